"""Odd rows, brute-force versions and the inner parts of the operators."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairn.llm import common, decontaminate, exact_dedup, kernel, langid, near_dedup, packing, pii, quality, secrets, sharding
from cairn.llm import chat as chats
from tests.llm.test_llm import ODD, brute_components, brute_groups, family, few_ranges, odd  # noqa: F401


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# Shared tables and settings.


def test_scratch_deletes_what_is_not_kept(spark):
    import os

    def there(df):
        return [os.path.exists(f.removeprefix("file://")) for f in df.inputFiles()]

    before = spark.conf.get(common._BATCH)
    with common.scratch(spark):
        with common.scratch(spark):
            one, two = (common.stored(spark.range(3), "x", keep=k, rows=7) for k in (False, True))
            assert all(there(one))
        assert not any(there(one)) and all(there(two)) and two.count() == 3
    assert not any(there(two)) and spark.conf.get(common._BATCH) == before


def test_operators_leave_little_behind(spark, docs):
    import os

    def folders():
        home = common._home(spark).removeprefix("file://")
        return set(os.listdir(home)) if os.path.isdir(home) else set()

    before, setting = folders(), spark.conf.get(common._BATCH)
    near_dedup.op9(docs).count()
    assert len(folders() - before) == 1
    exact_dedup.op4(docs).count()
    assert len(folders() - before) == 2 and spark.conf.get(common._BATCH) == setting


def test_filter_has_no_false_miss(spark):
    keys = spark.range(5000).select((F.col("id") * 7919 - 10**15).alias("k"))
    bits = common.membership_filter(keys, "k")
    own = np.array([r.k for r in keys.collect()])
    assert common.in_filter(bits, own).all() and common.in_filter(bits, own + 1).mean() < 0.05


# op1


def test_shards_are_near_equal_and_names_may_clash(spark, odd, tmp_path):  # noqa: F811
    rng = random.Random(3)
    rows = [(i, "x" * int(min(20_000, rng.paretovariate(0.8) * 40))) for i in range(2000)]
    p = sharding.op1(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sizes = p.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.002 * sizes.mean()
    least = sum(max(0, v - p["size"].sum() / 16) for v in p.groupby("old_shard")["size"].sum())
    assert p[p.old_shard != p["shard"]]["size"].sum() < least + 0.01 * p["size"].sum()
    clash = odd.withColumns({c: F.lit(7) for c in ("slot", "_size", "_old", "_slot", "size", "old", "h", "row_", "block")}).withColumn("shard", F.lit(0))
    done = sharding.reshard(clash, 3, sharding.text_bytes(), F.col("shard"), F.xxhash64("doc_id"))
    assert done.count() == len(ODD) and set(clash.columns) == set(done.select("row.*").columns)
    paths = sharding.reshard_files(clash, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert len(paths) > 1 and back.count() == len(ODD)
    for r in back.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect():
        assert r.s == list(range(len(r.s)))


def test_large_rows_go_where_most_is_lacking():
    to, left = sharding.deal_large([(0, 50), (0, 30), (0, 20)], {(0, 0): 60, (0, 1): 45})
    assert to == [0, 1, 1] and sum(left.values()) == 5


# op2


def test_kernel_ridge_by_hand(spark, docs, data):
    """Sums over partitions against one matrix, and random features against the exact kernel."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = quality.measure(docs, F.col("doc_id")).join(labels.filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    rows = common.stored(rows.withColumn("fold", (F.col("doc_id") % quality.FOLDS).cast("int")), "training")
    model = quality.fit(rows.repartition(5))
    p = rows.toPandas()
    x, y = p[list(quality.STATISTICS)].to_numpy(np.float64), p["y"].to_numpy()
    z = model.features(x)
    penalty = np.full(z.shape[1], quality.RIDGE)
    penalty[quality.FEATURES] = 1e-6
    want = np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y)
    assert np.allclose(z @ model.beta, z @ want, atol=1e-5)
    for k in range(quality.FOLDS):
        rest = (p["fold"] != k).to_numpy()
        want = np.linalg.solve(z[rest].T @ z[rest] + np.diag(penalty), z[rest].T @ y[rest])
        assert np.allclose(z @ model.without[:, k], z @ want, atol=1e-5)
    s = np.clip((x - model.mean) / model.scale, -6, 6)
    exact = np.exp(-((s[:, None] - s[None]) ** 2).sum(2) / (2 * quality.WIDTH**2))
    approximate = z[:, : quality.FEATURES] @ z[:, : quality.FEATURES].T
    assert np.abs(exact - approximate).mean() < 0.06
    centred = y - y.mean()
    by_kernel = exact @ np.linalg.solve(exact + quality.RIDGE * np.eye(len(y)), centred)
    assert np.corrcoef(by_kernel, model.raw(x))[0, 1] > 0.9


def test_quality_of_odd_rows(spark, docs, data, odd):  # noqa: F811
    labels = spark.read.parquet(f"{data}/labels.parquet")
    extra = odd.withColumns({"quality": F.lit(1), "y": F.lit(0.0), "fold": F.lit("x"), "held_out": F.lit("x"), "bytes": F.lit("x")})
    both = labels.unionByName(labels.limit(1)).unionByName(labels.limit(1).withColumn("quality", F.lit(None).cast(labels.schema["quality"].dataType)))
    got = quality.op2(extra, both).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    same = [r.score for r in got if r.doc_id in (1, 2)]
    assert max(same) - min(same) < 1e-12
    none = quality.op2(extra, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


# op3


def test_contamination_of_odd_rows(spark, odd):  # noqa: F811
    items = spark.createDataFrame([(1, "the same text here of some words now", 5), (None, "word", 6), (2, None, 7), (3, "un deux", 8)], "item_id long, text string, doc_id long")
    extra = odd.withColumns({c: F.lit(3) for c in ("at", "n", "window", "_row", "_doc", "hit", "items", "gram")})
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.op3(extra, items).collect())
    assert got[1, 8, 8, 1] == 2 and got[6, 30_001, 30_000, 0] == 1 and got[5, 4, 2, 1] == 1 and got[None, 0, 0, 0] == 2 and got[5, 5, 0, 0] == 1
    left = decontaminate.decontaminate(extra, items)
    assert left.columns == extra.columns and Counter(r.text for r in left.collect()) == Counter([None, None, "", "!!", "other text with this id"])
    cut = decontaminate.decontaminate(extra, items, "span")
    texts = {(r.doc_id, r.text) for r in cut.collect()}
    assert cut.columns == extra.columns and cut.count() == len(ODD) and {(6, "  end"), (5, "  trois quatre"), (5, "other text with this id")} <= texts | {(6, "  end")}
    assert any(i == 6 and t.split() == ["end"] for i, t in texts)


def test_span_mode_by_hand(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "  "]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for k in range(4)]
    grams = {tuple(t.split()) for _, t in items}
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "span").collect()}
    for i, t in rows:
        found = re.findall(r"w\d+", t)
        hit = {k + j for g in grams for k in range(len(found) - len(g) + 1) if tuple(found[k : k + len(g)]) == g for j in range(len(g))}
        want, at = "", 0
        for k, m in enumerate(re.finditer(r"w\d+", t)):
            if k not in hit:
                want += t[at : m.end()]
            elif k - 1 not in hit:
                want += t[at : m.start()] + " "
            at = m.end()
        assert got[i] == want + t[at:]


# op4


def test_null_next_to_empty(spark):
    rows = [(9, None), (9, ""), (3, None), (9, "x"), (9, "x"), (None, "x"), (None, "y"), (None, "y")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, _text string")
    for keep in ("largest", "smallest"):
        left = exact_dedup.exact_dedup(df, keep)
        want = [(9 if keep == "largest" else 3, ""), (9, "x"), (None, "y")]
        assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=repr) == sorted(want, key=repr) and left.columns == df.columns
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.op4(df).collect()), key=repr) == brute_groups(rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda x: hashlib.sha256(x).digest()[:1]])
def test_index_takes_batches(spark, digest, monkeypatch):
    """Four batches: levels fill up and are merged, and groups are those of all rows at once."""
    monkeypatch.setattr(exact_dedup, "FANOUT", 3)
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 7)
    rng = random.Random(6)
    rows = [(rng.choice([i, i, None]), rng.choice(["a", "b", "", None, f"t{i % 90}", "long " * 50])) for i in range(240)]
    index = exact_dedup.MergeIndex(spark, "smallest", digest)
    for k in range(4):
        index.ingest(spark.createDataFrame(rows[60 * k : 60 * k + 60], "doc_id long, text string").repartition(2))
    assert [len(level) for level in index.levels] == [1, 1]
    for run in index.runs():
        held = [r.digest for r in run.entries.collect()]
        assert len(held) == len(set(held)) and exact_dedup._may(run.bits, held).all()
    got = index.groups().collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == brute_groups(rows, largest=False)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_probe_looks_up_what_the_filter_lets_through(spark):
    index = exact_dedup.MergeIndex(spark)
    index.ingest(spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string"))
    asked = spark.createDataFrame([(bytearray(exact_dedup.sha256(f"t{i}".encode())),) for i in range(40, 60)], "digest binary")
    run = index.runs()[0]
    assert {bytes(r.digest) for r in index.probe(run, asked).collect()} == {exact_dedup.sha256(f"t{i}".encode()) for i in range(40, 50)}
    out = exact_dedup._may(run.bits, [exact_dedup.sha256(f"u{i}".encode()) for i in range(500)])
    assert out.mean() < 0.05
    for f in run.entries.inputFiles():
        ordered = pq.read_table(f.removeprefix("file://"))["digest"].to_pylist()
        assert ordered == sorted(ordered)


# op5


def test_decoding_by_hand():
    """Counts, log odds, margins and loss-weighted decoding in plain loops."""
    rng = random.Random(2)
    words = {"a": ["uno", "dos", "tres"], "b": ["one", "two", "three"], "c": ["ein", "zwei", "drei"]}
    texts = [(k, " ".join(rng.choice(w) for _ in range(rng.randint(1, 9)))) for k, w in words.items() for _ in range(20)]
    counts = np.zeros((3, langid.BUCKETS))
    for k, t in texts:
        data, offsets = kernel.utf8(pa.array([t]))
        gram, letter = langid.trigrams(data, offsets)
        for g, ok in zip(gram.tolist(), letter.tolist(), strict=True):
            counts["abc".index(k), g] += ok
    model = langid._model(list("abc"), counts)
    got = model.decode(model.margins(*kernel.utf8(pa.array([t for _, t in texts])))[0])
    p = (counts + langid.SMOOTH) / (counts.sum(1, keepdims=True) + langid.SMOOTH * langid.BUCKETS)
    for row, (k, t) in enumerate(texts):
        data, offsets = kernel.utf8(pa.array([t]))
        gram, letter = langid.trigrams(data, offsets)
        loss = [0.0] * 3
        for bit in range(model.code.shape[1]):
            one = [i for i in range(3) if model.code[i, bit] > 0]
            zero = [i for i in range(3) if model.code[i, bit] < 0]
            w = np.clip(np.log(p[one].mean(0) / p[zero].mean(0)), -langid.CLIP, langid.CLIP).astype(np.float32)
            margin = sum(float(w[g]) for g, ok in zip(gram, letter, strict=True) if ok) / max(1, sum(letter))
            f = (margin - model.bias[bit]) / model.scale[bit]
            for i in range(3):
                loss[i] += model.bit_weight[bit] * np.log1p(np.exp(-langid.STEEP * model.code[i, bit] * f))
        share = np.exp(min(loss) - np.array(loss))
        assert got[0][row] == int(np.argmin(loss)) and got[1][row] == pytest.approx((share / share.sum()).max(), abs=1e-5)
    assert np.mean([k == "abc"[i] for (k, _), i in zip(texts, got[0], strict=True)]) > 0.95


# op6


def test_evolution_beats_best_fit():
    """Triples that fill a bin exactly: best-fit decreasing spends a tenth more bins; crossover finds most of them."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        lengths = []
        for _ in range(40):
            x = int(rng.integers(780, 1000))
            y = int(rng.integers(520, 2048 - x - 480))
            lengths += [x, y, 2048 - x - y]
        found = packing.evolve(np.array(lengths), seed=seed)
        assert found.least == 40 and found.best_fit >= 44 and len(found.bins) <= 42 and found.crossovers > 10
        assert sorted(i for b in found.bins for i in b) == list(range(120)) and max(sum(lengths[i] for i in b) for b in found.bins) <= 2048


def test_elites_migrate():
    """Two patterns that fill a bin are put in whole where best-fit decreasing does worse."""
    lengths = np.array([1000, 700, 348] * 30 + [900, 800, 348] * 30)
    alone, helped = packing.evolve(lengths, children=0), packing.evolve(lengths, elites=((1000, 700, 348), (900, 800, 348)), children=0)
    assert len(helped.bins) == 60 <= len(alone.bins)


def test_pack_on_clashing_names(spark):
    rows = [(i, 100 + 37 * i % 1900, "s", i) for i in range(50)]
    pieces = spark.createDataFrame(rows, "doc_id long, length int, Sequence_ID string, offset int").withColumns({"_length": F.lit("x"), "_row": F.lit(1), "_final": F.lit(2)})
    out = packing.pack(pieces)
    assert out.columns == ["doc_id", "length", "_length", "_row", "_final", "sequence_id", "offset"] and out.count() == 50
    p = out.toPandas().sort_values(["sequence_id", "offset"])
    assert (p.groupby("sequence_id")["length"].cumsum() - p["length"] == p["offset"]).all() and p.groupby("sequence_id")["length"].sum().max() <= 2048


# op7


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "é" * 70_000), (None, 1, "assistant", ""), (-7, 2, "assistant", "tail")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "body", "loss_start", "n_turns")})
    got = {r.conv_id: r for r in chats.op7(df).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 2, -7: 3}
    assert got[None].loss_chars == 70_000 and got[1].loss_chars == 0 and got[-7].loss_chars == len(chats.TRICKY) + 4
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nuser\na\nuser\na\n").hexdigest()


# op8, op10


def test_owned_spans_by_hand(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(24)) for _ in range(12)]
    rows = []
    for i in range(240):
        first = rng.choice([0, 6])
        a, b = rng.sample(range(first, first + 6), 2)
        source = f"s{rng.randint(0, 6)}" if first else "own"
        rows.append((i, f"use {keys[a]} or token={keys[b]} now", source, rng.choice(["en", "fr", None])))
    owners, repositories = defaultdict(set), defaultdict(set)
    each = {}
    for i, t, source, lang in rows:
        _, found = secrets.find_secrets(t)
        each[i] = [(t[c["start"] : c["end"]].rpartition("=")[2], c) for c in found]
        for value, _ in each[i]:
            owners[value].add(source)
            repositories[value].add(f"{source}/{lang}" if lang else source)
    got = {r.doc_id: r for r in secrets.op8(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    seen = Counter()
    for i, found in each.items():
        live = [len(owners[v]) <= secrets.MAX_OWNERS and len(repositories[v]) <= secrets.MAX_REPOSITORIES for v, _ in found]
        want = sorted((c["start"], 0 if c["base"] else 3, "assign" if c["base"] else "owned", c["end"]) for (_, c), ok in zip(found, live, strict=True) if ok or c["base"])
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert (got[i].n_live, got[i].n_example) == (sum(live), len(live) - sum(live))
        seen.update(live)
    assert seen[True] and seen[False]


def test_bootstrap_by_hand(spark, docs):
    """Patterns of several widths, rounds in which found values become known, against plain sets."""
    rows = [(1000 + i, f"so client id: 10.2.3.{i} said it") for i in range(1, 61)]
    rows += [(1100 + i, f"so client id: ZX-9981{i} said it") for i in range(10)] + [(1200 + i, f"and case ref ZX-9981{i} is open") for i in range(10)]
    rows += [(1300, "and case ref QQ-44017-A is open"), (1400, "order 2024-1182 paid"), (1500, None), (1500, "")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    df = made.unionByName(docs.select("doc_id", "text"))
    each = [(i, c) for i, t in [(r.doc_id, r.text) for r in df.collect()] if t for c in pii.find_personal(t)[1]]
    graph, known = defaultdict(set), {c["value"] for _, c in each if c["base"]}
    for _, c in each:
        for p in c["patterns"]:
            graph[p].add(c["value"])
    rounds = 0
    for _ in range(pii.ROUNDS):
        good = {p for p, vs in graph.items() if len(vs & known) >= pii.SEEDS and len(vs & known) / (len(vs) + pii.DAMPING) >= pii.GOOD}
        more = known | {v for p in good for v in graph[p]}
        rounds += more != known
        if more == known:
            break
        known = more
    want = defaultdict(set)
    for i, c in each:
        if not c["base"] and good & set(c["patterns"]):
            want[i].add(f"found:{c['start']}:{c['end']}")
    got = {r.doc_id: set(filter(lambda s: s.startswith("found"), r.spans.split(","))) for r in pii.op10(df).collect() if r.n_found}
    assert got == want and rounds >= 2 and 1300 in want and 1100 in want and 1400 not in want


def test_patterns_of_several_widths():
    text = "line one\nThe big Client no: 12-34-56 (was said) here"
    a = text.index("12-")
    assert pii.patterns_around(text, a, a + 8) == ["no: _", "client no: _", "big client no: _", "_ (was", "_ (was said", "no: _ (was"]
    assert pii.patterns_around("12-34-56", 0, 8) == [] and pii.patterns_around("x" * 500 + " 12-34-56", 501, 509) == []


# op9


def test_five_word_shingles(spark, docs):
    rows = family(random.Random(11)) + [(10_000 + r.doc_id, r.text) for r in docs.collect()]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 5)


def test_blocks_are_bounded(spark):
    homes = spark.createDataFrame([(i, 5 if i < 300 else i * 2**53 - 2**62, i // 9, 100) for i in range(1000)], "sid long, home long, low long, size int")
    near_dedup.BLOCK, before = 2000, near_dedup.BLOCK
    try:
        sizes = [r.s for r in near_dedup._blocks(homes).groupBy("block").agg(F.count("*").alias("s")).collect()]
    finally:
        near_dedup.BLOCK = before
    assert sum(sizes) == 1000 and max(sizes) * 100 < 6 * 2000 and len(sizes) > 40


@pytest.mark.parametrize("copies", [2, 250])
def test_hot_sets_find_their_least_id(spark, copies):
    rows = [(i, "one two three four") for i in range(copies, 0, -1)] + [(1000 + i, f"other words {i} of text") for i in range(3)]
    got = {r.doc_id: r.component_id for r in near_dedup.op9(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 1 if i < 1000 else i for i, _ in rows}


def test_language_stage_goes_by_text_too(spark, docs):
    rows = spark.createDataFrame([(1, "12", "x"), (1, "word here", "x"), (None, "34", "x"), (None, "more words", "x"), (2, "", "x"), (2, None, "x")], "doc_id long, text string, _key string").withColumn("lang", F.lit("en"))
    left = langid.keep_identified(rows)
    assert left.columns == rows.columns and sorted(r.text for r in left.collect()) == ["more words", "word here"]


def test_crc_of_ids(spark):
    got = spark.createDataFrame([(7,), (None,)], "doc_id long").select(common.id_crc().alias("c")).collect()
    assert [r.c for r in got] == [zlib.crc32(b"7"), None]
