"""The operators against SQL, brute force, round trips and held-out accuracy; odd rows for all of them."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import chat, common, decontaminate, exact_dedup, langid, near_dedup, packing, pii, quality, secrets, sharding, tokens
from cairn.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept boolean, score double, key string, sid long, label string"
SAME = "the same text here of some words now"
ODD = [
    (1, SAME, "en", "a", 1), (1, SAME, "en", "a", 1), (2, SAME, None, None, None), (None, SAME, "en", None, 2), (None, None, None, None, None), (None, None, None, None, None),
    (3, "", "en", "a", 0), (4, "!!", "en", "a", 2), (5, "un deux trois quatre", "fr", "b", 3), (5, "other text with this id", "en", "b", 3), (6, "word " * 30_000 + "end", "en", "b", 150_003),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, None, 0.5, "k", 1, "x") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(autouse=True)
def few_ranges(monkeypatch):
    """Small tables need no more tasks than that."""
    monkeypatch.setattr(exact_dedup, "RANGES", 3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, data, same_as_sql):
    same_as_sql(QUERIES[name](spark, data), ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(name, spark, data, tmp_path):
    for t in ("documents", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "op7_chat" else 0)


# op1


def test_flow_is_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        m, n = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 4) for _ in range(m)]
        demand = [0] * n
        for _ in range(sum(supply)):
            demand[rng.randrange(n)] += 1
        cost = [[rng.randint(0, 5) for _ in range(n)] for _ in range(m)]
        flow = sharding.min_cost_flow(supply, demand, lambda i, j, c=cost: c[i][j])
        for i in range(m):
            assert sum(v for (a, _), v in flow.items() if a == i) == supply[i]
        for j in range(n):
            assert sum(v for (_, b), v in flow.items() if b == j) == demand[j]
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        slots = [j for j, s in enumerate(demand) for _ in range(s)]
        best = min((sum(cost[i][j] for i, j in zip(units, p, strict=True)) for p in set(itertools.permutations(slots))), default=0) if len(slots) <= 7 else None
        if best is not None:
            assert sum(v * cost[i][j] for (i, j), v in flow.items()) == best


def test_sharding_law(docs):
    p = sharding.op1(docs).toPandas()
    sizes = p.groupby("shard")["size"].sum()
    assert len(p) == docs.count() and set(p["shard"]) <= set(range(16))
    assert sizes.max() - sizes.min() <= 2 * p["size"].max()
    for _, s in p.groupby("shard")["slot"]:
        assert sorted(s) == list(range(len(s)))
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.size == len(text[r.doc_id]) + 1 for r in p.itertuples())
    least = sum(max(0, v - p["size"].sum() / 16) for v in p.groupby("old_shard")["size"].sum())
    assert abs(p[p.old_shard != p["shard"]]["size"].sum() - least) <= 16 * p["size"].max()


def test_files_are_rewritten(spark, docs, tmp_path):
    source = docs.withColumn("shard", F.pmod("doc_id", F.lit(3)).cast("int"))
    paths = sharding.reshard_files(source, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    stays = source.filter(~F.col("shard").isin(list(paths)))
    assert back.count() + stays.count() == docs.count()
    assert set(back.select("shard").distinct().toPandas()["shard"]) == set(paths)


# op2, op5


def test_quality_is_learned(spark, data, docs):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    m = quality.op2(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = m[m.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(m.doc_id, m.held_out, strict=True))


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, y = rng.integers(1, 4, 6).astype(float), rng.random(6)
        got = quality.isotonic(n, y * n)
        assert (np.diff(got) >= -1e-12).all()
        # Minimax form of the solution.
        want = [max(min((n[a : b + 1] * y[a : b + 1]).sum() / n[a : b + 1].sum() for b in range(i, 6)) for a in range(i + 1)) for i in range(6)]
        assert np.allclose(got, want)


def test_language_is_learned(docs):
    m = langid.op5(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = m[m.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert m.score.between(0, 1).all()


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 8, 20):
        code = langid.codewords(n)
        assert min((code[i] != code[j]).sum() for i, j in itertools.combinations(range(n), 2)) >= (2 if n > 2 else 1)


def test_no_letter_is_und(spark, docs):
    rows = spark.createDataFrame([(10_001, "12 34 !?"), (10_002, None), (10_003, ""), (10_004, "é"), (10_005, "中")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.lang_pred for r in langid.op5(docs.select("doc_id", "text", "lang").unionByName(rows)).filter("doc_id > 10000").collect()}
    assert [got[i] == "und" for i in sorted(got)] == [True, True, True, False, False]


def test_stage_keeps_texts_without_a_model(spark, data):
    """No label at all, labels on held-out rows only, and a language that is called und."""
    import corpus_pipeline

    texts = ["one two", "é", "中", "12 34 !?", "", None]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1]
    train = [i for i in range(100) if i not in held]
    for ids, lang in ((train, None), (held, "en"), (train, "und")):
        df = spark.createDataFrame([(i, t, lang) for i, t in zip(ids, texts, strict=False)], "doc_id long, text string, lang string")
        out = corpus_pipeline.STAGES[0][1](spark, df, data)
        assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == ids[:3]


# op3


def test_windows_of_short_items(spark):
    rows = spark.createDataFrame([(1, "One two THREE four"), (2, None), (3, ""), (4, "x one two three, y z a b c d e f g h i j k"), (5, "é É one"), (5, "é É one")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three"), (8, "!!"), (9, None), (10, "é"), (11, "a b c d e f g h i j k"), (12, "One two three")], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.op3(rows, items).collect())
    assert got == [(1, 4, 3, 2, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 17, 14, 3, True), (5, 3, 1, 1, True), (5, 3, 1, 1, True)]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(rows, items, "span").collect()}
    assert cut[1].split() == ["four"] and cut[2] is None and cut[4].split() == ["x", ",", "y", "z"]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(rows, items).collect()) == [2, 3]


def test_windows_in_blocks(spark, data, same_as_sql, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 100_000)
    same_as_sql(QUERIES["op3_decontaminate"](spark, data), ORACLES["op3_decontaminate"])


# op4


def brute_groups(rows, largest=True):
    pick = max if largest else min
    out = []
    for i, t in rows:
        ids = [j for j, u in rows if (u or "") == (t or "")]
        known = [j for j in ids if j is not None]
        out.append((i, pick(known) if known else None, len(ids)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda x: hashlib.sha256(x).digest()[:1]])
def test_exact_groups(spark, odd, digest, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 3)
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "", None, f"t{i}", "long " * 50])) for i in range(300)]
    for keep, df, plain in (("largest", odd, [(r[0], r[1]) for r in ODD]), ("smallest", spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)):
        got = exact_dedup.exact_groups(df, keep, digest).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == brute_groups(plain, keep == "largest")
        assert sum(r.kept for r in got) == len({t or "" for _, t in plain})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.exact_dedup(odd)
    assert sorted((r.text or "") for r in left.collect()) == sorted({t or "" for _, t, *_ in ODD}) and left.columns == odd.columns


# op6


def test_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    whole, own = Tokenizer.from_file(path), tokens.WordTokenizer(path)
    rng = random.Random(2)
    parts = ["a", "B", "é", "É", "'s", "'", "'ll", " ", "\n", "1", "22", "!", "<|", "<|endoftext|>", "中", "×", "÷", "ÿ", "ß", "don't", "WE'VE", "''s", ".'s", "İ", "_", "²", " ", "\t", "é"]
    for _ in range(100):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(30)]
        want = [e.ids for e in whole.encode_batch([*texts, ""], add_special_tokens=False)]
        assert [list(x) for x in own.encode(pa.array([*texts, None]))] == want


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary())
    for df in (docs, odd):
        p = packing.op6(df).toPandas().sort_values(["sequence_id", "offset"])
        assert (p.groupby("sequence_id")["length"].cumsum() - p["length"] == p["offset"]).all()
        assert p.groupby("sequence_id")["length"].sum().max() <= 2048
        assert p["sequence_id"].nunique() <= -(-p["length"].sum() // 2048) * 1.02 + 1
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = whole.encode(r.text or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), 2048):
                part = np.array(ids[k : k + 2048], "<u4").tobytes()
                want[r.doc_id, k // 2048, k, len(part) // 4, zlib.crc32(part)] += 1
        got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in p.itertuples())
        assert got == want


def test_sequences_hold_the_ids(spark, docs):
    pieces = common.stored(packing.cut(docs, packing.vocabulary(), "doc_id", with_ids=True), "pieces")
    packed = common.stored(packing.pack(pieces), "packed")
    lengths = {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()} == lengths


def test_elites_and_crossover():
    rng = np.random.default_rng(1)
    lengths = rng.integers(200, 1300, 300)
    for elites in ((), ((1024, 1024), (700, 700, 648))):
        bins = packing.evolve(lengths, elites=elites).bins
        assert sorted(i for b in bins for i in b) == list(range(300)) and max(lengths[b].sum() for b in bins) <= 2048


# op7


def test_chat_round_trip(spark):
    rng = random.Random(5)
    parts = ["\\", "|", "<", ">", "<|", "|>", "<|end|>", "\n", "a", "é", "中", "|>\n", "\\|"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys|>\n", "\\", "", None]), rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))])) for c in range(40) for t in range(6)]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_long_conversation_in_parts(spark, monkeypatch):
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "x<|" * 40) for i in range(5000)], "conv_id long, turn long, role string, text string")
    with common.small_batches(spark, 512):
        formatted = chat.format_conversations(turns)
        assert formatted.count() > 1
        row = chat.read_back(formatted).collect()
    assert len(row) == 1 and row[0].n_turns == 5000 and row[0].loss_chars == 2500 * 120


# op8, op10


def by_regex(text, kinds):
    out = sorted((m.start(), rank, k, m.end()) for rank, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in out).encode()).hexdigest(), [sum(o[2] == k for o in out) for k, _, _ in kinds]


def digits(m):
    return re.sub("[^0-9]", "", m[0])


SECRETS = [
    ("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


@pytest.mark.parametrize(("op", "kinds"), [(secrets.op8, SECRETS), (pii.op10, PERSONAL)])
def test_base_spans(spark, docs, odd, op, kinds):
    rng = random.Random(1)
    parts = ["a@", "b.c", "@", "-d", "_x@y.z", "1.2.3.4", "..", "5", "12 3", "4-5", "+1", "(9) 88", "token=", "a", "secret: 'x", "AKIA", "ABCDEFGH12345678", "0123456789ab", "api_key=", "é", " ", "%", "ſecret=abcdef", "4111 1111-11111111", "000256.1.1.1"]
    rows = [(100_000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12))), "s") for i in range(3000)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    df = docs.select("doc_id", "text", "source", "lang").unionByName(made)
    text = {r.doc_id: r.text or "" for r in df.collect()}
    for r in op(df).collect():
        assert (r.base_sha256, [r[f"n_{k}"] for k, _, _ in kinds]) == by_regex(text[r.doc_id], kinds), text[r.doc_id]
    assert op(odd).count() == len(ODD)


def test_ownership(spark):
    live, example = "Zk3aB9xT7qWm2LpR8vNc5JdY", "Ex4cD8yH1sGu6KfB0tQz3VwM"
    rows = [(1, f"key {live} here", "s1"), (2, f"key {live} again", "s1"), *[(10 + i, f"try {example} now", f"s{i}") for i in range(6)], (30, "token=abcdef123", "s9")]
    got = {r.doc_id: r for r in secrets.op8(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))).collect()}
    assert got[1].spans == f"owned:4:{4 + len(live)}" and got[1].n_live == 1
    assert got[10].spans == "" and got[10].n_example == 1
    assert got[30].spans == "assign:0:15" and got[30].n_live == 1


def test_patterns_find_unseen(spark):
    rows = [(i, f"client id: {i}0.2.3.{i} said so") for i in range(1, 9)] + [(50, "client id: ZX-99812-77 said so"), (51, "invoice no. 2024-1182 paid")]
    got = {r.doc_id: r.spans for r in pii.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "found:11:22" and got[51] == "" and got[1].startswith("ip:11:")


def test_short_runs_of_digits_are_scanned(spark):
    tokens = ["A1B2C3", "12-34-56", "555-123-987", "E123-456", "a1f0b9c2", "x/1.2y"]
    rows = [(100 + i, f"client id: 10.2.3.{i} said so") for i in range(1, 41)] + [(50 + i, f"client id: {t} said so") for i, t in enumerate(tokens)] + [(70, "client id: A1BCDEF said so")]
    got = {r.doc_id: r.spans for r in pii.op10(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[50 + i] for i in range(len(tokens))] == [f"found:11:{11 + len(t)}" for t in tokens] and got[70] == ""


def test_hint_lets_candidates_through():
    rng = random.Random(5)
    texts = ["".join(rng.choice("a1B2-._/ +@") for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    found = [t for t in texts if any(pii.identifier_like(m[0]) for m in pii._TOKEN.finditer(t)) or pii.find_base(t)]
    assert len(found) > 1000 and all(re.search(pii._HINT, t) for t in found)


def test_long_runs_are_linear():
    assert pii.find_personal("a" * 200_000 + "@" * 50_000 + "9" * 200_000)[0] == []
    assert secrets.find_secrets("f" * 200_000)[0] == [("hex", 0, 200_000)]


# op9


def brute_components(rows, n, percent=80):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        inside = len(sets[a] & sets[b])
        if inside and 100 * inside >= percent * (len(sets[a]) + len(sets[b]) - inside):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(rng):
    """Originals with copies that differ in a few words, chains, and texts that share a passage."""
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    passage = [rng.choice(words) for _ in range(60)]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((at, " ".join(copy)))
            at += 1
            if rng.random() < 0.5:
                base = copy
    for _ in range(25):
        rows.append((at, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(4, 20))])))
        at += 1
    rows += [(at, "one"), (at + 1, "ONE"), (at + 2, None), (at + 3, ""), (at + 4, " \t"), (at + 5, "one two"), (at + 6, "one  TWO")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_near_groups(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(near_dedup, "BLOCK", 4096)
    rows = family(random.Random(seed))
    want = brute_components(rows, 2)
    got = near_dedup.op9(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("count", (2, 3, 6))
def test_near_groups_of_one_short_text(spark, count):
    df = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(count)))], "doc_id long, text string")
    assert [tuple(r) for r in near_dedup.near_groups(df, n=5).collect()] == [(7, max(1, count - 4), 7, True)]


def test_near_groups_of_documents(docs):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op9(docs).collect()} == want


def test_missed_links_are_found(spark, docs):
    """Without any confirmed star, links within a bucket come from across()."""
    rows = [(r.doc_id, r.text) for r in docs.limit(0).collect()] + [(i, " ".join(f"w{k}" for k in range(100) if k != i)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = common.stored(df.select("doc_id", F.col("text").alias("_text")).mapInArrow(lambda it: near_dedup._banded(it, 2), "doc_id long, n_shingles long, sid long, bands array<long>"), "rows")
    members = made.select(F.lit(1).cast("long").alias("key"), "sid")
    sets = near_dedup.full_sets(made.select("sid"), df.select(F.col("text").alias("_text")), 2)
    none = spark.createDataFrame([], "node long, label long")
    assert near_dedup.across(members, none, sets, 80).count() == 15


# Filters that hand rows on, and the pipeline.


def test_filters_keep_rows_whole(odd):
    for f in (exact_dedup.exact_dedup, near_dedup.near_dedup, langid.keep_identified):
        out = f(odd)
        assert out.columns == odd.columns
        assert not out.exceptAll(odd).count()
    assert sharding.op1(odd).count() == len(ODD)
    assert sorted(r.lang_pred == "und" for r in langid.op5(odd).collect()).count(True) == 4


def test_pipeline(spark, data, docs):
    import corpus_pipeline

    rows, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        rows = common.stored(stage(spark, rows, data), name)
        kept.append(rows)
        if name != "packing":
            assert rows.columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    first = {i: t for i, t in text.items() if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in kept[0].collect()} == set(first)
    last = {t: i for i, t in sorted(first.items())}
    assert {r.doc_id for r in kept[1].collect()} == set(last.values())
    groups = brute_components([(i, first[i]) for i in last.values()], 5)
    assert {r.doc_id for r in kept[2].collect()} == {c for _, c in groups.values()}
    dirty = {r.doc_id for r in decontaminate.op3(docs, spark.read.parquet(f"{data}/benchmark.parquet")).filter("contaminated").collect()}
    assert {r.doc_id for r in kept[3].collect()} == {c for _, c in groups.values()} - dirty
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in kept[3].collect()}
    assert kept[4].count() == corpus_pipeline.run(spark, data).count()
