"""Near duplicates by one-permutation MinHash with optimal densification.

A text is its set of distinct word shingles; sets, not rows, are the nodes, so that copies cost
nothing beyond one row each. One hash of each shingle fills 512 slots; an empty slot takes the
value of the first full one on its own random walk. 64 bands of 8 slots give the buckets: a pair
at the threshold of 0.8 shares none with a chance of 1 in 100,000, and unrelated texts hardly ever
share one however many there are.
Edges of a bucket form a star. Its centre is the member that collides most over all bands, the
likely original of a family of copies. Each edge is confirmed on the full sets. Where confirmed
links leave the rest of a bucket in several components, its sets are held against each other
inside tasks, by sketches and then by the full sets, in pairs of blocks of bounded bytes that share
such a bucket; only links leave a task, so that the star loses none and no list of pairs is
formed. Components come from labels that spread along links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import kernel as K
from cairn.llm.common import in_filter, membership_filter, scratch, stored

SLOTS, BANDS = 512, 64
ROWS = SLOTS // BANDS
#: Bytes of sets in a block, a task holding two; slots of the first look at sketches, and how far
#: below the threshold an estimate may be to go on: five standard deviations or more.
BLOCK, LOOK, LOOK_SLACK, SLACK = 2 << 20, 128, 0.18, 0.11
#: Rows of an Arrow batch: full sets are long.
ROWS_OF_BATCH = 1024

_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text; of all its words if they are fewer."""
    low = K.ASCII_LOWER[data]
    starts, ends, first = K.runs(_WORD[data], offsets)
    words = K.span_hashes(low, starts, ends)
    count = len(words)
    rolled = np.zeros(count, np.uint64)
    # With fewer words than n in all, no text reads rolled.
    for k in range(min(n, count)):
        rolled[: count - k] = rolled[: count - k] * K.u64(0x9E3779B97F4A7C15) + words[k:]
    rolled = K.mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(rolled[a : b - n + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            h = 0
            for w in words[a:b].tolist():
                h = (h * 0x9E3779B97F4A7C15 + w + (b - a)) & 0xFFFFFFFFFFFFFFFF
            out.append(K.mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """Number of a set: 64 bits of a digest of its members."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SLOTS values for each non-empty set."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(n), size)
    slot = (flat >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    cell = of * SLOTS + slot
    # Sorted sets: the first value of a slot is its least.
    first = np.r_[True, cell[1:] != cell[:-1]]
    out = np.zeros(n * SLOTS, np.uint64)
    out[cell[first]] = K.mix(flat[first])
    full = np.zeros(n * SLOTS, bool)
    full[cell[first]] = True
    empty = np.flatnonzero(~full)
    row, own = empty // SLOTS * SLOTS, (empty % SLOTS).astype(np.uint64)
    step = 0
    while len(empty):
        probe = (K.mix(own * K.u64(0xD1B54A32D192ED03) + K.u64(step * 0x8CB92BA72F3D8DD7 + 1)) & np.uint64(SLOTS - 1)).astype(np.int64)
        hit = full[row + probe]
        out[empty[hit]] = out[row[hit] + probe[hit]]
        empty, row, own = empty[~hit], row[~hit], own[~hit]
        step += 1
    return out.reshape(n, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        keys = (keys ^ parts[:, :, k]) * K.u64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return K.mix(keys + np.arange(BANDS, dtype=np.uint64) * K.u64(0xD6E8FEB86659FD93)).view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("_text")
        for a, b, data, offsets in K.text_pieces(column):
            sets = shingles(data, offsets, n)
            some = [i for i, s in enumerate(sets) if len(s)]
            ids: list[int | None] = [None] * (b - a)
            bands: list[np.ndarray | None] = [None] * (b - a)
            if some:
                keys = band_keys(signatures([sets[i] for i in some]))
                for k, i in enumerate(some):
                    ids[i], bands[i] = set_id(sets[i]), keys[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "sid", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], n: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets whose number may be wanted, each once for a task, and a byte of each slot of their signatures."""
    seen: set[int] = set()
    for batch in batches:
        for _, _, data, offsets in K.text_pieces(batch.column("_text")):
            sets = [s for s in shingles(data, offsets, n) if len(s)]
            ids = np.array([set_id(s) for s in sets], np.int64)
            rows = []
            for i in np.flatnonzero(in_filter(bits, ids)).tolist():
                if ids[i] not in seen:
                    seen.add(int(ids[i]))
                    rows.append(i)
            if rows:
                low = (signatures([sets[i] for i in rows]) & np.uint64(255)).astype(np.uint8)
                columns = [pa.array(ids[rows]), pa.array([sets[i].tobytes() for i in rows], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["sid", "members", "sketch"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct members."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    inside = int((both[1:] == both[:-1]).sum())
    return 100 * inside >= percent * (len(both) - inside)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def full_sets(wanted: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Stored: sid, members and sketch of the sets whose numbers are in wanted (and a few more, if it is very large)."""
    bits = wanted.sparkSession.sparkContext.broadcast(membership_filter(wanted, "sid"))
    found = texts.mapInArrow(lambda it: _sets(it, n, bits.value), "sid long, members binary, sketch binary")
    return stored(found.groupBy("sid").agg(F.first("members").alias("members"), F.first("sketch").alias("sketch")), "sets", rows=ROWS_OF_BATCH)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored: the pairs (a, b) of set numbers whose full sets are similar."""
    x, y = sets.select(F.col("sid").alias("a"), F.col("members").alias("x")), sets.select(F.col("sid").alias("b"), F.col("members").alias("y"))
    # Members first: a centre has many edges, and Spark splits that side of the second join.
    joined = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return stored(joined.mapInArrow(lambda it: _confirmed(it, percent), "a long, b long"), "links", rows=ROWS_OF_BATCH)


def components(links: DataFrame) -> DataFrame:
    """Stored: node and label, the same node for all that links (a, b) join, for each node of links.

    Each round takes the least neighbour, follows it once more, and contracts the edges by these
    labels; what lies within one label goes, so that rounds end after a logarithm of the nodes and
    a star is done in one.
    """
    with scratch(links.sparkSession):
        edges = stored(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "edges")
        nodes = None
        while True:
            near = edges.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("label"))
            hop = near.select(F.col("a").alias("label"), F.col("label").alias("next"))
            level = stored(near.join(hop, "label").select("a", F.col("next").alias("label")), "level")
            low = edges.join(level, "a").select("b", F.col("label").alias("la"))
            edges = low.join(level.withColumnRenamed("a", "b"), "b").filter("la != label").select(F.col("la").alias("a"), F.col("label").alias("b")).distinct()
            edges = stored(edges, "edges")
            last = not edges.limit(1).count()
            if nodes is None:
                nodes = level.withColumnRenamed("a", "node")
            else:
                nodes = nodes.join(level.withColumnRenamed("label", "next"), nodes["label"] == level["a"], "left").select("node", F.coalesce("next", "label").alias("label"))
            if last:
                return stored(nodes, "nodes", keep=True)
            nodes = stored(nodes, "nodes")


def _links(rows: list[tuple], percent: int) -> pa.RecordBatch | None:
    """Links between rows (group, side, sid, label, sketch, members) of two blocks, or within one, of different labels."""
    within = rows[0][1] == "B"
    left = [r for r in rows if r[1] != "R"]
    right = left if within else [r for r in rows if r[1] == "R"]
    if not right or len({r[3] for r in rows}) < 2:
        return None
    ids, labels = np.array([r[2] for r in right]), np.array([r[3] for r in right])
    sketch = np.frombuffer(b"".join(r[4] for r in right), np.uint8).reshape(-1, SLOTS)
    look = np.ascontiguousarray(sketch[:, :LOOK])
    sets = [np.frombuffer(r[5], np.uint64) for r in right]
    least = percent / 100
    a, b = [], []
    for _, _, sid, label, own, members in left:
        where = np.flatnonzero((labels != label) & (ids > sid)) if within else np.flatnonzero(labels != label)
        for part, table, slack in ((LOOK, look, LOOK_SLACK), (SLOTS, sketch, SLACK)):
            same = np.count_nonzero(table[where] == np.frombuffer(own, np.uint8)[:part], axis=1)
            where = where[same >= (least - slack) * part]
        mine = np.frombuffer(members, np.uint64)
        for i in where.tolist():
            if similar(mine, sets[i], percent):
                a.append(sid)
                b.append(ids[i])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None


def _across_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("group", "side", "sid", "label", "sketch", "members")), strict=True):
            if rows and rows[0][0] != row[0]:
                if (found := _links(rows, percent)) is not None:
                    yield found
                rows = []
            rows.append(row)
    if rows and (found := _links(rows, percent)) is not None:
        yield found


def _blocks(homes: DataFrame) -> DataFrame:
    """homes (sid, home, low, size) with block: sets of one home together, in blocks of about BLOCK bytes.

    Homes are hashes, so that ranges of them are dealt evenly; the sets of a home of more than
    half a block are dealt out by low over blocks of its own, neighbours in a bucket together.
    """
    total = homes.agg(F.sum("size").alias("s")).collect()[0]["s"] or 0
    ranges = max(1, -(-total // BLOCK))
    where = F.least(F.floor((F.col("home") / 2.0**64 + 0.5) * ranges), F.lit(ranges - 1)).cast("string")
    large = homes.groupBy("home").agg(F.sum("size").alias("s")).filter(F.col("s") > BLOCK // 2).select("home", F.ceil(2 * F.col("s") / BLOCK).alias("parts"))
    # Copies share the least bucket of many sets; their sets are dealt out by half.
    part = F.concat_ws("/", "home", F.pmod(F.xxhash64("low", F.pmod("sid", F.lit(4))), "parts"))
    return homes.join(large, "home", "left").select("sid", F.when(F.col("parts").isNull(), where).otherwise(part).alias("block"))


def across(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored: links that the stars missed. members (key, sid): the buckets without their centres.

    A link can be missing only between members of one bucket with different labels. The sets of
    such buckets are dealt into blocks, those that buckets join together, and two blocks meet if a
    bucket has members of different labels in them: the work grows with the pairs of blocks that
    share a bucket, not with the square of what edges join to a family.
    """
    with scratch(members.sparkSession):
        named = members.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("label", "sid").alias("label"))
        mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("sid").alias("first")).filter("low != high").select("key", "first")
        named = stored(named.join(mixed, "key"), "mixed")
        joined = components(named.select(F.col("first").alias("a"), F.col("sid").alias("b")).filter("a != b").distinct())
        low = named.groupBy("sid").agg(F.min("key").alias("low"), F.first("label").alias("label"))
        rows = low.join(joined.select(F.col("node").alias("sid"), F.col("label").alias("home")), "sid").join(sets, "sid")
        rows = stored(rows, "rows")
        blocks = stored(_blocks(rows.select("sid", "home", "low", (F.octet_length("members") + SLOTS).alias("size"))), "blocks")
        # For each bucket its blocks with the least and largest label there; then pairs of them.
        parts = named.join(blocks, "sid").groupBy("key", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        lists = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "low", "high"))).alias("p"))
        pairs = lists.select(F.posexplode("p").alias("i", "x"), "p").select("x", F.explode(F.expr("slice(p, i + 1, size(p) - i)")).alias("y"))
        pairs = pairs.filter("NOT (x.low = x.high AND y.low = y.high AND x.low = y.low)").select(F.col("x.block").alias("low"), F.col("y.block").alias("high")).distinct()
        pairs = stored(pairs.select(F.concat_ws(" ", "low", "high").alias("group"), "low", "high"), "pairs")
        same = pairs.filter("low = high").select("group", F.lit("B").alias("side"), F.col("low").alias("block"))
        other = pairs.filter("low != high")
        to = same.unionByName(other.select("group", F.lit("L").alias("side"), F.col("low").alias("block"))).unionByName(other.select("group", F.lit("R").alias("side"), F.col("high").alias("block")))
        rows = rows.join(blocks, "sid").join(to, "block").select("group", "side", "sid", "label", "sketch", "members")
        rows = rows.repartition("group").sortWithinPartitions("group", "side")
        return stored(rows.mapInArrow(lambda it: _across_batches(it, percent), "a long, b long"), "missed", keep=True, rows=ROWS_OF_BATCH)


def _look_up(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows joined with found, which has one row for each key and n, the rows that have it.

    Keys with over a thousandth of all rows, and over a hundred, are looked up in a broadcast table,
    of a thousand rows at most; the others by a join in which no key has more than that.
    """
    many = max(100, (found.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0) // 1000)
    hot = F.broadcast(found.filter(F.col("n") > many).drop("n"))
    cold = found.filter(F.col("n") <= many).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


def _least_ids(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc_id, n_shingles, sid) with component_id."""
    by_set = rows.groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = by_set.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "least", F.col("n").alias("rows"), F.coalesce("label", "sid").alias("label"))
    named = stored(named, "named")
    least = stored(named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    found = stored(_look_up(named, least, "label").select("sid", F.col("rows").alias("n"), "component_id"), "found")
    return _look_up(rows, found, "sid").select("doc_id", "n_shingles", "component_id")


def near_groups(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id, kept.

    Sets of n-word shingles are linked from a Jaccard similarity of percent / 100 on;
    component_id is the smallest doc_id that links and equal sets lead to. Null and empty texts,
    and those without words, have no shingles and are linked with nothing. Null doc_ids take part and
    come last; a group of them alone has a null component_id and keeps its rows. Rows that repeat a
    kept doc_id are kept with it. No limit on buckets, partners or groups. Columns beyond doc_id
    and text are not read.
    """
    with scratch(documents.sparkSession):
        docs = documents.select("doc_id", F.col("text").alias("_text"))
        rows = stored(docs.mapInArrow(lambda it: _banded(it, n), "doc_id long, n_shingles long, sid long, bands array<long>"), "rows", rows=ROWS_OF_BATCH)
        banded = rows.filter("sid IS NOT NULL").select("sid", F.explode("bands").alias("key"))
        buckets = banded.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low != high").select("key")
        members = stored(banded.join(buckets, "key").distinct(), "members")
        sets = full_sets(members.select("sid").distinct(), docs.select("_text"), n)

        sizes = members.groupBy("key").agg(F.count("*").alias("n"))
        scores = members.join(sizes, "key").groupBy("sid").agg(F.sum("n").alias("score"))
        centres = members.join(scores, "sid").groupBy("key").agg(F.max(F.struct("score", "sid")).alias("top")).select("key", F.col("top.sid").alias("centre"))
        rest = stored(members.join(centres, "key").filter("sid != centre"), "rest")
        # The centre is side a of an edge here, whatever its number.
        links = confirm(rest.select(F.col("centre").alias("a"), F.col("sid").alias("b")).distinct(), sets, percent)
        labels = components(links)
        missed = across(rest.select("key", "sid"), labels, sets, percent)
        if missed.limit(1).count():
            labels = components(links.unionByName(missed))

        grouped = _least_ids(rows.filter("sid IS NOT NULL").select("doc_id", "n_shingles", "sid"), labels)
        alone = rows.filter("sid IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return stored(grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "groups", keep=True)


def near_dedup(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """documents with one doc_id of each near-duplicate group, the smallest; rows and columns that stay are as they came.

    Null, empty and wordless texts stay. Rows of one doc_id stay or go together; a null doc_id stays
    if its group has no other.
    """
    with scratch(documents.sparkSession):
        groups = near_groups(documents.select("doc_id", "text"), n, percent)
        gone = groups.groupBy("doc_id").agg(F.max("kept").alias("any")).filter("NOT any").select(F.col("doc_id").alias("_gone"))
        # Its size is known once it is stored, and Spark broadcasts it only below its threshold.
        gone = stored(gone, "gone", keep=True)
    return documents.join(gone, documents["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def op9(documents: DataFrame) -> DataFrame:
    """near_groups() with two-word shingles, for all rows of documents."""
    return near_groups(documents, n=2)
