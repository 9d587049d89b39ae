"""Best-fit packing by a grouping genetic algorithm on islands.

A gene is a bin. Crossover puts well-filled bins of one parent into the other whole, takes out
the bins that then hold a piece twice, lets displaced pieces take the place of shorter ones where
they fill a bin better, and best-fits the rest; mutation empties the worst bins. The first
solution is best-fit decreasing, and evolution starts where it misses the least number of bins
that there can be. Pieces are dealt out over islands of bounded size that evolve by themselves.
After an epoch the full bins are final, the contents of the rest move to islands that are dealt
anew, and the elites - the commonest contents of full bins, as lengths - migrate to all of them,
where one solution starts from them.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import scratch, stored

CAPACITY = 2048
#: Pieces of an island, solutions in its population, children that it breeds at most, and how many of them in vain.
ISLAND, POPULATION, CHILDREN, PATIENCE = 4096, 12, 300, 25
#: Tokens that a final bin may lack before the last epoch; epochs; elites that migrate, and pieces that one has at most.
SLACK, EPOCHS, ELITES, ELITE_PIECES = 4, 4, 512, 8

Bins = list[list[int]]


def best_fit(lengths, order, capacity: int, bins: Bins) -> Bins:
    """Puts the items of `order` into bins one by one, each where the least room stays."""
    bins = [list(b) for b in bins]
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            left, k = capacity - lengths[i], len(bins) - 1
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            left -= lengths[i]
        if left:
            bisect.insort(room, (left, k))
    return bins


def fitness(bins: Bins, lengths, capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones; larger is better."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def _exchange(bins: Bins, displaced: list[int], lengths, capacity: int) -> list[int]:
    """Puts into each bin the displaced item that fills it best in place of a shorter one; returns what is displaced then, longest first."""
    free = sorted((lengths[i], i) for i in displaced)
    for b in bins:
        room = capacity - sum(lengths[i] for i in b)
        if not room or not free:
            continue
        best = None
        for at, i in enumerate(b):
            k = bisect.bisect_left(free, (lengths[i] + room + 1, -1)) - 1
            if k >= 0 and free[k][0] > lengths[i] and (best is None or free[k][0] - lengths[i] > best[0]):
                best = free[k][0] - lengths[i], at, k
        if best:
            _, at, k = best
            _, new = free.pop(k)
            bisect.insort(free, (lengths[b[at]], b[at]))
            b[at] = new
    return [i for _, i in reversed(free)]


def cross(a: Bins, b: Bins, lengths, capacity: int, rng: np.random.Generator) -> Bins:
    """A child of a with some of the better half of b's bins put in whole."""
    ranked = sorted(b, key=lambda x: -sum(lengths[i] for i in x))
    half = ranked[: max(1, len(ranked) // 2)]
    injected = [list(half[i]) for i in np.flatnonzero(rng.random(len(half)) < 0.5)] or [list(half[0])]
    inside = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    # Mutation: the emptiest bins are dissolved.
    kept.sort(key=lambda x: -sum(lengths[i] for i in x))
    for _ in range(min(len(kept), int(rng.integers(1, 4)))):
        displaced += kept.pop()
    bins = injected + kept
    return best_fit(lengths, _exchange(bins, displaced, lengths, capacity), capacity, bins)


@dataclass
class Evolved:
    """Bins (lists of places), the least number that there can be, that of best-fit decreasing, and the crossovers made."""

    bins: Bins
    least: int
    best_fit: int
    crossovers: int


def evolve(lengths: np.ndarray, capacity: int = CAPACITY, elites: tuple[tuple[int, ...], ...] = (), seed: int = 0, population: int = POPULATION, children: int = CHILDREN) -> Evolved:
    """Bins over lengths of 1 to capacity, never more than best-fit decreasing makes.

    Stops at the least number that can be, which best-fit often meets, when the best solution has
    stayed for PATIENCE children, or after `children` of them.
    """
    sizes = [int(x) for x in lengths]
    least = -(-sum(sizes) // capacity)
    rng = np.random.default_rng(seed)
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [best_fit(sizes, falling, capacity, [])]
    plain = len(people[0])
    if plain > least and elites:
        at_hand: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(sizes):
            at_hand[x].append(i)
        settled: Bins = []
        for pattern in elites:
            need = Counter(pattern)
            while all(len(at_hand[x]) >= c for x, c in need.items()):
                settled.append([at_hand[x].pop() for x in pattern])
        people.append(best_fit(sizes, sorted((i for xs in at_hand.values() for i in xs), key=lambda i: -sizes[i]), capacity, settled))
    while len(people) < population and min(len(p) for p in people) > least:
        shaken = np.asarray(sizes) * rng.uniform(0.5, 1.5, len(sizes))
        people.append(best_fit(sizes, np.argsort(-shaken).tolist(), capacity, []))
    ranked = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(people)), reverse=True)
    made = stayed = 0
    while made < children and stayed < PATIENCE and len(ranked[0][2]) > least and len(ranked) > 1:
        a, b = rng.choice(len(ranked), 2, replace=False)
        new = cross(ranked[a][2], ranked[b][2], sizes, capacity, rng)
        made += 1
        stayed += 1
        worth = fitness(new, sizes, capacity)
        if all(worth != r[0] for r in ranked):
            stayed = 0 if worth > ranked[0][0] else stayed
            ranked.append((worth, len(people) + made, new))
            ranked.sort(reverse=True)
            del ranked[population:]
    return Evolved(ranked[0][2], least, plain, made)


def _islands(batches: Iterator[pa.RecordBatch], epoch: int, last: bool, elites, capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = (epoch << 56) | (TaskContext.get().partitionId() << 32)
    waiting: list[pa.RecordBatch] = []
    n = 0

    def settle(rows: pa.Table, number: int) -> pa.Table:
        lengths = rows.column("_length").to_numpy()
        sequence, offset, final = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        for k, items in enumerate(evolve(lengths, capacity, elites, number).bins):
            sequence[items] = first + number + k
            ends = np.cumsum(lengths[items])
            offset[items] = ends - lengths[items]
            final[items] = last or capacity - ends[-1] <= SLACK
        return rows.append_column("_sequence", pa.array(sequence)).append_column("_offset", pa.array(offset)).append_column("_final", pa.array(final))

    number = 0
    for batch in batches:
        waiting.append(batch)
        n += len(batch)
        while n >= ISLAND:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            yield from settle(rows.slice(0, ISLAND), number).combine_chunks().to_batches()
            number += ISLAND
            waiting, n = rows.slice(ISLAND).to_batches(), n - ISLAND
    if n:
        yield from settle(pa.Table.from_batches(waiting).combine_chunks(), number).combine_chunks().to_batches()


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; every length is 1 to capacity.

    Offsets of a sequence have no gaps. Pieces may repeat; an empty table stays empty. Columns of
    pieces that are called sequence_id or offset give way to the new ones. Islands hold 4096 pieces
    at most, so that memory doesn't grow; what an epoch leaves is stored.
    """
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    left = pieces.select(F.struct(*kept).alias("_row"), F.col(length).cast("long").alias("_length"))
    names, elites, done, last = left.columns, (), None, False
    schema = left.select(*names).schema.add("_sequence", "long").add("_offset", "long").add("_final", "boolean")
    for epoch in range(EPOCHS):
        last = last or epoch == EPOCHS - 1
        placed = stored(left.mapInArrow(lambda it, e=epoch, z=last, s=elites: _islands(it, e, z, s, capacity), schema), f"epoch{epoch}", keep=True)
        final = placed.filter("_final")
        done = final if done is None else done.unionByName(final)
        left = placed.filter("NOT _final").select(*names)
        n = 0 if last else left.count()
        if not n:
            break
        # What fits on one island ends there.
        last = n <= ISLAND
        left = left.repartition(-(-n // ISLAND))
        found = final.filter(F.col("_length") < capacity).groupBy("_sequence").agg(F.sort_array(F.collect_list("_length"), asc=False).alias("p"))
        top = found.filter(F.size("p") <= ELITE_PIECES).groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(ELITES).collect()
        elites = tuple(tuple(r["p"]) for r in top if r["n"] > 1)
    return done.select("_row.*", F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from cairn.llm.tokens import word_tokenizer

    tokenizer = word_tokenizer(path)
    for batch in batches:
        rows, out = [], []
        for k, ids in enumerate(tokenizer.encode(batch.column("_text"))):
            ids = np.append(ids, np.uint32(0)).astype("<u4")
            for start in range(0, len(ids), capacity):
                part = ids[start : start + capacity].tobytes()
                rows.append(k)
                out.append((start // capacity, start, len(part) // 4, zlib.crc32(part), part if with_ids else None))
        if not out:
            continue
        piece, start, length, crc, ids = zip(*out, strict=True)
        keep = batch.drop_columns(["_text"]).take(pa.array(rows))
        more = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["piece", "start", "length", "ids_crc32"]
        if with_ids:
            more.append(pa.array(ids, pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays([*keep.columns, *more], [*keep.schema.names, *names])


def cut(documents: DataFrame, path: str, *keep: str, capacity: int = CAPACITY, with_ids: bool = False, text: str = "text") -> DataFrame:
    """Pieces of the token ids of each text and a final id 0: keep, piece, start, length, ids_crc32 and ids if asked for.

    A null text is empty: one piece of one id. path: the vocabulary file, on every executor.
    """
    rows = documents.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", "binary")
    return rows.mapInArrow(lambda it: _cut(it, path, capacity, with_ids), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids (little-endian uint32) of packed pieces that carry their ids."""
    one = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return one.select("sequence_id", F.expr("aggregate(parts, cast('' AS binary), (a, p) -> concat(a, p.ids))").alias("ids"))


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The packed pieces of all rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null doc_ids and repeated rows have pieces like all others, and a null or empty text one of a
    single id; an empty table has none. Columns beyond doc_id and text are not read.
    """
    with scratch(documents.sparkSession):
        pieces = stored(cut(documents, path or vocabulary(), "doc_id"), "pieces")
        return pack(pieces).withColumn("length", F.col("length").cast("long"))
