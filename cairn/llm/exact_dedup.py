"""Exact duplicates by a log-structured merge index.

Ingest: each task fills memtables, one entry for each distinct text, and flushes them as runs
sorted by digest. An entry holds the digest, the identifier to keep and the rows that it stands
for, so that a group of copies costs one entry in a run however large it is.
Compaction: the entries of several runs, without their rows, come together by digest in digest
order, and one pass joins neighbours into a sorted run of the next level that holds the identifier to
keep of each digest. Each such run has a filter over its digests; a later batch is held against
the filters of the runs that are there, and only what hits one is looked up.
Verification: the texts of digests that several entries share are read again and compared byte
by byte; texts that differ under one digest are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import in_filter, membership_filter, scratch, stored

#: A memtable is flushed at so many rows, or so many bytes of its texts.
MEMTABLE_ROWS, MEMTABLE_BYTES = 65_536, 32 << 20
#: Runs of a level that are merged into one of the next; ranges of digests that are merged side by side, at least, and entries of one.
FANOUT, RANGES, RANGE_ENTRIES = 4, 64, 1 << 20

_PARTS = "array<struct<run: long, entry: long, best: long>>"
_ENTRY = "digest binary, run long, entry long, best long, n long, ids array<long>"
_RUN = f"digest binary, best long, n long, parts {_PARTS}"
_ARROW_ENTRY = pa.schema([("digest", pa.binary()), ("run", pa.int64()), ("entry", pa.int64()), ("best", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64()))])
_ARROW_RUN = pa.schema(
    [("digest", pa.binary()), ("best", pa.int64()), ("n", pa.int64()), ("parts", pa.list_(pa.struct([("run", pa.int64()), ("entry", pa.int64()), ("best", pa.int64())])))]
)

Digest = Callable[[bytes], bytes]


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


class Memtable:
    """Entries by digest; within it a hit counts only if the bytes agree."""

    def __init__(self) -> None:
        self.entries: dict[bytes, list[list]] = {}
        self.rows = self.bytes = 0

    def add(self, digest: bytes, text: bytes, doc_id: int | None) -> None:
        self.rows += 1
        for entry in self.entries.get(digest, ()):
            if entry[0] == text:
                entry[1].append(doc_id)
                return
        self.entries.setdefault(digest, []).append([text, [doc_id]])
        self.bytes += len(text)

    def full(self) -> bool:
        return self.rows >= MEMTABLE_ROWS or self.bytes >= MEMTABLE_BYTES

    def flush(self, run: int, largest: bool) -> pa.RecordBatch:
        pick = max if largest else min
        out: list[tuple] = []
        for digest in sorted(self.entries):
            for _, ids in self.entries[digest]:
                known = [i for i in ids if i is not None]
                out.append((digest, run, len(out), pick(known) if known else None, len(ids), ids))
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW_ENTRY, strict=True)], schema=_ARROW_ENTRY)


def flush_runs(batches: Iterator[pa.RecordBatch], batch_number: int, digest: Digest, largest: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    run = batch_number << 48 | TaskContext.get().partitionId() << 24
    table = Memtable()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            table.add(digest(text), text, doc_id)
            if table.full():
                yield table.flush(run, largest)
                run += 1
    if table.rows:
        yield table.flush(run, largest)


def merge_neighbours(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """One entry for each digest, from entries in digest order; a digest may go on in the next batch."""
    pick = max if largest else min
    held: list | None = None
    for batch in batches:
        out = []
        for digest, best, n, parts in zip(*(batch.column(c).to_pylist() for c in ("digest", "best", "n", "parts")), strict=True):
            if held and held[0] == digest:
                held[1] = pick((x for x in (held[1], best) if x is not None), default=None)
                held[2] += n
                held[3] += parts
                continue
            if held:
                out.append(held)
            held = [digest, best, n, parts]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW_RUN, strict=True)], schema=_ARROW_RUN)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(held, _ARROW_RUN, strict=True)], schema=_ARROW_RUN)


def prefix(digest: bytes) -> int:
    """The first 60 bits of a digest, as filters go by them; a shorter one is filled up with zeros."""
    return int.from_bytes(digest[:8].ljust(8, b"\0"), "big") >> 4


def _prefix(digits: int = 15) -> Column:
    """prefix(), or as many hex digits of it, in Spark's functions."""
    return F.conv(F.rpad(F.substring(F.hex("digest"), 1, digits), digits, "0"), 16, 10).cast("long")


def _may(bits: np.ndarray, digests: list[bytes]) -> np.ndarray:
    return in_filter(bits, np.array([prefix(d) for d in digests], np.int64)) if digests else np.zeros(0, bool)


def _texts_of(batches: Iterator[pa.RecordBatch], bits: np.ndarray, digest: Digest, once: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text) whose digests a filter lets through, with the digest; once: a text that a task has just sent is left out."""
    sent: dict[bytes, bytes] = {}
    size = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found = [digest(t) for t in texts]
        rows = []
        for i in np.flatnonzero(_may(bits, found)).tolist():
            if once and sent.get(found[i]) == texts[i]:
                continue
            rows.append(i)
            if once and found[i] not in sent:
                sent[found[i]] = texts[i]
                size += len(texts[i])
        if size > MEMTABLE_BYTES:
            sent, size = {}, 0
        if rows:
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).take(at), batch.column("doc_id").take(at), batch.column("text").take(at)], ["digest", "doc_id", "text"])


@dataclass
class Run:
    """A sorted run of one entry for each digest, and the filter over its digests."""

    entries: DataFrame
    bits: np.ndarray


class MergeIndex:
    """An index over batches of documents. keep: "smallest" or "largest" identifier of a group.

    digest may be any function of the bytes; a weak one costs work, not correctness. The tables of
    an index belong to the scratch() that is open when they are made.
    """

    def __init__(self, spark: SparkSession, keep: str = "largest", digest: Digest = sha256) -> None:
        self.spark, self.largest, self.digest = spark, keep == "largest", digest
        self.levels: list[list[Run]] = [[]]
        self.batches: list[DataFrame] = []
        self.entries: list[DataFrame] = []
        self.collided: DataFrame | None = None

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def _merged(self, entries: DataFrame) -> Run:
        """A run of entries (digest, best, n, parts); a range of digests is one task, its entries in order."""
        ranges = min(1 << 16, max(RANGES, entries.count() // RANGE_ENTRIES))
        by_range = F.floor(_prefix(4) * ranges / (1 << 16))
        ordered = entries.select("digest", "best", "n", "parts").repartition(ranges, by_range).sortWithinPartitions("digest")
        run = stored(ordered.mapInArrow(lambda it, z=self.largest: merge_neighbours(it, z), _RUN), "run", keep=True)
        return Run(run, membership_filter(run.select(_prefix().alias("h")), "h"))

    def probe(self, run: Run, digests: DataFrame) -> DataFrame:
        """Those of digests (digest) that are in run; only what its filter lets through is looked up."""
        bits = self.spark.sparkContext.broadcast(run.bits)

        def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_may(bits.value, batch.column("digest").to_pylist())))

        hits = stored(digests.select("digest").mapInArrow(may, "digest binary"), "hits")
        return run.entries.join(hits, "digest", "left_semi").select("digest")

    def ingest(self, documents: DataFrame) -> None:
        """Adds a batch of doc_id and text: null texts count as empty; other columns are not read."""
        docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        number, digest, largest = len(self.batches), self.digest, self.largest
        with scratch(self.spark):
            entries = stored(docs.mapInArrow(lambda it: flush_runs(it, number, digest, largest), _ENTRY), "entries", keep=True)
            new = self._merged(entries.withColumn("parts", F.array(F.struct("run", "entry", "best")).cast(_PARTS)))
            shared = new.entries.filter(F.size("parts") > 1).select("digest")
            for run in self.runs():
                shared = shared.unionByName(self.probe(run, new.entries))
            self.batches.append(docs)
            self.entries.append(entries)
            self._verify(stored(shared.distinct(), "shared"))
            self.levels[0].append(new)
            self._compact()

    def _texts(self, digests: DataFrame, once: bool) -> DataFrame:
        """digest, doc_id and text of the rows of all batches whose digests are in a table, and perhaps of a few more."""
        bits, digest = self.spark.sparkContext.broadcast(membership_filter(digests.select(_prefix().alias("h")), "h")), self.digest
        found = None
        for docs in self.batches:
            part = docs.mapInArrow(lambda it: _texts_of(it, bits.value, digest, once), "digest binary, doc_id long, text string")
            found = part if found is None else found.unionByName(part)
        return found

    def _verify(self, shared: DataFrame) -> None:
        """Reads the texts of digests that several entries share; those under which texts differ are remembered."""
        if not shared.limit(1).count():
            return
        found = self._texts(shared, once=True)
        # Least and greatest text, by their bytes; each task sends one pair for a digest, however many rows have it.
        texts = found.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
        differ = stored(texts.filter("a != b").select("digest"), "differ", keep=True)
        if differ.limit(1).count():
            self.collided = stored(differ if self.collided is None else self.collided.union(differ).distinct(), "collided", keep=True)

    def _compact(self) -> None:
        """Merges the runs of a full level into one of the next."""
        for k, level in enumerate(self.levels):
            if len(level) >= FANOUT:
                entries = level[0].entries
                for run in level[1:]:
                    entries = entries.unionByName(run.entries)
                merged = self._merged(entries)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)
                self.levels[k] = []

    def groups(self) -> DataFrame:
        """One row for each row of all batches: doc_id, keep_id, group_size, kept, digest."""
        runs = self.runs()
        entries = self.entries[0]
        for more in self.entries[1:]:
            entries = entries.unionByName(more)
        merged = runs[0].entries
        if len(runs) > 1:
            for run in runs[1:]:
                merged = merged.unionByName(run.entries)
            merged = self._merged(merged).entries
        def rank(p: Column) -> Column:
            best = p["best"] if self.largest else -p["best"]
            return F.named_struct(F.lit("known"), p["best"].isNotNull(), F.lit("best"), best, F.lit("run"), -p["run"], F.lit("entry"), -p["entry"])

        several = merged.filter(F.size("parts") > 1)
        parts = several.select(F.col("best").alias("keep_id"), F.col("n").alias("group_size"), F.array_max(F.transform("parts", rank)).alias("top"), F.explode("parts").alias("p"))
        won = (F.col("p.run") == -F.col("top.run")) & (F.col("p.entry") == -F.col("top.entry"))
        parts = parts.select("p.run", "p.entry", "keep_id", "group_size", won.alias("winner"))
        joined = entries.join(parts, ["run", "entry"], "left")
        alone = F.col("winner").isNull()
        keep_id, size = F.when(alone, F.col("best")).otherwise(F.col("keep_id")), F.when(alone, F.col("n")).otherwise(F.col("group_size"))
        joined = joined.select("digest", "ids", keep_id.alias("keep_id"), size.alias("group_size"), (alone | F.col("winner")).alias("winner"))
        if self.collided is not None:
            joined = joined.join(self.collided, "digest", "left_anti")
        # The first row with the identifier to keep, in the entry that won, stays.
        first = F.coalesce(F.array_position("ids", F.col("keep_id")), F.lit(1)) - 1
        rows = joined.select("digest", "keep_id", "group_size", F.when(F.col("winner"), first).otherwise(-1).alias("stays"), F.posexplode("ids").alias("at", "doc_id"))
        out = rows.select("doc_id", "keep_id", "group_size", (F.col("at") == F.col("stays")).alias("kept"), "digest")
        return out if self.collided is None else out.unionByName(self._told_apart())

    def _told_apart(self) -> DataFrame:
        """The rows of digests under which texts differ, in groups by their bytes."""
        rows = self._texts(self.collided, once=False).join(self.collided, "digest", "left_semi")
        rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "apart")
        rank = F.struct(F.col("doc_id").isNotNull().alias("known"), (F.col("doc_id") if self.largest else -F.col("doc_id")).alias("id"), (-F.col("at")).alias("at"))
        groups = rows.groupBy("digest", "text").agg((F.max("doc_id") if self.largest else F.min("doc_id")).alias("keep_id"), F.count("*").alias("group_size"), F.max(rank).alias("top"))
        return rows.join(groups, ["digest", "text"]).select("doc_id", "keep_id", "group_size", (-F.col("at") == F.col("top.at")).alias("kept"), "digest")


def exact_groups(documents: DataFrame, keep: str = "largest", digest: Digest = sha256) -> DataFrame:
    """Stored: one row for each row of documents: doc_id, keep_id, group_size, kept, digest.

    Null texts count as empty, and a null doc_id as the last to be kept. Of rows that share text
    and doc_id one is kept. Texts are read whole; an empty table has no groups. Columns beyond
    doc_id and text are not read.
    """
    with scratch(documents.sparkSession):
        index = MergeIndex(documents.sparkSession, keep, digest)
        index.ingest(documents)
        return stored(index.groups(), "groups", keep=True)


def exact_dedup(documents: DataFrame, keep: str = "largest") -> DataFrame:
    """documents without the rows that exact_groups() drops; columns as they came.

    Rows are taken out by doc_id. Where a doc_id stands on several rows, those rows (whole) are
    held against each other, so that each distinct text of it that stays does so once; a null text
    is the empty one here too.
    """
    text = F.coalesce("text", F.lit(""))
    with scratch(documents.sparkSession):
        groups = exact_groups(documents, keep)
        ids = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("any"), F.min("kept").alias("all"))
        ids = stored(ids.filter("NOT all"), "ids")
        # Their sizes are known once they are stored, and Spark broadcasts them only below its threshold.
        mixed = stored(ids.filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id")), "mixed", keep=True)
        gone = stored(ids.filter("NOT any").select(F.col("doc_id").alias("_id")).union(mixed).distinct(), "gone", keep=True)
        kept = groups.filter("kept").select(F.col("doc_id").alias("_kept"), F.col("digest").alias("_digest"))
        kept = stored(kept.join(mixed, kept["_kept"].eqNullSafe(mixed["_id"]), "left_semi"), "kept", keep=True)
    plain = documents.join(gone, documents["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
    rest = documents.join(mixed, documents["doc_id"].eqNullSafe(mixed["_id"]), "left_semi")
    rest = rest.select(F.struct(*rest.columns).alias("_row"), "doc_id", text.alias("_text")).groupBy("doc_id", "_text").agg(F.first("_row").alias("_row"))
    same = rest["doc_id"].eqNullSafe(kept["_kept"]) & (F.unhex(F.sha2("_text", 256)) == kept["_digest"])
    return plain.unionByName(rest.join(kept, same, "left_semi").select("_row.*"))


def op4(documents: DataFrame) -> DataFrame:
    """exact_groups() of all rows, the largest doc_id of a group kept, with the digest as text."""
    out = exact_groups(documents, "largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
