"""Spans of several kinds in texts: finding them in batches, joining what is learned later, and writing them out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from cairn.llm.common import stored

#: (kind, start, end): code points, end exclusive.
Span = tuple[str, int, int]

_SPAN = "struct<start: int, rank: int, kind: string, end: int>"
_ARROW_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
#: A candidate: its place, the hash of its value, those of its patterns, and whether it is a base span.
_CANDIDATE = "struct<start: int, end: int, value: long, patterns: array<long>, base: boolean>"
_ARROW_CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64())), ("base", pa.bool_())])


def hash64(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


def digest(spans: list[Span], kinds: tuple[str, ...]) -> tuple[list[dict], str]:
    ordered = sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)
    return [{"start": a, "rank": kinds.index(k), "kind": k, "end": b} for k, a, b in ordered], hashlib.sha256(text.encode()).hexdigest()


def find(rows: DataFrame, kinds: tuple[str, ...], hint: str, finder: Callable[[str], tuple[list[Span], list[dict]]], *keep: str | Column, text: str = "text") -> DataFrame:
    """Stored: the columns `keep`, row (a number of its own), n_<kind> for each kind, base_sha256, base and candidates.

    hint: a pattern for RE2 that every text with a span or candidate matches; only those are
    given to finder, whole. Null texts count as empty.
    """
    rows = rows.select(*keep, F.monotonically_increasing_id().alias("row"), F.col(text).alias("_text"))
    schema = rows.drop("_text").schema
    names = list(schema.names)
    for k in kinds:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("base", DataType.fromDDL(f"array<{_SPAN}>")).add("candidates", DataType.fromDDL(f"array<{_CANDIDATE}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = ([], digest([], kinds)[1], [0] * len(kinds), [])
        for batch in batches:
            column = batch.column("_text")
            out = [nothing] * len(batch)
            hit = pc.fill_null(pc.match_substring_regex(column, hint), False)
            for i in pc.indices_nonzero(hit).to_pylist():
                base, candidates = finder(column[i].as_py())
                out[i] = (*digest(base, kinds), [sum(s[0] == k for s in base) for k in kinds], candidates)
            counts = [pa.array([r[2][j] for r in out], pa.int64()) for j in range(len(kinds))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *counts, pa.array([r[1] for r in out]), pa.array([r[0] for r in out], pa.list_(_ARROW_SPAN)), pa.array([r[3] for r in out], pa.list_(_ARROW_CANDIDATE))],
                [*names, *(f"n_{k}" for k in kinds), "base_sha256", "base", "candidates"],
            )

    return stored(rows.mapInArrow(run, schema), "spans")


def candidates(found: DataFrame, *keep: str) -> DataFrame:
    """One row for each candidate: row, columns `keep`, start, end, value, patterns, base."""
    return found.select("row", *keep, F.inline("candidates"))


def with_added(found: DataFrame, added: DataFrame, *sums: str) -> DataFrame:
    """found with the spans of added (row, start, rank, kind, end, sums) put in: spans as a string; sums summed."""
    more = added.groupBy("row").agg(
        F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "rank", "kind", "end"))).alias("more"), *[F.sum(c).cast("long").alias(c) for c in sums]
    )
    joined = found.join(more, "row", "left")
    ordered = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))))
    text = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return joined.withColumn("spans", text).withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in sums})
