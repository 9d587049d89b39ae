"""Benchmark decontamination in DataFrame functions only.

The windows of the benchmark items form a hash set that is broadcast in blocks of bounded bytes,
one pass over the documents for each. Each document is cut into words once; every window of it is
hashed, the hashes are exploded and looked up, and a hit is verified word by word against the
window itself before it counts. No text leaves its task: what is stored is one short row for each
document and one for each verified hit, its place and the number of its window. Covered words are
counted along the hits of a document in order of their places, and the items of a window come in by a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from cairn.llm.common import scratch, stored

WINDOW = 10
#: Bytes of windows that are broadcast at once (one window at least); a larger set takes more passes.
BROADCAST_BYTES = 32 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything but 0-9, a-z and what lies beyond ASCII.
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Words of a text with A-Z in lower case; none for a null."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(low, _NOT_WORD), "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def windows_of(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct windows with the items that hold them: (n, gram, items, key, bytes)."""
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(text).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(window)))
    w = w.select("item", "n", "w", F.explode(F.expr("sequence(1, size(w) - n + 1)")).alias("at"))
    w = w.select("item", "n", F.expr("slice(w, at, n)").alias("gram"))
    w = w.groupBy("n", "gram").agg(F.collect_set("item").alias("items"))
    key = F.lit(None).cast("long")
    for n in range(1, window + 1):
        key = F.when(F.col("n") == n, F.xxhash64(F.lit(n), *[F.get("gram", F.lit(k)) for k in range(n)])).otherwise(key)
    # As an array of strings in memory: its bytes and some 24 for each word.
    return w.withColumn("key", key).withColumn("bytes", F.octet_length(F.array_join("gram", " ")) + 24 * F.col("n") + 64)


def _key(n: int) -> Column:
    """Hash of the n words of _w from place `at` on; null where they are not all there."""
    here = F.xxhash64(F.lit(n), *[F.get("_w", F.col("at") + k) for k in range(n)])
    return F.when((F.col("at") >= 0) & (F.col("at") + n <= F.size("_w")), here)


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored hits, and the stored windows that they name.

    Hits: for each row of documents one with _row (a number of its own), _doc (all columns but the
    text), n_words and at = -1, and one for each verified window with _row, at (0-based place of its
    first word), n and window. Documents and items without words have none.
    """
    grams = stored(windows_of(benchmark, item, item_text, window).withColumn("window", F.monotonically_increasing_id()), "windows")
    sizes = {r["n"]: r["b"] for r in grams.groupBy("n").agg(F.sum("bytes").alias("b")).collect()}
    blocks = max(1, math.ceil(sum(sizes.values()) / BROADCAST_BYTES))
    keep = [c for c in documents.columns if c != text]
    # Names of our own, so that no column of the input clashes. Place -1 stands for the row itself.
    docs = documents.select(F.struct(*keep).alias("_doc"), F.monotonically_increasing_id().alias("_row"), words(text).alias("_w"))
    if blocks > 1:
        # Several passes: the numbers of the rows must be the same in all of them.
        docs = stored(docs, "words")
    docs = docs.withColumn("_places", F.expr(f"sequence(-1, greatest(-1, size(_w) - {min(sizes, default=window)}))"))
    # All below runs in one generated loop over places: the words of a row are referred to, not copied.
    seen = docs.select("_doc", "_row", "_w", F.explode("_places").alias("at"))
    if len(sizes) == 1:
        seen = seen.withColumn("key", _key(*sizes))
    else:
        seen = seen.withColumn("key", F.explode(F.array(F.when(F.col("at") < 0, 0).cast("long"), *[_key(n) for n in sorted(sizes)])))
        seen = seen.filter(F.col("key").isNotNull())
    verified = F.col("gram").isNotNull() & (F.col("at") >= 0) & (F.expr("slice(_w, at + 1, n)") == F.col("gram"))
    looked_up = grams.select("key", "n", "gram", "window")
    found = None
    for b in range(blocks):
        block = F.broadcast(looked_up.filter(F.pmod("key", F.lit(blocks)) == b) if blocks > 1 else looked_up)
        part = seen.join(block, "key", "left").filter(((F.col("at") < 0) & F.lit(b == 0)) | verified)
        found = part if found is None else found.unionByName(part)
    own = F.col("at") < 0
    found = found.select("_row", F.when(own, F.col("_doc")).alias("_doc"), F.when(own, F.size("_w")).cast("long").alias("n_words"), "at", F.when(~own, F.col("n")).alias("n"), F.when(~own, F.col("window")).alias("window"))
    return stored(found, "hits"), grams


def _along() -> WindowSpec:
    return Window.partitionBy("_row").orderBy("at", "n", "window")


def _reach() -> Column:
    """Place behind the last word that earlier hits of the row cover."""
    return F.coalesce(F.max(F.col("at") + F.col("n")).over(_along().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def covered(found: DataFrame) -> DataFrame:
    """_row, _doc, n_words and n_hit, the number of words inside any hit, for each row of the documents."""
    fresh = F.greatest(F.col("at") + F.col("n") - F.greatest("at", "_reach"), F.lit(0))
    each = found.withColumn("_reach", _reach()).withColumn("_fresh", F.when(F.col("at") >= 0, fresh).otherwise(0))
    return each.groupBy("_row").agg(F.first("_doc", ignorenulls=True).alias("_doc"), F.max("n_words").alias("n_words"), F.sum("_fresh").cast("long").alias("n_hit"))


def items_of(found: DataFrame, windows: DataFrame) -> DataFrame:
    """_row and its items, sorted as strings; rows without any are left out. An item with a null id adds none."""
    named = windows.select("window", F.explode("items").alias("item"))
    held = found.filter("at >= 0").select("_row", "window").distinct().join(named, "window")
    return held.groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("items"))


def runs_of(found: DataFrame) -> DataFrame:
    """_doc and the runs of hit words (a to b - 1, in order) of each row that has some."""
    hit = found.filter("at >= 0").withColumn("_reach", _reach()).withColumn("_new", (F.col("at") > F.col("_reach")).cast("int"))
    hit = hit.withColumn("_run", F.sum("_new").over(_along().rowsBetween(Window.unboundedPreceding, 0)))
    runs = hit.groupBy("_row", "_run").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("n")).alias("b"))
    runs = runs.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))
    return found.filter("at < 0").select("_row", "_doc").join(runs, "_row").select("_doc", "runs")


def _identified(documents: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows that agree in the first and the last share their fate."""
    return documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"), "text")


def decontaminate(documents: DataFrame, benchmark: DataFrame, mode: str = "document", window: int = WINDOW) -> DataFrame:
    """documents without contaminated rows (mode "document"), or with the hit words taken out (mode "span").

    In mode "span" each run of hit words goes with the characters between them and becomes one
    space. A text without a hit is left alone, nulls included. Repeated rows are
    treated alike; a null doc_id is one like others. Columns as they came.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    with scratch(documents.sparkSession):
        found, _ = hits(_identified(documents), benchmark, window)
        if mode == "span":
            cuts = runs_of(found).groupBy(F.col("_doc.doc_id").alias("_bad"), F.col("_doc._key").alias("_hash")).agg(F.first("runs").alias("_runs"))
            cuts = stored(cuts, "cuts", keep=True)
        else:
            bad = found.groupBy("_row").agg(F.first("_doc", ignorenulls=True).alias("_doc"), F.max("at").alias("at")).filter("at >= 0")
            # Its size is known once it is stored, and Spark broadcasts it only below its threshold.
            bad = stored(bad.select(F.col("_doc.doc_id").alias("_bad"), F.col("_doc._key").alias("_hash")).distinct(), "bad", keep=True)
    if mode != "span":
        return documents.join(bad, documents["doc_id"].eqNullSafe(bad["_bad"]) & (key == bad["_hash"]), "left_anti")
    joined = documents.join(cuts, documents["doc_id"].eqNullSafe(cuts["_bad"]) & (key == cuts["_hash"]), "left")
    # A part is what lies before a word, and the word; the last one is what follows the last word.
    parts = F.regexp_extract_all("text", F.lit(r"([^0-9A-Za-z\x{80}-\x{10FFFF}]*)([0-9A-Za-z\x{80}-\x{10FFFF}]+|$)"), F.lit(0))
    runs = F.col("_runs")

    def between(p: Column, i: Column) -> Column:
        """What stays before run i, behind the run before it."""
        start = F.coalesce(F.get(runs["b"], i - 1), F.lit(0))
        stop = F.coalesce(F.get(runs["a"], i), F.size(p))
        before = F.regexp_replace(F.coalesce(F.get(p, stop), F.lit("")), r"[0-9A-Za-z\x{80}-\x{10FFFF}]+$", "")
        return F.concat(F.array_join(F.slice(p, start + 1, F.greatest(stop - start, F.lit(0))), ""), before)

    kept = _let(parts, lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: between(p, i)), " "))
    text = F.when(runs.isNull(), F.col("text")).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else documents[c] for c in documents.columns])


def op3(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts, and those without words, have no hits; items that share a window all
    count; repeated rows each have a row; an empty benchmark hits nothing. Texts are read whole.
    Columns beyond doc_id and text, and item_id and text, are not read.
    """
    with scratch(documents.sparkSession):
        found, windows = hits(documents.select("doc_id", "text"), benchmark.select("item_id", "text"))
        out = covered(found).join(items_of(found, windows), "_row", "left").select(
            F.col("_doc.doc_id").alias("doc_id"),
            "n_words",
            "n_hit",
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
        return stored(out, "contamination", keep=True)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
ns AS (SELECT DISTINCT n FROM b),
dg AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns)),
h AS (SELECT doc_id, s, dg.n, item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.gram = bg.gram),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
