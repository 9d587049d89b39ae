"""Secret scans with corpus-wide ownership frequency.

Three patterns give the base spans; further candidates are long tokens of mixed characters and
high entropy. The value of each, as a hash, is counted over the distinct repositories and owners
that hold it anywhere in the corpus: a value of many owners is an example that everyone copies,
one of few is a live-looking credential of its owner. Candidates of few owners become spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import spans
from cairn.llm.common import scratch, stored

KINDS = ("assign", "access", "hex")
#: The added kind comes after the base kinds.
OWNED = "owned"

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_-]{20}"""

#: Bits for each character that a candidate has at least, and owners or repositories that a live value has at most.
ENTROPY, MAX_OWNERS, MAX_REPOSITORIES = 3.5, 2, 4


def _random(token: str) -> bool:
    if not (re.search("[0-9]", token) and re.search("[A-Z]", token) and re.search("[a-z]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= ENTROPY


def find_secrets(text: str) -> tuple[list[spans.Span], list[dict]]:
    """Base spans, and candidates with the hash of their values; those of base spans too."""
    base, out, taken = [], [], []

    def add(kind: str, start: int, end: int, value: str) -> None:
        base.append((kind, start, end))
        taken.append((start, end))
        out.append({"start": start, "end": end, "value": spans.hash64(value), "patterns": [], "base": True})

    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            add("assign", m.start(), m.end(), m[2])
    for m in _ACCESS.finditer(text):
        if len(m[0]) >= 20:
            add("access", m.start(), m.end(), m[0])
    for m in _HEX.finditer(text):
        add("hex", m.start(), m.end(), m[0])
    taken.sort()
    i, end = 0, 0
    for m in _TOKEN.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            end = max(end, taken[i][1])
            i += 1
        if end <= m.start() and _random(m[0]):
            out.append({"start": m.start(), "end": m.end(), "value": spans.hash64(m[0]), "patterns": [], "base": False})
    return base, out


def scan(documents: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Stored: one row for each row of documents: doc_id, n_<kind>, base_sha256, spans, n_live, n_example.

    n_live and n_example count base spans and candidates by the owners of their values. A value
    whose owner is null belongs to an owner of its own; null and empty texts have no spans.
    """
    with scratch(documents.sparkSession):
        found = spans.find(documents, KINDS, _HINT, find_secrets, F.col("doc_id"), owner.alias("owner"), repository.alias("repository"))
        each = spans.candidates(found, "owner", "repository")
        held = each.select("value", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("o"), F.coalesce(F.col("repository").cast("string"), F.lit("")).alias("r")).distinct()
        copied = held.groupBy("value").agg(F.count_distinct("o").alias("owners"), F.count("*").alias("repositories"))
        copied = copied.filter((F.col("owners") > MAX_OWNERS) | (F.col("repositories") > MAX_REPOSITORIES)).select("value", F.lit(1).alias("copied"))
        judged = each.join(copied, "value", "left")
        live = F.col("copied").isNull()
        added = judged.select(
            "row", "start", F.lit(len(KINDS)).alias("rank"), F.when(live & ~F.col("base"), OWNED).alias("kind"), "end", live.cast("long").alias("n_live"), (~live).cast("long").alias("n_example")
        )
        out = spans.with_added(found, added, "n_live", "n_example").select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_live", "n_example")
        return stored(out, "secrets", keep=True)


def op8(documents: DataFrame) -> DataFrame:
    """scan() of all rows; the owner is the source, a repository one language of it.

    Repeated rows each have a row; spans of a text that stands on several rows are on all of them.
    Columns beyond doc_id, text, source and lang are not read.
    """
    return scan(documents, F.col("source"), F.concat_ws("/", "source", "lang"))
