"""Personal data by bootstrapped contextual extraction.

Base patterns give the seed entities. The words around an entity are its lexical patterns: one to
three before it, one or two after it, and one on each side. The pattern-instance graph links each
pattern with each distinct value that stands in it, seeds and unknown identifier-like tokens
alike. Rounds go over the whole graph: a pattern is worth the share of known values among its
own, held down while they are few; an unknown value in a pattern of high worth and enough known
values becomes known itself and takes part in the next round. Tokens of known values that stand
in a pattern of high worth become spans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import spans
from cairn.llm.common import scratch, stored

KINDS = ("email", "ip", "card", "phone")
#: The added kind comes after the base kinds.
FOUND = "found"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these starts at the first digit of a run: from a later digit it would fail as well.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._/-]*[A-Za-z0-9])?")
_WORDS = re.compile(r"[^\W\d_]+")
# Its last alternative holds for each token that is identifier_like: of six characters or more a third are two digits at least.
_HINT = r"@[A-Za-z0-9]|@-|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){11}|\+[0-9][ ().0-9-]+[0-9]|[0-9][A-Za-z0-9._/-]*[0-9]"

#: Characters around an entity that its patterns are read from, and words before and after it that they have at most.
CONTEXT, BEFORE, AFTER = 96, 3, 2
#: Rounds of scoring at most, what a pattern is held down by, and the worth and the known values that a good one has at least.
ROUNDS, DAMPING, GOOD, SEEDS = 8, 0.5, 0.8, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, from each @ outwards, so that long runs cost no more than their length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def find_base(text: str) -> list[spans.Span]:
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _sign(x: str) -> str:
    return x if x and not x.isalnum() else ""


def patterns_around(text: str, start: int, end: int) -> list[str]:
    """Patterns of a place: words of its line in lower case, with the sign next to it; none without a word.

    A word that CONTEXT cuts is not a part of any.
    """
    low, high = max(0, start - CONTEXT), end + CONTEXT
    left, right = text[low:start], text[end:high]
    if low and text[low - 1].isalpha():
        left = left.lstrip(_letters_of(left))
    if high < len(text) and text[high].isalpha():
        right = right.rstrip(_letters_of(right))
    left, right = left.rpartition("\n")[2].rstrip(), right.partition("\n")[0].lstrip()
    before, after = ([w.lower() for w in _WORDS.findall(x)] for x in (left, right))
    before_sign, after_sign = _sign(left[-1:]), _sign(right[:1])
    out = [f"{' '.join(before[-k:])}{before_sign} _" for k in range(1, min(BEFORE, len(before)) + 1)]
    out += [f"_ {after_sign}{' '.join(after[:k])}" for k in range(1, min(AFTER, len(after)) + 1)]
    if before and after:
        out.append(f"{before[-1]}{before_sign} _ {after_sign}{after[0]}")
    return out


def _letters_of(x: str) -> str:
    return "".join({c for c in x if c.isalpha()})


def identifier_like(token: str) -> bool:
    """Six characters or more, a third of them digits."""
    return len(token) >= 6 and 3 * sum(c.isdigit() for c in token) >= len(token)


def find_personal(text: str) -> tuple[list[spans.Span], list[dict]]:
    base = find_base(text)
    taken = sorted((a, b) for _, a, b in base)
    out = []

    def add(a: int, b: int, seed: bool) -> None:
        if found := patterns_around(text, a, b):
            out.append({"start": a, "end": b, "value": spans.hash64(text[a:b].lower()), "patterns": [spans.hash64(p) for p in found], "base": seed})

    for a, b in taken:
        add(a, b, True)
    i = 0
    for m in _TOKEN.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if identifier_like(m[0]) and not (i < len(taken) and taken[i][0] < m.end()):
            add(m.start(), m.end(), False)
    return base, out


def good_patterns(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Stored: the patterns of high worth, from rows of pattern, value and base (is the value a seed there).

    Each round counts the known values of each pattern anew; it ends early when none is learned.
    """
    with scratch(occurrences.sparkSession):
        graph = stored(occurrences.groupBy("pattern", "value").agg(F.max("base").alias("seed")), "graph")
        known = stored(graph.filter("seed").select("value").distinct(), "known")
        n = known.count()
        good = stored(known.select(F.col("value").alias("pattern")).limit(0), "good", keep=True)
        for _ in range(rounds if n else 0):
            marked = graph.join(known.withColumn("known", F.lit(1)), "value", "left")
            worth = marked.groupBy("pattern").agg(F.count("known").alias("known"), F.count("*").alias("n"))
            good = stored(worth.filter((F.col("known") >= SEEDS) & (F.col("known") / (F.col("n") + DAMPING) >= GOOD)).select("pattern"), "good", keep=True)
            known = stored(known.union(graph.join(good, "pattern").select("value")).distinct(), "known")
            was, n = n, known.count()
            if n == was:
                break
        return good


def scan(documents: DataFrame) -> DataFrame:
    """Stored: one row for each row of documents: doc_id, n_<kind>, base_sha256, spans, n_base, n_found.

    Null and empty texts have no spans. Patterns are scored over the whole corpus, each distinct
    value in a pattern once, so that copies of a document do not add to it. An unknown token is
    found where it stands in a pattern that is good in the last round.
    """
    with scratch(documents.sparkSession):
        found = spans.find(documents, KINDS, _HINT, find_personal, F.col("doc_id"))
        each = spans.candidates(found).select("row", "start", "end", "value", "base", F.explode("patterns").alias("pattern"))
        good = good_patterns(each.select("pattern", "value", "base"))
        added = each.filter("NOT base").join(good, "pattern", "left_semi").select("row", "start", "end").distinct()
        added = added.select("row", "start", F.lit(len(KINDS)).alias("rank"), F.lit(FOUND).alias("kind"), "end", F.lit(1).cast("long").alias("n_found"))
        n_base = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long"))
        out = spans.with_added(found, added, "n_found").select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", n_base.alias("n_base"), "n_found")
        return stored(out, "personal", keep=True)


def op10(documents: DataFrame) -> DataFrame:
    """scan() of all rows. Repeated rows each have a row; columns beyond doc_id and text are not read."""
    return scan(documents)
