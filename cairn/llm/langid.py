"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit of the code a binary classifier over byte trigrams
tells the languages with a 1 from those with a 0; its weights are log odds from trigram counts
that are summed over all training rows. A text gets one margin for each bit, and the language
whose codeword loses least (logistic loss, bits weighted by how far apart the classifier holds
the two sides) is chosen. A small lead over the next codeword flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import kernel as K
from cairn.llm.common import id_crc, scratch, small_batches, stored

#: Buckets of trigrams, and the slices by which their counts are shuffled and summed.
BUCKETS, SLICES = 1 << 15, 16
#: Weight limit, smoothing in buckets, and steepness of the loss.
CLIP, SMOOTH, STEEP = 3.0, 0.02, 2.0
#: Lead in score below which a text is ambiguous.
AMBIGUOUS = 0.1

#: Letters of ASCII in lower case and all bytes beyond it; the rest is one separator.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that starts one byte before each byte, with separators around the text; -1: no letter in the middle."""
    b = _FOLD[data].astype(np.uint32)
    before, after = np.empty_like(b), np.empty_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[full] = 32
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    after[last] = 32
    h = (before * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64), b != 32


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        for a, b, data, offsets in K.text_pieces(batch.column("text")):
            gram, letter = trigrams(data, offsets)
            of = np.repeat(np.arange(b - a), np.diff(offsets))
            for lang in set(langs[a:b]):
                mine = (langs[a:b] == lang)[of] & letter
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(gram[mine], minlength=BUCKETS)
    step = BUCKETS // SLICES
    rows = [(lang, i, c[i * step : (i + 1) * step].tobytes()) for lang, c in sorted(counts.items()) for i in range(SLICES)]
    if rows:
        lang, at, part = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(at, pa.int32()), pa.array(part, pa.binary())], ["lang", "slice", "counts"])


def _sum_slices(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One slice for each partition and language: a few KB for each."""
    total = np.sum([np.frombuffer(x, np.int64) for x in frame["counts"]], axis=0)
    return frame.iloc[:1].assign(counts=[total.tobytes()])


def codewords(n: int) -> np.ndarray:
    """Codes of +1 and -1, a row for each of n classes: all splits up to five classes, seeded dense codes beyond."""
    if n <= 5:
        bits = [c for k in range(1, n) for c in combinations(range(n), k) if 0 in c]
        out = np.array([[1 if i in c else -1 for c in bits] for i in range(n)])
        return out.reshape(n, len(bits))
    best, far = None, -1
    rng = np.random.default_rng(7)
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1, 1], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        near = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2))
        if near > far:
            best, far = code, near
    return best


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # bits x buckets
    bias: np.ndarray
    scale: np.ndarray
    bit_weight: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gram, letter = trigrams(data, offsets)
        n = K.sums_by_text(letter, offsets)
        out = np.empty((len(offsets) - 1, len(self.bias)))
        for k, w in enumerate(self.weights):
            out[:, k] = K.sums_by_text(w[gram] * letter, offsets)
        return out / np.maximum(n, 1)[:, None], n

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score in 0 to 1 and the lead over the next."""
        f = (margins - self.bias) / self.scale
        loss = np.zeros((len(f), len(self.langs)))
        for i, word in enumerate(self.code):
            loss[:, i] = (self.bit_weight * np.logaddexp(0, -STEEP * word * f)).sum(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        lead = order[:, -1] - order[:, -2] if p.shape[1] > 1 else np.ones(len(p))
        return p.argmax(1), p.max(1), lead


def fit(training: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts over all rows of training with a non-null lang; texts may be null or empty."""
    rows = training.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = rows.mapInArrow(count_trigrams, "lang string, slice int, counts binary")
    with small_batches(training.sparkSession):
        # A row for each language and slice; a language that occurs has 256 KB of counts on the driver.
        total = parts.groupBy("lang", "slice").applyInPandas(_sum_slices, "lang string, slice int, counts binary").collect()
    langs = sorted({r["lang"] for r in total})
    counts = np.zeros((len(langs), BUCKETS))
    step = BUCKETS // SLICES
    for r in total:
        counts[langs.index(r["lang"]), r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["counts"], np.int64)
    return _model(langs, counts)


def _model(langs: list[str], counts: np.ndarray) -> LanguageModel:
    code = codewords(len(langs))
    p = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)
    bits = code.shape[1] if len(langs) > 1 else 0
    weights, bias, scale, bit_weight = np.zeros((bits, BUCKETS), np.float32), np.zeros(bits), np.ones(bits), np.ones(bits)
    for k in range(bits):
        one, zero = code[:, k] > 0, code[:, k] < 0
        w = np.clip(np.log(p[one].mean(0) / p[zero].mean(0)), -CLIP, CLIP)
        weights[k] = w
        # Expected margin of each language; the threshold is half way between the nearest of the two sides.
        mean = p @ w
        high, low = mean[one].min(), mean[zero].max()
        bias[k], scale[k] = (high + low) / 2, max((high - low) / 2, 1e-3)
        bit_weight[k] = scale[k]
    bit_weight = bit_weight / max(bit_weight.mean(), 1e-9) if bits else bit_weight
    return LanguageModel(langs, code if bits else np.zeros((len(langs), 0)), weights, bias, scale, bit_weight)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: is one of its characters a letter of Unicode?"""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    out = K.sums_by_text(ascii_letter[data], offsets) > 0
    for i in np.flatnonzero(~out & (K.sums_by_text(data >= 128, offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def identify_batches(batches: Iterator[pa.RecordBatch], model: LanguageModel, column: int) -> Iterator[pa.RecordBatch]:
    """Adds lang_pred, score, ambiguous and has_letter to batches; column: the place of the text, which goes."""
    for batch in batches:
        pred: list[str] = []
        score, ambiguous, has_letter = np.zeros(len(batch)), np.ones(len(batch), bool), np.zeros(len(batch), bool)
        for a, b, data, offsets in K.text_pieces(batch.column(column)):
            margins, _ = model.margins(data, offsets)
            letter = has_letter[a:b] = _has_letter(data, offsets)
            if not model.langs:
                pred += ["und"] * (b - a)
                continue
            which, p, lead = model.decode(margins)
            pred += [model.langs[i] if ok else "und" for i, ok in zip(which, letter, strict=True)]
            score[a:b] = np.where(letter, p, 0.0)
            ambiguous[a:b] = ~letter | (lead < AMBIGUOUS)
        kept = [c for i, c in enumerate(batch.columns) if i != column]
        names = [n for i, n in enumerate(batch.schema.names) if i != column]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score), pa.array(ambiguous), pa.array(has_letter)], [*names, "lang_pred", "score", "ambiguous", "has_letter"])


def identify(rows: DataFrame, model: LanguageModel, *keep: Column | str, text: str = "text") -> DataFrame:
    """Stored: the columns `keep` of each row with lang_pred, score, ambiguous and has_letter.

    lang_pred is "und", with score 0 and ambiguous, where the text is null or has no letter, and
    everywhere where the model knows no language.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.select(*keep, F.col(text).alias("_text"))
    at = len(rows.columns) - 1
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean").add("has_letter", "boolean")
    return stored(rows.mapInArrow(lambda it: identify_batches(it, shared.value, at), schema), "identified")


def held_out() -> Column:
    return F.coalesce(F.pmod(id_crc(), F.lit(3)) == 1, F.lit(False))


def learn(documents: DataFrame) -> LanguageModel:
    return fit(documents.filter(~held_out()).select("text", "lang"))


def op5(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, lang_pred, score, ambiguous.

    A null doc_id is not held out; a null text and one without a letter, the empty one too, are
    "und" with score 0; without any training row every text is "und". Repeated rows each have a
    row, and texts are read whole. Columns beyond doc_id, text and lang are not read.
    """
    return identify(documents, learn(documents), F.col("doc_id"), held_out().alias("held_out")).drop("has_letter")


def keep_identified(documents: DataFrame) -> DataFrame:
    """documents without the rows that have no language: null texts and texts without a letter.

    A text with a letter stays whatever lang_pred is, so that a table without any label loses none.
    An ambiguous text stays; its language is a matter of doubt, not its being a text.
    Columns and rows that stay are as they came, repeated rows too. Rows go by doc_id and a hash
    of the text, so that texts don't travel: rows with the same of both have the same verdict.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    with scratch(documents.sparkSession):
        found = identify(documents, learn(documents), F.col("doc_id").alias("_id"), key.alias("_key"))
        gone = stored(found.filter("NOT has_letter").select("_id", "_key").distinct(), "rejected", keep=True)
    return documents.join(gone, documents["doc_id"].eqNullSafe(gone["_id"]) & (key == gone["_key"]), "left_anti")
