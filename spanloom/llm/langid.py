"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_arrow, narrow_arrow, schema

#: Hashed dimensions of the n-gram vectors.
DIMENSIONS = 1 << 14
#: Labelled documents per language that the centroids are fitted on, at most (a hash of the id picks them).
SAMPLE = 400
#: Centroids of a language; languages, at most.
CENTROIDS, LANGUAGES = 4, 2000
#: A text is rejected when its cosine is below this share of the least that its language had in the sample.
REJECT = 0.5
UNKNOWN = "und"
#: Characters that are counted at a time.
CHUNK = 1 << 20


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed 1- to 3-grams of the lower-case letters and word ends, with their counts; None without a letter."""
    if not text:
        return None
    counts, found, tail = np.zeros(DIMENSIONS, np.int64), False, np.full(1, 32, np.uint32)
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4").copy()
        is_letter = letters()[c]
        found |= bool(is_letter.any())
        c[~is_letter] = 32
        n_tail, c = len(tail), np.concatenate([tail, c])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        keep[:n_tail] = True
        c = c[keep]
        for width in (1, 2, 3):
            if len(c) >= width:
                first = max(0, n_tail - width + 1)  # n-grams that end in this chunk
                h = np.full(len(c) - width + 1 - first, width, np.uint32)
                for k in range(width):
                    h = (h ^ c[first + k : len(c) - width + 1 + k]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                counts += np.bincount(h & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
        tail = c[-2:]
    if not found:
        return None
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    """Inverse document frequencies, centroids in rows with their language, and each language's least cosine."""

    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    langs: list[str]
    least: np.ndarray

    def best(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine from 0 to 1, and whether the text is rejected."""
        got = grams(text)
        if got is None or not self.langs:
            return UNKNOWN, 0.0, True
        at, n = got
        v = (1 + np.log(n)) * self.idf[at]
        sims = (v @ self.centroids[at]) / np.sqrt(v @ v)
        k = int(np.argmax(sims))
        lang, sim = int(self.of[k]), min(1.0, max(0.0, float(sims[k])))
        return self.langs[lang], sim, sim < REJECT * float(self.least[lang])


def clusters(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit rows; the first centre is the row nearest the mean, each next the row farthest from those taken."""
    centres = [x[np.argmax(x @ x.mean(axis=0))]]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, axis=1))])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([m / max(np.linalg.norm(m), 1e-12) for m in (x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c)))])
    return c


def held_out() -> Column:
    """Whether a document's label is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Centroids from at most about ``sample`` labelled documents per language, whole texts, none of them held out."""
    narrow_arrow(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"fit: over {LANGUAGES} languages")
    rates = docs.sparkSession.createDataFrame([(r[0], min(1.0, sample / r[1])) for r in sizes], "lang string, rate double")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, *g) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (g := grams(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype("<u2").tobytes() for r in rows], pa.binary()), pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary())], names=["lang", "at", "n"])

    drawn = known.select("lang", "text", draw.alias("draw")).join(F.broadcast(rates), "lang").where("draw < rate").select("lang", "text")
    got = map_arrow(drawn, run, schema(("lang", "string"), ("at", "binary"), ("n", "binary"))).toArrow()
    rows = sorted(zip(*(got[c].to_pylist() for c in got.column_names), strict=True))
    langs = sorted({r[0] for r in rows})
    n_docs = np.zeros(DIMENSIONS)
    for r in rows:
        n_docs[np.frombuffer(r[1], "<u2")] += 1
    idf = (np.log((1 + len(rows)) / (1 + n_docs)) + 1).astype(np.float32)
    found, of, least = [np.zeros((0, DIMENSIONS), np.float32)], [], []
    for i, (_, mine) in enumerate(groupby(rows, key=lambda r: r[0])):  # the vectors of one language at a time
        mine = list(mine)
        x = np.zeros((len(mine), DIMENSIONS), np.float32)
        for k, r in enumerate(mine):
            at = np.frombuffer(r[1], "<u2")
            x[k, at] = (1 + np.log(np.frombuffer(r[2], "<u4"))) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = clusters(x, k=centroids)
        found.append(c)
        of += [i] * len(c)
        least.append(np.max(x @ c.T, axis=1).min())
    return Model(idf, np.ascontiguousarray(np.concatenate(found).T), np.array(of, int), langs, np.array(least))


def judged(df: DataFrame, model: Model) -> DataFrame:
    """``df``, whose last column is a text, with lang_pred, score and rejected in its place."""
    narrow_arrow(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats per centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [held.value.best(t) for t in b.columns[-1].to_pylist()]
            columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    return map_arrow(df, run, schema(*[(f.name, f.dataType) for f in df.schema[:-1]], ("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")))


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (cosine, 0 to 1), rejected.

    Each whole text goes to the language of the nearest centroid. A null text, or one without a letter, has ``und``
    and score 0 and is rejected; so is a text too far from all centroids, which keeps its nearest language. Ties go to
    the language first in order. Without any labelled document every text is ``und``. Repeated rows are predicted
    alike; other columns are not read; an empty table gives an empty result.
    """
    out = judged(docs.select("doc_id", held_out().alias("held_out"), "text"), model or fit(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected texts, its columns unchanged, whatever their names."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    return judged(rows, fit(docs)).where(~F.col("rejected")).select("_row.*")
