"""Toxicity scores from a linear model that is held to the same score when identity terms are swapped."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_arrow, narrow_arrow, schema

#: Hashed features; labelled rows of each label that the model is fitted on, at most about.
FEATURES, SAMPLE = 1 << 18, {0: 4000, 1: 2000}
#: Lengths of the word beginnings that are features beside the word.
STEMS = (3, 4, 5, 6, 7, 8)
#: Documents of the sample that a feature must be in; features that have a weight, at most.
LEAST, CHOSEN = 3, 4096
#: Length of the vectors; ridge; weight of the swaps' penalty.
LENGTH, RIDGE, SWAP = 15.0, 1e-2, 10.0
#: Steps of the fit, at most, and steps that it looks back on; parts that are left out in turn.
ROUNDS, MEMORY, FOLDS = 100, 8, 3
#: A score of this or more is toxic.
TOXIC = 0.7
#: Words that a worker remembers, about; characters that are counted at a time.
REMEMBER, CHUNK = 200_000, 1 << 20
WORD = re.compile(r"[^\W\d_]+")
OUTSIDE = re.compile(r"[\W\d_]")
SENTENCE = re.compile(r"[.!?\n]+")

#: Neutral names of groups of people. Each row is one kind, and a term is swapped for another of its row.
IDENTITIES = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists"),
    ("muslim", "jew", "christian", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "citizens"),
    ("frauen", "männer", "mädchen", "jungen", "mütter", "väter"),
    ("muslime", "juden", "christen", "hindus", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer", "migranten", "einheimische", "bürger"),
    ("femmes", "hommes", "filles", "garçons", "mères", "pères"),
    ("musulmans", "juifs", "chrétiens", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "migrants", "autochtones", "citoyens"),
    ("mujeres", "hombres", "chicas", "chicos", "madres", "padres"),
    ("musulmanes", "judíos", "cristianos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "migrantes", "nativos", "ciudadanos"),
)


def held_out() -> Column:
    """Whether a document's label is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def of_word(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself, and its beginnings."""
    names = [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for n in names)


def counted(text: str | None) -> Counter:
    """How often each lower-case word occurs; a long text is cut between words."""
    out: Counter = Counter()
    at, n = 0, len(text or "")
    while at < n:
        gap = OUTSIDE.search(text, at + CHUNK)
        end = gap.start() if gap else n
        out.update(WORD.findall(text[at:end].lower()))
        at = end
    return out


Bag = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def bag(words: Counter) -> Bag:
    """Of counted words: each word's own feature and count, and all features with theirs."""
    own, n = np.zeros(len(words), np.int64), np.fromiter(words.values(), np.int64, len(words))
    at: list[int] = []
    times: list[int] = []
    for i, (w, k) in enumerate(words.items()):
        f = of_word(w)
        own[i] = f[0]
        at += f
        times += [k] * len(f)
    ids, back = np.unique(np.array(at, np.int64), return_inverse=True)
    return own, n, ids, np.bincount(back, weights=times, minlength=len(ids)).astype(np.int64)


def swaps(text: str, identities=IDENTITIES) -> list[tuple[Counter, Counter]]:
    """Sentences that differ in whom they name, as counted words.

    Each sentence that names a group is paired with itself with the names swapped in their kind. And one sentence, which
    the text's hash picks, is a template: it gets a slot that one term of a kind fills, and then the next.
    """
    other = {}
    for kind in identities:
        for a, b in zip(kind, (*kind[1:], kind[0]), strict=True):
            other.setdefault(a, b)
    out, sentences = [], [WORD.findall(s) for s in SENTENCE.split(text.lower())]
    for words in sentences:
        if any(w in other for w in words):
            out.append((Counter(words), Counter(other.get(w, w) for w in words)))
    sentences = [words for words in sentences if words]
    if sentences and other:
        pick = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        words, term = sentences[pick % len(sentences)], sorted(other)[pick // 7 % len(other)]
        out.append((Counter([*words, term]), Counter([*words, other[term]])))
    return out


class Words(dict):
    """Places of words in two arrays, filled as words are met: what each adds to a text's value, and its share of the squared length."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.values, self.squares = np.zeros(1024), np.zeros(1024)

    def __missing__(self, word: str) -> int:
        k, f = len(self), np.array(of_word(word))
        if k == len(self.values):
            self.values, self.squares = np.concatenate([self.values, np.zeros(k)]), np.concatenate([self.squares, np.zeros(k)])
        self.values[k] = float(self.model.idf[f] @ self.model.weight[f])
        self.squares[k] = float(self.model.idf[f[0]] ** 2)
        self[word] = k
        return k


@dataclass
class Model:
    """Inverse document frequencies and weights of the features, and what turns a text's value into a score."""

    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    cut: float = 0.0

    def score(self, words: Counter, known: Words) -> float:
        """The sum of the words' weights at the text's LENGTH, as a score; ``known`` is kept from text to text."""
        if not len(self.idf):
            return 0.0
        n, at = np.fromiter(words.values(), np.float64, len(words)), np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        long = math.sqrt(float((n * n) @ known.squares[at]))
        value = float(n @ known.values[at]) * LENGTH / max(long, 1e-9) + self.bias
        z = self.slope * (value - self.cut) + math.log(TOXIC / (1 - TOXIC))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def solve(x: np.ndarray, label: np.ndarray, swapped: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Weights, the bias last, that minimise the logistic loss of both labels alike, the ridge, and ``swapped``: a quadratic form, the mean squared change under swaps.

    Quasi-Newton steps from the last few gradients, each shortened until the loss falls. Rows that are not ``used``
    weigh nothing, so that no copy of the others is made.
    """
    n = [max(1, int((used & (label == k)).sum())) for k in (0, 1)]
    each = used * np.where(label == 1, 0.5 / n[1], 0.5 / n[0])
    sign = 2 * label - 1

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = (x @ w[:-1].astype(np.float32)).astype(np.float64) + w[-1]
        e = -each * sign / (1 + np.exp(np.clip(sign * z, -500, 500)))
        moved = swapped @ w[:-1]
        value = float(each @ np.logaddexp(0, -sign * z)) + RIDGE / 2 * float(w[:-1] @ w[:-1]) + SWAP / 2 * float(w[:-1] @ moved)
        return value, np.append((e.astype(np.float32) @ x).astype(np.float64) + RIDGE * w[:-1] + SWAP * moved, e.sum())

    w = np.zeros(x.shape[1] + 1)
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        d, shares = g.copy(), []
        for s, y in reversed(past):
            shares.append(s @ d / (s @ y))
            d -= shares[-1] * y
        d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(past, reversed(shares), strict=True):
            d += (a - y @ d / (s @ y)) * s
        step = 1.0
        while step > 1e-6:
            new = w - step * d
            new_value, new_g = loss(new)
            if new_value <= value - 1e-4 * step * float(d @ g):
                break
            step /= 2
        else:
            break
        s, y = new - w, new_g - g
        if s @ y > 1e-12:
            past = [*past[1 - MEMORY :], (s, y)]
        done = value - new_value < 1e-7 * value
        w, value, g = new, new_value, new_g
        if done:
            break
    return w


def train(rows: list[tuple[int, Bag]], pairs: list[tuple[Bag, Bag]]) -> Model:
    """A model of labelled bags and of swapped sentences. Where a score becomes TOXIC is set on rows left out in turn."""
    label = np.array([r[0] for r in rows], float)
    if label.sum() < 2 or (1 - label).sum() < 2:
        return Model()
    n = len(rows)
    has = np.zeros((2, FEATURES))
    for y, b in rows:
        has[y, b[2]] += 1
    n_docs = has.sum(axis=0)
    m = Model(idf=np.log((n + 1) / (n_docs + 1)).astype(np.float32))
    # features that tell the labels apart, by the difference of their shares over its deviation
    share = (n_docs + 1) / (n + 2)
    apart = np.abs(has[1] / label.sum() - has[0] / (1 - label).sum()) / np.sqrt(share * (1 - share))
    chosen = np.sort(np.argsort(-np.where(n_docs >= LEAST, apart, -1.0), kind="stable")[:CHOSEN])
    chosen = chosen[n_docs[chosen] >= LEAST]
    place = np.full(FEATURES, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def vector(b: Bag) -> tuple[np.ndarray, np.ndarray]:
        own, times, at, k = b
        here = place[at] >= 0
        return place[at[here]], k[here] * m.idf[at[here]] * (LENGTH / max(math.sqrt(float(((times * m.idf[own]) ** 2).sum())), 1e-9))

    x = np.zeros((n, len(chosen)), np.float32)
    for i in range(n):
        at, v = vector(rows[i][1])
        x[i, at] = v
    rows.clear()
    swapped = np.zeros((len(chosen), len(chosen)))
    for a, b in pairs:
        (i, u), (j, v) = vector(a), vector(b)
        ids, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        change = np.bincount(back, weights=np.concatenate([u, -v]), minlength=len(ids))
        ids, change = ids[change != 0], change[change != 0]
        swapped[np.ix_(ids, ids)] += np.outer(change, change) / len(pairs)
    value = np.zeros(n)
    for f in range(FOLDS):
        out = np.arange(n) % FOLDS == f
        w = solve(x, label, swapped, ~out)
        value[out] = (x @ w[:-1].astype(np.float32))[out] + w[-1]
    order = np.argsort(-value, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, n + 1) + label.sum())
    best = int(np.argmax(f1))
    following = value[order[best + 1]] if best + 1 < n else value[order[best]] - 1
    m.cut = float((value[order[best]] + following) / 2)
    m.slope = float(2 / max(value.std(), 1e-9))
    w = solve(x, label, swapped, np.ones(n, bool))
    m.weight, m.bias = np.zeros(FEATURES, np.float32), float(w[-1])
    m.weight[chosen] = w[:-1]
    return m


BAG = [(f"{c}{k}", "binary") for k in (1, 2) for c in ("own", "n_own", "at", "n")]


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """The model of a bounded sample of labelled documents, which a hash of the id picks; none of them is held out."""
    narrow_arrow(docs.sparkSession)
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample[1] / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, sample[0] / max(1, sizes.get(0, 0)))))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    few = known.where(draw < rate)  # about the sample's number of rows, whatever the tables' size
    drawn = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for label, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.append((label, *bag(counted(t)), *[None] * 4))
                rows += [(None, *bag(x), *bag(y)) for x, y in swaps(t)]
            cols = [pa.array([r[0] for r in rows], pa.int32())]
            cols += [pa.array([None if r[k] is None else r[k].astype("<u4").tobytes() for r in rows], pa.binary()) for k in range(1, 9)]
            yield pa.RecordBatch.from_arrays(cols, names=["toxic", *(c for c, _ in BAG)])

    got = map_arrow(drawn, run, schema(("toxic", "int"), *BAG)).toArrow()

    def numbers(*raw: bytes) -> Bag:
        return tuple(np.frombuffer(x, "<u4") for x in raw)

    every = list(zip(*(got[c].to_pylist() for c in got.column_names), strict=True))
    del got
    rows = sorted((r for r in every if r[0] is not None), key=lambda r: (zlib.crc32(r[3]), r[3], r[0]))
    pairs = sorted((r[1:] for r in every if r[0] is None))
    del every
    return train([(r[0], numbers(*r[1:5])) for r in rows], [(numbers(*r[:4]), numbers(*r[4:])) for r in pairs])


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (1 if score >= TOXIC).

    Words and their beginnings are weighed over the whole text. Null, empty and wordless texts have the score of a
    text without features. Without two labelled documents of either label every score is 0. Repeated rows score alike.
    Other columns are not read; an empty table gives an empty result.
    """
    model = model or fit(docs, labels)
    narrow_arrow(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = held.value, Words(held.value)
        for b in batches:
            if len(known) > REMEMBER:
                known = Words(m)
            out = [m.score(counted(t), known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    out = map_arrow(docs.select("doc_id", "text"), run, schema(("doc_id", docs.schema["doc_id"].dataType), ("score", "double")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
