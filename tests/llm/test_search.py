"""Hard negatives and vector codes against full comparisons."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import codes, negatives
from spanloom.llm.common import LARGEST

#: Columns whose names the operators use inside.
EXTRA = ", row int, cell string, whole string, anchor string, far int, block int, code int, error string, _n int, part int"
FILL = (1, "c", "w", "a", 2, 3, 4, "e", 5, 6)


@pytest.fixture(scope="module")
def vectors_of(spark):
    def make(rows, kind="array<float>", label="int"):
        return spark.createDataFrame([(*r, *FILL) for r in rows], f"vec_id long, embedding {kind}, label {label}{EXTRA}").repartition(3)

    return make


def clustered(n, seed, dim=16, hot=0.3):
    """Rows near a few centres, a third of them the same vector, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    out = []
    for i in range(n):
        v = centres[0] if rng.random() < hot else centres[rng.integers(6)] + 0.3 * rng.standard_normal(dim)
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(4))))
    odd = [(50, None, 1), (100, [None] + [0.1] * (dim - 1), 1), (150, [float("nan")] * dim, 2), (200, [float("inf")] + [0.0] * (dim - 1), 2), (250, out[3][1], None), (None, out[4][1], 1), (out[7][0], out[7][1], out[7][2]), (300, [0.5] * (dim // 2), 1), (301, [0.5] * (dim // 2), 1), (302, [0.4] * (dim // 2), 2), (350, [], 1), (351, [], 2), (352, [], 1)]
    return out + odd


def whole(v):
    return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * float(x))) for x in v]


def brute_negatives(rows, positives, negatives_, low, high):
    kept = [(k, i, whole(v), label) for k, (i, v, label) in enumerate(rows) if label is not None and whole(v) is not None]
    out = []
    for k, i, q, label in kept:
        if i is None or i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x, strict=True)), j is None, j if j is not None else 0, other, n) for n, j, x, other in kept if n != k and len(x) == len(q)]
        scored.sort()
        for s, none, j, _, _ in [r for r in scored if r[3] == label][:positives]:
            fit = [r for r in scored if r[3] != label and low * -s <= 100 * -r[0] <= high * -s][:negatives_]
            out += [(i, None if none else j, n + 1, None if r[1] else r[2], -s, -r[0]) for n, r in enumerate(fit)]
    return sorted(map(str, out))


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
def test_negatives_against_brute_force(vectors_of, monkeypatch, small, kind):
    if small:  # many cells, a hot one of many blocks, groups and leaves
        for name, n in (("CELL", 40), ("BLOCK", 30), ("GROUP", 2), ("CANDIDATES", 8), ("ANCHORS", 1)):
            monkeypatch.setattr(negatives, name, n)
    rows = clustered(700, 3) + [(1000 + i, (-np.eye(16)[i % 16]).tolist(), i % 3) for i in range(60)]
    got = negatives.hard_negatives(vectors_of(rows, kind), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 5, 3, 50, 95)
    assert sorted(str(tuple(r)) for r in got.collect()) == want and len(want) > 50


def test_negatives_other_parameters(vectors_of):
    rows = clustered(300, 4)
    got = negatives.hard_negatives(vectors_of(rows), F.col("vec_id") % 50 == 0, positives=2, negatives=4, low=-33, high=101)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_negatives(rows, 2, 4, -33, 101)


def test_negatives_of_nothing(vectors_of):
    for rows in ([], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)], [(50, [1.0, 2.0], 1)], [(50, None, None)]):
        assert negatives.hard_negatives(vectors_of(rows), F.col("vec_id") % 50 == 0).collect() == []


def test_negatives_with_labels_of_text(vectors_of):
    rows = [(i, v, None if x is None else f"l{x}") for i, v, x in clustered(150, 5)]
    got = negatives.hard_negatives(vectors_of(rows, label="string"), F.col("vec_id") % 50 == 0)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_negatives(rows, 5, 3, 50, 95)


def test_pruning_is_safe_and_prunes():
    """Nodes are dropped, and no candidate that counts with them."""
    rng = np.random.default_rng(9)
    x = np.concatenate([np.rint(400 * c + 5 * rng.standard_normal((500, 8))) for c in np.eye(8)]).astype(np.int64)
    label = rng.integers(0, 2, len(x))
    import pyarrow as pa

    block = negatives.Block(np.arange(len(x)), label, x, pa.array(np.arange(len(x))[::-1].copy()))
    scored = []
    add = negatives.Asks.add
    asks = negatives.Asks(np.arange(40), label[:40], x[:40], np.arange(40), np.full(40, -negatives.FAR), np.full(40, negatives.FAR), 5, True)
    asks.add = lambda *a: (scored.append(len(a[0])), add(asks, *a))
    block.search(asks)
    got = sorted(zip(asks.row[asks.owner[asks.found[0]]].tolist(), asks.found[1].tolist(), block.row[asks.found[3]].tolist(), strict=True))
    want = []
    for i in range(40):
        s = [(-int(x[i] @ x[j]), len(x) - 1 - j, j) for j in range(len(x)) if j != i and label[j] == label[i]]
        want += [(i, -a, j) for a, _, j in sorted(s)[:5]]
    assert got == sorted(want)
    assert len(scored) < 2 * len(x) // negatives.CANDIDATES  # of twice as many pairs of leaves


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, whole(v), label) for i, v, label in rows if whole(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], np.array(r[1], "<i4").tobytes()))
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]

    def assign():
        d = [((x[:, p, None, :] - books[p][None]) ** 2).sum(-1) for p in range(parts)]
        return [m.argmin(1) for m in d], sum(m.min(1) for m in d)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                if (at[p] == e).any():
                    mine = x[at[p] == e, p]
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    at, error = assign()
    sums = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        sums[label] = sums.get(label, 0) + int(e)
    name = hashlib.sha256(",".join(str(int(n)) for b in books for e in b for n in e).encode()).hexdigest()
    return name, sorted(str((r[0], "".join(f"{at[p][k]:02x}" for p in range(parts)), int(error[k]), sums[r[2]])) for k, r in enumerate(kept))


@pytest.mark.parametrize("entries", [64, 7, 256])
def test_codes_against_brute_force(vectors_of, monkeypatch, entries):
    monkeypatch.setattr(codes, "AT_ONCE", 100)
    rows = [r for r in clustered(500, 6, dim=32) if r[1] is None or len(r[1]) in (0, 32)]
    found, books = codes.compress(vectors_of(rows), entries=entries)
    name, want = brute_codes(rows, entries=entries)
    assert codes.named(books) == name
    got = codes.with_label_errors(found).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_codes_of_few_rows(vectors_of):
    found, books = codes.compress(vectors_of([]))
    assert found.collect() == [] and codes.with_label_errors(found).collect() == [] and codes.named(books) == hashlib.sha256(b"").hexdigest()
    rows = [(3, [0.5] * 16, None), (1, [-0.001] * 16, None), (1, [-0.001] * 16, 4)]
    found, books = codes.compress(vectors_of(rows))
    assert books.shape == (16, 3, 1) and books[0, 0, 0] == -1
    assert sorted((r.vec_id, r.error, r.code.hex()) for r in found.collect()) == [(1, 0, "00" * 16), (1, 0, "00" * 16), (3, 0, "02" * 16)]
    back = {r.vec_id: r.embedding for r in codes.decoded(found, books).collect()}
    assert all(abs(x - 0.5) <= 1 / 256 for x in back[3])


def test_codes_that_cannot_be(vectors_of):
    for rows in ([(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)], [(1, [0.5] * 17, 1)]):
        with pytest.raises(ValueError, match="one length"):
            codes.compress(vectors_of(rows))
    with pytest.raises(Exception, match=str(LARGEST)):
        codes.compress(vectors_of([(1, [1e30] * 16, 1)]))


def test_ball_tree_is_exact():
    rng = random.Random(2)
    for trial in range(20):
        k, width, span = rng.choice([1, 2, 5, 64, 200]), rng.choice([1, 2, 4]), rng.choice([2, 30, 1 << 24])
        draw = np.random.default_rng(trial)
        entries, x = draw.integers(-span, span, (k, width)), draw.integers(-span, span, (300, width))
        x[:100] = entries[draw.integers(0, k, 100)]  # ties at distance 0 where entries repeat
        d = ((x[:, None, :] - entries[None]) ** 2).sum(-1)
        index, best = codes.BallTree(entries).nearest(x)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
