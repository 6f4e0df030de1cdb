"""Mixing, packing, sharding and vectors: exact round trips and brute force."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing, packing, pivots, sharding
from spanloom.llm.common import checkpoint, running_sum


def test_targets():
    plan = mixing.plan([("b", 100), (None, 10), ("a", 1), ("é", 1000), ("z", 0)])
    assert [s.name for s in plan] == ["a", "b", "z", "é", None]
    assert [s.weight for s in plan] == [1, 2, 3, 1, 2]
    assert abs(sum(s.target for s in plan) - 1111) < 1e-6
    assert plan[0].target == 3 and plan[2].target == 0 and plan[4].target == 30 and plan[1].target == 300
    assert all(s.target <= 3 * s.size + 1e-9 for s in plan)


def mixing_rows():
    rng = random.Random(11)
    rows = []
    for k in range(300):
        n = 0 if k % 50 == 0 else rng.randint(1, 200)
        rows.append((k, " ".join(f"w{rng.randrange(50)}" for _ in range(n)), "en", "big" if k % 3 else rng.choice(["a", "b", None])))
    return [*rows, (1, rows[1][1], "en", rows[1][3]), (None, "null id", "en", "a"), (500, None, None, "a"), (501, "only", None, "one")]


def test_mix(docs_of):
    rows = mixing_rows()
    got = mixing.taken(mixing.mix(docs_of(rows))).collect()
    assert len(got) == len(rows)
    sums, wanted, sizes = defaultdict(int), {}, defaultdict(int)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.doc_id]
        sums[s] += r.taken
        sizes[s] += r["size"]
        wanted[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
        assert r["size"] == len((next(x[1] for x in rows if x[0] == r.doc_id) or "").split())
    assert all(abs(sums[s] - wanted[s]) <= max(2, 0.02 * wanted[s]) for s in wanted), (sums, wanted)
    assert all(r.source_size == sizes[source[r.doc_id]] for r in got)
    again = mixing.taken(mixing.mix(docs_of(rows))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_against_brute_force(docs_of, monkeypatch):
    """Slot by slot: the source whose share of the unit interval holds the slot's point takes the words of its next block."""
    monkeypatch.setattr(mixing, "SLOTS", 256)
    rows = mixing_rows()
    docs = docs_of(rows)
    key = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()]
    source = {(r[0], r[1]): r[3] for r in rows}
    streams = defaultdict(list)
    order = lambda x: (x[2] % (1 << 64), x[0] if x[0] is not None else -1)
    for i, t, _ in sorted(key, key=order):
        streams[source[i, t]] += [(i, t)] * len((t or "").split())
    names = sorted(streams, key=lambda s: (s is None, s or ""))
    every = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    plan = mixing.plan([(s, len(streams[s])) for s in every])
    slots, taken, n = defaultdict(int), defaultdict(int), sum(p.slots for p in plan)
    wanted = {p.name: p for p in plan}

    def take(name):
        words, p = streams[name], wanted[name]
        k = slots[name] % p.blocks
        begin = lambda b: b * (len(words) // p.blocks) + min(b, len(words) % p.blocks)
        for x in words[begin(k) : begin(k + 1)]:
            taken[x] += 1
        slots[name] += 1

    ends = np.cumsum([p.slots for p in plan]).tolist()
    for slot in range(n):
        point = (slot + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
        k = next(i for i, e in enumerate(ends) if point < (e << 64) // n)
        if slots[plan[k].name] < plan[k].slots:
            take(plan[k].name)
    for p in plan:
        while slots[p.name] < p.slots:
            take(p.name)
    got = defaultdict(int)
    for r in mixing.mix(docs, mixing.WEIGHTS).pieces.collect():
        got[r.doc_id] += r.length
    want = defaultdict(int)
    for (i, _), k in taken.items():
        want[i] += k
    assert len(names) > 3 and dict(got) == dict(want)


def test_schedule_spreads_each_source(docs_of):
    m = mixing.mix(docs_of(mixing_rows()))
    slots = [r.slot for r in m.pieces.select("slot").distinct().collect()]
    assert len(slots) == len(set(slots))
    counts = mixing.schedule(docs_of([]).sparkSession, mixing.plan([("a", 1000), ("b", 3000)])).collect()
    by = defaultdict(list)
    for r in counts:
        by[r.ix].append((r.slot, r["rank"]))
    for k, of in by.items():
        of.sort()
        assert [x[1] for x in of] == list(range(len(of))), k
        share = len(of) / len(counts)
        half = sum(s < len(counts) / 2 for s, _ in of)
        assert abs(half - share * len(counts) / 2) < 8


def test_draw(docs_of):
    rows = mixing_rows()
    docs = docs_of(rows)
    out = mixing.draw(docs)
    assert out.columns == docs.columns
    drawn = out.collect()
    words = sum(len((r.text or "").split()) for r in drawn)
    assert words == sum(r.taken for r in mixing.taken(mixing.mix(docs)).collect())
    whole = {r[1] for r in rows}
    cut = [r for r in drawn if r.text not in whole]
    assert len(cut) <= len({r[3] for r in rows})
    assert all(r.n_chars == len(r.text) and r["size"] == "s" for r in drawn)
    assert mixing.draw(docs_of([])).count() == 0
    assert mixing.taken(mixing.mix(docs_of([]))).count() == 0


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_running_sum(spark, rows):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.getrandbits(63) - (1 << 62), k, rng.randint(0, 9)) for k in range(200)]
    df = checkpoint(spark.createDataFrame(data, "part string, h long, k long, v long"))
    got = running_sum(df, ["part"], ["h", "k"], "v", "before", rows).collect()
    unsigned = lambda h: h & (1 << 64) - 1
    assert len(got) == len(data)
    for r in got:
        assert r.before == sum(v for p, h, k, v in data if p == r.part and (unsigned(h), k) < (unsigned(r.h), r.k))


def test_hilbert_neighbours(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 3)
    for dims in (2, 3):
        grid = np.stack(np.meshgrid(*[np.arange(8)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = packing.hilbert(grid.astype(np.int64))
        assert sorted(key.tolist()) == list(range(8**dims))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    texts = ["", "It's 12 o'clock — ähnlich\n\n  x", "<|endoftext|> 😀👍🏽", "a" * 5000, " " * 300_000 + "x", "\n" * 1_000_000 + "x", "\t\n" * 50, "-" * 200_000]
    for s in texts:
        assert packing.ids(s).tolist() == [*t.encode(s, add_special_tokens=False).ids, 1]
    assert packing.ids(None).tolist() == [1]


def test_sequences_follow_the_curve(docs_of):
    """Documents come in the order of their places on a curve that a plain recursion walks."""
    rng = random.Random(17)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "über", "42"]) for _ in range(rng.randint(1, 400)))) for k in range(60)]
    got = sorted((r.sequence_id, r.offset, r.doc_id) for r in packing.pack(docs_of(rows)).collect())
    seen = list(dict.fromkeys(i for _, _, i in got))
    bucket, sign, matrix = packing.projection()
    keys = {}
    for i, t in rows:
        v = np.zeros(packing.HASHED)
        for x in packing.ids(t).tolist():
            v[bucket[x]] += sign[x]
        z = v / np.linalg.norm(v) @ matrix
        cell = [min(4095, int(0.5 * (1 + math.erf(x / math.sqrt(2))) * 4096)) for x in z]
        keys[i] = int(packing.hilbert(np.array([cell]))[0])
    assert len(set(keys.values())) > 50
    assert [keys[i] for i in seen] == sorted(keys.values())


def test_a_long_range_ends_in_one_sequence(docs_of, monkeypatch):
    rows = [(k, "word " * 3000) for k in range(20)]
    for long, tail in ((1 << 30, 5), (10, 1)):
        monkeypatch.setattr(packing, "LONG", long)
        sizes = defaultdict(int)
        for r in packing.pack(docs_of(rows)).collect():
            sizes[r.sequence_id] += r.length
        short = [n for n in sizes.values() if n < 2048]
        assert len(short) <= tail if tail == 1 else all(n & (n - 1) == 0 for n in short)
        assert sum(sizes.values()) == sum(len(packing.ids(t)) for _, t in rows)


@pytest.mark.parametrize("size", [16 << 20, 3000])
def test_pack(docs_of, odd_rows, monkeypatch, size):
    monkeypatch.setattr(packing, "RANGE", size)
    rows = odd_rows + [(100 + k, f"number {k} " * (k % 40)) for k in range(200)]
    got = packing.pack(docs_of(rows), with_ids=True).collect()
    want = defaultdict(int)
    for i, t, *_ in rows:
        want[i, packing.ids(t).astype("<u4").tobytes()] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for of in sequences.values():
        at = 0
        for r in sorted(of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert sum(r.length for r in got) == sum(len(raw) // 4 * n for (_, raw), n in want.items())
    for (i, raw), n in want.items():
        starts = [r for r in pieces[i, len(raw) // 4] if raw[4 * r.start : 4 * (r.start + r.length)] == bytes(r.ids)]
        assert sum(r.length for r in starts) >= n * len(raw) // 4
    assert packing.pack(docs_of([])).count() == 0


@pytest.mark.parametrize("limit", [1 << 40, 20_000, 900])
def test_shards(docs_of, odd_rows, limit):
    rows = odd_rows + [(1000 + k, "x" * (k % 300)) for k in range(400)] + [(3, "y" * 500)] * 6
    got = sharding.shards(docs_of(rows), limit).collect()
    assert len(got) == len(rows)
    size, ids = defaultdict(int), defaultdict(list)
    for r in got:
        size[r.depth, r.bucket, r.chain] += r.n_bytes
        ids[r.depth, r.bucket, r.chain].append(r.n_bytes)
    for shard, n in size.items():
        assert n <= limit or len(ids[shard]) == 1, shard
    prefixes = {(r.depth, r.bucket) for r in got}
    for d, b in prefixes:
        assert not any((e, b >> (d - e)) in prefixes for e in range(d))
    assert sum(size.values()) == sum(len((t or "").encode()) for _, t, *_ in rows)
    assert sharding.shards(docs_of([])).count() == 0


def test_write_shards(docs_of, tmp_path):
    docs = docs_of([(k, "x" * 100) for k in range(50)]).select("doc_id", "text")
    sharding.write_shards(docs, str(tmp_path / "out"), 1000)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= 1000


def vectors(rng, n, dim=16):
    out = []
    for _ in range(n):
        c = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 8)):
            out.append(c + rng.standard_normal(dim) * 0.04)
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(k, [float(x) for x in np.float32(v)], int(k % 2)) for k, v in enumerate(vectors(rng, 120))]
    rows += [(9000, rows[0][1], 0), (9001, rows[0][1], 0), (9001, rows[0][1], 0), (9002, [2 * x for x in rows[0][1]], 0), (9003, rows[0][1], None), (9004, None, 0), (9005, [0.0] * 16, 0), (9006, [0.0] * 16, 0)]
    rows += [(9007, [float("nan")] * 16, 0), (9008, [None] * 16, 1), (9009, [1.0, 2.0], 0), (9010, [2.0, 4.0], 0), (9011, [], 0), (None, rows[0][1], 0)]
    got = pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    units = [pivots.unit(v) for _, v, _ in rows]
    n = len(rows)
    hit = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and rows[a][2] is not None and rows[a][2] == rows[b][2]:
                hit[a, b] = units[a] @ units[b] >= 0.98
    want = sorted((str(r[0]), int(h.sum())) for r, h in zip(rows, hit, strict=True))
    mine = sorted((str(r.vec_id), r.n_links) for r in got)
    found = sum(min(a[1], b[1]) for a, b in zip(want, mine, strict=True))
    assert found >= 0.9 * hit.sum()
    assert all(b[1] <= a[1] for a, b in zip(want, mine, strict=True))
    names = {r.vec_id: r for r in got}
    for i in (9003, 9004, 9005, 9006, 9007, 9008, 9011):
        assert (names[i].n_links, names[i].component_id, names[i].kept) == (0, i, True)
    assert names[9002].component_id == 0 and names[9010].component_id == 9009
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pivots.near_vectors(empty).count() == 0


def test_write_shards_keeps_the_links_of_one_id(spark, docs_of, tmp_path):
    rows = [(None if k % 2 else 7, "abcdefghij" * 10) for k in range(60)] + [(100 + k, "x" * 30) for k in range(20)]
    sharding.write_shards(docs_of(rows), str(tmp_path / "out"), 1000)
    out = spark.read.parquet(str(tmp_path / "out"))
    sizes = out.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).collect()
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(rows, key=str)
    assert max(r.b for r in sizes) <= 1000
