"""Exact and near deduplication and repeated passages, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import exact, golay, graph, shingles, simhash, substring

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_groups(docs_of, odd_rows):
    for digests in (True, False):
        got = exact.exact_groups(docs_of(odd_rows), digests=digests).collect()
        groups = defaultdict(list)
        for i, t, *_ in odd_rows:
            groups[SPACE.sub("", t or "")].append((i, t or ""))
        assert len(got) == len(odd_rows)
        assert sum(r.kept for r in got) == len(groups)
        for members in groups.values():
            best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
            mine = [r for r in got if r.keep_id == best and r.group_size == len(members)]
            assert len(mine) >= len(members)
        if digests:
            texts = sorted(hashlib.sha256(SPACE.sub("", t or "").encode()).hexdigest() for _, t, *_ in odd_rows)
            assert sorted(bytes(r.digest).hex() for r in got) == texts


@pytest.mark.parametrize(("a_key", "most"), [(32, 1 << 31), (1, 1 << 15), (1 << 12, 1 << 20)])
def test_exact_whatever_the_filter(docs_of, odd_rows, monkeypatch, a_key, most):
    """A filter that takes many keys for others costs hashes and changes nothing; a sparse one lets only surviving rows through."""
    rows = [*odd_rows, *[(k, f"{k % 3000} text {k}" if k % 7 else f"again {k % 21}", "en", "a") for k in range(1000, 5000)]]
    monkeypatch.setattr("spanloom.llm.common.HOT_ROWS", 1)
    monkeypatch.setattr(exact, "BITS_A_KEY", a_key)
    monkeypatch.setattr(exact, "BITS", most)
    monkeypatch.setattr(exact, "ROW", min(exact.ROW, most))
    got = exact.exact_groups(docs_of(rows)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups["".join((t or "").split())].append(i)
    assert sorted(r.group_size for r in got) == sorted(len(g) for g in groups.values() for _ in g)
    hashed = sum(r.digest is not None for r in got)
    surviving = Counter((len(c), c[:64]) for c in ("".join((t or "").split()) for _, t, *_ in rows))
    assert hashed >= sum(n for n in surviving.values() if n > 1)
    if a_key > 1:
        assert hashed <= sum(n for n in surviving.values() if n > 1) + len(rows) / a_key


def test_exact_filter_has_every_key(spark):
    keys = spark.range(50_000).select((F.col("id") % 97).alias("n"), F.xxhash64("id").alias("head"))
    rows = keys.unionByName(spark.range(50_000, 150_000).select((F.col("id") % 97).alias("n"), F.xxhash64("id").alias("head"))).withColumn("k", F.monotonically_increasing_id())
    got = exact.with_survivors(rows.join(keys.withColumn("real", F.lit(True)), ["n", "head"], "left"), keys).groupBy("real").agg(F.count_if("_left").alias("taken"), F.count("*").alias("n"))
    got = {r["real"]: r for r in got.collect()}
    assert got[True].taken == got[True].n == 50_000
    assert got[None].taken <= got[None].n / 20


def test_drop_exact_keeps_columns(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    out = exact.drop_exact(docs)
    assert out.columns == docs.columns
    unique = docs_of([(k, *r[1:]) for k, r in enumerate(odd_rows)])
    assert sorted(r.text or "" for r in exact.drop_exact(unique).collect()) == sorted(r.text or "" for r in out.collect())
    rows = out.collect()
    assert len(rows) == len({SPACE.sub("", t or "") for _, t, *_ in odd_rows})
    assert {r["score"] for r in rows} == {"sc"}


def test_empty_tables(docs_of):
    empty = docs_of([])
    assert exact.exact_groups(empty).count() == 0
    assert exact.drop_exact(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert simhash.drop_near(empty).count() == 0
    assert substring.remove_repeats(empty).count() == 0


def brute_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd_rows):
    for _, t, *_ in odd_rows:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_golay_tables():
    error, further = simhash.golay()
    assert len(set(error.tolist())) == 2048
    heavy = [bin(int(x)).count("1") for x in further[further > 0]]
    assert set(heavy) == {7} and (further > 0).sum() == 5 * 1771


def test_words_one_bit_apart_share_a_codeword():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 4000)
    b = a ^ (1 << rng.integers(0, 23, 4000))
    (ia, ka), (ib, kb) = simhash.codewords(a), simhash.codewords(b)
    for x in range(4000):
        assert set(ia[x][ka[x]]) & set(ib[x][kb[x]])


def test_near_fingerprints_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a.copy()
    for x in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[x] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for f in (a, b):
        row, key = simhash.keys(f.view(np.int64))
        sets = defaultdict(set)
        for r, k in zip(row.tolist(), key.tolist(), strict=True):
            sets[r].add(k)
        keys.append(sets)
    assert all(keys[0][x] & keys[1][x] for x in range(len(a)))


def brute_components(fps):
    names = sorted(fps)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in names}


@pytest.mark.parametrize("bucket", [8192, 5])
def test_links_join_what_all_links_join(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    fps = {}
    for k in range(40):
        f = rng.getrandbits(64)
        for j in range(rng.randint(1, 12)):
            fps[100 * k + j] = f
            for _ in range(rng.randint(0, 3)):
                f ^= 1 << rng.randrange(64)
    distinct = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps.values())], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(distinct)).collect()}
    mine = defaultdict(set)
    for n, f in fps.items():
        s = f - (1 << 64) if f >> 63 else f
        mine[roots.get(s, s)].add(n)
    want = defaultdict(set)
    for n, r in brute_components(fps).items():
        want[r].add(n)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_near_groups_and_drop(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == len(odd_rows)
    fps = {(i, t): brute_fingerprint(t) for i, t, *_ in odd_rows}
    assert sorted(r.fp & (1 << 64) - 1 for r in rows) == sorted(fps[i, t] for i, t, *_ in odd_rows)
    zero = [r for r in rows if r.fp == 0]
    assert {r.component_id for r in zero} == {1}
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and ids.count(5) == 1 and ids.count(1) == 1 and ids.count(2) == 0 and None not in ids


def test_components_of_the_whole_query(docs_of, monkeypatch):
    monkeypatch.setattr("spanloom.llm.common.HOT_ROWS", 2)
    rng = random.Random(19)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randint(20, 200))]
        for j in range(rng.randint(1, 6)):
            rows.append((10 * k + j, " ".join(words)))
            words[rng.randrange(len(words))] = "new"
    want = brute_components({i: brute_fingerprint(t) for i, t in rows})
    assert len(set(want.values())) < len(rows)
    assert {r.doc_id: r.component_id for r in simhash.near_groups(docs_of(rows)).collect()} == want


def test_exact_reads_whole_texts_of_surviving_groups_only(docs_of):
    """Texts that length or prefix tell apart have no full hash; with digests the extra column changes no group."""
    rows = [(1, "a" * 100), (2, "a" * 100), (3, "a" * 99 + "b"), (4, "b" * 100), (5, "c" * 7), (6, "a " * 100)]
    got = {r.doc_id: r for r in exact.exact_groups(docs_of(rows)).collect()}
    assert {i for i, r in got.items() if r.digest is not None} == {1, 2, 3, 6}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.values()} == {(1, 6, 3), (2, 6, 3), (6, 6, 3), (3, 3, 1), (4, 4, 1), (5, 5, 1)}


def brute_copies(rows):
    """Per row the least id of its component under links of five-word Jaccard similarity 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("sets", [1024, 3])
def test_near_copies_of_similarity_one_to_four_fifths(docs_of, monkeypatch, sets):
    monkeypatch.setattr(shingles, "BLOCK_SETS", sets)
    rng = random.Random(12)
    rows = []
    for k in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(6, 300))]
        for j in range(rng.randint(1, 9)):
            rows.append((100 * k + j, " ".join(words)))
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
    want = brute_copies(rows)
    assert 25 < len(set(want.values())) < len(rows)
    assert {r.doc_id: r.component_id for r in shingles.near_copies(docs_of(rows)).collect()} == want
    assert sorted(r.doc_id for r in simhash.drop_near(docs_of(rows)).collect()) == sorted(set(want.values()))


def test_codewords_of_votes_are_the_nearest():
    rng = np.random.default_rng(9)
    code = np.unique((c := rng.integers(0, 1 << 23, 60_000)) ^ simhash.golay()[0][golay.syndrome(c)])
    assert len(code) == 4096
    sent = rng.choice(code, 500)
    signs = 2 * (sent[:, None] >> np.arange(23) & 1) - 1
    votes = signs * rng.integers(5, 9, signs.shape)
    for row in votes:  # four turned, though weakly, are one more than the word alone can tell
        row[rng.choice(23, 4, replace=False)] *= -1
    weak = np.sign(votes) * np.where(np.sign(votes) == signs, np.abs(votes), 1)
    assert (golay.decoded(weak) == sent >> 11).all()
    noise = rng.normal(size=(2000, 23))
    best = code[(noise @ (2 * (code[:, None] >> np.arange(23) & 1) - 1).T).argmax(axis=1)] >> 11
    assert (golay.decoded(noise) == best).mean() > 0.9


@pytest.mark.parametrize(("common", "mine", "other"), [(4, 0, 1), (8, 1, 1), (12, 0, 3), (80, 10, 10), (80, 0, 20)])
def test_sets_of_four_fifths_share_codewords_and_are_near(common, mine, other):
    rng = np.random.default_rng(common + other)
    for _ in range(300):
        x = rng.integers(0, 1 << 63, common + mine + other, dtype=np.uint64)
        prints, words = shingles.simhashes([x[: common + mine], np.delete(x, slice(common, common + mine))])
        assert (words[0] == words[1]).any()
        apart = np.bitwise_count((prints[0] ^ prints[1]).view(np.uint64)).astype(int)
        assert apart[: shingles.FIRST].sum() <= shingles.NEAR_FIRST and apart.sum() <= shingles.NEAR


@pytest.mark.parametrize(("bucket", "rows"), [(8192, 1 << 14), (8192, 8), (7, 8), (3, 8)])
def test_buckets_of_any_size_join_the_same_sets(spark, monkeypatch, bucket, rows):
    """Links of fingerprints by brute force; small buckets are cut into blocks. Some fingerprints are of several nodes."""
    monkeypatch.setattr(shingles, "BUCKET", bucket)
    monkeypatch.setattr(shingles, "ROWS_AT_ONCE", rows)
    rng = random.Random(bucket)
    made, node = [], 0
    for group in range(12):
        prints, words = rng.getrandbits(256), [rng.randrange(4096) for _ in range(shingles.SEGMENTS)]
        for _ in range(rng.choice([1, 2, 5, 40])):
            node += 1
            made.append((node * 7919 % 10007, prints, [w if rng.random() < 0.3 else rng.randrange(4096) for w in words]))
            for _ in range(rng.choice([0, 1, 30])):
                prints ^= 1 << rng.randrange(256)
    pack = lambda x: bytearray(x.to_bytes(32, "little"))
    nodes = spark.createDataFrame([(n, pack(p), bytearray(np.array(w, np.uint16).tobytes())) for n, p, w in made], "node long, prints binary, words binary")
    mine = {n: n for n, _, _ in made} | {r.node: r.root for r in graph.components(shingles.near_fingerprints(nodes)).collect()}
    of = {n: n for n, _, _ in made}
    first = (1 << 64 * shingles.FIRST) - 1
    for k, (n, p, w) in enumerate(made):
        for m, q, v in made[:k]:
            if any(x == y for x, y in zip(w, v, strict=True)) and (p ^ q).bit_count() <= shingles.NEAR and ((p ^ q) & first).bit_count() <= shingles.NEAR_FIRST and of[n] != of[m]:
                low, high = sorted((of[n], of[m]))
                of = {i: low if r == high else r for i, r in of.items()}
    assert mine == of and 12 <= len(set(of.values())) < len(of)


def test_a_large_group_is_told_once_not_by_each_bucket(spark, monkeypatch):
    """Rows that the search makes of a group that meets in most segments; before, each of 32 tasks told of it."""
    made, tell = spark.sparkContext.accumulator(0), shingles.candidates

    def counted(*args):
        for b in tell(*args):
            made.add(b.num_rows)
            yield b

    monkeypatch.setattr(shingles, "candidates", counted)
    rng, n = np.random.default_rng(5), 500
    words = np.where(rng.random((n, shingles.SEGMENTS)) < 0.7, rng.integers(0, 4096, shingles.SEGMENTS), rng.integers(0, 4096, (n, shingles.SEGMENTS)))
    prints = np.packbits(rng.random((n, 256)) < 0.03, axis=1)
    nodes = spark.createDataFrame([(k, bytearray(p.tobytes()), bytearray(w.astype(np.uint16).tobytes())) for k, p, w in zip(range(n), prints, words, strict=True)], "node long, prints binary, words binary")
    were = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(were, ("32", "false"), strict=True):
            spark.conf.set(k, v)
        joined = {r.node: r.root for r in graph.components(shingles.near_fingerprints(nodes)).collect()}
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert joined == dict.fromkeys(range(n), 0)
    assert made.value <= (shingles.EARLY + 2) * n


@pytest.mark.parametrize("few", [256, 3])
def test_rows_of_one_node_are_joined_and_not_compared(monkeypatch, few):
    monkeypatch.setattr(shingles, "FEW", few)
    rng = random.Random(few)
    rows = []
    for key in range(30):
        prints = rng.getrandbits(256)
        for _ in range(rng.choice([1, 2, 9, 60])):
            prints = rng.getrandbits(256) if rng.random() < 0.2 else prints ^ sum(1 << b for b in rng.sample(range(256), rng.choice([1, 30])))
            rows.append((key, rng.randrange(1000 * key, 1000 * key + 40), prints))
    rows.sort(key=lambda r: r[:2])
    members = np.array([[n, *np.frombuffer(p.to_bytes(32, "little"), np.int64)] for _, n, p in rows], np.int64)
    key, node = np.array([k for k, _, _ in rows]), members[:, 0]
    a, b = shingles.alike(key, members)
    assert (node[a] != node[b]).any() and (key[a] == key[b]).all()

    def sets(pairs):
        of = {n: n for n in node.tolist()}
        for x, y in pairs:
            low, high = sorted((of[x], of[y]))
            of = {i: low if r == high else r for i, r in of.items()}
        return of

    first = (1 << 64 * shingles.FIRST) - 1
    near = [(n, m) for i, (k, n, p) in enumerate(rows) for j, m, q in rows[:i] if j == k and (p ^ q).bit_count() <= shingles.NEAR and ((p ^ q) & first).bit_count() <= shingles.NEAR_FIRST]
    assert sets(zip(node[a].tolist(), node[b].tolist(), strict=True)) == sets(near)


def brute_repeats(rows, window=50):
    first, words = {}, {}
    for i, t in rows:
        words[i, t] = WORDS.findall(t or "")
        if i is not None:
            w = words[i, t]
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words[i, t], set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "size"), [(200, 32 << 20), (1, 100)])
def test_repeats(spark, docs_of, monkeypatch, hot, size):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "BYTES_AT_ONCE", size)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [text(80), text(51), text(50), text(49)]
    rows = []
    for i in range(60):
        w = text(rng.randint(0, 90))
        for s in rng.sample(shared, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w = w[:at] + s + w[at:]
        rows.append((i, " ".join(w)))
    rows += [(60, " ".join(["To"] * 200)), (61, " ".join(["To"] * 120)), (7, rows[7][1]), (7, " ".join(shared[0])), (None, rows[3][1]), (62, None), (63, ""), (64, "a b " * 60)]
    got = [tuple(r) for r in substring.remove_repeats(docs_of(rows)).collect()]
    assert sorted(got, key=str) == brute_repeats(rows)


def test_ids_of_words_are_an_error(docs_of):
    with pytest.raises(TypeError, match="whole number"):
        substring.remove_repeats(docs_of([(1, "a b")]).withColumn("doc_id", F.lit("x")))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000}


def test_components_with_a_hot_root(spark, monkeypatch):
    monkeypatch.setattr(graph, "EDGES", 20)
    edges = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(300 + k, 301 + k) for k in range(90)] + [(299, 350)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == dict.fromkeys(range(391), 0)
