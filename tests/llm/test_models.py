"""Language identification, toxicity and URL verdicts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import langid, toxicity, urls

SYLLABLES = {"en": ["the", "ing", "ha", "tion", "sh"], "de": ["ein", "ung", "sch", "keit", "ß"], "fr": ["eau", "ment", "é", "que", "oi"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language(docs_of, odd_rows):
    rng = random.Random(3)
    rows = [(1000 + k, speech(rng, lang, rng.randint(3, 80)), lang if k % 7 else None) for k, lang in enumerate(list(SYLLABLES) * 60)]
    truth = {1000 + k: lang for k, lang in enumerate(list(SYLLABLES) * 60)}
    got = {r.doc_id: r for r in langid.predict(docs_of(rows)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    held = [i for i in truth if got[i].held_out]
    assert held and sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    odd = langid.predict(docs_of(rows + odd_rows)).collect()
    assert len(odd) == len(rows) + len(odd_rows)
    by = {r.doc_id: r for r in odd}
    for i in (1, 2, 3, 12):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    assert all(0 <= r.score <= 1 for r in odd)


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = speech(rng, "de", 500)
    want = langid.grams(text)
    monkeypatch.setattr(langid, "CHUNK", 37)
    got = langid.grams(text)
    assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()


def test_keep_known(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    out = langid.keep_known(docs)
    rows = out.collect()
    assert out.columns == docs.columns and {r["score"] for r in rows} == {"sc"}
    assert not {r.doc_id for r in rows} & {1, 2, 3, 12}
    assert langid.keep_known(docs_of([])).count() == 0
    assert {r.lang_pred for r in langid.predict(docs_of([(1, "abc")])).collect()} == {"und"}


def labelled(rng, n):
    rows, labels = [], []
    for k in range(n):
        words = [w for _ in range(rng.randint(20, 60)) for w in [speech(rng, "en", 1)]]
        toxic = int(k % 4 == 0)
        for _ in range(3 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["blarg", "blargish", "snurk"]))
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return rows, labels


def test_toxicity(spark, docs_of, odd_rows):
    rows, labels = labelled(random.Random(6), 400)
    extra = [(10_000 + k if i is not None else None, t) for k, (i, t, *_) in enumerate(odd_rows)]
    table = spark.createDataFrame([(i, 1, t) for i, t in labels] + [(3, 1, None), (None, 0, 1), (5, 0, labels[5][1])], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs_of(rows + extra), table).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    hits = Counter((truth[r.doc_id], r.predicted) for r in held)
    assert hits[1, 1] >= 0.9 * (hits[1, 1] + hits[1, 0]) and hits[0, 1] <= 0.02 * (hits[0, 0] + hits[0, 1])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_held_out_labels_change_nothing(spark, docs_of):
    rows, labels = labelled(random.Random(7), 120)
    flipped = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    scores = []
    for table in ([(i, 1, t) for i, t in labels], flipped):
        got = toxicity.scored(docs_of(rows), spark.createDataFrame(table, "doc_id long, quality int, toxic int")).collect()
        scores.append({r.doc_id: r.score for r in got})
    assert scores[0] == scores[1]


def test_swapped_identities_do_not_change_the_score():
    """Toxic sentences name one group only; with the penalty a neutral mention of it no longer counts."""
    rng = random.Random(8)
    made = []
    for k in range(200):
        words = speech(rng, "en", 30).split()
        if k % 4 == 0:
            words[3:3] = ["muslims", "are", "blarg"]
        elif k % 4 == 1 and k % 8 == 1:
            words[3:3] = ["jews", "live", "here"]
        made.append((int(k % 4 == 0), " ".join(words)))
    rows = lambda: [(y, toxicity.bag(toxicity.counted(t))) for y, t in made]
    pairs = [(toxicity.bag(a), toxicity.bag(b)) for _, t in made for a, b in toxicity.swaps(t)]
    assert len(pairs) > len(made)
    neutral, other = (Counter(w.split()) for w in ("muslims live in the thing", "jews live in the thing"))
    free, held = toxicity.train(rows(), []), toxicity.train(rows(), pairs)
    change = [abs(m.score(neutral, toxicity.Words(m)) - m.score(other, toxicity.Words(m))) for m in (free, held)]
    assert change[1] < 0.5 * change[0]


def test_scores_equal_the_formula(spark, docs_of, odd_rows, monkeypatch):
    """Every document's score, feature by feature."""
    rows, labels = labelled(random.Random(12), 200)
    table = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    docs = docs_of(rows + [(10_000 + k, t) for k, (_, t, *_) in enumerate(odd_rows)])
    model = toxicity.fit(docs, table)
    monkeypatch.setattr(toxicity, "CHUNK", 50)

    def brute(text):
        n = Counter(w for w in re.findall(r"[^\W\d_]+", (text or "").lower()))
        long = math.sqrt(sum((k * float(model.idf[toxicity.of_word(w)[0]])) ** 2 for w, k in n.items()))
        value = sum(k * float(model.idf[f]) * float(model.weight[f]) for w, k in n.items() for f in toxicity.of_word(w)) * 15 / max(long, 1e-9) + model.bias
        return 1 / (1 + math.exp(-(model.slope * (value - model.cut) + math.log(0.7 / 0.3))))

    text = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.scored(docs, table, model).collect()
    assert len(got) == len(text) and all(abs(r.score - brute(text[r.doc_id])) < 1e-4 for r in got)
    assert toxicity.counted("Ab cd" * 40) == Counter(re.findall(r"\w+", ("Ab cd" * 40).lower()))


def test_the_fit_is_at_the_minimum():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 20)).astype(np.float32)
    label = (x[:, 0] - 0.5 * x[:, 1] + rng.standard_normal(300) * 0.3 > 0.4).astype(float)
    d = rng.standard_normal(20)
    swapped = np.outer(d, d)
    w = toxicity.solve(x, label, swapped, np.ones(300, bool))
    each = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())

    def loss(w):
        z = x.astype(float) @ w[:-1] + w[-1]
        return float(each @ np.logaddexp(0, -(2 * label - 1) * z)) + toxicity.RIDGE / 2 * w[:-1] @ w[:-1] + toxicity.SWAP / 2 * w[:-1] @ swapped @ w[:-1]

    assert all(loss(w) <= loss(w + 0.02 * rng.standard_normal(21)) + 1e-6 for _ in range(200))


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs_of([(1, "a b"), (2, None)]), none).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0), (0.0, 0)]
    assert toxicity.scored(docs_of([]), none).count() == 0


def page(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, verdict string")


def test_urls(spark):
    rows = [
        (1, None, None), (2, "no scheme", ""), (3, "http://A.Example.NET/en/x?q=1#f", "<a href=/en/>"), (4, "https://example.net", None), (5, "http://x.net/EN/", ""), (6, "ftp://example.com/de/", ""),
        (7, "http://b.org/fr/://c.net/", ""), (8, "http://notnet/", ""), (9, "http:///path", ""), (10, "http://É.org?x", ""), (11, "http://example.com#/de/", ""), (1, None, None), (None, "http://q.net/", None),
    ]
    got = sorted(urls.judge(page(spark, rows)).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got] == [
        (1, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "example.net", "", None, "allow"),
        (5, "x.net", "/EN/", "net/", "block"), (6, "example.com", "/de/", "example.com/de/", "block"), (7, "b.org", "/fr/://c.net/", "org/fr/", "allow"), (8, "notnet", "/", None, "allow"),
        (9, "", "/path", None, "allow"), (10, "É.org", "", None, "allow"), (11, "example.com", "", None, "allow"), (None, "q.net", "/", "net/", "block"),
    ]
    assert urls.judge(page(spark, [])).count() == 0


def test_distrust_spreads_to_who_links_to_blocked_hosts(spark, monkeypatch):
    farm = '<a href="http://bad.net/1"><a HREF=//bad.net/2>'
    rows = [(1, "http://bad.net/", '<a href="http://fine.com/">'), (2, "http://farm.com/a", farm), (3, "http://farm2.com/a", '<a href="http://farm.com/">'), (4, "http://good.org/fr/", '<a href="http://fine.com/">'), (5, "http://fine.com/", ""), (6, "http://both.com/", farm)]
    rows += [(7, "http://good.org/fr/2", '<a href="http://both.com/"><a href="http://both.com/x">')]
    got = {r.page_id: r.verdict for r in urls.judge(page(spark, rows)).collect()}
    assert [got[k] for k in range(1, 8)] == ["block", "block", "block", "allow", "allow", "allow", "allow"]
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "c", 1.0)], "walk string, host string, seed double")
    edges = spark.createDataFrame([("trust", "a", "b", 1.0), ("trust", "b", "a", 0.5), ("trust", "b", "c", 0.5), ("distrust", "c", "b", 1.0), ("distrust", "b", "a", 1.0)], "walk string, src string, dst string, share double")
    ranks = {(r.walk, r.host): r.rank for r in urls.propagate(edges, seeds).collect()}
    r = dict.fromkeys("abc", 0.0) | {"a": 1.0}
    for _ in range(60):
        n = {"b": 0.85 * r["a"], "a": 0.425 * r["b"], "c": 0.425 * r["b"]}
        n["a"] += 1 - sum(n.values())
        r = n
    assert all(abs(ranks["trust", h] - r[h]) < 1e-3 for h in "abc")
    assert ranks["distrust", "a"] > 0


def test_walk_reaches_beyond_thirty_links(spark, monkeypatch):
    seeds = spark.createDataFrame([("distrust", "h00", 1.0)], "walk string, host string, seed double")
    edges = spark.createDataFrame([("distrust", f"h{k:02}", f"h{k + 1:02}", 1.0) for k in range(34)], "walk string, src string, dst string, share double")
    ranks = {r.host: r.rank for r in urls.propagate(edges, seeds, 1e-4).collect()}
    assert len(ranks) == 35 and abs(ranks["h34"] / ranks["h00"] - 0.85**34) < 1e-3
    assert [urls.steps(urls.SETTLED * urls.FLOOR / n) for n in (5_000, 10**8)] == sorted(urls.steps(urls.SETTLED * urls.FLOOR / n) for n in (5_000, 10**8))
    monkeypatch.setattr(urls, "steps", lambda within: 2)
    with pytest.raises(RuntimeError, match="not settled"):
        urls.propagate(edges, seeds, 1e-3)


def test_hosts_with_some_blocked_pages_and_link_targets_are_seeds(spark):
    rows = [(1, "http://mixed.com/", ""), (2, "http://mixed.com/x", ""), (3, "http://mixed.com/bad/", ""), (4, "http://fan.com/", '<a href="http://mixed.com/x">'), (5, "http://fan2.com/", "<a href=//gone.net/1>"), (6, "http://plain.com/", '<a href="http://else.com/">')]
    rows += [(7, "http://mostly.com/bad/1", ""), (8, "http://mostly.com/bad/2", ""), (9, "http://mostly.com", "")]
    got = {r.page_id: r.verdict for r in urls.judge(page(spark, rows), (("block", "net", "/"), ("block", "com", "/bad/"))).collect()}
    assert [got[k] for k in range(1, 10)] == ["allow", "allow", "block", "block", "block", "allow", "block", "block", "block"]


def brute_verdicts(rows, rules):
    """Verdicts of (page_id, url, html) by dense matrices over all hosts."""

    def split(url):
        found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2]) if found else ("", "")

    def by(host, path):
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    pages, link, blocked_links = {}, Counter(), Counter()
    for i, url, html in rows:
        pages[i] = (*split(url), by(*split(url)))
        for target in re.findall(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", html or ""):
            to, path = split("http:" + target if target.startswith("//") else target)
            if to and pages[i][0] and to != pages[i][0]:
                link[pages[i][0], to] += 1
                blocked_links[to] += by(to, path) == "block"
    own = {p[0] for p in pages.values()} - {""}
    hosts = sorted(own | {b for _, b in link})
    at = {h: k for k, h in enumerate(hosts)}
    n, allowed, blocked = np.zeros(len(hosts)), np.zeros(len(hosts)), np.zeros(len(hosts))
    for h, _, v in pages.values():
        if h:
            n[at[h]] += 1
            allowed[at[h]] += v == "allow"
            blocked[at[h]] += v == "block"
    for (_, b), k in link.items():
        if b not in own:
            n[at[b]] += k
    for b, k in blocked_links.items():
        if b not in own:
            blocked[at[b]] += k
    a = np.zeros((len(hosts), len(hosts)))
    for (x, y), k in link.items():
        a[at[x], at[y]] = k

    def walk(a, seed):
        if not seed.sum():
            return np.zeros(len(hosts)), np.zeros(len(hosts))
        seed, out = seed / seed.sum(), a.sum(axis=1, keepdims=True)
        share, rank = np.divide(a, out, out=np.zeros_like(a), where=out > 0), seed / seed.sum()
        for _ in range(400):
            flow = 0.85 * rank @ share
            rank = flow + seed * (1 - flow.sum())
        return rank, seed * (1 - flow.sum())

    known_hosts = np.array([h in own for h in hosts])
    trust, _ = walk(a, np.where(known_hosts & (2 * allowed > n), allowed, 0.0))
    distrust, own_part = walk(a.T.copy(), np.divide(blocked, n, out=np.zeros(len(hosts)), where=n > 0))
    counted = np.where(2 * blocked > n, distrust, distrust - own_part)
    bad = (counted > trust) & (counted * len(hosts) >= 0.5)
    return {i: v or ("block" if h and bad[at[h]] else "allow") for i, (h, _, v) in pages.items()}


def test_verdicts_against_brute_force(spark, monkeypatch):
    """A made graph with hubs, hosts that are only linked to, and chains between trusted and blocked hosts."""
    monkeypatch.setattr("spanloom.llm.common.HOT_ROWS", 3)
    rng = random.Random(31)
    names = [f"h{k}.{rng.choice(['net', 'org', 'com', 'info'])}" for k in range(45)]
    rows = []
    for k in range(160):
        host = names[0] if k % 8 == 0 else rng.choice(names[:35])
        path = rng.choice(["/", "/fr/a", "/en/b", "/bad/c", ""])
        to = [rng.choice(names) if rng.random() < 0.7 else names[k % 3] for _ in range(30 if host == names[0] else rng.randint(0, 3))]
        html = " ".join(f'<a href="{rng.choice(["http:", ""])}//{t}{rng.choice(["/", "/bad/x", "/fr/y"])}">' for t in to)
        rows.append((k, f"http://{host}{path}", html))
    rules = (("block", "net", "/"), ("allow", "org", "/fr/"), ("block", "com", "/bad/"), ("allow", "h1.net", "/en/"))
    want = brute_verdicts(rows, rules)
    got = {r.page_id: r.verdict for r in urls.judge(page(spark, rows), rules).collect()}
    assert got == want
    ruled = {i for i, u, _ in rows if urls_rule(u, rules)}
    assert {want[i] for i in set(want) - ruled} == {"block", "allow"}


def urls_rule(url, rules):
    host, path = re.match(r"http://([^/]*)(.*)", url).groups()
    return any((host == h or host.endswith("." + h)) and path.startswith(p) for _, h, p in rules)


def test_language_is_that_of_the_nearest_centroid(docs_of, odd_rows):
    rng = random.Random(13)
    rows = [(1000 + k, speech(rng, lang, rng.randint(3, 60)), lang) for k, lang in enumerate(list(SYLLABLES) * 30)] + odd_rows
    docs = docs_of(rows)
    model = langid.fit(docs)

    def brute(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        letters = " " + re.sub(" +", " ", letters)
        n = Counter()
        for width in (1, 2, 3):
            for k in range(len(letters) - width + 1):
                if k + width > 1:  # the space before the text ends no gram
                    n[brute_hash(letters[k : k + width])] += 1
        v = np.zeros(langid.DIMENSIONS)
        for f, k in n.items():
            v[f] = (1 + math.log(k)) * model.idf[f]
        sims = v @ model.centroids / np.linalg.norm(v)
        k = int(np.argmax(sims))
        return model.langs[model.of[k]], min(1.0, max(0.0, float(sims[k])))

    got = sorted(((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in langid.predict(docs, model).collect()))
    want = sorted((str(i), brute(t)[0], round(brute(t)[1], 4)) for i, t, *_ in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-4 for g, w in zip(got, want, strict=True))


def brute_hash(gram):
    h = len(gram)
    for c in gram:
        h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
    return h % langid.DIMENSIONS
