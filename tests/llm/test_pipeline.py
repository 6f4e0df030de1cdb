"""The stages one after another, and the registry."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from spanloom.llm import langid, packing, queries


def test_stages(spark, docs_of, odd_rows, tmp_path):
    docs = docs_of(odd_rows + [(200 + k, f"the quick word number {k} of the text " * 3, "en", "s" + str(k % 3)) for k in range(60)])
    columns = docs.columns
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] > 0
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]


def test_registry():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.oracle_sql()) <= set(names)


def brute_near(texts):
    """Of {doc_id: text} the least id of each component under five-word Jaccard similarity of 0.8 or more."""
    sets, of = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = {k: low if v == high else v for k, v in of.items()}
    return set(of.values())


def test_stages_against_brute_force(spark, docs_of, tmp_path):
    """Exact copies (with other blanks), near copies of several strengths and texts in no language are planted."""
    rng = random.Random(21)
    words = {"en": "the quick brown fox walked over that old bridge with some friends this morning".split(), "de": "der schnelle braune fuchs lief heute über die alte brücke mit einigen freunden".split()}
    rows, near = [], 0
    for k in range(24):
        lang = ("en", "de")[k % 2]
        text = [rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(60)]
        rows.append((10 * k, " ".join(text), lang, "s" + str(k % 3)))
        if k % 3 == 0:
            rows.append((10 * k + 1, "  ".join(text), lang, "s0"))
        for j in range(2, 2 + k % 4):
            at = 3 + 2 * j
            changed = list(text)
            for x in range(j - 1):
                changed[at + 12 * x] = f"new{k}{j}{x}"
            rows.append((10 * k + j, " ".join(changed), lang, "s1"))
            near += 1
    rows += [(1000, None, "en", "s0"), (1001, "123 --- 456", "en", "s0"), (1002, "", "de", "s1")]
    docs, kept = docs_of(rows), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
        if k == 0:
            model = langid.fit(before)
            assert {r.doc_id for r in kept[0]} == {i for i, t, *_ in rows if not model.best(t)[2]}
            assert not {r.doc_id for r in kept[0]} & {1000, 1001, 1002} and len(kept[0]) > 40
    groups = defaultdict(list)
    for r in kept[0]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in kept[1]} == {min(g)[1] for g in groups.values()} and len(kept[1]) < len(kept[0])
    want = brute_near({r.doc_id: r.text for r in kept[1]})
    assert sorted(r.doc_id for r in kept[2]) == sorted(want) and 24 <= len(want) < len(kept[1])
    whole = {r.doc_id: r.text.split() for r in kept[2]}
    drawn, parts = defaultdict(Counter), 0
    for r in kept[3]:
        took = r.text.split()
        assert took == whole[r.doc_id][: len(took)]
        parts += len(took) < len(whole[r.doc_id])
        drawn[r.doc_id][len(took) == len(whole[r.doc_id])] += 1
    assert set(drawn) <= set(whole) and parts <= len({r.source for r in kept[2]})
    expected = Counter()
    for r in kept[3]:
        expected.update((r.doc_id, int(x)) for x in packing.ids(r.text))
    packed = Counter()
    for r in kept[4]:
        packed.update((r.doc_id, int(x)) for x in np.frombuffer(r.ids, "<u4"))
    assert packed == expected
