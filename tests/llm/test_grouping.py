"""Grouped packing: exact ids and places, and how near the bound it comes."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from spanloom.llm import grouping


def plain(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(plain, "tokenizer"):
        plain.tokenizer = Tokenizer.from_file(public_tokenizers.path(grouping.VOCABULARY))
        plain.tokenizer.encode_special_tokens = True
    return np.array([*plain.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


TEXTS = [
    None, "", " \n\t", "Hello, WORLD!", "it's they'RE we'll 'tis I'd", "a1b22 3.14", "<|endoftext|> <|startoftext|>x", "ÀÉÎ straße ÿ µ×÷ª", "İstanbul ΣΑΣ ǅ", "éå", " a b　c\x1cd\x85e",
    "日本語 тест мир", "😀👍🏽 x‍y", "x" * 5000, "a\x00b\x7f", "''s''t", "퟿", "tab\tand\r\nlines", "http://e.net/?q=a%20b#c", "ﬁ ﬂ ½ ²", "__a__--b''",
]


def test_ids_are_the_plain_ones():
    assert grouping.known(grouping.VOCABULARY).short
    for t in TEXTS:
        assert grouping.ids(t) == plain(t).tobytes(), t
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x250), rng.randrange(0x300, 0x370), rng.choice([32, 10, 39, 39, 0xA0, 0x3A3, 0x130])])) for _ in range(rng.randint(1, 12)))
        assert grouping.ids(t) == plain(t).tobytes(), t


def test_kept_ids_are_bounded(monkeypatch):
    monkeypatch.setattr(grouping, "CHUNKS_KEPT", 10)
    monkeypatch.setattr(grouping, "WORDS_KEPT", 20)
    known = grouping.Ids(grouping.VOCABULARY)
    text = " ".join(f"w{k} Wx{chr(97 + k % 26) * k}!" for k in range(100))
    assert b"".join(known[c] for c in text.split()) == plain(text).tobytes()[:-4]
    assert len(known) <= 10 and len(known.words) <= 20


def held_well(rows, texts):
    """Every id in exactly one piece, sequences gapless and no longer than they may be."""
    found, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in texts:
        v = plain(t)
        want[i] += [(k // 2048, k, len(v[k : k + 2048]), zlib.crc32(v[k : k + 2048].tobytes())) for k in range(0, len(v), 2048)]
    assert {i: sorted(p) for i, p in found.items()} == {i: sorted(p) for i, p in want.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), sum(r.length for r in rows)


def best_fit(lengths):
    """Sequences that pieces one by one take, longest first."""
    left = []
    for n in sorted(lengths, reverse=True):
        fit = min((k for k, r in enumerate(left) if r >= n), key=left.__getitem__, default=None)
        if fit is None:
            left.append(2048 - n)
        else:
            left[fit] -= n
    return len(left)


@pytest.mark.parametrize(("groups", "small", "most"), [(256, 682, 1.02), (128, 256, 1.02), (5, 682, 1.1)])
def test_pack(docs_of, odd_rows, groups, small, most):
    rng = random.Random(7)
    many = [(100 + k, " ".join("abc def ghi jkl mno".split()[rng.randrange(5)] for _ in range(rng.choice([3, 40, 200, rng.randint(1, 1500), 2500]))), "en", "s") for k in range(400)]
    rows = [*odd_rows, *many, many[0], (None, "x", None, None)]
    got = grouping.pack_grouped(docs_of(rows), groups=groups, small=small).collect()
    n, _ = held_well(got, [(r[0], r[1]) for r in rows])
    assert n <= most * best_fit([r.length for r in got])


def test_pack_with_ids(docs_of):
    rows = [(k, "a b c " * (k * 40), None, None) for k in range(60)]
    got = grouping.pack_grouped(docs_of(rows), with_ids=True).collect()
    held_well(got, [(r[0], r[1]) for r in rows])
    assert all(zlib.crc32(r["ids"]) == r.ids_crc32 and len(r["ids"]) == 4 * r.length for r in got)


def test_pack_of_one_kind(docs_of):
    """Nothing, only empty texts, only full pieces, only large ones, only small ones."""
    assert grouping.pack_grouped(docs_of([])).collect() == []
    for text, n, most in (("", 5000, 3), ("a " * 2047, 7, 7), ("a " * 1023, 9, 5), ("a " * 681, 9, 3), ("a " * 99, 41, 3)):
        rows = [(k, text, None, None) for k in range(n)]
        assert held_well(grouping.pack_grouped(docs_of(rows)).collect(), [(r[0], r[1]) for r in rows])[0] == most


def test_configurations_meet_demands_in_few_sequences():
    for seed in range(6):
        rng = random.Random(seed)
        sizes = sorted(rng.sample(range(257, 2048), rng.choice([1, 3, 20, 60])), reverse=True)
        demands = [rng.choice([1, 2, 50, 3000]) for _ in sizes]
        got = grouping.configurations(sizes, demands)
        assert all(sum(s * a for s, a in zip(sizes, c, strict=True)) <= 2048 for c, _ in got)
        assert [sum(c[t] * n for c, n in got) for t in range(len(sizes))] == demands
        _, amount = grouping.linear_program(sizes, demands)
        assert sum(n for _, n in got) <= amount.sum() * 1.001 + len(sizes) + 1


def test_fullest():
    assert grouping.fullest([5, 3], [5.0, 3.0], [9, 9], 11) == [1, 2]
    assert grouping.fullest([5, 3], [5.0, 3.0], [9, 1], 11) == [2, 0]
    assert grouping.fullest([5], [0.0], [9], 11) == [0] and grouping.fullest([], [], [], 4) == []


def test_gaps_are_best_fit():
    """Length by length against sequences kept one by one."""
    for seed in range(8):
        rng = random.Random(seed)
        counts = {rng.randint(1, 256): rng.choice([1, 2, 30]) for _ in range(40)}
        rooms = {rng.randint(1, 700): rng.randint(1, 9) for _ in range(30)}
        gaps = grouping.Gaps(counts, rooms)
        left = sorted(r for r, n in rooms.items() for _ in range(n))
        opened = 0
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = next((k for k, r in enumerate(left) if r >= length), None)
                if fit is None:
                    left.append(2048)
                    opened, fit = opened + 1, len(left) - 1
                left[fit] -= length
                left.sort()
        used = defaultdict(int)
        for length, n in counts.items():
            for name, number in zip(*(x.tolist() for x in gaps.places(np.full(n, length), np.arange(n))), strict=True):
                used[name, number] += length
        assert gaps.opened == opened
        assert all(total <= (2048 if name < 0 else name) for (name, _), total in used.items())
        got = sorted([name - used.get((name, k), 0) for name, n in rooms.items() for k in range(n)] + [2048 - used[-1, k] for k in range(opened)])
        assert got == left
