"""Packing documents into training sequences, neighbours along a space-filling curve together."""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_arrow, narrow_arrow, schema

SEQUENCE = 2048
#: Follows the ids of each document.
END = 1
#: The vocabulary, by the name under which the installed tokenizer files are found: as ranks, and for texts that the fast encoder can't take.
RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Runs of blanks on which the fast encoder's pattern would overflow its stack (from somewhere above 300,000).
BLANKS = re.compile(r"\s{100000}")
#: Hashed dimensions of a document's vector, dimensions that it is projected to, and bits of each on the curve.
HASHED, PROJECTED, BITS = 64, 4, 12
#: Bits of a hash that follow the curve's key, so that documents alike can be parted.
TIE = 15
#: Documents that the ranges' bounds are read from, at least; characters of a range, about, up to so many ranges. Above that the
#: ranges grow; a task sorts its range on disk and packs it row by row. The driver holds 16 bytes for each of 20 documents a range.
SAMPLE, RANGE, RANGES = 20_000, 16 << 20, 50_000
#: A range of so many sequences ends in one that is padded; a shorter one in sequences of powers of two.
LONG = 128


@cache
def fast_encoder(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(END, *table.values()) >= 1 << 16:
        raise ValueError(f"{ranks}: ids are held in 16 bits")
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def slow_ids(text: str, vocabulary: str) -> list[int]:
    """The ids by the other library. It is loaded for the text alone, as a worker would keep its 100 MB."""
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    slow.encode_special_tokens = True
    return slow.encode(text, add_special_tokens=False).ids


def ids(text: str | None, ranks: str = RANKS, vocabulary: str = VOCABULARY) -> np.ndarray:
    """A text's ids as 16-bit numbers, and END. Names of special tokens in a text are text, as the vocabulary's guide asks for."""
    if text and BLANKS.search(text):
        found = np.array(slow_ids(text, vocabulary), np.int64)
        if len(found) and found.max() >= 1 << 16:
            raise ValueError(f"{vocabulary}: ids are held in 16 bits")
    else:
        found = fast_encoder(ranks).encode_to_numpy(text or "", disallowed_special=())
    return np.append(found, END).astype(np.uint16)


@cache
def projection() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per id its bucket and sign, and the matrix that projects the buckets."""
    draw = np.random.default_rng(20240229)
    return draw.integers(0, HASHED, 1 << 16), draw.choice([-1.0, 1.0], 1 << 16), draw.standard_normal((HASHED, PROJECTED))


def cell(tokens: np.ndarray) -> np.ndarray:
    """Cell of a document on the grid: its hashed vector of unit length, projected, each value by its rank in the normal distribution."""
    bucket, sign, matrix = projection()
    v = np.bincount(bucket[tokens], weights=sign[tokens], minlength=HASHED)
    z = (v / max(np.linalg.norm(v), 1e-12)) @ matrix
    return np.array([min((1 << BITS) - 1, int(0.5 * (1 + math.erf(x / math.sqrt(2))) * (1 << BITS))) for x in z], np.int64)


def hilbert(cells: np.ndarray) -> np.ndarray:
    """Position of each row of ``cells`` along the Hilbert curve.

    From the highest bit down, the axes are exchanged or turned as the curve's copy in that sub-cube lies; then the
    Gray code over all axes is undone and the bits are interleaved.
    """
    x = cells.T.copy()
    n = len(x)
    for b in range(BITS - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            set_ = (x[i] >> b & 1).astype(bool)
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(set_, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(BITS - 1, 0, -1):
        turn = np.where(x[-1] >> b & 1, turn ^ ((1 << b) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(tokens: list[np.ndarray], ties: np.ndarray) -> np.ndarray:
    cells = np.stack([cell(t) for t in tokens]) if tokens else np.zeros((0, PROJECTED), np.int64)
    return hilbert(cells) << TIE | (ties & ((1 << TIE) - 1))


def bounds(docs: DataFrame) -> np.ndarray:
    """Keys at which the ranges begin, from a sample of whole documents that a hash picks; a range has about RANGE characters."""
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()
    ranges = min(RANGES, max(1, math.ceil(chars / RANGE)))
    rate = min(1.0, max(SAMPLE, 20 * ranges) / max(n, 1))
    drawn = docs.where(F.pmod(F.xxhash64("_tie"), F.lit(1 << 20)) < rate * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [ids(t) for t in b.column(0).to_pylist()]
            keys = curve_keys(tokens, b.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([len(t) for t in tokens], pa.int64())], names=["key", "n"])

    rows = map_arrow(drawn.select("text", "_tie"), run, schema(("key", "long"), ("n", "long"))).toArrow()  # 16 bytes each
    keys, sizes = rows["key"].to_numpy(), rows["n"].to_numpy()
    by = np.lexsort((sizes, keys))
    keys, ends = keys[by], np.cumsum(sizes[by])
    if not len(keys):
        return keys
    return np.unique(keys[np.searchsorted(ends, ends[-1] * np.arange(1, ranges) / ranges)])


def pack(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Each document is its text's ids and END. Documents are ordered along a Hilbert curve through their projected
    vectors, in ranges of about equal size, and each range is one stream that is cut every SEQUENCE ids. What remains
    at its end is one sequence, to be padded, where that is under one part in LONG; in a shorter range it is cut into
    sequences of powers of two, which need no padding. A document may lie in several
    sequences. Texts that are null or empty have END alone. Rows alike, or of the same id, are documents of their own.
    An empty table gives an empty result; other columns are not read.
    """
    narrow_arrow(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("doc_id", "text"))
    begins = bounds(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [ids(t) for t in b.column(1).to_pylist()]
            keys = curve_keys(tokens, b.column(2).to_numpy(zero_copy_only=False))
            part = np.searchsorted(begins, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(keys), b.column(0), b.column(2), pa.array([t.astype("<u2").tobytes() for t in tokens], pa.binary())], names=["part", "key", "doc_id", "tie", "ids"])

    coded = map_arrow(docs, encode, schema(("part", "int"), ("key", "long"), ("doc_id", kind), ("tie", "long"), ("ids", "binary")))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    out = schema(("doc_id", kind), *[(c, "long") for c in names[1:7]], *[("ids", "binary")] * with_ids)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (id, start, ids, tokens of the document) of the open sequence
        full, part, n = 0, None, 0

        def batch(done: list[tuple]) -> pa.RecordBatch:
            raw = [p[2].astype("<u4").tobytes() for p in done]
            cols = [pa.array([p[0] for p in done], id_type), *(pa.array([f(p) for p in done], pa.int64()) for f in (lambda p: p[1], lambda p: len(p[2])))]
            cols += [pa.array([zlib.crc32(r) for r in raw], pa.int64()), *(pa.array([p[k] for p in done], pa.int64()) for k in (3, 4, 5))]
            return pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids, names=names)

        def close(size: int) -> list[tuple]:
            """The first ``size`` ids of the open sequence as a sequence; the rest stays open."""
            nonlocal held, full, n
            done, rest, at = [], [], 0
            for i, start, t, total in held:
                take = min(len(t), max(0, size - at))
                if take:
                    done.append((i, start, t[:take], total, (part or 0) << 32 | n, at))
                    at += take
                if take < len(t):
                    rest.append((i, start + take, t[take:], total))
            held, full, n = rest, full - size, n + 1
            return done

        id_type = None
        for b in batches:
            id_type, done = b.column(2).type, []
            for k in range(b.num_rows):
                if part is None:
                    part = b.column(0)[k].as_py()
                i, t = b.column(2)[k].as_py(), np.frombuffer(b.column(4)[k].as_py(), "<u2")
                total, at = len(t), 0
                while full + len(t) - at >= SEQUENCE:
                    held.append((i, at, t[at : at + SEQUENCE - full], total))
                    at, full = at + SEQUENCE - full, SEQUENCE
                    done += close(SEQUENCE)
                if at < len(t):
                    held.append((i, at, t[at:], total))
                    full += len(t) - at
                if len(done) >= 512:
                    yield batch(done)
                    done = []
            if done:
                yield batch(done)
        done = []
        if n >= LONG:
            done += close(full)
        for bit in range(SEQUENCE.bit_length() - 1, -1, -1):
            if full >> bit & 1:
                done += close(1 << bit)
        if done:
            yield batch(done)

    ranged = coded.repartitionById(len(begins) + 1, "part").sortWithinPartitions("key", "doc_id", "tie")
    return map_arrow(ranged, fill, out)
