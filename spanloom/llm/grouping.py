"""Best-fit packing by linear grouping: few rounded lengths, optimal configurations of them, documents in their slots, small ones best-fit."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.llm.common import checkpoint, map_arrow, narrow_arrow, running_sum, schema

SEQUENCE = 2048
#: Follows the ids of each document.
END = 0
#: The vocabulary, by the name under which the installed tokenizer files are found.
VOCABULARY = "word_bpe_49k.json"
#: Longest small piece: of larger ones no three fit a sequence. Groups of larger pieces, of equal cardinality.
SMALL, GROUPS = SEQUENCE // 3, 256
#: The linear program ends within this share of its optimum, or after so many steps: what is found by then is a packing, if not the best one.
GAP, STEPS = 2e-4, 2_000
#: Chunks and words whose ids a worker keeps, and their length at most.
CHUNKS_KEPT, WORDS_KEPT, LONGEST = 1 << 19, 1 << 19, 64

#: Where the vocabulary's pattern always cuts, so that what lies between has ids of its own.
BETWEEN = re.compile("[ \t\r\n]+")
#: Printable characters that normalise to themselves, and what the vocabulary's pattern cuts them into once lower-cased.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: On these the short way has to agree with the library's whole one.
PROBES = ("We're", "don't!", "IT'S", "x2048--y", "(Straße,", "ÀÉÎÕÜ", "'tis", "<|endoftext|>", "a_b", "''s", "http://e.net/?q=1", "ÿþ÷×")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Ids(dict):
    """The ids of a chunk between blanks, as little-endian 32-bit numbers; what was asked for before is kept.

    A chunk of plain characters is cut into words here, and only words not seen before go to the library's model; any
    other chunk goes through the whole library.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters, self.words = self.tokenizer.model, byte_letters(), {}
        if self.whole(" a b\tc.\r\nd ") != b"".join(map(self.whole, ("a", "b", "c.", "d"))):
            raise ValueError(f"{vocabulary}: ids of words must not depend on the blanks between them")
        self.short = all(b"".join(map(self.word, WORDS.findall(x.lower()))) == self.whole(x) for x in PROBES)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            shown = word if word.isascii() else word.encode().decode("latin1").translate(self.letters)
            numbers = [t.id for t in self.model.tokenize(shown)]
            found = struct.pack(f"<{len(numbers)}I", *numbers)
            keep(self.words, word, found, WORDS_KEPT)
        return found

    def __missing__(self, chunk: str) -> bytes:
        if not (self.short and PLAIN.fullmatch(chunk)):
            found = self.whole(chunk)
        elif chunk.isalpha():
            found = self.word(chunk.lower())
        else:
            found = b"".join(map(self.word, WORDS.findall(chunk.lower())))
        keep(self, chunk, found, CHUNKS_KEPT)
        return found


def keep(known: dict, key: str, value: bytes, most: int) -> None:
    if len(key) <= LONGEST:
        if len(known) >= most:
            known.clear()
        known[key] = value


@cache
def known(vocabulary: str) -> Ids:
    return Ids(vocabulary)


def ids(text: str | None, vocabulary: str = VOCABULARY) -> bytes:
    """A text's ids and END, four bytes each. Names of special tokens in a text are text, as the vocabulary's guide asks for."""
    return b"".join(map(known(vocabulary).__getitem__, BETWEEN.split(text or ""))) + END.to_bytes(4, "little")


def fullest(sizes: list[int], values: list[float], most: list[int], room: int) -> list[int]:
    """How often to take each size so that the values add up to the most in ``room``; none oftener than ``most``."""
    best = np.zeros(room + 1)
    taken = []
    for t, (size, value) in enumerate(zip(sizes, values, strict=True)):
        if value > 0:
            for _ in range(min(most[t], room // size)):
                with_ = best[: room + 1 - size] + value
                better = with_ > best[size:] + 1e-12
                if not better.any():
                    break
                best[size:][better] = with_[better]
                taken.append((t, size, better))
    counts, at = [0] * len(sizes), room
    for t, size, better in reversed(taken):
        if at >= size and better[at - size]:
            counts[t] += 1
            at -= size
    return counts


def linear_program(sizes: list[int], demands: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Configurations, one in each column, and how often the linear program takes each: the fewest sequences that meet the demands.

    Columns are generated: the sizes' prices under the present ones price every other, and the best is a knapsack.
    """
    times = partial(np.einsum, "ij,jk->ik")  # small, and the driver's threads are Spark's
    n, need = len(sizes), np.array(demands, float)
    need *= 1 + 1e-6 * np.random.default_rng(0).random(n)  # no two ways to meet them are alike, so that no step is in vain
    columns = np.diag([min(SEQUENCE // s, d) for s, d in zip(sizes, demands, strict=True)]).astype(float)
    cost, inverse = np.ones(n), np.diag(1 / columns.diagonal())
    for k in range(1, STEPS + 1):
        if k % 64 == 0:
            inverse = 2 * inverse - times(inverse, times(columns, inverse))  # Newton's step takes out what rounding has added up
        amount, price = inverse @ need, cost @ inverse
        over = int(price.argmin())
        if price[over] < -1e-9:  # more than is asked for
            column, gain = -np.eye(n)[over], 0.0
        else:
            column = np.array(fullest(sizes, price.tolist(), demands, SEQUENCE), float)
            gain = 1.0
            if price @ column <= 1 + GAP:  # all prices over this sum are a lower bound
                break
        step = inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(ratio.argmin())
        columns[:, leaves], cost[leaves] = column, gain
        row = inverse[leaves] / step[leaves]
        inverse -= np.outer(step, row)
        inverse[leaves] = row
    amount, real = inverse @ need, cost > 0
    return columns[:, real], amount[real]


def configurations(sizes: list[int], demands: list[int]) -> list[tuple[list[int], int]]:
    """(how many of each size, how many sequences alike) that hold all demands: the linear program's whole numbers, then sequence by sequence what is left."""
    out: dict[tuple, int] = defaultdict(int)
    left = list(demands)
    if sum(demands) > len(sizes):
        columns, amount = linear_program(sizes, demands)
        for column, x in zip(columns.T.round().astype(int).tolist(), np.floor(amount + 1e-6).astype(int).tolist(), strict=True):
            times = min([x, *(left[t] // a for t, a in enumerate(column) if a > 0)])
            if times > 0:
                out[tuple(column)] += times
                left = [n - times * a for n, a in zip(left, column, strict=True)]
    while any(left):
        first = next(t for t, n in enumerate(left) if n)  # sizes fall: the largest that is left, and what fills its sequence best
        left[first] -= 1
        counts = fullest(sizes, [float(s) for s in sizes], left, SEQUENCE - sizes[first])
        left = [n - a for n, a in zip(left, counts, strict=True)]
        counts[first] += 1
        out[tuple(counts)] += 1
    return [(list(c), n) for c, n in out.items()]


class Slots:
    """Where the pieces of each length go, from the number of pieces by length: the n-th of a length to a sequence."""

    def __init__(self, counts: dict[int, int], groups: int = GROUPS):
        falling = sorted(counts, reverse=True)
        self.before, total = {}, 0
        for length in falling:
            self.before[length] = total
            total += counts[length]
        card = max(1, -(-total // groups))
        self.begins, self.sizes = [], []  # groups of one size are one
        for at in range(0, total, card):
            size = next(length for length in reversed(falling) if self.before[length] <= at)
            if not self.sizes or self.sizes[-1] != size:
                self.begins.append(at)
                self.sizes.append(size)
        demands = np.diff([*self.begins, total]).tolist()
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in self.sizes]  # by size: first place, places a sequence, first sequence
        self.n = 0
        filled = [0] * len(self.sizes)
        for config, times in configurations(self.sizes, demands) if total else []:
            for t, a in enumerate(config):
                if a:
                    self.runs[t].append((filled[t], a, self.n))
                    filled[t] += a * times
            self.n += times

    def sequences(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.array([self.before[x] for x in length.tolist()], np.int64) + rank
        size = np.searchsorted(self.begins, at, side="right") - 1
        out = np.empty(len(at), np.int64)
        for t in np.unique(size).tolist():
            mine = size == t
            place = at[mine] - self.begins[t]
            first, each, sequence = np.array(self.runs[t], np.int64).T
            run = np.searchsorted(first, place, side="right") - 1
            out[mine] = sequence[run] + (place - first[run]) // each[run]
        return out


class Gaps:
    """Best fit of small pieces, by the number of pieces of each length and of sequences of each room: longest first, each where least room is left.

    A run of sequences alike is dealt with at once. Where nothing fits, sequences are opened, whose room is named -1.
    """

    def __init__(self, counts: dict[int, int], rooms: dict[int, int]):
        held = defaultdict(list, {room: [(room, 0, n)] for room, n in rooms.items() if room > 0})
        order = sorted(held)
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # by length: first piece, pieces a sequence, room, first sequence of that room
        self.opened = 0
        for length in sorted(counts, reverse=True):
            done, m = 0, counts[length]
            while done < m:
                k = bisect_left(order, length)
                if k == len(order):
                    n = -(-(m - done) // (SEQUENCE // length))
                    held[SEQUENCE].append((-1, self.opened, self.opened + n))
                    order.append(SEQUENCE)
                    self.opened += n
                    continue
                room = order[k]
                name, begin, end = held[room].pop()
                if not held[room]:
                    order.pop(k)
                each = min(room // length, m - done)
                n = min(end - begin, (m - done) // each)
                self.runs[length].append((done, each, name, begin))
                done += n * each
                for rest, a, b in ((room - each * length, begin, begin + n), (room, begin + n, end)):
                    if a < b and rest:
                        if not held[rest]:
                            insort(order, rest)
                        held[rest].append((name, a, b))

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(room, number among the sequences of that room) of the sequence of each piece."""
        name, number = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x in np.unique(length).tolist():
            mine = length == x
            first, each, room, sequence = np.array(self.runs[x], np.int64).T
            run = np.searchsorted(first, rank[mine], side="right") - 1
            name[mine] = room[run]
            number[mine] = sequence[run] + (rank[mine] - first[run]) // each[run]
        return name, number


def pieces_of(docs: DataFrame, vocabulary: str, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row) of every document's pieces, and their ids."""
    narrow_arrow(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, piece, raws = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                raw = ids(text, vocabulary)
                for k in range(0, len(raw), 4 * SEQUENCE):
                    at.append(i)
                    piece.append(k // (4 * SEQUENCE))
                    raws.append(raw[k : k + 4 * SEQUENCE])
            part = np.array(piece, np.int64)
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(part.astype(np.int32)), pa.array(part * SEQUENCE), pa.array([len(r) // 4 for r in raws], pa.int64()), pa.array([zlib.crc32(r) for r in raws], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raws, pa.binary())] * with_ids, names=names)

    kind = docs.schema["doc_id"].dataType
    out = schema(("doc_id", kind), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), *[("ids", "binary")] * with_ids)
    return checkpoint(map_arrow(docs.select("doc_id", "text"), run, out).withColumn("row", F.monotonically_increasing_id()))


def ranked(df: DataFrame, part: str, row: str) -> DataFrame:
    """``df`` with ``rank``: a number for each row among those alike in ``part``, from 0, in an order that a hash gives."""
    return running_sum(checkpoint(df.withColumn("_h", F.xxhash64(row)).withColumn("_one", F.lit(1))), [part], ["_h", row], "_one", "rank").drop("_h", "_one")


def pack_grouped(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """Pieces of documents in as few sequences as the method finds: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Each document is its text's ids and END; a longer one than SEQUENCE is cut there, and its full pieces are sequences
    of their own. Of the other pieces those over ``small`` are ordered by length and cut into ``groups`` of equal
    cardinality, whose lengths count as the group's largest. For so few sizes a linear program over configurations
    gives how many sequences hold what, rounded down; what is left is filled sequence by sequence. The groups' pieces
    take the slots, and small pieces go, longest first, into the sequence whose actual room they fit best.

    Only numbers of pieces by length and of sequences by room, at most SEQUENCE of each, reach the driver. The n-th
    piece of a length finds its sequence in a table of runs; where it stands in it is a window over one sequence.

    Null and empty texts have END alone. Rows alike, or of one id or none, are documents of their own. Other columns are
    not read. An empty table gives an empty result. Numbers of sequences are arbitrary.
    """
    spark = docs.sparkSession
    pieces = pieces_of(docs, vocabulary, with_ids)
    slim = pieces.drop("ids")
    counts = {r["length"]: r["n"] for r in slim.groupBy("length").agg(F.count("*").alias("n")).collect()}  # SEQUENCE rows at most
    full = slim.where(F.col("length") == SEQUENCE).withColumn("sequence_id", 2 * F.col("row") + 1)
    cut = checkpoint(ranked(slim.where(F.col("length") < SEQUENCE), "length", "row"))
    slots = Slots({k: n for k, n in counts.items() if small < k < SEQUENCE}, groups)
    held = spark.sparkContext.broadcast(slots)  # a few runs for each group and configuration

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.sequences(length, rank))], names=[*b.schema.names, "bin"])

    fields = [*slim.schema.fields, *schema(("rank", "long"), ("bin", "long")).fields]
    kind = type(schema())
    large = checkpoint(map_arrow(cut.where(F.col("length") > small).select(*slim.columns, "rank"), fill, kind(fields)))
    bins = large.groupBy("bin").agg((SEQUENCE - F.sum("length")).alias("room")).where("room > 0")
    bins = checkpoint(ranked(bins, "room", "bin"))
    rooms = {r["room"]: r["n"] for r in bins.groupBy("room").agg(F.count("*").alias("n")).collect()}  # SEQUENCE rows at most
    gaps = Gaps({k: n for k, n in counts.items() if k <= small and k < SEQUENCE}, rooms)
    fits = spark.sparkContext.broadcast(gaps)  # runs of sequences alike

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
            room, number = fits.value.places(length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(room), pa.array(number)], names=[*b.schema.names, "room", "number"])

    fields = [*slim.schema.fields, *schema(("rank", "long"), ("room", "long"), ("number", "long")).fields]
    little = checkpoint(map_arrow(cut.where(F.col("length") <= small).select(*slim.columns, "rank"), fit, kind(fields)))
    known_bins = bins.select("room", F.col("rank").alias("number"), "bin")
    in_gaps = little.where("room >= 0").join(known_bins, ["room", "number"]).select(*slim.columns, "bin")
    opened = little.where("room < 0").select(*slim.columns, (F.col("number") + slots.n).alias("bin"))
    placed = large.select(*slim.columns, "bin").unionByName(in_gaps).unionByName(opened)
    # a sequence's pieces, SEQUENCE at most
    order = W.Window.partitionBy("bin").orderBy(F.col("length").desc(), "row").rowsBetween(W.Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).withColumn("sequence_id", 2 * F.col("bin")).drop("bin")
    out = placed.unionByName(full.withColumn("offset", F.lit(0).cast("long")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.join(pieces.select("row", "ids"), "row").select(*names, "ids") if with_ids else out.select(*names)
