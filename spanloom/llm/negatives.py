"""Hard negatives by dual-tree search: intervals of inner products prune whole groups of anchors at once."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from spanloom.llm.codes import SCALE, whole_rows
from spanloom.llm.common import checkpoint, map_arrow, schema

#: Rows of a cell, about, up to so many cells; beyond, cells grow. Rows that the cells are cut by, a bounded sample that a hash draws.
CELL, CELLS, SAMPLE = 4096, 4096, 16_384
#: Rows of a block, about: larger cells are dealt to several. Anchors of a group, about.
BLOCK, GROUP = 32_768, 256
#: Rows of a leaf of the trees within a block and within a group.
CANDIDATES, ANCHORS = 256, 32
#: No score is beyond it.
FAR = 1 << 62
#: What rounding may take from a bound, as a share of the numbers that it is made from.
ROOM = 1e-9


def parted(x: np.ndarray, least: int) -> tuple[np.ndarray, float, np.ndarray] | None:
    """(direction, threshold, which rows are not above it): a cut halfway between two rows far apart, or at the median where that
    leaves a side with less than one part in ``least``. None if the rows are alike."""
    far = x[((x - x[0]) ** 2).sum(axis=1).argmax()]
    direction = x[((x - far) ** 2).sum(axis=1).argmax()] - far
    along = x @ direction
    lowest, highest = along.min(), along.max()
    for at in ((lowest + highest) / 2, np.sort(along)[(len(x) - 1) // 2]):
        at = min(at, np.nextafter(highest, -np.inf))
        low = along <= at
        n = int(low.sum())
        if min(n, len(x) - n) * least >= len(x):
            break
    return None if low.all() or not low.any() else (direction, at, low)


class Tree:
    """A ball tree over rows, or over balls around them: nodes are runs of ``order``, each with its centre and a radius that is rounded up."""

    def __init__(self, x: np.ndarray, leaf: int, radii: np.ndarray | None = None, labels: np.ndarray | None = None):
        self.order = np.arange(len(x))
        self.begin, self.end, self.centre, self.radius, self.children = [], [], [], [], []
        self._build(x.astype(np.float64), leaf, np.zeros(len(x)) if radii is None else radii, 0, len(x))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        if labels is not None:
            held = labels[self.order]
            self.lowest, self.highest = (np.array([f(held[b:e]) for b, e in zip(self.begin, self.end, strict=True)]) for f in (np.min, np.max))

    def _build(self, x: np.ndarray, leaf: int, radii: np.ndarray, begin: int, end: int) -> int:
        at, node = self.order[begin:end], len(self.begin)
        rows = x[at]
        centre = rows.mean(axis=0)
        radius = float((np.sqrt(((rows - centre) ** 2).sum(axis=1)) + radii[at]).max())
        for held, value in ((self.begin, begin), (self.end, end), (self.centre, centre), (self.radius, radius * (1 + ROOM) + ROOM), (self.children, None)):
            held.append(value)
        found = parted(rows, 16) if end - begin > leaf else None
        if found is not None:
            low = found[2]
            half = begin + int(low.sum())
            self.order[begin:end] = np.concatenate([at[low], at[~low]])
            self.children[node] = (self._build(x, leaf, radii, begin, half), self._build(x, leaf, radii, half, end))
        return node


def interval(a: np.ndarray, na: float, ra: float, b: np.ndarray, nb: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of a point of a ball with one of each of other balls (centre, its norm, radius)."""
    middle = b @ a
    slack = na * rb + nb * ra + ra * rb + ROOM * (na + ra) * (nb + rb) + ROOM
    return middle - slack, middle + slack


class Asks:
    """What a group's anchors ask for: the first ``k`` candidates of scores ``low`` to ``high``, of the anchor's label or of others.

    An anchor has any number of asks, one after another; ``low`` rises as candidates are found. Candidates that tie with
    the last one found stay open until their ids decide.
    """

    def __init__(self, row: np.ndarray, label: np.ndarray, x: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.tree = Tree(x, ANCHORS, labels=label)
        order = self.tree.order
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ask = np.argsort(place[owner], kind="stable")
        self.row, self.label, self.x = row[order], label[order], x[order]
        self.owner, self.low, self.high = place[owner][self.ask], low[self.ask].copy(), high[self.ask]
        self.starts = np.searchsorted(self.owner, np.arange(len(order) + 1))
        self.k, self.same = k, same
        self.found = [np.zeros(0, np.int64)] * 4  # ask, score, rank, candidate

    def span(self, node: int) -> slice:
        return slice(self.starts[self.tree.begin[node]], self.starts[self.tree.end[node]])

    def bounds(self, node: int) -> tuple[int, int]:
        at = self.span(node)
        return (int(self.low[at].min()), int(self.high[at].max())) if at.stop > at.start else (FAR, -FAR)

    def add(self, ask: np.ndarray, score: np.ndarray, rank: np.ndarray, candidate: np.ndarray) -> None:
        """Keep the first ``k`` of each ask; of those alike in score, by ``rank``."""
        if not len(ask):
            return
        mine = np.isin(self.found[0], ask)
        all_ = [np.concatenate([f[mine], new]) for f, new in zip(self.found, (ask, score, rank, candidate), strict=True)]
        by = np.lexsort((all_[2], -all_[1], all_[0]))
        all_ = [f[by] for f in all_]
        first = np.searchsorted(all_[0], all_[0])
        nth = np.arange(len(by)) - first
        last = nth == self.k - 1
        self.low[all_[0][last]] = np.maximum(self.low[all_[0][last]], all_[1][last])
        self.found = [np.concatenate([f[~mine], new[nth < self.k]]) for f, new in zip(self.found, all_, strict=True)]


class Block:
    """Candidates and the tree over them."""

    def __init__(self, row: np.ndarray, label: np.ndarray, x: np.ndarray, ids: pa.Array):
        self.tree = Tree(x, CANDIDATES, labels=label)
        order = self.tree.order
        self.row, self.label, self.x, self.ids = row[order], label[order], x[order], ids.take(pa.array(order))
        self.rank = np.empty(len(order), np.int64)
        self.rank[pc.sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(len(order))
        self.peak = float(np.abs(x).max()) if x.size else 0.0

    def search(self, asks: Asks) -> None:
        """Pairs of nodes in the order of the scores that they may hold; a pair whose interval meets no ask of its anchors is dropped."""
        a, c = asks.tree, self.tree

        def offer(i: int, nodes: list[int]) -> None:
            low, high = interval(a.centre[i], a.norm[i], a.radius[i], c.centre[nodes], c.norm[nodes], c.radius[nodes])
            for node, x, y in zip(nodes, low, high, strict=True):
                heapq.heappush(heap, (-y, x, i, node))

        heap: list[tuple] = []
        offer(0, [0])
        exact = self.peak * (float(np.abs(asks.x).max()) if asks.x.size else 0) * max(1, self.x.shape[1]) < 1 << 53
        mine, theirs = (asks.x.astype(np.float64), self.x.astype(np.float64)) if exact else (asks.x, self.x)
        while heap:
            high, low, i, j = heapq.heappop(heap)
            least, most = asks.bounds(i)
            if -high < least or low > most:
                continue
            if asks.same and (a.highest[i] < c.lowest[j] or a.lowest[i] > c.highest[j]):
                continue
            if not asks.same and a.lowest[i] == a.highest[i] == c.lowest[j] == c.highest[j]:
                continue
            if c.children[j] and (not a.children[i] or c.radius[j] >= a.radius[i]):
                offer(i, list(c.children[j]))
            elif a.children[i]:
                for child in a.children[i]:
                    offer(child, [j])
            else:
                at, rows, span = slice(c.begin[j], c.end[j]), slice(a.begin[i], a.end[i]), asks.span(i)
                score = (mine[rows] @ theirs[at].T).astype(np.int64)
                open_ = (asks.label[rows, None] == self.label[None, at]) == asks.same
                open_ &= asks.row[rows, None] != self.row[None, at]
                owner = asks.owner[span] - a.begin[i]
                hit = open_[owner] & (score[owner] >= asks.low[span, None]) & (score[owner] <= asks.high[span, None])
                n, m = np.nonzero(hit)
                asks.add(n + span.start, score[owner[n], m], self.rank[m + at.start], m + at.start)


def cuts(sample: list[np.ndarray], cells: int) -> dict[int, list]:
    """For each number of dimensions a binary tree of cuts, as nested lists: [direction, threshold, below, above], or [centre] of a leaf."""
    out = {}
    least = math.ceil(len(sample) / cells)

    def cut(x: np.ndarray) -> list:
        found = parted(x, 4) if len(x) > least else None
        if found is None:
            return [x.mean(axis=0)]
        direction, at, low = found
        return [direction, at, cut(x[low]), cut(x[~low])]

    for dim in {len(v) for v in sample}:
        mine = [v for v in sample if len(v) == dim]
        out[dim] = cut(np.array(mine, np.float64).reshape(len(mine), dim))
    return out


def routed(tree: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, distance to its centre, rounded up) of each row."""
    leaf, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    todo, n = [(tree, np.arange(len(x)))], 0
    while todo:
        node, at = todo.pop()
        if len(node) == 1:
            leaf[at] = n
            far[at] = np.sqrt(((x[at] - node[0]) ** 2).sum(axis=1)) * (1 + ROOM) + ROOM
            n += 1
        else:
            below = x[at] @ node[0] <= node[1]
            todo += [(node[2], at[below]), (node[3], at[~below])]
    return leaf, far


def centres(tree: list) -> list[np.ndarray]:
    """Centres of the leaves, as ``routed`` numbers them."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if len(node) == 1:
            out.append(node[0])
        else:
            todo += [node[2], node[3]]
    return out


def place(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """Rows with their cell, the cells (cell, blocks, groups), and for each number of dimensions a tree over its cells' balls."""
    n = rows.count()
    drawn = rows.select("whole").orderBy(F.xxhash64("whole", "row")).limit(SAMPLE).toArrow()
    sample = [np.frombuffer(r, "<i4").astype(np.float64) for r in drawn["whole"].to_pylist()]
    trees = cuts(sample, min(CELLS, max(1, math.ceil(n / CELL)))) if sample else {}
    held = rows.sparkSession.sparkContext.broadcast(trees)  # CELLS vectors and directions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(b.schema.names.index("whole")).to_pylist()
            cell, far = np.zeros(len(raw), np.int64), np.zeros(len(raw))
            dims = np.array([len(r) // 4 for r in raw], np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(raw[i] for i in at), "<i4").reshape(len(at), dim).astype(np.float64)
                leaf, far[at] = routed(held.value.get(dim, [np.zeros(dim)]), x)
                cell[at] = dim << 32 | leaf
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    placed = checkpoint(map_arrow(rows, run, T.StructType([*rows.schema.fields, *schema(("cell", "long"), ("far", "double")).fields])))
    cells = checkpoint(
        placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("anchor").alias("n_anchors"), F.max("far").alias("far"))
        .select("cell", "far", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("n_anchors") / GROUP), F.lit(1)).cast("int").alias("groups"))
    )
    known = cells.select("cell", "far", "blocks").toArrow()  # CELLS rows, and one for each length that the sample lacks
    name, far, blocks = (known[c].to_numpy() for c in ("cell", "far", "blocks"))
    top = {}
    for dim in np.unique(name >> 32).tolist():
        at = np.flatnonzero(name >> 32 == dim)
        middle = centres(trees.get(dim, [np.zeros(dim)]))
        over = Tree(np.array([middle[c & 0xFFFFFFFF] for c in name[at]]).reshape(len(at), dim), 1, radii=far[at])
        top[dim] = (over, name[at][over.order], blocks[at][over.order])
    return placed, cells, top


#: An anchors' group as one row: rows, labels, vectors, and its asks (the anchor's place, the ask's number, least and largest score).
PACKED = ("dim", "rows", "labels", "wholes", "owners", "numbers", "lows", "highs")


def grouped(anchors: DataFrame, cells: DataFrame) -> DataFrame:
    """Anchors (row, label, whole, cell, asks) packed in groups of about GROUP; ``asks`` is an array of (number, low, high)."""
    kept = anchors.join(F.broadcast(cells.select("cell", "groups")), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int"))
    lists = kept.groupBy("cell", "part").agg(F.collect_list(F.struct("row", "label", "whole", "asks")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cell, part, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                asks = [(i, *(x[k] for k in ("number", "low", "high"))) for i, h in enumerate(held) for x in h["asks"]]
                numbers = [np.array([h[k] for h in held], np.int64).tobytes() for k in ("row", "label")]
                out.append((cell, part, cell >> 32, *numbers, b"".join(h["whole"] for h in held), *(np.array([x[k] for x in asks], np.int64).tobytes() for k in range(4))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)] if out else [pa.array([], f.type) for f in fields], names=names)

    names = ["cell", "part", *PACKED]
    fields = pa.schema([("cell", pa.int64()), ("part", pa.int32()), ("dim", pa.int64()), *[(c, pa.binary()) for c in PACKED[1:]]])
    return map_arrow(lists, run, schema(("cell", "long"), ("part", "int"), ("dim", "long"), *[(c, "binary") for c in PACKED[1:]]))


def unpacked(dim: int, rows: bytes, labels: bytes, wholes: bytes, owners: bytes, numbers: bytes, lows: bytes, highs: bytes) -> list[np.ndarray]:
    row, label, owner, number, low, high = (np.frombuffer(x, np.int64) for x in (rows, labels, owners, numbers, lows, highs))
    return [row, label, np.frombuffer(wholes, "<i4").reshape(len(row), dim).astype(np.int64), owner, number, low, high]


def at_home(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """Each group with one block of its own cell."""
    kept = groups.join(F.broadcast(cells.select("cell", "blocks")), "cell")
    return kept.withColumn("block", F.pmod(F.xxhash64("cell", "part"), F.col("blocks")).cast("int")).drop("blocks", "part")


def promising(groups: DataFrame, top: dict) -> DataFrame:
    """Each group with every block whose cell may hold a score that one of its anchors asks for: both trees' upper halves."""
    held = groups.sparkSession.sparkContext.broadcast(top)  # a ball for each cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                packed = b.slice(k, 1)
                values = [packed.column(i)[0].as_py() for i in range(2, b.num_columns)]
                row, label, x, owner, number, low, high = unpacked(*values)
                if not len(owner) or values[0] not in held.value:
                    continue
                over, cell, blocks = held.value[values[0]]
                centre = x.mean(axis=0)
                radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) * (1 + ROOM) + ROOM
                norm, least, most = float(np.sqrt(centre @ centre)), int(low.min()), int(high.max())
                todo, met = [0], []
                while todo:
                    nodes, todo = todo, []
                    less, more = interval(centre, norm, radius, over.centre[nodes], over.norm[nodes], over.radius[nodes])
                    for j in np.array(nodes)[(more >= least) & (less <= most)].tolist():
                        if over.children[j]:
                            todo += over.children[j]
                        else:
                            met += range(over.begin[j], over.end[j])
                at = np.array(met, np.int64)
                for some in np.array_split(at, max(1, math.ceil(len(at) / 64))):
                    to = np.repeat(some, blocks[some])
                    block = np.concatenate([np.arange(n) for n in blocks[some]] or [np.zeros(0)]).astype(np.int32)
                    same = pa.Table.from_batches([packed.select(range(2, b.num_columns))]).take(pa.array(np.zeros(len(to), np.int64)))
                    t = pa.table([pa.array(cell[to]), *same.columns, pa.array(block)], names=["cell", *PACKED, "block"])
                    yield from t.combine_chunks().to_batches()

    return map_arrow(groups, run, schema(("cell", "long"), ("dim", "long"), *[(c, "binary") for c in PACKED[1:]], ("block", "int")))


def meet(placed: DataFrame, cells: DataFrame, met: DataFrame, k: int, same: bool, raise_lows: bool) -> DataFrame:
    """Groups against the blocks that they were sent to. ``raise_lows``: gives the groups with what the block shows of the
    least score that can count; else gives (row, number, score, vec_id), the first ``k`` of each ask in each block."""
    kept = placed.join(F.broadcast(cells.select("cell", "blocks")), "cell")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    candidates = kept.select("cell", block.alias("block"), F.lit(0).alias("side"), "row", "vec_id", "label", "whole", *[F.lit(None).cast("long" if c == "dim" else "binary").alias(c) for c in PACKED])
    empty = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("row", "vec_id", "label", "whole")]
    both = candidates.unionByName(met.select("cell", "block", F.lit(1).alias("side"), *empty, *PACKED))
    vec_id = placed.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for b in batches:
            t = pa.Table.from_batches([b])
            key = np.stack([t["cell"].to_numpy(), t["block"].to_numpy(), t["side"].to_numpy()], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                cell, block, side = key[begin].tolist()
                if (cell, block) != at:
                    at, held, ready = (cell, block), [], None
                piece = t.slice(begin, end - begin)
                if side == 0:
                    held.append(piece.select(["row", "vec_id", "label", "whole"]))
                    continue
                if ready is None and held:
                    c = pa.concat_tables(held).combine_chunks()
                    x = np.frombuffer(b"".join(c["whole"].to_pylist()), "<i4").reshape(len(c), cell_dim(piece)).astype(np.int64)
                    ready, held = Block(c["row"].to_numpy(), c["label"].to_numpy(), x, c["vec_id"].combine_chunks()), []
                for values in zip(*(piece[c].to_pylist() for c in PACKED), strict=True):
                    row, label, x, owner, number, low, high = unpacked(*values)
                    asks = Asks(row, label, x, owner, low, high, k, same)
                    if ready is not None:
                        ready.search(asks)
                    if raise_lows:
                        raised = np.empty(len(low), np.int64)
                        raised[asks.ask] = asks.low
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((cell, 0, *values[:6], raised.tobytes(), values[7]), fields, strict=True)], names=fields.names)
                    elif ready is not None:
                        ask, score, _, candidate = asks.found
                        cols = [pa.array(asks.row[asks.owner[ask]]), pa.array(number[asks.ask[ask]].astype(np.int32)), pa.array(score), ready.ids.take(pa.array(candidate))]
                        yield pa.RecordBatch.from_arrays(cols, names=["row", "number", "score", "vec_id"])

    def cell_dim(piece: pa.Table) -> int:
        return piece["dim"][0].as_py()

    fields = pa.schema([("cell", pa.int64()), ("part", pa.int32()), ("dim", pa.int64()), *[(c, pa.binary()) for c in PACKED[1:]]])
    packed = schema(("cell", "long"), ("part", "int"), ("dim", "long"), *[(c, "binary") for c in PACKED[1:]])
    hits = schema(("row", "long"), ("number", "int"), ("score", "long"), ("vec_id", vec_id))
    dealt = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
    return map_arrow(dealt, run, packed if raise_lows else hits)


def first_of(placed: DataFrame, cells: DataFrame, top: dict, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(row, number, score, vec_id, rank) of the first ``k`` candidates of each ask; ties go to the smaller id, null ids last."""
    groups = grouped(anchors, cells)
    raised = checkpoint(meet(placed, cells, at_home(groups, cells), k, same, True))
    hits = meet(placed, cells, promising(raised, top), k, same, False)
    # no more than k rows for each block that the anchor met
    order = W.Window.partitionBy("row", "number").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE) -> DataFrame:
    """For each anchor and each of its first positives the first negatives whose score is ``low`` to ``high`` percent of the positive's.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. A row's score is the inner product of
    floor(scale * x) of both vectors. An anchor's positives are other rows of its label, its negatives rows of other labels;
    higher scores come first, ties by smaller vec_id.

    Rows are cut into cells by a tree from a bounded sample, and every row counts in its cell's ball. A group of anchors
    goes through the tree of these balls at once, and meets only the blocks of cells whose interval of inner products
    reaches what one of its anchors asks for; before that, a block of the group's own cell raises what counts. Where a
    group meets a block, trees over both are searched pair by pair of nodes, and pairs of leaves are scored exactly. A cell
    of any size is dealt to blocks of about BLOCK rows, and no list is cut: results are those of a full comparison.

    Rows with a null label, a null vector, or a null or non-finite component take no part; vectors of another length than
    the anchor's are not compared with it. Rows alike or of one id are rows of their own; null ids come last among ties.
    Labels that are no whole numbers are compared by a 64-bit hash. Other columns are not read. An empty table gives an
    empty result, as does one without anchors.
    """
    kind = vectors.schema["label"].dataType
    label = F.col("label").cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64("label")
    usable = vectors.where("label is not null").select("vec_id", label.alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), "embedding")
    rows = checkpoint(whole_rows(usable, scale).withColumn("row", F.monotonically_increasing_id()))
    placed, cells, top = place(rows)
    asked = placed.where("anchor").select("row", "label", "whole", "cell")
    any_score = F.array(F.struct(F.lit(1).cast("int").alias("number"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high")))
    found = first_of(placed, cells, top, asked.withColumn("asks", any_score), positives, True)
    pairs = checkpoint(found.select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("number")))
    # low * positive <= 100 * negative <= high * positive, in whole numbers
    least = F.expr(f"({low} * positive_score + pmod(-({low} * positive_score), 100L)) div 100L")
    most = F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100L)) div 100L")
    bands = pairs.select("row", F.struct(F.col("number").cast("int").alias("number"), least.alias("low"), most.alias("high")).alias("ask")).where("ask.low <= ask.high")
    asks = bands.groupBy("row").agg(F.collect_list("ask").alias("asks"))
    picked = first_of(placed, cells, top, asked.join(asks, "row"), negatives, False)
    named = placed.where("anchor").select("row", F.col("vec_id").alias("anchor_id"))
    out = picked.select("row", "number", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["row", "number"]).join(named, "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
