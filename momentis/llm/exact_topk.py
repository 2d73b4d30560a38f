"""Exact top-k search by inner product over KD-trees, one per shard.

1. Cells: median splits of a sample of `SAMPLE` vectors, a fixed and documented bound, cut the space into cells of about `SHARD` vectors (at least
   `LEAST` sampled ones each, so their number is bounded); every vector goes to its cell, and a cell of more vectors is dealt into several shards.
2. Trees: each shard's tree is built once and written. It splits at the median of the widest dimension down to leaves and keeps a
   tight bounding box per node.
3. Search: a box bounds a query's inner product by sum(max(q * low, q * high)); a query goes through a tree best bound first and stops at a
   bound below its k-th best score. It first searches the shard it lies in. The boxes of all cells (a bounded table) then say which other cells can reach its
   k-th score; these are searched in waves, best bounds first, each wave with the k-th score of all before. Only queries travel: a shard's tree meets
   them as a stream, so no task holds more than one tree and a batch of queries.

Components become floor(256 * x). Scores are exact: in floating point where all sums stay below 2**53, else in whole numbers.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors only meet others of their length, however long; rows
with one id are different rows, and a query skips only its own row; ties go to the smaller id; a null id is no query and comes last
among ties; an empty table gives an empty result; only the two columns named are read, whatever others are called.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis.llm.common import materialize, numbered, small_batches

SHARD = 8192
#: A shard's vectors take up to so many bytes, however long they are.
SHARD_BYTES = 4 << 20
SAMPLE, LEAST = 20_000, 16
LEAF = 128
SCALE = 256
#: Cells that a query searches in its first wave; each further wave takes four times as many.
WAVE = 8
#: Queries that one task puts to a shard.
ASKED = 50_000
_EXACT = float(1 << 53)
_LAST = (1 << 63) - 1


class Tree:
    """Median splits down to leaves, with tight boxes; nodes are (low row, high row, left child, right child)."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []
        low, high = [], []

        def build(a: int, b: int) -> int:
            own = points[self.order[a:b]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            me = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            low.append(lo)
            high.append(hi)
            if b - a > LEAF and (hi > lo).any():
                wide = int(np.argmax(hi - lo))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, wide], mid)]
                self.nodes[me] = (a, b, build(a, a + mid), build(a + mid, b))
            return me

        build(0, len(points))
        self.points = points[self.order]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of each query's score in each node."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own_row: int, bound: np.ndarray, k: int, floor: float) -> list[tuple]:
    """Up to k best (score, -id, row) of a query that reach the floor, in falling order; ids and rows follow the tree's order."""
    best: list[tuple] = []
    heap = [(-bound[0], 0)]
    least = floor
    while heap:
        top, node = heapq.heappop(heap)
        if -top < least:
            break
        a, b, left, right = tree.nodes[node]
        if left >= 0:
            heapq.heappush(heap, (-bound[left], left))
            heapq.heappush(heap, (-bound[right], right))
            continue
        scores = tree.points[a:b] @ query
        for i in np.flatnonzero(scores >= least).tolist():
            if rows[a + i] != own_row:
                found = (int(scores[i]), -int(ids[a + i]), int(rows[a + i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        if len(best) == k:
            least = max(least, best[0][0])
    return sorted(best, reverse=True)


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, dims, vectors, most = [], [], [], []
        for i, v in enumerate(batch.column(2).to_pylist()):
            if v is None or any(x is None for x in v):
                continue
            x = np.floor(SCALE * np.array(v, np.float64))
            if np.isfinite(x).all():
                keep.append(i), dims.append(len(v)), vectors.append(x.tobytes()), most.append(float(np.abs(x).max(initial=0)))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary()), pa.array(most, pa.float64())], ["row", "id", "dim", "v", "most"])


class Cells:
    """Median splits of a sample: nodes are (dimension, threshold, left child, right child), or (-1, cell, 0, 0)."""

    def __init__(self, sample: np.ndarray, wanted: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.count = 0

        def build(points: np.ndarray, wanted: int) -> int:
            me = len(self.nodes)
            self.nodes.append((-1, self.count, 0, 0))
            spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
            if wanted > 1 and len(points) >= 2 * LEAST and (spread > 0).any():
                axis = int(np.argmax(spread))
                middle = np.median(points[:, axis])
                low = points[:, axis] < middle if (points[:, axis] < middle).any() else points[:, axis] <= middle
                left, right = build(points[low], wanted // 2), build(points[~low], wanted - wanted // 2)
                threshold = points[~low, axis].min()
                self.nodes[me] = (axis, threshold, left, right)
            else:
                self.count += 1
            return me

        build(sample, wanted)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int64)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, at = waiting.pop()
            axis, value, left, right = self.nodes[node]
            if axis < 0:
                out[at] = value
                continue
            low = points[at, axis] < value
            waiting += [(left, at[low]), (right, at[~low])]
        return out


def exact(points: np.ndarray, most: float) -> np.ndarray:
    """Whole numbers as floating point where all products with numbers up to `most` add up exactly, else as Python's own."""
    if np.abs(points).max(initial=0) * most * points.shape[1] < _EXACT:
        return points
    return np.vectorize(int, otypes=[object])(points)


def _placed(cells: dict[int, Cells]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, v, out = batch.column(2).to_numpy(), batch.column(3), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                out[at] = cells[dim].of(np.frombuffer(b"".join(v.take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["row", "id", "dim", "v", "cell"])

    return run


def _built(largest: dict[int, float]):
    def run(shard: pa.Table) -> pa.Table:
        """A shard's tree, with its box."""
        dim = shard.column("dim")[0].as_py()
        x = exact(np.frombuffer(b"".join(shard.column("v").to_pylist()), np.float64).reshape(shard.num_rows, dim), largest[dim])
        tree = Tree(x)
        ids = shard.column("id").fill_null(_LAST).to_numpy()[tree.order]
        packed = pickle.dumps((tree, ids, shard.column("row").to_numpy()[tree.order]))
        box = [np.asarray(y[0], np.float64).tobytes() for y in (tree.low, tree.high)]
        return pa.table([shard.column("shard")[:1], shard.column("dim")[:1], shard.column("cell")[:1], pa.array([packed], pa.binary()), *(pa.array([b], pa.binary()) for b in box)], names=["shard", "dim", "cell", "tree", "low", "high"])

    return run


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of shards, the tree first: each query's best in the shard."""
        tree = None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            trees = [*np.flatnonzero(batch.column("tree").is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
            spans = [(None, 0, trees[0]), *((a, a + 1, b) for a, b in zip(trees, trees[1:], strict=False))]
            for at, low, high in spans:
                if at is not None:
                    tree, ids, rows = pickle.loads(batch.column("tree")[at].as_py())
                if low == high:
                    continue
                asked = batch.slice(low, high - low)
                q = np.frombuffer(b"".join(asked.column("v").to_pylist()), np.float64).reshape(asked.num_rows, -1)
                if tree.points.dtype == object:
                    q = np.vectorize(int, otypes=[object])(q)
                bounds = tree.bounds(q)
                for i, (own, name, floor) in enumerate(zip(*(asked.column(x).to_pylist() for x in ("row", "id", "floor")), strict=True)):
                    for score, least_id, found in search(tree, ids, rows, q[i], own, bounds[i], k, -np.inf if floor is None else floor):
                        for column, value in zip(out, (own, name, -least_id, score), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["row", "query_id", "vec_id", "score"])

    return run


def _reached(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each query, the cells whose box reaches its k-th score so far."""
        for batch in batches:
            row, cell, bound = [], [], []
            for own, dim, v, floor in zip(*(batch.column(x).to_pylist() for x in ("row", "dim", "v", "floor")), strict=True):
                q = np.frombuffer(v, np.float64)
                cells, low, high = boxes[dim]
                top = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                size = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
                top = np.where(size < _EXACT, top, top + 1e-9 * size)  # rounding must not lower a bound
                near = np.arange(len(cells)) if floor is None else np.flatnonzero(top >= floor)
                row.append(np.full(len(near), own)), cell.append(cells[near]), bound.append(top[near])
            if row:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (row, cell, bound)], ["row", "cell", "bound"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row that the condition is_query (over the column `id`) holds for: query_id, rank, vec_id and score of its k best others."""
    spark = vectors.sparkSession
    small_batches(spark)
    plain = numbered(vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("v")), "row", once=True).select("row", "id", "v")
    points = materialize(plain.mapInArrow(_scaled, "row long, id long, dim int, v binary, most double").where("dim > 0"))
    result = "row long, query_id long, vec_id long, score long"
    counts = points.groupBy("dim").agg(F.count("*").alias("n"), F.max("most").alias("most")).collect()  # a row for each length of vectors
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells, largest = {}, {}
    for dim, n, most in counts:
        size = max(LEAST, min(SHARD, SHARD_BYTES // (8 * dim)))
        own = points.where(F.col("dim") == dim)
        drawn = own if n <= SAMPLE else own.where(F.pmod(F.xxhash64("row"), F.lit(-(-n // SAMPLE))) == 0).limit(2 * SAMPLE)
        sample = np.frombuffer(b"".join(bytes(r.v) for r in drawn.select("v").collect()), np.float64).reshape(-1, dim)
        cells[dim], largest[dim] = Cells(sample, -(-n // size)), most
    placed = materialize(points.drop("most").mapInArrow(_placed(cells), "row long, id long, dim int, v binary, cell long"))
    base, rows = 0, []
    for dim, cell, n in placed.groupBy("dim", "cell").count().orderBy("dim", "cell").collect():  # at most SAMPLE / LEAST cells of each length
        shards = -(-n // max(LEAST, min(SHARD, SHARD_BYTES // (8 * dim))))
        rows.append((dim, cell, base, shards))
        base += shards
    dealt = F.broadcast(spark.createDataFrame(rows, "dim int, cell long, base long, shards long"))
    placed = placed.join(dealt, ["dim", "cell"]).withColumn("shard", F.col("base") + F.pmod(F.xxhash64("row"), "shards")).drop("base", "shards")
    trees = materialize(placed.groupBy("shard").applyInArrow(_built(largest), "shard long, dim int, cell long, tree binary, low binary, high binary"), [points])
    boxes = {dim: _cell_boxes(trees.where(F.col("dim") == dim), dim) for dim in cells}

    queries = materialize(placed.where(is_query).select("row", "id", "dim", "v", F.col("shard").alias("home")))
    none = lambda kind: F.lit(None).cast(kind)

    def meet(asked: DataFrame) -> DataFrame:
        """asked: shard, row, id, v, floor. A shard that very many queries ask goes to several tasks, as many as their number says."""
        asked = materialize(asked)
        slots = asked.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).alias("slots"))
        held = trees.join(slots, "shard").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
        held = held.select("shard", "slot", none("long").alias("row"), none("long").alias("id"), none("binary").alias("v"), none("long").alias("floor"), "tree")
        each = asked.join(slots, "shard").withColumn("slot", F.pmod(F.xxhash64("row"), "slots")).withColumn("tree", none("binary")).drop("slots")
        both = held.unionByName(each).withColumn("kind", F.col("row").isNotNull())
        return both.repartition("shard", "slot").sortWithinPartitions("shard", "slot", "kind").drop("kind", "slot").mapInArrow(_searched(k), result)

    def kept(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def floors(best: DataFrame) -> DataFrame:
        return best.where(F.col("rank") == k).select("row", F.col("score").alias("floor"))

    best = materialize(kept(meet(queries.select(F.col("home").alias("shard"), "row", "id", "v", none("long").alias("floor")))))
    asked = queries.join(floors(best), "row", "left")
    reached = asked.select("row", "dim", "v", "floor").mapInArrow(_reached(boxes), "row long, cell long, bound double")
    nearest = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("bound"), "cell"))
    waiting = materialize(reached.withColumn("place", nearest))
    low, high = 0, WAVE
    while not waiting.isEmpty():
        now = waiting.where((F.col("place") > low) & (F.col("place") <= high))
        turn = now.join(queries, "row").join(floors(best), "row", "left").where("floor is null or bound >= floor").join(dealt, ["dim", "cell"])
        turn = turn.withColumn("shard", F.explode(F.sequence("base", F.col("base") + F.col("shards") - 1))).where("shard <> home")
        best_now = materialize(kept(best.drop("rank").unionByName(meet(turn.select("shard", "row", "id", "v", "floor")))), [best])
        left = waiting.where(F.col("place") > high).join(floors(best_now), "row", "left").where("floor is null or bound >= floor").drop("floor")
        waiting_now = materialize(left, [waiting])
        best, waiting, low, high = best_now, waiting_now, high, 4 * high
    return best.select("query_id", "rank", F.when(F.col("vec_id") < F.lit(_LAST), F.col("vec_id")).alias("vec_id"), "score")


def _cell_boxes(shards: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of one length of vectors, at most SAMPLE / LEAST, with the boxes around all their shards."""

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for cell, low, high in zip(*(batch.column(x).to_pylist() for x in ("cell", "low", "high")), strict=True):
                own = [np.frombuffer(low, np.float64), np.frombuffer(high, np.float64)]
                held[cell] = [np.minimum(held[cell][0], own[0]), np.maximum(held[cell][1], own[1])] if cell in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *(pa.array([x[j].tobytes() for x in held.values()], pa.binary()) for j in (0, 1))], ["cell", "low", "high"])

    each = shards.select("cell", "low", "high").mapInArrow(widened, "cell long, low binary, high binary")
    found = each.repartition("cell").mapInArrow(widened, "cell long, low binary, high binary").orderBy("cell").collect()
    return np.array([r.cell for r in found], np.int64), *(np.frombuffer(b"".join(bytes(r[x]) for r in found), np.float64).reshape(len(found), dim) for x in ("low", "high"))


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP10_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
