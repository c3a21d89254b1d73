"""Exact top-k search by inner product in a forest of M-trees, best node first.

With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0), the squared
Euclidean distance of q' and x' is |q|^2 + M^2 - 2 q.x: the nearest are those of the
highest score, in a metric space. All rows are indexed. Routing objects at the
top are taken from a bounded sample; a row belongs to the subtree of its nearest
one. A subtree of many rows gets routing objects from a bounded sample of its own
rows, and so on, level by level, so the tree deepens with the table; every node
keeps its covering radius and the distance to the node above. Only rows that no
routing object tells apart, such as equal ones, are dealt into cells by a hash.
Within a cell rows sit in leaf pages with a routing object, a covering radius and
each entry's distance to the routing object.

A query first searches the cell it is in, which gives it a score to beat. It then
goes down the levels, to nodes whose stored distance to the node above, and if
that doesn't settle it, whose own distance and covering radius allow such a score.
In a cell it takes pages in order of their least possible distance until that can't win. Of a
page it computes only entries whose stored distances, by the triangle inequality,
leave a chance. Scores are sums of integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, load

SAMPLE = 2048
SUBTREES = 64
ROWS_A_SUBTREE = 4096
#: A node of more rows is split.
ROWS_A_CELL = 8192
#: Children of a node below the top, and about how many of its rows they are chosen from.
FAN = 64
SAMPLE_A_NODE = 512
DEPTH = 8
#: Rows of a node that one task deals out among its children, and queries that one task takes through a cell.
ROWS_A_DEAL = 1 << 17
QUERIES_A_CELL = 1 << 15
PAGE = 256
EXACT = float(1 << 53)


def integers(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(key, vec array<double>, norm2) of the rows whose vector and components are there and finite."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(good).select(F.col(key).cast("long").alias("id"), whole.alias("vec"))
    return rows.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))


def routing_objects(sample: np.ndarray, most: float, count: int) -> np.ndarray:
    """Up to ``count`` of the sampled rows, each the farthest from those before it, with the added coordinate."""
    lifted = lift(sample, most)
    chosen, near = [0], np.full(len(lifted), np.inf)
    while len(chosen) < min(count, len(lifted)):
        near = np.minimum(near, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
        if near.max() == 0:
            break
        chosen.append(int(near.argmax()))
    return lifted[chosen]


def lift(rows: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([rows, np.sqrt(np.maximum(most - (rows * rows).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


class Cell:
    """The leaf pages of one cell."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, most: float):
        self.most, lifted = most, lift(rows, most)
        picked = routing_objects(rows[:: max(1, len(rows) // 512)], most, max(1, -(-len(rows) // PAGE)))
        apart = distances(lifted, picked)
        home = apart.argmin(axis=1)
        parent = apart[np.arange(len(rows)), home]
        order = np.lexsort((parent, home))
        edges = np.searchsorted(home[order], np.arange(len(picked) + 1))
        self.pages = [(ids[o], rows[o], parent[o]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a for o in (order[a:b],)]
        used = edges[1:] > edges[:-1]
        self.routing = picked[used]
        self.radius = np.array([p[2][-1] for p in self.pages])
        self.opened = self.computed = 0

    def search(self, ids: np.ndarray, queries: np.ndarray, beat: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its best rows here, none below ``beat``, ties to smaller ids."""
        zero = np.zeros((len(queries), 1))
        to_page = distances(np.hstack([queries, zero]), self.routing)
        least = np.maximum(to_page - self.radius[None, :], 0)
        norms = (queries * queries).sum(axis=1)
        slack = 1e-6 * (np.sqrt(self.most) + np.sqrt(norms) + 1)
        for i, query in enumerate(queries):
            best_ids, best = np.zeros(0, np.int64), np.zeros(0)
            floor = beat[i]
            for page in np.argsort(least[i], kind="stable"):
                reach = np.sqrt(max(norms[i] + self.most - 2 * floor, 0)) + slack[i] if np.isfinite(floor) else np.inf
                if least[i, page] > reach:
                    break
                self.opened += 1
                page_ids, rows, parent = self.pages[page]
                a, b = np.searchsorted(parent, to_page[i, page] - reach, "left"), np.searchsorted(parent, to_page[i, page] + reach, "right")
                self.computed += b - a
                scores = rows[a:b] @ query
                fit = (scores >= floor) & (page_ids[a:b] != ids[i]) if np.isfinite(floor) else page_ids[a:b] != ids[i]
                if fit.any():
                    best_ids, best = np.concatenate([best_ids, page_ids[a:b][fit]]), np.concatenate([best, scores[fit]])
                    if len(best) > k:
                        order = np.lexsort((best_ids, -best))[:k]
                        best_ids, best = best_ids[order], best[order]
                    if len(best) == k:
                        floor = max(floor, best.min())
            yield best_ids, best


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _searched(rows: DataFrame, queries: DataFrame, most: float, k: int, parts: int) -> DataFrame:
    """(query_id, vec_id, score) from searching cells: ``rows`` (dim, node, part, id, vec), ``queries`` the same and beat.

    A task holds one cell while its queries stream by; a cell's rows are copied only if
    more than QUERIES_A_CELL queries come to it.
    """
    place = ["dim", "node", "part"]
    cell = [*place, "block"]
    blocks = queries.groupBy(*place).agg(F.ceil(F.count("*") / QUERIES_A_CELL).cast("int").alias("blocks"))
    left = rows.join(blocks, place).select(*place, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), "id", "vec", F.lit(None).cast("double").alias("beat"))
    right = queries.join(blocks, place).select(*place, F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), "id", "vec", "beat")
    both = left.unionByName(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in batches:
            n = batch.num_rows
            marks = np.column_stack([batch.column(c).to_numpy() for c in [*cell, "role"]]) if n else np.zeros((0, 5))
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), n] if n else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here, role = tuple(marks[a, :4].tolist()), marks[a, 4]
                part = batch.slice(a, b - a)
                if here != now:
                    now, held, tree = here, [], None
                if role == 0:
                    held.append((part.column("id").to_numpy(), matrix(part.column("vec"))))
                    continue
                if tree is None and held:
                    tree = Cell(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), most)
                if tree is None:
                    continue
                ids = part.column("id").to_numpy()
                beat = part.column("beat").to_numpy(zero_copy_only=False).astype(np.float64)
                found = list(tree.search(ids, matrix(part.column("vec")), np.where(np.isnan(beat), -np.inf, beat), k))
                counts = [len(f[0]) for f in found]
                if sum(counts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))],
                        ["query_id", "vec_id", "score"],
                    )

    dealt = both.repartition(parts, *cell).sortWithinPartitions(*cell, "role")
    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def _split(placed: DataFrame, big: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """(dim, node, child, center) of the nodes ``big`` (dim, node, n), and these nodes' rows with n.

    A node whose sampled rows are all equal has no children.
    """
    mine = placed.join(big, ["dim", "node"])
    share = F.lit(float(SAMPLE_A_NODE)) / F.col("n")
    draw = F.shiftrightunsigned(F.xxhash64("id", "node"), 11).cast("double") / float(1 << 53)

    def chosen(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if sum(map(len, held)) < 4 * SAMPLE_A_NODE:
                held.append(matrix(batch.column("vec")))
        centers = routing_objects(np.concatenate(held)[: 4 * SAMPLE_A_NODE], most, FAN)
        if len(centers) > 1:
            n = len(centers)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(centers.tolist(), pa.list_(pa.float64()))],
                ["dim", "node", "child", "center"],
            )

    sample = mine.where(draw < share).select("dim", "node", "vec")
    return sample.groupBy("dim", "node").applyInArrow(chosen, "dim int, node bigint, child int, center array<double>"), mine


def _dealt(mine: DataFrame, centers: DataFrame, most: float, parts: int) -> DataFrame:
    """The rows (dim, node, id, vec) of split nodes below their nearest child: (dim, node, id, vec, parent); a hot node is shared among tasks."""
    deals = F.ceil(F.col("n") / ROWS_A_DEAL).cast("int")
    nodes = mine.select("dim", "node", "n").distinct()
    left = centers.join(nodes, ["dim", "node"]).select("dim", "node", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.lit(0).alias("role"), F.col("child").cast("long").alias("id"), F.col("center").alias("vec"))
    right = mine.select("dim", "node", F.pmod(F.xxhash64("id", F.lit(2)), deals).cast("int").alias("deal"), F.lit(1).alias("role"), "id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids = None, [], []
        for batch in batches:
            n = batch.num_rows
            marks = np.column_stack([batch.column(c).to_numpy() for c in ("dim", "node", "deal", "role")]) if n else np.zeros((0, 4))
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), n] if n else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here, part = tuple(marks[a, :3].tolist()), batch.slice(a, b - a)
                if here != now:
                    now, held, ids = here, [], []
                if marks[a, 3] == 0:
                    held.append(matrix(part.column("vec")))
                    ids += part.column("id").to_pylist()
                    continue
                away = distances(lift(matrix(part.column("vec")), most), np.concatenate(held))
                child = np.array(ids)[away.argmin(axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), pa.array(SUBTREES + here[1] * FAN + child, pa.int64()), part.column("id"), part.column("vec"), pa.array(away.min(axis=1))], ["dim", "node", "id", "vec", "parent"]
                )

    where = ["dim", "node", "deal"]
    both = left.unionByName(right).repartition(parts, *where).sortWithinPartitions(*where, "role")
    return both.mapInArrow(run, "dim int, node bigint, id bigint, vec array<double>, parent double")


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, space: Workspace | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of each query among all rows of other ids.

    Rows whose id is null, or whose vector is null, empty or has a null or non-finite
    component, take no part. Vectors are compared with those of their own length.
    Ties go to the smaller id. Repeated rows are as many candidates; a row that is
    repeated asks once. Fewer candidates than k give all of them; an empty
    table gives no rows. Scores must stay below 2**53.
    """
    spark = vectors.sparkSession
    space = space or Workspace(spark, "exact-search")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = integers(vectors, key, vector, scale).withColumn("dim", F.size("vec")).where("dim > 0")
    rows = space.table(rows, "integers")
    shape = {r["dim"]: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("most")).collect()}
    if any(r["most"] >= EXACT for r in shape.values()):
        raise ValueError("scores of these vectors don't fit: the largest squared norm is 2**53 or more")
    most = max([r["most"] for r in shape.values()], default=0.0)
    sample = rows.select("dim", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    roots = {}
    for dim, r in shape.items():
        own = np.array([s["vec"] for s in sample if s["dim"] == dim] or [[0.0] * dim])
        roots[dim] = routing_objects(own, most, max(1, min(SUBTREES, r["n"] // ROWS_A_SUBTREE)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            tree, parent = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own = matrix(batch.column("vec").take(pa.array(at)))
                away = distances(lift(own, most), roots[dim])
                tree[at], parent[at] = away.argmin(axis=1), away.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(tree), batch.column("id"), batch.column("vec"), pa.array(parent)], ["dim", "node", "id", "vec", "parent"])

    shown = "dim int, node bigint, id bigint, vec array<double>, parent double"
    placed = space.table(rows.select("dim", "id", "vec").mapInArrow(place, shown), "placed-0")
    space.drop("integers")
    # at most SUBTREES rows a vector length
    top = {(r["dim"], r["node"]): (r["radius"], r["n"]) for r in placed.groupBy("dim", "node").agg(F.max("parent").alias("radius"), F.count("*").alias("n")).collect()}
    known = spark.createDataFrame([(d, t, roots[d][t].tolist(), n) for (d, t), (_, n) in sorted(top.items())], "dim int, node bigint, center array<double>, n bigint")
    levels: list[DataFrame] = []  # (dim, up, node, center, to_up, radius, n) of the children of each level's split nodes
    for level in range(1, DEPTH):
        big = known.where(F.col("n") > ROWS_A_CELL).select("dim", "node", "n")
        if big.isEmpty():
            break
        centers, mine = _split(placed, big, most)
        centers = space.table(centers, f"centers-{level}")
        split = centers.select("dim", "node").distinct()
        if centers.isEmpty():
            break
        moved = _dealt(mine.join(split, ["dim", "node"], "left_semi"), centers, most, parts)
        placed = space.table(placed.join(split, ["dim", "node"], "left_anti").select("dim", "node", "id", "vec", "parent").unionByName(moved), f"placed-{level}")
        space.drop(f"placed-{level - 1}")
        child = centers.withColumnRenamed("node", "up").withColumn("node", SUBTREES + F.col("up") * FAN + F.col("child"))
        above = known.select("dim", F.col("node").alias("up"), F.col("center").alias("_above"))
        sizes = placed.groupBy("dim", "node").agg(F.max("parent").alias("radius"), F.count("*").alias("n"))
        child = child.join(above, ["dim", "up"]).join(sizes, ["dim", "node"])
        known = space.table(child.select("dim", "up", "node", "center", _distance("center", "_above").alias("to_up"), "radius", "n"), f"nodes-{level}")
        levels.append(known)

    cells = placed.groupBy("dim", "node").agg(F.ceil(F.count("*") / ROWS_A_CELL).cast("int").alias("cells"))
    cells = space.table(cells, "cells")
    placed = space.table(placed.join(cells, ["dim", "node"]).select("dim", "node", F.pmod(F.xxhash64("id"), "cells").cast("int").alias("part"), "id", "vec"), "rows")
    asked = space.table(placed.where(is_query(F.col("id"))).dropDuplicates(["dim", "id", "vec"]), "asked")

    near = space.table(_searched(placed, asked.withColumn("beat", F.lit(None).cast("double")), most, k, parts), "near")
    # an id with several vectors has the scores of all of them, which are no worse
    beat = near.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("_n"), F.min("score").cast("double").alias("_low")).select("id", F.when(F.col("_n") >= k, F.col("_low")).alias("beat"))
    several = asked.groupBy("id").agg(F.count("*").alias("_v")).where("_v > 1").select("id", F.lit(True).alias("_many"))
    beat = beat.join(several, "id", "left").select("id", F.when(F.col("_many").isNull(), F.col("beat")).alias("beat"))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, node, away, limits = [], [], [], []
            for i, dim in enumerate(batch.column("dim").to_pylist()):
                query = np.array(batch.column("vec")[i].as_py())
                low, norm = batch.column("beat")[i].as_py(), float((query * query).sum())
                to_root = distances(np.append(query, 0.0)[None, :], roots[dim])[0]
                limit = np.inf if low is None else np.sqrt(max(norm + most - 2 * low, 0)) + 1e-6 * (np.sqrt(most) + np.sqrt(norm) + 1)
                for t, d in enumerate(to_root.tolist()):
                    if (dim, t) in top and d - top[dim, t][0] <= limit:
                        at.append(i)
                        node.append(t)
                        away.append(d)
                        limits.append(limit)
            if at:
                took = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(took) for c in ("dim", "id", "vec", "beat")), pa.array(node, pa.int64()), pa.array(away), pa.array(limits)], ["dim", "id", "vec", "beat", "node", "away", "limit"])

    front = asked.join(beat, "id", "left").select("dim", "id", "vec", "beat").mapInArrow(enter, "dim int, id bigint, vec array<double>, beat double, node bigint, away double, limit double")
    ends = front
    for level, nodes in enumerate(levels, 1):
        below = nodes.select("dim", F.col("up"), F.col("node").alias("_node"), "center", "to_up", "radius")
        step = front.join(below, (front["dim"] == below["dim"]) & (front["node"] == below["up"])).drop(below["dim"])
        step = step.where(F.abs(F.col("away") - F.col("to_up")) - F.col("radius") <= F.col("limit"))
        step = step.withColumn("_lifted", F.concat("vec", F.array(F.lit(0.0)))).withColumn("_away", _distance("_lifted", "center")).where(F.col("_away") - F.col("radius") <= F.col("limit"))
        front = space.table(step.select("dim", "id", "vec", "beat", F.col("_node").alias("node"), F.col("_away").alias("away"), "limit"), f"front-{level}")
        ends = ends.unionByName(front)
    # of the nodes on the way those that hold rows
    sent = ends.join(cells, ["dim", "node"]).select("dim", "node", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("part"), "id", "vec", "beat")
    home = asked.select("dim", "node", "part", "id", "vec")
    sent = sent.join(home, ["dim", "node", "part", "id", "vec"], "left_anti")
    far = _searched(placed, space.table(sent, "sent"), most, k, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = near.union(far).withColumn("rank", rank).where(F.col("rank") <= k)
    found = space.table(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found")
    space.keep("found")
    return found


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)
