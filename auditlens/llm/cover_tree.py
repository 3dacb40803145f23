"""Embedding near-duplicates by dual traversal of cover trees.

Vectors with one label are scaled to unit length, where a cosine of at least
``t`` is a distance of at most ``sqrt(2 - 2t)``.

1. Equal vectors of a label collapse to one point with a multiplicity.
2. The top of a cover tree is built in Spark: all points of a label are one cell; a cell
   that is too large for a task is split among centres chosen far apart from a sample of its
   own points, and so on until every cell fits.  Cells, centres and covering radii are
   tables; nothing of them is broadcast by hint or collected.
3. Level by level, pairs of cells are replaced by the pairs of their children, and pruned
   where the centres are further apart than the threshold and both covering radii.
4. Each pair of cells that is left is traversed in one task: a cover tree of each cell (nested
   levels, radii halving), node pairs pruned in the same way, node pairs whose points all lie
   within the threshold linked as a whole, leaf pairs compared exactly by cosine.
5. A task returns, for each of its points, how many vectors it links with, and a
   spanning forest of its links; link counts are summed and components joined in
   Spark.  All pairs of a group are never written.

A cell whose points cannot be told apart by centres is cut into blocks by hash, and all its
pairs of blocks are traversed.

Defined results: a null label, or a vector that is null, empty, zero or holds a
null or non-finite component links with nothing, and so do vectors of different
length; each is its own component and kept.  Repeated rows (equal ``vec_id``) are
vectors of their own that link with each other.  A null ``vec_id`` links like any
other and counts for others, but has no component of its own (null) unless its
links give one.  An empty table gives an empty result.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

log = logging.getLogger(__name__)

THRESHOLD = 0.93
#: Components of the vectors of a cell that a task takes; a task holds two cells.
CELL_VALUES = 1 << 19
#: Points that a cell may always have.
CELL_POINTS = 500
#: Children of a cell, and points (as expected) that their centres are chosen from.
CHILDREN = 16
PICKED = 256
#: A node with at most this many points is a leaf.
LEAF = 64
#: Radius at which a level goes on whose nodes cover few points each.
FINE = 0.25
#: Distances computed at a time.
TABLE = 1 << 21
#: Room for rounding in the pruning bounds; links are decided by the cosine itself.
SLACK = 1e-6


def reach_of(threshold: float) -> float:
    """The distance of unit vectors whose cosine is ``threshold``."""
    return math.sqrt(2 - 2 * threshold)


class Node:
    """A point that covers ``points`` (row numbers of the block) within ``radius``; ``more`` links belong to each of them."""

    __slots__ = ("centre", "children", "joined", "more", "points", "radius", "total")

    def __init__(self, centre: int, radius: float, points: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children
        self.joined, self.more, self.total = False, 0, -1

    def walk(self) -> Iterator[Node]:
        held = [self]
        while held:
            node = held.pop()
            yield node
            held.extend(node.children)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def cosine_of(distance):
    """The cosine of unit vectors at this distance."""
    return 1.0 - 0.5 * distance * distance


def net_of(x: np.ndarray, first: int, level: float, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A net of ``x`` from row ``first`` on: rows more than ``level`` apart that cover all others, and the nearest for each row."""
    least = cosine_of(level)
    close, best, net = x @ x[first], np.zeros(len(x), np.int64), [first]
    close[first] = 2.0
    bare = np.flatnonzero(close < least)
    while len(bare):
        some = bare[:batch]
        apart = x[some] @ x[some].T < least
        free, chosen = np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                chosen.append(i)
                free &= apart[i]
        new = some[chosen]
        found = x @ x[new].T
        found[new, np.arange(len(new))] = 2.0
        at = found.argmax(axis=1)
        most = found[np.arange(len(x)), at]
        closer = most > close
        close[closer], best[closer] = most[closer], len(net) + at[closer]
        net.extend(new.tolist())
        bare = bare[close[bare] < least]
    return np.array(net), best


def cover(x: np.ndarray, points: np.ndarray, centre: int, level: float) -> Node:
    """A cover tree over ``points``: children are a net of radius ``level`` and cover what is nearest to them."""
    away = distances(x[points], x[centre][None])[:, 0]
    radius = float(away.max())
    if len(points) <= LEAF or radius <= SLACK:
        return Node(centre, radius, points, [])
    while level >= radius:
        level /= 2
    # the centre itself is the first child: levels are nested
    first = int(np.flatnonzero(points == centre)[0])
    net, best = net_of(x[points], first, level)
    if level > FINE and len(net) > len(points) // 4:  # points far apart: the levels between are left out
        level = FINE
        net, best = net_of(x[points], first, level)
    order = np.argsort(best, kind="stable")
    parts = np.split(points[order], np.flatnonzero(np.diff(best[order])) + 1)
    return Node(centre, radius, points, [cover(x, part, int(points[i]), level / 2) for i, part in zip(net, parts)])


def tree(x: np.ndarray) -> Node:
    return cover(x, np.arange(len(x)), 0, 2.0)


class Links:
    """Found pairs of a task: counts for both sides, and a spanning forest."""

    def __init__(self, left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray, same: bool, threshold: float):
        self.x, self.y, self.same, self.threshold = left, right, same, threshold
        self.size_x, self.size_y = left_size, right_size
        self.count_x, self.count_y = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        self.shift = 0 if same else len(left)
        self.parent = np.arange(len(left) + (0 if same else len(right)))
        self.forest: list[tuple[int, int]] = []
        self.reach, self.within = reach_of(threshold) + SLACK, reach_of(threshold) - SLACK
        self.compared = 0

    def root(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def roots(self, a: np.ndarray) -> np.ndarray:
        found = self.parent[a]
        while (found != (up := self.parent[found])).any():
            found = up
        self.parent[a] = found
        return found

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        """Links between points ``p`` and ``q``: those that join two trees go to the forest."""
        r, s = self.roots(p), self.roots(q)
        apart = np.flatnonzero(r != s)
        if not len(apart):
            return
        _, first = np.unique(r[apart] * len(self.parent) + s[apart], return_index=True)
        for a, b in zip(p[apart[first]].tolist(), q[apart[first]].tolist()):
            r, s = self.root(a), self.root(b)
            if r != s:
                self.parent[max(r, s)] = min(r, s)
                self.forest.append((a, b))

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of points of two leaves, by cosine; a point is not paired with itself."""
        own = self.same and a is b
        if own and len(a) == 1:
            return
        self.compared += len(a) * len(b)
        hit = self.x[a] @ self.y[b].T >= self.threshold
        if own:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        if not len(i):
            return
        self.count_x[a] += hit @ self.size_y[b]
        (self.count_x if self.same else self.count_y)[b] += hit.T @ self.size_x[a]
        self.join(a[i], b[j] + self.shift)

    def link_all(self, a: Node, b: Node) -> None:
        """Every point of one node with every point of the other, without looking at the pairs."""
        for node, size, shift in ((a, self.size_x, 0), (b, self.size_y, self.shift)):
            if node.total < 0:
                node.total = int(size[node.points].sum())
        if a is b:
            self.count_x[a.points] += a.total - self.size_x[a.points]
            self._join_node(a, 0)
            return
        a.more += b.total
        b.more += a.total
        # every point of each side links with the other's first point
        self.join(np.array([a.points[0]]), np.array([b.points[0] + self.shift]))
        self._join_node(a, 0, b.points[0] + self.shift)
        self._join_node(b, self.shift, a.points[0])

    def _join_node(self, node: Node, shift: int, through: int | None = None) -> None:
        """The points of a node are one tree from now on, by links with ``through`` or else with its first point."""
        if not node.joined:
            mine = node.points + shift
            self.join(mine, np.full(len(mine), mine[0] if through is None else through))
            node.joined = True

    def traverse(self, a: Node, b: Node) -> None:
        """Node pairs, each unordered pair of points once."""
        stack, tops = [(a, b)], [(a, self.count_x)] + [(b, self.count_y)] * (not self.same)
        while stack:
            a, b = stack.pop()
            if self.same and a is b:
                if 2 * a.radius <= self.within:
                    self.link_all(a, a)
                elif not a.children:
                    self.compare(a.points, a.points)
                else:
                    kids = a.children
                    stack.extend((k, k) for k in kids if len(k.points) > 1)
                    for i, j, full in self.near(kids, kids):
                        if i < j:
                            self.link_all(kids[i], kids[j]) if full else stack.append((kids[i], kids[j]))
            elif not a.children and not b.children:
                self.compare(a.points, b.points)
            else:
                kids_a = a.children if a.children and (not b.children or a.radius >= b.radius) else [a]
                kids_b = b.children if b.children and (not a.children or b.radius >= a.radius) else [b]
                for i, j, full in self.near(kids_a, kids_b):
                    self.link_all(kids_a[i], kids_b[j]) if full else stack.append((kids_a[i], kids_b[j]))
        for top, count in tops:
            for node in top.walk():
                if node.more:
                    count[node.points] += node.more

    def near(self, a: list[Node], b: list[Node]) -> Iterator[tuple[int, int, bool]]:
        """Pairs that are not pruned (centres no further apart than the threshold and both covering radii), and
        whether all their points lie within the threshold."""
        ra, rb = np.array([n.radius for n in a]), np.array([n.radius for n in b])
        x, y = self.x[[n.centre for n in a]], self.y[[n.centre for n in b]]
        least = cosine_of(np.minimum(ra + rb.max() + self.reach, 2.0))  # no pair below it is near
        step = max(1, TABLE // len(b))
        for at in range(0, len(a), step):
            found = x[at : at + step] @ y.T
            self.compared += found.size
            i, j = np.nonzero(found >= least[at : at + step, None])
            d = np.sqrt(np.maximum(2.0 - 2.0 * found[i, j], 0.0))
            i += at
            both = ra[i] + rb[j]
            close = d <= both + self.reach
            yield from zip(i[close].tolist(), j[close].tolist(), (d + both <= self.within)[close].tolist())


def clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, raw, key1, key2`` of all rows; ``raw`` is the vector as doubles scaled by its largest component, and
    null, like the keys (two hashes that name label and vector), if the row cannot link."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    arrow = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("raw").combine_chunks() if isinstance(batch.column("raw"), pa.ChunkedArray) else batch.column("raw")
            sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(held.flatten(), np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            some = np.flatnonzero(sizes)
            most = np.zeros(len(sizes))
            if len(some):
                most[some] = np.maximum.reduceat(np.abs(flat), (ends - sizes)[some])  # NaN where a component is null or NaN
            with np.errstate(invalid="ignore"):
                good = np.isfinite(most) & (most > 0) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            most[~good] = 1.0
            kept = np.repeat(good, sizes)
            scaled = (flat / np.repeat(most, sizes))[kept] + 0.0  # no negative zeros
            offsets = np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))]).astype(np.int32)
            raw = pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), raw.cast(arrow.field("raw").type)], schema=arrow)

    out = rows.mapInArrow(run, rows.schema)
    return out.select("*", *[F.when(F.col("raw").isNotNull(), F.xxhash64(F.lit(i), "label", "raw")).alias(f"key{i}") for i in (1, 2)])


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda sum_, x: sum_ + x)


def gap(cosine: Column) -> Column:
    """The distance of unit vectors with this cosine."""
    return F.sqrt(F.greatest(2.0 - 2.0 * cosine, F.lit(0.0)))


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(wide: DataFrame) -> DataFrame:
    """``cell, child, centre``: points of each cell's sample, each far from those before it; twice as many as
    would fill a task each, ``CHILDREN`` at most."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf["raw"].tolist())
        most = min(CHILDREN, max(2, math.ceil(2 * pdf["points"].iat[0] / pdf["fit"].iat[0])))
        chosen, nearest = [0], distances(x, x[:1])[:, 0]
        while len(chosen) < most and nearest.max() > SLACK:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(x, x[chosen[-1:]])[:, 0])
        return pd.DataFrame({"cell": pdf["cell"].iat[0], "child": range(len(chosen)), "centre": x[chosen].tolist()})

    share = F.pmod(F.xxhash64("node", F.lit("centres")), F.lit(1 << 40)) / float(1 << 40)
    picked = wide.where(share < PICKED / F.col("points")).select("cell", "raw", "points", "fit")
    return picked.groupBy("cell").applyInPandas(choose, "cell string, child int, centre array<double>")


def cells_of(points: DataFrame, threshold: float, limit: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The top of the cover tree: ``node, cell, raw, size`` of all points; ``cell, points, blocks`` of the leaves; and
    ``a, b``, the pairs of leaves that can hold a link, each once."""
    held = points.select("node", F.concat_ws("|", "label", "n").alias("cell"), "n", "norm", "raw", "size")
    live = held.groupBy("cell", "n").agg(F.count("*").alias("points")).withColumn("radius", F.lit(2.0))
    live = common.written(live.select("cell", "n", "points", "radius", F.lit(None).cast("array<double>").alias("centre"), (F.col("points") > limit).alias("wide")), "cover-cells")
    pairs = live.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    settled: list[DataFrame] = []
    while not live.where("wide").isEmpty():
        wide = live.where("wide").select("cell", "points", limit.cast("double").alias("fit"))
        joined = held.join(wide, "cell")
        chosen = common.written(centres(joined), "cover-centres")
        sets = chosen.groupBy("cell").agg(F.collect_list(F.struct("child", "centre")).alias("set"))  # at most CHILDREN each
        settled.append(held.join(sets.select("cell"), "cell", "left_anti"))
        nearest = F.array_min(F.transform("set", lambda c: F.struct(gap(dot(c["centre"], "raw") / F.col("norm")).alias("away"), c["child"].alias("child"))))
        dealt = held.join(sets, "cell").withColumn("to", nearest)
        dealt = dealt.select("node", F.col("cell").alias("parent"), F.concat_ws(".", "cell", "to.child").alias("cell"), "n", "norm", "raw", "size", F.col("to.away").alias("away"))
        dealt = common.written(dealt, "cover-members")
        named = chosen.select(F.concat_ws(".", "cell", "child").alias("cell"), "centre")
        sizes = dealt.groupBy("parent", "cell", "n").agg(F.count("*").alias("points"), F.max("away").alias("radius"))
        kids = sizes.join(named, "cell").join(wide.select(F.col("cell").alias("parent"), F.col("points").alias("of")), "parent")
        # a child that holds nearly all of its parent is not split again
        again = (F.col("points") > limit) & (F.col("points") < 0.9 * F.col("of")) & (F.col("radius") > 10 * SLACK)
        kids = kids.select("parent", "cell", "n", "points", "radius", "centre", again.alias("wide"))
        rest = live.join(sets.select("cell"), "cell", "left_anti").select(F.col("cell").alias("parent"), "cell", "n", "points", "radius", "centre", F.lit(False).alias("wide"))
        kids = common.written(kids.unionByName(rest), "cover-cells")
        held, live = dealt.drop("parent", "away"), kids.drop("parent")
        pairs = common.written(near_children(pairs, kids, threshold), "cover-pairs")
        log.info("cover tree: %s cells, %s pairs of them left", live.count(), pairs.count())
    members = reduce(DataFrame.unionByName, settled, held).select("node", "cell", "raw", "size")
    return members, live.withColumn("blocks", F.ceil(F.col("points") / limit).cast("int")).select("cell", "points", "blocks"), pairs


def near_children(pairs: DataFrame, kids: DataFrame, threshold: float) -> DataFrame:
    """Pairs of the children of each pair ``a, b`` that are not pruned; a cell that was not split is its own child."""
    side = lambda x: kids.select(F.col("parent").alias(x), F.col("cell").alias(f"cell_{x}"), F.col("radius").alias(f"radius_{x}"), F.col("centre").alias(f"centre_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("a <> b or cell_a <= cell_b")
    close = gap(dot("centre_a", "centre_b")) <= F.col("radius_a") + F.col("radius_b") + reach_of(threshold) + SLACK
    return both.where((F.col("cell_a") == F.col("cell_b")) | close).select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b"))


def block_pairs(pairs: DataFrame, leaves: DataFrame) -> DataFrame:
    """``task, alone, cell, block, side``: both sides of every pair of blocks of paired cells."""
    of = lambda x: leaves.select(F.col("cell").alias(x), F.col("blocks").alias(f"blocks_{x}"))
    out = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)))
    first = F.when(F.col("a") == F.col("b"), F.col("block_a")).otherwise(F.lit(0))
    out = out.withColumn("block_b", F.explode(F.sequence(first, F.col("blocks_b") - 1)))
    out = out.select("a", "block_a", "b", "block_b", F.concat_ws("/", "a", "block_a", "b", "block_b").alias("task"), ((F.col("a") == F.col("b")) & (F.col("block_a") == F.col("block_b"))).alias("alone"))
    left = out.select("task", "alone", F.col("a").alias("cell"), F.col("block_a").alias("block"), F.lit(0).alias("side"))
    return left.unionByName(out.where("not alone").select("task", "alone", F.col("b").alias("cell"), F.col("block_b").alias("block"), F.lit(1).alias("side")))


def solved(dealt: DataFrame, threshold: float) -> DataFrame:
    """``node, other, links``: link counts (``other`` -1) and forests of all tasks."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = bool(pdf["alone"].iat[0])
        if not len(a) or not (same or len(b)):  # a hash may leave a block empty
            return pd.DataFrame({"node": np.empty(0, np.int64), "other": np.empty(0, np.int64), "links": np.empty(0, np.int64)})
        x = unit(a["raw"].tolist())
        y = x if same else unit(b["raw"].tolist())
        size_x = a["size"].to_numpy()
        found = Links(x, y, size_x, size_x if same else b["size"].to_numpy(), same, threshold)
        left = tree(x)
        found.traverse(left, left if same else tree(y))
        names = a["node"].to_numpy() if same else np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()])
        counts = found.count_x if same else np.concatenate([found.count_x, found.count_y])
        some = np.flatnonzero(counts)
        forest = np.array(found.forest, np.int64).reshape(-1, 2)
        return pd.DataFrame({
            "node": np.concatenate([names[some], names[forest[:, 0]]]),
            "other": np.concatenate([np.full(len(some), -1), names[forest[:, 1]]]),
            "links": np.concatenate([counts[some], np.zeros(len(forest), np.int64)]),
        })

    return dealt.groupBy("task").applyInPandas(solve, "node long, other long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """One row per row: ``vec_id, n_links, component_id, kept``.  ``block``: points of a cell that a task takes."""
    rows = clean(vectors, id_col, vector_col, label_col)
    points = rows.where("raw is not null").groupBy("label", "raw", "key1", "key2").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    points = points.select("*", F.size("raw").alias("n"), F.sqrt(dot("raw", "raw")).alias("norm"), F.monotonically_increasing_id().alias("node"))
    points = common.written(points, "cover-points")
    limit = F.lit(block) if block else F.greatest(F.lit(CELL_POINTS), F.lit(CELL_VALUES) / F.col("n"))
    members, leaves, pairs = cells_of(points, threshold, limit)
    sides = common.written(block_pairs(pairs, leaves), "cover-tasks")
    member = members.join(leaves.select("cell", "blocks"), "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = member.join(sides, ["cell", "block"]).select("task", "alone", "side", "node", "size", "raw")
    # tasks differ in work, not in bytes: they are dealt one by one as far as there are partitions
    dealt = dealt.repartition(max(1, min(sides.count(), 4 * vectors.sparkSession.sparkContext.defaultParallelism)), "task")
    found = common.written(solved(dealt, threshold), "cover-links")
    counts = found.where("other < 0").groupBy("node").agg(F.sum("links").alias("links"))
    graph = common.connected_components(found.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = points.select("node", "key1", "key2", "least", "size").join(graph, "node", "left").join(counts, "node", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("size") - 1
    placed = common.written(placed.select("key1", "key2", "least", F.coalesce("component", "node").alias("component"), links.alias("n_links")), "cover-placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(least, "component").select("key1", "key2", "n_links", "component_id")
    out = rows.select("id", "key1", "key2").join(known, ["key1", "key2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op10_cover_tree(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT m.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, m.vec_id = least.component_id AS kept
FROM embeddings m JOIN least ON m.vec_id = least.a LEFT JOIN n ON m.vec_id = n.a
"""
