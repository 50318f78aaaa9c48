"""Exact cosine-threshold links between vectors by dual traversal of cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .simhash import groups
from .store import save

#: Nodes of this many points or fewer aren't split further and are compared as blocks.
LEAF = 64
#: Points that look for their neighbours at once while a net is laid.
BLOCK = 64
#: Slack of the bounds against rounding; links themselves are decided by the cosine alone.
SLACK = 1e-9
#: The same for distances that come from products, whose roots are less exact.
WIDE_SLACK = 1e-6
#: Bytes of all pivots together, as they go to every task.
PIVOT_BYTES = 64 << 20
#: Vectors whose distances to the pivots are worked out at once.
ROWS = 256


@dataclass
class Node:
    """A ball around a point; its children are balls of half its radius or less around points that lie further apart than that.

    ``points`` are all points below it, ``singles`` those of its children that hold one point alone.
    """

    center: np.ndarray
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)
    singles: np.ndarray | None = None

    @property
    def leaf(self) -> bool:
        return self.singles is None


def _net(units: np.ndarray, points: np.ndarray, radius: float) -> list[np.ndarray]:
    """``points`` by their centers, first: points over ``radius`` apart that cover the others; each goes to the first that covers it."""
    out, left = [], points
    while len(left):
        block = left[:BLOCK]
        near = 2 - 2 * (units[block] @ units[left].T) <= radius * radius
        near[np.arange(len(block)), np.arange(len(block))] = True
        taken = np.zeros(len(left), bool)
        for i in range(len(block)):
            if not taken[i]:
                own = near[i] & ~taken
                taken |= own
                own[i] = False
                out.append(np.concatenate([left[i:i + 1], left[own]]))
        left = left[~taken]
    return out


def cover_tree(units: np.ndarray, points: np.ndarray) -> Node:
    """Nested nodes over ``points``: each level halves the radius, is separated by it, and keeps a node's true covering radius.

    A node's center is the center of its first child too, so the levels are nested.
    """
    center = units[points[0]]
    node = Node(center, float(np.linalg.norm(units[points] - center, axis=1).max()), points)
    if len(points) > LEAF and node.radius > WIDE_SLACK:
        groups_ = _net(units, points, node.radius / 2)
        node.singles = np.array([g[0] for g in groups_ if len(g) == 1], np.int64)
        node.children = [cover_tree(units, g) for g in groups_ if len(g) > 1]
    return node


class Links:
    """Counts of links per point and the components that they make, within one task."""

    HELD = 1 << 20

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.counts = np.zeros(len(weights), np.int64)
        self.root = np.arange(len(weights))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> None:
        """``mask`` says which of ``a`` x ``b`` are linked; each pair comes once."""
        self.counts[a] += mask @ self.weights[b]
        self.counts[b] += mask.T @ self.weights[a]
        i, j = np.nonzero(mask)
        self.join(a[i], b[j])

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        self.held.append((u, v))
        self.n += len(u)
        if self.n >= self.HELD:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            u, v = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.n = [], 0
            root = self.root
            while True:
                a, b = root[u], root[v]
                open_ = a != b
                if not open_.any():
                    break
                u, v, a, b = u[open_], v[open_], a[open_], b[open_]
                low = np.minimum(a, b)
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                while (root[root] != root).any():
                    root[:] = root[root]
        return self.root


def traverse(units: np.ndarray, left: Node, right: Node, links: Links, cosine: float) -> None:
    """Links between the points of two trees, or within one tree where both are the same node.

    A pair of nodes is left out if even their nearest points could not be
    linked, and counted whole if even their farthest points must be; otherwise
    the wider one gives way to its children. Points that are children alone go down the other tree together.
    """
    reach = math.sqrt(2 - 2 * cosine)

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        if len(a) and len(b):
            links.add(a, b, units[a] @ units[b].T >= cosine)

    def within(a: np.ndarray) -> None:
        if len(a) > 1:
            links.add(a, a, np.triu(units[a] @ units[a].T >= cosine, 1))

    def whole(a: np.ndarray, b: np.ndarray) -> None:
        links.counts[a] += links.weights[b].sum()
        links.counts[b] += links.weights[a].sum()
        links.join(a, np.full(len(a), b[0]))
        links.join(b, np.full(len(b), a[0]))

    def descend(singles: np.ndarray, node: Node) -> None:
        if not len(singles):
            return
        gaps = np.linalg.norm(units[singles] - node.center, axis=1)
        inside = gaps + node.radius < reach - SLACK
        if inside.any():
            whole(singles[inside], node.points)
        singles = singles[(gaps <= node.radius + reach + SLACK) & ~inside]
        if node.leaf:
            compare(singles, node.points)
        else:
            compare(singles, node.singles)
            for child in node.children:
                descend(singles, child)

    stack = [(left, right)]
    while stack:
        a, b = stack.pop()
        if a is b:
            if a.leaf:
                within(a.points)
            else:
                within(a.singles)
                for child in a.children:
                    descend(a.singles, child)
                stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
            continue
        gap = float(np.linalg.norm(a.center - b.center))
        if gap > a.radius + b.radius + reach + SLACK:
            continue
        if gap + a.radius + b.radius < reach - SLACK:
            whole(a.points, b.points)
        elif a.leaf and b.leaf:
            compare(a.points, b.points)
        elif b.leaf or not a.leaf and a.radius >= b.radius:
            descend(a.singles, b)
            stack += [(x, b) for x in a.children]
        else:
            descend(b.singles, a)
            stack += [(a, y) for y in b.children]


def _units(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _class_links(classes: DataFrame, cosine: float, cells: int | None, shard_size: int) -> DataFrame:
    """(rep, links, root): partial counts of linked vectors, and spanning links, for distinct vectors.

    ``classes`` has (rep, n, label, unit). The top of the trees is spread over
    the cluster: the pivots are a sample of one in ``shard_size`` vectors, 256 at
    least and no more than PIVOT_BYTES hold. A vector belongs to its label's
    nearest pivot. It also meets another cell of the label, unless it is farther
    from that cell than its covering radius and a link, or farther from its pivot
    than from its own by twice a link. Cells
    of more than ``shard_size`` vectors are dealt over several trees, and each
    two of them are compared in a task.
    """
    reach = math.sqrt(2 - 2 * cosine)
    if cells is None:
        shape = classes.agg(F.count("*"), F.max(F.size("unit"))).first()
        cells = max(1, min(max(256, shape[0] // shard_size), PIVOT_BYTES // (8 * (shape[1] or 1))))
    picked = classes.orderBy(F.xxhash64("rep"), "rep").limit(cells).select("label", "unit").collect()
    pivots: dict[tuple[str, int], list[tuple[int, list[float]]]] = {}
    for i, p in enumerate(picked):
        pivots.setdefault((p.label, len(p.unit)), []).append((i, p.unit))
    table = {k: (np.array([i for i, _ in v]), np.array([u for _, u in v])) for k, v in pivots.items()}

    def by_label(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids of their label's pivots, distances) for the rows of each label and width."""
        units = batch.column("unit")
        widths = np.diff(units.offsets.to_numpy())
        keys = list(zip(batch.column("label").to_pylist(), widths.tolist()))
        rows: dict[tuple[str, int], list[int]] = {}
        for i, key in enumerate(keys):
            rows.setdefault(key, []).append(i)
        for (label, width), found in rows.items():
            ids, centers = table.get((label, width), (np.array([-1]), None))
            if centers is None:
                yield np.array(found), ids, np.zeros((len(found), 1))
            else:
                own = _units(units.take(pa.array(found)), width)
                for at in range(0, len(found), ROWS):
                    gaps = np.sqrt(np.maximum(0.0, 2 - 2 * (own[at:at + ROWS] @ centers.T)))
                    yield np.array(found[at:at + ROWS]), ids, gaps

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, gap = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for rows, ids, gaps in by_label(batch):
                near = gaps.argmin(axis=1)
                cell[rows], gap[rows] = ids[near], gaps[np.arange(len(rows)), near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], [*batch.schema.names, "cell", "gap"])

    kinds = "rep long, n long, label string, unit array<double>"
    placed = save(classes.select("rep", "n", "label", "unit").mapInArrow(assign, kinds + ", cell int, gap double"), "vectors-placed")
    radii = {r.cell: r.radius for r in placed.where("cell >= 0").groupBy("cell").agg(F.max("gap").alias("radius")).collect()}
    most = np.array([radii.get(i, -3.0) for i in range(len(picked))] + [-3.0])  # the last one is that of cell -1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, gap = np.asarray(batch.column("cell")), np.asarray(batch.column("gap"))
            rest = batch.select([c for c in batch.schema.names if c != "gap"])
            for rows, ids, gaps in by_label(batch):
                met = (gaps <= most[ids] + reach + WIDE_SLACK) & (gaps <= gap[rows][:, None] + 2 * reach + WIDE_SLACK)
                i, j = np.nonzero(met | (ids == cell[rows][:, None]))
                for at in range(0, len(i), 16 * ROWS):
                    out = rest.take(pa.array(rows[i[at:at + 16 * ROWS]]))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(ids[j[at:at + 16 * ROWS]].astype(np.int32))], [*out.schema.names, "other"])

    wide = F.size("unit")
    met = placed.mapInArrow(meet, kinds + ", cell int, other int").withColumn("width", wide)
    shards = F.ceil(F.count("*") / F.lit(shard_size)).cast("int")
    sizes = placed.groupBy("label", "cell", wide.alias("width")).agg(shards.alias("shards"))
    dealt = (
        met.join(sizes, ["label", "cell", "width"])
        .join(sizes.select("label", "width", F.col("cell").alias("other"), F.col("shards").alias("others")), ["label", "width", "other"])
        .withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
        .withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .withColumn("forth", F.struct("cell", "shard") <= F.struct(F.col("other").alias("cell"), F.col("facing").alias("shard")))
        .select(
            "label", "width",
            F.when(F.col("forth"), F.col("cell")).otherwise(F.col("other")).alias("a"),
            F.when(F.col("forth"), F.col("shard")).otherwise(F.col("facing")).alias("i"),
            F.when(F.col("forth"), F.col("other")).otherwise(F.col("cell")).alias("b"),
            F.when(F.col("forth"), F.col("facing")).otherwise(F.col("shard")).alias("j"),
            "forth", "rep", "n", "unit",
        )
    )
    keys = ["label", "width", "a", "i", "b", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, keys):
            same = group["a"][0] == group["b"][0] and group["i"][0] == group["j"][0]
            units = _units(group["unit"].combine_chunks(), group["width"][0].as_py())
            links = Links(group["n"].to_numpy())
            reps = group["rep"].to_numpy()
            forth = group["forth"].to_numpy()
            left, right = np.flatnonzero(forth), np.flatnonzero(~forth)
            if same:
                tree = cover_tree(units, np.arange(len(units)))
                traverse(units, tree, tree, links, cosine)
            elif len(left) and len(right):
                traverse(units, cover_tree(units, left), cover_tree(units, right), links, cosine)
            root = links.settle()
            hit = np.flatnonzero(links.counts)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps[hit]), pa.array(links.counts[hit]), pa.array(reps[root[hit]])], ["rep", "links", "root"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, links long, root long")


def embedding_links(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", cells: int | None = None, shard_size: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows of the same label and width are linked if the cosine, in double
    precision, is ``cosine`` or more. Equal vectors form a class that is compared once and
    counted by its size. A vector that is null, empty, zero, or has a null or
    non-finite component, and a row with a null label or id, links with nothing
    and is its own component. Repeated rows count as other vectors. Columns
    besides the three are ignored; an empty table gives no rows. A label is
    compared as a whole, so one that holds most vectors is spread by its cells; what is
    close to all pairs of a dense cell that isn't within one link's reach costs as many comparisons.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    scale = F.array_max(F.transform("vector", F.abs))
    scaled = F.transform("vector", lambda x: x / scale)
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda acc, x: acc + x * x))
    classes = save(
        rows.where(usable).groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
        .withColumn("scaled", scaled).withColumn("norm", norm)
        .select("rep", "n", "label", "vector", F.transform("scaled", lambda x: x / F.col("norm")).alias("unit")),
        "vector-classes",
    )
    partial = save(_class_links(classes, cosine, cells, shard_size), "vector-links")
    counts = partial.groupBy("rep").agg(F.sum("links").alias("links"))
    found = connected_components(partial.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    labelled = (
        classes.join(counts, "rep", "left").join(found, classes.rep == found.node, "left")
        .select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    linked = rows.where(usable).join(labelled, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long"), "vec_id")
    return linked.union(alone).toDF("vec_id", "n_links", "component_id").withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
