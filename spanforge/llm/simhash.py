"""SimHash near-duplicate groups, found with BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .store import save

BITS = 64
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of ``text``, repeats included.

    Words are the runs without ASCII white space, A-Z in lower case. A text
    with fewer words than a shingle is one shingle; one without words has none.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        parts: Iterable[bytes] = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none give 0."""
    n = len(hashes)
    # eight counters side by side in a 64-bit word: no more than 255 hashes fill one
    rows = max(1, -(-n // 255))
    padded = np.zeros(rows * 255, np.uint64)
    padded[:n] = hashes
    padded = padded.reshape(rows, 255)
    result = 0
    for low in range(8):
        lanes = ((padded >> np.uint64(low)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.astype("<u8").view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            result |= 1 << (8 * int(byte) + low)
    return result


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of ``text``."""
    return majority_bits(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


class BKTree:
    """Values under integer Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = [value, item, {}]
            return
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = [value, item, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            at, item, children = stack.pop()
            d = (value ^ at).bit_count()
            if d <= radius:
                yield item
            for k, child in children.items():
                if d - radius <= k <= d + radius:
                    stack.append(child)


class Joined:
    """Components of a shard's members, as a forest."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)

    def star(self, nodes: list[int]) -> list[tuple[int, int]]:
        """An edge to its component's root for each other member."""
        return [(nodes[i], nodes[r]) for i in range(len(nodes)) if (r := self.find(i)) != i]


def _shard_links(fps: list[int], nodes: list[int], left: list[bool] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning star per local component of the links within a shard, or between two."""
    joined, tree = Joined(len(fps)), BKTree()
    if left is not None:
        for i, is_left in enumerate(left):
            if is_left:
                tree.add(fps[i], i)
    for i, value in enumerate(fps):
        if left is None or not left[i]:
            for j in tree.within(value, radius):
                joined.join(i, j)
        if left is None:
            tree.add(value, i)
    return joined.star(nodes)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in batches that are sorted by them, each run whole."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [np.asarray(batch.column(k)) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.concat_tables(held)


def links(classes: DataFrame, radius: int = 2, shard_size: int = 4096) -> DataFrame:
    """Edges (u, v) that span the links between fingerprints at ``radius`` or fewer bits.

    ``classes`` has one row (fp, rep) for each distinct fingerprint. Two values
    within the radius agree on one of radius + 1 blocks of bits at least, so the
    (block, value) pairs are the shards: each gets a BK-tree, and only the edges
    within the radius are followed. Trees go to the tasks by the shuffle, as
    their number grows with the data. A shard of more than ``shard_size`` values
    is dealt over several trees, and each two of them are compared in a task.
    """
    ends = [BITS * i // (radius + 1) for i in range(radius + 2)]
    blocks = F.array(*(
        F.struct(
            F.lit(i).alias("block"),
            F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"),
        )
        for i, (lo, hi) in enumerate(zip(ends, ends[1:]))
    ))
    keyed = classes.where("rep is not null").select("fp", "rep", F.inline(blocks))
    sizes = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / F.lit(shard_size)).cast("int")
    dealt = (
        keyed.join(sizes, ["block", "value"])
        .withColumn("shard", F.pmod(F.xxhash64("fp"), shards).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), shards - 1)))
        .select(
            "block", "value", "fp", "rep",
            F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard",
        )
    )
    keys = ["block", "value", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []
        for table in groups(batches, keys):
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            fps = table["fp"].to_numpy().view(np.uint64).tolist()
            nodes = table["rep"].to_pylist()
            left = None if i == j else (table["shard"].to_numpy() == i).tolist()
            for a, b in _shard_links(fps, nodes, left, radius):
                u.append(a)
                v.append(b)
            if len(u) >= 50_000:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
                u, v = [], []
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       radius: int = 2, shingle: int = 3, shard_size: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Equal fingerprints are one class with the smallest doc_id as its node, so
    copies are never compared with each other; ``component_id`` is the smallest
    doc_id that links of ``radius`` or fewer differing bits reach.

    Null and empty texts and those of white space alone have fingerprint zero
    and link like any other. Repeated rows stay as many. A row without doc_id
    gets the component of its fingerprint. Very long texts are fingerprinted whole, in one task each. Columns besides id and text are
    ignored, whatever their names. An empty table gives no rows.
    """
    fps = save(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    found = connected_components(links(classes, radius, shard_size))
    labelled = classes.join(found, classes.rep == found.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(labelled, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _dealt(keyed: DataFrame, keys: list[str], shard_size: int) -> DataFrame:
    """Rows of shards of two or more, each once for every pair (i, j) of the parts of ``shard_size`` that its shard is dealt to.

    Of shards with the same members (the number of them and two 64-bit hashes
    are equal) one is kept: a group of copies shares most of its keys.
    """
    members = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")]
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("n"), *members).where("n > 1")
    sizes = sizes.groupBy("n", "x", "y").agg(F.min(F.struct(*keys)).alias("s")).select("s.*", "n")
    parts = F.ceil(F.col("n") / F.lit(shard_size)).cast("int")
    return (
        keyed.join(sizes, keys)
        .withColumn("shard", F.pmod(F.xxhash64("rep"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumns({"i": F.least("shard", "other"), "j": F.greatest("shard", "other")}).drop("n", "other")
    )


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


#: Sets of fewer shingles than FEW have SimHashes that tell little: their similar pairs are taken within FEW_RADIUS bits.
FEW, FEW_RADIUS = 40, 40


def _similar_links(fps: list[int], sets: list[np.ndarray], nodes: list[int], radius: int, similarity: float) -> list[tuple[int, int]]:
    """As :func:`_shard_links`, for pairs within the radius whose shingle sets are similar.

    The tree holds leaders, which are not similar to each other; any other
    member follows the first leader that it is similar to. A new member meets the leaders within
    twice the radius, as a link to the leader's follower and one from there on are of one radius each, and the followers of those leaders that it is
    less similar to, but not so far from that a follower couldn't
    be similar to it: the Jaccard distance is a metric, so that is up to twice the distance of similar sets (and a hair, as that is a sum of doubles).
    Followers of its own component are passed over. So a group of like texts costs a comparison for each member and not each pair.
    For a set that may be similar to one of under FEW shingles, the radius is FEW_RADIUS or more.
    """
    joined, tree = Joined(len(fps)), BKTree()
    followers: dict[int, list[int]] = {}
    least = 1 - 2 * (1 - similarity) - 1e-9
    for i, value in enumerate(fps):
        leader, ring = None, []
        reach = max(radius, FEW_RADIUS) if len(sets[i]) * similarity < FEW else radius
        for j in tree.within(value, 2 * reach):
            near = (value ^ fps[j]).bit_count() <= reach
            if near or followers[j]:
                alike = _jaccard(sets[i], sets[j])
                if near and alike >= similarity:
                    joined.join(i, j)
                    leader = j if leader is None else leader
                if alike >= least and followers[j]:
                    ring.append(j)
        for j in ring:
            for k in followers[j]:
                if joined.find(i) != joined.find(k) and (value ^ fps[k]).bit_count() <= reach and _jaccard(sets[i], sets[k]) >= similarity:
                    joined.join(i, k)
        if leader is None:
            tree.add(value, i)
            followers[i] = []
        else:
            followers[leader].append(i)
    return joined.star(nodes)


def similar_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 18, n_keys: int = 4,
                       id_col: str = "doc_id", text_col: str = "text", shard_size: int = 4096) -> DataFrame:
    """(doc_id, component_id): groups of texts whose sets of word shingles have a Jaccard index of ``similarity`` or more.

    At 0.8 two SimHashes, here of the sets as repeats don't count, differ in about
    ten of 64 bits, too many for blocks of equal bits. The shards of the BK-trees are here the texts that share one of
    ``n_keys`` least shingle hashes, each under its own permutation: similar
    texts share none with a chance of (1 - similarity) ** n_keys, 0.16 %. The
    tree gives the shard's pairs within ``radius`` bits, and their sets decide (see :func:`_similar_links`).
    What a pair of sets at the threshold is lost by: no key in common, (1 - similarity) ** n_keys, and over ``radius`` bits,
    .2 % (sets of under 40 shingles are taken within 40 bits).

    Equal texts are one class. Texts without words form one group too; null texts
    count as such. Very long texts are taken whole: their shingle hashes go to at most ``n_keys`` shards. Rows without id get their class's component; no rows give none.
    """
    mixers = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1) for k in range(n_keys)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for t in batch.column(2):
                h = shingle_hashes(t.as_py(), shingle)
                fps.append(majority_bits(np.unique(h)))
                if len(h):
                    mixed = [h * m for m in mixers]
                    keys.append([int((x ^ (x >> np.uint64(32))).min().view(np.int64)) for x in mixed])
                else:
                    keys.append([0] * n_keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "mark", "fp", "keys"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("mark"), "text")
    rows = save(texts.mapInArrow(sketch, "doc_id long, mark long, fp long, keys array<long>"), "sketches")
    classes = save(rows.groupBy("mark", "fp").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "sketch-classes")
    keyed = classes.where("rep is not null").select("rep", "mark", "fp", F.posexplode("keys").alias("k", "value"))
    dealt = _dealt(keyed, ["k", "value"], shard_size)
    at = F.struct("k", "value", "i", "j", "shard", "fp")
    wanted = dealt.groupBy(F.col("rep").alias("doc_id"), "mark").agg(F.collect_list(at).alias("shards"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, shards in zip(*(batch.column(i) for i in range(3))):
                own = np.unique((shingle_hashes(text.as_py(), shingle) >> np.uint64(32)).astype(np.uint32)).view(np.int32)
                at = shards.values
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [*(at.field(c) for c in ("k", "value", "i", "j", "shard", "fp")), pa.repeat(doc, n), pa.array([own] * n, pa.list_(pa.int32()))],
                    ["k", "value", "i", "j", "shard", "fp", "rep", "own"])

    keys = ["k", "value", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[int] = []
        v: list[int] = []
        for table in groups(batches, keys):
            fps = table["fp"].to_numpy().view(np.uint64).tolist()
            sets = [np.asarray(x.values).view(np.uint32) for x in table["own"]]
            for a, b in _similar_links(fps, sets, table["rep"].to_pylist(), radius, similarity):
                u.append(a)
                v.append(b)
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    shards = texts.where("doc_id is not null").join(wanted, ["doc_id", "mark"]).select("doc_id", "text", "shards").mapInArrow(
        spread, "k int, value long, i int, j int, shard int, fp long, rep long, own array<int>")
    links_ = shards.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")
    found = connected_components(links_)
    labelled = classes.join(found, classes.rep == found.node, "left").select("mark", "fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(labelled, ["mark", "fp"]).select("doc_id", "component_id")
