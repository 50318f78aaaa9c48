"""Exact removal of repeated byte strings with suffix arrays built by induced sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hot import hot_hashes
from .store import discard, release, save

#: Bytes of an anchor, by which windows that may be equal are brought together.
ANCHOR = 32
#: Bytes of text that are sorted in one suffix array, but for a group that has more by itself.
SHARD = 2 << 20
#: Bytes of distinct regions of one anchor that a task sorts; the windows of an anchor with more are compared by their hashes, each as a row.
MOST = 32 << 20
#: Rows of one anchor from which on its equal regions are brought together in parts first.
HOT = 20_000
#: A string of names is sorted by induction again if it has this many kinds or fewer: buckets are then long
#: enough to be filled as arrays. With more kinds, names are paired and named anew until all differ.
FEW_SYMBOLS = 1024


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]])


def _append(sa: np.ndarray, ends: np.ndarray, chars: np.ndarray, items: np.ndarray, step: int) -> None:
    """Put ``items`` at the open ends of the buckets of their ``chars``, in order."""
    order = np.argsort(chars, kind="stable")
    chars, items = chars[order], items[order]
    first = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(chars)]]))
    rank = np.arange(len(chars)) - np.repeat(first, sizes)
    sa[ends[chars] + step * rank] = items
    ends[chars[first]] += step * sizes


def _induce_buckets(s: np.ndarray, small: np.ndarray, heads: np.ndarray, tails: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes that the order of ``lms`` induces, a bucket at a time."""
    sa = np.full(len(s), -1, np.int64)
    chars = s[lms]
    placed = np.bincount(chars, minlength=len(heads))
    at = tails - placed
    _append(sa, at.copy(), chars, lms, 1)
    ends = heads.copy()
    used = np.flatnonzero(tails > heads)

    def spread(items: np.ndarray, kind: bool, step: int) -> None:
        before = items[items > 0] - 1
        before = before[small[before] == kind]
        if len(before):
            _append(sa, ends, s[before], before, step)

    for c in used.tolist():
        done = heads[c]
        while done < ends[c]:
            upto = ends[c]
            spread(sa[done:upto], False, 1)
            done = upto
        spread(sa[at[c]:tails[c]], False, 1)
    larger = ends
    ends = tails - 1
    for c in used[::-1].tolist():
        done = tails[c] - 1
        while done > ends[c]:
            upto = ends[c]
            spread(sa[upto + 1:done + 1][::-1], True, -1)
            done = upto
        spread(sa[heads[c]:larger[c]][::-1], True, -1)
    return sa


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, whose last one is the least and unique.

    As many names as 62 bits hold are sorted as one; then the ranks that these
    suffixes have so far are the names of twice the length, until all differ.
    Only suffixes that are still tied are sorted again.
    """
    m = len(names)
    bits = int(names.max()).bit_length()
    span = max(1, 62 // max(1, bits))
    key = np.zeros(m, np.int64)
    for k in range(span):
        key <<= bits
        if k < m:
            key[:m - k] |= names[k:]
    order = np.argsort(key)
    fresh = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.zeros(m, np.int64)
    while True:
        first = np.maximum.accumulate(np.where(fresh, np.arange(m), 0))
        rank[order] = first
        tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(tied):
            return order
        items = order[tied]
        after = items + span
        key = first[tied] * (m + 1) + np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        moved = np.argsort(key)
        order[tied] = items[moved]
        key = key[moved]
        fresh[tied[1:]] |= key[1:] != key[:-1]
        span *= 2


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of ``s`` in order; its last symbol is 0, which occurs nowhere else.

    Suffixes are classed as smaller or larger than the one that follows. The
    substrings between leftmost smaller ones are sorted by induction and named
    in order; where names repeat, the string of names is sorted by recursion;
    the sorted leftmost smaller suffixes then induce all others in linear time.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(s.astype(np.int64)))
    where = np.where(step != 0, np.arange(n - 1), n)
    turn = np.minimum.accumulate(where[::-1])[::-1]
    small = np.append(step[turn] > 0, True)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    counts = np.bincount(s, minlength=symbols)
    heads = _starts(counts)
    tails = heads + counts
    if len(lms) > 1:
        sa = _induce_buckets(s, small, heads, tails, lms)
        order = sa[is_lms[sa]]
        lengths = np.zeros(n, np.int64)
        lengths[lms] = np.diff(np.append(lms, n - 1)) + 1
        a, b = order[:-1], order[1:]
        equal = lengths[a] == lengths[b]
        open_ = np.flatnonzero(equal)
        offset = 0
        while len(open_):
            differs = s[a[open_] + offset] != s[b[open_] + offset]
            equal[open_[differs]] = False
            offset += 1
            open_ = open_[~differs]
            open_ = open_[lengths[a[open_]] > offset]
        names = np.zeros(n, np.int64)
        names[order] = np.concatenate([[0], np.cumsum(~equal)])
        reduced = names[lms]
        kinds = int(reduced.max()) + 1
        if kinds == len(lms):
            lms = lms[np.argsort(reduced)]
        else:
            lms = lms[suffix_array(reduced, kinds) if kinds <= FEW_SYMBOLS else _order_of_names(reduced)]
    return _induce_buckets(s, small, heads, tails, lms)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, least: int) -> np.ndarray:
    """For each position in text order, its common prefix with the suffix before it in ``sa``.

    Where the suffix before moves on with the position, the prefix is one
    shorter; only the heads of such runs are compared. Values are exact below
    ``least`` and at least ``least`` otherwise. ``text`` holds bytes.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    heads = np.flatnonzero(~follows)
    runs = np.diff(np.append(heads, n))
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    prefix = np.zeros(len(heads), np.int64)
    open_ = np.flatnonzero(before[heads] >= 0)
    while len(open_):
        i = heads[open_] + prefix[open_]
        j = before[heads[open_]] + prefix[open_]
        inside = (i < n) & (j < n)
        open_, i, j = open_[inside], i[inside], j[inside]
        mixed = words[i] ^ words[j]
        same = mixed == 0
        low = mixed[~same]
        low &= ~low + np.uint64(1)
        prefix[open_[~same]] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        prefix[open_[same]] += 8
        open_ = open_[same]
        open_ = open_[prefix[open_] < runs[open_] + least]
    offset = np.arange(n) - np.repeat(heads, runs)
    return np.maximum(np.repeat(prefix, runs) - offset, 0)


def repeated_starts(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region the starts whose ``length`` bytes also start elsewhere in these regions."""
    parts = [np.frombuffer(r, np.uint8) for r in regions]
    gap = np.zeros(1, np.uint8)
    text = np.concatenate([x for p in parts for x in (p, gap)])
    s = text.astype(np.int64) + 2
    stops = np.cumsum([len(p) + 1 for p in parts])
    s[stops - 1] = 1
    s = np.append(s, 0)
    sa = suffix_array(s, 258)[1:]
    at_end = np.zeros(len(text), bool)
    starts = stops - np.array([len(p) + 1 for p in parts])
    whole = np.zeros(len(text) + 1, np.int64)
    lengths = np.array([len(p) for p in parts])
    fits = lengths >= length
    np.add.at(whole, starts[fits], 1)
    np.add.at(whole, stops[fits] - length, -1)
    valid = np.cumsum(whole)[:-1] > 0
    at_end[stops - 1] = True
    # bytes stand for the symbols in comparisons: a window that fits has no separator, and then neither has its equal
    prefixes = permuted_common_prefixes(text, sa, length)
    run = np.cumsum(prefixes[sa] < length)
    sorted_valid = valid[sa]
    sizes = np.bincount(run[sorted_valid], minlength=int(run[-1]) + 1)
    hit = np.zeros(len(text), bool)
    hit[sa[sorted_valid & (sizes[run] > 1)]] = True
    return [np.flatnonzero(hit[a:b]) for a, b in zip(starts, stops)]


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)

    def up(x: int) -> np.ndarray:
        out = np.full(size, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return up(base), up(inverse)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: blocks are scanned from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(-1, width)
    fore = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], fore[width - 1:n])


def anchors(data: bytes, length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): windows ``first`` to ``last`` have their least anchor, of this hash, at one place.

    Each window of ``length`` bytes takes the last of its least anchor hashes,
    so it depends on its own bytes alone and equal windows have equal hashes.
    """
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    size = 1 << max(17, (n + 1).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[anchor:] - sums[:-anchor]) * inverse[:n - anchor + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    width = length - anchor + 1
    least = sliding_least(h, width)
    # the last place of the least hash in each window: places of the least of some window, searched backwards
    spread = ~sliding_least(~np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
    places = np.flatnonzero(spread == h)
    pick = np.searchsorted(places, np.arange(width - 1, width - 1 + len(least)), "right") - 1
    open_ = np.flatnonzero(h[places[pick]] != least)
    while len(open_):
        pick[open_] -= 1
        open_ = open_[h[places[pick[open_]]] != least[open_]]
    first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    last = np.append(first[1:], len(pick)) - 1
    return h[places[pick[first]]], first, last


#: What :func:`_mark` gives for a row: repeated windows, a region that is to be compared further, or a window by its hash.
SPAN, REGION, WINDOW = 0, 1, 2


def _mark(rows: Iterator[tuple], length: int, most: int) -> Iterator[tuple]:
    """(kind, doc, mark, first, last, alone, h, x, y, region) from rows (k, h, doc, mark, first, last, parts, alone, region) in order of (k, h, region).

    Windows of a region that occurs twice or more are repeated as they stand, so
    only its first copy is kept for the others, as not alone any more; suffix arrays over the distinct regions of
    an anchor find the rest. In a part of a hot anchor each distinct region goes on. If those of an anchor are over ``most``
    bytes, each window goes on by 128 bits of its hash.
    """
    from xxhash import xxh3_128_intdigest

    shard: list[list] = []
    size = 0

    def flush() -> Iterator[tuple]:
        for (_, doc, mark, first, alone, region), hits in zip(shard, repeated_starts([r[5] for r in shard], length)):
            if alone and len(hits):
                cut = np.flatnonzero(np.diff(hits) > 1)
                for lo, hi in zip(np.append(hits[0], hits[cut + 1]), np.append(hits[cut], hits[-1])):
                    yield SPAN, doc, mark, first + int(lo), first + int(hi), True, None, None, None, None

    def onward(whole: bool) -> Iterator[tuple]:
        for h, doc, mark, first, alone, region in group:
            if whole:
                yield REGION, doc, mark, first, first + len(region) - length, alone, h, None, None, region
            else:
                for i in range(len(region) - length + 1):
                    x, y = divmod(xxh3_128_intdigest(region[i:i + length]), 1 << 64)
                    yield WINDOW, doc, mark, first + i, first + i, alone, None, x - (1 << 63), y - (1 << 63), None

    group: list[list] = []
    now, held, parted, spilt = None, 0, False, False

    def close() -> Iterator[tuple]:
        nonlocal shard, size
        if parted or spilt:
            yield from onward(parted)
        elif len(group) > 1:
            shard += group
            size += held
            if size >= SHARD:
                yield from flush()
                shard, size = [], 0

    for k, h, doc, mark, first, last, parts, alone, region in rows:
        if (k, h) != now:
            yield from close()
            group, now, held, parted, spilt = [], (k, h), 0, parts > 0, False
        if group and group[-1][5] == region:
            before = group[-1]
            if before[4]:
                before[4] = False
                yield SPAN, before[1], before[2], before[3], before[3] + len(region) - length, True, None, None, None, None
            if alone:
                yield SPAN, doc, mark, first, last, True, None, None, None, None
        else:
            if parted or held > most:
                spilt = True
                yield from onward(parted)
                group = []
            group.append([h, doc, mark, first, alone, region])
            held += len(region)
    yield from close()
    if shard:
        yield from flush()


#: The rows of :func:`_mark`.
MARKS = "kind int, doc long, mark long, first int, last int, alone boolean, h long, x long, y long, region binary"


def repeated_spans(docs: DataFrame, length: int = 200, hot: int = HOT, most: int = MOST) -> DataFrame:
    """(doc, mark, first, last): windows ``first`` to ``last`` of a text also start elsewhere.

    ``docs`` has (doc, mark, text), where doc and mark (a hash of the text) tell
    texts apart. Windows are grouped by the hash of their least anchor. Anchors
    that occur once are dropped before any text is shuffled; the windows of each
    other anchor go, as one region of text, to the task of its hash. Each window
    is in one region, and equal windows are in regions of one group, so shards of whole groups lose no repeat.
    All windows of equal texts (128 bits of hash and the size) are repeated, and only the text of the smallest doc is compared with others.

    The regions of an anchor with over ``hot`` rows go to the tasks by their own content and a part of the
    documents, so that equal ones, as copies make them, are told in many tasks; what is left, a few of each
    distinct region, goes to the anchor's task. If the distinct ones are over ``most`` bytes, their windows are compared
    as rows, by 128 bits of their hashes. So no task holds more than that.
    """

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(anchors(t.as_py().encode(), length)[0] for t in batch.column(2))]).view(np.int64)

    often = hot_hashes(docs, hashes, hot)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t.as_py().encode(), length) for t in batch.column(2)]
            rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            if not len(rows):
                continue
            h, first, last = (np.concatenate([f[i] for f in found]) for i in range(3))
            h = h.view(np.int64)
            keys = batch.select([0, 1]).take(pa.array(rows))
            part = often.part(h, np.asarray(batch.column(0))[rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(part), *keys.columns, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                ["h", "part", "doc", "mark", "first", "last"])

    thin = docs.select("doc", "mark", F.xxhash64("text", F.lit(1)).alias("check"), F.octet_length("text").alias("size")).where(F.col("size") >= length)
    classes = save(thin.groupBy("mark", "check", "size").agg(F.min("doc").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    members = thin.join(classes, ["mark", "check", "size"])
    copies = save(members.select("doc", "mark", F.lit(0).alias("first"), (F.col("size") - length).cast("int").alias("last"), (F.col("doc") != F.col("keep")).alias("other")).distinct(), "copies")
    found = docs.mapInArrow(scan, "h long, part int, doc long, mark long, first int, last int").repartition("h", "part").withColumn(
        "n", F.count("*").over(Window.partitionBy("h", "part")))
    # all hot hashes have as many parts as the most frequent one of the sample, others that turn out to be hot what their rows ask for
    most_parts = F.lit(int(often.parts.max()) if often else 0)
    parts = F.when(F.col("part") > 0, most_parts).when(F.col("n") > hot, F.ceil(F.col("n") / F.lit(hot))).otherwise(0).cast("int").alias("parts")
    places = save(
        found.where("n > 1 or part > 0").groupBy("doc", "mark").agg(F.array_distinct(F.collect_list(F.struct("h", "first", "last", parts))).alias("places"))
        .join(copies.where("other").select("doc", "mark"), ["doc", "mark"], "left_anti"),
        "anchors",
    )
    release(docs.sparkSession)

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, mark, text, found in zip(*(batch.column(i) for i in range(4))):
                data = text.as_py().encode()
                own = found.values
                h, first, last, parts = (own.field(i) for i in range(4))
                n = len(h)
                yield pa.RecordBatch.from_arrays(
                    [h, pa.repeat(doc, n), pa.repeat(mark, n), first, last, parts,
                     pa.array([data[a:b + length] for a, b in zip(first.to_pylist(), last.to_pylist())], pa.binary())],
                    ["h", "doc", "mark", "first", "last", "parts", "region"])

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [c.split(" ")[0] for c in MARKS.split(", ")]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for row in _mark(rows, length, most):
            out.append(row)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    def compared(regions: DataFrame) -> DataFrame:
        placed = regions.select("k", "h", "doc", "mark", "first", "last", "parts", "alone", "region")
        return save(placed.repartition("k").sortWithinPartitions("k", "h", "region").mapInArrow(marked, MARKS), "repeats")

    cut = docs.join(places, ["doc", "mark"]).select("doc", "mark", "text", "places").mapInArrow(
        regions, "h long, doc long, mark long, first int, last int, parts int, region binary")
    key = F.when(F.col("parts") > 0, F.xxhash64("h", "region", F.pmod(F.xxhash64("doc"), F.col("parts")))).otherwise(F.col("h"))
    found = compared(cut.withColumns({"k": key, "alone": F.lit(True)}))
    discard(places)
    release(docs.sparkSession)
    further = found.where(f"kind = {REGION}")
    if not further.isEmpty():
        found = found.union(compared(further.withColumns({"k": F.col("h"), "parts": F.lit(0)})))
    spans = found.where(f"kind = {SPAN}").select("doc", "mark", "first", "last")
    windows = found.where(f"kind = {WINDOW}").select("doc", "mark", "first", "last", "alone", "x", "y")
    if not windows.isEmpty():
        twice = windows.withColumn("n", F.count("*").over(Window.partitionBy("x", "y"))).where("n > 1 and alone")
        spans = spans.union(twice.select("doc", "mark", "first", "last"))
    return spans.union(copies.select("doc", "mark", "first", "last"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Texts are UTF-8 bytes. Every byte is removed that lies in a string of
    ``length`` bytes which also starts anywhere else, in this or another
    document, judged on the input. Null texts count as empty; very long texts are
    taken whole, their windows dealt to shards like those of many short ones. Repeated rows
    count as other documents, so they remove each other if they are long enough. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("mark"), "text")
    found = repeated_spans(rows.select("doc", "mark", "text"), length)
    spans = found.groupBy("doc", "mark").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, n, shas = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py().encode()
                kept, at, gone, runs = [], 0, 0, 0
                for s in found or ():
                    lo, hi = s["first"], s["last"] + length
                    if lo > at or not runs:
                        kept.append(data[at:lo])
                        runs += 1
                        gone += hi - lo
                    else:
                        gone += max(0, hi - at)
                    at = max(at, hi)
                kept.append(data[at:])
                sizes.append(len(data))
                removed.append(gone)
                n.append(runs)
                shas.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(shas, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.join(spans, ["doc", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
