"""Order MinHash fingerprints of texts, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Low bits of a packed k-mer that hold its position; a string of 2 GB has no more words.
POSITION = 30
#: Bins of the element hash: each gives a component of the signature.
BIN_BITS = 6
#: Elements that a component is made of.
TUPLE = 2
#: Longest run without white space that counts as one word; longer ones count by their overlapping character runs.
WORD = 24
#: Characters of such a run.
GRAM = 4
#: Steps of the search for a k-mer's occurrence number, longest first.
_STEPS = "transform(sequence(29, 0, -1), s -> shiftleft(1, s))"


def _key(x: Column) -> Column:
    return F.shiftrightunsigned(x, POSITION)


def _occurrence(kmers: Column, x: Column, i: Column) -> Column:
    """How many equal k-mers come before the one at ``i`` of the sorted array."""
    same = lambda back: F.coalesce(_key(F.get(kmers, i - back)) == _key(x), F.lit(False))
    run = F.aggregate(
        F.expr(_STEPS), F.lit(0),
        lambda acc, step: F.when((acc + step <= i) & same(acc + step), acc + step).otherwise(acc),
    )
    return F.when(~same(F.lit(1)), 0).when(~same(F.lit(2)), 1).otherwise(run)


def _words(text: Column) -> Column:
    """Runs without white space; in place of one of more than WORD characters, as in scripts without blanks, its character runs.

    What a word turns into depends on that word alone, so an edit elsewhere doesn't change it.
    """
    def grams(w: Column) -> Column:
        # a lambda's own argument is worked out once, an expression inside of it for each element
        return F.flatten(F.transform(F.array(F.split(w, "")), lambda letters: F.transform(
            letters, lambda c, i: F.concat(c, *(F.coalesce(F.get(letters, i + k), F.lit("")) for k in range(1, GRAM))))))

    words = F.split(text, r"(?U)\s+")
    long = lambda w: F.char_length(w) > WORD
    return F.when(F.exists(words, long), F.flatten(F.transform(words, lambda w: F.when(long(w), grams(w)).otherwise(F.array(w))))).otherwise(words)


def _with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the signature of the column ``text`` as an array of longs, one for each bin that isn't empty.

    The elements are pairs of neighbouring words (see :func:`_words`), the last word alone counting
    as one, each with its occurrence number. Bins are cut from an element's
    hash; in each the two smallest hashes are selected, put in text order and
    hashed together. Each step is a column of its own, so that it is evaluated once.
    """
    words, kmers, elements, chosen = (f"_{out}_{x}" for x in ("words", "kmers", "elements", "chosen"))
    low = F.lit((1 << POSITION) - 1)
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS)
    df = df.withColumn(words, _words(F.col(text)))
    df = df.withColumn(kmers, F.sort_array(F.transform(
        words, lambda w, i: F.shiftleft(F.xxhash64(w, F.get(F.col(words), i + 1)), POSITION).bitwiseOR(i.cast("long"))
    ))).drop(words)
    df = df.withColumn(elements, F.sort_array(F.transform(
        kmers, lambda x, i: F.shiftleft(
            F.xxhash64(_key(x), _occurrence(F.col(kmers), x, i).cast("long")), POSITION).bitwiseOR(x.bitwiseAND(low))
    ))).drop(kmers)
    df = df.withColumn(chosen, F.filter(
        elements, lambda x, i: (i < TUPLE) | (bin_of(F.get(F.col(elements), i - TUPLE)) != bin_of(x))
    )).drop(elements)

    def component(x: Column, i: Column) -> Column:
        y = F.get(F.col(chosen), i + 1)
        alone = y.isNull() | (bin_of(y) != bin_of(x))
        forth = x.bitwiseAND(low) < y.bitwiseAND(low)
        mixed = F.when(alone, F.xxhash64(_key(x))).when(forth, F.xxhash64(_key(x), _key(y))).otherwise(F.xxhash64(_key(y), _key(x)))
        first = (i == 0) | (bin_of(F.get(F.col(chosen), i - 1)) != bin_of(x))
        return F.when(first, F.shiftleft(bin_of(x), 24).bitwiseOR(mixed.bitwiseAND(F.lit((1 << 24) - 1))))

    return df.withColumn(out, F.filter(F.transform(chosen, component), lambda x: x.isNotNull())).drop(chosen)


def likeness(a: Column, b: Column) -> Column:
    """Estimate in 0 to 1 of the common share of two texts, in order, from their signatures.

    The share of equal components is near the product of the chances that each
    element of a tuple is common; its root j estimates the Jaccard index of the
    elements, and 2j / (1 + j) their common share. Equal signatures give 1.
    """
    bins = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 24))
    equal = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(bins(a), bins(b)))
    j = F.pow(equal / either, 1.0 / TUPLE)
    return 2 * j / (1 + j)


def fingerprint_string(signature: Column) -> Column:
    """Eight hexadecimal digits for each component: its bin and 24 bits of its hash."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _with_signature(rows, "text", "sig").select("doc_id", fingerprint_string(F.col("sig")).alias("fingerprint"))


def _in_buckets(rows: DataFrame, bucket_rows: int, most_buckets: int) -> DataFrame:
    """Adds ``bucket`` (ranges of descending doc_id) and, as ``guest`` rows, the first row of the bucket that follows.

    Bounds are approximate quantiles of the ids, at most ``most_buckets`` of
    them; with the first id of each bucket they are all that reaches the driver.
    """
    total = rows.count()
    want = min(most_buckets, total // bucket_rows)
    bounds: list[int] = []
    if want:
        shares = [i / (want + 1) for i in range(1, want + 1)]
        found = rows.agg(F.percentile_approx("doc_id", shares, 4 * want)).first()[0] or []
        bounds = sorted(set(found), reverse=True)
    listed = lambda xs: F.expr(f"cast(split('{','.join(map(str, xs))}', ',') as array<bigint>)")
    if bounds:
        steps = ",".join(str(1 << s) for s in range(len(bounds).bit_length() - 1, -1, -1))
        bucket = F.aggregate(
            F.expr(f"array({steps})"), F.lit(0),
            lambda acc, s: F.when(F.coalesce(F.get(listed(bounds), acc + s - 1) > F.col("order"), F.lit(False)), acc + s).otherwise(acc),
        )
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("order", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("bucket", bucket)
    heads = dict(rows.groupBy("bucket").agg(F.max("order")).collect())
    rows = rows.withColumn("guest", F.lit(False))
    if not heads:
        return rows
    # by bucket: the id at its head, and the bucket before it that isn't empty (for the first: the last)
    filled = sorted(heads)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    head = F.get(listed([heads.get(b, 0) for b in range(len(bounds) + 1)]), F.col("bucket"))
    host = F.get(listed([before.get(b, 0) for b in range(len(bounds) + 1)]), F.col("bucket"))
    guests = rows.where(F.col("order") == head).withColumns({"bucket": host.cast("int"), "guest": F.lit(True)})
    return rows.unionByName(guests)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      bucket_rows: int = 512, most_buckets: int = 1 << 16) -> DataFrame:
    """Fingerprints of every text and of an edit of it, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many of the next document in descending doc_id (all, if it is
    shorter); after the last comes the first. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The texts are shuffled once, by ranges of ids: ``bucket_rows`` rows a range, or
    more of them where there would be over ``most_buckets`` ranges, which bound what the
    driver holds; Spark's window keeps the rows of a larger range on disk. Very long texts are signed whole, by sorts of their own words. Null texts count as empty,
    which have a fingerprint of their own; rows of equal id follow each other by
    text, those without id come last; a single row is its own next. Other columns are
    ignored and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _in_buckets(rows, bucket_rows, most_buckets)
    by = Window.partitionBy("bucket").orderBy("guest", F.desc("order"), "text")
    half = F.expr("n_chars div 2").cast("int")
    rows = rows.withColumns({"next": F.coalesce(F.lead("text").over(by), F.lit("")), "place": F.row_number().over(by)})
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited", F.concat(F.left(F.col("text"), F.col("n_chars").cast("int") - half), F.left(F.col("next"), half))
    ).drop("next")
    rows = _with_signature(rows, "text", "sig").drop("text")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = _with_signature(rows, "edited", "edited_sig").drop("edited")
    after = Window.partitionBy("bucket").orderBy("place")
    rows = rows.withColumn("next_sig", F.lead("sig").over(after)).where("not guest")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_string(F.col("sig")).alias("fingerprint"),
        fingerprint_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
