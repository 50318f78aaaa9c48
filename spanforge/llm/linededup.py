"""Removal of lines that many documents share, by levelled sorted runs of line hashes, in DataFrame expressions alone."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import discard, fresh_path, save

#: Characters that are stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Line hashes that are matched by a broadcast of so many rows at most, those that were most frequent when they were settled; no other then has over about 1 / MOST_HOT of all lines.
MOST_HOT = 4096
KEY = ["a", "b"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A to Z in lower case; other letters stay as they are."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(text: Column, min_chars: int) -> Column:
    """For each line 128 bits of hash of its key, null for keys under ``min_chars`` code points."""
    keys = F.transform(F.split(text, "\n"), line_key)
    hashed = lambda k: F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, hashed(k)))


class LineRuns:
    """How many documents hold each line, as levels of sorted runs.

    A run is a table of (a, b, n), bucketed and sorted by the hash. A new batch is counted by itself, merge-anti-joined
    with the lines that the runs have settled (``n`` of ``min_docs`` or more), and what is left is a run of level 0.
    When a level has ``fan`` runs, they are merged into one of the next level; so a line is rewritten
    as often as there are levels, the logarithm of the number of batches. Buckets are those of the session's shuffle
    partitions, so neither the joins nor the merges move a run's rows again.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fan: int = 2) -> None:
        if min_docs < 1 or fan < 2:
            raise ValueError("min_docs is 1 or more, fan 2 or more")
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.levels: list[list[tuple[str, DataFrame]]] = []

    def _write(self, counts: DataFrame) -> tuple[str, DataFrame]:
        name = f"line_run_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        counts.write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", fresh_path(self.spark, "line-run")).saveAsTable(name)
        return name, self.spark.table(name)

    def _drop(self, run: tuple[str, DataFrame]) -> None:
        discard(run[1])
        self.spark.sql(f"drop table {run[0]}")

    def _merged(self, runs: list[tuple[str, DataFrame]]) -> DataFrame:
        def merged(left: DataFrame, right: DataFrame) -> DataFrame:
            both = left.join(right.withColumnRenamed("n", "m").hint("merge"), KEY, "full_outer")
            return both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        # not by a union: over bucketed tables Spark 4.1 takes it to be bucketed too, and would leave a line's counts apart
        return reduce(merged, (run for _, run in runs))

    def add(self, lines: DataFrame) -> None:
        """Take in a batch: a row (a, b) for each document and line that it holds."""
        counts = lines.groupBy(*KEY).agg(F.count("*").alias("n"))
        for level in self.levels:
            for _, run in level:
                counts = counts.join(run.where(F.col("n") >= self.min_docs).select(*KEY).hint("merge"), KEY, "left_anti")
        rising = self._write(counts)
        for i in range(len(self.levels) + 1):
            if i == len(self.levels):
                self.levels.append([])
            self.levels[i].append(rising)
            if len(self.levels[i]) < self.fan:
                break
            full, self.levels[i] = self.levels[i], []
            rising = self._write(self._merged(full))
            for run in full:
                self._drop(run)

    def settle(self) -> DataFrame:
        """(a, b, n) of the lines that ``min_docs`` documents or more hold, written to the shared folder; the runs are dropped.

        ``n`` is their number in the batches that came before the line was settled.
        """
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "a long, b long, n long")
        settled = save(self._merged(runs).where(F.col("n") >= self.min_docs), "settled-lines")
        for run in runs:
            self._drop(run)
        self.levels = []
        return settled


def without_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fan: int = 2,
                         id_col: str = "doc_id", text_col: str = "text", most_hot: int = MOST_HOT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every row: its text without the lines that ``min_docs`` rows or more hold.

    A text is split at newlines; lines are alike whose keys (see :func:`line_key`) have equal 128-bit hashes. A line counts
    once a row, however often the row repeats it. All its lines go, first ones included; keys under ``min_chars`` code points stay.

    One pass over the texts writes the hashes of each; all counting is over these. Batches are told by a hash of the row
    and go through :class:`LineRuns`. A line that many rows hold is added up before the shuffle; to find its places, the
    ``most_hot`` most frequent hashes are broadcast and all others meet the settled lines in a merge join. What
    goes back to the texts are places, at most as many as a text has lines.

    Null and empty texts are one empty line, which stays. Very long texts are handled whole, by sorts of their own lines. Rows
    without id and repeated rows are documents like any other; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    hashed = rows.select("uid", _hashes(F.col("text"), min_chars).alias("hashes"), F.pmod("uid", F.lit(batches)).cast("int").alias("batch"))
    hashed = save(hashed, "line-hashes", "batch")

    runs = LineRuns(spark, min_docs, fan)
    # a lambda's own argument is worked out once, an expression inside of it for each element
    in_order = F.array(F.sort_array(F.filter("hashes", lambda h: h.isNotNull())))
    own = hashed.select("batch", F.flatten(F.transform(in_order, lambda s: F.filter(s, lambda h, i: (i == 0) | (h != F.get(s, i - 1))))).alias("s"))
    for i in range(batches):
        runs.add(own.where(F.col("batch") == i).select(F.inline("s")))
    settled = runs.settle()

    places = hashed.select("uid", F.posexplode("hashes").alias("place", "h")).where("h is not null").select("uid", "place", "h.*")
    hot = F.broadcast(settled.orderBy(F.desc("n"), *KEY).limit(most_hot).select(*KEY))
    dropped = places.join(hot, KEY, "left_semi").select("uid", "place").union(
        places.join(hot, KEY, "left_anti").join(settled.select(*KEY).hint("merge"), KEY, "left_semi").select("uid", "place"))
    by_row = dropped.groupBy("uid").agg(F.collect_set("place").alias("places"))

    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places")
    left = F.flatten(F.transform(F.array(lines), lambda own: F.transform(stay, lambda i: F.get(own, i))))
    return rows.join(by_row, "uid", "left").select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept_text"))


def line_digests(docs: DataFrame, **how: object) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): :func:`without_shared_lines` with a digest in place of the kept text."""
    kept = without_shared_lines(docs, **how)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
