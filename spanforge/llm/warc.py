"""WARC archives: written with the text writer, read back by boundary-chain verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import discard, save

#: What each record begins with; one digit of the version and a line end follow.
MAGIC = "WARC/1."
CRLF = "\r\n"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: each five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(
        F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0,
               date: str = "1970-01-01T00:00:00Z", compression: str | None = None) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives in ``path``.

    The payload is the html in UTF-8 (null: empty). Of the rows with equal
    payloads of ``min_revisit_bytes`` or more, the one with the largest page_id
    is a response (rows that tie for it all are), the others are revisits
    without a block that refer to it. Payloads are grouped by their digests; only digests that occur
    twice or more are joined back, so Spark broadcasts them if, and only if, the
    written table is below its own limit. A row without page_id has a record
    without that field. CR and LF in a url become spaces.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]", " ").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumns({"sha": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    shared = save(
        rows.where(F.col("size") >= min_revisit_bytes).groupBy("sha", "size")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("sha", "size", "first"),
        "warc-shared",
    )
    rows = rows.join(shared, ["sha", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC + "1" + CRLF),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(field("WARC-Record-ID", urn(F.col("page_id"))), F.lit("")),
        F.when(F.col("url") != "", field("WARC-Target-URI", F.col("url"))).otherwise(""),
        field("WARC-Date", F.lit(date)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))),
        F.when(revisit, field("WARC-Refers-To", urn(F.col("first")))).otherwise(""),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
    )
    block = F.when(revisit, "").otherwise(F.col("html"))
    # the writer's line end is the last byte of each record
    out = rows.select(F.concat(head, F.lit(CRLF), block, F.lit(CRLF + "\r")).alias("value")).write
    if compression:
        out = out.option("compression", compression)
    out.option("lineSep", "\n").text(path)
    discard(shared)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The text between occurrences of the magic, with its place among those of its file split.

    Splits and tasks may differ from one scan to the next, so ``part`` orders the rows of a single scan alone.
    """
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("part"),
    )


def _marks() -> list[Column]:
    """128 bits by which a chunk's text is found again in another scan of its file."""
    return [F.xxhash64("value").alias("x"), F.xxhash64("value", F.lit(1)).alias("y")]


def _chunks(scan: DataFrame, keep: bool) -> DataFrame:
    """A row per chunk: what its header says, were it a record, and the digest of its block.

    The text itself is kept only where the chunk isn't a whole record, or of all chunks with ``keep``.
    """
    begins = F.col("value").rlike("^[01]\r\n") & (F.locate(CRLF * 2, F.col("value")) > 0)
    rows = scan.select(
        "file", "split", "part", "value", *_marks(),
        F.octet_length("value").cast("long").alias("size"),
        F.when(begins, F.substring_index("value", CRLF * 2, 1)).alias("head"),
    )
    say = lambda name: F.nullif(F.trim(F.regexp_extract(
        "head", rf"\r\n(?i:{name}):[ \t]*([^\r\n]*)", 1)), F.lit(""))
    rows = rows.withColumns({
        "block_at": F.octet_length("head").cast("long") + 4,
        "length": F.regexp_extract("head", r"\r\n(?i:Content-Length):[ \t]*(\d+)", 1).try_cast("long"),
        "type": say("WARC-Type"), "record_id": say("WARC-Record-ID"), "refers": say("WARC-Refers-To"),
        "digest": say("WARC-Payload-Digest"), "url": say("WARC-Target-URI"),
    })
    whole = F.coalesce(F.col("block_at") + F.col("length") <= F.col("size"), F.lit(False))
    rows = rows.withColumns({
        "sha": F.when(whole, F.sha1(F.expr("substring(cast(value as binary), cast(block_at + 1 as int), cast(length as int))"))),
        "text": F.col("value") if keep else F.when(~whole, F.col("value"))})
    return rows.drop("value", "head")


def _placed(chunks: DataFrame) -> DataFrame:
    """Each chunk with the byte offset of its magic line: lengths summed within a split, and splits within a file."""
    step = F.col("size") + len(MAGIC)
    within = Window.partitionBy("file", "split").orderBy("part")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = chunks.groupBy("file", "split").agg(F.sum(step).alias("bytes")).select(
        "file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")
    )
    return chunks.withColumn("upto", F.sum(step).over(within)).join(splits, ["file", "split"]).withColumn(
        "at", F.col("base") + F.col("upto") - step - len(MAGIC)
    ).where("at >= 0").drop("upto", "base")


def _reachable(candidates: DataFrame) -> DataFrame:
    """(file, at) of the records on the chain from offset 0, by pointer jumping.

    ``candidates`` are (file, at, to). Each round doubles the length of the
    jumps and the part of the chain that is known, so there are as many rounds
    as the logarithm of the records in the longest file.
    """
    jumps = save(candidates, "warc-jumps")
    known = save(jumps.where("at = 0").select("file", "at"), "warc-known")
    while True:
        further = save(
            known.union(known.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(),
            "warc-known",
        )
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        longer = save(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "warc-jumps")
        discard(known, jumps)
        known, jumps = further, longer
        if jumps.isEmpty():
            return known


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives (WARC/1.0 or 1.1) in ``path``.

    Columns: file, at, type, record_id, refers, digest, url, length (of its
    block), sha (hexadecimal SHA-1 of its block), and payload (binary) where
    ``payloads`` is set. Files are split like any text; every magic is a
    candidate with the offset of its successor, and only candidates on the chain
    from the start of the file are records. A magic inside a payload is not
    on the chain: the pieces that it cuts a block into are joined again, and each
    of them is found by its place after the record's start in one order of offsets a file.
    Pieces that look like whole records themselves are read a second time. A chain
    that breaks (a cut or damaged record) ends there. No files: no rows. The table
    is written to the shared folder, so later readers see the same rows.
    """
    scan = _scan(spark, path)
    chunks = save(_placed(_chunks(scan, payloads)), "warc-chunks")
    after = F.col("at") + len(MAGIC) + F.col("block_at") + F.col("length") + 4
    known = _reachable(chunks.where("length is not null and type is not null").select("file", "at", after.alias("to")))
    records = chunks.join(known, ["file", "at"])
    made = [chunks, known]
    block = lambda c: F.expr(f"substring(cast({c} as binary), cast(block_at + 1 as int), cast(length as int))")
    cut = records.where("sha is null and length is not null")
    if cut.isEmpty():
        out = records.withColumn("joined", F.lit(None).cast("binary"))
    else:
        starts = cut.select("file", "at", F.struct(F.col("at").alias("start"), after.alias("end"), "block_at", "length").alias("record"))
        upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        placed = chunks.select("file", "at", "x", "y", "text").join(starts, ["file", "at"], "left").withColumn("record", F.last("record", ignorenulls=True).over(upto))
        pieces = save(placed.where("at < record.end").select("file", "at", "x", "y", "text", "record.*"), "warc-pieces")
        made.append(pieces)
        again = pieces.where("text is null").select("file", "x", "y").distinct()
        if not again.isEmpty():
            found = scan.select("file", "value", *_marks()).join(again, ["file", "x", "y"]).groupBy("file", "x", "y").agg(F.first("value").alias("value"))
            found = save(found, "warc-found")
            made.append(found)
            pieces = pieces.join(found, ["file", "x", "y"], "left").withColumn("text", F.coalesce("text", "value"))
        whole = pieces.groupBy("file", "start", "block_at", "length").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p.text), MAGIC).alias("value"))
        out = records.join(whole.select("file", F.col("start").alias("at"), block("value").alias("joined")), ["file", "at"], "left")
        out = out.withColumn("sha", F.coalesce("sha", F.sha1("joined")))
    if payloads:
        out = out.withColumn("payload", F.coalesce("joined", block("text")))
    out = save(out.drop("joined", "part", "split", "size", "block_at", "x", "y", "text"), "warc-records")
    discard(*made)
    return out


def warc_round_trip(pages: DataFrame, path: str, min_revisit_bytes: int = 0, compression: str | None = None) -> DataFrame:
    """Write ``pages`` to ``path``, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Size and digest are those of the full payload: a revisit takes them from
    the block of the response that it refers to. Repeated rows stay as many; null html is an
    empty payload; a very long one is a record like any other, held whole by the tasks that write and hash it;
    other columns are ignored; an empty table gives no rows.
    """
    write_warc(pages, path, min_revisit_bytes, compression=compression)
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, 'page:(-?[0-9]+)>', 1), '') as bigint)")
    records = read_warc(pages.sparkSession, path).select(
        page("record_id").alias("page_id"), F.col("length").alias("payload_bytes"),
        F.concat(F.lit("sha1:"), base32(F.col("sha"))).alias("own"), "digest", F.col("type").alias("record_type"), page("refers").alias("refers_to"),
    )
    full = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(
        F.first("own").alias("full"), F.first("payload_bytes").alias("full_bytes"))
    revisits = records.where("record_type = 'revisit'").join(full, ["refers_to", "digest"], "left")
    strip = lambda c: F.substring(c, 6, 32).alias("payload_digest")
    return records.where("record_type = 'response'").select(
        "page_id", "payload_bytes", strip("own"), "record_type", "refers_to"
    ).union(revisits.select("page_id", "full_bytes", strip("full"), "record_type", "refers_to"))
