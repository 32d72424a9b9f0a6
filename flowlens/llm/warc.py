"""WARC archives: writing pages with revisit records, and reading by boundary-chain verification.

A reader that starts in the middle of a file can't tell a record from the same bytes inside a payload. So tasks split
files at every occurrence of the magic and emit, for each, where the record that seems to start there would end. These
candidates are linked to their successors, and pointer jumping from the start of each file keeps just the reachable ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows that are broadcast at most (under 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits as four groups of 40, each eight digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of ``pages(page_id, url, html)`` as uncompressed WARC files in the folder ``path``.

    Of records whose payloads are equal and have ``min_bytes`` or more bytes, that with the largest page_id (and rows
    that repeat that id) is the response; the others are revisits of it, without the payload. A null html is an empty
    payload, a null page_id is written as ``null`` and revisits like others (rows are responses where no id of the group
    is known), a null url has no target. Other columns are ignored; no rows give no records.

    Only the digests of payloads are shuffled; payloads go from the scan into the files.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "n": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("c"))
    groups = written(groups.where("c > 1 AND keeper IS NOT NULL").select("digest", "keeper"), "payloads")
    rows = rows.join(_small(groups), "digest", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c], F.lit("\r\n"))
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"),
                    line("Content-Length: ", F.col("n").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: ", name(F.col("page_id"))), line("WARC-Date: 2024-01-01T00:00:00Z"),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI: ", F.regexp_replace("url", "[\\r\\n]", " "))).otherwise(""),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To: ", name(F.col("keeper"))), line("WARC-Profile: ", PROFILE))).otherwise(""),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")), F.lit("\r\n"))
    # a record ends with two line ends: one is written as the separator of the text writer
    rows.select(F.concat(head, block, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, f"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def _parsed(df: DataFrame) -> DataFrame:
    """The fields of the record that seems to start with ``value`` (what follows the magic), and its payload."""
    df = df.withColumn("head", F.substring_index("value", END, 1))
    df = df.withColumns({"head_bytes": F.octet_length("head") + len(END),
                         "length": _field(F.col("head"), "Content-Length").try_cast("long")})
    df = df.withColumn("size", len(MAGIC) + F.col("head_bytes") + F.col("length") + len(END))
    df = df.withColumn("complete", F.octet_length("value") >= F.col("head_bytes") + F.col("length"))
    block = F.expr("substring(CAST(value AS BINARY), CAST(head_bytes AS INT) + 1, CAST(length AS INT))")
    df = df.withColumn("block", F.when(F.col("complete"), block))
    df = df.withColumn("http", F.substring_index(F.col("block").cast("string"), END, 1))
    is_http = F.coalesce(F.lower(_field(F.col("head"), "Content-Type")).startswith("application/http"), F.lit(False))
    df = df.withColumn("payload", F.when(is_http, F.expr("substring(block, octet_length(http) + 5)")).otherwise(F.col("block")))
    df = df.withColumns({
        "record_type": _field(F.col("head"), "WARC-Type"), "record_id": _field(F.col("head"), "WARC-Record-ID"),
        "refers_to": _field(F.col("head"), "WARC-Refers-To"), "target_uri": _field(F.col("head"), "WARC-Target-URI")})
    revisit = F.col("record_type") == "revisit"
    return df.withColumns({
        "payload_bytes": F.when(revisit, _field(F.col("http"), "Content-Length").try_cast("long")).otherwise(
            F.octet_length("payload").cast("long")),
        "payload_digest": F.when(revisit, F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "")).otherwise(
            base32_sha1(F.col("payload")))})


FIELDS = ["record_type", "record_id", "refers_to", "target_uri", "payload_bytes", "payload_digest"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, row, value): what lies between two occurrences of the magic. Files are read in parts, in parallel."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
                      F.monotonically_increasing_id().alias("row"), "value")


def _candidates(pieces: DataFrame) -> DataFrame:
    """(file, part, row, at, succ, run, complete, fields): a row per occurrence of the magic, without its payload.

    ``at`` is its offset and ``succ`` where its record ends. Neighbours whose offsets meet share a ``run``.
    """
    found = _parsed(pieces).select("file", "part", "row", "size", "complete", F.octet_length("value").alias("bytes"), *FIELDS)
    found = written(found, "candidates")
    order = Window.partitionBy("file", "part").orderBy("row")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({
        "rel": F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(before), F.lit(0)),
        "meets": F.coalesce(F.lag(F.col("size")).over(order) == F.lag(F.col("bytes") + len(MAGIC)).over(order), F.lit(False))})
    found = found.withColumn("run", F.sum(F.when(F.col("meets"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = found.groupBy("file", "part").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("total"))
    parts = parts.select("file", "part", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    found = found.join(parts, ["file", "part"]).withColumn("at", F.col("base") + F.col("rel") - len(MAGIC))
    # what stands before the first magic of a file has a negative offset: no candidate
    return found.where("at >= 0").withColumn("succ", F.col("at") + F.col("size"))


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates that a chain of records from the start of their file leads to.

    Runs of neighbours that meet are one node: whoever enters a run at an offset follows it to its end. Each round of
    pointer jumping doubles how many runs every link spans, so the rounds grow with the logarithm of the runs in a file.
    """
    run = ["file", "part", "run"]
    links = candidates.groupBy(*run).agg(F.max_by("succ", "at").alias("succ"))
    heads = candidates.select("file", "at", F.struct(*run).alias("node"))
    # jump: from a run to the run and offset that its last record leads to
    jump = links.where("succ IS NOT NULL").select("file", F.struct(*run).alias("from"), F.col("succ").alias("at"))
    jump = written(jump.join(heads, ["file", "at"]).select("from", F.col("node").alias("to"), "at"), "jump")
    reach = written(heads.where("at = 0").select("node", "at"), "reach")
    while not jump.isEmpty():
        step = reach.join(jump.select(F.col("from").alias("node"), "to", F.col("at").alias("next")), "node").select(
            F.col("to").alias("node"), F.col("next").alias("at"))
        reach = written(reach.union(step).distinct(), "reach")
        jump = written(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.from")).select(
            F.col("a.from").alias("from"), F.col("b.to").alias("to"), F.col("b.at").alias("at")), "jump")
    entry = reach.groupBy("node").agg(F.min("at").alias("entry"))
    return candidates.join(entry, F.struct(*run) == F.col("node")).where("at >= entry").drop("node", "entry")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """file, offset, and the fields of every record of the archives in ``path``; ``payload`` (binary) if asked for.

    Archives are uncompressed WARC 1.0. A record whose payload holds the magic is put together again from its pieces. A
    file that doesn't start with a record has none that is reachable. Payload length and digest of a response are taken
    from its bytes; those of a revisit from its headers.
    """
    pieces = _pieces(spark, path)
    found = written(reachable(_candidates(pieces)), "records")
    place = ["file", "part", "row"]
    whole = found.where("complete")
    columns = ["file", "at", *FIELDS]
    if payload:
        own = _parsed(pieces).select(*place, "payload")
        whole = whole.join(own, place).select(*columns, "payload")
        columns = [*columns, "payload"]
    whole = whole.select(*columns)
    broken = found.where("NOT complete AND succ IS NOT NULL").select("file", "at", "succ")
    if broken.isEmpty():
        return whole.withColumnRenamed("at", "offset")
    # pieces of the broken records: the last record that starts at or before a piece owns it
    every = _candidates(pieces).select(*place, "at")
    owners = every.join(broken.select("file").distinct(), "file", "left_semi").join(
        found.select("file", "at", F.lit(True).alias("true")), ["file", "at"], "left")
    last = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owners = owners.withColumn("owner", F.max(F.when(F.col("true"), F.col("at"))).over(last))
    owners = owners.join(broken.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi")
    owners = written(owners.select(*place, "owner", "at"), "owners")
    texts = pieces.join(_small(owners), place).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    texts = texts.select("file", F.col("owner").alias("at"), F.array_join(F.col("v.value"), MAGIC).alias("value"))
    return whole.union(_parsed(texts).where("complete").select(*columns)).withColumnRenamed("at", "offset")
