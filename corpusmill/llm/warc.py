"""WARC archives: writing pages, and reading archives back by boundary chains.

Spark's text writer writes the records, each ended by two line ends, so tasks that are lost or repeated leave no partial
file. Of pages with equal payloads of at least ``min_bytes``, the one with the largest id is a response and the others
are revisits that refer to it.

Reading: a magic string may stand inside a payload, so finding it proves nothing. Tasks cut the files at each magic string and
emit candidates: where one stands, and where its record's header says that the next begins. Pointer jumping from each file's
start (1, 2, 4 ... records at a time) keeps those that the chain reaches; the others are payload and are put back together
with the record that they stand in.

Null html is an empty payload; null ids and urls are left out of the headers and read back as null. Where the largest id is
repeated, all its rows are responses; rows without id are revisits if their payload has a row with one. Control characters
in urls are percent-encoded. Pages are spread over files as Spark's partitions are; copies join one row per payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import stored

MAGIC, GAP = "WARC/1.1\r\n", "\r\n\r\n"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them are four letters."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"),
                        F.octet_length(html).alias("n"), base32(F.sha1(html.cast("binary"))).alias("digest"))
    first = stored(rows.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("pages")).filter("pages > 1 and first is not null").drop("pages"), "copies")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit(GAP))
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.coalesce(F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("id"), F.lit(">")), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}"), F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(http) + F.when(again, 0).otherwise(F.col("n")), F.lit(GAP), http)
    record = F.concat(head, F.when(again, "").otherwise(F.col("html")))
    rows.join(first, "digest", "left").select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1)


def _length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between magic strings: value, file, part (where the split of the file begins) and order inside it."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("order"))


def _placed(pieces: DataFrame) -> DataFrame:
    """``order`` counted from the first piece of the split, so that it doesn't depend on how splits are dealt to tasks."""
    first = pieces.groupBy("file", "part").agg(F.min("order").alias("first"))
    return pieces.join(first, ["file", "part"]).withColumn("order", F.col("order") - F.col("first")).drop("first")


def candidates(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """A row for each piece between magic strings: file, at (the byte after the magic string), size, head, block_size as the head
    says, next (at of the record that it says follows), whole (the block is in this piece) and what a whole record holds."""
    raw = _scan(spark, path)
    cut = raw.withColumn("head", F.substring_index("value", GAP, 1)).withColumn("size", _length(F.col("value")))
    said = cut.withColumn("block_size", F.when(F.col("head").contains("WARC-Type:"), _field("Content-Length").try_cast("bigint")))
    rest = F.substring(F.col("value").cast("binary"), F.octet_length("head") + 1 + len(GAP), F.lit(2**31 - 1))
    whole = said.withColumn("whole", F.coalesce(F.col("size") - _length(F.col("head")) - len(GAP) >= F.col("block_size"), F.lit(False))) \
        .withColumn("payload", F.when(F.col("whole"), _payload(F.substring(rest, F.lit(1), F.col("block_size").cast("int")))))
    narrow = stored(whole.select("file", "part", "order", "size", "head", "block_size", "whole", _length(F.col("payload")).alias("n"), base32(F.sha1("payload")).alias("digest"),
                                 (F.col("payload") if payloads else F.lit(None).cast("binary")).alias("payload")), "pieces")
    before = W.partitionBy("file").orderBy("part", "order").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(before), F.lit(0))
    return narrow.withColumn("at", at).withColumn("next", F.col("at") + _length(F.col("head")) + F.col("block_size") + 2 * len(GAP) + len(MAGIC))


def _payload(block: Column) -> Column:
    """What follows the HTTP header in a block."""
    return F.substring(block, F.octet_length(F.substring_index(block.cast("string"), GAP, 1)) + 1 + len(GAP), F.lit(2**31 - 1))


def reachable(found: DataFrame) -> DataFrame:
    """(file, at) of the records on the chain that begins at the file's first byte."""
    jump = nodes = stored(found.filter("block_size is not null").select("file", "at", "next"), "jumps")
    reached = stored(jump.filter(F.col("at") == len(MAGIC)).select("file", "at"), "reached")
    count = reached.count()
    while count:
        far = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        real = far.join(nodes.select("file", "at"), ["file", "at"], "left_semi")
        reached = stored(reached.unionByName(real), "reached")
        now = reached.count()
        if now == count:
            break
        count = now
        then = jump.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = stored(jump.join(then, ["file", "next"]).select("file", "at", F.col("then").alias("next")), "jumps")
    return reached


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(id, url, record_type, refers_to, said_digest, n, digest, payload) of the records; n and digest are measured on the payload
    read, and those of a revisit come from the response that it refers to. Without ``payloads`` that column is null."""
    found = stored(candidates(spark, path, payloads), "candidates")
    real = reachable(found).withColumn("real", F.lit(True))
    own = W.partitionBy("file").orderBy("at")
    pieces = found.join(real, ["file", "at"], "left").withColumn("owner", F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(own))
    records = pieces.filter("real")
    split = records.filter("not whole").select("file", F.col("at").alias("owner"), F.col("head").alias("own_head"), F.col("block_size").alias("own_size"))
    both = records.filter("whole").select("head", "n", "digest", "payload")
    if split.limit(1).count():                                             # magic strings inside payloads: those files are read again
        needed = _placed(found.select("file", "part", "order", "at")).join(pieces.select("file", "at", "owner"), ["file", "at"]).join(split, ["file", "owner"])
        joined = needed.join(_placed(_scan(spark, path)), ["file", "part", "order"]).groupBy("file", "owner", "own_head", "own_size").agg(
            F.sort_array(F.collect_list(F.struct("at", "value"))).alias("p"))
        block = F.substring(F.array_join(F.transform("p", lambda x: x.value), MAGIC).cast("binary"), F.octet_length("own_head") + 1 + len(GAP), F.col("own_size").cast("int"))
        pasted = joined.withColumn("body", _payload(block)).select(F.col("own_head").alias("head"), _length(F.col("body")).alias("n"), base32(F.sha1("body")).alias("digest"),
                                                                  (F.col("body") if payloads else F.lit(None).cast("binary")).alias("payload"))
        both = both.unionByName(pasted)

    def ident(name: str) -> Column:
        return F.regexp_extract(_field(name), "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")

    read_back = both.select(ident("WARC-Record-ID").alias("id"), F.nullif(_field("WARC-Target-URI"), F.lit("")).alias("url"), _field("WARC-Type").alias("record_type"), ident("WARC-Refers-To").alias("refers_to"),
                            F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:([A-Z2-7]+)", 1).alias("said_digest"), "n", "digest", "payload")
    full = read_back.filter("record_type = 'response'")
    of = full.groupBy(F.col("id").alias("refers_to"), F.col("digest").alias("said_digest")).agg(F.max("n").alias("full_n"), F.max("payload").alias("full_payload"))
    revisits = read_back.filter("record_type <> 'response'").drop("n", "digest", "payload").join(of, ["refers_to", "said_digest"], "left")
    return full.unionByName(revisits.select("id", "url", "record_type", "refers_to", "said_digest", F.col("full_n").alias("n"), F.when(F.col("full_n").isNotNull(), F.col("said_digest")).alias("digest"), F.col("full_payload").alias("payload")))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM m
"""
