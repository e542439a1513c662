"""WARC archives written and read with Spark's own readers and writers, so any store that Spark reaches will do.

Reading cuts files at the magic line, wherever a split begins; each piece after a magic is a candidate record whose header
gives its successor's offset. Magic inside a payload makes false candidates, so only the chain from a file's start counts:
runs of candidates that follow each other in place are one node, and pointer jumping over the runs, marking what each
marked run points to and doubling the pointers, retains what the start reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.plans.durable import checkpointed, new_path, written
from meshwork.plans.skew import lookup

MAGIC = "WARC/1.1\r\n"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Decisions on pages whose payload is repeated are broadcast up to this many, counted first; beyond it they are shuffled.
BROADCAST_ROWS = 500_000
#: Offsets of a file are cut into ranges of so many bytes, by which pieces meet the records that span them.
RANGE_BYTES = 1 << 22


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hex digits are eight digits of base 32, in another alphabet."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    h = F.sha1(payload)
    return F.concat(*[F.lpad(F.translate(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), digits, letters), 8, "A") for i in range(4)])


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(__id, __url, __html, digest, refers): refers is the page that a repeated payload revisits, else null."""
    rows = pages.select(F.col(id_col).alias("__id"), F.coalesce(F.col(url_col), F.lit("")).alias("__url"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    rows = rows.withColumn("key", F.sha2(F.col("__html").cast("binary"), 256)).withColumn("digest", base32_sha1(F.col("__html").cast("binary")))
    repeated = rows.where(F.octet_length("__html") >= least).groupBy("key").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    repeated = written(repeated, "repeated")
    few = repeated.count() <= BROADCAST_ROWS
    if few:
        rows = rows.join(F.broadcast(repeated.drop("n")), "key", "left")
    else:
        rows = lookup(rows, "key", F.xxhash64("__id"), repeated, "key", "n", rows.count())
    return rows.withColumn("refers", F.when(~F.col("__id").eqNullSafe(F.col("first")), F.col("first")))


def _record(date: str) -> Column:
    """The text of a record but for its last line break, which the text writer adds."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(c.cast("string")), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    url = F.regexp_replace("__url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("__html").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(F.col("refers").isNull(), F.concat(http, F.col("__html"))).otherwise(http)
    kind = F.when(F.col("refers").isNull(), line("WARC-Type", F.lit("response"))).otherwise(
        F.concat(line("WARC-Type", F.lit("revisit")), line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers")))))
    head = F.concat(F.lit(MAGIC), kind, line("WARC-Record-ID", urn(F.col("__id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
                    line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("Content-Type", F.lit("application/http;msgtype=response")))
    return F.concat(head, line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block, F.lit(CRLF))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row, in uncompressed WARC files under ``path``, one per task.

    Null html is an empty payload, null urls are empty. Of equal payloads of at least ``least`` bytes the smallest id is the
    response and the others revisit it; rows that repeat that id are responses too. Rows without an id revisit a page with an
    id, or are responses. Pages are not shuffled; an empty table writes no record.
    """
    planned = plan_records(pages, id_col, url_col, html_col, least)
    planned.select(_record(date)).write.option("lineSep", CRLF).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between magic lines with their split and order in it."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))


def _parsed(pieces: DataFrame) -> DataFrame:
    """Thin columns of each piece: its length, its text's name, and what its header says if it has one."""
    end = F.instr("value", CRLF + CRLF)
    rows = pieces.withColumn("head", F.when(end > 0, F.expr("concat('\\r\\n', left(value, instr(value, '\\r\\n\\r\\n') + 3))")).otherwise(F.lit("")))
    named = lambda name: F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    size = F.expr(r"try_cast(regexp_extract(head, '(?i)\\r\\nContent-Length:[ \\t]*([0-9]{1,18})[ \\t]*\\r\\n', 1) as bigint)")
    rows = rows.select("*", F.octet_length("value").cast("long").alias("len"), (F.octet_length("head") - 2).cast("long").alias("head_len"), size.alias("size"))
    # the block of a record that lies in one piece; others are put together later
    whole = F.col("size").isNotNull() & (F.col("head_len") + F.col("size") + 4 <= F.col("len"))
    body = F.when(whole, F.expr("substr(value, char_length(head) - 1)"))
    body = F.when(F.octet_length(body) == F.col("size") + 4, F.expr("left(substr(value, char_length(head) - 1), char_length(value) - char_length(head) + 2 - 4)"))
    rows = rows.withColumn("body", body)
    return rows.select(
        "file", "block", "nth", "len", "head_len", "size", F.col("body").isNotNull().alias("whole"), _named().alias("name"), *_payload("body"),
        named("WARC-Type").alias("type"), named("WARC-Record-ID").alias("urn"), named("WARC-Refers-To").alias("refers"), named("WARC-Payload-Digest").alias("said"),
    )


def _named() -> Column:
    """128 bits and the length of a piece's text: the same in every scan, however files are split."""
    return F.struct(F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), "value").alias("b"), F.octet_length("value").alias("n"))


def _payload(block: str) -> list[Column]:
    """Bytes and digest of an HTTP response's payload: what follows its first empty line."""
    payload = F.expr(f"substr({block}, instr({block}, '\\r\\n\\r\\n') + 4)").cast("binary")
    return [F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("digest")]


def _placed(thin: DataFrame) -> DataFrame:
    """Offsets: prefix sums of split totals plus the running sum inside a split."""
    step = F.col("len") + len(MAGIC)
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = thin.groupBy("file", "block").agg(F.sum(step).alias("all")).withColumn("base", F.coalesce(F.sum("all").over(ahead), F.lit(0))).drop("all")
    inside = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = thin.withColumn("within", F.coalesce(F.sum(step).over(inside), F.lit(0))).join(totals, ["file", "block"])
    return rows.withColumn("at", F.col("base") + F.col("within") - len(MAGIC)).drop("base", "within")


def reachable(candidates: DataFrame) -> DataFrame:
    """Of candidates (file, block, at, next) those on the chain from offset 0 of their file."""
    line = Window.partitionBy("file", "block").orderBy("at")
    c = candidates.withColumn("adjacent", F.coalesce(F.lag("next").over(line) == F.col("at"), F.lit(False))).withColumn("jumps", ~F.coalesce(F.lead("at").over(line) == F.col("next"), F.lit(False)))
    targets = c.where("jumps").select(F.col("file"), F.col("next").alias("at"), F.lit(True).alias("target")).distinct()
    c = c.join(targets, ["file", "at"], "left").withColumn("first", ~F.col("adjacent") | F.coalesce("target", F.lit(False)))
    c = c.withColumn("run", F.max(F.when(F.col("first"), F.col("at"))).over(line))
    c = written(c.drop("adjacent", "target", "first"), "candidates")
    # a run may also end before a target: it then leads to the run that begins there
    ends = c.groupBy("file", "run").agg(F.max_by("next", "at").alias("next")).withColumn("reached", F.col("run") == 0)
    runs = checkpointed(ends)
    while True:
        marked = runs.where("reached").select("file", F.col("next").alias("run")).distinct().withColumn("hit", F.lit(True))
        on = runs.select("file", F.col("run").alias("next"), F.col("next").alias("then"))
        new = runs.join(marked, ["file", "run"], "left").withColumn("fresh", F.coalesce("hit", F.lit(False)) & ~F.col("reached"))
        new = checkpointed(new.join(on, ["file", "next"], "left").select("file", "run", F.col("then").alias("next"), (F.col("reached") | F.col("fresh")).alias("reached"), "fresh"))
        if new.where("fresh").isEmpty() and new.where("reached and next is not null").join(new.where("not reached").select("file", F.col("run").alias("next")), ["file", "next"], "left_semi").isEmpty():
            break
        runs = new.drop("fresh")
    return c.join(new.where("reached").select("file", "run"), ["file", "run"], "left_semi").drop("run", "jumps")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records on the chains: file, at, type, id, refers_to, payload_bytes, payload_digest (of the payload as read; null for revisits), said.

    ``said`` is the digest that the header states. A response that is cut short, so that its payload isn't all there, has null bytes
    and digest. Magic inside payloads, at any place, is payload.
    """
    thin = written(_placed(_parsed(_pieces(spark, path))), "pieces")
    following = F.col("at") + len(MAGIC) + F.col("head_len") + F.col("size") + 4
    found = reachable(thin.where("at >= 0 and size is not null").drop("name").withColumn("next", following))
    split = found.where("not whole")
    if split.isEmpty():
        full = found
    else:
        full = found.where("whole").unionByName(_joined(spark, path, thin, split))
    page = lambda c: F.try_url_decode(F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")))
    response = F.col("type") == "response"
    return full.select(
        "file", "at", "type", page("urn").alias("id"), F.when(~response, page("refers")).alias("refers_to"),
        F.when(response, F.col("bytes")).alias("payload_bytes"), F.when(response, F.col("digest")).alias("payload_digest"), F.regexp_replace("said", "^sha1:", "").alias("said"),
    )


def _joined(spark: SparkSession, path: str, thin: DataFrame, split: DataFrame) -> DataFrame:
    """Records that hold magic: their pieces, by offset, joined with the magic between them. One record is one group.

    Texts come from a second scan, which may split files elsewhere, so they are found by their names; that one is missing raises.
    """
    span = split.select("file", F.col("at").alias("start"), (F.col("at") + len(MAGIC) + F.col("head_len") + F.col("size") + 4).alias("stop"))
    span = span.withColumn("range", F.explode(F.sequence(F.expr(f"start div {RANGE_BYTES}"), F.expr(f"stop div {RANGE_BYTES}"))))
    pieces = thin.where("at >= 0").select("file", "at", "name", F.expr(f"at div {RANGE_BYTES}").alias("range"))
    parts = written(pieces.join(span, ["file", "range"]).where("at >= start and at < stop").drop("range"), "parts")
    again = spark.read.option("lineSep", MAGIC).text(path).select("value", _named().alias("name"))
    texts = again.join(parts.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.first("value").alias("value"))
    there = F.when(F.col("value").isNull(), F.raise_error(F.lit("a piece of a record was not found again"))).otherwise(F.col("value"))
    text = parts.join(texts, "name", "left").select("file", "start", "at", there.alias("value"))
    glued = text.groupBy("file", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    glued = glued.join(split.drop("bytes", "digest").withColumnRenamed("at", "start"), ["file", "start"])
    block = F.substring(F.col("value").cast("binary"), F.col("head_len").cast("int") + 1, F.col("size").cast("int")).cast("string")
    glued = glued.withColumn("body", F.when(F.octet_length(block) == F.col("size"), block)).withColumnRenamed("start", "at")
    return glued.select(*[c for c in split.columns if c not in ("bytes", "digest")], *_payload("body")).select(*split.columns)


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back, and return one row per record.

    Payloads of any length are kept whole; null html counts as empty; an empty table gives an empty result; other columns are
    ignored. id, payload_bytes, payload_digest (both of the full payload; a revisit's from the response it names, that of its
    digest if several have the id), record_type, refers_to. ``path`` defaults to a folder in the shared one.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col, least)
    records = written(read_warc(spark, path), "records")
    kind = pages.schema[id_col].dataType
    answers = records.where("type = 'response' and id is not null").dropDuplicates(["id", "payload_digest"]).select(F.col("id").alias("rid"), F.col("payload_bytes").alias("rb"), F.col("payload_digest").alias("rd"))
    asked = records.where("type = 'revisit'").withColumn("ask", F.concat_ws(":", "said", "refers_to"))
    answers = answers.withColumn("answer", F.concat_ws(":", "rd", "rid")).join(asked.groupBy(F.col("ask").alias("answer")).agg(F.count(F.lit(1)).alias("n")), "answer")
    asked = lookup(asked, "ask", F.xxhash64("file", "at"), answers.select("answer", "rb", "rd", "n"), "answer", "n", asked.count())
    asked = asked.withColumn("payload_bytes", F.col("rb")).withColumn("payload_digest", F.col("rd"))
    every = records.where("type = 'response'").unionByName(asked.select(*records.columns))
    return every.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
