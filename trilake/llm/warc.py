"""WARC archives of pages, and their capture index merged from sorted runs.

Archives are written and read by Spark's text source, so they need no file access of
their own, split like other text, and survive lost executors through Spark's commits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trilake.llm.common import stored
from trilake.session import scratch_dir

#: Payloads from this many bytes on are stored once.
LEAST_SHARED = 100
MARK = "WARC/1.1"
VERSION = f"{MARK}\r\n"
END = "\r\n\r\n"
#: Captures are dated one second apart, as the pages have no time of their own.
FIRST_CAPTURE = "2024-01-01 00:00:00"
#: Captures that one task merges, about.
RANGE_ROWS = 100_000
ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), ("/", "%2F"))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to of each page."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
        F.length(raw).cast("long").alias("payload_bytes"), F.sha2(raw, 256).alias("payload_digest"),
    )
    large = F.col("payload_bytes") >= LEAST_SHARED
    # the first page of every payload that occurs twice or more: a narrow table
    firsts = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = stored(firsts.where("n > 1").select(F.col("payload_digest").alias("shared"), "first_id"), "warc-firsts")
    # short payloads get a key of their own, or all of them would meet in one task
    key = F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("url", F.lit(""))))
    joined = rows.withColumn("_key", key).join(firsts, F.col("_key") == F.col("shared"), "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.withColumn("refers_to", refers).drop("_key", "shared", "first_id")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """One WARC record for each page as text, without the two line ends after its block."""
    rows = payloads(pages)
    revisit = F.col("refers_to").isNotNull()
    # the reader splits archives at the version line; a payload that holds its text is stored in
    # base64, with or without a line end, as the line end after the block would complete it
    unsafe = F.instr("html", MARK) > 0
    body = F.when(revisit, F.lit("")).when(unsafe, F.base64(F.col("html").cast("binary"))).otherwise(F.col("html"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(unsafe & ~revisit, F.lit("Content-Transfer-Encoding: base64\r\n")).otherwise(F.lit("")),
        _line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    block = F.concat(http, body)
    # without a zone, so that the session's zone has no part in it
    seconds = F.make_dt_interval(secs=F.unix_timestamp(capture_time(F.col("page_id"))).cast("decimal(18,6)"))
    when = F.concat(F.replace((F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + seconds).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    # a header is one line: percent-encode an address that has line ends or the version's text, and say so
    odd = F.col("url").rlike("[\r\n]") | (F.instr("url", MARK) > 0)
    escaped = F.col("url")
    for plain, code in ESCAPES:
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    target = F.when(odd, F.concat(_line("X-URI-Escaped", F.lit("yes")), _line("WARC-Target-URI", escaped)))
    target = target.when(F.col("url").isNull(), F.lit("")).otherwise(_line("WARC-Target-URI", F.col("url")))
    header = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        target,
        _line("WARC-Date", when),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, block).alias("value"))


def capture_time(page_id: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(f"{FIRST_CAPTURE}Z"))) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1_000_000_000)))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the pages as WARC files below `path`, one for each task."""
    records(pages).write.option("lineSep", END).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files written by ``write_archives``: page_id, url, captured_at,
    record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit).

    Lengths and digests are those of what was read; one that differs from its header
    raises an error, as does a piece without an id, a type, a length or a digest.
    """
    # a piece is what follows a version line: header lines, an empty line, the block, two line ends
    piece = spark.read.option("lineSep", VERSION).text(path).where("value <> ''")
    cut = F.instr("value", END)
    rows = piece.select(
        F.substring("value", F.lit(1), cut + 1).alias("head"),
        F.expr("substring(value, instr(value, '\\r\\n\\r\\n') + 4, length(value) - instr(value, '\\r\\n\\r\\n') - 7)").alias("block"),
    )

    def header(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r]*)", 1)
        return F.when(found != "", found)

    split = F.instr("block", END)
    http = F.substring("block", F.lit(1), split + 1)
    body = F.expr("substring(block, instr(block, '\\r\\n\\r\\n') + 4)")
    stated = F.regexp_extract(http, r"\nContent-Length: (\d+)", 1).try_cast("long")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    kind = header("WARC-Type")
    payload = F.when(F.instr(http, "Content-Transfer-Encoding: base64") > 0, F.unbase64(body)).otherwise(body.cast("binary"))
    # an empty address has a line, a null one has none
    address = F.when(F.instr("head", "\nWARC-Target-URI: ") > 0, F.coalesce(header("WARC-Target-URI"), F.lit("")))
    restored = address
    for plain, code in reversed(ESCAPES):
        restored = F.replace(restored, F.lit(code), F.lit(plain))
    named = header("WARC-Record-ID").rlike(r"^<urn:page:(none|-?\d+)>$") & kind.isin("response", "revisit")
    read = rows.select(
        F.coalesce(named, F.lit(False)).alias("named"),
        number(header("WARC-Record-ID")).alias("page_id"),
        F.when(header("X-URI-Escaped") == "yes", restored).otherwise(address).alias("url"),
        F.to_timestamp(header("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ssX").alias("captured_at"),
        kind.alias("record_type"),
        number(F.coalesce(header("WARC-Refers-To"), F.lit(""))).alias("refers_to"),
        stated.alias("stated"),
        F.regexp_extract("head", r"\nWARC-Payload-Digest: sha256:([0-9a-f]+)", 1).alias("stated_digest"),
        F.when(kind == "response", payload).alias("payload"),
        (header("Content-Length").try_cast("long") == F.octet_length("block")).alias("whole"),
    )
    lacking = ~F.col("named") | F.col("whole").isNull() | F.col("stated").isNull() | (F.col("stated_digest") == "")
    wrong = lacking | ~F.col("whole") | (F.length("payload") != F.col("stated")) | (F.sha2("payload", 256) != F.col("stated_digest"))
    broken = F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    return read.select(
        "page_id", "url", "captured_at", "record_type", "refers_to",
        F.when(F.coalesce(wrong, F.lit(False)), broken.cast("long")).otherwise(F.col("stated")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("stated_digest")).alias("payload_digest"),
        "payload",
    )


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then the path: pages of a site sort together."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    host, path = F.regexp_extract(rest, r"^([^/?#]*)", 1), F.regexp_extract(rest, r"^[^/?#]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


class LoserTree:
    """Merges k sorted iterators: inner nodes keep the loser of their match, so the next
    item costs one comparison for each level above the run it came from."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at > 0:
            other = self.losers[at]
            if other < 0:
                self.losers[at] = winner
                return
            if self._beats(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.losers[0]]) is not None:
            winner = self.losers[0]
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            self._play(winner)


ENTRY = ["url_key", "captured_at", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]


def sorted_runs(captures: DataFrame) -> DataFrame:
    """The captures in one sorted run for each task that reads archives, with the run's number."""
    entries = captures.withColumn("url_key", url_key(F.col("url"))).select(*ENTRY)
    return stored(
        entries.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in ENTRY]).withColumn("run", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()),
        "warc-runs",
    )


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures by the columns of ``ENTRY``, nulls last: in order within each
    partition, and partitions in order.

    Ranges of about `range_rows` captures are dealt out, so what a task holds does not grow
    with the table. The place of a capture in its run is the last part of the range's key:
    one URL, or one row that is repeated without end, is spread over several tasks. Within
    a range each run comes in its order, and the loser tree merges the runs.
    """
    schema = runs.schema
    at_entry = [schema.fieldNames().index(c) for c in ENTRY]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [b for b in batches if b.num_rows]
        if not full:
            return
        held = pa.Table.from_batches(full)
        columns = [held.column(i) for i in at_entry]
        # timestamps are compared as numbers
        values = [(c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c).to_pylist() for c in columns]
        number = [tuple((v is None, v if v is not None else 0) for v in row) for row in zip(*values)]
        run = held.column("run").to_pylist()
        starts = [i for i in range(len(run)) if i == 0 or run[i] != run[i - 1]] + [len(run)]
        cursors = [zip(number[a:b], range(a, b)) for a, b in zip(starts, starts[1:])]
        order = [i for _, i in LoserTree(cursors)]
        for at in range(0, len(order), 10_000):
            yield from held.take(order[at : at + 10_000]).combine_chunks().to_batches()

    keys = [*[F.col(c).asc_nulls_last() for c in ENTRY], F.col("place")]
    ranges = math.ceil(runs.count() / range_rows)
    # below the session's number of partitions, adaptive execution merges small ones
    most = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(ranges, *keys) if ranges > most else runs.repartitionByRange(*keys)
    return dealt.sortWithinPartitions("run", "place").mapInArrow(merged, schema)


def capture_histories(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as WARC archives, read them back, and give their captures in global
    order: the columns of ``ENTRY``.

    Of pages with equal payloads of at least ``LEAST_SHARED`` bytes, that with the
    smallest page_id is the response and the others are revisits that refer to it; rows
    that share the smallest page_id are all responses. Shorter payloads are all responses.

    Null html is an empty payload; a null url has an empty key and no target line. A null
    page_id is a revisit of a page with a number, or else a response. Payloads that hold
    the text of a WARC version line are stored in base64 and come back as they were. Ties in the
    order go to page_id, then url. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "warc")
    write_archives(pages.select("page_id", "url", "html"), path)
    return merge_runs(sorted_runs(read_archives(spark, path))).select(*ENTRY)
