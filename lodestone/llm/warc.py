"""Content-addressed WARC archive: payload bytes once for each digest, exact record headers beside them, records by joins.

An archive is a folder of three tables. payloads (digest, payload): the bytes of
every different payload, under its SHA-256. holders (digest, header): the header
of one record of each payload, that of the largest page_id. others (digest,
header): those of the remaining records. A header is the exact bytes from the
version line up to the payload: WARC fields, blank line, the head of the HTTP
message, blank line. payloads and holders are bucketed by digest alike, so that
joining them moves nothing.

Records of equal payloads of at least min_bytes: the holder's is a response, the
others are revisits of it, without payload; smaller ones are all responses.
Equal means of one SHA-256, and SHA-1 and length are checked to agree in each
group. A null html is an empty payload. Rows of one page_id and payload: one of
them, by url, is the response, the others revisit it. A null page_id counts as
the smallest and is null again when read; a null url is no field. CR and LF in a
url are percent-encoded in the header. An empty table makes an empty archive.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.runtime import keep_until_exit, materialize, shared_dir, tune

HOT = 1000  # a digest with more than one in so many records is hot; there are at most so many of these
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"


def base32(sha1_hex: Column) -> Column:
    """Forty hexadecimal digits as 32 of RFC 4648's base 32, in capitals."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def join_hot(rows: DataFrame, table: DataFrame, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the row of table that has their digest; those of the digests in hot, HOT rows at most, meet them where they are."""
    marks = F.broadcast(hot.select("digest"))
    few = table.join(marks, "digest", "left_semi")
    return rows.join(marks, "digest", "left_semi").join(F.broadcast(few), "digest", how).unionByName(rows.join(marks, "digest", "left_anti").join(table, "digest", how))


def _uri(page_id: Column, uid: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), uid.cast("string"), F.lit(">"))


def _header(date: str) -> Column:
    """The header of a record from columns page_id, uid, url, sha1, n_bytes, top (page_id and uid of the payload's response) and revisit."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _uri(F.col("top.page_id"), F.col("top.uid")), F.lit("\r\n"))
    fields = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), _uri(F.col("page_id"), F.col("uid")),
        F.lit(f"\r\nWARC-Date: {date}\r\n"), F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")), F.when(F.col("revisit"), again).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("n_bytes"))).cast("string"), F.lit(END),
    )
    return F.concat(fields, http).cast("binary")


def _hot(groups: DataFrame) -> DataFrame:
    """digest of the groups (digest, n) that have more than one in HOT of all records."""
    total = groups.agg(F.sum("n").alias("total"))
    return groups.crossJoin(F.broadcast(total)).where(F.col("n") * HOT > F.col("total")).select("digest")  # one row


class Archive:
    """The tables of an archive under root. Bucketed tables have a name in the session's catalog."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.name = spark, root, f"warc_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _save(self, df: DataFrame, table: str) -> None:
        df.write.format("parquet").bucketBy(self.buckets, "digest").option("path", f"{self.root}/{table}").option("compression", "zstd").saveAsTable(f"{self.name}_{table}")

    @property
    def payloads(self) -> DataFrame:
        return self.spark.table(f"{self.name}_payloads")

    @property
    def holders(self) -> DataFrame:
        return self.spark.table(f"{self.name}_holders")

    @property
    def others(self) -> DataFrame:
        return self.spark.read.schema("digest binary, header binary").parquet(f"{self.root}/others")

    def write(self, pages: DataFrame, min_bytes: int = 0, date: str = DATE) -> Archive:
        """Archive pages (page_id, url, html).

        Digests of all rows are written first; which record holds a payload is
        decided among these, and payloads move once, to their buckets.
        """
        payload = F.coalesce("html", F.lit("")).cast("binary")
        hashed = pages.select(
            F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.monotonically_increasing_id().alias("uid"),
            F.unhex(F.sha2(payload, 256)).alias("digest"), base32(F.upper(F.sha1(payload))).alias("sha1"), F.octet_length(payload).cast("bigint").alias("n_bytes"),
        )
        rows = materialize(hashed)
        groups = materialize(rows.groupBy("digest").agg(F.max(F.struct("page_id", "url", "uid")).alias("top"), F.count("*").alias("n"), F.min("sha1").alias("sha1_a"), F.max("sha1").alias("sha1_z"), F.min("n_bytes").alias("a"), F.max("n_bytes").alias("z")))
        checked = F.when((F.col("sha1_a") == F.col("sha1_z")) & (F.col("a") == F.col("z")), F.col("top")).otherwise(F.raise_error(F.lit("different payloads of one digest")))
        typed = join_hot(rows, groups.select("digest", checked.alias("top")), _hot(groups))
        holds = F.col("uid") == F.col("top.uid")
        headers = materialize(typed.withColumn("revisit", ~holds & (F.col("n_bytes") >= min_bytes)).select("digest", holds.alias("holds"), _header(date).alias("header")))
        self._save(headers.where("holds").drop("holds"), "holders")
        headers.where("NOT holds").drop("holds").write.option("compression", "zstd").parquet(f"{self.root}/others")
        self._save(pages.select(F.unhex(F.sha2(payload, 256)).alias("digest"), payload.alias("payload")).dropDuplicates(["digest"]), "payloads")
        return self

    def verified(self) -> DataFrame:
        """payloads, each checked against its digest when it is read; another content is an error."""
        same = F.unhex(F.sha2("payload", 256)) == F.col("digest")
        return self.payloads.select("digest", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("a payload is not what its digest says"))).alias("payload"))

    def held(self) -> DataFrame:
        """digest, header, record of the records that hold payloads, one for each; header and payload meet in their bucket."""
        return self.holders.join(self.verified(), "digest").select("digest", "header", F.concat("header", "payload", F.lit(END).cast("binary")).alias("record"))

    def records(self) -> DataFrame:
        """header and the exact bytes of every record: responses with their payload, revisits without."""
        rest, end = self.others, F.lit(END).cast("binary")
        revisit = _field("Type") == "revisit"
        sizes = rest.where(~revisit).groupBy("digest").agg(F.count("*").alias("n"))
        small = join_hot(rest.where(~revisit), self.verified(), _hot(sizes)).select("header", F.concat("header", "payload", end).alias("record"))
        return self.held().select("header", "record").unionByName(small).unionByName(rest.where(revisit).select("header", F.concat("header", end).alias("record")))

    def digests(self) -> DataFrame:
        """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, the payload's figures from the reconstructed record that holds it."""
        head = F.col("header").cast("string")
        http = F.octet_length(head) - F.octet_length(F.substring_index(head, END, 1)) - len(END)  # the head of the message, behind the WARC fields, in bytes
        n = _field("Content-Length", "").cast("bigint") - http
        payload = F.substring(F.col("record"), F.length("header") + 1, F.octet_length("record"))
        payload = F.substring(payload, F.lit(1), n.cast("int"))
        found = self.held().select("digest", "header", n.alias("payload_bytes"), F.octet_length(payload).cast("bigint").alias("there"), base32(F.upper(F.sha1(payload))).alias("payload_digest"))
        good = (F.col("there") == F.col("payload_bytes")) & (F.concat(F.lit("sha1:"), F.col("payload_digest")) == _field("Payload-Digest"))
        held = found.withColumn("payload_bytes", F.when(good, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a record is not what its header says"))))
        held = materialize(held.drop("there"))
        rest = self.others
        rest = join_hot(rest, held.select("digest", "payload_bytes", "payload_digest"), _hot(rest.groupBy("digest").agg(F.count("*").alias("n"))))
        number = lambda field: F.regexp_extract(_field(field), r"<urn:x-page:(-?[0-9]*):", 1)
        every = held.unionByName(rest)
        refers = F.when(_field("Type") == "revisit", F.nullif(number("Refers-To"), F.lit("")))
        return every.select(F.nullif(number("Record-ID"), F.lit("")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", _field("Type").alias("record_type"), refers.cast("bigint").alias("refers_to"))


def _field(name: str, prefix: str = "WARC-") -> Column:
    """A field of a record's header, the first of its name."""
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{prefix}{name}: ([^\r\n]*)", 1)


def roundtrip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive pages and read the archive back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    keep_until_exit(spark, root)
    return Archive(spark, root).write(pages, min_bytes).digests()


# ---- WARC files


def write_files(records: DataFrame, path: str, files: int | None = None) -> None:
    """Write records (record) as gzipped WARC files, one for each task, by Spark's text sink: the separator of lines is the end of a record."""
    rows = records if files is None else records.repartition(files)
    lines = rows.select(F.substring(F.col("record"), F.lit(1), F.octet_length("record") - len(END)).cast("string").alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header and payload of each record of a WARC file, plain or gzipped as a whole or record by record.

    The header is the WARC fields and, in records of HTTP messages, the head of
    the message; the payload what follows.
    """
    if raw[:2] == b"\x1f\x8b":
        parts, rest = [], raw
        while rest:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest) + member.flush())
            rest = member.unused_data
        raw = b"".join(parts)
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in raw[at:end].split(b"\r\n")[1:])}
        begin, stop = end + 4, end + 4 + int(fields[b"content-length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        head = raw.find(b"\r\n\r\n", begin, stop) + 4 if fields.get(b"content-type", b"").startswith(b"application/http") else begin
        head = begin if head < begin else head
        yield raw[at:head], raw[head:stop]
        at = stop + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """header, payload of the records of WARC files under path; a task reads whole files."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                some: list[tuple[bytes, bytes]] = []
                size = 0
                for record in parse(raw):
                    some.append(record)
                    size += len(record[0]) + len(record[1])
                    if size > 8 << 20:
                        yield _batch(some)
                        some, size = [], 0
                yield _batch(some)

    tune(spark, 1)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, payload binary")


def _batch(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"header": pa.array([r[0] for r in rows], pa.binary()), "payload": pa.array([r[1] for r in rows], pa.binary())})
