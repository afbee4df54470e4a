"""A content-addressed WARC archive: payload bytes once, exact record headers apart, records again by a join.

``write_archive`` makes two tables. ``payloads`` has each distinct payload once under its SHA-256, verified: rows are
grouped by digest and bytes, and two different payloads under one digest stop the job. ``headers`` has for each record the
exact bytes that stand before its payload in a WARC 1.1 file (the record's header, which carries type, id, date, digests, length and what it refers to, and
the HTTP header that its block begins with) and the digest that its payload is stored under.
``read_archive`` verifies every stored payload against its key again and joins it to the headers. All of that runs in the JVM.
``export_warc`` writes the records as ``.warc`` files, or ``.warc.gz`` with a member for each record, and ``records_of`` reads such files.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asclepia.llm._base import arrow, joined, shared_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: The date of records whose pages tell none.
DATE = "1970-01-01T00:00:00Z"
#: Payloads up to this size are broadcast if very many records share them (1,000 of them at most).
SMALL_PAYLOAD = 16 << 10


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1, 32 characters: 5 hex digits are 20 bits are 4 characters."""
    digest = F.sha1(data)
    out = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def _header(kind: Column) -> Column:
    """The exact bytes before a record's payload. Its id is a function of page and payload, so a rerun writes the same bytes.

    A URL that a header line can't hold as it is (null, empty, or with line ends or outer spaces) is kept in base64; the target is then the record's id.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uid = lambda of: F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(" ", F.lit("record"), of.cast("string"), F.hex("key"))), r"(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))
    named = lambda of: F.concat(F.lit("<"), uid(of), F.lit(">"))
    odd = F.col("url").isNull() | (F.col("url") == "") | F.col("url").rlike(r"[\r\n]|^\s|\s$")
    revisit = kind == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", named(F.col("id"))), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.when(odd, uid(F.col("id"))).otherwise(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", named(F.col("first_id"))),
            line("WARC-Refers-To-Page", F.col("first_id").cast("string")),
        )).otherwise(F.lit("")),
        line("X-Page-ID", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        F.when(odd & F.col("url").isNotNull(), line("X-Page-URL", F.concat(F.lit("base64:"), F.base64(F.encode(F.col("url"), "UTF-8"))))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF), http,
    )


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: Column | str = DATE) -> None:
    """One WARC record per row of ``pages`` into ``folder``/payloads and ``folder``/headers.

    Of records with equal payloads of at least ``least`` bytes, that with the smallest id is a response and the others are
    revisits of it; smaller payloads are all responses. A null payload counts as empty; a null id is never referred to if
    its payload also has other ids; repeated rows with the smallest id are all responses; an empty table gives an empty archive.
    ``date`` is a W3C date, or a column of them (null: ``DATE``).
    """
    spark = pages.sparkSession
    dated = F.coalesce(date if isinstance(date, Column) else F.lit(date), F.lit(DATE))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), dated.alias("date"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    # Equal payloads fold on the map side; the group's key holds the bytes, so the comparison is of full bytes.
    stored = rows.groupBy("key", "payload").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("records"))
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    store = spark.read.parquet(f"{folder}/payloads")
    known = store.select(F.col("key").alias("_key"), "first_id", "records", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    known = known.groupBy(F.col("_key").alias("key")).agg(*[F.first(c).alias(c) for c in ("first_id", "records", "sha1", "bytes")], F.count(F.lit(1)).alias("_n"))
    known = known.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("two payloads share one SHA-256"))).otherwise(F.col("_n")))
    known = known.filter("_n = 1")
    total = store.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    records = joined(rows.select("id", "url", "date", "key"), known, "key", "records", total)
    first = F.col("id").eqNullSafe(F.col("first_id"))
    kind = F.when((F.col("bytes") < least) | first, F.lit("response")).otherwise(F.lit("revisit"))
    records.select(F.encode(_header(kind), "UTF-8").alias("header"), F.col("key").alias("payload_key")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records: header and payload as bytes, with what both say: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest. A payload that isn't what its key says, or whose header names another digest or length, stops the job."""
    store = spark.read.parquet(f"{folder}/payloads")
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("key"), F.col("key")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")).cast("binary"))
    # How many records share a payload that is small enough for a broadcast.
    shared = F.when(F.octet_length("payload") <= SMALL_PAYLOAD, F.col("records")).otherwise(F.lit(0))
    store = store.select(sound.alias("key"), "payload", base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), shared.alias("_shared"))
    heads = spark.read.parquet(f"{folder}/headers")
    total = heads.count()
    text = F.decode(F.col("header"), "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(F.col("_text"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    url = F.when(F.concat(F.lit("<"), field("WARC-Target-URI"), F.lit(">")) == field("WARC-Record-ID"), F.decode(F.unbase64(F.regexp_extract("_text", r"\r\nX-Page-URL: base64:([^\r\n]*)\r\n", 1)), "UTF-8")).otherwise(field("WARC-Target-URI"))
    none = (F.concat(F.lit("<"), field("WARC-Target-URI"), F.lit(">")) == field("WARC-Record-ID")) & ~F.contains("_text", F.lit(f"{CRLF}X-Page-URL: "))
    heads = heads.withColumn("_text", text).select(
        "header", F.col("payload_key").alias("key"), field("X-Page-ID").cast("long").alias("page_id"), F.when(~none, url).alias("url"),
        field("WARC-Type").alias("record_type"), field("WARC-Refers-To-Page").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest").alias("_said"), field("X-Payload-Length").cast("long").alias("_length"),
    )
    records = joined(heads, store, "key", "_shared", total)
    agrees = (F.col("_said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("_length") == F.col("payload_bytes"))
    return records.withColumn("payload_digest", F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header differs from its payload")).cast("string"))).select(
        "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "header", "payload"
    )


def record_bytes() -> Column:
    """A whole record as it stands in a WARC file, from read_archive's columns; a revisit has no payload."""
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    return F.when(F.col("record_type") == "revisit", F.concat(F.col("header"), end)).otherwise(F.concat(F.col("header"), F.col("payload"), end))


def export_warc(records: DataFrame, folder: str, compressed: bool = True) -> DataFrame:
    """Writes ``records`` (read_archive's) as WARC files in ``folder``, one for each partition with rows: path, records, bytes.

    A file gets its name when it is whole, so a task that runs again leaves the same files.
    """
    arrow(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, n, size = None, 0, 0
        name = f"part-{TaskContext.get().partitionId():06d}.warc" + ".gz" * compressed
        for batch in batches:
            for record in batch.column(0).to_pylist():
                if out is None:
                    fs, path = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(path, recursive=True)
                    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary, compression=None)
                data = gzip.compress(record, 6, mtime=0) if compressed else record
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            fs.move(temporary, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    return records.select(record_bytes().alias("record")).mapInArrow(run, "path string, records long, bytes long")


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the block of each record of a WARC file's bytes, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    file = io.BytesIO(data)
    while version := file.readline():
        if version.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        block = file.read(int(fields["Content-Length"]))
        if len(block) < int(fields["Content-Length"]) or file.read(4) != b"\r\n\r\n":
            raise ValueError("a record isn't whole")
        yield fields, block


def archived(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` to a fresh archive in the shared folder and reads the records back."""
    folder = shared_dir(pages.sparkSession, "warc")
    write_archive(pages, folder, **options)
    return read_archive(pages.sparkSession, folder)
