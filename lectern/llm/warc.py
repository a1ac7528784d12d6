"""WARC archives: writing, normalising monolithic gzip, reading back by offset index.

Spark's text sink writes records as whole-file gzip streams, of one member each. The normaliser
inflates such a stream once, in blocks, rewrites every record as its own gzip member and writes a
sidecar index (offset, length per line) beside the archive, so any record can be read alone. The
reader takes the index and inflates single members.

Archives are written to a temporary name and moved, so a task that runs again replaces its own work.
Files are opened with pyarrow's file systems by URI: driver and executors must reach the folder.

Records of one payload (of `least` bytes or more) are one response, at the largest page_id, and
revisits that refer to it. Payload groups are counted with partial sums; only groups of two or more are
joined back, with both sides shuffled, so AQE can split a payload that very many pages share.

Defined cases: null html is an empty payload; a null url leaves its header out, white space in one is
percent-coded; repeated rows of the largest page_id are each a response; a null page_id never is the
largest and its record has an empty id, read back as null; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import arrow_text as A
from lectern.llm.shared import written

BLOCK = 1 << 20
DATE = "2000-01-01T00:00:00Z"


def classified(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, payload, payload_bytes, digest, refers_to)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("digest"))
    groups = written(
        rows.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1 and first is not null").drop("n"),
        "payloads",
    )
    return rows.join(groups, ["digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )


def write_monolithic(records: DataFrame, path: str, per_file: int = 5_000) -> None:
    """Write classified records as WARC files, each one gzip stream."""
    crlf = "\r\n"
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.concat(
        F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes"), F.lit(crlf * 2), F.col("payload")))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "[\r\n]", "%0A"), r"\s", "%20")
    head = F.concat_ws(
        crlf, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), ident, F.lit(">")), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">")),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes"))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    lines = records.select(F.concat(head, F.lit(crlf * 2), block, F.lit(crlf)).alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", crlf).option("maxRecordsPerFile", per_file).text(path)


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, block by block."""
    engine = zlib.decompressobj(31)
    while data := stream.read(BLOCK):
        while data:
            if engine.eof:
                engine = zlib.decompressobj(31)
            yield engine.decompress(data, 4 * BLOCK)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, 4 * BLOCK)
            data = engine.unused_data


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records (head, block and the two line ends after it) of a byte stream."""
    held, need = bytearray(), None
    for data in blocks:
        held += data
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 8 + int(re.search(rb"(?im)^Content-Length: *(\d+)", held[:end])[1])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("a WARC stream ends inside a record")


def normalise(files: DataFrame, out: str) -> DataFrame:
    """Rewrite the archives at files (path) into the folder `out`; (archive, records, bytes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(out)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for uri in A.column(batch, "path").to_pylist():
                source, path = located(uri)
                name = re.sub(r"(\.txt)?\.gz$", "", path.rsplit("/", 1)[-1]) + ".warc.gz"
                mark = uuid.uuid4().hex
                at = n = 0
                lines = []
                with source.open_input_file(path) as stream, store.open_output_stream(f"{root}/.{name}-{mark}", compression=None) as sink:
                    for record in records(inflated(stream)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(record) + engine.flush()
                        sink.write(member)
                        lines.append(f"{at} {len(member)}\n")
                        at += len(member)
                        n += 1
                with store.open_output_stream(f"{root}/.{name}.idx-{mark}", compression=None) as sink:
                    sink.write("".join(lines).encode())
                store.move(f"{root}/.{name}-{mark}", f"{root}/{name}")
                store.move(f"{root}/.{name}.idx-{mark}", f"{root}/{name}.idx")
                yield pa.RecordBatch.from_arrays([pa.array([f"{out}/{name}"]), pa.array([n], pa.int64()), pa.array([at], pa.int64())], ["archive", "records", "bytes"])

    return files.select("path").mapInArrow(run, "archive string, records bigint, bytes bigint")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, length) of all records in a folder of normalised archives."""
    parts = F.split("value", " ")
    return spark.read.schema("value string").text(f"{path}/*.idx").select(
        F.regexp_replace("_metadata.file_path", r"\.idx$", "").alias("archive"), parts[0].cast("long").alias("offset"), parts[1].cast("long").alias("length"))


def parsed(record: bytes) -> tuple:
    """(page_id, payload_bytes, digest, type, refers_to) of a record; of a response, of its payload itself."""
    head, block = record.split(b"\r\n\r\n", 1)
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    own = re.fullmatch(r"<urn:page:(-?\d*)>", fields["warc-record-id"])[1]
    page = int(own) if own else None
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return page, int(fields["x-payload-length"]), stated, "revisit", int(fields["warc-refers-to"][len("<urn:page:") : -1])
    payload = block[: int(fields["content-length"])].split(b"\r\n\r\n", 1)[1]
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"record {page}: payload digest is {digest}, not {stated}")
    return page, len(payload), digest, "response", None


def read_records(index: DataFrame) -> DataFrame:
    """The records that index (archive, offset, length) points at, each inflated alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(A.column(batch, c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    if stream:
                        stream.close()
                    store, path = located(archive)
                    name, stream = archive, store.open_input_file(path)
                stream.seek(offset)
                out.append(parsed(zlib.decompress(stream.read(length), 31)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(5)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def dealt(index: DataFrame, slice_bytes: int = 4 << 20, partition_bytes: int = 64 << 20) -> DataFrame:
    """index in partitions by the bytes that its rows point at (the rows themselves are small): slices of an archive in
    order, and so many partitions that each has about partition_bytes, or one for each core."""
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(-(-total // partition_bytes), min(-(-total // slice_bytes), index.sparkSession.sparkContext.defaultParallelism), 1)
    return index.repartition(int(parts), "archive", F.floor(F.col("offset") / slice_bytes)).sortWithinPartitions("archive", "offset")


def archive(pages: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """Write pages as normalised archives with indexes under `path`; the index of all records."""
    spark = pages.sparkSession
    write_monolithic(classified(pages, least), f"{path}/monolithic")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/monolithic").select("path")
    if not files.limit(1).count():
        return spark.createDataFrame([], "archive string, offset long, length long")
    done = normalise(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"), f"{path}/archives")
    done.write.parquet(f"{path}/manifest")
    return read_index(spark, f"{path}/archives")
