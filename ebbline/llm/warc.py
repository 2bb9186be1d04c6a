"""Web archives as seekable Zstandard bundles of WARC records."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

#: Fixed values of the public formats: the seekable Zstandard footer and the WARC revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

INDEX = "page_id long, record_id string, record_type string, refers_to long, bundle string, frame int, offset long, length long"
RECORDS = "bundle string, page_id long, url string, record_id string, record_type string, refers_to long, refers_to_record string, payload_digest string, payload binary"


def record_id(page_id: int | None, url: str | None, tie: int) -> str:
    """Follows from the page and from where its row lies in the table (tie): repeated rows and null ids have ids of their own, and a rerun gives the same."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {tie} {url}')}>"


def record_bytes(page_id, url, tie, payload: bytes, digest: str, first: tuple | None, date: str) -> tuple[str, str, bytes]:
    """The record's id, its type and its bytes. A revisit has no payload block; it names the response (first: its page_id, url and tie) and that one's page.

    A url stands as it is; only one that holds line breaks, which no header can, is kept escaped in a header of our own.
    """
    kind = "response" if first is None else "revisit"
    rid = record_id(page_id, url, tie)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        broken = "\r" in url or "\n" in url
        lines.append("X-Target-URI-Escaped: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if broken else "WARC-Target-URI: " + url)
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*first)}", f"X-Refers-To-Page: {first[0]}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return rid, kind, "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class Bundle:
    """One archive: frames that can be read alone, then a skippable frame with the size of each (the seek table)."""

    def __init__(self, stream, level: int):
        import zstandard

        self.stream, self.press, self.sizes, self.raw, self.total = stream, zstandard.ZstdCompressor(level=level), [], bytearray(), 0

    def add(self, record: bytes, frame_bytes: int) -> tuple[int, int]:
        """The record's frame and its offset in the decompressed frame."""
        if self.raw and len(self.raw) + len(record) > frame_bytes:
            self.end_frame()
        at = len(self.sizes), len(self.raw)
        self.raw += record
        return at

    def end_frame(self) -> None:
        if self.raw:
            pressed = self.press.compress(bytes(self.raw))
            self.stream.write(pressed)
            self.sizes.append((len(pressed), len(self.raw)))
            self.total += len(self.raw)
            self.raw = bytearray()

    def close(self) -> None:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.stream.close()


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the end of the archive."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the archive")
    out, at = [], 0
    for k in range(n):
        packed, size = struct.unpack_from("<II", content, len(content) - 9 - 8 * (n - k))
        out.append((at, packed, size))
        at += packed
    return out


def parse_record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The headers and the block of the record that starts at `at`, and where the next one starts."""
    head = raw.index(b"\r\n\r\n", at)
    lines = raw[at:head].decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    return fields, raw[head + 4 : head + 4 + n], head + 8 + n


def row_of(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(fields[k]) if k in fields else None
    url, escaped = fields.get("WARC-Target-URI"), fields.get("X-Target-URI-Escaped")
    if escaped is not None:
        url = escaped.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return number("X-Page-ID"), url, fields["WARC-Record-ID"], fields["WARC-Type"], number("X-Refers-To-Page"), fields.get("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha256:"), block


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


RECORD_SCHEMA = pa.schema([("bundle", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary())])
INDEX_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, folder: str, *, least_revisit: int = 100, frame_bytes: int = 1 << 18, bundle_bytes: int = 32 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) into archives below `folder`; returns the index.

    The index maps each record to its archive, frame, and offset and length in that frame. It is a
    table in `folder`: archives are named by task attempt, and only those that it lists count, so a
    task that ran twice or failed leaves no doubt. A null html is an empty payload. Of equal
    payloads of `least_revisit` bytes or more, the smallest page_id has the response (each row, if
    it is repeated) and the rest are revisits; null ids come last, and with none but null ids all
    are responses. Payloads that can have no revisit (shorter ones, or found once) meet no other row. No rows give an empty index.
    Other columns are ignored. pages is read twice and must give its rows in the same partitions and order, as a table does.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("tie"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= least_revisit
    one = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "tie", "url"))
    first = rows.filter(long_enough).groupBy("digest").agg(F.min(one).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # written, so that the join can split the pages of a digest that very many share
    first = written(first, "warc-first")
    revisit = ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    met = rows.filter(long_enough).join(first, "digest", "left").withColumn("first", F.when(revisit, F.col("first")))
    columns = ["page_id", "url", "tie", "digest", "payload", "first"]
    rows = rows.filter(~long_enough).withColumn("first", F.lit(None).cast(first.schema["first"].dataType)).select(*columns).unionByName(met.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        task, made, bundle, out, name = TaskContext.get(), 0, None, [], ""
        for batch in batches:
            for page_id, url, tie, digest, payload, first in zip(*(batch.column(k) for k in range(6)), strict=True):
                page_id, url, first = page_id.as_py(), url.as_py(), first.as_py()
                first = first and (first["page_id"], first["url"], first["tie"])
                if bundle is None:
                    name = f"bundle-{task.partitionId():06d}-{made:05d}-{task.taskAttemptId()}.warc.zst"
                    bundle, made = Bundle(store.open_output_stream(f"{top}/{name}", compression=None), level), made + 1
                rid, kind, record = record_bytes(page_id, url, tie.as_py(), payload.as_py(), digest.as_py(), first, date)
                frame, offset = bundle.add(record, frame_bytes)
                out.append((page_id, rid, kind, first and first[0], name, frame, offset, len(record)))
                if bundle.total + len(bundle.raw) >= bundle_bytes:
                    bundle.close()
                    bundle = None
            yield batch_of(out, INDEX_SCHEMA)
            out = []
        if bundle is not None:
            bundle.close()

    index = f"{folder}/index.parquet"
    rows.mapInArrow(run, INDEX).write.parquet(index)
    return pages.sparkSession.read.schema(INDEX).parquet(index)


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all archives in the folder, decoded frame by frame where each archive is read.

    A bundle that the index doesn't list, left by an attempt that failed, is told by its name: see `listed`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for bundle, content in zip(batch.column(0), batch.column(1), strict=True):
                bundle, content = bundle.as_py(), content.as_py()
                for at, packed, size in seek_table(content):
                    raw, here, rows = zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=size), 0, []
                    while here < len(raw):
                        fields, block, here = parse_record(raw, here)
                        rows.append((bundle, *row_of(fields, block)))
                    yield batch_of(rows, RECORD_SCHEMA)

    return _archives(spark, folder).select("bundle", "content").mapInArrow(run, RECORDS)


def listed(records: DataFrame, index: DataFrame) -> DataFrame:
    """The records of the bundles that the index lists. Project first: what is joined here is shuffled."""
    return records.join(index.select("bundle").distinct(), "bundle", "left_semi")


def fetch_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records of some rows of an index: only their frames are decoded, each once."""
    by_bundle = wanted.groupBy("bundle", "frame").agg(F.collect_list(F.col("offset")).alias("offsets")).groupBy("bundle").agg(F.collect_list(F.struct("frame", "offsets")).alias("frames"))
    files = _archives(spark, folder).join(by_bundle, "bundle").select("bundle", "content", "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for bundle, content, frames in zip(*(batch.column(k) for k in range(3)), strict=True):
                bundle, content = bundle.as_py(), content.as_py()
                table = seek_table(content)
                for f in frames.as_py():
                    at, packed, size = table[f["frame"]]
                    raw = zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=size)
                    yield batch_of([(bundle, *row_of(*parse_record(raw, o)[:2])) for o in f["offsets"]], RECORD_SCHEMA)

    return files.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and reads them back: page_id, payload_bytes, payload_digest (of the payload as read, a revisit's from its response), record_type and refers_to of every row of pages.

    Null and empty htmls are empty payloads, null urls have no header, null ids stay null; a very long html is a frame of its own; repeated
    rows are records of their own; ties between equal payloads go to the smallest page_id; no rows give no rows. Other columns are ignored.
    """
    spark, folder = pages.sparkSession, scratch(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    records = read_archives(spark, folder).select("bundle", "page_id", "record_type", "refers_to", F.col("payload_digest").alias("named"), F.octet_length("payload").cast("long").alias("own_bytes"), F.sha2("payload", 256).alias("own_digest"))
    records = listed(records, index)
    records = written(records, "warc-read")  # without payloads
    revisit = F.col("record_type") == "revisit"
    full = records.filter(~revisit).groupBy(F.col("own_digest").alias("named")).agg(F.max("own_bytes").alias("full_bytes"))
    full = written(full.join(records.filter(revisit).select("named").distinct(), "named"), "warc-full")
    same = records.filter(~revisit).withColumn("full_bytes", F.lit(None).cast("long")).unionByName(records.filter(revisit).join(full, "named", "left"))
    return same.select("page_id", F.when(revisit, F.col("full_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), F.when(revisit, F.col("named")).otherwise(F.col("own_digest")).alias("payload_digest"), "record_type", "refers_to")
