"""WARC archives as seekable Zstandard bundles, one file each.

Records are WARC/1.1 response records, or revisit records for a page whose payload another page's response holds. A
bundle is a run of independent Zstandard frames of a few records each, with the seek table of the Zstandard seekable
format as its footer, so any frame can be read alone. The index gives each record's file, frame and offset in the frame.

Spark's own committer writes the files, to any store that Spark writes, and a retried or lost task leaves no torn file.
Its text sink is the one that can write given bytes: a bundle is one row of a file, and the row's end mark is set to the
last four bytes of the bundle, which are always the magic number of the seek table. The sink names the files
``part-….txt``; what is in them is a complete ``.warc.zst``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.tables import table
from graphloom.plans import cut, join_hot, shared_folder

#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES = 1 << 16
BUNDLE_BYTES = 1 << 24
#: Payloads below this size are never deduplicated.
MIN_REVISIT = 1000
LEVEL = 3
#: Fixed values of the Zstandard seekable format and of WARC/1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: WARC-Date of every record: the pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
#: The last four bytes of every bundle.
END = struct.pack("<I", SEEKABLE_MAGIC)


def seek_table(entries: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, uncompressed) sizes of the frames before it."""
    body = b"".join(struct.pack("<II", *e) for e in entries) + struct.pack("<IB", len(entries), 0) + END
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, uncompressed size) of each frame, from the footer alone."""
    count, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or descriptor:
        raise ValueError("no seek table at the end of the bundle")
    start, out, at = len(bundle) - 9 - 8 * count, [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", bundle, start + 8 * i)
        out.append((at, packed, plain))
        at += packed
    return out


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"


def record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; ``name`` makes its id. A revisit has no block but names the record and digest of its payload."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(name)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(f'{refers_to}/{digest}')}", f"X-Refers-To-Page: {refers_to}"]
    block = payload if refers_to is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record that starts at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    headers = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, data[start:stop], stop + 4


class _Bundle:
    """Records gathered into frames, and frames into one bundle."""

    def __init__(self, level: int = LEVEL) -> None:
        self.squeeze = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()
        self.packed = self.records = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Append a record; the frame and the offset in it where it stands."""
        at = len(self.frames), len(self.open)
        self.open += data
        self.records += 1
        if len(self.open) >= FRAME_BYTES:
            self.end_frame()
        return at

    def end_frame(self) -> None:
        if self.open:
            packed = self.squeeze.compress(bytes(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), len(self.open)))
            self.packed += len(packed)
            self.open = bytearray()

    def close(self) -> bytes:
        self.end_frame()
        return b"".join(self.frames) + seek_table(self.sizes)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, made, bundle, named = TaskContext.get().partitionId(), 0, _Bundle(), set()
    close = lambda: pa.RecordBatch.from_arrays([pa.array([bundle.close()[: -len(END)]], pa.binary())], ["bundle"])
    for batch in batches:
        columns = [batch.column(n) for n in ("page_id", "url", "html", "digest", "refers_to", "named")]
        for row in zip(*columns, strict=True):
            page_id, url, html, digest, refers_to, known = (x.as_py() for x in row)
            # a response that others revisit is named by page and payload, all other records by their place as well
            name = f"{page_id}/{digest}"
            if not known or refers_to is not None or name in named:
                name = f"{name}/{part}/{made}/{bundle.records}"
            else:
                named.add(name)
            bundle.add(record(name, page_id, url, (html or "").encode("utf-8", "replace"), digest, refers_to))
            if bundle.packed >= BUNDLE_BYTES:
                yield close()
                made, bundle = made + 1, _Bundle()
    if bundle.records:
        yield close()


def referred(pages: DataFrame) -> DataFrame:
    """Pages with ``digest`` and ``refers_to``: among equal payloads of MIN_REVISIT bytes or more, the largest page_id;
    ``named`` where the row is a revisit, or the response (of the last url, if its page has more rows) that they name.

    Which page refers to which is found on ids and digests alone, where a payload that many pages share is dealt over
    several tasks; the texts move once, by page and not by payload.
    """
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha1(raw).alias("digest"), F.octet_length(raw).alias("bytes"))
    url = F.coalesce("url", F.lit(""))
    large = pages.where((F.col("bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest", url.alias("place"))
    large = cut(large, "payloads")
    last = large.groupBy("digest").agg(F.max(F.struct("page_id", "place")).alias("last"), F.count("*").alias("n")).where("n > 1")
    named = join_hot(large, cut(last, "responses"), ["digest"])
    named = named.where("page_id < last.page_id or (page_id = last.page_id and place = last.place)")
    refers_to = F.when(F.col("page_id") < F.col("last.page_id"), F.col("last.page_id"))
    named = named.select("page_id", "digest", "place", refers_to.alias("refers_to"), F.lit(True).alias("named")).distinct()
    # null ids never revisit; they are spread by their url instead of meeting in one task
    key = F.xxhash64("page_id", "digest", "place")
    own = F.when(F.col("page_id").isNull(), F.xxhash64("url", "digest")).otherwise(key)
    pages = pages.withColumn("place", url)
    joined = pages.withColumn("key", own).join(named.withColumn("key", key), ["key", "page_id", "digest", "place"], "left")
    return joined.select("page_id", "url", "html", "digest", "refers_to", F.coalesce("named", F.lit(False)).alias("named"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Pages (page_id, url, html, any more columns) as bundle files in a new ``folder`` that the cluster shares.

    A null html is an empty payload, a null url an empty one. A null page_id is always a response; rows repeated with
    one page_id are all responses or revisits like their payload's others, each with a record id of its own. An empty
    table gives no bundle. A payload is held in memory by one task at a time, however long. A revisit names the record
    of its response (WARC-Refers-To); where that page has further rows with this payload, that of the
    last url; rows that are equal in all three may share it.
    """
    bundles = referred(pages).mapInArrow(_write, "bundle binary").select(F.col("bundle").cast("string"))
    end = END.decode("latin-1")
    bundles.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", end).text(folder)


ROWS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, refers_to_record string, frame int, offset int, file string, block binary"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in ROWS.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            bundle, path = content.as_py(), path.as_py()
            for number, (at, packed, plain) in enumerate(read_seek_table(bundle)):
                data, offset, out = expand.decompress(bundle[at : at + packed], max_output_size=plain), 0, []
                while offset < len(data):
                    headers, block, after = parse(data, offset)
                    out.append((*_facts(headers, block), number, offset, path, block))
                    offset = after
                columns = zip(zip(*out, strict=True), [*kinds, pa.string(), pa.binary()], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in columns], names)


def _facts(headers: dict[str, str], block: bytes) -> tuple:
    """What a record says; size and digest of a response are those of the block that was read, a revisit has no size."""
    page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page")
    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size, digest = len(block), hashlib.sha1(block).hexdigest()
    if headers["WARC-Type"] == "revisit":
        size, digest = None, stated
    elif digest != stated:
        raise ValueError(f"record {headers['WARC-Record-ID']} does not match its digest")
    return (
        int(page) if page else None,
        headers["WARC-Target-URI"],
        size,
        digest,
        headers["WARC-Type"],
        int(refers) if refers else None,
        headers["WARC-Record-ID"],
        headers.get("WARC-Refers-To"),
    )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the bundles in ``folder``, and where it stands: file, frame and offset in the frame.

    ``block`` is the payload of a response and empty for a revisit, which has no payload_bytes and the digest that it
    states; ``resolved`` finds its response. A response that does not match its digest is an error.
    """
    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    return files.select("path", "content").mapInArrow(_read, ROWS)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` without their blocks; a revisit's payload is that of the response it names, by record id.

    payload_bytes and payload_digest of a revisit are those that were read and computed there; they are null where no
    response has the id, or has it with another digest than the revisit states. Responses that many records revisit are
    dealt over several tasks.
    """
    facts = cut(records.drop("block"), "records")
    revisits = facts.where("record_type = 'revisit'").withColumnsRenamed({"payload_digest": "stated"}).drop("payload_bytes")
    asked = revisits.groupBy("refers_to_record").agg(F.count("*").alias("n"))
    found = facts.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), "payload_bytes", "payload_digest")
    found = found.dropDuplicates(["refers_to_record"]).join(asked, "refers_to_record")
    joined = join_hot(revisits, cut(found, "revisited"), ["refers_to_record"], how="left")
    same = F.col("payload_digest") == F.col("stated")
    joined = joined.withColumns({"payload_bytes": F.when(same, F.col("payload_bytes")), "payload_digest": F.when(same, F.col("payload_digest"))})
    return facts.where("record_type = 'response'").unionByName(joined.select(facts.columns))


def fetch(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle, decompressing its frame alone."""
    at, packed, plain = read_seek_table(bundle)[frame]
    data = zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)
    return parse(data, offset)[:2]


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/graphloom-warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return resolved(read_archives(spark, folder)).select(columns)


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages
), d AS (
  SELECT page_id, octet_length(raw) AS payload_bytes, sha1(raw) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> last THEN last END AS refers_to
FROM m
"""
