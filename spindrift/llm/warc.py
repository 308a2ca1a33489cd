"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at the
end of each bundle holds the seek table of the public seekable format (compressed
and decompressed size of every frame), and an index table maps each record to its
bundle, frame and offset within the decompressed frame.

Of records with equal payloads of at least ``least`` bytes, that with the smallest
id becomes a response and the others revisit it.  Null payloads are empty, null
URLs are written as ``urn:unknown``; rows that repeat an id become records each
(copies of the smallest id are all responses).  Extra columns are ignored.  An
empty table makes an empty index.

Bundle names carry the task attempt, and only committed attempts enter the index,
so a lost executor leaves at most an unnamed file behind.
"""

from __future__ import annotations

import hashlib
import io
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import materialise, place, qualified, small_side

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
LEAST = 100
HEAD_END = b"\r\n\r\n"
INDEX = "page_id bigint, record_type string, refers_to bigint, bundle string, frame int, offset int, length int"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head (with the payload's size) alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127)))) if url else 'urn:unknown'}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + HEAD_END + block + HEAD_END


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record at that offset, and where the next begins."""
    end = data.index(HEAD_END, at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    if data[stop : stop + 4] != HEAD_END:
        raise ValueError(f"record at {at} isn't closed")
    return head, data[start:stop], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle."""
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """Reads frames of a bundle through its seek table."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * count)
        table = file.read(8 * count)
        self.starts, at = [], 0
        for compressed, whole in struct.iter_unpack("<II", table):
            self.starts.append((at, compressed, whole))
            at += compressed

    def frame(self, i: int) -> bytes:
        at, compressed, whole = self.starts[i]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(compressed), max_output_size=whole)


def decided(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to of every row."""
    rows = pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_ones = rows.where(F.octet_length("payload") >= least)
    firsts = long_ones.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    firsts = materialise(firsts, "firsts")
    out = rows.join(small_side(firsts, firsts.count()), "digest", "left")
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, path: str, ident: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """Writes the bundles and the table index under path; returns the index."""
    spark = pages.sparkSession
    path = qualified(spark, path)

    def run(batches):
        store, root = place(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        out, frames, pending, rows, made = None, [], io.BytesIO(), [], 0
        name = None

        def flush():
            data = pending.getvalue()
            if data:
                packed = packer.compress(data)
                out.write(packed)
                frames.append((len(packed), len(data)))
                pending.seek(0)
                pending.truncate()

        def close():
            flush()
            out.write(seek_table(frames))
            out.close()
            frames.clear()

        def index():
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page_id, link, text, digest, refers_to = row
                if out is None:
                    name = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}-{made}.warc.zst"
                    out, made = store.open_output_stream(f"{root}/{name}", compression=None), made + 1
                data = record(page_id, link, text.encode(), digest, refers_to)
                rows.append((page_id, "response" if refers_to is None else "revisit", refers_to, name, len(frames), pending.tell(), len(data)))
                pending.write(data)
                if pending.tell() >= frame_bytes:
                    flush()
                    if sum(c for c, _ in frames) >= BUNDLE_BYTES:
                        close()
                        out = None
            if rows:
                yield index()
                rows.clear()
        if out is not None:
            close()

    decided(pages, ident, url, payload, least).mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def fetch(index: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """Reads the records that the index rows name, each by its frame and offset.

    payload_digest is that of the bytes read for a response (a difference from its
    header is an error) and the header's for a revisit.
    """
    spark = index.sparkSession
    path = qualified(spark, path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        store, root = place(path)
        opened: tuple = (None, None)
        frame_at, data = None, b""
        for batch in batches:
            rows = []
            for bundle, frame, offset in zip(*(c.to_pylist() for c in batch.columns)):
                if opened[0] != bundle:
                    info = store.get_file_info(f"{root}/{bundle}")
                    opened, frame_at = (bundle, Bundle(store.open_input_file(info.path), info.size)), None
                if frame_at != frame:
                    frame_at, data = frame, opened[1].frame(frame)
                head, block, _ = parse(data, offset)
                http, _, payload = block.partition(HEAD_END)
                size = int(http.rpartition(b"Content-Length: ")[2])
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                kind = head["WARC-Type"]
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{head['WARC-Record-ID']} is damaged")
                number = lambda s: None if s in (None, "None") else int(s)
                refers = head.get("WARC-Refers-To")
                rows.append((number(head["WARC-Record-ID"][10:-1]), size, digest, kind, number(refers and refers[10:-1]), head["WARC-Target-URI"], payload if payloads and kind == "response" else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=[f.split()[0] for f in READ.split(", ")])

    wanted = index.select("bundle", "frame", "offset").repartition(parts, "bundle", F.floor(F.col("frame") / 8)).sortWithinPartitions("bundle", "frame", "offset")
    out = wanted.mapInArrow(run, READ)
    return out if payloads else out.drop("payload")


def verify_index(spark: SparkSession, path: str) -> int:
    """Counts the records by reading every bundle front to back; the index must hold as many."""
    path = qualified(spark, path)
    names = spark.read.parquet(f"{path}/index").select("bundle").distinct()

    def run(batches):
        store, root = place(path)
        for batch in batches:
            counts = []
            for bundle in batch.column(0).to_pylist():
                info = store.get_file_info(f"{root}/{bundle}")
                b = Bundle(store.open_input_file(info.path), info.size)
                n = 0
                for i in range(len(b.starts)):
                    data, at = b.frame(i), 0
                    while at < len(data):
                        _, _, at = parse(data, at)
                        n += 1
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n"])

    return names.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
