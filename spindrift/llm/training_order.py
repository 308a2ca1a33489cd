"""Training-order materialisation of token sequences.

Texts are tokenised, joined (each ends with the end token) and cut into sequences of
``length`` tokens task by task; a task's last sequence may be shorter.  Sequences are
numbered 0 to n - 1, and a keyed Feistel network over the next power of four, walked
along its cycles until it falls below n, gives each number its slot: a bijection
that any reader can compute.  Shards hold ``per_shard`` slots each in order, every
slot taking the same number of bytes (a count, then the ids, padded with zeros), so
slot s stands at byte (s % per_shard) * stride of shard s // per_shard and a reader
can resume anywhere.  A shard is a range of slots and the only one of its task.  Unless
given, per_shard makes as many shards as shuffle partitions, within ``LEAST_SHARD`` and ``MOST_SHARD`` slots each.

Null text is empty and has the end token alone.  Rows that repeat are written each;
extra columns are ignored; an empty table writes an empty index.  Ids are written as 16
bits, and a tokenizer that has larger ones is refused.  Shards are written
under a name of the attempt and then renamed, so an attempt that is lost or run
twice leaves the same whole shards.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import map_texts, materialise, place, qualified
from spindrift.llm.texthash import mix
from spindrift.llm.tokens import WordTokenizer

LENGTH = 2048
LEAST_SHARD, MOST_SHARD = 256, 32_768
KEY = 0x5EED
ROUNDS = 4
U = np.uint64


def permuted(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each index below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = U((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key))

    def once(x):
        left, right = x >> U(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << U(half)) | right

    out = once(index.astype(U))
    while (walks := out >= U(n)).any():
        out[walks] = once(out[walks])
    return out.astype(np.int64)


SPANS = "array<struct<doc_id: bigint, start: bigint, length: bigint, offset: bigint>>"
SPAN_KIND = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "offset")]))
CUT = f"part int, local bigint, used int, ids binary, spans {SPANS}"


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, ident: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """The sequences, written as a table: part and local number, tokens used, ids (little-endian 16-bit), the documents' spans."""

    def run(batches):
        words, part = WordTokenizer(tokenizer, end), TaskContext.get().partitionId()
        if max(len(words.last) - 1, end) > 0xFFFF:
            raise ValueError("ids beyond 16 bits don't fit the shards")
        rows, local = [], 0
        ids, spans, used = [], [], 0
        names = [f.split()[0] for f in "part int,local bigint,used int,ids binary,spans x".split(",")]

        def close():
            nonlocal local, ids, spans, used
            rows.append((part, local, used, np.concatenate(ids).astype("<u2").tobytes(), spans))
            local, ids, spans, used = local + 1, [], [], 0

        def table():
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), SPAN_KIND)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for doc, held in words.encode_rows(batch):
                at = 0
                while at < len(held):
                    n = min(length - used, len(held) - at)
                    ids.append(held[at : at + n])
                    spans.append({"doc_id": doc, "start": at, "length": n, "offset": used})
                    at, used = at + n, used + n
                    if used == length:
                        close()
                if len(rows) >= 250:
                    yield table()
        if used:
            close()
        if rows:
            yield table()

    given = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(map_texts(given, run, CUT), "sequences")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write(docs: DataFrame, path: str, tokenizer: str, length: int = LENGTH, per_shard: int | None = None, key: int = KEY, ident: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """Writes shards, layout.json and the table index (slot, used, spans) under path; returns the index."""
    spark, path = docs.sparkSession, qualified(docs.sparkSession, path)
    cut = sequences(docs, tokenizer, length, ident, text, end)
    sizes = {r["part"]: r["n"] for r in cut.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a task
    bases, n = {}, 0
    for part in sorted(sizes):
        bases[part], n = n, n + sizes[part]
    stride = 4 + 2 * length
    per_shard = per_shard or max(LEAST_SHARD, min(MOST_SHARD, n // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    store, root = place(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/layout.json", compression=None) as f:
        f.write(json.dumps({"sequences": n, "length": length, "per_shard": per_shard, "stride": stride, "key": key, "rounds": ROUNDS}).encode())

    def give(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            part, local = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            base = np.array([bases[p] for p in part.tolist()], np.int64)
            slot = permuted(base + local, n, key) if len(local) else local
            packed = pa.array([packer.compress(b) for b in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard, pa.int32()), pa.array(slot, pa.int64()), batch.column(2), packed, batch.column(4)], names=["shard", "slot", "used", "ids", "spans"])

    def save(batches):
        store, root = place(path)
        opener, now, out, name = zstandard.ZstdDecompressor(), None, None, None

        def close():
            if out is not None:
                out.close()
                store.move(name, f"{root}/{shard_name(now)}")

        for batch in batches:
            shards, slots, used = (batch.column(i).to_pylist() for i in range(3))
            for shard, blob, count in zip(shards, batch.column(3), used):
                if shard != now:
                    close()
                    now, name = shard, f"{root}/{shard_name(shard)}.{TaskContext.get().taskAttemptId()}"
                    out = store.open_output_stream(name, compression=None)
                ids = opener.decompress(blob.as_py(), max_output_size=2 * length)
                out.write(count.to_bytes(4, "little") + ids + bytes(2 * length - len(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(4)], names=["slot", "used", "spans"])
        close()

    slots = cut.mapInArrow(give, f"shard int, slot bigint, used int, ids binary, spans {SPANS}")
    slots = slots.repartitionById(max(1, -(-n // per_shard)), "shard").sortWithinPartitions("slot")
    slots.mapInArrow(save, f"slot bigint, used int, spans {SPANS}").write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def layout(path: str) -> dict:
    store, root = place(path)
    with store.open_input_stream(f"{root}/layout.json", compression=None) as f:
        return json.loads(f.read())


def read_slots(path: str, first: int = 0, last: int | None = None):
    """(slot, ids) in training order from any slot on: one seek, then a sequential read."""
    store, root = place(path)
    shape = layout(path)
    last = shape["sequences"] if last is None else min(last, shape["sequences"])
    slot = first
    while slot < last:
        shard, at = divmod(slot, shape["per_shard"])
        with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(at * shape["stride"])
            while slot < last and slot // shape["per_shard"] == shard:
                row = f.read(shape["stride"])
                used = int.from_bytes(row[:4], "little")
                yield slot, np.frombuffer(row[4 : 4 + 2 * used], "<u2")
                slot += 1


READ = "doc_id bigint, start bigint, length bigint, slot bigint, offset bigint, ids_crc32 bigint"


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Each document's spans with the checksum (of little-endian 32-bit ids) of what stands in the shards."""
    path = qualified(spark, path)
    shape = layout(path)
    stride, per_shard = shape["stride"], shape["per_shard"]
    index = spark.read.parquet(f"{path}/index")
    parts = max(1, -(-shape["sequences"] // per_shard))
    wanted = index.select("slot", "used", "spans").repartitionById(parts, F.floor(F.col("slot") / per_shard).cast("int")).sortWithinPartitions("slot")

    def run(batches):
        store, root = place(path)
        now, file = None, None
        for batch in batches:
            rows = []
            for slot, used, spans in zip(*(c.to_pylist() for c in batch.columns)):
                shard, at = divmod(slot, per_shard)
                if shard != now:
                    now, file = shard, store.open_input_file(f"{root}/{shard_name(shard)}")
                file.seek(at * stride)
                row = file.read(stride)
                if int.from_bytes(row[:4], "little") != used:
                    raise ValueError(f"slot {slot} is damaged")
                ids = np.frombuffer(row[4:], "<u2")
                for s in spans:
                    held = ids[s["offset"] : s["offset"] + s["length"]]
                    rows.append((s["doc_id"], s["start"], s["length"], slot, s["offset"], zlib.crc32(held.astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 6)], names=[f.split()[0] for f in READ.split(", ")])

    return wanted.mapInArrow(run, READ)
