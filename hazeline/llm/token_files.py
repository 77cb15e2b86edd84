"""Token ids in binary segments with Elias-Fano document boundaries.

A dataset is a folder of Parquet files, written by Spark's own committer, so a lost
executor or a repeated task leaves nothing behind. Each row is one segment: the ids of
consecutive documents in one array of 16- or 32-bit little-endian numbers, the places
where documents end, and the documents' own ids, both as Elias-Fano sequences. Segments
are ordered by ``part`` and ``segment``, documents ascend within and across them."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.batch_encoder import batch_encoder
from hazeline.llm.common import arrow_schema

SEGMENT = (
    "part int, segment int, offset long, n_docs long, n_ids long, width int, first_doc long, "
    "doc_ids binary, bounds binary, ids binary"
)
EVERY = 256  # a select sample for so many numbers


@dataclass
class EliasFano:
    """A non-decreasing sequence of numbers from 0 on: the low bits packed one after the
    other, the high parts in unary, and the place of every 256th number in them, from
    which ``select`` starts. About 2 + log2(largest / length) bits a number."""

    n: int
    low_bits: int
    low: np.ndarray  # bytes
    high: np.ndarray  # bytes
    samples: np.ndarray  # uint32

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        most = int(v[-1]) if n else 0
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return EliasFano(n, low_bits, low, np.packbits(bits, bitorder="little"), at[::EVERY].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8")
        return b"".join(x.tobytes() for x in (head, self.low, self.high, self.samples.astype("<u4")))

    @staticmethod
    def from_bytes(data: bytes) -> EliasFano:
        n, low_bits, a, b = np.frombuffer(data, "<u8", 4).tolist()
        low = np.frombuffer(data, np.uint8, a, 32)
        high = np.frombuffer(data, np.uint8, b, 32 + a)
        return EliasFano(n, low_bits, low, high, np.frombuffer(data, "<u4", -1, 32 + a + b))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return bits.reshape(-1, self.low_bits).astype(np.uint64) @ weights

    def select(self, first: int, last: int | None = None) -> np.ndarray:
        """The numbers from ``first`` to before ``last`` (one, if not given), unpacking
        the high bits from the sample before on only."""
        last = first + 1 if last is None else last
        if first >= last:
            return np.empty(0, np.int64)
        k = first // EVERY
        begin = int(self.samples[k])
        stop = (last - 1) // EVERY + 1
        end = int(self.samples[stop]) + 1 if stop < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[begin // 8 : (end + 7) // 8], bitorder="little")
        ones = np.flatnonzero(bits[begin % 8 :])[first - k * EVERY : last - k * EVERY] + begin
        high = (ones - np.arange(first, last)).astype(np.uint64)
        return ((high << np.uint64(self.low_bits)) | self._low(first, last)).astype(np.int64)

    def all(self) -> np.ndarray:
        return self.select(0, self.n)


def segments(
    docs: DataFrame, path: str, end_id: int, segment_ids: int = 1 << 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode documents and lay them out as segments of about ``segment_ids`` ids, in
    ascending ``key`` order; a longer document has a segment of its own. One shuffle, by
    ranges of the key. ``end_id`` closes each document, a null text counts as empty, rows
    without a key are left out, rows with the same key stay side by side by text. Other
    columns do not matter; an empty table gives no segment."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        docs.where(F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange(n, "key")
        .sortWithinPartitions("key", "text")
    )

    def run(batches):
        encode = batch_encoder(path)
        wide = max(max(encode.tok.label), end_id) >= 1 << 16
        part, k = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # keys, sizes, ids
        total = offset = 0

        def close():
            keys, sizes, ids = (np.concatenate(c) for c in zip(*held))
            values = {
                "part": part, "segment": k, "offset": offset, "n_docs": len(keys), "n_ids": len(ids), "width": 4 if wide else 2,
                "first_doc": int(keys[0]), "doc_ids": EliasFano.of(keys - keys[0]).to_bytes(),
                "bounds": EliasFano.of(np.cumsum(sizes)).to_bytes(),
                "ids": ids.astype("<u4" if wide else "<u2").tobytes(),
            }
            schema = arrow_schema(SEGMENT)
            return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                keys = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                found, sizes = encode(some.column(1))
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                ids = np.full(int(ends[-1]), end_id, np.uint32)
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                ids[inner] = found
                s = 0
                while s < len(keys):
                    # As many documents as fit, and one at least.
                    room = segment_ids - total + (ends[s - 1] if s else 0)
                    e = max(int(np.searchsorted(ends, room, "right")), s + (not held))
                    if e > s:
                        begin = ends[s - 1] if s else 0
                        held.append((keys[s:e], sizes[s:e], ids[begin : ends[e - 1]]))
                        total, s = total + int(ends[e - 1] - begin), e
                    if s < len(keys):
                        yield close()
                        offset, total, k = offset + total, 0, k + 1
                        held.clear()
        if held:
            yield close()

    return rows.mapInArrow(run, SEGMENT)


def write(docs: DataFrame, folder: str, path: str, end_id: int, **how) -> None:
    segments(docs, path, end_id, **how).write.mode("overwrite").parquet(folder)


def placed(folder: str, spark: SparkSession) -> DataFrame:
    """Segments with the number of ids before each. A segment knows the ids before it in
    its part; one number a part, so one for each writing task, goes over the driver."""
    rows = spark.read.schema(SEGMENT).parquet(folder)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, base = 0, []
    for r in sorted(totals, key=lambda r: r["part"]):
        base.append((r["part"], before))
        before += r["n"]
    bases = F.broadcast(spark.createDataFrame(base, "part int, before long"))
    return rows.join(bases, "part").withColumn("start", F.col("before") + F.col("offset"))


def read(folder: str, spark: SparkSession, ids: bool = True) -> DataFrame:
    """Documents of a dataset: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for,
    ``ids array<long>``. Offsets come from the Elias-Fano boundaries."""
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches):
        schema = arrow_schema(ddl)
        for batch in batches:
            for row in batch.to_pylist():
                ends = EliasFano.from_bytes(row["bounds"]).all()
                starts = np.concatenate([[0], ends[:-1]])
                keys = EliasFano.from_bytes(row["doc_ids"]).all() + row["first_doc"]
                data = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                parts = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                out = [keys, row["start"] + starts, ends - starts, [zlib.crc32(p.tobytes()) for p in parts]]
                out += [[p.tolist() for p in parts]] * ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema
                )

    return placed(folder, spark).mapInArrow(run, ddl)
