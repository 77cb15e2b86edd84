"""Helpers that several operators share: Arrow batches, word lists, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.session import scratch_path, shared_dir

#: A word, as all word-based operators here understand it.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str) -> list[bytes]:
    """The words of a text as UTF-8; bytes part at just the white space of ``WORD``."""
    return text.encode("utf-8", "surrogatepass").split()


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow types of a flat DDL string such as ``doc_id long, text string``."""
    return pa.schema([(n, _ARROW[t]) for n, t in (f.split(None, 1) for f in ddl.split(", "))])


def give_back() -> None:
    """Return memory that a task has freed to the system: workers live on from task to
    task and from stage to stage, and an allocator keeps what the largest of them took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not with this C library


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind, from_pandas=False)


def map_batches(
    df: DataFrame, ddl: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]]
) -> DataFrame:
    """``mapInArrow`` with dictionaries of columns as results. ``fn`` sees a whole
    partition as an iterator of batches and yields one dictionary per result batch."""

    def run(batches):
        schema = arrow_schema(ddl)
        for out in fn(batches):
            columns = [as_array(out[f.name], f.type) for f in schema]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        give_back()

    return df.mapInArrow(run, ddl)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def columns(batch: pa.RecordBatch) -> list[list]:
    return [batch.column(i).to_pylist() for i in range(batch.num_columns)]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that scatters them (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` words at a time."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes, in order (fewer than ``n``: none)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    out = words[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += words[k : k + m]
    return mix64(out)


def _cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and go on from there: like a
    checkpoint, but compressed. The folder can go once the result has been used."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Smallest member of the component of every node of ``edges (a long, b long)``.

    Alternates two steps until every node points at one that points nowhere. In the first every node points all its
    larger neighbours to its smallest one, in the second all its smaller ones; edges
    only ever lose stars, so the number of rows does not grow. Each round is one
    shuffle or two and ends in a checkpoint. A node with many neighbours is reduced by
    map-side minima and joined, never gathered. Returns ``node, component``; empty
    edges give no rows, loops and repeated edges are harmless."""
    pairs = _cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        large = _cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("e")
        )
        pairs = _cut(small.select("e.a", "e.b").where("a <> b").distinct())
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("root"))
        roles = ends.unionByName(pairs.select(F.col("b").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("root")))
        roles = roles.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("root").alias("root"))
        if roles.where("ups > 1 OR ups = 1 AND root = 1").isEmpty():
            break
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.unionByName(roots)
