"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors are scaled to length 1 and turned by one seeded random rotation. A vector's code
is the sign of each turned coordinate; beside it stands the correction factor, the inner
product ``f`` of the vector with its own code (of length 1). The inner product of a code
with another vector, over ``f``, is an unbiased estimate of the inner product of both
vectors, and its error stays below ``eps * sqrt((1 - f^2) / (f^2 (d - 1)))`` but for a
share of cases that falls as ``exp(-eps^2 / 2)``. The other vector enters as four bits a
coordinate, so a pair costs four counts of common bits. Pairs whose bound reaches the
threshold are computed again in double precision; only those can link."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import arrow_schema, components
from hazeline.session import shared_dir

BITS = 4


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    n, d = bits.shape
    wide = np.zeros((n, -(-d // 64) * 64), np.uint8)
    wide[:, :d] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """Codes, correction factors and four-bit forms of unit vectors."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray, seed: int):
        turned = unit @ turn
        n, d = turned.shape
        self.d = d
        self.code = packed(turned > 0)
        self.factor = np.abs(turned).sum(1) / np.sqrt(d)
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2**BITS - 1), 1e-12)
        dither = np.random.default_rng(seed).random((n, d))
        level = np.floor((turned - self.low[:, None]) / self.step[:, None] + dither)
        level = np.clip(level, 0, 2**BITS - 1).astype(np.uint8)
        self.slices = [packed((level >> b) & 1) for b in range(BITS)]
        self.total = level.sum(1, dtype=np.int64)
        self.ones = np.bitwise_count(self.code).sum(1).astype(np.int64)

    def candidates(self, other: Codes, threshold: float, eps: float, upper: bool):
        """Pairs (row here, row there) whose upper bound reaches the threshold."""
        d = self.d
        root = np.sqrt(d)
        g = np.sqrt(np.maximum(1 - other.factor**2, 0) / max(d - 1, 1))
        for i in range(len(self.code)):
            first = i + 1 if upper else 0
            if first >= len(other.code):
                break
            code = other.code[first:]
            common = np.zeros(len(code), np.int64)
            for b in range(BITS):
                common += np.bitwise_count(code & self.slices[b][i]).sum(1, dtype=np.int64) << b
            # Inner product of the code (+-1 / sqrt d) with the four-bit vector.
            ones = other.ones[first:]
            inner = (self.step[i] * (2 * common - self.total[i]) + self.low[i] * (2 * ones - d)) / root
            slack = eps * (g[first:] + self.step[i] / root / 2)
            hit = np.flatnonzero(inner + slack >= threshold * other.factor[first:])
            if len(hit):
                yield i, hit + first


def linked(a: np.ndarray, b: np.ndarray | None, threshold: float, eps: float, seed: int):
    """Index pairs with a cosine of at least ``threshold`` between rows of ``a`` and of
    ``b``, or among rows of ``a``; vectors come as doubles."""
    turn = rotation(a.shape[1], seed)
    norms_a = np.sqrt((a * a).sum(1))
    left = Codes(a / norms_a[:, None], turn, seed + 1)
    if b is None:
        right, there, norms_b = left, a, norms_a
    else:
        there, norms_b = b, np.sqrt((b * b).sum(1))
        right = Codes(b / norms_b[:, None], turn, seed + 2)
    for i, js in left.candidates(right, threshold, eps, b is None):
        cosine = (there[js] @ a[i]) / (norms_b[js] * norms_a[i])
        js = js[cosine >= threshold]
        if len(js):
            yield i, js


def usable(vector: str) -> F.Column:
    """Not null, of finite numbers, not all zero."""
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(x, lambda v: v != 0)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    block: int = 2048,
    eps: float = 7.0,
    seed: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row of ``vectors``.

    Only vectors of the same not-null label and the same length are compared. Equal
    vectors form a class, compared once by its smallest key. The classes of a label are
    dealt into blocks of about ``block``, and each pair of blocks is one group, so a hot
    label is many groups of bounded size; every pair of classes is met in one of them.
    A group reports how many vectors each class links to, and for components one edge a
    class, never its pairs. Unusable vectors (null, zero, null or non-finite numbers,
    null label) link with nothing. Keys must be unique and not null; other columns do not
    matter; an empty table gives no rows."""
    spark = vectors.sparkSession
    shared_dir(spark)
    good = F.coalesce(usable(vector) & F.col(label).isNotNull(), F.lit(False))
    written = F.sha2(F.concat_ws(",", F.col(vector).cast("array<string>")), 256)
    rows = vectors.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
        F.when(good, written).otherwise(F.concat(F.lit("none "), F.col(key))).alias("same"),
    )
    members = rows.where("same NOT LIKE 'none %'").select("key", "label", "same", "v")
    classes = members.groupBy("label", "same").agg(
        F.min("key").alias("rep"), F.count("*").alias("n"), F.min_by("v", "key").alias("v")
    )
    classes = classes.withColumn("dim", F.size("v")).checkpoint()
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("at", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    groups = dealt.select("*", every.alias("other")).select(
        "label", "dim", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "rep", "n", "v"
    )
    ddl = "rep long, links long, root long"

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        at, rep, n = (table[c].to_numpy() for c in ("at", "rep", "n"))
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        first = np.flatnonzero(at == i)
        second = None if i == j else np.flatnonzero(at == j)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        there = first if second is None else second
        for k, hits in linked(v[first], None if second is None else v[second], threshold, eps, seed):
            a, b = first[k], there[hits]
            links[a] += n[b].sum()
            links[b] += n[a]
            # Join what the pairs so far have in common; only the roots are kept.
            low = min(root[a], root[b].min())
            for r in np.unique(np.append(root[b], root[a])):
                if r != low:
                    root[root == r] = low
        hit = links > 0
        out = {"rep": rep[hit], "links": links[hit], "root": rep[root[hit]]}
        schema = arrow_schema(ddl)
        return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    found = groups.groupBy("label", "dim", "i", "j").applyInArrow(compare, ddl).checkpoint()
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    comp = comp.groupBy("node").agg(F.min("component").alias("component"))
    per_class = (
        classes.select("label", "same", "rep", "n")
        .join(links, "rep", "left")
        .join(comp, F.col("rep") == F.col("node"), "left")
        .select(
            "label",
            "same",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    return (
        rows.select("key", "label", "same")
        .join(per_class, ["label", "same"], "left")
        .select(
            F.col("key").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "key").alias("component_id"),
            (F.coalesce("component", "key") == F.col("key")).alias("kept"),
        )
    )
