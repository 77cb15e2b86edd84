"""Mixing sources to target weights by Sainte-Laguë apportionment.

Seats are words. They go to sources by the highest quotients ``target / (2 k + 1)``, and
inside a source to its shards by the highest quotients of their sizes, so every source
and shard has its quota to the word, however small it is. A shard lines up its documents
in a seeded order and takes its quota from that line in runs of about a block, with a
seeded start and even steps; above the line's length all of it is taken once and the
runs are those taken again. All but the quotas, which are a few numbers a shard, stays in
DataFrame expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import WORD
from hazeline.session import shared_dir


def capped_shares(total: float, weights: Sequence[float], caps: Sequence[float]) -> np.ndarray:
    """Share ``total`` by weight; a share stops at its cap and what is above it is shared
    again by weight among the others, until none is above or all are at their caps."""
    weights, caps = np.asarray(weights, float), np.asarray(caps, float)
    share, open_ = np.zeros(len(weights)), np.ones(len(weights), bool)
    left = float(total)
    while open_.any() and left > 0:
        per = left / weights[open_].sum()
        over = open_ & (weights * per >= caps)
        if not over.any():
            share[open_] = weights[open_] * per
            break
        share[over] = caps[over]
        left -= caps[over].sum()
        open_ &= ~over
    return share


def sainte_lague(seats: int, votes: Sequence[float], caps: Sequence[int] | None = None) -> np.ndarray:
    """Seats by the highest quotients ``vote / (2 k + 1)``, ties to the earlier entry, no
    entry above its cap. The divisor is found by halving, so the cost does not grow with
    the number of seats; if caps or zero votes leave seats over, they stay free."""
    votes = np.asarray(votes, float)
    caps = np.where(votes > 0, np.inf if caps is None else np.asarray(caps, float), 0)
    if seats <= 0 or not (votes > 0).any():
        return np.zeros(len(votes), np.int64)
    # Seat k (from 0) has the quotient v / (2k + 1): with quotients of at least q an
    # entry has floor((v / q + 1) / 2) seats.
    at_least = lambda q: np.minimum(np.floor((votes / q + 1) / 2), caps)
    if caps.sum() <= seats:
        return caps.astype(np.int64)
    high, low = votes.max() * 2, votes[votes > 0].min() / (2 * seats + 2)
    for _ in range(200):
        mid = (high * low) ** 0.5
        if not low < mid < high:
            break
        if at_least(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    given = at_least(high)
    rest = seats - int(given.sum())
    if rest > 0:
        room = np.flatnonzero(given < caps)
        quotient = votes[room] / (2 * given[room] + 1)
        given[room[np.lexsort((room, -quotient))[:rest]]] += 1
    return given.astype(np.int64)


def source_targets(sizes: Sequence[int], share: float, weights: Sequence[float], most: float) -> np.ndarray:
    """Targets of sources in their order: weights repeat along it."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    return capped_shares(share * sum(sizes), w, [most * s for s in sizes])


def block_length(total: int) -> int:
    """Words of a run, longer for more words in all."""
    return int(min(4096, max(16, total // 1_000_000)))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[float] = (3, 1, 2),
    most: int = 2,
    shards: int = 1024,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``key, size, source_size, target, taken`` of every document: how many of its words
    the mix takes, repeats counted, so that all sources together have ``share`` times all
    words. Sources are ordered by code point, null last, and have ``weights`` in turn;
    targets stop at ``most`` times a source's size, and no document is taken more often.

    Rows with null text or no word take nothing; rows with the same key are taken one by
    one; other columns do not matter; an empty table gives no rows. The number of sources
    and of shards (about ``shards`` in all) bounds what the driver sees. A large source
    has many shards of even size, whatever its share of the rows."""
    taken = taken_words(sized(docs, key, text, source), share, weights, most, shards, seed)
    return taken.select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def taken_words(rows: DataFrame, share: float, weights: Sequence[float], most: int, shards: int, seed: int) -> DataFrame:
    """``mix`` of sized rows, with the ``source_no`` and ``shard`` of each."""
    spark = rows.sparkSession
    shared_dir(spark)
    rows = rows.checkpoint()
    known = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    known = sorted(known, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["n"] for r in known]
    total = sum(sizes)
    targets = source_targets(sizes, share, weights, most)
    block = block_length(total)
    per_shard = max(total // shards, 256 * block, 1)
    n_shards = [max(1, -(-n // per_shard)) for n in sizes]
    sources = F.broadcast(  # one row a source
        spark.createDataFrame(
            [(r["source"], k, n, float(t), m) for k, (r, n, t, m) in enumerate(zip(known, sizes, targets, n_shards))],
            "source string, source_no int, source_size long, target double, n_shards long",
        )
    )
    dealt = (
        rows.join(sources, rows["source"].eqNullSafe(sources["source"]))
        .drop("source")
        .withColumn("shard", F.pmod(F.xxhash64("key", F.lit(seed)), "n_shards"))
    )
    found = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("n")).collect()
    shard_sizes: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(found, key=lambda r: (r["source_no"], r["shard"])):
        shard_sizes.setdefault(r["source_no"], []).append((r["shard"], r["n"]))
    words = sainte_lague(round(float(targets.sum())), targets, [most * n for n in sizes])
    quotas = []
    for no, parts in shard_sizes.items():
        lengths = [n for _, n in parts]
        got = sainte_lague(int(words[no]), lengths, [most * n for n in lengths])
        for (s, n), q in zip(parts, got.tolist()):
            times, more = divmod(q, n) if n else (0, 0)
            quotas.append((no, s, n, times, more, -(-block * n // more) if more else max(n, 1)))
    quota = F.broadcast(  # one row a shard, see shards
        spark.createDataFrame(quotas, "source_no int, shard long, length long, times long, more long, step long")
    )
    line = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64("key", F.lit(seed + 1)), "key", "size")
    end = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    phase = F.pmod(F.xxhash64("source_no", "shard", F.lit(seed + 2)), "step")

    def words_upto(x):
        """Words taken among the first ``x`` of a shard: the line is cut in steps from a
        seeded place on, and each step gives the run at its head."""
        cut = f"(phase + step * floor(({x} - phase) / step))"
        low, high = f"greatest({cut}, 0)", f"least({cut} + step, length)"
        # Products of two lengths need more than 64 bits.
        wide = lambda y: f"cast({y} as decimal(19, 0))"
        due = lambda y: f"({wide(y)} * {wide('more')} div {wide('greatest(length, 1)')})"
        return F.expr(f"{x} * times + {due(low)} + least({x} - {low}, {due(high)} - {due(low)})")

    return (
        dealt.join(quota, ["source_no", "shard"])
        .withColumns({"end": end, "phase": phase})
        .withColumn("begin", F.col("end") - F.col("size"))
        .select(
            "key",
            "source_no",
            "shard",
            "size",
            "source_size",
            "target",
            (words_upto("end") - words_upto("begin")).cast("long").alias("taken"),
        )
    )


def whole_documents(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[float] = (3, 1, 2),
    most: int = 2,
    shards: int = 1024,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``key, size, source_size, target, times`` of every document: how often the mix has
    it if documents stay whole. The whole part of ``taken / size`` counts in full. The
    fractions are added up along the line of a source, from a seeded start; a document at
    which the sum passes a whole number stands once more. The line goes by size class
    (four to each doubling), in a class by shard, in a shard by size: as neighbours have
    like sizes, the words kept follow the words taken. Fractions are whole numbers of
    2^-30, so sums do not depend on their order."""
    rows = taken_words(sized(docs, key, text, source), share, weights, most, shards, seed).checkpoint()
    unit = 1 << 30
    part = F.when(F.col("size") > 0, F.round((F.col("taken") % F.col("size")) * F.lit(unit) / F.col("size"))).otherwise(0)
    step = F.floor(F.log2(F.greatest("size", F.lit(1))) * 4).cast("int")
    rows = rows.withColumns({"part": part.cast("long"), "step": step})
    before = Window.partitionBy("source_no").orderBy("step", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # one row a shard and size class
        rows.groupBy("source_no", "step", "shard")
        .agg(F.pmod(F.sum("part"), F.lit(unit)).alias("parts"))  # whole numbers make no difference
        .withColumn("start", F.coalesce(F.sum("parts").over(before), F.lit(0)) + F.pmod(F.xxhash64("source_no", F.lit(seed + 3)), F.lit(unit)))
        .select("source_no", "step", "shard", "start")
    )
    line = Window.partitionBy("source_no", "step", "shard").orderBy("size", F.xxhash64("key", F.lit(seed + 4)), "key", "part")
    end = F.col("start") + F.sum("part").over(line.rowsBetween(Window.unboundedPreceding, 0))
    passed = F.shiftright("end", 30) - F.shiftright(F.col("end") - F.col("part"), 30)
    return (
        rows.join(F.broadcast(starts), ["source_no", "step", "shard"])
        .withColumn("end", end)
        .withColumn("whole", F.when(F.col("size") > 0, F.floor((F.col("taken") - F.col("taken") % F.col("size")) / F.col("size"))).otherwise(0))
        .select(F.col("key").alias(key), "size", "source_size", "target", (F.col("whole") + passed).cast("int").alias("times"))
    )
