"""Exact Jaccard join of word n-gram sets, as a metric-space join with pivots.

``1 - J`` is a metric on sets. Two documents link when it is at most ``r``, and two
documents whose distances from any pivot differ by more than ``r`` do not link.

The pivots of the first level are single n-grams: a document enters the regions of those
n-grams that come first in its set under one common order (rare ones before frequent
ones). A set and one it links to share such an n-gram, since ``1 - r`` of the larger must
be common, so every link lies inside a region, and boundary documents are in all regions
they could link in.

A large region is divided by one central pivot, which all of its documents meet. Those far
from it stay together in a region without those near it; on the seam they are in both. Two
of the near ones share at most what either shares with the pivot; where that is not enough for a link,
they must also share an n-gram that the pivot lacks. So each enters a region of the pivot
and such an n-gram, for those that come first among them in its set. There a document that
does not link to the pivot meets the others, as long as what they can share at most allows
a link; the few pairs for which the pivot's n-grams can be enough are looked at one by
one. Near copies of one text that lie just beyond the threshold thereby rarely make a
pair: what they share is the pivot's, less what either lacks of it. Before that, a
document without a link to the pivot meets the one nearest to the pivot that lacks the
same n-gram of it, for each that it lacks, which links most of those that have links.

Small regions then join recursively. In each, the documents with the
smallest seeded hashes are pivots; every other document that may still matter meets them,
and gets its exact distance by the whole sets. Documents linked through pivots are in one
component and need no further look at each other. Two documents of different components
stay candidates only inside the triangle window of their distances from the region's
pivot, and only if bucket counts of their sets, which shorten distances, allow a link. A
region has eight times as many pivots each round, until no region holds two components
with a pair unseen. What the rounds know of components may lag behind the links; the whole
graph of links is gone through once, at the end.

A set is of 64-bit n-gram hashes, and equal sets form one class before all else."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import columns, components, map_batches, mix64, ngram_hashes, written

HOT = 1 << 16  # n-grams that are put last in the common order, at most
PER_SALT = 256  # members that meet a pivot in one run
BUCKETS = 256  # of a sketch
LARGE = 128  # documents of a region that is not divided, at most
BALL = 80  # a pivot divides those at this distance at most, in percent
STEP = 1.02  # ratio of sizes that fall in one class of sizes
MASK = ["m0", "m1", "m2", "m3"]  # 64 bits each, for the n-grams of a pivot that a set lacks
FIRST, GROWTH = 4, 8  # pivots of a region in the first round, times as many in each after
GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])  # bytes between words
OF_BYTE = np.where(GAP, np.uint64(0), mix64(np.arange(1, 257, dtype=np.uint64)))
BLOCK = 1 << 16  # words hashed in one go


def of_place(n: int) -> np.ndarray:
    """Odd factors of the first ``n`` places of a word."""
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(1 << 20)) | np.uint64(1)


PLACES = of_place(4096)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the ASCII-lower-cased words, in order. A word's hash mixes the sum
    of a number for each byte times a factor for its place, taken for many words at once."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    word = ~GAP[raw]
    begins = word.copy()
    begins[1:] &= GAP[raw[:-1]]
    starts = np.flatnonzero(begins)
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), BLOCK):
        start = starts[k : k + BLOCK]
        stop = starts[k + BLOCK] if k + BLOCK < len(starts) else len(raw)
        span = np.diff(start, append=stop)  # a word and the gap behind it, which adds zeros
        places = PLACES if span.max() <= len(PLACES) else of_place(int(span.max()))
        first = start - start[0]
        terms = OF_BYTE[raw[start[0] : stop]] * places[np.arange(stop - start[0]) - np.repeat(first, span)]
        out[k : k + BLOCK] = mix64(np.add.reduceat(terms, first))
    return out


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of ASCII-lower-cased words; a shorter text is
    one n-gram, a text without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < n:
        return ngram_hashes(words, len(words)) ^ mix64(np.array([len(words)], np.uint64))
    grams = np.sort(ngram_hashes(words, n))
    return grams[np.append(True, grams[1:] != grams[:-1])]


def frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of the most frequent n-grams, the rarest first: those that stand out in some
    batch, added up over all. They only order the sets, any list gives right results."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 3000):
                texts = batch.column(0).slice(begin, 3000).to_pylist()
                sets = [shingles(t, n) for t in texts if t]
                if sets:
                    values, counts = np.unique(np.concatenate(sets), return_counts=True)
                    hot = counts >= max(4, len(sets) // 500)
                    yield {"gram": values[hot].view(np.int64), "n": counts[hot]}

    rows = map_batches(docs.select("text"), "gram long, n long", run)
    top = rows.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(HOT)
    found = [(r["n"], r["gram"]) for r in top.collect()]  # at most HOT
    return np.array([g for _, g in sorted(found)], np.int64).view(np.uint64)


def needed(size: int, pct: int) -> int:
    """Elements of a set of ``size`` that a linked set must share, at least."""
    return -(-size * pct // 100)


def common_order(hot: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Places of n-grams in the common order: by a hash, but frequent ones last."""
    by = np.argsort(hot)
    known = hot[by]

    def places(grams: np.ndarray) -> np.ndarray:
        order = mix64(grams) >> np.uint64(1)
        if len(known):
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            is_hot = known[at] == grams
            order[is_hot] = by[at[is_hot]].astype(np.uint64) + np.uint64(1 << 63)
        return order

    return places


def prefixes(docs: DataFrame, n: int, pct: int, hot: np.ndarray) -> DataFrame:
    """``doc, size, h1, h2, prefix`` of every document: size and digest of its set and the
    n-grams that come first in the common order. A batch gives one prefix for equal sets."""

    def run(batches):
        places = common_order(hot)
        for batch in batches:
            for begin in range(0, batch.num_rows, 3000):
                out: dict[str, list] = {k: [] for k in ("doc", "size", "h1", "h2", "prefix")}
                seen = set()
                for doc, text in zip(*columns(batch.slice(begin, 3000))):
                    grams = shingles(text or "", n)
                    digest = xxhash.xxh3_128_digest(grams.tobytes())
                    h1, h2 = np.frombuffer(digest, np.int64).tolist()
                    prefix = None
                    if len(grams) and digest not in seen:
                        seen.add(digest)
                        first = np.argsort(places(grams))[: len(grams) - needed(len(grams), pct) + 1]
                        prefix = grams[first].view(np.int64).tolist()
                    for name, v in zip(out, (doc, len(grams), h1, h2, prefix)):
                        out[name].append(v)
                yield out

    return map_batches(docs.select("doc", "text"), "doc long, size long, h1 long, h2 long, prefix array<long>", run)


def sketched(texts: DataFrame, n: int) -> DataFrame:
    """``doc, size, sketch, text``: a set's sketch counts its n-grams by hash bucket."""

    def run(batches):
        for batch in batches:
            docs, whole = columns(batch)
            sets = [shingles(t or "", n) for t in whole]
            counts = [np.bincount((g % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) for g in sets]
            sketches = [np.minimum(c, 255).astype(np.uint8).tobytes() for c in counts]
            yield {"doc": docs, "size": [len(g) for g in sets], "sketch": sketches, "text": whole}

    return map_batches(texts.select("doc", "text"), "doc long, size long, sketch binary, text string", run)


def near_enough(pairs: DataFrame, texts: DataFrame, pct: int) -> DataFrame:
    """Pairs of ``pivot, doc`` that can link by their sketches. Counting by bucket is a map
    into L1 that shortens distances: what two counts differ by, the sets differ by at
    least, and linked sets differ by at most ``(100 - pct) / (100 + pct)`` of both sizes."""
    own = texts.select("doc", F.col("size").alias("n_doc"), F.col("sketch").alias("s_doc"))
    theirs = texts.select(F.col("doc").alias("pivot"), F.col("size").alias("n_pivot"), F.col("sketch").alias("s_pivot"))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1).astype(np.int16)
                for c in (3, 5)
            )
            both = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            keep = np.abs(a - b).sum(1, dtype=np.int64) * (100 + pct) <= both * (100 - pct)
            yield {"pivot": batch.column(0).to_numpy()[keep], "doc": batch.column(1).to_numpy()[keep]}

    rows = pairs.select("pivot", "doc").join(own, "doc").join(theirs, "pivot")
    rows = rows.select("pivot", "doc", "n_doc", "s_doc", "n_pivot", "s_pivot")
    return map_batches(rows, "pivot long, doc long", run)


def distances(pairs: DataFrame, texts: DataFrame, n: int, pct: int = 0, hot: np.ndarray | None = None) -> DataFrame:
    """``pivot, doc, common, total`` of pairs: exact sizes of intersection and union. A
    pivot's set is held while its members stream past; a pivot with many members has a
    copy for every few hundred of them. With ``hot`` also ``size, rest, lacks``: the size
    of the document's set, its prefix where the pivot's n-grams come last, without those,
    and the pivot's n-grams that it lacks, if a document linked to the pivot can link to
    it. And a bit for each that it lacks, with the number of those that found theirs set."""
    names = ("pivot", "doc", "common", "total") + (("size", "rest", "lacks", "extra", *MASK) if hot is not None else ())
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    members = (
        pairs.join(salts, "pivot")
        .withColumn("salt", F.pmod(F.xxhash64("doc"), "salts").cast("int"))
        .select("pivot", "salt", "doc")
        .join(texts, "doc")
        .select("pivot", "salt", F.lit(1).alias("member"), "doc", "text")
    )
    pivots = (
        salts.join(texts, F.col("pivot") == F.col("doc"))
        .select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "doc", "text")
        .select("pivot", "salt", F.lit(0).alias("member"), "doc", "text")
    )

    def run(batches):
        held = np.empty(0, np.uint64)
        places = common_order(hot) if hot is not None else None
        for batch in batches:
            for begin in range(0, batch.num_rows, 3000):
                out: dict[str, list] = {k: [] for k in names}
                for pivot, _, member, doc, text in zip(*columns(batch.slice(begin, 3000))):
                    grams = shingles(text or "", n)
                    if not member:
                        held = grams
                        continue
                    shared = np.isin(grams, held, assume_unique=True)
                    common = int(shared.sum())
                    row = (pivot, doc, common, len(grams) + len(held) - common)
                    if places is not None:
                        in_ball = common * 100 >= row[3] * (100 - BALL)
                        beyond = grams[~shared] if in_ball else grams[:0]
                        first = np.argsort(places(beyond))[: len(grams) - needed(len(grams), pct) + 1]
                        reached = common * 100 >= row[3] * (2 * pct - 100)
                        lacks = held[~np.isin(held, grams, assume_unique=True)]
                        bits = np.zeros(64 * len(MASK), bool)
                        bits[(lacks % np.uint64(len(bits))).astype(np.int64)] = True
                        row += (len(grams), beyond[first].view(np.int64).tolist())
                        row += (lacks.view(np.int64).tolist() if reached else [], len(lacks) - int(bits.sum()))
                        row += tuple(np.packbits(bits).view(np.int64).tolist())
                    for name, v in zip(out, row):
                        out[name].append(v)
                yield out

    ordered = (
        pivots.unionByName(members).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member")
    )
    kinds = {"rest": "array<long>", "lacks": "array<long>"}
    return map_batches(ordered, ", ".join(f"{name} {kinds.get(name, 'long')}" for name in names), run)


def told_apart(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after more ``links (a, b)`` between known nodes. Nodes of one
    label are linked with each other by some way; not all that are so have one label yet,
    as a label comes from two links away at most. It only saves looks, so that is enough."""
    a = comp.select(F.col("node").alias("a"), F.col("component").alias("low"))
    b = comp.select(F.col("node").alias("b"), F.col("component").alias("high"))
    ties = links.join(a, "a").join(b, "b").where("low <> high").select("low", "high").distinct()
    ties = ties.select(F.explode(F.array(F.struct("low", "high"), F.struct(F.col("high").alias("low"), F.col("low").alias("high")))).alias("t"))
    ties = ties.select(F.col("t.low").alias("at"), F.col("t.high").alias("to"))
    one = ties.groupBy("at").agg(F.min(F.least("at", "to")).alias("least"))
    two = ties.join(one.select(F.col("at").alias("to"), "least"), "to").groupBy("at").agg(F.min("least").alias("least"))
    known = comp.join(two.select(F.col("at").alias("component"), "least"), "component", "left")
    return written(known.select("node", F.coalesce("least", "component").alias("component")), "labels")


def _allowed(pairs: DataFrame, pct: int) -> DataFrame:
    """Pairs of ``pivot, pivot_size, doc, size`` whose sizes allow a link."""
    allowed = (F.least("size", "pivot_size") * 100 >= F.greatest("size", "pivot_size") * pct) & (
        F.col("pivot") != F.col("doc")
    )
    return pairs.where(allowed).select("pivot", "doc")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("pivot", "doc").alias("x"), F.greatest("pivot", "doc").alias("y"))


def regions_of(entries: DataFrame) -> DataFrame:
    """``gram, doc, size, members`` of entries that share their n-gram with others."""
    rows = entries.select("gram", "doc", "size")
    return rows.withColumn("members", F.count("*").over(Window.partitionBy("gram"))).where("members > 1")


def central(large: DataFrame, pct: int, seed: int) -> DataFrame:
    """Every document of the regions beside the ``pivot`` of its region. Pivot is
    the document whose prefix lies in large regions for the greatest part: near copies of
    one text have what was changed in them, which is rare, in front of their prefixes."""
    share = large.groupBy("doc", "size").agg(F.count("*").alias("n"))
    share = share.select("doc", (-F.col("n") / (F.col("size") * (100 - pct) + 100)).alias("share"))
    order = F.struct("share", F.xxhash64("doc", F.lit(seed)).alias("h"), "doc")
    pivots = large.join(share, "doc").groupBy("gram").agg(F.min(order).alias("first"))
    return large.join(pivots.select("gram", F.col("first.doc").alias("pivot")), "gram").where("pivot <> doc")


def within_pivot(met: DataFrame, pct: int) -> DataFrame:
    """Pairs of ``pivot, doc`` that can link by n-grams of a pivot that both have met, at
    least one of them without a link to it. ``most`` is the size of the largest set with
    which what a document shares with the pivot can be enough for a link; without a link
    to the pivot that is below the pivot's size."""
    rows = met.select(
        "pivot", "doc", "size",
        (F.col("total") + F.col("common") - F.col("size")).alias("pivot_size"),
        (F.floor(F.col("common") * (100 + pct) / pct) - F.col("size")).alias("most"),
        (F.col("common") * 100 >= F.col("total") * pct).alias("linked"),
    )
    of_size = lambda c: F.floor(F.log(c) / float(np.log(STEP)))
    least = F.ceil(F.col("size") * pct / 100)
    far = rows.where(~F.col("linked") & (F.col("most") >= least)).select(
        F.col("pivot").alias("at"),
        F.explode(F.sequence(of_size(least), of_size(F.col("most")))).alias("class"),
        F.col("doc").alias("other"), F.col("size").alias("other_size"), F.col("most").alias("other_most"),
    )
    near = rows.where("size < pivot_size").select(
        F.col("pivot").alias("at"), of_size(F.col("size")).alias("class"), "doc", "size", "most"
    )
    pairs = near.join(far, ["at", "class"]).where("doc <> other AND size <= other_most AND other_size <= most")
    return pairs.select(F.col("other").alias("pivot"), "doc")


def probes(met: DataFrame, pct: int, seed: int) -> DataFrame:
    """Pairs of ``pivot, doc`` that are likely to link: a document without a link to its
    pivot beside the one nearest to the pivot that lacks the same n-gram of it."""
    rows = met.select(
        F.col("pivot").alias("at"), "doc", (F.col("total") - F.col("common")).alias("far"),
        (F.col("common") * 100 >= F.col("total") * pct).alias("linked"), F.explode("lacks").alias("gram"),
    )
    order = F.struct("far", F.xxhash64("doc", F.lit(seed)).alias("h"), "doc")
    nearest = rows.groupBy("at", "gram").agg(F.min(order).alias("first"))
    nearest = nearest.select("at", "gram", F.col("first.doc").alias("pivot"))
    pairs = rows.where(~F.col("linked")).join(nearest, ["at", "gram"]).where("doc <> pivot")
    return pairs.select("pivot", "doc").distinct()


def divided(met: DataFrame, comp: DataFrame, pct: int) -> DataFrame:
    """Pairs of ``pivot, doc`` that can link by n-grams that a pivot of both lacks, in the
    regions of the pivot and one such n-gram: of those that two sets share, the first in
    the order counts, so none that stand before it are shared. Of the pivot's own n-grams
    they share what neither lacks. One of the two has no link to the pivot."""
    rows = met.join(comp.select(F.col("node").alias("doc"), F.col("component").alias("comp")), "doc").select(
        "pivot", "doc", "size", "common", "comp", "extra", *MASK,
        (F.col("total") - F.col("size")).alias("lacking"),
        (F.col("common") * 100 >= F.col("total") * pct).alias("linked"),
        F.posexplode("rest").alias("before", "beyond"),
    )
    rows = rows.withColumn("after", F.col("size") - F.col("common") - F.col("before")).drop("before")
    # At most what it shares with the pivot and what comes after is shared with any set.
    asks = rows.where(~F.col("linked") & (F.col("common") + F.col("after") >= F.ceil(F.col("size") * pct / 100)))
    asks = asks.drop("linked", "common")
    asks = asks.select("pivot", "beyond", *[F.col(c).alias(f"o_{c}") for c in asks.columns if c not in ("pivot", "beyond")])
    bits = sum((F.bit_count(F.col(m).bitwiseAND(F.col(f"o_{m}"))) for m in MASK), F.lit(0))
    both_lack = F.least("lacking", "o_lacking", bits + F.col("extra"), bits + F.col("o_extra"))
    within = F.col("common") - F.col("o_lacking") + both_lack
    most = within + F.least("after", "o_after")
    can = (F.col("comp") != F.col("o_comp")) & (most * (100 + pct) >= (F.col("size") + F.col("o_size")) * pct)
    pairs = rows.join(asks, ["pivot", "beyond"]).where(can)
    return pairs.select(F.col("o_doc").alias("pivot"), "doc", "size", F.col("o_size").alias("pivot_size"))


def similarity_classes(
    docs: DataFrame, n: int = 5, pct: int = 80, seed: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_shingles, component_id`` of every document: the size of its n-gram set
    and the smallest key reachable by links; two documents link when ``100 *
    intersection >= pct * union``.

    Null texts and texts without words have empty sets and link with nothing. Keys must
    be unique; rows without a key are left out; rows that share a key count as linked.
    Other columns do not matter; an empty table gives no rows. What meets in one task is
    a region's rows of a few numbers each, or a pivot and a few hundred documents."""
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    hot = frequent(rows, n)
    sets = written(prefixes(rows, n, pct, hot), "sets")
    full = sets.where("size > 0")
    classes = full.groupBy("h1", "h2").agg(F.min("doc").alias("rep"))
    of = full.select("doc", "h1", "h2").join(classes, ["h1", "h2"]).select("doc", "rep")
    of = written(of, "classes")
    line = Window.partitionBy("gram")
    entries = full.where("prefix IS NOT NULL").select("doc", "size", F.explode("prefix").alias("gram"))
    # Equal sets of different batches are one document from here on.
    shared = regions_of(entries).join(of, "doc").select("gram", F.col("rep").alias("doc"), "size").distinct()
    regions = written(regions_of(shared), "regions")

    def opened(regions: DataFrame) -> DataFrame:
        """Regions with the first pivot of each."""
        order = F.struct(F.xxhash64("doc", F.lit(seed)).alias("h"), F.col("doc"), F.col("size"))
        first = F.min(order).over(line)
        return regions.withColumns({"pivot": first["doc"], "pivot_size": first["size"]})

    two = _allowed(opened(regions.where("members = 2")), pct)
    ids = two.select("doc").union(two.select("pivot")).union(regions.where("members > 2").select("doc")).distinct()
    texts = written(sketched(rows.join(ids, "doc", "left_semi"), n), "texts")
    comp = texts.select(F.col("doc").alias("node"), F.col("doc").alias("component"))
    linked = F.col("common") * 100 >= F.col("total") * pct
    linked_pairs = lambda df: df.where(linked).select(F.col("pivot").alias("a"), F.col("doc").alias("b"))
    seen = spark.createDataFrame([], "pivot long, doc long, common long, total long")
    edges = linked_pairs(seen)
    large, small = regions.where(F.col("members") > LARGE), regions.where(F.col("members") <= LARGE)
    if not large.isEmpty():
        beside = central(large, pct, seed)
        met = written(distances(beside.select("pivot", "doc").distinct(), texts, n, pct, hot), "divided")
        seen = met.select(seen.columns)
        # The triangle window: what links to one outside of the ball is outside of a smaller one.
        outer = met.where(F.col("common") * 100 < F.col("total") * (200 - BALL - pct)).select("pivot", "doc")
        small = small.unionByName(regions_of(beside.join(outer, ["pivot", "doc"])))
        met = met.where(F.col("common") * 100 >= F.col("total") * (100 - BALL))
        looked = within_pivot(met, pct).unionByName(probes(met, pct, seed))
        for _ in range(2):  # first what is likely to link, then all that still can
            pairs = _both(looked).distinct().join(_both(seen), ["x", "y"], "left_anti")
            pairs = pairs.select(F.col("x").alias("pivot"), F.col("y").alias("doc"))
            pairs = written(near_enough(pairs, texts, pct), "pairs")
            seen = seen.unionByName(written(distances(pairs, texts, n), "distances"))
            edges = linked_pairs(seen)
            comp = told_apart(told_apart(comp, edges), edges)
            looked = _allowed(divided(met, comp, pct), pct)
    # Large regions are done with.
    regions = written(opened(small), "regions")
    pairs = _both(_allowed(regions, pct)).distinct().join(_both(seen), ["x", "y"], "left_anti")
    pairs = written(pairs.select(F.col("x").alias("pivot"), F.col("y").alias("doc")), "pairs")
    new = written(distances(pairs, texts, n), "distances")
    seen = seen.unionByName(new)
    links = linked_pairs(new)
    edges = edges.unionByName(links)
    comp = told_apart(comp, links)
    rest = regions.where("members > 2").select("gram", "doc", "size", "pivot")
    far = seen.select("pivot", "doc", (1 - F.col("common") / F.col("total")).alias("far"))
    far = far.unionByName(far.select(F.col("doc").alias("pivot"), F.col("pivot").alias("doc"), "far")).distinct()
    rest = rest.join(far, ["pivot", "doc"], "left").where("pivot <> doc").select("gram", "doc", "size", "far")
    pivots = FIRST
    while True:
        held = rest.join(comp.select(F.col("node").alias("doc"), F.col("component").alias("comp")), "doc")
        mixed = held.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        held = held.join(mixed.select("gram"), "gram", "left_semi")
        rank = F.row_number().over(line.orderBy("like", F.xxhash64("doc", F.lit(seed + pivots))))
        held = held.withColumn("like", F.count("*").over(Window.partitionBy("gram", "comp"))).withColumn("rank", rank)
        held = written(held.select("gram", "doc", "size", "far", "comp", "rank"), "held")
        chosen = held.where(F.col("rank") <= pivots).select(
            "gram",
            F.col("doc").alias("pivot"),
            F.col("size").alias("pivot_size"),
            F.col("far").alias("pivot_far"),
            F.col("comp").alias("pivot_comp"),
            F.col("rank").alias("pivot_rank"),
        )
        # The triangle window, with room for rounding.
        near = F.coalesce(F.abs(F.col("far") - F.col("pivot_far")) <= 1 - pct / 100 + 1e-9, F.lit(True))
        near = near & (F.col("rank") > F.col("pivot_rank"))  # two pivots meet once
        met = held
        if pivots > FIRST:
            # Few regions are left, with many pivots each: a pair then meets only in the
            # first of the regions that hold both, where one of them is yet to be pivot.
            held_in = held.groupBy("doc").agg(F.collect_list("gram").alias("grams"))
            met = held.join(held_in, "doc")
            theirs = held_in.select(F.col("doc").alias("pivot"), F.col("grams").alias("pivot_grams"))
            chosen = chosen.join(theirs, "pivot")
            near = near & (F.array_min(F.array_intersect("grams", "pivot_grams")) == F.col("gram"))
        met = met.join(chosen, "gram").where(F.col("comp") != F.col("pivot_comp")).where(near)
        pairs = _both(_allowed(met, pct)).distinct().join(_both(seen), ["x", "y"], "left_anti")
        pairs = pairs.select(F.col("x").alias("pivot"), F.col("y").alias("doc"))
        pairs = written(near_enough(pairs, texts, pct), "pairs")
        rest = held.where(F.col("rank") > pivots).select("gram", "doc", "size", "far")
        if held.isEmpty():
            break
        if not pairs.isEmpty():
            new = written(distances(pairs, texts, n), "distances")
            seen = seen.unionByName(new)
            links = linked_pairs(new)
            if not links.isEmpty():
                edges = edges.unionByName(links)
                comp = told_apart(comp, links)
        pivots *= GROWTH
    comp = components(edges)
    named = of.join(comp, F.col("rep") == F.col("node"), "left").select(
        "doc", F.coalesce("component", "rep").alias("component")
    )
    # Keys in ``of`` that repeat with different sets are joined at last.
    out = sets.select("doc", "size").join(named.groupBy("doc").agg(F.min("component").alias("component")), "doc", "left")
    return out.select(
        F.col("doc").alias(key),
        F.col("size").alias("n_shingles"),
        F.coalesce("component", "doc").alias("component_id"),
    )
