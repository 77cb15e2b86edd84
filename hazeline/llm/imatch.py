"""Document fingerprints by I-Match over randomised lexicon subsets.

Terms are the lower-cased words of a text. The lexicon keeps those within a band of
inverse document frequency. A document's lexicon terms are made distinct and sorted, and
every randomised subset of the lexicon gives one hash of the terms that lie in it. The
subsets thin out in steps, so that short and long documents both have subsets with a few
of their terms. Likeness is the share of equal hashes among the subsets that hold a term
of either document.

Document frequencies are counted on 23-bit term hashes, so the lexicon is a table of a
fixed size whatever the corpus."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import WordHashes, columns, map_batches, words_of

SLOT_BITS = 23
RATES = range(1, 11)  # a subset of rate r holds one term in 2**r
PER_RATE = 8
_SHIFT = np.uint64(64 - SLOT_BITS)
_SEEDS = np.array(
    [xxhash.xxh3_64_intdigest(f"subset {r} {k}".encode()) | 1 for r in RATES for k in range(PER_RATE)], np.uint64
)
_TAKE = np.repeat(np.array([64 - r for r in RATES], np.uint64), PER_RATE)


def terms(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct terms."""
    return np.unique(hashes.of(words_of(text.lower())))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``slot, df`` over all texts; each task adds up its texts first."""

    def run(batches):
        counts, hashes = np.zeros(1 << SLOT_BITS, np.int32), WordHashes()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts[np.unique(terms(t, hashes) >> _SHIFT).astype(np.int64)] += 1
        slots = np.flatnonzero(counts)
        for at in range(0, len(slots), 1 << 16):
            some = slots[at : at + (1 << 16)]
            yield {"slot": some, "df": counts[some]}

    rows = map_batches(docs.select(F.col(text).alias("text")), "slot int, df long", run)
    return rows.groupBy("slot").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, least_df: int = 2, least_idf: float = math.log(20), text: str = "text") -> np.ndarray:
    """Bit table of the slots whose terms are in the band: in ``least_df`` documents at
    least, and with ``log(N / df) >= least_idf``. The table comes to the driver in packed
    pieces, a megabyte in all."""
    n = docs.count()
    per = 1 << 13
    band = document_frequencies(docs, text).where(
        (F.col("df") >= least_df) & (F.col("df") <= n / math.exp(least_idf))
    )

    def run(batches):
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.asarray(batch.column(0))
            for c in np.unique(slots // per):
                bits = rows.setdefault(int(c), np.zeros(per, np.uint8))
                bits[slots[slots // per == c] % per] = 1
        yield {"c": list(rows), "bits": [np.packbits(b).tobytes() for b in rows.values()]}

    packed = map_batches(
        band.select("slot").repartition((F.col("slot") / per).cast("int")), "c int, bits binary", run
    )
    table = np.zeros((1 << SLOT_BITS) // per * (per // 8), np.uint8)
    for r in packed.collect():  # at most 2**23 / 8192 rows of a kilobyte
        at = r["c"] * (per // 8)
        table[at : at + per // 8] |= np.frombuffer(r["bits"], np.uint8)
    return table


def fingerprint(text: str, table: np.ndarray, hashes: WordHashes) -> np.ndarray:
    """One 16-bit number a subset, 0 where it holds no term of the text. A text without a
    lexicon term goes by all its terms, one without terms by its characters."""
    own = terms(text, hashes)
    slots = (own >> _SHIFT).astype(np.int64)
    kept = own[(table[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1]
    kept = kept if len(kept) else own
    if not len(kept):
        whole = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % 65535 + 1
        return np.full(len(_SEEDS), whole, np.uint16)
    out = np.zeros(len(_SEEDS), np.uint64)
    for at in range(0, len(kept), 4096):
        some = kept[at : at + 4096, None] * _SEEDS
        some ^= some >> np.uint64(32)
        some *= np.uint64(0x9E3779B97F4A7C15)
        inside = (some >> _TAKE) == 0
        # The sum over the sorted distinct terms; equal sets have equal sums.
        some = (some ^ (some >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        out += np.where(inside, some, np.uint64(0)).sum(0, dtype=np.uint64)
    some = out ^ (out >> np.uint64(31))
    return np.where(out == 0, 0, (some % np.uint64(65535)) + np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among subsets that hold a term of either, at the rates that
    leave a quarter of the subsets empty at least (all rates, if none does): there a
    subset holds hardly more than one term, and the share is close to that of common
    terms. Without any such subset, 1 for the same fingerprint, else 0."""
    either, same = (a != 0) | (b != 0), a == b
    thin = np.repeat(either.reshape(-1, PER_RATE).sum(1) * 4 <= PER_RATE * 3, PER_RATE)
    for rates in (thin, ~thin):
        n = int((either & rates).sum())
        if n:
            return float((same & either & rates).sum() / n)
    return float(same.all())


def written(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` of every row; a null text counts as empty. The lexicon travels
    with the tasks; its size is fixed."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            keys, texts = columns(batch)
            yield {"key": keys, "fp": [written(fingerprint(t or "", table, hashes)) for t in texts]}

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_batches(rows, "key long, fp string", run).toDF(key, "fingerprint")


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in ranges of the key, each range in one partition and ascending, led by a copy
    of the row that comes before its first: ``range, lead, key, text``. One shuffle; the
    first range is led by the very last row. Rows without a key are left out, rows with
    the same key are ordered by text."""
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(c) for c in rows.approxQuantile("key", [k / n for k in range(1, n)], 0.2 / n)})
    below = F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("key"))
    placed = rows.withColumn("range", F.size(below) if cuts else F.lit(0))
    last = {r["range"]: r["last"] for r in placed.groupBy("range").agg(F.max("key").alias("last")).collect()}
    order = sorted(last)
    leads = {last[order[k - 1]]: r for k, r in enumerate(order)}  # at most one a range
    extra = F.lit(None).cast("int")
    if leads:
        extra = F.create_map(*[F.lit(v) for pair in leads.items() for v in pair])[F.col("key")]
    own = F.struct("range", F.lit(1).alias("own"))
    lead = F.when(extra.isNotNull(), F.struct(extra.alias("range"), F.lit(0).alias("own")))
    spread = placed.withColumn("to", F.array_compact(F.array(own, lead)))
    return (
        spread.select("key", "text", F.explode("to").alias("to"))
        .select("to.range", "to.own", "key", "text")
        .repartitionById(max(order, default=0) + 1, "range")
        .sortWithinPartitions("range", "own", "key", "text")
    )


def compared(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the next document (by
    descending key; after the last the first) gives the last third, and their likeness.
    Null texts count as empty; a document alone is its own next."""

    def run(batches):
        hashes = WordHashes()
        before: tuple[str, np.ndarray] | None = None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for _, own, k, t in zip(*columns(batch)):
                own_print = fingerprint(t, table, hashes)
                if own:
                    n = len(t)
                    edited = t[: n - n // 3] + before[0][: n // 3]
                    edited_print = fingerprint(edited, table, hashes) if n // 3 else own_print
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    near = likeness(own_print, edited_print), likeness(own_print, before[1])
                    row = (k, n, sha, written(own_print), written(edited_print), *near)
                    for name, v in zip(names, row):
                        out[name].append(v)
                before = (t, own_print)
            yield out

    ddl = (
        "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    names = [f.split()[0] for f in ddl.split(", ")]
    return map_batches(beside_next(docs, key, text), ddl, run).withColumnRenamed("key", key)
