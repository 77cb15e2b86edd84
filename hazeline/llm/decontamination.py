"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is a run of ``length`` words of a benchmark item; an item of fewer words, but
not none, is one window. Words are lower case. A window occurs in a document only with
all its shingles (runs of five words, or the whole of a shorter window), so one of them
is a prefix that an occurrence must have: the rarest, by how often each stands in the
documents. Windows with a shingle that no document has are out at once. Documents meet
windows on that prefix only; its place in the window says where an occurrence would begin
and end, which must lie within the document; what is left is compared byte by byte over
the whole window.

The windows travel to the documents in blocks of at most ``block`` pairs of window and
item and ``block_bytes`` of text, one pass over the documents for each block, so what is
sent does not grow beyond that. Documents are read in numpy, a batch at a time, whole
texts, and never shuffled unless there are several blocks: then the rows with hits are.

Null and empty texts have no words. Rows of documents are handled one by one: null and
repeated keys give a row each, other columns do not matter, an empty table gives no rows.
Items that share an id count as one item; items without an id mark words, but are
neither counted nor listed. Without items nothing is hit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import map_batches, mix64, ngram_hashes, spread, written

SHINGLE = 5
#: Longest word that is hashed together with others.
LONG = 1 << 16
#: Bytes hashed, and pairs of a place and a window compared, at a time.
STEP = 1 << 20
PAIRS = 1 << 17
_BASE = 0x9E3779B97F4A7C15


def _letters() -> np.ndarray:
    """What each byte of a text becomes: 0 between words, else a byte of a word."""
    table = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = np.arange(first, last + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


LETTERS = _letters()


def _powers(base: int) -> np.ndarray:
    out = np.full(STEP + 2 * LONG, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _POWERS:
        _POWERS.extend([_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))])
    return _POWERS


class Words:
    """The words of texts (an array of large strings) that each end in a separator.

    ``data`` holds the words with a zero behind each, ``at`` where each begins (and the
    end), ``first`` the number of words before each text (and of all)."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        letters = LETTERS[raw]
        inside = letters != 0
        before = np.r_[False, inside[:-1]]
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
        self.data = letters[inside | before]
        self.at = np.r_[0, np.cumsum(ends - starts + 1)]
        self.first = np.searchsorted(starts, offsets - offsets[0])
        self.n = len(starts)
        self._hashes: np.ndarray | None = None

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if self._hashes is None:
            out = np.empty(self.n, np.uint64)
            sizes = np.diff(self.at)
            long = np.flatnonzero(sizes > LONG)
            cuts = np.searchsorted(self.at, np.arange(0, len(self.data), STEP))
            cuts = np.unique(np.r_[cuts, long, long + 1, self.n])
            power, inverse = powers()
            for a, b in zip(np.r_[0, cuts[:-1]].tolist(), cuts.tolist()):
                if a == b:
                    continue
                begin, part = self.at[a], self.data[self.at[a] : self.at[b]]
                if b == a + 1 and sizes[a] > LONG:
                    out[a] = xxhash.xxh3_64_intdigest(part.tobytes())
                    continue
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * power[: len(part)], out=sums[1:])
                at = self.at[a : b + 1] - begin
                out[a:b] = mix64((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]])
            self._hashes = out
        return self._hashes

    def text_of(self, begin: int, end: int) -> bytes:
        """Words ``begin`` to ``end`` with a zero behind each."""
        return self.data[self.at[begin] : self.at[end]].tobytes()


def batches_of(batch: pa.RecordBatch, column: int, size: int = 1 << 22) -> Iterator[tuple[int, int, Words]]:
    """Rows of a batch in runs of about ``size`` bytes of text."""
    texts = batch.column(column).cast(pa.large_string())
    if len(texts):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        for a, b in zip(*_runs((offsets[1:] - offsets[0]) // size)):
            yield a, b, Words(texts.slice(a, b - a))


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    return [0, *cuts.tolist()], [*cuts.tolist(), len(values)]


def closed(text: str) -> F.Column:
    return F.concat(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("\n"))


def item_windows(items: DataFrame, length: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item, window, n_words, shingles array<long>``: every window of every item, its
    words with a blank behind each, and the hashes of its shingles in order."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, words in batches_of(batch, 1):
                hashes = words.hashes()
                grams = {k: ngram_hashes(hashes, k).view(np.int64) for k in range(1, SHINGLE + 1)}
                for i in range(a, b):
                    begin, end = words.first[i - a], words.first[i - a + 1]
                    size = min(length, end - begin)
                    if not size:
                        continue
                    k = min(SHINGLE, size)
                    at = range(begin, end - size + 1)
                    yield {
                        "item": [keys[i]] * len(at),
                        "window": [words.text_of(p, p + size).replace(b"\0", b" ").decode() for p in at],
                        "n_words": [size] * len(at),
                        "shingles": [grams[k][p : p + size - k + 1] for p in at],
                    }

    rows = items.select(F.col(key).cast("string").alias("item"), closed(text).alias("text"))
    return map_batches(rows, "item string, window string, n_words long, shingles array<long>", run)


class Members:
    """Which of many 64-bit hashes are in a sorted list, by a bit table first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        bits = min(24, max(10, (16 * len(self.keys)).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes that are in the list, and their places in it."""
        at = np.flatnonzero(self.bits[(hashes & self.mask).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[found] == hashes[at]
        return at[same], found[same]


def occurrences(docs: DataFrame, shingles: DataFrame, text: str, block: int) -> DataFrame:
    """``size, hash, n``: how often the shingles ``size, hash`` stand in the documents,
    those that do. One pass over the documents for every ``block`` hashes."""
    n = shingles.count()
    parts = []
    blocks = max(1, -(-n // block))
    for b in range(blocks if n else 0):
        mine: dict[int, list[int]] = {}
        for r in shingles.where(F.pmod(F.col("hash"), F.lit(blocks)) == b).collect():
            mine.setdefault(r["size"], []).append(r["hash"])
        sent = docs.sparkSession.sparkContext.broadcast(
            {size: Members(np.array(h, np.int64).view(np.uint64)) for size, h in mine.items()}
        )

        def run(batches, sent=sent):
            known = sent.value
            counts = {size: np.zeros(len(m.keys), np.int64) for size, m in known.items()}
            for batch in batches:
                for _, _, words in batches_of(batch, 0):
                    # Runs over the end of a text count too: that only orders prefixes.
                    for size, m in known.items():
                        counts[size] += np.bincount(m.find(ngram_hashes(words.hashes(), size))[1], minlength=len(m.keys))
            for size, m in known.items():
                at = np.flatnonzero(counts[size])
                yield {"size": [size] * len(at), "hash": m.keys[at].view(np.int64), "n": counts[size][at]}

        parts.append(map_batches(docs.select(closed(text).alias("text")), "size long, hash long, n long", run))
    if not parts:
        return docs.sparkSession.createDataFrame([], "size long, hash long, n long")
    return reduce(DataFrame.unionByName, parts).groupBy("size", "hash").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, windows: DataFrame, text: str, block: int) -> DataFrame:
    """``window, n_words, size, hash, place``: the rarest shingle of every distinct window
    whose shingles all occur, and its place in the window."""
    size = F.least(F.col("n_words"), F.lit(SHINGLE).cast("long")).alias("size")
    distinct = windows.groupBy("window").agg(F.first("n_words").alias("n_words"), F.first("shingles").alias("shingles"))
    each = distinct.select("window", "n_words", size, F.posexplode("shingles").alias("place", "hash"))
    counted = occurrences(docs, each.select("size", "hash").distinct(), text, block)
    rarest = (
        each.join(counted, ["size", "hash"], "left")
        .groupBy("window", "n_words", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "place")).alias("p"))
    )
    return rarest.where("p.n > 0").select("window", "n_words", "size", "p.hash", F.col("p.place").cast("long").alias("place"))


@dataclass
class Block:
    """Windows of one block by their prefixes, and the items that have them."""

    prefix: dict[int, tuple[Members, np.ndarray, np.ndarray]]  # size: hashes, starts, windows
    place: np.ndarray
    n_words: np.ndarray
    data: np.ndarray
    at: np.ndarray
    item_at: np.ndarray
    item_of: np.ndarray
    items: list[str]

    @staticmethod
    def of(rows: Iterable) -> Block:
        """From rows ``window, n_words, size, hash, place, item``, one for each item."""
        names: dict[str, int] = {}
        windows: dict[str, tuple] = {}
        owners: list[list[int]] = []
        for r in rows:
            w = windows.setdefault(r["window"], (len(windows), r["n_words"], r["size"], r["hash"], r["place"]))
            if w[0] == len(owners):
                owners.append([])
            if r["item"] is not None:
                owners[w[0]].append(names.setdefault(r["item"], len(names)))
        table = np.array([w[1:] for w in windows.values()], np.int64).reshape(-1, 4)
        prefix = {}
        for size in np.unique(table[:, 1]).tolist():
            mine = np.flatnonzero(table[:, 1] == size)
            hashes = table[mine, 2].view(np.uint64)
            order = np.argsort(hashes, kind="stable")
            members = Members(hashes)
            starts = np.searchsorted(hashes[order], members.keys)
            prefix[size] = (members, np.r_[starts, len(mine)], mine[order])
        texts = [w.replace(" ", "\0").encode() for w in windows]
        sizes = lambda parts: np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
        flat = np.array([i for own in owners for i in own], np.int64)
        return Block(
            prefix, table[:, 3], table[:, 0], np.frombuffer(b"".join(texts), np.uint8), sizes(texts),
            sizes(owners), flat, list(names),
        )

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur and the words they begin at."""
        out = []
        for size, (members, starts, windows) in self.prefix.items():
            places, found = members.find(ngram_hashes(words.hashes(), size))
            sizes = starts[found + 1] - starts[found]
            cuts = np.r_[0, np.cumsum(sizes)]
            step = np.searchsorted(cuts, np.arange(0, cuts[-1] + PAIRS, PAIRS))
            for a, b in zip(step[:-1].tolist(), step[1:].tolist()):
                if a < b:
                    w = windows[spread(starts[found[a:b]], sizes[a:b])]
                    out.append(self._verified(words, w, np.repeat(places[a:b], sizes[a:b])))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*out))

    def _verified(self, words: Words, w: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = place - self.place[w]
        end = begin + self.n_words[w]
        text = np.searchsorted(words.first, place, "right") - 1
        fits = (begin >= words.first[text]) & (end <= words.first[text + 1])
        w, begin, end = w[fits], begin[fits], end[fits]
        size = self.at[w + 1] - self.at[w]
        fits = words.at[end] - words.at[begin] == size
        w, begin, size = w[fits], begin[fits], size[fits]
        good = np.zeros(len(w), bool)
        step = np.cumsum(size) // STEP
        for a, b in zip(*_runs(step)) if len(w) else ():
            same = words.data[spread(words.at[begin[a:b]], size[a:b])] == self.data[spread(self.at[w[a:b]], size[a:b])]
            good[a:b] = np.logical_and.reduceat(same, np.cumsum(size[a:b]) - size[a:b])
        return w[good], begin[good]

    def hits(self, words: Words) -> tuple[list[int], list[list[int]], list[list[int]], list[list[str]]]:
        """For each text: number of words, where runs of hit words begin and end, and the
        items whose windows occur."""
        w, begin = self.find(words)
        first = words.first
        n = len(first) - 1
        change = np.zeros(words.n + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + self.n_words[w], -1)
        hit = np.cumsum(change)[:-1] > 0
        # A run ends with its text, even if the next text begins with a hit word.
        opens = np.zeros(words.n + 1, bool)
        opens[first] = True
        edge = lambda a, b: a & (~b | opens[:-1])
        begins = np.flatnonzero(edge(hit, np.r_[False, hit[:-1]]))
        ends = np.flatnonzero(hit & np.r_[~hit[1:] | opens[1:-1], True][: words.n]) + 1 if words.n else begins
        text = np.searchsorted(first, begins, "right") - 1
        cuts = np.searchsorted(text, np.arange(n + 1))
        found: list[set] = [set() for _ in range(n)]
        pairs = np.unique((np.searchsorted(first, begin, "right") - 1) * max(len(self.n_words), 1) + w)
        for pair in pairs.tolist():
            t, k = divmod(pair, len(self.n_words))
            found[t].update(self.item_of[self.item_at[k] : self.item_at[k + 1]].tolist())
        part = lambda values, t: (values[cuts[t] : cuts[t + 1]] - first[t]).tolist()
        return (
            np.diff(first).tolist(), [part(begins, t) for t in range(n)], [part(ends, t) for t in range(n)],
            [[self.items[i] for i in s] for s in found],
        )


COLUMNS = "n_words long, begins array<long>, ends array<long>, items array<string>"


def scanned(docs: DataFrame, rows: Iterable, text: str, extra: Sequence[tuple[str, str]], all_rows: bool) -> DataFrame:
    """One pass of one block over the documents, ``extra`` columns (name, type) kept."""
    sent = docs.sparkSession.sparkContext.broadcast(Block.of(rows))

    def run(batches):
        for batch in batches:
            kept = [batch.column(k + 1) for k in range(len(extra))]
            for a, b, words in batches_of(batch, 0):
                n, begins, ends, items = sent.value.hits(words)
                mine = [i for i in range(b - a) if all_rows or begins[i]]
                yield {name: [c[a + i].as_py() for i in mine] for (name, _), c in zip(extra, kept)} | {
                    "n_words": [n[i] for i in mine], "begins": [begins[i] for i in mine],
                    "ends": [ends[i] for i in mine], "items": [items[i] for i in mine],
                }

    ddl = ", ".join([f"{name} {kind}" for name, kind in extra] + [COLUMNS])
    return map_batches(docs.select(closed(text).alias("_text"), *[n for n, _ in extra]), ddl, run)


def scan(
    docs: DataFrame,
    items: DataFrame,
    length: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block: int = 500_000,
    block_bytes: int = 1 << 26,
) -> DataFrame:
    """``key, n_words, begins, ends, items`` of every document: runs of words (from 0, the
    end not included) that lie inside an occurrence of a window, and the ids of the items
    whose windows occur, in no certain order. Runs of several blocks may overlap."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("t"))
    windows = written(item_windows(items, length, item_key, item_text), "windows")
    starts = prefixes(docs, windows, "t", 8 * block)
    pairs = written(windows.select("item", "window").distinct().join(starts, "window"), "prefixes")
    n, size = pairs.agg(F.count("*"), F.sum(F.octet_length("window"))).head()
    blocks = max(1, -(-n // block), -(-(size or 0) // block_bytes))
    if blocks == 1:
        return scanned(docs, pairs.collect(), "t", [("key", "long")], True).withColumnRenamed("key", key)
    docs = docs.withColumn("digest", F.sha2("t", 256))
    parts = []
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b)
        found = scanned(docs, mine.collect(), "t", [("key", "long"), ("digest", "string")], b == 0)
        parts.append(written(found.withColumn("block", F.lit(b)), "hits"))
    # Rows of one key and one text are equal; the first block has all of them.
    rows = reduce(DataFrame.unionByName, parts).distinct()
    copies = parts[0].groupBy("key", "digest").agg(F.count("*").alias("copies"))
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    merged = rows.groupBy("key", "digest").agg(
        F.max("n_words").alias("n_words"), flat("begins"), flat("ends"), F.array_distinct(flat("items")).alias("items")
    )
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
    return (
        merged.alias("a").join(copies.alias("b"), same)
        .select("a.*", F.explode(F.expr("sequence(1, int(copies))")).alias("copy"))
        .select(F.col("key").alias(key), "n_words", "begins", "ends", "items")
    )


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` of scanned documents."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
            rows = [c.to_pylist() for c in batch.columns]
            for k, n, begins, ends, items in zip(*rows):
                hit, reached = 0, 0
                for a, b in sorted(zip(begins, ends)):
                    hit, reached = hit + max(b, reached) - max(a, reached), max(b, reached)
                names = sorted(set(items))
                out["key"].append(k)
                out["n_words"].append(n)
                out["n_hit"].append(hit)
                out["n_items"].append(len(names))
                out["items_sha256"].append(hashlib.sha256(",".join(names).encode()).hexdigest())
                out["contaminated"].append(hit > 0)
            yield out

    rows = found.select(F.col(key).alias("key"), "n_words", "begins", "ends", "items")
    ddl = "key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return map_batches(rows, ddl, run).withColumnRenamed("key", key)
