"""Alignment of two tokenizers over the same texts.

Every text is tokenized in full by a byte-level BPE (A, by its merge automaton; the text
gets a blank before it) and by a ``sentencepiece`` BPE model (B, which puts that blank
itself). Special strings inside texts are plain text. A single blank between two other
characters is an anchor: a token of A and one of B both begin there, since A parts texts
before such blanks and no piece of B holds a blank behind another character. Anchors part
a document into windows. The tokens inside a window, and how they fall into groups, depend
on its bytes alone, so a window is tokenized and aligned once and remembered by its bytes.
Groups are cut wherever tokens of A and B end at the same byte; the two tokens that end a
group together are linked, and links are counted over the whole corpus.

Documents are read once; groups, links with their number, and a task's own counts of
links go to a file in the shared folder. The counts of all tasks, a row for each pair of
ids, are then looked up in memory if there are at most ``in_memory`` of them, and by a
join otherwise.

Null and empty texts, and texts whose tokens do not give back their bytes, have no
tokens: zeros, and '' for the groups. Rows are handled one by one: null and repeated keys
give a row each and count each, other columns do not matter, an empty table gives none."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.batch_encoder import ALNUM, KINDS, WIDE, BatchEncoder, Labels, _after_wide_space, in_runs
from hazeline.llm.bpe_automaton import Automaton
from hazeline.llm.common import map_batches, spread
from hazeline.session import scratch_path

BLANK = "▁"  # what stands for a blank in the pieces of B (fixed value)


def whole_arrays(parts: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and how many each has."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum())), sizes


def anchors(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where windows begin, and the end of the data: at the texts' own bounds and at single
    blanks between other characters. Every text begins with a blank."""
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before = KINDS[data[at - 1]]
    at = at[(before >= ALNUM) & (KINDS[data[at + 1]] >= ALNUM)]
    wide = KINDS[data[at - 1]] == WIDE
    if wide.any():
        wide[wide] = _after_wide_space(data, at[wide])
        at = at[~wide]
    mark = np.zeros(len(data) + 1, bool)
    mark[at] = mark[bounds] = True
    return np.flatnonzero(mark)


def both_at(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two rising lists of the numbers that both hold."""
    place = np.full(max(a[-1:].max(initial=0), b[-1:].max(initial=0)) + 1, -1, np.int64)
    place[b] = np.arange(len(b))
    found = place[a]
    at = np.flatnonzero(found >= 0)
    return at, found[at]


class Aligner:
    """Both tokenizers, and the windows aligned so far. Whoever goes on with more than
    ``memo`` of them takes what was ``counted`` and calls ``forget``."""

    def __init__(self, a_path: str, b_path: str, memo: int = 300_000):
        import sentencepiece

        tok = Automaton(a_path)
        self.a = Labels({i: s for i, s in tok.label.items() if i not in tok.special.values()})
        tok.special, tok.split_special = {}, None
        self.encode_a = BatchEncoder(tok, memo)
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b = Labels(
            {
                i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(BLANK, " ").encode()
                for i in range(sp.get_piece_size())
            }
        )
        # Ids as they are written in groups: A within and at the end of its part, B alike.
        n_a, n_b = len(self.a.size), len(self.b.size)
        self.written = [f"{i}{c}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for c in ends for i in range(n)]
        self.base_b = 2 * n_a
        self.parted = not any(BLANK in sp.id_to_piece(i).lstrip(BLANK) for i in range(sp.get_piece_size()))
        self.memo = memo
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # -1: its tokens do not give back its bytes
        self.groups: list[str] = []  # each group with a semicolon behind it
        self.n_a, self.n_b = array("q"), array("q")
        self.links, self.ends = array("q"), array("q", [0])
        self.count_anew()

    def count_anew(self) -> None:
        self.seen = np.zeros(len(self.groups), np.int64)

    def _align(self, keys: list[bytes], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        """Align windows that are not known yet, all at once: ids of A and B of all
        windows, one after the other, and how many each window has."""
        self.n_a.frombytes(n_a.astype(np.int64).tobytes())
        self.n_b.frombytes(n_b.astype(np.int64).tobytes())
        at_a, at_b = both_at(np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b]))
        # A group's ids of A stand before its ids of B.
        group_a = np.searchsorted(at_a, np.arange(len(a)))
        group_b = np.searchsorted(at_b, np.arange(len(b)))
        code = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[at_a], last_b[at_b] = True, True
        code[np.arange(len(a)) + np.r_[0, at_b + 1][group_a]] = a + last_a * len(self.a.size)
        code[np.arange(len(b)) + (at_a + 1)[group_b]] = b + last_b * len(self.b.size) + self.base_b
        parts = list(map(self.written.__getitem__, code.tolist()))
        stops = np.cumsum(n_a + n_b).tolist()
        first = len(self.groups)
        self.groups += ["".join(parts[s:e]) for s, e in zip([0, *stops], stops)]
        self.known.update(zip(keys, range(first, first + len(keys))))
        # Every window ends where a group ends.
        done = np.searchsorted(at_a, np.cumsum(n_a))
        self.links.frombytes((a[at_a] * len(self.b.size) + b[at_b]).tobytes())
        self.ends.frombytes((self.ends[-1] + done).tobytes())

    def tokens(self, closed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and how many each text has, and the same of B; none for texts whose
        ids do not give back their bytes. Each text has the blank before it."""
        a, n_a = self.encode_a(closed)
        b, n_b = whole_arrays(self.sp.encode([t[1:] for t in closed.to_pylist()], num_threads=1))
        size = pc.binary_length(closed).to_numpy()
        raw = np.frombuffer(closed.buffers()[2], np.uint8)[: size.sum()]
        good = (size > 1) & self._same(self.a, a, n_a, raw, size) & self._same(self.b, b, n_b, raw, size)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        return a.astype(np.int64), n_a, b, n_b

    @staticmethod
    def _same(labels: Labels, ids: np.ndarray, n: np.ndarray, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        data = labels.bytes_of(ids)
        ends = np.r_[0, np.cumsum(labels.size[ids])][np.r_[0, np.cumsum(n)]]
        stops = np.r_[0, np.cumsum(size)]
        if len(data) == len(raw) and (data == raw).all():
            return np.diff(ends) == size
        return np.array(
            [
                e - s == y - x and bool((data[s:e] == raw[x:y]).all())
                for s, e, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), stops[:-1].tolist(), stops[1:].tolist())
            ],
            bool,
        )

    def windows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of tokens of A and B of each text, the windows of all texts in order,
        and how many windows each has."""
        nothing, blank = (pa.scalar(c, pa.large_string()) for c in ("", " "))
        closed = pc.binary_join_element_wise(nothing, texts.cast(pa.large_string()), blank)
        bounds = np.r_[0, np.cumsum(pc.binary_length(closed).to_numpy())]
        data = np.frombuffer(closed.buffers()[2], np.uint8)[: bounds[-1]]
        starts = anchors(data, bounds) if self.parted else bounds
        spans = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]
        )
        pieces = spans.dictionary_encode()
        keys = pieces.dictionary.to_pylist()
        found = list(map(self.known.get, keys))
        new = [key for key, k in zip(keys, found) if k is None]
        if new:
            a, n_a, b, n_b = self.tokens(pa.array(new, pa.large_binary()).cast(pa.large_string()))
            good = n_a > 0
            if not good.all():
                self.known.update((key, -1) for key, g in zip(new, good.tolist()) if not g)
                new = [key for key, g in zip(new, good.tolist()) if g]
            self._align(new, a, n_a[good], b, n_b[good])
            found = list(map(self.known.__getitem__, keys))
        windows = np.array(found, np.int64)[pieces.indices.to_numpy()]
        n = np.diff(np.searchsorted(starts, bounds))
        if (windows < 0).any():
            # One window that does not give back its bytes, and the text has no tokens.
            whole = np.minimum.reduceat(windows, np.cumsum(n) - n) >= 0
            windows, n = windows[np.repeat(whole, n)], n * whole
        ends = np.r_[0, np.cumsum(n)]
        n_a, n_b = (np.diff(np.r_[0, np.cumsum(np.array(x, np.int64)[windows])][ends]) for x in (self.n_a, self.n_b))
        return n_a, n_b, windows, n

    def count(self, windows: np.ndarray) -> None:
        if len(self.seen) < len(self.groups):
            self.seen = np.append(self.seen, np.zeros(len(self.groups) - len(self.seen), np.int64))
        self.seen += np.bincount(windows, minlength=len(self.seen))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of all windows counted so far and how often each occurred."""
        ends = np.array(self.ends, np.int64)[: len(self.seen) + 1]
        links = np.array(self.links, np.int64)[: ends[-1]]
        pairs, where = np.unique(links, return_inverse=True)
        n = np.bincount(where, np.repeat(self.seen, np.diff(ends)), len(pairs)).astype(np.int64)
        return self._pairs(pairs[n > 0]), n[n > 0]

    def _pairs(self, links: np.ndarray) -> np.ndarray:
        """Links as they leave a task: the id of A in the upper half, that of B in the lower."""
        a, b = np.divmod(links, len(self.b.size))
        return a << 32 | b

    def links_of(self, windows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts with ``n`` windows each: number of links, and the different links of
        all texts with how often each occurs, and how many different ones each text has."""
        ends = np.array(self.ends, np.int64)
        sizes = ends[windows + 1] - ends[windows]
        links = np.array(self.links, np.int64)[spread(ends[windows], sizes)]
        every = len(self.a.size) * len(self.b.size)
        text = np.repeat(np.repeat(np.arange(len(n)), n), sizes)
        code = np.sort(text * every + links)
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        owner, links = np.divmod(code[first], every)
        times = np.diff(np.r_[first, len(code)])
        return np.bincount(text, minlength=len(n)), self._pairs(links), times, np.bincount(owner, minlength=len(n))


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of two files, loaded once per process."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


def list_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(values))


FOUND = (
    "counts boolean, row long, key long, n_a long, n_b long, n_groups long, groups_sha256 string, "
    "groups string, links array<long>, times array<long>"
)


def found(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, keep_groups: bool) -> DataFrame:
    """A row for each document, and rows that only hold a task's counts of links."""

    def run(batches):
        both = aligner(a_path, b_path)
        both.count_anew()
        part, row = TaskContext.get().partitionId() << 40, 0

        def counts():
            links, times = both.counted()
            size = np.array([len(links)])
            return dict.fromkeys(("row", "key", "n_a", "n_b", "n_groups", "groups_sha256", "groups"), [None]) | {
                "counts": [True], "links": list_array(links, size), "times": list_array(times, size),
            }

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for s, e in in_runs(texts):
                if len(both.known) > both.memo:
                    yield counts()
                    both.forget()
                n_a, n_b, windows, n = both.windows(texts.slice(s, e - s))
                both.count(windows)
                n_links, links, times, different = both.links_of(windows, n)
                groups, ends = list(map(both.groups.__getitem__, windows.tolist())), np.cumsum(n).tolist()
                whole = ["".join(groups[x:y])[:-1] for x, y in zip([0, *ends], ends)]
                yield {
                    "counts": [False] * (e - s), "row": np.arange(part + row, part + row + e - s),
                    "key": batch.column(0).slice(s, e - s), "n_a": n_a, "n_b": n_b, "n_groups": n_links,
                    "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in whole],
                    "groups": whole if keep_groups else [None] * (e - s),
                    "links": list_array(links, different), "times": list_array(times, different),
                }
                row += e - s
        yield counts()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, FOUND, run)


def counted_in_memory(rows: DataFrame, counts: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Counts as sorted arrays that every task gets."""
    table = counts.select("link", "n", "best").toArrow()
    link, n, best = (c.to_numpy() for c in table.columns)
    order = np.argsort(link)
    sent = rows.sparkSession.sparkContext.broadcast((link[order], n[order], best[order].astype(np.int64)))

    def run(batches):
        link, n, best = sent.value
        for batch in batches:
            links, times = batch.column("links"), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(link, links.flatten().to_numpy())
            ends = np.r_[0, np.cumsum(np.diff(links.offsets.to_numpy()))]
            sums = lambda v: np.diff(np.r_[0, np.cumsum(v * times)][ends])
            yield {c: batch.column(c) for c, _ in columns} | {"n_best": sums(best[at]), "count_sum": sums(n[at])}

    ddl = ", ".join([f"{c} {t}" for c, t in columns] + ["n_best long", "count_sum long"])
    return map_batches(rows.select(*[c for c, _ in columns], "links", "times"), ddl, run)


def counted_by_join(rows: DataFrame, counts: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Counts joined to the links of all documents, summed back over each."""
    each = rows.select("row", F.explode(F.arrays_zip("links", "times")).alias("l"))
    sums = (
        each.select("row", F.col("l.links").alias("link"), F.col("l.times").alias("times"))
        .join(counts, "link")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("times")).alias("count_sum"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.select("row", *[c for c, _ in columns]).join(sums, "row", "left").select(
        *[c for c, _ in columns], zero("n_best"), zero("count_sum")
    )


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    key: str = "doc_id",
    text: str = "text",
    keep_groups: bool = False,
    in_memory: int = 4_000_000,
) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every
    document, and its ``groups`` as ``a1,a2|b1;a3|b2,b3`` if asked for. ``n_best`` counts
    links whose pair is the most frequent of its id of B, ``count_sum`` adds up how often
    the pairs of all links are linked in the corpus."""
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    out = found(docs, a_path, b_path, key, text, keep_groups)
    out.write.option("compression", "zstd").partitionBy("counts").parquet(path)
    written = spark.read.schema(out.schema).parquet(path)
    rows = written.where("NOT counts")
    pairs = (
        written.where("counts")
        .select(F.explode(F.arrays_zip("links", "times")).alias("l"))
        .groupBy(F.col("l.links").alias("link"))
        .agg(F.sum("l.times").alias("n"))
    )
    # Links of one id of B are as many as the vocabulary of A has ids, at most.
    of_b = Window.partitionBy(F.col("link").bitwiseAND(0xFFFFFFFF))
    counts = pairs.withColumn("best", F.col("n") == F.max("n").over(of_b))
    columns = [("key", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("groups_sha256", "string")]
    columns += [("groups", "string")] if keep_groups else []
    with_counts = counted_in_memory if pairs.count() <= in_memory else counted_by_join
    return with_counts(rows, counts, columns).select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
        "groups_sha256", *(["groups"] if keep_groups else []),
    )
