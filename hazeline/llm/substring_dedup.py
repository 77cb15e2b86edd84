"""Removal of repeated passages, with suffix automata of reference shards.

A window is a run of ``length`` words of one document. It is removed when the same words
start earlier: in a document with a smaller id, or earlier in the same document.

Every window has an anchor, the run of five words in it with the smallest hash, so equal
windows have equal anchors. Documents are streamed past the suffix automata of bounded
reference shards (the first documents of the corpus), which travel to all tasks: from an
anchor that a shard holds on, matching statistics give for every window the earliest
place of its words in the shard, and settle it when that lies before. What no shard
settles is grouped by anchor: one row for the windows that share an anchor, with two
window hashes, is sent to where all windows of that anchor meet, in document order. Two
windows count as equal when 40 bits of their anchor and the 64 and 8 of the hashes are:
among a million different windows of one anchor, a false equality has odds of one to some
ten thousand million. Maximal spans of removed windows are cut out at last."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import WordHashes, columns, map_batches, mix64, ngram_hashes, words_of

ANCHOR = 5
BYTES = 9  # of a window's two hashes beside its anchor's
HEAD = 17  # bytes before them: of the anchor, the document, a mark and the first start
KEY = 5  # bytes of the anchor
TOGETHER = 12 << 20  # bytes of text looked at together
SENT = 1 << 16  # rows in one result batch
HELD = 1 << 20  # starts that a task holds before it sends them on, a row a document
MARK = 1 << 31  # of windows, beside the start; settled starts have none
SECOND = np.uint64(0xD1B54A32D192ED03)  # for the second hash words are mixed with this


class SuffixAutomaton:
    """Of a sequence of word hashes. ``first`` holds, per state, where the earliest
    occurrence of its runs ends."""

    def __init__(self, words: np.ndarray):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.first = [-1], [0], [-1]
        last = 0
        for i, w in enumerate(words.tolist()):
            last = self._grow(last, w, i)

    def _state(self, nxt: dict, link: int, length: int, first: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.len.append(length)
        self.first.append(first)
        return len(self.len) - 1

    def _grow(self, last: int, w: int, i: int) -> int:
        cur, p = self._state({}, 0, self.len[last] + 1, i), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            if self.len[p] + 1 == self.len[q]:
                self.link[cur] = q
            else:
                copy = self._state(dict(self.next[q]), self.link[q], self.len[p] + 1, self.first[q])
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = copy
                    p = self.link[p]
                self.link[q] = self.link[cur] = copy
        return cur

    def matches(self, words: list[int], length: int) -> Iterator[tuple[int, int]]:
        """Matching statistics: for every run of ``length`` words that the sequence
        holds, its start in ``words`` and the end of its earliest place."""
        state, n = 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.len[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            if n >= length:
                while self.len[self.link[state]] >= length:
                    state = self.link[state]
                    n = self.len[state]
                yield i - length + 1, self.first[state]


class Shard:
    """Reference documents in one automaton, with a separator after each."""

    def __init__(self, docs: list[tuple[int, str]], length: int):
        hashes, parts, self.doc, self.start = WordHashes(), [], [], []
        at = 0
        for k, (doc, text) in enumerate(docs):
            words = hashes.of(words_of(text))
            parts += [words, mix64(np.array([k], np.uint64))]
            self.doc.append(doc)
            self.start.append(at)
            at += len(words) + 1
        self.length = length
        self.automaton = SuffixAutomaton(np.concatenate(parts) if parts else np.empty(0, np.uint64))
        grams = [ngram_hashes(p, ANCHOR) for p in parts]
        self.anchors = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)

    def settled(self, doc: int, words: np.ndarray, anchors: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts of windows of a document whose words are in the shard at an earlier
        place. ``anchors``: hash of the anchor of each window; ``at``: its place."""
        if not len(self.anchors):
            return np.empty(0, np.int64)
        spot = np.minimum(np.searchsorted(self.anchors, anchors), len(self.anchors) - 1)
        starts = np.flatnonzero(self.anchors[spot] == anchors)
        out = []
        if len(starts):
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                a = int(run[0])
                for s, end in self.automaton.matches(words[a : int(run[-1]) + self.length].tolist(), self.length):
                    k = int(np.searchsorted(self.start, end, side="right")) - 1
                    if (self.doc[k], end - self.length + 1 - self.start[k]) < (doc, a + s):
                        out.append(a + s)
        return np.array(out, np.int64)


def window_anchors(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the anchor of every window (the leftmost smallest)."""
    grams = ngram_hashes(words, ANCHOR)
    width = length - ANCHOR + 1
    n = len(words) - length + 1
    if n <= 0:
        return grams[:0], np.empty(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for k in range(1, width):
        other = grams[k : k + n]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    return best, at


def runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Runs of rows of a batch that are looked at together: up to 3000, and about
    ``TOGETHER`` bytes of text, or a row that has more."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    out, begin, held = [], 0, 0
    for k, n in enumerate(size.tolist()):
        if k > begin and (k - begin == 3000 or held + n > TOGETHER):
            out.append((begin, k))
            begin, held = k, 0
        held += n
    return [*out, (begin, batch.num_rows)]


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts one after the other; their list is emptied."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def held_twice(win: np.ndarray, chk: np.ndarray, rank: np.ndarray, whose: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where windows stand that also stand earlier in the batch, in rising order. ``rank``:
    order of the documents; ``whose``: document of each window."""
    order = np.argsort(win)
    same = win[order[1:]] == win[order[:-1]]
    busy = np.zeros(len(win), bool)
    busy[1:] |= same
    busy[:-1] |= same
    at = np.sort(order[busy])
    w, c, d, p = win[at], chk[at], rank[whose[at]], place[at]
    order = np.lexsort((p, d, c, w))
    w, c, d, p = w[order], c[order], d[order], p[order]
    # The place itself, where a key occurs twice, is not an earlier one.
    later = (w[1:] == w[:-1]) & (c[1:] == c[:-1]) & ((d[1:] != d[:-1]) | (p[1:] != p[:-1]))
    return np.sort(at[order[1:][later]])


def window_rows(docs: DataFrame, shards: list[tuple], length: int) -> DataFrame:
    """``data``: windows that share an anchor and lie side by side, as the hash bytes of
    each; or starts that are settled. In front stand the anchor, the document, a mark that
    tells them apart and the first start, so that rows sort by their bytes. A window that
    a batch holds twice is settled but for its first place."""

    def run(batches):
        hashes = WordHashes()
        reference = [Shard(*s) for s in shards]
        for batch in batches:
            for begin, end in runs(batch):
                ids, wins, checks, ancs, places, sizes, done = [], [], [], [], [], [], []
                for doc, text in zip(*columns(batch.slice(begin, end - begin))):
                    words = hashes.of(words_of(text))
                    anchors, at = window_anchors(words, length)
                    n = len(anchors)
                    if not n:
                        continue
                    keep = np.ones(n, bool)
                    for shard in reference:
                        keep[shard.settled(doc, words, anchors, at)] = False
                    if not keep.all():
                        done.append((doc, np.flatnonzero(~keep)))
                    starts = np.flatnonzero(keep)
                    wins.append(ngram_hashes(words, length)[starts])
                    second = ngram_hashes(mix64(words ^ SECOND), length)[starts]
                    checks.append((second >> np.uint64(56)).astype(np.uint8))
                    ancs.append(anchors[starts])
                    places.append(starts.astype(np.uint32))
                    ids.append(doc)
                    sizes.append(len(starts))
                if wins:
                    # Windows are many: few bytes each, and no list outlives its array.
                    win, chk, anc, place = (joined(parts) for parts in (wins, checks, ancs, places))
                    ids = np.array(ids, np.int64)
                    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
                    whose = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
                    gone = held_twice(win, chk, rank, whose, place)
                    if len(gone):
                        owner, start = ids[whose[gone]], place[gone]
                        at = np.flatnonzero(owner[1:] != owner[:-1]) + 1
                        done += [(int(d[0]), s) for d, s in zip(np.split(owner, at), np.split(start, at))]
                        first = np.ones(len(win), bool)
                        first[gone] = False
                        win, chk, anc, place, whose = (x[first] for x in (win, chk, anc, place, whose))
                    if len(win):
                        raw = np.empty((len(win), BYTES), np.uint8)
                        raw[:, :8], raw[:, 8] = win.view(np.uint8).reshape(-1, 8), chk
                        del win, chk
                        d = rank[whose]
                        new = np.r_[True, (anc[1:] != anc[:-1]) | (d[1:] != d[:-1]) | (place[1:] != place[:-1] + np.uint32(1))]
                        at = np.flatnonzero(new)
                        ends, raw = np.append(at[1:], len(raw)), memoryview(raw.reshape(-1))
                        for k in range(0, len(at), SENT):
                            a, b = at[k : k + SENT], ends[k : k + SENT].tolist()
                            front = heads(anc[a], ids[whose[a]], place[a].astype(np.int64) + MARK)
                            yield {"data": [h + raw[BYTES * x : BYTES * y] for h, x, y in zip(front, a.tolist(), b)]}
                if done:
                    anywhere = mix64(np.arange(len(done)))
                    front = heads(anywhere, np.array([d for d, _ in done], np.int64), np.zeros(len(done), np.int64))
                    yield {"data": [h + s.astype("<u4").tobytes() for h, (_, s) in zip(front, done)]}

    return map_batches(docs, "data binary", run)


def heads(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray) -> list[bytes]:
    rows = np.empty((len(doc), HEAD), np.uint8)
    rows[:, :KEY] = anchor.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]
    rows[:, KEY : KEY + 8] = (doc.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    rows[:, KEY + 8 :] = start.astype(">u4").view(np.uint8).reshape(-1, 4)
    raw = rows.tobytes()
    return [raw[k : k + HEAD] for k in range(0, len(raw), HEAD)]


def heads_read(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, whether rows hold windows, documents and starts."""
    rows = np.frombuffer(b"".join([d[:HEAD] for d in data]), np.uint8).reshape(-1, HEAD)
    anchor = np.zeros((len(rows), 8), np.uint8)
    anchor[:, :KEY] = rows[:, :KEY]
    doc = np.ascontiguousarray(rows[:, KEY : KEY + 8]).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
    start = np.ascontiguousarray(rows[:, KEY + 8 :]).view(">u4").ravel().astype(np.int64)
    return anchor.view("<u8").ravel(), start >= MARK, doc.view(np.int64), start & (MARK - 1)


def by_document(found: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """Documents and starts, a row a document."""
    doc, start = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
    raw, ends = start.astype("<u4").tobytes(), np.append(at[1:], len(doc)).tolist()
    return {"doc": doc[at], "starts": [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), ends)]}


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``doc, starts binary`` of windows that have an earlier equal one. All rows of an
    anchor meet in one partition in document order and are streamed; of an anchor that
    goes on in the next batch only the window hashes seen are carried."""

    def run(batches):
        last, found = None, []
        # Of the anchor that goes on: windows seen, and where each was first.
        seen = [np.empty(0, kind) for kind in (np.uint64, np.uint8, np.int64, np.int64)]
        for batch in batches:
            data = batch.column(0).to_pylist()
            anchor, mark, doc, start = heads_read(data)
            for k in np.flatnonzero(~mark).tolist():
                at = np.frombuffer(data[k][HEAD:], "<u4").astype(np.int64)
                found.append((np.full(len(at), doc[k]), at))
            rows_ = np.flatnonzero(mark)
            if not len(rows_):
                continue
            anchor, doc, start = anchor[rows_], doc[rows_], start[rows_]
            same = anchor[1:] == anchor[:-1]
            carried = last is not None and anchor[0] == last
            busy = np.zeros(len(rows_), bool)
            busy[1:] |= same
            busy[:-1] |= same
            busy |= (anchor == anchor[-1]) | (carried & (anchor == anchor[0]))
            sel = np.flatnonzero(busy)
            sizes = np.array([(len(data[k]) - HEAD) // BYTES for k in rows_[sel].tolist()])
            raw = np.frombuffer(b"".join([data[k][HEAD:] for k in rows_[sel].tolist()]), np.uint8).reshape(-1, BYTES)
            chk = np.ascontiguousarray(raw[:, 8])
            owner = np.repeat(np.arange(len(sel)), sizes)
            place = start[sel][owner] + np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            window = np.ascontiguousarray(raw[:, :8]).view(np.uint64).ravel()
            window = mix64(window ^ mix64(anchor[sel])[owner])
            d = doc[sel][owner]
            if not carried:
                seen = [x[:0] for x in seen]
            w, c, d_all, p_all = (np.append(x, y) for x, y in zip(seen, (window, chk, d, place)))
            order = np.lexsort((c, w))  # stable: what was seen first, then rows in document order
            again = (w[order[1:]] == w[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
            head = order[np.maximum.accumulate(np.where(np.r_[True, ~again], np.arange(len(w)), 0))]
            repeat = np.zeros(len(w), bool)
            # The place itself, where a key occurs twice, is not an earlier one.
            repeat[order] = (d_all[order] != d_all[head]) | (p_all[order] != p_all[head])
            fresh = np.zeros(len(w), bool)
            fresh[order[np.r_[True, ~again]]] = True
            n = len(seen[0])
            repeat, fresh = repeat[n:], fresh[n:]
            new = (anchor[sel][owner] == anchor[-1]) & fresh
            if not (carried and anchor[-1] == last):
                seen = [x[:0] for x in seen]
            seen = [np.append(x, y[new]) for x, y in zip(seen, (window, chk, d, place))]
            last = anchor[-1]
            found.append((d[repeat], place[repeat]))
            if sum(len(x) for x, _ in found) > HELD:
                yield by_document(found)
                found = []
        if found:
            yield by_document(found)

    ordered = rows.repartition(F.substring("data", 1, KEY)).sortWithinPartitions("data")
    return map_batches(ordered, "doc long, starts binary", run)


def reference_shards(docs: DataFrame, length: int, words: int = 60_000, docs_a_shard: int = 128) -> list[tuple]:
    """The first documents, up to ``words`` words, as the one shard that is kept small
    enough to travel; the grouping by anchor needs no shard to be right."""
    first = docs.where(F.length("text") <= 200_000).orderBy("doc").limit(docs_a_shard).collect()
    taken, n = [], 0
    for r in sorted(first, key=lambda r: r["doc"]):
        n += len(words_of(r["text"]))
        if n > words:
            break
        taken.append((r["doc"], r["text"]))
    return [(taken, length)] if taken else []


def remove_repeats(
    docs: DataFrame, length: int = 20, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """``key, n_words, n_removed, kept`` and the columns to ``keep`` (texts and whole
    numbers): the words of every text that no removed window covers, joined by single
    blanks.

    A null text has no words; texts shorter than a window, rows without a key and all
    texts of an empty table lose nothing. Rows that share a key are one document to the
    order: a window in both at the same place has no earlier one, and what is removed is
    removed in both. Other columns do not matter. Windows are judged on the input."""
    kinds = dict(docs.dtypes)
    kept = [(f"_kept_{c}", kinds[c].replace("bigint", "long")) for c in keep]
    carried = [F.col(c).alias(name) for c, (name, _) in zip(keep, kept)]
    named = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), *carried)
    rows = named.select("doc", "text").where("doc IS NOT NULL AND text IS NOT NULL")
    removed = repeated_windows(window_rows(rows, reference_shards(rows, length), length))
    whole = named.withColumn("starts", F.lit(None).cast("binary"))
    spans = removed.select("doc", F.lit(None).cast("string").alias("text"), "starts")
    both = whole.where("doc IS NOT NULL").unionByName(spans, allowMissingColumns=True)
    both = both.select("doc", "text", "starts", *[name for name, _ in kept])
    ordered = both.repartition("doc").sortWithinPartitions("doc", F.col("starts").isNull())
    nameless = whole.select(*both.columns).where("doc IS NULL")

    def run(batches):
        current, starts = None, []
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                out: dict[str, list] = {"key": [], "n_words": [], "n_removed": [], "kept": []}
                out |= {name: [] for name, _ in kept}
                for doc, t, s, *others in zip(*columns(batch.slice(begin, 2000))):
                    if doc is None or doc != current:
                        current, starts = doc, []
                    if s is not None:
                        starts.append(np.frombuffer(s, "<u4"))
                        continue
                    words = words_of(t or "")
                    n = len(words)
                    if starts:
                        gone = np.zeros(n + 1, np.int64)
                        at = np.unique(np.concatenate(starts)).astype(np.int64)
                        at = at[at + length <= n]
                        gone[at] += 1
                        gone[at + length] -= 1
                        keep = np.cumsum(gone[:n]) == 0
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                    out["key"].append(doc)
                    for (name, _), value in zip(kept, others):
                        out[name].append(value)
                    out["n_words"].append(n)
                    out["n_removed"].append(n - len(words))
                    out["kept"].append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield out

    ddl = ", ".join(["key long, n_words long, n_removed long, kept string", *(f"{name} {kind}" for name, kind in kept)])
    out = map_batches(ordered, ddl, run).unionByName(map_batches(nameless, ddl, run))
    return out.select(
        F.col("key").alias(key), "n_words", "n_removed", "kept", *[F.col(name).alias(c) for c, (name, _) in zip(keep, kept)]
    )
