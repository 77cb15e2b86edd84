"""Byte-level BPE of whole Arrow batches.

A batch's texts are parted by looking at their bytes, and equal pieces become
one entry of a dictionary. Pieces not seen before are pre-split and go through the token
automaton in step; the ids of all pieces are kept in one array, from which a batch takes
its ids by place. No list is built for a text or a piece that was seen before."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.bpe_automaton import Automaton
from hazeline.llm.common import map_batches, spread

# White space beyond ASCII in UTF-8 (fixed value): its bytes, last one first.
WIDE_SPACE = [
    b"\x85\xc2", b"\xa0\xc2", b"\x80\x9a\xe1", b"\x9f\x81\xe2", b"\xaf\x80\xe2", b"\xa8\x80\xe2", b"\xa9\x80\xe2",
    *(bytes([k, 0x80, 0xE2]) for k in range(0x80, 0x8B)), b"\x80\x80\xe3",
]
SPACE, ALNUM, MARK, APOSTROPHE, WIDE = 1, 2, 3, 4, 5


def _kinds() -> np.ndarray:
    """Kind of each byte; 0 for control characters, around which nothing is decided."""
    kinds = np.full(256, WIDE, np.uint8)
    kinds[:0x80] = 0
    for k in range(0x21, 0x7F):
        kinds[k] = ALNUM if chr(k).isalnum() else APOSTROPHE if chr(k) == "'" else MARK
    kinds[[*range(0x09, 0x0E), 0x20]] = SPACE
    return kinds


KINDS = _kinds()


def _after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space beyond ASCII ends before each place."""
    padded = np.concatenate([np.zeros(3, np.uint8), data])
    found = np.zeros(len(at), bool)
    for space in WIDE_SPACE:
        found |= np.logical_and.reduce([padded[at + 2 - k] == b for k, b in enumerate(space)])
    return found


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin: at the texts' own bounds, and where every pre-split parts
    whatever stands around: before white space that follows another character, and
    between a letter or digit and a mark that is no apostrophe. White space, blanks and
    what they may be taken with stay on one side."""
    kind = KINDS[data]
    before, now = kind[:-1], kind[1:]
    mark = np.zeros(len(data) + 1, bool)
    mark[1:-1] = (now == SPACE) & (before >= ALNUM)
    mark[1:-1] |= ((now == MARK) & (before == ALNUM)) | ((now == ALNUM) & (before == MARK))
    unsure = np.flatnonzero((now == SPACE) & (before == WIDE)) + 1
    mark[unsure[_after_wide_space(data, unsure)]] = False
    mark[bounds] = True
    return np.flatnonzero(mark)


class BatchEncoder:
    """Encodes batches; pieces and words seen are kept, up to ``memo`` pieces at a time."""

    def __init__(self, tok: Automaton, memo: int = 400_000):
        self.tok, self.memo = tok, memo
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.words: dict[str, np.ndarray] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _keep(self, pieces: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        first, total = len(self.known), self.used + len(ids)
        if total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * total)
        self.ids[self.used : total] = ids
        if first + len(pieces) > len(self.at):
            size = 2 * (first + len(pieces))
            self.at, self.size = np.resize(self.at, size), np.resize(self.size, size)
        self.at[first : first + len(pieces)] = self.used + np.cumsum(n) - n
        self.size[first : first + len(pieces)] = n
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.used = total

    def _learn(self, pieces: list[bytes]) -> None:
        """Letters behind at most one blank are one word; all else is pre-split."""
        plain, rest = [], []
        for p in pieces:
            text = p.decode("utf-8", "surrogatepass")
            (plain if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()) else rest).append((p, text))
        if plain:
            whole = [p for p, _ in plain]
            self._keep(whole, *self.tok.run(whole))
        if rest:
            split = [self.tok.words(text) for _, text in rest]
            new = list({w for words in split for w in words} - self.words.keys())
            if new:
                ids, n = self.tok.run([w.encode("utf-8", "surrogatepass") for w in new])
                self.words.update(zip(new, np.split(ids.astype(np.uint32), np.cumsum(n)[:-1])))
            known = self.words.__getitem__
            parts = [[known(w) for w in words] for words in split]
            n = np.array([sum(map(len, p)) for p in parts], np.int64)
            flat = [x for p in parts for x in p]
            self._keep([p for p, _ in rest], np.concatenate([np.empty(0, np.uint32), *flat]), n)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an array of strings without nulls), one after the other, and
        how many each text has. Special strings are plain text, unless the automaton
        knows some: then texts that hold any are cut at them."""
        special = self.tok.special
        held = np.zeros(len(texts), bool)
        for s in special:
            held |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not held.any():
            return self._plain(texts)
        parts, owner, fixed = [], [], []
        for k, (text, cut) in enumerate(zip(texts.to_pylist(), held.tolist())):
            for p in self.tok.split_special.split(text) if cut else [text]:
                parts.append("" if cut and p in special else p)
                fixed.append(special[p] if cut and p in special else -1)
                owner.append(k)
        ids, n = self._plain(pa.array(parts, pa.large_string()))
        # A special id stands at the end of its own, empty part.
        there = np.flatnonzero(np.array(fixed) >= 0)
        ids = np.insert(ids, np.cumsum(n)[there], np.array(fixed)[there])
        n[there] = 1
        return ids, np.bincount(owner, n, len(texts)).astype(np.int64)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.memo or len(self.words) > self.memo:
            self.forget()
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        starts = cuts(data, bounds)  # ends with the end of the data
        spans = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]
        )
        pieces = spans.dictionary_encode()
        names = pieces.dictionary.to_pylist()
        found = list(map(self.known.get, names))
        new = [p for p, k in zip(names, found) if k is None]
        if new:
            self._learn(new)
            found = list(map(self.known.__getitem__, names))
        place = np.array(found, np.int64)[pieces.indices.to_numpy()]
        sizes = self.size[place]
        ids = self.ids[spread(self.at[place], sizes)]
        ends = np.r_[0, np.cumsum(sizes)]
        return ids, np.diff(ends[np.searchsorted(starts, bounds)])


_ENCODERS: dict[str, BatchEncoder] = {}


def batch_encoder(path: str) -> BatchEncoder:
    """The encoder of a file, compiled once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(Automaton(path))
    return _ENCODERS[path]


class Labels:
    """The bytes of all tokens of a vocabulary."""

    def __init__(self, labels: dict[int, bytes]):
        size = max(labels) + 1
        parts = [labels.get(i, b"") for i in range(size)]
        self.size = np.fromiter(map(len, parts), np.int64, size)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.marked = np.fromiter((p[:1] == b" " for p in parts), bool, size)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of tokens, one after the other."""
        return self.data[spread(self.at[ids], self.size[ids])]


def in_runs(texts: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes."""
    run = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // size
    stops = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(stops, stops[1:]) if a < b)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<long>`` of every document; a null text counts as empty. A narrow
    pass: repeated keys, null keys and any other columns do not matter, and an empty
    table gives no rows."""

    def run(batches):
        encoder = batch_encoder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for s, e in in_runs(texts):
                ids, n = encoder(texts.slice(s, e - s))
                stops = np.r_[0, np.cumsum(n)].astype(np.int32)
                yield {"key": batch.column(0).slice(s, e - s), "ids": pa.ListArray.from_arrays(stops, pa.array(ids.astype(np.int64)))}

    return map_batches(_texts(docs, key, text), "key long, ids array<long>", run).withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` of rows of ids; the inverse of ``encode``. Null ids give ''."""

    def run(batches):
        label = batch_encoder(path).tok.label
        for batch in batches:
            keys, rows = batch.column(0), batch.column(1).to_pylist()
            yield {"key": keys, "text": [b"".join([label[i] for i in r or ()]).decode("utf-8", "replace") for r in rows]}

    rows = encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids"))
    return map_batches(rows, "key long, text string", run).withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every document and return only digests of both: ``key,
    n_tokens, ids_sha256, decoded_sha256``. Texts are decoded from the ids. Nulls, ties
    and other columns as in ``encode``."""

    def run(batches):
        encoder = batch_encoder(path)
        labels = Labels(encoder.tok.label)
        written = list(map(str, range(len(labels.size))))
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for s, e in in_runs(texts):
                ids, n = encoder(texts.slice(s, e - s))
                stops = np.r_[0, np.cumsum(n)]
                data = labels.bytes_of(ids).tobytes()
                at = np.r_[0, np.cumsum(labels.size[ids])][stops].tolist()
                parts, stops = list(map(written.__getitem__, ids.tolist())), stops.tolist()
                back = [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(at, at[1:])]
                yield {
                    "key": batch.column(0).slice(s, e - s),
                    "n_tokens": n,
                    "ids_sha256": [sha(",".join(parts[a:b]).encode()) for a, b in zip(stops, stops[1:])],
                    "decoded_sha256": list(map(sha, back)),
                }

    ddl = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(_texts(docs, key, text), ddl, run).withColumnRenamed("key", key)
