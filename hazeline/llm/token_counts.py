"""Token counts by a compiled finite-state tokenizer.

The pieces of a BPE model with byte fallback are compiled into a deterministic
transducer whose transitions carry the number of tokens they emit (``token_table`` keeps
its tables). A chunk of text acts on it as a state map: whatever state the chunk is
entered in, after the first token boundary that every tokenization must have, the rest
of the chunk goes the same way. A boundary of that kind stands before each blank that
follows another character, since no piece holds a blank behind one. So a chunk's map is
written down as its head up to the first such boundary, the tokens counted between, and
its tail after the last one, or as one open string where it has no boundary. Maps compose
by counting where a tail meets the next head, which is associative; documents are cut
into chunks, every chunk is mapped on its own, and a scan over the chunks of a document
composes them."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import columns, map_batches
from hazeline.llm.token_table import TokenTable

BLANK = "▁"  # what stands for a blank in the pieces (fixed value)


class Counter:
    """Counts the tokens of a ``sentencepiece`` BPE model with byte fallback, identity
    normalization and a blank put before the text. Counts of up to ``memo`` strings
    between blanks are remembered."""

    def __init__(self, path: str, memo: int = 800_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        pieces = [i for i in range(sp.get_piece_size()) if not special(i)]
        self.piece = {i: sp.id_to_piece(i) for i in pieces}
        if any(BLANK in p.lstrip(BLANK) for p in self.piece.values()):
            raise ValueError("a piece holds a blank behind another character")
        order = sorted(pieces, key=lambda i: (-sp.get_score(i), i))
        self.rank = {self.piece[i]: r for r, i in enumerate(order)}
        self.edges: dict[tuple[str, int], list[tuple[str, float, float]]] = {}
        self.parts: dict[str, tuple[str, str] | None] = {}
        standing = [i for i in pieces if len(self.piece[i]) == 1 or self._split(self.piece[i])]
        self.symbol = np.full(0x110000, -1, np.int32)
        singles = sorted(p for p in self.rank if len(p) == 1)
        for k, p in enumerate(singles):
            self.symbol[ord(p)] = k
        self.blank = int(self.symbol[ord(BLANK)])
        tokens = [([int(self.symbol[ord(c)]) for c in self.piece[i]], i) for i in standing]
        self.table = TokenTable(tokens, self._follows)
        self.known: dict[str, int] = {}
        self.memo = memo

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes the piece when it is encoded by itself."""
        if piece not in self.parts:
            rank, last = self.rank, None
            parts: list[str | None] = list(piece)
            right = [*range(1, len(parts)), -1]
            left = [-1, *range(len(parts) - 1)]
            todo = [(rank[p], k) for k, p in enumerate(a + b for a, b in zip(piece, piece[1:])) if p in rank]
            heapq.heapify(todo)
            while todo:
                r, k = heapq.heappop(todo)
                n = right[k] if parts[k] is not None else -1
                if n < 0 or rank.get(parts[k] + parts[n]) != r:
                    continue
                last = (parts[k], parts[n])
                parts[k], parts[n] = parts[k] + parts[n], None
                right[k] = right[n]
                if right[n] >= 0:
                    left[right[n]] = k
                for a, b in ((left[k], k), (k, right[k])):
                    if a >= 0 and b >= 0 and parts[a] + parts[b] in rank:
                        heapq.heappush(todo, (rank[parts[a] + parts[b]], a))
            self.parts[piece] = last if parts[0] == piece else None
        return self.parts[piece]

    def _born(self, piece: str) -> float:
        """When a piece is there: not before its parts."""
        parts = self._split(piece) if len(piece) > 1 else None
        return max(self.rank[piece], self._born(parts[0]), self._born(parts[1])) if parts else -1

    def _edge(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """Parts along one edge (0: right, 1: left): when each is there and absorbed."""
        found = self.edges.get((piece, side))
        if found is None:
            found, part, until = [], piece, float("inf")
            while True:
                born = self._born(part)
                found.append((part, born, until))
                parts = self._split(part) if len(part) > 1 else None
                if parts is None:
                    break
                part, until = parts[0] if side else parts[1], born
            self.edges[piece, side] = found
        return found

    def _follows(self, p: int, t: int) -> bool:
        rank = self.rank
        for v, born_v, until_v in self._edge(self.piece[t], 1):
            for u, born_u, until_u in self._edge(self.piece[p], 0):
                r = rank.get(u + v)
                if r is not None:
                    at = max(r, born_u, born_v)
                    if at < until_u and at <= until_v:
                        return False
        return True

    def _learn(self, strings: Iterable[str]) -> None:
        """Counts of strings, each with a blank before it, all in step."""
        new = list(strings)
        if not new:
            return
        text = np.frombuffer((" " + " ".join(new)).encode("utf-32-le", "surrogatepass"), np.uint32)
        whose = np.repeat(np.arange(len(new)), [len(s) + 1 for s in new])
        symbols = self.symbol[text]
        begin = np.empty(len(text), bool)
        begin[0] = True
        begin[1:] = whose[1:] != whose[:-1]
        symbols[begin] = self.blank
        # A blank inside a string, which only whole runs have, is one as well.
        symbols[text == 32] = self.blank
        counts = np.zeros(len(new), np.int64)
        odd = np.flatnonzero(symbols < 0)
        if len(odd):
            code = text[odd]
            size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            np.add.at(counts, whose[odd], size)
            begin[np.minimum(odd + 1, len(text) - 1)] = True
            keep = symbols >= 0
            # A part that starts at an odd symbol starts behind it instead.
            group = np.cumsum(begin)[keep]
            symbols, whose = symbols[keep], whose[keep]
        else:
            group = np.cumsum(begin)
        if len(symbols):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[first, len(group)])
            _, n = self.table.run(symbols, sizes)
            np.add.at(counts, whose[first], n)
        self.known.update(zip(new, counts.tolist()))

    def units(self, text: str) -> list[str]:
        """What stands between boundaries, each without its first blank. The text must
        begin with a blank that is a boundary."""
        units, run = text[1:].split(" "), ""
        if "" not in units:
            return units
        out = []
        for k, u in enumerate(units):
            if u or k == len(units) - 1:
                out.append(run + u)
                run = ""
            else:
                run += " "
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of strings that begin with a boundary blank; of '' none."""
        units = [self.units(t) if t else [] for t in texts]
        if len(self.known) > self.memo:
            self.known = dict(list(self.known.items())[: self.memo // 2])
        self._learn(set().union(*units) - self.known.keys())
        known = self.known.__getitem__
        return [sum(map(known, u)) for u in units]


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def first_boundary(chunk: str) -> int:
    """Place of the first blank behind a character that is not one, or -1."""
    k = 0
    while (k := chunk.find(" ", k)) >= 0:
        if k and chunk[k - 1] != " ":
            return k
        k += 1
    return -1


def last_boundary(chunk: str) -> int:
    k = len(chunk)
    while (k := chunk.rfind(" ", 0, k)) > 0:
        if chunk[k - 1] != " ":
            return k
    return -1


def chunk_maps(chunks: DataFrame, path: str) -> DataFrame:
    """State map of every chunk of ``key, part, n_bytes, chunk``: ``head, n, tail`` with n
    null where the chunk has no boundary (then it is all head)."""

    def run(batches):
        count = counter(path).count
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                keys, parts, sizes, texts = columns(batch.slice(at, 2000))
                heads, inner, tails = [], [], []
                for t in texts:
                    t = t.replace(BLANK, " ")  # both are the same symbol
                    a = first_boundary(t)
                    b = last_boundary(t) if a >= 0 else -1
                    heads.append(t if a < 0 else t[:a])
                    tails.append("" if a < 0 else t[b:])
                    inner.append("" if a < 0 else t[a:b])
                n = [None if not tail else k for k, tail in zip(count(inner), tails)]
                yield {"key": keys, "part": parts, "n_bytes": sizes, "head": heads, "n": n, "tail": tails}

    ddl = "key long, part int, n_bytes long, head string, n long, tail string"
    return map_batches(chunks, ddl, run)


def compose(maps: DataFrame, path: str) -> DataFrame:
    """Scan over the state maps of each document, from the start state: ``key, n_bytes,
    n_tokens``. Rows arrive by document and part; only the open tail is carried on."""

    def run(batches):
        count = counter(path).count
        current, size, total, open_ = None, 0, 0, ""
        for batch in batches:
            done: dict[str, list] = {"key": [], "n_bytes": [], "n_tokens": []}
            owners: list[int] = []  # of the strings to be counted: places in done
            strings: list[str] = []

            def close():
                done["key"].append(current)
                done["n_bytes"].append(size)
                done["n_tokens"].append(total)
                strings.append(open_)
                owners.extend([len(done["key"]) - 1] * (len(strings) - len(owners)))

            for key, _, n_bytes, head, n, tail in zip(*columns(batch)):
                if current is not None and key != current:
                    close()
                    size, total, open_ = 0, 0, ""
                current, size, open_ = key, size + n_bytes, open_ + head
                if n is not None:
                    strings.append(open_)
                    total, open_ = total + n, tail
            counts = count(strings)
            for k, c in zip(owners, counts):
                done["n_tokens"][k] += c
            total += sum(counts[len(owners) :])
            yield done
        if current is not None:
            yield {"key": [current], "n_bytes": [size], "n_tokens": [total + count([open_])[0]]}

    ordered = maps.repartition("key").sortWithinPartitions("key", "part")
    return map_batches(ordered, "key long, n_bytes long, n_tokens long", run)


def token_counts(
    docs: DataFrame, path: str, limit: int = 4096, chunk_chars: int = 1 << 16, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every document.

    A null text counts as empty. Keys must be unique and not null for one row per
    document: rows that share a key are read as one text in no certain order, rows
    without a key are left out. Other columns do not matter, an empty table gives no
    rows. Long texts are cut into chunks before Python sees them, and their chunks are
    spread over all tasks; texts of one chunk stay where they are."""
    rows = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")
    )
    size = F.length("t")
    head = F.when(size > 0, F.concat(F.lit(" "), F.substring("t", 1, chunk_chars))).otherwise("")
    n_bytes = lambda c: F.octet_length(c).cast("long").alias("n_bytes")
    short = rows.select("key", F.lit(0).alias("part"), n_bytes(F.substring("t", 1, chunk_chars)), head.alias("chunk"))
    later = F.sequence(F.lit(1), F.floor((size - 1) / chunk_chars).cast("int"))
    rest = (
        rows.where(size > chunk_chars)
        .select("key", "t", F.explode(later).alias("part"))
        .select("key", "part", F.expr(f"substring(t, part * {chunk_chars} + 1, {chunk_chars})").alias("chunk"))
        .repartition("key", "part")
        .select("key", "part", n_bytes("chunk"), "chunk")
    )
    return compose(chunk_maps(short.unionByName(rest), path), path).select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
