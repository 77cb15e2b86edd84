"""BPE encoding and decoding by a tokenization automaton.

The merges of a byte-level BPE vocabulary are compiled, in their order, into a
deterministic automaton over tokens that accepts exactly the correct tokenizations of a
word. It starts as one state with a loop on every byte. The gadget of the merge
``(u, v)`` adds an arc on ``uv`` wherever ``u`` and then ``v`` could be read, and takes
the arc on ``v`` away after ``u``. What may follow a token then depends on that token
only, so a state is named by the token last read, and an arc ``p -> t`` is gone exactly
when the gadget of some merge ``(u, v)`` came while ``u`` still ended ``p`` and ``v``
still began ``t``. The compiled table keeps, per token, its right and left edge with the
rank at which each part was absorbed; arcs are read off these edges and then kept.

A word has one accepted path. Its transitions are tables (``token_table``), and the
pre-split words of many texts go through them in step (``batch_encoder`` does so for whole
batches). Decoding emits the arc labels, the bytes of the tokens."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import regex

from hazeline.llm.token_table import TokenTable

#: Pre-tokenization of byte-level vocabularies (fixed value).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: a
    printable byte stands for itself, the others for the letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Automaton:
    """The compiled merges of a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        label = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.label: dict[int, bytes] = {i: label(s) for s, i in vocab.items()}
        self.token: dict[bytes, int] = {b: i for i, b in self.label.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            u, v, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[u, v] = rank
            self.parts.setdefault(whole, (u, v, rank))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.pre_split = regex.compile(PRE_SPLIT).findall
        self.stands: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        standing = [(data, t) for data, t in self.token.items() if self._stands(t)]
        self.table = TokenTable(standing, self.follows)

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts along one edge of a token (0: right, 1: left), each with the rank
        of the gadget that absorbed it; the token itself is never absorbed."""
        found = self.edges[side].get(token)
        if found is None:
            found, part = [(token, float("inf"))], token
            while part in self.parts:
                u, v, rank = self.parts[part]
                part = u if side else v
                found.append((part, rank))
            self.edges[side][token] = found
        return found

    def follows(self, p: int, t: int) -> bool:
        """Whether the automaton has the arc on ``t`` in the state after ``p``."""
        return self._apart(p, t, float("inf"))

    def _stands(self, token: int) -> bool:
        """Whether a token's own bytes are tokenized as the token: both its parts are,
        and no gadget came between them before its own."""
        found = self.stands.get(token)
        if found is None:
            parts = self.parts.get(token)
            if parts is None:
                found = len(self.label[token]) == 1
            else:
                u, v, rank = parts
                found = self._stands(u) and self._stands(v) and self._apart(u, v, rank)
            self.stands[token] = found
        return found

    def _apart(self, p: int, t: int, before: float) -> bool:
        """Whether no gadget of a rank below ``before`` joins the end of ``p`` to the
        start of ``t``. With equal ranks the pair further left goes first."""
        rank = self.rank
        for v, until_v in self.edge(t, 1):
            for u, until_u in self.edge(p, 0):
                r = rank.get((u, v))
                if r is not None and r < before and r < until_u and r <= until_v:
                    return False
        return True

    def run(self, strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-split strings, all in step: one after the other, and how many
        each has."""
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        return self.table.run(np.frombuffer(b"".join(strings), np.uint8), sizes)

    def words(self, text: str) -> list[str]:
        """Pre-split of a text without special strings."""
        return self.pre_split(text)
