"""The alignment of two tokenizers against the libraries and plain Python."""

import hashlib
import json
import random
from collections import Counter

import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hazeline.llm import alignment
from hazeline.llm.bpe_automaton import byte_letters
from hazeline.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES

SCHEMA = "doc_id long, text string, row long, links string, n_a int, counts boolean, key string"


class Libraries:
    def __init__(self):
        self.a = Tokenizer.from_file(BYTE_BPE)
        self.a.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
        with open(BYTE_BPE, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.label = {i: bytes(byte[c] for c in s) if all(c in byte for c in s) else b"?" for s, i in vocab.items()}

    def piece(self, i):
        if self.sp.is_byte(i):
            return bytes([int(self.sp.id_to_piece(i)[3:-1], 16)])
        return self.sp.id_to_piece(i).encode().replace("▁".encode(), b" ")

    def groups(self, text):
        """Groups of ids of A and B of a text, cut at every byte where both end."""
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.sp.encode(text)
        la, lb = [self.label[i] for i in a], [self.piece(i) for i in b]
        if not b"".join(la) == b"".join(lb) == (" " + text).encode():
            return []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ea, eb = ends(la), ends(lb)
        cuts, out, low = sorted(set(ea) & set(eb)), [], 0
        for c in cuts:
            out.append(([i for i, e in zip(a, ea) if low < e <= c], [i for i, e in zip(b, eb) if low < e <= c]))
            low = c
        return out


def brute(docs):
    lib = Libraries()
    found = [(i, lib.groups(t)) for i, t in docs]
    count = Counter((a[-1], b[-1]) for _, g in found for a, b in g)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, groups in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append(
            (
                i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                hashlib.sha256(text.encode()).hexdigest() if text else "",
            )
        )
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    words = "the of and tokenization aligned naïve Zürich 日本 😀 x1 3.14 don't HELLO hello ñandú <s> </s> <0x0A>".split()
    texts = [rng.choice([" ", "  ", "\n", " \t "]).join(rng.choices(words, k=rng.choice([1, 5, 40]))) for _ in range(60)]
    texts += [None, "", " ", "   ", "\n\n ", "▁x", "a▁b", "<|endoftext|> and <unk>", "\0 a\0b", "a" * 700, texts[0], texts[0]]
    texts += ["é ﻿​ 　x", " lead", "trail ", "\r\n", "the " * 300]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "the of"), (3, "again"), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "l", 2, True, "k") for i, t in rows], SCHEMA).repartition(3)


def rows_of(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def test_alignment(spark):
    want = brute(corpus())
    assert rows_of(alignment.align(frame(spark, corpus()), BYTE_BPE, PIECE_BPE)) == want
    by_join = alignment.align(frame(spark, corpus()), BYTE_BPE, PIECE_BPE, in_memory=0, keep_groups=True)
    assert rows_of(by_join) == want
    for r in by_join.collect():
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256
    assert sum(r[1] == 0 for r in want) >= 5


def test_windows_are_forgotten(spark, monkeypatch):
    """With room for a few windows only, counts come in several parts."""
    real = alignment.Aligner
    monkeypatch.setattr(alignment, "_LOADED", {})
    monkeypatch.setattr(alignment, "aligner", lambda a, b: real(a, b, memo=7))
    monkeypatch.setattr(alignment.in_runs, "__defaults__", (60,))
    both = alignment.aligner(BYTE_BPE, PIECE_BPE)
    texts = [t or "" for _, t in corpus()]
    whole = pa.array(texts)
    total, windows = Counter(), 0
    for s, e in alignment.in_runs(whole):
        if len(both.known) > both.memo:
            total.update(dict(zip(*(x.tolist() for x in both.counted()))))
            both.forget()
        _, _, found, n = both.windows(whole.slice(s, e - s))
        both.count(found)
        windows += n.sum()
        n_links, links, times, different = both.links_of(found, n)
        assert n_links.sum() == times.sum() and different.sum() == len(links)
    total.update(dict(zip(*(x.tolist() for x in both.counted()))))
    lib = Libraries()
    assert total == Counter(a[-1] << 32 | b[-1] for t in texts for a, b in lib.groups(t))


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, "")]):
        assert rows_of(alignment.align(frame(spark, rows), BYTE_BPE, PIECE_BPE)) == brute(rows)


LETTERS = st.text(alphabet=st.sampled_from("aethn is'1\n\t.▁é日😀<|>　"), max_size=40)
LIB = Libraries()


@settings(max_examples=60, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=6))
def test_groups_equal_the_libraries(texts):
    both = alignment.aligner(BYTE_BPE, PIECE_BPE)
    n_a, n_b, windows, n = both.windows(pa.array(texts))
    at = 0
    for t, x, y, k in zip(texts, n_a.tolist(), n_b.tolist(), n.tolist()):
        groups = LIB.groups(t)
        got = "".join(both.groups[w] for w in windows[at : at + k].tolist())[:-1]
        assert got == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        assert (x, y) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups))
        at += k


def test_windows_are_tokenized_once(monkeypatch):
    """A window that was seen before costs neither tokenizer anything."""
    both = alignment.Aligner(BYTE_BPE, PIECE_BPE)
    real, given_ = both.tokens, []
    monkeypatch.setattr(both, "tokens", lambda closed: given_.extend(closed.to_pylist()) or real(closed))
    texts = ["the of the  of", "naïve of\u3000 the", "", "a▁b of"]
    first = both.windows(pa.array(texts))
    assert sorted(given_) == sorted([" the", " of", " the  of", " naïve", " of\u3000 the", " ", " a▁b"])
    again = both.windows(pa.array(texts[::-1]))
    assert len(given_) == 7
    assert [x.tolist() for x in again[:2]] == [x.tolist()[::-1] for x in first[:2]]
    assert first[3].tolist() == [len(first[2]) - 2, 2, 0, 0]


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(QUERIES["op12_alignment"](spark, sf)) == brute(docs)
