"""The decontamination operator against plain Python over all windows."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
import xxhash

from check import compare, duck
from hazeline.llm import decontamination
from hazeline.llm.decontamination import Words

DOCS = "doc_id long, text string, item_id long, items string, n_words int, window string, digest string"
ITEMS = "item_id long, text string, doc_id long, hash string, key string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, length=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(length, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        names = sorted(str(i) for i in found if i is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    some = lambda n, k=9: [rng.choice("abcdefghi"[:k]) + rng.choice(["", "é", "7"]) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 3, 4, 5, 9, 10, 11, 30])))) for i in range(40)]
    items += [(3, " ".join(some(20))), (None, " ".join(some(25))), (70, items[-1][1]), (71, None), (72, ""), (73, " ,;\n")]
    items += [(80, items[7][1]), (81, items[7][1].upper()), (82, "日本 語"), (83, "x" * 70000 + " tail")]
    docs = []
    for i in range(120):
        text = some(rng.choice([0, 1, 8, 9, 10, 40]), rng.choice([3, 9]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            part = words_of(rng.choice(items)[1])
            cut = rng.choice([part, part[1:], part[:10], part[3:]])
            k = rng.randrange(len(text) + 1)
            text = text[:k] + cut + text[k:]
        docs.append((i, rng.choice([" ", ", ", "\n-\t"]).join(w.upper() if rng.random() < 0.2 else w for w in text)))
    docs += [(500, None), (501, ""), (502, "!?\0 "), (7, docs[7][1]), (7, docs[8][1]), (None, docs[9][1]), (None, None)]
    docs += [(503, "y " * 30000 + (items[12][1] + " ") * 400), (504, "x" * 70000 + " TAIL end"), (505, "pre日本 語"), (506, "日本-語.")]
    return docs, items


def frames(spark, docs, items):
    extra = (3, "i", 4, "w", "d")
    return (
        spark.createDataFrame([(*d, *extra) for d in docs], DOCS).repartition(3),
        spark.createDataFrame([(*i, 3, "h", "k") for i in items], ITEMS).repartition(2),
    )


@pytest.mark.parametrize("block", [500_000, 90])
def test_decontamination(spark, block):
    docs, items = corpus()
    found = decontamination.scan(*frames(spark, docs, items), block=block)
    got = sorted(map(tuple, decontamination.report(found).collect()), key=str)
    assert got == brute(docs, items)
    assert sum(r[-1] for r in got) > 40
    for r in found.where("doc_id < 120").collect():
        assert all(0 <= a < b <= r.n_words for a, b in zip(r.begins, r.ends))


@pytest.mark.parametrize("length", [1, 4, 23])
def test_window_lengths(spark, length):
    docs, items = corpus(length)
    found = decontamination.scan(*frames(spark, docs, items), length=length)
    assert sorted(map(tuple, decontamination.report(found).collect()), key=str) == brute(docs, items, length)


def test_empty_tables(spark):
    docs, items = corpus()
    for d, i in (([], items), (docs, []), ([], []), (docs, [(1, None), (2, " ")])):
        got = decontamination.report(decontamination.scan(*frames(spark, d, i))).collect()
        assert sorted(map(tuple, got), key=str) == brute(d, i)


def test_words_and_hashes(monkeypatch):
    texts = ["One, two\n", "\n", "é1 a" + "b" * 90 + " c\n", "a" * 300 + " One\n", "\n"]
    whole = Words(pa.array(texts, pa.large_string()))
    assert [whole.text_of(a, b) for a, b in zip(whole.first, whole.first[1:])] == [
        b"".join(w.encode() + b"\0" for w in words_of(t)) for t in texts
    ]
    hashes = whole.hashes()
    assert hashes[0] == hashes[-1] and len(set(hashes.tolist())) == len(hashes) - 1
    alone = [Words(pa.array([w + "\n"], pa.large_string())).hashes()[0] for t in texts for w in words_of(t)]
    assert alone == hashes.tolist()
    monkeypatch.setattr(decontamination, "STEP", 7)
    monkeypatch.setattr(decontamination, "LONG", 100)
    monkeypatch.setattr(decontamination, "_POWERS", [])
    again = Words(pa.array(texts, pa.large_string())).hashes()
    assert again[:-2].tolist() == hashes[:-2].tolist() and again[-1] == hashes[-1]
    assert again[-2] == xxhash.xxh3_64_intdigest(b"a" * 300 + b"\0")


def test_places_are_compared_in_parts(spark, monkeypatch):
    """Many windows on one prefix, cut into steps of a few pairs and bytes."""
    monkeypatch.setattr(decontamination, "PAIRS", 5)
    base = "r1 r2 r3 r4 r5".split()
    items = [(k, " ".join(base + [f"w{k % 9}", f"v{k // 9}"])) for k in range(60)]
    docs = [(k, " ".join(["z"] * k + base + [f"w{k % 9}", f"v{k // 9}", "z"])) for k in range(70)]
    d, i = frames(spark, docs, items)
    rows = decontamination.prefixes(d, decontamination.item_windows(i), "text", 10)
    pairs = rows.join(decontamination.item_windows(i).select("window", "item"), "window").collect()
    block = decontamination.Block.of(pairs)
    words = Words(pa.array([t + "\n" for _, t in docs], pa.large_string()))
    n, begins, ends, found = block.hits(words)
    want = brute(docs, items)
    got = [(k, a, sum(e - b for b, e in zip(bs, es)), len(f)) for k, (a, bs, es, f) in enumerate(zip(n, begins, ends, found))]
    assert sorted(got, key=str) == [r[:4] for r in want]


def test_query_equals_sql(spark, sf):
    ok, note = compare(spark, duck(sf), "op13_decontamination", sf)
    assert ok, note
