"""Each operator against brute force or the public library, on rows with nulls, empty and
long texts, ties, repeats and columns with clashing names, and on empty tables."""

import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hazeline.llm import (
    batch_encoder,
    embedding_dedup,
    imatch,
    language_id,
    licenses,
    mixing,
    ngram_join,
    substring_dedup,
    token_counts,
    token_files,
)
from hazeline.llm.common import components
from hazeline.llm.queries import BYTE_BPE, PIECE_BPE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, doc int, kind int"
SYLLABLES = "ba ce di fo gu la me ni or pu ra se ti vo".split()


def passage(rng, n):
    return [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(["", ".", "s"]) for _ in range(n)]


def corpus():
    rng = random.Random(4)
    base = [passage(rng, rng.choice([3, 30, 60, 140])) for _ in range(24)]
    shared = passage(rng, 45)
    texts = [" ".join(w) for w in base]
    texts += [" ".join(w[:50] + ["changed"] + w[51:]) for w in base if len(w) > 100]
    texts += [" ".join(passage(rng, 20) + shared + passage(rng, 9)) for _ in range(5)]
    texts += [texts[1], texts[1], None, "", " \n\t ", "one", "ONE", "é 日本 😀  <|endoftext|> ▁x", "12 34", "a" * 3000]
    texts += [" ".join(shared[:25] * 3), "x y z " * 2000]
    return [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2"][i % 3], 7, i, "k", 0, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def texts_of():
    return {r[0]: r[1] for r in corpus()}


def test_token_counts(docs, nothing):
    got = rows_of(token_counts.token_counts(docs, PIECE_BPE, limit=100, chunk_chars=37))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    want = {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in texts_of().items()}
    assert got == {i: (b, n, n > 100) for i, (b, n) in want.items()}
    assert token_counts.token_counts(nothing, PIECE_BPE).count() == 0


LETTERS = st.text(alphabet=st.sampled_from("aethn is'1\n\t.▁é日😀<|>　"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=6))
def test_counter_equals_sentencepiece(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    count = token_counts.counter(PIECE_BPE).count
    assert count([" " + t.replace("▁", " ") if t else "" for t in texts]) == [len(x) for x in sp.encode(texts)]


def test_bpe_automaton(docs, nothing):
    lib = Tokenizer.from_file(BYTE_BPE)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in texts_of().items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(x), sha(",".join(map(str, x))), sha(texts_of()[i] or "")) for i, x in ids.items()}
    assert rows_of(batch_encoder.digests(docs, BYTE_BPE)) == want
    encoded = batch_encoder.encode(docs, BYTE_BPE)
    assert {i: r[0] for i, r in rows_of(encoded).items()} == ids
    assert {i: r[0] for i, r in rows_of(batch_encoder.decode(encoded, BYTE_BPE)).items()} == {
        i: t or "" for i, t in texts_of().items()
    }
    assert batch_encoder.digests(nothing, BYTE_BPE).count() == 0


def test_token_files(spark, docs, nothing, tmp_path):
    lib = Tokenizer.from_file(BYTE_BPE)
    token_files.write(docs, str(tmp_path / "t"), BYTE_BPE, end_id=0, segment_ids=200)
    got = rows_of(token_files.read(str(tmp_path / "t"), spark))
    start = 0
    for i, t in sorted(texts_of().items()):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert got[i] == (start, len(ids), crc, ids)
        start += len(ids)
    token_files.write(nothing, str(tmp_path / "e"), BYTE_BPE, end_id=0)
    assert token_files.read(str(tmp_path / "e"), spark).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    ef = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert ef.all().tolist() == values
    for k in range(0, len(values), 97):
        assert ef.select(k).tolist() == [values[k]]


def test_license_scan(spark):
    files = spark.createDataFrame(
        [
            ("h/a/LICENSE", "x\nReleased under the MIT License.\ny", 1),
            ("h/a/b/f", "no such line", 1),
            ("h/a/b/g", "Licensed under CC BY-NC 4.0.", 1),
            ("h/a/b/g", "Licensed under CC BY-NC 4.0.", 1),
            ("h/z", None, 1), (None, "Released under the MIT License.", 1), ("h/ab/q", "", 1),
        ],
        "path string, text string, score int",
    )
    got = rows_of(licenses.scan(files, speaks=files["path"].endswith("LICENSE")))
    assert got["h/a/LICENSE"] == ("MIT", 1.0, "MIT", None)
    assert got["h/a/b/f"] == (None, None, "MIT", "h/a")
    assert got["h/a/b/g"][0] == "CC-BY-NC-4.0" and len(got) == 6
    assert got["h/z"] == got["h/ab/q"] == (None, None, None, None) and got[None][0] == "MIT"
    assert licenses.scan(files.limit(0)).count() == 0


def test_license_templates_tell_apart(spark):
    lines = [(f"d{k}/{name}", t) for name, ts in licenses.TEMPLATES.items() for k, t in enumerate(ts)]
    got = rows_of(licenses.scan(spark.createDataFrame(lines, "path string, text string")))
    assert {p: r[0] for p, r in got.items()} == {p: p.split("/")[1] for p, _ in lines}


def test_mixing(docs, nothing):
    got = rows_of(mixing.mix(docs, shards=4))
    assert got == rows_of(mixing.mix(docs.repartition(7), shards=4))
    source = {r[0]: r[3] for r in corpus()}
    sizes = {i: len((t or "").encode().split()) for i, t in texts_of().items()}
    for i, (size, source_size, target, taken) in got.items():
        assert size == sizes[i] and 0 <= taken <= 2 * size
        assert source_size == sum(n for j, n in sizes.items() if source[j] == source[i])
    for s in {*source.values()}:
        mine = [i for i in got if source[i] == s]
        assert abs(sum(got[i][3] for i in mine) - got[mine[0]][2]) < 0.05 * got[mine[0]][2] + 64
    assert mixing.mix(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.lists(st.integers(0, 900), min_size=1, max_size=6))
def test_sainte_lague_takes_highest_quotients(seats, votes):
    heap = [(-v, k, 0) for k, v in enumerate(votes) if v]
    heapq.heapify(heap)
    want = [0] * len(votes)
    for _ in range(seats if heap else 0):
        _, k, n = heapq.heappop(heap)
        want[k] += 1
        heapq.heappush(heap, (-votes[k] / (2 * n + 3), k, n + 1))
    got = mixing.sainte_lague(seats, votes).tolist()
    assert sum(got) == sum(want)
    # Ties may go either way between equal quotients.
    quotient = lambda k, n: votes[k] / (2 * n - 1)
    for k in range(len(votes)):
        if got[k] != want[k]:
            own, others = max(got[k], want[k]), [j for j in range(len(votes)) if j != k]
            assert any(np.isclose(quotient(k, own), quotient(j, max(got[j], want[j]))) for j in others)


def test_shares_stop_at_caps():
    assert mixing.capped_shares(150, [3, 1, 2], [60, 60, 80]).tolist() == [60, 30, 60]
    assert mixing.capped_shares(900, [3, 1], [20, 20]).tolist() == [20, 20]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    vecs = [(c + rng.normal(0, rng.choice([0.05, 0.2]), 16)).tolist() for c in centres for _ in range(12)]
    vecs += [vecs[0]] * 5 + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8]
    rows = [(i, v, None if i == 3 else i % 2, 1, "x") for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int, same string")
    got = rows_of(embedding_dedup.near_duplicates(df, threshold=0.98, block=7))
    usable = {}
    for i, v, label, *_ in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, np.float32).astype(float)
            usable[i] = (label, len(v), x / np.sqrt((x * x).sum()))
    links = {i: set() for i in range(len(rows))}
    for i, (a, n, x) in usable.items():
        for j, (b, m, y) in usable.items():
            if i < j and a == b and n == m and x @ y >= 0.98:
                links[i].add(j)
                links[j].add(i)
    comp = {i: i for i in links}
    for _ in links:
        for i in links:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}
    assert max(len(x) for x in links.values()) > 5
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def brute_removal(texts, length=20):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            if x in seen:
                gone[k : k + length] = [True] * length
            seen.add(x)
        out[i] = (len(w), sum(gone), b" ".join(a for a, g in zip(w, gone) if not g).decode())
    return out


def test_substring_dedup(docs, nothing):
    assert rows_of(substring_dedup.remove_repeats(docs)) == brute_removal(texts_of())
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_dedup_without_reference(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "reference_shards", lambda *a, **k: [])
    assert rows_of(substring_dedup.remove_repeats(docs)) == brute_removal(texts_of())


def brute_classes(texts, n=5):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(comp)
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = min(comp[i], comp[j])
        if comp == before:
            break
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_ngram_join(docs, nothing):
    assert rows_of(ngram_join.similarity_classes(docs)) == brute_classes(texts_of())
    assert ngram_join.similarity_classes(nothing).count() == 0


def test_ngram_join_of_a_dense_group(spark):
    """Copies with so many changes that about half of all pairs link, in large regions."""
    rng = random.Random(1)
    base = passage(rng, 120)
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(30)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_classes(texts)
    assert len({c for _, c in want.values()}) < 60
    assert rows_of(ngram_join.similarity_classes(df)) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (200, 100), (300, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert got == {**{i: 0 for i in range(41)}, 300: 0, 100: 100, 101: 100, 200: 100}


def test_language_id(spark, sf, docs, nothing):
    out = QUERIES["op7_language_id"](spark, sf)
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(docs_, "doc_id").where("lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held) > 0
    filters = language_id.learn(docs)
    got = rows_of(language_id.predict(docs, filters))
    for i, t in texts_of().items():
        none = not any(c.isalpha() for c in t or "")
        assert (got[i][0] == "und") == none and 0 <= got[i][1] <= 1
    assert language_id.learn(nothing).langs == []
    assert rows_of(language_id.predict(docs, language_id.learn(nothing)))[0][0] == "und"


def test_bloom_filters_lose_no_ngram():
    rng = np.random.default_rng(1)
    grams = {k: rng.integers(0, 1 << 60, 500).astype(np.uint64) for k in "abc"}
    filters = language_id.Filters.of(grams, bits=12)
    for i, k in enumerate("abc"):
        assert ((filters.masks(grams[k]) >> i) & 1).all()


def test_imatch(docs, nothing):
    table = imatch.lexicon(docs)
    got = rows_of(imatch.compared(docs, table))
    texts = {i: t or "" for i, t in texts_of().items()}
    order = sorted(texts, reverse=True)
    prints = {}
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        assert got[i][:2] == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert all(0 <= x <= 1 for x in got[i][4:])
        assert (edited == t) <= (got[i][4] == 1.0)
        assert prints.setdefault(t, got[i][2]) == got[i][2]
    assert rows_of(imatch.fingerprints(docs, table))[0][0] == got[0][2]
    assert imatch.compared(nothing, imatch.lexicon(nothing)).count() == 0


def test_pipeline(spark, sf):
    """run() against plain Python: what language ID, the join and the removal keep, and
    the digests of what the mix takes."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    left = {r.doc_id: r.text for r in rows if any(c.isalpha() for c in r.text or "")}
    classes = brute_classes_fast(left)
    left = {i: t for i, t in left.items() if classes[i] == i}
    cut = brute_removal(left)
    left = {i: (kept if gone else left[i]) for i, (n, gone, kept) in cut.items() if gone < n or not n}
    source = {r.doc_id: r.source for r in rows}
    frame = spark.createDataFrame([(i, t, source[i]) for i, t in left.items()], "doc_id long, text string, source string")
    taken = mixing.taken_words(mixing.sized(frame, "doc_id", "text", "source"), 1.5, (3, 1, 2), 2, 1024, 17)
    hashes = taken.select("key", F.xxhash64("key", F.lit(21)).alias("h"), "source_no", F.xxhash64("source_no", F.lit(20)).alias("g"))
    hashes = hashes.collect()
    times = copies(taken.collect(), {r.key: r.h for r in hashes}, {r.source_no: r.g for r in hashes})
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, n in times.items():
        ids = lib.encode(left[i], add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(left[i].encode()).hexdigest())] * n
    got = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def copies(rows, key_hash, source_hash):
    """How often each document stands: the whole part of ``taken / size``, and once more
    where the fractions, added up along the line of its source, pass a whole number."""
    unit, times = 1 << 30, {}
    for source in {r.source_no for r in rows}:
        line = []
        for r in rows:
            if r.source_no == source and r.size:
                part = math.floor(r.taken % r.size * unit / r.size + 0.5)
                step = math.floor(math.log2(r.size) * 4)
                line.append((step, r.shard, r.size, key_hash[r.key], r.key, part, r.taken // r.size))
        total = source_hash[source] % unit
        for *_, key, part, whole in sorted(line):
            times[key] = whole + ((total + part) // unit - total // unit)
            total += part
        kept = sum(times[r.key] * r.size for r in rows if r.source_no == source)
        target = next(r.target for r in rows if r.source_no == source)
        assert abs(kept - target) <= 0.05 * target + 2 * max(r.size for r in rows if r.source_no == source)
    return {k: n for k, n in times.items() if n}


def brute_classes_fast(texts):
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    items = sorted(sets.items())
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if len(a) * 100 >= 80 * len(b) and len(b) * 100 >= 80 * len(a) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return {i: root(i) for i in sets}


def test_queries_are_registered(spark):
    import __spark_entry__ as contract

    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert [next(q for q in QUERIES if q.startswith(f"op{n}_")) for n in range(1, 14)] == list(QUERIES)


def test_mixture_keeps_documents_near_the_targets(spark):
    """Documents of many blocks each, so every one has words taken and left."""
    rng = random.Random(7)
    parts = [("a", 1500), ("b", 700), ("c", 300), (None, 200)]
    rows = [(k, " ".join(["w"] * rng.choice([40, 90, 200, 400])), "en", s, 7) for k, s in enumerate(s for s, n in parts for _ in range(n))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    sizes = {r[0]: len(r[1].split()) for r in rows}
    kept = {}
    for r in corpus_pipeline.mixture(spark, frame, "").collect():
        kept.setdefault(r.source, []).append(r.doc_id)
    for r in mixing.mix(frame).join(frame.select("doc_id", "source"), "doc_id").groupBy("source").agg({"target": "max"}).collect():
        ids = kept[r[0]]
        assert abs(sum(sizes[i] for i in ids) - r[1]) < 0.02 * r[1] + 400
        assert max(ids.count(i) for i in set(ids)) <= 2


def test_mixing_takes_tiny_sources_to_the_word(spark, monkeypatch):
    """Beside a huge source, with the long runs of a huge corpus."""
    monkeypatch.setattr(mixing, "block_length", lambda total: 4096, raising=False)
    rows = [(k, "w " * 900, "huge") for k in range(2000)]
    rows += [(5000, "w " * 1200, "tiny"), (5001, "w " * 800, "tiny"), (5002, "w " * 6000, "mid"), (5003, "w " * 7, None)]
    source = {k: s for k, _, s in rows}
    taken, target = {}, {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=64).collect():
        s = source[r.doc_id]
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and len(target) == 4


def test_mixing_of_more_words_than_products_of_64_bits_allow(spark):
    """Shards of 10^11 words, whose squares are far beyond 64 bits."""
    rows = [(k, "ab"[k % 2], 5_000_000_000 + k) for k in range(40)]
    frame = spark.createDataFrame(rows, "key long, source string, size long")
    got = mixing.taken_words(frame, 1.5, (3, 1, 2), 2, 1, 17).collect()
    for no in (0, 1):
        mine = [r for r in got if r.source_no == no]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1 and all(0 <= r.taken <= 2 * r.size for r in mine)


@pytest.mark.parametrize("n", [60, 3000])
def test_license_scan_weighs_ordinary_words_by_their_files(spark, n):
    """Words that no template holds, in every file, around a statement."""
    common = "all content on this site article is"
    rows = [(f"d{k}/p", common) for k in range(n)]
    rows += [("x/p", "All content on this site article is licensed under CC BY 4.0."), ("y/p", "licensed cc by under 4.0")]
    got = rows_of(licenses.scan(spark.createDataFrame(rows, "path string, text string")).where("own IS NOT NULL"))
    assert got["x/p"][0] == "CC-BY-4.0" and set(got) == {"x/p", "y/p"}
    idf = lambda df: np.log((n + 3) / (df + 1)) + 1
    ordinary, stated = len(common.split()) * idf(n + 1) ** 2, 5 * idf(2) ** 2
    assert got["x/p"][1] == pytest.approx((stated / (stated + ordinary)) ** 0.5, abs=2e-6)


def test_license_scan_compares_statements_over_lines(spark):
    rows = [
        ("a/p", "x\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that these are met:\ny"),
        ("b/p", "Creative Commons Attribution 4.0 International"), ("c/p", "Licensed\n\nunder\n \nCC\nBY\n4.0\n" + "word " * 99),
        ("d/p", "Licensed under nothing\n" + "word " * 40 + "\nCC BY 4.0"), ("e/p", "use of the source code"),
        ("f/p", "Redistribution and use in source and binary forms, with or without"),
    ] + [(f"g{k}/p", "word and") for k in range(40)]
    got = rows_of(licenses.scan(spark.createDataFrame(rows, "path string, text string")))
    assert got["a/p"][0] == got["f/p"][0] == "BSD-3-Clause"
    assert got["b/p"][0] == got["c/p"][0] == "CC-BY-4.0" and got["c/p"][1] == 1.0
    assert got["e/p"][0] is got["g0/p"][0] is None


def test_license_gate_is_implied_by_the_threshold():
    stated = licenses.template_terms()
    rng = random.Random(5)
    for _ in range(50):
        shares = licenses.statement_shares(stated, {t: rng.randrange(1000) for _, _, t, _ in stated}, 1000)
        for share in shares.values():
            needed = licenses.needed_terms(share, 0.36)
            assert needed and sum(x for t, x in share.items() if t not in needed) < 0.36


def test_substring_dedup_tells_windows_of_an_anchor_apart(spark, monkeypatch):
    """One phrase with other words around it in every text, and window hashes that
    agree in their low 40 bits."""
    monkeypatch.setattr(substring_dedup, "reference_shards", lambda *a, **k: [])
    real, high = substring_dedup.ngram_hashes, np.uint64((2**24 - 1) << 40)
    monkeypatch.setattr(substring_dedup, "ngram_hashes", lambda w, n: real(w, n) & high if n == 20 else real(w, n))
    rng = random.Random(3)
    texts = {k: " ".join(passage(rng, 19) + "alpha beta gamma delta epsilon".split() + passage(rng, 19)) for k in range(300)}
    texts[300] = texts[7]
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert rows_of(substring_dedup.remove_repeats(frame)) == brute_removal(texts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert rows_of(substring_dedup.remove_repeats(frame)) == brute_removal(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_license_query_keeps_every_page_apart(spark, tmp_path):
    mit, none = "<p>Released under the MIT License.</p>", "<p>nothing</p>"
    pages = [
        (1, "HTTPS://h.org/a/x?page=1", mit), (2, "https://h.org/a/x?page=2", "<p>Licensed under CC BY-NC 4.0.</p>"),
        (3, "Http://h.org/a/y", none), (4, None, mit), (5, None, none), (6, "plain", none), (7, "other", mit), (8, "h.org/a/z#f", none),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op2_license_scan"](spark, str(tmp_path)).collect()}
    assert {k: r.own for k, r in got.items()} == {1: "MIT", 2: "CC-BY-NC-4.0", 3: None, 4: "MIT", 5: None, 6: None, 7: "MIT", 8: None}
    assert got[3].origin == got[8].origin == "h.org/a" and got[3].licence and got[8].licence
    assert got[5].licence is got[6].licence is None and got[4].path is None


def test_ngram_join_divides_a_large_region(spark, monkeypatch):
    rng = random.Random(8)
    copies = []
    for base in range(2):
        words = [f"w{base}x{k}" for k in range(120)]
        for _ in range(170):
            text = list(words)
            for k in rng.sample(range(len(text)), rng.choice([1, 1, 2, 4, 5, 6])):
                text[k] = f"e{rng.randrange(rng.choice([9, 10**9]))}"
            copies.append(" ".join(text[: rng.choice([120, 119, 100])]))
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    looked = []
    real = ngram_join.near_enough

    def near_enough(pairs, texts, pct):
        looked.append(pairs.count())
        return real(pairs, texts, pct)

    monkeypatch.setattr(ngram_join, "near_enough", near_enough)
    monkeypatch.setattr(ngram_join, "LARGE", 8, raising=False)
    assert rows_of(ngram_join.similarity_classes(df)) == brute_classes(dict(enumerate(copies)))
    # All pairs of a base are 14,365.
    assert sum(looked) < 6000
