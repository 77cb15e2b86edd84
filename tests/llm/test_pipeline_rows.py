"""The pipeline's stages on odd rows: null and repeated ids, null, empty and long texts,
ties, empty tables and further columns."""

import random

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h int, text_hash int, times int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(i, words(rng, rng.choice([1, 4, 30, 90])), "en", rng.choice(["a", "b", None]), 5) for i in range(40)]
    passage = words(rng, 30)
    out += [(50, words(rng, 9) + " " + passage, "en", "a", 1), (51, passage + " " + words(rng, 9), "en", "b", 1), (52, passage, "en", "a", 1)]
    out += [(7, out[7][1], "en", "a", 5), (7, out[7][1], "en", "a", 5), (8, words(rng, 60), "de", "b", 5)]  # repeated ids
    out += [(60, next(t for _, t, *_ in out if len(t.split()) == 30), "en", "a", 5), (None, words(rng, 40), "en", "a", 5), (None, None, None, None, None)]
    out += [(61, None, "en", "a", 0), (62, "", "en", "a", 0), (63, " 12 34 ", "en", "a", 7), (64, "word " * 60_000, "en", "b", 9)]
    return out


def by_id(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.doc_id, []).append(r)
    return found


def test_languages_judge_every_row(spark, rows):
    docs = frame(spark, rows)
    got = P.languages(spark, docs, "")
    assert got.columns == P.COLUMNS
    want = sorted((str(r[0]), r[1]) for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == want
    assert len(by_id(got)[7]) == 3 and all(r.lang for r in got.collect())


def test_near_duplicates_keep_whole_groups_of_an_id(spark, rows):
    got = by_id(P.near_duplicates(spark, frame(spark, rows), ""))
    assert len(got[7]) == 3 and len(got[8]) == 2 and None not in got and 60 not in got and 0 in got


def test_repeated_passages_neither_lose_nor_multiply_rows(spark, rows):
    got = P.repeated_passages(spark, frame(spark, rows), "")
    assert got.columns == P.COLUMNS
    found = by_id(got)
    assert len(found[7]) == 3 and len(found[8]) == 2 and len(found[None]) == 2
    assert 52 not in found and 60 not in found  # all words stand earlier
    assert found[51][0].text == " ".join(rows[41][1].split()[30:]) and found[51][0].n_chars == len(found[51][0].text)
    assert found[50][0].text == rows[40][1] and found[61][0].text is None
    assert found[64][0].text == "word"


def test_mixture_does_not_multiply_ids(spark, rows):
    got = by_id(P.mixture(spark, frame(spark, rows), ""))
    copies = {len(got[7]) // 3} if 7 in got else set()
    assert all(len(v) <= 2 for k, v in got.items() if k not in (7, 8, None)) and copies <= {1, 2}
    assert 61 not in got and 62 not in got


def test_tokens_have_a_row_each(spark, rows):
    assert P.tokens(spark, frame(spark, rows), "").count() == len(rows)


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_of_nothing(spark, name, stage):
    for nothing in ([], [(None, None, None, None, None)], [(1, None, None, None, None), (2, "", None, None, 0)]):
        got = stage(spark, frame(spark, nothing), "")
        assert got.count() <= len(nothing) and "doc_id" in got.columns
