"""License scan: sparse TF-IDF cosine to templates, then inheritance along directories.

Each line of a file, and each run of lines that is short enough, is compared with the
licence templates: cosine of sparse TF-IDF vectors, with document frequencies over all
files. A file's own licence is its best
template at or above the threshold. Files that speak for their directory give it their
licence; a file without its own takes that of its nearest ancestor directory that has
one. All of it is DataFrame expressions."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import written

# Usual licence statements.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"


def template_terms() -> list[tuple[str, str, str, int]]:
    """``licence, statement number, term, count`` of all templates."""
    return [
        (name, f"{name} {k}", term, n)
        for name, texts in TEMPLATES.items()
        for k, t in enumerate(texts)
        for term, n in sorted(Counter(re.findall(TERM, t.lower())).items())
    ]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


#: Terms of a run of two or more lines at most: twice those of the longest statement.
RUN = 2 * max(len(re.findall(TERM, t.lower())) for ts in TEMPLATES.values() for t in ts)


def runs(lines: Column, keep) -> Column:
    """For each line (an array of its terms) those runs of lines that begin with it and
    fulfil ``keep``, as arrays of ``first, n, words``."""

    def size(k):
        return F.size(F.coalesce(F.get(lines, k), F.array().cast("array<string>")))

    def from_line(words, i):
        # Every line has a term, so a run has at most RUN lines.
        near = F.sequence(i, F.least(i + RUN, F.size(lines)) - 1)
        state = F.struct(F.lit(0).alias("terms"), F.lit(0).alias("n"))
        add = lambda acc, k: F.struct(
            (acc["terms"] + size(k)).alias("terms"),
            (acc["n"] + F.when(acc["terms"] + size(k) <= RUN, 1).otherwise(0)).alias("n"),
        )
        fit = F.greatest(F.aggregate(near, state, add)["n"], F.lit(1))
        joined = lambda n: F.flatten(F.transform(F.sequence(i, i + n - 1), lambda k: F.get(lines, k)))
        all_runs = F.transform(
            F.sequence(F.lit(1), fit), lambda n: F.struct(i.alias("first"), n.alias("n"), joined(n).alias("words"))
        )
        return F.filter(all_runs, lambda run: keep(run["words"]))

    return F.transform(lines, from_line)


def statement_shares(stated: list[tuple[str, str, str, int]], idf: dict[str, int], n_files: int) -> dict[str, dict[str, float]]:
    """For each statement the share of each term in its squared norm."""
    squares: dict[str, dict[str, float]] = {}
    for _, statement, term, n in stated:
        squares.setdefault(statement, {})[term] = (n * (math.log((n_files + 1) / (idf.get(term, 0) + 1)) + 1)) ** 2
    return {st: {t: x / sum(sq.values()) for t, x in sq.items()} for st, sq in squares.items()}


def needed_terms(share: dict[str, float], least: float) -> set[str]:
    """Terms of which a text must have one: the others together stay below ``least``."""
    rest, needed = 0.0, set(share)
    for term, x in sorted(share.items(), key=lambda tx: (tx[1], tx[0])):
        rest += x
        if rest >= least - 1e-9:
            break
        needed.discard(term)
    return needed


def any_of(words: list[str]) -> str:
    """A pattern found in every lower-case text that has one of these terms."""
    letters = "|".join(w for w in words if w.isalpha())
    digits = "|".join(re.escape(w) for w in words if not w.isalpha())
    parts = [f"(?<![a-z])(?:{letters})(?![a-z])"] * bool(letters) + [f"(?<![0-9])(?:{digits})(?![0-9])"] * bool(digits)
    return "|".join(parts)


def ancestors(path: Column) -> Column:
    """A directory and all above it, as ``depth, dir``."""
    parts = F.split(path, "/", -1)
    upto = F.sequence(F.lit(1), F.size(parts))
    return F.transform(upto, lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))


def scan(files: DataFrame, threshold: float = 0.6, speaks: Column | None = None) -> DataFrame:
    """``path, own, score, licence, origin`` of ``files (path, text)``: a file's own licence
    with its cosine, the licence it has in the end, and the directory it comes from (null
    for its own). ``speaks`` says which files speak for their directory (all, if not
    given); among several the one with the best score, then the first path.

    Null texts and texts without terms have no licence of their own; a null path inherits
    nothing; rows that share a path are merged into their best; ties go to the first
    licence by name; other columns do not matter; an empty table gives no rows. Runs
    of lines that are compared have at most ``RUN`` terms, twice the longest statement;
    single lines may be longer. Lines without a term count as not there. What shares too
    little weight with every statement to reach the threshold is left out before."""
    spark = files.sparkSession
    stated = template_terms()
    vocabulary = sorted({t for _, _, t, _ in stated})
    rows = files.select("path", "text", (F.lit(True) if speaks is None else speaks).alias("speaks"))
    n_files = rows.count()
    df = written(
        rows.where("text IS NOT NULL")
        .select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df")),
        "frequencies",
    )
    idf = {r["term"]: r["df"] for r in df.where(F.col("term").isin(vocabulary)).collect()}
    weigh = lambda n: F.log((F.lit(n_files) + 1) / (n + 1)) + 1
    table = spark.createDataFrame(
        [(lic, st, t, n, idf.get(t, 0)) for lic, st, t, n in stated],
        "licence string, statement string, term string, n long, df long",
    ).withColumn("w", F.col("n") * weigh(F.col("df")))
    norms = table.groupBy("statement").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    table = F.broadcast(table.join(norms, "statement").select("licence", "statement", "term", "w", "norm", "df"))
    least = (threshold - 1e-6) ** 2 if threshold > 1e-6 else 0.0
    shares = statement_shares(stated, idf, n_files)
    needed = sorted(set().union(*(needed_terms(share, least) for share in shares.values())))
    overlap = lambda words: F.arrays_overlap(words, F.array(*map(F.lit, needed)))
    enough = F.lit(False)  # cosine <= root of the share of the statement's squared norm that is met
    for share in shares.values():
        met = sum((F.when(F.array_contains("words", t), F.lit(x)).otherwise(0.0) for t, x in share.items()), F.lit(0.0))
        enough = enough | (met >= least - 1e-9)
    lines = (
        rows.where(F.lower("text").rlike(any_of(needed)))
        .select("path", "text", F.xxhash64("path", "text").alias("file"))
        .select("path", "file", F.filter(F.transform(F.split("text", "\n"), terms), lambda x: F.size(x) > 0).alias("lines"))
        .select("path", "file", F.explode(F.flatten(runs(F.col("lines"), overlap))).alias("run"))
        .select("path", F.struct("file", "run.first", "run.n").alias("line"), "run.words")
        .where(enough)
        .select("path", "line", F.explode("words").alias("term"))
        .groupBy("path", "line", "term")
        .agg(F.count("*").alias("n"))
        .join(df, "term")
        .withColumn("wl", F.col("n") * weigh(F.col("df")))
        .drop("df")
    )
    whole = lines.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("wl") * F.col("wl"))).alias("norm_line"))
    common = (
        lines.join(table, "term")
        .groupBy("path", "line", "licence", "statement")
        .agg(F.sum(F.col("wl") * F.col("w")).alias("dot"), F.first("norm").alias("norm"))
    )
    scored = (
        common.join(whole, (common["path"].eqNullSafe(whole["path"])) & (common["line"] == whole["line"]))
        .select(common["path"].alias("path"), "licence", F.round(F.col("dot") / (F.col("norm") * F.col("norm_line")), 6).alias("score"))
        .where(F.col("score") >= threshold)
    )
    best = scored.groupBy("path").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")
    ).select(F.col("path").alias("p"), F.col("b.licence").alias("own"), (-F.col("b.s")).alias("score"))
    placed = (
        rows.groupBy("path")
        .agg(F.max("speaks").alias("speaks"))
        .join(best, F.col("path").eqNullSafe(F.col("p")), "left")
        .withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")))
    )
    given = (
        placed.where("speaks AND own IS NOT NULL AND dir IS NOT NULL")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("g"))
        .select("dir", F.col("g.own").alias("given"))
    )
    heirs = placed.where("own IS NULL AND dir IS NOT NULL").select(F.col("dir").alias("home")).distinct()
    nearest = (
        heirs.select("home", F.explode(ancestors(F.col("home"))).alias("a"))
        .select("home", "a.depth", "a.dir")
        .join(given, "dir")
        .groupBy("home")
        .agg(F.max(F.struct("depth", F.col("dir").alias("origin"), "given")).alias("m"))
        .select("home", "m.origin", "m.given")
    )
    joined = placed.join(nearest, (F.col("dir") == F.col("home")) & F.col("own").isNull(), "left")
    return joined.select("path", "own", "score", F.coalesce("own", "given").alias("licence"), "origin")


def page_files(pages: DataFrame) -> DataFrame:
    """Web pages as files: the address without scheme, query and fragment is the path,
    every tag ends a line. ``file`` is a path of the page's own in the same directory; a
    page without address has one without directory."""
    path = F.regexp_replace("url", "(?i)^[a-z][a-z0-9+.-]*://", "")
    path = F.regexp_replace(F.regexp_replace(path, "(?s)[?#].*", ""), "/+$", "")
    return pages.select(
        "page_id",
        path.alias("path"),
        F.concat_ws("\t", path, "page_id").alias("file"),
        F.regexp_replace("html", "<[^>]*>", "\n").alias("text"),
    )
