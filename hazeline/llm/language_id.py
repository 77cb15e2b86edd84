"""Language identification by language-bitmask n-gram filters.

Every language has a set of character n-grams. All sets share one bit-sliced Bloom
filter: each slot holds one bit per language, and the ``and`` of an n-gram's slots is
the mask of all languages that contain it. A text is scored by counting, per language,
the n-grams whose mask has its bit, less what false positives of that language's filter
would give; the highest corrected share decides.

N-grams run over letters only, lower-cased, with other characters as word ends. A
language's set holds n-grams that a share of its sample texts contain and that are
clearly more frequent there than in the mean of all languages."""

from __future__ import annotations

from collections.abc import Sequence

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import columns, map_batches, mix64

NO_LETTER = "und"


def ngrams(text: str, sizes=(2, 3, 4)) -> np.ndarray:
    """Hashes of all letter n-grams of a text; runs of other characters are one gap. Long
    texts go through whole; empty without letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTERS[code]
    if not letter.any():
        return np.empty(0, np.uint64)
    keep = letter.copy()
    keep[:-1] |= letter[1:] & ~letter[:-1]  # the last of a run of others stays as gap
    keep[-1] = True
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    code = np.concatenate([[np.uint64(32)], code] if code[0] != 32 else [code]).astype(np.uint64)
    out = []
    for n in sizes:
        m = len(code) - n + 1
        if m > 0:
            h = code[:m].copy()
            for k in range(1, n):
                h = (h << np.uint64(21)) ^ (h >> np.uint64(43)) ^ code[k : k + m]
            out.append(h * np.uint64(8) + np.uint64(n))
    return mix64(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class _Lazy:
    table: np.ndarray | None = None

    def __getitem__(self, code):
        if _Lazy.table is None:
            _Lazy.table = _letters()
        return _Lazy.table[code]


LETTERS = _Lazy()


@dataclass
class Filters:
    """``slots``: one mask of languages each (up to 64). ``rate``: false positives of each
    language's filter."""

    langs: list[str]
    slots: np.ndarray
    k: int
    rate: np.ndarray

    @staticmethod
    def of(grams: dict[str, np.ndarray], bits: int = 18, k: int = 3) -> Filters:
        langs = sorted(grams)
        if len(langs) > 64:
            raise ValueError("more than 64 languages")
        slots = np.zeros(1 << bits, np.uint64)
        f = Filters(langs, slots, k, np.zeros(len(langs)))
        for i, lang in enumerate(langs):
            for at in f._places(grams[lang]):
                np.bitwise_or.at(slots, at, np.uint64(1 << i))
        fill = [((slots >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(langs))]
        f.rate = np.array(fill) ** k
        f.slots = slots.astype(np.uint8) if len(langs) <= 8 else slots
        return f

    def _places(self, grams: np.ndarray):
        size, step = np.uint64(len(self.slots) - 1), (grams >> np.uint64(32)) | np.uint64(1)
        return [((grams + np.uint64(j) * step) & size).astype(np.int64) for j in range(self.k)]

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """All languages that contain each n-gram (false positives included)."""
        first, *rest = self._places(grams)
        out = self.slots[first]
        for at in rest:
            out &= self.slots[at]
        return out

    def shares(self, text: str) -> np.ndarray | None:
        """Corrected share of a text's n-grams in each language; None without a letter."""
        grams = ngrams(text)
        if not len(grams):
            return None
        masks = self.masks(grams)
        if len(self.langs) <= 8:
            counts = np.bincount(masks, minlength=256) @ _BITS[:, : len(self.langs)]
        else:
            counts = np.array([((masks >> np.uint64(i)) & np.uint64(1)).sum() for i in range(len(self.langs))])
        return np.clip((counts / len(grams) - self.rate) / (1 - self.rate), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share among all languages' shares (0 to 1)."""
        shares = self.shares(text) if text else None
        if shares is None or not self.langs:
            return NO_LETTER, 0.0
        best = int(shares.argmax())
        total = float(shares.sum())
        return self.langs[best], float(shares[best] / total) if total else 1.0 / len(self.langs)


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def learn(
    docs: DataFrame,
    sample: int = 250,
    most_grams: int = 6_000,
    least_share: float = 0.05,
    lift: float = 1.5,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
) -> Filters:
    """Fit the filters on at most ``sample`` labelled texts of each language (the first
    in a hashed order; up to 64 languages). Rows without label or letters teach nothing;
    repeated rows count as they come; no labelled row gives filters without languages.
    ``most_grams`` bounds a language's set, the most frequent first."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.xxhash64(key).alias("h"), F.col(key).cast("long").alias("key")
    )
    n = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(65).collect()
    if not n:
        return Filters([], np.zeros(1, np.uint8), 1, np.zeros(0))
    # A threshold on the hash leaves about twice the sample of each language, whatever
    # its size; the first of these are taken.
    span = float(1 << 63)
    cut = F.create_map(*[F.lit(v) for r in n for v in (r["lang"], min(1.0, (2 * sample + 64) / r["count"]))])
    taken = (
        docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .where(F.xxhash64(key).cast("double") <= (cut[F.col(lang)] * 2 - 1) * span)
        .select(F.col(lang).alias("lang"), F.xxhash64(key).alias("h"), F.col(text).alias("text"))
    )

    def run(batches):
        for batch in batches:
            langs, hashes, texts = columns(batch)
            sets = [np.unique(ngrams(t)).view(np.int64).tolist() for t in texts]
            yield {"lang": langs, "h": hashes, "grams": sets}

    rows = map_batches(taken, "lang string, h long, grams array<long>", run)
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("grams"))
    kept = rows.where(F.size("grams") > 0).withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample)
    per_gram = (
        kept.select("lang", F.explode("grams").alias("gram"))
        .groupBy("lang", "gram")
        .count()
        .join(F.broadcast(kept.groupBy("lang").agg(F.count("*").alias("n"))), "lang")  # a row a language
        .select("lang", "gram", (F.col("count") / F.col("n")).alias("share"))
        .where(F.col("share") >= least_share)
    )
    found: dict[str, list[tuple[float, int]]] = {r["lang"]: [] for r in n}
    everywhere: dict[int, float] = {}
    for r in per_gram.collect():  # at most 1 / least_share times an n-gram set a language
        found[r["lang"]].append((r["share"], r["gram"]))
        everywhere[r["gram"]] = everywhere.get(r["gram"], 0.0) + r["share"]
    grams = {}
    for name, items in found.items():
        own = sorted((-s, g) for s, g in items if len(found) == 1 or s * len(found) >= lift * everywhere[g])
        grams[name] = np.array([g for _, g in own[:most_grams]], np.int64).view(np.uint64)
    return Filters.of(grams)


def predict(
    docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """``key, lang_pred, score`` of every row, by its whole text and nothing else, and the
    columns to ``keep`` (texts and whole numbers). Null texts and texts without a letter
    are ``und`` with score 0. A narrow pass: repeated and null keys give a row each, an
    empty table none. The filters travel with the tasks; their size is fixed."""
    kinds = dict(docs.dtypes)
    kept = [(f"_kept_{c}", kinds[c].replace("bigint", "long")) for c in keep]

    def run(batches):
        for batch in batches:
            out = [filters.predict(t) for t in batch.column(1).to_pylist()]
            yield {"key": batch.column(0), "lang_pred": [x for x, _ in out], "score": [s for _, s in out]} | {
                name: batch.column(k) for k, (name, _) in enumerate(kept, 2)
            }

    carried = [F.col(c).alias(name) for c, (name, _) in zip(keep, kept)]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *carried)
    ddl = ", ".join(["key long, lang_pred string, score double", *(f"{name} {kind}" for name, kind in kept)])
    found = map_batches(rows, ddl, run)
    return found.select(
        F.col("key").alias(key), "lang_pred", "score", *[F.col(name).alias(c) for c, (name, _) in zip(keep, kept)]
    )
