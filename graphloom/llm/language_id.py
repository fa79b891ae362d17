"""Language ID by language-bitmask n-gram filters.

Training counts byte n-grams by language over a bounded sample of labelled
documents: those whose hash is below a share of all hashes that lets about
``per_language`` documents of each language through, whole texts. An n-gram
belongs to a language if it is not far more frequent in another. A bit-sliced
Bloom filter stores them: every slot is a bit mask of languages, an n-gram sets
its languages' bits in ``HASHES`` slots, and the AND of these slots gives back
all languages that contain it, with some false positives. There are several
slots for every n-gram of the largest language; beyond 64 languages a slot has several masks.

A text's n-grams are looked up at once; each language's popcount ``c`` of
``n`` n-grams is corrected by the filter's own rate ``f`` of false positives,
``(c - n f) / (1 - f)``, and the largest corrected count wins. The score is the
winner's share of all corrected counts; ``known`` is the winner's corrected
count as a share of all n-grams of the text.

Cases: a null text or one without a letter is ``und`` with score 0; a text with
letters of which no n-gram is known gets the most frequent learned language
with score 0; with nothing to learn from, all are ``und``; ties go to the
language that sorts first; repeated rows get equal results, and rows equal in
id, language and text are learned from once; a null language, id or text is not
learned from; long texts are read whole; a column of the documents that has the
result's name keeps it, and the result takes the next free one.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, free_name, release

NGRAM = 5
HASHES = 3
LEAST_BITS, MOST_BITS = 20, 24  # slots: 2^20 and more, at least 8 for each n-gram of a language, 2^24 at most
CHUNK = 250_000  # characters, which bounds a worker's arrays
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: The stage's least ``known`` for texts of ``LONG`` characters. Of some 4,000 labelled documents of sf0.1 the least has 0.44;
#: random letters of three scripts (100 texts of each length) had 0.07 at most with 50 characters and 0.02 with 300. Noise at the filter's
#: largest false rate, 0.004, has a standard deviation of 0.01 over the n-grams of 40 characters.
KNOWN = 0.1
LONG = 40


def _has_letter(text: str) -> bool:
    """Whether a character of the text is a letter; superscripts and fractions are none."""
    return any(map(str.isalpha, text))


def _fold(text: str) -> bytes:
    """Lower case, runs of anything but letters as one blank, framed by blanks."""
    return (" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode("utf-8", "replace")


def _grams(data: bytes) -> np.ndarray:
    """All byte n-grams as integers."""
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) < NGRAM:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(b) - NGRAM + 1, np.uint64)
    for k in range(NGRAM):
        out |= b[k:len(b) - NGRAM + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _slots(grams: np.ndarray, bits: int):
    h = grams * _MIX
    h ^= h >> np.uint64(29)
    for _ in range(HASHES):
        h = h * _MIX2
        h ^= h >> np.uint64(31)
        yield (h >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class LanguageFilter:
    """``masks``: a slot's languages as bits, a table for each 64 languages; ``false_rate``: by language."""

    languages: list[str]
    masks: list[np.ndarray]
    false_rate: np.ndarray
    fallback: str | None

    @classmethod
    def build(cls, languages: list[str], grams: list[np.ndarray], fallback: str | None) -> LanguageFilter:
        most = max((len(g) for g in grams), default=1)
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(8 * max(1, most)))))
        tables, fill = [], []
        for at in range(0, len(languages), 64):
            part = grams[at : at + 64]
            kind = next(k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(part) <= n)
            masks = np.zeros(1 << bits, kind)
            for i, g in enumerate(part):
                for s in _slots(g, bits):
                    masks[s] |= kind(1 << i)
            tables.append(masks)
            fill += [np.count_nonzero(masks & kind(1 << i)) / len(masks) for i in range(len(part))]
        return cls(languages, tables, np.array(fill) ** HASHES, fallback)

    def lookup(self, grams: np.ndarray) -> list[np.ndarray]:
        """Of each n-gram the masks of languages that contain it."""
        out: list[np.ndarray] = []
        if self.masks:
            bits = len(self.masks[0]).bit_length() - 1
            for k, s in enumerate(_slots(grams, bits)):
                for i, masks in enumerate(self.masks):
                    if k:
                        out[i] &= masks[s]
                    else:
                        out.append(masks[s])
        return out

    def counts(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text how many n-grams it has, and (by language) how many of them hit."""
        n = np.array([max(0, len(d) - NGRAM + 1) for d in data], dtype=np.int64)
        ends = np.cumsum([len(d) for d in data])
        first = ends - [len(d) for d in data]
        hits = self.lookup(_grams(b"".join(data)))
        sums = np.zeros((len(self.languages), len(data)))
        for k in range(len(self.languages)):
            table = hits[k // 64]
            # n-grams that reach over a text's end are left out by the bounds
            run = np.concatenate(([0], np.cumsum((table >> table.dtype.type(k % 64)) & table.dtype.type(1), dtype=np.int32)))
            sums[k] = run[np.minimum(first + n, len(run) - 1)] - run[np.minimum(first, len(run) - 1)]
        return n, sums

    def decide(self, texts) -> tuple[list, np.ndarray, np.ndarray]:
        """Languages, scores and shares of known n-grams."""
        texts = list(texts)
        labels, scores, known = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages:
            return labels, scores, known
        for a, b in chunks(texts, CHUNK):
            real = [i for i in range(a, b) if texts[i] is not None and _has_letter(texts[i])]
            if not real:
                continue
            n, sums = self.counts([_fold(texts[i]) for i in real])
            rate = self.false_rate[:, None]
            fixed = np.maximum(0, (sums - n * rate) / np.maximum(1 - rate, 1e-9))
            total = fixed.sum(axis=0)
            for j, i in enumerate(real):
                best = int(np.argmax(fixed[:, j]))
                labels[i] = self.languages[best] if total[j] > 0 else self.fallback
                scores[i] = fixed[best, j] / total[j] if total[j] > 0 else 0.0
                known[i] = fixed[best, j] / max(1, n[j])
        return labels, scores, known


def learnable() -> F.Column:
    """The contract's training rows: crc32 of the id as text, modulo 3, is not 1; null ids are not learned from."""
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & F.col("lang").isNotNull()


def train(docs: DataFrame, where, per_language: int = 400, share: float = 0.25) -> LanguageFilter:
    """Learn from ``text`` and ``lang`` of the rows that ``where`` admits.

    The only bound is ``per_language``, documents of each language: all their
    n-grams are counted, and all that pass ``share`` are in the filter. What
    comes to the driver is the sample's n-grams, whatever the corpus.
    """
    rows = docs.where(where & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    held = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("least")).collect()
    if not held:
        return LanguageFilter.build([], [], None)
    totals = {r["lang"]: r["n"] for r in held}
    # a language's share of all hashes comes first, so that no language is gathered; its rows of one id have one hash
    up_to = F.create_map(*[x for r in held for x in (F.lit(r["lang"]), F.lit(max(r["least"], min(1.0, 2.0 * per_language / r["n"]))))])
    chosen = rows.where(F.col("text").isNotNull() & (draw <= up_to[F.col("lang")])).withColumn("draw", draw)
    chosen = chosen.groupBy("lang", "doc_id", F.xxhash64("text").alias("th")).agg(F.first("text").alias("text"), F.first("draw").alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "th")
    chosen = chosen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)

    def count(frames):
        for pdf in frames:
            for lang, group in pdf.groupby("lang"):
                for a, b in chunks(group["text"].tolist(), CHUNK):
                    seen = np.concatenate([_grams(_fold(t)) for t in group["text"].iloc[a:b]])
                    g, n = np.unique(seen, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "n": n})
        release()

    counts = chosen.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    languages = sorted(found["lang"].unique())
    sums = found.groupby("lang")["n"].sum()
    found["p"] = found["n"] / found["lang"].map(sums)
    found = found[found["p"] >= share * found.groupby("gram")["p"].transform("max")]
    grams = [np.sort(found.loc[found["lang"] == x, "gram"].to_numpy(np.int64)).view(np.uint64) for x in languages]
    fallback = min(languages, key=lambda x: (-totals[x], x)) if languages else None
    return LanguageFilter.build(languages, grams, fallback)


def judge(spark, model: LanguageFilter):
    """A pandas UDF from a text to ``lang_pred``, ``score``, ``known``."""
    held = spark.sparkContext.broadcast((model.languages, model.masks, model.false_rate, model.fallback))  # 2^24 slots at most

    @F.pandas_udf("lang_pred string, score double, known double")
    def of(texts: pd.Series) -> pd.DataFrame:
        labels, scores, known = LanguageFilter(*held.value).decide(texts)
        release()
        return pd.DataFrame({"lang_pred": labels, "score": scores, "known": known})

    return of


def predict(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """Add the struct column ``language``: ``lang_pred``, ``score``, ``known``. Reads the text alone."""
    return docs.withColumn(free_name(docs, "language"), judge(docs.sparkSession, model)(F.col(text_col)))


def op3_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, learnable())
    out = predict(docs.select("doc_id", "text"), model)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def stage_language(spark, docs, sf_dir) -> DataFrame:
    """Pipeline stage: drop documents without a recognisable language.

    Rejected are ``und`` texts (null, empty or without a letter), and texts of
    ``LONG`` characters or more of whose n-grams no language knows a share of
    ``KNOWN``, which is above what the filter's false positives reach; shorter
    ones have too few to tell. Null ids, repeated rows and very long texts are
    judged like any other; columns of any name are kept; an empty table stays empty.
    """
    model = train(docs, learnable())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), judge(spark, model)("text").alias("judged"))
    known = (F.col("judged.known") >= KNOWN) | (F.length("row.text") < LONG)
    return rows.where((F.col("judged.lang_pred") != "und") & known).select("row.*")
