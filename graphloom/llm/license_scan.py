"""License scan: phrases, and an exact set-similarity join with license templates.

DataFrame and SQL functions only. A text block is a window of consecutive
words, as many as the template has, wherever lines end; a template fits a block
that contains at least ``THRESHOLD`` of the template's distinct words, and a
text with such a block. The templates' words are ordered by how many documents
hold them, rarest first. With ``need`` words of a template's ``n`` required, any
fitting block holds one of the template's first ``n - need + 1`` words (prefix
filter): places of such words are joined with the templates on the word. The
words around a place that a block with it can hold must include ``need`` of the
template's (length filter), and those behind and before the word in the order
must suffice on both sides (positional filter); then the overlap of each block
around the place is counted. No fitting block is lost.

The templates and their words are fixed in number, whatever the input, so the
index is broadcast; texts without a prefix word never leave the scan.

Cases: a null or empty text has no words, no labels and score 0; repeated rows
are scanned one by one; an empty table gives no rows; very long texts are
scanned whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.9

#: Fixed phrases and labels of the query's contract.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Usual wordings of public licenses and notices, with the labels they get.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("public-domain", "this work has been released into the public domain"),
    ("reserved", "all rights reserved"),
)


def _need(n: int, threshold: float) -> int:
    return -int(-(n * threshold - 1e-9) // 1)


def words_of(text: Column) -> Column:
    """Lower-cased words; ``lower`` also folds letters beyond ASCII, which changes no word's bounds."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def phrase_places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i):
        hit = F.lit(True)
        for k, p in enumerate(parts):
            hit = hit & (F.get(words, i + k) == p)
        return F.coalesce(hit, F.lit(False))

    return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def word_counts(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """Over all documents: how many hold a template word. As large as the templates."""
    held = F.explode(F.array_intersect(words_of(F.col(text_col)), _strings(vocabulary))).alias("w")
    return {r["w"]: r["count"] for r in docs.select(held).groupBy("w").count().collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates``.

    ``score`` is the largest share of a template's words found in a block, 1
    where a phrase stands; ``n_templates`` counts the templates that fit.
    """
    sets = [(label, sorted(set(t.split())), len(t.split())) for label, t in templates]
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    counts = word_counts(docs, text_col, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ordered = [(label, sorted(s, key=rank.get), _need(len(s), threshold), length) for label, s, length in sets]
    prefix = sorted({w for _, s, need, _ in ordered for w in s[: len(s) - need + 1]}, key=rank.get)
    reach = max((length for *_, length in ordered), default=1) - 1

    # one pass over the texts: counts, phrases, and the words around the places of prefix words
    base = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    first_words = _strings(sorted({p.split()[0] for p, _ in phrases}))
    base = base.withColumn("maybe", F.arrays_overlap("words", first_words))
    none = F.array().cast("array<int>")
    places = [F.when(F.col("maybe"), phrase_places(F.col("words"), p)).otherwise(none).alias(f"p{i}") for i, (p, _) in enumerate(phrases)]

    def around(i):
        start = F.greatest(F.lit(0), i - reach)
        return F.struct((i - start).alias("at"), F.slice(F.col("words"), start + 1, i - start + 1 + reach).alias("near"))

    found_at = F.array_compact(F.transform("words", lambda x, i: F.when(x.isin(prefix), around(i))))
    blocks = F.when(F.arrays_overlap("words", _strings(prefix)), found_at).otherwise(F.array().cast("array<struct<at:int,near:array<string>>>"))
    base = base.select("doc_id", F.size("words").cast("long").alias("n_words"), *places, blocks.alias("blocks"))
    base = save(base.withColumn("rid", F.monotonically_increasing_id()), "license-scan")

    # the join of places and templates on prefix words
    index = docs.sparkSession.createDataFrame(
        [(w, i, p, label, s, len(s), need, length) for i, (label, s, need, length) in enumerate(ordered) for p, w in enumerate(s[: len(s) - need + 1])],
        "token string, template int, rank int, label string, members array<string>, n int, need int, length int",
    )
    place = base.where(F.size("blocks") > 0).select("rid", F.explode("blocks").alias("b")).select("rid", "b.*")
    met = place.withColumn("token", F.get("near", F.col("at"))).join(F.broadcast(index), "token")
    # the words of all blocks with the place, and which of the template's they hold, in the template's order
    start = F.greatest(F.lit(0), F.col("at") - F.col("length") + 1)
    met = met.withColumn("near", F.slice("near", start + 1, F.col("at") - start + F.col("length"))).withColumn("at", F.col("at") - start)
    met = met.withColumn("held", F.array_intersect("members", "near")).where(F.size("held") >= F.col("need"))
    pos = F.array_position("held", F.col("token")).cast("int") - 1
    met = met.where(1 + F.least(F.size("held") - 1 - pos, F.col("n") - 1 - F.col("rank")) + F.least(pos, F.col("rank")) >= F.col("need"))
    starts = F.filter(F.sequence(F.lit(0), F.col("at")), lambda i: F.array_contains(F.col("held"), F.get(F.col("near"), i)))
    overlap = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(F.col("near"), i + 1, F.col("length")), F.col("held")))))
    met = met.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need"))
    met = met.groupBy("rid", "template").agg(F.first("label").alias("label"), F.max(F.col("overlap") / F.col("n")).alias("share"))
    found = met.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"), F.count(F.lit(1)).alias("n_templates"))

    out = base.drop("blocks").join(found, "rid", "left")
    own = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    starts = F.flatten(F.array(*[F.col(f"p{i}") for i in range(len(phrases))]))
    out = out.withColumn("own", F.array_sort(F.array_distinct(own))).withColumn("starts", starts)
    labels = F.array_sort(F.array_union("own", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("own") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("n_templates", F.lit(0)).cast("long").alias("n_templates"),
    )


def op7_license_scan(spark, sf_dir) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle() -> str:
    """Every window held against every template, every phrase against every word, without filters.

    Only windows that begin with a word of the template are listed: moving any other up to one loses none of its words.
    """
    sep = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    hits = []
    for p, label in PHRASES:
        parts = p.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(parts))
        hits.append(f"SELECT r, i, '{label}' AS label FROM places WHERE {test}")
    rows = ", ".join(f"({i}, '{label}', {sorted(set(t.split()))!r}, {_need(len(set(t.split())), THRESHOLD)}, {len(t.split())})" for i, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t FROM documents),
ws AS (SELECT r, doc_id, list_filter(string_split_regex(t, '{sep}'), lambda x: x <> '') AS w FROM d),
places AS (SELECT r, w, unnest(range(len(w))) AS i FROM ws),
hit AS ({" UNION ALL ".join(hits)}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS own FROM hit GROUP BY r),
tpl AS (SELECT * FROM (VALUES {rows}) AS x(template, label, members, need, length)),
words AS (SELECT template, label, members, need, length, unnest(members) AS word FROM tpl),
win AS (SELECT r, template, label, len(members) AS n, need, len(list_intersect(list_distinct(w[i + 1:i + length]), members)) AS overlap
        FROM places JOIN words ON w[i + 1] = word),
fit AS (SELECT r, template, any_value(label) AS label, max(overlap / n) AS share FROM win WHERE overlap >= need GROUP BY r, template),
found AS (SELECT r, list_distinct(list(label)) AS found, max(share) AS share, count(*) AS n_templates FROM fit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(array_to_string(own, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(found, [])))), ','), '') AS labels,
       CASE WHEN own IS NOT NULL THEN 1.0 ELSE coalesce(share, 0.0) END AS score,
       CAST(coalesce(n_templates, 0) AS BIGINT) AS n_templates
FROM ws LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""
