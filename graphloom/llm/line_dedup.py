"""Line dedup by a deletion-neighbourhood join; DataFrame and SQL functions only.

The unit of an edit is a word. A line (trimmed, split at single blanks) is a
duplicate if an equal line stands earlier, or, with ``NEAR_WORDS`` words or
more, one within a single inserted, deleted or replaced word. Earlier means a
smaller document id, then a smaller line number. The earliest line stays, and
all occurrences of a duplicate go. Lines below ``MIN_WORDS`` words stay, but
with ``least_chars`` only those that have fewer characters too: a passage in a
script without blanks is one word.

1. Equal lines are aggregated to one with its first place (two 64-bit hashes).
2. An edit leaves the first or the last ``b`` words unchanged, ``b`` being about
   half of the length's class; lines that share neither with another line have
   no partner and go no further. This drops no pair.
3. The others emit their deletion neighbourhood: the whole line and every
   variant without one word, as hashed keys. Two lines that share a variant
   with the same word's place removed differ by a replaced word; a variant that
   equals a whole line differs by a deleted word. Keys hold the least place of
   their lines, found by aggregation, so a group of any size costs a row for
   each member, never a row for each pair.
4. The words of each joined pair are compared, which settles hash collisions.

Cases: a null or empty text is left as it is; rows with equal id and text are
one document and equally treated; blank lines stay; empty tables give no rows;
a null id takes a negative hash of its text as its place; other columns, of any
name, are kept and not read; a line of n words costs n * sqrt(n) hash terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_key, free_name, save

MIN_WORDS = 3
NEAR_WORDS = 8
#: The pipeline's ``least_chars``; the SQL of ``op10_line_dedup`` is given, and knows words alone.
LEAST_CHARS = 16


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(doc_key(F.col(id_col), F.col(text_col)).alias("dk"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _edge_keys(line: Column, words: Column) -> Column:
    """Hashes of the first and last words: blocks of 4, 8, 16 ... by the length's class.

    A line whose length begins a class also emits the class below, since its
    partner may be one word shorter.
    """
    keys = []
    for e in range(2, 7):
        b = 1 << e
        inside = (words >= 2 * b) & ((words <= 4 * b) if e < 6 else F.lit(True))
        keys += [
            F.when(inside, F.xxhash64(F.lit(b), F.substring_index(line, " ", b))),
            F.when(inside, F.xxhash64(F.lit(-b), F.substring_index(line, " ", -b))),
        ]
    return F.array_compact(F.array(*keys))


def _lines(source: DataFrame, least_chars: int | None = None) -> DataFrame:
    """A row for each line of ``MIN_WORDS`` words or ``least_chars`` characters or more: place, two hashes, words, edge keys."""
    rows = source.select("dk", "th", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    rows = rows.select("dk", "th", "no", F.trim("raw").alias("line"))
    words = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    enough = F.col("words") >= MIN_WORDS
    if least_chars is not None:
        enough = enough | (F.length("line") >= least_chars)
    rows = rows.withColumn("words", words).where(enough)
    return rows.select(
        "dk", "th", "no", "line", "words", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2")
    )


def _neighbourhood() -> Column:
    """Of a line's words ``w`` the hashes of the line and of each variant without one word.

    A hash is the sum of hashes of (word, place), so that a variant's follows
    from prefix sums: words behind the gap count with a place less. Sums over
    blocks of about the square root of the length keep long lines cheap.
    """
    n = F.size("w")

    def term(x, j):
        return F.shiftrightunsigned(F.xxhash64(x, j), 20)

    def total(xs):
        return F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)

    here = F.transform("w", lambda x, j: term(x, j))
    moved = F.transform("w", lambda x, j: term(x, j - 1))
    step = F.ceil(F.sqrt(n)).cast("int")
    row = F.struct(here.alias("here"), moved.alias("moved"), step.alias("step"))

    def of(r):
        shift = F.zip_with(r["here"], r["moved"], lambda a, b: a - b)
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(r["here"]) - 1) / r["step"]).cast("int")), lambda b: total(F.slice(shift, b * r["step"] + 1, r["step"])))
        return F.struct(r["here"].alias("here"), r["moved"].alias("moved"), r["step"].alias("step"), shift.alias("shift"), blocks.alias("blocks"), total(r["moved"]).alias("all"))

    def heads(r):
        before = F.transform(r["blocks"], lambda _, b: total(F.slice(r["blocks"], F.lit(1), b)))
        return F.struct(r["here"].alias("here"), r["moved"].alias("moved"), r["step"].alias("step"), r["shift"].alias("shift"), before.alias("before"), r["all"].alias("all"))

    def hashes(r):
        def without(m, j):
            b = (j / r["step"]).cast("int")
            return r["all"] + F.get(r["before"], b) + total(F.slice(r["shift"], b * r["step"] + 1, j - b * r["step"])) - m

        return F.concat(F.array(total(r["here"])), F.transform(r["moved"], without))

    stages = F.array(row)
    for f in (of, heads):
        stages = F.transform(stages, f)
    return F.flatten(F.transform(stages, hashes))


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int | None = None) -> DataFrame:
    """``dk, th, no, near``: every line to remove; ``near`` tells lines that only resemble an earlier one."""
    source = _keyed(docs, id_col, text_col).where(F.length("text") > 0)
    lines = _lines(source, least_chars)
    place = F.struct("dk", "th", "no")

    # 1. one row for each distinct line
    edges = F.when(F.col("words") >= NEAR_WORDS, _edge_keys(F.col("line"), F.col("words"))).otherwise(F.array().cast("array<bigint>"))
    distinct = lines.select("h1", "h2", place.alias("at"), edges.alias("edges")).groupBy("h1", "h2").agg(
        F.min("at").alias("at"), F.first("edges").alias("edges"), F.count(F.lit(1)).alias("times")
    )
    distinct = save(distinct.select("h1", "h2", "at.*", "edges", "times"), "distinct-lines")

    # 2. lines that share their first or last words with another
    edge = distinct.select("dk", "th", "no", F.explode("edges").alias("edge"))
    shared = edge.groupBy("edge").count().where(F.col("count") > 1).select("edge")
    chosen = edge.join(shared, "edge", "left_semi").groupBy("dk", "th").agg(F.collect_set("no").alias("nos"))
    texts = source.join(chosen, ["dk", "th"]).select("dk", "th", F.split("text", "\n").alias("all"), F.explode("nos").alias("no"))
    texts = texts.select("dk", "th", "no", F.split(F.trim(F.get("all", F.col("no"))), " ").alias("w")).dropDuplicates(["dk", "th", "no"])
    # ids ascend with the place: partitions are ranges of it and each is sorted
    texts = texts.repartitionByRange("dk", "th", "no").sortWithinPartitions("dk", "th", "no")
    texts = save(texts.select(F.monotonically_increasing_id().alias("id"), place.alias("at"), "w"), "near-lines")

    # 3. the deletion neighbourhood: place 0 is the whole line
    hashed = texts.select("id", F.posexplode(_neighbourhood()).alias("i", "h"))
    variants = save(hashed, "variants")
    shared = variants.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where(F.col("a") < F.col("b")).select("h")
    joined = save(variants.join(shared, "h", "left_semi"), "shared-variants")
    discard(variants)
    inside = joined.where(F.col("i") > 0)
    first = inside.groupBy("h", "i").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    replaced = inside.join(first.drop("c"), ["h", "i"]).where(F.col("id") != F.col("keep"))
    replaced = replaced.select("id", "keep", "i", F.col("i").alias("j"))
    whole = joined.where(F.col("i") == 0).select(F.col("id").alias("whole"), "h")
    longer = inside.join(whole, "h").where(F.col("id") != F.col("whole"))
    later = F.col("id") > F.col("whole")
    deleted = longer.select(
        F.greatest("id", "whole").alias("id"), F.least("id", "whole").alias("keep"),
        F.when(later, F.col("i")).otherwise(0).alias("i"), F.when(later, 0).otherwise(F.col("i")).alias("j"),
    )

    # 4. verification of the words themselves; place 0 removes none
    def without(w: str, i: str) -> Column:
        rest = F.concat(F.slice(w, F.lit(1), F.col(i) - 1), F.slice(w, F.col(i) + 1, F.size(w)))
        return F.when(F.col(i) == 0, F.col(w)).otherwise(rest)

    pairs = replaced.unionByName(deleted).groupBy("id", "keep").agg(F.min(F.struct("i", "j")).alias("p")).select("id", "keep", "p.*")
    pairs = pairs.join(texts.select("id", "at", F.col("w").alias("a")), "id").join(texts.select(F.col("id").alias("keep"), F.col("w").alias("b")), "keep")
    near = save(pairs.where(without("a", "i") == without("b", "j")).select("at").distinct(), "near")
    discard(joined, texts)

    # all occurrences of what goes
    near = near.select("at.*", F.lit(True).alias("near"))
    judged = distinct.drop("edges").join(near, ["dk", "th", "no"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    judged = judged.where((F.col("times") > 1) | F.col("near"))
    judged = judged.select("h1", "h2", place.alias("first"), "near")
    every = lines.select("h1", "h2", "dk", "th", "no").join(judged, ["h1", "h2"])
    return every.where(F.col("near") | (place != F.col("first"))).select("dk", "th", "no", "near")


def _without_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int | None) -> DataFrame:
    """``row`` (of all columns), ``kept_text`` and ``removed``: struct of ``exact``, ``near``, ``kept``."""
    gone = find_duplicates(docs, id_col, text_col, least_chars).groupBy("dk", "th").agg(
        F.collect_set("no").alias("gone"), F.countDistinct(F.when(F.col("near"), F.col("no"))).cast("int").alias("near")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, doc_key(F.col(id_col), F.col(text_col)).alias("dk"), F.xxhash64(text_col).alias("th"))
    out = keyed.join(gone, ["dk", "th"], "left").withColumn("text", F.col(f"row.`{text_col}`"))
    # only texts that lose lines are split
    out = out.withColumn("all", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    lines = F.transform(kept, lambda i: F.get(F.col("all"), i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    total = F.when(F.octet_length("text") > 0, breaks + 1).otherwise(0)
    near = F.coalesce("near", F.lit(0))
    return out.select("row", text.alias("kept_text"), F.struct((removed - near).alias("exact"), near.alias("near"), (total - removed).alias("kept")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int | None = None) -> DataFrame:
    """``docs`` with duplicate lines taken out of the text, and ``lines_removed``: struct of ``exact``, ``near``, ``kept``.

    A column of the documents named ``lines_removed`` keeps its name, and the result takes the next free one.
    """
    out = _without_lines(docs, id_col, text_col, least_chars)
    columns = [F.col("kept_text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*columns, F.col("removed").alias(free_name(docs, "lines_removed")))


def op10_line_dedup(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "lines_removed.*", "text")


def stage_line_dedup(spark, docs, sf_dir) -> DataFrame:
    """Pipeline stage: duplicate lines go from the texts, and documents of which no line is left.

    ``n_chars``, where there is one, follows the new text. Null and empty texts
    stay; columns of any name are kept; an empty table stays empty.
    """
    out = _without_lines(docs, "doc_id", "text", LEAST_CHARS)
    emptied = (F.col("removed.kept") == 0) & (F.col("removed.exact") + F.col("removed.near") > 0)
    kinds = dict(docs.dtypes)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    columns = [new[c].cast(kinds[c]).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]
    return out.where(~emptied).select(*columns)


def oracle() -> str:
    """Every line against every earlier one of a near length: quadratic, for small tables."""
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(range(len(ls))) AS no, ls FROM d WHERE text <> ''),
l AS (SELECT doc_id, no, string_split(trim(ls[no + 1]), ' ') AS w FROM e),
m AS (SELECT doc_id, no, w, len(w) AS n, array_to_string(w, ' ') AS line FROM l WHERE len(w) >= {MIN_WORDS}),
u AS (SELECT line, any_value(w) AS w, any_value(n) AS n, min((doc_id, no)) AS pos FROM m GROUP BY line),
v AS (SELECT line, pos, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS h
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u WHERE n >= {NEAR_WORDS})),
p AS (SELECT a.pos AS x, b.pos AS y FROM v a JOIN v b ON a.h = b.h AND a.i = b.i AND a.pos > b.pos
      UNION ALL SELECT greatest(a.pos, b.pos), least(a.pos, b.pos) FROM v a JOIN u b ON a.h = b.line AND b.n >= {NEAR_WORDS}),
near AS (SELECT DISTINCT x FROM p),
g AS (SELECT m.doc_id, m.no, (u.pos IN (SELECT x FROM near)) AS near, (u.pos IN (SELECT x FROM near)) OR (m.doc_id, m.no) <> u.pos AS gone
      FROM m JOIN u USING (line)),
s AS (SELECT doc_id, list(no) AS nos, count(*) FILTER (near) AS near, count(*) FILTER (NOT near) AS exact FROM g WHERE gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(exact, 0) AS INTEGER) AS exact, CAST(coalesce(near, 0) AS INTEGER) AS near,
       CAST(CASE WHEN text <> '' THEN len(ls) ELSE 0 END - coalesce(len(nos), 0) AS INTEGER) AS kept,
       CASE WHEN nos IS NULL THEN text ELSE array_to_string([ls[i + 1] FOR i IN range(len(ls)) IF NOT list_contains(nos, i)], chr(10)) END AS text
FROM d LEFT JOIN s USING (doc_id)"""
