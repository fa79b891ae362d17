"""The pipeline: stages keep the documents' columns and their decisions take effect."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    sets = {"en": "the and ing tion her ".split(" "), "de": "der und ung ein sch ".split(" ")}

    def prose(lang, n):
        return " ".join("".join(rng.choice(sets[lang]) for _ in range(2)) or "a" for _ in range(n))

    docs = [(i, prose("en" if i % 2 else "de", 120), "en" if i % 2 else "de", "s", 1) for i in range(40)]
    item = prose("en", 30)
    docs += [(100, docs[0][1], "de", "s", 1), (101, docs[1][1] + " plus", "en", "s", 1), (102, "12345 !!", "en", "s", 1), (103, prose("en", 60) + " " + item, "en", "s", 1), (104, None, "en", "s", 1)]
    spark.createDataFrame(docs, DOCS).withColumn("piece", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = df.columns, []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        kept.append({r["doc_id"] for r in df.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == columns
    clean = set(range(40))
    assert kept[0] == clean | {100, 101, 103} and kept[1] == clean | {103} and kept[2] == kept[1] and kept[3] == clean and kept[4] == clean
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == clean
