"""Queries whose SQL the smallest tables don't tell from near misses, on documents that do."""

import duckdb
from pyspark.sql import functions as F

from fumiyomi.operators import surface
from fumiyomi.plans.queries import ORACLE, QUERIES


def both(spark, folder, name, docs):
    """Rows of a query and of its SQL over documents (doc_id, text)."""
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    df = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    found = con.sql(ORACLE[name])
    return sorted(tuple(r[c] for c in found.columns) for r in df.collect()), sorted(found.fetchall())


def test_antithesis_of_tech_between_the_bars(spark, tmp_path):
    ours, theirs = both(spark, tmp_path, "antithesis", [(k, "\n".join(["a! b! c! d! e! f! g!"] * 40)) for k in (2, 29, 61)])
    assert any(doc % 4 == 1 and 0.03 <= ratio < 0.045 for doc, _, ratio, _ in theirs)  # tech, by doc_id
    assert ours == theirs


def test_antithesis_keeps_the_bar_of_tech(spark):
    lines = spark.createDataFrame([(g, k, x, x) for g in ("tech", "essay") for k, x in enumerate(["雨ではなく、雪だ。"] * 4, 1)], "doc_id string, line int, raw string, masked string")
    counts = lines.select("doc_id", F.col("doc_id").alias("genre"), F.lit(100).alias("n_sentences")).distinct()
    rows = surface.antithesis_repetition(lines, counts).select("doc_id", "value", "severity").collect()
    assert {(r.doc_id, r.value, r.severity) for r in rows} == {("tech", 0.04, "warn"), ("essay", 0.04, "critical")}


def test_structural_rules_of_texts_that_end_with_breaks(spark, tmp_path):
    docs = [(k, ("**a** **b** **c** d\n" * 4) + end) for k in range(1, 41) for end in ("", "\n", "e")]
    ours, theirs = both(spark, tmp_path, "structural_rules", [(k, text) for k, (_, text) in enumerate(docs)])
    assert {c for _, c, _ in theirs} >= {"high_bold_density", "high_emoji_symbol_density"}
    assert ours == theirs


def test_structural_counts_the_final_break(spark):
    docs = spark.createDataFrame([("a", "**a****b****c**\n"), ("b", "**a****b****c**")], "doc_id string, text string")
    assert {(r.doc_id, r.value) for r in surface.structural(docs).collect()} == {("a", 3000 / 16), ("b", 3000 / 15)}
