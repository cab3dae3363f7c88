"""Outlines: headings, leads of blocks, lists as one row; and statistics of headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumiyomi import model as m
from fumiyomi.functions import text as t
from fumiyomi.operators.blocks import structured


def block_kind(c: Column) -> Column:
    return F.when(t.is_list_item(c), "bullets").when(t.is_quote(c), "quote").when(t.is_table(c), "table").otherwise("lead")


def outline(docs: DataFrame) -> DataFrame:
    """doc_id, line, kind (heading, lead, bullets), level, text. Blocks end at blanks, headings, fences and other kinds;
    an indented line that is no list item goes on with a list."""
    rows = structured(docs)
    raw = F.col("raw")
    heads = rows.filter("kind = 'heading'").select("doc_id", "line", F.lit("heading").alias("kind"), t.heading_level(raw).alias("level"), t.heading_text(raw).alias("text"))
    order = Window.partitionBy("doc_id").orderBy("line")
    apart = F.col("kind").isin("heading", "fence", "front_matter", "blank") | t.is_blank(raw)
    rows = rows.withColumn("apart", apart).withColumn("block", F.when(~apart, block_kind(raw)))
    goes_on = (F.lag("block").over(order) == "bullets") & raw.rlike(r"^(?U)\s") & (F.col("block") == "lead")
    rows = rows.withColumn("block", F.when(goes_on, F.lit("bullets")).otherwise(F.col("block")))
    new = F.col("apart") | F.lag("apart", 1, True).over(order) | (F.col("block") != F.lag("block").over(order))
    rows = rows.withColumn("nth", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("not apart")
    blocks = rows.groupBy("doc_id", "nth", "block").agg(F.min(F.struct("line", "raw")).alias("x"), F.count_if(t.is_list_item(raw)).alias("items"))
    lead = t.u_trim(F.regexp_extract("x.raw", "^([^。！？]*[。！？]?)", 1))
    said = F.when(F.col("block") == "bullets", F.concat(F.lit("(箇条書き "), F.col("items").cast("string"), F.lit(" 項目)"))).otherwise(lead)
    blocks = blocks.filter(F.col("block").isin("bullets", "lead")).select("doc_id", F.col("x.line").alias("line"), F.col("block").alias("kind"), F.lit(None).cast("int").alias("level"), said.alias("text"))
    return heads.unionByName(blocks.filter("text <> ''"))


def stripped(c: Column) -> Column:
    """A heading without numbering and punctuation before it, lowered."""
    return F.lower(t.u_trim(F.regexp_replace(c, r"^(?U)[\s0-9!-/:-@\[-`{-~０-９．、（）【】・]+", "")))


def template_word(c: Column) -> Column:
    return t.first_of(stripped(c), m.TEMPLATE_HEADINGS)


def structural_pattern(c: Column) -> Column:
    return c.rlike(r"^(?U)\s*(?:[0-9０-９]+[.).、]|[①-⑳])\s*\S") | c.rlike(r"^(?U)\s*[【\[［(（].+[】\]］)）]\s*\z") | c.rlike(r"(?U).+とは[?？]?\s*\z")


def heading_stats(headings: DataFrame) -> DataFrame:
    """By level and over all (level null): count, mean length, its variation, template and structural shares."""
    rows = headings.select("doc_id", "level", F.length("text").alias("n"), template_word(F.col("text")).isNotNull().alias("template"), structural_pattern(F.col("text")).alias("structural"))
    cv = F.when(F.count(F.lit(1)) > 1, F.coalesce(F.try_divide(F.stddev_pop("n"), F.avg("n")), F.lit(0.0))).otherwise(0.0)
    return rows.groupingSets([["doc_id", "level"], ["doc_id"]], "doc_id", "level").agg(
        F.count(F.lit(1)).alias("headings"), t.half_up(F.avg("n"), 2).alias("mean_length"), t.half_up(cv, 3).alias("cv"),
        F.count_if("template").alias("templates"), t.half_up(F.avg(F.col("structural").cast("double")), 3).alias("structural_ratio"),
    )
