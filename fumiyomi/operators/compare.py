"""Runs compared with an earlier one, and findings suppressed by configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumiyomi import model as m


def comparison_key(category: Column, excerpt: Column) -> Column:
    """What makes two findings the same: the category alone for rules on documents, else the first 20 visible characters, too."""
    return F.when(category.isin(m.DOCUMENT_RULES), F.lit("")).otherwise(F.left(F.regexp_replace(excerpt, r"(?U)\s", ""), F.lit(20)))


def bag_match(now: DataFrame, before: DataFrame) -> DataFrame:
    """A full outer join of bags: file, category, key and status persisting, new or resolved. Both sides: file, ord, category,
    excerpt. The n-th finding of a key meets the n-th one before, so each is used once, in order."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("file", "category", comparison_key(F.col("category"), F.col("excerpt")).alias("key"), "ord")
        return rows.select("file", "category", "key", F.row_number().over(Window.partitionBy("file", "category", "key").orderBy("ord")).alias("nth"), F.lit(True).alias(name))

    both = numbered(now, "here").join(numbered(before, "there"), ["file", "category", "key", "nth"], "full")
    status = F.when(F.col("here") & F.col("there"), "persisting").when(F.col("here"), "new").otherwise("resolved")
    return both.select("file", "category", "key", "nth", status.alias("status"))


def file_status(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files of either run: compared, added, or missing from this one."""
    both = now.select("file").distinct().withColumn("here", F.lit(True)).join(before.select("file").distinct().withColumn("there", F.lit(True)), "file", "full")
    return both.select("file", F.when(F.col("here") & F.col("there"), "compared").when(F.col("here"), "added").otherwise("missing").alias("status"))


def suppressed(findings: DataFrame, disabled: list[str], allow: list[tuple[str, str]]) -> DataFrame:
    """Findings that no disabled rule and no allowance (category, text in the excerpt) takes away. Both lists are a user's configuration."""
    hidden = F.col("category").isin(disabled) if disabled else F.lit(False)
    for category, text in allow:
        hidden = hidden | ((F.col("category") == category) & F.col("excerpt").contains(text))
    return findings.filter(~hidden)


def latest(records: DataFrame) -> DataFrame:
    """The last record of each file (file, ord, ...)."""
    return records.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy(F.col("ord").desc()))).filter("nth = 1").drop("nth")


def incompatible(header: DataFrame, version: str, genre: str | None, experimental: bool) -> DataFrame:
    """Files of an earlier run (file, version, genre, experimental) that were made under other settings."""
    same = (F.col("version").isNull() | (F.col("version") == version)) & F.col("genre").eqNullSafe(F.lit(genre)) & (F.col("experimental") == experimental)
    return header.filter(~same)
