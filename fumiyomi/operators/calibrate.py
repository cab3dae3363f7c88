"""Calibration over labelled collections: rates with intervals, thresholds, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fumiyomi.functions.text import wilson


def rates(rows: DataFrame, by: list[str], fired: str = "fired") -> DataFrame:
    """n, fired, rate and its interval for each group; low_n under five. rows: one a document."""
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(fired).alias("fired"))
    low, high = wilson(F.col("fired"), F.col("n"))
    return agg.select(*by, "n", "fired", F.try_divide("fired", "n").alias("rate"), low.alias("low"), high.alias("high"), (F.col("n") < 5).alias("low_n"))


def zero_filled(counts: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """Counts for every rule (category), 0 where none fired."""
    return rules.join(counts, by, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts.columns if c not in by})


def sweep(metric: DataFrame, thresholds: list[float], below: bool = True) -> DataFrame:
    """Documents that fire at each threshold: the metric is measured once, the list of thresholds is explicit. metric: label, value."""
    at = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    rows = metric.select("label", "value", at)
    hit = F.col("value") < F.col("threshold") if below else F.col("value") > F.col("threshold")
    return rows.groupBy("threshold", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("fired"))


def curve(values: DataFrame, domains: dict[str, list[float]], buckets: int = 256) -> DataFrame:
    """category, split, label, threshold, n, below and at_most: how many values lie below a threshold and not above it, for every
    threshold of every category (domains) at once. values: category, split, label, value.

    Equal values become one row with a count; thresholds join them as rows that count nothing, so a running sum in the order of
    values answers all of them. Values are dealt to buckets between quantiles of their category, running sums stay inside a bucket,
    and the sums of whole buckets, a few rows a group, are added: no group of any size is one task's."""
    by = ["category", "split", "label"]
    per = values.filter(F.col("category").isin(list(domains))).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("k"))
    cuts = per.groupBy("category").agg(F.percentile_approx("value", [(i + 1) / buckets for i in range(buckets - 1)], F.lit(10_000)).alias("cuts"))
    listed = F.map_from_arrays(F.array(*[F.lit(c) for c in domains]), F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in domains.values()]))
    asked = per.select(*by).distinct().select(*by, F.explode(listed[F.col("category")]).alias("threshold"))
    rows = per.select(*by, "value", "k", F.lit(None).cast("double").alias("threshold")).unionByName(asked.select(*by, F.col("threshold").alias("value"), F.lit(0).cast("long").alias("k"), "threshold"))
    rows = rows.join(F.broadcast(cuts), "category")  # a row of so many numbers for each category of domains
    rows = rows.withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    inside = Window.partitionBy(*by, "bucket").orderBy("value")
    told = rows.select(*by, "bucket", "threshold", "value", F.sum("k").over(inside.rangeBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("k").over(Window.partitionBy(*by, "bucket", "value")).alias("here"))
    whole = rows.groupBy(*by, "bucket").agg(F.sum("k").alias("k"))
    before = whole.select(*by, "bucket", F.coalesce(F.sum("k").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), F.sum("k").over(Window.partitionBy(*by)).alias("n"))
    out = told.filter("threshold is not null").join(before, [*by, "bucket"])
    return out.select(*by, "threshold", "n", (F.col("earlier") + F.col("upto") - F.col("here")).alias("below"), (F.col("earlier") + F.col("upto")).alias("at_most"))


def calibrated(swept: DataFrame, most_false: float, positive: str, negative: str) -> DataFrame:
    """Each threshold with its detection and the upper bound of its false rate; the feasible one of most detection is chosen, of equal ones the least threshold."""
    pick = lambda l, c: F.max(F.when(F.col("label") == l, F.col(c)))
    wide = swept.groupBy("threshold").agg(pick(positive, "n").alias("pn"), pick(positive, "fired").alias("pk"), pick(negative, "n").alias("nn"), pick(negative, "fired").alias("nk"))
    _, high = wilson(F.col("nk"), F.col("nn"))
    rows = wide.select("threshold", F.try_divide("pk", "pn").alias("detection"), high.alias("false_upper"), (high <= most_false).alias("feasible"))
    best = rows.filter("feasible").agg(F.max_by("threshold", F.struct("detection", -F.col("threshold"))).alias("best"))  # as many rows as thresholds
    return rows.join(F.broadcast(best), F.lit(True), "left").select("threshold", "detection", "false_upper", "feasible", F.coalesce(F.col("threshold") == F.col("best"), F.lit(False)).alias("chosen"))


def vocabulary(words: DataFrame) -> DataFrame:
    """word, documents and occurrences on either side, rate per 100,000 and smoothed log2 ratio. words: doc_id, side (a or b), word."""
    per = words.groupBy("word", "side", "doc_id").agg(F.count(F.lit(1)).alias("k")).groupBy("word", "side").agg(F.count(F.lit(1)).alias("docs"), F.sum("k").alias("n"))
    pick = lambda s, c: F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(0))
    wide = per.groupBy("word").agg(pick("a", "docs").alias("a_docs"), pick("b", "docs").alias("b_docs"), pick("a", "n").alias("a_n"), pick("b", "n").alias("b_n"))
    total = per.agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"{s}_total") for s in "ab"])
    rows = wide.join(F.broadcast(total), F.lit(True))  # one row
    share = lambda s: (F.col(f"{s}_n") + 0.5) / (F.col(f"{s}_total") + 0.5)
    return rows.select("word", "a_docs", "b_docs", "a_n", "b_n", F.try_divide(F.col("a_n") * 100000.0, F.col("a_total")).alias("a_rate"), F.log2(share("a") / share("b")).alias("log2_ratio"))


def candidates(vocab: DataFrame, known: list[str], docs: int = 3, ratio: float = 2.0, top: int = 20) -> DataFrame:
    """The top words of side a that aren't known yet: of three documents or more, four times as frequent. A report, so limited."""
    able = vocab.filter((F.col("a_docs") >= docs) & (F.col("log2_ratio") >= ratio) & (F.length("word") >= 2) & ~F.col("word").isin(known or [""]))
    return able.orderBy(F.col("log2_ratio").desc(), "word").limit(top)


def length_bucket(chars) -> object:
    return F.when(chars < 1000, "short").when(chars < 4000, "middle").otherwise("long")


def confusion(samples: DataFrame) -> DataFrame:
    """By category: samples that should fire and did, that should be silent and were, and mismatches. samples: category, expect, fired."""
    fire = F.col("expect") == "fire"
    return samples.groupBy("category").agg(
        F.count_if(fire).alias("expected"), F.count_if(fire & F.col("fired")).alias("hit"), F.count_if(~fire).alias("silent"),
        F.count_if(~fire & F.col("fired")).alias("false_alarm"), F.count_if(fire != F.col("fired")).alias("mismatches"),
    )


def first_of_each(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("nth = 1").drop("nth")
