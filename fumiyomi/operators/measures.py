"""Document measurements and the rules on them: rhythm, vocabulary, paragraphs, sentence length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumiyomi import model as m
from fumiyomi.functions import text as t
from fumiyomi.operators.surface import finding, several


def length_stats(lengths: DataFrame, order: list[str], by: str = "doc_id") -> DataFrame:
    """n, mean, population sigma, burstiness and lag-1 correlation of a document's sentence lengths (column n)."""
    w = Window.partitionBy(by).orderBy(*order)
    return _lengths(lengths.withColumn("after", F.lead("n").over(w)), [by], [])


def _lengths(rows: DataFrame, by: list[str], aggs: list[Column]) -> DataFrame:
    """length_stats of rows with n and after, the length of the next sentence; aggs go along."""
    x, y = F.col("n").cast("double"), F.col("after").cast("double")
    paired = F.col("after").isNotNull()
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sigma"),
        F.count_if(paired).alias("pairs"), F.covar_pop(F.when(paired, x), y).alias("cov"),
        F.stddev_pop(F.when(paired, x)).alias("sx"), F.stddev_pop(y).alias("sy"), *aggs,
    )
    burst = F.when(F.col("n_sentences") >= 6, F.try_divide(F.col("sigma") - F.col("mean"), F.col("sigma") + F.col("mean")))
    lag = F.when((F.col("n_sentences") >= 6) & (F.col("pairs") >= 4) & (F.col("sx") > 0) & (F.col("sy") > 0), F.try_divide(F.col("cov"), F.col("sx") * F.col("sy")))
    own = agg.columns[len(by) + 7 :]
    return agg.select(*by, "n_sentences", "mean", "sigma", burst.alias("burstiness"), lag.alias("lag1"), F.when(F.col("mean") > 0, F.try_divide("sigma", "mean")).alias("cv"), *own)


def _at(stats: DataFrame) -> DataFrame:
    """With the line of the first sentence, where it is known."""
    return stats if "line" in stats.columns else stats.withColumn("line", F.lit(1))


def rhythm(stats: DataFrame) -> DataFrame:
    """Findings from length_stats in mora."""
    at = _at(stats)
    return several(at, {"low_burstiness": (F.col("burstiness") < m.BURSTINESS, F.col("burstiness")), "high_length_autocorrelation": (F.col("lag1") > m.AUTOCORRELATION, F.col("lag1"))})


def low_variance(stats: DataFrame) -> DataFrame:
    """Findings from length_stats in characters."""
    rows = _at(stats.filter((F.col("n_sentences") >= 5) & (F.col("cv") < m.VARIANCE_CV)))
    return finding(rows, "low_sentence_variance", value=F.col("cv"))


def mtld(words: DataFrame, order: list[str], factor: float = m.MTLD_FACTOR) -> DataFrame:
    """doc_id and mtld of words (doc_id, word, columns of order): the mean length of runs until the share of different words falls to
    factor, forwards and back; null under 20 words."""
    return diversity(words, order, factor).select("doc_id", "mtld")


def diversity(words: DataFrame, order: list[str], factor: float = m.MTLD_FACTOR) -> DataFrame:
    """doc_id, tokens, types, ttr and mtld of words (doc_id, word, columns of order).

    Whether a word is new in the run is whether it was last seen before the run's begin. So each word takes along where it was
    seen last and will be next (a window by word), and a run is three numbers, whatever words it has: a native fold over numbers, with
    no set of words to carry, and no string once the windows are done."""
    place = Window.partitionBy("doc_id").orderBy(*order)
    rows = words.withColumn("at", F.row_number().over(place))
    same = Window.partitionBy("doc_id", "word").orderBy("at")
    rows = rows.select("doc_id", "at", F.coalesce(F.lag("at").over(same), F.lit(0)).alias("before"), F.lead("at").over(same).alias("after"))
    docs = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("before") == 0).alias("types"), F.array_sort(F.collect_list(F.struct("at", "before", "after"))).alias("w"))
    n = F.size("w")
    # counted from the end, the next place is the one before
    back = F.transform(F.reverse("w"), lambda x: F.struct((n - x["at"] + 1).alias("at"), F.coalesce(n - x["after"] + 1, F.lit(0)).alias("before")))
    mean = (n / _factors(F.col("w"), factor) + n / _factors(back, factor)) / 2
    return docs.select("doc_id", "tokens", "types", F.try_divide("types", "tokens").alias("ttr"), F.when(n >= 20, mean).alias("mtld"))


def _factors(places: Column, factor: float) -> Column:
    """How often the share falls to factor, the last run in part; 1 where it never does at all."""
    state = "struct<begin:int,types:int,n:double>"

    def step(s: Column, x: Column) -> Column:
        types = s["types"] + (x["before"] < s["begin"]).cast("int")
        full = types / (x["at"] - s["begin"] + 1) <= factor
        return F.struct(F.when(full, x["at"] + 1).otherwise(s["begin"]).alias("begin"), F.when(full, F.lit(0)).otherwise(types).alias("types"), (s["n"] + full.cast("int")).alias("n")).cast(state)

    def rest(s: Column) -> Column:
        left = F.size(places) - s["begin"] + 1
        part = F.least((1 - s["types"] / left) / (1 - factor), F.lit(1.0))
        total = s["n"] + F.when(left > 0, part).otherwise(0.0)
        return F.when(total > 0, total).otherwise(1.0)

    return F.aggregate(places, F.struct(F.lit(1).alias("begin"), F.lit(0).alias("types"), F.lit(0.0).alias("n")).cast(state), step, rest)


def lexical(words: DataFrame) -> DataFrame:
    """doc_id, tokens, types, ttr from one row a content word (doc_id, word)."""
    per_word = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("k"))
    docs = per_word.groupBy("doc_id").agg(F.sum("k").alias("tokens"), F.count(F.lit(1)).alias("types"))
    return docs.withColumn("ttr", F.try_divide("types", "tokens"))


def low_diversity(stats: DataFrame) -> DataFrame:
    """Findings from ttr, mtld and chars of a document."""
    at = _at(stats.filter(F.col("chars") >= m.LEXICAL_CHARS))
    return several(at, {"low_lexical_diversity_ttr": (F.col("ttr") < m.TTR, F.col("ttr")), "low_lexical_diversity_mtld": (F.col("mtld") < m.MTLD, F.col("mtld"))})


def paragraph_stats(paras: DataFrame) -> DataFrame:
    """doc_id, para, line of its first line, sentences, whether it leads with a conjunction; from paragraph lines (masked)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "masked"))), lambda x: x["masked"]), "\n")
    grouped = paras.groupBy("doc_id", "para").agg(F.min("line").alias("line"), text.alias("text"))
    pieces = F.filter(F.split("text", f"[{t.TERMINATORS}\n]", -1), lambda x: ~t.is_blank(x))
    lead = t.u_trim(F.col("text")).rlike("^(?:" + t.any_of(m.CONJUNCTIONS) + ")")
    return grouped.select("doc_id", "para", "line", "text", F.size(pieces).cast("long").alias("n_sentences"), lead.alias("leads"))


def paragraph_rules(stats: DataFrame) -> DataFrame:
    """Conjunctions that open too many paragraphs, and paragraphs of too even length."""
    docs = stats.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("leads").cast("double")).alias("share"),
        F.try_divide(F.stddev_pop("n_sentences"), F.avg("n_sentences")).alias("cv"),
    )
    often = docs.filter((F.col("n") >= 3) & (F.col("share") >= 0.30)).select("doc_id", "share")
    leads = stats.filter("leads").join(often, "doc_id")
    out = finding(leads, "paragraph_lead_conjunction", text=F.left("text", F.lit(20)), value=F.col("share"))
    even = docs.filter((F.col("n") >= 4) & (F.col("cv") < 0.15)).withColumn("line", F.lit(1))
    return out.unionByName(finding(even, "uniform_paragraph_structure", value=F.col("cv")))


def reading_marks(sentences: DataFrame) -> DataFrame:
    """sentences with what reading_load asks of them: length, whether one is long and has no comma, and the text it begins with."""
    n = t.reading_length(F.col("sentence"))
    rows = sentences.withColumn("length", n)
    dense = (F.col("length") >= 60) & (t.japanese_chars(F.col("sentence")) * 2 >= F.col("length")) & ~F.col("sentence").rlike("[、，,]")
    return rows.withColumns({"dense": dense, "head": F.left("sentence", F.lit(30)), "size": F.octet_length("sentence")})


def reading_load(sentences: DataFrame) -> DataFrame:
    """Long sentences, and long ones without a comma; needs sentence, line and genre, or what reading_marks makes of these."""
    marked = sentences if "dense" in sentences.columns else reading_marks(sentences)
    bar = F.when(F.col("genre") == "essay", m.SENTENCE_MAX["essay"]).otherwise(m.SENTENCE_MAX[None])
    rows = marked.withColumn("end_byte", F.col("byte_start") + F.col("size")).withColumnRenamed("byte_start", "start_byte") if "byte_start" in marked.columns else marked
    fired = F.array_compact(F.array(F.when(F.col("dense"), "no_comma_sentence"), F.when(F.col("length") > bar, "sentence_too_long")))
    return finding(rows.withColumn("rule", F.explode(fired)), F.col("rule"), severity=F.lit("info"), text=F.col("head"), value=F.col("length"))


def document_rules(facts: DataFrame) -> DataFrame:
    """Rules on the sentences of a document as a whole, from one aggregate: rhythm in mora, even length in characters, and no ending
    with a noun. facts: doc_id, genre, sent_idx, line, chars, mora, noun_ended."""
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    rows = facts.select("doc_id", "genre", "line", "chars", "noun_ended", F.col("mora").alias("n"), F.lead("mora").over(order).alias("after"))
    aggs = [F.min("line").alias("line"), F.max("line").alias("end"), F.sum("chars").alias("chars"), F.count_if("noun_ended").alias("nominal"), F.avg("chars").alias("width"), F.stddev_pop("chars").alias("spread")]
    docs = _lengths(rows, ["doc_id", "genre"], aggs)
    even = F.when(F.col("width") > 0, F.try_divide("spread", "width"))
    least = F.coalesce(*[F.when(F.col("genre") == g, F.lit(k)) for g, k in m.NOMINAL_CHARS.items() if g], F.lit(m.NOMINAL_CHARS[None]))
    rules = {
        "low_burstiness": (F.col("burstiness") < m.BURSTINESS, F.col("burstiness")), "high_length_autocorrelation": (F.col("lag1") > m.AUTOCORRELATION, F.col("lag1")),
        "low_sentence_variance": ((F.col("n_sentences") >= 5) & (even < m.VARIANCE_CV), even),
        "nominal_ending": ((F.col("n_sentences") >= 5) & (F.col("chars") >= least) & (F.col("nominal") == 0), F.col("nominal")),
    }
    return several(docs, rules, {"nominal_ending": "end"})
