"""The statistics of a document's report, all of them from one pass: lines and sentences in their order, one exchange by document,
one sort, running values for what looks back (paragraphs, the sentence before, runs of one mode), then two aggregates, by paragraph
and by document, which only add up whole numbers and keep maxima. So the second adds up what the first did, with no exchange between
them, and means, deviations and correlations are formed once, at the end, from exact sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumiyomi import model as m
from fumiyomi.functions import text as t
from fumiyomi.operators.surface import structure_counts

MODES = ["assertive", "tentative", "question", "nominal", "other"]
SCRIPTS = ["kanji", "hiragana", "katakana", "ascii"]
#: What a sentence brings along, whole numbers.
COUNTS = ["tokens", "verbs", "particles", *SCRIPTS]
SENTENCE = ["doc_id", "line", "sent_idx", "chars", "mora", "mode", "noun_ended", "conjunction", *COUNTS]


def leads(text: Column) -> Column:
    """Whether a text begins with a conjunction."""
    return t.u_trim(text).rlike("^(?:" + t.any_of(m.CONJUNCTIONS) + ")")


def sentence_measures(sents: DataFrame, tokens: DataFrame, ends: DataFrame) -> DataFrame:
    """SENTENCE from sentences (sentence, raw_text), their tokens (a row each) and endings (mode, noun_ended, mora)."""
    kind = t.script(F.col("surface"))
    solid = tokens.filter(~F.col("pos1").isin(m.PUNCTUATION_POS)).groupBy("doc_id", "sent_idx").agg(
        F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("pos1") == "動詞").alias("verbs"), F.count_if(F.col("pos1") == "助詞").alias("particles"),
        *[F.count_if(kind == k).alias(k) for k in SCRIPTS],
    )
    rows = sents.join(ends.select("doc_id", "sent_idx", "mode", "noun_ended", "mora"), ["doc_id", "sent_idx"]).join(solid, ["doc_id", "sent_idx"], "left")
    return rows.select("doc_id", "line", "sent_idx", F.length("raw_text").cast("long").alias("chars"), "mora", "mode", "noun_ended", leads(F.col("sentence")).alias("conjunction"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def surface_measures(sents: DataFrame) -> DataFrame:
    """SENTENCE without a tokenizer: modes by the mark and the ending, characters for mora, runs of one script for tokens."""
    s = F.col("sentence")
    ends = lambda words: s.rlike("(?:" + t.any_of(words) + r")\z")
    mode = F.when(F.col("end_mark").isin("？", "?"), "question").when(ends(m.TENTATIVE), "tentative").when(ends(m.ASSERTIVE), "assertive").otherwise("other")
    runs = {"kanji": "[一-鿿々]+", "hiragana": "[ぁ-ゖ]+", "katakana": "[ァ-ヶー]+", "ascii": r"[\x21-\x7E]+"}
    rows = sents.withColumns({k: t.pattern_count(s, p) for k, p in runs.items()})
    total = reduce(lambda a, b: a + b, [F.col(k) for k in SCRIPTS])
    size = F.length("raw_text").cast("long")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "line", "sent_idx", size.alias("chars"), size.alias("mora"), mode.alias("mode"), F.lit(False).alias("noun_ended"), leads(s).alias("conjunction"), total.alias("tokens"), zero.alias("verbs"), zero.alias("particles"), *SCRIPTS)


def _deviation(n: Column, s: Column, q: Column) -> Column:
    """Population deviation from a count, a sum and a sum of squares, which are whole."""
    return F.sqrt(F.greatest(F.lit(0.0), F.try_divide((n * q - s * s).cast("double"), (n * n).cast("double"))))


def document_stats(lines: DataFrame, sents: DataFrame) -> DataFrame:
    """doc_id and stats (a struct named as in reports) from structured lines (line, masked, kind) and SENTENCE rows. Every document
    that has a line has a row."""
    own = lines.select("doc_id", "line", F.lit(-1).alias("sent_idx"), F.lit(True).alias("is_line"), t.is_blank(F.col("masked")).alias("blank"), leads(F.col("masked")).alias("conjunction"), "kind")
    rows = own.unionByName(sents.select(*SENTENCE).withColumn("is_line", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("line", "sent_idx")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    said = ~F.col("is_line")
    rows = rows.withColumns({
        "was_blank": F.last(F.when(F.col("is_line"), F.col("blank")), ignorenulls=True).over(before),
        "past": F.last(F.when(said, F.struct("line", "mode", "mora")), ignorenulls=True).over(before),
        "nth": F.sum(said.cast("int")).over(so_far),
    })
    new = said & F.coalesce((F.col("mode") != F.col("past.mode")) | (F.col("line") > F.col("past.line") + 1), F.lit(True))
    begins = F.col("is_line") & ~F.col("blank") & F.coalesce("was_blank", F.lit(True))
    rows = rows.withColumn("begins", begins).withColumns({
        "para": F.sum(F.col("begins").cast("int")).over(so_far),
        "run": F.when(said, F.col("nth") - F.last(F.when(new, F.col("nth")), ignorenulls=True).over(so_far) + 1),
    })
    x, y = F.col("past.mora").cast("long"), F.when(F.col("past").isNotNull(), F.col("mora").cast("long"))
    x = F.when(said, x)
    adds = {
        "sentences": F.when(said, F.lit(1)), "nominal": F.when(F.col("noun_ended"), F.lit(1)), "led": F.when(said & F.col("conjunction"), F.lit(1)), "chars": F.col("chars"), **{c: F.col(c) for c in COUNTS},
        "mora": F.col("mora"), "mora2": F.col("mora") * F.col("mora"), "x": x, "y": y, "x2": x * x, "y2": y * y, "xy": x * y, "pairs": F.when(x.isNotNull(), F.lit(1)),
        "references": F.when(F.col("kind") == "reference", F.lit(1)), "notes": F.when(F.col("kind") == "code_note", F.lit(1)), "begun": F.when(F.col("begins"), F.lit(1)),
        "opened": F.when(F.col("begins") & F.col("conjunction"), F.lit(1)), **{f"is_{k}": F.when(F.col("mode") == k, F.lit(1)) for k in MODES},
    }
    tops = {f"run_{k}": F.when(F.col("mode") == k, F.col("run")) for k in MODES}
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    paras = rows.groupBy("doc_id", "para").agg(*[zero(F.sum(e)).alias(k) for k, e in adds.items()], *[zero(F.max(e)).alias(k) for k, e in tops.items()])
    spread = F.when(F.col("begun") > 0, F.struct("para", "sentences"))
    docs = paras.groupBy("doc_id").agg(
        *[F.sum(k).alias(k) for k in adds], *[F.max(k).alias(k) for k in tops], F.sum(F.when(F.col("begun") > 0, F.col("sentences") * F.col("sentences"))).alias("spread2"),
        F.transform(F.array_sort(F.collect_list(spread)), lambda p: p["sentences"]).alias("spread"),
    )
    return docs.select("doc_id", report().alias("stats"))


def report() -> Column:
    """The sums of a document as the statistics of its report."""
    c = F.col
    ratio = lambda a, b: F.try_divide(c(a).cast("double"), c(b).cast("double"))
    enough = c("sentences") >= 6
    mean, sigma = ratio("mora", "sentences"), _deviation(c("sentences"), c("mora"), c("mora2"))
    sx, sy = _deviation(c("pairs"), c("x"), c("x2")), _deviation(c("pairs"), c("y"), c("y2"))
    cov = F.try_divide((c("pairs") * c("xy") - c("x") * c("y")).cast("double"), (c("pairs") * c("pairs")).cast("double"))
    share = ratio("sentences", "begun")
    cv = F.when(c("begun") >= 4, F.coalesce(F.try_divide(_deviation(c("begun"), c("sentences"), c("spread2")), share), F.lit(0.0)))
    solid = (c("tokens") > 0) & (c("sentences") > 0)
    part = lambda k: F.when(solid, ratio(k, "tokens"))
    return F.struct(
        c("sentences").alias("total_sentences"), c("nominal").alias("nominal_ending_count"), F.coalesce(ratio("nominal", "sentences"), F.lit(0.0)).alias("nominal_ending_ratio"),
        c("begun").alias("total_paragraphs"), c("opened").alias("paragraph_lead_conjunction_count"), F.coalesce(ratio("opened", "begun"), F.lit(0.0)).alias("paragraph_lead_conjunction_ratio"),
        c("spread").alias("paragraph_sentence_counts"), cv.alias("paragraph_sentence_count_cv"),
        F.struct(c("references").alias("reference_lines"), c("notes").alias("code_annotation_lines")).alias("masking"),
        F.struct(c("led").alias("sentence_lead_conjunction_count"), ratio("led", "sentences").alias("sentence_lead_conjunction_ratio")).alias("conjunction"),
        F.struct(
            (~solid).alias("skipped_empty"), F.when(solid, ratio("chars", "sentences")).alias("mean_sentence_chars"), part("verbs").alias("verb_token_ratio"), part("particles").alias("particle_token_ratio"),
            *[part(k).alias(f"script_{k}_token_ratio") for k in SCRIPTS],
        ).alias("readability"),
        F.struct(
            F.when(enough, mean).alias("mora_mean"), F.when(enough, sigma).alias("mora_stdev"), F.when(enough, F.coalesce(F.try_divide(sigma - mean, sigma + mean), F.lit(0.0))).alias("burstiness"),
            F.when(enough & (c("pairs") >= 4) & (sx > 0) & (sy > 0), F.try_divide(cov, sx * sy)).alias("length_autocorrelation_lag1"),
            F.struct(F.struct(*[c(f"is_{k}").alias(k) for k in MODES]).alias("counts"), F.struct(*[c(f"run_{k}").alias(k) for k in MODES]).alias("longest_runs")).alias("sentence_endings"),
        ).alias("rhythm"),
    )


def structural_stats(docs: DataFrame) -> DataFrame:
    """doc_id and structural: counts and densities of Markdown."""
    c = F.col
    dense = lambda k: c(k) * 1000.0 / F.greatest(c("chars"), F.lit(1))
    return structure_counts(docs).select("doc_id", F.struct(
        c("bold").alias("bold_span_count"), dense("bold").alias("bold_per_1000_chars"), c("bullets").alias("bullet_line_count"), c("non_blank").alias("non_blank_line_count"),
        c("boilerplate").alias("boilerplate_heading_count"), c("phases").alias("numbered_phase_hit_count"), c("emoji").alias("emoji_symbol_count"), dense("emoji").alias("emoji_symbol_per_1000_chars"),
    ).alias("structural"))


def lexical_stats(docs: DataFrame) -> DataFrame:
    """doc_id and lexical_diversity from tokens, ttr, mtld and chars (all sentences') of a document; short documents give neither ratio."""
    short = F.col("chars") < m.LEXICAL_CHARS
    return docs.select("doc_id", F.struct(
        F.when(~short, F.col("ttr")).alias("ttr"), F.when(~short, F.col("mtld")).alias("mtld"), F.coalesce("tokens", F.lit(0)).alias("content_token_count"),
        F.col("chars").alias("doc_char_count"), short.alias("skipped_too_short"),
    ).alias("lexical_diversity"))


def specificity_stats(scores: DataFrame) -> DataFrame:
    """doc_id and low_specificity from the scores of paragraphs."""
    return scores.groupBy("doc_id").agg(F.struct(F.count(F.lit(1)).alias("paragraphs_evaluated"), F.count_if(F.col("score") < m.SPECIFICITY).alias("paragraphs_fired")).alias("low_specificity"))


def merged(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """doc_id, genre and stats of every document (doc_id, genre): the fields of all parts, which have a row a document at most."""
    rows = docs.select("doc_id", "genre")
    for part in parts:
        rows = rows.join(part, "doc_id", "left")
    names = [c for c in rows.columns if c not in ("doc_id", "genre", "stats")]
    return rows.select("doc_id", "genre", F.struct("stats.*", *names).alias("stats"))
