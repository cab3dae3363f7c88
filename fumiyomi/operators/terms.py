"""Terms of documents: acronyms, katakana words and names; their counts, contexts, and an audit over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumiyomi import model as m
from fumiyomi.functions import text as t
from fumiyomi.operators.blocks import uncommented
from fumiyomi.operators.tokens import SENTENCE, order

ACRONYM = "(?<![A-Za-z0-9])[A-Z]{2,}[0-9]*(?![A-Za-z0-9])"


def acronyms(lines: DataFrame, text: str = "raw") -> DataFrame:
    """doc_id, line, term for each acronym."""
    return lines.filter(F.col(text).rlike(ACRONYM)).select("doc_id", "line", F.explode(F.regexp_extract_all(text, F.lit(ACRONYM), 0)).alias("term"))


def _kind(surface: Column, pos2: Column) -> Column:
    """What kind of term a token can be of; null: none."""
    kana = surface.rlike("^[ァ-ヺー・]+\\z")
    latin = surface.rlike("^[A-Z][A-Za-z0-9]+\\z")
    ascii_ = surface.rlike("^[\\x00-\\x7F]+\\z")
    proper = F.when(ascii_, latin).otherwise((pos2 == "固有名詞") & (F.length(surface) >= 2))
    return F.when(kana, "katakana").when(proper, "proper")


def near_terms(sentences: DataFrame, tokens: Column) -> DataFrame:
    """Rows of tokens that can be of a term, and of those beside them: token_terms finds the same in these as in all. tokens: the array of
    a sentence's tokens."""
    rows = sentences.select("doc_id", "sent_idx", "line", tokens.alias("_t"))
    rows = rows.withColumn("_k", F.transform("_t", lambda x: _kind(x["surface"], x["pos2"]).isNotNull())).filter(F.exists("_k", lambda k: k))
    able = lambda i: F.coalesce(F.get("_k", i), F.lit(False))
    own = F.transform("_t", lambda x, i: F.when(able(i) | able(i - 1) | able(i + 1), F.struct(i.alias("tok_idx"), *[x[c].alias(c) for c in ("surface", "byte_start", "pos1", "pos2")])))
    return rows.select("doc_id", "sent_idx", "line", F.explode(F.array_compact(own)).alias("x")).select("doc_id", "sent_idx", "line", "x.*")


def token_terms(tokens: DataFrame) -> DataFrame:
    """Runs of katakana words, and of proper nouns; no katakana glued to a noun or affix, but over ・."""
    rows = tokens.withColumn("kind", _kind(F.col("surface"), F.col("pos2")))
    glue = F.col("pos1").isin("名詞", "接頭辞", "接尾辞") & ~F.col("surface").startswith("・")
    rows = rows.withColumns({"before": F.lag(F.when(glue, F.lit(True)).otherwise(False)).over(order()), "following": F.lead(F.when(glue, F.lit(True)).otherwise(False)).over(order())})
    new = F.coalesce(F.col("kind") != F.lag("kind").over(order()), F.lit(True)) | F.col("kind").isNull()
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(order().rowsBetween(Window.unboundedPreceding, 0))).filter("kind is not null")
    runs = rows.groupBy(*SENTENCE, "run", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "surface"))), lambda x: x["surface"]), "").alias("joined"),
        F.min("line").alias("line"), F.min("byte_start").alias("byte_start"), F.min_by("before", "tok_idx").alias("before"), F.max_by("following", "tok_idx").alias("following"),
    )
    term = F.regexp_replace("joined", "^・+|・+\\z", "")
    glued = F.coalesce("before", F.lit(False)) | F.coalesce("following", F.lit(False))
    runs = runs.withColumn("term", term).filter((F.col("kind") == "proper") | (~glued & (F.length("term") >= 3)))
    return runs.select("doc_id", "line", "byte_start", "term")


def registered(found: DataFrame) -> DataFrame:
    """The first place of each term of a document: least line, acronyms before others, then by byte."""
    first = F.row_number().over(Window.partitionBy("doc_id", "term").orderBy("line", "turn", "byte_start"))
    return found.withColumn("nth", first).filter("nth = 1").drop("nth", "turn")


def with_context(terms: DataFrame, docs: DataFrame, around: int = 80) -> DataFrame:
    """n occurrences in the whole text, the text around the place where a term was seen, and whether a gloss stands there.
    Comments count as blanks. The place is the first one of the term's line (of the text, where terms has no line); a line that
    doesn't hold it is the context itself. docs: doc_id, text."""
    whole = docs.select("doc_id", uncommented(F.col("text")).alias("text"))
    whole = whole.withColumns({"_chars": F.length("text"), "_sizes": F.transform(F.split("text", "\n", -1), lambda x: F.length(x))})  # once a document, not a term
    rows = terms.join(whole, "doc_id")
    if "line" in terms.columns:
        before = F.slice("_sizes", F.lit(1), F.greatest(F.lit(0), F.col("line") - 1))
        rows = rows.withColumn("_skip", F.aggregate(before, F.lit(0), lambda s, x: s + x + 1))
        size = F.get("_sizes", F.col("line") - 1)
        rows = rows.withColumn("_line", F.coalesce(F.substring("text", F.col("_skip") + 1, size), F.lit("")))
    else:
        rows = rows.withColumns({"_line": F.col("text"), "_skip": F.lit(0)})
    n = ((F.col("_chars") - F.length(F.expr("replace(text, term, '')"))) / F.length("term")).cast("long")
    seen = F.expr("instr(_line, term)")
    at = F.col("_skip") + seen
    start = F.greatest(F.lit(1), at - around)
    context = F.when(seen > 0, F.substring("text", start, at - start + F.length("term") + around)).otherwise(F.col("_line"))
    next_char = F.substring("text", at + F.length("term"), F.lit(1))
    gloss = ((seen > 0) & next_char.isin("(", "（")) | context.rlike(t.any_of(m.GLOSS))
    return rows.select(*terms.columns, n.alias("n"), t.u_trim(context).alias("context"), gloss.alias("has_gloss"))


def audit(terms: DataFrame) -> DataFrame:
    """Over all documents: total and number of documents of each term. terms: doc_id, term, n."""
    return terms.groupBy("term").agg(F.sum("n").alias("total"), F.count_distinct("doc_id").alias("docs"))


def variants(audited: DataFrame) -> DataFrame:
    """Spellings that share a normal form, two or more. audited: term, norm, total."""
    spellings = F.array_join(F.array_sort(F.collect_set("term")), ",")
    return audited.groupBy("norm").agg(F.count_distinct("term").alias("spellings"), F.sum("total").alias("total"), spellings.alias("terms")).filter("spellings >= 2")
