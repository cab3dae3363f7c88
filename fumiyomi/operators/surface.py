"""Rules on the surface of lines: phrases, patterns, structure. Each takes frames and returns findings.

A finding is doc_id, line, category, severity, excerpt, start_byte, end_byte (in the line), value (what was measured), the columns of
its place, and what may be put in the place of which bytes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumiyomi import model as m
from fumiyomi.functions import text as t
from fumiyomi.operators import spans
from fumiyomi.operators.blocks import uncommented

FINDING = ["doc_id", "line", "category", "severity", "excerpt", "start_byte", "end_byte", "value", "start_column", "end_column", *spans.SUGGESTION]


def matches(c: Column, pattern: Column | str) -> Column:
    """All matches of a pattern with their first byte: the pieces between matches give the places, without a function in Python."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts, found = F.split(c, pattern, F.lit(-1)), F.regexp_extract_all(c, pattern, F.lit(0))
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.octet_length(x))
    return F.transform(found, lambda x, i: F.struct(x.alias("match"), (size(F.slice(parts, 1, i + 1)) + size(F.slice(found, 1, i))).alias("start_byte")))


def finding(df: DataFrame, category: str | Column, *, severity: Column | None = None, line="line", text: Column | None = None, value: Column | None = None) -> DataFrame:
    """Findings of a rule from rows that have doc_id and line, and start_byte and end_byte where the rule has a place. Where rows have
    the line (raw), too, the excerpt is what stands around the place, and columns are known."""
    none = F.lit(None)
    place = "start_byte" in df.columns
    seen = place and "raw" in df.columns
    around = spans.excerpt(F.col("raw"), F.col("start_byte"), F.col("end_byte")) if seen else none
    rows = spans.with_columns(df) if seen else df
    held = lambda c, kind: (F.col(c) if c in rows.columns else none).cast(kind).alias(c)
    return rows.select(
        F.col("doc_id"), F.col(line).cast("int").alias("line"), F.lit(category).alias("category"),
        (severity if severity is not None else F.lit(m.BY_NAME[category].severity)).alias("severity"),
        (text if text is not None else around if place else F.lit("")).cast("string").alias("excerpt"),
        held("start_byte", "int"), held("end_byte", "int"), (value if value is not None else none).cast("double").alias("value"),
        held("start_column", "int"), held("end_column", "int"), held("fix_start", "int"), held("fix_end", "int"), held("fix_start_column", "int"), held("fix_end_column", "int"), held("preimage", "string"), held("replacement", "string"),
    )


def wide(text: str) -> Column:
    """Whether a text has characters beyond ASCII."""
    return F.octet_length(text) > F.length(text)


def located(lines: DataFrame, patterns: list[str], text: str = "masked", needs: list[str] | None = None) -> DataFrame:
    """A row for each match of each pattern (its number) in a line. Patterns are matched separately, as overlapping hits of different
    ones all count; lines without any are dropped by a plain filter first, and only the rest meet single patterns. needs: words of which
    each match holds one."""
    if needs:
        if not any(x.isascii() for x in needs):
            lines = lines.filter(wide(text))
        lines = lines.filter(F.col(text).rlike(heads(needs) + "(?:" + t.any_of(needs) + ")"))
    hit = lines.filter(F.col(text).rlike("|".join(f"(?:{p})" for p in patterns)))
    each = F.posexplode(F.array(*[F.lit(p) for p in patterns])).alias("pattern", "_p")
    rows = hit.select("doc_id", "line", "raw", F.col(text).alias("_t"), each).filter(F.rlike("_t", F.col("_p")))
    rows = rows.select("doc_id", "line", "raw", "pattern", F.explode(matches(F.col("_t"), F.col("_p"))).alias("x"))
    return rows.select("doc_id", "line", "raw", "pattern", "x.*").withColumn("end_byte", F.col("start_byte") + F.octet_length("match"))


def heads(phrases: list[str]) -> str:
    """What stands at any place where one of these phrases begins: a single test at the other places."""
    return "(?=[" + "".join(sorted({re.escape(p[0]) for p in phrases})) + "])"


def phrase_rows(lines: DataFrame, phrases: list[str], text: str) -> DataFrame:
    """One row a phrase and match. Lines are filtered by one alternation; only the rest meet single phrases, as overlapping ones all count."""
    able = lines if any(p.isascii() for p in phrases) else lines.filter(wide(text))
    hit = able.filter(F.col(text).rlike(heads(phrases) + "(?:" + t.any_of(phrases) + ")"))
    each = F.array(*[F.lit(p) for p in phrases])
    rows = hit.select("doc_id", "line", "raw", text, F.posexplode(each).alias("phrase_no", "phrase")).filter(F.col(text).contains(F.col("phrase")))
    parts = F.split(text, F.concat(F.lit("\\Q"), F.col("phrase"), F.lit("\\E")), F.lit(-1))
    size = F.octet_length("phrase")
    at = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda s, x: s + F.octet_length(x)) + (k - 1) * size)
    rows = rows.select("doc_id", "line", "raw", "phrase_no", "phrase", F.explode(at).alias("start_byte"))
    return rows.withColumn("end_byte", F.col("start_byte") + size)


def forbidden_phrase(masked: DataFrame) -> DataFrame:
    rows = phrase_rows(masked, m.PHRASES, "masked")
    weak = F.when(F.col("phrase").isin(m.WEAK_PHRASES), "info").otherwise("warn")
    return finding(rows, "forbidden_phrase", severity=weak)


def hype_expression(bare: DataFrame) -> DataFrame:
    return finding(phrase_rows(bare, m.HYPE, "masked"), "hype_expression")


def translationese(masked: DataFrame) -> DataFrame:
    return finding(located(masked, m.TRANSLATIONESE, needs=m.TRANSLATIONESE_NEEDS), "translationese")


def line_rules(lines: DataFrame) -> DataFrame:
    """forbidden_phrase, hype_expression (in raw lines outside fences and quotes), translationese and english_syntax_inanimate_subject in
    one pass: a line meets the patterns of those rules alone of which it holds a needed word."""
    literal = lambda phrases: [f"\\Q{p}\\E" for p in phrases]
    rules = {
        "forbidden_phrase": ("masked", literal(m.PHRASES), m.PHRASES, F.lit(True)), "hype_expression": ("raw", literal(m.HYPE), m.HYPE, ~F.col("kind").isin("fence", "quote")),
        "translationese": ("masked", m.TRANSLATIONESE, m.TRANSLATIONESE_NEEDS, F.lit(True)), "english_syntax_inanimate_subject": ("masked", m.INANIMATE, m.INANIMATE_NEEDS, F.lit(True)),
    }
    able = lines.filter(wide("raw")).withColumns({f"_{k}": where & F.col(text).rlike(heads(needs) + "(?:" + t.any_of(needs) + ")") for k, (text, _, needs, where) in rules.items()})
    able = able.filter(reduce(lambda a, b: a | b, [F.col(f"_{k}") for k in rules]))
    # a function, so that each name is bound
    of = lambda k, patterns: F.transform(F.split(F.lit("\n".join(patterns)), "\n"), lambda p: F.struct(F.lit(k).alias("rule"), p.alias("_p")))
    each = F.flatten(F.array_compact(F.array(*[F.when(F.col(f"_{k}"), of(k, patterns)) for k, (_, patterns, _, _) in rules.items()])))
    rows = able.select("doc_id", "line", "raw", "masked", F.explode(each).alias("x")).select("doc_id", "line", "raw", F.when(F.col("x.rule") == "hype_expression", F.col("raw")).otherwise(F.col("masked")).alias("_t"), "x.*")
    rows = rows.filter(F.rlike("_t", F.col("_p"))).select("doc_id", "line", "raw", "rule", "_p", F.explode(matches(F.col("_t"), F.col("_p"))).alias("x"))
    rows = rows.select("doc_id", "line", "raw", "rule", "_p", "x.*").withColumn("end_byte", F.col("start_byte") + F.octet_length("match"))
    strong = (F.col("rule") == "forbidden_phrase") & ~F.col("_p").isin(literal(m.WEAK_PHRASES))
    return finding(rows, F.col("rule"), severity=F.when(strong, "warn").otherwise("info"))


def antithesis_repetition(masked: DataFrame, sentence_counts: DataFrame) -> DataFrame:
    """One finding a document with three hits or more, at the first; severity by hits a sentence."""
    first = F.min(F.struct("line", "pattern", "start_byte", "end_byte", "raw")).alias("x")
    docs = located(masked, m.ANTITHESIS, needs=m.ANTITHESIS_NEEDS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), first).filter("hits >= 3").join(sentence_counts, "doc_id")
    ratio = F.try_divide(F.col("hits"), F.col("n_sentences"))
    bar = F.when(F.col("genre") == "tech", 0.045).otherwise(0.03)
    rows = docs.select("doc_id", "x.*", ratio.alias("ratio"), bar.alias("bar"))
    severity = F.when(F.col("ratio") < 0.02, "info").when(F.col("ratio") >= F.col("bar"), "critical").otherwise("warn")
    return finding(rows, "antithesis_repetition", severity=severity, text=t.u_trim(spans.sliced(F.col("raw"), F.col("start_byte"), F.col("end_byte"))), value=F.col("ratio"))


def inanimate_subject(masked: DataFrame) -> DataFrame:
    return finding(located(masked, m.INANIMATE, needs=m.INANIMATE_NEEDS), "english_syntax_inanimate_subject")


def cleft_marks(sentences: DataFrame) -> DataFrame:
    """sentences with whether they are a definition, or a reason."""
    return sentences.withColumns({"defines": F.col("sentence").rlike(m.CLEFT.replace("$", "\\z")), "because": F.col("sentence").rlike(m.BECAUSE), "head": F.left("sentence", F.lit(30))})


def cleft_because(sentences: DataFrame) -> DataFrame:
    """A definition and, as the next sentence, a reason; needs sentence, or what cleft_marks makes of it."""
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    rows = sentences if "defines" in sentences.columns else cleft_marks(sentences)
    rows = rows.withColumn("after", F.lead("because").over(order)).filter("defines and after")
    return finding(rows, "english_syntax_cleft_because", text=F.col("head"))


def structure_counts(docs: DataFrame) -> DataFrame:
    """Counts of Markdown structure of each document, comments as blanks; lines without the empty one after a final break."""
    text = uncommented(F.col("text"))
    body = F.regexp_replace(text, r"\r?\n\z", "")
    rows = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    count = lambda test: F.size(F.filter(rows, test)).cast("long")
    closers = F.transform(F.filter(rows, t.is_heading), t.heading_text)
    return docs.select(
        "doc_id",
        F.length(text).cast("long").alias("chars"),
        t.pattern_count(text, r"\*\*[^*\n]+\*\*").alias("bold"),
        count(t.is_list_item).alias("bullets"),
        count(lambda x: ~t.is_blank(x)).alias("non_blank"),
        F.size(F.filter(closers, lambda x: F.lower(x).isin(m.CLOSERS))).cast("long").alias("boilerplate"),
        t.pattern_count(text, m.PHASE).alias("phases"),
        t.pattern_count(text, m.EMOJI).alias("emoji"),
    )


def structural(docs: DataFrame) -> DataFrame:
    """Densities of bold marks, bullets, phases and emoji of a document."""
    c = structure_counts(docs).withColumn("line", F.lit(1))
    per_thousand = lambda k: F.try_divide(F.col(k) * 1000, F.col("chars"))
    share = F.try_divide(F.col("bullets"), F.col("non_blank"))
    rules = {
        "high_bold_density": ((F.col("bold") >= 3) & (per_thousand("bold") >= 3), per_thousand("bold")),
        "high_bullet_ratio": ((F.col("non_blank") >= 10) & (share >= 0.35), share),
        "numbered_phase_structure": (F.col("phases") >= 3, F.col("phases")),
        "high_emoji_symbol_density": ((F.col("emoji") >= 3) & (per_thousand("emoji") >= 2), per_thousand("emoji")),
    }
    return several(c, rules)


def several(rows: DataFrame, rules: dict[str, tuple[Column, Column]], lines: dict[str, str] | None = None) -> DataFrame:
    """Findings of several rules on the same rows (doc_id, line) in one pass: category to condition and value. lines: columns of
    the lines of rules whose line is another."""
    at = lines or {}
    each = [F.when(test, F.struct(F.lit(k).alias("category"), F.lit(m.BY_NAME[k].severity).alias("severity"), value.cast("double").alias("value"), F.col(at.get(k, "line")).alias("line"))) for k, (test, value) in rules.items()]
    hits = rows.select("doc_id", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    none = {c: F.lit(None).cast("string" if c in ("preimage", "replacement") else "int").alias(c) for c in FINDING}
    own = {"doc_id": F.col("doc_id"), "line": F.col("x.line").cast("int").alias("line"), "category": F.col("x.category"), "severity": F.col("x.severity"), "excerpt": F.lit("").alias("excerpt"), "value": F.col("x.value")}
    return hits.select(*[own.get(c, none[c]) for c in FINDING])


def boilerplate_heading(structured: DataFrame) -> DataFrame:
    rows = structured.filter(t.is_heading(F.col("raw")) & F.lower(t.heading_text(F.col("raw"))).isin(m.CLOSERS))
    return finding(rows, "boilerplate_heading", text=t.heading_text(F.col("raw")))


BULLET = r"^(?U)\s*(?:[-*+]|[0-9]+[.)])\s+"


def bullet_rows(structured: DataFrame) -> DataFrame:
    """List items outside fences and quotes: content after the mark."""
    return structured.filter((F.col("kind") != "fence") & (F.col("kind") != "quote") & t.is_list_item(F.col("raw"))).withColumn("content", F.regexp_replace("raw", BULLET, ""))


def bullet_styles(structured: DataFrame) -> DataFrame:
    """At most one finding a document and style: labels in bold, and items that begin with an emoji."""
    styles = {"bullet_bold_label": r"^\*\*[^*\n]+\*\*(?U)\s*[:：]", "bullet_emoji": "^" + m.EMOJI}
    items = bullet_rows(structured).withColumns({k: F.col("content").rlike(p) for k, p in styles.items()}).filter(reduce(lambda a, b: a | b, map(F.col, styles)))
    of = lambda k: F.struct(F.lit(k).alias("rule"), F.count_if(k).alias("hits"), F.min(F.when(F.col(k), F.struct("line", "content"))).alias("x"))
    docs = items.groupBy("doc_id").agg(F.array(*map(of, styles)).alias("x")).select("doc_id", F.explode("x").alias("x")).select("doc_id", "x.rule", "x.hits", "x.x.*").filter("hits > 0")
    return finding(docs, F.col("rule"), severity=F.lit("info"), text=F.left("content", F.lit(20)), value=F.col("hits"))


def colon_leads(structured: DataFrame) -> DataFrame:
    """Lines that end with a colon before a list, a fence or a table: candidates of predicate_colon_lead, with their label."""
    later = Window.partitionBy("doc_id").orderBy(F.col("line").desc()).rowsBetween(Window.unboundedPreceding, -1)
    open_lines = structured.withColumn("next", F.last(F.when(~t.is_blank(F.col("raw")), F.col("raw")), ignorenulls=True).over(later))
    label = t.u_trim(F.regexp_replace(F.regexp_replace("raw", r"(?U)\s+\z", ""), "[：:]\\z", ""))
    starts = t.is_list_item(F.col("next")) | F.col("next").rlike(r"^(?U)\s*(?:`{3}|~{3}|\|)")
    rows = open_lines.filter(~F.col("kind").isin("fence", "quote", "heading", "list") & F.col("raw").rlike(r"[：:](?U)\s*\z") & starts)
    return rows.withColumn("label", label).filter((F.length("label") > 0) & (F.length("label") <= 40)).select("doc_id", "line", "raw", "label")
