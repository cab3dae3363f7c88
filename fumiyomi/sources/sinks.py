"""Sinks: findings and reports as JSON, SARIF, annotation lines or plain text; and the exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumiyomi import __version__
from fumiyomi import model as m
from fumiyomi.functions.text import escape_data, escape_property
from fumiyomi.operators.surface import FINDING


def severity_rank(c: Column) -> Column:
    return F.coalesce(*[F.when(c == s, F.lit(k)) for s, k in m.SEVERITY_RANK.items()])


def rule_order(c: Column) -> Column:
    """Place of a category in the order of findings."""
    return F.coalesce(*[F.when(c == s, F.lit(k)) for s, k in m.ORDER.items()])


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("doc_id", "line", rule_order(F.col("category")), "start_byte")


def place_of(x: Column, start: str = "start", end: str = "end") -> Column:
    """The span of a finding (a struct) as reports have it; null where columns are unknown."""
    byte = lambda k: x[f"{k}_byte"] if k in ("start", "end") else x[k]
    line = x["line"]
    whole = F.struct(line.alias("start_line"), x[f"{start}_column"].alias("start_column"), line.alias("end_line"), x[f"{end}_column"].alias("end_column"), byte(start).alias("start_byte"), byte(end).alias("end_byte"))
    return F.when(x[f"{start}_column"].isNotNull() & x[f"{end}_column"].isNotNull(), whole)


def reported(x: Column) -> Column:
    """A finding (a struct) as reports have it."""
    fix = F.when(x["preimage"].isNotNull(), F.struct(place_of(x, "fix_start", "fix_end").alias("span"), x["preimage"].alias("preimage"), x["replacement"].alias("replacement")))
    return F.struct(*[x[c].alias(c) for c in ("line", "category", "excerpt", "severity", "value")], place_of(x).alias("span"), fix.alias("suggestion"))


def counted(f: Column) -> Column:
    """How many findings of an array each category has."""
    names = F.array_sort(F.array_distinct(F.transform(f, lambda x: x["category"])))
    return F.map_from_arrays(names, F.transform(names, lambda c: F.size(F.filter(f, lambda x: x["category"] == c))))


def json_reports(findings: DataFrame, docs: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One JSON object a document: file, version, stats (with the measures of stats: doc_id, stats, experimental), findings, and the
    reading-load lane with counts of its own. Fields without a value are left out; a document without findings has empty lists."""
    own = [c for c in FINDING if c not in ("doc_id", "line", "category", "start_byte")]
    item = F.struct("line", rule_order(F.col("category")).alias("o"), "start_byte", "category", *own, "lane")
    grouped = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("f"))
    rows = docs.select("doc_id", "genre").join(grouped, "doc_id", "left")
    measured, sentences = [], []
    if stats is not None:
        rows = rows.join(stats.select("doc_id", "stats", "experimental"), "doc_id", "left")
        measured, sentences = ["stats.*", F.coalesce("experimental", F.lit(False)).alias("experimental")], [F.coalesce("stats.total_sentences", F.lit(0)).alias("sentences")]
    rows = rows.withColumn("f", F.coalesce("f", F.array().cast(grouped.schema["f"].dataType)))
    rows = rows.withColumns({"main": F.filter("f", lambda x: x["lane"] == "main"), "reading": F.filter("f", lambda x: x["lane"] != "main")})
    main, reading = F.col("main"), F.col("reading")
    head = F.struct(F.size(main).alias("total_findings"), counted(main).alias("by_category"), F.col("genre").alias("genre"), *measured)
    load = F.struct(F.struct(F.size(reading).alias("total"), *sentences, F.col("genre").alias("genre"), counted(reading).alias("by_category")).alias("stats"), F.transform(reading, reported).alias("findings"))
    out = F.struct(F.col("doc_id").cast("string").alias("file"), F.lit(__version__).alias("version"), head.alias("stats"), F.transform(main, reported).alias("findings"), load.alias("reading_load"))
    return rows.select("doc_id", F.to_json(out).alias("json"))


def annotations(findings: DataFrame) -> DataFrame:
    """Annotation lines of a build service, with columns where they are known."""
    level = F.when(F.col("lane") == "reading_load", "notice").when(F.col("severity") == "critical", "error").when(F.col("severity") == "warn", "warning").otherwise("notice")
    line = F.col("line").cast("string")
    at = F.when(F.col("start_column").isNull(), F.concat(F.lit(",line="), line)).otherwise(
        F.concat(F.lit(",line="), line, F.lit(",endLine="), line, F.lit(",col="), F.col("start_column").cast("string"), F.lit(",endColumn="), F.col("end_column").cast("string"))
    )
    text = F.concat(F.lit("::"), level, F.lit(" file="), escape_property(F.col("doc_id").cast("string")), at, F.lit(",title="), escape_property(F.col("category")), F.lit("::"), escape_data(F.col("excerpt")))
    return findings.select("doc_id", "line", "category", text.alias("annotation"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """doc_id, line, o, category and the SARIF result (a struct) of each finding; the reading-load lane never is more than a note."""
    level = F.when(F.col("lane") == "reading_load", "note").when(F.col("severity") == "critical", "error").when(F.col("severity") == "warn", "warning").otherwise("note")
    known = F.col("start_column").isNotNull()
    region = F.struct(F.col("line").alias("startLine"), F.col("start_column").alias("startColumn"), F.when(known, F.col("line")).alias("endLine"), F.col("end_column").alias("endColumn"))
    result = F.struct(
        F.col("category").alias("ruleId"), level.alias("level"), F.struct(F.col("excerpt").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    return findings.select("doc_id", "line", rule_order(F.col("category")).alias("o"), "start_byte", "category", result.alias("r"))


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 log over all findings of a document, as JSON."""
    rows = sarif_results(findings).select("doc_id", "category", F.struct("line", "o", "start_byte", "r").alias("x"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("category")).alias("rules"), F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("results"))
    driver = F.struct(F.lit("fumiyomi").alias("name"), F.lit(__version__).alias("version"), F.transform("rules", lambda c: F.struct(c.alias("id"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.lit("unicodeCodePoints").alias("columnKind"), F.col("results"))
    return docs.select("doc_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def breakdown(findings: DataFrame) -> DataFrame:
    """Findings by document and category, most frequent first within a document."""
    return findings.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n")).orderBy("doc_id", F.col("n").desc(), "category")


def exit_code(findings: DataFrame, fail_on: str | None) -> int:
    """2 if a finding of the main lane is as severe as asked, else 0."""
    if fail_on is None:
        return 0
    return 2 if findings.filter((F.col("lane") == "main") & (severity_rank(F.col("severity")) >= m.SEVERITY_RANK[fail_on])).head(1) else 0
