"""Sources: documents, configuration, earlier runs, corpus manifests, lexicon tables."""

from __future__ import annotations

import sys
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi import model as m


class InputError(ValueError):
    """What a user can mend: exit code 1."""


def documents(spark: SparkSession, paths: list[str], genre: str | None = None) -> DataFrame:
    """Whole files as rows, in the order given: ord, doc_id (the path), file, genre, text. "-" alone is standard input."""
    if "-" in paths:
        if len(paths) > 1:
            raise InputError("standard input can't be mixed with files")
        rows = spark.createDataFrame([(0, "-", sys.stdin.read())], "ord int, file string, text string")
    else:
        for p in paths:
            at = Path(p)
            if "://" not in p and not at.exists():
                raise InputError(f"{p}: no such file")
            if "://" not in p and not at.is_file():
                raise InputError(f"{p}: not a file")
        full = {(p if "://" in p else Path(p).resolve().as_uri().replace("file:///", "file:/")): i for i, p in enumerate(paths)}
        names = spark.createDataFrame([(k.replace("file:///", "file:/"), i, paths[i]) for k, i in full.items()], "path string, ord int, file string")
        found = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.decode("content", "UTF-8").alias("text"))
        rows = found.join(F.broadcast(names), "path").select("ord", "file", "text")  # as many names as arguments
    return rows.select("ord", F.col("file").alias("doc_id"), "file", F.lit(genre).cast("string").alias("genre"), "text")


@dataclass
class Config:
    version: int = 1
    genre: str | None = None
    fail_on: str | None = None
    disabled_rules: list[str] = field(default_factory=list)
    allow: list[tuple[str, str]] = field(default_factory=list)


def config(path: str | None = None, default: str = ".fumiyomi.toml") -> Config:
    """Settings of a project; unknown keys and rules are errors, and so are allowances without text or reason."""
    at = Path(path or default)
    if not at.exists():
        if path:
            raise InputError(f"{path}: no such file")
        return Config()
    raw = tomllib.loads(at.read_text(encoding="utf-8"))
    if unknown := set(raw) - {"version", "genre", "fail_on", "disabled_rules", "allow"}:
        raise InputError(f"unknown keys: {sorted(unknown)}")
    if raw.get("version", 1) != 1:
        raise InputError("version must be 1")
    allow = []
    for x in raw.get("allow", []):
        if set(x) != {"category", "text", "reason"} or not x["text"].strip() or not x["reason"].strip():
            raise InputError("an allowance has a category, a text and a reason")
        allow.append((x["category"], x["text"]))
    for name in [*raw.get("disabled_rules", []), *(c for c, _ in allow)]:
        if name not in m.BY_NAME:
            raise InputError(f"unknown rule {name}")
    if raw.get("fail_on") not in (None, *m.SEVERITY_RANK):
        raise InputError("fail_on is info, warn or critical")
    return Config(1, raw.get("genre"), raw.get("fail_on"), raw.get("disabled_rules", []), allow)


BASELINE = "file string, version string, stats struct<genre:string,experimental:boolean>, findings array<struct<line:int,category:string,excerpt:string,severity:string>>"


def earlier_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header and findings of an earlier run: JSON of one object or of an array. Of a file given twice the last counts;
    findings without a category or excerpt are left out."""
    rows = spark.read.schema(BASELINE).json(path, multiLine=True).filter("file is not null")
    from fumiyomi.operators.compare import latest

    rows = latest(rows.withColumn("ord", F.monotonically_increasing_id()))
    header = rows.select("file", "version", F.col("stats.genre").alias("genre"), F.coalesce("stats.experimental", F.lit(False)).alias("experimental"))
    found = rows.select("file", F.posexplode("findings").alias("ord", "x")).select("file", "ord", "x.line", "x.category", "x.excerpt", "x.severity")
    return header, found.filter("category is not null and excerpt is not null")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a corpus manifest with their text: id, path, label, genre, split, text. Hashes, ids and labels are verified."""
    at = Path(path)
    raw = tomllib.loads(at.read_text(encoding="utf-8"))
    docs = raw.get("document", [])
    ids = [d["id"] for d in docs]
    if not docs or len(set(ids)) < len(ids):
        raise InputError("a manifest needs documents, with different ids")
    for d in docs:
        if d["label"] not in ("human", "ai") or len(d["sha256"]) != 64:
            raise InputError(f"{d['id']}: label or hash is no good")
    root = at.parent
    rows = spark.createDataFrame([(d["id"], (root / d["path"]).resolve().as_uri(), d["label"], d.get("genre"), d.get("split", "dev"), d["sha256"].lower()) for d in docs], "id string, path string, label string, genre string, split string, sha256 string")
    found = spark.read.format("binaryFile").load([str((root / d["path"]).resolve()) for d in docs])
    key = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    joined = rows.withColumn("key", key("path")).join(found.select(key("path").alias("key"), "content"), "key", "left")
    bad = joined.filter(F.col("content").isNull() | (F.sha2("content", 256) != F.col("sha256"))).select("id").collect()
    if bad:
        raise InputError(f"missing or changed: {[r['id'] for r in bad]}")
    return joined.select("id", "path", "label", "genre", "split", F.decode("content", "UTF-8").alias("text"))


def external(sources: DataFrame, lock: DataFrame) -> DataFrame:
    """Counts by split of web sources that the lock has with a hash (used), without one (unfetched), or lacks (missing)."""
    rows = sources.filter("type = 'web'").join(lock.withColumn("locked", F.lit(True)), "id", "left")
    return rows.groupBy("split").agg(
        F.count_if(F.col("locked").isNull()).alias("missing"), F.count_if(F.col("locked") & F.col("sha256").isNull()).alias("unfetched"),
        F.count_if(F.col("sha256").isNotNull()).alias("used"),
    )


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon table (CSV with a header)."""
    return spark.read.csv(path, header=True, schema="surface string, pos1 string, pos2 string, pos3 string, lemma string, reading string, kind string", encoding="UTF-8")


def lexicon_index(words: DataFrame) -> DataFrame:
    """Entries by surface, and how many: what a lookup of a text's prefixes needs."""
    return words.groupBy("surface").agg(F.count(F.lit(1)).alias("entries"), F.array_join(F.array_sort(F.collect_set("pos1")), "/").alias("pos1"))


def connection_costs(spark: SparkSession, path: str) -> DataFrame:
    """A text matrix: a line with both sizes, then left, right and cost by line."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(parts) == 3).select(*[F.get(parts, i).cast("int").alias(n) for i, n in enumerate(("left", "right", "cost"))])


def char_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Ranges of code points with their class: lines like 0x3041..0x309F HIRAGANA."""
    pattern = r"^0x([0-9A-Fa-f]+)(?:\.\.0x([0-9A-Fa-f]+))?\s+(\w+)"
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern))
    code = lambda i: F.conv(F.nullif(F.regexp_extract("value", pattern, i), F.lit("")), 16, 10).cast("int")
    return rows.select(code(1).alias("lo"), F.coalesce(code(2), code(1)).alias("hi"), F.regexp_extract("value", pattern, 3).alias("kind"))
