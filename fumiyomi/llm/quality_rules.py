"""Quality rules (op 2): line frequency across documents, beside counts of words, symbols and repeats.

Lines are normalised (lower case, white space runs as one blank, trimmed) and hashed to 64 bits. A line that more than
MAX_DOCS documents of one host (the source) hold is boilerplate and is removed from them; a document that loses more
than half of its words, or keeps fewer than MIN_WORDS, is rejected. A document counts once for a line, however often it
repeats it, so counting needs one row a document and line, summed before the shuffle.

Null texts have no words and fail. A null host is a host of its own. Repeated rows count as documents each.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.common import documents, map_texts, placed, words, written

#: Documents of a host that may hold the same line.
MAX_DOCS = 100
MIN_WORDS = 10
#: Share of words that may be lost to removed lines.
MAX_LOST = 0.5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5


def line_hash(line: str) -> int | None:
    """Signed 64 bits of the normalised line; None where it has no word."""
    parts = words(line.lower())
    return xxhash.xxh3_64_intdigest(" ".join(parts)) - (1 << 63) if parts else None


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    found = words(text)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n = len(found)
    repeated = 0
    if n > WINDOW:
        grams = list(zip(*(found[k:] for k in range(WINDOW)), strict=False))
        if len(set(grams)) < len(grams):
            seen: dict = {}
            for g in grams:
                seen[g] = seen.get(g, 0) + 1
            reach = 0  # words up to here are counted
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeated += i + WINDOW - max(i, reach)
                    reach = i + WINDOW
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row for each document: row (its number), doc_id, host, base counts, and its different lines: hashes and the words they hold."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text in frame["text"]:
            lines: dict[int, int] = {}
            for line in text.split("\n") if text else ():
                if (h := line_hash(line)) is not None:
                    lines[h] = lines.get(h, 0) + len(words(line))
            rows.append((*base_counts(text), list(lines), list(lines.values())))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line", "line_words")
        return pd.DataFrame({k: frame[k] for k in ("row", "doc_id", "host")} | {k: pd.Series([r[i] for r in rows], index=frame.index) for i, k in enumerate(names)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line array<long>, line_words array<long>"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(host).cast("string").alias("host"), "text")
    return map_texts(numbered, run, schema)


def line_rows(counted: DataFrame) -> DataFrame:
    return counted.select("row", "host", F.explode(F.arrays_zip("line", "line_words")).alias("x")).select("row", "host", F.col("x.line").alias("line"), F.col("x.line_words").alias("line_words"))


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, line, n_docs of the lines above the limit."""
    return lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > max_docs)


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST, host: str = "source") -> DataFrame:
    """doc_id, counts, n_removed_words, base_failed and kept for each row of docs (doc_id, text and the host column)."""
    counted = written(measured(docs, host), "lines")
    lines = line_rows(counted)
    frequent = frequent_lines(lines, max_docs).withColumnsRenamed({"host": "h", "line": "l"})
    lost = lines.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).groupBy("row").agg(F.sum("line_words").alias("lost"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    gone = F.coalesce("lost", F.lit(0))
    depleted = (gone > max_lost * F.col("n_words")) | (F.col("n_words") - gone < MIN_WORDS)
    return counted.drop("line", "line_words").join(lost, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone.alias("n_removed_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, host: str = "source") -> DataFrame:
    """docs with the lines above the limit cut out of text; all other columns and rows stay."""
    keyed = placed(docs, "_row")

    @F.pandas_udf("array<long>")
    def hashed(text: pd.Series) -> pd.Series:
        return pd.Series([[h for h in dict.fromkeys(map(line_hash, t.split("\n"))) if h is not None] if t else [] for t in text], dtype=object)

    lines = keyed.select("_row", F.col(host).cast("string").alias("h"), F.explode(hashed("text")).alias("l"))
    frequent = lines.groupBy("h", "l").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_docs).withColumnsRenamed({"h": "h2", "l": "l2"})
    bad = lines.join(frequent, F.col("h").eqNullSafe(F.col("h2")) & (F.col("l") == F.col("l2"))).groupBy("_row").agg(F.collect_set("l").alias("_bad"))

    def rest(text: str, bad: set) -> str:
        return "\n".join(x for x in text.split("\n") if line_hash(x) not in bad)

    @F.pandas_udf("string")
    def without(text: pd.Series, bad: pd.Series) -> pd.Series:
        return pd.Series([t if b is None or t is None else rest(t, set(b)) for t, b in zip(text, bad, strict=True)], dtype=object)

    return keyed.join(bad, "_row", "left").withColumn("text", without("text", "_bad")).drop("_row", "_bad")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
