"""Frames of a document collection: lines, sentences, paragraphs; each a DataFrame keyed by doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fumiyomi.functions.text import TERMINATORS, is_blank, u_trim

_SEGMENT = f"[^{TERMINATORS}]*[{TERMINATORS}]|[^{TERMINATORS}]+"


def lines(docs: DataFrame) -> DataFrame:
    """Numbered lines; the empty one after a final break, too."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(F.split("text", "\n", -1)).alias("line", "raw")).withColumn("line", F.col("line") + 1)


def sentence_rows(lined: DataFrame, text: str = "raw") -> DataFrame:
    """Sentences of lines, without their order in the document: line, pos, segment, sentence, end_mark. No shuffle."""
    rest = [c for c in lined.columns if c not in ("masked", "raw", "kind")]
    cut = lined.select(*rest, F.posexplode(F.regexp_extract_all(text, F.lit(_SEGMENT), 0)).alias("pos", "segment"))
    mark = F.regexp_extract("segment", f"[{TERMINATORS}]\\z", 0)
    rows = cut.withColumn("end_mark", F.when(mark != "", mark)).withColumn("sentence", u_trim(F.regexp_replace("segment", f"[{TERMINATORS}]\\z", "")))
    return rows.filter("sentence <> ''")


def sentences(masked: DataFrame, rest: tuple[str, ...] = ()) -> DataFrame:
    """Sentences of structured lines with their place: sent_idx in the document, byte_start in the line, and raw_text, the raw
    bytes at that place. rest: columns of lines that go along. One shuffle, by doc_id. A sentence takes its line along only where
    something of the line is masked; else the sentence itself is what stands there, and a line of many sentences stays one line."""
    hidden = F.when(F.col("masked") != F.col("raw"), F.col("raw")).alias("raw")
    cut = masked.select("doc_id", *rest, "line", hidden, F.posexplode(F.regexp_extract_all("masked", F.lit(_SEGMENT), 0)).alias("pos", "segment"))
    mark = F.regexp_extract("segment", f"[{TERMINATORS}]\\z", 0)
    body = F.regexp_replace("segment", f"[{TERMINATORS}]\\z", "")
    place = Window.partitionBy("doc_id").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, 0)
    in_line = Window.partitionBy("doc_id", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.select("doc_id", *rest, "line", "raw", "pos", F.octet_length("segment").alias("size"), body.alias("body"), F.when(mark != "", mark).alias("end_mark"), u_trim(body).alias("sentence"))
    # the window by document first: its partitioning serves the one by line, too
    rows = rows.withColumn("sent_idx", F.sum((F.col("sentence") != "").cast("int")).over(place).cast("int"))
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(in_line), F.lit(0))).filter("sentence <> ''")
    lead = F.octet_length("body") - F.octet_length(F.regexp_replace("body", r"(?U)^\s+", ""))
    slice_ = F.decode(F.substring(F.encode("raw", "UTF-8"), F.col("before").cast("int") + 1, F.octet_length("body")), "UTF-8")
    return rows.select("doc_id", *rest, "sent_idx", "line", "sentence", F.coalesce(u_trim(slice_), "sentence").alias("raw_text"), "end_mark", (F.col("before") + lead).cast("long").alias("byte_start"))


def paragraphs(lined: DataFrame, text: str = "masked") -> DataFrame:
    """Lines with text, with the number of their paragraph: a run of lines that aren't blank."""
    order = Window.partitionBy("doc_id").orderBy("line")
    before = F.sum(is_blank(F.col(text)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = lined.withColumn("gap", before).filter(~is_blank(F.col(text)))
    return rows.withColumn("para", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("gap"))).drop("gap")
