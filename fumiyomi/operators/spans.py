"""Places of findings: bytes of a line, columns (code points from 1) and excerpts, as native expressions.

A line's bytes are an index of their own: as many code points begin before a byte as the bytes before it decode to, and a byte
that goes on with a code point is no place at all. So columns are null off a boundary, as is the whole span where it is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumiyomi.functions import text as t

#: What a finding's place consists of.
SPAN = ["start_byte", "end_byte", "start_column", "end_column"]
#: What may be put in the place of which bytes.
SUGGESTION = ["fix_start", "fix_end", "fix_start_column", "fix_end_column", "preimage", "replacement"]


def sliced(raw: Column, start: Column, end: Column | None = None) -> Column:
    """The text of bytes start to end (to the end of the line), which are boundaries."""
    size = F.octet_length(raw) if end is None else end - start
    return F.decode(F.substring(F.encode(raw, "UTF-8"), start + 1, size), "UTF-8")


def on_boundary(raw: Column, byte: Column) -> Column:
    """Whether a byte of a line begins a code point or is the line's end."""
    next_ = F.hex(F.substring(F.encode(raw, "UTF-8"), byte + 1, F.lit(1)))
    return F.coalesce((byte >= 0) & (byte <= F.octet_length(raw)) & ~next_.between("80", "BF"), F.lit(False))


def column_at(raw: Column, byte: Column) -> Column:
    """The column of a byte; null where no code point begins."""
    return F.when(on_boundary(raw, byte), F.length(sliced(raw, F.lit(0), byte)) + 1)


def excerpt(raw: Column, start: Column, end: Column, around: int = 10) -> Column:
    """The text of bytes start to end with so many code points on either side, trimmed; null off boundaries."""
    before, inside = sliced(raw, F.lit(0), start), sliced(raw, start, end)
    whole = F.concat(F.right(before, F.lit(around)), F.left(sliced(raw, start), F.length(inside) + around))
    return F.when(on_boundary(raw, start) & on_boundary(raw, end) & (start <= end), t.u_trim(whole))


def with_columns(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """start_column and end_column from start_byte and end_byte of the line; both null where either is, or the span is empty."""
    line = F.col(raw)
    a, b = column_at(line, F.col("start_byte")), column_at(line, F.col("end_byte"))
    whole = a.isNotNull() & b.isNotNull() & (F.col("start_byte") < F.col("end_byte"))
    return rows.withColumns({"start_column": F.when(whole, a).cast("int"), "end_column": F.when(whole, b).cast("int")})


def checked(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Suggestions only where the line holds what they would replace."""
    line = F.col(raw)
    place = on_boundary(line, F.col("fix_start")) & on_boundary(line, F.col("fix_end")) & (F.col("fix_start") < F.col("fix_end"))
    same = F.coalesce(F.when(place, sliced(line, F.col("fix_start"), F.col("fix_end")) == F.col("preimage")), F.lit(False))
    rows = rows.withColumns({"fix_start_column": column_at(line, F.col("fix_start")).cast("int"), "fix_end_column": column_at(line, F.col("fix_end")).cast("int")})
    return rows.withColumns({c: F.when(same & F.col("replacement").isNotNull(), F.col(c)) for c in SUGGESTION})


def in_lines(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with bytes of their lines get columns, checked suggestions and, where they have none, the text as excerpt. Only lines
    with such findings are met."""
    placed = findings.filter("start_byte is not null")
    rows = placed.join(lines.select("doc_id", "line", F.col("raw").alias("_raw")), ["doc_id", "line"])
    rows = checked(with_columns(rows, "_raw"), "_raw")
    raw = F.col("_raw")
    said = F.when(on_boundary(raw, F.col("start_byte")) & on_boundary(raw, F.col("end_byte")), sliced(raw, F.col("start_byte"), F.col("end_byte")))
    rows = rows.withColumn("excerpt", F.coalesce("excerpt", said, F.lit(""))).select(*findings.columns)
    return findings.filter("start_byte is null").withColumn("excerpt", F.coalesce("excerpt", F.lit(""))).unionByName(rows)
