"""Text from web pages and scanned books, as chains of native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumiyomi.functions import text as t

_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]


def unescaped(c: Column) -> Column:
    """Named entities, then numbered ones: split at them, so each code is turned where it stands."""
    for a, b in _ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    pattern = "&#(?:[0-9]{1,7}|x[0-9a-fA-F]{1,6});"
    codes, parts = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)

    def char(x: Column) -> Column:
        number = F.when(x.startswith("&#x"), F.conv(F.regexp_extract(x, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(x, "([0-9]+);", 1)).cast("int")
        hexed = F.lpad(F.hex(number), 8, "0")
        return F.decode(F.unhex(hexed), "UTF-32")

    turned = F.concat(F.transform(codes, char), F.array(F.lit("")))
    return F.when(F.size(codes) == 0, c).otherwise(F.array_join(F.zip_with(parts, turned, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), ""))


def article(html: Column) -> Column:
    """The article, else the main part, else all of a page."""
    found = [F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1) for tag in ("article", "main")]
    return F.when(found[0] != "", found[0]).when(found[1] != "", found[1]).otherwise(html)


def _heading_text(x: Column) -> Column:
    """Text of a heading's HTML: no tags, white space as single blanks."""
    return t.u_trim(F.regexp_replace(unescaped(F.regexp_replace(x, "<[^>]+>", "")), r"(?U)\s+", " "))


def with_marks(html: Column) -> Column:
    """Headings as lines with marks; those without text are left out."""
    pattern = r"(?is)<h([1-6])[^>]*>.*?</h\1>"
    found, parts = F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), F.split(html, pattern, -1)

    def turned(x: Column) -> Column:
        text = _heading_text(x)
        return F.when(text == "", "").otherwise(F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(x, 3, 1).cast("int")), F.lit(" "), text, F.lit("\n\n")))

    rest = F.concat(F.transform(found, turned), F.array(F.lit("")))
    return F.when(F.size(found) == 0, html).otherwise(F.array_join(F.zip_with(parts, rest, lambda p, x: F.concat(p, x)), ""))


def stripped(html: Column) -> Column:
    """Text of HTML: no scripts and styles, headings with marks, breaks and paragraphs as lines, no tags; lines trimmed, one blank line between."""
    c = with_marks(F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", ""))
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, "(?i)</p>", "\n\n")
    c = unescaped(F.regexp_replace(c, "<[^>]+>", ""))
    lines = F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")), lambda x: x != "")
    return F.array_join(lines, "\n\n")


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", stripped(article(F.col("html"))).alias("text"))


def title(html: Column) -> Column:
    return F.regexp_replace(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"(?U)^\s+|\s+\z", "")


def headings(pages: DataFrame) -> DataFrame:
    """page_id, nth, level, text of the headings of each page that have a text."""
    pattern = r"(?is)<h([1-6])[^>]*>.*?</h\1>"
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("nth", "x"))
    return rows.select("page_id", "nth", F.substring("x", 3, 1).cast("int").alias("level"), _heading_text(F.col("x")).alias("text")).filter("text <> ''")


# Fixed value: lines of page numbers.
PAGE_NUMBER = r"[-‐―ー0-9０-９ページPage/\s.]{1,10}"


def without_running_lines(pages: DataFrame) -> DataFrame:
    """Lines of a book's pages, trimmed, but for blank ones, page numbers and running heads: lines of 40 characters at most that
    stand on half of the pages (rounded down), three at least, of a book of over two. pages: book, page, line, text."""
    n = pages.select("book", "page").distinct().groupBy("book").agg(F.count(F.lit(1)).alias("pages"))
    own = pages.withColumn("text", t.u_trim(F.col("text"))).filter("text <> ''")
    # a line counts once a page, and is dropped early where it can't be on enough of them
    often = own.filter(F.length("text") <= 40).select("book", "text", "page").distinct().groupBy("book", "text").agg(F.count(F.lit(1)).alias("on")).filter("on >= 3").join(n, "book")
    running = often.filter((F.col("pages") > 2) & (F.col("on") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 2))))
    numbers = (F.length("text") <= 10) & F.col("text").rlike(rf"(?U)^{PAGE_NUMBER}\z")
    return own.filter(~numbers).join(running.select("book", "text"), ["book", "text"], "left_anti")
