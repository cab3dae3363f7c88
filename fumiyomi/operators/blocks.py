"""Lines of Markdown with their kind and masked form, as native expressions: no function of Python, and no shuffle.

Which block a line stands in is a matter of all lines before it: front matter, or a fence of some sign and length, or neither. Only
few lines change that state (marks). What a stretch of marks does to any state is a small value of its own, and two such values
compose to the one of both stretches together. So a document's marks are folded in groups, the groups' values give the state
each group begins in, and then the groups tell their changes apart from each other. Lines are cut into segments at the changes
and a segment's lines get their kind one by one. The cost is linear in lines, and a document's rows can be dealt out as they are.

Masks keep every byte's place: a masked span becomes as many blanks as it has bytes, a masked line the empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fumiyomi.functions import text as t

#: Marks of a group.
GROUP = 512
# Patterns of Markdown that masks depend on.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
MARK = r"^(?U)\s*(`{3,}|~{3,})"
RULE = r"^(?U)\s*---\s*\z"
CODE = r"``[^\n]*?``|`[^`\n]+`"
TAG = r"</?[A-Za-z][A-Za-z0-9-]*(?:(?U:\s)[^>\n]*)?/?>"
URL = r"(?<=\]\()[^)]+(?=\))"
# End of the fixed values.
#: Lines of some kind begin so, or hold a bar.
SIGN = r"^(?U)\s*[-#*+0-9>|\[]"

#: A state: 0 none, -1 front matter, else twice the length of the open fence, plus one for tildes.
STATE = "bigint"
MARKS = f"array<struct<line:{STATE},code:{STATE},rule:boolean>>"
#: What marks do: to no block, to front matter, and to fences of backticks and tildes: the state from the first mark on that is
#: long enough to close it, for rising lengths.
EFFECT = f"struct<none:{STATE},matter:{STATE},ticks:array<struct<size:{STATE},then:{STATE}>>,tildes:array<struct<size:{STATE},then:{STATE}>>>"


def bound(value: Column, use) -> Column:
    """use(value), with the value made once for all places that use it."""
    return F.transform(F.array(value), use)[0]


def blanked(c: Column, pattern: str, breaks: bool = False) -> Column:
    """Matches as blanks, byte for byte; where they can hold line breaks, these stay."""

    def blank(x: Column) -> Column:
        if not breaks:
            return F.repeat(F.lit(" "), F.octet_length(x))
        return F.array_join(F.transform(F.split(x, "\n", -1), lambda p: F.repeat(F.lit(" "), F.octet_length(p))), "\n")

    found = F.concat(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), blank), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(c, pattern, -1), found, lambda a, b: F.concat(a, b)), "")


def uncommented(text: Column) -> Column:
    """Comments as blanks; an open one reaches to the end."""
    return F.when(F.contains(text, F.lit("<!--")), blanked(text, COMMENT, breaks=True)).otherwise(text)


def marks(bare: Column) -> Column:
    """The lines (an array) that can change the state: number, code of the fence they open (0: none), whether they are a rule."""

    def mark(x: Column, i: Column) -> Column:
        run = F.regexp_extract(x, MARK, 1)
        code = F.when(run == "", F.lit(0)).otherwise(F.length(run) * 2 + F.startswith(run, F.lit("~")).cast("int"))
        return F.struct((i + 1).cast(STATE).alias("line"), code.cast(STATE).alias("code"), x.rlike(RULE).alias("rule"))

    able = F.transform(bare, lambda x, i: F.when(F.contains(x, F.lit("```")) | F.contains(x, F.lit("~~~")) | F.contains(x, F.lit("---")), mark(x, i)))
    return F.filter(able, lambda x: x.isNotNull() & ((x["code"] > 0) | x["rule"])).cast(MARKS)


def stepped(state: Column, x: Column) -> Column:
    """The state after a mark."""
    opens = F.when((x["line"] == 1) & x["rule"], F.lit(-1)).otherwise(x["code"])
    closes = (x["code"] >= state) & ((x["code"] - state) % 2 == 0)
    return F.when(state == 0, opens).when(state == -1, F.when(x["rule"] & (x["line"] > 1), F.lit(0)).otherwise(state)).when(closes, F.lit(0)).otherwise(state).cast(STATE)


def effect(group: Column) -> Column:
    """What a group of marks does to any state."""

    def closing(before: Column, x: Column, odd: int) -> Column:
        later = F.transform(before, lambda r: F.struct(r["size"].alias("size"), stepped(r["then"], x).alias("then")))
        longest = F.coalesce(F.try_element_at(before, F.lit(-1))["size"], F.lit(0))
        new = F.array(F.struct((x["code"] - odd).cast(STATE).alias("size"), F.lit(0).cast(STATE).alias("then")))
        return F.when((x["code"] > 0) & (x["code"] % 2 == odd) & (x["code"] - odd > longest), F.concat(later, new)).otherwise(later)

    def more(e: Column, x: Column) -> Column:
        return F.struct(stepped(e["none"], x).alias("none"), stepped(e["matter"], x).alias("matter"), closing(e["ticks"], x, 0).alias("ticks"), closing(e["tildes"], x, 1).alias("tildes")).cast(EFFECT)

    start = F.struct(F.lit(0).alias("none"), F.lit(-1).alias("matter"), F.array().alias("ticks"), F.array().alias("tildes")).cast(EFFECT)
    return F.aggregate(group, start, more)


def applied(e: Column, state: Column) -> Column:
    """The state that an effect leads to."""
    fence = F.when(state % 2 == 0, e["ticks"]).otherwise(e["tildes"])
    closed = F.try_element_at(F.filter(fence, lambda r: r["size"] >= state - state % 2), F.lit(1))["then"]
    return F.when(state == 0, e["none"]).when(state == -1, e["matter"]).otherwise(F.coalesce(closed, state)).cast(STATE)


EVENTS = f"array<struct<line:{STATE},state:{STATE}>>"


def events(found: Column) -> Column:
    """The marks that change the state, with the state after them."""
    starts_of = f"struct<state:{STATE},out:array<{STATE}>>"
    told_of = f"struct<state:{STATE},out:{EVENTS}>"

    def starts(groups: Column) -> Column:
        begin = F.struct(F.lit(0).alias("state"), F.array().alias("out")).cast(starts_of)
        step = lambda acc, e: F.struct(applied(e, acc["state"]).alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out")).cast(starts_of)
        return F.aggregate(F.transform(groups, effect), begin, step)["out"]

    def told(group: Column, state: Column) -> Column:
        begin = F.struct(state.alias("state"), F.array().alias("out")).cast(told_of)

        def step(acc: Column, x: Column) -> Column:
            then = stepped(acc["state"], x)
            changed = F.concat(acc["out"], F.array(F.struct(x["line"].alias("line"), then.alias("state"))).cast(EVENTS))
            return F.struct(then.alias("state"), F.when(then == acc["state"], acc["out"]).otherwise(changed).alias("out")).cast(told_of)

        return F.aggregate(group, begin, step)["out"]

    def grouped(m: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / GROUP).cast("int")), lambda g: F.slice(m, g * GROUP + 1, F.lit(GROUP)))
        return bound(groups, lambda g: F.flatten(F.zip_with(g, starts(g), told)))

    return bound(found, lambda m: F.when(F.size(m) == 0, F.array().cast(EVENTS)).otherwise(grouped(m)))


def segments(pairs: Column, changes: Column) -> Column:
    """The lines (an array) cut where the state changes: state, number of the first line, lines."""
    n = F.size(pairs).cast(STATE)

    def cut(state: Column, first: Column, last: Column) -> Column:
        return F.struct(state.cast(STATE).alias("state"), first.cast(STATE).alias("first"), F.slice(pairs, first.cast("int"), F.greatest(F.lit(0), last - first + 1).cast("int")).alias("lines"))

    def each(e: Column, k: Column) -> Column:
        after = F.try_element_at(changes, k + 2)
        # a block's last line is its own, so what follows begins a line later and ends before the next block
        return F.when(e["state"] == 0, cut(e["state"], e["line"] + 1, F.coalesce(after["line"] - 1, n))).otherwise(cut(e["state"], e["line"], F.coalesce(after["line"], n)))

    before = cut(F.lit(0), F.lit(1), F.coalesce(F.try_element_at(changes, F.lit(1))["line"] - 1, n))
    return F.filter(F.concat(F.array(before), F.transform(changes, each)), lambda s: F.size(s["lines"]) > 0)


def kind_of(bare: Column) -> Column:
    """What a line outside blocks is. Few lines begin with a sign of any kind, and only these are tested for each."""
    kinds = [("heading", t.is_heading), ("list", t.is_list_item), ("quote", t.is_quote), ("table", t.is_table), ("embed", t.is_embed), ("reference", t.is_reference), ("code_note", t.is_code_note)]
    out = F.when(~(bare.rlike(SIGN) | F.contains(bare, F.lit("|"))), F.when(t.is_blank(bare), "blank").otherwise("text"))
    for name, test in kinds:
        out = out.when(test(bare), name)
    return out.otherwise("text")


def structured(docs: DataFrame, keep_headings: bool = False) -> DataFrame:
    """docs with one row a line: line, raw, masked and kind take the place of text. A null text has no lines."""
    rest = [c for c in docs.columns if c != "text"]
    commented = F.contains("text", F.lit("<!--"))
    raw = F.split("text", "\n", -1)
    pairs = F.when(commented, F.zip_with(raw, F.split(uncommented(F.col("text")), "\n", -1), lambda a, b: F.struct(a.alias("raw"), b.alias("bare"))))
    pairs = pairs.otherwise(F.transform(raw, lambda a: F.struct(a.alias("raw"), a.alias("bare"))))
    whole = F.transform(F.array(pairs), lambda p: bound(events(marks(F.transform(p, lambda x: x["bare"]))), lambda e: segments(p, e)))[0]
    cut = docs.select(*rest, F.explode(whole).alias("_s")).select(*rest, F.col("_s.state").alias("_state"), F.col("_s.first").alias("_first"), F.posexplode("_s.lines").alias("_at", "_x"))
    rows = cut.select(*rest, (F.col("_first") + F.col("_at")).cast("int").alias("line"), F.col("_x.raw").alias("raw"), F.col("_x.bare").alias("_bare"), "_state")
    kind = F.when(F.col("_state") == -1, "front_matter").when(F.col("_state") > 0, "fence").otherwise(kind_of(F.col("_bare")))
    rows = rows.withColumn("kind", kind)
    open_ = F.col("kind").isin("text", "blank", "heading") if keep_headings else F.col("kind").isin("text", "blank")
    rows = rows.withColumn("masked", F.when(open_, F.col("_bare")).otherwise(""))
    for sign, pattern in (("`", CODE), ("<", TAG), ("](", URL)):  # a column a step: each names the one before several times
        rows = rows.withColumn("masked", F.when(F.contains("masked", F.lit(sign)), blanked(F.col("masked"), pattern)).otherwise(F.col("masked")))
    return rows.select(*rest, "line", "raw", "masked", "kind")
