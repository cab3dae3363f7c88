"""Rules on token frames: one row a token, with doc_id, sent_idx, tok_idx, line, surface, pos1 to pos3, lemma, reading.

Neighbours are lag and lead within a sentence, so every rule is one window over one partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fumiyomi import model as m
from fumiyomi.functions import text as t
from fumiyomi.operators import spans
from fumiyomi.operators.measures import document_rules, reading_load, reading_marks
from fumiyomi.operators.surface import cleft_marks, finding

SENTENCE = ["doc_id", "sent_idx"]


def order() -> Window:
    return Window.partitionBy(*SENTENCE).orderBy("tok_idx")


def punctuation(c: str = "pos1") -> Column:
    return F.col(c).isin(m.PUNCTUATION_POS)


def after(name: str, k: int = 1) -> Column:
    return F.lead(name, k).over(order()) if k > 0 else F.lag(name, -k).over(order())


def mora(reading: Column) -> Column:
    """Characters of a reading but small vowels and glides."""
    return F.length(F.regexp_replace(reading, f"[{m.SMALL_KANA}]", "")).cast("long")


def _bytes(rows: DataFrame, places: dict[str, tuple[str, int]]) -> DataFrame:
    """Bytes of neighbours in the sentence, where tokens know theirs; before the sentence's first token stands that one. Bytes of the
    line, where tokens know at which the sentence begins (sent_at)."""
    if "byte_start" not in rows.columns:
        return rows
    first = F.first("byte_start").over(order())
    at = F.col("sent_at") if "sent_at" in rows.columns else F.lit(0)
    return rows.withColumns({name: at + (F.coalesce(after(c, k), first) if k < 0 else after(c, k) if k else F.col(c)) for name, (c, k) in places.items()})


def _kept(rows: DataFrame) -> list[str]:
    return [c for c in ("start_byte", "end_byte", "fix_start", "fix_end") if c in rows.columns]


def koto_ga_dekiru(tokens: DataFrame) -> DataFrame:
    """こと, が and a form of できる; not after a causative."""
    names = [("before", "lemma", -1), ("p1", "surface", 1), ("p1_pos", "pos1", 1), ("p2", "surface", 2), ("p2_pos", "pos1", 2)]
    rows = tokens.withColumns({a: after(c, k) for a, c, k in names})
    rows = _bytes(rows, {"start_byte": ("byte_start", -4), "end_byte": ("byte_end", 2), "fix_start": ("byte_start", -1), "fix_end": ("byte_end", 1)})
    hit = (F.col("surface") == "こと") & (F.col("pos1") == "名詞") & (F.col("p1") == "が") & (F.col("p1_pos") == "助詞") & (F.col("p2_pos") == "動詞") & F.col("p2").startswith("でき")
    rows = rows.filter(hit & ~F.coalesce(F.col("before").isin("せる", "させる"), F.lit(False)))
    # the verb before is する: the phrase can be left out
    shorter = F.when(F.col("before") == "する", F.lit("することが"))
    return rows.select("doc_id", "sent_idx", "tok_idx", "line", F.concat("surface", "p1", "p2").alias("match"), shorter.alias("preimage"), *_kept(rows))


def light_verb(tokens: DataFrame) -> DataFrame:
    """A verbal noun, を and a form of 行う; not passive or causative. replacement: する in the same form."""
    names = [("p1", "surface", 1), ("p1_pos", "pos1", 1), ("verb", "surface", 2), ("verb_lemma", "lemma", 2), ("verb_pos", "pos1", 2), ("aux", "lemma", 3)]
    rows = tokens.withColumns({a: after(c, k) for a, c, k in names})
    rows = _bytes(rows, {"start_byte": ("byte_start", 0), "end_byte": ("byte_end", 2), "fix_start": ("byte_start", 1), "fix_end": ("byte_end", 2)})
    hit = (F.col("pos1") == "名詞") & F.col("pos3").isin("サ変可能", "サ変形状詞可能") & (F.col("p1") == "を") & (F.col("p1_pos") == "助詞") & (F.col("verb_pos") == "動詞") & F.col("verb_lemma").isin("行う", "行なう")
    rows = rows.filter(hit & ~F.coalesce(F.col("aux").isin("れる", "られる", "せる", "させる"), F.lit(False)))
    turned = {"行う": "する", "行い": "し", "行っ": "し", "行なう": "する", "行ない": "し", "行なっ": "し"}
    replacement = F.coalesce(*[F.when(F.col("verb") == a, F.lit(b)) for a, b in turned.items()])
    return rows.select("doc_id", "sent_idx", "tok_idx", "line", F.concat("surface", "p1", "verb").alias("match"), F.concat("p1", "verb").alias("preimage"), replacement.alias("replacement"), *_kept(rows))


def inanimate_morph(tokens: DataFrame) -> DataFrame:
    """A thing as subject, and later in the sentence a verb that wants an agent."""
    rows = tokens.withColumns({"p1": after("surface"), "p1_pos": after("pos1"), "p2": after("surface", 2), "p2_pos": after("pos1", 2), "b1": after("surface", -1)})
    # the next verb: backwards, so that each row adds to the frame instead of reading the rest of the sentence
    later = Window.partitionBy(*SENTENCE).orderBy(F.col("tok_idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("verb", F.last(F.when((F.col("pos1") == "動詞") & F.col("lemma").isin(m.INANIMATE_VERBS), F.col("lemma")), ignorenulls=True).over(later))
    single = F.col("surface").isin("これ", "それ", "あれ", "それら") | (F.col("surface").isin("こと", "事実") & (F.col("pos1") == "名詞"))
    double = ((F.col("surface") == "この") & (F.col("p1") == "事実")) | ((F.col("surface") == "その") & (F.col("p1") == "こと"))
    covered = ((F.col("b1") == "この") & (F.col("surface") == "事実")) | ((F.col("b1") == "その") & (F.col("surface") == "こと"))
    case1 = F.col("p1").isin("が", "は") & (F.col("p1_pos") == "助詞")
    case2 = F.col("p2").isin("が", "は") & (F.col("p2_pos") == "助詞")
    hit = (double & case2) | (single & case1 & ~F.coalesce(covered, F.lit(False)))
    subject = F.when(double & case2, F.concat("surface", "p1")).otherwise(F.col("surface"))
    return rows.filter(hit & F.col("verb").isNotNull()).select("doc_id", "sent_idx", "tok_idx", "line", subject.alias("subject"), "verb")


def _apart(tokens: DataFrame, keep: Column) -> DataFrame:
    """Rows that keep holds for, each with the number of punctuation tokens before it in its sentence."""
    marks = F.sum(punctuation().cast("int")).over(order().rowsBetween(Window.unboundedPreceding, 0))
    return tokens.withColumn("marks", marks).filter(keep)


def no_chain(tokens: DataFrame) -> DataFrame:
    """Three の at most three tokens apart with no punctuation between; the first such place of a sentence."""
    rows = _apart(tokens, (F.col("surface") == "の") & (F.col("pos1") == "助詞"))
    rows = _bytes(rows.withColumns({"i1": after("tok_idx"), "i2": after("tok_idx", 2), "m2": after("marks", 2)}), {"start_byte": ("byte_start", 0), "end_byte": ("byte_end", 2)})
    rows = rows.filter((F.col("i1") - F.col("tok_idx") <= 3) & (F.col("i2") - F.col("i1") <= 3) & (F.col("m2") == F.col("marks")))
    return rows.groupBy(*SENTENCE).agg(F.min("tok_idx").alias("tok_idx"), F.min("line").alias("line"), *[F.min_by(c, "tok_idx").alias(c) for c in _kept(rows)])


def double_negative(tokens: DataFrame) -> DataFrame:
    """Two neighbouring negatives at most six tokens apart with no punctuation between, which are no obligation and no condition; the first of a sentence."""
    joined = F.array_join(F.collect_list("surface").over(Window.partitionBy(*SENTENCE).orderBy("tok_idx").rowsBetween(1, 7)), "")
    rows = tokens.withColumn("tail", joined)
    rows = _apart(rows, F.col("pos1").isin("助動詞", "形容詞") & F.col("lemma").isin(m.NEGATIVES))
    rows = rows.withColumns({"i1": after("tok_idx"), "m1": after("marks"), "s1": after("surface")})
    between = F.concat("surface", "tail")
    obliged = between.rlike(t.any_of(m.OBLIGATION))
    condition = between.rlike("^(?:ない|なけれ|なく)(?:と|ば|ければ)")
    rows = rows.filter((F.col("i1") - F.col("tok_idx") <= 6) & (F.col("m1") == F.col("marks")) & ~obliged & ~condition)
    return rows.groupBy(*SENTENCE).agg(F.min(F.struct("tok_idx", "i1")).alias("x"), F.min("line").alias("line")).select(*SENTENCE, F.col("x.tok_idx").alias("first"), F.col("x.i1").alias("second"), "line")


def buried_list(tokens: DataFrame) -> DataFrame:
    """Items of the longest run of segments between 、 that end with a noun, and the segment after it; three items or more."""
    comma = (F.col("surface") == "、").cast("int")
    seg = F.coalesce(F.sum(comma).over(order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = tokens.withColumn("seg", seg)
    solid = F.when(~punctuation(), F.struct("tok_idx", "pos1"))
    segs = rows.groupBy(*SENTENCE, "seg").agg(F.max(solid).alias("last"), F.max(comma).alias("closed"), F.min("line").alias("line"))
    noun = F.coalesce(F.col("last.pos1").isin("名詞", "代名詞"), F.lit(False)) & (F.col("closed") == 1)
    by_seg = Window.partitionBy(*SENTENCE).orderBy("seg")
    segs = segs.withColumn("noun", noun).withColumn("run", F.sum((~noun).cast("int")).over(by_seg.rowsBetween(Window.unboundedPreceding, 0)))
    runs = segs.filter("noun").groupBy(*SENTENCE, "run").agg(F.count(F.lit(1)).alias("k"), F.min("seg").alias("seg"), F.min("line").alias("line")).filter("k >= 2")
    best = runs.groupBy(*SENTENCE).agg(F.max(F.struct("k", (-F.col("seg")).alias("order"))).alias("x"), F.min("line").alias("line"))
    return best.select(*SENTENCE, (F.col("x.k") + 1).alias("items"), "line")


def kanji_runs(sentences: DataFrame, tokens: DataFrame) -> DataFrame:
    """Runs of seven kanji or more that no proper noun overlaps: an anti-join on the intervals."""
    pattern = "[一-龿々]{7,}"
    parts, found = F.split("sentence", pattern, -1), F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    at = F.transform(found, lambda x, i: F.struct(x.alias("run"), (size(F.slice(parts, 1, i + 1)) + size(F.slice(found, 1, i))).alias("lo")))
    runs = sentences.filter(F.col("sentence").rlike(pattern)).select(*SENTENCE, "line", F.explode(at).alias("x"))
    runs = runs.select(*SENTENCE, "line", F.col("x.run").alias("run"), F.col("x.lo").alias("lo"), (F.col("x.lo") + F.length("x.run")).alias("hi"))
    start = F.coalesce(F.sum(F.length("surface")).over(order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    proper = tokens.withColumn("a", start).filter("pos2 = '固有名詞'").select(*[F.col(c).alias("p_" + c) for c in SENTENCE], "a", (F.col("a") + F.length("surface")).alias("b"))
    same = [F.col(c) == F.col("p_" + c) for c in SENTENCE]
    return runs.join(proper, [*same, F.col("a") < F.col("hi"), F.col("b") > F.col("lo")], "left_anti")


def endings(tokens: DataFrame, marks: DataFrame) -> DataFrame:
    """Mode and signature of each sentence's ending, its mora and paragraph break; marks has end_mark and line of each sentence."""
    solid = ~punctuation()
    w = Window.partitionBy(*SENTENCE).orderBy(F.col("tok_idx").desc())
    rows = tokens.withColumn("mora", mora(F.col("reading"))).withColumn("nth", F.sum(solid.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tail = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(solid & (F.col("nth") <= 8), F.struct("tok_idx", "surface")))), lambda x: x["surface"]), "")
    last = F.max(F.when(solid, F.struct("tok_idx", "surface", "pos1")))
    sents = rows.groupBy(*SENTENCE).agg(tail.alias("tail"), last.alias("last"), F.sum("mora").alias("mora"))
    return ended(marks.join(sents, SENTENCE, "left")).select(*SENTENCE, "line", "mode", "signature", "mora", "noun_ended")


def ended(sents: DataFrame) -> DataFrame:
    """Mode, signature, mora and whether a noun ends it, of sentences with end_mark, mora, tail (the last eight tokens that are no
    punctuation, as text) and last (the last one; null: none)."""
    ends = lambda c, x: c.endswith(x)
    tentative, assertive = t.first_of(F.col("tail"), m.TENTATIVE, ends), t.first_of(F.col("tail"), m.ASSERTIVE, ends)
    asks = F.col("end_mark").isin("？", "?")
    ka = (F.col("last.pos1") == "助詞") & (F.col("last.surface") == "か")
    noun = F.col("last.pos1").isin("名詞", "代名詞")
    bare = F.col("last").isNull()
    mode = F.when(asks, "question").when(bare, "other").when(ka, "question").when(tentative.isNotNull(), "tentative").when(noun, "nominal").when(assertive.isNotNull(), "assertive").otherwise("other")
    sign = F.when(asks, "question_mark").when(bare, "other").when(ka, "particle_ka").when(tentative.isNotNull(), tentative).when(noun, "nominal").when(assertive.isNotNull(), assertive).otherwise("other")
    return sents.withColumns({"mode": mode, "signature": sign, "mora": F.coalesce("mora", F.lit(0).cast("long")), "noun_ended": F.coalesce(noun, F.lit(False))})


def ending_runs(ends: DataFrame, change: list[str]) -> DataFrame:
    """Runs of neighbouring sentences of one paragraph that have these columns in common: doc_id, them, n, first line, mora statistics."""
    w = Window.partitionBy("doc_id").orderBy("sent_idx")
    new = F.col("line") > F.lag("line").over(w) + 1
    for c in change:
        new = new | (F.col(c) != F.lag(c).over(w))
    rows = ends.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "run", *change).agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("line"), F.min("mora").alias("least"), F.max("mora").alias("most"),
        F.try_divide(F.stddev_pop("mora"), F.avg("mora")).alias("cv"),
    )


def _of_six(ends: DataFrame, change: list[str]) -> DataFrame:
    """ending_runs of documents of six sentences or more."""
    rows = ends if "k" in ends.columns else ends.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return ending_runs(rows.filter("k >= 6"), change)


def repeated_mode(ends: DataFrame) -> DataFrame:
    """Three or more long sentences of even length with the same mode and ending; documents of six sentences or more."""
    long_ends = ends.withColumn("long", F.col("mora") >= m.MODE_MORA)
    runs = _of_six(long_ends, ["mode", "signature", "long"]).filter("long").filter(F.col("mode").isin("assertive", "tentative", "question"))
    return runs.filter((F.col("n") >= 3) & (F.col("cv") <= m.MODE_CV)).select("doc_id", "line", "mode", "signature", "n")


def nominal_runs(ends: DataFrame) -> DataFrame:
    """Three or more short sentences that end with a noun."""
    short = ends.withColumn("short", F.col("mora") <= m.NOMINAL_MORA)
    return _of_six(short, ["mode", "short"]).filter("short and mode = 'nominal' and n >= 3").select("doc_id", "line", "n")


def significant(tokens: DataFrame) -> DataFrame:
    """Tokens from the first that is no punctuation on; nth counts them."""
    begun = F.max((~punctuation()).cast("int")).over(order().rowsBetween(Window.unboundedPreceding, 0))
    rows = tokens.withColumn("begun", begun).filter("begun = 1").drop("begun")
    return rows.withColumn("nth", F.row_number().over(order()))


def lead_counts(tokens: DataFrame) -> DataFrame:
    """How often a document's sentences begin with the same two tokens: doc_id, lead, n, first line, label-like, technical."""
    head = significant(tokens).filter("nth <= 3")
    pick = lambda k, c: F.max(F.when(F.col("nth") == k, F.col(c)))
    sents = head.groupBy(*SENTENCE).agg(
        F.min("line").alias("line"), *[pick(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("surface", "pos1", "pos2")],
        F.max(F.col("surface").isin("：", ":")).alias("colon"),
    ).filter("surface2 is not null")
    return lead_repeats(leads(sents))


def leads(sents: DataFrame) -> DataFrame:
    """The lead of sentences with their first two tokens (surface1, pos11, pos21, surface2) and whether a colon is among the first three."""
    marker = F.col("surface1").rlike(r"^[A-Za-z0-9]{1,2}\z") & F.col("surface2").isin(".", "．", ")", "）")
    tech = ((F.col("pos11") == "名詞") & (F.col("pos21") == "固有名詞")) | F.col("surface1").rlike(r"^[A-Za-z][A-Za-z0-9_.-]*\z")
    return sents.withColumns({"lead": F.concat("surface1", "surface2"), "label": F.col("colon") | marker, "tech": tech})


def lead_repeats(sents: DataFrame) -> DataFrame:
    agg = sents.groupBy("doc_id", "lead").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"), F.count_if("label").alias("labels"), F.min_by("tech", "sent_idx").alias("tech"), *[F.first(c).alias(c) for c in ("genre",) if c in sents.columns])
    return agg.withColumn("label_like", F.col("labels") * 2 >= F.col("n")).drop("labels")


def pos_templates(tokens: DataFrame) -> DataFrame:
    """The most frequent tuple of the first four parts of speech of a document's sentences; of equal ones that seen first latest."""
    head = significant(tokens).filter("nth <= 4")
    sents = head.groupBy(*SENTENCE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "pos1"))), lambda x: x["pos1"]), "/").alias("template"), F.count(F.lit(1)).alias("k")).filter("k = 4")
    return template_shares(sents)


def template_shares(sents: DataFrame) -> DataFrame:
    """The most frequent template of a document's sentences (doc_id, sent_idx, template) and its share."""
    each = sents.groupBy("doc_id", "template").agg(F.count(F.lit(1)).alias("n"), F.min("sent_idx").alias("first_seen"))
    docs = each.groupBy("doc_id").agg(F.sum("n").alias("eligible"), F.max(F.struct("n", "first_seen", "template")).alias("x")).filter("eligible >= 6")
    return docs.select("doc_id", "eligible", F.col("x.template").alias("template"), F.col("x.n").alias("n"), (F.col("x.n") / F.col("eligible")).alias("share"))


def evidence(paras: DataFrame) -> DataFrame:
    """Paragraphs (text) with what specificity asks of their text: its length, numbers, and whether it has an example."""
    return paras.withColumns({"chars": F.length("text"), "quantities": t.pattern_count(F.col("text"), m.QUANTITY), "example": F.col("text").rlike(t.any_of(m.EXAMPLES))})


def specificity(counts: DataFrame, paras: DataFrame) -> DataFrame:
    """Score of each paragraph: names, numbers and examples against abstract nouns. paras: doc_id, para, line, text and evidence; counts:
    doc_id, para, content, proper, abstract of its tokens, a row or more a paragraph."""
    content = counts.groupBy("doc_id", "para").agg(F.sum("content").alias("n"), F.sum("proper").alias("proper"), F.sum("abstract").alias("abstract"))
    rows = paras.filter("chars >= 80").join(content.filter("n >= 15"), ["doc_id", "para"])
    example = F.when(F.col("example"), 0.1).otherwise(0.0)
    score = (F.col("proper") + F.col("quantities")) / F.col("n") + example - 1.5 * F.col("abstract") / F.col("n")
    return rows.select("doc_id", "para", "line", "text", score.alias("score"))


def readability(tokens: DataFrame) -> DataFrame:
    """Shares of verbs, particles and scripts among tokens that are no punctuation."""
    share = lambda c: F.avg(c.cast("double"))
    kind = t.script(F.col("surface"))
    return tokens.filter(~punctuation()).groupBy("doc_id").agg(
        share(F.col("pos1") == "動詞").alias("verb_ratio"), share(F.col("pos1") == "助詞").alias("particle_ratio"),
        *[share(kind == k).alias(f"{k}_ratio") for k in ("kanji", "hiragana", "katakana", "ascii")],
    )


#: Rules that look at single tokens, by what a sentence must hold for them: a pattern of its text, since tokens are pieces of it.
SOUGHT = {"koto": "こと", "light": "を", "thing": "これ|それ|あれ|こと|事実|この|その", "chain": "の[^の]*の[^の]*の", "list": "、[^、]*、", "kanji": "[一-龿々]{7}"}


def facts(sentences: DataFrame, tokens: Column) -> DataFrame:
    """A row a sentence with all that rules ask of it, so that neither its tokens nor, for most, its text need be kept. sentences:
    doc_id, genre, sent_idx, line, sentence, raw_text, end_mark, byte_start; tokens: the array of a sentence's tokens.

    What looks back or on within a sentence is asked of the array: its end, its first tokens, counts. has_ columns tell which of the rules
    on single tokens can hold; where one can, the sentence stays. words are the lemmas of content words, parted by line breaks."""
    solid = lambda x: ~x["pos1"].isin(m.PUNCTUATION_POS)
    rows = sentences.withColumn("_t", tokens)
    rows = rows.withColumns({"_solid": F.filter("_t", solid), "_from": F.array_position(F.transform("_t", solid), True).cast("int"), "_content": F.filter("_t", lambda x: x["pos1"].isin(m.CONTENT_POS))})
    rows = rows.withColumn("_head", F.when(F.col("_from") > 0, F.slice("_t", F.greatest(F.lit(1), F.col("_from")), F.lit(4))))
    noun = lambda x: x["pos1"] == "名詞"
    head = lambda k, c: F.get("_head", F.lit(k))[c]
    colon = F.exists(F.slice("_head", 1, 3), lambda x: x["surface"].isin("：", ":"))
    rows = rows.withColumns({
        "tail": F.array_join(F.transform(F.slice("_solid", F.greatest(F.lit(1), F.size("_solid") - 7), F.lit(8)), lambda x: x["surface"]), ""),
        "last": F.try_element_at("_solid", F.lit(-1)), "mora": mora(F.array_join(F.transform("_t", lambda x: x["reading"]), "")),
        "surface1": head(0, "surface"), "pos11": head(0, "pos1"), "pos21": head(0, "pos2"), "surface2": head(1, "surface"), "colon": colon,
        "template": F.when(F.size("_head") == 4, F.array_join(F.transform("_head", lambda x: x["pos1"]), "/")),
        "content": F.size("_content"), "proper": F.size(F.filter("_content", lambda x: noun(x) & (x["pos2"] == "固有名詞"))), "abstract": F.size(F.filter("_content", lambda x: noun(x) & x["lemma"].isin(m.ABSTRACT))),
        "words": F.array_join(F.transform("_content", lambda x: x["lemma"]), "\n"), "chars": F.length("raw_text"),
        **{f"has_{k}": F.col("sentence").rlike(p) for k, p in SOUGHT.items()},
        "has_negatives": F.size(F.filter("_t", lambda x: x["pos1"].isin("助動詞", "形容詞") & x["lemma"].isin(m.NEGATIVES))) >= 2,
    })
    verb = F.exists("_t", lambda x: (x["pos1"] == "動詞") & x["lemma"].isin(m.INANIMATE_VERBS))
    rows = rows.withColumn("has_thing", F.when(F.col("has_thing"), verb).otherwise(False))
    rows = reading_marks(cleft_marks(leads(ended(rows))))
    any_ = reduce(lambda x, y: x | y, [F.col(c) for c in HAS])
    least = min(m.SENTENCE_MAX.values())
    said = F.when(F.col("dense") | F.col("defines") | (F.col("length") > least), F.col("head"))
    return rows.select(
        "doc_id", "genre", "sent_idx", "line", "byte_start", "size", "chars", "length", "dense", said.alias("head"), "defines", "because", "mode", "signature", "mora", "noun_ended",
        "lead", "label", "tech", "template", "content", "proper", "abstract", "words", *HAS, F.when(any_, F.col("sentence")).alias("sentence"),
    )


#: Columns of facts that tell which rules on single tokens can hold.
HAS = [f"has_{k}" for k in [*SOUGHT, "negatives"]]


def content_words(facts: DataFrame) -> DataFrame:
    """doc_id, sent_idx, nth, word: a row a content word."""
    return facts.filter("content > 0").select(*SENTENCE, F.posexplode(F.split("words", "\n", -1)).alias("nth", "word"))


def token_findings(facts: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings of the rules above, and of reading_load and document_rules, from facts, the tokens of those sentences that facts keep
    (with their has_ columns), and lines."""
    sentences = facts.filter("sentence is not null")
    of = lambda k: tokens.filter(f"has_{k}")
    length = sentences.select(*SENTENCE, F.col("length").alias("chars"))
    bar = F.when(F.col("items") <= 3, 80).otherwise(50)
    short = koto_ga_dekiru(of("koto"))
    placed = [
        finding(short.withColumn("replacement", F.when(F.col("preimage").isNotNull(), F.lit(""))), "translationese_morph"),
        finding(light_verb(of("light")), "redundant_light_verb"),
        finding(no_chain(of("chain")), "no_chain"),
        reading_load(facts),
    ]
    out = [
        spans.in_lines(union(placed), lines),
        finding(inanimate_morph(of("thing")), "inanimate_subject_morph", text=F.concat("subject", F.lit("…"), "verb")),
        finding(double_negative(of("negatives")), "double_negative"),
        finding(buried_list(of("list")).join(length, SENTENCE).filter(F.col("chars") >= bar), "buried_list", value=F.col("items")),
        finding(kanji_runs(sentences, of("kanji")), "kanji_run", text=F.col("run")),
    ]
    k = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    ends = facts.select(*SENTENCE, "line", "mode", "signature", "mora", k.alias("k"))
    out.append(finding(repeated_mode(ends), "repeated_sentence_mode", text=F.col("signature"), value=F.col("n")))
    out.append(finding(nominal_runs(ends), "consecutive_nominal_endings", value=F.col("n")))
    repeats = F.coalesce(*[F.when(F.col("genre") == g, F.lit(k)) for g, k in m.LEAD_REPEATS.items() if g], F.lit(m.LEAD_REPEATS[None]))
    often = lead_repeats(facts.filter("lead is not null")).filter(F.col("n") >= min(m.LEAD_REPEATS.values()))
    out.append(finding(often.filter(F.col("n") >= repeats), "repeated_sentence_lead", text=F.col("lead"), value=F.col("n")))
    shares = template_shares(facts.filter("template is not null"))
    out.append(finding(shares.filter("share >= 0.4").withColumn("line", F.lit(1)), "repeated_syntax_template", text=F.col("template"), value=F.col("share")))
    out.append(document_rules(facts))
    return union(out)


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows of parts, which have the same columns: halves of halves, so that a plan is looked at few times while it grows."""
    half = len(parts) // 2
    return parts[0] if not half else union(parts[:half]).unionByName(union(parts[half:]))
