"""The plan of a run: frames once, all rules over them, policy, one frame of findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumiyomi import model as m
from fumiyomi.operators.blocks import structured
from fumiyomi.functions.tokenizer import DEFAULT, token_frame, tokenize
from fumiyomi.operators import measures, stats, surface, tokens
from fumiyomi.operators.frames import paragraphs, sentences


def frames(docs: DataFrame, lexicon: str = str(DEFAULT)) -> dict[str, DataFrame]:
    """Lines, sentences, facts of sentences, and the tokens of those that need them, of docs (doc_id, genre, text). Masking and
    tokenizing are what costs, so they are dealt by document once, and lines, facts and these tokens are kept, in memory and beyond it
    on disk, until the caller clears the cache. What is kept is about two times the text: a masked line only where it isn't the line
    itself, of a sentence what rules ask of it (tokens.facts)."""
    keep = StorageLevel.MEMORY_AND_DISK
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given as a number, the partitioning stays known
    lines = structured(docs.select("doc_id", "genre", "text").repartition(n, "doc_id"))
    kept = lines.withColumn("masked", F.when(F.col("masked") != F.col("raw"), F.col("masked"))).persist(keep)
    lines = kept.withColumn("masked", F.coalesce("masked", "raw"))
    sents = sentences(lines, ("genre",))
    # kept in the order of the rules' windows, which then need neither an exchange nor a sort
    facts = tokens.facts(sents, tokenize(lexicon)("sentence")).sortWithinPartitions("doc_id", "sent_idx").persist(keep)
    some = facts.filter("sentence is not null").select("doc_id", "sent_idx", "line", F.col("byte_start").cast("int").alias("sent_at"), *tokens.HAS, F.posexplode(tokenize(lexicon)("sentence")).alias("tok_idx", "t"))
    fields = ("surface", "byte_start", "byte_end", "pos1", "pos2", "pos3", "lemma")
    toks = some.select("doc_id", "sent_idx", "line", "sent_at", "tok_idx", *[f"t.{c}" for c in fields], *tokens.HAS).sortWithinPartitions("doc_id", "sent_idx", "tok_idx").persist(keep)
    return {"docs": docs, "lines": lines, "sentences": sents, "facts": facts, "tokens": toks}


def policy(findings: DataFrame, docs: DataFrame, experimental: bool) -> DataFrame:
    """Drops experimental rules unless asked for, and for business documents those that don't suit them; adds the lane."""
    trial = [r.category for r in m.RULES if r.experimental]
    formal = [r.category for r in m.RULES if r.not_business]
    lanes = [r.category for r in m.RULES if r.lane == "reading_load"]
    out = findings if experimental else findings.filter(~F.col("category").isin(trial))
    out = out.join(docs.select("doc_id", "genre"), "doc_id").filter(~(F.col("category").isin(formal) & (F.coalesce("genre", F.lit("")) == "business"))).drop("genre")
    return out.withColumn("lane", F.when(F.col("category").isin(lanes), "reading_load").otherwise("main"))


def colon_findings(lines: DataFrame, lexicon: str) -> DataFrame:
    """Leads whose label ends with a verb or auxiliary."""
    rows = surface.colon_leads(lines).withColumn("t", tokenize(lexicon)("label"))
    solid = F.filter("t", lambda x: ~x["pos1"].isin(m.PUNCTUATION_POS))
    return surface.finding(rows.filter(F.try_element_at(solid, F.lit(-1))["pos1"].isin("動詞", "助動詞")), "predicate_colon_lead", text=F.col("label"))


@dataclass
class Run:
    """Findings (a row each) and stats (a row a document; planned when asked for) of a run; what both read is kept until the cache is cleared."""

    findings: DataFrame
    measure: Callable[[], DataFrame]

    @cached_property
    def stats(self) -> DataFrame:
        return self.measure()


def analyzed(docs: DataFrame, experimental: bool = False, lexicon: str = str(DEFAULT), disabled: list[str] | None = None) -> Run:
    """Findings of all rules and statistics of all documents of docs (doc_id, genre, text)."""
    f = frames(docs, lexicon)
    lines, facts = f["lines"], f["facts"]
    counts = facts.groupBy("doc_id", "genre").agg(F.count(F.lit(1)).alias("n_sentences"))
    paras = paragraphs(lines)
    para_stats = tokens.evidence(measures.paragraph_stats(paras)).withColumn("text", F.left("text", F.lit(40))).persist(StorageLevel.MEMORY_AND_DISK)
    opening = facts.groupBy("doc_id").agg(F.min("line").alias("line"), F.sum("chars").alias("chars"))
    long = opening.filter(F.col("chars") >= m.LEXICAL_CHARS)  # the only ones whose vocabulary a rule judges
    lexical = long.join(measures.diversity(tokens.content_words(facts.join(long.select("doc_id"), "doc_id", "left_semi")), ["sent_idx", "nth"]), "doc_id", "left")
    in_paras = facts.select("doc_id", "line", "content", "proper", "abstract").filter("content > 0").join(paras.select("doc_id", "line", "para"), ["doc_id", "line"])
    scores = tokens.specificity(in_paras, para_stats)
    parts = [
        surface.structural(docs), surface.boilerplate_heading(lines), colon_findings(lines, lexicon), surface.bullet_styles(lines), surface.line_rules(lines),
        surface.antithesis_repetition(lines, counts), surface.cleft_because(facts), tokens.token_findings(facts, f["tokens"], lines), measures.low_diversity(lexical),
        surface.finding(scores.filter(F.col("score") < m.SPECIFICITY), "low_specificity", text=F.left("text", F.lit(40)), value=F.col("score")),
        measures.paragraph_rules(para_stats),
    ]
    out = tokens.union(parts)
    if disabled:
        out = out.filter(~F.col("category").isin(disabled))

    def measure() -> DataFrame:
        sents, toks = f["sentences"], token_frame(f["sentences"], lexicon)
        ends = facts.select("doc_id", "sent_idx", "line", "mode", "signature", "mora", "noun_ended")
        shares = tokens.template_shares(facts.filter("template is not null"))
        templates = shares.select("doc_id", F.struct(F.col("template").alias("lead_pos_4gram_top"), F.col("share").alias("lead_pos_4gram_ratio")).alias("ngram"))
        base = stats.document_stats(lines, stats.sentence_measures(sents, toks, ends))
        every = opening.join(measures.diversity(tokens.content_words(facts), ["sent_idx", "nth"]), "doc_id", "left")
        whole = stats.merged(docs, [base, stats.structural_stats(docs), templates, stats.lexical_stats(every), stats.specificity_stats(scores)])
        return whole.withColumn("experimental", F.lit(experimental))

    return Run(policy(out, docs, experimental), measure)


def lint(docs: DataFrame, experimental: bool = False, lexicon: str = str(DEFAULT), disabled: list[str] | None = None) -> DataFrame:
    """Findings of all rules over docs (doc_id, genre, text)."""
    return analyzed(docs, experimental, lexicon, disabled).findings
