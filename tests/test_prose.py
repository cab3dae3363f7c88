"""Masking, tokenizer, rules, sinks, sources, comparison and streams."""

import hashlib
import io
import json
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fumiyomi import cli
from fumiyomi import model as m
from fumiyomi.functions import text, tokenizer
from fumiyomi.operators import blocks, calibrate, compare, extract, measures, outline, phrases, spans, stats, surface, tokens
from fumiyomi.operators.frames import paragraphs, sentences
from fumiyomi.plans.lint import lint
from fumiyomi.sources import readers, sinks
from fumiyomi.streaming.ingest import drift, incoming, lint_stream

import hand_made as fx
import plain_structure as plain

MARKUP = st.lists(st.sampled_from(["本文。", "`code`", "<b>", "](http://x)", "\n", "```\n", "# 見出し\n", "- 項目\n", "<!--", "-->", "---\n", "> 引用\n", "| a | b |\n", "~~~", "[1] 文献", "é"]), max_size=25).map("".join)


@given(MARKUP)
@settings(max_examples=300, deadline=None)
def test_masks_keep_bytes(t):
    rows = plain.mask_lines(t)
    assert [r[1] for r in rows] == t.split("\n")
    for _, raw, masked, _ in rows:
        assert masked == "" or len(masked.encode()) == len(raw.encode())
    bare = plain.without_comments(t)
    assert len(bare.encode()) == len(t.encode()) and bare.count("\n") == t.count("\n")


@pytest.mark.parametrize(
    ("t", "kinds"),
    [
        ("---\nx\n---\n本文", ["front_matter"] * 3 + ["text"]),
        ("---\nx", ["front_matter"] * 2),
        ("```\na\n``\n````x\n本文", ["fence"] * 4 + ["text"]),
        ("~~~\n```\n~~~", ["fence"] * 3),
        ("<!-- a\n---\n-->本文", ["blank", "blank", "text"]),
        ("####### 七\n#見出しでない\n#A 注釈\n[^1]: 脚注\n[1]続き", ["text", "text", "code_note", "reference", "text"]),
    ],
)
def test_kinds_of_lines(t, kinds):
    assert [r[3] for r in plain.mask_lines(t)] == kinds


def test_inline_masks():
    row = plain.mask_lines("見る`コード`と<br/>と[表](http://a)。")[0]
    assert row[2] == "見る" + " " * len("`コード`".encode()) + "と" + " " * 5 + "と[表](" + " " * 8 + ")。"


def lines_of(spark, texts, keep=False):
    got = {i: [] for i in range(len(texts))}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, kind_of string").repartition(8)
    for r in blocks.structured(df, keep).collect():
        got[r["doc_id"]].append((r["line"], r["raw"], r["masked"], r["kind"]))
    return [sorted(got[i]) for i in range(len(texts))]


@pytest.mark.parametrize("group", [3, 512])
def test_native_lines_are_those_of_the_loop(spark, monkeypatch, group):
    """Marks folded in groups give what one state carried from line to line gives; texts of very many fences, too."""
    monkeypatch.setattr(blocks, "GROUP", group)
    rng = random.Random(group)
    parts = ["---", "```", "````x", "~~~", "~~~~", "  ```", "`````", "本文", "", "# h", "- i", "1. x", "> q", "| a | b |", "[1] r", "[^n]: f", "#A note", "a `c` b", "x <b>y</b> [l](http://x) z", "<!-- c", "c -->", "<!-- a --> b", "日 `語` <!-- 注 -->", "--- ", "|--|", "[https://a.b/c:embed:cite]", "“`~", "``` ```"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 5, 20, 60]))) for _ in range(300)]
    texts += ["", "---\na\n---\nb", "---", "```", "```\n" + "\n".join(rng.choice(["```", "~~~", "````", "x"]) for _ in range(3000)), "x\n" * 20_000]
    assert lines_of(spark, texts) == [plain.mask_lines(t) for t in texts]
    assert lines_of(spark, texts[:50], True) == [plain.mask_lines(t, True) for t in texts[:50]]
    assert blocks.structured(spark.createDataFrame([(1, None)], "doc_id int, text string")).count() == 0


def test_counts_made_by_hand(spark):
    rows = blocks.structured(fx.docs(spark))
    kinds = {r["kind"]: r["count"] for r in rows.filter("doc_id = 'd13'").groupBy("kind").count().collect()}
    assert kinds == {"front_matter": 3, "text": 2, "table": 2, "reference": 2, "code_note": 1, "embed": 1, "fence": 3}
    found = outline.outline(fx.docs(spark).filter(F.col("doc_id").isin("d06", "d09"))).orderBy("doc_id", "line").collect()
    assert [(r["line"], r["kind"], r["text"]) for r in found] == [
        (1, "heading", "はじめに"), (2, "lead", "本文である。"), (3, "heading", "まとめ"), (4, "lead", "**要点**と**課題**と**方法**を書く。"), (5, "heading", "1. 結論"), (6, "bullets", "(箇条書き 4 項目)"),
        (1, "lead", "革命的な方法だ。"), (6, "lead", "最強の本だ。"),
    ]
    bare = rows.filter("doc_id = 'd09'").filter(~F.col("kind").isin("fence", "quote")).withColumn("masked", F.col("raw"))
    assert sorted((r["line"], r["phrase"]) for r in surface.phrase_rows(bare, m.HYPE, "masked").collect()) == [(1, "劇的に"), (1, "圧倒的な"), (1, "革命的"), (6, "最強の")]
    even = measures.paragraph_rules(measures.paragraph_stats(paragraphs(rows.filter("doc_id = 'd10'"))))
    assert sorted((r["category"], r["line"], r["value"]) for r in even.collect()) == [("paragraph_lead_conjunction", 1, 0.5), ("paragraph_lead_conjunction", 3, 0.5), ("uniform_paragraph_structure", 1, 0.0)]
    toks = fx.token_frame(spark)
    assert sorted((r["doc_id"], r["sent_idx"], r["items"]) for r in tokens.buried_list(toks).collect()) == [("t06", 1, 4), ("t06", 3, 5)]
    ends = tokens.endings(toks, fx.sentence_frame(spark).select("doc_id", "sent_idx", "line", "end_mark"))
    assert [(r["doc_id"], r["n"]) for r in tokens.nominal_runs(ends).collect()] == [("t08", 3)]


def test_sentences_know_their_bytes(spark):
    docs = spark.createDataFrame([("a", "一つ。 `x`二つ！　三つ\n四つ?")], "doc_id string, text string")
    rows = sentences(blocks.structured(docs)).orderBy("sent_idx").collect()
    assert [(r["sentence"], r["raw_text"], r["end_mark"], r["byte_start"], r["line"]) for r in rows] == [
        ("一つ", "一つ", "。", 0, 1), ("二つ", "`x`二つ", "！", 13, 1), ("三つ", "三つ", None, 25, 1), ("四つ", "四つ", "?", 0, 2),
    ]


def test_spans_of_matches(spark):
    docs = spark.createDataFrame([("a", "前にさて、さて、と言えます。")], "doc_id string, text string")
    rows = surface.forbidden_phrase(blocks.structured(docs)).orderBy("start_byte").collect()
    raw = "前にさて、さて、と言えます。".encode()
    assert [(raw[r["start_byte"] : r["end_byte"]].decode(), r["severity"]) for r in rows] == [("さて、", "info"), ("さて、", "info"), ("と言えます", "warn")]
    pattern = spark.createDataFrame([("xaあbaあ",)], "s string").select(surface.matches(F.col("s"), "a.").alias("m")).first()["m"]
    assert [(x["match"], x["start_byte"]) for x in pattern] == [("aあ", 1), ("aあ", 6)]


@pytest.mark.parametrize(
    ("sentence", "words"),
    [
        ("この事実は問題を示す", "この/連体詞 事実/名詞 は/助詞 問題/名詞 を/助詞 示す/動詞"),
        ("調査を行い、結果を説明した", "調査/名詞 を/助詞 行い/動詞 、/補助記号 結果/名詞 を/助詞 説明/名詞 し/動詞 た/助動詞"),
        ("コンピューターとAPIを使う", "コンピューター/名詞 と/助詞 API/名詞 を/助詞 使う/動詞"),
        ("利用することができる", "利用/名詞 する/動詞 こと/名詞 が/助詞 できる/動詞"),
    ],
)
def test_tokenizer(sentence, words):
    assert " ".join(f"{t['surface']}/{t['pos1']}" for t in tokenizer.tokens_of(sentence)) == words


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_tokens_cover_the_text(s):
    found = tokenizer.tokens_of(s)
    assert "".join(t["surface"] for t in found) == s
    assert all(s.encode()[t["byte_start"] : t["byte_end"]].decode() == t["surface"] for t in found)


def test_tokenizer_limits():
    assert tokenizer.tokens_of(None) == tokenizer.tokens_of("") == tokenizer.tokens_of("あ" * 20000) == []
    assert tokenizer.normalized("コンピューター") == "コンピュータ" and tokenizer.normalized("ＡＰＩ") == "api"
    assert dict(tokenizer.inflected("書く", "カク", "godan"))["書い"] == "カイ"


def test_every_rule_is_known():
    assert len(m.RULES) == 36 and sum(r.lane == "reading_load" for r in m.RULES) == 6


def test_policy(spark):
    docs = spark.createDataFrame([("a", "business", "- **要点**: 一つ\n# まとめ\nさて、本を読む。"), ("b", None, "- **要点**: 一つ\n# まとめ\nさて、本を読む。")], "doc_id string, genre string, text string")
    plain = {(r["doc_id"], r["category"]) for r in lint(docs).collect()}
    trial = {(r["doc_id"], r["category"]) for r in lint(docs, experimental=True).collect()}
    assert ("b", "bullet_bold_label") in plain and ("a", "bullet_bold_label") not in plain
    assert ("b", "boilerplate_heading") in trial - plain and ("a", "boilerplate_heading") not in trial
    spark.catalog.clearCache()


def mtld_of(words, factor=0.72):
    """The loop that carries the set of words seen."""
    if len(words) < 20:
        return None
    total = 0.0
    for order in (words, words[::-1]):
        factors, n, seen = 0.0, 0, set()
        for w in order:
            seen.add(w)
            n += 1
            if len(seen) / n <= factor:
                factors, n, seen = factors + 1, 0, set()
        if n and len(seen) < n:
            factors += min((1 - len(seen) / n) / (1 - factor), 1.0)
        total += len(words) / factors if factors > 0 else len(words)
    return total / 2


def test_mtld(spark):
    rng = random.Random(6)
    texts = [[rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) * 2 for _ in range(n)] for k, n in ((2, 19), (2, 20), (26, 25), (26, 400), (9, 1000), (1, 50))]
    texts += [[str(i) for i in range(300)], [str(i) for i in range(18)] + ["0"] * 7]  # 18 of 25 is the factor itself
    rows = [(d, i, w) for d, text in enumerate(texts) for i, w in enumerate(text)]
    got = {r["doc_id"]: r["mtld"] for r in measures.mtld(spark.createDataFrame(rows, "doc_id int, i int, word string").repartition(5), ["i"]).collect()}
    assert got == {d: pytest.approx(x) if (x := mtld_of(t)) is not None else None for d, t in enumerate(texts)}


def test_phrases_by_their_rarest_grams(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé日") for _ in range(rng.randint(0, 80))) for _ in range(150)] + [None, "", "aaaaaaaaaa"]
    wanted = sorted({"".join(rng.choice("abé日") for _ in range(rng.randint(4, 7))) for _ in range(300)} | {"aaaa", "aaaaa"})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(4)
    found = phrases.phrase_places(rows, spark.createDataFrame([(p,) for p in [*wanted, "ab", None, wanted[0]]], "phrase string"), ["doc_id"])
    want = sorted((i, p, k + 1) for i, t in enumerate(texts) for p in wanted for k in range(len(t or "")) if (t or "").startswith(p, k))
    assert sorted(tuple(r) for r in found.collect()) == want


def test_every_threshold_at_once(spark):
    rng = random.Random(7)
    values = [(rng.choice("xy"), rng.choice(["dev", "holdout"]), rng.choice(["ai", "human"]), rng.choice([0.1, 0.5, rng.random()])) for _ in range(3000)] + [("z", "dev", "ai", 1.0), ("other", "dev", "ai", 1.0)]
    domains = {"x": [0.0, 0.1, 0.3, 0.5, 1.0], "y": [0.5], "z": [1.0, 2.0], "none": [3.0]}
    df = spark.createDataFrame(values, "category string, split string, label string, value double").repartition(4)
    got = {tuple(r) for r in calibrate.curve(df, domains, 8).select("category", "split", "label", "threshold", "n", "below", "at_most").collect()}
    want = set()
    for key in {v[:3] for v in values if v[0] in domains}:
        own = [v[3] for v in values if v[:3] == key]
        want |= {(*key, t, len(own), sum(v < t for v in own), sum(v <= t for v in own)) for t in domains[key[0]]}
    assert got == want


@pytest.mark.parametrize(("k", "n", "low", "high"), [(0, 14, 0.0, 0.215), (1, 4, 0.046, 0.699), (6, 14, 0.214, 0.674), (3, 4, 0.301, 0.954), (1, 2, 0.095, 0.905)])
def test_wilson(spark, k, n, low, high):
    a, b = text.wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (round(r["a"], 3), round(r["b"], 3)) == (low, high)


def test_labelled_samples(spark):
    rows = [("x", "fire", True), ("x", "fire", False), ("x", "silent", True), ("y", "silent", False)]
    got = {r["category"]: r for r in calibrate.confusion(spark.createDataFrame(rows, "category string, expect string, fired boolean")).collect()}
    assert (got["x"]["hit"], got["x"]["false_alarm"], got["x"]["mismatches"], got["y"]["mismatches"]) == (1, 1, 2, 0)


def test_entities_and_pages(spark):
    html = "<html><title> A &amp; B </title><main>no</main><article><h2> 題 <b>x</b></h2><p>a&#65;&#x3042;<br>b</p><script>z</script></article>"
    r = extract.page_text(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert r["text"] == "## 題 x\n\naAあ\n\nb"


# ---- sources, sinks and the command line


def run(spark, *argv):
    out = io.StringIO()
    return cli.main([*argv], spark, out), out.getvalue()


@pytest.fixture
def prose(tmp_path):
    path = tmp_path / "a.md"
    path.write_text("# まとめ\nさて、重要なのは検証だ。調査を行う。総じて良い。\n", encoding="utf-8")
    return path


def test_lint_command(spark, prose):
    code, out = run(spark, "lint", str(prose), "--json", "--no-config", "--fail-on", "warn")
    report = json.loads(out)
    assert code == 2 and report["file"] == str(prose)
    assert report["stats"]["by_category"]["forbidden_phrase"] == 3 and report["stats"]["total_findings"] == len(report["findings"])
    assert run(spark, "lint", str(prose), "--no-config", "--fail-on", "critical")[0] == 0
    assert "::warning file=" in run(spark, "lint", str(prose), "--no-config", "--format", "github")[1]
    log = json.loads(run(spark, "lint", str(prose), "--no-config", "--format", "sarif")[1])
    rules = [r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]]
    assert log["runs"][0]["columnKind"] == "unicodeCodePoints" and rules == sorted(set(rules))


def test_baseline_and_config(spark, prose, tmp_path):
    first = run(spark, "lint", str(prose), "--json", "--no-config")[1]
    (tmp_path / "before.json").write_text(first, encoding="utf-8")
    again = json.loads(run(spark, "lint", str(prose), "--json", "--no-config", "--baseline", str(tmp_path / "before.json"))[1])
    assert set(again["comparison"]) == {"persisting"}
    conf = tmp_path / "c.toml"
    conf.write_text('version = 1\ndisabled_rules = ["redundant_light_verb"]\n[[allow]]\ncategory = "forbidden_phrase"\ntext = "総じて良い"\nreason = "style"\n', encoding="utf-8")
    report = json.loads(run(spark, "lint", str(prose), "--json", "--config", str(conf))[1])
    assert report["stats"]["by_category"].get("forbidden_phrase") == 2 and "redundant_light_verb" not in report["stats"]["by_category"]
    for bad in ("version = 2", 'disabled_rules = ["nope"]', "odd = 1", '[[allow]]\ncategory = "no_chain"\ntext = " "\nreason = "x"'):
        conf.write_text(bad, encoding="utf-8")
        with pytest.raises(readers.InputError):
            readers.config(str(conf))


def test_reports_hold_places_suggestions_and_stats(spark, tmp_path):
    path = tmp_path / "s.md"
    path.write_text("# 題\n<b>印</b>調査することができる。検証を行う。\n[1] 文献\n\nしかし雨だ。本を読む？\n", encoding="utf-8")
    report = json.loads(run(spark, "lint", str(path), "--json", "--no-config")[1])
    found = {f["category"]: f for f in report["findings"]}
    raw = path.read_text(encoding="utf-8").split("\n")
    for f in report["findings"] + report["reading_load"]["findings"]:
        if span := f.get("span"):
            line = raw[span["start_line"] - 1]
            assert line.encode()[span["start_byte"] : span["end_byte"]].decode() == line[span["start_column"] - 1 : span["end_column"] - 1]
    fix = found["redundant_light_verb"]["suggestion"]
    assert (fix["preimage"], fix["replacement"]) == ("を行う", "する") and raw[1][fix["span"]["start_column"] - 1 : fix["span"]["end_column"] - 1] == "を行う"
    assert (found["translationese_morph"]["suggestion"]["preimage"], found["translationese_morph"]["suggestion"]["replacement"]) == ("することが", "")
    stats = report["stats"]
    assert (stats["total_sentences"], stats["total_paragraphs"], stats["paragraph_sentence_counts"], stats["paragraph_lead_conjunction_count"]) == (4, 2, [2, 2], 1)
    assert stats["masking"] == {"reference_lines": 1, "code_annotation_lines": 0} and stats["conjunction"] == {"sentence_lead_conjunction_count": 1, "sentence_lead_conjunction_ratio": 0.25}
    assert stats["lexical_diversity"]["skipped_too_short"] and stats["rhythm"]["sentence_endings"]["counts"]["question"] == 1 and "burstiness" not in stats["rhythm"]
    assert report["reading_load"]["stats"] == {"total": 0, "sentences": 4, "by_category": {}}
    region = json.loads(run(spark, "lint", str(path), "--no-config", "--format", "sarif")[1])["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]
    assert set(region) == {"startLine", "startColumn", "endLine", "endColumn"}
    assert ",endLine=2,col=" in run(spark, "lint", str(path), "--no-config", "--format", "github")[1]


def test_places_are_null_off_boundaries(spark):
    rows = spark.createDataFrame([("aé日😀z", a, b) for a in range(-1, 13) for b in range(-1, 13)], "raw string, start_byte int, end_byte int")
    for r in spans.with_columns(rows).withColumn("x", spans.excerpt(F.col("raw"), F.col("start_byte"), F.col("end_byte"), 1)).collect():
        starts, a, b = [0, 1, 3, 6, 10, 11], r["start_byte"], r["end_byte"]
        whole = a in starts and b in starts and a < b
        assert (r["start_column"], r["end_column"]) == ((starts.index(a) + 1, starts.index(b) + 1) if whole else (None, None))
        if whole:
            assert r["x"] == "aé日😀z"[max(0, starts.index(a) - 1) : starts.index(b) + 1]


def test_statistics_are_those_of_a_loop(spark):
    """Sums by paragraph and document, runs, and the sentence before, for documents without sentences, too."""
    rng = random.Random(8)
    lines, sents = [], []
    for doc in range(30):
        k = 0
        for line in range(1, rng.randint(1, 40)):
            kind = rng.choice(["text", "text", "text", "blank", "reference", "code_note"])
            body = "しかし本" if rng.random() < 0.3 else "本"
            lines.append((doc, line, body if kind == "text" else "", kind))
            for _ in range(rng.randint(0, 3) if kind == "text" and doc else 0):
                k += 1
                sents.append((doc, line, k, rng.randint(1, 50), rng.randint(0, 40), rng.choice(stats.MODES[:3]), rng.random() < 0.2, rng.random() < 0.2, *[rng.randint(0, 9) for _ in stats.COUNTS]))
    got = {r["doc_id"]: r["stats"] for r in stats.document_stats(
        spark.createDataFrame(lines, "doc_id int, line int, masked string, kind string").repartition(5),
        spark.createDataFrame(sents, "doc_id int, line int, sent_idx int, chars long, mora long, mode string, noun_ended boolean, conjunction boolean, " + ", ".join(f"{c} long" for c in stats.COUNTS)).repartition(7),
    ).collect()}
    assert set(got) == {x[0] for x in lines}
    for doc, s in got.items():
        own, said = sorted(x for x in lines if x[0] == doc), sorted((x for x in sents if x[0] == doc), key=lambda x: x[2])
        paras, last = [], True
        for x in own:
            if x[2] and last:
                paras.append([x])
            elif x[2]:
                paras[-1].append(x)
            last = not x[2]
        sizes = [sum(y[1] in {x[1] for x in p} for y in said) for p in paras]
        assert (s["total_sentences"], s["total_paragraphs"], list(s["paragraph_sentence_counts"])) == (len(said), len(paras), sizes)
        assert s["paragraph_lead_conjunction_count"] == sum(p[0][2].startswith("しかし") for p in paras)
        assert s["masking"]["reference_lines"] == sum(x[3] == "reference" for x in own)
        runs, before = dict.fromkeys(stats.MODES, 0), None
        for x in said:
            n = n + 1 if before and before[5] == x[5] and x[1] <= before[1] + 1 else 1
            runs[x[5]], before = max(runs[x[5]], n), x
        assert s["rhythm"]["sentence_endings"]["longest_runs"].asDict() == runs
        mora = [x[4] for x in said]
        if len(mora) >= 6:
            assert s["rhythm"]["mora_stdev"] == pytest.approx(statistics.pstdev(mora))
            assert s["rhythm"]["length_autocorrelation_lag1"] == pytest.approx(statistics.correlation(mora[:-1], mora[1:]))
        else:
            assert s["rhythm"]["mora_mean"] is None
        if len(paras) >= 4 and sum(sizes):
            assert s["paragraph_sentence_count_cv"] == pytest.approx(statistics.pstdev(sizes) / statistics.fmean(sizes))


def test_outline_and_terms_commands(spark, tmp_path):
    path = tmp_path / "b.md"
    path.write_text("# 題\nコンピューターとAPIを使う。APIは速い。\n- 一つ\n- 二つ\n", encoding="utf-8")
    assert run(spark, "outline", str(path))[1].splitlines() == ["1: # 題", "2:  コンピューターとAPIを使う。", "3:  (箇条書き 2 項目)"]
    rows = [json.loads(x) for x in run(spark, "terms", str(path), "--json")[1].splitlines()]
    assert {(r["term"], r["n"]) for r in rows} == {("API", 2), ("コンピューター", 1)}
    assert run(spark, "terms", str(path), "--audit", "--json")[1].count("\n") == 2


def test_input_errors(spark, tmp_path):
    assert run(spark, "lint", str(tmp_path / "none.md"))[0] == 1
    assert run(spark, "lint", "-", "x.md")[0] == 1
    assert run(spark, "lint", str(tmp_path))[0] == 1


def test_manifest(spark, tmp_path):
    (tmp_path / "d.txt").write_text("本文", encoding="utf-8")
    digest = hashlib.sha256("本文".encode()).hexdigest()
    entry = f'[[document]]\nid = "a"\npath = "d.txt"\nlabel = "human"\nsha256 = "{digest.upper()}"\n'
    (tmp_path / "m.toml").write_text(entry, encoding="utf-8")
    assert readers.manifest(spark, str(tmp_path / "m.toml")).first()["text"] == "本文"
    (tmp_path / "m.toml").write_text(entry.replace(digest.upper(), "0" * 64), encoding="utf-8")
    with pytest.raises(readers.InputError):
        readers.manifest(spark, str(tmp_path / "m.toml"))


def test_lexicon_tables(spark, tmp_path):
    words = readers.lexicon(spark, str(tokenizer.DEFAULT))
    assert readers.lexicon_index(words).filter("surface = 'ない'").first()["entries"] == 2
    (tmp_path / "matrix.def").write_text("2 2\n0 0 5\n0 1 -7\n")
    assert readers.connection_costs(spark, str(tmp_path / "matrix.def")).count() == 2
    (tmp_path / "char.def").write_text("# classes\nKANJI 0 0 2\n0x4E00..0x9FFF KANJI\n0x3005 KANJI\n")
    assert {(r["lo"], r["hi"]) for r in readers.char_ranges(spark, str(tmp_path / "char.def")).collect()} == {(0x4E00, 0x9FFF), (0x3005, 0x3005)}


def test_incompatible_runs(spark):
    header = spark.createDataFrame([("a", None, None, False), ("b", "9", None, False), ("c", None, "tech", False)], "file string, version string, genre string, experimental boolean")
    assert {r["file"] for r in compare.incompatible(header, "1", None, False).collect()} == {"b", "c"}


def test_exit_code_ignores_reading_load(spark):
    rows = spark.createDataFrame([("a", "no_chain", "warn", "reading_load"), ("a", "x", "info", "main")], "doc_id string, category string, severity string, lane string")
    assert sinks.exit_code(rows, "warn") == 0 and sinks.exit_code(rows, "info") == 2 and sinks.exit_code(rows, None) == 0


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", None, "さて、本を読む。")], "doc_id string, genre string, text string").write.parquet(str(tmp_path / "in"))
    q = lint_stream(incoming(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("category = 'forbidden_phrase'").count() == 1
    events = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0)], "k int, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("k") * 60))
    assert drift(events).first()["mean"] == 3.0
    spark.catalog.clearCache()


def test_running_lines_of_a_book(spark):
    """Heads on half of the pages, rounded down; lines trimmed; blank lines and page numbers of several forms are gone."""
    from fumiyomi.operators import extract

    rows = [("b", p, k, x) for p in range(7) for k, x in enumerate([" Head " if p < 3 else f"own {p}", "", f"{p}/40", "１２ページ", "Page 3", "Only twice" if p < 2 else f"body {p}"])]
    got = extract.without_running_lines(spark.createDataFrame(rows, "book string, page int, line int, text string")).collect()
    assert sorted(r["text"] for r in got) == sorted([f"own {p}" for p in range(3, 7)] + [f"body {p}" for p in range(2, 7)] + ["Only twice"] * 2)


def test_headings_of_html(spark):
    from fumiyomi.operators import extract

    html = "<article><h2 class='x'> A <b>b</b>\n &amp;  c </h2><p>text</p><h3> <i></i> </h3><h1>T</h1></article>"
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert extract.page_text(df).collect()[0]["text"] == "## A b & c\n\ntext\n\n# T"
    assert [(r["level"], r["text"]) for r in extract.headings(df).orderBy("nth").collect()] == [(2, "A b & c"), (1, "T")]


def test_context_of_a_term_is_that_of_its_line(spark):
    from fumiyomi.operators import terms

    text = "# no API(x)\n<!-- API API -->API here\nplain ABC line"
    docs = spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")
    seen = spark.createDataFrame([("d", 2, "API"), ("d", 1, "ABC")], "doc_id string, line int, term string")
    got = {r["term"]: r for r in terms.with_context(seen, docs, around=5).collect()}
    assert (got["API"]["n"], got["API"]["context"], got["API"]["has_gloss"]) == (2, "API here", False)
    assert (got["ABC"]["n"], got["ABC"]["context"]) == (1, "# no API(x)")


def test_long_texts_are_tokenized_in_parts():
    from fumiyomi.functions import tokenizer

    text = "これは長い文で、とても続く。" * 1500 + "x" * 60_000
    found = tokenizer.all_tokens(text, str(tokenizer.DEFAULT))
    raw = text.encode()
    assert len(raw) > 2 * tokenizer.MOST_BYTES and "".join(t["surface"] for t in found) == text
    assert all(raw[t["byte_start"] : t["byte_end"]].decode() == t["surface"] for t in found)
