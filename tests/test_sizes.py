"""Work that must not grow with what no rule or phrase asks for, and queries beside their SQL where large tables differ from small ones."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from fumiyomi.functions import tokenizer
from fumiyomi.operators import phrases, terms
from fumiyomi.operators.blocks import structured
from fumiyomi.operators.frames import sentences
from fumiyomi.plans.lint import frames
from fumiyomi.plans.queries import ORACLE, QUERIES


def test_phrase_index_of_phrases_that_overlap_themselves(spark, tmp_path):
    tables = {"documents": [(1, "x to be or to be or to be or to\nto be or to"), (2, "日本 to be or to be or to"), (3, None), (4, "be or not")], "benchmark": [(1, "to be or to"), (2, "日本 to be or"), (3, "a b")]}
    con = duckdb.connect()
    for name, rows in tables.items():
        spark.createDataFrame(rows, f"{'doc_id' if name == 'documents' else 'item_id'} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = con.sql(ORACLE["phrase_index"])
    ours = sorted(tuple(r[c] for c in found.columns) for r in QUERIES["phrase_index"](spark, str(tmp_path)).collect())
    assert ours == sorted(found.fetchall()) == [("to be or to", 2, 4), ("日本 to be or", 1, 1)]


def test_only_places_of_the_sought_gram_travel():
    """A text full of a phrase's other grams gives no rows."""
    phrase = "the end of the very long story"
    grams = next(phrases.phrase_grams([pa.RecordBatch.from_pydict({"phrase": [phrase]})])).to_pylist()
    sought = grams[-1]  # " very long story"
    bits = 12
    table = np.zeros(1 << (bits - 6), np.uint64)
    for s in phrases._slots(np.array([sought["gram"]], np.int64).view(np.uint64), bits):
        table[s >> np.uint64(6)] |= np.uint64(1) << (s & np.uint64(63))
    texts = pa.RecordBatch.from_pydict({"k": [1, 2, 3], "text": ["the end of the story, the end of the long" * 2000, None, "é" + phrase]})
    rows = [r for b in phrases.placing({16: (table, bits)}, ["k"], len(phrase))([texts]) for r in b.to_pylist() if r["gram"] == sought["gram"]]
    assert [(r["k"], r["place"] - sought["chars"]) for r in rows] == [(3, 1)]


def test_sentences_take_no_whole_lines_along(spark):
    """A line of very many sentences isn't carried by each of them through the windows; where something is masked, raw_text is still
    what the line has."""
    docs = spark.createDataFrame([(1, "à b. " * 3 + "c! " * 500), (2, "`x y` はい。 <b>z</b>だ！")], "doc_id long, text string")
    rows = sentences(structured(docs))
    from_line = [r for r in rows.filter("doc_id = 2").select("sentence", "raw_text", "byte_start").collect()]
    assert [(r.sentence, r.raw_text) for r in from_line] == [("はい", "`x y` はい"), ("z    だ", "<b>z</b>だ")]
    assert {r.raw_text for r in rows.filter("doc_id = 1").collect()} == {"à b. à b. à b. c", "c"}
    below = rows._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1]
    assert re.search(r"CASE WHEN NOT \(masked#\d+ = raw#\d+\) THEN raw#\d+ END AS raw", below)


def test_stretches_between_runs_give_the_path_of_the_whole_sentence():
    rng, lex = random.Random(4), tokenizer.Lexicon()
    parts = [*list(lex.words)[::7], "API", " ", "12", "日本語", "テスト", "、", "(", "🎉", "é", "ないない", "Ａ１", "привет"]
    for _ in range(800):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert [lex.rows[k][0] for k in lex.numbered(x)] == [w.surface for _, w in lex.tokenize(x)]
        assert [lex.rows[k][2:5] for k in lex.numbered(x)] == [w.pos for _, w in lex.path(x)]


def test_what_lint_keeps_is_about_the_text(spark):
    """Of sentences that no rule on tokens can hold in, neither the text nor the tokens are kept."""
    docs = spark.createDataFrame([(1, "tech", "A plain text. " * 50 + "\nこのことが問題だ。")], "doc_id long, genre string, text string")
    f = frames(docs)
    assert {r.sentence for r in f["facts"].select("sentence").collect()} == {None, "このことが問題だ"}
    assert "".join(r.surface for r in f["tokens"].orderBy("sent_idx", "tok_idx").collect()) == "このことが問題だ"
    spark.catalog.clearCache()


def test_few_tokens_meet_the_rules_of_terms(spark):
    """Only tokens of terms and those beside them become rows, and the terms are those of all tokens."""
    rng = random.Random(8)
    parts = ["Spark", "API", "テスト", "・", "ラン", "東京", "本", "は", " ", " plain words ", "。", "を", "x1", "X1", "日本語"]
    rows = [(k, 1, 1, "".join(rng.choice(parts) for _ in range(rng.randint(1, 10)))) for k in range(300)]
    sents = spark.createDataFrame(rows, "doc_id long, sent_idx int, line int, sentence string")
    near = terms.near_terms(sents, tokenizer.tokenize()("sentence"))
    every = tokenizer.token_frame(sents)
    found = lambda toks: sorted(tuple(r) for r in terms.token_terms(toks).collect())
    assert found(near) == found(every) != []
    assert near.count() < every.count() * 0.8
