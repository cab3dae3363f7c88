"""Classifiers by held-out accuracy, counts and models against plain loops, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fumiyomi.llm import langid, quality_lm, quality_rules, toxicity
from fumiyomi.llm.common import documents, held_out, words

NAMES = {"a": "ka to mi ren so lu", "b": "dor an es qui ble vi", "c": "zu hy gon ped rul wex"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(NAMES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Three languages; a fifth is toxic by words with a common stem; a fifth is junk."""
    rng, rows, marks = random.Random(2), [], []
    for i in range(900):
        lang = "abc"[i % 3]
        text = "\n".join(sentence(rng, lang, rng.randint(6, 25)) for _ in range(rng.randint(2, 6)))
        toxic, junk = i % 5 == 1, i % 5 == 3
        if toxic:
            w = text.split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "vequx" + rng.choice(["", "al", "oro", "ist"]))
            text = " ".join(w)
        if junk:
            text = " ".join(w.upper() + rng.choice(["%%%", "###", "&&&"]) for w in text.split())
        rows.append((i, text, lang, f"h{i % 4}", len(text)))
        marks.append((i, 0 if junk else 1, int(toxic)))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_held_out_is_crc(spark):
    got = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)} | {None: True}


def test_toxicity_on_held_out_rows(spark, corpus):
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    got = toxicity.op1_toxicity(spark, corpus).join(labels, "doc_id").toPandas()
    apart = got[got["held_out"]]
    assert len(got) == 900 and (apart["predicted"] == apart["toxic"]).mean() > 0.97
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_scores_see_only_the_text(spark, corpus):
    docs = documents(spark, corpus)
    model = toxicity.fit(toxicity.sample(docs, spark.read.parquet(f"{corpus}/labels.parquet")))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("?")})
    a = toxicity.score(docs, model).orderBy("doc_id").toPandas()
    b = toxicity.score(other, model).orderBy("doc_id").toPandas()
    assert np.allclose(a["score"], b["score"])
    batch = [toxicity._coder(t) for t in ["ka to vequxal mi", "", None, "ka"]]
    assert np.allclose(model.scores(batch), [model.scores([x])[0] for x in batch], atol=1e-5)  # alone as in a batch


def test_gradient_of_the_classifier():
    """One step of a small learning rate lowers the loss of its batch."""
    model = toxicity.Cnn()
    texts = [toxicity._coder(t) for t in ["bad word here", "good word here", "all is bad", "all is fine"]]
    labels = np.array([1, 0, 1, 0], np.float32)

    def loss():
        p = model.scores(texts)
        return float(-np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))

    before = loss()
    model.train(texts, labels, epochs=3, rate=0.01)
    assert loss() < before


def test_best_cut():
    assert toxicity.best_cut(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == pytest.approx(0.5)


def test_gradient_against_differences():
    """One step of training moves each weight as finite differences of the loss say; a plain loop gives the same scores."""
    rng = np.random.default_rng(2)
    model = toxicity.Cnn(3)
    texts = [np.array([toxicity.code(f"w{rng.integers(9)}") for _ in range(n)], np.int64) for n in (1, 4, 9, 2)]

    def plain(text):
        rows = [np.zeros(toxicity.DIM)] * 2 + [sum(model.rows[r] for r in model.words(np.array([c]))[1][0]).astype(float) for c in text] + [np.zeros(toxicity.DIM)] * 2
        pooled = []
        for w, f in zip(toxicity.WIDTHS, model.filters, strict=True):
            at = range(3 - w, 2 + len(text))
            pooled += [max(sum(rows[i + j] @ f[j][:, k] for j in range(w)) for i in at) for k in range(toxicity.FILTERS)]
        return np.maximum(np.array(pooled) + model.offset, 0) @ model.out + model.bias[0]

    assert np.allclose(model.logits(texts), [plain(t) for t in texts], atol=1e-4)


def test_slices_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(5)
    model = toxicity.Cnn(1)
    texts = [np.array([toxicity.code(f"w{rng.integers(50)}") for _ in range(n)], np.int64) for n in (400, 0, 1, 37, 900)]
    whole = model.logits(texts)
    trees = langid.ContextTrees({"a": ["some words of a text " * 9], "b": ["других слов здесь нет " * 9]})
    raw = [b"", "words of другой текст ".encode() * 30, b"x", b"a text " * 50]
    bits = trees.bits(raw)
    for n in (3, 50, 211):
        monkeypatch.setattr(toxicity, "SLICE", n)
        monkeypatch.setattr(langid, "SLICE", n)
        assert np.allclose(model.logits(texts), whole, atol=1e-5) and np.allclose(trees.bits(raw), bits)


def test_a_long_labelled_text_does_not_empty_the_sample():
    n = np.array([5, 900, 7, 8, 2000, 6])
    kind = np.array([0, 0, 1, 0, 1, 1])
    assert toxicity.fitting(n, kind, 40).tolist() == [True, False, True, True, False, True]
    assert toxicity.fitting(np.array([90, 80, 3]), np.array([0, 0, 1]), 20).tolist() == [False, True, True]


def test_tokens_of_pairs_are_those_of_the_pattern(monkeypatch):
    """Words, marks and characters of scripts without spaces as TOKEN parts them, also where a long text is cut."""
    texts = ["Ein Satz, 12 Wörter_und mehr. " * 20, None, "", "日本語のテキスト and words", "a", "x" * 90 + " y", "one  two\n\nthree \u00a0 four", "😀😀 мир1 ๑๒"]
    for n in (1_000_000, 40):
        monkeypatch.setattr(quality_lm, "SLICE", n)
        p = quality_lm.Pairs(texts)
        for i, t in enumerate(texts):
            own = np.flatnonzero(p.doc == i)
            found = quality_lm.TOKEN.findall(t or "")
            assert [p.words[p.last[k]] for k in p.pair[own]] == found
            assert [p.words[p.before[k]] for k in p.pair[own]] == ["", *found][: len(found)]
            assert p.chars[i] == sum(len(w) + 1 for w in found)
        grams = quality_lm.four_grams([t for t in texts if t])
        if n == 1_000_000:
            whole = grams
        assert all((a == b).all() for a, b in zip(grams, whole, strict=True))


def test_no_labels(spark, docs, labels):
    assert toxicity.fit(toxicity.sample(docs, labels)) is None  # one class alone
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.keep(docs, None).count() == docs.count()


def test_languages_on_held_out_rows(spark, corpus):
    got = langid.op5_language_id(spark, corpus).join(documents(spark, corpus).select("doc_id", "lang"), "doc_id").toPandas()
    apart = got[got["held_out"]]
    assert (apart["lang"] == apart["lang_pred"]).mean() > 0.99 and got["score"].between(0, 1).all()


def test_code_lengths_are_those_of_the_trees():
    """The tables against trees walked byte by byte."""
    rng = random.Random(3)
    samples = {l: [sentence(rng, l, 12) for _ in range(6)] for l in "ab"}
    trees = langid.ContextTrees(samples)
    counts = {l: defaultdict(Counter) for l in samples}
    for l, texts in samples.items():
        for t in texts:
            raw = langid.PAD + langid.folded(t)
            raw += langid.PAD
            for i in range(3, len(raw)):
                for k in range(4):
                    counts[l][raw[i - k : i]][raw[i]] += 1
    kept = {c for l in samples for c, n in counts[l].items() if sum(n.values()) >= 2}  # the tree's own bound
    seen = {b for l in samples for t in samples[l] for b in langid.folded(t)} | set(langid.PAD)

    def p(l, ctx, b):
        n = counts[l].get(ctx, {}) if not ctx or ctx in kept else {}
        lower = (lambda x: 1 / 256) if not ctx else (lambda x: p(l, ctx[1:], x))
        if not n:
            return lower(b)
        total, kinds = sum(n.values()), len(n)
        if b in n:
            return n[b] / (total + kinds)
        return kinds / (total + kinds) * lower(b) / (1 - sum(lower(x) for x in n))

    text = langid.folded("ka tomi dor Q ble")
    bits = trees.bits([text, b"", text])
    for j, l in enumerate(trees.langs):
        raw = langid.PAD + text
        expect = -sum(math.log2(p(l, raw[i - 3 : i], raw[i])) for i in range(3, len(raw)) if raw[i] in seen)
        odd = sum(1 for b in text if b not in seen)
        assert bits[0, j] >= expect - 1e-3 and (odd or bits[0, j] == pytest.approx(expect, abs=1e-3))
        if not odd:
            assert bits[2, j] == pytest.approx(bits[0, j])
    assert bits[1].tolist() == [0.0, 0.0]


def test_undetermined(spark, docs, empty):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert got[45]["lang_pred"] == got[46]["lang_pred"] == got[47]["lang_pred"] == "und" and got[46]["score"] == 0
    assert got[49]["lang_pred"] in ("en", "fr")
    assert langid.identify(empty).collect() == []
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_base_counts_by_hand(docs):
    for r in docs.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        assert quality_rules.base_counts(r["text"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))


def test_frequent_lines(spark, tmp_path):
    rows = [(i, f"Own line number {i} with some more words in it here.\nCommon  LINE of the host\n", "h1") for i in range(8)]
    rows += [(100 + i, "common line of the host\nsecond common line of all\nx", "h1") for i in range(5)] + [(200, "common line of the host", "h2"), (201, None, None), (202, "", "h1"), (None, "a b", None)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, max_docs=6).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_removed_words"] == 5 and got[i]["kept"] for i in range(8))
    assert all(got[100 + i]["n_removed_words"] == 5 and not got[100 + i]["kept"] for i in range(5))
    assert got[200]["n_removed_words"] == 0 and not got[201]["kept"] and got[202]["base_failed"]
    cleaned = {r["doc_id"]: r["text"] for r in quality_rules.clean(docs, max_docs=6).collect()}
    assert "LINE" not in cleaned[0] and "Own line number 0" in cleaned[0] and cleaned[100] == "second common line of all\nx" and cleaned[200] == "common line of the host" and cleaned[201] is None


def plain_kneser_ney(texts):
    """Probabilities of the model by its definition, over codes of symbols."""
    table = quality_lm.classes()
    grams = {4: Counter()}
    for t in texts:
        x = [0, 0, 0] + [int(table[ord(c)]) for c in t]
        for i in range(3, len(x)):
            grams[4][tuple(x[i - 3 : i + 1])] += 1
    for k in (3, 2, 1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    less = {}
    for k, g in grams.items():
        n = [sum(v == i for v in g.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 0.7, 3 - 4 * y * n[4] / n[3] if n[3] else 0.9]
        less[k] = [min(max(x, 0.05), i + 0.9) for i, x in enumerate(d)]

    def p(ctx, w):
        k = len(ctx) + 1
        lower = p(ctx[1:], w) if ctx else 1 / 64
        here = {g[-1]: n for g, n in grams[k].items() if g[:-1] == ctx}
        if not here:
            return lower
        total = sum(here.values())
        off = lambda n: less[k][min(n, 3) - 1]
        return (max(here.get(w, 0) - off(here[w]), 0) / total if w in here else 0) + sum(map(off, here.values())) / total * lower

    return p


def test_model_is_kneser_ney(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, sentence(rng, "a", 8)) for i in range(12)] + [(50, None), (51, "")]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    lengths = quality_lm.table(docs, docs.filter("doc_id < 8 or doc_id >= 50").select("doc_id"))
    p = plain_kneser_ney([t for i, t in rows if i < 8])
    for text in ("Ka to mi.", rows[9][1], "Zz % 9"):
        x = [0, 0, 0] + [int(quality_lm.classes()[ord(c)]) for c in text]
        expect = -sum(math.log2(p(tuple(x[i - 3 : i]), x[i])) for i in range(3, len(x)))
        assert quality_lm.code_lengths([text, "", None], lengths)[1][0] == pytest.approx(expect, abs=0.002 * len(text))
    dense = 2.0 ** -(lengths.reshape(-1, 64) / quality_lm.UNIT)
    assert np.allclose(dense.sum(1), 1, atol=0.01)  # a distribution in each context


def plain_words(texts):
    """Bits of a text by the word model's definition: exact counts of pairs, no hashes."""
    cut = quality_lm.TOKEN.findall
    two = Counter(x for t in texts for x in zip(["", *cut(t)], cut(t)))
    one = Counter(b for _, b in two)

    def less(g):
        n = [sum(v == i for v in g.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 0.7, 3 - 4 * y * n[4] / n[3] if n[3] else 0.9]
        return [0, *(min(max(x, 0.05), i + 0.9) for i, x in enumerate(d))]

    d1, d2 = less(one), less(two)
    total, off = Counter(), Counter()
    for (a, _), n in two.items():
        total[a] += n
        off[a] += d2[min(n, 3)]

    def bits(text, lengths):
        words = cut(text)
        spell = dict(zip(words, quality_lm.spelled(words, lengths), strict=True))
        out = 0
        for a, b in zip(["", *words], words):
            p = (one[b] - d1[min(one[b], 3)] + sum(d1[min(n, 3)] for n in one.values()) * 2 ** -spell[b]) / sum(one.values())
            out -= math.log2((two[a, b] - d2[min(two[a, b], 3)] + off[a] * p) / total[a] if total[a] else p)
        return out

    return bits


def test_word_model_is_kneser_ney(spark, tmp_path):
    """Words, digits and letters of other scripts count as they are; the order of words does, too; a trusted text isn't judged by itself."""
    rng = random.Random(4)
    cyrillic = ["мир", "дом", "река", "лес", "поле"]
    rows = [(i, " ".join([sentence(rng, "a", 8), *(rng.choice(cyrillic) for _ in range(9))])) for i in range(60)]
    rows += [(60, "one strange text that stands alone"), (70, "one strange text that stands alone"), (71, "мир дом река лес поле"), (72, "рми модкере сел епло"), (73, None)]
    rows += [(74 + i, "east then west then north") for i in range(3)] + [(80, "east then west"), (81, "west east then")]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, lang string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    good = docs.filter("doc_id <= 60 or doc_id between 74 and 76").select("doc_id")
    lengths = quality_lm.table(docs, good)
    got = {r["doc_id"]: r for r in quality_lm.rates(docs, good, lengths).collect()}
    bits = plain_words([t for i, t in rows if i <= 60 or 74 <= i <= 76])
    assert len(got) == len(rows) and all(got[i]["trust"] == (i <= 60 or 74 <= i <= 76) for i, _ in rows)
    for i, t in rows:
        if not got[i]["trust"]:
            assert got[i]["bits"] == pytest.approx(bits(t or "", lengths), abs=1e-6)
    assert got[60]["bits"] > got[70]["bits"] + 10  # without its own counts
    assert got[72]["bits"] / got[72]["chars"] > 1.5 * got[71]["bits"] / got[71]["chars"]  # gibberish of the same letters
    assert got[81]["bits"] > got[80]["bits"] + 1 and got[81]["chars"] == got[80]["chars"]  # the order of words


def test_quality_on_a_corpus(spark, corpus):
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    got = quality_lm.op8_quality_lm(spark, corpus).join(labels, "doc_id").toPandas()
    assert len(got) == 900
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.99
    kept = quality_lm.keep(documents(spark, corpus), labels)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(got[got["kept"]]["doc_id"])


def test_quality_edge_cases(docs, empty, clashing, labels):
    got = quality_lm.classify(docs, labels)
    assert got.count() == docs.count() and {r["kept"] for r in got.filter("doc_id in (45, 46)").collect()} == {True}
    assert quality_lm.classify(empty, labels).collect() == [] and quality_lm.classify(docs, labels.limit(0)).filter("kept").count() == docs.count()
    assert quality_lm.keep(clashing, labels).columns == clashing.columns
    for fn in (quality_rules.judge, quality_rules.clean, lambda d: toxicity.score(d, None), langid.identify):
        assert fn(empty).collect() == [] and fn(clashing).count() == docs.count()


def test_pipeline(spark, corpus):
    import corpus_pipeline as pipe

    assert [n for n, _ in pipe.STAGES] == ["quality", "toxicity", "near_duplicates", "repeated_passages", "packing"]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    docs = documents(spark, corpus)
    kept = {}
    from fumiyomi.llm.common import written

    for name, stage in pipe.STAGES[:-1]:
        docs = written(stage(spark, docs, corpus), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {i for i, r in labels.items() if r["quality"]} - kept["quality"] == set()
    wrong = {i for i in kept["toxicity"] if labels[i]["toxic"]}
    clean = {i for i in kept["quality"] if not labels[i]["toxic"]}
    assert len(wrong) < 10 and len(clean - kept["toxicity"]) < 10
    assert kept["repeated_passages"] == kept["near_duplicates"]
    packed = pipe.STAGES[-1][1](spark, docs, corpus)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == kept["repeated_passages"]
    assert pipe.run(spark, corpus).count() == packed.count()


def test_pipeline_on_odd_rows(spark, docs, labels, tmp_path):
    import corpus_pipeline as pipe

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert pipe.run(spark, str(tmp_path)).count() > 0


def test_table_of_frames():
    from fumiyomi.llm.common import by_bytes

    frame = pd.DataFrame({"text": ["aa", None, "bbbb", "c" * 9, "d"]})
    parts = list(by_bytes(iter([frame]), "text", 5))
    assert [p["text"].tolist() for p in parts] == [["aa", None], ["bbbb"], ["c" * 9], ["d"]]
    assert words(None) == [] and words(" a  b ") == ["a", "b"]
