"""Small documents whose findings were counted by hand."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fumiyomi.functions.tokenizer import tokens_of

_EVEN = "雨の日に私は駅まで歩いて本を読む。"
DOCS: list[tuple[str, str | None, str]] = [
    ("d01", "essay", "さて、重要なのは検証だと言えます。言うまでもなく、検証は不可欠だ。\n非常に重要な資料を読むと、さて、と思う。"),
    ("d02", "tech", "調査することができる。利用することが可能です。という観点から見る。\nこの方法にとって重要な点は、分析することによって分かる。"),
    ("d03", None, "雨ではなく、雪だ。駅ではなく、家だ。朝だけでなく夜も読む。\n本だけでなく紙も使う。人ではなく、資料を見る。"),
    ("d04", None, "この事実は問題を示す。これが変化をもたらす。雨が降ることは季節を意味する。\n人は本を読む。"),
    ("d05", None, "それは問題である。なぜなら調査を行ったからだ。\nこれは資料だ。なぜなら会議で使うからだ。私は駅まで歩く。"),
    ("d06", "business", "# はじめに\n本文である。\n## まとめ\n**要点**と**課題**と**方法**を書く。\n# 1. 結論\n- **名前**: 東京\n- **場所**：京都\n- ✅ 済み\n* 📌 メモ"),
    ("d07", "tech", "- 一つ\n- 二つ\n- 三つ\n1. 四つ\n2) 五つ\n本文一。\n本文二。\n本文三。\n本文四。\n本文五。\n+ 六つ"),
    ("d08", None, "フェーズ1で調べ、ステップ 2で書き、段階３で読む。ステージ4は無い。\n🎉🎉🎉と⭐を付ける。"),
    ("d09", None, "革命的な方法だ。圧倒的な結果が、劇的に変わる。\n```\n革命的なコード\n```\n> 究極の引用\n最強の本だ。"),
    ("d10", None, "しかし雨だ。また歩く。\n\nそして駅に行く。本を読む。\n\n朝に書く。夜に読む。\n\n人が来る。人が行く。"),
    ("d11", "essay", "私は朝の駅で長い資料を読みながら新しい方法の問題と課題と結果を一つずつ確認してその説明を会議で使う本のために書いて人に見せることを考えているのである。\n短い文だ。"),
    ("d12", None, _EVEN * 6),
    ("d13", None, "---\ntitle: x\n---\n本文だ。\n| 表 | 値 |\n|---|---|\n[1] 参考文献\n[^2]: 脚注\n#A 注釈\n[https://example.org/a:embed:cite]\n~~~\ncode\n~~~~ end\n終わりだ。"),
    ("d14", None, "APIとHTTP2を使う。API（応用の窓口）とは約束だ。\nコンピューターとサーバーの話。XAPIYは無関係。ABC1とabcと\n"),
    ("d15", None, "# ①概要\n# 【重要】\n# 検証とは？\n# はじめに\n#### 2、背景\n####### 違う\n#違う\n## まとめと今後 ##"),
]
SENTENCES: list[tuple[str, str]] = [
    ("t01", "この事実は問題を示すことができる。調査することができた。"),
    ("t02", "調査を行い、結果を説明した。検証を行う。研究を行われる。本を行う。"),
    ("t03", "これは変化をもたらす。人は本を読む。そのことが課題を示す。"),
    ("t04", "高くないとは言えない。無いわけではない。読まなければならない。"),
    ("t05", "私の家の庭の木。私の本と、彼の家の庭。朝の駅の人の資料の山。"),
    ("t06", "東京、京都、大阪、そして歩く。本、資料を読む。問題、課題、方法、結果、資料である。"),
    ("t07", "情報処理技術者試験を見る。東京情報処理技術者試験を見る。短文だ。"),
    ("t08", "雨の朝。駅の人。本の山。私は歩く。人は読む。資料を見る。"),
    ("t09", "調査の結果である。検証の結果である。分析の結果である。本は高いだろう。駅は新しいらしい。これは問題か。"),
    ("t10", "私は本を読む。私は駅を見る。私は朝に歩く。私は資料を使う。私は人を見る。私は結果を示す。"),
]


def token_rows() -> tuple[list[tuple], list[tuple]]:
    """Sentences (doc_id, sent_idx, line, sentence, end_mark) and tokens of the fixture, each sentence a line of its own text."""
    sents, toks = [], []
    for doc, text in SENTENCES:
        for i, part in enumerate(re.findall("[^。！？!?]+[。！？!?]?", text), 1):
            body, mark = part.rstrip("。！？!?"), part[-1] if part[-1] in "。！？!?" else None
            sents.append((doc, i, 1, body, mark))
            toks += [(doc, i, 1, k, t["surface"], t["pos1"], t["pos2"], t["pos3"], t["lemma"], t["reading"]) for k, t in enumerate(tokens_of(body))]
    return sents, toks


def docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOCS, "doc_id string, genre string, text string")


def sentence_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(token_rows()[0], "doc_id string, sent_idx int, line int, sentence string, end_mark string")


def token_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(token_rows()[1], "doc_id string, sent_idx int, line int, tok_idx int, surface string, pos1 string, pos2 string, pos3 string, lemma string, reading string")
