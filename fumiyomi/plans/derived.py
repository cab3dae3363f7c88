"""Relations derived from the tables, the same rows as a DataFrame and as SQL: the tables hold no Markdown and no Japanese, so rules
on these get them from what each row's key says. Their size grows with the tables'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a line of an article becomes, by its number and its document's: the parts before and after it (None: the line itself goes).
SHAPES: list[tuple[str, str | None]] = [
    ("", ""), ("## ", ""), ("- ", ""), ("> ", ""), ("```", None), ("~~~~ x", None), ("| a | ", " |"), ("[1] ", ""), ("[^1]: ", ""), ("#A ", ""), ("---", None), ("<!-- ", " -->"),
    ("<!-- ", ""), ("", " --> x"), ("1. ", ""), ("", None), ("しかし、", "。"), ("このような中", "と言えるでしょう。"), ("本だけでなく紙も読むのではなく、", "だけでなく紙も使う。"), ("- **名前**: ", ""), ("", " `code` と <b>印</b> [先](http://x.y/z) だ？"),
    ("```` ", ""), ("# まとめ", None), ("さて、重要なのは", "だと言えます。さて、終わりだ！"), ("この事実は", "を意味する。これが変化をもたらす。"), ("", "することができます。という観点から見る。"), ("それは問題である。なぜなら", "だからだ。"),
    ("フェーズ1と段階２と", "。"), ("🎉⭐", "🎉"), ("革命的な", "は圧倒的な本だ。"), ("- ✅ ", ""), ("", "だけでなく紙も使う。"), ("情報処理技術者試験制度", "を読点なしで長い資料の問題と課題と結果を確認して説明を会議で使う本のために書いて人に見せることを考えているのである。"),
    ("", None), ("", ""), ("", ""), ("#### 1. ", "とは？ ##"), ("また", "。"), ("", " ---"), ("", ""), ("  ~~~~~", None),
]
GENRES = ["essay", "tech", "business", None]
STEP = (11, 17)


def _line_sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {k} THEN {q(a)}" + (f" || x || {q(b)}" if b is not None else "") for k, (a, b) in enumerate(SHAPES))
    return f"CASE WHEN i = 1 AND doc_id % 5 = 0 THEN '---' ELSE CASE (doc_id * {STEP[0]} + i * {STEP[1]}) % {len(SHAPES)} {cases} END END"


#: articles: doc_id, genre, text.
ARTICLES = (
    "articles AS (SELECT doc_id, CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{g}'" for k, g in enumerate(GENRES) if g) + " END AS genre, "
    f"array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_line_sql()}), chr(10)) AS text FROM documents)"
)


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, genre, text: documents whose lines have become Markdown and Japanese by turns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")

    def shaped(x, i):
        k = (F.col("doc_id") * STEP[0] + (i + 1) * STEP[1]) % len(SHAPES)
        before, after = (F.array(*[F.lit(s[j]) for s in SHAPES]) for j in (0, 1))
        own = F.when(F.get(after, k.cast("int")).isNotNull(), F.concat(x, F.get(after, k.cast("int")))).otherwise("")
        return F.when((i == 0) & (F.col("doc_id") % 5 == 0), "---").otherwise(F.concat(F.get(before, k.cast("int")), own))

    genre = F.get(F.array(*[F.lit(g) for g in GENRES]), (F.col("doc_id") % 4).cast("int"))
    return docs.select("doc_id", genre.alias("genre"), F.array_join(F.transform(F.split("text", "\n", -1), shaped), "\n").alias("text"))


def _blanked_sql(c: str, pattern: str, head: int = 0, tail: int = 0) -> str:
    """Matches of a pattern as blanks, but for so many bytes before and after (ASCII); line breaks stay."""
    kept = f"substring(p, 1, {head}) || " if head else ""
    end = f" || right(p, {tail})" if tail else ""
    blank = f"{kept}array_to_string(list_transform(string_split(p, chr(10)), lambda y: repeat(' ', strlen(y) - {head + tail})), chr(10)){end}" if head or tail else "array_to_string(list_transform(string_split(p, chr(10)), lambda y: repeat(' ', strlen(y))), chr(10))"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({c}, '{pattern}'), list_transform(regexp_extract_all({c}, '{pattern}'), lambda p: {blank})), lambda z: z[1] || coalesce(z[2], '')), '')"


def blocks_sql(source: str = "articles", key: str = "doc_id, genre", text: str = "text") -> str:
    """bl: key, line, raw, bare, kind, masked of a relation's lines; the state of blocks goes on from line to line."""
    first = key.split(",")[0].strip()
    bare = _blanked_sql(text, r"(?s)<!--.*?(?:-->|\z)")
    ticks, rule = r"^\s*(`{3,}|~{3,})", r"^\s*---\s*$"
    inline = _blanked_sql("bare", "``[^\\n]*?``|`[^`\\n]+`")
    tags = _blanked_sql("masked0", r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^>\n]*)?/?>")
    urls = _blanked_sql("masked1", r"\]\([^)]*\)", 2, 1)
    return rf"""ln AS MATERIALIZED (SELECT {key}, unnest(r) AS raw, unnest(b) AS bare, generate_subscripts(r, 1) AS line FROM (SELECT {key}, string_split({text}, chr(10)) AS r, string_split({bare}, chr(10)) AS b FROM {source})),
mk AS MATERIALIZED (SELECT *, regexp_extract(bare, '{ticks}', 1) AS mark, regexp_matches(bare, '{rule}') AS is_rule FROM ln),
st AS (SELECT {first}, line, mark, is_rule, CASE WHEN is_rule THEN '-' ELSE mark END AS state, CASE WHEN is_rule THEN 'front_matter' WHEN mark <> '' THEN 'fence' END AS block FROM mk WHERE line = 1
  UNION ALL SELECT m.{first}, m.line, m.mark, m.is_rule,
    CASE WHEN s.state = '-' THEN CASE WHEN m.is_rule THEN '' ELSE '-' END WHEN s.state <> '' THEN CASE WHEN m.mark[1] = s.state[1] AND length(m.mark) >= length(s.state) THEN '' ELSE s.state END ELSE m.mark END,
    CASE WHEN s.state = '-' THEN 'front_matter' WHEN s.state <> '' OR m.mark <> '' THEN 'fence' END
  FROM st s JOIN mk m ON m.{first} = s.{first} AND m.line = s.line + 1),
kd AS MATERIALIZED (SELECT ln.*, CASE WHEN block IS NOT NULL THEN block WHEN regexp_matches(bare, '^\s*#{{1,6}}([\t\f\r ]|$)') THEN 'heading' WHEN regexp_matches(bare, '^\s*([-*+] |[0-9]+[.)][\t\f\r ])') THEN 'list' WHEN regexp_matches(bare, '^\s*>') THEN 'quote'
  WHEN regexp_matches(bare, '^\s*\|[^|]*\|') OR (contains(bare, '|') AND regexp_full_match(bare, '[\s|:-]*')) THEN 'table' WHEN regexp_matches(bare, '^\s*\[https?://[^\]\n]+:embed:cite\]$') THEN 'embed'
  WHEN regexp_matches(bare, '^\s*\[([0-9]+\][ \t:]|\^[^\]]+\]:)') THEN 'reference' WHEN regexp_matches(bare, '^\s*#[A-Z] ') THEN 'code_note' WHEN regexp_full_match(bare, '\s*') THEN 'blank' ELSE 'text' END AS kind FROM ln JOIN st USING ({first}, line)),
m0 AS (SELECT *, CASE WHEN kind IN ('text', 'blank') THEN {inline} ELSE '' END AS masked0 FROM kd), m1 AS (SELECT *, {tags} AS masked1 FROM m0), bl AS MATERIALIZED (SELECT * EXCLUDE (masked0, masked1), {urls} AS masked FROM m1)"""


#: Tokens that words become: surface, parts of speech, lemma, reading.
LEXICON: list[tuple[str, str, str, str, str, str]] = [
    ("こと", "名詞", "普通名詞", "一般", "こと", "コト"), ("が", "助詞", "格助詞", "*", "が", "ガ"), ("でき", "動詞", "非自立可能", "*", "できる", "デキ"), ("する", "動詞", "非自立可能", "*", "する", "スル"), ("調査", "名詞", "普通名詞", "サ変可能", "調査", "チョウサ"),
    ("を", "助詞", "格助詞", "*", "を", "ヲ"), ("行う", "動詞", "一般", "*", "行う", "オコナウ"), ("行い", "動詞", "一般", "*", "行う", "オコナイ"), ("の", "助詞", "格助詞", "*", "の", "ノ"), ("の", "助詞", "格助詞", "*", "の", "ノ"), ("の", "助詞", "格助詞", "*", "の", "ノ"),
    ("これ", "代名詞", "*", "*", "これ", "コレ"), ("は", "助詞", "係助詞", "*", "は", "ハ"), ("この", "連体詞", "*", "*", "この", "コノ"), ("事実", "名詞", "普通名詞", "一般", "事実", "ジジツ"), ("示す", "動詞", "一般", "*", "示す", "シメス"), ("もたらす", "動詞", "一般", "*", "もたらす", "モタラス"),
    ("ない", "形容詞", "非自立可能", "*", "ない", "ナイ"), ("なけれ", "形容詞", "非自立可能", "*", "ない", "ナケレ"), ("ば", "助詞", "接続助詞", "*", "ば", "バ"), ("なら", "動詞", "非自立可能", "*", "なる", "ナラ"), ("ん", "助動詞", "*", "*", "ん", "ン"), ("、", "補助記号", "読点", "*", "、", ""), ("、", "補助記号", "読点", "*", "、", ""),
    ("情報処理", "名詞", "普通名詞", "一般", "情報処理", "ジョウホウショリ"), ("技術者", "名詞", "普通名詞", "一般", "技術者", "ギジュツシャ"), ("東京", "名詞", "固有名詞", "地名", "東京", "トウキョウ"), ("キャラ", "名詞", "普通名詞", "一般", "キャラ", "キャラ"), ("らしい", "助動詞", "*", "*", "らしい", "ラシイ"), ("だ", "助動詞", "*", "*", "だ", "ダ"),
    ("である", "助動詞", "*", "*", "だ", "デアル"), ("か", "助詞", "終助詞", "*", "か", "カ"), ("れる", "助動詞", "*", "*", "れる", "レル"), ("API", "名詞", "固有名詞", "一般", "API", "エーピーアイ"), ("そのこと", "名詞", "普通名詞", "一般", "そのこと", "ソノコト"), ("本", "名詞", "普通名詞", "一般", "本", "ホン"), ("A", "名詞", "普通名詞", "一般", "A", "エー"), (".", "補助記号", "句点", "*", ".", ""),
]
_TOKEN = "surface, pos1, pos2, pos3, lemma, reading"
#: tok: doc_id, sent_idx, line, tok_idx and a lexicon row for each word of a document; sent: the sentences they make.
TOKENS = (
    "lex AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, " + ", ".join(f"'{x}'" for x in row) + ")" for k, row in enumerate(LEXICON)) + f") AS v(k, {_TOKEN})), "
    r"wd AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS ix FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)), "
    f"tok AS MATERIALIZED (SELECT doc_id, ((ix - 1) // 14 + 1)::INT AS sent_idx, ((ix - 1) // 28 + 1 + ((ix - 1) // 56) % 2)::INT AS line, ((ix - 1) % 14)::INT AS tok_idx, {_TOKEN} FROM wd JOIN lex ON k = ('0x' || substring(md5(word || (ix % 7)), 1, 6))::BIGINT % {len(LEXICON)}), "
    "sent AS MATERIALIZED (SELECT doc_id, sent_idx, any_value(line) AS line, string_agg(surface, '' ORDER BY tok_idx) AS sentence, CASE WHEN sent_idx % 9 = 0 THEN '？' WHEN sent_idx % 4 > 0 THEN '。' END AS end_mark FROM tok GROUP BY ALL)"
)


def token_frame(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, sent_idx, line, tok_idx and a token for each word of a document: sentences of fourteen."""
    words = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("at", "word"))
    k = F.conv(F.substring(F.md5(F.concat("word", ((F.col("at") + 1) % 7).cast("string")).cast("binary")), 1, 6), 16, 10).cast("int") % len(LEXICON)
    lexicon = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(row, _TOKEN.split(", "), strict=True)]) for row in LEXICON])
    line = F.floor(F.col("at") / 28) + 1 + F.floor(F.col("at") / 56) % 2
    return words.select("doc_id", (F.floor(F.col("at") / 14) + 1).cast("int").alias("sent_idx"), line.cast("int").alias("line"), (F.col("at") % 14).cast("int").alias("tok_idx"), F.get(lexicon, k).alias("t")).select("doc_id", "sent_idx", "line", "tok_idx", "t.*")


def sentence_frame(tokens: DataFrame) -> DataFrame:
    """The sentences of token_frame: doc_id, sent_idx, line, sentence, end_mark."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "surface"))), lambda x: x["surface"]), "")
    mark = F.when(F.col("sent_idx") % 9 == 0, "？").when(F.col("sent_idx") % 4 > 0, "。")
    return tokens.groupBy("doc_id", "sent_idx").agg(F.min("line").alias("line"), whole.alias("sentence")).withColumn("end_mark", mark)


#: Findings of two runs: half of the events each, by different keys.
CATEGORIES = ["forbidden_phrase", "low_burstiness", "translationese", "hype_expression", "no_chain"]


def findings_sql(now: bool) -> str:
    keep = "event_id % 3 <> 0" if now else "event_id % 5 <> 0"
    cases = " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CATEGORIES))
    extra = " || ' '" if now else ""
    return f"(SELECT 'u' || (user_id % 400) AS file, event_id AS ord, CASE event_id % {len(CATEGORIES)} {cases} END AS category, event_type{extra} || (event_id % 3) || ' of the run' AS excerpt FROM events WHERE {keep} AND user_id % 50 <> {7 if now else 8})"


def findings(spark: SparkSession, sf: str, now: bool) -> DataFrame:
    """file, ord, category, excerpt of the run now or of the one before."""
    rows = spark.read.parquet(f"{sf}/events.parquet").filter((F.col("event_id") % (3 if now else 5) != 0) & (F.col("user_id") % 50 != (7 if now else 8)))
    category = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("event_id") % len(CATEGORIES)).cast("int"))
    excerpt = F.concat("event_type", F.lit(" " if now else ""), (F.col("event_id") % 3).cast("string"), F.lit(" of the run"))
    return rows.select(F.concat(F.lit("u"), (F.col("user_id") % 400).cast("string")).alias("file"), F.col("event_id").alias("ord"), category.alias("category"), excerpt.alias("excerpt"))
