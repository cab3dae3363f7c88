"""Rules, word lists and thresholds, as data."""

from __future__ import annotations

from dataclasses import dataclass

# Phrases, patterns and thresholds that results depend on.
PHRASES = [
    "と言えるでしょう", "と言えるだろう", "と言えます", "ということになるでしょう", "のではないでしょうか", "重要なのは", "大切なのは", "ポイントは",
    "結論から言うと", "結論として", "いかがでしたか", "いかがでしょうか", "まとめると", "総じて", "非常に重要", "極めて重要", "言うまでもなく",
    "言うまでもありません", "まさしく", "さて、", "それでは、", "このように", "このような中", "ここで注目したいのは", "見ていきましょう", "紹介していきます",
    "解説していきます", "深掘りしていきます", "一概には言えません", "個人差がありますが", "あくまで一例ですが", "正面から扱う", "正面から見る", "正面から書く",
    "正面から立てる", "正面から回収する", "不可欠", "核心的", "鍵となる", "根本的な", "多角的", "包括的", "総合的", "掘り下げる", "深掘りする", "言語化する",
    "について見ていく", "を探求する",
]
WEAK_PHRASES = ["重要なのは", "このように", "不可欠", "ポイントは", "さて、", "のではないでしょうか"]
TRANSLATIONESE = [
    "することができ(る|ます|た)", "することが可能(です|だ|になる)", "と言えるだろう", "という点で", "という観点(から|で)", "にとって(重要|不可欠)",
    "を持つ(こと|存在)", "することによって", "であることは間違いない", "に他ならない",
]
#: Words of which every match of those patterns holds one.
TRANSLATIONESE_NEEDS = ["することができ", "することが可能", "と言えるだろう", "という点で", "という観点", "にとって", "を持つ", "することによって", "であることは間違いない", "に他ならない"]
INANIMATE_NEEDS = ["もたらす", "示す", "意味する", "証明する", "生み出す", "反映する"]
ANTITHESIS_NEEDS = ["ではなく", "だけでなく"]
HYPE = ["革命的", "画期的な", "劇的に", "圧倒的な", "究極の", "最強の", "魔法のよう", "爆発的に"]
CLOSERS = ["まとめ", "おわりに", "終わりに", "さいごに", "最後に", "結論", "総括", "conclusion"]
INANIMATE = [
    "(これ|それ|この事実|そのこと)(は|が)[^\\n]{0,40}(もたらす|示す|意味する|証明する|生み出す|反映する)",
    "[^\\n]{0,20}(こと|事実)(は|が)[^\\n]{0,40}(もたらす|示す|意味する|証明する|生み出す|反映する)",
]
INANIMATE_VERBS = ["もたらす", "示す", "意味する", "証明する", "生み出す", "反映する", "示唆する", "物語る", "浮き彫りにする", "後押しする"]
ANTITHESIS = ["ではなく、?[^\\n]{0,30}", "だけでなく[^\\n]{0,10}も"]
CLEFT, BECAUSE = "^(それ|これ|この)は[^\\n]{0,60}(である|だ)$", "^(なぜなら|というのも)"
PHASE = "(フェーズ|ステップ|段階|ステージ)\\s*[0-9０-９]"
ABSTRACT = [
    "側面", "観点", "重要性", "可能性", "あり方", "存在", "意味", "本質", "価値", "意義", "課題", "問題", "要素", "要因", "背景", "傾向", "姿勢", "視点",
    "概念", "特徴", "性質", "状況", "状態", "変化",
]
EXAMPLES = ["たとえば", "例えば", "実際に", "実際には", "具体的には", "具体例として", "一例として", "先日", "昨日", "現に", "実例として"]
QUANTITY = "[0-9０-９]+(年代|年間|世紀|年|月|日|時間|時|分|秒|人|円|%|％|kg|km|cm|mm|g|m|回|件|個|つ|割|倍|台|社|名|冊|本|杯|軒)?"
CONJUNCTIONS = ["しかし", "また", "そして", "そのため", "さらに", "つまり", "一方", "一方で", "このように", "なぜなら", "したがって", "ただし"]
TENTATIVE = [
    "かもしれない", "かもしれません", "かもしれなかった", "に違いない", "に違いありません", "だろう", "でしょう", "ようだ", "ようです", "らしい", "らしいです",
    "と思う", "と思います",
]
ASSERTIVE = ["である", "であった", "だった", "なのだ", "のだ", "というわけだ", "です", "でした", "だ"]
OBLIGATION = ["といけ", "とだめ", "とダメ", "ばならな", "ばなりま", "ばいけな", "てはならな", "てはなりま", "てはいけな", "ざるを得", "ざるをえ"]
NEGATIVES = ["ない", "無い", "ぬ", "ず", "ん"]
TEMPLATE_HEADINGS = [
    "はじめに", "背景", "概要", "本記事について", "この記事について", "まとめと今後", "今後の展望", "今後の課題", "今後について", "まとめ", "おわりに", "終わりに",
    "さいごに", "最後に", "結論", "総括", "conclusion", "introduction", "summary",
]
GLOSS = ["とは", "と呼ぶ", "という", "、つまり"]
CONTENT_POS = ["名詞", "代名詞", "形状詞", "動詞", "形容詞", "副詞"]
PUNCTUATION_POS = ["記号", "補助記号", "空白"]
SMALL_KANA = "ァィゥェォャュョヮ"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B50}\\x{2B55}\\x{2705}\\x{274C}\\x{203C}]"
DOCUMENT_RULES = [
    "antithesis_repetition", "low_burstiness", "high_length_autocorrelation", "low_sentence_variance", "uniform_paragraph_structure", "nominal_ending",
    "low_lexical_diversity_ttr", "low_lexical_diversity_mtld",
]
LEAD_REPEATS = {"essay": 5, "tech": 7, "business": 7, None: 6}
NOMINAL_CHARS = {"essay": 1500, "tech": 3000, "business": 3000, None: 2000}
SENTENCE_MAX = {"essay": 110, None: 90}
BURSTINESS, AUTOCORRELATION, VARIANCE_CV = -0.24, 0.6, 0.25
TTR, MTLD, MTLD_FACTOR, LEXICAL_CHARS, SPECIFICITY = 0.45, 40.0, 0.72, 4000, -0.15
MODE_MORA, MODE_CV, NOMINAL_MORA = 30, 0.15, 25
# End of the fixed values.


@dataclass(frozen=True)
class Rule:
    """A category: its place in the order of findings, lane, severity, and when it is dropped."""

    category: str
    lane: str = "main"
    severity: str = "info"
    experimental: bool = False
    not_business: bool = False


RULES = [
    Rule("high_bold_density", experimental=True, not_business=True),
    Rule("high_bullet_ratio", experimental=True, not_business=True),
    Rule("boilerplate_heading", experimental=True, not_business=True),
    Rule("numbered_phase_structure", experimental=True, not_business=True),
    Rule("high_emoji_symbol_density", experimental=True),
    Rule("predicate_colon_lead"),
    Rule("hype_expression"),
    Rule("bullet_bold_label", not_business=True),
    Rule("bullet_emoji", not_business=True),
    Rule("forbidden_phrase", severity="warn"),
    Rule("translationese"),
    Rule("antithesis_repetition", severity="warn"),
    Rule("english_syntax_inanimate_subject"),
    Rule("english_syntax_cleft_because", severity="warn", experimental=True),
    Rule("translationese_morph"),
    Rule("inanimate_subject_morph"),
    Rule("redundant_light_verb"),
    Rule("repeated_sentence_mode", experimental=True),
    Rule("consecutive_nominal_endings", experimental=True),
    Rule("low_burstiness", severity="warn"),
    Rule("high_length_autocorrelation", experimental=True),
    Rule("repeated_sentence_lead", experimental=True),
    Rule("repeated_syntax_template", experimental=True),
    Rule("low_lexical_diversity_ttr", experimental=True),
    Rule("low_lexical_diversity_mtld", experimental=True),
    Rule("low_specificity"),
    Rule("paragraph_lead_conjunction", experimental=True),
    Rule("uniform_paragraph_structure"),
    Rule("low_sentence_variance", severity="warn"),
    Rule("nominal_ending"),
    Rule("no_comma_sentence", "reading_load"),
    Rule("sentence_too_long", "reading_load"),
    Rule("kanji_run", "reading_load"),
    Rule("buried_list", "reading_load"),
    Rule("double_negative", "reading_load"),
    Rule("no_chain", "reading_load"),
]
BY_NAME = {r.category: r for r in RULES}
ORDER = {r.category: i for i, r in enumerate(RULES)}
SEVERITY_RANK = {"info": 0, "warn": 1, "critical": 2}
