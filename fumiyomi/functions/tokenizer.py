"""A lattice tokenizer over a small lexicon, run in Arrow batches.

Words of the lexicon and, by class of characters, unknown words make a lattice over a sentence; the path of least cost
wins, costs being a word's own and that of meeting the part of speech before. Inflected forms come from a rule for each
kind of word. The lexicon is data (a CSV with surface, three levels of part of speech, lemma, reading, kind of inflection)
and can be another one; whatever it lacks is a noun, by its script. With a larger dictionary the rules don't change.
"""

from __future__ import annotations

import bisect
import csv
import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = "struct<surface:string,byte_start:int,byte_end:int,pos1:string,pos2:string,pos3:string,lemma:string,norm:string,reading:string>"
#: Bytes of a text that is tokenized at once; all_tokens cuts longer ones.
MOST_BYTES = 49149
DEFAULT = Path(__file__).with_name("lexicon.csv")
#: Words and stretches of Japanese that a worker remembers at most; results don't depend on them.
WORDS, STRETCHES = 500_000, 50_000


class Word(NamedTuple):
    surface: str
    pos: tuple[str, str, str]
    lemma: str
    reading: str
    cost: int


_ROWS = {"う": "わいうえおっ", "く": "かきくけこい", "す": "さしすせそし", "つ": "たちつてとっ", "ぬ": "なにぬねのん", "む": "まみむめもん", "る": "らりるれろっ", "ぐ": "がぎぐげごい", "ぶ": "ばびぶべぼん"}


def inflected(surface: str, reading: str, kind: str) -> list[tuple[str, str]]:
    """Forms of a word with their readings."""
    stem, sound = surface[:-1], reading[:-1]
    if kind == "ichidan":
        endings = ["る", "", "れ", "ろ", "よう"]
    elif kind == "godan":
        endings = list(_ROWS[surface[-1]])
        if surface[-2:] == "行く":
            endings[-1] = "っ"
    elif kind == "adjective":
        endings = ["い", "く", "かっ", "けれ", "さ"]
    else:
        return [(surface, reading)]
    return [(stem + e, sound + katakana(e)) for e in dict.fromkeys(endings) if stem + e]


def katakana(s: str) -> str:
    return "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in s)


def char_class(c: str) -> str:
    if c.isspace():
        return "space"
    if "ァ" <= c <= "ヺ" or c in "ー・":
        return "katakana"
    if "ぁ" <= c <= "ゟ":
        return "hiragana"
    if "一" <= c <= "龿" or c in "々〆" or "㐀" <= c <= "䶿":
        return "kanji"
    if c.isdigit():
        return "digit"
    if c.isascii() and c.isalpha():
        return "latin"
    return "letter" if c.isalpha() else "symbol"


def normalized(surface: str) -> str:
    """One spelling: compatibility forms, lower case, and no final long mark after three katakana or more."""
    s = unicodedata.normalize("NFKC", surface).lower()
    return s[:-1] if len(s) > 3 and s.endswith("ー") and char_class(s[0]) == "katakana" else s


_JAPANESE = re.compile("[々〆ぁ-ゟ㐀-䶿一-龿]")
#: Runs of one class in texts that have no other characters than these: ASCII, Latin letters, and marks that stand alone.
_PLAIN = re.compile("[\\x00-\\x7FÀ-ÖØ-öø-ɏ\u2010-\u2027]*")
_RUNS = re.compile(r"[A-Za-z]+|[0-9]+|[À-ÖØ-öø-ɏ]+|[\s\S]")


def runs(text: str) -> list[str]:
    """Runs of characters of one class; symbols and blanks one by one."""
    if text.isascii() or _PLAIN.fullmatch(text):
        return _RUNS.findall(text)
    out = []
    for kind, run in itertools.groupby(text, char_class):
        out += run if kind in ("symbol", "space") else ["".join(run)]
    return out


class Lexicon:
    #: Cost of a part of speech after another; 0 where nothing is said.
    MEETS = {
        ("助詞", "助詞"): 300, ("名詞", "名詞"): 250, ("名詞", "助動詞"): 50, ("動詞", "助動詞"): -300, ("動詞", "助詞"): 0, ("形容詞", "助動詞"): -50,
        ("名詞", "助詞"): -300, ("代名詞", "助詞"): -300, ("助動詞", "助動詞"): -100, ("BOS", "助詞"): 600, ("BOS", "助動詞"): 800, ("助詞", "助動詞"): 400,
        ("名詞", "動詞"): 150, ("助詞", "動詞"): -100, ("助詞", "名詞"): -100, ("助詞", "形容詞"): -100, ("補助記号", "助動詞"): 600, ("補助記号", "助詞"): 300,
    }

    def __init__(self, path: Path | str = DEFAULT):
        self.words: dict[str, list[Word]] = {}
        with open(path, encoding="utf-8", newline="") as f:
            for r in csv.DictReader(f):
                pos = (r["pos1"], r["pos2"], r["pos3"])
                for surface, reading in inflected(r["surface"], r["reading"], r["kind"]):
                    self.words.setdefault(surface, []).append(Word(surface, pos, r["lemma"], reading, 500 - 60 * len(surface)))
        self.longest = max(map(len, self.words), default=1)
        self.japanese = all(_JAPANESE.search(w) for w in self.words)
        signs = sorted(set("".join(self.words)))
        #: Whether words of the lexicon and runs outside of Japanese never share characters of one run.
        self.parted = not any(char_class(c) in ("digit", "latin", "letter") for c in signs)
        self.stretches = re.compile("([々〆ぁ-ゟ㐀-䶿一-龿ァ-ヺー・" + "".join(re.escape(c) for c in signs if char_class(c) in ("symbol", "space")) + "]+)")
        self.ascii_only = not any(c.isascii() for c in signs)
        self.forget()

    def forget(self) -> None:
        """Empties what is remembered: words with their numbers, and paths through stretches."""
        self.numbers: dict[Word, int] = {}
        self.rows: list[tuple] = []
        self.known = _Runs(self)
        self.paths: dict[tuple[str, str, str | None], list[int]] = {}
        self.columns: list[pa.Array] = []

    def number(self, w: Word) -> int:
        k = self.numbers.get(w)
        if k is None:
            k = self.numbers[w] = len(self.rows)
            self.rows.append((w.surface, len(w.surface.encode()), *w.pos, w.lemma, normalized(w.lemma), w.reading))
        return k

    def fields(self) -> list[pa.Array]:
        """The fields of the words by their numbers: surface, its bytes, parts of speech, lemma, norm, reading."""
        have = len(self.columns[0]) if self.columns else 0
        if have < len(self.rows):
            new = [pa.array(c, pa.int32() if k == 1 else pa.string()) for k, c in enumerate(zip(*self.rows[have:], strict=True))]
            self.columns = [pa.concat_arrays(x) for x in zip(self.columns, new, strict=True)] if have else new
        return self.columns

    def unknown(self, text: str, at: int) -> list[Word]:
        """Words that the script makes at a place: a run, and for kanji its beginnings, too."""
        kind = char_class(text[at])
        end = at + 1
        while end < len(text) and char_class(text[end]) == kind and kind not in ("symbol", "space"):
            end += 1
        run = text[at:end]
        noun = lambda s, cost, p2="普通名詞", p3="一般": Word(s, ("名詞", p2, p3), s, s, cost)
        if kind == "symbol":
            return [Word(run, ("補助記号", "一般", "*"), run, run, 300)]
        if kind == "space":
            return [Word(run, ("空白", "*", "*"), run, run, 100)]
        if kind == "digit":
            return [noun(run, 300, "数詞", "*")]
        if kind in ("katakana", "latin", "letter"):
            return [noun(run, 500, "固有名詞" if kind == "latin" and run[:1].isupper() and len(run) > 1 else "普通名詞")]
        if kind == "kanji":
            return [noun(run[:n], 650 + 260 * abs(n - 2)) for n in range(1, len(run) + 1)]
        return [noun(run[:n], 1500 + 300 * n) for n in range(1, min(len(run), 6) + 1)]

    def tokenize(self, text: str) -> list[tuple[int, Word]]:
        """First character and word of each token on the path of least cost; of equal ones that found first."""
        n = len(text)
        if self.japanese and not _JAPANESE.search(text):  # no word of the lexicon, one run at each place: one path
            out, at = [], 0
            while at < n:
                out.append((at, self.unknown(text, at)[0]))
                at += len(out[-1][1].surface)
            return out
        return self.path(text)

    def path(self, text: str, before: str = "BOS", after: str | None = None) -> list[tuple[int, Word]]:
        """The path of least cost between words of these parts of speech (after None: the end)."""
        n = len(text)
        best: list[dict[str, tuple[int, int, str, Word | None]]] = [{} for _ in range(n + 1)]  # by part of speech of the last word
        best[0][before] = (0, -1, "", None)
        for at in range(n):
            if not best[at]:
                continue
            found = [w for k in range(1, min(self.longest, n - at) + 1) for w in self.words.get(text[at : at + k], ())]
            for w in found + self.unknown(text, at):
                cost, last = min(((c[0] + self.MEETS.get((p, w.pos[0]), 0), p) for p, c in best[at].items()), key=lambda x: x[0])
                cost += w.cost
                there = best[at + len(w.surface)]
                if w.pos[0] not in there or cost < there[w.pos[0]][0]:
                    there[w.pos[0]] = (cost, at, last, w)
        out = []
        at, p = n, min(best[n], key=lambda k: best[n][k][0] + self.MEETS.get((k, after), 0)) if best[n] else ""
        while at > 0:
            _, start, last, w = best[at][p]
            out.append((start, w))
            at, p = start, last
        return out[::-1]

    def numbered(self, text: str) -> list[int]:
        """The numbers of the words that tokenize finds. Outside of Japanese one path alone leads on, and what is behind a word of it
        doesn't matter before it; so each stretch of Japanese is a lattice of its own, between the words beside it."""
        if not self.parted:
            return [self.number(w) for _, w in self.tokenize(text)]
        if text.isascii() and self.ascii_only:
            return list(map(self.known.__getitem__, _RUNS.findall(text)))
        out: list[int] = []
        parts = self.stretches.split(text)
        plain = [list(map(self.known.__getitem__, runs(x))) for x in parts[::2]]
        for k, own in enumerate(plain):
            out += own
            if 2 * k + 1 < len(parts):
                key = (self.rows[out[-1]][2] if out else "BOS", parts[2 * k + 1], self.rows[plain[k + 1][0]][2] if plain[k + 1] else None)
                found = self.paths.get(key)
                if found is None:
                    if len(self.paths) >= STRETCHES:
                        self.paths.clear()
                    found = self.paths[key] = [self.number(w) for _, w in self.path(key[1], key[0], key[2])]
                out += found
        return out


class _Runs(dict):
    """The numbers of words that are no lexicon's, by their run."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, run: str) -> int:
        k = self[run] = self.lexicon.number(self.lexicon.unknown(run, 0)[0])
        return k


@lru_cache(maxsize=4)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def _places(text: str) -> list[int]:
    """The byte at which each character begins, and the end."""
    return [0, *itertools.accumulate(len(c.encode()) for c in text)]


def cut(text: str) -> Iterator[str]:
    """A text of more than MOST_BYTES in pieces: before a blank or after a comma where there is one."""
    byte, at = _places(text), 0
    while at < len(text):
        end = bisect.bisect_right(byte, byte[at] + MOST_BYTES) - 1
        if end < len(text):
            mark = max(text.rfind(" ", at + 1, end), *(text.rfind(c, at, end - 1) + 1 for c in "、，,"))
            end = mark if mark > at else end
        yield text[at:end]
        at = end


def numbers(text: str | None, lex: Lexicon) -> list[int]:
    """The words of a text of any length."""
    if not text:
        return []
    if len(text) * 4 <= MOST_BYTES or len(text.encode()) <= MOST_BYTES:
        return lex.numbered(text)
    return [k for piece in cut(text) for k in lex.numbered(piece)]


def token_lists(texts: pa.Array, path: str) -> pa.Array:
    """The tokens of each text of a batch, put together from the columns of all words' fields."""
    lex = lexicon(path)
    if len(lex.rows) > WORDS:
        lex.forget()
    own = [numbers(t, lex) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, own)])
    at = np.fromiter(itertools.chain.from_iterable(own), np.int32, int(ends[-1]))
    if not len(at):
        lex.number(Word("", ("", "", ""), "", "", 0))
    fields = lex.fields()
    byte_end = np.cumsum(fields[1].to_numpy()[at], dtype=np.int64)
    total = np.concatenate([[0], byte_end])
    byte_end -= np.repeat(total[ends[:-1]], np.diff(ends))
    taken = [f.take(pa.array(at)) for f in fields]
    places = [pa.array((byte_end - taken[1].to_numpy()).astype(np.int32)), pa.array(byte_end.astype(np.int32))]
    tokens = pa.StructArray.from_arrays([taken[0], *places, *taken[2:]], names=["surface", "byte_start", "byte_end", "pos1", "pos2", "pos3", "lemma", "norm", "reading"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens)


def tokens_of(text: str | None, path: str = str(DEFAULT)) -> list[dict]:
    if not text or len(text.encode()) > MOST_BYTES:
        return []
    return token_lists(pa.array([text]), path).to_pylist()[0]


def all_tokens(text: str | None, path: str) -> list[dict]:
    """Tokens of a text of any length: one over MOST_BYTES is cut."""
    return token_lists(pa.array([text], pa.string()), path).to_pylist()[0]


def tokenize(path: str = str(DEFAULT)):
    """A column function: text to an array of tokens, with a lexicon that every worker can read at this path."""

    @F.arrow_udf(f"array<{TOKEN}>")
    def run(text: pa.Array) -> pa.Array:
        return token_lists(text, path)

    return run


def token_frame(sentences: DataFrame, path: str = str(DEFAULT)) -> DataFrame:
    """A row for each token of each sentence (doc_id, sent_idx, line, sentence)."""
    rows = sentences.select("doc_id", "sent_idx", "line", F.posexplode(tokenize(path)("sentence")).alias("tok_idx", "t"))
    return rows.select("doc_id", "sent_idx", "line", "tok_idx", "t.*")


def oversize(sentences: DataFrame) -> DataFrame:
    """Sentences too long to tokenize at once: they are cut."""
    return sentences.filter(F.octet_length("sentence") > MOST_BYTES).select("doc_id", "line", F.octet_length("sentence").alias("bytes"))
