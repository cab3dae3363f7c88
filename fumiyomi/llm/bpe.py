"""BPE encoding and decoding (op 10) by backtracking over longest matches.

An Aho-Corasick automaton over all tokens finds the longest token at each place of a pre-token. The encoder takes
the longest match whose pair with the token before it is compatible, that is, merging the two tokens' texts anew
would give just these two; else it takes the next shorter prefix token, and where none is left it steps back one
token and marks the place as a dead end. Each place is marked once, so the work is linear in the text.
The result is exactly that of applying the merges by rank. Decoding gathers token bytes through an offset table.

Null texts are empty texts: no tokens, an empty decoded text. The strings of special tokens inside a text become
their ids, as the tokenizers library does by default; pre-tokens are those of the byte-level pattern.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.common import Memo, cached, documents, map_texts, starts
from fumiyomi.llm.pieces import Pieces


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for s, i in vocab.items():
            self.bytes_of[i] = raw(s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        # ranks: single bytes first, then the merges in their order
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.id_of_rank = [i for s, i in sorted(vocab.items(), key=lambda x: x[1]) if len(s) == 1]
        rank = {i: r for r, i in enumerate(self.id_of_rank)}
        self.left, self.right, self.joined = list(range(len(rank))), list(range(len(rank))), {}
        for a, b in merges:
            i = vocab[a + b]
            if i in rank:
                continue
            x, y = rank[vocab[a]], rank[vocab[b]]
            rank[i] = r = len(self.id_of_rank)
            self.id_of_rank.append(i)
            self.left.append(x)
            self.right.append(y)
            self.joined[x, y] = r
        texts = [self.bytes_of[i].decode("latin-1") for i in self.id_of_rank]
        self.length = list(map(len, texts))
        self.rank_of_byte = {t: r for r, t in enumerate(texts) if len(t) == 1}
        by_text = {t: r for r, t in enumerate(texts)}
        self.automaton = ahocorasick.Automaton()
        for t, r in by_text.items():
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(texts)  # the longest proper prefix that is a token
        for t, r in by_text.items():
            for n in range(len(t) - 1, 0, -1):
                if (p := by_text.get(t[:n])) is not None:
                    self.shorter[r] = p
                    break
        self.fits: dict[tuple[int, int], bool] = Memo(1_000_000)
        self.words: dict[str, list[int]] = Memo(300_000)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.data, self.offset = data, starts(np.array(list(map(len, self.bytes_of)), np.int64))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the texts of ranks a and b, one after the other, stay these two tokens when merged from bytes."""
        known = self.fits.get((a, b))
        if known is None:
            self.fits.room(1)
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _spine(self, r: int, inner: list[int]) -> list[tuple[int, int]]:
        """Tokens that stand at one edge of rank r while it is merged, from its single byte on: each with the rank of the merge
        that ends it. inner gives the part at that edge."""
        out, end = [], len(self.id_of_rank)
        while True:
            out.append((r, end))
            if inner[r] == r:
                return out[::-1]
            r, end = inner[r], r

    def _compatible(self, a: int, b: int) -> bool:
        """By definition: merges are taken by rank, so the two texts are merged apart as long as no merge across their border comes
        before the next one at the border. The tokens at the border are those of two spines; a pair of them stands there from the
        rank of the later one's making until the first of them is merged further. Equal ranks go left to right: a merge across the
        border comes before one of the same rank that lies right of it."""
        left, right = self._spine(a, self.right), self._spine(b, self.left)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = self.joined.get((x, y))
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if x_ends <= y_ends:  # of equal ranks the left one comes first
                i += 1
            else:
                j += 1


    def word(self, text: bytes) -> list[int]:
        """Ranks of one pre-token."""
        chars = text.decode("latin-1")
        n = len(chars)
        longest = [-1] * n
        length, shorter, compatible = self.length, self.shorter, self.compatible
        for end, r in self.automaton.iter(chars):
            start = end + 1 - length[r]
            if longest[start] < 0 or length[longest[start]] < length[r]:
                longest[start] = r
        if length[longest[0]] == n:
            return [longest[0]]
        open_at = [True] * (n + 1)
        out: list[int] = []
        at, r = 0, longest[0]
        while at < n:
            end = at + length[r]
            if open_at[end] and (not out or compatible(out[-1], r)):
                out.append(r)
                at = end
                r = longest[at] if at < n else -1
            elif shorter[r] >= 0:
                r = shorter[r]
            else:
                open_at[at] = False
                r = out.pop()
                at -= length[r]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        ids, words = self.id_of_rank, self.words
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for m in self.pattern.findall(part):
                    if (known := words.get(m)) is None:
                        known = [ids[r] for r in self.word(m.encode())]
                        if len(m) <= 32:
                            words.room(1)
                            words[m] = known
                    out += known
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, gathered at once."""
        begin = self.offset[ids]
        size = self.offset[ids + 1] - begin
        place = starts(size)
        index = np.ones(int(place[-1]), np.int64)
        if not len(index):
            return b""
        full = size > 0
        begin, at, size = begin[full], place[:-1][full], size[full]
        index[at[0]] = begin[0]
        index[at[1:]] = begin[1:] - (begin[:-1] + size[:-1] - 1)
        return self.data[np.cumsum(index)].tobytes()


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    model = bpe(path)
    return Pieces(lambda new: [np.array(model.encode(p), "<u4").tobytes() for p in new], most=650_000)


cached("bpe", lambda: (_pieces.cache_clear(), bpe.cache_clear()) and None)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) for each row of docs (doc_id, text)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in _pieces(path)(frame["text"].tolist())]
        return pd.DataFrame({"doc_id": frame["doc_id"], "ids": pd.Series(ids, index=frame.index, dtype=object)})

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>", owner="bpe")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for each row of encoded (doc_id, ids); bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = bpe(path)
        return pd.Series([model.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") if x is not None else "" for x in ids])

    return encoded.select("doc_id", text("ids").alias("text"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        model, rows = bpe(path), []
        for parts in _pieces(path)(frame["text"].tolist()):
            raw = b"".join(parts)
            text = model.decode(np.frombuffer(raw, "<u4").astype(np.int64)).decode("utf-8", "replace")
            rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return pd.DataFrame({"doc_id": frame["doc_id"], **{k: pd.Series([r[i] for r in rows], index=frame.index) for i, k in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}})

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", 2_000_000, "bpe")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
