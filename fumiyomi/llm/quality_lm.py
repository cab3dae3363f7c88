"""Quality classifier (op 8): an interpolated modified Kneser-Ney model of the words of trusted text gives each document's perplexity.

Tokens are words (runs of letters and digits), single marks, and single characters of scripts that write no spaces. Their
pairs are counted over all trusted documents, whole, keyed by hash and summed by groups of documents before they are
shuffled; shards merge them, and from the merged pairs come, by word, the followers, their total and the continuation
count. Each run of a group's documents then asks the shards for its distinct pairs and words, packed, and the answers meet
the run's text. So what is gathered grows with the input, and none of it comes to the driver.

A word is spelled, where the words don't tell, by four-grams of 64 classes of characters: the base distribution, of bounded
size (64^4 entries of two bytes), is broadcast. Within a class, ASCII characters share all but 1/64 evenly.

Trusted documents are scored without their own counts (leave one out), or they would look better than others do.

A document's rate is its code length with SHRINK characters at its language's median rate added, over its characters and
SHRINK, which keeps short texts from being judged on a few characters; its perplexity is 2 to that rate. Characters are those
of tokens, and one more for each. It is rejected above the language's threshold: the quantile HIGH of trusted documents'
rates. Languages with fewer than OWN trusted documents, and null ones, share the quantile of all.

Null and empty texts have the median rate: nothing speaks against them. Without trusted text everything is kept, at
perplexity null. Repeated rows are judged each. A document is trusted if any of its labels has quality 1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.chunks import chunks, group_bits, opened, packed, runs_of, steps, unpacked, unstepped
from fumiyomi.llm.common import begin, documents, dropped, free, placed, trim, written
from fumiyomi.llm.fingerprints import mix

BITS, ORDER = 6, 4
CLASSES = 1 << BITS
#: Characters at the median rate that each text gets besides its own.
SHRINK = 60
HIGH, OWN = 0.999, 50
#: Steps of the histogram of rates, to a bit.
STEPS = 1000
#: A code length's unit: 1/1024 bit, in 16 bits.
UNIT = 1024
START = 0
#: The column of row numbers, where docs has it already.
ROW = "_lm_row"
#: Words; other characters alone, as are those of scripts without spaces.
_LETTERS = r"[^\W_\u0e00-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]+"
TOKEN = re.compile(_LETTERS + r"|\S")
#: Bits of the hashes of words and of pairs.
WORD_BITS, PAIR_BITS = 40, 48
#: Bytes of text for each shard of pairs and words, and of a run of documents that asks at once; characters of a slice.
SHARD_BYTES, ASKED, SLICE = 24_000_000, 32_000_000, 500_000
#: Pairs, or tokens, that are weighed at once.
PART = 100_000
#: Words that are spelled at once.
WORDS = 20_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point of the basic plane; other planes have the last class."""
    marks = " \n\t.,;:!?'\"-()/"  # 1 to 15; 0 is the start of a text
    out = np.empty(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        kind = unicodedata.category(ch)
        base = unicodedata.normalize("NFD", ch)[0] if kind[0] == "L" else ch
        if ch in marks:
            k = 1 + marks.index(ch)
        elif kind == "Lu":
            k = 16
        elif kind[0] == "N":
            k = 17
        elif ch in "#$%&*<>|@^~`+=_\\[]{}":
            k = 18
        elif "a" <= ch <= "z":
            k = 19 + ord(ch) - 97
        elif kind[0] == "L" and "a" <= base.lower() <= "z":
            k = 45 + (ord(base.lower()) - 97) % 6
        elif kind[0] == "L":
            k = 51 + (c >> 7) % 8
        elif kind[0] == "Z":
            k = 1
        else:
            k = 59 + (kind[0] == "P") + 2 * (kind[0] == "S")
        out[c] = k
    return out


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Four-gram codes of all characters of all texts, and each text's number of characters; contexts begin with START."""
    pad = "\0" * (ORDER - 1)
    joined = pad.join(["", *[(t or "").replace("\0", " ") for t in texts]])
    point = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    kind = np.where(point < 1 << 16, classes()[np.minimum(point, 0xFFFF)], CLASSES - 1).astype(np.int32)
    kind[point == 0] = START
    if len(kind) < ORDER:
        return np.zeros(0, np.int32), np.array([len(t or "") for t in texts], np.int64)
    code = kind[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        code += kind[ORDER - 1 - k : len(kind) - k] << (BITS * k)
    return code[kind[ORDER - 1 :] != START], np.array([len(t or "") for t in texts], np.int64)


def four_grams(texts: list[str | bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different four-gram codes of the texts, ascending, and their counts."""
    parts, held, size = [], [], 0

    def add(code: np.ndarray) -> None:
        code, n = np.unique(code, return_counts=True)
        parts.append((code.astype(np.uint64), [n]))

    for text in map(decoded, texts):
        for at in range(0, len(text), SLICE):  # a later slice of a long text begins with what its first context needs
            if at:
                add(codes([text[at - ORDER + 1 : at + SLICE]])[0][ORDER - 1 :])
            else:
                held.append(text[:SLICE])
                size += len(held[-1])
        if size > SLICE:
            add(codes(held)[0])
            held, size = [], 0
    add(codes(held)[0])
    code, (n,) = summed(parts, 1)
    return code, n


def kneser_ney(four: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: rows (code, p: discounted share in its context) and (ctx, back: weight of the shorter context)."""
    tables = {ORDER: four}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: different symbols before
        tables[k] = tables[k + 1].groupBy(F.col("code").bitwiseAND((1 << (BITS * k)) - 1).cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    out = []
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("ctx", F.shiftright("code", BITS))
        of = {int(r["n"]): r["k"] for r in t.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        less = [min(max(d, 0.05), i + 0.9) for i, d in enumerate((1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.7, 3 - 4 * y * n4 / n3 if n3 else 0.9))]
        off = F.when(F.col("n") == 1, less[0]).when(F.col("n") == 2, less[1]).otherwise(less[2])
        context = t.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(off).alias("off"))
        rows = t.join(context.select("ctx", "total"), "ctx").select("code", ((F.col("n") - off) / F.col("total")).alias("p"))
        out.append((rows, context.select("ctx", (F.col("off") / F.col("total")).alias("back"))))
    return out


def spelling(four: DataFrame) -> np.ndarray | None:
    """Code lengths of all four-grams in units (uint16), from their counts (code, n); None without any. Its size doesn't
    depend on the corpus."""
    if not four.head(1):
        return None
    shorter = np.full((1, CLASSES), 1 / CLASSES, np.float32)
    for k, (rows, back) in enumerate(kneser_ney(four), 1):
        found, weight = rows.toPandas(), back.toPandas()  # at most 64^k rows
        order = np.argsort(found["code"].to_numpy())
        code, own = found["code"].to_numpy()[order], found["p"].to_numpy(np.float32)[order]
        away = np.ones(CLASSES ** (k - 1), np.float32)
        away[weight["ctx"].to_numpy()] = weight["back"].to_numpy()
        del found, weight
        size = len(shorter)  # contexts of the order below; blocks share a first symbol
        dense = np.empty(CLASSES**k, np.uint16 if k == ORDER else np.float32)
        for lo in range(0, len(away), size):
            # p(w | ctx) = own share + weight of the context times p(w | shorter context)
            block = (away[lo : lo + size, None] * shorter).ravel()
            i, j = np.searchsorted(code, [lo * CLASSES, (lo + size) * CLASSES])
            block[code[i:j] - lo * CLASSES] += own[i:j]
            if k == ORDER:
                block = np.minimum(-np.log2(np.maximum(block, 1e-18)) * UNIT, 65535)
            dense[lo * CLASSES : (lo + size) * CLASSES] = block
        shorter = dense.reshape(-1, CLASSES)
    return dense


def code_lengths(texts: list[str | None], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters and bits of each text."""
    code, size = codes(texts)
    bits = np.zeros(len(size))
    full = np.flatnonzero(size)
    if len(full):
        bits[full] = np.add.reduceat(lengths[code], (np.cumsum(size) - size)[full], dtype=np.int64) / UNIT
    return size, bits


@lru_cache(maxsize=1)
def _within() -> np.ndarray:
    """Bits that tell a character of the basic plane from others of its class; others take 20."""
    kind, plain = classes(), np.arange(1 << 16) < 128
    own, rest = np.bincount(kind[plain], minlength=CLASSES)[kind], np.bincount(kind[~plain], minlength=CLASSES)[kind]
    share = np.where(plain, np.where(rest > 0, 63 / 64, 1) / np.maximum(own, 1), np.where(own > 0, 1 / 64, 1) / np.maximum(rest, 1))
    return -np.log2(share)


def spelled(words: list[str], lengths: np.ndarray) -> np.ndarray:
    """Bits of each word by its characters, with the space that ends it; in parts, for the memory."""
    return np.concatenate([np.zeros(0), *(_spelled(words[at : at + WORDS], lengths) for at in range(0, len(words), WORDS))])


def _spelled(words: list[str], lengths: np.ndarray) -> np.ndarray:
    size, bits = code_lengths([w + " " for w in words], lengths)
    point = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    inner = np.where(point < 1 << 16, _within()[np.minimum(point, 0xFFFF)], 20)
    return bits + np.bincount(np.repeat(np.arange(len(words)), size - 1), inner, len(words))


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point 0 (white space), 1 (letter of a word) or 2 (a token alone), and a hash; by TOKEN's own classes."""
    kind = np.full(0x110000, 2, np.uint8)
    for base in range(0, 0x110000, 0x8000):
        every = "".join(map(chr, range(base, base + 0x8000)))
        for pattern, k in ((r"\s+", 0), (_LETTERS, 1)):
            for m in re.finditer(pattern, every):
                kind[base + m.start() : base + m.end()] = k
    return kind, mix(np.arange(1, 0x110001, dtype=np.uint64))


def decoded(text: str | bytes | None) -> str:
    """A text that may be bytes yet: as bytes it takes the least memory, so it stays so until it is read."""
    return "" if text is None else text if isinstance(text, str) else bytes(text).decode("utf-8", "replace")


def slices(texts: list[str | bytes | None]) -> Iterator[list[tuple[int, str]]]:
    """Parts of about SLICE characters: numbers of texts and their text; longer texts are cut before white space only."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, raw in enumerate(texts):
        at, text = 0, decoded(raw)
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                cut = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE))
                end = cut if cut > at else end
            held.append((i, text[at:end] if at or end < len(text) else text))
            size += end - at
            at = end
            if size > SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


class Pairs:
    """Tokens of some texts, each with the one before it; the distinct words and pairs in the order of their hashes."""

    def __init__(self, texts: list[str | bytes | None]):
        table, hashes = _kinds()
        keys, docs = [], []
        spelling: dict[int, str] = {}
        for part in slices(texts):
            joined = " ".join(x for _, x in part)
            point = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
            kind = table[point]
            letter, alone = kind == 1, kind == 2
            head, tail = letter.copy(), letter.copy()
            head[1:] &= ~letter[:-1]
            tail[:-1] &= ~letter[1:]
            lo, hi = np.flatnonzero(head | alone), np.flatnonzero(tail | alone) + 1
            if not len(lo):
                continue
            inside = np.arange(len(point), dtype=np.int32)
            begins = np.zeros(len(point), np.int32)
            begins[lo] = lo
            inside -= np.maximum.accumulate(begins)
            inside[kind == 0] = 0
            power = np.cumprod(np.full(int((hi - lo).max()), 0x9E3779B97F4A7C15, np.uint64))
            term = hashes[point] * power[np.minimum(inside, len(power) - 1)]
            term[kind == 0] = 0
            h = mix(np.add.reduceat(term, lo) + (hi - lo).astype(np.uint64)) >> np.uint64(64 - WORD_BITS)
            ends = np.cumsum([len(x) + 1 for _, x in part])
            docs.append(np.array([i for i, _ in part], np.int32)[np.searchsorted(ends, lo, "right")])
            place, known = pd.factorize(np.maximum(h, 1))  # 0 is the empty word's
            first = np.zeros(len(known), np.int64)
            first[place[::-1]] = np.arange(len(h) - 1, -1, -1)
            keys.append((known, place.astype(np.int32)))
            for k, u, v in zip(known.tolist(), lo[first].tolist(), hi[first].tolist(), strict=True):
                if k not in spelling:  # so no part's text has to be kept
                    spelling[k] = joined[u:v]
        # the empty word begins each text
        every = np.concatenate([np.zeros(1, np.uint64), *(k for k, _ in keys)])
        self.word_keys, back = np.unique(every, return_inverse=True)
        self.words = [""] + [spelling[k] for k in self.word_keys[1:].tolist()]
        del spelling, every
        edge = np.cumsum([1, *(len(k) for k, _ in keys)])
        back = back.astype(np.int32)
        word = np.concatenate([np.zeros(0, np.int32), *(back[edge[i] : edge[i + 1]][place] for i, (_, place) in enumerate(keys))])
        del keys, back
        self.doc = np.concatenate([np.zeros(0, np.int32), *docs])
        del docs
        code = np.zeros(len(word), np.int64)
        code[1:] = np.where(self.doc[1:] == self.doc[:-1], word[:-1], 0)
        code *= len(self.words)
        code += word
        del word
        by = np.argsort(code)  # takes less memory than a hash table
        code = code[by]
        edge = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        pair = code[edge]
        del code
        n = np.diff(np.append(edge, len(by))).astype(np.int32)
        del edge
        inverse = np.empty(len(by), np.int32)
        inverse[by] = np.repeat(np.arange(len(pair), dtype=np.int32), n)
        del by
        a, b = (pair // len(self.words)).astype(np.int32), (pair % len(self.words)).astype(np.int32)
        del pair
        second, hashed = mix(self.word_keys), np.empty(len(a), np.uint64)
        for at in range(0, len(a), PART):
            x = slice(at, at + PART)
            hashed[x] = mix(self.word_keys[a[x]] * np.uint64(0x9E3779B97F4A7C15) + second[b[x]]) >> np.uint64(64 - PAIR_BITS)
        order = np.argsort(hashed, kind="stable")
        self.keys = hashed[order]
        del hashed
        self.before, self.last, self.n = a[order], b[order], n[order]
        del a, b, n
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.pair = back[inverse]
        del back, inverse, order
        size = np.array([len(w) + 1 for w in self.words])[self.last]
        self.chars = np.zeros(len(texts), np.int64)
        for at in range(0, len(self.pair), PART):
            self.chars += np.bincount(self.doc[at : at + PART], size[self.pair[at : at + PART]], len(texts)).astype(np.int64)


def cuts(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where sorted keys pass from one shard to the next."""
    return np.searchsorted(keys, np.array([-(-(s << bits) // shards) for s in range(shards)] + [1 << bits], np.uint64))


def summed(parts: list[tuple[np.ndarray, list[np.ndarray]]], columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys of all parts, and the sums of their columns."""
    if not parts:
        return np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * columns
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, [np.bincount(place, np.concatenate([c[i] for _, c in parts]).astype(np.float64), len(keys)).astype(np.int64) for i in range(columns)]


def _texts(frame: pd.DataFrame | pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Rows and texts (bytes) of a group's chunks, by row."""
    rows, texts = [np.zeros(0, np.int64)], []
    for blob in frame["blob"]:
        own, _, size, raw = opened(blob.as_py() if isinstance(blob, pa.Scalar) else bytes(blob))
        text, first = raw.tobytes(), np.cumsum(size) - size
        rows.append(own)
        texts += [text[f : f + n] for f, n in zip(first.tolist(), size.tolist(), strict=True)]
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], [texts[i] for i in order.tolist()]


def _chosen(frame: pd.DataFrame | dict[str, list]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.asarray(r, np.int64) for r in frame["rows"])])


_TABLE = "kind int, shard int, keys binary, a binary, b binary, c binary, d binary, e binary, n1 long, n2 long, n3 long, n4 long, kinds long, total long"
_NAMES = [c.split()[0] for c in _TABLE.split(", ")]
_REPLY = "group long, lo long, hi long, kind int, shard int, a binary, b binary, c binary, d binary, e binary"


def _of(n: np.ndarray) -> list[int]:
    return [*np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist(), int(np.count_nonzero(n)), int(n.sum())]


@dataclass
class Learned:
    """docs with their rows; bits of a group; how many shards; trusted rows by group; shards of pairs, words and four-grams."""

    keyed: DataFrame
    bits: int
    shards: int
    chosen: DataFrame
    pairs: DataFrame
    words: DataFrame
    four: DataFrame

    def base(self) -> DataFrame:
        return self.keyed.select("row", F.lit(0).cast("long").alias("id"), F.col("text").cast("binary").alias("text"))

    def grouped(self):
        return chunks(self.base(), self.bits).groupBy("group")


def learn(docs: DataFrame, good: DataFrame) -> Learned:
    """Counts of the texts of docs (doc_id, text, lang) whose doc_id is in good, as written tables."""
    keyed = (docs if ROW in docs.columns else placed(docs, ROW)).select(F.col(ROW).alias("row"), "doc_id", F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"), "text")
    bits, size = group_bits(keyed)
    shards = max(1, -(-size // SHARD_BYTES))
    rows = keyed.select("row", F.col("doc_id").cast("long").alias("id")).join(good.select(F.col("doc_id").cast("long").alias("id")).hint("merge"), "id", "left_semi")
    chosen = written(rows.groupBy(F.shiftright("row", bits).alias("group")).agg(F.collect_list("row").alias("rows")), "trusted")
    learned = Learned(keyed, bits, shards, chosen, chosen, chosen, chosen)

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        begin("quality_lm")
        out = []
        if len(left) and len(right):
            rows, texts = _texts(left)
            texts = [t for t, m in zip(texts, np.isin(rows, _chosen(right)).tolist(), strict=True) if m]
            p = Pairs(texts)
            edge = cuts(p.keys, PAIR_BITS, shards)
            for s in range(shards):
                at = slice(edge[s], edge[s + 1])
                if edge[s] < edge[s + 1]:  # the order by the first word leaves less to write
                    order = np.argsort(p.before[at], kind="stable")
                    first = p.word_keys[p.before[at][order]]
                    out.append((0, s, steps(first), packed(p.word_keys[p.last[at][order]]), packed(p.n[at][order])))
            code, n = four_grams(texts)
            edge = cuts(code, BITS * ORDER, min(shards, 64))
            out += [(2, s, steps(code[u:v]), None, packed(n[u:v])) for s, (u, v) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if u < v]
            del p, texts
            trim()
        return pd.DataFrame(out, columns=["kind", "shard", "a", "b", "n"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        kind, shard = int(frame["kind"].iloc[0]), int(frame["shard"].iloc[0])
        if kind == 2:
            code, (n,) = summed([(unstepped(bytes(a)), [unpacked(bytes(n))]) for a, n in zip(frame["a"], frame["n"], strict=True)], 1)
            return pd.DataFrame([(2, shard, steps(code), packed(n), *[None] * 4, *_of(n))], columns=_NAMES)
        a, b, n = (np.concatenate([f(bytes(x)) for x in frame[c]]) for c, f in (("a", unstepped), ("b", unpacked), ("n", unpacked)))
        key = mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b)) >> np.uint64(64 - PAIR_BITS)
        keys, first, place = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(place, n.astype(np.float64), len(keys)).astype(np.int64)
        out = [(0, shard, steps(keys), packed(n), None, None, None, None, *_of(n))]
        a, b, zero = a[first], b[first], np.zeros(len(n), np.int64)
        words, sums = summed([(b, [zero + 1, zero, zero, zero, zero]), (a, [zero, n, n == 1, n == 2, n > 2])], 5)
        edge = cuts(words, WORD_BITS, shards)
        for s in range(shards):
            if edge[s] < edge[s + 1]:
                at = slice(edge[s], edge[s + 1])
                out.append((1, s, steps(words[at]), *(packed(x[at]) for x in sums), 0, 0, 0, 0, 0, 0))
        del a, b, n, key, keys, first, place, words, sums
        trim()
        return pd.DataFrame(out, columns=_NAMES)

    def words(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [(unstepped(bytes(k)), [unpacked(bytes(x)) for x in rest]) for k, *rest in zip(*(frame[c] for c in ("keys", *"abcde")), strict=True)]
        keys, sums = summed(parts, 5)
        return pd.DataFrame([(1, int(frame["shard"].iloc[0]), steps(keys), *(packed(x) for x in sums), *_of(sums[0]))], columns=_NAMES)

    def opened_codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for keys, n in zip(frame["keys"], frame["a"], strict=True):
                yield pd.DataFrame({"code": unstepped(bytes(keys)).astype(np.int32), "n": unpacked(bytes(n)).astype(np.int64)})

    dealt = learned.grouped().cogroup(chosen.groupBy("group")).applyInPandas(count, "kind int, shard int, a binary, b binary, n binary")
    merged = written(dealt.groupBy("kind", "shard").applyInPandas(merge, _TABLE), "pairs")
    learned.pairs = merged.filter("kind = 0")
    learned.words = written(merged.filter("kind = 1").groupBy("shard").applyInPandas(words, _TABLE), "words")
    learned.four = merged.filter("kind = 2").select("keys", "a").mapInPandas(opened_codes, "code int, n long")
    free(docs)
    return learned


def table(docs: DataFrame, good: DataFrame) -> np.ndarray | None:
    """Code lengths of four-grams of trusted texts; None without any."""
    return spelling(learn(docs, good).four)


def discounts(found: DataFrame) -> tuple[list[float], list[int]]:
    """Discounts of counts of one, two and more; n1 to n4, how many there are and the total."""
    n = [int(x or 0) for x in found.agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4", "kinds", "total")]).first()]
    n1, n2, n3, n4 = n[:4]
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    less = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.7, 3 - 4 * y * n4 / n3 if n3 else 0.9)
    return [min(max(d, 0.05), i + 0.9) for i, d in enumerate(less)], n


def answers(learned: Learned) -> DataFrame:
    """For each run of a group's documents (rows lo to hi), kind and shard: columns a to e of what its distinct pairs (kind 0)
    and words (1) have in trusted text."""
    bits, shards = learned.bits, learned.shards

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("quality_lm")
        for group, rows, _, texts in runs_of(frames, bits, 1 << 62, ASKED):
            p, out = Pairs(texts), []
            for kind, keys, wide in ((0, p.keys, PAIR_BITS), (1, p.word_keys, WORD_BITS)):
                edge = cuts(keys, wide, shards)
                out += [(kind, s, group, rows[0], rows[-1], steps(keys[edge[s] : edge[s + 1]])) for s in range(shards) if edge[s] < edge[s + 1]]
            del p, texts
            trim()
            yield pd.DataFrame(out, columns=["kind", "shard", "group", "lo", "hi", "keys"])

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):
            kind, shard, use = int(left["kind"].iloc[0]), int(left["shard"].iloc[0]), "abcde" if left["kind"].iloc[0] else "a"
            known = unstepped(bytes(right["keys"].iloc[0])) if len(right) else np.zeros(0, np.uint64)
            value = [unpacked(bytes(right[c].iloc[0])) if len(right) else np.zeros(0, np.uint64) for c in use]
            for group, lo, hi, raw in zip(left["group"].tolist(), left["lo"].tolist(), left["hi"].tolist(), left["keys"], strict=True):
                keys = unstepped(bytes(raw))
                place = np.searchsorted(known, keys)
                hit = place < len(known)
                hit[hit] = known[place[hit]] == keys[hit]
                got = [np.zeros(len(keys), np.uint64) for _ in use]
                for x, v in zip(got, value, strict=True):
                    x[hit] = v[place[hit]]
                out.append((group, lo, hi, kind, shard, *map(packed, got), *[None] * (5 - len(use))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _REPLY.split(", ")])

    asked = learned.base().mapInPandas(ask, "kind int, shard int, group long, lo long, hi long, keys binary")
    known = learned.pairs.union(learned.words).select("kind", "shard", "keys", *"abcde")
    return written(asked.groupBy("kind", "shard").cogroup(known.groupBy("kind", "shard")).applyInPandas(answer, _REPLY), "answers")


def document_bits(p: Pairs, n: np.ndarray, by_word: list[np.ndarray], spell: np.ndarray, d1: list[float], d2: list[float], one: list[int], mine: np.ndarray) -> np.ndarray:
    """Bits of each text; those that mine marks are left out of the counts that judge them."""
    cont, total, f1, f2, f3 = by_word
    off = d2[0] * f1 + d2[1] * f2 + d2[2] * f3
    n1, n2, _, _, kinds, every = one
    base = np.exp2(-spell) * (d1[0] * n1 + d1[1] * n2 + d1[2] * (kinds - n1 - n2)) / max(every, 1)

    def take(x: np.ndarray, less: list[float]) -> np.ndarray:
        return x - np.array([0, *less])[np.minimum(x, 3)]

    def bits(n, cont, total, off, base):
        lower = take(cont, d1) / max(every, 1) + base
        return -np.log2(np.maximum(np.where(total > 0, (take(n, d2) + off * lower) / np.maximum(total, 1), lower), 1e-300))

    shared = np.empty(len(p.keys))
    for at in range(0, len(shared), PART):  # in parts, for the memory
        x = slice(at, at + PART)
        a, b = p.before[x], p.last[x]
        shared[x] = bits(n[x], cont[b], total[a], off[a], base[b])
    out = np.zeros(len(mine))
    for at in range(0, len(p.pair), PART):
        out += np.bincount(p.doc[at : at + PART], shared[p.pair[at : at + PART]], len(mine))
    del shared
    edge = np.searchsorted(p.doc, np.arange(len(mine) + 1))
    own, size = [], 0
    for i in np.append(np.flatnonzero(mine), len(mine)).tolist():  # trusted documents, some at once
        if own and (size > PART or i == len(mine)):
            tokens = np.concatenate([np.arange(edge[j], edge[j + 1]) for j in own])
            if len(tokens):
                code, c = np.unique(p.doc[tokens].astype(np.int64) * len(p.keys) + p.pair[tokens], return_counts=True)
                doc, pair = np.divmod(code, len(p.keys))
                a, b = p.before[pair], p.last[pair]
                left = np.maximum(n[pair] - c, 0)
                gone = (left == 0).astype(np.float64)
                u, ua = np.unique(doc * len(p.words) + a, return_inverse=True)
                v, vb = np.unique(doc * len(p.words) + b, return_inverse=True)
                rest = np.maximum(total[a] - np.bincount(ua, c, len(u))[ua], 0)
                less = np.maximum(off[a] - d2[0] * np.bincount(ua, gone, len(u))[ua], 0)
                seen = np.maximum(cont[b] - np.bincount(vb, gone, len(v))[vb].astype(np.int64), 0)
                found = np.bincount(doc, c * bits(left, seen, rest, less, base[b]), len(mine))
                out[own] = found[own]
            own, size = [], 0
        if i < len(mine):
            own.append(i)
            size += int(edge[i + 1] - edge[i])
    return out


def scored(learned: Learned, lengths: np.ndarray) -> DataFrame:
    """row, doc_id, lang, trust, chars and bits for each row of docs, as a written table."""
    (d2, _), (d1, one) = discounts(learned.pairs), discounts(learned.words)
    replies = answers(learned)
    dropped(replies.sparkSession, learned.pairs, learned.words)
    free(replies)
    held = replies.sparkSession.sparkContext.broadcast(lengths)
    marks = learned.chosen.select("group", *[F.lit(0).cast("long").alias(c) for c in ("lo", "hi")], F.lit(2).alias("kind"), F.lit(0).alias("shard"), *[F.lit(None).cast("binary").alias(c) for c in "abcde"], "rows")
    told = replies.withColumn("rows", F.lit(None).cast("array<bigint>")).union(marks)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:  # as Arrow tables, whose packed columns needn't be copied
        begin("quality_lm")
        rows, texts = _texts(left)
        key = right.select(["lo", "hi", "kind", "shard"]).to_pandas()
        trusted_ = np.isin(rows, _chosen({"rows": right["rows"].filter(pa.array(key["kind"] == 2)).to_pylist()}))
        out = [pd.DataFrame({"row": [], "trust": [], "chars": [], "bits": []})]
        for (lo, hi), part in key[key["kind"] < 2].sort_values("shard").groupby(["lo", "hi"]):
            u, v = np.searchsorted(rows, lo), np.searchsorted(rows, hi, "right")
            own, texts[u:v] = texts[u:v], [b""] * (v - u)
            p = Pairs(own)
            del own
            trim()

            def column(kind: int, c: str) -> np.ndarray:
                parts = [unpacked(right[c][i].as_py()) for i in part.index[part["kind"] == kind].tolist()]  # noqa: B023
                return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)

            mine = trusted_[u:v]
            bits = document_bits(p, column(0, "a"), [column(1, c) for c in "abcde"], spelled(p.words, held.value), d1, d2, one, mine)
            out.append(pd.DataFrame({"row": rows[u:v], "trust": mine, "chars": p.chars, "bits": bits}))
            del p
        trim()
        return pa.Table.from_pandas(pd.concat(out).astype({"row": "int64", "trust": "bool", "chars": "int64", "bits": "float64"}), preserve_index=False)

    found = learned.grouped().cogroup(told.groupBy("group")).applyInArrow(judge, "row long, trust boolean, chars long, bits double")
    rated = written(learned.keyed.select("row", "doc_id", "lang").join(found.hint("merge"), "row"), "rates")
    dropped(replies.sparkSession, replies)
    free(replies)
    return rated


def rates(docs: DataFrame, good: DataFrame, lengths: np.ndarray) -> DataFrame:
    return scored(learn(docs, good), lengths)


def quantiles(rate: DataFrame, q: float) -> dict[str | None, float]:
    """A quantile of rate by lang, and of all under None: from histograms of bounded size, rounded up to their steps."""
    bins = rate.select("lang", F.ceil(F.col("rate") * STEPS).cast("int").alias("bin")).groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")).toPandas()
    out: dict[str | None, float] = {}
    for lang, part in [*bins.groupby("lang"), (None, bins)]:
        part = part.groupby("bin")["n"].sum().sort_index()
        if part.sum() < OWN and lang is not None or not len(part):
            continue
        reach = part.cumsum().to_numpy() / part.sum()
        out[lang] = float(part.index[np.searchsorted(reach, q)]) / STEPS
    return out


def trusted(labels: DataFrame) -> DataFrame:
    """Ids that some label calls good."""
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def per_language(found: dict[str | None, float]):
    """A column: the value of the row's language, or that of all."""
    return F.coalesce(*[F.when(F.col("lang") == l, F.lit(q)) for l, q in found.items() if l is not None], F.lit(found[None]))


def model(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """row, doc_id, rate and bar of each row of docs; None without trusted text."""
    learned = learn(docs, trusted(labels))
    lengths = spelling(written(learned.four, "four_grams"))
    if lengths is None:
        return None
    rated = scored(learned, lengths)
    good = rated.filter("trust and chars > 0")
    middle = quantiles(good.select("lang", (F.col("bits") / F.col("chars")).alias("rate")), 0.5)
    if None not in middle:
        return None
    rate = (F.col("bits") + SHRINK * per_language(middle)) / (F.col("chars") + SHRINK)
    high = quantiles(good.select("lang", rate.alias("rate")), HIGH)
    return rated.select("row", "doc_id", rate.alias("rate"), per_language(high).alias("bar"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, perplexity, threshold (a perplexity) and kept for each row of docs (doc_id, text, lang)."""
    rated = model(docs, labels)
    if rated is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    power = lambda c: F.pow(F.lit(2.0), F.col(c))
    return rated.select("doc_id", power("rate").alias("perplexity"), power("bar").alias("threshold"), (F.col("rate") <= F.col("bar")).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify keeps, with all their columns. Rejected rows' numbers meet the texts."""
    keyed = placed(docs, ROW)
    rated = model(keyed, labels)
    if rated is None:
        return docs
    bad = rated.filter("rate > bar").select(F.col("row").alias(ROW))
    return keyed.join(bad.hint("merge"), ROW, "left_anti").drop(ROW)


def op8_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
