"""Toxicity (op 1): a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (letters and digits, lowered) is the sum of three hashed rows: its own, and those of its first four and five
letters, so that unseen endings of a known stem still count. Filters of widths one to three run over all words of a
text, each is pooled by its maximum, and a logistic layer gives the score. Since filters are linear up to the pooling,
each different word of a batch is multiplied with the filters once.

Labels come from a bounded sample of labelled rows that aren't held out, of both classes; the last fifth of it, if it
has enough of both classes, sets the bias, so that 0.5 cuts best, and a threshold for each language. Scores never see labels, lang, source or doc_id; the
language only picks the threshold of `flagged`. Texts without words, null or empty, score as a text of padding does.
Labels that are null, or of rows without an id, teach nothing; with no sample of both classes the score is 0 everywhere.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.common import Memo, begin, cached, documents, held_out, map_texts

#: Labelled rows of each class that are learned from, and characters of them, at most.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 12_000_000
BITS, DIM, FILTERS, WIDTHS = 18, 16, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.05, 7
#: Labelled rows of a class that a language needs for a threshold of its own.
OWN_THRESHOLD = 20
PAD = 0
#: Words that filters run over at once.
SLICE = 200_000
_WORD = re.compile(r"[^\W_]+")
_LOW = (1 << BITS) - 1


def code(word: str) -> int:
    """The three rows of a word in one number; never PAD."""
    raw = word.encode()
    a = zlib.crc32(raw) & _LOW
    b = zlib.crc32(word[:4].encode(), 1) & _LOW
    c = zlib.crc32(word[:5].encode(), 2) & _LOW
    return (((a << BITS) | b) << BITS | c) + 1


class Coder:
    """Texts to word codes, with a bounded memo."""

    def __init__(self):
        self.memo = Memo(300_000)

    def __call__(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        memo = self.memo
        new = {w for w in found if w not in memo}
        if new:
            memo.room(len(new))
            memo.update((w, code(w)) for w in (new if len(memo) else set(found)))
        return np.fromiter(map(memo.__getitem__, found), np.int64, len(found))


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts with padding around each, where each text begins, and how many words it has; without any it has one of padding."""
    texts = [t if len(t) else np.full(1, PAD, np.int64) for t in texts]
    pad = np.full(max(WIDTHS) - 1, PAD, np.int64)
    flat = np.concatenate([x for t in texts for x in (pad, t)] + [pad])
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + len(pad)) - size - len(pad)
    return flat, begin, size


class Cnn:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.rows = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.offset = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.shift = 0.0
        self.thresholds: dict[str | None, float] = {}

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of codes, and the three rows of each (padding: zeros)."""
        c = np.maximum(codes - 1, 0)
        rows = np.stack([c >> (2 * BITS), (c >> BITS) & _LOW, c & _LOW], 1)
        x = self.rows[rows[:, 0]] + self.rows[rows[:, 1]] + self.rows[rows[:, 2]]
        x[codes == PAD] = 0
        return x, rows

    def responses(self, x: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """Each width's filters over all windows of the flat text."""
        out = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            total = (x @ f[0])[ids[: len(ids) - w + 1]]
            for j in range(1, w):
                total = total + (x @ f[j])[ids[j : len(ids) - w + 1 + j]]
            out.append(total)
        return out

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Maxima over windows add up, so all words are gone through in slices, and a long text takes no more memory than short ones."""
        flat, begin, size = laid_out(texts)
        pooled = np.full((len(size), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        for at in range(0, len(flat), SLICE):
            known, ids = np.unique(flat[at : at + SLICE + max(WIDTHS) - 1], return_inverse=True)
            x, _ = self.words(known)
            for k, (w, r) in enumerate(zip(WIDTHS, self.responses(x, ids), strict=True)):
                # windows that hold a word of the text and begin in this slice
                lo = np.maximum(begin + max(WIDTHS) - w - at, 0)
                hi = np.minimum(begin + max(WIDTHS) - 1 + size - at, min(SLICE, len(r)))
                here = np.flatnonzero(lo < hi)
                if not len(here):
                    continue
                edges = np.stack([lo[here], hi[here]], 1).ravel()
                if edges[-1] >= len(r):
                    edges = edges[:-1]
                own = pooled[here, k * FILTERS : (k + 1) * FILTERS]
                pooled[here, k * FILTERS : (k + 1) * FILTERS] = np.maximum(own, np.maximum.reduceat(r, edges, axis=0)[::2])
        h = np.maximum(pooled + self.offset, 0)
        return h @ self.out + self.bias[0]

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Adagrad on the logistic loss; the gradient of a maximum goes to the window that has it."""
        rng = np.random.default_rng(SEED)
        weights = [*self.filters, self.offset, self.out, self.bias]
        squares = [np.full_like(w, 1e-6) for w in weights]
        row_squares = np.full(1 << BITS, 1e-6, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for begin_at in range(0, len(order), BATCH):
                batch = order[begin_at : begin_at + BATCH]
                flat, begin, size = laid_out([texts[i] for i in batch])
                known, ids = np.unique(flat, return_inverse=True)
                x, rows = self.words(known)
                at, pooled = [], []
                for w, r in zip(WIDTHS, self.responses(x, ids), strict=True):
                    lo = begin + max(WIDTHS) - w
                    hi = begin + max(WIDTHS) - 1 + size
                    best = np.stack([a + r[a:b].argmax(0) for a, b in zip(lo, np.minimum(hi, len(r)), strict=True)])
                    at.append(best)
                    pooled.append(np.take_along_axis(r, best, 0))
                z = np.concatenate(pooled, 1) + self.offset
                h = np.maximum(z, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.bias[0], -30, 30)))
                d = ((p - labels[batch]) / len(batch)).astype(np.float32)
                dz = d[:, None] * self.out * (z > 0)
                dx = np.zeros_like(x)
                grads = []
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    g = dz[:, k * FILTERS : (k + 1) * FILTERS]
                    df = np.zeros_like(f)
                    for j in range(w):
                        word = ids[at[k] + j]  # texts by filters
                        df[j] = np.einsum("bf,bfd->df", g, x[word])
                        np.add.at(dx, word.ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                    grads.append(df)
                grads += [dz.sum(0), h.T @ d, np.array([d.sum()], np.float32)]
                for weight, square, grad in zip(weights, squares, grads, strict=True):
                    square += grad**2
                    weight -= rate * grad / np.sqrt(square)
                used = np.flatnonzero((known != PAD) & dx.any(1))
                if len(used):
                    touched, place = np.unique(rows[used].ravel(), return_inverse=True)
                    dr = np.zeros((len(touched), DIM), np.float32)
                    np.add.at(dr, place.ravel(), np.repeat(dx[used], 3, axis=0))
                    row_squares[touched] += (dr**2).mean(1)
                    self.rows[touched] -= rate * dr / np.sqrt(row_squares[touched])[:, None]

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(np.float64) + self.shift, -30, 30)))


def best_cut(score: np.ndarray, label: np.ndarray) -> float:
    """The threshold with the fewest errors; in the middle of the widest gap that has so few."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) + ((y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)]))
    edge = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    able = np.flatnonzero(wrong == wrong.min())
    k = able[np.argmax(edge[able + 1] - edge[able])]
    return float((edge[k] + edge[k + 1]) / 2)


def fitting(n: np.ndarray, kind: np.ndarray, most: int) -> np.ndarray:
    """Which texts are taken, in their order: of each class as many characters as half the bound (the shortest text at least);
    one that doesn't fit is passed over, and the next ones may."""
    out, left = np.zeros(len(n), bool), {}
    for i, (size, k) in enumerate(zip(n.tolist(), kind.tolist(), strict=True)):
        if size <= left.setdefault(k, most // 2):
            left[k] -= size
            out[i] = True
    for k in left:
        if not out[kind == k].any():
            out[np.flatnonzero(kind == k)[n[kind == k].argmin()]] = True
    return out


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> pd.DataFrame:
    """Whole labelled texts, in the order of a hash of their ids: so many of either class, and so many characters in all."""
    marked = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [marked.filter(F.col("toxic") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    ids = F.broadcast(ids[0].union(ids[1]))
    sized = docs.join(ids, "doc_id").select("doc_id", "toxic", F.length("text").alias("n")).filter("n > 0")
    kept = sized.toPandas().drop_duplicates("doc_id")
    kept["key"] = kept["doc_id"].map(lambda i: zlib.crc32(f"order {i}".encode()))
    kept = kept.sort_values(["key", "doc_id"])
    kept = kept[fitting(kept["n"].to_numpy(np.int64), kept["toxic"].to_numpy(np.int64), chars)]
    if not len(kept):
        return kept.assign(text="", lang=None)
    chosen = docs.sparkSession.createDataFrame(kept[["doc_id", "toxic"]])
    found = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text", "lang").toPandas()
    found = found.sort_values(["doc_id", "text"]).drop_duplicates("doc_id").set_index("doc_id")
    return found.loc[[i for i in kept["doc_id"] if i in found.index]].reset_index()


def fit(learned: pd.DataFrame) -> Cnn | None:
    """A classifier from sampled rows (text, toxic, lang); None without both classes."""
    if learned["toxic"].nunique() < 2:
        return None
    coder, model = Coder(), Cnn()
    texts, labels = [coder(t) for t in learned["text"]], learned["toxic"].to_numpy(np.float32)
    cut = len(texts) * 4 // 5
    if min((labels[cut:] == k).sum() for k in (0, 1)) < OWN_THRESHOLD:  # too few to set anything by: all are learned from
        cut = len(texts)
    model.train(texts[:cut], labels[:cut], epochs=max(EPOCHS, min(60, 24_000 // len(texts))))
    if cut == len(texts):
        return model
    own = slice(cut, None)
    logits = np.concatenate([model.logits(texts[i : i + 100]) for i in range(cut, len(texts), 100)]).astype(np.float64)
    model.shift = -best_cut(logits, labels[own])
    scores = 1 / (1 + np.exp(-np.clip(logits + model.shift, -30, 30)))
    lang = learned["lang"].to_numpy(object)[own]
    for l in {x for x in lang if isinstance(x, str)}:
        mine = lang == l
        if min((labels[own][mine] == k).sum() for k in (0, 1)) >= OWN_THRESHOLD:
            model.thresholds[l] = float(np.clip(best_cut(scores[mine], labels[own][mine]), 0.05, 0.95))
    return model


_coder = Coder()
cached("toxicity", _coder.memo.clear)


def score(docs: DataFrame, model: Cnn | None) -> DataFrame:
    """doc_id, held_out, score, predicted, and flagged (by the language's threshold) for each row of docs (doc_id, text, lang)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        model = held.value
        s = model.scores([_coder(t) for t in frame["text"]]) if model else np.zeros(len(frame))
        bar = np.array([model.thresholds.get(l, 0.5) if model else 0.5 for l in frame["lang"]])
        return pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32), "flagged": s >= bar}, index=frame.index)

    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", held_out().alias("held_out"), "text", F.col("lang").cast("string").alias("lang"))
    return map_texts(asked, run, f"doc_id {kind}, held_out boolean, score double, predicted int, flagged boolean", 2_000_000, "toxicity")


def keep(docs: DataFrame, model: Cnn | None) -> DataFrame:
    """The rows of docs that aren't flagged, with all their columns."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series, lang: pd.Series) -> pd.Series:
        begin("toxicity")
        model, out = held.value, []
        for lo in range(0, len(text), 256):
            s = model.scores([_coder(t) for t in text.iloc[lo : lo + 256]])
            out.append(s < np.array([model.thresholds.get(l, 0.5) for l in lang.iloc[lo : lo + 256]]))
        return pd.Series(np.concatenate(out) if out else [], dtype=bool)

    return docs.filter(clean("text", F.col("lang").cast("string")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
