"""Language ID (op 5): prediction by partial matching over byte contexts.

Each language has a context tree of up to three bytes, its counts learned from a bounded sample and then frozen.
In a context seen n times with q different next bytes, a byte seen c times has probability c / (n + q); the escape
q / (n + q) goes to the next shorter context, without the bytes already counted, and at last to one in 256.
A text's code length under a language is the sum over its bytes; the shortest wins, ties go to the first name.
All languages' code lengths stand in one table over the contexts that any tree holds, so scoring is three lookups a byte.

Texts are lowered first. Null texts and texts without a letter are `und` with score 0, as is everything if nothing
can be learned. Rows without an id or with a null language are never learned from. Repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fumiyomi.llm.common import documents, held_out, map_texts

#: Documents of each language that are learned from, and bytes of them: whole documents until so many are reached.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 1_500_000
DEPTH = 3
#: Entries of the table of code lengths, at most: rare contexts go first.
TABLE = 16_000_000
#: Bytes whose code lengths are added at once.
SLICE = 1_000_000
PAD = b"\n" * DEPTH


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


class ContextTrees:
    """Frozen trees of all languages as tables: two steps of states, rows of code lengths."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        data = {l: np.frombuffer(PAD + b"".join(folded(t) + PAD for t in samples[l]), np.uint8) for l in self.langs}
        seen = np.unique(np.concatenate([np.frombuffer(PAD, np.uint8), *data.values()]))
        self.kinds = len(seen) + 1  # the last stands for each byte never seen
        self.kind = np.full(256, len(seen), np.uint8 if len(seen) < 255 else np.int16)
        self.kind[seen] = np.arange(len(seen))
        a, count = self.kinds, len(self.langs)
        coded = {l: self.kind[x].astype(np.int64) for l, x in data.items()}
        # context and next byte, for each order: code of the context (nearest byte first) times a, plus the next
        grams = {l: [np.unique(self._contexts(x, k) * a + x[DEPTH:], return_counts=True) for k in range(DEPTH + 1)] for l, x in coded.items()}
        least = 2
        while True:  # contexts that are frequent enough in some language; each one's shorter ones are, too
            nodes: list[np.ndarray] = [np.zeros(1, np.int64)]
            for k in range(1, DEPTH + 1):
                found = []
                for l in self.langs:
                    code, n = grams[l][k]
                    ctx, first = np.unique(code // a, return_index=True)
                    found.append(ctx[np.add.reduceat(n, first) >= least] if len(ctx) else ctx)
                nodes.append(np.unique(np.concatenate(found)))
            if sum(map(len, nodes)) * a * count <= TABLE:
                break
            least *= 2
        at = [0, *np.cumsum([len(x) for x in nodes])]
        self.cost = np.zeros((at[-1], a, count), np.float32)
        for j, l in enumerate(self.langs):
            shorter = np.full((1, a), 1 / 256)
            for k in range(DEPTH + 1):
                code, n = grams[l][k]
                place = np.searchsorted(nodes[k], code // a)
                own = (place < len(nodes[k])) & (nodes[k][np.minimum(place, len(nodes[k]) - 1)] == code // a)
                counts = np.zeros((len(nodes[k]), a))
                counts[place[own], (code % a)[own]] = n[own]
                total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
                back = shorter if k == 0 else shorter[np.searchsorted(nodes[k - 1], self._shorter(nodes[k], k))]
                unseen = np.where(counts > 0, 0, back)
                weight = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1)
                # what the shorter context leaves to bytes not seen here; the last kind stands for many bytes
                left = 1 - np.where(counts > 0, back, 0).sum(1, keepdims=True)
                p = counts / np.maximum(total + kinds, 1) + weight * unseen / np.maximum(left, 1e-9)
                self.cost[at[k] : at[k + 1], :, j] = -np.log2(np.maximum(p, 1e-12))
                shorter = p
        # states after one byte: its node or the root; after two: the node of two, or that of one with no longer context
        one = np.zeros(a, np.int64)
        one[nodes[1]] = at[1] + np.arange(len(nodes[1]))
        states, self.two = [], np.zeros((a, a), np.int32)
        for c1 in range(a):
            dead = len(states)
            states.append((one[c1], None))
            self.two[c1] = dead
            lo, hi = np.searchsorted(nodes[2], [c1 * a, (c1 + 1) * a])
            for i in range(lo, hi):
                self.two[c1, nodes[2][i] - c1 * a] = len(states)
                states.append((at[2] + i, int(nodes[2][i])))
        self.three = np.zeros((len(states), a), np.int32)
        for s, (row, ctx) in enumerate(states):
            self.three[s] = row
            if ctx is not None:
                lo, hi = np.searchsorted(nodes[3], [ctx * a, (ctx + 1) * a])
                self.three[s, nodes[3][lo:hi] - ctx * a] = at[3] + np.arange(lo, hi)
        self.cost = self.cost.reshape(-1, count)

    def _contexts(self, x: np.ndarray, k: int) -> np.ndarray:
        code = np.zeros(len(x) - DEPTH, np.int64)
        for d in range(1, k + 1):
            code = code * self.kinds + x[DEPTH - d : len(x) - d]
        return code

    def _shorter(self, ctx: np.ndarray, k: int) -> np.ndarray:
        return ctx // self.kinds if k > 1 else np.zeros(len(ctx), np.int64)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits: texts by languages."""
        x = self.kind[np.frombuffer(PAD + b"".join(t + PAD for t in texts), np.uint8)]
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size + DEPTH) - size  # in x; each text has a pad before it
        state = self.two[x[2:-1], x[1:-2]]
        row = self.three[state, x[:-3]].astype(np.int64)
        row *= self.kinds
        row += x[3:]
        out = np.zeros((len(texts), len(self.langs)))
        for at in range(0, len(row), SLICE):  # sums add up: a long text takes no more memory than short ones
            part = row[at : at + SLICE]
            lo, hi = np.maximum(begin - DEPTH - at, 0), np.minimum(begin - DEPTH + size - at, len(part))
            full = np.flatnonzero(lo < hi)
            if len(full):
                edges = np.stack([lo[full], hi[full]], 1).ravel()
                if edges[-1] == len(part):
                    edges = edges[:-1]
                out[full] += np.add.reduceat(self.cost[part], edges, axis=0, dtype=np.float64)[::2]
        return out


def sample(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """Whole texts by language: the rows least by a hash of their id, up to the bounds. Ids are ranked alone; then few rows are read."""
    able = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    # a frequent language's rows are thinned by the hash before they are ranked: about four times as many as asked for stay
    share = {r["lang"]: min(1.0, 4 * most_docs / r["n"]) for r in able.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return {}
    below = F.coalesce(*[F.when(F.col("lang") == l, F.lit(int(s * (1 << 32)))) for l, s in share.items()])
    order = Window.partitionBy("lang").orderBy("key", "doc_id")
    thinned = able.select("lang", "doc_id", F.octet_length("text").alias("n"), key.alias("key"), below.alias("below")).filter("key <= below")
    ranked = thinned.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most_docs).select("lang", "doc_id", "n").collect()
    left: dict[str, int] = {}
    chosen = []  # what doesn't fit in the bytes left is passed over; sizes are known before a text is read
    for r in ranked:
        if r["n"] <= left.setdefault(r["lang"], most_bytes):
            left[r["lang"]] -= r["n"]
            chosen.append((r["lang"], r["doc_id"], r["n"]))
    for lang in {r["lang"] for r in ranked} - {c[0] for c in chosen}:  # only longer ones: the shortest of them
        chosen.append(min(((r["lang"], r["doc_id"], r["n"]) for r in ranked if r["lang"] == lang), key=lambda c: c[2]))
    ids = docs.sparkSession.createDataFrame(chosen, able.select("lang", "doc_id", F.octet_length("text").alias("n")).schema)
    rows = able.withColumn("n", F.octet_length("text")).join(F.broadcast(ids.distinct()), ["lang", "doc_id", "n"], "left_semi").select("lang", "doc_id", "text").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def predict(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior under equal priors) and bits per byte for each row."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        trees = model.value
        texts = frame["text"].tolist()
        letter = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        name, score, rate = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
        if trees and trees.langs and letter.any():
            full = np.flatnonzero(letter)
            raw = [folded(texts[i]) for i in full]
            bits = trees.bits(raw)
            best = bits.argmin(1)
            name[full] = np.array(trees.langs, object)[best]
            score[full] = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
            rate[full] = bits.min(1) / [len(r) for r in raw]
        return pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "lang_pred": name, "score": score, "bits_per_byte": rate}, index=frame.index)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double", 1_000_000)


def identify(docs: DataFrame) -> DataFrame:
    found = sample(docs)
    return predict(docs, ContextTrees(found) if found else None)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
