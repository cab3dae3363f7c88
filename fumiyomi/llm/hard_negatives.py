"""Hard-negative mining: for an anchor and each of its positives, the rows of other labels that score just below the positive.

Vectors are rounded to integers and cut into pairs of components; k-means over a bounded sample gives each pair 256
centres. A row keeps its centres (product quantisation), the norm of what they leave out, and its integers. A block of anchors
meets a block of rows by look-up tables: table score plus and minus the bound of the residual (Cauchy-Schwarz) enclose the exact
score, so rows whose enclosure misses all windows are left out for sure; the rest are scored exactly in integers.

Two rounds over blocks: the first finds each anchor's positives, the second fills the windows below them. Anchors are a stated
query set; they meet all rows as blocks, dealt by (group of rows, group of anchors), and each task keeps only the best few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.common import dropped, starts, written

#: Rows the centres are fitted on, and centres of each pair of components.
SAMPLE, CENTRES, STEPS = 4096, 256, 6
#: Rows of a block, anchors of a block; blocks of rows and of anchors that one task holds, on average.
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 256
ROW_BLOCKS, ANCHOR_BLOCKS = 32, 256
#: Positives of an anchor, and negatives of each.
POSITIVES, NEGATIVES = 5, 5
#: Rows at a time that look-up tables score.
TILE = 1024
NONE = np.iinfo(np.int64).min
BLOCK = "first long, kind string, labels binary, vectors binary, codes binary, residuals binary, ids binary, owners binary"
ANCHORS = "first long, kind string, ids binary, keys binary, labels binary, vectors binary, windows binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of rows that have all three, each component finite."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)


def rounded(embedding: pd.Series, width: int) -> np.ndarray:
    """floor(256 x) as doubles; shorter vectors end with zeros."""
    out = np.zeros((len(embedding), width))
    for i, x in enumerate(embedding):
        out[i, : len(x)] = x
    return np.floor(256.0 * out)


def narrow(x: np.ndarray) -> tuple[str, bytes]:
    """The smallest type that holds whole numbers, and their bytes."""
    most = np.abs(x).max(initial=0)
    kind = next((k for k in ("i2", "i4", "i8") if most < 2.0 ** (8 * int(k[1]) - 1)), "f8")
    return kind, x.astype(kind).tobytes()


def wide(kind: str, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def fit(sample: np.ndarray) -> np.ndarray:
    """Centres (pair, centre, 2) of pairs of components, whole numbers; k-means from evenly spaced sample rows."""
    n, width = sample.shape
    pairs = sample.reshape(n, width // 2, 2)
    k = min(CENTRES, max(n, 1))
    out = np.zeros((width // 2, k, 2))
    for m in range(width // 2 if n else 0):
        x = pairs[:, m]
        c = x[np.lexsort(x.T)][np.linspace(0, n - 1, k).astype(int)]
        for _ in range(STEPS):
            own = nearest(x, c)
            size = np.bincount(own, minlength=k)
            total = np.stack([np.bincount(own, x[:, j], k) for j in range(2)], 1)
            c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        out[m] = np.rint(c)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None] - 2 * (x @ c.T), axis=1)


def encode(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centres, and its residual norm with the slack of single precision, rounded up."""
    pairs = x.reshape(len(x), -1, 2)
    codes = np.empty(pairs.shape[:2], np.uint8)
    near = np.empty_like(pairs)
    for m in range(pairs.shape[1]):
        codes[:, m] = nearest(pairs[:, m], centres[m])
        near[:, m] = centres[m][codes[:, m]]
    left, held = np.sqrt(((pairs - near) ** 2).sum((1, 2))), np.sqrt((near**2).sum((1, 2)))
    bound = (left + (pairs.shape[1] + 4) * 2.0**-22 * held) * (1 + 1e-5) + 1e-3
    return codes, bound.astype(np.float32)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in whole numbers; beyond long they stay at its ends."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    if most < 2.0**63:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    ends = np.iinfo(np.int64)
    sums = (sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for u, v in zip(a.tolist(), b.tolist(), strict=True))
    return np.array([min(max(s, ends.min + 1), ends.max) for s in sums], np.int64)


def blocks(rows: DataFrame, width: int, centres: np.ndarray) -> DataFrame:
    """rows as blocks. Of rows with one label and vector a block keeps the least ids, one more than an answer can hold."""
    keep = max(POSITIVES, NEGATIVES) + 1

    def block(frame: pd.DataFrame) -> dict:
        x, labels, ids = rounded(frame["embedding"], width), frame["label"].to_numpy(np.int64), frame["vec_id"].to_numpy(np.int64)
        _, vector = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, vector.ravel(), labels))
        x, labels, ids, vector = x[order], labels[order], ids[order], vector.ravel()[order]
        new = np.r_[True, (labels[1:] != labels[:-1]) | (vector[1:] != vector[:-1])]
        other = new | np.r_[True, ids[1:] != ids[:-1]]  # rows repeated as they are count once
        first = np.flatnonzero(new)
        x, labels, ids, owner = x[first], labels[first], ids[other], (np.cumsum(new) - 1)[other]
        few = np.arange(len(ids)) - np.searchsorted(owner, owner) < keep
        codes, bound = encode(x, centres)
        kind, data = narrow(x)
        return {"first": int(ids[0]), "kind": kind, "labels": labels.tobytes(), "vectors": data, "codes": codes.tobytes(), "residuals": bound.tobytes(), "ids": ids[few].tobytes(), "owners": owner[few].astype(np.int32).tobytes()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            for i in range(0, len(frame), BLOCK_ROWS):
                held.append(frame.iloc[i : i + BLOCK_ROWS])
                if sum(map(len, held)) >= BLOCK_ROWS:
                    whole, held = pd.concat(held), []
                    yield pd.DataFrame([block(whole.iloc[:BLOCK_ROWS])])
                    held = [whole.iloc[BLOCK_ROWS:]] if len(whole) > BLOCK_ROWS else []
        if held:
            yield pd.DataFrame([block(pd.concat(held))])

    return rows.mapInPandas(run, BLOCK)


def anchor_blocks(anchors: DataFrame, width: int, n: int) -> DataFrame:
    """Anchors (key, vec_id, label, embedding, windows: scores of positives) in n blocks or a few more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for i in range(0, len(whole), BLOCK_ANCHORS):
                f = whole.iloc[i : i + BLOCK_ANCHORS]
                kind, data = narrow(rounded(f["embedding"], width))
                windows = np.full((len(f), POSITIVES), NONE)
                for k, w in enumerate(f["windows"]):
                    windows[k, : len(w)] = w
                yield pd.DataFrame([{"first": int(f["key"].iloc[0]), "kind": kind, "ids": f["vec_id"].to_numpy(np.int64).tobytes(), "keys": f["key"].to_numpy(np.int64).tobytes(), "labels": f["label"].to_numpy(np.int64).tobytes(), "vectors": data, "windows": windows.tobytes()}])

    return anchors.repartition(n, "key").mapInPandas(run, ANCHORS)


class Best:
    """The best few (score, id) of each slot, higher scores first, ties by smaller id."""

    def __init__(self, slots: int, most: int):
        self.score, self.id, self.most = np.full((slots, most), NONE), np.zeros((slots, most), np.int64), most

    def bar(self) -> np.ndarray:
        """What a score must reach to enter a slot."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        old = self.score[touched] != NONE
        slot = np.r_[slot, np.repeat(touched, self.most).reshape(-1, self.most)[old]]
        score, ids = np.r_[score, self.score[touched][old]], np.r_[ids, self.id[touched][old]]
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.r_[True, (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])]
        slot, score, ids = slot[new], score[new], ids[new]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        top = place < self.most
        self.score[touched], self.id[touched] = NONE, 0
        self.score[slot[top], place[top]], self.id[slot[top], place[top]] = score[top], ids[top]


class Rows:
    """A block of rows, opened."""

    def __init__(self, r, pairs: int):
        self.labels = np.frombuffer(r.labels, np.int64)
        n = len(self.labels)
        self.vectors = wide(r.kind, r.vectors, n)
        self.codes, self.residuals = np.frombuffer(r.codes, np.uint8).reshape(n, pairs), np.frombuffer(r.residuals, np.float32)
        self.ids, owners = np.frombuffer(r.ids, np.int64), np.frombuffer(r.owners, np.int32)
        self.at = starts(np.bincount(owners, minlength=n))

    def members(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the ids that have it: index into row, id."""
        size = (self.at[1:] - self.at[:-1])[row]
        which = np.repeat(np.arange(len(row)), size)
        return which, self.ids[np.arange(len(which)) - np.repeat(starts(size)[:-1], size) + self.at[:-1][row][which]]


class Anchors:
    """A block of anchors, opened, with look-up tables (pair, centre, anchor)."""

    def __init__(self, r, centres: np.ndarray):
        self.ids, self.keys, self.labels = (np.frombuffer(x, np.int64) for x in (r.ids, r.keys, r.labels))
        n = len(self.ids)
        self.vectors = wide(r.kind, r.vectors, n)
        self.windows = np.frombuffer(r.windows, np.int64).reshape(n, POSITIVES)
        x = self.vectors.astype(np.float64)
        self.tables = np.einsum("amj,mkj->mka", x.reshape(n, -1, 2), centres).astype(np.float32)
        self.norm = (np.sqrt((x * x).sum(1)) * (1 + 1e-5)).astype(np.float32)


def edge(whole: np.ndarray, up: bool) -> np.ndarray:
    """Whole numbers as single ones not inside them; the ends of long, where scores stay, are without bound."""
    ends, out = np.iinfo(np.int64), np.nextafter(whole.astype(np.float32), np.float32(np.inf if up else -np.inf))
    return np.where(whole == ends.max, np.inf, out) if up else np.where(whole <= ends.min + 1, -np.inf, out)


def enclosed(rows: Rows, at: np.ndarray, anchors: Anchors, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table scores (row, anchor) and what the exact ones may differ by."""
    codes = rows.codes[at]
    score = np.zeros((len(at), len(who)), np.float32)
    every = len(who) == len(anchors.ids)
    for m in range(codes.shape[1]):
        table = anchors.tables[m] if every else anchors.tables[m][:, who]
        score += table.take(codes[:, m], axis=0)
    return score, rows.residuals[at][:, None] * anchors.norm[who][None]


def positives_of(anchors: Anchors, rows: Rows, best: Best, base: int) -> None:
    """Adds rows of an anchor's label. A slot for each anchor, from base on."""
    for label in np.intersect1d(anchors.labels, rows.labels):
        who, own = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
        for i in range(0, len(own), TILE):
            at = own[i : i + TILE]
            score, slack = enclosed(rows, at, anchors, who)
            r, a = np.nonzero(~(score + slack < edge(best.bar()[base + who], False)[None]))
            rerank(anchors, who[a], rows, at[r], lambda a, s: (base + a, s >= best.bar()[base + a]), best)


def negatives_of(anchors: Anchors, rows: Rows, best: Best, base: int) -> None:
    """Adds rows of other labels to the windows below positives. A slot for each anchor and positive, from base on."""
    hi = anchors.windows
    lo = np.where(hi != NONE, hi - hi // 5, 0)  # four fifths of it, rounded up
    who = np.flatnonzero((hi != NONE).any(1))
    for i in range(0, len(rows.labels) if len(who) else 0, TILE):
        at = np.arange(i, min(i + TILE, len(rows.labels)))
        score, slack = enclosed(rows, at, anchors, who)
        need = np.maximum(lo, best.bar()[base : base + hi.size].reshape(hi.shape))
        open_ = (hi != NONE) & (need <= hi)
        least = np.where(open_, need, np.iinfo(np.int64).max).min(1)[who]
        most = np.where(open_, hi, NONE).max(1)[who]
        missed = (score + slack < edge(least, False)[None]) | (score - slack > edge(most, True)[None])
        r, a = np.nonzero(~missed & (rows.labels[at][:, None] != anchors.labels[who][None]) & open_.any(1)[who][None])
        for w in range(POSITIVES):

            def window(a, s, w=w):
                slot = base + a * POSITIVES + w
                return slot, (hi[a, w] != NONE) & (s <= hi[a, w]) & (s >= lo[a, w]) & (s >= best.bar()[slot])

            if w == 0:
                s = rerank(anchors, who[a], rows, at[r], window, best)
            else:
                rerank(anchors, who[a], rows, at[r], window, best, s)


def rerank(anchors: Anchors, a: np.ndarray, rows: Rows, r: np.ndarray, window, best: Best, s: np.ndarray | None = None) -> np.ndarray:
    """Exact scores of pairs; those in the window go to their slots with the ids of their rows."""
    if s is None:
        s = np.concatenate([exact(anchors.vectors[a[i : i + 65536]], rows.vectors[r[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])
    slot, inside = window(a, s)
    slot, at = slot[inside], np.flatnonzero(inside)
    which, ids = rows.members(r[at])
    other = ids != anchors.ids[a[at]][which]
    best.add(slot[which][other], s[at][which][other], ids[other])
    return s


def met(rows: DataFrame, anchors: DataFrame, groups: tuple[int, int], centres: np.ndarray, step, slots: int, most: int) -> DataFrame:
    """Every block of anchors with every block of rows; the best few of each slot, by group of rows: key, slot, id, score."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            opened = [Anchors(r, centres) for r in right.itertuples()] if len(right) <= 4 else None
            best = [Best(len(r.ids) // 8 * slots, most) for r in right.itertuples()]
            for b in left.itertuples():  # a block of rows is open once, and tables of a few blocks of anchors at once
                block = Rows(b, len(centres))
                for k, r in enumerate(right.itertuples()):
                    step(opened[k] if opened else Anchors(r, centres), block, best[k], 0)
            for k, r in enumerate(right.itertuples()):
                slot, place = np.nonzero(best[k].score != NONE)
                out.append(pd.DataFrame({"key": np.frombuffer(r.keys, np.int64)[slot // slots], "slot": slot % slots, "id": best[k].id[slot, place], "score": best[k].score[slot, place]}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "slot": [], "id": [], "score": []})

    g, h = groups
    left = rows.select("*", F.pmod(F.xxhash64("first"), F.lit(g)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"))
    right = anchors.select("*", F.pmod(F.xxhash64("first"), F.lit(h)).cast("int").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))).alias("g"))
    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(run, "key long, slot int, id long, score long")


def top(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """by and an array of the best (score, id), in order. A key has a few rows from each group of rows."""
    order = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("less"), "id")))
    return found.groupBy(*by).agg(F.slice(order, 1, most).alias("best")).select(*by, F.transform("best", lambda x: F.struct(x["id"].alias("id"), (-x["less"]).alias("score"))).alias("best"))


RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mine(vectors: DataFrame, anchors: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores. vectors: vec_id, label, embedding (more columns are ignored).

    Rows without id, label or vector, or with a component that is null or not finite, take no part. Shorter vectors end with zeros.
    Rows repeated as they are count once; rows that share an id but nothing else all take part, and none is a positive or
    negative of an anchor with its id. Without anchors, positives or rows in a window there are no rows of result."""
    spark = vectors.sparkSession
    own = usable(vectors)
    about = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"), F.count_if(anchors).alias("a")).first()
    if not about["a"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n, width = about["n"], max(2, about["width"] + about["width"] % 2)
    part = F.pmod(F.xxhash64("vec_id", "label"), F.lit(1 << 30)) <= int(min(1.0, SAMPLE / n) * (1 << 30))
    some = own.filter(part).select("embedding").limit(2 * SAMPLE).toPandas()  # bounded by the limit, about SAMPLE by the hash
    centres = fit(rounded(some["embedding"], width))
    rows = written(blocks(own, width, centres), "blocks")
    key = F.xxhash64("vec_id", "label", "embedding").alias("key")
    asked = written(own.filter(anchors).select(key, "vec_id", "label", "embedding").dropDuplicates(["key"]), "anchors")
    few = -(-about["a"] // BLOCK_ANCHORS)
    groups = (-(-n // (BLOCK_ROWS * ROW_BLOCKS)), -(-few // ANCHOR_BLOCKS))
    none = F.array().cast("array<long>").alias("windows")
    found = met(rows, anchor_blocks(asked.select("*", none), width, few), groups, centres, positives_of, 1, POSITIVES)
    positives = written(asked.join(top(found, ["key"], POSITIVES), "key"), "positives")
    windows = positives.select("key", "vec_id", "label", "embedding", F.transform("best", lambda x: x["score"]).alias("windows"))
    found = met(rows, anchor_blocks(windows, width, few), groups, centres, negatives_of, POSITIVES, NEGATIVES)
    pairs = positives.select("key", F.col("vec_id").alias("anchor_id"), F.posexplode("best").alias("slot", "p"))
    out = pairs.join(top(found, ["key", "slot"], NEGATIVES), ["key", "slot"]).select("anchor_id", "p", F.posexplode("best").alias("at", "x"))
    out = written(out.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).alias("rank"), F.col("x.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score")), "negatives")
    dropped(spark, rows, asked, positives)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(noisy, F.col("vec_id") % 100 == 0)
