"""N-gram Jaccard join (op 9): Bayesian candidate pruning over MinHash values, then exact verification.

A text is the set of its five-word shingles (a shorter text: of all its words together). Texts with the same set are one
class; its least row by (doc_id, place) stands for it. Representatives that share a band of MinHash values are candidates.
Pairs within a band are compared: a few MinHash values at a time, dropping a pair once the posterior probability that its
similarity reaches the threshold, under a uniform prior, falls below a tolerance. Connected components over the pairs that
stay (not over all that share a band) are the groups, within which pairs are pruned in the same way and verified on the
shingle sets themselves. A pair of similarity 0.8 shares no band with probability 3e-6, and then may still meet through a third text.

Within a band only the low byte of each MinHash value travels, which can only keep pairs longer; texts of one component already
aren't compared again. Bands and groups of more than BLOCK texts are compared in pairs of blocks, one task each, so no task
holds an unbounded group; pairs are counted where they are found, and only sums and spanning links leave a task.

Null and empty texts have the empty set: they are copies of each other, linked to no other. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.common import Memo, begin, cached, connected, documents, map_texts, placed, runs, trim, words, written
from fumiyomi.llm.fingerprints import mix

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
BLOCK = 2000
#: Texts of a band that are compared row by row, for many bands at once; larger bands one by one.
SMALL = 12
#: The column of row numbers.
ROW = "_join_row"
_rng = np.random.default_rng(90210)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_P = np.cumprod(np.full(SHINGLE, 0x9E3779B97F4A7C15, np.uint64))
_memo = Memo(250_000)
cached("jaccard_join", _memo.clear)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's shingles."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    new = {w for w in found if w not in _memo}
    if new:
        _memo.room(len(new))
        _memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in (new if len(_memo) else set(found)))
    h = np.fromiter(map(_memo.__getitem__, found), np.uint64, len(found))
    n = min(n, len(h))
    total = h[: len(h) - n + 1] * _P[0]
    for k in range(1, n):
        total = mix(total) + h[k : len(h) - n + 1 + k] * _P[k]
    return np.unique(mix(total + np.uint64(n)))


def minhash(found: np.ndarray) -> np.ndarray:
    h = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        np.minimum(least, (h[i : i + 2048, None] * _A + _B).min(0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Texts by bands: 64-bit keys."""
    v = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), v.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * _P[1] + v[:, :, r] + _P[0])
    return key.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, total: int = BANDS * ROWS) -> dict[int, int]:
    """For each number of compared values the least matches with which a pair stays: P(J >= t | m of n) is a binomial sum."""
    out = {}
    for n in range(step, total + 1, step):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def measured(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest of the shingle set (two longs), n shingles, signature, its low bytes and band keys of each row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t) for t in frame["text"]]
        signatures = np.stack([minhash(s) for s in sets])
        keys = band_keys(signatures)
        digest = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets])
        return pd.DataFrame({
            "row": frame["row"].to_numpy(), "doc_id": frame["doc_id"].array, "d1": digest[:, 0], "d2": digest[:, 1],
            "n": [len(s) for s in sets], "signature": [s.tobytes() for s in signatures], "low": [s.astype(np.uint8).tobytes() for s in signatures], "bands": list(keys),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("row", "doc_id", "text"), run, f"row long, doc_id {kind}, d1 long, d2 long, n int, signature binary, low binary, bands array<long>", 2_000_000, "jaccard_join")


def compare(left: list[tuple], right: list[tuple] | None, threshold: float, bars: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links within left, or between left and right (rows: weight, n, signature, shingles): summed weights of each text's
    links, and the least index of its component."""
    rows = left + (right or [])
    count, edge = len(rows), len(left)
    weight = np.array([r[0] for r in rows], np.int64)
    n = np.array([r[1] for r in rows], np.int64)
    signature = np.stack([r[2] for r in rows])
    # bit sets over the shingles that more than one text has: others never meet
    flat = np.concatenate([r[3] for r in rows])
    owner = np.repeat(np.arange(count), [len(r[3]) for r in rows])
    known, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], number[place[keep]]
    width = max(1, -(-int(shared.sum()) // 64))
    bits = np.zeros((count, width), np.uint64)
    np.bitwise_or.at(bits, (owner, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    links, comp = np.zeros(count, np.int64), np.arange(count)
    for i in range(edge):
        j = np.arange(i + 1, count) if right is None else np.arange(edge, count)
        if not len(j):
            continue
        j = j[(np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i]) - 1e-9) & (n[j] > 0) & (n[i] > 0)]
        same = np.zeros(len(j), np.int64)
        for upto, bar in bars.items():
            if not len(j):
                break
            same += (signature[j, upto - STEP : upto] == signature[i, upto - STEP : upto]).sum(1)
            stay = same >= bar
            if not stay.all():
                j, same = j[stay], same[stay]
        if not len(j):
            continue
        both = np.concatenate([np.bitwise_count(bits[j[k : k + 500]] & bits[i]).sum(1, dtype=np.int64) for k in range(0, len(j), 500)])
        j = j[both >= threshold * (n[i] + n[j] - both) - 1e-9]
        if len(j):
            links[i] += weight[j].sum()
            links[j] += weight[i]
            roots = np.unique(comp[np.append(j, i)])
            if len(roots) > 1:
                comp[np.isin(comp, roots)] = roots[0]
    return links, comp


def unpruned(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, bars: dict[int, int]) -> np.ndarray:
    """Places of the pairs of rows of a and b (low bytes of MinHash values; na and nb: shingles) that stay to the end."""
    at = np.flatnonzero(np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
    same = np.zeros(len(at), np.int64)
    for upto, bar in bars.items():
        if not len(at):
            break
        x = np.broadcast_to(a, b.shape) if a.ndim == 1 else a
        same += (x[at, upto - STEP : upto] == b[at, upto - STEP : upto]).sum(1)
        stay = same >= bar
        at, same = at[stay], same[stay]
    return at


def band_links(low: np.ndarray, n: np.ndarray, left: np.ndarray | None, threshold: float, bars: dict[int, int]) -> list[tuple[int, int]]:
    """Links that span what pairs of one band leave together; left: pairs are of one row that it marks and one that it doesn't."""
    comp, out = np.arange(len(n)), []
    for i in range(len(n)) if left is None else np.flatnonzero(left).tolist():
        j = np.flatnonzero(comp != comp[i]) if left is None else np.flatnonzero((comp != comp[i]) & ~left)
        if left is None:
            j = j[j > i]
        found = j[unpruned(low[i], low[j], n[i], n[j], threshold, bars)]
        if len(found):
            _, first = np.unique(comp[found], return_index=True)  # a link to each other component
            out += [(i, int(k)) for k in found[first]]
            comp[np.isin(comp, comp[found])] = comp[i]
    return out


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """a and b: links that span what pairs of representatives (row, n, low, bands) that share a band leave together."""
    bars = least_matches(threshold)
    banded = reps.select("row", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int")).drop("k")
    # a text of block i of a band takes part in the comparisons (i, k) and (k, i) of all blocks k
    rows = banded.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    rows = rows.select("row", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    task = F.xxhash64("key", F.least("block", "k"), F.greatest("block", "k"))
    rows = rows.select("row", task.alias("task"), (F.col("block") == F.least("block", "k")).alias("own"), (F.col("block") == F.col("k")).alias("within"))
    dealt = rows.join(reps.select("row", "n", "low"), "row").repartition("task").sortWithinPartitions("task", "row").select("task", "row", "own", "within", "n", "low")

    def compare_bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("jaccard_join")
        held: list[pd.DataFrame] = []

        def done(last: bool) -> pd.DataFrame:
            frame = pd.concat(held, ignore_index=True)
            task, row, n = (frame[c].to_numpy() for c in ("task", "row", "n"))
            edge = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            cut = len(task) if last else int(edge[-1])  # the last run may go on
            held[:] = [] if last else [frame.iloc[cut:]]
            low = np.frombuffer(b"".join(frame["low"].iloc[:cut]), np.uint8).reshape(-1, BANDS * ROWS)
            size = np.diff(np.append(edge[edge < cut], cut))
            own, within = frame["own"].to_numpy(), frame["within"].to_numpy()
            out = [np.zeros((0, 2), np.int64)]
            small = np.repeat(size <= SMALL, size) & within[:cut]
            for d in range(1, SMALL):
                i = np.flatnonzero((task[d:cut] == task[: cut - d]) & small[: cut - d]) if d < cut else np.zeros(0, np.int64)
                i = i[unpruned(low[i], low[i + d], n[i], n[i + d], threshold, bars)]
                out.append(np.stack([row[i], row[i + d]], 1))
            for a, k in zip(edge[edge < cut].tolist(), size.tolist(), strict=True):
                if k > SMALL or not within[a]:
                    own_ = own[a : a + k]
                    pairs = band_links(low[a : a + k], n[a : a + k], None if within[a] else own_, threshold, bars)
                    out.append(np.array([(row[a + i], row[a + j]) for i, j in pairs], np.int64).reshape(-1, 2))
            pairs = np.unique(np.sort(np.concatenate(out), 1), axis=0)
            return pd.DataFrame({"a": pairs[:, 1], "b": pairs[:, 0]})

        rows_ = 0
        for frame in frames:
            held.append(frame)
            rows_ += len(frame)
            if rows_ > 40_000 and held and (frame["task"].iloc[-1] != held[0]["task"].iloc[0]):
                yield done(False)
                rows_ = sum(map(len, held))
        if held:
            yield done(True)
        trim()

    return dealt.mapInPandas(compare_bands, "a long, b long")


def links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row, doc_id, class_id (least doc_id of the group), copies_id (least doc_id of equal sets), n_links (other rows at
    or above the threshold) and first (the one row of its group that stays) for each row of docs."""
    return _links(placed(docs, ROW).select(F.col(ROW).alias("row"), "doc_id", "text"), threshold)


def _links(numbered: DataFrame, threshold: float) -> DataFrame:
    table = written(measured(numbered), "shingles")
    classes = table.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x"), F.count(F.lit(1)).alias("weight"))
    classes = written(classes.select("d1", "d2", F.col("x.row").alias("cls"), F.col("x.doc_id").alias("copies_id"), "weight"), "classes")
    reps = table.join(classes.select(F.col("cls").alias("row"), "weight"), "row").filter("n > 0")
    groups = written(connected(candidates(reps, threshold)), "groups")
    size = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    dealt = groups.join(size, "comp").select(F.col("node").alias("row"), "comp", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    # a text of block i takes part in the comparisons (i, k) and (k, i) of all blocks k
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    task = F.xxhash64("comp", F.least("block", "k"), F.greatest("block", "k"))
    dealt = dealt.withColumn("task", task).withColumn("own", F.col("block") == F.least("block", "k")).withColumn("within", F.col("block") == F.col("k")).drop("block", "k")
    data = dealt.join(reps.select("row", "weight", "n", "signature"), "row").join(numbered.select("row", "text"), "row")
    dealt = data.repartition("task").sortWithinPartitions("task", "row").select("task", "comp", "blocks", "row", "own", "within", "weight", "n", "signature", "text")
    bars = least_matches(threshold)

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("jaccard_join")
        out: list[tuple] = []
        for _, rows in runs(frames, "task"):
            parts: dict[object, list] = {}
            for r in rows:  # tasks of different groups may share a hash
                parts.setdefault(r[1], []).append(r)
            for found in parts.values():
                texts = [(r[6], r[7], np.frombuffer(r[8], np.uint32), shingles(r[9])) for r in found]
                if all(r[5] for r in found):
                    order = found
                    total, comp = compare(texts, None, threshold, bars)
                else:
                    left = [i for i, r in enumerate(found) if r[4]]
                    right = [i for i, r in enumerate(found) if not r[4]]
                    order = [found[i] for i in left + right]
                    total, comp = compare([texts[i] for i in left], [texts[i] for i in right], threshold, bars)
                out += [(r[3], int(total[i]), order[comp[i]][3], r[2] > 1) for i, r in enumerate(order)]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["cls", "links", "root", "split"])
                out = []
        trim()
        yield pd.DataFrame(out, columns=["cls", "links", "root", "split"]).astype({"cls": "int64", "links": "int64", "root": "int64", "split": "bool"})

    found = written(dealt.mapInPandas(verify, "cls long, links long, root long, split boolean"), "links")
    spanning = found.filter("split and cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))
    joined = found.filter("not split").select("cls", F.col("root").alias("comp"))
    if spanning.head(1):
        joined = joined.union(connected(spanning, "spanning").select(F.col("node").alias("cls"), "comp"))
    per_class = classes.join(found.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left").join(joined, "cls", "left")
    per_class = written(per_class.withColumns({"links": F.coalesce("links", F.lit(0)), "comp": F.coalesce("comp", "cls")}), "per_class")
    best = per_class.groupBy("comp").agg(F.min(F.struct(F.col("copies_id").isNull().alias("none"), "copies_id", "cls")).alias("x"))
    named = per_class.join(best.select("comp", F.col("x.copies_id").alias("class_id"), F.col("x.cls").alias("first_row")), "comp")
    named = named.select("d1", "d2", "copies_id", "class_id", "first_row", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    return table.select("row", "doc_id", "d1", "d2").join(named, ["d1", "d2"]).select("row", "doc_id", "class_id", "copies_id", "n_links", (F.col("row") == F.col("first_row")).alias("first"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group: the least by (doc_id, place)."""
    keyed = placed(docs, ROW)
    kept = _links(keyed.select(F.col(ROW).alias("row"), "doc_id", "text"), threshold).filter("first").select(F.col("row").alias(ROW))
    return keyed.join(kept, ROW, "left_semi").drop(ROW)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(documents(spark, sf_dir)).select("doc_id", "class_id", "copies_id", "n_links")
