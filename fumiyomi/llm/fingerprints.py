"""Document fingerprints (op 4) by locally consistent parsing.

A text's bytes are parsed into phrases, those into longer phrases, and so on. On each level runs of one symbol become
one symbol (with its length); then neighbours differ, and deterministic coin tossing gives each symbol a label from the
lowest bit in which it differs from the one before it, repeated until labels are below six. Phrases begin at local minima
of the labels. A phrase's name is a hash of its symbols, so where phrases begin and what they are called depends on a
few symbols to the left and right only: equal substrings share their interior names wherever they stand.

The fingerprint holds, for the levels one to four, the least K of the names' hashes (bottom-k sketches). The likeness
of two fingerprints is the mean over the levels from two on of the Jaccard estimate of their sketches; where both have
fewer than three names on level two, the short phrases of level one are compared instead. A text too short for a level
has there the one name of the whole text. Null texts are empty; the fingerprint of an empty
text is the empty string, like only to itself. Equal texts have equal fingerprints.

The next document by descending id comes from buckets of ids between splitters. Only the first document of each later
bucket travels to the bucket before it. Equal ids are ordered by a hash of the text; rows without an id come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.common import begin, documents, trim

#: Names kept of each level, and the levels that are kept.
K, LEVELS = 24, (1, 2, 3, 4)
#: Characters that are parsed at once (a longer text alone), which bounds a worker's memory.
RUN_CHARS = 300_000
#: Documents between two splitters, about.
BUCKET = 4096
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit of each non-zero word."""
    return np.bitwise_count((x & (~x + x.dtype.type(1))) - x.dtype.type(1))


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six; neighbours within a text differ. first: where texts begin."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]  # differs in bit 0
    bit = _lowest_bit(x ^ before)
    label = (bit << 1) | ((x >> bit.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)
    for _ in range(3):  # 128 labels, then 14, then 8, then 6
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        d = label ^ before
        bit = np.bitwise_count((d & (~d + np.uint8(1))) - np.uint8(1))
        label = (bit << 1) | ((label >> bit) & 1)
    return label


def parse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of all texts, and where texts begin among them. Each text has a symbol at least."""
    n = len(x)
    head = np.ones(n, bool)
    head[1:] = x[1:] != x[:-1]
    head[first] = True
    at = np.flatnonzero(head)
    if len(at) < n:  # runs become one symbol
        run = np.diff(np.append(at, n))
        first = np.searchsorted(at, first)
        x = x[at]
        x = np.where(run > 1, mix(x.astype(np.uint64) + _M1 * run.astype(np.uint64)), x.astype(np.uint64)) if run.max() > 1 else x
        equal = x[1:] == x[:-1]  # within a text a named run can't equal its neighbour but by chance
        equal[first[1:] - 1] = False
        if equal.any():
            x = x.astype(np.uint64)
            x[1:][equal] = ~x[1:][equal]
        n = len(x)
    label = _toss(x, first)
    low = np.zeros(n, bool)
    low[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
    inside = np.ones(n, bool)
    inside[first] = False
    inside[np.append(first[1:], n) - 1] = False
    low &= inside
    low[first] = True
    start = np.flatnonzero(low)
    size = np.diff(np.append(start, n))
    # a polynomial of the mixed symbols, by their place in the phrase
    place = np.arange(n) - np.repeat(start, size)
    power = np.cumprod(np.full(int(size.max()), 0xD6E8FEB86659FD93 | 1, np.uint64))
    terms = mix(x.astype(np.uint64) + _M1) * power[place]
    return mix(np.add.reduceat(terms, start) + size.astype(np.uint64)), np.searchsorted(start, first)


def sketches(texts: list[bytes], k: int = K) -> list[list[np.ndarray]]:
    """For each text the least k names (32 bits, ascending) of each kept level; none for an empty text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    size = np.array([len(texts[i]) for i in full])
    first = np.cumsum(size) - size
    x: np.ndarray = np.frombuffer(b"".join(texts[i] for i in full), np.uint8)
    for level in range(1, max(LEVELS) + 1):
        x, first = parse(x, first)
        if level in LEVELS:
            names = (mix(x + np.uint64(level)) >> np.uint64(32)).astype(np.uint32)
            edge = np.append(first, len(x))
            for j, i in enumerate(full):
                own = names[edge[j] : edge[j + 1]]
                out[i].append(np.unique(own)[:k])
    return out


def written_out(sketch: list[np.ndarray]) -> str:
    """Levels parted by a dash; each name as eight hex digits."""
    return "-".join(level.astype(">u4").tobytes().hex() for level in sketch)


def read_in(fingerprint: str) -> list[np.ndarray]:
    return [np.frombuffer(bytes.fromhex(x), ">u4") for x in fingerprint.split("-")] if fingerprint else []


def _jaccard(a: np.ndarray, b: np.ndarray, k: int) -> float:
    union = sorted({*a.tolist(), *b.tolist()})[:k]
    both = set(a.tolist()) & set(b.tolist())
    return sum(x in both for x in union) / len(union)


def likeness(a: list[np.ndarray], b: list[np.ndarray], k: int = K) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if not a or not b:
        return float(not a and not b)
    levels = slice(1, None) if max(len(a[1]), len(b[1])) > 2 else slice(0, 1)
    return float(np.mean([_jaccard(x, y, k) for x, y in zip(a[levels], b[levels], strict=True)]))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs (doc_id, text)."""

    @F.pandas_udf("string")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([written_out(s) for s in sketches([(t or "").encode() for t in text])])

    return docs.select("doc_id", of("text").alias("fingerprint"))


def edited_text(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def beside_next(docs: DataFrame, bucket_rows: int = BUCKET) -> DataFrame:
    """docs (doc_id, text) dealt to partitions in which each row's next one by descending id follows it; own marks
    the rows that belong there, the others are guests: the first row of the next bucket, or the first of all."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = keyed.count()
    buckets = max(1, min(100_000, n // bucket_rows))
    edges = sorted(set(keyed.filter("doc_id is not null").approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets))) if buckets > 1 else []
    # bucket 0 has the largest ids; null ids come after all others
    if edges:
        table = F.array(*[F.lit(int(e)) for e in edges]) if len(edges) < 200 else None
        if table is not None:
            place = F.size(F.filter(table, lambda e: e < F.col("doc_id")))
        else:
            held = spark.sparkContext.broadcast(np.array(edges, np.int64))

            @F.pandas_udf("int")
            def between(ids: pd.Series) -> pd.Series:
                return pd.Series(np.searchsorted(held.value, ids.fillna(0).to_numpy(np.int64), "left").astype(np.int32))

            place = between("doc_id")
    else:
        place = F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(len(edges) - place).cast("int")
    keyed = keyed.withColumn("bucket", bucket)
    # the first row of each bucket: by id, then by the text's hash
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("text")]
    tops = keyed.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    tops = [(r["bucket"], r["top"]) for r in tops.orderBy("bucket").collect()]  # a row for each bucket
    if not tops:
        return keyed.select("bucket", "doc_id", "text", F.lit(True).alias("own"), F.lit(0).alias("hash"))
    ids = [t for _, t in tops if t is not None]
    heads = keyed.filter(F.col("doc_id").isin(ids)) if tops[-1][1] is not None or len(tops) > 1 else keyed.limit(0)
    if tops[-1][1] is None:
        heads = heads.union(keyed.filter("doc_id is null")) if tops[0][1] is not None else keyed
    heads = heads.withColumn("hash", F.xxhash64("text")).groupBy("bucket").agg(F.min_by(F.struct("doc_id", "text", "hash"), F.struct("hash", "text")).alias("x"))
    before = {b: tops[i - 1][0] for i, (b, _) in enumerate(tops)}
    turned = F.create_map(*[F.lit(int(v)) for kv in before.items() for v in kv])
    guests = heads.select(turned[F.col("bucket")].cast("int").alias("bucket"), F.col("x.doc_id"), F.col("x.text"), F.lit(False).alias("own"), F.col("x.hash"))
    dealt = keyed.select("bucket", "doc_id", "text", F.lit(True).alias("own"), F.xxhash64("text").alias("hash")).union(guests)
    return dealt.repartition(max(1, len(tops)), "bucket").sortWithinPartitions("bucket", F.col("own").desc(), *order)


def with_edits(docs: DataFrame, bucket_rows: int = BUCKET) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    dealt = beside_next(docs, bucket_rows).select("bucket", "doc_id", "text", "own")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        """Runs of rows of one bucket, each run but the last of a bucket overlapping the next one by a row."""
        run: list[tuple] = []
        size = 0
        for frame in frames:
            for r in zip(frame["bucket"], frame["doc_id"], frame["text"], frame["own"], strict=True):
                if run and r[0] != run[-1][0]:
                    yield run
                    run, size = [], 0
                run.append(r)
                size += len(r[2])
                if size > RUN_CHARS and len(run) > 1:
                    yield run
                    run, size = [r], len(r[2])
        if run:
            yield run

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("fingerprints")
        for n, run in enumerate(rows(frames)):
            if n % 16 == 15:
                trim()
            # the guest is last in its bucket; the last row of a run is known from the next run again
            pairs = [(run[i], run[i + 1]) for i in range(len(run) - 1) if run[i][3]]
            if not pairs:
                continue
            edits = [edited_text(a[2], b[2]) for a, b in pairs]
            raw = [r[2].encode() for r in run]
            changed = [e.encode() for e in edits]
            found = sketches(raw + changed)
            own, other = found[: len(run)], found[len(run) :]
            kept = [i for i in range(len(run) - 1) if run[i][3]]
            yield pd.DataFrame({
                "doc_id": pd.array([None if pd.isna(a[1]) else int(a[1]) for a, _ in pairs], "Int64"),
                "n_chars": [len(a[2]) for a, _ in pairs],
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in changed],
                "fingerprint": [written_out(own[i]) for i in kept],
                "edited_fingerprint": [written_out(o) for o in other],
                "near_edited": [likeness(own[i], o) for i, o in zip(kept, other, strict=True)],
                "near_next": [likeness(own[i], own[i + 1]) for i in kept],
            })
        trim()

    return dealt.mapInPandas(mark, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir))
