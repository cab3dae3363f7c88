"""What the operators of this package share: reading inputs, words, held-out rows and shared folders."""

from __future__ import annotations

import ctypes
import gc
import re
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what ASCII white space parts.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The columns of documents, in their order.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is divisible by five; rows without an id are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that the driver and all executors share; sets one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/fumiyomi-checkpoints"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cuts lineage: df as a table in the shared folder, read again with its schema."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(docs: DataFrame) -> None:
    """Shuffle files that nothing refers to any more leave the disk when the driver's JVM collects; the query that ran last
    is still referred to, so a small one runs first."""
    spark = docs.sparkSession
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)  # the cleaner works beside us


#: Files whose numbers are broadcast (16 bytes each); more are joined.
FILES = 1_000_000


def placed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of its rows' numbers: the file's number and the place in it, so a row has the same one however
    often and in whatever pieces the files are read. docs is a read of Parquet files, filtered or projected at most;
    what has no places in files is written to the shared folder first. Numbers don't follow any order between files."""
    try:
        at = docs.metadataColumn("_metadata")
        own = docs.select("*", F.xxhash64(at["file_path"]).alias(f"{name}_file"), at["row_index"].alias(f"{name}_at"))
    except AnalysisException:  # not a read of files, or of files without places
        return placed(written(docs, "rows"), name)
    files = sorted(r[0] for r in own.select(f"{name}_file").distinct().collect())  # one number a file, of those the driver lists to read them
    if len(files) < 2:
        return own.withColumn(name, F.col(f"{name}_at").cast("long")).drop(f"{name}_file", f"{name}_at")
    table = docs.sparkSession.createDataFrame(pd.DataFrame({f"{name}_file": files, f"{name}_number": range(len(files))}), f"{name}_file long, {name}_number long")
    own = own.join(F.broadcast(table) if len(files) <= FILES else table, f"{name}_file")
    return own.withColumn(name, F.shiftleft(f"{name}_number", 40) + F.col(f"{name}_at")).drop(f"{name}_file", f"{name}_at", f"{name}_number")


def starts(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs of these lengths, the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def by_bytes(frames: Iterator[pd.DataFrame], column: str, most: int) -> Iterator[pd.DataFrame]:
    """Cuts frames so that the texts of each have at most so many bytes, by the column n_bytes, or else characters (one longer text stands alone)."""
    for frame in frames:
        size = (frame["n_bytes"] if "n_bytes" in frame.columns else frame[column].str.len()).fillna(0).to_numpy(np.int64)
        begin, total = 0, 0
        for i, n in enumerate(size):
            if total and total + n > most:
                yield frame.iloc[begin:i]
                begin, total = i, 0
            total += int(n)
        if begin < len(frame):
            yield frame.iloc[begin:]


def map_texts(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 4_000_000, owner: str = "") -> DataFrame:
    """Applies fn to frames of bounded text size, within the partitions df has. owner: the operator whose caches fn uses."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin(owner)
        for part in by_bytes(frames, "text", most):
            yield fn(part)
        trim()

    return df.mapInPandas(run, schema)


_caches: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def cached(name: str, clear: Callable[[], None]) -> None:
    """Tells how an operator's caches in a worker process are emptied."""
    _caches[name] = clear


def begin(name: str) -> None:
    """An operator's task begins in this worker: the caches of others go, as a worker outlives the tasks of a stage."""
    if _owner[0] != name:
        for other, clear in _caches.items():
            if other != name:
                clear()
        _owner[0] = name
        trim()


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Memo(dict):
    """A bounded dictionary: emptied when full, so a worker's memory has a limit whatever the vocabulary."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def room(self, n: int) -> None:
        if len(self) + n > self.most:
            self.clear()


def runs(frames: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive rows with the same key, over the borders of frames: the key, and the rows as tuples of all columns."""
    held: list[tuple] = []
    last = None
    for frame in frames:
        k = list(frame.columns).index(key)
        for row in zip(*(frame[c].tolist() for c in frame.columns), strict=True):
            if held and row[k] != last:
                yield last, held
                held = []
            last = row[k]
            held.append(row)
    if held:
        yield last, held


def connected(edges: DataFrame, kind: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b: long, a <> b): node and comp, its least node, for each node of an edge.

    Alternates the large-star and small-star steps: minima by key are partial sums, joins split hot keys, and each step's
    edges are a table in the shared folder. Nothing but two numbers a round comes to the driver."""

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), kind)
    state = None
    while True:
        sides = both(now)  # large star: larger neighbours go to the least of the neighbourhood
        m = least(sides).withColumn("m", F.least("u", "m"))
        large = sides.join(m, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.filter("a <> b"), kind)
        m = large.groupBy("a").agg(F.min("b").alias("m"))  # small star: smaller neighbours and the node go to the least of them
        small = large.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = written(small.union(m.select("a", F.col("m").alias("b"))).distinct(), kind)
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (r["n"], r["h"]):
            break
        state = (r["n"], r["h"])
    comp = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return comp.union(comp.select(F.col("comp").alias("node"), "comp").distinct())
