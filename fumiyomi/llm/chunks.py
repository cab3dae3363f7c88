"""Documents that follow each other in a file, as compressed rows: texts travel so in half the space, without a sort of rows.

Rows are numbered by file and place (common.placed). A group is the documents whose numbers agree but for their last bits;
how many bits, group_bits says, so a group has about GROUP_BYTES of text. A group's documents come in some chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumiyomi.llm.common import placed

#: Documents and bytes of a chunk (one longer text makes a chunk of its own).
CHUNK_DOCS, CHUNK_BYTES = 256, 8_000_000
#: Bytes of text of a group, about, and the most bits of its documents' places.
GROUP_BYTES, GROUP_BITS = 16_000_000, 12
#: Stands for a null id: after all others.
LAST_ID = np.iinfo(np.int64).max


def numbered(docs: DataFrame) -> DataFrame:
    """row, id and text (bytes)."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID))).alias("_id")
    own = placed(docs, "_row")
    return own.select(F.col("_row").alias("row"), id_.alias("id"), F.col("text").cast("binary").alias("text"))


def group_bits(docs: DataFrame) -> tuple[int, int]:
    """Bits of a place within a group, and the bytes of all texts: long documents make groups of fewer."""
    about = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    size = int(about["bytes"] or 0)
    return max(0, min(GROUP_BITS, int(math.log2(max(1.0, GROUP_BYTES * (about["n"] or 1) / max(size, 1)))))), size


def joined(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and where each text begins and how long it is."""
    size = np.array([len(t) if t is not None else 0 for t in texts], np.int64)
    return np.frombuffer(b"".join(bytes(t) for t in texts if t is not None), np.uint8), np.cumsum(size) - size, size


def runs_of(frames: Iterator[pd.DataFrame], bits: int, docs: int, most: int) -> Iterator[tuple[int, list[int], list[int], list]]:
    """Consecutive rows of one group, so many and of so many bytes at most: the group, rows, ids and texts."""
    rows: list[int] = []
    ids: list[int] = []
    texts: list = []
    held = 0
    for frame in frames:
        for row, i, text in zip(frame["row"].tolist(), frame["id"].tolist(), frame["text"], strict=True):
            if rows and (row >> bits != rows[0] >> bits or len(rows) >= docs or held >= most):
                yield rows[0] >> bits, rows, ids, texts
                rows, ids, texts, held = [], [], [], 0
            rows.append(row)
            ids.append(i)
            texts.append(text)
            held += len(text) if text is not None else 0
    if rows:
        yield rows[0] >> bits, rows, ids, texts


def chunks(docs: DataFrame, bits: int) -> DataFrame:
    """group and blob: documents (row, id, text) that follow each other, as one compressed row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for group, rows, ids, texts in runs_of(frames, bits, CHUNK_DOCS, CHUNK_BYTES):
            raw, _, size = joined(texts)
            parts = [np.array([len(rows)], np.int64), np.array(rows, np.int64), np.array(ids, np.int64), size, raw]
            yield pd.DataFrame({"group": [group], "blob": [pack.compress(b"".join(x.tobytes() for x in parts))]})

    return docs.mapInPandas(run, "group long, blob binary")


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids, sizes and joined bytes of a chunk."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    rows, ids, size = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * k) for k in range(3))
    return rows, ids, size, np.frombuffer(raw, np.uint8, -1, 8 + 24 * n)


# ---- numbers as compressed bytes


def packed(x: np.ndarray) -> bytes:
    """Numbers that aren't negative as planes of bytes, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    wide = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(raw[1:])), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(np.uint64).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unstepped(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """From and to of runs of equal values."""
    found = edges(x).tolist()
    return list(zip(found, found[1:] + [len(x)], strict=True)) if found else []
