"""Very many phrases at once: an index of grams instead of every text against every phrase.

A phrase is sought by one of its grams of bytes, the one that is rarest in the texts, and so only the places of that gram travel:
grams that no phrase is sought by are left out where they stand, by a bit table of bounded size, and the others, with the few bytes
around them, meet the phrases by an equi-join on the gram, where the phrase itself is compared. Grams are as long as a phrase allows
(16, 8 or 4 bytes), as a long one is rare. Numpy hashes the grams of a batch at once, in the buffer that Arrow hands over.
Phrases of fewer than GRAM characters are not for this index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a phrase has at least; bytes of grams, the longest first.
GRAM, SIZES = 4, (16, 8, 4)
#: Most bits of the bit table, as a power of two (2 MB), its bits a gram, and bytes that are hashed at once.
BITS, SPARSE, PART = 24, 1024, 1 << 16
#: Bytes of texts that are looked at together; a longer one stands alone.
MOST = 1 << 22
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def hashed(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of each gram of so many bytes, by the byte it begins at."""
    n = max(0, len(data) - size + 1)
    if not n:
        return np.empty(0, np.uint64)
    word = lambda at: np.ndarray((n,), "<u4" if size == 4 else "<u8", data, at, (1,)).astype(np.uint64)
    h = word(0) * _K[0]
    if size == 16:
        h ^= h >> np.uint64(29)
        h += word(8) * _K[1]
    h += np.uint64(size)
    h ^= h >> np.uint64(31)
    h *= _K[2]
    return h


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in a bit table."""
    return h >> np.uint64(64 - bits), (h * _K[3]) >> np.uint64(64 - bits)


def _set(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


def able(data: np.ndarray, size: int, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams whose two bits are set."""
    places, hashes = [], []
    for begin in range(0, max(0, len(data) - size + 1), PART):
        h = hashed(data[begin : begin + PART + size - 1], size)
        at = np.flatnonzero(_set(table, h >> np.uint64(64 - bits)))
        at = at[_set(table, _slots(h[at], bits)[1])]
        places.append(at + begin)
        hashes.append(h[at])
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.empty(0, np.int64), np.empty(0, np.uint64))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, one text after the other, and where each begins; the end of the last, too. A null text is empty."""
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, "<i8" if pa.types.is_large_string(column.type) else "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), begins


def parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with MOST bytes of texts at most (or one text), with their bytes and where each begins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, begins = strings(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(begins, begins[first] + MOST, "right")) - 1)
            yield batch.slice(first, last - first), data[begins[first] : begins[last]], begins[first : last + 1] - begins[first]
            first = last


def found_in(data: np.ndarray, begins: np.ndarray, tables: dict[int, tuple[np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size of grams: row, place in all bytes and hash of those in the table that don't run over their text's end."""
    for size, (table, bits) in tables.items():
        at, h = able(data, size, table, bits)
        row = np.searchsorted(begins, at, "right") - 1
        whole = at + size <= begins[row + 1]
        yield row[whole], at[whole], h[whole]


def phrase_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of phrases: how many bytes and characters stand before them, their size and hash."""
    for batch in batches:
        rows = []
        for phrase in batch.column("phrase").to_pylist():
            data = np.frombuffer(phrase.encode(), np.uint8)
            size = next(s for s in SIZES if s <= len(data))
            before = np.cumsum((data & 0xC0) != 0x80) - ((data & 0xC0) != 0x80)
            rows += [(phrase, i, int(before[i]), size, h) for i, h in enumerate(hashed(data, size).view(np.int64).tolist())]
        names = {"phrase": pa.string(), "offset": pa.int32(), "chars": pa.int32(), "size": pa.int32(), "gram": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(names.values())], names=list(names))


def bit_tables(grams: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """By size of grams (size, gram, distinct) the bit table of theirs and its bits, as a power of two. The numbers that hold a table
    come to the driver, 2^18 at most."""
    out = {}
    for size, n in sorted((r["size"], r["count"]) for r in grams.groupBy("size").count().collect()):
        bits = min(BITS, max(10, (SPARSE * n).bit_length()))

        def places(batches: Iterator[pa.RecordBatch], bits: int = bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
                slots = np.concatenate(_slots(h, bits))
                bit = (np.uint64(1) << (slots & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int32)), pa.array(bit)], names=["place", "bit"])

        rows = grams.filter(F.col("size") == size).select("gram").mapInArrow(places, "place int, bit long")
        words = rows.groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[words["place"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        out[size] = table, bits
    return out


def counting(tables: dict[int, tuple[np.ndarray, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often texts have each gram of the tables, a row for each gram and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, begins in parts(batches, "text"):
            for _, _, h in found_in(data, begins, tables):
                grams, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return run


def placing(tables: dict[int, tuple[np.ndarray, int]], keep: list[str], longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places of grams of the tables: keep, gram, the characters of the text before it, the bytes around it, and how many of
    these stand before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, begins in parts(batches, "text"):
            row, at, h = (np.concatenate(x) for x in zip(*found_in(data, begins, tables), strict=True))
            if not len(at):
                continue
            before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            first, last = np.maximum(begins[row], at - longest), np.minimum(begins[row + 1], at + longest)
            around = pa.array([data[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())
            own = [batch.column(c).take(pa.array(row)) for c in keep]
            new = [pa.array(h.view(np.int64)), pa.array((before[at] - before[begins[row]]).astype(np.int32)), around, pa.array((at - first).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[*keep, "gram", "place", "around", "inner"])

    return run


def phrase_places(texts: DataFrame, phrases: DataFrame, keep: list[str]) -> DataFrame:
    """keep, phrase and at (from 1) for every place of every phrase. texts: keep and text; phrases: phrase, distinct, of GRAM
    characters or more (null and shorter ones are found nowhere). Overlapping places all count. Two passes over texts: one counts
    grams, so that each phrase is sought by its rarest one (a tie: the first); a gram that very many places have is of many
    rows on the streamed side, which adaptive execution splits. Without phrases nothing is read."""
    spark = texts.sparkSession
    own = phrases.select("phrase").filter(F.length("phrase") >= GRAM).distinct()
    inside = own.mapInArrow(phrase_grams, "phrase string, offset int, chars int, size int, gram long")
    kinds = {c: texts.schema[c].dataType.simpleString() for c in keep}
    tables = bit_tables(inside.select("size", "gram").distinct())
    if not tables:
        return spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", phrase string, at int")
    often = texts.select("text").mapInArrow(counting(tables), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    ranked = inside.join(often, "gram", "left").groupBy("phrase", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "chars", "gram")).alias("key"))
    sought = ranked.filter("key.n > 0").select("phrase", "size", "key.offset", "key.chars", "key.gram").persist()  # a row a phrase at most; it is what the second pass is planned by
    longest = own.agg(F.max(F.octet_length("phrase"))).first()[0]
    tables = bit_tables(sought.select("size", "gram").distinct())
    if not tables:
        return spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", phrase string, at int")
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", gram long, place int, around binary, inner int"
    rows = texts.select(*keep, "text").mapInArrow(placing(tables, keep, longest), schema)
    met = rows.join(sought, "gram").withColumn("at", F.col("place") - F.col("chars") + 1)
    begin = F.col("inner") - F.col("offset") + 1
    same = (begin >= 1) & (F.substring("around", begin, F.octet_length("phrase")) == F.encode("phrase", "UTF-8"))
    return met.filter(same).select(*keep, "phrase", "at")


def apart(found: DataFrame, keep: list[str]) -> DataFrame:
    """keep, phrase and n: places of phrase_places that don't overlap, counted from the first on."""
    step = lambda s, x: F.when(x >= s["free"], F.struct((s["n"] + 1).alias("n"), (x + F.length("phrase")).alias("free"))).otherwise(s)
    n = F.aggregate(F.array_sort("_at"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("free")), step)["n"]
    return found.groupBy(*keep, "phrase").agg(F.collect_list("at").alias("_at")).select(*keep, "phrase", n.cast("long").alias("n"))
