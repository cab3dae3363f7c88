"""Suffix-array deduplication (op 3): removes bytes that a string of SPAN bytes covers which an earlier document has too.

Only suffixes that begin at anchors are sorted. Anchors are the places whose leading KGRAM bytes have the least hash within
some window of SPAN bytes (all such places, if several tie); they depend on the window alone, so equal strings of SPAN bytes
have equal anchors. Three steps:

1. A k-gram that one document alone has can't take part in a match. Each group of documents sends the different hashes of
   its anchors to hash buckets, as differences, and learns which of them another document has, too.
2. The suffixes of those, with as many bytes before them as a match may reach back, are dealt to ranges of their leading bytes
   between splitters, which a bounded sample of the suffixes gives; each range sorts them by multikey quicksort. Common prefixes
   of neighbours, to the right and (sorted by the bytes before) to the left, give for each split of SPAN bytes around the k-gram
   the classes of equal strings; all members but those of the least document are covered. Suffixes of one group of documents
   with equal bytes on both sides are settled before they travel.
3. Covered ranges meet their document's text.

Across boundaries: a range border never parts suffixes that must be compared. Suffixes of a k-gram stay together, as long as
it isn't hot (more of them in the sample than a range should hold). A hot k-gram's suffixes are parted by HALF bytes after it,
too, and compared there in the strings that have at least HALF bytes to the right; and they travel a second time, parted by HALF
bytes before the k-gram, where the strings that have at least HALF bytes to the left are compared. Every string of SPAN
bytes is of one of these kinds. What remains in one task is a string of KGRAM + HALF bytes in different surroundings, once for each
group of documents and surroundings.

Documents are ordered by doc_id; those without one are after all others and not before one another, as are equal ids. Strings
are judged on the input. Null texts are empty. Texts shorter than SPAN bytes lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.chunks import LAST_ID, chunks, edges, group_bits, joined, numbered, opened, packed, runs, runs_of, steps, unpacked, unstepped
from fumiyomi.llm.common import begin, documents, dropped, free, placed, trim, written
from fumiyomi.llm.fingerprints import mix

SPAN, KGRAM = 50, 20
REACH = SPAN - KGRAM  # bytes that a match may have on either side of the k-gram
HALF = REACH // 2
WINDOW = SPAN - KGRAM + 1
WIDTH = SPAN + REACH
#: Bytes whose anchors are found at once, and bytes of a group that ask at once.
SLICE, ASKED = 500_000, 32_000_000
#: Bytes of text for each hash bucket; suffixes of a range, and ranges that have splitters (more are dealt on within them).
BUCKET_BYTES, RANGE, RANGES = 48_000_000, 150_000, 8192
#: Documents sampled for splitters.
SAMPLE = 2000
LOW = 40
_LOW = np.uint64((1 << LOW) - 1)


def anchors(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in joined texts, and the hashes of their k-grams. No window crosses from one text to another."""
    able = size >= SPAN
    lo, hi = first[able], first[able] + size[able] - SPAN + 1  # where windows begin
    parts = []
    for a in range(0, len(raw), SLICE):  # the windows around a place are all that decides on it
        u, v = max(0, a - SPAN), min(len(raw), a + SLICE + SPAN)
        i, j = np.searchsorted(hi, u, "right"), np.searchsorted(lo, v, "left")
        if i < j and v - u >= SPAN:
            at, h = _anchors(raw[u:v], np.maximum(lo[i:j], u) - u, np.minimum(hi[i:j], v - SPAN + 1) - u)
            own = (at >= a - u) & (at < a + SLICE - u)
            parts.append((at[own] + u, h[own]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _anchors(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the windows that begin from lo to before hi."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.ndarray(n, "<u8", padded.data, strides=(1,))
    m = n - KGRAM + 1
    h = mix(word[:m] * np.uint64(0x9E3779B97F4A7C15) + word[8 : 8 + m] * np.uint64(0xC2B2AE3D27D4EB4F) + word[12 : 12 + m] * np.uint64(0x165667B19E3779F9))
    key = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def slide(x: np.ndarray, op) -> np.ndarray:
        """op over WINDOW neighbours from each place on."""
        w, y = 1, x
        while 2 * w <= WINDOW:
            y = op(y[:-w], y[w:])
            w *= 2
        return op(y[: len(x) - WINDOW + 1], y[WINDOW - w :][: len(x) - WINDOW + 1])

    least = slide(key, np.minimum)  # for each window of SPAN bytes
    valid = np.zeros(n + 1, np.int32)
    some = lo < hi
    np.add.at(valid, lo[some], 1)
    np.add.at(valid, hi[some], -1)
    least[np.cumsum(valid)[: len(least)] == 0] = 0
    edge = np.zeros(WINDOW - 1, np.uint32)
    most = slide(np.concatenate([edge, least, edge]), np.maximum)[:m]
    at = np.flatnonzero(most == key)
    return at, h[at]


def coded(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hash bucket and low bits of a hash in one number."""
    return ((h >> np.uint64(LOW)) % np.uint64(buckets)) << np.uint64(LOW) | (h & _LOW)


def asked(docs: DataFrame, bits: int, buckets: int) -> DataFrame:
    """For each group and bucket the different anchor hashes, ascending: those of one document, and those that several have."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("suffix_dedup")
        for group, _, ids, texts in runs_of(frames, bits, 1 << 62, ASKED):
            raw, first, size = joined(texts)
            at, h = anchors(raw, first, size)
            code = coded(h, buckets)
            order = np.argsort(code, kind="stable")
            code, who = code[order], np.array(ids, np.int64)[np.searchsorted(first, at, "right") - 1][order]
            edge = edges(code)
            many = np.minimum.reduceat(who, edge) != np.maximum.reduceat(who, edge) if len(edge) else np.zeros(0, bool)
            code = code[edge]
            bucket, low = (code >> np.uint64(LOW)).astype(np.int64), code & _LOW
            out = [(int(bucket[a]), group, steps(low[a:b][~many[a:b]]), steps(low[a:b][many[a:b]])) for a, b in runs(bucket)]
            del raw, at, h, order, who
            yield pd.DataFrame(out, columns=["bucket", "group", "one", "many"])
        trim()

    return docs.mapInPandas(run, "bucket int, group long, one binary, many binary")


def repeated(asking: DataFrame) -> DataFrame:
    """group, bucket and hashes: those of the group's k-grams in this bucket that another document has, too."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unstepped(bytes(x)) for c in ("one", "many") for x in frame[c]]
        key = np.concatenate(parts)
        if not len(key):
            return pd.DataFrame([], columns=["group", "bucket", "hashes"])
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(key, kind="stable")
        edge = edges(key[order])
        size = np.diff(np.append(edge, len(key)))
        known = (size > 1) | np.logical_or.reduceat(part[order] >= len(frame), edge)
        hit = np.zeros(len(key), bool)
        hit[order] = np.repeat(known, size)
        groups = np.tile(frame["group"].to_numpy(np.int64), 2)
        cut = np.append(0, np.cumsum([len(p) for p in parts]))
        out = [(g, int(frame["bucket"].iloc[0]), steps(p[x])) for g, p, a in zip(groups.tolist(), parts, cut[:-1].tolist(), strict=True) if (x := hit[a : a + len(p)]).any()]
        return pd.DataFrame(out, columns=["group", "bucket", "hashes"])

    return asking.groupBy("bucket").applyInPandas(run, "group long, bucket int, hashes binary")


def multikey(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their words, most significant first, by multikey quicksort: each segment of rows that tie so far is parted
    three ways by a pivot of its next word; the equal part goes on with the word after it. A round parts all segments at once."""
    keys = np.stack(words, 1)
    n, depth = keys.shape
    flat = keys.ravel()
    order = np.arange(n)
    some = int(n > 1)
    lo, size, level = np.zeros(some, np.int64), np.full(some, n, np.int64), np.zeros(some, np.int64)
    while len(lo):
        begin_ = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(lo)), size)
        place = np.arange(len(segment)) + np.repeat(lo - begin_, size)
        rows = order[place]
        word = flat[rows * depth + level[segment]]
        a, b, c = word[begin_], word[begin_ + size // 2], word[begin_ + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
        side = segment * 3 + (word >= pivot) + (word > pivot)
        count = np.bincount(side, minlength=3 * len(lo))
        to = np.empty(len(rows), np.int64)
        for k in range(3):  # places of each side, one after another
            at = np.flatnonzero(side - segment * 3 == k)
            own = count[k::3]
            start = begin_ + (count[0::3] if k else 0) + (count[1::3] if k > 1 else 0)
            to[at] = np.arange(len(at)) + np.repeat(start - (np.cumsum(own) - own), own)
        order[place[to]] = rows
        lo = np.stack([lo, lo + count[0::3], lo + count[0::3] + count[1::3]], 1).ravel()
        level = np.stack([level, level + 1, level], 1).ravel()
        live = (count > 1) & (level < depth)
        lo, size, level = lo[live], count[live], level[live]
    return order


def _words(x: np.ndarray) -> list[np.ndarray]:
    """Columns of eight bytes, big-endian, that sort as the bytes do."""
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, : x.shape[1]] = x
    return list(np.ascontiguousarray(wide).view(">u8").astype(np.uint64).T)


def _common_prefix(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in this order has in common with the one before it."""
    out = np.zeros(len(order), np.int16)
    for lo in range(1, len(order), 50_000):
        hi = min(len(order), lo + 50_000)
        differ = x[order[lo:hi]] != x[order[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    return out


def covered(context: np.ndarray, before: np.ndarray, after: np.ndarray, ids: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes of one bucket (REACH bytes before the k-gram, the k-gram, REACH bytes after; before and after: how many
    of them the document has; least and most: with how many bytes before the k-gram strings are compared here) how far a
    match with an earlier document reaches to the left and right of the k-gram; -1: none."""
    n = len(ids)
    left, right = np.full(n, -1, np.int8), np.full(n, -1, np.int8)
    forward = np.ascontiguousarray(context[:, REACH:])
    order = multikey(_words(forward))
    common = _common_prefix(forward, order)
    gram = np.empty(n, np.int32)
    gram[order] = np.cumsum(common < KGRAM)
    back = np.ascontiguousarray(context[:, REACH - 1 :: -1][:, :REACH])
    order_back = multikey([gram.astype(np.uint64), *_words(back)])
    common_back = _common_prefix(back, order_back)
    common_back[1:][gram[order_back[1:]] != gram[order_back[:-1]]] = -1
    common_back[0] = -1
    by_right, by_left = np.empty(n, np.int32), np.empty(n, np.int32)
    for o in range(REACH + 1):  # SPAN bytes from o before the k-gram on
        r = REACH - o
        at = np.flatnonzero((before >= o) & (after >= r) & (least <= o) & (o <= most))
        if len(at) < 2:
            continue
        by_right[order] = np.cumsum(common < KGRAM + r)
        by_left[order_back] = np.cumsum(common_back < o)
        key = by_left[at].astype(np.int64) * (n + 1) + by_right[at]
        inner = np.argsort(key, kind="stable")
        at, key = at[inner], key[inner]
        edge = edges(key)
        first = np.repeat(np.minimum.reduceat(ids[at], edge), np.diff(np.append(edge, len(key))))
        hit = at[ids[at] > first]
        left[hit] = np.maximum(left[hit], o)
        right[hit] = np.maximum(right[hit], r)
    return left, right


_RECORD = np.dtype([("context", np.uint8, WIDTH), ("before", np.uint8), ("after", np.uint8), ("id", "<i8"), ("row", "<i8"), ("at", "<i4")])
_RANGE = np.dtype([("row", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
_SENT = "side int, bucket int, context binary, ids binary, rows binary, at binary, settled binary"


def known(frame: pd.DataFrame) -> np.ndarray:
    """A group's codes that repeat, ascending."""
    parts = [np.uint64(int(b) << LOW) | unstepped(bytes(h)) for b, h in zip(frame["bucket"], frame["hashes"], strict=True)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def records(rows: np.ndarray, ids: np.ndarray, size: np.ndarray, raw: np.ndarray, buckets: int, repeat: np.ndarray) -> np.ndarray:
    """The suffixes of a chunk whose k-gram repeats."""
    first = np.cumsum(size) - size
    at, h = anchors(raw, first, size)
    code = coded(h, buckets)
    place = np.searchsorted(repeat, code)
    stay = np.zeros(len(code), bool)
    stay[place < len(repeat)] = repeat[place[place < len(repeat)]] == code[place < len(repeat)]
    at = at[stay]
    owner = np.searchsorted(first, at, "right") - 1
    padded = np.concatenate([np.zeros(REACH, np.uint8), raw, np.zeros(SPAN, np.uint8)])
    record = np.zeros(len(at), _RECORD)
    record["context"] = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    inside = at - first[owner]
    record["before"] = np.minimum(inside, REACH)
    record["after"] = np.minimum(size[owner] - inside - KGRAM, REACH)
    record["id"], record["row"], record["at"] = ids[owner], rows[owner], inside
    return record


def settled(record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a group that must travel, and covered ranges: of suffixes with equal bytes on both sides only the least document's travels."""
    full = np.flatnonzero((record["before"] == REACH) & (record["after"] == REACH))
    if len(full) < 2:
        return record, np.zeros(0, _RANGE)
    context = np.ascontiguousarray(record["context"][full])
    h = np.zeros(len(full), np.uint64)
    for word in context.view("<u8").T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word)
    inner = np.argsort(h, kind="stable")
    same = (h[inner[1:]] == h[inner[:-1]]) & (context[inner[1:]] == context[inner[:-1]]).all(1)
    order, edge = full[inner], np.flatnonzero(np.append(True, ~same))
    least = np.repeat(np.minimum.reduceat(record["id"][order], edge), np.diff(np.append(edge, len(order))))
    done = order[record["id"][order] > least]
    out = np.zeros(len(done), _RANGE)
    out["row"], out["lo"], out["hi"] = record["row"][done], record["at"][done] - REACH, record["at"][done] + SPAN
    return np.delete(record, done), out


def suffixes(found: DataFrame, replies: DataFrame, bits: int, buckets: int, splitters: np.ndarray, hot: np.ndarray, spread: int, back: int) -> DataFrame:
    """Suffixes whose k-gram repeats, by range of their leading bytes; hot ones also by the bytes before them, to so many
    buckets (back); and ranges that the group itself settles."""
    held = found.sparkSession.sparkContext.broadcast((splitters, hot))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        begin("suffix_dedup")
        names = [c.split()[0] for c in _SENT.split(", ")]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=names)
        splitters, hot = held.value
        repeat = known(right)
        record = np.concatenate([records(*opened(bytes(b)), buckets, repeat) for b in left["blob"]])
        record, done = settled(record)
        lead = np.zeros((len(record), SPAN), np.uint8)
        lead[:, :KGRAM] = record["context"][:, REACH : REACH + KGRAM]
        warm = np.isin(np.ascontiguousarray(lead[:, :KGRAM]).view(f"S{KGRAM}").ravel(), hot) if len(hot) else np.zeros(len(record), bool)
        lead[warm, KGRAM : KGRAM + HALF] = record["context"][warm, REACH + KGRAM : REACH + KGRAM + HALF]
        pack = zstandard.ZstdCompressor(level=3)
        out = []
        if len(done):
            out.append((0, int(left["group"].iloc[0] % 1009), None, None, None, None, pack.compress(done.tobytes())))

        def send(side: int, bucket: np.ndarray, own: np.ndarray) -> None:
            order = np.argsort(bucket, kind="stable")
            bucket, own = bucket[order], own[order]
            for a, b in runs(bucket):
                r = own[a:b]
                flags = np.concatenate([r["context"].ravel(), r["before"], r["after"]])
                out.append((side, int(bucket[a]), pack.compress(flags.tobytes()), packed(r["id"].astype(np.uint64)), packed(r["row"]), packed(r["at"]), None))

        send(0, (np.searchsorted(splitters, lead.view(f"S{SPAN}").ravel(), "right") if len(splitters) else np.zeros(len(lead), np.int64)) * spread + _dealt(lead, spread), record)
        if warm.any():
            near = np.ascontiguousarray(record["context"][warm, REACH - HALF : REACH + KGRAM])
            send(1, _dealt(near, back), record[warm])
        return pd.DataFrame(out, columns=names)

    return found.groupBy("group").cogroup(replies.groupBy("group")).applyInPandas(run, _SENT)


def _dealt(x: np.ndarray, n: int) -> np.ndarray:
    """A number below n by a hash of each row's bytes."""
    h = np.zeros(len(x), np.uint64)
    if n > 1:
        for word in _words(x):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word)
    return ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _all(blobs, kind: np.dtype) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(unpack.decompress(bytes(b)) for b in blobs if b), kind)


def _received(frame: pd.DataFrame) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    out = [np.zeros(0, _RECORD)]
    for context, ids, rows, at in zip(frame["context"], frame["ids"], frame["rows"], frame["at"], strict=True):
        if context is not None:
            raw = np.frombuffer(unpack.decompress(bytes(context)), np.uint8)
            r = np.zeros(len(raw) // (WIDTH + 2), _RECORD)
            r["context"] = raw[: WIDTH * len(r)].reshape(-1, WIDTH)
            r["before"], r["after"] = raw[WIDTH * len(r) :].reshape(2, -1)
            r["id"], r["row"], r["at"] = unpacked(bytes(ids)).astype(np.int64), unpacked(bytes(rows)).astype(np.int64), unpacked(bytes(at)).astype(np.int32)
            out.append(r)
    return np.concatenate(out)


def ranges(dealt: DataFrame, bits: int, hot: np.ndarray) -> DataFrame:
    """group and covered ranges of its documents (packed records of row, from, to)."""
    held = dealt.sparkSession.sparkContext.broadcast(hot)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        record = _received(frame)
        out = [_all(frame["settled"], _RANGE)]
        if len(record) > 1:
            least, most = np.zeros(len(record), np.int8), np.full(len(record), REACH, np.int8)
            if frame["side"].iloc[0]:
                least[:] = HALF
            elif len(held.value):
                most[np.isin(np.ascontiguousarray(record["context"][:, REACH : REACH + KGRAM]).view(f"S{KGRAM}").ravel(), held.value)] = HALF
            left, right = covered(record["context"], record["before"], record["after"], record["id"], least, most)
            hit = left >= 0
            own = np.zeros(int(hit.sum()), _RANGE)
            own["row"] = record["row"][hit]
            own["lo"] = record["at"][hit] - left[hit].astype(np.int32)
            own["hi"] = record["at"][hit] + KGRAM + right[hit].astype(np.int32)
            out.append(own)
        found = np.concatenate(out)
        del record, out
        trim()
        found = found[np.argsort(found["row"], kind="stable")]
        group = found["row"] >> bits
        pack = zstandard.ZstdCompressor(level=3)
        return pd.DataFrame({"group": group[edges(group)], "ranges": [pack.compress(found[a:b].tobytes()) for a, b in runs(group)]})

    return dealt.groupBy("side", "bucket").applyInPandas(run, "group long, ranges binary")


def sampled(base: DataFrame, replies: DataFrame, n: int, bits: int, buckets: int) -> tuple[np.ndarray, float]:
    """The leading SPAN bytes of the suffixes that a bounded sample of documents sends, sorted, and how many suffixes of the
    table one of them stands for."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lead: list[bytes] = []
        if len(left) and len(right):
            repeat = known(right)
            for b in left["blob"]:
                own = settled(records(*opened(bytes(b)), buckets, repeat))[0]["context"][:, REACH:]
                lead += [x.tobytes() for x in own]
        return pd.DataFrame([(b"".join(lead),)] if lead else [], columns=["lead"], dtype=object)

    share = min(1.0, SAMPLE / max(n, 1))
    few = chunks(base.sample(share, seed=11).limit(2 * SAMPLE), bits)
    found = few.groupBy("group").cogroup(replies.join(F.broadcast(few.select("group").distinct()), "group", "left_semi").groupBy("group")).applyInPandas(run, "lead binary").collect()
    return np.sort(np.frombuffer(b"".join(bytes(r["lead"]) for r in found), f"S{SPAN}")), 1 / share


def chunk_ranges(base: DataFrame, bits: int, size: int) -> DataFrame:
    """group and ranges (packed records) of the groups of base (row, id, text) that lose bytes, as a written table."""
    buckets = max(4, -(-size // BUCKET_BYTES))
    replies = written(repeated(asked(base, bits, buckets)), "repeated")
    free(base)
    lead, stands = sampled(base, replies, base.count(), bits, buckets)
    gram, count = np.unique(np.ascontiguousarray(lead).astype(f"S{KGRAM}"), return_counts=True)
    parts = max(1, int(len(lead) * stands / RANGE))
    # as hot counts what would fill half a range, but nothing that the sample saw less than eight times
    hot = gram[(count * stands > RANGE / 2) & (count >= 8)]
    many = min(parts, RANGES)
    splitters = np.unique(lead[np.linspace(0, len(lead) - 1, many + 1).astype(int)[1:-1]]) if many > 1 else lead[:0]
    back = max(1, int(count[np.isin(gram, hot)].sum() * stands / RANGE))
    dealt = suffixes(chunks(base, bits), replies, bits, buckets, splitters, hot, -(-parts // many), back)
    found = written(ranges(dealt, bits, hot), "ranges")
    dropped(base.sparkSession, replies)
    free(base)
    return found


def merged(blobs) -> dict[int, list[tuple[int, int]]]:
    """Maximal runs of covered bytes, by row."""
    found = _all(blobs, _RANGE)
    found = found[np.lexsort((found["lo"], found["row"]))]
    out = {}
    for a, b in runs(found["row"]):
        lo, reach = found["lo"][a:b], np.maximum.accumulate(found["hi"][a:b])
        begin_ = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
        out[int(found["row"][a])] = list(zip(lo[begin_].tolist(), reach[np.append(begin_[1:], b - a) - 1].tolist(), strict=True))
    return out


def covered_ranges(base: DataFrame) -> DataFrame:
    """row and spans (array of from, to in bytes) of the documents of base (row, id, text) that lose bytes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = merged(frame["ranges"])
        return pd.DataFrame({"row": list(own), "spans": [[{"lo": a, "hi": b} for a, b in x] for x in own.values()]})

    return chunk_ranges(base, *group_bits(base)).groupBy("group").applyInPandas(run, "row long, spans array<struct<lo:int,hi:int>>")


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(hi for _, hi in spans)]
    starts_ = [*(lo for lo, _ in spans), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends, starts_, strict=True))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    base = numbered(docs)
    bits, size = group_bits(base)
    found = chunk_ranges(base, bits, size)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        begin("suffix_dedup")
        spans, out = merged(right["ranges"]), []
        for blob in left["blob"]:
            rows, ids, size, joined_ = opened(bytes(blob))
            raw, first = joined_.tobytes(), np.cumsum(size) - size
            for row, i, n, a in zip(rows.tolist(), ids.tolist(), size.tolist(), first.tolist(), strict=True):
                own = spans.get(row, [])
                kept = cut_out(raw[a : a + n], own)
                out.append((None if i == LAST_ID else i, n, n - len(kept), len(own), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    both = chunks(base, bits).groupBy("group").cogroup(found.groupBy("group"))
    return both.applyInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with covered bytes cut out of text (parts of characters left at an edge are dropped); all rows and columns stay."""
    keyed = placed(docs, "_place")
    base = keyed.select(F.col("_place").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID))).alias("id"), F.col("text").cast("binary").alias("text"))
    found = written(covered_ranges(base), "spans").withColumnsRenamed({"row": "_place", "spans": "_spans"})

    @F.pandas_udf("string")
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or x is None else cut_out(t.encode(), [(s["lo"], s["hi"]) for s in x]).decode("utf-8", "ignore") for t, x in zip(text, spans, strict=True)], dtype=object)

    return keyed.join(found, "_place", "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(rest("text", "_spans"))).drop("_place", "_spans")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
