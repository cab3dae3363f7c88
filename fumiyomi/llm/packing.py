"""Best-fit packing (op 6): documents become token pieces, and a swap-based local search packs them into sequences.

A document's tokens end with one separator. Longer documents than a sequence are cut into full pieces, the first of
which may be shorter; only the shorter one is left to place. Documents are dealt by hash to shards of bounded size,
each packed in one task: best fit by decreasing length, then local search: from the emptiest bins on, documents move to
another underfull bin, or are exchanged one for one or two for one, wherever the sum of squared fills grows, until
bins are empty. All underfull bins and all their documents take part, and the search goes on until it meets the lower bound or
no step is left; a bin from which no step led is only held against bins that have changed since.

Null texts are empty: a piece of the separator alone. Repeated rows are packed each; of equal lengths the first in
the shard's order goes first. Other columns than id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.bpe import byte_alphabet
from fumiyomi.llm.common import begin, by_bytes, cached, documents

CAPACITY = 2048
#: Documents that a shard holds, about.
SHARD = 8192


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Text to ids (uint32). The vocabulary is that of a tokenizers file; tiktoken merges by the same ranks several
    times as fast, and the library itself stands in for texts that it cannot take."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    import tiktoken

    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the pattern's engine gives up on some very long runs, as a panic, which is no Exception
            if type(e).__name__ != "PanicException":
                raise
            from tokenizers import Tokenizer

            return np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


cached("packing", _encoder.cache_clear)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by volume, and by documents of over half a bin with what fits beside none of them."""
    total = -(-int(lengths.sum()) // capacity)
    best, ordered = total, np.sort(lengths)
    sums = np.concatenate([[0], np.cumsum(ordered)])
    for k in np.unique(ordered[ordered <= capacity // 2]):
        large = len(ordered) - np.searchsorted(ordered, capacity - k, "right")
        lo, hi = np.searchsorted(ordered, capacity // 2, "right"), np.searchsorted(ordered, capacity - k, "right")
        small = np.searchsorted(ordered, k, "left")
        spare = (hi - lo) * capacity - (sums[hi] - sums[lo])
        need = max(0, sums[lo] - sums[small] - spare)
        best = max(best, int(large + (hi - lo) + -(-int(need) // capacity)))
    return best


class Bins:
    """Bins of one shard, by best fit and then by local search."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity, self.steps = lengths, capacity, 0
        self.bins: list[list[int]] = []
        room: list[int] = []
        by_room: dict[int, list[int]] = defaultdict(list)
        mask = 0  # bit r: some bin has room r
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[i])
            fits = mask >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                b = by_room[r].pop()
                if not by_room[r]:
                    mask &= ~(1 << r)
                self.bins[b].append(i)
            else:
                b, r = len(self.bins), capacity
                self.bins.append([i])
                room.append(r)
            room[b] = r = r - n
            by_room[r].append(b)
            mask |= 1 << r

    def fills(self) -> list[int]:
        return [int(sum(self.lengths[i] for i in b)) for b in self.bins]

    def search(self) -> None:
        """Rounds over the underfull bins, the emptiest first, until the lower bound is met or no step is left."""
        bound = lower_bound(self.lengths, self.capacity)
        fills = self.fills()
        count = sum(map(bool, self.bins))
        changed = np.zeros(len(self.bins), np.int64)  # the step that changed a bin last
        tried = np.full(len(self.bins), -1, np.int64)  # the step up to which no step leads from a bin
        while count > bound:
            before = self.steps
            for b in sorted((b for b in range(len(self.bins)) if self.bins[b] and fills[b] < self.capacity), key=fills.__getitem__):
                while self.bins[b] and (step := self._best(b, fills, changed, tried[b])):
                    self._take(b, step, fills, changed)
                    tried[b] = -1
                if self.bins[b]:
                    tried[b] = self.steps
                else:
                    count -= 1
                    if count <= bound:
                        break
            if self.steps == before:
                break
        self.bins = [b for b in self.bins if b]

    def _best(self, b: int, fills: list[int], changed: np.ndarray, since: int) -> tuple[list[int], int, list[int]] | None:
        """The step from bin b that makes the sum of squared fills grow most: documents that leave it, the other bin, and
        documents that come back; only to bins that changed after step `since`."""
        size, capacity = self.lengths, self.capacity
        others = [c for c in range(len(self.bins)) if c != b and self.bins[c] and fills[c] < capacity and changed[c] > since]
        if not others:
            return None
        fill = np.array([fills[c] for c in others])
        room = capacity - fill
        item = np.array([i for c in others for i in self.bins[c]])
        home = np.repeat(np.arange(len(others)), [len(self.bins[c]) for c in others])
        wide = np.int64(2 * capacity)
        key = home * wide + size[item]
        order = np.argsort(key, kind="stable")
        key, item = key[order], item[order]  # each bin's documents by length
        mine = {}  # what can leave, one of each sum of lengths; alone before in twos
        for u, x in enumerate(self.bins[b]):
            mine.setdefault((int(size[x]), True), [x])
        for u, x in enumerate(self.bins[b]):
            for y in self.bins[b][u + 1 :]:
                mine.setdefault((int(size[x] + size[y]), False), [x, y])
        out = list(mine)
        n = np.array([k[0] for k in out])
        growth = 2 * n[:, None] * (fill - fills[b] + n[:, None])  # moves of one
        growth[(room < n[:, None]) | ~np.array([k[1] for k in out])[:, None]] = 0
        k = int(growth.argmax())
        best, step = int(growth.flat[k]), (k // len(others), k % len(others), -1)
        # exchanges: the shortest document of the other bin that leaves no more than its room grows it most
        low = np.maximum(n[:, None] - room, 1)
        place = np.searchsorted(key, np.arange(len(others)) * wide + low)
        at = np.minimum(place, len(key) - 1)
        back = key[at] - np.arange(len(others)) * wide
        gain = n[:, None] - back
        growth = np.where((place < len(key)) & (back < wide) & (back > 0) & (gain > 0), 2 * gain * (fill - fills[b] + gain), 0)
        k = int(growth.argmax())
        if int(growth.flat[k]) > best:
            best, step = int(growth.flat[k]), (k // len(others), k % len(others), int(at.flat[k]))
        if best <= 0:
            return None
        return mine[out[step[0]]], others[step[1]], [] if step[2] < 0 else [int(item[step[2]])]

    def _take(self, b: int, step: tuple[list[int], int, list[int]], fills: list[int], changed: np.ndarray) -> None:
        self.steps += 1
        out, c, back = step
        for x in out:
            self.bins[b].remove(x)
            self.bins[c].append(x)
        for y in back:
            self.bins[c].remove(y)
            self.bins[b].append(y)
        moved = int(sum(self.lengths[x] for x in out) - sum(self.lengths[y] for y in back))
        fills[b] -= moved
        fills[c] += moved
        changed[b] = changed[c] = self.steps


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Lists of indices, one for each bin."""
    bins = Bins(lengths, capacity)
    bins.search()
    return bins.bins


def tokens(docs: DataFrame, path: str, eos: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens with the separator, crcs of the ids of each piece, salt (row's place in its partition), and ids if asked for."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("packing")
        encode, seen = _encoder(path), 0
        for frame in by_bytes(frames, "text", 4_000_000):
            n, crcs, kept = [], [], []
            for text in frame["text"]:
                ids = np.append(encode(text), np.uint32(eos)) if text else np.array([eos], np.uint32)
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[s : s + k].tobytes()) for s, k in cuts(len(ids), capacity)])
                if with_ids:
                    kept.append(ids.astype(np.int32))
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n_tokens": n, "crcs": crcs, "salt": np.arange(seen, seen + len(n))} | ({"ids": kept} if with_ids else {}))
            seen += len(n)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens long, crcs array<long>, salt long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, eos: int = 0, with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = max(1, -(-docs.count() // shard))
    dealt = tokens(docs, path, eos, capacity, with_ids).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "crcs", "salt"), F.lit(n)).cast("int"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "n_tokens", "salt"], kind="stable").reset_index(drop=True)
        total = frame["n_tokens"].to_numpy(np.int64)
        rows = [(i, p, s, k) for i, t in enumerate(total.tolist()) for p, (s, k) in enumerate(cuts(t, capacity))]
        row, piece, start, length = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        sequence, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for b, members in enumerate(pack(length, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = b, at
                at += length[i]
        out = pd.DataFrame({
            "doc_id": frame["doc_id"].to_numpy()[row], "piece": piece.astype(np.int32), "start": start, "length": length,
            "ids_crc32": np.concatenate([np.asarray(x, np.int64) for x in frame["crcs"]]),
            "sequence_id": (int(frame["shard"].iloc[0]) << 32) + sequence, "offset": offset,
        })
        if with_ids:
            out["ids"] = [frame["ids"].iloc[r][s : s + k] for r, _, s, k in rows]
        return out

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return dealt.groupBy("shard").applyInPandas(run, schema)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
