"""Token counts, BPE and packing against the tokenizers library."""

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fumiyomi.llm import bpe, packing, pieces, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"ab Zé\t\n 　\x1c\x85'’s1½٣日😀.!<|>", "<|endoftext|>", "  ", " \n", "\u0301", "'ll"]
ODD = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


@lru_cache
def loaded(path):
    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def library():
    return loaded(BYTES)


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_pieces_sum_to_text(text):
    assert "".join(pieces.cut(text)) == text


@given(ODD)
@settings(max_examples=400, deadline=None)
def test_encoding_is_the_library_s(text):
    library = loaded(BYTES)
    ids = np.frombuffer(b"".join(bpe._pieces(BYTES)([text])[0]), "<u4")
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.bpe(BYTES).decode(ids.astype(np.int64)).decode("utf-8", "replace") == library.decode(ids.tolist(), skip_special_tokens=False)
    if text:
        assert packing._encoder(BYTES)(text).tolist() == ids.tolist()


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_counts_are_the_library_s(text):
    library = loaded(WORDS)
    assert token_counts._counter(WORDS)([text, None]) == [len(library.encode(text, add_special_tokens=False).ids), 0]


@given(st.text(alphabet="ab xyz", min_size=1, max_size=30), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_backtracking_on_long_words(word, k):
    library = loaded(BYTES)
    text = word * (1 + 7 * k)
    assert bpe.bpe(BYTES).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_queries_over_a_table(docs, texts, library):
    rows = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.digests(docs, BYTES).collect()}
    assert len(bpe.digests(docs, BYTES).collect()) == docs.count()
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = rows[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()}
    assert all(back[i] == (t or "") for i, t in texts.items())
    counted = {r["doc_id"]: r for r in token_counts.count_tokens(docs, WORDS).collect()}
    other = Tokenizer.from_file(WORDS)
    for i, t in texts.items():
        assert counted[i]["n_bytes"] == len((t or "").encode())
        assert counted[i]["n_tokens"] == len(other.encode(t or "", add_special_tokens=False).ids)
        assert counted[i]["over_limit"] == (counted[i]["n_tokens"] > 2048)


def test_sentencepiece_counts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts._counter(path)(["a b c", None, "日本"]) == [len(model.encode("a b c")), 0, len(model.encode("日本"))]


@given(st.integers(1, 9000), st.sampled_from([7, 64, 2048]))
def test_cuts(n, capacity):
    parts = packing.cuts(n, capacity)
    assert parts[0][0] == 0 and sum(k for _, k in parts) == n
    assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert all(k == capacity for _, k in parts[1:]) and 0 < parts[0][1] <= capacity


@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_packing_is_a_partition(lengths):
    size = np.array(lengths)
    bins = packing.pack(size, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(size)))
    assert all(size[b].sum() <= 100 for b in bins)
    assert len(bins) >= packing.lower_bound(size, 100)


def test_local_search_beats_best_fit():
    size = np.array([6, 5, 5, 4, 4, 3, 3])  # best fit by length leaves four bins, three of ten do
    start = packing.Bins(size, 10)
    before = len(start.bins)
    start.search()
    assert len(start.bins) <= before and len(packing.pack(np.array([5, 4, 4, 3, 2, 2]), 10)) == 2


def fewest(lengths, capacity):
    """Bins of the best packing there is, by trying all."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [r - lengths[i] if j == k else r for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_packing_of_few_against_all_packings(lengths):
    bins, best = packing.pack(np.array(lengths), 30), fewest(sorted(lengths, reverse=True), 30)
    assert best <= len(bins) <= best + 1
    assert packing.lower_bound(np.array(lengths), 30) <= best


@given(st.lists(st.integers(3, 60), min_size=5, max_size=40), st.integers(60, 80))
@settings(max_examples=100, deadline=None)
def test_no_step_is_left(lengths, capacity):
    """Above the lower bound no move and no exchange of one or two documents for one makes the sum of squared fills grow."""
    size = np.array(lengths)
    bins = packing.pack(size, capacity)
    if len(bins) == packing.lower_bound(size, capacity):
        return
    fill = [int(size[b].sum()) for b in bins]
    for b in range(len(bins)):
        for c in range(len(bins)):
            if b != c and fill[b] < capacity and fill[c] < capacity:
                ones = [[int(size[x])] for x in bins[b]]
                twos = [[int(size[x]), int(size[y])] for k, x in enumerate(bins[b]) for y in bins[b][k + 1 :]]
                for out, back in [(o, 0) for o in ones] + [(o, int(size[y])) for o in ones + twos for y in bins[c]]:
                    gain = sum(out) - back
                    assert gain <= 0 or fill[c] + gain > capacity or (fill[c] + gain) ** 2 + (fill[b] - gain) ** 2 <= fill[c] ** 2 + fill[b] ** 2


def test_packed_documents(docs, texts, library):
    rows = packing.pack_documents(docs, BYTES, with_ids=True).collect()
    plain = packing.pack_documents(docs, BYTES).collect()
    key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["ids_crc32"], r["sequence_id"], r["offset"])
    assert sorted(map(key, rows)) == sorted(map(key, plain))
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        own = own[: len(packing.cuts(len(ids), 2048))] if i != 7 else own[::2]
        if i != 7:
            assert [(r["start"], r["length"]) for r in own] == packing.cuts(len(ids), 2048)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            assert r["ids"] == ids[r["start"] : r["start"] + r["length"]].tolist()
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_and_clashing(empty, clashing, docs):
    for fn in (lambda d: bpe.digests(d, BYTES), lambda d: token_counts.count_tokens(d, WORDS), lambda d: packing.pack_documents(d, BYTES)):
        assert fn(empty).collect() == []
        assert fn(clashing).count() == fn(docs).count()
