"""Repeated strings, fingerprints and the Jaccard join against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fumiyomi.llm import chunks, common, fingerprints, jaccard_join, suffix_dedup


def covered_by_hand(rows, span=50):
    """By document: the bytes of strings that a document with a smaller id has, too."""
    seen, out = {}, []
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - span + 1):
            s = raw[k : k + span]
            key = float("inf") if i is None else i
            seen[s] = min(seen.get(s, key), key)
    for i, t in rows:
        raw = (t or "").encode()
        mark = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - span + 1):
            if seen[raw[k : k + span]] < (float("inf") if i is None else i):
                mark[k] += 1
                mark[k + span] -= 1
        m = np.cumsum(mark)[: len(raw)] > 0
        kept = np.frombuffer(raw, np.uint8)[~m].tobytes()
        out.append((i, len(raw), int(m.sum()), int((m & ~np.append(False, m[:-1])).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeated_strings(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in suffix_dedup.digests(docs).collect()), key=str)
    assert got == covered_by_hand(rows)


@pytest.mark.parametrize("seed, most", [(0, 150_000), (1, 150_000), (2, 12), (3, 12), (4, 40)])
def test_repeated_strings_of_few_letters(spark, tmp_path, monkeypatch, seed, most):
    """Much overlap: texts cut from a few sources over two letters, with runs; small ranges make k-grams hot, which are parted."""
    monkeypatch.setattr(suffix_dedup, "RANGE", most)
    rng = random.Random(seed)
    source = ["".join(rng.choice("ab" if k % 2 else "abcdefgh") for _ in range(400)) + "z" * 150 for k in range(4)]
    rows = []
    for i in range(60):
        a = rng.choice(source)
        lo = rng.randrange(300)
        text = a[lo : lo + rng.randrange(20, 200)] + "".join(rng.choice("xyé") for _ in range(rng.randrange(30))) + rng.choice(source)[: rng.randrange(100)]
        rows.append((rng.choice([i, i // 2, None]), text))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    df = spark.read.parquet(path)
    got = sorted((tuple(r) for r in suffix_dedup.digests(df).collect()), key=str)
    assert got == covered_by_hand(rows)


def test_small_slices_groups_and_ranges(docs, monkeypatch):
    """The same result whatever is done at once: few documents a group, many ranges, hash buckets and buckets within ranges."""
    whole = sorted((tuple(r) for r in suffix_dedup.digests(docs).collect()), key=str)
    for name, value in (("RANGE", 20), ("RANGES", 4), ("BUCKET_BYTES", 9_000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(chunks, "GROUP_BITS", 2)
    assert sorted((tuple(r) for r in suffix_dedup.digests(docs).collect()), key=str) == whole


def test_anchors_in_slices(monkeypatch):
    rng = random.Random(3)
    raw, first, size = suffix_dedup.joined(["".join(rng.choice("abc ") for _ in range(n)).encode() for n in (900, 20, 51, 0, 400, 50, 2000)])
    whole = suffix_dedup.anchors(raw, first, size)
    for n in (64, 77, 1000):
        monkeypatch.setattr(suffix_dedup, "SLICE", n)
        assert all((a == b).all() for a, b in zip(suffix_dedup.anchors(raw, first, size), whole, strict=True))


def test_row_numbers_do_not_depend_on_the_cut(spark, docs):
    """Row numbers are those of files: the same under other splits, after filters, and in several files."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    pick = lambda d: sorted((r["_row"], str(r["doc_id"]), str(r["text"])) for r in common.placed(d, "_row").collect())
    whole = pick(docs)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        assert pick(docs) == whole and len({r[0] for r in whole}) == len(whole)
        assert set(pick(docs.filter("doc_id > 20"))) <= set(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    made = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert len({r[0] for r in pick(made)}) == 2


@given(st.lists(st.binary(min_size=0, max_size=12), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_multikey_order(rows):
    x = np.zeros((len(rows), 16), np.uint8)
    for i, r in enumerate(rows):
        x[i, : len(r)] = list(r)
    order = suffix_dedup.multikey(suffix_dedup._words(x))
    assert [x[i].tobytes() for i in order] == sorted(r.tobytes() for r in x)


@given(st.lists(st.text(alphabet="ab ", max_size=120), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_each_window_has_its_anchors(texts):
    """Equal windows have equal anchors, at least one each."""
    raw, first, size = suffix_dedup.joined([t.encode() for t in texts])
    at = set(suffix_dedup.anchors(raw, first, size)[0].tolist())
    seen: dict = {}
    for f, n in zip(first.tolist(), size.tolist(), strict=True):
        for k in range(f, f + n - suffix_dedup.SPAN + 1):
            own = {p - k for p in at if k <= p <= k + suffix_dedup.REACH}
            assert own
            seen.setdefault(raw[k : k + suffix_dedup.SPAN].tobytes(), []).append(own)
    for sets in seen.values():
        assert set.intersection(*sets)


def test_texts_without_repeats(docs, texts):
    cut = {(r["doc_id"], r["n_chars"]): r["text"] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert len(suffix_dedup.remove_repeats(docs).columns) == len(docs.columns)
    assert cut[3, len(texts[3])] == texts[3] and cut[40, len(texts[40])] == "" and cut[46, None] is None


# ---- fingerprints


def test_fingerprints_of_a_table(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    from pyspark.sql import functions as fn  # the tie order of equal and missing ids is a hash's

    hashes = {r["text"]: r["h"] for r in docs.select(fn.coalesce("text", fn.lit("")).alias("text")).distinct().select("text", fn.xxhash64("text").alias("h")).collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    expect = sorted((str(i), len(t), hashlib.sha256(fingerprints.edited_text(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
    for bucket in (4096, 5):
        got = fingerprints.with_edits(docs, bucket).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == expect
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert all(plain[r["doc_id"]] == r["fingerprint"] for r in got if r["doc_id"] is not None)
    assert plain[3] == plain[40] != plain[4] and plain[45] == ""
    assert fingerprints.likeness(fingerprints.read_in(plain[3]), fingerprints.read_in(plain[40])) == 1.0
    assert fingerprints.likeness(fingerprints.read_in(plain[4]), fingerprints.read_in(plain[42])) > 0.6 > fingerprints.likeness(fingerprints.read_in(plain[4]), fingerprints.read_in(plain[5]))


@given(st.text(alphabet="abcde ", min_size=200, max_size=400), st.text(alphabet="abcde ", max_size=50), st.text(alphabet="abcde ", max_size=50))
@settings(max_examples=100, deadline=None)
def test_interior_phrases_do_not_depend_on_offset(core, before, after):
    """Names of phrases well inside a string are the same wherever it stands."""
    first = np.zeros(1, np.int64)

    def names(text):
        return fingerprints.parse(np.frombuffer(text.encode(), np.uint8), first)[0].tolist()

    inner = names(core)[12:-12]
    whole = names(before + core + after)
    assert not inner or any(whole[k : k + len(inner)] == inner for k in range(len(whole)))


def test_labels_differ_between_neighbours():
    x = np.frombuffer(bytes(np.random.default_rng(1).permutation(np.arange(256, dtype=np.uint8))), np.uint8)
    label = fingerprints._toss(x, np.zeros(1, np.int64))
    assert (label[1:] != label[:-1]).all() and label.max() < 6


# ---- Jaccard join


def shingle_sets(rows):
    out = []
    for _, t in rows:
        w = common.words(t)
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def by_hand(rows):
    sets = shingle_sets(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if (not a and not b) or (a and b and both >= 0.8 * (len(a) + len(b) - both) - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    named = {i: min((rows[k][0] is None, rows[k][0] or 0) for k in g) for g in groups.values() for i in g}
    return sorted((str(rows[i][0]), str(None if named[i][0] else named[i][1]), links[i]) for i in range(len(rows)))


@pytest.fixture(scope="module")
def near(spark, texts, tmp_path_factory):
    """The small table, and a group of near copies, chains of them, and texts that share a passage."""
    rng = random.Random(9)
    base = texts[0].split()
    rows = list(texts.items())
    for k in range(30):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append((100 + k, " ".join(w)))
    for k in range(12):  # each link of the chain is near the next one only
        rows.append((200 + k, " ".join(f"c{k + j}" for j in range(60))))
    rows += [(None, texts[2]), (300, texts[2]), (301, "short text"), (302, "short text"), (303, "other")]
    path = str(tmp_path_factory.mktemp("near") / "d.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("block", [2000, 7])
def test_join_is_brute_force(near, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # blocks of a group
    rows = [(r["doc_id"], r["text"]) for r in near.collect()]
    got = jaccard_join.links(near).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in got) == by_hand(rows)
    firsts = [r for r in got if r["first"]]
    assert len(firsts) == len({(r["class_id"], None if r["class_id"] is not None else r["row"]) for r in firsts})


def test_one_of_each_group_stays(near):
    kept = jaccard_join.deduplicate(near)
    assert kept.columns == near.columns
    rows = [(r["doc_id"], r["text"]) for r in near.collect()]
    assert kept.count() == len({g for _, g, _ in by_hand(rows)} - {"None"}) + ("None" in {g for _, g, _ in by_hand(rows)})


def test_pruning_bars():
    bars = jaccard_join.least_matches()
    assert list(bars) == [32, 64, 96, 128, 160] and all(b < 0.8 * n for n, b in bars.items())
    assert jaccard_join.least_matches(tolerance=0.5)[160] > bars[160]


def test_components(spark):
    rng = random.Random(4)
    edges = [(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(60)) if a != b] + [(k + 1, k) for k in range(200, 230)]
    got = {r["node"]: r["comp"] for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_empty_and_clashing(empty, clashing, docs):
    for fn in (suffix_dedup.digests, suffix_dedup.remove_repeats, fingerprints.with_edits, jaccard_join.links, jaccard_join.deduplicate):
        assert fn(empty).collect() == []
    assert sorted(map(str, suffix_dedup.digests(clashing).collect())) == sorted(map(str, suffix_dedup.digests(docs).collect()))
    pick = lambda d: sorted(map(str, jaccard_join.links(d).select("doc_id", "class_id", "n_links").collect()))
    assert pick(clashing) == pick(docs)
    assert jaccard_join.deduplicate(clashing).columns == clashing.columns and suffix_dedup.remove_repeats(clashing).columns == clashing.columns
    assert fingerprints.with_edits(clashing).count() == clashing.select(F.lit(1)).count()


@given(st.integers(0, 10**6), st.integers(2, 30), st.booleans())
@settings(max_examples=60, deadline=None)
def test_links_of_a_band_span_its_pairs(seed, count, halves):
    """Components of the links are those of all pairs that the pruning leaves."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (3, 160))
    low = np.stack([np.where(rng.random(160) < rng.choice([0, 0.1, 0.4]), rng.integers(0, 256, 160), base[rng.integers(3)]) for _ in range(count)]).astype(np.uint8)
    n, bars = rng.integers(80, 120, count), jaccard_join.least_matches()
    left = rng.random(count) < 0.5 if halves else None

    def components(pairs):
        comp = list(range(count))
        for i, j in pairs:
            comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
        return comp

    def stays(i, j):
        one = lambda x: x[None]
        return len(jaccard_join.unpruned(one(low[i]), one(low[j]), one(n[i]), one(n[j]), 0.8, bars)) == 1

    every = [(i, j) for i in range(count) for j in range(i + 1, count) if (left is None or left[i] != left[j]) and stays(i, j)]
    assert components(jaccard_join.band_links(low, n, left, 0.8, bars)) == components(every)
