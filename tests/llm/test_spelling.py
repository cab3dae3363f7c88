"""Near words against all pairs; the automata against plain sets; counts of runs against a loop over texts."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from fumiyomi.llm import spelling_variants as sv

LETTERS = "abcdeàÿ"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=10):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def words(rng, n, least=7, most=10):
    out = set()
    while len(out) < n:
        w = "".join(rng.choice(LETTERS) for _ in range(rng.randint(least, most)))
        out.add(w)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(LETTERS) + w[i:], w[:i] + rng.choice(LETTERS) + w[i + 1 :]])
            if len(v) >= least:
                out.add(v)
    return sorted(out)


def rows_of(spark, counts):
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int").repartition(3)
    return sorted(tuple(r) for r in sv.variants(df).collect())


def test_automaton_numbers_words_and_is_minimal():
    rng = random.Random(1)
    own = sorted({w[:k] for w in words(rng, 300) for k in (3, 5, 8)})
    codes = np.array(own, dtype="<U8").view("<u4").reshape(len(own), 8)
    a = sv.Automaton(codes)
    for i, w in enumerate(own):
        state, number = np.array([a.root]), 0
        for c in w:
            at, there = a.step(state, np.array([ord(c)]))
            assert there.all()
            state, number = a.target[at], number + int(a.skip[at[0]])
        assert number == i and a.final[state[0]]
    rest = {tuple(sorted(w[len(p) :] for w in own if w.startswith(p))) for w in own for p in (w[:k] for k in range(len(w) + 1))}
    assert len(a.final) == len(rest)  # as many states as different sets of continuations


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_one_group(seed):
    rng = random.Random(seed)
    m = rng.choice([7, 8])
    own = [w for w in words(rng, 250, m, m + 1) if len(w) in (m, m + 1)]
    asks = np.array([len(w) == m for w in own])
    found = collections.Counter()
    for backward in (False, True):
        found.update(zip(*(x.tolist() for x in sv.edited_pairs(own, np.ones(len(own), bool), asks, m, backward)), strict=True))
    wanted = {(i, j) for i, w in enumerate(own) for j, v in enumerate(own) if asks[i] and one_edit(w, v)}
    assert set(found) == wanted and set(found.values()) == {1}


def test_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    counts = {w: rng.choice([2, 3, 5, 20, 30, 200, 300, 2000]) for w in words(rng, 500)}
    wanted = brute(counts)
    assert rows_of(spark, counts) == wanted and any(r[1] and r[1] != r[2] for r in wanted)
    monkeypatch.setattr(sv, "PART", 3)  # groups in parts, many buckets
    monkeypatch.setattr(sv, "BUCKET", 50)
    assert rows_of(spark, counts) == wanted


def test_one_half_of_very_many_words(spark, monkeypatch):
    rng = random.Random(3)
    own = {"abcabc" + "".join(rng.choice(LETTERS) for _ in range(rng.randint(5, 6))) for _ in range(400)}
    counts = {w: rng.randint(2, 60) for w in own}
    monkeypatch.setattr(sv, "PART", 40)
    monkeypatch.setattr(sv, "BUCKET", 100)
    assert rows_of(spark, counts) == brute(counts)


def test_few_long_and_no_words(spark):
    assert rows_of(spark, {}) == [] and rows_of(spark, {"abcdefg": 2}) == [("abcdefg", None, "abcdefg", 2, 0, None)]
    counts = {"x" * 4000: 50, "x" * 4001: 2, "x" * 2000 + "y" + "x" * 1999: 3, "aaaaaaa": 100, "aaaaaaaa": 10, "aaaaaaaaa": 10, "baaaaaa": 10}
    assert rows_of(spark, counts) == brute(counts)


def test_runs_of_documents(spark, docs):
    def loop(rows):
        counts = collections.Counter()
        for i, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                w = run.translate({c: c + 32 for c in range(65, 91)})
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if h % 31 == 0:
                    k = h % len(w)
                    w = w[:k] + w[k + 1 :]
                if len(w) >= 7:
                    counts[w] += 1
        return {w: n for w, n in counts.items() if n >= 2}

    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(9, "ÀÉÎÕÜß×÷ÿz " * 3 + "Schön-Schönheiten SCHÖNHEITEN"), (None, "Strength STRENGTH")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int")
    got = {r["word"]: r["n"] for r in sv.counted(sv.slipped(sv.runs(df))).collect()}
    assert got == loop(rows) and any("×" in w for w in got)
