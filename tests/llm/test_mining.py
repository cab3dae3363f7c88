"""Hard negatives against all scores; windows with ties, copies and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fumiyomi.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, score int, key string"


def brute(rows):
    """All rows against all anchors, in Python's whole numbers."""
    able = {(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for a, label, v in sorted(able):
        if a % 100:
            continue
        near = sorted({(-dot(v, w), i) for i, l, w in able if l == label and i != a})[:5]
        away = sorted({(-dot(v, w), i) for i, l, w in able if l != label and i != a})
        for p, pid in near:
            inside = [(s, i) for s, i in away if 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(inside[:5])]
    return sorted(out)


def mined(spark, rows, tmp_path, parts=3):
    path = str(tmp_path / "e")
    spark.createDataFrame([(i, l, v, 1, "x") for i, l, v in rows], SCHEMA).repartition(parts).write.parquet(path)
    df = hn.mine(spark.read.parquet(path), F.col("vec_id") % 100 == 0)
    assert df.columns == hn.RESULT
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small(monkeypatch):
    """Several blocks, groups and tiles on few rows."""
    for name, value in {"BLOCK_ROWS": 64, "BLOCK_ANCHORS": 2, "ROW_BLOCKS": 2, "ANCHOR_BLOCKS": 2, "TILE": 16, "SAMPLE": 100}.items():
        monkeypatch.setattr(hn, name, value)


def vectors(rng, n, width=6):
    return [(i, rng.randrange(3), [rng.uniform(-1, 1) for _ in range(width)]) for i in range(n)]


def test_all_scores(spark, tmp_path, small):
    rows = vectors(random.Random(1), 900)
    assert mined(spark, rows, tmp_path) == brute(rows) != []


def test_copies_of_a_third_and_ties(spark, tmp_path, small):
    rng = random.Random(2)
    rows = vectors(rng, 600, 5)
    hot = [0.5, 0.5, 0.25, 0.0, 0.1]
    rows = [(i, l, hot if i % 3 == 0 else [round(x, 1) for x in v]) for i, l, v in rows]
    rows += rows[:50]  # repeated as they are
    rows += [(7, 2, hot), (200, 1, [0.9] * 5)]  # an id with other contents
    assert mined(spark, rows, tmp_path) == brute(rows) != []


def test_rows_that_take_no_part(spark, tmp_path, small):
    rows = vectors(random.Random(3), 250, 4)
    rows += [(None, 1, [1.0] * 4), (1000, None, [1.0] * 4), (1001, 1, None), (1100, 1, [1.0, None, 1.0, 1.0]), (1200, 0, [1.0, math.nan, 0.0, 0.0]), (1300, 0, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(1400, 0, [1.0]), (1401, 0, []), (1402, 1, [0.9, 0.1])]  # shorter ones end with zeros
    assert mined(spark, rows, tmp_path) == brute(rows) != []


def test_large_components_stay_exact(spark, tmp_path, small):
    rng = random.Random(4)
    rows = [(i, rng.randrange(2), [rng.uniform(-1, 1) * 10.0 ** (i % 13) for _ in range(3)]) for i in range(300)]
    assert mined(spark, rows, tmp_path) == brute(rows) != []


def test_no_rows_and_no_anchors(spark, tmp_path):
    assert mined(spark, [], tmp_path / "a") == [] and mined(spark, [(1, 1, [1.0]), (2, 0, [1.0])], tmp_path / "b") == []
    assert mined(spark, [(100, 1, [1.0])], tmp_path / "c") == [] and mined(spark, [(100, 1, []), (101, 1, []), (102, 0, [])], tmp_path / "d") == [(100, 101, 1, 102, 0, 0)]


def test_the_filter_is_sound():
    """No exact score lies outside its enclosure, and few rows are left to be scored."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(700, 64)) / 8)
    centres = hn.fit(x[:300])
    codes, bound = hn.encode(x, centres)
    near = centres[np.arange(32), codes].reshape(len(x), -1)
    a = x[:20]
    off = np.abs(a @ x.T - a @ near.T)
    assert (off <= np.sqrt((a * a).sum(1))[:, None] * bound).all()
    assert np.median(bound) < 0.35 * np.median(np.sqrt((x * x).sum(1)))
