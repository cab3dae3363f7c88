"""Spelling variants: words at one edit from each other, each led to the near word that is far more frequent.

Two words at one edit share the first or the last half of the shorter. So words are grouped by length and half, forward and
backward; a task builds for its groups minimal acyclic automata over the words (and over the reversed words), whose edges carry
how many words precede, so that a path's sum is the word's number (a perfect hash). A word walks its half exactly and completes the
rest with one error: another letter, or a letter more. Pairs that both directions could find are left to the forward one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.common import documents, dropped, starts, written

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences of a word, and how many times more frequent its form is.
LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10
#: Words a task holds on average, and the most of one half in a part of a group.
BUCKET, PART = 60_000, 30_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Automaton:
    """The minimal acyclic automaton of distinct words, sorted by code point, with their numbers.

    Edges are sorted by state and code point: keys (state << 21 | code point), the state they lead to, and skip, how many words
    precede those behind the edge. A word's number is the sum of its path's skips: its place among the sorted words."""

    def __init__(self, codes: np.ndarray):
        n, width = codes.shape
        size = (codes != 0).sum(1)
        same = np.zeros(n, np.int64)  # letters in common with the word before
        same[1:] = np.where((codes[1:] == codes[:-1]).all(1), width, (codes[1:] != codes[:-1]).argmax(1))
        parent, letter, count, height, final = [], [], [np.array([n])], [np.array([size.max(initial=0)])], [np.array([bool((size == 0).any())])]
        base, node = 0, np.zeros(n, np.int64)  # of each word, at the depth so far
        total = 1
        for d in range(1, width + 1):
            here = size >= d
            if not here.any():
                break
            new = here & (same < d)
            first = np.flatnonzero(new)
            parent.append(node[first])
            letter.append(codes[first, d - 1].astype(np.int64))
            at = np.flatnonzero(here)
            own = np.cumsum(new)[at] - 1
            count.append(np.bincount(own, minlength=len(first)))
            deepest = np.zeros(len(first), np.int64)
            np.maximum.at(deepest, own, size[at])
            height.append(deepest - d)
            ends = np.zeros(len(first), bool)
            ends[own[size[at] == d]] = True
            final.append(ends)
            base, total = total, total + len(first)
            node = node.copy()
            node[at] = base + own
        count, height, final = map(np.concatenate, (count, height, final))
        parent = np.concatenate(parent) if parent else np.zeros(0, np.int64)
        letter = np.concatenate(letter) if letter else np.zeros(0, np.int64)
        degree = np.bincount(parent, minlength=total)
        self._merge(letter, starts(degree), degree, count, height, final)

    def _merge(self, letter, first, degree, count, height, final) -> None:
        """Nodes of the tree (node k + 1 hangs on edge k) with the same continuations become one state, the lowest first."""
        state = np.full(len(count), -1)
        leaders: list[np.ndarray] = []
        states = 0
        order = np.argsort(height, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(height[order])) + 1):
            deg = degree[own]
            at = np.repeat(first[own] - starts(deg)[:-1], deg) + np.arange(deg.sum())
            pair = (state[at + 1].astype(np.uint64) << np.uint64(21)) | letter[at].astype(np.uint64)
            sums = []
            for mix in _MIX:
                x = (pair + mix) * mix
                x ^= x >> np.uint64(29)
                x *= _MIX[0] ^ (mix << np.uint64(1))
                x ^= x >> np.uint64(32)
                sums.append(np.diff(np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)][starts(deg)]))
            sort = np.lexsort((*sums, deg, final[own]))
            keys = [k[sort] for k in (*sums, deg, final[own])]
            new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
            lead = own[sort[new]]
            leader = np.empty(len(own), np.int64)
            leader[sort] = lead[np.cumsum(new) - 1]
            # the sums are hashes: what they join is compared
            twin = np.repeat(first[leader] - starts(deg)[:-1], deg) + np.arange(deg.sum())
            if not ((letter[at] == letter[twin]) & (state[at + 1] == state[twin + 1])).all():
                raise ArithmeticError("two hashes of continuations agree by chance")
            number = np.empty(len(own), np.int64)
            number[sort] = states + np.cumsum(new) - 1
            state[own] = number
            leaders.append(lead)
            states += len(lead)
        lead = np.concatenate(leaders)
        deg = degree[lead]
        at = np.repeat(first[lead] - starts(deg)[:-1], deg) + np.arange(deg.sum())
        source = np.repeat(np.arange(states), deg)
        before = np.cumsum(count[at + 1]) - count[at + 1] if len(at) else np.zeros(0, np.int64)
        self.root, self.final, self.edges = int(state[0]), final[lead], starts(deg)
        self.keys, self.target = (source << 21) | letter[at], state[at + 1]
        self.skip = before - (before[self.edges[:-1][source]] if len(at) else 0) + self.final[source]

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge of a state for a code point, and whether there is one."""
        key = (state << 21) | code
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)

    def fan(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of states: index into state, edge."""
        deg = self.edges[state + 1] - self.edges[state]
        which = np.repeat(np.arange(len(state)), deg)
        return which, np.arange(len(which)) - np.repeat(starts(deg)[:-1], deg) + self.edges[state][which]

    def near(self, codes: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length (a row of code points each): pairs of row and number of the words that begin with the row's
        first half and have one letter changed or one letter more after it, each once."""
        n, width = codes.shape
        codes = codes.astype(np.int64)
        row, state, number = np.arange(n), np.full(n, self.root), np.zeros(n, np.int64)
        lost = [np.zeros(0, np.int64)] * 3  # rows with the error behind them
        for j in range(width + 1):
            if j >= half:
                which, edge = self.fan(state)
                letter = self.keys[edge] & ((1 << 21) - 1)
                other = letter != codes[row[which], j] if j < width else np.ones(len(which), bool)
                # a letter more: of places that give the same word the last one; then the row's own letter follows
                which, edge = which[other], edge[other]
                spawned = [row[which], self.target[edge], number[which] + self.skip[edge]]
                lost = [np.r_[a, b] for a, b in zip(lost, spawned, strict=True)]
            if j == width:
                break
            at, there = self.step(lost[1], codes[lost[0], j])
            lost = [lost[0][there], self.target[at[there]], lost[2][there] + self.skip[at[there]]]
            if j >= half:  # another letter
                lost = [np.r_[a, b] for a, b in zip(lost, spawned, strict=True)]
            at, there = self.step(state, codes[row, j])
            row, state, number = row[there], self.target[at[there]], number[there] + self.skip[at[there]]
        ends = self.final[lost[1]]
        return lost[0][ends], lost[2][ends]


def edited_pairs(words: list[str], held: np.ndarray, asks: np.ndarray, m: int, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index of a word that asks, index of a near one that is held). words: distinct, of m or m + 1 code points (m, if they
    ask); the direction's half has brought them together."""
    turned = np.array([w[::-1] for w in words] if backward else words, dtype=f"<U{m + 1}")
    keep, asking = np.flatnonzero(held), np.flatnonzero(asks)
    order = keep[np.argsort(turned[keep], kind="stable")]
    codes = turned.view("<u4").reshape(len(words), m + 1)
    row, number = Automaton(codes[order]).near(codes[asking][:, :m], m // 2)
    a, b = asking[row], order[number]
    if backward and len(a):  # those with the first half in common are the forward direction's
        fore = np.array([w[: m // 2] for w in words], dtype=f"<U{max(m // 2, 1)}")
        apart = fore[a] != fore[b]
        a, b = a[apart], b[apart]
    return a, b


def near_words(frame: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, less (minus the largest n of its near words), form: what one bucket tells of its words."""
    out: dict[str, list] = {"word": [], "n_near": [], "less": [], "form": []}
    for (backward, m), part in frame.groupby(["backward", "m"]):
        part = part.groupby("word", sort=True, as_index=False).agg({"n": "first", "asks": "max", "held": "max"})  # parts of a group may meet here
        words, n = part["word"].tolist(), part["n"].to_numpy()
        a, b = edited_pairs(words, part["held"].to_numpy(bool), part["asks"].to_numpy(bool), int(m), bool(backward))
        longer = np.array([len(w) for w in words]) > m
        a, b = np.r_[a, b[longer[b]]], np.r_[b, a[longer[b]]]  # the longer word of a pair asks nothing here
        if len(a):
            order = np.lexsort((b, -n[b], a))  # words are sorted by code point
            a, b = a[order], b[order]
            lead = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            out["word"] += [words[i] for i in a[lead]]
            out["n_near"] += np.diff(np.r_[lead, len(a)]).tolist()
            out["less"] += (-n[b[lead]]).tolist()
            out["form"] += [words[i] for i in b[lead]]
    return pd.DataFrame({c: pd.Series(x, dtype=object if c in ("word", "form") else "int64") for c, x in out.items()})


def halves(words: DataFrame) -> DataFrame:
    """word, n, backward, m, asks, half (hash): a word as the shorter of a pair (asks) and as the longer one, in both directions."""
    size = F.length("word")

    def half(backward: bool, m: Column, asks: bool) -> Column:
        n = F.floor(m / 2).cast("int")
        part = F.right("word", n) if backward else F.left("word", n)
        return F.struct(F.lit(backward).alias("backward"), m.cast("int").alias("m"), F.lit(asks).alias("asks"), F.xxhash64(part).alias("half"))

    each = F.array(*[half(d, size, True) for d in (False, True)], *[half(d, size - 1, False) for d in (False, True)])
    rows = words.select("word", "n", F.explode(F.filter(each, lambda x: x["m"] >= 1)).alias("x"))
    return rows.select("word", "n", "x.*")


def near(words: DataFrame) -> DataFrame:
    """word, n_near, less and form over all words (word: distinct; n); words without near words have no row.

    Halves of one word alone are left out. A half of very many words is parted: each word is in the automaton of one part and
    asks in all of them, so no task holds the group, and what grows with the square of its size are questions, not pairs."""
    key = ["backward", "m", "half"]
    rows = written(halves(words), "halves")
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("k"), F.count_if("asks").alias("q")).filter("k > 1 and q > 0")
    total = groups.agg(F.sum(F.col("k") + F.col("q") * F.floor(F.col("k") / PART)).alias("n")).first()["n"] or 0
    met = rows.join(groups, key).withColumn("parts", F.ceil(F.col("k") / PART).cast("int")).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    every = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))
    met = met.withColumn("part", F.explode(every))
    bucket = F.pmod(F.xxhash64(*key, "part"), F.lit(-(-total // BUCKET) or 1)).alias("bucket")
    held = met.select("word", "n", "backward", "m", "asks", (F.col("part") == F.col("own")).alias("held"), bucket)
    found = held.groupBy("bucket").applyInPandas(near_words, "word string, n_near long, less long, form string")
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("x"))
    out = written(out.select("word", "n_near", "x.less", "x.form"), "near")
    dropped(words.sparkSession, rows)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words that have a form (word, form): each round doubles the steps, and a form is ten times as frequent, so
    there are few."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = written(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        dropped(now.sparkSession, now)
        now = after.select("word", "root")
        if not after.filter("moved").head(1):
            return now


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word: distinct, not null, without the code point 0; n). Near words differ by
    exactly one code point inserted, deleted or replaced; the form is the near word of largest n, of equal ones the least in
    code-point order, if its n is so many times the word's, else null. No words give no rows."""
    found = near(words)
    rows = words.select("word", "n").join(found, "word", "left")
    best = -F.col("less")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(best >= times * F.col("n"), F.struct(F.col("form"), best.alias("n"))).alias("x")), "forms")
    rooted = roots(rows.filter("x is not null").select("word", "x.form"))
    out = rows.join(rooted, "word", "left")
    return out.select("word", F.col("x.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("x.n").alias("form_n"))


def counted(runs: DataFrame, least: int = LEAST_CHARS, often: int = LEAST_COUNT) -> DataFrame:
    """word and n of runs (word, a row an occurrence) of so many code points that occur so often; partial sums meet in one shuffle."""
    return runs.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


def runs(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id and word: maximal runs of letters of so many code points, A-Z lowered; a null text has none."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least},}}"), 0)).alias("word")).withColumn("word", F.translate("word", UPPER, LOWER))


def slipped(found: DataFrame) -> DataFrame:
    """runs where one in 31, by a hash of document (null: empty) and run, has lost a code point."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    rows = found.withColumn("h", h)
    at = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.left("word", at), F.substring("word", at + 2, F.length("word")))
    return rows.select("doc_id", F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("word")).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(counted(slipped(runs(documents(spark, sf_dir).select("doc_id", "text")))), "words"))
