import random

import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import common, neardup
from loomspan.llm.common import Scratch


def brute(rows, width, percent):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        w = min(width, len(words))
        sets.setdefault(doc, {tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if words else set())
    at = {d: d for d in sets}

    def root(d):
        while at[d] != d:
            d = at[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = sorted((root(a), root(b)))
                at[s] = r
    return {(d, len(sets[d]), root(d), d == root(d)) for d in docs}


def run(spark, rows, width=3, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.near_duplicates(df, Scratch(spark, "t"), width, percent)
    return {tuple(r) for r in found.collect()}


def family(seed, copies, words=60, most=6):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(most)):
            text[rng.randrange(words)] = rng.choice(["the", "of", "and", f"x{rng.randrange(9)}"])
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_matches_brute_force(spark, width, percent):
    texts = family(1, 40) + family(2, 25, 20, 3) + family(3, 25, 150, 14)
    texts += ["", None, " \n", "one", "ONE", "one two", "One  Two", "one two three", "é É", "É é"] + texts[:5]
    rows = list(enumerate(texts))
    assert run(spark, rows, width, percent) == brute(rows, width, percent)


def test_crowded_buckets_match_brute_force(spark, monkeypatch):
    rows = list(enumerate(family(5, 120, 100, 16)))
    expected = brute(rows, 3, 85)
    monkeypatch.setattr(neardup, "PAIRS_A_MEMBER", -1)
    real = neardup._bucket_pairs
    made = []

    def crowded(distance):
        made.append(distance)
        inner = real(distance)

        def run(batches):
            neardup.PAIRS_A_MEMBER = -1
            return inner(batches)

        return run

    monkeypatch.setattr(neardup, "_bucket_pairs", crowded)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 2000)
    assert run(spark, rows) == expected
    assert made


@pytest.mark.parametrize(("block", "hot"), [(300, 1_000_000), (300, 4), (2000, 4), (200_000, 1_000_000)])
def test_large_buckets_match_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    texts = family(6, 70, 80, 12) + family(7, 50, 80, 5) + family(8, 20, 400, 60)
    rows = list(enumerate(texts))
    monkeypatch.setattr(neardup, "BUCKET_ROWS", 2)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    assert run(spark, rows) == brute(rows, 3, 85)


def test_empty_table_nulls_and_clashing_columns(spark):
    assert run(spark, []) == set()
    df = spark.createDataFrame([(None, "a b c", 1), (4, "a b c", 2), (2, "a b c", 3)], "doc_id long, text string, node int")
    rows = neardup.near_duplicates(df, Scratch(spark, "t"), 3, 85).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {(None, None, True), (4, 2, False), (2, 2, True)}


def test_signatures_within_the_distance_always_share_a_key():
    rng = np.random.default_rng(3)
    m = neardup.chunks_for(0.85)
    for _ in range(50):
        sig = rng.integers(0, 1 << 16, m * neardup.CHUNK).astype(np.uint16)
        other = sig.copy()
        other[rng.choice(len(sig), 2 * m - 1, replace=False)] ^= 1
        assert set(neardup.index_keys(sig).tolist()) & set(neardup.index_keys(other).tolist())


@pytest.mark.parametrize("rows, shingles", [(2048, 25_000), (3, 40), (1, 1)])
def test_block_links_in_tiles_join_what_all_pairs_join(monkeypatch, rows, shingles):
    monkeypatch.setattr(neardup, "TILE_ROWS", rows)
    monkeypatch.setattr(neardup, "TILE_SHINGLES", shingles)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 30)).astype(np.uint64)) for _ in range(40)]
    of = [k % 2 for k in range(40)]
    for i, j in ((0, 0), (0, 1), (1, 1)):
        own = [k for k in range(40) if of[k] in (i, j)]
        batch = pa.record_batch(
            [[7] * len(own), [i] * len(own), [j] * len(own), own, own, [of[k] for k in own], [sets[k].tobytes() for k in own]],
            names=list("abcdefg"),
        )
        found = [(u, v) for out in neardup._block_links(80)(iter([batch])) for u, v in zip(*(c.to_pylist() for c in out.columns))]
        pairs = [(x, y) for x in own for y in own if x < y and (i == j or of[x] != of[y])]
        true = [(x, y) for x, y in pairs if 100 * len(set(sets[x]) & set(sets[y])) >= 80 * len(set(sets[x]) | set(sets[y]))]
        assert {tuple(sorted(p)) for p in found} <= set(true)
        assert _classes(own, found) == _classes(own, true)


def _classes(items, links):
    at = {k: k for k in items}
    for u, v in links:
        at = {k: at[u] if c == at[v] else c for k, c in at.items()}
    return {frozenset(k for k in items if at[k] == c) for c in at.values()}
