import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from loomspan.llm import toxicity
from loomspan.llm.common import Scratch
from loomspan.llm.neardup import shingle_set
from loomspan.llm.queries import vocabulary

INSULTS = ["vilewort", "grubface", "idiot", "scum"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    split = "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 0x7F else " " for c in lower(text))
    return split.split(" ")


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(plain) for _ in range(n)]
    items = [(i, " ".join(text(14))) for i in range(6)] + [(50, None), (51, "Tiny item")]
    rows, labels = [], []
    for i in range(300):
        made = text(rng.randrange(20, 60))
        if i % 9 == 0:
            for _ in range(4):
                made[rng.randrange(len(made))] = rng.choice(INSULTS)
        if i % 13 == 5:
            made[3:3] = items[i % 6][1].split()
        rows.append((i, " ".join(made), "en", "clash"))
        labels.append((i, 1, int(i % 9 == 0)))
    for i in range(300, 340):  # copies, near copies, and chains of them
        one = rows[(i * 7) % 300][1]
        rows.append((i, one.upper() if i % 2 else one + " tail" * (i % 3), "en", "clash"))
    rows += [(400, None, None, None), (401, "", "de", "x"), (None, rows[1][1], "en", "x"), (None, "lonely null id words here now", "en", "x"), (402, "A tiny ITEM tiny-item.", "en", "x")]
    rows += [(2, rows[2][1], "en", "clash"), (2, "other words under a repeated id", "en", "x"), (403, "w1 " * 3000, "en", "x")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def order(rows):
    return sorted(rows, key=repr)


def brute_exact(rows):
    best = {}
    for row in rows:
        key, rank = lower(row[1]), (row[0] is not None, row[0] or 0)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, row)
    return [row for _, row in best.values()]


def brute_near(rows):
    sets = [set(shingle_set(r[1] or "", 5).tolist()) for r in rows]
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                at[root(i)] = root(j)
    best = {}
    for i, row in enumerate(rows):
        rank = (row[0] is None, row[0] or 0)
        if root(i) not in best or rank < best[root(i)][0]:
            best[root(i)] = (rank, row)
    return [row for _, row in best.values()]


def brute_clean(rows, items):
    out = []
    for row in rows:
        have, bad = [w for w in words(row[1]) if w], False
        for _, item in items:
            item = [w for w in words(item) if w]
            n = min(10, len(item))
            wins = {tuple(item[s : s + n]) for s in range(len(item) - n + 1)} if item else set()
            bad = bad or any(tuple(have[p : p + n]) in wins for p in range(len(have) - n + 1))
        if not bad:
            out.append(row)
    return out


def brute_tokens(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    out = []
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids))
    return out


def test_run_matches_brute_force(spark, data):
    folder, rows, items = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judge = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), Scratch(spark, "t")).matcher()
    left = [r for r in rows if judge(r[1] or "") < toxicity.THRESHOLD]
    assert len(left) < len(rows) and not any(r[0] is not None and r[0] < 300 and r[0] % 9 == 0 and zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in left)
    expected = []
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (None, brute_exact, brute_near, lambda r: brute_clean(r, items), None)):
        if brute is not None:
            before = spark.createDataFrame(left, docs.schema)
            found = stage(spark, before, folder)
            left = brute(left)
            assert found.columns == docs.columns and order(map(tuple, found.collect())) == order(left), name
    expected = brute_tokens(left)
    assert order(map(tuple, corpus_pipeline.run(spark, folder).collect())) == order(expected)


def test_empty_tables(spark, data, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{data[0]}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
