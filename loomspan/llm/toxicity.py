"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are the entries of a fixed lexicon of insults, and words and word
beginnings (patterns) whose presence goes with toxic rows of a bounded sample of the labelled
training rows. A generative model is fitted by expectation maximisation over
labelled and unlabelled training rows: it estimates each voter's rates, and those of
the annotators, who are one more voter and abstain on unlabelled rows; correlated voters
(a word and its beginnings, words of one phrase) share their weight, by the
correlations left once the label is known. Its posterior labels train a
logistic regression over the same features, which scores every text.
Labels of held-out rows, lang, source and doc_id are never seen by a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, row_count_at_most

#: Labelled and unlabelled rows the models are fitted on, at most; taken by a hash of doc_id.
SAMPLE_ROWS = 8_000
UNLABELLED_ROWS = 2_000
#: Voters beside the lexicon at most, the strongest; rows such a voter must have voted on.
VOTERS = 1_000
LEAST_VOTES = 3
STEMS = (4, 5, 6, 7)
#: Labelled ids that may be broadcast to tell unlabelled rows.
BROADCAST_LABELS = 1_000_000
THRESHOLD = 0.3
# Common insults of four languages, the lexicon voters.
LEXICON = (
    "idiot idiots idiotic stupid moron morons moronic loser losers scum trash worthless pathetic disgusting clown dumb fool fools foolish "
    "imbecile jerk creep freak vermin filth filthy garbage lowlife bastard pig swine dimwit halfwit retard retarded ugly "
    "dummkopf trottel vollidiot arschloch abschaum widerlich dreckig schwein versager wertlos blöd hässlich "
    "imbécile crétin connard salaud ordure minable dégoûtant abruti débile racaille raté "
    "idiota imbécil estúpido estúpida basura asqueroso patético inútil payaso escoria fracasado gilipollas cabrón"
).split()
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Distinct lower-case words of a whole text, and their beginnings marked by a star."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:k] + "*" for w in found for k in STEMS if len(w) >= k}


@dataclass
class Model:
    """Weights by feature and a bias; ``score`` is the posterior of label 1."""

    weights: dict[str, float]
    bias: float

    def matcher(self):
        """A function of text that looks every distinct word up once and caches what it means."""
        weights, known = self.weights, {}

        def parts(word: str) -> tuple[str, ...]:
            names = (word, *(word[:k] + "*" for k in STEMS if len(word) >= k))
            hit = tuple(n for n in names if n in weights)
            if len(known) >= 300_000:
                known.clear()
            known[word] = hit
            return hit

        def score(text: str) -> float:
            hits: set[str] = set()
            for word in set(_WORD.findall(text.lower())):
                found = known.get(word)
                if found is None:
                    found = parts(word)
                if found:
                    hits.update(found)
            z = self.bias + sum(weights[h] for h in sorted(hits))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pos, neg = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            (pos if label else neg).update(features(text.as_py() or ""))
    names = list(pos | neg)
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.record_batch(
            [pa.array(part, pa.string()), *(pa.array([c[n] for n in part], pa.int64()) for c in (pos, neg))], names=["name", "pos", "neg"]
        )


def _found(places: dict[str, int]):
    """Rows (label, places): which of the named features each text holds, as sorted numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(places[f] for f in features(t.as_py() or "") if f in places) for t in batch.column(0)]
            yield pa.record_batch([batch.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["label", "places"])

    return run


def strongest(rows: DataFrame, n_pos: int, n_neg: int, voters: int) -> list[str]:
    """The features of rows (text, label) that go with toxic rows, strongest first and ``voters`` at most; counts of both labels meet in Spark."""
    counted = rows.mapInArrow(_count, "name string, pos long, neg long").groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    able = counted.where(F.col("pos") >= LEAST_VOTES).select("name", "pos", odds.alias("odds")).where("odds > 1.5")
    return [r["name"] for r in able.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "name").limit(voters).select("name").collect()]


def label_model(votes: np.ndarray, seen: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 per row, and each voter's rates of voting on toxic and on clean rows.

    ``votes`` is rows by voters (0 or 1); ``seen`` holds the annotators' label or
    NaN. They are one more voter: right nine times in ten at first, then as
    often as the rows say. A voter's evidence is divided by the square root of the sum
    of its absolute correlations with all voters within the classes, so that a
    crowd of dependent voters counts less than its number.
    """
    n, k = votes.shape
    seen = seen.astype(float)
    told, yes = ~np.isnan(seen), seen == 1
    right, wrong = 0.9, 0.1
    post = np.where(told, np.where(yes, 0.95, 0.05 * prior), prior)
    share = np.ones(k)
    rate1 = rate0 = np.full(k, 0.5)
    for turn in range(rounds):
        w1, w0 = post.sum() + 2, (1 - post).sum() + 2
        rate1 = np.clip((votes.T @ post + 0.2) / w1, 1e-4, 1 - 1e-4)
        rate0 = np.clip((votes.T @ (1 - post) + 0.02) / w0, 1e-4, 1 - 1e-4)
        if turn:
            right = (post[yes].sum() + 9) / (post[told].sum() + 10)
            wrong = ((1 - post[yes]).sum() + 1) / ((1 - post[told]).sum() + 10)
        if turn % 8 == 0:
            rest = votes - np.where(post[:, None] > 0.5, rate1.astype(np.float32), rate0.astype(np.float32))
            rest /= np.sqrt(np.einsum("ij,ij->j", rest, rest)) + 1e-9
            share = 1 / np.maximum(1.0, np.abs(rest.T @ rest).sum(axis=1) ** 0.5)
        up = share * (np.log(rate1) - np.log(rate0))
        down = share * (np.log1p(-rate1) - np.log1p(-rate0))
        given = np.where(told, np.where(yes, np.log(right / wrong), np.log((1 - right) / (1 - wrong))), 0.0)
        z = np.log(prior / (1 - prior)) + given + votes @ (up - down) + down.sum()
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post, rate1, rate0


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by accelerated gradient steps.

    Equal columns are fitted as one and share its weight. The step follows the
    largest eigenvalue, found by power iteration.
    """
    first: dict[bytes, int] = {}
    packed = np.packbits(x.T > 0, axis=1)
    where = np.array([first.setdefault(row.tobytes(), len(first)) for row in packed])
    size = np.bincount(where)
    cols = np.ones((len(x), len(size) + 1), np.float32)
    cols[:, where] = x
    cols[:, :-1] *= np.sqrt(size).astype(np.float32)
    n, k = cols.shape
    top = np.ones(k, np.float32)
    for _ in range(20):
        top = cols.T @ (cols @ top) / n
        top /= np.linalg.norm(top) + 1e-12
    step = 1 / (0.3 * float(top @ (cols.T @ (cols @ top))) / n + l2)
    keep = np.full(k, l2, np.float32)
    keep[-1] = 0
    w = np.zeros(k, np.float32)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, y = w.copy(), y.astype(np.float32)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(cols @ v, -30, 30)))
        new = v - step * (cols.T @ (p - y) / n + keep * v)
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1][where] / np.sqrt(size[where]), float(w[-1])


def fit(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str = "text", sample_rows: int = SAMPLE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS
) -> Model:
    """Fits on at most ``sample_rows`` labelled and ``unlabelled_rows`` other rows whose crc32(doc_id) mod 4 is not 2.

    What comes to the driver is bounded by the samples and the number of voters: names of the
    best features and, per sampled row, which voters it holds. Rows with a null
    label or id are left out; of a doc_id labelled twice one label is taken; rows that repeat a
    labelled doc_id all count. Without labelled rows of both kinds the model gives the prior to all.
    The texts of the sample are written once, below ``scratch``.
    """
    training = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(training & F.col("toxic").isNotNull())
    known = (
        marks.groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    marked = F.broadcast(marks.select("doc_id").distinct()) if row_count_at_most(marks, BROADCAST_LABELS) else marks.select("doc_id")
    free = own.select("doc_id").where(training).join(marked, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled_rows)
    wanted = known.unionByName(free.distinct().withColumn("label", F.lit(None).cast("int")))
    rows = scratch.save(own.join(F.broadcast(wanted), "doc_id").select("text", "label"), "sample").coalesce(16)
    kinds = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_pos, n_neg = kinds.get(1, 0), kinds.get(0, 0)
    if not n_pos or not n_neg:
        return Model({}, 4.0 if n_pos else -4.0)
    best = strongest(rows.where("label is not null"), n_pos, n_neg, VOTERS)
    voters = {name: k for k, name in enumerate(dict.fromkeys([*LEXICON, *best]))}
    votes, given, at = np.zeros((sum(kinds.values()), len(voters)), np.float32), [], 0
    for row in rows.mapInArrow(_found(voters), "label int, places array<int>").toLocalIterator():
        votes[at, row["places"]] = 1
        given.append(np.nan if row["label"] is None else row["label"])
        at += 1
    post, rate1, rate0 = label_model(votes, np.array(given, np.float32), n_pos / (n_pos + n_neg))
    weights, bias = logistic(votes, post)
    return Model({name: float(weights[k]) for name, k in voters.items()}, bias)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.matcher()
        for batch in batches:
            out = [score(t.as_py() or "") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts count as empty and, like texts without any voter, score the
    model's bias. held_out of a null doc_id is null. Equal texts score alike; an empty table
    gives an empty result; other columns are ignored; long texts are scored whole.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    scored = own.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``THRESHOLD``; nulls count as empty texts."""
    at, field = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.matcher()
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py() or "") < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, field)
