"""Exact dedup through a cuckoo-filter index, partitioned by digest.

Texts are equal when identical after lower-casing A-Z. The digest (SHA-256 of
the normalised UTF-8 text) is computed in the JVM; only digests and ids are
shuffled, never texts.

A digest that a third of all rows share would make one index partition hot, so
each task first folds its own rows through a local index (one row per digest
and task leaves it), and the owner of a digest range merges those. Labels go
back to the documents by a join on the digest in which only digests of two or
more rows take part; adaptive execution splits its hot partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import ascii_lower
from loomspan.llm.cuckoo import CuckooIndex

_FOLDED = "digest binary, keep_id long, group_size long"
#: Digests after which an index is written out; bounds a task's memory, not the result.
LOCAL_KEYS = 200_000


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` reduced to ``doc_id`` and the ``digest`` of the normalised text; null counts as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)).alias("digest"),
    )


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds rows of (digest, keep_id, group_size) through a ``CuckooIndex``.

    The index is emptied once it holds ``LOCAL_KEYS`` digests, all but the one
    seen last. Over rows sorted by digest one row comes out per digest; over
    unsorted rows a digest may come out again later, to be folded once more.
    """
    index = CuckooIndex(1024)
    for batch in batches:
        cols = batch.to_pydict()
        for digest, doc, size in zip(cols["digest"], cols["keep_id"], cols["group_size"]):
            seen = index.get(digest)
            if seen is None:
                index.put(digest, [doc, size])
            else:
                if doc is not None and (seen[0] is None or doc > seen[0]):
                    seen[0] = doc
                seen[1] += size
        if len(index) >= LOCAL_KEYS:
            held = index.get(digest)
            index.delete(digest)
            yield from _rows(index)
            index = CuckooIndex(1024)
            index.put(digest, held)
    yield from _rows(index)


def _rows(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    items = index.items()
    while part := list(islice(items, 50_000)):
        yield pa.record_batch(
            [
                pa.array([d for d, _ in part], pa.binary()),
                pa.array([v[0] for _, v in part], pa.int64()),
                pa.array([v[1] for _, v in part], pa.int64()),
            ],
            names=["digest", "keep_id", "group_size"],
        )


def groups(marked: DataFrame) -> DataFrame:
    """(doc_id, digest) rows to one row per digest: its largest doc_id and its number of rows."""
    local = marked.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    owned = local.mapInArrow(fold, _FOLDED).repartition("digest").sortWithinPartitions("digest")
    return owned.mapInArrow(fold, _FOLDED)


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of equal texts stays. Null and empty texts
    are one group. Rows that repeat a doc_id count each; all rows with the
    group's keep_id are kept rows. A null doc_id loses to any other; a group of
    only null ids has a null keep_id and its rows count as kept. An empty table
    gives an empty result; other columns of ``docs`` are ignored. Long texts are
    hashed whole, in the scan.
    """
    marked = digests(docs, text)
    many = groups(marked).where("group_size > 1")
    out = marked.join(many, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def apply_changes(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies a batch of changes to an index table and returns the new index table.

    ``index(digest, doc_id)`` lists the live documents, ``changes(digest,
    doc_id, op, seq)`` inserts (op 'I') and deletes (op 'D') in ascending seq. A digest
    stays live as long as one of its documents does. Both tables are placed by
    digest and document, so that a hot digest is many tasks, and replayed through a ``CuckooIndex``
    in that order: memory does not grow with the table. Deleting what is
    not live and inserting what is live change nothing; null digests are
    ignored; empty tables are fine; other columns are dropped.
    """
    start = index.select("digest", F.col("doc_id").cast("long").alias("doc_id"), F.lit("I").alias("op"), F.lit(-1).cast("long").alias("seq"))
    rows = start.unionByName(changes.select("digest", F.col("doc_id").cast("long").alias("doc_id"), "op", F.col("seq").cast("long").alias("seq")))
    placed = rows.where("digest is not null").repartition("digest", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    return placed.sortWithinPartitions("digest", "doc_id", "seq").mapInArrow(_replay, "digest binary, doc_id long")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replays changes sorted by digest, document and seq; what is settled leaves the index, so it stays small."""
    index, last, out = CuckooIndex(64), None, []

    def settle() -> None:
        if last is not None and index.delete(last[0]):
            out.append(last)

    for batch in batches:
        cols = batch.to_pydict()
        for digest, doc, op in zip(cols["digest"], cols["doc_id"], cols["op"]):
            if last != (digest, doc):
                settle()
                last = (digest, doc)
            if op == "I":
                index.put(digest, doc)
            elif op == "D":
                index.delete(digest)
        if len(out) >= 50_000:
            yield _pairs(out)
            out = []
    settle()
    yield _pairs(out)


def _pairs(rows: list[tuple[bytes, int | None]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["digest", "doc_id"])
