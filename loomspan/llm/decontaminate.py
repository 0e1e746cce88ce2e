"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window of T words is found through its k-grams (k = min(5, T)): of every
T - k + 1 neighbouring k-gram hashes the least, the rightmost of equal ones, is
kept as a fingerprint (Schleimer, Wilkerson, Aiken, "Winnowing"), on both sides
alike, so every shared run of T words shares a fingerprint. Each fingerprint of
a document carries the word hashes around it, and a hit is extended to all
windows that contain it, whose digests must be those of benchmark windows. Fingerprints and
windows meet distinct ones of the benchmark, so repeated words or passages
never multiply: a document gives each of its windows a bounded number of times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, ascii_lower, let, row_count_at_most

WINDOW = 10
GRAM = 5
#: Fingerprints and windows of the benchmark that may be broadcast; a row is under 100 bytes.
BROADCAST_ROWS = 200_000
_SPLIT = r"[\x00-/:-`{-\x7f]+"


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z: runs of digits, ASCII letters and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SPLIT), "")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _fingerprints(h: Column, span: int) -> Column:
    """Fingerprints of windows of ``span`` words: structs of span, gram, pos, from (start of ctx) and ctx.

    Each window gives the rightmost of its least grams; a gram's low bits make room for its place in the window.
    """
    k = min(GRAM, span)
    w = span - k + 1
    bits = (w - 1).bit_length()
    n = F.greatest(F.size(h) - (k - 1), F.lit(0))
    grams = F.transform(F.slice(h, 1, n), lambda x, i: F.shiftleft(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]), bits))

    def at(m: Column, j: Column) -> Column:
        return (j + F.lit(w - 1) - m.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))).cast("int")

    def select(g: Column) -> Column:
        placed = lambda j, o: F.get(g, j + o).bitwiseOR(F.lit(w - 1 - o).cast("long"))
        whole = F.slice(g, 1, F.greatest(F.size(g) - (w - 1), F.lit(0)))
        least = F.transform(whole, lambda x, j: F.least(*[placed(j, o) for o in range(w)]) if w > 1 else x)
        chosen = F.array_distinct(F.transform(least, at))

        def item(p: Column) -> Column:
            start = F.greatest(p - (w - 1), F.lit(0))
            ctx = F.slice(h, start + 1, F.lit(span + w - 1))
            return F.struct(F.lit(span).alias("span"), F.get(g, p).alias("gram"), p.alias("pos"), start.alias("from"), ctx.alias("ctx"))

        return F.transform(chosen, item)

    return let(grams, select)


def _marked(df: DataFrame, keys: list[str], spans: list[int]) -> DataFrame:
    """One row per fingerprint of each row's column ``h``."""
    every = let(F.col("h"), lambda h: F.concat(*[_fingerprints(h, s) for s in spans]) if len(spans) > 1 else _fingerprints(h, spans[0]))
    return df.select(*keys, F.explode(every).alias("f")).select(*keys, "f.*")


def _window(words: Column, span: Column, start: Column, at: Column) -> Column:
    """The window of ``span`` hashes from ``at`` on, as its place ``start`` and a digest of 128 bits."""
    taken = F.slice(words, at + 1, span)
    return F.struct(start.alias("start"), F.xxhash64(taken, F.lit(11)).alias("one"), F.xxhash64(F.lit(13), taken).alias("two"))


def _broadcast(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if row_count_at_most(df, bound) else df


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``docs`` with a hit, one per doc_id and text: doc_id, mark (a hash of the text), n_hit, n_items, items_sha256.

    Benchmark fingerprints and windows are broadcast up to ``bound`` rows each,
    else joined by a shuffle. The benchmark's windows and the rows with hits are
    written once, as both are read twice.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), _hashes(F.col(text)).alias("h")).where("size(h) > 0")
    texts = items.select("h").distinct().select("h", F.xxhash64("h", F.lit(7)).alias("text_id"), F.least(F.size("h"), F.lit(window)).alias("span"))
    # The spans in use: at most ``window`` small numbers.
    spans = sorted({window, *(r[0] for r in texts.select("span").distinct().collect())})
    theirs = reduce(DataFrame.unionByName, [_marked(texts.where(F.col("span") == s).select("h"), [], [s]) for s in spans])
    theirs = _broadcast(theirs.select("span", "gram").distinct(), bound)
    places = F.sequence(F.lit(0), F.size("h") - F.col("span"))
    held = texts.select("text_id", "span", F.explode(F.transform(places, lambda s: _window(F.col("h"), F.col("span"), s, s))).alias("w"))
    scratch = Scratch(docs.sparkSession, "leaks")
    held = scratch.save(held.select("text_id", "span", "w.one", "w.two").distinct(), "windows")
    # Windows of the same items share one set, digested by sums, so that a passage of many items is no group in one task.
    digest = [F.count("*").alias("n"), *[F.sum(F.xxhash64("text_id", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]]
    windows = held.groupBy("span", "one", "two").agg(*digest).select("span", "one", "two", F.xxhash64("n", "s1", "s2").alias("set_id"))
    first = windows.groupBy("set_id").agg(F.min(F.struct("span", "one", "two")).alias("w")).select("set_id", "w.*")
    members = first.join(held, ["span", "one", "two"]).select("set_id", "text_id")
    names = items.select("item_id", F.xxhash64("h", F.lit(7)).alias("text_id"))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = own.select("doc_id", F.xxhash64("text").alias("mark"), _hashes(F.col("text")).alias("h"))
    met = _marked(keyed.where("size(h) > 0"), ["doc_id", "mark"], spans).join(theirs, ["span", "gram"], "left_semi")
    starts = F.filter(F.sequence("from", "pos"), lambda s: s + F.col("span") <= F.col("from") + F.size("ctx"))
    own_windows = F.transform(starts, lambda s: _window(F.col("ctx"), F.col("span"), s, s - F.col("from")))
    near = met.select("doc_id", "mark", "span", F.explode(own_windows).alias("w")).select("doc_id", "mark", "span", "w.*")
    found = near.join(_broadcast(windows, bound), ["span", "one", "two"])
    one = found.groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_set(F.struct("start", "span"))).alias("runs"), F.sort_array(F.collect_set("set_id")).alias("sets")
    )
    n_hit = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, r: F.struct(
            F.greatest(a["end"], r["start"] + r["span"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), r["start"] + r["span"] - F.greatest(a["end"], r["start"]))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )
    one = scratch.save(one.select("doc_id", "mark", n_hit.alias("n_hit"), "sets", F.xxhash64("sets").alias("sets_id")), "hits")
    # Documents with the same sets have the same items: their ids are listed and digested once.
    listed = (
        one.select("sets_id", F.explode("sets").alias("set_id")).distinct()
        .join(members, "set_id")
        .join(names, "text_id")
        .groupBy("sets_id")
        .agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
        .select("sets_id", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    return one.join(listed, "sets_id").select("doc_id", "mark", "n_hit", "n_items", "items_sha256")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of a benchmark item; an item of
    fewer words, but not none, is one window. A document word inside any
    occurrence of a window is hit. n_items counts items with occurring windows
    and items_sha256 digests their ids sorted as strings and joined by commas
    (of the empty string if none). Null texts have no words; items with the
    same words all count; equal rows get equal results; a null doc_id is kept.
    Empty tables give an empty result or no hits; other columns are ignored. Time
    and memory are linear in the words of a text, repeated ones too. Benchmark fingerprints and
    windows are broadcast up to ``bound`` rows each, else joined by a shuffle.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = hits(docs, benchmark, window, text, bound)
    named = found.withColumnsRenamed({"doc_id": "hit_doc", "mark": "hit_mark"})
    total = own.select("doc_id", F.xxhash64("text").alias("mark"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = total.join(named, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("mark") == F.col("hit_mark")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
