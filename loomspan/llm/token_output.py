"""Token ids as wavelet matrices: a succinct file per shard that answers access, rank, count and select.

A shard is one task's range of ascending doc_ids, written as one Parquet file
of segments; each segment is a wavelet matrix over the ids of whole documents
(Claude, Navarro, Ordóñez, "The Wavelet Matrix"), 16 bit-planes with a rank
directory, beside the ids and lengths of its documents.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.bpe_stream import byte_letters
from loomspan.llm.common import Scratch
from loomspan.llm.pieces import PieceEncoder

MAGIC = b"LWM1"
LEVELS = 16
BLOCK = 4096
#: Tokens after which a segment ends with the document at hand; its planes then fit in a core's cache.
SEGMENT_TOKENS = 1 << 18
SHARD = "shard int, segment int, first_doc long, start_in_shard long, n_tokens long, doc_ids array<long>, lengths array<long>, planes binary"


class WaveletMatrix:
    """A sequence of ids below 65,536. Positions and occurrence numbers start at 0; bounds are checked."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray]) -> None:
        self.n, self.zeros, self.planes = n, zeros, planes
        self._ranks: list[np.ndarray | None] = [None] * LEVELS

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        row, zeros, planes = ids.astype(np.uint16, copy=False), [], []
        for level in range(LEVELS):
            ones = (row & np.uint16(1 << (LEVELS - 1 - level))) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            at0, at1 = np.flatnonzero(~ones), np.flatnonzero(ones)
            zeros.append(len(at0))
            row = np.concatenate([row.take(at0), row.take(at1)])
        return cls(len(ids), zeros, planes)

    def to_bytes(self) -> bytes:
        """Magic, length, zeros of each plane, then each plane with its rank directory."""
        out = [MAGIC, struct.pack("<q", self.n), struct.pack(f"<{LEVELS}q", *self.zeros)]
        for level, plane in enumerate(self.planes):
            out += [self._directory(level).astype("<u4").tobytes(), plane.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        (n,) = struct.unpack_from("<q", data, 4)
        zeros = list(struct.unpack_from(f"<{LEVELS}q", data, 12))
        at, planes, ranks = 12 + 8 * LEVELS, [], []
        blocks, size = n // BLOCK + 1, (n + 7) // 8
        for _ in range(LEVELS):
            ranks.append(np.frombuffer(data, "<u4", blocks, at))
            planes.append(np.frombuffer(data, np.uint8, size, at + 4 * blocks))
            at += 4 * blocks + size
        if at != len(data):
            raise ValueError("a wavelet matrix of wrong length")
        made = cls(n, zeros, planes)
        made._ranks = ranks
        return made

    def _directory(self, level: int) -> np.ndarray:
        """Ones before each block of ``BLOCK`` positions."""
        if self._ranks[level] is None:
            full = self.n // BLOCK
            counts = np.bitwise_count(self.planes[level][: full * BLOCK // 8]).reshape(full, BLOCK // 8)
            self._ranks[level] = np.concatenate([[0], np.cumsum(counts.sum(axis=1, dtype=np.int64))]).astype(np.uint32)
        return self._ranks[level]

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        block = i // BLOCK
        plane, first, last = self.planes[level], block * BLOCK // 8, i // 8
        n = int(self._directory(level)[block]) + int(np.bitwise_count(plane[first:last]).sum())
        return n + (int(plane[last]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else n

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(LEVELS):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before position ``i``."""
        if not 0 <= i <= self.n:
            raise IndexError(i)
        low, high = self._range(token, 0, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if not 0 <= token < 1 << LEVELS:
            return 0, 0
        for level in range(LEVELS):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (LEVELS - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def select(self, token: int, k: int) -> int:
        """Position of occurrence ``k`` of ``token``."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in reversed(range(LEVELS)):
            one = token >> (LEVELS - 1 - level) & 1
            at = self._find(level, at - self.zeros[level] if one else at, one)
        return at

    def _find(self, level: int, k: int, bit: int) -> int:
        """Position of the ``k``-th ``bit`` of a plane."""
        ones = self._directory(level).astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * BLOCK
        part = np.unpackbits(self.planes[level][first // 8 : (first + BLOCK) // 8], bitorder="little")[: self.n - first]
        return first + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes are undone from the last to the first."""
        row = np.zeros(self.n, np.uint16)
        for level in reversed(range(LEVELS)):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros, above = self.zeros[level], np.empty_like(row)
            above[np.flatnonzero(~ones)] = row[:zeros]
            above[np.flatnonzero(ones)] = row[zeros:] | np.uint16(1 << (LEVELS - 1 - level))
            row = above
        return row


@lru_cache(maxsize=2)
def library_encoder(path: str) -> PieceEncoder:
    """Ids by the tokenizers library. Pre-tokens are encoded by its model, once while they stay cached.

    The caches are bounded and live as long as the worker process, across tasks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    if library.get_vocab_size() > 1 << LEVELS:
        raise ValueError(f"ids must fit in {LEVELS} bits")
    letters = byte_letters()
    model = library.model

    def word(text: str) -> bytes:
        plain = text.isascii() and text.isprintable()
        shown = text.replace(" ", letters[32]) if plain else text.encode().decode("latin-1").translate(letters)
        ids = [t.id for t in model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}H", *ids)

    special = {str(t.content): i.to_bytes(2, "little") for i, t in library.get_added_tokens_decoder().items()}
    return PieceEncoder(word, special)


def _write_segments(path: str, end_id: int):
    tail = end_id.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = library_encoder(path), TaskContext.get().partitionId()
        docs, sizes, codes, n, start, segment = [], [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            planes = WaveletMatrix.build(np.frombuffer(b"".join(codes), "<u2")).to_bytes()
            values = [shard, segment, next((d for d in docs if d is not None), None), start, n, docs, sizes, planes]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NAMES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                code = coder.closed(text.as_py() or "", False) + tail
                docs.append(doc)
                sizes.append(len(code) // 2)
                codes.append(code)
                n += sizes[-1]
                if n >= SEGMENT_TOKENS:
                    yield row()
                    docs, sizes, codes, n, start, segment = [], [], [], 0, start + n, segment + 1
        if docs:
            yield row()

    return run


_NAMES = ["shard", "segment", "first_doc", "start_in_shard", "n_tokens", "doc_ids", "lengths", "planes"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def write_shards(docs: DataFrame, vocabulary: str, scratch: Scratch, end_id: int = 2, text: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes ``docs`` and writes shards in ascending doc_id order; returns the table read back.

    Null texts count as empty and give the end id alone; null ids come first;
    rows that repeat an id stay beside each other, shorter texts first. An empty table
    writes no segment. Segments hold whole documents, however long. A vocabulary with
    ids beyond 16 bits is refused; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.length("text"))
    return scratch.save(placed.mapInArrow(_write_segments(vocabulary, end_id), SHARD), "shards")


def shard_starts(shards: DataFrame) -> dict[int, int]:
    """Ids before each shard. One row per shard comes to the driver, as many as write tasks, not documents."""
    total, out = 0, {}
    sums = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard")
    for row in sums.collect():
        out[row["shard"]] = total
        total += row["n"]
    return out


def _read_segments(starts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, at, docs, sizes, planes = (batch.column(c)[k].as_py() for c in range(5))
                ids = WaveletMatrix.from_bytes(planes).tokens().astype("<u4")
                ends = np.cumsum(sizes)
                spans = list(zip((ends - sizes).tolist(), ends.tolist()))
                yield pa.record_batch(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array([starts[shard] + at + a for a, _ in spans], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document of written shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = shards.select("shard", "start_in_shard", "doc_ids", "lengths", "planes")
    return rows.mapInArrow(_read_segments(shard_starts(shards)), "doc_id long, start long, n_tokens long, ids_crc32 long")
