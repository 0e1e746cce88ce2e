"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

How far a token boundary can still move when more text arrives depends on the
merge list alone (cf. Berglund and van der Merwe, "Formalizing BPE
Tokenization", on incremental tokenization with a sufficient lookahead).
``sufficient_lookahead`` computes such a bound; the transducer encodes what it
has read, emits the tokens that end at least that far before the end and keeps
only the rest, so its memory does not grow with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.pieces import CLEAN_SPACE, WORDS, WS, PieceEncoder

CHUNK = 1 << 16
OPEN_LIMIT = 8192
NONE = 1 << 30
#: Characters whose pre-token may still change with what follows; longer than any special string here.
HELD = 16


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes from the end of a text beyond which no token can change, whatever follows.

    Take two texts with a common prefix and apply the merge list to both. The
    last boundary up to which they agree can only move left when a rule (u, v)
    joins u, which ends there, in one of them; each rule does so at most once,
    in ascending rank. After rule i moved it, the token behind it begins with
    uv in one text and with u in the other, so the next rule that moves it must have a right side
    whose left spine holds one of the two. The bound is the heaviest chain of
    such rules, each weighing as much as the bytes of its u.
    """
    left: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    worst = 0
    for u, v in merges:
        best, part = 0, v
        while part is not None:
            best = max(best, reach.get(part, 0))
            part = left.get(part)
        chain = best + len(u)
        worst = max(worst, chain)
        left.setdefault(u + v, u)
        for part in (u + v, u):
            reach[part] = max(reach.get(part, 0), chain)
    return worst + 1


class Merges:
    """Ranks and ids of a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        to_bytes = lambda token: bytes(byte_of[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        merges = [(to_bytes(a), to_bytes(b)) for a, b in pairs]
        self.id_of = {to_bytes(t): i for t, i in data["model"]["vocab"].items()}
        self.rank = {self.id_of[a] << 16 | self.id_of[b]: i for i, (a, b) in enumerate(merges)}
        self.joined = [self.id_of[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.lookahead = sufficient_lookahead(merges)
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        size = max([*self.id_of.values(), *self.special.values()]) + 1
        if size > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.bytes_of = [b""] * size
        for part, i in self.id_of.items():
            self.bytes_of[i] = part
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()

    def split(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is joined first, from the left."""
        if len(word) > 96:
            return self._split_long(word)
        ids = [self.single[b] for b in word]
        rank, joined = self.rank.get, self.joined
        ranks = [rank(a << 16 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            ids[i] = joined[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 16 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 16 | ids[i], NONE)
        return ids

    def _split_long(self, word: bytes) -> list[int]:
        """The same with a heap and links, for n log n time on long runs."""
        ids = [self.single[b] for b in word]
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 16 | ids[j]) != r:
                continue
            ids[i], ids[j] = self.joined[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(ids[a] << 16 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]


def codes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}H", *ids)


class ByteTransducer:
    """The bytes of one open pre-token to ids, emitted once they are stable."""

    def __init__(self, merges: Merges, block: int = 4096) -> None:
        self.merges = merges
        self.block = block
        self.held = b""

    def feed(self, data: bytes) -> bytes:
        out = []
        for at in range(0, len(data), self.block):
            self.held += data[at : at + self.block]
            if len(self.held) < self.merges.lookahead + self.block:
                continue
            stable, parts, used = len(self.held) - self.merges.lookahead, self.merges.split(self.held), 0
            for k, part in enumerate(parts):
                size = len(self.merges.bytes_of[part])
                if used + size > stable:
                    out.append(codes(parts[:k]))
                    break
                used += size
            self.held = self.held[used:]
        return b"".join(out)

    def finish(self) -> bytes:
        out, self.held = codes(self.merges.split(self.held)), b""
        return out


class Transducer:
    """Text in chunks of any size to ids (little-endian uint16 bytes); ``finish`` ends a document."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        special = {t: i.to_bytes(2, "little") for t, i in merges.special.items()}
        if any(len(t) >= HELD or " " in t for t in special):
            raise ValueError("special strings must be short and without spaces")
        self.pieces = PieceEncoder(self._word, special)
        self.open = ByteTransducer(merges)
        self.buffer, self.spaced, self.run = "", False, None

    def _word(self, word: str) -> bytes:
        return codes(self.merges.split(word.encode()))

    def feed(self, chunk: str) -> bytes:
        """Ids that are certain by now. ``spaced`` says that a space stands before the buffer."""
        self.buffer += chunk
        out = []
        while True:
            if self.run is not None:
                out.append(self._go_on())
                if self.run is not None:
                    return b"".join(out)
            cut = self._last_clean_space()
            if cut > 0:
                out.append(self.pieces.closed(self.buffer[:cut], self.spaced))
                self.buffer, self.spaced = self.buffer[cut + 1 :], True
            if len(self.buffer) <= OPEN_LIMIT:
                return b"".join(out)
            out.append(self._tight())

    def finish(self) -> bytes:
        if self.run is not None:
            out = self._go_on(last=True)
            if self.buffer:
                out += self.pieces.whole(self.buffer)
        elif self.buffer or self.spaced:
            out = self.pieces.closed(self.buffer, self.spaced)
        else:
            out = b""
        self.buffer, self.spaced, self.run = "", False, None
        return out

    def _last_clean_space(self) -> int:
        at = len(self.buffer)
        while (at := self.buffer.rfind(" ", 0, at)) > 0:
            if CLEAN_SPACE.match(self.buffer, at):
                return at
        return -1

    def _tight(self) -> bytes:
        """Emits from a long buffer without a clean space; may leave an open run behind."""
        out = []
        if self.spaced:
            self.buffer, self.spaced = " " + self.buffer, False
        for mark, code in self.pieces.special.items():
            while mark in self.buffer:
                head, _, self.buffer = self.buffer.partition(mark)
                out += [self.pieces.whole(head), code]
        sure, used = len(self.buffer) - HELD, 0
        for m in WORDS.finditer(self.buffer):
            if m.end() > sure:
                break
            out.append(self.pieces.whole(m[0]))
            used = m.end()
        self.buffer = self.buffer[used:]
        if len(self.buffer) > OPEN_LIMIT:
            kinds = (r"\p{L}", r"\p{N}", rf"[^{WS}\p{{L}}\p{{N}}]", f"[{WS}]")
            probe = self.buffer[1]
            self.run = next(k for k in kinds if regex.match(k, probe))
            out.append(self.open.feed(self.buffer[:1].encode()))
            self.buffer = self.buffer[1:]
        return b"".join(out)

    def _go_on(self, last: bool = False) -> bytes:
        """Carries an open run on; at its end the rest goes back to the ordinary way."""
        stop = len(self.buffer) if last else max(0, len(self.buffer) - HELD)
        marks = [at for t in self.pieces.special if (at := self.buffer.find(t)) >= 0]
        end = regex.match(f"(?:{self.run})*", self.buffer).end()
        if marks and min(marks) <= end:
            out = self.open.feed(self.buffer[: min(marks)].encode()) + self.open.finish()
            self.buffer, self.run = self.buffer[min(marks) :], None
            return out
        if end < len(self.buffer) and (last or end <= stop):
            keep = 1 if self.run == f"[{WS}]" and end > 0 else 0
            if self.run == f"[{WS}]" and end == 0:
                raise AssertionError("an open run of white space always holds its end back")
            out = self.open.feed(self.buffer[: end - keep].encode()) + self.open.finish()
            self.buffer, self.run = self.buffer[end - keep :], None
            return out
        if last:
            out = self.open.feed(self.buffer.encode()) + self.open.finish()
            self.buffer, self.run = "", None
            return out
        out = self.open.feed(self.buffer[:stop].encode())
        self.buffer = self.buffer[stop:]
        return out


class Decoder:
    """Ids to text, in blocks; bytes of an unfinished character wait for the next block."""

    def __init__(self, merges: Merges) -> None:
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def _loaded(path: str) -> Transducer:
    return Transducer(Merges(path))


def encode_parts(coder: Transducer, text: str) -> Iterator[bytes]:
    """The ids of a text as they become certain."""
    for at in range(0, len(text), CHUNK):
        yield coder.feed(text[at : at + CHUNK])
    yield coder.finish()


def encode_text(coder: Transducer, text: str) -> bytes:
    return b"".join(encode_parts(coder, text))


_DIGESTS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def _round_trip(coder: Transducer, text: str, with_ids: bool) -> tuple[int, str, str, np.ndarray | None]:
    """Number and digest of the ids, and the digest of the text decoded from them, part by part; the ids only if wanted."""
    n, parts, decoder, of_ids, of_text = 0, [], Decoder(coder.merges), hashlib.sha256(), hashlib.sha256()
    for part in encode_parts(coder, text):
        ids = np.frombuffer(part, "<u2")
        n += len(ids)
        of_ids.update(ids.astype("<u4").tobytes())
        of_text.update(decoder.feed(ids.tolist()).encode())
        if with_ids:
            parts.append(ids)
    of_text.update(decoder.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest(), np.concatenate(parts).astype("i4") if with_ids else None


def _digest_batches(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(path)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    rows = [_round_trip(coder, t.as_py() or "", with_ids) for t in batch.column(1)[at : at + 256]]
                    cols = [batch.column(0)[at : at + 256]]
                    cols += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                    if with_ids:
                        cols.append(pa.array([r[3] for r in rows], pa.list_(pa.int32())))
                    yield pa.record_batch(cols, names=_DIGESTS + ["ids"] * with_ids)
        finally:
            coder.pieces.rest()

    return run


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (array of int).

    Null and empty texts have an empty array. Special strings of the vocabulary
    stand for their ids. Texts of any length are streamed in chunks; rows that
    repeat give equal rows; an empty table gives an empty result.
    """
    return _coded(docs, vocabulary, text, True)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``tokens`` (doc_id, ids) to (doc_id, text); null ids give a null text, broken UTF-8 U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _loaded(vocabulary).merges
        for batch in batches:
            out = []
            for row in batch.column(1):
                decoder = Decoder(merges)
                out.append(None if (given := row.as_py()) is None else decoder.feed(given) + decoder.finish())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_decode_digests(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """The same without ids, which are digested and decoded as they come: memory does not grow with the text."""
    return _coded(docs, vocabulary, text, False)


def _coded(docs: DataFrame, vocabulary: str, text: str, with_ids: bool) -> DataFrame:
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _doc_text(docs, text).mapInArrow(_digest_batches(vocabulary, with_ids), schema)


def _doc_text(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
