"""A cuckoo filter over digests, and an index whose buckets hold the keys that make its answers exact.

The filter holds 16-bit fingerprints, four to a bucket, and supports insertion
and deletion (Fan et al., "Cuckoo Filter: Practically Better Than Bloom").
``CuckooIndex`` keeps each live digest in a cell beside its fingerprint: a
filter miss proves a digest is new, a hit opens the cells of that bucket with the same
fingerprint and compares keys, and an insertion that finds no free slot
rebuilds a filter twice as large from the keys in the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

SLOTS = 4
MAX_KICKS = 250


class CuckooFilter:
    """Fingerprints of digests, each with a cell that moves along; ``add`` is False when no slot can be freed."""

    def __init__(self, buckets: int) -> None:
        self.mask = (1 << max(1, (buckets - 1).bit_length())) - 1
        self.rows: list[list[int]] = [[] for _ in range(self.mask + 1)]
        self.cells: list[list[object]] = [[] for _ in range(self.mask + 1)]

    def place(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint and the two buckets of a digest."""
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self.place(digest)
        return mark in self.rows[one] or mark in self.rows[two]

    def add(self, digest: bytes, cell: object = None) -> bool:
        mark, one, two = self.place(digest)
        for at in (one, two):
            if len(self.rows[at]) < SLOTS:
                self.rows[at].append(mark)
                self.cells[at].append(cell)
                return True
        at = one
        trail = []
        for kick in range(MAX_KICKS):
            slot = (kick * 7 + mark) % SLOTS
            trail.append((at, slot, self.rows[at][slot], self.cells[at][slot]))
            self.rows[at][slot], mark = mark, self.rows[at][slot]
            self.cells[at][slot], cell = cell, self.cells[at][slot]
            at = self._other(at, mark)
            if len(self.rows[at]) < SLOTS:
                self.rows[at].append(mark)
                self.cells[at].append(cell)
                return True
        for at, slot, old, held in reversed(trail):
            self.rows[at][slot], self.cells[at][slot] = old, held
        return False

    def remove(self, digest: bytes) -> bool:
        mark, one, two = self.place(digest)
        for at in (one, two):
            if mark in self.rows[at]:
                self.take(at, self.rows[at].index(mark))
                return True
        return False

    def take(self, bucket: int, slot: int) -> None:
        """Empties one slot and its cell."""
        del self.rows[bucket][slot], self.cells[bucket][slot]


class CuckooIndex:
    """Live digests, each with what the caller stores for it.

    ``get`` of a digest that is not live is None. ``put`` inserts or replaces;
    ``delete`` of a digest that is not live is False. Two digests with the same
    fingerprint and buckets are told apart by the keys in their cells.
    """

    def __init__(self, buckets: int = 64) -> None:
        self.filter = CuckooFilter(buckets)
        self.size = 0
        self.resized = 0
        self.false_hits = 0

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        """Bucket and slot of a live digest."""
        mark, one, two = self.filter.place(digest)
        hit = False
        for at in (one, two) if one != two else (one,):
            row = self.filter.rows[at]
            if mark in row:
                hit = True
                for slot, cell in enumerate(self.filter.cells[at]):
                    if row[slot] == mark and cell[0] == digest:
                        return at, slot
        self.false_hits += hit
        return None

    def get(self, digest: bytes):
        found = self._find(digest)
        return None if found is None else self.filter.cells[found[0]][found[1]][1]

    def put(self, digest: bytes, value: object) -> None:
        found = self._find(digest)
        if found is not None:
            self.filter.cells[found[0]][found[1]][1] = value
            return
        cell = [digest, value]
        self.size += 1
        if not self.filter.add(digest, cell):
            self._grow(cell)

    def delete(self, digest: bytes) -> bool:
        found = self._find(digest)
        if found is None:
            return False
        self.filter.take(*found)
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for row in self.filter.cells:
            for digest, value in row:
                yield digest, value

    def _grow(self, late: list) -> None:
        cells = [cell for row in self.filter.cells for cell in row] + [late]
        size = (self.filter.mask + 1) * 2
        while True:
            self.resized += 1
            bigger = CuckooFilter(size)
            if all(bigger.add(cell[0], cell) for cell in cells):
                self.filter = bigger
                return
            size *= 2

    def __len__(self) -> int:
        return self.size
