"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; each piece is encoded by itself in
two tiers.  Pieces that are whole vocabulary entries are found by a minimal
perfect hash over the vocabulary (hash and displace, one 32-bit displacement
for each entry, exact comparison of the entry found).  All others are merged
from their bytes: a heap holds the mergeable neighbour pairs of a linked list
by (rank, position), so that the lowest rank, leftmost first, merges next.

The work is a map over Arrow batches: no shuffle, memory bounded by one batch
and two lookup memories that are emptied at a fixed size.

Defined cases: null and empty texts give no ids and decode to nothing; long
texts are encoded whole; repeated rows are encoded alike; null ids (of the
vocabulary) don't occur; extra columns stay as they are.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import fresh, per_text, struct

#: Entries of a generation that a task remembers; it keeps two.
REMEMBERED = 3 << 16
ALL = (1 << 64) - 1
#: A space that starts no piece with what follows it.
LOOSE_SPACE = re.compile(r" (?!\S)").search


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, by id."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    entries = [b""] * len(rows)
    for token, rank in rows:
        entries[int(rank)] = base64.b64decode(token)
    return entries


class PerfectHash:
    """A minimal perfect hash from the entries to 0..n-1 and on to their ids."""

    def __init__(self, entries: list[bytes]) -> None:
        n = self.n = len(entries)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, entries), np.uint64, n)
        groups: dict[int, list[int]] = {}
        for i, b in enumerate((hashes >> np.uint64(32)) % np.uint64(n)):
            groups.setdefault(int(b), []).append(i)
        self.displaced = np.zeros(n, np.int64)
        slots = [-1] * n
        single = []
        for bucket, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                single.append((bucket, members[0]))
                continue
            own, d = hashes[members], 1
            while True:
                at = _slot(own, np.int64(d), n).tolist()
                if len(set(at)) == len(at) and all(slots[a] < 0 for a in at):
                    break
                d += 1
            self.displaced[bucket] = d
            for a, i in zip(at, members, strict=True):
                slots[a] = i
        free = iter([a for a, i in enumerate(slots) if i < 0])
        for bucket, i in single:  # one entry needs no search: its slot is written down
            a = next(free)
            self.displaced[bucket] = -a - 1
            slots[a] = i
        self.__setstate__((n, self.displaced, np.array(slots, np.int64), [entries[i] for i in slots]))

    def __getstate__(self) -> tuple:
        return self.n, self.displaced, self.ids, self.keys

    def __setstate__(self, state: tuple) -> None:
        self.n, self.displaced, self.ids, self.keys = state
        self.placed = list(zip(self.keys, self.ids.tolist(), strict=True))
        self.moves = self.displaced.tolist()

    def find(self, piece: bytes) -> int:
        """The id of a piece, or -1."""
        h = xxhash.xxh3_64_intdigest(piece)
        d = self.moves[(h >> 32) % self.n]
        if d < 0:
            key, i = self.placed[-d - 1]
        else:
            x = (h ^ (d * 0x9E3779B97F4A7C15 & ALL)) * 0xD6E8FEB86659FD93 & ALL
            key, i = self.placed[(x ^ (x >> 32)) % self.n]
        return i if key == piece else -1


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ (np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


#: Marks that make one piece after letters, whatever follows.
MARKS = "!#$%&*,.:;?|"


class Memory(dict):
    """What ``make`` has made of a key.  When a generation is full, a new one begins and the one before the last goes;
    what is still in use moves on."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class Encoder:
    """Encodes texts by one vocabulary, given as its perfect hash."""

    def __init__(self, table: PerfectHash, pattern: str) -> None:
        self.find = table.find
        entries = [key for _, key in sorted(zip(table.ids.tolist(), table.keys, strict=True))]
        self.cut = regex.compile(pattern).findall
        self.bytes = [table.find(bytes([b])) for b in range(256)]
        # from two entries' ids, as left << 32 | right, to the id of both joined, or -1
        self.pairs = Memory(lambda key: table.find(entries[key >> 32] + entries[key & 0xFFFFFFFF]))
        own = self.bytes
        self.first = [table.find(entries[a] + entries[b]) for a in own for b in own]  # joins of two bytes
        self.pieces = Memory(self._piece)
        self.parts = Memory(self._part)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no entry itself.

        ``joins[i]`` is the rank of the pair that begins at byte i; a heap
        item holds for as long as its rank stands there."""
        pairs, n = self.pairs, len(piece)
        first, own = self.first, self.bytes
        ids = [own[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joins = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        heap = [r * n + i for i, r in enumerate(joins) if r >= 0]
        joins.append(-1)
        heapify(heap)
        while heap:
            item = heappop(heap)
            i = item % n
            rank = item // n
            if joins[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], joins[j] = rank, -1, -1
            if k < n:
                before[k] = i
                r = joins[i] = pairs[rank << 32 | ids[k]]
                if r >= 0:
                    heappush(heap, r * n + i)
            else:
                joins[i] = -1
            if (h := before[i]) >= 0:
                r = joins[h] = pairs[ids[h] << 32 | rank]
                if r >= 0:
                    heappush(heap, r * n + h)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        i = self.find(raw)
        ids = [i] if i >= 0 else self.merge(raw)
        return pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        """The packed ids of a space and a part."""
        letters = part.rstrip(MARKS)
        if letters.isalpha():
            if len(letters) == len(part):
                return self._piece(" " + part)
            return self.parts[letters] + self.pieces[part[len(letters):]]
        return self._run(" " + part)

    def _run(self, text: str) -> bytes:
        """The packed ids of a text that is cut by the pattern as it stands."""
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        A space before other than white space always starts a piece, and no
        piece depends on what precedes it; so texts are cut there first, and
        each such part is looked up by itself."""
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif LOOSE_SPACE(t):
                out.append(self._run(t))
            else:
                first, *rest = t.split(" ")
                out.append(self._run(first) + b"".join(map(self.parts.__getitem__, rest)))
        return out


def decode(entries: list[bytes], packed: list[bytes | None]) -> list[bytes]:
    """The bytes that packed ids stand for."""
    entry = entries.__getitem__
    return [b"".join(map(entry, np.frombuffer(p or b"", "<u4").tolist())) for p in packed]


def encoded(text: Column | str, path: str, pattern: str) -> Column:
    """The ids of a text column: binary, little-endian unsigned 32-bit integers.  ``path`` names the rank file,
    read here, by the driver."""
    table = PerfectHash(read_ranks(path))

    def make():
        encoder = Encoder(table, pattern)
        return lambda texts: {"ids": encoder.encode(texts)}

    return per_text(make, struct(ids="binary"), text)["ids"]


def decoded(ids: Column | str, path: str) -> Column:
    """The bytes that a column of packed ids stands for."""
    entries = read_ranks(path)

    return per_text(lambda: lambda packed: {"bytes": decode(entries, packed)}, struct(bytes="binary"), ids)["bytes"]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` and their packed ids."""
    return docs.withColumn(ids, encoded(F.col(text), path, pattern))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and the SHA-256 of their ids and of the bytes decoded from these, both in
    lower-case hex, and the packed ids themselves as column ``keep``, if named.  Columns of these names are replaced.
    Encoding and decoding share one pass and one Python worker."""
    entries = read_ranks(path)
    table = PerfectHash(entries)

    def make():
        encoder = Encoder(table, pattern)

        def both(texts):
            ids = encoder.encode(texts)
            return {"ids": ids, "bytes": decode(entries, ids)}
        return both

    both = fresh(docs, "round_trip")
    out = docs.withColumn(both, per_text(make, struct(ids="binary", bytes="binary"), F.col(text)))
    ids = F.col(both)["ids"]
    return out.withColumns({
        "n_tokens": (F.octet_length(ids) / 4).cast("long"), "ids_sha256": F.sha2(ids, 256),
        "decoded_sha256": F.sha2(F.col(both)["bytes"], 256),
    } | ({keep: ids} if keep else {})).drop(both)
