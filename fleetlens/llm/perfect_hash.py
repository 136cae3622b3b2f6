"""A minimal perfect hash over document keys, as arrays that can be stored and mapped."""

from __future__ import annotations

import numpy as np

#: Bits per key of each level: more bits, fewer levels.
_SPREAD = 2
_MOST_LEVELS = 48
_MAGIC = b"FLMPH001"
ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("row", "<u4")])


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit values for each seed (the SplitMix64 finaliser)."""
    x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(doc_ids: np.ndarray, copies: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit keys of (doc_id or NULL, copy number of a repeated id)."""
    own = mix(doc_ids.astype(np.int64).view(np.uint64), 0)
    own = np.where(null, np.uint64(0), own)
    return mix(own + copies.astype(np.uint64), 1) ^ null.astype(np.uint64)


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 99) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Level by level, keys alone on their bit stay there and the others go to the next level.

    A key's number is the count of set bits before its own. Keys beyond the last level (two
    keys of equal 64 bits never part) are listed.
    """

    def __init__(self, levels: list[np.ndarray], listed: np.ndarray):
        self.levels, self.listed = levels, listed
        words = np.concatenate(levels) if levels else np.array([], np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in levels]))).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys) and len(levels) < _MOST_LEVELS:
            bits = -(-len(keys) * _SPREAD // 64) * 64
            at = (mix(keys, 2 + len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; a key that was not built in gets any number, or -1."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            if not len(left):
                return found
            at = mix(keys[left], 2 + number) % np.uint64(len(level) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (level[word] >> bit) & np.uint64(1) == 1
            lower = level[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.before[self.starts[number] + word] + np.bitwise_count(lower)
            found[left[hit]] = rank[hit]
            left = left[~hit]
        place = np.searchsorted(self.listed, keys[left])
        inside = place < len(self.listed)
        inside[inside] = self.listed[place[inside]] == keys[left][inside]
        found[left[inside]] = self.before[-1] + place[inside]
        return found


def pack_index(keys: np.ndarray, shards: np.ndarray, rows: np.ndarray) -> bytes:
    """The index file: the hash's levels, then one (fingerprint, shard, row) per key."""
    table = PerfectHash.build(keys)
    slots = table.slots(keys)
    if len(np.unique(slots)) != len(keys):
        raise ValueError("two document keys share all 64 bits of their hash")
    entries = np.empty(len(keys), ENTRY)
    entries["fingerprint"][slots] = _fingerprints(keys)
    entries["shard"][slots], entries["row"][slots] = shards, rows
    head = np.array([len(keys), len(table.levels), len(table.listed),
                     *[len(x) for x in table.levels]], "<u8")
    return b"".join([_MAGIC, head.tobytes(), *[x.astype("<u8").tobytes() for x in table.levels],
                     table.listed.astype("<u8").tobytes(), entries.tobytes()])


class Index:
    """An index file's content: keyed access in constant time."""

    def __init__(self, content: bytes):
        if content[:len(_MAGIC)] != _MAGIC:
            raise ValueError("not an index file")
        at = len(_MAGIC)
        n, n_levels, n_listed = np.frombuffer(content, "<u8", 3, at).tolist()
        sizes = np.frombuffer(content, "<u8", n_levels, at + 24).tolist()
        at += 8 * (3 + n_levels)
        levels = []
        for size in [*sizes, n_listed]:
            levels.append(np.frombuffer(content, "<u8", size, at))
            at += 8 * size
        self.table = PerfectHash(levels[:-1], levels[-1])
        self.entries = np.frombuffer(content, ENTRY, n, at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, row) of each key, -1 where it isn't stored.

        A foreign key passes the 32-bit fingerprint with a chance of one in 4 billion.
        """
        slots = self.table.slots(keys)
        known = slots >= 0
        known[known] = self.entries["fingerprint"][slots[known]] == _fingerprints(keys[known])
        shard, row = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        shard[known] = self.entries["shard"][slots[known]]
        row[known] = self.entries["row"][slots[known]]
        return shard, row
