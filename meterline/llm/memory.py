"""What a Python worker remembers between chunks and tasks: byte strings of up to 24 bytes as exact keys of a table in numpy."""

from __future__ import annotations

import numpy as np

from .blocks import mix

#: A key is three words of eight bytes; the last byte of the last word holds the length, so that no two strings share a key.
LANES = 3
KEY_BYTES = 8 * LANES - 1
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes with room for a read of a whole key behind the last one."""
    out = np.zeros(len(data) + 8 * LANES + 8, np.uint8)
    out[: len(data)] = data
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position of padded bytes on, as one integer, without a copy."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def keys_of(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LANES x n: keys of ranges of at most KEY_BYTES bytes."""
    out = np.zeros((LANES, len(starts)), np.uint64)
    out[0] = view[starts] & _MASKS[np.minimum(sizes, 8)]
    for lane in range(1, LANES):
        some = np.flatnonzero(sizes > 8 * lane)
        out[lane, some] = view[starts[some] + 8 * lane] & _MASKS[np.minimum(sizes[some] - 8 * lane, 8)]
    out[-1] |= sizes.astype(np.uint64) << np.uint64(56)
    return out


def hashes(keys: np.ndarray) -> np.ndarray:
    total = keys[0] * _ODD[0]
    for lane in range(1, len(keys)):
        total = total ^ (keys[lane] * _ODD[lane] + (total >> np.uint64(29)))
    return mix(total)


class Slots:
    """Open addressing over lanes of keys; keys are only ever added."""

    def __init__(self, lanes: int, capacity: int):
        size = 1 << int(2 * capacity - 1).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros((lanes, size), np.uint64)
        self.values = np.full(size, -1, np.int64)
        self.held = 0

    def find(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where there is none; ``at`` is the hash of each key."""
        out = np.full(keys.shape[1], -1, np.int64)
        asked, slot = None, (at & self.mask).astype(np.int64)
        while len(slot):
            value = self.values[slot]
            equal = value >= 0
            for lane in range(len(keys)):
                equal &= self.keys[lane][slot] == (keys[lane] if asked is None else keys[lane][asked])
            if asked is None:
                out[equal] = value[equal]
                asked = np.flatnonzero(~equal & (value >= 0))
                slot = slot[asked]
            else:
                out[asked[equal]] = value[equal]
                on = ~equal & (value >= 0)
                asked, slot = asked[on], slot[on]
            slot = (slot + 1) & int(self.mask)
        return out

    def add(self, keys: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        """Keys that the table doesn't have, each once."""
        left, slot = np.arange(keys.shape[1]), (at & self.mask).astype(np.int64)
        while len(left):
            # Of several keys that meet in one free slot the first has it.
            won = self._owner(slot, left, self.values[slot] < 0) == left
            self.values[slot[won]] = values[left[won]]
            self.keys[:, slot[won]] = keys[:, left[won]]
            left, slot = left[~won], (slot[~won] + 1) & int(self.mask)
        self.held += keys.shape[1]

    @staticmethod
    def _owner(slot: np.ndarray, left: np.ndarray, free: np.ndarray) -> np.ndarray:
        """For each asker of a free slot, the first one that asks for the same slot."""
        out = np.full(len(left), -1, np.int64)
        some = np.flatnonzero(free)
        distinct, first, which = np.unique(slot[some], return_index=True, return_inverse=True)
        out[some] = left[some[first[which]]]
        return out


class Memory:
    """Values of up to ``capacity`` keys used last, or thereabouts: keys go to a young table; when that is full it becomes the
    old one, and what the old one still holds of use is taken over key by key."""

    def __init__(self, capacity: int, lanes: int = LANES):
        self.lanes, self.room = lanes, max(1, capacity // 2)
        self.young, self.old = Slots(lanes, self.room), None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key (lanes x n), -1 where it isn't remembered."""
        at = hashes(keys)
        out = self.young.find(keys, at)
        if self.old is not None and len(miss := np.flatnonzero(out < 0)):
            older = self.old.find(keys[:, miss], at[miss])
            out[miss] = older
            again = miss[older >= 0]
            if len(again):
                again = again[distinct(keys[:, again])[0]]
                self.put(keys[:, again], out[again])
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once, with values of 0 or more."""
        for lo in range(0, keys.shape[1], self.room):
            some, told = keys[:, lo : lo + self.room], values[lo : lo + self.room]
            if self.young.held + some.shape[1] > self.room:
                self.old, self.young = self.young, Slots(self.lanes, self.room)
            self.young.add(some, hashes(some), told)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one holder of each distinct key, number of the distinct key of each)."""
    n = keys.shape[1]
    order = np.lexsort(keys)
    fresh = np.ones(n, bool)
    fresh[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(fresh) - 1
    return order[fresh], which
