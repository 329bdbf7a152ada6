"""A hash table of 64-bit keys in arrays: many keys are looked up at once."""

from __future__ import annotations

import numpy as np


class KeyTable:
    """Open addressing at a load of at most a quarter; keys are distinct."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int64)  # -1 where a slot is free
        left, step = np.arange(len(keys)), 0
        slots = self._slots(keys.astype(np.uint64))
        while len(left):
            at = (slots[left] + step) & (len(self.keys) - 1)
            _, first = np.unique(at, return_index=True)
            mine = first[self.values[at[first]] < 0]
            self.keys[at[mine]], self.values[at[mine]] = keys[left[mine]], values[left[mine]]
            left, step = np.delete(left, mine), step + 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; -1 for those that are not in the table."""
        at = self._slots(keys)
        out = self.values[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        out[wrong] = -1
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            held = self.values[at[wrong]]
            hit = (held >= 0) & (self.keys[at[wrong]] == keys[wrong])
            out[wrong[hit]] = held[hit]
            wrong = wrong[(held >= 0) & ~hit]
        return out


class SubstringTable:
    """Which entries of a vocabulary lie where in many words, by packed bytes.

    Up to eight bytes are a key by themselves. Longer entries are looked up one by one,
    at the places whose eight bytes begin one.
    """

    WIDTH = 8

    def __init__(self, entries: dict[bytes, int]):
        by_size: list[dict[int, int]] = [{} for _ in range(self.WIDTH + 1)]
        self.long: dict[bytes, int] = {}
        for entry, value in entries.items():
            if len(entry) <= self.WIDTH:
                by_size[len(entry)][int.from_bytes(entry)] = value
            else:
                self.long[entry] = value
        self.tables = [_table(t) for t in by_size]
        self.heads = _table({int.from_bytes(e[: self.WIDTH]): 1 for e in self.long})
        self.longest = max(map(len, entries), default=0)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, value) of every entry in every word."""
        sizes = np.array([len(w) for w in words], np.int64)
        body = b"".join(words)
        data = np.frombuffer(body + bytes(self.WIDTH), np.uint8).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), sizes)
        first = np.cumsum(sizes) - sizes
        start = np.arange(len(word)) - first[word]
        room = sizes[word] - start
        place, found = np.arange(len(word)), []
        keys = np.zeros(len(word), np.uint64)
        for size in range(1, self.WIDTH + 1):
            inside = room >= size
            place, keys, room = place[inside], keys[inside], room[inside]
            keys = (keys << np.uint64(8)) | data[place + size - 1]
            value = self.tables[size].find(keys)
            hit = np.flatnonzero(value >= 0)
            at = place[hit]
            found.append((word[at], start[at], start[at] + size, value[hit]))
        if self.long:
            more = []
            for at in place[self.heads.find(keys) >= 0].tolist():
                w, s = int(word[at]), int(start[at])
                top = min(int(sizes[w]) - s, self.longest)
                for size in range(self.WIDTH + 1, top + 1):
                    value = self.long.get(body[at : at + size])
                    if value is not None:
                        more.append((w, s, s + size, value))
            if more:
                found.append(tuple(np.array(more, np.int64).T))
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def _table(held: dict[int, int]) -> KeyTable:
    return KeyTable(np.fromiter(held, np.uint64, len(held)), np.fromiter(held.values(), np.int64, len(held)))
