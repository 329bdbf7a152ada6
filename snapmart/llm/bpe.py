"""Byte-pair merges: exact merging, merge histories, and the compatibility of neighbours.

A token sequence is what merging gives if and only if every token is what merging
gives for its own symbols and every adjacent pair stays apart. Two neighbours stay
apart when no merge across their border comes up before one of the two border
tokens is used up by a merge of its own side. The border tokens over time are the
right spine of the left tree and the left spine of the right tree, so the test walks
both trees back from the end, always undoing the later merge. It is done for whole
arrays of pairs.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

NEVER = np.int64(1) << 40
#: Symbols up to which a heap does not pay; what a pair that never merges has.
SHORT = 24
_NO_MERGE = (1 << 60, -1)


class Merges:
    """The vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *self.specials.values()])
        self.text_of = [""] * size
        for token, i in [*self.vocab.items(), *self.specials.items()]:
            self.text_of[i] = token
        cut = len(self.suffix)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault((self.vocab[a], self.vocab[b]), (k, self.vocab[a + b]))
        self.longest = max(
            len(t) - cut * (bool(cut) and t.endswith(self.suffix)) for t in self.vocab
        )
        self.size = size
        self._histories()
        keys = np.fromiter((a * size + b for a, b in self.rank), np.int64, len(self.rank))
        self._index(keys, np.fromiter((r for r, _ in self.rank.values()), np.int64, len(keys)))

    def _index(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """A hash table in arrays; pairs whose slot is taken go to a second one without clashes."""
        self._tables = []
        for bits, tries in ((20, 1), (20, 1000)):
            for k in range(tries):
                factor = np.random.default_rng([bits, tries, k]).integers(1 << 62, dtype=np.int64) | 1
                slot = self._slot(keys, factor, bits)
                taken, first = np.unique(slot, return_index=True)
                if len(taken) == len(keys) or tries == 1:
                    break
            table, held = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER)
            table[slot[first]], held[slot[first]] = keys[first], ranks[first]
            self._tables.append((factor, bits, table, held))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, ranks = keys[rest], ranks[rest]
        assert not len(keys), "clashing pairs of tokens"

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.int64, bits: int) -> np.ndarray:
        return ((keys * factor) >> np.int64(64 - bits)) & np.int64((1 << bits) - 1)

    def symbols(self, piece: str) -> list[int] | None:
        """Ids of the single symbols; None where one is not in the vocabulary."""
        if not piece:
            return []
        parts = [*piece[:-1], piece[-1] + self.suffix]
        ids = [self.vocab.get(p) for p in parts]
        return None if None in ids else ids

    def merged(self, ids: list[int], log: dict | None = None) -> list[int]:
        """Exact merging: lowest rank first, leftmost first; a heap over a linked list."""
        n = len(ids)
        if n <= SHORT and log is None:
            return self._merged_short(list(ids))
        ids = list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            hit = self.rank.get((ids[i], ids[i + 1]))
            if hit:
                heap.append((hit[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            whole = self.rank[a, b][1]
            if log is not None:
                log[whole] = (a, b, rank)
            ids[i], gone[j] = whole, True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n:
                    hit = self.rank.get((ids[p], ids[q]))
                    if hit:
                        heapq.heappush(heap, (hit[0], p, ids[p], ids[q]))
        return [t for t, dead in zip(ids, gone) if not dead]

    def _merged_short(self, ids: list[int]) -> list[int]:
        """The same for few symbols: the lowest of all ranks, again and again."""
        get, none = self.rank.get, _NO_MERGE
        hits = [get(pair, none) for pair in zip(ids, ids[1:])]
        while hits:
            best = min(hits)  # ranks differ, so of equal ones all are the same merge
            if best is none:
                break
            i = hits.index(best)
            ids[i : i + 2] = [best[1]]
            del hits[i]
            if i:
                hits[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(hits):
                hits[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _histories(self) -> None:
        """For every token: is it what merging gives for its symbols, and from which two parts."""
        self.sound = np.zeros(self.size, bool)
        self.birth = np.full(self.size, -1, np.int64)
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        cut = len(self.suffix)
        for token, i in self.vocab.items():
            ended = bool(cut) and token.endswith(self.suffix) and len(token) > cut
            body = token[: len(token) - cut] if ended else token
            parts = [*body[:-1], body[-1] + self.suffix] if ended else [*body]
            ids = [self.vocab.get(p) for p in parts]
            if None in ids:
                continue
            log: dict = {}
            if self.merged(ids, log) == [i]:
                self.sound[i] = True
                if i in log:
                    self.left[i], self.right[i], self.birth[i] = log[i]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * np.int64(self.size) + b
        out = np.full(len(keys), NEVER)
        for factor, bits, table, held in self._tables:
            slot = self._slot(keys, factor, bits)
            hit = table[slot] == keys
            out[hit] = held[slot[hit]]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stays two tokens."""
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_used, y_used = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            rank = self.pair_ranks(x, y)
            # Of equal merges the left one comes first.
            merges = (rank < x_used) & (rank <= y_used)
            good[at[merges]] = False
            bx, by = self.birth[x], self.birth[y]
            undo_x = bx > by
            on = ~merges & ((bx >= 0) | (by >= 0))
            x_used = np.where(undo_x, bx, x_used)[on]
            y_used = np.where(undo_x, y_used, by)[on]
            x, y = np.where(undo_x, self.right[x], x)[on], np.where(undo_x, y, self.left[y])[on]
            at = at[on]
        return good
