"""Whitespace-separated chunks, encoded once per distinct chunk of a worker.

For a tokenizer that drops white space and never joins over it, a text's tokens are
its chunks' tokens in order. Distinct chunks are encoded in batches; what is remembered
of them is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from operator import add
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters that the tokenizer's patterns take as white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: What Python's split() takes as white space beyond these.
ODD = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile(f"[^{SPACE}]+")
#: The chunks of a text with their places.
WORDS = _SPLIT.finditer

#: Entries of a generation of remembered chunks or words, and the longest that is kept.
KNOWN, LONG = 120_000, 200
#: Chunks that stay when a table of arrays, about 30 bytes each, has twice as many.
TABLE = 250_000


def chunks_of(text: str) -> list[str]:
    return _SPLIT.findall(text) if ODD.search(text) else text.split()


def key_of(chunk: str) -> tuple[str, str]:
    """A chunk's word in lower case and its last full stop or comma, where they are encoded apart.

    True of Latin letters: the patterns cut before the mark, lower-casing keeps letters
    letters, and normalisation leaves both alone. Other chunks are keys of their own.
    """
    word, mark = (chunk[:-1], chunk[-1]) if chunk.endswith((".", ",")) else (chunk, "")
    if word.isalpha() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word):
        return word.lower(), mark
    return chunk, ""


class Recent:
    """What was solved lately: two generations, the older one let go when the newer is full.

    What is asked for again moves to the newer one, so frequent entries stay while the
    many that occur once pass through. At most about twice ``KNOWN`` are held.
    """

    def __init__(self) -> None:
        self.new: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def take(self, keys: Iterable[str]) -> tuple[dict[str, Any], list[str]]:
        """Entries that are known, and keys that are not."""
        found, missing = {}, []
        new, old = self.new.get, self.old.get
        for k in keys:
            v = new(k)
            if v is None:
                v = old(k)
                if v is None:
                    missing.append(k)
                    continue
                self.new[k] = v
            found[k] = v
        return found, missing

    def add(self, entries: Mapping[str, Any]) -> None:
        """Remember entries that are not too long, for as long as they are of use."""
        if len(self.new) + len(entries) > KNOWN:
            self.old, self.new = self.new, {}
        self.new.update((k, v) for k, v in entries.items() if len(k) <= LONG)
        while len(self.new) > KNOWN:  # more at once than a generation holds
            self.new.popitem()


class ChunkTable:
    """Values of chunks, looked up and laid out as Arrow arrays; only new chunks are Python strings.

    ``solve`` gives, for new chunks, one list per type. Solved chunks are kept as arrays;
    when there are twice ``TABLE`` of them, those used last stay.
    """

    def __init__(self, solve: Callable[[list[str]], list[list]], types: list[pa.DataType]):
        self.solve, self.types = solve, types
        self.keys = pa.array([], pa.string())
        self.values = [pa.array([], t) for t in types]
        self.used = np.zeros(0, np.int64)
        self.clock = 0

    def __call__(self, flat: pa.Array) -> list[pa.Array]:
        """The values of every occurrence, in order."""
        coded = flat.dictionary_encode()
        distinct, n = coded.dictionary, len(self.keys)
        # The side that is hashed for the look-up is the slice's, which is the smaller one.
        at = pc.index_in(self.keys, value_set=distinct).fill_null(-1).to_numpy()
        held = np.flatnonzero(at >= 0)
        place = np.full(len(distinct), -1, np.int64)
        place[at[held]] = held
        new = distinct.filter(pa.array(place < 0))
        self.clock += 1
        self.used[place[place >= 0]] = self.clock
        values = self.values
        if len(new):
            place[place < 0] = n + np.arange(len(new))
            solved = self.solve(new.to_pylist())
            values = [pa.concat_arrays([old, pa.array(v, t)]) for old, v, t in zip(values, solved, self.types)]
            self._keep(new, values)
        return [v.take(pa.array(place[coded.indices.to_numpy()])) for v in values]

    def _keep(self, new: pa.Array, values: list[pa.Array]) -> None:
        """Remember new chunks that are not too long; make room if there are too many."""
        keys = pa.concat_arrays([self.keys, new])
        used = np.append(self.used, np.full(len(new), self.clock))
        stay = pc.binary_length(keys).to_numpy() <= LONG
        if stay.sum() > 2 * TABLE:
            last = np.where(stay, used, -1)
            stay = np.zeros(len(keys), bool)
            stay[np.argpartition(last, len(keys) - TABLE)[len(keys) - TABLE :]] = True
            stay &= last >= 0
        if not stay.all():
            kept = pa.array(np.flatnonzero(stay))
            keys, values, used = keys.take(kept), [v.take(kept) for v in values], used[stay]
        self.keys, self.values, self.used = keys, values, used


@dataclass(frozen=True)
class Laid:
    """Texts' bytes, one after the other, and the bytes before each of them."""

    data: memoryview
    at: list[int]

    def __len__(self) -> int:
        return len(self.at) - 1

    def __getitem__(self, i: int) -> memoryview:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return self.data[self.at[i] : self.at[i + 1]]


def laid(values: pa.Array, cuts: np.ndarray) -> Laid:
    """Runs of ``values``, bounded by ``cuts``, each joined."""
    if not len(values):
        return Laid(memoryview(b""), [0] * len(cuts))
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return Laid(memoryview(data) if data is not None else memoryview(b""), bounds[cuts].tolist())


class ChunkEncoder:
    """Ids of whole texts from those of their distinct chunks, and words of ids if asked for.

    ``encode`` gives little-endian unsigned 32-bit ids per chunk; ``decode`` (optional)
    the words of ids, each with a space behind it.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], decode: Callable[[bytes], str] | None = None):
        self.encode, self.decode = encode, decode
        self.keys = Recent()
        self.table = ChunkTable(self._solved, [pa.binary(), *([pa.string()] if decode else [])])

    def __call__(self, texts: pa.Array) -> list[Laid]:
        """Ids of every text; with ``decode`` also its words, each with a space behind it."""
        if pc.any(pc.match_substring_regex(texts, ODD.pattern)).as_py():
            cut = pa.array([chunks_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            cut = pc.utf8_split_whitespace(texts)
        cuts = cut.offsets.to_numpy().astype(np.int64)
        return [laid(v, cuts - cuts[0]) for v in self.table(cut.flatten())]

    def _solved(self, chunks: list[str]) -> list[list]:
        """New chunks, by the keys that they share."""
        keys, marks = zip(*map(key_of, chunks)) if chunks else ((), ())
        # White space at a text's ends leaves empty chunks.
        entries, wanted = self.keys.take({".", ",", *keys} - {""})
        ids = self.encode(wanted)
        new = dict(zip(wanted, zip(ids, map(self.decode, ids)) if self.decode else ids))
        self.keys.add(new)
        entries.update(new)
        entries[""] = (b"", "") if self.decode else b""
        heads, tails = map(entries.__getitem__, keys), map(entries.__getitem__, marks)
        if not self.decode:
            return [list(map(add, heads, tails))]
        both = list(zip(heads, tails))
        return [[a + b for (a, _), (b, _) in both], [a + b for (_, a), (_, b) in both]]
