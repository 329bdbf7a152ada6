"""Repeated byte strings by prefix doubling over blocks of positions.

Ranks are identities of the strings at a position: words of 8 bytes, then 64-bit hashes of
the pair of ranks at pos and pos + offset, which doubles the length to a gram (32 bytes of
100) and on to the wanted length. Nothing is written per position; a string of the wanted
length, a window, goes by the least gram rank inside it (of equal ones the leftmost). Equal
windows have the same least gram at the same place, so a window can only repeat one that
shares its gram.

1. Windows in a row that share the position of their least gram form a block, about one for
   every 32 bytes: a row of gram, rank of the block's whole text, place and number of
   windows. Blocks of equal rank hold the same windows, so all but the earliest of them are
   repeats as a whole. Tasks settle copies among the documents they hold by themselves.
2. The earliest block of each rank is compared with the earliest blocks of other ranks only
   if they share its gram. They are cut into parts of at most 8 windows, at fixed distances
   from the gram. All windows of a part share its core of 93 bytes; a row of its rank and of
   the up to 7 bytes before and after it tells the part's windows. Equal parts settle as
   blocks do.
3. Only unlike parts with the same core are taken apart into windows, by those bytes.

No window of another gram, place or core can be equal, and no later block or part of a kind
holds a window that the earliest of its kind lacks, so no repeat is lost. Windows are equal
when the gram (48 bits of its rank), the core (64) and the bytes beside the core are.

A string is a repeat where it also starts earlier: in a smaller doc_id, or earlier in
the same document. The bytes that repeats cover are removed from the whole text.

Defined cases: a NULL text is empty; texts shorter than the length lose nothing; ties
don't occur, as positions differ; rows repeated with their doc_id and text count as one
document and each get its result; other texts of one doc_id are judged by their own bytes,
strings that start at the same position not being earlier; a NULL doc_id comes before all
others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapmart.llm.common import stored

#: Windows looked at in one go, so that their arrays stay in the processor's cache.
SLAB = (1 << 16) - 256
#: Windows of a part; the bytes beside their core, one fewer, fit a long.
PART = 8
#: Bytes of text whose blocks a task holds at a time.
SHARE = 1 << 25
#: Rows handed on at a time.
ROWS = 200_000
#: Stands for a NULL doc_id inside the operator.
NO_ID = -(1 << 63)
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of ranks."""
    out = right ^ (right >> np.uint64(31))
    out *= _A
    out += left
    out ^= out >> np.uint64(29)
    out *= _B
    out ^= out >> np.uint64(32)
    out *= _C
    return out


def gram_size(length: int) -> int:
    """The largest power of two that fits twice into the length."""
    return 1 << max(0, (length // 2).bit_length() - 1)


def gram_ranks(data: np.ndarray, size: int) -> np.ndarray:
    """The rank of the ``size`` bytes (a power of two) at every position."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    words = np.ndarray(len(data), np.dtype("<u8"), padded, strides=(1,)).copy()
    if size < 8:
        words &= np.uint64((1 << 8 * size) - 1)
    ranks = mixed(words, words)
    width = 8
    while width < size:
        ranks = mixed(ranks[:-width], ranks[width:])
        width *= 2
    return ranks[:n]


def longer_ranks(ranks: np.ndarray, size: int, length: int, at: np.ndarray) -> np.ndarray:
    """The ranks of ``length`` bytes at some positions, from those of ``size`` bytes."""
    if length == size:
        return ranks[at]
    half = size
    while 2 * half < length:
        half *= 2
    return mixed(longer_ranks(ranks, size, half, at), longer_ranks(ranks, size, half, at + length - half))


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring keys."""
    n, done = len(keys) - width + 1, 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    return np.minimum(keys[:n], keys[width - done : width - done + n])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins, with the end of the last."""
    _, where, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _low_bits(length: int) -> np.uint64:
    """Bits of a key that hold a place among the windows looked at in one go."""
    return np.uint64((max(SLAB, 2 * length) + length).bit_length())


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of some SHARE bytes of text each, with those bytes and where each text begins."""
    for batch in batches:
        begins = _bytes(batch.column("text"))[1][:-1]
        edges = [0, *(np.flatnonzero(np.diff(begins // SHARE)) + 1), batch.num_rows]
        for low, high in pairwise(edges):
            rows = batch.slice(low, high - low)
            yield rows, *_bytes(rows.column("text"))


def _follows(text: np.ndarray, at: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which blocks begin where the one before them ends, in the same text."""
    out = np.zeros(len(at), bool)
    out[1:] = (text[1:] == text[:-1]) & (at[1:] == at[:-1] + windows[:-1])
    return out


def _joined(over: np.ndarray, follows: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours that are repeats as a whole become one: which rows stay, and their windows."""
    joins = over & follows
    joins[1:] &= over[:-1]
    heads = np.flatnonzero(~joins)
    return heads, np.add.reduceat(windows, heads) if len(heads) else windows


def text_blocks(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the texts end to end: gram, rank, place and number of windows of every block.

    Blocks that equal the one right before them, as in runs of one character, are repeats;
    neighbours of that kind come as one (last column: ``over``).
    """
    size = gram_size(length)
    slab = max(SLAB, 2 * length)
    low = _low_bits(length)
    long = np.diff(ends) >= length
    first, last = ends[:-1][long], ends[1:][long] - length + 1
    kinds = (np.uint64, np.uint64, np.int64, np.int64, bool)
    out: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, k) for k in kinds)]
    for begin in range(0, len(data) - length + 1, slab):
        count = min(slab, len(data) - length + 1 - begin)
        ranks = gram_ranks(data[begin : begin + count + length - 1], size)
        keys = (ranks >> low << low) | np.arange(len(ranks), dtype=np.uint64)
        keys = least(keys, length - size + 1)
        cuts = [np.zeros(1, np.int64), np.flatnonzero(keys[1:] != keys[:-1]) + 1]
        for edge in (first, last):
            cuts.append(edge[np.searchsorted(edge, begin) : np.searchsorted(edge, begin + count)] - begin)
        starts = np.unique(np.concatenate(cuts))
        windows = np.diff(starts, append=count)
        text = np.searchsorted(first, starts + begin, "right") - 1
        inside = (text >= 0) & (starts + begin < last[text]) if len(last) else np.zeros(len(starts), bool)
        starts, windows, text = starts[inside], windows[inside], text[inside]
        ahead, behind = (longer_ranks(ranks, size, length, x) for x in (starts, starts + windows - 1))
        block = mixed(mixed(ahead, behind), windows.astype(np.uint64))
        gram, follows = keys[starts] >> low, _follows(text, starts, windows)
        over = follows.copy()
        over[1:] &= (gram[1:] == gram[:-1]) & (block[1:] == block[:-1])
        heads, windows = _joined(over, follows, windows)
        out.append((gram[heads], block[heads], starts[heads] + begin, windows, over[heads]))
    return tuple(np.concatenate(x) for x in zip(*out))


def settled(gram: np.ndarray, block: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which blocks have an equal one at an earlier place among these."""
    out = np.zeros(len(block), bool)
    order = np.argsort(block)
    same = block[order][1:] == block[order][:-1]
    some = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
    some = some[np.lexsort((pos[some], doc[some], gram[some], block[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (block[some][1:] != block[some][:-1]) | (gram[some][1:] != gram[some][:-1])
    head = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    out[some] = (doc[some] != doc[head]) | (pos[some] != pos[head])
    return out


def _blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in _shares(batches):
            gram, block, at, windows, over = text_blocks(data, ends, length)
            row = np.searchsorted(ends, at, "right") - 1
            doc, key = (rows.column(c).to_numpy()[row] for c in ("doc", "key"))
            pos = at - ends[row]
            over |= settled(gram, block, doc, pos)
            heads, windows = _joined(over, _follows(row, at, windows), windows)
            gram, block, doc, key, pos, over = (x[heads] for x in (gram, block, doc, key, pos, over))
            gram = np.where(over, mixed(block, pos.astype(np.uint64)), gram)  # they may go to any partition
            columns = (gram.view(np.int64), block.view(np.int64), doc, key, pos.astype(np.int32),
                       windows.astype(np.int32), over)
            whole = pa.RecordBatch.from_arrays(
                [pa.array(x) for x in columns], ["gram", "block", "doc", "key", "pos", "n", "over"]
            )
            for k in range(0, len(heads), ROWS):
                yield whole.slice(k, ROWS)

    return run


def parts_of(data: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Blocks of ``n`` windows, end to end, cut into parts of at most PART windows.

    Parts are cut at fixed distances from the least gram. Returns block, first window's place
    in the block, place of that window in the part, number of windows, rank of the bytes that
    all windows of a whole part share (the core), and the bytes before and after the core that
    the part's windows reach, the nearest lowest.
    """
    size, many = gram_size(length), min(PART, length)
    low = _low_bits(length)
    wide = n + length - 1
    before = np.cumsum(wide) - wide
    ranks = gram_ranks(data, size)
    keys = least((ranks >> low << low) | np.arange(len(ranks), dtype=np.uint64), length - size + 1)
    anchor = (keys[before] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64) - before
    most, fewest = anchor // many, (anchor - n + 1) // many
    count = most - fewest + 1
    block = np.repeat(np.arange(len(n)), count)
    number = np.repeat(most + np.cumsum(count) - count, count) - np.arange(count.sum())
    begin = anchor[block] - number * many - many + 1
    first = np.maximum(begin, 0)
    last = np.minimum(begin + many, n[block]) - 1
    skipped, reach = first - begin, last - begin
    at = begin + before[block]
    inner = length - many + 1
    own = gram_size(inner)
    core = longer_ranks(ranks if own == size else gram_ranks(data, own), own, inner, at + many - 1)
    core = mixed(core, number.astype(np.uint64))
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    left, right = (np.ndarray(len(data) + 9, np.dtype(k), padded, strides=(1,)) for k in (">u8", "<u8"))
    bits = [(np.uint64(1) << (8 * k).astype(np.uint64)) - np.uint64(1) for k in (many - 1 - skipped, reach)]
    left = left[at + many - 1].astype(np.uint64) & bits[0]
    right = right[np.minimum(at + length, len(data)) + 8].astype(np.uint64) & bits[1]
    return block, first, skipped, last - first + 1, core, left, right


def _parts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in _shares(batches):
            blocks = rows.column("blocks")
            row = np.repeat(np.arange(len(blocks)), blocks.value_lengths().to_numpy())
            pos, n, gram = (blocks.flatten().field(c).to_numpy().astype(np.int64) for c in ("pos", "n", "gram"))
            doc, key = (rows.column(c).to_numpy()[row] for c in ("doc", "key"))
            some = max(1, SLAB // (2 * length))
            for k in range(0, len(row), some):
                wide = n[k : k + some] + length - 1
                before = np.cumsum(wide) - wide
                place = np.arange(wide.sum()) + np.repeat(ends[row[k : k + some]] + pos[k : k + some] - before, wide)
                block, first, skipped, windows, *ranks = parts_of(data[place], n[k : k + some], length)
                of = block + k
                small = (x.astype(np.int32) for x in (pos[of] + first, skipped, windows))
                columns = [gram[of], *(x.view(np.int64) for x in ranks), doc[of], key[of], *small]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in columns],
                    ["gram", "core", "before", "after", "doc", "key", "pos", "skipped", "n"],
                )

    return run


def _judged(parts: DataFrame, shared: list[str], own: list[str]) -> DataFrame:
    """Parts that hold repeats as a whole (``over``), and those whose windows have to be compared."""
    earlier = Window.partitionBy(*shared, *own).orderBy("doc", "pos")
    return (
        parts.repartition(*shared)
        .withColumn("place", F.rank().over(earlier))
        .withColumn("kinds", F.sum((F.col("place") == 1).cast("int")).over(Window.partitionBy(*shared)))
        .withColumn("over", F.col("over") | (F.col("place") > 1))
        .where("over or kinds > 1")
        .drop("place", "kinds")
    )


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, key, pos, n) of n neighbouring ``length``-byte strings that also start earlier."""
    blocks = docs.mapInArrow(
        _blocks(length), "gram long, block long, doc long, key long, pos int, n int, over boolean"
    )
    blocks = stored(_judged(blocks, ["gram"], ["block"]).drop("block"), "blocks")
    unlike = blocks.where("not over").groupBy("doc", "key").agg(
        F.collect_list(F.struct("pos", "n", "gram")).alias("blocks")
    )
    parts = docs.join(unlike, ["doc", "key"]).mapInArrow(
        _parts(length),
        "gram long, core long, before long, after long, doc long, key long, pos int, skipped int, n int",
    ).withColumn("over", F.lit(False))
    parts = stored(_judged(parts, ["gram", "core"], ["before", "after", "skipped", "n"]), "parts")
    last = min(PART, length) - 1
    windows = (
        parts.where("not over")
        .withColumn("step", F.explode(F.expr("sequence(skipped, skipped + n - 1)")))
        .select(
            "gram", "core", "step", "doc", "key", F.expr("pos + step - skipped").alias("pos"),
            F.expr(f"before & (shiftleft(1L, 8 * ({last} - step)) - 1)").alias("before"),
            F.expr("after & (shiftleft(1L, 8 * step) - 1)").alias("after"),
        )
    )
    earlier = Window.partitionBy("gram", "core", "step", "before", "after").orderBy("doc", "pos")
    later = windows.withColumn("place", F.rank().over(earlier)).where("place > 1").withColumn("n", F.lit(1))
    found = [x.select("doc", "key", "pos", "n") for x in (blocks.where("over"), parts.where("over"), later)]
    return found[0].unionAll(found[1]).unionAll(found[2])


def suffix_dedup(
    docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), "text"
    )
    found = repeats(source.select("doc", "key", "text"), length)
    starts = found.groupBy("doc", "key").agg(F.collect_list(F.struct("pos", "n")).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _bytes(batch.column("text"))
            out: list[list] = [[], [], [], []]
            for i, at in enumerate(batch.column("starts")):
                whole = data[ends[i] : ends[i + 1]]
                removed = spans = 0
                kept = whole
                if at.is_valid:
                    change = np.zeros(len(whole) + 1, np.int32)
                    pos, n = (at.values.field(c).to_numpy() for c in ("pos", "n"))
                    np.add.at(change, pos, 1)
                    np.add.at(change, pos + n + (length - 1), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                    kept = whole[~gone]
                    removed = len(whole) - len(kept)
                for column, value in zip(out, (len(whole), removed, spans, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return source.join(starts, ["doc", "key"], "left").select("doc_id", "text", "starts").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
