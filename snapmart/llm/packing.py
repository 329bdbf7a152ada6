"""Best-fit packing of documents into sequences by exact complements.

1. *Pieces.* One pass tokenises every document, ends it with id 0 and cuts only what
   is longer than a sequence. Rows of a few numbers are written to the shared folder.
2. *Plan.* Only the number of pieces per length matters, at most ``size`` counts
   whatever the corpus. For each length, longest first, its gap is filled exactly by
   one, two or three lengths out of the index of sums, as often as the counts allow;
   what has no exact complement is placed best-fit. The plan is a list of templates
   (how often, which lengths), some thousand rows at most, since every step uses up
   a length or a group of open sequences.
3. *Places.* Pieces of a length are numbered without gathering them anywhere: rows are
   counted per (length, bucket), buckets are summed up, and rows are numbered inside
   their bucket. The number decides template, sequence and offset.

Defined cases: a NULL or empty text is the end id alone, a piece of length 1; an empty
table gives no rows; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from snapmart.llm.chunks import ChunkEncoder
from snapmart.llm.common import stored
from snapmart.llm.text_map import built, map_texts

#: The id that ends a document.
END = 0
#: Pieces per bucket when pieces of a length are numbered.
BUCKET = 20_000

Template = tuple[int, list[tuple[int, int]]]


def _library(path: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    suffix = library.model.end_of_word_suffix
    ends = np.zeros(library.get_vocab_size(), bool)
    if suffix:
        ends[[i for t, i in library.get_vocab().items() if t.endswith(suffix)]] = True

    def encode(chunks: list[str]) -> list[bytes]:
        """Words of letters as one text, cut where a token ends a word; other chunks one by one."""
        words = [c for c in chunks if c.isalpha()]
        ids = np.array(library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) != len(words):  # some are several words, or hold what the vocabulary lacks
            words, ids = [], ids[:0]
        data, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        out = {c: data[a:b] for c, a, b in zip(words, at, at[1:])}
        rest = [c for c in chunks if c not in out]
        out.update(zip(rest, (
            array("I", e.ids).tobytes() for e in library.encode_batch_fast(rest, add_special_tokens=False)
        )))
        return [out[c] for c in chunks]

    return ChunkEncoder(encode)


def pieces(
    docs: DataFrame, tokenizer: str, size: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id and its pieces: piece, start, length, ids_crc32."""
    end = array("I", [END]).tobytes()

    def function(ids: list, texts: pa.Array) -> dict[str, list]:
        encoder = built(("library", tokenizer), lambda: _library(tokenizer))
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        (encoded,) = encoder(texts)
        for i, body in zip(ids, encoded):
            whole = len(body) // 4 + 1
            for piece, at in enumerate(range(0, whole, size)):
                stop = min(at + size, whole)
                checksum = zlib.crc32(body[4 * at : 4 * stop])
                out["doc_id"].append(i)
                out["piece"].append(piece)
                out["start"].append(at)
                out["length"].append(stop - at)
                out["ids_crc32"].append(zlib.crc32(end, checksum) if stop == whole else checksum)
        return out

    schema = "piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_texts(docs, doc_id, text, schema, function, as_array=True)


class _Stock:
    """Pieces left per length, and the index of sums of two lengths."""

    def __init__(self, counts: np.ndarray):
        self.left = counts
        self.sums: dict[int, list[tuple[int, int]]] = {}
        self._rebuild()

    def _rebuild(self) -> None:
        have = np.flatnonzero(self.left)
        self.have = have[::-1].tolist()
        self.pair_at: dict[int, int] = {}
        present = self.left > 0
        size = len(self.left)
        # For each sum the longest first part that has its second part in stock.
        for a in have.tolist():
            reach = np.flatnonzero(present[: min(a, size - 1 - a) + 1])
            self.pair_at.update(zip((reach + a).tolist(), [a] * len(reach)))

    def times(self, parts: tuple[int, ...]) -> int:
        """How often the parts can be taken together."""
        return min(int(self.left[p]) // parts.count(p) for p in set(parts))

    def pair(self, gap: int, taken: tuple[int, ...], most: int) -> tuple[int, ...] | None:
        """Two lengths that fill the gap beside ``taken``, the first at most ``most`` and the longer."""
        top, low = self.pair_at.get(gap), (gap - 1) // 2
        if top is None:
            return None
        # Stock only falls, so an entry that is used up is lowered for good.
        while top > low and not (self.left[top] and self.left[gap - top]):
            top -= 1
        if top <= low:
            self.pair_at.pop(gap)
            return None
        self.pair_at[gap] = top
        high = min(top, most)
        if high <= low:
            return None
        both = (self.left[low + 1 : high + 1] > 0) & (self.left[gap - high : gap - low][::-1] > 0)
        for at in np.flatnonzero(both)[::-1].tolist():
            a = low + 1 + at
            if self.times((*taken, a, gap - a)):
                return a, gap - a
        return None

    def triple(self, gap: int, first: int) -> tuple[int, ...] | None:
        for a in self.have:
            if 3 * a < gap:
                break
            if a > gap - 2 or not self.left[a]:
                continue
            rest = self.pair(gap - a, (first, a), a)
            if rest is not None:
                return a, *rest
        return None


def plan(lengths: dict[int, int], size: int) -> list[Template]:
    """Templates (how often, [(length, how many)]) that hold every piece."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in lengths.items():
        counts[length] = n
    out: list[Template] = []
    if counts[size]:
        out.append((int(counts[size]), [(size, 1)]))
        counts[size] = 0
    stock = _Stock(counts)
    for first in range(size - 1, 0, -1):
        gap = size - first
        while counts[first]:
            parts: tuple[int, ...] | None = (gap,) if stock.times((first, gap)) else None
            parts = parts or stock.pair(gap, (first,), gap - 1) or stock.triple(gap, first)
            if parts is None:
                break
            often = stock.times((first, *parts))
            for p in (first, *parts):
                counts[p] -= often
            out.append((often, [(p, 1) for p in (first, *parts)]))
    return out + _best_fit(counts, size)


def _best_fit(counts: np.ndarray, size: int) -> list[Template]:
    """Longest first, each into the fullest open sequence that still takes it; groups move together."""
    room: dict[int, list[Template]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fit = min((g for g in room if g >= length), default=None)
            if fit is None:
                per = size // length
                often, rest = divmod(left, per)
                if often:
                    room.setdefault(size - per * length, []).append((often, [(length, per)]))
                if rest:
                    room.setdefault(size - rest * length, []).append((1, [(length, rest)]))
                break
            often, parts = room[fit].pop()
            if not room[fit]:
                del room[fit]
            used = min(often, left)
            if often > used:
                room.setdefault(fit, []).append((often - used, parts))
            room.setdefault(fit - length, []).append((used, [*parts, (length, 1)]))
            left -= used
    return [t for group in room.values() for t in group]


def slots(templates: list[Template]) -> np.ndarray:
    """Rows (length, first number, pieces per sequence, first sequence, offset), sorted."""
    rows, taken, sequence = [], {}, 0
    for often, parts in templates:
        offset = 0
        for length, k in parts:
            rows.append((length, taken.get(length, 0), k, sequence, offset))
            taken[length] = taken.get(length, 0) + often * k
            offset += length * k
        sequence += often
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, tokenizer: str, size: int = 2048, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, tokenizer, size, doc_id, text), "pieces")
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(lengths, size))
    buckets = max(1, -(-sum(lengths.values()) // BUCKET))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .select(
            "length", "bucket",
            F.coalesce(
                F.sum("n").over(
                    Window.partitionBy("length").orderBy("bucket")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("before"),
        )
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(before, ["length", "bucket"])
    frame = numbered.select(
        *cut.columns, (F.col("before") + F.col("inside")).cast("long").alias("number")
    )
    out = StructType(
        [*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]
    )
    arrow = to_arrow_schema(out)
    stride = np.int64(1) << 42
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * stride + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            row = table[np.searchsorted(keys, length * stride + number, "right") - 1]
            ahead = number - row[:, 1]
            sequence = row[:, 3] + ahead // row[:, 2]
            offset = row[:, 4] + ahead % row[:, 2] * length
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], schema=arrow
            )

    return frame.mapInArrow(place, out)
