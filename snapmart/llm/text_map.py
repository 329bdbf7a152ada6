"""Apply a Python function to (doc_id, text) in slices of bounded size, inside Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Characters handled at a time in a worker (one longer text is a slice of its own), and
#: rows of an Arrow batch that are Python objects at a time.
SLICE_CHARS, SLICE_ROWS = 1_000_000, 1_000
#: Bytes of a slice that stays an Arrow array.
SLICE_BYTES = 2_000_000
#: Seconds of work after which memory that was freed goes back to the system.
RETURN_EVERY = 1.0

T = TypeVar("T")

#: Per worker process: what ``make`` built, by key. Workers are reused over tasks and
#: queries, so only what one operator needs is kept.
_BUILT: dict = {}


def _release() -> None:
    """Return freed memory to the system, which all workers of a machine share."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _give_back() -> None:
    """The same for what is unreachable, which workers of later stages would hold on to."""
    gc.collect()
    _release()


def released(items: Iterable[T]) -> Iterator[T]:
    """``items``; after the first, about every ``RETURN_EVERY`` seconds and at the end freed memory is returned.

    Allocators keep what a slice needed for a moment: 130 MB of a worker's 460 when
    packing, of no use to the other workers and stages of an executor.
    """
    last = -RETURN_EVERY
    for item in items:
        yield item
        if time.monotonic() - last >= RETURN_EVERY:
            _release()
            last = time.monotonic()
    _release()


def built(key: tuple, make: Callable):
    """Build once per worker process; what another operator built is let go first.

    An operator is the first word of its keys' names.
    """
    if key not in _BUILT:
        operator = key[0].split()[0]
        if any(held[0].split()[0] != operator for held in _BUILT):
            _BUILT.clear()
            _give_back()
        _BUILT[key] = make()
        _release()
    return _BUILT[key]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)


def slices(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SLICE_CHARS:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield ids[start:], texts[start:]


def array_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts (second column) have about ``SLICE_BYTES``; a longer text is one of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = before = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def map_texts(
    docs: DataFrame, doc_id: str, text: str, schema: str,
    function: Callable[[list, list], dict[str, list]], as_array: bool = False,
) -> DataFrame:
    """``function(ids, texts)`` gives the columns of ``schema`` for one slice.

    A NULL text arrives as an empty one. ``doc_id`` keeps its type. With ``as_array``
    the texts stay an Arrow array.
    """
    frame = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    out = StructType([frame.schema["doc_id"], *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handled() -> Iterator[dict[str, list]]:
            for batch in released(part for whole in batches for part in parts(whole)):
                if as_array:
                    for some in array_slices(batch):
                        yield function(some.column(0).to_pylist(), some.column(1))
                else:
                    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                    for some_ids, some_texts in slices(ids, texts):
                        yield function(some_ids, some_texts)

        for columns in handled():
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) for f in arrow], schema=arrow
            )

    return frame.mapInArrow(run, out)


def filter_texts(docs: DataFrame, text: str, keep: Callable[[list], list]) -> DataFrame:
    """Whole rows of ``docs`` for whose texts ``keep(texts)`` is true, in one scan."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(part for whole in batches for part in parts(whole)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            mask = [k for _, some in slices(texts, texts) for k in keep(some)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def replace_texts(docs: DataFrame, text: str, function: Callable[[list], list]) -> DataFrame:
    """``docs`` with each text replaced by its counterpart in ``function(texts)``; NULL stays."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(part for whole in batches for part in parts(whole)):
            old = batch.column(at).to_pylist()
            texts = [t or "" for t in old]
            new = [t for _, some in slices(texts, texts) for t in function(some)]
            kept = pa.array([None if o is None else n for o, n in zip(old, new)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), kept)

    return docs.mapInArrow(run, docs.schema)
