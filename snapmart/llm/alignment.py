"""Alignment of two tokenizers' tokens by diagonal run skipping, and links counted over the corpus.

1. *Tokens.* Both tokenizers work on the text with a space before it. Byte lengths of
   the tokens, summed up, give two rising arrays of ends.
2. *Groups.* The arrays are walked together at an index shift. As long as they agree at
   the shift, every token of one side is one of the other: such a stretch is measured by
   probes of 1, 2, 4, ... tokens and taken at once. Where they part, the side that is
   behind moves on until both end together again; this irregular group sets the shift
   that the next stretch is compared at.
3. *Links.* Tokens that end together are linked, and an id pair is counted by its links
   in the whole corpus. Documents are handled in buckets of bounded text: a bucket has a
   dictionary of its distinct pairs with their counts, and its documents hold places in
   that dictionary. Only dictionaries are shuffled, one row per (bucket, pair), summed
   per pair and sent back to their bucket, so a pair that stands in every document is no
   hot key, and neither the table of pairs nor any other is sent to all tasks but the
   largest count per B id, at most one row per entry of the vocabulary.

Tokens come from the libraries. A text is cut at single spaces between other characters:
tokenizer A's words never reach over such a space, and B's pieces hold a space only as
their first character or among spaces alone, so both sides end there together and no
group reaches over. New chunks of many texts are laid end to end, encoded and walked
once as one pair of arrays; a text is its chunks' groups in order. That a chunk is given
back byte by byte is checked, with halving to find those that are not. What is remembered
of chunks is bounded.

Defined cases: texts that are NULL, empty or not given back by the joined tokens have no
tokens, zeros, and '' for the groups; repeated rows are documents of their own and count
in the corpus; ``doc_id`` may be NULL, repeated or of any type; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from snapmart.llm.chunks import ChunkTable, laid
from snapmart.llm.common import stored
from snapmart.llm.prefix_counts import byte_of
from snapmart.llm.text_map import built, parts, slices

#: Characters of a bucket (one longer text is a bucket of its own).
BUCKET_CHARS = 8_000_000
#: Known chunks per worker process, and the longest chunk that is kept.

#: White space that is not alone between two other characters.
_ODD = re.compile(r"\s\s|\A\s|\s\Z")
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")

#: (first A, first B, one-to-one tokens, A after, B after): a stretch and the irregular group behind it.
Run = tuple[int, int, int, int, int]


def chunks_of(text: str) -> list[str]:
    return _SPACE.split(text) if _ODD.search(text) else text.split(" ")


def runs(a: list[int], b: list[int]) -> list[Run]:
    """Walk two arrays of ends that finish together."""
    out, i, j, n = [], 0, 0, len(a)
    while i < n:
        first, other, step = i, j, 1
        while a[i : i + step] == b[j : j + step] and i + step <= n:
            i, j, step = i + step, j + step, step * 2
        while step > 1:
            step //= 2
            if i + step <= n and a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
        size = i - first
        if i < n:
            left, right = a[i], b[j]
            while left != right:
                if left < right:
                    i += 1
                    left = a[i]
                else:
                    j += 1
                    right = b[j]
            i, j = i + 1, j + 1
        out.append((first, other, size, i, j))
    return out


class Aligned(NamedTuple):
    """Texts: tokens of both sides and groups (counts), groups as text, keys of the linked pairs."""

    n_a: list[int]
    n_b: list[int]
    n_groups: list[int]
    groups: list[str]
    pairs: list[np.ndarray]


#: What a chunk has whose bytes are not given back.
LOST = (-1, 0, 0, "", b"")


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [self._entry(self.a.id_to_token(i)) for i in range(size_a)]
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.size_b)]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.names = [str(i) for i in range(max(size_a, self.size_b))]
        self.table = ChunkTable(
            self._new, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        )

    @staticmethod
    def _entry(token: str | None) -> bytes:
        codes = [byte_of(c) for c in token or ""]
        return (token or "").encode() if None in codes else bytes(codes)

    @staticmethod
    def _piece(piece: str) -> bytes:
        code = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode()

    def learn(self, chunks: list[str]) -> dict[str, tuple]:
        """New chunks, laid end to end with a space before each; ``LOST`` where bytes are not given back."""
        if not chunks:
            return {}
        text = " ".join(chunks)
        body = f" {text}".encode()
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text, num_threads=1)
        if all(b"".join(map(table.__getitem__, ids)) == body for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return self._solved(chunks, a, b)
        if len(chunks) == 1:
            return {chunks[0]: LOST}
        half = len(chunks) // 2
        return {**self.learn(chunks[:half]), **self.learn(chunks[half:])}

    def _solved(self, chunks: list[str], a: list[int], b: list[int]) -> dict[str, Aligned]:
        names = self.names
        text_a, text_b = [names[t] for t in a], [names[t] for t in b]
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        last_a: list[int] = []
        last_b: list[int] = []
        groups: list[str] = []
        for i, j, size, after_a, after_b in runs(ends_a.tolist(), ends_b.tolist()):
            if size:
                last_a += range(i, i + size)
                last_b += range(j, j + size)
                groups += map("|".join, zip(text_a[i : i + size], text_b[j : j + size]))
            i, j = i + size, j + size
            if i < after_a:
                last_a.append(after_a - 1)
                last_b.append(after_b - 1)
                groups.append(",".join(text_a[i:after_a]) + "|" + ",".join(text_b[j:after_b]))
        # Both sides end at every chunk's end, so the chunks' groups are runs of groups.
        borders = np.cumsum([len(c) + 1 if c.isascii() else len(c.encode()) + 1 for c in chunks])
        pairs = (ids_a[last_a] * self.size_b + ids_b[last_b]).tobytes()
        cuts = [np.searchsorted(ends, borders, "right") for ends in (ends_a, ends_b, ends_a[last_a])]
        counts = [np.diff(c, prepend=0).tolist() for c in cuts]
        out, at = {}, 0
        for chunk, n_a, n_b, n in zip(chunks, *counts):
            end = at + n
            out[chunk] = (n_a, n_b, n, ";".join(groups[at:end]) + ";", pairs[8 * at : 8 * end])
            at = end
        return out

    def _new(self, chunks: list[str]) -> list[list]:
        # Chunks with white space at their ends would meet their neighbours.
        alone = {c for c in chunks if not c or c[0].isspace() or c[-1].isspace()}
        solved = self.learn([c for c in chunks if c not in alone])
        for c in alone:
            solved.update(self.learn([c]))
        return [list(column) for column in zip(*map(solved.__getitem__, chunks))]

    def align(self, texts: list[str]) -> Aligned:
        """Whole texts from their chunks' groups."""
        cut = [chunks_of(t) if t else [] for t in texts]
        cuts = np.cumsum([0, *map(len, cut)])
        n_a, n_b, n_groups, groups, pairs = self.table(pa.array(list(chain.from_iterable(cut)), pa.string()))

        def sums(column: pa.Array) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(column.to_numpy())])[cuts])

        # A text with a chunk that is not given back has no tokens.
        whole = np.diff(np.concatenate([[0], np.cumsum(n_a.to_numpy() < 0)])[cuts]) == 0
        texts_of, pairs_of = laid(groups, cuts), laid(pairs, cuts)
        return Aligned(
            *(np.where(whole, sums(c), 0).tolist() for c in (n_a, n_b, n_groups)),
            [str(g[:-1], "utf-8") if fine else "" for g, fine in zip(texts_of, whole)],
            [np.frombuffer(p if fine else b"", np.int64) for p, fine in zip(pairs_of, whole)],
        )


# ------------------------------------------------------------------ places in a dictionary


def packed(places: np.ndarray) -> bytes:
    """Numbers by byte planes: all lowest bytes first, so that the high ones compress to nothing."""
    return np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


_DOC = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string"
_BUCKET = "bucket bigint, places binary, pairs array<bigint>, counts array<bigint>"


def aligned_buckets(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, doc_id: str = "doc_id", text: str = "text",
    keep_groups: bool = False, bucket_chars: int = BUCKET_CHARS,
) -> DataFrame:
    """A row per document; the first of a bucket also holds the bucket's pairs and their counts."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = StructType([frame.schema["doc_id"], *_parse_datatype_string(f"{_DOC}, {_BUCKET}").fields])
    arrow = to_arrow_schema(out)
    names = [f.name for f in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = built(("aligner", tokenizer_a, tokenizer_b), lambda: Aligner(tokenizer_a, tokenizer_b))
        bucket, rows, keys, chars = TaskContext.get().partitionId() << 32, [], [], 0

        def closed() -> pa.RecordBatch:
            pairs, back, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            # Frequent pairs come first and have small places.
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            columns = {n: [r.get(n) for r in rows] for n in names}
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            columns["places"] = [packed(p) for p in np.split(rank[back], cuts)]
            columns["bucket"] = [bucket] * len(rows)
            columns["pairs"][0], columns["counts"][0] = pairs[order], counts[order]
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

        for batch in (part for whole in batches for part in parts(whole)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some_ids, some_texts in slices(ids, texts):
                size = sum(map(len, some_texts))
                if rows and chars + size > bucket_chars:
                    yield closed()
                    bucket, rows, keys, chars = bucket + 1, [], [], 0
                chars += size
                found = aligner.align(some_texts)
                keys += [p.copy() for p in found.pairs]
                for i, n_a, n_b, n, groups, pairs in zip(some_ids, *found):
                    rows.append({
                        "doc_id": i, "n_a": n_a, "n_b": n_b, "n_groups": n, "n_links": len(pairs),
                        "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if groups else "",
                        "groups": groups if keep_groups else None,
                    })
        if rows:
            yield closed()

    return frame.mapInArrow(run, out)


def pair_counts(buckets: DataFrame, n_b: int) -> DataFrame:
    """Links of each id pair in the whole corpus: pair, a, b, n."""
    listed = buckets.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    total = listed.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    return total.select("pair", F.expr(f"pair div {n_b}").alias("a"), F.expr(f"pair % {n_b}").alias("b"), "n")


def align_documents(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, doc_id: str = "doc_id", text: str = "text",
    keep_groups: bool = False, bucket_chars: int = BUCKET_CHARS,
) -> DataFrame:
    """Per document: tokens of both sides, groups, links, how many are their B id's best, and their counts' sum.

    With ``keep_groups`` also ``groups`` themselves, as text.
    """
    from sentencepiece import SentencePieceProcessor

    n_b = SentencePieceProcessor(model_file=tokenizer_b).get_piece_size()
    buckets = stored(
        aligned_buckets(docs, tokenizer_a, tokenizer_b, doc_id, text, keep_groups, bucket_chars), "aligned"
    )
    counts = stored(pair_counts(buckets, n_b), "pairs")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    rated = counts.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    listed = buckets.where("pairs is not null").select("bucket", F.posexplode("pairs").alias("place", "pair"))
    answers = listed.join(rated, "pair").select(F.col("bucket").alias("of_bucket"), "place", "n", "best")

    kept = ["doc_id", *(f.split()[0] for f in _DOC.split(", "))]
    if not keep_groups:
        kept.remove("groups")
    left = buckets.select(*kept, "bucket", "places")
    out = StructType([
        *(left.schema[c] for c in kept), *_parse_datatype_string("n_best bigint, count_sum bigint").fields
    ])
    arrow = to_arrow_schema(out)

    def rate(rows: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("place").to_numpy()
        n, is_best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], is_best[place] = known.column("n").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        found = [unpacked(p) for p in rows.column("places").to_pylist()]
        rated = {"n_best": [int(is_best[p].sum()) for p in found], "count_sum": [int(n[p].sum()) for p in found]}
        return pa.Table.from_arrays(
            [pa.array(rated[f.name], f.type) if f.name in rated else rows.column(f.name).cast(f.type) for f in arrow],
            schema=arrow,
        )

    return left.groupBy("bucket").cogroup(answers.groupBy("of_bucket")).applyInArrow(rate, out)
