"""Tokenisation operators against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from snapmart.llm import text_map
from snapmart.llm import chunks
from snapmart.llm.bpe import Merges
from snapmart.llm.bpe_codec import Codec, bpe_round_trip
from snapmart.llm.chunks import ChunkTable
from snapmart.llm.key_table import KeyTable, SubstringTable
from snapmart.llm.packing import _Stock, pack, plan, slots
from snapmart.llm.prefix_counts import (
    PrefixCounter, fit_chars, prefix_table, token_counts, tokens_of_prefix,
)
from snapmart.llm.queries import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ALPHABET = "abcdeghinorst aABC'’sßéüñΣİ123.,!?-_ \n\t  日本🙂́\x1c<|>&/w"
TEXTS = [
    None, "", " ", "Hello wörld's don't we'll", "a<|endoftext|>b <|startoftext|>x", "aaaa" * 200, "-" * 300,
    "  two  spaces \n\n and lines \n", "ΑΣ ΑΣ", "it's we're they've I'll 're", "x" * 30_000, "the same", "the same",
]


def texts(n=60):
    r = random.Random(4)
    return TEXTS + ["".join(r.choice(ALPHABET) for _ in range(r.randrange(70))) for _ in range(n)]


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    schema = "doc_id long, text string, length long, key string, rank int"
    return spark.createDataFrame([(i, t, 1, "k", 2) for i, t in enumerate(rows)], schema)


def test_codec_equals_the_library(spark):
    library, rows = Tokenizer.from_file(WORD), texts()
    got = {r["doc_id"]: r for r in bpe_round_trip(frame(spark, rows), WORD, keep_ids=True).collect()}
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["decoded"] == decoded, t
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_compatibility_is_what_merging_says():
    merges, r = Merges(BYTE), random.Random(5)
    sound = np.flatnonzero(merges.sound)
    a, b = (np.array([sound[r.randrange(len(sound))] for _ in range(400)]) for _ in "ab")
    fine = merges.compatible(a, b)
    for x, y, good in zip(a.tolist(), b.tolist(), fine.tolist()):
        symbols = [merges.vocab[c] for c in merges.text_of[x] + merges.text_of[y]]
        assert good == (merges.merged(symbols) == [x, y])


def test_speculation_and_merging_both_happen():
    codec = Codec(WORD)
    words = ["the", "hello", "unbelievably", "strengthlessness", "zzxqy"]
    library = Tokenizer.from_file(WORD)
    assert codec.encode_words(words) == [library.encode(w, add_special_tokens=False).ids for w in words]
    guess = lambda w: codec.speculate([w])[1].tolist()
    guesses = [guess(w) == e for w, e in zip(words, codec.encode_words(words))]
    assert any(guesses) and not all(guess(w) == codec.encode_words([w])[0] for w in (
        "ingouhethere", "hathonreer", "erntheedly", "wondethrouable"))
    # All at once is each by itself.
    owner, tokens = codec.speculate(words)
    assert [tokens[owner == i].tolist() for i in range(len(words))] == [guess(w) for w in words]


def test_entries_in_words_by_packed_bytes():
    r = random.Random(9)
    entries = {bytes(r.choice(b"ab\x00\xff") for _ in range(r.randrange(1, 14))): i for i in range(300)}
    words = [bytes(r.choice(b"ab\x00\xff") for _ in range(r.randrange(0, 25))) for _ in range(200)] + [b"", max(entries, key=len)]
    got = sorted(zip(*(x.tolist() for x in SubstringTable(entries).find(words))))
    assert got == sorted(
        (w, s, e, entries[word[s:e]]) for w, word in enumerate(words) for s in range(len(word))
        for e in range(s + 1, len(word) + 1) if word[s:e] in entries
    )
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    table = KeyTable(keys[:3000], np.arange(3000))
    assert table.find(keys).tolist() == [*range(3000), *[-1] * (len(keys) - 3000)]


def test_chunk_table_forgets_what_was_used_least(monkeypatch):
    monkeypatch.setattr(chunks, "TABLE", 3)
    asked = []

    def solve(new):
        asked.extend(new)
        return [[c.encode() for c in new], [len(c) for c in new]]

    table = ChunkTable(solve, [pa.binary(), pa.int64()])
    for line in ("a bb a", "bb c d e", "a f g", "", "x" * 300 + " a", "h i j k l m n bb"):
        flat = pa.array(line.split(), pa.string())
        ids, sizes = table(flat)
        assert ids.to_pylist() == [c.encode() for c in line.split()] and sizes.to_pylist() == list(map(len, line.split()))
        assert len(table.keys) <= 6 and all(len(k) < 300 for k in table.keys.to_pylist())
    assert asked.count("a") == 1 and asked[:4] == ["a", "bb", "c", "d"]


def test_chunk_table_hashes_a_slice_and_not_what_it_remembers(monkeypatch):
    hashed, index_in = [], pc.index_in

    def counted(values, value_set):
        hashed.append(len(value_set))
        return index_in(values, value_set=value_set)

    monkeypatch.setattr(chunks.pc, "index_in", counted)
    table = ChunkTable(lambda new: [[len(c) for c in new]], [pa.int64()])
    for words in ([str(i) for i in range(2000)], ["1999", "x", "7", "x"], [], ["", "1"]):
        (sizes,) = table(pa.array(words, pa.string()))
        assert sizes.to_pylist() == list(map(len, words))
        assert hashed[-1] <= len(set(words))


def test_key_of_splits_off_marks_of_latin_words_only():
    for chunk, key in {
        "Word.": ("word", "."), "a,": ("a", ","), "\u00c9t\u00e9": ("\u00e9t\u00e9", ""), ".": (".", ""), "": ("", ""),
        "\u0130x.": ("\u0130x.", ""), "\u0394x": ("\u0394x", ""), "a..": ("a..", ""), "a1.": ("a1.", ""),
    }.items():
        assert chunks.key_of(chunk) == key


def test_arrow_splits_where_python_does():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))
    for text in (f"a{'b'.join(every)}", " lead", "trail ", "", "  ", "a  b"):
        if chunks.ODD.search(text):
            text = chunks.ODD.sub("", text)
        got = [c for c in pc.utf8_split_whitespace(pa.array([text])).to_pylist()[0] if c]
        assert got == chunks.chunks_of(text) == text.split()


def test_short_and_long_merging_agree():
    merges, r = Merges(BYTE), random.Random(6)
    for _ in range(300):
        ids = merges.symbols("".join(r.choice("theinger aond") for _ in range(r.randrange(1, 20))).replace(" ", "Ġ"))
        assert merges._merged_short(list(ids)) == merges.merged(ids, {})


def test_counts_equal_the_library(spark):
    library, rows = Tokenizer.from_file(BYTE), texts()
    got = {r["doc_id"]: r for r in token_counts(frame(spark, rows), BYTE, limit=10).collect()}
    for i, t in enumerate(rows):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["over_limit"]) == (n, n > 10), t
        assert got[i]["n_bytes"] == len((t or "").encode())


def test_every_prefix_equals_the_library():
    library, counter = Tokenizer.from_file(BYTE), PrefixCounter(BYTE)
    for t in texts(40):
        if t and len(t) < 500:
            want = [len(library.encode(t[: i + 1], add_special_tokens=False).ids) for i in range(len(t))]
            assert counter.prefixes(t).tolist() == want, t


def test_budget_questions_from_stored_counts(spark):
    library, rows = Tokenizer.from_file(BYTE), ["", "some words that are cut somewhere", None]
    stored = prefix_table(frame(spark, rows), BYTE)
    c = F.col("prefix_tokens")
    got = {r["doc_id"]: r for r in stored.select(
        "doc_id", fit_chars(c, 3).alias("fit"), tokens_of_prefix(c, 9).alias("nine")).collect()}
    text = rows[1]
    count = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert got[1]["fit"] == max(i for i, n in enumerate(count) if n <= 3)
    assert got[1]["nine"] == count[9]
    assert (got[0]["fit"], got[0]["nine"], got[2]["fit"]) == (0, 0, 0)


@pytest.mark.parametrize("size", [16, 2048])
def test_packing(spark, size):
    library, rows = Tokenizer.from_file(WORD), texts() + ["word " * 5000]
    got = pack(frame(spark, rows), WORD, size=size).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(-(-len(ids) // size)))
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == p["piece"] * size and len(part) == p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size


def test_plan_holds_everything_and_fills_gaps():
    r = random.Random(6)
    lengths: dict[int, int] = {}
    for _ in range(20_000):
        n = min(2048, int(r.lognormvariate(5.5, 1.2)) + 1)
        lengths[n] = lengths.get(n, 0) + 1
    templates = plan(lengths, 2048)
    used: dict[int, int] = {}
    for often, parts in templates:
        assert sum(n * k for n, k in parts) <= 2048
        for n, k in parts:
            used[n] = used.get(n, 0) + often * k
    assert used == lengths
    least = -(-sum(n * k for n, k in lengths.items()) // 2048)
    assert sum(t[0] for t in templates) <= least * 1.01
    assert len(slots(templates)) < 20_000
    # Pairs and triples that fit exactly are found.
    assert sum(t[0] for t in plan({1000: 5, 1048: 5, 700: 3, 600: 3, 500: 3, 248: 3}, 2048)) == 8
    assert plan({}, 2048) == [] and len(slots([])) == 0


def test_empty_table(spark):
    none = frame(spark, ["x"]).where("doc_id < 0")
    assert bpe_round_trip(none, WORD).count() == 0
    assert token_counts(none, BYTE, 5).count() == 0
    assert pack(none, WORD).count() == 0


def test_triples_are_found_as_stock_runs_down():
    counts = np.zeros(21, np.int64)
    counts[[14, 11, 5, 3, 1]] = 1, 1, 1, 3, 1
    stock = _Stock(counts)
    counts[[14, 5, 1]] = 0
    assert stock.triple(9, 11) == (3, 3, 3)


def test_freed_memory_is_returned_while_texts_are_handled(monkeypatch):
    """After the first slice, from time to time and at the end, not only when another operator starts."""
    calls = []
    monkeypatch.setattr(text_map, "_release", lambda: calls.append(1))
    monkeypatch.setattr(text_map, "_BUILT", {})
    monkeypatch.setattr(text_map, "RETURN_EVERY", 1000.0)
    assert list(text_map.released(range(5))) == list(range(5)) and len(calls) == 2
    monkeypatch.setattr(text_map, "RETURN_EVERY", 0.0)
    assert list(text_map.released(range(5))) == list(range(5)) and len(calls) == 8
    assert text_map.built(("some library",), lambda: 1) == 1 and len(calls) == 9
