"""BPE encoding and decoding: speculate with longest matches, verify, merge only what fails.

Every new word is cut greedily into the longest vocabulary entries. All adjacent
pairs of all new words are tested at once (``bpe.Merges.compatible``); a word whose
tokens are sound and whose pairs all stay apart has its exact encoding, and only the
others are merged step by step. Normalisation and word splitting are the tokenizer
library's own, called on distinct chunks.

Defined cases: NULL and empty texts have no tokens and decode to an empty text;
strings of special tokens inside a text become these tokens; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from snapmart.llm.bpe import Merges
from snapmart.llm.chunks import ChunkEncoder, Laid
from snapmart.llm.key_table import SubstringTable
from snapmart.llm.prefix_counts import BYTES, byte_of
from snapmart.llm.text_map import built, map_texts


class Codec:
    """Encoder and decoder for a tokenizer that drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.words = library.pre_tokenizer.pre_tokenize_str
        self.merges = Merges(path)
        suffix = self.merges.suffix
        inner, ended = {}, {}
        for entry, i in self.merges.vocab.items():
            is_end = bool(suffix) and entry.endswith(suffix)
            codes = [byte_of(c) for c in (entry[: -len(suffix)] if is_end else entry)]
            if codes and None not in codes:
                (ended if is_end or not suffix else inner)[bytes(codes)] = i
                if not suffix:
                    inner[bytes(codes)] = i
        self.inner, self.ended = SubstringTable(inner), SubstringTable(ended)
        # Whether small letters are one word as they are, so that the library need not be asked.
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.letters_stay = self.normalise(letters) == letters and [w for w, _ in self.words(letters)] == [letters]
        self.special = re.compile("|".join(map(re.escape, self.merges.specials)))
        self.encoder = ChunkEncoder(self.encode_chunks, self.words_of)

    def round_trip(self, texts: pa.Array) -> list[Laid]:
        """Little-endian unsigned 32-bit ids of whole texts, and their tokens, each with a space behind it.

        Where the file names no decoder, the library decodes by joining tokens with spaces.
        """
        return self.encoder(texts)

    def words_of(self, ids: bytes) -> str:
        """A chunk's tokens, each with a space behind it."""
        return "".join([f"{self.merges.text_of[i]} " for i in memoryview(ids).cast("I")])

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        out = [b""] * len(chunks)
        letters, others = [], []
        for i, c in enumerate(chunks):
            (letters if self.letters_stay and c.isascii() and c.isalpha() and c.islower() else others).append(i)
        for i, ids in zip(letters, self.encode_words([chunks[i] for i in letters])):
            out[i] = array("I", ids).tobytes()
        plain = [i for i in others if not self.special.search(chunks[i])]
        for i, ids in zip(plain, self._plain([chunks[i] for i in plain])):
            out[i] = array("I", ids).tobytes()
        for i in set(others) - set(plain):
            ids, at = [], 0
            for m in self.special.finditer(chunks[i]):
                ids += self._plain([chunks[i][at : m.start()]])[0]
                ids.append(self.merges.specials[m.group()])
                at = m.end()
            ids += self._plain([chunks[i][at:]])[0]
            out[i] = array("I", ids).tobytes()
        return out

    def _plain(self, chunks: list[str]) -> list[list[int]]:
        """Chunks without special tokens: normalised and split together, one space apart."""
        if not chunks:
            return []
        # A chunk alone on its side of a space is normalised as it would be within its text.
        normal = self.normalise(" ".join(chunks))
        starts, at = [], 0
        for part in normal.split(" "):
            starts.append(at)
            at += len(part) + 1
        pieces = self.words(normal)
        owner = np.searchsorted(np.array(starts), [p[1][0] for p in pieces], "right") - 1
        ids = self.encode_words([p[0] for p in pieces])
        out: list[list[int]] = [[] for _ in chunks]
        for k, found in zip(owner.tolist(), ids):
            out[k] += found
        return out

    def speculate(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: word numbers and tokens, in order.

        Words with a symbol that no entry has are left out from there on; their tokens do
        not cover them, which ``encode_words`` sees.
        """
        bodies = [w.translate(BYTES).encode("latin-1") for w in words]
        sizes = np.array([len(b) for b in bodies], np.int64)
        first = np.cumsum(sizes) - sizes
        longest = np.zeros(int(sizes.sum()) + 1, np.int64)
        entry = np.full(len(longest), -1, np.int64)
        for table, ends in ((self.inner, False), (self.ended, True)):
            word, start, end, token = table.find(bodies)
            fits = (end == sizes[word]) == ends
            place, size, token = (first[word] + start)[fits], (end - start)[fits], token[fits]
            # Sizes rise, so the last one written at a place is the longest.
            order = np.argsort(size, kind="stable")
            place, size, token = place[order], size[order], token[order]
            longer = size > longest[place]
            longest[place[longer]], entry[place[longer]] = size[longer], token[longer]
        at, active, owners, tokens = first.copy(), np.flatnonzero(sizes > 0), [], []
        while len(active):
            here = at[active]
            known = entry[here] >= 0
            active, here = active[known], here[known]
            owners.append(active)
            tokens.append(entry[here])
            at[active] = here + longest[here]
            active = active[at[active] < first[active] + sizes[active]]
        none = np.zeros(0, np.int64)
        owner, token = np.concatenate([*owners, none]), np.concatenate([*tokens, none])
        order = np.argsort(owner, kind="stable")
        self._covered = at == first + sizes
        return owner[order], token[order]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        merges = self.merges
        # Symbols are bytes written as characters; words with others are merged as they are.
        plain = [i for i, w in enumerate(words) if w and (w.isascii() or None not in map(byte_of, w))]
        owner, flat = self.speculate([words[i] for i in plain])
        fine = self._covered
        if len(flat):
            fine[owner[~merges.sound[flat]]] = False
            inside = owner[1:] == owner[:-1]
            pairs, back = np.unique(
                flat[:-1][inside] * merges.size + flat[1:][inside], return_inverse=True
            )
            apart = merges.compatible(pairs // merges.size, pairs % merges.size)[back]
            fine[owner[1:][inside][~apart]] = False
        cuts = np.searchsorted(owner, np.arange(len(plain) + 1)).tolist()
        tokens, proposed = flat.tolist(), [None] * len(words)
        for k, i in enumerate(plain):
            if fine[k]:
                proposed[i] = tokens[cuts[k] : cuts[k + 1]]
        return [self._merged(w) if p is None else p for w, p in zip(words, proposed)]

    def _merged(self, word: str) -> list[int]:
        """Exact merging; symbols outside the vocabulary have no token, as in the library."""
        merges = self.merges
        known = merges.symbols(word)
        if known is None:
            last = len(word) - 1
            symbols = (c + merges.suffix * (k == last) for k, c in enumerate(word))
            known = [merges.vocab[s] for s in symbols if s in merges.vocab]
        return merges.merged(known)


def bpe_round_trip(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids and decoded."""

    def function(ids: list, texts: pa.Array) -> dict[str, list]:
        codec = built(("codec", tokenizer), lambda: Codec(tokenizer))
        encoded, words = codec.round_trip(texts)
        decoded = [w[:-1] for w in words]
        out: dict[str, list] = {
            "doc_id": ids, "n_tokens": [len(e) // 4 for e in encoded],
            "ids_sha256": [hashlib.sha256(e).hexdigest() for e in encoded],
            "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in decoded],
        }
        if keep_ids:
            out["decoded"] = [str(t, "utf-8") for t in decoded]
            out["ids"] = [np.frombuffer(e, "<u4").astype(np.int32) for e in encoded]
        return out

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"
    return map_texts(docs, doc_id, text, schema, function, as_array=True)
