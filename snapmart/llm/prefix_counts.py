"""Token counts at every prefix, by dynamic programming over BPE prefixes.

The last token of a prefix's encoding is the one vocabulary entry that ends there and
stays apart from the last token of the prefix before it, so ``last`` and ``count`` of
every prefix of a word follow from shorter prefixes without encoding any of them
again. Distinct words are solved once per worker; a text's counts are the words'
counts laid end to end. ``tokens_of_prefix`` and ``fit_chars`` answer truncation and
budget questions from the stored counts alone.

The count stored at position i is the number of tokens of the first i characters as
a text of their own. White space before a word, contractions and special strings are
split differently while they are incomplete; these places are corrected.

Defined cases: NULL and empty texts have no tokens; strings of special tokens inside
a text count as one; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.llm.bpe import Merges
from snapmart.llm.chunks import SPACE, Recent
from snapmart.llm.key_table import SubstringTable
from snapmart.llm.text_map import built, map_texts

#: The tokenizer's word pattern, with its white space written out.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^WS\p{L}\p{N}]+|[WS]+(?![^WS])|[WS]+"
).replace("WS", SPACE)
#: How the vocabulary writes the 256 bytes as printable characters.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))
}
_BYTE_OF = {c: b for b, c in _BYTE_CHARS.items()}
#: The same for ``str.translate``; the result is bytes in Latin-1.
BYTES = {ord(c): b for c, b in _BYTE_OF.items()}
#: Characters of new words solved together.
BATCH_CHARS = 50_000


def byte_of(char: str) -> int | None:
    """The byte that a character of the vocabulary stands for."""
    return _BYTE_OF.get(char)


class PrefixCounter:
    def __init__(self, path: str):
        self.merges = Merges(path)
        with open(path, encoding="utf-8") as f:
            self.specials = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials)))
        self.split = regex.compile(WORDS).findall
        self.known = Recent()
        sound = self.merges.sound
        # Entries of vocabularies by bytes; a byte's character is no other byte's.
        self.entries = SubstringTable({
            bytes(map(byte_of, t)): i for t, i in self.merges.vocab.items() if sound[i]
        })

    # Words ------------------------------------------------------------------

    def byte_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each prefix of each word, by bytes: row per word, column per length.

        All words advance together: the entries that end at a length are tested at once.
        """
        bodies = [w.encode() for w in words]
        width = max(map(len, bodies)) + 1
        last = np.full((len(words), width), -1, np.int64)
        count = np.zeros((len(words), width), np.int32)
        word, start, end, token = self.entries.find(bodies)
        order = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[order], np.arange(width + 1))
        for at in range(1, width):
            here = order[cuts[at] : cuts[at + 1]]
            w, s, t = word[here], start[here], token[here]
            fits = s == 0
            later = np.flatnonzero(~fits)
            before = last[w[later], s[later]]
            later, before = later[before >= 0], before[before >= 0]
            fits[later] = self.merges.compatible(before, t[later])
            w, s, t = w[fits], s[fits], t[fits]
            last[w, at] = t
            count[w, at] = count[w, s] + 1
        return count

    def word_counts(self, word: str) -> list[int]:
        """Tokens of each prefix of one word, by characters."""
        row = self.byte_counts([word])[0]
        data = np.frombuffer(word.encode(), np.uint8)
        return row[[*(np.flatnonzero((data[1:] & 0xC0) != 0x80) + 1).tolist(), len(data)]].tolist()

    # Whole texts ------------------------------------------------------------

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts: the counts at their last prefix."""
        parts = [self.special.split(t) for t in texts]
        words = [[w for p in some for w in self.split(p)] if len(some) > 1 else self.split(some[0])
                 for some in parts]
        here, fresh = self.known.take(set(chain.from_iterable(words)))
        if fresh:
            solved = self.learn(fresh)
            here.update(solved)
            self.known.add(solved)
        get = here.__getitem__
        return [sum(map(get, w)) + len(p) - 1 for w, p in zip(words, parts)]

    def learn(self, words: list[str]) -> dict[str, int]:
        """Tokens of words, solved in batches of like length and bounded size."""
        fresh = sorted(words, key=len)
        at, solved = 0, {}
        while at < len(fresh):
            end = at + 1
            while end < len(fresh) and (end + 1 - at) * len(fresh[end]) <= BATCH_CHARS:
                end += 1
            batch = fresh[at:end]
            counts = self.byte_counts(batch)
            sizes = [len(w.encode()) for w in batch]
            solved.update(zip(batch, counts[np.arange(len(batch)), sizes].tolist()))
            at = end
        return solved

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text: element i belongs to the first i + 1 characters."""
        out = np.zeros(len(text), np.int64)
        at = base = 0
        part = ""
        for k, part_or_special in enumerate(re.split(f"({self.special.pattern})", text)):
            if k % 2:  # a special string; incomplete, it is plain text that goes on
                before = base - self.count([part])[0]
                for i in range(1, len(part_or_special)):
                    out[at + i - 1] = before + self.count([part + part_or_special[:i]])[0]
                base += 1
                at += len(part_or_special)
                out[at - 1] = base
            else:
                part = part_or_special
                counts = self._part(part)
                out[at : at + len(part)] = base + counts
                at += len(part)
                base += int(counts[-1]) if part else 0
        return out

    def _part(self, part: str) -> np.ndarray:
        out = np.zeros(len(part), np.int64)
        at = base = 0
        for word in self.split(part):
            counts = self.word_counts(word)
            out[at : at + len(word)] = base + np.array(counts)
            if len(word) == 3 and word in ("'re", "'ve", "'ll"):
                # Without its last letter it is an apostrophe and a word.
                out[at + 1] = base + self.word_counts("'")[-1] + self.word_counts(word[1])[-1]
            base += counts[-1]
            at += len(word)
        # White space at the end of a prefix is one word, also with the last
        # character that a following word takes along.
        for run in re.finditer(f"[{SPACE}]{{2,}}", part):
            before = int(out[run.start() - 1]) if run.start() else 0
            out[run.start() : run.end()] = before + np.array(self.word_counts(run.group()))
        return out


def _counter(tokenizer: str) -> PrefixCounter:
    return built(("prefix counts", tokenizer), lambda: PrefixCounter(tokenizer))


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per document: n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""

    def function(ids: list, texts: list) -> dict[str, list]:
        counts = _counter(tokenizer).count(texts)
        return {
            "doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    schema = "n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_texts(docs, doc_id, text, schema, function)


def prefix_table(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: ``prefix_tokens``, one count per prefix (empty for an empty text)."""

    def function(ids: list, texts: list) -> dict[str, list]:
        counter = _counter(tokenizer)
        return {"doc_id": ids, "prefix_tokens": [counter.prefixes(t).astype(np.int32) for t in texts]}

    return map_texts(docs, doc_id, text, "prefix_tokens array<int>", function)


def tokens_of_prefix(counts: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` characters, from the stored counts."""
    chars = chars if isinstance(chars, Column) else F.lit(chars)
    at = F.least(chars, F.size(counts))
    return F.when(at <= 0, F.lit(0)).otherwise(F.try_element_at(counts, at))


def fit_chars(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from the stored counts."""
    fits = F.transform(counts, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0))
