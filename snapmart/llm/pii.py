"""Personal data: pattern spans, and spans that a linear-chain CRF adds.

The base kinds (email, ip, card, phone) are fixed patterns. A conditional random field
over word-shape features, trained on the small labelled table below, adds spans of its
own kinds: person, street, national_id, local_phone. Added spans that overlap a base
span are left out; base spans always stay.

A token's score for a label is a sum of table entries for its own word and shape and
those of its neighbours, so whole texts are scored by table lookups. A token whose best
entity score lies below the outside score by more than any two transitions can make up
is outside in every best path; only runs of the other tokens are decoded, all runs of
a slice together, by Viterbi in numpy. The result is that of decoding the whole chain.

Defined cases: a NULL or empty text has no spans; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from snapmart.llm.chunks import LONG, WORDS, chunks_of
from snapmart.llm.text_map import built, map_texts, replace_texts

#: Labels of the CRF; the first is "no personal data".
LABELS = ["outside", "person", "street", "national_id", "local_phone"]
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = BASE_KINDS + LABELS[1:]

#: Labelled rows: text, and for each entity its label and words.
TRAINING: list[tuple[str, list[tuple[str, str]]]] = [
    ("Please contact Jane Miller at the front desk.", [("person", "Jane Miller")]),
    ("Contact Peter Novak for details", [("person", "Peter Novak")]),
    ("My name is Anna Schmidt and I live here", [("person", "Anna Schmidt")]),
    ("my name is Carlos Ruiz", [("person", "Carlos Ruiz")]),
    ("Her name is Marie Dubois, she said", [("person", "Marie Dubois")]),
    ("Dear Mr Thompson, thank you for the letter", [("person", "Thompson")]),
    ("Dear Mrs Olsen the order was sent", [("person", "Olsen")]),
    ("Mr. John Baker signed the paper", [("person", "John Baker")]),
    ("Dr. Helen Carter will see you", [("person", "Helen Carter")]),
    ("The patient of Dr Paul Weber left", [("person", "Paul Weber")]),
    ("Mrs. Laura Conti called twice", [("person", "Laura Conti")]),
    ("Signed: Robert Hale", [("person", "Robert Hale")]),
    ("Signed: Ingrid Larsen in the office", [("person", "Ingrid Larsen")]),
    ("He lives at 12 Oak Street now", [("street", "12 Oak Street")]),
    ("Send it to 221 Baker Street today", [("street", "221 Baker Street")]),
    ("The house at 7 Elm Road is empty", [("street", "7 Elm Road")]),
    ("delivered to 45 Maple Avenue on Monday", [("street", "45 Maple Avenue")]),
    ("Address: 980 Hill Lane", [("street", "980 Hill Lane")]),
    ("Address: 16 Park Road, second floor", [("street", "16 Park Road")]),
    ("SSN 123-45-6789 is on file", [("national_id", "123-45-6789")]),
    ("Her SSN: 987-65-4321", [("national_id", "987-65-4321")]),
    ("social security number 078-05-1120 was leaked", [("national_id", "078-05-1120")]),
    ("ssn 219-09-9999", [("national_id", "219-09-9999")]),
    ("the id 457-55-5462 belongs to her", [("national_id", "457-55-5462")]),
    ("call 555-123-4567 tonight", [("local_phone", "555-123-4567")]),
    ("Phone: 212-555-0147", [("local_phone", "212-555-0147")]),
    ("tel 303-555-0199 or come by", [("local_phone", "303-555-0199")]),
    ("Tel: 404-555-0123", [("local_phone", "404-555-0123")]),
    ("reach me on 617-555-0175 after six", [("local_phone", "617-555-0175")]),
    ("The quick report of the day was read by all.", []),
    ("On Monday The Board met in London.", []),
    ("Of Rend And Other stories were told", []),
    ("Edth Ernt. Thinhe of the old", []),
    ("Licensed under the Apache License, Version 2.0.", []),
    ("This work is licensed under the GNU General Public License, version 3.", []),
    ("All rights reserved. Copyright 2019 The Authors", []),
    ("Released under the MIT License.", []),
    ("key=9f8e7d6c5b4a and token AKIA4D62HKU6VBLC", []),
    ("the order 40418949746 has 12 parts", []),
    ("in 2019 there were 300 people and 15 Cars", []),
    ("see page 12 of Part Two", []),
    ("version 2.0.1 of 2021-05-17 runs", []),
    ("the range 100-200 and 10-20-30 holds", []),
    ("Der Tag war lang und Die Nacht kalt", []),
    ("Le Jour de la Fête est venu", []),
    ("El Camino de las Flores es largo", []),
    ("A Street Without Name is a book", []),
    ("The Road To The Hill was closed", []),
    ("Name of the product: Widget", []),
    ("THE END OF THE STORY", []),
    ("contact the office for more", []),
    ("call it a day", []),
    ("Street food and Park life", []),
    ("1234-5678-9012 was the code", []),
    ("he signed the paper in the morning", []),
    ("Hash thou a that, as reat thanoued", []),
    ("ratio 3-2 and score 10-12", []),
    ("Shsh. Than stin it t. East. Er for to st", []),
    ("Thinhe | Esshnt. | Erwhlyen | a. Heon | Orreat | enblend |", []),
    ("TH!! A.!! IS!! ONONHE!! ERSHRE!! REND. IN!! THE!! AND!! OF!!", []),
    ("Ntwh erntblees in by ths. Eresor onan ernt. To Of Th Th Th", []),
    ("Wher. Wher. Wher. Wher. And And And And On On On On", []),
    ("Mentque. Èentreç le êier et De De De la mentoi.", []),
    ("Einäie zuzuheit enöer. Erpfach und Der Der Der heit", []),
    ("Of%%% the&&& Thatwh&&& an%%% For.*** Edhend$$$ In%%% at%%%", []),
    ("Con tae de Ciónas de la Raes Raes que el", []),
    ("Ertion was 42.144.35.254 Onthe in +1 (988) 555-2485 Orthen ndat", []),
    ("reed bosbt.42@mail8.example.com Thble 4041894974608795 Edthnd ernt", []),
    ("hahesh to. Is. Aneaes thoubleon in", []),
    ("It is Eron. Ouatan eratre re", []),
    ("that is. Anlyen the when to is oningndou. Ea onea", []),
    ("this is Thndnd of it. Is Erthti. Blesh it to", []),
    ("and is Ernt. Her Thest. His Onre my Edea", []),
    ("Mit der Chlichung. La Ea de. De. Ómi óes.", []),
    ("With eran, to Than. Contact. Signed. Dear.", []),
    ("At At At At At At At At Re Re Re Re", []),
    ("Hely 5500 of 12 Then 7 Onea and 30 Esti", []),
    ("Question 7 Answer The following", []),
]

_EDGE = re.compile(r"^[^\w#]+|[^\w]+$")


def bare(token: str) -> str:
    """The token without punctuation at its ends."""
    return _EDGE.sub("", token)


def shape(token: str) -> str:
    """Upper X, lower x (runs as one), digits d one by one up to four, then D."""
    out: list[str] = []
    for c in token[:40]:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c
        if kind != "d" and out and out[-1] == kind and kind in "Xx":
            continue
        out.append(kind)
    return re.sub("d{5,}", "D", "".join(out))


def form(token: str) -> str:
    """Shape, and whether punctuation ends the token."""
    core = bare(token)
    return shape(core) + ("." if core and token[-1] != core[-1] else "" if core else "-")


@dataclass
class Crf:
    """Word and shape tables (index 0: unknown), and score tables by offset of the neighbour."""

    words: dict[str, int]
    shapes: dict[str, int]
    by_word: np.ndarray  # offset, word, label
    by_shape: np.ndarray  # offset, shape, label
    step: np.ndarray  # label, next label

    def type_of(self, token: str) -> int:
        word = token.rstrip(".,;:!?")
        if word.isalpha() and (word.islower() or (word[0].isupper() and word[1:].islower())):
            # Most tokens: what form() and bare() give, without their patterns.
            own = ("x" if word.islower() else "Xx" if len(word) > 1 else "X") + "." * (word != token)
            return self.words.get(word.lower(), 0) * len(self.shapes) + self.shapes.get(own, 0)
        word = self.words.get(bare(token).lower(), 0)
        return word * len(self.shapes) + self.shapes.get(form(token), 0)

    def tables(self) -> np.ndarray:
        """Score of a token type for a label, by offset: the types combine word and shape."""
        both = self.by_word[:, :, None, :] + self.by_shape[:, None, :, :]
        return both.reshape(len(OFFSETS), -1, len(LABELS))

    def bounds(self) -> tuple[np.ndarray, float]:
        """Most that each inside label's incoming transition gains, and what a run must gain in all."""
        t = self.step - self.step[0, 0]
        into = t[1:, 1:].max(0)
        return into, float((into - t[0, 1:]).min() - t[1:, 0].max())


#: Whose word and shape count for a token.
OFFSETS = (-2, -1, 0, 1, 2)


def scores(types: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Token by label; neighbours beyond the ends count nothing."""
    out = tables[OFFSETS.index(0)][types].copy()
    for k, offset in enumerate(OFFSETS):
        if offset < 0 and len(types) > -offset:
            out[-offset:] += tables[k][types[:offset]]
        elif offset > 0 and len(types) > offset:
            out[:-offset] += tables[k][types[offset:]]
    return out


def train_crf(
    rows: list[tuple[str, list[tuple[str, str]]]] = TRAINING, epochs: int = 200, l2: float = 0.02,
    rate: float = 0.1,
) -> Crf:
    """Maximum likelihood with an L2 term; forward and backward over all rows at once."""
    tokens = [text.split() for text, _ in rows]
    labels = []
    for (_, entities), words in zip(rows, tokens):
        tags = [0] * len(words)
        for label, entity in entities:
            parts = entity.split()
            for i in range(len(words) - len(parts) + 1):
                if [bare(w) for w in words[i : i + len(parts)]] == [bare(p) for p in parts]:
                    tags[i : i + len(parts)] = [LABELS.index(label)] * len(parts)
        labels.append(tags)
    entity_free = [bare(w).lower() for ws, tags in zip(tokens, labels) for w, t in zip(ws, tags)
                   if t == 0 or w.lower() in ("street", "road", "avenue", "lane")]
    words = {"": 0} | {w: k + 1 for k, w in enumerate(sorted({w for w in entity_free if w.isalpha()}))}
    words |= {w: len(words) + k for k, w in enumerate(("avenue", "lane")) if w not in words}
    shapes = {"": 0} | {s: k + 1 for k, s in enumerate(sorted({form(w) for ws in tokens for w in ws}))}
    n, long, k = len(rows), max(map(len, tokens)), len(LABELS)
    word, kind = np.zeros((n, long), int), np.zeros((n, long), int)
    gold, real = np.zeros((n, long), int), np.zeros((n, long), bool)
    for i, (ws, tags) in enumerate(zip(tokens, labels)):
        word[i, : len(ws)] = [words.get(bare(w).lower(), 0) for w in ws]
        kind[i, : len(ws)] = [shapes.get(form(w), 0) for w in ws]
        gold[i, : len(ws)], real[i, : len(ws)] = tags, True
    params = [np.zeros((len(OFFSETS), len(words), k)), np.zeros((len(OFFSETS), len(shapes), k)), np.zeros((k, k))]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]

    def shifted(values: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        out, here = np.zeros_like(values), np.zeros_like(real)
        if offset < 0:
            out[:, -offset:], here[:, -offset:] = values[:, :offset], real[:, :offset]
        elif offset > 0:
            out[:, :-offset], here[:, :-offset] = values[:, offset:], real[:, offset:]
        else:
            out, here = values, real
        return out, here & real

    views = [(shifted(word, o), shifted(kind, o)) for o in OFFSETS]
    onehot = np.eye(k)[gold] * real[:, :, None]
    for epoch in range(1, epochs + 1):
        e = np.zeros((n, long, k))
        for o, ((w, here), (s, _)) in enumerate(views):
            e += (params[0][o][w] + params[1][o][s]) * here[:, :, None]
        t = params[2]
        # Outside before the first and after the last token; padding is outside for free.
        free = np.full((k, k), -1e9)
        free[:, 0] = t[:, 0]
        alpha, beta = np.zeros((n, long, k)), np.zeros((n, long + 1, k))

        def over(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha[:, 0] = t[0] + e[:, 0]
        for j in range(1, long):
            step = np.where(real[:, j, None, None], t, free)
            alpha[:, j] = over(alpha[:, j - 1, :, None] + step, 1) + e[:, j]
        beta[:, long - 1] = t[:, 0]
        for j in range(long - 2, -1, -1):
            step = np.where(real[:, j + 1, None, None], t, free)
            beta[:, j] = over(step + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
        z = over(alpha[:, -1] + t[:, 0], 1)
        at = np.exp(alpha + beta[:, :long] - z[:, None, None]) * real[:, :, None]
        gap = at - onehot
        grads = [l2 * p for p in params]
        for o, ((w, here), (s, _)) in enumerate(views):
            np.add.at(grads[0][o], w[here], gap[here])
            np.add.at(grads[1][o], s[here], gap[here])
        first = np.zeros(k)
        first[0] = 1
        grads[2] += np.outer(first, gap[:, 0].sum(0))
        for j in range(1, long):
            both = np.exp(
                alpha[:, j - 1, :, None] + t + (e[:, j] + beta[:, j])[:, None, :] - z[:, None, None]
            )
            hit = onehot[:, j - 1, :, None] * onehot[:, j, None, :]
            grads[2] += ((both - hit) * real[:, j, None, None]).sum(0)
        last = real.sum(1) - 1
        grads[2][:, 0] += gap[np.arange(n), last].sum(0)
        for p, g, (m, v) in zip(params, grads, moment):
            g = g / n
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-6)
    return Crf(words, shapes, params[0], params[1], params[2])


def viterbi(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best label of every token inside runs of ``e`` that have outside on both sides.

    All runs advance together; the longest come first, so those still running are a prefix.
    """
    out, back = np.zeros(len(e), np.int8), np.zeros(e.shape, np.int8)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    running = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # longer than j
    best = step[0] + e[starts]
    for j in range(1, int(lengths[0])):
        n = running[j]
        through = best[:n, :, None] + step
        here = starts[:n] + j
        back[here] = through.argmax(1)
        best[:n] = through.max(1) + e[here]
    at = (best + step[:, 0]).argmax(1)
    for j in range(int(lengths[0]) - 1, -1, -1):
        n = running[j]
        here = starts[:n] + j
        out[here] = at[:n]
        if j:
            at[:n] = back[here, at[:n]]
    return out


class Tagger:
    """Added spans (kind, start, end) of texts."""

    def __init__(self, crf: Crf):
        self.crf = crf
        # One more type stands between texts: surely outside, and nothing to its neighbours.
        tables = crf.tables()
        self.tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], 1)
        self.between = tables.shape[1]
        self.tables[OFFSETS.index(0), self.between, 1:] = -1e6
        self.into, self.least = crf.bounds()
        self.known: dict[str, int] = {}

    def types(self, parts: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        except KeyError:
            if len(known) > 200_000:
                known.clear()
            for p in set(parts):
                if p not in known and len(p) <= LONG:
                    known[p] = self.crf.type_of(p)
            return np.fromiter(
                (known[p] if len(p) <= LONG else self.crf.type_of(p) for p in parts), np.int64, len(parts)
            )

    def labels(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Labels of the tokens of several texts."""
        gap = np.full(len(OFFSETS), self.between)
        pieces, starts, at = [gap], [], len(gap)
        for parts in texts:
            starts.append(at)
            pieces += [self.types(parts), gap]
            at += len(parts) + len(gap)
        e = scores(np.concatenate(pieces), self.tables)
        found = np.zeros(len(e), np.int8)
        # The most that a run of inside labels around each token can gain over outside.
        sums = np.cumsum((e[:, 1:] - e[:, :1] + self.into).max(1))
        before = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))
        after = np.maximum.accumulate(sums[::-1])[::-1]
        open_ = np.flatnonzero(after - before >= self.least - 1e-6)
        if len(open_):
            first = np.flatnonzero(np.diff(open_, prepend=-2) > 1)
            lengths = np.diff(first, append=len(open_))
            found = viterbi(e, open_[first], lengths, self.crf.step)
        return [found[s : s + len(parts)] for s, parts in zip(starts, texts)]

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        out = []
        for text, labels in zip(texts, self.labels([chunks_of(t) for t in texts])):
            spans: list[tuple[str, int, int]] = []
            out.append(spans)
            if not labels.any():
                continue
            places = [m.span() for m in WORDS(text)]
            edges = np.flatnonzero(np.diff(labels, prepend=0, append=0))
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                if labels[i]:
                    a, b = places[i][0], places[j - 1][1]
                    core = bare(text[a:b])
                    if core:
                        a += text[a:b].index(core)
                        spans.append((LABELS[labels[i]], a, a + len(core)))
        return out


# The base patterns. A run of digits or of address characters is tried
# from its first character only, which finds the same matches in linear time.
_DIGIT = re.compile("[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, leftmost and non-overlapping per kind."""
    out: list[tuple[str, int, int]] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in order)


def _make(crf: Crf) -> Callable[[], Tagger]:
    return lambda: Tagger(crf)


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """Per text base spans, and base spans with those added that overlap none of them."""
    out = []
    for text, added in zip(texts, tagger.spans(texts)):
        base = base_spans(text)
        fine = [s for s in added if not any(s[1] < end and start < s[2] for _, start, end in base)]
        out.append((base, base + fine))
    return out


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    crf = train_crf()

    def function(ids: list, texts: list) -> dict[str, list]:
        tagger = built(("crf",), _make(crf))
        out: dict[str, list] = {"doc_id": ids, "base_sha256": [], "spans": []}
        out |= {f"n_{kind}": [] for kind in BASE_KINDS}
        for base, every in all_spans(texts, tagger):
            for kind in BASE_KINDS:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
        return out

    counts = ", ".join(f"n_{kind} bigint" for kind in BASE_KINDS)
    return map_texts(docs, doc_id, text, f"{counts}, base_sha256 string, spans string", function)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlaps are replaced once."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with masked texts, all other columns kept."""
    crf = train_crf()

    def function(texts: list) -> list:
        tagger = built(("crf",), _make(crf))
        return [masked(t, every) for t, (_, every) in zip(texts, all_spans(texts, tagger))]

    return replace_texts(docs, text, function)
