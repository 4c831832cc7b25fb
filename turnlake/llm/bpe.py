"""Exact byte-level BPE over Arrow batches, for a public tokenizers file.

Text is cut into pieces by vectorised byte-class rules that equal the file's
split pattern on the code points listed in ``_PLAIN``; a text with any other
code point, or with the text of a special token, is cut by the library's own
pre-tokenizer instead.  Every distinct piece of a batch is merged once, many
pieces side by side in numpy, and the result is kept in a bounded table.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from turnlake.llm.arrowtext import ragged

BLANK, LETTER, NUMBER, OTHER = 0, 1, 2, 3

#: Code point ranges whose classes no Unicode version has changed since the
#: tables in use; white space outside ASCII is left out on purpose.
_PLAIN = ((0x00, 0x0A), (0x0D, 0x0D), (0x20, 0x7F), (0xA1, 0x233), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x400, 0x481), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20AC), (0x4E00, 0x9FA5))

#: Distinct pieces kept between batches of one Python worker.
KEEP_PIECES = 500_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class by code point below 0xA000; 255 where the library has to decide."""
    table = np.full(0xA000, 255, np.uint8)
    letter, number, blank = (regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
    for low, high in _PLAIN:
        for point in range(low, high + 1):
            char = chr(point)
            table[point] = LETTER if letter.match(char) else NUMBER if number.match(char) else BLANK if blank.match(char) else OTHER
    return table


class Vocabulary:
    """Tokens, merge ranks and split rules read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        for b in range(256):
            if b not in shown:
                shown[b] = chr(256 + len(shown) - len(printable))
        back = {c: b for b, c in shown.items()}
        self.path = path
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        ids = {token: i for token, i in model["vocab"].items() if token.encode() not in self.special}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        if self.size > 1 << 16:
            raise ValueError("ids are held in 16 bits: the vocabulary has more than 65,536 of them")
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for content, i in self.special.items():
            self.token_bytes[i] = content
        self.byte_id = np.array([ids[shown[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(ids[a] << 16) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order].astype(np.uint32), order.astype(np.int32)
        self.rank_id = np.array([ids[a + b] for a, b in pairs], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; a large number where they never merge."""
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], np.int32(1 << 30))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of many words: (ids of all, number of ids of each)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        rows, counts, parts = [], [], []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 40), (40, 64)):
            pick = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(pick), 20_000):
                some = pick[at : at + 20_000]
                ids, n = self._merge_padded([words[i] for i in some.tolist()], size[some], high)
                rows.append(some), counts.append(n), parts.append(ids)
        for i in np.flatnonzero(size > 64).tolist():
            ids = self._merge_long(words[i])
            rows.append([i]), counts.append([len(ids)]), parts.append(ids)
        if not rows:
            return np.zeros(0, np.uint16), np.zeros(len(words), np.int64)
        made, order = np.concatenate(counts), np.concatenate(rows)
        begin, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[order], total[order] = np.cumsum(made) - made, made
        return np.concatenate(parts).astype(np.uint16)[ragged(begin, total)], total

    def _merge_padded(self, words: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        flat = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ids = np.full((len(words), width + 1), -1, np.int32)
        ids[np.arange(width + 1) < size[:, None]] = flat
        rank = np.full((len(words), width + 1), 1 << 30, np.int32)
        rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        live, columns = np.arange(len(words)), np.arange(width + 1)
        a, r = ids, rank
        while len(live):
            at = r.argmin(1)
            rows = np.arange(len(live))
            best = r[rows, at]
            go = best < 1 << 30
            if not go.all():
                ids[live[~go]] = a[~go]
                live, a, r, at, best = live[go], a[go], r[go], at[go], best[go]
                rows = rows[: len(live)]
                if not len(live):
                    break
            a[rows, at] = self.rank_id[best]
            shift = np.minimum(columns + (columns > at[:, None]), width)
            a = np.take_along_axis(a, shift, 1)
            r = np.take_along_axis(r, shift, 1)
            a[:, -1], r[:, -1] = -1, 1 << 30
            r[rows, at] = self.ranks(a[rows, at], a[rows, np.minimum(at + 1, width)])
            before = np.maximum(at - 1, 0)
            r[rows, before] = np.where(at > 0, self.ranks(a[rows, before], a[rows, at]), r[rows, before])
        used = ids >= 0
        return ids[used], used.sum(1)

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One long word, with a heap of pairs: n log n however long it is."""
        import heapq

        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        found = self.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        lookup: dict[tuple[int, int], int] = {}

        def rank(x: int, y: int) -> int:
            if (x, y) not in lookup:
                lookup[x, y] = int(self.ranks(np.array([x]), np.array([y]))[0])
            return lookup[x, y]

        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(found) if r < 1 << 30]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else -1
            if j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = int(self.rank_id[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (s := rank(ids[p], ids[q])) < 1 << 30:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], np.int32)


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of every byte; the bytes of one code point share its class."""
    table = classes()
    out = table[data & 0x7F]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        lead = data[high].astype(np.int32)
        tail = data[np.minimum(high + 1, len(data) - 1)] & 0x3F
        third = data[np.minimum(high + 2, len(data) - 1)] & 0x3F
        point = np.where(lead < 0xE0, ((lead & 0x1F) << 6) | tail, np.where(lead < 0xF0, ((lead & 0x0F) << 12) | (tail.astype(np.int32) << 6) | third, 0x9FFF))
        kind = table[np.minimum(point, 0x9FFF)]
        out[high] = kind
        for step, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            wide = lead >= least
            at = high[wide] + step
            fits = at < len(data)
            out[at[fits]] = kind[wide][fits]
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Starts of the pieces of every document, in one vectorised pass.

    A run of one class is a piece; the last blank before a run joins it if it
    is a space and stands alone if not; an apostrophe that begins a piece takes
    the ending s, t, m, d, re, ve or ll that follows it.
    """
    n = len(data)
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    lead = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[lead] = True
    is_lead = np.zeros(n + 1, bool)
    is_lead[lead] = True
    is_lead[n] = True
    after = np.flatnonzero((kind[1:] != BLANK) & (kind[:-1] == BLANK)) + 1
    after = after[~is_lead[after]]
    begin[after - 1] = True
    begin[after[data[after - 1] == 0x20]] = False
    quote = np.flatnonzero(data == 0x27)
    quote = quote[begin[quote] & ~is_lead[quote + 1]]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one = data[quote + 1]
        two = data[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        pair &= ~is_lead[np.minimum(quote + 2, n)]
        take = quote[short | pair]
        stop = take + np.where(short, 2, 3)[short | pair]
        begin[take + 1] = False
        inside = stop[~is_lead[np.minimum(stop, n)]]
        begin[inside[kind[inside] == LETTER]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes blocks of documents; keeps the pieces it has merged, bounded."""

    def __init__(self, vocabulary: Vocabulary, lexicon=None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.filled = np.zeros(1 << 20, np.uint16), 0
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.known)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(words) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.begin[first : first + len(words)] = self.filled + np.cumsum(counts) - counts
        self.count[first : first + len(words)] = counts
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.filled += len(ids)

    def table(self, words: list[bytes]) -> np.ndarray:
        """Row of each distinct word in the table; unseen words are merged now."""
        if len(self.known) + len(words) > KEEP_PIECES:
            self.forget()
        get = self.known.get
        rows = [get(w, -1) for w in words]
        out = np.array(rows, np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = np.arange(len(self.known), len(self.known) + len(new))
            fresh = [words[i] for i in new.tolist()]
            if self.lexicon is None:
                ids, counts = self.vocabulary.merge(fresh)
            else:
                ids, counts = self.lexicon.encode(fresh, self.vocabulary.merge)
            self._add(fresh, ids, counts)
        return out

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, dict[int, int]]:
        """(pieces of all documents, pieces before each, special ids by piece)."""
        kind = byte_classes(data)
        starts = piece_starts(data, offsets, kind)
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(kind == 255), side="right") - 1)
        raw = data.tobytes()
        marks = {w for w in self.vocabulary.special if w in raw}
        if marks:
            odd = np.union1d(odd, [i for i in range(len(offsets) - 1) if any(w in raw[offsets[i] : offsets[i + 1]] for w in marks)]).astype(np.int64)
        edge = np.append(starts, len(data)).astype(np.int32)
        plain = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(raw)])
        before = np.searchsorted(starts, offsets)
        if not len(odd):
            return plain, before, {}
        parts, counts, special, done = [], np.diff(before), {}, 0
        for i in odd.tolist():
            parts.append(plain.slice(before[done], before[i] - before[done]))
            own = self._cut(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"))
            at = sum(map(len, parts))
            special.update({at + k: x for k, x in enumerate(own) if isinstance(x, int)})
            parts.append(pa.array([b"" if isinstance(x, int) else x for x in own], pa.binary()))
            counts[i], done = len(own), i + 1
        parts.append(plain.slice(before[done], before[-1] - before[done]))
        return pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(counts)]), special

    def _cut(self, text: str) -> list[bytes | int]:
        """Pieces by the library's own rules; the id in place of a special token."""
        out: list[bytes | int] = []
        names = sorted((w.decode() for w in self.vocabulary.special), key=len, reverse=True)
        for part in regex.split("(" + "|".join(map(regex.escape, names)) + ")", text) if names else [text]:
            if part.encode() in self.vocabulary.special:
                out.append(self.vocabulary.special[part.encode()])
            elif part:
                out += [part[a:b].encode() for _, (a, b) in _library(self.vocabulary.path).pre_tokenizer.pre_tokenize_str(part)]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, ids before each document)."""
        pieces, before, special = self.pieces(data, offsets)
        coded = pieces.dictionary_encode()
        rows = self.table(coded.dictionary.to_pylist())
        which = rows[coded.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64)
        counts = self.count[which]
        ids = self.pool[ragged(self.begin[which], counts)]
        if special:
            total = np.concatenate([[0], np.cumsum(counts)])
            at = np.array(sorted(special))
            ids = np.insert(ids, total[at], [special[i] for i in at.tolist()])
            counts[at] = 1
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[before]


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder: its table is kept from task to task."""
    return Encoder(vocabulary(path))
