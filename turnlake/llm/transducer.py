"""Minimal acyclic transducer from words to token ids, in one mappable file.

States with equal right languages are shared, so suffixes are stored once.  An
arc carries the number of accepted words that sort before the words through
it; the sum along a path is the word's rank, the transducer's output, under
which its ids stand in a packed table.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

_HEADER = 8


def compile_words(words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Serialise distinct, sorted words with their ids (``counts`` ids a word)."""
    if any(a >= b for a, b in zip(words, words[1:], strict=False)):
        raise ValueError("words must be sorted and distinct")
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) along the last word
    tip, previous = 0, b""

    def freeze(down_to: int) -> None:
        nonlocal tip
        while len(path) > down_to:
            parent, byte = path.pop()
            child = arcs[parent][byte]
            key = (final[child], tuple(arcs[child].items()))
            arcs[parent][byte] = register.setdefault(key, child)
            tip = parent

    for word in words:
        same = len(os.path.commonprefix((previous, word)))
        freeze(same)
        state = tip if path or same == 0 else 0
        state = path[-1] and arcs[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte))
            state = len(arcs) - 1
        final[state] = True
        previous = word
    freeze(0)

    order, seen, stack = [], {0}, [(0, iter(list(arcs[0].values())))]
    while stack:  # post-order: targets before sources
        state, rest = stack[-1]
        for target in rest:
            if target not in seen:
                seen.add(target)
                stack.append((target, iter(list(arcs[target].values()))))
                break
        else:
            order.append(state)
            stack.pop()
    number = {state: i for i, state in enumerate(reversed(order))}
    words_from: dict[int, int] = {}
    key, target, output = [], [], []
    for state in order:
        total = int(final[state])
        for byte, to in sorted(arcs[state].items()):
            key.append(number[state] << 8 | byte)
            target.append(number[to])
            output.append(total)
            total += words_from[to]
        words_from[state] = total
    by_key = np.argsort(np.array(key, np.int64), kind="stable") if key else np.zeros(0, np.int64)
    accepts = np.zeros(len(order), np.uint32)
    accepts[[number[s] for s in order if final[s]]] = 1
    parts = [np.array(x, np.uint32)[by_key] for x in (key, target, output)]
    parts += [accepts, np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32), ids.astype(np.uint32)]
    head = np.zeros(_HEADER, np.uint32)
    head[: len(parts)] = [len(x) for x in parts]
    return b"".join(x.tobytes() for x in [head, *parts])


class Transducer:
    """A compiled lexicon; its tables are views into the buffer, not copies."""

    def __init__(self, buffer):
        raw = np.frombuffer(buffer, np.uint32)
        edges = _HEADER + np.concatenate([[0], np.cumsum(raw[:6].astype(np.int64))])
        self.key, self.target, self.output, self.accepts, self.offsets, self.ids = (raw[a:b] for a, b in zip(edges, edges[1:], strict=False))

    @classmethod
    def mapped(cls, content: bytes) -> Transducer:
        """Memory-map ``content`` through an unnamed file of this process."""
        with tempfile.TemporaryFile() as file:
            file.write(content)
            file.flush()
            return cls(mmap.mmap(file.fileno(), 0, prot=mmap.PROT_READ))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 where it is not in the lexicon; all words walk
        the automaton side by side, one byte a step."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.key):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        live, state, total = np.flatnonzero(size > 0), np.zeros(len(words), np.uint32), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            key = (state[live] << np.uint32(8)) | data[begin[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            live, at = live[hit], at[hit]
            state[live], total[live] = self.target[at], total[live] + self.output[at]
            step += 1
            ended = size[live] == step
            done = live[ended]
            done = done[self.accepts[state[done]] == 1]
            out[done] = total[done]
            live = live[~ended]
        return out

    def encode(self, words: list[bytes], merge) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids a word): known words from the lexicon, others by ``merge``."""
        from turnlake.llm.arrowtext import ragged

        rank = self.ranks(words)
        new = np.flatnonzero(rank < 0)
        ids, made = merge([words[i] for i in new.tolist()]) if len(new) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        known = np.maximum(rank, 0)
        begin = self.offsets[known].astype(np.int64)
        count = self.offsets[np.minimum(known + 1, len(self.offsets) - 1)].astype(np.int64) - begin
        begin[new], count[new] = len(self.ids) + np.cumsum(made) - made, made
        return np.concatenate([self.ids, ids])[ragged(begin, count)].astype(np.uint16), count
