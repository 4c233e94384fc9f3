"""A minimal acyclic transducer from words to token ids.

Sorted words are compiled into the smallest automaton that accepts them:
prefixes are shared because words are added in order, suffixes because a
finished state is looked up among all finished states. Each arc carries the
number of words that sort before it leaves the state, so the sum along a path
is the word's index, and the index leads to its ids. The compiled form is a flat
run of integer arrays, made to be memory-mapped and searched by many words at
once.
"""

from __future__ import annotations

import mmap

import numpy as np

LONGEST_WORD = 64


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The transducer of sorted, distinct words and the ids of each."""
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[tuple] = []
    counts: list[int] = []

    def finish(final: bool, out: list) -> int:
        key = (final, tuple(out))
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(final)
            arcs.append(key[1])
            counts.append(final + sum(counts[target] for _, target in out))
        return state

    path, before = [[False, []]], b""
    for word in [*words, b""]:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        while len(path) - 1 > shared:
            state = finish(*path.pop())
            path[-1][1].append((before[len(path) - 1], state))
        for _ in word[shared:]:
            path.append([False, []])
        if word:
            path[-1][0] = True
        before = word
    root = finish(*path[0])

    keys, targets, outs = [], [], []
    for state, out in enumerate(arcs):
        passed = int(finals[state])
        for byte, target in out:
            keys.append(state << 8 | byte)
            targets.append(target)
            outs.append(passed)
            passed += counts[target]
    flat = [i for row in ids for i in row]
    sections = [
        np.array(keys, np.int64), np.array(targets, np.int64), np.array(outs, np.int64), np.array(finals, np.int64),
        np.concatenate([[0], np.cumsum([len(row) for row in ids], dtype=np.int64)]).astype(np.int64), np.array(flat, np.int64),
    ]
    head = np.array([root, *map(len, sections)], np.int64)
    return b"".join(part.tobytes() for part in [head, *sections])


class Lexicon:
    """A compiled transducer, mapped from a file or held in memory."""

    def __init__(self, content):
        head = np.frombuffer(content, np.int64, 7)
        self.root, at, sections = int(head[0]), 56, []
        for n in head[1:]:
            sections.append(np.frombuffer(content, np.int64, int(n), at))
            at += 8 * int(n)
        self.keys, self.targets, self.outs, self.finals, self.offsets, self.ids = sections

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """Share the pages of a local file between the workers of an executor."""
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for words that are not in the lexicon."""
        found: list[list[int] | None] = [None] * len(words)
        if not len(self.keys):
            return found
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST_WORD))
        state = np.full(len(words), self.root, np.int64)
        index = np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            key = state[live] << 8 | data[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[arc] == key
            live, arc = live[there], arc[there]
            state[live] = self.targets[arc]
            index[live] += self.outs[arc]
            step += 1
            ended = lengths[live] == step
            done = live[ended]
            done = done[self.finals[state[done]] == 1]
            for i, a, b in zip(done.tolist(), self.offsets[index[done]].tolist(), self.offsets[index[done] + 1].tolist(), strict=True):
                found[i] = self.ids[a:b].tolist()
            live = live[~ended]
        return found
