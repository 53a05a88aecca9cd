"""A double-array trie over token bytes, and count-only Viterbi over it."""

from __future__ import annotations

import math

import numpy as np


class DoubleArrayTrie:
    """Three integer arrays: the child of node n by byte b is base[n] + b + 1 if check there is n; value >= 0 ends a token."""

    def __init__(self, tokens: dict[bytes, int]):
        keys = sorted(tokens)
        size = 1 << 10
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        check[0], used[0] = 0, 1
        if keys and keys[0] == b"":
            keys = keys[1:]
        level = [(0, 0, len(keys), 0)] if keys else []
        free = 1
        while level:
            node, lo, hi, depth = level.pop()
            kids, i = [], lo
            if len(keys[lo]) == depth:
                i += 1
            while i < hi:
                b, j = keys[i][depth], i + 1
                while j < hi and keys[j][depth] == b:
                    j += 1
                kids.append((b, i, j))
                i = j
            if not kids:
                continue
            while used[free] if free < len(used) else False:
                free += 1
            at = max(0, free - kids[0][0] - 1)
            while True:
                while at + 258 >= len(used):
                    grow = len(used)
                    base, check, value = (np.concatenate([a, np.full(grow, fill, np.int32)]) for a, fill in ((base, 0), (check, -1), (value, -1)))
                    used += bytearray(grow)
                if not any(used[at + b + 1] for b, _, _ in kids):
                    break
                at += 1
            base[node] = at
            for b, i, j in kids:
                child = at + b + 1
                used[child], check[child] = 1, node
                if len(keys[i]) == depth + 1:
                    value[child] = tokens[keys[i]]
                level.append((child, i, j, depth + 1))
        self.base, self.check, self.value = base.tolist(), check.tolist(), value.tolist()

    def matches(self, text: bytes, start: int) -> list[tuple[int, int]]:
        """(end, token) of the tokens that begin at `start`."""
        base, check, value, node, out = self.base, self.check, self.value, 0, []
        for i in range(start, len(text)):
            child = base[node] + text[i] + 1
            if check[child] != node:
                break
            node = child
            if value[node] >= 0:
                out.append((i + 1, value[node]))
        return out


def unigram_count(trie: DoubleArrayTrie, scores: list[float], text: bytes, unknown: float = -100.0) -> int:
    """Tokens on the best path of `text` under a unigram vocabulary; a byte that no token covers costs `unknown` and counts as one.

    Only the best score and the length of the best path are kept for each position, no path. Equal scores prefer fewer tokens.
    """
    n = len(text)
    best, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for i in range(n):
        if best[i] == -math.inf:
            continue
        for j, t in [*trie.matches(text, i), (i + 1, None)]:
            s = best[i] + (unknown if t is None else scores[t])
            if s > best[j] or s == best[j] and count[i] + 1 < count[j]:
                best[j], count[j] = s, count[i] + 1
    return count[n]


class BpeCount:
    """Tokens of a byte-BPE vocabulary by the same count-only dynamic program.

    A BPE encoding is the only path on which every two neighbours are themselves the encoding of their joined bytes; so
    in place of a sum of scores a step is allowed when the token agrees with the last one before it. For each position
    the last token and the length of the only valid path to it are kept.
    """

    def __init__(self, ranks: dict[bytes, int], trie: DoubleArrayTrie):
        self.ranks, self.trie = ranks, trie
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """The encoding by merges in order of rank; used to decide on pairs."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
            if rank == math.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [self.bytes[a], self.bytes[b]]
        return known

    def count(self, text: bytes) -> int:
        n = len(text)
        if text in self.ranks:
            return 1
        last, count = [-1] * (n + 1), [-1] * (n + 1)
        count[0] = 0
        base, check, value, pairs = self.trie.base, self.trie.check, self.trie.value, self.pairs
        for i in range(n):
            if count[i] < 0:
                continue
            node, before = 0, last[i]
            for j in range(i, n):
                child = base[node] + text[j] + 1
                if check[child] != node:
                    break
                node, t = child, value[child]
                if t >= 0 and count[j + 1] < 0 and (before < 0 or (pairs[before, t] if (before, t) in pairs else self.agree(before, t))):
                    last[j + 1], count[j + 1] = t, count[i] + 1
        return count[n]
