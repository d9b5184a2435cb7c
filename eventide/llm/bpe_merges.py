"""Byte-pair vocabularies as tables: pieces, merges, and which token may follow which.

The vocabulary file is a JSON of the public ``tokenizers`` library (byte-level BPE). It is read on the
driver and broadcast: its size is that of the vocabulary, whatever the corpus.
"""
from __future__ import annotations

import json

import regex

#: The pattern that cuts text into pieces before merging, for byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte: itself where printable, the next free code point from 256 on else."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    rest = (b for b in range(256) if b not in set(printable))
    letters |= {chr(256 + i): b for i, b in enumerate(rest)}
    return letters


class Vocabulary:
    """labels: bytes of each id; left, right, born: the two parts and the rank of the merge that makes an id (bytes: born -1)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        added = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        size = 1 + max([*ids.values(), *added.values()])
        self.labels: list[bytes] = [b""] * size
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        for s, i in ids.items():
            if s not in added:
                self.labels[i] = bytes(letters[c] for c in s)
        self.special = {s: i for s, i in added.items() if s}
        for s, i in self.special.items():
            self.labels[i] = s.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            u, v, w = ids[a], ids[b], ids[a + b]
            if self.born[w] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.left[w], self.right[w], self.born[w] = u, v, r
            self.rank[u, v] = r
            self.merges.append((u, v, w))
        self.of_bytes = {b: i for i, b in enumerate(self.labels) if b and i not in set(self.special.values())}
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(PIECES).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "cut")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """The text cut at special strings: (is special, part), without empty parts."""
        if self.cut is None:
            return [(False, text)] if text else []
        return [(bool(i % 2), s) for i, s in enumerate(self.cut(text)) if s]

    def follows(self, x: int, t: int, until: int = NEVER) -> bool:
        """Whether t may stand right after x in a correct tokenization, with x's merges counted up to rank ``until`` only.

        No merge may join across the boundary: look for one among x or its right parts and t or its left parts, each at the
        time when both parts were whole tokens.
        """
        rank, born, left, right = self.rank, self.born, self.left, self.right
        while True:
            r = rank.get((x, t))
            if r is not None and r < until:
                return False
            bx, bt = born[x], born[t]
            if bt >= bx:
                if bt < 0:
                    return True
                t = left[t]
                if bt + 1 < until:
                    until = bt + 1
            else:
                x = right[x]
                if bx < until:
                    until = bx


class Memo(dict):
    """Results per key in two halves: when one is full, it takes the place of the older one. Bounded memory, the same answers.

    Keys that are asked for again come back from the older half, so frequent ones are made once.
    """

    def __init__(self, make, most: int = 250_000):
        super().__init__()
        self.make, self.half, self.older = make, max(1, most // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        out = self.older.pop(key, None)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


class SuffixTokens:
    """For each prefix of a byte string, the tokens that are its suffixes: a trie over token bytes with failure links."""

    def __init__(self, tokens: dict[bytes, int]):
        self.step: dict[int, int] = {}
        depth_first: list[tuple[int, int, int]] = []
        ends = [-1]
        for b, i in tokens.items():
            node = 0
            for c in b:
                nxt = self.step.get(node << 8 | c)
                if nxt is None:
                    nxt = self.step[node << 8 | c] = len(ends)
                    depth_first.append((node, c, nxt))
                    ends.append(-1)
                node = nxt
            ends[node] = i
        children: dict[int, list[tuple[int, int]]] = {}
        for node, c, nxt in depth_first:
            children.setdefault(node, []).append((c, nxt))
        size = {i: len(b) for b, i in tokens.items()}
        self.fail = [0] * len(ends)
        self.out: list[tuple[tuple[int, int], ...]] = [()] * len(ends)
        level = [0]
        while level:
            below = []
            for node in level:
                for c, nxt in children.get(node, ()):
                    f = self.next(self.fail[node], c) if node else 0
                    self.fail[nxt] = f
                    own = ((ends[nxt], size[ends[nxt]]),) if ends[nxt] >= 0 else ()
                    self.out[nxt] = own + self.out[f]
                    below.append(nxt)
            level = below
        self.known = len(self.step)

    def next(self, node: int, c: int) -> int:
        """Where byte c leads; transitions found through failure links are kept."""
        step = self.step
        nxt = step.get(node << 8 | c)
        if nxt is not None:
            return nxt
        up = node
        while nxt is None and up:
            up = self.fail[up]
            nxt = step.get(up << 8 | c)
        nxt = nxt or 0
        if hasattr(self, "known"):
            step[node << 8 | c] = nxt
        return nxt
