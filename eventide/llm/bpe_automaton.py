"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton starts with one state that loops over all bytes. Each merge u v -> w, in rank order, adds a gadget: the state
that u enters is split off without its v arc, and every state with a u arc gets a w arc to where v led. When all merges are
in, exactly the correct tokenizations are paths. Arcs to a token always enter the same state, so the table holds one entry
state per token; a state is kept as (token that owns it, rank at which a later gadget replaced it) and its missing arcs are
looked up there. Encoding a piece reads its bytes once: every prefix has exactly one path, so each offset gets one state, by
the one arc into it, among the tokens that end there, which its origin has. Decoding emits the arcs' labels.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.bpe_merges import NEVER, Memo, SuffixTokens, Vocabulary
from eventide.llm.common import blank_text, parts_of, ship

MOST_CHARACTERS = 500_000  # of the texts whose tokens a task holds at a time


class Automaton:
    def __init__(self, vocabulary: Vocabulary, most_pieces: int = 200_000):
        self.vocabulary = vocabulary
        self.most_pieces = most_pieces
        self._compile()
        self._ready()

    def _compile(self) -> None:
        """owner, until: of each state (state 0: all arcs); enter: the state that each token's arcs lead to."""
        self.enter = [0] * len(self.vocabulary.labels)
        self.owner, self.until = [-1], [NEVER]
        for r, (u, v, w) in enumerate(self.vocabulary.merges):
            before, after_v = self.enter[u], self.enter[v]
            if self.owner[before] == u:
                self.until[before] = r
            self.enter[u] = len(self.owner)
            self.owner.append(u)
            self.until.append(NEVER)
            self.enter[w] = after_v
        self.suffixes = SuffixTokens(self.vocabulary.of_bytes)

    def _ready(self) -> None:
        width = len(self.enter)
        owner, until, follows = self.owner, self.until, self.vocabulary.follows

        def has_arc(key: int) -> bool:
            state, token = divmod(key, width)
            return state == 0 or follows(owner[state], token, until[state])

        self.width = width
        self.arcs = Memo(has_arc, 2 * self.most_pieces)
        self.pieces = Memo(self._packed, self.most_pieces)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("arcs", "pieces")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _packed(self, piece: str) -> bytes:
        return np.array(self.path(piece.encode()), dtype="<u4").tobytes()

    def path(self, b: bytes) -> list[int]:
        """The tokens of the one path that spells b."""
        n, enter, arcs, width = len(b), self.enter, self.arcs, self.width
        step, following, out_of = self.suffixes.step, self.suffixes.next, self.suffixes.out
        token, origin, state = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        node = 0
        for i, c in enumerate(b, 1):
            key = node << 8 | c
            node = step[key] if key in step else following(node, c)
            for t, size in out_of[node]:
                j = i - size
                if arcs[state[j] * width + t]:
                    token[i], origin[i], state[i] = t, j, enter[t]
                    break
        out = []
        while n:
            if token[n] < 0:
                raise ValueError("a byte is not in the vocabulary")
            out.append(token[n])
            n = origin[n]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = []
        for special, s in self.vocabulary.segments(text):
            if special:
                parts.append(np.array([self.vocabulary.special[s]], dtype="<u4").tobytes())
            else:
                parts += map(self.pieces.__getitem__, self.vocabulary.split(s))
        return b"".join(parts)

    def decode(self, ids) -> str:
        """Labels joined; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.labels.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then ids array<int>: the tokens of each whole text (null: empty, no tokens). Other columns are left out.

    One narrow pass, no shuffle: rows stay in their scan partition and a task holds the ids of about ``MOST_CHARACTERS``.
    """
    def run(row: Automaton, t: str):
        return np.frombuffer(row.encode(t), dtype="<u4").astype(np.int32)

    return _over_texts(docs, vocabulary, text, keep, [("ids", pa.list_(pa.int32()), "array<int>")], lambda a, t: (run(a, t),))


def digest_documents(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256: encode, decode what was encoded, and digest both."""
    def run(a: Automaton, t: str):
        packed = a.encode(t)
        decoded = a.decode(np.frombuffer(packed, dtype="<u4").tolist())
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _over_texts(docs, vocabulary, text, keep, [
        ("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")], run)


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and text, from ids (null: null; an id outside the vocabulary fails)."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Automaton(Vocabulary(vocabulary)))
    fields = [encoded.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            texts = [None if x is None else a.decode(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string"])
    return encoded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, schema)


def _over_texts(docs: DataFrame, vocabulary: str, text: str, keep, outputs, each) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(Vocabulary(vocabulary)))
    names = [*keep, *(o[0] for o in outputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            for part in parts_of(b, len(keep), MOST_CHARACTERS):
                rows = [each(a, t.as_py()) for t in part.column(len(keep))]
                made = [pa.array([r[k] for r in rows], o[1]) for k, o in enumerate(outputs)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *made], names)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{o[0]} {o[2]}" for o in outputs)])
    return docs.select(*keep, blank_text(text).alias("_text")).mapInArrow(run, schema)
