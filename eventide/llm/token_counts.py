"""Token counts of every prefix of a text, by dynamic programming.

A piece's prefix of i bytes ends in one token t: the only one among the vocabulary's suffixes of that prefix that may follow
the last token of the prefix before it. So count[i] = count[i - len(t)] + 1, and every prefix's count is exact, not only the
whole piece's. A text's counts are its pieces' counts plus what stood before, mended where a cut changes how the text is
split into pieces (white-space runs, contractions, special strings). Truncation and budget questions are then searches in the
array: nothing is encoded again.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventide.llm.bpe_merges import Memo, SuffixTokens, Vocabulary
from eventide.llm.common import blank_text, ship

#: Contractions of which a shorter prefix is split otherwise.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounts:
    def __init__(self, vocabulary: Vocabulary, most_pieces: int = 500_000):
        self.vocabulary, self.most_pieces = vocabulary, most_pieces
        self.suffixes = SuffixTokens(vocabulary.of_bytes)
        self.size = [len(b) for b in vocabulary.labels]
        self._ready()

    def _ready(self) -> None:
        width, follows = len(self.size), self.vocabulary.follows
        self.width = width
        self.may = Memo(lambda k: follows(*divmod(k, width)), 2 * self.most_pieces)
        self.pieces = Memo(self._entry, self.most_pieces)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("may", "pieces")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def piece(self, b: bytes) -> list[int]:
        """Token count of each prefix of b, from the empty one on."""
        n, may, width = len(b), self.may, self.width
        step, following, out_of = self.suffixes.step, self.suffixes.next, self.suffixes.out
        count, last = [0] * (n + 1), [-1] * (n + 1)
        node = 0
        for i, c in enumerate(b, 1):
            key = node << 8 | c
            node = step[key] if key in step else following(node, c)
            for t, size in out_of[node]:
                j = i - size
                if j == 0 or may[last[j] * width + t]:
                    count[i], last[i] = count[j] + 1, t
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")
        return count

    def _entry(self, s: str) -> tuple[bytes, int, int, int]:
        """Counts at each character end (packed), their number, the last count, and 1 for white space only, 2 for white space first."""
        b = s.encode()
        c = self.piece(b)
        if len(b) != len(s):
            at = [i for i in range(1, len(b) + 1) if i == len(b) or b[i] & 0xC0 != 0x80]
            kept = [c[i] for i in at]
        else:
            kept = c[1:]
        if s in LONG_CONTRACTIONS:
            kept[1] = 2
        return np.array(kept, dtype="<u4").tobytes(), len(s), c[-1], 1 if s.isspace() else 2 if s[0].isspace() else 0

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i = 0 .. len(text)."""
        out, before, segment = [np.zeros(1, dtype=np.int64)], 0, ""
        for special, s in self.vocabulary.segments(text):
            if special:
                mended = [before - self._total(segment) + self._total(segment + s[:i]) for i in range(1, len(s))]
                before += 1
                out.append(np.array([*mended, before], dtype=np.int64))
                segment = ""
            else:
                own = self._segment(s)
                out.append(own + before)
                before += int(own[-1])
                segment = s
        return np.concatenate(out)

    def _total(self, s: str) -> int:
        return sum(self.pieces[p][2] for p in self.vocabulary.split(s))

    def _segment(self, s: str) -> np.ndarray:
        pieces = self.vocabulary.split(s)
        packed, sizes, totals, kinds = zip(*map(self.pieces.__getitem__, pieces), strict=True)
        sizes, kinds = np.array(sizes), np.array(kinds)
        ends = np.cumsum(np.array(totals, dtype=np.int64))
        before = np.concatenate([[0], ends[:-1]])
        out = np.frombuffer(b"".join(packed), dtype="<u4") + np.repeat(before, sizes)
        # a text cut right after the first character of a piece that continues a white-space run has that run as one piece
        for k in np.flatnonzero((kinds[1:] > 0) & (kinds[:-1] == 1)) + 1:
            first = int(sizes[:k].sum())
            out[first] = before[k - 1] + self.pieces[pieces[k - 1] + pieces[k][0]][2]
        return out


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The most characters of a text that come to at most ``budget`` tokens (counts of longer prefixes can be smaller)."""
    return int(np.flatnonzero(counts <= budget)[-1])


def count_documents(docs: DataFrame, vocabulary: str, limit: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                    with_prefixes: bool = False) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens, over_limit and chars_within (longest prefix of at most ``limit`` tokens).

    ``with_prefixes`` adds prefix_tokens array<int>, the count of every prefix. A null text is read as empty (0 tokens).
    Columns of the input that are not kept do not matter, whatever their names.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(PrefixCounts(Vocabulary(vocabulary)))
    names = [*keep, "n_bytes", "n_tokens", "over_limit", "chars_within", *["prefix_tokens"] * with_prefixes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            n_bytes, n_tokens, within, arrays = [], [], [], []
            for t in b.column(len(keep)):
                s = t.as_py()
                c = table.counts(s)
                n_bytes.append(len(s.encode()))
                n_tokens.append(int(c[-1]))
                within.append(longest_within(c, limit))
                if with_prefixes:
                    arrays.append(c.astype(np.int32))
            made = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()),
                    pa.array(within, pa.int64()), *([pa.array(arrays, pa.list_(pa.int32()))] if with_prefixes else [])]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *made], names)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep),
                        "n_bytes long, n_tokens long, over_limit boolean, chars_within long", *["prefix_tokens array<int>"] * with_prefixes])
    return docs.select(*keep, blank_text(text).alias("_text")).mapInArrow(run, schema)
