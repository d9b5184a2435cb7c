"""Language identification by a linear-chain conditional random field over words.

A word's emission score for a language sums learned weights of its character n-grams (one to four characters, with markers at
both ends, so n-grams that hold a marker are its prefixes and suffixes) and a learned multiple of its lexicon score. The
lexicon is the log share of the word's hash bucket in each language, counted by Spark over all training documents; its size is
a parameter. Transitions are learned on code-switched sequences, made of spans of training documents in turn. Labels come from
forward-backward over all words of a text; the document's language has the largest mean posterior over words with a letter.

The weights are fitted on the driver on at most ``per_language`` training documents of each language, chosen by hash. Tables
sent to tasks are of fixed size. Prediction is one narrow pass; a task runs all its documents step by step together.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import ship

BLANKS = r"[\x20\x09-\x0D]+"
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def word_features(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) of every n-gram of every marked word."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    at, features = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, 5):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        inside = owner[:m] == owner[n - 1:]
        at.append(owner[:m][inside])
        features.append((h[inside] >> np.uint64(20)) % np.uint64(size))
    return np.concatenate(at), np.concatenate(features).astype(np.int64)


def bucket_of(word: str, size: int) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % size


def forward_backward(emission: np.ndarray, offsets: np.ndarray, transition: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Posteriors of packed sequences: row offsets[t] + r is step t of sequence r, sequences longest first.

    ``pairs``, if given, is added the expected transition counts.
    """
    scores = np.exp(emission - emission.max(axis=1, keepdims=True))
    move = np.exp(transition)
    steps = len(offsets) - 1
    alpha = np.empty_like(scores)
    before = None
    for t in range(steps):
        s, e = offsets[t], offsets[t + 1]
        a = scores[s:e] if before is None else (before[: e - s] @ move) * scores[s:e]
        before = alpha[s:e] = a / a.sum(axis=1, keepdims=True)
    out = np.empty_like(scores)
    beta = np.ones((offsets[1] - offsets[0] if steps else 0, emission.shape[1]))
    for t in range(steps - 1, -1, -1):
        s, e = offsets[t], offsets[t + 1]
        p = alpha[s:e] * beta[: e - s]
        out[s:e] = p / p.sum(axis=1, keepdims=True)
        if t:
            b = scores[s:e] * beta[: e - s]
            if pairs is not None:
                q = alpha[offsets[t - 1]:offsets[t - 1] + e - s, :, None] * move * b[:, None, :]
                pairs += (q / q.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ move.T
            beta[: e - s] = b / b.sum(axis=1, keepdims=True)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    lexicon: np.ndarray  # buckets x languages, log shares
    lexicon_weight: float
    transition: np.ndarray
    most_words: int = 400_000
    index: dict = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)
    lettered: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"index": {}, "table": None, "lettered": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        at, f = word_features(words, len(self.weights))
        out = np.stack([np.bincount(at, self.weights[f, k], len(words)) for k in range(len(self.languages))], axis=1)
        return out + self.lexicon_weight * self.lexicon[[bucket_of(w, len(self.lexicon)) for w in words]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        count = len(self.languages)
        if len(self.index) > self.most_words:
            self.index.clear()
        if not self.index:
            self.table, self.lettered = np.zeros((0, count)), np.zeros(0, dtype=bool)
        index, fresh = self.index, []
        rows: list[np.ndarray] = []
        for t in texts:
            ids = []
            for w in (t or "").encode("utf-8", "surrogatepass").split():
                i = index.get(w)
                if i is None:
                    i = index[w] = len(index)
                    fresh.append(w.decode("utf-8", "surrogatepass"))
                ids.append(i)
            rows.append(np.array(ids, dtype=np.int64))
        if fresh and count:
            self.table = np.concatenate([self.table, self.emissions(fresh)])
            self.lettered = np.concatenate([self.lettered, [LETTER.search(w) is not None for w in fresh]])
        sizes = np.array([len(r) for r in rows])
        order = np.argsort(-sizes, kind="stable")
        most = int(sizes.max(initial=0))
        active = len(rows) - np.searchsorted(np.sort(sizes), np.arange(most), "right")
        offsets = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
        packed = np.empty(offsets[-1], dtype=np.int64)
        for r, k in enumerate(order):
            packed[offsets[: sizes[k]] + r] = rows[k]
        if not count or not most:
            return [UNKNOWN] * len(rows), [0.0] * len(rows)
        seen = self.lettered[packed]
        p = forward_backward(self.table[packed], offsets, self.transition) * seen[:, None]
        total, words = np.zeros((len(rows), count)), np.zeros(len(rows))
        for t in range(most):
            s, e = offsets[t], offsets[t + 1]
            total[: e - s] += p[s:e]
            words[: e - s] += seen[s:e]
        names, scores = [UNKNOWN] * len(rows), [0.0] * len(rows)
        for r, k in enumerate(order):
            if words[r]:
                best = int(total[r].argmax())
                names[k], scores[k] = self.languages[best], float(min(1.0, total[r, best] / words[r]))
        return names, scores


def _sequences(texts: list[list[str]], labels: list[int], count: int, length: int, rng) -> tuple[list[str], np.ndarray]:
    """Words and labels of ``count`` sequences: half from one document, half switching between documents."""
    usable = [i for i, t in enumerate(texts) if t]
    words, tags = [], []
    for n in range(count):
        left = length
        while left:
            i = usable[rng.integers(len(usable))]
            span = left if n % 2 else min(left, int(rng.integers(3, 20)))
            at = int(rng.integers(max(1, len(texts[i]) - span + 1)))
            part = texts[i][at:at + span]
            words += part
            tags += [labels[i]] * len(part)
            left -= len(part)
    return words, np.array(tags)


def fit(training: DataFrame, text: str = "text", label: str = "lang", per_language: int = 300, features: int = 1 << 15,
        buckets: int = 1 << 16, sequences: int = 3000, length: int = 40, rounds: int = 30, seed: int = 3) -> Model:
    """Fit on rows with text and label. No such rows give a model without languages, which calls everything unknown."""
    rows = training.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("string").alias("l"))
    word = F.explode(F.split(F.lower("t"), BLANKS)).alias("w")
    counts = rows.select("l", word).filter("w != ''").groupBy("l", F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(buckets)).alias("k")).count().toPandas()
    # hashes are ranked, not texts: a task sends on a few numbers per language, and copies of a text count once
    hashed = rows.withColumn("h", F.xxhash64("t", F.lit(seed)))
    ranked = hashed.select("l", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h")))
    last = ranked.filter(F.col("n") <= per_language).groupBy("l").agg(F.max("h").alias("last")).collect()  # a row per language
    chosen = F.lit(False)
    for r in last:
        chosen = chosen | ((F.col("l") == r["l"]) & (F.col("h") <= r["last"]))
    sample = hashed.filter(chosen).dropDuplicates(["l", "h"]).select("t", "l").toPandas()
    sample = sample.sort_values(["l", "t"])
    languages = sorted(set(sample["l"]))
    n = len(languages)
    lexicon = np.full((buckets, n), 0.5)
    place = {x: i for i, x in enumerate(languages)}
    known = counts["l"].isin(languages)
    lexicon[counts["k"][known].to_numpy(np.int64), counts["l"][known].map(place).to_numpy(np.int64)] += counts["count"][known].to_numpy()
    lexicon = np.log(lexicon / lexicon.sum(axis=0) * buckets)
    lexicon -= lexicon.mean(axis=1, keepdims=True) if n else 0
    model = Model(languages, np.zeros((features, n)), lexicon, 0.5, np.zeros((n, n)))
    texts = [t.split() for t in sample["t"]]
    if n < 2 or not any(texts):
        return model
    words, tags = _sequences(texts, [place[x] for x in sample["l"]], sequences, length, np.random.default_rng(seed))
    distinct = sorted(set(words))
    number = {w: i for i, w in enumerate(distinct)}
    # packed by step: row t * sequences + r
    ids = np.array([number[w] for w in words]).reshape(sequences, length).T.ravel()
    tags = tags.reshape(sequences, length).T.ravel()
    offsets = np.arange(length + 1) * sequences
    at, f = word_features(distinct, features)
    own = lexicon[[bucket_of(w, buckets) for w in distinct]]
    observed = np.zeros((n, n))
    np.add.at(observed, (tags[:-sequences], tags[sequences:]), 1.0)
    theta = [model.weights, model.transition, np.array([model.lexicon_weight])]
    squares = [np.full_like(x, 1e-6) for x in theta]
    for _ in range(rounds):
        words_score = np.stack([np.bincount(at, theta[0][f, k], len(distinct)) for k in range(n)], axis=1) + theta[2] * own
        pairs = np.zeros((n, n))
        p = forward_backward(words_score[ids], offsets, theta[1], pairs)
        p[np.arange(len(tags)), tags] -= 1.0
        by_word = -np.stack([np.bincount(ids, p[:, k], len(distinct)) for k in range(n)], axis=1)
        gradient = [np.stack([np.bincount(f, by_word[at, k], features) for k in range(n)], axis=1) - 0.1 * theta[0],
                    observed - pairs - 0.1 * theta[1], np.array([(by_word * own).sum()])]
        for x, s, g in zip(theta, squares, gradient, strict=True):
            s += g * g
            x += 0.2 * g / np.sqrt(s)
    model.lexicon_weight = float(theta[2][0])
    return model


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
             label: str = "lang_pred", score: str = "lang_score", most_characters: int = 1_000_000) -> DataFrame:
    """``keep`` columns, lang_pred and lang_score (0 to 1), or as named. ``und`` and 0 for a null text or one without a letter.

    Texts are predicted in parts of about ``most_characters``; a longer text is a part of its own.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, label, score]
    # the text travels once: where it is kept, it is read from there
    kept = text in keep and docs.schema[text].dataType.simpleString() == "string"
    sent = docs.select(*keep) if kept else docs.select(*keep, F.col(text).cast("string").alias("_text"))
    place = keep.index(text) if kept else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, size = 0, 0
            lengths = pc.fill_null(pc.utf8_length(b.column(place)), 0).to_pylist()
            for end in range(1, b.num_rows + 1):
                size += lengths[end - 1]
                if size > most_characters or end == b.num_rows:  # bounds memory; documents are independent of each other
                    part = b.slice(start, end - start)
                    labels, scores = shared.value.predict(part.column(place).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names)
                    start, size = end, 0

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"{label} string, {score} double"])
    return sent.mapInArrow(run, schema)


def training_fold(doc_id: str = "doc_id") -> Column:
    """True for held-out rows: crc32 of the id as text leaves 1 when divided by 3. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))
