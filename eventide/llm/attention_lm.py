"""Scoring texts with a causal self-attention model over subword ids, next to a smoothed unigram base.

Texts are lower-cased and cut into words; words are coded by a public tokenizer (" word"), one end closes a text. The model
gives P(id | before) = P(class | before) * P(id | class, class before it in the word). Classes group ids that keep like
company; the second factor comes from the counts of all training words. P(class | before) is one layer of masked self-attention with relative positions, written
and trained in numpy: Spark tasks run mini-batches over their share of the training windows and the weights are averaged,
round by round; every training document is in one round. Scoring uses windows that overlap by ``OVERLAP`` tokens, so each token is scored once, with at least that much
of what stands before it (if there is that much), in batches of masked attention.

Texts are read and coded once: a bucket of documents settles the ids of its texts, the places of their words among the bucket's distinct
words, and those words. All later passes read ids. Counts of words are looked up by buckets: a bucket's distinct words are counted over
all buckets in one window, and meet the bucket's documents in one co-group. Rows shuffled grow with documents and distinct words per bucket.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import blank_text, settle, ship

WIDTH, OVERLAP = 40, 16
STEP = WIDTH - OVERLAP
CLASSES, DIMS, SINGLE = 96, 16, 48
FREQUENT, REACH = 48, 4  # ids that tell classes apart, by standing at most so far from an id
TRUST = 10.0  # training tokens that the class's own shares weigh against those after a given class
END_WORD = b""  # no word is empty
BLANK = re.compile(r"[^\S ]")


@lru_cache(maxsize=2)
def coder(path: str):
    """The tokenizer of a file of base64 ranks; its next free id is the end."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # on bytes: A-Z and the six ASCII blanks only


@lru_cache(maxsize=2)
def begins_word(path: str) -> np.ndarray:
    """By id, whether its bytes begin with the space that stands before a word; true for the end."""
    enc, end = coder(path)
    return np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(end)] + [True])


def code_words(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word, flattened, and their number by word. The empty word stands for the end.

    Words are joined and coded in one call: no piece of the pattern reaches past a word's end, but for words that hold blanks beyond
    ASCII, which are coded alone. Only the first id of a word begins with a space.
    """
    enc, end = coder(path)
    texts = [" " + w.decode() for w in words]
    odd = {i: [end] for i, t in enumerate(texts) if len(t) == 1}
    if BLANK.search("".join(texts)):
        odd |= {i: enc.encode_ordinary(t) for i, t in enumerate(texts) if BLANK.search(t)}
    ids = np.array(enc.encode_ordinary("".join(t for i, t in enumerate(texts) if i not in odd) if odd else "".join(texts)), dtype=np.int32)
    sizes = np.diff(np.flatnonzero(begins_word(path)[ids]), append=len(ids)).astype(np.int64)
    if not odd:
        return ids, sizes
    at = np.array(sorted(odd), dtype=np.int64)
    before = at - np.arange(len(at))  # plain words that stand before
    ends = np.concatenate([[0], np.cumsum(sizes)])
    own = np.array([len(odd[i]) for i in at.tolist()], dtype=np.int64)
    ids = np.insert(ids, np.repeat(ends[before], own), [x for i in at.tolist() for x in odd[i]])
    return ids.astype(np.int32), np.insert(sizes, before, own)


# --- the model -----------------------------------------------------------------------------------------------------------

SHAPES = {"embed": (CLASSES + 1, DIMS), "q": (DIMS, DIMS), "k": (DIMS, DIMS), "v": (DIMS, DIMS), "near": (WIDTH,), "out": (DIMS, CLASSES), "bias": (CLASSES,)}
BEFORE = np.arange(OVERLAP, WIDTH)[None, :] - np.arange(WIDTH)[:, None]  # by place read, then by place scored
AGO = np.maximum(BEFORE, 0)
SEEN = (BEFORE >= 0).astype(np.float32)
FUTURE = np.where(BEFORE < 0, np.float32(-1e9), np.float32(0))
ENDS = np.cumsum([int(np.prod(shape)) for shape in SHAPES.values()]).tolist()


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {name: flat[start:end].reshape(shape) for (name, shape), start, end in zip(SHAPES.items(), [0, *ENDS], ENDS, strict=False)}


def start_weights(class_shares: np.ndarray, follows: np.ndarray, seed: int = 5) -> np.ndarray:
    """Random attention over a start that gives, in low rank, how often a class (row; the last: the text begins) is followed by another."""
    rng = np.random.default_rng(seed)
    class_shares = np.maximum(class_shares, 1e-9)  # a class can be empty
    p = {n: rng.normal(0, DIMS ** -0.5, s) for n, s in SHAPES.items()}
    p["v"] *= 0.1
    p["near"], p["bias"] = np.zeros(WIDTH), np.log(class_shares)
    shares = (follows + 5 * class_shares) / (follows.sum(axis=1, keepdims=True) + 5)
    weight = np.sqrt((follows.sum(axis=1, keepdims=True) + 1) / (follows.sum() + len(follows)))
    half = DIMS // 2
    u, scale, v = np.linalg.svd(np.log(shares / class_shares) * weight, full_matrices=False)
    root = np.sqrt(scale[:half])
    u = u[:, :half] * root / weight
    p["embed"] = np.concatenate([u, -u], axis=1)  # of a number and its negative one passes the rectifier
    p["out"] = np.concatenate([v[:half] * root[:, None], -v[:half] * root[:, None]])
    return np.concatenate([p[n].ravel() for n in SHAPES]).astype(np.float32)


class Attention:
    """The layer with its projections as tables by class: what stands in a place is a class, so rows are looked up, not multiplied.

    A last row, ``NOTHING``, stands for places with nothing there. A column more in queries and keys hides those, one more in values gives
    the sums of the attention, and one more in the last layer adds the bias, so no pass over the scores is spent on them. Products go
    window by window: larger ones start BLAS threads wherever ``OMP_NUM_THREADS`` is not 1, as Spark sets it for its workers.
    Scores stand by place read, then by place scored, so that a window's largest are found along whole rows. ``held`` keeps
    the large arrays from batch to batch.
    """

    def __init__(self, flat: np.ndarray, held: dict | None = None):
        p = self.p = unpack(flat)
        self.held, self.kind, self.scale = {} if held is None else held, flat.dtype, flat.dtype.type(DIMS ** -0.5)
        self.x = self._table(p["embed"])
        self.q = self._table(p["embed"] @ p["q"] * self.scale, 1, 1)
        self.k = self._table(p["embed"] @ p["k"], 0, -1e9)
        self.v = self._table(p["embed"] @ p["v"], 1, 1)
        self.near = p["near"][AGO] + FUTURE
        self.out = np.concatenate([p["out"], p["bias"][None]])

    def _table(self, rows: np.ndarray, *more: float) -> np.ndarray:
        """Rows by class, then nothing's; ``more``: a further column's value for the classes and for nothing."""
        out = np.zeros((CLASSES + 2, DIMS + (len(more) > 0)), self.kind)
        out[:-1, :DIMS] = rows
        if more:
            out[:-1, DIMS], out[-1, DIMS] = more
        return out

    def room(self, name: str, n: int, *shape: int) -> np.ndarray:
        """An array for ``n`` windows with what it held before in it."""
        got = self.held.get((name, self.kind))
        if got is None or len(got) < n:
            got = self.held[name, self.kind] = np.empty((n, *shape), self.kind)
        return got[:n]

    def rows(self, name: str, table: np.ndarray, c: np.ndarray) -> np.ndarray:
        return table.take(c, axis=0, out=self.room(name, len(c), c.shape[1], table.shape[1]), mode="clip")

    @property
    def total(self) -> np.ndarray:
        return 1 / self.share[..., :1]

    def forward(self, seen: np.ndarray) -> None:
        """Weights before they are divided by their total, what is read, the last layer's input and its logits."""
        n = len(seen)
        self.c = np.where(seen < 0, NOTHING, seen).astype(np.intp)
        last = self.c[:, OVERLAP:]
        self.qs, self.ks, self.vs = self.rows("q", self.q, last), self.rows("k", self.k, self.c), self.rows("v", self.v, self.c)
        w = self.w = np.matmul(self.ks, self.qs.transpose(0, 2, 1), out=self.room("w", n, WIDTH, STEP))
        w += self.near
        most = w
        while most.shape[1] % 2 == 0:
            half = most.shape[1] // 2
            most = np.maximum(most[:, :half], most[:, half:], out=self.room(f"most {half}", n, half, STEP))
        w -= most.max(axis=1, keepdims=True)
        np.maximum(w, FAINT, out=w)
        np.exp(w, out=w)
        w *= SEEN
        read = np.matmul(w.transpose(0, 2, 1), self.vs, out=self.room("read", n, STEP, DIMS + 1))
        self.share = along(1 / read[..., DIMS], DIMS)  # of the total
        self.read = np.multiply(read[..., :DIMS], self.share, out=self.room("mean", n, STEP, DIMS))
        self.u = self.rows("u", self.x, last)
        self.u += self.read
        self.h = self.room("h", n, STEP, DIMS + 1)
        self.h[..., DIMS] = 1
        np.maximum(self.u, 0, out=self.h[..., :DIMS])
        self.z = np.matmul(self.h, self.out, out=self.room("z", n, STEP, CLASSES)).reshape(-1, CLASSES)
        if not -WIDE < self.z.min() <= self.z.max() < WIDE:
            self.z -= self.z.max(axis=1, keepdims=True)

    def log_probs(self, goals: np.ndarray) -> np.ndarray:
        """Of the goals (-1: any number); the logits become shares before they are divided by ``mass``."""
        own = self.z[np.arange(len(self.z)), np.maximum(goals, 0)]
        np.exp(self.z, out=self.z)
        self.mass = self.z @ ONES.astype(self.kind)
        return own - np.log(self.mass)


NOTHING = CLASSES + 1
FAINT = -46  # beside a weight of one no sum of single precision shows one of this logarithm; products of much smaller ones are slow
WIDE = 60  # single precision holds the exponentials of numbers up to this, and their sums
ONES = np.ones(CLASSES, np.float32)


def along(x: np.ndarray, n: int) -> np.ndarray:
    """Each number ``n`` times, in a last axis: arrays of one shape are multiplied far faster than a short axis by one number at a time."""
    return np.repeat(x, n).reshape(*x.shape, n)


def by_class(c: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
    """Sums of the rows by class."""
    c = c.ravel()
    order = np.argsort(c, kind="stable")
    held = c[order]
    begins = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    out = [np.zeros((CLASSES + 2, r.shape[-1]), r.dtype) for r in rows]
    for total, r in zip(out, rows, strict=True):
        total[held[begins]] = np.add.reduceat(r.reshape(len(c), -1).take(order, axis=0), begins, axis=0)
    return [total[:CLASSES + 1, :DIMS] for total in out]


def gradient(flat: np.ndarray, seen: np.ndarray, target: np.ndarray, held: dict | None = None) -> tuple[float, np.ndarray]:
    """Loss and gradient over windows. seen: classes read (-1: nothing there); target: next class (-1: not scored)."""
    m = Attention(flat, held)
    p, n = m.p, len(seen)
    m.forward(seen)
    goals = target[:, OVERLAP:].ravel()
    scored = goals >= 0
    one = m.kind.type(1) / m.kind.type(np.count_nonzero(scored))
    loss = -float(m.log_probs(goals)[scored].mean())
    each = along(np.where(scored, one / m.mass, m.kind.type(0)).reshape(n, STEP), DIMS + 1)
    m.z[np.arange(len(m.z)), np.maximum(goals, 0)] -= m.mass  # of a place that is not scored: any, it weighs nothing
    e = m.z.reshape(n, STEP, CLASSES)
    du = np.matmul(e, p["out"].T, out=m.room("du", n, STEP, DIMS))
    du *= each[..., :DIMS]
    du *= m.u > 0
    each *= m.h
    last = (each.transpose(0, 2, 1) @ e).sum(axis=0)
    g = {"out": last[:DIMS], "bias": last[DIMS]}
    # of a weight's share: what its value adds, less what all values add on average
    back = m.room("back", n, STEP, DIMS + 1)
    np.multiply(du, m.share, out=back[..., :DIMS])
    np.negative(np.einsum("btd,btd->bt", back[..., :DIMS], m.read), out=back[..., DIMS])
    dv = np.matmul(m.w, back, out=m.room("dv", n, WIDTH, DIMS + 1))
    ds = np.matmul(m.vs, back.transpose(0, 2, 1), out=m.room("ds", n, WIDTH, STEP))
    ds *= m.w
    g["near"] = np.bincount(AGO.ravel(), ds.sum(axis=0).ravel(), WIDTH)
    dk = np.matmul(ds, m.qs, out=m.room("dk", n, WIDTH, DIMS + 1))
    dq = np.matmul(ds.transpose(0, 2, 1), m.ks, out=m.room("dq", n, STEP, DIMS + 1))
    c = m.c.astype(np.int16)
    (dx, dq), (dk, dv) = by_class(c[:, OVERLAP:], du, dq), by_class(c, dk, dv)
    dq = dq * m.scale
    g["q"], g["k"], g["v"] = (p["embed"].T @ d for d in (dq, dk, dv))
    g["embed"] = dx + dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
    return loss, np.concatenate([g[k].ravel() for k in SHAPES]).astype(np.float32)


class Trainer:
    """Adam over mini-batches of windows, from batch to batch of a task."""

    def __init__(self, flat: np.ndarray, rate: float, batch: int = 64):
        self.flat, self.rate, self.batch = flat.copy(), rate, batch
        self.first, self.second, self.steps, self.seen, self.held = np.zeros_like(flat), np.zeros_like(flat), 0, 0, {}

    def over(self, seen: np.ndarray, target: np.ndarray) -> None:
        for at in range(0, len(seen), self.batch):
            _, g = gradient(self.flat, seen[at:at + self.batch], target[at:at + self.batch], self.held)
            self.steps += 1
            self.first += 0.1 * (g - self.first)
            self.second += 0.01 * (g * g - self.second)
            rise = self.rate / (1 - 0.9 ** self.steps)
            self.flat -= np.float32(rise) * self.first / (np.sqrt(self.second / np.float32(1 - 0.99 ** self.steps)) + np.float32(1e-6))
        self.seen += len(seen)


def train_locally(flat: np.ndarray, seen: np.ndarray, target: np.ndarray, rate: float, batch: int = 64) -> np.ndarray:
    """One pass over the windows."""
    t = Trainer(flat, rate, batch)
    t.over(seen, target)
    return t.flat


def windows(classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts laid end to end: classes read, next classes (-1 outside and in the overlap), and place of each window's first scored token."""
    each = -(-sizes // STEP)
    starts = np.cumsum(sizes) - sizes
    number = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    # every text after OVERLAP empty places and before as many as its last window has left
    wide = OVERLAP + each * STEP
    begins = np.cumsum(wide) - wide
    at = np.arange(len(classes)) + np.repeat(begins + OVERLAP - starts, sizes)
    laid = np.full((2, wide.sum() + 1), -1, dtype=np.int16)
    laid[0, at + 1] = classes
    laid[0, (begins + OVERLAP + sizes)[sizes > 0]] = -1
    laid[0, (begins + OVERLAP)[sizes > 0]] = CLASSES
    laid[1, at] = classes
    first = np.repeat(begins, each) + number * STEP
    seen, target = (np.lib.stride_tricks.sliding_window_view(x, WIDTH)[first] for x in laid)
    target[:, :OVERLAP] = -1
    return seen, target, np.repeat(starts, each) + number * STEP


def class_log_probs(flat: np.ndarray, classes: np.ndarray, sizes: np.ndarray, batch: int = 64) -> np.ndarray:
    """Log probability of every token's class, each scored once."""
    m = Attention(flat.astype(np.float32))
    seen, target, first = windows(classes, sizes)
    out = np.zeros(len(classes), dtype=np.float64)
    steps = np.arange(STEP)
    for at in range(0, len(seen), batch):
        m.forward(seen[at:at + batch])
        goal = target[at:at + batch, OVERLAP:].ravel()
        scored = goal >= 0
        where = (first[at:at + batch, None] + steps).ravel()
        out[where[scored]] = m.log_probs(goal)[scored]
    return out


def make_classes(company: np.ndarray, counts: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Class of each id: the most frequent ones are classes of their own, the rest are grouped by the frequent ids around them (``company``)."""
    order = np.argsort(-counts, kind="stable")
    seen = company.sum(axis=1)
    mean = company.sum(axis=0) / max(1.0, seen.sum())
    shape = np.sqrt((company + 4 * mean) / (seen + 4 * mean.sum() + 1e-12)[:, None])
    groups = CLASSES - SINGLE
    out = np.empty(len(counts), dtype=np.int64)
    rest = order[SINGLE:]
    centers = shape[rest[np.linspace(0, min(len(rest), 2000) - 1, groups).astype(int)]]
    weight = counts[rest] + 0.01
    for _ in range(rounds):
        nearest = (shape[rest] @ centers.T * 2 - (centers * centers).sum(axis=1)).argmax(axis=1)
        mass = np.bincount(nearest, weight, groups)
        for d in range(shape.shape[1]):
            centers[:, d] = np.where(mass > 0, np.bincount(nearest, weight * shape[rest, d], groups) / np.maximum(mass, 1e-9), centers[:, d])
    out[rest] = SINGLE + nearest
    out[order[:SINGLE]] = np.arange(SINGLE)
    return out


def frequent_ids(counts: np.ndarray) -> np.ndarray:
    """Number among the FREQUENT most frequent ids, -1 for the others."""
    column = np.full(len(counts), -1)
    column[np.argsort(-counts, kind="stable")[:FREQUENT]] = np.arange(FREQUENT)
    return column


def add_company(total: np.ndarray, ids: np.ndarray, sizes: np.ndarray, column: np.ndarray) -> None:
    """Adds to ``total`` (by id, then frequent id) the pairs of an id and a frequent one at most REACH apart in one text."""
    laid = np.full(len(ids) + REACH * (len(sizes) + 1), -1, dtype=np.int32)  # REACH empty places around each text
    laid[np.arange(len(ids)) + np.repeat(REACH * np.arange(1, len(sizes) + 1), sizes)] = ids
    held = np.where(laid < 0, -1, column.astype(np.int32)[laid])
    places = np.flatnonzero(held >= 0)
    near = held[places]
    for d in range(-REACH, REACH + 1):
        if d:
            other = laid[places + d]
            at = other * np.int64(FREQUENT) + near
            np.add.at(total, at[other >= 0], 1)


def add_follows(total: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> None:
    """Adds to ``total`` (by the class before, CLASSES: the text begins; then class) every token of the texts."""
    before = np.empty(len(classes), dtype=np.int64)
    before[1:] = classes[:-1]
    before[np.cumsum(sizes) - sizes] = CLASSES
    total += np.bincount(before * CLASSES + classes, minlength=len(total))


# --- Spark ---------------------------------------------------------------------------------------------------------------

def _id_kind(path: str) -> type:
    return np.uint16 if coder(path)[1] < 1 << 16 else np.uint32


def _packed(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value per text with its part of ``x``."""
    ends = np.concatenate([[0], np.cumsum(sizes) * x.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _parts(column: pa.Array, kind: type, room: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, numbers end to end and how many by row, of packed rows that have about ``room`` numbers."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) // kind().itemsize
    data = np.frombuffer(column.buffers()[2] or b"", kind)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + room, "right")) - 1)
        yield row, data[ends[row]:ends[stop]], np.diff(ends[row:stop + 1])
        row = stop


def _steps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row's numbers from small to large, each less the one before it in the row: they take half the room when packed."""
    rows = np.repeat(np.arange(len(sizes)) << 32, sizes)
    x = np.sort(rows + x) - rows
    out = np.diff(x, prepend=0)
    first = np.cumsum(sizes) - sizes
    out[first] = x[first]
    return out.astype(np.int32)


def _numbers(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ``_steps``; every row has some."""
    x = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    return x - np.repeat(x[first] - steps[first], sizes)


def _code(docs: DataFrame, path: str, bucket_rows: int, bucket_words: int = 1_500_000) -> DataFrame:
    """_id, train, mix of ``docs`` with ids and places (of the words among the bucket's words: from small to large, each less the one before),
    packed; a bucket's first row has its words and how often each stands in training documents (0: only elsewhere), the end included."""
    names = ["bucket", "_id", "train", "mix", "ids", "places", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, kind = TaskContext.get().partitionId() << 32, _id_kind(path)
        for b in batches:
            texts, train = b.column(3), b.column(1).to_numpy(zero_copy_only=False)
            row = 0
            while row < b.num_rows:
                place: defaultdict[bytes, int] = defaultdict()
                place.default_factory = place.__len__  # a new word's number
                held: list[np.ndarray] = []
                first, room, end = row, bucket_words, place[END_WORD]
                while row < b.num_rows and room > 0 and row - first < bucket_rows:
                    words = words_of(texts[row].as_py())
                    words.append(END_WORD)
                    held.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                    room -= len(words)
                    row += 1
                known = list(place)
                flat, sizes = code_words(path, known)
                starts = np.cumsum(sizes) - sizes
                lengths = np.array([len(x) for x in held], dtype=np.int64)
                every = np.concatenate(held)
                counts = np.bincount(every[np.repeat(train[first:row], lengths)], minlength=len(known))
                packed, at = [], 0
                for piece in np.split(every, np.cumsum(lengths)[np.searchsorted(np.cumsum(lengths), np.arange(200_000, len(every), 200_000))]):
                    n = sizes[piece]
                    ends = np.cumsum(n)
                    packed.append((flat[np.repeat(starts[piece] - (ends - n), n) + np.arange(n.sum())].astype(kind), ends))
                own = np.concatenate([x for x, _ in packed])
                id_ends = np.cumsum(sizes[every])[np.cumsum(lengths) - 1]
                more = [None] * (row - first - 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(row - first, bucket)), *(b.column(k).slice(first, row - first) for k in range(3)), _packed(own, np.diff(id_ends, prepend=0)),
                    _packed(_steps(every, lengths), lengths), pa.array([known, *more], pa.list_(pa.binary())), pa.array([counts, *more], pa.list_(pa.int64()))], names)
                bucket += 1

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "train", "mix", "_text").mapInArrow(
        run, f"bucket long, _id {kind}, train boolean, mix long, ids binary, places binary, words array<binary>, counts array<bigint>")


def _own(docs: DataFrame) -> DataFrame:
    """The texts' ids, or the texts where they are not coded yet."""
    return docs.select("ids" if "ids" in docs.columns else "_text")


def _coded(batches: Iterator[pa.RecordBatch], path: str, room: int = 500_000, most_words: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the texts in the batches' first column (``ids``: packed already), end to end, and their number by text; about ``room`` words or ids at a time."""
    place: defaultdict[bytes, int] = defaultdict()
    place.default_factory = place.__len__  # a new word's number
    flat, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def flush():
        nonlocal flat, sizes
        fresh = list(islice(place, len(sizes), None))
        if fresh:
            more, n = code_words(path, fresh)
            flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, n])
        every = np.concatenate(held)
        n = sizes[every]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[every] - (ends - n), n) + np.arange(n.sum())
        closes = ends[np.cumsum([len(x) for x in held]) - 1]
        held.clear()
        return flat[at], np.diff(closes, prepend=0)

    words = 0
    for b in batches:
        if b.schema.names[0] == "ids":
            yield from ((x.astype(np.int32), n) for _, x, n in _parts(b.column(0), _id_kind(path), room))
            continue
        for t in b.column(0):
            x = np.array([*map(place.__getitem__, words_of(t.as_py())), place[END_WORD]], dtype=np.int64)
            held.append(x)
            words += len(x)
            if words > room:
                yield flush()
                words = 0
                if len(place) > most_words:
                    place.clear()
                    flat, sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
    if held:
        yield flush()


def _sums(docs: DataFrame, path: str, cells: int, add) -> np.ndarray:
    """Sums over all ``docs`` of what ``add(total, ids, sizes)`` adds to a table of so many cells; a row per task and cell is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for ids, sizes in _coded(batches, path):
            add(total, ids, sizes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = _own(docs).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # by cells
    out = np.zeros(cells)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out


def _id_counts(docs: DataFrame, path: str) -> np.ndarray:
    """Occurrences of each id in all ``docs``."""
    def add(total, ids, sizes):
        total += np.bincount(ids, minlength=len(total))

    return _sums(docs, path, coder(path)[1] + 1, add)


def _after(docs: DataFrame, path: str, classes: np.ndarray) -> np.ndarray:
    """Occurrences of each id by the class before it in its word (CLASSES: it begins the word), in all ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def add(total, ids, sizes):
        np.add.at(total, before_in_word(path, ids, sent.value) * len(sent.value) + ids, 1)

    return _sums(docs, path, (CLASSES + 1) * len(classes), add).reshape(CLASSES + 1, -1)


def _company(docs: DataFrame, path: str, by_id: np.ndarray) -> np.ndarray:
    """How often each id stands near each frequent id, in all ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_ids(by_id))
    return _sums(docs, path, len(by_id) * FREQUENT, lambda total, ids, sizes: add_company(total, ids, sizes, sent.value)).reshape(-1, FREQUENT)


def _follows(docs: DataFrame, path: str, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each (row; the last: the text begins), in all ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    return _sums(docs, path, (CLASSES + 1) * CLASSES, lambda total, ids, sizes: add_follows(total, sent.value[ids], sizes)).reshape(-1, CLASSES)


def before_in_word(path: str, ids: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class before each id of whole words in its word; CLASSES where a word begins."""
    out = np.empty(len(ids), dtype=np.int64)
    out[1:] = classes[ids[:-1]]
    out[begins_word(path)[ids]] = CLASSES
    return out


def log_shares(by_id: np.ndarray, after: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log P(id | its class, class before it in the word)."""
    own = (by_id + 0.5) / np.bincount(classes, by_id + 0.5, CLASSES)[classes]
    out = np.empty(after.shape, dtype=np.float32)
    for k, row in enumerate(after):
        out[k] = np.log((row + TRUST * own) / (np.bincount(classes, row, CLASSES)[classes] + TRUST))
    return out


def _round(docs: DataFrame, n: int, rounds: int, share: int) -> DataFrame:
    """The documents of a round, by the hash ``mix``: over all rounds, one in ``share`` of them, each once."""
    return docs.filter((F.pmod("mix", F.lit(share)) == 0) & (F.pmod(F.floor(F.col("mix") / share), F.lit(rounds)) == n))


def _learn(batches: Iterator[pa.RecordBatch], path: str, classes: np.ndarray, trainer: Trainer, seed: int, room: int = 65_536) -> None:
    """Trains on all windows of the texts, shuffled about ``room`` at a time, so a mini-batch mixes documents."""
    rng = np.random.default_rng(seed)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def over():
        seen, target = (np.concatenate(x) for x in zip(*held, strict=True))
        order = rng.permutation(len(seen))
        held.clear()
        trainer.over(seen[order], target[order])

    for ids, sizes in _coded(batches, path, 200_000):
        seen, target, _ = windows(classes[ids], sizes)
        held.append((seen.astype(np.int16), target.astype(np.int16)))
        waiting += len(seen)
        if waiting > room:
            over()
            waiting = 0
    if held:
        over()


def _train(docs: DataFrame, path: str, classes: np.ndarray, flat: np.ndarray, rounds: int, share: int) -> np.ndarray:
    """One pass over all windows of one in ``share`` of the documents. Tasks code and cut texts as they go; a round's weights are averaged."""
    sc = docs.sparkSession.sparkContext
    for n in range(rounds):
        sent = sc.broadcast((flat, classes))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=0.02 / (1 + n), n=n) -> Iterator[pa.RecordBatch]:
            weights, table = sent.value
            t = Trainer(weights, rate)
            _learn(batches, path, table, t, n)
            if t.seen:
                own = t.flat.astype(np.float64) * t.seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(own), pa.array(np.full(len(own), t.seen))], ["i", "w", "n"])

        got = _own(_round(docs, n, rounds, share)).mapInArrow(run, "i long, w double, n long").groupBy("i").agg(
            (F.sum("w") / F.sum("n")).alias("w")).collect()  # one row per weight
        new = flat.copy()
        for r in got:
            new[r["i"]] = r["w"]
        flat = new
    return flat


def score_documents(docs: DataFrame, ranks: str, train: Column, doc_id: str = "doc_id", text: str = "text", share: int = 1,
                    rounds: int = 3, bucket_rows: int = 4096, seed: int = 9) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of the text's probability).

    ``train`` marks the rows to learn from (null: not). A null text is empty: one token, its end. Repeated rows are scored each.
    Without training rows the base knows no word and the model is uniform over its classes.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = settle(_code(docs.select(
        F.col(doc_id).alias("_id"), F.coalesce(train, F.lit(False)).alias("train"),
        F.pmod(F.xxhash64(F.col(doc_id), blank_text(text), F.lit(seed)), F.lit(1 << 40)).alias("mix"), blank_text(text).cast("binary").alias("_text")), ranks, bucket_rows), "lm-documents")
    words = rows.filter("words is not null").select("bucket", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select(
        "bucket", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    same = Window.partitionBy("word")
    known = settle(words.select("bucket", "place", "n", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("bucket")) == 1).alias("first")), "lm-counts")
    total, distinct = known.filter("c > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if("first")).first()
    learned = rows.filter("train")
    by_id = _id_counts(learned, ranks)
    classes = make_classes(_company(learned, ranks, by_id), by_id)
    mass = np.bincount(classes, by_id + 0.5, CLASSES)
    within = log_shares(by_id, _after(learned, ranks, classes), classes)
    flat = _train(learned, ranks, classes, start_weights(mass / mass.sum(), _follows(learned, ranks, classes)), rounds, share)
    model = spark.sparkContext.broadcast((flat, classes, within))
    log_all = float(np.log10(total + distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, classes, within = model.value
        for b in batches:
            for row, x, sizes in _parts(b.column(4), _id_kind(ranks), 400_000):
                ids = x.astype(np.int32)
                logs = class_log_probs(flat, classes[ids], sizes)
                logs += within[before_in_word(ranks, ids, classes), ids]
                own = np.add.reduceat(logs, np.cumsum(sizes) - sizes) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(row, len(sizes)) for k in range(4)), pa.array(own)], ["bucket", "_id", "train", "places", "score"])

    def base(key, texts, known):
        c = np.empty(known.num_rows, dtype=np.int64)
        c[known.column("place").to_numpy()] = known.column("c").to_numpy()
        each = np.log10(c + 1.0) - log_all
        made = []
        for chunk in texts.column("places").chunks:
            for _, x, sizes in _parts(chunk, np.int32, 1_000_000):
                x = _numbers(x, sizes)
                at = np.cumsum(sizes) - sizes
                made.append((sizes, np.add.reduceat((c[x] > 0).astype(np.int64), at), np.add.reduceat(each[x], at)))
        n, n_known, base_score = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({doc_id: texts.column("_id"), "held_out": pc.invert(texts.column("train")), "n_tokens": pa.array(n), "n_known": pa.array(n_known),
                         "train_tokens": pa.array(np.full(len(n), total, dtype=np.int64)), "base_score": pa.array(base_score), "score": texts.column("score")})

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = rows.select("bucket", "_id", "train", "places", "ids").mapInArrow(score, f"bucket long, _id {kind}, train boolean, places binary, score double")
    return scored.groupBy("bucket").cogroup(known.select("bucket", "place", "c").groupBy("bucket")).applyInArrow(
        base, f"`{doc_id}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
