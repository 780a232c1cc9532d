"""Quality rules by line sequence labelling.

A linear-chain conditional random field with two states labels every line of a
document as content or boilerplate; Viterbi decoding finds the best sequence,
and the share of content, in bytes, decides whether the document stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship, slices, training_rows

#: So many labelled documents, chosen by hash of the id, train the model.
TRAIN_DOCS = 4000
#: To learn from, documents are cut into pieces of so many lines; to decode, they are worked on in parts of at least so many.
TRAIN_LINES = 64
PART_LINES = 256
#: A document with less content than this share of its bytes is rejected.
MIN_SHARE = 0.5
SEED = 6
#: Characters whose features are computed together: some arrays take eight bytes for each.
FEATURE_CHARS = 1 << 20

# -- features: a few quantities of each line, each cut into bins

_CLASSES = 6  # upper, lower, digit, space, symbol, bar
_KIND = np.full(256, 1, np.int64)
for _i in range(128):
    _c = chr(_i)
    _KIND[_i] = 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 3 if _c.isspace() else 5 if _c == "|" else -1 if _c in ".,;:'\"-?()@+/_" else 4
#: Three counters of 21 bits in a word, twice.
_COUNT = np.zeros((2, 256), np.uint64)
for _i in range(256):
    if _KIND[_i] >= 0:
        _COUNT[_KIND[_i] // 3, _i] = 1 << (21 * (_KIND[_i] % 3))
_PIECE = 1 << 20
_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

CUTS = {
    "upper": (0.06, 0.12, 0.25, 0.5, 0.8),
    "symbol": (0.004, 0.015, 0.04, 0.1, 0.25),
    "bar": (0.002, 0.02, 0.08),
    "digit": (0.01, 0.05, 0.2),
    "repeat": (0.04, 0.1, 0.25, 0.5, 0.8),
    "length": (16, 48, 128, 512, 2048),
    "word": (2.5, 4, 5.5, 7, 9, 14),
    "stop": (0.5,),
    "edge": (0.5, 1.5),
}
OFFSETS = np.cumsum([0, *(len(c) + 1 for c in CUTS.values())])
FEATURES = int(OFFSETS[-1])


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the lines that aren't blank: their document, their bytes, and a bin for each quantity."""
    lines, doc = [], []
    for i, text in enumerate(texts):
        own = [b for x in text.split("\n") if (b := x.strip()) and (b := b.encode("utf-8", "surrogatepass"))]
        lines += own
        doc += [i] * len(own)
    owner = np.array(doc, np.int64)
    if not lines:
        return owner, owner, np.zeros((0, len(CUTS)), np.int64)
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(size + 1) - size - 1
    # counts of the classes; a line of over a million bytes is counted in pieces
    pieces = -(-size // _PIECE)
    piece_of = np.repeat(np.arange(len(lines)), pieces)
    at = start[piece_of] + (np.arange(len(piece_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _PIECE
    count = np.zeros((_CLASSES, len(lines)), np.int64)
    for half in range(2):
        sums = np.add.reduceat(_COUNT[half][data], at)
        for k in range(3):
            np.add.at(count[half * 3 + k], piece_of, ((sums >> np.uint64(21 * k)) & np.uint64((1 << 21) - 1)).astype(np.int64))
    upper, lower, digit, space, symbol, bar = count
    space = space - 1  # the line's own end, which its last piece holds
    # words that equal the one before them
    blank = _KIND[data] == 3
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    place = np.arange(len(data)) - np.repeat(first, np.diff(first, append=len(data)))
    mixed = _BYTE[data] * _PLACE[place & 63] * (~blank)
    key = np.add.reduceat(mixed, first) + (end - first).astype(np.uint64)
    line_of = np.searchsorted(start, first, side="right") - 1
    same = np.zeros(len(first), bool)
    same[1:] = (key[1:] == key[:-1]) & (line_of[1:] == line_of[:-1])
    words = np.bincount(line_of, minlength=len(lines))
    repeat = np.bincount(line_of, weights=same, minlength=len(lines)) / np.maximum(1, words)
    solid = np.maximum(1, size - space)
    edge = np.zeros(len(lines), np.int64)
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    edge[new] = 1
    edge[np.append(new[1:], len(lines)) - 1] = 2
    last = data[start + size - 1]
    values = {
        "upper": upper / np.maximum(1, upper + lower), "symbol": symbol / solid, "bar": bar / solid, "digit": digit / solid, "repeat": repeat,
        "length": size, "word": solid / np.maximum(1, words), "stop": np.isin(last, np.frombuffer(b".?!\"')", np.uint8)), "edge": edge,
    }
    bins = np.stack([np.searchsorted(c, values[k], side="right") for k, c in CUTS.items()], 1)
    return owner, size, bins


# -- the field: weights of each bin and of each pair of neighbouring states


class Field:
    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.emit[bins + OFFSETS[:-1]].sum(1)

    def decode(self, scores: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Viterbi: the best states of sequences that lie one after another; 1 is content.

        Sequences are cut into parts.  All parts go from line to line together,
        once for each state that the line before them may have; the parts of a
        sequence are then joined in order, and read back together.  Of equally
        good states the lower is taken.
        """
        longest = int(size.max(initial=0))
        state = np.zeros(len(scores), np.int8)
        if not longest:
            return state
        step = max(PART_LINES, int(np.ceil(np.sqrt(longest))))
        parts = -(-size // step)
        first = np.cumsum(parts) - parts  # of each sequence
        seq = np.repeat(np.arange(len(size)), parts)
        rank = np.arange(len(seq)) - first[seq]
        at = start[seq] + rank * step
        length = np.minimum(step, start[seq] + size[seq] - at)
        order = np.argsort(-length, kind="stable")
        back = np.zeros((len(scores), 2, 2), np.int8)  # by the state before the part and that of the line
        best = np.empty((len(seq), 2, 2))
        best[:] = scores[at][:, None, :] + np.where(rank[:, None, None] > 0, self.move, 0.0)
        for t in range(1, int(length.max())):
            own = order[: np.searchsorted(-length[order], -t)]
            via = best[own][:, :, :, None] + self.move
            back[at[own] + t] = via.argmax(2)
            best[own] = via.max(2) + scores[at[own] + t][:, None, :]
        chain = best[first, 0]  # the best so far of each sequence, by its last state
        entry = np.zeros((len(seq), 2), np.int8)  # the best state before a part, by the state at its end
        for r in range(1, int(parts.max())):
            own = np.flatnonzero(parts > r)
            via = chain[own][:, :, None] + best[first[own] + r]
            entry[first[own] + r] = via.argmax(1)
            chain[own] = via.max(1)
        end, before = np.zeros(len(seq), np.int8), np.zeros(len(seq), np.int8)
        end[first + parts - 1] = chain.argmax(1)
        for r in range(int(parts.max()) - 1, 0, -1):
            own = first[parts > r] + r
            before[own] = entry[own, end[own]]
            end[own - 1] = before[own]
        state[at + length - 1] = end
        for t in range(int(length.max()) - 1, 0, -1):
            own = order[: np.searchsorted(-length[order], -t)]
            row = at[own] + t
            state[row - 1] = back[row, before[own], state[row]]
        return state

    def fit(self, bins: np.ndarray, start: np.ndarray, size: np.ndarray, gold: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 2e-5) -> "Field":
        """Maximum conditional likelihood by Adam; weight is of each sequence."""
        task = Likelihood(bins, start, size, gold, weight)
        theta = np.concatenate([self.emit.ravel(), self.move.ravel()])
        m = v = np.zeros_like(theta)
        for step in range(1, rounds + 1):
            grad = task(theta)[1] - decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.emit, self.move = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        return self


class Likelihood:
    """The weighted mean log likelihood of the gold states and its gradient, by forward and backward passes."""

    def __init__(self, bins: np.ndarray, start: np.ndarray, size: np.ndarray, gold: np.ndarray, weight: np.ndarray):
        order = np.argsort(-size, kind="stable")
        start, size, weight = start[order], size[order], weight[order]
        self.at = [start[: np.searchsorted(-size, -t)] + t for t in range(int(size[0]))]
        of = np.empty(len(bins), np.int64)
        for rows in self.at:
            of[rows] = np.arange(len(rows))
        self.w, self.gold = weight[of] / weight.sum(), gold
        self.inner = np.concatenate([np.zeros(0, np.int64), *self.at[1:]])
        # lines alike in all bins are scored once
        kinds, self.kind = np.unique(bins, axis=0, return_inverse=True)
        self.kind = self.kind.ravel()
        self.place = kinds + OFFSETS[:-1]

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        emit, move = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        s = emit[self.place].sum(1)[self.kind]
        forward, backward = s.copy(), np.zeros_like(s)
        for rows in self.at[1:]:
            forward[rows] += _log_sum(forward[rows - 1][:, :, None] + move)
        for rows in reversed(self.at[1:]):
            backward[rows - 1] = _log_sum(move.T + (s[rows] + backward[rows])[:, :, None])
        total = _log_sum((forward + backward)[:, :, None])[:, 0]
        p = np.exp(forward + backward - total[:, None])
        line = np.arange(len(s))
        d = -p
        d[line, self.gold] += 1
        d *= self.w[:, None]
        kinds = np.stack([np.bincount(self.kind, weights=d[:, c], minlength=len(self.place)) for c in range(2)], 1)
        g = np.zeros_like(emit)
        for k in range(self.place.shape[1]):
            for c in range(2):
                g[:, c] += np.bincount(self.place[:, k], weights=kinds[:, c], minlength=len(g))
        inner = self.inner
        pair = np.exp(forward[inner - 1][:, :, None] + move + (s[inner] + backward[inner])[:, None, :] - total[inner][:, None, None])
        gm = -(pair * self.w[inner][:, None, None]).sum(0)
        np.add.at(gm, (self.gold[inner - 1], self.gold[inner]), self.w[inner])
        heads = self.at[0]
        value = (self.w * s[line, self.gold]).sum() + (self.w[inner] * move[self.gold[inner - 1], self.gold[inner]]).sum() - (self.w[heads] * total[heads]).sum()
        return float(value), np.concatenate([g.ravel(), gm.ravel()])


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log(exp(x[:, 0]) + exp(x[:, 1]))"""
    a, b = x[:, 0], x[:, 1]
    return np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))


def _sequences(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents that have lines, with the start and number of them."""
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[start], start, np.diff(start, append=len(owner))


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and bins of all lines, read a slice at a time."""
    owners, bins, base = [np.zeros(0, np.int64)], [np.zeros((0, len(CUTS)), np.int64)], 0
    for _, part in slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])], "text", FEATURE_CHARS):
        owner, _, b = line_features(part)
        owners.append(owner + base)
        bins.append(b)
        base += len(part)
    return np.concatenate(owners), np.concatenate(bins)


def train(texts: list[str], good: list[int]) -> Field:
    """Fit on documents labelled as a whole.

    Each line first inherits its document's label.  The field then reads the
    bad documents itself, and lines that it takes for content even there, as
    sentences quoted amid junk, no longer count as boilerplate in the second
    fit.  If not both labels have lines, nothing tells content from
    boilerplate, and every line counts as content.
    """
    owner, bins = _features(texts)
    label = np.asarray(good, np.int64)
    gold = label[owner] if len(owner) else owner
    if not len(owner) or gold.min() == gold.max():
        return Field(emit=np.tile([0.0, 1.0], (FEATURES, 1)))
    docs, start, size = _sequences(owner)
    weight = 1 / np.sqrt(size)  # long documents don't outweigh the rest
    # long sequences would take a step for each of their lines: they are learnt from in pieces
    pieces = -(-size // TRAIN_LINES)
    of = np.repeat(np.arange(len(size)), pieces)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    end = (start + size)[of]
    start = start[of] + rank * TRAIN_LINES
    size, weight = np.minimum(TRAIN_LINES, end - start), weight[of]
    field = Field().fit(bins, start, size, gold, weight)
    alone = field.scores(bins)
    gold = np.where((gold == 0) & (alone[:, 1] - alone[:, 0] > 2), 1, gold)
    return Field(field.emit, field.move).fit(bins, start, size, gold, weight, rounds=50)


def content(field: Field, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: lines, lines of content, and the share of its bytes in them (0 for a text without lines)."""
    owner, size, bins = line_features(texts)
    n = len(texts)
    state = np.zeros(0, np.int8)
    if len(owner):
        _, start, lines = _sequences(owner)
        state = field.decode(field.scores(bins), start, lines)
    total = np.bincount(owner, weights=size, minlength=n)
    share = np.bincount(owner, weights=size * state, minlength=n) / np.maximum(1, total)
    return np.bincount(owner, minlength=n), np.bincount(owner, weights=state, minlength=n).astype(np.int64), share


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """A field fitted on train_docs labelled documents (all, if there are fewer), as far as training_rows takes them.

    A document with several labels is good if one of them says so.  If the
    labels of documents with text are not of both kinds, or there are none,
    nothing is known of boilerplate and the field calls every line content.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("long").alias("_good"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(train_docs)
    rows = training_rows(docs, chosen, "_good", SEED)
    return train([text for text, _ in rows], [int(good) for _, good in rows])


SCORED = "doc_id long, n_lines long, content_lines long, content_share double, keep boolean"


def score(docs: DataFrame, field: Field, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, n_lines, content_lines, content_share, keep) for every row of docs.

    A null, empty or blank text has no lines, share 0 and isn't kept.  Null ids
    stay null; repeated rows are judged alike.
    """
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", FEATURE_CHARS):
            lines, own, share = content(field, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines), pa.array(own), pa.array(share), pa.array((lines > 0) & (share >= min_share))], ["doc_id", "n_lines", "content_lines", "content_share", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCORED)


def keeps(field: Field, min_share: float = MIN_SHARE):
    """The decision as a function of the text column."""

    @F.pandas_udf("boolean")
    def keep(text):
        import pandas as pd

        out = []
        for _, texts in slices([pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True)], ["text"])], "text", FEATURE_CHARS):
            lines, _, share = content(field, texts)
            out.append((lines > 0) & (share >= min_share))
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return keep


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with all their columns as they are.

    Null, empty and blank texts go.  Rows are judged by their text alone, so
    repeated rows stay or go together, and so do rows without an id.  A share
    of exactly MIN_SHARE stays.  Without labels of both kinds (see fitted)
    every document with text is kept.
    """
    ship(spark)
    field = fitted(docs, read(spark, sf_dir, "labels"))
    return docs.where(keeps(field)(F.col("text").cast("string")))
