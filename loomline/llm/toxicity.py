"""Toxicity by bags of subwords.

A word's vector is the mean of those of its character n-grams and itself, a
window's the mean of its words', and a linear softmax reads the window.  Vectors
and softmax are trained jointly.  An unseen misspelling shares most n-grams, and
so most of its vector, with the word that it comes from.  Labels are of whole
documents.  At first those windows of toxic documents are called toxic that hold
a word with far more toxic contexts than chance allows; later also those that
the model itself sets above all clean documents.
"""

from __future__ import annotations

import importlib
import zlib
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ngrams, ship, slices, training_rows

#: At most so many labelled documents of each class, chosen by hash of the id, train the model.
TRAIN_DOCS = 2500
BUCKETS = 1 << 16
DIM = 12
GRAMS = (3, 4, 5)
WINDOW = 16
REMEMBERED = 600_000
#: Each fit makes at least so many updates.
UPDATES = 150
SEED = 2
_PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&…«»“”„-_/\\"


def subwords(pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets, each with its word: of the words themselves, and then of their n-grams between marks for their ends."""
    bare = [p.strip(_PUNCTUATION) for p in pieces]
    own = [zlib.crc32(w.encode("utf-8", "surrogatepass"), 1) for w in bare]
    yield np.array(own, np.int64) & (BUCKETS - 1), np.arange(len(bare))
    yield from ngrams(bare, GRAMS, BUCKETS)


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of windows over n words that follow each other; the last one ends with the text."""
    start = np.arange(0, max(1, n - WINDOW + 1), WINDOW)
    if n > WINDOW and start[-1] != n - WINDOW:
        start = np.append(start, n - WINDOW)
    return start, np.minimum(start + WINDOW, n)


class Model:
    """slope: what each bucket adds to the score, already multiplied with the softmax; bias; and the score from which a text is toxic."""

    def __init__(self, slope: np.ndarray, bias: float, limit: float = 0.0):
        self.slope, self.bias, self.limit = slope.astype(np.float64), float(bias), float(limit)

    def key(self) -> int:
        return zlib.crc32(self.slope.tobytes()) ^ hash((self.bias, self.limit))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, float] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Know all words of these texts: those that are new are worked out together."""
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        new = list(set(chain.from_iterable(texts)).difference(self.words))
        for at in range(0, len(new), 1 << 14):
            part = new[at : at + (1 << 14)]
            sums, n = np.zeros(len(part)), np.zeros(len(part))
            for bucket, word in subwords(part):
                sums += np.bincount(word, weights=self.model.slope[bucket], minlength=len(part))
                n += np.bincount(word, minlength=len(part))
            self.words.update(zip(part, (sums / n).tolist()))

    def score(self, pieces: list[str]) -> float:
        """The highest score of all windows of WINDOW neighbours of these words, which must be learnt; minus infinity without words."""
        if not pieces:
            return -np.inf
        s = np.fromiter(map(self.words.__getitem__, pieces), np.float64, len(pieces))
        s = s[np.append(True, s[1:] != s[:-1])]  # a word said over and over, marks at its ends aside, counts once
        if len(s) <= WINDOW:
            return float(s.mean()) + self.model.bias
        sums = np.concatenate([[0.0], np.cumsum(s)])
        return float((sums[WINDOW:] - sums[:-WINDOW]).max()) / WINDOW + self.model.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() for t in texts]
        self.learn(split)
        return np.fromiter(map(self.score, split), np.float64, len(split))


_scorers: dict[int, Scorer] = {}


def scorer(model: Model) -> Scorer:
    own = importlib.import_module(__name__)._scorers
    key = model.key()
    if key not in own:
        own.clear()
        own[key] = Scorer(model)
    return own[key]


class _Bags:
    """Windows of documents as ragged lists of distinct words, and words as ragged lists of buckets."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        words, starts, ends, docs = [], [], [], []
        base = 0
        for i, t in enumerate(texts):
            own = [number.setdefault(p, len(number)) for p, _ in groupby(t.lower().split())]
            if own:
                s, e = windows(len(own))
                starts.append(s + base)
                ends.append(e + base)
                docs.append(np.full(len(s), i))
                words += own
                base += len(own)
        none = np.zeros(0, np.int64)
        self.words = np.array(words, np.int64)
        self.start, self.end, self.doc = (np.concatenate([none, *x]) for x in (starts, ends, docs))
        found = [(g, w + at) for at in range(0, len(number), 1 << 14) for g, w in subwords(list(islice(number, at, at + (1 << 14))))]
        grams, word = (np.concatenate([none, *x]) for x in zip(*found)) if found else (none, none)
        self.grams = grams[np.argsort(word, kind="stable")]
        self.count = np.bincount(word, minlength=len(number))
        self.first = np.cumsum(self.count) - self.count

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these windows the buckets, the row that each belongs to, and its weight in the mean."""
        word, row = _ragged(self.start[rows], self.end[rows] - self.start[rows])
        word = self.words[word]
        gram, at = _ragged(self.first[word], self.count[word])
        size = (self.end - self.start)[rows]
        return self.grams[gram], row[at], 1.0 / (self.count[word][at] * size[row[at]])

    def holding(self, label: np.ndarray, least: float = 5.0) -> np.ndarray:
        """Windows that hold a word of toxic documents: one whose contexts (the words around it, each context
        counted once, so copies add nothing) are mostly toxic, so that chance is so many deviations off.
        """
        doc = np.repeat(self.doc, self.end - self.start)
        word = np.concatenate([self.words[a:b] for a, b in zip(self.start, self.end)]) if len(self.start) else self.words
        before, after = np.roll(word, 1), np.roll(word, -1)
        rows = np.unique(np.stack([word, before, after, label[doc]], 1), axis=0)
        n = np.bincount(rows[:, 0], minlength=len(self.count))
        a = np.bincount(rows[:, 0], weights=rows[:, 3], minlength=len(self.count))
        p = rows[:, 3].mean()
        z = (a - n * p) / np.sqrt(np.maximum(n, 1) * p * (1 - p) + 1e-12)
        return np.maximum.reduceat(((z >= least) & (a >= 0.75 * n)).astype(np.int8)[word], np.cumsum(self.end - self.start) - (self.end - self.start)) > 0

    def scores(self, slope: np.ndarray) -> np.ndarray:
        each = np.add.reduceat(slope[self.grams], self.first) / self.count
        return _window_means(each[self.words], self.start, self.end)


def _window_means(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return (sums[end] - sums[start]) / (end - start)


def _ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(start)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner], owner


def train(texts: list[str], toxic: list[int], prevalence: float = 0.1, rounds: int = 1, passes: int = 2, batch: int = 256) -> Model:
    """Train on documents labelled as a whole; a fifth of them only sets the limit, for the best F1 at this prevalence.

    Documents of one label alone, or of none, teach nothing: the limit is then infinite, so no text is toxic.
    """
    rng = np.random.default_rng(SEED)
    label = np.asarray(toxic, np.int64)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(BUCKETS), 0.0, np.inf)
    order = rng.permutation(len(label))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    bags = _Bags([texts[i] for i in used])
    own = label[used]
    vectors = soft = bias = sq_v = sq_s = sq_b = None

    def restart() -> None:
        nonlocal vectors, soft, bias, sq_v, sq_s, sq_b
        vectors, soft, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
        sq_v, sq_s, sq_b = np.full((BUCKETS, 1), 1e-6), np.full(soft.shape, 1e-6), np.full(2, 1e-6)

    def fit(rows: np.ndarray, gold: np.ndarray, passes: int) -> None:
        weight = np.where(gold == 1, 0.5 / max(1, (gold == 1).sum()), 0.5 / max(1, (gold == 0).sum())) * len(gold)
        passes = max(passes, -(-UPDATES * batch // len(rows)))  # few windows are gone through more often
        for _ in range(passes):
            shuffled = rng.permutation(len(rows))
            for at in range(0, len(shuffled), batch):
                pick = shuffled[at : at + batch]
                gram, row, w = bags.batch(rows[pick])
                touched, place = np.unique(gram, return_inverse=True)
                mix = np.zeros((len(pick), DIM))
                v = vectors[gram] * w[:, None]
                edges = np.flatnonzero(np.diff(row, prepend=-1))
                mix[row[edges]] = np.add.reduceat(v, edges, axis=0)
                z = mix @ soft + bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                d = (p - np.eye(2)[gold[pick]]) * (weight[pick] / len(pick))[:, None]
                back = d @ soft.T
                pulled = back[row] * w[:, None]
                g = np.stack([np.bincount(place, weights=pulled[:, k], minlength=len(touched)) for k in range(DIM)], 1)
                g_soft, g_bias = mix.T @ d, d.sum(0)
                sq_v[touched] += (g**2).mean(1, keepdims=True)
                vectors[touched] -= 0.3 * g / np.sqrt(sq_v[touched])
                for x, gx, sq in ((soft, g_soft, sq_s), (bias, g_bias, sq_b)):
                    sq += gx**2
                    x -= 0.1 * gx / np.sqrt(sq)

    of_toxic = own[bags.doc] == 1
    gold = (of_toxic & bags.holding(own)).astype(np.int64)
    for _ in range(rounds):
        restart()
        fit(np.arange(len(gold)), gold if gold.any() else of_toxic.astype(np.int64), passes)
        # the rest of a toxic document is clean; one with no window above the clean ones may be mislabelled
        s = bags.scores(vectors @ (soft[:, 1] - soft[:, 0]))
        clear = np.quantile(s[~of_toxic], 0.9995)
        gold |= of_toxic & (s > clear)
    restart()
    fit(np.arange(len(gold)), gold, passes)
    model = Model(vectors @ (soft[:, 1] - soft[:, 0]), bias[1] - bias[0])
    held = held if len(held) and 0 < label[held].sum() < len(held) else order
    score = Scorer(model)
    s = score.scores([texts[i] for i in held])
    model.limit = _limit(s, label[held], prevalence)
    return model


def _limit(s: np.ndarray, gold: np.ndarray, prevalence: float) -> float:
    """Halfway between the two neighbouring scores that part the classes with the best F1 at this prevalence."""
    order = np.argsort(-s, kind="stable")
    hit = np.cumsum(gold[order] == 1) / max(1, (gold == 1).sum()) * prevalence
    false = np.cumsum(gold[order] == 0) / max(1, (gold == 0).sum()) * (1 - prevalence)
    f1 = 2 * hit / (hit + false + prevalence)
    i = len(f1) - 1 - int(f1[::-1].argmax())
    low = s[order[i + 1]] if i + 1 < len(s) else s[order[i]] - 1
    return float((s[order[i]] + low) / 2) if np.isfinite(low) else float(s[order[i]]) - 1


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """A model fitted on at most train_docs documents of each class, as far as training_rows takes them; the prevalence is that of all labels.

    A document with several labels is toxic if one of them says so.
    """
    given = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("_toxic"))
    shares = {r["_toxic"]: r["count"] for r in given.groupBy("_toxic").count().collect()}  # two rows
    place = F.xxhash64("doc_id", F.lit(SEED))
    chosen = None
    for c in (0, 1):
        part = given.where(F.col("_toxic") == c).orderBy(place, "doc_id").limit(train_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = training_rows(docs, chosen, "_toxic", SEED)
    prevalence = shares.get(1, 0) / max(1, sum(shares.values()))
    return train([text for text, _ in rows], [int(toxic) for _, toxic in rows], min(0.5, max(0.01, prevalence)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity, toxic) of every row: the probability of its most toxic window, and whether it reaches the limit.

    Null, empty and blank texts have toxicity 0 and aren't toxic.  Null ids
    stay; repeated rows are scored alike.  A score of just the limit is toxic;
    with labels of one class alone (see train) nothing is.
    """
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(model)
        for batch, texts in slices(batches, "text", 1 << 20):
            x = s.scores(texts)
            p = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
            some = np.isfinite(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(some, p, 0.0)), pa.array(some & (x >= model.limit))], ["doc_id", "toxicity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, toxicity double, toxic boolean")
