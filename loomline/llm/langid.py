"""Language identification by Bayesian fusion of evidence.

A page's languages are weighed by what its text says (naive Bayes over the
character n-grams of its words), by the language that its markup declares, by
the suffix of its address, and by a prior of its host.  How far a declaration or
suffix can be trusted is counted over all pages, weighted by what their texts
say.  So are the host priors, which are smoothed from level to level: of all
pages, of the domain, of the host.
"""

from __future__ import annotations

import importlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked, cut, ngrams, ship, slices, training_rows

#: At most so many documents of each language, chosen by hash of the id, train the text model.
TRAIN_DOCS = 1500
BUCKETS = 1 << 15
#: Neighbouring n-grams say much the same, so log likelihoods are weakened by a factor.  It is the one of these that fits best
#: to held-out pieces of so many words, each documents' next in turn.
HEATS = tuple(2.0 ** (-k / 4) for k in range(25))
PIECES = (1, 2, 4, 8)
#: Pages that a level's parent counts for.
SMOOTHING = 5.0
#: Pages of a declaration or suffix that are imagined beforehand.
ALPHA = 1.0
REMEMBERED = 400_000
SEED = 5

_DROPPED = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)|&#?\w{1,32};", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})", re.I)
_MARKS = ".,;:!?\"'()[]{}<>|*#$%&…«»“”„-_/\\@+=~^`0123456789"


def grams(pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to 4, the buckets of the words' n-grams between marks for their ends, and which word each is of, in order.

    Marks of punctuation at a word's ends are left out; a word without letters
    has no n-grams.
    """
    return ngrams([p.strip(_MARKS) for p in pieces], (1, 2, 3, 4), BUCKETS)


class TextModel:
    """Log probabilities of the n-grams in each language, and the factor that weakens their sums."""

    def __init__(self, langs: list[str], logs: np.ndarray, heat: float = 1.0):
        self.langs, self.logs, self.heat = langs, logs, heat

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> "TextModel":
        """All texts make the probabilities; the factor is of those that four fifths of the texts give for the rest."""
        names = sorted(set(langs))
        held = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 5 == 0 for t in texts]
        parts = [cls._counts([(t, lang) for t, lang, h in zip(texts, langs, held) if h == part], names) for part in (False, True)]
        model = cls(names, cls._logs(parts[0]))
        model.heat = model._fitting_heat([(t, names.index(lang)) for t, lang, h in zip(texts, langs, held) if h])
        return cls(names, cls._logs(parts[0] + parts[1]), model.heat)

    @staticmethod
    def _counts(rows: list[tuple[str, str]], names: list[str]) -> np.ndarray:
        counts = np.zeros((BUCKETS, len(names)))
        for k, name in enumerate(names):
            pieces: Counter[str] = Counter()
            for t, lang in rows:
                if lang == name:
                    pieces.update(t.lower().split())
            # n-grams of each distinct word once, a slice of words at a time
            items = iter(pieces.items())
            while part := list(islice(items, 1 << 15)):
                often = np.array([n for _, n in part], np.float64)
                for bucket, word in grams([p for p, _ in part]):
                    counts[:, k] += np.bincount(bucket, weights=often[word], minlength=BUCKETS)
        return counts

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.1) / (counts + 0.1).sum(0)) if counts.shape[1] else counts

    def _fitting_heat(self, rows: list[tuple[str, int]]) -> float:
        """The factor under which the languages of pieces of these texts are likeliest; 1 if there is nothing to tell by."""
        if len(self.langs) < 2:
            return 1.0
        own, split, gold = Reader(self), [], []
        for t, k in rows:
            words, at = t.lower().split(), 0
            while at < len(words):
                n = PIECES[len(split) % len(PIECES)]
                split.append(words[at : at + n])
                gold.append(k)
                at += n
        own.learn(split)
        sums = [own.read(pieces) for pieces in split]
        x, g = np.array([x for x, n in sums if n]).reshape(-1, len(self.langs)), np.array([k for (_, n), k in zip(sums, gold) if n], np.int64)
        if not len(x):
            return 1.0
        fits = [(h * x[np.arange(len(g)), g] - np.log(np.exp(h * x).sum(1))).mean() for h in HEATS]
        return HEATS[int(np.argmax(fits))]

    def key(self) -> int:
        return zlib.crc32(self.logs.tobytes()) ^ hash(self.heat)


class Reader:
    """A worker's text model, with the words that it has met."""

    def __init__(self, model: TextModel):
        self.model = model
        self.table = np.zeros((0, len(model.langs) + 1))
        self.words: dict[str, int] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Know all words of these texts: those that are new are worked out together."""
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        new = list(set(chain.from_iterable(texts)).difference(self.words))
        if not new:
            return
        n, base = len(self.model.langs), len(self.words)
        if base + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:base], np.zeros((len(new) + base, n + 1))])
        for at in range(0, len(new), 1 << 14):
            part = new[at : at + (1 << 14)]
            rows = self.table[base + at : base + at + len(part)]
            rows[:] = 0
            for bucket, word in grams(part):
                start = np.flatnonzero(np.diff(word, prepend=-1))
                if len(start):
                    rows[word[start], :n] += np.add.reduceat(self.model.logs[bucket], start, axis=0)
                    rows[word[start], n] += np.diff(start, append=len(word))
        self.words.update(zip(new, range(base, base + len(new))))

    def read(self, pieces: list[str]) -> tuple[np.ndarray, int]:
        """Log likelihoods of the languages, weakened by the model's factor, the best being 0; and the number of n-grams.

        The words must be learnt.
        """
        rows = np.fromiter(map(self.words.__getitem__, pieces), np.int64, len(pieces))
        sums = self.table[rows].sum(0)
        x = sums[:-1] * self.model.heat
        return x - x.max(initial=-np.inf) if len(x) else x, int(sums[-1])


_readers: dict[int, Reader] = {}


def reader(model: TextModel) -> Reader:
    own = importlib.import_module(__name__)._readers
    key = model.key()
    if key not in own:
        own.clear()
        own[key] = Reader(model)
    return own[key]


def fitted(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> TextModel:
    """A text model of the languages named in docs, from at most train_docs documents of each, as far as training_rows takes them.

    Documents whose hash lies below a share that is expected to give twice as
    many are the only ones that are sorted.
    """
    given = docs.where("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    counts = cut(given.groupBy("lang").count())
    place = F.xxhash64("doc_id", F.lit(SEED))
    share = checked(counts.select("lang", (F.lit(2.0 * train_docs) / F.col("count")).alias("_share")), 64)
    few = given.join(share, "lang").where(F.shiftrightunsigned(place, 11).cast("double") / float(1 << 53) < F.col("_share")).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    chosen = cut(few.withColumn("_n", rank).where(F.col("_n") <= train_docs).select("doc_id", "lang"))
    rows = training_rows(docs, chosen, "lang", SEED, given="lang")
    return TextModel.fit([text for text, _ in rows], [lang for _, lang in rows])


def visible(html: str) -> str:
    return _DROPPED.sub(" ", html)


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix (the last one); None for what there isn't."""
    try:
        host = (urlsplit(url or "").hostname or "").strip(".")
    except ValueError:
        host = ""
    if not host:
        return None, None, None
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else None


EVIDENCE_COLUMNS = "id long, declared string, suffix string, domain string, host string, n_grams long, likely array<double>"


def _evidence(model: TextModel, markup: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(model)
        for batch, texts in slices(batches, "body", 1 << 20):
            places = batch.column("place").to_pylist()
            split = [(visible(t) if markup else t).lower().split() for t in texts]
            own.learn(split)
            rows: list[list] = [[], [], [], [], [], []]
            for body, pieces, place in zip(texts, split, places):
                declared = None
                if markup:
                    m = _DECLARED.search(body)
                    declared = m.group(1).lower() if m else None
                    host, domain, suffix = address(place)
                else:
                    host, domain, suffix = place, None, None
                likely, n = own.read(pieces)
                for column, x in zip(rows, (declared, suffix, domain, host, n, likely.tolist())):
                    column.append(x)
            text, number = pa.string(), pa.int64()
            kinds = [text, text, text, text, number, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, t) for x, t in zip(rows, kinds))], ["id", "declared", "suffix", "domain", "host", "n_grams", "likely"])

    return work


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """What each page (page_id, url, html) shows by itself."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("place"), F.col("html").cast("string").alias("body"))
    return rows.mapInArrow(_evidence(model, True), EVIDENCE_COLUMNS)


def document_evidence(docs: DataFrame, model: TextModel) -> DataFrame:
    """The same for documents (doc_id, text, source), which declare nothing; their source is taken for their host."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("place"), F.col("text").cast("string").alias("body"))
    return rows.mapInArrow(_evidence(model, False), EVIDENCE_COLUMNS)


def _soft(langs: list[str]) -> list[Column]:
    """The posterior by text alone, over a flat prior: a column for each language."""
    e = [F.exp(F.col("likely")[i]) for i in range(len(langs))]
    return [x / sum(e, F.lit(0.0)) for x in e]


def fuse(shown: DataFrame, langs: list[str]) -> DataFrame:
    """shown with lang and confidence, the language of the highest posterior (the first in the alphabet of equals)."""
    k = range(len(langs))
    soft = cut(shown).withColumns({f"_s{i}": x for i, x in enumerate(_soft(langs))})

    def grouped(key: str, prefix: str) -> DataFrame:
        own = soft.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}"))
        return own.agg(*[F.sum(f"_s{i}").alias(f"{prefix}{i}") for i in k])

    totals = soft.agg(*[F.coalesce(F.sum(f"_s{i}"), F.lit(0.0)).alias(f"_g{i}") for i in k])
    out = soft.crossJoin(F.broadcast(totals))  # one row
    shares = [(F.col(f"_g{i}") + ALPHA) / (sum((F.col(f"_g{j}") for j in k), F.lit(0.0)) + ALPHA * len(langs)) for i in k]
    for key, prefix in (("declared", "_d"), ("suffix", "_x"), ("domain", "_o"), ("host", "_h")):
        table = checked(cut(grouped(key, prefix)), 64 + 8 * len(langs))
        out = out.join(table, F.col(key) == F.col(f"_{key}"), "left")
    score = []
    n = lambda p: sum((F.coalesce(F.col(f"{p}{j}"), F.lit(0.0)) for j in k), F.lit(0.0))
    none = F.lit(0.0)
    for i in k:
        # counts of a level leave the page itself out, which speaks for itself
        less = lambda p, i=i: F.greatest(none, F.coalesce(F.col(f"{p}{i}") - F.col(f"_s{i}"), none))
        domain = F.when(F.col("domain").isNull(), shares[i]).otherwise((less("_o") + SMOOTHING * shares[i]) / (F.greatest(none, n("_o") - 1) + SMOOTHING))
        host = F.when(F.col("host").isNull(), domain).otherwise((less("_h") + SMOOTHING * domain) / (F.greatest(none, n("_h") - 1) + SMOOTHING))
        # P(shown | language), up to what is the same for every language
        said = [F.when(F.col(key).isNull(), none).otherwise(F.log((less(p) + ALPHA) / (F.col(f"_g{i}") + ALPHA * len(langs)))) for key, p in (("declared", "_d"), ("suffix", "_x"))]
        score.append(F.log(host) + F.col("likely")[i] + said[0] + said[1])
    out = out.withColumns({f"_p{i}": x for i, x in enumerate(score)})
    best = F.greatest(*[F.col(f"_p{i}") for i in k]) if len(langs) > 1 else F.col("_p0")
    lang = F.coalesce(*[F.when(F.col(f"_p{i}") == best, F.lit(x)) for i, x in enumerate(langs)])
    confidence = 1 / sum((F.exp(F.col(f"_p{i}") - best) for i in k), F.lit(0.0))
    return out.select(*shown.columns, lang.alias("lang"), confidence.alias("confidence"))


def identify(pages: DataFrame, docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """(doc_id, page_id, lang, confidence) of every page and every document; one of the ids is null.

    Pages without text are judged by the other evidence, and rows without any by
    the prior of all.  A null html, text, url or source is missing evidence.
    Repeated rows are judged alike.  The languages are those named in docs; with
    none named, lang is null.
    """
    model = model or fitted(docs)
    none = F.lit(None).cast("long")
    if not model.langs:
        rows = pages.select(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id")).unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id")))
        return rows.select("*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    of_pages = fuse(evidence(pages, model), model.langs).select(none.alias("doc_id"), F.col("id").alias("page_id"), "lang", "confidence")
    of_docs = fuse(document_evidence(docs, model), model.langs).select(F.col("id").alias("doc_id"), none.alias("page_id"), "lang", "confidence")
    return of_docs.unionByName(of_pages)
