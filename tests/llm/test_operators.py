"""Operators that SQL can't express, against brute force, round trips or held-out accuracy."""

import collections
import time

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomline.llm import chat, langid, linededup, mixing, packing, quality, simhash, token_counts, topk, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return documents.orderBy("doc_id").toPandas()


# -- token counts


def test_token_counts_equal_the_tokenizer(documents, texts):
    whole = tiktoken.Encoding("x", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.ranks(), special_tokens={})
    expected = {i: len(whole.encode_ordinary(t)) for i, t in zip(texts.doc_id, texts.text)}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents).collect()} == expected


def test_shortcut_is_proven_by_merging():
    rank = token_counts.ranks()
    proven = token_counts.proven()
    assert len(proven) > 40_000
    for s in list(proven)[::997]:
        assert token_counts.merge(s.encode(), rank) == [s.encode()]


def test_pieces_agree_with_the_pattern():
    import random

    rng, c = random.Random(5), token_counts.Counter(token_counts.ranks(), token_counts.proven())
    whole = tiktoken.Encoding("x", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.ranks(), special_tokens={})
    for _ in range(5000):
        t = "".join(rng.choice(" \n\t'sdab19éß!²  日🙂 ") for _ in range(rng.randint(0, 14)))
        assert c.count(t) == len(whole.encode_ordinary(t)), repr(t)


# -- toxicity


def test_toxicity_held_out(spark):
    """Labels of the small tables are few, so the order of scores is asked for more than the limit."""
    big = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{big}/documents.parquet").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    docs = docs.where("lang = 'en'").select("text", "toxic").orderBy("doc_id").toPandas()
    train, test = docs.iloc[::2], docs.iloc[1::2]
    model = toxicity.train(list(train.text), [int(t) for t in train.toxic])
    score = toxicity.Scorer(model)
    s, gold = score.scores(list(test.text)), test.toxic.to_numpy() == 1
    assert (s[gold][:, None] > s[~gold][None, :]).mean() > 0.95
    assert (s >= model.limit)[gold].mean() > 0.65 and (s >= model.limit)[~gold].mean() < 0.02


def _slow_toxicity(model, text):
    """The score by its definition: every window of every place, every word's n-grams one by one."""
    bare = [w.strip(toxicity._PUNCTUATION) for w in text.lower().split()]
    words = [w for i, w in enumerate(bare) if i == 0 or w != bare[i - 1]]
    value = []
    for w in words:
        buckets = [b for bucket, _ in toxicity.subwords([w]) for b in bucket.tolist()]
        value.append(sum(model.slope[b] for b in buckets) / len(buckets))
    if not value:
        return -np.inf
    n = min(toxicity.WINDOW, len(value))
    return max(sum(value[e - n : e]) / n for e in range(n, len(value) + 1)) + model.bias


def test_toxicity_scores_every_window(texts):
    rng = np.random.default_rng(7)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), -0.3)
    own = [*texts.text[:60], "", " \n", "a a a a b", " ".join(f"w{i}" for i in range(16)), " ".join(f"w{i}" for i in range(17)), "!!! ... ?"]
    fast = toxicity.Scorer(model).scores(own)
    for t, s in zip(own, fast):
        slow = _slow_toxicity(model, t)
        assert s == slow or abs(s - slow) < 1e-9


def test_subwords_by_hand():
    grams = [g.tolist() for _, g in [(0, x[0]) for x in toxicity.subwords(["abc."])]]
    spelled = [g for n in toxicity.GRAMS for g in ["<abc>"[i : i + n] for i in range(6 - n)]]
    assert len(grams[0]) == 1 and sum(map(len, grams[1:])) == len(spelled) == 6
    # the same n-gram of another word lies in the same bucket
    other = [g.tolist() for g, _ in toxicity.subwords(["abcd"])]
    assert grams[1][0] == other[1][0] and grams[0] != other[0]


def test_toxicity_of_one_class_flags_nothing():
    for labels in ([0] * 4, [1] * 4, []):
        model = toxicity.train(["some words"] * len(labels), labels)
        assert not (toxicity.Scorer(model).scores(["some words", "others", ""]) >= model.limit).any()


def test_misspelling_shares_vectors():
    rng = np.random.default_rng(0)
    words = [f"w{i}x{i * 7 % 31}" for i in range(300)]
    clean = [" ".join(rng.choice(words, 40)) for _ in range(300)]
    toxic = [" ".join([*rng.choice(words, 20), "blockhead", *rng.choice(words, 20)]) for _ in range(300)]
    model = toxicity.train(clean + toxic, [0] * 300 + [1] * 300)
    scorer = toxicity.Scorer(model)
    scorer.learn([["blockheads", "blockhed", *words]])
    s = scorer.words
    assert s["blockheads"] > s["blockhed"] > max(s[w] for w in words[:50])


# -- top-k search


def _searched(q, q_id, p, p_id, k):
    best = topk.Best(np.full(len(q), -np.inf), k)
    return topk.search_bucket(q, q_id, np.linalg.norm(q, axis=1), *topk.by_length(p, p_id, np.linalg.norm(p, axis=1)), best)


@pytest.mark.parametrize("coordinate", [0.9, 0.2])
def test_top_k_equals_brute_force(coordinate, monkeypatch):
    monkeypatch.setattr(topk, "COORDINATE", coordinate)
    monkeypatch.setattr(topk, "LOCAL", 100)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)) * rng.lognormal(0, 1.5, 700)[:, None]
    x[3], x[4], x[10:30] = 0, x[5], x[31]
    ids = np.arange(700)
    best = _searched(x, ids, x, ids, 7)
    s = np.round(np.einsum("ik,jk->ij", x, x), topk.DIGITS)
    np.fill_diagonal(s, -np.inf)
    for i in range(700):
        assert list(best.id[best.row == i]) == list(np.lexsort([ids, -s[i]])[:7])


def test_top_k_keeps_later_vectors_along_an_axis(monkeypatch):
    monkeypatch.setattr(topk, "LOCAL", 1)
    for sign in (1, -1):
        q, p = np.array([[sign, 0.0]]), np.array([[sign * 9.3, 8.0], [sign * 9.9, 0.0]])
        best = _searched(q, np.array([9]), p, np.arange(2), 1)
        assert list(best.id) == [1] and list(best.score) == [9.9]


def test_top_k_of_one_hot_vectors(monkeypatch):
    monkeypatch.setattr(topk, "LOCAL", 40)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 5))
    x[::3] = np.eye(5)[rng.integers(0, 5, 200)] * rng.choice([-1, 1], 200)[:, None]
    x[1::3] = np.eye(5)[rng.integers(0, 5, 200)] * 3 + rng.normal(size=(200, 5)) * 0.3
    x *= rng.lognormal(0, 0.3, 600)[:, None]
    ids = np.arange(600)
    best = _searched(x, ids, x, ids, 3)
    s = np.round(np.einsum("ik,jk->ij", x, x), topk.DIGITS)
    np.fill_diagonal(s, -np.inf)
    for i in range(600):
        assert list(best.id[best.row == i]) == list(np.lexsort([ids, -s[i]])[:3])


@pytest.mark.parametrize("size", [1.0, 1e3, 1e5])
def test_top_k_keeps_ties_of_long_vectors(size, monkeypatch):
    """A later vector whose product ties with the k-th best so far counts by its smaller id."""
    monkeypatch.setattr(topk, "LOCAL", 1)
    rng = np.random.default_rng(9)
    for _ in range(200):
        q, p = np.zeros((1, 64)), np.repeat(rng.normal(size=(1, 64)) * size, 2, axis=0)
        q[0, :40] = rng.normal(size=40) * size
        p[1, 40:] /= 2  # shorter, where the query has zeros
        best = _searched(q, np.array([9]), p, np.array([1, 0]), 1)
        assert list(best.id) == [0]


@pytest.mark.parametrize("spread", [1.0, 0.0])
@pytest.mark.parametrize("size", [None, 200])
def test_top_k_over_many_buckets(spark, size, spread):
    """Of lengths that differ, where buckets are skipped, and that are all alike, where hashes divide them."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 6))
    x *= (rng.lognormal(0, 1, 1500) * spread + (1 - spread) / np.linalg.norm(x, axis=1))[:, None]
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    _, tops, width, n = topk.bucketed(topk.vectors(v), size)
    assert width == 6 and n == 1500 and (len(tops) == 1) == (size is None) and [t for _, t in tops] == sorted((t for _, t in tops), reverse=True)
    found = collections.defaultdict(list)
    for r in sorted(topk.top_k(v, 4, size).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r.neighbor_id)
    s = np.round(x @ x.T, topk.DIGITS)
    np.fill_diagonal(s, -np.inf)
    assert all(found[i] == list(np.lexsort([np.arange(1500), -s[i]])[:4]) for i in range(1500))


def test_top_k_shuffles_no_vector_for_a_search(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    assert "Exchange" not in topk.top_k(v, 2, 10)._jdf.queryExecution().executedPlan().toString()


# -- mixing


def test_poisson_counts(spark):
    rows = [(i, "x" * 10, "en", "big" if i % 10 else "small", 10) for i in range(20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.replicate(d, {"big": 0.25, "small": 0.75}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n["big"] - 5000) < 350 and abs(n["small"] - 15_000) < 600


def test_large_rates(spark):
    rows = [(i, "x" * (1 if i < 20 else 100_000), "en", "rare" if i < 20 else "rest", 1) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    rate = {r.source: r.rate for r in mixing.rates(d).collect()}["rare"]
    assert rate > 40_000
    n = mixing.replicate(d).where("source = 'rare'").count()
    assert abs(n - 20 * rate) < 6 * (20 * rate) ** 0.5


def test_distributions_by_definition(spark):
    import math

    means = [1e-9, 0.3, 1.0, 19.5, 300.0, 12_345.6]
    table = spark.createDataFrame([(str(m), m) for m in means], "source string, rate double")
    for r in mixing.breakpoints(table).collect():
        m, total = float(r.source), 0.0
        assert r.low == max(0, math.floor(m - mixing.REACH * m**0.5 - mixing.MORE))
        for j, c in enumerate(r.cdf, r.low):
            total += math.exp(j * math.log(m) - m - math.lgamma(j + 1))
            assert c == pytest.approx(total, rel=1e-9, abs=1e-12)
        assert total == pytest.approx(1, abs=1e-9)


# -- language identification


def test_languages_held_out(documents, texts):
    model = langid.TextModel.fit(list(texts.text[::2]), list(texts.lang[::2]))
    read = langid.Reader(model)
    split = [t.lower().split() for t in texts.text[1::2]]
    read.learn(split)
    found = [model.langs[int(read.read(t)[0].argmax())] for t in split]
    assert (np.array(found) == texts.lang[1::2].to_numpy()).mean() > 0.97


def test_likelihoods_by_brute_force(texts):
    """Sums of log probabilities, n-gram by n-gram, times the factor."""
    rows = list(zip(texts.text[:120], texts.lang[:120]))
    model = langid.TextModel.fit([t for t, _ in rows], [lang for _, lang in rows])
    counts = {lang: np.full(langid.BUCKETS, 0.1) for lang in model.langs}

    def buckets(word):
        return [b for g, _ in langid.grams([word]) for b in g.tolist()]

    for t, lang in rows:
        for w in t.lower().split():
            for b in buckets(w):
                counts[lang][b] += 1
    assert model.heat in langid.HEATS and model.heat < 1  # neighbouring n-grams aren't independent
    read = langid.Reader(model)
    for t in [*texts.text[200:210], "", "123 !!", "x"]:
        pieces = t.lower().split()
        read.learn([pieces])
        x, n = read.read(pieces)
        own = [b for w in pieces for b in buckets(w)]
        slow = np.array([model.heat * sum(np.log(counts[lang][b] / counts[lang].sum()) for b in own) for lang in model.langs])
        assert n == len(own) and np.allclose(x, slow - slow.max(), atol=1e-6)


def test_more_text_tells_more(texts):
    model = langid.TextModel.fit(list(texts.text[:200]), list(texts.lang[:200]))
    read, words = langid.Reader(model), texts.text[300].lower().split()
    read.learn([words])
    gaps = [np.sort(read.read(words * k)[0])[-2] for k in (1, 2, 4)]
    assert gaps[1] == pytest.approx(2 * gaps[0]) and gaps[2] == pytest.approx(4 * gaps[0])


def test_heat_fits_held_out_pieces(texts):
    """Confidence of short pieces is as often right as it says."""
    model = langid.TextModel.fit(list(texts.text[:600]), list(texts.lang[:600]))
    read, right, said = langid.Reader(model), [], []
    for t, lang in zip(texts.text[600:], texts.lang[600:]):
        words = t.lower().split()[:4]
        read.learn([words])
        x, n = read.read(words)
        if n:
            p = np.exp(x) / np.exp(x).sum()
            right.append(model.langs[int(p.argmax())] == lang)
            said.append(p.max())
    assert abs(np.mean(right) - np.mean(said)) < 0.05


def test_ties_of_languages_and_tables_without_any(spark):
    model = langid.TextModel(["aa", "bb"], np.zeros((langid.BUCKETS, 2)))
    docs = spark.createDataFrame([(1, "same", None, None), (1, "same", None, None), (2, None, None, "s")], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(7, "http://x.zz/", "<p>same")], "page_id long, url string, html string")
    out = langid.identify(pages, docs, model).collect()
    assert sorted((str(r.doc_id), str(r.page_id), r.lang) for r in out) == [("1", "None", "aa"), ("1", "None", "aa"), ("2", "None", "aa"), ("None", "7", "aa")]
    assert all(r.confidence == pytest.approx(0.5) for r in out)
    assert all(r.lang is None and r.confidence is None for r in langid.identify(pages, docs).collect())


def test_training_documents_are_picked_without_sorting_all(spark):
    rows = [(i, f"text {i} of {lang}", lang, "s") for i in range(3000) for lang in ("aa", "bb") if lang == "aa" or i < 10]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fitted(docs, 20)
    assert model.langs == ["aa", "bb"]


def test_fusion_against_the_formula(spark, documents):
    """The posterior in plain Python, for pages whose text tells little."""
    import math

    model = langid.TextModel(["aa", "bb"], np.zeros((langid.BUCKETS, 2)))
    rows = [(i, f"http://h{i % 3}.x.{'de' if i % 2 else 'fr'}/", f"<html lang='{'bb' if i % 2 else 'aa'}'>", [0.0, -float(i)] if i % 2 == 0 else [-float(i), 0.0]) for i in range(12)]
    shown = spark.createDataFrame([(i, "bb" if i % 2 else "aa", "de" if i % 2 else "fr", "x." + ("de" if i % 2 else "fr"), f"h{i % 3}", 5, like) for i, _, _, like in rows], langid.EVIDENCE_COLUMNS)
    out = {r.id: (r.lang, r.confidence) for r in langid.fuse(shown, model.langs).collect()}
    soft = {i: [math.exp(v) / sum(map(math.exp, like)) for v in like] for i, _, _, like in rows}
    total = [sum(s[k] for s in soft.values()) for k in (0, 1)]
    share = [(t + langid.ALPHA) / (sum(total) + 2 * langid.ALPHA) for t in total]
    for i, _, _, like in rows:
        score = []
        for k in (0, 1):
            less = lambda f, k=k: max(0.0, sum(soft[j][k] for j in soft if f(j)) - soft[i][k])
            same = lambda f: max(0.0, sum(sum(soft[j]) for j in soft if f(j)) - 1)
            parity, host = (lambda j: j % 2 == i % 2), (lambda j: j % 3 == i % 3)
            domain = (less(parity) + langid.SMOOTHING * share[k]) / (same(parity) + langid.SMOOTHING)
            at_host = (less(host) + langid.SMOOTHING * domain) / (same(host) + langid.SMOOTHING)
            said = math.log((less(parity) + langid.ALPHA) / (total[k] + 2 * langid.ALPHA))
            score.append(math.log(at_host) + like[k] + 2 * said)
        best = score.index(max(score))
        assert out[i][0] == model.langs[best] and out[i][1] == pytest.approx(1 / sum(math.exp(x - max(score)) for x in score))


# -- quality


def _brute_viterbi(field, scores):
    import itertools

    best = max(itertools.product((0, 1), repeat=len(scores)), key=lambda p: sum(scores[i, s] for i, s in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:])))
    return list(best)


@pytest.mark.parametrize("part", [1, 2, 3, 256])
def test_viterbi_equals_enumeration(part, monkeypatch):
    monkeypatch.setattr(quality, "PART_LINES", part)
    rng = np.random.default_rng(0)
    for _ in range(10):
        field = quality.Field(move=rng.normal(size=(2, 2)))
        size = rng.integers(1, 11, 6)
        start = np.cumsum(size) - size
        scores = rng.normal(size=(size.sum(), 2)) * 2
        state = field.decode(scores, start, size)
        for a, n in zip(start, size):
            assert list(state[a : a + n]) == _brute_viterbi(field, scores[a : a + n])


def test_viterbi_of_many_lines_takes_few_steps():
    import time

    rng, n = np.random.default_rng(1), 300_000
    field = quality.Field(move=np.array([[1.0, -1.0], [-1.0, 1.0]]))
    scores = rng.normal(size=(n, 2))
    began = time.perf_counter()
    state = field.decode(scores, np.array([0]), np.array([n]))
    assert time.perf_counter() - began < 3
    best = scores[0].copy()
    for s in scores[1:]:
        best = np.max(best[:, None] + field.move, axis=0) + s
    own = scores[np.arange(n), state].sum() + field.move[state[:-1], state[1:]].sum()
    assert own == pytest.approx(best.max(), rel=1e-9)


def _likelihood(rng, size):
    bins = np.stack([rng.integers(0, len(c) + 1, sum(size)) for c in quality.CUTS.values()], 1)
    size = np.array(size)
    start, gold, weight = np.cumsum(size) - size, rng.integers(0, 2, size.sum()), rng.random(len(size))
    return quality.Likelihood(bins, start, size, gold, weight), bins, start, size, gold, weight / weight.sum()


def test_likelihood_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    task, bins, start, size, gold, weight = _likelihood(rng, [5, 1, 3])
    theta = rng.normal(size=quality.FEATURES * 2 + 4)
    field = quality.Field(theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))
    scores = field.scores(bins)

    def total(p, s):
        return sum(s[i, x] for i, x in enumerate(p)) + sum(field.move[x, y] for x, y in zip(p, p[1:]))

    expected = 0.0
    for a, n, w in zip(start, size, weight):
        s = scores[a : a + n]
        expected += w * (total(gold[a : a + n], s) - np.log(sum(np.exp(total(p, s)) for p in itertools.product((0, 1), repeat=n))))
    assert task(theta)[0] == pytest.approx(expected)


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    task = _likelihood(rng, [5, 4, 1])[0]
    theta = rng.normal(size=quality.FEATURES * 2 + 4) * 0.3
    slow = [(task(theta + e)[0] - task(theta - e)[0]) / 2e-6 for e in np.eye(len(theta)) * 1e-6]
    assert np.allclose(task(theta)[1], slow, atol=1e-7)


def test_labels_of_one_class_keep_everything():
    for good in (0, 1):
        _, lines, share = quality.content(quality.train(["one line", "two\nlines"], [good, good]), ["BUY | NOW", "text"])
        assert list(share) == [1, 1] and list(lines) == [1, 1]


def test_quality_held_out(spark, documents):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    docs = documents.join(labels, "doc_id").select("text", "quality").orderBy("doc_id").toPandas()
    train, test = docs.iloc[::2], docs.iloc[1::2]
    field = quality.train(list(train.text), [int(q) for q in train.quality])
    lines, _, share = quality.content(field, list(test.text))
    keep, good = share >= quality.MIN_SHARE, test.quality.to_numpy() == 1
    assert keep[good].mean() > 0.98 and keep[~good].mean() < 0.15


def test_line_features_by_hand():
    _, size, bins = quality.line_features(["AB cd | 12\n\n go go go. "])
    names = list(quality.CUTS)
    value = {n: [int(np.searchsorted(quality.CUTS[n], v, side="right")) for v in vs] for n, vs in {"upper": (0.5, 0), "bar": (1 / 7, 0), "digit": (2 / 7, 0), "repeat": (0, 1 / 3), "stop": (0, 1)}.items()}
    assert list(size) == [10, 9]
    more = {"symbol": (0, 0), "length": (10, 9), "word": (7 / 4, 7 / 3), "edge": (1, 2)}
    value |= {n: [int(np.searchsorted(quality.CUTS[n], v, side="right")) for v in vs] for n, vs in more.items()}
    assert value.keys() == quality.CUTS.keys()
    for n, v in value.items():
        assert list(bins[:, names.index(n)]) == v, n


# -- near-dedup


def test_near_duplicates_recall(documents, texts):
    found = {r.doc_id: r.kept_doc_id for r in simhash.near_duplicates(documents).collect()}
    f, some = simhash.fingerprints(list(texts.text))
    d = np.bitwise_count(f[:, None, :] ^ f[None, :, :]).sum(-1)
    a, b = np.nonzero(np.triu(d <= simhash.MAX_DISTANCE, 1) & some[:, None] & some[None, :])
    ids = texts.doc_id.to_numpy()
    root = np.array([found.get(i, i) for i in ids])
    assert (root[a] == root[b]).mean() >= 0.99
    exact = simhash._forest(a, b, len(ids))
    assert set(found) <= {int(i) for i in ids[exact != np.arange(len(ids))]}
    assert all(k < i and k not in found for i, k in found.items())


def test_oversized_buckets_are_split_without_losing_near_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(simhash, "CAP", 64)
    base = rng.integers(0, 2**63, (300, simhash.WORDS), dtype=np.uint64)
    base[:, :] = base[:1] ^ (base & np.uint64(0x1111111111111111) & base[::-1])  # one crowd, loosely alike
    twin = base.copy()
    for i in range(300):
        for p in rng.choice(simhash.BITS, 20, replace=False):
            twin[i, p // 64] ^= np.uint64(1 << int(p % 64))
    f = np.concatenate([base, twin])
    a, b = simhash.bucket_edges(np.zeros(len(f), np.int64), f)
    assert (np.bitwise_count(f[a] ^ f[b]).sum(1) <= simhash.MAX_DISTANCE).all()
    root = simhash._forest(a, b, len(f))
    assert (root[:300] == root[300:]).mean() > 0.9


@pytest.mark.parametrize("distance", [40, 45, simhash.MAX_DISTANCE])
def test_isolated_pairs_meet_where_buckets_are_split(distance, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", 12)
    rng = np.random.default_rng(8)
    n = 1500
    bits = rng.random((n, simhash.BITS)) < 0.25  # buckets are large, and pairs far from each other
    other = bits.copy()
    flip = np.argsort(rng.random((n, simhash.BITS)), axis=1)[:, :distance]
    np.put_along_axis(other, flip, ~np.take_along_axis(bits, flip, 1), 1)
    f = np.packbits(np.concatenate([bits, other]), axis=1, bitorder="little").view(np.uint64)
    order = simhash.samples()
    met = np.zeros(n, bool)
    for t in range(simhash.TABLES):
        a, b = simhash.bucket_edges(simhash._bits(f, order[t, : simhash.SAMPLED]) + (t << simhash.SAMPLED), f)
        met[a[np.abs(a - b) == n] % n] = True
    assert met.mean() > {40: 0.99, 45: 0.97}.get(distance, 0.93)


def pairs_by_index(key, f):
    """Near pairs of a bucket, every row compared with each later one by arrays of places."""
    end = np.searchsorted(key, key, side="right")
    found, lag, at = [], 1, np.arange(len(key))
    while len(at := at[at + lag < end[at]]):
        near = np.bitwise_count(f[at] ^ f[at + lag]).sum(1) <= simhash.MAX_DISTANCE
        found.append((at[near], at[near] + lag))
        lag += 1
    return tuple(np.concatenate(x) for x in zip(*found))


@pytest.mark.parametrize("small", [1, 20, 512])
def test_buckets_connect_what_near_pairs_connect(small, monkeypatch):
    for name, value in (("SMALL", small), ("BLOCK", 16), ("TILE", 24), ("SLICE", 50)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(6)
    key = np.sort(np.concatenate([np.repeat(np.arange(30), rng.integers(1, 60, 30)), np.repeat(30, 300)])).astype(np.int32)
    f = rng.integers(0, 2**63, (200, simhash.WORDS), dtype=np.uint64)[rng.integers(0, 200, len(key))]
    f ^= rng.integers(0, 2**63, f.shape, dtype=np.uint64) & rng.integers(0, 2**63, f.shape, dtype=np.uint64) & rng.integers(0, 2**63, f.shape, dtype=np.uint64)
    mixed = rng.permutation(len(key))
    a, b = simhash.bucket_edges(key[mixed], f[mixed])
    assert len(a) and (simhash.distance(f[mixed][a], f[mixed][b]) <= simhash.MAX_DISTANCE).all() and (key[mixed][a] == key[mixed][b]).all()
    assert list(simhash._forest(mixed[a], mixed[b], len(key))) == list(simhash._forest(*pairs_by_index(key, f), len(key)))


def test_a_bucket_of_thousands_is_compared_whole():
    rng = np.random.default_rng(9)
    f = rng.integers(0, 2**64, (1500, simhash.WORDS), dtype=np.uint64)
    other = np.unpackbits(f.view(np.uint8), axis=1, bitorder="little")
    flip = np.argsort(rng.random(other.shape), axis=1)[:, : simhash.MAX_DISTANCE]
    np.put_along_axis(other, flip, 1 - np.take_along_axis(other, flip, 1), 1)
    f = np.concatenate([f, np.packbits(other, axis=1, bitorder="little").view(np.uint64)])
    a, b = simhash.bucket_edges(np.zeros(len(f), np.int64), f)
    assert {(i, i + 1500) for i in range(1500)} <= {(int(min(x)), int(max(x))) for x in zip(a, b)}


def test_comparing_takes_a_fraction_of_the_time_that_places_take():
    rng = np.random.default_rng(10)
    key = np.repeat(np.arange(40, dtype=np.int32), 300)
    f = rng.integers(0, 2**64, (len(key), simhash.WORDS), dtype=np.uint64)

    def seconds(compare):
        began = time.process_time()
        compare(key, f)
        return time.process_time() - began

    took = [min(seconds(c) for _ in range(3)) for c in (simhash.bucket_edges, pairs_by_index)]
    assert took[0] < took[1] / 2


def test_long_texts_of_the_same_words_are_apart():
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(3000)])
    zipf = 1 / np.arange(1, 3001)
    for p in (None, zipf / zipf.sum()):
        texts = [" ".join(rng.choice(words, 20_000, p=p)) for _ in range(5)]
        turned = " ".join(texts[0].split()[::-1])
        near = texts[0].split()
        near[::25] = ["other"] * len(near[::25])
        f, _ = simhash.fingerprints([*texts, turned, " ".join(near)])
        d = simhash.distance(f[:, None], f[None, :])
        assert d[np.triu_indices(6, 1)].min() > simhash.MAX_DISTANCE + 20
        assert d[0, 6] < simhash.MAX_DISTANCE


def test_fingerprints_by_definition():
    texts = ["The cat the CAT sat", "", "one", "b a b a b", " ".join(f"x{i}" for i in range(700))]
    h, size = simhash.features(texts)
    for t, n in zip(texts, size):
        words = t.lower().split()
        assert n == len({*words, *zip(words, words[1:])})
    f, some = simhash.fingerprints(texts)
    assert list(some) == [True, False, True, True, True]
    at = np.cumsum(size) - size
    for i in np.flatnonzero(some):
        own = h[at[i] : at[i] + size[i]]
        bits = np.concatenate([np.unpackbits(simhash._mix(own + np.uint64((w * 0x9E3779B97F4A7C15) & (2**64 - 1))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for w in range(simhash.WORDS)], axis=1)
        expected = 2 * bits.sum(0, dtype=int) + np.arange(simhash.BITS) % 2 > size[i]
        assert (np.unpackbits(f[i].view(np.uint8), bitorder="little") == expected).all()


def test_buckets_are_streamed_whole(monkeypatch):
    monkeypatch.setattr(simhash, "ROWS", 10)
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 12, 300)).astype(np.int32)
    f = rng.integers(0, 2**63, (40, simhash.WORDS), dtype=np.uint64)[rng.integers(0, 40, 300)]
    ids = np.arange(300)

    def batches(size):
        for s in range(0, 300, size):
            e = slice(s, s + size)
            yield pa.RecordBatch.from_arrays([pa.array(key[e]), pa.array(ids[e]), *(pa.array(np.ascontiguousarray(f[e, w]).view(np.int64)) for w in range(simhash.WORDS))], ["key", "doc_id", "f0", "f1", "f2", "f3"])

    for size in (1, 7, 300):
        out = list(simhash._edges(batches(size)))
        a, b = (np.concatenate([x.column(c).to_numpy() for x in out]) for c in ("a", "b"))
        assert (simhash.distance(f[a], f[b]) <= simhash.MAX_DISTANCE).all()
        root = simhash._forest(a, b, 300)
        near = [(i, j) for i in range(300) for j in range(i) if key[i] == key[j] and simhash.distance(f[i], f[j]) <= simhash.MAX_DISTANCE]
        assert near and all(root[i] == root[j] for i, j in near)


def test_versions_of_one_document_connect_their_copies(spark):
    one, two = "the first text of some length with many words", "another version that shares nothing at all here"
    rows = [(7, one), (7, two), (5, one), (9, two), (9, two), (11, "alone with its words and nobody else around")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == [(7, 5), (9, 5)]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(60)]
    found = {r.doc_id: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    a, b = np.array(edges).T
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = simhash._forest(place[: len(a)], place[len(a) :], len(nodes))
    assert found == {int(n): int(nodes[r]) for n, r in zip(nodes, root) if nodes[r] != n}


# -- packing


def test_packing_places_every_token_once(documents):
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents).collect()}
    rows = packing.pack_documents(documents).collect()
    spans, packs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.n_tokens))
        packs[r.pack_id].append((r.slot, r.offset, r.n_tokens))
    for i, n in counts.items():
        at = 0
        for start, size in sorted(spans[i]):
            assert start == at
            at += size
        assert at == n
    for own in packs.values():
        at = 0
        for _, offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= packing.WINDOW
    full = sum(counts.values()) / packing.WINDOW
    assert len(packs) <= 1.05 * full + 1 and sorted(packs) == list(range(len(packs)))


def test_nnls_conditions():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, b = rng.random((12, 30)), rng.random(12) * 5
        x = packing.nnls(a, b)
        grad = a.T @ (b - a @ x)
        assert (x >= 0).all() and grad.max() < 1e-6 and np.abs(grad[x > 1e-9]).max() < 1e-6


def _fewest(pieces, window):
    """The least number of windows that hold these lengths, by trying all ways."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= pieces[i] and rooms[j] not in rooms[:j]:
                place(i + 1, [*rooms[:j], rooms[j] - pieces[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, window - pieces[i]])

    place(0, [])
    return best


def test_plan_against_all_ways_to_pack():
    rng = np.random.default_rng(5)
    for _ in range(40):
        h = np.bincount(rng.integers(0, 8, rng.integers(1, 10)), minlength=8)
        pieces = sorted((b + 1 for b in range(8) for _ in range(h[b])), reverse=True)
        used = sum(n for n, _ in packing.plan(h))
        assert _fewest(pieces, 8) <= used <= _fewest(pieces, 8) + 1


def test_large_bins_are_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    rng = np.random.default_rng(6)
    counts = [(int(i) if i % 3 else None, int(n)) for i, n in enumerate(rng.integers(0, 300, 400))]
    out = packing.pack(spark.createDataFrame(counts, "doc_id long, n_tokens long"), 64, 16, 3).collect()
    assert sum(r.n_tokens for r in out) == sum(n for _, n in counts)
    packs = collections.defaultdict(list)
    for r in out:
        packs[r.pack_id].append((r.slot, r.offset, r.n_tokens))
    for own in packs.values():
        own.sort()
        assert [s for s, _, _ in own] == list(range(len(own))) and [o for _, o, _ in own] == [sum(n for _, _, n in own[:i]) for i in range(len(own))] and sum(n for _, _, n in own) <= 64


def test_plan_uses_every_text():
    rng = np.random.default_rng(1)
    for h in (rng.integers(0, 900, 128), np.eye(128, dtype=int)[5] * 7, np.zeros(128, int)):
        used = np.zeros(128, int)
        for n, bins in packing.plan(h):
            assert sum(bins) <= 128 and n > 0
            for b in bins:
                used[b - 1] += n
        assert (used == h).all()


# -- line dedup


def test_incremental_line_dedup_is_reversible(spark, documents, tmp_path):
    first, second = documents.where("doc_id < 400"), documents.where("doc_id >= 400")
    state = linededup.LineDedup(spark, str(tmp_path / "state"), 4)
    n = state.insert(first).count()
    before = sorted(map(tuple, state.table("counts").collect()))
    filters = {r.shard: linededup.Cuckoo.from_bytes(r.filter) for r in state.table("filters").collect()}
    assert all(filters[r[0]].contains(np.array([r[1]], np.int64).view(np.uint64)).all() for r in before)
    n += state.insert(second).count()
    both = [r for r in state.table("counts").collect()]
    assert n == sum(r.lines_removed for r in linededup.dedup_lines(documents).collect())
    state = linededup.LineDedup(spark, str(tmp_path / "state"))  # as found on disk
    assert state.shards == 4 and state.version == 2
    state.delete(second.select("doc_id"))
    assert sorted(map(tuple, state.table("counts").collect())) == before
    # the filters have let go of what is gone
    held = {(r[0], r[1]) for r in before}
    gone = [r for r in both if (r.shard, r.hi) not in held]
    filters = {r.shard: linededup.Cuckoo.from_bytes(r.filter) for r in state.table("filters").collect()}
    known = sum(int(filters[r.shard].contains(np.array([r.hi], np.int64).view(np.uint64))[0]) for r in gone)
    assert len(gone) > 500 and known < 0.01 * len(gone)
    assert all(filters[r[0]].contains(np.array([r[1]], np.int64).view(np.uint64)).all() for r in before)
    state.vacuum()
    assert sorted(map(tuple, linededup.LineDedup(spark, str(tmp_path / "state")).table("counts").collect())) == before
    assert not (tmp_path / "state" / "v2" / "counts").exists() or state.state["docs"] == [1, 2]
    # what was first before is first again, and an emptied state knows nothing
    state.delete(first.select("doc_id"))
    assert state.table("counts").count() == state.table("postings").count() == 0
    assert state.insert(first).count() + second.count() - second.count() == sum(r.lines_removed for r in linededup.dedup_lines(first).collect())


def test_a_deleted_owner_passes_the_line_on(spark, tmp_path):
    state = linededup.LineDedup(spark, str(tmp_path / "s"), 3)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    state.insert(docs((1, "a\nb\na"), (2, "b\nc"), (None, "c")))
    assert {r.doc_id for r in [*state.insert(docs((3, "b\nd"))).withColumnRenamed("doc", "doc_id").collect()]} == {3}
    state.delete(docs((1, ""), (77, "")).select("doc_id"))
    counts = {(r.doc, r.pos): r.refs for r in state.table("counts").collect()}
    assert counts == {(2, 0): 2, (2, 1): 2, (3, 1): 1}
    again = state.insert(docs((4, "a\nc"))).collect()
    assert [(r.doc, r.pos) for r in again] == [(4, 1)]


def test_deletion_touches_only_the_shards_of_its_lines(spark, tmp_path):
    import shutil

    state = linededup.LineDedup(spark, str(tmp_path / "s"), 16)
    state.insert(spark.createDataFrame([(i, "\n".join(f"line {i} {j}" for j in range(40))) for i in range(20)], "doc_id long, text string"))
    state.insert(spark.createDataFrame([(100, "only this line")], "doc_id long, text string"))
    own = state.touched_by(spark.createDataFrame([(100,)], "doc long"))
    assert len(own) == 1
    for name in ("counts", "postings", "filters"):  # the others aren't even there any more
        for p in (tmp_path / "s" / "v1" / name).glob("shard=*"):
            if p.name != f"shard={own[0]}":
                shutil.rmtree(p)
    state.delete(spark.createDataFrame([(100,)], "doc_id long"))
    assert {s for s, v in state.state["counts"].items() if v == 3} == set(own)
    assert {s for s, vs in state.state["postings"].items() if vs == [3]} == set(own)


def test_a_run_that_breaks_off_leaves_the_last_version(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    linededup.LineDedup(spark, at, 2).insert(docs((1, "a\nb")))
    before = sorted(map(tuple, linededup.LineDedup(spark, at).table("counts").collect()))
    for broken in ("counts", "filters", "postings", "docs", None):
        state = linededup.LineDedup(spark, at)
        with monkeypatch.context() as m:

            def write(self, df, name, part="shard", real=linededup.LineDedup._write):
                if name == broken:
                    raise OSError(name)
                real(self, df, name, part)

            def commit(self, state):
                raise OSError("before the manifest")

            m.setattr(linededup.LineDedup, "_write", write)
            if broken is None:
                m.setattr(linededup.LineDedup, "_commit", commit)
            with pytest.raises(OSError):
                state.insert(docs((2, "b\nc")))
        now = linededup.LineDedup(spark, at)
        assert now.version == 1 and sorted(map(tuple, now.table("counts").collect())) == before
    other = linededup.LineDedup(spark, at)
    now.insert(docs((2, "b\nc")))
    with pytest.raises(RuntimeError):
        other.insert(docs((3, "d")))
    assert linededup.LineDedup(spark, at).version == 2


def test_rows_without_id_cost_what_others_do(spark):
    import time

    took = []
    for i in ("id", "cast(null as long)", "id"):  # the first run also compiles
        docs = spark.range(20_000).selectExpr(f"{i} as doc_id", "concat('line ', id % 5000, '\n', 'own ', id) as text")
        began = time.perf_counter()
        rows = linededup.dedup_lines(docs).agg(F.sum("lines_removed")).first()[0]
        took.append(time.perf_counter() - began)
        assert rows == 15_000
    assert took[1] < 3 * took[2] + 3


def test_the_largest_id_is_not_null(spark):
    docs = spark.createDataFrame([(2**63 - 1, "a\nb"), (None, "a\nb"), (1, "b")], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.lines_removed) for r in linededup.dedup_lines(docs).collect()}
    assert out[1] == ("b", 0)
    assert sorted([out[None], out[2**63 - 1]]) == [("", 2), ("a", 1)]


def test_cuckoo_filter():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    c = linededup.Cuckoo(64)
    for part in np.split(h, 10):
        held = h
        c.insert(part, lambda held=held: held)
    assert c.contains(h).all()
    assert c.contains(rng.integers(0, 2**64, 50_000, dtype=np.uint64)).mean() < 0.001
    c = linededup.Cuckoo.from_bytes(c.to_bytes())
    own = np.unique(h)
    c = linededup.Cuckoo(len(own))
    c.insert(own, lambda: own)
    c.remove(own[::2])
    assert c.contains(own[1::2]).all() and c.contains(own[::2]).mean() < 0.01


def test_keys_that_share_a_hash_are_removed_one_by_one():
    h = np.array([5, 5, 5, 9], np.uint64)
    c = linededup.Cuckoo()
    c.insert(h, lambda: h)
    for left in (True, True, False):
        c.remove(np.array([5], np.uint64))
        assert c.contains(np.array([5, 9], np.uint64)).tolist() == [left, True]


def test_insert_shard_in_chunks(monkeypatch):
    monkeypatch.setattr(linededup, "CHUNK", 37)
    rng = np.random.default_rng(5)
    rows = np.zeros(3000, linededup.Counts.TYPE)
    rows["hi"] = rng.integers(0, 500, 3000).astype(np.uint64) << np.uint64(40)
    rows["lo"] = rng.integers(0, 2, 3000)
    rows["refs"], rows["doc"], rows["pos"] = 1, rng.permutation(3000), 0
    counts = linededup.Counts()
    again = linededup.insert_shard(rows, counts, linededup.Cuckoo(8))
    first = {}
    for r in np.sort(rows, order=["doc"]):
        first.setdefault((r["hi"], r["lo"]), r["doc"])
    assert sorted(again["doc"]) == sorted(set(range(3000)) - set(first.values()))
    assert {(r["hi"], r["lo"]): r["doc"] for r in counts.all()} == first and counts.all()["refs"].sum() == 3000


@pytest.mark.parametrize("chunk", [1, 2, 3, 5])
def test_repeated_rows_of_two_partitions_keep_their_first_lines(chunk, monkeypatch):
    monkeypatch.setattr(linededup, "CHUNK", chunk)
    texts = [(1, "a\nb\nc"), (2, "c\nd\na"), (3, "d\ne")]
    partition = pa.RecordBatch.from_pydict({"doc": [i for i, _ in texts], "text": [t for _, t in texts]})
    found = [b for _ in range(2) for b in linededup._postings(1, False)(iter([partition]))]
    counts = linededup.Counts()
    rows, shards = linededup._rows(found)
    linededup.insert_shard(rows[shards >= 0], counts, linededup.Cuckoo())
    assert list(counts.all()["refs"]) == [2 * sum(t.split("\n").count(line) for _, t in texts) for line in sorted("abcde", key=linededup.line_key)]
    again, _ = linededup._rows(linededup._insert_partition(iter(found)))
    assert {(int(r["doc"]), int(r["pos"])) for r in again} == {(2, 0), (2, 2), (3, 0)}


# -- chat


def test_chat_round_trip(spark):
    turns = spark.read.parquet(f"{BIG}/conversations.parquet")
    gold = collections.defaultdict(list)
    for r in turns.orderBy("conv_id", "turn").collect():
        gold[r.conv_id].append((r.role, r.text))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # conversations reach over batches
    try:
        out = {r.conv_id: r.text for r in chat.format_chats(turns).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, text in out.items():
        back = [tuple(t.split("\n", 1)) for t in text.removeprefix(chat.HEAD).removesuffix(chat.TAIL).split(chat.TAIL + chat.HEAD)]
        assert back == gold[i]
    assert out.keys() == gold.keys()
