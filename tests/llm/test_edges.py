"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing names."""

import ast
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import chat, common, langid, linededup, mixing, packing, quality, simhash, token_counts, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the rain in spain falls mainly on the plain and nobody minds it much at all"


def odd_rows():
    long = " ".join(f"word{i % 977} and" for i in range(60_000))
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, "en", "b"), (4, "", None, "b"), (5, " \n\t ", "de", None),
        (None, "no id at all but words enough to count", "en", "c"), (None, None, None, None), (6, long, "en", "hot"), (7, "x" * 1_500_000, "en", "hot"),
        (8, "\n\n\n", "fr", "a"), (9, "one", "fr", "a"), (10, "é日本語 🙂 ||| *** !!", "fr", "b"), (11, "a\u0000b\r\nc d", "de", "b"), (11, "other text under one id", "de", "b"), (-5, PROSE + " indeed", "en", ""),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def internal_names():
    """Every name that the operators give a column of their own: the strings in their source that look like one."""
    names = set()
    for p in sorted((Path(linededup.__file__).parent).glob("*.py")):
        for t in ast.walk(ast.parse(p.read_text())):
            if isinstance(t, ast.Constant) and isinstance(t.value, str):
                names |= {w for w in re.findall(r"\w+", t.value) if re.fullmatch(r"_?[a-z]\w*_?", w)} if re.fullmatch(r"[\w ,.<>=]{1,200}", t.value) else set()
    return sorted({n.lower() for n in names if len(n) < 20})


CLASHES = [*internal_names(), "a.b", "lines_removed_", "_copy_no", "COPY_NO_"]


def clashing(df):
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(dict.fromkeys(CLASHES)) if c.lower() not in have])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


def shapes(docs, spark):
    return {"odd": docs, "clashing": clashing(docs), "empty": spark.createDataFrame([], SCHEMA)}


@pytest.mark.parametrize("shape", ["odd", "clashing", "empty"])
def test_operators(spark, docs, labels, shape):
    d = shapes(docs, spark)[shape]
    n = d.count()
    tokens = token_counts.token_counts(d).collect()
    assert len(tokens) == n and all(t.n_tokens == 0 for t in tokens if t.doc_id == 4) and all(t.n_tokens is None for t in tokens if t.doc_id == 3)
    toxic = toxicity.score(d, toxicity.fitted(d, labels)).collect()
    assert len(toxic) == n and not any(t.toxic for t in toxic if t.doc_id in (3, 4, 5))
    scored = quality.score(d, quality.fitted(d, labels)).collect()
    assert len(scored) == n and not any(s.keep for s in scored if s.doc_id in (3, 4, 5, 8))
    pages = spark.createDataFrame([(1, "http://a.b.de/x", "<html lang='de'><p>hallo"), (2, None, None), (None, "::::[", "<script>x"), (4, "", "")], "page_id long, url string, html string")
    pages = pages if shape != "empty" else pages.limit(0)
    assert langid.identify(clashing(pages) if shape == "clashing" else pages, d).count() == n + pages.count()
    out = linededup.dedup_lines(d).collect()
    assert len(out) == n and {r[-1] for r in out if r.doc_id == 1} <= {0} and all(r.text is None for r in out if r.doc_id == 3)
    pairs = {(r.doc_id, r.kept_doc_id) for r in simhash.near_duplicates(d).collect()}
    assert shape == "empty" or {(1, -5), (2, -5)} <= pairs
    mixed = mixing.replicate(d)
    assert mixed.columns[:-1] == d.columns and mixed.columns[-1].startswith("copy_no") and mixed.count() >= 0
    placed = packing.pack_documents(d).collect()
    assert sum(r.n_tokens for r in placed) == sum(t.n_tokens or 0 for t in tokens)


@pytest.mark.parametrize("shape", ["odd", "clashing", "empty"])
@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, docs, labels, shape, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    d = shapes(docs, spark)[shape]
    out = stage[1](spark, d, str(tmp_path))
    rows = out.collect()
    if stage is not corpus_pipeline.STAGES[-1]:
        assert out.columns == d.columns
        assert shape != "empty" or not rows


@pytest.mark.parametrize("rows", [[], [(99, 0, 0)], [(3, 0, 0), (4, 0, 0), (8, 0, 0)], [(1, None, 0)], [(1, 0, 1), (2, 0, 1)], [(1, 1, 0)]], ids=["none", "no document", "no text", "null", "bad alone", "good alone"])
def test_quality_without_usable_labels_keeps_every_text(spark, docs, rows, tmp_path):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    texts = [r.text for r in docs.collect()]
    expected = sorted(t for t in texts if t and t.strip())
    assert sorted(r.text for r in quality.stage(spark, docs, str(tmp_path)).collect()) == expected
    scored = quality.score(docs, quality.fitted(docs, labels)).collect()
    assert sum(s.keep for s in scored) == len(expected) and all(s.content_share == 1 for s in scored if s.keep)
    # through the pipeline as well: nothing is lost to it
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert kept == {r.doc_id for r in docs.collect() if r.text and r.text.strip()}
    if not rows:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    flagged = toxicity.score(docs, toxicity.fitted(docs, labels)).collect()
    assert not any(r.toxic for r in flagged)


def test_repeated_rows_near_dedup(spark):
    d = spark.createDataFrame([(5, PROSE, "en", "a", 1)] * 4 + [(6, PROSE, "en", "a", 1), (None, PROSE, "en", "a", 1)], SCHEMA)
    assert sorted(simhash.stage(spark, d, "").select("doc_id").collect(), key=str) == sorted([(5,), (None,)], key=str)


def test_blank_rows_stay_whatever_else_repeats(spark):
    blank = [(3, " \n", "en", "a", 1)] * 3 + [(4, None, "en", "a", 1)] * 2
    for texts in ([(1, PROSE, "en", "a", 1)], [(1, PROSE, "en", "a", 1)] * 2, [(3, PROSE, "en", "a", 1)] * 2):
        out = simhash.stage(spark, spark.createDataFrame([*blank, *texts], SCHEMA), "").collect()
        assert sorted((r.doc_id, bool(r.text and r.text.strip())) for r in out) == sorted([(3, False)] * 3 + [(4, False)] * 2 + [(texts[0][0], True)])


def test_survivor_of_repeated_rows_is_always_the_same(spark):
    rows = [(1, PROSE, "en", s, n) for s in ("c", "a", "b") for n in (7, 5, None)] + [(1, PROSE.upper() + " ", "de", "a", 5)]
    found = {tuple(simhash.stage(spark, spark.createDataFrame(own, SCHEMA).repartition(k), "").collect()) for k, own in ((1, rows), (5, rows), (3, rows[::-1]))}
    assert len(found) == 1 and len(next(iter(found))) == 1


def test_long_texts_and_repeats_are_bounded_in_training(spark, labels):
    rows = [(1, "y" * 50 + str(i)) for i in range(300)] + [(2, "z" * 400), (3, "a b"), (5, "c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 5)], "doc_id long, lab long")
    out = common.training_rows(docs, chosen, "lab", 1, longest=100)
    assert out == [("a b", 1), ("c d", 1), ("y" * 50 + "0", 1)]
    few = common.training_rows(docs, chosen, "lab", 1, chars=10, longest=100)
    assert few == [("a b", 1), ("c d", 1)]


def test_many_short_lines_are_quick(spark, labels):
    import time

    docs = spark.createDataFrame([(1, "ab\n" * 300_000)], "doc_id long, text string")
    field = quality.train(["BUY | NOW\n" * 5, "A sentence of words, which ends.\n" * 5], [0, 1])
    began = time.perf_counter()
    assert quality.score(docs, field).first().n_lines == 300_000
    assert time.perf_counter() - began < 6


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_top_k_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [2.0]), (8, [None, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk.top_k(clashing(v), 2).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.neighbor_id, r.score))
    assert found == {1: [(7, 2.0), (2, 0.5)], 2: [(7, 1.0), (1, 0.5)], 6: [(1, 0.0), (2, 0.0)], 7: [(1, 2.0), (2, 1.0)]}
    assert topk.top_k(v.limit(0)).count() == 0


def test_chat_odd_turns(spark):
    rows = [(1, 1, "user", "b"), (1, 0, None, "a"), (1, 1, "user", "b"), (2, None, "user", None), (None, 0, "user", "x"), (3, 0, "user", "é" * 300_000)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(clashing(t)).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert out[1].text == turn("unknown", "a") + turn("user", "b") * 2 and out[1].n_turns == 3
    assert out[2].text == turn("user", "") and out[None].text == turn("user", "x")
    lone = t.unionByName(t.where("conv_id is null")).unionByName(t.where("conv_id is null"))
    assert [r.text for r in chat.format_chats(lone.repartition(1)).where("conv_id is null").collect()] == [turn("user", "x")] * 3
    assert out[3].n_bytes == len(out[3].text.encode())
    assert chat.format_chats(t.limit(0)).count() == 0
