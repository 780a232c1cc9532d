"""The pipeline against brute force, stage by stage."""

from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from loomline.llm import mixing, packing, quality, simhash
from loomline.llm.common import read, shared_dir


def _folders(spark):
    return Path(shared_dir(spark).removeprefix("file:")).glob("pipeline-*")


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs, found = read(spark, sf, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        found.append(docs.toPandas())
        docs = spark.createDataFrame(found[-1]) if stage is not packing.stage else docs
    return found


def _kept(field, text):
    """Whether a text stays: its lines scored one by one, the best labels by plain dynamic programming, the share of bytes."""
    lines = [b for x in text.split("\n") if (b := x.strip().encode())]
    if not lines:
        return False
    _, _, bins = quality.line_features([text])
    best: dict[int, tuple[float, list[int]]] = {}
    for row in bins:
        s = [sum(field.emit[off + b, k] for off, b in zip(quality.OFFSETS, row)) for k in (0, 1)]
        best = {k: max(((v + field.move[j, k] + s[k], [*path, k]) for j, (v, path) in best.items()), key=lambda x: x[0]) if best else (s[k], [k]) for k in (0, 1)}
    path = max(best.values(), key=lambda x: x[0])[1]
    return sum(len(b) for b, k in zip(lines, path) if k) >= quality.MIN_SHARE * sum(map(len, lines))


def test_stages_by_brute_force(spark, sf, outputs):
    docs = read(spark, sf, "documents").toPandas()
    field = quality.fitted(read(spark, sf, "documents"), read(spark, sf, "labels"))
    docs = docs[[_kept(field, t) for t in docs.text]].sort_values("doc_id")
    assert set(outputs[0].doc_id) == set(docs.doc_id)

    seen, texts = set(), []
    for t in docs.text:
        kept = []
        for line in t.split("\n"):
            bare = line.strip(" \t\r")
            if bare and bare in seen:
                continue
            seen.add(bare) if bare else None
            kept.append(line)
        texts.append("\n".join(kept))
    docs = docs.assign(text=texts)
    docs = docs[docs.text.str.strip() != ""]
    assert dict(zip(outputs[1].doc_id, outputs[1].text)) == dict(zip(docs.doc_id, docs.text))
    assert (outputs[1].n_chars == outputs[1].text.str.len()).all()

    f, _ = simhash.fingerprints(list(docs.text))
    d = np.bitwise_count(f[:, None, :] ^ f[None, :, :]).sum(-1)
    a, b = np.nonzero(np.triu(d <= simhash.MAX_DISTANCE, 1))
    gone = set(docs.doc_id.to_numpy()[simhash._forest(a, b, len(docs)) != np.arange(len(docs))])
    dropped = set(docs.doc_id) - set(outputs[2].doc_id)
    assert dropped <= gone and (not gone or len(dropped) >= 0.98 * len(gone))

    rate = {r.source: r.rate for r in mixing.rates(spark.createDataFrame(outputs[2])).collect()}
    expected = sum(rate[s] for s in outputs[2].source)
    assert abs(len(outputs[3]) - expected) < 6 * expected**0.5
    assert set(outputs[3].doc_id) <= set(outputs[2].doc_id)

    packs = outputs[4].groupby("pack_id").n_tokens.sum()
    assert packs.max() <= packing.WINDOW and set(outputs[4].doc_id) == set(outputs[3].doc_id)


def test_run(spark, sf, outputs):
    before = set(_folders(spark))
    out = corpus_pipeline.run(spark, sf)
    (own,) = set(_folders(spark)) - before
    assert [p.name for p in own.iterdir()] == [str(len(corpus_pipeline.STAGES) - 2)]  # what the result is made from
    assert sorted(map(tuple, out.select("doc_id", "start", "n_tokens").collect())) == sorted(map(tuple, outputs[4][["doc_id", "start", "n_tokens"]].to_numpy().tolist()))
