"""Sequences without groups at scale: no task holds more than a block, and nothing else comes out."""

import duckdb
import pytest
from pyspark.sql import functions as F

import loomline.seq as seq
from loomline.operators import windows as wi
from loomline.plans import effects, sequences  # noqa: F401
from loomline.plans.registry import QUERIES, SQL
from loomline.sources.inputs import from_values, table

#: Queries that were held by one task, by the number of the finding.
HELD = ["run_ranges", "running_variance", "map_in_place", "reduced_runs", "longest_runs", "zip_counter_and_filter", "runs_of_types", "consecutive_triples", "dedupe_types"]


@pytest.mark.parametrize("name", HELD)
def test_in_blocks_as_in_sql(spark, sf, name, monkeypatch):
    monkeypatch.setattr(seq, "BLOCK_BYTES", 6000)
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "shufflepartitionidpassthrough" in plan and seq.BLOCK not in df.columns
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    expected = con.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(df.columns)

    def rounded(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)

    assert rounded(df.select(*columns).collect()) == rounded(expected.fetchall())


def test_compressed_rows_are_counted_and_each_block_has_a_task(spark, tmp_path):
    """Files of 6 MB, far below what their rows take."""
    at = str(tmp_path / "rows")
    spark.range(1_500_000).select("id", F.lit("click").alias("kind"), F.lit("a").alias("a"), F.lit("b").alias("b")).write.parquet(at)
    s = table(spark, at, "id")
    assert seq.estimated_bytes(s.df) < 16 << 20
    cut = s.blocked()
    rows = cut.df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.min(seq.BLOCK).alias("a"), F.max(seq.BLOCK).alias("b")).collect()
    assert len(rows) == len(cut.cuts) + 1 > 5
    assert all(r.a == r.b == r.task for r in rows) and max(r.n for r in rows) < 800_000


def test_long_texts_make_more_blocks(spark):
    s = from_values(spark, ["x" * 10_000] * 200, "string")
    assert len(seq.replace(s, block_bytes=200_000).blocked().cuts) > 5


def test_rows_go_to_their_blocks_once(spark, sf, monkeypatch):
    """Runs take the previous row and a running sum of one division."""
    monkeypatch.setattr(seq, "BLOCK_BYTES", 6000)
    out = wi.runs(F.col("event_type"))(table(spark, f"{sf}/events.parquet", "event_id"))
    assert not out.is_blocked and not out.keeps_blocks
    plan = out.df._jdf.queryExecution().optimizedPlan().toString()
    main = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(main) == 4  # rows, and what blocks carry over into them; the same for the totals of blocks


@pytest.mark.parametrize("cuts", [1, 16, 17, 300, 1500])
def test_places_of_any_number_of_cuts(spark, cuts):
    """Compared one by one, in two searches, in lists; nulls first."""
    df = spark.range(2000).select(F.nullif("id", F.lit(0)).alias("id"))
    at = sorted({i * 2000 // (cuts + 1) for i in range(cuts)})
    made = [f'{{"id":{i or "null"}}}' for i in at]
    for r in seq._locate(df, ["id"], made).collect():
        assert r[1] == sum(i < (r.id or 0) for i in at)
    pairs = df.select(F.lit(1).alias("g"), "id")
    for r in seq._locate(pairs, ["g", "id"], [f'{{"g":1,"id":{i or "null"}}}' for i in at]).collect():
        assert r[2] == sum(i < (r.id or 0) for i in at)
