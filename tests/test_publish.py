"""Published versions: all tables or none, profiled by the scan that writes them; views in versions."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from orderlens.plans.workflow import EXPORTED
from orderlens.sample.queries import sample_analysis
from orderlens.sample.tables import DELIVERED, sample_tables
from orderlens.sources.catalog import new_folder, register_tables
from orderlens.sources.publish import last_version, manifest_of, profile, publish_tables, read_published
from orderlens.sources.views import create_view, drop_view, view_text

DIRECTORY = "/root/testdata/sf0.001"


def test_versions_are_read_as_published(spark):
    path = new_folder(spark, "published")
    first = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert last_version(spark, path) is None
    with pytest.raises(ValueError, match="no published version"):
        read_published(spark, path)
    publish_tables(spark, {"t": first, "u": first.limit(0)}, path)
    publish_tables(spark, {"t": first.where("k = 1")}, path)
    assert last_version(spark, path) == 2
    assert [tuple(r) for r in read_published(spark, path)["t"].collect()] == [(1, "a")]
    old = read_published(spark, path, 1)
    assert sorted(map(tuple, old["t"].collect())) == [(1, "a"), (2, None)]
    assert old["u"].schema == first.schema and old["u"].count() == 0
    rows = {(r.table_name, r.column_name): (r.total_rows, r.null_rows) for r in profile(spark, manifest_of(spark, path, 1)).collect()}
    assert rows == {("t", "k"): (2, 0), ("t", "v"): (2, 1), ("u", "k"): (0, 0), ("u", "v"): (0, 0)}


def test_a_write_that_fails_halfway_leaves_the_last_version(spark, tmp_path):
    path = str(tmp_path / "published")
    good = spark.range(10)
    publish_tables(spark, {"a": good, "b": good}, path)
    broken = good.select(F.when(F.col("id") < 7, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        publish_tables(spark, {"a": good.where("id < 3"), "b": broken}, path)
    assert last_version(spark, path) == 1
    published = read_published(spark, path)
    assert published["a"].count() == published["b"].count() == 10
    assert len(glob.glob(f"{path}/versions/*")) == 1


def test_a_table_can_replace_the_one_it_is_made_from(spark, tmp_path):
    path = str(tmp_path / "published")
    publish_tables(spark, {"t": spark.range(5)}, path)
    publish_tables(spark, {"t": read_published(spark, path)["t"].where("id > 1")}, path)
    assert sorted(r.id for r in read_published(spark, path)["t"].collect()) == [2, 3, 4]


def test_a_version_is_published_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "published")
    publish_tables(spark, {"t": spark.range(5)}, path)
    monkeypatch.setattr("orderlens.sources.publish.last_version", lambda *_: 0)
    with pytest.raises(ValueError, match="another run"):
        publish_tables(spark, {"t": spark.range(6)}, path)
    monkeypatch.undo()
    assert read_published(spark, path)["t"].count() == 5
    assert len(glob.glob(f"{path}/manifests/[0-9]*")) == 1


def test_the_profile_equals_the_checks(spark, tmp_path):
    analysis = sample_analysis(spark, DIRECTORY)
    manifest = publish_tables(spark, dict(analysis.raw), str(tmp_path / "published"))
    counts = {r.table_name: r.row_count for r in analysis.jobs()["table_row_counts"]().collect()}
    assert {name: entry["rows"] for name, entry in manifest["tables"].items()} == counts
    nulls = analysis.jobs()["null_counts_orders"]().first()
    orders = manifest["tables"]["orders"]["nulls"]
    assert (nulls.null_status, nulls.null_delivery_date) == (orders["order_status"], orders["order_delivered_customer_date"])


def test_publishing_scans_a_table_once(spark, tmp_path):
    spark.sparkContext.setJobGroup("publish", "publish")
    reads = spark.sparkContext.accumulator(0)
    source = spark.range(1000, numPartitions=2).rdd.map(lambda r: (reads.add(1), (r.id,))[1])
    manifest = publish_tables(spark, {"t": spark.createDataFrame(source, "id long")}, str(tmp_path / "published"))
    assert manifest["tables"]["t"]["rows"] == 1000 and reads.value == 1000
    assert json.loads(manifest["tables"]["t"]["schema"])["fields"][0]["name"] == "id"


def test_a_view_keeps_its_text_until_it_is_dropped(spark):
    register_tables(sample_tables(spark, DIRECTORY), prefix="v_")
    drop_view(spark, "orders_clean", "v_")
    create_view(spark, "orders_clean", 1, "v_", DELIVERED)
    first = spark.table("v_orders_clean")
    with pytest.raises(ValueError, match="drop it first"):
        create_view(spark, "orders_clean", 2, "v_", DELIVERED)
    drop_view(spark, "orders_clean", "v_")
    create_view(spark, "orders_clean", None, "v_", DELIVERED)
    second = spark.table("v_orders_clean")
    analysis = sample_analysis(spark, DIRECTORY)
    assert sorted(first.collect()) == sorted(analysis.all_delivered.collect())
    assert sorted(second.collect()) == sorted(analysis.clean.collect())
    assert first.exceptAll(second).count() == first.count() - second.count()
    create_view(spark, "reviews_deduped", prefix="v_")
    assert spark.table("v_reviews_deduped").count() == analysis.scores.count()
    with pytest.raises(ValueError, match="no version 3"):
        view_text("orders_clean", 3)


def test_reports_from_shared_counts_equal_the_single_jobs(spark):
    analysis = sample_analysis(spark, DIRECTORY)
    jobs, counted = analysis.jobs(), analysis.counted_reports()
    assert len(set(counted) & set(EXPORTED)) == 5
    for name, report in counted.items():
        assert report().collect() == jobs[name]().collect(), name
        assert report().dtypes == jobs[name]().dtypes, name


def test_stored_facts_are_counted_once(spark):
    stored = sample_analysis(spark, DIRECTORY).stored()
    try:
        reports = stored.counted_reports()
        for name in ("headline_kpis", "score_vs_delay"):
            plan = reports[name]()._jdf.queryExecution().optimizedPlan().toString()
            assert "satisfaction-counts" in str(reports[name]().inputFiles()), plan
        assert len(stored.folders) == 3
    finally:
        stored.close()
