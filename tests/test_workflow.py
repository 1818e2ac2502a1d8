from pathlib import Path

from orderlens.plans.workflow import EXPORTED, Analysis, export_reports
from orderlens.sample.queries import PARAMETERS, sample_analysis
from orderlens.sample.tables import sample_tables
from orderlens.sources.csv import read_csv_table

DIRECTORY = "/root/testdata/sf0.001"


def test_ten_reports_are_exported(spark, tmp_path):
    analysis = sample_analysis(spark, DIRECTORY)
    paths = export_reports(analysis, str(tmp_path))
    assert [Path(path).name for path in paths] == list(EXPORTED) and len(EXPORTED) == 10
    for path in paths:
        report = analysis.jobs()[Path(path).name]()
        written = read_csv_table(spark, path, report.schema)
        assert sorted(map(str, written.collect())) == sorted(map(str, report.collect())), path


def test_every_job_gives_the_same_on_stored_facts(spark):
    analysis = sample_analysis(spark, DIRECTORY)
    stored = analysis.stored()
    plain, fast = analysis._reports(), stored._reports()
    for name in plain:
        columns = plain[name]().columns
        assert sorted(map(str, fast[name]().select(columns).collect())) == sorted(map(str, plain[name]().collect())), name
    shared = spark.conf.get("spark.checkpoint.dir")
    assert all(shared in file for file in stored.scored.inputFiles())


def test_fixes_leave_the_inputs_alone(spark):
    raw = sample_tables(spark, DIRECTORY)
    fixed = Analysis(raw, PARAMETERS).tables
    assert raw["products"].where("product_category_name = ''").count() > 0
    assert fixed["products"].where("product_category_name = ''").count() == 0
    assert fixed["category_translation"].count() == raw["category_translation"].count() + 2
    assert set(fixed) == set(raw)


def test_stored_folders_are_removed_after_the_export(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in shared.iterdir()} if shared.exists() else set()
    export_reports(sample_analysis(spark, DIRECTORY), str(tmp_path))
    assert {p.name for p in shared.iterdir()} == before
