import csv as python_csv
import io
import random
from pathlib import Path

import pytest

from orderlens.sources import csv
from orderlens.sources.catalog import new_folder, register_tables
from orderlens.sources.schemas import TABLE_SCHEMAS

REVIEW_FILE = '''"review_id","order_id","review_score","review_comment_title","review_comment_message","review_creation_date","review_answer_timestamp"
"r1","o1",4,"","First line
second line, with a ""quoted"" word

last line",2018-01-18 00:00:00,2018-01-18 21:46:59
"r2","o2",5,,,2018-03-10 00:00:00,2018-03-11 03:05:13
"r3","o3",1,"back\\slash","ends with a backslash \\",2018-03-10 00:00:00,
'''


def test_review_cells_with_newlines_quotes_and_blanks(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(REVIEW_FILE)
    df = csv.read_csv_tables(spark, {"reviews": str(path)})["reviews"]
    rows = {r["review_id"]: r for r in df.collect()}
    assert len(rows) == 3 and [rows[k]["review_score"] for k in sorted(rows)] == [4, 5, 1]
    assert rows["r1"]["review_comment_message"] == 'First line\nsecond line, with a "quoted" word\n\nlast line'
    assert rows["r1"]["review_comment_title"] == "" and rows["r2"]["review_comment_title"] is None
    assert rows["r2"]["review_comment_message"] is None
    assert rows["r3"]["review_comment_message"] == "ends with a backslash \\"
    assert str(rows["r1"]["review_answer_timestamp"]) == "2018-01-18 21:46:59"
    assert rows["r3"]["review_answer_timestamp"] is None


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_what_is_written_reads_back_the_same(spark, end):
    cells = ["", None, 'x "y", z', "two\nlines", "\\", '"', "  pad  ", " ", "\n", "x\r", "\r", "a\r\nb", "\u001a", ",", "''"]
    rows = [(f"k{i:02}", cell) for i, cell in enumerate(cells)]
    df = spark.createDataFrame(rows, "k string, v string")
    path = new_folder(spark, "test-csv")
    csv.write_csv(df, path, end)
    assert sorted(map(tuple, csv.read_csv_table(spark, path, df.schema, multiline=True).collect())) == rows


def test_line_feeds_in_cells_survive_every_line_end(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "a\rb"), (3, "a\r\nb")], "k int, v string").coalesce(1)
    for end in ("\n", "\r\n", "\r"):
        path = new_folder(spark, "test-csv")
        csv.write_csv(df, path, end)
        (file,) = [f for f in Path(path).iterdir() if f.name.startswith("part-")]
        assert file.read_bytes().decode() == end.join(["k,v", '1,"a\nb"', '2,"a\rb"', '3,"a\r\nb"', ""])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_table_without_rows_has_a_header(spark, end):
    df = spark.createDataFrame([], "k int, `a,b` string")
    path = new_folder(spark, "test-csv")
    csv.write_csv(df, path, end)
    (file,) = [f for f in Path(path).iterdir() if f.name.startswith("part-")]
    assert file.read_bytes().decode() == 'k,"a,b"' + end
    assert csv.read_csv_table(spark, path, df.schema, multiline=True).collect() == []


def test_malformed_row_is_an_error(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_text("k,n\na,1\nb,not a number\n")
    with pytest.raises(Exception, match="Malformed records"):
        csv.read_csv_table(spark, str(path), "k string, n int").collect()


def test_other_tables_are_split_by_size(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("order_id\n" + "".join(f"order-{i:08}\n" for i in range(200_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = csv.read_csv_table(spark, str(path), "order_id string")
        assert df.rdd.getNumPartitions() > 4
        assert df.distinct().count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_report_is_one_file_in_order(spark):
    df = spark.createDataFrame([(i % 3, str(i)) for i in range(30)], "a int, b string").orderBy("a", "b")
    path = new_folder(spark, "test-report")
    csv.write_report(df, path)
    (file,) = Path(path).glob("*.csv")
    with file.open() as lines:
        rows = list(python_csv.DictReader(lines))
    assert [(int(r["a"]), r["b"]) for r in rows] == [tuple(r) for r in df.collect()]


def test_schemas_parse_and_views_register(spark):
    tables = {name: spark.createDataFrame([], schema) for name, schema in TABLE_SCHEMAS.items()}
    assert len(tables) == 9
    register_tables(tables, prefix="t_")
    assert spark.table("t_orders").columns == tables["orders"].columns
    assert spark.sql("SELECT count(*) AS n FROM t_reviews").first()["n"] == 0


def awkward_cells(rng):
    """Cells of quotes, newlines and commas, so that blocks end in every possible place."""
    pieces = ["a", '"', "\n", ",", "word", "\n\n", '""', " ", "x\ny"]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))


@pytest.mark.parametrize("block_bytes", [11, 90])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_blocks_match_the_plain_parser(spark, tmp_path, block_bytes, end):
    rng = random.Random(block_bytes)
    rows = [(f"k{i}", awkward_cells(rng), rng.choice(["", "t"])) for i in range(14)]
    for part in range(2):
        with open(tmp_path / f"part-{part}.csv", "w", newline="") as file:
            writer = python_csv.writer(file, quoting=python_csv.QUOTE_ALL, lineterminator=end)
            writer.writerow(["k", "v", "w"])
            writer.writerows(rows[part::2])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    try:
        df = csv.read_csv_table(spark, str(tmp_path), "k string, v string, w string", True)
        assert sorted(map(tuple, df.collect())) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_assembled_records_are_typed_and_checked(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(REVIEW_FILE)
    split = csv.read_csv_table(spark, str(path), TABLE_SCHEMAS["reviews"], True)
    assert split.dtypes == spark.createDataFrame([], TABLE_SCHEMAS["reviews"]).dtypes
    assert [r["review_score"] for r in sorted(split.collect())] == [4, 5, 1]
    path.write_text('k,n\n"a",1\n"b",none\n')
    with pytest.raises(Exception, match="Malformed records"):
        csv.read_csv_table(spark, str(path), "k string, n int", True).collect()


def python_rows(text):
    """Records as Python's csv module reads them: no header, no blank lines."""
    rows = list(python_csv.reader(io.StringIO(text, newline="")))
    return [tuple(r) for r in rows if r][1:]


def random_cell(rng):
    pieces = ["a", "\n", ",", "word", "\n\n", " ", "x\ny", "\r\n", "\r", '"']
    cell = "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
    if rng.random() < 0.6:
        return '"' + cell.replace('"', '""') + '"'
    # An unquoted cell may hold quotes, but not at its start.
    return "u" + "".join(c for c in cell if c not in ",\n\r")


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("block_bytes", [7, 60, 100_000])
def test_any_file_in_any_blocks_matches_pythons_reader(spark, tmp_path, end, block_bytes):
    rng = random.Random(f"{end!r}{block_bytes}")
    texts = []
    for part in range(3):
        lead = end * rng.randrange(3)
        body = [",".join([f"k{part}-{i}", random_cell(rng), random_cell(rng)]) for i in range(25)]
        blank = [end if rng.random() < 0.1 else "" for _ in body]
        text = lead + "k,v,w" + end + "".join(line + end + extra for line, extra in zip(body, blank))
        texts.append(text if rng.random() < 0.5 else text.removesuffix(end))
        (tmp_path / f"part-{part}.csv").write_bytes(texts[-1].encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    try:
        df = csv.read_csv_table(spark, str(tmp_path), "k string, v string, w string", True)
        found = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # Spark trims nothing; only quoted empty cells are told apart from empty ones, which are NULL.
    assert [tuple(c or "" for c in row) for row in found] == sorted(r for t in texts for r in python_rows(t))


def test_both_readers_agree_where_cells_have_no_newlines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('\nk,v\na,1,5" screen\n'.replace("1,5", "15") + 'b,"x ""y"""\nc,""\nd,\n')
    plain = csv.read_csv_table(spark, str(tmp_path), "k string, v string")
    split = csv.read_csv_table(spark, str(tmp_path), "k string, v string", multiline=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))
    assert {r.k: r.v for r in split.collect()} == {"a": '15" screen', "b": 'x "y"', "c": "", "d": None}


def test_header_over_several_lines_and_blocks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('\n\n"k\nof\nrow","v"\na,1\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3")
    try:
        df = csv.read_csv_table(spark, str(tmp_path), "`k\nof\nrow` string, v int", multiline=True)
        assert [tuple(r) for r in df.collect()] == [("a", 1)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cell_without_end_is_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text('k,v\na,"1\nb,2\n')
    with pytest.raises(Exception, match="quoted cell does not end"):
        csv.read_csv_table(spark, str(tmp_path), "k string, v string", multiline=True).collect()


def test_reading_stays_in_the_jvm_and_shuffles_by_file_and_block(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n" + "".join(f'{i},"two\nlines"\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = csv.read_csv_table(spark, str(tmp_path), "k int, v string", multiline=True)
        assert len(df.collect()) == 3000
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = plan.split("== Initial Plan ==")[0]
    assert "Arrow" not in plan and "Python" not in plan
    assert all("file" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    # Lines are read and put together to chunks once; both uses share that.
    assert plan.count("FileScan text") == 1 and "ReusedExchange" in plan


def test_very_long_cells_and_lines(spark, tmp_path):
    cells = ['say ""no"", ' * 300_000, "line\n" * 100_000, "x" * 3_000_000]
    (tmp_path / "t.csv").write_text("k,v\n" + "".join(f'{i},"{cell}"\n' for i, cell in enumerate(cells)))
    df = csv.read_csv_table(spark, str(tmp_path), "k int, v string", multiline=True)
    assert {r.k: r.v for r in df.collect()} == {i: cell.replace('""', '"') for i, cell in enumerate(cells)}


@pytest.mark.parametrize("multiline", [False, True])
def test_columns_are_found_by_name(spark, tmp_path, multiline):
    (tmp_path / "t.csv").write_text("B,a\n1,x\n2,y\n")
    df = csv.read_csv_table(spark, str(tmp_path), "a string, b int", multiline=multiline)
    assert df.columns == ["a", "b"] and sorted(map(tuple, df.collect())) == [("x", 1), ("y", 2)]
    assert sorted(r.b for r in df.select("b").collect()) == [1, 2]


@pytest.mark.parametrize("multiline", [False, True])
@pytest.mark.parametrize("header", ["a,c", "a", "a,b,c", "a,a"])
def test_a_header_that_differs_from_the_schema_is_an_error(spark, tmp_path, multiline, header):
    (tmp_path / "t.csv").write_text(header + "\n" + ",".join("1" for _ in header.split(",")) + "\n")
    with pytest.raises(ValueError, match="columns"):
        csv.read_csv_table(spark, str(tmp_path), "a string, b int", multiline=multiline)


@pytest.mark.parametrize("multiline", [False, True])
@pytest.mark.parametrize("other", ["b,a", "a,c", "a,b,c", "a"])
def test_files_with_differing_headers_are_an_error_that_names_the_file(spark, tmp_path, multiline, other):
    (tmp_path / "one.csv").write_text("a,b\n" + "x,1\n" * 40)
    (tmp_path / "two.csv").write_text(other + "\n" + ",".join("1" for _ in other.split(",")) + "\n")
    with pytest.raises(Exception, match="two.csv"):
        csv.read_csv_table(spark, str(tmp_path), "a string, b int", multiline=multiline).collect()


@pytest.mark.parametrize("multiline", [False, True])
def test_a_byte_order_mark_is_not_part_of_the_first_name(spark, tmp_path, multiline):
    (tmp_path / "t.csv").write_bytes(b"\xef\xbb\xbf" + b"a,b\nx,1\n")
    df = csv.read_csv_table(spark, str(tmp_path), "a string, b int", multiline=multiline)
    assert [tuple(r) for r in df.collect()] == [("x", 1)]


@pytest.mark.parametrize("multiline", [False, True])
def test_malformed_rows_can_be_kept_aside(spark, tmp_path, multiline):
    (tmp_path / "t.csv").write_text("k,n\na,1\nb,none\nc,3,4\n")
    df = csv.read_csv_table(spark, str(tmp_path), "k string, n int", multiline, corrupt_column="_corrupt_record")
    rows = {r.k: (r.n, r._corrupt_record) for r in df.collect()}
    assert rows == {"a": (1, None), "b": (None, "b,none"), "c": (3, "c,3,4")}


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    class Session:
        def __init__(self, **settings):
            self.conf = {k.replace("_", "."): v for k, v in settings.items()}

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x", ""):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            new_folder(Session(spark_master=master), "x")
    assert "x-" in new_folder(Session(spark_master="local[4]"), "x")
    session = Session(spark_master="yarn")
    session.conf["spark.checkpoint.dir"] = "s3a://shared/"
    assert new_folder(session, "x").startswith("s3a://shared/x-")
