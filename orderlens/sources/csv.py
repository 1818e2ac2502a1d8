"""CSV in and out, RFC 4180 style: quoted cells may hold newlines, ``""`` is a quote.

Both ways stay in the JVM: reading and writing are built-in expressions.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.sources.catalog import Tables
from orderlens.sources.schemas import TABLE_SCHEMAS, TABLES_WITH_NEWLINES

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def _read_options(blank: str) -> dict[str, str]:
    """``blank`` stands for a quoted empty cell while reading, since Spark would make it NULL."""
    return {
        "quote": '"',
        "escape": '"',
        "nullValue": "",
        "emptyValue": blank,
        "timestampNTZFormat": TIMESTAMP_FORMAT,
        "mode": "FAILFAST",
    }


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    multiline: bool = False,
    corrupt_column: str | None = None,
) -> DataFrame:
    """A CSV file or folder with headers. ``""`` is empty text, an empty cell is NULL.

    Columns are found by their names in the header, whatever their order; capitals
    don't matter. A header with unknown, missing or repeated names is an error. All
    files of a folder need one header; another one is an error that names the file.

    A malformed row is an error too, unless ``corrupt_column`` is given: then such a
    row's cells are what could be read of it, and this last column holds its text. All
    cells are then read whatever columns are used, so that the same rows are malformed
    in every query; such files are read as ``multiline`` ones are.

    Set ``multiline`` when cells hold newlines, as review comments do; such files are
    split by size all the same, even inside a cell. Lines may end in LF, CRLF or CR. A
    quote opens a cell only at its start.
    """
    # Spark's CSV source would parse, and so check, only the columns that a query uses.
    multiline = multiline or corrupt_column is not None
    wanted = spark.createDataFrame([], schema).schema
    in_file = T.StructType([wanted[name] for name in _header_order(spark, path, wanted, multiline)])
    names = list(in_file.names)
    blank = f"blank-{uuid.uuid4().hex}"
    options = _read_options(blank)
    if multiline:
        bad = corrupt_column or f"bad-{uuid.uuid4().hex}"
        in_file = T.StructType([*in_file.fields, T.StructField(bad, T.StringType())])
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    if multiline:
        parsed = F.from_csv("record", in_file.toDDL(), {**options, "multiLine": "true"}).alias("parsed")
        df = _records(spark, path, names).select("file", parsed)
        if corrupt_column is None:
            error = F.concat(F.lit("Malformed records in "), "file", F.lit(": "), F.col("parsed")[bad])
            df = df.where(F.when(F.col("parsed")[bad].isNull(), True).otherwise(F.raise_error(error).cast("boolean")))
        df = df.select("parsed.*")
    else:
        df = spark.read.schema(in_file).options(**options, header=True, enforceSchema=False).csv(path)
    texts = {f.name for f in wanted.fields if isinstance(f.dataType, T.StringType)}

    def cell(name: str) -> Column:
        column = F.col(f"`{name}`")
        return (F.when(column == blank, "").otherwise(column) if name in texts else column).alias(name)

    return df.select(*[cell(name) for name in wanted.names], *([corrupt_column] if corrupt_column else []))


def _header_order(spark: SparkSession, path: str, wanted: T.StructType, multiline: bool) -> list[str]:
    """The names of the schema in the order of one file's header. Only its first record is read."""
    header = spark.read.options(quote='"', escape='"', header=True, multiLine=multiline).csv(path).columns
    by_name = {name.lower(): name for name in wanted.names}
    found = [name.lower() for name in header]
    if header and sorted(found) != sorted(by_name):
        unknown = [name for name in header if name.lower() not in by_name]
        missing = [name for key, name in by_name.items() if key not in found]
        raise ValueError(f"header of {path}: unknown columns {unknown}, missing columns {missing}")
    return [by_name[name] for name in found] or list(wanted.names)


# What is left of a quoted cell up to its closing quote, a cell, and cells of one record. Nothing is tried twice.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_CELL = rf'(?:"{_QUOTED}"[^,\r\n]*+|(?!")[^,\r\n]*+)'
_CELLS = rf"{_CELL}(?:,{_CELL})*+"
# Text that ends inside a cell: begun outside of one, and begun inside.
_OPENS = rf'\A(?:{_CELL}[,\r\n])*+"{_QUOTED}\z'
_STAYS = rf'\A{_QUOTED}(?:\z|"[^,\r\n]*+[,\r\n](?:{_CELL}[,\r\n])*+"{_QUOTED}\z)'
# Begun inside: the rest of that record, if it ends. Begun outside: whole records.
_REST = rf'\A{_QUOTED}"[^,\r\n]*+(?:,{_CELL})*+(?=[\r\n]|\z)'
_RESTARTS = rf'\A{_QUOTED}"[^,\r\n]*+(?:,{_CELL})*+[\r\n]'
_RECORD = rf"\G[\r\n]*+({_CELLS})(?=[\r\n]|\z)"
_RECORDS = rf"\A(?:{_CELLS}[\r\n]++)*+"

_LINES_A_CHUNK_LOG2 = 8
_BLOCK = ["file", "block"]
_CHUNK = [*_BLOCK, "chunk"]


def _records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Records of CSV files but their headers, one text each, line ends inside cells as they are.

    A file is read in blocks, and the lines of a block are put together to chunks of
    256 lines, the only shuffle of the whole text. Patterns tell of each chunk whether
    it ends inside a cell, begun outside one and begun inside one. Running over these
    answers, first in each block and then over the blocks of a file, tells how each
    chunk really begins; those rows are narrow. Then patterns cut the chunks into
    records. A record that crosses a border of chunks is put together from the tail of
    one and the beginnings of those behind it. No window holds any text.
    """
    line = F.monotonically_increasing_id()
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.shiftright(line, _LINES_A_CHUNK_LOG2).alias("chunk"),
        F.struct(line.alias("line"), "value").alias("line"),
    )
    # Both uses below read both columns, so one scan and one exchange serve them.
    chunks = lines.groupBy(*_CHUNK).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    chunks = chunks.select(*_CHUNK, F.array_join("lines.value", "\n").alias("text"))
    begun = chunks.join(_chunk_begins(chunks), _CHUNK)

    goes_through = F.col("begins_inside") & F.col("ends_inside") & ~F.col("leaves_open")
    rest = F.when(goes_through, F.col("text")).when(F.col("begins_inside"), F.regexp_extract("text", _REST, 0))
    behind = F.expr("substring(text, coalesce(length(rest), 0) + 1)")
    cut = begun.withColumn("rest", rest).withColumn("text", F.regexp_replace(behind, r"\A[\r\n]++", ""))
    whole = cut.select(
        "file", "has_header", F.posexplode(F.regexp_extract_all("text", F.lit(_RECORD), 1)).alias("number", "record")
    ).select("file", (F.col("has_header") & (F.col("number") == 0)).alias("header"), "record")

    # A rest belongs to the record opened last, a tail is the beginning of the next one.
    tail = F.regexp_replace("text", _RECORDS, "")
    no_header = F.lit(False).alias("header")
    rest_of_record = F.struct(F.col("opened_before").alias("opened"), no_header, F.col("rest").alias("record"))
    beginning = F.struct(
        (F.col("opened_before") + 1).alias("opened"), (F.col("has_header") & (tail == F.col("text"))).alias("header"), tail.alias("record")
    )
    ends = F.array(F.when(F.col("begins_inside"), rest_of_record), F.when(F.col("leaves_open"), beginning))
    joined = (
        cut.where("begins_inside OR leaves_open")
        .select(*_CHUNK, F.inline(F.array_compact(ends)))
        .groupBy("file", "opened")
        .agg(F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("block", "chunk", "record"))).alias("parts"))
        .select("file", "header", F.rtrim(F.array_join("parts.record", "\n"), F.lit("\r")).alias("record"))
    )
    both = whole.unionByName(joined).where("record <> ''")

    cells = F.from_csv("record", ", ".join(f"_{i} STRING" for i in range(len(names))), {"quote": '"', "escape": '"', "multiLine": "true"})
    header = F.transform(F.array(*[cells[f"_{i}"] for i in range(len(names))]), F.lower)
    expected = F.array(*[F.lit(name.lower()) for name in names])
    error = F.concat(F.lit(f"The header differs from {', '.join(names)} in "), "file", F.lit(": "), "record")
    agrees = F.when(header == expected, False).otherwise(F.raise_error(error).cast("boolean"))
    return both.where(F.when(F.col("header"), agrees).otherwise(True)).select("file", "record")


def _tracked(df: DataFrame, order: Window) -> DataFrame:
    """Adds what the rows before each say about whether it begins inside a cell, for ``_begins``.

    A row sets how it ends (``outside`` equals ``inside``), or passes on how it begins,
    or turns it round. So a row begins as the last setting row said, turned as often as
    rows have since.
    """
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = F.sum((F.col("outside") & ~F.col("inside")).cast("long")).over(through)
    sets = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("ends"), "turned"))
    return df.withColumn("turned", turned).withColumns(
        {
            "last_set": F.last(sets, ignorenulls=True).over(before),
            "turned": F.coalesce(F.last("turned").over(before), F.lit(0)),
        }
    )


def _begins(initial: Column) -> Column:
    """Whether a tracked row begins inside a cell, if the first one begins as ``initial`` says."""
    odd = (F.col("turned") - F.coalesce(F.col("last_set")["turned"], F.lit(0))) % 2 == 1
    return F.coalesce(F.col("last_set")["ends"], initial) != odd


def _ends(begins: str) -> Column:
    return F.when(F.col(begins), F.col("inside")).otherwise(F.col("outside"))


def _opens(begins: str) -> Column:
    """Whether a record that starts in the chunk goes on behind it."""
    return _ends(begins) & (~F.col(begins) | F.col("restarts"))


def _chunk_begins(chunks: DataFrame) -> DataFrame:
    """Per chunk, without its text: how it begins and ends, records left open before it, whether the header starts in it."""
    in_block = Window.partitionBy(*_BLOCK).orderBy("chunk")
    all_of_block = in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    quoted = F.col("text").contains('"')
    answers = chunks.select(
        *_CHUNK,
        (quoted & F.col("text").rlike(_OPENS)).alias("outside"),
        (~quoted | F.col("text").rlike(_STAYS)).alias("inside"),
        (quoted & F.col("text").rlike(_RESTARTS)).alias("restarts"),
        F.col("text").rlike(r"[^\r\n]").alias("has_text"),
    )
    tracked = _tracked(answers, in_block).withColumn(
        "first_text", F.min(F.when(F.col("has_text"), F.col("chunk"))).over(all_of_block)
    )
    blocks = (
        tracked.withColumns({"if_outside": _begins(F.lit(False)), "if_inside": _begins(F.lit(True))})
        .groupBy(*_BLOCK)
        .agg(
            F.max_by(_ends("if_outside"), "chunk").alias("outside"),
            F.max_by(_ends("if_inside"), "chunk").alias("inside"),
            F.sum(_opens("if_outside").cast("long")).alias("opens_if_outside"),
            F.sum(_opens("if_inside").cast("long")).alias("opens_if_inside"),
            F.max("first_text").alias("text_in_block"),
        )
    )
    in_file = Window.partitionBy("file").orderBy("block")
    all_of_file = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opens = F.when(F.col("block_inside"), F.col("opens_if_inside")).otherwise(F.col("opens_if_outside"))
    unterminated = F.concat(F.lit("A quoted cell does not end in "), "file")
    first_with_text = F.min(F.when(F.col("text_in_block").isNotNull(), F.col("block"))).over(all_of_file)
    block_begins = (
        _tracked(blocks, in_file)
        .withColumn("block_inside", _begins(F.lit(False)))
        .withColumn("file_inside", F.last(_ends("block_inside")).over(all_of_file))
        .select(
            *_BLOCK,
            F.when(F.col("file_inside"), F.raise_error(unterminated).cast("boolean"))
            .otherwise(F.col("block_inside"))
            .alias("block_inside"),
            _before(opens, in_file).alias("opened_before_block"),
            (first_with_text == F.col("block")).alias("has_first_text"),
        )
    )
    return (
        tracked.join(block_begins, _BLOCK)
        .withColumn("begins_inside", _begins(F.col("block_inside")))
        .withColumns({"ends_inside": _ends("begins_inside"), "leaves_open": _opens("begins_inside")})
        .select(
            *_CHUNK,
            "begins_inside",
            "ends_inside",
            "leaves_open",
            (F.col("opened_before_block") + _before(F.col("leaves_open").cast("long"), in_block)).alias("opened_before"),
            F.coalesce(F.col("has_first_text") & (F.col("first_text") == F.col("chunk")), F.lit(False)).alias("has_header"),
        )
    )


def _before(amount: Column, order: Window) -> Column:
    """The sum of an amount over the rows before each."""
    return F.coalesce(F.sum(amount).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def read_csv_tables(spark: SparkSession, paths: Mapping[str, str]) -> Tables:
    """The tables of ``TABLE_SCHEMAS`` that have a path, each read on first use."""
    return Tables(
        {
            name: partial(
                read_csv_table, spark, path, TABLE_SCHEMAS[name], multiline=name in TABLES_WITH_NEWLINES
            )
            for name, path in paths.items()
        }
    )


_WRITE_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "emptyValue": '""',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": TIMESTAMP_FORMAT,
}

# The bits of a monotonically increasing id that count the rows of one partition.
_ROWS_OF_PARTITION = (1 << 33) - 1


def write_csv(df: DataFrame, path: str, line_end: str = "\n") -> None:
    """Write with a header, one file per partition, such that ``read_csv_table`` restores it.

    Spark's CSV sink turns line feeds inside cells into the line end. So for any other
    line end ``to_csv`` makes the records and the text sink writes them (as ``.txt``);
    the first record of a file carries the header, and a table without rows becomes
    one file with the header only. A row of one NULL cell alone is an empty line,
    which readers skip.
    """
    if line_end == "\n":
        df.write.options(**_WRITE_OPTIONS, header=True, lineSep=line_end).csv(path)
        return
    names = [F.lit(name).alias(f"_{i}") for i, name in enumerate(df.columns)]
    header = df.sparkSession.range(1).coalesce(1).select(F.to_csv(F.struct(*names), _WRITE_OPTIONS).alias("header"))
    first = header.first()["header"] + line_end
    records = df.select(
        F.to_csv(F.struct(*[F.col(f"`{name}`") for name in df.columns]), _WRITE_OPTIONS).alias("record"),
        (F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS_OF_PARTITION)) == 0).alias("first"),
    )
    written = Observation()
    lines = records.select(
        F.when(F.col("first"), F.concat(F.lit(first), "record")).otherwise(F.col("record")).alias("line")
    ).observe(written, F.count(F.lit(1)).alias("rows"))
    options = {"lineSep": line_end, "maxRecordsPerFile": 0}
    lines.write.options(**options).text(path)
    if written.get["rows"] == 0:
        header.write.options(**options).mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Write a report as one CSV file in a new folder.

    For aggregated results only (a row per bucket, score, segment or category, or
    a top list): one task writes them. Use ``write_csv`` for anything longer.
    """
    write_csv(df.coalesce(1), path)
