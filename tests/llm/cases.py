"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards quietly mix strange potions behind old stone "
    "walls near the river and nobody in town ever asks what the green smoke above the chimney might mean for them"
)
WORDS = PROSE.split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows() -> list[tuple]:
    near = " ".join([*WORDS[:-1], "us"])
    long_text = " ".join(f"{w}{i}" for i in range(3000) for w in ("lorem", "ipsum", "dolor"))
    texts = [
        PROSE,
        PROSE.replace(" ", "\n \t", 3),  # equal after white space is folded
        near,  # a near copy
        None,
        "",
        " \n\t ",
        "word",
        "word",
        "ab " * 30000,  # long, repeated words
        long_text,
        "日本語のテキスト 👍🏽 naïve ﬁ\u0000x",
        "Released under the MIT License.",
    ]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[6], (None, PROSE, "en", "s1", 1), (None, "no id", None, None, None)]


def edge_table(spark, extra: bool = True):
    """The rows, with extra columns named like those that operators make."""
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    if not extra:
        return df
    clashing = "id norm hash size kept keep_id ids bytes measured score copies slot shard block node root span gone"
    return df.selectExpr("*", *[f"'x' AS `{name}`" for name in clashing.split()])


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)
