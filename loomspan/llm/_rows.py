"""Whole rows of any columns carried through joins: nested in one struct, so that no name of theirs can clash or needs quoting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name as an identifier, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def nested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`row, id, text`: each row as a struct, with its id and its text beside it."""
    return docs.select(F.struct("*").alias("row"), F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))


def opened(rows: DataFrame, columns: list[str], text_col: str | None = None, text: Column | None = None) -> DataFrame:
    """The columns of the struct `row`, with another text if one is given."""
    return rows.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns])
