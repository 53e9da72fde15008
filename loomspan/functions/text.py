"""Words of text columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words_on_space(text: Column) -> Column:
    """The non-empty parts between single spaces (other white space stays in the words)."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def words_on_space_or_line(text: Column) -> Column:
    """`words_on_space` of all lines of a text at once."""
    return F.filter(F.split(text, "[ \n]"), lambda w: w != "")


def words_on_white_space(text: Column) -> Column:
    """The non-empty parts between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def lines_of(df: DataFrame, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """A row for each line of a text column, blank ones too: `keep`, line_no (from 0), value."""
    return df.select(*(keep or []), F.posexplode(F.split(text_col, "\n")).alias("line_no", "value"))


def starts_with_name(option: Column, name: str, assign: str = "=") -> Column:
    """Whether an option text begins with a name and its assignment symbol."""
    return F.startswith(option, F.lit(name + assign))
