"""Text to number, boolean and timestamp, null where the text does not fit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A plain decimal number; Spark's own cast would also take suffixes such as 1d or 5f.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# Accepted boolean words.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")

# Accepted date layouts, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy")
DATE_FORMATS_SQL = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%m/%d/%Y', '%d-%m-%Y']"


def is_number(c: Column, commas: bool = False) -> Column:
    text = F.trim(c)
    return F.rlike(F.replace(text, F.lit(","), F.lit("")) if commas else text, F.lit(NUMBER))


def to_number(c: Column) -> Column:
    return F.when(is_number(c), F.trim(c).cast("double"))


def to_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_datetime(c: Column) -> Column:
    """First layout that fits, as a zone-free timestamp. The layouts differ in shape, so one regexp picks the one
    parse that can succeed instead of trying all of them on every row."""
    text = F.trim(c)
    shapes = {
        "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
        "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
        "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
        "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
        "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    }
    picked = None
    for layout in DATE_FORMATS:
        test, parse = F.rlike(text, F.lit(shapes[layout])), F.try_to_timestamp(text, F.lit(layout))
        picked = F.when(test, parse) if picked is None else picked.when(test, parse)
    return picked.cast("timestamp_ntz")
