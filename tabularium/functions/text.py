"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalise_name(c: Column) -> Column:
    """Lower case, trimmed, blanks and hyphens as underscores."""
    return F.translate(F.lower(F.trim(c)), " -", "__")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def sanitize_filename(c: Column) -> Column:
    """Safe file name: allowed characters, runs of dots and underscores collapsed, 30 characters, lower extension."""
    base = F.regexp_replace(c, r"^.*/", "")
    extension = F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))
    stem = F.when(extension != "", F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(c)
    stem = F.regexp_replace(stem, r"[^a-zA-Z0-9._-]", "_")
    stem = F.regexp_replace(F.regexp_replace(stem, r"\.+", "."), "_+", "_")
    stem = F.regexp_replace(F.substring(stem, 1, 30), r"[._]+$", "")
    stem = F.when(stem == "", "dataset").otherwise(stem)
    extension = F.when(extension == "", ".csv").otherwise(extension)
    return F.when(F.coalesce(c, F.lit("")) == "", "unnamed_dataset").otherwise(F.concat(stem, extension))


def mask_email(c: Column) -> Column:
    """Keep two characters of every mail address in the text."""
    return F.regexp_replace(c, r"([\w.-]{2})[\w.-]+@([\w.-]+)", "$1***@$2")


def tokens(c: Column) -> Column:
    """Lower-case alphanumeric words of at least two characters."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def user_label(c: Column) -> Column:
    """The part before the @."""
    return F.split_part(c, F.lit("@"), F.lit(1))


def initials(c: Column) -> Column:
    """First letters of the words, upper case."""
    return F.upper(F.array_join(F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.substring(w, 1, 1)), ""))


def _one_decimal(c: Column) -> Column:
    return F.round(c, 1).cast("decimal(20,1)").cast("string")


def format_size(byte_count: Column) -> Column:
    kb, mb = byte_count / F.lit(1024.0), byte_count / F.lit(1048576.0)
    return (F.when(F.coalesce(byte_count, F.lit(0)) == 0, "0 B")
            .when(mb >= 1, F.concat(_one_decimal(mb), F.lit(" MB")))
            .otherwise(F.concat(_one_decimal(kb), F.lit(" KB"))))


def format_duration(seconds: Column) -> Column:
    whole = lambda c: c.cast("bigint").cast("string")
    return (F.when(F.coalesce(seconds, F.lit(0)) == 0, "0s")
            .when(seconds < 60, F.concat(whole(seconds), F.lit("s")))
            .when(seconds < 3600, F.concat(whole(F.floor(seconds / 60)), F.lit("m "), whole(seconds % 60), F.lit("s")))
            .otherwise(F.concat(whole(F.floor(seconds / 3600)), F.lit("h "),
                                whole(F.floor(seconds % 3600 / 60)), F.lit("m"))))


UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def is_uuid(c: Column) -> Column:
    return F.rlike(c, F.lit(UUID))


# The words behind each intent.
DATA_WORDS = ("show", "list", "find", "get", "fetch", "count", "how many", "what is", "what are", "top", "bottom",
              "average", "avg", "sum", "total", "max", "min", "highest", "lowest", "filter", "where", "group", "rank",
              "compare", "between", "greater", "less", "equal", "select", "query", "rows", "records")
ANALYTICAL_WORDS = ("why", "reason", "cause", "because", "explain", "analyse", "analyze", "trend", "pattern",
                    "performance", "affect", "impact", "influence", "correlation", "relationship", "compared to",
                    "vs", "versus", "over time", "month", "year", "quarter", "dropped", "increased", "declined", "grew",
                    "insight", "unusual", "anomaly", "outlier", "distribution", "changed", "difference")
GENERAL_WORDS = ("how many columns", "how many rows", "what columns", "column names", "dataset", "schema", "structure",
                 "hello", "hi", "help", "what can you", "tell me about the dataset", "describe the dataset", "overview")


def word_pattern(words: tuple[str, ...]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def intent(c: Column) -> Column:
    """general, analytical, data_query or ambiguous. Any analytical word wins over data words."""
    q = F.lower(F.trim(c))
    has = lambda words: F.rlike(q, F.lit(word_pattern(words)))
    return (F.when((F.length(q) < 30) & has(GENERAL_WORDS), "general")
            .when(has(ANALYTICAL_WORDS), "analytical")
            .when(has(DATA_WORDS), "data_query")
            .otherwise("ambiguous"))
