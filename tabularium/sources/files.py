"""CSV, JSON, text and binary files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tabularium.operators import filters, stats

# Lines looked at, header candidates among them, longest header cell, weights of the two scores.
SCAN_LINES, CANDIDATES, HEADER_CHARS = 30, 10, 60
HEADER_WEIGHT, BELOW_WEIGHT = 0.6, 0.4


def read_csv(spark: SparkSession, path: str, schema=None, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Typed CSV. Give a schema for large files; without one Spark reads the data once more to infer it."""
    reader = spark.read.option("header", header).option("encoding", encoding).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_text(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Every column as text. Without an encoding, each cell is UTF-8 if its bytes are, and Latin-1 otherwise.

    The file is read once, as Latin-1, which keeps every byte; cells that are UTF-8 are then decoded as such.
    """
    df = spark.read.option("header", True).option("encoding", encoding or "ISO-8859-1").option("escape", '"').csv(path)
    if encoding:
        return df
    return df.select(*[utf8_or_latin(F.col(f"`{c}`")).alias(_utf8_name(c)) for c in df.columns])


def utf8_or_latin(c: Column) -> Column:
    """Text that was read as Latin-1, decoded as UTF-8 where its bytes allow it."""
    return F.coalesce(F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string")), c)


def _utf8_name(name: str) -> str:
    try:
        return name.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return name


def _outside_quotes(line: Column) -> Column:
    return F.regexp_replace(line, '"([^"]|"")*"', "")


def header_line(spark: SparkSession, lines: list[str]) -> tuple[int, list[str]]:
    """Place and cells of the line that most looks like a header.

    A candidate's score weighs its share of short cells that are no numbers with how well the lines below are filled, both
    over the widest line; the earliest of the best wins. A few lines go in, one row comes out.
    """
    head = spark.createDataFrame(list(enumerate(lines[:SCAN_LINES])), "at int, line string")
    widths = head.select("*", F.size(F.split(_outside_quotes(F.col("line")), ",")).alias("cells"))
    width = widths.agg(F.max("cells")).first()[0] or 1
    fields = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)), {"escape": '"'})
    filled = F.filter(F.array(*[F.col("r")[f"c{i}"] for i in range(width)]), lambda c: F.length(c) > 0)
    name = lambda c: F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double").isNull() & (F.length(c) <= HEADER_CHARS)
    scored = widths.withColumn("r", fields).select(
        "at", "r", F.size(filled).alias("full"), F.size(F.filter(filled, name)).alias("names"))
    below = W.orderBy("at").rowsBetween(1, W.unboundedFollowing)  # SCAN_LINES rows
    share = F.coalesce(F.sum("full").over(below) / (F.count("full").over(below) * width), F.lit(0.0))
    ranked = scored.withColumn("score", HEADER_WEIGHT * F.col("names") / width + BELOW_WEIGHT * share)
    best = ranked.filter((F.col("full") > 0) & (F.col("at") < CANDIDATES)).orderBy(F.desc("score"), "at").first()
    if best is None:
        return 0, []
    cells = [best["r"][f"c{i}"] for i in range(width)]
    return best["at"], cells


def read_csv_with_preamble(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Text CSV whose header may follow some junk lines in the first file (by name).

    Thirty lines are looked at to find the header; everything above it is dropped by its place in the first file. Lines are
    parsed where they are read, and a quoted line break raises an error; with ``multi_line`` files are read whole, one
    task each, and quoted line breaks are kept.
    """
    in_order = sorted(spark.read.text(path).inputFiles())
    first, head = in_order[0].rsplit("/", 1)[-1], []
    for name in in_order[:SCAN_LINES]:
        head += [r["value"] for r in spark.read.text(name).limit(SCAN_LINES - len(head)).collect()]
        if len(head) == SCAN_LINES:
            break
    at, cells = header_line(spark, head)
    names = [(c or "").strip().replace("`", "") or f"Unnamed: {i}" for i, c in enumerate(cells)]
    schema = ", ".join(f"`{n}` string" for n in names)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    marks = [(F.col("_metadata.file_name") == first).alias("_first"), F.col("_metadata.file_block_start").alias("_start"), place.alias("_place")]
    if multi_line:
        rows = (spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path).select("*", *marks))
        return _below_header(rows, at).select(*[f"`{n}`" for n in names])
    lines = _below_header(spark.read.text(path).select("value", *marks), at).filter(F.length("value") > 0)
    whole = F.assert_true(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 0,
                          "a quoted line break: read the file with multi_line=True")
    parsed = lines.select(F.when(whole.isNull(), F.from_csv("value", schema, {"escape": '"'})).alias("r"))
    return parsed.select("r.*")


def _below_header(rows: DataFrame, at: int) -> DataFrame:
    """Drop the rows up to the header: the smallest places of the first file's first block."""
    block = F.col("_first") & (F.col("_start") == 0)
    start = rows.filter(block).agg(F.min("_place")).scalar()
    return rows.filter(~block | (F.col("_place") - start > at))


def sanitise(df: DataFrame) -> DataFrame:
    """Stripped names and cells, no empty or ``Unnamed`` columns, empty text as null."""
    names = [c.strip() for c in df.columns]
    df = df.toDF(*names)
    df = df.drop(*[c for c in names if not c or c.startswith("Unnamed")])
    text = stats.string_columns(df)
    return df.withColumns({c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in text}) if text else df


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """The cleaning input: text CSV with header search, sanitised, footer rows dropped."""
    return filters.sparse_rows_dropped(sanitise(read_csv_with_preamble(spark, path)))


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def read_json_rows(spark: SparkSession, path: str, field: str | None = None, multi_line: bool = False) -> DataFrame:
    """A file of objects as it is, or the rows of the (first) list field inside each object."""
    df = spark.read.option("multiLine", multi_line).json(path)
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    field = field or (lists[0] if lists else None)
    return df.select(F.explode(F.col(f"`{field}`")).alias("_r")).select("_r.*") if field else df


def capped(df: DataFrame, order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows in the order of ``order`` for a preview store, each with how many rows there are in all
    (total_rows), how many were kept (row_count_stored) and whether that is fewer (truncated)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(cap).withColumns({
        "total_rows": total, "row_count_stored": F.least(total, F.lit(cap)).cast("bigint"), "truncated": total > cap})


def list_tables(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """Names of the tables (files or folders ending in ``suffix``) of a folder, in the folder's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    return sorted(n.removesuffix(suffix) for n in names if n.endswith(suffix))


def export_values(df: DataFrame) -> DataFrame:
    """NaN as null and moments as ISO text, ready for JSON."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.date_format(c, "yyyy-MM-dd")
    return df.withColumns(out) if out else df


def line_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"))


# First bytes of spreadsheet files.
ZIP_MAGIC, OLE_MAGIC = "504B0304", "D0CF11E0"


def content_kinds(spark: SparkSession, path: str) -> DataFrame:
    """``(path, kind, looks_safe)`` per file, from its extension and first bytes.

    A CSV must not hold a NUL in its first 8 bytes; a spreadsheet must start with its format's magic number. The
    listing reads no content; tasks then read 8 bytes per file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")

    def first_bytes(batches):
        from pyarrow import fs
        for pdf in batches:
            heads = []
            for uri in pdf["path"]:
                place, name = fs.FileSystem.from_uri(uri)
                with place.open_input_file(name) as f:
                    heads.append(f.read(8).hex().upper())
            yield pdf.assign(head=heads)

    files = listed.mapInPandas(first_bytes, "path string, head string")
    head, kind = F.col("head"), F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1)
    safe = (F.when(kind == "csv", ~F.rlike(head, F.lit("^(..)*00"))).when(kind == "xlsx", F.startswith(head, F.lit(ZIP_MAGIC)))
            .when(kind == "xls", F.startswith(head, F.lit(OLE_MAGIC))).otherwise(F.lit(False)))
    return files.select("path", kind.alias("kind"), safe.alias("looks_safe"))
