"""The five cleaning steps with preview, apply and lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F

from tabularium.operators import clean, features, stats
from tabularium.session import scratch_path

# The steps in order.
STEPS = ("null_values", "duplicates", "data_types", "outliers", "feature_engineering")


def _suggested(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    specs = features.suggest(df)
    return features.derive_all(df, specs), {s["col"]: s["operation"] for s in specs}


# Every automatic step returns the changed frame and what it decided per column. Versions are written, so quantiles read them
# without a copy, and repeats are found by fingerprints.
AUTOMATIC: dict[str, Callable[[DataFrame], tuple[DataFrame, dict[str, str]]]] = {
    "null_values": lambda df: clean.auto_fill(df, stage=False),
    "duplicates": lambda df: (stats.distinct_rows(df), {"strategy": "Keep first"}),
    "data_types": clean.auto_cast,
    "outliers": lambda df: clean.auto_cap(df, stage=False),
    "feature_engineering": _suggested,
}

_FILLS = {"Fill with 0": "zero", "Fill with mean": "mean", "Fill with median": "median", "Fill with mode": "mode",
          "Drop rows": "drop", "Fill with empty string": "empty"}
_KEEPS = {"Keep first": "first", "Keep last": "last", "Drop all": "none"}
_OUTLIERS = {"Remove rows": "remove", "IQR capping": "iqr", "Z-score capping": "zscore"}


def manual(df: DataFrame, step: str, params: dict) -> DataFrame:
    """One step with the user's choices; choices for unknown columns are ignored."""
    if step == "null_values":
        for column, choice in params.items():
            if column in df.columns:
                df = clean.fill(df, column, _FILLS[choice])
        return df
    if step == "duplicates":
        keep = _KEEPS[params.get("strategy", "Keep first")]
        return clean.dedup(df, keep) if keep == "none" else stats.distinct_rows(df)
    if step == "data_types":
        return clean.cast_columns(df, params)
    if step == "outliers":
        numeric = stats.numeric_columns(df)
        return clean.outliers_in_turn(df, {c: _OUTLIERS[p] for c, p in params.items() if c in numeric})
    if step == "feature_engineering":
        return features.derive_all(df, params["features"])
    raise ValueError(f"unknown step: {step}")


class Wizard:
    """Versioned states of one dataset. A preview is only a plan; apply writes the next version.

    Applying an earlier step again drops the later versions from the history. Every version is Parquet in the shared
    scratch folder, so later steps read typed columns and not a re-run of the earlier steps.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.root = scratch_path(self.spark, "wizard")
        self.history: list[tuple[str, str, str, dict]] = []  # (step, mode, path, decisions)
        self.facts: dict[str, tuple[int, int, int]] = {}  # rows, nulls and columns of each version, counted while writing
        self._written = 0
        self._write("initial", "raw", df, {})

    def _write(self, step: str, mode: str, df: DataFrame, decisions: dict):
        path = f"{self.root}/v={self._written}"
        facts = Observation()
        empty = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
        df.observe(facts, F.count(F.lit(1)).alias("rows"), F.sum(empty).alias("nulls")).write.option("compression", "zstd").parquet(path)
        self._written += 1
        self.history.append((step, mode, path, decisions))
        self.facts[path] = (facts.get["rows"], facts.get["nulls"] or 0, len(df.columns))

    def _before(self, step: str) -> int:
        done = [entry[0] for entry in self.history]
        return done.index(step) if step in done else len(done)

    def _change(self, step: str, params: dict | None) -> tuple[DataFrame, dict]:
        base = self.spark.read.parquet(self.history[self._before(step) - 1][2])
        if params is None:
            return AUTOMATIC[step](base)
        said = {f["col"]: f["operation"] for f in params["features"]} if step == "feature_engineering" else params
        return manual(base, step, params), said

    @property
    def current(self) -> DataFrame:
        return self.spark.read.parquet(self.history[-1][2])

    def preview(self, step: str, params: dict | None = None) -> DataFrame:
        return self._change(step, params)[0]

    def apply(self, step: str, params: dict | None = None) -> DataFrame:
        changed, decisions = self._change(step, params)
        del self.history[self._before(step):]
        self._write(step, "auto" if params is None else "manual", changed, decisions)
        return self.current

    def finalize(self, path: str) -> None:
        self.current.write.mode("overwrite").parquet(path)

    def lineage(self, copies: bool = False) -> DataFrame:
        """One row per applied step: mode, decisions, and rows, cols and nulls before and after.

        ``copies`` adds the number of repeated rows, which costs one grouping of the rows' fingerprints per version.
        """
        out = None
        for i, (step, mode, path, decisions) in enumerate(self.history):
            said = ", ".join(f"{c}: {d}" for c, d in sorted(decisions.items()))
            rows, nulls, cols = self.facts[path]
            one = self.spark.range(1).select(
                F.lit(i).alias("position"), F.lit(step).alias("step"), F.lit(mode).alias("mode"), F.lit(said).alias("decisions"),
                F.lit(rows).cast("bigint").alias("rows"), F.lit(cols).alias("cols"), F.lit(nulls).cast("bigint").alias("nulls"),
                *([stats.duplicate_count(self.spark.read.parquet(path)).alias("copies")] if copies else []))
            out = one if out is None else out.unionByName(one)
        counted = ["rows", "cols", "nulls", *(["copies"] if copies else [])]
        before = out.select((F.col("position") + 1).alias("position"), *[F.col(c).alias(f"{c}_before") for c in counted])
        return out.withColumnsRenamed({c: f"{c}_after" for c in counted}).join(before, "position")


def report(lineage: DataFrame, capped: int, converted: int) -> DataFrame:
    """``(category, n, action)``: what cleaning changed; categories without a change are left out."""
    # The sentences.
    lost = lambda step, before, after: F.sum(F.when(F.col("step") == step, F.col(before) - F.col(after)).otherwise(0))
    one = lineage.agg(lost("null_values", "nulls_before", "nulls_after").alias("nulls"),
                      lost("duplicates", "rows_before", "rows_after").alias("copies"))
    rows = [("Missing Values", F.col("nulls"), "Filled using MEAN/MEDIAN/MODE"), ("Duplicates", F.col("copies"), "Removed duplicate rows"),
            ("Outliers", F.lit(capped).cast("bigint"), "Removed / capped using IQR method"),
            ("Data Types", F.lit(converted).cast("bigint"), "Converted to standard format")]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), n.cast("bigint").alias("n"), F.lit(a).alias("action")) for c, n, a in rows])).alias("r")
    ).select("r.*").filter("n > 0")
