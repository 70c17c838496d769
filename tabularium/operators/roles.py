"""Business roles of a table's columns: by name, by fuzzy name, by data shape, by fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabularium.operators import match, profile, stats

# Confidence of each way a role is found.
CONFIDENCE = {"dict": 1.00, "pattern": 0.60, "fallback_sales": 0.40, "fallback_date": 0.35}


def detect(df: DataFrame) -> DataFrame:
    """``(role, column_name, method, confidence)``. Only names and one figure per column reach the driver."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "column_name string, position int")
    named = match.match_names(names, "column_name").join(names, "column_name").filter("role is not null")
    found: dict[str, tuple[str, str, float]] = {}
    for r in sorted(named.collect(), key=lambda r: (-r["score"], r["position"])):
        sure = CONFIDENCE["dict"] if r["method"] == "dict" else r["score"] / 100
        found.setdefault(r["role"], (r["column_name"], r["method"], sure))
    taken = {v[0] for v in found.values()}
    rest = [c for c in df.columns if c not in taken]
    if "date" not in found:
        kinds = profile.facts(df, rest, distinct=False) if rest else None
        dates = [] if kinds is None else [
            (r["position"], r["column_name"], r["dtype"]) for r in kinds.filter("date_share > 0.7").collect()]
        for _, c, dtype in sorted(dates)[:1]:
            found["date"] = (c, "pattern", CONFIDENCE["pattern"]) if dtype == "datetime" else (c, "fallback", CONFIDENCE["fallback_date"])
            rest.remove(c)
    numeric = [c for c in rest if c in stats.numeric_columns(df)]
    if "sales" not in found and numeric:
        likely = sorted((r["position"], r["column_name"]) for r in profile.sales_like(df.select(*numeric)).collect())
        if likely:
            found["sales"] = (likely[0][1], "pattern", CONFIDENCE["pattern"])
        else:
            found["sales"] = (profile.widest(df.select(*numeric)).first()["column_name"], "fallback", CONFIDENCE["fallback_sales"])
    return spark.createDataFrame([(role, *hit) for role, hit in found.items()],
                                 "role string, column_name string, method string, confidence double")
