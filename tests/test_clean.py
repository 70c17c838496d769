import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabularium.operators import access, clean, features, profile, stats


@pytest.fixture
def messy(spark):
    rows = [(1, 1.0, "a", " yes "), (2, 3.0, "b", "NO"), (3, None, None, "maybe"), (4, 100.0, "a", None), (5, 2.0, "b", "1")]
    return spark.createDataFrame(rows, "id int, x double, k string, t string")


def column(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_fill_rules(messy):
    assert column(clean.fill(messy, "x", "zero"), "x")[2] == 0
    assert column(clean.fill(messy, "x", "mean"), "x")[2] == 26.5
    assert column(clean.fill(messy, "x", "median"), "x")[2] == 2.5
    assert column(clean.fill(messy, "k", "mode"), "k")[2] == "a"  # tie: the smaller text
    assert clean.fill(messy, "x", "drop").count() == 4
    assert column(clean.fill(messy, "k", "empty", "N/A"), "k")[2] == "N/A"
    assert column(clean.fill(messy, "k", "mean"), "k")[2] is None  # text has no mean
    with pytest.raises(ValueError):
        clean.fill(messy, "x", "guess")


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    assert column(clean.fill(df, "x", "median"), "x") == [None, None]
    assert clean.auto_fill(df)[1] == {"x": clean.DROPPED}


def test_auto_fill_decisions(spark):
    rows = [(i, None if i % 2 else float(i), None if i % 10 else "v", None if i == 3 else "k") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, x double, sparse string, k string")
    out, chosen = clean.auto_fill(df)
    assert chosen == {"x": clean.BY_MEDIAN, "sparse": clean.DROPPED, "k": clean.BY_MODE}
    assert "sparse" not in out.columns
    assert out.filter("x is null or k is null").count() == 0


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 2), (2, "c", 3)], "k int, v string, n int")
    assert clean.dedup(df).count() == 3
    assert clean.dedup(clean.dedup(df)).count() == 3
    assert sorted(tuple(r) for r in clean.dedup(df, "none").collect()) == [(2, "b", 2), (2, "c", 3)]
    assert sorted(tuple(r) for r in clean.dedup(df, "last", ["k"], ["n"]).collect()) == [(1, "a", 1), (2, "c", 3)]
    assert [tuple(r) for r in clean.dedup(df, "none", ["k"]).collect()] == []
    assert df.select(stats.duplicate_count(df)).first()[0] == 1


def test_casts(spark):
    texts = ["12", " 3.9 ", "1d", "", None, "abc", "-4e2", "1,200", "NaN"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    assert column(clean.cast_columns(df, {"t": "Integer"}), "t") == [12, 3, 0, 0, 0, 0, -400, 0, 0]
    assert column(clean.cast_columns(df, {"t": "Float"}), "t") == [12.0, 3.9, 0.0, 0.0, 0.0, 0.0, -400.0, 0.0, 0.0]
    words = spark.createDataFrame(list(enumerate([" TRUE", "n", "0", "perhaps", None])), "id int, t string")
    assert column(clean.cast_columns(words, {"t": "Boolean"}), "t") == [True, False, False, None, None]
    days = spark.createDataFrame(list(enumerate(["2024-02-29", "2023-02-29", "02/03/2024", "03-02-2024", "2024-01-02 03:04:05", "soon"])), "id int, t string")
    got = [str(v)[:10] if v else None for v in column(clean.cast_columns(days, {"t": "Date"}), "t")]
    assert got == ["2024-02-29", None, "2024-02-03", "2024-02-03", "2024-01-02", None]


@pytest.mark.parametrize("good,expected", [(90, "Float"), (80, None)])
def test_auto_cast_numbers(spark, good, expected):
    df = spark.range(100).select(F.when(F.col("id") < good, F.col("id").cast("string")).otherwise("x").alias("t"))
    assert clean.cast_decisions(df).get("t") == expected


@pytest.mark.parametrize("good,expected", [(80, "Date"), (70, None)])
def test_auto_cast_dates(spark, good, expected):
    df = spark.range(100).select(F.when(F.col("id") < good, "2024-01-05").otherwise("x").alias("t"))
    assert clean.cast_decisions(df).get("t") == expected


def test_outliers(messy):
    low, high = stats.iqr_bounds(messy, ["x"])["x"]
    removed = clean.outliers(messy, "x", "remove")
    assert removed.filter("x is null").count() == 0 and removed.count() == 3
    capped = clean.outliers(messy, "x", "iqr")
    assert capped.count() == 5 and capped.filter("x is null").count() == 1
    assert capped.agg(F.max("x")).first()[0] == high
    constant = messy.select("id", F.lit(2.0).alias("x"))
    assert clean.outliers(constant, "x", "zscore").select("x").distinct().collect()[0][0] == 2.0


def test_quantiles_equal_percentile(spark):
    df = spark.range(5000).select(
        (F.pmod(F.xxhash64("id"), F.lit(997)) / 7.0).alias("spread"),
        F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.exp(F.col("id") / 100.0)).alias("skewed"),
        F.when(F.col("id") % 5 != 0, F.col("id").cast("double")).alias("gaps"),
        F.lit(4.0).alias("flat"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") == 0, 1e300).when(F.col("id") == 1, -1e300).otherwise(F.col("id") / 3.0).alias("wide"),
        F.when(F.col("id") % 100 == 0, float("inf")).when(F.col("id") % 99 == 0, float("-inf")).otherwise(F.col("id") * 1.0).alias("endless"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.pow(10.0, F.col("id") % 600 - 300)).alias("decades"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = df.agg(*[F.percentile(F.when(~F.isnan(c), F.col(c)), F.array(*map(F.lit, probs))).alias(c) for c in df.columns]).first()
    for accuracy in (stats.ACCURACY, 50):
        found = stats.quantiles(df, df.columns, probs, accuracy)
        for c in df.columns:
            for a, b in zip(want[c] or [None] * len(probs), found[c]):
                assert (a is None and b is None) or a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12), (c, a, b)


def test_quantiles_take_three_scans(spark):
    """However the values lie, jobs are a sketch, the counts below, and the values inside the brackets."""
    seen = []
    plain = stats._pick_ranks
    df = spark.range(300_000).select(F.when(F.col("id") == 5, float("inf")).otherwise(F.exp(F.col("id") / 500)).alias("x"))
    stats._pick_ranks = lambda *a: seen.append(a[1]) or plain(*a)
    try:
        got = stats.quantiles(df, ["x"], [0.25, 0.5, 0.999999])["x"]
    finally:
        stats._pick_ranks = plain
    assert [len(s) for s in seen] == [3]
    assert got == pytest.approx(list(df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.999999)))).first()[0]))


def test_group_quantiles(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.sqrt("id")).alias("v"))
    got = {r["g"]: (r["m"], r["p"]) for r in stats.group_quantiles(df, "g", "v", {"m": 0.5, "p": 0.9}).collect()}
    for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.9)).alias("p")).collect():
        assert got[r["g"]] == pytest.approx((r["m"], r["p"]))


def test_feature_operations(messy):
    get = lambda op, inputs, **kw: column(features.derive(messy, "f", op, inputs, **kw), "f")
    assert get("normalize", ["x"]) == [0.01, 0.03, 0.0, 1.0, 0.02]
    assert get("boolean_flag", ["k"]) == [1, 1, 0, 1, 1]
    assert get("product", ["x", "id"])[3] == 400.0
    assert get("sum", ["x", "id"])[2] == 3.0
    assert get("difference", ["id"]) == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert get("ratio", ["id", "x"])[2] is None
    assert get("log", ["x"])[2] == 0.0
    assert get("no_such_operation", ["x"]) == get("normalize", ["x"])
    assert get("binning", ["id"], bins=2) == [0, 0, 0, 1, 1]  # right-closed edges
    flat = messy.select("id", F.lit(0.0).alias("x"))
    assert set(column(features.derive(flat, "f", "zscore", ["x"]), "f")) == {0.0}
    assert set(column(features.derive(flat, "f", "normalize", ["x"]), "f")) == {0.0}
    assert set(column(features.derive(flat, "f", "binning", ["x"]), "f")) == {0}


def test_label_encode_and_scale(messy):
    coded = features.label_encode(messy.select("id", "k"), ["k"])
    assert column(coded, "k_code") == [0, 1, 2, 0, 1]
    scaled = column(features.standard_scale(messy.select("id", "x").na.drop(), ["x"]), "x_scaled")
    assert sum(scaled) == pytest.approx(0) and sum(v * v for v in scaled) == pytest.approx(len(scaled))


def test_relationships_against_corr(spark):
    df = spark.range(500).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.when(F.col("id") % 7 > 0, F.rand(3)).alias("c"))
    df = df.withColumn("ab", F.col("a") * F.col("b")).withColumn("abc", F.col("a") + F.col("c")).cache()
    found = {(r["target"], r["formula"]): r["correlation"] for r in features.relationships(df).collect()}
    assert found[("ab", "a * b")] == 1.0 and found[("abc", "a + c")] == 1.0
    cols = df.columns
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            for t in cols:
                if t not in (a, b):
                    for sign, made in (("*", F.col(a) * F.col(b)), ("+", F.col(a) + F.col(b))):
                        r = df.agg(F.corr(made, F.col(t))).first()[0]
                        assert ((t, f"{a} {sign} {b}") in found) == (abs(r) > 0.98)
    df.unpersist()


@pytest.mark.parametrize("sum_bytes", [1, 20_000])
def test_relationships_in_blocks_are_those_of_one(spark, sum_bytes):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 9)) + rng.integers(-3, 3, 9)
    x[:, 6], x[:, 7], x[:, 8] = x[:, 0] * x[:, 1], x[:, 2] + x[:, 3], 5.0
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 3] = np.where(np.arange(400) < 380, np.nan, x[:, 3])
    df = spark.createDataFrame([[None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)] for r in x], [f"n{i}" for i in range(9)]).repartition(3)
    whole = sorted(map(tuple, features.relationships(df).collect()))
    assert whole == sorted(map(tuple, features.relationships(df, sum_bytes=sum_bytes).collect()))
    want = set()
    for a in range(9):
        for b in range(a + 1, 9):
            for t in set(range(9)) - {a, b}:
                for sign, made in (("*", x[:, a] * x[:, b]), ("+", x[:, a] + x[:, b])):
                    there = ~np.isnan(made) & ~np.isnan(x[:, t])
                    with np.errstate(all="ignore"):
                        r = np.corrcoef(made[there], x[there, t])[0, 1] if there.sum() > 1 else 0
                    if abs(r) > 0.98:
                        want.add((f"n{t}", f"n{a} {sign} n{b}", round(r, 4)))
    assert {(r[0], r[1], r[3]) for r in whole} == want and len(want) >= 2


def test_relationships_of_two_hundred_columns_stay_within_a_gigabyte(spark):
    """The sums of all triples would be 2.9 GB; one task's memory is measured."""
    cols = [f"n{i}" for i in range(200)]
    blocks = features._pair_blocks(200, features._SUM_BYTES)
    assert sum(map(len, blocks)) == 200 * 199 // 2 and max(map(len, blocks)) * 200 * 9 * 8 <= features._SUM_BYTES
    rng = np.random.default_rng(1)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rng.normal(size=(200, 600))], names=cols)
    tracemalloc.start()
    sizes = [p.nbytes for p in features._pair_sums(200, [0.0] * 200, blocks[0], 0)([batch])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30 and max(sizes) < 1 << 20 and features._SALTS * max(sizes) < 1 << 27


def test_suggested_features(spark):
    names = "order_id int, sales_amount double, quantity int, profit double, unit_price double, discount double"
    specs = features.suggest(spark.createDataFrame([], names))
    assert [s["col"] for s in specs] == ["sales_per_quantity", "profit_margin", "discount_rate", *[f"{c}_log" for c in ("order_id", "sales_amount", "quantity", "profit", "unit_price", "discount")]]
    assert features.suggest(spark.createDataFrame([], "Len double"))[0]["col"] == "len_normalized"


def test_wide_tables_are_read_in_batches(spark):
    from tabularium.operators import profile
    wide = spark.range(200).select(*[(F.when(F.col("id") % (i + 2) != 0, F.col("id") * 1.0)).alias(f"n{i}") for i in range(60)],
                                   *[F.lit("7").alias(f"t{i}") for i in range(45)])
    known = {r["column_name"]: r for r in profile.facts(wide).collect()}
    assert len(known) == 105 and sorted(r["position"] for r in known.values()) == list(range(1, 106))
    assert known["n0"]["null_count"] == 100 and known["t44"]["nunique"] == 1
    assert set(clean.cast_decisions(wide).values()) == {"Float"} and len(clean.cast_decisions(wide)) == 45
    one = profile.quality(wide).first()
    assert one["total_nulls"] == sum(r["null_count"] for r in known.values()) and one["total_cols"] == 105
    assert len(stats.quantiles(wide, stats.numeric_columns(wide), [0.5])) == 60


def test_tables_without_numbers(spark):
    from tabularium.operators import profile
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, t string")
    assert profile.quality(df).first()["total_nulls"] == 1
    assert profile.catalog(df).count() == 2 and stats.outlier_cells(df).count() == 0
    assert clean.auto_cap(df)[1] == {} and profile.summary_cards(df).count() == 2


@pytest.mark.parametrize("policy, limit", [("profile", 100), ("chat", 199), ("analysis", 9), ("pattern", 1800), ("pattern", 999)])
def test_types_at_the_limits_of_distinct_counts(spark, monkeypatch, policy, limit):
    """Columns one below, at and one above a limit, and far from it; only those near it are counted."""
    counts = [max(1, limit // 3), limit - 1, limit, limit + 1, limit + 2]
    df = spark.range(2000).select(*[F.concat(F.lit("v"), F.col("id") % n).alias(f"c{n}") for n in dict.fromkeys(counts)],
                                  F.lit(None).cast("string").alias("none"), F.lit(float("nan")).alias("nan"))
    exact = profile.facts(df).select("column_name", profile.inferred(policy).alias("inferred_type")).collect()
    asked = []
    nunique = stats.nunique
    monkeypatch.setattr(stats, "nunique", lambda df, columns: (asked.extend(columns), nunique(df, columns))[1])
    got = profile.infer_types(df, policy).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exact))
    assert {f"c{limit - 1}", f"c{limit}", f"c{limit + 1}"} & set(asked) and (limit < 50 or f"c{limit // 3}" not in asked)


def test_identifiers_and_sales_columns_count_what_may_be_unique(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 2710).alias("nearly"), (F.col("id") % 2600).alias("less"), (F.col("id") % 40).alias("few"),
                                  (F.col("id") * 1.5 + 1).alias("money"), F.concat(F.lit("k"), F.col("id")).alias("code"))
    asked = []
    nunique = stats.nunique
    monkeypatch.setattr(stats, "nunique", lambda df, columns: (asked.extend(columns), nunique(df, columns))[1])
    assert sorted(tuple(r) for r in profile.identifiers(df).collect()) == [("code", 1.0), ("id", 1.0), ("nearly", 0.9033)]
    assert "few" not in asked and set(asked) <= {"id", "nearly", "less", "code"}
    asked.clear()
    assert [r["column_name"] for r in profile.sales_like(df).collect()] == ["less", "few", "money"] and "few" not in asked and "money" not in asked


def test_duplicates_by_fingerprint(spark):
    rows = [(1, "a", None, [1]), (1, None, "a", [1]), (1, "a", None, [1]), (None, None, None, None), (None, None, None, None), (2, "", "", []), (2, None, "", [])]
    df = spark.createDataFrame(rows, "a long, b string, c string, d array<int>")
    count = lambda df: spark.range(1).select(stats.duplicate_count(df)).first()[0]
    assert count(df) == 2 and count(df.limit(2)) == 0 and count(df.where("false")) == 0
    doubles = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (1.0,)], "x double")
    assert count(doubles) == 2
    mapped = df.select("a", F.create_map(F.lit("k"), "b").alias("m"))
    assert count(mapped.select("a", F.to_json("m").alias("m"))) >= 1


def test_different_rows_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(stats, "fingerprint", lambda columns: [(F.col("c0") % 3).alias("_f1"), F.lit(0).cast("long").alias("_f2")])
    df = spark.range(30).select((F.col("id") % 10).alias("n"), F.lit("x").alias("t"))
    assert spark.range(1).select(stats.duplicate_count(df)).first()[0] == 20


@pytest.mark.parametrize("few, buckets", [(0, 1 << 16), (0, 64), (0, 7), (50, 1000)])
def test_frequent_values_of_many(spark, few, buckets):
    """Skewed, unique and nearly unique columns, many ties at the limit, copies of one value, nulls."""
    rng = np.random.default_rng(few + buckets)
    rows = [(int(min(rng.zipf(1.2), 10 ** 9)), f"k{i}", f"u{i if i % 50 else 0}", "one", int(rng.integers(300)), None if i % 3 else float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "zipf long, key string, nearly string, same string, flat long, gaps double").repartition(5)
    got = sorted((r.column_name, r["rank"], r.value, r.n, r.present) for r in stats.frequent_values(df, df.columns, 20, few, buckets).collect())
    want = []
    for i, c in enumerate(df.columns):
        values = [str(r[i]) for r in rows if r[i] is not None]
        best = sorted(Counter(values).items(), key=lambda v: (-v[1], v[0]))[:20]
        want += [(c, k + 1, v, n, len(values)) for k, (v, n) in enumerate(best)]
    assert got == sorted(want)
    assert sorted(tuple(r) for r in stats.modes(df, ["zipf", "key"]).collect()) == sorted((c, v, n) for c, k, v, n, _ in want if k == 1 and c in ("zipf", "key"))
    assert stats.frequent_values(df.where("false"), df.columns, 3, few, buckets).collect() == []


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_permission_matrix_in_blocks(spark, block):
    grants = spark.createDataFrame([(u, f"d{d}") for u in (1, 2, None) for d in range(10) if (u or 5) * d % 3 == 0] + [(1, "gone"), (1, "d0")], "user long, d string")
    datasets = spark.createDataFrame([(f"d{i % 10}",) for i in range(12)], "d string")
    got = sorted((r.user or 0, r.d, r.granted) for r in access.matrix(grants, "user", datasets, block).collect())
    held = {(r.user or 0, r.d) for r in grants.collect()}
    assert got == sorted((u, f"d{d}", (u, f"d{d}") in held) for u in (0, 1, 2) for d in range(10))


@pytest.mark.parametrize("collide", [False, True])
def test_distinct_rows_by_fingerprint(spark, monkeypatch, collide):
    """Rows that stand once are not shuffled; rows that share a fingerprint only by chance are all kept."""
    if collide:
        monkeypatch.setattr(stats, "fingerprint", lambda columns: [(F.coalesce("c0", F.lit(0)) % 3).cast("long").alias("_f1")])
    rows = [(i, float(i % 7), None if i % 5 else f"t{i}") for i in range(300)] + [(None, None, None)] * 3 + [(7, 0.0, None)] * 40
    df = spark.createDataFrame(rows, "a long, `b c` double, c string").repartition(4)
    got = stats.distinct_rows(df)
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == Counter(set(rows))
    assert spark.range(1).select(stats.duplicate_count(df)).first()[0] == len(rows) - len(set(rows))
    assert sorted(map(tuple, stats.distinct_rows(df.where("a < 7")).collect())) == sorted(set(r for r in rows if r[0] is not None and r[0] < 7))
    assert stats.distinct_rows(df.where("false")).collect() == []


def test_wizard_steps_write_versions_and_fingerprints_only(spark, monkeypatch):
    from tabularium.plans import wizard
    rows = [(i, float(i % 50) if i % 3 else None, f"k{i % 4}" if i % 5 else None) for i in range(2000)]
    df = spark.createDataFrame(rows + rows[:100], "id long, x double, k string").repartition(4)
    made = []
    written = stats.written
    monkeypatch.setattr(stats, "written", lambda frame, label: (made.append((label, frame.dtypes)), written(frame, label))[1])
    steps = wizard.Wizard(df)
    for step in ("null_values", "duplicates", "data_types", "outliers"):
        steps.apply(step)
    found = {r.step: r for r in steps.lineage(copies=True).collect()}
    assert (found["duplicates"].rows_before, found["duplicates"].rows_after) == (2100, 2000)
    assert (found["duplicates"].copies_before, found["duplicates"].copies_after) == (100, 0)
    assert {label for label, _ in made} <= {"repeated", "brackets"}  # no copies of the numbers
    assert {tuple(kinds) for label, kinds in made if label == "repeated"} == {(("_f1", "bigint"),)}
