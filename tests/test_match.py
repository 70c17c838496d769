import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.operators import match, profile, roles
from tabularium.functions import nested, text


def brute(queries, items, k, least, otherwise):
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)
    scores = unit(queries) @ unit(items).T
    out = set()
    for q, row in enumerate(scores):
        order = np.lexsort((np.arange(len(row)), -row))
        good = [i for i in order if row[i] >= least][:k] or list(order[:otherwise])
        out |= {(q, int(i)) for i in good}
    return out


@pytest.mark.parametrize("limit", [match.BROADCAST_BYTES, 10])
def test_nearest_equals_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(match, "_BLOCK_BYTES", 2400)
    rng = np.random.default_rng(5)
    q, v = rng.normal(size=(17, 8)), rng.normal(size=(230, 8))
    q[3] = -np.abs(q[3])
    v[:, 0] = np.abs(v[:, 0])
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, v array<double>").repartition(5)
    got = match.nearest(frame(q), frame(v), 4, 0.8, 3, broadcast_bytes=limit)
    assert {(r["query_id"], r["item_id"]) for r in got.collect()} == brute(q, v, 4, 0.8, 3)


def test_token_overlap(spark):
    items = spark.createDataFrame([(1, "red green"), (2, "red red blue"), (3, "grey"), (4, "RED, green! blue?")], "id int, t string")
    asks = spark.createDataFrame([(10, "red green"), (11, "x 1 yy")], "id int, t string")
    got = match.overlapping(match.word_sets(asks, "id", "t"), match.word_sets(items, "id", "t"), 3)
    rows = {(r["query_id"], r["rank"]): (r["item_id"], round(r["score"], 4)) for r in got.collect()}
    assert rows == {(10, 1): (1, 1.0), (10, 2): (4, 0.6667), (10, 3): (2, 0.3333), (11, 1): (1, 0.0), (11, 2): (2, 0.0), (11, 3): (3, 0.0)}


@pytest.mark.parametrize("k, postings", [(8, match.SEED_POSTINGS), (3, 5), (8, 0), (400, 40)])
def test_token_overlap_equals_brute_force(spark, monkeypatch, k, postings):
    """Words of very unequal frequency, copies, an item of nearly all words, empty sets, and queries without any known word."""
    monkeypatch.setattr(match, "SEED_POSTINGS", postings)
    rng = np.random.default_rng(k + postings)
    word = lambda: f"w{min(int(rng.zipf(1.3)), 400)}"
    items = [(i, sorted({word() for _ in range(rng.integers(0, 30))})) for i in range(300)]
    items += [(300 + i, items[i % 7][1]) for i in range(40)] + [(500, [f"w{i}" for i in range(400)])]
    asks = [(i, sorted({word() for _ in range(rng.integers(0, 20))})) for i in range(40)]
    asks += [(90, items[0][1]), (91, items[3][1][:-1]), (92, ["other", "words"]), (93, ["w1"]), (94, ["w1", "unknown"])]
    want = set()
    for q, a in asks:
        scores = [(len(set(a) & set(b)) / (len(set(a) | set(b)) + 1e-10), i) for i, b in items if set(a) & set(b)]
        found = sorted(scores, key=lambda s: (-s[0], s[1]))[:k] or [(0.0, i) for i in sorted(i for i, _ in items)[:k]]
        want |= {(q, i, round(s, 8), n + 1) for n, (s, i) in enumerate(found)}
    frame = lambda rows: spark.createDataFrame(rows, "id long, words array<string>").repartition(3)
    got = match.overlapping(frame(asks), frame(items), k).collect()
    assert {(r.query_id, r.item_id, round(r.score, 8), r.rank) for r in got} == want and len(got) == len(want)


def test_names(spark):
    names = ["Order Date", "revenu", "INCOME", "abc", "unit price", "zz"]
    got = {r["n"]: (r["role"], r["method"]) for r in match.match_names(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert got == {"Order Date": ("date", "dict"), "revenu": ("sales", "fuzzy"), "INCOME": ("sales", "dict"), "abc": (None, None),
                   "unit price": ("price", "dict"), "zz": (None, None)}


def test_roles(spark):
    df = spark.range(50).select(F.col("id").alias("row_no"), (F.rand(3) * 100 + 1).alias("figure"), F.lit("2024-05-06").alias("when_it_was"),
                                F.concat(F.lit("p"), F.col("id") % 4).alias("sku"))
    got = {r["role"]: (r["column_name"], r["method"], r["confidence"]) for r in roles.detect(df).collect()}
    assert got == {"product": ("sku", "dict", 1.0), "date": ("when_it_was", "fallback", 0.35), "sales": ("figure", "pattern", 0.6)}


@pytest.mark.parametrize("question,label", [
    ("hello there", "general"), ("how many rows", "general"), ("why did sales drop in the north last spring", "analytical"),
    ("show me the ten largest customers please", "data_query"), ("compare this year with the year before that", "analytical"),
    ("please sing me a long song about the sea", "ambiguous"), ("totally unlike anything within those topics", "ambiguous")])
def test_intent(spark, question, label):
    assert spark.range(1).select(text.intent(F.lit(question))).first()[0] == label


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.mask_email(F.lit("to jane.doe@site.org now"))) == "to ja***@site.org now"
    assert one(text.sanitize_filename(F.lit("my file..final__v2 .CSV"))) == "my_file.final_v2.csv"
    assert one(text.sanitize_filename(F.lit("...."))) == "dataset.csv"
    assert one(text.sanitize_filename(F.lit("x" * 50 + ".xlsx"))) == "x" * 30 + ".xlsx"
    assert one(text.format_size(F.lit(0))) == "0 B" and one(text.format_size(F.lit(1536))) == "1.5 KB"
    assert one(text.format_size(F.lit(3 * 1024 * 1024))) == "3.0 MB"
    assert [one(text.format_duration(F.lit(s))) for s in (0, 59, 61, 3600, 7325)] == ["0s", "59s", "1m 1s", "1h 0m", "2h 2m"]
    assert one(nested.json_merge(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}'))) == '{"a":"1","b":"3"}'


def test_score_golden(spark):
    """8,523 rows × 12 columns with 3,873 nulls and no repeats scored 97.49: nulls alone cost 1.89."""
    got = spark.range(1).select(profile.score(F.lit(3873 / (8523 * 12)), F.lit(0.0), F.lit(0.0))).first()[0]
    assert got == 98.11
    assert spark.range(1).select(profile.score(F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()[0] == 30.0


def test_validation(spark):
    failing = lambda df: [r["rule"] for r in profile.first_failure(profile.validate(df, 5_000_000, 200)).collect()]
    assert failing(spark.range(9).select("id")) == ["min_rows"]
    assert failing(spark.range(20).select(F.lit("a").alias("t"))) == ["numeric_columns"]
    assert failing(spark.range(20).select(*[F.col("id").alias(f"c{i}") for i in range(201)])) == ["max_columns"]
    assert failing(spark.range(20).select("id", *[F.lit(None).cast("int").alias(f"c{i}") for i in range(19)])) == ["null_share"]
    assert failing(spark.range(20).select("id", "id")) == ["unique_columns"]
    assert failing(spark.range(20).select("id")) == []
    free = profile.validate(spark.range(20).select(*[F.col("id").alias(f"c{i}") for i in range(201)]))
    assert profile.first_failure(free).count() == 0
