import zlib

from pyspark.sql import functions as F

from tabularium.llm import language, labelled


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = docs.select("doc_id", "lang", language.fit(docs).column("text").alias("f")).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.f.lang == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.f.score <= 1 and abs(sum(r.f.shares) - 1) < 1e-6 for r in found if r.f.lang != "und")


def test_mixtures_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    one = {r.lang: r.text for r in docs.where("n_chars between 3000 and 6000").select("lang", "text").collect()}
    mixed = spark.createDataFrame([(one["en"] + " " + one["de"],), (one["fr"],)], "text string").select(model.column("text").alias("f")).collect()
    assert set(mixed[0].f.languages) == {"en", "de"} and mixed[1].f.languages == ["fr"]


def test_awkward_rows(awkward, nothing, spark):
    model = language.fit(awkward)
    made = {(r.doc_id, r.text): r.f for r in awkward.select("doc_id", "text", model.column("text").alias("f")).collect()}
    assert made[1, None].lang == made[2, ""].lang == made[3, " \t\n "].lang == "und" and made[2, ""].score == 0
    assert made[7, "one two"].lang == "en"
    none = awkward.select(language.fit(nothing).column("text").alias("f")).collect()
    assert {r.f.lang for r in none} == {"und"}
    assert nothing.select(model.column("text").alias("f")).collect() == []


def test_held_out_column(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), labelled.held_out("doc_id", 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert spark.sql("select cast(null as long) doc_id").select(labelled.held_out().alias("h")).first().h is False
