import numpy as np

import corpus_pipeline
from tabularium.llm import quality, toxicity
from tests.llm.test_minhash import expected, groups
from tests.llm.test_packing import check
from tests.llm.test_words import sets


def test_stages_are_those_of_plain_python(spark, folder, documents, labels):
    good = documents.where(quality.fit(documents, labels).column("text") >= 0.5)
    made = corpus_pipeline.good(spark, documents, folder)
    assert made.columns == documents.columns and sorted(made.collect()) == sorted(good.collect()) and 0 < made.count() < documents.count()
    clean = corpus_pipeline.clean(spark, made, folder)
    assert sorted(clean.collect()) == sorted(made.where(toxicity.fit(made, labels).column("text") < 0.7).collect()) and clean.columns == documents.columns
    first = corpus_pipeline.distinct(spark, clean, folder)
    label = expected([(r.doc_id, r.text) for r in clean.collect()], 80)
    assert sorted(r.doc_id for r in first.collect()) == sorted(set(label.values())) and first.columns == documents.columns
    check(first, corpus_pipeline.windows(spark, first, folder).collect(), 2048)
    packed = corpus_pipeline.run(spark, folder)
    check(first, packed.collect(), 2048)


def test_awkward_rows_pass_all_stages(spark, folder, awkward, nothing):
    for df in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, df, folder)
            assert made.columns == df.columns and made.count() <= df.count()
    kept = corpus_pipeline.distinct(spark, awkward, folder).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 2, 3, 4, 7, 9, 10, 12, 13, 14] and sum(r.doc_id is None for r in kept) == 2


def test_near_copies_between_80_and_85_percent_are_found(spark, folder):
    rng = np.random.default_rng(11)
    rows, near = [], 0
    for i in range(60):
        size, changed = int(rng.integers(150, 400)), 0
        base = [f"d{i}w{j}" for j in range(size)]
        copy = list(base)
        while 5 * (changed + 1) / (size - 4) <= (0.11 if i % 3 else 0.125):
            changed += 1
            copy[7 * changed] = f"d{i}c{changed}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    by = [(i, sets(t)) for i, t in rows]
    share = {(a, b): len(x & y) / len(x | y) for n, (a, x) in enumerate(by) for b, y in by[:n] if x & y}
    assert sum(0.8 <= s < 0.85 for s in share.values()) >= 40 and sum(s < 0.8 for s in share.values()) >= 10
    label = groups([p for p, s in share.items() if s >= 0.8], {i for i, _ in rows})
    made = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert sorted(r.doc_id for r in made.collect()) == sorted(set(label.values()))


def test_rows_that_repeat_an_id_leave_the_one_of_the_smallest_hash(spark, folder):
    rows = [(1, f"text number {i} of the same id and no other one", "en", i % 3) for i in range(40)] + [(2, "alone", "de", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int")
    made = corpus_pipeline.distinct(spark, df.repartition(9), folder)
    first = df.where("doc_id = 1").selectExpr("min(struct(xxhash64(text) AS h, text)).text AS t").first().t
    assert made.columns == df.columns and sorted((r.doc_id, r.text) for r in made.collect()) == [(1, first), (2, "alone")]
