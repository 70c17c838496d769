"""One registered query per operator: the thin digest of its contract over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm import chat, labelled, language, minhash, negatives, packing, phrases, pieces, quality, sharding, sketch, toxicity, vectors, wavelet
from tabularium.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[name] = sql.strip()
        return fn
    return keep


def reached(nodes: str, links: str) -> str:
    """CTEs that name each node's component by its smallest member, given the nodes and the links in both directions."""
    return f"""reach AS (SELECT id, id AS other FROM {nodes} UNION SELECT r.id, l.b FROM reach r JOIN {links} l ON l.a = r.other),
label AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op1_minhash", f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
d AS (SELECT doc_id AS id FROM documents), {reached('d', 'p')}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN label ON id = doc_id""")
def op1(t: Tables) -> DataFrame:
    """Near-duplicate groups of whole documents at Jaccard 0.85 on five-word shingles."""
    return minhash.near_duplicates(t.documents)


def scored(t: Tables, model, cut: float) -> DataFrame:
    score = model.column("text")
    return (t.documents.select("doc_id", labelled.held_out().alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= cut).cast("int")))


@query("op6_quality")
def op6(t: Tables) -> DataFrame:
    """Quality scores of all whole documents."""
    return scored(t, quality.fit(t.documents, t.labels), 0.5)


@query("op9_toxicity")
def op9(t: Tables) -> DataFrame:
    """Toxicity scores of all whole documents."""
    return scored(t, toxicity.fit(t.documents, t.labels), 0.7)


@query("op10_packing")
def op10(t: Tables) -> DataFrame:
    """All whole documents packed into windows of 2048 tokens."""
    return packing.pack(t.documents, public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_projections", f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95),
d AS (SELECT vec_id AS id FROM embeddings), {reached('d', 'p')}
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN label ON id = vec_id""")
def op7(t: Tables) -> DataFrame:
    """Near-duplicate groups and links of all embeddings at cosine 0.95."""
    return vectors.near_duplicates(t.embeddings)


@query("op8_ring")
def op8(t: Tables) -> DataFrame:
    """All documents on 16 shards of near-equal bytes."""
    return sharding.sharded(t.documents)


@query("op4_sketch")
def op4(t: Tables) -> DataFrame:
    """Fingerprints of all whole documents and of their edited texts."""
    return sketch.with_edits(t.documents)


@query("op5_language")
def op5(t: Tables) -> DataFrame:
    """The language of every whole document."""
    found = language.fit(t.documents).column("text")
    return (t.documents.select("doc_id", labelled.held_out("doc_id", language.FOLDS, language.HELD).alias("held_out"), found.alias("found"))
            .select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.languages", "found.shares"))


CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"


def escaped(column: str) -> str:
    """Characters of an escaped text: one more for each backslash and each control string."""
    return f"(length({column}) + length({column}) - length(replace({column}, '\\', '')) + len(regexp_extract_all({column}, '{CONTROL}')))"


@query("op3_chat", f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
  sum({escaped('role')} + {escaped('text')} + 20) AS formatted_chars FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, false AS rewritten FROM g""")
def op3(t: Tables) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    extra = t.spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.digests(t.conversations.select("conv_id", "turn", "role", "text").unionByName(extra))


@query("op2_viterbi")
def op2(t: Tables) -> DataFrame:
    """Piece ids of all whole documents, decoded again."""
    return pieces.digested(t.documents, public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_negatives", """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.e) = len(b.e)),
p AS (SELECT * FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 10""")
def op13(t: Tables) -> DataFrame:
    """Hard negatives of every hundredth embedding, for each of its five best positives."""
    return negatives.hard_negatives(t.embeddings)


@query("op11_wavelet")
def op11(t: Tables) -> DataFrame:
    """All whole documents' ids written into wavelet matrices and read back from the files."""
    return wavelet.documents(t.spark, wavelet.written(t.documents, public_tokenizers.path("byte_bpe_50k.json")))


@query("op12_phrases", f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
q AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM q GROUP BY 1),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM q, (SELECT unnest([1, 2, 3, 4, 5]) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.phrase, c.m, c.a, k, l.a AS l, r.a AS r, n, (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM c JOIN n ON n.lang = c.lang JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:c.m], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM s
WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = s.lang AND y.m > s.m AND 100 * y.a >= 100 * s.a AND contains(' ' || y.phrase || ' ', ' ' || s.phrase || ' '))
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000""")
def op12(t: Tables) -> DataFrame:
    """The collocations of each language in all whole documents."""
    return phrases.collocations(t.documents)
