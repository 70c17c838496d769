"""Dictionary, fuzzy, token and vector matching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabularium.functions import text
from tabularium.functions.nested import l2_normalise
from tabularium.session import written

# Business words behind each column role; the first role that knows a word wins.
ROLE_WORDS: dict[str, tuple[str, ...]] = {
    "sales": (
        "sales", "revenue", "total", "amount", "order_total", "gross_sales", "gross_revenue", "net_sales", "income",
        "sales_amount", "total_sales", "total_revenue", "sale_value", "sale_amount", "value", "transaction_amount",
        "total_amount", "billed_amount", "invoiced_amount", "subtotal"),
    "date": (
        "date", "order_date", "created_at", "timestamp", "transaction_date", "invoice_date", "ship_date", "order_time",
        "created_date", "event_date", "record_date", "entry_date", "period", "time", "datetime", "date_time",
        "transaction_time", "purchase_date", "sale_date", "order_datetime"),
    "product": (
        "product", "item", "product_name", "item_name", "sku", "product_id", "product_code", "item_code", "description",
        "goods", "merchandise", "article", "product_description", "item_description", "part"),
    "customer": (
        "customer", "client", "buyer", "account", "consumer", "customer_name", "client_name", "customer_id",
        "account_name", "contact", "user", "member", "subscriber", "purchaser", "end_user"),
    "region": (
        "region", "country", "state", "city", "location", "area", "territory", "zone", "district", "market", "branch",
        "division", "province", "county", "store", "site", "office", "geography"),
    "quantity": (
        "quantity", "qty", "units", "amount_sold", "volume", "count", "unit_sold", "pieces", "nos", "number_of_units",
        "units_sold", "order_qty", "order_quantity", "items_ordered", "quantity_ordered"),
    "price": (
        "price", "unit_price", "mrp", "cost_price", "rate", "per_unit", "list_price", "selling_price", "retail_price",
        "unit_cost", "price_per_unit", "sale_price", "base_price"),
    "profit": (
        "profit", "net_profit", "margin", "earnings", "net_income", "gross_profit", "operating_profit", "profit_margin",
        "gain", "profitability", "income", "net_margin"),
}

# Score from which a fuzzy match counts, and the shortest name tried.
FUZZY_SCORE, FUZZY_LENGTH = 80.0, 4

# Largest query side that is sent to every task, in bytes of its tokens or vector entries; beyond it both sides are cut
# into blocks of at most so many bytes, and each pair of blocks is one group.
BROADCAST_BYTES = 32 << 20
_BLOCK_BYTES = 8 << 20
_CELLS = 4_000_000  # scores held by a task at one time


def _entries(words: dict[str, tuple[str, ...]]) -> list[tuple[int, str, str]]:
    """(role number, role, word) with each word kept under the first role that has it."""
    seen: dict[str, tuple[int, str, str]] = {}
    for number, (role, group) in enumerate(words.items()):
        for word in group:
            seen.setdefault(word, (number, role, word))
    return list(seen.values())


def match_exact(df: DataFrame, column: str, words: dict[str, tuple[str, ...]] = ROLE_WORDS) -> DataFrame:
    """Add ``norm`` and ``role`` (null if unknown). The dictionary is a fixed word list, so it is broadcast."""
    book = df.sparkSession.createDataFrame(
        [(word, role) for _, role, word in _entries(words)], "_word string, role string")
    named = df.withColumn("norm", text.normalise_name(F.col(column)))
    return named.join(F.broadcast(book), F.col("norm") == F.col("_word"), "left").drop("_word")


def _fuzzy(norm: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """struct(score, role): best edit-distance ratio over the word list, the earlier role on ties."""
    book = F.array(*[F.struct(F.lit(-number).alias("place"), F.lit(role).alias("role"), F.lit(word).alias("word"))
                     for number, (role, group) in enumerate(words.items()) for word in group])
    longest = lambda w: F.greatest(F.length(norm), F.length(w))
    scored = F.transform(book, lambda e: F.struct(
        (F.lit(100.0) * (F.lit(1.0) - F.levenshtein(norm, e["word"]) / longest(e["word"]))).alias("score"),
        e["place"].alias("place"), e["role"].alias("role")))
    return F.array_max(scored)


def match_names(df: DataFrame, column: str, words: dict[str, tuple[str, ...]] = ROLE_WORDS) -> DataFrame:
    """``(column, norm, role, method, score)`` per distinct text: exact word first, then the best fuzzy one.

    Every distinct text is scored against the fixed list inside its own row, so nothing is paired up by a join.
    """
    exact = match_exact(df.select(column).distinct(), column, words)
    best = _fuzzy(F.col("norm"), words)
    tried = exact.withColumn("_best", F.when(F.col("role").isNull() & (F.length("norm") >= FUZZY_LENGTH), best))
    fuzzy = F.col("_best.score") >= FUZZY_SCORE
    return tried.select(
        column, "norm", F.coalesce("role", F.when(fuzzy, F.col("_best.role"))).alias("role"),
        F.when(F.col("role").isNotNull(), "dict").when(fuzzy, "fuzzy").alias("method"),
        F.when(F.col("role").isNotNull(), 100.0).when(fuzzy, F.round("_best.score", 4)).alias("score"))


# ---- best k items per query ----------------------------------------------------------------------------

SCORES = "query_id long, item_id long, score double"


def _bytes(df: DataFrame) -> int:
    """Bytes of all payloads: 8 per number, a token's UTF-8 length and 8 more per token."""
    kind = df.schema["payload"].dataType.elementType
    each = F.size("payload").cast("long") * 8
    if isinstance(kind, T.StringType):
        each = each + F.octet_length(F.array_join("payload", ""))
    return df.agg(F.coalesce(F.sum(each + 8), F.lit(0))).first()[0]


def best_k(queries: DataFrame, items: DataFrame, k: int, score: Callable, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(query_id, item_id, score, rank)``: exact top k items per query, the smaller item id on ties.

    Both frames are ``(id long, payload array)``. ``score(query payloads)`` prepares a block of queries and returns
    ``fn(flat item values, item lengths) -> matrix`` of doubles (NaN = no match). No pair is ever a row: a task
    scores Arrow batches in numpy and emits at most k candidates per query. A query side whose
    bytes have been counted and lie within ``broadcast_bytes`` goes to every task; a larger one is cut into blocks, and every
    (query block, item block) pair is one bounded group. The work is queries times items: meant for a stated set of queries.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    queries = written(queries.toDF("id", "payload"), "queries")  # its bytes are counted before it is collected
    items = items.toDF("id", "payload")

    def cut(best, q_ids, i_ids, matrix):
        """Merge a scored block into the running best lists: arrays (score, item) of at most k per query."""
        for row, qid in enumerate(q_ids):
            s = matrix[row]
            have = np.flatnonzero(~np.isnan(s))
            if not len(have):
                continue
            s, ids = s[have], i_ids[have]
            if len(s) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k]
                near = s >= edge
                s, ids = s[near], ids[near]
            if qid in best:
                s, ids = np.concatenate([best[qid][0], s]), np.concatenate([best[qid][1], ids])
            order = np.lexsort((ids, -s))[:k]
            best[qid] = (s[order], ids[order])

    def add(best, q_ids, ready, ids, lists):
        """Score items a slice at a time, so the matrix stays within _CELLS."""
        step = max(1, _CELLS // max(1, len(q_ids)))
        for at in range(0, len(lists), step):
            part = lists.slice(at, step)
            lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype("int64")
            cut(best, q_ids, ids[at:at + step], ready(part.flatten(), lengths))

    def arrays(best):
        ids = [np.full(len(s), q, dtype="int64") for q, (s, _) in best.items()]
        join = lambda parts, kind: np.concatenate(parts) if parts else np.array([], dtype=kind)
        return [pa.array(join(ids, "int64")), pa.array(join([i for _, i in best.values()], "int64")),
                pa.array(join([s for s, _ in best.values()], "float64"))]

    names = ["query_id", "item_id", "score"]
    size = _bytes(queries)
    if size <= broadcast_bytes:
        rows = queries.collect()  # size checked above
        q_ids = np.array([r["id"] for r in rows], dtype="int64")
        payloads = [r["payload"] for r in rows]

        def scan(batches):
            best: dict = {}
            ready = score(payloads) if len(q_ids) else None
            for batch in batches:
                if batch.num_rows and ready:
                    add(best, q_ids, ready, batch.column(0).to_numpy(), batch.column(1))
            yield pa.RecordBatch.from_arrays(arrays(best), names=names)

        found = items.mapInArrow(scan, SCORES)
    else:
        q_blocks = max(1, -(-size // _BLOCK_BYTES))
        i_blocks = max(1, -(-_bytes(items) // _BLOCK_BYTES))

        def meet(q, i):
            best: dict = {}
            if q.num_rows and i.num_rows:
                add(best, q.column("id").to_numpy(), score(q.column("payload").to_pylist()), i.column("id").to_numpy(),
                    i.column("payload").combine_chunks())
            return pa.Table.from_arrays(arrays(best), names=names)

        block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = queries.withColumn("qb", block(q_blocks)).withColumn("ib", all_of(i_blocks))
        i = items.withColumn("ib", block(i_blocks)).withColumn("qb", all_of(q_blocks))
        found = q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib")).applyInArrow(meet, SCORES)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _cosine(queries):
    import numpy as np
    asked = np.vstack([np.asarray(q, dtype="float64") for q in queries])
    return lambda flat, lengths: asked @ flat.to_numpy(zero_copy_only=False).reshape(len(lengths), -1).T


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 8, least: float = 0.25, otherwise: int = 3, **kw) -> DataFrame:
    """Cosine top k per query among vectors scoring at least ``least``; without any, the best ``otherwise``."""
    unit = lambda df: df.toDF("id", "v").select("id", l2_normalise(F.col("v")).alias("payload"))
    ranked = best_k(unit(queries), unit(vectors), max(k, otherwise), _cosine, **kw)
    top = F.max("score").over(W.partitionBy("query_id"))
    good = (F.col("score") >= least) & (F.col("rank") <= k)
    return (ranked.withColumn("_top", top)
            .filter(good | ((F.col("_top") < least) & (F.col("rank") <= otherwise))).drop("_top"))


def word_sets(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.array_distinct(text.tokens(F.col(column))).alias("payload"))


# Postings that the words which seed a query's candidates come to at most (or its rarest word), and seeds scored per result.
SEED_POSTINGS, SEEDS = 4096, 4
_EPS = 1e-9  # slack of bounds computed in doubles; what passes is scored exactly


def overlapping(queries: DataFrame, items: DataFrame, k: int = 8) -> DataFrame:
    """``(query_id, item_id, score, rank)``: exact token Jaccard top k per query, the smaller item id on ties; a query that
    shares no token gets the first k items by id with score 0. Both frames come from :func:`word_sets`, ids unique.

    The items' words are an inverted index that is joined by word. Few postings of a query's rarest words give seeds, whose k-th
    score is a floor. An item at the floor or above holds so many of the query's words that one of them is among its rarest
    ones, so the commonest words' postings, the longest by far, are never read. What the prefix has
    counted bounds the score from above; only items whose bound reaches the floor are scored.
    """
    queries, items = written(queries.toDF("query_id", "words"), "queries"), written(items.toDF("item_id", "held"), "items")
    asked = queries.select("query_id", F.size("words").alias("asked"), F.explode("words").alias("word"))
    postings = items.select("item_id", F.size("held").alias("size"), F.explode("held").alias("word"))
    wanted = asked.select("word").distinct()
    commonness = postings.join(wanted, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = W.partitionBy("query_id").orderBy("n", "word")
    # one query's words; words that no item holds come first and cost nothing
    placed = written(asked.join(commonness, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
                     .withColumn("place", F.row_number().over(rarest)).withColumn("upto", F.sum("n").over(rarest.rowsBetween(W.unboundedPreceding, W.currentRow))), "asked")

    def counted(some: DataFrame) -> DataFrame:
        return (postings.join(some.select("query_id", "asked", "word"), "word").groupBy("query_id", "item_id", "asked", "size")
                .agg(F.count(F.lit(1)).alias("hits")))

    def scored(some: DataFrame) -> DataFrame:
        shared = F.size(F.array_intersect("words", "held"))
        return (some.select("query_id", "item_id").join(items, "item_id").join(queries, "query_id")
                .select("query_id", "item_id", (shared / (F.size("words") + F.size("held") - shared + 1e-10)).alias("score")))

    first = F.col("upto") <= SEED_POSTINGS
    rare = placed.where(first | (F.col("upto") == F.col("n")))  # also the rarest held word alone, however common
    most = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("hits"), "size", "item_id"))
    seeds = counted(rare).withColumn("r", most).where(F.col("r") <= SEEDS * k)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    floors = scored(seeds).withColumn("r", place).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
    floor = F.coalesce("floor", F.lit(0.0))
    prefix = F.col("asked") - F.greatest(F.ceil(floor * F.col("asked") - _EPS), F.lit(1)) + 1
    index = written(placed.join(floors, "query_id", "left").withColumns({"floor": floor, "prefix": prefix}), "index")
    bounds = index.select("query_id", "floor", "prefix").distinct()
    best = F.col("hits") + F.least(F.col("asked") - F.col("prefix"), F.col("size") - F.col("hits"))
    bound = best / (F.col("asked") + F.col("size") - best)
    near = counted(index.where("place <= prefix")).join(bounds, "query_id").where(bound >= F.col("floor") - _EPS)
    ranked = scored(near).withColumn("rank", place).where(F.col("rank") <= k)
    hit = F.array(F.struct("item_id", "score", F.col("rank").cast("int").alias("rank")))
    first_ids = F.array_sort(F.collect_list("item_id"))  # k ids
    filler = items.select("item_id").orderBy("item_id").limit(k).agg(F.transform(first_ids, lambda i, at: F.struct(
        i.alias("item_id"), F.lit(0.0).alias("score"), (at + 1).cast("int").alias("rank")))).scalar()
    every = queries.select("query_id").join(ranked, "query_id", "left")
    return every.select("query_id", F.explode(F.when(F.col("item_id").isNull(), filler).otherwise(hit)).alias("r")).select("query_id", "r.*")
