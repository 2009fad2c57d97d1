"""Queries over vectors: scores, candidates, curated recommendations, audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.functions.text import normalize_title
from quern.operators import curation, search
from quern.plans import catalog as C
from quern.session import stash, work_dir

K, POOL = 8, 40
#: Of all vectors one in so many is a query.
EVERY = 50


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = C.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return search.unit(list(row[0]))


def _pool(spark: SparkSession, sf_dir: str, rows: DataFrame, pool: int, k: int) -> DataFrame:
    # A limit above the number of rows takes them all, so the pool needs no count to be clamped.
    n = search.pool_size(pool, k, max(pool, k))
    return search.top_candidates(rows, _query_vector(spark, sf_dir), n, "product_id")


def vector_scores_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", search.score(F.col("embedding"), _query_vector(spark, sf_dir)).alias("score"))


def vector_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir, C.vectors(spark, sf_dir), POOL, K).select("product_id", "score")


def vector_pool_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools below k, above the table, and of usual size."""
    rows = C.vectors(spark, sf_dir)
    out = None
    for name, pool, k in (("below_k", 3, 12), ("above_n", 10**6, 5), ("usual", POOL, K)):
        one = _pool(spark, sf_dir, rows, pool, k).select(F.lit(name).alias("kind"), "product_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def _ordered(candidates: DataFrame, by: list[str]) -> DataFrame:
    """place from 1 by score and id within a pool of bounded size."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("product_id"))
    return candidates.withColumn("place", F.row_number().over(order))


RESULT = ("rank", "product_id", "title", "store", "score", "rating_number", "average_rating")


def recommend_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector: score, top pool, curation, quality gate. The pool (at most POOL rows) is
    fetched, so that parts and ratings are read with a filter on its ids."""
    pool = _pool(spark, sf_dir, C.vectors(spark, sf_dir), POOL, K).select("product_id", "score").collect()
    best = spark.createDataFrame(pool, "product_id bigint, score double")
    best = F.broadcast(best).join(C.products(spark, sf_dir, [r.product_id for r in pool]), "product_id")
    rows = _ordered(C.keyed(best.withColumn("query_id", F.lit(0).cast("bigint"))), ["query_id"])
    return curation.quality_gate(curation.curate(rows, K, ["query_id"])).select(*RESULT)


def recommend_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector as a query, against all products: queries grow with the table, so they are dealt out in
    groups. Their pools cover most products, so parts and ratings are read whole."""
    vectors = C.vectors(spark, sf_dir)
    known = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"))
    corpus = vectors.join(known, "product_id", "left_semi")
    asked = vectors.filter(F.col("product_id") % EVERY == 0).select(F.col("product_id").alias("query_id"), "embedding")
    best = search.blocked_candidates(corpus, asked, POOL, "product_id")
    rows = C.keyed(stash(best, "batch-pools").join(C.products(spark, sf_dir), "product_id"))
    return curation.quality_gate(curation.curate(rows, K, ["query_id"])).select("query_id", *RESULT)


def dedup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curation with stores uncapped: the best row of each title."""
    best = _pool(spark, sf_dir, C.catalog(spark, sf_dir), POOL, K).drop("embedding").withColumn("query_id", F.lit(0))
    return curation.curate(_ordered(C.keyed(best), ["query_id"]), POOL, ["query_id"], cap=POOL).select("rank", "product_id", "title")


def store_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curation where every row has its own title: at most two rows of a store, then backfill."""
    best = _pool(spark, sf_dir, C.catalog(spark, sf_dir), POOL, K).drop("embedding").withColumn("query_id", F.lit(0))
    rows = _ordered(C.keyed(best), ["query_id"]).withColumn("title_key", F.col("product_id").cast("string"))
    return curation.curate(rows, 30, ["query_id"]).select("rank", "product_id", "store")


def vector_norm_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in all, not finite, not of unit length, and the lengths seen; and the three spot rows."""
    e = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.count()
    spots = F.col("vec_id").isin(0, n // 2, n - 1)
    v = F.col("embedding")
    return e.agg(
        F.count("*").alias("n"), F.count_if(~V.is_finite(v)).alias("not_finite"), F.count_if(~V.is_unit(v)).alias("not_unit"),
        F.count_if(spots).alias("spots"), F.count_if(spots & ~V.is_unit(v)).alias("bad_spots"), F.min(F.size(v)).alias("min_dim"), F.max(F.size(v)).alias("max_dim"),
    )


def vector_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled by 3 and normalised again: their length, and their product with the original."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    back = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", V.l2_normalize(scaled).alias("unit"))
    return back.select("vec_id", F.round(V.norm(F.col("unit")), 6).alias("norm"), F.round(V.dot(F.col("unit"), F.col("embedding")), 6).alias("cosine"))


def artifact_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products without a vector, vectors without a product, and both, by a full outer join on the key."""
    p, e = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), C.vectors(spark, sf_dir).select(F.col("product_id").alias("id"))
    both = p.withColumn("p", F.lit(1)).join(e.withColumn("e", F.lit(1)), "id", "full_outer")
    return both.agg(F.count_if(F.expr("e is null")).alias("no_vector"), F.count_if(F.expr("p is null")).alias("no_product"), F.count_if(F.expr("p = e")).alias("aligned"))


def ordered_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products written as lines and their vectors as a matrix, zipped by place when they are loaded: each product with the first
    component and the length of the vector that it has got. Both files go to the shared folder, which is mounted where a matrix is used."""
    from quern.operators.embed_job import digest
    from quern.pipeline import load_aligned
    from quern.sources import files, npy

    rows = files.renumbered(C.catalog(spark, sf_dir), "product_id", "row_index")
    title = F.coalesce("title", F.lit(""))
    lines = rows.select(
        "row_index", F.col("product_id").cast("string").alias("parent_asin"), title.alias("title"), "store", "average_rating", "rating_number", "price", F.lit(None).cast("string").alias("image_url"),
        F.array(title).alias("features"), normalize_title(title).alias("normalized_title"), F.concat(title, F.lit(" by "), F.col("store")).alias("retrieval_text"), "embedding",
    )
    rows = stash(lines, "zip-rows")
    at = f"{work_dir(spark)}/zip-{uuid.uuid4().hex}"
    files.write_products(rows.drop("embedding"), f"{at}/products")
    vectors = rows.select("row_index", F.col("embedding").cast("array<float>").alias("embedding"))
    npy.write_npy(vectors, f"{at}/matrix.npy".removeprefix("file://"), len(rows.first()["embedding"]))
    texts = rows.select("row_index", F.trim("retrieval_text").alias("embedding"))
    manifest = {"product_count": rows.count(), "dimensions": 64, "normalized": True, "vectors_digest": digest(vectors, "row_index"), "texts_digest": digest(texts, "row_index")}
    zipped = load_aligned(spark, f"{at}/products", f"{at}/matrix.npy", manifest)
    v = F.col("embedding")
    return zipped.select(F.col("parent_asin").cast("bigint").alias("product_id"), "row_index", F.round(F.element_at(v, 1).cast("double"), 6).alias("first"), F.round(V.norm(v), 4).alias("norm"))


def query_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vectors can be queries, of vectors that are cut short, scaled down, or made zero, infinite or null at one place, by
    what they hold: the first component's size and sign."""
    e, first = C.table(spark, sf_dir, "embeddings"), F.element_at("embedding", 1).cast("double")
    size = F.floor(F.abs(first) * 1000) % 6
    changed = lambda put: F.transform("embedding", lambda x, i: F.when(i == size, put).otherwise(x))
    v = (
        F.when(size == 0, F.slice("embedding", 2, 63)).when(size == 1, F.transform("embedding", lambda x: x * 0)).when(size == 2, changed(F.lit(float("inf")).cast("float")))
        .when(size == 3, changed(F.lit(None).cast("float"))).when(size == 4, F.transform("embedding", lambda x: x * 1000)).otherwise(F.filter("embedding", lambda x: x * first < 10))
    )
    return e.select("vec_id", size.cast("int").alias("size"), V.is_query(v, 64).alias("valid"))


def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MiB of the catalog's vectors as float32 and of its metadata, and both."""
    from quern.functions.numbers import mib

    rows = C.catalog(spark, sf_dir)
    size = F.octet_length("title") + F.octet_length("store")
    found = rows.agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 4).alias("vector_bytes"), F.coalesce(F.avg(size), F.lit(900.0)).alias("mean"))
    vec, meta = mib(F.col("vector_bytes")), mib(F.col("mean") * F.col("n"))
    return found.select("n", F.round(meta, 4).alias("metadata_mib"), F.round(vec, 4).alias("vector_mib"), F.round(vec + meta, 4).alias("total_mib"))


def quality_gate_no_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores for which no product passes the gate."""
    rows = C.products(spark, sf_dir)
    good = curation.quality_gate(rows).select("store").distinct()
    return rows.groupBy("store").agg(F.count("*").alias("n")).join(good.withColumn("ok", F.lit(True)), "store", "left").select(
        "store", "n", F.when(F.col("ok"), "ok").otherwise("no_results").alias("status")
    )


_Q0 = "(SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)"
_SCORE = "round(list_inner_product({e}::double[], {q}) / sqrt(list_inner_product({q}, {q})), 6)"


def score_sql(e: str, q: str) -> str:
    return _SCORE.format(e=e, q=q)


def fold_sql(k: int | str, cap: int, title: str, rk: str) -> str:
    """Curation over ``rk`` (qid, o, product_id, title, store, ...) as a recursive list."""
    x = "c[1 + i % len(c)]"
    return f"""base AS (SELECT qid, list({{'o': o, 't': {title}, 'st': coalesce(trim(store), '')}} ORDER BY o) AS c FROM {rk} GROUP BY qid),
f(qid, c, i, sel, seen, sts) AS (
  SELECT qid, c, 0, []::bigint[], []::varchar[], []::varchar[] FROM base
  UNION ALL
  SELECT qid, c, i + 1, CASE WHEN ok THEN list_append(sel, x.o) ELSE sel END, CASE WHEN ok THEN list_append(seen, x.t) ELSE seen END,
    CASE WHEN ok THEN list_append(sts, x.st) ELSE sts END
  FROM (SELECT *, {x} AS x, len(sel) < {k} AND NOT list_contains(seen, {x}.t)
      AND (i >= len(c) OR {x}.st = '' OR len(list_filter(sts, lambda z: z = {x}.st)) < {cap}) AS ok
    FROM f WHERE i < 2 * len(c)) g),
chosen AS (SELECT qid, unnest(sel) AS o, unnest(range(1, len(sel) + 1)) AS rank FROM f WHERE i = 2 * len(c))"""


TITLE_KEY_SQL = f"coalesce(nullif(trim({C.title_sql('title')}), ''), product_id::varchar)"
_RK_ONE = f"""sc AS (SELECT 0::bigint AS qid, cat.*, {score_sql('embedding', _Q0)} AS score FROM cat),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, product_id) AS o FROM sc) WHERE o <= {POOL})"""


def _recommend_sql(scores: str, first: str) -> str:
    return f"""WITH RECURSIVE {C.CATALOG_SQL},
{scores},
{fold_sql(K, 2, TITLE_KEY_SQL, 'rk')}
SELECT {first}rank::int AS rank, product_id, title, store, score, rating_number, average_rating
FROM chosen JOIN rk USING (qid, o) WHERE rating_number >= 10 AND NOT isnan(average_rating) AND average_rating >= 4.0"""


# The flagship takes its pool from all vectors and then keeps those with a product.
_RK_ALL = f"""sc AS (SELECT 0::bigint AS qid, vec_id, {score_sql('embedding', _Q0)} AS score FROM embeddings),
tp AS (SELECT * FROM sc ORDER BY score DESC, vec_id LIMIT {POOL}),
rk AS (SELECT qid, products.*, score, row_number() OVER (ORDER BY score DESC, product_id) AS o FROM tp JOIN products ON product_id = vec_id)"""
_RK_BATCH = f"""sc AS (SELECT q.vec_id AS qid, cat.*, {score_sql('cat.embedding', 'q.embedding::double[]')} AS score FROM cat, embeddings q WHERE q.vec_id % {EVERY} = 0),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, product_id) AS o FROM sc) WHERE o <= {POOL})"""


def _clamp_sql(kind: str, n: str) -> str:
    return f"(SELECT '{kind}' AS kind, vec_id AS product_id, {score_sql('embedding', _Q0)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {n})"


# What can be a query, from the rule itself: 64 components, all finite, and one that is not zero.
_VALID_SQL = """WITH s AS (SELECT vec_id, embedding AS e, (floor(abs(embedding[1]::double) * 1000) % 6)::int AS size FROM embeddings),
v AS (SELECT vec_id, size, CASE size WHEN 0 THEN e[2:64] WHEN 1 THEN list_transform(e, lambda x: (x * 0)::float)
  WHEN 2 THEN list_concat(e[1:2], ['inf'::float], e[4:64]) WHEN 3 THEN list_concat(e[1:3], [NULL::float], e[5:64]) WHEN 4 THEN list_transform(e, lambda x: (x * 1000)::float)
  ELSE list_filter(e, lambda x: x * e[1] < 10) END AS v FROM s)
SELECT vec_id, size, len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 AS valid FROM v"""
_UNIT = "abs(sqrt(list_inner_product(embedding::double[], embedding::double[])) - 1) <= 0.00101"
_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_SPOT = "vec_id IN (0, n // 2, n - 1)"

QUERIES = {
    "recommend_top8": (recommend_top8, _recommend_sql(_RK_ALL, "")),
    "recommend_batch": (recommend_batch, _recommend_sql(_RK_BATCH, "qid AS query_id, ")),
    "vector_scores_round": (vector_scores_round, f"SELECT vec_id, {score_sql('embedding', _Q0)} AS score FROM embeddings"),
    "vector_topn": (vector_topn, f"SELECT vec_id AS product_id, {score_sql('embedding', _Q0)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {POOL}"),
    "vector_pool_clamp": (vector_pool_clamp, " UNION ALL ".join((_clamp_sql("below_k", "12"), _clamp_sql("above_n", "1000000"), _clamp_sql("usual", str(POOL))))),
    "dedup_by_key": (
        dedup_by_key,
        f"WITH RECURSIVE {C.CATALOG_SQL},\n{_RK_ONE},\n{fold_sql(POOL, POOL, TITLE_KEY_SQL, 'rk')}\nSELECT rank::int AS rank, product_id, title FROM chosen JOIN rk USING (qid, o)",
    ),
    "store_cap": (
        store_cap,
        f"WITH RECURSIVE {C.CATALOG_SQL},\n{_RK_ONE},\n{fold_sql(30, 2, 'product_id::varchar', 'rk')}\nSELECT rank::int AS rank, product_id, store FROM chosen JOIN rk USING (qid, o)",
    ),
    "vector_norm_audit": (
        vector_norm_audit,
        f"""SELECT count(*) AS n, count(*) FILTER (NOT ({_FINITE})) AS not_finite, count(*) FILTER (NOT ({_FINITE} AND {_UNIT})) AS not_unit,
        count(*) FILTER ({_SPOT}) AS spots, count(*) FILTER ({_SPOT} AND NOT ({_FINITE} AND {_UNIT})) AS bad_spots,
        min(len(embedding))::int AS min_dim, max(len(embedding))::int AS max_dim FROM embeddings, (SELECT count(*) AS n FROM embeddings) t""",
    ),
    "vector_l2_normalize": (
        vector_l2_normalize,
        """WITH s AS (SELECT vec_id, embedding::double[] AS e, list_transform(embedding::double[], lambda x: x * 3) AS v FROM embeddings),
        u AS (SELECT vec_id, e, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM s)
        SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS norm, round(list_inner_product(u, e), 6) AS cosine FROM u""",
    ),
    "artifact_alignment": (
        artifact_alignment,
        """SELECT count(*) FILTER (vec_id IS NULL) AS no_vector, count(*) FILTER (p_partkey IS NULL) AS no_product,
        count(*) FILTER (vec_id IS NOT NULL AND p_partkey IS NOT NULL) AS aligned FROM part FULL OUTER JOIN embeddings ON p_partkey = vec_id""",
    ),
    "ordered_zip": (
        ordered_zip,
        f"""WITH {C.CATALOG_SQL} SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS row_index, round(embedding[1]::double, 6) AS first,
        round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 4) AS norm FROM cat""",
    ),
    "query_validation": (query_validation, _VALID_SQL),
    "memory_estimate": (
        memory_estimate,
        f"""WITH {C.CATALOG_SQL}, m AS (SELECT count(*) AS n, sum(len(embedding) * 4) / 1048576.0::double AS v,
        coalesce(avg(strlen(title) + strlen(store)), 900) * count(*) / 1048576.0::double AS d FROM cat)
        SELECT n, round(d, 4) AS metadata_mib, round(v::double, 4) AS vector_mib, round(v::double + d, 4) AS total_mib FROM m""",
    ),
    "quality_gate_no_results": (
        quality_gate_no_results,
        f"""WITH {C.PRODUCTS_SQL} SELECT store, count(*) AS n, CASE WHEN count(*) FILTER (rating_number >= 10 AND average_rating >= 4.0) > 0 THEN 'ok' ELSE 'no_results' END AS status
        FROM products GROUP BY store""",
    ),
}
