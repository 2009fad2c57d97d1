"""Queries over requests, prompts, explanations, batches and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import providers as M
from quern.functions import text as T
from quern.operators import batching, embed_job, explain
from quern.plans import catalog as C
from quern.plans import search_queries as S
from quern.session import work_dir
from quern.sources.files import PRICE_PER_MILLION

DONE_BELOW = 300
REQUEST_TOKENS = 400
BATCH_INPUTS, BATCH_TOKENS = 16, 20_000


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as requests; every 25th asks for too many results."""
    turns = C.table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select(
        "conv_id", "turn", F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("query"), F.when(F.col("conv_id") % 25 == 0, 21).when(F.col("conv_id") % 2 == 0, 5).alias("max_results")
    )


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = explain.validate_requests(_requests(spark, sf_dir))
    return out.select("conv_id", "turn", F.length("query").alias("n"), "max_results", "status")


def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all turns by outcome, with fixture results and failures chosen by conversation."""
    requests = explain.validate_requests(_requests(spark, sf_dir)).withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    results = requests.filter("conv_id % 3 <> 0").select("id")
    errors = requests.filter("conv_id % 7 = 0").select("id", F.when(F.col("conv_id") % 2 == 0, "upstream_error").otherwise("missing_api_key").alias("status"))
    return explain.outcomes(requests, results, "id", errors.distinct()).groupBy("status").agg(F.count("*").alias("n"))


def intent_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.table(spark, sf_dir, "conversations").filter("role = 'user'")
    words = F.split("text", " ")
    raw = turns.select(
        "conv_id", "turn", F.col("text").alias("query"), F.concat(F.lit(" "), words[0], F.lit("\t")).alias("occasion"), F.lit("  ").alias("season"),
        F.lit(None).cast("string").alias("audience"), F.lit("low").alias("price_preference"), F.slice(F.concat(words, F.array(F.lit(" "))), 1, 3).alias("garment_types"),
        F.array(F.lit(" "), F.lit("a "), F.lit("")).alias("attributes"), F.when(F.col("conv_id") % 2 == 0, F.lit(" \n ")).otherwise(F.lit(" own text ")).alias("retrieval_text"),
    )
    c = explain.clean_intent(raw)
    return c.select(
        "conv_id", "turn", "occasion", "season", "audience", "price_preference", F.array_join("garment_types", "|").alias("garments"), F.array_join("attributes", "|").alias("attributes"),
        "retrieval_text", (F.length("retrieval_text").between(1, explain.INTENT_MAX)).alias("fits"),
    )


def query_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", explain.query_prompt(F.col("text")).alias("prompt"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20 products in a row as the ranked products of a query."""
    k = F.col("product_id")
    return C.products(spark, sf_dir).withColumns({"query_id": F.floor(k / 20).cast("bigint"), "rank": (k % 20 + 1).cast("int")})


def explain_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(_ranked(spark, sf_dir))


def _prompts(rows: DataFrame) -> DataFrame:
    text = F.lit(None).cast("string")
    intent = {
        "original_query": F.concat(F.lit("query "), F.col("query_id").cast("string")), "occasion": F.lit(" party "), "season": F.lit(" "), "audience": text, "price_preference": text,
        "garment_types": F.array(F.lit("dress"), F.lit(" "), F.lit(" hat")), "attributes": F.array().cast("array<string>"),
    }
    features = F.transform(F.sequence(F.lit(1), F.col("rank")), lambda i: F.concat(F.lit(" f"), i.cast("string")))
    product = {"title": F.col("title"), "store": F.when(F.col("rank") % 3 != 0, F.col("store")).otherwise(F.lit(" ")), "features": features, "price": F.when(F.col("rank") % 2 == 0, F.col("price"))}
    product |= {"average_rating": F.col("average_rating"), "rating_number": F.col("rating_number")}
    return explain.explain_prompts(rows, ["query_id"], explain.intent_lines(intent), product)


def explanation_merge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integrity(_ranked(spark, sf_dir))


def _integrity(rows: DataFrame) -> DataFrame:
    """Verdicts on explanations that miss, add, repeat or blank a rank."""
    ranked = rows.select("query_id", "rank", "product_id")
    q, r = F.col("query_id"), F.col("rank")
    said = ranked.select(
        "query_id", F.when((q % 5 == 1) & (r == 5), F.lit(99)).when((q % 5 == 2) & (r == 5), F.lit(4)).otherwise(r).alias("rank"),
        F.when((q % 5 == 3) & (r == 2), F.lit(" \n")).otherwise(F.concat(F.lit("  why  "), r.cast("string"), F.lit("\n"))).alias("why_this_matches"), r.alias("place"),
    ).filter(~((q % 5 == 4) & (r == 1)))
    merged, verdicts = explain.merge_explanations(ranked, said, ["query_id"])
    counts = merged.groupBy("query_id").agg(F.count("*").alias("n"), F.min("why_this_matches").alias("first_why"))
    return verdicts.join(counts, "query_id", "left").select("query_id", "verdict", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "first_why")


ERRORS = (
    (1, 429, "Other", "slow down"), (2, 404, "NotFoundError", "no such model"), (3, None, "APITimeoutError", ""), (4, 400, "BadRequestError", "The Model is not found"),
    (5, 400, "BadRequestError", "the input is not found"), (6, 403, "PermissionDeniedError", ""), (7, 401, "AuthenticationError", "model access"), (8, None, None, None), (9, 503, "InternalServerError", ""),
)


def transient_error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as failures of a request: status, class and message by the number in their properties, or a status of their own."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    one = lambda i, kind: F.element_at(F.array(*[F.lit(e[i]).cast(kind) for e in ERRORS]), (k % len(ERRORS) + 1).cast("int"))
    status = F.when(F.col("user_id") % 2 == 0, (400 + F.col("event_id") % 120).cast("int")).otherwise(one(1, "int"))
    rows = C.table(spark, sf_dir, "events").select("event_id", status.alias("status"), one(2, "string").alias("name"), one(3, "string").alias("message"))
    return rows.select("event_id", M.transient_column(F.col("status"), F.col("name")).alias("transient"), M.fallback_column(F.col("name"), F.col("message")).alias("fallback"))


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each user's next attempt waits, by the errors that they have had within the hour."""
    hour = F.date_trunc("hour", "ts")
    errors = C.table(spark, sf_dir, "events").groupBy("user_id", hour.alias("hour")).agg(F.count_if(F.col("event_type") == "error").alias("attempt"))
    return errors.select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "attempt", M.backoff_column(F.col("attempt")).alias("seconds"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), F.coalesce("text", F.lit("")).alias("text"))


def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).select("row_index", T.token_estimate("text").alias("tokens"))
    return batching.batch_ids(rows, "row_index", "tokens", BATCH_INPUTS, BATCH_TOKENS)


def embed_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to embed after a run that stopped; any set of rows may be done."""
    texts = _texts(spark, sf_dir)
    done = texts.filter((F.col("row_index") < DONE_BELOW) | (F.col("row_index") % 10 == 0))
    return embed_job.missing(texts, done, "row_index").select("row_index", T.token_estimate("text").alias("tokens"))


def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.sum(T.token_estimate("text"))
    return _texts(spark, sf_dir).agg(F.count("*").alias("product_count"), tokens.alias("total_tokens"), F.round(tokens / 1e6 * PRICE_PER_MILLION, 6).alias("estimated_cost_usd"))


def embed_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.functions import vectors as V

    texts = _texts(spark, sf_dir)
    found = M.embed_column(texts, M.HashEmbedder(), "row_index", "text")
    return found.select("row_index", F.size("embedding").alias("dimensions"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


def embed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline vectors of all texts, an entry a row where it is not zero."""
    found = M.embed_column(_texts(spark, sf_dir), M.HashEmbedder(), "row_index", "text")
    entries = found.select("row_index", F.posexplode("embedding").alias("axis", "value")).filter("value <> 0")
    return entries.select("row_index", "axis", F.round(F.col("value").cast("double"), 5).alias("value"))


def parse_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    found = explain.clean_intent(M.parse_column(turns, M.LexiconParser(), "id", "text"))
    return found.select("id", "original_query", "audience", F.size("attributes").alias("n_attributes"), "retrieval_text")


def embed_job_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that the embedding job forms of all turns in order, and what they use."""
    turns = C.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), "text")
    axis = [1.0]
    serve = lambda texts: ([axis] * len(texts), [len(texts), sum(map(len, texts))])
    found = embed_job.requests(embed_job.planned(turns, "row_index", BATCH_INPUTS, REQUEST_TOKENS), "row_index", BATCH_INPUTS, REQUEST_TOKENS, serve)
    return found.drop("embedding")


def embed_resume_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding job over two deliveries: first what users say, in waves, then all turns. Each row
    with the run that embedded it; what the first run has is not asked for again."""
    turns = C.table(spark, sf_dir, "conversations")
    texts = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_index"), F.coalesce("text", F.lit("")).alias("text"), "role")
    output = f"{work_dir(spark)}/vectors-{uuid.uuid4().hex}"
    quiet = lambda line: None
    for delivery in (texts.filter("role = 'user'"), texts):
        embed_job.run(spark, delivery.select("row_index", "text"), M.HashEmbedder(), output, max_inputs=BATCH_INPUTS, max_tokens=BATCH_TOKENS, log=quiet, min_waves=4)
    return embed_job.vectors_at(spark, output).select("row_index", F.col("run").cast("int").alias("run"), "estimated_tokens")


def requests_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns as one batch of requests, answered offline: query_id, status, number of results and the first one's product."""
    from quern.pipeline import Recommender

    rows = C.products(spark, sf_dir).withColumnsRenamed({"product_id": "row_index"})
    rows = rows.withColumns({"parent_asin": F.col("row_index").cast("string"), "normalized_title": T.normalize_title("title")})
    rows = rows.withColumns({"image_url": F.lit(None).cast("string"), "features": F.array(F.lit("soft"))})
    vectors = C.vectors(spark, sf_dir).withColumnRenamed("product_id", "row_index")
    asked = _requests(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.lower("query").alias("query"), "max_results")
    answers = Recommender(rows, vectors, M.HashEmbedder(), M.LexiconParser(), M.TemplateExplainer()).answer(asked)
    first = F.try_element_at("results", F.lit(1))
    return answers.select("query_id", "status", F.coalesce(F.size("results"), F.lit(0)).alias("n_results"), first["product"]["parent_asin"].alias("first_asin"))


def explain_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(_ranked(spark, sf_dir))


def _explained(ranked: DataFrame) -> DataFrame:
    """Prompts to explanations to merged rows, offline."""
    ranks = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    prompts = _prompts(ranked).join(ranks, "query_id")
    said = M.explain_column(prompts, M.TemplateExplainer(), "query_id")
    merged, _ = explain.merge_explanations(ranked.select("query_id", "rank", "product_id"), said, ["query_id"])
    return merged


LEXICON = M.LexiconParser()


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_TRIM = r"regexp_replace({c}, '^[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_Q = _TRIM.format(c="'  ' || text || chr(10)")
_REQUESTS = f"""WITH r AS (SELECT conv_id, turn, {_Q} AS query, coalesce(CASE WHEN conv_id % 25 = 0 THEN 21 WHEN conv_id % 2 = 0 THEN 5 END, 8) AS max_results
  FROM conversations WHERE role = 'user'),
v AS (SELECT *, CASE WHEN length(query) BETWEEN 3 AND 500 AND max_results BETWEEN 1 AND 20 THEN 'ok' ELSE 'invalid_request' END AS status FROM r)"""
_RANKED = f"{C.PRODUCTS_SQL}, ranked AS (SELECT *, product_id // 20 AS query_id, (product_id % 20 + 1)::int AS rank FROM products)"
_LISTED = [", ".join("NULL" if e[i] is None else repr(e[i]) for e in ERRORS) for i in range(4)]
_AT = f"[1 + json_extract_string(props, '$.k')::bigint % {len(ERRORS)}]"
_PACK = f"""WITH RECURSIVE t AS (SELECT doc_id, greatest(1, (length(coalesce(text, '')) + 2) // 3)::bigint AS n FROM documents),
c AS (SELECT list(n ORDER BY doc_id) AS c, list(doc_id ORDER BY doc_id) AS d FROM t),
f(i, b, k, s) AS (SELECT 0::bigint, 0::bigint, 0::bigint, 0::bigint UNION ALL
  SELECT i + 1, CASE WHEN new THEN b + 1 ELSE b END, CASE WHEN new THEN 1 ELSE k + 1 END, CASE WHEN new THEN n ELSE s + n END
  FROM (SELECT *, k >= {BATCH_INPUTS} OR (k > 0 AND s + n > {BATCH_TOKENS}) AS new FROM (SELECT f.*, c[i + 1] AS n, len(c) AS total FROM f, c) g WHERE i < total) h)
SELECT d[i] AS row_index, c[i] AS tokens, b AS batch FROM f, c WHERE i > 0"""
# Offline answers from end to end: words hashed to a vector, the best of all vectors, curation by each request's own number, the gate.
_WORDS = r"""w AS (SELECT qid, unnest(regexp_extract_all(lower(query), '[\pL\pN_]+')) AS w FROM k),
h AS (SELECT qid, ('0x' || substr(md5(w), 1, 15))::bigint AS h, count(*) AS c FROM w GROUP BY ALL),
a AS (SELECT qid, h % 64 AS axis, sum(CASE WHEN h >> 59 = 1 THEN c ELSE -c END)::double AS n FROM h GROUP BY 1, 2),
z AS (SELECT k.qid, r.axis, coalesce(a.n, 0) AS n FROM k CROSS JOIN (SELECT unnest(range(64)) AS axis) r LEFT JOIN a ON a.qid = k.qid AND a.axis = r.axis),
y AS (SELECT qid, axis, n, sum(n * n) OVER (PARTITION BY qid) AS ss FROM z),
q AS (SELECT qid, list(CASE WHEN ss > 0 THEN (n / sqrt(ss))::float::double WHEN axis = 0 THEN 1.0 ELSE 0.0 END ORDER BY axis) AS q FROM y GROUP BY qid)"""
_ANSWERED = f"""{_REQUESTS.replace("WITH r AS", "WITH RECURSIVE r AS")}, {C.PRODUCTS_SQL},
k AS (SELECT conv_id || ':' || turn || '|' || max_results AS qid, query FROM v WHERE status = 'ok'), {_WORDS},
sc AS (SELECT qid, vec_id, {S.score_sql("embedding", "q")} AS score FROM q, embeddings),
tp AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 40),
rk AS (SELECT qid, products.*, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, product_id) AS o FROM tp JOIN products ON product_id = vec_id),
{S.fold_sql("split_part(qid, '|', 2)::int", 2, S.TITLE_KEY_SQL, "rk")},
g AS (SELECT qid, count(*) AS n, min_by(product_id, rank) AS first FROM chosen JOIN rk USING (qid, o) WHERE rating_number >= 10 AND NOT isnan(average_rating) AND average_rating >= 4.0 GROUP BY qid)
SELECT conv_id || ':' || turn AS query_id, CASE WHEN status <> 'ok' THEN status WHEN n IS NULL THEN 'no_results' ELSE 'ok' END AS status, coalesce(n, 0)::int AS n_results, first::varchar AS first_asin
FROM v LEFT JOIN g ON g.qid = conv_id || ':' || turn || '|' || max_results"""

QUERIES = {
    "request_validation": (request_validation, f"{_REQUESTS} SELECT conv_id, turn, length(query)::int AS n, max_results, status FROM v"),
    "request_outcomes": (
        request_outcomes,
        f"""{_REQUESTS}, o AS (SELECT CASE WHEN status <> 'ok' THEN status WHEN conv_id % 14 = 0 THEN 'upstream_error' WHEN conv_id % 7 = 0 THEN 'missing_api_key'
        WHEN conv_id % 3 <> 0 THEN 'ok' ELSE 'no_results' END AS status FROM v) SELECT status, count(*) AS n FROM o GROUP BY status""",
    ),
    "intent_clean": (
        intent_clean,
        f"""WITH q AS (SELECT *, {_TRIM.format(c='text')} AS own, string_split(text, ' ') AS w FROM conversations WHERE role = 'user'),
        t AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN own ELSE 'own text' END AS rt,
          list_filter(list_transform((list_append(w, ' '))[1:3], lambda x: {_TRIM.format(c='x')}), lambda x: x <> '') AS g FROM q)
        SELECT conv_id, turn, nullif({_TRIM.format(c='w[1]')}, '') AS occasion, NULL::varchar AS season, NULL::varchar AS audience, 'low' AS price_preference,
        array_to_string(g, '|') AS garments, 'a' AS attributes, rt AS retrieval_text, length(rt) BETWEEN 1 AND 1000 AS fits FROM t""",
    ),
    "query_prompt": (query_prompt, "SELECT conv_id, turn, 'Shopper query: ' || text AS prompt FROM conversations WHERE role = 'user'"),
    "explain_prompt": (
        explain_prompt,
        f"""WITH {_RANKED}, b AS (SELECT query_id, rank, array_to_string(list_filter(['Product rank ' || rank || ':', '- title: ' || title, '- average_rating: ' || printf('%.1f', average_rating),
        '- rating_number: ' || rating_number, CASE WHEN rank % 3 <> 0 THEN '- store: ' || store END, CASE WHEN rank % 2 = 0 THEN '- price: $' || printf('%.2f', price) END, '- features:',
        array_to_string(list_transform(range(1, least(rank, 6) + 1), lambda i: '  - f' || i), chr(10))], lambda x: x IS NOT NULL), chr(10)) AS block FROM ranked)
        SELECT query_id, 'Shopper intent:' || chr(10) || '- original_query: query ' || query_id || chr(10) || '- occasion: party' || chr(10) || '- garment_types: dress, hat' || chr(10) || chr(10)
        || 'Products:' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY rank) AS prompt FROM b GROUP BY query_id""",
    ),
    "explanation_merge_integrity": (
        explanation_merge_integrity,
        f"""WITH {_RANKED}, k AS (SELECT query_id, rank FROM ranked),
        s AS (SELECT query_id, CASE WHEN query_id % 5 = 1 AND rank = 5 THEN 99 WHEN query_id % 5 = 2 AND rank = 5 THEN 4 ELSE rank END AS rank,
          CASE WHEN query_id % 5 = 3 AND rank = 2 THEN NULL ELSE 'why ' || rank END AS why FROM k WHERE NOT (query_id % 5 = 4 AND rank = 1)),
        t AS (SELECT query_id, rank, count(*) AS c, min(why) AS why FROM s WHERE why IS NOT NULL GROUP BY ALL),
        j AS (SELECT coalesce(k.query_id, t.query_id) AS query_id, k.rank AS kr, t.rank AS tr, c, why FROM k FULL OUTER JOIN t ON k.query_id = t.query_id AND k.rank = t.rank),
        v AS (SELECT query_id, CASE WHEN max(c) > 1 THEN 'duplicate_rank' WHEN count(*) FILTER (kr IS NULL OR tr IS NULL) > 0 THEN 'rank_mismatch' ELSE 'ok' END AS verdict,
          count(*) AS n, min(why) AS why FROM j GROUP BY query_id)
        SELECT query_id, verdict, CASE WHEN verdict = 'ok' THEN n ELSE 0 END AS n, CASE WHEN verdict = 'ok' THEN why END AS first_why FROM v""",
    ),
    "transient_error_classify": (
        transient_error_classify,
        f"""WITH r AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 400 + event_id % 120 ELSE [{_LISTED[1]}]{_AT} END AS status, [{_LISTED[2]}]{_AT} AS name, [{_LISTED[3]}]{_AT} AS message FROM events)
        SELECT event_id, coalesce(status IN (408, 409, 429, 500, 502, 503, 504), false) OR coalesce(name IN ('APITimeoutError', 'APIConnectionError', 'RateLimitError', 'InternalServerError'), false) AS transient,
        coalesce(name IN ('NotFoundError', 'PermissionDeniedError') OR (name = 'BadRequestError' AND contains(lower(message), 'model')
        AND regexp_matches(lower(message), '{"|".join(M.MODEL_HINTS)}')), false) AS fallback FROM r""",
    ),
    "backoff_schedule": (
        backoff_schedule,
        """WITH e AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) FILTER (event_type = 'error') AS attempt FROM events GROUP BY ALL)
        SELECT user_id, strftime(h, '%Y-%m-%d %H') AS hour, attempt, least(pow(2, attempt), 30)::int AS seconds FROM e""",
    ),
    "batch_packing": (batch_packing, _PACK),
    "embed_resume": (
        embed_resume,
        f"""SELECT doc_id AS row_index, greatest(1, (length(coalesce(text, '')) + 2) // 3)::bigint AS tokens FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id AND (e.doc_id < {DONE_BELOW} OR e.doc_id % 10 = 0))""",
    ),
    "embed_resume_waves": (
        embed_resume_waves,
        """SELECT conv_id * 1000 + turn AS row_index, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS run,
        greatest(1, (length(coalesce(text, '')) + 2) // 3)::bigint AS estimated_tokens FROM conversations""",
    ),
    "embed_job_batches": (
        embed_job_batches,
        f"""WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS id, length(coalesce(text, '')) AS l, greatest(1, (length(coalesce(text, '')) + 2) // 3)::bigint AS n FROM conversations),
        c AS (SELECT list(n ORDER BY id) AS c, list(id ORDER BY id) AS d, list(l ORDER BY id) AS l FROM t),
        f(i, b, k, s) AS (SELECT 0::bigint, 0::bigint, 0::bigint, 0::bigint UNION ALL
          SELECT i + 1, CASE WHEN new THEN b + 1 ELSE b END, CASE WHEN new THEN 1 ELSE k + 1 END, CASE WHEN new THEN n ELSE s + n END
          FROM (SELECT *, k >= {BATCH_INPUTS} OR (k > 0 AND s + n > {REQUEST_TOKENS}) AS new FROM (SELECT f.*, c[i + 1] AS n, len(c) AS total FROM f, c) g WHERE i < total) h),
        r AS (SELECT d[i] AS row_index, b AS request, c[i] AS estimated_tokens, l[i] AS chars, k FROM f, c WHERE i > 0)
        SELECT row_index, request, estimated_tokens, CASE WHEN k = 1 THEN count(*) OVER (PARTITION BY request) ELSE 0 END::bigint AS prompt_tokens,
          CASE WHEN k = 1 THEN sum(chars) OVER (PARTITION BY request) ELSE 0 END::bigint AS total_tokens FROM r""",
    ),
    "requests_answered": (requests_answered, _ANSWERED),
    "manifest_stats": (
        manifest_stats,
        f"""WITH t AS (SELECT greatest(1, (length(coalesce(text, '')) + 2) // 3)::bigint AS n FROM documents)
        SELECT count(*) AS product_count, sum(n)::bigint AS total_tokens, round(sum(n)::double / 1e6::double * {PRICE_PER_MILLION}::double, 6) AS estimated_cost_usd FROM t""",
    ),
    "embed_offline": (embed_offline, "SELECT doc_id AS row_index, 64 AS dimensions, 1.0::double AS norm FROM documents"),
    "embed_vectors": (
        embed_vectors,
        rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+')) AS w FROM documents),
        h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::bigint AS h, count(*) AS c FROM w GROUP BY ALL),
        a AS (SELECT doc_id, (h % {M.HashEmbedder.dimensions})::int AS axis, sum(CASE WHEN h >> 59 = 1 THEN c ELSE -c END)::double AS n FROM h GROUP BY 1, 2),
        v AS (SELECT *, sum(n * n) OVER (PARTITION BY doc_id) AS ss FROM a WHERE n <> 0)
        SELECT doc_id AS row_index, axis, round((n / sqrt(ss))::float::double, 5) AS value FROM v
        UNION ALL SELECT doc_id, 0, 1.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v)""",
    ),
    "parse_offline": (
        parse_offline,
        rf"""WITH q AS (SELECT conv_id || ':' || turn AS id, {_TRIM.format(c='text')} AS own, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+') AS w
          FROM conversations WHERE role = 'user')
        SELECT id, own AS original_query, list_filter(w, lambda x: x IN ({_quoted(LEXICON.audiences)}))[1] AS audience,
          len(list_filter(w, lambda x: length(x) > 3 AND x NOT IN ({_quoted((*LEXICON.occasions, *LEXICON.seasons, *LEXICON.garments, *LEXICON.audiences))})))::int AS n_attributes,
          coalesce(nullif(array_to_string(w, ' '), ''), own) AS retrieval_text FROM q""",
    ),
    "explain_offline": (explain_offline, f"WITH {_RANKED} SELECT query_id, rank, product_id, 'Matches the request at rank ' || rank || '.' AS why_this_matches FROM ranked"),
}
