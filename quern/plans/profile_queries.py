"""Queries that profile: presence, quantiles, pools, top groups, samples, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.numbers import percent
from quern.operators import ingest as I
from quern.operators import profile as P
from quern.plans import catalog as C

SAMPLE_SEED, SAMPLE_SIZE = "20260506", 8
#: Ratings below which a product counts as having few, in the report of reasons.
WELL_RATED = 30
#: Labels and keywords that occur in the tables' part names.
LEXICON = {"warm": ("red", "orange", "gold"), "cold": ("blue", "green"), "small": ("bolt", "nut", "ring"), "large": ("frame", "gear", "plate")}


def presence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    rules = {
        "text": T.has_text("text"), "lang": T.has_text("lang"), "source": T.has_text("source"), "lines": F.size(T.clean_list(T.first_lines("text"))) > 1,
        "n_chars": F.coalesce(F.col("n_chars") > 0, F.lit(False)), "quality": F.col("quality").isNotNull(), "toxic": F.coalesce(F.col("toxic") != 0, F.lit(False)),
    }
    found = P.presence(rows, rules)
    return found.select("field", "present", "total", percent(F.col("present"), F.col("total")).alias("share"))


_MEASURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}


def quantiles_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.quantiles(C.table(spark, sf_dir, "lineitem"), {k: F.col(v) for k, v in _MEASURES.items()})
    return lines.unionByName(P.quantiles(C.table(spark, sf_dir, "documents"), {"n_chars": F.col("n_chars")}))


def _pool_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    """The products with fixture rules: images, features and descriptions depend on the key."""
    k = F.col("product_id")
    rules = P.pool_rules(T.has_text("title"), k % 7 != 0, k % 5 != 0, k % 3 != 0, F.col("rating_number"), F.col("average_rating"))
    return C.products(spark, sf_dir), rules


def pool_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, rules = _pool_rows(spark, sf_dir)
    return P.pool_members(rows, rules).groupBy("pool").agg(F.count("*").alias("n"), F.sum("product_id").alias("key_sum"))


def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, rules = _pool_rows(spark, sf_dir)
    priced = F.when(F.col("product_id") % 2 == 0, F.col("price"))
    return P.pool_summary(P.pool_members(rows, rules), priced, F.col("store"), T.normalize_title("title"))


def catalog_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest's own rule over all products, which have images and features alike."""
    rows = C.products(spark, sf_dir)
    ok = I.eligible_column(T.has_text("title"), F.lit(True), F.lit(True), F.col("rating_number"), F.col("average_rating"))
    return rows.select("product_id", ok.alias("eligible"))


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by the first rule that they fail, of a report that asks for WELL_RATED ratings, and by the ingest's
    own status, with titles, images and keys absent by fixture."""
    k = F.col("product_id")
    given = (T.has_text(F.when(k % 11 != 0, F.col("title"))), k % 7 != 0, F.lit(True), F.col("rating_number"), F.col("average_rating"))
    reason = F.coalesce(I.reason_column(*given, min_count=WELL_RATED), F.lit("ok"))
    status = I.status_column(F.lit(False), I.eligible_column(*given), k % 13 != 0)
    return C.products(spark, sf_dir).groupBy(reason.alias("reason"), status.alias("status")).agg(F.count("*").alias("n"))


def catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest's own rules over all products, with titles, images, features and keys absent by fixture."""
    k = F.col("product_id")
    rows = C.products(spark, sf_dir)
    eligible = I.eligible_column(T.has_text(F.when(k % 11 != 0, F.col("title"))), k % 7 != 0, k % 5 != 0, F.col("rating_number"), F.col("average_rating"))
    return rows.select("product_id", eligible.alias("eligible"), I.status_column(k % 17 == 0, eligible, k % 13 != 0).alias("status"))


def store_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = F.when(F.col("p_partkey") % 13 == 0, F.lit("")).otherwise(F.col("p_brand"))
    return P.top_groups(C.table(spark, sf_dir, "part"), F.coalesce(F.nullif(store, F.lit("")), F.lit("Unknown")), 10)


def title_dup_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = C.table(spark, sf_dir, "part").groupBy(T.normalize_title("p_name").alias("title")).count()
    share = F.round(F.max("count") / F.sum("count"), 6)
    return titles.agg(F.sum("count").alias("n"), F.count("*").alias("titles"), F.max("count").alias("largest"), share.alias("share"))


def category_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = C.table(spark, sf_dir, "part").select(F.explode(T.categories("p_name", LEXICON)).alias("category"))
    return titles.groupBy("category").agg(F.count("*").alias("n"))


def category_signals_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the whole texts of all documents."""
    texts = C.table(spark, sf_dir, "documents").select(F.explode(T.categories("text")).alias("category"))
    return texts.groupBy("category").agg(F.count("*").alias("n"))


def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.bottom_sample(C.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", SAMPLE_SIZE, SAMPLE_SEED)
    return rows.select("p_partkey", "p_name", "mark")


def compact_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile's sample projection, with titles escaped for Markdown tables."""
    title = T.escape_pipes(F.concat(F.col("title"), F.lit(" | "), F.col("store")))
    rows = P.bottom_sample(C.products(spark, sf_dir), "product_id", SAMPLE_SIZE, SAMPLE_SEED)
    return rows.select("product_id", title.alias("title"), "average_rating", "rating_number", "price")


def pool_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of each candidate pool with all fields that a report shows."""
    rows, rules = _pool_rows(spark, sf_dir)
    k = F.col("product_id")
    features = F.filter(F.array(F.col("title"), F.when(k % 2 == 0, F.lit(" soft "))), lambda x: x.isNotNull())
    shown = P.sample_fields(
        title=F.concat(F.col("title"), F.lit(" | "), F.col("store")), store=F.col("store"), average_rating=F.col("average_rating"), rating_number=F.col("rating_number"),
        price=F.when(k % 2 == 0, F.col("price")), features=F.when(k % 5 != 0, features), description=F.when(k % 3 != 0, F.array(F.col("title"))),
        images=F.when(k % 7 != 0, F.array(F.concat(F.lit("https://img.example/"), k.cast("string")))),
    )
    return P.pool_samples(rows, rules, "product_id", shown, SAMPLE_SIZE, SAMPLE_SEED)


def metadata_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean bytes of the first 500 products' title, store and price as text; 900 without any."""
    size = F.octet_length(F.concat_ws("|", "title", "store", F.format_string("%.2f", F.col("price"))))
    first = C.products(spark, sf_dir).orderBy("product_id").limit(500)
    return first.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(size), F.lit(900.0)), 6).alias("mean_bytes"))


def _presence_sql() -> str:
    rules = {
        "text": "coalesce(regexp_matches(text, '[^\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]'), false)", "lang": "coalesce(trim(lang) <> '', false)", "source": "coalesce(trim(source) <> '', false)",
        "lines": "len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) > 1", "n_chars": "coalesce(n_chars > 0, false)",
        "quality": "quality IS NOT NULL", "toxic": "coalesce(toxic <> 0, false)",
    }
    one = "SELECT '{f}' AS field, count(*) FILTER ({r}) AS present, count(*) AS total, printf('%.2f', count(*) FILTER ({r}) / count(*) * 100) || '%' AS share FROM j"
    parts = " UNION ALL ".join(one.format(f=f, r=r) for f, r in rules.items())
    return f"WITH j AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)) {parts}"


def _quantile_sql() -> str:
    one = """SELECT '{m}' AS measure, p, coalesce(list_sort(list({c})::double[])[1 + round_even((count({c}) - 1) * p, 0)::int], 0) AS value
    FROM {t}, (SELECT unnest([0.5, 0.75, 0.9, 0.95])::double AS p) GROUP BY p"""
    parts = [one.format(m=m, c=c, t="lineitem") for m, c in _MEASURES.items()] + [one.format(m="n_chars", c="n_chars", t="documents")]
    return " UNION ALL ".join(parts)


_POOLS_SQL = f"""WITH {C.PRODUCTS_SQL}, b AS (SELECT *, product_id % 7 <> 0 AS base, product_id % 5 <> 0 AS feats, product_id % 3 <> 0 AS descr,
  coalesce(rating_number, 0) AS rn, coalesce(average_rating, 0) >= 4.0 AS good, {C.title_sql('title')} AS nt FROM products),
m AS (SELECT *, unnest(list_filter([CASE WHEN base THEN 'base_title_image' END, CASE WHEN base AND feats AND rn >= 10 AND good THEN 'preferred_rn10_avg4_features' END,
  CASE WHEN base AND feats AND rn >= 5 AND good THEN 'relaxed_rn5_avg4_features' END, CASE WHEN base AND feats AND rn >= 25 AND good THEN 'strict_rn25_avg4_features' END,
  CASE WHEN base AND (feats OR descr) AND rn >= 10 AND good THEN 'fallback_rn10_avg4_features_or_description' END,
  CASE WHEN base AND feats AND rn >= 10 THEN 'rn10_features_no_avg_floor' END], lambda x: x IS NOT NULL)) AS pool FROM b)"""


def _category_sql(lexicon: dict, source: tuple[str, str]) -> str:
    cases = []
    for label, words in lexicon.items():
        hits = " OR ".join("contains(t, ' {} ')".format(w.replace("'", "''")) for w in words)
        cases.append(f"CASE WHEN {hits} THEN '{label}' END")
    return f"""WITH t AS (SELECT ' ' || lower({source[0]}) || ' ' AS t FROM {source[1]}), l AS (SELECT list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL) AS c FROM t)
    SELECT unnest(CASE WHEN len(c) > 0 THEN c ELSE ['{T.UNCATEGORIZED}'] END) AS category, count(*) AS n FROM l GROUP BY 1"""


_OK = "coalesce(rating_number >= 10, false)"
_GOOD = "coalesce(average_rating >= 4.0, false)"
_MARK = f"md5('{SAMPLE_SEED}|' || {{k}}::varchar)"

QUERIES = {
    "presence_profile": (presence_profile, _presence_sql()),
    "quantiles_nearest_rank": (quantiles_nearest_rank, _quantile_sql()),
    "pool_membership": (pool_membership, f"{_POOLS_SQL} SELECT pool, count(*) AS n, sum(product_id)::bigint AS key_sum FROM m GROUP BY pool"),
    "pool_summary": (
        pool_summary,
        f"""{_POOLS_SQL}, s AS (SELECT pool, coalesce(nullif(store, ''), 'Unknown') AS st, count(*) AS c FROM m GROUP BY ALL),
        t AS (SELECT pool, nt, count(*) AS c FROM m GROUP BY ALL), n AS (SELECT pool, count(*) AS n, count(*) FILTER (product_id % 2 = 0 AND price IS NOT NULL) AS priced FROM m GROUP BY pool)
        SELECT pool, n, priced, round((SELECT max(c) FROM s WHERE s.pool = n.pool) / n, 6) AS top_store_share,
        round((SELECT max(c) FROM t WHERE t.pool = n.pool) / n, 6) AS top_title_share FROM n""",
    ),
    "catalog_eligibility": (catalog_eligibility, f"WITH {C.PRODUCTS_SQL} SELECT product_id, {_OK} AND {_GOOD} AS eligible FROM products"),
    "reject_reasons": (
        reject_reasons,
        f"""WITH {C.PRODUCTS_SQL} SELECT CASE WHEN product_id % 11 = 0 THEN 'no_title' WHEN product_id % 7 = 0 THEN 'no_image'
          WHEN NOT coalesce(rating_number >= {WELL_RATED}, false) THEN 'few_ratings' WHEN NOT {_GOOD} THEN 'low_rating' ELSE 'ok' END AS reason,
        CASE WHEN product_id % 11 = 0 OR product_id % 7 = 0 OR NOT ({_OK} AND {_GOOD}) THEN 'ineligible'
          WHEN product_id % 13 = 0 THEN 'missing_key' ELSE 'ok' END AS status, count(*) AS n FROM products GROUP BY 1, 2""",
    ),
    "catalog_status": (
        catalog_status,
        f"""WITH {C.PRODUCTS_SQL}, e AS (SELECT product_id, product_id % 11 <> 0 AND product_id % 7 <> 0 AND product_id % 5 <> 0 AND coalesce(rating_number >= 10, false)
          AND coalesce(average_rating >= 4.0, false) AS eligible FROM products)
        SELECT product_id, eligible, CASE WHEN product_id % 17 = 0 THEN 'malformed' WHEN NOT eligible THEN 'ineligible' WHEN product_id % 13 = 0 THEN 'missing_key' ELSE 'ok' END AS status FROM e""",
    ),
    "store_topn": (
        store_topn,
        """SELECT coalesce(nullif(CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END, ''), 'Unknown') AS key, count(*) AS count FROM part GROUP BY 1
        ORDER BY count DESC, key LIMIT 10""",
    ),
    "title_dup_share": (
        title_dup_share,
        f"""WITH t AS (SELECT {C.title_sql('p_name')} AS t, count(*) AS c FROM part GROUP BY 1)
        SELECT sum(c)::bigint AS n, count(*) AS titles, max(c) AS largest, round(max(c) / sum(c), 6) AS share FROM t""",
    ),
    "category_signals": (category_signals, _category_sql(LEXICON, ("p_name", "part"))),
    "category_signals_text": (category_signals_text, _category_sql(T.CATEGORY_KEYWORDS, ("text", "documents"))),
    "deterministic_sample": (deterministic_sample, f"SELECT p_partkey, p_name, {_MARK.format(k='p_partkey')} AS mark FROM part ORDER BY mark, p_partkey LIMIT {SAMPLE_SIZE}"),
    "compact_samples": (
        compact_samples,
        f"""WITH {C.PRODUCTS_SQL} SELECT product_id, replace(title || ' | ' || store, '|', '\\|') AS title, average_rating, rating_number, price FROM products
        ORDER BY {_MARK.format(k='product_id')}, product_id LIMIT {SAMPLE_SIZE}""",
    ),
    "pool_samples": (
        pool_samples,
        f"""{_POOLS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY {_MARK.format(k='product_id')}, product_id) AS place FROM m)
        SELECT pool, place::int AS place, product_id, replace(title || ' | ' || store, '|', '\\|') AS title, store, average_rating, rating_number,
        CASE WHEN product_id % 2 = 0 THEN price END AS price, CASE WHEN product_id % 5 = 0 THEN 0 WHEN product_id % 2 = 0 THEN 2 ELSE 1 END::int AS n_features,
        CASE WHEN product_id % 3 = 0 THEN 0 ELSE 1 END::int AS n_description, CASE WHEN product_id % 7 = 0 THEN 0 ELSE 1 END::int AS n_images,
        CASE WHEN product_id % 7 <> 0 THEN 'https://img.example/' || product_id END AS first_image FROM o WHERE place <= {SAMPLE_SIZE}""",
    ),
    "metadata_bytes": (
        metadata_bytes,
        f"""WITH {C.PRODUCTS_SQL}, f AS (SELECT * FROM products ORDER BY product_id LIMIT 500)
        SELECT count(*) AS n, round(coalesce(avg(strlen(concat_ws('|', title, store, printf('%.2f', price)))), 900), 6) AS mean_bytes FROM f""",
    ),
}
