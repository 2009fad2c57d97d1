"""Cross-site line dedup, in DataFrame functions only.

A line's spread is the number of distinct sites it stands on. HyperLogLog sketches per line
hash, merged by aggregation, give the spread of all lines; lines near the threshold get an
exact distinct count. A line at or above the threshold is boilerplate: its earliest
occurrence stays, every other one goes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import stash


@dataclass(frozen=True)
class LineDedup:
    min_sites: int = 10
    #: log2 of a sketch's buckets. Its relative error is 1.04 / sqrt(2^log_k); estimates
    #: within six errors of the threshold (and at least 2) are counted exactly.
    log_k: int = 10
    #: Sets of line hashes are broadcast up to this many rows (24 bytes each), else shuffled.
    broadcast_rows: int = 200_000

    @property
    def band(self) -> int:
        return max(2, math.ceil(self.min_sites * 6 * 1.04 / math.sqrt(2**self.log_k)))


# What is trimmed from a line before it is compared.
TRIM = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    """Trimmed lines of a text; null is empty."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda s: F.btrim(s, F.lit(TRIM)))


def _occurrences(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """id, body hash, site, pos, line hash: one row per line that is not blank."""
    body = F.col(f"`{text}`")
    hashed = F.transform(_lines(body), lambda s, i: F.struct(i.alias("pos"), F.when(s != "", F.xxhash64(s)).alias("line")))
    return docs.select(
        F.col(f"`{key}`").alias("id"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("body"),
        F.concat(F.lit("s"), F.col(f"`{site}`")).alias("site"),
        F.explode(F.filter(hashed, lambda h: h["line"].isNotNull())).alias("h"),
    ).select("id", "body", F.coalesce("site", F.lit("n")).alias("site"), "h.*")


def _bounded(side: DataFrame, limit: int) -> DataFrame:
    """A written table, marked for broadcast when it has at most ``limit`` rows."""
    return F.broadcast(side) if side.count() <= limit else side


def boilerplate(docs: DataFrame, p: LineDedup = LineDedup(), key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """line (hash), keeper (id and pos of the earliest occurrence), sites (exact or estimated) of every boilerplate line."""
    lines = _occurrences(docs, key, text, site)
    spread = stash(
        lines.groupBy("line")
        .agg(F.hll_sketch_agg("site", F.lit(p.log_k)).alias("sketch"), F.min(F.struct("id", "pos")).alias("keeper"))
        .select("line", "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= p.min_sites - p.band),
        "line-spread",
    )
    near = spread.filter(F.col("sites") <= p.min_sites + p.band)
    exact = (
        lines.select("line", "site")
        .join(_bounded(near.select("line"), p.broadcast_rows), "line", "left_semi")
        .groupBy("line")
        .agg(F.countDistinct("site").alias("sites"))
        .filter(F.col("sites") >= p.min_sites)
    )
    return near.drop("sites").join(exact, "line").unionByName(spread.filter(F.col("sites") > p.min_sites + p.band))


def dedup_lines(docs: DataFrame, p: LineDedup = LineDedup(), key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with the cleaned text in place, and a struct column ``line_dedup`` (n_lines, n_removed, n_left).

    Lines are compared after trimming; blank lines are never boilerplate and always stay. A
    null text has one blank line and stays null. A null site is a site of its own. The earliest
    occurrence is the one with the smallest (id, position), null ids first; rows that share
    both id and text are one document. Ties cannot arise otherwise. Other columns pass
    through, whatever their names, unless one is called ``line_dedup``, which is replaced.
    Lines are identified by 64-bit hashes.
    """
    plates = stash(boilerplate(docs, p, key, text, site).select("line", "keeper"), "line-plates")
    lines = _occurrences(docs, key, text, site).drop("site")
    gone = (
        lines.join(_bounded(plates, p.broadcast_rows), "line")
        .filter(~F.struct("id", "pos").eqNullSafe(F.col("keeper")))
        .select("id", "body", "pos")
    )
    # One flag per line of the documents that lose any. Positions arrive per document only.
    gone = gone.groupBy("id", "body").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    flags = gone.select(F.col("id").alias("to_id"), F.col("body").alias("to_body"), "gone", F.lit(True).alias("hit"))

    carried = [c for c in docs.columns if c != "line_dedup"]
    body = F.col(f"row.`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"))
    rows = rows.withColumn("body", F.xxhash64(F.coalesce(body, F.lit(""))))
    joined = rows.join(flags, F.col(f"row.`{key}`").eqNullSafe(F.col("to_id")) & (F.col("body") == F.col("to_body")), "left")
    # Kept lines as runs between removed positions: each run is one slice of the line array.
    parts = F.split(body, "\n", -1)
    n_lines = F.size(F.split(F.coalesce(body, F.lit("")), "\n", -1))
    cuts = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(n_lines))
    runs = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("n")))
    runs = F.filter(runs, lambda r: r["n"] > 0)
    # The split text is bound to a lambda's variable: named directly, it would be split anew for every run.
    joined_up = F.transform(
        F.array(parts), lambda whole: F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(whole, r["first"] + 1, r["n"]))), "\n")
    )
    cleaned = F.when(F.col("hit"), F.element_at(joined_up, 1)).otherwise(body)
    removed = F.coalesce(F.size("gone"), F.lit(0))
    out = joined.select("row", cleaned.alias("clean"), n_lines.alias("n_lines"), F.when(F.col("hit"), removed).otherwise(0).alias("n_removed"))
    return out.select(
        *[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in carried],
        F.struct(
            F.col("n_lines").cast("bigint").alias("n_lines"),
            F.col("n_removed").cast("bigint").alias("n_removed"),
            (F.col("n_lines") - F.col("n_removed")).cast("bigint").alias("n_left"),
        ).alias("line_dedup"),
    )


def report(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """doc_id, cleaned text and line counts of every document."""
    return dedup_lines(docs.select("doc_id", "text", "source"), p).select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed")


_TRIM_SQL = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"

#: DuckDB twin of the query.
ORACLE_SQL = f"""
WITH cut AS (SELECT doc_id, coalesce('s' || source, 'n') AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, site, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM cut),
t AS (SELECT *, trim(part, {_TRIM_SQL}) AS line FROM l),
plates AS (SELECT line, min({{'d': doc_id, 'p': pos}}) AS keeper FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {LineDedup().min_sites}),
marked AS (SELECT t.*, plates.line IS NOT NULL AND keeper <> {{'d': doc_id, 'p': pos}} AS gone FROM t LEFT JOIN plates USING (line)),
clean AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY pos) FILTER (NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(clean.text, '') END AS text, n_lines::bigint AS n_lines, n_removed::bigint AS n_removed
FROM documents d JOIN clean USING (doc_id)
"""
