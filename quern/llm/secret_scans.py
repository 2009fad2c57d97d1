"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every text is addressed by its SHA-256. The ledger holds a row per (blob, rule version) that
has been scanned; a run scans only pairs that the ledger lacks, one path per blob, and joins
the findings back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import stash, work_dir

# The base rules. Letters of the key words match in either case, spelled out
# because engines differ in which non-ASCII letters fold to ASCII ones.
_KEYS = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")
)
ASSIGN_LEAD = rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_LEAD + r"[A-Za-z0-9+/_.=-]+"
# A run that is too short fails whole, so the lower bounds may stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class Rule:
    kind: str
    version: str
    pattern: str
    #: Matches are dropped unless at least ``least`` characters follow the part that ``lead`` matches.
    lead: str | None = None
    least: int = 0
    #: Whether its spans count for ``base_sha256``.
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (Rule("assign", "1", ASSIGN, ASSIGN_LEAD, 6, base=True), Rule("access", "1", ACCESS, base=True), Rule("hex", "1", HEX, base=True))

#: Columns of a ledger: what was scanned and what was found there, code points, end exclusive.
LEDGER_DDL = "blob binary, rule string, spans array<struct<start:bigint,stop:bigint>>"


def _pieces(text: Column, wanted: Column, rule: Rule, order: int) -> Column:
    """array<struct(rule, order, pos, gap, n, ok)>: for each match, the characters between it
    and the match before, its own length, and whether it stands. One cheap search decides
    whether the text is cut at all."""
    pattern = F.lit(rule.pattern)

    def judge(m: Column) -> Column:
        ok = F.lit(True) if rule.lead is None else F.length(m) - F.length(F.regexp_extract(m, "^" + rule.lead, 0)) >= rule.least
        return F.struct(F.length(m).alias("n"), ok.alias("ok"))

    gaps = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), judge)
    both = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), lambda z: z["m"].isNotNull())
    rows = F.transform(
        both,
        lambda z, i: F.struct(
            F.lit(rule.name).alias("rule"), F.lit(order).alias("order"), i.alias("pos"), z["gap"].alias("gap"), z["m"]["n"].alias("n"), z["m"]["ok"].alias("ok")
        ),
    )
    return F.when(wanted & text.rlike(rule.pattern), rows)


def _count_of(spans: str, order: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["order"] == order)).cast("bigint")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, ledger afterwards).

    Findings: ``key``, blob (hex), a count per rule, base_sha256 (of the base rules' spans) and
    spans (of all rules; kind:start:end by start, then rule order) of every row. A rule's count is
    n_<kind>; where rules share a kind, those that are not base rules have n_<kind>_<version>. A null text is the empty blob;
    a null key is a path like any other; repeated rows get equal findings and are scanned
    once; an empty table gives empty results. Only ``key`` and ``text`` are read.

    The paths of a blob are reduced to one before texts move: blob addresses are grouped
    with a partial aggregate, so a blob with very many paths costs one row per task, and
    the texts to scan are shuffled once by a hash join that builds on the addresses.
    """
    paths, pairs, spans = _scanned(docs, ledger, rules, key, text)
    fresh = _entries(pairs, spans)
    known = spans if ledger is None else spans.unionByName(ledger.select("blob", "rule", "spans"))
    after = fresh if ledger is None else ledger.select("blob", "rule", "spans").unionByName(fresh)
    return _report(paths, known, rules, key), after


def scan_stored(docs: DataFrame, path: str, rules: tuple[Rule, ...] = BASE_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The findings, by way of a ledger stored as Parquet at ``path``, made where there is none.

    What it lacks is scanned and appended, and the findings come from the table read back. An
    append that was cut off has left whole rows or none: the next run scans what is missing.
    Runs at the same time may both append a pair; it counts once.
    """
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER_DDL).write.mode("ignore").parquet(path)
    paths, pairs, spans = _scanned(docs, spark.read.schema(LEDGER_DDL).parquet(path), rules, key, text)
    _entries(pairs, spans).write.mode("append").parquet(path)
    stored = spark.read.schema(LEDGER_DDL).parquet(path)
    known = stored.filter(F.size("spans") > 0).groupBy("blob", "rule").agg(F.first("spans").alias("spans"))
    return _report(paths, known, rules, key)


def stored_report(docs: DataFrame) -> DataFrame:
    """Findings by way of the ledger that spark.quern.secretLedger names. Without that setting every
    call begins a ledger in the shared folder, so that it scans all blobs."""
    spark = docs.sparkSession
    path = spark.conf.get("spark.quern.secretLedger", None) or f"{work_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    return scan_stored(docs, path)


def _scanned(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, blob) of all rows; (blob, rule) pairs that the ledger lacks; and the spans of those that have any."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    address = F.unhex(F.sha2(body, 256))
    paths = stash(docs.select(F.col(f"`{key}`").alias("path"), address.alias("blob")), "secret-paths")
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    pairs = blobs.select("blob", "path", F.explode(F.array(*[F.lit(r.name) for r in rules])).alias("rule"))
    if ledger is None:
        todo = blobs.withColumn("rules", F.array(*[F.lit(r.name) for r in rules]))
    else:
        pairs = pairs.join(ledger.select("blob", "rule"), ["blob", "rule"], "left_anti")
        todo = pairs.groupBy("blob", "path").agg(F.collect_set("rule").alias("rules"))

    todo = todo.select(F.col("blob").alias("to_blob"), F.col("path").alias("to_path"), "rules").hint("shuffle_hash")
    texts = docs.select(F.col(f"`{key}`").alias("path"), body.alias("body"))
    scanned = texts.join(todo, F.col("path").eqNullSafe(F.col("to_path"))).filter(F.col("to_blob") == F.unhex(F.sha2("body", 256)))
    matches = F.flatten(
        F.filter(F.array(*[_pieces(F.col("body"), F.array_contains("rules", r.name), r, i) for i, r in enumerate(rules)]), lambda a: a.isNotNull())
    )
    found = scanned.select(F.col("to_blob").alias("blob"), F.explode(matches).alias("m")).select("blob", "m.*")
    # A path may stand in the table twice with the same text.
    found = found.dropDuplicates(["blob", "rule", "pos"])
    # A match's start: all gaps up to it and all matches before it.
    ahead = "sum(gap + n) over (partition by blob, rule order by pos) - n"
    spans = (
        found.select("blob", "rule", "ok", "n", F.expr(f"{ahead}").alias("start"))
        .filter("ok")
        .groupBy("blob", "rule")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), (F.col("start") + F.col("n")).cast("bigint").alias("stop")))).alias("spans"))
    )
    return paths, pairs, spans


def _entries(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return pairs.select("blob", "rule").join(spans, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", none).alias("spans"))


def _columns(rules: tuple[Rule, ...]) -> list[str]:
    """The names of the rules' counts."""
    shared = [r.kind for r in rules]
    return [f"n_{r.kind}" if r.base or shared.count(r.kind) == 1 else f"n_{r.kind}_{r.version}" for r in rules]


def _report(paths: DataFrame, known: DataFrame, rules: tuple[Rule, ...], key: str) -> DataFrame:
    # A blob's spans of all rules of this run, in order.
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]
    columns = _columns(rules)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["order"]], s["start"], s["stop"])), ",")

    of_blob = (
        known.filter(F.col("rule").isin([r.name for r in rules]))
        .select("blob", F.element_at(place, F.col("rule")).alias("order"), F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct("s.start", "order", "s.stop"))).alias("all"))
        .select(
            F.col("blob").alias("to_blob"),
            *[_count_of("all", i).alias(c) for i, c in enumerate(columns)],
            joined(F.col("all")).alias("spans"),
            joined(F.filter("all", lambda s: s["order"].isin(base))).alias("base_spans"),
        )
    )
    return paths.join(of_blob, F.col("blob") == F.col("to_blob"), "left").select(
        F.col("path").alias(key),
        F.lower(F.hex("blob")).alias("blob"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in columns],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _duck(kind: str, order: int, pattern: str, ok: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, unnest(range(len(m))) AS pos, unnest(m) AS hit, unnest(g[1:len(m)]) AS gap, {ok} AS ok
      FROM (SELECT doc_id, regexp_extract_all(body, '{quoted}') AS m, string_split_regex(body, '{quoted}') AS g FROM d)"""


#: DuckDB twin of the query.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
hits AS ({" UNION ALL ".join((
    _duck("assign", 0, ASSIGN, "length(unnest(m)) - length(regexp_extract(unnest(m), '^" + ASSIGN_LEAD.replace("'", "''") + "')) >= 6"),
    _duck("access", 1, ACCESS, "true"),
    _duck("hex", 2, HEX, "true"),
))}),
placed AS (SELECT doc_id, kind, ord, ok, length(hit) AS n,
  sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, ord ORDER BY pos) - length(hit) AS start FROM hits),
joined AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg(kind || ':' || start::bigint || ':' || (start + n)::bigint, ',' ORDER BY start, ord) AS spans FROM placed WHERE ok GROUP BY doc_id)
SELECT d.doc_id, sha256(d.body) AS blob, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access,
  coalesce(n_hex, 0)::bigint AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)
"""
