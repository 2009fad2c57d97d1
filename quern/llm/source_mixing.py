"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled and laid end to end as a stream of words, cut into
blocks of equal size. A golden-ratio sequence is mapped through the cumulative weights of
the sources: its n-th point says which source fills slot n. The k-th slot of a source takes
the source's k-th block (a second pass begins again at the first), so any stretch of the mix
is close to the target weights.

Every prefix sum is taken in two steps (within runs, then over run totals), so that a source
with a third of all documents is spread over many tasks. Only sizes move, never texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.words import WORD_SQL
from quern.session import discard, stash

#: Fractional parts of the golden ratio and of 2^20 times it: a point keeps its precision for n up to 2^45.
PHI = 0.6180339887498949
PHI_20 = 0.6077874097403509
#: Bits of the md5 digest that order a source's documents.
ORDER_BITS = 60


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)  # of the sources in code-point order, null last, repeating
    share: float = 1.5  # of all words
    cap: int = 2  # times its size that a source, and so a document, is taken at most
    block: int = 1024  # words of a slot
    seed: str = "mix"
    run_rows: int = 20_000  # documents of a run, about
    chunk: int = 1 << 16  # slots ranked together
    cells: int = 4096  # of [0, 1), to find a point's source by an equi-join
    broadcast_rows: int = 50_000  # the sources' cells are broadcast up to this many rows


def _src(name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), name.cast("string")), F.lit("t"))  # null sorts last


def sizes_of(docs: DataFrame, p: Mix, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, src (source as a non-null key), body (the text's hash), size, h (place in the shuffled order), written once."""
    return stash(
        docs.select(
            F.col(f"`{key}`").alias("doc_id"),
            _src(F.col(f"`{source}`")).alias("src"),
            F.xxhash64(f"`{text}`").alias("body"),
            F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD_SQL)), F.lit(0)).cast("bigint").alias("size"),
            F.conv(F.substring(F.md5(F.concat(F.lit(p.seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))), 1, ORDER_BITS // 4), 16, 10)
            .cast("bigint")
            .alias("h"),
        ),
        "mix-sizes",
    )


def targets(sizes: DataFrame, p: Mix) -> DataFrame:
    """src, source_size, target, words (whole words to take), blocks and slots of every source.

    Weighted shares are capped at ``cap`` times the source's size; what is over is shared
    again by weight. In order of cap per weight, the sources before the first uncapped one
    are the capped ones, and that one fixes the words per weight of all others.
    """
    per = _running(sizes.groupBy("src").agg(F.sum("size").alias("source_size")), ["src"], {"rank": F.lit(1)})
    cycle = F.array(*[F.lit(w) for w in p.weights])
    per = per.withColumn("w", F.element_at(cycle, (F.col("rank") % len(p.weights) + 1).cast("int")).cast("double"))
    whole = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    per = per.withColumn("ratio", F.col("source_size") * p.cap / F.col("w"))
    per = _running(per, ["ratio", "src"], {"size_ahead": F.col("source_size"), "w_ahead": F.col("w")})
    level = (F.lit(whole.size * p.share) - F.col("size_ahead") * p.cap) / (F.lit(whole.w) - F.col("w_ahead"))
    per = per.withColumn("level", level)
    level = per.filter("ratio >= level").agg(F.min_by("level", F.struct("ratio", "src"))).first()[0]
    share = F.col("w") * F.lit(level) if level is not None else F.lit(0.0)
    per = per.withColumn("target", F.least(F.col("source_size") * F.lit(float(p.cap)), share))
    words = F.floor("target").cast("bigint")
    blocks = F.ceil(F.col("source_size") / p.block).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("bigint")
    slots = passes * blocks + F.ceil((words - passes * F.col("source_size")) / p.block).cast("bigint")
    return stash(per.select("src", "source_size", "target", words.alias("words"), blocks.alias("blocks"), slots.alias("slots")), "mix-targets")


def _running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name in ``sums``, that value's sum over all rows before, by ``order``. Rows are dealt out
    by range and summed there; what meets in one task is a row for each range."""
    ranged = stash(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranged")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = before.select("_range", *[F.coalesce(F.sum(f"_{name}").over(upto), F.lit(0)).alias(f"_{name}") for name in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({name: F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()}).join(before, "_range")
    return placed.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_range", *[f"_{name}" for name in sums])


def offsets(sizes: DataFrame, p: Mix, twins: bool = False) -> DataFrame:
    """doc_id, src, body, size, at (the words before a document in its source's stream), twin (its number among
    rows that share id, source and text)."""
    runs = max(1, -(-sizes.count() // p.run_rows))
    run = F.floor(F.col("h") / F.lit(float(1 << ORDER_BITS)) * runs).cast("bigint")
    held = sizes.withColumn("run", run)
    totals = held.groupBy("src", "run").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy("src").orderBy("run")) - F.col("total")
    within = F.sum("size").over(Window.partitionBy("src", "run").orderBy("h", "doc_id", "size", "body").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    # Twins share h, and so a run.
    twin = F.row_number().over(Window.partitionBy("src", "run", "h", "doc_id", "body").orderBy("size")) if twins else F.lit(1)
    inner = held.withColumn("within", within).withColumn("twin", twin)
    return inner.join(totals.withColumn("before", before).drop("total"), ["src", "run"]).select(
        "doc_id", "src", "body", "size", (F.col("before") + F.col("within")).cast("bigint").alias("at"), "twin"
    )


def schedule(sources: DataFrame, p: Mix) -> DataFrame:
    """slot (place in the mix), src, k (rank of the slot within its source): all slots of every source.

    A source that the sequence gives fewer points than it has slots gets the rest at the end;
    the sequence's low discrepancy keeps these few.
    """
    spark = sources.sparkSession
    n = sources.agg(F.sum("slots")).first()[0] or 0
    hi = (F.col("ahead") + F.col("slots")) / F.lit(float(max(1, n)))
    lo = hi - F.col("slots") / F.lit(float(max(1, n)))
    spread = _running(sources, ["src"], {"ahead": F.col("slots")}).filter("slots > 0").select("src", "slots", lo.alias("lo"), hi.alias("hi"))
    first, last = (F.greatest(F.lit(0), F.floor(F.col(c) * p.cells)).cast("int") for c in ("lo", "hi"))
    cells = stash(spread.select("src", "slots", "lo", "hi", F.explode(F.sequence(first, last)).alias("cell")), "mix-cells")
    if cells.count() <= p.broadcast_rows:
        cells = F.broadcast(cells)
    high, low = F.shiftright("slot", 20).cast("double"), F.col("slot").bitwiseAND((1 << 20) - 1).cast("double")
    point = high * F.lit(PHI_20) + low * F.lit(PHI)
    points = spark.range(n).select(F.col("id").alias("slot")).withColumn("u", point - F.floor(point))
    points = points.withColumn("cell", F.floor(F.col("u") * p.cells).cast("int")).join(cells, "cell").filter("u >= lo and u < hi")
    points = points.select("slot", "src", "slots", F.floor(F.col("slot") / p.chunk).cast("bigint").alias("chunk"))
    totals = stash(points.groupBy("src", "chunk").agg(F.count("*").alias("total")), "mix-chunks")
    before = F.sum("total").over(Window.partitionBy("src").orderBy("chunk")) - F.col("total")
    rank = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = points.withColumn("rank", rank).join(totals.withColumn("before", before).drop("total"), ["src", "chunk"])
    ranked = ranked.select("slot", "src", (F.col("before") + F.col("rank")).alias("k"), "slots").filter("k < slots").drop("slots")
    given = totals.groupBy("src").agg(F.sum("total").alias("given"))
    late = sources.join(given, "src", "left").select("src", "slots", F.coalesce("given", F.lit(0)).cast("bigint").alias("given")).filter("given < slots")
    late = late.select("src", F.explode(F.sequence("given", F.col("slots") - 1)).alias("k"), "given")
    return ranked.unionByName(late.select((F.lit(n) + F.col("k") - F.col("given")).alias("slot"), "src", "k"))


def mix(docs: DataFrame, p: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    Documents: doc_id, size, source_size, target, taken, n_slots, first_slot of every row.
    Pieces: slot, turn (0 for the first pass), doc_id, start and n (words of the document) in
    the order that the mix has them.

    A null text has no words and is not taken; a null source sorts last; a null or repeated
    doc_id is a document of its own; equal rows may be taken in either order. An empty table,
    or one without words, takes nothing. Other columns are not read. The order depends on
    doc_id, size and seed alone, so reruns agree.
    """
    placed, sources, pieces = _pieces(sizes_of(docs, p, key, text, source), p)
    # A document with words is known by its source and its place there.
    sums = pieces.groupBy("src", "at").agg(F.sum("n").alias("taken"), F.countDistinct("slot").alias("n_slots"), F.min("slot").alias("first_slot"))
    sums = sums.withColumn("some", F.lit(True))
    full = placed.withColumn("some", F.col("size") > 0).join(sums, ["src", "at", "some"], "left")
    documents = full.join(sources.select("src", "source_size", "target"), "src").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"), "first_slot",
    )
    return documents, pieces.drop("src", "at")


def _pieces(sizes: DataFrame, p: Mix, twins: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``offsets``, ``targets``, pieces: slot, turn, doc_id, src, at, start, n)."""
    sources = targets(sizes, p)
    placed = stash(offsets(sizes, p, twins), "mix-offsets")
    discard(sizes)
    size, at = F.col("size"), F.col("at")
    parts = (
        placed.filter("size > 0")
        .select("doc_id", "src", "size", "at", F.explode(F.sequence(F.floor(at / p.block).cast("bigint"), F.floor((at + size - 1) / p.block).cast("bigint"))).alias("block"))
    )
    # Where the source's stream ends in its last pass, the block is cut.
    known = sources.select("src", "source_size", "words", "blocks")
    slots = schedule(sources, p).join(known, "src")
    turn = F.floor(F.col("k") / F.col("blocks")).cast("bigint")
    slots = slots.select("slot", "src", turn.alias("turn"), (F.col("k") - turn * F.col("blocks")).alias("block"), (F.col("words") - turn * F.col("source_size")).alias("limit"))
    begin = F.greatest(at, F.col("block") * p.block)
    end = F.least(at + size, (F.col("block") + 1) * p.block, F.col("limit"))
    pieces = (
        parts.join(slots, ["src", "block"])
        .select("slot", "turn", "doc_id", "src", "at", (begin - at).alias("start"), (end - begin).alias("n"))
        .filter("n > 0")
    )
    return placed, sources, pieces


def _row_key(key: str, src: str, body: str) -> list[Column]:
    """What a row is joined by, without nulls."""
    return [F.coalesce(key, F.lit(0)).alias("k_id"), F.isnull(key).alias("k_null"), F.col(src).alias("k_src"), F.col(body).alias("k_body")]


def mixed_documents(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """``docs`` in the order of the mix: for each pass over a document a row, at the slot of its first
    word; where the source's last pass ends inside it, its first words. Documents not taken are
    left out. Partitions, and the files written of them, are consecutive stretches of the mix.

    A row is known by its id, source and text; rows that share all three are told apart by a
    number, and either may be the one that is taken once more. Texts move twice: to their
    copies, and to their stretches.
    """
    placed, sources, pieces = _pieces(sizes_of(docs, p), p, twins=True)
    copies = pieces.groupBy("src", "at", "turn").agg(F.sum("n").alias("first"), F.min("slot").alias("slot"))
    copies = stash(placed.filter("size > 0").join(copies, ["src", "at"]).select(*_row_key("doc_id", "src", "body"), "twin", "size", "at", "first", "slot"), "mix-copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), _src(F.col("row.source")).alias("src"), F.xxhash64("row.text").alias("body"))
    rows = rows.select("row", *_row_key("id", "src", "body"))
    rows = rows.withColumn("mine", F.row_number().over(Window.partitionBy("k_id", "k_null", "k_src", "k_body").orderBy("k_src")))
    # The number is no key of the join, so that it can use the window's shuffle.
    rows = rows.join(copies, ["k_id", "k_null", "k_src", "k_body"]).filter("mine <= twin and mine >= twin").select("row", "size", "first", "slot", "at")
    # A word together with the space before it: the text up to any word is a prefix of these.
    spaced = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    text = F.when(F.col("first") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(spaced, 1, F.col("first").cast("int")), ""))
    stretches = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = max(1, sources.agg(F.sum("slots")).first()[0] or 0)
    # Slots after the sequence's end belong to the last stretch.
    to = F.least(F.floor(F.col("slot") * stretches / total), F.lit(stretches - 1)).cast("int")
    rows = rows.repartitionById(stretches, to).sortWithinPartitions("slot", "at")
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_slots and first_slot of every document."""
    return mix(docs, p)[0]


_W = ", ".join(map(str, Mix.weights))
_BLOCK = Mix.block
#: DuckDB twin of the query: the slots that the golden-ratio sequence gives each source, the blocks
#: of its stream that stand there, and the words of each document in them.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 't') AS src, coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0)::bigint AS size,
  ('0x' || substr(md5('{Mix.seed}' || coalesce(doc_id::varchar, '')), 1, {ORDER_BITS // 4}))::bigint AS h FROM documents),
s AS (SELECT src, sum(size)::bigint AS source_size, [{_W}][1 + (row_number() OVER (ORDER BY src) - 1) % {len(Mix.weights)}]::double AS w FROM d GROUP BY src),
r AS (SELECT *, source_size * {Mix.cap} / w AS ratio FROM s),
v AS (SELECT *, (sum(source_size) OVER () * {Mix.share}::double
    - {Mix.cap} * coalesce(sum(source_size) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
f AS (SELECT level FROM v WHERE ratio >= level ORDER BY ratio, src LIMIT 1),
t AS (SELECT src, source_size, least(source_size * {Mix.cap}::double, coalesce(w * (SELECT level FROM f), 0)) AS target FROM v),
w AS (SELECT *, floor(target)::bigint AS words, ceil(source_size / {_BLOCK})::bigint AS blocks,
  CASE WHEN source_size > 0 THEN floor(target)::bigint // source_size ELSE 0 END AS passes FROM t),
n AS (SELECT *, (passes * blocks + ceil((words - passes * source_size) / {_BLOCK}))::bigint AS slots FROM w),
share AS (SELECT *, sum(slots) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) / greatest(1, sum(slots) OVER ())::double AS hi,
  slots / greatest(1, sum(slots) OVER ())::double AS wide FROM n),
points AS (SELECT slot, x - floor(x) AS u FROM (SELECT range AS slot, (range >> 20)::double * {PHI_20!r}::double + (range & {(1 << 20) - 1})::double * {PHI!r}::double AS x
  FROM range((SELECT coalesce(sum(slots), 0)::bigint FROM n)))),
ranked AS (SELECT slot, src, slots, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS k FROM points JOIN share ON u >= hi - wide AND u < hi),
given AS (SELECT src, count(*) AS given FROM ranked GROUP BY src),
late AS (SELECT src, coalesce(given, 0) AS given, unnest(range(coalesce(given, 0), slots)) AS k FROM n LEFT JOIN given USING (src)),
slots AS (SELECT slot, src, k FROM ranked WHERE k < slots
  UNION ALL SELECT (SELECT sum(slots) FROM n)::bigint + k - given, src, k FROM late),
o AS (SELECT d.*, source_size, target,
  (sum(size) OVER (PARTITION BY src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::bigint AS place FROM d JOIN t USING (src)),
b AS (SELECT slot, src, k % blocks AS block, words - k // blocks * source_size AS cut FROM slots JOIN n USING (src)),
pieces AS (SELECT o.doc_id, o.src, o.place, slot, least(place + size, (block + 1) * {_BLOCK}, cut) - greatest(place, block * {_BLOCK}) AS n
  FROM (SELECT *, unnest(range(place // {_BLOCK}, (place + size - 1) // {_BLOCK} + 1)) AS block FROM o WHERE size > 0) o JOIN b USING (src, block)),
sums AS (SELECT src, place, true AS spoken, sum(n)::bigint AS taken, count(DISTINCT slot) AS n_slots, min(slot) AS first_slot FROM pieces WHERE n > 0 GROUP BY src, place)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::bigint AS taken, coalesce(n_slots, 0)::bigint AS n_slots, first_slot
FROM (SELECT *, size > 0 AS spoken FROM o) LEFT JOIN sums USING (src, place, spoken)
"""
