"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies (its source's target over its source's size).  The
documents of a source are laid on a line in a fixed order, each as long as its expected copies; one
random offset per source is added, and a document is emitted once per integer boundary that it crosses.

The order is a two-level one so that no task ever holds a source: a document falls by hash into one of
about sqrt(n) cells of its source, cells lie one after another, and inside a cell documents are sorted by
size (rising in even cells, falling in odd ones), which spreads large documents evenly over the line.
Both the cells of a source and the documents of a cell therefore number about sqrt(n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._scratch import Scratch, broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources is broadcast up to so many rows; larger ones are joined by shuffle.
MAX_BROADCAST_SOURCES = 20_000


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2
) -> DataFrame:
    """One row per source: ``skey, n, source_size, target``.

    Sources in code point order (null last) weigh ``weights``, repeating, and share ``share`` (a fraction)
    of all sizes.  A target stops at ``cap`` times its source's size; what is cut off is shared again by
    weight until no target is above.  All comparisons are in integers, so reruns agree to the bit.
    """
    per = sizes.groupBy("skey").agg(
        F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("source_size")
    )
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last(), "skey")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w.cast("long")).withColumn("cap", cap * F.col("source_size"))
    # Water level: a source is full when the level at which it fills needs no more than the total.
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, 0)
    num, den = share
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(by_level))
        .withColumn("filled", F.sum("cap").over(by_level))
        .withColumn(
            "full",
            den * (F.col("filled") * F.col("weight") + F.col("cap") * F.col("rest")) <= num * F.col("total") * F.col("weight"),
        )
    )
    left = num * F.col("total") - den * F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    share_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * left).cast("double") / (float(den) * share_w)
    )
    return per.withColumn("target", target).select("skey", "n", "source_size", "target")


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
    seed: int = 7,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Copies of each document that the mix takes.

    Returns ``doc_id, source, size, source_size, target, copies, taken``, one row per input row (repeated
    rows and null ids included).  ``size`` counts words; a null or empty text has size 0 and takes nothing.
    A null source is a source of its own, last in order.  A source whose texts are all empty has target 0.
    ``copies`` is 0 to ``cap``; ``taken = copies * size``.  An empty table gives an empty result.  Columns
    other than doc_id, text and source are ignored, whatever their names, but for those in ``keep``, which are carried along.
    """
    scratch = Scratch(spark)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sizes = docs.select("doc_id", "source", *keep, size.alias("size")).withColumn(
        "skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    )
    sizes = scratch.save(sizes.select("doc_id", "source", "skey", "size", *keep))
    targets = scratch.save(source_targets(sizes, weights, share, cap))
    rows = sizes.join(broadcast_if_small(targets, MAX_BROADCAST_SOURCES), "skey")
    rows = rows.withColumn("h", _hash(F.col("doc_id").cast("string"), F.col("size").cast("string"))).withColumn(
        "cell", F.col("h") % F.ceil(F.sqrt("n"))
    )
    # Expected copies before each cell: a prefix sum over about sqrt(n) rows a source.
    before = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("skey", "cell").agg(F.count("*").alias("in_cell"))
    cells = cells.select("skey", "cell", F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("ahead"))
    swing = F.when(F.col("cell") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    in_cell = Window.partitionBy("skey", "cell").orderBy(swing, "h", "doc_id")
    rows = rows.withColumn("nth", F.row_number().over(in_cell)).join(cells, ["skey", "cell"])
    offset = (_hash(F.lit(str(seed)), F.col("skey")) % 1024) / 1024.0
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("ahead") + F.col("nth")
    crossed = F.floor(place * expected + offset) - F.floor((place - 1) * expected + offset)
    copies = F.least(crossed, F.lit(cap)).cast("long")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep
    )


#: Documents whose copies are broadcast at most when a mix is written out; more are joined by shuffle.
MAX_BROADCAST_DOCUMENTS = 1_000_000


def write_mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as its copies say, all columns as they are.

    Rows with equal doc_id, source and text share their copies: one of them stands for all.
    """
    keys = ["doc_id", "source", "text_hash"]
    hashed = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("row"))
    taken = mix_sources(spark, docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash")), keep=("text_hash",), **options)
    taken = taken.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = Scratch(spark).save(taken)
    if not taken.filter("rows > 1").isEmpty():
        hashed = hashed.dropDuplicates(keys)
    taken = broadcast_if_small(taken.filter("copies > 0"), MAX_BROADCAST_DOCUMENTS).alias("t")
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    rows = hashed.alias("d").join(taken, same[0] & same[1] & same[2])
    rows = rows.select("d.row", F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias("copy"))
    return rows.select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 3, 1, 2 and sharing 150 % of all words, at most doubled."""
    return mix_sources(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def mixing_sql(table: str = "documents", seed: int = 7) -> str:
    """DuckDB SQL of the same rows, ``doc_id`` to ``copies``, for a table with doc_id, text and source."""
    h = lambda x: f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM {table}),
per AS (
  SELECT skey, min(source) AS source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey),
weighed AS (
  SELECT *, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST, skey) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM per),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         sum(weight) OVER () - sum(weight) OVER w AS rest, sum(cap) OVER w AS filled
  FROM weighed WINDOW w AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
filled AS (
  SELECT *, 2 * (filled * weight + cap * rest) <= 3 * total * weight AS is_full FROM levels),
targets AS (
  SELECT skey, n, source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * (3 * total - 2 * sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
                   / (2.0::DOUBLE * CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS DOUBLE)) END AS target
  FROM filled),
placed AS (
  SELECT s.*, t.n, t.source_size, t.target,
         {h("concat_ws('|', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))")} AS h
  FROM sized s JOIN targets t USING (skey)),
celled AS (SELECT *, h % CAST(ceil(sqrt(n)) AS BIGINT) AS cell FROM placed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY cell,
         CASE WHEN cell % 2 = 0 THEN size ELSE -size END, h, doc_id) AS place,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS expected,
         ({h(f"concat_ws('|', '{seed}', skey)")} % 1024) / 1024.0::DOUBLE AS u
  FROM celled),
counted AS (
  SELECT *, CAST(least(floor(place * expected + u) - floor((place - 1) * expected + u), 2) AS BIGINT) AS copies FROM ranked)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted
"""
