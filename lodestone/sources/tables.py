"""Readers and writers: snapshots, JSON lines, text, partitioned Parquet, databases; optional columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_columns(table: DataFrame, schema: str) -> DataFrame:
    """``table`` with exactly the columns of ``schema``; those that it lacks are null."""
    kinds = table.sparkSession.createDataFrame([], schema).schema
    held = {c.lower() for c in table.columns}
    return table.select(*[(F.col(f.name) if f.name.lower() in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of rows with ids: rows without one are dropped, the last of a repeated id wins."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).filter("id IS NOT NULL")
    rows = rows.withColumn("at_", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    rest = [c for c in rows.columns if c not in ("id", "at_")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "at_").alias("row")).select("id", "row.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(schema).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``name, size, content`` of whole text files."""
    rows = spark.read.option("wholetext", True).text(path).withColumn("path", F.input_file_name())
    return rows.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.octet_length("value").alias("size"), F.col("value").alias("content"))


def key_bounds(spark: SparkSession, url: str, table: str, key: str, options: dict[str, str] | None = None) -> tuple[str, str] | None:
    """The smallest and largest ``key`` of a database table, asked of the database; none where no row has one."""
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    asked = f"SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {table} keyed"
    found = spark.read.format("jdbc").options(**(options or {})).option("url", url).option("query", asked).load().first()
    return None if found is None or found[0] is None else (str(found[0]), str(found[1]))


def read_database(spark: SparkSession, url: str, table: str, schema: str, key: str | None = None, parts: int = 16, options: dict[str, str] | None = None) -> DataFrame:
    """A database table as the columns of ``schema``; those that it lacks are null.

    Which columns there are is probed from the table.  With a ``key`` (numeric, date or timestamp; compared without case) the
    table is read in ``parts`` ranges between its bounds, which the database is asked for; rows without a key come with the
    first range.  Only the columns of ``schema``, and filters on them, are asked of the database.
    """
    reader = spark.read.format("jdbc").options(**(options or {})).option("url", url).option("dbtable", table)
    held = reader.load()
    if key:
        name = next((c for c in held.columns if c.lower() == key.lower()), None)
        if name is None:
            raise ValueError(f"{table} has no column {key}")
        bounds = key_bounds(spark, url, table, name, options)
        if bounds:
            ranged = reader.option("partitionColumn", name).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
            held = ranged.option("numPartitions", parts).load()
    return with_columns(held, schema)


def export_snapshot(table: DataFrame, path: str, renames: dict[str, str] | None = None) -> None:
    """Rows in order of id as JSON lines, columns renamed."""
    for old, new in (renames or {}).items():
        table = table.withColumnRenamed(old, new)
    table.orderBy("id").write.mode("overwrite").json(path)


def append_partitioned(table: DataFrame, path: str, by: str) -> None:
    """Append to a Parquet log, one folder a value of ``by``."""
    table.repartition(by).write.mode("append").partitionBy(by).parquet(path)


def report_json(scores: DataFrame) -> DataFrame:
    """``audit_id, report``: each audit's row as JSON, nulls left out."""
    return scores.select("audit_id", F.to_json(F.struct("*")).alias("report"))


def report_markdown(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """``audit_id, report``: grade, score and issues of each audit as Markdown."""
    line = F.format_string("%d. **%s** %s (%s)", "rank", "check_id", "status", "severity")
    listed = issues.groupBy("audit_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    rows = scores.join(listed, "audit_id", "left")
    body = F.array_join(F.transform(F.coalesce("lines", F.array()), lambda x: x["line"]), "\n")
    head = F.format_string("# Audit %s\n\nGrade %s, score %s\n\n", F.col("audit_id").cast("string"), "grade", F.coalesce(F.col("pcr").cast("string"), F.lit("none")))
    return rows.select("audit_id", F.concat(head, body).alias("report"))
