"""Shared-storage scratch tables and size-checked broadcasts.

Intermediate tables are written below ``spark.checkpoint.dir`` (the folder every executor shares),
so a lost executor costs a re-read, never a recomputation from scratch.  Only where the session
does not name such a folder (tests on one machine) is a local one set.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is heavy in a join if it holds more than one part in so many of the rows: fewer keys than this can be.
HEAVY_KEYS = 10_000
#: Rows of a key that are never cut up.
LIGHT_ROWS = 128
#: Written steps from this size on let the driver look for shuffle files that nothing needs any more.
RELEASE_BYTES = 4 << 20
#: Names that two different things share, at most; expected are none.
MAX_COLLISIONS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; sets a temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


class Scratch:
    """A folder of written tables belonging to one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and return a reader of it: its lineage is cut."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        self.release(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, column: str) -> DataFrame:
        """Like ``save``, in as many buckets of ``column`` as shuffles have partitions: joins on it don't move these rows.

        The table's entry in the catalog is dropped at once; the returned reader keeps what it needs of it.
        """
        self.count += 1
        name = f"lodestone_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.base}/{self.count}")
        writer.bucketBy(buckets, column).saveAsTable(name)
        self.release(f"{self.base}/{self.count}")
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return table

    def release(self, path: str) -> None:
        """Shuffle files go once the driver sees that nothing refers to them; a step that wrote much makes it look now."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if store.getContentSummary(target).getLength() >= RELEASE_BYTES:
            gc.collect()
            self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(conf).delete(target, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting: beyond ``max_rows`` the join shuffles instead.

    ``df`` should be a written table (or cheap), as it is counted once here.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread_join(
    rows: DataFrame, table: DataFrame, key: str, how: str = "inner", sizes: DataFrame | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) on ``key`` by shuffle, though one key may hold any share of ``rows``.

    Heavy keys (of more than 1 / HEAVY_KEYS of all rows) are counted first; their rows are dealt into parts by a hash of
    the columns ``by`` (all of them, if none are named), and ``table`` gives one copy of its row to each part.  The list
    of heavy keys is shorter than HEAVY_KEYS, whatever the rows.  ``sizes``: key and ``n_``, the number of its rows,
    where that is known already.  ``how``: inner, left, left_semi or left_anti.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n_")) if sizes is None else sizes
    total, largest = sizes.agg(F.coalesce(F.sum("n_"), F.lit(0)), F.coalesce(F.max("n_"), F.lit(0))).first()
    most = max(LIGHT_ROWS, total // HEAVY_KEYS)
    if largest <= most:
        return rows.join(table, key, how)
    heavy = sizes.filter(F.col("n_") > most).select(F.col(key).alias("key_"), F.ceil(F.col("n_") / most).cast("int").alias("parts_")).collect()
    kind = T.StructType([T.StructField("key_", rows.schema[key].dataType), T.StructField("parts_", T.IntegerType())])
    listed = F.broadcast(rows.sparkSession.createDataFrame(heavy, kind))

    def parts(df: DataFrame) -> DataFrame:
        return df.join(listed, df[key].eqNullSafe(F.col("key_")), "left").drop("key_").withColumn("parts_", F.coalesce("parts_", F.lit(1)))

    named = [F.col(f"`{c}`") for c in by or rows.columns]
    part = F.when(F.col("parts_") > 1, F.pmod(F.xxhash64(*named), F.col("parts_"))).otherwise(0).cast("int")
    dealt = parts(rows).withColumn("part_", part).drop("parts_")
    copies = parts(table).withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")
    return dealt.join(copies, [key, "part_"], how).drop("part_")


def checked() -> list[Column]:
    """Aggregates of a ``check`` by name, for ``exact_name``."""
    return [F.min("check").alias("check_x"), F.max("check").alias("check_y")]


def exact_name(groups: DataFrame, name: str) -> Column:
    """The 64-bit ``name``, or the 64-bit ``check`` where different checks share a name: no two things go by one name.

    ``groups`` has each name once, with ``checked()``.  Only names that do collide travel through the driver.
    """
    collided = [r[0] for r in groups.filter("check_x <> check_y").select(name).limit(MAX_COLLISIONS + 1).collect()]
    if len(collided) > MAX_COLLISIONS:
        raise RuntimeError(f"over {MAX_COLLISIONS} names are shared by different things")
    return F.when(F.col(name).isin(collided), F.col("check")).otherwise(F.col(name)) if collided else F.col(name)
