"""Tables in the folder that all machines of a cluster share, and the number of partitions to deal into."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits a sought id has in sifted(), and most bits in all (8 MB).
BITS_EACH, MOST_BITS = 32, 1 << 26


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session that names none gets one of its own; a cluster must name it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet and read again: a lost executor reads files instead of computing anew, and the plan is cut."""
    spark = df.sparkSession
    path = f"{folder(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    for tables in _passing:
        tables.append(table)
    return table


_passing: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables that saved() writes inside are deleted at the end, but for those that are taken off the list. What is still lazy by then must not read them."""
    tables: list[DataFrame] = []
    _passing.append(tables)
    try:
        yield tables
    finally:
        _passing.remove(tables)
    discard(*tables)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote and no later plan reads."""
    for table in tables:
        hadoop = table.sparkSession._jvm.org.apache.hadoop.fs
        conf = table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for place in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = hadoop.Path(place)
            if f"{folder(table.sparkSession)}/llm/" in place:
                path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of one key together and in runs, a partition holding many keys."""
    return df.repartition(partitions(df.sparkSession), key).sortWithinPartitions(key)


def heavy(keys: DataFrame, rows: int) -> DataFrame:
    """key, salts of the keys (first column) that a task's share of that many rows or more have: salts in proportion to their rows. At most 4 times the partitions for each key that a row has."""
    share = max(1, rows // (4 * partitions(keys.sparkSession)))
    return saved(keys.toDF("key").groupBy("key").count().where(F.col("count") > share).select("key", F.ceil(F.col("count") / share).cast("int").alias("salts")))


def met(rows: DataFrame, table: DataFrame, on: str, spread: str, hot: DataFrame) -> DataFrame:
    """rows, left joined by the column `on` with a table that has it once. Heavy keys (hot: key, salts) and nulls are dealt by the column `spread`, and the table's rows of heavy keys copied for it."""
    n = F.when(F.col(on).isNull(), F.lit(partitions(rows.sparkSession))).otherwise(F.coalesce("salts", F.lit(1)))
    known = hot.withColumnRenamed("key", on)
    dealt_ = rows.join(known, on, "left").withColumn("salt", F.pmod(F.xxhash64(spread), n).cast("int")).drop("salts")
    copies = table.join(known, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt_.join(copies, [on, "salt"], "left").drop("salt")


def sifted(rows: DataFrame, on: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose integer column `on` may be in the first column of ids, and those where it is not for certain, null included. A join then moves the former only.

    The ids' hashes are marked in a bitmap of bounded size, the only thing that is broadcast: at 32 bits an id 3 % of the other rows pass too, with over 2 million ids more of them, up to all.
    """
    bits = min(MOST_BITS, 1 << max(15, (BITS_EACH * ids.count()).bit_length()))

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(bits)) + 1  # Spark's buckets of bits count from 1

    at = place(F.col(ids.columns[0]))
    marks = ids.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__marks"))
    at = place(F.col(on))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substr("__marks", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.col(on).isNotNull() & F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    known = rows.join(F.broadcast(marks), F.bitmap_bucket_number(at) == F.col("__bucket"), "left")
    return known.where(marked).select(rows.columns), known.where(~marked).select(rows.columns)
