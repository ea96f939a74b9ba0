"""Session settings, the shared folder, and guards for broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it was measured and has at most so many rows and so many bytes of values.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: A key is hot if it holds more than one row in HOT_SHARE of all; there are at most HOT_SHARE such keys, whatever the data.
HOT_SHARE = 1000
#: Fewer rows than this aren't worth a way of their own, whatever their share.
HOT_ROWS = 100_000
SALTS = 32


def build(app: str = "lexiloom", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false"}
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where the session names none, a temporary one on a local master, as in tests; an error on any other."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not at and held.isDefined():
        return held.get()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lexiloom-")
    if not held.isDefined():
        sc.setCheckpointDir(at)
    return at


#: Rows and bytes of values of tables that `cut` wrote.
_measured: WeakKeyDictionary[DataFrame, tuple[int, int]] = WeakKeyDictionary()
_scopes: list[list] = []


def _width(df: DataFrame) -> Column:
    """Bytes of a row's values: strings and binaries by length, nested ones by their text, others as 8."""
    one = lambda f: F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(8)
    nested = lambda f: F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    parts = [nested(f) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else one(f) for f in df.schema.fields]
    total = F.lit(0)
    for p in parts:
        total = total + p
    return total.cast("bigint")


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and goes on from there: what follows survives the loss of executors. The table's
    rows and bytes are measured as it is written. It is removed with the `scope` it was made in, or by the file system when the application ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    seen = Observation()
    flat = not any(isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) for f in df.schema.fields)
    size = F.coalesce(F.sum(_width(df)), F.lit(0)) if flat else F.lit(-1)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), size.alias("bytes")).write.option("compression", "zstd").parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(at)
    _measured[out] = (seen.get["rows"], seen.get["bytes"])
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written by `cut` inside are removed at the end; use their results before it."""
    _scopes.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            path.getFileSystem(conf).delete(path, True)


def rows_of(df: DataFrame) -> int:
    """Rows of a table; those of one that `cut` wrote are known."""
    return _measured[df][0] if df in _measured else df.count()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is measured to be small, else df, for a shuffled join.

    A table that `cut` wrote was measured then; any other is counted here, up to rows + 1 rows.
    """
    n, m = _measured.get(df, (0, -1))
    if n <= rows and m < 0:
        r = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
        n, m = r[0], r[1]
    return F.broadcast(df) if n <= rows and m <= size else df


def hot_keys(rows: DataFrame, key: str, least: int = HOT_ROWS) -> list:
    """Keys with more than one row in HOT_SHARE of all and more than `least` rows: at most HOT_SHARE, whatever the data."""
    return hot_of(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, least)


def hot_of(counts: DataFrame, key: str, least: int = HOT_ROWS) -> list:
    """hot_keys of counted rows: (key, n), a row a key."""
    hot = counts.where((F.col("n") > least) & (F.col("n") > counts.agg(F.sum("n") / HOT_SHARE).scalar()))
    return [r[0] for r in hot.select(key).limit(HOT_SHARE).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, weight: Column) -> DataFrame:
    """Inner equi-join on key of a left side with hot keys and a right side with few rows a key.

    weight (of right) is the number of left rows that a key has. Keys above 1/HOT_SHARE of all left rows, at most
    HOT_SHARE of them by arithmetic, are spread over SALTS partitions by the hash of `spread` (of left); their right rows
    are repeated as often. Other keys are joined as they stand. A NULL key joins nothing.
    """
    w = right.select(F.col(key).alias("_hot"), weight.cast("double").alias("_w"))
    hot = F.broadcast(w.where(F.col("_w") > w.agg(F.sum("_w") / HOT_SHARE).scalar()).select("_hot", F.lit(True).alias("_is_hot")).distinct())
    salt = F.when(F.col("_is_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    lhs = left.join(hot, left[key] == hot["_hot"], "left").withColumn("_salt", salt).drop("_hot", "_is_hot")
    rhs = right.join(hot, right[key] == hot["_hot"], "left")
    rhs = rhs.withColumn("_salt", F.explode(F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot", "_is_hot")
    return lhs.join(rhs, [key, "_salt"]).drop("_salt")


def flagged(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left with the columns of right, which has one row a key: a left join whose hot keys travel nowhere.

    A small right side is broadcast. Otherwise the rows of hot keys (at most HOT_SHARE keys) meet their few right rows by broadcast
    and only the rest is shuffled.
    """
    small = broadcast_if_small(right)
    if small is not right:
        return left.join(small, on, "left")
    h = lambda d: d.withColumn("_h", F.xxhash64(*on))
    lhs, rhs = h(left), h(right).withColumnRenamed("_h", "_g")
    hot = hot_keys(lhs.select("_h"), "_h")
    if not hot:
        return left.join(right, on, "left")
    near = lhs.where(F.col("_h").isin(hot)).join(F.broadcast(rhs.where(F.col("_g").isin(hot))), on, "left")
    far = lhs.where(~F.col("_h").isin(hot)).join(rhs.where(~F.col("_g").isin(hot)), on, "left")
    return near.unionByName(far).drop("_h", "_g")


def joined(left: DataFrame, right: DataFrame, key: str, spread: Column, weight: Column) -> DataFrame:
    """As salted_join; a right side that `cut` measured to be small is broadcast instead, so the left one stays where it lies."""
    if _measured.get(right, (BROADCAST_ROWS + 1, 0))[0] <= BROADCAST_ROWS:
        small = broadcast_if_small(right)
        if small is not right:
            return left.join(small, key)
    return salted_join(left, right, key, spread, weight)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lexiloom-"), "lexiloom"), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(made)
    _shipped.add(app)
