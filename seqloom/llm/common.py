"""Shared plumbing of the training-data operators: tables, scratch space, row batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: texts of a few hundred kB then still fit a worker with room to spare.
BATCH_ROWS = 512
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and Python workers that find this package wherever the driver was started."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


_caches: dict[str, Callable[[], object]] = {}


def working(name: str, clear: Callable[[], object] | None = None) -> None:
    """In a worker: work for this operator begins, so what others have cached in the process goes. clear: empties its own."""
    if clear:
        _caches[name] = clear
    for other, empty in _caches.items():
        if other != name:
            empty()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and is one process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        got = sc._jsc.sc().getCheckpointDir()
        if got.isDefined():
            base = got.get()
        elif sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        else:
            base = tempfile.mkdtemp(prefix="seqloom-")
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/seqloom"


def settle(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to shared storage and read it again: cuts the lineage, survives lost executors."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting to remove a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as each ends, not when the driver happens to collect its garbage. For many
    small queries in a row, each run once; one that were run again would have to write them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, as UTF-8 (bytes.split breaks on exactly these six characters)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo the modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, in any letter case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}".lower() in used:
            name = f"_{name}"
        out.append(f"_{name}")
        used.add(out[-1].lower())
    return out


def order_id(column: str) -> Column:
    """The id, never null: rows without one come after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(2**63 - 1))


def sieve(rows: DataFrame, keys: DataFrame, by: list[str], bits: int, inside: bool = True) -> DataFrame:
    """The rows whose columns `by` may be among keys (its columns in the same order), or with inside=False all others. A bitmap of
    `bits` bits at most is broadcast; no row leaves its task. Rows among keys are always inside; the fuller the bitmap, the more
    others are too."""
    at = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(bits)) + 1
    bucket, bitmap = fresh(rows, "bucket", "bitmap")
    place = at(keys.columns)
    maps = keys.select(F.bitmap_bucket_number(place).alias(bucket), F.bitmap_bit_position(place).alias("p")).groupBy(bucket).agg(F.bitmap_construct_agg("p").alias(bitmap))
    own = at(by)
    joined = rows.withColumn(bucket, F.bitmap_bucket_number(own)).join(F.broadcast(maps), bucket, "left")
    spot = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (spot % 8).cast("int")) == 1, F.lit(False))
    return joined.where(found if inside else ~found).select(*rows.columns)
