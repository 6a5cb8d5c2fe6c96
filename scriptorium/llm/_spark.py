"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, one beside
    the warehouse. On a cluster that must not be on one machine's disk."""
    setting = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if setting:
        return setting
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not spark.sparkContext.master.startswith("local") and base.split(":")[0] in ("file", base):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base


#: Folders that saved() has made and nobody has removed.
_made: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it again.

    Unlike localCheckpoint it survives lost executors. The folder belongs to the
    session: the cluster's owner clears spark.checkpoint.dir as for checkpoint(), or
    remove() does.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """Folders of saved tables that still exist."""
    return list(_made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes saved tables that nothing will read any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _made.remove(path)


def remainder(column, n: int):
    """crc32 of the column as text, modulo n; null ids count as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")), F.lit(n))


def hashed_sample(df: DataFrame, key: str, limit: int, seed: str) -> DataFrame:
    """About ``limit`` rows (never more than ``limit``) with the smallest hashes of
    ``key``: a fixed sample for fitting models, whatever the partitioning."""
    n = df.count()
    order = F.xxhash64(F.lit(seed), F.col(key))
    if n > limit:
        share = 1.2 * limit / n
        df = df.where(order < F.lit(int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1))
    return df.orderBy(order, key).limit(limit)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tidy() -> None:
    """Gives memory that a worker has freed back to the system, where its C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def append(df: DataFrame, compute, fields: str, text: str | None = None, limit: int = 1 << 20) -> DataFrame:
    """df with more columns from ``compute(record_batch) -> list of arrays``, one
    batch at a time; where ``text`` names a column, batches are cut to about ``limit``
    bytes of it, so that neither side holds results of more. Input columns of the same
    names (in any case) are replaced."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(fields)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in names]
    keep = [f.name for f in kept]
    types = [f.type for f in to_arrow_schema(StructType(list(new.fields)))]
    out_names = [*keep, *(f.name for f in new)]

    def run(batches):
        for batch in (part for whole in batches for part in (_text.pieces(whole, named(whole, text), limit) if text else [whole])):
            arrays = compute(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(a if isinstance(a, pa.Array) and a.type == t else pa.array(a, t) for a, t in zip(arrays, types, strict=True))], names=out_names)
        tidy()

    return df.mapInArrow(run, StructType([*kept, *new.fields]))


def named(batch, name: str) -> str:
    """The batch's own name of a column that is named in any case."""
    return next(x for x in batch.schema.names if x.lower() == name.lower())


def column(batch, name: str):
    """A column by its name in any case."""
    return batch.column(named(batch, name))
