"""Shared helpers: table access, Arrow batch mapping, shared-folder tables, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import spread
from ..plans.shipping import ship_package

#: Bytes of text handed to a kernel at once; keeps a Python worker's memory flat when texts are long.
CHUNK_BYTES = 4 << 20


#: Arrow batches between Spark and Python, unless the session sets another size.
ARROW_BATCH = "8m"


def lean_batches(spark: SparkSession) -> None:
    """Small Arrow batches: both ends hold a few of them at a time, and texts can be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).lower() in ("67108864b", "64m", "67108864"):  # the default
        spark.conf.set(name, ARROW_BATCH)


def give_back() -> None:
    """In a Python worker: Arrow's buffers from the system's allocator, which returns what is freed."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Without one a local master gets a temporary folder, as in
    tests; on a cluster executors would not see the driver's folder, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: a re-read survives lost executors and starts a new lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that no plan reads any more; what came from them must be written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of phases that are over; only a hint, nothing waits for it.

    Plans die with the first collection, what they alone held with the second."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def pieces(batches, size_of: str, chunk: int = CHUNK_BYTES):
    """Record batches cut into about `chunk` bytes each, whole rows only, by the lengths of a text column."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if batch.nbytes <= 2 * chunk:
            yield batch
            continue
        col = batch.column(batch.schema.get_field_index(size_of))
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            ends = np.cumsum(byte_lengths(col))
        else:
            ends = np.arange(1, n + 1) * (batch.nbytes // n + 1)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + chunk, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def map_rows(df: DataFrame, columns: list[str], kernel, schema: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Run kernel(record batch) -> dict of columns over every batch of df[columns], in Arrow form."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship_package(df.sparkSession)
    lean_batches(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))
    size_of = columns[-1]

    def run(batches):
        give_back()
        for batch in pieces(batches, size_of, chunk):
            out = kernel(batch)
            arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for f in target for v in [out[f.name]]]
            arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as str, null as the empty text."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The text column as UTF-8 bytes, null as the empty text."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [b"" if t is None else t for t in col.to_pylist()]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges, for every id on an edge.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each round is two grouped
    minima and joins, so no group of links is ever collected; rounds grow with the logarithm of the
    longest path.  Each round is a table in the shared folder, so lineage stays short.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = written(e)
    state = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .filter("u <> v")
            .distinct()
        )
        before, e = e, written(small)
        discard(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(e.select(F.col("v"), F.col("v")).distinct())
