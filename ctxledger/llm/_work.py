"""Session helpers of the corpus operators: shared folders, materialising, tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a temporary folder takes its place in local mode only;
    on a cluster, whose machines share no local folder, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master or 'the cluster'} share")
        base = getattr(spark, "_ctxledger_scratch", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="spark-ctxledger-")
            spark._ctxledger_scratch = base
    if ":/" not in base:  # tasks read and write there too, so the store must be named
        base = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared Parquet table and read it back: cuts the lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def written(df: DataFrame, name: str) -> str:
    """The path of a shared Parquet table that ``df`` is written to."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a shared table that no later step reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_columns(path: str, columns: list[str], **equal):
    """Columns of a shared Parquet table as numpy arrays, of the rows where ``equal`` holds; for models of a bounded size, inside a task.

    Read one batch after another without threads, so that it takes little more memory than the arrays.
    """
    import numpy as np
    import pyarrow as pa
    from pyarrow import dataset, fs

    store, base = fs.FileSystem.from_uri(path)
    where = None
    for name, value in equal.items():
        where = dataset.field(name) == value
    rows = dataset.dataset(base, filesystem=store, format="parquet").to_batches(columns=columns, filter=where, use_threads=False, batch_readahead=0, fragment_readahead=0, batch_size=65_536)
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in rows if b.num_rows]
    out = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(columns))]
    del parts, rows
    pa.default_memory_pool().release_unused()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """Rows of ``counts`` whose count reaches the lowest threshold that at most ``most`` rows reach.

    The threshold comes from a histogram of counts in 64 steps per octave (a few
    thousand rows whatever the table), so the rows asked for are the only ones that
    travel: sorting would send every task's own ``most`` rows to the driver.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 64).cast("int")
    steps = sorted(((r["s"], r["c"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, None
    for s, c in steps:
        if total + c > most:
            break
        total, least = total + c, s
    return counts.where(F.lit(False)) if least is None else counts.where(step >= least)


def first_rows(df: DataFrame, most: int, n: str, key: str) -> DataFrame:
    """The ``most`` rows of greatest ``n``, ties by a hash of ``key``, then ``key``: exactly ``most`` if there are so many.

    As in most_frequent, a histogram of ``n`` bounds what is sorted: the steps that
    fit are taken whole, and only rows of the step that overflows are put in order.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 64).cast("int")
    steps = sorted(((r["s"], r["c"]) for r in df.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total = 0
    for s, c in steps:
        if total + c > most:
            edge = df.where(step == s).orderBy(F.desc(n), F.xxhash64(key), key).limit(most - total)
            return df.where(step > s).unionByName(edge)
        total += c
    return df


def smallest_hashes(df: DataFrame, columns: list[str], most: int, total: int, salt: int) -> DataFrame:
    """``columns`` of the ``most`` rows of least hash of the first column, all of ``total`` rows if there are no more.

    A bound on the hash lets about twice as many rows through before they are put in
    order, so that a large table is never sorted. Ties go by the columns in order.
    """
    rows = df.select(*columns)
    if total <= most:
        return rows
    hashed = F.xxhash64(columns[0], F.lit(salt))
    bound = min(2**63 - 1, int((2 * most + 100) / total * 2**64) - 2**63)
    return rows.where(hashed <= bound).orderBy(hashed, *columns).limit(most)
