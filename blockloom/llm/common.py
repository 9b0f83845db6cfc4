"""Shared plumbing of the operators: tables, scratch space and Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch, and bytes of it that an operator works on at once: they bound a worker's memory.
ARROW_ROWS, PIECE_BYTES = 256, 8 << 20
#: Words of 64 bits in the bitmap of sieved(), at most that many rows of which are broadcast.
SIEVE_WORDS = 1 << 17
#: Spark's setting that shuffle files are deleted when the SQL execution that made them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="blockloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends, if nothing has deleted it before."""
    path = f"{shared_dir(spark)}/blockloom-{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is only scratch
        return


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors,
    and gives the optimizer real sizes, so it broadcasts a side only below its threshold."""
    spark = df.sparkSession
    path = scratch(spark, what)
    # The files of the write's own shuffles go as it ends: nothing reads them once the table is there.
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)


def sieved(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows with __maybe: false where key is certainly not in ids (a column of the same name), for joins that then move few rows.

    Of a bitmap of 64 * SIEVE_WORDS bits one is set for each id's hash. It is bounded, so a large ids only sieves less. Null
    keys are false.
    """
    hashed = F.xxhash64(key)
    word = F.floor(F.pmod(hashed, F.lit(64 * SIEVE_WORDS)) / 64)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hashed, F.lit(64)).cast("int"))
    words = ids.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    there = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False)) & F.col(key).isNotNull()
    out = rows.withColumn("__word", word).join(F.broadcast(words), "__word", "left")
    return out.withColumn("__maybe", there).drop("__word", "__bits")


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Left semi join of rows with ids; few other rows are moved."""
    return sieved(rows, ids, key).filter("__maybe").drop("__maybe").join(ids, key, "left_semi")


def not_among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Left anti join of rows with ids; few other rows are moved."""
    marked = sieved(rows, ids, key)
    return marked.filter("NOT __maybe").unionByName(marked.filter("__maybe").join(ids, key, "left_anti")).select(rows.columns)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size to rows, if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def pieces(batches: Iterator) -> Iterator:
    """The rows of the batches, PIECE_BYTES at a time (a larger row on its own)."""
    for batch in batches:
        if batch.num_rows < 2 or batch.nbytes <= PIECE_BYTES:
            yield batch
            continue
        half = batch.num_rows // 2
        yield from pieces([batch.slice(0, half), batch.slice(half)])


def map_batches(df: DataFrame, fn: Callable, fields: list[T.StructField], keep: list[str] | None = None, rows: int = ARROW_ROWS) -> DataFrame:
    """Add columns that fn(batch) -> list of Arrow arrays computes; input columns of the same names are replaced."""
    import pyarrow as pa

    new = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    names = [f.name for f in kept] + new
    small_batches(df.sparkSession, rows)

    def run(batches: Iterator) -> Iterator:
        for batch in pieces(batches):
            added = fn(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f)) for f in names[: len(kept)]] + added, names)

    return df.mapInArrow(run, T.StructType(kept + fields))


def text_of(batch, name: str) -> Iterator[str]:
    """Texts of a batch, null as empty."""
    for x in batch.column(batch.schema.get_field_index(name)):
        yield x.as_py() or ""


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls that tells a null source from any string; nulls sort last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))
