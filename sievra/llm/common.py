"""What the operators share: reading tables, written intermediate tables, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import warnings
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

_OWN: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


#: Rows and bytes of an Arrow batch at most, where rows hold texts (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes at most from now on, in this session.

    Frames are run after the call that makes them, so the settings can't be put back here; smaller ones are kept.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key)).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests on one machine), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sievra-")
    return _OWN[app]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The table stays until release() or the end of the driver process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievra-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """How many staged tables there are: what release() takes as `first`."""
    return len(_STAGED)


def release(keep: int = 0, first: int = 0) -> None:
    """Delete the staged tables from the first-th on, but the last `keep`; frames that still read them must not be used afterwards."""
    for spark, path in _STAGED[first : len(_STAGED) - keep]:
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder then outlives us
            return
        _STAGED.remove((spark, path))


atexit.register(release)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def give_back() -> None:
    """Returns freed memory to the system: Python workers are used again by later stages, and keep what they once took."""
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()  # modules stay anyway: later collections pass over them
    trim()


def trim() -> None:
    """Returns freed memory to the system, without a collection."""
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if malloc_trim:
        malloc_trim(0)


def tidy(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives memory back at the end of a task."""

    def run(batches: Iterator) -> Iterator:
        yield from fn(batches)
        give_back()

    return run


def in_batches(fn: Callable[[Iterator], Iterator[pa.Array]], kind: str) -> Callable[..., Column]:
    """A column function in Python over batches of its arguments; the other columns of the rows stay in the JVM."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the kind of function is given by name, not by hints
        return F.arrow_udf(tidy(fn), kind, ArrowUDFType.SCALAR_ITER).asNondeterministic()  # a filter on the column then doesn't run it twice


def of_texts(fn: Callable[[Iterator[list[str]]], Iterator[pa.Array]], kind: str, text: Column, max_bytes: int = 4 << 20) -> Column:
    """A column made from lists of texts in Python."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = in_pieces((pa.RecordBatch.from_arrays([c], ["text"]) for c in columns), "text", max_bytes)
        return fn(piece.column(0).to_pylist() for piece in pieces)

    return in_batches(run, kind)(text)


def in_pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that `column` holds about max_bytes in each at most (one row at least)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        size = batch.column(at).nbytes
        if size <= max_bytes or batch.num_rows <= 1:
            if batch.num_rows:
                yield batch
            continue
        step = max(1, batch.num_rows * max_bytes // size)
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def crc_mod(col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the split that the queries are told to use. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus
