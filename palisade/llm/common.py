"""What the corpus operators share: tables, shared storage, Arrow batches, hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of one Arrow batch between the JVM and a Python worker; long texts make batches of few rows.
BATCH_BYTES = 8 << 20

_prepared: weakref.WeakSet = weakref.WeakSet()
_written: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and lets Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context in _prepared:
        return
    _prepared.add(context)
    package = Path(__file__).resolve().parents[1]
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(package.parent) in (os.path.realpath(p) for p in seen if p):
        return
    target = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in package.rglob("*.py"):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if all run on
    this machine, else an error: executors elsewhere couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/palisade-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/palisade-{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back.

    A lost executor then costs the tasks it ran, not the stages before this table.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone; then its owner clears the folder
            continue


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch that returns columns by name, in the schema's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None:
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    binary = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    return [x or b"" for x in binary.to_pylist()]


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-mixed 64-bit function of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + _GOLDEN * np.uint64(2 * seed + 1)
        z = (z ^ (z >> np.uint64(30))) * _MIX_A
        z = (z ^ (z >> np.uint64(27))) * _MIX_B
        return z ^ (z >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, each distinct word hashed once."""
    import pandas as pd

    if not words:
        return np.zeros(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[codes]
