"""Pieces that several operators share: batch limits, the shared folder, word hashing."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts of 100 KB then make batches of some 50 MB at most.
BATCH_ROWS = 512
#: Where checkpoints go if the session names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/brindle-shared"


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's default Arrow batch of 10,000 rows, which whole documents would make too large; see also _ship()."""
    _ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send the package to the executors, through Spark, unless the path that they inherit has it."""
    package = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    known = {os.path.realpath(p or ".") for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if app in _shipped or str(package.parent) in known:
        return
    _shipped.add(app)
    with tempfile.TemporaryDirectory() as folder:
        name = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        kept = Path(tempfile.mkdtemp()) / Path(name).name
        shutil.copy(name, kept)
    spark.sparkContext.addPyFile(str(kept))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir. A folder of our own only in a session of one machine that
    names none, as in tests; elsewhere its lack is an error, since executors don't share local folders."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not root and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or LOCAL_SHARED).rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the folders behind frames that stored() made."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def of_text(function: Callable[[str], Any], kind: str, text: str = "text") -> Column:
    """A function of one whole text as a column, in Arrow batches."""

    @F.pandas_udf(kind)  # type: ignore[call-overload]
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([function(x) for x in texts], dtype=bool if kind == "boolean" else object)

    return run(text_of(text))


def where_text(docs: DataFrame, function: Callable[[str], bool], text: str = "text") -> DataFrame:
    """The rows of docs whose text passes, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.where(of_text(function, "boolean", text))


def map_batches(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply a function of column lists, with the state it builds once per task, to each Arrow batch."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(df.sparkSession)
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, out[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, struct)


class WordHash(dict):
    """Word to 63-bit hash, equal on every executor; grows to a bounded number of words and then only looks up."""

    LIMIT = 1 << 17

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1
        if len(self) < self.LIMIT:
            self[word] = value
        return value


_words = WordHash()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: list[str], width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words; a shorter, non-empty text is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : n + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))
