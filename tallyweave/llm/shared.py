"""Small helpers of the corpus operators: shared folders, bounded samples, table reading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.textarrays import U64, chunks, distinct, mix

FILTER_BITS = 1 << 25  # of a key filter, whatever the number of keys


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the package that brings the files is asked, on each machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all machines share (``spark.checkpoint.dir``).

    Where a local session names none, as in tests, a temporary folder is set for it; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tallyweave-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []  # paths of the tables that are to go, by open scope


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were stored within it, except those stored to ``outlive`` it; these go with the scope around it, if there is one."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def place(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A new path in the shared folder, which the open scope (or, to outlive it, the one around it) deletes."""
    path = scratch(spark, name)
    if scopes := _scopes[:-1] if outlive else _scopes:
        scopes[-1].append(path)
    return path


def stored(df: DataFrame, name: str, outlive: bool = False, few: bool = False) -> DataFrame:
    """The rows written to the shared folder and read again: they outlive executors, and later uses don't compute them anew.

    ``few`` is for results of a join or an aggregate: their partitions are written by two tasks a core at most, so that small
    ones don't make as many files as there are shuffle partitions.
    """
    path = place(df.sparkSession, name, outlive)
    if few:
        df = df.coalesce(max(8, 2 * df.sparkSession.sparkContext.defaultParallelism))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` returned."""
    for file in df.inputFiles()[:1]:
        _delete(spark, file.rpartition("/")[0])


def hub_join(rows: DataFrame, marks: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with marks, which has one row for each key and in c how many of the rows have it, without c.

    A key that more than a thousandth of the ``total`` of all c has is no shuffle key: there
    are a thousand at most, which are broadcast.
    """
    often = max(1000, total // 1000)
    hubs = F.broadcast(marks.where(F.col("c") > often).drop("c"))
    rest = rows.join(hubs.select(*keys), keys, "left_anti").join(marks.where(F.col("c") <= often).drop("c"), keys)
    return rest.unionByName(rows.join(hubs, keys))


def fold(doc_id: str, folds: int):
    """crc32 of an id's decimal text modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def kept_rows(docs: DataFrame, text_col: str, most: int, keep) -> DataFrame:
    """The rows, with all their columns, for which keep(bytes, offsets) of their texts says so (one bool for each row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, text_col, most):
            yield batch.filter(pa.array(keep(data, offsets), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _filter_places(keys: np.ndarray) -> np.ndarray:
    mixed = mix(keys.astype(np.int64).view(U64))
    return np.stack([(mixed >> U64(s)) % U64(FILTER_BITS) for s in (0, 20, 39)]).astype(np.int64)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over one column of longs, fit to be broadcast.

    It only spares rows a shuffle: what passes is joined with the keys.  The more keys there
    are, the more rows pass; none that is wanted is lost.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = distinct(_filter_places(batch.column(0).to_numpy()).reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(own >> 6), pa.array(np.int64(1) << (own & 63))], names=["word", "bits"])

    found = keys.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return words


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys may be in a key filter."""
    places = _filter_places(keys)
    return (words[places >> 6] >> (places & 63) & 1).astype(bool).all(axis=0)
