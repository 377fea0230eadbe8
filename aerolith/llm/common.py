"""Helpers shared by the training-data operators: shared scratch tables, folds, sorted Arrow groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.session import scratch_path

LOWER_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder nobody else uses, below the shared ``spark.checkpoint.dir``."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "step", **options) -> DataFrame:
    """Write ``df`` to the shared folder (with the writer's ``options``) and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (Spark does not tell cases apart)."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but those called like one of ``names``, in any case."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written with a number for each row, and that column's name: ids may be null or repeated."""
    name = unused(df, "__row")
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_folder(df.sparkSession, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder made below :func:`fresh_path`."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside are deleted when each has ended: for tables that are written and read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def is_held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True for the fold that nothing is learned from; rows without an id belong to it."""
    return F.coalesce(fold(id_col, modulus) == F.lit(remainder), F.lit(True))


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows: the check made before a broadcast."""
    return df.limit(max_rows + 1).count() <= max_rows


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased (null text: no words)."""
    lowered = F.translate(F.coalesce(text, F.lit("")), *LOWER_AZ)
    return F.array_remove(F.split(lowered, WORD_BREAK), "")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Regroup a partition sorted by ``keys`` so that every table holds whole groups only.

    A group is at most the size the caller has bounded it to; a table has about ``rows`` rows
    or one group, whichever is larger.
    """
    held: list[pa.Table] = []
    n_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n_held += batch.num_rows
        if n_held < rows:
            continue
        t = pa.concat_tables(held).combine_chunks()
        change = group_starts(t, keys)
        cut = int(change[-1])
        if cut:
            yield t.slice(0, cut)
        held, n_held = [t.slice(cut)], t.num_rows - cut
    if n_held:
        yield pa.concat_tables(held).combine_chunks()


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions where a new key begins in a table sorted by ``keys``."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 linked by (left, right): the smallest node each one reaches."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            break
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label
