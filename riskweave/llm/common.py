"""Helpers shared by the operators: input tables, shared storage, labelled samples."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


ROWS_AT_A_TIME = 256  # rows that a function of lists gets


_memory: list = []  # whose memory a worker keeps, and what is in it


def remembered(owner, fresh):
    """What this worker remembers for ``owner``, at first what ``fresh`` makes.

    A worker lives through many stages and remembers for one of them: what it kept for another
    goes before anything is made for this one.
    """
    if not _memory or _memory[0] is not owner:
        _memory.clear()
        _memory[:] = [owner, fresh()]
    return _memory[1]


def forget() -> None:
    """Let go of what this worker remembers."""
    _memory.clear()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; any others stay unread."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of this session if unset.

    Only a session without that setting, as in tests, gets a folder of its own making.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more.

    Its cleaner acts on collected garbage only, and a driver with little to do collects rarely.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % modulus


def held_out(key: str, modulus: int, rest: int) -> Column:
    """True for ids whose remainder is ``rest``; false for a null id."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    column: str,
    learn: Column,
    rows_per_class: int,
    max_chars: int,
) -> DataFrame:
    """(text, y): at most ``rows_per_class`` labelled documents of each class.

    ``learn`` says which ids may be learnt from. Rows are taken by a hash of the id, so the
    sample does not hang on the order of the input. Texts over ``max_chars`` are left to scoring:
    with the row bound this bounds what a fit sees. A document with several labels counts as the
    largest of them; rows without id, label or text teach nothing.
    """
    classes = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.max(column).alias("y"))
    )
    return ranked_sample(documents, classes, rows_per_class, max_chars)


def ranked_sample(
    documents: DataFrame, classes: DataFrame, rows_per_class: int, max_chars: int
) -> DataFrame:
    """(text, y) of the first ``rows_per_class`` ids of each class, in the order of a hash.

    Only ids and lengths are shuffled. No class is ranked whole, as it may hold most rows: its
    ids are counted, and only those whose hash is low enough for about four times the rows are
    ranked. The ids taken, a bounded number, go to the texts; an id on several rows teaches its
    least text only.
    """
    fitting = documents.select("doc_id", "text").where(F.length("text").between(1, max_chars))
    ids = store(classes.join(fitting.select("doc_id"), "doc_id", "left_semi"), "ids")
    # One row per class, of which a model holds far more.
    sizes = F.broadcast(ids.groupBy("y").agg(F.count("*").alias("size")))
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5  # from 0 to 1, in the order of the hash
    first = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        ids.join(sizes, "y")
        .where(place * F.col("size") <= 4 * rows_per_class + 40)
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= rows_per_class)
        .select("doc_id", "y")
    )
    return (
        fitting.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
        .select("text", "y")
    )


def mapped(df: DataFrame, function, used: tuple[str, ...], added: str, keep: tuple[str, ...] = ()):
    """``df`` with columns ``added`` that ``function`` makes of lists of the columns ``used``.

    Columns that are used leave unless they are in ``keep``; the others pass through as they are.
    A few rows at a time are made into lists, so that a task never holds a whole batch of texts.
    """
    passed = [c for c in df.columns if c not in used or c in keep]
    extra = StructType.fromDDL(added)
    schema = StructType([df.schema[c] for c in passed] + extra.fields)

    def run(batches):
        types = to_arrow_schema(extra)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_A_TIME):
                batch = whole.slice(at, ROWS_AT_A_TIME)
                made = function(*(batch.column(c).to_pylist() for c in used))
                new = [pa.array(m, f.type) for m, f in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in passed] + new, [*passed, *types.names]
                )

    return df.mapInArrow(run, schema)
