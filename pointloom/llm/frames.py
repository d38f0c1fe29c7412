"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pointloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor costs no result and lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads; others, whatever their names, are pruned from the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def as_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow], schema=arrow)


def map_batches(df: DataFrame, func: Callable[[pa.RecordBatch], Iterator[dict] | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over a function that takes a batch and yields dictionaries of columns."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)
        for batch in batches:
            for columns in func(batch):
                yield as_batch(columns, arrow)

    return df.mapInArrow(run, fields)


def _known(labels: DataFrame, value_col: str, id_col: str) -> DataFrame:
    """(doc_id, value): an id labelled more than once counts with its largest label, a null label not at all."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(value_col).alias("value")).where("doc_id IS NOT NULL AND value IS NOT NULL")
    return known.groupBy("doc_id").agg(F.max("value").alias("value"))


def bounded_sample(labels: DataFrame, value_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids in a fixed pseudo-random order: the documented bound for fitting models."""
    return _known(labels, value_col, id_col).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)


def sample_of_each(labels: DataFrame, value_col: str, most: int, least: int, id_col: str = "doc_id") -> DataFrame:
    """Labelled ids in a fixed pseudo-random order, as many of each value: ``most`` shared among the values, ``least`` at least.

    A rare value is as much in the sample as a common one; Spark limits the ids of a value before it shuffles them.
    """
    known = _known(labels, value_col, id_col)
    each = max(least, most // max(1, known.select("value").distinct().count()))
    turn = F.row_number().over(Window.partitionBy("value").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id"))
    return known.withColumn("_turn", turn).where(F.col("_turn") <= each).drop("_turn")


#: Code points of one text that a model is fitted on, at most: the first ones of a longer text.
FIT_CHARS = 1 << 14


def fitting_rows(docs: DataFrame, sample: DataFrame, most_chars: int = FIT_CHARS) -> DataFrame:
    """(doc_id, text, value) of the sampled ids (doc_id, value), of each text its first ``most_chars`` code points.

    The bound of a text is its own, so that a long one takes no room from others. An id that several documents
    have counts once, with its smallest text.
    """
    texts = id_and_text(docs).where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("doc_id", "value", F.substring("text", 1, most_chars).alias("text"))
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("value").alias("value"))
