"""A corpus pipeline over ``documents``: toxic texts go, repeated lines go, one of each
near-duplicate group stays, sources are mixed to target weights, texts become piece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. ``run``
writes each stage's rows as Parquet in the shared folder and reads them again for the next.
Rows with null texts pass every stage (empty texts are copies of each other in near-dedup); further columns are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm import line_dedup, mixing, near_dedup, pieces, toxicity
from ratingspark.llm.common import documents, store

#: SQL can express neither the toxicity model nor XXH64 fingerprints nor piece ids.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns from all labelled rows of ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; ``n_chars`` follows the text."""
    done = line_dedup.dedup_lines(docs)
    text = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
            if "n_chars" in docs.columns else None}
    return done.select(*(
        (text[c] if c in text else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest key of every group of texts with 5-word Jaccard similarity of 0.8 or more.

    Candidates are found by joining tries of SimHash fingerprints with themselves; an exact check follows.
    """
    return near_dedup.keep_one_row(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as fitted rates say: each source has the same weight, small languages are raised.

    Documents of a source that is above its weight may go.
    """
    model = mixing.fit_domains(docs, mixing.labelled_domains(spark, docs, sf_dir))
    return mixing.mix_rows(docs, model)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, piece ``ids``, their number, the length of the text and whether they decode to it."""
    return pieces.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("simhash near-dedup", drop_near_copies),
          ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
