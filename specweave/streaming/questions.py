"""Answering a stream of questions from static knowledge tables (an extension).

Counting a question's matches needs all of them together, so each micro-batch is answered
as a table; the answers of a batch are written once under its number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from specweave.operators.answering import answer_all, indexes


def answer_stream(questions: DataFrame, records: DataFrame, temperature: DataFrame, guidance: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Answer a streaming table of questions into Parquet folders ``path/batch=N``. A batch
    that runs again after a failure replaces its folder."""

    ready = indexes(records, temperature)

    def write(batch: DataFrame, number: int) -> None:
        answer_all(batch, records, temperature, guidance, ready=ready).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_stream_table(questions: DataFrame, records: DataFrame, temperature: DataFrame, guidance: DataFrame) -> DataFrame:
    """A finite table of questions, sent through `answer_stream` by way of the shared folder."""
    from specweave.sources.shared import shared_path

    spark = questions.sparkSession
    root = shared_path(spark, "stream")
    questions.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(questions.schema).parquet(f"{root}/in")
    answer_stream(stream, records, temperature, guidance, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")
