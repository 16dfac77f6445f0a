"""Pairing a growing log of messages into exchanges (an extension).

The log is append-only, so a message's place is the number of messages of its conversation before it.
A conversation's state is that number and, where it is odd, the message that waits for its
partner; a batch never looks at earlier messages again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from specweave.operators.conversation import without_welcome
from specweave.sources.shared import shared_path

PAIR = "conv_id long, pair long, user string, assistant string"
#: Messages so far, and role and text of the one that waits.
STATE = "seen long, role string, text string"


def _pairs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A conversation's messages of one batch, in the order of turns, behind those before."""
    seen, *waiting = state.get if state.exists else (0, None, None)
    rows = [row for batch in batches for row in zip(*(batch[c].astype(object).where(batch[c].notna(), None).tolist() if batch[c].hasnans else batch[c].tolist() for c in ("turn", "role", "text")), strict=True)]
    found = []
    for _, role, text in sorted(rows, key=lambda row: [(v is not None, v) for v in row]):  # nulls first, as Spark orders them
        if seen % 2 == 0:
            waiting = [role, text]
        elif waiting[0] == "user" and role == "assistant":
            found.append((seen // 2, waiting[1], text))
        seen += 1
    state.update((seen, *(waiting if seen % 2 else (None, None))))
    if found:
        pair, user, assistant = zip(*found, strict=True)
        yield pd.DataFrame({"conv_id": pd.array([key[0]] * len(found), dtype="Int64"), "pair": pair, "user": user, "assistant": assistant})


def exchange_stream(messages: DataFrame) -> DataFrame:
    """messages (a stream with ``id``, ``conv_id``, ``turn``, ``role``, ``text``) without the welcome message, in pairs by place, as
    `conversation.exchanges` makes them of the whole log: ``conv_id``, ``pair``, ``user``, ``assistant``.

    Within a batch a conversation's messages go by turn; a batch's messages come behind all of earlier
    batches. The state of a conversation is one message at most; a task holds one
    conversation's messages of one batch at a time."""
    log = without_welcome(messages).select("conv_id", "turn", "role", "text")
    return log.groupBy("conv_id").applyInPandasWithState(_pairs, PAIR, STATE, "append", GroupStateTimeout.NoTimeout)


def write_exchanges(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """`exchange_stream` into Parquet files, each pair once; it ends when the log's present end is reached
    and goes on from there with the same checkpoint."""
    return exchange_stream(messages).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def exchange_stream_table(parts: list[DataFrame]) -> DataFrame:
    """The exchanges of a log that grows by these parts, one after another."""
    spark = parts[0].sparkSession
    root = shared_path(spark, "log")
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        log = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        write_exchanges(log, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(PAIR).parquet(f"{root}/out")
