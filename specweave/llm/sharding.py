"""Sharding by vector bin packing of bytes, tokens and rows.

Documents of equal text form a group, which is placed as one. A group has a vector
(bytes, tokens, rows). Groups are placed one after another, largest first, each on the
shard whose residual capacity has the highest dot product with the group's vector, among
those shards that still have room for it.

Groups of one size class count as equal: bytes and rows are cut to their five leading bits and
tokens go by their ratio to the bytes, in 32nds. A class has the mean vector of its groups,
and placing its m groups one by one gives each shard a number of them. Since every group of
a class lowers a shard's product by the same amount, these numbers follow without m steps:
they are the m highest of all products that come up (`deal`). The groups of a class, in the
order of their hashes, then go to the shards by these numbers. So there is one rule for
tables of any size: the driver sees one row a class, whose number depends on the range of
sizes alone, some thousands in practice, while the groups stay in their tables.

A group that by itself has over ``WHOLE`` times the bytes of a fair share cannot lie in one
shard of about equal size; it is cut by row into as many parts as fair shares need, which
are placed like groups. All other groups stay whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.common import BROADCAST_ROWS, boxed, hot_keys, lookup, quoted, shuffled, sized, stored, unboxed, word_count

WHOLE = 1.25

#: Rows of a shard, bytes where texts go along, and groups of a class that are numbered in one run.
RUN_ROWS = 200_000
RUN_GROUPS = 20_000
RUN_BYTES = 64 << 20


def step(left: np.ndarray, v: np.ndarray) -> int:
    """The shard of one vector: that of the highest dot product among those with room for
    it; where it fits nowhere, the one that it overfills least. Of equals the lowest."""
    fits = (left >= v - 1e-12).all(axis=1)
    return int(np.argmax(np.where(fits, left @ v, -np.inf) if fits.any() else (left - v).min(axis=1)))


def deal(m: int, v: np.ndarray, left: np.ndarray) -> np.ndarray:
    """How many of m equal vectors each shard takes, one `step` after another.

    With room, the products of a shard fall by the same amount with each vector, and
    without room, its worst overfill grows; so the shards' next values are falling
    series, and the steps take the highest values of all series. All that lie above a
    threshold are counted at once; the few at the threshold are taken step by step."""
    counts = np.zeros(len(left), dtype=np.int64)
    used = v > 0
    if not used.any():
        counts[0] = m  # vectors of nothing fit everywhere, and all products are 0
        return counts
    room = np.where((left[:, ~used] >= -1e-12).all(axis=1), np.maximum(0, np.floor((left[:, used] + 1e-12) / v[used]).min(axis=1)), 0).astype(np.int64)
    square, product = float(v @ v), left @ v

    def fitting(t: float) -> np.ndarray:
        return np.clip(np.floor((product - t) / square) + 1, 0, room).astype(np.int64)

    def overfull(t: float) -> np.ndarray:
        return room + np.where((left[:, ~used] >= t).all(axis=1), np.clip(np.floor((left[:, used] - t) / v[used]).min(axis=1), 0, 1 << 60).astype(np.int64) - room, 0).clip(0)

    series = fitting if m <= room.sum() else overfull
    spread = float(abs(left).max() + 1) * (1 + float(v.max())) * 3 + (m + len(left)) * float(v.max()) * 3 + float(abs(product).max()) + m * square
    low, high = -spread, spread
    for _ in range(90):
        middle = (low + high) / 2
        low, high = (middle, high) if series(middle).sum() > m else (low, middle)
    counts = series(high)
    for _ in range(m - int(counts.sum())):
        counts[step(left - counts[:, None] * v, v)] += 1
    return counts


def place(vectors: np.ndarray, numbers: np.ndarray, shards: int) -> np.ndarray:
    """classes x shards: how many of the numbers[i] vectors like vectors[i] each shard takes.
    Dimensions are scaled by the capacity, a fair share of their sum. Classes go in falling
    order of their largest component, ties as given."""
    total = (vectors * numbers[:, None]).sum(axis=0)
    scaled = vectors / np.where(total > 0, total / shards, 1.0)
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros((len(vectors), shards), dtype=np.int64)
    for i in np.argsort(-scaled.max(axis=1, initial=0.0), kind="stable"):
        out[i] = deal(int(numbers[i]), scaled[i], left)
        left -= out[i][:, None] * scaled[i]
    return out


def numbered(df: DataFrame, key: str, order: list[Column], runs: int, name: str) -> DataFrame:
    """df with gapless numbers from 0 for each value of ``key`` (never null).

    The rows of a key are dealt by hash to runs, which are numbered apart, from the sum of
    the counts of the runs before."""
    dealt = df.withColumn("run", F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int"))
    counts = dealt.groupBy(F.col(key).alias("of"), F.col("run").alias("at")).agg(F.count("*").alias("n"))
    first = counts.select("of", "at", F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy(key, "run").orderBy(*order)) - 1
    first = stored(first, "runs")
    joined = dealt.withColumn("number", number).join(sized(first, first.count()), (F.col(key) == F.col("of")) & (F.col("run") == F.col("at")))
    return joined.withColumn(name, (F.col("before") + F.col("number")).cast("long")).drop("run", "of", "at", "before", "number")


def size_class(bytes_: Column, tokens: Column, rows: Column) -> Column:
    """A group's size class as a text."""

    def cut(n: Column) -> tuple[Column, Column]:
        drop = F.greatest(F.length(F.bin(n)) - 5, F.lit(0))
        return F.call_function("shiftright", n, drop).cast("string"), drop.cast("string")

    return F.concat_ws(" ", *cut(bytes_), *cut(rows), F.floor(tokens * 32 / bytes_).cast("string"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, row_bytes: int = 8, keep_text: bool = True) -> DataFrame:
    """docs with ``size`` (UTF-8 bytes of the text plus row_bytes), ``tokens`` (words),
    ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Rows stay rows; columns with these names are replaced, all others stay. A null text has no
    bytes and no words and equals the empty text; a text of any length is counted whole. Null
    and repeated ids are placed like others; a shard's slots follow the hash order of id and
    text. The rows of a group that is cut are dealt by a number of their own, so ids that repeat
    in it don't matter. An empty table gives an empty one.
    """
    made = ["size", "tokens", "text_crc32", "shard", "slot"]
    text = F.coalesce(quoted(text_col), F.lit(""))
    box = boxed(
        docs,
        (*made, *([] if keep_text else [text_col])),
        id=F.xxhash64(quoted(id_col)),
        size=(F.octet_length(text) + row_bytes).cast("long"),
        tokens=word_count(text),
        text_crc32=F.crc32(text),
        group=F.xxhash64(text),
    )
    if not keep_text:
        box = stored(box, "sizes")
    vector = ["bytes", "tokens", "rows"]
    groups = box.groupBy("group").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = stored(groups.withColumn("class", size_class(F.col("bytes"), F.col("tokens"), F.col("rows"))), "groups")
    total = groups.agg(F.count("*").alias("groups"), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in vector]).first()
    fair = max(1.0, total["bytes"] / shards)
    is_giant = F.col("bytes") > WHOLE * fair
    giants = sorted(groups.filter(is_giant).collect(), key=lambda g: g["group"])  # under shards rows
    whole = stored(groups.filter(~is_giant), "whole")
    classes = sorted(whole.groupBy("class").agg(F.count("*").alias("m"), *[F.sum(v).alias(v) for v in vector]).collect(), key=lambda c: c["class"])  # one row a size class

    parts = [math.ceil(g["bytes"] / fair) for g in giants]
    vectors = np.array([[g[v] / n for v in vector] for g, n in zip(giants, parts, strict=True)] + [[c[v] / c["m"] for v in vector] for c in classes], dtype=float).reshape(-1, 3)
    taken = place(vectors, np.array(parts + [c["m"] for c in classes], dtype=np.int64), shards)
    upto = taken.cumsum(axis=1).tolist()

    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(list(zip([c["class"] for c in classes], upto[len(giants) :], strict=True)), "class string, upto array<long>"))
    runs = max(1, math.ceil(total["groups"] / RUN_GROUPS))
    ranked = numbered(whole.select("group", "class", "rows"), "class", [F.col("group")], runs, "rank").join(table, "class")
    of_group = stored(ranked.select("group", "rows", F.size(F.filter("upto", lambda n: n <= F.col("rank"))).alias("shard")), "shard_of_group")
    # Giants are kept out of the shuffle like hot keys, and meet their parts below.
    hot = [*hot_keys(of_group, "group", total["rows"], "rows"), *(g["group"] for g in giants)]
    by_group = of_group.select("group", "shard")
    rows = lookup(box, by_group if total["groups"] <= BROADCAST_ROWS else shuffled(by_group), "group", hot)
    if giants:
        cut = F.broadcast(spark.createDataFrame([(g["group"], n, up) for g, n, up in zip(giants, parts, upto, strict=False)], "group long, parts int, upto array<long>"))
        # The parts of a giant's rows are stored, so that they are the same wherever they are read.
        part = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts"))
        dealt = box.join(cut, "group").withColumn("part", part).withColumn("shard", F.size(F.filter("upto", lambda n: n <= F.col("part"))))
        rows = rows.unionByName(stored(dealt.drop("parts", "upto", "part"), "giants"))
    runs = max(1, math.ceil(total["rows"] / shards / RUN_ROWS), math.ceil(total["bytes"] / shards / RUN_BYTES) if keep_text else 1)
    return unboxed(numbered(rows, "shard", [F.col("id"), F.col("group"), F.col("text_crc32")], runs, "slot"), *made)
