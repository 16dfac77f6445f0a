"""Ranked lexical search over document shards.

A shard is a row of the index: the ids of some thousand documents, their terms, and the
terms' postings in compressed sparse rows: ``counts`` postings a term, which lie one after another in
``docs`` (places in the shard) and ``impacts``, both packed as little-endian 32-bit numbers. An impact is
a whole number, worked out when the
index is built from the term's occurrences, the document's length and the mean length of
all documents. Documents stay where they are read: building shuffles nothing. Spark reads and writes
some thousand rows of a file at a time, whatever their size, so a file has FILE_SHARDS shards.

A search sends each block of queries to all shards. A query's terms are taken one at a
time: weight times impact is added to a dense accumulator of one number a document. The
best k of a shard come from a partition of the accumulator around the k-th score, with
all its ties, so that equal scores are told apart by id and never by place. A task
merges its shards; Spark merges the tasks' rows, at most k a task and item.

Scores are those of BM25 in whole numbers (`IDF`, `impact`): equal on every machine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.common import BROADCAST_ROW_BYTES, BROADCAST_ROWS, quoted, stored

#: Terms are runs of ASCII letters, digits and everything beyond ASCII. Bytes of UTF-8: A-Z as
#: a-z, what is in no term as a blank.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()

#: A shard is closed at so many postings, documents or bytes of different terms; a document is never cut.
SHARD_TERMS, SHARD_DOCS, SHARD_BYTES = 1 << 20, 1 << 16, 16 << 20
#: Shards of a file.
FILE_SHARDS = 4
#: Different terms of all items, and their bytes, that are sent to the shards at once.
BLOCK_TERMS, BLOCK_BYTES = 200_000, 16 << 20
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Parts in which an item's rows are ranked before they meet.
PARTS = 64


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, some at a time; null has none."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(text: str | None) -> Counter[bytes]:
    """The terms of a whole text with their occurrences."""
    counts: Counter[bytes] = Counter()
    for terms in pieces(text):
        counts.update(terms)
    return counts


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms of all documents; a task returns one row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = total = 0
        for batch in batches:
            for text in batch.column("text"):
                n = sum(map(len, pieces(text.as_py())))
                n_docs, total = n_docs + (n > 0), total + n
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([total])], names=["n_docs", "total"])

    row = docs.select("text").mapInArrow(count, "n_docs long, total long").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total")).first()
    return row["n_docs"] or 0, row["total"] or 0


#: The weight of a term, by ``n_docs`` and ``df``.
IDF = "cast(floor(1000 * ln((2 * {n_docs} + 2) / (2 * df + 1))) as long)"


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term's weight is multiplied with, by its occurrences in a document and the
    document's number of terms."""
    if 75 * n_docs * int(length.max(initial=0)) >= 1 << 63:
        share = np.array([75 * int(n) * n_docs // total for n in length], dtype=np.int64)
    else:
        share = 75 * length * n_docs // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * (25 + share))


@dataclass(frozen=True)
class Index:
    """shards: the stored table; n_docs: documents with a term; total: all terms of all documents."""

    shards: DataFrame
    n_docs: int
    total: int


class _Shard:
    """A shard in the making: ids, and of each document the places of its terms and their occurrences."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.places: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.size = self.bytes = 0

    def add(self, id_: int | None, counts: Counter[bytes]) -> None:
        self.ids.append(id_)
        self.bytes += sum(len(t) for t in counts if t not in self.places)
        self.terms.append(np.fromiter((self.places.setdefault(t, len(self.places)) for t in counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.size += len(counts)

    def full(self) -> bool:
        return self.size >= SHARD_TERMS or len(self.ids) >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def row(self, n_docs: int, total: int) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(t) for t in self.terms])
        length, of = np.array([t.sum() for t in self.tf], dtype=np.int64), np.concatenate(self.terms)
        order = np.argsort(of, kind="stable")
        impacts = impact(np.concatenate(self.tf), length[doc], n_docs, total)[order]
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        packed = lambda a: pa.array([a.astype("<i4").tobytes()], pa.binary())
        terms = pa.array([t.decode("utf-8", "replace") for t in self.places], pa.string())
        lists = [pa.array(self.ids, pa.int64()), terms, pa.array(np.bincount(of, minlength=len(self.places)).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*map(one, lists), packed(doc[order]), packed(impacts)], names=["ids", "terms", "counts", "docs", "impacts"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of every document, of its whole text. Ids are whole numbers or null; documents
    without terms, null texts among them, are in no shard. Other columns are not read."""
    own = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    n_docs, total = totals(own)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if counts := term_counts(text.as_py()):
                    shard.add(i, counts)
                if shard.full():
                    yield shard.row(n_docs, total)
                    shard = _Shard()
        if shard.ids:
            yield shard.row(n_docs, total)

    table = own.mapInArrow(shards, "ids array<long>, terms array<string>, counts array<int>, docs binary, impacts binary")
    return Index(stored(table, "shards", FILE_SHARDS), n_docs, total)


def best(scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, the highest first, equal ones by id (null last)."""
    if len(scores) > k:
        kth = scores[np.argpartition(scores, len(scores) - k)[-k:]].min()
        places = np.flatnonzero(scores >= max(kth, 1))  # with all ties of the k-th
    else:
        places = np.flatnonzero(scores > 0)
    return places[np.lexsort((ids[places], no_id[places], -scores[places]))[:k]]


def _hits(index: Index, block: pa.Table, k: int, kind: str) -> DataFrame:
    """The best documents in each task for the items of a block: ``item``, ``term``, ``factor``."""
    block = block.sort_by("no")
    terms = pc.unique(block.column("term").combine_chunks()) if block.num_rows else pa.array([], pa.string())
    term = pc.index_in(block.column("term").combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False)
    factor = block.column("factor").to_numpy()
    starts = np.flatnonzero(np.diff(block.column("no").to_numpy(), prepend=-1))
    ends, names = np.append(starts, block.num_rows)[1:], block.column("item").combine_chunks().take(pa.array(starts))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, own, counts = (batch.column(c)[row].values for c in ("ids", "terms", "counts"))
                no_id, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                docs, impacts = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i4") for c in ("docs", "impacts"))
                edges = np.concatenate([[0], np.cumsum(counts.to_numpy(), dtype=np.int64)])
                at = pc.index_in(terms, value_set=own).fill_null(-1).to_numpy()
                for item, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    scores, found = np.zeros(len(ids), dtype=np.int64), False
                    for t, f in zip(at[term[a:b]], factor[a:b], strict=True):
                        if t >= 0:
                            scores[docs[edges[t] : edges[t + 1]]] += f * impacts[edges[t] : edges[t + 1]].astype(np.int64)
                            found = True
                    if found:
                        places = best(scores, ids, no_id, k)
                        have = [np.concatenate(pair) for pair in zip(held.get(item, ([], [], [])), (scores[places], ids[places], no_id[places]), strict=True)]
                        have = [have[0].astype(np.int64), have[1].astype(np.int64), have[2].astype(bool)]
                        top = best(*have, k)
                        held[item] = tuple(h[top] for h in have)
        for item, (scores, ids, no_id) in held.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([names.take(pa.array([item] * len(scores))), pa.array(ids, mask=no_id), pa.array(scores)], names=["item", "doc_id", "score"])

    return index.shards.mapInArrow(search, f"item {kind}, doc_id long, score long")


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``term``, ``n``: the terms of each item with their occurrences."""
    own = items.select(quoted(id_col).alias("item"), quoted(text_col).alias("text")).distinct()
    kind = own.schema["item"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column("text")):
                counts = term_counts(text.as_py())
                if counts:
                    item = batch.column("item").take(pa.array([row] * len(counts)))
                    yield pa.RecordBatch.from_arrays([item, pa.array([t.decode("utf-8", "replace") for t in counts]), pa.array(list(counts.values()), pa.int64())], names=["item", "term", "n"])

    return own.mapInArrow(split, f"item {kind}, term string, n long").groupBy("item", "term").agg(F.sum("n").alias("n"))


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k documents of highest score above 0 for each item (all, if fewer): the item's id,
    ``rank`` from 1, ``doc_id``, ``score``. Equal scores go by id, a null id last.

    A repeated item row counts once; other texts of the same id, null included, add their terms to the same
    item. Items without terms, or without a document that holds one, give no rows. Repeated documents are
    documents of their own, each with its rank. Texts are taken whole. Columns of items other than the two
    are not read. An empty table on either side gives an empty one.
    """
    wanted = stored(query_terms(items, id_col, text_col), "query_terms")
    size = wanted.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("bytes")).first()
    different = stored(wanted.select("term").distinct(), "different_terms")
    few = size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_ROWS * BROADCAST_ROW_BYTES
    postings = index.shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.counts").alias("n"))
    counts = postings.join(F.broadcast(different) if few else different, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weights = counts.select(F.col("term").alias("word"), F.expr(IDF.format(n_docs=f"{index.n_docs}L")).alias("w"))
    factors = wanted.join(weights, F.col("term") == F.col("word")).select("item", "term", (F.col("n") * F.col("w")).alias("factor"))
    blocks = max(1, -(-size["rows"] // BLOCK_TERMS), -(-size["bytes"] // BLOCK_BYTES))
    factors = stored(factors.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "factors")
    numbered = factors.withColumn("no", F.dense_rank().over(Window.partitionBy("block").orderBy("item")))
    kind = factors.schema["item"].dataType.simpleString()
    hits = None
    for n in range(blocks):
        # One block of bounded size at a time.
        found = _hits(index, numbered.filter(F.col("block") == n).select("item", "no", "term", "factor").toArrow(), k, kind)
        found = found if blocks == 1 else stored(found, "hits")
        hits = found if hits is None else hits.union(found)
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    near = hits.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("place", place("item", "part")).filter(F.col("place") <= k)
    ranked = near.withColumn("rank", place("item")).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(id_col), "rank", "doc_id", "score")
