"""Helpers that the training-data operators share: shared storage, words, sized joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.sources.shared import shared_path

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a lookup table is broadcast; a row is at most BROADCAST_ROW_BYTES.
BROADCAST_ROWS = 20_000
BROADCAST_ROW_BYTES = 512


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """df, written once to the shared folder and read from there, with up to file_rows
    rows a file (0: any number).

    This cuts the lineage: what is read survives the loss of any executor, and a
    table used twice is computed once.
    """
    path = shared_path(df.sparkSession, name)
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; of null, an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words (long); null has none."""
    return F.size(words(text)).cast("long")


def sized(small: DataFrame, rows: int) -> DataFrame:
    """small with a broadcast hint if its counted rows are few enough; else as it is,
    for a shuffle join, whose skew AQE splits."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides, whatever Spark takes their sizes for. It sizes rows that
    are made by an explode or in Python by what they are made from, and a stored table by its
    compressed bytes, so that it may broadcast a table many times its threshold."""
    return df.hint("merge")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names (Spark resolves names without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame, without_columns: tuple[str, ...] = (), **named: Column) -> DataFrame:
    """df's columns as one struct ``row``, beside the named ones, so that no name of df can
    clash with one that an operator makes; ``row.*`` gives them back. Columns of
    without_columns (names without case) are left out of the row."""
    gone = {n.lower() for n in without_columns}
    own = [quoted(c) for c in df.columns if c.lower() not in gone]
    return df.select(F.struct(*own).alias("row") if own else F.lit(None).alias("row"), *[c.alias(n) for n, c in named.items()])


def unboxed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns of ``row`` again, then these columns."""
    has_row = df.schema["row"].dataType.typeName() == "struct"
    return df.select(*(["row.*"] if has_row else []), *columns)


#: A key with over HOT_ROWS rows and over 1/HOT of all rows is hot, so there are at most HOT of them.
HOT, HOT_ROWS = 1000, 100


def hot_keys(counts: DataFrame, key: str, total: int, rows: str = "n") -> list:
    """The hot keys of a table of different keys with their numbers of rows, which sum up to
    total: at most HOT."""
    return [r[0] for r in counts.filter((F.col(rows) > HOT_ROWS) & (F.col(rows) * HOT > total)).select(key).collect()]


def lookup(big: DataFrame, small: DataFrame, key: str, hot: list) -> DataFrame:
    """big joined with small, whose keys are all different and not null. The rows of hot keys (a
    list of bounded length) stay where they are and meet their few rows of small by a
    broadcast; all others are shuffled, no key of which has over 1/HOT of the rows."""
    if not hot:
        return big.join(small, key)
    is_hot = F.col(key).isin(hot)
    return big.filter(is_hot).join(F.broadcast(small.filter(is_hot)), key).unionByName(big.filter(~is_hot).join(small.filter(~is_hot), key))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by minimum labels and pointer jumps.

    edges has two columns ``a`` and ``b`` of one type that can be ordered. Returns ``node``, ``root``: each node
    of an edge with the smallest node of its component. A round sends every label over
    every edge once and then halves the paths to the root; each round's labels are a
    table in the shared folder. Labels meet in ``min``, which Spark combines before the
    shuffle; nodes with very many neighbours and roots of very many nodes are hot keys
    of a `lookup`, so they need no task of their own. Other rows are always shuffled. Nulls and loops are left out; of no
    edges the result is empty.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    n_edges, n_nodes = both.count(), labels.count()
    if not n_nodes:
        return labels
    hubs = hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), "b", n_edges)
    while True:
        near = lookup(both, shuffled(labels.select(F.col("node").alias("b"), "root")), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        best = stored(labels.select("node", "root").join(shuffled(near), "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old")), "best")
        jump = best.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        large = hot_keys(best.groupBy("root").agg(F.count("*").alias("n")), "root", n_nodes)
        labels = stored(lookup(best, shuffled(jump), "root", large).select("node", F.least("root", "jump").alias("root"), "old"), "labels")
        if labels.filter("root <> old").limit(1).count() == 0:
            return labels.select("node", "root")
