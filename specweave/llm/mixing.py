"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words in proportion to their weights; a source stops at
``max_epochs`` times its size, and its excess goes to the others in proportion to their
weights, again and again until none is above its cap. A source then takes whole
repetitions of all its documents and a fractional one of some: in an order that the seed
fixes, documents are taken while their words fit into the fraction, and one more document
of the rest closes the gap as well as any can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.common import boxed, quoted, sized, stored, unboxed, word_count

#: Leading hexadecimal digits of a document's place; each value is a slice of a source, so
#: that running sums need no task that holds a source.
SLICE_DIGITS = 3


def place(id_: Column, text: Column, seed: int) -> Column:
    """A document's place in its source's sampling order, as 32 hexadecimal digits; that of
    a null id follows from the text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.md5(text), F.lit(""))))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources (``source``, ``source_size``, ``weight``) with ``target`` (double).

    A round finds the share of a unit of weight among the sources below their caps and
    clamps those that it would lift above; it ends when there are none. Only sums reach
    the driver. If the caps allow less than the budget, every source is at its cap.
    """
    capped = F.lit(False)
    cap = F.col("source_size") * F.lit(max_epochs)
    while True:
        row = sources.select(
            F.sum(F.when(capped, cap).otherwise(0.0)).alias("fixed"), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)).alias("weight"), F.count(F.when(capped, 1)).alias("n")
        ).first()
        unit = max(0.0, budget - (row["fixed"] or 0.0)) / row["weight"] if row["weight"] else 0.0
        over = capped | (F.col("weight") * F.lit(unit) > cap)
        if sources.filter(over).count() == row["n"]:
            return sources.withColumn("target", F.when(capped, cap).otherwise(F.col("weight") * F.lit(unit)).cast("double"))
        capped = over


def mix(
    docs: DataFrame,
    weights: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    keep_text: bool = True,
) -> DataFrame:
    """docs with ``size`` (words), ``source_size``, ``target`` and ``taken`` (words that
    the mix takes, repeats counted) and ``repeats`` (taken copies).

    weights has ``source`` (null is a source too) and ``weight`` (positive), a row for each
    source; documents of a source without a weight have target 0 and are not taken. Rows
    stay rows; columns with these names are replaced, all others stay, whatever their names.
    Documents without words take nothing; texts of any length are counted whole. Rows that share source and id share their place, and are taken together or not at all
    but for the document that closes the gap. An empty table gives an empty one.

    Sizes and places are stored once, without the text. Running sums are made of sums by slice of a source, then within the slices; a hot source has as many
    slices as any, so it needs no task of its own.
    """
    made = ["size", "source_size", "target", "taken", "repeats"]
    drop = (*made, *([] if keep_text else [text_col]))
    rows = boxed(docs, drop, __src=quoted(source_col), size=word_count(quoted(text_col)), __place=place(quoted(id_col), quoted(text_col), seed))
    rows = rows.withColumn("__slice", F.substring("__place", 1, SLICE_DIGITS))
    if not keep_text:
        rows = stored(rows, "sizes")
    narrow = rows.select("__src", "size", "__place", "__slice")
    if keep_text:
        narrow = stored(narrow, "sizes")

    slices = stored(narrow.groupBy(F.col("__src").alias("source"), F.col("__slice").alias("slice")).agg(F.sum("size").alias("words")), "slices")
    totals = slices.groupBy("source").agg(F.sum("words").alias("source_size"))
    budget = (totals.agg(F.sum("source_size")).first()[0] or 0) * budget_share
    w = weights.select(F.col("source").alias("__source"), F.col("weight").cast("double").alias("weight"))
    sources = stored(totals.join(w, totals["source"].eqNullSafe(w["__source"])).select("source", "source_size", "weight"), "sources")
    targets = stored(water_fill(sources, budget, max_epochs).select("source", "source_size", "target"), "targets")

    # Whole repetitions, and the words that the fraction has room for.
    rated = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    rated = rated.withColumn("room", F.col("target") - F.col("whole") * F.col("source_size")).alias("t")
    before = slices.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("s")
    plan = stored(before.join(rated, F.col("s.source").eqNullSafe(F.col("t.source"))).select(F.col("s.source").alias("__source"), F.col("slice").alias("__at"), "before", "words", "room"), "plan")

    # The slice in which a source's room ends, and the documents in it that still fit.
    edge = stored(plan.filter("before <= room and before + words > room").select("__source", "__at", "before", "room"), "edge")
    n_edges = edge.count()
    within = Window.partitionBy("__source", "__at").orderBy("__place").rangeBetween(Window.unboundedPreceding, 0)
    run = narrow.join(sized(edge, n_edges), F.col("__src").eqNullSafe(F.col("__source")) & (F.col("__slice") == F.col("__at"))).withColumn("upto", F.col("before") + F.sum("size").over(within))
    full = run.filter("upto <= room").groupBy(F.col("__source").alias("fs")).agg(F.max("upto").alias("used"), F.max("__place").alias("until"))
    # A slice's digits sort before all places in it and behind those of earlier slices.
    bounds = edge.join(full, F.col("__source").eqNullSafe(F.col("fs")), "left").select(F.col("__source").alias("bs"), F.coalesce("used", "before").alias("used"), F.coalesce("until", "__at").alias("until"))
    final = rated.join(bounds, F.col("source").eqNullSafe(F.col("bs")), "left").select(F.col("source").alias("__source"), "source_size", "target", "whole", F.coalesce("until", F.lit("")).alias("until"), (F.col("room") - F.coalesce("used", F.lit(0))).alias("gap"))
    final = stored(final, "final")
    n = final.count()
    # One more document of the rest: the one whose size is nearest to the gap, if it helps.
    rest = narrow.join(sized(final, n), F.col("__src").eqNullSafe(F.col("__source"))).filter((F.col("__place") > F.col("until")) & (F.col("size") > 0))
    off = F.abs(F.col("size") - F.col("gap"))
    nearest = rest.filter(off < F.col("gap")).groupBy("__source").agg(F.min(F.struct(off.alias("off"), "__place")).alias("best")).select(F.col("__source").alias("ns"), F.col("best.__place").alias("also"))
    final = stored(final.join(nearest, F.col("__source").eqNullSafe(F.col("ns")), "left").drop("ns", "gap"), "choice")

    choice = final.select(*[F.col(c).alias(c if c == "__source" else f"__{c}") for c in final.columns])
    out = rows.join(sized(choice, n), F.col("__src").eqNullSafe(F.col("__source")), "left")
    extra = F.when((F.col("__place") <= F.col("__until")) | (F.col("__place") == F.col("__also")), 1).otherwise(0)
    repeats = F.when(F.col("size") > 0, F.coalesce(F.col("__whole") + extra, F.lit(0))).otherwise(0).cast("long")
    out = out.withColumn("repeats", repeats).withColumn("taken", (F.col("repeats") * F.col("size")).cast("long"))
    return unboxed(out, "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "taken", "repeats")


def cyclic_weights(docs: DataFrame, source_col: str = "source", cycle: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Weights for the sources in code point order, null last, taking the cycle's values in
    turn. The order is over one row a source."""
    names = docs.select(F.col(source_col).alias("source")).distinct()
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return names.select("source", F.array(*[F.lit(float(c)) for c in cycle])[at % len(cycle)].alias("weight"))


def expanded(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each taken copy, and none for documents not taken."""
    box = boxed(mixed.filter("repeats > 0"), copies=F.sequence(F.lit(1), F.col("repeats").cast("int")))
    return unboxed(box.select("row", F.explode("copies")))
