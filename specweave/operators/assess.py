"""Consistency checks of a raw model row's published figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specweave.functions.text import js_number

#: The page with a known discrepancy, and its note.
NOTED_PAGE = 49
NOTE = "The source heading says 2d while the combined tolerance column reports 4d; component values remain internally consistent."


def close_enough(a: Column, b: Column, threshold: float) -> Column:
    return F.abs(a - b) <= F.lit(threshold)


def _unit(unit: Column) -> Column:
    """A unit in a message; a missing one shows as null does in JavaScript."""
    return F.coalesce(unit, F.lit("null"))


def sum_message() -> Column:
    """Repeatability plus linearity against the tolerance, where all three have a value and the
    same unit (none at all counts as the same)."""
    rep, lin, tol = F.col("repeatability"), F.col("linearity"), F.col("tolerance")
    total = rep["value"] + lin["value"]
    checked = rep["value"].isNotNull() & lin["value"].isNotNull() & tol["value"].isNotNull() & rep["unit"].eqNullSafe(lin["unit"]) & lin["unit"].eqNullSafe(tol["unit"])
    said = F.concat(F.lit("Published tolerance "), js_number(tol["value"]), F.lit(" "), _unit(tol["unit"]), F.lit(" differs from repeatability + linearity ("), js_number(total), F.lit(" "), _unit(tol["unit"]), F.lit(")."))
    return F.when(checked & ~close_enough(total, tol["value"], 1e-9), said)


def d_message(measure: str, name: str) -> Column:
    """A measure in divisions of the readability against its published d."""
    m, readability = F.col(measure), F.col("readability")
    found = F.try_divide(m["value"], readability)
    checked = m["value"].isNotNull() & m["d"].isNotNull() & readability.isNotNull() & (readability != 0) & m["unit"].eqNullSafe(F.col("readability_unit"))
    said = F.concat(F.lit(f"Published {name} converts to "), js_number(found), F.lit("d, while the source lists "), js_number(m["d"]), F.lit("d."))
    return F.when(checked & ~close_enough(found, m["d"], 1e-4), said)


def page_message() -> Column:
    return F.when(F.col("source_pdf_page") == NOTED_PAGE, NOTE)


def assess() -> Column:
    """The verdict of a raw current row: status `review` with messages, or `ok`."""
    messages = F.array_compact(F.array(sum_message(), d_message("tolerance", "tolerance"), d_message("ocl", "OCL"), page_message()))
    return F.struct(F.when(F.size(messages) > 0, "review").otherwise("ok").alias("status"), messages.alias("messages"))
