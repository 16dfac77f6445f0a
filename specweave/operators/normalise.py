"""Normalising raw model rows into knowledge records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions import text as js
from specweave.operators.assess import assess

#: Pages of the current table whose models are legacy; the known QA items.
LEGACY_PAGES = (79, 80)
KNOWN_QA_ITEMS = 21


def clean_alias(value: Column) -> Column:
    """Without asterisks, white space collapsed and trimmed; null is empty."""
    return js.trim(js.collapse(F.regexp_replace(F.coalesce(value, F.lit("")), r"\*", "")))


def expand_alias(value: Column) -> Column:
    """The cleaned alias, the same without its qualifier, and for an optional letter in
    parentheses the forms without it and with it; distinct, in this order."""
    cleaned = clean_alias(value)
    bare = F.regexp_replace(cleaned, rf"(?i){js.SPACE}+\((?:Fine|Full|Coarse)\)\z", "")
    optional = rf"(?i)^({js.DOT}*)\(([A-Z])\)({js.DOT}*)\z"
    before, letter, after = (F.regexp_extract(bare, optional, k) for k in (1, 2, 3))
    has = bare.rlike(optional)
    forms = F.array(cleaned, bare, F.when(has, F.concat(before, after)), F.when(has, F.concat(before, letter, after)))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def aliases_for(model_group: Column, search_aliases: Column) -> Column:
    """All aliases of a record: model groups (split at a slash between spaces) and search
    aliases (split at bars), expanded, distinct, longest first; ties keep their order."""
    parts = F.concat(F.split(F.coalesce(model_group, F.lit("")), rf"{js.SPACE}+/{js.SPACE}+"), F.split(F.coalesce(search_aliases, F.lit("")), r"\|"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand_alias))), lambda a, b: js.utf16_length(b) - js.utf16_length(a))


def component(name: str) -> Column:
    """A measure of a raw row; a missing one is a struct of nulls."""
    at = F.col(name)
    return F.struct(at["value"].alias("value"), at["value_secondary"].alias("secondaryValue"), at["unit"].alias("unit"), at["unit_secondary"].alias("secondaryUnit"), at["d"].alias("d"), at["raw"].alias("raw"))


def surrogate_key(prefix: str, pos: Column) -> Column:
    """prefix and the 1-based ordinal, padded to four digits and never cut."""
    return F.format_string(f"{prefix}-%04d", pos + 1)


def lifecycle(page: Column) -> Column:
    return F.when(page.isin(*LEGACY_PAGES), "legacy").otherwise("current")


def spec(value: str, unit: str, second: str, second_unit: str, note: str) -> Column:
    return F.struct(F.col(value).alias("value"), F.col(unit).alias("unit"), F.col(second).alias("secondaryValue"), F.col(second_unit).alias("secondaryUnit"), F.col(note).alias("note"))


def _common(rows: DataFrame, prefix: str, cycle: Column, tbl: int) -> list[Column]:
    return [
        F.lit(tbl).alias("tbl"),
        F.col("pos").cast("long").alias("pos"),
        surrogate_key(prefix, F.col("pos")).alias("id"),
        cycle.alias("lifecycle"),
        F.col("series"),
        F.col("table_title").alias("tableTitle"),
        clean_alias(F.col("model_group")).alias("modelGroup"),
        aliases_for(F.col("model_group"), F.col("search_aliases")).alias("aliases"),
        component("repeatability").alias("repeatability"),
        component("linearity").alias("linearity"),
        component("ocl").alias("ocl"),
        F.struct(F.col("source_manual").alias("manual"), F.col("source_pdf_page").alias("page")).alias("source"),
    ]


def current_records(rows: DataFrame, *keep: str) -> DataFrame:
    """rows: raw current models with ``pos``. A missing measure gives nulls, and no check. Columns
    keep come along."""
    return rows.select(
        *keep,
        *_common(rows, "CUR", lifecycle(F.col("source_pdf_page")), 0),
        spec("capacity_primary", "capacity_primary_unit", "capacity_secondary", "capacity_secondary_unit", "capacity_annotation").alias("capacity"),
        spec("readability", "readability_unit", "readability_secondary", "readability_secondary_unit", "readability_annotation").alias("readability"),
        component("tolerance").alias("tolerance"),
        F.struct(js.falsy_null(F.col("astm_class")).alias("astm"), js.falsy_null(F.col("oiml_class")).alias("oiml")).alias("calibration"),
        assess().alias("qa"),
    )


def legacy_records(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, *_common(rows, "LEG", F.lit("legacy"), 1))


def catalogue(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Current and legacy records in one table; what legacy ones lack is null."""
    return current_records(current).unionByName(legacy_records(legacy), allowMissingColumns=True)


def meta(current: DataFrame, legacy: DataFrame, temperature: DataFrame, date: DataFrame, title: str) -> DataFrame:
    """One row of counts, by table and not by lifecycle."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(current, "currentRecords").crossJoin(one(legacy, "legacyRecords")).crossJoin(one(temperature, "temperatureRecords"))  # one row each
    return counts.crossJoin(date.agg(F.max("document_date").alias("documentDate"))).select(F.lit(title).alias("title"), "documentDate", "currentRecords", "legacyRecords", "temperatureRecords", F.lit(KNOWN_QA_ITEMS).alias("knownQaItems"))
