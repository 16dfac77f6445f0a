"""Reading raw catalogue documents, and writing and reading what is prepared from them: the
knowledge tables, or one output document for each raw one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from specweave.operators import normalise
from specweave.sources import schemas

PASSED_THROUGH = {"temperature": "temperature_specs", "guidance": "guidance", "class_cross_map": "weight_class_crossmap", "series_class_recommendations": "series_class_recommendations", "mass_tolerances": "mass_tolerances"}


@dataclass
class Knowledge:
    """records: current and legacy models with their order (``tbl``, ``pos``); the other
    tables also have ``pos``; meta has one row."""

    records: DataFrame
    temperature: DataFrame
    guidance: DataFrame
    class_cross_map: DataFrame
    series_class_recommendations: DataFrame
    mass_tolerances: DataFrame
    meta: DataFrame


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The one-row raw document; malformed JSON fails."""
    return spark.read.schema(schemas.DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def unnest(document: DataFrame, column: str, *keep: str) -> DataFrame:
    """A row for each element of an array of the document, with ``pos`` from 0; of many
    documents also the columns keep, which tell them apart."""
    rows = document.select(*keep, F.posexplode(column).alias("pos", "row"))
    if column in schemas.READ_MEMBERS and rows.schema["row"].dataType.typeName() == "variant":
        rows = rows.withColumn("row", F.col("row").cast(schemas.READ_MEMBERS[column]))
    struct = rows.schema["row"].dataType.typeName() == "struct"
    return rows.select(*keep, "pos", "row.*") if struct else rows


def prepare(document: DataFrame, title: str = "Master Tolerance Reference") -> Knowledge:
    """All knowledge tables of a raw document; title names the catalogue in meta."""
    current, legacy = unnest(document, "current"), unnest(document, "legacy")
    tables = {name: unnest(document, column) for name, column in PASSED_THROUGH.items()}
    date = document.select("document_date").limit(1)
    return Knowledge(records=normalise.catalogue(current, legacy), meta=normalise.meta(current, legacy, tables["temperature"], date, title), **tables)


def progress(records: int, path: str) -> str:
    """What a finished preparation reports."""
    return f"Prepared {records} model records at {path}"


def write(knowledge: Knowledge, path: str) -> str:
    """One Parquet folder for each table, replaced as a whole; nulls are kept. Returns the
    progress line; its count is taken while the records are written."""
    written = Observation("written")
    for name, table in vars(knowledge).items():
        table = table.observe(written, F.count("*").alias("records")) if name == "records" else table
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return progress(written.get["records"], path)


def read(spark: SparkSession, path: str) -> Knowledge:
    return Knowledge(**{name: spark.read.parquet(f"{path}/{name}") for name in Knowledge.__dataclass_fields__})


def write_documents(documents: DataFrame, path: str) -> None:
    """Raw documents as JSON, a file for each row, nulls kept."""
    documents.write.mode("overwrite").option("ignoreNullFields", "false").option("maxRecordsPerFile", 1).json(path)


#: Members of the output document and the raw columns that they are copied from.
COPIED = {"temperatureSpecs": "temperature_specs", "classCrossMap": "weight_class_crossmap", "seriesClassRecommendations": "series_class_recommendations", "massTolerances": "mass_tolerances", "guidance": "guidance"}


def _nested(records: DataFrame, key: str, name: str, of: str) -> DataFrame:
    """The records of each document as one array in their order."""
    found = records.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*_members(of)).alias("e")))).alias("es"))  # one raw document's
    return found.select(F.col(key).alias(f"{name}_of"), F.transform("es", lambda x: x["e"]).alias(name))


def _members(of: str) -> list[Column]:
    return [F.col(f.name) for f in schemas.fields(of)]


def output_documents(documents: DataFrame, title: str = "Master Tolerance Reference", key: str = "document_date") -> DataFrame:
    """The output document of each raw one, as ``key`` and the members of `schemas.OUTPUT`: its counts, its
    records nested again in their order, and the five tables that are copied as they are.

    key tells the raw documents apart. Ordinals begin anew in each document. A missing array is an empty
    one. Records meet their document in two joins by key; what is copied moves once."""
    of = lambda rows, make, name, kind: _nested(make(rows, key), key, name, kind)
    current = of(unnest(documents, "current", key), normalise.current_records, "current", schemas.CURRENT_OUT)
    legacy = of(unnest(documents, "legacy", key), normalise.legacy_records, "legacy", schemas.LEGACY_OUT)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    copied = documents.select(F.col(key), F.col("document_date").alias("date"), *[empty(F.col(column), schemas.PASSED).alias(member) for member, column in COPIED.items()])
    joined = copied.join(current, F.col(key).eqNullSafe(F.col("current_of")), "left").join(legacy, F.col(key).eqNullSafe(F.col("legacy_of")), "left")
    whole = joined.withColumn("current", empty(F.col("current"), f"array<{schemas.CURRENT_OUT}>")).withColumn("legacy", empty(F.col("legacy"), f"array<{schemas.LEGACY_OUT}>"))
    count = lambda c: F.size(c).cast("long")
    meta = F.struct(F.lit(title).alias("title"), F.col("date").alias("documentDate"), count("current").alias("currentRecords"), count("legacy").alias("legacyRecords"), count("temperatureSpecs").alias("temperatureRecords"), F.lit(normalise.KNOWN_QA_ITEMS).alias("knownQaItems"))
    return whole.select(F.col(key), meta.alias("meta"), "current", "legacy", *COPIED)


def write_output(outputs: DataFrame, path: str) -> str:
    """Output documents as JSON, a file for each, nulls kept, the folder replaced. Returns the progress
    line; its count is taken while they are written."""
    written = Observation("written")
    records = F.sum(F.col("meta.currentRecords") + F.col("meta.legacyRecords"))
    observed = outputs.select("meta", "current", "legacy", *COPIED).observe(written, F.coalesce(records, F.lit(0)).alias("records"))
    observed.write.mode("overwrite").option("ignoreNullFields", "false").option("maxRecordsPerFile", 1).json(path)
    return progress(written.get["records"], path)


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """Output documents, a row for each; malformed JSON fails."""
    return spark.read.schema(schemas.OUTPUT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def from_output(output: DataFrame) -> Knowledge:
    """The knowledge tables of one output document."""
    tables = {name: unnest(output.select(F.col(member).alias(column)), column) for name, column in PASSED_THROUGH.items() for member, c in COPIED.items() if c == column}
    numbered = [unnest(output, name).withColumn("tbl", F.lit(n)).withColumn("pos", F.col("pos").cast("long")) for n, name in enumerate(("current", "legacy"))]
    return Knowledge(records=numbered[0].unionByName(numbered[1], allowMissingColumns=True), meta=output.select("meta.*"), **tables)
