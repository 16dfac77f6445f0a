"""A catalogue, questions and the rest, derived from the star-schema tables.

The catalogue's own data are not available, so parts stand for models, suppliers for
temperature rows and orders for questions. All derivations are per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specweave.operators import normalise
from specweave.operators.conversation import WELCOME
from specweave.sources import schemas
from specweave.sources.knowledge import Knowledge

WORDS = ["tolerance", "repeatability", "linearity", "readability", "capacity", "weight class", "OCL", "temperature"]

#: Questions that reach the other branches.
FIXED = [
    "What is tolerance vs uncertainty?", "What is MPE?", "Which class for Scout?", "the 1/3 rule", "ASTM versus OIML", "ASTM E617 vs OIML", "What is the tolerance for Scout?",
    "hello", "", "   ", "current or legacy PX1006", "latest PX1012 capacity", "old PX1006 linearity", "tolerance of PX1005(N)?", "px1007 (fine) off center", "PX1006-X d value", "heater of TS3 and TS4",
]


def _measure(value: str, d: str) -> str:
    return f"named_struct('value', {value}, 'value_secondary', cast(null as double), 'unit', 'g', 'unit_secondary', cast(null as string), 'd', cast({d} as double), 'raw', cast(null as string))"


def raw_current(part: DataFrame) -> DataFrame:
    """Raw current models of part; the ordinal is the key, so no order over all rows is needed."""
    tol = "case when p_partkey % 13 = 0 then null when p_partkey % 11 = 0 then 3 * p_size / 100d + 0.5d else 3 * p_size / 100d end"
    return part.selectExpr(
        "p_partkey - 1 as pos", "p_brand as series", "p_type as table_title",
        "concat('PX', 1000 + p_partkey, case when p_partkey % 5 = 0 then '(N)' else '' end, case when p_partkey % 7 = 0 then ' (Fine)' else '' end) as model_group",
        "concat_ws('|', p_name, replace(p_brand, '#', '')) as search_aliases",
        f"{_measure('p_size / 100d', '1')} as repeatability", f"{_measure('2 * p_size / 100d', '2')} as linearity", f"{_measure('2 * p_size / 100d', 'case when p_partkey % 17 = 0 then 4 else 2 end')} as ocl", f"{_measure(tol, '3')} as tolerance",
        "p_retailprice as capacity_primary", "'g' as capacity_primary_unit", "case when p_partkey % 3 = 0 then p_size * 1.5d end as capacity_secondary", "'oz' as capacity_secondary_unit", "cast(null as string) as capacity_annotation",
        "p_size / 100d as readability", "'g' as readability_unit", "cast(null as double) as readability_secondary", "cast(null as string) as readability_secondary_unit", "cast(null as string) as readability_annotation",
        "case p_partkey % 3 when 0 then '' when 1 then '2' end as astm_class", "case when p_partkey % 4 = 0 then 'F1' else '' end as oiml_class", "p_type as source_manual", "cast(p_size + 31 as int) as source_pdf_page",
    )


def raw_legacy(part: DataFrame) -> DataFrame:
    """Every sixth model once more, as a legacy one."""
    return part.filter("p_partkey % 6 = 0").selectExpr(
        "p_partkey - 1 as pos", "p_brand as series", "p_type as table_title", "concat('PX', 1000 + p_partkey) as model_group", "cast(null as string) as search_aliases",
        f"{_measure('p_size / 100d', '1')} as repeatability", f"{_measure('2 * p_size / 100d', '2')} as linearity", f"{_measure('cast(null as double)', 'null')} as ocl", "p_type as source_manual", "cast(p_size as int) as source_pdf_page",
    )


def temperature(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        "s_suppkey - 1 as pos", "concat('TS', s_suppkey, case when s_suppkey % 3 = 0 then '/TX' else ' / TX' end, s_suppkey) as model_group", "s_suppkey % 9 / 4d as temperature_tolerance_c", "40d as display_range_min_c", "s_suppkey * 1.25d as display_range_max_c",
        "case when s_suppkey % 2 = 0 then '100;160;200' else '100;160' end as cal_setpoints_c", "cast(s_suppkey % 80 as int) as source_pdf_page", "'halogen' as heater_technology", "1d as temperature_readability_c", "s_acctbal as adjustment_mass_value", "'g' as adjustment_mass_unit",
    )


def guidance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s, 90 + s) for k, s in enumerate([1, 2, 3, 4, 7])], "pos long, section int, source_pdf_page int")


def questions(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """A question for each order, and the fixed ones with negative ids."""
    words = "array(" + ", ".join(f"'{w}'" for w in WORDS) + ")"
    asked = orders.selectExpr(
        "o_orderkey as question_id",
        f"concat(case o_orderkey % 12 when 3 then 'current ' when 7 then 'legacy ' else '' end, 'What is the ', {words}[cast(o_orderkey % 8 as int)], ' for ', "
        "case when o_orderkey % 11 = 0 then concat('TS', 1 + o_custkey % 20) else concat('PX', 1000 + o_custkey + case when o_orderkey % 9 = 0 then 900000 else 0 end) end, '?') as question",
    )
    return asked.union(spark.createDataFrame([(-1 - k, q) for k, q in enumerate(FIXED)], "question_id long, question string"))


def knowledge(spark: SparkSession, sf_dir: str) -> Knowledge:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    current, legacy = raw_current(part), raw_legacy(part)
    heat, guide = temperature(spark.read.parquet(f"{sf_dir}/supplier.parquet")), guidance(spark)
    date = spark.createDataFrame([("2024-01",)], "document_date string")
    none = spark.createDataFrame([], "pos int, row string")
    return Knowledge(normalise.catalogue(current, legacy), heat, guide, none, none, none, normalise.meta(current, legacy, heat, date, "Master Tolerance Reference"))


#: Models of a raw document.
DOCUMENT_MODELS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as raw documents of DOCUMENT_MODELS keys each, whose number stands in
    document_date; the elements are in the order of their keys. Weight classes, as texts and as
    objects, stand for the tables of unknown elements."""
    part, supplier = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    number = F.floor((F.col("pos") + 1) / DOCUMENT_MODELS).cast("long").alias("number")

    def arrays(rows: DataFrame, name: str, of: str) -> DataFrame:
        fields = T.StructType.fromDDL(f"e {of}")["e"].dataType
        element = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        found = rows.groupBy(number).agg(F.array_sort(F.collect_list(F.struct("pos", element.alias("e"))), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("es"))  # at most DOCUMENT_MODELS
        return found.select("number", F.transform("es", lambda x: x["e"]).alias(name))

    current = arrays(raw_current(part), "current", schemas.CURRENT_IN)
    legacy = arrays(raw_legacy(part), "legacy", schemas.LEGACY_IN)
    heat = arrays(temperature(supplier), "temperature_specs", schemas.TEMPERATURE)
    guide = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(90 + s).alias("source_pdf_page")) for s in (1, 2, 3, 4, 7)])
    joined = current.join(legacy, "number", "full").join(heat, "number", "full")
    label = F.col("number").cast("string")
    limits = F.array(F.struct(F.concat(F.lit("E"), label).alias("class"), F.array("number", F.lit(None)).alias("limits"), F.lit(None).cast("string").alias("note")))
    return joined.select(label.alias("document_date"), "current", "legacy", "temperature_specs", guide.alias("guidance"), F.array(F.concat(F.lit("class "), label)).alias("weight_class_crossmap"), F.array(label, F.lit(None)).alias("series_class_recommendations"), limits.alias("mass_tolerances"))


def messages(conversations: DataFrame) -> DataFrame:
    """conversations with ids; a system message stands for the welcome message."""
    own = F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return conversations.withColumn("id", F.when(F.col("role") == "system", WELCOME).otherwise(own))


#: References by page_id % 10; {} is the page's own path with query and fragment.
REFERENCES = ["{}", "{} é?q=a b'c\"<>#top `x`", "/x/%2e%2E/./y/..{}", "/\\evil.example{}", "/\t/\nevil.example", "/{}", "/a/../callback", "{}/𝄞|^`\\..\\!?#", "/\\App.L%6fcal:443{}?", "{}100%?a+b\x7f#"]


def references(pages: DataFrame) -> DataFrame:
    """A place to return to for each page: the part of its url behind the host, in several
    forms, bad ones among them. A page without one has `/`."""
    own = F.coalesce(F.regexp_extract("url", r"(?s)^[a-z]+://[^/?#]*(.+)", 1), F.lit(""))
    forms = F.array(*[F.lit(r) for r in REFERENCES])
    form = F.get(forms, F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(len(REFERENCES))).cast("int"))
    return pages.select("page_id", F.replace(form, F.lit("{}"), F.when(own == "", "/").otherwise(own)).alias("reference"))
