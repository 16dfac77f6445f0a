"""A query for each operator of the lookup engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.functions import text as js
from specweave.functions import url
from specweave.operators import answering as a
from specweave.operators import conversation as conv
from specweave.operators import matching, normalise
from specweave.operators.assess import NOTE, assess, d_message, sum_message
from specweave.plans import driver_tables as d
from specweave.sources import knowledge
from specweave.sources.shared import shared_path, stored
from specweave.streaming.exchanges import exchange_stream_table
from specweave.streaming.questions import answer_stream_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries whose tasks run Python.
PYTHON = ("exchange_log",)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.raw_current(_table(spark, sf_dir, "part"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.questions(spark, _table(spark, sf_dir, "orders"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


# The derived tables in SQL, and JavaScript's functions as macros would be.
_NUM = "CASE WHEN {v} IS NULL THEN 'not published' ELSE regexp_replace(regexp_replace(format('{{:,.10f}}', {v}), '0+$', ''), '\\.$', '') END"
_PLAIN = "regexp_replace(format('{{}}', {v}), '\\.0$', '')"
_WORDS = "[" + ", ".join(f"'{w}'" for w in d.WORDS) + "]"
_FIXED = ", ".join(f"({-1 - k}, '{q}')" for k, q in enumerate(d.FIXED))

RAW = """
raw AS (
  SELECT p_partkey AS k, p_brand AS series, p_type AS manual, p_name, p_size + 31 AS page, p_size / 100.0::DOUBLE AS rep, 2 * p_size / 100.0::DOUBLE AS lin, 2 * p_size / 100.0::DOUBLE AS ocl,
    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 3 * p_size / 100.0::DOUBLE + 0.5 ELSE 3 * p_size / 100.0::DOUBLE END AS tol, CASE WHEN p_partkey % 17 = 0 THEN 4 ELSE 2 END AS ocl_d,
    p_retailprice AS cap, CASE WHEN p_partkey % 3 = 0 THEN p_size * 1.5::DOUBLE END AS cap2, p_size / 100.0::DOUBLE AS readability,
    nullif(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '2' END, '') AS astm, CASE WHEN p_partkey % 4 = 0 THEN 'F1' END AS oiml,
    'PX' || (1000 + p_partkey) || CASE WHEN p_partkey % 5 = 0 THEN '(N)' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ' (Fine)' ELSE '' END AS model,
    concat_ws('|', p_name, replace(p_brand, '#', '')) AS search, p_size
  FROM part
)"""
ALIASES = (
    RAW
    + """,
parts AS (SELECT 0 AS tbl, k, format('CUR-{:04d}', k) AS id, unnest(list_concat([model], string_split(search, '|'))) AS v FROM raw
  UNION ALL SELECT 1, k, format('LEG-{:04d}', k), 'PX' || (1000 + k) FROM raw WHERE k % 6 = 0),
forms AS (SELECT tbl, k, id, trim(regexp_replace(replace(v, '*', ''), '\\s+', ' ', 'g')) AS c FROM parts),
bare AS (SELECT *, regexp_replace(c, '(?i)\\s+\\((Fine|Full|Coarse)\\)$', '') AS b FROM forms),
aliases AS (
  SELECT DISTINCT tbl, k, id, f AS alias FROM (SELECT tbl, k, id, unnest([c, b, CASE WHEN regexp_matches(b, '(?i)^.*\\([A-Z]\\).*$') THEN regexp_replace(b, '(?i)^(.*)\\(([A-Z])\\)(.*)$', '\\1\\3') END,
    CASE WHEN regexp_matches(b, '(?i)^.*\\([A-Z]\\).*$') THEN regexp_replace(b, '(?i)^(.*)\\(([A-Z])\\)(.*)$', '\\1\\2\\3') END]) AS f FROM bare) WHERE f IS NOT NULL AND f <> ''
)"""
)
QUESTIONS = f"""
questions AS (
  SELECT o_orderkey AS question_id, CASE o_orderkey % 12 WHEN 3 THEN 'current ' WHEN 7 THEN 'legacy ' ELSE '' END || 'What is the ' || {_WORDS}[(o_orderkey % 8)::INT + 1] || ' for ' ||
    CASE WHEN o_orderkey % 11 = 0 THEN 'TS' || (1 + o_custkey % 20) ELSE 'PX' || (1000 + o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 900000 ELSE 0 END) END || '?' AS question
  FROM orders UNION ALL SELECT * FROM (VALUES {_FIXED})
)"""
#: Span by span: all runs of tokens of a question against the aliases, then the bounded test.
MATCHES = (
    ALIASES
    + ","
    + QUESTIONS
    + """,
up AS (SELECT question_id, trim(question) AS q, upper(question) AS u FROM questions),
toks AS (SELECT question_id, u, regexp_extract_all(u, '[A-Z0-9]+[^A-Z0-9]*') AS t FROM up),
spans AS (SELECT DISTINCT question_id, regexp_replace(array_to_string(t[i:i + n - 1], ''), '[^A-Z0-9]+$', '') AS s
  FROM (SELECT question_id, t, i, unnest(generate_series(1, 4)) AS n FROM (SELECT question_id, t, unnest(generate_series(1, len(t))) AS i FROM toks)) WHERE i + n - 1 <= len(t)),
pairs AS (
  SELECT DISTINCT question_id, id, tbl, k FROM (
    SELECT s.question_id, a.id, a.tbl, a.k FROM spans s JOIN aliases a ON upper(a.alias) = s.s
    UNION ALL
    SELECT u.question_id, a.id, a.tbl, a.k FROM up u JOIN aliases a ON NOT regexp_matches(a.alias, '[A-Za-z0-9]$') AND contains(u.u, upper(a.alias))
      AND regexp_matches(u.u, '(^|[^A-Z0-9])' || replace(replace(upper(a.alias), '(', '\\('), ')', '\\)') || '($|[^A-Z0-9])')
  )
)"""
)
INTENT = """CASE WHEN regexp_matches(lower({q}), 'temperature|heater|setpoint|set point') THEN 'temperature'
  WHEN regexp_matches(lower({q}), 'off[^\\n\\r]?center|\\bocl\\b|corner load') THEN 'ocl' WHEN regexp_matches(lower({q}), 'repeatab') THEN 'repeatability' WHEN regexp_matches(lower({q}), 'linear') THEN 'linearity'
  WHEN regexp_matches(lower({q}), 'readability|resolution|smallest division|\\bd value\\b') THEN 'readability' WHEN regexp_matches(lower({q}), 'capacity|maximum load|max load') THEN 'capacity'
  WHEN regexp_matches(lower({q}), 'calibration[^\\n\\r]*class|weight class|which class|\\bastm\\b|\\boiml\\b') THEN 'calibration' ELSE 'tolerance' END"""
SECTION = """CASE WHEN regexp_matches(lower({q}), 'tolerance[^\\n\\r]*uncertainty|uncertainty[^\\n\\r]*tolerance') THEN 2 WHEN regexp_matches(lower({q}), '\\bmpe\\b|maximum permissible error') THEN 3
  WHEN regexp_matches(lower({q}), 'class f') THEN 4 WHEN regexp_matches(lower({q}), '1\\s*/\\s*3|one[^\\n\\r]?third|third rule') THEN 7
  WHEN regexp_matches(lower({q}), 'astm[^\\n\\r]*oiml|oiml[^\\n\\r]*astm|class systems?') THEN 4 WHEN regexp_matches(lower({q}), 'what[^\\n\\r]*tolerance|define tolerance|weight tolerance') THEN 1 END"""
GUARD = "len(list_filter(regexp_extract_all({q}, '[A-Za-z0-9]+(?:-+[A-Za-z0-9]+)*'), lambda t: length(t) >= 4 AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]'))) > 0"


@query(f"WITH {RAW} SELECT k AS p_partkey, trim(regexp_replace(replace(model || ' *  ' || p_name, '*', ''), '\\s+', ' ', 'g')) AS alias FROM raw")
def clean_alias(spark, sf_dir):
    return _raw(spark, sf_dir).join(_table(spark, sf_dir, "part"), F.col("pos") + 1 == F.col("p_partkey")).select("p_partkey", normalise.clean_alias(F.concat("model_group", F.lit(" *  "), "p_name")).alias("alias"))


@query(f"WITH {ALIASES} SELECT DISTINCT k AS p_partkey, f AS alias FROM (SELECT k, unnest([c, b, CASE WHEN regexp_matches(b, '\\([A-Z]\\)') THEN regexp_replace(b, '\\(([A-Z])\\)', '') END, CASE WHEN regexp_matches(b, '\\([A-Z]\\)') THEN regexp_replace(b, '\\(([A-Z])\\)', '\\1') END]) AS f FROM bare JOIN raw USING (k) WHERE tbl = 0 AND c LIKE 'PX%') WHERE f IS NOT NULL")
def expand_alias(spark, sf_dir):
    return _raw(spark, sf_dir).select((F.col("pos") + 1).alias("p_partkey"), F.explode(normalise.expand_alias(F.col("model_group"))).alias("alias"))


@query(f"WITH {ALIASES} SELECT id, alias, count(*) OVER (PARTITION BY id) AS n_aliases FROM aliases")
def aliases_for(spark, sf_dir):
    records = d.knowledge(spark, sf_dir).records
    return records.select("id", F.explode("aliases").alias("alias"), F.size("aliases").cast("long").alias("n_aliases"))


@query("SELECT p_partkey, format('CUR-{:04d}', p_partkey) AS id FROM part")
def surrogate_key(spark, sf_dir):
    return _raw(spark, sf_dir).select((F.col("pos") + 1).alias("p_partkey"), normalise.surrogate_key("CUR", F.col("pos")).alias("id"))


@query("SELECT lifecycle, count(*) AS n FROM (SELECT CASE WHEN p_size + 31 IN (79, 80) THEN 'legacy' ELSE 'current' END AS lifecycle FROM part UNION ALL SELECT 'legacy' FROM part WHERE p_partkey % 6 = 0) GROUP BY 1")
def lifecycle(spark, sf_dir):
    return d.knowledge(spark, sf_dir).records.groupBy("lifecycle").agg(F.count("*").alias("n"))


@query(f"WITH {RAW} SELECT format('CUR-{{:04d}}', k) AS id, astm, oiml FROM raw")
def falsy_null(spark, sf_dir):
    return d.knowledge(spark, sf_dir).records.filter("tbl = 0").select("id", "calibration.astm", "calibration.oiml")


@query(f"WITH {RAW} SELECT format('CUR-{{:04d}}', k) AS id, cap, 'g' AS unit, cap2, rep, lin, ocl, tol, readability, manual, page FROM raw")
def current_records(spark, sf_dir):
    r = d.knowledge(spark, sf_dir).records.filter("tbl = 0")
    return r.selectExpr("id", "capacity.value as cap", "capacity.unit as unit", "capacity.secondaryValue as cap2", "repeatability.value as rep", "linearity.value as lin", "ocl.value as ocl", "tolerance.value as tol", "readability.value as readability", "source.manual as manual", "source.page as page")


@query(f"WITH {RAW} SELECT format('LEG-{{:04d}}', k) AS id, 'legacy' AS lifecycle, series, manual AS table_title, 'PX' || (1000 + k) AS model_group, rep, lin, NULL::DOUBLE AS ocl, NULL::DOUBLE AS tol, NULL::VARCHAR AS status, p_size AS page FROM raw WHERE k % 6 = 0")
def legacy_records(spark, sf_dir):
    r = d.knowledge(spark, sf_dir).records.filter("tbl = 1")
    return r.selectExpr("id", "lifecycle", "series", "tableTitle as table_title", "modelGroup as model_group", "repeatability.value as rep", "linearity.value as lin", "ocl.value as ocl", "tolerance.value as tol", "qa.status as status", "source.page as page")


@query("SELECT 'Master Tolerance Reference' AS title, '2024-01' AS documentDate, (SELECT count(*) FROM part) AS currentRecords, (SELECT count(*) FROM part WHERE p_partkey % 6 = 0) AS legacyRecords, (SELECT count(*) FROM supplier) AS temperatureRecords, 21 AS knownQaItems")
def meta_counts(spark, sf_dir):
    return d.knowledge(spark, sf_dir).meta


_SUM = f"CASE WHEN tol IS NOT NULL AND abs(rep + lin - tol) > 1e-9 THEN 'Published tolerance ' || {_PLAIN.format(v='tol')} || ' g differs from repeatability + linearity (' || {_PLAIN.format(v='(rep + lin)')} || ' g).' END"


@query(f"WITH {RAW} SELECT k AS p_partkey, {_SUM} AS message FROM raw")
def qa_sum_check(spark, sf_dir):
    return _raw(spark, sf_dir).select((F.col("pos") + 1).alias("p_partkey"), sum_message().alias("message"))


_D_TOL = f"CASE WHEN tol IS NOT NULL AND abs(tol / readability - 3) > 1e-4 THEN 'Published tolerance converts to ' || {_PLAIN.format(v='(tol / readability)')} || 'd, while the source lists 3d.' END"
_D_OCL = f"CASE WHEN abs(ocl / readability - ocl_d) > 1e-4 THEN 'Published OCL converts to ' || {_PLAIN.format(v='(ocl / readability)')} || 'd, while the source lists ' || ocl_d || 'd.' END"


@query(f"WITH {RAW} SELECT k AS p_partkey, {_D_TOL} AS tolerance_message, {_D_OCL} AS ocl_message FROM raw")
def qa_d_check(spark, sf_dir):
    return _raw(spark, sf_dir).select((F.col("pos") + 1).alias("p_partkey"), d_message("tolerance", "tolerance").alias("tolerance_message"), d_message("ocl", "OCL").alias("ocl_message"))


@query(f"""WITH {RAW}, n AS (SELECT k, (tol IS NOT NULL AND abs(rep + lin - tol) > 1e-9)::INT + (tol IS NOT NULL AND abs(tol / readability - 3) > 1e-4)::INT + (abs(ocl / readability - ocl_d) > 1e-4)::INT + (page = 49)::INT AS n FROM raw)
SELECT k AS p_partkey, CASE WHEN n > 0 THEN 'review' ELSE 'ok' END AS status, n AS n_messages FROM n""")
def qa_verdict(spark, sf_dir):
    return _raw(spark, sf_dir).select((F.col("pos") + 1).alias("p_partkey"), assess().alias("qa")).select("p_partkey", "qa.status", F.size("qa.messages").alias("n_messages"))


@query(f"WITH {RAW}, n AS (SELECT k, (tol IS NOT NULL AND abs(rep + lin - tol) > 1e-9) OR (tol IS NOT NULL AND abs(tol / readability - 3) > 1e-4) OR abs(ocl / readability - ocl_d) > 1e-4 OR page = 49 AS bad FROM raw) SELECT format('CUR-{{:04d}}', k) AS id, CASE WHEN bad THEN 'Source review' ELSE 'Verified' END AS badge FROM n UNION ALL SELECT format('LEG-{{:04d}}', k), 'Verified' FROM raw WHERE k % 6 = 0")
def qa_badge(spark, sf_dir):
    return d.knowledge(spark, sf_dir).records.select("id", conv.qa_badge(F.col("qa.status")).alias("badge"))


_NOTED = f"CASE WHEN page = 49 THEN {_quoted(NOTE)} END"


@query(f"WITH {RAW}, notes AS (SELECT k, list_filter([{_SUM}, {_D_TOL}, {_D_OCL}, {_NOTED}], lambda m: m IS NOT NULL) AS m FROM raw) SELECT format('CUR-{{:04d}}', k) AS id, i - 1 AS place, m[i] AS message FROM (SELECT k, m, unnest(range(1, len(m) + 1)) AS i FROM notes)")
def qa_notes(spark, sf_dir):
    return conv.qa_notes(d.knowledge(spark, sf_dir).records).select("id", F.col("place").cast("long").alias("place"), "message")


@query(f"WITH {QUESTIONS}, t AS (SELECT 'q' || question_id AS id, question AS t FROM questions UNION ALL SELECT 'd' || doc_id, text FROM documents) SELECT id, {INTENT.format(q='t')} AS intent FROM t")
def detect_intent(spark, sf_dir):
    q = _questions(spark, sf_dir).select(F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("id"), F.col("question").alias("t"))
    t = q.union(_texts(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text"))
    return t.select("id", a.detect_intent(F.col("t")).alias("intent"))


def _matched(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    return matching.matches(_questions(spark, sf_dir), matching.alias_index(d.knowledge(spark, sf_dir).records), strategy)


@query(f"WITH {MATCHES} SELECT question_id, id FROM pairs")
def exact_token_match_span(spark, sf_dir):
    return _matched(spark, sf_dir, "span")


@query(f"WITH {MATCHES} SELECT question_id, id FROM pairs WHERE question_id % 50 = 0")
def exact_token_match_theta(spark, sf_dir):
    """The search by its definition: the questions whose id is divisible by 50 against all aliases."""
    asked = _questions(spark, sf_dir).filter("question_id % 50 = 0")
    return matching.matches(asked, matching.alias_index(d.knowledge(spark, sf_dir).records), "theta")


FOUND = (
    MATCHES
    + """,
own AS (SELECT p.question_id, p.id, p.tbl, p.k, r.page, r.manual, r.p_size, u.q, CASE WHEN p.tbl = 1 OR r.page IN (79, 80) THEN 'legacy' ELSE 'current' END AS lifecycle, r.series, count(*) OVER (PARTITION BY p.question_id) AS n_all
  FROM pairs p JOIN raw r USING (k) JOIN up u USING (question_id)),
wants AS (SELECT *, CASE WHEN n_all > 1 THEN CASE WHEN regexp_matches(lower(q), '\\b(current|new|latest)\\b') THEN 'current' WHEN regexp_matches(lower(q), '\\b(legacy|old|older|discontinued)\\b') THEN 'legacy' END END AS w FROM own),
found AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM wants WHERE w IS NULL OR lifecycle = w)"""
)


def _found(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched pairs, made once, with these columns of the record more; the questions and the records."""
    records = d.knowledge(spark, sf_dir).records
    q = _questions(spark, sf_dir).select("question_id", a.question_text(F.col("question")).alias("q"))
    index = matching.alias_index(records, *a.CARRIED).select(*more, *a.CARRIED, "alias")
    return stored(matching.matches(a.asking(q), index), "pairs"), q, records


@query(f"WITH {FOUND}, k AS (SELECT question_id, max(n_all) AS n_all FROM own GROUP BY 1), f AS (SELECT question_id, count(*) AS n FROM found GROUP BY 1) SELECT question_id, coalesce(n, 0) AS n, CASE coalesce(n, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'model' ELSE 'ambiguous' END AS kind FROM k LEFT JOIN f USING (question_id)")
def match_cardinality(spark, sf_dir):
    n = F.col("n")
    return a.settled(_found(spark, sf_dir)[0]).select("question_id", "n", F.when(n == 0, "none").when(n == 1, "model").otherwise("ambiguous").alias("kind"))


@query(f"WITH {FOUND} SELECT question_id, id, lifecycle FROM found")
def lifecycle_disambiguation(spark, sf_dir):
    return a.lasting(_found(spark, sf_dir, "id")[0]).select("question_id", "id", "lifecycle")


@query(f"WITH {FOUND} SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY tbl, k) - 1 AS place, id, CASE WHEN lifecycle = 'current' THEN 'Current' ELSE 'Legacy' END || ' · ' || series AS label, q || ' (' || lifecycle || ')' AS question, manual, CASE WHEN tbl = 1 THEN p_size ELSE page END AS page FROM found WHERE n > 1")
def ambiguous_options(spark, sf_dir):
    pairs, asked, records = _found(spark, sf_dir)
    many = a.choices(pairs, a.settled(pairs), asked, records)
    return many.select("question_id", "place", a.option().alias("o")).select("question_id", "place", "o.id", "o.label", "o.question", "o.source.manual", "o.source.page")


@query(f"SELECT doc_id, {GUARD.format(q='text')} AS model_like FROM documents")
def unknown_model_guard(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", a.looks_like_model(F.col("text")).alias("model_like"))


@query(f"WITH {QUESTIONS} SELECT question_id, {SECTION.format(q='question')} AS section FROM questions")
def guidance_router(spark, sf_dir):
    return _questions(spark, sf_dir).select("question_id", a.guidance_section(F.col("question")).alias("section"))


_TEMPERATURE = f"""'TS' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '/TX' ELSE ' / TX' END || s_suppkey || ' has a published temperature tolerance of ±' || {_NUM.format(v='(s_suppkey % 9 / 4.0::DOUBLE)')} || ' °C. Its display range is 40–' || {_NUM.format(v='(s_suppkey * 1.25::DOUBLE)')} ||
  ' °C, with calibration setpoints at ' || CASE WHEN s_suppkey % 2 = 0 THEN '100 and160;200' ELSE '100 and160' END || ' °C.'"""


@query(f"""WITH {QUESTIONS}, t AS (SELECT question_id, regexp_extract_all(upper(question), '[A-Z0-9]+') AS t FROM questions)
SELECT question_id, s_suppkey FROM t, supplier WHERE list_has_any(t, ['TS' || s_suppkey, 'TX' || s_suppkey])""")
def temperature_matches(spark, sf_dir):
    heat = matching.temperature_index(d.temperature(_table(spark, sf_dir, "supplier")))
    return matching.matches(_questions(spark, sf_dir), heat).select("question_id", (F.col("id") + 1).alias("s_suppkey"))


@query("SELECT s_suppkey, 'halogen' AS heater, '1 °C' AS temperature_readability, regexp_replace(format('{}', s_acctbal), '\\.0$', '') || ' g' AS adjustment_mass FROM supplier")
def temperature_card(spark, sf_dir):
    card = conv.temperature_card(d.temperature(_table(spark, sf_dir, "supplier")))
    return card.select((F.col("pos") + 1).alias("s_suppkey"), "heater", "temperature_readability", "adjustment_mass")


@query(f"SELECT s_suppkey, {_TEMPERATURE} AS text FROM supplier")
def temperature_answer(spark, sf_dir):
    return d.temperature(_table(spark, sf_dir, "supplier")).select((F.col("pos") + 1).alias("s_suppkey"), a.temperature_text().alias("text"))


@query(f"SELECT p_partkey, {_NUM.format(v='p_retailprice')} AS shown, {_NUM.format(v='(p_retailprice * 1000)')} AS thousand FROM part")
def format_number(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", js.format_number(F.col("p_retailprice")).alias("shown"), js.format_number(F.col("p_retailprice") * 1000).alias("thousand"))


_M = "CASE WHEN {v} IS NULL THEN 'Not published' ELSE '±' || " + _NUM + " || ' g (±' || {d} || 'd)' END"


@query(f"WITH {RAW} SELECT k AS p_partkey, {_M.format(v='tol', d='3')} AS tolerance, {_M.format(v='ocl', d='ocl_d')} AS ocl FROM raw")
def measure_text(spark, sf_dir):
    return _raw(spark, sf_dir).select((F.col("pos") + 1).alias("p_partkey"), a.measure_text(F.col("tolerance"), True).alias("tolerance"), a.measure_text(F.col("ocl"), True).alias("ocl"))


_CAP = f"{_NUM.format(v='cap')} || ' g' || CASE WHEN cap2 IS NOT NULL THEN ' / ' || {_NUM.format(v='cap2')} || ' oz' ELSE '' END"


@query(f"WITH {RAW} SELECT format('CUR-{{:04d}}', k) AS id, {_CAP} AS capacity FROM raw UNION ALL SELECT format('LEG-{{:04d}}', k), 'Not published' FROM raw WHERE k % 6 = 0")
def capacity_text(spark, sf_dir):
    return d.knowledge(spark, sf_dir).records.select("id", a.capacity_text(F.col("capacity")).alias("capacity"))


_REP, _LIN, _OCL, _TOL = (_M.format(v=v, d=n) for v, n in (("rep", "1"), ("lin", "2"), ("ocl", "ocl_d"), ("tol", "3")))
_CLASSES = "CASE WHEN astm IS NULL AND oiml IS NULL THEN 'Not published for this record' ELSE 'ASTM Class ' || coalesce(astm, 'not published') || ' / OIML ' || coalesce(oiml, 'not published') END"
MODEL = (
    RAW
    + f""",
recs AS (
  SELECT format('CUR-{{:04d}}', k) AS id, model, CASE WHEN page IN (79, 80) THEN 'legacy' ELSE 'current' END AS lifecycle, {_REP} AS rep, {_LIN} AS lin, {_OCL} AS ocl, {_NUM.format(v="readability")} || ' g' AS readability, {_CAP} AS cap, {_CLASSES} AS classes, {_TOL} AS tol, manual, page FROM raw
  UNION ALL SELECT format('LEG-{{:04d}}', k), 'PX' || (1000 + k), 'legacy', {_REP}, {_LIN}, 'Not published', 'Not published', 'Not published', 'Not published for this record', 'Not published', manual, p_size FROM raw WHERE k % 6 = 0
)"""
)
_FACT = "CASE intent WHEN 'repeatability' THEN rep WHEN 'linearity' THEN lin WHEN 'ocl' THEN ocl WHEN 'readability' THEN readability WHEN 'capacity' THEN cap WHEN 'calibration' THEN classes ELSE tol END"
_TEXT = """CASE intent WHEN 'repeatability' THEN 'The ' || model || ' repeatability specification is ' || rep || '.' WHEN 'linearity' THEN 'The ' || model || ' linearity specification is ' || lin || '.'
  WHEN 'ocl' THEN 'The ' || model || ' off-center-load specification is ' || ocl || '.' WHEN 'readability' THEN 'The ' || model || ' readability is ' || readability || '.' WHEN 'capacity' THEN 'The ' || model || ' capacity is ' || cap || '.'
  WHEN 'calibration' THEN model || ' calls for ' || classes || '. A tighter class is acceptable; do not substitute a looser class without reviewing the application.'
  ELSE CASE WHEN tol = 'Not published' THEN 'I found ' || model || ', but this ' || lifecycle || ' record does not publish a combined tolerance. Its published repeatability is ' || rep || ' and linearity is ' || lin || '.'
    ELSE 'The ' || model || ' combined tolerance is ' || tol || '. This is the published repeatability-plus-linearity service limit, not calibration-weight uncertainty.' END END"""
_LABEL = """CASE intent WHEN 'repeatability' THEN 'Repeatability' WHEN 'linearity' THEN 'Linearity' WHEN 'ocl' THEN 'Off-center load' WHEN 'readability' THEN 'Readability' WHEN 'capacity' THEN 'Capacity'
  WHEN 'calibration' THEN 'Calibration weight class' ELSE 'Combined tolerance' END"""
_INTENTS = "(SELECT unnest(['temperature', 'ocl', 'repeatability', 'linearity', 'readability', 'capacity', 'calibration', 'tolerance']) AS intent)"


@query(f"WITH {MODEL} SELECT id, intent, {_TEXT} AS text, {_LABEL} AS label, {_FACT} AS fact FROM recs, {_INTENTS}")
def model_answer(spark, sf_dir):
    names = F.array(*[F.lit(n) for n, _ in a.INTENTS], F.lit("tolerance"))
    rows = d.knowledge(spark, sf_dir).records.withColumn("intent", F.explode(names))
    return rows.select("id", "intent", a.model_answer(F.col("intent")).alias("m")).select("id", "intent", "m.text", F.col("m.factLabel").alias("label"), F.col("m.factValue").alias("fact"))


_GUIDES = " ".join(f"WHEN {k} THEN {_quoted(v.format(maker='manufacturer'))}" for k, v in a.SUMMARIES.items())
ANSWERS = FOUND + MODEL.removeprefix(RAW) + f""",
heat AS (SELECT u.question_id, s.s_suppkey, {_TEMPERATURE} AS t_text, s_suppkey % 80 AS t_page, count(*) OVER (PARTITION BY question_id) AS m
  FROM toks u JOIN supplier s ON list_has_any(list_transform(t, lambda x: regexp_replace(x, '[^A-Z0-9]+$', '')), ['TS' || s_suppkey, 'TX' || s_suppkey])),
one AS (SELECT question_id, min(id) AS id FROM found WHERE n = 1 GROUP BY 1),
ns AS (SELECT question_id, max(n) AS n FROM found GROUP BY 1),
every AS (SELECT u.question_id, u.q, {INTENT.format(q="u.q")} AS intent, {SECTION.format(q="u.q")} AS section, coalesce(n, 0) AS n, h.s_suppkey, t_text, t_page, r.*
  FROM up u LEFT JOIN ns USING (question_id) LEFT JOIN one o USING (question_id) LEFT JOIN recs r ON o.id = r.id LEFT JOIN (SELECT * FROM heat WHERE m = 1) h ON u.question_id = h.question_id),
kinds AS (SELECT *, CASE WHEN q = '' THEN 'empty' WHEN intent = 'temperature' AND s_suppkey IS NOT NULL THEN 'temperature' WHEN n = 1 THEN 'model' WHEN n > 1 THEN 'ambiguous'
  WHEN {GUARD.format(q="q")} THEN 'unknown' WHEN section IS NOT NULL THEN 'guidance' ELSE 'fallback' END AS what FROM every)
SELECT question_id, CASE WHEN what IN ('empty', 'unknown', 'fallback') THEN 'not-found' ELSE what END AS kind,
  CASE what WHEN 'empty' THEN {_quoted(a.EMPTY)} WHEN 'temperature' THEN t_text WHEN 'model' THEN {_TEXT} WHEN 'ambiguous' THEN 'I found ' || n || ' records for that model. Choose the applicable version so I do not mix current and legacy specifications.'
    WHEN 'unknown' THEN {_quoted(a.UNKNOWN_MODEL)} WHEN 'guidance' THEN CASE section {_GUIDES} END ELSE {_quoted(a.FALLBACK)} END AS text,
  CASE WHEN what = 'model' THEN {_LABEL} END AS fact_label, CASE WHEN what = 'model' THEN {_FACT} END AS fact_value, CASE WHEN what = 'model' THEN id END AS record_id,
  CASE what WHEN 'temperature' THEN {_quoted(a.TEMPERATURE_MANUAL)} WHEN 'model' THEN manual WHEN 'guidance' THEN {_quoted(a.GUIDANCE_MANUAL)} END AS source_manual,
  CASE what WHEN 'temperature' THEN t_page WHEN 'model' THEN page WHEN 'guidance' THEN 90 + section END AS source_page, CASE WHEN what = 'ambiguous' THEN n ELSE 0 END AS n_options
FROM kinds"""


def _flat(answers: DataFrame) -> DataFrame:
    return answers.select(
        "question_id", "kind", "text", F.col("factLabel").alias("fact_label"), F.col("factValue").alias("fact_value"), F.col("recordId").alias("record_id"), F.col("source.manual").alias("source_manual"), F.col("source.page").cast("long").alias("source_page"), F.greatest(F.size("options"), F.lit(0)).cast("long").alias("n_options")
    )


@query(f"WITH {ANSWERS}")
def answer_all(spark, sf_dir):
    k = d.knowledge(spark, sf_dir)
    return _flat(a.answer_all(_questions(spark, sf_dir), k.records, k.temperature, k.guidance))


@query(f"WITH {ANSWERS}")
def answer_stream(spark, sf_dir):
    """All questions as a stream, answered batch by batch."""
    k = d.knowledge(spark, sf_dir)
    return _flat(answer_stream_table(_questions(spark, sf_dir), k.records, k.temperature, k.guidance))


PAIRS = """
placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS spot FROM conversations WHERE role <> 'system'),
grouped AS (SELECT conv_id, spot // 2 AS pair, max(CASE WHEN spot % 2 = 0 THEN role END) AS r0, max(CASE WHEN spot % 2 = 1 THEN role END) AS r1, max(CASE WHEN spot % 2 = 0 THEN text END) AS user, max(CASE WHEN spot % 2 = 1 THEN text END) AS assistant FROM placed GROUP BY ALL),
exchanges AS (SELECT conv_id, pair, "user", assistant FROM grouped WHERE r0 = 'user' AND r1 = 'assistant')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.exchanges(conv.without_welcome(d.messages(_table(spark, sf_dir, "conversations"))))


@query(f'WITH {PAIRS} SELECT conv_id, pair, "user", assistant FROM exchanges')
def conversation_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f'WITH {PAIRS} SELECT conv_id, pair, "user", assistant FROM exchanges')
def exchange_log(spark, sf_dir):
    """The same pairs from the log as a stream that grows three times."""
    messages = d.messages(_table(spark, sf_dir, "conversations")).select("id", "conv_id", "turn", "role", "text")
    return exchange_stream_table([messages.filter(c) for c in ("turn < 2", "turn between 2 and 4", "turn > 4")])


@query(f"WITH {PAIRS} SELECT conv_id, max(pair) AS pair, arg_max(\"user\", pair) AS \"user\", arg_max(assistant, pair) AS assistant FROM exchanges GROUP BY 1")
def latest_exchange(spark, sf_dir):
    return conv.latest(_pairs(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT conv_id, pair, row_number() OVER (PARTITION BY conv_id ORDER BY pair DESC) - 1 AS place FROM exchanges QUALIFY place > 0")
def exchange_history(spark, sf_dir):
    return conv.history(_pairs(spark, sf_dir)).select("conv_id", "pair", F.col("place").cast("long").alias("place"))


@query(f"WITH {PAIRS} SELECT conv_id, pair, row_number() OVER (PARTITION BY conv_id ORDER BY pair DESC) - 1 AS place FROM exchanges")
def latest_first(spark, sf_dir):
    return conv.latest_first(_pairs(spark, sf_dir)).select("conv_id", "pair", F.col("place").cast("long").alias("place"))


@query(f"WITH {PAIRS} SELECT conv_id, count(*) - 1 AS n_history FROM exchanges GROUP BY 1")
def history_count(spark, sf_dir):
    return conv.history_count(_pairs(spark, sf_dir))


@query(f"WITH {MODEL} SELECT id, readability, rep AS repeatability, lin AS linearity, ocl FROM recs")
def spec_card(spark, sf_dir):
    return conv.spec_card(d.knowledge(spark, sf_dir).records)


@query(f"WITH {MODEL} SELECT id, 'Source: ' || manual || ' · Master reference page ' || page AS line FROM recs")
def source_line(spark, sf_dir):
    return d.knowledge(spark, sf_dir).records.select("id", conv.source_line(F.col("source")).alias("line"))


@query("SELECT 'known' AS meta, n AS total, format('{:,d}', n) AS shown FROM (SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM part WHERE p_partkey % 6 = 0) AS n) UNION ALL SELECT 'none', 746, '746'")
def record_total(spark, sf_dir):
    meta = d.knowledge(spark, sf_dir).meta
    return conv.record_total(meta).select(F.lit("known").alias("meta"), "total", "shown").union(conv.record_total(meta.filter("false")).select(F.lit("none"), "total", "shown"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as raw JSON documents, written to the shared folder and read again."""
    path = shared_path(spark, "documents")
    knowledge.write_documents(d.documents(spark, sf_dir), path)
    return knowledge.read_document(spark, path)


@query(f"""WITH {RAW} SELECT (k // 500)::VARCHAR AS document_date, row_number() OVER (PARTITION BY k // 500 ORDER BY k) - 1 AS pos, model AS model_group, search AS search_aliases, cap, tol, rep, ocl_d, page FROM raw""")
def raw_documents(spark, sf_dir):
    rows = knowledge.unnest(_documents(spark, sf_dir), "current", "document_date")
    return rows.select("document_date", F.col("pos").cast("long").alias("pos"), "model_group", "search_aliases", F.col("capacity_primary").alias("cap"), F.col("tolerance.value").alias("tol"), F.col("repeatability.value").alias("rep"), F.col("ocl.d").cast("long").alias("ocl_d"), F.col("source_pdf_page").cast("long").alias("page"))


@query(f"""WITH {RAW}, ns AS (SELECT DISTINCT k // 500 AS n FROM raw UNION SELECT DISTINCT s_suppkey // 500 FROM supplier),
rows_ AS (
  SELECT k // 500 AS n, 'legacy' AS name, row_number() OVER (PARTITION BY k // 500 ORDER BY k) - 1 AS pos, 'PX' || (1000 + k) AS shown FROM raw WHERE k % 6 = 0
  UNION ALL SELECT s_suppkey // 500, 'temperature_specs', row_number() OVER (PARTITION BY s_suppkey // 500 ORDER BY s_suppkey) - 1, 'TS' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '/TX' ELSE ' / TX' END || s_suppkey FROM supplier
  UNION ALL SELECT n, 'guidance', i - 1, ([1, 2, 3, 4, 7][i])::VARCHAR FROM ns, (SELECT unnest(range(1, 6)) AS i)
  UNION ALL SELECT n, 'weight_class_crossmap', 0, 'class ' || n FROM ns
  UNION ALL SELECT n, 'series_class_recommendations', i, CASE WHEN i = 0 THEN n::VARCHAR END FROM ns, (SELECT unnest(range(2)) AS i)
  UNION ALL SELECT n, 'mass_tolerances', 0, '{{"class":"E' || n || '","limits":[' || n || ',null],"note":null}}' FROM ns
) SELECT n::VARCHAR AS document_date, name, pos, shown FROM rows_""")
def passed_through_tables(spark, sf_dir):
    """The other tables of the documents."""
    read = _documents(spark, sf_dir)
    shown = {"legacy": "model_group", "temperature_specs": "model_group", "guidance": "section", "weight_class_crossmap": "row", "series_class_recommendations": "row", "mass_tolerances": "row"}
    parts = [knowledge.unnest(read, name, "document_date").select("document_date", F.lit(name).alias("name"), F.col("pos").cast("long").alias("pos"), F.col(column).cast("string").alias("shown")) for name, column in shown.items()]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH {ALIASES}, ns AS (SELECT DISTINCT k // 500 AS n FROM raw UNION SELECT DISTINCT s_suppkey // 500 FROM supplier),
named AS (SELECT tbl, k, count(*) AS n_aliases FROM aliases GROUP BY ALL),
recs AS (
  SELECT k // 500 AS n, 'current' AS member, 'CUR' AS prefix, k, trim(regexp_replace(replace(model, '*', ''), '\\s+', ' ', 'g')) AS shown, tol AS value, n_aliases,
    CASE WHEN (tol IS NOT NULL AND (abs(rep + lin - tol) > 1e-9 OR abs(tol / readability - 3) > 1e-4)) OR abs(ocl / readability - ocl_d) > 1e-4 OR page = 49 THEN 'review' ELSE 'ok' END AS status FROM raw JOIN named USING (k) WHERE tbl = 0
  UNION ALL SELECT k // 500, 'legacy', 'LEG', k, 'PX' || (1000 + k), lin, n_aliases, NULL FROM raw JOIN named USING (k) WHERE tbl = 1
), placed AS (SELECT *, row_number() OVER (PARTITION BY n, member ORDER BY k) - 1 AS pos FROM recs),
heat AS (SELECT s_suppkey // 500 AS n, s_suppkey AS k, 'TS' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '/TX' ELSE ' / TX' END || s_suppkey AS shown FROM supplier),
counts AS (SELECT n, unnest(['currentRecords', 'legacyRecords', 'temperatureRecords', 'knownQaItems']) AS id, unnest([0, 1, 2, 3]) AS pos,
  unnest([(SELECT count(*) FROM recs r WHERE r.n = ns.n AND member = 'current'), (SELECT count(*) FROM recs r WHERE r.n = ns.n AND member = 'legacy'), (SELECT count(*) FROM heat h WHERE h.n = ns.n), 21]) AS c FROM ns)
SELECT n::VARCHAR AS document_date, member, pos, format('{{}}-{{:04d}}', prefix, pos + 1) AS id, shown, value, status, n_aliases FROM placed
UNION ALL SELECT n::VARCHAR, 'meta', pos, id, 'Master Tolerance Reference', c::DOUBLE, NULL, NULL FROM counts
UNION ALL SELECT n::VARCHAR, 'temperatureSpecs', row_number() OVER (PARTITION BY n ORDER BY k) - 1, NULL, shown, NULL, NULL, NULL FROM heat
UNION ALL SELECT n::VARCHAR, 'guidance', i - 1, NULL, ([1, 2, 3, 4, 7][i])::VARCHAR, NULL, NULL, NULL FROM ns, (SELECT unnest(range(1, 6)) AS i)
UNION ALL SELECT n::VARCHAR, 'classCrossMap', 0, NULL, 'class ' || n, NULL, NULL, NULL FROM ns
UNION ALL SELECT n::VARCHAR, 'seriesClassRecommendations', i, NULL, CASE WHEN i = 0 THEN n::VARCHAR END, NULL, NULL, NULL FROM ns, (SELECT unnest(range(2)) AS i)
UNION ALL SELECT n::VARCHAR, 'massTolerances', 0, NULL, '{{"class":"E' || n || '","limits":[' || n || ',null],"note":null}}', NULL, NULL, NULL FROM ns""")
def output_documents(spark, sf_dir):
    """The output document of each raw one, written as JSON, read again and taken apart."""
    path = shared_path(spark, "outputs")
    knowledge.write_output(knowledge.output_documents(_documents(spark, sf_dir)), path)
    read = knowledge.read_output(spark, path).withColumn("document_date", F.col("meta.documentDate"))
    columns = ["document_date", "member", "pos", "id", "shown", "value", "status", "n_aliases"]

    def rows(member: str, **of) -> DataFrame:
        found = knowledge.unnest(read, member, "document_date").withColumn("member", F.lit(member))
        kinds = {"pos": "long", "value": "double", "n_aliases": "long"}
        made = {c: of.get(c, F.col(c) if c in ("document_date", "member", "pos") else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in columns}
        return found.select(*made.values())

    aliases = F.size("aliases")
    parts = [rows("current", id=F.col("id"), shown=F.col("modelGroup"), value=F.col("tolerance.value"), status=F.col("qa.status"), n_aliases=aliases), rows("legacy", id=F.col("id"), shown=F.col("modelGroup"), value=F.col("linearity.value"), n_aliases=aliases)]
    shown = {"temperatureSpecs": F.try_variant_get("row", "$.model_group", "string"), "guidance": F.col("section")}
    parts += [rows(m, shown=shown.get(m, F.col("row").cast("string"))) for m in knowledge.COPIED]
    counts = ["currentRecords", "legacyRecords", "temperatureRecords", "knownQaItems"]
    meta = read.select("document_date", "meta.title", F.posexplode(F.array(*[F.struct(F.lit(c).alias("id"), F.col(f"meta.{c}").cast("double").alias("value")) for c in counts])).alias("pos", "m"))
    parts.append(meta.select("document_date", F.lit("meta").alias("member"), F.col("pos").cast("long"), "m.id", F.col("title").alias("shown"), "m.value", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("n_aliases")))
    return reduce(DataFrame.unionByName, parts)


_ASKED = "asked AS (SELECT conv_id, max(turn) + 1 AS turn, 7000 + conv_id AS asked_at, CASE WHEN conv_id % 5 = 0 THEN '  ' ELSE '  question ' || conv_id || ' ' END AS question, 'answer ' || conv_id AS text FROM conversations GROUP BY conv_id)"


@query(f"""WITH {_ASKED} SELECT 'm' || conv_id || '-' || turn AS id, conv_id, turn, role, text FROM conversations
UNION ALL SELECT 'user-' || asked_at, conv_id, turn, 'user', trim(question) FROM asked WHERE trim(question) <> '' UNION ALL SELECT 'assistant-' || asked_at, conv_id, turn + 1, 'assistant', text FROM asked WHERE trim(question) <> ''""")
def submitted_messages(spark, sf_dir):
    messages = _table(spark, sf_dir, "conversations")
    asked = messages.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).selectExpr("conv_id", "turn", "7000 + conv_id as asked_at", "case when conv_id % 5 = 0 then '  ' else concat('  question ', conv_id, ' ') end as question", "concat('answer ', conv_id) as text")
    return conv.submit(messages.withColumn("id", F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))), asked)


@query(f"WITH {PAIRS}, placed_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair DESC) - 1 AS place FROM exchanges) SELECT conv_id, pair, \"user\" AS question, CASE WHEN pair % 2 = 0 THEN 'fact ' || pair ELSE assistant END AS label FROM placed_ WHERE place > 0")
def history_labels(spark, sf_dir):
    fact = F.when(F.col("pair") % 2 == 0, F.concat(F.lit("fact "), F.col("pair").cast("string")))
    return conv.history(_pairs(spark, sf_dir)).select("conv_id", "pair", F.col("user").alias("question"), conv.history_label(fact, F.col("assistant")).alias("label"))


@query("SELECT s_suppkey, 'Source: Master Reference · Page ' || s_suppkey % 80 AS line FROM supplier")
def temperature_source_line(spark, sf_dir):
    heat = d.temperature(_table(spark, sf_dir, "supplier"))
    return heat.select((F.col("pos") + 1).alias("s_suppkey"), conv.temperature_source_line(F.col("source_pdf_page")).alias("line"))


@query("SELECT s AS section, 'Source: Master Reference guidance · Page ' || (90 + s) AS line FROM (SELECT unnest([1, 2, 3, 4, 7]) AS s)")
def guidance_source_line(spark, sf_dir):
    return d.guidance(spark).select("section", conv.guidance_source_line(F.col("source_pdf_page")).alias("line"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {_quoted(q)})" for k, q in enumerate(conv.SUGGESTED)) + ") AS t(place, question)")
def suggested_questions(spark, sf_dir):
    return conv.suggested_questions(spark)


_COMPONENT = "replace(replace(replace(replace(replace(url_encode({v}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
_DECODED = "CASE WHEN regexp_matches({v}, '%([^0-9A-Fa-f]|$)|%[0-9A-Fa-f]([^0-9A-Fa-f]|$)') THEN NULL ELSE TRY(url_decode(replace({v}, '+', '%2B'))) END"


@query(f"""WITH e AS (SELECT doc_id, text, {_COMPONENT.format(v="text")} AS shown FROM documents)
SELECT doc_id, md5(shown) AS encoded_md5, text IS NOT NULL AS comes_back, md5({_DECODED.format(v="text")}) AS decoded_md5, true AS cut_is_null FROM e""")
def url_components(spark, sf_dir):
    """Whole texts encoded and decoded again; texts decoded as they are; encoded texts cut within a character."""
    shown = _texts(spark, sf_dir).select("doc_id", "text", url.encode_component(F.col("text")).alias("shown"))
    back = F.coalesce(url.decode_component(F.col("shown")) == F.col("text"), F.lit(False))
    cut = url.decode_component(F.concat("shown", F.lit("%E2%82"))).isNull()
    return shown.select("doc_id", F.md5("shown").alias("encoded_md5"), back.alias("comes_back"), F.md5(url.decode_component(F.col("text"))).alias("decoded_md5"), cut.alias("cut_is_null"))


def _encoded(v: str, signs: str) -> str:
    """Character by character: blanks, control and non-ASCII characters and these signs."""
    listed = ", ".join(_quoted(s) for s in signs)
    return f"array_to_string(list_transform(string_split({v}, ''), lambda c: CASE WHEN c <= ' ' OR c > '~' OR c IN ({listed}) THEN url_encode(c) ELSE c END), '')"


_FORMS = "[" + ", ".join("'" + r.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '").replace("\x7f", "' || chr(127) || '") + "'" for r in d.REFERENCES) + "]"
_DOT = "'^(\\.|%2e)$'"
RETURNS = f"""
own AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*(.+)', 1), ''), '/') AS place FROM pages),
refs AS (SELECT page_id, replace({_FORMS}[(page_id % {len(d.REFERENCES)})::INT + 1], '{{}}', place) AS reference FROM own),
clean AS (SELECT page_id, reference, regexp_replace(replace(replace(reference, chr(9), ''), chr(10), ''), ' +$', '') AS c FROM refs),
cut AS (SELECT page_id, reference, string_split(string_split(c, '#')[1], '?')[1] AS before, CASE WHEN contains(string_split(c, '#')[1], '?') THEN substr(string_split(c, '#')[1], strpos(c, '?') + 1) ELSE '' END AS q,
  CASE WHEN contains(c, '#') THEN substr(c, strpos(c, '#') + 1) ELSE '' END AS f FROM clean),
led AS (SELECT *, replace(before, chr(92), '/') AS b FROM cut),
split AS (SELECT *, starts_with(b, '//') AS remote, regexp_extract(b, '^/+([^/]*)', 1) AS host, coalesce(nullif(CASE WHEN starts_with(b, '//') THEN regexp_extract(b, '^/+[^/]*(.*)', 1) ELSE b END, ''), '/') AS place FROM led),
parts AS (SELECT *, string_split({_encoded("place", url.PATH)}, '/')[2:] AS p FROM split),
walked AS (SELECT *, list_reduce(list_transform(p, lambda x: [x]), lambda done, x: CASE WHEN regexp_matches(x[1], '^(\\.|%2e)(\\.|%2e)$', 'i') THEN done[:-2] WHEN regexp_matches(x[1], {_DOT}, 'i') THEN done ELSE done || x END, []::VARCHAR[])
  || CASE WHEN regexp_matches(p[-1], '^(\\.|%2e)(\\.|%2e)?$', 'i') THEN [''] ELSE []::VARCHAR[] END AS w FROM parts),
safe AS (SELECT page_id, CASE WHEN starts_with(reference, '//') OR (remote AND lower(url_decode(regexp_replace(host, ':(443)?$', ''))) <> 'app.local') OR '/' || array_to_string(w, '/') IN ('/signin-with-chatgpt', '/signout-with-chatgpt', '/callback') THEN '/'
  ELSE '/' || array_to_string(w, '/') || CASE WHEN q <> '' THEN '?' || {_encoded("q", url.QUERY)} ELSE '' END || CASE WHEN f <> '' THEN '#' || {_encoded("f", url.FRAGMENT)} ELSE '' END END AS safe FROM walked)"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.references(_table(spark, sf_dir, "pages").select("page_id", "url"))


@query(f"WITH {RETURNS} SELECT page_id, safe FROM safe")
def return_path(spark, sf_dir):
    return _references(spark, sf_dir).select("page_id", conv.safe_return_path(F.col("reference")).alias("safe"))


@query(f"WITH {RETURNS} SELECT page_id, '/signin-with-chatgpt?return_to=' || {_COMPONENT.format(v='safe')} AS sign_in, '/signout-with-chatgpt?return_to=' || {_COMPONENT.format(v='safe')} AS sign_out FROM safe")
def sign_paths(spark, sf_dir):
    return _references(spark, sf_dir).select("page_id", conv.sign_in_path(F.col("reference")).alias("sign_in"), conv.sign_out_path(F.col("reference")).alias("sign_out"))


#: Search aliases of whole words and of letters beyond the basic plane, whose UTF-16 length is twice their number.
_WIDE = "concat_ws('|', replace(p_name, ' ', '|'), repeat('𝄞', (p_partkey % 6 + 1)::INT), 'é' || repeat('𝔸', (p_partkey % 4)::INT), p_name)"


@query(f"""WITH parts AS (SELECT p_partkey, ['PX' || p_partkey] || string_split({_WIDE}, '|') AS l FROM part),
rows_ AS (SELECT p_partkey, l[i] AS alias, min(i) AS first FROM (SELECT p_partkey, l, unnest(range(1, len(l) + 1)) AS i FROM parts) GROUP BY ALL),
sized AS (SELECT *, length(alias) + length(regexp_replace(alias, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units FROM rows_)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY units DESC, first) - 1 AS place, alias, units FROM sized""")
def alias_order(spark, sf_dir):
    wide = "concat_ws('|', replace(p_name, ' ', '|'), repeat('𝄞', cast(p_partkey % 6 + 1 as int)), concat('é', repeat('𝔸', cast(p_partkey % 4 as int))), p_name)"
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(normalise.aliases_for(F.expr("concat('PX', p_partkey)"), F.expr(wide))).alias("place", "alias"))
    return rows.select("p_partkey", F.col("place").cast("long").alias("place"), "alias", js.utf16_length(F.col("alias")).cast("long").alias("units"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['PX' || p_partkey] WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN [p_name, 'A' || p_partkey] ELSE []::VARCHAR[] END AS aliases FROM part""")
def normalized_aliases(spark, sf_dir):
    """A missing array, an empty one, one with asterisks and blanks, and one of nothing else."""
    given = "case p_partkey % 4 when 0 then null when 1 then cast(array() as array<string>) when 2 then array(concat(' *', p_name, '* '), '**', concat('A', p_partkey), ' ') else array('*', ' ') end"
    return _table(spark, sf_dir, "part").select("p_partkey", matching.normalized_aliases(F.expr(given), F.expr("concat('*PX', p_partkey, ' ')")).alias("aliases"))


_MEASURES = ("repeatability", "linearity", "ocl", "tolerance")
_SPECS = ("capacity", "readability")


def _members_sql() -> str:
    of = {"value": "CASE WHEN p_partkey % 5 = {n} THEN NULL ELSE p_size / 4.0::DOUBLE + {n} END", "secondaryValue": "p_size + {n}::DOUBLE", "unit": "'u{n}'", "secondaryUnit": "CASE WHEN p_partkey % 3 = 0 THEN 'v{n}' END", "d": "{n}::DOUBLE", "raw": "p_name || ' {n}'"}
    given = {m: f"CASE WHEN p_partkey % 7 = {n} THEN NULL ELSE " + "{x} END" for n, m in enumerate(_MEASURES)}
    shown = [f"{given[m].format(x=x.format(n=n))} AS {m}_{k}" for n, m in enumerate(_MEASURES) for k, x in of.items()]
    spec = {"value": "p_retailprice + {n}", "unit": "'g{n}'", "secondaryValue": "CASE WHEN p_partkey % 2 = 0 THEN p_size * 2.0::DOUBLE + {n} END", "secondaryUnit": "'oz{n}'", "note": "CASE WHEN p_partkey % 3 = 1 THEN p_brand || {n} END"}
    shown += [f"{x.format(n=n)} AS {m}_{k}" for n, m in enumerate(_SPECS) for k, x in spec.items()]
    return "SELECT p_partkey, " + ", ".join(shown) + " FROM part"


@query(_members_sql())
def record_members(spark, sf_dir):
    """All members of measures, capacities and readabilities; a measure that is missing as a whole gives nulls."""
    rows = _table(spark, sf_dir, "part")
    for n, m in enumerate(_MEASURES):
        made = f"named_struct('value', case when p_partkey % 5 = {n} then null else p_size / 4d + {n} end, 'value_secondary', p_size + {n}d, 'unit', 'u{n}', 'unit_secondary', case when p_partkey % 3 = 0 then 'v{n}' end, 'd', {n}d, 'raw', concat(p_name, ' {n}'))"
        rows = rows.withColumn(m, F.expr(f"case when p_partkey % 7 <> {n} then {made} end"))
    for n, (m, first) in enumerate((("capacity", "_primary"), ("readability", ""))):
        of = {first: f"p_retailprice + {n}", f"{first}_unit": f"'g{n}'", "_secondary": f"case when p_partkey % 2 = 0 then p_size * 2d + {n} end", "_secondary_unit": f"'oz{n}'", "_annotation": f"case when p_partkey % 3 = 1 then concat(p_brand, {n}) end"}
        for name, x in of.items():
            rows = rows.withColumn(m + name, F.expr(x))
    others = ("series", "table_title", "model_group", "search_aliases", "astm_class", "oiml_class", "source_manual")
    rows = rows.select("*", (F.col("p_partkey") - 1).alias("pos"), F.lit(1).alias("source_pdf_page"), *[F.lit("x").alias(c) for c in others])
    made = normalise.current_records(rows, "p_partkey")
    columns = [F.col(f"{m}.{k}").alias(f"{m}_{k}") for m in _MEASURES for k in ("value", "secondaryValue", "unit", "secondaryUnit", "d", "raw")]
    columns += [F.col(f"{m}.{k}").alias(f"{m}_{k}") for m in _SPECS for k in ("value", "unit", "secondaryValue", "secondaryUnit", "note")]
    return made.select("p_partkey", *columns)
