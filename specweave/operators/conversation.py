"""Shaping message logs into exchanges and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.functions import url
from specweave.functions.text import js_number, trim
from specweave.operators.answering import measure_text, readability_text

#: Fixed values.
SUGGESTED = ["What is the tolerance for STX622?", "What is the OCL for RC31P3?", "Which weight class does R71MHD3 use?", "What is tolerance vs. uncertainty?"]
RECORDS_FALLBACK = 746
WELCOME = "welcome"


def without_welcome(messages: DataFrame) -> DataFrame:
    """messages but for the welcome message, which is known by its ``id``; a null id stays."""
    return messages.filter(~F.col("id").eqNullSafe(F.lit(WELCOME)))


def exchanges(messages: DataFrame) -> DataFrame:
    """messages (``conv_id``, ``turn``, ``role``, ``text``; no welcome message) in pairs by
    place: 0 and 1, 2 and 3, and so on in the order of turns. A pair counts if it is a user's
    message and an assistant's; a stray message shifts all later pairs. ``pair`` from 0."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    placed = messages.withColumn("at", at).withColumn("pair", F.floor(F.col("at") / 2))
    side = lambda k, c: F.max(F.when(F.col("at") % 2 == k, F.col(c)))
    pairs = placed.groupBy("conv_id", "pair").agg(side(0, "role").alias("r0"), side(1, "role").alias("r1"), side(0, "text").alias("user"), side(1, "text").alias("assistant"))
    return pairs.filter("r0 = 'user' and r1 = 'assistant'").select("conv_id", "pair", "user", "assistant")


def _newest() -> Column:
    return F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("pair").desc()))


def latest_first(pairs: DataFrame) -> DataFrame:
    """pairs with ``place`` from 0, the newest first."""
    return pairs.withColumn("place", _newest() - 1)


def latest(pairs: DataFrame) -> DataFrame:
    best = pairs.groupBy("conv_id").agg(F.max_by(F.struct("pair", "user", "assistant"), "pair").alias("p"))
    return best.select("conv_id", "p.pair", "p.user", "p.assistant")


def history(pairs: DataFrame) -> DataFrame:
    """All but the newest exchange, the newest first."""
    return latest_first(pairs).filter("place > 0")


def history_count(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("conv_id").agg((F.count("*") - 1).alias("n_history"))


def history_label(fact_value: Column, text: Column) -> Column:
    return F.coalesce(fact_value, text)


def submit(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """messages (``id``, ``conv_id``, ``turn``, ``role``, ``text``) with a user's and an
    assistant's message for each row of answers (``conv_id``, ``turn``, ``asked_at``,
    ``question``, ``text``) whose question isn't blank. Both ids come from asked_at, the
    time of the question; its text is trimmed."""
    question = trim(F.coalesce("question", F.lit("")))
    asked = answers.filter(question != "")

    def said(role: str, later: int, text: Column) -> DataFrame:
        return asked.select(F.concat(F.lit(f"{role}-"), F.col("asked_at").cast("string")).alias("id"), "conv_id", (F.col("turn") + later).alias("turn"), F.lit(role).alias("role"), text.alias("text"))

    return messages.select("id", "conv_id", "turn", "role", "text").unionByName(said("user", 0, question)).unionByName(said("assistant", 1, F.col("text")))


def record_total(meta: DataFrame) -> DataFrame:
    """Current and legacy records, or the fallback where there is no meta row."""
    total = F.coalesce(F.max(F.col("currentRecords") + F.col("legacyRecords")), F.lit(RECORDS_FALLBACK))
    return meta.agg(total.alias("total")).withColumn("shown", F.format_number("total", 0))


def qa_badge(status: Column) -> Column:
    return F.when(F.coalesce(status, F.lit("ok")) == "review", "Source review").otherwise("Verified")


def spec_card(records: DataFrame) -> DataFrame:
    return records.select("id", readability_text(F.col("readability")).alias("readability"), *[measure_text(F.col(m), True).alias(m) for m in ("repeatability", "linearity", "ocl")])


def temperature_card(specs: DataFrame) -> DataFrame:
    number = lambda c: js_number(F.col(c))
    mass = F.concat(number("adjustment_mass_value"), F.lit(" "), F.coalesce("adjustment_mass_unit", F.lit("")))
    return specs.select("pos", F.col("heater_technology").alias("heater"), F.concat(number("temperature_readability_c"), F.lit(" °C")).alias("temperature_readability"), mass.alias("adjustment_mass"))


def source_line(source: Column) -> Column:
    """Under a model's answer."""
    return F.concat(F.lit("Source: "), source["manual"], F.lit(" · Master reference page "), source["page"].cast("string"))


def temperature_source_line(page: Column) -> Column:
    return F.concat(F.lit("Source: Master Reference · Page "), page.cast("string"))


def guidance_source_line(page: Column) -> Column:
    return F.concat(F.lit("Source: Master Reference guidance · Page "), page.cast("string"))


def qa_notes(records: DataFrame) -> DataFrame:
    """A row for each message of each record, in order."""
    return records.select("id", F.posexplode("qa.messages").alias("place", "message"))


def suggested_questions(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SUGGESTED)), "place int, question string")


#: The paths of signing in and out, to which no one is sent back, and the own host.
SIGN_IN, SIGN_OUT, CALLBACK = "/signin-with-chatgpt", "/signout-with-chatgpt", "/callback"
RESERVED_PATHS = (SIGN_IN, SIGN_OUT, CALLBACK)
OWN_HOST = "app.local"


def safe_return_path(path: Column, reserved: tuple[str, ...] = RESERVED_PATHS) -> Column:
    """A path of the own site with its query and fragment, serialised as browsers do it, else `/`
    (`url.local_path`); null gives `/`."""
    return F.coalesce(url.local_path(path, OWN_HOST, reserved), F.lit("/"))


def sign_in_path(return_to: Column) -> Column:
    """The path that signs in and comes back to return_to, if that is safe, else to `/`."""
    return F.concat(F.lit(f"{SIGN_IN}?return_to="), url.encode_component(safe_return_path(return_to)))


def sign_out_path(return_to: Column) -> Column:
    """The path that signs out; a missing return_to is `/`."""
    return F.concat(F.lit(f"{SIGN_OUT}?return_to="), url.encode_component(safe_return_path(return_to)))
