"""Pairs of a growing log, and options without arrays of the catalogue's size."""

import random

from pyspark.sql import functions as F

from specweave.operators import answering, conversation, matching
from specweave.streaming.exchanges import exchange_stream_table

LOG = "id string, conv_id long, turn long, role string, text string"


def log(seed):
    rng = random.Random(seed)
    rows = [("welcome", c, -1, "assistant", "hi") for c in range(30)]
    for c in [*range(30), None]:
        for t in range(rng.randint(0, 12)):
            rows.append((f"m{c}-{t}" if t % 5 else None, c, t, rng.choice([["user", "assistant"][t % 2]] * 8 + ["tool", "user", None]), rng.choice(["a", "b", None, ""])))
    return rows


def test_stream_equals_batch(spark):
    rows = log(2)
    whole = conversation.exchanges(conversation.without_welcome(spark.createDataFrame(rows, LOG)))
    parts = [[r for r in rows if lo <= r[2] < hi] for lo, hi in ((-1, 1), (1, 4), (4, 7), (7, 7), (7, 99))]
    streamed = exchange_stream_table([spark.createDataFrame(p, LOG).repartition(3) for p in parts])
    shown = lambda df: sorted(map(str, df.select("conv_id", "pair", "user", "assistant").collect()))
    assert shown(streamed) == shown(whole) and len(shown(whole)) > 20


def test_welcome_is_known_by_id(spark):
    rows = [("welcome", 1, 0, "user", "x"), (None, 1, 1, "user", "q"), ("m", 1, 2, "assistant", "a")]
    left = conversation.without_welcome(spark.createDataFrame(rows, LOG))
    assert [r["text"] for r in left.orderBy("turn").collect()] == ["q", "a"]


def test_a_long_alias_adds_no_spans_to_short_questions(spark):
    long = " ".join(f"T{i}" for i in range(200))
    aliases = spark.createDataFrame([(0, "AB-1"), (1, long), (2, "X"), (3, "(--)"), (4, "")], "id long, alias string")
    index = matching.span_index(aliases)
    assert index.runs == (1, 2, 200) and index.signs == (0, 4) and index.table.inputFiles()
    asked = spark.createDataFrame([(0, "one two three four five AB-1"), (1, f"a {long.lower()}!"), (2, long[:-1]), (3, "x"), (4, "a (--) b"), (5, None)], "question_id long, question string")
    made = asked.select("question_id", F.size(matching.spans(F.upper("question"), index.runs)).alias("n")).orderBy("question_id").collect()
    assert [r["n"] for r in made][:2] == [7 + 6, 201 + 200 + 2]
    assert {tuple(r) for r in matching.matches(asked, index).collect()} == {tuple(r) for r in matching.theta_matches(asked, aliases).collect()}


def test_options_of_very_many_records(spark, monkeypatch):
    """Rows of at most ROW_OPTIONS options, in the catalogue's order, none lost."""
    monkeypatch.setattr(answering, "ROW_OPTIONS", 7)
    monkeypatch.setattr(answering, "RUN", 4)
    records = spark.range(50).selectExpr(
        "if(id % 3 = 0, 1, 0) as tbl", "id * 3 as pos", "concat('R', id) as id", "if(id % 3 = 0, 'legacy', 'current') as lifecycle", "'S' as series", "cast(null as string) as modelGroup", "array('Same', concat('Own', id)) as aliases", "named_struct('manual', 'M', 'page', 1) as source",
        *[f"cast(null as struct<value:double,unit:string,secondaryValue:double,secondaryUnit:string,note:string,d:double>) as {m}" for m in ("repeatability", "linearity", "ocl", "tolerance", "capacity", "readability")],
        "named_struct('astm', '1', 'oiml', cast(null as string)) as calibration",
    )
    heat = spark.createDataFrame([], "pos long, model_group string, temperature_tolerance_c double, display_range_min_c double, display_range_max_c double, cal_setpoints_c string, source_pdf_page int")
    guide = spark.createDataFrame([], "pos long, section int, source_pdf_page int")
    asked = spark.createDataFrame([(0, "same?"), (1, "current same"), (2, "own7 class"), (3, "hello"), (4, "legacy own6 and own9"), (5, "old own7 and own8")], "question_id long, question string")
    got = answering.answer_all(asked, records, heat, guide).collect()
    of = lambda q: sorted((r for r in got if r["question_id"] == q), key=lambda r: r["part"])
    order = [f"R{i}" for i in range(50) if i % 3] + [f"R{i}" for i in range(0, 50, 3)]
    assert [o["id"] for r in of(0) for o in r["options"]] == order and [r["part"] for r in of(0)] == list(range(8)) and {len(r["options"]) for r in of(0)[:-1]} == {7}
    assert [o["id"] for r in of(1) for o in r["options"]] == order[:33] and all(r["text"].startswith("I found 33 records") for r in of(1))
    assert [(r["kind"], r["recordId"], r["options"], r["part"]) for r in of(2)] == [("model", "R7", None, 0)]
    assert [r["kind"] for q in (3, 4, 5) for r in of(q)] == ["not-found", "ambiguous", "not-found"]
