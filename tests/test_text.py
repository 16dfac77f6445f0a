"""JavaScript's string and number semantics."""

import random
import re
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from specweave.functions import text as js


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("value", "shown"),
    [(None, "not published"), (0.00048828125, "0.0004882813"), (1234567.5, "1,234,567.5"), (0.03, "0.03"), (3.0, "3"), (1e21, "1,000,000,000,000,000,000,000"), (-2.5, "-2.5")],
)
def test_format_number(spark, value, shown):
    assert one(spark, value, "double", js.format_number) == shown


@pytest.mark.parametrize(("value", "shown"), [(3.0, "3"), (0.1 + 0.2, "0.30000000000000004"), (1e-5, "0.00001"), (1.5e-7, "1.5e-7"), (1e-7, "1e-7"), (1e21, "1e+21"), (12345678.25, "12345678.25"), (1e7, "10000000"), (0.0, "0"), (-0.5, "-0.5"), (float("nan"), "NaN"), (None, None)])
def test_js_number(spark, value, shown):
    assert one(spark, value, "double", js.js_number) == shown


def test_trim_and_edges(spark):
    assert one(spark, "﻿  a　b  \n", "string", js.trim) == "a　b"
    edge = js.regex(r"\bx\b")
    got = spark.createDataFrame([("éx",), ("x-",), ("ax",), ("x_",)], "v string").select(F.col("v").rlike(edge)).collect()
    assert [r[0] for r in got] == [True, True, False, False]
    assert not spark.createDataFrame([("a b",)], "v string").select(F.col("v").rlike(js.regex("a.b"))).first()[0]


def test_escape(spark):
    for text in ["a(b)*", "x.y+z?", "^$|[]{}\\"]:
        assert re.fullmatch(one(spark, text, "string", js.escape), text)


def shortest(value):
    """JavaScript's form of Python's shortest digits."""
    sign, digits, power = Decimal(repr(value)).normalize().as_tuple()
    digits = "".join(map(str, digits))
    n, k = len(digits) + power, len(digits)
    if value == 0:
        return "0"
    if k <= n <= 21:
        body = digits + "0" * (n - k)
    elif 0 < n <= 21:
        body = digits[:n] + "." + digits[n:]
    elif -6 < n <= 0:
        body = "0." + "0" * -n + digits
    else:
        body = digits[0] + ("." + digits[1:] if k > 1 else "") + ("e-" if n < 1 else "e+") + str(abs(n - 1))
    return "-" * sign + body


def test_js_number_is_shortest(spark):
    rng = random.Random(4)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(6000)]
    values += [rng.random() * 10 ** rng.randint(-12, 12) for _ in range(3000)] + [round(rng.random() * 1000, 3) / 7 for _ in range(1000)] + [a / 100 + b / 100 for a in range(40) for b in range(40)]
    values += [2.0**-44, 2e-3, 2e23, 1e23, 9007199254740993.0, 5e-324, 1.5e-323, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 123456789012345680000.0, 999999999999999900000.0, 1e21, 1e-6, 9.5e-7, -0.1, 4.35, 0.000001, 1e16]
    values = [v for v in values if v == v and abs(v) != float("inf")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", js.js_number(F.col("v")).alias("x")).collect()
    wrong = [(r["v"], r["x"], shortest(r["v"])) for r in got if r["x"] != shortest(r["v"])]
    assert not wrong, (len(wrong), wrong[:5])


def test_utf16_length(spark):
    for text in ["", "aé東", "𝄞a😀", "\U0010ffff\uffff", None]:
        assert one(spark, text, "string", js.utf16_length) == (None if text is None else len(text.encode("utf-16-le")) // 2)
