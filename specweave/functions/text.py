"""String and number functions with JavaScript's semantics, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that JavaScript's trim and \s take as white space.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: \b on ASCII word characters, and a dot that stops at JavaScript's line ends.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
DOT = r"[^\n\r\x{2028}\x{2029}]"

#: US grouping and at most ten digits behind the point.
_PATTERN = "#,##0.##########"


def regex(pattern: str) -> str:
    """A pattern whose \\b and . mean what they mean in JavaScript without flags."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(EDGE if pattern[i + 1] == "b" else pattern[i : i + 2])
            i += 2
        else:
            out.append(DOT if pattern[i] == "." else pattern[i])
            i += 1
    return "".join(out)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, rf"{SPACE}+", " ")


def escape(text: Column) -> Column:
    """text with a backslash before each character that regular expressions treat specially."""
    return F.regexp_replace(text, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def falsy_null(text: Column) -> Column:
    """null for the empty text."""
    return F.when(text != "", text)


def format_number(value: Column) -> Column:
    """US format with up to ten fraction digits, halves away from zero; null is
    `not published`. The decimal form rounds exactly; what it can't hold goes as a double."""
    exact = F.round(value.try_cast("decimal(38,18)"), 10)
    shown = [F.call_function("format_number", v, F.lit(_PATTERN)) for v in (exact, value.cast("double"))]
    return F.when(value.isNull(), "not published").otherwise(F.coalesce(*shown))


def js_number(value: Column) -> Column:
    """A double as JavaScript prints it: the shortest digits that read back as the same double, of
    several such the nearest; an exponent only below 1e-6 and from 1e21 on. Null gives null."""
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # binds a value once
    return bound(value.cast("double"), lambda double: bound(_digits(F.abs(double)), lambda own: bound(_shortest(F.abs(double), own), lambda d: _printed(double, d))))


def _trimmed(digits: Column, power: Column) -> Column:
    """struct(digits, power) of a whole number times a power of ten, without zeros at the ends."""
    short = F.regexp_replace(digits, r"0+\z", "")
    return F.struct(F.regexp_replace(short, "^0+", "").alias("digits"), (power + F.length(digits) - F.length(short)).alias("power"))


def _digits(size: Column) -> Column:
    """Spark's digits of a double that is not negative: they read back as the same double, but
    a shorter number may do so, too."""
    parts = F.split(F.concat(size.cast("string"), F.lit("E0")), "[E.]")
    behind = F.get(parts, F.lit(1))
    return _trimmed(F.concat(parts[0], behind), F.get(parts, F.lit(2)).try_cast("int") - F.length(behind))


def _shortest(size: Column, own: Column) -> Column:
    """The shortest digits of the double. Up to 15 digits are unique already, but for doubles of
    reduced precision; so 15 to 17 are tried, and from 1 on for those."""
    n_own = F.length(own["digits"])

    def cut(n: Column) -> Column:
        low, power = F.substring(own["digits"], F.lit(1), n), own["power"] + n_own - n
        high = (low.cast("decimal(20,0)") + 1).cast("string")
        reads = lambda digits: F.concat(digits, F.lit("E"), power.cast("string")).try_cast("double") == size
        up = F.when(reads(low) & reads(high), F.substring(own["digits"], n + 1, F.lit(1)) >= "5").otherwise(reads(high))
        return F.when(reads(low) | reads(high), F.when(up, _trimmed(high, power)).otherwise(_trimmed(low, power)))

    lengths = F.when(size < 2.2250738585072014e-308, F.sequence(F.lit(1), F.lit(17))).otherwise(F.sequence(F.lit(15), F.lit(17)))
    found = F.filter(F.transform(F.filter(lengths, lambda n: n < n_own), cut), lambda c: c.isNotNull())
    return F.when((n_own > 15) | (size < 2.2250738585072014e-308), F.coalesce(F.get(found, F.lit(0)), own)).otherwise(own)


def _printed(double: Column, number: Column) -> Column:
    digits, n = number["digits"], F.length(number["digits"])
    point = n + number["power"]  # digits before the point
    with_point = lambda a, b: F.when(b == "", a).otherwise(F.concat(a, F.lit("."), b))
    whole = F.rpad(digits, point, F.lit("0"))
    cut = with_point(F.substring(digits, F.lit(1), point), F.substring(digits, point + 1, n))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    exponent = F.concat(with_point(F.substring(digits, 1, 1), F.substring(digits, F.lit(2), n)), F.lit("e"), F.when(point < 1, "-").otherwise("+"), F.abs(point - 1).cast("string"))
    size = F.abs(double)
    shown = F.when((point > 21) | (point < -5), exponent).when(point <= 0, small).when(point >= n, whole).otherwise(cut)
    body = F.when(F.isnan(double), "NaN").when(size == float("inf"), "Infinity").when(size == 0, "0").otherwise(shown)
    return F.concat(F.when((double < 0) & ~F.isnan(double), "-").otherwise(""), body)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, as JavaScript counts: characters beyond the basic plane are two."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
