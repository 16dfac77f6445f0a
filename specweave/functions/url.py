"""Percent-encoding and the parsing of paths as browsers do it, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Printable ASCII signs, those that Spark's url_encode leaves as they are, and
#: those that each part of a URL encodes (with blanks, control and all non-ASCII characters).
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LEFT = "*-._"
COMPONENT = "\"#$%&+,/:;<=>?@[\\]^`{|}"
PATH, QUERY, FRAGMENT = '"#<>?^`{}', "\"#<>'", '"<>`'

_NO_ESCAPE = "%(?![0-9A-Fa-f]{2})"
#: The escaped and the plain form of the character that stands for bytes that are no UTF-8.
_REPLACEMENT = r"(?i)%EF%BF%BD|\x{FFFD}"


def encode(text: Column, signs: str) -> Column:
    """text with the UTF-8 bytes of blanks, control and non-ASCII characters and of these signs
    as %XX. Without % among the signs, escapes that are there stay as they are."""
    shown = F.replace(F.call_function("url_encode", text), F.lit("+"), F.lit("%20"))
    # % comes back last, so that an escape of the text is never taken for one that was made here.
    for sign in sorted(set(SIGNS) - set(LEFT) - set(signs), key=lambda s: s == "%"):
        shown = F.replace(shown, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    for sign in set(LEFT) & set(signs):
        shown = F.replace(shown, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return shown


def encode_component(text: Column) -> Column:
    """text as one value within a URL: only ASCII letters, digits and ``-_.!~*'()`` stay. Null
    gives null."""
    return encode(text, COMPONENT)


def decode_component(text: Column) -> Column:
    """text with its escapes resolved, a plus sign kept; null where it has a % without two
    hexadecimal digits, or escaped bytes that are no UTF-8 (cut, overlong, surrogates, beyond
    Unicode). Null gives null."""
    plain = F.call_function("try_url_decode", F.replace(text, F.lit("+"), F.lit("%2B")))
    # What is no UTF-8 decodes to replacement characters that the text does not hold.
    strict = F.regexp_count(plain, F.lit(r"\x{FFFD}")) == F.regexp_count(text, F.lit(_REPLACEMENT))
    return F.when(~text.rlike(_NO_ESCAPE) & strict, plain)


_UP, _HERE = r"(?i)^(?:\.|%2e){2}\z", r"(?i)^(?:\.|%2e)\z"


def resolved(path: Column) -> Column:
    """A path from its first slash on without its dot segments, escaped ones included; one at the
    end leaves its slash."""
    parts = F.split(path, "/", -1)
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def walk(done: Column, part: Column) -> Column:
        return F.when(part.rlike(_UP), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(part.rlike(_HERE), done).otherwise(F.concat(done, F.array(part)))

    last = F.element_at(F.concat(F.array(F.lit("")), parts), -1)
    walked = F.aggregate(parts, F.array().cast("array<string>"), walk)
    walked = F.when(last.rlike(_UP) | last.rlike(_HERE), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def _host(authority: Column) -> Column:
    """The host of an authority without user and default port, in lower case and with its escapes
    resolved; null if it can't be read."""
    behind = F.regexp_replace(authority, r"(?s)^.*@", "")
    return F.lower(decode_component(F.regexp_replace(behind, r":(?:0*443)?\z", "")))


def local_path(reference: Column, host: str, reserved: tuple[str, ...] = ()) -> Column:
    """A reference that starts with one slash, parsed against ``https://host/``, as path, query and
    fragment; null if it does not start so, can't be read, names another host or a
    reserved path.

    Control characters and blanks at the end, tabs and line ends anywhere go, backslashes are slashes before the
    query, dot segments are resolved, and each part is percent-encoded by its own set. An empty query or
    fragment leaves no sign. A second slash that shows only then leads in a host, which
    has to be ``host`` (ASCII letters in any case, escapes, a user and port 443 allowed)."""
    clean = F.regexp_replace(F.regexp_replace(reference, r"[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    before = F.replace(F.regexp_extract(clean, r"(?s)^[^?#]*", 0), F.lit("\\"), F.lit("/"))
    query, fragment = F.regexp_extract(clean, r"(?s)^[^?#]*\?([^#]*)", 1), F.regexp_extract(clean, r"(?s)^[^#]*#(.*)", 1)
    remote = before.startswith("//")
    authority = F.regexp_extract(before, r"(?s)^/+([^/]*)", 1)
    place = F.when(remote, F.regexp_extract(before, r"(?s)^/+[^/]*(.*)", 1)).otherwise(before)
    path = resolved(encode(F.when(place == "", "/").otherwise(place), PATH))
    part = lambda sign, text, signs: F.when(text != "", F.concat(F.lit(sign), encode(text, signs))).otherwise("")
    good = reference.startswith("/") & ~reference.startswith("//") & (~remote | F.coalesce(_host(authority) == host, F.lit(False)))
    if reserved:
        good = good & ~path.isin(*reserved)
    return F.when(good, F.concat(path, part("?", query, QUERY), part("#", fragment, FRAGMENT)))
