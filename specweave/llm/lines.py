"""Line dedup by a tree of line templates, in DataFrame functions only.

A line is parsed at fixed depth: first by its number of tokens, then by its LEADING first
tokens; tokens with a digit count as the variable field ``<*>``. Where words without a digit vary among the first tokens, a
line would reach a leaf of its own; so it also goes down the wildcard children, to the leaf of all lines of
its length with the same LEADING last tokens. The lines that reach the
same leaf are generalised by place, and a leaf holds as many templates as its lines give:

* The weight of a token in a place of the leaf is the number of documents with a line that
  has it there (a document counts once a line).
* A line keeps its tokens of highest weight, ``similar`` percent of them at least and all of
  the last one's weight; its other places become fields. That is the most general template which
  the line is still similar to.
* Lines of the same template belong together. Templates that occur in ``least_docs`` different documents or more
  are dropped from all texts, if they are a line as it is (with a word), or keep LEAST_WORDS words: of a few
  words that stay the same, sentences have too much of their own to count as one template.

A line that recurs as it is, is the template without further fields. A token of a weight below
least_docs can't be a constant of a template that recurs, so lines with too many of those are
out early. What is lost by this form: where one value of a varying place is more
frequent in its leaf than the template's own words, its lines make a template of their own.

Hashes of lines are counted and joined; tokens are exploded just for leaves in which lines
differ and that occur in enough documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import boxed, quoted, sized, stored, unboxed

FIELD = "<*>"
LEADING = 3
LEAST_DOCS = 5
#: Percent of a line's tokens that its template keeps.
SIMILAR = 70
#: Words that a template keeps if words of its lines vary.
LEAST_WORDS = 6

#: A word with a digit, from its start.
_DIGITS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def masked(text: Column) -> Column:
    """The lines of a text, words with a digit as the field, words apart by one space. The
    patterns are run on the lines that have a digit, or white space other than single spaces."""
    fields = F.transform(F.split(text, "\n"), lambda line: F.when(line.rlike("[0-9]"), F.regexp_replace(line, _DIGITS, FIELD)).otherwise(line))
    return F.transform(fields, lambda line: F.trim(F.when(line.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(line)))


def has_word(line: Column) -> Column:
    """True if a masked line has anything but fields."""
    return F.when(line.contains(FIELD), F.trim(F.replace(line, F.lit(FIELD), F.lit(""))) != "").otherwise(line != "")


def hashed(line: Column) -> Column:
    """(leaf, back, line) of a masked line, back being the leaf by its last tokens; null if it has no word."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    back = F.when(spaces >= LEADING, F.xxhash64(spaces, F.substring_index(line, " ", -LEADING), F.lit("back")))
    return F.when(has_word(line), F.struct(F.xxhash64(spaces, F.substring_index(line, " ", LEADING)).alias("leaf"), back.alias("back"), F.xxhash64(line).alias("line")))


def parsed(box: DataFrame) -> DataFrame:
    """A row for each row of box (``text`` and the key ``k1``, ``k2``): ``row``, a number of its
    own, the key, its ``lines`` as hashes, in order, and where some repeat the same without
    repetitions, ``once``; and the different masked lines, ``words``, in the order of once, so that texts are masked once only."""
    rows = box.select(F.monotonically_increasing_id().alias("row"), "k1", "k2", masked(F.coalesce("text", F.lit(""))).alias("m"))
    # The different lines are told apart as strings: an array of structs would be compared pair by pair.
    rows = rows.withColumn("words", F.array_distinct("m"))
    return stored(rows.select("row", "k1", "k2", F.transform("m", hashed).alias("lines"), F.when(F.size("words") < F.size("m"), F.transform("words", hashed)).alias("once"), "words"), "parsed")


def general(own: DataFrame, least_docs: int, similar: int) -> DataFrame:
    """own: the different lines of leaves (``leaf``, ``line``, ``words`` from the leaf's constant ones on, ``n`` documents, and
    ``total``, the sum of n in the leaf). Returns ``leaf``, ``line`` and ``template`` of those whose
    template may recur."""
    tokens = own.withColumn("tokens", F.split("words", " ")).withColumn("rest", F.expr(f"slice(tokens, {LEADING + 1}, greatest(size(tokens) - {LEADING}, 0))"))
    places = tokens.select("leaf", "line", "n", F.posexplode("rest").alias("place", "token"))
    weights = places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("weight")).filter(F.col("weight") >= least_docs)
    weighed = places.join(weights, ["leaf", "place", "token"], "left").groupBy("leaf", "line").agg(F.array_sort(F.collect_list(F.struct("place", "token", F.coalesce("weight", F.lit(0)).alias("weight")))).alias("rest"))  # a row for each token of the line
    head = own.select("leaf", "line", "words", "total", F.substring_index("words", " ", LEADING).alias("head"))
    both = weighed.join(head, ["leaf", "line"])
    need = F.expr(f"({similar} * (size(rest) + {LEADING}) + 99) div 100 - {LEADING}").cast("int")
    least = F.when(need > 0, F.get(F.reverse(F.array_sort(F.transform("rest", lambda t: t["weight"]))), need - 1)).otherwise(F.col("total"))
    both = both.withColumn("least", least).filter(F.col("least") >= least_docs)
    # The outer lambda binds its values once, the inner one is run for each token.
    kept = F.transform(F.array(F.struct("rest", "least")), lambda b: F.transform(b["rest"], lambda t: F.when(t["weight"] >= b["least"], t["token"]).otherwise(FIELD)))[0]
    made = both.select("leaf", "line", "words", F.concat_ws(" ", "head", F.array_join(kept, " ")).alias("template"))
    n_words = F.size(F.filter(F.split("template", " "), lambda t: t != FIELD))
    return made.filter((F.col("template") == F.col("words")) | (n_words >= LEAST_WORDS)).drop("words")


def recurring(lines: DataFrame, least_docs: int = LEAST_DOCS, similar: int = SIMILAR) -> DataFrame:
    """The lines that are dropped, ``line``, each once. lines are `parsed`."""
    pairs = lines.select("row", F.explode(F.coalesce("once", "lines")).alias("l")).filter("l is not null").select("row", "l.line", F.explode(F.array_compact(F.array("l.leaf", "l.back"))).alias("leaf"))
    leaves = pairs.groupBy("leaf").agg(F.count("*").alias("total"), F.min("line").alias("line"), F.max("line").alias("other")).filter(F.col("total") >= least_docs)
    leaves = stored(leaves, "leaves")
    alone = leaves.filter("line = other").select("line")
    mixed = leaves.filter("line <> other").select("leaf", "total")
    texts = lines.select(F.explode(F.arrays_zip("words", F.coalesce("once", "lines").alias("l"))).alias("x")).select("x.words", "x.l").filter("l is not null")
    both = F.array(F.struct(F.col("l.leaf").alias("leaf"), F.lit(False).alias("turned")), F.struct(F.col("l.back").alias("leaf"), F.lit(True).alias("turned")))
    texts = texts.select("words", "l.line", F.explode(both).alias("of")).select("words", "line", "of.leaf", "of.turned")
    found = texts.join(sized(mixed, mixed.count()), "leaf").groupBy("leaf", "line").agg(F.any_value("words").alias("words"), F.any_value("turned").alias("turned"), F.count("*").alias("n"), F.any_value("total").alias("total"))
    found = found.withColumn("words", F.when(F.col("turned"), F.array_join(F.reverse(F.split("words", " ")), " ")).otherwise(F.col("words"))).drop("turned")
    templates = stored(general(stored(found, "mixed"), least_docs, similar), "templates")
    # A document counts once for a template, whatever number of different lines it has of it.
    name = F.xxhash64("template").alias("template")
    known = templates.select("leaf", "line", name)
    once = pairs.join(sized(known, known.count()), ["leaf", "line"]).select("leaf", "template", "row").distinct()
    enough = once.groupBy("leaf", "template").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least_docs)
    return known.join(enough, ["leaf", "template"]).select("line").union(alone).distinct()


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", id_col: str | None = None, least_docs: int = LEAST_DOCS, similar: int = SIMILAR) -> DataFrame:
    """docs with ``n_lines``, ``n_dropped`` and ``clean_text``, the text without the lines
    of recurring templates.

    Rows stay rows and are counted as documents, also when they repeat; equal texts stay equal.
    Lines of nothing but fields, and blank ones, stay. Short lines are lines like any other, and
    a text may be of any length: it is taken whole. A null text has no lines and stays null. Of
    equal weights all count. Columns of these names are replaced, all others stay. An empty
    table gives an empty one. Texts meet the places that go by a shuffle on a hash of text and id_col, so
    that copies of a text are spread where an id tells them apart."""
    made = ["n_lines", "n_dropped", "clean_text"]
    text = F.coalesce(quoted(text_col), F.lit(""))
    own = [quoted(id_col)] if id_col else []
    keys = {"k1": F.xxhash64(text, *own), "k2": F.xxhash64(*own, F.lit(1), text)}
    kept = [n for n in made if n.lower() != text_col.lower()]
    box = boxed(docs, tuple(kept), text=quoted(text_col), **keys)
    lines = parsed(box.select("text", "k1", "k2"))
    gone = stored(recurring(lines, least_docs, similar), "recurring")
    at = lines.select("k1", "k2", F.posexplode("lines").alias("place", "l")).filter("l is not null").select("k1", "k2", "place", "l.line")
    hits = at.join(sized(gone, gone.count()), "line").groupBy("k1", "k2").agg(F.collect_set("place").alias("gone"))
    # The texts go to their hits by a shuffle at any size.
    out = box.join(stored(hits, "hits").hint("merge"), ["k1", "k2"], "left")
    own_lines = F.split("text", "\n")
    left = F.transform(F.array(own_lines), lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone")), lambda n: F.get(own, n)))[0]  # splits once
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = out.withColumns({"n_lines": F.greatest(F.size(own_lines), F.lit(0)).cast("long"), "n_dropped": F.greatest(F.size("gone"), F.lit(0)).cast("long"), "clean_text": clean})
    return unboxed(out, *kept) if text_col.lower() != "clean_text" else unboxed(out, "n_lines", "n_dropped")
