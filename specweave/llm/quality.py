"""Quality rules with adaptive thresholds, in DataFrame functions only.

Base measures of each text come first. For each language and source, the distribution of
every measure is kept as a mergeable quantile sketch: counts of integer values in
log-linear bins, exact below 32 and within 1/16 above. Sketches merge by adding counts, so
those of languages and of all rows cost no further pass.

A sketch gives its fence by its quantiles at 10, 25, 50, 75 and 90 percent. From the median
outwards, a quantile belongs to the bulk if its step from the one before is at most SPREAD times
the steps before it (the first step has the one on the median's other side to go by);
the fence lies SPREAD times the last step beyond the bulk. So odd rows don't move the fence, up to nearly half
of a group: where a quarter of a source is junk, its upper quantile is a jump and not part of the bulk.
Most texts have no symbol or repeated line at all, so steps are nought there. No step counts as less than the
measure's resolution in the group, for a text whose length is the lower quartile of the group's, which its sketch of
lengths tells: for a share what the fewest occurrences that there can be make in it, for a mean length
of words its sampling error there, if words vary by half of the median. There is no fixed cutoff and no
least size: a group of n rows has the fence ``(n * own + PRIOR * parent) / (n + PRIOR)``, where the parent is
its language's fence, weighed likewise against that of all rows. The rows are joined with the fences of
their group and filtered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.common import boxed, quoted, sized, stored, unboxed, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """measure: integer SQL over the base measures. A value above the upper fence
    (``upper``) or below the lower one fails. least: the fewest occurrences that the
    measure can count in a text, if it is a share of its words; None for a mean over them."""

    name: str
    measure: str
    upper: bool
    least: int | None


#: Measures in thousandths but for word lengths, which are in hundredths of a character. Repeated
#: windows cover six words at least.
RULES = (
    Rule("symbols", "n_symbols * 1000 div greatest(n_words, 1)", True, 1),
    Rule("dup_lines", "n_dup_lines * 1000 div greatest(n_words, 1)", True, 1),
    Rule("repeats", "n_repeat_words * 1000 div greatest(n_words, 1)", True, 6),
    Rule("long_words", "word_chars * 100 div greatest(n_words, 1)", True, None),
    Rule("short_words", "word_chars * 100 div greatest(n_words, 1)", False, None),
)
#: The sketch that resolutions come from.
LENGTH = "n_words"

QUANTILES = (10, 25, 50, 75, 90)
SPREAD = 4
#: Rows of a group that weigh as much as its parent.
PRIOR = 20


def measures(docs: DataFrame) -> DataFrame:
    """docs and the five base measures of the whole ``text`` (longs, of null all 0).

    n_repeat_words sorts the hashes of the text's five-word windows with their places;
    texts whose windows all differ, most of them, skip that sort. No row leaves its
    partition.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.withColumns({"__words": F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), "__lines": lines})
    two = one.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__windows": F.expr("if(size(__words) < 5, array(), transform(sequence(0, size(__words) - 5), i -> xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2), get(__words, i + 3), get(__words, i + 4))))"),
        }
    )
    two = two.withColumn("__sorted", F.expr("if(size(array_distinct(__windows)) = size(__windows), null, array_sort(transform(__windows, (h, i) -> struct(h, i))))"))
    # Places of windows that occur twice or more, then the words that these cover.
    two = two.withColumn("__twice", F.expr("array_sort(transform(filter(__sorted, (w, k) -> w.h <=> get(__sorted, k - 1).h or w.h <=> get(__sorted, k + 1).h), w -> w.i))"))
    two = two.withColumn("n_repeat_words", F.expr("coalesce(aggregate(transform(__twice, (p, k) -> least(5, coalesce(get(__twice, k + 1) - p, 5))), 0L, (a, x) -> a + x), 0L)"))
    # A generator of one row keeps later filters from being pushed down and repeating all this.
    own = [c for c in docs.columns if c != "text"]
    one_row = two.select(*own, F.explode_outer(F.array(F.struct(*BASE))).alias("__measures"))
    return one_row.select(*own, *[F.col("__measures")[b].alias(b) for b in BASE])


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of the words in repeated windows."""
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def bin_of(value: Column) -> Column:
    """The sketch's bin of a non-negative long, as its smallest value: exact below 32,
    above that the value cut to its five leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame, keys: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """One row per group of keys, rule and bin: the count ``n``. Spark adds the counts of a
    task before the shuffle, so a group costs some hundred rows a task whatever its size."""
    measured_as = [(r.name, r.measure) for r in rules] + [(LENGTH, "n_words")]
    one = F.array(*[F.struct(F.lit(name).alias("rule"), bin_of(F.expr(f"cast({measure} as long)")).alias("bin")) for name, measure in measured_as])
    rows = measured.filter(~base_failed()).select(*keys, F.explode(one).alias("m"))
    return rows.groupBy(*keys, F.col("m.rule").alias("rule"), F.col("m.bin").alias("bin")).agg(F.count("*").alias("n"))


def fence_of(at: list[Column], resolution: Column, spread: int, upper: bool) -> Column:
    """The fence beyond the quantiles ``at``, which run from the other side of the median, through the median,
    outwards: five of them, the median third."""
    size = lambda a, b: F.greatest(F.abs(b - a).cast("double"), resolution)
    inner, first, second = size(at[1], at[2]), size(at[2], at[3]), size(at[3], at[4])
    one = first <= inner * spread
    two = one & (second <= F.greatest(inner, first) * spread)
    last = F.when(two, second).when(one, first).otherwise(inner)
    bulk = F.when(two, at[4]).when(one, at[3]).otherwise(at[2])
    return bulk + last * (spread if upper else -spread)


def edges(sketch: DataFrame, keys: list[str], rules: tuple[Rule, ...], spread: int) -> DataFrame:
    """One row per group and rule: rows ``total`` and the ``fence`` that its sketch gives."""
    group = Window.partitionBy(*keys, "rule")
    run = sketch.select("*", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("total"))
    found = run.groupBy(*keys, "rule").agg(F.first("total").alias("total"), *[F.min(F.when(F.col("upto") >= F.expr(f"(total * {q} + 99) div 100"), F.col("bin"))).alias(f"q{q}") for q in QUANTILES])
    short = F.greatest(F.max(F.when(F.col("rule") == LENGTH, F.col("q25"))).over(Window.partitionBy(*keys)), F.lit(1))
    found = found.withColumn("short", short).filter(F.col("rule") != LENGTH)
    upwards = [F.col(f"q{q}") for q in QUANTILES]
    fences = [F.when(F.col("rule") == r.name, fence_of(upwards if r.upper else upwards[::-1], F.col("q50") / F.lit(2.0) / F.sqrt("short") if r.least is None else F.lit(1000.0 * r.least) / F.col("short"), spread, r.upper)) for r in rules]
    return found.select(*keys, "rule", "total", F.coalesce(*fences).alias("fence"))


def fences(measured: DataFrame, rules: tuple[Rule, ...] = RULES, spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """One row per ``lang`` and ``source`` that has a row which the base rules keep, with a
    column ``fence_<rule>`` (double) each."""
    own = stored(sketches(measured, ["lang", "source"], rules), "sketches")
    a = edges(own, ["lang", "source"], rules, spread).alias("a")
    b = edges(own.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n")), ["lang"], rules, spread).alias("b")
    c = F.broadcast(edges(own.groupBy("rule", "bin").agg(F.sum("n").alias("n")), [], rules, spread)).alias("c")  # a row for each rule
    full = a.join(b, (F.col("a.rule") == F.col("b.rule")) & F.col("a.lang").eqNullSafe(F.col("b.lang"))).join(c, F.col("a.rule") == F.col("c.rule"))
    weighed = lambda name, parent: F.coalesce((F.col(f"{name}.total") * F.col(f"{name}.fence") + F.lit(float(prior)) * parent) / (F.col(f"{name}.total") + prior), parent)
    rows = full.select("a.lang", "a.source", "a.rule", weighed("a", weighed("b", F.col("c.fence"))).alias("fence"))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("fence"))).alias(f"fence_{r.name}") for r in rules])


def quality(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    rules: tuple[Rule, ...] = RULES,
    spread: int = SPREAD,
    prior: int = PRIOR,
    keep_text: bool = True,
) -> DataFrame:
    """docs with the base measures, ``base_failed``, ``failed_rules`` and ``kept``.

    Rows stay rows; columns of docs with these names are replaced, all others stay, whatever
    their names. Texts are measured once, whole, however long; the measures are stored (with keep_text
    next to the text) and read for the sketches and for the verdict. A null or empty text has no
    words and fails; null languages and sources are groups like any other. A value equal to its
    fence passes. Equal rows get equal
    verdicts. An empty table gives an empty one.
    """
    made = [*BASE, "base_failed", "failed_rules", "kept"]
    box = boxed(docs, (*made, *([] if keep_text else [text_col])), text=quoted(text_col), lang=quoted(lang_col), source=quoted(source_col))
    measured = stored(measures(box), "measured")
    limits = stored(fences(measured, rules, spread, prior), "fences").withColumnsRenamed({"lang": "for_lang", "source": "for_source"})
    joined = measured.join(sized(limits, limits.count()), F.col("lang").eqNullSafe(F.col("for_lang")) & F.col("source").eqNullSafe(F.col("for_source")), "left")
    beyond = lambda r: F.expr(r.measure) > F.col(f"fence_{r.name}") if r.upper else F.expr(r.measure) < F.col(f"fence_{r.name}")
    failed = F.array(*[F.when(beyond(r), F.lit(r.name)) for r in rules])
    judged = joined.withColumns({"base_failed": base_failed(), "failed_rules": F.array_compact(failed)})
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return unboxed(judged, *made)
