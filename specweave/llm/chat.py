"""Chat formatting in budgeted windows, by DataFrame functions alone.

A conversation is cut into windows between turns. The prefix sums of its turns' tokens choose
them: with a stride of three quarters of the room for new turns, the turns whose
prefix lies in one stride make a window. Its last turn may reach over the stride's end; if it takes more than
the last quarter of the room, it is a window of its own. So a window is within the budget
unless one turn alone or the system turn is too large for that, and no turn is ever cut or dropped. The windows follow
from the sums, not from one another, so nothing walks through a conversation.

Every window begins with the system turn, if the conversation's first turn is one, and with the
turns before it that lie whole within ``history`` tokens. These are repeated, so they
are masked: the loss covers each assistant's text in the one window that holds it as a new turn.

Texts are shuffled once, by conversation. Windows also end after every CHUNK turns, so a
conversation with a large share of all rows is dealt out by chunks (`dealt`); what a
chunk repeats of earlier turns comes along with it, and the windows are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.common import hot_keys, quoted, stored

START, END = "<|im_start|>", "<|im_end|>"
#: A token: up to eight letters, digits or characters beyond ASCII, or one ASCII sign.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{1,8}|[!-/:-@\[-`{-~]"
#: Tokens of a turn's marks, at least one for each turn.
MARKS = 4
BUDGET, HISTORY = 2048, 512
#: Turns after which a window ends in any case.
CHUNK = 5000
#: Rows that a task of `dealt` numbers.
RUN = 50_000


def escape(text: Column) -> Column:
    """text with one more backslash between `<` and `|`, however many are there, so that no mark is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


#: What a role can't hold as it is: the escape sign itself, the line end and the start of a mark.
_ROLE = [("%", "%25"), ("\n", "%0A"), ("<", "%3C")]


def escape_role(role: Column) -> Column:
    for plain, shown in _ROLE:
        role = F.replace(role, F.lit(plain), F.lit(shown))
    return role


def unescape_role(role: Column) -> Column:
    for plain, shown in reversed(_ROLE):
        role = F.replace(role, F.lit(shown), F.lit(plain))
    return role


def estimate(text: Column) -> Column:
    """Number of tokens of a text, by the pattern TOKEN."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]


def dealt(rows: DataFrame, history: int) -> DataFrame:
    """Rows of very long conversations with their ``place``, by chunks of CHUNK turns. Each chunk
    also has what its windows may repeat: the system turn and the turns within ``history`` tokens before it
    (``carried``). Rows are numbered in runs of a range partitioning, equal ones anywhere."""
    tasks = max(2, -(-rows.count() // RUN))
    ranged = rows.withColumn("salt", F.rand(17)).repartitionByRange(tasks, "conv", *_order(), "salt").withColumn("run", F.spark_partition_id())
    runs = stored(ranged.drop("salt"), "runs")
    counts = runs.groupBy(F.col("conv").alias("c"), F.col("run").alias("r")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("c", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = runs.withColumn("k", F.row_number().over(Window.partitionBy("conv", "run").orderBy(*_order())) - 1).join(starts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    own = numbered.select("conv", "role", "text", "size", (F.col("start") + F.col("k")).alias("place")).withColumn("chunk", F.floor(F.col("place") / CHUNK))
    own = stored(own, "dealt")
    columns = ["conv", "chunk", "place", "role", "text", "size"]
    last = Window.partitionBy("conv", "chunk").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tail = own.withColumn("upto", F.sum("size").over(last)).filter((F.col("upto") <= history) & (F.col("place") > 0)).withColumn("chunk", F.col("chunk") + 1)
    chunks = F.broadcast(own.groupBy(F.col("conv").alias("c")).agg(F.max("chunk").alias("chunks")))  # a row for each hot key
    system = own.filter("place = 0 and role = 'system'").join(chunks, F.col("conv").eqNullSafe(F.col("c"))).withColumn("chunk", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), "chunks"))))
    carried = tail.select(*columns).unionByName(system.select(*columns)).withColumn("carried", F.lit(True))
    return own.select(*columns, F.lit(False).alias("carried")).unionByName(carried)


def _windows(rows: DataFrame, keys: list[str], budget: int, history: int) -> DataFrame:
    """The windows of rows with ``conv``, ``chunk``, ``place``, ``role``, ``text``, ``size`` and
    ``carried``; all of a row's earlier turns that count are in its partition by keys."""
    w = Window.partitionBy(*keys).orderBy("place")
    is_system = (F.col("place") == 0) & (F.col("role") == "system")
    turn = F.struct("role", "text", "size")
    rows = rows.withColumn("before", F.coalesce(F.sum(F.when(is_system, 0).otherwise(F.col("size"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("system", F.first(F.when(is_system, turn), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    past = F.collect_list(F.when(~is_system, turn)).over(Window.partitionBy(*keys).orderBy("before").rangeBetween(-history, -1))
    rows = rows.withColumn("past", past).filter(~F.col("carried"))
    rows = rows.withColumn("at", F.col("before") - F.min("before").over(Window.partitionBy("conv", "chunk")))
    room = F.greatest(F.lit(budget - history) - F.coalesce("system.size", F.lit(0)), F.lit(budget // 4))
    stride = F.floor(room * 3 / 4)
    rows = rows.withColumn("span", F.floor(F.col("at") / stride))
    alone = (F.col("at") > 0) & (F.col("at") + F.col("size") > (F.col("span") + 1) * stride) & (F.col("size") > room - stride)
    grouped = rows.groupBy("conv", "chunk", "span", alone.alias("alone")).agg(
        F.min("place").alias("first_turn"),
        F.array_sort(F.collect_list(F.struct("place", "role", "text", "size"))).alias("own"),
        F.min_by("past", "place").alias("past"),
        F.min_by("system", "place").alias("system"),
    )
    system = F.when(F.col("system").isNotNull() & (F.col("first_turn") > 0), F.array("system")).otherwise(F.array().cast("array<struct<role:string,text:string,size:bigint>>"))
    piece = lambda t, own: F.struct(
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END + "\n")).alias("shown"),
        (F.length(escape_role(t["role"])) + len(START) + 1).cast("long").alias("head"),
        (F.lit(own) & (t["role"] == "assistant")).alias("target"),
        t["size"].alias("size"),
    )
    made = grouped.withColumn("again", F.concat(system, "past"))
    made = made.select("conv", "first_turn", F.size("own").alias("n_own"), F.size("again").alias("n_repeated"), F.concat(F.transform("again", lambda t: piece(t, False)), F.transform("own", lambda t: piece(t, True))).alias("pieces"))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def add(done: Column, p: Column) -> Column:
        n = F.length(p["shown"]).cast("long")
        target = F.struct((done["at"] + p["head"]).alias("start"), (n - p["head"] - len(END) - 1).alias("length"))
        return F.struct((done["at"] + n).alias("at"), F.when(p["target"], F.concat(done["loss"], F.array(target))).otherwise(done["loss"]).alias("loss"))

    loss = F.aggregate("pieces", nothing, add)["loss"]
    tokens = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["size"])
    return made.select("conv", "first_turn", "n_own", "n_repeated", tokens.alias("n_tokens"), F.array_join(F.col("pieces.shown"), "").alias("formatted"), loss.alias("loss"))


def windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Column | None = None
) -> DataFrame:
    """A row per window of each conversation: the conversation's id, ``first_turn`` (the place of its
    first new turn, from 0), ``n_own`` and ``n_repeated`` (new turns, and repeated ones before
    them), ``n_tokens``, ``formatted`` and ``loss``, the character ranges (start from 0, length) under
    the loss mask.

    A turn takes `tokens` (by default an estimate) and MARKS more. Turns go by turn_col (null last), then by role and text, so
    repeated rows and equal turns have a place each. Null roles and texts are empty, an id that is null is a
    conversation like any other, and texts of any length stay whole. A system turn
    later than the first is a turn like others. Other columns are not read. An empty table gives an empty one.
    """
    if not 0 <= history < min(budget, CHUNK * MARKS):
        raise ValueError("history must be below the budget")
    text = F.coalesce(quoted(text_col), F.lit(""))
    size = (F.coalesce(estimate(text) if tokens is None else tokens.cast("long"), F.lit(0)) + MARKS).alias("size")
    rows = turns.select(quoted(conv_col).alias("conv"), quoted(turn_col).alias("turn"), F.coalesce(quoted(role_col), F.lit("")).alias("role"), text.alias("text"), size)
    key = F.xxhash64("conv")
    counts = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    hot = hot_keys(counts.filter(F.col("n") > CHUNK), "key", turns.count())
    place = F.row_number().over(Window.partitionBy("conv").orderBy(*_order())).cast("long") - 1
    few = (rows.filter(~key.isin(hot)) if hot else rows).select("conv", "role", "text", "size", place.alias("place"), F.lit(False).alias("carried"))
    made = _windows(few.withColumn("chunk", F.floor(F.col("place") / CHUNK)), ["conv"], budget, history)
    if hot:
        made = made.unionByName(_windows(dealt(rows.filter(key.isin(hot)), history), ["conv", "chunk"], budget, history))
    return made.withColumnRenamed("conv", conv_col)


def read_back(formatted: Column, loss: Column, n_repeated: Column) -> Column:
    """struct(turns, targets) of a window: its new turns (role, text) and the texts under the
    loss mask, both unescaped, read from the formatted text."""
    shown = F.split(formatted, r"<\|im_end\|>\n", -1)
    new = F.slice(shown, n_repeated + 1, F.size(shown) - 1 - n_repeated)

    def turn(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        return F.struct(unescape_role(F.substring(line, F.lit(len(START) + 1), F.length(line))).alias("role"), unescape(F.substring(piece, F.length(line) + 2, F.length(piece))).alias("text"))

    targets = F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.struct(F.transform(new, turn).alias("turns"), targets.alias("targets"))


def digests(made: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation of `windows`, read back from them: ``n_turns``, ``turns_sha256`` (role, line end,
    text, line end of each turn), ``loss_chars``, ``loss_sha256`` (all text under the mask) and
    ``formatted_chars``. A digest takes its conversation as one string, of 2 GB at most."""
    read = made.select(quoted(conv_col).alias("conv"), "first_turn", "n_own", F.length("formatted").alias("chars"), read_back(F.col("formatted"), F.col("loss"), F.col("n_repeated")).alias("r"))
    told = F.array_join(F.transform("r.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv", "n_own", "chars", F.struct("first_turn", told.alias("told"), F.array_join("r.targets", "").alias("targets")).alias("part"))
    whole = parts.groupBy("conv").agg(F.sum("n_own").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    joined = whole.select("conv", "n_turns", "formatted_chars", F.array_join("parts.told", "").alias("told"), F.array_join("parts.targets", "").alias("targets"))
    return joined.select(F.col("conv").alias(conv_col), "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("targets").cast("long").alias("loss_chars"), F.sha2("targets", 256).alias("loss_sha256"), "formatted_chars")
