"""Benchmark decontamination with a generalised suffix automaton.

The items' words go into one suffix automaton in which no match crosses two items. A
training text is streamed through it word by word: the state and the matched length tell
the longest run of words, ending here, that occurs in some item. Runs of ``window`` words
or more, and whole items shorter than that, are contaminated spans.

Automata are broadcast, and their input is bounded twice: the items are cut into blocks of
at most ``block_words`` words, each with an automaton of its own, and a pass over the texts
takes blocks of at most ``pass_words`` words in all. A larger benchmark takes several
passes, whose spans and items are united row by row in a stored table; each pass's automata are
given up before the next one's are built. An item longer than a block is cut into pieces
that overlap by ``window - 1`` words, so no window is lost.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specweave.llm.common import boxed, quoted, sized, stored, unboxed

#: Bytes as they count in words: A-Z as a-z, other ASCII but 0-9 and a-z as a space.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))

#: Words a block's automaton is built of.
BLOCK_WORDS = 200_000
#: Words of all the blocks that are broadcast at a time.
PASS_WORDS = 1_000_000

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words: runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """A generalised suffix automaton of word sequences.

    Attributes: ``ids`` (word -> number), ``move`` (state * len(ids) + number -> state),
    ``link``, ``size`` (the longest match of each state), ``window_state`` (the state that
    stands for a state's last ``window`` words), ``items`` (a state's items that hold it),
    ``whole`` (the longest item below ``window`` words that is a proper suffix of a state,
    or the state itself) and ``shorter`` (the next such state).
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.words = sum(len(words) for _, words in items)
        self.ids: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.ids.setdefault(w, len(self.ids))
        self.base = max(1, len(self.ids))
        self.move: dict[int, int] = {}
        self._out: list[list[int]] = [[]]
        self.link, self.size = [-1], [0]
        ends = []
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.ids[w])
            ends.append(last)
        n = len(self.link)
        self.items: list[set[str]] = [set() for _ in range(n)]
        for name, words in items:
            state = 0
            for w in words:
                state = self.move[state * self.base + self.ids[w]]
                up = state
                while up > 0 and name not in self.items[up]:
                    self.items[up].add(name)
                    up = self.link[up]
        short = {e for e, (_, words) in zip(ends, items, strict=True) if 0 < len(words) < window and self.size[e] == len(words)}
        self.window_state, self.whole = [0] * n, [0] * n
        for s in sorted(range(1, n), key=self.size.__getitem__):
            up = self.link[s]
            self.window_state[s] = s if self.size[up] < window <= self.size[s] else self.window_state[up]
            self.whole[s] = s if s in short else self.whole[up]
        self.shorter = [self.whole[self.link[s]] if s else 0 for s in range(n)]
        self.short_items: dict[int, set[str]] = {s: set() for s in short}
        for e, (name, words) in zip(ends, items, strict=True):
            if e in short and len(words) < window:
                self.short_items[e].add(name)
        del self._out

    def _state(self, size: int, link: int) -> int:
        self.link.append(link)
        self.size.append(size)
        self._out.append([])
        return len(self.link) - 1

    def _copy(self, p: int, q: int, c: int) -> int:
        """Part the strings of q that end by p and c from its longer ones."""
        new = self._state(self.size[p] + 1, self.link[q])
        for d in self._out[q]:
            self._set(new, d, self.move[q * self.base + d])
        self.link[q] = new
        while p >= 0 and self.move.get(p * self.base + c) == q:
            self.move[p * self.base + c] = new
            p = self.link[p]
        return new

    def _set(self, state: int, c: int, to: int) -> None:
        if state * self.base + c not in self.move:
            self._out[state].append(c)
        self.move[state * self.base + c] = to

    def _extend(self, last: int, c: int) -> int:
        known = self.move.get(last * self.base + c)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._copy(last, known, c)
        new = self._state(self.size[last] + 1, 0)
        p = last
        while p >= 0 and p * self.base + c not in self.move:
            self._set(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self.move[p * self.base + c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, q, c)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The contaminated spans [start, end) of words, in order and apart, and the items
        of which a window (or the whole short item) occurs."""
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        short: set[int] = set()
        move, link, size, window, base = self.move, self.link, self.size, self.window, self.base
        whole, shorter = self.whole, self.shorter
        state = matched = 0
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                state = matched = 0
                continue
            to = move.get(state * base + c)
            while to is None and state:
                state = link[state]
                matched = size[state]
                to = move.get(state * base + c)
            if to is None:
                continue
            state, matched = to, matched + 1
            hit = 0
            if matched >= window:
                hit = matched
                states.add(state if size[link[state]] < window else self.window_state[state])
            w = whole[state]
            if w:
                if size[w] > matched:  # the state's own item, longer than the match
                    w = shorter[state]
                if w:
                    hit = max(hit, size[w])
                    while w and w not in short:
                        short.add(w)
                        w = shorter[w]
            if hit:
                start, end = i + 1 - hit, i + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))
        found = set().union(*(self.items[s] for s in states), *(self.short_items[s] for s in short)) if states or short else set()
        return spans, found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of at most block_words words each; the driver holds one block at a time."""
    items: list[tuple[str, list[bytes]]] = []
    held = 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).filter("text is not null").distinct().orderBy("id", "text")
    for row in rows.toLocalIterator():
        words = words_of(row["text"])
        step = max(1, block_words - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = words[at : at + step + window - 1]
            if items and held + len(piece) > block_words:
                yield Automaton(items, window)
                items, held = [], 0
            if piece:
                items.append((row["id"], piece))
                held += len(piece)
    yield Automaton(items, window)


def passes(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int, pass_words: int) -> Iterator[list[Automaton]]:
    """The blocks' automata, as many at a time as have pass_words words at most (one at least)."""
    held: list[Automaton] = []
    for automaton in blocks(benchmark, id_col, text_col, window, block_words):
        if held and sum(a.words for a in held) + automaton.words > pass_words:
            yield held
            held = []
        held.append(automaton)
    yield held


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _where(text: str) -> list[tuple[int, int]]:
    """(start, end) in bytes of each normalised word of a text."""
    return [m.span() for m in re.finditer(rb"[^ ]+", text.encode("utf-8", "surrogatepass").translate(_FOLD))]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without these spans, each of which leaves a newline."""
    raw, at = text.encode("utf-8", "surrogatepass"), _where(text)
    keep, last = [], 0
    for start, end in spans:
        keep.append(raw[last : at[start][0]])
        last = at[end - 1][1]
    keep.append(raw[last:])
    return b"\n".join(keep).decode("utf-8", "surrogatepass")


def clean_text(text: str, automata: list[Automaton], spans: list[tuple[int, int]], least: int) -> str:
    """text without spans of least or more words, over and over until none is left: what
    stands side by side after a removal is scanned again."""
    while spans := [s for s in spans if s[1] - s[0] >= least]:
        text = cut(text, spans)
        spans = _merged([s for a in automata for s in a.scan(words_of(text))[0]])
    return text


FOUND = "spans array<struct<start:long,end:long>>, items array<string>"
SPANS = "array<struct<start:bigint,end:bigint>>"


def hits(texts: DataFrame, automata: list[Automaton]) -> DataFrame:
    """A row for each different ``text`` in which these automata find something: ``key`` (its digest), ``text``,
    ``spans``, ``items``. The result is stored; texts without a hit are read, and neither moved nor written."""
    shared = [texts.sparkSession.sparkContext.broadcast(a) for a in automata]

    @F.pandas_udf(FOUND)
    def found(column: pd.Series) -> pd.DataFrame:
        own, out = [b.value for b in shared], []
        for text in column:
            words = words_of(text)
            each = [a.scan(words) for a in own]
            spans = _merged([s for h in each for s in h[0]])
            out.append(([{"start": s, "end": e} for s, e in spans], sorted(set(itertools.chain.from_iterable(h[1] for h in each)))))
        return pd.DataFrame(out, columns=["spans", "items"])

    hit = texts.select("text", found("text").alias("found")).filter(F.size("found.items") > 0)
    one = hit.groupBy(F.md5("text").alias("key")).agg(F.any_value("text").alias("text"), F.any_value("found").alias("found"))
    made = stored(one.select("key", "text", "found.*"), "pass")
    for b in shared:
        b.unpersist()
    return made


def all_hits(texts: DataFrame, groups: Callable[[], Iterator[list[Automaton]]]) -> DataFrame:
    """`hits` of all groups of automata, each in a pass over the texts, put together by key."""
    every = reduce(DataFrame.union, [hits(texts, group) for group in groups()])
    merge = F.pandas_udf(lambda column: pd.Series([[{"start": s, "end": e} for s, e in _merged([(x["start"], x["end"]) for x in spans])] for spans in column], dtype=object), SPANS)
    one = every.groupBy("key").agg(F.any_value("text").alias("text"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # a row a pass
    return stored(one.select("key", "text", merge("spans").alias("spans"), "items"), "hits")


def in_passes(box: DataFrame, groups: Callable[[], Iterator[list[Automaton]]], with_text: bool, least_words: int, most_coverage: float) -> DataFrame:
    """box (``row``, ``text``) with the outcome. Each group of automata takes a pass that reads the texts; what it finds is
    kept by the text's digest, and removals and their rounds only concern the texts that had a hit."""
    count = F.pandas_udf(lambda texts: pd.Series([len(words_of(t)) for t in texts]), "long")
    words_hit = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    dirty = all_hits(box.filter("text is not null"), groups)
    clean = dirty.select("key", F.lit(None).cast("string").alias("cleaned"))
    if with_text:
        remove = F.pandas_udf(lambda texts, spans: pd.Series([cut(t, [(s["start"], s["end"]) for s in ss]) for t, ss in zip(texts, spans, strict=True)], dtype=object), "string")
        todo = F.filter("spans", lambda s: s["end"] - s["start"] >= least_words)
        left = dirty.filter(words_hit(F.col("spans")) <= F.lit(most_coverage) * count("text"))
        turn = stored(left.select("key", "text", todo.alias("todo")), "todo")
        done = [turn.filter("size(todo) = 0").select("key", F.col("text").alias("cleaned"))]
        while (turn := turn.filter("size(todo) > 0")).limit(1).count():
            after = stored(turn.select("key", remove("text", "todo").alias("text")), "cut")
            again = all_hits(after.select("text"), groups).select(F.col("key").alias("hit"), todo.alias("todo"))
            turn = stored(after.join(again, F.md5("text") == F.col("hit"), "left").select("key", "text", F.coalesce("todo", F.array().cast(SPANS)).alias("todo")), "todo")
            done.append(turn.filter("size(todo) = 0").select("key", F.col("text").alias("cleaned")))
        clean = reduce(DataFrame.union, done)
    known = stored(dirty.select("key", "spans", "items").join(clean, "key", "left"), "outcome")
    out = box.join(sized(known, known.count()), F.md5("text") == F.col("key"), "left")
    spans, items = F.coalesce("spans", F.array().cast(SPANS)), F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("row", "text", "key", count("text").alias("n_words"), words_hit(spans).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), spans.alias("spans"), "cleaned")
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out.withColumn("clean_text", F.when(F.col("key").isNull(), F.col("text")).otherwise(F.col("cleaned"))) if with_text else out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_words: int = BLOCK_WORDS,
    pass_words: int = PASS_WORDS,
    with_text: bool = True,
    least_words: int = 1,
    most_coverage: float = 0.8,
) -> DataFrame:
    """docs with the outcome of a scan of every whole text.

    New columns: ``n_words``, ``n_hit`` (words in spans), ``n_items``, ``items_sha256``,
    ``contaminated``, ``spans`` (start and end in words) and, if with_text,
    ``clean_text`` (the text without spans of least_words words or more; null where more
    than most_coverage of the words are hit, and where the text is null). Columns of docs
    with these names are replaced; the others stay, whatever their names. Rows stay rows, and texts of any
    length are taken whole. Nothing is shuffled while the benchmark fits one pass; with more passes texts meet
    what was found in them by their digest, by a broadcast if it is little.

    Null or empty texts have no words and are clean. Items without words have no window.
    A null item id counts as the item id ''; rows that repeat an item id count once in
    n_items. Of an empty benchmark nothing is found.
    """
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", *(["clean_text"] if with_text else [])]
    made = [n for n in names if n.lower() != text_col.lower()]
    box = boxed(docs, tuple(made), text=quoted(text_col))

    def groups() -> Iterator[list[Automaton]]:
        return passes(benchmark, item_id, item_text, window, block_words, pass_words)

    first, second = itertools.islice(itertools.chain(groups(), [None]), 2)
    if second is not None:
        return unboxed(in_passes(box, groups, with_text, least_words, most_coverage), *made)
    shared = [docs.sparkSession.sparkContext.broadcast(a) for a in first]
    schema = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>" + ", clean_text string" * with_text

    @F.pandas_udf(schema)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        automata = [b.value for b in shared]
        out = []
        for text in texts:
            words = words_of(text)
            hits = [a.scan(words) for a in automata]
            spans = hits[0][0] if len(hits) == 1 else _merged([s for h in hits for s in h[0]])
            items = sorted(set(itertools.chain.from_iterable(h[1] for h in hits)))
            n_hit = sum(e - s for s, e in spans)
            row = [len(words), n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, [{"start": s, "end": e} for s, e in spans]]
            if with_text:
                whole = text is not None and n_hit <= most_coverage * len(words)
                row.append((clean_text(text, automata, spans, least_words) if spans else text) if whole else None)
            out.append(row)
        return pd.DataFrame(out, columns=names)

    found = box.withColumn("scan", scanned("text"))
    return unboxed(found, *[F.col("scan")[n].alias(n) for n in made])
