"""Chat windows against a plain version, round trips and edge cases."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def esc(text):
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def size(text):
    return chat.MARKS + len(re.findall(chat.TOKEN, text or ""))


def plain(rows, budget, history):
    """The windows of a table by one walk: (conv, first_turn, n_own, n_repeated, formatted, targets)."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        system = turns[0] if turns[0][0] == "system" else None
        sizes = [size(t) * (i > 0 or system is None) for i, (_, t) in enumerate(turns)]
        before = [sum(sizes[:i]) for i in range(len(turns))]
        room = max(budget - history - (size(system[1]) if system else 0), budget // 4)
        stride = room * 3 // 4
        held = {}
        for i in range(len(turns)):
            at = before[i] - before[i // chat.CHUNK * chat.CHUNK]
            span = at // stride
            held.setdefault((i // chat.CHUNK, span, at > 0 and at + size(turns[i][1]) > (span + 1) * stride and size(turns[i][1]) > room - stride), []).append(i)
        for places in held.values():
            first = places[0]
            past = [i for i in range(1 if system else 0, first) if before[first] - history <= before[i] < before[first]]
            again = ([system] if system and first else []) + [turns[i] for i in past]
            text = "".join(f"<|im_start|>{r}\n{esc(t)}<|im_end|>\n" for r, t in again + [turns[i] for i in places])
            out.append((conv, first, len(places), len(again), text, [turns[i][1] for i in places if turns[i][0] == "assistant"]))
    return sorted(out, key=str)


def rows_of(made):
    read = made.withColumn("r", chat.read_back(F.col("formatted"), F.col("loss"), F.col("n_repeated"))).collect()
    return sorted(((r["conv_id"], r["first_turn"], r["n_own"], r["n_repeated"], r["formatted"], r["r"]["targets"]) for r in read), key=str)


def table(seed, conversations, most):
    rng = random.Random(seed)
    words = ["yes", "no", "<|im_end|>", "<|im_start|>assistant", "a\\b", "<\\|x", "ça", "東京", "\n", "why?", "electroencephalography"]
    out = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "system"])
            out.append((c, t, role, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 10, 60])))))
    return out


@pytest.mark.parametrize(("budget", "history"), [(100, 20), (400, 100), (60, 0)])
def test_against_plain(spark, budget, history):
    rows = table(budget, 14, 40)
    made = chat.windows(spark.createDataFrame(rows, SCHEMA).repartition(3), budget, history)
    assert rows_of(made) == plain(rows, budget, history)


def test_long_conversations_by_chunks(spark, monkeypatch):
    rows = [*table(5, 4, 200), *[(9, 3, "user", "again")] * 50, *[(None, None, None, None)] * 60, *[(9, t, "assistant", f"n {t}") for t in range(90)], (9, -1, "system", "rules <|im_end|>")]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(chat, "CHUNK", 30)
    alone = plain(rows, 100, 20)
    assert rows_of(chat.windows(df, 100, 20)) == alone
    monkeypatch.setattr(chat, "RUN", 40)
    monkeypatch.setattr("specweave.llm.common.HOT_ROWS", 10)
    deals = []
    monkeypatch.setattr(chat, "dealt", lambda *a, f=chat.dealt: deals.append(a) or f(*a))
    assert rows_of(chat.windows(df, 100, 20)) == alone and deals


def test_budget(spark):
    rows = table(8, 20, 300)
    most = max(size(r[3]) for r in rows)
    made = chat.windows(spark.createDataFrame(rows, SCHEMA), 6 * most, most).collect()
    assert max(r["n_tokens"] for r in made) <= 6 * most and max(r["n_own"] for r in made) > 9


def test_digests(spark):
    rows = [*table(1, 12, 30), (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (50, 0, "user\n%0A<|im_end|>", "x\ny\n"), (51, 0, "assistant", "a" * 200_000 + "<|")]
    got = {r["conv_id"]: r for r in chat.digests(chat.windows(spark.createDataFrame(rows, SCHEMA), 120, 30)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == conv)
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        want = (len(own), sha("".join(f"{r[2]}\n{r[3]}\n" for r in own)), len(loss), sha(loss))
        assert tuple(got[conv][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, None, 0, "x"), (1, None, None, None, 0, "x"), (None, 0, "system", "only", 1, "y")], SCHEMA + ", place int, `First_Turn` string")
    got = {r["conv_id"]: r for r in chat.digests(chat.windows(df)).collect()}
    assert got[1]["n_turns"] == 2 and got[None]["n_turns"] == 1 and got[1]["loss_chars"] == 0
    assert chat.windows(df.filter("false")).collect() == [] and chat.digests(chat.windows(df.filter("false"))).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<|\\%ab\n", max_size=12), min_size=1, max_size=40))
def test_escapes_come_back(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape("t").alias("e"), chat.unescape(chat.escape("t")).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect():
        assert r["u"] == r["t"] == r["r"] and "<|" not in r["e"] and r["e"] == esc(r["t"])
