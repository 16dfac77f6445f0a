"""The automaton against brute force, and the operator's edge cases."""

import hashlib
import random

from specweave.llm import decontaminate as d


def brute(items, words, window):
    hit, found = [0] * len(words), set()
    for name, own in items:
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    found.add(name)
                    hit[j : j + k] = [1] * k
    return hit, found


def test_automaton():
    rng = random.Random(1)
    for _ in range(1500):
        letters, window = rng.choice([2, 3, 5]), rng.choice([2, 3, 4])
        word = lambda n: b"%d" % rng.randrange(n)
        items = [(str(i), [word(letters) for _ in range(rng.randrange(9))]) for i in range(rng.randrange(5))]
        words = [word(letters + 1) for _ in range(rng.randrange(25))]
        spans, found = d.Automaton(items, window).scan(words)
        hit = [0] * len(words)
        for start, end in spans:
            hit[start:end] = [1] * (end - start)
        assert (hit, found) == brute(items, words, window)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_words():
    assert d.words_of("Don't STOP, Élan_3\x00x") == ["don".encode(), b"t", b"stop", "Élan".encode(), b"3", b"x"]
    assert d.words_of(None) == d.words_of(" -") == []


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def run(spark, texts, items, **more):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted(d.decontaminate(docs, bench, **more).collect(), key=lambda r: r["doc_id"])


def test_operator(spark):
    around = " ".join(f"w{i}" for i in range(30))
    texts = [None, "", around, f"{around} {ITEM.upper()}! {around}", f"{around} Mini item. {around}", ITEM, f"{around} one two three four five {ITEM} six seven eight nine ten eleven twelve {around}"]
    items = [(1, ITEM), (2, "mini item"), (2, "mini item"), (None, "mini item"), (3, None), (4, "-")]
    got = run(spark, texts, items)
    assert [r["n_hit"] for r in got] == [0, 0, 0, 12, 2, 12, 12]
    assert [r["n_items"] for r in got] == [0, 0, 0, 1, 2, 1, 1]
    assert got[3]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and got[4]["items_sha256"] == hashlib.sha256(b",2").hexdigest()
    assert got[2]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[0]["clean_text"] is None and got[2]["clean_text"] == around
    assert got[3]["clean_text"] == f"{around} \n! {around}"
    assert got[5]["clean_text"] is None and got[5]["contaminated"]
    # What a removal joins is scanned again.
    assert d.words_of(got[6]["clean_text"]) == d.words_of(f"{around} {around}")


def test_blocks(spark):
    """Blocks of a few words, and items cut into pieces, find the same."""
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))) for i in range(12)]
    texts = [" ".join(rng.choice("abcd") for _ in range(200)) for _ in range(8)] + [items[3][1], items[4][1]]
    key = lambda rows: [(r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows]
    assert key(run(spark, texts, items, window=6)) == key(run(spark, texts, items, window=6, block_words=15))
    assert [r["n_hit"] for r in run(spark, texts, items[:0])] == [0] * 10
    # So do several passes, with the same texts left.
    all_of = lambda rows: [tuple(r) for r in rows]
    once, often = (run(spark, [*texts, None, ""], items, window=6, block_words=60, pass_words=n, least_words=7) for n in (10**6, 100))
    assert all_of(once) == all_of(often) == all_of(run(spark, [*texts, None, ""], items, window=6, block_words=30, pass_words=1, least_words=7)) and any(r["clean_text"] != t for r, t in zip(once, texts, strict=False))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, f"x {ITEM}", 5, 6, 7)], "doc_id long, text string, __scan int, scan int, row int")
    got = d.decontaminate(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).first()
    assert (got["__scan"], got["scan"], got["row"], got["n_hit"]) == (5, 6, 7, 12)


def test_many_short_items():
    """Short items cost in proportion to their number."""
    items = [(str(i), [b"w%d" % i, b"v%d" % (i % 7)]) for i in range(30_000)]
    automaton = d.Automaton(items, 10)
    assert automaton.scan([b"w5", b"v5", b"w8", b"v2"])[1] == {"5"}


def test_passes_keep_copies_and_clashing_names(spark):
    """Copies of a contaminated text, and of what a removal leaves, all have the outcome of one pass."""
    around = " ".join(f"w{i}" for i in range(30))
    joined = f"{around} one two three four five {ITEM} six seven eight nine ten eleven twelve {around}"
    rows = [(i, t, 1, "k", 2) for i, t in enumerate([joined] * 4 + [around] * 3 + [f"{around} {ITEM} {around}"] * 2 + [ITEM, None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, digest string, spans int")
    bench = spark.createDataFrame([(1, ITEM), (2, "a b c d e f g h i j k l"), (3, f"x {ITEM} y")], "item_id long, text string")
    for with_text in (True, False):
        shown = lambda df: sorted(map(str, df.collect()))
        once, often = (d.decontaminate(docs, bench, with_text=with_text, block_words=14, pass_words=n) for n in (10**6, 1))
        assert shown(once) == shown(often) and once.columns == often.columns and once.filter("contaminated").count() == 7
