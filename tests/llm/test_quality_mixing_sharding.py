"""Quality rules, mixing and sharding: brute force, properties and edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from specweave.llm import mixing, quality, sharding


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b c d", "a b c d e", "x " * 3000, "é ü 😀 #*$%&|<>", "l 1\nl 1\n\nl 1 \n"]
    texts += [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 12, 30, 90)] + ["\n".join(rng.choice(["a b", "c", " "]) for _ in range(40))]
    docs = spark.createDataFrame([(i, t, "en", None, 7, 8, 9, 10) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int, fence_symbols int, __lang int, row int")
    got = sorted(quality.quality(docs, prior=3).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r[b] for b in quality.BASE) for r in got] == [brute_measures(t) for t in texts]
    assert not any(r["kept"] for r in got if r["base_failed"]) and quality.quality(docs.limit(0)).count() == 0


def test_thresholds(spark):
    """A fence follows its group: symbols are usual in one source and odd in another."""
    clean = lambda i: " ".join(f"word{i}x{k}" for k in range(40))
    busy = lambda i, n: " ".join(f"#{i}y{k}" if k < n else f"w{i}x{k}" for k in range(40))
    rows = [("plain", clean(i)) for i in range(60)] + [("plain", busy(900, 12))] + [("code", busy(i, 8 + i % 9)) for i in range(60)] + [("tiny", busy(800, 10)), ("tiny", None)]
    docs = spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    for keep in (True, False):
        got = {r["doc_id"]: r for r in quality.quality(docs, keep_text=keep).collect()}
        assert not got[60]["kept"] and got[60]["failed_rules"] == ["symbols"]
        assert all(got[i]["kept"] for i in [*range(60), *range(61, 121)])
        assert not got[122]["kept"] and ("text" in got[0].asDict()) == keep


def test_sketches_decide(spark):
    """The fences of the documents' groups differ, and other sketches give other verdicts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured = quality.stored(quality.measures(docs.select("doc_id", "lang", "source", "text")), "measured")
    rows = quality.fences(measured).collect()
    for rule in ("symbols", "dup_lines", "repeats", "long_words", "short_words"):
        assert len({r[f"fence_{rule}"] for r in rows}) > 10
    kept = {r["doc_id"] for r in quality.quality(docs, keep_text=False).filter("kept").collect()}
    longer = docs.withColumn("text", F.when(F.col("lang") == "de", F.regexp_replace("text", r"([a-z])\b", "$1$1$1$1")).otherwise(F.col("text")))
    moved = {r["doc_id"]: r for r in quality.quality(longer, keep_text=False).collect()}
    german = [r for r in moved.values() if r["lang"] == "de" and not r["base_failed"]]
    # Texts whose words are all longer stay where the whole language is so, and go elsewhere.
    assert sum(r["kept"] for r in german) > 0.85 * len(german) and len(kept) > 0.8 * docs.count()
    # The same words make a text odd where few have them.
    few = docs.withColumn("text", F.when(F.col("doc_id") % 37 == 0, F.regexp_replace("text", r"([a-z])\b", "$1$1$1$1$1$1$1$1$1")).otherwise(F.col("text")))
    odd = [r for r in quality.quality(few, keep_text=False).collect() if r["doc_id"] % 37 == 0 and not r["base_failed"] and r["lang"] == "en"]
    assert sum("long_words" in r["failed_rules"] for r in odd) > 0.8 * len(odd) > 0


def test_a_group_full_of_junk(spark):
    """Where two in five texts of a source are junk, these still go and the others stay; a source whose texts all
    hold some signs keeps them, and a tie with the fence stays."""
    clean = lambda i: " ".join(f"word{i}x{k}" for k in range(50))
    junk = lambda i: " ".join(f"{'#$%&'[k % 4]}y{i}{k}" for k in range(50))
    some = lambda i: " ".join(f"{'#' * (k < 5 + i % 4)}w{i}x{k}" for k in range(50))
    lines = lambda i, n: "\n".join(" ".join(f"l{i}x{k}y{j}" for j in range(8)) + ("\nsame" if k < n else "") for k in range(12))
    rows = [("good", clean(i)) for i in range(100)] + [("bad", junk(i) if i % 5 < 2 else clean(i)) for i in range(50)] + [("code", some(i)) for i in range(100)] + [("lines", lines(i, 12 if i % 10 == 0 else 1 + i % 2)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality(docs, keep_text=False).collect()}
    for i, (source, text) in enumerate(rows):
        odd = source == "bad" and "#y" in text or source == "lines" and text.count("same") > 5
        assert got[i]["kept"] != odd, (source, got[i])


def test_edges_of_sketches(spark):
    """Tables of one row, of equal rows, and of rows that all fail have verdicts."""
    text = " ".join(f"word{k}" for k in range(30))
    for rows in ([(1, text)], [(1, text)] * 5, [(1, None), (2, ""), (3, "few words")]):
        docs = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, source string")
        assert [r["kept"] for r in quality.quality(docs).collect()] == [r[1] == text for r in rows]


def test_bins(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 1000, 123456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bin_of(F.col("v"))).collect()]
    assert got == [0, 1, 31, 32, 32, 62, 64, 992, 29 << 22]
    assert all(b <= v and v - b <= v / 16 for v, b in zip(values, got, strict=True))


def test_water_fill(spark):
    rng = random.Random(6)
    for _ in range(4):
        rows = [(f"s{i}", rng.randint(0, 1000), float(rng.choice([1, 2, 3]))) for i in range(rng.randint(1, 7))]
        budget = rng.choice([0.3, 1.5, 3.0]) * sum(r[1] for r in rows)
        frame = spark.createDataFrame(rows, "source string, source_size long, weight double")
        got = {r["source"]: r["target"] for r in mixing.water_fill(frame, budget, 2.0).collect()}
        low, high = 0.0, 1e6  # the unit of weight by bisection
        for _ in range(100):
            unit = (low + high) / 2
            low, high = (unit, high) if sum(min(2 * n, w * unit) for _, n, w in rows) < budget else (low, unit)
        assert all(abs(got[s] - min(2 * n, w * high)) < 1e-3 for s, n, w in rows)


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([1, 3, 10, 80]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(1000, None, "a"), (None, "w w", "b"), (5, "w " * 9, "a"), (5, "w " * 9, "a"), (1001, "", "empty"), (1002, None, "empty")]
    docs = spark.createDataFrame([(*r, "clash", "until", "n", 1, 2) for r in rows], "doc_id long, text string, source string, taken string, until string, `__place` string, `row` int, `__copy` int")
    runs = [sorted((str(tuple(r)) for r in mixing.mix(docs, mixing.cyclic_weights(docs), keep_text=keep).drop("text").collect())) for keep in (True, False)]
    assert runs[0] == runs[1]
    got = mixing.mix(docs, mixing.cyclic_weights(docs)).collect()
    assert len(got) == len(rows) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)  # half of the largest document
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert mixing.expanded(mixing.mix(docs, mixing.cyclic_weights(docs))).count() == sum(r["repeats"] for r in got)
    assert mixing.mix(docs.limit(0), mixing.cyclic_weights(docs)).count() == 0


def test_place():
    rng = np.random.default_rng(8)
    vectors = rng.gamma(2, 1, size=(300, 3))
    counts = sharding.place(vectors, np.full(300, 10), 24)
    loads = counts.T @ vectors
    assert (abs(loads / loads.mean(axis=0) - 1) < 0.05).all() and (counts.sum(axis=1) == 10).all()
    assert sharding.place(np.zeros((0, 3)), np.zeros(0, dtype=int), 3).shape == (0, 3) and sharding.place(np.ones((1, 3)), np.array([5]), 3).tolist() == [[2, 2, 1]]


def test_deal():
    """All at once gives what one vector after another does, with room and beyond it."""
    rng = np.random.default_rng(9)
    for _ in range(400):
        shards = int(rng.integers(1, 6))
        left, v = rng.normal(0.5, 0.5, size=(shards, 3)), rng.gamma(1, 0.2, size=3) * (rng.random(3) < 0.8)
        if rng.random() < 0.3:
            left[:] = left[0]
        m, counts = int(rng.integers(0, 60)), np.zeros(shards, dtype=int)
        for _ in range(m):
            counts[sharding.step(left - counts[:, None] * v, v)] += 1
        assert sharding.deal(m, v, left).tolist() == counts.tolist()
    v = np.array([1e-9, 2e-9, 1e-9])
    assert sharding.deal(2_400_000_005, v, np.ones((24, 3))).max() == 100_000_001


def cut_to_five_bits(n):
    drop = max(0, n.bit_length() - 5)
    return f"{n >> drop} {drop}"


def plain_greedy(rows, shards):
    """rows: (hash of the text, text). The shards of each group by plain greedy placement, group by group."""
    groups = {}
    for g, text in rows:
        size, tokens, n = groups.get(g, (0, 0, 0))
        groups[g] = size + len(text.encode()) + 8, tokens + len(re.findall(r"[^\x20\x09-\x0D]+", text)), n + 1
    fair = sum(v[0] for v in groups.values()) / shards
    units = defaultdict(list)
    for g, (size, tokens, n) in groups.items():
        if size <= 1.25 * fair:
            units[f"{cut_to_five_bits(size)} {cut_to_five_bits(n)} {tokens * 32 // size}"].append(g)
    capacity = np.array([sum(v[d] for v in groups.values()) for d in range(3)]) / shards
    giants = sorted(g for g in groups if groups[g][0] > 1.25 * fair)
    means = [(np.array(groups[g]) / -(-groups[g][0] // fair) / capacity, [g] * int(-(-groups[g][0] // fair))) for g in giants]
    means += [(np.array([groups[g] for g in units[c]]).sum(axis=0) / len(units[c]) / capacity, sorted(units[c])) for c in sorted(units)]
    left, at = np.ones((shards, 3)), {}
    for v, members in sorted(means, key=lambda x: -x[0].max()):
        counts = np.zeros(shards, dtype=int)
        for _ in members:
            residual = left - counts[:, None] * v
            fits = [s for s in range(shards) if (residual[s] >= v - 1e-12).all()]
            s = max(fits, key=lambda s: (residual[s] @ v, -s)) if fits else max(range(shards), key=lambda s: ((residual[s] - v).min(), -s))
            counts[s] += 1
        left -= counts[:, None] * v
        # The members of a class go by their order, shard after shard.
        for g, s in zip(members, np.repeat(np.arange(shards), counts), strict=True):
            at.setdefault(g, []).append(int(s))
    return at


def test_greedy(spark):
    """Plain greedy placement, group by group, gives every document the same shard."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("g")).collect()
    for shards in (3, 24):
        at = plain_greedy([(r["g"], r["text"]) for r in rows], shards)
        got = {r["doc_id"]: r["shard"] for r in sharding.pack(docs, shards=shards).collect()}
        assert all(got[r["doc_id"]] in at[r["g"]] for r in rows)


def test_very_long_texts(spark):
    """A text of a million words among short ones is measured, mixed and placed whole."""
    long = " ".join(f"w{i % 99_991}" for i in range(1_000_000))
    rows = [(1, long, "a"), *[(i, f"some words of text {i}", "b") for i in range(2, 40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = {r["doc_id"]: r for r in mixing.mix(docs, mixing.cyclic_weights(docs)).collect()}
    assert mixed[1]["size"] == 1_000_000 and mixed[1]["taken"] in (0, 1_000_000, 2_000_000)
    packed = {r["doc_id"]: r for r in sharding.pack(docs.drop("source"), shards=3).collect()}
    assert packed[1]["size"] == len(long) + 8 and packed[1]["tokens"] == 1_000_000 and len(packed) == 39


def test_ties_with_the_fence(spark):
    """Documents at their group's fence stay, those above go, and equal rows have equal verdicts."""
    base = [f"u{i}x{k}" for i in range(1) for k in range(1000)]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(1000))) for i in range(60)]
    rows += [(100 + n, " ".join("#" * (k < n) + w for k, w in enumerate(base))) for n in range(1, 9) for _ in range(2)]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    fence = quality.fences(quality.stored(quality.measures(docs), "m")).first()["fence_symbols"]
    got = quality.quality(docs).collect()
    assert 4 <= fence < 5
    failed = {(r["n_symbols"], "symbols" in r["failed_rules"]) for r in got}
    assert failed == {(n, n > fence) for n in range(9)}


def test_pack(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["ab", "cde", "f"]) for _ in range(rng.randint(0, 40)))) for i in range(1500)] + [(2000 + i, "same text") for i in range(20)] + [(None, None), (1, "again"), (1, "again")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, shard int")
    got = sharding.pack(docs, shards=5).collect()
    assert len(got) == len(rows)
    of_text, slots, bytes_, counts = {}, defaultdict(list), Counter(), Counter()
    for r in got:
        assert of_text.setdefault(r["text"] or "", r["shard"]) == r["shard"]
        assert r["size"] == len((r["text"] or "").encode()) + 8
        slots[r["shard"]].append(r["slot"])
        bytes_[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 5
    assert max(bytes_.values()) < 1.05 * min(bytes_.values()) and max(counts.values()) < 1.1 * min(counts.values())
    narrow = sharding.pack(docs, shards=5, keep_text=False)
    assert sorted((str(r["doc_id"]), r["size"], r["shard"], r["slot"]) for r in narrow.collect()) == sorted((str(r["doc_id"]), r["size"], r["shard"], r["slot"]) for r in got)
    assert sharding.pack(docs.limit(0), shards=5).count() == 0


def test_pack_splits_giants(spark):
    """A group above a fair share is cut, whether or not its ids repeat; slots stay gapless over several runs."""
    docs = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, concat('t', id), 'giant') as text")
    same = sharding.pack(docs.selectExpr("if(text = 'giant', 5, doc_id) as doc_id", "text", "7 as part"), shards=4).collect()
    assert max(Counter(r["shard"] for r in same).values()) <= 1.25 * min(Counter(r["shard"] for r in same).values()) and len(same) == 900
    got = sharding.pack(docs, shards=4).collect()
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) <= 1.25 * min(counts.values())
    numbered = sharding.numbered(docs.selectExpr("*", "cast(doc_id % 2 as int) as s"), "s", [F.col("doc_id")], 450, "slot")
    for s in (0, 1):
        assert sorted(r["slot"] for r in numbered.filter(F.col("s") == s).collect()) == list(range(450))


def test_many_groups_are_shuffled(spark, monkeypatch):
    """Shards of groups grow with the groups, so they are broadcast by their counted number alone."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 200).alias("text"))
    few = sharding.pack(docs, shards=3)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 100, raising=False)
    many = sharding.pack(docs, shards=3)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [group" in plan(many) and "SortMergeJoin [group" not in plan(few)
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
