"""Fingerprints and components against brute force."""

import random
from itertools import combinations, combinations_with_replacement

import pytest
import xxhash
from pyspark.sql import functions as F

from specweave.llm import simhash

COLUMNS = "doc_id long, text string, fingerprint string"


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= bits:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in root}


@pytest.mark.parametrize(("segments", "bits", "equal"), [(6, 4, 2), (7, 4, 3), (8, 4, 4), (9, 6, 3)])
def test_ring_keys(segments, bits, equal):
    """However up to ``bits`` differences fall on segments, some key is identical."""
    keys = simhash.ring_keys(segments, bits, equal)
    for wrong in combinations_with_replacement(range(segments), bits):
        assert any(set(k).isdisjoint(wrong) for k in keys)
    assert sum(w for _, w in simhash.cuts(segments)) == 64


def test_fingerprint():
    rng = random.Random(3)
    texts = [None, "", " \n", "Ab", "ab c", "É é", *(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (3, 4, 5, 40, 300))]
    for k in (4, 5):
        assert [simhash.fingerprint_of(t, k) for t in texts] == [brute_fingerprint(t, k) for t in texts]
    assert simhash.fingerprint_of("x " * 40_000, 4) == brute_fingerprint("x x x x", 4)


def test_outer_pieces(spark):
    """Whatever max_bits bits differ outside a key, some piece of the rest is equal."""
    rng = random.Random(2)
    sets = simhash.ring_keys(6, 4, 2)
    pairs = []
    for _ in range(300):
        number = rng.randrange(len(sets))
        free = [shift + i for s, (shift, width) in enumerate(simhash.cuts(6)) if s not in sets[number] for i in range(width)]
        a = rng.getrandbits(64)
        pairs.append((number, a, a ^ sum(1 << b for b in rng.sample(free, 4))))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(n, signed(a), signed(b)) for n, a, b in pairs], "number int, a long, b long")
    got = frame.select(simhash.outer_pieces("a", "number", sets, 6, 4).alias("x"), simhash.outer_pieces("b", "number", sets, 6, 4).alias("y")).collect()
    assert all(len(r["x"]) == 5 and set(r["x"]) & set(r["y"]) for r in got)


@pytest.mark.parametrize(("bits", "dense"), [(4, 0), (4, 256), (6, 0), (6, 256)])
def test_components(spark, monkeypatch, bits, dense):
    """Dense balls, chains of links, and fingerprints of their own, by pieces and by whole buckets."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(bits)
    prints = set()
    for size, radius in ((150, 3), (60, 6), (1, 0), (40, 9)):
        centre, loose = rng.getrandbits(64), rng.sample(range(64), 14)
        for _ in range(size):
            prints.add(centre ^ sum(1 << b for b in rng.sample(loose, rng.randint(0, radius))))
    chain = rng.getrandbits(64)
    for step in range(12):
        prints.add(chain := chain ^ sum(1 << b for b in rng.sample(range(64), bits - step % 2)))
    prints |= {rng.getrandbits(64) for _ in range(100)} | {0, 3}
    want = brute_components(prints, bits)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {r["node"]: r["root"] for r in simhash.fingerprint_components(frame, bits).collect()}
    groups = lambda pairs: {frozenset(n for n, r in pairs if r == root) for _, root in pairs}
    assert groups([(signed(p), signed(r)) for p, r in want.items()]) == groups([(signed(p), got.get(signed(p), signed(p))) for p in prints])


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: brute_fingerprint(r["text"], 4) for r in docs.collect()}
    roots = brute_components(set(rows.values()), 4)
    least = {}
    for i, p in sorted(rows.items()):
        least.setdefault(roots[p], i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, shingle=4).collect()}
    assert got == {i: (f"{p:016x}", least[roots[p]]) for i, p in rows.items()}


def test_edges(spark):
    rows = [(5, None, "x"), (4, "", "x"), (None, " ", "x"), (7, "a b c d e f", "x"), (7, "a b c d e f", "x"), (None, "a b c d e f", "x"), (9, "z", "x")]
    docs = spark.createDataFrame(rows, COLUMNS)
    got = sorted((r["doc_id"] or 0, r["component_id"], r["fingerprint"]) for r in simhash.near_duplicates(docs).collect())
    assert [x[:2] for x in got] == [(0, 4), (0, 7), (4, 4), (5, 4), (7, 7), (7, 7), (9, 9)]
    assert got[0][2] == "0" * 16
    # Other texts of an id that goes stay, and of one component's rows of one id one stays.
    shared = spark.createDataFrame([(1, "p q r s t u"), (2, "p q r s t u"), (2, "of its own it is"), (3, "x y"), (3, "X Y")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.drop_near_duplicates(shared).collect())[:2] == [(1, "p q r s t u"), (2, "of its own it is")] and simhash.drop_near_duplicates(shared).count() == 3
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "7", "9", "None", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("segments", "bits"), [(6, 4), (9, 6), (16, 6)])
def test_ring_filter(spark, segments, bits):
    """No pair within the bits is pruned, and most pairs with many more bits are."""
    rng = random.Random(segments)
    differs = [sum(1 << b for b in rng.sample(range(64), rng.randint(0, 30))) for _ in range(4000)]
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(i, signed(d)) for i, d in enumerate(differs)], "i int, d long")
    kept = [r["k"] for r in frame.select("i", simhash.in_ring(F.col("d"), segments, bits).alias("k")).orderBy("i").collect()]
    of = lambda d: [(d >> s & (1 << w) - 1).bit_count() for s, w in simhash.cuts(segments)]
    viable = lambda c: any(all(sum(c[(i + j) % segments] for j in range(n)) * segments <= n * bits for n in range(1, simhash.CHAIN + 1)) for i in range(segments))
    assert kept == [viable(of(d)) for d in differs]
    assert all(k for k, d in zip(kept, differs, strict=True) if d.bit_count() <= bits)
    far = [k for k, d in zip(kept, differs, strict=True) if d.bit_count() > 20]
    assert sum(far) < 0.5 * len(far)


def test_ring_rows(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(50)]
    sets = simhash.ring_keys(9, 6, 3)
    got = {(r["fp"], r["number"]): r["key"] for r in simhash.ring_rows(spark.createDataFrame([(p,) for p in prints], "fp long"), sets, 9).collect()}
    assert len(got) == 50 * len(sets)
    for (fp, number), key in got.items():
        want = number
        for s in sets[number]:
            shift, width = simhash.cuts(9)[s]
            want = want << width | (fp % (1 << 64)) >> shift & (1 << width) - 1
        assert key % (1 << 64) == want


def plans_of(spark, run):
    """The final plans of all that run writes and collects."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(60_000)
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty(60_000)
    found = store.executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(before, found.size())]


@pytest.mark.parametrize("percent", [None, 80])
def test_no_table_is_broadcast_by_its_size(spark, percent):
    """Spark takes key rows, made in Python, and repetitive stored tables for much smaller than they are."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"w{n}" for n in range(40)], k=30))) for i in range(60)]
    rows += [(100 + i, text + " end") for i, text in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans = plans_of(spark, lambda: simhash.drop_near_duplicates(docs, max_bits=6, percent=percent).collect())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("BroadcastExchange" in p for p in plans)
