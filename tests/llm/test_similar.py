"""Near copies by the exact similarity of their shingles, whatever their fingerprints say."""

import random

from pyspark.sql import functions as F

from specweave.llm import simhash
from tests.llm.test_simhash import brute_fingerprint


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_planted_copies(spark):
    """Copies at 0.8 and a little more go though most of their fingerprints are far apart;
    texts a little less alike stay."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, near, far = [], [], []
    for i in range(120):
        words = [word() for _ in range(rng.choice([100, 300, 1000]))]
        other, place = list(words), iter(range(2, len(words), 7))
        least, below = (0.8, False) if i % 2 else (0.7, True)
        while True:  # change words as long as the copy stays above least
            last, at = list(other), next(place)
            other[at] = word()
            if jaccard(" ".join(words), " ".join(other)) < least:
                break
        a, b = " ".join(words), " ".join(last)
        rows += [(2 * i, a), (2 * i + 1, b)]
        if (brute_fingerprint(a, 5) ^ brute_fingerprint(b, 5)).bit_count() > 6:
            (far if jaccard(a, b) < 0.8 else near).append(2 * i + 1)
        assert jaccard(a, b) < 0.8 if below else jaccard(a, b) >= 0.8
    # A group around a text, whose members are less alike among themselves.
    base = [word() for _ in range(400)]
    group = [" ".join(base)]
    for k in range(8):
        own = list(base)
        for at in range(2 + k, 400, 57):
            own[at] = word()
        group.append(" ".join(own))
    rows += [(1000 + k, t) for k, t in enumerate(group)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs, shingle=5, max_bits=6, percent=80).collect()}
    assert len(near) > 20 and not kept & set(near)
    assert len(far) > 20 and kept > set(far)
    assert [i for i in kept if i >= 1000] == [1000]


def test_one_template(spark, monkeypatch):
    """Very many texts alike at 0.45 to 0.6 in the same buckets, with some copies at 0.8 among them: all
    copies link, by pairs that do not grow with the square."""
    monkeypatch.setattr(simhash, "DENSE", 5)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template, rows, planted = [word() for _ in range(200)], [], []
    for i in range(150):
        own = template + [word() for _ in range(rng.randint(70, 120))]
        rows.append((2 * i, " ".join(own)))
        if i % 5 == 0:
            copy = own[:-1] + [word()] if i % 2 else own[:]
            copy[rng.randrange(200, len(own))] = word()
            rows.append((2 * i + 1, " ".join(copy)))
            planted.append(2 * i + 1)
    made = []
    monkeypatch.setattr(simhash, "apart_pairs", lambda *a, f=simhash.apart_pairs: made.append((a[1] is not None, f(*a))) or made[-1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, shingle=5, max_bits=0, percent=80).collect()}
    root = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 10 * len(a & b) >= 8 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in root} and all(got[i] < i for i in planted)
    by_prefix = [f for dense, f in made if dense]
    assert by_prefix and by_prefix[0].count() < len(rows)


def test_wide_sketches(spark):
    """Bits of pairs at 0.8 and above stay within the bound, those of pairs at 0.65 do not."""
    rng, rows = random.Random(9), []
    for i in range(300):
        n, same = 900, rng.choice([0.8, 0.65])
        common = round(2 * n * same / (1 + same))
        both = [rng.getrandbits(64) - (1 << 63) for _ in range(2 * n - common)]
        rows.append((same, both[:n], both[n - common :]))
    got = spark.createDataFrame(rows, "same double, a array<long>, b array<long>").select("same", simhash.wide_sketch(F.col("a")).alias("a"), simhash.wide_sketch(F.col("b")).alias("b")).collect()
    far = [(r["same"], sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(r["a"], r["b"], strict=True))) for r in got]
    most = simhash.wide_bits(80)
    assert all((d <= most) == (same == 0.8) for same, d in far)


def test_fewer_links(spark):
    """Fewer links, the same components."""
    rng = random.Random(3)
    links = {(rng.randrange(60), 100 + rng.randrange(40)) for _ in range(90)}
    got = {tuple(r) for r in simhash.fewer_links(spark.createDataFrame(sorted(links), "a long, b long")).collect()}

    def parts(pairs):
        root = {x: x for pair in links for x in pair}

        def find(x):
            return x if root[x] == x else find(root[x])

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in root}

    assert parts(got) == parts(links) and len(got) <= len(links)
