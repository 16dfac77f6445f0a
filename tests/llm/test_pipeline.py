"""The pipeline's stages, each on what its predecessor kept, against brute force."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specweave.llm import decontaminate
from specweave.llm.common import stored
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_quality_mixing_sharding import brute_measures, plain_greedy
from tests.llm.test_simhash import brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def test_columns(results):
    assert all(r.columns == corpus_pipeline.COLUMNS for r in results[:-1])
    assert set(corpus_pipeline.COLUMNS) < set(results[-1].columns)


def test_quality(results):
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in results[:2])
    for i, r in before.items():
        words, _, _, _, repeated = brute_measures(r["text"])
        if words < 10 or 100 * repeated > 20 * words:
            assert i not in after
    assert all(after[i] == before[i] for i in after) and len(after) > 0.7 * len(before)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup(results):
    """Of the texts that six bits or a Jaccard similarity of 0.8 link, the smallest id stays."""
    before, after = (x.collect() for x in results[1:3])
    rows = sorted((r["doc_id"], brute_fingerprint(r["text"], 5), shingles(r["text"])) for r in before)
    first = {i: i for i, _, _ in rows}

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    for n, (i, print_i, set_i) in enumerate(rows):
        for j, print_j, set_j in rows[n + 1 :]:
            if (print_i ^ print_j).bit_count() <= 6 or (set_i and 10 * len(set_i & set_j) >= 8 * len(set_i | set_j)):
                a, b = find(i), find(j)
                first[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in after) == sorted({find(i) for i in first})


def test_decontamination(spark, results):
    items = [(str(r["item_id"]), decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in results[2:4])
    for i, r in before.items():
        if sum(brute_windows(items, decontaminate.words_of(r["text"]), 10)[0]):
            assert i not in after or not sum(brute_windows(items, decontaminate.words_of(after[i]["text"]), 10)[0])
        else:
            assert after[i] == r


def test_mix_and_shards(results):
    clean, mixed, sharded = (x.collect() for x in results[3:])
    size = {r["doc_id"]: len(r["text"].split()) for r in clean}
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= set(size) and set(copies.values()) <= {1, 2}
    assert abs(sum(size[i] * n for i, n in copies.items()) / sum(size.values()) - 1.5) < 0.1
    assert Counter(r["doc_id"] for r in sharded) == copies
    slots = defaultdict(list)
    for r in sharded:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < corpus_pipeline.SHARDS


def test_mix_by_sql(results):
    """The copies of each document are those that op9's SQL takes of what the stage was given."""
    import duckdb

    from specweave.llm.queries import OP9_SQL

    documents = results[3].toArrow()
    db = duckdb.connect()
    db.register("documents", documents)
    taken = {row[0]: row for row in db.sql(f"SELECT doc_id, taken, size FROM ({OP9_SQL})").fetchall()}
    copies = Counter(r["doc_id"] for r in results[4].collect())
    assert {i: copies[i] * size for i, _, size in taken.values()} == {i: t for i, t, _ in taken.values()}


def test_shards_by_plain_greedy(results):
    """Each copy lies in a shard of its group by the plain placement of what the stage was given."""
    rows = results[4].select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("g")).collect()
    at = plain_greedy([(r["g"], r["text"] or "") for r in rows], corpus_pipeline.SHARDS)
    got = results[5].select("shard", F.xxhash64(F.coalesce("text", F.lit(""))).alias("g")).collect()
    assert len(got) == len(rows) and all(r["shard"] in at[r["g"]] for r in got)


def test_very_long_text(spark):
    """A text of a quarter of a million words goes through all stages whole."""
    long = " ".join(f"long{i}x{i % 7}" for i in range(250_000))
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), *[(i, " ".join(f"d{i}w{k}" for k in range(40)), "en", "a", 200) for i in range(2, 12)]], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, out, SF), name)
    assert {r["text"] for r in out.filter("doc_id = 1").collect()} <= {long} and out.filter("doc_id > 1").count() >= 10


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, extra columns and empty tables go through all stages."""
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(1, text, "en", "a", 9, "x"), (1, text, "en", "a", 9, "x"), (None, None, None, None, None, None), (None, text + " more", None, None, None, None), (3, "", "en", "a", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for start, want in ((docs, [text, text, text + " more"]), (docs.limit(0), [])):
        out = start
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, out, SF), name)
        assert sorted(r["text"] for r in out.collect()) == want
