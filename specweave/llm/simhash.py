"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has 64 bits; two link when at most ``max_bits`` of them differ.
Cut a fingerprint into m segments on a ring. If two fingerprints differ in at most t
bits, then from at least one segment every chain of l consecutive segments holds at most
l*t/m differences (the pigeonring principle). The budget of the first segment is 0
when m > t, so such a start is identical in both, and the budgets of the following ones
force further identical segments. `ring_keys` lists segment sets of which every linked
pair shares one; pairs that share one are pruned by the chains, then by the full
Hamming distance.

Only different fingerprints are compared, and no bucket is expanded into all its pairs:

1. Each member of a bucket is compared with the bucket's smallest member.
2. Those links are joined into components.
3. Where a bucket of three or more still spans several components, the members
   outside the component that is most frequent there are compared with the members of
   the other components. Pairs of one component need no comparison: they are already
   connected. If over DENSE members are outside, only members of equal pieces are paired: two members of
   a bucket that link differ in at most max_bits of the bits outside
   the bucket's key, so of max_bits + 1 pieces of those bits they share one.

So each component is exact, while a large group of near copies costs a few rows a member, and
unrelated members of a bucket meet only as far as pieces of theirs are equal by chance.

Fingerprints of texts that share 0.8 of their shingles mostly differ in more bits than
max_bits. With ``percent`` a second route is added: texts that share one of BANDS bands of
BAND minimum hashes are candidates, taken from their buckets in the same steps, and two
link if the exact Jaccard similarity of their sets of shingles reaches percent. A pair
at 0.8 shares a band with probability 0.998. Buckets of very many texts that are alike, but
not enough, as pages of one template are, are settled by prefixes of their sets (`prefixes_of`).

Joins are `shuffled`: keys are up to some hundred rows a fingerprint, and stored members repeat their pivots and
sketches, both of which Spark sizes far too low for a broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.common import boxed, components, hot_keys, lookup, quoted, shuffled, stored, unboxed

SEED = 42
#: Segments of the longest chain that is tested; the one of all segments is the Hamming distance itself.
CHAIN = 3
#: Key rows of a task and of a batch.
KEY_ROWS, KEY_BATCH = 2_000_000, 200_000
BANDS, BAND = 20, 6
#: Lowest bits of 64 minimum hashes: of pairs at 0.8, about 6 differ; over 18 in none to speak of.
SKETCH_BITS = 18
#: Minimum hashes of a wide sketch, made only of sets whose buckets the pivots leave in several
#: components. Of pairs at a similarity j, (1 - j) / 2 of their lowest bits differ on average.
WIDE = 2048
WIDE_FACTORS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of a bucket of sets that all others are compared with first.
PIVOTS = 4
#: Members outside a bucket's top component that are compared with all its members.
DENSE = 256
#: Odd factors, one a minimum hash.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a text. A-Z are lower-cased, shingles are joined by a space."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, dtype="<u8")
    joined, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= shingle:
        return np.array([digest(joined, seed)], dtype="<u8")
    ends = list(accumulate(map(len, own), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[: len(own) - shingle]]]
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=True)], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; of none, 0."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None, shingle: int, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned number."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprint(text: Column, shingle: int, seed: int = SEED) -> Column:
    """`fingerprint_of` over a column, as a (signed) long; null has that of no words, 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle, seed) for t in texts], dtype=np.uint64).astype(np.int64))

    return of(text)


def sketch_of(text: str | None, shingle: int, seed: int = SEED) -> tuple[int, bytes | None, int, int, list[int]]:
    """(fingerprint, 128-bit digest of the set of shingles, its size, sketch bits, band keys), signed."""
    h = shingle_hashes(text, shingle, seed)
    own = np.unique(h)
    if not len(own):
        return 0, None, 0, 0, []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(own), 512):
        least = np.minimum(least, np.multiply.outer(own[i : i + 512], FACTORS).min(axis=0))
    bits = np.packbits(((least[:64] >> np.uint64(17)) & np.uint64(1)).astype(np.uint8)).view("<u8")[0]
    keys = [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, BAND))]
    signed = np.array([majority(h), int(bits), *keys], dtype=np.uint64).astype(np.int64).tolist()
    return signed[0], xxhash.xxh3_128_digest(own.tobytes(), seed), len(own), signed[1], signed[2:]


def sketch(text: Column, shingle: int, seed: int = SEED) -> Column:
    """`sketch_of` over a column."""

    @F.pandas_udf("fp long, shingles binary, size long, bits long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch_of(t, shingle, seed) for t in texts], columns=["fp", "shingles", "size", "bits", "bands"])

    return of(text)


def shingle_set(text: Column, shingle: int, seed: int = SEED) -> Column:
    """The different hashes of a text's shingles."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle, seed)).astype(np.int64) for t in texts], dtype=object)

    return of(text)


def ring_keys(segments: int, max_bits: int, equal: int) -> list[tuple[int, ...]]:
    """Sets of ``equal`` segments such that two fingerprints within max_bits share one.

    For each way to spread the differences over the segments, the chain from a viable
    start meets identical segments; the first ``equal`` of them make a set.
    """
    if segments - max_bits < equal:
        raise ValueError("too few segments are identical for certain")
    sets: dict[tuple[int, ...], None] = {}
    for wrong in combinations(range(segments), max_bits):  # fewer wrong segments leave more identical
        if not any(set(have).isdisjoint(wrong) for have in sets):
            counts = [int(s in wrong) for s in range(segments)]
            start = next(i for i in range(segments) if all(sum(counts[(i + j) % segments] for j in range(n)) * segments <= n * max_bits for n in range(1, segments + 1)))
            ring = [(start + j) % segments for j in range(segments)]
            sets[tuple(sorted([s for s in ring if s not in wrong][:equal]))] = None
    return list(sets)


def cuts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment of 64 bits."""
    widths = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return list(zip([0, *accumulate(widths)][:-1], widths, strict=True))


def shape(fingerprints: int, max_bits: int) -> tuple[int, int]:
    """(segments, identical ones in a key) for a number of different fingerprints: keys get
    as many bits as that number needs, and 20 at least, so that a bucket holds few
    unrelated fingerprints at any size."""
    for equal in range(2, 64 - max_bits):
        segments = equal + max_bits
        bits = 64 * equal // segments
        if bits >= 20 and (fingerprints <= 1 << bits or bits >= 32):
            return segments, equal
    raise ValueError("max_bits is too large")


def in_ring(differs: Column, segments: int, max_bits: int, chain: int = CHAIN) -> Column:
    """True if, from some segment on, the chains of up to ``chain`` segments keep their proportional budgets."""
    ones = [F.bit_count(F.shiftrightunsigned(differs, s).bitwiseAND(F.lit((1 << w) - 1))) for s, w in cuts(segments)]
    viable = F.lit(False)
    for start in range(segments):
        at = [ones[(start + n) % segments] for n in range(min(chain, segments))]
        viable = viable | reduce(lambda a, b: a & b, [reduce(lambda a, b: a + b, at[: n + 1]) <= (n + 1) * max_bits // segments for n in range(len(at))])
    return viable


def linked(a: Column, b: Column, segments: int, max_bits: int) -> Column:
    """The pigeonring filter, then the full Hamming check."""
    return in_ring(a.bitwiseXOR(b), segments, max_bits) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)


def ring_rows(prints: DataFrame, sets: list[tuple[int, ...]], segments: int) -> DataFrame:
    """A row for each fingerprint and set of segments: ``fp``, ``number`` of the set and ``key``, the
    bits of its segments behind that number."""
    at, rows = cuts(segments), max(1, KEY_BATCH // len(sets))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for first in range(0, len(every), rows):
                fp = every[first : first + rows]
                keys = np.empty((len(sets), len(fp)), dtype=np.uint64)
                for number, chosen in enumerate(sets):
                    keys[number] = number
                    for s in chosen:
                        keys[number] = keys[number] << np.uint64(at[s][1]) | fp >> np.uint64(at[s][0]) & np.uint64((1 << at[s][1]) - 1)
                numbers = np.repeat(np.arange(len(sets), dtype=np.int32), len(fp))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(fp, len(sets)).view(np.int64)), pa.array(numbers), pa.array(keys.reshape(-1).view(np.int64))], names=["fp", "number", "key"])

    return prints.select("fp").mapInArrow(spread, "fp long, number int, key long")


def outer_pieces(fp: str, number: str, sets: list[tuple[int, ...]], segments: int, max_bits: int) -> Column:
    """The max_bits + 1 pieces, each with its place, of the bits of a fingerprint that are not in
    its key, that of the segments ``sets[number]``."""
    at = cuts(segments)

    @F.pandas_udf("array<long>")
    def of(fps: pd.Series, numbers: pd.Series) -> pd.Series:
        prints, which = fps.to_numpy().astype(np.int64).view(np.uint64), numbers.to_numpy()
        out = np.zeros((len(prints), max_bits + 1), dtype=np.int64)
        for n in np.unique(which):
            own, left, bits = prints[which == n], np.zeros(int((which == n).sum()), dtype=np.uint64), 0
            for shift, width in (at[s] for s in range(segments) if s not in sets[n]):
                left |= (own >> np.uint64(shift) & np.uint64((1 << width) - 1)) << np.uint64(bits)
                bits += width
            edges = [bits * i // (max_bits + 1) for i in range(max_bits + 2)]
            for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                out[which == n, i] = (left >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)).astype(np.int64) * (max_bits + 1) + i
        return pd.Series(list(out))

    return of(F.col(fp), F.col(number))


def fingerprint_components(prints: DataFrame, max_bits: int = 4, known: DataFrame | None = None) -> DataFrame:
    """prints: a stored table of different longs ``fp``; known: further links ``a``, ``b``
    between them. Returns ``node``, ``root`` for each fingerprint that links to another one, root being
    one of its component."""
    rows = prints.count()
    segments, equal = shape(rows, max_bits)
    sets = ring_keys(segments, max_bits, equal)
    # A fingerprint becomes as many rows as there are keys; no task makes more than some KEY_ROWS.
    keyed = ring_rows(prints.repartition(max(1, -(-rows * len(sets) // KEY_ROWS)), "fp"), sets, segments)
    buckets = stored(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("pivot")).filter("n > 1").withColumnRenamed("key", "bucket"), "buckets")
    # A bucket of two is settled by comparing both; those of three or more keep all members.
    star = (F.col("fp") != F.col("pivot")) & linked(F.col("fp"), F.col("pivot"), segments, max_bits)
    members = stored(keyed.join(shuffled(buckets), (F.col("key") == F.col("bucket")) & ((F.col("n") > 2) | star)).select("key", "number", "fp", "n", "pivot"), "members")
    stars = stored(members.filter(star).select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    found = components(stars if known is None else stars.union(known.select("a", "b")))

    labelled = members.filter("n > 2").select("key", "number", "fp").join(shuffled(found.withColumnRenamed("node", "fp")), "fp", "left").select("key", "number", "fp", F.coalesce("root", "fp").alias("root"))
    labelled = stored(labelled, "labelled")
    shares = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), (F.sum("n") - F.max("n")).alias("outside")).filter("roots > 1")
    mixed = stored(mixed.select("key", "top", (F.col("outside") > DENSE).alias("dense")), "mixed")
    rest = stored(labelled.join(shuffled(mixed), "key"), "rest")

    def apart(rows: DataFrame, *on: str) -> DataFrame:
        a, b = rows.filter("root <> top").alias("a"), shuffled(rows).alias("b")
        same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
        return a.join(b, same & (F.col("a.root") != F.col("b.root")) & linked(F.col("a.fp"), F.col("b.fp"), segments, max_bits)).select(F.col("a.root").alias("a"), F.col("b.root").alias("b"))

    pieces = rest.filter("dense").select("key", "fp", "root", "top", F.explode(outer_pieces("fp", "number", sets, segments, max_bits)).alias("piece"))
    more = stored(apart(rest.filter("not dense"), "key").union(apart(stored(pieces, "pieces"), "key", "piece")).distinct(), "more")
    if more.limit(1).count() == 0:
        return found
    # The components so far are the nodes of the second graph.
    over = components(more).select(F.col("node").alias("root"), F.col("root").alias("over"))
    alone = over.join(shuffled(found), "root", "left_anti").select(F.col("root").alias("node"), F.col("over").alias("root"))
    return stored(found.join(shuffled(over), "root", "left").select("node", F.coalesce("over", "root").alias("root")).union(alone), "roots")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, seed: int, percent: int | None) -> DataFrame:
    """A row for each row of docs: ``id``, ``hash`` of the text, ``fp``, and ``first``: the
    id and hash of the first row of its component, by id (null last), then by hash."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    if percent is None:
        rows = stored(docs.select(quoted(id_col).alias("id"), F.xxhash64(text).alias("hash"), fingerprint(quoted(text_col), shingle, seed).alias("fp")), "prints")
    else:
        rows = stored(docs.select(quoted(id_col).alias("id"), F.xxhash64(text).alias("hash"), sketch(quoted(text_col), shingle, seed).alias("s")).select("id", "hash", "s.*"), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash")).alias("first")
    prints = stored(rows.groupBy("fp").agg(first, F.count("*").alias("n")), "different")
    similar = None if percent is None else similar_edges(rows, docs.select(F.struct(F.xxhash64(text).alias("hash"), quoted(id_col).alias("id")).alias("at"), text.alias("text")), shingle, percent)
    found = fingerprint_components(prints.select("fp"), max_bits, similar)
    roots = stored(prints.join(shuffled(found.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = stored(roots.groupBy("root").agg(F.min("first").alias("first")), "least")
    large = hot_keys(roots.groupBy("root").agg(F.count("*").alias("n")), "root", roots.count())
    by_print = stored(lookup(roots.select("fp", "n", "root"), shuffled(least), "root", large).select("fp", "n", "first"), "by_print")
    return lookup(rows.select("id", "hash", "fp"), shuffled(by_print.select("fp", "first")), "fp", hot_keys(by_print, "fp", rows.count()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = 4, seed: int = SEED, percent: int | None = None) -> DataFrame:
    """One row per row of docs: the id, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id`` (the smallest id that links reach, itself included). With percent,
    texts whose sets of shingles have that Jaccard similarity link as well.

    Null and empty texts have fingerprint 0 and link like any other; texts of any length are
    taken whole. A null id takes part in links but is never the smallest; of ids that are
    all null the component is null. Repeated rows give repeated rows. Other columns of docs,
    whatever their names, are not read. An empty table gives an empty one.
    """
    rows = grouped(docs, id_col, text_col, shingle, max_bits, seed, percent)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def wide_sketch(own: Column) -> Column:
    """The lowest bits of WIDE minimum hashes of a set, as longs."""

    @F.pandas_udf("array<long>")
    def of(sets: pd.Series) -> pd.Series:
        out = []
        for hashes in sets:
            h = np.asarray(hashes).astype(np.int64).view(np.uint64)
            least = np.full(WIDE, np.iinfo(np.uint64).max, dtype=np.uint64)
            for i in range(0, len(h), 256):
                least = np.minimum(least, np.multiply.outer(h[i : i + 256], WIDE_FACTORS).min(axis=0))
            out.append(np.packbits(((least >> np.uint64(17)) & np.uint64(1)).astype(np.uint8)).view("<i8"))
        return pd.Series(out, dtype=object)

    return of(own)


def own_sets(wanted: DataFrame, texts: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """wanted (different ``shingles``) with ``own``, the hashes themselves. texts has ``at`` (text hash and id) and
    ``text``; sets names one row for each set, so that of many copies one is read."""
    at = wanted.join(shuffled(sets), "shingles").select("shingles", F.col("at").alias("first"))
    found = texts.join(shuffled(at), F.col("at").eqNullSafe(F.col("first"))).groupBy("shingles").agg(F.any_value("text").alias("text"))
    return stored(found.select("shingles", shingle_set(F.col("text"), shingle).alias("own")), "shingle_sets")


def confirmed(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The rows ``a``, ``b`` of pairs (digests of sets) whose Jaccard similarity reaches percent."""
    x, y = own.select(F.col("shingles").alias("a"), F.col("own").alias("x")), own.select(F.col("shingles").alias("b"), F.col("own").alias("y"))
    both = pairs.join(shuffled(x), "a").join(shuffled(y), "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
    return stored(both.filter(F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent).select("a", "b"), "confirmed")


def _near(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be alike by their sizes and are so by their sketch bits."""
    sizes = F.least(f"{a}.size", f"{b}.size") * 100 >= F.greatest(f"{a}.size", f"{b}.size") * percent
    return sizes & (F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) <= SKETCH_BITS)


def fewer_links(links: DataFrame) -> DataFrame:
    """links of members ``a`` with pivots ``b`` by fewer that join the same sets: each member with its smallest
    pivot, and that one with the member's others. A member has PIVOTS links a band at most."""
    own = links.groupBy("a").agg(F.min("b").alias("first"), F.collect_set("b").alias("others"))
    between = own.select(F.col("first").alias("a"), F.explode("others").alias("b")).filter("a <> b")
    return stored(own.select("a", F.col("first").alias("b")).union(between).distinct(), "links")


def wide_bits(percent: int) -> int:
    """Differing bits of wide sketches up to which pairs are verified: those that pairs at percent have, and
    four and a half standard deviations."""
    share = (100 - percent) / 200
    return math.ceil(WIDE * share + 4.5 * math.sqrt(WIDE * share * (1 - share)))


def apart_pairs(rest: DataFrame, prefixes: DataFrame | None, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of sets in the same bucket (``key``), of different components, one of
    them outside the top component, and alike by their wide sketches. Without prefixes all such pairs; with them
    those that share a ``token`` of both prefixes."""
    rows, on = (rest, ["key"]) if prefixes is None else (prefixes, ["key", "token"])
    x = rows.filter("root <> top").select(*on, F.col("m").alias("v"), F.col("root").alias("r"), F.col("wide").alias("s"))
    y = rows.select(*[F.col(c).alias(f"{c}_") for c in on], F.col("m").alias("w"), "root", F.col("wide").alias("t"))
    same = F.expr(" and ".join(f"{c} = {c}_" for c in on))
    far = reduce(lambda a, b: a + b, [F.bit_count(F.col("s")[i].bitwiseXOR(F.col("t")[i])) for i in range(WIDE // 64)])
    found = x.join(shuffled(y), same & (F.col("r") != F.col("root")) & _near("v", "w", percent) & (far <= wide_bits(percent)))
    return found.select(F.least("v.shingles", "w.shingles").alias("a"), F.greatest("v.shingles", "w.shingles").alias("b")).distinct()  # a pair may come both ways round


def prefixes_of(rest: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """A row for each member of a bucket and each ``token`` of its prefix. In the order of their frequency in the
    bucket, two sets of the similarity share one of their first tokens: of the n of a set, the first n - ceil(n
    * percent / 100) + 1. What very many members share, as pages of one template do, comes last and leads to no pairs."""
    tokens = rest.select("key", "m").join(shuffled(own.select(F.col("shingles").alias("set"), "own")), F.col("m.shingles") == F.col("set")).select("key", "m", F.explode("own").alias("token"))
    counted = tokens.withColumn("n", F.count("*").over(Window.partitionBy("key", "token")))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("key", "m").orderBy("n", "token")))
    first = F.col("m.size") - F.ceil(F.col("m.size") * percent / 100) + 1
    some = placed.filter(F.col("place") <= first).select(F.col("key").alias("of"), F.col("m.shingles").alias("set"), "token")
    return stored(some.join(shuffled(rest), (F.col("of") == F.col("key")) & (F.col("set") == F.col("m.shingles"))).select("key", "token", "m", "root", "top", "wide"), "prefixes")


def similar_edges(rows: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """rows: a stored table of `sketch` with ``id`` and ``hash``, that of the text. Returns ``a``, ``b``:
    fingerprints to be linked since sets of shingles are alike; buckets are settled as by
    `fingerprint_components`. A bucket with more than DENSE members outside its top component is
    settled by the prefixes of its sets where that compares fewer, so that the pairs of unlike members don't
    grow with the square."""
    sets = rows.filter("size > 0").groupBy("shingles").agg(F.min("fp").alias("fp"), F.min(F.struct("hash", "id")).alias("at"), F.min("size").alias("size"), F.min("bits").alias("bits"), F.min("bands").alias("bands"))
    sets = stored(sets, "sets")
    node = F.struct("shingles", "size", "bits")
    keyed = sets.select(node.alias("m"), F.explode("bands").alias("key"))
    # Each bucket has pivots of its own, so that a group which shares many buckets is tied together by many of them.
    pivots = [F.min(F.struct(F.xxhash64("key", "m.shingles", F.lit(n)).alias("h"), "m"))["m"] for n in range(PIVOTS)]
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*pivots)).alias("pivots")).filter("n > 1").withColumnRenamed("key", "bucket")
    members = stored(keyed.join(shuffled(stored(buckets, "set_buckets")), F.col("key") == F.col("bucket")).select("key", "m", "n", "pivots"), "set_members")
    stars = members.select("m", F.explode("pivots").alias("pivot")).filter((F.col("m.shingles") != F.col("pivot.shingles")) & _near("m", "pivot", percent))
    stars = stored(stars.select(F.col("m.shingles").alias("a"), F.col("pivot.shingles").alias("b")).distinct(), "set_stars")
    first = fewer_links(confirmed(stars, own_sets(stars.select(F.explode(F.array("a", "b")).alias("shingles")).distinct(), texts, sets, shingle), percent))
    found = components(first).withColumnRenamed("node", "shingles")
    labelled = members.filter("n > 2").select("key", "m", F.col("m.shingles").alias("shingles")).join(shuffled(found), "shingles", "left")
    labelled = stored(labelled.select("key", "m", F.coalesce("root", "shingles").alias("root")), "set_labelled")
    shares = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), (F.sum("n") - F.max("n")).alias("outside")).filter("roots > 1")
    # Stored, so that Spark can split a large bucket in the join.
    mixed = stored(mixed.select(F.col("key").alias("bucket"), "top", (F.col("outside") > DENSE).alias("dense")), "set_mixed")
    rest = stored(labelled.join(shuffled(mixed), F.col("key") == F.col("bucket")).select("key", "m", "root", "top", "dense"), "set_rest")
    own = own_sets(rest.select("m.shingles").distinct(), texts, sets, shingle)
    wide = stored(own.select(F.col("shingles").alias("set"), wide_sketch(F.col("own")).alias("wide")), "wide")
    rest = stored(rest.join(shuffled(wide), F.col("m.shingles") == F.col("set")).drop("set"), "sketched")
    dense = rest.filter("dense")
    apart = apart_pairs(rest.filter("not dense"), None, percent)
    if dense.limit(1).count():
        prefixes = prefixes_of(dense, own, percent)
        outside = F.count_if(F.col("root") != F.col("top"))
        by_token = prefixes.groupBy("key", "token").agg((F.count("*") * outside).alias("n")).groupBy(F.col("key").alias("of")).agg(F.sum("n").alias("by_token"))
        cheap = dense.groupBy(F.col("key").alias("bucket")).agg((F.count("*") * outside).alias("by_pair")).join(shuffled(by_token), F.col("bucket") == F.col("of")).filter("by_token < by_pair").select("bucket")
        cheap, of = shuffled(stored(cheap, "by_prefix")), F.col("key") == F.col("bucket")
        apart = apart.union(apart_pairs(dense.join(cheap, of, "left_anti"), None, percent)).union(apart_pairs(dense, prefixes.join(cheap, of, "left_semi"), percent)).distinct()
    more = confirmed(stored(apart, "set_pairs"), own, percent)
    prints = shuffled(sets.select("shingles", "fp"))
    at = lambda c: prints.select(F.col("shingles").alias(c), F.col("fp").alias(f"fp_{c}"))
    alike = first.union(more).join(at("a"), "a").join(at("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    # Equal sets may have several fingerprints, as these count repeated shingles.
    equal = rows.select("shingles", F.col("fp").alias("a")).distinct().join(prints, "shingles").filter("a <> fp").select("a", F.col("fp").alias("b"))
    return stored(alike.union(equal).distinct(), "similar")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = 4, percent: int | None = None) -> DataFrame:
    """docs with one document of each component: that of the smallest id, and of the
    smallest text hash where the id repeats.

    Rows are told apart by id and text, so other texts of an id that goes stay. Rows whose id
    is null all stay. Of rows that repeat an id and a text one stays. The texts are shuffled once,
    by id and text hash, against the rows that go; columns and their names stay as they are.
    """
    rows = grouped(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col, shingle, max_bits, SEED, percent)
    gone = rows.filter(F.col("id").isNotNull() & ~F.struct("id", "hash").eqNullSafe(F.struct("first.id", "first.hash"))).select("id", "hash").distinct()
    box = boxed(docs, id=quoted(id_col), hash=F.xxhash64(F.coalesce(quoted(text_col), F.lit(""))))
    left = box.join(shuffled(stored(gone, "gone")), ["id", "hash"], "left_anti")
    marked = left.withColumn("copy", F.when(F.col("id").isNull(), F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(0)))))
    return unboxed(marked.filter("copy = 1"))
