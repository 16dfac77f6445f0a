"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm import chat, clusters, decontaminate, langid, licenses, lines, mixing, quality, ranking, sharding, simhash, tokens, warc
from specweave.llm.common import WORD, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = lines.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), id_col="doc_id")
    return clean.select("doc_id", "n_lines", "n_dropped", F.crc32(F.coalesce("clean_text", F.lit(""))).alias("clean_crc32"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = warc.read_archives(spark, path, with_payload=False)
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: a folder for each source and two levels below, by the hash of the
    id; texts of up to 60 words stand for licence files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    hashed = F.md5(F.col("doc_id").cast("string"))
    name = F.when(F.regexp_count("text", F.lit(WORD)) <= 60, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.withColumn("path", F.concat_ws("/", "source", F.substring(hashed, 1, 1), F.substring(hashed, 2, 1), name))
    return licenses.license_scan(files, keep_text=False).select("doc_id", "path", "own_license", F.col("cosine"), "license", "inherited_from")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), with_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokens.load_vocabulary(tokens.default_vocabulary_path())
    return tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "n_pretokens", "n_tokens")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, mixing.cyclic_weights(docs), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24, keep_text=False)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(ranking.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, of id -1, whose texts hold the template's marks."""
    marks = chat.END + chat.START + "assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    return chat.digests(chat.windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_counts": op7_token_counts,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_ranked_search": op11_ranked_search,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_chat_formatting": op13_chat_formatting,
}

#: Words and windows one by one; quantiles of log-linear bins by language and source, language, all.
OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM docs)
), twice AS (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice GROUP BY doc_id),
base AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (doc_id)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
m AS (
  SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'long_words', 'short_words', 'n_words']) AS rule,
    unnest([n_symbols * 1000 // greatest(n_words, 1), n_dup_lines * 1000 // greatest(n_words, 1), n_repeat_words * 1000 // greatest(n_words, 1),
      word_chars * 100 // greatest(n_words, 1), word_chars * 100 // greatest(n_words, 1), n_words]) AS v,
    unnest([1, 1, 6, NULL, NULL, NULL]) AS least, unnest([true, true, true, true, false, true]) AS upper
  FROM judged
), binned AS (SELECT *, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) AS b FROM m WHERE NOT base_failed),
sketch AS (
  SELECT lang, source, rule, upper, least, grouping(lang, source) AS level, count(*) AS n, list_sort(list(b)) AS bs
  FROM binned GROUP BY GROUPING SETS ((lang, source, rule, upper, least), (lang, rule, upper, least), (rule, upper, least))
), q AS (
  SELECT *, bs[(n * 10 + 99) // 100] AS q10, bs[(n * 25 + 99) // 100] AS q25, bs[(n * 50 + 99) // 100] AS q50, bs[(n * 75 + 99) // 100] AS q75, bs[(n * 90 + 99) // 100] AS q90,
    greatest(max(CASE WHEN rule = 'n_words' THEN bs[(n * 25 + 99) // 100] END) OVER (PARTITION BY level, lang, source), 1) AS short FROM sketch
), s AS (
  SELECT *, CASE WHEN least IS NULL THEN q50 / 2.0::DOUBLE / sqrt(short) ELSE least * 1000.0::DOUBLE / short END AS unit, CASE WHEN upper THEN q75 ELSE q25 END AS o1, CASE WHEN upper THEN q90 ELSE q10 END AS o2 FROM q WHERE rule <> 'n_words'
), t AS (
  SELECT *, greatest(abs(q50 - CASE WHEN upper THEN q25 ELSE q75 END)::DOUBLE, unit) AS s0, greatest(abs(o1 - q50)::DOUBLE, unit) AS s1, greatest(abs(o2 - o1)::DOUBLE, unit) AS s2 FROM s
), f AS (
  SELECT lang, source, rule, level, n, CASE WHEN s1 > 4 * s0 THEN q50 ELSE CASE WHEN s2 > 4 * greatest(s0, s1) THEN o1 ELSE o2 END END
    + CASE WHEN s1 > 4 * s0 THEN s0 ELSE CASE WHEN s2 > 4 * greatest(s0, s1) THEN s1 ELSE s2 END END * CASE WHEN upper THEN 4 ELSE -4 END AS fence FROM t
),
fences AS (
  SELECT a.lang, a.source, a.rule, coalesce((a.n * a.fence + 20.0::DOUBLE * coalesce((l.n * l.fence + 20.0::DOUBLE * g.fence) / (l.n + 20), g.fence)) / (a.n + 20),
    coalesce((l.n * l.fence + 20.0::DOUBLE * g.fence) / (l.n + 20), g.fence)) AS fence
  FROM f a JOIN f l ON l.level = 1 AND a.rule = l.rule AND a.lang IS NOT DISTINCT FROM l.lang JOIN f g ON g.level = 3 AND a.rule = g.rule WHERE a.level = 0
), verdict AS (
  SELECT m.doc_id, bool_or(coalesce(CASE WHEN upper THEN v > fence ELSE v < fence END, false)) AS failed
  FROM m LEFT JOIN fences q ON m.rule = q.rule AND m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source
  GROUP BY m.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept
FROM judged JOIN verdict USING (doc_id)
"""

#: Base 32: five bytes of the hash at a time, eight digits each.
_FIVE = "('0x' || substr(h, {at}, 10))::BIGINT"
_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_FIVE.format(at=five * 10 + 1)} >> {shift}) & 31)::INT + 1, 1)" for five in range(4) for shift in range(35, -1, -5))
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, {_DIGITS} AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
"""

OP6_SQL = r"""
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), wins AS (
  SELECT DISTINCT id AS item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM (SELECT id, w, least(10, len(w)) AS k FROM low WHERE kind = 'b' AND len(w) > 0))
), sizes AS (SELECT DISTINCT k FROM wins),
dwin AS (
  SELECT id AS doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM low, sizes WHERE kind = 'd' AND len(w) >= k)
), found AS (SELECT d.doc_id, d.k, d.i, b.item_id FROM dwin d JOIN wins b ON d.k = b.k AND d.win = b.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM found)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY 1)
SELECT l.id AS doc_id, coalesce(len(l.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low l LEFT JOIN hits h ON l.id = h.doc_id LEFT JOIN items i ON l.id = i.doc_id WHERE l.kind = 'd'
"""

#: Unit of weight by the sources' order of cap to weight; documents by md5 of seed and id.
OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS place
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1)::INT % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), steps AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS n, source_size * 2.0::DOUBLE AS cap, (SELECT sum(source_size) * 1.5::DOUBLE FROM totals) AS budget,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM totals
), unit AS (SELECT arg_min((budget - fixed) / left_weight, n) AS u FROM steps WHERE weight * ((budget - fixed) / left_weight) <= cap),
goal AS (
  SELECT source, source_size, CASE WHEN u IS NULL OR weight * u > cap THEN cap ELSE weight * u END AS target
  FROM steps, unit
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goal
), run AS (
  SELECT s.*, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS room,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
), gaps AS (
  SELECT *, room - coalesce(max(CASE WHEN upto <= room THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM run
), last AS (
  SELECT source, arg_min(place, struct_pack(off := abs(size - gap), place := place)) AS also
  FROM gaps WHERE upto > room AND size > 0 AND abs(size - gap) < gap GROUP BY source
)
SELECT g.doc_id, g.size, g.source_size, g.target,
  (CASE WHEN g.size > 0 THEN (g.whole + CASE WHEN g.upto <= g.room OR g.place = l.also THEN 1 ELSE 0 END) * g.size ELSE 0 END)::BIGINT AS taken
FROM gaps g LEFT JOIN last l ON g.source IS NOT DISTINCT FROM l.source
"""

#: Terms of all documents one by one.
OP11_SQL = r"""
WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark
), docs AS (SELECT id AS doc_id, len(w)::BIGINT AS n, w FROM split WHERE kind = 'd' AND len(w) > 0),
stats AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS total FROM docs),
tf AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM docs) GROUP BY ALL),
asked AS (SELECT id AS item_id, t, count(*)::BIGINT AS q FROM (SELECT id, unnest(w) AS t FROM split WHERE kind = 'b') GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * (SELECT nd FROM stats) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY t),
scores AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // total))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weights USING (t), stats GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


def _op12_sql(k: int, rounds: int, seed: int) -> str:
    """Every distance in every round; sums and floors of whole numbers."""
    near = (
        "SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT vec_id, v, cluster, "
        "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{n}) GROUP BY ALL"
    )
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, v AS c FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        sums = f"SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, 65) AS r(i) GROUP BY ALL"
        steps.append(f"m{n} AS MATERIALIZED (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM ({sums}) GROUP BY cluster)")
        steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))")
    steps.append(f"found AS MATERIALIZED ({near.format(n=rounds)})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256 FROM found JOIN c{rounds} USING (cluster)"""


#: Windows by the running sums of the turns' tokens; only their lengths are needed beside the turns themselves.
_ESCAPED = r"regexp_replace({v}, '<(\\*)\|', '<\1\\|', 'g')"
OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS place,
    {chat.MARKS} + len(regexp_extract_all(text, '{chat.TOKEN}')) AS size,
    {len(chat.START) + len(chat.END) + 2} + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + length({_ESCAPED.format(v="text")}) AS chars
  FROM turns
), led AS (
  SELECT *, place = 0 AND role = 'system' AS leads, max(CASE WHEN place = 0 AND role = 'system' THEN size END) OVER (PARTITION BY conv_id) AS system_size,
    max(CASE WHEN place = 0 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS system_chars,
    greatest({chat.BUDGET - chat.HISTORY} - coalesce(max(CASE WHEN place = 0 AND role = 'system' THEN size END) OVER (PARTITION BY conv_id), 0), {chat.BUDGET // 4}) AS room
  FROM sized
), run AS (
  SELECT *, coalesce(sum(CASE WHEN leads THEN 0 ELSE size END) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, room * 3 // 4 AS stride FROM led
), chunked AS (SELECT *, place // {chat.CHUNK} AS chunk, before - min(before) OVER (PARTITION BY conv_id, place // {chat.CHUNK}) AS along FROM run),
placed AS (SELECT *, along // stride AS span, along > 0 AND along + size > (along // stride + 1) * stride AND size > room - stride AS alone FROM chunked),
wins AS (SELECT conv_id, chunk, span, alone, min(before) AS start, min(place) AS first_turn, sum(chars) AS chars, any_value(system_chars) AS system_chars FROM placed GROUP BY ALL),
again AS (
  SELECT w.conv_id, w.first_turn, sum(t.chars) AS chars FROM wins w JOIN run t ON w.conv_id = t.conv_id AND t.place < w.first_turn AND NOT t.leads AND t.before >= w.start - {chat.HISTORY} AND t.before < w.start GROUP BY ALL
), shown AS (
  SELECT w.conv_id, sum(w.chars + coalesce(a.chars, 0) + CASE WHEN w.first_turn > 0 THEN coalesce(w.system_chars, 0) ELSE 0 END)::BIGINT AS formatted_chars FROM wins w LEFT JOIN again a USING (conv_id, first_turn) GROUP BY ALL
), told AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '') AS loss
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM told JOIN shown USING (conv_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_decontaminate": OP6_SQL,
    "op9_mixing": OP9_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_centroid_clustering": _op12_sql(40, 5, 2),
    "op13_chat_formatting": OP13_SQL,
}
