"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import bpe, collocations, fertility, filteraudit, html, linededup, mixing, quality_cnn, sharding, simhash, suffixes, urlfilter, vectors

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_cnn.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality_cnn.held_out(F.col("doc_id")).alias("held_out"), quality_cnn.quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_curriculum_mix(spark, sf_dir):
    return mixing.plan_mix(table(spark, sf_dir, "documents")).drop("mark").orderBy(F.asc_nulls_last("position"), "doc_id")


def op3_url_templates(spark, sf_dir):
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op4_host_suffix_array(spark, sf_dir):
    return html.extract_text(table(spark, sf_dir, "pages"))


def op5_rendezvous(spark, sf_dir):
    return sharding.shard_records(table(spark, sf_dir, "documents"), SHARDS)


def op6_chunked_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, RANKS, PATTERN, with_ids=False).drop("text")


def op7_deletion_neighbourhood(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs)


def op8_rotation_codes(spark, sf_dir):
    return vectors.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op9_vantage_points(spark, sf_dir):
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_fertility(spark, sf_dir):
    return fertility.fertility_rules(table(spark, sf_dir, "documents"), PIECES, RANKS, PATTERN)


def op11_filter_audit(spark, sf_dir):
    return filteraudit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_sampled_suffixes(spark, sf_dir):
    found = suffixes.dedup_substrings(table(spark, sf_dir, "documents"), with_kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_phrase_rollup(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_cnn, op2_curriculum_mix, op3_url_templates, op4_host_suffix_array, op5_rendezvous,
        op6_chunked_bpe, op7_deletion_neighbourhood, op8_rotation_codes, op9_vantage_points, op10_fertility, op11_filter_audit,
        op12_sampled_suffixes, op13_phrase_rollup, pipeline,
    )
}

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s, substr(md5(coalesce(doc_id::VARCHAR, '\N' || md5(coalesce(text, '')))), 1, 8) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT s, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY s),
need AS (
  SELECT *, (3.0::DOUBLE * source_size) AS most FROM sources),
shared AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM need),
capped AS (SELECT *, share * weight > most AS c FROM shared),
goal AS (
  SELECT s, source_size, weight, CASE WHEN c THEN most ELSE weight * (SELECT arg_min(share, (most / weight, s)) FROM capped WHERE NOT c) END AS target FROM capped),
placed AS (
  SELECT doc_id, size, source_size, target, CASE weight WHEN 5 THEN 0.5 WHEN 1 THEN -0.5 ELSE 0 END::DOUBLE AS slope,
    coalesce(sum(size) OVER (PARTITION BY s ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized JOIN goal USING (s)),
passes AS (
  SELECT *, list_transform([0, 1, 2], lambda k: {'place': source_size * k + start, 'part': greatest(least(floor(target)::BIGINT - (source_size * k + start), size), 0)}) AS parts FROM placed),
timed AS (
  SELECT *, list_transform(list_filter(parts, lambda p: p.part > 0 AND 2 * p.part >= size), lambda p: CASE WHEN slope = 0 THEN p.place / target
    ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * (p.place / target), 0)) - (1 - slope)) / (2 * slope) END) AS positions FROM passes)
SELECT doc_id, size, source_size, target, list_sum(list_transform(parts, lambda p: p.part))::BIGINT AS taken, len(positions)::INT AS copies, positions[1] AS position, positions FROM timed
"""


def _draw(shards: int) -> str:
    bits = "(('0x' || substr(md5(k || ':' || x), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
    return f"list_min(list_transform(range({shards}), lambda x: {{'draw': -ln({bits}), 'shard': x::INT}})).shard"


#: One step of CRC-32 for each byte value, then over the text's bytes.
OP5_SQL = rf"""
WITH steps AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS b))),
own AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '\N') AS k, (coalesce(strlen(text), 0) + 16)::BIGINT AS size, hex(coalesce(text, '')) AS x FROM documents),
summed AS (
  SELECT doc_id, k, size, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))::BIGINT AS text_crc32 FROM own, steps),
drawn AS (SELECT *, {_draw(SHARDS)} AS shard, {_draw(SHARDS + 1)} AS grown_shard FROM summed)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, 3), k, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM drawn
"""

def _agree(side: str) -> str:
    """How far two lines agree from an end, by characters or, with {k} the number, by words."""
    powers = ", ".join(str(1 << k) for k in range(20, -1, -1))
    return f"list_reduce([0, {powers}], lambda p, k: CASE WHEN p + k <= least(a.n, b.n) AND {side.format(x='a', k='(p + k)::BIGINT')} = {side.format(x='b', k='(p + k)::BIGINT')} THEN p + k ELSE p END)"


#: Pairs of lines that agree in a half of their characters or words, told apart by how far they agree from both ends.
OP7_SQL = rf"""
WITH each AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
firsts AS (SELECT line, length(line) AS n, min((doc_id, no)) AS pos FROM each WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
halves AS (SELECT *, unnest([m || 'r' || right(line, (m - (m + 1) // 2)::BIGINT), m || 'l' || left(line, ((m + 1) // 2)::BIGINT)]) AS h FROM (SELECT *, unnest([n, n + 1]) AS m FROM firsts)),
worded AS (SELECT line, pos, w, len(w) AS n FROM (SELECT line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM firsts) WHERE len(w) >= 8),
word_halves AS (SELECT *, unnest([m || 'r' || array_to_string(w[n - m + (m + 1) // 2 + 1:], ' '), m || 'l' || array_to_string(w[1:(m + 1) // 2], ' ')]) AS h FROM (SELECT *, unnest([n, n + 1]) AS m FROM worded)),
gone AS (
  SELECT a.line FROM halves a JOIN halves b ON a.h = b.h AND b.pos < a.pos WHERE {_agree("left({x}.line, {k})")} + {_agree("right({x}.line, {k})")} >= greatest(a.n, b.n) - 1
  UNION SELECT a.line FROM word_halves a JOIN word_halves b ON a.h = b.h AND b.pos < a.pos
  WHERE {_agree("{x}.w[1:{k}]")} + {_agree("{x}.w[{x}.n - {k} + 1:]")} >= greatest(a.n, b.n) - 1),
stay AS (SELECT pos FROM firsts ANTI JOIN gone USING (line)),
marked AS (
  SELECT e.doc_id, e.no, e.line, regexp_matches(e.line, '[^\x20\x09-\x0D]') AS worded, (e.doc_id, e.no) IN (SELECT pos FROM stay) AS stays FROM each e)
SELECT doc_id, coalesce(array_to_string(list(line ORDER BY no) FILTER (stays OR NOT worded), chr(10)), '') AS text,
  count(*) FILTER (worded)::BIGINT AS n_lines, count(*) FILTER (worded AND NOT stays)::BIGINT AS n_removed
FROM marked GROUP BY doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON node = vec_id LEFT JOIN counts ON a = vec_id
"""

OP11_SQL = r"""
WITH own AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM own LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, s AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)),
counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM counted
"""

OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM places, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT lang, phrase, a, arg_min({'l': l, 'r': r, 'score': score}, (score, k)) AS x FROM scored GROUP BY ALL),
around AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(w[b:b + 1], ' ') AS phrase FROM candidates, (SELECT unnest([1, 2]) AS b) WHERE m = 3) GROUP BY ALL),
left_over AS (SELECT t.lang, t.phrase, t.a, x.l, x.r, x.score FROM lowest t LEFT JOIN around o ON o.lang = t.lang AND o.phrase = t.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * t.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op2_curriculum_mix": OP2_SQL, "op5_rendezvous": OP5_SQL, "op7_deletion_neighbourhood": OP7_SQL, "op8_rotation_codes": OP8_SQL, "op11_filter_audit": OP11_SQL, "op13_phrase_rollup": OP13_SQL}
