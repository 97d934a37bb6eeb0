"""Registered queries over the media catalog, with the DuckDB SQL of each."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import hashes, paths, tags
from lumenlake.operators import clusters, many, rewrite, search, stats, sync
from lumenlake.operators.tables import materialise, shared_dir
from lumenlake.plans.catalog import CATALOG, EVENTS, HASHED, LISTING, ROOTS, catalog, change_events, hidden_tags, journal, listing, roots, table
from lumenlake.sources import files, store
from lumenlake.streaming import changes

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return put


def on_catalog(select: str, base: str = CATALOG) -> str:
    recursive = "RECURSIVE " if "reach" in select else ""
    return f"WITH {recursive}{base}{'' if select.lstrip().startswith('SELECT') else ','} {select}"


LISTED = ["path", "name", "media_kind", "size_bytes"]


# -- projections and scalar functions


@query(on_catalog("SELECT path, regexp_extract(path, '^(.*)/', 1) AS dir, name, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM catalog"))
def path_parts(spark, sf_dir):
    return catalog(spark, sf_dir).select("path", paths.path_parts(F.col("path")).alias("p")).select("path", "p.*")


@query(on_catalog("SELECT path, media_kind FROM catalog"))
def media_kind(spark, sf_dir):
    return catalog(spark, sf_dir).select("path", "media_kind")


@query(on_catalog("SELECT path, CASE media_kind WHEN 'video' THEN 'video/mp4' WHEN 'audio' THEN 'audio/mpeg' ELSE '' END AS content_type FROM catalog"))
def content_type(spark, sf_dir):
    return catalog(spark, sf_dir).select("path", paths.content_type(F.col("path")).alias("content_type"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 2 THEN ts ELSE date_trunc('second', ts) END AS t FROM events")
def parse_creation_time(spark, sf_dir):
    """All layouts: with Z, with a blank, with a fraction, with an offset."""
    own, n = table(spark, sf_dir, "events"), F.col("event_id") % 4
    later = F.concat(F.date_format(F.timestamp_add("HOUR", F.lit(2), F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    text = F.when(n == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    text = text.when(n == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(later)
    return own.select("event_id", paths.parse_creation_time(text).alias("t"))


@query("SELECT p_partkey, 'part:' || replace(lower(p_name), ' ', '-') AS slug FROM part")
def tag_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tags.tag_slug("part", F.col("p_name")).alias("slug"))


@query(on_catalog("SELECT path, auto_tags FROM catalog WHERE media_kind <> 'audio'"))
def photo_auto_tags(spark, sf_dir):
    return catalog(spark, sf_dir).where("media_kind <> 'audio'").select("path", "auto_tags")


@query(on_catalog("SELECT path, auto_tags FROM catalog WHERE media_kind = 'audio'"))
def audio_auto_tags(spark, sf_dir):
    return catalog(spark, sf_dir).where("media_kind = 'audio'").select("path", "auto_tags")


WORDS = "list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
f AS (SELECT doc_id, w, min(i) AS i FROM w WHERE w <> 'untagged' GROUP BY doc_id, w), t AS (SELECT doc_id, list(w ORDER BY i) AS tags FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(tags, []) AS tags FROM documents LEFT JOIN t USING (doc_id)""")
def normalize_tags(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    return own.select("doc_id", tags.normalize_tags(F.split("text", "[ \n]")).alias("tags"))


@query(f"SELECT doc_id, {WORDS} AS tokens FROM documents")
def tokenize_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tags.tokenize_query(F.col("text")).alias("tokens"))


@query(on_catalog("SELECT path, phash FROM hashed", HASHED))
def dhash64(spark, sf_dir):
    return catalog(spark, sf_dir, phash=True).select("path", "phash")


@query("""
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: (floor(x::DOUBLE * 1000000)::BIGINT & 4294967295)::BIGINT) AS v FROM embeddings)
SELECT vec_id, (CASE WHEN hi >= 2147483648 THEN hi - 4294967296 ELSE hi END * 4294967296 + lo)::BIGINT AS phash FROM (
  SELECT vec_id, list_reduce([v[i] FOR i IN range(10, 41, 2)], lambda a, b: xor(a, b)) AS hi, list_reduce([v[i] FOR i IN range(9, 41, 2)], lambda a, b: xor(a, b)) AS lo FROM n)
""")
def audio_fold64(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    text = F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000000).cast("string")), ",")
    return own.select("vec_id", hashes.audio_fold64(text).alias("phash"))


@query(on_catalog("SELECT a.path, bit_count(xor(a.phash, b.phash))::INT AS dist FROM hashed a JOIN hashed b ON b.doc_id = a.doc_id + 1", HASHED))
def hamming64(spark, sf_dir):
    own = materialise(catalog(spark, sf_dir, phash=True).select("doc_id", "path", "phash"), "media")
    after = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("phash").alias("b"))
    return own.join(after, "doc_id").select("path", hashes.hamming64(F.col("phash"), F.col("b")).alias("dist"))


@query(on_catalog("SELECT path, flash % 2 = 1 AS fired FROM catalog"))
def flash_fired(spark, sf_dir):
    return catalog(spark, sf_dir).select("path", tags.flash_fired(F.col("flash")).alias("fired"))


@query("SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(n / 1073741824.0 * 10 + 0.5) / 10) END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS n FROM orders)")
def human_size(spark, sf_dir):
    n = F.col("o_orderkey").cast("long") * F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", paths.human_size(n).alias("size"))


#: Four 60-bit pieces of each path's checksum, joined by exclusive or.
PRINT = "sha256(concat_ws(':', count(*)" + "".join(f", bit_xor(('0x' || substr(sha256(path), {1 + 15 * k}, 15))::BIGINT)" for k in range(4)) + "))"


@query(on_catalog(f"SELECT hash, {PRINT} AS fingerprint FROM catalog GROUP BY hash HAVING count(*) > 1"))
def cluster_fingerprint(spark, sf_dir):
    own = catalog(spark, sf_dir)
    found = clusters.fingerprints(clusters.exact_members(own).select("id", "path"))
    return found.select(F.substring("id", 7, 64).alias("hash"), "fingerprint")


FNV = "list_reduce(list_prepend(2166136261, list_transform(range(strlen({x})), lambda i: ('0x' || substr(hex({x}), 2 * i + 1, 2))::BIGINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296)"


@query(on_catalog("""
SELECT path, lpad(lower(printf('%x', u)), 16, '0') || '-' || lpad(lower(printf('%x', list_reduce(list_prepend(2166136261, list_transform(range(strlen(path)), lambda i: ('0x' || substr(hex(path), 2 * i + 1, 2))::BIGINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296))), 8, '0') AS id
FROM (SELECT path, (CASE WHEN phash < 0 THEN phash::HUGEINT + 18446744073709551616 ELSE phash END)::UBIGINT AS u FROM hashed)""", HASHED))
def cluster_id(spark, sf_dir):
    return catalog(spark, sf_dir, phash=True).select("path", hashes.cluster_id(F.col("phash"), F.col("path")).alias("id"))


# -- filters, search, order

PICK = "SELECT path, name, media_kind, size_bytes FROM catalog"


@query(on_catalog(f"{PICK} WHERE starts_with(path, '/lib/src1/')"))
def filter_folder(spark, sf_dir):
    return search.filter_folder(catalog(spark, sf_dir), "/lib/src1").select(*LISTED)


@query(on_catalog(f"{PICK} WHERE NOT list_contains(tags, 'hidden')"))
def exclude_hidden(spark, sf_dir):
    return search.exclude_hidden(catalog(spark, sf_dir)).select(*LISTED)


@query(on_catalog(f"{PICK} WHERE len(tags) = 0"))
def filter_untagged(spark, sf_dir):
    return search.filter_untagged(catalog(spark, sf_dir)).select(*LISTED)


@query(on_catalog(f"{PICK} WHERE (list_contains(tags, 'good') OR list_contains(auto_tags, 'good') OR contains(lower(name), 'good')) OR (list_contains(tags, 'iso:low') OR list_contains(auto_tags, 'iso:low') OR contains(lower(name), 'iso:low'))"))
def match_tokens(spark, sf_dir):
    return search.match_tokens(catalog(spark, sf_dir), ["good", "iso:low"], "any").select(*LISTED)


@query(on_catalog("""SELECT path, name, taken_at, row_number() OVER (ORDER BY taken_at DESC NULLS FIRST, path DESC) - 1 AS pos FROM catalog
WHERE starts_with(path, '/lib/src1/') AND NOT list_contains(tags, 'hidden') AND list_contains(tags, 'good') AND list_contains(auto_tags, 'kind:photo')"""))
def search_media(spark, sf_dir):
    found = search.search_media(catalog(spark, sf_dir), "kind:photo good", "/lib/src1", "date", True)
    return search.with_position(found, search.sort_order("date", True)).select("path", "name", "taken_at", "pos")


for _key, _column in search.SORT_KEYS.items():
    for _desc in (False, True):
        _way, _nulls = ("DESC", "FIRST") if _desc else ("ASC", "LAST")

        @query(on_catalog(f"SELECT path, name, media_kind, hash, size_bytes, mod_time, taken_at, row_number() OVER (ORDER BY {_column} {_way} NULLS {_nulls}, path {_way}) - 1 AS pos FROM catalog"), name=f"sort_media_{_key}_{_way.lower()}")
        def sort_media(spark, sf_dir, key=_key, desc=_desc):
            return search.with_position(catalog(spark, sf_dir), search.sort_order(key, desc)).select("path", "name", "media_kind", "hash", "size_bytes", "mod_time", "taken_at", "pos")


@query(on_catalog("SELECT k.path, c.name, c.path IS NOT NULL AS found FROM (SELECT path FROM listing) k LEFT JOIN catalog c ON c.path = k.path", LISTING))
def get_media(spark, sf_dir):
    return search.get_media(catalog(spark, sf_dir), listing(spark, sf_dir).select("path")).select("path", "name", "found")


STATS = """hidden AS (SELECT unnest(['junk', 'ghost']) AS name),
user_tags AS (SELECT t AS name, count(*) AS n FROM (SELECT unnest(tags) AS t FROM catalog) GROUP BY t),
auto AS (SELECT t AS name, count(*) AS n FROM (SELECT unnest(auto_tags) AS t FROM catalog) GROUP BY t),
tag_stats AS (SELECT 'untagged' AS name, count(*) FILTER (len(tags) = 0) AS count, 'system' AS kind, false AS hidden FROM catalog
  UNION ALL SELECT coalesce(u.name, h.name), coalesce(n, 0), 'user', h.name IS NOT NULL FROM user_tags u FULL JOIN hidden h USING (name)
  UNION ALL SELECT name, n, 'auto', false FROM auto)"""


def _stats(spark, sf_dir):
    return stats.tag_stats(catalog(spark, sf_dir), hidden_tags(spark, sf_dir), True, True)


@query(on_catalog(STATS + " SELECT * FROM tag_stats"))
def tag_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(on_catalog(STATS + " SELECT * FROM tag_stats WHERE contains(name, 'canon')"))
def filter_tag_names(spark, sf_dir):
    return search.filter_tag_names(_stats(spark, sf_dir), " Canon ")


def fuzzy(q: str, text: str) -> str:
    """The score of q, in lower case, against the column text: a fold over its letters that carries how many of q are hit."""
    hit = f"(a.qi < length({q}) AND x.c = substr({q}, a.qi + 1, 1))"
    run = f"CASE WHEN {hit} THEN CASE WHEN a.hit THEN a.run + 1 ELSE 0 END ELSE a.run END"
    place = "CASE WHEN x.p = '' THEN 4 WHEN regexp_matches(x.p, '[\\s\\-_./]') THEN 2 ELSE 0 END"
    start = "'qi': 0, 'score': 0, 'run': 0, 'hit': false"
    letters = f"list_transform(range(1, length({text}) + 1), lambda i: {{'c': lower({text})[i], 'p': CASE WHEN i = 1 THEN '' ELSE lower({text})[i - 1] END, {start}}})"
    step = f"{{'c': x.c, 'p': x.p, 'qi': a.qi + {hit}::INT, 'score': a.score + CASE WHEN {hit} THEN 1 + {place} + ({run}) ELSE 0 END, 'run': {run}, 'hit': {hit}}}"
    end = f"list_reduce(list_prepend({{'c': '', 'p': '', {start}}}, {letters}), lambda a, x: {step})"
    return f"list_transform([{end}], lambda e: CASE WHEN e.qi = length({q}) THEN e.score - length({text}) * 0.01::DOUBLE END)[1]"


@query(on_catalog(STATS + f" SELECT * FROM (SELECT name, max(count)::BIGINT AS count, {fuzzy("'can'", 'name')} AS score FROM tag_stats WHERE kind <> 'system' AND name <> 'camera:canon' GROUP BY name) WHERE score IS NOT NULL ORDER BY score DESC, name LIMIT 8"))
def suggest_tags(spark, sf_dir):
    return search.suggest_tags(_stats(spark, sf_dir), "can", ["camera:canon"])


PART_QUERIES = "SELECT p_partkey AS query_id, lower(substr(p_name, 1 + p_partkey % 3, 1 + p_partkey % 4)) AS q, CASE WHEN p_partkey % 3 = 0 THEN ['kind:photo', 'year:2019'] WHEN p_partkey % 3 = 1 THEN [] END AS chosen FROM part"


@query(on_catalog(STATS + f""", asked AS ({PART_QUERIES}), v AS (SELECT name, max(count)::BIGINT AS count FROM tag_stats WHERE kind <> 'system' GROUP BY name),
scored AS (SELECT q, name, count, CASE WHEN q = '' THEN 0 ELSE {fuzzy('q', 'name')} END AS score FROM (SELECT DISTINCT q FROM asked), v),
ranked AS (SELECT query_id, name, count, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name)::INT AS rank FROM asked JOIN scored USING (q) WHERE score IS NOT NULL AND (chosen IS NULL OR NOT list_contains(chosen, name)))
SELECT query_id, rank, name, count, score FROM ranked WHERE rank <= 8"""))
def suggest_many(spark, sf_dir):
    n = F.col("p_partkey")
    chosen = F.when(n % 3 == 0, F.array(F.lit("kind:photo"), F.lit("year:2019"))).when(n % 3 == 1, F.array().cast("array<string>"))
    asked = table(spark, sf_dir, "part").select(n.alias("query_id"), F.substring(F.col("p_name"), (1 + n % 3).cast("int"), (1 + n % 4).cast("int")).alias("q"), chosen.alias("chosen"))
    return many.suggest_many(_stats(spark, sf_dir), asked)


TOKENS = ["good", "IMG", "_9", "doc_1", "iso:low", ".mp", "7", "untagged", "hidden", "kind:audio", ".JPG", "oc_4", "junk"]


@query(on_catalog(f"""asked AS (SELECT s_suppkey AS query_id, lower({TOKENS}[s_suppkey % 13 + 1]) AS a, CASE WHEN s_suppkey % 4 > 0 THEN lower({TOKENS}[s_suppkey * 5 % 11 + 1]) END AS b, s_suppkey % 2 = 0 AS every FROM supplier),
hit AS (SELECT query_id, every, a, b, c.path, c.tags, list_contains(tags, a) OR list_contains(auto_tags, a) OR contains(lower(name), a) AS x, list_contains(tags, b) OR list_contains(auto_tags, b) OR contains(lower(name), b) AS y FROM asked, catalog c)
SELECT query_id, path FROM hit WHERE (len(tags) = 0 OR (a <> 'untagged' AND coalesce(b, '') <> 'untagged')) AND (NOT list_contains(tags, 'hidden') OR a = 'hidden' OR b = 'hidden')
AND CASE WHEN a = 'untagged' THEN b IS NULL OR b = 'untagged' OR y WHEN b IS NULL OR b = 'untagged' THEN x WHEN every THEN x AND y ELSE x OR y END"""))
def search_many(spark, sf_dir):
    n = F.col("s_suppkey")
    word = lambda i: F.element_at(F.array(*map(F.lit, TOKENS)), (i + 1).cast("int"))
    q = F.concat_ws("  ", word(n % 13), F.when(n % 4 > 0, word(n * 5 % 11)))
    asked = table(spark, sf_dir, "supplier").select(n.alias("query_id"), q.alias("q"), F.when(n % 2 == 0, "all").otherwise("any").alias("match"))
    return many.search_many(catalog(spark, sf_dir), asked)


@query(on_catalog(f"SELECT path, {fuzzy("'doc1'", 'name')} AS score FROM catalog"))
def fuzzy_score(spark, sf_dir):
    return catalog(spark, sf_dir).select("path", tags.fuzzy_score("doc1", F.col("name")).alias("score"))


@query(on_catalog("p AS (SELECT path, row_number() OVER (ORDER BY name, path) - 1 AS pos FROM catalog), e AS (SELECT min(pos) AS a, max(pos) AS b FROM p WHERE path LIKE '%/doc\\_10.%' ESCAPE '\\' OR path LIKE '%/doc\\_50.%' ESCAPE '\\') SELECT path, pos FROM p, e WHERE pos BETWEEN a AND b"))
def select_range(spark, sf_dir):
    own = materialise(search.with_position(catalog(spark, sf_dir), search.sort_order("name")).select("path", "pos"), "positions")
    a, b = [x.path for x in own.where(F.col("path").rlike("/doc_(10|50)\\.")).orderBy("path").take(2)]  # two rows
    return search.select_range(own, b, a)


# -- aggregates


@query(on_catalog("""parts AS (SELECT string_split(path, '/') AS p FROM catalog WHERE media_kind <> 'audio'),
up AS (SELECT CASE WHEN i = 1 THEN '/' ELSE array_to_string(p[1:i], '/') END AS path, i = len(p) - 1 AS own FROM (SELECT p, unnest(range(1, len(p))) AS i FROM parts)),
node AS (SELECT path, count(*) FILTER (own) AS count, count(*) AS total FROM up GROUP BY path)
SELECT path, CASE WHEN path = '/' THEN '' WHEN path = '/lib' THEN '/' ELSE regexp_extract(path, '^(.*)/', 1) END AS parent, CASE WHEN path = '/' THEN '/' ELSE string_split(path, '/')[-1] END AS name, count, total FROM node"""))
def folder_tree(spark, sf_dir):
    return stats.folder_tree(catalog(spark, sf_dir))


UNTAGGED = "u AS (SELECT regexp_extract(path, '^(.*)/', 1) AS folder, path, name FROM catalog WHERE len(tags) = 0)"


@query(on_catalog(UNTAGGED + " SELECT folder, path, name, count(*) OVER (PARTITION BY folder) AS count FROM u"))
def untagged_by_folder(spark, sf_dir):
    return stats.untagged_by_folder(catalog(spark, sf_dir))


EXACT = "e AS (SELECT 'exact-' || hash AS id, count(*) AS size, count(*) FILTER (len(tags) = 0) AS untagged, min(path) AS first FROM catalog GROUP BY hash HAVING count(*) > 1)"


@query(on_catalog(EXACT + " SELECT * FROM e"))
def exact_clusters(spark, sf_dir):
    return clusters.exact_clusters(catalog(spark, sf_dir))


@query(on_catalog(EXACT + " SELECT count(*) AS clusters, sum(size)::BIGINT AS members, sum(size - 1)::BIGINT AS extras, (SELECT sum(size_bytes)::BIGINT FROM catalog c JOIN e ON 'exact-' || c.hash = e.id WHERE c.path <> e.first) AS reclaim_bytes FROM e"))
def reclaim_summary(spark, sf_dir):
    own = catalog(spark, sf_dir)
    return stats.reclaim_summary(clusters.exact_clusters(own), clusters.exact_members(own))


@query(on_catalog(EXACT + " SELECT id, path, CASE WHEN path = first THEN 'keep' ELSE 'extra' END AS role FROM catalog JOIN e ON 'exact-' || hash = id"))
def keeper_and_extras(spark, sf_dir):
    return clusters.keeper_and_extras(clusters.exact_members(catalog(spark, sf_dir)))


@query(on_catalog(EXACT + " SELECT * FROM e WHERE untagged > 0"))
def clusters_needing_tags(spark, sf_dir):
    return clusters.clusters_needing_tags(clusters.exact_clusters(catalog(spark, sf_dir)))


@query(on_catalog(EXACT + " SELECT * FROM e WHERE size >= 3"))
def clusters_min_size(spark, sf_dir):
    return clusters.clusters_min_size(clusters.exact_clusters(catalog(spark, sf_dir)), 3)


@query(on_catalog(EXACT + " SELECT * FROM (SELECT *, row_number() OVER (ORDER BY size DESC, id) - 1 AS pos FROM e WHERE size >= 2) WHERE pos BETWEEN 10 AND 19"))
def clusters_min_size__page(spark, sf_dir):
    return clusters.clusters_min_size(clusters.exact_clusters(catalog(spark, sf_dir)), 2, 1, 10)


PRINTS = EXACT + f", f AS (SELECT 'exact-' || hash AS id, {PRINT} AS fingerprint, min(doc_id) AS d FROM catalog GROUP BY hash HAVING count(*) > 1)"


def _dismissed(own):
    members = clusters.exact_members(own)
    even = own.withColumn("id", F.concat(F.lit("exact-"), "hash")).groupBy("id").agg(F.min("doc_id").alias("d")).where("d % 2 = 0").select("id")
    return clusters.fingerprints(members.select("id", "path")).join(even, "id", "left_semi").select("fingerprint")


@query(on_catalog(PRINTS + " SELECT e.* FROM e JOIN f USING (id) WHERE d % 2 <> 0"))
def drop_dismissed(spark, sf_dir):
    own = catalog(spark, sf_dir)
    return clusters.drop_dismissed(clusters.exact_clusters(own), clusters.exact_members(own), _dismissed(own))


@query(on_catalog(PRINTS + " SELECT DISTINCT fingerprint FROM f"))
def dismiss_cluster(spark, sf_dir):
    own = catalog(spark, sf_dir)
    return clusters.dismiss(_dismissed(own), clusters.exact_members(own).select("id", "path"))


@query(on_catalog(PRINTS + " SELECT DISTINCT fingerprint FROM f WHERE d % 2 <> 0"))
def undismiss_cluster(spark, sf_dir):
    own = catalog(spark, sf_dir)
    every = clusters.dismiss(_dismissed(own), clusters.exact_members(own).select("id", "path"))
    return clusters.undismiss(every, _dismissed(own))


def labels(t: int, x: str = "") -> str:
    """Tables d, pairs, m (rows with the smallest hash g of their group) and named (groups of two or more), names with x behind."""
    return f"""d{x} AS (SELECT DISTINCT CASE WHEN media_kind = 'audio' THEN 'audio' ELSE 'photo' END AS kind, phash FROM hashed WHERE phash <> 0),
pairs{x} AS (SELECT a.kind, a.phash AS a, b.phash AS b, bit_count(xor(a.phash, b.phash))::INT AS dist FROM d{x} a JOIN d{x} b ON a.kind = b.kind AND a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= {t}),
sides{x} AS (SELECT kind, a, b FROM pairs{x} UNION SELECT kind, b, a FROM pairs{x}),
reach{x} AS (SELECT kind, phash AS node, phash AS other FROM d{x} UNION SELECT r.kind, r.node, p.b FROM reach{x} r JOIN sides{x} p ON p.kind = r.kind AND p.a = r.other),
label{x} AS (SELECT kind, node, min((CASE WHEN other < 0 THEN other::HUGEINT + 18446744073709551616 ELSE other END)::UBIGINT) AS g FROM reach{x} GROUP BY kind, node),
m{x} AS (SELECT l.kind, g, path, tags, auto_tags, size_bytes FROM hashed JOIN label{x} l ON node = phash AND l.kind = CASE WHEN media_kind = 'audio' THEN 'audio' ELSE 'photo' END),
c{x} AS (SELECT kind, g, count(*) AS size, count(*) FILTER (len(tags) = 0) AS untagged, min(path) AS first FROM m{x} GROUP BY kind, g HAVING count(*) > 1),
named{x} AS (SELECT *, lpad(lower(printf('%x', g)), 16, '0') || '-' || lpad(lower(printf('%x', {FNV.format(x="first")})), 8, '0') AS id FROM c{x})"""


def _hashed(spark, sf_dir):
    return materialise(catalog(spark, sf_dir, phash=True), "media")


for _name, _t in (("near_pairs", 5), ("near_pairs_wide", 12)):

    @query(on_catalog(labels(_t) + " SELECT * FROM pairs", HASHED), name=_name)
    def near_pairs(spark, sf_dir, t=_t):
        return clusters.near_pairs(_hashed(spark, sf_dir), t)


for _name, _t in (("duplicate_clusters", 5), ("similar_clusters", 12)):

    @query(on_catalog(labels(_t) + " SELECT id, size, untagged, first FROM named", HASHED), name=_name)
    def near_clusters(spark, sf_dir, t=_t):
        return clusters.near_clusters(_hashed(spark, sf_dir), t)


@query(on_catalog(labels(5) + " SELECT id, path, size_bytes, path = first AS keep FROM m JOIN named USING (kind, g)", HASHED))
def duplicate_clusters__members(spark, sf_dir):
    return clusters.near_members(_hashed(spark, sf_dir))


@query(on_catalog(labels(5) + ", " + labels(12, "w") + """, pick AS (SELECT path FROM m JOIN named USING (kind, g) WHERE id = (SELECT min(id) FROM named)),
wide AS (SELECT id, path FROM mw JOIN namedw USING (kind, g)),
scope AS (SELECT path FROM pick UNION SELECT path FROM wide WHERE id IN (SELECT id FROM wide WHERE path IN (SELECT path FROM pick)))
SELECT path, CASE WHEN path IN (SELECT path FROM scope) THEN list_concat(tags, ['scoped']) ELSE tags END AS tags FROM hashed""", HASHED))
def apply_similar_scope(spark, sf_dir):
    own = _hashed(spark, sf_dir)
    duplicates, similar = (materialise(clusters.near_members(own, t), "members") for t in (clusters.DUPLICATE, clusters.SIMILAR))
    first = duplicates.agg(F.min("id")).first()[0]
    return clusters.apply_similar_scope(own, duplicates, similar, first, ["Scoped"])[0].select("path", "tags")


@query(on_catalog(labels(5) + " SELECT count(*) AS total, count(*) FILTER (len(tags) > 0) AS tagged, count(*) FILTER (len(tags) = 0) AS untagged, (SELECT max(untagged) FROM c) AS largest_untagged FROM catalog", HASHED))
def tagging_progress(spark, sf_dir):
    own = _hashed(spark, sf_dir)
    return stats.tagging_progress(own, clusters.near_clusters(own))


@query(on_catalog("s AS (SELECT * FROM catalog WHERE list_contains(tags, 'junk') AND media_kind = 'photo'), t AS (SELECT t, count(*) AS m FROM (SELECT unnest(tags) AS t FROM s) GROUP BY t), n AS (SELECT count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM s) SELECT t AS tag, n, bytes FROM n LEFT JOIN t ON m = n"))
def selection_summary(spark, sf_dir):
    return stats.selection_summary(catalog(spark, sf_dir).where(F.array_contains("tags", "junk") & (F.col("media_kind") == "photo")))


@query(on_catalog(STATS + " SELECT name, name IN (SELECT name FROM user_tags UNION ALL SELECT name FROM hidden) AS exists FROM (SELECT DISTINCT name FROM tag_stats)"))
def tag_exists(spark, sf_dir):
    return stats.tag_exists(catalog(spark, sf_dir), hidden_tags(spark, sf_dir), _stats(spark, sf_dir).select("name").distinct())


@query(on_catalog("SELECT media_kind, count(*) AS count FROM catalog GROUP BY media_kind"))
def media_count(spark, sf_dir):
    return stats.media_count(catalog(spark, sf_dir))


@query(on_catalog(UNTAGGED + ", s AS (SELECT folder, count(*) AS n, count(*) FILTER (ends_with(path, '.jpg')) AS k FROM u GROUP BY folder) SELECT folder, CASE WHEN k = 0 THEN 'none' WHEN k = n THEN 'all' ELSE 'some' END AS state FROM s"))
def folder_selection_state(spark, sf_dir):
    own = stats.untagged_by_folder(catalog(spark, sf_dir))
    return stats.folder_selection_state(own, own.where(F.col("path").endswith(".jpg")))


# -- joins, sync

CHANGES = """changed AS (SELECT coalesce(l.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'missing' WHEN l.size_bytes = c.size_bytes AND l.mod_time = c.mod_time THEN 'unchanged' ELSE 'changed' END AS status
FROM listing l FULL JOIN catalog c ON l.path = c.path)"""


@query(on_catalog(CHANGES + " SELECT * FROM changed", LISTING))
def detect_changes(spark, sf_dir):
    return sync.detect_changes(listing(spark, sf_dir), catalog(spark, sf_dir))


@query(on_catalog("SELECT c.path FROM catalog c WHERE NOT starts_with(c.path, '/lib/src1/') OR c.path IN (SELECT path FROM listing)", LISTING))
def prune_missing(spark, sf_dir):
    return sync.prune_missing(catalog(spark, sf_dir), listing(spark, sf_dir), "/lib/src1")[0].select("path")


@query(on_catalog("SELECT c.path FROM catalog c WHERE c.path NOT IN (SELECT path FROM listing)", LISTING))
def prune_missing__removed(spark, sf_dir):
    return sync.prune_missing(catalog(spark, sf_dir), listing(spark, sf_dir))[1]


@query(on_catalog("SELECT path FROM catalog WHERE regexp_matches(path, '^/lib/src[0-9]*[02468]/')"))
def covered_by_roots(spark, sf_dir):
    some = roots(spark, sf_dir).where("last_scanned_at IS NOT NULL")
    return sync.covered_by_roots(catalog(spark, sf_dir).select("path"), some)


@query("SELECT DISTINCT '/lib/' || source || x AS path FROM (SELECT source, unnest(['', '/' || lang]) AS x FROM documents) UNION SELECT DISTINCT '/lib/' || source || '/none/deep' FROM documents WHERE regexp_matches(source, '[02468]$')")
def covered_by_roots__media(spark, sf_dir):
    own = roots(spark, sf_dir)
    asked = own.select("path").union(own.select(F.concat("origin", F.lit("/none/deep")).alias("path"))).distinct()
    return sync.covered_by_roots(asked, own.where("last_scanned_at IS NOT NULL AND path = origin"), catalog(spark, sf_dir))


@query(on_catalog("SELECT path FROM catalog WHERE NOT starts_with(path, '/lib/src1/fr/')"))
def drop_ignored(spark, sf_dir):
    return sync.drop_ignored(catalog(spark, sf_dir).select("path"), roots(spark, sf_dir).where("path = '/lib/src1/fr'"))


@query(on_catalog("p AS (SELECT path, string_split(path, '/') AS p FROM listing) SELECT path FROM p WHERE NOT starts_with(path, '/lib/src1/') AND NOT list_contains(p, 'vendor')", LISTING))
def path_policy(spark, sf_dir):
    return sync.path_policy(listing(spark, sf_dir), ["/lib/src1"]).select("path")


@query("SELECT DISTINCT unnest(['/lib', '/lib/' || source, '/lib/' || source || '/' || lang]) AS dir FROM documents")
def discover_dirs(spark, sf_dir):
    return sync.discover_dirs(catalog(spark, sf_dir), "/lib")


@query(on_catalog(CHANGES + f", {ROOTS} SELECT r.path AS root, status, count(*) AS count FROM changed c JOIN roots r ON starts_with(c.path, r.path || '/') WHERE status <> 'missing' GROUP BY ALL", LISTING))
def scan_summary(spark, sf_dir):
    return sync.scan_summary(sync.detect_changes(listing(spark, sf_dir), catalog(spark, sf_dir)), roots(spark, sf_dir))


@query(f"WITH {EVENTS}, t AS (SELECT path, op, ts, event_id FROM (SELECT e.event_id, c.* FROM (SELECT row_number() OVER () AS r, event_id FROM events) e JOIN (SELECT row_number() OVER () AS r, * FROM change_events) c USING (r))) SELECT '/lib/src' || (user_id % 8) || '/en/u' || user_id || '.jpg' AS path, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_per_path(spark, sf_dir):
    own = journal(spark, sf_dir).select(F.concat(F.lit("/lib/src"), (F.col("id").cast("int") % 8).cast("string"), F.lit("/en/u"), "id", F.lit(".jpg")).alias("path"), F.col("seq").alias("event_id"), "state")
    return sync.latest_per_path(own, "event_id").select("path", "event_id")


@query(on_catalog("SELECT path, size_bytes FROM listing UNION ALL SELECT path, size_bytes FROM catalog WHERE path NOT IN (SELECT path FROM listing)", LISTING))
def additive_scan(spark, sf_dir):
    return sync.additive_scan(catalog(spark, sf_dir).select("path", "size_bytes"), listing(spark, sf_dir).select("path", "size_bytes"))


for _keep in (False, True):

    @query(on_catalog("SELECT c.path, l.size_bytes, CASE WHEN l.path IS NULL OR " + str(_keep).lower() + " THEN coalesce(tags, []) ELSE [] END AS tags, CASE WHEN l.path IS NULL THEN c.size_bytes END AS kept_size FROM catalog c LEFT JOIN listing l ON l.path = c.path UNION ALL SELECT path, size_bytes, [], NULL FROM listing WHERE path NOT IN (SELECT path FROM catalog)", LISTING), name="upsert_catalog" + "_preserving" * _keep)
    def upsert_catalog(spark, sf_dir, keep=_keep):
        own = catalog(spark, sf_dir).select("path", "tags", F.lit(None).cast("long").alias("size_bytes"), F.col("size_bytes").alias("kept_size"))
        built = listing(spark, sf_dir).select("path", "size_bytes", F.lit(None).cast("long").alias("kept_size"))
        return sync.upsert_catalog(own, built, keep)


@query(on_catalog("SELECT coalesce(l.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM listing l FULL JOIN catalog c ON l.path = c.path WHERE c.path IS NULL OR l.path IS NULL OR l.size_bytes <> c.size_bytes", LISTING))
def snapshot_diff(spark, sf_dir):
    return sync.snapshot_diff(catalog(spark, sf_dir).select("path", "size_bytes", "mod_time"), listing(spark, sf_dir))


@query(on_catalog("""o AS (SELECT doc_id, path, width, height, taken_at FROM catalog WHERE doc_id % 11 <> 0),
n AS (SELECT doc_id, path, CASE WHEN doc_id % 4 = 0 THEN height ELSE width END AS width, CASE WHEN doc_id % 4 = 0 THEN width ELSE height END AS height, CASE WHEN doc_id % 6 = 0 THEN mod_time ELSE taken_at END AS taken_at FROM catalog WHERE doc_id % 13 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path
WHERE o.path IS NULL OR n.path IS NULL OR o.width IS DISTINCT FROM n.width OR o.height IS DISTINCT FROM n.height OR o.taken_at IS DISTINCT FROM n.taken_at"""))
def snapshot_diff_nulls(spark, sf_dir):
    """Columns that are null in many rows, swapped with others, filled and emptied."""
    own = catalog(spark, sf_dir).select("doc_id", "path", "width", "height", "taken_at", "mod_time")
    swap, n = F.col("doc_id") % 4 == 0, F.col("doc_id")
    new = own.where(n % 13 != 0).select(
        "path", F.when(swap, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(swap, F.col("width")).otherwise(F.col("height")).alias("height"),
        F.when(n % 6 == 0, F.col("mod_time")).otherwise(F.col("taken_at")).alias("taken_at"),
    )
    return sync.snapshot_diff(own.where(n % 11 != 0).select("path", "width", "height", "taken_at"), new)


@query(on_catalog("SELECT CASE WHEN c.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS count FROM listing l FULL JOIN catalog c ON l.path = c.path WHERE c.path IS NULL OR l.path IS NULL OR l.size_bytes <> c.size_bytes GROUP BY 1", LISTING))
def snapshot_counts(spark, sf_dir):
    return sync.snapshot_counts(snapshot_diff(spark, sf_dir))


LAST = "last AS (SELECT * FROM journal QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1), pending AS (SELECT * FROM last WHERE state = 'pending')"


@query(f"WITH {EVENTS}, {LAST} SELECT id, kind, state, seq FROM pending")
def journal_pending(spark, sf_dir):
    return sync.journal_pending(journal(spark, sf_dir)).select("id", "kind", "state", "seq")


@query(f"""WITH {LISTING}, {EVENTS}, {LAST}, x AS (SELECT p.id, kind, p.old_path IN (SELECT path FROM listing) AS s, p.new_path IN (SELECT path FROM listing) AS d FROM pending p)
SELECT id, kind, CASE WHEN kind = 'restore' THEN 'skipped' WHEN kind = 'move' AND NOT s AND d THEN 'forwarded' WHEN kind = 'move' AND NOT s THEN 'skipped' WHEN s THEN 'rolled' WHEN kind = 'delete' THEN 'skipped' ELSE 'forwarded' END AS outcome,
 CASE WHEN kind = 'restore' THEN 'pending' WHEN kind = 'move' AND NOT s AND d THEN 'complete' WHEN kind = 'permanent-delete' AND NOT s THEN 'complete' ELSE 'failed' END AS state,
 CASE WHEN kind = 'restore' THEN 'none' WHEN kind = 'move' AND NOT s AND d THEN 'rename' WHEN s THEN 'none' ELSE 'remove' END AS catalog_action,
 CASE kind WHEN 'restore' THEN false WHEN 'move' THEN s OR NOT d WHEN 'delete' THEN true ELSE s END AS explained FROM x""")
def recovery_plan(spark, sf_dir):
    trash = catalog(spark, sf_dir).where("doc_id % 20 = 0").select(F.col("path").alias("original_path"))
    plan = sync.recovery_plan(sync.journal_pending(journal(spark, sf_dir)), listing(spark, sf_dir), trash)
    return plan.select("id", "kind", "outcome", "state", "catalog_action", F.col("message").isNotNull().alias("explained"))


@query(on_catalog("pending AS (SELECT path FROM catalog WHERE doc_id % 10 = 0) SELECT p.path, t.path IS NOT NULL AS in_trash FROM pending p LEFT JOIN (SELECT path FROM catalog WHERE doc_id % 20 = 0) t USING (path)"))
def trash_match(spark, sf_dir):
    own = catalog(spark, sf_dir)
    return sync.trash_match(own.where("doc_id % 10 = 0").select("path"), own.where("doc_id % 20 = 0").select(F.col("path").alias("original_path")))


@query(f"WITH {ROOTS} SELECT path, row_number() OVER (ORDER BY last_scanned_at ASC NULLS FIRST, path) - 1 AS pos FROM roots")
def rescan_order(spark, sf_dir):
    return sync.rescan_order(roots(spark, sf_dir)).select("path", "pos")


@query(on_catalog("SELECT sha256(path) AS id, mod_time + INTERVAL 1 DAY AS trashed_at, row_number() OVER (ORDER BY mod_time DESC, sha256(path)) - 1 AS pos FROM catalog WHERE doc_id % 20 = 1 AND path IN (SELECT path FROM listing)", LISTING))
def trash_list(spark, sf_dir):
    own = catalog(spark, sf_dir).where("doc_id % 20 IN (0, 1)")
    trash = own.select(F.sha2("path", 256).alias("id"), F.col("path").alias("trash_path"), F.timestamp_add("DAY", F.lit(1), F.col("mod_time")).alias("trashed_at"))
    return sync.trash_list(trash, listing(spark, sf_dir)).select("id", "trashed_at", "pos")


@query(f"WITH {ROOTS}, k AS (SELECT * FROM roots WHERE last_scanned_at IS NOT NULL) SELECT path, origin FROM k UNION ALL SELECT path, '/lib' FROM (SELECT DISTINCT path FROM roots WHERE last_scanned_at IS NULL UNION SELECT '/lib') WHERE NOT (path = '/lib/src1/fr' OR starts_with(path, '/lib/src1/fr/'))")
def upsert_roots(spark, sf_dir):
    own = roots(spark, sf_dir)
    ignored = own.where("path = '/lib/src1/fr'").select("path")
    return sync.upsert_roots(own.where("last_scanned_at IS NOT NULL"), ignored, "/lib", sync.discover_dirs(catalog(spark, sf_dir), "/lib").select(F.col("dir").alias("path")))[0].select("path", "origin")


@query(f"WITH {ROOTS} SELECT DISTINCT path FROM roots WHERE last_scanned_at IS NULL AND NOT (path = '/lib/src1/fr' OR starts_with(path, '/lib/src1/fr/')) UNION SELECT '/lib' FROM documents")
def upsert_roots__added(spark, sf_dir):
    own = roots(spark, sf_dir)
    return sync.upsert_roots(own.where("last_scanned_at IS NOT NULL"), own.where("path = '/lib/src1/fr'").select("path"), "/lib", sync.discover_dirs(catalog(spark, sf_dir), "/lib").select(F.col("dir").alias("path")))[1]


@query("SELECT DISTINCT '/lib/' || source || x AS path, '/lib/' || source AS origin FROM (SELECT source, unnest(['', '/' || lang]) AS x FROM documents)")
def decompose_roots(spark, sf_dir):
    whole = roots(spark, sf_dir).where("path = origin")
    return sync.decompose_roots(whole, catalog(spark, sf_dir)).select("path", "origin")


@query(f"WITH {ROOTS} SELECT path FROM roots WHERE path <> '/lib/src2' AND origin <> '/lib/src2'")
def remove_roots(spark, sf_dir):
    own = roots(spark, sf_dir)
    return sync.remove_roots(own, own.where("path = '/lib/src1/fr'"), "/lib/src2")[0].select("path")


@query(f"WITH {ROOTS} SELECT path, greatest(last_scanned_at, CASE WHEN origin = '/lib/src3' THEN TIMESTAMP '2025-01-01' END) AS last_scanned_at FROM roots")
def mark_scanned(spark, sf_dir):
    own = roots(spark, sf_dir)
    return sync.mark_scanned(own, own.where("origin = '/lib/src3'").select("path", F.to_timestamp(F.lit("2025-01-01 00:00:00")).alias("at"))).select("path", "last_scanned_at")


# -- rewrites


@query(on_catalog("SELECT path, CASE WHEN doc_id % 3 = 0 THEN ['new', 'two words'] ELSE tags END AS tags FROM catalog"))
def set_tags(spark, sf_dir):
    own = catalog(spark, sf_dir)
    return rewrite.set_tags(own, own.where("doc_id % 3 = 0").select("path", F.array(F.lit(" New"), F.lit("two words"), F.lit("NEW"), F.lit("Untagged")).alias("tags"))).select("path", "tags")


GAINED = "CASE WHEN {on} THEN list_concat(tags, list_filter(['good', 'extra'], lambda x: NOT list_contains(tags, x))) ELSE tags END"


@query(on_catalog(f"SELECT path, {GAINED.format(on='doc_id % 2 = 0')} AS tags FROM catalog"))
def add_tags(spark, sf_dir):
    own = catalog(spark, sf_dir)
    return rewrite.add_tags(own, own.where("doc_id % 2 = 0"), ["Good", "extra"])[0].select("path", "tags")


@query(on_catalog("SELECT count(*) FILTER (doc_id % 2 = 0) AS updated FROM catalog"))
def add_tags__counts(spark, sf_dir):
    own = catalog(spark, sf_dir)
    return rewrite.add_tags(own, own.where("doc_id % 2 = 0"), ["Good", "extra"])[1]


@query(on_catalog("SELECT count(*) FILTER (doc_id % 2 = 0 AND NOT list_contains(tags, 'good')) AS updated FROM catalog"))
def apply_tags_by_path(spark, sf_dir):
    own = catalog(spark, sf_dir)
    return rewrite.add_tags(own, own.where("doc_id % 2 = 0"), ["good"])[1]


@query(on_catalog(f"SELECT path, {GAINED.format(on=chr(39).join(['starts_with(path, ', '/lib/src1/', ')']))} AS tags FROM catalog"))
def add_tags_to_folder(spark, sf_dir):
    return rewrite.add_tags_to_folder(catalog(spark, sf_dir), "/lib/src1/", ["good", "extra"])[0].select("path", "tags")


RENAMED = "CASE WHEN list_contains(tags, 'hidden') AND list_contains(tags, 'good') THEN list_filter(tags, lambda x: x <> 'hidden') ELSE list_transform(tags, lambda x: CASE WHEN x = 'hidden' THEN 'good' ELSE x END) END"
RENAME_COUNTS = "SELECT count(*) FILTER (list_contains(tags, 'hidden') AND NOT list_contains(tags, 'good')) AS renamed, count(*) FILTER (list_contains(tags, 'hidden') AND list_contains(tags, 'good')) AS absorbed FROM catalog"


@query(on_catalog(f"SELECT path, {RENAMED} AS tags FROM catalog"))
def rename_tag(spark, sf_dir):
    return rewrite.rename_tag(catalog(spark, sf_dir), hidden_tags(spark, sf_dir), "Hidden", "good")[0].select("path", "tags")


@query(on_catalog(RENAME_COUNTS))
def rename_tag__counts(spark, sf_dir):
    return rewrite.rename_tag(catalog(spark, sf_dir), hidden_tags(spark, sf_dir), "Hidden", "good")[2]


@query(on_catalog(f"SELECT path, {RENAMED} AS tags FROM catalog"))
def merge_tags(spark, sf_dir):
    return rewrite.merge_tags(catalog(spark, sf_dir), hidden_tags(spark, sf_dir), "hidden", "good")[0].select("path", "tags")


@query("SELECT DISTINCT 'ghost' AS name FROM documents")
def merge_tags__hidden(spark, sf_dir):
    return rewrite.merge_tags(catalog(spark, sf_dir), hidden_tags(spark, sf_dir), "junk", "good")[1]


@query(on_catalog("SELECT path, list_filter(tags, lambda x: x <> 'junk') AS tags FROM catalog"))
def delete_tag(spark, sf_dir):
    return rewrite.delete_tag(catalog(spark, sf_dir), hidden_tags(spark, sf_dir), "junk")[0].select("path", "tags")


@query(on_catalog("SELECT count(*) FILTER (list_contains(tags, 'junk')) AS affected FROM catalog"))
def delete_tag__counts(spark, sf_dir):
    return rewrite.delete_tag(catalog(spark, sf_dir), hidden_tags(spark, sf_dir), "junk")[2]


@query("SELECT DISTINCT unnest(['ghost', 'good', 'junk']) AS name FROM documents")
def set_tag_hidden(spark, sf_dir):
    return rewrite.set_tag_hidden(catalog(spark, sf_dir), hidden_tags(spark, sf_dir), " Good", True)


@query(on_catalog("SELECT path FROM catalog WHERE NOT starts_with(path, '/lib/src1/')"))
def remove_folder(spark, sf_dir):
    return rewrite.remove_folder(catalog(spark, sf_dir), "/lib/src1")[0].select("path")


@query(on_catalog("SELECT path FROM catalog WHERE starts_with(path, '/lib/src1/')"))
def remove_folder__removed(spark, sf_dir):
    return rewrite.remove_folder(catalog(spark, sf_dir), "/lib/src1")[1]


def _moves(spark, sf_dir):
    own = catalog(spark, sf_dir)
    sources = own.where("doc_id % 4 = 0").select("path", F.col("doc_id").alias("seq")).union(listing(spark, sf_dir).where("path LIKE '/lib/new/%'").select("path", F.lit(-1).cast("long")))
    return rewrite.plan_moves(own, sources, "/lib/src1/en/")


@query(on_catalog("""s AS (SELECT path, name FROM catalog WHERE doc_id % 4 = 0) SELECT path, '/lib/src1/en/' || name NOT IN (SELECT path FROM catalog) AS success,
CASE WHEN '/lib/src1/en/' || name IN (SELECT path FROM catalog) THEN 'destination exists' END AS error, CASE WHEN '/lib/src1/en/' || name NOT IN (SELECT path FROM catalog) THEN '/lib/src1/en/' || name END AS new_path FROM s
UNION ALL SELECT path, false, 'not in catalog', NULL FROM listing WHERE path LIKE '/lib/new/%'""", LISTING))
def plan_moves(spark, sf_dir):
    return _moves(spark, sf_dir)[0]


@query(on_catalog("SELECT CASE WHEN doc_id % 4 = 0 AND '/lib/src1/en/' || name NOT IN (SELECT path FROM catalog) THEN '/lib/src1/en/' || name ELSE path END AS path FROM catalog"))
def plan_moves__catalog(spark, sf_dir):
    return _moves(spark, sf_dir)[1].select("path")


@query(on_catalog("SELECT count(*) FILTER (k AND '/lib/src1/en/' || name NOT IN (SELECT path FROM catalog)) AS succeeded, count(*) FILTER (NOT k OR '/lib/src1/en/' || name IN (SELECT path FROM catalog)) AS failed FROM (SELECT name, true AS k FROM catalog WHERE doc_id % 4 = 0 UNION ALL SELECT '', false FROM listing WHERE path LIKE '/lib/new/%')", LISTING))
def batch_outcome(spark, sf_dir):
    return stats.batch_outcome(_moves(spark, sf_dir)[0])


def _deletes(spark, sf_dir):
    return rewrite.plan_deletes(catalog(spark, sf_dir), listing(spark, sf_dir).select("path"))


@query(on_catalog("SELECT path, path IN (SELECT path FROM catalog) AS success, CASE WHEN path NOT IN (SELECT path FROM catalog) THEN 'not in catalog' END AS error FROM listing", LISTING))
def plan_deletes(spark, sf_dir):
    return _deletes(spark, sf_dir)[0]


@query(on_catalog("SELECT sha256(path) AS id, path AS original_path, hash FROM catalog WHERE path IN (SELECT path FROM listing)", LISTING))
def plan_deletes__trash(spark, sf_dir):
    return _deletes(spark, sf_dir)[2]


@query(on_catalog("SELECT path, name, hash, CASE WHEN path IN (SELECT path FROM listing) THEN NULL ELSE size_bytes END AS size_bytes FROM catalog", LISTING))
def plan_undo(spark, sf_dir):
    results, left, trash = _deletes(spark, sf_dir)
    undo = results.where("success").select(F.lit(1).alias("op_seq"), F.lit("delete").alias("kind"), F.col("path").alias("old_path"), F.lit(None).cast("string").alias("new_path"))
    return rewrite.plan_undo(left, undo, trash)[1].select("path", "name", "hash", "size_bytes")


#: Where each row is after each of six operations, as expressions that Spark and the oracle share. 1 and 2 move rows on,
#: 3 trashes some, 4 moves some back to where they began, 5 and 6 move every fourth row round by one place.
OPS = [
    ("move", "doc_id % 2 = 0", "concat('/one/', doc_id, '.jpg')"), ("move", "doc_id % 3 = 0", "concat('/two/', doc_id, '.jpg')"), ("delete", "doc_id % 5 = 0", "NULL"),
    ("move", "doc_id % 14 = 0 AND doc_id % 5 > 0", "path"), ("move", "doc_id % 4 = 1 AND doc_id % 5 > 0", "concat('/swap/', doc_id, '.jpg')"), ("move", "doc_id % 4 = 1 AND doc_id % 5 > 0", "around"),
]
AROUND = "lead(p4) OVER (PARTITION BY doc_id % 4, doc_id % 5 > 0, doc_id // 1000 ORDER BY doc_id)"


def _history() -> str:
    """The catalog with p0 ... p6, its paths after each operation, p3 on null for trashed rows."""
    out = "SELECT doc_id, path, name, hash, path AS p0 FROM catalog"
    for k, (_, where, to) in enumerate(OPS, 1):
        to = to if to != "around" else f"coalesce(around, p{k - 1})"
        out = f"SELECT *, CASE WHEN {where} THEN {to} ELSE p{k - 1} END AS p{k} FROM ({out})"
        if k == 4:
            out = f"SELECT *, {AROUND} AS around FROM ({out})"
    return out


UNDONE = f"""h AS ({_history()}),
undo AS ({' UNION ALL '.join(f"SELECT {k} AS op_seq, '{kind}' AS kind, p{k - 1} AS old_path, p{k} AS new_path FROM h WHERE {where}" for k, (kind, where, _) in enumerate(OPS, 1))}),
reach(doc_id, restored, p, t) AS (SELECT doc_id, false, p6, 99 FROM h WHERE p6 IS NOT NULL UNION ALL SELECT doc_id, true, p2, 3 FROM h WHERE p6 IS NULL AND {{k}} >= 4
  UNION ALL SELECT doc_id, restored, old_path, op_seq FROM (SELECT r.doc_id, r.restored, u.old_path, u.op_seq, row_number() OVER (PARTITION BY r.doc_id ORDER BY u.op_seq DESC) AS n FROM reach r JOIN undo u ON u.kind = 'move' AND u.op_seq > 6 - {{k}} AND u.new_path = r.p AND u.op_seq < r.t) WHERE n = 1)
SELECT p AS path, hash, restored FROM (SELECT doc_id, restored, arg_min(p, t) AS p FROM reach GROUP BY ALL) JOIN h USING (doc_id)"""


def _undo_table(spark, sf_dir):
    catalog(spark, sf_dir).createOrReplaceTempView("catalog")
    return materialise(spark.sql(_history().replace("//", "DIV")), "history")


for _k in (2, 4, 6):

    @query(on_catalog(UNDONE.format(k=_k)), name=f"plan_undo_{_k}")
    def plan_undo_many(spark, sf_dir, k=_k):
        rows = _undo_table(spark, sf_dir)
        each = [rows.where(where).select(F.lit(n).alias("op_seq"), F.lit(kind).alias("kind"), F.col(f"p{n - 1}").alias("old_path"), F.col(f"p{n}").cast("string").alias("new_path")) for n, (kind, where, _) in enumerate(OPS, 1)]
        undo = reduce(DataFrame.union, each)
        now = rows.where("p6 IS NOT NULL").select(F.col("p6").alias("path"), "name", "hash", F.lit(False).alias("restored"))
        trash = rows.where("p3 IS NULL").select(F.col("p2").alias("original_path"), "hash")
        out = rewrite.plan_undo(now, undo, trash, k)[1]
        return out.select("path", "hash", F.coalesce("restored", F.lit(True)).alias("restored"))


MEDIA = ["path", "name", "media_kind", "size_bytes", "mod_time", "width", "height", "camera_make"]


@query(on_catalog(f"SELECT {', '.join(MEDIA)} FROM catalog"))
def all_media(spark, sf_dir):
    own = catalog(spark, sf_dir)
    return search.all_media(own.where("media_kind <> 'audio'").select(*MEDIA), own.where("media_kind = 'audio'").select("path", "name", "media_kind", "size_bytes", "mod_time", "camera_make", "channels"))


@query(on_catalog("SELECT path, name, media_kind, size_bytes, mod_time, NULL::INT AS width, NULL::INT AS height, NULL::VARCHAR AS camera_make FROM catalog WHERE media_kind = 'audio'"))
def audio_as_media(spark, sf_dir):
    own = catalog(spark, sf_dir)
    return search.audio_as_media(own.where("media_kind = 'audio'").select("path", "name", "media_kind", "size_bytes", "mod_time", "duration_sec"), own.where("media_kind <> 'audio'").select(*MEDIA))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return files.content_hash(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "hash")


# -- sources: written from a table into the shared folder, and read again


def _tree(spark, sf_dir):
    """A file /source=S/lang=L/....jpg for each pair, that lists the documents' keys."""
    base = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    own = table(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("line"), "doc_id")
    own = own.repartition("source", "lang").sortWithinPartitions("source", "lang", "doc_id").drop("doc_id")
    own.write.partitionBy("source", "lang").option("extension", "jpg").csv(base)
    return base


def _pair():
    return [F.regexp_extract("path", f"/{x}=([^/]*)/", 1).alias(x) for x in ("source", "lang")]


PAIRS = "SELECT source, lang, {0} FROM (SELECT source, lang, string_agg(doc_id, chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents GROUP BY source, lang)"


@query(PAIRS.format("strlen(content)::BIGINT AS size_bytes"))
def list_media(spark, sf_dir):
    return files.list_media(spark, _tree(spark, sf_dir)).select(*_pair(), "size_bytes")


@query(PAIRS.format("sha256(content) AS hash"))
def hashed_media(spark, sf_dir):
    return files.hashed_media(spark, _tree(spark, sf_dir)).select(*_pair(), "hash")


def _streamed(spark, df, mode="append"):
    """What a stream of df has given when it has read all there is."""
    name, base = f"s{uuid.uuid4().hex}", shared_dir(spark)
    sink = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/{name}-log").trigger(availableNow=True)
    if mode == "append":
        sink.format("parquet").option("path", f"{base}/{name}").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")
    out = []
    sink.foreachBatch(lambda batch, _: out.append(materialise(batch, name))).start().awaitTermination()
    return out[-1]


@query(PAIRS.format("strlen(content)::BIGINT AS size_bytes"))
def stream_listing(spark, sf_dir):
    return _streamed(spark, files.stream_listing(spark, _tree(spark, sf_dir))).select(*_pair(), "size_bytes")


def _stream_of(spark, df):
    held = materialise(df, "fed")
    return spark.readStream.schema(df.schema).parquet(held.scratch_path)


@query(on_catalog(f"{ROOTS}, n AS (SELECT r.path AS root, count(*) AS n FROM listing l JOIN (SELECT DISTINCT path FROM roots WHERE path = origin) r ON starts_with(l.path, r.path || '/') GROUP BY r.path) SELECT root, (n // 25 * 25)::BIGINT AS processed, -1::BIGINT AS total FROM n WHERE n >= 25", LISTING))
def scan_progress(spark, sf_dir):
    top = roots(spark, sf_dir).where("path = origin").select(F.col("path").alias("root")).distinct()
    each = listing(spark, sf_dir).select("path", F.explode(paths.ancestors(F.col("path"))).alias("root")).join(top, "root")
    return _streamed(spark, changes.scan_progress(_stream_of(spark, each)), "complete")


@contextmanager
def _rocksdb(spark):
    """Streams with state that Python keeps need this store; the setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _in_order(spark, df, slices=6, files=4):
    """A stream of df(ts, ...) that reads it in so many micro-batches, each of a later span of time."""
    base = f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}"
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    for k in range(slices):
        own = df.where((F.col("ts") >= first + (last - first) * k / slices) & ((F.col("ts") < first + (last - first) * (k + 1) / slices) | F.lit(k == slices - 1)))
        own.repartition(files).write.mode("append").parquet(base)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(base)


@query(f"WITH {EVENTS}, {LAST} SELECT id, state, seq FROM last")
def journal_state_stream(spark, sf_dir):
    with _rocksdb(spark):
        seen = _streamed(spark, changes.journal_state_stream(_in_order(spark, journal(spark, sf_dir).select("id", "state", "seq", "ts"))))
    return seen.groupBy("id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


@query(on_catalog(CHANGES + """, l AS (SELECT l.path, l.size_bytes, status FROM listing l JOIN changed USING (path))
SELECT l.path, l.size_bytes, ['kind:' || k] || CASE k WHEN 'audio' THEN ['codec:mp3', 'year:2024'] ELSE [] END AS auto_tags, [] AS tags FROM (SELECT *, CASE regexp_extract(path, '(\\.[^./]*)$', 1) WHEN '.mp3' THEN 'audio' WHEN '.mp4' THEN 'video' ELSE 'photo' END AS k FROM l WHERE status <> 'unchanged') l
UNION ALL SELECT path, size_bytes, auto_tags, tags FROM catalog WHERE path NOT IN (SELECT path FROM l WHERE status <> 'unchanged')""", LISTING))
def ingest_stream(spark, sf_dir):
    own = catalog(spark, sf_dir).select("path", "name", "media_kind", "size_bytes", "mod_time", "tags", "auto_tags")
    base = f"{shared_dir(spark)}/ingested-{uuid.uuid4().hex}"
    store.save_catalog({"media": own}, base)
    changes.ingest_stream(_stream_of(spark, listing(spark, sf_dir)), base, own.schema, f"{base}/log").awaitTermination()
    return store.load_catalog(spark, base, {"media": own.schema})["media"].select("path", "size_bytes", "auto_tags", "tags")


@query(on_catalog("SELECT path, name, tags, auto_tags, NULL::BIGINT AS phash FROM catalog"))
def load_catalog(spark, sf_dir):
    own = catalog(spark, sf_dir).select("path", "name", "tags", "auto_tags")
    base = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    store.save_catalog({"media": own.limit(0)}, base)
    store.save_catalog({"media": own}, base)
    return store.load_catalog(spark, base, {"media": own.schema.add("phash", "long")})["media"]


@query(on_catalog("SELECT path, name, tags, CASE WHEN media_kind = 'audio' THEN 2 ELSE 1 END AS first_commit FROM catalog"))
def save_catalog(spark, sf_dir):
    """Two writers start from the empty store. The second is refused, takes over what the first has put, and commits."""
    own = catalog(spark, sf_dir).select("path", "name", "tags", "media_kind")
    sound, rest = own.where("media_kind = 'audio'"), own.where("media_kind <> 'audio'")
    base, kinds = f"{shared_dir(spark)}/writers-{uuid.uuid4().hex}", {"media": own.schema}
    one = store.save_catalog({"media": rest}, base, after=0)
    try:
        store.save_catalog({"media": sound}, base, after=0)
    except store.Conflict:
        store.save_catalog({"media": store.load_catalog(spark, base, kinds)["media"].unionByName(sound)}, base, after=one)
    early = store.load_catalog(spark, base, kinds, number=one)["media"].select("path", F.lit(1).alias("early"))
    last = store.load_catalog(spark, base, kinds)["media"].join(early, "path", "left")
    return last.select("path", "name", "tags", F.coalesce("early", F.lit(2)).alias("first_commit"))


@query(f"WITH {EVENTS} SELECT id, kind, state, count(*) AS n FROM journal WHERE state <> 'failed' GROUP BY ALL")
def read_journal(spark, sf_dir):
    own = journal(spark, sf_dir).withColumn("id", F.when(F.col("state") != "failed", F.col("id")))
    lines = own.select(F.to_json(F.struct("id", "kind", "state", "old_path", "new_path", "path")).alias("value"))
    torn = lines.select(F.substring("value", 1, 20).alias("value"))
    path = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    lines.union(torn).write.text(path)
    return files.read_journal(spark, path).groupBy("id", "kind", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS}, {LAST} SELECT id, state FROM last")
def read_journal_order(spark, sf_dir):
    """A journal of several files, each later than the last: the last line of an id is that of the greatest seq."""
    own = journal(spark, sf_dir)
    path = f"{shared_dir(spark)}/journals-{uuid.uuid4().hex}"
    for k in range(3):
        lines = own.where(F.col("seq") * 3 >= F.lit(k) * own.count()).where((F.col("seq") * 3 < F.lit(k + 1) * own.count()) | F.lit(k == 2))
        lines.coalesce(1).sortWithinPartitions("seq").select(F.to_json(F.struct("id", "kind", "state")).alias("value")).write.mode("append").text(path)
    return files.read_journal(spark, path).groupBy("id").agg(F.max_by("state", "seq").alias("state"))


@query(f"WITH {ROOTS} SELECT path, origin, 'root' AS what FROM roots UNION ALL SELECT DISTINCT origin || '/old', NULL, 'ignored' FROM roots")
def read_roots(spark, sf_dir):
    own = roots(spark, sf_dir)
    some = own.select("path", F.when(F.col("path") != F.col("origin"), F.col("origin")).otherwise("").alias("origin"))
    some = some.union(own.select(F.concat("origin", F.lit("/vendor")).alias("path"), F.col("origin")))
    ignored = own.select(F.concat("origin", F.lit("/old")).alias("path")).distinct()
    # the file holds all roots, of which there are few
    one = some.agg(F.collect_list(F.struct("path", "origin")).alias("roots")).join(ignored.agg(F.collect_list("path").alias("ignored")))
    path = f"{shared_dir(spark)}/roots-{uuid.uuid4().hex}"
    one.select(F.to_json(F.struct("roots", "ignored"))).coalesce(1).write.text(path)
    found, gone = files.read_roots(spark, path)
    return found.select("path", "origin", F.lit("root").alias("what")).union(gone.select("path", F.lit(None).cast("string"), F.lit("ignored")))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN (event_id % 5 + 1)::INT END AS channels, CASE WHEN event_id % 2 = 0 THEN event_id % 1000 / 4.0::DOUBLE WHEN event_id % 1000 > 0 THEN event_id % 1000 / 2.0::DOUBLE END AS duration_sec,
 CASE WHEN event_id % 7 > 0 THEN (event_id // 1000)::INT END AS bitrate_kbps, CASE WHEN event_id % 4 > 0 THEN (event_id % 4 * 100)::INT END AS width FROM (SELECT event_id FROM events WHERE event_id % 1000 > 0)
UNION ALL SELECT event_id, CASE WHEN event_id % 3 > 0 THEN (event_id % 5 + 1)::INT END, NULL, CASE WHEN event_id % 7 > 0 THEN (event_id // 1000)::INT END, CASE WHEN event_id % 4 > 0 THEN (event_id % 4 * 100)::INT END FROM events WHERE event_id % 1000 = 0""")
def probe_fields(spark, sf_dir):
    n = F.col("event_id")
    audio = F.struct(
        F.lit("audio").alias("codec_type"), F.when(n % 3 > 0, (n % 5 + 1).cast("int")).otherwise(0).alias("channels"),
        F.when(n % 2 == 0, (n % 1000 / 4).cast("string")).otherwise("0").alias("duration"), F.lit("x").alias("bit_rate"), F.lit(0).alias("width"),
    )
    video = F.struct(F.lit("video").alias("codec_type"), F.lit(0).alias("channels"), F.lit("1").alias("duration"), F.lit("1").alias("bit_rate"), (n % 4 * 100).cast("int").alias("width"))
    whole = F.struct((n % 1000 / 2).cast("string").alias("duration"), F.when(n % 7 > 0, n.cast("string")).alias("bit_rate"))
    probe = F.to_json(F.struct(F.array(audio, video).alias("streams"), whole.alias("format")))
    return files.probe_fields(table(spark, sf_dir, "events").select("event_id", probe.alias("probe"))).select("event_id", "channels", "duration_sec", "bitrate_kbps", "width")


IMAGES = "im AS (SELECT doc_id, '/pictures/' || doc_id AS path, (9 + doc_id % 4)::INT AS width, (8 + doc_id % 3)::INT AS height, repeat(sha256(text), 4) AS x FROM documents)"


def _images(spark, sf_dir):
    """Grey pictures of twelve shapes, as the image source gives them, whose points are the checksum of a document."""
    n = F.col("doc_id")
    own = table(spark, sf_dir, "documents").select(F.concat(F.lit("file:/pictures/"), n.cast("string")).alias("origin"), (8 + n % 3).cast("int").alias("height"), (9 + n % 4).cast("int").alias("width"), F.sha2("text", 256).alias("x"))
    data = F.unhex(F.substring(F.repeat("x", 4), F.lit(1), 2 * F.col("width") * F.col("height")))
    return own.select(F.struct("origin", "height", "width", F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data")).alias("image"))


@query(f"WITH {IMAGES} SELECT path, width, height FROM im")
def image_dims(spark, sf_dir):
    return files.dims_of(_images(spark, sf_dir))


#: Bilinear points of an 8 x 9 grid, rounded to even; bit 63 is the first.
@query(f"""WITH {IMAGES}, spots AS (
  SELECT doc_id, width AS w, x, i, j, greatest(0, least((i + 0.5::DOUBLE) * height / 8 - 0.5::DOUBLE, height - 1))::DOUBLE AS v, greatest(0, least((j + 0.5::DOUBLE) * width / 9 - 0.5::DOUBLE, width - 1))::DOUBLE AS u, height - 1 AS last_v, width - 1 AS last_u
  FROM im, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(9)) AS j)),
corners AS (SELECT doc_id, i, j, v - floor(v) AS fv, u - floor(u) AS fu, list_transform(
    [floor(v)::INT * w + floor(u)::INT, floor(v)::INT * w + least(floor(u)::INT + 1, last_u), least(floor(v)::INT + 1, last_v) * w + floor(u)::INT, least(floor(v)::INT + 1, last_v) * w + least(floor(u)::INT + 1, last_u)],
    lambda k: ('0x' || substr(x, 2 * k + 1, 2))::INT::DOUBLE) AS p FROM spots),
grid AS (SELECT doc_id, i, j, round_even((p[1] * (1 - fu) + p[2] * fu) * (1 - fv) + (p[3] * (1 - fu) + p[4] * fu) * fv, 0)::INT AS n FROM corners),
sums AS (SELECT a.doc_id, sum((a.n < b.n)::HUGEINT << (63 - a.i * 8 - a.j)::INT) AS u FROM grid a JOIN grid b ON b.doc_id = a.doc_id AND b.i = a.i AND b.j = a.j + 1 GROUP BY a.doc_id)
SELECT 'file:/pictures/' || doc_id AS path, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS phash FROM sums""")
def image_dhash(spark, sf_dir):
    return hashes.image_dhash(_images(spark, sf_dir))


PLACES = """c AS (SELECT c_custkey AS id, (c_custkey * 41 % 180 - 90)::DOUBLE AS lat, (c_custkey * 67 % 360 - 180)::DOUBLE AS lon FROM customer),
s AS (SELECT s_name AS place, n_name AS country, (s_suppkey * 37 % 180 - 90)::DOUBLE AS lat, (s_suppkey * 73 % 360 - 180)::DOUBLE AS lon FROM supplier JOIN nation ON n_nationkey = s_nationkey),
m AS (SELECT id, place, country, 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, sin(radians(c.lat - s.lat) / 2) ** 2 + cos(radians(c.lat)) * cos(radians(s.lat)) * sin(radians(c.lon - s.lon) / 2) ** 2))) AS km FROM c, s),
b AS (SELECT id, place, country FROM m WHERE km <= 300 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(km, 6), place) = 1)"""


@query(f"WITH {PLACES} SELECT c.id, place, country FROM c LEFT JOIN b USING (id)")
def nearest_place(spark, sf_dir):
    spot = lambda k, a, b: [(F.col(k) * a % 180 - 90).cast("double").alias("lat"), (F.col(k) * b % 360 - 180).cast("double").alias("lon")]
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *spot("c_custkey", 41, 67))
    nation = table(spark, sf_dir, "nation")
    cities = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("place"), F.col("n_name").alias("country"), *spot("s_suppkey", 37, 73))
    return clusters.nearest_place(points, cities, 300.0).select("id", "place", "country")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query, vec_id, rank FROM (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5""")
def semantic_neighbours(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    return clusters.semantic_neighbours(own, own.where("vec_id % 100 = 0"), 5).select("query", "vec_id", "rank")


@query(on_catalog(labels(5) + """, q AS (SELECT * FROM named WHERE untagged > 0), t AS (SELECT kind, g, tag, count(*) AS k FROM (SELECT kind, g, unnest(auto_tags) AS tag FROM m) GROUP BY ALL),
s AS (SELECT q.id, list_sort(list(tag)) AS shared FROM q JOIN t ON t.kind = q.kind AND t.g = q.g AND k = size GROUP BY q.id)
SELECT q.id, size, untagged, first, coalesce(shared, []) AS shared, row_number() OVER (ORDER BY size DESC, q.id) - 1 AS pos FROM q LEFT JOIN s USING (id)""", HASHED))
def tagging_queue(spark, sf_dir):
    own = _hashed(spark, sf_dir)
    return clusters.tagging_queue(clusters.near_members(own), own).select("id", "size", "untagged", "first", "shared", "pos")


# -- streams, as batches

SESSIONS = "(SELECT {key}, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT {key}, ts, lag(ts) OVER (PARTITION BY {key} ORDER BY ts) AS p FROM {source}))"

for _name, _gap in (("debounce_changes", "3 seconds"), ("debounce_changes_hourly", "1 hour")):

    @query(f"WITH {EVENTS} SELECT dir, min(ts) AS first_event, max(ts) + INTERVAL {_gap} AS due, count(*) AS events FROM {SESSIONS.format(key='dir', gap=_gap, source='change_events')} GROUP BY dir, g", name=_name)
    def debounce_changes(spark, sf_dir, gap=_gap):
        return changes.debounce_changes(change_events(spark, sf_dir), gap)


@query(f"WITH s AS (SELECT user_id, g, min(ts) AS a, max(ts) AS b FROM {SESSIONS.format(key='user_id', gap='6 hours', source='events')} GROUP BY ALL), x AS (SELECT user_id, b AS idle_from, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS idle_to FROM s) SELECT * FROM x WHERE idle_to IS NOT NULL")
def idle_periods(spark, sf_dir):
    return changes.idle_periods(table(spark, sf_dir, "events"), "6 hours")


IDLE = f"WITH s AS (SELECT user_id, g, min(ts) AS a, max(ts) AS b FROM {SESSIONS.format(key='user_id', gap='6 hours', source='events')} GROUP BY ALL), x AS (SELECT user_id, b AS idle_from, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS idle_to FROM s)"


@query(f"{IDLE} SELECT user_id, idle_from, idle_to FROM x WHERE idle_to IS NOT NULL")
def idle_stream(spark, sf_dir):
    with _rocksdb(spark):
        seen = _streamed(spark, changes.idle_stream(_in_order(spark, table(spark, sf_dir, "events").select("user_id", "ts")), "6 hours"))
    return seen.where("idle_to IS NOT NULL").select("user_id", *[F.col(x).cast("timestamp_ntz").alias(x) for x in ("idle_from", "idle_to")])


@query(f"WITH {EVENTS} SELECT dir, min(ts) AS first_event, max(ts) + INTERVAL 1 HOUR AS due, count(*) AS events FROM {SESSIONS.format(key='dir', gap='1 hour', source='change_events')} GROUP BY dir, g HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def debounce_stream(spark, sf_dir):
    """Fed in order; sessions that the watermark has not passed are still open, and not given."""
    seen = _streamed(spark, changes.debounce_changes(_in_order(spark, change_events(spark, sf_dir)), "1 hour"))
    return seen.select("dir", *[F.col(x).cast("timestamp_ntz").alias(x) for x in ("first_event", "due")], "events")


@query(f"WITH {EVENTS} SELECT CASE op WHEN 'remove' THEN NULL ELSE 'rescan' END AS action, dir AS path, count(*) AS n FROM change_events WHERE op <> 'remove' AND dir IN (SELECT DISTINCT '/lib/' || source || '/' || lang FROM documents) GROUP BY ALL")
def route_changes(spark, sf_dir):
    events = change_events(spark, sf_dir).withColumn("is_dir", F.lit(False))
    return changes.route_changes(events, roots(spark, sf_dir)).groupBy("action", "path").agg(F.count(F.lit(1)).alias("n"))
