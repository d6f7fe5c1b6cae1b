"""Queries of the index operators over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from waymark.functions import keys, text
from waymark.operators import chunks as chunk_ops
from waymark.operators import filters, graph, ingest, vectors
from waymark.operators.changefeed import whole_seconds
from waymark.operators.incremental import current_fetches
from waymark.plans.filter_dsl import And, Key, Not, from_list, leaf_keys, parse_filter
from waymark.plans import stored
from waymark.plans.registry import Registry
from waymark.runtime import spread, table

INDEX = Registry()

_TOPIC_SQL = ", ".join(f"CASE WHEN {' + '.join(f'''CAST(contains(t, '{w}') AS INT)''' for w in words.split())} >= 2 THEN 'topic:{name}' END" for name, words in keys.TOPICS.items())
_FOLDER_SQL = "CASE WHEN NOT contains(file_path, '/') THEN '' WHEN regexp_replace(file_path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(file_path, '/[^/]*$', '') END"
_NAME_SQL = "regexp_extract(lower(file_path), '([^/]*)$', 1)"
_STEM_SQL = f"regexp_replace({_NAME_SQL}, '(.)\\.[^.]*$', '\\1')"
_CONVENTION_SQL = f"""
  CASE WHEN suffix({_STEM_SQL}, '_test') OR suffix({_STEM_SQL}, '_spec') OR starts_with({_STEM_SQL}, 'test_') OR contains(lower(file_path), 'tests/') OR contains(lower(file_path), 'test/') THEN 'convention:test' END,
  CASE WHEN contains({_NAME_SQL}, '.config.') OR {_NAME_SQL} IN ({', '.join(f"'{n}'" for n in keys.CONFIG_NAMES)}) THEN 'convention:config' END,
  CASE WHEN contains(lower(file_path), 'migrations/') OR contains(lower(file_path), 'migrate/') THEN 'convention:migration' END,
  CASE WHEN starts_with({_STEM_SQL}, 'readme') THEN 'convention:readme' END,
  CASE WHEN contains(lower(file_path), 'docs/') OR contains(lower(file_path), 'doc/') THEN 'convention:docs' END"""
_SIZE_SQL = "CASE WHEN strlen(coalesce(text, '')) <= 1023 THEN 'size:small' WHEN strlen(coalesce(text, '')) <= 10240 THEN 'size:medium' ELSE 'size:large' END"
KEYS_SQL = f"""
keys AS (
  SELECT DISTINCT doc_id, k AS bitmap_key FROM (
    SELECT doc_id, unnest(['source:' || source_type, 'type:' || auto_type, 'lang:' || lower(lang), 'folder:' || {_FOLDER_SQL}, {_SIZE_SQL}, {_TOPIC_SQL}, {_CONVENTION_SQL}]) AS k
    FROM (SELECT *, lower(coalesce(text, '')) AS t FROM documents))
  WHERE k IS NOT NULL)"""


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "file_path", "source_type", "auto_type", "lang", "text")


def _keys(spark, d, *names):
    """The stored key table, or its part that the given keys or namespaces are in."""
    k = stored.doc_keys(spark, d)
    return k if not names else k.where(reduce(lambda a, b: a | b, (F.col("bitmap_key").startswith(f"{n}:") for n in sorted(keys.namespaces_of(names)))))


def _universe(spark, d):
    return table(spark, d, "documents").select("doc_id")


def _has(*names):
    return "SELECT doc_id FROM keys WHERE bitmap_key IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def _filter_query(name, expression, condition):
    """A filter over the whole key table; ``condition`` is its SQL over documents d."""

    parsed = parse_filter(expression) if isinstance(expression, str) else expression

    @INDEX.add(name, f"WITH {KEYS_SQL} SELECT DISTINCT d.doc_id FROM documents d WHERE {condition}")
    def run(spark, d):
        return filters.match(_keys(spark, d, *leaf_keys(parsed)), parsed, _universe(spark, d))


_filter_query("filter_key", "lang:en", f"d.doc_id IN ({_has('lang:en')})")
_filter_query("filter_and", "source:code AND topic:database AND size:medium", f"d.doc_id IN ({_has('source:code')}) AND d.doc_id IN ({_has('topic:database')}) AND d.doc_id IN ({_has('size:medium')})")
_filter_query("filter_or", "source:jira OR source:slack OR lang:ja", f"d.doc_id IN ({_has('source:jira', 'source:slack', 'lang:ja')})")
_filter_query("filter_not", "NOT lang:en", f"d.doc_id NOT IN ({_has('lang:en')})")
_filter_query("filter_nested", "(source:obsidian OR source:confluence) AND NOT (lang:de OR size:small)", f"d.doc_id IN ({_has('source:obsidian', 'source:confluence')}) AND d.doc_id NOT IN ({_has('lang:de', 'size:small')})")
_filter_query("filter_double_not", "NOT NOT source:code", f"d.doc_id IN ({_has('source:code')})")
_filter_query("filter_unknown_key", "tag:nowhere", "false")
_filter_query("filter_legacy_or", from_list(["type:task", "type:moc"], "or"), f"d.doc_id IN ({_has('type:task', 'type:moc')})")
_filter_query("filter_legacy_and", from_list(["type:source_file", "topic:database"]), f"d.doc_id IN ({_has('type:source_file')}) AND d.doc_id IN ({_has('topic:database')})")
_filter_query("filter_empty_and", And(()), "false")


@INDEX.add("filter_match_all", f"WITH {KEYS_SQL} SELECT DISTINCT doc_id FROM keys WHERE starts_with(bitmap_key, 'source:')")
def filter_match_all(spark, d):
    return filters.match_all(_keys(spark, d, "source:"))


@INDEX.add("filter_tombstoned", f"WITH {KEYS_SQL} SELECT DISTINCT doc_id FROM keys WHERE bitmap_key = 'source:confluence' AND doc_id NOT IN (SELECT doc_id FROM tombstones WHERE doc_id IS NOT NULL)")
def filter_tombstoned(spark, d):
    return filters.match(_keys(spark, d, "source:"), "source:confluence", _universe(spark, d), table(spark, d, "tombstones"))


@INDEX.add("filter_page", f"""
WITH {KEYS_SQL}, m AS ({_has('source:obsidian')} EXCEPT {_has('lang:de')})
SELECT doc_id, (SELECT count(*) FROM m) AS total_matching FROM m ORDER BY doc_id LIMIT 20 OFFSET 40""")
def filter_page(spark, d):
    return filters.page(filters.match(_keys(spark, d, "source:", "lang:"), "source:obsidian AND NOT lang:de", _universe(spark, d)), 20, 40)


@INDEX.add("matched_filters", f"WITH {KEYS_SQL} SELECT DISTINCT doc_id, ['source:jira', 'lang:fr'] AS matched_filters FROM keys WHERE bitmap_key = 'source:jira' AND doc_id NOT IN ({_has('lang:fr')})")
def matched_filters(spark, d):
    f = And((Key("source:jira"), Not(Key("lang:fr"))))
    return filters.match(_keys(spark, d, *leaf_keys(f)), f, _universe(spark, d)).select("doc_id", F.array(*(F.lit(k) for k in leaf_keys(f))).alias("matched_filters"))


@INDEX.add("filter_catalog", f"WITH {KEYS_SQL} SELECT bitmap_key, split_part(bitmap_key, ':', 1) AS category, count(DISTINCT doc_id) AS cardinality FROM keys GROUP BY ALL")
def filter_catalog(spark, d):
    return filters.catalog(_keys(spark, d))


@INDEX.add("filter_catalog_prefix", f"WITH {KEYS_SQL} SELECT bitmap_key, split_part(bitmap_key, ':', 1) AS category, count(DISTINCT doc_id) AS cardinality FROM keys WHERE starts_with(bitmap_key, 'topic:') GROUP BY ALL")
def filter_catalog_prefix(spark, d):
    return filters.catalog(_keys(spark, d, "topic:"), "topic:")


@INDEX.add("index_status", f"""
WITH {KEYS_SQL}
SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tombstones)) AS total_documents, (SELECT count(DISTINCT bitmap_key) FROM keys) AS total_keys,
  (SELECT count(DISTINCT doc_id) FROM tombstones) AS total_tombstones, (SELECT max(doc_id) + 1 FROM documents) AS next_doc_id, (SELECT max(chunk_id) + 1 FROM chunks) AS next_chunk_id""")
def index_status(spark, d):
    return filters.status(table(spark, d, "documents"), table(spark, d, "chunks"), _keys(spark, d), table(spark, d, "tombstones"))


@INDEX.add("jaccard_pair", f"""
WITH {KEYS_SQL}, a AS ({_has('topic:testing')}), b AS ({_has('source:code')})
SELECT n_both, n_either, CASE WHEN n_either = 0 THEN 0.0 ELSE n_both / n_either END AS jaccard FROM (
  SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_both, (SELECT count(*) FROM (FROM a UNION FROM b)) AS n_either)""")
def jaccard_pair(spark, d):
    return filters.jaccard(_keys(spark, d, "topic:", "source:"), "topic:testing", "source:code")


@INDEX.add("jaccard_with_key", f"""
WITH {KEYS_SQL}, a AS ({_has('source:code')}), size AS (SELECT bitmap_key, count(*) AS n FROM keys GROUP BY ALL),
both_ AS (SELECT bitmap_key, count(*) AS n FROM keys WHERE doc_id IN (FROM a) AND bitmap_key <> 'source:code' GROUP BY ALL)
SELECT b.bitmap_key, b.n AS n_both, s.n + (SELECT count(*) FROM a) - b.n AS n_either, b.n / (s.n + (SELECT count(*) FROM a) - b.n) AS jaccard
FROM both_ b JOIN size s USING (bitmap_key)""")
def jaccard_with_key(spark, d):
    return filters.jaccard_with(_keys(spark, d), "source:code")


@INDEX.add("key_union", f"WITH {KEYS_SQL} {_has('type:task')} UNION {_has('topic:api')}")
def key_union(spark, d):
    k = _keys(spark, d, "type:", "topic:")
    return filters.match(k, "type:task").union(filters.match(k, "topic:api")).distinct()


@INDEX.add("key_intersect", f"WITH {KEYS_SQL} {_has('lang:en')} INTERSECT {_has('topic:database')}")
def key_intersect(spark, d):
    k = _keys(spark, d, "lang:", "topic:")
    return filters.match(k, "lang:en").intersect(filters.match(k, "topic:database"))


@INDEX.add("key_except", f"WITH {KEYS_SQL} {_has('lang:en')} EXCEPT {_has('source:code')}")
def key_except(spark, d):
    k = _keys(spark, d, "lang:", "source:")
    return filters.match(k, "lang:en").subtract(filters.match(k, "source:code"))


@INDEX.add("size_tagger", f"SELECT doc_id, {_SIZE_SQL} AS tag FROM documents")
def size_tagger(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.size_tag(F.coalesce("text", F.lit(""))).alias("tag"))


@INDEX.add("topic_tagger", f"SELECT doc_id, tag FROM (SELECT doc_id, unnest([{_TOPIC_SQL}]) AS tag FROM (SELECT doc_id, lower(text) AS t FROM documents)) WHERE tag IS NOT NULL")
def topic_tagger(spark, d):
    return spread(_documents(spark, d)).select("doc_id", F.explode_outer(keys.topic_tags(F.col("text"))).alias("tag")).where("tag IS NOT NULL")


@INDEX.add("convention_tagger", f"SELECT doc_id, tag FROM (SELECT doc_id, unnest([{_CONVENTION_SQL}]) AS tag FROM documents) WHERE tag IS NOT NULL")
def convention_tagger(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode_outer(keys.convention_tags(F.col("file_path"))).alias("tag")).where("tag IS NOT NULL")


@INDEX.add("complexity_tagger", """
SELECT d.doc_id, CASE WHEN n > 10 OR m >= 4 THEN 'complexity:high' WHEN n > 3 THEN 'complexity:medium' ELSE 'complexity:low' END AS tag
FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT chunk_id) AS n, max(depth) AS m FROM chunks GROUP BY ALL) c USING (doc_id)""")
def complexity_tagger(spark, d):
    stats = filters.chunk_ranges(table(spark, d, "chunks"))
    return table(spark, d, "documents").join(stats, "doc_id", "left").select("doc_id", keys.complexity_tag(F.col("n_chunks"), F.col("max_depth")).alias("tag"))


_RULES = keys.RuleTagger.load({"name": "places", "rules": [
    {"match": {"folder": "/vault/*/work"}, "add_tags": ["place:work"]},
    {"match": {"extension": ".py", "content_contains": "store.get"}, "add_tags": ["uses:store", "lang:python"]},
    {"match": {"has_tag": "source:jira", "content_contains": "Priority: High"}, "add_tags": ["urgent:yes"]},
]})


@INDEX.add("rule_tagger", f"""
SELECT doc_id, tag FROM (SELECT doc_id, unnest(list_concat(
    CASE WHEN regexp_full_match({_FOLDER_SQL}, '/vault/.*/work') THEN ['place:work'] ELSE [] END,
    CASE WHEN suffix(file_path, '.py') AND contains(text, 'store.get') THEN ['uses:store', 'lang:python'] ELSE [] END,
    CASE WHEN source_type = 'jira' AND contains(text, 'Priority: High') THEN ['urgent:yes'] ELSE [] END)) AS tag FROM documents)""")
def rule_tagger(spark, d):
    docs = table(spark, d, "documents")
    tags = F.array(F.concat(F.lit("source:"), F.col("source_type")))
    return docs.select("doc_id", F.explode(_RULES.tags(F.col("file_path"), F.col("text"), tags)).alias("tag"))


@INDEX.add("code_types", r"""
SELECT doc_id, CASE WHEN stem = '' THEN NULL
  WHEN regexp_matches(stem, '(_test|_tests|_spec|\.test|\.spec)$') OR starts_with(stem, 'test_') OR stem = 'tests' OR contains(file_path, '/tests/') OR contains(file_path, '/test/') THEN 'test_file'
  WHEN ext = '' THEN NULL
  WHEN ext IN ('toml', 'yaml', 'yml', 'json', 'ini', 'cfg') OR stem IN ('Cargo', 'Makefile', 'Dockerfile') OR starts_with(stem, '.') THEN 'config_file' ELSE 'source_file' END AS code_type
FROM (SELECT doc_id, file_path, regexp_replace(f, '(.)\.[^.]*$', '\1') AS stem, regexp_extract(f, '^.+\.([^.]*)$', 1) AS ext FROM (SELECT *, regexp_extract(file_path, '([^/]*)$', 1) AS f FROM documents))""")
def code_types(spark, d):
    return table(spark, d, "documents").select("doc_id", keys.code_type(F.col("file_path")).alias("code_type"))


@INDEX.add("flatten_tags", """
SELECT DISTINCT doc_id, array_to_string(p[1:i], '/') AS tag FROM (
  SELECT doc_id, string_split(trim(file_path, '/'), '/') AS p FROM documents), range(1, 30) r(i) WHERE i <= len(p)""")
def flatten_tags(spark, d):
    path = F.regexp_replace("file_path", "^/+|/+$", "")
    return table(spark, d, "documents").select("doc_id", F.explode(text.flatten_tag(path)).alias("tag")).distinct()


@INDEX.add("slugs", r"SELECT DISTINCT title, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]', '-', 'g'), '-') AS slug FROM remote_items WHERE title IS NOT NULL")
def slugs(spark, d):
    return table(spark, d, "remote_items").where("title IS NOT NULL").select("title", text.slug(F.col("title")).alias("slug")).distinct()


@INDEX.add("mrkdwn_expand", r"""
SELECT msg_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<@[^|>]+\|([^>]+)>', '@\1', 'g'), '<@([^|>]+)>', '@\1', 'g'),
  '<#[^|>]+\|([^>]+)>', '#\1', 'g'), '<#([^|>]+)>', '#\1', 'g'), '<((?:https?|mailto)[^|>]*)\|([^>]+)>', '\2 (\1)', 'g'), '<((?:https?|mailto)[^|>]*)>', '\1', 'g') AS expanded
FROM slack_messages""")
def mrkdwn_expand(spark, d):
    return table(spark, d, "slack_messages").select("msg_id", text.expand_mrkdwn(F.col("text")).alias("expanded"))


@INDEX.add("strip_html", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents WHERE source_type = 'confluence'")
def strip_html(spark, d):
    return table(spark, d, "documents").where("source_type = 'confluence'").select("doc_id", text.strip_tags(F.col("text")).alias("plain"))


@INDEX.add("wiki_links", """SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'content-title="([^"]*)"', 1)) AS target FROM documents WHERE source_type = 'confluence'""")
def wiki_links(spark, d):
    return table(spark, d, "documents").where("source_type = 'confluence'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('content-title="([^"]*)"'))).alias("target")).distinct()


@INDEX.add("utc_days", """
SELECT source_name, strftime(to_timestamp(CASE WHEN abs(updated_at) >= 100000000000 THEN updated_at // 1000 ELSE updated_at END) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM remote_items GROUP BY ALL""")
def utc_days(spark, d):
    return table(spark, d, "remote_items").groupBy("source_name", text.utc_day(whole_seconds(F.col("updated_at"))).alias("day")).agg(F.count("*").alias("n"))


@INDEX.add("chat_users", """
SELECT channel_id, bundle_date, list_sort(list(DISTINCT coalesce(username, user_id, 'unknown'))) AS users, bool_or(coalesce(thread_ts, '') <> '') AS has_threads
FROM slack_messages WHERE subtype IS NULL OR subtype IN ('bot_message', 'file_share') GROUP BY ALL""")
def chat_users(spark, d):
    m = table(spark, d, "slack_messages").where("subtype IS NULL OR subtype IN ('bot_message', 'file_share')")
    who = F.coalesce("username", "user_id", F.lit("unknown"))
    pairs = m.groupBy("channel_id", "bundle_date", who.alias("who")).agg(F.bool_or(F.coalesce("thread_ts", F.lit("")) != "").alias("t"))  # a row per user and day before they are listed
    return pairs.groupBy("channel_id", "bundle_date").agg(F.sort_array(F.collect_list("who")).alias("users"), F.bool_or("t").alias("has_threads"))


@INDEX.add("chunk_tree", """
WITH c AS (SELECT doc_id, chunk_id, any_value(byte_start) AS b, any_value(depth) AS dep, any_value(kind) IN ('frontmatter', 'body') AS flat FROM chunks GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b, chunk_id) AS i FROM c),
p AS (SELECT a.doc_id, a.chunk_id, max(q.i) AS pi FROM n a LEFT JOIN n q ON q.doc_id = a.doc_id AND q.i < a.i AND q.dep < a.dep AND NOT q.flat
  AND NOT EXISTS (SELECT 1 FROM n z WHERE z.doc_id = a.doc_id AND z.i > q.i AND z.i < a.i AND z.dep <= q.dep) GROUP BY ALL)
SELECT p.doc_id, p.chunk_id, n.chunk_id AS parent_chunk_id FROM p LEFT JOIN n ON n.doc_id = p.doc_id AND n.i = p.pi""")
def chunk_tree(spark, d):
    return chunk_ops.nest(table(spark, d, "chunks")).select("doc_id", "chunk_id", "parent_chunk_id")


@INDEX.add("chunk_ranges", "SELECT doc_id, min(chunk_id) AS chunk_start, max(chunk_id) AS chunk_end, count(DISTINCT chunk_id) AS n_chunks, max(depth) AS max_depth FROM chunks GROUP BY ALL")
def chunk_ranges(spark, d):
    return filters.chunk_ranges(table(spark, d, "chunks"))


@INDEX.add("doc_for_chunk", "SELECT DISTINCT v.vec_id AS chunk_id, c.doc_id FROM embeddings v JOIN chunks c ON c.chunk_id = v.vec_id")
def doc_for_chunk(spark, d):
    return filters.doc_for_chunk(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id")), table(spark, d, "chunks"))


@INDEX.add("chunk_texts")
def chunk_texts(spark, d):
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).join(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("_b")), "doc_id")
    return c.select("chunk_id", text.chunk_bytes(F.col("_b"), F.col("byte_start"), F.coalesce("byte_end", F.octet_length("_b"))).alias("chunk_text"))


@INDEX.add("hydrate_pointers", f"""
WITH {KEYS_SQL}, m AS (SELECT DISTINCT doc_id FROM keys WHERE bitmap_key = 'type:moc' ORDER BY doc_id LIMIT 20)
SELECT d.doc_id, d.file_path, d.source_type, d.auto_type, d.last_indexed AS last_modified,
  coalesce((SELECT list(c.chunk_id ORDER BY c.byte_start, c.chunk_id) FROM (SELECT DISTINCT doc_id, chunk_id, byte_start FROM chunks) c WHERE c.doc_id = d.doc_id), []) AS chunk_ids
FROM documents d WHERE d.doc_id IN (FROM m)""")
def hydrate_pointers(spark, d):
    ids = filters.page(filters.match(_keys(spark, d, "type:"), "type:moc"))
    rows = filters.hydrate(ids, table(spark, d, "documents"), table(spark, d, "chunks"), ["type:moc"])
    return rows.select("doc_id", "file_path", "source_type", "auto_type", "last_modified", F.transform("chunks", lambda c: c.chunk_id).alias("chunk_ids"))


@INDEX.add("inspect_documents", f"WITH {KEYS_SQL} SELECT d.doc_id, lower(hex(d.blake3_hash)) AS content_hash, list_sort(list(k.bitmap_key)) AS keys FROM documents d JOIN keys k USING (doc_id) GROUP BY ALL")
def inspect_documents(spark, d):
    """What inspection shows, for every document."""
    docs = table(spark, d, "documents")
    k = _keys(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_set("bitmap_key")).alias("keys"))
    return docs.select("doc_id", F.lower(F.hex("blake3_hash")).alias("content_hash")).join(k, "doc_id")


_SYNC_SQL = """
WITH s AS (SELECT file_path, content_hash AS h FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY updated_at DESC, (content_hash IS NOT NULL) DESC, fetch_id DESC) AS rn FROM item_fetches) WHERE rn = 1),
j AS (SELECT coalesce(s.file_path, d.file_path) AS file_path, d.doc_id, s.file_path IS NOT NULL AS here, d.doc_id IS NOT NULL AS known, s.h, d.blake3_hash AS old, t.doc_id IS NOT NULL AS gone
  FROM s FULL JOIN (SELECT * FROM documents WHERE source_type IN ('confluence', 'jira', 'slack')) d ON d.file_path = s.file_path LEFT JOIN (SELECT DISTINCT doc_id FROM tombstones) t ON t.doc_id = d.doc_id),
actions AS (SELECT file_path, doc_id, CASE WHEN NOT known THEN CASE WHEN h IS NULL THEN 'unread' ELSE 'indexed' END WHEN h IS NOT NULL AND (gone OR old IS DISTINCT FROM h) THEN 'updated'
  WHEN here THEN 'skipped' WHEN NOT gone THEN 'tombstoned' END AS action FROM j)
"""


def _sync(spark, d):
    docs = table(spark, d, "documents").where("source_type IN ('confluence', 'jira', 'slack')")
    return ingest.snapshot_actions(current_fetches(table(spark, d, "item_fetches")), docs, None, table(spark, d, "tombstones"))


@INDEX.add("snapshot_sync", _SYNC_SQL + "SELECT file_path, doc_id, action FROM actions WHERE action IS NOT NULL")
def snapshot_sync(spark, d):
    return _sync(spark, d)


@INDEX.add("snapshot_counts", _SYNC_SQL + """SELECT count(*) FILTER (WHERE action = 'indexed') AS indexed, count(*) FILTER (WHERE action = 'updated') AS updated,
  count(*) FILTER (WHERE action = 'skipped') AS skipped, count(*) FILTER (WHERE action = 'tombstoned') AS tombstoned FROM actions""")
def snapshot_counts(spark, d):
    return ingest.action_counts(_sync(spark, d))


@INDEX.add("change_feed_latest", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def change_feed_latest(spark, d):
    """Of every user the last event, and how many there were."""
    e = table(spark, d, "events").where("user_id IS NOT NULL")
    best = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("b"), F.count("*").alias("n"))
    return best.select("user_id", "b.event_id", "b.event_type", "n")


@INDEX.add("compact_chunks", "SELECT chunk_id, count(*) AS n FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM tombstones WHERE doc_id IS NOT NULL) GROUP BY ALL")
def compact_chunks(spark, d):
    out = ingest.compact(table(spark, d, "tombstones"), chunks=table(spark, d, "chunks"))
    return out["chunks"].groupBy("chunk_id").agg(F.count("*").alias("n"))


@INDEX.add("compact_edges", "SELECT from_id, to_id, count(*) AS n FROM doc_links WHERE from_id NOT IN (SELECT doc_id FROM tombstones WHERE doc_id IS NOT NULL) AND to_id NOT IN (SELECT doc_id FROM tombstones WHERE doc_id IS NOT NULL) GROUP BY ALL")
def compact_edges(spark, d):
    out = ingest.compact(table(spark, d, "tombstones"), edges=table(spark, d, "doc_links"))
    return out["edges"].groupBy("from_id", "to_id").agg(F.count("*").alias("n"))


@INDEX.add("key_diff", f"""
WITH {KEYS_SQL}, live AS (SELECT * FROM keys WHERE doc_id NOT IN (SELECT doc_id FROM tombstones WHERE doc_id IS NOT NULL)),
coded AS (SELECT doc_id, bitmap_key FROM keys WHERE doc_id IN ({_has('source:code')}))
SELECT *, 'added' AS change FROM (FROM coded EXCEPT FROM live) UNION ALL SELECT *, 'removed' FROM (FROM live EXCEPT FROM coded)""")
def key_diff(spark, d):
    k = _keys(spark, d)
    live = k.join(table(spark, d, "tombstones").select("doc_id"), "doc_id", "left_anti")
    return filters.key_diff(live, k.join(filters.match(k, "source:code"), "doc_id", "left_semi"))


EDGES_SQL = """edges AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, kind ORDER BY created_at DESC, category DESC, weight DESC NULLS LAST, byte_offset DESC NULLS LAST) AS rn FROM doc_links
  WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND kind IS NOT NULL) WHERE rn = 1)"""


def _edges(spark, d):
    return graph.distinct_edges(table(spark, d, "doc_links"))


def _seeds(spark, d):
    """Task notes."""
    return table(spark, d, "documents").where("auto_type = 'task'").select("doc_id")


SEEDS_SQL = "seeds AS (SELECT DISTINCT doc_id FROM documents WHERE auto_type = 'task')"


@INDEX.add("edges_distinct", f"WITH {EDGES_SQL} SELECT from_id, to_id, kind, category, created_at FROM edges")
def edges_distinct(spark, d):
    return _edges(spark, d).select("from_id", "to_id", "kind", "category", "created_at")


@INDEX.add("edges_by_category", f"WITH {EDGES_SQL} SELECT category, count(*) AS n FROM edges GROUP BY ALL")
def edges_by_category(spark, d):
    return _edges(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@INDEX.add("graph_stats", f"WITH {EDGES_SQL} SELECT count(*) AS edge_count, (SELECT count(*) FROM (SELECT from_id FROM edges UNION SELECT to_id FROM edges)) AS node_count FROM edges")
def graph_stats(spark, d):
    return graph.stats(_edges(spark, d)).select("edge_count", "node_count")


for _name, _direction, _condition in (("neighbours_out", "outgoing", "e.from_id = s.doc_id"), ("neighbours_in", "incoming", "e.to_id = s.doc_id"), ("neighbours_both", "both", "e.from_id = s.doc_id OR e.to_id = s.doc_id")):

    @INDEX.add(_name, f"WITH {EDGES_SQL}, {SEEDS_SQL} SELECT s.doc_id AS seed, CASE WHEN {'e.from_id = s.doc_id' if _direction != 'incoming' else 'false'} THEN e.to_id ELSE e.from_id END AS doc_id, e.kind FROM edges e JOIN seeds s ON {_condition}")
    def _neighbours(spark, d, direction=_direction):
        return graph.neighbours(_edges(spark, d), _seeds(spark, d), direction).select("seed", "doc_id", "kind")


@INDEX.add("neighbours_filtered", f"WITH {EDGES_SQL}, {SEEDS_SQL} SELECT s.doc_id AS seed, e.to_id AS doc_id, e.kind FROM edges e JOIN seeds s ON e.from_id = s.doc_id WHERE e.category = 'reference' AND e.kind IN ('ref:wikilink', 'ref:link')")
def neighbours_filtered(spark, d):
    where = graph.AllOf((graph.Category("reference"), graph.Kinds(("ref:wikilink", "ref:link"))))
    return graph.neighbours(_edges(spark, d), _seeds(spark, d), "outgoing", where).select("seed", "doc_id", "kind")


_WALK_SQL = "walk(doc_id, hop) AS (SELECT doc_id, 0 FROM seeds UNION SELECT e.to_id, w.hop + 1 FROM walk w JOIN edges e ON e.from_id = w.doc_id WHERE w.hop < {hops})"
for _name, _hops in (("expand_1hop", 1), ("expand_2hop", 2)):

    @INDEX.add(_name, f"WITH RECURSIVE {EDGES_SQL}, {SEEDS_SQL}, {_WALK_SQL.format(hops=_hops)} SELECT doc_id, CAST(min(hop) AS INT) AS hop_distance FROM walk GROUP BY ALL")
    def _expand(spark, d, hops=_hops):
        return graph.expand(_edges(spark, d), _seeds(spark, d), hops)


_START_SQL = f"start AS (SELECT min(from_id) AS doc_id FROM edges)"  # noqa: F541


@INDEX.add("reachable", f"WITH RECURSIVE {EDGES_SQL}, {_START_SQL}, walk(doc_id) AS (SELECT e.to_id FROM edges e JOIN start s ON e.from_id = s.doc_id UNION SELECT e.to_id FROM walk w JOIN edges e ON e.from_id = w.doc_id) SELECT doc_id FROM walk WHERE doc_id <> (SELECT doc_id FROM start)")
def reachable(spark, d):
    e = _edges(spark, d)
    return graph.reachable(e, e.agg(F.min("from_id")).first()[0]).select("doc_id")


@INDEX.add("shortest_path", f"""
WITH RECURSIVE {EDGES_SQL}, ends AS (SELECT min(from_id) AS a FROM edges),
walk(doc_id, hop) AS (SELECT a, 0 FROM ends UNION SELECT e.to_id, w.hop + 1 FROM walk w JOIN edges e ON e.from_id = w.doc_id WHERE w.hop < 12),
least AS (SELECT doc_id, min(hop) AS hop FROM walk GROUP BY ALL), goal AS (SELECT max(doc_id) AS b FROM least WHERE hop <= 4),
back(doc_id, hop) AS (SELECT b, (SELECT hop FROM least WHERE doc_id = b) FROM goal UNION ALL
  SELECT (SELECT min(e.from_id) FROM edges e JOIN least l ON l.doc_id = e.from_id AND l.hop = k.hop - 1 WHERE e.to_id = k.doc_id), k.hop - 1 FROM back k WHERE k.hop > 0)
SELECT CAST(hop AS INT) AS position, doc_id FROM back""")
def shortest_path(spark, d):
    """From the smallest linking document to the greatest within four hops of it."""
    e = _edges(spark, d)
    start = e.agg(F.min("from_id")).first()[0]
    end = graph.expand(e, spark.createDataFrame([(start,)], "doc_id long"), 4).agg(F.max("doc_id")).first()[0]
    return spark.createDataFrame(list(enumerate(graph.shortest_path(e, start, end))), "position int, doc_id long")


@INDEX.add("in_degree", f"WITH {EDGES_SQL} SELECT to_id AS doc_id, CAST(count(*) AS DOUBLE) AS score FROM edges GROUP BY ALL")
def in_degree(spark, d):
    return graph.degrees(_edges(spark, d), "in")


@INDEX.add("out_degree", f"WITH {EDGES_SQL} SELECT from_id AS doc_id, CAST(count(*) AS DOUBLE) AS score FROM edges GROUP BY ALL")
def out_degree(spark, d):
    return graph.degrees(_edges(spark, d), "out")


@INDEX.add("top_central", f"WITH {EDGES_SQL} SELECT to_id AS doc_id, CAST(count(*) AS DOUBLE) AS score FROM edges GROUP BY ALL ORDER BY score DESC, doc_id LIMIT 10")
def top_central(spark, d):
    return graph.central(_edges(spark, d), "indegree", 10)


@INDEX.add("degree_restricted", f"""WITH {EDGES_SQL}, live AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tombstones WHERE doc_id IS NOT NULL))
SELECT to_id AS doc_id, CAST(count(*) AS DOUBLE) AS score FROM edges WHERE from_id IN (FROM live) AND to_id IN (FROM live) GROUP BY ALL""")
def degree_restricted(spark, d):
    live = table(spark, d, "documents").join(table(spark, d, "tombstones").select("doc_id"), "doc_id", "left_anti")
    return graph.degrees(graph.restrict(_edges(spark, d), live), "in")


def _pagerank_sql(iterations, damping):
    steps = "".join(f""",
r{i + 1} AS (SELECT n.doc_id, {1 - damping} / c.n + {damping} * (coalesce(g.got, 0) + l.loose / c.n) AS score FROM nodes n
  LEFT JOIN (SELECT p.dst, sum(r.score * p.share) AS got FROM shares p JOIN r{i} r ON r.doc_id = p.src GROUP BY ALL) g ON g.dst = n.doc_id,
  (SELECT count(*) AS n FROM nodes) c, (SELECT coalesce(sum(score), 0) AS loose FROM r{i} WHERE doc_id NOT IN (SELECT src FROM shares)) l)""" for i in range(iterations))
    return f"""WITH {EDGES_SQL}, pairs AS (SELECT from_id AS src, to_id AS dst, count(*) AS w FROM edges GROUP BY ALL),
shares AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM pairs), nodes AS (SELECT src AS doc_id FROM shares UNION SELECT dst FROM shares),
r0 AS (SELECT doc_id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS score FROM nodes){steps}
SELECT doc_id, round(score, 9) AS score FROM r{iterations}"""


@INDEX.add("pagerank_5", _pagerank_sql(5, 0.85))
def pagerank_5(spark, d):
    return graph.pagerank(_edges(spark, d), 5).select("doc_id", F.round("score", 9).alias("score"))


@INDEX.add("pagerank")
def pagerank(spark, d):
    """The production run: 100 iterations; pagerank_5 only checks the steps against SQL."""
    return graph.pagerank(_edges(spark, d))


@INDEX.add("central_pagerank")
def central_pagerank(spark, d):
    return graph.central(_edges(spark, d), "pagerank", 10)


_PENDING_SQL = r"""p AS (SELECT from_id, target_ref, kind, min(created_at) AS created_at FROM doc_links_pending WHERE from_id IS NOT NULL AND target_ref IS NOT NULL AND kind IS NOT NULL GROUP BY ALL),
stems AS (SELECT regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem, min(doc_id) AS doc_id FROM documents GROUP BY ALL),
resolved AS (SELECT p.*, coalesce(d.doc_id, s.doc_id) AS to_id FROM p LEFT JOIN documents d ON d.file_path = p.target_ref LEFT JOIN stems s ON s.stem = p.target_ref)"""


@INDEX.add("link_resolution", f"WITH {_PENDING_SQL} SELECT from_id, to_id, kind, created_at FROM resolved WHERE to_id IS NOT NULL")
def link_resolution(spark, d):
    return graph.resolve(table(spark, d, "doc_links_pending"), table(spark, d, "documents"))[0].select("from_id", "to_id", "kind", "created_at")


@INDEX.add("pending_links", f"WITH {_PENDING_SQL} SELECT from_id, target_ref, kind, created_at FROM resolved WHERE to_id IS NULL")
def pending_links(spark, d):
    return graph.resolve(table(spark, d, "doc_links_pending"), table(spark, d, "documents"))[1].select("from_id", "target_ref", "kind", "created_at")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_COSINE_SQL = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _first_vector(v):
    return v.orderBy("id").select("embedding").first()[0]


@INDEX.add("cosine_topk", f"SELECT b.vec_id AS id, round({_COSINE_SQL}, 6) AS score FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b ORDER BY {_COSINE_SQL} DESC, b.vec_id LIMIT 10")
def cosine_topk(spark, d):
    """The ten vectors nearest to the first one."""
    v = _vectors(spark, d)
    return vectors.nearest(v, _first_vector(v)).select("id", F.round("score", 6).alias("score"))


@INDEX.add("cosine_topk_filtered", f"SELECT b.vec_id AS id, round({_COSINE_SQL}, 6) AS score FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b WHERE b.label = (SELECT max(label) FROM embeddings) ORDER BY {_COSINE_SQL} DESC, b.vec_id LIMIT 10")
def cosine_topk_filtered(spark, d):
    v = _vectors(spark, d)
    top = v.agg(F.max("label")).scalar()
    return vectors.nearest(v, _first_vector(v), 10, v.where(F.col("label") == top)).select("id", F.round("score", 6).alias("score"))


@INDEX.add("cosine_scores", f"SELECT b.vec_id AS id, round({_COSINE_SQL}, 6) AS score FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b")
def cosine_scores(spark, d):
    """Every vector's cosine with the first one, by the built-in expression."""
    v = _vectors(spark, d)
    q = F.array(*(F.lit(float(x)) for x in _first_vector(v)))
    return v.select("id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("score"))


@INDEX.add("cosine_batch", f"""SELECT query_id, id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COSINE_SQL}, 6) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE_SQL} DESC, b.vec_id) AS INT) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5""")
def cosine_batch(spark, d):
    """The stated query set (ids divisible by 100) against all vectors, in blocks of queries."""
    v = _vectors(spark, d)
    return vectors.nearest_for_all(v, v.where("id % 100 = 0"), 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@INDEX.add("cosine_batch_filtered", f"""SELECT query_id, id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COSINE_SQL}, 6) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE_SQL} DESC, b.vec_id) AS INT) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND b.label = (SELECT max(label) FROM embeddings)) WHERE rank <= 5""")
def cosine_batch_filtered(spark, d):
    """The same query set against the vectors of one label."""
    v = _vectors(spark, d)
    top = v.agg(F.max("label")).scalar()
    return vectors.nearest_for_all(v, v.where("id % 100 = 0"), 5, candidates=v.where(F.col("label") == top)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@INDEX.add("ann_batch")
def ann_batch(spark, d):
    """The same query set through the cell index."""
    v = _vectors(spark, d)
    return vectors.CellIndex(v).search(v.where("id % 100 = 0"), 5)


@INDEX.add("semantic_three_stage", f"""
WITH RECURSIVE {KEYS_SQL}, {EDGES_SQL}, seeds AS (SELECT DISTINCT doc_id FROM keys WHERE bitmap_key = 'source:obsidian' AND doc_id NOT IN (SELECT doc_id FROM tombstones)),
docs AS (SELECT doc_id FROM seeds UNION SELECT e.to_id FROM edges e JOIN seeds s ON e.from_id = s.doc_id WHERE e.to_id NOT IN (SELECT doc_id FROM tombstones)),
cand AS (SELECT DISTINCT chunk_id, doc_id FROM chunks WHERE doc_id IN (FROM docs))
SELECT c.doc_id, c.chunk_id, round({_COSINE_SQL}, 6) AS score FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) a, embeddings b JOIN cand c ON c.chunk_id = b.vec_id
ORDER BY {_COSINE_SQL} DESC, c.chunk_id LIMIT 10""")
def semantic_three_stage(spark, d):
    """Notes, expanded by one hop, then their chunks nearest to the first vector."""
    from waymark.engine import Engine

    v = _vectors(spark, d)
    e = Engine(spark, documents=table(spark, d, "documents"), chunks=table(spark, d, "chunks"), doc_keys=_keys(spark, d, "source:"), edges=_edges(spark, d), tombstones=table(spark, d, "tombstones"), vectors=v)
    return e.semantic("", parse_filter("source:obsidian"), 10, hops=1, query_vector=_first_vector(v)).select("doc_id", "chunk_id", F.round("score", 6).alias("score"))


def _files(spark, d, kind, parser):
    docs = spread(_documents(spark, d)).where((F.col("source_type") == kind) & F.col("text").isNotNull())
    return docs.select("doc_id", "file_path", F.col("text").cast("binary").alias("content"), F.lit(parser).alias("parser"))


def _parsed(spark, d, kind, parser):
    from waymark.sources.parsers import parse_files

    files = _files(spark, d, kind, parser)
    return parse_files(files), files.select("doc_id", "file_path")


@INDEX.add("markdown_chunks")
def markdown_chunks(spark, d):
    from waymark.sources.parsers import chunk_rows

    return chunk_rows(*_parsed(spark, d, "obsidian", "markdown")).select("doc_id", "position", "byte_start", "byte_end", "kind", "label", "depth")


@INDEX.add("code_chunks")
def code_chunks(spark, d):
    from waymark.sources.parsers import chunk_rows

    return chunk_rows(*_parsed(spark, d, "code", "code")).select("doc_id", "position", "byte_start", "byte_end", "kind", "label", "depth", "language", "visibility")


@INDEX.add("note_links", r"""SELECT DISTINCT doc_id, trim(split_part(l, '|', 1)) AS target_ref FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) AS l FROM documents WHERE source_type = 'obsidian') WHERE trim(split_part(l, '|', 1)) <> ''""")
def note_links(spark, d):
    from waymark.sources.parsers import link_rows

    return link_rows(*_parsed(spark, d, "obsidian", "markdown")).select(F.col("from_id").alias("doc_id"), "target_ref").distinct()


@INDEX.add("parsed_keys")
def parsed_keys(spark, d):
    from waymark.sources.parsers import keys_of

    return keys_of(*_parsed(spark, d, "obsidian", "markdown")).unionByName(keys_of(*_parsed(spark, d, "code", "code")))


@INDEX.add("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    from waymark.streaming.feeds import event_counts

    return event_counts(table(spark, d, "events"))


_NOTES_SQL = "notes AS (SELECT * FROM documents WHERE source_type IN ('obsidian', 'code') AND text IS NOT NULL), dead AS (SELECT DISTINCT doc_id FROM tombstones WHERE doc_id IS NOT NULL), live AS (SELECT * FROM notes WHERE doc_id NOT IN (FROM dead))"


@INDEX.add("index_run", f"WITH {_NOTES_SQL} SELECT count(*) AS indexed, 0 AS updated, 0 AS skipped, 0 AS tombstoned FROM notes")
def index_run(spark, d):
    """The first run over all notes and code."""
    return stored.Indexed(spark, d).run(1)


@INDEX.add("index_rerun", f"WITH {_NOTES_SQL} SELECT 0 AS indexed, 0 AS updated, count(*) FILTER (WHERE doc_id NOT IN (FROM dead)) AS skipped, count(*) FILTER (WHERE doc_id IN (FROM dead)) AS tombstoned FROM notes")
def index_rerun(spark, d):
    """A second run, in which the documents that tombstones name are gone."""
    return stored.Indexed(spark, d).run(2)


@INDEX.add("index_documents", f"WITH {_NOTES_SQL} SELECT file_path, source_type, lower(sha256(text)) AS content_hash FROM live")
def index_documents(spark, d):
    """What the index holds of its live documents."""
    t = stored.Indexed(spark, d).engine.tables.pinned()
    return t.documents.join(t.tombstones.select("doc_id"), "doc_id", "left_anti").select("file_path", "source_type", F.lower(F.hex("blake3_hash")).alias("content_hash"))


@INDEX.add("search_index", f"WITH {_NOTES_SQL} SELECT file_path FROM live WHERE source_type = 'code' AND strlen(text) > 1023 OR source_type = 'obsidian' AND strlen(text) <= 1023")
def search_index(spark, d):
    """A filter over the index, hydrated whole."""
    return stored.Indexed(spark, d).engine.search("(source:code AND NOT size:small) OR (source:obsidian AND size:small)", limit=None).select("file_path")


@INDEX.add("search_page", f"WITH {_NOTES_SQL}, numbered AS (SELECT doc_id, row_number() OVER (ORDER BY file_path) AS n FROM notes) SELECT file_path, (SELECT count(*) FROM live WHERE source_type = 'code') AS total_matching FROM live JOIN numbered USING (doc_id) WHERE source_type = 'code' ORDER BY n LIMIT 20 OFFSET 40")
def search_page(spark, d):
    """The third page of a filter over the index; a first run numbers documents by their paths."""
    return stored.Indexed(spark, d).engine.search("source:code", limit=20, offset=40).select("file_path", "total_matching")


@INDEX.add("inspect_path", f"""
WITH {_NOTES_SQL} SELECT file_path, source_type, lower(sha256(text)) AS content_hash, CASE WHEN strlen(text) <= 1023 THEN 'size:small' WHEN strlen(text) <= 10240 THEN 'size:medium' ELSE 'size:large' END AS size_key FROM notes WHERE file_path = (SELECT min(file_path) FROM notes)""")
def inspect_path(spark, d):
    e = stored.Indexed(spark, d).engine
    first = e.tables.documents.agg(F.min("file_path")).first()[0]
    return e.inspect(first).select("file_path", "source_type", "content_hash", F.filter("keys", lambda k: k.startswith("size:"))[0].alias("size_key"))


@INDEX.add("index_links", f"""
WITH {_NOTES_SQL}, l AS (SELECT DISTINCT doc_id, trim(split_part(x, '|', 1)) AS t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)) AS x FROM notes WHERE source_type = 'obsidian') WHERE trim(split_part(x, '|', 1)) <> ''),
stems AS (SELECT regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, min(file_path) AS p FROM notes GROUP BY ALL)
SELECT DISTINCT n.file_path AS from_path, coalesce(f.file_path, s.p) AS to_path FROM l JOIN notes n USING (doc_id) LEFT JOIN notes f ON f.file_path = l.t LEFT JOIN stems s ON s.stem = l.t WHERE coalesce(f.file_path, s.p) IS NOT NULL""")
def index_links(spark, d):
    """The links between notes that the index resolved."""
    t = stored.Indexed(spark, d).engine.tables.pinned()
    path = lambda end: t.documents.select(F.col("doc_id").alias(f"{end}_id"), F.col("file_path").alias(f"{end}_path"))
    return t.edges.where("kind = 'ref:wikilink'").join(path("from"), "from_id").join(path("to"), "to_id").select("from_path", "to_path").distinct()


@INDEX.add("semantic_index")
def semantic_index(spark, d):
    """The chunks of code nearest to a text, one hop of links allowed, by the built-in embedder."""
    return stored.Indexed(spark, d).engine.semantic("retry the request after a timeout", "source:code", k=20, hops=1)
