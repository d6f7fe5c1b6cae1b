"""Queries of the language-model operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.llm import conversations, markup, mixing, pii, splitting, subjects, tokenize
from waymark.plans import stored
from waymark.plans.registry import Registry
from waymark.runtime import spread, table

LLM = Registry()


def _documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "source", "source_type"))


def _messages(spark, d):
    return spread(table(spark, d, "slack_messages").select("msg_id", "channel_id", "text"))


@LLM.add("p8_ids")
def p8_ids(spark, d):
    return tokenize.encode(_documents(spark, d), ["doc_id"])


def _mixture(spark, d):
    return mixing.Mixture(_documents(spark, d), table(spark, d, "mix_targets"))


@LLM.add("p9_mixture")
def p9_mixture(spark, d):
    """Every document of the mixture with the number of its copies."""
    return _mixture(spark, d).rows


@LLM.add("p9_shares")
def p9_shares(spark, d):
    return _mixture(spark, d).shares()


@LLM.add("p10_found")
def p10_found(spark, d):
    docs = _documents(spark, d)
    model = subjects.train(docs, table(spark, d, "subject_labels"), table(spark, d, "subjects"))
    return subjects.assign_subjects(docs, model)


def _pieces(spark, d):
    return splitting.split_chunks(table(spark, d, "chunks"), table(spark, d, "documents"))


@LLM.add("p3_found", """
SELECT DISTINCT c.chunk_id FROM chunks c JOIN documents d ON c.doc_id = d.doc_id
WHERE d.text IS NOT NULL
  AND least(coalesce(c.byte_end, 9000000000000000000), strlen(d.text)) - greatest(c.byte_start, 0) > 1500""")
def p3_found(spark, d):
    return _pieces(spark, d).where("piece = 0 AND n_pieces > 1").select("chunk_id").distinct()


@LLM.add("p3_pieces")
def p3_pieces(spark, d):
    return _pieces(spark, d)


@LLM.add("p2_found", r"""
WITH c AS (
  SELECT * FROM (
    SELECT channel_id, CAST(try_cast(trim(ts) AS DECIMAL(20,6)) * 1000000 AS BIGINT) AS us,
      CAST(try_cast(trim(thread_ts) AS DECIMAL(20,6)) * 1000000 AS BIGINT) AS root,
      coalesce(nullif(trim(user_id), ''), nullif(trim(username), '')) AS speaker, text, reply_count,
      coalesce(subtype IN ('tombstone', 'message_deleted'), false) AS gone,
      row_number() OVER (PARTITION BY channel_id, try_cast(trim(ts) AS DECIMAL(20,6)) ORDER BY received_at DESC, msg_id DESC) AS rn
    FROM slack_messages) WHERE rn = 1 AND us IS NOT NULL AND channel_id IS NOT NULL),
threads AS (SELECT DISTINCT channel_id, root FROM c WHERE root IS NOT NULL),
members AS (
  SELECT t.channel_id, t.root, c.us, c.speaker, c.reply_count, regexp_full_match(coalesce(c.text, ''), '[\s\p{Z}\p{C}ᅟᅠㅤﾠ⠀͏︀-️]*') AS blank
  FROM threads t JOIN c ON c.channel_id = t.channel_id AND NOT c.gone AND (c.us = t.root OR c.root = t.root))
SELECT t.channel_id, CAST(t.root // 1000000 AS VARCHAR) || '.' || lpad(CAST(t.root % 1000000 AS VARCHAR), 6, '0') AS thread_ts
FROM threads t LEFT JOIN members m ON m.channel_id = t.channel_id AND m.root = t.root
GROUP BY t.channel_id, t.root
HAVING count(*) FILTER (WHERE m.us = t.root) = 0
  OR count(*) FILTER (WHERE m.us <> t.root) < coalesce(max(m.reply_count) FILTER (WHERE m.us = t.root), 0)
  OR coalesce(bool_and(m.blank), true) OR count(DISTINCT m.speaker) < 2""")
def p2_found(spark, d):
    return conversations.broken_threads(table(spark, d, "slack_messages")).select("channel_id", "thread_ts")


@LLM.add("p2_conversations")
def p2_conversations(spark, d):
    return conversations.conversations(table(spark, d, "slack_messages"), table(spark, d, "chat_members"))


def _cleaned(spark, d):
    return markup.clean_records(_messages(spark, d), spread(table(spark, d, "remote_items").select("feed_id", "source_name", "title")))


@LLM.add("p4_found")
def p4_found(spark, d):
    return _cleaned(spark, d).where("marked").select("record_table", "record_id").distinct()


@LLM.add("p4_clean")
def p4_clean(spark, d):
    """Every text with its markup resolved."""
    return _cleaned(spark, d)


@LLM.add("p4_pages")
def p4_pages(spark, d):
    """Every wiki document as clean text, without what its wiki puts on all pages of a kind."""
    return markup.clean_pages(table(spark, d, "documents"))


#: Fields trained in this process, by the session and the state of the table they were trained on.
_FIELDS: dict[str, pii.Field] = {}


def _masked(spark, d):
    messages, key = _messages(spark, d), stored.home(spark, d, "field", "slack_messages")
    if key not in _FIELDS:
        _FIELDS[key] = pii.train(table(spark, d, "slack_messages"))
    return pii.find_and_mask(messages, ["msg_id"], field=_FIELDS[key])


@LLM.add("p6_found")
def p6_found(spark, d):
    return _masked(spark, d).select("msg_id", F.explode("pii_types").alias("pii_type")).distinct()


@LLM.add("p6_masked")
def p6_masked(spark, d):
    """Every message with its personal information replaced by placeholders."""
    return _masked(spark, d).select("msg_id", "masked")
