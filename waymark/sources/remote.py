"""Remote sources as Python data sources: wiki spaces, issue projects, chat channels.

The transport is a function from a request path to parsed JSON, so a source reads a live
service, recorded pages or a test's dictionary alike. One partition per space, project or
channel; a partition follows its pages by itself.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.operators.ingest import content_hash
from waymark.operators.manifest import ManifestTable
from waymark.runtime import cut
from waymark.sources.files import parser_of

ITEMS = "source_name string, id string, synthetic_path string, title string, updated_at long, deleted boolean, content string"
Fetch = Callable[[str], dict]


def seconds(iso: str | None) -> int:
    """Unix seconds of an ISO 8601 time, its offset counted; 0 if it is none."""
    try:
        t = datetime.fromisoformat((iso or "").replace("Z", "+00:00"))
    except ValueError:
        return 0
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp())


def wiki_items(fetch: Fetch, name: str, space: str, since: int = 0) -> Iterator[tuple]:
    """Pages of one space, 50 at a time, following the links to the next page."""
    at = f"/rest/api/content?spaceKey={quote(space)}&limit=50&expand=version,body.storage,metadata.labels,ancestors"
    while at:
        page = fetch(at)
        for x in page.get("results", []):
            when = seconds(x.get("version", {}).get("when"))
            if when >= since:
                yield (name, str(x["id"]), f"confluence://{space}/{x['id']}.confluence", x.get("title"), when, x.get("status") == "trashed", json.dumps(x))
        at = page.get("_links", {}).get("next")


def issue_items(fetch: Fetch, name: str, project: str, since: int = 0) -> Iterator[tuple]:
    """Issues of one project by time of change, 50 at a time."""
    jql = f"project = {project}" + (f' AND updated >= "{datetime.fromtimestamp(since, UTC):%Y-%m-%d %H:%M}"' if since else "") + " ORDER BY updated ASC"
    start, total = 0, 1
    while start < total:
        page = fetch(f"/rest/api/2/search?jql={quote(jql)}&startAt={start}&maxResults=50")
        issues, total = page.get("issues", []), page.get("total", 0)
        for x in issues:
            f = x.get("fields", {})
            yield (name, x["key"], f"jira://{project}/{x['key']}.jira", f.get("summary"), seconds(f.get("updated")), False, json.dumps(x))
        if not issues:
            break
        start += len(issues)


def chat_items(fetch: Fetch, name: str, channel: str, since: int = 0) -> Iterator[tuple]:
    """One item per channel and UTC day, its messages in order, whatever their number."""
    cursor, days, label = "", {}, channel
    while True:
        page = fetch(f"/api/conversations.history?channel={quote(channel)}&oldest={since}&limit=200&cursor={quote(cursor)}")
        label = page.get("channel_name", label)
        for m in page.get("messages", []):
            days.setdefault(f"{datetime.fromtimestamp(float(m['ts']), UTC):%Y-%m-%d}", []).append(m)
        cursor = page.get("response_metadata", {}).get("next_cursor", "")
        if not cursor:
            break
    for day, found in sorted(days.items()):
        found.sort(key=lambda m: float(m["ts"]))
        bundle = {"channel_id": channel, "channel_name": label, "date": day, "messages": found}
        yield (name, f"{channel}-{day}", f"slack://{label}/{day}.slack", f"#{label} — {day}", int(float(found[-1]["ts"])), False, json.dumps(bundle))


_ITEMS = {"confluence": wiki_items, "jira": issue_items, "slack": chat_items}


@dataclass
class _Scope(InputPartition):
    kind: str
    name: str
    scope: str
    since: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[_Scope]:
        o = self.options
        return [_Scope(o["kind"], o.get("name", o["kind"]), s.strip(), int(o.get("since", 0))) for s in o["scopes"].split(",") if s.strip()]

    def read(self, part: _Scope) -> Iterator[tuple]:
        yield from _ITEMS[part.kind](self.fetch, part.name, part.scope, part.since)


def remote_source(fetch: Fetch, short_name: str = "waymark_remote") -> type[DataSource]:
    """A data source class over ``fetch``; options: kind (confluence, jira, slack), name, scopes (comma-separated), since."""

    class RemoteSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return ITEMS

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), fetch)

    return RemoteSource


def poll(spark: SparkSession, fetch: Fetch, kind: str, name: str, scopes: list[str], since: int = 0) -> DataFrame:
    """The items of one poll as a table. A failing scope fails the poll, so nothing later counts as read."""
    spark.dataSource.register(remote_source(fetch))
    return spark.read.format("waymark_remote").options(kind=kind, name=name, scopes=",".join(scopes), since=since).load()


def poll_once(spark: SparkSession, fetch: Fetch, kind: str, name: str, scopes: list[str], since: int, now: int, ingest: Callable[[DataFrame], None]) -> tuple[int, int]:
    """(items ingested, time that the next poll starts from): ``now`` if all went well, else ``since``, with nothing ingested.

    Deleted items are handed on with their flag. Ingestion is by content, so items that
    come again after a failure change nothing.
    """
    try:
        items = cut(poll(spark, fetch, kind, name, scopes, since))
    except Exception as e:  # a source may fail in any way
        logging.getLogger(__name__).warning("poll of %s failed: %s", name, str(e).splitlines()[0])
        return 0, since
    n = items.count()
    if n:
        ingest(items)
    return n, now


def poll_due(spark: SparkSession, fetch: Fetch, sources: DataFrame, state: str, now: int, ingest: Callable[[DataFrame], None]) -> DataFrame:
    """Poll every source (name, kind, scopes, poll_interval_secs) that is due at ``now``; gives name, items, last_poll.

    The time that each source was last polled with success is kept under ``state`` as
    rows of a manifest version, published after its items are ingested: a poll that fails
    or breaks off comes again from where the last good one began. Call it in a loop, or
    from a streaming clock, at any interval shorter than the sources'. There is a row a
    configured source, so they are walked through on the driver.
    """
    kept, done = ManifestTable(spark, state), []
    for s in sources.orderBy("name").collect():
        base = kept.version()
        held = kept.read("polls", base)
        row = None if held is None else held.where(F.col("name") == s.name).agg(F.max("last_poll")).first()
        since = row[0] if row and row[0] is not None else 0
        if since and now - since < s.poll_interval_secs:
            continue
        n, at = poll_once(spark, fetch, s.kind, s.name, list(s.scopes), since, now, ingest)
        if at != since:
            kept.commit({"polls": [kept.stage("polls", spark.createDataFrame([(s.name, at)], "name string, last_poll long"))]}, base)
        done.append((s.name, n, at))
    return spark.createDataFrame(done, "name string, items long, last_poll long")


def item_files(items: DataFrame) -> DataFrame:
    """Live items as a file table (file_path, content, content_hash, parser) for ``Engine.sync``."""
    live = items.where("NOT coalesce(deleted, false) AND content IS NOT NULL").select(F.col("synthetic_path").alias("file_path"), F.col("content").cast("binary").alias("content"))
    return live.select("file_path", "content", content_hash(F.col("content")).alias("content_hash"), parser_of(F.col("file_path")).alias("parser"))
