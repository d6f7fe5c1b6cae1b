"""Problem 2: rebuilding conversations from message rows, by disentangling channels.

Of every message the row received last counts. Every message gets one parent: the start
of its thread if it names one, else the likeliest of the messages before it in its
channel, judged by the time between (in minutes and by the channel's pace), mentions,
shared words and who speaks, or none. The links form trees, and each tree is a
conversation. The weights are trained on the threads that messages name. How far back a
link may go follows from them: beyond ``LinkScore.reach`` no message can have even odds. Channels are cut into
time buckets that repeat that much of the bucket before, so a channel with a third of
all messages is spread over tasks and no task holds more than the messages within reach
of one.
"""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.fitting import logistic
from waymark.operators.incremental import newest_per_key
from waymark.operators.registry import rank_within
from waymark.runtime import cut

#: Subtypes of rows that say a message is gone, and of messages that nobody wrote (fixed values).
GONE = ("tombstone", "message_deleted")
SYSTEM = ("channel_join", "channel_leave", "channel_topic")
#: Characters that show nothing: white space, separators, controls, formats and blank-looking letters.
BLANK = r"^[\s\p{Z}\p{C}\x{115F}\x{1160}\x{3164}\x{FFA0}\x{2800}\x{034F}\x{FE00}-\x{FE0F}]*$"

_MENTION = re.compile(r"<@([A-Z0-9]+)")
_WORD = re.compile(r"[^\W_]{3,}")


@dataclass(frozen=True)
class LinkScore:
    """Log odds that a message answers another.

    Time counts by its logarithm, in minutes and in multiples of the channel's pace (its
    mean gap between messages). Messages of at most two words ("on it") are more likely
    answers. A link is made where the odds are at least even; of equal ones the later
    parent wins. Neither weight of time may be above zero.
    """

    base: float = -0.4
    per_time: float = -0.5
    per_pace: float = -0.2
    mention: float = 3.0
    overlap: float = 4.0
    same_speaker: float = 0.5
    short: float = 0.3

    def weights(self) -> tuple[float, ...]:
        return (self.base, self.per_time, self.per_pace, self.mention, self.overlap, self.same_speaker, self.short)

    def time(self, gap: float, pace: float) -> float:
        """What ``gap`` seconds take from the odds in a channel with a message every ``pace`` seconds."""
        return self.per_time * math.log1p(gap / 60) + self.per_pace * math.log1p(gap / pace)

    def most(self) -> float:
        """The odds where all that can speak for a link does, with no time between."""
        return self.base + sum(max(w, 0.0) for w in (self.mention, self.overlap, self.same_speaker, self.short))

    def reach(self, pace: float) -> int | None:
        """Microseconds beyond which even all that speaks for a link leaves the odds below even; None without such a bound."""
        most = self.most()
        if most < 0:
            return 0
        if most + self.time(1e12, pace) >= 0:
            return None
        low, high = 0.0, 1e12
        while high - low > max(1.0, 1e-3 * high):
            mid = math.sqrt(max(low, 1.0) * high) if high > 4 * max(low, 1.0) else (low + high) / 2
            low, high = (mid, high) if most + self.time(mid, pace) >= 0 else (low, mid)
        return math.ceil(high * 1e6)

    def of(self, gap: float, pace: float, mentioned: bool, shared: float, same: bool, short: bool) -> float:
        return sum(w * x for w, x in zip(self.weights(), self.features(gap, pace, mentioned, shared, same, short), strict=True))

    @staticmethod
    def features(gap: float, pace: float, mentioned: bool, shared: float, same: bool, short: bool) -> tuple[float, ...]:
        return (1.0, math.log1p(gap / 60), math.log1p(gap / pace), float(mentioned), shared, float(same), float(short))


#: Seconds of a channel in one bucket at least, and reaches; seconds of a stretch of a channel that is trained on whole; messages and pairs that link weights are trained on at most; threads beside its own that a message is always told from; stretches that those messages come from at least, if there are as many; channels whose pace and reach are broadcast at most.
BUCKET, REACHES, STRETCH, TRAIN_MESSAGES, TRAIN_PAIRS, RIVALS, TRAIN_STRETCHES, BROADCAST_CHANNELS = 21_600, 4, 1_209_600, 20_000, 60_000, 3, 32, 50_000


def micros(ts: Column) -> Column:
    """A message time as a count of microseconds, however many decimals it is written with; null if it is none or none before the year 2255."""
    seconds = F.trim(ts).try_cast("decimal(20,6)")
    return F.when(F.abs(seconds) < 9_000_000_000, (seconds * 1_000_000).cast("long"))


def written(us: Column) -> Column:
    """Microseconds as seconds with exactly six decimals."""
    return F.concat(F.floor(us / F.lit(1_000_000)).cast("string"), F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))


def counting_messages(messages: DataFrame) -> DataFrame:
    """The row of every message that counts: channel_id, us, thread_us, speaker, text, subtype, reply_count, gone.

    Received last, of equal times the greatest msg_id. Rows without a channel or a time
    that is a number name no message and are left out. A blank thread_ts is none; the
    speaker is the user_id, else the username, null where both are missing or blank.
    """
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    m = messages.select(
        "channel_id", micros(F.col("ts")).alias("us"), micros(F.col("thread_ts")).alias("thread_us"), F.coalesce(said("user_id"), said("username")).alias("speaker"),
        "text", "subtype", "reply_count", "received_at", "msg_id",
    )
    best = newest_per_key(m, ["channel_id", "us"], [F.col("received_at"), F.col("msg_id")], ["thread_us", "speaker", "text", "subtype", "reply_count"])
    return best.withColumn("gone", F.coalesce(F.col("subtype").isin(*GONE), F.lit(False)))


def with_starts(counting: DataFrame) -> DataFrame:
    """``counting`` with named, whether some row of the channel names a message as its thread; such messages that name none name themselves.

    So the start of a thread is never judged, and stays in one tree with its replies.
    """
    named = counting.where("thread_us IS NOT NULL").select(F.col("channel_id").alias("_nc"), F.col("thread_us").alias("_nt")).distinct()
    out = counting.join(named, (F.col("channel_id") == F.col("_nc")) & (F.col("us") == F.col("_nt")), "left")
    return out.withColumn("named", F.col("_nt").isNotNull()).withColumn("thread_us", F.coalesce("thread_us", "_nt")).drop("_nc", "_nt")


def _by_channel(rows: DataFrame, channels: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``channels`` says of their channel; up to BROADCAST_CHANNELS are sent to every task, so no row moves for it."""
    channels = cut(channels)
    few = channels.limit(BROADCAST_CHANNELS + 1).count() <= BROADCAST_CHANNELS
    return rows.join(F.broadcast(channels) if few else channels, F.col("channel_id") == F.col(key)).drop(key)


def with_pace(counting: DataFrame) -> DataFrame:
    """``counting`` with pace, the mean seconds between the messages of its channel (a day in a channel of one)."""
    span = (F.max("us") - F.min("us")) / F.lit(1e6)
    pace = counting.groupBy(F.col("channel_id").alias("_pc")).agg(F.when(span > 0, F.greatest(span / F.count("*"), F.lit(1e-3))).otherwise(86_400.0).alias("pace"))
    return _by_channel(counting, pace, "_pc")


def _shared(a: frozenset, b: frozenset) -> float:
    return len(a & b) / (1 + min(len(a), len(b))) if a and b else 0.0


class _Message:
    __slots__ = ("us", "speaker", "text", "root", "far", "_words")

    def __init__(self, us: int, speaker: str | None, text: str | None, root: int, far: bool):
        self.us, self.speaker, self.text, self.root, self.far, self._words = us, speaker, text, root, far, None

    @property
    def words(self) -> frozenset:
        if self._words is None:
            self._words = frozenset(_WORD.findall(self.text.lower())) if self.text else frozenset()
        return self._words


class _Recent:
    """The messages that later ones may answer, in order and by speaker; where shared words weigh more than INDEXED, by word too."""

    INDEXED = 1.0

    def __init__(self, score: LinkScore):
        self.score, self.indexed = score, score.overlap > self.INDEXED
        self.clear(86_400.0)

    def clear(self, pace: float) -> None:
        """Begin a channel, or a bucket of one, of this pace."""
        self.pace, self.reach = pace, self.score.reach(pace)
        self.held: deque = deque()
        self.by: defaultdict = defaultdict(deque)
        self.having: defaultdict = defaultdict(deque)

    def add(self, m: _Message) -> None:
        self.held.append(m)
        self.by[m.speaker].append(m)
        if self.indexed:
            for w in m.words:
                self.having[w].append(m)

    def forget(self, us: int) -> None:
        """Drop what is out of the reach of a message at ``us``."""
        while self.reach is not None and self.held and self.held[0].us < us - self.reach:
            old = self.held.popleft()
            self.by[old.speaker].popleft()
            if not self.by[old.speaker]:
                del self.by[old.speaker]
            if self.indexed:
                for w in old.words:
                    self.having[w].popleft()
                    if not self.having[w]:
                        del self.having[w]

    def likeliest(self, new: _Message) -> tuple[float, _Message] | None:
        """The best odds of all messages held and the latest message that has them, None if there is no message.

        Messages of the same speaker, of those it names and of the others are walked back
        apart, each until time alone has taken what words could bring. Where words have an
        index, a walk takes only the latest of its kind, and those that share words are
        walked back word by word, the rarest first; a message without the words before
        shares at most the ``left`` others, so once that can't beat the best at its time
        no older one can.
        """
        score, us, speaker = self.score, new.us, new.speaker
        named = set(_MENTION.findall(new.text)) if new.text and "<@" in new.text else set()
        short = len(new.words) < 3
        best, found, judged = -math.inf, None, set()
        gain = max(score.overlap, 0.0) * len(new.words) / (1 + len(new.words))

        def judge(m: _Message) -> None:
            nonlocal best, found
            shared = _shared(new.words, m.words) if score.overlap else 0.0
            s = score.of((us - m.us) / 1e6, self.pace, m.speaker is not None and m.speaker in named, shared, m.speaker is not None and m.speaker == speaker, short)
            if s > best or (s == best and m.us > found.us):
                best, found = s, m

        def walk(messages: Iterator[_Message], most: float) -> None:
            for m in messages:
                if most + score.time((us - m.us) / 1e6, self.pace) + 1e-9 < best:
                    break
                if m.us not in judged:
                    judged.add(m.us)
                    judge(m)

        plain = score.base + score.short * short
        own = {*named, speaker} - {None}
        kinds = [(reversed(self.by[who]), plain + score.mention * (who in named) + score.same_speaker * (who == speaker)) for who in own if who in self.by]
        kinds.append(((m for m in reversed(self.held) if m.speaker not in own), plain))
        for messages, most in kinds:
            walk(itertools.islice(messages, 1) if self.indexed else messages, most + gain)
        if self.indexed:
            most = plain + max(score.mention, 0.0) * bool(named) + max(score.same_speaker, 0.0) * (speaker is not None)
            mine = sorted((w for w in new.words if w in self.having), key=lambda w: (len(self.having[w]), w))
            for i, w in enumerate(mine):
                left = len(mine) - i
                walk(reversed(self.having[w]), most + score.overlap * left / (1 + left))
        return None if found is None else (best, found)


def _link_stream(score: LinkScore, keep_text: bool):
    """Judge the messages of sorted buckets one after another, holding those within reach only; what isn't needed to judge passes as it is."""
    kept = ("speaker", "shown", "reply_count", "gone", "named", *(["text"] if keep_text else []))

    def values(c: pa.Array) -> list:
        return c.to_numpy(zero_copy_only=False).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, recent = None, _Recent(score)
        for b in batches:
            out = []
            thread = b["thread_us"]
            read = (values(b[c]) for c in ("channel_id", "bucket", "us", "speaker", "text", "judged", "context", "pace"))
            for channel, bucket, us, speaker, text, judged, context, pace, threaded, thread_us in zip(*read, values(thread.is_valid()), values(thread.fill_null(0)), strict=True):
                if held != (channel, bucket):
                    held = (channel, bucket)
                    recent.clear(pace)
                recent.forget(us)
                parent, odds = None, None
                new = _Message(us, speaker, text, us, context)  # where a message of the bucket before belongs isn't known here
                if threaded:
                    new.root, new.far, parent = thread_us, False, None if thread_us == us else thread_us
                elif judged and not context and (likeliest := recent.likeliest(new)) is not None:
                    odds, m = likeliest
                    if odds >= 0:
                        parent, new.root, new.far = m.us, m.root, m.far
                if judged or threaded:
                    recent.add(new)
                if not context:
                    out.append((parent, new.root, new.far, "thread" if threaded else "judged" if parent is not None else "start", odds))
            own = b.filter(pc.invert(b["context"]))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([own["channel_id"], own["us"], *made, *(own[c] for c in kept)], ["channel_id", "us", "parent_us", "root_us", "far", "link", "odds", *kept])

    return run


def _reaches(score: LinkScore):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(reach=pd.array([score.reach(p) for p in pdf.pace], dtype="Int64"))

    return run


def links(starts: DataFrame, score: LinkScore = LinkScore(), keep_text: bool = False) -> DataFrame:  # noqa: B008
    """Every counting message (``with_starts``, ``with_pace``) with its parent and the root that its bucket knows of.

    channel_id, us, parent_us, root_us, far (whether the root is of the bucket before and may
    itself belong elsewhere), link ("thread", "judged" or "start"), odds and what an audit needs:
    speaker, shown (whether its text says anything), reply_count, gone, named.
    Deleted and system messages neither answer nor are answered, save in the thread they name.
    A message that others name as their thread starts it, whether or not it says so itself.
    A bucket is several times as wide as the reach of its channel; without a bound a channel is one bucket.
    """
    if score.per_time > 0 or score.per_pace > 0:
        raise ValueError("links can't become likelier with time")
    reach = starts.select(F.col("channel_id").alias("_rc"), "pace").distinct().mapInPandas(_reaches(score), "_rc string, pace double, reach long").drop("pace")
    m = _by_channel(starts, reach, "_rc")
    wide = F.greatest(F.lit(BUCKET * 1_000_000), F.col("reach") * REACHES)
    bucket = F.when(F.col("reach").isNull(), F.lit(0)).otherwise(F.floor(F.col("us") / wide))
    judged = ~F.col("gone") & ~F.coalesce(F.col("subtype").isin(*SYSTEM), F.lit(False))
    shown = ~F.coalesce("text", F.lit("")).rlike(BLANK)
    again = F.col("reach").isNotNull() & (F.pmod(F.col("us"), wide) >= wide - F.col("reach"))  # in reach of the next bucket
    m = m.select(
        "channel_id", bucket.cast("long").alias("bucket"), "us", "thread_us", "speaker", "text", judged.alias("judged"), shown.alias("shown"), F.col("reply_count").cast("int").alias("reply_count"), "gone", "named", "pace",
        F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    m = m.select("channel_id", (F.col("bucket") + F.col("_copy")).alias("bucket"), "us", "thread_us", "speaker", "text", "judged", (F.col("_copy") == 1).alias("context"), "shown", "reply_count", "gone", "named", "pace")
    ordered = m.repartition("channel_id", "bucket").sortWithinPartitions("channel_id", "bucket", "us")
    schema = "channel_id string, us long, parent_us long, root_us long, far boolean, link string, odds double, speaker string, shown boolean, reply_count int, gone boolean, named boolean" + ", text string" * keep_text
    return ordered.mapInArrow(_link_stream(score, keep_text), schema)


def _training_pairs(score: LinkScore):
    """Of the asked messages in whole stretches of channels: the features of the last message of their own thread (1) and of other threads (0), each with its weight.

    The threads spoken in last are all taken. Of those before, one message is drawn from
    every stride back, each twice as long as the one before; if it is the last of its thread
    it stands, by its weight, for all of the stride. So near and far threads count as often
    as they are there, however many a channel has at a time, and time can't seem to speak
    for a link because only near threads were looked at. The start of a thread, and a message
    outside threads, answers nobody, so all before it are examples of no link.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, said, last = None, [], {}
        for pdf in batches:
            out = []
            for channel, stretch, us, root, speaker, text, pace, asked in pdf.itertuples(index=False, name=None):
                if held != (channel, stretch):
                    held, said, last = (channel, stretch), [], {}
                if asked:
                    words = frozenset(_WORD.findall(text.lower())) if text else frozenset()
                    named = set(_MENTION.findall(text)) if text and "<@" in text else ()
                    draw, back, rivals = random.Random(us), len(said), []
                    while back and len(rivals) < RIVALS:
                        back -= 1
                        if last[said[back][0]] == back and said[back][0] != root:
                            rivals.append((back, 1))
                    stride = len(said) - back
                    while back:
                        stride = min(stride, back)
                        at = back - 1 - draw.randrange(stride)
                        if last[said[at][0]] == at and said[at][0] != root:
                            rivals.append((at, stride))
                        back, stride = back - stride, stride * 2
                    for at, weight in [*([(last[root], 1)] if root in last else []), *rivals]:
                        r, before, who, t = said[at]
                        w = frozenset(_WORD.findall(t.lower())) if t else frozenset()
                        f = score.features((us - before) / 1e6, pace, who is not None and who in named, _shared(words, w), who is not None and who == speaker, len(words) < 3)
                        out.append((float(r == root), list(f), float(weight)))
                last[root] = len(said)
                said.append((root, us, speaker, text))
            yield pd.DataFrame(out, columns=["y", "x", "weight"])

    return run


def fit_links(starts: DataFrame, score: LinkScore = LinkScore()) -> LinkScore:  # noqa: B008
    """The weights that tell a message's own thread from others before it and starts from replies, drawn towards ``score`` where threads say little.

    ``starts`` as ``links`` takes it. Trained on about TRAIN_MESSAGES messages in whole
    stretches of channels, chosen by a hash of channel and time, and on at most TRAIN_PAIRS
    pairs. Where stretches are so full that fewer than TRAIN_STRETCHES would hold as many,
    that many are read and the messages are chosen among theirs by a hash. Nothing is left
    out between a message and what came before it that other pairs don't stand for, so no
    base has to be moved. Weights of time above zero would say nothing about how far a link
    reaches and are held at zero.
    """
    stretch = F.floor(F.col("us") / F.lit(STRETCH * 1_000_000))
    n, stretches = starts.groupBy("channel_id", stretch).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    share = min(1.0, max(TRAIN_MESSAGES / max(n, 1), TRAIN_STRETCHES / max(stretches, 1)))
    chosen = lambda part, *c: F.pmod(F.xxhash64(*c), F.lit(10**12)) < int(part * 10**12)
    asked = chosen(min(1.0, TRAIN_MESSAGES / max(n * share, 1)), "us", "channel_id")
    some = starts.where("NOT gone").where(chosen(share, "channel_id", stretch))
    rows = some.select("channel_id", stretch.alias("stretch"), "us", F.coalesce("thread_us", "us").alias("root"), "speaker", "text", "pace", asked.alias("asked"))
    rows = rows.repartition("channel_id", "stretch").sortWithinPartitions("channel_id", "stretch", "us")
    pairs = rows.mapInPandas(_training_pairs(score), "y double, x array<double>, weight double")
    got = pairs.orderBy(F.xxhash64("x", "y"), "x", "y", "weight").limit(TRAIN_PAIRS).collect()
    if not got:
        return score
    x, y, weight, start = np.array([r.x for r in got]), np.array([r.y for r in got]), np.array([r.weight for r in got]), np.array(score.weights())
    free = np.ones(len(start), bool)
    while True:  # without the weights of time that come out above zero
        w = np.zeros(len(start))
        w[free] = logistic(x[:, free], y, 1.0, 60, start[free], weight)
        above = [k for k in (1, 2) if free[k] and w[k] > 0]
        if not above:
            break
        free[above] = False
    names = ("base", "per_time", "per_pace", "mention", "overlap", "same_speaker", "short")
    return replace(score, **{k: float(v) for k, v in zip(names, w, strict=True)})


def trees(linked: DataFrame) -> DataFrame:
    """``linked`` with root_us the root of the whole tree.

    Within a bucket the roots are known. A root of the bucket before (far) is followed by
    doubling, so the number of rounds is the logarithm of the longest chain of buckets;
    only such roots are looked up, and no other row moves. A thread's start that no row
    has remains the root.
    """
    linked = cut(linked)
    far = linked.where("far")
    sought = far.select(F.col("channel_id").alias("_sc"), F.col("root_us").alias("_su")).distinct()
    at = linked.select("channel_id", F.col("us").alias("_at"), F.col("root_us").alias("_to"))
    hops = cut(at.join(sought, (F.col("channel_id") == F.col("_sc")) & (F.col("_at") == F.col("_su")), "left_semi"))
    while True:
        onward = hops.select(F.col("channel_id").alias("_c"), F.col("_at").alias("_a"), F.col("_to").alias("_b"))
        step = hops.join(onward, (hops.channel_id == onward._c) & (hops._to == onward._a) & (onward._a != onward._b), "left")
        step = cut(step.select("channel_id", "_at", F.coalesce("_b", "_to").alias("_to"), F.col("_b").isNotNull().alias("_moved")))
        hops = step.drop("_moved")
        if step.where("_moved").isEmpty():
            break
    top = hops.select(F.col("channel_id").alias("_c"), "_at", F.col("_to").alias("_top"))
    moved = far.join(top, (far.channel_id == top._c) & (far.root_us == top._at), "left").withColumn("root_us", F.coalesce("_top", "root_us"))
    return linked.where("NOT far").unionByName(moved.select(*linked.columns)).drop("far")


def audit(linked: DataFrame) -> DataFrame:
    """Every thread named by some counting row, and what is wrong with it.

    channel_id, root_us, n_turns, missing_start, missing_replies, no_text, one_speaker. A
    message counts for the thread it names and for the one it may start, so one grouping
    by partial counts does; the two speakers that matter are the least and the greatest,
    so no thread's rows or speakers are ever gathered.
    """
    names = F.when(F.col("link") == "thread", F.col("root_us"))
    keys = F.array_compact(F.array_distinct(F.array(names, F.when(F.col("named"), F.col("us")))))
    rows = linked.select("channel_id", "us", "speaker", "shown", "reply_count", "gone", names.alias("_named"), F.explode(keys).alias("root_us"))
    there, at_start = ~F.col("gone"), F.col("us") == F.col("root_us")
    g = rows.groupBy("channel_id", "root_us").agg(
        F.count_if(F.col("_named") == F.col("root_us")).alias("_naming"), F.count_if(there).alias("n_turns"), F.count_if(there & at_start).alias("_starts"), F.count_if(there & ~at_start).alias("_replies"),
        F.max(F.when(there & at_start, F.col("reply_count"))).alias("_expected"), F.count_if(there & F.col("shown")).alias("_shown"),
        F.min(F.when(there, F.col("speaker"))).alias("_least"), F.max(F.when(there, F.col("speaker"))).alias("_greatest"),
    )
    return g.where("_naming > 0").select(
        "channel_id", "root_us", "n_turns", (F.col("_starts") == 0).alias("missing_start"), (F.col("_replies") < F.coalesce("_expected", F.lit(0))).alias("missing_replies"),
        (F.col("_shown") == 0).alias("no_text"), (F.col("_least").isNull() | (F.col("_least") == F.col("_greatest"))).alias("one_speaker"),
    )


BROKEN = "missing_start OR missing_replies OR no_text OR one_speaker"


def rebuilt(messages: DataFrame, score: LinkScore | None = None, keep_text: bool = False) -> DataFrame:
    """Every counting message in its tree: ``links`` with roots followed to the end; without a ``score`` one is trained on the threads there are."""
    starts = with_pace(cut(with_starts(counting_messages(messages))))
    return cut(trees(links(starts, score or fit_links(starts), keep_text)))


def broken_threads(messages: DataFrame, score: LinkScore | None = None) -> DataFrame:
    """channel_id, thread_ts (six decimals) of the conversations to be left out that messages name as a thread, with the reasons."""
    return audit(rebuilt(messages, score)).where(BROKEN).withColumn("thread_ts", written(F.col("root_us")))


def conversations(messages: DataFrame, members: DataFrame, score: LinkScore | None = None) -> DataFrame:
    """The turns of every whole conversation, threads and judged trees alike.

    channel_id, conversation (time of its root, six decimals), turn (from 1), ts, speaker,
    role (of chat_members; null if unknown), text, reply_to, link, odds. Left out are broken
    threads and trees with one speaker or no text. Deleted messages are no turns. Without
    a ``score`` one is trained on the threads there are.
    """
    whole = rebuilt(messages, score, keep_text=True)
    bad = audit(whole).where(BROKEN).select(F.col("channel_id").alias("_bc"), F.col("root_us").alias("_br"))
    turns = whole.where("NOT gone").join(bad, (F.col("channel_id") == F.col("_bc")) & (F.col("root_us") == F.col("_br")), "left_anti")
    fit = turns.groupBy(F.col("channel_id").alias("_fc"), F.col("root_us").alias("_fr")).agg(F.min("speaker").alias("_a"), F.max("speaker").alias("_z"), F.count_if("shown").alias("_n"))
    fit = fit.where("_a < _z AND _n > 0")
    turns = turns.join(fit, (turns.channel_id == fit._fc) & (turns.root_us == fit._fr), "left_semi")
    roles = members.select(F.explode(F.array("user_id", "username")).alias("_who"), "member_role").where("_who IS NOT NULL").groupBy("_who").agg(F.min("member_role").alias("role"))
    turns = turns.join(roles, turns.speaker == roles._who, "left")
    turns = rank_within(turns.select("channel_id", "root_us", "us", "speaker", "role", "text", "parent_us", "link", "odds"), ["channel_id", "root_us"], ["us"], "turn")
    return turns.select(
        "channel_id", written(F.col("root_us")).alias("conversation"), "turn", written(F.col("us")).alias("ts"), "speaker", "role", "text", written(F.col("parent_us")).alias("reply_to"), "link", "odds",
    )
