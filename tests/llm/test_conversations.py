import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waymark.llm.conversations import BUCKET, LinkScore, broken_threads, conversations, counting_messages, fit_links, links, trees, with_pace, with_starts

MSG = "msg_id long, channel_id string, ts string, user_id string, username string, text string, subtype string, thread_ts string, reply_count int, received_at timestamp"


def frame(spark, *rows):
    full = []
    for i, r in enumerate(rows, 1):
        d = {"msg_id": i, "channel_id": "C", "ts": None, "user_id": None, "username": None, "text": "hello there", "subtype": None, "thread_ts": None, "reply_count": None, "received_at": datetime(2024, 1, 1) + timedelta(seconds=i)} | r
        full.append(tuple(d.values()))
    return spark.createDataFrame(full, MSG)


def prepared(m):
    return with_pace(with_starts(counting_messages(m)))


def test_broken(spark):
    m = frame(
        spark,
        {"ts": "100.5", "user_id": "A", "thread_ts": "100.500000", "reply_count": 1}, {"ts": "101", "user_id": "B", "thread_ts": "100.5"},  # whole
        {"ts": "201", "user_id": "B", "thread_ts": "200"},  # its start is missing
        {"ts": "300", "user_id": "A", "reply_count": 2}, {"ts": "301", "user_id": "B", "thread_ts": "300.000"},  # one reply short
        {"ts": "400", "user_id": "A", "text": " \u200b"}, {"ts": "401", "user_id": "B", "text": None, "thread_ts": "400"},  # nothing said
        {"ts": "500", "user_id": "A"}, {"ts": "501", "user_id": "A", "thread_ts": "500"},  # one speaker
        {"ts": "600", "user_id": "A"}, {"ts": "601", "user_id": "B", "thread_ts": "600"}, {"ts": "601.000", "user_id": "B", "thread_ts": "600", "subtype": "message_deleted"},  # its reply was deleted
        {"ts": "700", "user_id": "A", "thread_ts": " "}, {"ts": "x", "user_id": "A", "thread_ts": "800"}, {"ts": "900", "user_id": "A", "subtype": "tombstone"}, {"ts": "901", "user_id": "B", "thread_ts": "900"}, {"ts": "902", "username": "bot", "thread_ts": "900"},
    )
    assert sorted(r.thread_ts for r in broken_threads(m).collect()) == ["200.000000", "300.000000", "400.000000", "500.000000", "600.000000", "900.000000"]
    assert broken_threads(m.limit(0)).isEmpty()


def test_counting(spark):
    m = frame(spark, {"ts": "1", "text": "old"}, {"ts": "1.0", "text": "new"}, {"ts": None}, {"ts": "2", "channel_id": None})
    assert [(r.us, r.text) for r in counting_messages(m).collect()] == [(1_000_000, "new")]


def test_disentangled(spark):
    at = 10 * BUCKET - 600  # the talk crosses the edge of a bucket
    m = frame(
        spark,
        {"ts": f"{at}", "user_id": "UA", "text": "the parser fails with weird unicode input"}, {"ts": f"{at + 20}", "user_id": "UC", "text": "lunch anyone today around noon"},
        {"ts": f"{at + 60}", "user_id": "UB", "text": "which unicode input fails the parser"}, {"ts": f"{at + 90}", "user_id": "UD", "text": "<@UC> lunch sounds good today"},
        {"ts": f"{at + 700}", "user_id": "UA", "text": "<@UB> any unicode input with marks fails the parser"}, {"ts": f"{at + 90_000}", "user_id": "UE", "text": "good morning"},
    )
    members = spark.createDataFrame([("UA", "ann", "staff"), ("UB", "bob", "guest")], "user_id string, username string, member_role string")
    rows = conversations(m, members, LinkScore()).orderBy("conversation", "turn").collect()
    talks = {}
    for r in rows:
        talks.setdefault(r.conversation, []).append(r)
    assert [[r.speaker for r in t] for t in talks.values()] == [["UA", "UB", "UA"], ["UC", "UD"]] and [r.role for r in rows][:3] == ["staff", "guest", "staff"]
    t = trees(links(prepared(m)))
    assert t.count() == 6 and t.where(F.col("us") == (at + 700) * 1_000_000).first().root_us == at * 1_000_000
    assert conversations(m.limit(0), members).isEmpty()


def test_long_chain_over_buckets(spark):
    step = 600
    m = frame(spark, *({"ts": f"{1_000_000 + i * step}", "user_id": f"U{i % 2}", "text": "the very same long topic words here again"} for i in range(120)))
    t = trees(links(prepared(m)))
    assert t.count() == 120 and t.select("root_us").distinct().count() == 1


def test_trained_links(spark):
    rows = []
    for i in range(60):  # two threads at a time; replies share words with their own start
        a, b = 10_000 * i, 10_000 * i + 5
        rows += [{"ts": f"{a}", "user_id": "A", "text": f"topic alpha{i} beta{i} gamma{i}", "thread_ts": f"{a}"}, {"ts": f"{b}", "user_id": "B", "text": f"matter delta{i} zeta{i} eta{i}", "thread_ts": f"{b}"}]
        rows += [{"ts": f"{a + 60}", "user_id": "C", "text": f"about alpha{i} beta{i} indeed", "thread_ts": f"{a}"}, {"ts": f"{b + 70}", "user_id": "D", "text": f"about delta{i} zeta{i} indeed", "thread_ts": f"{b}"}]
    starts = prepared(frame(spark, *rows))
    s = fit_links(starts)
    assert s.overlap > LinkScore().overlap and s.of(60, 2500, False, 0.5, False, False) > 0 > s.of(60, 2500, False, 0.0, False, False)
    assert fit_links(starts.limit(0)) == LinkScore()


def test_times(spark):
    m = frame(spark, {"ts": "99999999999999"}, {"ts": "-1.5"}, {"ts": "1e3"}, {"ts": " 7 ", "thread_ts": "99999999999999999999999"})
    assert sorted((r.us, r.thread_us) for r in counting_messages(m).collect()) == [(-1_500_000, None), (7_000_000, None), (1_000_000_000, None)]
    assert links(prepared(m)).count() == 3


def test_links_at_any_gap(spark):
    noise = [{"ts": f"{5_000 + 60 * i}", "user_id": f"N{i % 7}", "text": f"chatter noise{i} blah{i} and so on{i}"} for i in range(100)]
    m = frame(
        spark, *noise, {"ts": "100", "user_id": "UA", "text": "the parser fails with weird unicode input"}, {"ts": f"{100 + BUCKET + 9_000}", "user_id": "UB", "text": "<@UA> which unicode input fails the parser"},
    )
    slow = LinkScore(base=-1.0, per_time=-0.2, per_pace=-0.1)
    reply = links(prepared(m), slow).where("speaker = 'UB'").first()
    assert (reply.parent_us, reply.link) == (100_000_000, "judged") and reply.odds > 0
    assert links(prepared(m), LinkScore(per_time=-3.0)).where("speaker = 'UB'").first().link == "start"
    assert links(prepared(m), LinkScore(base=-2.0, per_time=0.0, per_pace=0.0)).where("speaker = 'UB'").first().parent_us == 100_000_000
    for bad in (LinkScore(per_time=0.1), LinkScore(per_pace=0.1)):
        with pytest.raises(ValueError):
            links(prepared(m), bad)


@pytest.mark.parametrize("score", [LinkScore(), LinkScore(5.5, -1.3, -0.7, 2.9, 0.2, 5.4, 0.1), LinkScore(0.5, -0.4, -0.3, 2.0, -1.0, -0.5, 0.2), LinkScore(-1.0, 0.0, 0.0, -1.0, 4.0, -0.5, 0.2), LinkScore(1.0, 0.0, -0.6, 1.0, 3.0, 0.5, 0.2)])
def test_links_as_by_brute_force(spark, score):
    rng = random.Random(7)
    rows, at = [], 0
    for _ in range(250):
        at += rng.choice([5, 40, 300, 2_000, 9_000])
        text = " ".join(rng.choices(["apple", "berry", "cedar", "delta", "ember", "the", "fjord"], [1, 1, 1, 1, 1, 6, 1], k=rng.randint(1, 5))) + rng.choice(["", "", " <@U1>", " <@U2> <@U3>"])
        rows.append({"ts": f"{at}", "user_id": rng.choice(["U1", "U2", "U3", "U4", None]), "text": text})
    rows = [r | {"username": None} for r in rows]
    words = [frozenset(w for w in r["text"].lower().replace("<@", "").replace(">", "").split() if len(w) > 2) for r in rows]
    want, pace = {}, (int(rows[-1]["ts"]) - int(rows[0]["ts"])) / len(rows)
    for i, r in enumerate(rows):
        best = (-1.0, None)
        for j, q in enumerate(rows[:i]):
            shared = len(words[i] & words[j]) / (1 + min(len(words[i]), len(words[j]))) if words[i] and words[j] else 0.0
            who = q["user_id"]
            s = score.of(float(int(r["ts"]) - int(q["ts"])), pace, who is not None and who in r["text"], shared, who is not None and who == r["user_id"], len(words[i]) < 3)
            best = max(best, (s, j)) if s >= 0 else best
        want[int(r["ts"]) * 1_000_000] = None if best[1] is None else int(rows[best[1]]["ts"]) * 1_000_000
    got = {r.us: r.parent_us for r in links(prepared(frame(spark, *rows)), score).collect()}
    assert got == want and any(want.values())


def test_trained_on_far_replies(spark):
    rows = []
    for i in range(60):  # replies come hours after their start, at times after other threads' starts
        a, b = 40_000 * i, 40_000 * i + 3_600
        rows += [{"ts": f"{a}", "user_id": "A", "text": f"topic alpha{i} beta{i} gamma{i}", "thread_ts": f"{a}"}, {"ts": f"{b}", "user_id": "B", "text": f"matter delta{i} zeta{i} eta{i}", "thread_ts": f"{b}"}]
        rows += [{"ts": f"{a + 9_000}", "user_id": "C", "text": f"about alpha{i} beta{i} indeed", "thread_ts": f"{a}"}, {"ts": f"{b + 12_000}", "user_id": "D", "text": f"about delta{i} zeta{i} indeed", "thread_ts": f"{b}"}]
    s = fit_links(prepared(frame(spark, *rows)))
    assert s.of(9_000, 10_000, False, 0.5, False, False) > 0 > s.of(9_000, 10_000, False, 0.0, False, False)


def test_blank_starts(spark):
    m = frame(
        spark,
        {"ts": "100", "user_id": "UA", "text": "the parser fails with weird unicode input"}, {"ts": "130", "user_id": "UB", "text": "which unicode input fails the parser"},  # a judged talk
        {"ts": "160", "user_id": "UC", "text": "<@UA> the parser fails with unicode input", "thread_ts": " "},  # starts a thread, though it seems to answer
        {"ts": "190", "user_id": "UD", "text": "so it does", "thread_ts": "160"}, {"ts": "9000", "user_id": "UD", "text": "fixed", "thread_ts": "160.0"},
        {"ts": "19100", "user_id": "UE", "text": "note to self"},  # named in another channel only
        {"ts": "19200", "user_id": "UE", "channel_id": "D", "thread_ts": "19100"},
    )
    members = spark.createDataFrame([], "user_id string, username string, member_role string")
    talks = {}
    for r in conversations(m, members, LinkScore()).orderBy("conversation", "turn").collect():
        talks.setdefault(r.conversation, []).append((r.ts, r.reply_to, r.link))
    assert talks == {
        "100.000000": [("100.000000", None, "start"), ("130.000000", "100.000000", "judged")],
        "160.000000": [("160.000000", None, "thread"), ("190.000000", "160.000000", "thread"), ("9000.000000", "160.000000", "thread")],
    }
    t = {(r.channel_id, r.us // 1_000_000): (r.root_us // 1_000_000, r.link) for r in trees(links(prepared(m))).collect()}
    assert t["C", 160] == (160, "thread") and t["C", 19100] == (19100, "start")


def test_interleaved_threads_held_out(spark):
    """Four talks at a time whose messages alternate: the weights come from some channels, whose threads are named, and join the others'."""
    rng = random.Random(5)
    rows, truth = [], {}
    for channel in range(24):
        at = 0
        for talk in range(12):
            at += 40_000
            words = {k: [f"w{channel}x{talk}x{k}x{i}" for i in range(6)] for k in range(4)}
            root = {}
            for k in [k for _ in range(5) for k in rng.sample(range(4), 4)]:
                at += rng.randint(20, 400)
                root.setdefault(k, at)
                truth[f"C{channel}", at] = root[k]
                rows.append({"ts": f"{at}", "channel_id": f"C{channel}", "user_id": f"U{k}{rng.randint(0, 1)}", "text": " ".join(rng.sample(words[k], 3)) + " we should see", "thread_ts": f"{root[k]}" if channel % 2 else None})
    starts = prepared(frame(spark, *rows))
    score = fit_links(starts.where(F.substring("channel_id", 2, 9).cast("int") % 2 == 1))
    got = trees(links(starts, score)).where("link <> 'thread'").collect()
    replies = [r for r in got if truth[r.channel_id, r.us // 1_000_000] * 1_000_000 != r.us]
    linked = [r for r in got if r.parent_us is not None]
    right = [r for r in linked if truth[r.channel_id, r.parent_us // 1_000_000] == truth[r.channel_id, r.us // 1_000_000]]
    assert len(right) > 0.95 * len(replies) and len(right) > 0.95 * len(linked)
    assert sum(r.root_us == truth[r.channel_id, r.us // 1_000_000] * 1_000_000 for r in replies) > 0.9 * len(replies)


def test_named_threads_hidden_and_found_again(spark):
    """On the test tables: weights from half of the channels, threads of the other half hidden."""
    counting = counting_messages(spark.read.parquet("/root/testdata/sf0.01/slack_messages.parquet"))
    other = F.pmod(F.xxhash64("channel_id"), F.lit(2)) == 1
    score = fit_links(with_pace(with_starts(counting.where(~other))))
    truth = {(r.channel_id, r.us): r.thread_us for r in with_starts(counting.where(other)).where("NOT gone").collect()}
    hidden = with_pace(with_starts(counting.where(other).withColumn("thread_us", F.lit(None).cast("long"))))
    got = trees(links(hidden, score)).where("NOT gone").collect()
    replies = [r for r in got if truth[r.channel_id, r.us] not in (None, r.us)]
    linked = [r for r in got if r.parent_us is not None]
    right = [r for r in linked if truth[r.channel_id, r.us] not in (None, r.us) and truth.get((r.channel_id, r.parent_us)) == truth[r.channel_id, r.us]]
    assert len(replies) > 1000 and len(right) > 0.85 * len(replies) and len(right) > 0.85 * len(linked)


def test_found_comes_from_the_trained_trees(spark, monkeypatch):
    from waymark.llm import conversations as c

    used, fit = [], c.fit_links
    monkeypatch.setattr(c, "fit_links", lambda starts: used.append(fit(starts)) or used[-1])
    m = frame(spark, {"ts": "100", "user_id": "A", "thread_ts": "100", "reply_count": 2}, {"ts": "110", "user_id": "B", "thread_ts": "100"}, {"ts": "130", "user_id": "B"})
    assert [r.thread_ts for r in c.broken_threads(m).collect()] == ["100.000000"] and len(used) == 1


def full(spark, stretches=1):
    """Forty threads at a time in one channel, so that a thread's last message is far behind those of others."""
    rng, rows, at, live = random.Random(3), [], 0, []
    for _ in range(stretches):
        for _ in range(1_200):
            at += rng.randint(20, 60)
            if len(live) < 40:
                live.append((at, 1))
                k = len(live) - 1
            else:
                k = rng.randrange(40)
                live[k] = (live[k][0], live[k][1] + 1)
            rows.append({"ts": f"{at}", "user_id": f"U{rng.randrange(50)}", "text": "we should see", "thread_ts": f"{live[k][0]}"})
            if live[k][1] == 6:
                live.pop(k)
        at += 1_209_600
    return prepared(frame(spark, *rows))


def test_full_channels_keep_a_reach(spark):
    s = fit_links(full(spark))
    assert s.per_time + s.per_pace < 0 and s.reach(40.0) is not None


def test_trained_where_one_stretch_holds_more_than_is_trained_on(spark, monkeypatch):
    from waymark.llm import conversations as c

    starts = full(spark, 3)
    monkeypatch.setattr(c, "TRAIN_MESSAGES", 1)
    assert c.fit_links(starts.where("us < 0")) == LinkScore()
    monkeypatch.setattr(c, "TRAIN_MESSAGES", 100)
    assert c.fit_links(starts) != LinkScore()


def test_many_channels_are_joined_without_a_broadcast(spark, monkeypatch):
    from waymark.llm import conversations as c

    m = frame(spark, *({"ts": f"{100 + 40 * i}", "channel_id": f"C{i % 3}", "user_id": f"U{i % 2}", "text": "the parser fails"} for i in range(12)))
    few = sorted(map(tuple, links(prepared(m)).collect()))
    monkeypatch.setattr(c, "BROADCAST_CHANNELS", 2)
    assert sorted(map(tuple, links(prepared(m)).collect())) == few and len(few) == 12
