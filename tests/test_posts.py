"""Keywords, counters, scores, rankings and streams."""

import json
import time
from datetime import datetime

from pyspark.sql import functions as F

from logtrends.functions.keywords import keywords
from logtrends.operators import posts as P, trends
from logtrends.plans import bindings
from logtrends.sources import posts as S
from logtrends.streaming import live, store as store_module
from logtrends.streaming.store import CounterStore

T0 = "2024-01-01 10:00:30"


def posts_df(spark, *records):
    texts = [(json.dumps({"ts": T0, **r}),) for r in records]
    return S.parse_json(spark.createDataFrame(texts, "value string"))


def test_keywords(spark):
    df = spark.createDataFrame([("The quick fox, and the  Lazy dog's",), ("",), (None,), ("of the",)], "t string")
    assert [r[0] for r in df.select(keywords(F.col("t"))).collect()] == [["quick fox", "lazy dog", "s"], [], [], []]


def test_counters_and_scores(spark, rows):
    df = posts_df(
        spark, {"type": "reddit", "title": "rain and rain", "score": 5, "num_comments": 1},
        {"type": "twitter", "text": "snow", "reply_count": 1, "retweet_count": 2, "favorite_count": 3},
        {"type": "twitter", "reply_count": 9}, {"type": "reddit", "title": "sun", "num_comments": 3},
    )
    reddit, twitter = P.keyword_minute(df, "reddit"), P.keyword_minute(df, "twitter")
    assert rows(reddit, "keyword", "score", "num_comments") == [("rain", 10, 2), ("sun", None, 3)]
    assert rows(twitter, "keyword", "replies", "retweets", "favorites") == [("snow", 1, 2, 3)]
    scored = trends.minute_scores(reddit, twitter, F.lit("2024-01-01 10:01:00").cast("timestamp"))
    assert rows(scored, "keyword", "score") == [("rain", 8), ("snow", 2), ("sun", 0)]
    assert trends.minute_scores(reddit, twitter, F.lit("2024-01-01 10:00:59").cast("timestamp")).count() == 0


def test_source_clash(spark, rows):
    reddit = spark.sql("SELECT timestamp'2024-01-01 10:00:00' minute, 'k' keyword, 3L num_comments, 7L score")
    twitter = spark.sql("SELECT timestamp'2024-01-01 10:00:00' minute, 'k' keyword, 1L replies, 2L retweets, 3L favorites")
    now = F.lit("2024-01-01 11:00:00").cast("timestamp")
    assert rows(trends.minute_scores(reddit, twitter, now), "score") == [(2,)]
    assert rows(trends.minute_scores(reddit, twitter, now, "sum"), "score") == [(8,)]


def test_rankings(spark, rows):
    data = [(f"2024-01-01 10:{m:02d}:00", k, s) for m, k, s in [(1, "a", 4), (7, "a", 6), (2, "b", 9), (3, "c", 9), (59, "z", 1)]]
    data += [("2024-01-01 11:00:00", f"k{i:02d}", 1) for i in range(12)]
    scores = spark.createDataFrame(data, "minute string, keyword string, score bigint").withColumn("minute", F.to_timestamp("minute"))
    hour = trends.trend_windows(scores, "1 hour").filter("hour(period) = 10")
    assert rows(hour, "rank", "keyword", "score") == [(1, "a", 10), (2, "b", 9), (3, "c", 9), (4, "z", 1)]
    now = trends.trend_now(scores, F.lit("2024-01-01 11:30:10").cast("timestamp"))
    assert sorted(tuple(r) for r in now.select("rank", "keyword").collect()) == [(i + 1, f"k{i:02d}") for i in range(10)]
    assert trends.trend_windows(scores, "5 minutes").filter("hour(period) = 11").count() == 10


def test_meetup(spark, rows):
    df = posts_df(
        spark, {"post_id": 1, "type": "meetup", "name": "chess night", "group": {"city": "Rome", "country": "it"}},
        {"post_id": 2, "type": "meetup", "name": "chess night", "description": "the board", "venue": {
            "name": "Hall", "city": "Oslo", "country": "no", "state": "S", "address_1": " A", "address_3": " C"},
         "group": {"city": "x", "country": "y", "category": {"shortname": "games"}}},
        {"type": "other"}, {},
    )
    shown = S.meetup_fields(S.route_posts(df)["meetup"])
    assert rows(shown, "city", "state", "country", "venue_text", "category") == [
        ("Oslo", "S", "no", "Hall A C", "games"), ("Rome", "None", "it", "None", "None"),
    ]
    assert S.route_posts(df)["invalid"].count() == 2
    assert rows(P.meetup_latest(df), "keyword", "city") == [("board", "Oslo"), ("chess night", "Oslo")]


def exchanged(df):
    """Hash exchanges in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_meetups_move_before_their_keywords(spark, rows):
    """No row per keyword is shuffled, and no long name stands in more than one row on the way; a meetup that came twice counts once."""
    name = "long name " + "x" * 1000
    text = " and ".join(f"w{i}" for i in range(50))
    meetup = lambda i, **more: {"post_id": i, "type": "meetup", "name": name, "description": text, "group": {"city": f"c{i}", "country": "it"}, **more}
    df = posts_df(spark, meetup(1), meetup(2), meetup(2), meetup(3, description="w7"), meetup(None, ts=None))
    found = P.meetup_latest(df)
    assert exchanged(found) and not any("keyword" in line for line in exchanged(found))
    assert found.filter("post_id = 2").count() == 49 and found.filter("post_id is null").count() == 51
    assert rows(found.filter("keyword = 'w7'"), "post_id", "city", "name") == [(3, "c3", name), (None, "cNone", name)]


def test_keywords_of_crowded_periods_are_dealt_out(spark, rows, monkeypatch):
    """Counters and rankings need no shuffle of keywords, and parts change no result."""
    text = lambda i: " and ".join(f"w{(i * 7 + j) % 40}" for j in range(25))
    df = posts_df(
        spark, *[{"post_id": i, "ts": f"2024-01-01 10:0{i % 3}:05", "type": "reddit", "title": text(i), "score": i, "num_comments": 1} for i in range(20)],
        *[{"post_id": 50 + i, "ts": "2024-01-01 10:01:30", "type": "twitter", "text": text(i) + " and w3", "reply_count": 1, "retweet_count": i, "favorite_count": 2} for i in range(9)])
    plain = trends.trend_windows(trends.scores_of(P.both_minutes(df)), "1 hour")
    want = [rows(x) for x in (P.keyword_minute(df, "twitter"), P.both_minutes(df), plain)]
    for size in (2_000, 3, 1):
        monkeypatch.setattr(P, "POSTS_PER_PART", size)
        counted, both = P.keyword_minute(df, "twitter"), P.both_minutes(df)
        ranked = trends.trend_windows(trends.scores_of(P.both_minutes(df, "1 hour")), "1 hour")
        assert [rows(x) for x in (counted, both, ranked)] == want
        assert not any("keyword" in line for x in (counted, both, ranked) for line in exchanged(x))


def test_keywords_are_put_in_the_order_of_their_parts_once(spark, monkeypatch):
    """Every keyword, repeats included, goes to the part of its own, in the order of the post; the parts are cut out of one sorted list, not looked for one by one."""
    monkeypatch.setattr(P, "POSTS_PER_PART", 1)
    texts = [" and ".join(f"w{(i * 7 + j * j) % 50}" for j in range(i * 3)) for i in range(40)] + ["the", "", "rain"]
    df = posts_df(spark, *[{"post_id": i, "ts": T0 if i < 42 else "2024-01-01 12:00:00", "type": "reddit", "title": t} for i, t in enumerate(texts)])
    packed, _ = P.gathered(df, F.date_trunc("minute", "ts"), keywords(F.col("title")), "post_id")
    found, part_of = {}, {}
    for row in packed.collect():
        for word in row["_words"].split("|"):
            assert part_of.setdefault((row["period"], word), row["part"]) == row["part"] < 42
        assert (row["post_id"], row["part"]) not in found
        found[row["post_id"], row["part"]] = row["_words"].split("|")
    for i, t in enumerate(texts):
        words = [w for w in t.split(" and ") if w not in ("the", "")]
        own = [f for (post, _), f in found.items() if post == i]
        assert sorted(w for f in own for w in f) == sorted(words)
        assert all(f == [w for w in words if w in set(f)] for f in own)
    assert len(set(part_of.values())) > 15 and found[42, 0] == ["rain"]
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and plan.count("xxhash64(") == 1


def test_merge_counters(spark, rows):
    old = spark.createDataFrame([("m", "a", 1), ("m", "b", 2)], "minute string, keyword string, score bigint")
    new = spark.createDataFrame([("m", "a", 5), ("m", "c", None)], "minute string, keyword string, score bigint")
    assert rows(P.merge_counters(new, old, ["minute", "keyword"], ["score"])) == [("m", "a", 6), ("m", "b", 2), ("m", "c", 0)]


def write_posts(folder, name, records):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def test_stream_equals_batch_and_late_posts(spark, rows, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    post = lambda i, ts: {"post_id": i, "ts": ts, "type": "reddit", "title": "rain", "score": 1, "num_comments": 2}
    steps = [
        [post(1, "2024-01-01 10:00:10"), post(2, "2024-01-01 10:00:20"), {"type": "reddit"}],
        [post(3, "2024-01-01 10:08:00"), post(4, "2024-01-01 10:00:40")],   # 4 is late, but within the delay
        [post(5, "2024-01-01 10:30:00")],
        [post(6, "2024-01-01 10:00:50")],                                   # beyond the delay: dropped
    ]
    for i, step in enumerate(steps):
        write_posts(source, f"{i}.json", step)
        live.start_counts(S.read_posts(spark, str(source), streaming=True), "reddit", out, state).awaitTermination()
    found = live.read_counts(spark, "reddit", out)
    batch = P.keyword_minute(S.read_posts(spark, str(source)).filter("post_id <> 6"), "reddit")
    columns = ["minute", "keyword", "num_comments", "score"]
    assert rows(found, *columns) == rows(batch, *columns) and found.count() == 3
    twitter = live.read_counts(spark, "reddit", out).limit(0).selectExpr(
        "minute", "keyword", "score retweets", "score favorites", "score replies")
    live.counter_store(spark, "twitter", str(tmp_path / "tw")).commit(twitter, 0, "none")
    live.refresh_trend(spark, out, str(tmp_path / "tw"), datetime(2024, 1, 1, 10, 20), str(tmp_path / "rank"))
    assert rows(spark.read.parquet(str(tmp_path / "rank")), "keyword", "score", "rank") == [("rain", 4, 1)]


def test_replays_are_dropped(spark, rows, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(2):
        write_posts(source, f"{i}.json", [{"post_id": p, "ts": T0, "type": "reddit"} for p in (1, 2, 2)])
        live.start_dedup(S.read_posts(spark, str(source), streaming=True), out, state).awaitTermination()
    assert rows(spark.read.parquet(out), "post_id") == [(1,), (2,)]


def counts_df(spark, **values):
    at = datetime(2024, 1, 1, 10)
    return spark.createDataFrame([(at, k, v) for k, v in values.items()], "minute timestamp, keyword string, score bigint")


def test_counter_store(spark, rows, tmp_path, monkeypatch):
    """Replayed batches, several runs, merges by level and a manifest that was cut off."""
    monkeypatch.setattr(store_module, "FAN", 3)
    path = str(tmp_path / "store")
    store = CounterStore(spark, path, ["score"])
    assert store.read().count() == 0
    assert store.commit(counts_df(spark, a=1, b=2), 0, "one") and not store.commit(counts_df(spark, a=50), 0, "one")
    for batch in range(1, 12):
        store.commit(counts_df(spark, a=1 + batch, **{f"k{batch}": batch}), batch, "one")
        assert len(store._names("manifest")) <= 2
    want = [("a", 12), ("b", 2), *((f"k{i}", i) for i in range(1, 12))]
    assert rows(store.read(), "keyword", "score") == sorted(want, key=repr)
    segments = store._manifest()[1]["segments"]
    assert len(segments) <= 4 and max(s["level"] for s in segments) == 2 and len(store._names("segments")) <= 8
    # a fresh checkpoint on the old path starts with batch 0 again: another run, added to what is there
    assert CounterStore(spark, path, ["score"]).commit(counts_df(spark, a=5, z=1), 0, "two")
    assert dict(rows(store.read(), "keyword", "score"))["a"] == 17
    number = store._manifest()[0]
    (tmp_path / "store" / "manifest" / f"{number + 1:020d}").write_text('{"segments": [{"fol')
    assert store._manifest()[0] == number and dict(rows(store.read(), "keyword", "score"))["z"] == 1
    assert not store.commit(counts_df(spark, a=9), 11, "one")
    hour = F.lit("2024-01-01 11:00:00").cast("timestamp")
    assert store.read(hour, hour + F.expr("INTERVAL 1 HOUR")).count() == 0


def test_closed_minutes_and_hours(spark, rows, tmp_path):
    """Both sources in one stream: each closed minute once, the ranking of each closed hour, whatever the micro-batches."""
    source = tmp_path / "in"
    source.mkdir()
    post = lambda i, ts, kind, **more: {"post_id": i, "ts": f"2024-01-01 {ts}", "type": kind, **more}
    steps = [
        [post(1, "10:00:10", "reddit", title="rain", score=10, num_comments=5), post(2, "10:00:20", "twitter", text="rain", retweet_count=4, favorite_count=10, reply_count=0)],
        [post(3, "10:59:59", "reddit", title="sun and rain", score=5, num_comments=0), post(4, "10:00:30", "reddit", title="fog", score=None, num_comments=1)],
        [post(5, "11:20:00", "twitter", text="snow", retweet_count=10, favorite_count=0, reply_count=0)],
        [post(6, "12:30:00", "meetup", name="rain")],
    ]
    for merge, rain in (("overwrite", 5), ("sum", 14)):
        out, hours = str(tmp_path / f"minutes-{merge}"), str(tmp_path / f"hours-{merge}")
        for i, step in enumerate(steps):
            write_posts(source, f"{i}.json", step)
            stream = lambda: S.read_posts(spark, str(source), streaming=True)
            live.start_minute_scores(stream(), out, f"{out}-state", merge=merge).awaitTermination()
            live.start_hourly_trend(stream(), hours, f"{hours}-state", merge=merge).awaitTermination()
        batch = trends.scores_of(P.both_minutes(S.read_posts(spark, str(source))), merge)
        found = live.read_minute_scores(spark, out)
        assert rows(found, "minute", "keyword", "score") == rows(batch, "minute", "keyword", "score") and found.count() == 5
        two = trends.minute_scores(*(P.keyword_minute(S.read_posts(spark, str(source)), k) for k in ("reddit", "twitter")), F.lit("2024-01-02").cast("timestamp"), merge)
        assert rows(two, "minute", "keyword", "score") == rows(batch, "minute", "keyword", "score")
        ranked = live.read_hourly_trend(spark, hours).filter("hour(period) = 10")
        assert rows(ranked, "rank", "keyword", "score") == [(1, "rain", rain + 4), (2, "sun", 4), (3, "fog", 0)]
        assert rows(live.read_hourly_trend(spark, hours).filter("hour(period) = 11"), "keyword", "score") == [("snow", 5)]
        for i in range(len(steps)):
            (source / f"{i}.json").unlink()


def test_streams_keep_posts_of_open_periods_only(spark, rows, tmp_path):
    """No state per keyword: what a batch closes is not stored, what is open is stored as posts."""
    source = tmp_path / "in"
    source.mkdir()
    post = lambda i, ts: {"post_id": i, "ts": f"2024-01-01 {ts}", "type": "reddit", "title": "rain and sun", "score": 10, "num_comments": 0}
    write_posts(source, "0.json", [post(i, f"10:{i:02d}:10") for i in range(40)] + [post(50, "11:05:00"), {"type": "reddit", "title": "fog"}])
    stream = lambda: S.read_posts(spark, str(source), streaming=True)
    for start, read, name, left, found in (
            (live.start_minute_scores, live.read_minute_scores, "minutes", 1, 80), (live.start_hourly_trend, live.read_hourly_trend, "hours", 1, 2)):
        out, state = str(tmp_path / name), str(tmp_path / f"{name}-state")
        for _ in range(2):  # the second finds nothing new
            start(stream(), out, state, delay="0 seconds").awaitTermination()
        assert not (tmp_path / f"{name}-state" / "state").exists()
        assert spark.read.parquet(f"{state}/open/0/posts").count() == left and read(spark, out).count() == found
    out, state = str(tmp_path / "counts"), str(tmp_path / "counts-state")
    live.start_counts(stream(), "reddit", out, state).awaitTermination()
    assert not (tmp_path / "counts-state" / "state").exists()
    assert live.read_counts(spark, "reddit", out).count() == 82


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in files.split("\n") if "/shuffle_" in name}


def left_behind(spark, before):
    """Shuffle files that were not there before; they are removed in the background."""
    for _ in range(50):
        if not (found := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    return found


def test_closed_periods_are_done_in_slices(spark, rows, tmp_path, monkeypatch):
    """Slices give what the whole batch gives, a repeated batch replaces all of them, and no slice leaves its shuffle files to the next."""
    source = tmp_path / "in"
    source.mkdir()
    post = lambda i, **more: {"post_id": i, "ts": f"2024-01-01 {10 + i % 7}:{i % 60:02d}:10", **more}
    write_posts(source, "0.json", [post(i, type="reddit", title=f"rain and w{i % 5}", score=i, num_comments=2) for i in range(60)] + [
        post(60 + i, type="twitter", text="sun and rain", retweet_count=i, favorite_count=1, reply_count=None) for i in range(9)])
    for start, read, name in ((live.start_minute_scores, live.read_minute_scores, "minutes"), (live.start_hourly_trend, live.read_hourly_trend, "hours")):
        want = None
        for size in (2_000_000, 25):
            monkeypatch.setattr(live, "POSTS_PER_SLICE", size)
            out, before = str(tmp_path / f"{name}-{size}"), shuffle_files(spark)
            for _ in range(2):  # the second time as if the batch had not been finished
                start(S.read_posts(spark, str(source), streaming=True), out, f"{out}-state", delay="0 seconds").awaitTermination()
                for done in (tmp_path / f"{name}-{size}-state" / "commits").glob("*0*"):
                    done.unlink()
            assert not left_behind(spark, before)
            found = rows(read(spark, out))
            assert found == (want or found) and len(found) > 10
            want = found


def test_batches_that_add(spark, rows, tmp_path, monkeypatch):
    """Sums of what batches add, beside running totals of another run; a key of a single segment is not shuffled."""
    monkeypatch.setattr(store_module, "FAN", 3)
    store = CounterStore(spark, str(tmp_path / "store"), ["score"])
    assert store.commit(counts_df(spark, a=1, b=None), 0, "one", added=True) and not exchanged(store.read())
    assert rows(store.read(), "keyword", "score") == [("a", 1), ("b", None)]
    for batch in range(1, 5):
        assert store.commit(counts_df(spark, a=10), batch, "one", added=True) and not store.commit(counts_df(spark, a=10), batch, "one", added=True)
    store.commit(counts_df(spark, a=100), 0, "two")
    store.commit(counts_df(spark, a=300, c=7), 1, "two")
    assert rows(store.read(), "keyword", "score") == [("a", 341), ("b", None), ("c", 7)]
    assert len(store._manifest()[1]["segments"]) <= 5


def test_large_stores_are_added_up_in_slices_of_time(spark, rows, tmp_path, monkeypatch):
    """Totals of runs, what batches add, keys without a minute: slices give what the whole gives and leave no shuffle files, nor do commits."""
    minute = lambda i: None if i % 7 == 0 else f"2024-01-01 10:{i % 7:02d}:00"
    made = lambda n: spark.createDataFrame([(minute(i), f"k{i % 11}", i) for i in range(n)], "minute string, keyword string, score bigint").groupBy(
        F.col("minute").cast("timestamp").alias("minute"), "keyword").agg(F.sum("score").alias("score"))
    store, before = CounterStore(spark, str(tmp_path / "store"), ["score"]), shuffle_files(spark)
    for run, batch, n, added in (("one", 0, 20, False), ("one", 1, 50, False), ("two", 0, 40, False), ("three", 0, 60, True), ("three", 1, 30, True)):
        assert store.commit(made(n), batch, run, added=added)
    assert not left_behind(spark, before)
    columns = ("minute", "keyword", "score")
    start = F.lit("2024-01-01 10:02:00").cast("timestamp")
    part = lambda: rows(store.read(start, start + F.expr("INTERVAL 2 MINUTES")), *columns)
    whole, some = rows(store.read(), *columns), part()
    assert len(whole) == 60 and sum(r[2] for r in whole) == sum(sum(range(n)) for n in (50, 40, 60, 30)) and some
    before = shuffle_files(spark)
    for size in (100, 25):
        monkeypatch.setattr(store_module, "ROWS_PER_SLICE", size)
        found = store.read()
        assert not left_behind(spark, before) and not exchanged(found)
        assert rows(found, *columns) == whole and part() == some
        before = shuffle_files(spark)


def test_posts_are_made_in_more_tasks_for_more_events(spark, monkeypatch):
    """Events are small and get whole texts: adaptive execution would join them in a few tasks."""
    monkeypatch.setattr(bindings, "EVENTS_PER_TASK", 20)
    made = bindings.posts_table(spark, "/root/testdata/sf0.001")
    tasks = made.filter("type = 'reddit'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert made.count() == 1000 and tasks > 25
