"""Decoding, merge rules, replay, several batches and late rows."""

import json

import pytest
from pyspark.sql import functions as F

from murmur.functions import bands
from murmur.operators import metrics
from murmur.sources import readers, writers
from murmur.streaming import decode, histories, ingest, live, tables


def envelope(*rows, send_time="2024-01-31 00:00:00"):
    return json.dumps({"send_time": send_time, "data": list(rows)}, ensure_ascii=False)


def event(title="t", crawl="2024-01-01 00:00:00", **more):
    return {"title": title, "crawl_time": crawl, **more}


def comment(cid="c1", title="t", crawl="2024-01-01 00:00:00", publish="2023-12-31 10:00", **more):
    return {"comment_id": cid, "hot_title": title, "crawl_time": crawl, "publish_time": publish, **more}


def article(aid="a1", title="t", crawl="2024-01-01 00:00:00", publish="2023-12-31 10:00", **more):
    return {"article_id": aid, "hot_title": title, "crawl_time": crawl, "publish_time": publish, **more}


def lines(spark, *texts):
    return spark.createDataFrame([(x,) for x in texts], "value string")


def send(folder, name, *texts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(texts) + "\n", encoding="utf-8")


@pytest.fixture
def run(spark, tmp_path):
    """Sends one file and lets its stream run dry."""
    count = iter(range(1000))

    def go(kind, *texts, **options):
        send(tmp_path / kind, f"{next(count):04d}.txt", *texts)
        source = readers.file_stream(spark, str(tmp_path / kind), 1)
        ingest.run(spark, {kind: source}, str(tmp_path / "tables"), str(tmp_path / "marks"), available_now=True, **options)
        return str(tmp_path / "tables")
    return go


def test_decode_shapes(spark):
    rows = decode.decode(lines(spark, envelope(event("a"), event("b")), json.dumps({"send_time": "x", "data": event("c")}),
                               "junk", '{"data": 5}', '{"data": []}', json.dumps([event("d")])), "event")
    assert sorted(r.title for r in rows.collect()) == ["a", "b", "c"]


def test_one_bad_element_does_not_spoil_its_neighbours(spark):
    text = envelope(event("a", heat=5), "oops", None, event("b", heat="many"))
    rows = {r.title: r.heat for r in decode.clean(decode.decode(lines(spark, text), "event"), "event").collect()}
    assert rows == {"a": 5, "b": 0}


def test_required_and_filled(spark):
    text = envelope(comment("1"), comment(None), comment("2", title=None), comment("3", publish="junk"), comment("4", crawl=None),
                    comment("5", like_count=7, location="x", hot_rank=3))
    got = {r.comment_id: r for r in decode.clean(decode.decode(lines(spark, text), "comment"), "comment").collect()}
    assert set(got) == {"1", "5"}
    assert (got["1"].like_count, got["1"].location, got["1"].content, float(got["1"].sentiment_score)) == (0, "unknown", "no content", 0.5)
    assert got["5"].like_count == 7 and got["5"].location == "x" and "hot_rank" not in got["5"].asDict()


def test_event_upsert_keeps_score_when_message_has_none(spark, run):
    run("event", envelope(event("t", heat=5, sentiment_score=0.9)))
    root = run("event", envelope(event("t", "2024-01-02 00:00:00", heat=8), event("u", heat=1)))
    got = {r.title: r for r in tables.read_events(spark, root).collect()}
    assert (got["t"].heat, float(got["t"].sentiment_score), str(got["t"].crawl_time)) == (8, 0.9, "2024-01-02 00:00:00")
    assert float(got["u"].sentiment_score) == 0.5


def test_later_batch_wins_even_when_crawled_earlier(spark, run):
    run("event", envelope(event("t", "2024-01-05 00:00:00", heat=5)))
    root = run("event", envelope(event("t", "2024-01-01 00:00:00", heat=3)))
    assert tables.read_events(spark, root).first().heat == 3


def test_article_merge_rules(spark, run):
    run("article", envelope(article(author="first", content="one", like_count=1)))
    root = run("article", envelope(article(author="second", content="two", like_count=9, title="other", publish="2024-01-01 10:00")))
    row = tables.read_table(spark, root, "articles").first()
    assert (row.author, row.content, row.like_count, row.hot_title) == ("first", "one", 9, "other")
    assert str(row.publish_time) == "2023-12-31 10:00:00"
    events = {r.title: r.id for r in tables.read_events(spark, root).collect()}
    assert set(events) == {"t", "other"} and row.event_id == events["t"]


def test_comment_events_resolve(spark, run):
    run("event", envelope(event("known", heat=7)))
    root = run("comment", envelope(comment("1", "known"), comment("2", "new"), comment("3", "new", event_id=42)))
    events = {r.title: r for r in tables.read_events(spark, root).collect()}
    ids = {r.comment_id: r.event_id for r in tables.read_table(spark, root, "comments").collect()}
    assert ids == {"1": events["known"].id, "2": events["new"].id, "3": events["new"].id}  # 42 is no id of this store
    assert events["known"].heat == 7 and events["new"].heat == 0


def test_titles_of_another_store_keep_their_ids(spark):
    rows = spark.createDataFrame([("1", "known", None), ("2", "new", None), ("3", "known", 5), ("4", "new", 12)],
                                 "comment_id string, hot_title string, event_id long")
    known = spark.createDataFrame([(11, "known"), (12, "known")], "id long, title string")
    got = {r.comment_id: r.event_id for r in ingest.resolved(rows, known).collect()}
    assert got["1"] == 11 and got["3"] == 11 and got["4"] == 12 and got["2"] not in (5, 11, 12, None)


def test_rows_without_an_own_id_are_not_one_group(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("comment_id"), F.lit("known").alias("hot_title"),
                                    F.when(F.col("id") < 500, F.col("id") % 5).alias("event_id"))
    keyed = rows.select(F.col("event_id").isNull().alias("none"), ingest.own_key(F.col("event_id"), rows.columns).alias("k"))
    kinds = {r.none: r.n for r in keyed.groupBy("none").agg(F.count_distinct("k").alias("n")).collect()}
    assert kinds[True] > 500 and kinds[False] == 5
    known = spark.createDataFrame([(11, "known"), (3, "other")], "id long, title string")
    got = ingest.resolved(rows, known)
    assert {r.event_id: r["count"] for r in got.groupBy("event_id").count().collect()} == {11: 1900, 3: 100}


def test_a_running_stream_resolves_against_another_store(spark, run):
    def store(session):
        return session.createDataFrame([(11, "known"), (12, "known")], "id long, title string")

    root = run("comment", envelope(comment("1", "known"), comment("2", "new"), comment("3", "known", event_id=12)), known=store)
    ids = {r.comment_id: r.event_id for r in tables.read_table(spark, root, "comments").collect()}
    stubs = {r.title: r.id for r in tables.read_events(spark, root).collect()}
    assert stubs == {"new": ids["2"]} and ids["1"] == 11 and ids["3"] == 12


def test_scores_refresh_for_touched_events_only(spark, run):
    run("event", envelope(event("t"), event("u", sentiment_score=0.2)))
    run("comment", envelope(comment("1", "t", sentiment_score=0.9), comment("2", "t", sentiment_score=0.5)))
    root = run("comment", envelope(comment("1", "t", sentiment_score=0.1)))
    got = {r.title: float(r.sentiment_score) for r in tables.read_events(spark, root).collect()}
    assert got == {"t": 0.3, "u": 0.2}


def test_newer_score_wins_over_an_older_one_with_a_higher_epoch(spark, run):
    run("comment", envelope(comment("1", "t", sentiment_score=0.9)))
    for i in range(3):
        run("article", envelope(article(f"a{i}", "t")))
    root = run("comment", envelope(comment("2", "t", sentiment_score=0.1)))
    assert float(tables.read_events(spark, root).first().sentiment_score) == 0.5
    run("article", envelope(article("a9", "t")))
    assert float(tables.read_events(spark, root).first().sentiment_score) == 0.5


def test_comment_counts_for_the_event_it_was_first_placed_in(spark, run):
    run("comment", envelope(comment("1", "t", sentiment_score=0.9), comment("2", "u", sentiment_score=0.3)))
    root = run("comment", envelope(comment("1", "u", sentiment_score=0.7)))
    got = {r.title: float(r.sentiment_score) for r in tables.read_events(spark, root).collect()}
    assert got["u"] == 0.3


def test_stub_stands_until_its_event_arrives(spark, run):
    run("comment", envelope(comment("1", "t", sentiment_score=0.9)))
    root = run("event", envelope(event("t", "2024-03-01 00:00:00", heat=99)))
    rows = tables.read_events(spark, root).collect()
    assert len(rows) == 1 and rows[0].heat == 99 and str(rows[0].crawl_time) == "2024-03-01 00:00:00"


def test_replayed_epoch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "tables")
    first = decode.clean(decode.decode(lines(spark, envelope(comment("1", like_count=1), comment("2"), comment("2", like_count=4))), "comment"), "comment")
    second = decode.clean(decode.decode(lines(spark, envelope(comment("1", like_count=5))), "comment"), "comment")

    def state():
        return (sorted(map(str, tables.read_table(spark, root, "comments").collect())), sorted(map(str, tables.read_events(spark, root).collect())))

    ingest.save_texts(first, 0, root, "comment")
    ingest.save_texts(second, 1, root, "comment")
    before = state()
    ingest.save_texts(second, 1, root, "comment")
    assert state() == before
    likes = {r.comment_id: r.like_count for r in tables.read_table(spark, root, "comments").collect()}
    assert likes == {"1": 5, "2": 4}


def test_histories_of_the_stream_equal_those_of_its_comments(spark, run):
    """Revised, repeated and replayed comments: the history has each once, where it was first placed, as it is last."""
    first = [comment(str(k), f"t{k % 3}", publish=f"2023-12-{29 + k % 3} {k % 24:02d}:30", like_count=k, content="x" * (k % 4),
                     **({"sentiment_score": k % 11 / 10} if k % 5 else {})) for k in range(40)]
    root = run("comment", envelope(*first))
    run("comment", envelope(comment("1", "t2", publish="2024-01-03 10:00", like_count=50, sentiment_score=0.95, content="moved"),
                            comment("5", "t0", like_count=2, sentiment_score=0.1), *first[10:14]))
    run("comment", envelope(comment("1", "t2", like_count=3), comment("new", "t9", publish="2024-01-02 00:00", sentiment_score=0.7)))

    def agree():
        rows, history = tables.read_table(spark, root, "comments").drop("crawl_time"), tables.read_history(spark, root)
        pairs = [(histories.hourly(history), metrics.hourly_history(rows)), (histories.daily(history), metrics.daily_history(rows)),
                 (histories.trend(history, 3), metrics.sentiment_trend(rows, 3)),
                 (histories.daily_bands(history), metrics.daily(rows, F.count(F.lit(1)).alias("n"), *bands.counts(F.col("sentiment_score")))),
                 (histories.daily(history, "2023-12-30", "2023-12-31"),
                  metrics.daily_history(rows.filter("publish_time >= '2023-12-30' AND publish_time < '2024-01-01'")))]
        for ours, plain in pairs:
            assert sorted(map(tuple, ours.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect())) != []
        per_event = histories.event_days(history).groupBy("id").agg(F.sum("n").alias("n"), F.sum("likes").alias("likes"))
        want = rows.filter("publish_time IS NOT NULL").groupBy("event_id").agg(F.count(F.lit(1)), F.sum("like_count"))
        assert sorted(map(tuple, per_event.collect())) == sorted(map(tuple, want.collect()))

    agree()
    for table in ("comments", "comment_history"):
        tables.compact(spark, root, table)
        agree()
    run("comment", envelope(comment("1", "t2", like_count=8, sentiment_score=0.4), *first[:5]))
    agree()
    assert not any("/comments/" in f for f in tables.read_history(spark, root).inputFiles())
    empty = tables.read_history(spark, f"{root}-none")
    assert histories.hourly(empty).count() == histories.trend(empty).count() == 0


def test_replayed_message_file_changes_nothing(spark, run):
    text = envelope(comment("1", like_count=3), comment("2"))
    root = run("comment", text)
    before = sorted(map(str, tables.read_table(spark, root, "comments").collect()))
    run("comment", text)
    assert sorted(map(str, tables.read_table(spark, root, "comments").collect())) == before


def test_an_event_without_comments_has_the_score_of_its_title(spark, run):
    root = run("event", envelope(event("a good day"), event("a bad day"), event("told", sentiment_score=0.1)))
    got = {r.title: float(r.sentiment_score) for r in tables.read_events(spark, root).collect()}
    assert got["a good day"] > 0.5 > got["a bad day"] and got["told"] == 0.1


def test_compacted_logs_read_the_same_and_go_on(spark, run, tmp_path):
    run("event", envelope(event("t", heat=5), event("u", heat=2, sentiment_score=0.4)))
    run("comment", envelope(comment("1", like_count=3, sentiment_score=0.9), comment("2", "v")))
    root = run("comment", envelope(comment("1", like_count=8, sentiment_score=0.2)))
    run("article", envelope(article("a1", "t"), article("a2", "w")))

    def state():
        return [sorted(map(str, tables.read_table(spark, root, n).collect())) for n in ("comments", "articles")] + [
            sorted(map(str, tables.read_events(spark, root).collect()))]

    before = state()
    for table in ("comments", "articles", "events", "comments"):
        tables.compact(spark, root, table)
        assert state() == before
    left = sorted(p.name for p in (tmp_path / "tables" / "comments").rglob("epoch=*"))
    assert left == ["epoch=2"]
    run("comment", envelope(comment("1", like_count=9, sentiment_score=0.6), comment("3", "t", sentiment_score=0.2)))
    got = {r.title: float(r.sentiment_score) for r in tables.read_events(spark, root).collect()}
    assert got["t"] == 0.4 and got["u"] == 0.4
    likes = {r.comment_id: r.like_count for r in tables.read_table(spark, root, "comments").collect()}
    assert likes == {"1": 9, "2": 0, "3": 0}


def test_an_epoch_replayed_after_compaction_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "tables")
    batch = decode.clean(decode.decode(lines(spark, envelope(comment("1", sentiment_score=0.9), comment("2", sentiment_score=0.1))), "comment"), "comment")
    ingest.save_texts(batch, 0, root, "comment")
    tables.compact(spark, root, "comments")
    before = sorted(map(str, tables.read_events(spark, root).collect()))
    ingest.save_texts(batch, 0, root, "comment")
    assert sorted(map(str, tables.read_events(spark, root).collect())) == before
    assert tables.read_table(spark, root, "comments").count() == 2


def test_an_unfinished_compaction_does_not_count(spark, tmp_path):
    root = str(tmp_path / "tables")
    batch = decode.clean(decode.decode(lines(spark, envelope(comment("1"))), "comment"), "comment")
    ingest.save_texts(batch, 0, root, "comment")
    spark.createDataFrame([("comment", 0)], "source string, epoch long").write.parquet(f"{root}/comments_folds/fold=1")
    assert tables.read_table(spark, root, "comments").count() == 1


def test_quality_counters(spark, tmp_path):
    send(tmp_path / "in", "1.txt", envelope(comment("1"), comment("2", publish=None), comment("3", crawl=None)))
    query = ingest.start(readers.file_stream(spark, str(tmp_path / "in")), "comment", str(tmp_path / "t"), str(tmp_path / "m"), True)
    query.awaitTermination()
    seen = [p.observedMetrics.get("comment_quality") for p in query.recentProgress]
    assert [tuple(s) for s in seen if s and s[0]] == [(3, 1, 1)]


def test_latest_rank_snapshot(spark, tmp_path):
    rows = [{"rank": i, "title": f"t{i}", "url": "u", "heat": i, "crawl_time": f"2024-01-01 00:0{m}:00"} for m in (1, 2) for i in (1, 2)]
    send(tmp_path / "in", "1.txt", envelope(*rows[2:]))
    send(tmp_path / "in", "2.txt", envelope(*rows[:2]))
    ingest.start_rank(readers.file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "t"), str(tmp_path / "m"), True).awaitTermination()
    got = ingest.read_rank(spark, str(tmp_path / "t")).collect()
    assert sorted((r.rank, r.crawl_time.minute) for r in got) == [(1, 2), (2, 2)]


def test_envelopes_round_trip(spark):
    df = spark.range(250).select(F.concat(F.lit('say "hi", 好 '), "id").alias("title"), F.lit("2024-01-01 00:00:00").alias("crawl_time"))
    packed = writers.envelopes(df, "now", 100)
    assert all(len(json.loads(r.value)["data"]) <= 100 for r in packed.collect())
    back = decode.decode(packed, "event").select("title", "crawl_time")
    assert sorted(back.collect()) == sorted(df.collect())
    assert writers.envelopes(df.limit(0), "now").count() == 0


def test_envelopes_are_put_together_where_the_rows_are(spark, tmp_path):
    df = spark.range(0, 250, 1, 3).select(F.col("id").cast("string").alias("title"), F.lit("2024-01-01 00:00:00").alias("crawl_time"))
    packed = writers.envelopes(df, "now", 40)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    sizes = sorted(len(json.loads(r.value)["data"]) for r in packed.collect())
    assert sum(sizes) == 250 and sizes.count(40) == 6 and min(sizes) > 0
    writers.publish_files(packed, str(tmp_path / "out"))
    plain = sum(len(r.value.encode()) for r in packed.collect())
    assert 0 < sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*")) < plain / 2
    back = decode.decode(spark.read.text(str(tmp_path / "out")), "event").select("title", "crawl_time")
    assert sorted(back.collect()) == sorted(df.collect())
    writers.publish_files(packed.coalesce(1), str(tmp_path / "few"), per_file=2)
    assert len(list((tmp_path / "few").glob("part-*"))) == 5


def test_each_object_of_an_envelope_is_written_once(spark):
    """Before, a filter on the objects became one on their columns, which wrote every object a second time."""
    df = spark.range(0, 250, 1, 1).select(F.when(F.col("id") % 5 > 0, F.concat(F.lit("好 "), "id")).alias("title"))
    packed = writers.envelopes(df, "now", 30)
    assert packed._jdf.queryExecution().executedPlan().toString().count("StructsToJsonEvaluator") == 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # envelopes go on over batches, and end within one
    try:
        for size, least in ((30, 7), (3, 67)):
            sent = [json.loads(r.value)["data"] for r in writers.envelopes(df, "now", size).collect()]
            assert len(sent) == least and all(len(x) == size for x in sent[:-1])
            assert [x["title"] for part in sent for x in part] == [f"好 {k}" for k in range(250) if k % 5]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keyed_messages(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), (None, "x")], "title string, crawl_time string")
    got = writers.keyed_messages(df, "title", "now").collect()
    assert [r.key for r in got] == ["a"] and json.loads(got[0].value)["data"] == [{"title": "a", "crawl_time": "2024-01-01 00:00:00"}]


def test_late_rows_and_windows(spark, tmp_path):
    def part(name, *rows):
        send(tmp_path / "in", name, *[json.dumps({"event_id": 1, "like_count": 1, "sentiment_score": 0.5, "publish_time": p}) for p in rows])

    schema = "event_id long, like_count int, sentiment_score decimal(4,3), publish_time timestamp_ntz"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    part("1.json", "2024-01-01 10:00:10", "2024-01-01 10:00:20", "2024-01-01 10:05:00")
    live.start_rolling(source, out, marks, True, delay="10 minutes").awaitTermination()
    part("2.json", "2024-01-01 10:00:30", "2024-01-01 10:30:00")   # late but within the delay
    live.start_rolling(source, out, marks, True, delay="10 minutes").awaitTermination()
    part("3.json", "2024-01-01 10:00:40", "2024-01-01 11:30:00")   # too late: its window is out
    last = live.start_rolling(source, out, marks, True, delay="10 minutes")
    last.awaitTermination()
    assert live.late_rows(last) == 1
    got = {r.start: r.n for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01 10:00"] == 3 and got["2024-01-01 10:05"] == 1 and got["2024-01-01 10:30"] == 1


def test_run_stops_the_others_when_one_fails(spark, tmp_path):
    send(tmp_path / "in", "1.txt", envelope(event("t")))
    good = readers.file_stream(spark, str(tmp_path / "in"))
    boom = good.select(F.raise_error(F.lit("boom")).alias("value"))
    with pytest.raises(Exception, match="boom|USER_RAISED"):
        ingest.run(spark, {"event": good, "comment": boom}, str(tmp_path / "t"), str(tmp_path / "m"), trigger="100 milliseconds")
    assert not spark.streams.active


def test_kafka_source_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        readers.kafka_stream(spark, "localhost:9092", "topic", max_offsets=100)


def test_kafka_options(spark):
    class Reader:
        def __init__(self):
            self.set, self.kind = {}, None

        def format(self, kind):
            self.kind = kind
            return self

        def option(self, key, value):
            self.set[key] = value
            return self

        def options(self, **more):
            self.set.update(more)
            return self

        def load(self):
            return self

        def select(self, column):
            return self

    class Session:
        readStream = Reader()

    got = readers.kafka_stream(Session(), "a:1,b:2", "topic", "earliest", 500, minPartitions=8)
    assert got.kind == "kafka" and got.set == {
        "kafka.bootstrap.servers": "a:1,b:2", "subscribe": "topic", "startingOffsets": "earliest", "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": 500, "minPartitions": 8}


def test_a_shared_folder_must_be_named(spark):
    from murmur.streaming.folders import SETTING, shared_folder

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match=SETTING):
        shared_folder(Session(), "x")
    assert shared_folder(spark, "x").startswith(spark.conf.get(SETTING))


def test_exports(spark, t, tmp_path):
    with pytest.raises(ValueError):
        writers.export_all({"events": t.hot_events}, "1900-01-01", "1900-01-02", str(tmp_path / "none"))
    assert writers.export_all({"events": t.hot_events}, "1990-01-01", "2030-01-01", str(tmp_path / "all")) == ["events"]
    back = spark.read.option("header", True).csv(str(tmp_path / "all" / "events"))
    assert back.count() == t.hot_events.count() and back.columns == ["id", "title", "crawl_time", "heat", "sentiment_score"]


def test_a_merge_sorts_rows_in_the_task_of_their_key_only(spark, tmp_path):
    """Before, all columns were sorted in the map tasks too, and two or three copies of them were sent."""
    root, text = str(tmp_path / "tables"), envelope(comment("1", like_count=1), comment("1", like_count=4), comment("2"))
    batch = decode.clean(decode.decode(lines(spark, text), "comment"), "comment")
    ingest.save_texts(batch, 0, root, "comment")

    def below_exchange(df):
        plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        return plan[plan.index("Exchange hashpartitioning(comment_id"):]

    for df in (tables.reduced(ingest.resolved(batch), "comments"), tables.read_table(spark, root, "comments")):
        assert "Aggregate" not in below_exchange(df) and "Sort" not in below_exchange(df)
    narrow = tables.read_table(spark, root, "comments").select("like_count")._jdf.queryExecution().executedPlan().toString()
    assert "like_count" in narrow and "content" not in narrow and "hot_title" not in narrow


def test_envelopes_that_fit_are_parsed_once_and_read_the_same(spark):
    odd = [envelope(comment("1", like_count=3, content="a \"b\" 好"), comment("2", user_id=7, location={"x": [1, 2.50]})), envelope(),
           envelope(comment("3", like_count="many"), comment("4", like_count=2.5), comment("5", sentiment_score="0.5")),
           json.dumps({"data": comment("6")}), json.dumps({"data": [json.dumps(comment("7")), [comment("8")], comment("9")]}),
           json.dumps({"data": [comment("10"), None, {}]}), envelope(comment("11"))[:-3], envelope(comment("12")) + " junk", "[]", "", None]
    got = decode.decode(spark.createDataFrame([(x,) for x in odd], "value string"), "comment")
    alone = spark.createDataFrame([(x,) for x in odd], "value string").select(F.col("value").alias("body"))
    many, one = (F.from_json("body", s)["data"] for s in (decode.schemas.ENVELOPE, decode.schemas.ENVELOPE_ONE))
    items = alone.select(F.explode(F.coalesce(many, F.when(F.ltrim(one).startswith("{"), F.array(one)))).alias("item"))
    plain = items.select(F.inline(F.array(F.from_json("item", decode.schemas.COMMENT_MESSAGE))))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert {"1", "3", "6", "7", "12"} <= {r.comment_id for r in got.collect()}


def test_a_batch_reads_its_rows_once_for_sums_and_history(spark, tmp_path):
    root = str(tmp_path / "tables")
    for epoch, score in enumerate((0.9, 0.1)):
        rows = [comment(str(k), f"t{k % 2}", publish=f"2023-12-31 {k:02d}:00", sentiment_score=score) for k in range(8)]
        ingest.save_texts(decode.clean(decode.decode(lines(spark, envelope(*rows)), "comment"), "comment"), epoch, root, "comment")
    summed = spark.read.parquet(f"{root}/event_sums")
    assert sorted((int(r.n), float(r.total)) for r in summed.collect()) == [(0, -3.2), (0, -3.2), (4, 3.6), (4, 3.6)]


def test_a_second_compaction_moves_no_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")
    for epoch in (0, 1):
        text = envelope(*[comment(str(k), like_count=k + epoch) for k in range(50)])
        ingest.save_texts(decode.clean(decode.decode(lines(spark, text), "comment"), "comment"), epoch, root, "comment")
    tables.compact(spark, root, "comments")
    before = sorted(map(str, tables.read_table(spark, root, "comments").collect()))
    monkeypatch.delitem(tables._WHOLE, "comments")  # the merge, which deals the rows out
    tables.compact(spark, root, "comments")
    assert sorted(map(str, tables.read_table(spark, root, "comments").collect())) == before and len(before) == 50
