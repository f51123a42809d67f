"""Physical plans: what reaches the scan, what is joined how, what stays out of Python."""

import math

from pyspark.sql import functions as F

from murmur.functions import words
from murmur.operators import filters, insights, joins, keywords, metrics, ranking, scoring, sets, text


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filters_reach_the_scan(t):
    raw = t.raw("events")
    p = plan(raw.filter(filters.times.since(F.col("ts"), "2024-01-31", days=7)).select("event_id"))
    assert "GreaterThanOrEqual(ts" in p and "LessThanOrEqual(ts" in p and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p
    p = plan(raw.filter(filters.times.between_days(F.col("ts"), "2024-01-02", "2024-01-03")))
    assert "GreaterThanOrEqual(ts" in p and "LessThan(ts" in p


def test_point_lookup_reaches_the_scan(t):
    assert "EqualTo(o_orderkey,77)" in plan(filters.by_id(t.hot_events, 77))


def test_no_cartesian_product_anywhere(t):
    texts = sets.all_texts(t.replies, t.articles)
    for df in (ranking.event_board(t.hot_events, t.comments), scoring.influence(t.hot_events, t.comments, "2001-08-01"),
               scoring.standardised(scoring.features(t.hot_events, t.comments)), keywords.polarity(texts, ["a", "b"], "sentiment_score"),
               keywords.timeline(texts, ["a", "b"], "2024-01-31", 30), keywords.compare(texts, ["a", "b"]), text.keywords(texts, 10),
               metrics.event_coverage(t.hot_events, t.comments, "2001-08-01"), metrics.risk_index(t.hot_events, t.comments, "2001-08-01"),
               joins.live_board(t.hot_events, t.comments, t.articles, "2001-08-01")):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p


def test_scoring_stays_out_of_python(t):
    texts = words.with_score(sets.all_texts(t.replies, t.articles), F.col("sentiment_score"))
    for df in (texts, text.keywords(texts, 10), keywords.polarity(texts, ["a"], "score")):
        p = plan(df)
        assert "Python" not in p and "Pandas" not in p


def test_events_are_aggregated_before_the_join(t):
    p = plan(ranking.event_board(t.hot_events, t.comments))
    assert p.index("Join") < p.index("partial_count_if" if "partial_count_if" in p else "partial_count")


def test_pages_are_cut_before_comments_are_counted(t):
    p = plan(ranking.heat_ranking(t.hot_events, t.comments, 10))
    assert "TakeOrderedAndProject" in p and "LeftSemi" in p


def test_text_counting_reads_only_the_text(spark, t):
    docs = spark.read.parquet(f"{t.folder}/documents.parquet")
    assert "ReadSchema: struct<text:string>" in plan(text.word_counts(docs, 5, "text"))


def test_text_tables_are_dealt_out_only_on_request(spark, t):
    from murmur.sources.views import TEXT_PARTS, Tables
    set_ = spark.conf.get(TEXT_PARTS)
    spark.conf.unset(TEXT_PARTS)
    try:
        assert "Exchange" not in plan(Tables(spark, t.folder).raw("documents"))
        assert "Exchange" in plan(Tables(spark, t.folder, 3).raw("documents"))
    finally:
        spark.conf.set(TEXT_PARTS, set_)


def bytes_read(spark, action):
    """What the file system has read more after an action."""
    statistics = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics()
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    settings.set("parquet.hadoop.vectored.io.enabled", "false")  # such reads are not counted
    try:
        before = statistics.get("file").getLong("bytesRead")
        action()
        return statistics.get("file").getLong("bytesRead") - before
    finally:
        settings.unset("parquet.hadoop.vectored.io.enabled")


def comment_rows(spark, first, count, step=1):
    """Comments of the stored form, by number."""
    from murmur.streaming import tables
    made = {"comment_id": F.sha1(F.col("id").cast("string")), "hot_title": F.lit("t"), "event_id": F.lit(1),
            "content": F.repeat(F.sha1(F.col("id").cast("string")), F.lit(3)), "sentiment_score": F.lit(0.5)}
    return spark.range(first, first + count * step, step).select("id", *[
        made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in tables.schemas.COMMENTS])


def test_a_batch_reads_what_it_needs_of_the_comments(spark, tmp_path):
    """200 epochs of 1,000 comments; a batch of 1,000 of which 20 have come before, in 20 epochs."""
    from murmur.streaming import ingest, tables
    root = str(tmp_path / "tables")
    log = comment_rows(spark, 0, 200_000).withColumn("source", F.lit("comment")).withColumn(
        "epoch", F.floor(F.col("id") / 1000)).drop("id")
    tables.keyed(log.repartition(8, "epoch").sortWithinPartitions("epoch", "comment_id"), "comment_id").partitionBy(
        "source", "epoch").parquet(f"{root}/comments")
    batch = comment_rows(spark, 0, 20, 10_007).unionByName(comment_rows(spark, 1_000_000, 980)).drop("id").persist()
    assert batch.count() == 1000

    def changed():
        row = ingest.changes(ingest.steps(spark, root, batch, 200)).collect()
        assert [(r.id, int(r.n)) for r in row] == [(1, 980)]  # the other 20 had the same score before

    looked_up = bytes_read(spark, changed)
    whole = bytes_read(spark, lambda: tables.read_texts_log(spark, root, "comments").select(
        "comment_id", "event_id", "sentiment_score").write.format("noop").mode("overwrite").save())
    p = plan(ingest.changes(ingest.steps(spark, root, batch, 200)))
    # Event, score, and what the history adds up: hour, content or none, likes. The bytes above are of all of them.
    read = "event_id:bigint,comment_id:string,content:string,publish_time:timestamp_ntz,like_count:int"
    assert "In(comment_id" in p and f"ReadSchema: struct<{read}" in p
    assert looked_up < whole / 3, (looked_up, whole)

    files = spark.read.parquet(f"{root}/comments")  # rows that leave the scan: pages of the 20, nothing of other files
    keys = [r[0] for r in batch.select("comment_id").collect()]
    found = files.filter(F.col("comment_id").isin(keys))
    found.collect()
    assert rows_of_scan(found._jdf.queryExecution().executedPlan()) <= 20 * 2 * tables.PAGE_ROWS


def rows_of_scan(node):
    """How many rows the scan below a node has given."""
    while not node.nodeName().startswith("Scan"):
        node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.children().head()
    return node.metrics().apply("numOutputRows").value()


def test_a_first_batch_sends_no_comment_to_look_for_earlier_ones(spark, tmp_path):
    from murmur.streaming import ingest, tables
    root, batch = str(tmp_path / "tables"), comment_rows(spark, 0, 10).drop("id")
    steps = ingest.steps(spark, root, batch, 0)
    assert "Join" not in plan(steps) and "Exchange" not in plan(steps)
    tables.write_texts(batch, root, "comments", "comment", 0)
    assert "Join" not in plan(ingest.steps(spark, root, batch, 0))  # a replay looks at no epoch but earlier ones
    later = ingest.steps(spark, root, batch, 1).agg(F.sum("n").alias("n")).first()
    assert "Join" in plan(ingest.steps(spark, root, batch, 1)) and later.n == 0


def test_rows_without_an_own_id_are_not_sent_to_meet_events_by_it(spark):
    from murmur.streaming import ingest
    events = spark.createDataFrame([(7, "a"), (3, "a"), (9, "b")], "id long, title string")
    rows = spark.createDataFrame([("1", "a", 9), ("2", "a", 5), ("3", "a", None), ("4", "new", None), ("5", "b", 7)],
                                 "comment_id string, hot_title string, event_id long")
    want = sorted(tuple(r) for r in ingest.resolved(rows, events).select("comment_id", "event_id").collect())
    got = ingest.placed(rows, events, ingest.titles_there(rows, events)).select("comment_id", "event_id")
    assert sorted(tuple(r) for r in got.collect()) == want and ("3", 3) in want and ("1", 9) in want and ("2", 3) in want
    assert "_own" not in plan(ingest.resolved(rows.drop("event_id"), events))


def test_a_batch_leaves_no_shuffle_files_and_no_second_copy(spark, tmp_path):
    import os
    import time

    from murmur.streaming import ingest, tables
    from murmur.streaming.folders import CLEANUP
    root, before = str(tmp_path / "tables"), spark.conf.get(CLEANUP, None)
    batch = spark.range(20_000).select(*[
        {"comment_id": F.sha1(F.col("id").cast("string")), "hot_title": F.concat(F.lit("t"), F.col("id") % 9),
         "content": F.sha2(F.col("id").cast("string"), 512), "publish_time": F.lit("2024-01-10"), "crawl_time": F.lit("2024-01-10")}.get(
             f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in tables.schemas.COMMENTS if f.name != "event_id"])

    def kept():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    were = kept()
    ingest.save_texts(batch, 0, root, "comment")
    for _ in range(20):
        if kept() - were < 1_000_000:
            break
        time.sleep(0.5)
    assert kept() - were < 1_000_000  # a batch is 3.4 MB of keys and texts, sent once
    assert spark.conf.get(CLEANUP, None) == before
    assert not os.path.exists(f"{root}/comments_staged/source=comment/epoch=0")
    assert tables.read_table(spark, root, "comments").count() == 20_000


def test_few_and_many_keys_find_the_same(spark, tmp_path, monkeypatch):
    from murmur.streaming import tables
    root = str(tmp_path / "tables")
    for epoch in range(3):
        tables.write_texts(comment_rows(spark, 50 * epoch, 100).drop("id"), root, "comments", "comment", epoch)
    batch = comment_rows(spark, 60, 30).unionByName(comment_rows(spark, 500, 10)).drop("id")

    def found():
        return sorted((r.comment_id, r.epoch) for r in tables.earlier_rows(spark, root, "comments", batch, "comment", 2).collect())

    few = found()
    monkeypatch.setattr(tables, "FEW_KEYS", 5)
    assert found() == few and len(few) == 60


def test_a_batch_opens_the_folders_of_its_titles(spark, tmp_path):
    from murmur.streaming import tables
    root = str(tmp_path / "tables")
    titles = spark.range(5000).select(F.concat(F.lit("title "), "id").alias("title"))
    for epoch in range(2):
        tables.write_titles(titles.filter(F.expr(f"length(title) % 2 = {epoch}")), root, "comment", epoch)
    asked = titles.limit(10).unionByName(spark.createDataFrame([("new",)], "title string")).withColumnRenamed("title", "hot_title")
    known = tables.known_titles(spark, root, asked, "comment", 2)
    assert known.count() == 10
    p = plan(known)
    assert "PartitionFilters" in p and "slot" in p.split("PartitionFilters")[1].split("\n")[0]
    slots = {r[0] for r in asked.select(tables.slot("hot_title")).collect()}
    files = tables.read_log(spark, f"{root}/titles", tables.TITLE_LOG, "slot").filter(F.col("slot").isin(sorted(slots)))
    assert files.rdd.getNumPartitions() <= 2 * 11 and len(slots) <= 11


def test_the_newest_rank_snapshot_is_found_by_its_folder(spark, tmp_path):
    from murmur.streaming import ingest, tables
    root = str(tmp_path / "tables")
    rows = "'t' AS title, 1 AS rank, CAST('u' AS STRING) AS url, 5L AS heat"
    for epoch, day in enumerate((3, 9, 5)):
        batch = spark.range(1).select(F.expr(f"TIMESTAMP_NTZ'2024-01-0{day} 10:00:00' AS crawl_time"), *[
            F.expr(x) for x in rows.split(", ")])
        ingest.save_rank(batch.select(*[F.col(f.name).cast(f.dataType) for f in tables.RANK_LOG]), epoch, root)
    for _ in range(2):
        newest = tables.read_rank(spark, root)
        assert [str(r.crawl_time) for r in newest.collect()] == ["2024-01-09 10:00:00"]
        p = plan(newest)
        assert "taken" in p.split("PartitionFilters")[1].split("\n")[0] and "max(" not in p
        tables.compact(spark, root, "rank")
    every = tables.read_log(spark, f"{root}/rank", tables.RANK_LOG, "taken")
    assert every.select("taken").distinct().count() == 3


def test_keywords_per_event_clean_each_text_once(spark, tmp_path):
    """Before, idf read the texts without the test for an event that the joins had put into all other uses."""
    rows = [(1, "red sea"), (1, "red fox"), (2, "red"), (None, "fox"), (None, " fox "), (None, "")]
    spark.createDataFrame(rows, "event_id long, content string").write.parquet(str(tmp_path / "texts"))
    words_of = text.keywords_per_event(spark.read.parquet(str(tmp_path / "texts")))
    assert "PushedFilters: []" not in plan(words_of)
    n_texts, held = 4, {"red": 3, "sea": 1, "fox": 2}  # of texts without an event one is blank, two are equal when cleaned
    want = {(e, w): n / total * math.log((n_texts + 1) / (held[w] + 1))
            for e, w, n, total in ((1, "red", 2, 4), (1, "sea", 1, 4), (1, "fox", 1, 4), (2, "red", 1, 1))}
    got = {(r.event_id, r.word): r.weight for r in words_of.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_influence_and_features_read_the_comments_once(spark, t):
    both = scoring.influence(t.hot_events, t.comments, "2001-08-01").join(
        scoring.features(t.hot_events, t.comments).select("id", F.struct("comment_count", "avg_sentiment", "avg_likes").alias("x")), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else a plan tells of shared steps only after it has run
    try:
        assert plan(both).count("partial_count(1)") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_words_of_insights_are_not_sorted_again(t):
    top = text.keywords_per_event(keywords.texts_with_titles(t.hot_events, t.replies))
    p = plan(insights.event_insights(t.hot_events, t.comments, top_words=top).select("id", "key_findings"))
    assert "collect_list" not in p and "date_format" not in p


def test_influence_counts_missing_scores_as_half(spark):
    said = [(1, None, None), (1, 3, "0.9"), (2, None, None)]
    comments = spark.createDataFrame(said, "event_id long, like_count int, sentiment_score string").withColumn(
        "sentiment_score", F.col("sentiment_score").cast("decimal(4,3)"))
    events = spark.createDataFrame([(1,), (2,), (3,)], "id long").withColumns(
        {"heat": F.lit(0), "crawl_time": F.lit("2024-01-01").cast("timestamp_ntz")})
    got = {r.id: (r.comment_count, round(r.sentiment_factor, 9), round(r.engagement_factor, 9))
           for r in scoring.influence(events, comments, "2024-01-02").collect()}
    assert got == {1: (2, 0.7, 0.15), 2: (1, 0.5, 0.0), 3: (0, 0.5, 0.0)}
