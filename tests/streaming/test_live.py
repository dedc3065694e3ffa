import datetime

from pyspark.sql import functions as F

from strandline.streaming import live


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows_close_behind_the_watermark(spark, sf_dir):
    got = run(live.live_histogram(stream(spark, sf_dir), "ts", "1 hour", "event_type"), "hist")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert 0.98 * batch.count() <= got.agg(F.sum("n")).first()[0] <= batch.count()
    sliding = run(live.live_histogram(stream(spark, sf_dir), "ts", "1 hour", slide="30 minutes"), "slide", "complete")
    assert sliding.agg(F.sum("n")).first()[0] == 2 * batch.count()


def test_sessions_alerts_first_seen(spark, sf_dir):
    sessions = run(live.live_sessions(stream(spark, sf_dir), "ts", "user_id", "12 hours"), "sessions")
    assert sessions.filter("n < 1 or end <= start").count() == 0 and sessions.count() > 10
    assert run(live.live_alerts(stream(spark, sf_dir), "event_type=error value>100"), "alerts").count() == spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error' and value > 100").count()
    seen = run(live.first_seen(stream(spark, sf_dir), ["user_id"], "ts", "60 days"), "seen")
    assert seen.count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()


def test_new_files_join_a_running_merge(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source, folder, marks = (str(tmp_path / n) for n in ("in", "counts", "marks"))
    keep = live.keep_counts(folder, ["event_type", "user_id", "__source"], "ts", 86_400_000)

    def add(rows, name):
        rows.coalesce(1).write.parquet(str(tmp_path / f"w-{name}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"w-{name}").glob("part-*")).rename(tmp_path / "in" / name)

    def settle():
        files = live.with_source(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source))
        files.writeStream.foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, live.kept_counts(spark, folder).collect()), key=str)

    def whole():
        return sorted(map(tuple, live.counts(live.with_source(spark.read.schema(events.schema).parquet(source)), ["event_type", "user_id", "__source"], "ts", 86_400_000).collect()), key=str)

    add(events.filter("event_id % 3 = 0"), "a.parquet")
    assert settle() == whole()
    add(events.filter("event_id % 3 = 1"), "b.parquet")
    add(events.filter("event_id % 3 = 2").withColumn("event_type", F.lit(None).cast("string")), "c.parquet")
    state = settle()
    assert state == whole() == settle() and sum(n for kind, name, _, n, *_ in state if name == "__source") == events.count()
    keep(live.with_source(spark.read.schema(events.schema).parquet(f"{source}/a.parquet")), 0)
    assert sorted(map(tuple, live.kept_counts(spark, folder).collect()), key=str) == state


def test_counts_of_no_rows_and_of_nulls(spark):
    stamp = datetime.datetime(1969, 12, 31, 23, 59, 59, tzinfo=datetime.timezone.utc)
    df = spark.createDataFrame([(None, None), ("", stamp), ("x", stamp)], "name string, at timestamp")
    got = sorted(map(tuple, live.counts(df, ["name"], "at", 60_000).collect()), key=str)
    assert got == [("facet", "name", "", 2, None, None), ("facet", "name", "x", 1, None, None), ("time", "at", "-60000", 2, -1000, -1000)]
    assert live.counts(df.limit(0), ["name"], "at").count() == 0
