from byteloom.streaming import profile


def run(df, spark, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    docs, events = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "events"))
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = lambda df, d: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{d}")
    assert run(profile.fingerprint(stream(docs, "docs")), spark, "prints", tmp_path) == sorted(map(tuple, profile.fingerprint(docs).collect()))
    want = sorted(map(tuple, profile.windowed_buckets(events).collect()))
    assert run(profile.windowed_buckets(stream(events, "events")), spark, "windows", tmp_path, "complete") == want and want
    # appended windows are those that the watermark has passed
    closed = run(profile.windowed_buckets(stream(events, "events")), spark, "closed", tmp_path)
    assert set(closed) <= set(want)
