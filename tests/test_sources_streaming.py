import json

import pytest
from pyspark.sql import functions as F

from colloquy.sources import readers as R
from colloquy.streaming import chunker as S


def test_conversation_shapes(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in [
        {"conversation_id": "c1", "messages": [{"role": "Agent", "text": "hi"}, {"role": "customer", "text": " "}, {"role": "customer", "content": "yo"}]},
        {"id": "c2", "transcript_segments": [{"speaker_role": "x", "message": "m", "message_index": 7}]}]) + "\nnot json\n")
    (tmp_path / "b.json").write_text(json.dumps({"conversations": [{"conversation_id": "c3", "messages": [{"role": "a", "text": "t"}]}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"conversation_id": "c4", "messages": [{"role": "a", "text": "t"}]}]))
    got = {tuple(r)[:4] for f in ("a.jsonl", "b.json", "l.json") for r in R.read_conversations(spark, str(tmp_path / f)).collect()}
    assert got == {("c1", 0, "agent", "hi"), ("c1", 2, "customer", "yo"), ("c2", 7, "x", "m"), ("c3", 0, "a", "t"), ("c4", 0, "a", "t")}
    with pytest.raises(ValueError):
        R.read_conversations(spark, str(tmp_path / "a.txt"))


def test_prices_sinks_and_resume(spark, tmp_path):
    (tmp_path / "p.csv").write_text("timestamp,symbol,open,high,low,close,volume\n2024-01-02 09:30:00,A,1,1,1,2.5,3\n2024-01-02T09:30:00+01:00,A,,,,2,\nbad,A,1,1,1,1,1\n")
    p = R.read_prices(spark, str(tmp_path / "p.csv"), "America/New_York")
    assert sorted(str(r.ts) for r in p.select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts")).collect()) == ["2024-01-02 08:30", "2024-01-02 14:30"]
    assert R.resume(spark, str(tmp_path / "t")) is None
    R.write_table(p.withColumn("tags", F.array(F.lit("a"), F.lit("b"))), str(tmp_path / "t"), partition_by=["symbol"])
    t = R.resume(spark, str(tmp_path / "t"))
    assert t.count() == 2
    R.write_csv(t.select("close", "tags"), str(tmp_path / "c"))
    R.write_jsonl(t, str(tmp_path / "j"))
    assert {r.tags for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {"a;b"}
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_pages_and_periods(spark):
    df = spark.createDataFrame([(1, "<nav>x</nav><p>A &amp; B</p><script>no</script><a class='l' href='/u'>go</a>"), (2, None)], "id int, html string")
    df2 = df.withColumn("base", F.lit("https://h.example/x"))
    assert [tuple(r) for r in R.page_links(df2, page="id", html="html", base="base").collect()] == [(1, 0, "https://h.example/u", "go")]
    assert [r[0] for r in df.select(R.page_text(F.col("html"))).collect()] == ["A & B go", ""]
    assert [r[0] for r in R.fiscal_periods(spark, "2024-05-06", 1).collect()] == ["2023_Q2", "2023_Q3", "2023_Q4", "2024_Q1", "2024_Q2"]


def test_streams_equal_batch(spark, sf, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").limit(400).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    run = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    run(S.tumbling(stream, ts="ts", key="event_type", value="value", window="1 day"), "tumbled", "complete")
    want = S.tumbling(batch, ts="ts", key="event_type", value="value", window="1 day")
    key = lambda df: sorted((r.event_type, str(r.start), r.n, round(r.total, 4)) for r in df.collect())
    assert key(spark.table("tumbled")) == key(want)
    run(S.distinct_within(stream, ts="ts", keys=["event_type"], late="60 days"), "firsts", "append")
    assert spark.table("firsts").count() == batch.select("event_type").distinct().count()


def test_stateful_chunker(spark, tmp_path):
    src = str(tmp_path / "seg")
    rows = [("k", float(10 * i), 10.0 * i + 9, f"segment number {i} with words") for i in range(9)]
    spark.createDataFrame(rows, "key string, start double, end double, text string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("key string, start double, end double, text string").parquet(src)
    q = S.chunk_segments(stream, idle_ms=None).writeStream.format("memory").queryName("chunks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.start, r.end, r.n_segments) for r in spark.table("chunks").collect())
    assert got == [(0.0, 29.0, 3), (30.0, 59.0, 3)]
