import json

import pytest
from pyspark.sql import functions as F

from colloquy.sources import files as R
from colloquy.sources import plugins as P
from colloquy.sources import readers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n[2]\nbroken\n{"a": 3}\n')
    good, bad = R.read_jsonl_with_errors(spark, str(p), "a int")
    assert rows(good.select("a", "line_no")) == [(1, 1), (3, 5)] and rows(bad.select("line_no", "error")) == [(3, "non_object"), (4, "invalid_json")]
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(p), "a int").collect()


def test_supervised(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text(json.dumps({"text": " hi ", "label": "neutral"}) + "\n")
    r = R.read_supervised(spark, str(p)).head()
    assert (r.text, r.signal_family, r.domain, r.message_index, r.pii_redacted, r.source_path) == ("hi", "neutral", "unknown", 0, False, "s.jsonl")
    p.write_text(json.dumps({"text": "hi", "label": "odd"}) + "\n")
    with pytest.raises(Exception, match="invalid labelled example"):
        R.read_supervised(spark, str(tmp_path / "s.jsonl")).collect()


def test_labelled_csv_and_ingest(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text('text,label\n"good, yes",Positive\n,negative\nx,odd\n')
    got = R.read_labelled_csv(spark, str(p), families=R.PHRASEBANK)
    assert rows(got.select("text", "mapped_signal_label")) == [("good, yes", "opportunity_commitment"), ("x", "unmapped")]
    with pytest.raises(ValueError):
        R.read_labelled_csv(spark, str(p), text="body")
    a = spark.createDataFrame([("x", None), (" ", None), (None, "a.wav")], "text string, audio_path string")
    good, n = R.ingest({"a": a, "b": a.limit(0).drop("audio_path")})
    assert good.count() == 2 and rows(n) == [("a", 2, 1), ("b", 0, 0)]


def test_hashes_documents_and_chunks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "transcript.txt").write_text("One sentence here. " * 200)
    (tmp_path / "t" / "c.event_chunks.jsonl").write_text('{"section": "qna", "speaker": "A", "text": " hi  there "}\n{"text": " "}\n')
    (tmp_path / "t" / "s.json").write_text('[{"section": "x", "text": "short"}, {"speaker": "B", "text": "other"}]')
    h = R.file_hashes(spark, str(tmp_path / "t" / "s.json")).head()
    assert len(h.sha256) == 64
    c = R.read_transcript_chunks(spark, str(tmp_path / "t")).select(F.regexp_extract("file", "([^/]+)$", 1).alias("f"), "chunk_index", "section", "speaker", F.length("text").alias("n"))
    got = rows(c)
    assert ("c.event_chunks.jsonl", 0, "qna", "A", 8) in got and ("s.json", 1, "", "B", 5) in got and sum(r[0] == "transcript.txt" for r in got) == 3
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "k string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "3")], "k string, sha256 string")
    assert rows(R.compare_hashes(a, b, key="k")) == [("w", "new"), ("y", "changed"), ("z", "missing")]
    with pytest.raises(Exception, match="no converter"):
        (tmp_path / "d.docx").write_text("x")
        R.read_documents(spark, str(tmp_path / "d.docx")).collect()


def test_runs_and_broker_prices(spark, tmp_path):
    for n in ("ACME_2024-05-06_16-30", "odd"):
        (tmp_path / "runs" / n).mkdir(parents=True)
        (tmp_path / "runs" / n / "metrics.json").write_text("{}")
    assert [(r.symbol, str(r.event_time)) for r in R.discover_runs(spark, str(tmp_path / "runs")).collect()] == [("ACME", "2024-05-06 16:30:00")]
    p = tmp_path / "b.csv"
    p.write_text("Date,Last,Vol\n2024-01-02 09:30:00,2.5,3\n2024-03-10 02:30:00,1,1\n2024-11-03 01:30:00,1,1\nbad,1,1\n2024-01-02T09:30:00Z,,1\n")
    got = rows(R.read_broker_prices(spark, str(p), zone="America/New_York"))
    assert got == [("2024-01-02T14:30:00Z", "UNKNOWN", 2.5, 2.5, 2.5, 2.5, 3.0)]


def test_packets_and_label_lines(spark, tmp_path):
    text = "# Human Labeling Packet: case_x\n## Candidate 1\n- suggested_label: `neutral`\n- confidence: 0.5\n- reason: words\n```text\nsaid so\n```\n### cand_2\n> quoted\n> more\n## Other\nnothing\n"
    both = "CASE: a\nSOURCE: s1\n## cand_1\n> q\nCASE: b\n## cand_1\n"
    df = spark.createDataFrame([("p/one.md", text), ("p/two.md", both), ("p/none.md", "plain"), ("p/empty.md", " ")], "path string, text string")
    got = {(r.path, r.candidate_id): r for r in R.parse_packets(df, path="path", text="text").collect()}
    assert got["p/one.md", "Candidate_1"].evidence == "said so" and got["p/one.md", "Candidate_1"].warning == "" and got["p/one.md", "Candidate_1"].case_id == "case_x"
    assert got["p/one.md", "case_x_CAND_2"].evidence == "quoted\nmore" and "missing_suggested_label" in got["p/one.md", "case_x_CAND_2"].warning
    assert got["p/two.md", "a_CAND_1"].source_file == "s1" and got["p/two.md", "b_CAND_1"].source_file == "p/two.md" and got["p/none.md", "none_unparsed"].warning == "no_candidate_blocks_found" and len(got) == 5
    p = tmp_path / "w.jsonl"
    p.write_text('{"id": "1", "text_span": "t", "type": "neutral", "score": 0.4, "reason": "r"}\nnope\n')
    got = {r.candidate_id: r for r in R.read_weak_label_lines(spark, str(p)).collect()}
    assert (got["1"].evidence, got["1"].label, got["1"].confidence, got["1"].warning) == ("t", "neutral", "0.4", "") and got["w_row_0002"].warning.startswith("invalid_json_line_2")


def test_review_tables_and_status(spark, tmp_path):
    t = R.ReviewTables(spark, str(tmp_path / "db"))
    row = lambda *r: spark.createDataFrame(list(r), "chunk_id string, text string, batch int")
    assert t.read("chunks") is None
    t.upsert("chunks", row(("a", "x", 1), ("b", "y", 1)), "chunk_id", "batch")
    t.upsert("chunks", row(("a", "z", 2)), "chunk_id", "batch")
    assert rows(t.read("chunks").select("chunk_id", "text")) == [("a", "z"), ("b", "y")]
    t.append("history", spark.createDataFrame([(1, ["a", "b"])], "id int, labels array<string>"))
    assert rows(t.log("history")) == [(1, "a,b")]
    R.write_json_object(row(("a", "x", 1)), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text())["batch"] == 1
    with pytest.raises(ValueError):
        R.write_json_object(row(("a", "x", 1), ("b", "x", 1)), str(tmp_path / "s.json"))


def test_plugins_and_source(spark, tmp_path):
    P.CLASSIFIERS["words"] = P.lexicon_classifier(["good"], ["bad"])
    P.EMBEDDERS["length"] = lambda: lambda ts: [[float(len(t))] for t in ts]
    P.RERANKERS["same"] = lambda: lambda ps: [float(a == b) for a, b in ps]
    P.register(spark, ["words"], ["length"])
    df = spark.createDataFrame([("good day",), (" ",), (None,), ("bad bad",)], "t string")
    df.createOrReplaceTempView("plug")
    assert [r[0]["label"] for r in spark.sql("select classify_words(t) from plug").collect()] == ["POSITIVE", "NEUTRAL", "NEUTRAL", "NEGATIVE"]
    assert [r[0] for r in spark.sql("select embed_length(t) from plug").collect()] == [[8.0], [1.0], [0.0], [7.0]]
    assert df.select(P.rerank("same")("t", F.lit("bad bad"))).collect()[3][0] == 1.0
    with pytest.raises(ValueError):
        P.classify("none")
    with pytest.raises(ImportError):
        P.require("x", "no_such_module_here")
    p = tmp_path / "c.jsonl"
    p.write_text("".join(json.dumps({"conversation_id": f"c{i}", "messages": [{"role": "A", "text": f"t{i}"}, {"text": " "}]}) + "\n" for i in range(20)) + "nope\n")
    for n in (1, 7):
        assert rows(P.read_source(spark, str(p), n)) == sorted((f"c{i}", 0, "a", f"t{i}") for i in range(20))


def test_links_of_a_page(spark):
    page = '<link rel="canonical" href="/c"><a href="x.html">go <b>on</b></a><a href="mailto:a@b.c">m</a><script type="application/ld+json">{"u": ["https://j.example/1"]}</script><script>var a="https://m.example/a.mp3"</script><a href="x.html">again</a>'
    df = spark.createDataFrame([(1, "https://h.example/d/", page), (2, None, None)], "id int, base string, html string")
    got = [(r.href, r.label) for r in readers.page_links(df, page="id", html="html", base="base").orderBy("position").collect()]
    assert got == [("https://h.example/d/x.html", "go"), ("https://h.example/c", "metadata url"), ("https://j.example/1", "json-ld url"), ("https://m.example/a.mp3", "script embedded public asset url")]
