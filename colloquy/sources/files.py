"""Readers of label sets, packets, runs and transcripts, with declared schemas and rows of what could not be read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.operators import chunking as K

SUPERVISED = (
    "id string, text string, signal_family string, label string, source_path string, source_file string, conversation_id string, message_index int, domain string, "
    "evidence_terms array<string>, label_source string, rationale string, pii_redacted boolean, notes string"
)
#: External labels of two public sets, and the family each stands for.
PHRASEBANK = {"positive": "opportunity_commitment", "negative": "risk_friction", "neutral": "neutral"}
GOEMOTIONS = {
    "admiration": "opportunity_commitment", "approval": "opportunity_commitment", "optimism": "opportunity_commitment", "confusion": "uncertainty_hedging", "fear": "risk_friction",
    "disappointment": "risk_friction", "neutral": "neutral",
}
#: Fields by which packets and label files name the same thing, in order.
ALIASES = {
    "candidate_id": ["candidate_id", "id"], "evidence": ["evidence_span", "text", "text_span", "evidence_text", "matched_text", "segment_text"],
    "label": ["suggested_label", "predicted_label", "weak_label", "label", "type", "signal_type"], "confidence": ["suggested_confidence", "confidence", "score"],
    "reason": ["reason", "evidence_terms", "trigger_terms", "warning"], "source_file": ["source_file", "source_path", "source"], "case_id": ["case_id", "call_id", "source_case_id"],
}


def _first(fields: list[Column]) -> Column:
    return F.coalesce(*(F.nullif(T.strip(c.cast("string")), F.lit("")) for c in fields))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, line) of text files, blank lines left out. A file is one row when it is read, as its
    line numbers need all that comes before."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("i", "line"))
    return lines.where(T.strip(F.col("line")) != "").select("file", (F.col("i") + 1).alias("line_no"), "line")


def read_jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """Objects of JSON lines by a schema. strict raises on the first line that is none, else such lines are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_jsonl_with_errors(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(fields..., file, line_no) of readable objects, and (file, line_no, error, line_hash) of all other lines."""
    t = numbered_lines(spark, path).withColumn("v", F.try_parse_json("line"))
    ok = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    good = t.where(ok).select(F.from_json("line", schema).alias("x"), "file", "line_no").select("x.*", "file", "line_no")
    error = F.when(F.col("v").isNull(), "invalid_json").otherwise("non_object")
    bad = t.where(~ok).select("file", "line_no", error.alias("error"), F.concat(F.lit("sha256:"), F.sha2("line", 256)).alias("line_hash"))
    return good, bad


def read_supervised(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples with defaults for what is missing; an empty text or unknown label raises."""
    t = read_jsonl(spark, path, SUPERVISED).withColumns({"file": F.input_file_name()})
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    label, text = _first([F.col("signal_family"), F.col("label")]), T.strip(F.coalesce("text", F.lit("")))
    ok = (text != "") & F.coalesce(label.isin(L.FAMILIES), F.lit(False))
    some = lambda *cs: _first([*(F.col(c) if isinstance(c, str) else c for c in cs)])
    return t.select(
        F.coalesce(_first([F.col("id")]), F.concat_ws(":", name, F.sha2(text, 256))).alias("id"), F.when(ok, text).otherwise(F.raise_error(F.concat(F.lit("invalid labelled example in "), name))).alias("text"), label.alias("signal_family"),
        some("source_path", name).alias("source_path"), some("source_file", "source_path", name).alias("source_file"), some("conversation_id", "source_path", name).alias("conversation_id"), F.coalesce("message_index", F.lit(0)).alias("message_index"),
        some("domain", F.lit("unknown")).alias("domain"), F.coalesce("evidence_terms", F.array().cast("array<string>")).alias("evidence_terms"), some("label_source", F.lit("unknown")).alias("label_source"), F.coalesce("rationale", F.lit("")).alias("rationale"),
        F.coalesce("pii_redacted", F.lit(False)).alias("pii_redacted"), F.coalesce("notes", F.lit("")).alias("notes"),
    )


def read_labelled_csv(spark: SparkSession, path: str, *, text: str = "text", label: str = "label", families: dict[str, str] | None = None) -> DataFrame:
    """(text, external_label, source_path[, mapped_signal_label]) of a CSV with the given columns; rows without either are
    dropped, a missing column raises. families maps external labels, others are unmapped."""
    t = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    lacking = [c for c in (text, label) if c not in t.columns]
    if lacking:
        raise ValueError(f"columns missing in {path}: {lacking}")
    rows = t.select(T.strip(F.col(text)).alias("text"), T.strip(F.col(label)).alias("external_label"), F.input_file_name().alias("source_path")).where("text <> '' and external_label <> ''")
    if families is None:
        return rows
    known = F.create_map(*(F.lit(x) for kv in families.items() for x in kv))
    rows = rows.withColumn("external_label", F.lower("external_label"))
    return rows.withColumn("mapped_signal_label", F.coalesce(F.try_element_at(known, F.col("external_label")), F.lit("unmapped")))


def normalized_records(df: DataFrame, *, source: str) -> tuple[DataFrame, DataFrame]:
    """Records of a connector that have a text, an audio or a video, and the others with the reason they are rejected."""
    need = [c for c in ("text", "audio_path", "video_path") if c in df.columns]
    has = reduce(lambda a, b: a | b, (F.coalesce(T.strip(F.col(c).cast("string")) != "", F.lit(False)) for c in need)) if need else F.lit(False)
    t = df.withColumn("source", F.lit(source))
    return t.where(has), t.where(~has).withColumn("reason", F.lit("no_text_audio_or_video"))


def ingest(connectors: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(records of all connectors, one row of counts for each connector); fields that a connector lacks are null."""
    parts = {name: normalized_records(df, source=name) for name, df in connectors.items()}
    good = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (g for g, _ in parts.values()))
    tag = lambda df, ok: df.select("source", F.lit(ok).alias("ok"))
    every = reduce(DataFrame.unionByName, (tag(x, i == 0) for p in parts.values() for i, x in enumerate(p)))
    n = every.groupBy("source").agg(F.count_if("ok").alias("loaded"), F.count_if(~F.col("ok")).alias("rejected"))
    names = good.sparkSession.createDataFrame([(k,) for k in connectors], "source string")
    return good, names.join(n, "source", "left").fillna(0, ["loaded", "rejected"])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def compare_hashes(before: DataFrame, after: DataFrame, *, key: str) -> DataFrame:
    """(key, problem): missing, changed or new files between two tables of (key, sha256)."""
    j = before.select(key, F.col("sha256").alias("a")).join(after.select(key, F.col("sha256").alias("b")), key, "full_outer")
    what = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed")
    return j.select(key, what.alias("problem")).where("problem is not null")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .txt, .md, .csv and .json files; others raise, as they need a converter."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    known = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin("txt", "md", "csv", "json")
    return files.select("path", F.when(known, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no converter for "), F.col("path")))).alias("text"))


def read_transcript_chunks(spark: SparkSession, path: str, *, size: int = 1800, overlap: int = 200, least: int = 200) -> DataFrame:
    """(file, chunk_index, section, speaker, text) of transcripts: .event_chunks.jsonl as they are, .txt packed by sentences,
    .json entry by entry; other files give nothing."""
    events = "section string, speaker string, text string"
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), "value")
    ready = lines.where(F.col("file").endswith(".event_chunks.jsonl")).select("file", F.posexplode(F.split("value", "\n")).alias("chunk_index", "line"))
    ready = ready.select("file", "chunk_index", F.from_json("line", events).alias("x")).select("file", "chunk_index", "x.section", "x.speaker", T.normalize_lines(F.col("x.text")).alias("text")).where("text <> ''")
    blank = F.lit("").alias("section"), F.lit("").alias("speaker")
    plain = lines.where(F.col("file").endswith(".txt")).select("file", F.lit(0).alias("entry"), *blank, T.normalize_lines(F.col("value")).alias("body"))
    entries = lines.where(F.col("file").endswith(".json")).select("file", F.posexplode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':') for c in events.split(', '))}>>")).alias("entry", "x"))
    entries = entries.select("file", "entry", F.coalesce("x.section", F.lit("")).alias("section"), F.coalesce("x.speaker", F.lit("")).alias("speaker"), T.normalize_lines(F.col("x.text")).alias("body"))
    cut = plain.unionByName(entries).where("body <> ''").select("file", "entry", "section", "speaker", "body", F.posexplode(K.packed(F.col("body"), size, overlap, least)).alias("k", "s"))
    cut = cut.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("entry", "k")) - 1).alias("chunk_index"), "section", "speaker", T.strip(F.expr("substring(body, s.start + 1, s.end - s.start)")).alias("text"))
    return ready.unionByName(cut)


def discover_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, symbol, event_time, files) of the folders below a path, by their names: symbol_date[_time]. Folders
    whose name says neither are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    t = files.select(F.regexp_extract("path", rf"/{root}/([^/]+)/", 1).alias("run_id")).where("run_id <> ''").groupBy("run_id").agg(F.count(F.lit(1)).alias("files"))
    p = r"^([A-Za-z.]{1,6})[_-](\d{4}-\d{2}-\d{2})(?:[_T](\d{2})[-:](\d{2}))?"
    day, h, m = (F.regexp_extract("run_id", p, i) for i in (2, 3, 4))
    when = F.concat(day, F.when(h != "", F.concat(F.lit("T"), h, F.lit(":"), m, F.lit(":00"))).otherwise("T00:00:00"))
    return t.where(F.col("run_id").rlike(p)).select("run_id", F.upper(F.regexp_extract("run_id", p, 1)).alias("symbol"), when.try_cast("timestamp_ntz").alias("event_time"), "files")


def read_broker_prices(spark: SparkSession, path: str, *, symbol: str | None = None, zone: str = "UTC") -> DataFrame:
    """(timestamp text in UTC, symbol, open, high, low, close, volume) of a broker's CSV: columns by their aliases, times without an
    offset local to ``zone``, missing prices from close, volume 0, rows without a time or close dropped.

    A local time that the change of clocks skips or repeats is dropped."""
    t = spark.read.option("header", True).csv(path)
    named = {c.strip().lower(): c for c in t.columns}
    get = lambda *names: _first([F.col(f"`{named[n]}`") for n in names if n in named]) if any(n in named for n in names) else F.lit(None).cast("string")
    raw = get("timestamp", "datetime", "date", "time")
    offset = raw.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    wall = raw.try_cast("timestamp_ntz")
    utc = F.to_utc_timestamp(wall.cast("timestamp"), zone)
    back = F.from_utc_timestamp(utc, zone)
    twice = F.from_utc_timestamp(utc + F.expr("interval 1 hour"), zone).eqNullSafe(back) | F.from_utc_timestamp(utc - F.expr("interval 1 hour"), zone).eqNullSafe(back)
    local = F.when(back.eqNullSafe(wall.cast("timestamp")) & ~twice, utc)
    ts = F.when(offset, raw.try_cast("timestamp")).otherwise(local)
    num = lambda *names: get(*names).try_cast("double")
    close = num("close", "last", "price")
    who = F.lit(symbol) if symbol else F.coalesce(get("symbol", "ticker"), F.lit("UNKNOWN"))
    out = t.select(ts.alias("ts"), F.upper(who).alias("symbol"), *(F.coalesce(num(c), close).alias(c) for c in ("open", "high", "low")), close.alias("close"), F.coalesce(num("volume", "vol"), F.lit(0.0)).alias("volume"))
    return out.where("ts is not null and close is not null").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume")


def split_packets(df: DataFrame, *, path: str, text: str) -> DataFrame:
    """(path, section_no, case_id, source, body): a packet cut at its CASE: lines, each with its SOURCE: or the path; one
    section without a case where there is no such line."""
    named = lambda c, k: T.strip(F.regexp_extract(c, rf"(?im)^{k}:\s*(\S[^\r\n]*)$", 1))
    parts = df.select(F.col(path).alias("path"), F.split(text, r"(?im)(?=^CASE:\s*\S)").alias("p"))
    body = F.col("body")
    cases = F.filter("p", lambda x: x.rlike(r"(?i)\ACASE:\s*\S"))
    t = parts.select("path", F.posexplode(F.when(F.size(cases) > 0, cases).otherwise(F.array(F.array_join("p", "")))).alias("section_no", "body"))
    return t.select("path", "section_no", F.when(body.rlike(r"(?i)\ACASE:"), named(body, "CASE")).otherwise("").alias("case_id"), F.coalesce(F.nullif(named(body, "SOURCE"), F.lit("")), F.col("path")).alias("source"), "body")


def parse_packets(df: DataFrame, *, path: str, text: str) -> DataFrame:
    """Candidate rows of labelling packets in Markdown: one for each candidate heading, with its bullets by their aliases, its
    fenced or quoted evidence and warnings of what is missing; a packet without any gives one unparsed row."""
    header = T.strip(F.regexp_extract("body", r"(?im)^#\s*Human Labeling Packet:\s*([^\r\n]+)$", 1))
    s = split_packets(df, path=path, text=text).withColumn("case", F.coalesce(F.nullif("case_id", F.lit("")), F.nullif(header, F.lit("")), F.lit("")))
    blocks = s.select("path", "section_no", "case", "source", F.posexplode(F.split("body", r"(?m)(?=^#{2,4}\s+\S)")).alias("k", "b"))
    title = T.strip(F.regexp_extract("b", r"\A#{2,4}\s+([^\r\n]+)", 1))
    low = F.lower(title)
    c = blocks.withColumn("title", title).where(low.rlike(r"\bcand(?:idate)?[-_ ]?\d+\b") | low.contains("_weak_") | low.startswith("priority_review_"))
    field = lambda names: F.coalesce(*(F.nullif(T.strip(F.regexp_replace(F.regexp_extract("b", rf"(?im)^\s*[-*]\s*\**{n.replace('_', '[_ ]')}\**\s*:\**\s*([^\r\n]+)$", 1), r"^`|`$", "")), F.lit("")) for n in names), F.lit(""))
    fenced = T.strip(F.regexp_extract("b", r"(?s)```[a-z]*\s*\n(.*?)```", 1))
    quoted = T.strip(F.array_join(F.regexp_extract_all("b", F.lit(r"(?m)^>\s?(.*)$"), 1), "\n"))
    short = low.rlike(r"\Acand[_ -]?\d+\z") & (F.col("case") != "")
    made = F.regexp_replace("title", "[- ]", "_")
    c = c.select(
        "path", "section_no", "k", "case", F.coalesce(F.nullif(field(ALIASES["candidate_id"]), F.lit("")), F.when(short, F.concat_ws("_", "case", F.upper(made))).otherwise(made)).alias("candidate_id"),
        F.coalesce(F.nullif(fenced, F.lit("")), quoted).alias("evidence"), field(["suggested_label", "predicted_label", "weak_label", "label"]).alias("label"), field(["suggested_confidence", "confidence", "deterministic_confidence"]).alias("confidence"),
        field(ALIASES["reason"]).alias("reason"), F.coalesce(F.nullif(field(["source_file", "source_path"]), F.lit("")), "source").alias("source_file"),
    )
    lacks = lambda name, code: F.when(F.col(name) == "", code)
    warn = F.array_join(F.array_compact(F.array(lacks("case", "missing_case_id"), lacks("evidence", "missing_evidence_span"), lacks("label", "missing_suggested_label"), lacks("confidence", "missing_suggested_confidence"), lacks("reason", "missing_reason"))), ";")
    c = c.withColumn("warning", warn).withColumnRenamed("case", "case_id").drop("section_no", "k")
    rest = df.where(T.strip(F.col(text)) != "").select(F.col(path).alias("path")).join(c.select("path").distinct(), "path", "left_anti")
    none = F.lit("")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rest = rest.select("path", none.alias("case_id"), F.concat(stem, F.lit("_unparsed")).alias("candidate_id"), *(none.alias(f) for f in ("evidence", "label", "confidence", "reason")), F.col("path").alias("source_file"), F.lit("no_candidate_blocks_found").alias("warning"))
    return c.unionByName(rest)


def read_weak_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Queue rows of weak labels in JSON lines: fields by their aliases, an id by file and line where there is none, warnings
    of what is missing or unreadable."""
    t = numbered_lines(spark, path).withColumn("v", F.try_parse_json("line"))
    obj = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    get = lambda names: F.coalesce(_first([F.when(obj, F.try_variant_get("v", f"$.{n}", "string")) for n in names]), F.lit(""))
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    out = {k: get(v) for k, v in ALIASES.items()}
    made = F.concat(stem, F.lit("_row_"), F.lpad(F.col("line_no").cast("string"), 4, "0"))
    bad = F.when(F.col("v").isNull(), F.concat(F.lit("invalid_json_line_"), F.col("line_no"))).when(~obj, F.concat(F.lit("non_object_json_line_"), F.col("line_no")))
    c = t.select("file", "line_no", bad.alias("bad"), *(x.alias(k) for k, x in out.items()))
    c = c.withColumns({"candidate_id": F.coalesce(F.nullif("candidate_id", F.lit("")), made), "source_file": F.coalesce(F.nullif("source_file", F.lit("")), "file")})
    lacks = lambda name, code: F.when(F.col(name) == "", code)
    warn = F.array_join(F.array_compact(F.array(F.col("bad"), lacks("evidence", "missing_evidence_span"), lacks("label", "missing_suggested_label"), lacks("confidence", "missing_suggested_confidence"), lacks("reason", "missing_reason"))), ";")
    return c.withColumn("warning", warn).drop("bad")


def write_json_object(df: DataFrame, path: str) -> None:
    """A status of one row as one indented JSON file; more rows are an error. Only this row goes through the driver."""
    import json

    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a status has one row")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(rows[0]), f, indent=2, ensure_ascii=False)


class ReviewTables:
    """Review tables below a folder: chunks by key, labels and history that grow. Parquet; a new version of a keyed table
    is written beside the old one and named in its place when complete."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[str]:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(f"{self.folder}/{name}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [str(s.getPath()) for s in fs.listStatus(root) if fs.exists(jvm.Path(s.getPath(), "_SUCCESS"))]
        return sorted(done)

    def read(self, name: str) -> DataFrame | None:
        """The newest complete version of a table; null where there is none."""
        v = self._versions(name)
        return self.spark.read.parquet(v[-1]) if v else None

    def _write(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.folder}/{name}/v{len(self._versions(name)):06d}")

    def upsert(self, name: str, rows: DataFrame, key: str, order: str) -> None:
        """Rows replace those of their key; of several new rows of a key the last by ``order``."""
        from colloquy.operators.labels import upsert

        old = self.read(name)
        self._write(name, upsert(old if old is not None else rows.limit(0), rows, key, order).drop("origin"))

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows are added; arrays are joined by commas."""
        flat = [F.array_join(c, ",").alias(c) if t == "array<string>" else F.col(c) for c, t in rows.dtypes]
        rows.select(*flat).write.mode("append").parquet(f"{self.folder}/{name}_log")

    def log(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}_log")
