"""Readers with declared schemas, and writers. No schema is inferred in production paths."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,text:string,message:string,content:string,timestamp:string,speaker_role:string,speaker_id:string,message_index:int>"
CONVERSATION = (
    f"conversation_id string, id string, domain string, messages array<{MESSAGE}>, transcript_segments array<{MESSAGE}>, "
    f"conversations array<struct<conversation_id:string,messages:array<{MESSAGE}>>>"
)
PRICES = "timestamp string, symbol string, open double, high double, low double, close double, volume double"
GUIDANCE_LABELS = (
    "call_id string, ticker string, company string, quarter string, event_date string, guidance_change_label string, evidence_text string, "
    "evidence_start int, evidence_end int, label_confidence string, notes string, source_type string, source_path string"
)


def _texts(c: Column) -> Column:
    """First non-empty of text, message and content."""
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(some(c["text"]), some(c["message"]), some(c["content"]))


def read_conversations(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """(conv, turn, role, text, timestamp) of conversations in JSON or JSON lines.

    Accepts one object with messages or transcript_segments, an object with a list of
    conversations, and lists of objects. Rows without text are dropped; a missing index is
    the position. A conversation without an id is named by its file and its position there.
    strict raises on malformed rows, otherwise they are dropped. Unknown suffixes raise.
    """
    if not path.rstrip("/*").endswith((".json", ".jsonl")):
        raise ValueError("conversations are read from .json or .jsonl")
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    raw = spark.read.schema(CONVERSATION).option("mode", mode).option("multiLine", path.endswith(".json")).json(path)
    raw = raw.withColumns({"_f": F.input_file_name(), "_b": F.input_file_block_start(), "_i": F.monotonically_increasing_id()})
    name, at = F.coalesce("conversation_id", "id"), ["_f", "_b", "_i"]
    flat = raw.select(name.alias("conv"), F.coalesce("messages", "transcript_segments").alias("m"), *at).where("m is not null")
    nested = raw.where("conversations is not null").select(F.explode("conversations").alias("c"), *at).select(F.col("c.conversation_id").alias("conv"), F.col("c.messages").alias("m"), *at)
    every = flat.unionByName(nested)
    # the position in the file: where the row's block of the file begins, then its order in that block
    place = F.concat_ws("_", F.regexp_extract("_f", r"([^/]+)$", 1), F.col("_b").cast("string"), F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i")).cast("string"))
    unnamed = every.where("conv is null").withColumn("conv", F.concat(F.lit("conversation_"), place))
    every = every.where("conv is not null").unionByName(unnamed)
    t = every.select("conv", F.posexplode("m").alias("pos", "x"))
    t = t.select(
        "conv", F.coalesce("x.message_index", "pos").alias("turn"), F.lower(F.coalesce("x.role", "x.speaker_role", F.lit("unknown"))).alias("role"),
        _texts(F.col("x")).alias("text"), F.col("x.timestamp").alias("timestamp"),
    )
    return t.where("text is not null")


def read_prices(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """(symbol, ts, close, ...) from CSV with a header; times in UTC, unreadable rows dropped.

    A time with an offset keeps it; one without is local to ``zone``."""
    p = spark.read.schema(PRICES).option("header", True).option("mode", "PERMISSIVE").csv(path)
    offset = F.col("timestamp").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    local = F.to_utc_timestamp(F.col("timestamp").try_cast("timestamp_ntz").cast("timestamp"), zone)
    ts = F.when(offset, F.col("timestamp").try_cast("timestamp")).otherwise(local)
    return p.select("symbol", ts.alias("ts"), "open", "high", "low", "close", "volume").where("ts is not null and close is not null and symbol is not null")


def read_guidance_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows from CSV with quoted multi-line text."""
    return spark.read.schema(GUIDANCE_LABELS).options(header=True, multiLine=True, quote='"', escape='"').csv(path)


def read_parquet_dir(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


#: Media and documents that scripts of pages name.
MEDIA = r"https?://[^\s\"'<>]+?\.(?:mp3|m4a|wav|mp4|m3u8|pdf|txt|html?)(?:\?[^\s\"'<>]*)?"


class _Page(HTMLParser):
    """Anchors with their texts, canonical and social links, and JSON-LD of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str]] = []
        self.meta: list[str] = []
        self.data: list[str] = []
        self.kind: str | None = None
        self.open: int | None = None

    def handle_starttag(self, tag, attrs):
        a = {k.lower(): v or "" for k, v in attrs}
        if tag == "a" and a.get("href"):
            self.links.append((a["href"], a.get("title") or a.get("aria-label") or ""))
            self.open = len(self.links) - 1
        elif tag == "link" and a.get("rel", "").lower() == "canonical" and a.get("href"):
            self.meta.append(a["href"])
        elif tag == "meta" and a.get("property", "").lower() in ("og:url", "twitter:url") and a.get("content"):
            self.meta.append(a["content"])
        elif tag == "script":
            self.kind = a.get("type", "")

    def handle_endtag(self, tag):
        if tag == "script":
            self.kind = None
        elif tag == "a":
            self.open = None

    def handle_data(self, data):
        if self.kind == "application/ld+json":
            self.data.append(data)
        elif self.open is not None and self.kind is None and not self.links[self.open][1]:
            self.links[self.open] = (self.links[self.open][0], " ".join(data.split()))


def _urls_of(x) -> list[str]:
    if isinstance(x, dict):
        return [u for v in x.values() for u in _urls_of(v)]
    if isinstance(x, list):
        return [u for v in x for u in _urls_of(v)]
    return re.findall(r"https?://[^\s\"'<>]+", x) if isinstance(x, str) else []


def links_of(base: str | None, page: str | None) -> list[dict]:
    """(href, label) of a page, absolute, http only, each once: anchors, metadata, JSON-LD, media in the source."""
    p = _Page()
    p.feed(page or "")
    found = [*p.links, *((u, "metadata url") for u in p.meta)]
    for raw in p.data:
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        found += [(u, "json-ld url") for u in _urls_of(value)]
    found += [(u, "script embedded public asset url") for u in re.findall(MEDIA, page or "", re.I)]
    out: dict[str, str] = {}
    for href, label in found:
        href = urljoin(base or "", href.strip())
        if href.startswith(("http://", "https://")):
            out.setdefault(href, label)
    return [{"href": h, "label": t} for h, t in out.items()]


def page_links(df: DataFrame, *, page: str, html: str, base: str | None = None) -> DataFrame:
    """(page, position, href, label) of the links of HTML pages; base: the column of the page's own URL. Arrow batches, whole pages."""

    @F.pandas_udf("array<struct<href:string,label:string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for b, h in batches:
            yield pd.Series([links_of(x, y) for x, y in zip(b, h)])

    root = F.col(base) if base else F.lit(None).cast("string")
    return df.select(page, F.posexplode(run(root, F.col(html))).alias("position", "x")).select(page, "position", "x.href", "x.label")


def page_text(c: Column) -> Column:
    """Readable text of HTML: without scripts, styles, navigation and tags; common entities decoded."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style|nav|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, partitioned where asked."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """CSV with a header; arrays joined by semicolons."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).option("header", True).csv(path)


def resume(spark: SparkSession, path: str) -> DataFrame | None:
    """The finished table at a path, or null: stages skip what is complete."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(fs_path) else None


def fiscal_periods(spark: SparkSession, anchor: str, years: int = 5) -> DataFrame:
    """YYYY_Qn of the quarters of ``years`` years up to the one of the anchor date."""
    days = F.sequence(F.add_months(F.trunc(F.lit(anchor).cast("date"), "quarter"), -12 * years), F.trunc(F.lit(anchor).cast("date"), "quarter"), F.expr("interval 3 months"))
    q = spark.range(1).select(F.explode(days).alias("q"))
    return q.select(F.concat(F.year("q").cast("string"), F.lit("_Q"), F.quarter("q").cast("string")).alias("period"))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
