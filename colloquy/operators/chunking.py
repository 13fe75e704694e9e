"""Text and time chunks that need a sequential pass within one row or one conversation."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators.series import ordered_scan

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def sentence_ends(text: str) -> list[int]:
    """Ends of sentences with the white space after them; the last is the end of the text."""
    ends = [m.end() for m in re.finditer(r"(?<=[.!?])\s+", text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def pack_sentences(text: str | None, size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Spans of whole sentences that end within ``size`` characters of their start, each beginning ``overlap`` characters
    before the end of the one before; a longer sentence stays whole. A piece under ``least`` characters is
    joined to the one before it. A text without sentences has none."""
    spans: list[tuple[int, int]] = []
    start, end, first = 0, 0, True
    for cut in sentence_ends(text) if text else []:
        if not first and cut - start > size:
            spans.append((start, end))
            start = max(start, end - overlap)
        first, end = False, cut
    if text:
        spans.append((start, end))
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and len(text[s:e].strip()) < least:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def packed(c: Column, size: int = 1800, overlap: int = 200, least: int = 200) -> Column:
    """Array of (start, end) of packed sentences. Arrow batches; whole texts."""

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"start": a, "end": b} for a, b in pack_sentences(t, size, overlap, least)])

    return run(c)


def review_pieces(text: str | None, size: int = 900) -> list[str]:
    """Paragraphs; one of more than ``size`` characters as runs of sentences that fit, and a sentence that doesn't in cuts of ``size``."""
    out: list[str] = []
    for paragraph in re.split(r"\n\s*\n", re.sub(r"\r\n?", "\n", text or "")):
        paragraph = paragraph.strip()
        if len(paragraph) <= size:
            out.append(paragraph)
            continue
        run = ""
        for sentence in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", paragraph))):
            if run and len(run) + 1 + len(sentence) > size:
                out.append(run)
                run = ""
            if len(sentence) > size:
                out += [sentence[i : i + size].strip() for i in range(0, len(sentence), size)]
            else:
                run = f"{run} {sentence}" if run else sentence
        out.append(run)
    return [x for x in out if x]


def review_chunks(c: Column, size: int = 900) -> Column:
    """Array of the pieces of review_pieces(). Arrow batches; whole texts."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: review_pieces(t, size))

    return run(c)


def timeline(pieces: Column, words_per_second: float = 2.5) -> Column:
    """Array of (start, end, text): pieces on a made-up timeline, each as long as its words take, 5 to 90 seconds."""
    seconds = lambda x: F.greatest(F.lit(5.0), F.least(F.lit(90.0), F.greatest(F.lit(1), F.regexp_count(x, F.lit(r"(?U)\b\w+\b"))) / max(words_per_second, 0.5)))
    step = lambda s, x: F.struct(F.round(s["t"] + seconds(x), 3).alias("t"), F.concat(s["out"], F.array(F.struct(s["t"].alias("start"), F.round(s["t"] + seconds(x), 3).alias("end"), x.alias("text")))).alias("out"))
    zero = F.struct(F.lit(0.0).alias("t"), F.array().cast("array<struct<start:double,end:double,text:string>>").alias("out"))
    return F.aggregate(pieces, zero, step)["out"]


def pack_time(segments: DataFrame, *, key: str, seconds: float = 30.0) -> DataFrame:
    """(key, chunk_no, start, end, n): greedy chunks of consecutive segments while they end within ``seconds``
    of the chunk's start.

    segments: (key, ord, start, end). Rows without a time are left out."""
    types = dict(segments.dtypes)

    def step(state, row):
        k, no, first, last, n = state or (None, 0, None, 0.0, 0)
        done = [(k, no, first, last, n)]
        if row is None:
            return None, done if n else []
        _, _, s, e = row
        if n and e - first > seconds:
            return (row[0], no + 1, s, e, 1), done
        return (row[0], no, s if first is None else first, e, n + 1), []

    rows = segments.select(key, "ord", "start", "end").where(f"`{key}` is not null and start is not null and `end` is not null")
    return ordered_scan(rows, [key], ["ord"], step, f"`{key}` {types[key]}, chunk_no int, start double, end double, n int")


def similarity(a: Column, b: Column) -> Column:
    """Sequence-matcher ratio of two texts (levenshtein differs); null counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([SequenceMatcher(None, p or "", q or "", autojunk=False).ratio() for p, q in zip(x, y)])

    return run(a, b)


def marker_spans(c: Column, markers: dict[str, str]) -> Column:
    """Sections from the first hit of each marker to the next one, and what comes before.

    Array of (section, start, end), 0-based; without any marker one unknown section."""
    text = F.lower(c)
    hits = F.filter(F.array(*(F.struct((F.locate(m, text) - 1).alias("start"), F.lit(name).alias("section")) for name, m in markers.items())), lambda h: h["start"] >= 0)
    hits = F.array_sort(hits)
    first = F.coalesce(F.get(hits, 0)["start"], F.length(c))
    hits = F.when(first > 0, F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit("unknown").alias("section"))), hits)).otherwise(hits)
    return F.transform(hits, lambda h, i: F.struct(h["section"].alias("section"), h["start"].alias("start"), F.coalesce(F.get(hits, i + 1)["start"], F.length(c)).alias("end")))
