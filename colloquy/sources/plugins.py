"""Plug-ins: classifiers, embedders and re-rankers by name, as Arrow functions over batches, in SQL too; and a data source.

A plug-in is built once in each Python worker from its factory and sees whole batches of texts."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CLASSIFIERS: dict[str, Callable[[], Callable[[list[str]], list[tuple[str, float]]]]] = {}
EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], list[list[float]]]]] = {}
RERANKERS: dict[str, Callable[[], Callable[[list[tuple[str, str]]], list[float]]]] = {}


def require(purpose: str, *modules: str) -> None:
    """Raises with all that is lacking of what a plug-in needs."""
    lacking = [m for m in modules if importlib.util.find_spec(m) is None]
    if lacking:
        raise ImportError(f"{purpose} needs {', '.join(lacking)}")


def _known(kind: dict, name: str):
    if name not in kind:
        raise ValueError(f"unknown plug-in {name}; known are {', '.join(sorted(kind))}")
    return kind[name]


def classify(name: str) -> Callable[[Column], Column]:
    """A function of a text column: struct (label, score) of the named classifier. A blank text is NEUTRAL with 0."""
    factory = _known(CLASSIFIERS, name)

    @F.pandas_udf("struct<label:string,score:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for s in batches:
            said = [isinstance(t, str) and bool(t.strip()) for t in s]
            out = iter(model([t for t, ok in zip(s, said) if ok]))
            yield pd.DataFrame([next(out) if ok else ("NEUTRAL", 0.0) for ok in said], columns=["label", "score"])

    return run


def embed(name: str) -> Callable[[Column], Column]:
    """A function of a text column: the vector of the named embedder; null counts as empty."""
    factory = _known(EMBEDDERS, name)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            yield pd.Series([np.asarray(v, np.float32) for v in model([t if isinstance(t, str) else "" for t in s])])

    return run


def rerank(name: str) -> Callable[[Column, Column], Column]:
    """A function of query and text: the score of the named re-ranker."""
    factory = _known(RERANKERS, name)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, t in batches:
            yield pd.Series(model(list(zip(q.fillna(""), t.fillna("")))), dtype="float64")

    return run


def register(spark: SparkSession, classifiers: list[str] = (), embedders: list[str] = ()) -> None:
    """Plug-ins as SQL functions classify_<name> and embed_<name>."""
    for n in classifiers:
        spark.udf.register(f"classify_{n}", classify(n))
    for n in embedders:
        spark.udf.register(f"embed_{n}", embed(n))


def lexicon_classifier(up: list[str], down: list[str]) -> Callable:
    """The factory of a classifier by two word lists, which stands in for a model."""

    def build():
        good, bad = set(up), set(down)

        def model(texts: list[str]) -> list[tuple[str, float]]:
            out = []
            for t in texts:
                ws = t.lower().split()
                p, n = sum(w.strip(".,;:!?") in good for w in ws), sum(w.strip(".,;:!?") in bad for w in ws)
                out.append(("POSITIVE" if p > n else "NEGATIVE" if n > p else "NEUTRAL", round(0.5 + 0.5 * abs(p - n) / (p + n + 1), 4)))
            return out

        return model

    return build


class _Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ConversationSource(DataSource):
    """``spark.read.format("conversations").load(path)``: the turns of conversations in a JSON-lines file, read in slices of
    bytes. Options: ``slices``. Lines that are no objects are left out."""

    @classmethod
    def name(cls) -> str:
        return "conversations"

    def schema(self) -> str:
        return "conv string, turn int, role string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Conversations(self.options["path"], int(self.options.get("slices", 4)))


class _Conversations(DataSourceReader):
    def __init__(self, path: str, slices: int):
        self.path, self.slices = path, slices

    def partitions(self) -> list[InputPartition]:
        import os

        size = os.path.getsize(self.path)
        step = max(1, -(-size // self.slices))
        return [_Slice(self.path, a, min(size, a + step)) for a in range(0, size, step)]

    def read(self, partition: _Slice):
        with open(partition.path, "rb") as f:
            f.seek(max(partition.start - 1, 0))
            if partition.start:
                f.readline()  # the line that began before belongs to the slice before
            while f.tell() < partition.end:
                line = f.readline()
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if isinstance(row, dict):
                    for i, m in enumerate(row.get("messages") or []):
                        text = (m.get("text") or m.get("message") or m.get("content") or "").strip()
                        if text:
                            yield str(row.get("conversation_id") or row.get("id") or ""), i, str(m.get("role") or "unknown").lower(), text


def read_source(spark: SparkSession, path: str, slices: int = 4) -> DataFrame:
    spark.dataSource.register(ConversationSource)
    return spark.read.format("conversations").option("slices", slices).load(path)
