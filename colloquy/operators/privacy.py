"""Personal data in texts: cards, IBANs, e-mail addresses, postal addresses and phone numbers replaced by tags.

Candidates of all kinds overlap, and which one stands depends on those before it, so texts go
through Python in Arrow batches; whole texts are read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns by kind, in order of priority.
PATTERNS = {
    "card": r"\b(?:\d[ -]?){13,19}\d\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "email": r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "address": r"\b\d{1,5}\s+(?:[A-Za-z][A-Za-z.'-]*\s+){1,5}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way|Court|Ct)\b\.?",
    "phone": r"(?:(?<!\w)(?:\+?\d[\d(). -]{8,}\d))(?!\w)",
}
_COMPILED = [(kind, re.compile(p, re.I)) for kind, p in PATTERNS.items()]
FOUND = "array<struct<kind:string,hash:string,start:int,end:int>>"


def luhn(value: str) -> bool:
    """Luhn's check of 13 to 19 digits among other signs."""
    digits = [int(c) for c in value if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [2 * x - 9 * (x > 4) for x in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _counts(kind: str, value: str) -> bool:
    if kind == "card":
        return luhn(value)
    return kind != "phone" or 10 <= sum(c.isdigit() for c in value) <= 15


def value_hash(kind: str, value: str) -> str:
    """16 hex digits of the SHA-256 of the value in a normal form of its kind."""
    v = value.strip().lower()
    if kind in ("phone", "card"):
        v = re.sub(r"\D+", "", v)
    elif kind == "iban":
        v = re.sub(r"\s+", "", v).upper()
    elif kind == "address":
        v = re.sub(r"\s+", " ", v)
    return hashlib.sha256(v.encode()).hexdigest()[:16]


def find_personal(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what is replaced: from left to right, the kind of higher priority and the longer one first
    where several begin together; what overlaps something taken is left."""
    if not text:
        return []
    spans = [(m.start(), rank, -m.end(), kind) for rank, (kind, p) in enumerate(_COMPILED) for m in p.finditer(text) if _counts(kind, m.group())]
    out, upto = [], 0
    for start, _, end, kind in sorted(spans):
        if start >= upto:
            out.append((kind, start, -end))
            upto = -end
    return out


def redact_text(text: str | None) -> tuple[str, list[dict]]:
    parts, found, at = [], [], 0
    for kind, start, end in find_personal(text):
        parts += [text[at:start], f"[{kind.upper()}]"]
        found.append({"kind": kind, "hash": value_hash(kind, text[start:end]), "start": start, "end": end})
        at = end
    return "".join(parts) + (text or "")[at:], found


def redacted(c: Column) -> Column:
    """Struct of the text with tags and of what was found. Null is empty text; offsets are those of the text before."""

    @F.pandas_udf(f"struct<text:string,found:{FOUND}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            pairs = [redact_text(t) for t in s]
            yield pd.DataFrame({"text": [t for t, _ in pairs], "found": [f for _, f in pairs]})

    return run(c)


def redact_messages(df: DataFrame, *, messages: str, fields: list[str]) -> DataFrame:
    """Rows with an array of structs: (pos, field, kind, hash, start, end) of what the given text fields of its elements
    hold, with the path of each; other columns stay."""
    rest = [c for c in df.columns if c != messages]
    each = df.select(*rest, F.posexplode(messages).alias("pos", "m"))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"m.{f}").alias("value")) for f in fields))
    each = each.select(*rest, "pos", F.explode(cells).alias("x")).where("x.value is not null")
    each = each.select(*rest, "pos", "x.field", redacted(F.col("x.value")).alias("r"))
    path = F.concat(F.lit(f"{messages}["), F.col("pos").cast("string"), F.lit("]."), F.col("field"))
    return each.select(*rest, path.alias("path"), F.inline("r.found"))


def redaction_summary(found: DataFrame) -> DataFrame:
    """(kind, n, n_values): redactions and distinct hashes of each kind."""
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hash").alias("n_values"))
