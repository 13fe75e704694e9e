"""Column functions on text: tokenisers, term matching, numbers, hashes. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lits(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


WHITE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.trim(c, F.lit(WHITE))


def compact(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.regexp_replace(strip(F.lower(c)), r"[ \t\n\x0B\f\r]+", " ")


def any_pattern(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def any_phrase(c: Column, phrases: list[str]) -> Column:
    """Whether any phrase is in a text, also as part of a word."""
    return reduce(lambda a, b: a | b, (c.contains(p) for p in phrases))


def normalize_space(c: Column) -> Column:
    """Null becomes empty; runs of white space become one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalize_lines(c: Column) -> Column:
    """Line ends as \\n, blanks and tabs as one space, at most one empty line, trimmed."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def tokens(c: Column, pattern: str = r"[a-zA-Z']+") -> Column:
    """Lower-case matches of a pattern: letters, letters and digits, or as given."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({pattern})"), 1)


def words(c: Column) -> Column:
    return tokens(c, r"[a-zA-Z0-9']+")


def without(ts: Column, stop: list[str]) -> Column:
    """Tokens that are no stop words, repeats kept."""
    return F.filter(ts, lambda t: ~t.isin(stop))


def plain(c: Column) -> Column:
    """What terms are looked for in: lower case, white space normalised, null as empty."""
    return F.lower(normalize_space(c))


def term_in(t: Column, term: str) -> Column:
    """A phrase as a substring of a plain text, a single word between word boundaries."""
    return t.contains(term) if " " in term else t.rlike(rf"\b\Q{term}\E\b")


def terms_in(t: Column, terms: list[str], limit: int = 8) -> Column:
    """Terms found in a plain text, in the order of the list, the first ``limit`` only."""
    return F.slice(F.array_compact(F.array(*(F.when(term_in(t, w), F.lit(w)) for w in terms))), 1, limit)


def term_found(c: Column, term: str) -> Column:
    return term_in(plain(c), term)


def matched_terms(c: Column, terms: list[str], limit: int = 8) -> Column:
    return terms_in(plain(c), terms, limit)


def phrase_count(c: Column, phrases: list[str]) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    return sum((t.contains(p).cast("int") for p in phrases[1:]), t.contains(phrases[0]).cast("int"))


def overlap(left: Column, right: Column) -> Column:
    """Share of the distinct left tokens that the right has; 0 without left tokens."""
    a = F.array_distinct(left)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, right)) / F.size(a)).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    u = F.size(F.array_union(left, right))
    return F.when(u > 0, F.size(F.array_intersect(left, right)) / u).otherwise(F.lit(0.0))


def share(hits: Column, total: Column) -> Column:
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


def length_bucket(c: Column) -> Column:
    n = F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^ \t\n\r\f]+"))
    return F.when(n < 12, "short").when(n < 25, "medium").otherwise("long")


def confidence_bucket(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "unknown").when(c < 0.4, "low").when(c < 0.6, "medium").otherwise("high")


NUMBER = r"-?\d[\d,]*(?:\.\d+)?"


def numbers(c: Column) -> Column:
    """Signed numbers of a text, thousands commas dropped."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def number_range(c: Column) -> Column:
    """(low, high) of "between a and b", else of "a to b"; null without."""
    t = F.lower(c)
    n = r"(-?\d+(?:\.\d+)?)"
    pair = lambda p: F.array(*(F.regexp_extract(t, p, i).try_cast("double") for i in (1, 2)))
    a, b = pair(rf"between\s+{n}\s+and\s+{n}"), pair(rf"{n}\s*(?:to|–|-)\s*{n}")
    r = F.when(F.get(a, 0).isNotNull(), a).when(F.get(b, 0).isNotNull(), b)
    return F.sort_array(r)


def midpoint(c: Column) -> Column:
    """Middle of the range, else the first number, to six places."""
    r = number_range(c)
    return F.round(F.coalesce((F.get(r, 0) + F.get(r, 1)) / 2, F.get(numbers(c), 0)), 6)


def round_significant(c: Column, digits: int = 3) -> Column:
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - (digits - 1))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c / scale) * scale)


def argmax_topic(c: Column, topics: dict[str, list[str]], default: str) -> Column:
    """The topic with most phrases found; the first of equal ones; ``default`` without any."""
    cells = [F.struct(phrase_count(c, p).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, p) in enumerate(topics.items())]
    best = F.array_max(F.array(*cells))
    return F.when(best["n"] > 0, best["t"]).otherwise(default)


def period_tag(c: Column) -> Column:
    t = F.lower(c)
    q = F.regexp_extract(t, r"\bq([1-4])\b", 1)
    return (
        F.when(q != "", F.concat(F.lit("Q"), q)).when(t.rlike(r"\bfy\b|fiscal year|full year"), "FY")
        .when(t.contains("year"), "Year").when(t.contains("quarter"), "Quarter").otherwise("Unknown")
    )


def first_direction(c: Column, directions: dict[str, list[str]], default: str) -> Column:
    out = F.lit(default)
    for name, phrases in reversed(directions.items()):
        out = F.when(phrase_count(c, phrases) > 0, name).otherwise(out)
    return out


def stable_hash(*parts: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts, each followed by the unit separator."""
    return F.substring(F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\x1f")))), 256), 1, length)


def slug(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(t == "", "unknown").otherwise(t)


def excerpt(c: Column, term: str, width: int = 160) -> Column:
    """Text around the first hit (30 before, 90 after), or the first ``width`` characters."""
    t = normalize_space(c)
    at = F.locate(term, F.lower(t))
    start = F.greatest(at - 30, F.lit(1))
    cut = F.concat(
        F.when(start > 1, "...").otherwise(""), F.substring(t, start, at - start + 90), F.when(F.length(t) > at + 89, "...").otherwise("")
    )
    return F.when(at > 0, cut).otherwise(F.substring(t, 1, width))


def preview(c: Column, width: int = 96) -> Column:
    """The first ``width`` characters of a text with white space normalised, with dots where there are more."""
    t = normalize_space(c)
    return F.concat(F.substring(t, 1, width), F.when(F.length(t) > width, "...").otherwise(""))


def gated_preview(c: Column, allowed: Column, width: int = 160) -> Column:
    """The first characters of a text where that is allowed, else a note."""
    return F.when(F.coalesce(allowed, F.lit(False)), F.substring(F.coalesce(c, F.lit("")), 1, width)).otherwise("[redacted: raw text commit not allowed]")


def row_hash(*columns: str) -> Column:
    """sha256: and the digest of the columns as compact JSON, keys in order, nulls kept."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def hash_bucket(token: Column, dimensions: int) -> Column:
    """Feature-hashing bucket of a token: first four bytes of its SHA-256, big-endian."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dimensions


def hash_sign(token: Column) -> Column:
    """+1 or -1 by the parity of the fifth byte."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def normalize_role(c: Column, roles: dict[str, str]) -> Column:
    """A role by its canonical name; others stand for themselves in lower case with underscores, an empty one for unknown."""
    r = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s-]+", "_")
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in roles.items() for x in kv)), r)
    return F.coalesce(known, F.nullif(r, F.lit("")), F.lit("unknown"))


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
