"""Best representative of each duplicate group, field by field.

One aggregation: for each field the maximum of a composite (has a value, trust, time,
smallest id, value), so a group of any size is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names in dates written with words.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Rights tiers that say nothing.
NO_TIER = ["", "unknown", "n/a", "na", "none", "null"]
#: Source types from most to least trusted; others rank last.
TRUST = ["local_file", "manual", "web"]
#: Check times outside these years are placeholders.
YEARS = (1971, 2100)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _decode(c: Column) -> Column:
    """Percent-decoded text; as it is where it can't be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def canonical_resource(c: Column) -> Column:
    """One spelling for each resource.

    URLs: http equals https; a leading www., the host's letter case, a default port, a
    final slash, a fragment, utm_ parameters, parameter order and percent-encoding don't
    matter. Paths: nor do the direction and doubling of slashes, ``.`` steps and a final
    slash. Null and blank give null.
    """
    s = _trim(c)
    url = r"^(?i:(https?)):[/\\]{2}([^/?#\\]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(s, url, i)
    port = F.when(F.lower(part(1)) == "http", r":80$").otherwise(r":443$")
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), port, F.lit("")), r":$|^www\.", "")
    path = F.regexp_replace(_decode(part(3)), r"/+$", "")
    keep = F.filter(F.split(part(4), "&"), lambda x: (x != "") & ~F.lower(x).startswith("utm_"))
    query = F.array_join(F.array_sort(F.transform(keep, _decode)), "&")
    as_url = F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    p = F.regexp_replace(F.regexp_replace(s, r"^(?i:file)://", ""), r"\\", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"/{2,}", "/"), r"(?<=/)(\./)+|^(\./)+|/\.$|(?<=.)/$", "")
    p = F.regexp_replace(p, r"(?<=.)/$", "")
    return F.when(s != "", F.when(s.rlike(url), as_url).otherwise(p))


def check_time(c: Column) -> Column:
    """The UTC time (timestamp_ntz) of a check; null where it can't be read or is a placeholder.

    A time without zone is UTC, a date alone is midnight, ten digits alone are seconds
    since 1970, a fraction of a second is dropped.
    """
    s = _trim(c)
    iso = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2}):?(\d{2}):?(\d{2})(?:[.,]\d+)?)?\s*(?:([Zz])|([+-])(\d{2}):?(\d{2}))?$"
    words = r"^(\d{1,2}) ([A-Za-z]{3})[a-z]*\.?,? (\d{4})$"
    g = lambda i: F.regexp_extract(s, iso, i)
    two = lambda x: F.when(x == "", "00").otherwise(x)
    wall = F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit("T"), two(g(4)), F.lit(":"), two(g(5)), F.lit(":"), two(g(6)))
    number = F.lpad(F.array_position(F.lit(MONTHS), F.lower(F.regexp_extract(s, words, 2))).cast("string"), 2, "0")
    named = F.concat(F.regexp_extract(s, words, 3), F.lit("-"), number, F.lit("-"), F.lpad(F.regexp_extract(s, words, 1), 2, "0"), F.lit("T00:00:00"))
    is_iso, is_words, is_epoch = s.rlike(iso), s.rlike(words), s.rlike(r"^\d{10}$")
    text = F.when(is_epoch, "1970-01-01T00:00:00").when(is_iso, wall).when(is_words, named)
    off = F.when(g(9) != "", (g(9).try_cast("int") * 60 + g(10).try_cast("int")) * F.when(g(8) == "-", -60).otherwise(60)).otherwise(0)
    secs = F.when(is_epoch, s.try_cast("long")).otherwise(-off.cast("long"))
    t = text.try_cast("timestamp_ntz") + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))
    return F.when(F.year(t).between(*YEARS), t)


def iso_utc(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def known_tier(c: Column) -> Column:
    """Tier in lower case with underscores; blank, unknown and n/a give null."""
    t = F.regexp_replace(F.lower(_trim(c)), r"[\s\-_]+", "_")
    return F.when(~t.isin(NO_TIER), t)


def survivors(df: DataFrame, *, source: str, record_id: str, checked: str, tier: str, trust: str, fields: list[str]) -> DataFrame:
    """One row per source: record_id (the smallest), n_records, the tier of the latest
    readable check that has a known tier, the latest check, and of every other field the
    best value: a value before none, then the more trusted source type, then the later
    check, then the smaller record id.

    Rows whose source is null or blank are left out; a field without any value is null;
    blank strings are no values; equal rows change nothing; an empty table gives an empty
    result. Columns not named are ignored.
    """
    rank = F.lit(0)
    for i, v in enumerate(reversed(TRUST)):
        rank = F.when(F.lower(_trim(F.col(trust))) == v, i + 1).otherwise(rank)
    base = df.select(
        canonical_resource(F.col(source)).alias("_src"),
        F.col(record_id).alias("_id"),
        check_time(F.col(checked)).alias("_t"),
        known_tier(F.col(tier)).alias("_tier"),
        rank.alias("_trust"),
        *(F.col(f) for f in fields),
    ).where(F.col("_src").isNotNull() & F.col("_id").isNotNull())

    def value(f: str) -> Column:
        v = F.col(f)
        return F.when(_trim(v) != "", v) if dict(df.dtypes)[f] == "string" else v

    def best(v: Column, *order: Column) -> Column:
        return F.max(F.struct(v.isNotNull().alias("has"), *(o.alias(f"o{i}") for i, o in enumerate(order)), (-F.col("_id")).alias("id"), v.alias("v")))["v"]

    by_tier = F.when(F.col("_t").isNotNull(), F.col("_tier"))
    return base.groupBy("_src").agg(
        F.min("_id").alias(record_id),
        F.count(F.lit(1)).alias("n_records"),
        best(by_tier, F.col("_t")).alias(tier),
        iso_utc(F.max("_t")).alias(checked),
        *(best(value(f), F.col("_trust"), F.col("_t")).alias(f) for f in fields),
    ).withColumnRenamed("_src", "canonical_source")
