"""Queries on event series, timed segments and audio intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.operators import series as S
from colloquy.plans import sqltext as X
from colloquy.plans.common import SCORED, TURNS, scored, turns
from colloquy.plans.registry import Registry
from colloquy.runtime import norm_key, read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def events(spark, d):
    return read_table(spark, d, "events")


@query("""with t as (select event_id, user_id, value, avg(value) over w m, stddev_pop(value) over w s from events window w as (partition by user_id order by ts, event_id rows 4 preceding))
select event_id, round(m, 4) mean, round(s, 4) std, round(case when s > 1e-9 then (value - m) / s else 0 end, 4) z, abs(round(case when s > 1e-9 then (value - m) / s else 0 end, 4)) >= 1.5 is_change from t""")
def tone_change(spark, d):
    t = S.tone_changes(events(spark, d), key="user_id", order=["ts", "event_id"], value="value", threshold=1.5)
    return t.select("event_id", "mean", "std", "z", "is_change")


@query("""with t as (select *, case when (value < 30) is not distinct from lag(value < 30) over w then 0 else 1 end nw from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(nw) over (partition by user_id order by ts, event_id) run from t)
select user_id, cast(run as bigint) run, count(*) n_events, min(event_id) first_event from r where value < 30 group by user_id, run""")
def event_runs(spark, d):
    r = S.runs(events(spark, d), key="user_id", order=["ts", "event_id"], state=F.col("value") < 30)
    return r.where("_state").groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


_P = "p as (select user_id, ts, max(value) v from events where event_type = (select min(event_type) from events) group by all), q as (select event_id, user_id, ts from events where event_type = (select max(event_type) from events))"


def _DAY():
    return F.date_trunc("day", F.col("ts"))


def _prices(spark, d):
    e = events(spark, d)
    kinds = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.join(F.broadcast(kinds))
    p = e.where("event_type = lo").groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    return p, e.where("event_type = hi").select("event_id", "user_id", "ts")


@query(f"with {_P} select q.event_id, p.v as_of from q asof left join p on q.user_id = p.user_id and q.ts >= p.ts")
def event_asof_before(spark, d):
    p, q = _prices(spark, d)
    return S.as_of(q, p, key="user_id", time="ts", value="v", block=_DAY()).select("event_id", "as_of")


@query(f"with {_P} select q.event_id, p.v as_of from q asof left join p on q.user_id = p.user_id and q.ts <= p.ts")
def event_asof_after(spark, d):
    p, q = _prices(spark, d)
    return S.as_of(q, p, key="user_id", time="ts", value="v", forward=True, block=_DAY()).select("event_id", "as_of")


_RET = """, a as (select q.event_id, q.user_id, q.ts, p.v v0 from q asof left join p on q.user_id = p.user_id and q.ts <= p.ts),
b as (select a.event_id, a.v0, p.v v1 from (select *, ts + interval 1 day t1 from a) a asof left join p on a.user_id = p.user_id and a.t1 <= p.ts)"""


@query(f"with {_P}{_RET} select event_id, round(case when v0 <> 0 then v1 / v0 - 1 end, 6) ret from b where v0 is not null and v1 is not null")
def event_window_return(spark, d):
    """Return from the first price at or after an event to the first at or after one day later."""
    p, q = _prices(spark, d)
    a = S.as_of(q, p, key="user_id", time="ts", value="v", forward=True, block=_DAY()).withColumnRenamed("as_of", "v0")
    b = S.as_of(a.withColumn("ts", F.expr("ts + interval 1 day")), p, key="user_id", time="ts", value="v", forward=True, block=_DAY())
    return b.where("v0 is not null and as_of is not null").select("event_id", F.round(F.expr("case when v0 <> 0 then as_of / v0 - 1 end"), 6).alias("ret"))


@query("select cast(user_id % 16 as int) shard, time_bucket(interval 1 hour, ts) bucket, count(*) n, round(sum(value), 4) total from events group by all")
def event_tumbling(spark, d):
    return events(spark, d).groupBy((F.col("user_id") % 16).cast("int").alias("shard"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("""with t as (select user_id, ts, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end nw from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(nw) over (partition by user_id order by ts rows unbounded preceding) s from t) select user_id, min(ts) start_ts, count(*) n from s group by user_id, s""")
def event_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = events(spark, d).withColumn("nw", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1))
    t = t.withColumn("s", F.sum("nw").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("user_id", "s").agg(F.min("ts").alias("start_ts"), F.count(F.lit(1)).alias("n")).drop("s")


@query("""with recursive e as (select distinct user_id, epoch_us(ts) t from events), o as (select *, row_number() over (partition by user_id order by t) r from e),
w as (select user_id, t, r, t kept, true keep from o where r = 1 union all
  select o.user_id, o.t, o.r, case when o.t - w.kept >= 21600000000 then o.t else w.kept end, o.t - w.kept >= 21600000000 from w join o on o.user_id = w.user_id and o.r = w.r + 1)
select user_id, t from w where keep""")
def event_min_gap(spark, d):
    e = events(spark, d).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return S.thin(e, key="user_id", time="t", gap=6 * 3600 * 1_000_000)


_AUDIO = """a as (select audio_id lid, any_value(lower(trim(case_id))) conv, any_value(start_time_s) ls, any_value(end_time_s) le from audio_behavior_segments where start_time_s < end_time_s group by audio_id)"""


def _audio(spark, d):
    a = read_table(spark, d, "audio_behavior_segments").where("start_time_s < end_time_s").dropDuplicates(["audio_id"])
    return a.select(norm_key(F.col("case_id")).alias("conv"), F.col("audio_id").alias("lid"), F.col("start_time_s").alias("ls"), F.col("end_time_s").alias("le"))


def _segments(spark, d):
    t = turns(spark, d).where("start_s < end_s")
    return t.select("conv", F.col("turn").alias("rid"), F.col("start_s").alias("rs"), F.col("end_s").alias("re"), "role", "text", "segment_id")


@query(f"""with {TURNS}, {_AUDIO} select conv, lid audio_id, turn, round(least(le, end_s) - greatest(ls, start_s), 6) overlap from a join turns using (conv)
where start_s < end_s and ls < end_s and start_s < le""")
def audio_segment_overlaps(spark, d):
    o = S.overlaps(_audio(spark, d), _segments(spark, d).select("conv", "rid", "rs", "re"), key="conv", width=60.0)
    return o.select("conv", F.col("lid").alias("audio_id"), F.col("rid").alias("turn"), F.round("overlap", 6).alias("overlap"))


_AUDIO_ROWS = f"""{_AUDIO}, co as (select lid, role, turn, segment_id, least(le, end_s) - greatest(ls, start_s) o from a join turns using (conv) where start_s < end_s and ls < end_s and start_s < le),
ck as (select *, row_number() over (partition by lid order by o desc, turn) k from co), context as (select lid audio_id, role, turn, segment_id from ck where k = 1)"""


def audio_context(spark, d):
    """(audio_id, role, turn, segment_id): the segment with the largest overlap of each audio row; the first of equal ones."""
    seg = _segments(spark, d)
    o = S.overlaps(_audio(spark, d), seg.select("conv", "rid", "rs", "re"), key="conv", width=60.0)
    best = o.groupBy("conv", F.col("lid").alias("audio_id")).agg(F.max(F.struct("overlap", (-F.col("rid")).alias("o")))["o"].alias("o"))
    best = best.select("conv", "audio_id", (-F.col("o")).alias("turn"))
    return best.join(seg.select("conv", F.col("rid").alias("turn"), "role", "segment_id"), ["conv", "turn"]).select("audio_id", "role", "turn", "segment_id")


@query(f"with {TURNS}, {_AUDIO_ROWS} select audio_id, role as dominant_role, turn from context")
def audio_dominant_segment(spark, d):
    return audio_context(spark, d).select("audio_id", F.col("role").alias("dominant_role"), "turn")


@query(f"""with {TURNS}, {_AUDIO}, o as (select lid, role from a join turns using (conv) where start_s < end_s and ls < end_s and start_s < le)
select lid audio_id, bool_or(role = 'analyst') any_question, bool_or(role = 'executive') any_answer, count(*) n_segments from o group by lid""")
def audio_overlap_flags(spark, d):
    seg = _segments(spark, d)
    o = S.overlaps(_audio(spark, d), seg.select("conv", "rid", "rs", "re"), key="conv", width=60.0).join(seg.select("conv", "rid", "role"), ["conv", "rid"])
    return o.groupBy(F.col("lid").alias("audio_id")).agg(
        F.bool_or(F.col("role") == "analyst").alias("any_question"), F.bool_or(F.col("role") == "executive").alias("any_answer"), F.count(F.lit(1)).alias("n_segments")
    )


@query("""with a as (select distinct * from audio_behavior_segments), r as (
  select audio_id, hesitation_score, pause_before_answer_ms p, silence_ratio s, filler_count f, word_count w,
    row_number() over (partition by lower(trim(case_id)), qa_pair_id order by start_time_s nulls last, audio_id) k from a where qa_pair_id is not null)
select audio_id, round(least(1, coalesce(nullif(p, 'nan'::double), 0) / 3000) * 4 + least(1, coalesce(nullif(s, 'nan'::double), 0)) * 3 + case when w > 0 then least(1, f / w * 10) else 0 end * 3, 4) hesitation from r where k = 1""")
def audio_hesitation(spark, d):
    """Blended hesitation of the first answer segment of each pair."""
    a = read_table(spark, d, "audio_behavior_segments").distinct().where("qa_pair_id is not null")
    w = Window.partitionBy(norm_key(F.col("case_id")), "qa_pair_id").orderBy(F.asc_nulls_last("start_time_s"), "audio_id")
    a = a.withColumn("k", F.row_number().over(w)).where("k = 1")
    part = lambda c, top: F.least(F.lit(1.0), F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0)) / top)
    fill = F.when(F.col("word_count") > 0, F.least(F.lit(1.0), F.col("filler_count") / F.col("word_count") * 10)).otherwise(0.0)
    return a.select("audio_id", F.round(part(F.col("pause_before_answer_ms"), 3000) * 4 + part(F.col("silence_ratio"), 1) * 3 + fill * 3, 4).alias("hesitation"))




_ASKED = f"""asks as (select conv, start_s t, min(turn) aid from scored where start_s is not null and length({X.strip('text')}) > 15 and (contains(text, '?') or {X.any_phrase(f"lower({X.strip('text')})", L.SHIFT_QUESTION_PHRASES)}) group by 1, 2),
ordered as (select *, row_number() over (partition by conv order by t) r from asks),
walk as (select conv, t, aid, r, t kept, true keep from ordered where r = 1 union all
  select o.conv, o.t, o.aid, o.r, case when o.t - w.kept >= 30 then o.t else w.kept end, o.t - w.kept >= 30 from walk w join ordered o on o.conv = w.conv and o.r = w.r + 1)"""


@query(f"""with recursive {TURNS.lstrip()}, {SCORED}, {_ASKED}, k as (select conv, aid, t from walk where keep), c as (select conv, start_s s, end_s e, signed from scored where start_s < end_s),
m as (select k.conv, k.aid, avg(signed) filter (where e > t - 60 and s < t) b, avg(signed) filter (where e > t and s < t + 120) a from k left join c on k.conv = c.conv group by 1, 2)
select conv, cast(aid as varchar) aid, {X.exact('b', 6)} before, {X.exact('a', 6)} after, {X.exact('a - b', 6)} shift from m""")
def question_shifts(spark, d):
    """Mean tone of what overlaps the 60 s before and 120 s after each question, of whatever role.

    A question has more than 15 characters and a question mark or phrase; those less than 30 s
    after the last kept one are left out, and of several at one time the first turn is kept."""
    t = scored(spark, d)
    chunks = t.where("start_s < end_s").select("conv", F.col("turn").alias("cid"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("signed").alias("score"))
    text = T.strip(F.col("text"))
    asks = (F.length(text) > 15) & (text.contains("?") | (T.phrase_count(text, L.SHIFT_QUESTION_PHRASES) > 0))
    asked = t.where(asks & F.col("start_s").isNotNull()).groupBy("conv", F.col("start_s").alias("t")).agg(F.min("turn").alias("aid"))
    anchors = asked.join(S.thin(asked, key="conv", time="t", gap=30.0), ["conv", "t"]).select("conv", "aid", "t")
    return S.window_means(anchors, chunks, key="conv", before=60.0, after=120.0)


@query(f"""with {TURNS}, f as (select conv, min(start_s) s0 from turns where start_s is not null group by conv), b as (
  select conv, turn, cast(floor((start_s - s0) / 30) as bigint) win, end_s, start_s, nullif({X.strip('text')}, '') as text from turns join f using (conv) where start_s is not null),
g as (select conv, win, arg_max(end_s, (start_s, turn)) end_s, count(*) n_segments, length(string_agg(text, ' ')) n_chars from b group by conv, win)
select conv, win, end_s, n_segments, n_chars from g where n_chars >= 40 or (n_chars > 0 and win = (select max(win) from g h where h.conv = g.conv))""")
def window_chunks(spark, d):
    """Windows of 30 s anchored at the first start, with their trimmed texts joined by blanks; windows with less than
    40 characters are dropped, but for the last one of a conversation, which only needs any text. end_s is that of the last segment."""
    t = turns(spark, d).where("start_s is not null").withColumn("n", F.nullif(F.length(T.strip(F.col("text"))), F.lit(0)))
    t = t.withColumn("win", F.floor((F.col("start_s") - F.min("start_s").over(Window.partitionBy("conv"))) / 30))
    g = t.groupBy("conv", "win").agg(F.max_by("end_s", F.when(F.col("end_s").isNotNull(), F.struct("start_s", "turn"))).alias("end_s"), F.count(F.lit(1)).alias("n_segments"), (F.sum("n") + F.count("n") - 1).alias("n_chars"))
    last = F.col("win") == F.max("win").over(Window.partitionBy("conv"))
    return g.withColumn("last", last).where("n_chars >= 40 or last and n_chars > 0").drop("last")


@query("""with t as (select *, case when (value < 40) is not distinct from lag(value < 40) over w then 0 else 1 end nw from events window w as (partition by user_id order by ts, event_id)), r as (select *, sum(nw) over (partition by user_id order by ts, event_id) run from t),
o as (select user_id, run, any_value(value < 40) s, count(*) n from r group by 1, 2), m as (select *, case when s and n * 100e0 >= 120 then n * 100e0 end ms from o)
select user_id, cast(sum(n) as bigint) n_frames, round(sum(case when s then n else 0 end) / sum(n), 4) silence_ratio, count(ms) pause_count, count(*) filter (where ms >= 450) burst_count, round(coalesce(avg(ms), 0), 4) mean_ms, round(coalesce(max(ms), 0), 4) max_ms from m group by user_id""")
def frame_pauses(spark, d):
    """Events as frames of 100 ms, silent below a value of 40."""
    return S.pause_stats(events(spark, d), key="user_id", order=["ts", "event_id"], silent=F.col("value") < 40, hop_ms=100.0)


@query(f"""with {_P}, f as (select user_id, ts, max(value) < 40 s from events group by all), n as (select *, row_number() over w i, max(case when not s then rn end) over w loud from (select *, row_number() over (partition by user_id order by ts) rn from f) window w as (partition by user_id order by ts rows unbounded preceding)),
k as (select user_id, ts, i - coalesce(loud, 0) quiet from n) select q.event_id, least(coalesce(k.quiet, 0) * 100e0, 2000) silence_ms from q asof left join k on q.user_id = k.user_id and q.ts >= k.ts""")
def frame_leading_silence(spark, d):
    """Silence up to each event of the last kind, itself a frame."""
    f = events(spark, d).groupBy("user_id", "ts").agg(F.max("value").alias("v"))
    q = _prices(spark, d)[1]
    return S.leading_silence(f, q, key="user_id", time="ts", silent=F.col("v") < 40, hop_ms=100.0).select("event_id", "silence_ms")


_WINDOWS = [("0h:1h", 0, 3600), ("0h:1d", 0, 86400), ("-1h:6h", -3600, 21600)]


@query(f"""with {_P}, w(name, a, b) as (values {", ".join(map(str, _WINDOWS))}), x as (select q.event_id, q.user_id, w.name, q.ts + to_seconds(a) t0, q.ts + to_seconds(b) t1 from q, w),
s as (select x.*, p.v v0 from x asof left join p on x.user_id = p.user_id and x.t0 <= p.ts), e as (select s.*, p.v v1 from s asof left join p on s.user_id = p.user_id and s.t1 <= p.ts),
n as (select *, lead(v) over (partition by user_id order by ts) nv, from p), b as (select q.event_id, n.v v0, n.nv v1 from q asof left join n on q.user_id = n.user_id and q.ts >= n.ts), f as (select q.event_id, n.v w0, n.nv w1 from q asof left join n on q.user_id = n.user_id and q.ts <= n.ts),
c as (select b.event_id, 'close:close' name, case when b.v0 is null then w0 else b.v0 end v0, case when b.v0 is null then w1 else b.v1 end v1 from b join f using (event_id))
select event_id, name as window_name, round(case when v0 <> 0 then v1 / v0 - 1 end, 6) ret from (select event_id, name, v0, v1 from e union all select * from c) where v0 is not null and v1 is not null""")
def event_window_returns(spark, d):
    """Returns of every event over several windows: first price at or after both ends; close:close from the price at or before
    (else at or after) to the next one."""
    p, q = _prices(spark, d)
    w = spark.createDataFrame(_WINDOWS, "name string, a int, b int")
    at = lambda c: F.expr(f"timestampadd(SECOND, {c}, ts0)")
    x = q.withColumnRenamed("ts", "ts0").join(F.broadcast(w)).withColumn("ts", at("a"))
    s = S.as_of(x, p, key="user_id", time="ts", value="v", forward=True, block=_DAY()).withColumnRenamed("as_of", "v0").withColumn("ts", at("b"))
    e = S.as_of(s, p, key="user_id", time="ts", value="v", forward=True, block=_DAY()).select("event_id", F.col("name").alias("window_name"), "v0", F.col("as_of").alias("v1"))
    n = p.withColumn("n", F.struct("v", F.lead("v").over(Window.partitionBy("user_id").orderBy("ts")).alias("nv"))).drop("v")
    c = S.as_of(q, n, key="user_id", time="ts", value="n", block=_DAY()).withColumnRenamed("as_of", "b")
    c = S.as_of(c, n, key="user_id", time="ts", value="n", forward=True, block=_DAY()).withColumn("k", F.coalesce("b", "as_of"))
    e = e.unionByName(c.select("event_id", F.lit("close:close").alias("window_name"), F.col("k.v").alias("v0"), F.col("k.nv").alias("v1")))
    return e.where("v0 is not null and v1 is not null").select("event_id", "window_name", F.round(F.expr("case when v0 <> 0 then v1 / v0 - 1 end"), 6).alias("ret"))
