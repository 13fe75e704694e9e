"""Queries on documents: tokens, numbers, rules, chunks, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import lexicons as L
from colloquy.functions import text as T
from colloquy.operators import retrieval as R
from colloquy.plans.registry import Registry
from colloquy.plans.sqltext import sql_list
from colloquy.runtime import read_spread, read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def docs(spark, d):
    return read_spread(spark, d, "documents")


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9'']+')"
_NORM = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_ANY = lambda c, ps: "(" + " or ".join(f"contains(lower({c}), '{p}')" for p in ps) + ")"
_N = lambda c, ps: "(" + " + ".join(f"contains(lower({c}), '{p}')::int" for p in ps) + ")"
_BUCKET = "case when n < 12 then 'short' when n < 25 then 'medium' else 'long' end"


@query(rf"""with t as (select doc_id, {_TOK} ts from documents)
select doc_id, len(ts) n_tokens, len(list_distinct(ts)) n_distinct, case when len(ts) > 0 then round(len(list_distinct(ts)) / len(ts), 4) else 0 end lexical_density,
  len(list_filter(ts, lambda x: not list_contains({sql_list(L.SHORT_STOP_WORDS)}, x))) n_content from t""")
def doc_token_stats(spark, d):
    ts = T.words(F.col("text"))
    t = docs(spark, d).select("doc_id", ts.alias("ts"))
    n, k = F.size("ts"), F.size(F.array_distinct("ts"))
    return t.select("doc_id", n.alias("n_tokens"), k.alias("n_distinct"), F.round(T.share(k, n), 4).alias("lexical_density"), F.size(T.without(F.col("ts"), L.SHORT_STOP_WORDS)).alias("n_content"))


@query(rf"""with t as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) n from documents) select doc_id, {_BUCKET} length_bucket from t""")
def doc_length_bucket(spark, d):
    return docs(spark, d).select("doc_id", T.length_bucket(F.col("text")).alias("length_bucket"))


@query(r"""select doc_id, left(sha256(cast(doc_id as varchar) || chr(31) || coalesce(source, '') || chr(31)), 16) object_id,
  case when trim(regexp_replace(lower(coalesce(section, '')), '[^a-z0-9]+', '_', 'g'), '_') = '' then 'unknown' else trim(regexp_replace(lower(coalesce(section, '')), '[^a-z0-9]+', '_', 'g'), '_') end section_slug,
  'sha256:' || sha256(coalesce(text, '')) text_sha from documents""")
def doc_hashes(spark, d):
    return docs(spark, d).select(
        "doc_id", T.stable_hash(F.col("doc_id"), F.col("source")).alias("object_id"), T.slug(F.col("section")).alias("section_slug"),
        F.concat(F.lit("sha256:"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_sha"),
    )


@query(r"""with n as (select *, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ') t from documents)
select doc_id, left(t, 96) || case when length(t) > 96 then '...' else '' end preview, case when coalesce(lang = 'en', false) then left(coalesce(text, ''), 160) else '[redacted: raw text commit not allowed]' end gated,
  'sha256:' || sha256(cast(to_json({'doc_id': doc_id, 'fiscal_year': fiscal_year, 'source': source}) as varchar)) row_hash from n""")
def doc_previews(spark, d):
    """Previews of texts, in full only where the language is plainly English, and hashes of rows."""
    t = docs(spark, d)
    return t.select("doc_id", T.preview(F.col("text")).alias("preview"), T.gated_preview(F.col("text"), F.col("lang") == "en").alias("gated"), T.row_hash("source", "doc_id", "fiscal_year").alias("row_hash"))


@query(r"""with n as (select doc_id, list_transform(regexp_extract_all(text, '-?[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: try_cast(replace(x, ',', '') as double)) ns,
  regexp_extract(lower(text), 'between\s+(-?[0-9]+(?:\.[0-9]+)?)\s+and\s+(-?[0-9]+(?:\.[0-9]+)?)', ['a', 'b']) btw,
  regexp_extract(lower(text), '(-?[0-9]+(?:\.[0-9]+)?)\s*(?:to|–|-)\s*(-?[0-9]+(?:\.[0-9]+)?)', ['a', 'b']) ran from documents where text is not null)
select doc_id, len(ns) n_numbers, ns[1] first_number,
  round(coalesce((try_cast(btw.a as double) + try_cast(btw.b as double)) / 2, (try_cast(ran.a as double) + try_cast(ran.b as double)) / 2, ns[1]), 6) midpoint from n""")
def doc_numbers(spark, d):
    t = docs(spark, d).where("text is not null")
    ns = T.numbers(F.col("text"))
    return t.select("doc_id", F.size(ns).alias("n_numbers"), F.get(ns, 0).alias("first_number"), T.midpoint(F.col("text")).alias("midpoint"))


def _windows(t, width: int, step: int):
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    starts = F.filter(starts, lambda s: (s == 0) | (s + (width - step) < n))
    return t.where(n > 0).select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "start_char"))


@query("""with s as (select doc_id, text, unnest(list_filter(range(0, length(text), 700), lambda s: s = 0 or s + 100 < length(text))) start_char from documents where length(text) > 0)
select doc_id, cast(start_char // 700 as int) chunk_no, cast(start_char as int) start_char, cast(least(start_char + 800, length(text)) as int) end_char,
  left(sha256(substring(text, start_char + 1, 800)), 16) chunk_sha from s""")
def doc_char_chunks(spark, d):
    """Windows of 800 characters, 100 shared; the last is the first that reaches the end."""
    c = _windows(docs(spark, d), 800, 700)
    body = F.substring(F.col("text"), F.col("start_char") + 1, F.lit(800))
    return c.select("doc_id", "chunk_no", "start_char", F.least(F.col("start_char") + 800, F.length("text")).alias("end_char"), F.substring(F.sha2(body, 256), 1, 16).alias("chunk_sha"))


@query("""with s as (select source, doc_id, length(text) n, unnest(list_filter(range(0, length(text), 700), lambda s: s = 0 or s + 100 < length(text))) st from documents where length(text) > 0)
select source, count(*) n_chunks, cast(max(least(800, n - st)) as int) max_span, round(avg((least(800, n - st) < 800)::int), 4) short_ratio from s group by source""")
def doc_window_quality(spark, d):
    c = _windows(docs(spark, d).withColumn("doc_id", F.struct("doc_id", "source")), 800, 700)
    span = F.least(F.lit(800), F.length("text") - F.col("start_char"))
    return c.groupBy(F.col("doc_id.source").alias("source")).agg(F.count(F.lit(1)).alias("n_chunks"), F.max(span).alias("max_span"), F.round(F.avg((span < 800).cast("int")), 4).alias("short_ratio"))


@query("""with l as (select unnest(string_split(text, chr(10))) line from documents where text is not null), k as (select trim(line) line, count(*) n from l where trim(line) <> '' group by 1)
select left(sha256(line), 16) line_id, n from k where n >= 4""")
def doc_repeated_lines(spark, d):
    lines = docs(spark, d).where("text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
    k = lines.select(F.trim("line").alias("line")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return k.where("n >= 4").select(F.substring(F.sha2("line", 256), 1, 16).alias("line_id"), "n")


@query("select sha256(text) text_sha, count(*) n, min(doc_id) first_doc from documents where text is not null group by 1 having count(*) > 1")
def doc_exact_dupes(spark, d):
    t = docs(spark, d).where("text is not null").groupBy(F.sha2("text", 256).alias("text_sha"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


_LOW = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_POSTS = f"posts as (select doc_id, unnest({_LOW.format('text')}) token from documents), tf as (select doc_id, token, count(*) tf from posts group by all)"


@query(f"with {_POSTS} select token, count(*) df, round(ln(1 + ((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) idf from tf group by token")
def bm25_stats(spark, d):
    t = docs(spark, d)
    df = R.document_frequencies(R.postings(t, "doc_id", T.tokens(F.col("text"), "[a-z0-9]+")))
    n = t.agg(F.count(F.lit(1)).alias("n"))
    return df.join(F.broadcast(n)).select("token", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


_BM25 = f"""{_POSTS}, lens as (select doc_id, len({_LOW.format('text')}) n from documents), st as (select count(*) n, avg(n) avgdl from lens),
df as (select token, count(*) df from tf group by token),
q as (select item_id, unnest({_LOW.format('text')}) token from eval_passages), qt as (select item_id, token, count(*) qtf from q group by all),
sc as (select item_id, tf.doc_id, sum(qtf * ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens.n / avgdl))) score
  from qt join tf using (token) join df using (token) join lens on lens.doc_id = tf.doc_id, st group by all),
rk as (select item_id, doc_id, round(score, 6) score, cast(row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as int) rank from sc where score > 0)"""


def _asked(spark, d):
    """The stated query set: the whole texts of all evaluation passages."""
    q = read_table(spark, d, "eval_passages")
    return q.select("item_id", "lang", F.explode(T.tokens(F.col("text"), "[a-z0-9]+")).alias("token"))


@query(f"with {_BM25} select item_id, doc_id, score, rank from rk where rank <= 10")
def bm25_topk(spark, d):
    return R.bm25(docs(spark, d), _asked(spark, d), doc="doc_id", query="item_id", ts=T.tokens(F.col("text"), "[a-z0-9]+"), k=10)


_SHINGLES = f"""dts as (select doc_id, {_LOW.format('text')} ts from documents), its as (select item_id, {_LOW.format('text')} ts from eval_passages),
dsh as (select distinct doc_id, unnest(list_transform(range(1, len(ts) - 6), lambda i: array_to_string(ts[i:i + 7], ' '))) h from dts), ish as (select distinct item_id, unnest(list_transform(range(1, len(ts) - 6), lambda i: array_to_string(ts[i:i + 7], ' '))) h from its),
rel as (select item_id, doc_id from dsh join ish using (h) group by all having count(*) >= 3)"""


def _relevant(spark, d):
    ts = T.tokens(F.col("text"), "[a-z0-9]+").alias("ts")
    return R.shared_shingles(docs(spark, d).select("doc_id", ts), read_table(spark, d, "eval_passages").select("item_id", ts), doc="doc_id", item="item_id")


@query(f"""with {_BM25}, {_SHINGLES}, f as (select rel.item_id, min(rank) r from rel left join rk on rk.item_id = rel.item_id and rk.doc_id = rel.doc_id and rank <= 10 group by 1)
select count(*) n_queries, round(avg(coalesce(r <= 1, false)::int), 4) recall_at_1, round(avg(coalesce(r <= 3, false)::int), 4) recall_at_3, round(avg(coalesce(r <= 5, false)::int), 4) recall_at_5,
  round(avg(coalesce(1 / r, 0)), 4) mrr from f""")
def retrieval_metrics(spark, d):
    """Metrics of the ranking; relevant are documents that share three or more runs of eight words with the passage."""
    return R.ranking_metrics(bm25_topk(spark, d), _relevant(spark, d), query="item_id", doc="doc_id", at=[1, 3, 5])


_CBM = f"""cposts as (select doc_id, coalesce(lang, '') x, unnest({_LOW.format('text')}) token from documents), ctf as (select doc_id, x, token, count(*) tf from cposts group by all),
clen as (select doc_id, coalesce(lang, '') x, len({_LOW.format('text')}) n from documents), cst as (select x, count(*) n, avg(n) avgdl from clen group by x), cdf as (select token, x, count(*) df from ctf group by all),
cq as (select item_id, coalesce(lang, '') x, unnest({_LOW.format('text')}) token from eval_passages), cqt as (select item_id, x, token, count(*) qtf from cq group by all),
csc as (select item_id, ctf.doc_id, sum(qtf * ln(1 + (cst.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * clen.n / avgdl))) score
  from cqt join ctf using (token, x) join cdf using (token, x) join clen on clen.doc_id = ctf.doc_id join cst on cst.x = cqt.x group by all),
crk as (select item_id, doc_id, round(score, 6) score, cast(row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as int) rank from csc where score > 0)"""


@query(f"with {_CBM} select item_id, doc_id, score, rank from crk where rank <= 5")
def bm25_in_context(spark, d):
    """The five best documents of the passage's language, with that language's counts."""
    t = docs(spark, d).select("doc_id", "lang", "text")
    return R.bm25(t, _asked(spark, d), doc="doc_id", query="item_id", ts=T.tokens(F.col("text"), "[a-z0-9]+"), k=5, context=["lang"])


_OUTCOMES = f"""{_CBM}, {_SHINGLES}, q as (select item_id from eval_passages), hit as (select item_id, min(rank) first from crk join rel using (item_id, doc_id) where rank <= 5 group by 1),
ret as (select item_id, count(*) n from crk where rank <= 5 group by 1), ex as (select item_id, count(*) n from rel group by 1),
outcomes as (select q.item_id, coalesce(ex.n, 0) n_expected, coalesce(ret.n, 0) n_returned, coalesce(first, 0) first_rank, ret.n is null abstained from q left join ex using (item_id) left join ret using (item_id) left join hit using (item_id))"""


@query(f"with {_OUTCOMES} select * from outcomes")
def retrieval_outcomes(spark, d):
    """One row for each passage: what was expected and returned, the first expected rank (0 for none), abstention."""
    q = read_table(spark, d, "eval_passages").select("item_id")
    return R.outcomes(q, bm25_in_context(spark, d), _relevant(spark, d), query="item_id", doc="doc_id")


@query(f"""with {_OUTCOMES} select count(*) n_queries, count(*) filter (where n_expected > 0) n_expecting, round(avg((first_rank = 1)::int) filter (where n_expected > 0), 4) recall_at_1, round(avg((first_rank between 1 and 3)::int) filter (where n_expected > 0), 4) recall_at_3,
  round(avg((first_rank between 1 and 5)::int) filter (where n_expected > 0), 4) recall_at_5, round(avg(case when first_rank > 0 then 1 / first_rank else 0 end) filter (where n_expected > 0), 4) mrr, round(avg((first_rank > 0)::int) filter (where n_expected > 0), 4) hit_rate,
  count(*) filter (where abstained) n_abstained, round(coalesce(avg(abstained::int) filter (where n_expected = 0), 0), 4) abstention_correctness from outcomes""")
def retrieval_summary(spark, d):
    return R.outcome_rates(retrieval_outcomes(spark, d))


@query(f"""with {_POSTS}, h as (select doc_id, cast(('0x' || left(sha256(token), 8)) as bigint) % 64 bucket,
  sum(tf * case when cast(('0x' || substring(sha256(token), 9, 2)) as int) % 2 = 0 then 1.0 else -1.0 end) v from tf group by all)
select doc_id, count(*) n_buckets, round(max(abs(v)) / sqrt(sum(v * v)), 4) peak from h where v <> 0 group by doc_id""")
def doc_hash_embedding(spark, d):
    e = R.hash_embedding(R.postings(docs(spark, d), "doc_id", T.tokens(F.col("text"), "[a-z0-9]+")), "doc_id", 64)
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_buckets"), F.round(F.max(F.abs("value")), 4).alias("peak"))


_COS = """with v as (select vec_id, embedding::double[] e, label from embeddings), p as (
  select q.vec_id, v.vec_id neighbour, q.label ql, v.label nl, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) similarity
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0
), r as (select *, cast(row_number() over (partition by vec_id order by similarity desc, neighbour) as int) rank from p)"""


@query(f"{_COS} select vec_id, neighbour, similarity, rank from r where rank <= 10")
def embedding_topk(spark, d):
    return R.nearest_vectors(read_table(spark, d, "embeddings"), row="vec_id", vector="embedding", k=10)


@query(f"{_COS} select vec_id, round(avg((ql = nl)::int), 4) agreement from r where rank <= 10 group by vec_id")
def embedding_label_agreement(spark, d):
    e = read_table(spark, d, "embeddings")
    r = embedding_topk(spark, d).join(e.select("vec_id", F.col("label").alias("ql")), "vec_id")
    r = r.join(e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("nl")), "neighbour")
    return r.groupBy("vec_id").agg(F.round(F.avg((F.col("ql") == F.col("nl")).cast("int")), 4).alias("agreement"))


@query("""with r as (select doc_id, source, row_number() over (partition by source order by n_chars desc nulls last, doc_id) k from documents) select doc_id, source, cast(k as int) k from r where k <= 8""")
def cap_per_group(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), "doc_id")
    return docs(spark, d).select("doc_id", "source", F.row_number().over(w).alias("k")).where("k <= 8")


@query("""with r as (select doc_id, section, row_number() over (partition by section order by sha256('13' || chr(31) || doc_id || chr(31)), doc_id) k from documents)
select doc_id, cast(row_number() over (order by k, section nulls first, doc_id) as int) pos from r where k <= 50 order by pos limit 50""")
def round_robin(spark, d):
    """Seeded order within each section, then one of each in turn: the first 50."""
    w = Window.partitionBy("section").orderBy(T.stable_hash(F.lit(13), F.col("doc_id"), length=64), "doc_id")
    r = docs(spark, d).select("doc_id", "section", F.row_number().over(w).alias("k")).where("k <= 50")
    top = r.orderBy("k", F.asc_nulls_first("section"), "doc_id").limit(50)
    return top.select("doc_id", F.row_number().over(Window.orderBy("k", F.asc_nulls_first("section"), "doc_id")).alias("pos"))
