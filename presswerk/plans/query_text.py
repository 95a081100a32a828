"""Queries on column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswerk.functions import text as fn
from presswerk.operators import pack as pk
from presswerk.plans import views
from presswerk.plans.registry import query
from presswerk.plans.views import NOW, with_views

_S = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_N = rf"regexp_replace(lower({_S}), '\s+', ' ', 'g')"
_MARK = "chr(10) || chr(10) || '[TRUNCATED FOR CONTEXT WINDOW]' || chr(10)"


def docs(spark, d):
    return views.table(spark, d, "documents")


@query(with_views("articles") + f"select id, sha256(title || '|' || url || '|' || {_N}) as content_hash from articles")
def content_hash(spark, d):
    return views.articles(spark, d, hashes=True).select("id", "content_hash")


@query("select doc_id, sha256('https://' || source || '/' || doc_id) as id from documents")
def stable_id(spark, d):
    return docs(spark, d).select("doc_id", fn.stable_id(F.concat(F.lit("https://"), "source", F.lit("/"), "doc_id")).alias("id"))


@query(f"select doc_id, sha256({_N}) as h, length({_N})::int as n from documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(fn.normalize(F.col("text")), 256).alias("h"), F.length(fn.normalize(F.col("text"))).alias("n"))


@query(f"select doc_id, case when length({_S}) <= 200 then {_S} else {_S}[:200] || '…' end as clipped from documents")
def clip_text(spark, d):
    return docs(spark, d).select("doc_id", fn.clip(F.col("text"), 200).alias("clipped"))


@query("select doc_id, greatest(1, floor(length(text) / 3.6::double))::bigint as t36, greatest(1, floor(length(text) / 2.4::double))::bigint as t24 from documents")
def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", fn.estimate_tokens(F.col("text")).alias("t36"), fn.estimate_tokens(F.col("text"), 2.4).alias("t24"))


@query("select source, sum(length(text) + length(source) + 200)::bigint as chars from documents group by source")
def batch_chars(spark, d):
    e = pk.estimate(F.length(fn.text(F.col("text"))), F.col("source"), F.lit(""))
    return docs(spark, d).groupBy("source").agg(F.sum(e).alias("chars"))


_HEAD = "translate(text[:length(text) - 120], chr(10) || chr(9), '  ')"
_CUT = f"case when strpos({_HEAD}, ' ') > 0 and length({_HEAD}) - strpos(reverse({_HEAD}), ' ') > 0 then length({_HEAD}) - strpos(reverse({_HEAD}), ' ') else length(text) - 120 end"


@query(rf"select doc_id, case when length(text) <= 120 then '' else regexp_replace(text[:{_CUT}], '\s+$', '') || {_MARK} end as trimmed from documents")
def trim_tail(spark, d):
    return docs(spark, d).select("doc_id", fn.trim_tail(F.col("text"), F.lit(50)).alias("trimmed"))


@query(rf"select doc_id, case when length(text) <= 120 then '[TRUNCATED FOR CONTEXT WINDOW]' || chr(10) else regexp_replace(regexp_replace(text[:length(text) - 120], '[\p{{L}}\p{{N}}]+$', ''), '\s+$', '') || chr(10) || '[TRUNCATED]' || chr(10) end as trimmed from documents")
def trim_tail_alnum(spark, d):
    return docs(spark, d).select("doc_id", fn.trim_tail_alnum(F.col("text"), F.lit(50)).alias("trimmed"))


_MT = "select conv_id, string_agg(role || ':' || chr(10) || text, chr(10) || chr(10) order by turn, role, text) as t from conversations group by conv_id"


@query(_MT)
def messages_text(spark, d):
    return views.messages(spark, d).select("conv_id", fn.messages_text(F.col("messages")).alias("t"))


@query("select conv_id, (max(rn) filter (role = 'user') - 1)::int as last_user from (select *, row_number() over (partition by conv_id order by turn, role, text) as rn from conversations) group by conv_id")
def last_user_index(spark, d):
    return views.messages(spark, d).select("conv_id", fn.last_user(F.col("messages")).alias("last_user"))


_LAST = "m as (select *, row_number() over (partition by conv_id order by turn, role, text) as rn from conversations), l as (select *, rn = max(case when role = 'user' then rn end) over (partition by conv_id) as last from m)"


@query(f"""with {_LAST}, x as (select conv_id, rn, role, case when last and length(text) > 921 then text[:921] || {_MARK} else text end as cut, text from l),
s as (select conv_id, string_agg(role || ':' || chr(10) || text, chr(10) || chr(10) order by rn) as t, string_agg(role || ':' || chr(10) || cut, chr(10) || chr(10) order by rn) as c from x group by conv_id)
select conv_id, case when greatest(1, floor(length(t) / 3.6::double)) > 256 then c else t end as t, greatest(1, floor(length(case when greatest(1, floor(length(t) / 3.6::double)) > 256 then c else t end) / 3.6::double))::bigint as est, 256::bigint as budget from s""")
def enforce_budget(spark, d):
    messages, est, budget = fn.enforce_budget(F.col("messages"), 1980, 700, 1024)
    return views.messages(spark, d).select("conv_id", fn.messages_text(messages).alias("t"), est.alias("est"), budget.alias("budget"))


@query(rf"""with {_LAST} select conv_id, string_agg(role || ':' || chr(10) || case when not coalesce(last, false) then text when text = '' then '' when length(text) <= 120 then '' else regexp_replace(text[:{_CUT}], '\s+$', '') || {_MARK} end, chr(10) || chr(10) order by rn) as t from l group by conv_id""")
def trim_last_user(spark, d):
    cut = fn.with_last_user(F.col("messages"), lambda c: fn.trim_tail(c, F.lit(50)))
    return views.messages(spark, d).select("conv_id", fn.messages_text(cut).alias("t"))


@query("select event_id, event_id % 3000 as overflow, case when event_id % 3000 <= 200 then 'word_trim' when event_id % 3000 <= 1200 then 'drop_one_article' else 'drop_multiple_articles' end as action from events")
def overflow_parse(spark, d):
    error = F.concat(F.lit("400: Exceeded max context length by "), F.col("event_id") % 3000, F.lit(" tokens"))
    o = fn.overflow_tokens(error)
    return views.table(spark, d, "events").select("event_id", o.alias("overflow"), fn.trim_action(o).alias("action"))


@query("select event_id, case event_id % 5 when 0 then 0 else (event_id % 90) * case event_id % 5 when 1 then 60 when 2 then 3600 when 3 then 86400 else 604800 end end::bigint as seconds from events")
def lookback_parse(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ["y", "m", "H", " d", "w "])), (F.col("event_id") % 5 + 1).cast("int"))
    return views.table(spark, d, "events").select("event_id", fn.lookback_seconds(F.concat(F.lit(" "), F.col("event_id") % 90, unit)).alias("seconds"))


@query(with_views("summaries") + "select id, class from summaries")
def summary_class(spark, d):
    return views.summaries(spark, d).select("id", fn.summary_class(F.col("doc_json")).alias("class"))


@query("select event_id, case when event_id % 4 = 0 then event_id end as n, case when event_id % 3 = 0 then event_id else -1 end as m from events")
def safe_values(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(F.lit(" "), e, F.lit(" "))).when(e % 4 == 1, "None").when(e % 4 == 2, "NULL ").otherwise("")
    number = F.when(e % 3 == 0, e.cast("string")).when(e % 3 == 1, "x1").otherwise(F.lit(None))
    return views.table(spark, d, "events").select("event_id", fn.normal_summary_id(raw).cast("long").alias("n"), fn.safe_int(number, -1).alias("m"))


@query("select event_id, 'sum_' || strftime(ts, '%Y%m%d_%H%M') || case when event_id % 2 = 0 then '_job' || event_id else '' end as id from events")
def summary_doc_id(spark, d):
    t = views.table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return t.select("event_id", fn.summary_doc_id(F.col("s"), F.when(F.col("event_id") % 2 == 0, F.col("event_id"))).alias("id"))


@query("select event_id, 'Nyhetssammanfattning ' || strftime(ts, '%Y-%m-%d') || case when event_id % 2 = 0 then '–' || strftime(ts + interval 3 day, '%Y-%m-%d') else '' end || ' (1w)' as title from events")
def title_default(spark, d):
    t = views.table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    end = F.col("s") + F.when(F.col("event_id") % 2 == 0, 3 * 86400).otherwise(0)
    return t.select("event_id", fn.default_title(F.lit("1w"), F.col("s"), end).alias("title"))


def _trimmed(expr: str, mark: str) -> str:
    return f"regexp_replace({expr}, '^{mark}+|{mark}+$', '', 'g')"


_LINE = rf"regexp_extract(chr(34) || {_S}, '^([^\n\r]*)', 1)"
for _mark in (r"\s", '"', "''", r"\s"):
    _LINE = _trimmed(_LINE, _mark)


@query(rf"select doc_id, case when line = '' then 'none' when length(line) > 120 then regexp_replace(line[:120], '\s+$', '') || '…' else line end as title from (select doc_id, {_LINE} as line from documents)")
def title_clean(spark, d):
    return docs(spark, d).select("doc_id", fn.clean_title(F.concat(F.lit('  "'), fn.strip(F.col("text"))), F.lit("none")).alias("title"))


@query(with_views("articles") + f"select id, '[' || pos || '] ' || title || ' (' || source || ') ' || url || chr(10) || {_S} as block from articles")
def compact_block(spark, d):
    a = views.articles(spark, d)
    return a.select("id", fn.article_block(F.col("pos"), F.col("title"), F.col("source"), F.col("url"), F.col("text")).alias("block"))


@query(rf"""select conv_id, 'Intro' || chr(10) || chr(10) || string_agg('## ' || role || turn || chr(10) || chr(10) || {_S}, chr(10) || chr(10) order by turn, role, text) as t from conversations where {_S} <> '' group by conv_id""")
def composed_text(spark, d):
    m = views.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    s = F.transform("s", lambda x: F.struct(F.concat(x["role"], x["turn"]).alias("tag"), x["text"].alias("summary")))
    return m.select("conv_id", fn.composed_text(s, F.lit(" Intro ")).alias("t"))


@query(f"select doc_id, case when {_S} = '' then 'Intro' else 'Intro' || chr(10) || chr(10) || {_S} end as t from documents")
def prepend_ingress(spark, d):
    return docs(spark, d).select("doc_id", fn.prepend_ingress(F.col("text"), F.lit("Intro ")).alias("t"))


_HEAD = "'## Källor' || chr(10)"
_FULL = f"regexp_replace(case doc_id % 3 when 0 then text || chr(10) || {_HEAD} || chr(10) || '- a' || chr(10) when 1 then {_HEAD} || text else text end, '\\s+$', '')"


@query(rf"""with s as (select doc_id, {_FULL} as s from documents where text is not null), p as (select *, strpos(s, chr(10) || {_HEAD}) as p from s)
select doc_id, case when p > 0 then regexp_replace(s[:p - 1], '\s+$', '') when starts_with(s, {_HEAD}) then '' else s end as t from p""")
def strip_appendix(spark, d):
    k = F.col("doc_id") % 3
    full = F.when(k == 0, F.concat("text", F.lit("\n## Källor\n\n- a\n"))).when(k == 1, F.concat(F.lit("## Källor\n"), "text")).otherwise(F.col("text"))
    return docs(spark, d).where("text is not null").select("doc_id", fn.strip_appendix(full).alias("t"))


@query(rf"""with s as (select doc_id, regexp_replace(case when doc_id % 2 = 0 then text || chr(10) || 'Källor: x' else text end, '^\s+|\s+$', '', 'g') as s from documents where text is not null),
h as (select *, regexp_extract(s, '(?is)^(.*(?:^|\n))källor\s*:[^\n]*', 1) as head, regexp_matches(s, '(?im)^källor\s*:') as found from s)
select doc_id, case when s = '' then '' when found then regexp_replace(regexp_replace(head, '\s+$', '') || chr(10) || chr(10) || 'Note' || chr(10) || chr(10) || regexp_replace(s[length(head) + 1:], '^\s+', ''), '^\s+|\s+$', '', 'g') || chr(10)
  else s || chr(10) || chr(10) || 'Note' || chr(10) end as t from h""")
def note_before_sources(spark, d):
    full = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\nKällor: x"))).otherwise(F.col("text"))
    return docs(spark, d).where("text is not null").select("doc_id", fn.note_before_sources(full, F.lit(" Note ")).alias("t"))


_C = rf"regexp_replace({_S}, '\s+', ' ', 'g')"


@query(rf"select doc_id, case when length({_C}) <= 220 then {_C} else regexp_replace({_C}[:217], '\s+$', '') || '...' end as t from documents")
def log_excerpt(spark, d):
    return docs(spark, d).select("doc_id", fn.log_excerpt(F.col("text")).alias("t"))


@query("select doc_id, case when length(text) = 0 then 1.0 else round(least(1.0::double, length(text[:500])::double / length(text)), 6) end as r from documents")
def coverage_ratio(spark, d):
    return docs(spark, d).select("doc_id", F.round(fn.coverage_ratio(F.col("text"), F.substring("text", 1, 500)), 6).alias("r"))


def _template(s: str) -> str:
    """SQL of ``placeholder_template`` on a stripped text."""
    hits = rf"len(regexp_extract_all({s}, '(\[[^\]\n]{{3,120}}\])', 1))"
    labels = rf"len(list_filter(regexp_extract_all({s}, '(?im)^(?:rubrik|ingress|brödtext)\s*:\s*(.+)$', 1), lambda v: contains(v, '[') and contains(v, ']')))"
    return f"({s} <> '' and ({hits} >= 3 or {labels} >= 2 or (contains(lower({s}), 'reviderad sammanfattning') and {hits} >= 1)))"


@query(rf"""with s as (select doc_id, regexp_replace(text || case doc_id % 4 when 0 then ' x [abc] [de' || chr(10) || '] y' when 1 then chr(10) || 'Rubrik: [a]' || chr(10) || 'Ingress: [bcd]' when 2 then ' Reviderad Sammanfattning: [här]' else '' end, '^\s+|\s+$', '', 'g') as s from documents where text is not null)
select doc_id, {_template("s")} as p from s""")
def placeholder_detector(spark, d):
    k = F.col("doc_id") % 4
    more = F.when(k == 0, " x [abc] [de\n] y").when(k == 1, "\nRubrik: [a]\nIngress: [bcd]").when(k == 2, " Reviderad Sammanfattning: [här]").otherwise("")
    return docs(spark, d).where("text is not null").select("doc_id", fn.placeholder_template(F.concat("text", more)).alias("p"))


@query(rf"""with r as (select doc_id, case when doc_id % 7 = 1 then '' else {_S} end as prev, case doc_id % 7 when 0 then '' when 2 then {_S} || ' [abc] [def] [ghi]' when 3 then {_S}[:length({_S}) // 3] else {_S} end as new, doc_id % 7 = 4 as headed from documents),
s as (select doc_id, regexp_replace(case when headed then '## a' || chr(10) || prev else prev end, '^\s+|\s+$', '', 'g') as prev, regexp_replace(new, '^\s+|\s+$', '', 'g') as new from r)
select doc_id, case when new = '' then 'empty_response' when prev = '' then 'accepted_no_previous_text' when {_template("new")} then 'placeholder_template' when length(new) < greatest(200, floor(length(prev) * 0.35::double)) then 'extreme_truncation'
  when contains(prev, '## ') and not contains(new, '## ') then 'missing_section_headings' else 'accepted' end as verdict from s""")
def rewrite_validator(spark, d):
    k, s = F.col("doc_id") % 7, fn.strip(F.col("text"))
    prev = F.when(k == 1, "").when(k == 4, F.concat(F.lit("## a\n"), s)).otherwise(s)
    new = F.when(k == 0, "").when(k == 2, F.concat(s, F.lit(" [abc] [def] [ghi]"))).when(k == 3, F.substring(s, F.lit(1), F.floor(F.length(s) / 3).cast("int"))).otherwise(s)
    return docs(spark, d).select("doc_id", fn.rewrite_verdict(prev, new).alias("verdict"))


@query("""with r as (select doc_id, length(text) as p, length(text) * (doc_id % 11) // 10 as c, length(text) * (doc_id % 7) // 10 as x from documents)
select doc_id, case when p <= 0 then 1.0 else round(least(1.0::double, c::double / p), 6) end as ratio,
 case when p <= 0 then 'accepted_no_previous_text' when least(1.0::double, c::double / p) >= 0.9 then 'accepted_ratio' when x < floor(greatest(0, p - c) * 0.5::double) then 'blocked_large_loss_without_delete_ops' else 'accepted_delete_justified' end as reason from r""")
def retention_guard(spark, d):
    n = F.length("text")
    ratio, reason = fn.retention(n, F.expr("length(text) * (doc_id % 11) div 10"), F.expr("length(text) * (doc_id % 7) div 10"))
    return docs(spark, d).select("doc_id", F.round(ratio, 6).alias("ratio"), reason.alias("reason"))


@query(rf"""with b as (select doc_id, coalesce(text, '') as t, regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0) as w, doc_id % 4 as k from documents),
c as (select *, strpos(t, w) as spot, k < 3 and w <> '' as fits from b)
select doc_id, sha256(regexp_replace(case when not fits then t else t[:spot - 1] || case k when 0 then 'NEW' when 1 then '' else w || 'X' end || t[spot + length(w):] end, '^\s+|\s+$', '', 'g')) as h,
 fits::int as applied, 3 - fits::int as skipped, case when fits and k = 1 then length(w) else 0 end::int as deleted_chars from c""")
def apply_operations(spark, d):
    """Edits of whole texts: the first word is replaced, deleted or added to; a missing and an empty target are skipped."""
    k, word = F.col("doc_id") % 4, F.regexp_extract(fn.text(F.col("text")), "[A-Za-z]+", 0)
    op = lambda o, t, x: F.struct(F.lit(o).alias("op"), F.lit("").alias("issue_id"), t.alias("target_quote"), F.lit(x).alias("text"))
    first = F.when(k == 0, op("replace", word, "NEW")).when(k == 1, op("delete", word, "")).when(k == 2, op("insert_after", word, "X")).otherwise(op("insert_after", word, ""))
    ops = F.array(first, op("replace", F.lit("\x01 missing \x01"), "y"), op("delete", F.lit(""), ""))
    r = docs(spark, d).select("doc_id", fn.apply_operations(F.col("text"), ops).alias("r"))
    return r.select("doc_id", F.sha2("r.text", 256).alias("h"), "r.applied", "r.skipped", "r.deleted_chars")


@query("select doc_id, case doc_id % 3 when 0 then 'delete' when 1 then 'replace' else 'insert_after' end as op, case when doc_id % 2 = 0 then 'issue_1' else 'i' || doc_id end as issue_id, 'q' as target_quote, 'new' as text from documents")
def operation_defaults(spark, d):
    k = F.col("doc_id")
    raw = F.struct(
        F.when(k % 3 == 0, " Delete ").when(k % 3 == 1, "unknown").alias("op"), F.when(k % 3 == 2, "INSERT_AFTER").alias("operation"), F.when(k % 2 == 1, F.concat(F.lit("i"), k)).alias("issue_id"),
        F.lit(" q ").alias("target_quote"), F.lit("").alias("text"), F.when(k % 2 == 0, "new").alias("replacement"), F.lit(" new").alias("content"),
    )
    return docs(spark, d).select("doc_id", fn.coerce_op(raw, F.lit(1)).alias("o")).select("doc_id", "o.*")


@query("select source, 'job_7_' || sha256(string_agg(doc_id::varchar, '|' order by doc_id))[:12] as k1, sha256(string_agg(doc_id::varchar, '|' order by doc_id))[:16] as k2, 'job_7' as k3 from documents group by source")
def checkpoint_key(spark, d):
    g = docs(spark, d).groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("x")).withColumn("x", F.transform("x", lambda i: i.cast("string")))
    none = F.lit(None).cast("long")
    return g.select("source", fn.checkpoint_key(F.lit(7), F.col("x")).alias("k1"), fn.checkpoint_key(none, F.col("x")).alias("k2"), fn.checkpoint_key(F.lit(7), F.col("x"), True).alias("k3"))


@query(with_views("articles") + "select source, string_agg('- ' || title || ' — ' || url, chr(10) order by pos) as lines from articles group by source")
def source_lines(spark, d):
    line = fn.source_line(F.col("title"), F.col("url"))
    g = views.articles(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("x"))
    return g.select("source", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("lines"))


@query("select event_id, case when event_id % 2 = 0 then floor(epoch(ts))::bigint end as t from events")
def entry_timestamp(spark, d):
    t = views.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    k = F.col("event_id") % 6
    rfc = F.date_format("ts", "d MMM yyyy HH:mm:ss")
    raw = F.when(k == 0, F.concat(F.date_format("ts", "E, "), rfc, F.lit(" GMT"))).when(k == 2, rfc).when(k == 4, F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "d MMM yyyy HH:mm:ss"), F.lit(" +0200"))).otherwise("soon")
    return t.select("event_id", fn.entry_ts(raw).alias("t"))


@query("select conv_id, string_agg(role, ',' order by first) as roles from (select conv_id, role, min(rn) as first from (select *, row_number() over (partition by conv_id order by turn, role, text) as rn from conversations) group by all) group by conv_id")
def ordered_dedupe(spark, d):
    return views.messages(spark, d).select("conv_id", F.array_join(fn.ordered_distinct(F.transform("messages", lambda m: m["role"])), ",").alias("roles"))


@query("select event_id, case when greatest(512, greatest(2048, 9000 - event_id % 9000) - 1200) >= 4000 then 2400 else greatest(512, greatest(2048, 9000 - event_id % 9000) - 1200) end::bigint as budget from events")
def adaptive_budget(spark, d):
    return views.table(spark, d, "events").select("event_id", fn.adaptive_budget(F.lit(9000).cast("long"), F.col("event_id") % 9000, F.lit(4000).cast("long")).alias("budget"))


@query(f"""with recursive t as (select doc_id, 0 as k, text as x, length(text) as n from documents
  union all select doc_id, k + 1, x[:greatest(500, floor(length(x) * 0.85::double)::int)], length(x[:greatest(500, floor(length(x) * 0.85::double)::int)]) from t where k < 6 and greatest(1, floor((n + 19) / 2.4::double)) > 400)
select doc_id, sha256('Overview' || chr(10) || 'x' || chr(10) || case when k = 6 then x[:2000] else x end || ' (end)..') as h from (select doc_id, max(k) as k, max_by(x, k) as x from t group by doc_id)""")
def super_meta_fit(spark, d):
    from presswerk.operators.budget import super_meta

    template = "Overview\n{lookback}\n{topic_summaries} (end).."
    return docs(spark, d).select("doc_id", F.sha2(super_meta(F.lit(template), F.col("text"), F.lit("x"), 400, 2.4), 256).alias("h"))


@query(f"select {NOW}::bigint as now, '2024-02-01 00:00' as minute, '' as none")
def minute_format(spark, d):
    return spark.range(1).select(F.lit(NOW).cast("long").alias("now"), fn.minute(F.lit(NOW)).alias("minute"), fn.minute(F.lit(0)).alias("none"))
