"""The registered queries of reports, ledgers and grounding, each with the SQL that gives the same rows.

The driver's tables stand in: documents as scored corpus rows, orders as candidates and claims, events as run records.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import evaluate, grounding, reports
from .queries import DOMAIN, REASON, query, quoted, table

SCORED = """(select d.doc_id, d.source as publisher, d.lang, l.quality::double as authors_f1, l.toxic::double as pdf_accuracy, d.n_chars::double as duration_ms, d.n_chars < 300 as blocked, d.n_chars > 600 as present,
 case when d.n_chars % 7 = 0 then 'crash' end as error from documents d left join labels l using (doc_id))"""


def scored(spark, sf_dir):
    """Documents as scored rows: labels as two metrics, short ones as blocked, some as crashed."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(l.select("doc_id", "quality", "toxic"), "doc_id", "left")
    return rows.select("doc_id", F.col("source").alias("publisher"), "lang", F.col("quality").cast("double").alias("authors_f1"), F.col("toxic").cast("double").alias("pdf_accuracy"), F.col("n_chars").cast("double").alias("duration_ms"), (F.col("n_chars") < 300).alias("blocked"), (F.col("n_chars") > 600).alias("present"), F.when(F.col("n_chars") % 7 == 0, "crash").alias("error"))


def rounded(df, names, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


@query(f"""select publisher, count(*) as rows, count(*) filter (not coalesce(blocked, false)) as scored, count(*) filter (not coalesce(blocked, false) and error is not null) as errors, count(*) filter (coalesce(blocked, false)) as skipped_no_html,
 round(coalesce(avg(authors_f1), 0), 6) as authors_f1, count(authors_f1) as n_authors_f1, round(coalesce(avg(pdf_accuracy), 0), 6) as pdf_accuracy, count(pdf_accuracy) as n_pdf_accuracy,
 round(case when count(*) filter (not coalesce(blocked, false)) > 0 then count(*) filter (present) / greatest(count(*) filter (not coalesce(blocked, false)), 1) else 0 end, 6) as present_rate,
 round(sum(coalesce(duration_ms, 0)) / greatest(count(*) filter (not coalesce(blocked, false)), 1), 6) as duration_ms_mean from {SCORED} group by publisher""")
def group_summary(spark, sf_dir):
    """Each source's summary over its scored rows."""
    return rounded(reports.group_summary(scored(spark, sf_dir), ["publisher"], ["authors_f1", "pdf_accuracy"]), ["authors_f1", "pdf_accuracy", "present_rate", "duration_ms_mean"])


SCORE_METRICS = "count(*) as rows, count(authors_f1) as authors_scored_rows, round(coalesce(avg(authors_f1), 0), 6) as authors_f1_strict, round(coalesce(avg(pdf_accuracy), 0), 6) as authors_f1_soft, count(*) filter (error is not null) as errors, round(coalesce(avg(duration_ms), 0), 6) as duration_ms_mean"
SCORE_COLUMNS = ["rows", "authors_scored_rows", "authors_f1_strict", "authors_f1_soft", "errors", "duration_ms_mean"]


def scorecard_rows(spark, sf_dir):
    none = F.lit(None).cast("double")
    rows = scored(spark, sf_dir)
    score = F.when(F.col("authors_f1").isNotNull(), F.struct(F.col("authors_f1").alias("f1"), F.col("pdf_accuracy").alias("f1_soft")))
    modes = F.filter(F.array(F.when(F.col("blocked"), "short"), F.when(F.col("error").isNotNull(), "crash"), F.when(~F.col("present"), "absent")), lambda m: m.isNotNull())
    return rows.select(
        F.col("publisher").alias("publisher_domain"), "duration_ms", "error", modes.alias("failure_modes"), score.alias("authors_score"), F.struct(none.alias("strict_f1"), none.alias("soft_f1"), none.alias("fuzzy_f1")).alias("affiliations_score"),
        F.struct(none.alias("soft_ratio"), none.alias("fuzzy_ratio"), F.lit(False).alias("strict_match"), F.lit(False).alias("present")).alias("abstract_score"), F.struct(F.lit(False).alias("strict_match"), F.lit(False).alias("divergent")).alias("pdf_score"),
    )


@query(f"select coalesce(nullif(publisher, ''), 'unknown') as publisher, {SCORE_METRICS} from {SCORED} group by 1")
def publisher_scorecard(spark, sf_dir):
    """The evaluation's scorecard of each source."""
    return rounded(evaluate.per_publisher(scorecard_rows(spark, sf_dir)).select("publisher", *SCORE_COLUMNS), ["authors_f1_strict", "authors_f1_soft", "duration_ms_mean"])


MODES = "list_filter([case when blocked then 'short' end, case when error is not null then 'crash' end, case when not present then 'absent' end], lambda m: m is not null)"


@query(f"select mode, {SCORE_METRICS} from (select *, unnest(case when len({MODES}) > 0 then {MODES} else ['clean'] end) as mode from {SCORED}) group by mode")
def failure_mode_scorecard(spark, sf_dir):
    """The scorecard of each failure mode; a row counts in each of its modes."""
    return rounded(evaluate.per_failure_mode(scorecard_rows(spark, sf_dir)).select("mode", *SCORE_COLUMNS), ["authors_f1_strict", "authors_f1_soft", "duration_ms_mean"])


@query("select source, count(*) as row_count, count(distinct nullif(lang, '')) as n_prefixes, arg_min(lang, doc_id) as sample_lang, arg_min(n_chars, doc_id) as sample_n_chars from documents group by source")
def publisher_prefixes(spark, sf_dir):
    """Rows, distinct prefixes (languages stand in) and the first row's sample of each source."""
    return reports.publisher_counts(table(spark, sf_dir, "documents"), "source", "lang", "doc_id", ["lang", "n_chars"])


@query("""select 'c_mktsegment' as dimension, c_mktsegment as value, count(*) as n from customer group by c_mktsegment union all select 'c_nationkey', c_nationkey::varchar, count(*) from customer group by c_nationkey""")
def queue_tallies(spark, sf_dir):
    """Tasks counted by each dimension in one pass."""
    return reports.tallies(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("select o_orderpriority, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from orders group by o_orderpriority")
def failure_shares(spark, sf_dir):
    """Each value's share of all rows."""
    return rounded(reports.shares(table(spark, sf_dir, "orders"), "o_orderpriority"), ["share"], 9)


@query("select distinct 'lang' as filter, lang as value from documents where lang is not null union all select distinct 'source', source from documents where source is not null")
def filter_lists(spark, sf_dir):
    """What a report's filters offer."""
    return reports.filter_lists(table(spark, sf_dir, "documents"), ["lang", "source"])


DASH = f"(select doc_id::varchar as doi, publisher as publisher_domain, {MODES} as failure_modes, authors_f1 as authors_f1_soft, coalesce(pdf_accuracy, 0) as abstract_ratio_fuzzy, error from {SCORED})"


@query(f"""select 'authors' as failing, count(*) as n from {DASH} where coalesce(authors_f1_soft, 1) < 0.9 union all select 'abstract', count(*) from {DASH} where abstract_ratio_fuzzy < 0.85
 union all select 'errors', count(*) from {DASH} where error is not null and list_contains(failure_modes, 'short') union all select 'search', count(*) from {DASH} where contains(lower(doi), '7') or contains(lower(publisher_domain), '7')""")
def dashboard_filters(spark, sf_dir):
    """Rows that each of a report's filters leaves."""
    rows = scorecard_rows(spark, sf_dir)
    s = scored(spark, sf_dir)
    modes = F.filter(F.array(F.when(F.col("blocked"), "short"), F.when(F.col("error").isNotNull(), "crash"), F.when(~F.col("present"), "absent")), lambda m: m.isNotNull())
    rows = s.select(F.col("doc_id").cast("string").alias("doi"), F.col("publisher").alias("publisher_domain"), modes.alias("failure_modes"), F.col("authors_f1").alias("authors_f1_soft"), F.coalesce("pdf_accuracy", F.lit(0.0)).alias("abstract_ratio_fuzzy"), F.lit(False).alias("pdf_expected"), F.lit(False).alias("pdf_match"), "error")
    count = lambda name, df: df.agg(F.lit(name).alias("failing"), F.count("*").alias("n"))
    return (
        count("authors", reports.dashboard_rows(rows, failing="authors")).unionAll(count("abstract", reports.dashboard_rows(rows, failing="abstract")))
        .unionAll(count("errors", reports.dashboard_rows(rows, failing="errors", failure="short"))).unionAll(count("search", reports.dashboard_rows(rows, search=" 7 ")))
    )


@query("select source as publisher, count(*) as rows from documents group by source having count(*) >= 2 order by rows desc, publisher limit 18")
def size_heatmap(spark, sf_dir):
    """The eighteen largest sources: a report's head."""
    return reports.heatmap(table(spark, sf_dir, "documents").groupBy(F.col("source").alias("publisher")).agg(F.count("*").alias("rows")))


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 15")
def top_priorities(spark, sf_dir):
    """The fifteen most urgent tasks: a report's head."""
    return reports.page_of(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 0, 15)


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 51 offset 49")
def row_range(spark, sf_dir):
    """Rows 50 to 100 in order, as a batch takes them."""
    return reports.numbered_slice(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "50-100")


@query("select doc_id, case when doc_id <= (select max(doc_id) from (select doc_id from documents order by doc_id limit 50)) then 'train' else 'holdout' end as part from documents")
def half_split(spark, sf_dir):
    """The first fifty rows by number against the rest."""
    return reports.halves(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


CANDIDATES = "(select o_custkey::varchar as doi, o_orderpriority as field, case o_orderstatus when 'O' then 'pending' when 'F' then 'pending_browserbase' else 'accepted' end as status, o_orderkey as pos from orders)"


def order_candidates(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "pending_browserbase").otherwise("accepted")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doi"), F.col("o_orderpriority").alias("field"), status.alias("status"), F.col("o_orderkey").alias("pos"))


@query(f"""select doi, field, status, pos from (select *, row_number() over (partition by doi, field order by pos) as r from {CANDIDATES} where status <> 'accepted') where r = 1
 order by case status when 'pending_browserbase' then 0 else 1 end, field, doi limit 200 offset 20""")
def grounding_queue(spark, sf_dir):
    """A page of the candidates to be grounded, each (doi, field) once."""
    return reports.groundable(order_candidates(spark, sf_dir), "pos", 20, 200)


@query(f"""with tasks as (select c_custkey::varchar as task_id, c_nationkey as size, 'needs_agent' as status, 'diagnose' as next_action from customer),
claims as (select o_custkey::varchar as task_id, arg_max(case o_orderstatus when 'O' then 'in_progress' when 'F' then 'complete' else 'needs_referee' end, o_orderkey) as status, arg_max(o_orderpriority, o_orderkey) as agent from orders group by 1),
old as (select c_custkey::varchar as task_id, case c_mktsegment when 'BUILDING' then 'needs_agent' when 'MACHINERY' then 'blocked_by_gold' else 'reviewed' end as status, case when c_mktsegment <> 'MACHINERY' then 'archive' end as next_action, c_name as agent from customer where c_custkey % 3 <> 0),
m as (select t.*, c.status as cs, c.agent as ca, o.status as os, o.next_action as oa, o.agent as og, coalesce(o.status, '') <> '' and o.status not in ({quoted(rules.GENERIC_STATUSES)}) and not (coalesce(c.status, '') <> '' and c.status not in ({quoted(rules.LOW_DETAIL_STATUSES)})) as kept from tasks t left join claims c using (task_id) left join old o using (task_id))
select task_id, size, case when coalesce(kept, false) then os else coalesce(cs, status) end as status, case when coalesce(kept, false) and oa is not null then oa else next_action end as next_action, case when coalesce(kept, false) then coalesce(ca, og) else ca end as assigned_agent from m""")
def claim_status_merge(spark, sf_dir):
    """Fresh tasks with the latest claims and the stored tasks' own statuses."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    tasks = c.select(F.col("c_custkey").cast("string").alias("task_id"), F.col("c_nationkey").alias("size"), F.lit("needs_agent").alias("status"), F.lit("diagnose").alias("next_action"))
    claims = o.select(F.col("o_custkey").cast("string").alias("task_id"), F.when(F.col("o_orderstatus") == "O", "in_progress").when(F.col("o_orderstatus") == "F", "complete").otherwise("needs_referee").alias("status"), F.col("o_orderpriority").alias("agent_id"), F.col("o_orderkey").alias("pos"))
    segment = F.col("c_mktsegment")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("task_id"), F.when(segment == "BUILDING", "needs_agent").when(segment == "MACHINERY", "blocked_by_gold").otherwise("reviewed").alias("status"), F.when(segment != "MACHINERY", "archive").alias("next_action"), F.col("c_name").alias("assigned_agent"))
    return reports.with_claims(tasks, claims, old)


@query("""select o_orderkey::varchar as doi, c_mktsegment as publisher, n_nationkey as task_id, n_name as task_status from (select o_orderkey, o_custkey from orders) left join (select * from customer where c_custkey % 2 = 0) on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey and n_regionkey = 1""")
def candidate_context(spark, sf_dir):
    """Candidates with their corpus row and the queue's task."""
    c, n = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), table(spark, sf_dir, "nation")
    candidates = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doi"), F.col("o_orderkey").cast("string").alias("order_doi"))
    corpus = c.select(F.col("c_custkey").cast("string").alias("doi"), F.col("c_nationkey").alias("publisher"), "c_mktsegment")
    queue = n.select(F.col("n_nationkey").alias("publisher_id"), F.when(F.col("n_regionkey") == 1, "corresponding").otherwise("authors").alias("field"), F.col("n_nationkey").alias("task_id"), F.col("n_name").alias("status"))
    return reports.candidate_context(candidates, corpus, queue).select(F.col("order_doi").alias("doi"), F.col("c_mktsegment").alias("publisher"), "task_id", "task_status")


@query(f"""with cur as (select distinct lower(c_custkey::varchar) as doi_key, '1-URGENT' as field from customer where c_acctbal > 0 union select distinct c_custkey::varchar, '5-LOW' from customer where c_acctbal < 0),
led as (select *, lower(doi) as doi_key from {CANDIDATES})
select 'current' as part, field, status, count(*) as n from led semi join cur using (doi_key, field) group by field, status union all select 'historical', field, status, count(*) from led anti join cur using (doi_key, field) group by field, status
 union all select 'missing', field, null, count(*) from cur anti join led using (doi_key, field) group by field""")
def backfill_split(spark, sf_dir):
    """Ledger rows that are current, historical, and current keys without a row."""
    c = table(spark, sf_dir, "customer")
    status = F.when(F.col("c_acctbal") != 0, "gold_empty_parser_present").otherwise("empty_empty_pass")
    rows = c.select(F.col("c_custkey").cast("string").alias("doi"), F.when(F.col("c_acctbal") > 0, "1-URGENT").otherwise("5-LOW").alias("field"), status.alias("status"))
    return reports.backfill_split(order_candidates(spark, sf_dir), reports.current_keys(rows))


@query("""with r as (select doc_id::varchar as doi, case when quality = 1 then 0 else 2 end as ga, n_chars % 4 as pa, case when toxic = 1 then 0 else 50 end as gl, n_chars as pl, case when lang = 'de' then 'x' end as gp, case when n_chars % 2 = 0 then source end as pp, lang in ('en', 'fr') as asked, n_chars % 3 = 0 as someone, case when n_chars % 3 = 1 then 'no page' end as blocker from documents left join labels using (doc_id))
select doi, 'authors' as field, pa::varchar as candidate, 'high' as confidence, 'pending' as status, null::varchar as rejection_reason from r where ga = 0 and pa > 0
 union all select doi, 'abstract', pl::varchar, 'medium', 'pending', null from r where gl = 0 and pl > 100 union all select doi, 'pdf_url', pp, 'medium', 'pending', null from r where gp is null and coalesce(pp, '') <> ''
 union all select doi, 'corresponding', case when someone then 'Ann; Ben' else '' end, case when someone then 'candidate' else 'blocked' end, case when someone then 'pending' else 'blocked_candidate_reparse' end, case when not someone then blocker end from r where asked and (someone or blocker is not null)""")
def backfill_proposals(spark, sf_dir):
    """Proposals for fields that gold lacks and the parser has."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    n, names = F.col("n_chars"), F.array(F.lit("Ann"), F.lit("Ben"))
    rows = d.select(
        F.col("doc_id").cast("string").alias("doi"), F.when(F.col("quality") == 1, 0).otherwise(2).alias("gold_n_authors"), (n % 4).alias("parsed_n_authors"), F.when(F.col("toxic") == 1, 0).otherwise(50).alias("gold_abstract_len"), n.alias("parsed_abstract_len"),
        F.when(F.col("lang") == "de", "x").alias("gold_pdf_url"), F.when(n % 2 == 0, F.col("source")).alias("parsed_pdf_url"), F.when(F.col("lang").isin("en", "fr"), "gold_empty_parser_present").alias("corresponding_status"),
        F.when(n % 3 == 0, names).otherwise(F.array().cast("array<string>")).alias("parsed_corresponding"), F.when(n % 3 == 1, "no page").alias("blocker"),
    )
    return reports.proposals(rows)


@query(f"select {DOMAIN} as bucket, count(*) as n_sampled, count(*) filter (contains(coalesce(html, ''), '<article')) as pages_with_article, count(*) filter (contains(coalesce(html, ''), 'class=\"ad\"')) as pages_with_ad, count(*) filter (contains(coalesce(html, ''), '__PRELOADED_STATE__')) as pages_with_state from pages group by 1")
def markup_signals(spark, sf_dir):
    """Pages of each domain that hold certain markup."""
    from ..functions import url

    pages = table(spark, sf_dir, "pages").select(url.publisher_domain(F.col("url")).alias("bucket"), "html")
    return reports.signals_by_bucket(pages, "bucket", "html", {"pages_with_article": "<article", "pages_with_ad": 'class="ad"', "pages_with_state": "__PRELOADED_STATE__"})


@query("select source as publisher_id, lang as field, blocked, backfill, misses, blocked + backfill + misses as open_rows from (select source, lang, count(*) filter (n_chars < 300) as blocked, count(*) filter (n_chars % 5 = 0) as backfill, count(*) filter (n_chars > 3000) as misses from documents group by source, lang)")
def field_urgency(spark, sf_dir):
    """Open rows of each source and language, the most urgent first."""
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("publisher_id"), F.col("lang").alias("field")).agg(F.count_if(n < 300).alias("blocked"), F.count_if(n % 5 == 0).alias("backfill"), F.count_if(n > 3000).alias("misses"))
    return reports.by_urgency(rows)


@query("""with runs as (select user_id, count(*) as total_rows, max(ts) as newest from events group by user_id) select user_id, total_rows, newest::varchar as newest from runs order by total_rows >= 20 desc, newest desc, user_id desc limit 1""")
def latest_full_run(spark, sf_dir):
    """The newest run of full size (twenty rows stand in), else the newest."""
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total_rows"), F.max(F.struct("ts", "user_id")).alias("at"))
    return reports.latest_run(runs, full=20).select("user_id", "total_rows", F.col("at.ts").cast("string").alias("newest"))


@query("""select o_orderkey as gate_id, count(*)::integer as n_failed, string_agg(l_linenumber::varchar, ',' order by l_linenumber) as blockers from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' group by o_orderkey""")
def failed_stages(spark, sf_dir):
    """Gates (orders) with the stages (lines) that failed (were returned)."""
    l = table(spark, sf_dir, "lineitem")
    stage = F.struct(F.col("l_linenumber").cast("string").alias("name"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"), F.col("l_linestatus").alias("detail"))
    gates = l.groupBy(F.col("l_orderkey").alias("gate_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", stage.alias("s")))), lambda x: x["s"]).alias("stages"))  # lines of one order
    return reports.failed_stages(gates).select("gate_id", "n_failed", F.array_join("blockers", ",").alias("blockers"))


@query("""with k as (select o_orderdate::varchar as day, count(*)::double as orders, round(sum(o_totalprice), 2)::double as price from orders group by o_orderdate), l as (select *, row_number() over (order by day desc) as r from k)
select 'orders' as metric, a.orders as value, a.orders - b.orders as change from l a left join l b on b.r = 2 where a.r = 1 union all select 'price', a.price, round(a.price - b.price, 2) from l a left join l b on b.r = 2 where a.r = 1""")
def kpi_milestone(spark, sf_dir):
    """The last day's figures with the change against the day before."""
    k = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("string").alias("at")).agg(F.count("*").cast("double").alias("orders"), F.round(F.sum("o_totalprice").cast("double"), 2).alias("price"))
    return reports.milestone(k, "at", ["orders", "price"]).withColumn("change", F.round("change", 2))


@query("select doc_id::varchar as doi, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def gold_bootstrap(spark, sf_dir):
    """Configured documents that the labels don't have yet."""
    config = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doi"), "source")
    return reports.bootstrap(config, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doi")))


@query("""with g as (select distinct s.source, f.lang from (select distinct source from documents) s, (select distinct lang from documents) f)
select source as publisher_id, lang as field, case when source not in (select source from documents where n_chars > 2000 and source is not null) then 'unknown' when source not in (select source from documents join labels using (doc_id) where source is not null) then 'no-gold' end as problem,
 case when source in (select source from documents join labels using (doc_id) where source is not null) then 0.5 else 1.0 end as tolerance_pp from g where source is not null""")
def sprint_plan(spark, sf_dir):
    """A planning grid checked against known publishers and those with gold."""
    d = table(spark, sf_dir, "documents")
    sources = d.select(F.col("source").alias("publisher_id")).where("publisher_id is not null").distinct()
    grid = sources.join(F.broadcast(d.select(F.col("lang").alias("field")).distinct()), how="cross")  # languages are a handful
    known = d.where("n_chars > 2000").select(F.col("source").alias("publisher_id"))
    gold = d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(F.col("source").alias("publisher_id"))
    return reports.planned(grid, known, gold)


@query("""select event_id, strftime(ts, '%Y%m%dT%H%M%SZ') as compact_id, case when event_id % 10 > 0 then round(60.0 / (event_id % 10) * greatest(8 - event_id % 10, 0), 6) end as eta from events""")
def event_ids(spark, sf_dir):
    """Times as compact ids, and what is left of a job at its pace."""
    e = table(spark, sf_dir, "events")
    done = F.col("event_id") % 10
    return e.select("event_id", reports.compact_time(F.col("ts")).alias("compact_id"), F.round(reports.remaining_seconds(done, F.lit(8), F.lit(60.0)), 6).alias("eta"))


NORMAL_TEXT = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"""select doc_id, case when t is null then null when t = '' then 'abstract_empty_candidate' when t = 'this article has no abstract' then 'abstract_placeholder_no_abstract' when contains(t, 'click to increase image size') or contains(t, 'click to decrease image size') then 'abstract_ui_chrome'
 when regexp_matches(t, '^''.{{1,240}}'' published in ''.{{1,240}}''$') then 'abstract_title_published_in_metadata' when contains(t, 'download references') or contains(t, 'google scholar') then 'abstract_references_not_abstract'
 when regexp_matches(t, '\\b(po box|tel:|fax:|email:|website:|contact:)\\b') then 'abstract_contact_directory' when starts_with(t, 'this document is part of subvolume') then 'abstract_volume_metadata' when length(t) < 100 and contains(t, ';') and not contains(t, '.') then 'abstract_synonyms_not_abstract' end as reason
 from (select doc_id, {NORMAL_TEXT} as t from documents)""")
def abstract_blockers(spark, sf_dir):
    """Why a document is no abstract."""
    return table(spark, sf_dir, "documents").select("doc_id", grounding.abstract_blocker(F.col("text")).alias("reason"))


@query("""select page_id, (page_id % 5 <> 0) and regexp_matches(lower(coalesce(url, '')), '^https?://') and not regexp_matches(lower(coalesce(url, '')), 'error|denied|captcha|login|signin') and regexp_matches(lower(coalesce(url, '')), '/pdf|pdfft|\\.pdf') as usable from pages""")
def pdf_resolutions(spark, sf_dir):
    """Which resolved addresses can be a PDF's."""
    status = F.when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    return table(spark, sf_dir, "pages").select("page_id", grounding.pdf_resolution_usable(status, F.col("url")).alias("usable"))


@query("""with p as (select p_partkey, list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 2) as w from part)
select a.p_partkey, round(case when len(a.w) > 0 and len(coalesce(b.w, [])) > 0 then len(list_filter(b.w, lambda x: list_contains(a.w, x))) / len(b.w) else 0 end, 6) as overlap,
 case when len(a.w) = 0 and len(coalesce(b.w, [])) = 0 then 'both_empty' when len(coalesce(b.w, [])) = 0 then 'parser_miss' when len(a.w) = 0 then 'gold_missing_parser_has' when len(list_filter(b.w, lambda x: list_contains(a.w, x))) = 0 then 'disjoint_names_gold_likely_wrong'
 when len(list_filter(b.w, lambda x: list_contains(a.w, x))) / len(b.w) >= 0.5 then 'names_overlap_format_diff' else 'partial_overlap_unclear' end as verdict from p a left join p b on b.p_partkey = a.p_partkey + 1""")
def surname_overlaps(spark, sf_dir):
    """The names of a part against those of the next, with the verdict on gold."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.filter(F.split("p_name", " "), lambda w: F.length(w) > 2).alias("gold"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("gold").alias("parsed"))
    rows = p.join(nxt, "p_partkey", "left").withColumn("parsed", F.coalesce("parsed", F.array().cast("array<string>")))
    return rows.select("p_partkey", F.round(grounding.surname_overlap(F.col("gold"), F.col("parsed")), 6).alias("overlap"), grounding.gold_verdict(F.col("gold"), F.col("parsed")).alias("verdict"))


@query("""with s as (select s_suppkey, s_name, list_filter(regexp_extract_all(lower(s_name), '[a-z]+'), lambda x: x <> '') as w, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') as k from supplier)
select a.s_suppkey, b.s_suppkey as other, (a.k <> '' and a.k = b.k) or (a.w[-1] is not distinct from b.w[-1] and a.w[1][1:1] is not distinct from b.w[1][1:1]) as same from s a join s b on b.s_suppkey = a.s_suppkey + 1""")
def person_matches(spark, sf_dir):
    """Whether neighbouring suppliers' names are one person's."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    nxt = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("other"), F.col("s_name").alias("o_name"))
    return s.join(nxt, "s_suppkey").select("s_suppkey", "other", grounding.same_person(F.col("s_name"), F.col("o_name")).alias("same"))


JOINED = "case when doc is null then 'insufficient_private_context' when n_chars < 300 then 'retrieval_owned' when lang in ('en', 'de') or coalesce(quality, 0) >= 0.98 then 'already_fixed_by_current_parser' when lang = 'fr' then 'still_parser_owned' when lang = 'es' then 'gold_or_ticket_disagreement' else 'insufficient_private_context' end"


@query(f"""select page_id as ticket, {JOINED} as joined from (select p.page_id, d.doc_id as doc, d.n_chars, d.lang, l.quality from pages p left join documents d on d.doc_id = p.page_id * 2 left join labels l on l.doc_id = d.doc_id)""")
def ticket_classes(spark, sf_dir):
    """Tickets (pages) against their corpus rows (documents)."""
    p, d, l = (table(spark, sf_dir, t) for t in ("pages", "documents", "labels"))
    rows = p.select(F.col("page_id").alias("ticket")).join(d.select((F.col("doc_id") / 2).alias("ticket"), "n_chars", "lang", "doc_id"), "ticket", "left").join(l.select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("lang").isin("en", "de"), "gold_present_parser_present").when(F.col("lang") == "fr", "gold_present_parser_empty").when(F.col("lang") == "es", "gold_empty_parser_present").otherwise("unknown")
    return rows.select("ticket", grounding.joined_class(F.col("doc_id").isNotNull(), status, F.col("n_chars") < 300, F.col("quality").cast("double")).alias("joined"))


@query("select source, doc_id, blocked from (select *, row_number() over (partition by blocked order by doc_id) as n from (select source, min(doc_id) as doc_id, arg_min(n_chars < 600, doc_id) as blocked from documents group by source)) where n <= case when blocked then 1 else 9 end")
def seed_pick(spark, sf_dir):
    """A seed of nine readable rows and a blocked one, each of another source."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") < 600).alias("blocked"))
    return reports.diverse_seed(rows, "source", "doc_id", "blocked")


@query("select doc_id, source as publisher, n_chars > 500 as cached from documents where n_chars > 500 and source in (select distinct source from documents where lang = 'en' order by source limit 3) order by doc_id limit 100")
def corpus_scan(spark, sf_dir):
    """The first hundred readable rows of three publishers, as an evaluation takes them."""
    d = table(spark, sf_dir, "documents")
    three = [r[0] for r in d.where("lang = 'en'").select("source").distinct().orderBy("source").limit(3).collect()]
    rows = d.select("doc_id", F.col("source").alias("publisher"), (F.col("n_chars") > 500).alias("cached"))
    return reports.scan(rows, "doc_id", three, "cached", 100)


@query("""select event_id, props from events where event_id % 3 <> 0 and event_id % 4 <> 0""")
def main_events(spark, sf_dir):
    """Events without row-level progress."""
    e = table(spark, sf_dir, "events").withColumn("action", F.when(F.col("event_id") % 3 == 0, rules.PROGRESS_ACTIONS[0]).when(F.col("event_id") % 4 == 0, rules.PROGRESS_ACTIONS[1]).otherwise("claim"))
    return reports.main_events(e).select("event_id", "props")


@query("select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3")
def queue_slice(spark, sf_dir):
    """Tasks of one type and publisher."""
    tasks = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("queue_type"), F.lit("authors").alias("field"), F.col("c_nationkey").alias("publisher_id"))
    return reports.of_queue(tasks, queue_type="BUILDING", publisher=3).select("c_custkey")


@query(f"""with r as (select {DOMAIN} as publisher, {REASON} as reason from pages),
c as (select 'group' as level, publisher, reason, count(*) as n from r group by all union all select 'all', null, reason, count(*) from r group by reason)
select level, publisher, sum(n)::bigint as total_rows, coalesce(sum(n) filter (reason is null), 0)::bigint as html_available, coalesce(sum(n) filter (reason is not null), 0)::bigint as retrieval_blocked,
 coalesce(string_agg(reason || '=' || n, ';' order by reason) filter (reason is not null), '') as by_reason from c group by level, publisher""")
def coverage_reasons(spark, sf_dir):
    """Pages that can be scored, and why the others can't, by domain and altogether."""
    from ..functions import html, url

    pages = table(spark, sf_dir, "pages").select(url.publisher_domain(F.col("url")).alias("publisher"), html.block_reason(F.col("html")).alias("reason"))
    return reports.coverage(pages, "publisher", "reason")


@query("""with r as (select source as publisher, lang as marker_type, doc_id, row_number() over (partition by source, lang order by doc_id) as place, count(*) over (partition by source, lang) as n from documents join labels using (doc_id) where quality = 0)
select publisher, marker_type, any_value(n) as doc_count, string_agg(doc_id, ',' order by doc_id) filter (place <= 5) as examples from r where n >= 3 group by all""")
def repeated_patterns(spark, sf_dir):
    """Patterns (source and language) that three bad documents or more share, with five of them."""
    bad = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id").select("doc_id", F.col("source").alias("publisher"), F.col("lang").alias("marker_type"))
    found = reports.repeated_patterns(bad, ["publisher", "marker_type"], "doc_id")
    return found.select("publisher", "marker_type", F.col("n").alias("doc_count"), F.array_join("examples", ",").alias("examples"))


@query("""with roles(place, event_type) as (values (0, 'view'), (1, 'error'), (2, 'scribe'), (3, 'purchase')),
e as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as own, row_number() over (order by ts desc, event_id desc) as overall from events)
select 'latest' as part, r.place as "at", r.event_type, e.event_id, e.user_id from roles r left join e on e.event_type = r.event_type and e.own = 1
union all select 'recent', (overall - 1)::int, event_type, event_id, user_id from e where overall <= 10""")
def role_heads(spark, sf_dir):
    """The latest event of each of four roles (event types, one of which has none), and the last ten of all."""
    return reports.console(table(spark, sf_dir, "events"), ["view", "error", "scribe", "purchase"], "event_type", ["ts", "event_id"], ["event_id", "user_id"])
