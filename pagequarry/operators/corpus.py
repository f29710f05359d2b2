"""Corpus analytics: publisher lookup, retrieval audit, field status, ranking, work queue, claims, gates, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions import html as H
from ..functions import text as X
from ..functions import url as U

#: Groups (publishers, sites) up to which an order over all of them is taken in one task; each is one aggregated row.
FIELDS = ["authors", "affiliations", "abstract", "pdf_url", "corresponding"]


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() if v is not None for x in (k, v)])


def publisher_of(doi: Column, url: Column, registrant: Column | None = None) -> Column:
    """By DOI prefix, else host (as it is, without ``www.``, or a parent domain), else registrant name, else ``unknown``."""
    by_prefix = F.try_element_at(literal_map(rules.PREFIX_PUBLISHER), U.doi_prefix(doi))
    host = U.publisher_domain(url)
    exact = F.try_element_at(literal_map(rules.DOMAIN_PUBLISHER), host)
    routers = [k for k, v in rules.DOMAIN_PUBLISHER.items() if v is None]
    parents = F.array(*[F.struct(F.lit("." + d).alias("d"), F.lit(p).alias("p")) for d, p in rules.DOMAIN_PUBLISHER.items() if p])
    parent = F.try_element_at(F.filter(parents, lambda x: host.endswith(x["d"])), F.lit(1))["p"]
    name = F.lower(X.text_of(registrant)) if registrant is not None else F.lit("")
    named = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(p).alias("p")) for s, p in rules.REGISTRANT_PUBLISHER])
    by_name = F.try_element_at(F.filter(named, lambda x: name.contains(x["s"])), F.lit(1))["p"]
    return F.coalesce(by_prefix, exact, F.when(~host.isin(routers), parent), by_name, F.lit("unknown"))


def retrieval_audit(pages: DataFrame, group: Column, html: Column) -> DataFrame:
    """Pages of each group by retrieval state, and the share that can be read."""
    states = ["cached_ok", "cached_bot_check", "cached_router_only", "cached_tiny", "missing"]
    counted = pages.select(group.alias("publisher"), H.retrieval_state(html).alias("state")).groupBy("publisher").pivot("state", states).count()
    counts = [F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in states]
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in states[1:]), F.coalesce(F.col(states[0]), F.lit(0)))
    return counted.select("publisher", *counts, F.bround(F.coalesce(F.col("cached_ok"), F.lit(0)) / total, 4).alias("coverage"))


def field_status(gold: Column, parsed: Column) -> Column:
    """Which of the two has a value."""
    g, p = F.coalesce(gold, F.lit("")) != "", F.coalesce(parsed, F.lit("")) != ""
    return F.when(g & p, "both_present").when(g, "gold_present_parser_empty").when(p, "gold_empty_parser_present").otherwise("empty_empty_pass")


def status_accounting(rows: DataFrame, group: str, field: str, status: str) -> DataFrame:
    """Status counts of each field, for each group and for all (``group`` null), in one pass of grouping sets."""
    counted = [F.count_if(F.col(status) == s).alias(s) for s in ("both_present", "gold_present_parser_empty", "gold_empty_parser_present", "empty_empty_pass")]
    return rows.groupingSets([[F.col(field)], [F.col(group), F.col(field)]], F.col(group), F.col(field)).agg(F.count("*").alias("total_rows"), *counted)


def parser_status(publisher: Column, supported: Column) -> Column:
    """(status, tractability) of a publisher."""
    return F.when(publisher == "unknown", F.struct(F.lit("unsupported-no-parser").alias("status"), F.lit(0.0).alias("tractability"))).when(supported, F.struct(F.lit("supported").alias("status"), F.lit(1.0).alias("tractability"))).otherwise(F.struct(F.lit("generic-only").alias("status"), F.lit(0.5).alias("tractability")))


def ranked(groups: DataFrame) -> DataFrame:
    """Groups (publisher, row_count, current_f1, tractability) with priority and the coverage up to each, most urgent first.

    One row for each group reaches the single ordered window: aggregated rows, as many as there are publishers.
    """
    priority = F.bround((1 - F.coalesce(F.col("current_f1"), F.lit(0.5))) * F.col("row_count") * F.col("tractability"), 4)
    order = Window.orderBy(F.desc("priority"), "publisher").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return groups.withColumn("priority", priority).withColumn("cumulative_coverage", F.bround(F.sum("row_count").over(order) / F.sum("row_count").over(whole), 4))


def queue_type(publisher_class: Column, backfill: Column, html_available: Column, blocked: Column, scored: Column, kpi: Column) -> Column:
    """(queue_type, status, next_action) of a publisher's field, by the first fitting of seven cases."""
    out = lambda a, b, c: F.struct((F.lit(a) if isinstance(a, str) else a).alias("queue_type"), (F.lit(b) if isinstance(b, str) else b).alias("status"), F.lit(c).alias("next_action"))
    return (
        F.when((backfill > 0) & ((kpi >= rules.TARGET) | (backfill >= F.greatest(F.lit(2), F.floor(scored / 3)))), out("goldie-backfilled", "goldie_backfill_pending", "browserbase-ground"))
        .when(publisher_class == "unknown", out("unknown", "publisher_unknown", "classify-publisher"))
        .when((html_available == 0) & (blocked > 0), out("harvest-blocked", "retrieval_blocked", "retrieve-html"))
        .when(publisher_class == "unsupported", out("unsupported", "unsupported", "add-parser-or-block"))
        .when(publisher_class.isin("generic_only", "onboarding"), out("onboarding", publisher_class, "onboard-or-baseline"))
        .when(kpi >= rules.TARGET, out("ready", "above_98", "monitor"))
        .otherwise(out("ready", "needs_agent", "diagnose"))
    )


def queue_priority(kpi: Column, total: Column, tractability: Column, html_available: Column, backfill: Column) -> Column:
    coverage = html_available / F.greatest(total, F.lit(1))
    return F.bround(F.greatest(F.lit(0.0), F.lit(rules.TARGET) - kpi) * total * F.greatest(tractability, F.lit(0.05)) * F.greatest(coverage, F.lit(0.05)) + F.coalesce(backfill, F.lit(0)) * 0.75, 4)


def task_id(publisher: Column, field: Column, total: Column) -> Column:
    return F.concat_ws("_", F.lit("v2"), publisher, field, F.substring(F.sha1(F.concat_ws("|", publisher, field, total.cast("string"))), 1, 8))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key, as a partial aggregate: no key is gathered in one task's list."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def claimable() -> Column:
    """Whether a task's status lets it be claimed."""
    status, backfill = F.coalesce(F.col("status"), F.lit("")), F.coalesce(F.col("gold_empty_parser_present").try_cast("int"), F.lit(0))
    reopened = status.startswith("goldie_backfill_") & F.greatest(*[status.endswith(e) for e in rules.REOPENING_ENDS])
    return status.isin(rules.CLAIMABLE) | ((F.col("queue_type") == "goldie-backfilled") & (backfill > 0) & (reopened | status.isin(rules.REOPENING)))


def claim(tasks: DataFrame, claims: DataFrame, n: int, agent: str, run_id: str) -> DataFrame:
    """The next ``n`` claims: claimable tasks without an active latest claim, in queue order (``pos``)."""
    active = latest(claims.select("task_id", "status", "pos"), "task_id", [F.col("pos")]).where(F.col("status").isin(rules.ACTIVE_CLAIMS))
    free = tasks.join(active, "task_id", "left_anti").where(claimable()).orderBy("pos").limit(n)
    return free.select(F.lit(run_id).alias("run_id"), "task_id", "publisher_id", "field", "queue_type", F.lit(agent).alias("agent_id"), F.current_timestamp().alias("claimed_at"), F.lit("in_progress").alias("status"))


def new_candidates(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates whose (lower-cased doi, field) the ledger hasn't; of repeated ones the first by ``proposed_at``."""
    key = found.withColumn("__k", F.lower("doi")).groupBy("__k", "field").agg(F.min_by(F.struct(*found.columns), "proposed_at").alias("r"))
    known = ledger.select(F.lower("doi").alias("__k"), "field").distinct()
    return key.join(known, ["__k", "field"], "left_anti").select("r.*")


def gate(before: DataFrame, after: DataFrame, tolerance_pp: float = 1.0) -> DataFrame:
    """Metrics (metric, value) before and after: delta and whether it falls by more than the tolerance. Metrics that are missing on a side are left out."""
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric").where("before is not null and after is not null and not isnan(before) and not isnan(after)")
    return both.withColumn("delta", F.bround(F.col("after") - F.col("before"), 4)).withColumn("regressed", F.col("delta") < -tolerance_pp / 100)


def crashes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Error counts of two runs: failed if there are more than before."""
    n = lambda d, name: d.agg(F.count_if(F.coalesce("error", F.lit("")) != "").alias(name))
    return n(before, "errors_before").crossJoin(F.broadcast(n(after, "errors_after"))).withColumn("failed", F.col("errors_after") > F.col("errors_before"))


def prefer_then_latest(rows: DataFrame, key: str, asset: Column, created: str) -> DataFrame:
    """For each key the record to use: any that isn't an asset before those that are, then the latest created."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct((~asset).alias("a"), F.col(created))).alias("r")).select(key, "r.*")


def sample_by_bucket(rows: DataFrame, bucket: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows of each bucket by the smallest hash of seed and key: a sampling operator, the same rows on every run."""
    order = Window.partitionBy(bucket).orderBy(F.sha1(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def grounded(value: Column, page: Column, n: int = 12, share: float = 0.6, least: int = 3) -> Column:
    """How a gold text stands on a page: exact, ngram (some ``n`` consecutive words), tokens (``share`` of at least ``least`` words) or null."""
    v, p = X.normalize_alpha(value), X.normalize_alpha(page)
    words = F.filter(F.split(v, " "), lambda w: w != "")
    runs = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    met = F.size(F.array_intersect(words, F.split(p, " "))) / F.greatest(F.size(F.array_distinct(words)), F.lit(1))
    return F.when((v != "") & p.contains(v), "exact").when(F.exists(runs, lambda r: p.contains(r)), "ngram").when((F.size(words) >= least) & (met >= share), "tokens")


def repair_prefix(gold: Column, parsed: Column) -> Column:
    """What to do with a gold abstract that may be the start of the parsed one: the outcome's name."""
    g, p = X.normalize_text(gold), X.normalize_text(parsed)
    head = F.substring(g, 1, 100)
    return (
        F.when(g == "", "gold_empty").when(p == "", "parsed_empty").when(F.length(g) < 100, "gold_short").when(g.endswith("...") | g.endswith("…"), "gold_ellipsis")
        .when(F.length(p) < F.length(g) * 1.5, "parsed_not_longer").when(~F.substring(p, 1, 120).contains(head), "no_prefix").otherwise("replace")
    )


def repair_ellipsis(gold: Column, parsed: Column) -> Column:
    """The parsed abstract where the gold one is cut off by an ellipsis and shorter, else the gold one."""
    cut = F.rtrim(gold).endswith("...") | F.rtrim(gold).endswith("…")
    return F.when(cut & (F.length(parsed) > F.length(gold)), parsed).otherwise(gold)


def null_tagged(corpus: DataFrame, tagged: DataFrame, key: str = "doi", column: str = "authors") -> DataFrame:
    """``corpus`` with ``column`` set to 'N/A' where the key is tagged, and ``outcome``: nulled, already_null or kept."""
    marks = tagged.select(F.lower(key).alias("__k")).distinct().withColumn("__t", F.lit(True))
    rows = corpus.withColumn("__k", F.lower(key)).join(marks, "__k", "left")
    empty = F.upper(F.trim(F.coalesce(column, F.lit("")))).isin("", "N/A", "NULL", "NONE")
    return rows.withColumn("outcome", F.when(F.col("__t") & empty, "already_null").when(F.col("__t"), "nulled").otherwise("kept")).withColumn(column, F.when(F.col("__t") & ~empty, F.lit("N/A")).otherwise(F.col(column))).drop("__k", "__t")


def batch_class(rows: Column, errors: Column, worst: Column) -> Column:
    """smoke for fewer than 20 rows, failed beyond nine tenths of errors, weak with a metric under 0.80, else ok."""
    return F.when(rows < 20, "smoke").when(errors / rows > 0.9, "failed").when(worst < 0.80, "weak").otherwise("ok")


def normal_role(name: Column, role: Column, names: dict[str, str]) -> Column:
    """A public role: the given one if it is one, else the agent's, else Scribe."""
    return F.coalesce(F.when(role.isin(rules.ROLES), role), F.try_element_at(literal_map(names), name) if names else F.lit(None).cast("string"), F.lit("Scribe"))


def grid(spark: SparkSession, publishers: list[str], fields: list[str] = FIELDS) -> DataFrame:
    """The planning grid: each publisher with each field, from two short lists."""
    schema = T.StructType([T.StructField("publisher_id", T.StringType())])
    rows = spark.createDataFrame([(p,) for p in publishers], schema)
    return rows.withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))


def run_deltas(runs: DataFrame, metric: str, order: str) -> DataFrame:
    """Each run's change against the run before, in percentage points; one row for each run."""
    return runs.withColumn("delta_pp", F.bround((F.col(metric) - F.lag(metric).over(Window.orderBy(order))) * 100, 2))


def latency(rows: DataFrame, group: str, value: str) -> DataFrame:
    """min, median, mean, p95 and max of each group; p95 is the element at floor(0.95 n) - 1 of the sorted values.

    Exact ranks come from counts of equal values, so that a large group meets as counts; then a window over its distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col(value)))
    p95 = F.greatest(F.floor(F.col("n") * 0.95).cast("long") - 1, F.lit(0))
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    return placed.groupBy(group).agg(F.max("n").alias("n"), F.min(value).alias("min"), middle.alias("median"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("avg"), at(p95).alias("p95"), F.max(value).alias("max"))
