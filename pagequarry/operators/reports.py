"""Reports over corpora, queues, runs and ledgers: group summaries, tallies, shares, heads, splits and the joins behind them.

All are aggregates, joins or heads of ordered tables; a limit stands only where a report shows the first rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from .corpus import latest


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def scan(corpus: DataFrame, order: str, publishers: list[str] | None = None, cached: str | None = None, limit: int | None = None) -> DataFrame:
    """The corpus rows to evaluate: of some publishers, with a cached page where ``cached`` names that flag, the first ``limit`` by ``order``."""
    rows = corpus.where(F.col("publisher").isin(publishers)) if publishers else corpus
    rows = rows.where(F.col(cached)) if cached else rows
    return rows.orderBy(order).limit(limit) if limit else rows


def diverse_seed(rows: DataFrame, prefix: str, order: str, blocked: str, clean: int = 9, walls: int = 1) -> DataFrame:
    """A small seed from different sources: the first row of each prefix by ``order``, of those the first ``clean`` that can be read and the first ``walls`` blocked ones."""
    rest = [c for c in rows.columns if c != prefix]
    firsts = rows.groupBy(prefix).agg(F.min_by(F.struct(*rest), order).alias("r")).select(prefix, "r.*").select(*rows.columns)
    of = lambda flag, n: firsts.where(F.coalesce(F.col(blocked), F.lit(False)) == flag).orderBy(order).limit(n)
    return of(False, clean).unionAll(of(True, walls))


def group_summary(rows: DataFrame, keys: list[str], metrics: list[str], error: str = "error", blocked: str = "blocked", present: str = "present", duration: str = "duration_ms") -> DataFrame:
    """For each group: rows, those scored (with a page), errors among these, skipped ones; each metric's mean (0 where it has no value) and count; rates and mean duration over the scored rows, one at least."""
    skipped = F.coalesce(F.col(blocked), F.lit(False))
    scored = F.count_if(~skipped)
    over = lambda n: n / F.greatest(scored, F.lit(1))
    means = [c for m in metrics for c in (F.coalesce(F.avg(m), F.lit(0.0)).alias(m), F.count(m).alias(f"n_{m}"))]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), scored.alias("scored"), F.count_if(~skipped & (text(error) != "")).alias("errors"), F.count_if(skipped).alias("skipped_no_html"), *means,
        F.when(scored > 0, over(F.count_if(F.col(present)))).otherwise(0.0).alias("present_rate"), over(F.sum(F.coalesce(F.col(duration), F.lit(0.0)))).alias("duration_ms_mean"),
    )


def publisher_counts(corpus: DataFrame, publisher: str, prefix: str, order: str, samples: list[str]) -> DataFrame:
    """For each publisher its rows, distinct prefixes and the sample columns of its first row."""
    firsts = F.min_by(F.struct(*samples), order)
    return corpus.groupBy(publisher).agg(F.count("*").alias("row_count"), F.count_distinct(F.nullif(prefix, F.lit(""))).alias("n_prefixes"), firsts.alias("s")).select(publisher, "row_count", "n_prefixes", *[F.col(f"s.{c}").alias(f"sample_{c}") for c in samples])


def tallies(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts by each of the dimensions, as (dimension, value, n): one pass of grouping sets."""
    which = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dimensions])
    return rows.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(which.alias("dimension"), value.alias("value"), F.count("*").alias("n")).select("dimension", "value", "n")


def shares(rows: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, and its share of all; the window is over one row for each value."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def filter_lists(rows: DataFrame, columns: list[str]) -> DataFrame:
    """What a report's filters offer: the distinct values of some columns, arrays element by element, as (filter, value) in order."""
    parts = []
    for c in columns:
        values = F.explode(c) if rows.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
        parts.append(rows.select(F.lit(c).alias("filter"), values.alias("value")).where("value is not null").distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.orderBy("filter", "value")


def dashboard_rows(rows: DataFrame, publisher: str | None = None, failure: str | None = None, failing: str | None = None, search: str = "") -> DataFrame:
    """Scored rows by a report's filters: publisher, a failure mode, a failing field (authors under 0.9, abstract under 0.85, a missed PDF link, errors), words of DOI or publisher."""
    fails = {
        "authors": F.coalesce(F.col("authors_f1_soft"), F.lit(1.0)) < 0.9, "abstract": F.col("abstract_ratio_fuzzy") < 0.85,
        "pdf": F.col("pdf_expected") & ~F.col("pdf_match"), "errors": text("error") != "",
    }
    q = search.strip().lower()
    keep = F.lit(True)
    if publisher:
        keep = keep & (F.col("publisher_domain") == publisher)
    if failure:
        keep = keep & F.array_contains("failure_modes", failure)
    if failing:
        keep = keep & fails[failing]
    if q:
        keep = keep & (F.lower("doi").contains(q) | F.lower("publisher_domain").contains(q))
    return rows.where(keep)


def heatmap(groups: DataFrame, size: str = "rows", key: str = "publisher", least: int = 2, most: int = 18) -> DataFrame:
    """The largest groups, a report's head: those of ``least`` rows or more."""
    return groups.where(F.col(size) >= least).orderBy(F.desc(size), key).limit(most)


def page_of(rows: DataFrame, order: list, skip: int, limit: int | None) -> DataFrame:
    """A page of an ordered table."""
    ordered = rows.orderBy(*order).offset(skip)
    return ordered.limit(limit) if limit else ordered


def numbered_slice(rows: DataFrame, order: str, text_range: str) -> DataFrame:
    """Rows by a range such as ``1-100`` of their numbers in order."""
    low, high = (int(x) for x in text_range.split("-"))
    return page_of(rows, [order], low - 1, high - low + 1)


def halves(rows: DataFrame, order: str, n: int = 50, names: tuple[str, str] = ("train", "holdout")) -> DataFrame:
    """``rows`` with ``part``: the first ``n`` by ``order`` and the rest. Only the n-th value reaches one task, no order over all rows is taken."""
    cut = rows.select(order).orderBy(order).limit(n).agg(F.max(order).alias("__cut"))
    return rows.join(F.broadcast(cut), how="cross").withColumn("part", F.when(F.col(order) <= F.col("__cut"), names[0]).otherwise(names[1])).drop("__cut")


def of_queue(tasks: DataFrame, queue_type: str | None = None, field: str | None = None, publisher: str | None = None) -> DataFrame:
    """Tasks by type, field and publisher, where given."""
    for column, wanted in (("queue_type", queue_type), ("field", field), ("publisher_id", publisher)):
        tasks = tasks.where(F.col(column) == wanted) if wanted else tasks
    return tasks


def main_events(events: DataFrame) -> DataFrame:
    """Events for the main report: without the row-level progress of long jobs."""
    return events.where(~text("action").isin(rules.PROGRESS_ACTIONS))


def with_claims(tasks: DataFrame, claims: DataFrame, existing: DataFrame, pos: str = "pos") -> DataFrame:
    """Freshly built tasks with what is known of them: the latest claim's status, unless that says little and the stored task has a status of its own, which then stays with its next action and agent."""
    claim = latest(claims.select("task_id", F.col("status").alias("claim_status"), F.col("agent_id").alias("claim_agent"), pos), "task_id", [F.col(pos)]).drop(pos)
    old = existing.select("task_id", F.col("status").alias("old_status"), F.col("next_action").alias("old_action"), F.col("assigned_agent").alias("old_agent"))
    rows = tasks.join(claim, "task_id", "left").join(old, "task_id", "left")
    telling = (text("claim_status") != "") & ~text("claim_status").isin(rules.LOW_DETAIL_STATUSES)
    kept = (text("old_status") != "") & ~text("old_status").isin(rules.GENERIC_STATUSES) & ~telling
    return rows.select(
        "task_id", *[c for c in tasks.columns if c not in ("task_id", "status", "next_action")],
        F.when(kept, F.col("old_status")).otherwise(F.coalesce(F.nullif("claim_status", F.lit("")), F.col("status"))).alias("status"),
        F.when(kept & (text("old_action") != ""), F.col("old_action")).otherwise(F.col("next_action")).alias("next_action"),
        F.when(kept, F.coalesce(F.nullif("claim_agent", F.lit("")), F.col("old_agent"))).otherwise(F.col("claim_agent")).alias("assigned_agent"),
    )


def candidate_context(candidates: DataFrame, corpus: DataFrame, queue: DataFrame, field: str = "corresponding") -> DataFrame:
    """Candidate DOIs with their corpus row and the queue's task of the row's publisher for ``field``; null where there is none."""
    rows = corpus.withColumn("__k", F.lower("doi")).drop("doi")
    tasks = queue.where(F.col("field") == field).select(F.col("publisher_id").alias("publisher"), F.col("task_id"), F.col("status").alias("task_status"))
    return candidates.withColumn("__k", F.lower("doi")).join(rows, "__k", "left").drop("__k").join(tasks, "publisher", "left")


def current_keys(rows: DataFrame) -> DataFrame:
    """The (lower-cased doi, field) of rows where the parser has a value and the gold table none."""
    return rows.where(F.col("status") == "gold_empty_parser_present").select(F.lower("doi").alias("doi_key"), "field").distinct()


def backfill_split(ledger: DataFrame, current: DataFrame) -> DataFrame:
    """Ledger rows against the current keys, counted as (part, field, status, n): current, historical, and keys that the ledger lacks (status null)."""
    rows = ledger.withColumn("doi_key", F.lower(text("doi")))
    counted = lambda df, part: df.groupBy("field", F.col("status")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "field", "status", "n")
    now = rows.join(current, ["doi_key", "field"], "left_semi")
    old = rows.join(current, ["doi_key", "field"], "left_anti")
    missing = current.join(rows.select("doi_key", "field"), ["doi_key", "field"], "left_anti").withColumn("status", F.lit(None).cast("string"))
    return counted(now, "current").unionAll(counted(old, "historical")).unionAll(counted(missing, "missing"))


def proposals(rows: DataFrame) -> DataFrame:
    """Backfill proposals of run rows, one for each field that gold lacks and the parser has: (doi, field, candidate, confidence, status, rejection_reason).

    Authors by their number, abstracts of over 100 characters, PDF links, corresponding authors where the branch says so:
    without names these are blocked by the reason that came with them.
    """
    row = lambda field, candidate, confidence, status=None, reason=None: F.struct(F.lit(field).alias("field"), candidate.cast("string").alias("candidate"), confidence.alias("confidence"), (status if status is not None else F.lit("pending")).alias("status"), (reason if reason is not None else F.lit(None).cast("string")).alias("rejection_reason"))
    some = F.size(F.coalesce("parsed_corresponding", F.array().cast("array<string>"))) > 0
    asked = F.col("corresponding_status") == "gold_empty_parser_present"
    found = F.array(
        F.when((F.col("gold_n_authors") == 0) & (F.col("parsed_n_authors") > 0), row("authors", F.col("parsed_n_authors"), F.lit("high"))),
        F.when((F.col("gold_abstract_len") == 0) & (F.col("parsed_abstract_len") > 100), row("abstract", F.col("parsed_abstract_len"), F.lit("medium"))),
        F.when((text("gold_pdf_url") == "") & (text("parsed_pdf_url") != ""), row("pdf_url", F.col("parsed_pdf_url"), F.lit("medium"))),
        F.when(asked & (some | (text("blocker") != "")), row("corresponding", F.array_join("parsed_corresponding", "; "), F.when(some, "candidate").otherwise("blocked"), F.when(some, "pending").otherwise("blocked_candidate_reparse"), F.when(~some, F.col("blocker")))),
    )
    return rows.select("doi", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p")).select("doi", "p.*")


def groundable(candidates: DataFrame, order: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Candidates to be grounded: the first open one of each (doi, field) by ``order``, those that wait for a page first; a page of them."""
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(rules.GROUNDING_STATUSES)])
    open_rows = candidates.where(F.col("status").isin(rules.GROUNDING_STATUSES) & (text("doi") != "") & (text("field") != ""))
    rest = [c for c in candidates.columns if c not in ("doi", "field")]
    firsts = open_rows.groupBy("doi", "field").agg(F.min_by(F.struct(*rest), order).alias("r")).select("doi", "field", "r.*").select(*candidates.columns)
    return page_of(firsts, [rank, "field", "doi"], skip, limit)


def signals_by_bucket(pages: DataFrame, bucket: str, html: str, signals: dict[str, str]) -> DataFrame:
    """Pages of each bucket, and how many hold each signal (name to needle)."""
    return pages.groupBy(bucket).agg(F.count("*").alias("n_sampled"), *[F.count_if(text(html).contains(needle)).alias(name) for name, needle in signals.items()])


def by_urgency(rows: DataFrame) -> DataFrame:
    """A publisher and field table, what has most blocked, backfill and missed rows first."""
    return rows.withColumn("open_rows", F.coalesce("blocked", F.lit(0)) + F.coalesce("backfill", F.lit(0)) + F.coalesce("misses", F.lit(0))).orderBy(F.desc("open_rows"), "publisher_id", "field")


def latest_run(runs: DataFrame, total: str = "total_rows", at: str = "at", full: int = 10_000) -> DataFrame:
    """The run to report on: the newest of full size, else the newest; one row."""
    rest = F.struct(*runs.columns)
    return runs.agg(F.max_by(rest, F.struct((F.col(total) >= full).alias("f"), F.col(at))).alias("r")).where("r is not null").select("r.*")


def failed_stages(gates: DataFrame) -> DataFrame:
    """Gate records (gate_id, stages of (name, status, detail)) as blockers: one row for each gate that failed somewhere, with those stages only."""
    failed = F.filter("stages", lambda s: s["status"] == "failed")
    return gates.select("gate_id", failed.alias("failed")).where(F.size("failed") > 0).select("gate_id", F.size("failed").alias("n_failed"), F.transform("failed", lambda s: s["name"]).alias("blockers"))


def milestone(kpis: DataFrame, at: str, metrics: list[str]) -> DataFrame:
    """The last row of a KPI table with its change against the row before, as (metric, value, change); the change is null for the first."""
    last = kpis.orderBy(F.desc(at)).limit(2).select(at, *metrics)
    both = last.agg(F.array_sort(F.collect_list(F.struct(at, *metrics))).alias("r")).where("size(r) > 0")  # two rows at most
    now, before = F.element_at("r", -1), F.try_element_at("r", F.lit(-2))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), now[m].cast("double").alias("value"), (now[m].cast("double") - before[m].cast("double")).alias("change")) for m in metrics])
    return both.select(F.explode(rows).alias("m")).select("m.*")


def bootstrap(config: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold rows to be set up: those of the configuration that aren't there yet; what is there is never written over."""
    return config.join(gold.select(F.lower("doi").alias("__k")).distinct(), F.lower("doi") == F.col("__k"), "left_anti")


def planned(grid: DataFrame, known: DataFrame, gold: DataFrame) -> DataFrame:
    """A planning grid (publisher_id, field) with what stands against each publisher (unknown, no-gold or null) and the tolerance in percentage points: half a point where there is gold, else a whole one."""
    has = lambda df, name: df.select(F.col("publisher_id"), F.lit(True).alias(name)).distinct()
    rows = grid.join(has(known, "__known"), "publisher_id", "left").join(has(gold, "__gold"), "publisher_id", "left")
    problem = F.when(F.col("__known").isNull(), "unknown").when(F.col("__gold").isNull(), "no-gold")
    return rows.select("publisher_id", "field", problem.alias("problem"), F.when(F.col("__gold").isNotNull(), 0.5).otherwise(1.0).alias("tolerance_pp"))


def compact_time(at: Column) -> Column:
    """A time as a compact id such as ``20240131T235959Z``."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """What is left at the pace so far; null before the first row."""
    return F.when(done > 0, elapsed / done * F.greatest(total - done, F.lit(0)))


def coverage(rows: DataFrame, group: str, reason: str) -> DataFrame:
    """How much of each group, and of all (``level`` all), can be scored: (``level``, ``group``, total_rows, html_available, retrieval_blocked, by_reason).

    ``reason`` says why a row can't be, null for one that can; ``by_reason`` has ``reason=rows`` in order of the reasons. Rows are
    counted by group and reason before anything is listed, so a list is as long as there are reasons.
    """
    counts = rows.groupingSets([[F.col(group), F.col(reason)], [F.col(reason)]], F.col(group), F.col(reason)).agg(F.count("*").alias("n"), F.grouping(group).alias("whole"))
    blocked = F.col(reason).isNotNull()
    named = F.array_sort(F.collect_list(F.when(blocked, F.struct(F.col(reason).alias("r"), F.col("n").alias("n")))))
    told = F.array_join(F.transform(named, lambda x: F.concat_ws("=", x["r"], x["n"])), ";")
    number = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("long"))
    sums = counts.groupBy("whole", group).agg(F.sum("n").alias("total_rows"), number(~blocked).alias("html_available"), number(blocked).alias("retrieval_blocked"), told.alias("by_reason"))
    return sums.select(F.when(F.col("whole") == 1, "all").otherwise("group").alias("level"), group, "total_rows", "html_available", "retrieval_blocked", "by_reason")


def repeated_patterns(rows: DataFrame, keys: list[str], id_col: str, least: int = 3, examples: int = 5) -> DataFrame:
    """What comes up ``least`` times or more: (keys, n, examples), the examples being the ``examples`` least ids, repeated ones included.

    Null keys are a pattern, too. Examples are ranked with a limit that Spark applies before it shuffles, so a hot pattern sends a few rows from each partition.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(id_col).asc_nulls_last()))
    some = rows.select(*keys, id_col).withColumn("__at", first).where(F.col("__at") <= examples)
    listed = some.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", id_col))), lambda x: x[id_col]).alias("examples"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    return counts.alias("c").join(listed.alias("l"), same).select(*[f"c.{k}" for k in keys], "c.n", "l.examples")


def console(events: DataFrame, roles: list[str], role: str, order: list[str], shown: list[str], n: int = 10) -> DataFrame:
    """The head of an event log: (part, at, ``role``, ``shown``): for each of ``roles`` its latest event (``latest``, nulls for a role without one), and the last ``n`` of all (``recent``, newest first by ``at``).

    ``order`` columns tell later events from earlier ones. The latest is an aggregate, the last ``n`` a top-k: nothing is sorted as a whole.
    """
    own = events.select(role, *order, *[c for c in shown if c not in order])
    heads = own.groupBy(role).agg(F.max_by(F.struct(*shown), F.struct(*order)).alias("e"))
    known = events.sparkSession.createDataFrame([(i, r) for i, r in enumerate(roles)], f"at int, `{role}` string")
    latest = known.join(heads, role, "left").select(F.lit("latest").alias("part"), "at", role, *[F.col("e")[c].alias(c) for c in shown])
    last = own.orderBy(*[F.desc(c) for c in order]).limit(n)
    recent = last.withColumn("at", F.row_number().over(Window.orderBy(*[F.desc(c) for c in order])) - 1)  # n rows
    return latest.unionByName(recent.select(F.lit("recent").alias("part"), "at", role, *shown))
