"""Readers and writers. Schemas are declared; malformed lines are dropped or flagged, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AUTHOR_IN = "array<struct<name:string,affiliations:string,rasses:string,address:string,is_corresponding:string,corresponding_author:string>>"
AUTHORS = "array<struct<name:string,affiliations:array<string>,is_corresponding:boolean>>"
EVENT = (
    "run_id string, report_id string, timestamp string, agent_name string, agent_role string, publisher string, field string, stage string, action string, status string, "
    "progress_current long, progress_total long, duration_ms long, artifact_path string, commit_sha string, kpi_before double, kpi_after double, notes string"
)
CLAIM = "run_id string, task_id string, publisher_id string, field string, queue_type string, agent_id string, claimed_at string, status string"
TASK = "task_id string, publisher_id string, field string, queue_type string, status string, priority double, row_count long, gold_empty_parser_present long, next_action string"
CANDIDATE = (
    "doi string, publisher string, field string, gold_value string, candidate_value string, confidence string, evidence_excerpt string, rendered_url string, rendered_session string, "
    "approving_agent string, status string, rejection_reason string, proposed_at string, source_run string"
)
RUN = "doi string, parsed struct<authors:array<struct<name:string,affiliations:array<struct<name:string>>,is_corresponding:boolean>>,urls:array<struct<url:string,content_type:string>>,license:string,version:string,abstract:string>, error string, duration_ms double, html_cached boolean, publisher_domain string"
KPI = "timestamp string, run_id string, rows long, authors double, affiliations double, abstract double, pdf_url double"


def page_store(spark: SparkSession, path: str) -> DataFrame:
    """A folder of cached pages, one file each, named by the SHA-1 of the lower-cased DOI: (key, is_pdf, html). The first bytes decide on PDFs; bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").load(path)
    key = F.regexp_extract("path", r"([0-9a-f]{40})", 1)
    pdf = F.substring(F.col("content"), 1, 5) == F.lit(b"%PDF-")
    return files.select(key.alias("key"), pdf.alias("is_pdf"), F.when(~pdf, F.make_valid_utf8(F.col("content").cast("string"))).alias("html"))


def cache_key(doi: Column) -> Column:
    return F.sha1(F.lower(doi).cast("binary"))


def yes_no(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "yes", "1"), True).when(t.isin("false", "no", "0"), False)


def gold_authors(raw: Column) -> Column:
    """(authors, quality) of a JSON text with several spellings of keys: ok, journal-title-leaked for bare text, broken-json for a list that can't be read."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    na = F.upper(F.regexp_replace(t, "`", "")).isin("", "N/A", "NA", "NONE", "NULL")
    read = F.from_json(t, AUTHOR_IN, {"mode": "PERMISSIVE"})
    broken = t.startswith("[") & (F.try_parse_json(t).isNull() | read.isNull())
    listed = lambda s: F.when(s.startswith("["), F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))).when(F.trim(s) != "", F.transform(F.split(s, ";"), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    affs = lambda a: F.coalesce(a["affiliations"], a["rasses"], a["address"], F.lit(""))
    authors = F.transform(read, lambda a: F.struct(F.trim(F.coalesce(a["name"], F.lit(""))).alias("name"), F.filter(listed(affs(a)), lambda x: x != "").alias("affiliations"), yes_no(F.coalesce(a["is_corresponding"], a["corresponding_author"])).alias("is_corresponding")))
    none = F.array().cast(AUTHORS)
    quality = F.when(na, "ok").when(broken, "broken-json").when(~t.startswith("["), "journal-title-leaked").otherwise("ok")
    return F.struct(F.when(quality == "ok", F.coalesce(F.when(~na, authors), none)).otherwise(none).alias("authors"), quality.alias("quality"))


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """The hand-made gold table: rows with a number, authors read from JSON, notes turned to failure modes."""
    from ..functions.text import failure_modes, three_valued
    from ..functions.url import normalize_doi

    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    rows = raw.where(F.trim(F.coalesce(F.col("No"), F.lit(""))) != "").withColumn("a", gold_authors(F.col("Authors")))
    na = lambda c: F.when(~F.upper(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "`", ""))).isin("", "N/A", "NA"), F.col(c))
    return rows.select(
        F.col("No").try_cast("int").alias("no"), normalize_doi(F.col("DOI")).alias("doi"), F.col("Link").alias("link"), F.col("a.authors").alias("authors"), na("Abstract").alias("abstract"), na("PDF URL").alias("pdf_url"),
        F.coalesce(three_valued(F.col("Status")), F.lit(False)).alias("status"), F.coalesce("Notes", F.lit("")).alias("notes"), three_valued(F.col("Has Bot Check")).alias("has_bot_check"), three_valued(F.col("Resolves To PDF")).alias("resolves_to_pdf"),
        F.col("a.quality").alias("gold_quality"), (F.col("a.quality") == "ok").alias("score_authors"), failure_modes(F.col("Notes")).alias("failure_modes"),
    )


def gold_ndjson(rows: DataFrame, path: str, prefix: str) -> None:
    """One publisher's gold rows (by DOI prefix), the first of each DOI, as JSON lines."""
    own = rows.where(F.col("doi").startswith(prefix + "/"))
    first = own.groupBy("doi").agg(F.min_by(F.struct(*[c for c in own.columns if c != "doi"]), "no").alias("annotation"))
    first.select("doi", F.lit("human-goldie").alias("source"), F.lit(None).cast("string").alias("captured_at"), "annotation").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def renamed(schema: str, names: dict[str, str]) -> str:
    """``schema`` for files that call some columns otherwise: ``names`` maps a column's name here to that in the files."""
    out = StructType.fromDDL(schema)
    return ", ".join(f"`{names.get(f.name, f.name)}` {f.dataType.simpleString()}" for f in out.fields)


def candidates(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """A ledger of candidates from JSON lines, whose files may call columns otherwise."""
    names = names or {}
    return ndjson(spark, path, renamed(CANDIDATE, names)).withColumnsRenamed({v: k for k, v in names.items()})


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def kpi_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KPI).option("mode", "DROPMALFORMED").csv(path, header=True).fillna(0)


def write_run(scored: DataFrame, path: str, run_id: str, label: str) -> None:
    """A run's rows under its own partition; a repeated run replaces its own rows only."""
    scored.withColumns({"run_id": F.lit(run_id), "label": F.lit(label)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def run_index(spark: SparkSession, path: str) -> DataFrame:
    """The runs, newest first, with their scorecards."""
    from ..operators.evaluate import metrics

    return spark.read.parquet(path).groupBy("run_id", "label").agg(*metrics()).orderBy(F.desc("run_id"))


def with_metadata(pages: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Pages with their records' resolved_url and namespace; null where there is none."""
    return pages.join(records.select(key, "resolved_url", "namespace"), key, "left")


def tail(events: DataFrame, run_id: str | None, n: int) -> DataFrame:
    """The last ``n`` events, of one run if given."""
    rows = events.where(F.col("run_id") == run_id) if run_id else events
    return rows.orderBy(F.desc("timestamp")).limit(n)
