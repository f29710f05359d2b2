"""The engine's queries over the driver's tables, each with the SQL that gives the same rows where SQL can.

Every query runs over its whole tables. Limits stand only where they are the feature: the fifty links of a page that
``link_pdf_first`` ranks, the sample of a bucket, the head of a queue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import fuzzy, html, text, url
from ..operators import corpus, dom, evaluate, extract, families, openaccess

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that checks it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
DOMAIN = f"regexp_replace({HOST}, '^www\\.', '')"
BARE, TEXT_ONLY = "regexp_replace(html, '^\\s+|\\s+$', '', 'g')", "trim(regexp_replace(regexp_replace(lower(regexp_replace(html, '^\\s+|\\s+$', '', 'g')), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
REASON = f"""case when html is null then 'missing'
 when starts_with({BARE}, '%PDF-') then 'cached_pdf'
 when contains(lower({BARE}), '<title>just a moment') or contains(substr(lower({BARE}), 1, 5000), '>just a moment...') or contains(lower({BARE}), '<title>error - cookies turned off') or contains({TEXT_ONLY}, 'cookies turned off')
  or contains(lower({BARE}), 'checking your browser') or contains(lower({BARE}), 'cf-browser-verification') or contains(lower({BARE}), 'cf-chl') or contains({TEXT_ONLY}, 'help us confirm that you are not a robot')
  or (contains(lower({BARE}), 'akamai') and (contains({TEXT_ONLY}, 'powered and protected by') or contains(lower({BARE}), 'bm-verify='))) or contains({TEXT_ONLY}, 'shieldsquare captcha') or contains({TEXT_ONLY}, 'radware bot manager captcha')
  or contains(lower({BARE}), 'captcha.perfdrive.com') or (length({BARE}) < 3000 and contains(lower({BARE}), 'document.cookie') and contains(lower({BARE}), 'document.location.reload')) then 'cached_bot_check'
 when {TEXT_ONLY} in ('loading...', 'loading ...', 'loading') or (contains(lower({BARE}), 'enable javascript') and length({BARE}) < 5000) then 'js_rendered_required'
 when contains(lower({BARE}), '<title>doi.org') or contains(lower({BARE}), 'the doi system') then 'cached_router_only'
 when contains(lower({BARE}), '<title>cybercrime') or contains(lower({BARE}), '<title>cyber crime') then 'cached_error_page'
 when length({BARE}) < 512 then 'cached_too_small' end"""
ANY_BOT, ANY_ROUTER = ("|".join(f"(?:{p})" for p in ps).replace("'", "''") for ps in (rules.BOT_PATTERNS, rules.ROUTER_PATTERNS))
STATE = f"""case when html is null then 'missing' when regexp_matches(substr(html, 1, {rules.HEAD_BYTES}), '(?i){ANY_BOT}') then 'cached_bot_check'
 when regexp_matches(substr(html, 1, {rules.HEAD_BYTES}), '(?i){ANY_ROUTER}') then 'cached_router_only' when octet_length(encode(html)) < {rules.MIN_PAGE_BYTES} then 'cached_tiny' else 'cached_ok' end"""
TITLE = SQUEEZE.format("replace(replace(replace(replace(replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', chr(34)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")
FOLD = f"replace(translate({{}}, '{text.ACCENTED}', '{text.PLAIN}'), 'ß', 'ss')"
NORMAL = SQUEEZE.format(FOLD.format("lower(coalesce({}, ''))"))
LICENSE_T = "lower(replace(replace(coalesce(text, ''), ' ', ''), '-', ''))"
LICENSE = "case " + " ".join(f"when contains({LICENSE_T}, '{p}') then " + (f"(case when not contains({LICENSE_T}, '{rules.NOT_PUBLIC_DOMAIN}') then '{n}' end)" if n == "public-domain" else f"'{n}'") for p, n in rules.LICENSES + rules.DATASET_LICENSES) + " end"


@query(f"""select {DOMAIN} as domain, count(*) as pages, count(*) filter ({REASON} is not null) as blocked, count(*) filter ({TITLE} <> '') as titled, sum(length(html)) as chars from pages group by 1""")
def page_domain_scorecard(spark, sf_dir):
    """Pages of each domain, blocked ones, those with a title, and characters."""
    h = F.col("html")
    rows = table(spark, sf_dir, "pages").select(url.publisher_domain(F.col("url")).alias("domain"), html.block_reason(h).alias("reason"), html.title(h).alias("title"), F.length(h).alias("n"))
    return rows.groupBy("domain").agg(F.count("*").alias("pages"), F.count("reason").alias("blocked"), F.count_if(F.col("title") != "").alias("titled"), F.sum("n").alias("chars"))


@query(f"""with p as (select page_id, trim(url) as url, list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' and regexp_extract(x, '^([^=]*)', 1) not in ({quoted(rules.TRACKING_PARAMS)})) as kept,
 regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/+$', '') as path from pages)
select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {DOMAIN} || case when path = '' then '/' else path end
 || case when len(kept) = 0 then '' else '?' || array_to_string(list_transform(kept, lambda x: case when contains(x, '=') then x else x || '=' end), '&') end as canonical from p""")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.canonical_url(F.col("url")).alias("canonical"))


@query(f"select page_id, coalesce({REASON}, 'ok') as reason from pages")
def html_block_reason(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(html.block_reason(F.col("html")), F.lit("ok")).alias("reason"))


@query(f"""with s as (select {DOMAIN} as publisher, {STATE} as state from pages)
select publisher, count(*) filter (state = 'cached_ok') as cached_ok, count(*) filter (state = 'cached_bot_check') as cached_bot_check, count(*) filter (state = 'cached_router_only') as cached_router_only, count(*) filter (state = 'cached_tiny') as cached_tiny,
 count(*) filter (state = 'missing') as missing, round_even(count(*) filter (state = 'cached_ok') / count(*), 4) as coverage from s group by 1""")
def retrieval_audit_pivot(spark, sf_dir):
    return corpus.retrieval_audit(table(spark, sf_dir, "pages"), url.publisher_domain(F.col("url")), F.col("html"))


@query(f"""select page_id, {TITLE} as title, ({TITLE} = '' or contains({TITLE}, 'Redirecting') or contains({TITLE}, 'Just a moment') or contains({TITLE}, 'Login |')) as bad from pages""")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.bad_landing(F.col("html")).alias("bad"))


ANCHOR_SQL = """with a as (select page_id, url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)(<a\\b[^>]*>.*?</a\\s*>)', 1)) as a, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?is)(<a\\b[^>]*>.*?</a\\s*>)', 1), 1) - 1 as pos from pages),
l as (select page_id, url, pos, nullif(regexp_extract(a, '(?is)\\shref\\s*=\\s*"([^"]*)"', 1), '') as href, lower(trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) as anchor from a)"""
PDF_SHAPED = "(contains(lower(coalesce(href, '')), '/pdf') or contains(lower(coalesce(href, '')), '/epdf') or contains(lower(coalesce(href, '')), 'pdfft') or contains(lower(coalesce(href, '')), '.pdf') or contains(lower(coalesce(href, '')), 'downloadpdf'))"
BAD_ANCHOR = "list_bool_or(list_transform([" + quoted([w.lower() for w in rules.BAD_ANCHOR_WORDS]) + "], lambda w: contains(anchor, w)))"
BAD_HREF = "(list_bool_or(list_transform([" + quoted([w.lower() for w in rules.BAD_HREF_WORDS]) + "], lambda w: contains(lower(href), w))) or regexp_matches(lower(href), 'jmir_v[a-z0-9]+_app\\d+\\.pdf')) and not list_bool_or(list_transform([" + quoted([w.lower() for w in rules.GOOD_HREF_WORDS]) + "], lambda w: contains(lower(href), w)))"


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.explode(html.anchors(F.col("html"))).alias("a")).select("page_id", "url", F.col("a.pos").cast("long").alias("pos"), F.nullif(F.col("a.href"), F.lit("")).alias("href"), "a.anchor")


@query(f"{ANCHOR_SQL} select page_id, pos, href, anchor, {PDF_SHAPED} as pdf_shaped, coalesce({BAD_ANCHOR}, false) as bad_anchor, coalesce({BAD_HREF}, false) as bad_href from l")
def page_links(spark, sf_dir):
    """Every anchor with the tests on its shape."""
    return page_anchors(spark, sf_dir).select("page_id", "pos", "href", "anchor", url.looks_like_pdf(F.col("href")).alias("pdf_shaped"), url.bad_anchor(F.col("anchor")).alias("bad_anchor"), url.bad_href(F.col("href")).alias("bad_href"))


@query(f"{ANCHOR_SQL} select page_id, href, rank from (select page_id, href, row_number() over (partition by page_id order by {PDF_SHAPED} desc, pos) as rank from l where href is not null) where rank <= {extract.CAP}")
def link_pdf_first(spark, sf_dir):
    """The links that the ranking looks at: PDF-shaped ones first, at most fifty of a page."""
    order = Window.partitionBy("page_id").orderBy(F.desc(url.looks_like_pdf(F.col("href"))), "pos")
    return page_anchors(spark, sf_dir).where("href is not null").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= extract.CAP).select("page_id", "href", "rank")


@query(ANCHOR_SQL + """, b as (select *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as origin, regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*)', 1), '(://[^/]+)$', '\\1/') as folder from l where href is not null)
select page_id, pos, case when not regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') and regexp_matches(target, '^[^:]*://[^/?#]*[^?#]*/\\.\\.?(/|$|[?#])')
 then regexp_extract(target, '^([^:]*://[^/?#]*)', 1) || array_to_string(list_reduce(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract(target, '^[^:]*://[^/?#]*([^?#]*)', 1), '/\\.\\.$', '/../'), '/\\.$', '/./'), '/'), lambda x: [x]),
 lambda kept, part: case when part[1] = '.' then kept when part[1] = '..' then kept[1:greatest(len(kept) - 1, 1)] else list_concat(kept, part) end), '/') || regexp_extract(target, '^[^?#]*([?#].*)?$', 1) else target end as target from (
select page_id, pos, href, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '//') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href when starts_with(href, '/') then origin || href
 when starts_with(href, '?') then regexp_extract(url, '^([^?#]*)', 1) || href when starts_with(href, '#') then regexp_extract(url, '^([^#]*)', 1) || href else regexp_replace(folder, '[^/]*$', '') || href end as target from b)""")
def url_join_resolve(spark, sf_dir):
    return page_anchors(spark, sf_dir).where("href is not null").select("page_id", "pos", url.resolve(F.col("url"), F.col("href")).alias("target"))


@query(f"select doc_id, {LICENSE} as license from documents")
def license_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.license_of(F.col("text"), dataset=True).alias("license"))


REDACTED = SQUEEZE.format(f"regexp_replace(regexp_replace(coalesce(text, ''), '{rules.EMAIL_PATTERN}', '[email]', 'g'), '{rules.PHONE_PATTERN}', '[phone]', 'g')")


@query(f"select doc_id, case when length({REDACTED}) > 500 then rtrim(substr({REDACTED}, 1, 497)) || '...' else {REDACTED} end as redacted from documents")
def redact_pii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


SECRETS = "array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(coalesce(text, ''), '(?i){p}') then '{n}' end" for n, p in rules.SECRET_PATTERNS) + "], lambda x: x is not null), ',')"


@query(f"select conv_id, turn, {SECRETS} as violations from conversations")
def secret_scan(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.secrets(F.col("text")), ",").alias("violations"))


@query(f"select doc_id, len(regexp_extract_all(coalesce(text, ''), '({rules.DOI_PATTERN})', 1)) as n_dois from documents")
def doi_extract(spark, sf_dir):
    found = F.regexp_extract_all(text.text_of(F.col("text")), F.lit(f"({rules.DOI_PATTERN})"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_dois"))


@query(f"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({FOLD.format("lower(coalesce(text, ''))")}, '<\\w+.*?>', '', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\b(a|an|the)\\b', '', 'g'), '\\band\\b', '', 'g'), '\\s+', '', 'g')) as key from documents""")
def text_normalize_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_key(F.col("text")).cast("binary")).alias("key"))


@query("select doc_id, length(text) > 200 and not regexp_matches(rtrim(text), '(\\.\\.\\.|…)$') and not starts_with(text, 'http') as passes from documents")
def abstract_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.abstract_gate(F.col("text")).isNotNull().alias("passes"))


MODES = "list_filter([" + ", ".join(f"case when regexp_matches(coalesce(text, ''), '(?i){p}') then '{n}' end" for n, p in rules.FAILURE_MODES) + "], lambda x: x is not null)"


@query(f"""with m as (select source, {MODES} as modes from documents), e as (select source, unnest(case when len(modes) > 0 then modes else ['clean'] end) as mode from m) select mode, count(*) as docs, count(distinct source) as sources from e group by 1""")
def failure_modes_explode(spark, sf_dir):
    """Documents of each failure mode, each counted in all of its modes."""
    found = text.failure_modes(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("source", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("clean")))).alias("mode"))
    return rows.groupBy("mode").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"))


#: Rows of runs, of 24 bytes each, up to which a side is sent to every executor.
MOST_BROADCAST = 1_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast join if it has at most ``MOST_BROADCAST`` rows of fixed width; otherwise it is shuffled."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def runs_of_words(words: pa.ListArray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, g1, g2): 128-bit keys of the runs of ``n`` words of each row; of a shorter text none, or (``short``) one of all its words.

    A run's key sums its words' hashes, each times a power of an odd number by its place, and its length: a few additions over all words at once.
    """
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    coded = words.flatten().dictionary_encode()
    code, distinct = coded.indices.to_numpy(zero_copy_only=False), np.array(coded.dictionary.to_pylist(), object)
    runs = np.where(size >= n, size - n + 1, ((size > 0) & short).astype(np.int64))
    row = np.repeat(np.arange(len(size)), runs)
    first = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    length = np.minimum(size, n)[row]
    keys = []
    for seed, base in ((b"the first hashes", 0x9E3779B97F4A7C15), (b"the second ones.", 0xC2B2AE3D27D4EB4F)):
        hashes = np.concatenate([pd.util.hash_array(distinct, hash_key=seed.decode())[code] if len(code) else np.zeros(0, np.uint64), np.zeros(n, np.uint64)])
        key, power = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1
        for i in range(n):
            power = power * base % 2**64
            key += np.where(i < length, hashes[first + i], np.uint64(0)) * np.uint64(power)
        keys.append(key.view(np.int64))
    return row, *keys


#: What stays of a text's bytes for its plain words; all else is a space.
PLAIN = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for b in range(256))


def split_plain(texts: pa.Array) -> pa.ListArray:
    """Words of letters a to z, digits and underscores; null for none."""
    return pc.ascii_split_whitespace(pa.array([t.encode().translate(PLAIN).decode().strip() or None for t in texts.to_pylist()], pa.string()))


def with_runs(df: DataFrame, key: str, words: F.Column, n: int, short: bool, most: int = 500_000) -> DataFrame:
    """(key, g1, g2): the runs of each row's words (an array, or a text for ``split_plain``), one after the other, from some ``most`` words at a time, or one text."""
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = split_plain(batch.column(1)) if pa.types.is_string(batch.schema.types[1]) or pa.types.is_large_string(batch.schema.types[1]) else batch.column(1)
            upto = np.cumsum(pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False))
            cuts = np.nonzero(np.diff(upto // most, prepend=0))[0].tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                row, g1, g2 = runs_of_words(given.slice(a, b - a), n, short)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(g1), pa.array(g2)], names=[key, "g1", "g2"])

    return df.select(key, words.alias("words")).mapInArrow(work, f"`{key}` {kind}, g1 bigint, g2 bigint")


def shared_runs(docs: DataFrame, items: DataFrame, key: str, item: str, words: F.Column, n: int, short: bool = False) -> DataFrame:
    """(key, item, g): the runs of ``n`` words that a document and an item share, once for each place in the document."""
    b = with_runs(items, item, words, n, short).distinct()
    d = with_runs(docs, key, words, n, short)
    return d.join(broadcast_if_small(b), ["g1", "g2"]).select(key, item, F.struct("g1", "g2").alias("g"))


BARE_WORDS = r"[^\x20\x09-\x0D]+"
FIVE = f"(select {{id}}, text, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w] else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as g from (select {{id}}, text, regexp_extract_all(coalesce(text, ''), '{BARE_WORDS}') as w from {{table}}))"


@query(f"""with p as (select distinct d.doc_id, b.item_id, d.text as p, b.text as q from {FIVE.format(id="doc_id", table="documents")} d join {FIVE.format(id="item_id", table="benchmark")} b using (g))
select doc_id, item_id, round(1 - levenshtein(p, q) / greatest(strlen(p), strlen(q)), 6) as ratio from p""")
def near_dup_ratio(spark, sf_dir):
    """Edit ratio, over the bytes of whole texts, of documents and benchmark items that share a run of five words.

    Words are what stands between spaces; a text of fewer than five is one run, one of none meets nothing. Equal rows count once.
    """
    d, b = (table(spark, sf_dir, name).select(F.col(i), F.col("text").alias(c), F.xxhash64("text").alias(f"{c}h")) for name, i, c in (("documents", "doc_id", "p"), ("benchmark", "item_id", "q")))
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(BARE_WORDS), F.lit(0))
    keys = lambda df, c: df.select(F.struct(*[n for n in df.columns if n != c]).alias(f"{c}k"), F.col(c).alias("text"))
    met = shared_runs(keys(d, "p"), keys(b, "q"), "pk", "qk", words, 5, short=True).select("pk.doc_id", "pk.ph", "qk.item_id", "qk.qh").distinct().alias("x")
    with_docs = met.join(d.distinct().alias("d"), F.expr("x.ph = d.ph and x.doc_id <=> d.doc_id")).select("x.doc_id", "x.item_id", "x.qh", "p").alias("y")
    pairs = with_docs.join(b.distinct().alias("b"), F.expr("y.qh = b.qh and y.item_id <=> b.item_id")).select("y.doc_id", "y.item_id", "p", "q")
    one_char = lambda c: F.decode(F.encode(F.col(c), "UTF-8"), "ISO-8859-1")  # noqa: E731  a byte becomes a character
    return pairs.select("doc_id", "item_id", F.round(fuzzy.levenshtein_ratio(one_char("p"), one_char("q")), 6).alias("ratio"))


GRAMS = "list_transform(range(1, greatest(len(w) - 11, 0) + 1), lambda i: md5(array_to_string(w[i:i + 11], ' ')))"
WORDS_SQL = f"list_filter(string_split(trim(regexp_replace({NORMAL.format('text')}, '[^a-z0-9_ ]+', ' ', 'g')), ' '), lambda x: x <> '')"


def folded(column: str) -> F.Column:
    """Lower case, accents folded; '' for null."""
    low = F.lower(text.text_of(F.col(column)))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(text.fold_latin(low))  # ASCII has nothing to fold


@query(f"""with b as (select item_id, unnest({GRAMS}) as g from (select item_id, {WORDS_SQL} as w from benchmark)), d as (select doc_id, unnest({GRAMS}) as g from (select doc_id, {WORDS_SQL} as w from documents))
select d.doc_id, b.item_id, count(distinct d.g) as shared from d join b using (g) group by 1, 2""")
def ngram_grounding(spark, sf_dir):
    """Benchmark items found in documents by shared runs of twelve words."""
    met = shared_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", folded("text"), 12)
    return met.groupBy("doc_id", "item_id").agg(F.countDistinct("g").alias("shared"))


STATUS = "case when {g} <> '' and {p} <> '' then 'both_present' when {g} <> '' then 'gold_present_parser_empty' when {p} <> '' then 'gold_empty_parser_present' else 'empty_empty_pass' end"
FIELD_ROWS = f"""r as (select source, unnest(['quality', 'toxic', 'license']) as field, unnest([case when l.quality = 1 then 'y' else '' end, case when l.toxic = 1 then 'y' else '' end, case when contains(lower(text), 'licen') then 'y' else '' end]) as gold,
 unnest([case when length(text) > 1000 then 'y' else '' end, case when contains(text, '!') then 'y' else '' end, coalesce({LICENSE}, '')]) as parsed from documents d left join labels l using (doc_id)), s as (select source, field, {STATUS.format(g='gold', p='parsed')} as status from r)"""


def field_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, field, status) for three fields that have a gold side (labels, phrases) and a derived one."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    yes = lambda c: F.when(c, "y").otherwise("")
    sides = {"quality": (yes(F.col("quality") == 1), yes(F.length("text") > 1000)), "toxic": (yes(F.col("toxic") == 1), yes(F.col("text").contains("!"))), "license": (yes(F.lower("text").contains("licen")), F.coalesce(text.license_of(F.col("text"), dataset=True), F.lit("")))}
    fields = F.array(*[F.struct(F.lit(n).alias("field"), corpus.field_status(g, p).alias("status")) for n, (g, p) in sides.items()])
    return rows.select("source", F.explode(fields).alias("f")).select("source", "f.*")


@query(f"""with {FIELD_ROWS} select source, field, count(*) as total_rows, count(*) filter (status = 'both_present') as both_present, count(*) filter (status = 'gold_present_parser_empty') as gold_present_parser_empty,
 count(*) filter (status = 'gold_empty_parser_present') as gold_empty_parser_present, count(*) filter (status = 'empty_empty_pass') as empty_empty_pass from s group by grouping sets ((field), (source, field))""")
def status_branch_accounting(spark, sf_dir):
    return corpus.status_accounting(field_rows(spark, sf_dir), "source", "field", "status")


@query("""with r as (select source, toxic, case when length(text) < 1500 then 1 else 0 end as hit from documents join labels using (doc_id)),
g as (select source, count(*) filter (toxic = 1 and hit = 1) as tp, count(*) filter (toxic = 0 and hit = 1) as fp, count(*) filter (toxic = 1 and hit = 0) as fn from r group by 1),
f as (select *, case when tp + fp + fn = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end as f1 from g)
select count(*) as groups, round(coalesce(avg(f1), 0.0), 6) as macro_f1, round(case when sum(tp) + sum(fp) + sum(fn) = 0 then 0.0 else 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) end, 6) as micro_f1 from f""")
def micro_macro_f1(spark, sf_dir):
    """F1 of a length rule against the toxic labels: mean over sources, and of the summed counts."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", (F.col("toxic") == 1).alias("y"), (F.length("text") < 1500).alias("p"))
    g = rows.groupBy("source").agg(F.count_if(F.col("y") & F.col("p")).alias("tp"), F.count_if(~F.col("y") & F.col("p")).alias("fp"), F.count_if(F.col("y") & ~F.col("p")).alias("fn"))
    macro = evaluate.mean_of(evaluate.f1(F.col("tp"), F.col("fp"), F.col("fn"))[2])
    micro = evaluate.f1(F.sum("tp"), F.sum("fp"), F.sum("fn"))[2]
    return g.agg(F.count("*").alias("groups"), F.round(macro, 6).alias("macro_f1"), F.round(micro, 6).alias("micro_f1"))


@query(f"select md5({NORMAL.format('text')}) as key, min(doc_id) as first_id, count(*) as copies, max(case when doc_id % 2 = 0 then 1 else 0 end) = 1 as any_even from documents group by 1")
def first_wins_dedupe(spark, sf_dir):
    """Documents with the same folded text become one: the first, with a flag that any of them sets."""
    key = F.md5(text.normalize_text(F.col("text")).cast("binary"))
    return table(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.bool_or(F.col("doc_id") % 2 == 0).alias("any_even"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_event_per_user(spark, sf_dir):
    return corpus.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("""with c as (select user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1)
select c_custkey, c_name from customer where not exists (select 1 from c where c.user_id = c_custkey and c.event_type in ('error', 'click'))""")
def claim_anti_join(spark, sf_dir):
    """Customers (as tasks) whose latest event (as claim) isn't active."""
    last = corpus.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).where(F.col("event_type").isin("error", "click"))
    return table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey", "c_name")


@query("""with g as (select source as publisher, count(*) as row_count from documents group by 1), p as (select *, round_even((1 - 0.5) * row_count * 1.0, 4) as priority from g)
select publisher, row_count, priority, round_even(sum(row_count) over (order by priority desc, publisher rows unbounded preceding) / sum(row_count) over (), 4) as cumulative_coverage from p""")
def cumulative_coverage(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("publisher")).agg(F.count("*").alias("row_count"))
    return corpus.ranked(groups.withColumns({"current_f1": F.lit(None).cast("double"), "tractability": F.lit(1.0)})).select("publisher", "row_count", "priority", "cumulative_coverage")


@query("""with g as (select source as p, lang as f, count(*) as total, count(*) filter (length(text) >= 500) as avail, count(*) filter (length(text) < 500) as blocked, count(*) filter (contains(text, '|')) as backfill, count(*) filter (length(text) > 1500) as good from documents group by 1, 2),
k as (select *, good / total as kpi from g)
select 'v2_' || p || '_' || f || '_' || substr(sha1(p || '|' || f || '|' || total), 1, 8) as task_id, round_even(greatest(0.0, 0.98 - kpi) * total * 1.0 * greatest(avail / greatest(total, 1), 0.05) + backfill * 0.75, 4) as priority,
 case when backfill > 0 and (kpi >= 0.98 or backfill >= greatest(2, floor(total / 3))) then 'goldie-backfilled' when avail = 0 and blocked > 0 then 'harvest-blocked' else 'ready' end as queue_type,
 case when backfill > 0 and (kpi >= 0.98 or backfill >= greatest(2, floor(total / 3))) then 'goldie_backfill_pending' when avail = 0 and blocked > 0 then 'retrieval_blocked' when kpi >= 0.98 then 'above_98' else 'needs_agent' end as status from k""")
def priority_queue(spark, sf_dir):
    """Work queue of (source, language) as (publisher, field): id, priority, type and status."""
    n = lambda c, name: F.count_if(c).alias(name)
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("total"), n(F.length("text") >= 500, "avail"), n(F.length("text") < 500, "blocked"), n(F.col("text").contains("|"), "backfill"), n(F.length("text") > 1500, "good"))
    g = g.withColumn("kpi", F.col("good") / F.col("total"))
    kind = corpus.queue_type(F.lit("supported"), F.col("backfill"), F.col("avail"), F.col("blocked"), F.col("total"), F.col("kpi"))
    priority = corpus.queue_priority(F.col("kpi"), F.col("total"), F.lit(1.0), F.col("avail"), F.col("backfill"))
    return g.select(corpus.task_id(F.col("source"), F.col("lang"), F.col("total")).alias("task_id"), priority.alias("priority"), kind["queue_type"].alias("queue_type"), kind["status"].alias("status"))


@query("""with n as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as g from conversations)
select conv_id, g as "group", max(case when role = 'user' then md5(text) end) as head, coalesce(md5(string_agg(case when role <> 'user' then text end, '\x01' order by turn)), md5('')) as members from n where g > 0 group by 1, 2""")
def meta_fold_pattern(spark, sf_dir):
    """The ordered fold on turns: a user's turn opens a group, what follows joins it."""
    rows = table(spark, sf_dir, "conversations")
    folded = extract.fold_groups(rows, "conv_id", "turn", F.col("role") == "user", "text")
    return folded.select("conv_id", "group", F.md5(F.col("head").cast("binary")).alias("head"), F.md5(F.array_join("members", "\x01").cast("binary")).alias("members"))


@query("""select user_id, event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_purchase,
 first_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as next_purchase from events""")
def ffill_walk(spark, sf_dir):
    """Forward and backward fill along each user's events."""
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.last(bought, ignorenulls=True).over(back).alias("last_purchase"), F.first(bought, ignorenulls=True).over(ahead).alias("next_purchase"))


DOMAINS = ", ".join(f"('{d}', '{p}')" for d, p in rules.DOMAIN_PUBLISHER.items() if p)


@query(f"""with dims(d, p) as (values {DOMAINS}, ('example.net', 'springer'), ('example.org', 'wiley')), h as (select page_id, {DOMAIN} as host from pages)
select h.page_id, coalesce(min(e.p), min(s.p), 'unknown') as publisher from h left join dims e on e.d = h.host left join dims s on ends_with(h.host, '.' || s.d) group by 1""")
def publisher_lookup(spark, sf_dir):
    """Hosts looked up as they are, then by parent domain, in small dimension tables: each parent of a host is a key."""
    dims = spark.createDataFrame([(d, p) for d, p in rules.DOMAIN_PUBLISHER.items() if p] + [("example.net", "springer"), ("example.org", "wiley")], "d string, p string")
    host = url.publisher_domain(F.col("url"))
    parts = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(parents).alias("level", "d"))
    met = rows.join(F.broadcast(dims), "d", "left")
    return met.groupBy("page_id").agg(F.coalesce(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("level"))), F.lit("unknown")).alias("publisher"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by case when o_orderstatus = 'P' then 1 else 0 end, o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def prefer_then_latest(spark, sf_dir):
    """For each customer the latest order, pending ones only where there is no other."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderstatus")
    return corpus.prefer_then_latest(rows, "o_custkey", F.col("o_orderstatus") == "P", "at").select("o_custkey", "o_orderkey")


@query("""with m as (select event_type as metric, case when day(ts) <= 15 then 0 else 1 end as part, sum(cast(value as decimal(18, 2))) / count(*) / 100.0 as value from events group by 1, 2),
d as (select b.metric, round(b.value, 6) as before, round(a.value, 6) as after, round_even(round(a.value, 6) - round(b.value, 6), 4) as delta from m b join m a on a.metric = b.metric where b.part = 0 and a.part = 1)
select metric, before, after, delta, delta < -0.01 as regressed from d""")
def before_after_gate(spark, sf_dir):
    """Mean event values of two halves of the month as two runs, and whether any falls by over a point."""
    mean = F.round((F.sum(F.col("value").cast("decimal(18,2)")) / F.count("*")).cast("double") / 100, 6)
    half = lambda late: table(spark, sf_dir, "events").where((F.dayofmonth("ts") > 15) == late).groupBy(F.col("event_type").alias("metric")).agg(mean.alias("value"))
    return corpus.gate(half(False), half(True))


@query("""with m as (select date_trunc('month', l_shipdate)::date as run, count(*) filter (l_returnflag = 'R') / count(*) as share from lineitem group by 1) select cast(run as varchar) as run, round(share, 6) as share, round_even((round(share, 6) - lag(round(share, 6)) over (order by run)) * 100, 2) as delta_pp from m""")
def run_delta_lag(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").cast("string").alias("run")).agg(F.round(F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 6).alias("share"))
    return corpus.run_deltas(runs, "share", "run")


@query("""select c.c_mktsegment, r.r_name, count(*) as customers, count(*) filter (exists (select 1 from orders o where o.o_custkey = c.c_custkey)) as with_orders from customer c join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey group by 1, 2""")
def segment_grid(spark, sf_dir):
    """Customers of each segment and region, and those that ordered: broadcast dimensions, a semi join as an existence flag."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("some", F.lit(True))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(ordered, "c_custkey", "left")
    return rows.groupBy("c_mktsegment", "r_name").agg(F.count("*").alias("customers"), F.count("some").alias("with_orders"))


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(n) as n, min(value) as min, round(median(value), 6) as median, round(sum(cast(value as decimal(18, 2))) / count(*), 6) as avg, max(case when i = greatest(cast(floor(n * 0.95) as bigint) - 1, 0) then value end) as p95, max(value) as max from r group by 1""")
def latency_index(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return corpus.latency(rows, "event_type", "value").select("event_type", "n", "min", F.round("median", 6).alias("median"), F.round("avg", 6).alias("avg"), "p95", "max")


@query("select s_suppkey, lower(s_name) || '@example.org' as email from supplier")
def cfemail_decode(spark, sf_dir):
    """Addresses hidden by XOR with a key byte, and read again."""
    address = F.concat(F.lower("s_name"), F.lit("@example.org"))
    key = (F.col("s_suppkey") % 200 + 20).cast("int")
    hide = lambda ch: F.lpad(F.hex(F.ascii(ch).bitwiseXOR(key)), 2, "0")
    hidden = F.concat(F.lpad(F.hex(key), 2, "0"), F.array_join(F.transform(F.filter(F.split(address, ""), lambda c: c != ""), hide), ""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", hidden.alias("hidden")).select("s_suppkey", text.decode_cfemail(F.col("hidden")).alias("email"))


@query("""with b as (select doc_id, lang || case when length(text) > 2000 then '_long' else '_short' end as bucket from documents)
select bucket, doc_id from (select *, row_number() over (partition by bucket order by sha1('7' || doc_id), doc_id) as r from b) where r <= 20""")
def bucket_sample(spark, sf_dir):
    """Twenty documents of each bucket, by a seeded hash: a sampling operator."""
    bucket = F.concat("lang", F.when(F.length("text") > 2000, "_long").otherwise("_short"))
    return corpus.sample_by_bucket(table(spark, sf_dir, "documents").select("doc_id", bucket.alias("bucket")), "bucket", "doc_id", 20, "7").select("bucket", "doc_id")


@query("""select role, case when contains(lower(text), 'wrong corresponding') or contains(lower(text), 'incorrect corresponding') then 'wrong_corresponding_author' when contains(lower(text), 'missing corresponding') or contains(lower(text), 'no corresponding') then 'missing_corresponding_author'
 when contains(lower(text), 'author email') then 'author_email' when contains(lower(text), 'corresponding') then 'corresponding_author_general' else 'unknown_corresponding_author_issue' end as issue, count(*) as turns from conversations group by 1, 2""")
def issue_tally(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role", text.issue_class(F.col("text")).alias("issue")).agg(F.count("*").alias("turns"))


@query("select s_suppkey, last, initial from (select s_suppkey, 'supplier' as last, substr(regexp_extract(s_name, '#0*(\\d+)', 1), 1, 1) as initial from supplier)")
def name_keys(spark, sf_dir):
    """Keys of names written 'Last, First'."""
    name = F.concat(F.lit("Supplier, "), F.regexp_extract("s_name", r"#0*(\d+)", 1))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.name_key(name).alias("k")).select("s_suppkey", "k.last", "k.initial")


@query("select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k from events group by 1")
def json_props(spark, sf_dir):
    """A path of semi-structured properties, summed."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query(f"""select doc_id, case when g = '' then 'gold_empty' when p = '' then 'parsed_empty' when length(g) < 100 then 'gold_short' when ends_with(g, '...') or ends_with(g, '…') then 'gold_ellipsis' when length(p) < length(g) * 1.5 then 'parsed_not_longer'
 when not contains(substr(p, 1, 120), substr(g, 1, 100)) then 'no_prefix' else 'replace' end as outcome from (select doc_id, {NORMAL.format("substr(text, 1, 400)")} as g, {NORMAL.format("text")} as p from documents)""")
def repair_outcomes(spark, sf_dir):
    """The repair of cut gold abstracts, on documents against their own openings of 400 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", corpus.repair_prefix(F.substring("text", 1, 400), F.col("text")).alias("outcome"))


@query()
def page_responses(spark, sf_dir):
    """The extraction record of each page."""
    return extract.response(table(spark, sf_dir, "pages")).select("page_id", F.to_json("authors").alias("authors"), F.to_json("urls").alias("urls"), "license", "version", "abstract", "error")


@query()
def dom_profile(spark, sf_dir):
    """Elements of each kind over all pages, and how deep they lie."""
    return dom.nodes(table(spark, sf_dir, "pages")).groupBy("tag").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.countDistinct("page_id").alias("pages"))


@query()
def author_matching(spark, sf_dir):
    """Matching of name lists, small as a page's: the suppliers of each order's lines, against the same names turned around without the first of them."""
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", F.lit("Ann"), F.translate("s_name", "#0", " o")).alias("n"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).join(names, "s_suppkey")
    turned = lambda n: text.let(F.split(n, " "), lambda ws: F.concat_ws(", ", F.element_at(ws, -1), F.element_at(ws, 1)))
    g = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("n")).alias("gold"))  # the lines of one order
    parsed = text.let(F.array_sort(F.transform("gold", turned)), lambda p: F.slice(p, 2, F.size(p)))
    scored = g.select("l_orderkey", evaluate.score_authors(F.col("gold"), parsed).alias("s"))
    return scored.select("l_orderkey", F.size("s.matched").alias("matched"), F.round("s.f1", 6).alias("f1"), F.round("s.f1_soft", 6).alias("f1_soft"))


#: Words of a run that makes a document and an item candidates.
RUN = 5
WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"


def word_runs(words: F.Column, n: F.Column | int) -> F.Column:
    """Hashes of the runs of ``n`` words, none for shorter texts; equal hashes only make candidates."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(n, F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def alike_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, p, q): whole texts of documents and items that share a run of words anywhere; texts shorter than a run are looked for as a whole.

    Words are letters and digits of any script, ideographs and kana one by one. A row is known by its id and its text's hash, so repeated rows stay.
    """
    d = docs.select("doc_id", F.col("text").alias("p"), F.xxhash64("text").alias("dh"))
    b = items.select("item_id", F.col("text").alias("q"), F.xxhash64("text").alias("bh"))
    words = lambda c: F.regexp_extract_all(F.lower(text.text_of(F.col(c))), F.lit(WORD), F.lit(0))
    short = [r[0] for r in b.select(F.size(words("q")).alias("n")).where(f"n between 1 and {RUN - 1}").distinct().collect()]
    whole = lambda ws: F.when(F.size(ws).between(1, RUN - 1), word_runs(ws, F.size(ws))).otherwise(F.array().cast("array<bigint>"))
    # of runs: those of full length on both sides; short items in documents; short documents in items
    tag = lambda k: lambda h: F.struct(F.lit(k).alias("kind"), h.alias("h"))
    tagged = lambda kinds: F.explode(F.concat(*[F.transform(runs, tag(k)) for k, runs in kinds]))
    of_doc = text.let(words("p"), lambda ws: F.struct(word_runs(ws, RUN).alias("full"), F.concat(F.array().cast("array<bigint>"), *[word_runs(ws, n) for n in short]).alias("item"), whole(ws).alias("doc")))
    of_item = text.let(words("q"), lambda ws: F.struct(word_runs(ws, RUN).alias("full"), whole(ws).alias("item"), F.concat(*[word_runs(ws, n) for n in range(1, RUN)]).alias("doc")))
    runs_of = lambda df, made, *keys: df.select(*keys, made.alias("r")).select(*keys, tagged([(k, F.col(f"r.{k}")) for k in ("full", "item", "doc")]).alias("g")).select(*keys, "g.kind", "g.h")
    wanted = runs_of(b, of_item, "item_id", "bh").distinct()
    met = runs_of(d, of_doc, "doc_id", "dh").join(broadcast_if_small(wanted), ["kind", "h"]).select("doc_id", "dh", "item_id", "bh")
    pairs = met.distinct().alias("x")
    with_docs = pairs.join(d.alias("d"), F.expr("x.dh = d.dh and x.doc_id <=> d.doc_id")).select("x.doc_id", "x.item_id", "x.bh", "p").alias("y")
    return with_docs.join(b.alias("b"), F.expr("y.bh = b.bh and y.item_id <=> b.item_id")).select("y.doc_id", "y.item_id", "p", "q")


@query()
def fuzzy_ratios(spark, sf_dir):
    """Indel, token-set and Levenshtein ratios, over the characters of whole texts, of documents and benchmark items that share a run of words."""
    pairs = alike_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ratios = F.round(fuzzy.indel_ratio("p", "q"), 4).alias("indel"), F.round(fuzzy.token_set_ratio("p", "q"), 4).alias("token_set"), F.round(fuzzy.edit_ratio("p", "q"), 6).alias("levenshtein")
    return pairs.select("doc_id", "item_id", *ratios)


@query()
def page_extraction(spark, sf_dir):
    """The chosen extractor's candidate of each page that has one, with the page's open-access status."""
    pages = table(spark, sf_dir, "pages")
    best = families.extract_pages(pages).select("page_id", "rule_id", "rung", F.size("authors").alias("n_authors"), "abstract")
    return pages.select("page_id", openaccess.status(F.col("url"), F.col("html"))["oa_status"].alias("oa_status")).join(best, "page_id", "left")


from . import report_queries  # noqa: E402, F401  registers its queries beside these
