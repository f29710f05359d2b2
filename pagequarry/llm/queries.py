"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, fingerprints, language_id, line_dedup, lm_score, merkle, near_duplicates, packing, quality, token_counts, toxicity, url_filter
from .common import id_remainder, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (verdict, host + path)
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs that a rule judges are the labelled ones; the trees carry their verdicts over to the rest."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    _, verdict = url_filter.rule_for(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), URL_RULES)
    fitted = url_filter.train(pages.select("url", verdict.alias("verdict")))
    return url_filter.judge(pages, fitted, URL_RULES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", F.col("offending.position").alias("offending_sentences"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "representative", "n_links", "n_shingles")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.n_words(F.col("text")))


def rounded_scores(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_scores(lm_score.score(table(spark, sf_dir, "documents")))


def backed_off(value: str, given: str, context: str, shorter: str) -> str:
    """SQL of one step: the share of an n-gram after its context, or ``ALPHA`` of the shorter n-gram's score; without a context the shorter one's."""
    return f"(case when coalesce({value}, 0) > 0 then {value} / greatest(1, {context}) else (case when {given} is null then 1.0::double else {lm_score.ALPHA}::double end) * {shorter} end)"


#: The same counts by grouping, from trigrams down.
OP8_SQL = f"""
with words as (
  select doc_id, p, ws[p] as w, case when p > 1 then ws[p - 1] end as v, case when p > 2 then ws[p - 2] end as u
  from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as ws from documents))
), total as (select count(*) as n from words),
uni as (select w, count(*) as c from words group by w), own_uni as (select doc_id, w, count(*) as c from words group by doc_id, w),
bi as (select v, w, count(*) as c from words where v is not null group by v, w), own_bi as (select doc_id, v, w, count(*) as c from words where v is not null group by doc_id, v, w),
tri as (select u, v, w, count(*) as c from words where u is not null group by u, v, w), own_tri as (select doc_id, u, v, w, count(*) as c from words where u is not null group by doc_id, u, v, w),
size as (select doc_id, count(*) as n from words group by doc_id),
scored as (
  select a.doc_id, {backed_off("(tri.c - ot.c)", "a.u", "(bc.c - obc.c)", backed_off("(bi.c - ob.c)", "a.v", "(uv.c - ov.c)", f"(case when uw.c - ow.c > 0 then (uw.c - ow.c) / greatest(1, t.n - s.n) else {lm_score.ALPHA}::double / greatest(1, t.n - s.n) end)"))} as value
  from words a join size s using (doc_id) cross join total t
  join uni uw on uw.w = a.w join own_uni ow on ow.doc_id = a.doc_id and ow.w = a.w
  left join uni uv on uv.w = a.v left join own_uni ov on ov.doc_id = a.doc_id and ov.w = a.v
  left join bi on bi.v = a.v and bi.w = a.w left join own_bi ob on ob.doc_id = a.doc_id and ob.v = a.v and ob.w = a.w
  left join bi bc on bc.v = a.u and bc.w = a.v left join own_bi obc on obc.doc_id = a.doc_id and obc.v = a.u and obc.w = a.v
  left join tri on tri.u = a.u and tri.v = a.v and tri.w = a.w left join own_tri ot on ot.doc_id = a.doc_id and ot.u = a.u and ot.v = a.v and ot.w = a.w
)
select d.doc_id, coalesce(s.n, 0) as n_words, round(coalesce(x.l, 0), 4) as log10_score, round(x.l / s.n, 6) as mean_log10
from documents d left join size s using (doc_id) left join (select doc_id, sum(log10(value)) as l from scored group by doc_id) x using (doc_id)
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


#: The same removal by exact distinct counts.
OP9_SQL = rf"""
with lines as (
  select doc_id, source, p - 1 as pos, ls[p] as line, md5(regexp_replace(ls[p], '^[\s]+|[\s]+$', '', 'g')) as h, trim(regexp_replace(ls[p], '^[\s]+|[\s]+$', '', 'g')) = '' as blank
  from (select doc_id, source, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as p from documents)
), bad as (
  select h from lines where not blank group by h having count(distinct coalesce(source, chr(0))) >= {line_dedup.MIN_SITES}
), firsts as (
  select h, min((doc_id, pos)) as first from lines join bad using (h) where not blank group by h
), gone as (
  select l.doc_id, l.pos from lines l join firsts f on l.h = f.h where not l.blank and (l.doc_id, l.pos) <> f.first
), kept as (
  select l.doc_id, coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as text, count(*) as n_lines, count(g.pos) as n_removed
  from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
)
select doc_id, text, cast(n_lines as integer) as n_lines, cast(n_removed as integer) as n_removed from kept
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(id_remainder("doc_id", 4) != 2))
    held = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    return language_id.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the id's crc32 is even, the row is also tampered with: its text loses its line ends; its path is that of the row as it was."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars"]
    spoilt = F.when(id_remainder("doc_id", 2) == 0, merkle.leaf(*fields, F.translate("text", "\n", "")))
    made = docs.select("doc_id", "source", merkle.leaf(*fields, "text").alias("leaf"), spoilt.alias("tampered_leaf"))
    proved = merkle.prove(made, keep=["tampered_leaf"])
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), merkle.folded(F.coalesce("tampered_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_field(value: str) -> str:
    return f"coalesce(octet_length(encode(cast({value} as varchar))) || ':' || cast({value} as varchar), '-')"


def oracle_leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(oracle_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


#: The trees level by level, in recursion; crc32 by its table.
OP11_SQL = f"""
with recursive bits as (
  select b as i, 0 as k, b::bigint as v from range(0, 256) t(b)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8
), crc as (select list(v order by i) as t from bits where k = 8
), d as (
  select doc_id, source, {oracle_leaf("text")} as leaf, {oracle_leaf("replace(text, chr(10), '')")} as spoilt,
    xor(list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(doc_id::varchar, '')]), lambda a, c: xor(a >> 8, crc.t[(xor(a, c) & 255) + 1])), 4294967295::bigint) as sum
  from documents, crc
), leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from d
), tree as (
  select 0 as level, source, pos, leaf as h, count(*) over (partition by source) as n from leaves
  union all
  select any_value(level) + 1, source, pos // 3, sha256(string_agg(h, '' order by pos)), (any_value(n) + 2) // 3 from tree where n > 1 group by source, pos // 3
), subroots as (select source, h as subroot, level as height, row_number() over (order by source nulls first) - 1 as place from tree where n = 1
), top as (
  select 0 as level, place as pos, subroot as h, count(*) over () as n from subroots
  union all
  select any_value(level) + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (any_value(n) + 2) // 3 from top where n > 1 group by pos // 3
), low as (
  select l.source, l.pos as leaf_pos, t.level, string_agg(t.h, '' order by t.pos) filter (where t.pos < l.pos // (3 ** t.level)::bigint) as before, string_agg(t.h, '' order by t.pos) filter (where t.pos > l.pos // (3 ** t.level)::bigint) as after
  from leaves l join tree t on t.source is not distinct from l.source and t.n > 1 and t.pos // 3 = l.pos // (3 ** (t.level + 1))::bigint group by 1, 2, 3
), high as (
  select s.source, s.height + t.level as level, string_agg(t.h, '' order by t.pos) filter (where t.pos < s.place // (3 ** t.level)::bigint) as before, string_agg(t.h, '' order by t.pos) filter (where t.pos > s.place // (3 ** t.level)::bigint) as after
  from subroots s join top t on t.n > 1 and t.pos // 3 = s.place // (3 ** (t.level + 1))::bigint group by 1, 2
), path as (
  select source, leaf_pos, level, coalesce(before, '') as before, coalesce(after, '') as after from low
  union all select l.source, l.pos, h.level, coalesce(h.before, ''), coalesce(h.after, '') from leaves l join high h on l.source is not distinct from h.source
), fold as (
  select source, pos, 0 as level, case when sum % 2 = 0 then spoilt else leaf end as h from leaves
  union all select f.source, f.pos, f.level + 1, sha256(p.before || f.h || p.after) from fold f join path p on p.source is not distinct from f.source and p.leaf_pos = f.pos and p.level = f.level
), proofs as (select source, leaf_pos, string_agg(before || after, '' order by level) as digits from path group by 1, 2
), ends as (select source, pos, arg_max(h, level) as h from fold group by 1, 2)
select l.doc_id, l.leaf, s.subroot, r.h as root, sha256(coalesce(p.digits, '')) as proof_sha256, e.h as folded_root, e.h = r.h as verified
from leaves l join subroots s on s.source is not distinct from l.source join (select h from top where n = 1) r on true
left join proofs p on p.source is not distinct from l.source and p.leaf_pos = l.pos join ends e on e.source is not distinct from l.source and e.pos = l.pos
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run has a cache of its own, empty at first, so that what it encodes doesn't depend on earlier runs."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, middle = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.lit(None).cast("string")
    for k, c in enumerate(middle):
        digest = F.when(F.col("cluster") == k, F.lit(centroids.digest_of(c))).otherwise(digest)
    return rows.withColumn("centroid_sha256", digest)


def lloyd_sql() -> str:
    """The rounds one after another, over unnested components and row by row, without grouping equal vectors."""
    steps = [
        f"""kept as materialized (
  select vec_id, [floor({centroids.SCALE} * x::double)::bigint for x in embedding] as q, sha256('{centroids.SALT}' || vec_id) as h from embeddings
  where len(embedding) = {centroids.WIDTH} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {centroids.WIDTH}
), parts as materialized (select vec_id, unnest(range(1, {centroids.WIDTH + 1})) as i, unnest(q) as x from kept
), c0 as materialized (
  select k, unnest(range(1, {centroids.WIDTH + 1})) as i, unnest(q) as z from (select row_number() over (order by h, q) - 1 as k, q from (select h, q from kept order by h, q limit {centroids.CLUSTERS}))
)"""
    ]
    for r in range(centroids.ROUNDS + 1):
        steps.append(f"""a{r} as materialized (
  select vec_id, arg_min(k, (d, k)) as k, min(d) as d from (select p.vec_id, c.k, sum((p.x - c.z) * (p.x - c.z)) as d from parts p join c{r} c using (i) group by all) group by vec_id
)""")
        if r < centroids.ROUNDS:
            steps.append(f"""c{r + 1} as materialized (
  select c.k, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.z)::bigint as z
  from c{r} c left join (select a.k, p.i, sum(p.x) as s, count(*) as n from parts p join a{r} a using (vec_id) group by all) m on m.k = c.k and m.i = c.i
)""")
    last = centroids.ROUNDS
    return f"""with {", ".join(steps)}
select a.vec_id, a.k::int as cluster, a.d::bigint as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, c.h as centroid_sha256
from a{last} a join (select k, sha256(string_agg(z, ',' order by i)) as h from c{last} group by k) c using (k)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_packing": op7_packing,
    "op8_lm_score": op8_lm_score,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_merkle": op11_merkle,
    "op12_token_counts": op12_token_counts,
    "op13_centroids": op13_centroids,
}
ORACLE_SQL: dict[str, str] = {"op8_lm_score": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_merkle": OP11_SQL, "op13_centroids": lloyd_sql()}
