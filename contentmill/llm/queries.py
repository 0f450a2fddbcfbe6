"""Driver queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contentmill.llm.centroids import centroid_clusters
from contentmill.llm.decontaminate import contaminated
from contentmill.llm.embedding_dedup import embedding_near_dedup
from contentmill.llm.html_text import extract_text
from contentmill.llm.licenses import TEMPLATES, bigram_list, scan_licenses
from contentmill.llm.mixing import mix_sources
from contentmill.llm.ngram_join import ngram_jaccard_join
from contentmill.llm.pii import find_pii, pii_digest
from contentmill.llm.quality import classify_quality
from contentmill.llm.secrets import scan_secrets, secret_digest
from contentmill.llm.url_filter import filter_urls
from contentmill.llm.warc import warc_round_trip
from contentmill.llm.whitening import whiten

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(_read(spark, sf_dir, "documents")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_read(spark, sf_dir, "embeddings"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(_read(spark, sf_dir, "documents")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_read(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_read(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_read(spark, sf_dir, "pages"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_url_filters,
        op3_quality_classifier,
        op4_embedding_near_dedup,
        op5_license_scans,
        op6_pii,
        op7_ngram_jaccard_join,
        op8_benchmark_decontamination,
        op9_mixing_sources,
        op10_html_extraction,
        op11_centroid_clustering,
        op12_warc,
        op13_embedding_whitening,
    )
}

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_REACHED = """
    reached(id, other) as (select a, b from links union all select b, a from links union select r.id, l.b from reached r join (select a, b from links union all select b, a from links) l on r.other = l.a),
    classes as (select id, least(id, min(other)) as component_id from reached group by id)"""

_TEMPLATE_ROWS = ", ".join(f"('{name}', {bigram_list(t)!r})" for name, texts in TEMPLATES.items() for t in texts)


def _rounds(n: int) -> str:
    """Rounds of Lloyd over ``points``: assignments a0 to a``n`` and centroids c0 to c``n``."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""
    d{i} as (select vec_id, c, sum((p.x - k.x) * (p.x - k.x)) as distance from points p join c{i} k using (d) group by 1, 2),
    a{i} as (select vec_id, c, distance from d{i} qualify row_number() over (partition by vec_id order by distance, c) = 1)""")
        if i < n:
            parts.append(f"""
    m{i} as (select c, d, cast(sum(x) as bigint) as s, count(*) as n from points join a{i} using (vec_id) group by 1, 2),
    c{i + 1} as (select c, d, coalesce((s - ((s % n) + n) % n) // n, x) as x from c{i} left join m{i} using (c, d))""")
    return ",".join(parts)


ORACLES: dict[str, str] = {
    "op4_embedding_near_dedup": f"""
    with recursive good as (
        select vec_id, label, cast(embedding as double[]) as v from embeddings where label is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.93),
    {_REACHED}
    select vec_id, (select count(*) from links where a = vec_id or b = vec_id) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
    from embeddings left join classes on id = vec_id""",
    "op5_license_scans": f"""
    with known(license, grams) as (values {_TEMPLATE_ROWS}),
    lines as (select doc_id, text, unnest(string_split_regex(text, '[\\r\\n]+')) as line from documents where text is not null),
    pieces as (
        select doc_id, text as piece from documents where text is not null union select doc_id, line from lines
        union select doc_id, unnest(string_split_regex(regexp_replace(line, '([.;!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) from lines),
    plain as (select distinct doc_id, trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')) as passage from pieces),
    worded as (select doc_id, passage, string_split(passage, ' ') as w from plain),
    sets as (select doc_id, passage, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as grams from worded where len(w) > 1),
    scored as (select doc_id, passage, license, 2.0 * len(list_intersect(s.grams, k.grams)) / (len(s.grams) + len(k.grams)) as dice from sets s, known k),
    best as (select doc_id, passage, license, dice, row_number() over (partition by doc_id, passage order by dice desc, license) as n from scored where dice >= 0.8 - 1e-12)
    select doc_id, license, round(max(dice), 9) as dice, count(*) as n_passages from best where n = 1 group by 1, 2""",
    "op7_ngram_jaccard_join": f"""
    with recursive worded as (select doc_id, {_WORDS} as w from documents),
    sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as grams from worded),
    cells as (select doc_id, len(grams) as n, unnest(grams) as gram from sets),
    pairs as (select a.doc_id as a, b.doc_id as b, a.n as n, b.n as m, count(*) as shared from cells a join cells b on a.gram = b.gram and a.doc_id < b.doc_id and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) group by 1, 2, 3, 4),
    links as (select a, b from pairs where 100 * shared >= 90 * (n + m - shared)),
    {_REACHED}
    select doc_id, cast(len(grams) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id from sets left join classes on id = doc_id""",
    "op11_centroid_clustering": f"""
    with kept as (select vec_id, embedding from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    points as (select vec_id, unnest(range(64)) as d, unnest(list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint))) as x from kept),
    starts as (select vec_id, row_number() over (order by sha256('1:' || vec_id)) - 1 as c from kept qualify c < 16),
    c0 as (select c, d, x from starts join points using (vec_id)),{_rounds(3)},
    named as (select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as centroid_sha256 from c3 group by 1)
    select vec_id, cast(c as integer) as cluster, cast(distance as bigint) as distance, cast(sum(distance) over (partition by c) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia, centroid_sha256
    from a3 join named using (c)""",
    "op12_warc": """
    with keyed as (select page_id, coalesce(html, '') as html from pages),
    sized as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from keyed),
    firsts as (select payload_digest, min(page_id) as first from sized where payload_bytes >= 100 group by 1)
    select page_id, payload_bytes, s.payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to
    from sized s left join firsts f on s.payload_digest = f.payload_digest and payload_bytes >= 100""",
}
