"""The thin queries opN_<name>, one for each operator of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, bpe, centroids, decontaminate, languages, line_dedup, near_dedup, sharding, substring_dedup, token_counts, topk, toxicity, urls

from tidemark.llm.common import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.decode(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of documents arrives by itself; the rows as they lie after compaction."""
    docs = table(spark, sf_dir, "documents")
    shards = sharding.ShardedTable(spark, fresh_path(spark, "shards"), docs.schema)
    shards.append(docs, "source")
    shards.compact()
    rows = shards.read()
    digest = F.md5(F.col("text").cast("binary"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.select("doc_id", "source", n_bytes.alias("n_bytes"), digest.alias("text_md5"), "run", "run_arrivals", "run_rows", "run_bytes", "tier")


def _merged(k: int) -> str:
    tier = " + ".join(f"(bytes >= {sharding.BASE_BYTES * sharding.FANOUT**t})::INT" for t in range(sharding.LAST_TIER))
    return f"""t{k} AS (SELECT *, {tier} AS tier FROM r{k}),
c{k} AS (SELECT *, count(DISTINCT run) OVER (PARTITION BY tier) AS n FROM t{k}),
g{k} AS (SELECT source, CASE WHEN n >= {sharding.FANOUT} THEN min(run) OVER (PARTITION BY tier) ELSE run END AS run, own_bytes, own_rows FROM c{k}),
r{k + 1} AS (SELECT *, sum(own_bytes) OVER (PARTITION BY run) AS bytes FROM g{k})"""


OP2_ROUNDS = 6
OP2_SQL = f"""
WITH r0 AS (
  SELECT source, source AS run, sum(octet_length(encode(text)))::BIGINT AS own_bytes, count(*) AS own_rows,
         sum(octet_length(encode(text)))::BIGINT AS bytes
  FROM documents GROUP BY source
), {", ".join(_merged(k) for k in range(OP2_ROUNDS))}, last AS (
  SELECT source, run, count(*) OVER (PARTITION BY run) AS run_arrivals, sum(own_rows) OVER (PARTITION BY run)::BIGINT AS run_rows,
         bytes::BIGINT AS run_bytes
  FROM r{OP2_ROUNDS}
)
SELECT d.doc_id, d.source, octet_length(encode(d.text))::BIGINT AS n_bytes, md5(d.text) AS text_md5, run, run_arrivals, run_rows, run_bytes,
       ({" + ".join(f"(run_bytes >= {sharding.BASE_BYTES * sharding.FANOUT**t})::INT" for t in range(sharding.LAST_TIER))})::INT AS tier
FROM documents d JOIN last ON d.source IS NOT DISTINCT FROM last.source
"""


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars_within")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


_ROLLED = " + ".join(f"CASE WHEN i > {back} THEN h[greatest(i - {back}, 1)] ELSE 0 END * {line_dedup.FACTOR**back}" for back in range(line_dedup.WINDOW))
OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), hashed AS (
  SELECT *, list_transform(l, lambda x: ('0x' || md5(x)[1:7])::BIGINT) AS h FROM lines
), ended AS (
  SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR ({_ROLLED}) % {line_dedup.MEAN_LINES} = 0) AS e FROM hashed
), chunked AS (
  SELECT doc_id, text, len(l) AS n, unnest(range(1, len(e) + 1)) AS k, e, l FROM ended
), bodies AS (
  SELECT doc_id, text, n, k, l[(CASE WHEN k = 1 THEN 0 ELSE e[k - 1] END) + 1 : e[k]] AS part FROM chunked
), counted AS (
  SELECT doc_id, n, k, array_to_string(part, chr(10)) AS body, len(part) AS size,
         len(list_filter(part, lambda x: trim(x) <> '')) AS filled
  FROM bodies
), marked AS (
  SELECT *, filled >= {line_dedup.LEAST_LINES}
            AND row_number() OVER (PARTITION BY body, filled >= {line_dedup.LEAST_LINES} ORDER BY doc_id, k) > 1 AS gone
  FROM counted
)
SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text,
       CASE WHEN max(n) = 1 AND max(length(body)) = 0 THEN 0 ELSE max(n) END AS n_lines,
       coalesce(sum(size) FILTER (WHERE gone), 0)::BIGINT AS n_removed
FROM marked GROUP BY doc_id
"""


#: (verdict, rule) of the production rules.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Hosts of junk, adverts and adult pages that the query blocks with all their subdomains; a longer list comes from files.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, BLOCKED_HOSTS).drop("url")


OP8_SQL = f"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
), rules(verdict, rule_host, rule_path) AS (
  VALUES {", ".join(f"('{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in RULES)}
), hosts(name) AS (
  VALUES {", ".join(f"('{h[:-1]}')" for h in BLOCKED_HOSTS)}
), best AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path
)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN EXISTS (SELECT 1 FROM hosts WHERE p.host = name OR ends_with(p.host, '.' || name))
                                THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p LEFT JOIN best b ON p.page_id = b.page_id
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find_passages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.fit(docs)
    return languages.label(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, found = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return centroids.with_inertia(assigned, found)


OP13_ROUNDS = 10


def _distances(of: str) -> str:
    """Each vector's nearest centroid: the least (distance, number)."""
    return f"""SELECT v.vec_id, v.v, arg_min(c.c, (list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.c)) AS c,
    min((list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.c))[1]::BIGINT AS d
  FROM v, {of} c GROUP BY v.vec_id, v.v"""


def _round(k: int) -> str:
    return f"""a{k} AS MATERIALIZED ({_distances(f"c{k}")}
), m{k} AS (SELECT c, i, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS x FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY c, i
), c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{k} o LEFT JOIN (SELECT c, list(x::BIGINT ORDER BY i) AS v FROM m{k} GROUP BY c) n ON o.c = n.c)"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8
), {", ".join(_round(k) for k in range(OP13_ROUNDS))}, last AS MATERIALIZED ({_distances(f"c{OP13_ROUNDS}")})
SELECT l.vec_id, l.c::INT AS cluster, l.d AS distance, sum(l.d) OVER (PARTITION BY l.c)::BIGINT AS cluster_inertia, sum(l.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last l JOIN c{OP13_ROUNDS} c ON l.c = c.c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_topk": op3_topk,
    "op4_minhash": op4_minhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_language_id": op11_language_id,
    "op12_alignment": op12_alignment,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": OP2_SQL,
    "op3_topk": OP3_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_url_filters": OP8_SQL,
    "op13_centroids": OP13_SQL,
}
