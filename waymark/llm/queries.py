"""The thin queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from waymark.llm.byte_bpe import decoded, encoded, read_ranks
from waymark.llm.common import table
from waymark.llm.exact_topk import exact_top_k
from waymark.llm.filter_audit import audit_documents
from waymark.llm.line_dedup import drop_frequent_lines
from waymark.llm.merkle import tamper_test
from waymark.llm.packing import pack_documents
from waymark.llm.piece_sampling import sample_pieces
from waymark.llm.prefix_forest import nearest
from waymark.llm.quality import with_quality
from waymark.llm.secret_scan import find_secrets
from waymark.llm.simhash import hexed, near_duplicates
from waymark.llm.token_counts import count_tokens
from waymark.llm.url_filter import judge_urls


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
lines AS (SELECT r, doc_id, generate_subscripts(own, 1) AS pos, unnest(own) AS line FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o ON keyed.k = o.k GROUP BY r, doc_id
"""


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


OP3_SQL = """
WITH whole AS (
  SELECT vec_id, embedding, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
asked AS (SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT vec_id, embedding, v FROM whole WHERE vec_id % 20 = 0)),
scored AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_sum([x[1] * x[2] FOR x IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM asked q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


#: Fixed values of the contract: verdict, host, start of the path.
OP4_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), OP4_RULES)


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), seed=0, alpha=1.0)


#: Documents below this score are rejected. It leans towards keeping: a clean document lost costs more than junk kept.
KEEP_FROM = 0.3


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    keep = F.coalesce(F.col("quality.score") >= KEEP_FROM, F.lit(True))
    return found.select("doc_id", "quality.text_score", "quality.meta_score", F.col("quality.score").alias("quality_score"), keep.alias("keep"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_test(table(spark, sf_dir, "documents"))


def _tree_sql(name: str, levels: int = 12) -> str:
    """Common tables over {name}0 (grp, pos, digest, width): the nodes of each level, and {name}s of left and right siblings by level and node."""
    same = "a.grp IS NOT DISTINCT FROM b.grp"
    parts = [
        f"{name}{k} AS (SELECT grp, pos // 8 AS pos, (width + 7) // 8 AS width, CASE WHEN width = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}{k - 1} GROUP BY grp, pos // 8, width)"
        for k in range(1, levels + 1)
    ]
    near = " UNION ALL ".join(
        f"SELECT {k} AS level, a.grp, a.pos, a.width > 1 AS joins, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r"
        f" FROM {name}{k} a JOIN {name}{k} b ON {same} AND a.pos // 8 = b.pos // 8 GROUP BY a.grp, a.pos, a.width"
        for k in range(levels)
    )
    return ",\n".join([*parts, f"{name}s AS ({near})"])


def _climb_sql(name: str, start: str, levels: int = 12) -> str:
    """Common tables {name}p{k} over {start}, which has grp, pos, proof and again: each level's siblings added to both."""
    parts, last = [], start
    for k in range(levels):
        parts.append(
            f"{name}p{k} AS (SELECT x.* REPLACE (x.proof || s.l || s.r AS proof, CASE WHEN s.joins THEN sha256(s.l || x.again || s.r) ELSE x.again END AS again, x.pos // 8 AS pos)"
            f" FROM {last} x JOIN {name}s s ON s.level = {k} AND s.grp IS NOT DISTINCT FROM x.grp AND s.pos = x.pos)"
        )
        last = f"{name}p{k}"
    return ",\n".join(parts)


_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || {} END"
OP11_SQL = f"""
WITH docs AS (
  SELECT doc_id, lang, sha256({_FIELDS} || {_TEXT.format("text")}) AS leaf,
         sha256({_FIELDS} || {_TEXT.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS changed,
         xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) AS crc FROM documents),
leaves AS (
  SELECT doc_id, lang AS grp, leaf, CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS again, '' AS proof,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS width FROM docs),
g0 AS (SELECT grp, pos, leaf AS digest, width FROM leaves),
{_tree_sql("g")},
{_climb_sql("g", "leaves")},
subs AS (SELECT grp AS lang, digest AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS width FROM g12),
t0 AS (SELECT 0 AS grp, pos, subroot AS digest, width FROM subs),
{_tree_sql("t")},
climbed AS (SELECT x.doc_id, x.leaf, x.proof, x.again, s.subroot, 0 AS grp, s.pos FROM gp11 x JOIN subs s ON x.grp IS NOT DISTINCT FROM s.lang),
{_climb_sql("t", "climbed")}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, again AS folded_root, again = digest AS verified FROM tp11 CROSS JOIN (SELECT digest FROM t12)
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    text_of_ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded(found, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text_of_ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS txt,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
told AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         MAP {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
              'C': 100 * (length(txt) - length(regexp_replace(txt, '[A-Z]', '', 'g'))) > 5 * length(txt),
              'D': regexp_matches(txt, '[#$%&*|]'), 'E': coalesce(docs.doc_id > min(docs.doc_id) OVER (PARTITION BY txt), false)} AS f
  FROM docs LEFT JOIN told ON docs.doc_id = told.doc_id),
masks AS (SELECT part, good, toxic, f, count(*) AS n FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM orders),
seen AS (
  SELECT part, filter_order, step, filter_order[step] AS x, n, good, toxic, f[filter_order[step]] AS fails,
         len(list_filter(string_split(left(filter_order, step - 1), ''), lambda y: y <> '' AND f[y])) AS before,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: f[y])) AS failed FROM masks, steps),
counted AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE before = 0 AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE before = 0 AND fails), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE before > 0 AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(n * good) FILTER (WHERE before = 0 AND fails), 0)::BIGINT AS good_lost, coalesce(sum(n * toxic) FILTER (WHERE before = 0 AND fails), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM counted
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_prefix_forest": op2_prefix_forest,
    "op3_exact_topk": op3_exact_topk,
    "op4_url_filters": op4_url_filters,
    "op5_piece_sampling": op5_piece_sampling,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secret_scan": op7_secret_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_counts": op9_token_counts,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op3_exact_topk": OP3_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
