"""The queries of the corpus operators and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import toxicity as tox
from plumbline.llm.best_fit_packing import best_fit_packing
from plumbline.llm.bpe import bpe_digests
from plumbline.llm.common import table
from plumbline.llm.cutting_stock import cutting_stock_packing
from plumbline.llm.embedding_dedup import embedding_dedup
from plumbline.llm.exact_dedup import exact_dedup
from plumbline.llm.filter_audit import filter_audit
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.secret_scan import secret_scan
from plumbline.llm.simhash_dedup import CLOSE, simhash_dedup
from plumbline.llm.source_divergence import source_divergence
from plumbline.llm.token_output import token_output
from plumbline.llm.url_filter import Rule, url_filter

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = tox.fit(docs, labels.where(~tox.held_out(F.col("doc_id"))))
    judged = tox.toxicity(docs, model)
    return judged.select("doc_id", tox.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"), F.col("toxic_predicted").alias("predicted"), F.size("toxicity.passages").alias("n_passages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_key")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), width=4, tries=CLOSE).select("doc_id", "fingerprint", "component_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end=50256)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("text_key", "live")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "dropped")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_best_fit_packing, op3_exact_dedup, op4_simhash_dedup, op5_url_filter, op6_token_output, op7_secret_scan, op8_bpe, op9_line_dedup,
    op10_embedding_dedup, op11_filter_audit, op12_source_divergence, op13_cutting_stock_packing)}

ORACLES = {
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op10_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, link.y FROM reach JOIN link ON link.x = reach.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op7_secret_scan": r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS owner, coalesce(source, chr(0)) || chr(31) || coalesce(lang, chr(0)) AS repo, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
  (1, 'access', 'AKIA[A-Z0-9]+', 16), (2, 'hex', '[0-9a-f]+', 32), (3, 'bare', '[A-Za-z0-9+_-]+', 20)) v(kind, name, pattern, least)),
m AS (SELECT doc_id, owner, repo, 0 AS kind, 'assign' AS name, 8 AS least, regexp_extract_all(t, (SELECT pattern FROM k WHERE kind = 0)) AS hits,
    regexp_extract_all(t, (SELECT pattern FROM k WHERE kind = 0), 2) AS vals, regexp_split_to_array(t, (SELECT pattern FROM k WHERE kind = 0)) AS gaps FROM d
  UNION ALL SELECT doc_id, owner, repo, kind, name, least, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d, k WHERE kind = 1
  UNION ALL SELECT doc_id, owner, repo, kind, name, least, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_split_to_array(t, '[0-9a-f]+') FROM d, k WHERE kind = 2
  UNION ALL SELECT doc_id, owner, repo, kind, name, least, regexp_extract_all(t, '[A-Za-z0-9+_-]+'), regexp_extract_all(t, '[A-Za-z0-9+_-]+'), regexp_split_to_array(t, '[A-Za-z0-9+_-]+') FROM d, k WHERE kind = 3),
e AS (SELECT doc_id, owner, repo, kind, name, least, i, hits[i] AS hit, vals[i] AS val, length(gaps[i]) AS gap, length(hits[i]) AS size FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
p AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM e),
s AS (SELECT doc_id, owner, repo, kind, name, val, stop - size AS start, stop FROM p WHERE length(val) >= least
  AND (kind < 3 OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')))),
h AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM s GROUP BY val),
c AS (SELECT s.*, owners >= 3 OR (owners > 1 AND repos >= 6) AS copied FROM s JOIN h USING (val)),
f AS (SELECT * FROM c WHERE kind < 3 OR (NOT copied AND NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.kind < 3 AND b.start < c.stop AND c.start < b.stop))),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  string_agg(name || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM documents LEFT JOIN g USING (doc_id)""",
    "op11_filter_audit": r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, {
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)} AS x FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, x.A::INT AS a, x.B::INT AS b, x.C::INT AS c, x.D::INT AS d, x.E::INT AS e, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT v.k || w.k || x.k || y.k || z.k AS filter_order FROM k v, k w, k x, k y, k z WHERE len(list_distinct([v.k, w.k, x.k, y.k, z.k])) = 5),
m AS (SELECT *, [a, b, c, d, e] AS bits, a + b + c + d + e AS fails FROM c),
s AS (SELECT m.*, filter_order, step, bits[ascii(substr(filter_order, step, 1)) - 64] AS own,
    list_sum([bits[ascii(substr(filter_order, i, 1)) - 64] FOR i IN range(1, step)]) AS before FROM m, o, (SELECT unnest(range(1, 6))::INT AS step))
SELECT part, filter_order, step, coalesce(sum(n) FILTER (own = 0 AND coalesce(before, 0) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own = 1 AND coalesce(before, 0) = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (own = 1 AND before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own = 1 AND fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (own = 1 AND coalesce(before, 0) = 0), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (own = 1 AND coalesce(before, 0) = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(fails, 1)) FILTER (own = 1), 0)::BIGINT AS shapley FROM s GROUP BY part, filter_order, step""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n_lang FROM kept GROUP BY lang),
s AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n_source FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (n_source + v) AS p, 1 + 1000000000::HUGEINT * (total + 1) // (n_lang + v) AS q
  FROM s JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, r::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM (SELECT * FROM every UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR r <= 200""",
}
