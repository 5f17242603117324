"""The registered queries of the corpus operators, on their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import delta_lloyd, divergence, exact_dedup, kmeans_tree, packing, secrets, simhash, style_tree, telephony, tokens, toxicity, url_filter, warc
from .common import materialise, table, utf8

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as telephony sound: stored, read back, described."""
    payload = utf8("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(payload).cast("long").alias("n_bytes"), telephony.padded(payload).alias("payload"))
    docs = docs.withColumn("codec", telephony.codec_by_content(F.col("payload")))
    stored = telephony.save(telephony.store(docs, "payload", "codec", ["doc_id", "n_bytes"]), "media")
    described = stored.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = telephony.load(described, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    size = F.octet_length("payload")
    return read.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", size - 63, F.lit(64))).alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.crc32("pcm").alias("pcm_crc32"),
    )


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, "text", ["doc_id"], *VOCABULARY)


def op3_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, "text", ["doc_id"], model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_offending"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archives read back; gaps, if any, are logged and stay in a table of the shared folder."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    read = materialise(warc.read_archives(archives).drop("payload"), "records")
    warc.log_gaps(read)
    return read.where("kind != 'gap'").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = style_tree.extract(table(spark, sf_dir, "pages"), "url", "html", ["page_id", "url"])
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op6_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op7_overlap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = tokens.encode_documents(table(spark, sf_dir, "documents"), "text", ["doc_id"], ranks, public_tokenizers.PATTERN)
    decimal = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def joined_spans(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(kind: str) -> Callable[[F.Column], F.Column]:
    return lambda span: span["kind"] == kind


def op8_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans("base").cast("binary"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"), "layers")


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op10_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.spam_list(pages)).drop("listed")


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").drop("centroid")


def op12_golomb_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"), "doc_id", "text")


def op13_shard_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_telephony_audio, op2_cost_packing, op3_toxicity_mil, op4_warc_salvage, op5_style_tree, op6_kmeans_tree_ann, op7_overlap_bpe, op8_secret_worklist, op9_simhash_gray, op10_url_bloom, op11_delta_lloyd, op12_golomb_exchange, op13_shard_divergence)}

OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
named AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/|\.html)$', '') AS canonical FROM split),
listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE (list_contains(string_split(host, '.'), 'spam-farm') OR list_contains(string_split(host, '.'), 'cheap-pills')) AND canonical <> ''),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host <> '' AND ruled.canonical IN (SELECT canonical FROM listed) THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""


def lloyd_sql(rounds: int) -> str:
    """Every round as two tables: owners by full comparison, and the means of all their vectors."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT no, min(d * 8 + k) // 8 AS distance, min(d * 8 + k) % 8 AS k FROM (
  SELECT v.no, c.k, list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(v.q, c.q)])::BIGINT AS d FROM v CROSS JOIN c{r} c) GROUP BY no)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM (
    SELECT k, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (no) CROSS JOIN range(1, 65) r(i) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS no, vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS k, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v) ORDER BY h NULLS LAST, q LIMIT 8),
{", ".join(steps)}
SELECT vec_id, k::INTEGER AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (no) JOIN c{rounds} c USING (k)"""


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER w = 1 AS kept, sha256(plain) AS text_sha256
FROM t WINDOW w AS (PARTITION BY plain ORDER BY length(body) DESC, doc_id NULLS LAST)
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS MATERIALIZED (SELECT no, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT no) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (coalesce(n.n, 0) + 1)::HUGEINT * 1000000000 // (coalesce(total.total, 0) + v.v) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN total ON total.lang = g.lang AND total.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
q AS (SELECT lang, term, 1 + (sum(n) + 1)::HUGEINT * 1000000000 // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM n GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 200
"""

ORACLE_SQL: dict[str, str] = {"op10_url_bloom": OP10_SQL, "op11_delta_lloyd": lloyd_sql(delta_lloyd.ROUNDS), "op12_golomb_exchange": OP12_SQL, "op13_shard_divergence": OP13_SQL}
