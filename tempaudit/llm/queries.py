"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempaudit.llm import (bpe, embedding_dedup, filter_audit, hard_negatives, line_dedup, lm_scoring, mixing, ngram_join, quality_classifier,
                           quality_rules, secrets, sharding, url_filters)
from tempaudit.session import small_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@query
def op4_quality_rules(spark, sf):
    return quality_rules.repetition(table(spark, sf, "documents"))


@query
def op1_source_mix(spark, sf):
    docs = table(spark, sf, "documents")
    chosen = mixing.mix(docs, F.array("source"), mixing.cycled(5, 2, 1))
    sources = F.broadcast(spark.createDataFrame([s[:3] for s in chosen.sources], "source string, source_size long, target double"))
    mixed = chosen.documents.withColumn("name", F.col("members")[0]).join(sources, F.col("name").eqNullSafe(F.col("source")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_ngram_jaccard_join(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


@query
def op3_secret_scan(spark, sf):
    return secrets.scan(table(spark, sf, "documents"))


def vocabulary() -> str:
    """The public byte-level vocabulary of 50,257 tokens on the driver."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op5_bpe_round_trip(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), vocabulary())


@query
def op6_lm_scoring(spark, sf):
    training = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    return lm_scoring.score(table(spark, sf, "documents"), vocabulary(), training)


@query
def op7_line_dedup(spark, sf):
    out = line_dedup.dedup_lines(table(spark, sf, "documents"), least=1)
    return out.select("doc_id", "n_lines", "n_exact", "n_near", "removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block")]


@query
def op8_url_filters(spark, sf):
    rules = small_table(spark, URL_RULES, "host string, path string, action string")
    return url_filters.judge(table(spark, sf, "pages"), rules)


ORACLES["op8_url_filters"] = """
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(h, q, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, arg_max(h || q, length(h || q) * 1000 + length(h)) AS rule, arg_max(action, length(h || q) * 1000 + length(h)) AS action
    FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)"""


@query
def op9_embedding_near_dedup(spark, sf):
    return embedding_dedup.links(table(spark, sf, "embeddings"))


ORACLES["op9_embedding_near_dedup"] = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u AS vec_id, min(w) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def judged(docs, sf):
    """Documents by the quality classifier; a source stands for a host, its languages for the host's paths."""
    return quality_classifier.classify(docs, table(docs.sparkSession, sf, "labels"), F.col("source"), F.col("lang"))


@query
def op10_quality_classifier(spark, sf):
    return judged(table(spark, sf, "documents"), sf)


@query
def op11_filter_audit(spark, sf):
    return filter_audit.audit_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN g USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
l(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM l a JOIN l b ON b.c <> a.c JOIN l c ON c.c NOT IN (a.c, b.c) JOIN l d ON d.c NOT IN (a.c, b.c, c.c) JOIN l e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (SELECT part, filter_order, step, any_value(bit) AS bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM m, s GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x"""


@query
def op12_hard_negatives(spark, sf):
    rows = hard_negatives.usable(table(spark, sf, "embeddings"), "embedding", "vec_id", "label")
    return hard_negatives.mine(hard_negatives.moved_labels(rows, 7, 10), 50)


ORACLES["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
pos AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
neg AS (SELECT pos.anchor, pos.other AS positive, p.other AS negative, pos.score AS ps, p.score AS ns,
    row_number() OVER (PARTITION BY pos.anchor, pos.other ORDER BY p.score DESC, p.other) AS rank
    FROM pos JOIN p ON p.anchor = pos.anchor AND NOT p.same AND 100 * p.score BETWEEN 50 * pos.score AND 95 * pos.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score
FROM neg WHERE rank <= 3"""


@query
def op13_sharding(spark, sf):
    return sharding.shard_documents(table(spark, sf, "documents"), 8)
