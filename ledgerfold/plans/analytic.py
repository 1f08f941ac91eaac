"""Vectors, graphs, names, text, finance, sinks and streams: queries over the operator modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.catalog import table
from ledgerfold.functions.columns import black_scholes_call
from ledgerfold.operators.graph import bfs, components, triangles
from ledgerfold.operators.similar import centroids, nearest_centroids, set_similarity
from ledgerfold.operators.simulate import portfolio_var
from ledgerfold.operators.text_search import bm25
from ledgerfold.plans.sqlbase import query, with_roles
from ledgerfold.sources.tables import audit_chain, insert_or_ignore, upsert
from ledgerfold.streaming.watch import available, run_watches, windowed_counts


def cosine_topk_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = centroids(e, "label", "embedding")
    out = nearest_centroids(e, "vec_id", "embedding", c, "label", 3)
    return out.select("vec_id", "label", "similarity", F.col("rank").cast("bigint").alias("rank"))


def cluster_centroid_norms(spark: SparkSession, d: str) -> DataFrame:
    c = centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.round(F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("centre_norm"), "n")


def jaccard_similar_firms(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "startability_surface").where("firm_id IS NOT NULL AND score > 0.5 AND NOT isnan(score)").select("firm_id", "cluster_id").distinct()
    return set_similarity(s, "firm_id", "cluster_id", "company_1001").where("jaccard > 0.01")


def vector_quality(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "patent_research_data").select("publication_number", "embedding_v1")
    e = F.col("embedding_v1")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x))
    kind = F.when(e.isNull(), "missing").when(F.size(e) != 64, "length").when(bad, "nan").when(~F.exists(e, lambda x: x != 0), "zero").otherwise("valid")
    return v.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def citation_network_bfs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "patent_citations").select(F.col("citing_publication").alias("src"), F.col("cited_publication").alias("dst"))
    start = c.agg(F.min("src").alias("node"))
    return bfs(c, start, 2).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def citation_components(spark: SparkSession, d: str) -> DataFrame:
    o = query(with_roles("SELECT citing AS src, cited AS dst FROM cites"))(spark, d)
    return components(o).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def network_clustering(spark: SparkSession, d: str) -> DataFrame:
    t = triangles(table(spark, d, "patent_citations").select(F.col("citing_publication").alias("src"), F.col("cited_publication").alias("dst")))
    return t.select("node", "degree", "triangles", F.round("coefficient", 6).alias("coefficient"))


def text_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return bm25(table(spark, d, "documents"), "doc_id", "text", ["antenna", "gearbox", "licensing"]).orderBy(F.desc("score"), "doc_id").limit(200)


def patent_option_value(spark: SparkSession, d: str) -> DataFrame:
    r = query(with_roles("SELECT id, y, value FROM records"))(spark, d)
    years = F.greatest(F.lit(20.0) - (F.lit(2005.0) - F.col("y")), F.lit(0.5))
    call = black_scholes_call(F.col("value"), F.lit(100000.0), years, 0.02, F.lit(0.3))
    return r.select("id", F.round(call, 2).alias("option_value"))


def portfolio_value_at_risk(spark: SparkSession, d: str) -> DataFrame:
    e = query("SELECT l_suppkey AS firm, avg(l_discount) AS a, avg(l_tax) AS b, avg(l_quantity) / 50 AS c, count(*) / 1000 AS d, 0.1 AS e FROM lineitem GROUP BY l_suppkey")(spark, d)
    return portfolio_var(e, "firm", list("abcde"))


def upsert_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return upsert(o, new, ["o_orderkey"], "o_totalprice").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))


def insert_ignore_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type")
    return insert_or_ignore(e.where("event_type = 'purchase'"), e, ["user_id"]).groupBy().agg(F.count(F.lit(1)).alias("n"))


def audit_hash_chain(spark: SparkSession, d: str) -> DataFrame:
    return audit_chain(table(spark, d, "events"), "user_id", "event_id", "event_type")


def stream_watch_alerts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    watches = t.select("event_type").distinct().select(F.concat(F.lit("w-"), "event_type").alias("watch"), F.col("event_type").alias("label"), F.lit(5).alias("least"))
    out = run_watches(available(spark, f"{d}/events.parquet", t.schema), watches, "event_type", "label", "least")
    return out.groupBy("watch").agg(F.sum("n").alias("n"))


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    stream = available(spark, f"{d}/events.parquet", t.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_counts(stream, "ts", "event_type", "1 day", "2 days")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"))


QUERIES = {f.__name__: f for f in (cosine_topk_centroid, cluster_centroid_norms, jaccard_similar_firms, vector_quality, citation_network_bfs, citation_components, network_clustering, text_ranked_search, patent_option_value, portfolio_value_at_risk, upsert_orders, insert_ignore_events, audit_hash_chain, stream_watch_alerts, stream_daily_counts)}

_CENTRE = "c AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY label, pos), centre AS (SELECT label, list(m ORDER BY pos) AS v FROM c GROUP BY label)"
SQL = {
    "cosine_topk_centroid": f"WITH {_CENTRE}, s AS (SELECT vec_id, centre.label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, centre) SELECT vec_id, label, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, label) AS rank FROM s) WHERE rank <= 3",
    "cluster_centroid_norms": f"WITH {_CENTRE} SELECT label, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS centre_norm, (SELECT count(*) FROM embeddings e WHERE e.label = centre.label) AS n FROM centre",
    "jaccard_similar_firms": """
WITH s AS (SELECT DISTINCT firm_id, cluster_id FROM startability_surface WHERE firm_id IS NOT NULL AND score > 0.5 AND NOT isnan(score)), m AS (SELECT cluster_id FROM s WHERE firm_id = 'company_1001'),
n AS (SELECT firm_id, count(*) AS n, count(*) FILTER (cluster_id IN (SELECT cluster_id FROM m)) AS shared FROM s GROUP BY firm_id)
SELECT firm_id, shared, round(shared / (n + (SELECT count(*) FROM m) - shared), 6) AS jaccard FROM n WHERE shared > 0 AND firm_id <> 'company_1001' AND round(shared / (n + (SELECT count(*) FROM m) - shared), 6) > 0.01""",
    "vector_quality": """
SELECT CASE WHEN embedding_v1 IS NULL THEN 'missing' WHEN len(embedding_v1) <> 64 THEN 'length' WHEN len(list_filter(embedding_v1, lambda x: x IS NULL OR isnan(x))) > 0 THEN 'nan' WHEN len(list_filter(embedding_v1, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'valid' END AS kind, count(*) AS n FROM patent_research_data GROUP BY 1""",
    "citation_network_bfs": """
WITH RECURSIVE e AS (SELECT citing_publication AS a, cited_publication AS b FROM patent_citations UNION SELECT cited_publication, citing_publication FROM patent_citations),
w AS (SELECT min(citing_publication) AS node, 0 AS level FROM patent_citations UNION SELECT e.b, w.level + 1 FROM w JOIN e ON w.node = e.a WHERE w.level < 2)
SELECT level, count(*) AS n FROM (SELECT node, CAST(min(level) AS INT) AS level FROM w GROUP BY node) GROUP BY level""",
    "citation_components": with_roles("""
WITH RECURSIVE e AS (SELECT citing AS a, cited AS b FROM cites UNION SELECT cited, citing FROM cites), w AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, w.c FROM w JOIN e ON w.node = e.a)
SELECT component, count(*) AS n FROM (SELECT node, min(c) AS component FROM w GROUP BY node) GROUP BY component"""),
    "network_clustering": """
WITH u AS (SELECT DISTINCT least(citing_publication, cited_publication) AS a, greatest(citing_publication, cited_publication) AS b FROM patent_citations WHERE citing_publication <> cited_publication), s AS (SELECT a, b FROM u UNION SELECT b, a FROM u), d AS (SELECT a AS node, count(*) AS degree FROM s GROUP BY a),
t AS (SELECT x.a AS a, x.b AS b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), p AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY node)
SELECT d.node, d.degree, coalesce(p.t, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(p.t, 0) / (degree * (degree - 1)) ELSE 0.0 END, 6) AS coefficient FROM d LEFT JOIN p USING (node)""",
    "text_ranked_search": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: x = 'antenna')) AS t0, len(list_filter(w, lambda x: x = 'gearbox')) AS t1, len(list_filter(w, lambda x: x = 'licensing')) AS t2 FROM w),
s AS (SELECT count(*) AS n, avg(l) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM c)
SELECT doc_id, round(ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / mean)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / mean)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * l / mean)), 6) AS score
FROM c, s WHERE t0 + t1 + t2 > 0 ORDER BY score DESC, doc_id LIMIT 200""",
    "patent_option_value": with_roles("""
WITH a AS (SELECT id, value, greatest(20.0::DOUBLE - (2005.0::DOUBLE - y), 0.5::DOUBLE) AS years FROM records), b AS (SELECT *, (ln(value / 100000.0::DOUBLE) + (0.02::DOUBLE + 0.045::DOUBLE) * years) / (0.3::DOUBLE * sqrt(years)) AS d1 FROM a), c AS (SELECT *, d1 - 0.3::DOUBLE * sqrt(years) AS d2 FROM b),
e AS (SELECT *, abs(d1) / sqrt(2) AS z1, abs(d2) / sqrt(2) AS z2 FROM c), f AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z1) AS t1, 1 / (1 + 0.3275911::DOUBLE * z2) AS t2 FROM e)
SELECT id, round(value * (CASE WHEN d1 >= 0 THEN (1 + 1 - t1 * (0.254829592 + t1 * (-0.284496736 + t1 * (1.421413741 + t1 * (-1.453152027 + t1 * 1.061405429)))) * exp(-z1 * z1)) / 2 ELSE (1 - (1 - t1 * (0.254829592 + t1 * (-0.284496736 + t1 * (1.421413741 + t1 * (-1.453152027 + t1 * 1.061405429)))) * exp(-z1 * z1))) / 2 END) - 100000 * exp(-0.02::DOUBLE * years) * (CASE WHEN d2 >= 0 THEN (1 + 1 - t2 * (0.254829592 + t2 * (-0.284496736 + t2 * (1.421413741 + t2 * (-1.453152027 + t2 * 1.061405429)))) * exp(-z2 * z2)) / 2 ELSE (1 - (1 - t2 * (0.254829592 + t2 * (-0.284496736 + t2 * (1.421413741 + t2 * (-1.453152027 + t2 * 1.061405429)))) * exp(-z2 * z2))) / 2 END), 2) AS option_value FROM f"""),
    "audit_hash_chain": "SELECT user_id, list_reduce(list_prepend('', list(coalesce(CAST(event_type AS VARCHAR), '') ORDER BY event_id, event_type)), lambda a, e: sha256(a || '|' || e)) AS head FROM events GROUP BY user_id",
    "stream_daily_counts": "WITH m AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events), w AS (SELECT DISTINCT event_type, date_trunc('day', ts) AS start FROM events) SELECT event_type, count(*) AS windows FROM w, m WHERE start + INTERVAL 1 DAY <= mark GROUP BY event_type",
    "upsert_orders": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'U' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END * o_totalprice), 0) AS total FROM orders GROUP BY 1",
    "insert_ignore_events": "SELECT count(DISTINCT user_id) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "stream_watch_alerts": "SELECT concat('w-', event_type) AS watch, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type HAVING count(*) >= 5",
}
