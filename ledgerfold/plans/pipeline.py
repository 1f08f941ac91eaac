"""Queries over the engine's functions and operators: search, portfolios, vectors, graphs, linking, loads and watches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerfold.api import Engine
from ledgerfold.catalog import table
from ledgerfold.functions.columns import cosine, fit_score, int_date, inverse_distance, overlap
from ledgerfold.operators import graph, linking, similar, simulate, text_search
from ledgerfold.plans.domain import with_roles
from ledgerfold.session import materialize, scratch_path
from ledgerfold.sources import tables as sinks
from ledgerfold.streaming import watch as watches


def _citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patent_citations").select(F.col("citing_publication").alias("src"), F.col("cited_publication").alias("dst"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Valid vectors of firms by year, one a year."""
    v = table(spark, d, "firm_tech_vectors").where("firm_id IS NOT NULL AND tech_vector IS NOT NULL AND size(tech_vector) = 64 AND NOT exists(tech_vector, x -> x IS NULL OR isnan(x)) AND exists(tech_vector, x -> x <> 0)")
    return v.groupBy("firm_id", "year").agg(F.max(F.struct("patent_count", "dominant_cpc", "tech_vector")).alias("m")).select("firm_id", "year", F.col("m.patent_count").alias("n"), F.col("m.dominant_cpc").alias("code"), F.col("m.tech_vector").alias("v"))


# search and portfolios
def patent_search_page(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).patent_search(query="sensor AND turbine", size=50).select("id", "how")


def patent_search_filters(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).patent_search(class_prefix="F31", jurisdiction="us", number=2, size=25).select("id")


def firm_portfolio_codes(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).firm_portfolio("company_1001", 30)


def co_applicants_all(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).co_applicants(least=2)


def applicant_network_levels(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).applicant_network("company_1001", 2)


def compare_firms(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).compare(["company_1001", "company_1038", "company_1075"])


def similar_firms_by_class(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).similar_firms("company_1001")


def class_landscape(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).landscape()


def ranking_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    r = Engine(spark, d).ranking(2999, firm="company_1001", top=10)
    return r.select("cluster_id", "firm_id", F.round("score", 6).alias("score"), "rank")


def delta_of_years(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).delta(2019, 2022).select("firm_id", "cluster_id", F.round("delta", 6).alias("delta"))


def citation_edges_capped(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "patent_citations").agg(F.min("citing_publication")).first()[0]
    return Engine(spark, d).citation_graph(first, 1, 50) if first else _citations(spark, d).withColumn("level", F.lit(0)).limit(0)


def user_categories(spark: SparkSession, d: str) -> DataFrame:
    return Engine(spark, d).categorise([("power", "class", "F31H"), ("power", "keyword", "electrode"), ("sensing", "class", "G5"), ("sensing", "keyword", "sensor")])


# linking of names
def owners_linked(spark: SparkSession, d: str) -> DataFrame:
    """Typed owner names against the tidied ones: level and best ratio of each."""
    a = table(spark, d, "patent_assignees")
    typed = a.select(F.regexp_replace("raw_name", "[^ -~]", "?").alias("raw_name"))
    register = a.where("firm_id IS NOT NULL").select("firm_id", F.regexp_replace("harmonized_name", "[^ -~]", "?").alias("harmonized_name"))
    return linking.link_names(typed, "raw_name", register, "firm_id", "harmonized_name", {"MVGA GmbH": "company_1075"}, compatibility=False)


def link_levels(spark: SparkSession, d: str) -> DataFrame:
    return owners_linked(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 4).alias("mean_ratio"))


def compatible_names(spark: SparkSession, d: str) -> DataFrame:
    """Owner names in Unicode compatibility form with their company key."""
    return table(spark, d, "patent_assignees").select("raw_name").distinct().select("raw_name", linking.nfkc("raw_name").alias("plain"), linking.company_key(F.col("raw_name")).alias("key"))


# vectors
def firm_vectors_decayed(spark: SparkSession, d: str) -> DataFrame:
    m = similar.decayed_means(_vectors(spark, d), "firm_id", "year", "v", "n")
    return m.select("firm_id", "year", F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), F.round(F.element_at("vec", 1), 6).alias("first"))


def vector_velocity(spark: SparkSession, d: str) -> DataFrame:
    v = similar.velocities(_vectors(spark, d), "firm_id", "year", "v")
    return v.select("firm_id", "year", F.round("velocity", 6).alias("velocity"))


def clusters_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    """k-means of the firm vectors within every section, k by silhouette."""
    v = _vectors(spark, d).select(F.substring("code", 1, 1).alias("section"), F.concat_ws(":", "firm_id", "year").alias("key"), "v")
    c = similar.kmeans_in_groups(v, "section", "key", "v", most=4, rounds=4)
    return c.groupBy("section", "cluster", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("silhouette"), 6).alias("silhouette"))


def score_surface(spark: SparkSession, d: str) -> DataFrame:
    """Fit of every firm-year with the centre of every section: cosine, distance and class; 0 where the gate is closed."""
    v = _vectors(spark, d).where("code IS NOT NULL")
    centres = similar.centroids(v.select(F.substring("code", 1, 1).alias("section"), "v"), "section", "v").select("section", "centre")
    pairs = v.join(F.broadcast(centres))  # one row a section, nine at most
    same = (F.substring("code", 1, 1) == F.col("section")).cast("double")
    score = fit_score(cosine(F.col("v"), F.col("centre")), inverse_distance(F.col("v"), F.col("centre")), same)
    return pairs.select("firm_id", "year", "section", F.round(score, 6).alias("score"))


def text_to_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Words to a vector (mean of the best hits), and the vector to the nearest classes."""
    r = table(spark, d, "patent_research_data").where("embedding_v1 IS NOT NULL AND size(embedding_v1) = 64 AND NOT exists(embedding_v1, x -> x IS NULL OR isnan(x))").dropDuplicates(["publication_number"])
    r = r.select("publication_number", F.concat_ws(" ", "title_en", "abstract_en").alias("text"), F.col("embedding_v1").alias("v"))
    hits = text_search.bm25(r, "publication_number", "text", ["turbine", "sensor"])
    ranked = hits.orderBy(F.desc("score"), "doc_id").limit(200).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))).withColumnRenamed("doc_id", "publication_number")
    centre = text_search.text_vector(ranked, r, "publication_number", "v")
    classes = Engine(spark, d).classes().select(F.col("id").alias("publication_number"), F.substring("code", 1, 4).alias("code4")).distinct()
    clusters = similar.centroids(r.join(classes, "publication_number").select("code4", "v"), "code4", "v")
    return text_search.vector_clusters(centre, clusters, "code4", 10, -1.0)


def class_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of a firm's classes that its records of the first office hold too."""
    e = Engine(spark, d)
    m = e.owners().join(e.classes(), "id").select("firm", F.substring("code", 1, 4).alias("code"), F.startswith("id", F.lit("US-")).alias("us"))
    sets = m.groupBy("firm").agg(F.collect_set("code").alias("a"), F.collect_set(F.when(F.col("us"), F.col("code"))).alias("b"))
    return sets.select("firm", F.round(overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


# graphs
def paths_from_hubs(spark: SparkSession, d: str) -> DataFrame:
    c = _citations(spark, d)
    hubs = c.where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("n")).orderBy(F.desc("n"), "node").limit(3)
    return graph.path_lengths(c, hubs, 3).groupBy("source", "hops").agg(F.count(F.lit(1)).alias("n"))


def communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation(_citations(spark, d), 2)


def network_resilience(spark: SparkSession, d: str) -> DataFrame:
    return graph.percolation(_citations(spark, d), [0.0, 0.01, 0.05])


def small_world_index(spark: SparkSession, d: str) -> DataFrame:
    c = _citations(spark, d)
    s = graph.small_world(c, c.agg(F.min("src").alias("node")), 3)
    return s.select(*[F.round(x, 5).alias(x) for x in ("clustering", "path_length", "density", "index")])


# finance
def npv_of_firms(spark: SparkSession, d: str) -> DataFrame:
    g = Engine(spark, d).scores().groupBy("firm_id").agg(F.count(F.lit(1)).cast("double").alias("income"), F.avg("score").alias("growth"), F.coalesce(F.stddev_samp("score"), F.lit(0.02)).alias("spread"))
    return simulate.npv_paths(g.withColumn("growth", F.col("growth") / 10), "firm_id", "income", "growth", "spread", paths=1000)


# sources and sinks
def csv_with_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Declarations through a CSV whose header names the columns otherwise."""
    path = scratch_path(spark, "csv")
    s = table(spark, d, "sep_declarations")
    sinks.export(s.select(F.col("declaration_id").alias("Decl ID"), F.col("standard_name").alias("Standard"), F.col("standard_org").alias("SDO")), path)
    back = sinks.read_csv(spark, path, {"id": ["declaration_id", "decl id"], "standard": ["standard_name", "standard"], "org": ["organisation", "sdo"], "extra": ["none"]})
    return back.groupBy("org").agg(F.count("id").alias("n"), F.count("standard").alias("named"), F.count("extra").alias("extra"))


def json_export(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "json")
    sinks.export(table(spark, d, "region"), path, "json")
    return spark.read.json(path).select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"), "r_name")


def partitions_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Bulk load by year, then one year replaced: the others stay."""
    path = scratch_path(spark, "partitions")
    s = Engine(spark, d).scores()
    sinks.bulk_insert(s, path, "year")
    sinks.replace_partitions(s.where("year = 2022").withColumn("score", F.lit(0.0)), path, "year")
    return spark.read.parquet(path).groupBy(F.col("year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("total"))


def nested_terms(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "patent_research_data").select("publication_number", "top_terms").distinct()
    return sinks.explode_nested(r, "publication_number", "top_terms").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def number_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists typed as JSON or with separators, read the same way."""
    s = table(spark, d, "sep_declarations").where("standard_name IS NOT NULL AND patent_number IS NOT NULL")
    typed = F.when(F.col("declaration_id") % 2 == 0, F.to_json(F.array("declarant", "standard_name"))).otherwise(F.concat_ws(" ; ", F.lit("x"), F.lit("y"), F.lit("z")))
    return s.select("declaration_id", F.size(sinks.text_list(typed)).alias("n"))


def research_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one office, read with the filter and two columns only."""
    r = table(spark, d, "patent_research_data").where(F.startswith("publication_number", F.lit("US-"))).select("publication_number", F.coalesce(F.size("embedding_v1"), F.lit(-1)).alias("dim")).distinct()
    return r.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))


def company_master_list(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "patent_assignees").where("harmonized_name IS NOT NULL").select(F.regexp_replace("harmonized_name", "[^ -~]", "?").alias("name")).distinct()
    return sinks.company_master(s, "name", linking.company_key(F.col("name"), compatibility=False))


def resumed_loads(spark: SparkSession, d: str) -> DataFrame:
    """Two loads of growing events: the second takes only what is newer, a third nothing."""
    root = scratch_path(spark, "resume")
    e = table(spark, d, "events").select(F.col("event_id").cast("bigint").alias("event_id"), "event_type")
    middle = e.agg(F.expr("(min(event_id) + max(event_id)) div 2").alias("m")).first()["m"] or 0
    landing, target = f"{root}/landing", f"{root}/target"
    log = spark.createDataFrame([], "source string, mark bigint, rows bigint")
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle, F.lit(False)):
        e.where(part).write.mode("append").parquet(landing)
        log = log.unionByName(sinks.load_new(sinks.ParquetSource(landing, "event_id"), spark, log, "events", target, "event_id"))
    return spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


def children_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Orders upserted with their lines: those of orders that came again are replaced as a whole."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("version"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    new = o.where("status = 'F'").withColumn("status", F.lit("N")).withColumn("version", F.lit(1))
    fresh = new.select("o_orderkey", F.lit(1).cast(lines.schema["l_linenumber"].dataType).alias("l_linenumber"))
    parents, children = sinks.upsert_with_children(o, lines, new, fresh, "o_orderkey", "version")
    return parents.join(children, "o_orderkey", "left").groupBy("status").agg(F.count_distinct("o_orderkey").alias("orders"), F.count("l_linenumber").alias("lines"))


def dates_of_ints(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("i"))
    return o.select("o_orderkey", F.date_format(int_date(F.col("i")), "yyyy-MM-dd").alias("iso"))


# watches
def watch_polls(spark: SparkSession, d: str) -> DataFrame:
    """Two polls over owners by id, the second repeated: alerts by watch, each once."""
    a = table(spark, d, "patent_assignees")
    first = Engine(spark, d).classes().groupBy("id").agg(F.min("code").alias("code"))
    titles = Engine(spark, d).records().groupBy("id").agg(F.max("title").alias("title"))
    rows = a.select(F.col("publication_number").alias("id"), F.col("id").alias("at"), "raw_name", "firm_id").join(first, "id", "left").join(titles, "id", "left")
    rows = materialize(rows, "watch-rows")
    w = spark.createDataFrame([("w1", "applicant", "Materials", 5, None), ("w2", "class", "F31", 5, None), ("w3", "keyword", "sensor", 5, None), ("w4", "competitor", "company_1038", 5, None)], "watch string, kind string, value string, least int, last_checked bigint")
    last = rows.agg(F.max("at")).first()[0] or 0
    alerts = spark.createDataFrame([], watches.ALERTS)
    for until in (last // 2, last, last):
        w, alerts = watches.poll(rows, w, alerts, until, "raw_name", "code", "title", "firm_id")
    return alerts.groupBy("watch").agg(F.count(F.lit(1)).alias("alerts"), F.sum("n").alias("rows"))


QUERIES = {f.__name__: f for f in (
    patent_search_page, patent_search_filters, firm_portfolio_codes, co_applicants_all, applicant_network_levels, compare_firms, similar_firms_by_class, class_landscape, ranking_with_fallback, delta_of_years,
    citation_edges_capped, user_categories, owners_linked, link_levels, compatible_names, firm_vectors_decayed, vector_velocity, clusters_of_vectors, score_surface, text_to_clusters, class_set_overlap, paths_from_hubs,
    communities, network_resilience, small_world_index, npv_of_firms, csv_with_synonyms, json_export, partitions_replaced, nested_terms, number_lists, research_vectors, company_master_list, resumed_loads,
    children_replaced, dates_of_ints, watch_polls)}

_EDGES = "e AS (SELECT citing_publication AS a, cited_publication AS b FROM patent_citations WHERE citing_publication <> cited_publication UNION SELECT cited_publication, citing_publication FROM patent_citations WHERE citing_publication <> cited_publication)"
_TEXT = "lower(concat_ws(' ', title_en, abstract_en))"
_VALID = "vectors AS (SELECT firm_id, year, max_by(dominant_cpc, patent_count) AS code, max(patent_count) AS n, any_value(tech_vector) AS v FROM firm_tech_vectors WHERE firm_id IS NOT NULL AND tech_vector IS NOT NULL AND len(tech_vector) = 64 AND len(list_filter(tech_vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(tech_vector, lambda x: x <> 0)) > 0 GROUP BY firm_id, year)"
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower({0}), '株式会社', ' '), '有限会社', ' '), '&', ' and ', 'g'), '[.,''()/-]+', ' ', 'g'), ' +', ' ', 'g'))"
_FORMS = " (" + "|".join(linking.SUFFIXES) + ")$"


def _key(column: str) -> str:
    k = f"regexp_replace({_KEY.format(column)}, '^the ', '')"
    for _ in range(linking.PASSES):
        k = f"trim(regexp_replace({k}, '{_FORMS}', ''))"
    return k


SQL = {
    "patent_search_page": f"""
WITH t AS (SELECT DISTINCT publication_number AS id, {_TEXT} AS t FROM patent_research_data WHERE publication_number IS NOT NULL),
s AS (SELECT id, min(CASE WHEN contains(t, 'sensor') AND contains(t, 'turbine') THEN 0 WHEN contains(t, 'sensor') OR contains(t, 'turbine') THEN 1 END) AS step FROM t GROUP BY id)
SELECT id, CASE WHEN step = 0 THEN 'all' ELSE 'any' END AS how FROM s WHERE step = (SELECT min(step) FROM s) ORDER BY id DESC LIMIT 50""",
    "patent_search_filters": with_roles("SELECT id FROM (SELECT DISTINCT publication_number AS id FROM patent_research_data) WHERE id IN (SELECT id FROM classes WHERE code LIKE 'F31%') AND id LIKE 'US-%' ORDER BY id DESC LIMIT 25 OFFSET 25"),
    "firm_portfolio_codes": with_roles("SELECT c.code, count(*) AS n FROM classes c JOIN holders h ON h.id = c.id WHERE h.firm = 'company_1001' GROUP BY c.code ORDER BY n DESC, c.code LIMIT 30"),
    "co_applicants_all": with_roles("SELECT a.firm AS firm_a, b.firm AS firm_b, count(*) AS shared FROM holders a JOIN holders b ON a.id = b.id AND a.firm < b.firm GROUP BY 1, 2 HAVING count(*) >= 2"),
    "applicant_network_levels": with_roles("""
WITH RECURSIVE pairs AS (SELECT DISTINCT a.firm AS x, b.firm AS y FROM holders a JOIN holders b ON a.id = b.id AND a.firm <> b.firm), w AS (SELECT 'company_1001' AS node, 0 AS level UNION SELECT p.y, w.level + 1 FROM w JOIN pairs p ON p.x = w.node WHERE w.level < 2)
SELECT node, CAST(min(level) AS INT) AS level FROM w GROUP BY node"""),
    "compare_firms": with_roles("SELECT substr(c.code, 1, 4) AS code, string_agg(DISTINCT h.firm, ',' ORDER BY h.firm) AS firms, count(DISTINCT h.firm) AS n_firms FROM holders h JOIN classes c ON c.id = h.id WHERE h.firm IN ('company_1001', 'company_1038', 'company_1075') GROUP BY 1"),
    "similar_firms_by_class": with_roles("""
WITH m AS (SELECT DISTINCT h.firm, c.code4 FROM holders h JOIN classes c ON c.id = h.id), mine AS (SELECT code4 FROM m WHERE firm = 'company_1001'), n AS (SELECT firm, count(*) AS n, count(*) FILTER (code4 IN (SELECT code4 FROM mine)) AS shared FROM m GROUP BY firm)
SELECT firm, shared, round(shared / (n + (SELECT count(*) FROM mine) - shared), 6) AS jaccard FROM n WHERE shared > 0 AND firm <> 'company_1001' AND round(shared / (n + (SELECT count(*) FROM mine) - shared), 6) >= 0.01"""),
    "class_landscape": with_roles("""
WITH k AS (SELECT DISTINCT id, code4 FROM classes), t AS (SELECT count(*) AS total FROM k)
SELECT k.code4 AS code, count(DISTINCT k.id) AS records, count(DISTINCT h.firm) AS firms, round(count(DISTINCT k.id) / max(total), 6) AS share FROM k CROSS JOIN t LEFT JOIN holders h ON h.id = k.id GROUP BY k.code4"""),
    "ranking_with_fallback": with_roles("""
WITH s AS (SELECT * FROM scores WHERE firm_id = 'company_1001'), y AS (SELECT year, count(*) AS n FROM s GROUP BY year), best AS (SELECT max(year) AS year FROM y WHERE n >= greatest(1, floor(0.9 * (SELECT max(n) FROM y))))
SELECT cluster_id, firm_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, firm_id, cluster_id) AS rank FROM s WHERE year = (SELECT year FROM best)) WHERE rank <= 10"""),
    "delta_of_years": with_roles("""
SELECT coalesce(a.firm_id, b.firm_id) AS firm_id, coalesce(a.cluster_id, b.cluster_id) AS cluster_id, round(coalesce(b.score, 0) - coalesce(a.score, 0), 6) AS delta
FROM (SELECT * FROM scores WHERE year = 2019) a FULL OUTER JOIN (SELECT * FROM scores WHERE year = 2022) b ON a.firm_id = b.firm_id AND a.cluster_id = b.cluster_id WHERE abs(coalesce(b.score, 0) - coalesce(a.score, 0)) >= 1e-4"""),
    "citation_edges_capped": f"""
WITH {_EDGES}, s AS (SELECT min(citing_publication) AS node FROM patent_citations), near AS (SELECT b AS node FROM e WHERE a = (SELECT node FROM s) ORDER BY b LIMIT 50), seen AS (SELECT node FROM near UNION SELECT node FROM s)
SELECT DISTINCT citing_publication AS src, cited_publication AS dst, CAST(1 AS INT) AS level FROM patent_citations, s WHERE citing_publication <> cited_publication AND citing_publication IN (SELECT node FROM seen) AND cited_publication IN (SELECT node FROM seen) AND (citing_publication = s.node OR cited_publication = s.node)""",
    "user_categories": with_roles(f"""
WITH r AS (SELECT * FROM (VALUES ('power', 'F31H', 'electrode'), ('sensing', 'G5', 'sensor')) t(category, prefix, word)), c AS (SELECT DISTINCT r.category, k.id, CASE WHEN length(r.prefix) >= 4 THEN 0.9 ELSE 0.7 END AS c FROM r JOIN classes k ON starts_with(k.code, r.prefix)),
w AS (SELECT DISTINCT r.category, publication_number AS id FROM r JOIN patent_research_data p ON contains({_TEXT}, r.word))
SELECT coalesce(c.category, w.category) AS category, coalesce(c.id, w.id) AS id, CAST(CASE WHEN c.id IS NOT NULL AND w.id IS NOT NULL THEN 0.95 WHEN c.id IS NOT NULL THEN c.c ELSE 0.6 END AS DOUBLE) AS confidence FROM c FULL OUTER JOIN w ON c.category = w.category AND c.id = w.id"""),
    "firm_vectors_decayed": f"""
WITH {_VALID}, s AS (SELECT firm_id, year AS y, sqrt(greatest(coalesce(n, 0), 1)) AS w, unnest(v) AS x, unnest(range(0, 64)) AS pos FROM vectors), t AS (SELECT DISTINCT firm_id, year AS at FROM vectors),
m AS (SELECT s.firm_id, t.at AS year, pos, sum(w * exp(-0.1 * (t.at - y)) * x) / sum(w * exp(-0.1 * (t.at - y))) AS m FROM s JOIN t ON t.firm_id = s.firm_id AND s.y <= t.at GROUP BY ALL)
SELECT firm_id, year, round(sqrt(sum(m * m)), 6) AS norm, round(max(CASE WHEN pos = 0 THEN m END), 6) AS first FROM m GROUP BY firm_id, year""",
    "vector_velocity": f"""
WITH {_VALID}, l AS (SELECT firm_id, year, v, lag(v) OVER w AS b, lag(year) OVER w AS y FROM vectors WINDOW w AS (PARTITION BY firm_id ORDER BY year))
SELECT firm_id, year, CASE WHEN y = year - 1 THEN round(list_distance(v, b), 6) END AS velocity FROM l""",
    "score_surface": f"""
WITH {_VALID}, k AS (SELECT firm_id, year, code, v FROM vectors WHERE code IS NOT NULL), p AS (SELECT substr(code, 1, 1) AS section, unnest(v) AS x, unnest(range(0, 64)) AS pos FROM k), m AS (SELECT section, pos, avg(x) AS m FROM p GROUP BY section, pos), c AS (SELECT section, list(m ORDER BY pos) AS centre FROM m GROUP BY section),
f AS (SELECT firm_id, year, section, list_cosine_similarity(v, centre) AS cs, 1 / (1 + list_distance(v, centre)) AS inv, CASE WHEN substr(code, 1, 1) = section THEN 1.0 ELSE 0.0 END AS same FROM k, c)
SELECT firm_id, year, section, round(CASE WHEN same > 0.01 OR cs > 0.3 THEN 1 / (1 + exp(-(-4 + 6 * cs + 3 * inv + 2 * same))) ELSE 0 END, 6) AS score FROM f""",
    "class_set_overlap": with_roles("""
WITH m AS (SELECT DISTINCT h.firm, c.code4, h.id LIKE 'US-%' AS us FROM holders h JOIN classes c ON c.id = h.id) SELECT firm, round(count(DISTINCT CASE WHEN us THEN code4 END) / CAST(count(DISTINCT code4) AS DOUBLE), 6) AS overlap FROM m GROUP BY firm"""),
    "paths_from_hubs": f"""
WITH RECURSIVE {_EDGES}, h AS (SELECT citing_publication AS node FROM patent_citations WHERE citing_publication <> cited_publication GROUP BY 1 ORDER BY count(DISTINCT cited_publication) DESC, 1 LIMIT 3),
w AS (SELECT node AS source, node, 0 AS hops FROM h UNION SELECT w.source, e.b, w.hops + 1 FROM w JOIN e ON e.a = w.node WHERE w.hops < 3)
SELECT source, hops, count(*) AS n FROM (SELECT source, node, CAST(min(hops) AS INT) AS hops FROM w GROUP BY source, node) GROUP BY source, hops""",
    "communities": f"""
WITH {_EDGES}, l1 AS (SELECT a AS node, min(b) AS label FROM e GROUP BY a),
v2 AS (SELECT e.a, l1.label, count(*) AS n FROM e JOIN l1 ON l1.node = e.b GROUP BY e.a, l1.label) SELECT a AS node, label FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, label) AS rn FROM v2) WHERE rn = 1""",
    "small_world_index": f"""
WITH RECURSIVE {_EDGES}, d AS (SELECT a AS node, count(*) AS k FROM e GROUP BY a), t AS (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b AND x.b < y.b),
p AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY node), cc AS (SELECT avg(CASE WHEN k > 1 THEN 2.0 * coalesce(p.t, 0) / (k * (k - 1)) ELSE 0 END) AS clustering, count(*) AS n, avg(k) AS mean_degree FROM d LEFT JOIN p USING (node)),
w AS (SELECT min(citing_publication) AS node, 0 AS hops FROM patent_citations UNION SELECT e.b, w.hops + 1 FROM w JOIN e ON e.a = w.node WHERE w.hops < 3), l AS (SELECT avg(h) AS path_length FROM (SELECT node, min(hops) AS h FROM w GROUP BY node) WHERE h > 0)
SELECT round(clustering, 5) AS clustering, round(path_length, 5) AS path_length, round(mean_degree / (n - 1), 5) AS density, round((clustering / (mean_degree / (n - 1))) / (path_length / (ln(n) / ln(mean_degree))), 5) AS index FROM cc, l""",
    "csv_with_synonyms": "SELECT standard_org AS org, count(*) AS n, count(standard_name) AS named, CAST(0 AS BIGINT) AS extra FROM sep_declarations GROUP BY standard_org",
    "json_export": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region",
    "partitions_replaced": with_roles("SELECT CAST(year AS INT) AS year, count(*) AS n, round(sum(CASE WHEN year = 2022 THEN 0 ELSE score END), 3) AS total FROM scores GROUP BY year"),
    "nested_terms": "SELECT item, count(*) AS n FROM (SELECT publication_number, unnest(top_terms) AS item FROM (SELECT DISTINCT publication_number, top_terms FROM patent_research_data)) GROUP BY item",
    "number_lists": "SELECT declaration_id, CAST(CASE WHEN declaration_id % 2 = 0 THEN 2 ELSE 3 END AS INT) AS n FROM sep_declarations WHERE standard_name IS NOT NULL AND patent_number IS NOT NULL",
    "research_vectors": "SELECT dim, count(*) AS n FROM (SELECT DISTINCT publication_number, CAST(coalesce(len(embedding_v1), -1) AS INT) AS dim FROM patent_research_data WHERE publication_number LIKE 'US-%') GROUP BY dim",
    "company_master_list": f"WITH s AS (SELECT DISTINCT regexp_replace(harmonized_name, '[^ -~]', '?', 'g') AS name FROM patent_assignees WHERE harmonized_name IS NOT NULL), k AS (SELECT name, {_key('name')} AS key FROM s) SELECT key, min(name) AS name, count(*) AS n FROM k WHERE key <> '' GROUP BY key",
    "resumed_loads": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type",
    "children_replaced": "WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN o_orderstatus = 'F' THEN 'N' ELSE o_orderstatus END AS status, count(*) AS orders, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE coalesce(l.n, 0) END) AS BIGINT) AS lines FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1",
    "dates_of_ints": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
    "watch_polls": with_roles("""
WITH f AS (SELECT id, min(code) AS code FROM classes GROUP BY id), t AS (SELECT publication_number AS id, lower(max(title_en)) AS title FROM patent_research_data GROUP BY 1),
r AS (SELECT a.publication_number AS id, a.id <= (SELECT max(id) // 2 FROM patent_assignees) AS early, lower(raw_name) AS name, firm_id, coalesce(f.code, '') AS code, coalesce(t.title, '') AS title FROM patent_assignees a LEFT JOIN f ON f.id = a.publication_number LEFT JOIN t ON t.id = a.publication_number),
m AS (SELECT 'w1' AS watch, id, early FROM r WHERE name LIKE '%materials%' UNION ALL SELECT 'w2', id, early FROM r WHERE code LIKE 'F31%' UNION ALL SELECT 'w3', id, early FROM r WHERE title LIKE '%sensor%' UNION ALL SELECT 'w4', id, early FROM r WHERE firm_id = 'company_1038' OR name LIKE '%company_1038%'),
c AS (SELECT watch, early, count(DISTINCT id) AS n FROM m GROUP BY watch, early HAVING count(DISTINCT id) >= 5) SELECT watch, count(*) AS alerts, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY watch"""),
}
_LINK = f"""
WITH n AS (SELECT DISTINCT regexp_replace(raw_name, '[^ -~]', '?', 'g') AS name FROM patent_assignees WHERE raw_name IS NOT NULL), nk AS (SELECT name, {_key('name')} AS key FROM n WHERE trim(name) <> ''),
r AS (SELECT firm_id AS entity, regexp_replace(harmonized_name, '[^ -~]', '?', 'g') AS registered FROM patent_assignees WHERE firm_id IS NOT NULL AND harmonized_name IS NOT NULL), bn AS (SELECT registered AS name, min(entity) AS e FROM r GROUP BY 1),
bk AS (SELECT key, min(entity) AS e FROM (SELECT entity, {_key('registered')} AS key FROM (SELECT DISTINCT entity, registered FROM r)) WHERE key <> '' GROUP BY key),
st AS (SELECT nk.name, nk.key, CASE WHEN nk.name = 'MVGA GmbH' THEN 'company_1075' END AS g, bn.e AS x, bk.e AS k FROM nk LEFT JOIN bn ON bn.name = nk.name LEFT JOIN bk ON bk.key = nk.key),
a AS (SELECT name, key AS own, array_to_string(list_sort(string_split(key, ' ')), ' ') AS p FROM st WHERE g IS NULL AND x IS NULL AND k IS NULL AND key <> ''),
b AS (SELECT array_to_string(list_sort(string_split(key, ' ')), ' ') AS q, min(e) AS e FROM bk GROUP BY 1), z AS (SELECT name, own, e, round(1 - levenshtein(p, q) / greatest(length(p), length(q)), 6) AS ratio FROM a JOIN b ON abs(length(p) - length(q)) <= 0.16 * greatest(length(p), length(q))),
fz AS (SELECT name, e, ratio FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, e) AS rn FROM z WHERE ratio >= CASE WHEN length(own) < 6 THEN 0.95 ELSE 0.84 END) WHERE rn = 1),
linked AS (SELECT st.name, coalesce(g, x, k, fz.e) AS entity, CASE WHEN g IS NOT NULL THEN 'override' WHEN x IS NOT NULL THEN 'exact' WHEN k IS NOT NULL THEN 'normalised' WHEN fz.e IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS level, CASE WHEN coalesce(g, x, k) IS NOT NULL THEN 1.0 ELSE coalesce(fz.ratio, 0.0) END AS ratio FROM st LEFT JOIN fz ON fz.name = st.name AND coalesce(g, x, k) IS NULL)
"""
SQL["owners_linked"] = _LINK + "SELECT name, entity, level, ratio FROM linked"
SQL["link_levels"] = _LINK + "SELECT level, count(*) AS n, round(avg(ratio), 4) AS mean_ratio FROM linked GROUP BY level"
