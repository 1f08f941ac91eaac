"""The engine as functions: every call names its tables by role, takes its own arguments and gives a lazy DataFrame.

    from ledgerfold.api import Engine
    e = Engine(spark, "/path/to/tables")
    e.patent_search(query="antenna", class_prefix="F31", jurisdiction="US", page=2).show()

Arguments left out, empty or 0 are no filter. Pages hold 1 to 100 rows. Orders are total, so that pages don't overlap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerfold.catalog import table
from ledgerfold.operators.graph import bfs, bfs_edges
from ledgerfold.operators.linking import link_names
from ledgerfold.operators.similar import set_similarity
from ledgerfold.operators.text_search import matches, sanitise, search_variants

MOST = 100


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered result; numbers and sizes out of range are moved into it."""
    size = min(max(int(size or 20), 1), MOST)
    return df.orderBy(*order).offset((max(int(number or 1), 1) - 1) * size).limit(size)


def page_count(total: int, size: int = 20) -> int:
    size = min(max(int(size or 20), 1), MOST)
    return max(1, -(-int(total) // size))


class Engine:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    # roles
    def records(self) -> DataFrame:
        return self.table("patent_research_data").select(F.col("publication_number").alias("id"), F.col("title_en").alias("title"), F.col("abstract_en").alias("abstract")).where("id IS NOT NULL").distinct()

    def classes(self) -> DataFrame:
        code = F.upper(F.replace(F.col("cpc_code"), F.lit(" "), F.lit("")))
        return self.table("patent_cpc").select(F.col("publication_number").alias("id"), code.alias("code")).where("id IS NOT NULL AND code <> ''").distinct()

    def owners(self) -> DataFrame:
        return self.table("patent_assignees").select(F.col("publication_number").alias("id"), F.col("firm_id").alias("firm")).where("id IS NOT NULL AND firm IS NOT NULL").distinct()

    def scores(self) -> DataFrame:
        s = self.table("startability_surface").where("firm_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1")
        return s.groupBy("firm_id", "cluster_id", "year").agg(F.max("score").alias("score"))

    # search
    def patent_search(self, query: str | None = None, class_prefix: str | None = None, owner: str | None = None, jurisdiction: str | None = None, number: int = 1, size: int = 20, fallback: bool = True) -> DataFrame:
        """(id, title, how): records that meet all that is asked; `how` tells which variant of the query found them.

        All filters act before the page is cut. A query without words finds nothing; with *fallback* weaker variants are tried.
        """
        r = self.records()
        if query:
            text = F.concat_ws(" ", "title", "abstract")
            if fallback:
                r = r.join(search_variants(r, "id", text, query).select("id", "how"), "id")
            else:
                r = r.where(matches(text, "all", sanitise(query) or [])).withColumn("how", F.lit("all"))
        else:
            r = r.withColumn("how", F.lit(""))
        filters = []
        if class_prefix:
            filters.append(self.classes().where(F.startswith(F.col("code"), F.lit(class_prefix.upper()))).select("id"))
        if owner:
            filters.append(self.owners().where(F.col("firm") == owner).select("id"))
        for f in filters:
            r = r.join(f, "id", "left_semi")
        if jurisdiction:
            r = r.where(F.startswith(F.col("id"), F.lit(jurisdiction.upper() + "-")))
        return page(r.groupBy("id").agg(F.max("title").alias("title"), F.max("how").alias("how")), [F.desc("id")], number, size)

    def patent_detail(self, id: str) -> DataFrame:
        """(id, title, codes, owners, cites, cited_by) of one record, lists in order; nothing for an unknown one."""
        one = self.records().where(F.col("id") == id).groupBy("id").agg(F.max("title").alias("title"))
        codes = self.classes().where(F.col("id") == id).groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
        owners = self.owners().where(F.col("id") == id).groupBy("id").agg(F.array_sort(F.collect_set("firm")).alias("owners"))
        c = self.table("patent_citations")
        cites = c.where(F.col("citing_publication") == id).groupBy(F.col("citing_publication").alias("id")).agg(F.count_distinct("cited_publication").alias("cites"))
        cited = c.where(F.col("cited_publication") == id).groupBy(F.col("cited_publication").alias("id")).agg(F.count_distinct("citing_publication").alias("cited_by"))
        out = reduce(lambda a, b: a.join(b, "id", "left"), (codes, owners, cites, cited), one)
        return out.select("id", "title", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), F.coalesce("owners", F.array().cast("array<string>")).alias("owners"), F.coalesce("cites", F.lit(0)).alias("cites"), F.coalesce("cited_by", F.lit(0)).alias("cited_by"))

    def entity_resolve(self, names: list[str], register: DataFrame | None = None) -> DataFrame:
        """(name, entity, level, ratio) of names against a register(firm_id, raw_name); the owners' own names by default."""
        known = register if register is not None else self.table("patent_assignees").select("firm_id", "raw_name")
        return link_names(self.spark.createDataFrame([(n,) for n in names], "name string"), "name", known, "firm_id", "raw_name")

    # portfolios
    def firm_portfolio(self, firm: str, top: int = 20) -> DataFrame:
        """(code, n): class histogram of a firm."""
        mine = self.owners().where(F.col("firm") == firm).select("id")
        return self.classes().join(mine, "id", "left_semi").groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(top)

    def co_applicants(self, firm: str | None = None, least: int = 1) -> DataFrame:
        """(firm_a, firm_b, shared): pairs of firms that own records together; of one firm, or all.

        Owners are distinct, so the count of joined rows is the count of records; the filter on the firm acts before the join.
        """
        o = self.owners()
        a = o.select("id", F.col("firm").alias("firm_a"))
        if firm:
            a = a.where(F.col("firm_a") == firm)
        b = o.select("id", F.col("firm").alias("firm_b"))
        apart = F.col("firm_a") != F.col("firm_b") if firm else F.col("firm_a") < F.col("firm_b")
        return a.join(b, "id").where(apart).groupBy("firm_a", "firm_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)

    def applicant_network(self, firm: str, depth: int = 2, least: int = 1) -> DataFrame:
        """(node, level) of firms reached over co-ownership from one firm."""
        edges = self.co_applicants(least=least).select(F.col("firm_a").alias("src"), F.col("firm_b").alias("dst"))
        return bfs(edges, self.spark.createDataFrame([(firm,)], "node string"), depth)

    def compare(self, firms: list[str], digits: int = 4) -> DataFrame:
        """(code, firms, n_firms): classes of the firms, cut to so many characters, and who of them holds each."""
        o = self.owners().where(F.col("firm").isin(firms))
        c = self.classes().select("id", F.substring("code", 1, digits).alias("code"))
        return c.join(o, "id").groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("firm")), ",").alias("firms"), F.count_distinct("firm").alias("n_firms"))

    def similar_firms(self, firm: str, least: float = 0.01) -> DataFrame:
        """(firm, shared, jaccard) by the classes (four characters) of their records."""
        members = self.owners().join(self.classes(), "id").select("firm", F.substring("code", 1, 4).alias("code")).distinct()
        return set_similarity(members, "firm", "code", firm).where(F.col("jaccard") >= least)

    # landscapes
    def landscape(self, prefix: str | None = None, digits: int = 4) -> DataFrame:
        """(code, records, firms, share): records and owners by class below a prefix."""
        c = self.classes()
        if prefix:
            c = c.where(F.startswith(F.col("code"), F.lit(prefix.upper())))
        c = c.select("id", F.substring("code", 1, digits).alias("code")).distinct()
        by = c.groupBy("code").agg(F.count(F.lit(1)).alias("records"))
        firms = c.join(self.owners(), "id").groupBy("code").agg(F.count_distinct("firm").alias("firms"))
        total = by.agg(F.sum("records").alias("total"))  # one row
        return by.join(firms, "code", "left").join(F.broadcast(total)).select("code", "records", F.coalesce("firms", F.lit(0)).alias("firms"), F.round(F.col("records") / F.col("total"), 6).alias("share"))

    def ranking(self, year: int, cluster: str | None = None, firm: str | None = None, top: int = 20) -> DataFrame:
        """(cluster_id, firm_id, score, rank): the best firms of every cluster, or of one, or the best clusters of a firm.

        A year of fewer than min(3, top) rows gives way to the latest one with at least 90 % of the rows of the fullest.
        """
        s = self.scores()
        if cluster:
            s = s.where(F.col("cluster_id") == cluster)
        if firm:
            s = s.where(F.col("firm_id") == firm)
        years = {r["year"]: r["count"] for r in s.groupBy("year").count().collect()}  # one row a year
        if years.get(year, 0) < min(3, top) and years:
            year = max(y for y, n in years.items() if n >= max(1, int(0.9 * max(years.values()))))
        w = Window.partitionBy("firm_id" if firm else "cluster_id").orderBy(F.desc("score"), "firm_id", "cluster_id")
        return s.where(F.col("year") == year).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("cluster_id", "firm_id", "score", F.col("rank").cast("bigint").alias("rank"))

    def delta(self, first: int, last: int, firm: str | None = None, least: float = 1e-4) -> DataFrame:
        """(firm_id, cluster_id, delta) of scores between two years; a missing one is 0."""
        s = self.scores().where(F.col("year").isin(first, last))
        if firm:
            s = s.where(F.col("firm_id") == firm)
        d = F.sum(F.when(F.col("year") == last, F.col("score")).otherwise(-F.col("score")))
        return s.groupBy("firm_id", "cluster_id").agg(d.alias("delta")).where(F.abs("delta") >= least)

    def citation_graph(self, id: str, depth: int = 2, per_node: int | None = 50) -> DataFrame:
        """(src, dst, level): citations around a record, up to *per_node* neighbours of each."""
        edges = self.table("patent_citations").select(F.col("citing_publication").alias("src"), F.col("cited_publication").alias("dst"))
        return bfs_edges(edges, self.spark.createDataFrame([(id,)], "node string"), depth, per_node)

    # rules made by users
    def categorise(self, rules: list[tuple[str, str, str]], digits: int = 4) -> DataFrame:
        """(category, id, confidence) of rules (category, 'class' or 'keyword', value): class .9 (from four characters on) or .7, keyword .6, both .95."""
        r = F.broadcast(self.spark.createDataFrame(rules, "category string, kind string, value string"))  # a user's rules
        by_class = self.classes().join(r, (F.col("kind") == "class") & F.startswith(F.col("code"), F.col("value"))).select("category", "id", F.when(F.length("value") >= digits, 0.9).otherwise(0.7).alias("c"), F.lit(0.0).alias("k"))
        by_word = self.records().join(r, (F.col("kind") == "keyword") & F.contains(F.lower(F.concat_ws(" ", "title", "abstract")), F.lower("value"))).select("category", "id", F.lit(0.0).alias("c"), F.lit(0.6).alias("k"))
        both = by_class.unionByName(by_word).groupBy("category", "id").agg(F.max("c").alias("c"), F.max("k").alias("k"))
        return both.select("category", "id", F.when((F.col("c") > 0) & (F.col("k") > 0), 0.95).otherwise(F.greatest("c", "k")).alias("confidence"))

    @classmethod
    def help(cls, word: str = "") -> list[tuple[str, str]]:
        """Functions and the first lines of what they do, those that mention the word."""
        out = [(n, (getattr(cls, n).__doc__ or "").strip().splitlines()[0]) for n in sorted(vars(cls)) if not n.startswith("_") and getattr(cls, n).__doc__]
        return [x for x in out if word.lower() in " ".join(x).lower()]
