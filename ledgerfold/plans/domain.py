"""Queries over the record tables themselves (classes, owners, citations, vectors, scores, filings): one SQL text for both engines.

A body that has to differ is a pair (Spark, DuckDB). Roles: `classes` and `holders` are the distinct class codes and owners
of a publication; `scores` the best valid score of (firm, cluster, year); `vectors` the valid vectors of firms by year.
"""

from __future__ import annotations

import re

from ledgerfold.plans.sqlbase import query

ROLES = {
    "classes": "SELECT DISTINCT publication_number AS id, upper(replace(cpc_code, ' ', '')) AS code, substr(upper(replace(cpc_code, ' ', '')), 1, 4) AS code4, substr(upper(replace(cpc_code, ' ', '')), 1, 1) AS section FROM patent_cpc WHERE publication_number IS NOT NULL AND cpc_code IS NOT NULL AND replace(cpc_code, ' ', '') <> ''",
    "holders": "SELECT DISTINCT publication_number AS id, firm_id AS firm FROM patent_assignees WHERE firm_id IS NOT NULL AND publication_number IS NOT NULL",
    "scores": "SELECT firm_id, cluster_id, year, max(score) AS score FROM startability_surface WHERE score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 AND firm_id IS NOT NULL GROUP BY firm_id, cluster_id, year",
    "cited": "SELECT cited_publication AS id, count(DISTINCT citing_publication) AS n_cited FROM patent_citations WHERE cited_publication <> citing_publication GROUP BY cited_publication",
    "yearly": "SELECT firm_id, year, max(patent_count) AS n, max(tech_diversity) AS diversity, max(tech_concentration) AS concentration, max(dominant_cpc) AS code FROM firm_tech_vectors WHERE firm_id IS NOT NULL GROUP BY firm_id, year",
    "family": "SELECT DISTINCT lower(trim(firm_id)) AS firm, lower(trim(parent_firm_id)) AS parent FROM corporate_hierarchy WHERE trim(firm_id) <> '' AND trim(parent_firm_id) <> '' AND lower(trim(firm_id)) <> lower(trim(parent_firm_id))",
}


def with_roles(body: str) -> str:
    """The body behind the roles it names."""
    used = [r for r in ROLES if re.search(rf"\b{r}\b", body)]
    if not used:
        return body
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    heads = ", ".join(f"{r} AS ({ROLES[r]})" for r in used)
    return f"WITH {own.group(1) or ''}{heads}, {body[own.end() :]}" if own else f"WITH {heads} {body}"


BODIES: dict[str, str | tuple[str, str]] = {
    # search and lists
    "search_combined": """
SELECT r.publication_number FROM (SELECT DISTINCT publication_number, title_en FROM patent_research_data) r
WHERE lower(r.title_en) LIKE '%antenna%' AND r.publication_number IN (SELECT id FROM classes WHERE section = 'H') AND r.publication_number IN (SELECT id FROM holders) AND r.publication_number LIKE 'US-%' ORDER BY r.publication_number LIMIT 50""",
    "search_no_hit": "SELECT publication_number FROM patent_research_data WHERE 1 = 0 OR lower(title_en) LIKE '%zzzqqq%'",
    "page_of_owners": """
SELECT raw_name, n, total, CAST(ceil(total / 25.0) AS BIGINT) AS pages FROM (SELECT raw_name, count(*) AS n FROM patent_assignees GROUP BY raw_name ORDER BY count(*) DESC, raw_name LIMIT 25 OFFSET 25)
CROSS JOIN (SELECT count(DISTINCT raw_name) AS total FROM patent_assignees)""",
    "repeatable_sample": "SELECT publication_number FROM (SELECT DISTINCT publication_number FROM patent_research_data) ORDER BY md5(concat(publication_number, ':7')), publication_number LIMIT 100",
    "limit_in_subquery": """
SELECT c.code4, count(*) AS n FROM classes c JOIN (SELECT id FROM cited ORDER BY n_cited DESC, id LIMIT 200) t ON c.id = t.id GROUP BY c.code4""",
    "keyset_batches": "SELECT CAST(floor(id / 5000) AS BIGINT) AS batch, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM patent_assignees GROUP BY 1",
    "point_lookup": "SELECT publication_number, cpc_code, is_first FROM patent_cpc WHERE publication_number = (SELECT min(publication_number) FROM patent_cpc) AND cpc_code IS NOT NULL",
    "label_search": (
        "SELECT DISTINCT publication_number FROM patent_research_data WHERE exists(top_terms, t -> lower(t) LIKE '%sensor%' OR lower(t) LIKE '%valve%')",
        "SELECT DISTINCT publication_number FROM patent_research_data WHERE len(list_filter(top_terms, lambda t: lower(t) LIKE '%sensor%' OR lower(t) LIKE '%valve%')) > 0",
    ),
    "keyword_class": """
SELECT publication_number, CASE WHEN t LIKE '%electrode%' THEN 'H01M' WHEN t LIKE '%antenna%' THEN 'H01Q' WHEN t LIKE '%turbine%' THEN 'F01D' WHEN t LIKE '%sensor%' THEN 'G01D' WHEN t LIKE '%valve%' THEN 'F16K' END AS code4
FROM (SELECT DISTINCT publication_number, lower(concat(coalesce(title_en, ''), ' ', coalesce(abstract_en, ''))) AS t FROM patent_research_data) WHERE t LIKE '%electrode%' OR t LIKE '%antenna%' OR t LIKE '%turbine%' OR t LIKE '%sensor%' OR t LIKE '%valve%'""",
    "text_class_shares": """
WITH hits AS (SELECT DISTINCT publication_number AS id FROM patent_research_data WHERE lower(abstract_en) LIKE '%sensor%')
SELECT c.code4, count(DISTINCT h.id) AS n, round(count(DISTINCT h.id) / CAST((SELECT count(*) FROM hits) AS DOUBLE), 6) AS share FROM hits h JOIN classes c ON c.id = h.id GROUP BY c.code4""",
    "query_types": (
        "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN q RLIKE '^[A-Z]{2}-?[0-9]{6,}' THEN 'number' WHEN q RLIKE '^[A-H][0-9]{2}[A-Z]' THEN 'class' WHEN size(split(trim(q), ' +')) <= 4 THEN 'firm' ELSE 'text' END AS kind FROM (SELECT publication_number AS q FROM patent_research_data UNION ALL SELECT cpc_code FROM patent_cpc WHERE cpc_code IS NOT NULL UNION ALL SELECT raw_name FROM patent_assignees UNION ALL SELECT title_en FROM patent_research_data WHERE title_en IS NOT NULL)) GROUP BY kind",
        "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(q, '^[A-Z]{2}-?[0-9]{6,}') THEN 'number' WHEN regexp_matches(q, '^[A-H][0-9]{2}[A-Z]') THEN 'class' WHEN len(regexp_split_to_array(trim(q), ' +')) <= 4 THEN 'firm' ELSE 'text' END AS kind FROM (SELECT publication_number AS q FROM patent_research_data UNION ALL SELECT cpc_code FROM patent_cpc WHERE cpc_code IS NOT NULL UNION ALL SELECT raw_name FROM patent_assignees UNION ALL SELECT title_en FROM patent_research_data WHERE title_en IS NOT NULL)) GROUP BY kind",
    ),
    # joins
    "latest_year_left_join": """
SELECT c.cluster_id, count(s.firm_id) AS firms, round(avg(s.score), 6) AS mean_score FROM (SELECT DISTINCT cluster_id FROM scores) c
LEFT JOIN scores s ON s.cluster_id = c.cluster_id AND s.year = (SELECT max(year) FROM scores) GROUP BY c.cluster_id""",
    "prefix_join": """
WITH p AS (SELECT DISTINCT substr(code, 1, 3) AS prefix FROM classes) SELECT p.prefix, count(DISTINCT c.id) AS n FROM p JOIN classes c ON substr(c.code, 1, 3) = p.prefix AND c.code LIKE concat(p.prefix, '%') GROUP BY p.prefix""",
    "latest_per_cluster": """
SELECT s.cluster_id, s.firm_id, s.year, round(s.score, 6) AS score FROM scores s JOIN (SELECT cluster_id, max(year) AS year FROM scores GROUP BY cluster_id) m ON m.cluster_id = s.cluster_id AND m.year = s.year""",
    "claim_pairs": """
WITH few AS (SELECT id FROM cited ORDER BY n_cited DESC, id LIMIT 30), k AS (SELECT c.id, c.code FROM classes c JOIN few f ON f.id = c.id), n AS (SELECT id, count(*) AS n FROM k GROUP BY id)
SELECT a.id AS a, b.id AS b, round(count(*) / CAST(max(na.n) + max(nb.n) - count(*) AS DOUBLE), 6) AS jaccard, CASE WHEN count(*) / CAST(max(na.n) + max(nb.n) - count(*) AS DOUBLE) >= 0.6 THEN 'high' WHEN count(*) / CAST(max(na.n) + max(nb.n) - count(*) AS DOUBLE) >= 0.3 THEN 'moderate' ELSE 'low' END AS band
FROM k a JOIN k b ON a.code = b.code AND a.id < b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id GROUP BY a.id, b.id""",
    # written as ASCII first: one engine counts edits by letters, the other by bytes
    "similar_spellings": ("""
WITH n AS (SELECT name, substr(name, 1, 4) AS block, count(*) AS n FROM (SELECT regexp_replace(harmonized_name, '[^ -~]', '?') AS name FROM patent_assignees WHERE harmonized_name IS NOT NULL) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, name) AS rn FROM n)
SELECT a.name AS name_a, b.name AS name_b, round(1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE), 6) AS ratio FROM r a JOIN r b ON a.block = b.block AND b.rn > a.rn AND b.rn <= a.rn + 200
WHERE abs(length(a.name) - length(b.name)) <= 0.3 * greatest(length(a.name), length(b.name)) AND 1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) >= 0.88""", """
WITH n AS (SELECT name, substr(name, 1, 4) AS block, count(*) AS n FROM (SELECT regexp_replace(harmonized_name, '[^ -~]', '?', 'g') AS name FROM patent_assignees WHERE harmonized_name IS NOT NULL) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, name) AS rn FROM n)
SELECT a.name AS name_a, b.name AS name_b, round(1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE), 6) AS ratio FROM r a JOIN r b ON a.block = b.block AND b.rn > a.rn AND b.rn <= a.rn + 200
WHERE abs(length(a.name) - length(b.name)) <= 0.3 * greatest(length(a.name), length(b.name)) AND 1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) >= 0.88"""),
    # aggregates
    "owner_list": (
        "SELECT id, array_join(array_sort(collect_set(firm)), ',') AS owners FROM holders GROUP BY id",
        "SELECT id, string_agg(DISTINCT firm, ',' ORDER BY firm) AS owners FROM holders GROUP BY id",
    ),
    "whitespace_clusters": """
SELECT a.cluster_id, round(a.mean_score, 6) AS mean_score, coalesce(b.n, 0) AS recent_firms FROM (SELECT cluster_id, avg(score) AS mean_score FROM scores GROUP BY cluster_id) a
LEFT JOIN (SELECT cluster_id, count(DISTINCT firm_id) AS n FROM scores WHERE year >= 2021 AND score > 0.5 GROUP BY cluster_id) b ON a.cluster_id = b.cluster_id""",
    "owner_or_name": "SELECT coalesce(firm_id, raw_name) AS owner, count(*) AS n, min(country_code) AS first_country FROM patent_assignees GROUP BY coalesce(firm_id, raw_name)",
    "running_portfolio": "SELECT firm_id, year, CAST(sum(n) OVER (PARTITION BY firm_id ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM yearly",
    "top_owners_of_class": (
        "SELECT code4, array_join(transform(array_sort(collect_list(struct(rn, firm))), x -> x.firm), ',') AS top_owners FROM (SELECT code4, firm, row_number() OVER (PARTITION BY code4 ORDER BY n DESC, firm) AS rn FROM (SELECT c.code4, h.firm, count(DISTINCT c.id) AS n FROM classes c JOIN holders h ON h.id = c.id GROUP BY c.code4, h.firm)) WHERE rn <= 10 GROUP BY code4",
        "SELECT code4, string_agg(firm, ',' ORDER BY rn) AS top_owners FROM (SELECT code4, firm, row_number() OVER (PARTITION BY code4 ORDER BY n DESC, firm) AS rn FROM (SELECT c.code4, h.firm, count(DISTINCT c.id) AS n FROM classes c JOIN holders h ON h.id = c.id GROUP BY c.code4, h.firm)) WHERE rn <= 10 GROUP BY code4",
    ),
    "counts_as_json": (
        "SELECT firm_id, to_json(map_from_entries(array_sort(collect_list(struct(CAST(year AS STRING), n))))) AS counts FROM yearly WHERE n IS NOT NULL GROUP BY firm_id",
        """SELECT firm_id, concat('{', string_agg(concat('"', year, '":', n), ',' ORDER BY year), '}') AS counts FROM yearly WHERE n IS NOT NULL GROUP BY firm_id""",
    ),
    "skew_and_correlations": """
WITH m AS (SELECT avg(n) AS mean, stddev_samp(n) AS s FROM yearly)
SELECT round(sum(pow((n - mean) / s, 3)) / count(*), 5) AS skewness, round(corr(n, diversity), 5) AS r_diversity, round(corr(n, concentration), 5) AS r_concentration, round(corr(diversity, concentration), 5) AS r_both FROM yearly CROSS JOIN m WHERE n IS NOT NULL""",
    "firm_sets": (
        "SELECT firm_id, array_join(array_sort(collect_set(country_code)), ',') AS countries, count(DISTINCT publication_number) AS n FROM patent_assignees WHERE firm_id IS NOT NULL AND country_code IS NOT NULL GROUP BY firm_id",
        "SELECT firm_id, string_agg(DISTINCT country_code, ',' ORDER BY country_code) AS countries, count(DISTINCT publication_number) AS n FROM patent_assignees WHERE firm_id IS NOT NULL AND country_code IS NOT NULL GROUP BY firm_id",
    ),
    "median_of_scores": "SELECT cluster_id, round(score, 6) AS median_score FROM (SELECT cluster_id, score, row_number() OVER (PARTITION BY cluster_id ORDER BY score, firm_id, year) AS rn, count(*) OVER (PARTITION BY cluster_id) AS c FROM scores) WHERE rn = floor(c / 2.0) + 1",
    # ranks are counted over distinct sizes, so no window holds all firms
    "portfolio_benchmark": """
WITH p AS (SELECT h.firm, count(DISTINCT h.id) AS n, count(DISTINCT c.code4) AS classes, sum(coalesce(t.n_cited, 0)) AS cites FROM holders h LEFT JOIN classes c ON c.id = h.id LEFT JOIN cited t ON t.id = h.id GROUP BY h.firm),
sizes AS (SELECT n, sum(count(*)) OVER (ORDER BY n DESC) - count(*) + 1 AS place FROM p GROUP BY n)
SELECT p.firm, p.n, p.classes, CAST(p.cites AS BIGINT) AS cites, CAST(place AS BIGINT) AS rank_by_size FROM p JOIN sizes ON sizes.n = p.n""",
    "report_by_section": "SELECT c.section, count(DISTINCT c.id) AS records, count(DISTINCT h.firm) AS firms, count(DISTINCT c.code4) AS classes FROM classes c LEFT JOIN holders h ON h.id = c.id GROUP BY c.section",
    # windows
    "first_and_last": "SELECT firm_id, min_by(code, year) AS first_code, max_by(code, year) AS last_code, min(year) AS first_year, max(year) AS last_year, CASE WHEN min_by(code, year) = max_by(code, year) THEN 'stable' ELSE 'moved' END AS move FROM yearly WHERE code IS NOT NULL GROUP BY firm_id",
    "growth_three_back": "SELECT firm_id, year, round((n - b) / CAST(nullif(b, 0) AS DOUBLE), 6) AS growth3 FROM (SELECT firm_id, year, n, lag(n, 3) OVER (PARTITION BY firm_id ORDER BY year) AS b, row_number() OVER (PARTITION BY firm_id ORDER BY year DESC) AS rn FROM yearly) WHERE rn = 1",
    "growth_two_blocks": """
WITH m AS (SELECT max(year) AS y FROM yearly), b AS (SELECT code, CAST(sum(CASE WHEN year > y - 5 THEN n ELSE 0 END) AS BIGINT) AS recent, CAST(sum(CASE WHEN year <= y - 5 AND year > y - 10 THEN n ELSE 0 END) AS BIGINT) AS previous FROM yearly CROSS JOIN m WHERE code IS NOT NULL GROUP BY code)
SELECT code, recent, previous, round((recent - previous) / CAST(nullif(previous, 0) AS DOUBLE), 6) AS growth FROM b""",
    "open_last_period": "SELECT year, CAST(sum(n) AS BIGINT) AS n, CASE WHEN year = (SELECT max(year) FROM yearly) THEN 'open' ELSE 'closed' END AS period FROM yearly GROUP BY year",
    "year_with_enough_rows": "SELECT max(year) AS year FROM (SELECT year, count(*) AS n FROM scores WHERE firm_id = 'company_1001' GROUP BY year) WHERE n > 5",
    "populated_years": "SELECT year, n FROM (SELECT year, count(*) AS n FROM scores GROUP BY year) WHERE n > 1000",
    # scalars
    "legal_suffixes_off": (
        "SELECT DISTINCT raw_name, trim(regexp_replace(regexp_replace(regexp_replace(upper(raw_name), '[.,]', ''), '( (INC|CORP|LTD|LLC|GMBH|AG|SA|KK|CO|PLC|NV|AB|CORPORATION|LIMITED|COMPANY|INCORPORATED))+$', ''), ' +', ' ')) AS bare FROM patent_assignees",
        "SELECT DISTINCT raw_name, trim(regexp_replace(regexp_replace(regexp_replace(upper(raw_name), '[.,]', '', 'g'), '( (INC|CORP|LTD|LLC|GMBH|AG|SA|KK|CO|PLC|NV|AB|CORPORATION|LIMITED|COMPANY|INCORPORATED))+$', ''), ' +', ' ', 'g')) AS bare FROM patent_assignees",
    ),
    "slug_and_ids": (
        "SELECT DISTINCT standard_name, concat(trim(BOTH '-' FROM regexp_replace(lower(standard_name), '[^a-z0-9]+', '-')), '-', substr(sha2(standard_name, 256), 1, 8)) AS slug, substr(sha2(standard_name, 256), 1, 16) AS sha16, substr(md5(standard_name), 1, 12) AS md12 FROM sep_declarations WHERE standard_name IS NOT NULL",
        "SELECT DISTINCT standard_name, concat(trim(regexp_replace(lower(standard_name), '[^a-z0-9]+', '-', 'g'), '-'), '-', substr(sha256(standard_name), 1, 8)) AS slug, substr(sha256(standard_name), 1, 16) AS sha16, substr(md5(standard_name), 1, 12) AS md12 FROM sep_declarations WHERE standard_name IS NOT NULL",
    ),
    "ascii_share": (
        "SELECT publication_number, round(max(length(regexp_replace(abstract_en, '[^ -~]', '')) / CAST(length(abstract_en) AS DOUBLE)), 6) AS ascii_share FROM patent_research_data WHERE abstract_en <> '' GROUP BY publication_number",
        "SELECT publication_number, round(max(length(regexp_replace(abstract_en, '[^ -~]', '', 'g')) / CAST(length(abstract_en) AS DOUBLE)), 6) AS ascii_share FROM patent_research_data WHERE abstract_en <> '' GROUP BY publication_number",
    ),
    "first_sentences": (
        "SELECT DISTINCT publication_number, array_join(slice(filter(transform(split(abstract_en, '[.!?]'), x -> trim(x)), x -> length(x) >= 10), 1, 2), '|') AS picked FROM patent_research_data WHERE abstract_en IS NOT NULL",
        "SELECT DISTINCT publication_number, array_to_string(list_filter(list_transform(regexp_split_to_array(abstract_en, '[.!?]'), lambda x: trim(x)), lambda x: length(x) >= 10)[1:2], '|') AS picked FROM patent_research_data WHERE abstract_en IS NOT NULL",
    ),
    "key_phrases": (
        "SELECT DISTINCT publication_number, array_join(slice(array_distinct(filter(transform(split(lower(abstract_en), ' (a|an|the|of|for|with|and|or|to|in|is|are|by|on) |[,.;:()]'), x -> trim(x)), x -> length(x) > 3 AND size(split(x, ' ')) <= 6)), 1, 15), '|') AS phrases FROM patent_research_data WHERE abstract_en IS NOT NULL",
        "SELECT DISTINCT publication_number, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: list_position(l, p[1]) = p[2]), lambda p: p[1])[1:15], '|') AS phrases FROM (SELECT publication_number, list_filter(list_transform(regexp_split_to_array(lower(abstract_en), ' (a|an|the|of|for|with|and|or|to|in|is|are|by|on) |[,.;:()]'), lambda x: trim(x)), lambda x: length(x) > 3 AND len(string_split(x, ' ')) <= 6) AS l FROM patent_research_data WHERE abstract_en IS NOT NULL)",
    ),
    "graph_lines": (
        "SELECT concat('N', regexp_replace(citing_publication, '[^A-Za-z0-9]', '_'), ' --> N', regexp_replace(cited_publication, '[^A-Za-z0-9]', '_')) AS line FROM (SELECT DISTINCT citing_publication, cited_publication FROM patent_citations) ORDER BY citing_publication, cited_publication LIMIT 200",
        "SELECT concat('N', regexp_replace(citing_publication, '[^A-Za-z0-9]', '_', 'g'), ' --> N', regexp_replace(cited_publication, '[^A-Za-z0-9]', '_', 'g')) AS line FROM (SELECT DISTINCT citing_publication, cited_publication FROM patent_citations) ORDER BY citing_publication, cited_publication LIMIT 200",
    ),
    "offset_list": (
        "SELECT user_id, size(items) AS n, split(items[0], ',')[0] AS first_name FROM (SELECT user_id, split(array_join(transform(array_sort(collect_list(struct(event_id, event_type))), x -> concat(x.event_type, ',', x.event_id)), ';'), ';') AS items FROM events GROUP BY user_id)",
        "SELECT user_id, len(items) AS n, string_split(items[1], ',')[1] AS first_name FROM (SELECT user_id, string_split(string_agg(concat(event_type, ',', event_id), ';' ORDER BY event_id), ';') AS items FROM events GROUP BY user_id)",
    ),
    "tone_fields": (
        "SELECT l_orderkey, l_linenumber, try_cast(split(t, ',')[0] AS DOUBLE) AS tone, try_cast(split(t, ',')[2] AS DOUBLE) AS negative FROM (SELECT l_orderkey, l_linenumber, concat_ws(',', l_discount, l_tax, l_quantity) AS t FROM lineitem)",
        "SELECT l_orderkey, l_linenumber, try_cast(string_split(t, ',')[1] AS DOUBLE) AS tone, try_cast(string_split(t, ',')[3] AS DOUBLE) AS negative FROM (SELECT l_orderkey, l_linenumber, concat_ws(',', l_discount, l_tax, l_quantity) AS t FROM lineitem)",
    ),
    "kind_codes": (
        "SELECT publication_number, substring_index(publication_number, '-', -1) AS kind, substr(publication_number, 1, 2) AS country, CASE WHEN substring_index(publication_number, '-', -1) LIKE 'B%' THEN 'granted' WHEN substring_index(publication_number, '-', -1) LIKE 'U%' THEN 'utility' WHEN substring_index(publication_number, '-', -1) LIKE 'A%' THEN 'application' ELSE 'other' END AS status FROM (SELECT DISTINCT publication_number FROM patent_research_data)",
        "SELECT publication_number, split_part(publication_number, '-', -1) AS kind, substr(publication_number, 1, 2) AS country, CASE WHEN split_part(publication_number, '-', -1) LIKE 'B%' THEN 'granted' WHEN split_part(publication_number, '-', -1) LIKE 'U%' THEN 'utility' WHEN split_part(publication_number, '-', -1) LIKE 'A%' THEN 'application' ELSE 'other' END AS status FROM (SELECT DISTINCT publication_number FROM patent_research_data)",
    ),
    "number_forms": (
        "SELECT declaration_id, regexp_extract(regexp_replace(patent_number, '[ ,.]', ''), '([0-9]{6,12})', 1) AS digits, regexp_extract(patent_number, '^([A-Z]{2})', 1) AS office FROM sep_declarations WHERE patent_number IS NOT NULL",
        "SELECT declaration_id, regexp_extract(regexp_replace(patent_number, '[ ,.]', '', 'g'), '([0-9]{6,12})', 1) AS digits, regexp_extract(patent_number, '^([A-Z]{2})', 1) AS office FROM sep_declarations WHERE patent_number IS NOT NULL",
    ),
    "int_dates": "SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS as_int, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) + 200000 AS BIGINT) AS plus_20_years FROM orders",
    "days_between": (
        "SELECT l_orderkey, CAST(max(datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey",
        "SELECT l_orderkey, CAST(max(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey",
    ),
    "quarter_bounds": (
        "SELECT DISTINCT CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS STRING) AS first_day, CAST(date_sub(add_months(CAST(date_trunc('quarter', o_orderdate) AS DATE), 3), 1) AS STRING) AS last_day FROM orders",
        "SELECT DISTINCT CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS last_day FROM orders",
    ),
    "tolerant_lists": (
        "SELECT declaration_id, size(coalesce(from_json(t, 'array<string>'), array())) AS n FROM (SELECT declaration_id, CASE WHEN patent_number IS NULL THEN 'broken [' ELSE concat('[\"', standard_name, '\",\"', standard_org, '\"]') END AS t FROM sep_declarations WHERE standard_name IS NOT NULL AND standard_org IS NOT NULL)",
        "SELECT declaration_id, CAST(CASE WHEN patent_number IS NULL THEN 0 ELSE 2 END AS INT) AS n FROM sep_declarations WHERE standard_name IS NOT NULL AND standard_org IS NOT NULL",
    ),
    "display_names": """
WITH names AS (SELECT firm_id, raw_name AS firm_name FROM (SELECT firm_id, raw_name, row_number() OVER (PARTITION BY firm_id ORDER BY count(*) DESC, raw_name) AS rn FROM patent_assignees WHERE firm_id IS NOT NULL GROUP BY firm_id, raw_name) WHERE rn = 1)
SELECT y.firm_id, n.firm_name, y.year, y.n FROM yearly y LEFT JOIN names n ON n.firm_id = y.firm_id""",
    "class_labels": """
SELECT c.section, l.label, count(DISTINCT c.id) AS n FROM classes c LEFT JOIN (SELECT 'A' AS section, 'necessities' AS label UNION ALL SELECT 'B', 'operations' UNION ALL SELECT 'C', 'chemistry' UNION ALL SELECT 'D', 'textiles' UNION ALL SELECT 'E', 'constructions' UNION ALL SELECT 'F', 'engineering' UNION ALL SELECT 'G', 'physics' UNION ALL SELECT 'H', 'electricity') l ON l.section = c.section GROUP BY c.section, l.label""",
    "summary_texts": "SELECT firm_id, concat(firm_id, ' held ', CAST(n AS VARCHAR(20)), ' records in ', CAST(year AS VARCHAR(10)), CASE WHEN concentration > 0.5 THEN ', concentrated' ELSE ', spread' END) AS summary FROM yearly WHERE n IS NOT NULL AND concentration IS NOT NULL",
    "decay_weights": "SELECT firm_id, year, round(sqrt(greatest(n, 1)) * exp(-0.1 * (2024 - year)), 6) AS weight FROM yearly WHERE n IS NOT NULL",
    # sets of codes and vectors
    "class_overlap": """
WITH a AS (SELECT DISTINCT c.code4 FROM holders h JOIN classes c ON c.id = h.id WHERE h.firm = 'company_1001'), b AS (SELECT DISTINCT h.firm, c.code4 FROM holders h JOIN classes c ON c.id = h.id WHERE h.firm <> 'company_1001')
SELECT b.firm, count(*) AS common, round(count(*) / CAST((SELECT count(*) FROM a) AS DOUBLE), 6) AS overlap FROM b JOIN a ON a.code4 = b.code4 GROUP BY b.firm""",
    "proxy_donors": """
WITH latest AS (SELECT firm_id, dominant_cpc AS code, patent_count AS n, tech_vector IS NOT NULL AS has, row_number() OVER (PARTITION BY firm_id ORDER BY CASE WHEN tech_vector IS NULL THEN 0 ELSE 1 END, year DESC) AS rn FROM firm_tech_vectors WHERE dominant_cpc IS NOT NULL),
donor AS (SELECT code, firm_id AS donor FROM (SELECT code, firm_id, row_number() OVER (PARTITION BY code ORDER BY n DESC, firm_id) AS k FROM latest WHERE has) WHERE k = 1)
SELECT l.firm_id, l.code, d.donor FROM latest l LEFT JOIN donor d ON d.code = l.code WHERE l.rn = 1 AND NOT l.has""",
    "growth_potential": """
WITH g AS (SELECT firm_id, cluster_id, score, lag(score) OVER (PARTITION BY firm_id, cluster_id ORDER BY year) AS before, year FROM scores), m AS (SELECT firm_id, score, CASE WHEN before > 0 THEN (score - before) / before ELSE 0.0 END AS m FROM g WHERE year = 2022)
SELECT firm_id, round(least(1.0, 2 * sum(score * greatest(0.0, m)) / nullif(sum(score), 0)), 6) AS growth, count(CASE WHEN m > 0.3 THEN 1 END) AS high_growth FROM m GROUP BY firm_id""",
    "synergies": """
WITH a AS (SELECT cluster_id, max(score) AS s FROM scores WHERE firm_id = 'company_1001' GROUP BY cluster_id), b AS (SELECT firm_id, cluster_id, max(score) AS s FROM scores WHERE firm_id <> 'company_1001' GROUP BY firm_id, cluster_id),
x AS (SELECT b.firm_id, avg(b.s) AS s, count(a.cluster_id) / CAST(count(*) AS DOUBLE) AS shared, sum(b.s * coalesce(a.s, 0)) / nullif(sqrt(sum(b.s * b.s)) * sqrt((SELECT sum(s * s) FROM a)), 0) AS cs FROM b LEFT JOIN a ON a.cluster_id = b.cluster_id GROUP BY b.firm_id)
SELECT firm_id, round(least(1.0, 0.6 * s + 0.2 * (1 - shared) + 0.2 * (1 - coalesce(cs, 0))), 6) AS gap, round(least(1.0, 0.5 * s + 0.3 * shared + 0.2 * coalesce(cs, 0)), 6) AS consolidation, round(least(1.0, 0.5 * s + 0.5 * (1 - shared)), 6) AS diversification FROM x""",
    "quality_index": """
WITH q AS (SELECT h.firm, sum(coalesce(t.n_cited, 0)) / CAST(count(*) AS DOUBLE) AS c FROM holders h LEFT JOIN cited t ON t.id = h.id GROUP BY h.firm), d AS (SELECT c, sum(count(*)) OVER (ORDER BY c) - count(*) AS below FROM q GROUP BY c)
SELECT q.firm, round(q.c, 4) AS mean_cites, round(100.0 * d.below / (SELECT count(*) FROM q), 4) AS percentile FROM q JOIN d ON d.c = q.c""",
    "pair_similarity_bands": """
WITH m AS (SELECT DISTINCT h.firm, c.code4 FROM holders h JOIN classes c ON c.id = h.id), n AS (SELECT firm, count(*) AS n FROM m GROUP BY firm), big AS (SELECT firm FROM n ORDER BY n DESC, firm LIMIT 30)
SELECT a.firm AS firm_a, b.firm AS firm_b, round(count(*) / CAST(max(x.n) + max(y.n) - count(*) AS DOUBLE), 6) AS jaccard FROM m a JOIN m b ON a.code4 = b.code4 AND a.firm < b.firm JOIN n x ON x.firm = a.firm JOIN n y ON y.firm = b.firm WHERE a.firm IN (SELECT firm FROM big) AND b.firm IN (SELECT firm FROM big) GROUP BY a.firm, b.firm""",
    "class_trial_rates": """
WITH t AS (SELECT DISTINCT trial_number, publication_number AS id FROM ptab_trials WHERE publication_number IS NOT NULL), n AS (SELECT code4, count(DISTINCT id) AS n FROM classes GROUP BY code4)
SELECT c.code4, count(DISTINCT t.trial_number) AS trials, round(least(1.0, count(DISTINCT t.trial_number) / CAST(max(n.n) AS DOUBLE) / 0.02), 6) AS risk FROM t JOIN classes c ON c.id = t.id JOIN n ON n.code4 = c.code4 GROUP BY c.code4""",
    # tools over firms, groups and filings
    "group_portfolio": """
WITH RECURSIVE tree AS (SELECT DISTINCT parent AS root, firm, 1 AS depth FROM family UNION ALL SELECT t.root, f.firm, t.depth + 1 FROM tree t JOIN family f ON f.parent = t.firm WHERE t.depth < 10)
SELECT t.root, count(DISTINCT t.firm) AS members, count(DISTINCT h.id) AS records FROM (SELECT DISTINCT root, firm FROM tree) t LEFT JOIN holders h ON lower(h.firm) = t.firm GROUP BY t.root""",
    "group_scores": """
SELECT f.parent, s.cluster_id, round(max(s.score), 6) AS best, round(avg(s.score), 6) AS mean, count(DISTINCT s.firm_id) AS members FROM family f JOIN scores s ON lower(s.firm_id) = f.firm WHERE s.year = 2022 GROUP BY f.parent, s.cluster_id""",
    "firm_landscape": "SELECT h.firm, c.section, count(DISTINCT h.id) AS n, round(count(DISTINCT h.id) / CAST(max(t.n) AS DOUBLE), 6) AS share FROM holders h JOIN classes c ON c.id = h.id JOIN (SELECT firm, count(*) AS n FROM holders GROUP BY firm) t ON t.firm = h.firm GROUP BY h.firm, c.section",
    "clusters_list": "SELECT cluster_id, substr(cluster_id, 1, 4) AS code4, count(DISTINCT firm_id) AS firms, round(avg(score), 6) AS mean_score, round(max(score), 6) AS best FROM scores GROUP BY cluster_id",
    "cross_border": """
SELECT a.office AS office_a, b.office AS office_b, count(*) AS shared_firms FROM (SELECT DISTINCT firm, substr(id, 1, 2) AS office FROM holders) a JOIN (SELECT DISTINCT firm, substr(id, 1, 2) AS office FROM holders) b ON a.firm = b.firm AND a.office < b.office GROUP BY a.office, b.office""",
    "market_strength": """
WITH p AS (SELECT h.firm, count(*) AS n, avg(least(coalesce(t.n_cited, 0) / 20.0, 1.0)) AS value FROM holders h LEFT JOIN cited t ON t.id = h.id GROUP BY h.firm), k AS (SELECT firm_id, count(DISTINCT cluster_id) AS clusters FROM scores GROUP BY firm_id)
SELECT p.firm, round(0.4 * least(1.0, ln(1 + n) / ln(10001)) + 0.3 * least(1.0, value) + 0.3 * least(1.0, coalesce(clusters, 0) / 50.0), 6) AS strength FROM p LEFT JOIN k ON k.firm_id = p.firm""",
    "citation_score": """
SELECT r.id, round(100 * (0.25 * least(coalesce(t.n_cited, 0) / 20.0, 1.0) + 0.15 * least(r.codes / 8.0, 1.0)), 4) AS partial_score FROM (SELECT id, count(*) AS codes FROM classes GROUP BY id) r LEFT JOIN cited t ON t.id = r.id""",
    "section_diversity": """
WITH s AS (SELECT h.firm, c.section, count(DISTINCT h.id) AS n FROM holders h JOIN classes c ON c.id = h.id GROUP BY h.firm, c.section), p AS (SELECT firm, n / CAST(sum(n) OVER (PARTITION BY firm) AS DOUBLE) AS p FROM s)
SELECT firm, round(least(1.0, (0 - sum(p * log2(p))) / 3), 6) AS diversity, round(sum(p * p), 6) AS hhi FROM p GROUP BY firm""",
    "prospects": """
WITH d AS (SELECT a.firm_id, avg(b.score - a.score) AS delta, avg(b.score) AS s FROM scores a JOIN scores b ON a.firm_id = b.firm_id AND a.cluster_id = b.cluster_id AND a.year = 2021 AND b.year = 2022 GROUP BY a.firm_id)
SELECT firm_id, round((1 - s) * 100, 4) AS need, round(least(100.0, greatest(0.0, 200 * delta + 0.3 * (1 - s) * 100)), 4) AS urgency FROM d""",
    "ptab_search": "SELECT DISTINCT trial_number, petitioner, patent_owner, prosecution_status FROM ptab_trials WHERE lower(petitioner) LIKE '%corp%' AND prosecution_status IS NOT NULL ORDER BY trial_number LIMIT 100",
    "ptab_owner_rates": """
SELECT patent_owner, count(DISTINCT trial_number) AS n, round(least(1.0, count(DISTINCT trial_number) / CAST((SELECT count(DISTINCT trial_number) FROM ptab_trials) AS DOUBLE) / 0.05 + CASE WHEN count(DISTINCT trial_number) >= 20 THEN 0.1 ELSE 0.0 END), 6) AS risk FROM ptab_trials WHERE patent_owner IS NOT NULL GROUP BY patent_owner""",
    "litigation_search": "SELECT DISTINCT case_id, plaintiff, defendant, court, outcome FROM patent_litigation WHERE court IS NOT NULL AND lower(defendant) LIKE '%corp%' ORDER BY case_id LIMIT 100",
    "category_members": """
SELECT k.category, c.id, max(CASE WHEN length(k.prefix) >= 4 THEN 0.9 ELSE 0.7 END) AS confidence FROM (SELECT 'power' AS category, 'F31H' AS prefix UNION ALL SELECT 'power', 'F3' UNION ALL SELECT 'sensing', 'G5') k JOIN classes c ON c.code LIKE concat(k.prefix, '%') GROUP BY k.category, c.id""",
    "category_landscape": """
WITH m AS (SELECT DISTINCT k.category, c.id FROM (SELECT 'power' AS category, 'F31H' AS prefix UNION ALL SELECT 'power', 'F3' UNION ALL SELECT 'sensing', 'G5') k JOIN classes c ON c.code LIKE concat(k.prefix, '%'))
SELECT m.category, h.firm, count(*) AS n FROM m JOIN holders h ON h.id = m.id GROUP BY m.category, h.firm""",
    "watch_matches": """
SELECT watch, count(DISTINCT id) AS n FROM (
  SELECT 'applicant' AS watch, publication_number AS id FROM patent_assignees WHERE lower(raw_name) LIKE '%materials%' UNION ALL SELECT 'class', id FROM classes WHERE code LIKE 'F31%'
  UNION ALL SELECT 'keyword', publication_number FROM patent_research_data WHERE lower(title_en) LIKE '%sensor%' UNION ALL SELECT 'competitor', id FROM holders WHERE firm = 'company_1038') GROUP BY watch""",
    "patent_cards": """
SELECT r.id, coalesce(r.title, '') AS title, coalesce(c.n, 0) AS n_codes, coalesce(h.n, 0) AS n_owners, coalesce(t.n_cited, 0) AS n_cited FROM (SELECT publication_number AS id, max(title_en) AS title FROM patent_research_data GROUP BY 1) r
LEFT JOIN (SELECT id, count(*) AS n FROM classes GROUP BY id) c ON c.id = r.id LEFT JOIN (SELECT id, count(*) AS n FROM holders GROUP BY id) h ON h.id = r.id LEFT JOIN cited t ON t.id = r.id""",
    "adjacent_classes": """
SELECT a.section AS section_a, b.section AS section_b, count(*) AS n FROM (SELECT DISTINCT id, section FROM classes) a JOIN (SELECT DISTINCT id, section FROM classes) b ON a.id = b.id AND a.section < b.section GROUP BY a.section, b.section""",
    "degrees_in_out": """
SELECT coalesce(o.p, i.p) AS node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM (SELECT citing_publication AS p, count(DISTINCT cited_publication) AS n FROM patent_citations WHERE citing_publication <> cited_publication GROUP BY 1) o
FULL OUTER JOIN (SELECT cited_publication AS p, count(DISTINCT citing_publication) AS n FROM patent_citations WHERE citing_publication <> cited_publication GROUP BY 1) i ON o.p = i.p""",
    "bayes_updates": """
WITH g AS (SELECT firm_id, avg(score) AS prior, stddev_samp(score) AS sd, count(*) AS k FROM scores WHERE year < 2022 GROUP BY firm_id), x AS (SELECT firm_id, avg(score) AS seen FROM scores WHERE year = 2022 GROUP BY firm_id)
SELECT g.firm_id, round((prior / pow(greatest(coalesce(sd, 0), 0.02), 2) + 10 * 0.8 * seen) / (1 / pow(greatest(coalesce(sd, 0), 0.02), 2) + 10 * 0.8), 6) AS posterior_mean, round((3 + 16 * seen) / (3 + 3 + 16), 6) AS posterior_share FROM g JOIN x ON x.firm_id = g.firm_id""",
    "extrapolated_total": "SELECT h.firm, round(avg(coalesce(t.n_cited, 0)) * count(*), 4) AS total FROM holders h LEFT JOIN cited t ON t.id = h.id GROUP BY h.firm",
    "vector_coverage": (
        "SELECT substr(publication_number, 1, 2) AS office, count(*) AS n, round(100.0 * count(embedding_v1) / count(*), 4) AS coverage_pct, count(CASE WHEN size(embedding_v1) = 64 THEN 1 END) AS full_length FROM patent_research_data GROUP BY 1",
        "SELECT substr(publication_number, 1, 2) AS office, count(*) AS n, round(100.0 * count(embedding_v1) / count(*), 4) AS coverage_pct, count(CASE WHEN len(embedding_v1) = 64 THEN 1 END) AS full_length FROM patent_research_data GROUP BY 1",
    ),
    "compare_unique_codes": """
SELECT code4, min(firm) AS firm FROM (SELECT DISTINCT h.firm, c.code4 FROM holders h JOIN classes c ON c.id = h.id WHERE h.firm IN (SELECT firm FROM (SELECT firm, count(*) AS n FROM holders GROUP BY firm) ORDER BY n DESC, firm LIMIT 12 OFFSET 3)) GROUP BY code4 HAVING count(*) = 1""",
    "codes_except": """
WITH sizes AS (SELECT firm, count(*) AS n FROM holders GROUP BY firm)
SELECT c.code FROM classes c JOIN holders h ON h.id = c.id WHERE h.firm IN (SELECT firm FROM sizes ORDER BY n DESC, firm LIMIT 1) EXCEPT SELECT c.code FROM classes c JOIN holders h ON h.id = c.id WHERE h.firm IN (SELECT firm FROM sizes ORDER BY n DESC, firm LIMIT 1 OFFSET 8)""",
    "new_entrants": """
WITH s AS (SELECT firm_id, cluster_id, min(year) AS first_year FROM scores GROUP BY firm_id, cluster_id) SELECT a.cluster_id, count(*) AS entrants FROM scores a WHERE a.year = 2021 AND NOT EXISTS (SELECT 1 FROM s WHERE s.firm_id = a.firm_id AND s.cluster_id = a.cluster_id AND s.first_year < 2019) GROUP BY a.cluster_id""",
}

QUERIES, SQL = {}, {}
for _name, _body in BODIES.items():
    _spark, _duck = _body if isinstance(_body, tuple) else (_body, _body)
    QUERIES[_name], SQL[_name] = query(with_roles(_spark)), with_roles(_duck)
