"""Scans, filters, joins, aggregates, windows, top-k and set operations of the analytic tools, declared in SQL.

Keys start with the operator ids or the tool they serve. Every top-k has a unique last sort key; percentages and scores are
rounded once, at the end.
"""

from __future__ import annotations

from ledgerfold.plans.sqlbase import declare

BODIES = {
    # class and time landscape
    "tech_landscape_year": """
SELECT code, y AS period, cnt, round(cnt / CAST(sum(cnt) OVER (PARTITION BY y) AS DOUBLE), 6) AS share
FROM (SELECT c.code, r.y, count(DISTINCT r.id) AS cnt FROM records r JOIN codes c ON r.id = c.id GROUP BY c.code, r.y)""",
    "tech_landscape_quarter": """
SELECT c.code, concat(CAST(r.y AS VARCHAR(4)), 'Q', CAST(r.q AS VARCHAR(1))) AS period, count(DISTINCT r.id) AS cnt
FROM records r JOIN codes c ON r.id = c.id GROUP BY c.code, r.y, r.q""",
    "tech_landscape_growth": """
WITH counts AS (SELECT c.code, r.y, count(DISTINCT r.id) AS n FROM records r JOIN codes c ON r.id = c.id GROUP BY c.code, r.y),
anchored AS (SELECT *, max(y) OVER () AS last_y FROM counts),
blocks AS (SELECT code, CAST(sum(CASE WHEN y > last_y - 5 THEN n ELSE 0 END) AS BIGINT) AS recent, CAST(sum(CASE WHEN y > last_y - 6 AND y <= last_y - 5 THEN n ELSE 0 END) AS BIGINT) AS previous FROM anchored GROUP BY code)
SELECT code, recent, previous, round((recent - previous) / CAST(nullif(previous, 0) AS DOUBLE), 6) AS growth FROM blocks""",
    "top_applicants_share": """
SELECT firm, n, round(100.0 * n / total, 4) AS share_pct FROM (
  SELECT firm, count(DISTINCT id) AS n, (SELECT count(DISTINCT id) FROM owners) AS total FROM owners GROUP BY firm)
ORDER BY n DESC, firm LIMIT 20""",
    # portfolio of a firm, and of all
    "firm_portfolio_histogram": """
SELECT o.firm, c.code, count(DISTINCT o.id) AS n FROM owners o JOIN codes c ON o.id = c.id WHERE o.firm = 1 GROUP BY o.firm, c.code ORDER BY n DESC, code LIMIT 20""",
    "firm_filing_trend": "SELECT o.firm, r.y, count(DISTINCT r.id) AS n FROM owners o JOIN records r ON o.id = r.id GROUP BY o.firm, r.y",
    "firm_portfolio_detail": """
SELECT r.id, CAST(r.d AS VARCHAR(10)) AS filed, r.status, round(r.value, 2) AS value FROM records r JOIN owners o ON r.id = o.id WHERE o.firm = 1 ORDER BY r.d DESC, r.id LIMIT 1000""",
    "patent_detail_nested_counts": """
SELECT r.id, count(DISTINCT c.code) AS n_codes, count(DISTINCT o.firm) AS n_firms FROM records r LEFT JOIN codes c ON r.id = c.id LEFT JOIN owners o ON r.id = o.id GROUP BY r.id""",
    "co_applicant_edges": """
SELECT a.firm AS firm_a, b.firm AS firm_b, count(*) AS shared FROM owners a JOIN owners b ON a.id = b.id AND a.firm < b.firm GROUP BY a.firm, b.firm HAVING count(*) >= 5""",
    "patent_compare_shared": """
SELECT code FROM (SELECT c.code, count(DISTINCT o.firm) AS n FROM owners o JOIN codes c ON o.id = c.id WHERE o.firm IN (1, 2, 3) GROUP BY c.code) WHERE n = 3""",
    # search: intersections of semi joins, facets
    "search_multi_class_intersect": """
SELECT r.id, r.y FROM records r WHERE r.id IN (SELECT id FROM codes WHERE code = 'Brand#11') AND r.id IN (SELECT id FROM codes WHERE code = 'Brand#12') AND r.y BETWEEN 1996 AND 1999""",
    "search_prefix_or": """
SELECT DISTINCT r.id, r.y FROM records r JOIN codes c ON r.id = c.id WHERE (c.code LIKE 'Brand#1%' OR c.code LIKE 'Brand#2%') AND r.y = 1997 AND r.value > 100000""",
    "search_facets": """
SELECT facet, val, count(DISTINCT id) AS n FROM (
  SELECT 'code' AS facet, code AS val, id FROM codes UNION ALL SELECT 'year', CAST(y AS VARCHAR(4)), id FROM records UNION ALL SELECT 'status', status, id FROM records) GROUP BY facet, val""",
    "search_latest_page": "SELECT id, CAST(d AS VARCHAR(10)) AS filed FROM records WHERE status = 'F' ORDER BY d DESC, id LIMIT 20 OFFSET 20",
    "search_short_word": "SELECT doc_id FROM documents WHERE lower(text) LIKE '%mm%' AND lower(text) LIKE '%gear%'",
    "j14_or_key_forms": """
SELECT t.trial_number, count(DISTINCT a.publication_number) AS n FROM (SELECT DISTINCT trial_number, regexp_extract(regexp_replace(patent_number, '[ ,]', '', 'g'), '([0-9]{6,})', 1) AS num FROM ptab_trials WHERE patent_number IS NOT NULL) t
JOIN (SELECT DISTINCT publication_number, regexp_extract(publication_number, '([0-9]{6,})', 1) AS num FROM patent_assignees) a ON t.num = a.num WHERE t.num <> '' GROUP BY t.trial_number""",
    "j11_exists_litigated": """
SELECT count(*) AS n FROM (SELECT DISTINCT publication_number FROM patent_cpc) p WHERE EXISTS (SELECT 1 FROM sep_declarations s WHERE s.publication_number = p.publication_number)""",
    # time series
    "momentum_growth_accel": """
SELECT code, y, n, round(growth, 6) AS growth, round(CASE WHEN lag(y) OVER w IS NULL THEN 0.0 ELSE growth - lag(growth) OVER w END, 6) AS acceleration
FROM (SELECT code, y, n, CASE WHEN before IS NULL OR before = 0 THEN 0.0 ELSE up / CAST(before AS DOUBLE) END AS growth FROM momentum) WINDOW w AS (PARTITION BY code ORDER BY y)""",
    "tech_volatility": """
WITH returns AS (SELECT code, ln(n / CAST(before AS DOUBLE)) AS x FROM momentum WHERE before > 0 AND n > 0)
SELECT code, round(stddev_pop(x), 6) AS sigma, round(avg(x), 6) + 0 AS drift, round(stddev_pop(x) * sqrt(252), 6) AS annual,
  CASE WHEN avg(x) > 0.05 THEN 'growth' WHEN avg(x) > -0.05 THEN 'mature' ELSE 'declining' END AS regime FROM returns GROUP BY code""",
    "tech_beta": """
WITH r AS (SELECT code, y, ln(n / CAST(before AS DOUBLE)) AS x FROM momentum WHERE before > 0 AND n > 0),
tot AS (SELECT y, sum(n) AS n FROM momentum GROUP BY y), m AS (SELECT y, ln(n / CAST(lag(n) OVER (ORDER BY y) AS DOUBLE)) AS mx FROM tot)
SELECT code, round(covar_samp(x, mx) / nullif(var_samp(mx), 0), 5) AS beta, round(avg(x) - covar_samp(x, mx) / nullif(var_samp(mx), 0) * avg(mx), 5) AS alpha, round(pow(corr(x, mx), 2), 5) AS r2
FROM r JOIN m USING (y) WHERE mx IS NOT NULL GROUP BY code""",
    "tech_beta_rolling": """
WITH r AS (SELECT code, y, ln(n / CAST(before AS DOUBLE)) AS x FROM momentum WHERE before > 0 AND n > 0),
tot AS (SELECT y, sum(n) AS n FROM momentum GROUP BY y), m AS (SELECT y, ln(n / CAST(lag(n) OVER (ORDER BY y) AS DOUBLE)) AS mx FROM tot),
j AS (SELECT code, y, x, mx FROM r JOIN m USING (y) WHERE mx IS NOT NULL),
w AS (SELECT code, y, covar_samp(x, mx) OVER f AS c, var_samp(mx) OVER f AS v, count(*) OVER f AS k FROM j WINDOW f AS (PARTITION BY code ORDER BY y ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT code, y, round(c / nullif(v, 0), 4) AS beta3 FROM w WHERE k = 3""",
    "tech_entropy_hhi": """
WITH shares AS (SELECT y, cnt / CAST(sum(cnt) OVER (PARTITION BY y) AS DOUBLE) AS p FROM (SELECT r.y, o.firm, count(*) AS cnt FROM records r JOIN owners o ON r.id = o.id GROUP BY r.y, o.firm))
SELECT y, round(-sum(p * log2(p)), 6) AS entropy, round(sum(p * p), 8) AS hhi, count(*) AS firms FROM shares GROUP BY y""",
    "tech_entropy_lifecycle": """
WITH shares AS (SELECT section, y, cnt / CAST(sum(cnt) OVER (PARTITION BY section, y) AS DOUBLE) AS p, cnt FROM (SELECT c.section, r.y, o.firm, count(*) AS cnt FROM records r JOIN owners o ON r.id = o.id JOIN codes c ON c.id = r.id GROUP BY c.section, r.y, o.firm)),
h AS (SELECT section, y, -sum(p * log2(p)) AS e, CAST(sum(cnt) AS DOUBLE) AS n FROM shares GROUP BY section, y),
s AS (SELECT section, regr_slope(e, y) AS es, regr_slope(n, y) AS ns, avg(n) AS mean FROM h GROUP BY section)
SELECT section, round(es, 5) AS entropy_slope, CASE WHEN es > 0.05 AND ns > 0 THEN 'growth' WHEN abs(es) <= 0.05 AND abs(ns / mean) <= 0.1 THEN 'mature' WHEN es < -0.05 THEN 'declining' ELSE 'introduction' END AS stage FROM s""",
    "citation_age_curve": """
WITH ages AS (SELECT a.y - b.y AS age, count(*) AS n FROM cites c JOIN records a ON c.citing = a.id JOIN records b ON c.cited = b.id GROUP BY a.y - b.y)
SELECT CAST(age AS INT) AS age, n, round(100.0 * sum(n) OVER (ORDER BY age ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 4) AS cumulative_pct FROM ages""",
    "citation_half_life": """
WITH ages AS (SELECT a.y - b.y AS age, count(*) AS n FROM cites c JOIN records a ON c.citing = a.id JOIN records b ON c.cited = b.id GROUP BY a.y - b.y),
cum AS (SELECT age, sum(n) OVER (ORDER BY age ROWS UNBOUNDED PRECEDING) / CAST(sum(n) OVER () AS DOUBLE) AS share FROM ages)
SELECT CAST(min(age) AS INT) AS half_life FROM cum WHERE share >= 0.5""",
    "cagr_with_fallback": """
WITH last_row AS (SELECT code, y, n, lag(n, 5) OVER w AS n5, lag(n, 3) OVER w AS n3, lag(n, 2) OVER w AS n2, row_number() OVER (PARTITION BY code ORDER BY y DESC) AS rn FROM momentum WINDOW w AS (PARTITION BY code ORDER BY y))
SELECT code, round(CASE WHEN n5 > 0 THEN pow(n / CAST(n5 AS DOUBLE), 1 / 5.0) - 1 WHEN n3 > 0 THEN pow(n / CAST(n3 AS DOUBLE), 1 / 3.0) - 1 WHEN n2 > 0 THEN pow(n / CAST(n2 AS DOUBLE), 0.5) - 1 ELSE 0.0 END, 6) AS cagr FROM last_row WHERE rn = 1""",
    "portfolio_evolution": """
WITH yearly AS (SELECT o.firm, c.code, r.y, count(*) AS n FROM owners o JOIN records r ON o.id = r.id JOIN codes c ON c.id = r.id GROUP BY o.firm, c.code, r.y),
top AS (SELECT firm, y, code, row_number() OVER (PARTITION BY firm, y ORDER BY n DESC, code) AS rn FROM yearly)
SELECT firm, y, code, lag(code) OVER (PARTITION BY firm ORDER BY y) AS before FROM top WHERE rn = 1""",
    "tech_trend_hot": """
SELECT code, y, round(up / CAST(before AS DOUBLE), 6) AS growth, CASE WHEN up / CAST(before AS DOUBLE) > 0.3 THEN 'hot' WHEN up / CAST(before AS DOUBLE) < -0.1 THEN 'cooling' ELSE 'steady' END AS state FROM momentum WHERE before > 0""",
    "brief_growth_bands": """
WITH w AS (SELECT code, avg(CASE WHEN y > m - 3 THEN n END) AS late, avg(CASE WHEN y <= m - 3 AND y > m - 6 THEN n END) AS early FROM (SELECT code, y, n, max(y) OVER () AS m FROM momentum) GROUP BY code)
SELECT code, round(late, 4) AS late, round(early, 4) AS early, CASE WHEN late > early * 1.1 THEN 'rising' WHEN late < early * 0.9 THEN 'falling' ELSE 'flat' END AS band FROM w""",
    "best_year_90pct": """
WITH n AS (SELECT year, count(*) AS c FROM surface GROUP BY year) SELECT max(year) AS best_year FROM n WHERE c >= greatest(1, floor(0.9 * (SELECT max(c) FROM n)))""",
    "yp3_argmax_year": "SELECT year FROM (SELECT year, count(*) AS c FROM surface GROUP BY year) ORDER BY c DESC, year DESC LIMIT 1",
    "yp1_exact_else_latest": """
SELECT firm_id, cluster_id, year, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY firm_id, cluster_id ORDER BY CASE WHEN year = 2020 THEN 0 ELSE 1 END, year DESC) AS rn FROM surface) WHERE rn = 1""",
    "yp5_healthy_year": "SELECT CAST(max(y) AS INT) AS y FROM (SELECT y, avg(up / CAST(before AS DOUBLE)) AS g FROM momentum WHERE before > 0 GROUP BY y) WHERE g > -0.3",
    # surface tools
    "rank_in_cluster_year": "SELECT firm_id, cluster_id, year, CAST(rank() OVER (PARTITION BY cluster_id, year ORDER BY score DESC) AS BIGINT) AS rnk FROM surface WHERE year = 2022",
    "startability_ranking_by_tech": """
SELECT cluster_id, firm_id, round(score, 6) AS score, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, firm_id) AS BIGINT) AS rn FROM surface WHERE year = 2021) WHERE rn <= 20""",
    "score_delta_full_outer": """
SELECT coalesce(a.firm_id, b.firm_id) AS firm_id, coalesce(a.cluster_id, b.cluster_id) AS cluster_id, round(coalesce(b.score, 0) - coalesce(a.score, 0), 6) AS delta
FROM (SELECT * FROM surface WHERE year = 2018) a FULL OUTER JOIN (SELECT * FROM surface WHERE year = 2022) b ON a.firm_id = b.firm_id AND a.cluster_id = b.cluster_id
WHERE abs(coalesce(b.score, 0) - coalesce(a.score, 0)) >= 0.0001""",
    "score_histogram": "SELECT CAST(least(floor(score * 10), 9) AS INT) AS bin, count(*) AS n FROM surface GROUP BY 1",
    "tech_trend_alert_risers": """
WITH d AS (SELECT a.firm_id, b.score - a.score AS delta FROM surface a JOIN surface b ON a.firm_id = b.firm_id AND a.cluster_id = b.cluster_id WHERE a.year = 2019 AND b.year = 2022)
SELECT firm_id, round(avg(delta), 6) AS mean_delta, count(*) AS n FROM d GROUP BY firm_id HAVING avg(delta) > 0.05""",
    "startability_heatmap": """
WITH f AS (SELECT firm_id FROM (SELECT firm_id, count(*) AS n FROM surface WHERE year = 2022 GROUP BY firm_id) ORDER BY n DESC, firm_id LIMIT 20),
c AS (SELECT cluster_id FROM (SELECT cluster_id, count(*) AS n FROM surface WHERE year = 2022 GROUP BY cluster_id) ORDER BY n DESC, cluster_id LIMIT 20)
SELECT f.firm_id, c.cluster_id, round(coalesce(s.score, 0), 6) AS score FROM f CROSS JOIN c LEFT JOIN surface s ON s.firm_id = f.firm_id AND s.cluster_id = c.cluster_id AND s.year = 2022""",
    "tech_gap_pairs": """
WITH a AS (SELECT cluster_id, max(score) AS sa FROM surface WHERE firm_id = 'company_1001' GROUP BY cluster_id), b AS (SELECT cluster_id, max(score) AS sb FROM surface WHERE firm_id = 'company_1038' GROUP BY cluster_id)
SELECT coalesce(a.cluster_id, b.cluster_id) AS cluster_id, CASE WHEN coalesce(sa, 0) > 0.3 AND coalesce(sb, 0) > 0.3 THEN 'overlap' WHEN coalesce(sa, 0) - coalesce(sb, 0) > 0.1 THEN 'a_stronger' WHEN coalesce(sb, 0) - coalesce(sa, 0) > 0.1 THEN 'b_stronger' ELSE 'even' END AS relation FROM a FULL OUTER JOIN b ON a.cluster_id = b.cluster_id""",
    "adversarial_contested": """
WITH p AS (SELECT cluster_id, max(CASE WHEN firm_id = 'company_1001' THEN score END) AS a, max(CASE WHEN firm_id = 'company_1186' THEN score END) AS b FROM surface GROUP BY cluster_id)
SELECT cluster_id, round(abs(coalesce(a, 0) - coalesce(b, 0)), 6) AS gap, CASE WHEN abs(coalesce(a, 0) - coalesce(b, 0)) <= CASE WHEN a > 0.8 AND b > 0.8 THEN 0.15 ELSE 0.05 END THEN 'contested' WHEN coalesce(a, 0) > coalesce(b, 0) THEN 'a_strong' ELSE 'b_strong' END AS zone FROM p WHERE a IS NOT NULL OR b IS NOT NULL""",
    "moat_percentiles": """
WITH r AS (SELECT firm_id, cluster_id, percent_rank() OVER (PARTITION BY cluster_id ORDER BY score) AS pr FROM surface WHERE year = 2022)
SELECT firm_id, round(0.5 * avg(pr) + 0.3 * avg(CASE WHEN pr >= 0.9 THEN 1.0 ELSE 0.0 END) + 0.2 * count(*) / CAST((SELECT count(DISTINCT cluster_id) FROM surface WHERE year = 2022) AS DOUBLE), 6) AS moat FROM r GROUP BY firm_id""",
    "position_counts": """
WITH r AS (SELECT firm_id, rank() OVER (PARTITION BY cluster_id ORDER BY score DESC) / CAST(count(*) OVER (PARTITION BY cluster_id) AS DOUBLE) AS p FROM surface WHERE year = 2021)
SELECT firm_id, CAST(sum(CASE WHEN p <= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS leading, CAST(sum(CASE WHEN p > 0.1 AND p <= 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS competitive, count(*) AS n FROM r GROUP BY firm_id""",
    "ma_consolidation": """
WITH own AS (SELECT cluster_id, max(score) AS s FROM surface WHERE firm_id = 'company_1001' AND year >= 2020 GROUP BY cluster_id),
x AS (SELECT t.firm_id, sum(t.s * own.s) AS raw FROM (SELECT firm_id, cluster_id, max(score) AS s FROM surface WHERE year >= 2020 AND firm_id <> 'company_1001' GROUP BY firm_id, cluster_id) t JOIN own ON own.cluster_id = t.cluster_id GROUP BY t.firm_id)
SELECT firm_id, round(raw / nullif(top, 0), 6) AS fit FROM x CROSS JOIN (SELECT max(raw) AS top FROM x)""",
    # citations and flows
    "citation_counts_full_outer": """
SELECT coalesce(a.p, b.p) AS publication_number, coalesce(a.n, 0) AS citing_count, coalesce(b.n, 0) AS cited_by_count
FROM (SELECT citing_publication AS p, count(*) AS n FROM patent_citations GROUP BY 1) a FULL OUTER JOIN (SELECT cited_publication AS p, count(*) AS n FROM patent_citations GROUP BY 1) b ON a.p = b.p""",
    "knowledge_flow_matrix": """
WITH first_code AS (SELECT id, min(section) AS section FROM codes GROUP BY id)
SELECT a.section AS citing_class, b.section AS cited_class, count(*) AS n FROM cites c JOIN first_code a ON c.citing = a.id JOIN first_code b ON c.cited = b.id WHERE a.section <> b.section GROUP BY a.section, b.section""",
    "knowledge_flow_net": """
WITH first_code AS (SELECT id, min(section) AS section FROM codes GROUP BY id), f AS (SELECT a.section AS s, b.section AS t FROM cites c JOIN first_code a ON c.citing = a.id JOIN first_code b ON c.cited = b.id WHERE a.section <> b.section)
SELECT class, CAST(sum(e) AS BIGINT) AS exports, CAST(sum(i) AS BIGINT) AS imports, CAST(sum(e) - sum(i) AS BIGINT) AS net FROM (SELECT t AS class, 1 AS e, 0 AS i FROM f UNION ALL SELECT s, 0, 1 FROM f) GROUP BY class""",
    "spillover_rate": """
WITH first_code AS (SELECT id, min(section) AS section FROM codes GROUP BY id)
SELECT round(sum(CASE WHEN a.section <> b.section THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS rate FROM cites c JOIN first_code a ON c.citing = a.id JOIN first_code b ON c.cited = b.id""",
    "network_degrees": """
SELECT degree, count(*) AS nodes FROM (SELECT node, count(DISTINCT other) AS degree FROM (SELECT citing AS node, cited AS other FROM cites UNION ALL SELECT cited, citing FROM cites) GROUP BY node) GROUP BY degree""",
    "power_law_mle": """
WITH d AS (SELECT node, count(DISTINCT other) AS k FROM (SELECT citing_publication AS node, cited_publication AS other FROM patent_citations UNION ALL SELECT cited_publication, citing_publication FROM patent_citations) WHERE node <> other GROUP BY node)
SELECT count(*) AS n, round(1 + count(*) / sum(ln(k / 0.5)), 6) AS gamma FROM d""",
    "fusion_pairs_auto": """
SELECT a.section AS section_a, b.section AS section_b, CAST(sum(CASE WHEN r.y >= 1999 THEN 1 ELSE 0 END) AS BIGINT) AS recent, CAST(sum(CASE WHEN r.y < 1999 THEN 1 ELSE 0 END) AS BIGINT) AS older
FROM (SELECT DISTINCT id, section FROM codes) a JOIN (SELECT DISTINCT id, section FROM codes) b ON a.id = b.id AND a.section < b.section JOIN records r ON r.id = a.id GROUP BY a.section, b.section""",
    "fusion_active_firms": """
WITH f AS (SELECT o.firm, r.y, max(CASE WHEN c.code = 'Brand#11' THEN 1 ELSE 0 END) AS a, max(CASE WHEN c.code = 'Brand#22' THEN 1 ELSE 0 END) AS b FROM owners o JOIN records r ON o.id = r.id JOIN codes c ON c.id = r.id GROUP BY o.firm, r.y)
SELECT y, CAST(sum(a * b) AS BIGINT) AS both_areas, count(*) AS firms FROM f GROUP BY y""",
    # standards, trials, litigation
    "sep_search": "SELECT declaration_id, standard_name, declarant, declaration_date FROM sep_declarations WHERE lower(standard_name) LIKE '%mesh%' AND standard_org IS NOT NULL ORDER BY declaration_date DESC NULLS LAST, declaration_id LIMIT 50",
    "sep_landscape": """
WITH d AS (SELECT standard_name, declarant, count(*) AS n FROM sep_declarations WHERE declarant IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY standard_name) AS DOUBLE) AS share, row_number() OVER (PARTITION BY standard_name ORDER BY n DESC, declarant) AS rn FROM d)
SELECT standard_name, CAST(sum(n) AS BIGINT) AS n, count(*) AS declarants, round(sum(share * share), 8) AS hhi, round(sum(CASE WHEN rn <= 3 THEN share ELSE 0 END), 6) AS top3,
  CASE WHEN sum(share * share) < 0.15 THEN 'competitive' WHEN sum(share * share) <= 0.25 THEN 'moderate' ELSE 'concentrated' END AS label FROM s GROUP BY standard_name""",
    "sep_portfolio_peers": """
WITH mine AS (SELECT DISTINCT standard_name FROM sep_declarations WHERE declarant = (SELECT min(declarant) FROM sep_declarations WHERE length(declarant) > 20))
SELECT declarant, count(*) AS n FROM sep_declarations WHERE standard_name IN (SELECT standard_name FROM mine) AND declarant IS NOT NULL GROUP BY declarant ORDER BY n DESC, declarant LIMIT 20""",
    "frand_royalty_stack": """
SELECT standard_name, declarant, round(0.10 * n / CAST(sum(n) OVER (PARTITION BY standard_name) AS DOUBLE), 8) AS royalty, round(sum(n) OVER (PARTITION BY standard_name ORDER BY n DESC, declarant ROWS UNBOUNDED PRECEDING) / CAST(sum(n) OVER (PARTITION BY standard_name) AS DOUBLE), 6) AS cumulative
FROM (SELECT standard_name, declarant, count(*) AS n FROM sep_declarations WHERE declarant IS NOT NULL GROUP BY 1, 2)""",
    "ptab_status_rates": """
SELECT lower(trim(prosecution_status)) AS status, count(DISTINCT trial_number) AS n FROM ptab_trials WHERE prosecution_status IS NOT NULL GROUP BY 1""",
    "ptab_risk_patent": """
WITH t AS (SELECT DISTINCT trial_number, publication_number, lower(trim(prosecution_status)) AS s FROM ptab_trials WHERE publication_number IS NOT NULL)
SELECT publication_number, count(*) AS n, round(least(1.0, 0.3 + 0.5 * avg(CASE WHEN s = 'instituted' THEN 1.0 ELSE 0.0 END) + 0.05 * least(count(*), 4)), 6) AS risk FROM t GROUP BY publication_number""",
    "litigation_risk_firm": """
WITH c AS (SELECT DISTINCT case_id, plaintiff, defendant FROM patent_litigation), u AS (SELECT defendant AS firm, 1 AS d, 0 AS p FROM c UNION ALL SELECT plaintiff, 0, 1 FROM c)
SELECT firm, CAST(sum(d) AS BIGINT) AS as_defendant, CAST(sum(p) AS BIGINT) AS as_plaintiff, round(0.7 * least(1.0, sum(d) / 10.0) + 0.3 * least(0.3, sum(p) / 30.0), 6) AS risk FROM u WHERE firm IS NOT NULL GROUP BY firm""",
    "litigation_courts": "SELECT court, outcome, count(DISTINCT case_id) AS n, round(avg(damages_amount), 2) AS mean_damages FROM patent_litigation GROUP BY court, outcome",
    "option_greeks": """
WITH a AS (SELECT id, value AS s, greatest(y + 20 - 2005.0, 0.5) AS t FROM records WHERE value > 0), b AS (SELECT id, s, t, (ln(s / 100000.0) + (0.02 + 0.045) * t) / (0.3 * sqrt(t)) AS d1 FROM a), c AS (SELECT *, d1 - 0.3 * sqrt(t) AS d2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM b),
k AS (SELECT *, 1 / (1 + 0.3275911 * abs(d1) / sqrt(2.0)) AS t1, 1 / (1 + 0.3275911 * abs(d2) / sqrt(2.0)) AS t2 FROM c), n AS (SELECT *, CASE WHEN d1 >= 0 THEN 1 - (t1 * (0.254829592 + t1 * (-0.284496736 + t1 * (1.421413741 + t1 * (-1.453152027 + t1 * 1.061405429)))) * exp(-d1 * d1 / 2)) / 2 ELSE (t1 * (0.254829592 + t1 * (-0.284496736 + t1 * (1.421413741 + t1 * (-1.453152027 + t1 * 1.061405429)))) * exp(-d1 * d1 / 2)) / 2 END AS n1, CASE WHEN d2 >= 0 THEN 1 - (t2 * (0.254829592 + t2 * (-0.284496736 + t2 * (1.421413741 + t2 * (-1.453152027 + t2 * 1.061405429)))) * exp(-d2 * d2 / 2)) / 2 ELSE (t2 * (0.254829592 + t2 * (-0.284496736 + t2 * (1.421413741 + t2 * (-1.453152027 + t2 * 1.061405429)))) * exp(-d2 * d2 / 2)) / 2 END AS n2 FROM k)
SELECT id, round(n1, 5) + 0 AS delta, round(1000000 * pdf / (s * 0.3 * sqrt(t)), 5) + 0 AS gamma_ppm, round(s * pdf * sqrt(t) / 100, 3) + 0 AS vega, round((-s * pdf * 0.3 / (2 * sqrt(t)) - 0.02 * 100000 * exp(-0.02 * t) * n2) / 365, 4) + 0 AS theta, round(100000 * t * exp(-0.02 * t) * n2 / 100, 3) + 0 AS rho FROM n""",
    # value, family, status
    "family_size": "SELECT family, count(*) AS family_size FROM records GROUP BY family",
    "value_index_minmax": """
WITH f AS (SELECT cited AS id, count(*) AS c FROM cites GROUP BY cited), fam AS (SELECT family, count(*) AS n FROM records GROUP BY family), last AS (SELECT max(y) AS now_y FROM records),
m AS (SELECT c.id, max(greatest(0.0, least(1.0, mo.up / CAST(mo.before AS DOUBLE)))) AS g FROM codes c JOIN momentum mo ON mo.code = c.code CROSS JOIN last WHERE mo.y = now_y AND mo.before > 0 GROUP BY c.id),
v AS (SELECT r.id, 0.35 * ln(1 + coalesce(f.c, 0)) + 0.20 * ln(greatest(fam.n, 1)) + 0.25 * greatest(0.0, least(1.0, (r.y + 20 - now_y) / 20.0)) + 0.20 * coalesce(m.g, 0.0) AS raw FROM records r CROSS JOIN last JOIN fam ON fam.family = r.family LEFT JOIN f ON f.id = r.id LEFT JOIN m ON m.id = r.id),
b AS (SELECT min(raw) AS low, max(raw) AS high FROM v)
SELECT id, round((raw - low) / nullif(high - low, 0), 6) AS value_score FROM v CROSS JOIN b""",
    "legal_status_expiry": """
SELECT id, CASE WHEN status = 'P' THEN 'pending' WHEN y + 20 < 2017 THEN 'expired' WHEN status = 'F' THEN 'alive' ELSE 'abandoned' END AS legal, CAST(y + 20 AS INT) AS expiry_year FROM records""",
    "expiry_timeline": "SELECT CAST(y + 20 AS INT) AS expiry_year, count(*) AS n, round(100.0 * sum(count(*)) OVER (ORDER BY y + 20 ROWS UNBOUNDED PRECEDING) / sum(count(*)) OVER (), 4) AS cumulative_pct FROM records GROUP BY y + 20",
    "remaining_life": "SELECT id, round(greatest(0.0, least(1.0, (y + 20 - 2010) / 20.0)), 6) AS life FROM records",
    "claim_scope": """
WITH c AS (SELECT publication_number, count(DISTINCT substr(cpc_code, 1, 1)) AS s, count(DISTINCT substr(cpc_code, 1, 4)) AS k, count(DISTINCT cpc_code) AS n FROM patent_cpc WHERE cpc_code IS NOT NULL AND cpc_code <> '' GROUP BY 1)
SELECT publication_number, CASE WHEN s >= 3 OR k >= 6 OR n >= 10 THEN 'broad' WHEN s >= 2 OR k >= 3 OR n >= 4 THEN 'moderate' ELSE 'narrow' END AS scope FROM c""",
    "fto_firm_share": """
WITH n AS (SELECT o.firm, count(DISTINCT o.id) AS n FROM owners o JOIN codes c ON o.id = c.id WHERE c.code = 'Brand#33' GROUP BY o.firm), t AS (SELECT count(*) AS cites FROM cites JOIN codes c ON cites.cited = c.id WHERE c.code = 'Brand#33')
SELECT round(0.35 * least(sum(n) / 10000.0, 1.0) + 0.25 * max(n) / CAST(sum(n) AS DOUBLE) + 0.25 * least(max(cites) / 500.0, 1.0) + 0.15 * least(count(*) / 30.0, 1.0), 6) AS risk FROM n CROSS JOIN t""",
    "category_rule_confidence": """
WITH hits AS (SELECT doc_id, CASE WHEN lower(text) LIKE '%antenna%' THEN 1 ELSE 0 END AS kw, CASE WHEN source LIKE 'claims%' THEN 1 ELSE 0 END AS cls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN kw = 1 AND cls = 1 THEN 0.95 WHEN cls = 1 THEN 0.9 ELSE 0.6 END AS confidence FROM hits WHERE kw + cls > 0""",
    "null_statistics": """
SELECT count(*) AS n, CAST(sum(CASE WHEN firm_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS firm_null, CAST(sum(CASE WHEN harmonized_name IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS name_null, CAST(sum(CASE WHEN country_code IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS country_null FROM patent_assignees""",
    "link_coverage": "SELECT country_code, round(100.0 * count(firm_id) / count(*), 4) AS coverage_pct, count(*) AS n FROM patent_assignees GROUP BY country_code",
    "owner_mode_name": """
SELECT firm_id, raw_name AS usual_name, n FROM (SELECT firm_id, raw_name, n, row_number() OVER (PARTITION BY firm_id ORDER BY n DESC, raw_name) AS rn FROM (SELECT firm_id, raw_name, count(*) AS n FROM patent_assignees WHERE firm_id IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1""",
    "upper_median_value": "SELECT status, round(value, 2) AS upper_median FROM (SELECT status, value, row_number() OVER (PARTITION BY status ORDER BY value, id) AS rn, count(*) OVER (PARTITION BY status) AS c FROM records) WHERE rn = floor(c / 2.0) + 1",
    "share_below_value": "SELECT priority, round(avg(CASE WHEN value < 150000 THEN 1.0 ELSE 0.0 END), 6) AS share_below FROM records GROUP BY priority",
    "news_axes_quarter": """
SELECT user_id, CAST(year(ts) AS INT) AS y, CAST(quarter(ts) AS INT) AS q, count(*) AS mentions, round(avg(value), 6) AS tone, round(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / (10.0 + sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)), 6) AS investment FROM events GROUP BY 1, 2, 3""",
    "group_hierarchy_counts": "SELECT relationship, count(*) AS n, round(avg(ownership_pct), 4) AS mean_pct FROM corporate_hierarchy GROUP BY relationship",
}

QUERIES, SQL = declare(BODIES)
for _name in ("j14_or_key_forms",):  # Spark's regexp_replace takes no flags
    from ledgerfold.plans.sqlbase import query as _query

    QUERIES[_name] = _query(SQL[_name].replace(", 'g')", ")"))
