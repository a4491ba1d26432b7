"""The same results in plain SQL, for the queries that SQL can express.

Written from the definitions, not from the Spark plans. Fixed values come from the
catalog; every formula is spelled out here a second time.
"""

from __future__ import annotations

from clientlens.functions import catalog


def _text(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _values(rows, columns: str, name: str) -> str:
    lit = lambda v: _text(v) if isinstance(v, str) else repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {name}({columns})"


# --- shared fragments ---------------------------------------------------------------


def _customers(money_scale: float = 500.0) -> str:
    return f"""
hist AS (
  SELECT o_custkey AS k, max(o_orderdate) AS last_order, min(o_orderdate) AS first_order,
         count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spend
  FROM orders GROUP BY 1),
lines AS (
  SELECT o_custkey AS k, count(DISTINCT p_brand) AS brands,
         CAST(sum(CASE WHEN l_discount >= 0.05e0 THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS disc,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS ret
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
  GROUP BY 1),
ev AS (
  SELECT user_id AS k,
         100e0 * CAST(sum(CASE WHEN event_type IN ('view','click','purchase') THEN 1 ELSE 0 END) AS BIGINT) / count(*) AS eng,
         CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors
  FROM events GROUP BY 1),
cust0 AS (
  SELECT c_custkey AS Customer_ID,
    CAST(least(greatest(date_diff('day', CAST(last_order AS DATE),
         CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) + 1, 1), 365) AS INTEGER) AS Recency_Days,
    CAST(least(greatest(n_orders, 1), 200) AS INTEGER) AS Frequency_Orders,
    greatest(CAST(spend AS DOUBLE) / {money_scale!r}e0, 1e0) AS Monetary_Spend,
    CAST(least(greatest(coalesce(floor(brands / 3e0), 3), 1), 10) AS INTEGER) AS Category_Diversity,
    coalesce(eng, 50e0) AS Engagement_Score,
    CAST(least(greatest(coalesce(floor(errors / 5e0), 1), 0), 20) AS INTEGER) AS Support_Tickets,
    coalesce(disc, 0.15e0) AS Discount_Ratio,
    least(coalesce(ret, 0.05e0), 0.5e0) AS Return_Rate,
    c_mktsegment AS Preferred_Channel, 'Unknown' AS Gender, CAST(35 AS INTEGER) AS Age,
    r_name AS Region, strftime(first_order, '%Y-%m') AS First_Order_Month
  FROM customer JOIN hist ON c_custkey = hist.k
  LEFT JOIN lines ON c_custkey = lines.k LEFT JOIN ev ON c_custkey = ev.k
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
cust AS (
  SELECT *, round_even(Monetary_Spend / Frequency_Orders, 2) AS Avg_Order_Value,
    round_even({_RFM_CHURN}, 3) AS Churn_Risk_Index
  FROM cust0)"""


_RFM_CHURN = (
    "0.4e0 * least(Recency_Days / 120e0, 1e0) + 0.3e0 * greatest(1e0 - Frequency_Orders / 20e0, 0e0)"
    " + 0.2e0 * greatest(1e0 - Engagement_Score / 100e0, 0e0) + 0.1e0 * least(Support_Tickets / 5e0, 1e0)"
)


def _bin(order: str) -> str:
    rank = f"row_number() OVER (ORDER BY {order}, Customer_ID)"
    n = "count(*) OVER ()"
    return f"CAST(greatest(1, (({rank} - 1) * 5 + {n} - 2) // ({n} - 1)) AS INTEGER)"


_SCORED = f"""
scored AS (
  SELECT *, {_bin('Recency_Days DESC')} AS R_Score, {_bin('Frequency_Orders')} AS F_Score,
    {_bin('Monetary_Spend')} AS M_Score
  FROM cust),
seg AS (
  SELECT *, CASE WHEN Recency_Days >= 300 THEN CAST(-1 AS INTEGER) ELSE Segment END AS Density_Label
  FROM (SELECT *, CAST(CASE WHEN R_Score >= 4 AND F_Score >= 4 THEN 0 WHEN R_Score >= 4 AND F_Score <= 2 THEN 1
     WHEN R_Score >= 3 AND F_Score >= 3 THEN 2 WHEN R_Score <= 2 AND F_Score >= 4 THEN 3
     WHEN R_Score = 3 AND F_Score <= 2 THEN 4 ELSE 5 END AS INTEGER) AS Segment FROM scored))"""

_CUST = "WITH " + _customers()
_SEG = _CUST + "," + _SCORED


def _dsum(expr: str, scale: int = 6) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,{scale}))) AS DOUBLE)"


def _davg(expr: str) -> str:
    return f"({_dsum(expr)} / count({expr}))"


def _profile(label: str) -> str:
    """prof: unrounded cluster rows with persona key; per: the rounded rows with texts."""
    texts = _values([(k, t, c, i, t, catalog.PERSONA_RULES[k], "plan for " + k) for k, t, c, i in catalog.PERSONAS], "tkey, persona_title, color, icon, tagline, description, strategy", "tx")
    return f"""
prof0 AS (
  SELECT {label} AS cluster_id, count(*) AS customer_count, {_dsum('Monetary_Spend')} AS rev,
    {_davg('Recency_Days')} AS r, {_davg('Frequency_Orders')} AS f, {_davg('Monetary_Spend')} AS m,
    {_davg('Avg_Order_Value')} AS aov, {_davg('Engagement_Score')} AS eng, {_davg('Discount_Ratio')} AS disc,
    {_davg('Churn_Risk_Index')} AS churn
  FROM seg GROUP BY 1),
q AS (SELECT quantile_cont(Monetary_Spend, 0.7) AS m70, quantile_cont(Monetary_Spend, 0.5) AS m50,
    quantile_cont(CAST(Frequency_Orders AS DOUBLE), 0.65) AS f65, quantile_cont(CAST(Frequency_Orders AS DOUBLE), 0.5) AS f50,
    quantile_cont(CAST(Recency_Days AS DOUBLE), 0.4) AS r40, quantile_cont(CAST(Recency_Days AS DOUBLE), 0.6) AS r60 FROM seg),
prof AS (
  SELECT *, CASE WHEN cluster_id = -1 THEN 'GENERAL'
     WHEN m > m70 AND f > f65 AND r < r40 THEN 'CHAMPION' WHEN r > r60 AND m > m50 THEN 'AT_RISK'
     WHEN disc > 0.55e0 THEN 'BARGAIN' WHEN f <= 4 AND r < 40 THEN 'NEW_BUYER'
     WHEN f >= f50 THEN 'LOYALIST' ELSE 'GENERAL' END AS persona_key,
    customer_count / (SELECT sum(customer_count) FROM prof0) * 100e0 AS cpct,
    rev / (SELECT {_dsum('rev')} FROM prof0) * 100e0 AS rpct
  FROM prof0, q),
per AS (
  SELECT cluster_id, persona_key, persona_title, tagline, description, strategy, color, icon, customer_count,
    round_even(cpct, 2) AS customer_percentage, round_even(rev, 2) AS total_revenue, round_even(rpct, 2) AS revenue_percentage,
    round_even(r, 1) AS avg_recency_days, round_even(f, 1) AS avg_frequency_orders, round_even(m, 2) AS avg_monetary_spend,
    round_even(aov, 2) AS avg_order_value, round_even(eng, 1) AS avg_engagement_score, round_even(disc, 2) AS avg_discount_ratio,
    round_even(churn, 3) AS avg_churn_risk, churn, rev
  FROM prof LEFT JOIN {texts} ON tkey = CASE WHEN cluster_id = -1 THEN 'NOISE' ELSE persona_key END)"""


def _pct(column: str) -> str:
    return (
        f"((rank() OVER (ORDER BY {column}) - 1 + (count(*) OVER (PARTITION BY {column}) + 1) / 2e0)"
        f" / count(*) OVER ())"
    )


_SEVERITY = (
    f"{_pct('Monetary_Spend')} * 0.35e0 + {_pct('Return_Rate')} * 0.25e0"
    f" + {_pct('Discount_Ratio')} * 0.2e0 + {_pct('Churn_Risk_Index')} * 0.2e0"
)


def _flagged(money_scale: float = 500.0) -> str:
    return f"""WITH {_customers(money_scale)},
sev AS (SELECT *, {_SEVERITY} AS severity FROM cust),
flagged AS (SELECT *, severity >= (SELECT quantile_cont(severity, 0.97) FROM sev) AS Is_Anomaly FROM sev)"""


_RAW = """
raw AS (
  SELECT c_custkey AS Customer_ID,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE CAST(date_diff('day', CAST(last_order AS DATE),
      CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS DOUBLE) END AS r,
    n_orders * 1.5e0 AS f, c_acctbal AS m,
    CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal / 50e0 END AS e, c_acctbal / 5000e0 AS d,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS ch, c_mktsegment
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order, count(*) AS n_orders
    FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""

# --- vector fragments ---------------------------------------------------------------

_VEC = """
vec AS (SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
dims AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM vec),
cen AS (SELECT label, i, avg(v) AS c FROM dims GROUP BY 1, 2),
centre AS (SELECT label, list(c ORDER BY i) AS c FROM cen GROUP BY 1)"""

_NEAR = _VEC + """,
near AS (
  SELECT vec_id, vec.label, arg_min(centre.label, struct_pack(d := list_distance(x, c), l := centre.label)) AS nearest,
    min(list_distance(x, c)) AS dist
  FROM vec, centre GROUP BY 1, 2)"""

_GEO = _VEC + """,
geo AS (SELECT vec.label, count(*) AS n, avg(list_distance(x, c)) AS s, sum(list_distance(x, c) ** 2) AS w, any_value(c) AS c
  FROM vec JOIN centre ON vec.label = centre.label GROUP BY 1)"""

# the labelings of the benchmark, long: one row per vector and labeling, noise left out
_BENCH = _NEAR + """,
lab AS (SELECT vec_id, label AS l, 'label' AS run FROM near UNION ALL SELECT vec_id, nearest, 'nearest' FROM near
  UNION ALL SELECT vec_id, label, 'partly' FROM near WHERE label < 8),
pt AS (SELECT lab.*, x FROM lab JOIN vec USING (vec_id)),
bd AS (SELECT run, l, i, avg(x[i]) AS m FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM pt) GROUP BY 1, 2, 3),
bc AS (SELECT run, l, list(m ORDER BY i) AS c FROM bd GROUP BY 1, 2),
bg AS (SELECT run, l, any_value(c) AS c, count(*) AS n, avg(list_distance(x, c)) AS s, sum(list_distance(x, c) ** 2) AS w
  FROM pt JOIN bc USING (run, l) GROUP BY 1, 2),
db AS (SELECT run, avg(worst) AS db FROM (SELECT a.run, a.l, max((a.s + b.s) / list_distance(a.c, b.c)) AS worst
  FROM bg a JOIN bg b ON a.run = b.run AND a.l <> b.l GROUP BY 1, 2) GROUP BY 1),
md AS (SELECT run, list(m ORDER BY i) AS m FROM (SELECT run, i, avg(x[i]) AS m FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM pt) GROUP BY 1, 2) GROUP BY 1),
ch AS (SELECT run, count(*) AS k, sum(n) AS n, (sum(n * list_distance(c, m) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS ch
  FROM bg JOIN md USING (run) GROUP BY 1),
dp AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.x, b.x) AS d FROM vec a, vec b WHERE a.vec_id <> b.vec_id),
mp AS (SELECT la.run, dp.a, la.l AS la, lb.l AS lb, avg(d) AS m FROM dp JOIN lab la ON la.vec_id = dp.a
  JOIN lab lb ON lb.vec_id = dp.b AND lb.run = la.run GROUP BY 1, 2, 3, 4),
si AS (SELECT run, avg(CASE WHEN a0 IS NULL THEN 0e0 ELSE (b0 - a0) / greatest(a0, b0) END) AS sil FROM
  (SELECT run, a, la, max(CASE WHEN la = lb THEN m END) AS a0, min(CASE WHEN la <> lb THEN m END) AS b0 FROM mp GROUP BY 1, 2, 3) GROUP BY 1),
bm AS (SELECT run, k, (SELECT count(*) FROM vec) - n AS noise, round_even(sil, 4) AS sil, round_even(db, 4) AS db, round_even(ch, 2) AS ch
  FROM ch JOIN db USING (run) JOIN si USING (run))"""


def _silhouettes(power: int) -> str:
    """By Euclidean distance (power 1) or its square, pair by pair."""
    return _VEC + f""",
pair AS (SELECT a.vec_id, a.label AS la, b.label AS lb, sum(list_distance(a.x, b.x) ** {power}) AS s, count(*) AS n
  FROM vec a, vec b WHERE a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, la, max(CASE WHEN la = lb THEN s / n END) AS a, min(CASE WHEN la <> lb THEN s / n END) AS b
  FROM pair GROUP BY 1, 2),
sil AS (SELECT vec_id, la AS label, CASE WHEN a IS NULL THEN 0e0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


def _matrix() -> str:
    logs = set(catalog.LOG_COLUMNS)
    raw = [f"ln(1 + {c})" if c in logs else f"CAST({c} AS DOUBLE)" for c in catalog.MATRIX_NUMERICS]
    cols = ", ".join(f"{e} AS t{i}" for i, e in enumerate(raw))
    scaled = ", ".join(
        f"CASE WHEN (SELECT stddev_pop(t{i}) FROM lg) = 0 THEN 0e0 ELSE (t{i} - (SELECT avg(t{i}) FROM lg)) / (SELECT stddev_pop(t{i}) FROM lg) END AS x{i}"
        for i in range(len(raw))
    )
    return f"""
lg AS (SELECT Customer_ID, Preferred_Channel, {cols} FROM cust),
sc AS (SELECT Customer_ID, Preferred_Channel, {scaled} FROM lg),
chan AS (SELECT list(ch ORDER BY ch) AS chans FROM (SELECT DISTINCT Preferred_Channel AS ch FROM cust))"""


_X = ", ".join(f"x{i}" for i in range(len(catalog.MATRIX_NUMERICS)))


def _dbscan(eps: float, min_samples: int) -> str:
    return f"""WITH RECURSIVE {_customers()}, {_matrix()},
pts AS MATERIALIZED (SELECT Customer_ID AS id, list_concat([{_X}],
    list_transform(chans, lambda ch: CASE WHEN ch = Preferred_Channel THEN 1e0 ELSE 0e0 END)) AS x FROM sc, chan),
nb AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM pts a, pts b WHERE list_distance(a.x, b.x) <= {eps!r}e0),
core AS MATERIALIZED (SELECT a AS id FROM nb GROUP BY 1 HAVING count(*) >= {min_samples}),
edge AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS root, id FROM core UNION SELECT reach.root, edge.b FROM reach JOIN edge ON edge.a = reach.id),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY 1),
num AS (SELECT root, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS label FROM (SELECT DISTINCT root FROM comp)),
lab AS (SELECT id, label FROM comp JOIN num USING (root)),
border AS (SELECT a AS id, min(label) AS label FROM nb JOIN lab ON nb.b = lab.id WHERE a NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT pts.id AS Customer_ID, CAST(coalesce(lab.label, border.label, -1) AS INTEGER) AS label
FROM pts LEFT JOIN lab ON pts.id = lab.id LEFT JOIN border ON pts.id = border.id"""


# --- churn drivers ------------------------------------------------------------------


def _driver_ctes() -> str:
    parts = []
    for i, c in enumerate(catalog.MODEL_FEATURES):
        base, weight = catalog.CHURN_BASELINES[c], catalog.CHURN_WEIGHTS[c]
        parts.append(
            f"SELECT Customer_ID, Churn_Risk_Index, {i} AS pos, '{c}' AS feature, CAST({c} AS DOUBLE) AS raw, "
            f"(CAST({c} AS DOUBLE) - {base!r}e0) / {base!r}e0 * ({weight!r}e0) AS i0 FROM cust"
        )
    return f"""
d0 AS ({' UNION ALL '.join(parts)}),
d1 AS (SELECT *, round_even(raw, 2) AS value, round_even(i0, 4) AS impact,
   CASE WHEN i0 > 0 THEN 'increases_churn' ELSE 'reduces_churn' END AS direction FROM d0),
tot AS (SELECT Customer_ID, list_reduce(list_prepend(0e0, list(abs(impact) ORDER BY abs(impact) DESC, pos)), lambda a, b: a + b) AS t
   FROM d1 GROUP BY 1),
d2 AS (SELECT d1.*, round_even(abs(impact) / CASE WHEN t = 0 THEN 1e0 ELSE t END * 100e0, 1) AS importance_pct,
   CAST(row_number() OVER (PARTITION BY Customer_ID ORDER BY abs(impact) DESC, pos) AS INTEGER) AS driver_rank,
   row_number() OVER (PARTITION BY Customer_ID, direction ORDER BY abs(impact) DESC, pos) AS side_rank
   FROM d1 JOIN tot USING (Customer_ID))"""


def _names(direction: str) -> str:
    return f"coalesce(string_agg(CASE WHEN direction = '{direction}' AND side_rank <= 3 THEN feature END, ',' ORDER BY driver_rank), '')"


def _first(direction: str, expr: str) -> str:
    return f"max(CASE WHEN direction = '{direction}' AND side_rank = 1 THEN {expr} END)"


# --- scenarios ----------------------------------------------------------------------

_SCENARIOS = [
    ("default", 15.0, 2.0, 10.0, 2, "all"),
    ("touch", 15.0, 2.0, 10.0, 6, "at_risk"),
    ("value", 30.0, 1.0, 2.0, 1, "high_value_risk"),
    ("lost", 50.0, 5.0, 0.0, 0, "lost"),
    ("free", 0.0, 0.0, 0.0, 0, "all"),
]


def _scenarios() -> str:
    rows = _values(_SCENARIOS, "scenario, boost, tick, disc, touch, target", "s")
    return f"""{_CUST},
sim AS (SELECT s.*, c.*, round_even(least(greatest(
    0.4e0 * least(Recency_Days / 120e0, 1e0) * (1e0 - greatest(0e0, least(0.2e0, touch * 0.05e0)))
    + 0.3e0 * greatest(1e0 - Frequency_Orders / 20e0, 0e0)
    + 0.2e0 * greatest(1e0 - least(Engagement_Score * (1e0 + CAST(boost AS DOUBLE) / 100e0), 100e0) / 100e0, 0e0)
    + 0.1e0 * least(greatest(Support_Tickets - CAST(tick AS DOUBLE), 0e0) / 5e0, 1e0), 0e0), 1e0), 3) AS after
  FROM cust c, {rows}
  WHERE CASE target WHEN 'at_risk' THEN Churn_Risk_Index >= 0.5e0
    WHEN 'high_value_risk' THEN Churn_Risk_Index >= 0.4e0 AND Monetary_Spend >= (SELECT median(Monetary_Spend) FROM cust)
    WHEN 'lost' THEN Recency_Days >= 90 ELSE true END),
agg AS (SELECT scenario, target, CAST(boost AS DOUBLE) AS boost, CAST(tick AS DOUBLE) AS tick, CAST(disc AS DOUBLE) AS disc, touch,
    count(*) AS n, {_dsum('Monetary_Spend')} AS spend, {_dsum('Churn_Risk_Index')} AS churn, {_dsum('after')} AS after,
    CAST(sum(CASE WHEN Churn_Risk_Index >= 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS high,
    CAST(sum(CASE WHEN after >= 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS still,
    {_dsum('Monetary_Spend * Churn_Risk_Index', 8)} AS risk, {_dsum('Monetary_Spend * after', 8)} AS rest
  FROM sim GROUP BY ALL),
fin AS (SELECT *, risk - rest AS rec, n * (spend / n * (disc / 100e0) + touch * 0.5e0) AS cost FROM agg)
SELECT scenario, target AS target_cohort, n AS target_audience_count, round_even(churn / n, 3) AS initial_avg_churn,
  round_even(after / n, 3) AS simulated_avg_churn, round_even((churn / n - after / n) * 100e0, 1) AS churn_reduction_pct,
  high AS initial_high_risk_count, still AS simulated_high_risk_count, greatest(0, high - still) AS rescued_customers,
  round_even(greatest(0e0, rec), 2) AS recovered_revenue, round_even(cost, 2) AS total_campaign_cost,
  round_even(rec - cost, 2) AS net_value_generated, CASE WHEN cost > 0 THEN round_even(rec / cost, 2) ELSE 0e0 END AS roi_factor,
  boost AS engagement_boost_pct, tick AS ticket_reduction, disc AS discount_incentive_pct, CAST(touch AS INTEGER) AS email_touchpoints
FROM fin"""


# --- answers and report -------------------------------------------------------------

_FACTS = f"""
ans AS (SELECT arg_max(struct_pack(id := cluster_id, title := persona_title, v := churn), struct_pack(a := churn, b := -cluster_id)) AS risky,
   arg_max(struct_pack(id := cluster_id, title := persona_title, v := rev), struct_pack(a := rev, b := -cluster_id)) AS rich,
   sum(customer_count) AS n, {_dsum('rev')} AS rev FROM per),
allc AS (SELECT {_dsum('Churn_Risk_Index')} / count(*) AS avg_churn FROM seg),
noise AS (SELECT count(*) AS n, count(*) FILTER (WHERE Density_Label = -1) AS k, count(DISTINCT CASE WHEN Density_Label <> -1 THEN Density_Label END) AS c FROM seg),
answers AS (
 SELECT 'Churn Analysis' AS category,
   'cluster=' || risky.id || '; persona=' || risky.title || '; churn=' || printf('%.1f%%', risky.v * 100)
     || '; all=' || printf('%.1f%%', avg_churn * 100) AS answer,
   risky.id AS cluster_id, risky.title AS persona, round_even(risky.v, 3) AS value, round_even(avg_churn, 3) AS reference_value,
   'review_cluster' AS recommended_action FROM ans, allc
 UNION ALL SELECT 'Revenue Intelligence',
   'cluster=' || rich.id || '; persona=' || rich.title || '; revenue=' || format('{{:,.2f}}', rich.v)
     || printf('; share=%.1f%%', rich.v / rev * 100e0),
   rich.id, rich.title, round_even(rich.v, 2), round_even(rich.v / rev * 100e0, 2),
   'review_cluster' FROM ans
 UNION ALL SELECT 'Density & Outlier Detection',
   'outliers=' || k || printf('; share=%.1f%%; setting=', k / n * 100e0) || 'unknown', CAST(c AS INTEGER), NULL, CAST(k AS DOUBLE),
   round_even(k / n * 100e0, 2), 'review_outliers' FROM noise
 UNION ALL SELECT 'General Customer Intelligence',
   'customers=' || format('{{:,}}', CAST(n AS BIGINT)) || '; revenue=' || format('{{:,.2f}}', rev) || '; segments=6; spend='
     || format('{{:,.2f}}', rev / n), NULL, NULL, round_even(rev, 2), round_even(rev / n, 2),
   'review_segments' FROM ans)"""

_CAMPAIGNS = _values([(k, "campaign for " + k, "response of " + k) for k in catalog.CAMPAIGN_KEYS], "ckey, recommended_campaign, success_metric", "cp")

_PRIORITY = f"""
prio AS (SELECT cluster_id, persona_title,
   round_even(0.45e0 * revenue_percentage + 35e0 * avg_churn_risk + 0.2e0 * customer_percentage, 2) AS priority_score,
   round_even(rev * churn, 2) AS expected_revenue_at_risk, recommended_campaign, success_metric,
   customer_count AS estimated_audience
  FROM per LEFT JOIN {_CAMPAIGNS} ON ckey = persona_key)"""


def _report() -> str:
    facts = [("data_source", "'orders'"), ("trained_at", "(SELECT max(First_Order_Month) FROM seg)"),
             ("production_model", "'K-Means Clustering'"), ("anomaly_model", "'DBSCAN'"), ("optimal_k", "'6'"),
             ("best_benchmark", "NULL"), ("stability", "NULL")]
    run = " UNION ALL ".join(f"SELECT 0, {i}, 0, '{k}', CAST({v} AS VARCHAR)" for i, (k, v) in enumerate(facts))
    fixed = lambda e: f"printf('%.2f', {e})"
    overview = [("customers", "CAST(CAST(tot.n AS BIGINT) AS VARCHAR)"), ("segments", "CAST(c AS VARCHAR)"), ("revenue", fixed("rev")),
                ("spend_per_customer", fixed("rev / tot.n")), ("outliers", "CAST(k AS VARCHAR)"),
                ("outlier_percentage", fixed("round_even(k / noise.n * 100, 2)")), ("top_revenue_cluster", "CAST(rich AS VARCHAR)"),
                ("top_churn_cluster", "CAST(risky AS VARCHAR)")]
    head = " UNION ALL ".join(f"SELECT 1, {i}, 0, '{k}', {v} FROM tot, noise" for i, (k, v) in enumerate(overview))
    rows = [("persona", "persona_title"), ("customers", "CAST(customer_count AS VARCHAR)"), ("revenue", fixed("total_revenue")),
            ("churn", "printf('%.3f', avg_churn_risk)")]
    segments = " UNION ALL ".join(f"SELECT 2, cluster_id, {i}, cluster_id || '.{k}', {v} FROM per" for i, (k, v) in enumerate(rows))
    plan = [("campaign", "recommended_campaign"), ("priority", fixed("priority_score")),
            ("revenue_at_risk", fixed("expected_revenue_at_risk"))]
    campaigns = " UNION ALL ".join(f"SELECT 3, place, {i}, cluster_id || '.{k}', {v} FROM best" for i, (k, v) in enumerate(plan))
    return f"""{_SEG}, {_profile('Segment')}, {_PRIORITY},
noise AS (SELECT count(*) AS n, count(*) FILTER (WHERE Density_Label = -1) AS k FROM seg),
tot AS (SELECT sum(customer_count) AS n, {_dsum('rev')} AS rev, count(*) AS c,
  arg_max(cluster_id, struct_pack(a := total_revenue, b := -cluster_id)) AS rich,
  arg_max(cluster_id, struct_pack(a := avg_churn_risk, b := -cluster_id)) AS risky FROM per),
best AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, cluster_id) - 1 AS place FROM prio
  QUALIFY row_number() OVER (ORDER BY priority_score DESC, cluster_id) <= 5),
ln(part, place, sub, key, value) AS ({run} UNION ALL {head} UNION ALL {segments} UNION ALL {campaigns}),
named AS (SELECT *, ['run', 'overview', 'segment', 'campaign'][part + 1] AS section FROM ln)
SELECT CAST(row_number() OVER (ORDER BY part, place, sub, key) AS INTEGER) AS line_no, section, key, value,
  section || '.' || key || ' = ' || coalesce(value, '') AS text FROM named"""


# --- logs ---------------------------------------------------------------------------

_OWNER = "coalesce(CASE WHEN Region <> 'AFRICA' THEN Region END, '{}')"


def _digest(prefix: str, *parts: str) -> str:
    return f"'{prefix}' || md5(" + " || '|' || ".join(f"coalesce({p}, '')" for p in parts) + ")"


_ALERTS = f"""{_flagged()},
al AS (SELECT CAST(Customer_ID AS VARCHAR) AS customer_id, {_OWNER.format('system')} AS tenant_id,
  CASE WHEN Churn_Risk_Index > 0.7e0 THEN 'HIGH_CHURN_RISK' ELSE 'ANOMALY_DETECTED' END AS alert_type,
  '{{"customer_id":' || Customer_ID || ',"recency_days":' || Recency_Days || '}}' AS details, First_Order_Month AS created_at
  FROM flagged WHERE Churn_Risk_Index > 0.7e0 OR Is_Anomaly),
alerts AS (SELECT {_digest('alert_', 'alert_type', 'customer_id', 'tenant_id', 'created_at', 'details')} AS id, * FROM al)"""


def _mix(w, tickets: str, returns: str, digits: int, capped: bool = False) -> str:
    cap = (lambda e: f"least({e}, 1e0)") if capped else (lambda e: e)
    eng = "least(Engagement_Score, 100e0)" if capped else "Engagement_Score"
    return (
        f"{_CUST} SELECT Customer_ID, round_even(least(greatest({w[0]}e0 * {cap('Recency_Days / 365e0')} + {w[1]}e0 * (1e0 - {eng} / 100e0)"
        f" + {w[2]}e0 * {cap(f'Support_Tickets / {tickets}')} + {w[3]}e0 * {cap(f'Return_Rate / {returns}')}, 0e0), 1e0), {digits}) AS churn FROM cust"
    )


_CURVES = _values(
    [(k, m, v) for k, vs in catalog.RETENTION_PROFILES.items() for m, v in enumerate(vs)], "pkey, month, base", "cv"
)
_CELLS = _values([(*c, f"R {c[0]}, F {c[1]}") for c in catalog.RFM_CELLS], "r_score, f_score, title, color, action", "cl")
_COHORTS = _values(catalog.RFM_COHORTS, "cohort, cohort_name, color", "co")
_RATES = _values(list(catalog.CURRENCY_RATES.items()), "cur, rate", "rt")
_COPY = _values(
    [(k, t, *[f"{{{k}.{x}}}" for x in ("email_subject", "sms_text", "call_to_action", "discount_offer")])
     for k, t, *_ in catalog.PERSONAS if k in catalog.COPY_KEYS],
    "k, copy_title, email_subject, sms_text, call_to_action, discount_offer", "cc",
)
_FEATS = catalog.MATRIX_NUMERICS
_RECORD_DEFAULTS = ", ".join(
    f"CAST({_text(d) if isinstance(d, str) else d} AS {dict(int='INTEGER', double='DOUBLE', string='VARCHAR')[t]}) AS {n}"
    for n, (t, _, _, d) in catalog.RECORD_FIELDS.items() if d is not None
)


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["customer_table"] = f"{_CUST} SELECT * FROM cust"
    named = [("Customer_ID", "Account ID"), ("Recency_Days", "Days Since Last Order"), ("Frequency_Orders", "Order Count"), ("Monetary_Spend", "Total-Spend")]
    held = {"Engagement_Score", "Discount_Ratio", "Preferred_Channel"}
    told = [("rename", c, f"column '{s}' read as {c}") for c, s in named]
    told += [("default", c, f"column was absent and holds {v}") for c, v in catalog.OPTIONAL_DEFAULTS.items() if c not in held]
    told += [("derived", "Avg_Order_Value", "computed from spend and orders"),
             ("derived", "Churn_Risk_Index", "computed from recency, orders, engagement and tickets")]
    quoted = lambda t: "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in t) + ")"
    medians = {"Recency_Days": "r", "Frequency_Orders": "f", "Monetary_Spend": "m", "Engagement_Score": "e", "Discount_Ratio": "d"}
    sql["conform_warnings"] = f"""WITH {_RAW} SELECT * FROM (VALUES {', '.join(map(quoted, told))}) t(rule, "column", message)""" + "".join(
        f" UNION ALL SELECT 'impute', '{c}', 'missing values hold ' || CAST(median({e}) AS VARCHAR) FROM raw HAVING count(*) > count({e})"
        for c, e in medians.items())
    sql["upload_lines"] = """WITH k AS (SELECT c_custkey AS id, c_custkey % 10 AS r, c_nationkey AS n, c_mktsegment AS s FROM customer)
SELECT CASE WHEN r NOT IN (1, 2, 3, 4) THEN CAST(id AS BIGINT) END AS customer_id, CASE WHEN r NOT IN (1, 2, 3, 4, 5) THEN CAST(n AS INTEGER) END AS nation,
  CASE WHEN r = 5 THEN s || ', Inc' WHEN r NOT IN (1, 2, 3, 4) THEN s END AS segment,
  CASE r WHEN 1 THEN id || ',' || n WHEN 2 THEN id || ',' || n || ',' || s || ',more' WHEN 3 THEN id || ',"' || n || ',' || s WHEN 4 THEN id || ',n/a,' || s END AS line,
  CASE r WHEN 1 THEN 'too few fields' WHEN 2 THEN 'too many fields' WHEN 3 THEN 'open quote' WHEN 4 THEN 'unreadable value' END AS reason FROM k"""
    sql["conform_clip"] = f"""WITH {_RAW},
med AS (SELECT median(r) AS r, median(f) AS f, median(e) AS e FROM raw),
fil AS (SELECT Customer_ID, coalesce(raw.r, med.r) AS r, coalesce(raw.f, med.f) AS f, m, coalesce(raw.e, med.e) AS e, d, ch FROM raw, med),
con AS (SELECT Customer_ID, CAST(round_even(least(greatest(r, 1), 365), 0) AS INTEGER) AS Recency_Days,
  CAST(round_even(least(greatest(f, 1), 200), 0) AS INTEGER) AS Frequency_Orders, greatest(m, 1e0) AS Monetary_Spend,
  CAST(3 AS INTEGER) AS Category_Diversity, least(greatest(e, 1e0), 100e0) AS Engagement_Score, CAST(1 AS INTEGER) AS Support_Tickets,
  least(greatest(d, 0e0), 1e0) AS Discount_Ratio, 0.05e0 AS Return_Rate, coalesce(ch, 'Web') AS Preferred_Channel,
  'Unknown' AS Gender, CAST(35 AS INTEGER) AS Age FROM fil)
SELECT *, round_even(Monetary_Spend / Frequency_Orders, 2) AS Avg_Order_Value, round_even({_RFM_CHURN}, 3) AS Churn_Risk_Index FROM con"""
    sql["input_validation"] = f"""WITH {_RAW},
chk AS (SELECT Customer_ID AS customer_id, CAST(r AS INTEGER) AS r, CAST(trunc(f) AS INTEGER) AS f, m, e, d,
  concat_ws(',', CASE WHEN r IS NULL OR r < 0 OR r > 3650 THEN 'Recency_Days' END,
    CASE WHEN f IS NULL OR trunc(f) < 0 OR trunc(f) > 5000 THEN 'Frequency_Orders' END,
    CASE WHEN m IS NULL OR m < 0 THEN 'Monetary_Spend' END,
    CASE WHEN e < 0 OR e > 100 THEN 'Engagement_Score' END, CASE WHEN d < 0 OR d > 1 THEN 'Discount_Ratio' END) AS reasons FROM raw)
SELECT customer_id, reasons, CASE WHEN reasons = '' THEN r END AS Recency_Days, CASE WHEN reasons = '' THEN f END AS Frequency_Orders,
  CASE WHEN reasons = '' THEN m END AS Monetary_Spend, CASE WHEN reasons = '' THEN CAST(3 AS INTEGER) END AS Category_Diversity,
  CASE WHEN reasons = '' THEN coalesce(e, 70e0) END AS Engagement_Score, CASE WHEN reasons = '' THEN coalesce(d, 0.2e0) END AS Discount_Ratio
FROM chk"""
    sql["csv_round_trip"] = f"{_CUST} SELECT Customer_ID, Recency_Days, Monetary_Spend, Preferred_Channel, Region FROM cust"
    sql["tenant_partition"] = f"""{_CUST} SELECT 'ASIA' AS asked_by, Customer_ID, Monetary_Spend, Region FROM cust WHERE Region = 'ASIA'
UNION ALL SELECT 'NOBODY', Customer_ID, Monetary_Spend, Region FROM cust"""
    sql["tenant_replaced"] = f"""{_CUST} SELECT 'ASIA' AS asked_by, Customer_ID, Monetary_Spend * 2 AS Monetary_Spend, Region FROM cust WHERE Region = 'ASIA'
UNION ALL SELECT 'NOBODY', Customer_ID, Monetary_Spend, Region FROM cust"""
    sql["dataset_status"] = f"""{_CUST} SELECT 'uploaded_csv:customers.csv' AS data_source, 'User File: customers.csv' AS display_name,
  true AS is_custom, count(*) AS total_samples FROM cust"""
    sql["model_info"] = f"""{_SEG} SELECT 'Gaussian Mixture Model (GMM)' AS production_model, 'DBSCAN' AS anomaly_model,
  count(*) AS total_samples, CAST(count(DISTINCT Segment) AS INTEGER) AS optimal_k FROM seg"""
    core = """WITH h AS (SELECT o_custkey AS k, max(o_orderdate) AS last_order, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS k, date_diff('day', CAST(last_order AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) + 400.5e0 AS days, n,
  abs(CAST(c_acctbal AS DOUBLE)) * 1000e0 + 1e6 AS spend FROM customer JOIN h ON c_custkey = k)
SELECT k AS Customer_ID, CAST(least(greatest(round_even(days, 0), 1), 365) AS INTEGER) AS Recency_Days,
  CAST(least(greatest(n, 1), 200) AS INTEGER) AS Frequency_Orders, greatest(spend, 1e0) AS Monetary_Spend FROM r"""
    sql["conform_fragments"] = sql["conform_magnitudes"] = core
    bounds = [(c, c in catalog.CORE_COLUMNS, float(r[0])) for c, r in catalog.VALUE_RANGES.items()]
    sql["upload_schema"] = f"{_CUST} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {str(need).lower()} AS required, {low!r}e0 AS low, min({c}) >= {low!r}e0 AS within FROM cust"
        for c, need, low in bounds
    )
    sql["arrival_ids"] = "SELECT count(*) AS n, count(*) AS n_ids, 10001 AS first_id, 10000 + count(*) AS last_id FROM customer"
    sql["churn_rfm"] = f"{_CUST} SELECT Customer_ID, Churn_Risk_Index AS churn FROM cust"
    sql["churn_gen"] = _mix((0.45, 0.25, 0.15, 0.15), "15e0", "0.4e0", 4)
    sql["churn_single"] = _mix((0.5, 0.25, 0.15, 0.1), "12e0", "0.3e0", 4)
    sql["churn_pred"] = _mix((0.45, 0.25, 0.15, 0.15), "15e0", "0.4e0", 3, capped=True)
    sql["churn_labels"] = f"""{_CUST} SELECT Customer_ID, CASE WHEN Churn_Risk_Index > 0.35e0 THEN 1e0 ELSE 0e0 END AS churned,
  CASE WHEN Recency_Days > 30 OR Support_Tickets >= 2 OR Engagement_Score < 55 THEN 1e0 ELSE 0e0 END AS churned_by_rules FROM cust"""
    sql["churn_drivers"] = f"""{_CUST}, {_driver_ctes()}
SELECT Customer_ID, driver_rank, feature, value, impact, importance_pct, direction FROM d2"""
    sql["churn_driver_lists"] = f"""{_CUST}, {_driver_ctes()}
SELECT Customer_ID, round_even(any_value(Churn_Risk_Index), 3) AS overall_churn_risk, {_names('increases_churn')} AS risk,
  {_names('reduces_churn')} AS retention,
  coalesce('Main churn risk: ' || {_first('increases_churn', "replace(feature, '_', ' ')")} || ' at ' || {_first('increases_churn', 'value')} || '. ',
     'No feature raises churn risk. ') ||
  coalesce('Main loyalty anchor: ' || {_first('reduces_churn', "replace(feature, '_', ' ')")} || ' at ' || {_first('reduces_churn', 'value')} || '.', '')
  AS churn_summary FROM d2 GROUP BY Customer_ID"""
    sql["risk_bands"] = f"""{_CUST} SELECT Customer_ID, CASE WHEN Churn_Risk_Index >= 0.7e0 THEN 'CRITICAL CHURN RISK'
  WHEN Churn_Risk_Index >= 0.4e0 THEN 'MODERATE CHURN RISK' ELSE 'LOW CHURN RISK' END AS risk_category,
  CASE WHEN Churn_Risk_Index >= 0.7e0 THEN '#EF4444' WHEN Churn_Risk_Index >= 0.4e0 THEN '#F59E0B' ELSE '#10B981' END AS badge_color FROM cust"""
    group = "CAST(R_Score AS VARCHAR) || F_Score || M_Score AS RFM_Group"
    sql["rfm_train"] = f"""{_CUST}, s AS (SELECT Customer_ID, 6 - {_bin('Recency_Days')} AS R_Score,
  {_bin('Frequency_Orders')} AS F_Score, {_bin('Monetary_Spend')} AS M_Score FROM cust)
SELECT *, R_Score + F_Score + M_Score AS RFM_Score_Sum, {group} FROM s"""
    sql["rfm_analytics"] = f"""{_SEG} SELECT Customer_ID, R_Score, F_Score, M_Score,
  R_Score + F_Score + M_Score AS RFM_Score_Sum, {group} FROM seg"""
    sql["rfm_grid"] = f"""{_SEG}, c AS (SELECT R_Score AS r, F_Score AS f, count(*) AS n, {_davg('Monetary_Spend')} AS m FROM seg GROUP BY 1, 2)
SELECT CAST(r_score AS INTEGER) AS r_score, CAST(f_score AS INTEGER) AS f_score, coalesce(n, 0) AS count,
  round_even(coalesce(m, 0e0), 2) AS avg_spend, title, action, color FROM {_CELLS} LEFT JOIN c ON r_score = r AND f_score = f"""
    sql["rfm_cohorts"] = f"""{_SEG}, c AS (SELECT Segment, count(*) AS n FROM seg GROUP BY 1)
SELECT CAST(cohort AS INTEGER) AS cohort, cohort_name, coalesce(n, 0) AS count,
  round_even(coalesce(n, 0) / (SELECT count(*) FROM seg) * 100, 1) AS percentage, color FROM {_COHORTS} LEFT JOIN c ON cohort = Segment"""
    sql["overview_kpis"] = f"""{_SEG} SELECT count(*) AS total_customers, round_even({_dsum('Monetary_Spend')}, 2) AS total_revenue,
  round_even({_davg('Monetary_Spend')}, 2) AS avg_spend_per_customer, round_even({_davg('Recency_Days')}, 1) AS avg_recency_days,
  round_even({_davg('Frequency_Orders')}, 1) AS avg_frequency_orders, round_even({_davg('Churn_Risk_Index')}, 3) AS avg_churn_risk,
  count(DISTINCT CASE WHEN Density_Label <> -1 THEN Density_Label END) AS optimal_clusters_count FROM seg"""
    sql["distinct_labels"] = f"{_SEG} SELECT DISTINCT Density_Label FROM seg WHERE Density_Label <> -1"
    quant = lambda c, p: f"SELECT '{c}' AS \"column\", {p!r}e0 AS p, quantile_cont(CAST({c} AS DOUBLE), {p}) AS value FROM cust"
    sql["exact_quantiles"] = f"{_CUST} " + " UNION ALL ".join(
        quant(c, p) for c, p in [("Monetary_Spend", 0.7), ("Monetary_Spend", 0.5), ("Frequency_Orders", 0.65),
                                 ("Frequency_Orders", 0.5), ("Recency_Days", 0.4), ("Recency_Days", 0.6)]
    )
    metrics = """customer_count, customer_percentage, total_revenue, revenue_percentage, avg_recency_days, avg_frequency_orders,
  avg_monetary_spend, avg_order_value, avg_engagement_score, avg_discount_ratio, avg_churn_risk"""
    sql["persona_profile"] = f"{_SEG}, {_profile('Density_Label')} SELECT cluster_id, {metrics} FROM per"
    sql["persona_rules"] = f"""{_SEG}, {_profile('Density_Label')}
SELECT cluster_id, persona_key, persona_title, tagline, description, strategy, color, icon FROM per"""
    sql["persona_per_customer"] = f"""{_SEG}, {_profile('Segment')} SELECT Customer_ID,
  coalesce(persona_title, 'Cluster ' || Segment) AS persona, coalesce(color, '#3B82F6') AS persona_color
FROM seg LEFT JOIN (SELECT * FROM per WHERE cluster_id < 4) p ON Segment = cluster_id"""
    z = " UNION ALL ".join(
        f"SELECT g.cluster_id, g.n, {i} AS pos, '{c}' AS feature, g.c{i} AS cm, w.m{i} AS gm, "
        f"(g.c{i} - w.m{i}) / CASE WHEN w.s{i} = 0 THEN 1e0 ELSE w.s{i} END AS z FROM g, w"
        for i, c in enumerate(_FEATS)
    )
    sql["segment_drivers"] = f"""{_SEG},
w AS (SELECT {', '.join(f'avg({c}) AS m{i}, stddev_samp({c}) AS s{i}' for i, c in enumerate(_FEATS))} FROM seg),
g AS (SELECT Segment AS cluster_id, count(*) AS n, {', '.join(f'avg({c}) AS c{i}' for i, c in enumerate(_FEATS))} FROM seg GROUP BY 1),
zs AS ({z}),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round_even(abs(z), 9) DESC, pos) AS k,
  CASE WHEN z > 0 THEN 'above average' ELSE 'below average' END AS direction FROM zs),
st AS (SELECT cluster_id, 'Marked by: ' || string_agg(replace(feature, '_', ' ') || ' is ' || direction, ', ' ORDER BY k) || '.' AS plain_english
  FROM rk WHERE k <= 3 GROUP BY 1)
SELECT rk.cluster_id, n AS sample_size, CAST(k AS INTEGER) AS driver_rank, feature, direction, round_even(abs(z), 3) AS strength,
  round_even(cm, 3) AS cluster_average, round_even(gm, 3) AS global_average, plain_english FROM rk JOIN st USING (cluster_id) WHERE k <= 4"""
    sql["campaign_priority"] = f"{_SEG}, {_profile('Segment')}, {_PRIORITY} SELECT * FROM prio"
    sql["imported_drivers"], sql["imported_campaigns"] = sql["segment_drivers"], sql["campaign_priority"]
    sql["imported_runs"] = """WITH sold AS (SELECT c_nationkey AS nation, c_nationkey || '/' || c_mktsegment AS run_id, o_orderpriority AS p
  FROM customer JOIN orders ON o_custkey = c_custkey),
runs AS (SELECT nation, run_id, count(*) AS total_samples, CAST(count(DISTINCT p) AS INTEGER) AS optimal_k FROM sold GROUP BY 1, 2),
lists AS (SELECT run_id, CAST(left(p, 1) AS INTEGER) AS cluster_id, max(p) AS persona_title, count(*) AS estimated_audience FROM sold GROUP BY 1, 2)
SELECT run_id, total_samples, optimal_k, cluster_id, persona_title, estimated_audience, CAST(NULL AS VARCHAR) AS reason
FROM runs JOIN lists USING (run_id) WHERE nation % 5 IN (0, 4)
UNION ALL SELECT run_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN nation % 5 = 2 THEN 'unreadable value' ELSE 'not a run document' END
FROM runs WHERE nation % 5 NOT IN (0, 4)"""
    sql["campaign_copy"] = f"""{_SEG}, {_profile('Segment')},
w AS (SELECT cluster_id, CASE WHEN persona_key = 'GENERAL' THEN 'LOYALIST' ELSE persona_key END AS copy_key FROM per)
SELECT cluster_id, copy_key, copy_title, email_subject, sms_text, call_to_action, discount_offer FROM w JOIN {_COPY} ON copy_key = k"""
    sql["high_risk_topk"] = f"""{_SEG} SELECT Customer_ID AS customer_id, Segment AS cluster, round_even(Churn_Risk_Index, 3) AS churn_risk_index,
  round_even(Monetary_Spend, 2) AS monetary_spend, Recency_Days AS recency_days, Frequency_Orders AS frequency_orders,
  'contact' AS recommended_action
FROM seg ORDER BY Churn_Risk_Index DESC, seg.Monetary_Spend DESC, seg.Customer_ID LIMIT 25"""
    sql["target_cohort"] = f"""{_CUST} SELECT Customer_ID, Churn_Risk_Index, Monetary_Spend FROM cust
WHERE Churn_Risk_Index >= 0.4e0 AND Monetary_Spend >= (SELECT median(Monetary_Spend) FROM cust)"""
    sql["micro_segment"] = f"""{_SEG}, {_profile('Segment')} SELECT Customer_ID, persona_title AS persona, Monetary_Spend, Recency_Days, Churn_Risk_Index
FROM seg JOIN per ON Segment = cluster_id WHERE persona_title = 'VIP Champions' AND Churn_Risk_Index * 100e0 <= 45e0
  AND Monetary_Spend >= 5000e0 AND Recency_Days <= 60"""
    sql["currency_view"] = f"""{_CUST}, c AS (SELECT *, CASE Region WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'EUR' WHEN 'ASIA' THEN 'INR'
  WHEN 'MIDDLE EAST' THEN 'AED' ELSE 'XOF' END AS currency FROM cust)
SELECT Customer_ID, Monetary_Spend * coalesce(CAST(rate AS DOUBLE), 1e0) AS Monetary_Spend,
  Avg_Order_Value * coalesce(CAST(rate AS DOUBLE), 1e0) AS Avg_Order_Value, currency FROM c LEFT JOIN {_RATES} ON currency = cur"""
    sql["alert_candidates"] = f"""{_flagged()} SELECT Customer_ID, Churn_Risk_Index, Is_Anomaly,
  CASE WHEN Churn_Risk_Index > 0.7e0 THEN 'HIGH_CHURN_RISK' ELSE 'ANOMALY_DETECTED' END AS alert_type
FROM flagged WHERE Churn_Risk_Index > 0.7e0 OR Is_Anomaly"""
    sql["anomaly_severity"] = f"""{_SEG}, noise AS (SELECT * FROM seg WHERE Density_Label = -1),
sv AS (SELECT *, {_SEVERITY} AS sev FROM noise)
SELECT Customer_ID AS customer_id, round_even(sev, 3) AS severity, round_even(Monetary_Spend, 2) AS monetary_spend, round_even(Return_Rate, 3) AS return_rate,
  round_even(Discount_Ratio, 3) AS discount_ratio, round_even(Churn_Risk_Index, 3) AS churn_risk_index FROM sv ORDER BY sev DESC, sv.Customer_ID LIMIT 25"""
    sql["anomaly_counts"] = f"""{_SEG} SELECT count(*) FILTER (WHERE Density_Label = -1) AS count,
  round_even(count(*) FILTER (WHERE Density_Label = -1) / count(*) * 100, 2) AS percentage FROM seg"""
    kind = """CASE WHEN NOT Is_Anomaly THEN 'Normal Pattern'
  WHEN Monetary_Spend > 15000 OR (Monetary_Spend > 8000 AND Frequency_Orders > 40) THEN 'VIP Whale Outlier'
  WHEN Support_Tickets >= 5 OR (Support_Tickets >= 3 AND Return_Rate > 0.3e0) THEN 'High Friction / Fraud Suspect'
  WHEN Return_Rate > 0.35e0 THEN 'Abnormal Return Behavior'
  WHEN Recency_Days > 180 AND Monetary_Spend > 5000 THEN 'Dormant High Value Customer' ELSE 'Behavioral Outlier' END"""
    sql["anomaly_types"] = f"{_flagged(200.0)} SELECT Customer_ID, Is_Anomaly, {kind} AS Anomaly_Type FROM flagged"
    sql["anomaly_type_counts"] = f"{_flagged(200.0)} SELECT {kind} AS Anomaly_Type, count(*) AS n FROM flagged WHERE Is_Anomaly GROUP BY 1"
    sql["scenario_compare"] = _scenarios()
    sql["retention_curve"] = f"""{_SEG}, {_profile('Segment')},
cu AS (SELECT cluster_id, persona_key, customer_count, CAST(month AS INTEGER) AS month, CASE WHEN month = 0 THEN 100e0
  ELSE round_even(least(greatest(CAST(base AS DOUBLE) * (1e0 - 0.25e0 * (avg_churn_risk - 0.2e0)), 2e0), 100e0), 1) END AS retention_pct
  FROM per JOIN {_CURVES} ON pkey = persona_key)
SELECT cluster_id, persona_key, customer_count, round_even(100e0 - max(CASE WHEN month = 12 THEN retention_pct END) OVER (PARTITION BY cluster_id), 1) AS m12_churn_rate,
  month, retention_pct FROM cu"""
    sql["cohort_retention_observed"] = """WITH act AS (SELECT DISTINCT o_custkey AS k, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m FROM orders),
f AS (SELECT k, min(m) AS first FROM act GROUP BY 1),
c AS (SELECT first, m - first AS later, count(*) AS n FROM act JOIN f USING (k) GROUP BY 1, 2),
s AS (SELECT first, n AS size FROM c WHERE later = 0)
SELECT printf('%04d-%02d', first // 12, first % 12 + 1) AS cohort, CAST(later AS INTEGER) AS months_later, size AS cohort_size,
  n AS active_customers, n / size AS retention FROM c JOIN s USING (first)"""
    sql["answer_table"] = f"{_SEG}, {_profile('Segment')}, {_FACTS} SELECT * FROM answers"
    sql["question_routing"] = f"""{_SEG}, {_profile('Segment')}, {_FACTS},
asked AS (SELECT conv_id, turn, text AS question FROM conversations),
rt AS (SELECT *, CASE WHEN question ILIKE '%churn%' OR question ILIKE '%risk%' THEN 'Churn Analysis'
  WHEN question ILIKE '%revenue%' OR question ILIKE '%highest spend%' OR question ILIKE '%champion%' OR question ILIKE '%top spend%' THEN 'Revenue Intelligence'
  WHEN question ILIKE '%silhouette%' OR question ILIKE '%elbow%' OR question ILIKE '%best algorithm%' OR question ILIKE '%best model%' OR question ILIKE '%evaluation%' THEN 'Model Benchmark & Silhouette Analysis'
  WHEN question ILIKE '%dbscan%' OR question ILIKE '%outlier%' OR question ILIKE '%noise%' THEN 'Density & Outlier Detection'
  ELSE 'General Customer Intelligence' END AS category FROM asked)
SELECT conv_id, turn, question, rt.category, answer FROM rt LEFT JOIN answers ON rt.category = answers.category"""
    sql["report_lines"] = _report()
    sql["nearest_centroid"] = f"WITH {_NEAR} SELECT vec_id, nearest, round_even(dist, 6) AS distance FROM near"
    sql["nearest_within"] = f"WITH {_NEAR} SELECT vec_id, CASE WHEN dist > 2.5e0 * 0.36e0 THEN -1 ELSE nearest END AS DBSCAN_Cluster FROM near"
    sql["davies_bouldin"] = f"""WITH {_GEO},
r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS worst FROM geo a JOIN geo b ON a.label <> b.label GROUP BY 1)
SELECT round_even(avg(worst), 6) AS davies_bouldin FROM r"""
    sql["calinski_harabasz"] = f"""WITH {_GEO},
mid AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(v) AS m FROM dims GROUP BY 1))
SELECT CAST(count(*) AS INTEGER) AS n_clusters, round_even((sum(n * list_distance(c, m) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz FROM geo, mid"""
    sql["silhouette_euclidean"] = f"WITH {_silhouettes(1)} SELECT round_even(avg(s), 6) AS silhouette_euclidean FROM sil"
    sql["silhouette_squared_euclidean"] = f"WITH {_silhouettes(2)} SELECT round_even(avg(s), 6) AS silhouette_squared_euclidean FROM sil"
    sql["silhouette_samples"] = f"""WITH {_silhouettes(1)},
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s, vec_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY label) // 10) AS step FROM sil)
SELECT label, CAST(i // step AS INTEGER) AS place, round_even(s, 6) AS silhouette FROM p WHERE i % step = 0"""
    sql["clustering_benchmark"] = f"""WITH {_BENCH} SELECT CASE run WHEN 'label' THEN 'given' WHEN 'partly' THEN 'partly noise' ELSE run END AS algorithm,
  CAST(k AS INTEGER) AS clusters, CAST(noise AS BIGINT) AS noise, sil AS silhouette_score, db AS davies_bouldin, ch AS calinski_harabasz FROM bm"""
    sql["answer_benchmark"] = f"""WITH {_BENCH}, top AS (SELECT * FROM bm WHERE run IN ('label', 'nearest') ORDER BY sil DESC, run DESC LIMIT 1)
SELECT 'Model Benchmark & Silhouette Analysis' AS category, 'algorithm=' || run || '; silhouette=' || sil || '; k=10' AS answer,
  CAST(10 AS INTEGER) AS cluster_id, run AS persona, sil AS value, db AS reference_value,
  'review_k_grid' AS recommended_action FROM top"""
    sql["class_report"] = f"""WITH {_NEAR}, cls AS (SELECT DISTINCT label AS c FROM near UNION SELECT nearest FROM near),
n AS (SELECT c, CAST((SELECT count(*) FROM near WHERE label = c) AS BIGINT) AS support, (SELECT count(*) FROM near WHERE nearest = c) AS named,
  (SELECT count(*) FROM near WHERE label = c AND nearest = c) AS hit FROM cls),
s AS (SELECT *, coalesce(hit / nullif(named, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM n),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM s)
SELECT CAST(c AS INTEGER) AS class, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(f1, 6) AS f1_score, support,
  round_even((SELECT sum(hit) / sum(support) FROM f), 4) AS accuracy, round_even((SELECT sum(f1 * support) / sum(support) FROM f), 4) AS weighted_f1_score FROM f"""
    sql["adjusted_rand"] = f"""WITH {_NEAR},
c AS (SELECT label, nearest, count(*) AS n FROM near GROUP BY 1, 2),
a AS (SELECT sum(n * (n - 1) / 2e0) AS v FROM (SELECT label, sum(n) AS n FROM c GROUP BY 1)),
b AS (SELECT sum(n * (n - 1) / 2e0) AS v FROM (SELECT nearest, sum(n) AS n FROM c GROUP BY 1)),
t AS (SELECT sum(n * (n - 1) / 2e0) AS v, sum(n) AS n FROM c)
SELECT round_even((t.v - a.v * b.v / (t.n * (t.n - 1) / 2e0)) / ((a.v + b.v) / 2e0 - a.v * b.v / (t.n * (t.n - 1) / 2e0)), 9) AS adjusted_rand_index FROM a, b, t"""
    sql["standard_scaled"] = f"""{_CUST}, {_matrix()} SELECT Customer_ID, {', '.join(f'round_even(x{i}, 6) AS x{i}' for i in range(len(_FEATS)))},
  array_to_string(list_transform(chans, lambda ch: CASE WHEN ch = Preferred_Channel THEN '1' ELSE '0' END), '') || '1' AS flags FROM sc, chan"""
    sql["dbscan_labels"] = _dbscan(1.2, 5)
    sql["transaction_log"] = f"""{_CUST}, t AS (SELECT CAST(Customer_ID AS VARCHAR) AS customer_id, {_OWNER.format('guest')} AS tenant_id, * EXCLUDE (Customer_ID) FROM cust)
SELECT {_digest('tx_', 'customer_id', 'tenant_id', 'First_Order_Month', 'CAST(Recency_Days AS VARCHAR)', 'CAST(Frequency_Orders AS VARCHAR)', "printf('%.6f', Monetary_Spend)")} AS id, tenant_id, customer_id, Recency_Days AS recency_days,
  Frequency_Orders AS frequency_orders, Monetary_Spend AS monetary_spend, First_Order_Month AS created_at FROM t"""
    sql["audit_log"] = f"""{_CUST}, t AS (SELECT 'transaction_ingested' AS action, {_OWNER.format('guest')} AS tenant_id, First_Order_Month AS stamp,
  '{{"customer_id":' || Customer_ID || ',"frequency_orders":' || Frequency_Orders || '}}' AS details FROM cust)
SELECT {_digest('evt_', 'action', 'tenant_id', 'details', 'stamp')} AS id, tenant_id, action, details, stamp AS timestamp FROM t"""
    sql["alert_log"] = f"{_ALERTS} SELECT id, tenant_id, alert_type, customer_id, details, created_at FROM alerts"
    sql["recent_alerts"] = f"""{_ALERTS} SELECT id, alert_type, customer_id, details, created_at FROM alerts WHERE tenant_id = 'ASIA'
ORDER BY created_at DESC, id LIMIT 15"""
    sql["ingest_stream"] = f"""{_CUST}, r AS (SELECT CAST(Customer_ID AS VARCHAR) AS Customer_ID, {_OWNER.format('guest')} AS tenant_id, First_Order_Month AS created_at,
  Recency_Days, Frequency_Orders, Monetary_Spend FROM cust), f AS (SELECT *, {_RECORD_DEFAULTS} FROM r)
SELECT *, round_even(least(greatest(0.45e0 * least(Recency_Days / 365e0, 1e0) + 0.25e0 * (1e0 - least(Engagement_Score, 100e0) / 100e0)
  + 0.15e0 * least(Support_Tickets / 15e0, 1e0) + 0.15e0 * least(Return_Rate / 0.4e0, 1e0), 0e0), 1e0), 3) AS Churn_Risk_Index FROM f"""
    sql["alert_stream"] = f"""{_CUST}, a AS (SELECT CAST(Customer_ID AS VARCHAR) AS customer_id, Region AS tenant_id,
  CASE WHEN Churn_Risk_Index > 0.7e0 THEN 'HIGH_CHURN_RISK' ELSE 'ANOMALY_DETECTED' END AS alert_type,
  '{{"customer_id":"' || Customer_ID || '","recency_days":' || Recency_Days || '}}' AS details, First_Order_Month AS created_at
  FROM cust WHERE Churn_Risk_Index > 0.7e0 OR Support_Tickets >= 3)
SELECT {_digest('alert_', 'alert_type', 'customer_id', 'tenant_id', 'created_at', 'details')} AS id, * FROM a"""
    sql["ingest_log_stream"] = sql["ingest_once_stream"] = sql["transaction_log"]
    sql["alert_once_stream"] = sql["alert_stream"]
    return sql
