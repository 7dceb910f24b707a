"""Queries: deciles, thresholds, ranking quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deciles as dec
from ..operators import link
from .bindings import sql
from .registry import query


def _r(df, digits=9):
    return df.withColumns({c: F.round(c, digits) for c, k in df.dtypes if k == "double"})


@query("deciles_qcut", sql("SELECT lead_id, decile FROM scored"))
def deciles_qcut(t):
    return t.scored.select("lead_id", "decile")


_BANDS = """bands AS (SELECT decile, min(lead_score) AS threshold_min, max(lead_score) AS threshold_max, count(*) AS count,
  avg(lead_score) AS mean_probability, stddev_samp(lead_score) AS std_probability FROM scored WHERE captured_at < DATE '2024-01-22' GROUP BY decile)"""
_ASSIGNED = _BANDS + """, assigned AS (SELECT l.lead_id, coalesce(
    (SELECT arg_min(b.decile, (b.threshold_min, b.decile)) FROM bands b WHERE l.lead_score BETWEEN b.threshold_min AND b.threshold_max),
    (SELECT max(10) FROM bands b WHERE b.decile = 10 AND l.lead_score > b.threshold_max),
    (SELECT max(1) FROM bands b WHERE b.decile = 1 AND l.lead_score < b.threshold_min),
    (SELECT arg_min(b.decile, (abs(l.lead_score - (b.threshold_min + b.threshold_max) / 2), b.decile)) FROM bands b)) AS decile,
  l.decile AS qcut_decile FROM scored l)"""


def _bands(t):
    """Thresholds learnt on the first three weeks."""
    return dec.thresholds(t.scored.filter("captured_at < DATE '2024-01-22'"))


@query(
    "decile_thresholds",
    sql("""SELECT decile, threshold_min, threshold_max, count, round(mean_probability, 9) AS mean_probability,
  round(std_probability, 9) AS std_probability FROM bands""", _BANDS),
)
def decile_thresholds(t):
    return _r(_bands(t)).select("decile", "threshold_min", "threshold_max", "count", "mean_probability", "std_probability")


@query("decile_assign", sql("SELECT lead_id, decile FROM assigned", _ASSIGNED))
def decile_assign(t):
    return dec.assign_deciles(t.leads, _bands(t)).select("lead_id", "decile")


@query(
    "threshold_checks",
    sql("""SELECT decile, next_decile, round(gap, 9) AS gap, gap > 0.01 AS has_gap, gap < 0 AS overlaps FROM (
  SELECT decile, lead(decile) OVER (ORDER BY decile) AS next_decile, lead(threshold_min) OVER (ORDER BY decile) - threshold_max AS gap FROM bands)
WHERE next_decile IS NOT NULL""", _BANDS),
)
def threshold_checks(t):
    return _r(dec.threshold_checks(_bands(t)))


@query(
    "threshold_stability",
    sql("""SELECT sum(n) AS leads, round(stddev_samp(n) / avg(n), 9) AS cv, round(sum(n) FILTER (r <= 3) * 100.0 / sum(n), 9) AS top3_pct,
  round(max(n) * 100.0 / sum(n), 9) AS max_pct, 10 - count(*) AS empty_deciles,
  stddev_samp(n) / avg(n) <= 0.5 AND sum(n) FILTER (r <= 3) * 100.0 / sum(n) <= 60 AND max(n) * 100.0 / sum(n) <= 50 AND 10 - count(*) <= 2 AS viable
FROM (SELECT decile, count(*) AS n, row_number() OVER (ORDER BY decile DESC) AS r FROM assigned GROUP BY decile)""", _ASSIGNED),
)
def threshold_stability(t):
    return _r(dec.threshold_stability(dec.assign_deciles(t.leads, _bands(t))))


@query(
    "decile_method_difference",
    sql("""SELECT decile, count(*) FILTER (kind = 'q') AS n_left, count(*) FILTER (kind = 't') AS n_right,
  count(*) FILTER (kind = 't') - count(*) FILTER (kind = 'q') AS diff,
  round((count(*) FILTER (kind = 't') - count(*) FILTER (kind = 'q')) * 100.0 / count(*) FILTER (kind = 'q'), 9) AS diff_pct
FROM (SELECT decile, 't' AS kind FROM assigned UNION ALL SELECT qcut_decile, 'q' FROM assigned) GROUP BY decile""", _ASSIGNED),
)
def decile_method_difference(t):
    both = dec.assign_deciles(t.scored, _bands(t), to="by_threshold")
    return _r(dec.compare_decile_counts(both, "decile", "by_threshold"))


_LIFT = """y AS (SELECT s.decile, s.lead_score, l.target FROM scored s JOIN target_leads l ON s.lead_id = l.lead_id),
per AS (SELECT decile, count(*) AS total_leads, sum(target) AS conversions, round(avg(target), 4) AS conversion_rate FROM y GROUP BY decile),
lifts AS (SELECT *, round(conversions * 100.0 / (SELECT sum(target) FROM y), 2) AS conversion_share,
  round(conversion_rate / (SELECT avg(target) FROM y), 2) AS lift FROM per)"""


@query("decile_lift", sql("SELECT decile, total_leads, conversions, conversion_rate, conversion_share, lift FROM lifts", _LIFT))
def decile_lift(t):
    return dec.decile_lift(link.target_by_email_or_phone(t.scored, t.sales))


@query(
    "ranking_metrics",
    sql("""SELECT top3_share, top5_share, max_lift, round(monotonicity, 6) AS monotonicity, round(d10_over_d1, 6) AS d10_over_d1, conversions, round(auc, 9) AS auc FROM
 (SELECT round(sum(conversion_share) FILTER (r <= 3), 6) AS top3_share, round(sum(conversion_share) FILTER (r <= 5), 6) AS top5_share, max(lift) AS max_lift,
   avg(CASE WHEN conversion_rate >= prev THEN 1.0 ELSE 0.0 END) FILTER (prev IS NOT NULL) * 100 AS monotonicity,
   coalesce(max(conversion_rate) FILTER (decile = 10) / nullif(max(conversion_rate) FILTER (decile = 1), 0), 0) AS d10_over_d1, sum(conversions) AS conversions
  FROM (SELECT *, lag(conversion_rate) OVER (ORDER BY decile) AS prev, row_number() OVER (ORDER BY decile DESC) AS r FROM lifts)),
 (SELECT (sum(rk) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2.0)
    / (count(*) FILTER (target = 1) * 1.0 * count(*) FILTER (target = 0)) AS auc
  FROM (SELECT target, rank() OVER (ORDER BY lead_score) + (count(*) OVER (PARTITION BY lead_score) - 1) / 2.0 AS rk FROM y))""", _LIFT),
)
def ranking_metrics(t):
    out = dec.ranking_metrics(link.target_by_email_or_phone(t.scored, t.sales))
    return out.withColumns({c: F.round(c, 6) for c in ("top3_share", "top5_share", "monotonicity", "d10_over_d1")}).withColumn("auc", F.round("auc", 9))


@query(
    "cumulative_revenue",
    sql("""SELECT decile, round(revenue, 2) AS revenue, round(sum(revenue) OVER (ORDER BY decile DESC), 2) AS cumulative_revenue,
  round(sum(revenue) OVER (ORDER BY decile DESC) * 100.0 / sum(revenue) OVER (), 6) AS cumulative_pct
FROM (SELECT decile, sum(sale_value) AS revenue FROM matched WHERE converted GROUP BY decile)"""),
)
def cumulative_revenue(t):
    per = t.matched.filter("converted").groupBy("decile").agg(F.sum("sale_value").alias("revenue"))
    out = dec.cumulative_revenue(per)
    return out.withColumns({"revenue": F.round("revenue", 2), "cumulative_revenue": F.round("cumulative_revenue", 2), "cumulative_pct": F.round("cumulative_pct", 6)})


@query(
    "score_summary",
    sql("SELECT decile, count(*) AS leads, round(avg(lead_score), 9) AS mean_score, min(lead_score) AS min_score, max(lead_score) AS max_score FROM scored GROUP BY decile"),
)
def score_summary(t):
    return dec.score_summary(t.scored).withColumn("mean_score", F.round("mean_score", 9))


@query("top_leads", sql("SELECT lead_id, lead_score, decile FROM scored ORDER BY lead_score DESC, lead_id LIMIT 100"))
def top_leads(t):
    from ..sources.sinks import top_leads as top

    return top(t.scored, 100).select("lead_id", "lead_score", "decile")
