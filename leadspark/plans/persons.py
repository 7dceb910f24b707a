"""Queries: persons linked through chains of contacts, and splits that keep them whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as comp
from ..operators import splits as sp
from .bindings import sql
from .registry import query

# Phones pass between neighbours, so that up to twelve e-mails hang together by chains of phones.
_CHAINS = """linked AS (SELECT event_id AS lead_id, CASE WHEN event_id % 31 <> 0 THEN 'user' || user_id || '@mail.com' END AS email,
    CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 5 = 0 AND user_id % 12 <> 11 THEN 'n' || ((user_id + 1) // 2) ELSE 'n' || (user_id // 2) END AS phone,
    CAST(value > 30 AS INT) AS target FROM events),
keys AS (SELECT lead_id, 'e:' || email AS e, 'p:' || phone AS p FROM linked),
edges AS (SELECT DISTINCT e AS a, p AS b FROM keys WHERE e IS NOT NULL AND p IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
labels AS (SELECT node, min(other) AS label FROM reach GROUP BY node),
persons AS (SELECT k.lead_id, l.target, coalesce(x.label, y.label, k.e, k.p, 'i:' || k.lead_id) AS person
    FROM keys k JOIN linked l USING (lead_id) LEFT JOIN labels x ON x.node = k.e LEFT JOIN labels y ON y.node = k.p)"""


def _linked(t):
    e = t.read("events")
    i, u = F.col("event_id"), F.col("user_id")
    own, next_one = F.floor(u / 2).cast("string"), F.floor((u + 1) / 2).cast("string")
    phone = F.when(i % 29 == 0, None).when((i % 5 == 0) & (u % 12 != 11), F.concat(F.lit("n"), next_one)).otherwise(F.concat(F.lit("n"), own))
    return e.select(i.alias("lead_id"), F.when(i % 31 != 0, F.concat(F.lit("user"), u, F.lit("@mail.com"))).alias("email"), phone.alias("phone"), (F.col("value") > 30).cast("int").alias("target"))


@query("person_chains", f"WITH RECURSIVE {_CHAINS} SELECT lead_id, min(lead_id) OVER (PARTITION BY person) AS first_lead FROM persons")
def person_chains(t):
    """Components whose contacts hang together by long chains."""
    labelled = comp.person_components(_linked(t))
    first = labelled.groupBy("person").agg(F.min("lead_id").alias("first_lead"))
    return labelled.join(first, "person").select("lead_id", "first_lead")


@query(
    "person_split",
    f"""WITH RECURSIVE {_CHAINS}, weighed AS (SELECT person, max(target) AS y, count(*) AS n, ('0x' || substr(md5('42:' || person), 1, 15))::BIGINT AS h FROM persons GROUP BY person),
placed AS (SELECT person, sum(n) OVER (PARTITION BY y ORDER BY h) <= 0.7::DOUBLE * sum(n) OVER (PARTITION BY y) AS train FROM weighed)
SELECT lead_id, CASE WHEN train THEN 'train' ELSE 'test' END AS split FROM persons JOIN placed USING (person)""",
)
def person_split(t):
    """Whole persons on one side, seven tenths of each stratum's leads in training."""
    return sp.split_by_person(_linked(t)).select("lead_id", "split")


@query(
    "person_split_report",
    f"""WITH RECURSIVE {_CHAINS}, weighed AS (SELECT person, max(target) AS y, count(*) AS n, ('0x' || substr(md5('42:' || person), 1, 15))::BIGINT AS h FROM persons GROUP BY person),
placed AS (SELECT person, sum(n) OVER (PARTITION BY y ORDER BY h) <= 0.7::DOUBLE * sum(n) OVER (PARTITION BY y) AS train FROM weighed)
SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS split, count(*) AS "rows", CAST(sum(target) AS BIGINT) AS positives, avg(target) AS positive_rate
FROM persons JOIN placed USING (person) GROUP BY 1""",
)
def person_split_report(t):
    return sp.split_report(sp.split_by_person(_linked(t)))
