"""Queries: encoding, model scores, conversion events, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import CORRECTED_RATES, DECILES
from ..operators import deciles as dec
from ..operators import encode as enc
from ..operators import events as ev
from ..operators import features as feat
from ..operators import link
from ..operators import model as ml
from ..operators import splits as sp
from ..operators import utm as names
from ..session import checkpoint_dir, stored
from ..sources import leads as src
from ..streaming import jobs
from .bindings import sql
from .profiling import _SPLIT
from .registry import query

_LANGS, _BITS = ("de", "en", "es", "fr"), ("0", "1")
_DUMMIES = ", ".join(
    [f"CAST(coalesce(lang = '{v}', false) AS INT) AS lang_{v}" for v in _LANGS]
    + [f"CAST(coalesce({c} = {v}, false) AS INT) AS {c}_{v}" for c in ("quality", "toxic") for v in _BITS]
)


@query("one_hot_encoded", sql(f"SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, {_DUMMIES} FROM survey"))
def one_hot_encoded(t):
    df = t.survey.select("doc_id", "lang", "n_chars", "quality", "toxic")
    fitted = enc.fit_encoder(t.survey.filter("split = 'train'").select("lang", "n_chars", "quality", "toxic"), numeric=("n_chars",))
    return fitted.transform(df, ("doc_id",))


@query(
    "derived_features",
    sql("""SELECT lead_id, isodow(captured_at) - 1 AS dia_semana, length(name) AS nome_comprimento, false AS nome_tem_sobrenome, true AS nome_valido,
  coalesce(regexp_matches(lower(trim(email_raw)), '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}$'), false) AS email_valido, phone IS NOT NULL AS telefone_valido,
  coalesce(length(phone), 4) AS telefone_comprimento FROM leads"""),
)
def derived_features(t):
    out = feat.derive_features(t.leads, "captured_at", "name", "email_raw", "phone_raw", keep_raw=True)
    return out.select("lead_id", "dia_semana", "nome_comprimento", *feat.FLAGS, "telefone_comprimento")


def _model_frames(t, target=None):
    """Encoded leads split by time, and the encoder fitted on the training part. ``target`` replaces conversion."""
    base = link.target_by_email_or_phone(names.with_class(t.leads), t.sales)
    if target is not None:
        base = base.withColumn("target", target)
    inputs = ("dia_semana", "nome_comprimento", *feat.FLAGS, "telefone_comprimento", "term", "medium", "ml_type")
    # the cut, the encoder and both parts read the linked leads: they are written once
    derived = feat.derive_features(base, "captured_at", "name", "email_raw", "phone_raw", keep_raw=True)
    split = sp.split_by_leads(stored(derived.select("lead_id", "captured_at", "target", *inputs), "model-leads"))
    shaped = names.unify_term(split)
    encoder = enc.fit_encoder(shaped.filter("split = 'train'").select(*inputs))
    encoded = encoder.transform(shaped, ("lead_id", "target", "split"))
    return encoder, encoded.filter("split = 'train'"), encoded.filter("split = 'test'")


def _forest_scores(t):
    """Scores and deciles of the later 30 % of leads by the full forest."""
    encoder, train, test = _model_frames(t)
    return ml.train_scorer(train, test, encoder, params={"numTrees": 300, "maxDepth": 8})[1]


@query(
    "rf_scores",
    sql("SELECT lead_id, CAST(target AS INTEGER) AS target, true AS score_valid, true AS decile_valid FROM target_leads JOIN halves USING (lead_id) WHERE split = 'test'", _SPLIT),
)
def rf_scores(t):
    """Leads of the later 30 % with their target, and whether score and decile are in range."""
    score, decile = F.col("lead_score").between(0, 1), F.col("decile").between(1, 10)
    return _forest_scores(t).select("lead_id", F.col("target").cast("int").alias("target"), score.alias("score_valid"), decile.alias("decile_valid"))


@query(
    "rf_metrics",
    sql("SELECT count(*) AS leads, CAST(sum(target) AS BIGINT) AS conversions, true AS auc_in_range, true AS shares_in_order FROM target_leads JOIN halves USING (lead_id) WHERE split = 'test'", _SPLIT),
)
def rf_metrics(t):
    """Ranking quality of the forest on the later 30 % of leads, as far as SQL can state it."""
    scored = _forest_scores(t)
    one = dec.ranking_metrics(scored)
    return one.crossJoin(scored.agg(F.count("*").alias("leads"))).select(  # one row each
        "leads", F.col("conversions").cast("long").alias("conversions"), F.col("auc").between(0.4, 1).alias("auc_in_range"),
        ((F.col("top3_share") <= F.col("top5_share")) & (F.col("top5_share") <= 100)).alias("shares_in_order"),
    )


# A target that the weekday of the capture decides but for noise by lead.
_WEEKDAY_TARGET = "CAST((lead_id * 7919) % 100 < 5 + 12 * {weekday} AS INT)"
_WEEKDAY = f"""w AS (SELECT isodow(captured_at) - 1 AS day, {_WEEKDAY_TARGET.format(weekday="(isodow(captured_at) - 1)")} AS target FROM halves WHERE split = 'test'),
per AS (SELECT day, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg FROM w GROUP BY day),
best AS (SELECT sum(a.pos * (coalesce((SELECT sum(b.neg) FROM per b WHERE b.day < a.day), 0) + a.neg / 2.0)) / (sum(a.pos) * sum(a.neg)) AS auc FROM per a)"""


@query(
    "grid_search",
    sql("""SELECT trees AS num_trees, depth AS max_depth, (SELECT count(*) FROM w) AS leads, (SELECT CAST(sum(target) AS BIGINT) FROM w) AS conversions,
  round(auc, 9) AS weekday_auc, auc > 0.6 AS learned FROM best, (VALUES (200), (300), (400)) a(trees), (VALUES (8), (10)) b(depth)""", f"{_SPLIT},\n{_WEEKDAY}"),
)
def grid_search(t):
    """The whole small grid on a target that the features explain: whether each forest ranks the later leads
    over 0.6 and within 0.1 of the weekday itself, which no score can beat by more than chance."""
    target = F.expr(_WEEKDAY_TARGET.format(weekday="weekday(captured_at)"))
    encoder, train, test = _model_frames(t, target)
    _, tried = ml.tune(train, test, encoder.contract, ml.GRIDS["small"], baseline={"numTrees": 300, "maxDepth": 8})
    later = _later_weekdays(t, target)
    best = dec.auc(later, "weekday", "target").select(F.round("auc", 9).alias("weekday_auc"))
    counts = later.agg(F.count("*").alias("leads"), F.sum("target").cast("long").alias("conversions"))
    rows = t.spark.createDataFrame([(p["numTrees"], p["maxDepth"], auc) for p, auc in tried], "num_trees int, max_depth int, auc double")
    one = counts.crossJoin(best)  # one row each
    learned = (F.col("auc") > 0.6) & (F.col("auc") > F.col("weekday_auc") - 0.1)
    return rows.crossJoin(F.broadcast(one)).withColumn("learned", learned).drop("auc")


def _later_weekdays(t, target):
    """Weekday and target of the later 30 % of leads."""
    split = sp.split_by_leads(t.leads).filter("split = 'test'")
    return split.select(F.expr("weekday(captured_at)").cast("double").alias("weekday"), target.alias("target"))


_EVENTS = """caps AS (SELECT email, arg_min(id, (NOT coalesce(first_name <> '', false), id)) AS id FROM captures WHERE email IS NOT NULL GROUP BY email),
c AS (SELECT captures.* FROM captures JOIN caps USING (id)),
enriched AS (SELECT s.email, s.phone, s.decile, s.lead_score, coalesce(c.event_id, 'lead_1706659200_' || substr(sha256(s.email), 1, 16)) AS event_id,
    s.name AS first_name, c.fbp, c.fbc FROM scored s LEFT JOIN c ON s.email = c.email WHERE s.email IS NOT NULL)"""
_RATES = " ".join(f"WHEN {k} THEN {r}::DOUBLE" for k, r in zip(DECILES, CORRECTED_RATES))


def _enriched(t):
    captures = src.best_captures(t.captures.filter("email IS NOT NULL"))
    return ev.enrich_with_captures(t.scored.filter("email IS NOT NULL"), captures, 1706659200)


@query(
    "conversion_events",
    sql(f"""SELECT event_name, prefix || event_id AS event_id, sha256(email) AS em, sha256(phone) AS ph, sha256(lower(first_name)) AS fn, fbp,
  CASE WHEN phone IS NOT NULL THEN sha256('br') END AS country, CASE event_name WHEN 'LeadQualified' THEN round(2000.0 * CASE decile {_RATES} END, 6) END AS value,
  'D' || lpad(CAST(decile AS VARCHAR), 2, '0') AS decil
FROM enriched, (VALUES ('LeadQualified', 'qualified_', 1), ('LeadQualifiedHighQuality', 'hq_', 9)) k(event_name, prefix, least_decile) WHERE decile >= least_decile""", _EVENTS),
)
def conversion_events(t):
    e, u = F.col("event"), F.col("event.user_data")
    out = ev.conversion_events(_enriched(t))
    return out.select(
        e["event_name"].alias("event_name"), e["event_id"].alias("event_id"), u["em"].alias("em"), u["ph"].alias("ph"), u["fn"].alias("fn"),
        u["fbp"].alias("fbp"), u["country"].alias("country"), F.round(e["custom_data"]["value"], 6).alias("value"),
        e["custom_data"]["custom_properties"]["decil"].alias("decil"),
    )


@query(
    "purchase_events",
    sql("""SELECT 'purchase_' || lead_id AS event_id, sha256(email) AS em, sale_value AS value FROM matched WHERE converted"""),
)
def purchase_events(t):
    buyers = t.matched.filter("converted").withColumn("event_id", F.col("lead_id").cast("string")).withColumn("event_time", F.lit(0))
    out = ev.purchase_events(buyers)
    return out.select(
        F.col("event.event_id").alias("event_id"), F.col("event.user_data.em").alias("em"), F.col("event.custom_data.value").alias("value")
    )


@query(
    "sent_counts",
    sql("""SELECT count(*) AS checked, count(*) FILTER (s) AS sent, count(*) FILTER (NOT s) AS not_sent FROM (
  SELECT email, bool_or(created_at < DATE '2024-01-10') AS s FROM captures WHERE email IS NOT NULL GROUP BY email)"""),
)
def sent_counts(t):
    known = t.captures.filter("email IS NOT NULL")
    return ev.sent_counts(known, known.filter("created_at < DATE '2024-01-10'"))


def _scratch(spark) -> str:
    """A new folder under the shared checkpoint folder (private only where none is set)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _capture_stream(t):
    """The events table read as a stream of captures."""
    schema = t.read("events").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    repeat = F.explode(F.array(F.lit(0), F.lit(1)))  # every capture arrives twice
    return raw.withColumn("again", repeat).select(
        F.concat(F.lit("ev"), "event_id").alias("event_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("user"), "user_id", F.lit("@mail.com")).alias("email"),
        F.when(F.col("event_type") == "error", "https://site/PARABENS").otherwise("https://site/").alias("event_source_url"),
    )


@query("stream_dedup", "SELECT concat('ev', event_id) AS event_id, concat('user', user_id, '@mail.com') AS email FROM events WHERE event_type <> 'error'")
def stream_dedup(t):
    folder = _scratch(t.spark)
    intake = jobs.capture_intake(_capture_stream(t))
    jobs.append_stream(intake, f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "email")


@query(
    "stream_send_once",
    """SELECT concat('user', user_id, '@mail.com') AS email, concat('ev', arg_min(event_id, (ts, concat('ev', event_id)))) AS event_id
FROM events GROUP BY user_id""",
)
def stream_send_once(t):
    folder = _scratch(t.spark)
    jobs.send_once(_capture_stream(t), f"{folder}/sent", f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("email", "event_id")


@query(
    "stream_weekly",
    """SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS leads, count(*) FILTER (value > 300) AS strong FROM events GROUP BY 1""",
)
def stream_weekly(t):
    folder = _scratch(t.spark)
    raw = t.spark.readStream.schema(t.read("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    timed = raw.withColumn("at", F.col("ts").cast("timestamp"))
    counts = jobs.weekly_counts(timed, "at", F.count_if(F.col("value") > 300).alias("strong"))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    # a batch has the weeks that it changed; the last one counts
    out = t.spark.read.parquet(f"{folder}/out").groupBy("week").agg(*(F.max_by(c, "batch_id").alias(c) for c in ("leads", "strong")))
    return out.select(F.col("week.start").cast("date").alias("week"), "leads", "strong")
