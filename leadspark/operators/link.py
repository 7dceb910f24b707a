"""Linking leads to sales: training targets and first-sale attribution.

Leads carry ``lead_id, email, phone, captured_at``; sales carry ``email, phone,
sale_value, sale_date, sale_origin, product`` (keys already normalised). E-mail OR phone
is always two equi joins, never an OR condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.contact import phone_variants
from ..session import stored
from .asof import next_value
from .joins import first_per_key, flag_members, left_lookup, nulls_last


def _as_target(df: DataFrame, *flags: str) -> DataFrame:
    hit = F.lit(False)
    for flag in flags:
        hit = hit | F.col(flag)
    return df.withColumn("target", hit.cast("int"))


def target_by_email(leads: DataFrame, sales: DataFrame) -> DataFrame:
    return _as_target(flag_members(leads, sales, "email", "_e"), "_e").drop("_e")


KEYS = {"email": "e:", "phone": "p:"}


def _tagged(key: str) -> Column:
    return F.concat(F.lit(KEYS[key]), F.col(key))


def _by_key(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows unfolded to one per known contact key ``k``, so that both keys share one scan
    and one shuffle; look-ups by e-mail and by phone then reuse the same table."""
    keys = F.explode(F.array_compact(F.array(*[_tagged(k) for k in KEYS])))
    return df.select(keys.alias("k"), *columns)


def _look_up(df: DataFrame, table: DataFrame, value: str, to: dict[str, str]) -> DataFrame:
    """``table(k, value)`` looked up by each contact key of ``to``, under its new name."""
    out = df
    for key, name in to.items():
        named = table.select("k", F.col(value).alias(name))
        out = left_lookup(out.withColumn("_k", _tagged(key)), named, "_k", "k").drop("_k")
    return out


def _flag_buyers(df: DataFrame, sales: DataFrame) -> DataFrame:
    """Flags ``_e`` and ``_p``: whether the e-mail, the phone is that of a buyer."""
    buyers = _by_key(sales).distinct().withColumn("_hit", F.lit(True))
    return _look_up(df, buyers, "_hit", {"email": "_e", "phone": "_p"}).fillna(False, ["_e", "_p"])


def target_by_email_or_phone(
    leads: DataFrame, sales: DataFrame, min_digits: int | None = DEFAULTS.min_phone_digits
) -> DataFrame:
    """E-mail, else phone; phones shorter than ``min_digits`` do not count (``None``: all do)."""
    if min_digits is not None:
        sales = sales.withColumn("phone", F.when(F.length("phone") >= min_digits, F.col("phone")))
    return _as_target(_flag_buyers(leads, sales), "_e", "_p").drop("_e", "_p")


def target_by_variants(
    leads: DataFrame, sales: DataFrame, phone_col: str = "phone_raw", id_col: str = "lead_id"
) -> DataFrame:
    """E-mail, or any spelling of the phone in common."""
    wanted = (
        sales.select(F.explode(phone_variants(F.col(phone_col))).alias("variant")).distinct()
    )
    offered = leads.select(id_col, F.explode(phone_variants(F.col(phone_col))).alias("variant"))
    hits = offered.join(wanted, "variant", "left_semi").select(id_col)
    flagged = flag_members(flag_members(leads, sales, "email", "_e"), hits, id_col, "_p")
    return _as_target(flagged, "_e", "_p").drop("_e", "_p")


def target_validated(
    leads: DataFrame, sales: DataFrame, students: DataFrame, products: DataFrame
) -> DataFrame:
    """E-mail target plus leads confirmed by a student list and a listed product.

    The confirmed ones are buyers already, so ``confirmed`` never adds a target; it is
    kept because callers report it.
    """
    listed = sales.join(products.select("product").distinct(), "product", "left_semi")
    df = flag_members(leads, sales, "email", "primary")
    df = flag_members(df, students, "email", "_student")
    df = flag_members(df, listed, "email", "_listed")
    confirmed = ~F.col("primary") & F.col("_student") & F.col("_listed")
    df = df.withColumn("confirmed", confirmed).drop("_student", "_listed")
    return _as_target(df, "primary", "confirmed")


def retarget(targeted: DataFrame, sales: DataFrame, products: DataFrame) -> DataFrame:
    """Keep ``target = 1`` only for buyers of a listed product; ``by`` tells how they matched."""
    listed = sales.join(products.select("product").distinct(), "product", "left_semi")
    df = _flag_buyers(targeted, listed)
    was = F.col("target") == 1
    by = (
        F.when(was & F.col("_e") & F.col("_p"), "both")
        .when(was & F.col("_e"), "email")
        .when(was & F.col("_p"), "phone")
    )
    return df.withColumn("by", by).withColumn("target", F.col("by").isNotNull().cast("int")).drop("_e", "_p")


def retarget_counts(retargeted: DataFrame) -> DataFrame:
    return retargeted.filter("target = 1").groupBy("by").count()


def discarded_products(targeted: DataFrame, sales: DataFrame, products: DataFrame, id_col: str = "lead_id") -> DataFrame:
    """Products bought by the leads that :func:`retarget` discards, one count per person."""
    kept = retarget(targeted, sales, products)
    lost = targeted.filter("target = 1").join(kept.filter("target = 1"), id_col, "left_anti")
    bought = _by_key(sales.filter("product IS NOT NULL"), "product").distinct()
    pairs = _by_key(lost, id_col).join(bought, "k").select(id_col, "product").distinct()
    return pairs.groupBy("product").agg(F.count("*").alias("leads"))


def within_conversion_window(
    targeted: DataFrame, sales: DataFrame, days: int = DEFAULTS.conversion_window_days
) -> DataFrame:
    """Drop leads too recent to have converted, unless they did."""
    last = sales.agg((F.max("sale_date") - F.expr(f"INTERVAL {days} DAYS")).alias("_limit"))
    df = targeted.crossJoin(F.broadcast(last))  # one row
    return df.filter((F.col("captured_at") <= F.col("_limit")) | (F.col("target") == 1)).drop("_limit")


_SALE = ["sale_date", "sale_value", "sale_origin"]


def _first_sales(sales: DataFrame) -> DataFrame:
    """``(k, sale)``: the first sale of every contact key by date, value, origin."""
    sale = F.struct(*_SALE)
    order = F.struct(*nulls_last(F.col("sale_date")), F.col("sale_value"), F.col("sale_origin"))
    return _by_key(sales, *_SALE).groupBy("k").agg(F.min_by(sale, order).alias("sale"))


def _first_sales_after(leads: DataFrame, sales: DataFrame) -> DataFrame:
    """``(k, captured_at, sale)``: the first sale at or after each capture of a contact key."""
    sold = _by_key(sales.filter("sale_date IS NOT NULL"), F.col("sale_date").cast("timestamp_ntz").alias("ts"), F.struct(*_SALE).alias("value"))
    seen = _by_key(leads, F.col("captured_at").alias("ts"))
    return next_value(sold, seen).select("k", F.col("ts").alias("captured_at"), F.col("value").alias("sale"))


def attribute_sales(leads: DataFrame, sales: DataFrame, temporal: bool = False) -> DataFrame:
    """First sale per lead by e-mail, else by phone.

    With ``temporal`` the sale must not precede the capture. Leads without a capture time
    never match. Adds ``converted, sale_value, sale_date, sale_origin, match_method``.
    """
    found = {"email": "_by_email", "phone": "_by_phone"}
    if temporal:
        at = F.col("captured_at").cast("string")
        moment = lambda k: F.when(k.isNotNull() & at.isNotNull(), F.concat_ws("\u0001", k, at))
        # one table answers for e-mails and phones
        table = stored(_first_sales_after(leads, sales).select(moment(F.col("k")).alias("k"), "sale"), "first-sales")
        df = leads
        for key, name in found.items():
            named = table.select("k", F.col("sale").alias(name))
            df = left_lookup(df.withColumn("_k", moment(_tagged(key))), named, "_k", "k").drop("_k")
    else:
        df = _look_up(leads, _first_sales(sales), "sale", found)
    dated = F.col("captured_at").isNotNull()
    by_email = dated & F.col("_by_email").isNotNull()
    by_phone = dated & F.col("_by_phone").isNotNull()
    sale = F.when(by_email, F.col("_by_email")).when(by_phone, F.col("_by_phone"))
    method = F.when(by_email, "email").when(by_phone, "telefone")
    return (
        df.withColumn("_sale", sale).withColumn("match_method", method)
        .withColumn("converted", F.col("match_method").isNotNull())
        .withColumn("sale_value", F.coalesce(F.col("_sale.sale_value"), F.lit(0.0)))
        .withColumn("sale_date", F.col("_sale.sale_date"))
        .withColumn("sale_origin", F.col("_sale.sale_origin"))
        .drop("_sale", "_by_email", "_by_phone")
    )


def drop_outside_conversions(matched: DataFrame, start: str, end: str) -> DataFrame:
    """Remove conversions captured outside the closed period; keep all other leads."""
    from ..functions.dates import in_closed_days

    return matched.filter(~F.col("converted") | in_closed_days(F.col("captured_at"), start, end))


def dedupe_conversions(matched: DataFrame, id_col: str = "lead_id") -> DataFrame:
    """One conversion per (person, sale date, sale value): the earliest capture.

    A person without e-mail is known by phone, so strangers do not merge.
    """
    person = F.coalesce(F.col("email"), F.col("phone"))
    sold = matched.filter("converted").withColumn("_person", person)
    order = [F.col("captured_at"), F.col(id_col)]
    kept = first_per_key(sold, ["_person", "sale_date", "sale_value"], order).drop("_person")
    return kept.unionByName(matched.filter(~F.col("converted")))


def tracked_buyers(matched: DataFrame, sales: DataFrame, columns: tuple[str, ...] = ("campaign",), id_col: str = "lead_id") -> DataFrame:
    """Every buyer with the campaign of a converted lead, if any: by e-mail, then phone.

    One row per buyer e-mail (buyers without one stay one by one), tracked rows first.
    """
    sold = _by_key(matched.filter("converted"), "captured_at", id_col, F.struct(*columns).alias("info"))
    first = sold.groupBy("k").agg(F.min_by("info", F.struct("captured_at", id_col)).alias("info"))
    out = _look_up(sales, first, "info", {"email": "_by_email", "phone": "_by_phone"})
    info = F.coalesce("_by_email", "_by_phone")
    out = (
        out.withColumn("_info", info).withColumn("tracked", F.col("_info").isNotNull())
        .select(*sales.columns, *[F.col(f"_info.{c}").alias(c) for c in columns], "tracked")
    )
    named = first_per_key(
        out.filter(F.col("email").isNotNull()), ["email"],
        [~F.col("tracked"), *nulls_last(F.col("sale_date")), F.col("sale_value"), F.col("sale_origin")],
    )
    return named.unionByName(out.filter(F.col("email").isNull()))


def matching_stats(matched: DataFrame, total_sales: DataFrame | None = None) -> DataFrame:
    """One row of matching counts and rates; ``total_sales`` is the frame of all sales."""
    ok = F.col("converted")
    stats = matched.agg(
        F.count("*").alias("total_leads"),
        F.count_if(ok).alias("total_conversions"),
        F.count_if(ok & (F.col("match_method") == "email")).alias("matched_by_email"),
        F.count_if(ok & (F.col("match_method") == "telefone")).alias("matched_by_phone"),
        F.coalesce(F.sum(F.when(ok, F.col("sale_value"))), F.lit(0.0)).alias("total_revenue"),
        F.count_if(ok & (F.col("sale_origin") == "guru")).alias("conversions_guru"),
        F.count_if(ok & (F.col("sale_origin") == "tmb")).alias("conversions_tmb"),
    )
    if total_sales is None:
        stats = stats.withColumn("total_sales", F.col("total_conversions"))
    else:
        stats = stats.crossJoin(total_sales.agg(F.count("*").alias("total_sales")))  # one row each
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0)), 2)
    return (
        stats.withColumn("tracking_rate", F.when(F.col("total_sales") == 0, 100.0).otherwise(rate("total_conversions", "total_sales")))
        .withColumn("conversion_rate", rate("total_conversions", "total_leads"))
        .withColumn("match_rate_email", rate("matched_by_email", "total_conversions"))
        .withColumn("match_rate_phone", rate("matched_by_phone", "total_conversions"))
        .withColumn("avg_ticket", F.round(F.coalesce(F.try_divide("total_revenue", "total_conversions"), F.lit(0.0)), 2))
        .withColumn("total_revenue", F.round("total_revenue", 2))
    )


def product_coverage(sales: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """Sales counted per listed product, listed products never sold, and sold ones not listed."""
    counts = sales.groupBy("product").agg(F.count("*").alias("sales"))
    listed = products.select("product").distinct()
    return {
        "counted": counts.join(listed, "product", "left_semi"),
        "missing": listed.join(counts, "product", "left_anti"),
        "unlisted": counts.join(listed, "product", "left_anti"),
    }


def recall(targeted: DataFrame, sales: DataFrame, products: DataFrame, first_day: str) -> DataFrame:
    """Distinct listed-product sales since ``first_day`` against conversions, as one row."""
    wanted = sales.filter(F.col("sale_date") >= F.lit(first_day).cast("date")).join(
        products.select("product").distinct(), "product", "left_semi"
    )
    real = wanted.select("email", "sale_date", "sale_value").distinct().agg(F.count("*").alias("sales"))
    seen = targeted.agg(F.count_if(F.col("target") == 1).alias("conversions"))
    return (
        real.crossJoin(seen)  # one row each
        .withColumn("recall", F.coalesce(F.try_divide(F.col("conversions").cast("double"), "sales"), F.lit(0.0)))
        .withColumn("factor", F.coalesce(F.try_divide(F.col("sales").cast("double"), "conversions"), F.lit(1.0)))
    )
