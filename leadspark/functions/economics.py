"""Unit economics of a campaign, adset or ad, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DECILES, DEFAULTS, Settings

ON_OFF = ("ad", "content")
BUDGETED = ("campaign", "adset", "medium", "term")


def cpl(spend: Column, leads: Column) -> Column:
    return F.when(leads == 0, F.lit(0.0)).otherwise(spend / leads)


def projected_rate(shares: list[Column], settings: Settings = DEFAULTS) -> Column:
    """Sum over deciles of share (0 to 1) times expected rate."""
    return reduce(lambda a, b: a + b, [s * F.lit(r) for s, r in zip(shares, settings.rates)])


def projected_roas(rate: Column, cost_per_lead: Column, settings: Settings = DEFAULTS) -> Column:
    value = F.lit(settings.product_value) * rate
    return F.when(cost_per_lead == 0, F.lit(0.0)).otherwise(value / cost_per_lead)


def projected_revenue(rate: Column, leads: Column, settings: Settings = DEFAULTS) -> Column:
    return leads * rate * F.lit(settings.product_value)


def confidence(leads: Column, days: Column, settings: Settings = DEFAULTS) -> Column:
    distance = leads / days - F.lit(settings.sigmoid_midpoint)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-settings.sigmoid_slope) * distance))


def roas_multiplier(roas: Column, settings: Settings = DEFAULTS) -> Column:
    low, high = settings.min_roas, settings.target_roas
    rising = F.lit(0.5) + F.lit(0.5) * (roas - F.lit(low)) / F.lit(high - low)
    return F.when(roas < low, F.lit(0.0)).when(roas >= high, F.lit(1.0)).otherwise(rising)


def confidence_level(leads: Column, days: Column, settings: Settings = DEFAULTS) -> Column:
    few, low, mid = settings.level_per_day
    return (
        F.when(leads < days * few, "insuficiente")
        .when(leads < days * low, "baixa")
        .when(leads < days * mid, "media")
        .otherwise("alta")
    )


def budget_variation(
    margin: Column, spend: Column, roas: Column, leads: Column, days: Column,
    settings: Settings = DEFAULTS,
) -> Column:
    """Recommended budget change in percent, one decimal, from -100 to +100."""
    percent = F.try_divide(margin, spend) * F.lit(100.0)
    sure = confidence(leads, days, settings)
    up = F.least(percent, F.lit(settings.max_variation)) * sure * roas_multiplier(roas, settings)
    down = F.greatest(percent * sure, F.lit(-100.0))
    return F.when(spend == 0, F.lit(0.0)).otherwise(F.round(F.when(margin > 0, up).otherwise(down), 1))


def _percent_text(value: Column) -> Column:
    return F.concat(F.abs(value).cast("decimal(10,1)").cast("string"), F.lit("%"))


def action(
    dimension: str, has_budget: Column, leads: Column, days: Column, spend: Column,
    margin: Column, roas: Column, settings: Settings = DEFAULTS,
) -> Column:
    """Recommended action text for one row of ``dimension``."""
    on_off = dimension in ON_OFF
    costly = spend > settings.spend_without_leads
    needed = days * settings.min_leads_per_day
    missing = needed - leads
    wait = F.when(missing == 1, "Aguardar dados (falta 1 lead)").otherwise(
        F.concat(F.lit("Aguardar dados (faltam "), missing.cast("string"), F.lit(" leads)"))
    )
    if dimension == "campaign":
        uncontrolled = F.lit("ABO")
    elif dimension == "medium":
        weak = (margin < 0) | (roas < settings.min_roas)
        uncontrolled = F.when(weak, "CBO - Pausar / Alterar").otherwise("CBO - Manter")
    else:
        uncontrolled = F.lit("N/A")
    if on_off:
        controlled = F.when(margin >= 0, "Manter").otherwise("Remover")
    else:
        change = budget_variation(margin, spend, roas, leads, days, settings)
        idle = "Manter (ROAS baixo)" if dimension in BUDGETED else "Manter"
        controlled = (
            F.when(change > 0, F.concat(F.lit("Aumentar "), _percent_text(change)))
            .when(change < 0, F.concat(F.lit("Reduzir "), _percent_text(change)))
            .otherwise(idle)
        )
    return (
        F.when((leads == 0) & costly, "Remover" if on_off else "Reduzir 100%")
        .when(
            (leads < needed) & costly & (roas < 1.0),
            "Remover (ROAS < 1.0)" if on_off else "Reduzir 100%",
        )
        .when(leads < needed, wait)
        .when(~has_budget, uncontrolled)
        .otherwise(controlled)
    )


def target_budget(
    dimension: str, action_text: Column, margin: Column, spend: Column, roas: Column,
    leads: Column, days: Column, settings: Settings = DEFAULTS,
) -> Column:
    """Budget after the action, from the numeric variation (never parsed from the text)."""
    change = budget_variation(margin, spend, roas, leads, days, settings)
    moved = action_text.startswith("Aumentar") | action_text.startswith("Reduzir")
    return (
        F.when(action_text.isin("Remover", "Reduzir 100%"), F.lit(0.0))
        .when(moved, spend * (F.lit(1.0) + change / F.lit(100.0)))
        .otherwise(spend)
    )


def adjusted_value(value: Column, origin: Column, settings: Settings = DEFAULTS) -> Column:
    """Sale value with the instalment vendor's realisation factor applied."""
    instalment = F.lower(origin) == settings.instalment_origin
    return F.when(instalment, value * F.lit(settings.instalment_factor)).otherwise(value)


def rate_of(decile: Column, rates: tuple[float, ...]) -> Column:
    """Expected rate of an integer decile, 0 when it has none."""
    out = F.lit(0.0)
    for k, r in reversed(list(zip(DECILES, rates))):
        out = F.when(decile == k, F.lit(r)).otherwise(out)
    return out
