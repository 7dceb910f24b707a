"""Query registry: a Spark callable and, where SQL can say it, the equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .bindings import Tables

# Columns that SQL would return in another number type than Spark does.
_COUNTS = "BIGINT"
RESULT_TYPES = {
    "contacts_normalized": {"phone_digits": "INTEGER"},
    "class_counts": {"excluded": _COUNTS},
    "report_hierarchy": {"budget": "DOUBLE"},
    "utm_economics_keywords": {"spend": "DOUBLE", "budget_current": "DOUBLE"},
    "threshold_stability": {"leads": _COUNTS},
    "decile_lift": {"conversions": _COUNTS},
    "ranking_metrics": {"conversions": _COUNTS},
    "campaign_metrics": {"budget": "DOUBLE"},
    "ml_vs_control": {"treated_conversions": _COUNTS, "control_conversions": _COUNTS},
    "overall_stats": {"excluded_leads": _COUNTS},
    "decile_performance": {"revenue_guru": "DOUBLE", "revenue_total": "DOUBLE"},
    "adset_comparison": {"conversions": _COUNTS},
    "all_adsets_comparison": {"conversions": _COUNTS},
    "ad_comparison": {"leads": _COUNTS, "conversions": _COUNTS},
    "ad_comparison_matched": {"leads": _COUNTS, "conversions": _COUNTS},
    "budget_metadata": {"budget": "DOUBLE"},
    "category_shares": {"rank": "INTEGER"},
    "utm_fill": {"utm_campaign_pct": "DOUBLE", "utm_medium_pct": "DOUBLE"},
    "component_sizes": {"leads": _COUNTS},
    "derived_features": {"dia_semana": "INTEGER", "nome_comprimento": "INTEGER", "telefone_comprimento": "INTEGER"},
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL twin."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in RESULT_TYPES.get(name, {}).items())
            ORACLE[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return fn

    return add
