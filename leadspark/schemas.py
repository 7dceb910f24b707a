"""Declared schemas and the step that conforms a frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(),
    "time": T.TimestampNTZType(), "date": T.DateType(), "boolean": T.BooleanType(),
}


def table(**kinds: str) -> T.StructType:
    """Struct type from space-separated column names per kind."""
    return T.StructType([T.StructField(n, _KINDS[k]) for k, names in kinds.items() for n in names.split()])


LEADS = table(
    string="lead_id email name phone campaign source medium term content",
    time="captured_at", double="lead_score", int="decile",
)
SALES = table(
    string="email name phone utm_campaign product sale_origin", double="sale_value", time="sale_date",
)
CAPTURES = table(
    long="id",
    string="email name first_name last_name phone fbp fbc event_id user_agent client_ip event_source_url "
           "utm_source utm_medium utm_campaign utm_term utm_content tem_comp",
    time="capi_sent_at created_at updated_at",
)
REPORT_ROWS = table(
    string="campaign_id campaign_name adset_id adset_name ad_id ad_name budget_type "
           "optimization_goal_indicator _account_name _source_file",
    double="spend results budget leads_standard lead_qualified lead_qualified_hq faixa_a",
    date="report_start report_end", boolean="_is_edge_case",
)
COST_ROWS = table(
    string="campaign_id campaign_name adset_id adset_name ad_id ad_name optimization_goal",
    double="spend daily_budget lifetime_budget", boolean="has_campaign_budget", date="day",
)
INSIGHTS = T.StructType([
    *table(
        string="campaign_id campaign_name adset_id adset_name ad_id ad_name spend daily_budget "
               "lifetime_budget optimization_goal",
        date="date_start date_stop",
    ).fields,
    T.StructField("actions", T.ArrayType(table(string="action_type value"))),
    T.StructField("promoted_object", table(string="custom_event_str")),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: unknown ones go, missing ones are null, unreadable
    values become null."""
    have = set(df.columns)

    def one(f: T.StructField):
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        return F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in schema.fields])
