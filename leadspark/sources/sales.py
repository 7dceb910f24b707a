"""Sales of both vendors under common names, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contact import email_key, phone_key
from ..functions.dates import parse_timestamp
from ..functions.text import decimal_comma, strip
from ..operators.joins import first_per_key, nulls_last
from ..schemas import SALES, conform


# Columns that decide between sales of one vendor, e-mail, date and value.
TIES = ("product", "name", "phone", "utm_campaign", "sale_id")


def _first(df: DataFrame, *names: str) -> Column:
    """The first of the columns that exists, as text."""
    name = next((n for n in names if n in df.columns), None)
    return F.lit(None).cast("string") if name is None else F.col(f"`{name}`").cast("string")


def _number(c: Column) -> Column:
    """``1.234,50``, ``1234,5`` or ``1234.5``."""
    text = strip(c)
    brazilian = F.when(text.contains(","), F.regexp_replace(text, r"\.", "")).otherwise(text)
    return decimal_comma(brazilian)


def _conformed(df: DataFrame, origin: str, email: Column, name: Column, phone: Column, value: Column, date: Column, product: Column) -> DataFrame:
    out = df.select(
        email_key(email).alias("email"), name.alias("name"), phone_key(phone).alias("phone"),
        _number(value).alias("sale_value"), date.alias("sale_date"), _first(df, "utm_campaign").alias("utm_campaign"),
        product.alias("product"), F.lit(origin).alias("sale_origin"),
    )
    return conform(out, SALES).filter("email IS NOT NULL AND sale_date IS NOT NULL")


def vendor_a_sales(raw: DataFrame) -> DataFrame:
    """Approved sales; date of approval, else of order."""
    df = raw.filter("status = 'Aprovada'") if "status" in raw.columns else raw
    date = F.coalesce(parse_timestamp(_first(df, "data aprovacao")), parse_timestamp(_first(df, "data pedido")))
    return _conformed(
        df, "guru", _first(df, "email contato"), _first(df, "nome contato"), _first(df, "telefone contato"),
        _first(df, "valor venda", "valor produtos"), date, _first(df, "nome produto"),
    )


def vendor_b_sales(raw: DataFrame) -> DataFrame:
    """Effective sales; date they took effect, else of creation."""
    df = raw.filter("Status = 'Efetivado'") if "Status" in raw.columns else raw
    date = F.coalesce(parse_timestamp(_first(df, "Data Efetivado")), parse_timestamp(_first(df, "Criado Em")))
    return _conformed(
        df, "tmb", _first(df, "Cliente Email", "Cliente E-mail"), _first(df, "Cliente Nome"),
        _first(df, "Telefone", "Cliente Telefone"), _first(df, "Ticket (R$)", "Ticket"), date, _first(df, "Produto"),
    )


def combine_sales(*vendors: DataFrame) -> DataFrame:
    """Union with one sale per (e-mail, date): vendor A first, then the larger value.

    A sale without a readable value comes after those with one; ties go by the columns ``TIES``.
    """
    from ..sources.tables import union_all

    df = union_all(list(vendors))
    order = [F.col("sale_origin") != "guru", *nulls_last(-F.col("sale_value")), *(x for c in TIES if c in df.columns for x in nulls_last(F.col(c)))]
    return first_per_key(df, ["email", "sale_date"], order)
