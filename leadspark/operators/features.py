"""Derived lead features and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contact import email_is_valid, name_is_valid, phone_key
from ..functions.dates import parse_timestamp
from ..functions.text import strip
from .profile import flag_rates

FLAGS = ("nome_tem_sobrenome", "nome_valido", "email_valido", "telefone_valido")
RAW = ("aba_origem", "arquivo_origem")


def derive_features(
    df: DataFrame, time: str = "Data", name: str = "Nome Completo", email: str = "E-mail",
    phone: str = "Telefone", legacy_null_lengths: bool = True, keep_raw: bool = False,
) -> DataFrame:
    """Weekday (Monday 0), name and phone lengths, validity flags; raw columns are dropped.

    With ``legacy_null_lengths`` a missing name has length 3 and a missing phone length 4,
    the lengths of the words once written for them, which the feature names rely on.
    """
    c = lambda n: F.col(f"`{n}`")
    out = {}
    if time in df.columns:
        stamp = c(time) if dict(df.dtypes)[time] in ("timestamp", "timestamp_ntz", "date") else parse_timestamp(c(time))
        out["dia_semana"] = F.weekday(stamp)
    if name in df.columns:
        size = F.length(c(name))
        words = F.size(F.split(strip(c(name)), r"(?U)\s+"))
        out["nome_comprimento"] = F.coalesce(size, F.lit(3)) if legacy_null_lengths else size
        out["nome_tem_sobrenome"] = F.coalesce((strip(c(name)) != "") & (words >= 2), F.lit(False))
        out["nome_valido"] = name_is_valid(c(name))
    if email in df.columns:
        out["email_valido"] = email_is_valid(c(email))
    if phone in df.columns:
        size = F.length(phone_key(c(phone)))
        out["telefone_valido"] = phone_key(c(phone)).isNotNull()
        out["telefone_comprimento"] = F.coalesce(size, F.lit(4)) if legacy_null_lengths else size
    wide = df.withColumns(out)
    if keep_raw:
        return wide
    gone = {*RAW, time, name, email, phone}
    return wide.select(*[c(n) for n in wide.columns if n not in gone])


def feature_summary(df: DataFrame) -> DataFrame:
    """Count and percent of true values of each derived flag."""
    return flag_rates(df, [f for f in FLAGS if f in df.columns])
