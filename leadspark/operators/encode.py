"""Categorical encoding with a contract fixed at fit time."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import feature_name
from .columns import schema_difference
from .profile import value_counts

# Ordered answers; the code is the position.
ORDINALS = {
    "Qual a sua idade?": (
        "Menos de 18 anos", "18 - 24 anos", "25 - 34 anos", "35 - 44 anos", "45 - 54 anos", "Mais de 55 anos",
    ),
    "Atualmente, qual a sua faixa salarial?": (
        "Não tenho renda", "Entre R$1.000 a R$2.000 reais ao mês", "Entre R$2.001 a R$3.000 reais ao mês",
        "Entre R$3.001 a R$5.000 reais ao mês", "Mais de R$5.001 reais ao mês",
    ),
}
NUMERIC = ("dia_semana", "nome_comprimento")
REFERENCE_DUMMIES = ("telefone_comprimento_8",)
# Feature names written differently in the contract.
SPECIAL_NAMES = {
    "O_que_voc_faz_atualmente_Sou_autonomo": "O_que_voc_faz_atualmente_Sou_aut_nomo",
    "Tem_computador_notebook_SIM": "Tem_computador_notebook_Sim",
    "Medium_outros": "Medium_Outros",
}


@dataclass
class Encoder:
    """Which columns stay, which become dummies of which values, and the feature order."""

    ordinals: dict[str, list[str]] = field(default_factory=dict)
    numeric: list[str] = field(default_factory=list)
    dummies: list[tuple[str, str, str]] = field(default_factory=list)  # column, value, feature
    contract: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame, keep: tuple[str, ...] = (), fill: bool = True) -> DataFrame:
        """Features in contract order; a category unseen at fit time sets no dummy."""
        have = set(df.columns)
        cols = {}
        for name, order in self.ordinals.items():
            if name in have:
                codes = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
                cols[feature_name(name)] = F.try_element_at(codes, F.col(f"`{name}`"))
        for name in self.numeric:
            if name in have:
                cols[feature_name(name)] = F.col(f"`{name}`").cast("double")
        for name, value, feature in self.dummies:
            if name in have:
                hit = F.coalesce(F.col(f"`{name}`").cast("string") == value, F.lit(False)).cast("int")
                # two values may clean to one feature; the feature is then set by either
                cols[feature] = F.greatest(cols[feature], hit) if feature in cols else hit
        wide = df.select(*[F.col(f"`{k}`") for k in keep], *[c.alias(n) for n, c in cols.items()])
        return align_features(wide, self.contract, keep, fill)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Encoder:
        raw = json.loads(text)
        raw["dummies"] = [tuple(d) for d in raw["dummies"]]
        return Encoder(**raw)


def fit_encoder(
    df: DataFrame, exclude: tuple[str, ...] = ("target",), production_names: bool = True,
    ordinals: dict = ORDINALS, numeric: tuple[str, ...] = NUMERIC, numeric_categories: int = 20,
) -> Encoder:
    """Learn categories: text and boolean columns, and numbers of at most ``numeric_categories`` values.

    Distinct values are counted per column first, so only the columns that become dummies
    send their (few) values to the driver.
    """
    types = {c: k for c, k in df.dtypes if c not in exclude}
    free = [c for c in types if c not in ordinals and c not in numeric]
    encoder = Encoder(
        {c: list(ordinals[c]) for c in types if c in ordinals}, [c for c in types if c in numeric]
    )
    if free:
        pairs = value_counts(df, free).filter("value IS NOT NULL").select("column", "value")
        sizes = {r["column"]: r["n"] for r in pairs.groupBy("column").agg(F.count("*").alias("n")).collect()}
        chosen = [c for c in free if types[c] in ("string", "boolean") or sizes.get(c, 0) <= numeric_categories]
        encoder.numeric += [c for c in free if c not in chosen]
        values: dict[str, list[str]] = {c: [] for c in chosen}
        for r in pairs.filter(F.col("column").isin(chosen)).collect():
            values[r["column"]].append(r["value"])
        for c in chosen:
            for v in sorted(values[c], key=lambda v: _order(types[c], v)):
                shown = v.capitalize() if types[c] == "boolean" else v
                feature = f"{c}_{shown}"
                if feature in REFERENCE_DUMMIES:
                    continue
                cleaned = feature_name(feature)
                encoder.dummies.append((c, v, SPECIAL_NAMES.get(cleaned, cleaned) if production_names else cleaned))
    names = [feature_name(c) for c in [*encoder.ordinals, *encoder.numeric]] + [d[2] for d in encoder.dummies]
    encoder.contract = list(dict.fromkeys(names))
    return encoder


def _order(kind: str, value: str):
    try:
        return (0, float(value), "") if kind not in ("string", "boolean") else (1, 0.0, value)
    except ValueError:
        return (1, 0.0, value)


def align_features(df: DataFrame, contract: list[str], keep: tuple[str, ...] = (), fill: bool = True) -> DataFrame:
    """Contract columns in order: missing ones are 0, extra ones go, nulls become 0."""
    have = set(df.columns)

    def one(name: str):
        if name not in have:
            return F.lit(0).alias(name)
        return (F.coalesce(F.col(name), F.lit(0)) if fill else F.col(name)).alias(name)

    return df.select(*[F.col(f"`{k}`") for k in keep], *[one(n) for n in contract])


def encoding_report(df: DataFrame, contract: list[str]) -> dict[str, list[str]]:
    return schema_difference(df.columns, contract)


def feature_categories(names: list[str]) -> dict[str, list[str]]:
    """Features by origin, told from their names: UTM, survey, derived, other."""
    utm, survey = ("Source_", "Medium_", "Term_"), ("gênero", "g_nero", "idade", "faz", "faixa", "cart", "estudou", "faculdade", "evento")
    derived = ("nome_", "email_", "telefone_", "dia_semana")
    groups: dict[str, list[str]] = {"utm": [], "survey": [], "derived": [], "other": []}
    for name in names:
        for group, marks in (("utm", utm), ("survey", survey), ("derived", derived)):
            if any(m in name for m in marks):
                groups[group].append(name)
                break
        else:
            groups["other"].append(name)
    return groups
