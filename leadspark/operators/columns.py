"""Column-level cleaning: what to drop, rename, coalesce and unify. All decisions are made
on ``df.columns`` at plan time; no job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_invisible
from .joins import left_lookup

# Column names of the survey export.
SCORING_COLUMNS = ("Pontuação", "Score", "Faixa", "Faixa A", "Faixa B", "Faixa C", "Faixa D")
TECHNICAL_COLUMNS = (
    "Remote IP", "User Agent", "fbc", "fbp", "cidade", "estado", "pais", "cep", "externalid",
    "Page URL", "Qual estado você mora?",
)
CAMPAIGN_COLUMNS = ("Campaign", "Content")
INVESTED = "Já investiu em algum curso online para aprender uma nova forma de ganhar dinheiro?"
INTEREST = "O que mais te chama atenção na profissão de Programador?"
LONG_NAMES = {INVESTED: "investiu_curso_online", INTEREST: "interesse_programacao"}
# Pairs of sales columns, first choice first, and the common name.
SALES_PAIRS = {
    "valor": ("Ticket (R$)", "valor produtos"),
    "produto": ("Produto", "nome produto"),
    "nome": ("Cliente Nome", "nome contato"),
    "email": ("Cliente Email", "email contato"),
    "data": ("Criado Em", "data aprovacao"),
    "telefone": ("Telefone", "telefone contato"),
}
SALES_UTM = ("source", "medium", "campaign", "content")
SURVEY_CATEGORIES = (
    "interesse_programacao", "Tem computador/notebook?", "O que mais você quer ver no evento?",
    "Você possui cartão de crédito?", "Atualmente, qual a sua faixa salarial?",
    "O que você faz atualmente?", "Qual a sua idade?",
)
# Exact renames after cleaning; further ones only lose a trailing dot.
RENAMES = {
    "Tem computador/notebook?": {"SIM": "Sim", "não": "Não"},
    "O que mais você quer ver no evento?": {
        "Fazer transição de carreira e consegui meu primeiro emprego na área":
            "Fazer transição de carreira e conseguir meu primeiro emprego na área",
        "A aula com a recrutadora;": "A aula com a recrutadora",
    },
    "O que você faz atualmente?": {
        "Sou autonomo": "Sou autônomo",
        "Sou autônomo (Uber, freela, vendedor, etc).": "Sou autônomo",
        "Atualmente não trabalho e nem estudo.": "Não trabalho e nem estudo",
    },
}
DOTLESS = {
    "interesse_programacao": (
        "Todas as alternativas", "Poder trabalhar de qualquer lugar do mundo",
        "A possibilidade de ganhar altos salários", "Trabalhar para outros países e ganhar em outra moeda",
        "A ideia de nunca faltar emprego na área",
    ),
    "Atualmente, qual a sua faixa salarial?": (
        "Não tenho renda", "Entre R$1.000 a R$2.000 reais ao mês", "Entre R$2.001 a R$3.000 reais ao mês",
        "Entre R$3.001 a R$5.000 reais ao mês", "Mais de R$5.001 reais ao mês",
    ),
    "O que você faz atualmente?": (
        "Trabalho em outra área e quero fazer transição para tecnologia",
        "Estou no ensino médio ou acabei de sair e quero entrar na programação",
        "Estudo T.I. na faculdade mas quero aprender mais por fora",
        "Faço outro curso na faculdade e quero mudar para T.I",
    ),
    "Qual a sua idade?": ("Menos de 18 anos", "Mais de 55 anos"),
}


def _drop(df: DataFrame, unwanted) -> DataFrame:
    # names may hold dots, which drop() would read as fields, so the rest is selected
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not unwanted(c)])


def dropped_columns(df: DataFrame, names) -> list[str]:
    lowered = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() in lowered or c.startswith("Unnamed:")]


def drop_listed(df: DataFrame, names) -> DataFrame:
    """Drop the listed columns, whatever their case, and ``Unnamed:`` ones."""
    gone = set(dropped_columns(df, names))
    return _drop(df, gone.__contains__)


def clean_production_columns(df: DataFrame) -> DataFrame:
    return drop_listed(df, SCORING_COLUMNS + TECHNICAL_COLUMNS)


def drop_campaign_columns(df: DataFrame, short_names: bool = False) -> DataFrame:
    """Drop campaign-specific and blank-named columns (training: names up to 2 chars too)."""
    limit = 2 if short_names else 0
    return _drop(df, lambda c: c in CAMPAIGN_COLUMNS or len(c.strip()) <= limit)


def drop_technical(df: DataFrame) -> DataFrame:
    return _drop(df, TECHNICAL_COLUMNS.__contains__)


def drop_utm_columns(df: DataFrame, prefixes=("Source", "Medium", "Term")) -> DataFrame:
    """Drop UTM columns and their dummies."""
    return _drop(df, lambda c: any(c == p or c.startswith(p + "_") for p in prefixes))


def rename_long(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in LONG_NAMES.items() if k in df.columns})


def similar_columns(names: list[str], prefix: int = 30) -> list[tuple[str, str]]:
    """Pairs of column names with the same first 30 characters."""
    by_prefix: dict[str, list[str]] = {}
    for n in names:
        by_prefix.setdefault(n[:prefix], []).append(n)
    return [(a, b) for same in by_prefix.values() for i, a in enumerate(same) for b in same[i + 1:] if a != b]


def _coalesce(df: DataFrame, sources: tuple[str, ...], to: str) -> DataFrame:
    present = [c for c in sources if c in df.columns]
    if not present:
        return df
    merged = F.coalesce(*[F.col(f"`{c}`") for c in present])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in present]
    return df.select(*kept, merged.alias(to))


def unify_survey_columns(df: DataFrame) -> DataFrame:
    """The two survey questions that occur twice (with a trailing blank) become one column."""
    for question, short in LONG_NAMES.items():
        if question in df.columns and question + " " in df.columns:
            df = _coalesce(df, (question, question + " "), short)
    return df


def unify_sales_columns(df: DataFrame) -> DataFrame:
    """Both vendors' columns to common names; UTM pairs are merged and then dropped."""
    for to, sources in SALES_PAIRS.items():
        df = _coalesce(df, sources, to)
    for name in SALES_UTM:
        pair = (f"utm_last_{name}", f"utm_{name}")
        if all(p in df.columns for p in pair):
            df = _coalesce(df, pair, name)
    return _drop(df, SALES_UTM.__contains__)


def unify_categories(df: DataFrame) -> DataFrame:
    """Clean and unify the survey's category columns that are present."""
    out = {}
    for name in SURVEY_CATEGORIES:
        if name not in df.columns:
            continue
        raw = clean_invisible(F.col(f"`{name}`"))
        renames = {**RENAMES.get(name, {}), **{f"{v}.": v for v in DOTLESS.get(name, ())}}
        value = raw
        if renames:
            table = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
            value = F.coalesce(F.try_element_at(table, raw), raw)
        if name == "O que mais você quer ver no evento?":
            value = F.when(raw.rlike("Quero saber.*é.*para.*mim"), "Quero saber se é para mim").otherwise(value)
        if name == "Você possui cartão de crédito?":
            value = F.when(raw.contains("Sim"), "Sim").otherwise(value)
        out[name] = value
    return df.withColumns(out) if out else df


def rename_values(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Exact renames from a ``mapping(value, category)`` table; others stay as they are."""
    table = mapping.select(F.col("value").alias("__v"), F.col("category").alias("__c")).dropDuplicates(["__v"])
    return left_lookup(df, table, column, "__v").withColumn(column, F.coalesce("__c", column)).drop("__c")


def column_report(df: DataFrame) -> list[tuple[int, str, str]]:
    """Position, name and type of every remaining column."""
    return [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes, 1)]


def after_cutoff(df: DataFrame, time: str, cutoff: str, drop: tuple[str, ...] = ()) -> DataFrame:
    return _drop(df.filter(F.col(time) >= F.lit(cutoff).cast("date")), set(drop).__contains__)


def schema_difference(actual: list[str], expected: list[str]) -> dict[str, list[str]]:
    return {
        "missing": [c for c in expected if c not in set(actual)],
        "extra": [c for c in actual if c not in set(expected)],
    }
