"""UTM and campaign-name expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from .text import strip

# Minority sources folded into one category.
MINOR_SOURCES = ("fb", "teste", '[field id="utm_source"]', "facebook-ads-SiteLink")
MINOR_SOURCES_TRAINING = MINOR_SOURCES + ("utm_source",)
# Terms and mediums that only name the platform.
GENERIC_KEYWORDS = ("fb", "ig", "instagram", "facebook")
GENERIC_ADSETS = ("paid", "dgen", "facebook", "instagram", "meta", "fb", "ig", "cpc")


def _group(c: Column, pattern: str, index: int = 1) -> Column:
    """First match of ``pattern``, null (not empty text) when there is none."""
    found = F.regexp_extract(c, pattern, index)
    return F.when(found != "", found)


def unified_source(c: Column, minor: tuple[str, ...] = MINOR_SOURCES) -> Column:
    return F.when(c.isin(*minor), "outros").otherwise(c)


def unified_term(c: Column) -> Column:
    """``ig`` and ``fb`` spelled out; short digit strings stay; the rest is ``outros``."""
    return (
        F.when(c.isin("ig", "instagram"), "instagram")
        .when(c.isin("fb", "facebook"), "facebook")
        .when(c.rlike("^[0-9]{1,10}$"), c)
        .when(c.isNotNull(), "outros")
    )


def medium_audience(c: Column) -> Column:
    """Audience part of ``ADV | audience | ...`` or ``audience | ...``."""
    text = strip(c)
    parts = F.split(text, r"\|")
    head = strip(parts[0])
    piped = F.size(parts) > 1
    return F.when(piped & (F.upper(head) == "ADV"), _not_adv(text, parts)).when(piped, head).otherwise(text)


def _not_adv(text: Column, parts: Column) -> Column:
    second = strip(F.get(parts, F.lit(1)))
    rest = strip(F.regexp_replace(text, r"^[^|]*\|", ""))
    return F.when(F.upper(second) == "ADV", rest).otherwise(second)


def campaign_id(c: Column) -> Column:
    """Last ``|`` part when it is a number of 11+ digits, else the first ``1`` + 14 digits run."""
    last = strip(F.element_at(F.split(c, r"\|"), -1))
    tail = F.when(c.contains("|") & last.rlike("^[0-9]{11,}$"), last)
    return F.coalesce(tail, _group(c, "(1[0-9]{14,})"))


def campaign_base(c: Column) -> Column:
    """Campaign name without its id and trailing separators."""
    bare = F.regexp_replace(c, r"\|?\s*1[0-9]{14,}", "")
    return F.when(c != "", strip(F.regexp_replace(bare, r"[| ]+$", "")))


def utm_id(c: Column) -> Column:
    """Platform id of a UTM value: ``...|18 digits``, bare 18 digits, last of ``a--b--c``,
    or a word of 11 or 12 digits."""
    text = strip(c)
    dashed = F.split(text, "--")
    return F.coalesce(
        _group(text, r"\|([0-9]{18})$"),
        _group(text, "^([0-9]{18})$"),
        F.when(F.size(dashed) >= 3, F.element_at(dashed, -1)),
        _group(text, r"\b([0-9]{11,12})\b"),
    )


def id_suffix(c: Column, digits: str = "15,", cut: int | None = 15) -> Column:
    """Digits after the final ``|``: at least or exactly ``digits`` of them, cut to ``cut``."""
    found = _group(c, rf"\|([0-9]{{{digits}}})$")
    return found if cut is None else F.substr(found, F.lit(1), F.lit(cut))


def captured_ad_id(c: Column) -> Column:
    return id_suffix(c, "15,", 15)


def is_numeric_id(c: Column) -> Column:
    return F.coalesce(strip(c).rlike("^[0-9]{11,}$"), F.lit(False))


def _without_tail(c: Column) -> Column:
    """UTM campaign text without its id and its date."""
    no_id = F.regexp_replace(c, r"\|[0-9]{18}$", "")
    return F.regexp_replace(no_id, r"\|\s*[0-9]{4}-[0-9]{2}-[0-9]{2}$", "")


def campaign_label(c: Column) -> Column:
    return strip(_without_tail(c))


def adset_from_campaign(c: Column) -> Column:
    """Adset name inside a campaign UTM: what stands between the ``FASE`` and ``PG`` parts;
    else from the fifth part on; else the last two parts."""
    clean = _without_tail(c)
    parts = F.filter(F.transform(F.split(clean, r"\|"), strip), lambda p: p != "")
    phase = F.array_position(F.transform(parts, lambda p: p.startswith("FASE ")), F.lit(True)).cast("int")
    page = F.array_position(F.transform(parts, lambda p: p.startswith("PG")), F.lit(True)).cast("int")
    between = F.slice(parts, phase + 1, page - phase - 1)
    n = F.size(parts)
    return (
        F.when(c.isNull() | (c == "") | (n == 0), F.lit(None).cast("string"))
        .when((phase > 0) & (page > phase + 1), F.array_join(between, " | "))
        .when(n >= 5, F.array_join(F.slice(parts, F.lit(5), n), " | "))
        .when(n >= 2, F.array_join(F.slice(parts, F.lit(-2), F.lit(2)), " | "))
        .otherwise(clean)
    )


def keyword(c: Column) -> Column:
    """Search keyword of a term such as ``keyword--campaign--ad``; null when generic."""
    first = strip(F.split(c, "--")[0])
    return F.when((first != "") & ~first.isin(*GENERIC_KEYWORDS), first)


def is_acquisition(c: Column, settings: Settings = DEFAULTS) -> Column:
    return F.coalesce(F.lower(c).contains(settings.acquisition_marker), F.lit(False))


def campaign_class(c: Column, settings: Settings = DEFAULTS) -> Column:
    """``COM_ML``, ``SEM_ML`` or, outside acquisition, ``EXCLUIR``."""
    marked = reduce(
        lambda a, b: a | b, [F.lower(c).contains(m) for m in settings.model_markers]
    )
    return (
        F.when(~is_acquisition(c, settings), "EXCLUIR").when(marked, "COM_ML").otherwise("SEM_ML")
    )


def event_class(goal: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(goal.isin(*settings.model_events), "COM_CAPI").otherwise("SEM_CAPI")


def valid_utm(c: Column, bare: tuple[str, ...] = ()) -> Column:
    """Not null, not empty, no ``{{`` placeholder, none of the bare names."""
    ok = c.isNotNull() & (c != "") & ~c.contains("{{")
    return (ok & ~F.upper(c).isin(*[b.upper() for b in bare])) if bare else ok


def null_templates(c: Column) -> Column:
    return F.when(~c.contains("{{"), c)


def comparable_name(c: Column) -> Column:
    """Lower-cased name without an id suffix, the form used to compare names."""
    return F.lower(strip(F.regexp_replace(c, r"\|[0-9]+$", "")))


def goal_name(goal: Column) -> Column:
    """Simplified optimisation goal of a report row; a missing one is a plain lead."""
    text = F.lower(goal)

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(w) for w in words])

    return (
        F.when(goal.isNull(), "Lead")
        .when(has("leadqualifiedhighquality", "lead_qualified_high_quality"), "LeadQualifiedHighQuality")
        .when(has("leadqualified", "lead_qualified"), "LeadQualified")
        .when(has("faixa a", "faixa_a"), "Faixa A")
        .when(has("lead"), "Lead")
        .otherwise(goal)
    )


def short_label(c: Column) -> Column:
    """Strategy, type/temperature and date of a campaign name, padded for a console table."""
    tag = (
        F.when(c.contains("MACHINE LEARNING"), "[ML]")
        .when(c.contains("ESCALA SCORE"), "[ESCALA]")
        .when(c.contains("FAIXA A"), "[FAIXA-A]")
        .when(c.contains("FAIXA B"), "[FAIXA-B]")
        .when(c.contains("FAIXA C"), "[FAIXA-C]")
        .otherwise("[OUTRO]")
    )
    kind = F.when(c.contains("CAP"), "CAP").when(c.contains("RET"), "RET")
    warmth = F.when(c.contains("FRIO"), "FRIO").when(c.contains("MORNO"), "MORNO")
    last = strip(F.element_at(F.split(c, r"\|"), -1))
    dated = c.contains("|") & last.rlike("20[0-9]{2}")
    day = F.when(dated, F.substr(last, F.lit(1), F.lit(10))).otherwise("")
    described = F.concat_ws("/", kind, warmth)
    return F.trim(F.format_string("%-10s %-10s %-10s", tag, described, day))


def account_label(c: Column, names: dict[str, str]) -> Column:
    """Display name of an account id or report file name; ``names`` maps id or name part
    to the display name."""
    out = F.lit(None).cast("string")
    for part, label in reversed(list(names.items())):
        hit = (c == part) if part.startswith("act_") else c.contains(part)
        out = F.when(hit, label).otherwise(out)
    return F.coalesce(out, c, F.lit("N/A"))


def ad_code(c: Column) -> Column:
    return _group(c, "(AD0[0-9]+)")
