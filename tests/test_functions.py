"""Row-level tables for the column expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadspark.functions import contact, dates, deciles, economics, events, text, utm


def run(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def table(spark, expression, pairs, kind="string"):
    got = run(spark, expression, [p[0] for p in pairs], kind)
    assert got == [p[1] for p in pairs]


def test_email_key(spark):
    table(spark, contact.email_key, [
        (" Ana@Mail.COM ", "ana@mail.com"), ("a@b.c", None), ("a@b.cd", "a@b.cd"), ("nan", None), (None, None), ("", None),
        (" ana@mail.com ", "ana@mail.com"), ("no-at-sign.com", None),
    ])


def test_phone_key(spark):
    table(spark, contact.phone_key, [
        ("+55 (11) 99988-7766", "11999887766"), ("11999887766.0", "11999887766"), ("1.1999887766E10", "11999887766"),
        ("1.1999887766e+10", "11999887766"), ("5511999887766", "11999887766"), ("5533334444", "5533334444"), ("99887766", "99887766"),
        ("1234567", None), ("119998877661234", None), (None, None), ("abc", None), ("nan", None),
    ])


def test_phone_key_of_double(spark):
    table(spark, contact.phone_key, [(11999887766.0, "11999887766"), (None, None)], "double")


def test_phone_variants(spark):
    got = run(spark, contact.phone_variants, ["37999610179", "3799610179", "999610179", "99610179", "77610179", None, "12"])
    assert [set(g) for g in got] == [
        {"37999610179", "99610179", "3799610179"}, {"3799610179", "99610179", "37999610179"}, {"999610179", "99610179"},
        {"99610179", "999610179"}, {"77610179"}, set(), set(),
    ]
    assert all(len(g) == len(set(g)) for g in got)


def test_validity(spark):
    table(spark, contact.email_is_valid, [("a.b+c@d.co", True), ("a@b", False), (None, False), (" A@B.CO ", True)])
    table(spark, contact.name_is_valid, [("Ana", True), ("12 34", False), ("A", False), (None, False), ("Zé", True), ("...", False)])


def test_names_gender_state_hash(spark):
    table(spark, contact.first_name, [("Ana Maria Silva", "Ana"), ("Ana", "Ana"), (" ", None), (None, None)])
    table(spark, contact.last_name, [("Ana Maria Silva", "Maria Silva"), ("Ana", None), (None, None)])
    table(spark, contact.gender_code, [("Masculino", "m"), (" FEMININO ", "f"), ("outro", None), (None, None), ("12", None)])
    table(spark, contact.phone_state, [("+55 11 999887766", "SP"), ("98999887766", "MA"), ("00", None), (None, None)])
    import hashlib

    table(spark, contact.hashed, [(" Ana ", hashlib.sha256(b"ana").hexdigest()), (" ", None), (None, None)])
    assert len(contact.AREA_CODES) == 67 and len(set(contact.AREA_CODES.values())) == 27


def test_text(spark):
    table(spark, text.clean_invisible, [("⁠a​b c ", "ab c"), (None, None)])
    table(spark, text.collapse_spaces, [("  a \t b c ", "a b c"), (None, None)])
    table(spark, text.comparison_form, [(" Audience  A.. ", "audience a"), (None, None)])
    table(spark, text.nfc, [("é", "é"), (None, None)])
    table(spark, text.decimal_comma, [("0,31", 0.31), ("0.5", 0.5), ("x", None), (None, None)])
    table(spark, text.thousands, [("1,234.5", 1234.5), ("", None)])
    assert text.feature_name("O seu gênero:_Feminino") == "O_seu_g_nero_Feminino"


def test_cleaners_are_idempotent(spark):
    values = ["  A  b ", "⁠x", "ADV | y", None]
    for clean in (text.strip, text.collapse_spaces, text.clean_invisible, text.comparison_form, contact.email_key, contact.phone_key):
        once = run(spark, clean, values)
        assert run(spark, clean, once) == once


def test_ratios(spark):
    row = spark.range(1).select(
        text.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("a"), text.safe_ratio(F.lit(1.0), F.lit(4.0), 100).alias("b"),
        text.ratio_den1(F.lit(3.0), F.lit(0.0)).alias("c"), text.percent_difference(F.lit(3.0), F.lit(0.0)).alias("d"),
        text.percent_difference(F.lit(3.0), F.lit(2.0)).alias("e"),
    ).first()
    assert tuple(row) == (0.0, 25.0, 3.0, 0.0, 50.0)


def test_dates(spark):
    ts = dt.datetime
    table(spark, dates.parse_timestamp, [
        ("31/12/2024", ts(2024, 12, 31)), ("01/02/2024 10:20:30", ts(2024, 2, 1, 10, 20, 30)), ("1/2/2024 9:05", ts(2024, 2, 1, 9, 5)),
        ("2024-02-01", ts(2024, 2, 1)), ("2024-02-01 03:04:05", ts(2024, 2, 1, 3, 4, 5)), ("#ERROR!", None), (None, None), ("31/02/2024", None),
    ])
    table(spark, lambda c: dates.epoch_seconds(c, F.lit(7)), [("1970-01-01 00:01:00", 60), ("bad", 7), (None, 7)])


def test_periods(spark):
    df = spark.sql("SELECT DATE '2025-10-28' AS s").withColumns(dates.launch_periods(F.col("s")))
    row = df.first()
    assert (str(row["capture_end"]), str(row["sales_start"]), str(row["sales_end"])) == ("2025-11-03", "2025-11-10", "2025-11-16")
    c = F.col
    flags = df.select(*[v.alias(k) for k, v in dates.period_flags(c("s"), c("capture_end"), c("sales_start"), c("sales_end")).items()]).first()
    assert all(flags)
    short = df.select(dates.sales_period(c("capture_end"))["sales_start"].alias("x")).first()["x"]
    assert str(short) == "2025-11-10"


UTM = "ACME | CAP | FRIO | FASE 01 | ABERTO ADV+ | PG2 | 2025-04-15|120220370119870390"


def test_utm_ids(spark):
    table(spark, utm.utm_id, [
        (UTM, "120220370119870390"), ("120220370119870390", "120220370119870390"), ("22527413714--180108372678--750940275538", "750940275538"),
        ("ad 12345678901 x", "12345678901"), ("name", None), (None, None), ("a--b", None),
    ])
    table(spark, utm.campaign_id, [(UTM, "120220370119870390"), ("x 120220370119870 y", "120220370119870"), ("a|12345678901", "12345678901"), ("a|1", None), (None, None)])
    table(spark, utm.campaign_base, [(UTM, UTM.rsplit("|", 1)[0]), ("plain | ", "plain"), ("", None), (None, None)])
    table(spark, utm.captured_ad_id, [(UTM, "120220370119870"), ("a|123", None), (None, None)])
    table(spark, utm.is_numeric_id, [("12345678901", True), ("1234567890", False), ("x", False), (None, False)])


def test_adset_from_campaign(spark):
    table(spark, utm.adset_from_campaign, [
        (UTM, "ABERTO ADV+"), ("A | B | FASE 02 | X | Y | PG1 | Z", "X | Y"), ("a | b | c | d | e | f", "e | f"), ("a | b | c", "b | c"),
        ("single", "single"), (" | ", None), ("", None), (None, None), ("FASE 1 | PG1 | z", "PG1 | z"),
    ])


def test_utm_cleaning(spark):
    table(spark, utm.unified_term, [("ig", "instagram"), ("fb", "facebook"), ("a--b", "outros"), ("{x}", "outros"), ("123", "123"), ("12345678901", "outros"), ("word", "outros"), (None, None)])
    table(spark, utm.unified_source, [("fb", "outros"), ("google-ads", "google-ads"), ("utm_source", "utm_source"), (None, None)])
    table(spark, utm.medium_audience, [("ADV | Open", "Open"), ("Open | AD01", "Open"), (" Open ", "Open"), ("ADV | ADV | z", "ADV | z"), (None, None)])
    table(spark, utm.keyword, [("word--1--2", "word"), ("fb--1", None), ("", None), (None, None)])
    table(spark, utm.campaign_class, [
        ("DEMO | CAP | FRIO | MACHINE LEARNING", "COM_ML"), ("demo | cap | frio | x | ML | y", "COM_ML"), ("DEMO | CAP | FRIO | SCORE", "SEM_ML"),
        ("OTHER | ML |", "EXCLUIR"), (None, "EXCLUIR"),
    ])
    table(spark, utm.event_class, [("LeadQualified", "COM_CAPI"), ("LEAD", "SEM_CAPI"), (None, "SEM_CAPI")])
    table(spark, utm.goal_name, [
        ("conversions:offsite_conversion.fb_pixel_custom.LeadQualifiedHighQuality", "LeadQualifiedHighQuality"), ("x lead_qualified", "LeadQualified"),
        ("actions:faixa_a", "Faixa A"), ("fb_pixel_lead", "Lead"), ("other", "other"), (None, "Lead"),
    ])
    table(spark, lambda c: utm.valid_utm(c, ("Bare",)), [("x", True), ("", False), ("{{y}}", False), ("BARE", False), (None, False)])
    table(spark, utm.short_label, [("X CAP FRIO MACHINE LEARNING | 2025-05-28", "[ML]       CAP/FRIO   2025-05-28"), ("ESCALA SCORE RET", "[ESCALA]   RET")])
    table(spark, utm.ad_code, [("DEV-AD0033-vid", "AD0033"), ("none", None)])
    table(spark, lambda c: utm.account_label(c, {"act_1": "One", "Second": "Two"}), [("act_1", "One"), ("my Second file", "Two"), ("z", "z"), (None, "N/A")])


def test_decile_labels(spark):
    table(spark, deciles.decile_label, [(1, "D01"), (10, "D10"), (None, None)], "int")
    table(spark, deciles.decile_number, [("D1", 1), ("d03", 3), ("D10", 10), ("D11", None), ("x", None), (None, None)])


def test_thresholds(spark):
    bands = [(1, 0.0, 0.1), (2, 0.12, 0.5), (10, 0.6, 0.9)]
    table(spark, lambda c: deciles.by_thresholds(c, bands), [
        (0.05, 1), (0.1, 1), (0.12, 2), (0.95, 10), (-1.0, 1), (0.11, 1), (0.55, 10), (float("nan"), None), (None, None),
    ], "double")


@pytest.mark.parametrize("leads, days, expected", [(15, 1, 0.5), (30, 1, 0.9047)])
def test_confidence(spark, leads, days, expected):
    value = spark.range(1).select(economics.confidence(F.lit(leads), F.lit(days))).first()[0]
    assert value == pytest.approx(expected, abs=1e-3)


def test_economics(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(economics.cpl(F.lit(10.0), F.lit(0))) == 0.0
    assert [one(economics.roas_multiplier(F.lit(x))) for x in (2.0, 2.5, 8.0, 10.0)] == [0.0, 0.5, 1.0, 1.0]
    assert one(economics.budget_variation(F.lit(918.26), F.lit(100.84), F.lit(10.11), F.lit(15), F.lit(1))) == 50.0
    assert one(economics.budget_variation(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(1), F.lit(1))) == 0.0
    assert [one(economics.confidence_level(F.lit(n), F.lit(1))) for n in (2, 5, 15, 30)] == ["insuficiente", "baixa", "media", "alta"]
    assert one(economics.adjusted_value(F.lit(100.0), F.lit("TMB"))) == pytest.approx(62.11)

    def act(dimension, leads, spend, margin, roas, has=True, days=1):
        return one(economics.action(dimension, F.lit(has), F.lit(leads), F.lit(days), F.lit(spend), F.lit(margin), F.lit(roas)))

    assert act("campaign", 0, 101.0, -101.0, 0.0) == "Reduzir 100%"
    assert act("ad", 0, 101.0, -101.0, 0.0) == "Remover"
    assert act("ad", 2, 101.0, -50.0, 0.5) == "Remover (ROAS < 1.0)"
    assert act("campaign", 2, 10.0, 5.0, 3.0) == "Aguardar dados (falta 1 lead)"
    assert act("campaign", 1, 10.0, 5.0, 3.0) == "Aguardar dados (faltam 2 leads)"
    assert act("campaign", 50, 10.0, 5.0, 3.0, has=False) == "ABO"
    assert act("medium", 50, 10.0, -5.0, 3.0, has=False) == "CBO - Pausar / Alterar"
    assert act("medium", 50, 10.0, 5.0, 3.0, has=False) == "CBO - Manter"
    assert act("ad", 50, 10.0, -5.0, 3.0) == "Remover"
    assert act("campaign", 15, 100.84, 918.26, 10.11) == "Aumentar 50.0%"
    assert act("campaign", 15, 100.0, 50.0, 1.0) == "Manter (ROAS baixo)"
    assert act("campaign", 15, 100.0, -50.0, 0.5) == "Reduzir 25.0%"


def test_log_lines(spark):
    lines = ["x LeadQualified enviado: A@b.co (decil: D10, x)", "LeadQualifiedHighQuality enviado: c@d.co (y)", "Faixa A enviado: e@f.co (", "noise"]
    table(spark, events.log_email, list(zip(lines, ["a@b.co", "c@d.co", "e@f.co", None])))
    table(spark, events.log_event, list(zip(lines, ["LeadQualified", "LeadQualifiedHighQuality", "Faixa A", None])))
