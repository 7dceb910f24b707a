"""Business parameters, all overridable through :class:`Settings`."""

from __future__ import annotations

from dataclasses import dataclass, field

DECILES = tuple(range(1, 11))

# Expected conversion rate per decile, as observed and after
# correction for matching recall.
OBSERVED_RATES = (
    0.002137, 0.002748, 0.002138, 0.005802, 0.003053,
    0.006721, 0.006718, 0.010382, 0.014043, 0.019243,
)
CORRECTED_RATES = (
    0.003836, 0.004933, 0.003838, 0.010415, 0.005480,
    0.012064, 0.012059, 0.018636, 0.025207, 0.034551,
)


@dataclass(frozen=True)
class Settings:
    # economics
    product_value: float = 2000.0
    rates: tuple[float, ...] = CORRECTED_RATES
    spend_without_leads: float = 100.0
    min_leads_per_day: int = 3
    min_roas: float = 2.5
    target_roas: float = 8.0
    max_variation: float = 100.0
    sigmoid_midpoint: float = 15.0
    sigmoid_slope: float = 0.15
    level_per_day: tuple[int, int, int] = (3, 10, 20)
    # instalment vendor: mean of the two measured realisation rates
    instalment_origin: str = "tmb"
    instalment_factor: float = (0.5605 + 0.6817) / 2
    # linking
    conversion_window_days: int = 20
    min_phone_digits: int = 10
    # launch calendar
    capture_days: int = 7
    nurture_days: int = 6
    sales_days: int = 7
    # comparison of arms
    min_pair_spend: float = 200.0
    imputation_ratio: float = 0.5244
    budget_tolerance: float = 0.30
    creative_overlap: float = 0.80
    impute_lead_ids: tuple[str, ...] = ()
    # similarity thresholds
    campaign_similarity: float = 0.85
    adset_similarity: float = 0.75
    ad_similarity: float = 0.85
    # campaign naming
    acquisition_marker: str = "demo | cap | frio"
    model_markers: tuple[str, ...] = ("machine learning", "| ml |")
    model_events: tuple[str, ...] = ("LeadQualified", "LeadQualifiedHighQuality")
    bare_campaigns: tuple[str, ...] = field(default=())
    bare_mediums: tuple[str, ...] = field(default=())


DEFAULTS = Settings()
