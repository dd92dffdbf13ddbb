"""Fixed values and defaults shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Header aliases, in order of preference, matched case-sensitively.
# ---------------------------------------------------------------------------
DATE_ALIASES = ("TimePeriod", "date_start", "segments_date", "date", "Date",
                "day", "Day", "report_date", "time_period", "period")
REVENUE_ALIASES = ("Revenue", "revenue", "conversion", "metrics_conversions_value",
                   "conv_value", "ConvValue", "total_revenue", "sales",
                   "total_sales", "Total sales", "conversion_value")
SPEND_ALIASES = ("Spend", "spend", "metrics_cost_micros", "cost", "Cost",
                 "total_spend", "Total spend", "amount_spent")
NAME_ALIASES = ("CampaignName", "campaign_name", "campaign", "Campaign",
                "ad_set_name", "adset_name", "campaign_id")
TYPE_ALIASES = ("CampaignType", "campaign_type", "campaign_advertising_channel_type",
                "type", "Type", "objective", "Objective")


@dataclass(frozen=True)
class Platform:
    """One ad platform: its canonical file name and the fallback name patterns."""

    channel: str
    file_name: str
    patterns: tuple[str, ...]
    type_from_name: bool = False
    spend_may_be_micros: bool = False


# Platforms, in load order.
PLATFORMS = (
    Platform("bing", "bing_campaign_stats.csv", ("bing*.csv",)),
    Platform("meta", "meta_ads_campaign_stats.csv", ("meta*.csv", "facebook*.csv"),
             type_from_name=True),
    Platform("google", "google_ads_campaign_stats.csv", ("google*.csv",),
             spend_may_be_micros=True),
)

# Texts that a delimited file uses for "no value".
NULL_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
              "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
              "n/a", "nan", "null")
NULL_LABEL = "nan"
MISSING_LABEL = "unknown"

# Spend is taken to be in millionths when its median exceeds this.
MICROS_MEDIAN = 10_000
MICROS_PER_UNIT = 1_000_000

# Promotional events (name, date, days before, days after).
PROMO_EVENTS = (
    ("black_friday", "2024-11-29", -2, 1),
    ("cyber_monday", "2024-12-02", -1, 2),
    ("black_friday", "2025-11-28", -2, 1),
    ("cyber_monday", "2025-12-01", -1, 2),
    ("valentines_day", "2025-02-14", -2, 2),
    ("valentines_day", "2026-02-14", -2, 2),
    ("mothers_day", "2025-05-11", -2, 1),
    ("mothers_day", "2026-05-10", -2, 1),
    ("prime_day", "2025-07-08", -2, 2),
    ("prime_day", "2024-07-16", -2, 2),
)

# Forecast windows and eligibility gates.
HORIZONS = (30, 60, 90)
MIN_CALENDAR_DAYS = 90
MIN_NONZERO_DAYS = 60
FLOOR_PERCENTILE = 0.10
FLOOR_AVERAGE_SHARE = 0.05
ROAS_LOWER_BOUND = 0.1
FALLBACK_ROAS_CV = 0.3
FALLBACK_BAND = (0.6, 1.4)
DISPLAY_MIN_POINT = 100
TRAILING_DAYS = 30

#: Days without facts that a gap-free series fills at most.
LONGEST_GAP = 3660

# Anomaly rules.
Z_WINDOW = 14
Z_THRESHOLD = 2.5
Z_HIGH = 4
WEEK_ROWS = 7
WEEK_MIN_ROWS = 4
SPEND_RISE = 0.20
REVENUE_FALL = -0.10
LOOKBACK_DAYS = 90

# Anomaly sentences (printf style) and the line format of the digest.
TEXT_REVENUE = "Revenue %s of %s USD (%sσ from 14-day rolling mean)."
TEXT_ROAS = "ROAS dropped to %sx (%sσ below 14-day mean). Spend was $%s, revenue $%s."
TEXT_DECOUPLING = ("Spend rose %s WoW but revenue fell %s WoW. "
                   "Potential audience saturation or tracking issue.")
TEXT_CHANNEL = "%s revenue %s (%sσ). Revenue: $%s, spend: $%s."
TEXT_DIGEST_LINE = "- [%s] %s | %s | %s"
TEXT_NO_ANOMALY = "No significant anomalies detected in the lookback window."
TEXT_NO_RECENT_ANOMALY = "No significant anomalies detected in the recent data."

LEVELS = ("aggregate", "channel", "campaign_type", "campaign")
SLICE = ("level", "entity")


@dataclass(frozen=True)
class ModelSettings:
    """Hyperparameters of the forecast model; part of the refit fingerprint."""

    interval_width: float = 0.80
    uncertainty_samples: int = 500
    changepoint_scale: float = 0.05
    seasonality_scale: float = 10.0
    shrinkage: float = 5.0
    cap_elasticity: float | None = None
    use_spend_regressor: bool = True
    #: Slope changes that sampled intervals expect over a span as long as the training days.
    trend_changes: float = 0.0
    seed: int = 42
    min_calendar_days: int = MIN_CALENDAR_DAYS
    min_nonzero_days: int = MIN_NONZERO_DAYS
