"""Scalar column functions (F1-F17).  All are native Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# AQI category names and upper bounds of the threshold rule.
CATEGORY_THRESHOLDS = [
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy for Sensitive Groups"),
    (200, "Unhealthy"),
    (300, "Very Unhealthy"),
]
CATEGORY_TOP = "Hazardous"
CATEGORY_ORDER = [name for _, name in CATEGORY_THRESHOLDS] + [CATEGORY_TOP]

# Four-band status used by the city ranking.
STATUS4 = [(50, "Good"), (100, "Moderate"), (150, "Unhealthy")]
STATUS4_TOP = "Very Unhealthy"

# Colour bands of the daily bar chart (strict bounds).
STATUS4_STRICT = [(50, "green"), (100, "yellow"), (150, "orange")]
STATUS4_STRICT_TOP = "red"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def calendar_parts(df: DataFrame, ts: str = "timestamp", parts=None) -> DataFrame:
    """hour, day_of_week (Monday = 0), day_of_year, month, quarter, year, date, day name."""
    t = F.col(ts)
    exprs = {
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "day_of_year": F.dayofyear(t),
        "month": F.month(t),
        "quarter": F.quarter(t),
        "year": F.year(t),
        "date": F.to_date(t),
        "day_name": F.date_format(t, "EEEE"),
    }
    wanted = parts or ["hour", "day_of_week", "day_of_year", "month", "quarter", "year"]
    return df.withColumns({p: exprs[p] for p in wanted})


def cyclic(x, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*x/period."""
    ang = _c(x).cast("double") * (2.0 * math.pi / period)
    return F.sin(ang), F.cos(ang)


def interaction(a, b) -> Column:
    """product of two measures."""
    return _c(a) * _c(b)


def category_by_threshold(x) -> Column:
    """<=50 Good ... <=300 Very Unhealthy, else Hazardous; null stays null."""
    v = _c(x)
    out = None
    for hi, name in CATEGORY_THRESHOLDS:
        out = F.when(v <= hi, F.lit(name)) if out is None else out.when(v <= hi, F.lit(name))
    return out.when(v.isNotNull(), F.lit(CATEGORY_TOP))


def _bands(v: Column, bands, top: str, strict: bool) -> Column:
    out = None
    for hi, name in bands:
        cond = (v < hi) if strict else (v <= hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.when(v.isNotNull(), F.lit(top))


def status4(x) -> Column:
    """Good / Moderate / Unhealthy / Very Unhealthy with inclusive bounds."""
    return _bands(_c(x), STATUS4, STATUS4_TOP, strict=False)


def status4_strict(x) -> Column:
    """Colour band with strict bounds."""
    return _bands(_c(x), STATUS4_STRICT, STATUS4_STRICT_TOP, strict=True)


def corr_strength(r) -> Column:
    """|r| > 0.7 Strong, > 0.5 Moderate, else Weak."""
    a = F.abs(_c(r))
    return F.when(a > 0.7, "Strong").when(a > 0.5, "Moderate").when(a.isNotNull(), "Weak")


def corr_direction(r) -> Column:
    """sign name (zero counts as Negative, as in the published rule)."""
    v = _c(r)
    return F.when(v > 0, "Positive").when(v.isNotNull(), "Negative")


def trend_label(d) -> Column:
    """> 5 upward, < -5 downward, else stable."""
    v = _c(d)
    return F.when(v > 5, "upward").when(v < -5, "downward").when(v.isNotNull(), "stable")


def clip(x, lo: float = 20.0, hi: float = 500.0) -> Column:
    """F8: clamp; null stays null."""
    v = _c(x)
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def round_half_even(x, d: int) -> Column:
    """NumPy-style rounding: scale by 10^d, round half to even on the binary value, scale back."""
    k = float(10 ** d)
    return F.bround(_c(x) * k, 0) / k


def round_half_up(x, d: int) -> Column:
    """SQL-style rounding (half away from zero) on the binary value."""
    k = float(10 ** d)
    return F.round(_c(x) * k, 0) / k


# Factor tables of the rule-based forecast.  Row "a" is the one
# the application uses; row "b" is its second (unused) variant.
RULE_FACTORS = {
    "a": {"rush": 1.2, "offpeak": 0.95, "hum_hi": (75, 1.15), "hum_lo": (35, 1.1),
          "wind_lo": (3, 1.12), "wind_hi": (10, 0.88), "temp_hi": (38, 1.08), "temp_lo": (18, 1.05),
          "winter": 1.1, "monsoon": 0.9},
    "b": {"rush": 1.15, "offpeak": 0.95, "hum_hi": (70, 1.1), "hum_lo": (40, 1.05),
          "wind_lo": (3, 1.08), "wind_hi": (8, 0.92), "temp_hi": (35, 1.03), "temp_lo": (15, 1.05),
          "winter": 1.0, "monsoon": 1.0},
}
# Defaults for absent inputs of the rule-based forecast.
RULE_DEFAULTS = {"aqi": 50.0, "temperature": 25.0, "humidity": 60.0, "wind_speed": 5.0}


def rule_forecast(aqi="aqi", temperature="temperature", humidity="humidity", wind_speed="wind_speed",
                  ts="timestamp", variant: str = "a", clip_result: bool = True) -> Column:
    """multiplicative rule forecast of the value 24 h ahead.

    The published night branch (22 <= h <= 5) can never hold and is not built.
    Random per-model jitter is off: results are reproducible.
    """
    f = RULE_FACTORS[variant]
    a = F.coalesce(_c(aqi), F.lit(RULE_DEFAULTS["aqi"]))
    t = F.coalesce(_c(temperature), F.lit(RULE_DEFAULTS["temperature"]))
    h = F.coalesce(_c(humidity), F.lit(RULE_DEFAULTS["humidity"]))
    w = F.coalesce(_c(wind_speed), F.lit(RULE_DEFAULTS["wind_speed"]))
    hr, mo = F.hour(_c(ts)), F.month(_c(ts))
    traffic = F.when(hr.between(7, 9) | hr.between(17, 19), f["rush"]).otherwise(f["offpeak"])
    hum = F.when(h > f["hum_hi"][0], f["hum_hi"][1]).when(h < f["hum_lo"][0], f["hum_lo"][1]).otherwise(1.0)
    wind = F.when(w < f["wind_lo"][0], f["wind_lo"][1]).when(w > f["wind_hi"][0], f["wind_hi"][1]).otherwise(1.0)
    temp = F.when(t > f["temp_hi"][0], f["temp_hi"][1]).when(t < f["temp_lo"][0], f["temp_lo"][1]).otherwise(1.0)
    season = F.when(mo.isin(12, 1, 2), f["winter"]).when(mo.isin(6, 7, 8), f["monsoon"]).otherwise(1.0)
    raw = a * traffic * hum * wind * temp * season
    return clip(raw) if clip_result else raw


def title_model_name(x) -> Column:
    """random_forest -> Random Forest."""
    return F.initcap(F.regexp_replace(_c(x), "_", " "))


def fmt(x, pattern: str = "%.2f") -> Column:
    """printf-style metric text."""
    return F.format_string(pattern, _c(x))


def iso_ts(x) -> Column:
    """ISO text of a timestamp."""
    return F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss")


def minute_text(x) -> Column:
    """'%Y-%m-%d %H:%M' text of a timestamp."""
    return F.date_format(_c(x), "yyyy-MM-dd HH:mm")


def range_text(lo, hi) -> Column:
    """'0-50' style label."""
    return F.concat_ws("-", _c(lo).cast("string"), _c(hi).cast("string"))
