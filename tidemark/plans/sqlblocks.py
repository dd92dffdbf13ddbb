"""Building blocks of the independent SQL checks (DuckDB dialect).

The checks are written as plain groupings and joins on a generated calendar, so
they share no technique with the DataFrame operators they verify.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from tidemark import config as cfg

Event = tuple[str, str, int, int]

ADS = """ads AS (
  SELECT l_returnflag AS channel, p_type AS campaign_type, p_brand AS campaign_name,
         CAST(l_shipdate AS DATE) AS ds,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS revenue,
         CAST(l_extendedprice * l_tax AS DECIMAL(18,4)) AS spend
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_LEVEL = {
    "aggregate": ("'all'", "CAST(NULL AS VARCHAR)", ""),
    "channel": ("channel", "channel", "channel, "),
    "campaign_type": ("channel || '/' || campaign_type", "channel", "channel, campaign_type, "),
    "campaign": ("channel || '/' || campaign_name", "channel", "channel, campaign_name, "),
}


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c) + "\n" + select


def totals(levels: Sequence[str] = cfg.LEVELS, where: str = "TRUE") -> str:
    parts = [
        f"SELECT '{lv}' AS level, {_LEVEL[lv][0]} AS entity, {_LEVEL[lv][1]} AS channel, ds, "
        f"sum(revenue) AS revenue, sum(spend) AS spend FROM ads WHERE {where} GROUP BY {_LEVEL[lv][2]}ds"
        for lv in levels
    ]
    return "totals AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def series(levels: Sequence[str] = cfg.LEVELS, min_nonzero: int = cfg.MIN_NONZERO_DAYS,
           where: str = "TRUE") -> str:
    """ads, totals, bounds, calendar and series."""
    return f"""{ADS},
{totals(levels, where)},
bounds AS (
  SELECT level, entity, min(channel) AS channel, min(ds) AS lo, max(ds) AS hi,
         count(*) FILTER (WHERE revenue > 0) AS nz FROM totals GROUP BY level, entity),
calendar AS (
  SELECT level, entity, channel, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP),
         CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds
  FROM bounds WHERE level IN ('aggregate', 'channel') OR nz >= {min_nonzero}),
series AS (
  SELECT c.level, c.entity, c.channel, c.ds, coalesce(t.revenue, 0) AS revenue,
         coalesce(t.spend, 0) AS spend
  FROM calendar c LEFT JOIN totals t
    ON c.level = t.level AND c.entity = t.entity AND c.ds = t.ds)"""


def event_table(events: Sequence[Event]) -> str:
    """Every day of every event window with the labels of all events on it."""
    values = ", ".join(f"('{name}', DATE '{day}', {low}, {high})" for name, day, low, high in events)
    low, high = min(e[2] for e in events), max(e[3] for e in events)
    return f"""promo AS (
  SELECT ds, string_agg(label, '|' ORDER BY label) AS event FROM (
    SELECT DISTINCT CAST(day + CAST(o AS INTEGER) AS DATE) AS ds, name || printf('%+d', o) AS label
    FROM (VALUES {values}) AS e(name, day, low, high), range({low}, {high + 1}) AS r(o) WHERE o BETWEEN low AND high)
  GROUP BY ds)"""


def normal_quantile(width: float) -> str:
    """What leaves ``width`` of a standard normal between minus and plus itself."""
    return f"CAST({NormalDist().inv_cdf(0.5 + width / 2)!r} AS DOUBLE)"


def rolling(keys: str = "level, entity", source: str = "series",
            horizons: Sequence[int] = cfg.HORIZONS) -> str:
    sums = ", ".join(
        f"CASE WHEN row_number() OVER (PARTITION BY {keys} ORDER BY ds) >= {h // 2} THEN "
        f"sum({c}) OVER (PARTITION BY {keys} ORDER BY ds ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) "
        f"END AS {c}_{h}d" for h in horizons for c in ("revenue", "spend"))
    return f"rolling AS (SELECT *, {sums} FROM {source})"


def guards(keys: str = "level, entity", horizons: Sequence[int] = cfg.HORIZONS) -> str:
    """One row per slice and window: floor and coefficient of variation."""
    parts = []
    for h in horizons:
        ratio = f"(CAST(revenue_{h}d AS DOUBLE) / nullif(CAST(spend_{h}d AS DOUBLE), 0))"
        parts.append(
            f"SELECT {keys}, {h} AS window_days, "
            f"greatest(quantile_cont(CAST(revenue_{h}d AS DOUBLE), 0.1), "
            f"CAST(sum(revenue) AS DOUBLE) / count(*) * {h} * CAST(0.05 AS DOUBLE)) AS revenue_floor, "
            f"CASE WHEN count({ratio}) > 1 THEN stddev_samp({ratio}) / "
            f"greatest(avg({ratio}), CAST(1e-6 AS DOUBLE)) ELSE CAST(0.3 AS DOUBLE) END AS roas_cv "
            f"FROM rolling GROUP BY {keys}")
    return "guards AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def slices(keys: str = "level, entity", source: str = "series",
           min_days: int = cfg.MIN_CALENDAR_DAYS, min_nonzero: int = cfg.MIN_NONZERO_DAYS) -> str:
    return f"""slices AS (
  SELECT {keys}, min(channel) AS channel, min(ds) AS first_ds, max(ds) AS last_ds, count(*) AS n_days,
         count(*) FILTER (WHERE revenue > 0) AS nonzero_days,
         CAST(sum(revenue) AS DOUBLE) AS total_revenue, CAST(sum(spend) AS DOUBLE) AS total_spend,
         CAST(sum(revenue) AS DOUBLE) / count(*) AS average_revenue,
         CAST(sum(spend) AS DOUBLE) / count(*) AS average_spend,
         level = 'aggregate' OR (count(*) >= {min_days}
           AND count(*) FILTER (WHERE revenue > 0) >= {min_nonzero}) AS eligible
  FROM {source} GROUP BY {keys}),
recent_days AS (
  SELECT {keys}, CAST(sum(revenue) AS DOUBLE) AS trailing_revenue,
         CAST(sum(spend) AS DOUBLE) AS trailing_spend, min(ds) AS trailing_start, max(ds) AS trailing_end
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ds DESC) AS back FROM {source})
  WHERE back <= {cfg.TRAILING_DAYS} GROUP BY {keys})"""


def fit(events: Sequence[Event], keys: str = "level, entity", source: str = "series",
        kappa: float = cfg.ModelSettings.shrinkage) -> str:
    """The staged model as chained group means; ends with ``coef`` (one row per slice)."""
    k = keys
    shrink = f"(count(*) + CAST({kappa} AS DOUBLE))"
    return f"""{event_table(events)},
d0 AS (
  SELECT s.*, p.event, ln(1 + CAST(s.revenue AS DOUBLE)) AS y, ln(1 + CAST(s.spend AS DOUBLE)) AS x,
         dayofweek(s.ds) + 1 AS dow, month(s.ds) AS moy
  FROM {source} s LEFT JOIN promo p ON s.ds = p.ds),
first_day AS (SELECT {k}, min(ds) AS first_ds FROM d0 GROUP BY {k}),
d1 AS (SELECT d0.*, CAST(date_diff('day', first_ds, ds) AS DOUBLE) AS t FROM d0 JOIN first_day USING ({k})),
trend AS (
  SELECT {k}, coalesce(regr_slope(y, t), 0) AS y_slope, coalesce(regr_slope(x, t), 0) AS x_slope,
         avg(y) - coalesce(regr_slope(y, t), 0) * avg(t) AS y_base,
         avg(x) - coalesce(regr_slope(x, t), 0) * avg(t) AS x_base FROM d1 GROUP BY {k}),
r1 AS (SELECT d1.*, y - (y_base + y_slope * t) AS y1, x - (x_base + x_slope * t) AS x1
       FROM d1 JOIN trend USING ({k})),
dows AS (SELECT {k}, dow, avg(y1) AS y_dow, avg(x1) AS x_dow FROM r1 GROUP BY {k}, dow),
r2 AS (SELECT r1.*, y1 - y_dow AS y2, x1 - x_dow AS x2 FROM r1 JOIN dows USING ({k}, dow)),
moys AS (SELECT {k}, moy, sum(y2) / {shrink} AS y_moy, sum(x2) / {shrink} AS x_moy FROM r2 GROUP BY {k}, moy),
r3 AS (SELECT r2.*, y2 - y_moy AS y3, x2 - x_moy AS x3 FROM r2 JOIN moys USING ({k}, moy)),
evs AS (SELECT {k}, event, sum(y3) / {shrink} AS y_event, sum(x3) / {shrink} AS x_event
        FROM r3 WHERE event IS NOT NULL GROUP BY {k}, event),
r4 AS (SELECT r3.*, y3 - coalesce(y_event, 0) AS y4, x3 - coalesce(x_event, 0) AS x4
       FROM r3 LEFT JOIN evs USING ({k}, event)),
slope AS (SELECT {k}, stddev_samp(x4) AS x_sigma,
                 CASE WHEN stddev_samp(x4) > 1e-9 THEN regr_slope(y4, x4) ELSE 0 END AS beta
          FROM r4 GROUP BY {k}),
coef AS (SELECT {k}, any_value(x_sigma) AS x_sigma, any_value(beta) AS beta,
                stddev_samp(y4 - beta * x4) AS y_sigma, stddev_samp(y4) AS stages_sigma FROM r4 JOIN slope USING ({k}) GROUP BY {k})"""


def least_squares(keys: str = "level, entity", source: str = "series") -> str:
    """Closed least squares of scaled log revenue on level, slope and log spend, and of scaled log spend on level and slope."""
    k = keys
    det = "(var_pop(u) * var_pop(s) - covar_pop(u, s) * covar_pop(u, s))"
    slope = f"(covar_pop(y, u) * var_pop(s) - covar_pop(y, s) * covar_pop(u, s)) / {det}"
    spend = f"(covar_pop(y, s) * var_pop(u) - covar_pop(y, u) * covar_pop(u, s)) / {det}"
    return f"""logs AS (SELECT {k}, ds, ln(1 + CAST(revenue AS DOUBLE)) AS y, ln(1 + CAST(spend AS DOUBLE)) AS x FROM {source}),
scales AS (
  SELECT {k}, min(ds) AS lo, max(ds) AS hi, greatest(date_diff('day', min(ds), max(ds)), 1) AS span, avg(x) AS x_mean,
         CASE WHEN max(y) > 0 THEN max(y) ELSE 1 END AS y_scale, CASE WHEN max(x) > 0 THEN max(x) ELSE 1 END AS x_scale,
         CASE WHEN stddev_samp(x) > 0 THEN stddev_samp(x) ELSE 1 END AS x_sd FROM logs GROUP BY {k}),
scaled AS (
  SELECT {k}, y / y_scale AS y, x / x_scale AS z, CAST(date_diff('day', lo, ds) AS DOUBLE) / span AS u, (x - x_mean) / x_sd AS s
  FROM logs JOIN scales USING ({k})),
least AS (
  SELECT *, my - slope * mu - log_spend * ms AS base, mz - z_slope * mu AS z_base,
         sqrt(vy - slope * cyu - log_spend * cys) AS sigma, sqrt(vz - z_slope * czu) AS z_sigma
  FROM (SELECT {k}, {slope} AS slope, {spend} AS log_spend, regr_slope(z, u) AS z_slope, avg(y) AS my, avg(u) AS mu, avg(s) AS ms,
               avg(z) AS mz, var_pop(y) AS vy, covar_pop(y, u) AS cyu, covar_pop(y, s) AS cys, var_pop(z) AS vz,
               covar_pop(z, u) AS czu FROM scaled GROUP BY {k}))"""


def least_future(keys: str = "level, entity", horizon: int = max(cfg.HORIZONS), budget: str = "", spend: str = "average_spend") -> str:
    """Daily predictions of ``least_squares`` in the shape of ``future``."""
    z, u = normal_quantile(0.8), "CAST(date_diff('day', lo, last_ds) + h AS DOUBLE) / span"
    return f"""predicted AS (
  SELECT {keys}, h, (base + slope * {u} + log_spend * (ln(1 + CAST({spend} AS DOUBLE)) - x_mean) / x_sd) * y_scale AS revenue_yhat,
         (z_base + z_slope * {u}) * x_scale AS spend_yhat, {z} * sigma * y_scale AS y_half, {z} * z_sigma * x_scale AS x_half
  FROM slices JOIN least USING ({keys}) JOIN scales USING ({keys}) {budget} CROSS JOIN range(1, {horizon + 1}) AS days(h) WHERE eligible)"""


def future(keys: str = "level, entity", horizon: int = max(cfg.HORIZONS),
           width: float = 0.80, budget: str = "", spend: str = "average_spend", with_spend: bool = True) -> str:
    """Daily predictions; ``budget`` is an extra join that may provide the ``spend`` expression."""
    k = keys
    beta, sigma = ("beta", "y_sigma") if with_spend else ("0", "stages_sigma")
    z = normal_quantile(width)
    return f"""future AS (
  SELECT {k}, h, first_ds, last_ds, CAST(last_ds + CAST(h AS INTEGER) AS DATE) AS ds, ln(1 + CAST({spend} AS DOUBLE)) AS x_future
  FROM slices {budget} CROSS JOIN range(1, {horizon + 1}) AS days(h) WHERE eligible),
daily AS (
  SELECT f.*, beta, y_sigma, stages_sigma, x_sigma, y_slope, x_slope,
         y_base + y_slope * date_diff('day', first_ds, ds) + coalesce(y_dow, 0) + coalesce(y_moy, 0)
           + coalesce(y_event, 0) AS y_stages,
         x_base + x_slope * date_diff('day', first_ds, ds) + coalesce(x_dow, 0) + coalesce(x_moy, 0)
           + coalesce(x_event, 0) AS x_stages
  FROM (SELECT f.*, p.event, dayofweek(f.ds) + 1 AS dow, month(f.ds) AS moy
        FROM future f LEFT JOIN promo p ON f.ds = p.ds) f
  JOIN trend USING ({k}) JOIN coef USING ({k})
  LEFT JOIN dows USING ({k}, dow) LEFT JOIN moys USING ({k}, moy) LEFT JOIN evs USING ({k}, event)),
predicted AS (
  SELECT *, y_stages + {beta} * (x_future - x_stages) AS revenue_yhat, x_stages AS spend_yhat,
         {z} * coalesce({sigma}, 0) AS y_half, {z} * coalesce(x_sigma, 0) AS x_half FROM daily)"""


def normal_draw(name: str) -> str:
    """A standard normal made of the md5 of name, day h and draw i."""
    def uniform(part: str) -> str:
        return (f"((CAST('0x' || substr(md5('{name}{part}:' || h || ':' || i), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) "
                f"/ CAST({16**13} AS DOUBLE))")
    return f"sqrt(-2 * ln({uniform('/r')})) * cos(2 * pi() * {uniform('/a')})"


def draws(settings: cfg.ModelSettings, horizon: int = max(cfg.HORIZONS)) -> str:
    """Every draw of every future day as a row."""
    columns = []
    for m in ("revenue", "spend"):
        u = f"((CAST('0x' || substr(md5('{m}-{{}}{settings.seed}:' || h || ':' || i), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {16**13}::DOUBLE)"
        v = f"({u.format('size')} - 0.5)"
        columns += [f"{normal_draw(f'{m}-noise{settings.seed}')} AS {m}_noise", f"{u.format('bend')} AS {m}_bend",
                    f"-sign({v}) * ln(1 - 2 * abs({v})) AS {m}_size"]
    return (f"draws AS (SELECT h, i, {', '.join(columns)} FROM range(1, {horizon + 1}) AS a(h), "
            f"range(1, {settings.uncertainty_samples + 1}) AS b(i))")


def daily_quantiles(settings: cfg.ModelSettings) -> str:
    """``sampled``: predicted days whose distances to the bands come from the draws of the day."""
    tail = (1 - settings.interval_width) / 2
    cuts = ", ".join(f"quantile_cont({m}_noise, {share!r}) AS {m}_{b}_noise" for m in ("revenue", "spend")
                     for b, share in (("lower", tail), ("upper", 1 - tail)))
    return f"""{draws(settings)},
cuts AS (SELECT h, {cuts} FROM draws GROUP BY h),
sampled AS (
  SELECT p.*, -coalesce(y_sigma, 0) * revenue_lower_noise AS y_low, coalesce(y_sigma, 0) * revenue_upper_noise AS y_high,
         -coalesce(x_sigma, 0) * spend_lower_noise AS x_low, coalesce(x_sigma, 0) * spend_upper_noise AS x_high
  FROM predicted p JOIN cuts USING (h))"""


def paths(settings: cfg.ModelSettings, keys: str = "level, entity", horizons: Sequence[int] = cfg.HORIZONS) -> str:
    """``path_bounds``: quantiles over draws of their sums over a window, with simulated trend changes."""
    k, tail = keys, (1 - settings.interval_width) / 2
    rate = f"{float(settings.trend_changes)!r}::DOUBLE / n_days"
    spans = ", ".join(f"({h})" for h in horizons)
    cuts = ", ".join(f"quantile_cont({m}, {share!r}) AS {m}_{b}0" for m in ("revenue", "spend")
                     for b, share in (("lower", tail), ("upper", 1 - tail)))
    run = f"OVER (PARTITION BY {k}, i ORDER BY h)"
    return f"""{draws(settings, max(horizons))},
changes AS (
  SELECT {k}, h, i, revenue_yhat + coalesce(y_sigma, 0) * revenue_noise AS y, spend_yhat + coalesce(x_sigma, 0) * spend_noise AS x,
         sum(CASE WHEN revenue_bend < {rate} THEN abs(y_slope) * revenue_size ELSE 0 END) {run} AS y_change,
         sum(CASE WHEN spend_bend < {rate} THEN abs(x_slope) * spend_size ELSE 0 END) {run} AS x_change
  FROM predicted JOIN slices USING ({k}) JOIN draws USING (h)),
moved AS (SELECT {k}, h, i, y + sum(y_change) {run} AS y, x + sum(x_change) {run} AS x FROM changes),
path_sums AS (
  SELECT {k}, window_days, i, sum(exp(greatest(y, 0)) - 1) AS revenue, sum(exp(greatest(x, 0)) - 1) AS spend
  FROM moved JOIN (VALUES {spans}) AS s(window_days) ON h <= window_days GROUP BY {k}, window_days, i),
path_bounds AS (SELECT {k}, window_days, {cuts} FROM path_sums GROUP BY {k}, window_days)"""


def windows(keys: str = "level, entity", floor: bool = True, budget: str = "",
            planned: str = "NULL", horizons: Sequence[int] = cfg.HORIZONS, source: str = "predicted",
            bands: Sequence[str] = ("y_half", "y_half", "x_half", "x_half"), path: bool = False) -> str:
    """Sums per window; ``planned`` is the total planned spend of a window, or NULL; ``bands`` are the distances to the
    daily bounds, unless the bounds come from ``path_bounds``."""
    k = keys
    low = "greatest(revenue_lower0, revenue_floor)" if floor else "revenue_lower0"

    def total(e: str) -> str:
        return f"sum(exp(greatest({e}, 0)) - 1)"

    spans = ", ".join(f"({h})" for h in horizons)
    y_low, y_high, x_low, x_high = bands
    bounds = "" if path else f""",
         {total(f'revenue_yhat - {y_low}')} AS revenue_lower0, {total(f'revenue_yhat + {y_high}')} AS revenue_upper0,
         {total(f'spend_yhat - {x_low}')} AS spend_lower0, {total(f'spend_yhat + {x_high}')} AS spend_upper0"""
    more = f"JOIN path_bounds USING ({k}, window_days)" if path else ""
    return f"""spans(window_days) AS (VALUES {spans}),
summed AS (
  SELECT {k}, window_days, {total('revenue_yhat')} AS revenue_point, {total('spend_yhat')} AS spend0{bounds}
  FROM {source} JOIN spans ON h <= window_days GROUP BY {k}, window_days),
guarded AS (
  SELECT s.* EXCLUDE (spend0), {low} AS revenue_lower, greatest(revenue_upper0, revenue_point, {low}) AS revenue_upper,
         coalesce({planned}, spend0) AS spend_point,
         coalesce({planned}, spend_lower0) AS spend_lower,
         coalesce({planned}, greatest(spend_upper0, spend0, spend_lower0)) AS spend_upper,
         roas_cv
  FROM (SELECT * FROM summed {more}) s JOIN guards USING ({k}, window_days) {budget}),
forecasts AS (
  SELECT * EXCLUDE (revenue_lower0, revenue_upper0, spend_lower0, spend_upper0),
         revenue_point / greatest(spend_point, 1) AS roas_point,
         greatest(revenue_point / greatest(spend_point, 1) * (1 - roas_cv), CAST(0.1 AS DOUBLE)) AS roas_lower,
         revenue_point / greatest(spend_point, 1) * (1 + roas_cv) AS roas_upper
  FROM guarded)"""


def forecasts(events: Sequence[Event], levels: Sequence[str] = cfg.LEVELS,
              min_days: int = cfg.MIN_CALENDAR_DAYS, min_nonzero: int = cfg.MIN_NONZERO_DAYS,
              budget_values: str = "", settings: cfg.ModelSettings = cfg.ModelSettings(),
              interval: str = "analytic") -> str:
    """Everything from the base tables to ``forecasts``; ``budget_values`` are (entity, budget) rows."""
    head = f"budgets(entity, budget) AS (VALUES {budget_values})," if budget_values else ""
    join = "LEFT JOIN budgets USING (entity)" if budget_values else ""
    spend = "coalesce(budget, average_spend)" if budget_values else "average_spend"
    planned = "budget * window_days" if budget_values else "NULL"
    return ",\n".join([
        head + series(levels), rolling(), guards(), slices(min_days=min_days, min_nonzero=min_nonzero),
        fit(events), future(budget=join, spend=spend, with_spend=settings.use_spend_regressor),
        *({"sum": [daily_quantiles(settings)], "path": [paths(settings)]}.get(interval, [])),
        windows(budget=join, planned=planned, path=interval == "path",
                **({"source": "sampled", "bands": ("y_low", "y_high", "x_low", "x_high")} if interval == "sum" else {}))])


def scored(keys: str = "level, entity", lookback: int = 3000) -> str:
    """Series with z-scores, weekly changes and the lookback flag."""
    def frame(n: int) -> str:
        return f"OVER (PARTITION BY {keys} ORDER BY ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    w = f"OVER (PARTITION BY {keys} ORDER BY ds)"

    def z(c: str) -> str:
        return (f"CASE WHEN count({c}) {frame(14)} >= 7 AND stddev_samp({c}) {frame(14)} > 0 "
                f"THEN ({c} - avg({c}) {frame(14)}) / stddev_samp({c}) {frame(14)} END")

    def change(c: str) -> str:
        return (f"CASE WHEN lag({c}, 7) {w} = 0 AND {c} > 0 THEN CAST('inf' AS DOUBLE) "
                f"ELSE CAST({c} AS DOUBLE) / nullif(CAST(lag({c}, 7) {w} AS DOUBLE), 0) - 1 END")

    return f"""weekly AS (
  SELECT *, CAST(revenue AS DOUBLE) AS rev, CAST(revenue AS DOUBLE) / nullif(CAST(spend AS DOUBLE), 0) AS roas,
         coalesce(CAST(revenue AS DOUBLE) / nullif(CAST(spend AS DOUBLE), 0), 0) AS roas0,
         CASE WHEN count(*) {frame(7)} >= 4 THEN sum(revenue) {frame(7)} END AS rev7,
         CASE WHEN count(*) {frame(7)} >= 4 THEN sum(spend) {frame(7)} END AS spend7
  FROM series),
scored AS (
  SELECT *, {z('rev')} AS revenue_z, {z('roas0')} AS roas_z,
         CASE WHEN count(*) {frame(14)} >= 14 THEN avg(rev) {frame(14)} END AS mean14,
         {change('rev7')} AS revenue_wow, {change('spend7')} AS spend_wow,
         ds >= max(ds) OVER (PARTITION BY {keys}) - {lookback} AS recent
  FROM weekly)"""


def anomalies(everywhere: bool = False, z_threshold: float = 2.5) -> str:
    account = "TRUE" if everywhere else "level = 'aggregate'"
    scope = "CASE WHEN level = 'aggregate' THEN 'aggregate' ELSE entity END AS scope"
    title = "upper(left(entity, 1)) || lower(substr(entity, 2))"
    way = "CASE WHEN revenue_z > 0 THEN 'spike' ELSE 'drop' END"
    share = "CASE WHEN isinf(spend_wow) THEN 'inf%' ELSE printf('%.0f%%', spend_wow * 100) END"
    money = "printf('%.0f', CAST({} AS DOUBLE))"
    rev, spd = money.format("revenue"), money.format("spend")
    off = "printf('%.0f', CAST(abs(revenue - mean14) AS DOUBLE))"
    return f"""anomalies AS (
  SELECT ds, 'revenue_' || {way} AS type, {scope}, abs(revenue_z) AS magnitude, 'sigma' AS magnitude_unit,
         CASE WHEN abs(revenue_z) > 4 THEN 'high' ELSE 'medium' END AS severity,
         CASE WHEN level = 'aggregate' THEN
           'Revenue ' || {way} || ' of ' || coalesce({off}, 'nan') || ' USD ('
             || printf('%.1f', abs(revenue_z)) || 'σ from 14-day rolling mean).'
         ELSE {title} || ' revenue ' || {way} || ' (' || printf('%.1f', abs(revenue_z))
             || 'σ). Revenue: $' || {rev} || ', spend: $' || {spd} || '.' END AS description
  FROM scored WHERE recent AND abs(revenue_z) >= {z_threshold}
  UNION ALL
  SELECT ds, 'roas_collapse', {scope}, abs(roas_z), 'sigma',
         CASE WHEN roas_z < -4 THEN 'high' ELSE 'medium' END,
         'ROAS dropped to ' || coalesce(printf('%.2f', roas), 'nan') || 'x (' || printf('%.1f', abs(roas_z))
           || 'σ below 14-day mean). Spend was $' || {spd} || ', revenue $' || {rev} || '.'
  FROM scored WHERE recent AND {account} AND roas_z <= -{z_threshold}
  UNION ALL
  SELECT ds, 'spend_revenue_decoupling', {scope}, abs(revenue_wow), 'fraction', 'high',
         'Spend rose ' || {share} || ' WoW but revenue fell ' || printf('%.0f%%', abs(revenue_wow) * 100)
           || ' WoW. Potential audience saturation or tracking issue.'
  FROM scored WHERE recent AND {account} AND spend_wow >= 0.20 AND revenue_wow <= -0.10)"""
