"""Lags, fills, recurrences and splits over series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.functions import physics
from voltfleet.operators import imputation, ordered
from voltfleet.operators.series import forward_fill, lay_out, row_numbers
from voltfleet.operators.validation import accept, decode, fill_defaults
from voltfleet.plans.inputs import JUDGED_SQL, MESSAGES_SQL, T_SQL, Inputs
from voltfleet.plans.registry import query

W = f"WITH {T_SQL}"
SITE_ASSET = ["site_id", "asset_id"]


def _series(i: Inputs, keys, *columns: str):
    return lay_out(i.t().selectExpr("site_id", "asset_id", "seq", *columns), keys, ["seq"], i.series_rows)


_LAGS = f"""{W}, n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY site_id, asset_id) AS n,
    first_value(power_kw) OVER w AS head, lag(power_kw, 1) OVER w AS l1, lag(power_kw, 2) OVER w AS l2,
    avg(power_kw) OVER (PARTITION BY site_id, asset_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS roll
  FROM t WINDOW w AS (PARTITION BY site_id, asset_id ORDER BY seq))"""


@query(
    "lag_features",
    f"""{_LAGS} SELECT site_id, asset_id, seq, coalesce(l1, CASE WHEN n > 1 THEN head END, 0) AS lag_1,
      coalesce(l2, CASE WHEN n > 2 THEN head END, 0) AS lag_2 FROM n""",
)
def lag_features(i: Inputs) -> DataFrame:
    out = ordered.lag_features(_series(i, SITE_ASSET, "power_kw"), ["power_kw"]).rows()
    return out.select(
        "site_id", "asset_id", "seq", F.col("power_kw_lag_1h").alias("lag_1"), F.col("power_kw_lag_2h").alias("lag_2")
    )


@query(
    "rolling_mean",
    f"{_LAGS} SELECT site_id, asset_id, seq, round(coalesce(roll, CASE WHEN n > 1 THEN head END, 0), 6) AS roll_4 FROM n",
)
def rolling_mean(i: Inputs) -> DataFrame:
    out = ordered.lag_features(_series(i, SITE_ASSET, "power_kw"), ["power_kw"]).rows()
    return out.select("site_id", "asset_id", "seq", F.round("power_kw_roll_4h", 6).alias("roll_4"))


_GAPPY = "CASE WHEN k >= 30 THEN power_kw END AS x"


@query(
    "ffill",
    f"""{W} SELECT asset_id, seq, last_value(CASE WHEN k >= 30 THEN power_kw END IGNORE NULLS) OVER (
      PARTITION BY asset_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM t""",
    split=True,
)
def ffill(i: Inputs) -> DataFrame:
    return forward_fill(_series(i, ["asset_id"], _GAPPY), {"filled": "x"}).rows().select("asset_id", "seq", "filled")


@query(
    "fill_chain",
    f"""{W}, g AS (SELECT *, CASE WHEN k >= 30 THEN power_kw END AS x FROM t)
    SELECT site_id, asset_id, seq, coalesce(
      last_value(x IGNORE NULLS) OVER (PARTITION BY site_id, asset_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(x IGNORE NULLS) OVER (PARTITION BY site_id, asset_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      0) AS x FROM g""",
)
def fill_chain(i: Inputs) -> DataFrame:
    return ordered.fill_chain(_series(i, SITE_ASSET, _GAPPY), ["x"]).rows()


@query(
    "impute_isolated",
    f"""{W}, n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seq) AS rn FROM t),
    g AS (SELECT *, CASE WHEN rn % 5 > 0 THEN power_kw END AS x FROM n)
    SELECT asset_id, seq, coalesce(x, round(avg(x) OVER (PARTITION BY asset_id ORDER BY seq
      ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 3)) AS imputed FROM g""",
    split=True,
)
def impute_isolated(i: Inputs) -> DataFrame:
    """Every fifth reading of an asset is lost."""
    numbered = row_numbers(_series(i, ["asset_id"], "power_kw"), "rn")
    gappy = numbered.on(numbered.df.withColumn("x", F.when(F.col("rn") % 5 > 0, F.col("power_kw"))))
    return imputation.impute_isolated(gappy, "x", "imputed").rows().select("asset_id", "seq", "imputed")


SITE_TOPIC = ["site_id", "topic"]

IMPUTED_SQL = f"""WITH RECURSIVE {T_SQL}, {MESSAGES_SQL}, {JUDGED_SQL},
a AS (
  SELECT *, row_number() OVER (PARTITION BY site_id, topic ORDER BY seq) AS rn FROM (
    SELECT *, ok AND seq >= coalesce(min(CASE WHEN ok AND complete THEN seq END) OVER (PARTITION BY site_id, topic), 9e18) AS accepted
    FROM j) WHERE accepted
),
f AS (
  SELECT site_id, topic, seq, rn, {', '.join(f'v{n}, NULL::DOUBLE AS a{n}, NULL::DOUBLE AS b{n}' for n in range(5))}
  FROM a WHERE rn = 1
  UNION ALL
  SELECT a.site_id, a.topic, a.seq, a.rn, {', '.join(
      f"CASE WHEN a.v{n} IS NOT NULL OR {n} >= CASE a.topic WHEN 'battery' THEN 5 ELSE 3 END THEN a.v{n}"
      f" WHEN f.a{n} IS NULL THEN round(f.v{n}, 3) WHEN f.b{n} IS NULL THEN round((f.v{n} + f.a{n}) / 2, 3)"
      f" ELSE round((f.b{n} + f.a{n} + f.v{n}) / 3, 3) END, f.v{n}, f.a{n}" for n in range(5))}
  FROM f JOIN a ON a.site_id = f.site_id AND a.topic = f.topic AND a.rn = f.rn + 1
)"""


def accepted_series(i: Inputs, keys):
    sent = i.messages()
    rows = fill_defaults(decode(sent)).drop("payload")
    judged = accept(lay_out(rows, keys, ["seq"], i.series_rows, counted=sent))
    return judged.on(judged.df.filter("accepted").drop("reasons", "bad_fields", "accepted"))


@query("impute_recursive", f"{IMPUTED_SQL} SELECT site_id, topic, seq, v0, v1, v2, v3, v4 FROM f")
def impute_recursive(i: Inputs) -> DataFrame:
    filled = imputation.impute(accepted_series(i, SITE_TOPIC)).rows()
    return filled.select("site_id", "topic", "seq", *S.SLOTS)


@query(
    "chrono_split",
    f"""{W}, n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY site_id) AS n FROM t)
    SELECT site_id, seq, CASE WHEN floor(n * 0.8e0) >= n THEN 'both' WHEN rn <= floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS part FROM n""",
)
def chrono_split(i: Inputs) -> DataFrame:
    return ordered.chrono_split(_series(i, ["site_id"])).rows().select("site_id", "seq", "part")


@query(
    "ewma",
    f"""WITH RECURSIVE {T_SQL}, n AS (
      SELECT site_id, seq, row_number() OVER (PARTITION BY site_id ORDER BY seq) AS rn,
        CASE WHEN v >= 25 THEN 0.8e0 WHEN v >= 12 THEN 1.8e0 ELSE 1 + v / 12 * 0.5e0 END AS x
      FROM (SELECT *, sqrt(power_kw) * 1.5e0 AS v FROM t)),
    r AS (
      SELECT site_id, seq, rn, 0.95e0 * 1 + 0.05e0 * x AS v FROM n WHERE rn = 1
      UNION ALL
      SELECT n.site_id, n.seq, n.rn, 0.95e0 * r.v + 0.05e0 * n.x FROM r JOIN n ON n.site_id = r.site_id AND n.rn = r.rn + 1)
    SELECT site_id, seq, round(v, 9) AS wear FROM r""",
    split=True,
)
def ewma(i: Inputs) -> DataFrame:
    """Wear index of the turbine from wind speed."""
    t = i.t().select("site_id", "seq", physics.vibration_target(F.sqrt("power_kw") * 1.5).alias("x"))
    out = ordered.smoothed(lay_out(t, ["site_id"], ["seq"], i.series_rows), "x", "wear").rows()
    return out.select("site_id", "seq", F.round("wear", 9).alias("wear"))


@query(
    "soc_replay",
    f"""WITH RECURSIVE {T_SQL}, n AS (
      SELECT site_id, seq, row_number() OVER (PARTITION BY site_id ORDER BY seq) AS rn,
        CASE WHEN p > 0 THEN least(abs(p), 500) * 0.95e0 ELSE -least(abs(p), 500) / 0.95e0 END AS d
      FROM (SELECT site_id, seq, (power_kw - 40) * 4 AS p FROM t)),
    r AS (
      SELECT site_id, seq, rn, least(1800, greatest(200, 1000 + d)) AS v FROM n WHERE rn = 1
      UNION ALL
      SELECT n.site_id, n.seq, n.rn, least(1800, greatest(200, r.v + n.d)) FROM r JOIN n ON n.site_id = r.site_id AND n.rn = r.rn + 1)
    SELECT site_id, seq, round(v, 6) AS level_kwh FROM r""",
    split=True,
)
def soc_replay(i: Inputs) -> DataFrame:
    t = i.t().select("site_id", "seq", ordered.energy_delta((F.col("power_kw") - 40) * 4).alias("delta"))
    out = ordered.storage_level(lay_out(t, ["site_id"], ["seq"], i.series_rows), "delta", "level_kwh").rows()
    return out.select("site_id", "seq", F.round("level_kwh", 6).alias("level_kwh"))
