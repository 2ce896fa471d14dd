"""Minimum-cost battery schedules, one dynamic program per forecast run.

The hours of a run fit one row with arrays; Spark spreads the runs and each
task solves a batch of them at once in numpy, and hands its hours on with it. The
stored energy moves on a grid of levels. Since selling pays less than buying
costs and every price is positive, the cost is convex in the path of levels:
grids of ever smaller step around the best path so far lead to the optimum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltfleet import schemas as S
from voltfleet.functions import flows
from voltfleet.functions.timeparts import minute_label
from voltfleet.session import ship_package

_NEAR = np.arange(-3, 4)


@dataclass(frozen=True)
class Battery:
    low: float = S.BATTERY_MIN_FRACTION * S.BATTERY_KWH
    high: float = S.BATTERY_MAX_FRACTION * S.BATTERY_KWH
    rate: float = S.BATTERY_KW
    efficiency: float = S.BATTERY_EFF
    sell_ratio: float = S.SELL_RATIO
    step: float = 100.0
    finest: float = 0.01

    def cost(self, change, net_load, price):
        """Cost of one hour in which the stored energy moves by ``change``; infinite beyond the rate limits."""
        charge = np.maximum(change, 0.0) / self.efficiency
        discharge = np.maximum(-change, 0.0) * self.efficiency
        grid = net_load + charge - discharge
        cost = np.where(grid > 0, grid, self.sell_ratio * grid) * price
        allowed = np.maximum(charge, discharge) <= self.rate + 1e-9
        return np.where(allowed, cost, np.inf)

    def best_path(self, start, levels, net_load, price):
        """Cheapest walk through ``levels[run, hour, option]`` from ``start[run]``.

        Of equally cheap walks the one with the smaller moves is taken. Returns
        the path and its cost, which is infinite where no walk is allowed.
        """
        runs, hours, options = levels.shape
        ahead = np.zeros((runs, options))
        choices = np.zeros((hours, runs, options), dtype=np.int32)
        for t in range(hours - 1, 0, -1):
            change = levels[:, t, None, :] - levels[:, t - 1, :, None]
            total = self.cost(change, net_load[:, t, None, None], price[:, t, None, None]) + ahead[:, None, :]
            choices[t], ahead = self._cheapest(total, np.abs(change))
        change = levels[:, 0, :] - start[:, None]
        total = self.cost(change, net_load[:, 0, None], price[:, 0, None]) + ahead
        pick, best = self._cheapest(total, np.abs(change))
        path = np.empty((runs, hours))
        each = np.arange(runs)
        for t in range(hours):
            if t:
                pick = choices[t, each, pick]
            path[:, t] = levels[each, t, pick]
        return path, best

    @staticmethod
    def _cheapest(total, moved):
        best = total.min(axis=-1)
        close = total <= best[..., None] + 1e-7
        return np.where(close, moved, np.inf).argmin(axis=-1), best

    def grid_path(self, start, net_load, price):
        """Cheapest walk on the even grid of levels; all levels share the cost of a move."""
        runs, hours = net_load.shape
        count = round((self.high - self.low) / self.step) + 1
        levels = self.low + self.step * np.arange(count)
        down = math.floor(self.rate / self.efficiency / self.step + 1e-9)
        up = math.floor(self.rate * self.efficiency / self.step + 1e-9)
        # Small moves first: the first of equally cheap ones is taken.
        moves = np.array(sorted(range(-down, up + 1), key=abs))
        target = np.arange(count)[:, None] + moves
        target = np.where((target >= 0) & (target < count), target, count)  # the last column costs infinity
        move_cost = self.cost(moves * self.step, net_load[:, :, None], price[:, :, None])
        ahead = np.zeros((runs, count + 1))
        ahead[:, count] = np.inf
        choices = np.zeros((hours, runs, count), dtype=np.int32)
        for t in range(hours - 1, 0, -1):
            total = ahead[:, target]
            total += move_cost[:, t, None, :]
            pick = total.argmin(axis=-1)
            choices[t] = target[np.arange(count), pick]
            ahead[:, :count] = np.take_along_axis(total, pick[:, :, None], axis=-1)[:, :, 0]
        change = levels - start[:, None]
        first = self.cost(change, net_load[:, :1], price[:, :1]) + ahead[:, :count]
        pick, best = self._cheapest(first, np.abs(change))
        path, each = np.empty((runs, hours)), np.arange(runs)
        for t in range(hours):
            if t:
                pick = choices[t, each, pick]
            path[:, t] = levels[pick]
        return path, best

    def solve(self, start, net_load, price, refine: bool = True):
        path, cost = self.grid_path(start, net_load, price)
        step = self.step
        while refine and step > self.finest:
            step /= 2
            gain = np.inf
            while gain > 1e-6:
                around = np.clip(path[:, :, None] + _NEAR * step, self.low, self.high)
                path, better = self.best_path(start, around, net_load, price)
                gain = np.max(np.where(np.isfinite(cost), cost - better, 0.0), initial=0.0)
                cost = better
        return path, cost


    def bound(self, start, net_load, price):
        """What no schedule of these runs can cost less than.

        With a price ``x[t]`` on the energy stored after hour t, each hour buys and sells for itself, and whatever prices are
        set, the sum is a lower bound. The least cost is that of a flow in a network whose arcs cost the slopes of the hourly
        cost, so best prices are found among these slopes and 0, by a walk through the hours. With positive prices the bound
        is the least cost itself; with others it stays a bound.
        """
        runs, hours = net_load.shape
        ratio = np.array([1.0, self.sell_ratio])
        slopes = (price[:, :, None] * ratio)[..., None] * np.array([self.efficiency, 1 / self.efficiency])
        rates = np.concatenate([slopes.reshape(runs, -1), np.zeros((runs, 1))], axis=1)
        # The cost of an hour bends where nothing moves and where the grid is idle; it is least at a bend or an end.
        most, least = self.rate * self.efficiency, -self.rate / self.efficiency
        idle = np.where(net_load < 0, -net_load * self.efficiency, -net_load / self.efficiency)
        bends = np.stack([np.full_like(idle, least), np.zeros_like(idle), np.clip(idle, least, most), np.full_like(idle, most)])
        costs = self.cost(bends, net_load, price)
        step = rates[:, :, None] - rates[:, None, :]
        held = np.minimum(step * self.low, step * self.high)
        value = np.minimum(rates * self.low, rates * self.high)
        for t in range(hours - 1, -1, -1):
            if t < hours - 1:
                value = (held + value[:, None, :]).max(axis=-1)
            value = value + (costs[:, :, t, None] - bends[:, :, t, None] * rates).min(axis=0)
        return (value - rates * start[:, None]).max(axis=-1)


#: Numbers a bound may hold at once: runs times the square of the prices it tries.
_BOUND_CELLS = 4_000_000


def _bounds(battery: Battery, start, net, price) -> np.ndarray:
    size = max(1, _BOUND_CELLS // (4 * net.shape[1] + 1) ** 2)
    parts = [slice(first, first + size) for first in range(0, len(start), size)]
    return np.concatenate([battery.bound(start[p], net[p], price[p]) for p in parts])


_SERIES = ("times", "demand", "solar", "wind", "price")


def _solve_batches(batches: Iterator[pd.DataFrame], keys: list[str], battery: Battery, refine: bool, bounded: bool):
    for batch in batches:
        for _, same in batch.groupby(batch["price"].map(len), sort=False):
            # Some thousand moves per run and hour: a few hundred runs at a time keep the arrays small.
            for first in range(0, len(same), 256):
                part = same.iloc[first : first + 256]
                demand, solar, wind, price = (np.stack(part[c].to_list()) for c in _SERIES[1:])
                start, net = part["start_kwh"].to_numpy(dtype=float), demand - solar - wind
                path, cost = battery.solve(start, net, price, refine)
                least = _bounds(battery, start, net, price) if bounded else cost
                yield part.assign(path=list(path), cost=cost, bound=least)[np.isfinite(cost)]


def _solved(forecast: DataFrame, starts: DataFrame, keys, battery: Battery, refine: bool, bounded: bool = False) -> DataFrame:
    """One row per run that can be kept within the limits: its hours as arrays, the path of levels, its cost and bound."""
    ship_package(forecast.sparkSession)
    hour = F.struct(F.unix_micros(F.col("time").cast("timestamp")).alias("times"), *_SERIES[1:])
    runs = forecast.groupBy(*keys).agg(F.array_sort(F.collect_list(hour)).alias("hours"))
    start_keys = [k for k in keys if k in starts.columns]
    runs = runs.join(starts, start_keys, "left")
    start = F.coalesce("start_kwh", F.lit(S.BATTERY_KWH / 2)).alias("start_kwh")
    slim = runs.select(*keys, start, *[F.col(f"hours.{c}").alias(c) for c in _SERIES])
    # Solving is heavy work on few bytes, so the task count is set here and not left to be coalesced.
    tasks = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = slim.repartition(tasks, *keys)
    numbers = T.ArrayType(T.DoubleType())
    found = [T.StructField("path", numbers), T.StructField("cost", T.DoubleType()), T.StructField("bound", T.DoubleType())]
    schema = T.StructType([*slim.schema.fields, *found])
    return slim.mapInPandas(lambda b: _solve_batches(b, list(keys), battery, refine, bounded), schema)


def optimal_cost(
    forecast: DataFrame, starts: DataFrame, keys: Sequence[str], battery: Battery = Battery(), refine: bool = True
) -> DataFrame:
    return _solved(forecast, starts, keys, battery, refine).select(*keys, "cost")


def _flows(solved: DataFrame, keys: Sequence[str], battery: Battery, time_type: str = "timestamp") -> DataFrame:
    """Unrounded hourly flows of solved runs, with the level before and after each hour."""
    hours = F.arrays_zip(*_SERIES, "path", F.concat(F.array("start_kwh"), "path").alias("before"))
    # The levels before the hours are one more than the hours; the last one starts no hour.
    rows = solved.select(*keys, F.posexplode(F.slice(hours, F.lit(1), F.size("times"))).alias("i", "h"))
    c = lambda name: F.col(f"h.{name}")
    change = c("path") - c("before")
    rows = rows.select(
        *keys,
        F.timestamp_micros(c("times")).cast(time_type).alias("time"),
        *[c(n).alias(n) for n in _SERIES[1:]],
        c("before").alias("before"),
        c("path").alias("soc"),
        (F.greatest(change, F.lit(0.0)) / battery.efficiency).alias("charge"),
        (F.greatest(-change, F.lit(0.0)) * battery.efficiency).alias("discharge"),
    )
    grid = F.expr("demand - solar - wind + charge - discharge")
    return rows.withColumns({"buy": F.greatest(grid, F.lit(0.0)), "sell": F.greatest(-grid, F.lit(0.0))})


def schedule(
    forecast: DataFrame, starts: DataFrame, keys: Sequence[str], battery: Battery = Battery(), refine: bool = True
) -> DataFrame:
    """Hourly battery and grid flows for every run of ``forecast``.

    ``forecast``: keys, ``time``, ``demand``, ``solar``, ``wind``, ``price``.
    ``starts``: ``start_kwh`` per key (or a subset of the keys).
    Runs that cannot be brought within the limits have no rows.
    """
    time_type = forecast.schema["time"].dataType.simpleString()
    rows = _flows(_solved(forecast, starts, keys, battery, refine), keys, battery, time_type)
    c = F.col
    return rows.select(
        *keys,
        "time",
        minute_label(c("time")).alias("hour"),
        F.round("price", 2).alias("buy_price_inr"),
        F.round("demand", 1).alias("demand_kw"),
        F.round("solar", 1).alias("solar_kw"),
        F.round("wind", 1).alias("wind_kw"),
        F.round("charge", 1).alias("charge_kw"),
        F.round("discharge", 1).alias("discharge_kw"),
        F.round("soc", 1).alias("battery_soc_kwh"),
        F.round("buy", 1).alias("grid_buy_kw"),
        F.round("sell", 1).alias("grid_sell_kw"),
        F.round(flows.baseline_cost(c("demand"), c("solar"), c("wind"), c("price")), 2).alias("baseline_cost_inr"),
        F.round(flows.dispatched_cost(c("buy"), c("sell"), c("price"), battery.sell_ratio), 2).alias("optimized_cost_inr"),
    )


#: Kilowatts, or kilowatt-hours, by which unrounded flows may miss a rule.
EXACT = 1e-6


def certificate(forecast: DataFrame, starts: DataFrame, keys: Sequence[str], battery: Battery = Battery()) -> DataFrame:
    """Per run: its hours, how many of them break a rule before rounding, its cost, what no schedule can cost less than, and
    the gap between the two, and what the last grid of levels explains of it: each hour's move misses the best by a step at most.

    The rules: one direction an hour, level and rate within limits, energy in equals energy out, and each hour's level follows
    from the level before it, beginning with the start. That cheap hours charge and dear ones discharge needs no rule of its
    own: a schedule that missed a gain between two hours would lie above the bound.
    """
    solved = _solved(forecast, starts, keys, battery, True, bounded=True)
    rows = _flows(solved, [*keys, "cost", "bound"], battery)
    c = F.col
    follows = c("before") + c("charge") * battery.efficiency - c("discharge") / battery.efficiency
    balance = c("buy") + c("solar") + c("wind") + c("discharge") - c("demand") - c("charge") - c("sell")
    bad = (
        ((c("charge") > EXACT) & (c("discharge") > EXACT))
        | ~c("soc").between(battery.low - EXACT, battery.high + EXACT)
        | (F.greatest("charge", "discharge") > battery.rate + EXACT)
        | (F.abs(balance) > EXACT)
        | (F.abs(follows - c("soc")) > EXACT)
    )
    step_cost = F.abs("price") * battery.finest / battery.efficiency
    runs = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hours"),
        F.count_if(bad).alias("broken_hours"),
        F.any_value("cost").alias("cost"),
        F.any_value("bound").alias("bound"),
        F.sum(step_cost).alias("grid_gap"),
    )
    return runs.withColumn("gap", F.col("cost") - F.col("bound"))


def audit(plan: DataFrame, battery: Battery = Battery(), tolerance: float = 0.1) -> DataFrame:
    """Rows that break a rule, with the rules broken; empty for a good schedule."""
    c = F.col
    supply = c("grid_buy_kw") + c("solar_kw") + c("wind_kw") + c("discharge_kw")
    use = c("demand_kw") + c("charge_kw") + c("grid_sell_kw")
    broken = F.array_compact(
        F.array(
            F.when((c("charge_kw") > 0.1) & (c("discharge_kw") > 0.1), "both ways"),
            F.when(~c("battery_soc_kwh").between(battery.low, battery.high), "level"),
            F.when((c("charge_kw") > battery.rate) | (c("discharge_kw") > battery.rate), "rate"),
            F.when(F.abs(supply - use) > tolerance + 0.15, "balance"),
        )
    )
    return plan.withColumn("violations", broken).filter(F.size("violations") > 0)
