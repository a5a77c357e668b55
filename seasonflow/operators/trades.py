"""Trade-level operators: interval filters, price paths, exits, payoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonflow.functions.core import written

TRADE = ["symbol", "date", "holding_days", "direction"]
#: delta, leverage, time value, spread cost by strike; premium over the stock's price by strike (fixed values).
STRIKES = {"D30": (0.30, 12, 0.85, 0.025), "D40": (0.40, 11, 0.70, 0.015), "D50": (0.50, 11, 0.55, 0.015), "D60": (0.60, 11, 0.40, 0.015)}
PREMIUMS = {"D30": 0.025, "D40": 0.036, "D50": 0.045, "D60": 0.055}
#: days to expiry as (times, plus) of the holding days, premium multiplier by expiry; premium multiplier, share that passes by volatility filter (fixed values).
EXPIRIES = {"XS": (1, 3, 1.0), "XN": (1, 10, 1.3), "XB": (1, 7, 1.5), "X2": (2, 0, 1.8)}
VOLATILITIES = {"IN": (1.10, 1.00), "IL": (1.00, 0.60), "IH": (0.90, 0.30)}
#: cost over width by (width, expiry) of debit spreads; credit over width by (short distance, width, expiry) (fixed values).
DEBIT = {
    (0.03, "XN"): 0.40, (0.05, "XN"): 0.37, (0.03, "XB"): 0.41, (0.05, "XB"): 0.38, (0.03, "X2"): 0.39, (0.05, "X2"): 0.36,
    (0.03, "XS"): 0.44, (0.05, "XS"): 0.40
}
CREDIT = {
    (0.03, 0.03, "XS"): 0.28, (0.03, 0.03, "XN"): 0.25, (0.03, 0.05, "XS"): 0.22, (0.03, 0.05, "XN"): 0.20, (0.05, 0.03, "XS"): 0.18, (0.05, 0.03, "XN"): 0.15,
    (0.05, 0.05, "XS"): 0.12, (0.05, 0.05, "XN"): 0.10, (0.02, 0.03, "XS"): 0.33, (0.02, 0.03, "XN"): 0.30, (0.02, 0.05, "XS"): 0.27, (0.02, 0.05, "XN"): 0.24,
}


def month_number(d: Column | str) -> Column:
    return F.year(d) * 12 + F.month(d)


def with_exit_date(df: DataFrame) -> DataFrame:
    return df.withColumn("exit_date", F.expr("date_add(date, holding_days)"))


def with_event_inside(df: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct TRADE keys of rows that have an event of their symbol from entry to exit, both included; the join is by (symbol, month)."""
    t = with_exit_date(df.select(*TRADE)).withColumn("_m", F.explode(F.sequence(month_number("date"), month_number("exit_date"))))
    e = events.select("symbol", month_number("date").alias("_m"), F.col("date").alias("_e"))
    return t.join(e, ["symbol", "_m"]).where(F.col("_e").between(F.col("date"), F.col("exit_date"))).select(*TRADE).distinct()


def without_events(df: DataFrame, events: DataFrame) -> DataFrame:
    """Rows without an event of their symbol from entry to exit, both included."""
    return with_exit_date(df).join(with_event_inside(df, events), TRADE, "left_anti")


def with_event_flag(df: DataFrame, events: DataFrame) -> DataFrame:
    """df with has_event."""
    hit = with_event_inside(df, events).withColumn("_h", F.lit(True))
    return df.join(hit, TRADE, "left").withColumn("has_event", F.coalesce("_h", F.lit(False))).drop("_h")


def interval_path(df: DataFrame, bars: DataFrame) -> DataFrame:
    """A row for each bar in (entry, exit] of each trade: the trade's columns, bar_date, bar_close.

    Bars are spread over the months that a trade spans, so that the join's key is (symbol, month), not the symbol alone.
    """
    t = with_exit_date(df).withColumn("_m", F.explode(F.sequence(month_number("date"), month_number("exit_date"))))
    b = bars.select(F.col("symbol").alias("_s"), F.col("date").alias("bar_date"), F.col("close").alias("bar_close"), month_number("date").alias("_bm"))
    return t.join(
        b,
        (F.col("symbol") == F.col("_s")) & (F.col("_m") == F.col("_bm")) & (F.col("bar_date") > F.col("date")) & (F.col("bar_date") <= F.col("exit_date"))
    ).drop("_s", "_m", "_bm")


def calendar(bars: DataFrame) -> DataFrame:
    """(date, idx, next_date) of every day on which any symbol has a bar: a calendar, so its numbering is one small task."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return bars.select("date").distinct().select("date", (F.row_number().over(w) - 1).alias("idx"), F.lead("date").over(w).alias("next_date"))


def filled_bars(bars: DataFrame, needed: DataFrame, days: DataFrame) -> DataFrame:
    """(symbol, _m, bar_date, idx, close, last_close) for every trading day of the needed (symbol, _m), whether it has a bar or not.

    close is null on a day without a bar, last_close goes on from the last day that has one. It is carried within the
    month by a window, over months' ends by a table of a row for each month of a symbol; so no task sees more of a symbol
    than its months. The calendar, broadcast by month, has a row for each trading day.
    """
    by_month = days.groupBy(month_number("date").alias("_m")).agg(F.collect_list(F.struct(F.col("date").alias("bar_date"), "idx")).alias("days"))
    spine = needed.join(F.broadcast(by_month), "_m").select("symbol", "_m", F.inline("days"))
    own = spine.join(bars.select("symbol", F.col("date").alias("bar_date"), "close"), ["symbol", "bar_date"], "left")
    ends = bars.groupBy("symbol", month_number("date").alias("_m")).agg(F.max_by("close", "date").alias("end"))
    months = ends.unionByName(needed.withColumn("end", F.lit(None).cast("double"))).groupBy("symbol", "_m").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("symbol").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    before = months.select("symbol", "_m", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    inside = Window.partitionBy("symbol", "_m").orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    return own.join(before, ["symbol", "_m"], "left").select(
        "symbol", "_m", "bar_date", "idx", "close", F.coalesce(F.last("close", ignorenulls=True).over(inside), "before").alias("last_close")
    )


def trade_path(df: DataFrame, bars: DataFrame) -> DataFrame:
    """A row for each trading day of each trade, from the day after entry to the last one by the deadline: bar_date, t, cum, held, last.

    Trading days are those on which any symbol has a bar. t counts them from entry; last is the deadline's t, 1 at least:
    where no trading day comes before the deadline, the next one is the last. cum is the signed return since the entry
    close, 0 on a day without a bar of the symbol; held goes on from the last bar instead, as options and spreads are
    valued. Trades without an entry bar, or entered on the last day of all, have no path.

    The days ahead of an entry are found once for all trades entered there, by (symbol, month), so a symbol's days are
    dealt over many keys. Trades meet them by (symbol, date) and unfold in place: what follows by trade needs no shuffle
    of paths. The number of parts is stated, as Spark would merge them by their sizes before they unfold.
    """
    parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bars = written(bars.select("symbol", "date", "close"), "closes")
    days = written(calendar(bars), "calendar")
    at = bars.select("symbol", "date", F.col("close").alias("entry_close"))
    begun = with_exit_date(df).join(F.broadcast(days.toDF("date", "_entry", "_next")), "date").join(at, ["symbol", "date"])
    begun = begun.where("entry_close > 0 and _next is not null").withColumn("_until", F.greatest("exit_date", "_next")).drop("_next")
    trades = written(begun, "begun")
    open_ = trades.groupBy("symbol", "date").agg(F.max("_until").alias("_until")).withColumn("_m", F.explode(F.sequence(month_number("date"), month_number("_until"))))
    filled = filled_bars(bars, open_.select("symbol", "_m").distinct(), days).toDF("symbol", "_m", "bar_date", "_idx", "bar_close", "_last_close")
    ahead = open_.join(filled, ["symbol", "_m"]).where((F.col("bar_date") > F.col("date")) & (F.col("bar_date") <= F.col("_until")))
    ahead = ahead.groupBy("symbol", "date").agg(F.collect_list(F.struct("bar_date", "_idx", "bar_close", "_last_close")).alias("_ahead"))
    p = trades.repartition(parts, "symbol", "date").join(ahead.hint("merge"), ["symbol", "date"])
    p = p.withColumn("_ahead", F.filter("_ahead", lambda d: d["bar_date"] <= F.col("_until"))).withColumn("last", F.size("_ahead"))
    p = p.select(*[c for c in p.columns if c != "_ahead"], F.inline("_ahead"))
    sign = F.when(F.col("direction") == "l", 1).otherwise(-1)
    since = lambda c: F.coalesce(sign * (F.col(c) / F.col("entry_close") - 1), F.lit(0.0))
    p = p.withColumns({"t": F.col("_idx") - F.col("_entry"), "cum": since("bar_close"), "held": since("_last_close")})
    return p.drop("_entry", "_until", "_idx", "_last_close")


def carried(path: DataFrame) -> DataFrame:
    """path with cum as options and spreads see it: on a day without a bar the last one's."""
    return path.withColumn("cum", F.col("held"))


def upto(column: Column, func=F.max, before: bool = False) -> Column:
    """func over a trade's days up to the present one, or up to the day before."""
    return func(column).over(Window.partitionBy(*TRADE).orderBy("t").rowsBetween(Window.unboundedPreceding, -1 if before else 0))


Rules = list[tuple[str, Column, Column]]


def first_triggers(path: DataFrame, sets: dict[str, Rules], last: dict[str, Column] | None = None) -> DataFrame:
    """One row per trade and set of rules: rule, exit_t, exit_return, reason of the first day on which one fires; earlier rules go first in a day.

    sets: name -> [(reason, condition, return)]. The last day's own return, `last` of the set or cum, is the last rule of
    each. All sets are resolved in one pass over the path, by the least day times rules plus rule.
    """
    sets = {name: [*rules, ("expiry", F.col("t") >= F.col("last"), (last or {}).get(name, F.col("cum")))] for name, rules in sets.items()}
    first = {f"_i{k}": F.coalesce(*[F.when(cond, F.lit(i)) for i, (_, cond, _) in enumerate(rules)]) for k, rules in enumerate(sets.values())}
    p, aggs, rows = path.withColumns(first), [], []
    for k, (name, rules) in enumerate(sets.items()):
        n, chosen = len(rules), lambda at, values: F.coalesce(*[F.when(at == i, x) for i, x in enumerate(values)])
        at = F.col("t").cast("long") * n + F.col(f"_i{k}")
        aggs += [F.min(at).alias(f"_at{k}"), F.min_by(chosen(F.col(f"_i{k}"), [ret.cast("double") for _, _, ret in rules]), at).alias(f"_r{k}")]
        i = F.col(f"_at{k}") % n
        rows.append(F.struct(
            F.lit(name).alias("rule"), ((F.col(f"_at{k}") - i) / n).cast("int").alias("exit_t"), F.col(f"_r{k}").alias("exit_return"),
            chosen(i, [F.lit(reason) for reason, _, _ in rules]).alias("reason")
        ))
    return p.groupBy(*TRADE).agg(*aggs).select(*TRADE, F.inline(F.array(*rows)))


def first_trigger(path: DataFrame, rules: Rules) -> DataFrame:
    """first_triggers of a single set, without its name."""
    return first_triggers(path, {"": rules}).drop("rule")


def with_marks(path: DataFrame, predicted: Column) -> DataFrame:
    """path with hwm, the running maximum of 0 and cum; reached and reached_before, whether it has met the predicted return; stop, half the excess."""
    p = path.withColumn("predicted", predicted).withColumns({"_top": upto(F.col("cum")), "_before": upto(F.col("cum"), before=True)})
    met = lambda c: F.coalesce(F.col(c) >= F.col("predicted"), F.lit(False))
    p = p.withColumns({"hwm": F.greatest("_top", F.lit(0.0)), "reached": met("_top"), "reached_before": met("_before")})
    return p.withColumn("stop", F.col("predicted") + (F.col("hwm") - F.col("predicted")) * 0.5).drop("_top", "_before")


def exit_hold(path: DataFrame) -> DataFrame:
    return first_trigger(path, [])


def trailing(extra: list = ()) -> list:
    return [*extra, ("trailing_stop", F.col("reached") & (F.col("cum") <= F.col("stop")), F.col("stop"))]


def exit_mfe_trail(path: DataFrame, predicted: Column) -> DataFrame:
    return first_trigger(with_marks(path, predicted), trailing())


def exit_time_trail(path: DataFrame, predicted: Column, share: float = 0.6) -> DataFrame:
    """As the trail, and out at `share` of the time if the predicted return wasn't met before that day."""
    late = (F.col("t") >= F.floor(F.col("last") * share)) & ~F.col("reached_before")
    return first_trigger(with_marks(path, predicted), trailing([("time_limit", late, F.col("cum"))]))


def exit_pct_trail(path: DataFrame, pct: float = 0.03) -> DataFrame:
    p = path.withColumn("hwm", F.greatest(upto(F.col("cum")), F.lit(0.0)))
    return first_trigger(p, [("pct_trail", (F.col("cum") <= F.col("hwm") - pct) & (F.col("t") >= 2), F.col("hwm") - pct)])


def atr_or_default(atr: Column) -> Column:
    return F.when(atr > 0, atr).otherwise(0.02)


def exit_atr_trail(path: DataFrame, atr: Column, k: float = 2.0) -> DataFrame:
    p = path.withColumn("hwm", F.greatest(upto(F.col("cum")), F.lit(0.0)))
    stop = F.col("hwm") - k * atr_or_default(atr)
    return first_trigger(p, [("atr_trail", (F.col("cum") <= stop) & (F.col("t") >= 2), stop)])


def expiry_days(expiry: str, holding: Column) -> Column:
    times, plus, _ = EXPIRIES[expiry]
    return holding * times + plus


def premium(strike: str, expiry: str, volatility: str = "IL") -> float:
    """An option's premium over the stock's price."""
    return PREMIUMS[strike] * EXPIRIES[expiry][2] * VOLATILITIES[volatility][0]


def option_paths(path: DataFrame, options: dict[str, tuple[str, Column]]) -> DataFrame:
    """path with opt and dte_left, each followed by the option's name, for several options: name -> (strike, days to expiry).

    opt is the option's gain over its premium by day, never below -1. Each day adds the stock's move times delta and
    leverage less a root-of-time decay. A running sum with a floor equals the plain running sum plus what its minimum
    falls short of the floor. All options share the sort by trade and day.
    """
    w = Window.partitionBy(*TRADE).orderBy("t")
    p = path.withColumn("_move", F.col("cum") - F.coalesce(F.lag("cum").over(w), F.lit(0.0))).withColumns({f"dte{n}": dte.cast("double") for n, (_, dte) in options.items()})
    p = p.withColumns({f"dte_left{n}": F.greatest(F.col(f"dte{n}") - (F.col("t") - 1), F.lit(1)) for n in options})
    gain = {}
    for n, (strike, _) in options.items():
        delta, leverage, value, cost = STRIKES[strike]
        left, dte = F.col(f"dte_left{n}"), F.col(f"dte{n}")
        decay = (F.sqrt(left / dte) - F.sqrt((left - 1) / dte)) * value
        gain[f"_d{n}"] = F.col("_move") * (delta * leverage) - decay + F.when(F.col("t") == 1, -cost / 2).otherwise(0.0)
    p = p.withColumns(gain).withColumns({f"_s{n}": upto(F.col(f"_d{n}"), F.sum) for n in options})
    p = p.withColumns({f"opt{n}": F.col(f"_s{n}") + F.greatest(F.lit(0.0), -1 - upto(F.col(f"_s{n}"), F.min)) for n in options})
    return p.drop("_move", *gain, *[f"_s{n}" for n in options])


def option_path(path: DataFrame, strike: str, dte: Column) -> DataFrame:
    """option_paths of a single option: opt, dte and dte_left."""
    return option_paths(path, {"": (strike, dte)})


def option_result(opt: Column, strike: str) -> Column:
    """A day's option gain after the exit's half of the spread."""
    return F.greatest(opt - STRIKES[strike][3] / 2, F.lit(-1.0))


def option_rules(rule: str, atr: Column | None = None, name: str = "") -> Rules:
    """ES: premium stop at -40 %. EC: -50 %, trail on the stock, decay near expiry. EM, ET: as for stocks. EA: -50 %, ATR trail, decay."""
    opt = F.col(f"opt{name}")
    trail = ("mfe_trail", F.col("reached") & (F.col("cum") <= F.col("stop")), opt)
    decay = ("theta_exit", (F.col(f"dte_left{name}") <= 5) & (opt < 0), opt)
    stop = lambda at: ("premium_stop", opt <= at, F.lit(at))
    if rule == "ES":
        return [stop(-0.40)]
    if rule == "EC":
        return [stop(-0.50), trail, decay]
    if rule == "ET":
        return [("time_limit", (F.col("t") >= F.floor(F.col("last") * 0.6)) & ~F.col("reached_before"), opt), trail]
    if rule.startswith("EA"):
        k = int(rule[2:] or 20) / 10
        return [stop(-0.50), ("atr_trail", (F.col("cum") <= F.col("hwm") - k * atr_or_default(atr)) & (F.col("t") >= 2), opt), decay]
    return [trail]


def exit_options(path: DataFrame, rules: dict[str, list[str]] | list[str], predicted: Column, atr: Column | None = None) -> DataFrame:
    """Exits by several rules in one pass over a path of one option or, with rules by option name, of several; `rule` names them.

    With several options the name and the rule stand in `option` and `rule`.
    """
    several = isinstance(rules, dict)
    sets = {f"{name} {rule}": (name, rule) for name, own in (rules if several else {"": rules}).items() for rule in own}
    own, last = {k: option_rules(rule, atr, name) for k, (name, rule) in sets.items()}, {k: F.col(f"opt{name}") for k, (name, _) in sets.items()}
    out = first_triggers(with_marks(path, predicted), own, last)
    both = F.split("rule", " ")
    return out.withColumns({"option": both[0], "rule": both[1]} if several else {"rule": both[1]})


def exit_option(path: DataFrame, rule: str, predicted: Column, atr: Column | None = None) -> DataFrame:
    return exit_options(path, [rule], predicted, atr).drop("rule")


def spread_rules(kind: str, width: float, rule: str = "EH", atr: Column | None = None, short: float = 0.03) -> Rules:
    """Debit: out at the full width, at 90 % of it (EP), or by an ATR trail (EA). Credit: out halfway to the short strike."""
    early = F.col("t") < F.col("last")
    full = ("max_profit", (F.col("cum") >= width) & early, F.col("cum"))
    if kind == "CREDIT":
        return [("credit_stop", (F.col("cum") <= -short * 0.5) & early, F.col("cum"))]
    if rule == "EP":
        return [("profit_target", (F.col("cum") >= width * 0.9) & early, F.col("cum"))]
    if rule.startswith("EA"):
        k = int(rule[2:]) / 10
        return [("atr_trail", (F.col("cum") <= F.col("hwm") - k * atr_or_default(atr)) & (F.col("t") >= 2) & early, F.col("cum")), full]
    return [full]


def exit_spreads(path: DataFrame, sets: dict[str, Rules]) -> DataFrame:
    """Exits of spreads by several spread_rules in one pass."""
    return first_triggers(path.withColumn("hwm", F.greatest(upto(F.col("cum")), F.lit(0.0))), sets)


def exit_spread(path: DataFrame, kind: str, width: float, rule: str = "EH", atr: Column | None = None, short: float = 0.03) -> DataFrame:
    return exit_spreads(path, {"": spread_rules(kind, width, rule, atr, short)}).drop("rule")


def debit_spread(ret: Column, width: float, expiry: str) -> Column:
    """Gain over the premium of a debit spread at expiry."""
    cost = DEBIT.get((width, expiry), 0.40) * width
    return F.least(F.greatest(ret, F.lit(0.0)), F.lit(width)) / cost - 1


def credit_spread(ret: Column, short: float, width: float, expiry: str) -> Column:
    """Gain over the collateral of a credit spread at expiry."""
    credit = CREDIT.get((short, width, expiry), 0.20) * width
    held = width - credit
    part = -F.least((-ret - short - credit) / held, F.lit(1.0))
    return F.when(ret >= -short, F.lit(credit / held)).when(ret <= -(short + width), -1.0).otherwise(part)


def single_leg(ret: Column, days: Column, t: Column) -> Column:
    """Gain over the premium of a deep call under a straight path of t days to `ret`: the floored running sum as a fold."""
    delta, leverage, value, cost = STRIKES["D60"]
    dte = days * 2.0

    def step(s: Column, d: Column) -> Column:
        left = F.greatest(dte - d, F.lit(1.0))
        decay = (F.sqrt(left / dte) - F.sqrt((left - 1) / dte)) * value
        return F.greatest(s + ret / t * (delta * leverage) - decay, F.lit(-1.0))

    return F.greatest(F.aggregate(F.sequence(F.lit(1), t), F.lit(-cost / 2), step) - cost / 2, F.lit(-1.0))


def stock_profile(profile: str, actual: Column, mfe: Column, atr: Column) -> Column:
    """Percent return under hold, target4_trail2, target5_trail3 or target6_atr2, from outcome and best excursion."""
    if profile == "target4_trail2":
        return F.when(mfe >= 4, 4.0).when((mfe >= 2.5) & (mfe - actual >= 2), F.greatest(actual, mfe - 2)).otherwise(actual)
    if profile == "target5_trail3":
        return F.when(mfe >= 5, 5.0).when((mfe >= 3) & (mfe - actual >= 2), F.greatest(actual, mfe - 2)).otherwise(actual)
    if profile == "target6_atr2":
        return F.when(mfe >= 6, 6.0).otherwise(F.greatest(actual, -2 * atr))
    return actual


def option_profile(actual: Column, mfe: Column, days: Column, premium: float, theta: float) -> Column:
    gross = 0.55 * F.greatest(actual / 100, F.lit(0.0)) + 0.30 * F.greatest(mfe / 100, F.lit(0.0))
    return F.least(F.greatest(((gross - premium) / premium - theta * days / 30) * 100, F.lit(-100.0)), F.lit(300.0))


def spread_profile(family: str, actual: Column, mfe: Column, otm: float, width: float) -> Column:
    if family == "bull_call":
        debit = 0.40 * width
        end = F.when(mfe >= otm + 0.5 * width, 0.60 * width).otherwise(F.least(F.greatest(actual, F.lit(0.0)), F.lit(width)))
        return F.least(F.greatest((end - debit) / debit * 100, F.lit(-100.0)), F.lit(150.0))
    credit = 0.32 * width
    loss = F.least(F.greatest(-actual - otm, F.lit(0.0)), F.lit(width))
    return F.least(F.greatest((credit - loss) / (width - credit) * 100, F.lit(-100.0)), F.lit(60.0))
