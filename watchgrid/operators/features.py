"""Causal channel features as window expressions over the dense calendar.

Every window is per channel and ordered by day, so one exchange and one sort by
(channel, date) serve them all.  A partition holds one row per calendar day: its
size follows the length of the history, never the number of records.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchgrid import vocab
from watchgrid.functions.scalars import finite, ratio
from watchgrid.plans.decay import LONGEST_CALENDAR, block_length, with_decayed_sums

MASKS = {"alarm": "alarm_count", "observed": "events_count",
         "fault": "fault_count", "no_power": "no_power_count"}
def by_day():
    """Days of one channel in order."""
    return Window.partitionBy("channel_id").orderBy("date")


def trailing(c: Column | str, days: int, key: str = "channel_id") -> Column:
    """Sum of the last ``days`` days, today included."""
    window = Window.partitionBy(key).orderBy("date").rowsBetween(-(days - 1), 0)
    return F.sum(c).over(window)


def running(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def masks() -> list[Column]:
    return [(F.col(c) > 0).cast("int").alias(m) for m, c in MASKS.items()]


def with_masks(grid: DataFrame) -> DataFrame:
    """Day index ``i`` and 0/1 masks; the base of all features below."""
    return grid.select("*", (F.row_number().over(by_day()) - 1).alias("i"), *masks())


# Window clauses as SQL text: one parsed expression per feature keeps wide marts cheap to plan.
DAYS = "PARTITION BY channel_id ORDER BY date"
UPTO = f"OVER ({DAYS} ROWS UNBOUNDED PRECEDING)"


@dataclass
class Family:
    """SQL expressions of one feature family, by the stage in which they are computed.

    ``flags`` come first, then running sums of ``sums`` and other ``windows``,
    then the running sums ``spans`` = (name, days) ago, then plain arithmetic
    ``out``.  Families computed together share the stages: three window
    operators in all, whatever the number of features.
    """

    out: dict[str, str]
    flags: dict[str, str] = field(default_factory=dict)
    sums: dict[str, str] = field(default_factory=dict)
    windows: dict[str, str] = field(default_factory=dict)
    spans: set[tuple[str, int]] = field(default_factory=set)


def compute(masked: DataFrame, *families: Family) -> DataFrame:
    """Add the features of all families to a grid with masks."""
    flags, sums, windows, out = {}, {}, {}, {}
    for f in families:
        flags |= f.flags
        sums |= f.sums
        windows |= f.windows
        out |= f.out
    spans = sorted(set().union(*[f.spans for f in families]))
    stages = [
        [f"{e} AS {n}" for n, e in flags.items()],
        [f"sum({e}) {UPTO} AS _r_{n}" for n, e in sums.items()] + [f"{e} AS {n}" for n, e in windows.items()],
        [f"lag(_r_{n}, {k}, 0L) OVER ({DAYS}) AS _l_{n}_{k}" for n, k in spans],
    ]
    df = masked
    for columns in stages:
        if columns:
            df = df.selectExpr("*", *columns)
    return df.selectExpr(*masked.columns, *[f"{e} AS {n}" for n, e in out.items()])


class Spans:
    """Collects the trailing sums a family uses.

    A trailing sum of counts is the difference of two running sums: exact for
    integers, and its cost does not grow with the length of the window.
    """

    def __init__(self) -> None:
        self.used: set[tuple[str, int]] = set()

    def __call__(self, name: str, days: int) -> str:
        self.used.add((name, days))
        return f"(_r_{name} - _l_{name}_{days})"


def _elapsed(days: int) -> str:
    return f"least(i + 1, {days})"


def _same(names) -> dict[str, str]:
    return {n: n for n in names}


def _share(part: str, whole: str) -> str:
    return f"coalesce(try_divide({part}, {whole}), 0D)"


def rolling_family(windows: tuple[int, ...] = (3, 7, 14)) -> Family:
    """Trailing sums of 12 counters, with alarm and numeric shares per window."""
    past, out = Spans(), {}
    for k in windows:
        out |= {f"{c}_sum_{k}d": past(c, k) for c in vocab.ROLLING_COUNTERS}
        events = past("events_count", k)
        out[f"alarm_rate_{k}d"] = _share(past("alarm_count", k), events)
        out[f"numeric_share_{k}d"] = _share(past("numeric_count", k), events)
    return Family(out, sums=_same(vocab.ROLLING_COUNTERS), spans=past.used)


def since_last(mask: Column, window=None) -> Column:
    """Days since the last TRUE, 0 today, -1 when never."""
    last = F.last(F.when(mask, F.col("date")), ignorenulls=True).over(running(window or by_day()))
    return F.coalesce(F.datediff("date", last), F.lit(-1))


def streak(mask: Column, window=None) -> Column:
    """Length of the run of TRUE days ending today; needs the row number ``_n``."""
    return F.when(mask, F.col("_n") - F.coalesce(
        F.last(F.when(~mask, F.col("_n")), ignorenulls=True).over(running(window or by_day())), F.lit(0))).otherwise(0)


def _last_index(mask: str, value: int) -> str:
    return f"last(if({mask} = {value}, i, NULL), true) {UPTO}"


def days_since_family(masks: tuple[str, ...] = ("alarm", "observed", "fault")) -> Family:
    """Days since the last alarm, record and fault; -1 when never."""
    return Family({f"days_since_{m}": f"coalesce(i - _last1_{m}, -1)" for m in masks},
                  windows={f"_last1_{m}": _last_index(m, 1) for m in masks})


def streak_family() -> Family:
    """Run lengths of the masks ending today, and of days without an alarm."""
    out = {f"{m}_streak": f"if({m} = 1, i - coalesce(_last0_{m}, -1), 0)" for m in MASKS}
    out["quiet_streak"] = "if(alarm = 0, i - coalesce(_last1_alarm, -1), 0)"
    windows = {f"_last0_{m}": _last_index(m, 0) for m in MASKS}
    return Family(out, windows={**windows, "_last1_alarm": _last_index("alarm", 1)})


def active_days_family(windows: tuple[int, ...] = (3, 7, 28, 90)) -> Family:
    """Alarm and observed days per window, and the alarm-day rate over elapsed days."""
    past, out = Spans(), {}
    for k in windows:
        out[f"alarm_days_{k}d"] = past("alarm", k)
        out[f"observed_days_{k}d"] = past("observed", k)
        out[f"alarm_day_rate_{k}d"] = f"{past('alarm', k)} / {_elapsed(k)}"
    return Family(out, sums=_same(["alarm", "observed"]), spans=past.used)


def history_family() -> Family:
    """Whether the channel was ever seen, and its share of alarm days so far."""
    return Family({"seen_before_or_today": "_seen", "historical_alarm_day_rate": "_r_alarm / (i + 1)"},
                  sums=_same(["alarm"]), windows={"_seen": f"max(observed) {UPTO}"})


def trend_family() -> Family:
    """Short against long alarm rate, and today's volume against its 7-day mean."""
    past = Spans()
    out = {"alarm_trend_7_28": f"{past('alarm', 7)} / {_elapsed(7)} - {past('alarm', 28)} / {_elapsed(28)}",
           "events_trend_1_7": f"events_count / (1 + {past('events_count', 7)} / 7)"}
    return Family(out, sums=_same(["alarm", "events_count"]), spans=past.used)


def lag_family(days: tuple[int, ...] = (1, 2, 7, 14, 28)) -> Family:
    """Alarm n days ago, 0 before the start."""
    return Family({f"alarm_lag_{n}": f"_alarm_ago_{n}" for n in days},
                  windows={f"_alarm_ago_{n}": f"lag(alarm, {n}, 0) OVER ({DAYS})" for n in days})


def log_lag_family(days: tuple[int, ...] = (1, 2, 6)) -> Family:
    """Log counts n days ago, NULL before the start."""
    names = [(c, n) for c in ("fault_count", "no_power_count", "events_count") for n in days]
    return Family({f"{c}_lag{n}": f"log1p(_{c}_ago_{n})" for c, n in names},
                  windows={f"_{c}_ago_{n}": f"lag({c}, {n}) OVER ({DAYS})" for c, n in names})


def change_family() -> Family:
    """Log-count change since yesterday, and the mean of the same weekday over 4 weeks."""
    windows, out = {}, {}
    for c in ("events_count", "alarm_count"):
        windows |= {f"_{c}_back_{n}": f"lag({c}, {n}, 0L) OVER ({DAYS})" for n in (1, 7, 14, 21, 28)}
        out[f"{c}_change"] = f"log1p({c}) - log1p(_{c}_back_1)"
        out[f"{c}_same_weekday_4w"] = "(" + " + ".join(f"log1p(_{c}_back_{n})" for n in (7, 14, 21, 28)) + ") / 4"
    return Family(out, windows=windows)


# Yesterday's alarm (NULL on the first day) and counts of what followed it.
_PREVIOUS = {"_prev": f"lag(alarm, 1) OVER ({DAYS})"}
_FOLLOWED = {n: f"cast(coalesce({c}, false) AS int)" for n, c in {
    "from0": "_prev = 0", "from1": "_prev = 1", "from0_alarm": "_prev = 0 AND alarm = 1",
    "from1_alarm": "_prev = 1 AND alarm = 1", "switch": "_prev <> alarm"}.items()}


def transition_family(days: int = 90) -> Family:
    """Smoothed probability of an alarm today after a quiet / an alarm day."""
    past = Spans()
    out = {f"transition_from_{s}": f"({past(f'from{s}_alarm', days)} + 1) / ({past(f'from{s}', days)} + 20)" for s in (0, 1)}
    return Family(out, _PREVIOUS, _FOLLOWED, spans=past.used)


def dynamics_family() -> Family:
    """Alarm rate when observed, alarm starts and switches, change of the record rate."""
    past = Spans()
    out = {"alarm_rate_when_observed_28d": f"{past('alarm', 28)} / (1 + {past('observed', 28)})",
           "alarm_starts_28d": past("from0_alarm", 28), "alarm_switches_28d": past("switch", 28),
           "observation_change": f"{past('observed', 7)} / 7 - {past('observed', 28)} / 28"}
    return Family(out, _PREVIOUS, {**_FOLLOWED, **_same(["alarm", "observed"])}, spans=past.used)


def numeric_family(days: int = 28) -> Family:
    """Mean and spread of the previous 28 days and today's clipped deviation.

    Sums of measurements use a real frame: differences of long running sums
    would lose digits.
    """
    before = f"OVER ({DAYS} ROWS BETWEEN {days} PRECEDING AND 1 PRECEDING)"
    windows = {n: f"sum({c}) {before}" for n, c in (("_pn", "numeric_count"), ("_ps", "value_sum"), ("_pq", "value_sumsq"))}
    mean = "try_divide(_ps, _pn)"
    std = f"sqrt(greatest(try_divide(_pq, _pn) - {mean} * {mean}, 0D))"
    deviation = f"greatest(-100D, least(100D, (try_divide(value_sum, numeric_count) - {mean}) / (1 + {std})))"
    return Family({"numeric_past28_mean": f"if(_pn > 0, {mean}, NULL)", "numeric_past28_std": f"if(_pn > 0, {std}, NULL)",
                   "numeric_deviation": f"if(_pn > 0 AND numeric_count > 0, {deviation}, NULL)"}, windows=windows)


def weekday_family(weeks: tuple[int, ...] = (4, 12)) -> Family:
    """Smoothed share of tomorrow's weekday over its past occurrences."""
    windows, out = {}, {}
    for m in ("alarm", "observed"):
        windows |= {f"_{m}_week_{n}": f"lag({m}, {6 + 7 * n}, 0) OVER ({DAYS})" for n in range(max(weeks))}
        for k in weeks:
            total = " + ".join(f"_{m}_week_{n}" for n in range(k))
            out[f"{m}_tomorrow_weekday_{k}w"] = f"({total} + 0.1D) / (least({k}, (i + 1) DIV 7) + 10)"
    return Family(out, windows=windows)


def window_rate_family(windows: tuple[int, ...] = (2, 5, 14, 60, 180)) -> Family:
    """Share of alarm and observed days over elapsed days of each window."""
    past = Spans()
    out = {f"seq_{m}_rate_{k}d": f"{past(m, k)} / {_elapsed(k)}" for m in ("alarm", "observed") for k in windows}
    return Family(out, sums=_same(["alarm", "observed"]), spans=past.used)


def ewm(masked: DataFrame, spans: tuple[int, ...] = (7, 28)) -> DataFrame:
    """Exponential means of the masks and log counts, starting from the first day."""
    inputs = {f"{m}_ewm_{{}}": m for m in MASKS}
    inputs |= {f"{c}_log_ewm{{}}": f"log1p({c})" for c in ("events_count", "alarm_count")}
    specs = {}
    for span in spans:
        alpha = 2.0 / (span + 1)
        for name, x in inputs.items():
            specs[name.format(span)] = (F.expr(f"if(i = 0, 1D, {alpha!r}D) * {x}"), 1 - alpha)
    return with_decayed_sums(masked, "channel_id", "date", "i", specs)


def leave_one_out(facts: DataFrame, keys: list[str], columns: list[str], prefix: str,
                  observed: str | None = None) -> DataFrame:
    """Group sums without the own row, and rates over the other observed channels.

    Groups are summed first (combined before the shuffle) and joined back; a
    window over a group would pull all channels of a large group into one task.
    """
    wanted = [*columns, *([observed] if observed else [])]
    sums = facts.groupBy(*keys).agg(*[F.sum(c).alias(f"_g_{c}") for c in wanted])
    joined = facts.join(sums, keys)
    out = []
    for c in columns:
        other = F.col(f"_g_{c}") - F.col(c)
        out.append(other.alias(f"{prefix}_{c}_others"))
        if observed:
            out.append((other / (1 + F.col(f"_g_{observed}") - F.col(observed))).alias(f"{prefix}_{c}_rate"))
    return joined.select(*[facts[c] for c in facts.columns], *out)


# Members of a group whose sums one task hands out.
WIDE = 10_000


def others_in_groups(days: DataFrame, levels: dict[str, tuple[list[str], list[str], str | None]], start: Column) -> DataFrame:
    """``leave_one_out`` for several groupings, told for the days on which they differ from zero.

    ``days`` holds (channel_id, date, group columns, values) of the days with records, and a row without a date for each
    channel that may have none; the group columns are the same in all rows of a channel.  ``levels`` maps a prefix to
    (keys, columns, observed), the day being a key of all.  A channel gets a row for each day on which one of its
    groups has records, and one for ``start`` if nothing else; on all other days its columns are 0.

    Groups are summed over the days with records and their sums handed to the members, whose own values are taken
    off when all that belongs to a channel meets.  The rows come out by channel: a calendar is filled without another exchange.
    """
    groups = list(dict.fromkeys(k for keys, _, _ in levels.values() for k in keys))
    wanted = {p: [*columns, *([observed] if observed else [])] for p, (_, columns, observed) in levels.items()}
    members = days.select("channel_id", *groups).distinct()
    rows = days.select("channel_id", F.coalesce("date", start).alias("date"), *[
        (-F.col(c).cast("long")).alias(f"_{p}_{c}") for p, needed in wanted.items() for c in needed])
    for prefix, (keys, _, _) in levels.items():
        names = [f"_{prefix}_{c}" for c in wanted[prefix]]
        sums = days.where("date IS NOT NULL").groupBy(*keys, "date").agg(*[
            F.sum(c).alias(n) for c, n in zip(wanted[prefix], names)])
        # The few groups with many members (one for WIDE channels at most) are dealt out to several tasks.
        wide = F.broadcast(members.groupBy(*keys).count().where(F.col("count") > WIDE).select(
            *keys, F.ceil(F.col("count") / WIDE).alias("_shares")))
        shares = F.coalesce("_shares", F.lit(1))
        asking = members.join(wide, keys, "left").select(
            "channel_id", *keys, F.pmod(F.xxhash64("channel_id"), shares).alias("_share")).alias("m")
        told = sums.join(wide, keys, "left").select(
            *keys, "date", *names, F.explode(F.sequence(F.lit(0), shares - 1)).alias("_share")).alias("s")
        same = [F.col(f"m.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        handed = asking.join(told, [*same, F.col("m._share") == F.col("s._share")])
        rows = rows.unionByName(handed.select("channel_id", "date", *names), allowMissingColumns=True)
    others = rows.repartition("channel_id").groupBy("channel_id", "date").agg(*[
        F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in rows.columns if n not in ("channel_id", "date")])
    out = []
    for prefix, (_, columns, observed) in levels.items():
        for c in columns:
            other = F.col(f"_{prefix}_{c}")
            out.append(other.alias(f"{prefix}_{c}_others"))
            if observed:
                out.append((other / (1 + F.col(f"_{prefix}_{observed}"))).alias(f"{prefix}_{c}_rate"))
    return others.select("channel_id", "date", *out)


CARRIED = ["intra_last_event_is_alarm", "intra_last_event_minute", "intra_last_alarm_minute",
           "value_mean_1d", "value_std_1d", "events_count", "alarm_count", "fault_count", "no_power_count"]


def carry(value: Column, known: Column, window=None) -> Column:
    """Last known (value, day index) as a struct; NULL before the first."""
    return F.last(F.when(known, F.struct(value.alias("v"), F.col("i").alias("at"))),
                  ignorenulls=True).over(running(window or by_day()))


def carry_last(masked: DataFrame) -> DataFrame:
    """Last known value of nine attributes, and the age of two of them in days."""
    out = []
    for c in CARRIED:
        known = (F.col("observed") == 1) & F.col(c).isNotNull()
        if c.startswith("value_"):
            known = known & (F.col("numeric_count") > 0)
        memory = carry(F.col(c), known)
        out.append(memory["v"].alias(f"last_known_{c}"))
        if c in ("intra_last_event_is_alarm", "value_mean_1d"):
            out.append((F.col("i") - memory["at"]).alias(f"age_{c}"))
    return masked.select("*", *out)


def minutes_since(masked: DataFrame) -> DataFrame:
    """Minutes from the last record and the last alarm to the end of the day."""
    event = carry(F.col("intra_last_event_minute"), F.col("observed") == 1)
    alarm = carry(F.col("intra_last_alarm_minute"), F.col("intra_last_alarm_minute") >= 0)
    return masked.select("*", *[
        ((F.col("i") - m["at"] + 1) * 1440 - m["v"]).alias(n)
        for n, m in (("minutes_since_event", event), ("minutes_since_alarm", alarm))])


# --- memories -----------------------------------------------------------------

HALF_LIFE = 90


def context_memory(masked: DataFrame, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Alarm and record probabilities after the context of the last 1, 2, 3 days.

    The decayed outcome counts of a context are a running sum over the days that
    followed it.  The context that tomorrow follows is the one to ask, so each
    channel gets one empty day at its end and every answer moves back a day.
    All partitions are by channel and context: no exchange is added.
    """
    decay = 0.5 ** (1.0 / HALF_LIFE)
    if block_length(decay) < LONGEST_CALENDAR:
        raise ValueError("half life too short for one block")
    window = "PARTITION BY channel_id ORDER BY date"
    upto = f"OVER ({window} ROWS UNBOUNDED PRECEDING)"
    columns = masked.columns
    code = "2 * alarm + observed"
    # What precedes a day, two bits a day, the last one lowest: the shorter contexts are its remainders.
    preceding = " + ".join(f"lag({code}, {n + 1}, 0) OVER ({window}) * {4 ** n}" for n in range(max(orders)))
    told = masked.selectExpr("*", f"{preceding} AS _x", f"lead(date) OVER ({window}) IS NULL AS _last")
    # The sorts by context hold no column that the day's number or a later window gives again.
    asked = told.selectExpr("*", "explode(if(_last, array(0, 1), array(0))) AS _ahead").selectExpr(
        *[c for c in columns if c not in ("date", "i", "alarm", "observed")],
        "date_add(date, _ahead) AS date", "i + _ahead AS i", "if(_ahead = 0, alarm, NULL) AS alarm",
        "if(_ahead = 0, observed, NULL) AS observed", "_ahead", f"if(_ahead = 0, _x, {code} + 4 * (_x % {4 ** (max(orders) - 1)})) AS _x")
    weight = f"pow({decay!r}D, -i)"
    before = f"pow({decay!r}D, i - _ahead) * pow({decay!r}D, _ahead - 1)"
    for k in orders:
        earlier = (f"OVER (PARTITION BY channel_id, _x % {4 ** k} ORDER BY date "
                   "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        # State at the end of the previous day; learning starts with a full context.
        counted = f"if(_ahead = 0 AND i >= {k}, {weight}, NULL)"
        asked = asked.selectExpr("*", *[
            f"coalesce(sum({counted} * {x}) {earlier}, 0D) * ({before}) AS _{n}{k}"
            for n, x in (("n", "1"), ("a", "alarm"), ("o", "observed"))])
    base = [f"pow({decay!r}D, i) * sum({x}) {upto} AS _p{n}"
            for n, x in (("a", f"{weight} * alarm"), ("o", f"{weight} * observed"), ("n", weight))]
    answers = asked.selectExpr("*", *base, *[
        f"lead(_{n}{k}) OVER ({window}) AS _{n}{k}_next" for k in orders for n in "nao"]).where("_ahead = 0")
    out = []
    for k in orders:
        out += [f"(_a{k}_next + 10 * (_pa + 0.1D) / (_pn + 10)) / (_n{k}_next + 10) AS pattern{k}_alarm",
                f"(_o{k}_next + 10 * (_po + 1) / (_pn + 10)) / (_n{k}_next + 10) AS pattern{k}_observed",
                f"_n{k}_next AS pattern{k}_support"]
    return answers.selectExpr(*columns, *out)


def recurrence(masked: DataFrame, mask: str) -> DataFrame:
    """Age, last gap, smoothed gap, gap variation and cycle position of a mask."""
    hit = F.col(mask) == 1
    before = by_day().rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last(F.when(hit, F.col("i")), ignorenulls=True).over(before)
    df = masked.withColumn("_gap", F.when(hit, F.col("i") - previous))
    run = running(by_day())
    gap = F.col("_gap").cast("double")
    df = df.select(
        "*", (F.count("_gap").over(run) - 1).alias("_j"),
        F.sum(gap).over(run).alias("_s"), F.sum(gap * gap).over(run).alias("_q"),
        F.last("_gap", ignorenulls=True).over(run).alias(f"{mask}_last_gap"),
        (F.col("i") - F.last(F.when(hit, F.col("i")), ignorenulls=True).over(run)).alias(f"{mask}_age"))
    # Smoothing steps once per gap: index the decay by gaps, the first taken whole.
    fresh = F.when(F.col("_gap").isNull(), 0.0).when(F.col("_j") == 0, gap).otherwise(gap * 0.3)
    df = df.withColumn("_at", F.greatest(F.col("_j"), F.lit(0)))
    df = with_decayed_sums(df, "channel_id", "date", "_at", {"_ema": (fresh, 0.7)})
    n = F.col("_j") + 1
    mean = ratio(F.col("_s"), n)
    std = F.sqrt(F.greatest(ratio(F.col("_q"), n) - mean * mean, F.lit(0.0)))
    ema = F.when(n > 0, F.col("_ema"))
    return df.select(
        *masked.columns, f"{mask}_age", f"{mask}_last_gap", ema.alias(f"{mask}_gap_ema"),
        F.when(n > 1, std / (mean + 1e-8)).alias(f"{mask}_gap_cv"),
        ((F.col(f"{mask}_age") + 1) / (ema + 1)).alias(f"{mask}_cycle_fraction"))


def channel_mart(masked: DataFrame) -> DataFrame:
    """All per-channel features of the daily mart that need no other table.

    One exchange by channel and a fixed number of window operators, however
    many features are added.
    """
    return compute(ewm(masked), rolling_family(), active_days_family(), history_family(), trend_family(),
                   days_since_family(), streak_family(), lag_family(), change_family(), transition_family(),
                   dynamics_family(), numeric_family(), weekday_family(), window_rate_family())


# --- feature lists --------------------------------------------------------------

def feature_columns(schema: T.StructType, keys: list[str], categorical: list[str], labels: list[str]) -> list[str]:
    """Columns a model may use; text outside the categorical list is an error."""
    out = []
    for f in schema.fields:
        if f.name in keys or f.name in labels:
            continue
        if f.name not in categorical and not isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            raise ValueError(f"{f.name} is not numeric and not categorical")
        out.append(f.name)
    return out


def sanitize(df: DataFrame, numeric: list[str], categorical: list[str], fill: float = -999999.0) -> DataFrame:
    """Finite numbers everywhere, categories as text."""
    keep = [c for c in df.columns if c not in (*numeric, *categorical)]
    return df.select(*keep, *[finite(F.col(c), fill).alias(c) for c in numeric],
                     *[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in categorical])
