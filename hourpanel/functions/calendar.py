"""Calendar and categorical scalar functions over the hour stamp ``tm``.

Everything here is a column expression (or a ``withColumns`` over a frame),
so it stays inside whole-stage codegen and runs on batch or streaming frames.
``tm`` is an integer ``YYYYMMDDHH`` without a zone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._util import col_of

# ---------------------------------------------------------------------------
# Fixed values (must equal the analysed study's definitions).
# Weekday names, Monday first (weekday 0 = Monday).
WEEKDAY_NAMES_KO = ["월", "화", "수", "목", "금", "토", "일"]
# Hour cut edges for the five-way time category (right-closed) and its labels.
TIME_CATEGORY_EDGES = [-1, 6, 9, 16, 19, 23]
TIME_CATEGORY_LABELS = ["심야", "출근", "낮", "퇴근", "밤"]
# Service time groups: (hours, label); hours 1-4 are the closed service window.
TIME_GROUPS = [
    ([1, 2, 3, 4], "운행중단"),
    ([5, 6], "새벽_첫차(5-6시)"),
    ([7, 8, 9], "아침_러시아워(7-9시)"),
    ([10, 11], "오전_일반(10-11시)"),
    ([12, 13, 14], "점심시간(12-14시)"),
    ([15, 16], "오후_일반(15-16시)"),
    ([17, 18, 19], "저녁_러시아워(17-19시)"),
    ([20, 21, 22], "야간_일반(20-22시)"),
    ([23], "막차시간(23시)"),
    ([0], "심야_귀가(0시)"),
]
# Commute periods: (hours, label); any other hour is late_night.
TIME_PERIODS = [
    ([6, 7], "early_morning_rush"),
    ([8, 9], "morning_rush_peak"),
    ([10], "morning_rush_end"),
    ([11, 12, 13, 14], "daytime"),
    ([15, 16], "afternoon_start"),
    ([17, 18], "evening_rush_start"),
    ([19, 20], "evening_rush_peak"),
    ([21], "evening_rush_end"),
    ([22, 23], "night"),
]
TIME_PERIOD_DEFAULT = "late_night"
PEAK_PERIODS = ["morning_rush_peak", "evening_rush_peak"]
# Rush-hour presets.
RUSH_HOURS = {
    "model": [7, 8, 9, 18, 19, 20],
    "eda": [7, 8, 9, 17, 18, 19],
    "period_peak": [8, 9, 19, 20],
}
# Season presets by month.
SEASON_CODE_1_4 = {1: [3, 4, 5], 2: [6, 7, 8], 3: [9, 10, 11], 4: [12, 1, 2]}
SEASON_CODE_0_3 = {0: [12, 1, 2], 1: [3, 4, 5], 2: [6, 7, 8], 3: [9, 10, 11]}
SEASON_LABELS_KO = [([3, 4, 5], "봄"), ([6, 7, 8], "여름"), ([9, 10, 11], "가을"), ([12, 1, 2], "겨울")]
SEASON_LABEL_OTHER = "기타"
SEASON_DETAILED = [
    ([12, 1, 2], "winter"),
    ([3, 4], "spring_early"),
    ([5], "spring_late"),
    ([6, 7], "summer_early"),
    ([8], "summer_peak"),
    ([9, 10], "autumn_early"),
    ([11], "autumn_late"),
]
# Public holidays 2021-2023 used by the holiday flag.
HOLIDAYS = [
    "2021-01-01", "2021-02-11", "2021-02-12", "2021-02-13", "2021-02-14",
    "2021-03-01", "2021-05-01", "2021-05-05", "2021-05-19", "2021-06-06",
    "2021-08-15", "2021-08-16", "2021-09-18", "2021-09-19", "2021-09-20",
    "2021-09-21", "2021-09-22", "2021-10-03", "2021-10-04", "2021-10-09",
    "2021-10-10", "2021-10-11", "2021-10-20", "2021-11-18", "2021-12-25",
    "2022-01-01", "2022-01-29", "2022-01-30", "2022-01-31", "2022-02-01", "2022-02-02",
    "2022-03-01", "2022-03-09", "2022-05-01", "2022-05-05", "2022-05-08", "2022-06-01",
    "2022-06-04", "2022-06-05", "2022-06-06", "2022-08-13", "2022-08-14", "2022-08-15",
    "2022-09-09", "2022-09-10", "2022-09-11", "2022-09-12", "2022-10-01", "2022-10-02",
    "2022-10-03", "2022-10-08", "2022-10-09", "2022-10-10", "2022-11-17", "2022-11-30", "2022-12-25",
    "2023-01-01", "2023-01-21", "2023-01-22", "2023-01-23", "2023-01-24",
    "2023-03-01", "2023-05-05", "2023-05-06", "2023-05-07", "2023-05-27", "2023-05-28", "2023-05-29",
    "2023-06-06", "2023-08-15", "2023-09-14", "2023-09-28", "2023-09-29", "2023-09-30",
    "2023-10-01", "2023-10-02", "2023-10-03", "2023-10-07", "2023-10-08", "2023-10-09",
    "2023-11-16", "2023-12-23", "2023-12-24", "2023-12-25", "2023-12-30", "2023-12-31",
]
UP_LINE, DOWN_LINE = "상선", "하선"
# ---------------------------------------------------------------------------


def parse_tm(tm: str | Column = "tm") -> Column:
    """``YYYYMMDDHH`` integer -> zone-less timestamp."""
    return F.to_timestamp_ntz(col_of(tm).cast("string"), F.lit("yyyyMMddHH"))


def tm_hour(tm: str | Column = "tm") -> Column:
    """Hour by integer arithmetic (``tm % 100``)."""
    return (col_of(tm) % 100).cast("int")


def tm_month(tm: str | Column = "tm") -> Column:
    """Month by integer arithmetic (``(tm // 10000) % 100``)."""
    return (F.floor(col_of(tm) / 10000) % 100).cast("int")


def with_calendar(df: DataFrame, tm: str = "tm", prefix: str = "") -> DataFrame:
    """Add ``datetime, date, year, month, day, hour, dayofweek`` (0 = Monday) of a ten-digit stamp.

    The parts are integer arithmetic on the stamp and one date; only ``datetime`` parses text.  A stamp of no
    real date and hour has NULL parts.
    """
    p, n = prefix, F.col(tm).cast("long")
    hour = (n % 100).cast("int")
    date = F.to_date(F.try_make_timestamp_ntz(F.floor(n / 1000000).cast("int"), (F.floor(n / 10000) % 100).cast("int"),
                                              (F.floor(n / 100) % 100).cast("int"), hour, F.lit(0), F.lit(0)))
    out = df.withColumns({f"{p}datetime": parse_tm(tm), f"{p}date": F.when(n.between(10**9, 10**10 - 1), date)})
    d = F.col(f"{p}date")
    return out.withColumns({f"{p}year": F.year(d), f"{p}month": F.month(d), f"{p}day": F.dayofmonth(d),
                            f"{p}hour": F.when(d.isNotNull(), hour), f"{p}dayofweek": F.weekday(d)})


def iso_week(ts: str | Column = "datetime") -> Column:
    return F.weekofyear(col_of(ts))


def weekend_flag(dow: str | Column = "dayofweek") -> Column:
    return (col_of(dow) >= 5).cast("int")


def day_type(dow: str | Column = "dayofweek") -> Column:
    return F.when(col_of(dow) >= 5, "weekend").when(col_of(dow).isNotNull(), "weekday")


def dow_flags(dow: str | Column = "dayofweek") -> dict[str, Column]:
    d = col_of(dow)
    return {
        "is_monday": (d == 0).cast("int"),
        "is_friday": (d == 4).cast("int"),
        "is_saturday": (d == 5).cast("int"),
        "is_sunday": (d == 6).cast("int"),
    }


def dow_name(dow: str | Column = "dayofweek", names: Sequence[str] = WEEKDAY_NAMES_KO) -> Column:
    """Localized weekday label; pair with ``dow`` itself as the sort order."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), col_of(dow) + 1)


def _in_chain(c: Column, groups: Iterable[tuple[Sequence[int], object]], default=None,
              null_to_last: bool = False) -> Column:
    """Map values through an if/elif chain of membership tests.

    ``null_to_last`` reproduces the source's if/elif behaviour where a missing
    value fails every test and lands in the final branch.
    """
    expr = None
    for values, label in groups:
        cond = c.isin(list(values))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if default is not None:
        expr = expr.when(c.isNotNull(), F.lit(default))
        if null_to_last:
            expr = expr.otherwise(F.lit(default))
    return expr


def season(month: str | Column = "month", preset: str = "code_1_4") -> Column:
    """Four season presets over the month number.

    ``code_1_4``: 1 spring .. 4 winter; ``code_0_3``: 0 winter .. 3 autumn;
    ``label``: Korean labels (unknown month -> 기타); ``detailed``: 7 bands.
    """
    m = col_of(month)
    if preset == "code_1_4":
        return _in_chain(m, [(v, k) for k, v in SEASON_CODE_1_4.items()]).cast("int")
    if preset == "code_0_3":
        return _in_chain(m, [(v, k) for k, v in SEASON_CODE_0_3.items()]).cast("int")
    if preset == "label":
        return _in_chain(m, SEASON_LABELS_KO, default=SEASON_LABEL_OTHER)
    if preset == "detailed":
        # every month outside 12..10 is November in the source chain
        return _in_chain(m, SEASON_DETAILED)
    raise ValueError(f"unknown season preset {preset!r}")


def time_category(hour: str | Column = "hour") -> Column:
    """Right-closed hour cut (-1,6], (6,9], (9,16], (16,19], (19,23]."""
    from .bins import cut
    return cut(hour, TIME_CATEGORY_EDGES, TIME_CATEGORY_LABELS)


def time_group(hour: str | Column = "hour") -> Column:
    return _in_chain(col_of(hour), TIME_GROUPS)


def time_period(hour: str | Column = "hour", null_to_last: bool = False) -> Column:
    return _in_chain(col_of(hour), TIME_PERIODS, default=TIME_PERIOD_DEFAULT, null_to_last=null_to_last)


def rush_flag(hour: str | Column = "hour", preset: str = "model") -> Column:
    return col_of(hour).isin(RUSH_HOURS[preset]).cast("int")


def commute_flags(hour: str | Column = "hour") -> dict[str, Column]:
    h = col_of(hour)
    mc, ec = h.between(7, 9), h.between(17, 19)
    mp, ep = h.between(8, 9), h.between(18, 19)
    return {
        "is_morning_commute": mc.cast("int"),
        "is_evening_commute": ec.cast("int"),
        "is_commute_time": (mc | ec).cast("int"),
        "is_morning_peak": mp.cast("int"),
        "is_evening_peak": ep.cast("int"),
        "is_peak_time": (mp | ep).cast("int"),
    }


def weekend_windows(dow: str | Column = "dayofweek", hour: str | Column = "hour") -> dict[str, Column]:
    we, h = col_of(dow) >= 5, col_of(hour)
    return {
        "is_weekend_peak": (we & (h >= 8)).cast("int"),
        "weekend_hour_8_12": (we & h.between(8, 12)).cast("int"),
        "weekend_hour_13_17": (we & h.between(13, 17)).cast("int"),
        "weekend_hour_18_22": (we & h.between(18, 22)).cast("int"),
    }


def day_hour_combo(dow: str | Column = "dayofweek", hour: str | Column = "hour") -> Column:
    return F.concat_ws("_", col_of(dow).cast("string"), col_of(hour).cast("string"))


def cyclic(value: str | Column, period: float) -> tuple[Column, Column]:
    angle = 2 * math.pi * col_of(value) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def cyclic_features(df: DataFrame, hour="hour", dow="dayofweek", month="month", week=None) -> DataFrame:
    cols = {}
    for name, c, period in [("hour", hour, 24), ("day", dow, 7), ("month", month, 12), ("week", week, 52)]:
        if c is None:
            continue
        s, co = cyclic(c, period)
        cols[f"{name}_sin"], cols[f"{name}_cos"] = s, co
    return df.withColumns(cols)


def recurring_month_days(dates: Sequence[str] = HOLIDAYS) -> list[str]:
    """Month-days that are holidays in every year of the list (fixed-date holidays)."""
    by_year: dict[str, set[str]] = {}
    for d in dates:
        by_year.setdefault(d[:4], set()).add(d[5:])
    sets = list(by_year.values())
    return sorted(set.intersection(*sets)) if sets else []


def holiday_flag(date: str | Column = "date", dates: Sequence[str] = HOLIDAYS, recurring: bool = False) -> Column:
    """1 when the date is in the (bounded, literal) holiday set, else 0.

    A literal IN-set is evaluated inside the scan's codegen stage, so no
    join is needed.  ``recurring`` also flags the fixed-date holidays of any
    year (the month-days present in every listed year).
    """
    d = col_of(date)
    cond = d.isin([F.to_date(F.lit(x)) for x in sorted(set(dates))]) if dates else F.lit(False)
    if recurring:
        cond = cond | F.date_format(d, "MM-dd").isin(recurring_month_days(dates))
    return F.coalesce(cond.cast("int"), F.lit(0))


def holiday_cross(holiday: str | Column = "is_holiday", hour: str | Column = "hour") -> dict[str, Column]:
    h, hol = col_of(hour), col_of(holiday) == 1
    return {
        "is_holiday_and_morning": (hol & h.between(7, 9)).cast("int"),
        "is_holiday_and_evening": (hol & h.between(17, 19)).cast("int"),
    }


def direction_cross(direction: str | Column = "direction", hour: str | Column = "hour",
                    up: str = UP_LINE, down: str = DOWN_LINE) -> dict[str, Column]:
    h, d = col_of(hour), col_of(direction)
    return {
        "is_morning_outer": (h.between(7, 9) & (d == up)).cast("int"),
        "is_evening_inner": (h.between(17, 19) & (d == down)).cast("int"),
    }


def format_stamp(ts: str | Column = "datetime") -> Column:
    """Timestamp -> ``YYYYMMDDHHMM`` string."""
    return F.date_format(col_of(ts), "yyyyMMddHHmm")


def stamp_hour(stamp: str | Column) -> Column:
    """Hour back from a ``YYYYMMDDHHMM`` string (characters 9-10)."""
    return F.substring(col_of(stamp), 9, 2).cast("int")


def date_string(ts: str | Column = "datetime") -> Column:
    return F.date_format(col_of(ts), "yyyy-MM-dd")
