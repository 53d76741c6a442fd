"""One small row per day from which distinct users and visitors of any span are estimated.

Distinct counts do not add up over days, sketches of them do: `day_sketches` keeps a HyperLogLog
sketch of the addresses and a theta sketch of the visitors of each day. Stored with
`accesslens.sources.writers.write_days`, a question about a month reads 30 rows (16 KB and
up to 512 KB each) and no requests; late requests replace their day only. Sketches combine
on the map side, so a busy address costs a task nothing.

Counts under the sketches' sizes are exact. Above, errors are random but repeat with the data;
`margin` columns are three standard errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accesslens.functions.measures import hits
from accesslens.functions.periods import DateLike, date_lit, request_date
from accesslens.operators.selection import on_days
from accesslens.schema import VISITOR_KEY, require_columns

USERS_LOG2 = 14
VISITORS_LOG2 = 15
#: Standard error of a union of HyperLogLog sketches, times the root of their size.
_HLL_ERROR = 1.04


def day_sketches(log: DataFrame) -> DataFrame:
    """`day, hits, users, visitors`: requests, and sketches of addresses and visitors, per day.

    NULL addresses and visitors with a NULL key part are in no sketch, as in the exact
    operators. A rollup that keeps the visitor columns gives the same rows.
    """
    require_columns(log, VISITOR_KEY)
    visitor = F.concat(F.octet_length("ip").cast("string"), F.lit(":"), *VISITOR_KEY)
    return log.groupBy(request_date(log).alias("day")).agg(
        hits(log).alias("hits"),
        F.hll_sketch_agg("ip", USERS_LOG2).alias("users"),
        F.theta_sketch_agg(visitor, VISITORS_LOG2).alias("visitors"),
    )


def merged_days(sketches: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables as one row per day, for days whose requests arrived in several parts.

    Requests in both parts are distinct users once, but `hits` counts them twice.
    """
    both = sketches.unionByName(more.select(sketches.columns))
    return both.groupBy("day").agg(
        F.sum("hits").alias("hits"),
        F.hll_union_agg("users").alias("users"),
        F.theta_union_agg("visitors", VISITORS_LOG2).alias("visitors"),
    )


def _users(sketch: Column) -> list[Column]:
    users = F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))
    margin = F.ceil(3 * _HLL_ERROR / 2 ** (USERS_LOG2 / 2) * users).cast("bigint")
    return [users.alias("users"), margin.alias("margin")]


def users_per_day(sketches: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`day, users, margin`: estimates for `traffic.unique_users_per_day`."""
    return on_days(sketches, start, end).select("day", *_users(F.col("users"))).orderBy("day")


def users_in(sketches: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`users, margin` of the whole period, in one row."""
    union = on_days(sketches, start, end).agg(F.hll_union_agg("users").alias("users"))
    return union.select(*_users(F.col("users")))


def trailing_users(sketches: DataFrame, start: DateLike, end: DateLike, days: int = 7) -> DataFrame:
    """`day, users, margin`: users of the `days` days up to each day that has requests.

    The window runs over one row per day.
    """
    number = F.unix_date("day")
    before = Window.orderBy(number).rangeBetween(1 - days, 0)
    spans = sketches.where(F.col("day") >= F.date_sub(date_lit(start), days - 1))
    spans = spans.select("day", F.hll_union_agg("users").over(before).alias("users"))
    return on_days(spans, start, end).select("day", *_users(F.col("users"))).orderBy("day")


def visitor_counts(sketches: DataFrame, start: DateLike, end: DateLike) -> DataFrame:
    """`total_visitors, new_visitors, returning_visitors, margin`, as `visitors.visitor_counts`.

    New visitors have no other day up to the end than one in the period: those of a day
    without those of the history, of the days before and of the days after it. The unions
    on either side of each day come from one pass in each direction over the days. `margin`
    holds for all three counts.
    """
    history = on_days(sketches, None, end)
    inside = F.col("day") >= date_lit(start)
    day = F.when(inside, F.col("day"))
    days = history.groupBy(day.alias("day")).agg(F.theta_union_agg("visitors", VISITORS_LOG2).alias("visitors"))
    union = F.theta_union_agg("visitors", VISITORS_LOG2)
    earlier = Window.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.col("day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    around = days.select("day", "visitors", union.over(earlier).alias("before"), union.over(later).alias("after"))
    once = F.theta_difference(F.theta_difference("visitors", "before"), "after")
    in_period = F.when(F.col("day").isNotNull(), F.col("visitors"))
    found = around.agg(
        F.theta_sketch_estimate(F.theta_union_agg(in_period, VISITORS_LOG2)).alias("total"),
        F.sum(F.when(F.col("day").isNotNull(), F.theta_sketch_estimate(once))).alias("new"),
        F.theta_sketch_estimate(F.theta_union_agg("visitors", VISITORS_LOG2)).alias("ever"),
    )
    total, new = F.coalesce("total", F.lit(0)), F.least(F.coalesce("new", F.lit(0)), F.coalesce("total", F.lit(0)))
    # the sketches keep a share of all visitors ever: binomial error of each count
    kept = F.greatest(F.coalesce("ever", F.lit(0)) / 2**VISITORS_LOG2 - 1, F.lit(0.0))
    return found.select(
        total.alias("total_visitors"),
        new.alias("new_visitors"),
        (total - new).alias("returning_visitors"),
        F.ceil(3 * F.sqrt(total * kept)).cast("bigint").alias("margin"),
    )
