"""Selection, first-seen distinct and filters on top-level messages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import times
from palaver.schema import UNKNOWN_MONTH


def select_channels(
    messages: DataFrame,
    include: Sequence[str] | DataFrame | None = None,
    exclude: Sequence[str] | None = None,
) -> DataFrame:
    """Keep requested channels. A table of channels becomes a semi-join, a list a pushed-down filter."""
    if isinstance(include, DataFrame):
        messages = messages.join(include.select("channel"), "channel", "left_semi")
    elif include:
        messages = messages.filter(F.col("channel").isin(*include))
    if exclude:
        messages = messages.filter(~F.col("channel").isin(*exclude))
    return messages


def first_seen(
    df: DataFrame,
    keys: Sequence[str] = ("channel", "timestamp"),
    order: Sequence[str | Column] = ("seq",),
) -> DataFrame:
    """One row per key, the first in ``order`` wins.

    Spark keeps only each task's first row per key before the exchange
    (``WindowGroupLimit``), so a key with many copies does not weigh on its reducer.
    ``order`` must be total within a key.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def first_hits(hits: DataFrame, order: str = "seq") -> DataFrame:
    """First-seen distinct for search hits: hits without an id are all kept.

    ``order`` joins the key of id-less rows, which also spreads them over the cluster.
    """
    keyed = hits.withColumn("_solo", F.when(F.col("timestamp") == "", F.col(order)))
    return first_seen(keyed, ("channel", "timestamp", "_solo"), (order,)).drop("_solo")


def with_ids(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("timestamp") != "")


def rejected_messages(messages: DataFrame) -> DataFrame:
    """``channel, seq, reason`` of the messages :func:`with_ids` leaves out, so none goes unreported."""
    reason = F.when(F.coalesce("timestamp", F.lit("")) == "", F.lit("no id"))
    return messages.select("channel", "seq", reason.alias("reason")).filter("reason IS NOT NULL")


def exclude_bots(messages: DataFrame) -> DataFrame:
    """Rows not known to be a bot's stay."""
    return messages.filter(~F.coalesce("is_bot", F.lit(False)))


def _bounds(oldest: str | None, newest: str | None) -> tuple[datetime | None, datetime | None]:
    low, high = times.parse_bound(oldest), times.parse_bound(newest)
    if low and high and low > high:
        raise ValueError("oldest bound lies after newest bound")
    return low, high


def stored_months(messages: DataFrame, column: str, oldest: str | None = None, newest: str | None = None) -> DataFrame:
    """Partition filter implied by the bounds, for tables stored by the month of the id.

    All copies of a message share that month, so this may come before :func:`first_seen`.
    """
    low, high = _bounds(oldest, newest)
    month = F.col(column)
    if low:
        messages = messages.filter((month >= low.strftime("%Y-%m")) | (month == UNKNOWN_MONTH))
    if high:
        messages = messages.filter((month <= high.strftime("%Y-%m")) | (month == UNKNOWN_MONTH))
    return messages


def date_bounds(
    messages: DataFrame,
    oldest: str | None = None,
    newest: str | None = None,
    captured_at: str | None = None,
) -> DataFrame:
    """Keep ``moment >= oldest`` and ``date(moment) <= date(newest)``; undated rows pass.

    The part that depends on the id alone is a filter of its own: it commutes with
    :func:`first_seen` and Catalyst moves it below that exchange.
    """
    low, high = _bounds(oldest, newest)

    def keep(moment: Column) -> Column:
        inside = F.lit(True)
        if low:
            inside = inside & (moment >= times.literal(low))
        if high:
            day_after = datetime.combine(high.date() + timedelta(days=1), time())
            inside = inside & (moment < times.literal(day_after))
        return F.coalesce(inside, F.lit(True))

    if not (low or high):
        return messages
    from_id = times.id_datetime(F.col("timestamp"))
    from_label = times.label_datetime(F.col("datetime"), F.col(captured_at) if captured_at else None)
    return messages.filter(keep(from_id)).filter(from_id.isNotNull() | keep(from_label))


def keyword_match(text: Column, query: str) -> Column:
    """Every whitespace-separated term occurs, ignoring case.

    The matching of the original search lies with a remote server; this is the definition used here.
    """
    terms = query.lower().split()
    if not terms:
        raise ValueError("empty search query")
    match = F.lit(True)
    for term in terms:
        match = match & F.lower(text).contains(term)
    return match


def min_length(messages: DataFrame, characters: int) -> DataFrame:
    return messages.filter(F.length("text") >= characters)
