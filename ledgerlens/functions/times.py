"""Time functions as column expressions; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parsed_time(text: Column) -> Column:
    """Epoch seconds or ISO text as RFC 3339 seconds; null if it is neither."""
    epoch = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.timestamp_seconds(F.floor(text.try_cast("double"))))
    return F.date_format(F.coalesce(epoch, F.try_to_timestamp(text)), RFC3339)


def valid_rfc3339(text: Column) -> Column:
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$") & F.try_to_timestamp(text).isNotNull()


def relative_dates(text: Column, anchor: Column) -> Column:
    """Dates named by 'tomorrow', 'yesterday' and ISO dates in the text, as ISO strings."""
    day = F.to_date(anchor)
    low = F.lower(text)
    named = F.array_compact(F.array(F.when(F.contains(low, F.lit("tomorrow")), F.date_add(day, 1).cast("string")), F.when(F.contains(low, F.lit("yesterday")), F.date_sub(day, 1).cast("string"))))
    return F.concat(named, F.regexp_extract_all(text, F.lit(r"\b20[0-9][0-9]-[0-9][0-9]-[0-9][0-9]\b"), F.lit(0)))


def temporal_filter(query: Column) -> Column:
    """'historical' for words about the past, and the first year or month named."""
    since = F.regexp_extract(query, r"\b(20[0-9][0-9](-[0-9][0-9])?)\b", 1)
    return F.struct(F.lower(query).rlike(r"\b(previous|previously|before|earlier)\b").alias("historical"), F.when(since != "", since).alias("since"))


def lease_until(start: Column, seconds: Column) -> Column:
    return start + F.make_interval(secs=seconds)


def as_of(start: Column, until: Column, at: Column) -> Column:
    """Whether a version was current at a time."""
    return (start <= at) & (until.isNull() | (at < until))
