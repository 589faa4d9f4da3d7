"""Reports of a crawl: fetch results, status codes, content types."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import long_report


def status_phrase(status: Column) -> Column:
    """``404 Not Found``; a code that HTTP does not name stands alone."""
    names = F.create_map(*(F.lit(x) for s in HTTPStatus for x in (int(s), s.phrase)))
    return F.concat_ws(" ", status.cast("string"), F.try_element_at(names, status.cast("int")))


def media_type(content_type: Column) -> Column:
    """Without parameters: what stands before the first semicolon, in lower case."""
    return F.lower(F.trim(F.split(content_type, ";")[0]))


def kept_type(content_type: Column, types: tuple[str, ...] = ("text/html", "application/pdf", "application/msword"), families: tuple[str, ...] = ("image",)) -> Column:
    """Whether a crawl keeps the content: one of the types, or of a family of types."""
    kind = media_type(content_type)
    return F.coalesce(kind.isin(*types) | F.split(kind, "/")[0].isin(*families), F.lit(False))


def fetch_report(fetches: DataFrame, visits: DataFrame) -> DataFrame:
    """(section, metric, n) of fetches (url, status) and visits (url, content_type): below 300 a fetch has succeeded, above it has failed."""
    totals = fetches.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("status") < 300).alias("succeeded"), F.count_if(F.col("status") > 300).alias("failed"))
    names = ("attempted", "succeeded", "failed")
    fetch = totals.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("metric", "n"))
    status = fetches.groupBy(status_phrase(F.col("status")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    types = visits.groupBy(media_type(F.col("content_type")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return long_report(fetch=fetch, status=status, content=types)
