"""Sinks: feeds, calendars, site maps, strong tags, keyed facts."""

from __future__ import annotations

import time
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.citations import fnv1a64
from strandline.functions.text import ics_escape, xml_escape


def rss_items(df: DataFrame, title: str, link: str, day: str) -> DataFrame:
    """One ``<item>`` per row; the day decides the build date of the feed, so equal rows give equal feeds."""
    stamp = F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT"))
    item = F.concat(F.lit("<item><title>"), xml_escape(F.col(title)), F.lit("</title><link>"), xml_escape(F.col(link)), F.lit("</link><pubDate>"), stamp, F.lit("</pubDate></item>"))
    return df.select(F.col(day).alias("day"), item.alias("item"))


def folded_lines(line: Column) -> Column:
    """Calendar lines folded at 75 octets without splitting a character."""

    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        def fold(line: str | None) -> str | None:
            if line is None:
                return None
            out, size = [], 0
            for c in line:
                n = len(c.encode())
                if size + n > 75:
                    out.append("\r\n ")
                    size = 1
                out.append(c)
                size += n
            return "".join(out)

        return lines.map(fold)

    return run(line)


def ics_events(df: DataFrame, uid: str, day: str, summary: str) -> DataFrame:
    """All-day events."""
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(uid).cast("string")), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd")), folded_lines(F.concat(F.lit("SUMMARY:"), ics_escape(F.col(summary)))), F.lit("END:VEVENT")]
    return df.select(uid, F.array_join(F.array(*lines), "\r\n").alias("event"))


def sitemap(paths: DataFrame, base: str) -> DataFrame:
    """Distinct addresses of a site, escaped."""
    return paths.select(F.concat(F.lit("<url><loc>"), xml_escape(F.concat(F.lit(base), F.col("path"))), F.lit("</loc></url>")).alias("url")).distinct()


def strong_tag(body: Column) -> Column:
    """A strong tag of a body: its FNV-1a hash in 64 bits, quoted."""
    return F.concat(F.lit('"'), fnv1a64(body), F.lit('"'))


def feed_document(items: DataFrame, title: str, link: str) -> DataFrame:
    """One row ``document``: the feed's envelope around its items (pos, day, item), dated by the newest; the items of a feed are few."""
    stamp = F.concat(F.date_format(F.max("day"), "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "")
    head = F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{link}</link><lastBuildDate>')
    return items.agg(F.concat(head, stamp, F.lit("</lastBuildDate>"), listed, F.lit("</channel></rss>")).alias("document"))


def calendar_document(event: Column) -> Column:
    """A calendar of one event: what a subscriber to a draft's deadline gets."""
    return F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//strandline//EN\r\n"), event, F.lit("\r\nEND:VCALENDAR\r\n"))


def upsert(stored: DataFrame | None, fresh: DataFrame, key: list[str], version: int) -> DataFrame:
    """Facts after a refresh: fresh rows win, older ones of the same version stay, others are dropped; incomplete rows are never stored."""
    fresh = fresh.where("complete").withColumn("version", F.lit(version))
    if stored is None:
        return fresh
    kept = stored.where(F.col("version") == version).join(fresh.select(*key), key, "left_anti")
    return fresh.unionByName(kept, allowMissingColumns=True)


def last_good(spark: SparkSession, path: str, fresh) -> tuple[DataFrame, bool]:
    """What ``fresh()`` reads, or the last good snapshot below ``path`` where it fails in any way; and whether it is stale.

    A snapshot is written to a folder of its own first; only then a small table
    of names is appended that says it is the newest. A failed or half-written
    read leaves the one before untouched.
    """
    names = f"{path}/names"
    try:
        folder = f"snapshot-{uuid.uuid4().hex}"
        fresh().write.parquet(f"{path}/{folder}")
        spark.createDataFrame([(time.time_ns(), folder)], "at long, folder string").write.mode("append").parquet(names)
        stale = False
    except Exception:  # noqa: BLE001 - whatever the source raises, the last good snapshot is the answer
        stale = True
    newest = spark.read.schema("at long, folder string").parquet(names).agg(F.max_by("folder", "at")).first()[0]
    return spark.read.parquet(f"{path}/{newest}"), stale


def merged_days(stored: DataFrame, delta: DataFrame, key: list[str], value: str, stamp: str) -> DataFrame:
    """Two partial aggregates of a day as one: counts add up, the later stamp stays."""
    return stored.unionByName(delta).groupBy(*key).agg(F.sum(value).alias(value), F.max(stamp).alias(stamp))


def newest_first(items: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` items in order."""
    return items.orderBy(F.desc("day"), "item").limit(n).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("day"), "item")))
