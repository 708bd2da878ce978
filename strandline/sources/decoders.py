"""Row decoders of the filter lists and of nested records: positions and paths as declared, as typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.dates import parse_day
from strandline.functions.text import html_text
from strandline.operators.privacy import ORGANISATION, submitter_class

BASE = "https://www.parlament.gv.at"
#: Clubs that a motion's title may end in.
CLUBS = ["ÖVP", "SPÖ", "FPÖ", "NEOS", "GRÜNE", "JETZT", "PILZ", "STRONACH", "BZÖ", "LIF"]
#: Item types of a statement; anything else is a statement on a draft.
STATEMENT_TYPES = ["SN", "SPET", "SBI"]


def at(cells: Column, i: int) -> Column:
    """Cell ``i`` of a positional row, counted from 0; null beyond its end."""
    return F.get(cells, F.lit(i))


def count_of(cell: Column) -> Column:
    """A whole number, or null for anything else: unread differs from none."""
    return F.when(F.trim(cell).rlike(r"^\d+$"), F.trim(cell).try_cast("long"))


def address(cell: Column, own: Column) -> Column:
    """The row's own path where it is a path of the site or an https address of it, else the path its keys spell."""
    path = F.coalesce(cell, F.lit(""))
    return F.when(path.rlike("^/[^/]"), F.concat(F.lit(BASE), path)).when(path.startswith(BASE + "/"), path).otherwise(F.concat(F.lit(BASE), own))


def own_path(cells: Column, kind: str) -> Column:
    return F.concat(F.lit("/gegenstand/"), at(cells, 0), F.lit(f"/{kind}/"), at(cells, 2))


def draft_rows(rows: DataFrame, cells: str) -> DataFrame:
    """List 81: a draft per row."""
    c = F.col(cells)
    return rows.select(
        at(c, 0).alias("gp"), at(c, 2).try_cast("long").alias("inr"), at(c, 5).alias("citation"), html_text(at(c, 4)).alias("title"), at(c, 6).alias("ministry_code"), at(c, 16).alias("ministry"),
        F.coalesce(parse_day(at(c, 10)), parse_day(at(c, 3))).alias("arrived"), parse_day(at(c, 14)).alias("deadline"), F.coalesce(at(c, 11) == "J", F.lit(False)).alias("active"),
        count_of(at(c, 13)).alias("statements"), address(at(c, 7), own_path(c, "ME")).alias("url"),
    )


def item_rows(rows: DataFrame, cells: str) -> DataFrame:
    """List 101: an item per row; a motion's title loses the clubs it ends in, its vote flag is kept."""
    c = F.col(cells)
    clubs = "|".join(CLUBS)
    title = html_text(at(c, 6))
    motion = at(c, 11) == "A"
    return rows.select(
        at(c, 0).alias("gp"), at(c, 2).try_cast("long").alias("inr"), at(c, 7).alias("citation"), at(c, 11).alias("kind"),
        F.when(motion, F.regexp_replace(title, rf"\s*\((?:{clubs})(?:,\s*(?:{clubs}))*\)\s*$", "")).otherwise(title).alias("title"),
        parse_day(at(c, 8)).alias("day"), at(c, 10).alias("status"), F.when(motion, F.coalesce(at(c, 12) == "1", F.lit(False))).alias("vote_carried"), address(at(c, 14), own_path(c, "I")).alias("url"),
    )


def statement_rows(rows: DataFrame, cells: str, organisation: str = ORGANISATION) -> DataFrame:
    """List 142: a statement per row; its submitter is classed before anything is kept, and only organisations are named."""
    c = F.col(cells)
    raw = F.regexp_replace(html_text(at(c, 6)), r"\s*\(\d+/S(?:N|PET|BI)(?:-[^)]*)?\)\s*$", "")
    kind = submitter_class(raw, at(c, 19) != "P", organisation)
    item = F.when(at(c, 1).isin(STATEMENT_TYPES), at(c, 1)).otherwise(F.lit("SNME"))
    return rows.select(
        at(c, 15).alias("citation"), F.coalesce(parse_day(at(c, 5)), parse_day(at(c, 4))).alias("day"), kind.alias("submitter_class"), F.when(kind == "organisation", raw).alias("organisation"),
        count_of(at(c, 12)).alias("endorsements"), F.concat(F.lit(BASE + "/gegenstand/"), at(c, 0), F.lit("/"), item, F.lit("/"), at(c, 2)).alias("url"),
    )


def participation_rows(rows: DataFrame, cells: str) -> DataFrame:
    """List 143: counts (null where unread) and the open flag."""
    c = F.col(cells)
    return rows.select(at(c, 0).alias("gp"), at(c, 1).alias("item_type"), F.coalesce(count_of(at(c, 2)), F.lit(0)).alias("inr"), at(c, 11).alias("kind"), count_of(at(c, 19)).alias("statements"), count_of(at(c, 20)).alias("support"), F.coalesce(at(c, 23) == "J", F.lit(False)).alias("active"))


def flat_records(rows: DataFrame, text: str, paths: dict[str, tuple[str, str]], many: dict[str, str]) -> DataFrame:
    """Nested records as flat rows: ``paths`` gives name -> (path, type) of single values, ``many`` name -> path of what may be one value, many or none."""
    value = F.try_parse_json(F.col(text))

    def strings(path: str) -> Column:
        one = F.try_variant_get(value, path, "string")
        listed = F.try_variant_get(value, path, "array<string>")
        return F.coalesce(listed, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))

    return rows.select(*[F.try_variant_get(value, path, kind).alias(name) for name, (path, kind) in paths.items()], *[strings(path).alias(name) for name, path in many.items()])
