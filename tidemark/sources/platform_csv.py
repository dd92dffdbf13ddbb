"""Ad-platform CSV files with unstable headers, resolved to one fact table.

A source is a CSV file or a folder of CSV part files whose name ends in ``.csv``. Header
names never reach Spark's own header handling: one pass over the text finds every part
file's header line and whether quotes stay open at the end of a line, files of one layout
are read together by position with an all-text schema, and layouts are united by canonical
column. Case variants such as ``Revenue`` and ``revenue`` therefore stay distinct, and part
files may order or name their columns differently.
"""

from __future__ import annotations

import csv
import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.operators.promo import small_table

MONEY = "decimal(28,6)"
CANONICAL = ("date", "revenue", "spend", "name", "type")
NEEDED = CANONICAL[:3]


# -- discovery ---------------------------------------------------------------

def source_names(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct top-level ``*.csv`` names (files or folders of parts) below ``folder``."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path")
    )
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    top = F.regexp_extract("path", rf"^\Q{root}\E/([^/]+\.csv)(/|$)", 1)
    return listing.select(top.alias("source_name")).where(F.col("source_name") != "").distinct()


def discover_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One row per platform: the chosen source name and how it was matched.

    The exact name wins; else the first name, in sorted order, of the first
    pattern that matches anything; else no source.
    """
    hits, platforms = [], []
    name = F.col("source_name")
    for position, p in enumerate(cfg.PLATFORMS):
        platforms.append((position, p.channel))
        for rank, (how, pattern) in enumerate([("exact", p.file_name), *(("pattern", g) for g in p.patterns)]):
            like = pattern.replace("_", r"\_").replace("*", "%")
            hits.append(F.when(name.like(like), F.struct(
                F.lit(p.channel).alias("channel"), F.lit(rank).alias("rank"), F.lit(how).alias("matched_by"))))
    matched = source_names(spark, folder).select("source_name", F.inline(F.array_compact(F.array(*hits))))
    best = matched.groupBy("channel").agg(
        F.min(F.struct("rank", "source_name", "matched_by")).alias("hit"))
    return (
        small_table(spark, platforms, "position int, channel string")
        .join(best, "channel", "left")
        .select("position", "channel", "hit.source_name", "hit.matched_by")
    )


# -- headers -------------------------------------------------------------------

def pick(header: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First alias, in alias order, that is present in the header."""
    return next((a for a in aliases if a in header), None)


@dataclass(frozen=True)
class Header:
    """Header of one source: all raw names, and those left after the index column."""

    names: tuple[str, ...]
    skipped: int

    @property
    def columns(self) -> tuple[str, ...]:
        return self.names[self.skipped:]

    def position(self, name: str | None) -> str | None:
        return None if name is None else f"c{self.columns.index(name) + self.skipped}"


def parse_header(line: str, legacy_index: bool = False) -> Header:
    """A header line. A blank or ``Unnamed: 0`` first column is an index; ``legacy_index`` always drops the first column."""
    names = tuple(next(csv.reader([line.lstrip("\ufeff")]), []))
    has_index = bool(names) and names[0].strip() in ("", "Unnamed: 0")
    return Header(names, 1 if names and (legacy_index or has_index) else 0)


@dataclass(frozen=True)
class Layout:
    """Part files with the same header line, and whether their quoted fields hold line breaks."""

    header: Header
    files: tuple[str, ...]
    multi_line: bool


def _literal(path: str) -> str:
    """A path whose signs stand for themselves, not for a pattern of names."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def layouts(spark: SparkSession, path: str, legacy_index: bool = False, multi_line: bool | None = None) -> list[Layout]:
    """The layouts of a source, the most frequent first, from one pass over its text.

    A field with a line break leaves a line with an odd number of quotes. ``multi_line``
    overrides what the quotes say. Empty files have no layout.
    """
    first_block = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    open_quote = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    lines = spark.read.text(_literal(path)).select("value", F.col("_metadata.file_path").alias("file"), first_block.alias("at"),
                                         open_quote.alias("open_quote"))
    files = lines.groupBy("file").agg(F.min_by("value", "at").alias("line"), F.max("open_quote").alias("broken"))
    if multi_line is not None:
        files = files.withColumn("broken", F.lit(multi_line))
    groups = files.groupBy("line", "broken").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy(
        F.size("files").desc(), "line", "broken")
    return [Layout(parse_header(r["line"], legacy_index), tuple(map(unquote, r["files"])), r["broken"]) for r in groups.collect()]


@dataclass(frozen=True)
class Resolved:
    """Which header names carry the canonical columns."""

    date: str | None
    revenue: str | None
    spend: str | None
    name: str | None
    type: str | None

    @property
    def missing(self) -> list[str]:
        return [c for c in NEEDED if getattr(self, c) is None]


def resolve(columns: Sequence[str]) -> Resolved:
    return Resolved(
        date=pick(columns, cfg.DATE_ALIASES),
        revenue=pick(columns, cfg.REVENUE_ALIASES),
        spend=pick(columns, cfg.SPEND_ALIASES),
        name=pick(columns, cfg.NAME_ALIASES),
        type=pick(columns, cfg.TYPE_ALIASES),
    )


def located(spark: SparkSession, folder: str) -> list[tuple[cfg.Platform, str | None]]:
    """Path per platform; the collected rows are one per platform."""
    names = {r["channel"]: r["source_name"] for r in discover_sources(spark, folder).collect()}
    root = folder.rstrip("/")
    return [(p, f"{root}/{names[p.channel]}" if names.get(p.channel) else None)
            for p in cfg.PLATFORMS]


# -- reading and normalising -----------------------------------------------------

def _read(spark: SparkSession, layout: Layout) -> DataFrame:
    """All columns of a layout's files as text, named c0, c1, ... by position.

    Quotes inside quoted fields are doubled and a backslash is an ordinary character.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(layout.header.names))])
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=layout.multi_line).csv(
        [_literal(f) for f in layout.files])


def read_ads_csv(spark: SparkSession, path: str, legacy_index: bool = False,
                 multi_line: bool | None = None) -> tuple[DataFrame, Header]:
    """All columns as text, named by position in the header beside them, which has the names of all layouts.

    Files with line breaks inside quotes are found by themselves and are then not split;
    ``multi_line`` decides for all files.
    """
    parts = layouts(spark, path, legacy_index, multi_line)
    merged = Header(tuple(dict.fromkeys(n for p in parts for n in p.header.columns)), 0)
    data = None
    for part in parts:
        named = [(F.col(part.header.position(n)) if n in part.header.columns else F.lit(None).cast("string")).alias(
            merged.position(n)) for n in merged.names]
        rows = _read(spark, part).select(*named)
        data = rows if data is None else data.unionByName(rows)
    if data is None:
        data = spark.createDataFrame([], T.StructType())
    return data, merged


def canonical_text(spark: SparkSession, platform: cfg.Platform, path: str, legacy_index: bool = False,
                   multi_line: bool | None = None) -> tuple[DataFrame | None, list[tuple[Layout, Resolved]]]:
    """The canonical columns of all usable layouts as text, and what every layout resolves to.

    A layout without a date, revenue or spend column is left out.
    """
    found = [(layout, resolve(layout.header.columns)) for layout in layouts(spark, path, legacy_index, multi_line)]
    data = None
    for layout, got in found:
        if got.missing:
            continue

        def text(name: str | None, header: Header = layout.header) -> Column | None:
            return None if name is None else F.col(header.position(name))

        name = S.clean_label(text(got.name))
        of_name = got.type is None and platform.type_from_name
        rows = _read(spark, layout).select(
            *(text(getattr(got, c)).alias(c) for c in NEEDED), name.alias("name"),
            (S.type_from_prefix(name) if of_name else S.clean_label(text(got.type))).alias("type"))
        data = rows if data is None else data.unionByName(rows)
    return data, found


def spend_is_micros(raw: DataFrame, amount: str):
    """Whether the exact median of ``amount`` exceeds the micros limit, as a scalar subquery.

    Only the comparison is needed, so counting the values above the limit
    decides it, and the two values next to the limit settle an even split.
    Every aggregate is of constant size, whatever the number of rows.
    """
    limit = float(cfg.MICROS_MEDIAN)
    v = F.col(amount)
    counted = raw.agg(
        F.count(v).alias("n"),
        F.count_if(v > limit).alias("above"),
        F.max(F.when(v <= limit, v)).alias("low"),
        F.min(F.when(v > limit, v)).alias("high"),
    )
    middle = (F.col("low") + F.col("high")) / 2.0
    verdict = (
        F.when(F.col("above") * 2 > F.col("n"), True)
        .when(F.col("above") * 2 < F.col("n"), False)
        .otherwise(F.coalesce(middle > limit, F.lit(False)))
    )
    return counted.select(verdict).scalar()


def normalize(spark: SparkSession, platform: cfg.Platform, path: str,
              bad_dates: str = "fail", legacy_index: bool = False, multi_line: bool | None = None,
              date_formats: Sequence[str] = S.SLASHED_DATES) -> DataFrame | None:
    """Canonical facts of one platform, or None when no layout has the needed columns."""
    data, found = canonical_text(spark, platform, path, legacy_index, multi_line)
    for layout, got in found:
        if got.missing:
            warnings.warn(f"{platform.channel}: {len(layout.files)} file(s) without a column for {', '.join(got.missing)} "
                          f"skipped; their header is {list(layout.header.columns)}.", stacklevel=2)
    if data is None:
        return None
    amounts = data.withColumns({c: S.fill_zero(S.coerce_numeric(F.col(c))) for c in ("revenue", "spend")})
    spend = F.col("spend")
    if platform.spend_may_be_micros:
        spend = S.micros_to_units(spend, spend_is_micros(amounts.select("spend"), "spend"))

    def money(c: Column) -> Column:
        return F.coalesce(S.clip_zero(c).try_cast(MONEY), F.lit(0).cast(MONEY))  # beyond all money: not a plain amount

    return amounts.select(
        F.lit(platform.channel).alias("channel"), F.col("type").alias("campaign_type"), F.col("name").alias("campaign_name"),
        S.parse_date(F.col("date"), bad_dates, date_formats).alias("ds"),
        money(F.col("revenue")).alias("revenue"), money(spend).alias("spend"))


def load_platform(spark: SparkSession, folder: str, channel: str, **options) -> DataFrame | None:
    for platform, path in located(spark, folder):
        if platform.channel == channel:
            if path is None:
                warnings.warn(f"{platform.file_name} not found; {channel} skipped.", stacklevel=2)
                return None
            return normalize(spark, platform, path, **options)
    raise ValueError(f"unknown channel {channel!r}")


def load_all(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Facts of every usable platform, tagged with the channel."""
    loaded = []
    for platform, path in located(spark, folder):
        if path is None:
            warnings.warn(f"{platform.file_name} not found; {platform.channel} skipped.", stacklevel=2)
            continue
        facts = normalize(spark, platform, path, **options)
        if facts is not None:
            loaded.append(facts)
    if not loaded:
        wanted = ", ".join(p.file_name for p in cfg.PLATFORMS)
        raise RuntimeError(f"no usable data files in {folder}; expected {wanted}")
    union = loaded[0]
    for facts in loaded[1:]:
        union = union.unionByName(facts)
    return union


# -- what is in the sources -------------------------------------------------------

def _profiled(data: DataFrame, date_formats: Sequence[str]) -> dict[str, tuple[int, int]]:
    """(blank, unreadable) cells of the needed columns and the number of rows, from one pass."""
    def blank(c: str) -> Column:
        return F.col(c).isNull() | F.trim(c).isin(*cfg.NULL_TEXTS)

    readable = {c: S.coerce_numeric(F.col(c)) for c in NEEDED}
    readable["date"] = S.parse_date(F.col("date"), "null", date_formats)
    cells = [F.count(F.lit(1)).alias("n")]
    for c in NEEDED:
        cells += [F.count_if(blank(c)).alias(f"{c}_blank"), F.count_if(~blank(c) & readable[c].isNull()).alias(f"{c}_unreadable")]
    return data.agg(*cells).head().asDict()


_PROFILE = ("channel string, canonical string, header_name string, n_rows long, n_blank long, n_unreadable long")


def resolve_columns(spark: SparkSession, folder: str, legacy_index: bool = False,
                    date_formats: Sequence[str] = S.SLASHED_DATES) -> DataFrame:
    """(channel, canonical, header_name, n_rows, n_blank, n_unreadable) for every platform found.

    Where layouts differ, ``header_name`` lists their names. Labels are never unreadable or
    blank: a missing one has a text of its own.
    """
    rows = []
    for platform, path in located(spark, folder):
        if path is None:
            continue
        data, found = canonical_text(spark, platform, path, legacy_index)
        counts = _profiled(data, date_formats) if data is not None else {}
        for c in CANONICAL:
            names = dict.fromkeys(getattr(got, c) for _, got in found if getattr(got, c) is not None)
            rows.append((platform.channel, c, " | ".join(names) or None, counts.get("n", 0),
                         counts.get(f"{c}_blank", 0), counts.get(f"{c}_unreadable", 0)))
    return spark.createDataFrame(rows, _PROFILE)


#: What a finding says, by its code; filled with its subject and its number.
FINDINGS = {
    "absent": "No file for this platform; it contributes nothing.",
    "other_name": "Read from {subject}, which is not the usual name.",
    "broken": "The source cannot be opened: {subject}",
    "empty": "The source has no line of data.",
    "no_column": "{count} part file(s) lack a column for {subject} and are left out.",
    "mixed": "The part files have {count} different layouts.",
    "line_breaks": "{count} part file(s) hold line breaks inside quotes and are read unsplit.",
    "bad_cells": "{count} cell(s) of {subject} cannot be read.",
    "blank_cells": "{count} cell(s) of {subject} are blank.",
}


def findings(spark: SparkSession, folder: str, legacy_index: bool = False,
             date_formats: Sequence[str] = S.SLASHED_DATES) -> list[tuple]:
    """(channel, path, columns, resolved, n_rows, [(code, subject, count)]) of every platform. Never raises."""
    out = []
    for platform, path in located(spark, folder):
        if path is None:
            out.append((platform.channel, None, None, None, None, [("absent", None, None)]))
            continue
        name, seen = path.rsplit("/", 1)[-1], []
        if name != platform.file_name:
            seen.append(("other_name", name, None))
        try:
            data, found = canonical_text(spark, platform, path, legacy_index)
            counts = _profiled(data, date_formats) if data is not None else {"n": 0}
        except Exception as problem:  # a source that cannot be read is part of the report
            out.append((platform.channel, path, None, None, None, [*seen, ("broken", str(problem).split("\n")[0], None)]))
            continue
        for layout, got in found:
            seen += [("no_column", c, len(layout.files)) for c in got.missing]
        if len({layout.header for layout, _ in found}) > 1:
            seen.append(("mixed", None, len({layout.header for layout, _ in found})))
        if broken := sum(len(layout.files) for layout, _ in found if layout.multi_line):
            seen.append(("line_breaks", None, broken))
        if not counts["n"]:
            seen.append(("empty", None, None))
        for code, kind in (("bad_cells", "unreadable"), ("blank_cells", "blank")):
            seen += [(code, c, counts[f"{c}_{kind}"]) for c in NEEDED if counts.get(f"{c}_{kind}")]
        first = found[0] if found else (Layout(Header((), 0), (), False), Resolved(None, None, None, None, None))
        out.append((platform.channel, path, list(first[0].header.columns), first[1], counts["n"], seen))
    return out


def validate(spark: SparkSession, folder: str, legacy_index: bool = False,
             date_formats: Sequence[str] = S.SLASHED_DATES) -> DataFrame:
    """One row per platform: what was found, what its most frequent layout resolves to, and findings. Never raises."""
    rows = []
    for channel, path, columns, got, n, seen in findings(spark, folder, legacy_index, date_formats):
        notes = [(code, subject, count, FINDINGS[code].format(subject=subject, count=count)) for code, subject, count in seen]
        rows.append((channel, path is not None, path.rsplit("/", 1)[-1] if path else None, columns,
                     *(getattr(got, c, None) for c in NEEDED), n, notes))
    return spark.createDataFrame(
        rows, "channel string, found boolean, source_name string, columns array<string>, date_col string, "
              "revenue_col string, spend_col string, n_rows long, "
              "findings array<struct<code string, subject string, count long, text string>>")


# -- writing facts back in a platform's own layout ---------------------------------

def export_platform_layout(facts: DataFrame, folder: str, channel_of: dict[str, str],
                           names: dict[str, str] | None = None) -> None:
    """Write facts as platform sources (CSV folders); ``channel_of`` maps each wanted
    platform channel to the fact table's channel value, ``names`` to a source name other than the usual."""
    layouts = {
        "bing": dict(TimePeriod="ds", Revenue="revenue", Spend="spend",
                     CampaignType="campaign_type", CampaignName="campaign_name"),
        "meta": dict(date_start="ds", conversion="revenue", spend="spend",
                     campaign_name="concat_ws('_', campaign_type, campaign_name)"),
        "google": dict(segments_date="ds", metrics_conversions_value="revenue",
                       metrics_cost_micros="cast(spend * 1000000 as bigint)",
                       campaign_advertising_channel_type="campaign_type",
                       campaign_name="campaign_name"),
    }
    for platform in (p for p in cfg.PLATFORMS if p.channel in channel_of):
        part = facts.where(F.col("channel") == channel_of[platform.channel])
        columns = [F.expr("monotonically_increasing_id()").alias("Unnamed: 0")]
        columns += [F.expr(e).alias(n) for n, e in layouts[platform.channel].items()]
        part.select(columns).write.options(header=True, quote='"', escape='"').csv(
            f"{folder}/{(names or {}).get(platform.channel, platform.file_name)}")
