"""Readers of call files and imports: file-name masks, recorder JSON, CSV lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The tokens of a file-name mask and what each of them stands for.
MASK_TOKENS = {
    "#DATE": r"\d{4}[-_/]?\d{2}[-_/]?\d{2}", "#TIME": r"\d{2}[-_:]?\d{2}[-_:]?\d{2}", "#ZTIME": r"\d{2}[-_:]?\d{2}[-_:]?\d{2}", "#GROUP": r"[^_/]+?", "#HZ": r"\d+", "#KHZ": r"[\d.]+", "#MHZ": r"[\d.]+", "#SITE": r"\d+",
    "#SITELBL": r"[^_/]+?", "#SYS": r"\d+", "#SYSLBL": r"[^_/]+?", "#TAG": r"[^_/]+?", "#TG": r"\d+", "#TGAFS": r"\d{2}-\d{3}", "#TGHZ": r"\d+", "#TGKHZ": r"[\d.]+", "#TGLBL": r"[^_/]+?", "#TGMHZ": r"[\d.]+", "#UNIT": r"\d+", "#UNITLBL": r"[^_/]+?",
}


def compile_mask(mask: str) -> tuple[str, list[str]]:
    """One regular expression for a mask, and its tokens in the order of their groups.  Longer tokens are looked for first."""
    names = sorted(MASK_TOKENS, key=len, reverse=True)
    found: list[str] = []
    out = []
    for part in re.split("(" + "|".join(names) + ")", mask):
        if part in MASK_TOKENS:
            found.append(part)
            out.append(f"({MASK_TOKENS[part]})")
        else:
            out.append(re.escape(part))
    return "^" + "".join(out) + r"(?:\.[A-Za-z0-9]+)?$", found


def parse_mask(name: Column, mask: str) -> dict[str, Column]:
    """Typed columns from a file name: ts_ms, frequency (Hz), system, talkgroup, unit, site and labels; null where the mask has no such token or the name does not fit."""
    pattern, tokens = compile_mask(mask)

    def part(token: str) -> Column:
        if token not in tokens:
            return F.lit(None).cast("string")
        return F.nullif(F.regexp_extract(name, pattern, tokens.index(token) + 1), F.lit(""))

    digits = lambda t: F.regexp_replace(part(t), "[^0-9]", "")
    whole = lambda t: F.try_to_number(part(t), F.lit("9" * 18)).cast("bigint")
    scaled = lambda t, by: F.round(part(t).try_cast("double") * by).cast("bigint")
    afs = F.shiftleft(F.split_part(part("#TGAFS"), F.lit("-"), F.lit(1)).try_cast("int"), 7).bitwiseOR(F.split_part(part("#TGAFS"), F.lit("-"), F.lit(2)).try_cast("int"))
    clock = F.coalesce(digits("#TIME"), digits("#ZTIME"))
    stamp = F.try_to_timestamp(F.concat(digits("#DATE"), clock), F.lit("yyyyMMddHHmmss"))
    return {
        "ts_ms": F.unix_millis(stamp),
        "frequency": F.coalesce(whole("#HZ"), scaled("#KHZ", 1_000), scaled("#MHZ", 1_000_000)),
        "system": whole("#SYS"),
        "talkgroup": F.coalesce(whole("#TG"), afs.cast("bigint"), whole("#TGHZ"), scaled("#TGKHZ", 1_000), scaled("#TGMHZ", 1_000_000)),
        "unit": whole("#UNIT"),
        "site": whole("#SITE"),
        "system_label": part("#SYSLBL"),
        "talkgroup_label": part("#TGLBL"),
        "unit_label": part("#UNITLBL"),
        "site_label": part("#SITELBL"),
        "tag": part("#TAG"),
        "group": part("#GROUP"),
    }


RECORDER = "freqList array<struct<freq:bigint,len:double>>, patched_talkgroups array<bigint>, srcList array<struct<src:bigint,pos:double,tag:string>>, start_time bigint, talkgroup bigint, talkgroup_tag string, short_name string"


def parse_recorder(json: Column) -> Column:
    """Recorder JSON as a struct: the first frequency, positive patches, sources from 0 on, start in ms."""
    j = F.from_json(json, RECORDER)
    return F.struct(
        F.get(j["freqList"], F.lit(0))["freq"].alias("frequency"),
        F.coalesce(F.filter(j["patched_talkgroups"], lambda p: p > 0), F.array().cast("array<bigint>")).alias("patches"),
        F.coalesce(F.filter(j["srcList"], lambda s: s["src"] >= 0), F.array().cast("array<struct<src:bigint,pos:double,tag:string>>")).alias("units"),
        (j["start_time"] * 1000).alias("ts_ms"),
        j["talkgroup"].alias("talkgroup"),
        j["talkgroup_tag"].alias("tag"),
        j["short_name"].alias("system_label"),
    )


def parse_recorder_path(path: Column) -> dict[str, Column]:
    """Date from the folder, time from the name's first six digits, talkgroup and unit from its last two parts."""
    folder = F.regexp_extract(path, r"(\d{8})/[^/]+$", 1)
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1), r"\[[^\]]*\]", "")
    parts = F.split(name, "_")
    return {
        "ts_ms": F.unix_millis(F.try_to_timestamp(F.concat(folder, F.regexp_extract(name, r"^(\d{6})", 1)), F.lit("yyyyMMddHHmmss"))),
        "talkgroup": F.try_element_at(parts, F.lit(-2)).try_cast("bigint"),
        "unit": F.try_element_at(parts, F.lit(-1)).try_cast("bigint"),
    }


def header_key(name: str) -> str:
    """Blanks, dashes and underscores of a header do not count."""
    return re.sub(r"[ _\-﻿]", "", name).lower()


def first_per_ref(rows: DataFrame, ref: str, place: str) -> DataFrame:
    """The first row of each numeric reference, in the file's order."""
    numeric = rows.where(F.col(ref).rlike(r"^\d+$"))
    return numeric.withColumn("__n", F.row_number().over(Window.partitionBy(ref).orderBy(place))).where("__n = 1").drop("__n")


def read_list(spark: SparkSession, path: str, columns: dict[int, str]) -> DataFrame:
    """A headless CSV as named string columns, with its lines' order; one row for each reference (the first column)."""
    most = max(columns) + 1
    raw = spark.read.option("header", False).schema(", ".join(f"_c{i} string" for i in range(most))).csv(path)
    placed = raw.withColumn("place", F.monotonically_increasing_id())
    named = placed.select("place", *[F.trim(f"_c{i}").alias(n) for i, n in columns.items()])
    return first_per_ref(named, next(iter(columns.values())), "place")


def talkgroup_list(spark: SparkSession, path: str) -> DataFrame:
    return read_list(spark, path, {0: "ref", 2: "label", 4: "name", 5: "tag", 6: "groups"})


def unit_list(spark: SparkSession, path: str) -> DataFrame:
    return read_list(spark, path, {0: "ref", 1: "label"})


# Headers that a tone list may use for each field.
TONE_HEADERS = {"label": ("label", "name", "description"), "a": ("atone", "a", "tone1", "atonehz"), "b": ("btone", "b", "tone2", "btonehz"), "long": ("longtone", "long", "longtonehz"), "tolerance": ("tolerance", "tol")}


def tone_list(spark: SparkSession, path: str) -> DataFrame:
    """label, a, b, long, tolerance (Hz) and a warning for each line of a tone CSV, whatever its headers are called."""
    raw = spark.read.option("header", True).csv(path)
    known = {header_key(c): c for c in raw.columns}

    def field(name: str) -> Column:
        found = [F.col(f"`{known[h]}`") for h in TONE_HEADERS[name] if h in known]
        return F.nullif(F.trim(F.coalesce(*found)), F.lit("")) if found else F.lit(None).cast("string")

    out = raw.select(field("label").alias("label"), *[field(n).try_cast("double").alias(n) for n in ("a", "b", "long", "tolerance")])
    warning = F.when(F.col("a").isNull() & F.col("b").isNull() & F.col("long").isNull(), "no tones").when((F.col("b").isNotNull()) & F.col("a").isNull(), "B tone without A tone")
    return out.withColumn("label", F.coalesce("label", F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")))).withColumn("warning", warning)
