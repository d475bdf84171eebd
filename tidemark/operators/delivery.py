"""Delivery records: manifests, checksum files, channel maps, and regression reports, as rows of text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import dims


def checksum_lines(files: DataFrame) -> DataFrame:
    """package, text: the SHA256SUMS text of files (package, name, content), by name."""
    line = F.concat(F.sha2("content", 256), F.lit("  "), F.col("name"))
    return files.groupBy("package").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def manifests(renders: DataFrame, files: DataFrame) -> DataFrame:
    """package, manifest (JSON): a render's record with its files, their sizes and sums, ordered by name.

    A package's files are few; numbers that aren't finite are left out.
    """
    finite = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(F.col(c), 3)).alias(c) if t in ("double", "float") else F.col(c) for c, t in renders.dtypes]
    one = F.struct("name", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    own = files.groupBy("package").agg(F.sort_array(F.collect_list(one)).alias("files"))
    r = renders.select(*finite).join(own, "package", "left")
    return r.select("package", F.to_json(F.struct(*r.columns)).alias("manifest"))


def channel_map(spark: SparkSession) -> DataFrame:
    """layout_id, text: a line for each channel with its number, speaker, angles and label."""
    j = dims.wav_channel_order(spark).join(dims.speakers(spark), "speaker_id")
    line = F.format_string("%2d  %-5s  %7.1f  %8.1f  %4.0f  %-12s", "channel", "speaker_id", "azimuth_adm", "azimuth_hrtf", "elevation", "adm_label")
    lines = F.sort_array(F.collect_list(F.struct("channel", line.alias("line"))))
    return j.groupBy("layout_id", "mask").agg(lines.alias("x")).select("layout_id", "mask", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("text"))


def channel_map_json(spark: SparkSession) -> DataFrame:
    j = dims.wav_channel_order(spark).join(dims.speakers(spark), "speaker_id")
    one = F.struct("channel", "speaker_id", "azimuth_adm", "azimuth_hrtf", "elevation", "lfe", "adm_label", "wav_mask_bit")
    own = j.groupBy("layout_id", "mask", "standard").agg(F.sort_array(F.collect_list(one)).alias("channels"))
    return own.select("layout_id", F.to_json(F.struct("layout_id", F.size("channels").alias("channel_count"), "mask", "standard", "channels")).alias("json"))


def regression_report(flags: DataFrame) -> DataFrame:
    """One line of Markdown for each kind of flag, with its count and the first ids."""
    own = flags.groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return own.select(F.format_string("| %s | %s | %d | %s |", "severity", "kind", "n", F.col("first_id").cast("string")).alias("line"), "severity", "kind", "n")


def unique_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, name, unique_name: names taken in order of the key; one that is taken gets _2, _3 or so before its extension.

    Where no name of the table looks like a numbered one of another, the number is
    the row's place among equal names. Families of names in which some do are
    gone through in order, one task for each family.
    """
    ext = text.extension(F.col(name))
    stem = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(ext))
    root = F.concat(F.regexp_replace(stem, r"(_[0-9]+)+$", ""), F.lit("|"), ext)
    own = rows.select(F.col(key).alias("__key"), F.col(name).alias("__name"), stem.alias("stem"), ext.alias("ext"), root.alias("family"))
    mixed = own.groupBy("family").agg(F.count_distinct("__name").alias("n")).where("n > 1").select("family")
    plain = own.join(mixed, "family", "left_anti").withColumn("place", F.row_number().over(Window.partitionBy("__name").orderBy("__key")))
    numbered = F.concat("stem", F.lit("_"), F.col("place").cast("string"), "ext")
    simple = plain.select("__key", "__name", F.when(F.col("place") == 1, F.col("__name")).otherwise(numbered).alias("unique_name"))

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        pdf = pdf.sort_values("__key")
        for whole, s, e in zip(pdf["__name"], pdf["stem"], pdf["ext"], strict=True):
            got, n = whole, 2
            while got in used:
                got, n = f"{s}_{n}{e}", n + 1
            used.add(got)
            out.append(got)
        return pd.DataFrame({"__key": pdf["__key"], "__name": pdf["__name"], "unique_name": out})

    kind = dict(rows.dtypes)[key]
    rest = own.join(mixed, "family", "left_semi").groupBy("family").applyInPandas(in_order, f"__key {kind}, __name string, unique_name string")
    return simple.unionByName(rest).select(F.col("__key").alias(key), F.col("__name").alias(name), "unique_name")


def summaries(reports: DataFrame) -> DataFrame:
    """One line for each render report: loudness before and after, gain, peak and passes."""
    level = lambda c: F.when(F.col(c).isNull(), "silent").otherwise(F.format_string("%.1f", c))
    return reports.select("clip_id", F.concat_ws(", ", F.concat(level("loudness_before"), F.lit(" to "), level("loudness_after"), F.lit(" LUFS")), F.format_string("gain %.1f dB", "gain_db"), F.format_string("peak %.2f dBTP", "true_peak_db"), F.concat(F.col("passes").cast("string"), F.lit(" passes"))).alias("summary"))


def readme_lines(manifests: DataFrame) -> DataFrame:
    """package, text: a short note for each manifest, a line for each file."""
    m = manifests.select("package", F.from_json("manifest", "files array<struct<name: string, bytes: bigint, sha256: string>>").alias("m"))
    lines = F.transform("m.files", lambda f: F.concat(F.lit("- "), f["name"], F.lit(" ("), f["bytes"].cast("string"), F.lit(" bytes)")))
    return m.select("package", F.concat(F.lit("Delivery "), F.col("package"), F.lit("\n"), F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "\n")).alias("text"))


def serialised_presets(presets: DataFrame) -> DataFrame:
    """preset_id, text: presets (preset_id, name, description, settings) as JSON of schema 3."""
    head = F.struct(F.lit("preset").alias("format"), F.lit(3).alias("schemaVersion"), F.substring("name", 1, 120).alias("name"), F.substring("description", 1, 500).alias("description"), F.col("settings").alias("parameters"))
    return presets.select("preset_id", F.to_json(head).alias("text"))


def package(renders: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Writes a folder of manifests, checksum lists and notes, one row of text for each package; returns the manifests."""
    own = manifests(renders, files)
    for name, rows in (("manifest", own.select("package", F.col("manifest").alias("text"))), ("SHA256SUMS", checksum_lines(files)), ("README", readme_lines(own))):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    return own
