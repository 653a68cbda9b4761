"""Reading, combining and writing tables."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fungo.functions.numeric import nan_to_null
from fungo.functions.text import english_name, looked_up, translate_team
from fungo.plans.schema import PITCHER_POSITIONS, ROSTER_DASH, ROSTER_LETTERS, ROSTER_POOL, ROSTER_SKIPPED, ROSTER_TITLES


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "csv") -> DataFrame:
    """A headered CSV or stored table with a declared schema; NaN becomes null."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return nan_to_null(reader.load(path))


def union_seasons(frames: dict[int, DataFrame | None], column: str = "season") -> DataFrame:
    """S3: union by name of one frame per season; the column is added only where it is absent.

    A season that is not there yet (None) counts as an empty frame of the others' columns;
    without any season there is nothing to take columns from: a ValueError.
    """
    there = {season: df for season, df in sorted(frames.items()) if df is not None}
    if not there:
        raise ValueError("no season has a table")
    labelled = [df if column in df.columns else df.withColumn(column, F.lit(season)) for season, df in there.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def read_seasons(spark: SparkSession, paths: dict[int, str], schema: T.StructType, fmt: str = "csv", column: str = "season") -> DataFrame:
    """S3 on stored tables: seasons whose path does not exist are tolerated; none at all give an empty table of the same columns."""
    hadoop = spark._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(hadoop).exists(at)

    found = {season: read_table(spark, path, schema, fmt) if exists(path) else None for season, path in paths.items()}
    if not any(df is not None for df in found.values()):
        return spark.createDataFrame([], schema if column in schema.names else T.StructType([*schema.fields, T.StructField(column, T.IntegerType())]))
    return union_seasons(found, column)


def season_window(df: DataFrame, date_column: str, windows: list[tuple[int, str, str]], label: str = "season") -> DataFrame:
    """Rows inside a season's start and end date, both included, labelled by it; the windows are a few rows, so they are one expression in the scan."""
    day = F.to_date(F.col(date_column))
    which = F.coalesce(*(F.when(day.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(s)) for s, a, b in windows))
    return df.withColumn(label, which).filter(F.col(label).isNotNull())


def season_windows(df: DataFrame, date_column: str, windows: DataFrame, label: str = "season", bucket_days: int = 32) -> DataFrame:
    """S4 on a table of windows (`label`, first_day, last_day) of any size: a row for every window that holds the day, both ends included.

    Windows may overlap, and one without a last day is open.  Windows are set out over
    buckets of `bucket_days` days, days fall into one, and the join is by bucket, then
    filtered: no pair of a row and a window further away is made.  Open windows end at the
    table's last day.  Rows without a day, and windows without a label or first day, meet nothing.
    """
    day = F.to_date(F.col(f"`{date_column}`"))
    last_day = df.agg(F.max(day)).scalar()
    bucket = lambda d: F.floor(F.unix_date(d) / bucket_days)
    known = windows.filter(F.col(label).isNotNull() & F.col("first_day").isNotNull()).select(F.col(label).alias("_label"), F.to_date("first_day").alias("_from"), F.to_date("last_day").alias("_to"))
    closed = known.withColumn("_to", F.coalesce("_to", last_day)).filter("_from <= _to")
    spread = closed.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to")))))
    placed = df.withColumns({"_day": day, "_bucket": bucket(day)})
    met = placed.join(spread, "_bucket").filter(F.col("_day").between(F.col("_from"), F.col("_to")))
    return met.withColumn(label, F.col("_label")).drop("_label", "_from", "_to", "_bucket", "_day")


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """DISTINCT of some columns (all, if none is named); null is one value; partial distinct rows are exchanged, not facts."""
    return df.select(*(F.col(f"`{c}`") for c in columns or df.columns)).distinct()


def source_prefix(path, suffix: str):
    """The part of a source's name (see source_of) before its suffix, without underscores at its end."""
    return F.regexp_extract(path, rf"([^/=]*?)_*{re.escape(suffix)}(?:/[^/]*)?$", 1)


def tag_sources(df: DataFrame, prefix: str, source_map: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows of known prefixes with country and country_name; and the unknown prefixes with their row counts."""
    known = df.sparkSession.createDataFrame([(p, *v) for p, v in source_map.items()], "_p string, country string, country_name string")
    tagged = df.join(F.broadcast(known), F.col(prefix) == F.col("_p"), "inner").drop("_p")
    unknown = df.join(F.broadcast(known), F.col(prefix) == F.col("_p"), "left_anti").groupBy(prefix).agg(F.count("*").alias("n_rows"))
    return tagged, unknown


def source_lines(spark: SparkSession, folder: str, suffix: str, exclude: str | None) -> DataFrame:
    """(file, header, line): data lines of all sources `*<suffix>` of a folder without `exclude` in their name, beside their own file's first line.

    A source is a file or a folder of part files, and each part has a header of its own.  The
    first lines are found in the tasks that read them (the least place in a file's first
    block), and meet the lines again by file.  Blank lines, and lines equal to their header,
    are left out.
    """
    lines = spark.read.text(f"{folder}/*{suffix}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    name = F.regexp_extract(F.url_decode("file"), rf"([^/=]*{re.escape(suffix)})(?:/[^/]*)?$", 1)
    lines = lines.filter((name != "") & ~name.contains(exclude) if exclude else name != "")
    heads = lines.filter("block = 0").groupBy("file").agg(F.min_by("line", "place").alias("header"))
    return lines.join(heads, "file").filter("line != header and trim(line) != ''").select("file", "header", "line")


def combine_parts(spark: SparkSession, folder: str, suffix: str, exclude: str | None, source_map: dict[str, tuple[str, str]], schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All sources of a folder (see source_lines), tagged from their prefix; the skipped prefixes; and the rejected lines.

    Columns are matched by the names in each part's own header, so parts of one source may
    differ in columns and order; what a part lacks is null.  Only the distinct headers, as
    many as there are layouts, come to the driver, and all lines are parsed in one scan.
    Rejected (file, line, reason): `fields`, a line of another number of fields than its
    header, which is left out; `type`, a value that its declared type cannot hold, which is
    null in the combined row.  Quoted fields may hold separators, not line ends.
    """
    lines = source_lines(spark, folder, suffix, exclude)
    headers = sorted(r.header for r in lines.select("header").distinct().collect())
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    layouts = [next(csv.reader([h])) for h in headers]
    every = list(dict.fromkeys([*(schema.names if schema is not None and headers else []), *(c for names in layouts for c in names)]))
    if not headers:
        return spark.createDataFrame([], schema or T.StructType()), spark.createDataFrame([], "prefix string, n_rows long"), spark.createDataFrame([], "file string, line string, reason string")
    read = None
    for h, names in zip(headers, layouts):
        ddl = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(len(names))), T.StructField("_bad", T.StringType())])
        own = F.from_csv(F.col("line"), ", ".join(f"{f.name} string" for f in ddl.fields), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        read = (F if read is None else read).when(F.col("header") == h, F.struct(*(own[f"c{names.index(c)}"].alias(f"v{j}") if c in names else F.lit(None).cast("string").alias(f"v{j}") for j, c in enumerate(every)), own["_bad"].alias("_bad")))
    parsed = lines.select("file", "line", source_prefix(F.url_decode("file"), suffix).alias("_prefix"), read.alias("_r"))
    raw = {c: F.col(f"_r.v{j}") for j, c in enumerate(every)}
    value = {c: raw[c].try_cast(types[c]) if c in types else raw[c] for c in every}
    wrong = reduce(lambda x, y: x | y, [raw[c].isNotNull() & value[c].isNull() for c in types if c in raw], F.lit(False))
    reason = F.when(F.col("_r._bad").isNotNull(), "fields").when(wrong, "type")
    good = parsed.filter(F.col("_r._bad").isNull()).select(*(value[c].alias(c) for c in every), "_prefix")
    tagged, unknown = tag_sources(good, "_prefix", source_map)
    rejected = parsed.select("file", "line", reason.alias("reason")).filter("reason is not null")
    return nan_to_null(tagged.drop("_prefix")), unknown.withColumnRenamed("_prefix", "prefix"), rejected


def combine_sources(spark: SparkSession, folder: str, suffix: str, exclude: str | None, source_map: dict[str, tuple[str, str]], schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """The combined rows and the skipped prefixes of combine_parts."""
    return combine_parts(spark, folder, suffix, exclude, source_map, schema)[:2]


def carry_down(rows: DataFrame, group: list[str], chunk: str, place: str, value: str, out: str) -> DataFrame:
    """Beside every row the last non-null `value` at or before it in its group, rows being in order of (chunk, place).

    A scan in three steps, so that a group of any length is many tasks: each chunk's last
    value is one grouped row; a window over these few carries values across chunks; inside a
    chunk a window looks back, and what it does not find is what was carried in.
    """
    held = F.struct(F.col(value).alias("v"))  # a row that has a value, whatever it holds
    ends = rows.groupBy(*group, chunk).agg(F.max_by(F.when(F.col(value).isNotNull(), held), F.when(F.col(value).isNotNull(), F.col(place))).alias("_end"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carries = ends.withColumn("_in", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    inside = Window.partitionBy(*group, chunk).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_own", F.last(F.when(F.col(value).isNotNull(), held), ignorenulls=True).over(inside)).join(carries, [*group, chunk])
    return found.withColumn(out, F.coalesce("_own", "_in")["v"]).drop("_own", "_in")


def roster_rows(lines: DataFrame, file: str, position: str, line: str, countries: dict[str, str], cities: dict[str, str], teams: dict[str, str], chunk: Column | None = None) -> DataFrame:
    """Player rows of sectioned text; a header's country and pool reach down to the next header.

    `chunk` cuts a file into parts that follow each other (by default 65,536 positions each),
    which are scanned side by side (see carry_down).
    """
    text = F.trim(F.regexp_replace(F.col(line), r"^\s+|\s+$", ""))
    part = F.floor(F.col(position) / 65_536) if chunk is None else chunk
    rows = lines.select(F.col(file).alias("_file"), F.col(position).alias("_pos"), text.alias("_line"), part.alias("_chunk"))
    rows = rows.filter(reduce(lambda c, x: c & ~F.col("_line").startswith(x), ROSTER_SKIPPED, F.col("_line") != ""))
    # country（…） — プールX（city） — …
    parts = F.transform(F.split("_line", ROSTER_DASH), lambda x: F.trim(x))
    head, pool = parts[0], F.get(parts, F.lit(1))
    name, letter = F.trim(F.substring_index(head, "（", 1)), F.substring(pool, len(ROSTER_POOL) + 1, 1)
    city = F.substring_index(F.substring_index(pool, "（", -1), "）", 1)
    is_head = (F.size(parts) > 2) & head.like("_%（_%）") & pool.startswith(ROSTER_POOL) & letter.isin(*ROSTER_LETTERS) & F.substring(pool, len(ROSTER_POOL) + 2, 100).like("（_%）")
    section = F.when(is_head, F.struct(looked_up(name, countries, F.lit(None).cast("string")).alias("country"), F.concat(letter, F.lit(" ("), looked_up(city, cities, city), F.lit(")")).alias("pool")))
    rows = carry_down(rows.withColumn("_section", section), ["_file"], "_chunk", "_pos", "_section", "_now")
    fields = F.split("_line", ",")
    players = rows.filter(F.col("_section").isNull() & ~F.col("_line").startswith(ROSTER_TITLES) & (F.size(fields) >= 3) & F.col("_now.country").isNotNull() & (F.trim(fields[0]) != ""))
    return players.select(F.trim(fields[0]).alias("name"), F.col("_now.country").alias("country"), F.col("_now.pool").alias("pool"), F.trim(fields[1]).alias("position"), F.trim(fields[2]).alias("team"), F.trim(F.coalesce(F.get(fields, F.lit(3)), F.lit(""))).alias("on_40_man")).transform(lambda df: normalize_roster(df, teams))


def normalize_roster(df: DataFrame, teams: dict[str, str]) -> DataFrame:
    """English name, translated team, boolean flag, role from the position."""
    pitcher = F.col("position").isin(*PITCHER_POSITIONS)
    return df.withColumns({"name": english_name(F.col("name")), "team": translate_team(F.col("team"), teams), "on_40_man": F.col("on_40_man") == "YES", "role": F.when(pitcher, "pitcher").otherwise("batter")})


def parse_roster(spark: SparkSession, path: str, countries: dict[str, str], cities: dict[str, str], teams: dict[str, str]) -> DataFrame:
    """S5 on files: lines are read by blocks, so one huge file is many tasks; a block is a chunk of carry_down."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    return roster_rows(lines, "file", "place", "line", countries, cities, teams, F.col("block"))


def write_dataset(df: DataFrame, path: str, fmt: str = "csv", partition_by: str | None = None, small: bool = False) -> None:
    """A headered CSV or Parquet dataset; partitions that are written replace their like (refresh by season); one file only where `small` says the result is."""
    out = (df.coalesce(1) if small else df).write.mode("overwrite").option("header", True)
    if partition_by:
        out = out.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    out.format(fmt).save(path)


def write_all(datasets: dict[str, DataFrame], folder: str, suffix: str = "", fmt: str = "csv") -> list[str]:
    """Many datasets in one run; returns their paths."""
    paths = []
    for name, df in sorted(datasets.items()):
        paths.append(f"{folder}/{name}{suffix}")
        write_dataset(df, paths[-1], fmt)
    return paths


def write_facts(df: DataFrame, table: str, path: str, n_buckets: int, keys: tuple[str, ...] = ("pitcher", "season")) -> DataFrame:
    """Facts as a table bucketed and sorted by keys, and the table read back: grouping, windows and joins on the keys need no exchange.

    Each bucket is written by one task, so choose `n_buckets` for buckets of some hundred
    megabytes; rows without a key share a bucket.
    """
    df.repartition(n_buckets, *keys).write.bucketBy(n_buckets, *keys).sortBy(*keys).mode("overwrite").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def drop_index_column(df: DataFrame) -> DataFrame:
    """Without a saved index column."""
    return df.drop("Unnamed: 0", "_c0")
