"""Table sources and sinks: file listings, projected scans, configs, partitioned output, record text."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from ..functions.text import room_id, safe_folder, video_key


def list_files(spark: SparkSession, root: str, pattern: str, include: list[str] | None = None, exclude: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(media_id, path, length, modified, room_id) of files under ``root``, numbered in the order of their lower-cased path.
    Only the listing is read, not the files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    f = f.select("path", "length", F.col("modificationTime").alias("modified"), room_id(F.col("path")).alias("room_id")).dropDuplicates(["path"])
    if include and include != ["auto"]:
        f = f.filter(F.col("room_id").isin(include))
    if exclude:
        f = f.filter(~F.col("room_id").isin(exclude))
    if limit is not None:
        f = f.orderBy(F.lower("path"), "path").limit(limit)
    # a listing of files, ordered as one sequence of ids
    n = F.row_number().over(Window.orderBy(F.lower("path"), "path"))
    return f.select(F.format_string("media_%06d", n).alias("media_id"), "path", "length", "modified", "room_id")


def hashed_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length, sha256) of files; contents are hashed where they are read and do not travel."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"))


def track_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(video_key, path) of track files: session and video are the two folders above the file; of one video the first path stays."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    p = F.split("path", "/")
    key = video_key(F.element_at(p, -3), F.concat(F.element_at(p, -2), F.lit(".MP4")))
    return f.filter(F.size(p) >= 3).groupBy(key.alias("video_key")).agg(F.min("path").alias("path"))


def read_room_days(spark: SparkSession, path: str, room: str, first: str, last: str, room_col: str = "room_id", time_col: str = "start_time") -> DataFrame:
    """Rows of a CSV table (all texts) of one room whose time text begins with a date from ``first`` to ``last``."""
    t = spark.read.option("header", True).csv(path)
    return t.filter((F.col(room_col) == room) & F.substring(time_col, 1, 10).between(first, last))


def read_fallbacks(spark: SparkSession, text: str) -> DataFrame:
    """(room_id, zone_id, polygon) of a YAML text with manual zones by room; needs a YAML reader."""
    import yaml

    rows = [(room, z["zone_id"], [[float(x) for x in p] for p in z.get("polygon", [])]) for room, zones in ((yaml.safe_load(text) or {}).get("rooms") or {}).items() for z in zones or []]
    return spark.createDataFrame(rows, "room_id string, zone_id string, polygon array<array<double>>")


def cached(df: DataFrame, path: str, fingerprint: str, force: bool = False) -> DataFrame:
    """``df`` from a Parquet copy at ``path`` if that was made with the same fingerprint (of inputs and settings), else made anew. The
    fingerprint is written after the rows, so an unfinished copy is not taken."""
    spark = df.sparkSession
    try:
        known = spark.read.text(f"{path}.fingerprint").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    if force or known is None or known[0] != fingerprint:
        df.write.mode("overwrite").parquet(path)
        spark.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.fingerprint")
    return spark.read.schema(df.schema).parquet(path)


def copy_named(spark: SparkSession, names: dict[str, str], to: str) -> DataFrame:
    """(name, rows) of Parquet tables written again under ``to`` by their names; a table that does not exist has null rows."""
    done = []
    for name, path in names.items():
        try:
            spark.read.parquet(path).write.mode("overwrite").parquet(f"{to}/{name}")
            done.append((name, spark.read.parquet(f"{to}/{name}").count()))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            done.append((name, None))
    return spark.createDataFrame(done, "name string, rows long")


def report(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A Markdown text of bounded tables: aggregates are made in Spark, at most ``most`` rows of each are shown, and a line says how
    many are not."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            out += ["", f"{df.count() - most} more rows are not shown."]
        if not rows:
            out += ["", "No rows."]
    return "\n".join(out) + "\n"


def save_model(path: str, posteriors: DataFrame, parameters: dict[str, DataFrame], about: dict) -> None:
    """A model's posteriors, parameter tables and description under one folder, each as it is written by Spark."""
    posteriors.write.mode("overwrite").parquet(f"{path}/posteriors")
    for name, df in parameters.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = posteriors.sparkSession
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_if_exists(spark: SparkSession, path: str, schema: StructType, kind: str = "csv") -> DataFrame:
    """A table with a fixed schema; empty if there is none."""
    try:
        reader = spark.read.schema(schema)
        return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order; absent ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def read_config(spark: SparkSession, path: str, session: str) -> DataFrame:
    """The config of a session out of a JSON file with one object or a list; an error if there is none."""
    c = spark.read.option("multiLine", True).json(path).filter(F.col("session_id") == session)
    if c.isEmpty():
        raise ValueError(f"no config for session {session}")
    return c


def write_table(df: DataFrame, path: str, csv: bool = False, parquet: bool = True) -> None:
    if parquet:
        df.write.mode("overwrite").parquet(f"{path}.parquet")
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_partitioned(df: DataFrame, path: str, room: str, session: str) -> None:
    """One folder for each room and session, with names that any file system takes."""
    out = df.withColumn("room_folder", safe_folder(F.col(room))).withColumn("session_folder", safe_folder(F.col(session)))
    out.write.mode("overwrite").partitionBy("room_folder", "session_folder").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON text a row; null fields are kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; ``load`` reads JSON and lays overrides over it."""

    window_seconds: float = 30.0
    stride_seconds: float = 10.0
    max_windows: int | None = None
    max_media: int | None = None
    rooms: tuple[str, ...] = ("auto",)
    exclude: tuple[str, ...] = field(default_factory=tuple)
    write_csv: bool = False
    write_parquet: bool = True

    @staticmethod
    def load(text: str, **overrides) -> RunConfig:
        known = set(asdict(RunConfig()))
        found = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in known}
        return replace(RunConfig(**found), **{k: v for k, v in overrides.items() if v is not None})


def stages(names: set[str]) -> list[str]:
    """The stages that the asked ones need, in order."""
    needs = {"index": set(), "zones": {"index"}, "video": {"index", "zones"}, "audio": {"index"}, "environment": set(), "merge": {"video", "audio", "environment"}}
    todo: set[str] = set()

    def add(n: str) -> None:
        for m in needs[n]:
            add(m)
        todo.add(n)

    for n in needs if "all" in names else names:
        add(n)
    return [n for n in needs if n in todo]
