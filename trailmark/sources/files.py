"""Readers and writers for the file layouts of recordings, sessions and results.

All of them return DataFrames with fixed schemas where the layout has one; a header decides only for
sensor tables. NaN becomes NULL on the way in.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.names import behaviour_of, movie_index
from trailmark.model import NON_ANT_LABELS, nan_to_null
from trailmark.operators.intervals import movie_frames

AUTOIDS = "tracklet string, label string, score double, best_frame long"
MANUALIDS = "tracklet string, label string, flip boolean, colony string, m long, len long, framenum long"
TAGGED = "ant string, from long, to long, m long, tracklet string, assigned int, single int, source int"
UNTAGGED = "index long, from long, to long, m long, tracklet string, assigned int, single int, source int"
LABELS = "label string, category string"
IDS_CFG = "command string, colony string, id string, from string, to string"


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return nan_to_null(spark.read.csv(path, schema=schema, sep=sep, header=header, nanValue="NaN", enforceSchema=True))


def read_autoids(spark: SparkSession, path: str) -> DataFrame:
    """autoids_<m>.csv of one or many movies, with the movie m; a best_frame of 0 is none."""
    d = spark.read.csv(path, schema=AUTOIDS, header=True).withColumn("m", movie_index(F.col("_metadata.file_path")))
    return d.withColumn("best_frame", F.when(F.col("best_frame") > 0, F.col("best_frame")))


def read_manualids(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, MANUALIDS)


def read_tracklet_tables(spark: SparkSession, path: str | Sequence[str], *, tagged: bool = True) -> DataFrame:
    """Tracklet tables of many movies, repeated rows (files listed twice) once."""
    d = read_table(spark, path, TAGGED if tagged else UNTAGGED).distinct()
    return d.withColumns({c: F.col(c) == 1 for c in ("assigned", "single", "source")})


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label, category); nonant_labels is another name of noant_labels."""
    d = read_table(spark, path, LABELS, sep="\t")
    return d.withColumn("category", F.when(F.col("category") == "nonant_labels", "noant_labels").otherwise(F.col("category")))


def default_labels(spark: SparkSession) -> DataFrame:
    from trailmark.functions.names import default_ids

    rows = [(i, "ant_labels") for i in default_ids()] + [(x, "noant_labels") for x in NON_ANT_LABELS] + [("Unknown", "other_labels"), ("MultiAnt", "other_labels")]
    return spark.createDataFrame(rows, LABELS)


def read_dat(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Frame data: tab-separated, the header names the sensors, '% framenum' is the frame; sensors are doubles."""
    head = spark.read.csv(path, sep="\t", header=True)
    names = [c.strip().lstrip("%").strip() for c in head.columns]
    names = ["frame" if n == "framenum" else n for n in names]
    keep = [n for n in names if n == "frame" or columns is None or n in columns]
    d = head.toDF(*names)
    return nan_to_null(d.select(*[F.col(n).try_cast("long" if n == "frame" else "double").alias(n) for n in keep]))


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """The table of movies (blank-separated, header first) with running fi and ff; a gap in the index is refused."""
    head = spark.read.csv(path, sep=" ", header=True)
    number = {"index", "nframes", "width", "height", "channels", "fi", "ff"}
    real = {"filesize", "fps", "starttime", "duration"}
    d = head.select(*[F.col(c).try_cast("long" if c in number else "double" if c in real else "string").alias("m" if c == "index" else c) for c in head.columns])
    bad = d.agg(F.max("m") - F.min("m") + 1 - F.count_distinct("m")).first()[0]
    if bad:
        raise ValueError(f"{bad} movies are missing between the first and the last")
    frames = F.coalesce("nframes", F.round(F.col("duration") * F.col("fps")).cast("long"))
    return movie_frames(d.withColumn("nframes", frames).drop("fi", "ff"))


def read_behaviour_scores(spark: SparkSession, path: str, movies: DataFrame, behaviours: Sequence[str] | None = None) -> DataFrame:
    """(behaviour, m, frame, ant, score) of wide score files without a frame column: rows count from the movie's first frame.

    Row numbers come from the position inside each file: a file is one movie.
    """
    from pyspark.sql import Window

    raw = spark.read.csv(path, header=True)
    ants = raw.columns
    w = Window.partitionBy("__p").orderBy("__i")
    d = raw.withColumns({"__p": F.col("_metadata.file_path"), "__i": F.monotonically_increasing_id()})
    d = d.withColumn("mf", F.row_number().over(w).cast("long"))
    d = d.withColumns({"behaviour": behaviour_of(F.col("__p")), "m": movie_index(F.col("__p"))})
    if behaviours:
        d = d.where(F.col("behaviour").isin(*behaviours))
    long = d.unpivot(["behaviour", "m", "mf"], ants, "ant", "score").withColumn("score", F.col("score").try_cast("double"))
    return nan_to_null(long.join(movies.select("m", "fi"), "m").select("behaviour", "m", (F.col("fi") + F.col("mf") - 1).alias("frame"), "ant", "score"))


def write_behaviour_scores(scores: DataFrame, folder: str, behaviour: str) -> None:
    """scores (m, mf, ant, score) as the wide files scores_<behaviour>_<m>.csv, a row per movie frame and no frame column.

    A movie's file is written by the task that holds its rows, and appears under its name when it is whole.
    """
    ants = sorted(r[0] for r in scores.select("ant").distinct().collect())  # the individuals of one colony

    def work(p):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        m = int(p["m"].iloc[0])
        store.create_dir(root, recursive=True)
        wide = p.set_index("mf").sort_index().reindex(range(1, int(p["mf"].max()) + 1))
        draft, path = f"{root}/_{behaviour}_{m}.tmp", f"{root}/scores_{behaviour}_{m}.csv"
        with store.open_output_stream(draft) as out:
            out.write(wide[ants].to_csv(index=False).encode())
        store.move(draft, path)
        return p[["m"]].head(1)

    wide = scores.groupBy("m", "mf").pivot("ant", ants).agg(F.first("score"))
    wide.groupBy("m").applyInPandas(work, "m long").write.format("noop").mode("overwrite").save()


def read_id_commands(spark: SparkSession, path: str, *, colonies: bool = True) -> DataFrame:
    """ids.cfg: 'remove [colony] id from to', blank-separated; without colonies the colony is 'all'."""
    t = spark.read.text(path).where(~F.trim("value").rlike("^(#|$)"))
    p = F.split(F.trim("value"), r"\s+")
    k = 1 if colonies else 0
    col = lambda i: F.get(p, F.lit(i))
    return t.select(F.lower(col(0)).alias("command"), (col(1) if colonies else F.lit("all")).alias("colony"), col(1 + k).alias("id"), col(2 + k).alias("from"), col(3 + k).alias("to"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as bytes with the movie in their name; pixels are for user functions."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", movie_index(F.col("path")).alias("m"))


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files <name>_<m>_p<k>.csv of movies in parts, with m and part."""
    d = spark.read.csv(path, schema=schema, header=True)
    p = F.col("_metadata.file_path")
    return d.withColumns({"m": F.regexp_extract(p, r"_(\d+)_p\d+\.", 1).try_cast("long"), "part": F.regexp_extract(p, r"_p(\d+)\.", 1).try_cast("int")})


def write_by_movie(df: DataFrame, path: str, *, colony: bool = False, format: str = "parquet") -> None:
    """Replace the partitions of the movies that df holds and leave all others."""
    by = ["colony", "m"] if colony else ["m"]
    d = df.repartition(*by).sortWithinPartitions(*by, *[c for c in ("frame",) if c in df.columns])
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(format).save(path)


def read_by_movie(spark: SparkSession, path: str, movies: Sequence[int] | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.where(F.col("m").isin(*movies)) if movies is not None else d


def missing(wanted: DataFrame, done: DataFrame) -> DataFrame:
    return wanted.select("m").distinct().join(done.select("m"), "m", "left_anti")


#: Folders (``colonies``) that the colonies of a movie are dealt to: a recording may hold very many, and a folder of its own costs more than a colony's rows.
FOLDERS = 16


def folder_of(colony: object) -> object:
    """The folder of a colony, for a column or a value; the same for 2 as a number of any type and as text."""
    if isinstance(colony, Column):
        return F.coalesce(F.crc32(colony.cast("string")) % FOLDERS, F.lit(0)).cast("int")
    return zlib.crc32(str(colony).encode()) % FOLDERS


def replace_rows(df: DataFrame, path: str, *key: str) -> None:
    """Replace the stored rows of the keys that df holds and leave all others.

    There is a folder for each key, but for colonies one of ``FOLDERS``, in the files of which they lie in order. What the folders of df's
    keys hold of other colonies is written again beside its rows; so many folders and movies are listed as df has, whatever its rows.
    """
    folders = ["colonies" if c == "colony" else c for c in key]
    d, new = df, None
    if "colony" in key:
        d = df.withColumn("colonies", folder_of(F.col("colony")))
        try:
            old = df.sparkSession.read.parquet(path)
        except AnalysisException:  # nothing is stored
            old = None
        if old is not None:
            if "colonies" not in old.columns:
                raise ValueError(f"{path} has a folder per colony, of an earlier layout")
            old = old.select(*[F.col(c).cast(d.schema[c].dataType).alias(c) if c in d.columns else F.col(c) for c in old.columns])
            new = d.select("colony", *folders).distinct().persist()
            touched = new.agg(*[F.collect_set(c).alias(c) for c in folders]).first()  # as many as there are folders
            for c in folders:
                old = old.where(F.col(c).isNull() | F.col(c).isin(touched[c]))
            same = lambda names: [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in names]
            old = old.alias("o").join(F.broadcast(new.select(*folders).distinct().alias("n")), same(folders), "left_semi")
            d = d.unionByName(old.alias("o").join(new.alias("n"), same(["colony", *folders]), "left_anti"), True)
    if folders:
        d = d.hint("rebalance", *folders).sortWithinPartitions(*folders, *[c for c in ("colony",) if c in key])
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
    if new is not None:
        new.unpersist()


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, node_ids: DataFrame | None = None) -> None:
    """Nodes (tracklet, colony, m, ...), edges (colony, m, src, dst; m is the parent's movie) and the long table of ids, each replaced by colony and movie."""
    tables = {"nodes": nodes, "edges": edges} | ({"node_ids": node_ids} if node_ids is not None else {})
    for name, df in tables.items():
        replace_rows(df, f"{path}/{name}", *[c for c in ("colony", "m") if c in df.columns])


def read_folders(spark: SparkSession, path: str, *wanted: tuple[str, Sequence | None]) -> DataFrame:
    """Parquet stored by ``replace_rows``, with its folders outermost first in ``wanted`` and the values asked for (None: all).

    Folders that are not asked for are not listed, as far as values are given from the outermost on; a recording has very many.
    """
    at = path.rstrip("/")
    for name, values in wanted:
        if not values or not all(isinstance(v, int) or str(v).isidentifier() for v in values):
            break
        if name == "colony":
            name, values = "colonies", sorted({folder_of(v) for v in values})
        at += f"/{name}={{{','.join(map(str, values))}}}"
    try:
        d = spark.read.option("basePath", path).parquet(at)
    except AnalysisException:  # there are none of these
        d = spark.read.parquet(path)
    for name, values in wanted:
        d = d if values is None else d.where(F.col(name).isin(*values))
    return d.drop("colonies")


def read_graph(spark: SparkSession, path: str, table: str, *, colonies: Sequence[int] | None = None, movies: Sequence[int] | None = None) -> DataFrame:
    """A table of a stored graph; colonies and movies choose folders, and colonies parts of their files, so the others are not read."""
    return read_folders(spark, f"{path}/{table}", ("colony", colonies), ("m", movies))


def write_xy(df: DataFrame, path: str) -> None:
    """Trajectories (colony, type, m, ...): final, without propagation or untagged ones in folders of their own; replaced by type, colony and movie."""
    replace_rows(df, path, "type", "colony", "m")


def read_xy(spark: SparkSession, path: str, *, type: str = "final", colony: int | None = None, movies: Sequence[int] | None = None, ants: Sequence[str] | None = None) -> DataFrame:
    d = read_folders(spark, path, ("type", [type]), ("colony", None if colony is None else [colony]), ("m", movies))
    return d if ants is None else d.where(F.col("ant").isin(*ants))


def read_pose(spark: SparkSession, path: str | Sequence[str], movies: Sequence[int] | None = None) -> DataFrame:
    """Pose files turned to Parquet (tracklet, ix, bodypart, x, y, likelihood[, m])."""
    d = nan_to_null(spark.read.parquet(*([path] if isinstance(path, str) else path)))
    return d if movies is None else d.where(F.col("m").isin(*movies))


def append_command(spark: SparkSession, path: str, command: str, tracklet: str, value: object) -> None:
    """One more line 'command tracklet value' of a folder of manual commands; truth values are written as 1 and 0."""
    text = str(int(value)) if isinstance(value, bool) else str(value)
    spark.createDataFrame([(f"{command} {tracklet} {text}",)], "value string").coalesce(1).write.mode("append").text(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="")


@dataclass(frozen=True)
class Parameters:
    """Settings of a session; unknown names of a file are ignored, missing ones keep their defaults."""

    fps: float = 10.0
    scale: float = 1.0
    tracklet_max_length: int = 600
    single_area_min: float = 1e-6
    single_area_max: float = 3.5e-6
    pairs_max_depth: int = 10
    solve_max_rounds: int = 10
    export_soft: bool = True
    export_long_component: int = 2000
    interpolate_max_frames: int = 300
    interpolate_max_distance: float = 0.01

    @classmethod
    def from_json(cls, text: str) -> Parameters:
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in json.loads(text).items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    def as_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, json.dumps(v)) for k, v in asdict(self).items()], T.StructType([T.StructField(c, T.StringType()) for c in ("name", "value")]))
