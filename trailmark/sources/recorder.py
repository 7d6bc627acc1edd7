"""Files of a video recorder: per movie an .npz archive of frame numbers and frame times.

They are read as binary files, so from any store that Spark reads, and as a table or as a stream of files that
arrive. Movies are chosen by file name before a file is opened. Archives hold one movie each; the step to the previous
movie is found from one row per movie.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions.names import movie_index

NUMBERS, TIMES = "frame_number", "frame_time"
FRAMES = "file long, pos long, framenum long, timestamp double, dt double, last double"


def _opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for file, content in zip(part["file"], part["content"], strict=True):
            with np.load(io.BytesIO(content), allow_pickle=False) as z:
                number, time = z[NUMBERS], z[TIMES].astype(float)
            if number.shape != time.shape or number.ndim != 1:
                raise ValueError(f"movie {file}: frame numbers and times differ in length")
            step = np.r_[np.nan, np.diff(time)] if len(time) else time
            yield pd.DataFrame({"file": file, "pos": np.arange(len(number)), "framenum": number.astype(np.int64), "timestamp": time, "dt": pd.Series(step).where(~np.isnan(step), None), "last": time[-1] if len(time) else None})


def read_recorder(spark: SparkSession, path: str, *, movies: Sequence[int] | None = None, stream: bool = False) -> DataFrame:
    """(file, pos, framenum, timestamp, dt, last): a row per frame of the archives <name>_<file>.npz or <file>.npz under path.

    dt is the step inside the file, null at its first frame; last is the file's last timestamp. Files without frames
    give no rows, and one whose arrays differ in length is an error. stream: a stream of these rows as files arrive.
    """
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read).format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true")
    d = reader.load(path)
    where = F.coalesce(movie_index(F.col("_metadata.file_path")), F.regexp_extract("_metadata.file_path", r"(\d+)\.npz$", 1).try_cast("long"))
    if movies is not None:
        d = d.where(where.isin(*movies))
    return d.select(where.alias("file"), "content").mapInPandas(_opened, FRAMES)


def frame_steps(frames: DataFrame) -> DataFrame:
    """(m, frame, framenum, timestamp, dt) of a recording: movies count from 1 in file order, frames through all of them.

    A movie's first dt is the gap to the last frame of the movie before; the first movie's is that of its second frame.
    Files that lack between two others leave a gap in m, as movies are numbered by file. One row per file crosses files.
    """
    files = frames.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last"), F.min(F.when(F.col("pos") == 1, F.col("dt"))).alias("second"))
    w = Window.orderBy("file")
    before = F.lag("last").over(w)
    files = files.select("file", before.alias("before"), F.when(before.isNull(), F.col("second")).alias("second"), (F.sum("n").over(w) - F.col("n")).alias("ahead"), (F.col("file") - F.min("file").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).alias("m"))
    first = F.coalesce(F.col("timestamp") - F.col("before"), F.col("second"))
    return frames.join(files, "file").select("m", (F.col("ahead") + F.col("pos") + 1).alias("frame"), "framenum", "timestamp", F.when(F.col("pos") == 0, first).otherwise(F.col("dt")).alias("dt"))


def movie_folders(movies: DataFrame, *, fps: float, frames_per_file: int, hours: float = 24.0) -> DataFrame:
    """movies (m) with the folder '<first>_<last>' that holds the movies of as many hours; the last folder ends with the last movie."""
    per = fps * 3600 * hours / frames_per_file
    part = F.floor((F.col("m") - 1) / per)
    last = movies.agg(F.max("m")).first()[0]
    lo, hi = F.floor(part * per + 1).cast("long"), F.floor((part + 1) * per).cast("long")
    return movies.withColumn("folder", F.concat_ws("_", lo, F.least(hi, F.lit(last).cast("long"))))


def write_archives(frames: DataFrame, folder: str, name: str) -> None:
    """Archives <name>_<m>.npz of frames (m, framenum, timestamp), each written by the task that holds its movie and named when it is whole."""
    _by_movie(frames.select("m", "framenum", "timestamp"), folder, lambda m: f"{name}_{m}.npz", "timestamp", _npz)


def write_dat(frames: DataFrame, folder: str, name: str) -> None:
    """Tab-separated <folder>/<name>_<m>.dat of frames (m, frame, framenum, timestamp, dt[, folder]), in the layout of frame data."""
    keep = [c for c in ("folder",) if c in frames.columns]
    _by_movie(frames.select("m", "frame", "framenum", "timestamp", "dt", *keep), folder, lambda m: f"{name}_{m}.dat", "frame", _dat)


def _npz(p: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{NUMBERS: p["framenum"].to_numpy(), TIMES: p["timestamp"].to_numpy(float)})
    return out.getvalue()


def _dat(p: pd.DataFrame) -> bytes:
    return p[["framenum", "timestamp", "dt"]].rename(columns={"framenum": "% framenum"}).to_csv(sep="\t", index=False).encode()


def _by_movie(frames: DataFrame, folder: str, named, order: str, content) -> None:
    def work(p: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        p = p.sort_values(order)
        m = int(p["m"].iloc[0])
        at = f"{root}/{p['folder'].iloc[0]}" if "folder" in p else root
        store.create_dir(at, recursive=True)
        draft = f"{at}/_{named(m)}.tmp"
        with store.open_output_stream(draft) as out:
            out.write(content(p))
        store.move(draft, f"{at}/{named(m)}")
        return p[["m"]].head(1)

    frames.groupBy("m").applyInPandas(work, "m long").write.format("noop").mode("overwrite").save()
