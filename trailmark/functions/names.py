"""Texts that name things: movie lists, times, tracklets, options, commands."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.model import TAG_COLOURS


def parse_movlist(text: str | int | list[int] | None, known: list[int] | None = None) -> list[int]:
    """'4', '3,5,6', '1-5,7', 'all', an int or a list: ascending movie numbers without repeats."""
    if text is None or text == "all":
        return sorted(set(known or []))
    if isinstance(text, int):
        return [text]
    if isinstance(text, list):
        return sorted(set(text))
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        if not re.fullmatch(r"\d+(-\d+)?", part):
            raise ValueError(f"no movie list: {text!r}")
        a, _, b = part.partition("-")
        out.update(range(int(a), int(b or a) + 1))
    return sorted(out)


def movies_of(text: Column) -> Column:
    """The same for a column: an ascending array of movie numbers."""
    part = F.split(F.replace(text, F.lit(" ")), ",")
    one = lambda p: F.sequence(F.split(p, "-")[0].cast("long"), F.coalesce(F.get(F.split(p, "-"), F.lit(1)), F.split(p, "-")[0]).cast("long"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(part, lambda p: p != ""), one))))


def movlist_text(df: DataFrame, key: str, m: str = "m") -> DataFrame:
    """(key, movies): movie numbers of each key with runs written as a-b."""
    w = Window.partitionBy(key).orderBy(m)
    runs = df.select(key, m).distinct().withColumn("__r", F.col(m) - F.row_number().over(w))
    r = runs.groupBy(key, "__r").agg(F.min(m).alias("a"), F.max(m).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return r.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x.t), ",").alias("movies"))


def parse_tracklet_name(name: Column, *, end_movie: bool = True) -> dict[str, Column]:
    """trj_<id>_ti<m>_<mf>_tf<m>_<mf>: m1, mf1, m2, mf2. Without end_movie the start movie stands for both."""
    p = F.split(name, "_")
    m1 = F.substr(F.get(p, F.lit(2)), F.lit(3)).cast("long")
    m2 = F.substr(F.get(p, F.lit(4)), F.lit(3)).cast("long") if end_movie else m1
    return {"m1": m1, "mf1": F.get(p, F.lit(3)).cast("long"), "m2": m2, "mf2": F.get(p, F.lit(5)).cast("long")}


def tracklet_name(number: Column, m1: Column, mf1: Column, m2: Column, mf2: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.concat(F.lit("trj_id"), s(number), F.lit("_ti"), s(m1), F.lit("_"), s(mf1), F.lit("_tf"), s(m2), F.lit("_"), s(mf2))


def parse_times(commands: DataFrame, movies: DataFrame, columns: tuple[str, str] = ("from", "to")) -> DataFrame:
    """commands with fi and ff for the texts start, end, f<n>, m<n>, m<n>f<k>; a bare movie ends with its last frame.

    Malformed texts give NULL. Movies are joined by number.
    """
    ends = movies.agg(F.min("fi").alias("__first"), F.max("ff").alias("__last"))
    d = commands.join(F.broadcast(ends))  # one row
    for c, out, last in ((columns[0], "fi", False), (columns[1], "ff", True)):
        t = F.lower(F.trim(c))
        m, f = F.regexp_extract(t, r"^m(\d+)", 1), F.regexp_extract(t, r"^(?:m\d+)?f(\d+)$", 1)
        d = d.withColumns({"__m": F.when(t.rlike(r"^m\d+(f\d+)?$"), m.cast("long")), "__f": F.when(f != "", f.cast("long")), "__t": t})
        mv = movies.select(F.col("m").alias("__m"), F.col("fi").alias("__fi"), F.col("ff").alias("__ff"))
        d = d.join(mv, "__m", "left")
        whole = F.col("__ff") if last else F.col("__fi")
        value = (
            F.when(F.col("__t") == "start", F.col("__first")).when(F.col("__t") == "end", F.col("__last"))
            .when(F.col("__m").isNotNull(), F.when(F.col("__f").isNotNull(), F.col("__fi") + F.col("__f") - 1).otherwise(whole))
            .otherwise(F.col("__f"))
        )
        d = d.withColumn(out, value).drop("__m", "__f", "__t", "__fi", "__ff")
    return d.drop("__first", "__last")


def parse_properties(lines: DataFrame, line: str = "line") -> DataFrame:
    """(command, tracklet, value) of lines 'command tracklet value'; empty lines and # comments go."""
    p = F.split(F.trim(line), r"\s+", 3)
    d = lines.where(~F.trim(line).rlike("^(#|$)"))
    return d.select(F.lower(F.get(p, F.lit(0))).alias("command"), F.get(p, F.lit(1)).alias("tracklet"), F.regexp_replace(F.coalesce(F.get(p, F.lit(2)), F.lit("")), r"\s", "").alias("value"))


def parse_options(text: Column) -> Column:
    """'a=1,b=x' as a map."""
    return F.str_to_map(F.replace(text, F.lit(" ")), F.lit(","), F.lit("="))


def all_possible_ids(colours: DataFrame, column: str = "colour") -> DataFrame:
    """(id) for every ordered pair of tag colours, equal ones included (a colour list is a handful of rows)."""
    every = colours.agg(F.array_sort(F.collect_set(column)).alias("c"))
    a = every.select(F.explode("c").alias("a"), "c")
    return a.select("a", F.explode("c").alias("b")).select(F.concat("a", "b").alias("id"))


def default_ids() -> list[str]:
    return [a + b for a in TAG_COLOURS for b in TAG_COLOURS]


def movie_index(path: Column) -> Column:
    """The number behind the last underscore of a file name."""
    return F.regexp_extract(path, r"_(\d+)\.[^./]+$", 1).try_cast("long")


def behaviour_of(path: Column) -> Column:
    """scores_<behaviour>_<m>.csv; the behaviour may hold underscores."""
    return F.regexp_extract(path, r"scores_(.+)_\d+\.csv$", 1)


def subdir(m: Column, size: int) -> Column:
    """The folder 'a_b' of a movie, with a..b the numbers that share it."""
    a = F.floor((m - 1) / size).cast("long") * size
    return F.concat_ws("_", (a + 1).cast("string"), (a + size).cast("string"))
