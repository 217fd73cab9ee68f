"""Readers of the formats that recordings' tools write, as DataFrames. Bad rows are dropped by rule, never by failure.

``file`` is a file's whole path, so files of one name in two folders are two recordings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def diarizer_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, speaker, start_s, end_s) of files {"duration": d, "segments": [{speaker, start, end}]}.

    Times that aren't finite numbers and turns without a length go; turns are clamped to the duration where it is
    known, and speakers are named S1, S2, ... in the order in which they first speak.
    """
    rows = spark.read.schema("duration double, segments array<struct<speaker:string,start:string,end:string>>").option("multiLine", True).json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), "duration", F.explode("segments").alias("s"))
    time = lambda c: F.when(F.col(c).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.col(c).try_cast("double"))
    end = F.when(F.col("duration") > 0, F.least(time("s.end"), "duration")).otherwise(time("s.end"))
    rows = rows.select("file", F.col("s.speaker").alias("raw"), F.greatest(F.lit(0.0), time("s.start")).alias("start_s"), end.alias("end_s"), time("s.start").alias("given"))
    rows = rows.filter("given is not null and end_s is not null and end_s > start_s").drop("given")
    first = rows.groupBy("file", "raw").agg(F.min(F.struct("start_s", "end_s")).alias("first"))
    label = F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("file").orderBy("first", "raw")).cast("string"))
    names = first.select(F.col("file").alias("f"), F.col("raw").alias("r"), label.alias("speaker"))
    return rows.join(names, (F.col("file") == F.col("f")) & F.col("raw").eqNullSafe(F.col("r"))).select("file", "speaker", "start_s", "end_s")


def rttm(spark: SparkSession, path: str) -> DataFrame:
    """(recording, speaker, start_s, end_s) of RTTM lines of type SPEAKER; lines with too few fields or without numbers go."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).filter((F.get("f", F.lit(0)) == "SPEAKER") & (F.size("f") >= 8))
    start, length = F.get("f", F.lit(3)).try_cast("double"), F.get("f", F.lit(4)).try_cast("double")
    out = rows.select(F.get("f", F.lit(1)).alias("recording"), F.get("f", F.lit(7)).alias("speaker"), start.alias("start_s"), (start + length).alias("end_s"))
    return out.filter("start_s is not null and end_s > start_s")


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with a list of timestamps and speakers, one row per turn: recording, speaker, start_s, end_s."""
    rows = spark.read.parquet(path).select("recording", F.explode(F.arrays_zip("timestamps_start", "timestamps_end", "speakers")).alias("z"))
    return rows.select("recording", F.col("z.speakers").alias("speaker"), F.col("z.timestamps_start").alias("start_s"), F.col("z.timestamps_end").alias("end_s"))


def transcription_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, start_s, end_s, text) of results {"segments": [{start, end, text}]} or {"text": ...} alone, which is one row without times."""
    rows = spark.read.schema("text string, segments array<struct<start:double,end:double,text:string>>").option("multiLine", True).json(path)
    none = F.lit(None).cast("double")
    alone = F.array(F.struct(none.alias("start"), none.alias("end"), F.col("text")))
    some = F.when(F.coalesce(F.size("segments"), F.lit(0)) > 0, F.col("segments")).otherwise(alone)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode(some).alias("n", "s"))
    return rows.select("file", "n", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.trim("s.text").alias("text")).filter("text <> ''")


def model_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(model, seq, name, status, capable) of a catalog {"models": [{id, name, status, capabilities}]}."""
    from parley.functions.words import model_status

    rows = spark.read.schema("models array<struct<id:string,name:string,status:string,capabilities:array<string>>>").option("multiLine", True).json(path)
    rows = rows.select(F.posexplode("models").alias("seq", "m"))
    return rows.select(F.col("m.id").alias("model"), "seq", F.coalesce("m.name", "m.id").alias("name"), model_status(F.col("m.status")).alias("status"), F.coalesce(F.array_contains("m.capabilities", "transcribe"), F.lit(False)).alias("capable"))


def probe_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per media probe: the longest duration, whether there is sound, and the size of the first real video, turned if it is rotated."""
    stream = "struct<codec_type:string,width:int,height:int,duration:string,disposition:struct<attached_pic:int>,tags:struct<rotate:string>>"
    rows = spark.read.schema(f"streams array<{stream}>, format struct<duration:string>").option("multiLine", True).json(path)
    video = F.get(F.filter("streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)), F.lit(0))
    longest = F.array_max(F.transform("streams", lambda s: s["duration"].try_cast("double")))
    turned = F.coalesce(F.pmod(video["tags"]["rotate"].try_cast("int"), F.lit(180)) == 90, F.lit(False))
    w, h = video["width"], video["height"]
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.greatest(F.col("format.duration").try_cast("double"), longest).alias("duration_s"),
        F.exists("streams", lambda s: s["codec_type"] == "audio").alias("sound"), F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"),
    )


def progress_lines(spark: SparkSession, path: str, duration_s: float) -> DataFrame:
    """(n, permille) of progress lines like out_time_us=123 or time=00:01:02.5, in the order of the file."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))
    us = F.nullif(F.regexp_extract("value", r"out_time_(?:us|ms)=(\d+)", 1), F.lit("")).try_cast("double") / 1e6
    part = lambda i: F.regexp_extract("value", r"time=(\d+):(\d+):(\d+(?:\.\d+)?)", i).try_cast("double")
    clock = part(1) * 3600 + part(2) * 60 + part(3)
    s = F.coalesce(us, clock)
    return rows.select("n", F.when(s.isNotNull(), F.least(F.lit(1000), F.floor(1000 * s / duration_s))).cast("int").alias("permille")).filter("permille is not null")


def metadata_header(header: Column) -> Column:
    """The pairs of a header "key b64,key2 b64" as a map; a key without a value has an empty one. Null for a header with a value
    that doesn't decode, with more than a key and a value in a pair, or with a key twice: it is refused as a whole."""
    pair = F.filter(F.transform(F.split(header, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda p: F.get(p, F.lit(0)) != "")
    value = lambda p: F.coalesce(F.get(p, F.lit(1)), F.lit(""))
    fine = F.forall(pair, lambda p: (F.size(p) <= 2) & value(p).rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"))
    once = F.size(F.array_distinct(F.transform(pair, lambda p: F.get(p, F.lit(0))))) == F.size(pair)
    whole = F.transform(pair, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.decode(F.unbase64(value(p)), "utf-8").alias("value")))
    return F.when(fine & once, F.map_from_entries(F.when(fine & once, whole)))


def scene_scores(spark: SparkSession, path: str) -> DataFrame:
    """(t_s, score) of a metadata stream that names a frame's time and then its score: each time takes the next score before another time."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_path").alias("file"))
    number = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit("")).try_cast("double")
    rows = rows.select("file", "n", number(r"pts_time:\s*(-?\d+(?:\.\d+)?)").alias("t_s"), number(r"scene_score=(\d+(?:\.\d+)?)").alias("score")).filter("t_s is not null or score is not null")
    order = Window.partitionBy("file").orderBy("n")
    return rows.withColumn("next", F.lead("score").over(order)).filter("t_s is not null and next is not null").select("file", "t_s", F.col("next").alias("score"))
