"""Readers: annotated sources in their own layouts, as one record table.

Every reader gives an explicit schema and never infers one. Files are read by Spark, so paths may
be of any store that Spark reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

BOX = T.ArrayType(T.DoubleType())
RECORD = T.StructType(
    [
        T.StructField("image_id", T.StringType(), False),
        *[T.StructField(n, T.StringType()) for n in ("path", "source", "group_id", "license")],
        T.StructField("train_commercial_ok", T.BooleanType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("attribution", T.StringType()),
        T.StructField("split_hint", T.StringType()),
        T.StructField("frame_label", T.IntegerType()),
        T.StructField("boxes", T.ArrayType(BOX)),
        T.StructField("box_labels", T.ArrayType(T.StringType())),
        T.StructField("box_is_animal", T.ArrayType(T.BooleanType())),
        T.StructField("boxes_exhaustive", T.BooleanType()),
        T.StructField("mask_path", T.StringType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("t_sec", T.DoubleType()),
        T.StructField("url", T.StringType()),
        T.StructField("labeled", T.BooleanType()),
        T.StructField("extra", T.StringType()),
    ]
)
#: Metrics that a curated index has beside its records.
METRICS = ("lum_mean", "lum_p95", "contrast", "norm_contrast", "haze", "cast_mag", "cast_hue", "red_ratio", "sharpness", "noise", "uciqe", "grad_energy", "edge_density", "colorfulness", "clarity")
INDEX = T.StructType(
    [
        *RECORD,
        *[T.StructField(m, T.DoubleType()) for m in METRICS],
        T.StructField("phash", T.LongType()),
        T.StructField("metric_error", T.StringType()),
        T.StructField("dup_cluster", T.LongType()),
        T.StructField("is_empty", T.BooleanType()),
        *[T.StructField(n, T.StringType()) for n in ("light", "clarity_bucket", "slice", "split")],
        T.StructField("weight", T.DoubleType()),
    ]
)


class DuplicateIds(ValueError):
    """An id comes more than once across sources."""


class LicenseNotAccepted(PermissionError):
    """A source whose terms were not accepted."""


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


# --------------------------------------------------------------------------- tables


def read_table(spark: SparkSession, path: str, schema: T.StructType = INDEX) -> DataFrame:
    """A table of records or an index; columns it lacks are null."""
    return spark.read.schema(schema).parquet(path)


def union_sources(tables: Sequence[DataFrame], id_col: str) -> DataFrame:
    """All tables as one; an id that comes twice is an error, and so is no table at all."""
    if not tables:
        raise ValueError("no source has records")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    twice = [r[0] for r in out.groupBy(id_col).count().where("count > 1").select(id_col).limit(5).collect()]
    if twice:
        raise DuplicateIds(f"ids come more than once: {twice}")
    return out


def concat_records(spark: SparkSession, paths: Iterable[str], warn=print) -> DataFrame:
    """The record tables at `paths`; those that are missing are skipped with a warning."""
    found = []
    for p in paths:
        if exists(spark, p):
            found.append(read_table(spark, p, RECORD))
        else:
            warn(f"no records at {p}")
    return union_sources(found, "image_id")


# --------------------------------------------------------------------------- records


def make_record(df: DataFrame, source: str, license_clause: bool = False, **values: Column) -> DataFrame:
    """Rows of RECORD from columns given by name; those not given are null or empty. The licence is
    normalised, and a row counts as labelled with a label, a box or a mask."""
    empty = {"boxes": F.array().cast(T.ArrayType(BOX)), "box_labels": F.array().cast("array<string>"), "box_is_animal": F.array().cast("array<boolean>"), "attribution": F.lit(""), "frame_label": F.lit(-1), "boxes_exhaustive": F.lit(False), "extra": F.lit("{}")}
    get = lambda n: values.get(n, empty.get(n, F.lit(None)))
    license_ = C.normalize_license(get("license").cast("string"))
    made = {
        "source": F.lit(source),
        "license": license_,
        "train_commercial_ok": C.commercial_ok(license_, F.lit(license_clause)),
        "labeled": (get("frame_label") != -1) | (F.size(get("boxes")) > 0) | C.has_text(get("mask_path").cast("string")),
    }
    return df.select(*[(made[f.name] if f.name in made else get(f.name)).cast(f.dataType).alias(f.name) for f in RECORD])


COCO = T.StructType(
    [
        T.StructField("images", T.ArrayType(T.StructType([*[T.StructField(n, T.StringType()) for n in ("file_name", "mask_file", "group", "split", "condition", "location", "datetime")], T.StructField("has_animal", T.BooleanType()), T.StructField("id", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("image_id", T.StringType()), T.StructField("category_id", T.StringType()), T.StructField("bbox", BOX), T.StructField("iscrowd", T.IntegerType())]))),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())]))),
    ]
)


def _coco_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = spark.read.schema(COCO).option("multiLine", True).json(path)
    return tuple(raw.select(F.inline(F.col(c))) for c in ("images", "annotations", "categories"))


def below(folder: str, file: Column) -> Column:
    """The path of a file relative to a folder above it, however either writes its scheme."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", folder).rstrip("/")
    return F.regexp_replace(file, rf"^.*?{re.escape(plain)}/+", "")


def read_coco(spark: SparkSession, path: str, source: str, license: str, animals: Sequence[str] | None = None, exhaustive: bool = True, split: str | None = None, clause: bool = False, images_dir: str | None = None, prefix: str = "") -> DataFrame:
    """Images and boxes of a COCO file. Crowds and annotations without a box are left out; all
    categories are animals unless some are named. Boxes become normalised corners.

    An image is known by `prefix` and its file name, as numbers start anew in each file; its own split
    goes before `split`. With `images_dir`, images and masks that are not there are left out, and sizes
    that the file does not tell are those of the images.
    """
    images, annotations, categories = _coco_tables(spark, path)
    named = F.lit(True) if animals is None else F.col("name").isin(*animals)
    boxes = annotations.where((F.coalesce("iscrowd", F.lit(0)) == 0) & (F.size("bbox") == 4)).select(F.col("image_id"), F.col("category_id"), F.col("id").alias("annotation_id"), "bbox")
    boxes = boxes.join(F.broadcast(categories.select(F.col("id").alias("category_id"), "name")), "category_id", "left").withColumn("animal", F.coalesce(named, F.lit(False)))
    gathered = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("annotation_id", "bbox", F.coalesce("name", F.col("category_id")).alias("name"), "animal"))).alias("found"))
    if images_dir is not None:
        images = _present(spark, images, images_dir)
    rows = images.withColumnRenamed("id", "image_key").join(gathered, F.col("image_key") == F.col("image_id"), "left").withColumn("found", F.coalesce("found", F.array().cast(gathered.schema["found"].dataType)))
    path_ = C.safe_relative(F.concat(F.lit(prefix), F.col("file_name")))
    base = C.stem(path_)
    video = C.video_id(path_)
    return make_record(
        rows,
        source,
        clause,
        image_id=F.concat(F.lit(f"{source}:{prefix}"), F.col("file_name")),
        path=path_,
        group_id=F.concat(F.lit(f"{source}:"), F.coalesce("group", video)),
        license=F.lit(license),
        width=F.col("width"),
        height=F.col("height"),
        split_hint=F.coalesce("split", F.lit(split)),
        boxes=F.transform("found", lambda x: C.xywh_to_corners(x["bbox"], F.col("width"), F.col("height"))),
        box_labels=F.transform("found", lambda x: x["name"]),
        box_is_animal=F.transform("found", lambda x: x["animal"]),
        boxes_exhaustive=F.lit(exhaustive),
        frame_label=C.frame_label(F.exists("found", lambda x: x["animal"]), F.lit(exhaustive)),
        mask_path=F.col("mask_file"),
        video_id=F.when(video != base, video),
        extra=F.to_json(F.struct("condition", "has_animal")),
    )


def _present(spark: SparkSession, images: DataFrame, folder: str) -> DataFrame:
    """The listed images that `folder` holds, with masks and sizes that are known."""
    there = list_files(spark, folder, IMAGE_ENDINGS).select(below(folder, F.col("file")).alias("file_name"))
    found = images.join(there, "file_name", "left_semi")
    masks = there.select(F.col("file_name").alias("mask_file"), F.lit(True).alias("__mask"))
    found = found.join(masks, "mask_file", "left").withColumn("mask_file", F.when(F.col("__mask"), F.col("mask_file"))).drop("__mask")
    unsized = F.col("width").isNull() | F.col("height").isNull()
    if not found.where(unsized).limit(1).count():
        return found
    sizes = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder).select(below(folder, F.col("image.origin")).alias("file_name"), F.col("image.width").alias("__w"), F.col("image.height").alias("__h"))
    return found.join(sizes, "file_name", "left").withColumns({"width": F.coalesce("width", "__w"), "height": F.coalesce("height", "__h")}).drop("__w", "__h")


#: Category names that say a camera saw nothing.
EMPTY_NAMES = ("empty", "blank", "none")


def read_camera_traps(spark: SparkSession, path: str, source: str, license: str, most_empty: int | None = None, most_animal: int | None = None, seed: int = 0) -> DataFrame:
    """Images of a camera-trap file: empty if all of their annotations say so; without any, dropped.
    Each class may be cut to a number of images chosen by hash. A group is a place and a day."""
    images, annotations, categories = _coco_tables(spark, path)
    named = annotations.join(F.broadcast(categories.select(F.col("id").alias("category_id"), F.lower("name").alias("name"))), "category_id", "left")
    empty = named.groupBy("image_id").agg(F.every(F.coalesce(F.col("name").isin(*EMPTY_NAMES), F.lit(False))).alias("empty"), F.array_sort(F.collect_set("name")).alias("names"))
    rows = images.withColumnRenamed("id", "image_key").join(empty, F.col("image_key") == F.col("image_id"))
    rank = F.row_number().over(Window.partitionBy("empty").orderBy(C.hash01(seed, "camera", F.col("image_key")), "image_key"))
    most = F.when(F.col("empty"), F.lit(most_empty)).otherwise(F.lit(most_animal))
    rows = rows.withColumn("__rank", rank).where(most.isNull() | (F.col("__rank") <= most))
    return make_record(
        rows,
        source,
        image_id=F.concat(F.lit(f"{source}:"), F.col("image_key")),
        path=C.safe_relative(F.col("file_name")),
        group_id=F.concat(F.lit(f"{source}:"), F.coalesce("location", F.lit("na")), F.lit(":"), C.day_of(F.col("datetime"))),
        license=F.lit(license),
        width=F.col("width"),
        height=F.col("height"),
        frame_label=F.when(F.col("empty"), 0).otherwise(1),
        extra=F.to_json(F.struct("datetime", "location", "names")),
    )


def read_yolo(spark: SparkSession, folder: str, source: str, license: str, names: Mapping[int, str], animals: Sequence[str] | None = None, exhaustive: bool = False, images_dir: str | None = None, split: str | None = None) -> DataFrame:
    """Label files of `class cx cy w h` lines. Shorter lines are skipped; a class without a name is told
    by its number. Boxes are cut to the image.

    With `images_dir`, a row for each image there, with the labels of the same path below `folder` if
    there are any; without, a row for each label file. An image is known by its path below its folder.
    One without an animal is negative only if boxes are `exhaustive` and it has a label file; Spark
    reads no files of no bytes, so there an image without objects needs a line feed.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(below(folder, F.col("_metadata.file_path")).alias("file"), "value")
    tokens = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+")), lambda t: F.size(t) >= 5)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in (str(pair[0]), pair[1])]) if names else F.create_map().cast("map<string,string>")
    name = lambda t: F.coalesce(F.try_element_at(table, t[0]), t[0])
    edge = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 6)

    def corners(t: Column) -> Column:
        cx, cy, w, h = (t[i].try_cast("double") for i in range(1, 5))
        return F.array(edge(cx - w / 2), edge(cy - h / 2), edge(cx + w / 2), edge(cy + h / 2))

    bare = F.regexp_replace("file", r"\.[^./]*$", "").alias("bare")
    labels = files.select(bare, tokens.alias("tokens"), F.lit(True).alias("labelled"))
    if images_dir is not None:
        images = list_files(spark, images_dir, IMAGE_ENDINGS).select(F.col("file").alias("path"), below(images_dir, F.col("file")).alias("file"))
        rows = images.withColumn("bare", bare).join(labels, "bare", "left")
        rows = rows.withColumns({"tokens": F.coalesce("tokens", F.array().cast("array<array<string>>")), "labelled": F.coalesce("labelled", F.lit(False)), "known": F.col("file")})
    else:
        rows = labels.withColumns({"known": F.col("bare"), "path": F.lit(None).cast("string")})
    is_animal = (lambda t: F.lit(True)) if animals is None else (lambda t: name(t).isin(*animals))
    return make_record(
        rows,
        source,
        image_id=F.concat(F.lit(f"{source}:"), F.col("known")),
        path=F.col("path"),
        group_id=F.concat(F.lit(f"{source}:"), C.video_id(F.col("known"))),
        license=F.lit(license),
        split_hint=F.coalesce(F.lit(split), C.split_from_path(F.concat(F.lit("/"), F.col("known")))),
        boxes=F.transform("tokens", corners),
        box_labels=F.transform("tokens", name),
        box_is_animal=F.transform("tokens", is_animal),
        boxes_exhaustive=F.lit(exhaustive),
        frame_label=C.frame_label(F.exists("tokens", is_animal), F.lit(exhaustive) & F.col("labelled")),
    )


#: File name endings of stills and of videos.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
VIDEO_ENDINGS = ("mp4", "mov", "avi", "mkv", "m4v", "mts", "mxf", "h264", "ts")


def list_files(spark: SparkSession, folder: str, endings: Sequence[str]) -> DataFrame:
    """(file, length, modified) of the files of a folder and all below it; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    return found.where(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(*endings))


def read_folder(spark: SparkSession, folder: str, source: str, license: str, group_by: str = "parent", frame_label: int = -1) -> DataFrame:
    """Stills of a folder, grouped by the folder or the file they are in."""
    rows = list_files(spark, folder, IMAGE_ENDINGS)
    parent = F.element_at(F.split("file", "/"), -2)
    base = C.stem(F.col("file"))
    group = {"parent": parent, "file": base, "video": C.video_id(F.col("file"))}[group_by]
    return make_record(rows, source, image_id=F.concat(F.lit(f"{source}:"), parent, F.lit("/"), base), path=F.col("file"), group_id=F.concat(F.lit(f"{source}:"), group), license=F.lit(license), frame_label=F.lit(frame_label))


HABITAT_CSV = "ID STRING, labels INT"


def read_habitat_csv(spark: SparkSession, csv: str, files: DataFrame, source: str, license: str) -> DataFrame:
    """Classification rows `ID, labels` whose image exists among `files`(file); others are skipped.
    The group is the habitat, the last folder of the id that is not a class."""
    rows = spark.read.schema(HABITAT_CSV).option("header", True).csv(csv).where(F.col("ID").isNotNull())
    rows = rows.withColumns({"habitat": C.habitat(F.col("ID")), "base": C.stem(F.col("ID"))})
    there = files.select(C.stem(F.col("file")).alias("base"), F.col("file"))
    return make_record(rows.join(there, "base"), source, image_id=F.concat(F.lit(f"{source}:"), F.col("ID")), path=F.col("file"), group_id=F.concat(F.lit(f"{source}:"), F.col("habitat")), license=F.lit(license), frame_label=F.when(F.col("labels") > 0, 1).otherwise(0))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(url, dive, notes, name, cruise, date) of a manifest CSV: blank and # lines and rows without a
    URL are left out, and so are names that tell no cruise."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")) & ~F.startswith(F.trim("value"), F.lit("url,")))
    rows = lines.select(F.from_csv("value", "url STRING, dive STRING, notes STRING").alias("r")).select("r.*").where(C.has_text(F.col("url")))
    named = rows.withColumn("name", C.url_basename(F.col("url")))
    return named.select("url", F.coalesce(C.dive(F.col("name")), F.col("dive")).alias("dive"), "notes", "name", C.cruise(F.col("name")).alias("cruise"), C.capture_date(F.col("name")).alias("date")).where(F.col("cruise").isNotNull())


LISTING = "files ARRAY<STRUCT<key: STRING, filename: STRING, size: BIGINT, filesize: BIGINT, checksum: STRING, links: STRUCT<content: STRING, download: STRING, self: STRING>>>"


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, md5, url) of a repository's record in either of its layouts."""
    rows = spark.read.schema(LISTING).option("multiLine", True).json(path).select(F.inline("files"))
    return rows.select(F.coalesce("key", "filename").alias("name"), F.coalesce("size", "filesize").alias("size"), F.regexp_replace("checksum", "^md5:", "").alias("md5"), F.coalesce("links.content", "links.download", "links.self").alias("url"))


# --------------------------------------------------------------------------- logs

FRAME = """kind STRING, t DOUBLE, frame BIGINT, state STRING, frame_prob DOUBLE, novelty DOUBLE, recording BOOLEAN, events ARRAY<STRING>,
target STRUCT<found: BOOLEAN, cx: DOUBLE, cy: DOUBLE, size: DOUBLE, peak: DOUBLE, n_blobs: INT, yaw: DOUBLE, pitch: DOUBLE>,
track STRUCT<active: BOOLEAN, confirmed: BOOLEAN, yaw: DOUBLE, pitch: DOUBLE, size: DOUBLE, hits: INT, misses: INT>,
cmd STRUCT<yaw_rate: DOUBLE, heave: DOUBLE, surge: DOUBLE, light: DOUBLE>, reid STRUCT<sim: DOUBLE, skipped: INT, remembered: INT>,
nav STRUCT<t: DOUBLE, depth_m: DOUBLE, heading_deg: DOUBLE, altitude_m: DOUBLE, temp_c: DOUBLE>, lights STRUCT<dark: BOOLEAN, ambient: DOUBLE>,
search STRUCT<mode: STRING>, curiosity STRUCT<looking: BOOLEAN, cue: STRING>,
encounter_summary STRUCT<id: BIGINT, reason: STRING, t_start: DOUBLE, t_end: DOUBLE, engaged_s: DOUBLE, good_s: DOUBLE, value: DOUBLE, novelty_weight: DOUBLE, behaviour: STRING>,
id BIGINT, reason STRING, t_start DOUBLE, t_end DOUBLE, engaged_s DOUBLE, good_s DOUBLE, value DOUBLE, novelty_weight DOUBLE, behaviour STRING"""
ENCOUNTER = ("id", "reason", "t_start", "t_end", "engaged_s", "good_s", "value", "novelty_weight", "behaviour")


def read_logs(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(frames, encounters) of JSON-line logs that hold both. Frames have a state and a time; an
    encounter that several logs tell of is one, by id, start and end."""
    rows = spark.read.schema(FRAME).json(paths)
    frames = rows.where((F.col("kind").isNull() | (F.col("kind") == "guidance")) & F.col("state").isNotNull() & F.col("t").isNotNull()).drop(*ENCOUNTER)
    own = rows.where("kind = 'encounter'").select(*ENCOUNTER)
    told = frames.where("encounter_summary is not null").select("encounter_summary.*").select(*ENCOUNTER)
    encounters = own.unionByName(told).dropDuplicates(["id", "t_start", "t_end"])
    return frames.drop("encounter_summary"), encounters


# --------------------------------------------------------------------------- packs and caches

PACK = "key STRING, content BINARY, length BIGINT, mtime DOUBLE, crc32 BIGINT, part INT"


def lookup_packed(packs: DataFrame, keys: DataFrame, loose: DataFrame | None = None) -> DataFrame:
    """(key, content) of the keys: a loose file first, else the latest part that has it."""
    latest = packs.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("part").desc()))).where("__n = 1").select("key", "content")
    out = keys.select("key").distinct().join(latest, "key", "left")
    if loose is not None:
        own = loose.select("key", F.col("content").alias("__loose"))
        out = out.join(own, "key", "left").select("key", F.coalesce("__loose", "content").alias("content"))
    return out


def cached(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with what the cache has of them, rows still to compute). Of a key that the cache has
    several times, the last written counts; errors are cached like values."""
    last = cache.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("written").desc()))).where("__n = 1").drop("__n", "written")
    return rows.join(last, key), rows.join(last.select(key), key, "left_anti")


def cache_key(path: Column, size: Column, mtime: Column) -> Column:
    return F.concat_ws("|", path, size.cast("string"), mtime.cast("string"))


def todo(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def require_terms(source: str, terms: Mapping[str, bool], accepted: Sequence[str]) -> None:
    """Refuse a source whose terms must be accepted and were not, before anything of it is read."""
    if terms.get(source, False) and source not in accepted:
        raise LicenseNotAccepted(f"the terms of {source} were not accepted")


REGISTRY = {"coco": read_coco, "camera_traps": read_camera_traps, "yolo": read_yolo, "folder": read_folder}


def read_source(spark: SparkSession, kind: str, path: str, source: str, license: str, terms: Mapping[str, bool] | None = None, accepted: Sequence[str] = (), **options) -> DataFrame:
    """The records of one source of a registered layout, once its terms are accepted."""
    require_terms(source, terms or {}, accepted)
    if kind not in REGISTRY:
        raise KeyError(f"no reader for {kind}; there are {', '.join(REGISTRY)}")
    return REGISTRY[kind](spark, path, source, license, **options)
