"""Named sources: which layout each comes in, under which licence, and how its records are read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from . import readers
from .readers import make_record


@dataclass(frozen=True)
class Source:
    """What is known of a source: its layout, its licence, the terms to accept (None: none) and whether
    they allow training whatever the licence."""

    layout: str
    license: str
    terms: str | None = None
    clause: bool = False
    options: dict[str, Any] = field(default_factory=dict)


#: Public collections and the licences they state.
SOURCES = {
    "fathomnet": Source("site_images", "unknown", "fathomnet-tou", True),
    "noaa_oer": Source("dives", "public-domain-us-gov", "public-domain-us-gov"),
    "deepfish": Source("habitats", "CC-BY-4.0", "CC-BY-4.0"),
    "kakadu": Source("boxes", "CC-BY-3.0-AU", "CC-BY-3.0-AU"),
    "brackish": Source("boxes", "CC-BY-SA-4.0", "CC-BY-SA-4.0", options={"names": dict(enumerate(("fish", "crab", "shrimp", "starfish", "small_fish", "jellyfish")))}),
    "river_herring": Source("camera_traps", "CDLA-Permissive-1.0", "CDLA-Permissive-1.0"),
    "puget_sound": Source("camera_traps", "CDLA-Permissive-1.0", "CDLA-Permissive-1.0"),
    "ozfish": Source("folder", "CC-BY-3.0-AU", "CC-BY-3.0-AU"),
    "onc": Source("folder", "CC-BY-4.0", "CC-BY-4.0"),
    "own": Source("folder", "own"),
    "synthetic": Source("scenes", "own"),
}


def coco_files(spark: SparkSession, folder: str) -> list[str]:
    """The JSON files below a folder that hold images and annotations; a source has a few."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    is_coco = F.get_json_object("value", "$.images").isNotNull() & F.get_json_object("value", "$.annotations").isNotNull()
    return sorted(r[0] for r in rows.where(is_coco).select(F.col("_metadata.file_path")).collect())


def _boxes(spark: SparkSession, name: str, info: Source, folder: str, images_dir: str | None = None, labels_dir: str | None = None, names: dict[int, str] | None = None, exhaustive: bool = False) -> DataFrame:
    """All COCO files below a folder; where there are none, label files beside images."""
    parts = []
    for path in coco_files(spark, folder):
        base = path.rsplit("/", 1)[-1].removesuffix(".json")
        told = next((split for key, split in (("train", "train"), ("val", "val"), ("test", "test")) if key in base.lower() or f"/{key}/" in path.lower()), None)
        parts.append(readers.read_coco(spark, path, name, info.license, exhaustive=exhaustive, split=told, clause=info.clause, images_dir=images_dir or path.rsplit("/", 1)[0], prefix=f"{base}/"))
    if not parts and (names or info.options.get("names")):
        parts.append(readers.read_yolo(spark, labels_dir or f"{folder}/labels", name, info.license, names or info.options["names"], exhaustive=exhaustive, images_dir=images_dir or f"{folder}/images"))
    if not parts:
        raise FileNotFoundError(f"{name}: no COCO files and no labels below {folder}")
    return reduce(DataFrame.unionByName, parts)


def _camera_traps(spark: SparkSession, name: str, info: Source, folder: str, **options) -> DataFrame:
    return readers.read_camera_traps(spark, folder, name, info.license, **options)


def _folder(spark: SparkSession, name: str, info: Source, folder: str, **options) -> DataFrame:
    return readers.read_folder(spark, folder, name, info.license, **options)


def _habitats(spark: SparkSession, name: str, info: Source, folder: str) -> DataFrame:
    """The splits of the classification part; the file tells the split."""
    files = readers.list_files(spark, folder, readers.IMAGE_ENDINGS)
    parts = []
    for split in ("train", "val", "test"):
        csv = f"{folder}/Classification/{split}.csv"
        if readers.exists(spark, csv):
            parts.append(readers.read_habitat_csv(spark, csv, files, name, info.license).withColumn("split_hint", F.lit(split)))
    if not parts:
        raise FileNotFoundError(f"{name}: no lists of images below {folder}")
    return reduce(DataFrame.unionByName, parts)


SITE_IMAGE = """uuid STRING, url STRING, width INT, height INT, latitude DOUBLE, longitude DOUBLE, depthMeters DOUBLE, timestamp STRING, contributorsEmail STRING, license STRING,
boundingBoxes ARRAY<STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE, concept: STRING, rejected: BOOLEAN>>"""


def site_images(pages: DataFrame, name: str, info: Source, plants: tuple[str, ...] = (), most: int | None = None, seed: int = 0) -> DataFrame:
    """Records of a site's image objects (JSON in `value`, as paged_source gives them): one for each
    uuid with a URL, rejected boxes left out, concepts in `plants` no animals; at most `most`, by hash."""
    rows = pages.select(F.from_json("value", SITE_IMAGE).alias("r")).select("r.*").where(C.has_text(F.col("url")))
    rows = rows.dropDuplicates(["uuid"])
    if most is not None:
        rows = rows.orderBy(C.hash01(seed, "site", F.col("uuid")), "uuid").limit(most)
    found = F.filter(F.coalesce("boundingBoxes", F.array().cast("array<struct<x:double,y:double,width:double,height:double,concept:string,rejected:boolean>>")), lambda b: ~F.coalesce(b["rejected"], F.lit(False)))
    rows = rows.withColumn("found", found)
    animal = lambda b: ~b["concept"].isin(*plants) if plants else F.lit(True)
    return make_record(
        rows,
        name,
        info.clause,
        image_id=F.concat(F.lit(f"{name}:"), F.col("uuid")),
        path=C.url_basename(F.col("url")),
        url=F.col("url"),
        group_id=C.site_group(name, F.col("url"), F.col("timestamp"), F.col("latitude"), F.col("longitude"), F.col("contributorsEmail")),
        license=F.coalesce("license", F.lit(info.license)),
        width=F.col("width"),
        height=F.col("height"),
        boxes=F.transform("found", lambda b: C.xywh_to_corners(F.array(b["x"], b["y"], b["width"], b["height"]), F.col("width"), F.col("height"))),
        box_labels=F.transform("found", lambda b: b["concept"]),
        box_is_animal=F.transform("found", animal),
        frame_label=C.frame_label(F.exists("found", animal), F.lit(False)),
        extra=F.to_json(F.struct("depthMeters", "latitude", "longitude", "timestamp")),
    )


def _site_images(spark: SparkSession, name: str, info: Source, folder: str, **options) -> DataFrame:
    return site_images(spark.read.text(folder), name, info, **options)


def _dives(spark: SparkSession, name: str, info: Source, folder: str) -> DataFrame:
    """The videos of a manifest, a record each, grouped by cruise and dive; frames come from a decoder."""
    rows = readers.read_manifest(spark, folder)
    base = C.stem(F.col("name"))
    group = F.concat_ws(":", F.lit(name), F.coalesce("cruise", F.lit("NA")), F.coalesce("dive", "date", base))
    return make_record(rows, name, image_id=F.concat(F.lit(f"{name}:"), base), path=F.col("name"), url=F.col("url"), group_id=group, license=F.lit(info.license), video_id=base)


def _scenes(spark: SparkSession, name: str, info: Source, folder: str, n: int = 120) -> DataFrame:
    """Seeded synthetic pictures; nothing is read."""
    from ..operators import images

    rows = images.scenes(spark, n)
    return make_record(rows, name, image_id=F.concat(F.lit(f"{name}:"), F.col("path")), path=F.col("path"), group_id=F.concat(F.lit(f"{name}:"), F.col("path")), license=F.lit(info.license), width=F.col("width"), height=F.col("height"), boxes=F.col("boxes"), box_labels=F.transform("boxes", lambda _: F.lit("animal")), box_is_animal=F.transform("boxes", lambda _: F.lit(True)), boxes_exhaustive=F.lit(True), frame_label=F.when(F.size("boxes") > 0, 1).otherwise(0), extra=F.to_json(F.struct("condition")))


LAYOUTS: dict[str, Callable[..., DataFrame]] = {"boxes": _boxes, "camera_traps": _camera_traps, "folder": _folder, "habitats": _habitats, "site_images": _site_images, "dives": _dives, "scenes": _scenes}


def fetch(spark: SparkSession, name: str, path: str = "", accept: str | None = None, **options) -> DataFrame:
    """The records of a named source, once its terms are accepted by name; nothing is read before."""
    if name not in SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(SOURCES)}")
    info = SOURCES[name]
    if info.terms is not None and accept != info.terms:
        raise readers.LicenseNotAccepted(f"{name} asks to accept {info.terms}")
    return LAYOUTS[info.layout](spark, name, info, path, **options)
