"""The curation of a dataset, from the records of its sources to an index and what was removed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.kernels import thumbnail_distance
from ..sources.writers import markdown
from . import dedup, sampling
from .tables import materialize


@dataclass
class Settings:
    """Parameters of a curation; unknown keys of a mapping are ignored."""

    commercial_only: bool = False
    thresholds: Mapping[str, float] = field(default_factory=dict)
    calibrate: bool = False
    dedup: bool = True
    hamming: int = 6
    thumb: float = 1.2
    empty_keep: Mapping[str, float] | None = field(default_factory=lambda: {"default": 0.15, "murky": 0.5, "dark": 0.5})
    val: float = 0.05
    test: float = 0.10
    official: Sequence[str] = ()
    per_group: int | None = None
    weight_cap: float = 8.0
    source_caps: Mapping[str, float] = field(default_factory=dict)
    seed: int = 0

    @classmethod
    def of(cls, values: Mapping) -> Settings:
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})


DEFAULTS = {"dark": C.DARK, "dim": C.DIM, "murky": C.MURKY, "clear": C.CLEAR}


def thresholds_of(df: DataFrame, settings: Settings) -> dict[str, float]:
    """The given thresholds, or 15 and 45 % of luminance and 30 and 70 % of clarity."""
    if not settings.calibrate:
        return DEFAULTS | dict(settings.thresholds)
    row = df.agg(F.percentile("lum_mean", F.array(F.lit(0.15), F.lit(0.45))), F.percentile("clarity", F.array(F.lit(0.3), F.lit(0.7)))).first()
    return dict(zip(("dark", "dim", "murky", "clear"), [*(row[0] or []), *(row[1] or [])])) or dict(DEFAULTS)


def curate(measured: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, dict]:
    """(index, removed, log) of measured records: RECORD columns, METRICS, phash, thumb, metric_error.

    Buckets and splits are assigned before duplicates go; emptiness and weights after. What is
    removed carries its reason. Rows are only tagged until the end, so both tables come of one plan,
    cut where a later step would repeat the work of duplicates.
    """
    s, steps = settings, []
    gone: list[DataFrame] = []

    def take(df: DataFrame, reason, name: str) -> DataFrame:
        tagged = materialize(df.withColumn("removed_reason", reason), name)
        counts = {r[0]: r[1] for r in tagged.where("removed_reason is not null").groupBy("removed_reason").count().collect()}
        steps.append({"step": name, "removed": counts})
        gone.append(tagged.where("removed_reason is not null"))
        return tagged.where("removed_reason is null").drop("removed_reason")

    licensed = F.when(~C.commercial_ok(F.col("license"), F.col("train_commercial_ok")), "license_filter") if s.commercial_only else F.lit(None).cast("string")
    rows = take(measured, F.coalesce(licensed, F.when(C.has_text(F.col("metric_error")), "unreadable")), "readable")
    t = thresholds_of(rows, s)
    light, clear = C.light_bucket(F.col("lum_mean"), t["dark"], t["dim"]), C.clarity_bucket(F.col("clarity"), t["murky"], t["clear"])
    split = C.split_with_hints(F.col("source"), F.col("split_hint"), C.hash01(s.seed, "split", F.col("group_id")), s.official, s.test, s.val)
    rows = rows.withColumns({"light": light, "clarity_bucket": clear, "split": split}).withColumn("slice", C.eval_slice(F.col("light"), F.col("clarity_bucket")))
    mixed = rows.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count()
    steps.append({"step": "split", "mixed_groups": mixed})
    if s.dedup:
        close = F.udf(lambda a, b: thumbnail_distance(bytes(a), bytes(b)) <= s.thumb, "boolean")
        keyed = materialize(rows.withColumn("__id", F.monotonically_increasing_id()), "keyed")
        small = dedup.near_duplicate_clusters(keyed.select("__id", "phash", "thumb"), "__id", "phash", s.hamming, close(F.col("a_thumb"), F.col("b_thumb")))
        named = keyed.drop("dup_cluster").join(small.select("__id", "dup_cluster"), "__id").drop("__id")
        ranked = dedup.survivors(named, "image_id", C.richness(F.col("mask_path"), F.size("boxes"), F.col("frame_label")), F.col("width").cast("long") * F.col("height"))
        rows = take(ranked.withColumnRenamed("removed_reason", "__why"), F.col("__why"), "duplicates").drop("__why")
        gone[-1] = gone[-1].drop("__why")
    else:
        rows = rows.withColumn("dup_cluster", F.monotonically_increasing_id())
    rows = rows.withColumn("is_empty", C.is_empty_scene(F.col("grad_energy"), F.col("edge_density")))
    if s.empty_keep is not None:
        candidate = (F.col("split") == "train") & F.col("is_empty") & ~F.col("labeled") & (F.col("frame_label") != 1)
        drop = candidate & (C.hash01(s.seed, "empty", F.col("image_id")) >= C.keep_probability(F.col("slice"), F.col("light"), s.empty_keep))
        rows = take(rows, F.when(drop, "empty_water"), "empty")
    if s.per_group is not None:
        train = rows.where("split = 'train'")
        stay = sampling.cap_per_group(train.select("image_id", "group_id"), ["group_id"], C.hash01(s.seed, "cap", F.col("image_id")), "image_id", s.per_group).select("image_id").withColumn("__stay", F.lit(True))
        capped = rows.join(stay, "image_id", "left")
        over = F.when((F.col("split") == "train") & F.col("__stay").isNull(), "group_cap")
        rows = take(capped, over, "group_cap").drop("__stay")
        gone[-1] = gone[-1].drop("__stay")
    is_train = F.col("split") == "train"
    weighted = materialize(sampling.bucket_weights(rows, is_train, F.concat_ws("/", "light", "clarity_bucket"), s.weight_cap), "weights")
    index = sampling.source_capped_weights(weighted, is_train, "source", s.source_caps).drop("raw_weight", "thumb")
    removed = gone[0]
    for part in gone[1:]:
        removed = removed.unionByName(part, allowMissingColumns=True)
    steps.append({"step": "final", "by_split": {r[0]: r[1] for r in index.groupBy("split").count().collect()}})
    return index, removed.drop("thumb"), {"thresholds": t, "steps": steps}


def overview(index: DataFrame, removed: DataFrame) -> DataFrame:
    """Kept rows by split, and removed ones by reason, of the sources that kept any."""
    kept = index.groupBy("source").agg(F.count("*").alias("kept"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    lost = removed.groupBy("source").agg(*[F.count_if(F.col("removed_reason") == r).alias(r) for r in ("near_dup", "dup_of_eval", "empty_water")])
    return kept.join(lost, "source", "left").na.fill(0)


def label_stats(index: DataFrame) -> DataFrame:
    label = lambda v, n: F.count_if(F.col("frame_label") == v).alias(n)
    return index.groupBy("source", "split").agg(F.count("*").alias("images"), label(1, "positive"), label(0, "negative"), label(-1, "unknown"), F.sum(F.size("boxes")).alias("boxes"), F.count_if(C.has_text(F.col("mask_path"))).alias("masks"))


#: Input sizes (height, width) that box sizes are told for, in patches of 16 pixels.
INPUTS = ((112, 112), (160, 160), (224, 224), (112, 208))


def box_sizes(index: DataFrame) -> DataFrame:
    """How large animal boxes are in patches, at several input sizes."""
    boxes = index.select(F.explode(F.filter(F.arrays_zip("boxes", "box_is_animal"), lambda x: x["box_is_animal"])).alias("b")).select(F.col("b.boxes").alias("b"))
    sizes = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in INPUTS])
    each = boxes.select("b", F.inline(sizes)).withColumns({"pw": (F.col("b")[2] - F.col("b")[0]) * F.col("w") / 16.0, "ph": (F.col("b")[3] - F.col("b")[1]) * F.col("h") / 16.0})
    share = lambda c: F.avg(c.cast("int"))
    area = F.col("pw") * F.col("ph")
    return each.groupBy("h", "w").agg(F.count("*").alias("boxes"), share(F.greatest("pw", "ph") < 1).alias("below_patch"), share(area < 1).alias("area_below_1"), share(area < 4).alias("area_below_4"), F.median("pw").alias("median_w"), F.median("ph").alias("median_h"))


def report(index: DataFrame, removed: DataFrame, log: Mapping) -> str:
    """The dataset report as Markdown."""
    licences = index.groupBy("license").agg(F.count("*").alias("images"), F.avg(F.col("train_commercial_ok").cast("int")).alias("commercial"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    grid = index.where("split = 'train'").groupBy("light").pivot("clarity_bucket", ["murky", "moderate", "clear"]).count().na.fill(0)
    slices = index.where("split <> 'train'").groupBy("source", "split").pivot("slice", ["dark", "murky", "clear", "other"]).count().na.fill(0)
    spread = [F.percentile(c, F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias(c) for c in ("lum_mean", "clarity", "norm_contrast", "noise", "cast_mag", "red_ratio")]
    quantiles = index.groupBy("source").agg(*spread)
    told = quantiles.select("source", *[F.array_join(F.transform(c, lambda x: F.format_string("%.3f", x)), " / ").alias(c) for c in quantiles.columns[1:]])
    parts = [("Images per source", overview(index, removed), ["source"]), ("Licenses", licences, ["license"]), ("Condition buckets (train)", grid, ["light"]), ("Evaluation slices", slices, ["source", "split"]), ("Labels", label_stats(index), ["source", "split"]), ("Box sizes", box_sizes(index), ["h", "w"]), ("Metrics (p10 / median / p90)", told, ["source"])]
    head = ["# Dataset report", "", "Thresholds: " + ", ".join(f"{k} {v:.4g}" for k, v in log["thresholds"].items()), ""]
    return "\n".join(head + [x for title, df, order in parts for x in (f"## {title}", "", markdown(df, order=order))])
