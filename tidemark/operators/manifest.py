"""Dataset manifests: nested JSON to one row a frame, and folder listings to manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.keyed import mapped

VIDEO = "struct<label:string,frames:array<string>,masks:array<string>>"
PLAIN = f"map<string,map<string,map<string,map<string,{VIDEO}>>>>"  # dataset, label, split, video
COMPRESSED = f"map<string,map<string,map<string,map<string,map<string,{VIDEO}>>>>>"  # compression before video


def without_alias(name: Column | str) -> Column:
    """(dataset, compression): a name that ends in _c23 or _c40 names both."""
    n = F.col(name) if isinstance(name, str) else name
    return F.struct(F.regexp_replace(n, "_(c23|c40)$", "").alias("dataset"), F.nullif(F.regexp_extract(n, "_(c23|c40)$", 1), F.lit("")).alias("compression"))


def videos(df: DataFrame, text: str = "value", compressed: bool = False) -> DataFrame:
    """dataset, label, split, compression, video, label_name, frames, masks from manifest texts."""
    out = df.select(F.from_json(text, COMPRESSED if compressed else PLAIN).alias("m")).select(F.explode("m").alias("dataset", "m")).select("dataset", F.explode("m").alias("label", "m")).select("dataset", "label", F.explode("m").alias("split", "m"))
    out = out.select("dataset", "label", "split", F.explode("m").alias("compression", "m")) if compressed else out.select("dataset", "label", "split", F.lit(None).cast("string").alias("compression"), "m")
    return out.select("dataset", "label", "split", "compression", F.explode("m").alias("video", "v")).select("dataset", "label", "split", "compression", "video", F.col("v.label").alias("label_name"), F.col("v.frames").alias("frames"), F.col("v.masks").alias("masks"))


def frames(df: DataFrame, labels: dict[str, int], array: str = "frames", name: str = "label_name") -> DataFrame:
    """One row a frame, with its place; a label name that `labels` doesn't have raises."""
    return mapped(df, name, labels, "label_id").select(*df.columns, "label_id", F.posexplode(array).alias("place", "frame")).drop(array)


def split_keys(pairs: DataFrame) -> DataFrame:
    """(key, split) from rows (a, b, split): a, b, a_b and b_a; of a key in several splits test beats val beats train."""
    keys = pairs.select("split", F.explode(F.array("a", "b", F.concat_ws("_", "a", "b"), F.concat_ws("_", "b", "a"))).alias("key"))
    rank = F.array_position(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("split"))
    return keys.groupBy("key").agg(F.max_by("split", rank).alias("split"))


def assigned(items: DataFrame, splits: DataFrame, key: str, fake: str = "fake") -> DataFrame:
    """items with their split; a fake item without one goes to all three, a real one raises."""
    out = items.join(splits.withColumnRenamed("key", key), key, "left")
    every = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    miss = F.raise_error(F.concat(F.lit("no split for "), F.col(key))).cast("array<string>")
    return out.withColumn("split", F.explode(F.when(F.col("split").isNotNull(), F.array("split")).when(F.col(fake), every).otherwise(miss)))


def manifest(paths: DataFrame, label: Column, split: Column, path: str = "path") -> DataFrame:
    """(label, split, video, frames) from frame paths: the video is the folder, frames are in the order of their numbers."""
    from tidemark.functions.text import parent_folder
    from tidemark.operators.sampling import numeric_order

    return paths.groupBy(label.alias("label"), split.alias("split"), parent_folder(path).alias("video")).agg(numeric_order(F.collect_list(path)).alias("frames"))


def manifest_json(df: DataFrame, dataset: str) -> DataFrame:
    """One nested JSON text of (label, split, video, frames)."""
    video = F.struct(F.col("label"), F.col("frames"))
    per = df.groupBy("label", "split").agg(F.map_from_entries(F.collect_list(F.struct("video", video.alias("v")))).alias("m")).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("split", "m"))).alias("m"))
    return per.agg(F.to_json(F.create_map(F.lit(dataset), F.map_from_entries(F.collect_list(F.struct("label", "m"))))).alias("value"))


def masks(items: DataFrame, mask_paths: DataFrame, path: str = "path") -> DataFrame:
    """items with the first mask of the same file stem, or null."""
    from tidemark.functions.text import file_stem

    found = mask_paths.select(file_stem(path).alias("_s"), F.col(path).alias("mask")).groupBy("_s").agg(F.min("mask").alias("mask"))
    return items.withColumn("_s", file_stem(path)).join(found, "_s", "left").drop("_s")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


# For each dataset the folders of its real and fake videos (a pattern each, tried in order) with their labels, and the
# splits that a video of the folder belongs to: all of them; `train`, with those in a list of test videos in val and test as well; or
# what a table of splits says.
LAYOUTS = {
    "UADFV": {"labels": [("/real/", "UADFV_Real"), ("/fake/", "UADFV_Fake")], "splits": "all"},
    "Celeb-DF-v1": {"labels": [("/(Celeb-real|YouTube-real)/", "CelebDFv1_real"), ("/", "CelebDFv1_fake")], "splits": "tested"},
    "Celeb-DF-v2": {"labels": [("/(Celeb-real|YouTube-real)/", "CelebDFv2_real"), ("/", "CelebDFv2_fake")], "splits": "tested"},
    "DFDCP": {"labels": [("/method_A/", "DFDCP_FakeA"), ("/method_B/", "DFDCP_FakeB"), ("/", "DFDCP_Real")], "splits": "listed"},
    "DFDC": {"labels": [("/", "")], "splits": "listed"},
    "DeeperForensics-1.0": {"labels": [("/manipulated_videos/", "DF_fake"), ("/source_videos/", "DF_real")], "splits": "listed"},
    "FaceForensics++": {"labels": [("/original_sequences/youtube/", "FF-real"), ("/manipulated_sequences/Deepfakes/", "FF-DF"), ("/manipulated_sequences/Face2Face/", "FF-F2F"), ("/manipulated_sequences/FaceSwap/", "FF-FS"), ("/manipulated_sequences/NeuralTextures/", "FF-NT")], "splits": "listed"},
    "DeepFakeDetection": {"labels": [("/original_sequences/actors/", "DFD_real"), ("/manipulated_sequences/DeepFakeDetection/", "DFD_fake")], "splits": "all"},
    "FaceShifter": {"labels": [("/original_sequences/youtube/", "FF-real"), ("/manipulated_sequences/FaceShifter/", "FF-FH")], "splits": "listed"},
}


def by_layout(paths: DataFrame, dataset: str, path: str = "path", tested: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """label, split, compression, video, frames of the frames of a dataset, by its rule in LAYOUTS.

    Frames are .../frames/<video>/<frame>. tested: video, the list of test videos. splits: video, split and, where the
    folders don't tell it, label; a real video that it doesn't list belongs to all splits, a fake one raises.
    """
    from tidemark.functions.text import clean_path
    from tidemark.operators.sampling import numeric_order

    rule = LAYOUTS[dataset]
    p = clean_path(path)
    label = F.lit(None).cast("string")
    for pattern, name in reversed(rule["labels"]):
        label = F.when(p.rlike(pattern), name).otherwise(label)
    compression = F.nullif(F.regexp_extract(p, "/(c23|c40|raw)/", 1), F.lit(""))
    rows = paths.where(p.rlike("/frames/[^/]+/[^/]+$")).select(label.alias("label"), compression.alias("compression"), F.regexp_extract(p, "/frames/([^/]+)/[^/]+$", 1).alias("video"), p.alias("frame"))
    videos_ = rows.where(F.col("label").isNotNull()).groupBy("label", "compression", "video").agg(numeric_order(F.collect_list("frame")).alias("frames"))
    every = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    if rule["splits"] == "all":
        out = videos_.withColumn("splits", every)
    elif rule["splits"] == "tested":
        out = videos_.join(tested.select("video", F.lit(True).alias("_t")).distinct(), "video", "left").withColumn("splits", F.when(F.col("_t"), every).otherwise(F.array(F.lit("train"))))
    else:
        listed = splits.groupBy("video").agg(F.collect_set("split").alias("_l"), *([F.max("label").alias("_label")] if "label" in splits.columns else []))
        out = videos_.join(listed, "video", "left")
        if "label" in splits.columns:
            out = out.withColumn("label", F.coalesce("_label", "label"))
        miss = F.raise_error(F.concat(F.lit("no split for "), F.col("video"))).cast("array<string>")
        out = out.withColumn("splits", F.when(F.col("_l").isNotNull(), F.col("_l")).when(F.lower("label").contains("real"), every).otherwise(miss))
    return out.select("label", F.explode("splits").alias("split"), "compression", "video", "frames")


def resolved_paths(items: DataFrame, there: DataFrame, given: str, root: str, to: str = "path") -> DataFrame:
    """items with where the file of each is, among the paths of `there`: as given, else below root, else below root where the path begins with root already; null without."""
    from tidemark.functions.text import clean_path

    base = root.strip("/") if not root.startswith("/") else root.rstrip("/")
    p = clean_path("_g")
    again = F.when(p.startswith(base), F.concat(F.lit(f"{base}/"), F.regexp_replace(p.substr(F.lit(len(base) + 1), F.length(p)), "^/+", "")))
    tries = F.filter(F.array(F.struct(F.lit(0).alias("o"), p.alias("t")), F.struct(F.lit(1).alias("o"), F.concat(F.lit(f"{base}/"), p).alias("t")), F.struct(F.lit(2).alias("o"), again.alias("t"))), lambda x: x["t"].isNotNull())
    asked = items.select(F.col(given).alias("_g")).distinct().select("_g", F.inline(tries))
    found = asked.join(there.select(F.col("path").alias("t")).distinct(), "t").groupBy("_g").agg(F.min_by("t", "o").alias(to))
    return items.join(found, F.col(given).eqNullSafe(F.col("_g")), "left").drop("_g")
