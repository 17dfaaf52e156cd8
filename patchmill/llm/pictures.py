"""Pictures of a manifest as sets of shingles: what img and case_id say, however it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchmill.functions.labels import label, path_plain, plain, with_names, words_joined
from patchmill.llm.overlap import cross_split_overlap, overlap_pairs


def picture_shingles(scene: Column, role: Column, name: Column, weight: int = 8) -> Column:
    """The shingles of a picture: its scene with its role, ``weight`` times over, and a word of the name as it is written.

    A similarity of weighted sets is that of sets in which an element of weight w stands w times. Of the words the one of least hash
    is taken, so that two writings with the same words keep the same one. Two pictures of one scene and role share 8 of at most 10
    shingles, a similarity of 0.8 or more, whatever slips their names hold. Scenes are numbers and codes in dense use, so runs of
    their characters would be frequent ones and pair all records with all; whole scenes are rare.
    """
    own = F.transform(F.sequence(F.lit(1), F.lit(weight)), lambda i: F.concat_ws("|", i.cast("string"), role, scene))
    word = F.array_min(F.transform(F.split(name, "_"), lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w"))))
    return F.when(scene.isNotNull() & role.isNotNull(), F.concat(own, F.filter(F.array(F.concat(F.lit("~"), word["w"])), lambda x: x.isNotNull())))


def overlapping_pictures(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (val or test, train) of items whose pictures overlap, with c_scene, c_role and c_source of each side, their similarity and the keys of their writings.

    Items with NULL split take no part; where a file name says no role, img itself stands for it. Rows of one item count once.
    """
    norm = with_names(items.select("item_id", "split", "case_id", "img", "source").where(F.col("split").isNotNull()).dropDuplicates(["item_id", "split"]))
    norm = norm.withColumns({"role": F.coalesce("p_role", F.concat(F.lit("img:"), F.col("img"))), "scene": F.col("p_scene"), "source": label("source"), "name": words_joined(F.substring_index(path_plain(plain("img")), "/", -1))})
    links, members = cross_split_overlap(norm, "item_id", "split", picture_shingles(F.col("scene"), F.col("role"), F.col("name")), threshold=threshold, carry=("scene", "role", "source"), unique=True)
    return overlap_pairs(links, members)


def same_picture_pairs(items: DataFrame) -> DataFrame:
    """The overlapping pictures whose scene and role agree."""
    return overlapping_pictures(items).where((F.col("c_scene_e") == F.col("c_scene_t")) & (F.col("c_role_e") == F.col("c_role_t")))
