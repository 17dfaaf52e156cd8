"""Manifests from file listings and nested indexes: pairing of files, leakage-safe splits, quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchmill.functions.labels import path_plain
from patchmill.operators.sampling import holdout
from patchmill.storage import Workspace

VALID = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif")
# Endings of file stems that name a picture's part.
PARTS = "modified|original|orig|mask|fake|real|inpainted|gt"


def valid_images(li: DataFrame, exts: tuple[str, ...] = VALID) -> DataFrame:
    return li.where(F.col("ext").isin(*exts))


def base_name(stem: Column) -> Column:
    """The stem without the one ending that names its part."""
    return F.regexp_replace(stem, f"_({PARTS})$", "")


def casia_ids(base: Column) -> list[Column]:
    """(bg_id, fg_id) of ``casia_<bg>_<fg...>``, else NULLs."""
    return [F.nullif(F.regexp_extract(base, "^casia_([^_]*)_(.*)$", i), F.lit("")) for i in (1, 2)]


def indoor_items(li: DataFrame, holdout: str) -> DataFrame:
    """Pictures of houses; those under a folder named holdout are val."""
    x = valid_images(li).where(F.col("path").contains("/indoor/"))
    return x.select(F.col("path").alias("img"), F.lit(None).cast("string").alias("mask"), F.lit("indoor_real").alias("kind"), F.col("stem").alias("case_id"), F.lit("indoor_real").alias("source"), F.when(F.array_contains(F.split("path", "/"), holdout), "val").otherwise("train").alias("split"))


def _sided(x: DataFrame, key: str, val: float, seed: str) -> DataFrame:
    """x with split: all rows of a key on one side; a share of the keys is held out."""
    x = Workspace(x.sparkSession, "sided").cut(x)
    return x.join(holdout(x, key, val, seed).select(key, F.col("side").alias("split")), key)


def _kept(li: DataFrame, where: Column) -> DataFrame:
    """The pictures of one source, written once: each is looked at several times."""
    return Workspace(li.sparkSession, "listing").cut(valid_images(li).where(where).select("path", "name", "stem", "ext"))


def imd_items(li: DataFrame, val: float = 0.1, seed: str = "42") -> DataFrame:
    """Of each case folder the first original by name, and the pictures that have a mask of their own stem; folders are held out whole.

    The share counts all folders, those without an original too.
    """
    x = _kept(li, F.col("path").contains("/imd2020/")).withColumn("case_id", F.element_at(F.split("path", "/"), -2))
    orig = x.where(F.col("stem").contains("_orig")).withColumn("rk", F.row_number().over(Window.partitionBy("case_id").orderBy("name", "path"))).where("rk = 1")
    masks = x.where(F.col("name").endswith("_mask.png")).select("case_id", F.regexp_replace("stem", "_mask$", "").alias("stem"), F.col("path").alias("mask"))
    fakes = x.where(~F.col("stem").contains("_orig") & ~F.col("stem").endswith("_mask")).join(masks, ["case_id", "stem"]).join(orig.select("case_id"), "case_id", "left_semi")
    a = orig.select(F.col("path").alias("img"), F.lit(None).cast("string").alias("mask"), F.lit("imd_real").alias("kind"), "case_id", F.lit("imd2020").alias("source"))
    rows = a.unionByName(fakes.select(F.col("path").alias("img"), "mask", F.lit("imd_splice").alias("kind"), "case_id", F.lit("imd2020").alias("source")))
    return rows.join(holdout(x, "case_id", val, seed).select("case_id", F.col("side").alias("split")), "case_id")


def _part(li: DataFrame, where: Column, as_: str, base: Column) -> DataFrame:
    """(base, as_): one file for each base, the last by name and path."""
    x = valid_images(li).where(where).select(base.alias("base"), "name", F.col("path").alias(as_))
    return x.groupBy("base").agg(F.max(F.struct("name", as_)).alias("m")).select("base", F.col(f"m.{as_}").alias(as_))


def casia_triplets(li: DataFrame, side: DataFrame | None = None, val: float = 0.1, seed: str = "42") -> DataFrame:
    """Real, fake and mask of each base whose background and foreground lie on the same side; side: (key, side) of both kinds of ids.

    Without side, backgrounds and foregrounds of complete triplets are held out, each by its own order. Two rows come from each
    triplet; pairs that would leak across sides are left out.
    """
    p = F.col("path")
    li = _kept(li, p.contains("/casia/"))
    real = _part(li, p.contains("/casia/images/") & F.col("stem").endswith("_real"), "real", base_name(F.col("stem")))
    fake = _part(li, p.contains("/casia/images/") & F.col("stem").endswith("_fake"), "fake", base_name(F.col("stem")))
    mask = _part(li, p.contains("/casia/masks/") & F.col("stem").endswith("_mask"), "mask", base_name(F.col("stem")))
    bg, fg = casia_ids(F.col("base"))
    t = real.join(fake, "base").join(mask, "base").withColumns({"bg_id": bg, "fg_id": F.regexp_extract(fg, "^[^_]+", 0)})
    if side is None:
        t = Workspace(li.sparkSession, "casia").cut(t)
        sides = [holdout(t.where("bg_id <> '' and fg_id <> ''"), k, val, f"{seed}|{k}").withColumnRenamed(k, "key") for k in ("bg_id", "fg_id")]
    else:
        sides = [side, side]
    for k, s in zip(("bg_id", "fg_id"), sides, strict=True):
        t = t.join(s.select(F.col("key").alias(k), F.col("side").alias(f"s_{k}")), k)
    row = F.explode(F.array(F.struct(F.col("real").alias("img"), F.lit(None).cast("string").alias("mask"), F.lit("imd_real").alias("kind")), F.struct(F.col("fake").alias("img"), F.col("mask").alias("mask"), F.lit("imd_splice").alias("kind"))))
    return t.where("s_bg_id = s_fg_id").select(row.alias("r"), F.col("base").alias("case_id"), F.lit("casia").alias("source"), "bg_id", "fg_id", F.col("s_bg_id").alias("split")).select("r.*", "case_id", "source", "bg_id", "fg_id", "split")


def _two_rows(t: DataFrame, source: str, real: str, fake: str, mask: str, *, paste: bool) -> DataFrame:
    """A real and a fake row of each base (base, split); with paste the fake one knows its original."""
    none = F.lit(None).cast("string")
    row = F.explode(F.array(F.struct(F.col(real).alias("img"), none.alias("mask"), F.lit("imd_real").alias("kind"), none.alias("real_path")), F.struct(F.col(fake).alias("img"), F.col(mask).alias("mask"), F.lit("casia_splice").alias("kind"), (F.col(real) if paste else none).alias("real_path"))))
    return t.select(row.alias("r"), F.concat(F.lit(source + "_"), "base").alias("case_id"), F.lit(source).alias("source"), "split").select("r.*", "case_id", "source", "split")


def triplets(li: DataFrame, source: str, modified: str, original: str, mask: str, val: float = 0.1, seed: str = "42") -> DataFrame:
    """Modified and original pictures with a mask, matched by base name: two rows each; the fake one knows its original. Bases are held out whole."""
    p, base = F.col("path"), base_name(F.col("stem"))
    li = _kept(li, p.contains(modified) | p.contains(original) | p.contains(mask))
    t = _part(li, p.contains(modified), "m", base).join(_part(li, p.contains(original), "o", base), "base").join(_part(li, p.contains(mask), "k", base), "base")
    return _two_rows(_sided(t, "base", val, seed), source, "o", "m", "k", paste=True)


def unmatched(li: DataFrame, modified: str, original: str, mask: str) -> DataFrame:
    """Modified pictures without an original or a mask."""
    p, base = F.col("path"), base_name(F.col("stem"))
    m = _part(li, p.contains(modified), "img", base)
    both = _part(li, p.contains(original), "o", base).join(_part(li, p.contains(mask), "k", base), "base")
    return m.join(both, "base", "left_anti")


def anyedit_items(li: DataFrame, source: str = "anyedit", val: float = 0.1, seed: str = "42") -> DataFrame:
    """Real and edited pictures of the same base: two rows each, the edited one with its mask where there is one. Bases are held out whole.

    What a stem ends in counts in any letter case, the base only without an ending in lower case.
    """
    p, base, low = F.col("path"), base_name(F.col("stem")), F.lower("stem")
    li = _kept(li, p.contains("/anyedit/"))
    real = _part(li, p.contains("/anyedit/images/") & low.rlike("_(real|original)$"), "real", base)
    fake = _part(li, p.contains("/anyedit/images/") & low.rlike("_(fake|modified)$"), "fake", base)
    mask = _part(li, p.contains("/anyedit/masks/"), "mask", base)
    t = real.join(fake, "base").join(mask, "base", "left")
    return _two_rows(_sided(t, "base", val, seed), source, "real", "fake", "mask", paste=False)


def bfree_items(li: DataFrame, source: str = "bfree", val: float = 0.1, seed: str = "42") -> DataFrame:
    """Edits of an anchor: the mask of the box for other-category edits where there is one, else the exact one; one real row for each anchor. Anchors are held out with their edits."""
    p, low, none = F.col("path"), F.lower("stem"), F.lit(None).cast("string")
    li = _kept(li, p.contains("/bfree/"))
    anchor = _part(li, p.contains("/bfree/anchor/"), "anchor", F.regexp_replace(low, "_anchor$", ""))
    edit = valid_images(li).where(p.rlike("/bfree/(diffcat|samecat)/")).select(F.regexp_replace(low, r"_(diffcat|samecat)\d+$", "").alias("base"), low.alias("edit"), F.regexp_extract("path", "/bfree/(diffcat|samecat)/", 1).alias("variant"), p.alias("fake"))
    box = _part(li, p.contains("/bfree/bbox/"), "box", F.regexp_replace(low, "_mask$", ""))
    exact = _part(li, p.contains("/bfree/exact/"), "exact", F.regexp_replace(low, "_mask$", ""))
    x = edit.join(anchor, "base").join(box.withColumnRenamed("base", "edit"), "edit", "left").join(exact.withColumnRenamed("base", "edit"), "edit", "left")
    x = _sided(x, "base", val, seed)
    fakes = x.select(F.concat(F.lit(f"{source}_"), "base", F.lit("_"), "variant").alias("case_id"), "variant", F.col("fake").alias("img"), F.coalesce(F.when(F.col("variant") == "diffcat", F.col("box")), F.col("exact")).alias("mask"), F.lit("casia_splice").alias("kind"), F.col("anchor").alias("real_path"), "split")
    reals = x.select(F.concat(F.lit(f"{source}_"), "base").alias("case_id"), none.alias("variant"), F.col("anchor").alias("img"), none.alias("mask"), F.lit("imd_real").alias("kind"), none.alias("real_path"), "split").distinct()
    return fakes.unionByName(reals).withColumn("source", F.lit(source))


NESTED = "map<string,struct<category:string,original_512:string,masks:map<string,string>,manipulations:array<struct<type:string,model:string,fake_path:string,mask_used:string,variation_id:int>>>>"


def nested_index(text: DataFrame, col: str = "json") -> DataFrame:
    """One row for each manipulation of a nested JSON index: ids, category, model, type, mask and its path (NULL where the map lacks it)."""
    x = text.select(F.explode(F.from_json(col, NESTED)).alias("scene", "v"))
    m = x.select("scene", "v.category", "v.original_512", "v.masks", F.explode("v.manipulations").alias("m"))
    return m.select("scene", "category", "original_512", F.col("m.type").alias("type"), F.col("m.model").alias("model"), F.col("m.fake_path").alias("img"), F.col("m.mask_used").alias("mask_used"), F.col("m.variation_id").alias("variation_id"), F.try_element_at("masks", F.col("m.mask_used")).alias("mask"))


def mask_type(mask_used: Column) -> Column:
    """``random`` of ``random_0``."""
    return F.substring_index(mask_used, "_", 1)


def mask_family(kind: Column) -> Column:
    return F.when(kind == "random", "random").otherwise("semantic")


def model_filter(df: DataFrame, col: str, want: str) -> DataFrame:
    """Rows whose model, letters only and in lower case, has want in it; all rows where none has."""
    w = "".join(c for c in want.lower() if c.isalpha())
    hit = F.coalesce(F.regexp_replace(F.lower(col), r"[^\p{L}]", "").contains(w), F.lit(False))
    return df if df.where(hit).isEmpty() else df.where(hit)


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def route_split(train_sources: list[str], val_sources: list[str]) -> Column:
    """The split a row goes to by the flags of its source: both, one or none."""
    s = F.col("source")
    t, v = s.isin(*train_sources) if train_sources else F.lit(False), s.isin(*val_sources) if val_sources else F.lit(False)
    return F.when(t & v, F.col("split")).when(t, "train").when(v, "val")


# The codes of faults; hard ones would break a run or give a wrong label.
HARD = ("MISSING_IMG", "UNREADABLE_IMG", "SPLICE_NO_MASK", "MISSING_MASK", "UNREADABLE_MASK", "EMPTY_MASK", "MISSING_REALPATH", "UNREADABLE_REALPATH")
SOFT = ("DEGENERATE_SIZE", "MASK_SIZE_MISMATCH")


def file_facts(li: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """(path, ok, width, height, peak): what is known of each file. A file of length 0 cannot be read; sizes and the greatest value come from decoded (path, width, height, ok, peak) where given, else they are NULL."""
    f = li.select("path", (F.coalesce("length", F.lit(1)) > 0).alias("ok"))
    if decoded is None:
        return f.withColumns({"width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "peak": F.lit(None).cast("int")})
    d = decoded.select("path", F.col("ok").alias("_ok"), "width", "height", "peak")
    return f.join(d, "path", "left").select("path", (F.col("ok") & F.coalesce("_ok", F.lit(True))).alias("ok"), "width", "height", "peak")


def quality_issues(items: DataFrame, facts: DataFrame, min_side: int = 32) -> DataFrame:
    """(item_id, source, code, detail): faults of manifest rows against the files that are there.

    facts: file_facts, one row for each file, by normalised path. img, mask and real_path are normalised for the comparison; detail has
    them as they are. Sizes and contents are checked where they are known.
    """
    x = items.withColumns({f"f_{c}": path_plain(c) for c in ("img", "mask", "real_path")})
    for c in ("img", "mask", "real_path"):
        x = x.join(facts.select(F.col("path").alias(f"f_{c}"), F.struct("ok", "width", "height", "peak").alias(f"a_{c}")), f"f_{c}", "left")
    splice = F.coalesce(F.col("kind").isin("imdsplice", "casiasplice"), F.lit(False))
    i, m, r = F.col("a_img"), F.col("a_mask"), F.col("a_real_path")
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    size = lambda a: F.concat(F.lit("("), a["width"], F.lit(", "), a["height"], F.lit(")"))
    fine = i["ok"] & m["ok"]
    checks = [
        ("MISSING_IMG", ~given("img") | i.isNull(), F.col("img")),
        ("UNREADABLE_IMG", given("img") & ~i["ok"], F.col("img")),
        ("DEGENERATE_SIZE", given("img") & i["ok"] & (F.least(i["width"], i["height"]) < min_side), size(i)),
        ("SPLICE_NO_MASK", splice & ~given("mask"), F.coalesce("kind", F.lit(""))),
        ("MISSING_MASK", given("mask") & m.isNull(), F.col("mask")),
        ("UNREADABLE_MASK", given("mask") & ~m["ok"], F.col("mask")),
        ("EMPTY_MASK", given("mask") & m["ok"] & splice & (m["peak"] == 0), F.lit("all-zero mask on splice")),
        ("MASK_SIZE_MISMATCH", given("mask") & fine & ((i["width"] != m["width"]) | (i["height"] != m["height"])), F.concat(F.lit("img="), size(i), F.lit(" mask="), size(m))),
        ("MISSING_REALPATH", given("real_path") & r.isNull(), F.col("real_path")),
        ("UNREADABLE_REALPATH", given("real_path") & ~r["ok"], F.col("real_path")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("code"), d.alias("detail"))) for n, c, d in checks]), lambda e: e.isNotNull())
    return x.select("item_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.explode(found).alias("i")).select("item_id", "source", "i.code", "i.detail")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Counts by code and by source and code in one pass; hard issues are flagged."""
    c = issues.groupingSets([["code"], ["source", "code"]], "source", "code").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    return c.select(F.when(F.col("gid") > 0, "ALL").otherwise(F.col("source")).alias("source"), "code", "n", F.col("code").isin(*HARD).alias("hard"))


def issue_verdict(items: DataFrame, issues: DataFrame) -> DataFrame:
    """One row (checked, flagged, hard, soft_only, exit_status): items checked and flagged, and 1 where any has a hard fault, else 0."""
    own = issues.groupBy("item_id").agg(F.max(F.col("code").isin(*HARD)).alias("hard"))
    n = own.agg(F.count("*").alias("flagged"), F.count_if("hard").alias("hard"))
    return items.agg(F.count("*").alias("checked")).join(n).select("checked", "flagged", "hard", (F.col("flagged") - F.col("hard")).alias("soft_only"), (F.col("hard") > 0).cast("int").alias("exit_status"))


def write_issue_report(items: DataFrame, issues: DataFrame, path: str) -> None:
    """JSON lines, one for each flagged item, with its issues in the order of their codes."""
    own = issues.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("code", "detail"))).alias("issues"))
    items.join(own, "item_id").select("split", "source", "kind", "img", "mask", "real_path", "issues").write.mode("overwrite").option("ignoreNullFields", "false").json(path)
