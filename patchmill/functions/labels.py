"""Labels and names as people write them: one spelling for each meaning, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that print as nothing, and full-width forms of ASCII letters and digits.
ZERO_WIDTH = "[­​‌‍⁠﻿]"
WIDE = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
NARROW = "0123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz"
EXTENSIONS = "jpg|jpeg|png|webp|tif|tiff|bmp"
SOURCES = "imd2020|casia|anyedit|glidefill|bfree|tgif2|indoor_real"


def label(c: Column | str) -> Column:
    """Letters and digits of c in lower case; NULL stays NULL."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9]", "")


def label_or_unknown(c: Column | str) -> Column:
    """As label, with ``unknown`` for NULL."""
    return F.coalesce(label(c), F.lit("unknown"))


# Blanks at which texts are trimmed, and what separates words of a name.
BLANKS = " \t\n\x0b\f\r"
SEPARATORS = BLANKS + "-."


def plain(c: Column | str) -> Column:
    """c without invisible characters and full-width forms, in lower case, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.translate(c, WIDE + ZERO_WIDTH.strip("[]"), NARROW)))


def words_joined(c: Column | str) -> Column:
    """As plain, with every run of separators written as one underscore and none at the ends."""
    c = F.translate(F.replace(plain(c), F.lit("%20"), F.lit("_")), SEPARATORS, "_" * len(SEPARATORS))
    return F.btrim(F.when(F.contains(c, F.lit("__")), F.regexp_replace(c, "__+", "_")).otherwise(c), F.lit("_"))


def path_plain(c: Column | str) -> Column:
    """A path with single forward slashes, without ``.`` components and without blanks at the ends; letter case stays."""
    c = F.translate(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)), "\\", "/")
    c = F.when(F.contains(c, F.lit("//")), F.regexp_replace(c, "//+", "/")).otherwise(c)
    return F.when(F.contains(c, F.lit("./")), F.regexp_replace(F.regexp_replace(c, r"(?<=/)(\./)+", ""), r"^(\./)+", "")).otherwise(c)


def _first(c: Column, *patterns: str) -> Column:
    """First group of the first pattern that matches, else NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def _number(c: Column) -> Column:
    """A number without leading zeros; other strings as they are."""
    return F.when(c.rlike("^[0-9]+$"), F.regexp_replace(c, "^0+(?=.)", "")).otherwise(c)


def with_names(df: DataFrame, case_id: str = "case_id", img: str = "img", prefix: str = "p_") -> DataFrame:
    """df with the scene and the role of each picture: {prefix}case_scene, {prefix}img_scene, {prefix}scene and {prefix}role.

    case_scene: the scene that case_id names, however it is written: a donor pair, a house and picture, a number or a code.
    img_scene: the scene that the path names: its folder where folders are scenes, else the file's name. scene: the first
    of both that is there. role: the part of the picture in its scene, as the file's name says. Each is NULL where nothing is said. The steps are columns of their own, so that no expression is worked out twice.
    """
    # The roles that file names state; the number of a house's picture is its role.
    roles = r"_([a-z0-9]+_(?:fr|sp)_[a-z0-9]+_v\d+|original_512|original|modified|anchor|diffcat\d+|samecat\d+|real|fake|orig|v\d+)(?=[_@(]|$)"
    c, f, s = (F.col(f"_{prefix}{x}") for x in ("case", "path", "stem"))
    a = df.withColumns({f"_{prefix}case": words_joined(case_id), f"_{prefix}path": path_plain(plain(img))})
    a = a.withColumns({f"_{prefix}case": F.regexp_replace(c, f"^(?:{SOURCES}|indoorreal)_(?=.)", ""), f"_{prefix}stem": words_joined(F.substring_index(f, "/", -1)), f"_{prefix}folder": F.when(F.contains(f, F.lit("imd2020/")) | F.contains(f, F.lit("tgif2/")), words_joined(F.regexp_extract(f, r"(?:^|/)(?:imd2020|tgif2/[a-z0-9_]+)/([^/]+)/[^/]+$", 1)))})
    a = a.withColumns({f"{prefix}case_scene": F.coalesce(_first(c, r"^([a-z]{3}\d+_[a-z]{3}\d+|h\d+_img_\d+)(?:_|$)"), _first(c, "^([^_]+)")), f"_{prefix}house": F.when(F.contains(f, F.lit("/h")), _first(f, r"/(h\d+)/[^/]*$")), f"_{prefix}pic": _first(s, r"^(img_\d+)"), f"_{prefix}pair": _first(s, r"(?:^|_)([a-z]{3}\d{6,}_[a-z]{3}\d{3,})_")})
    a = a.withColumns({f"{prefix}img_scene": F.coalesce(F.concat(F.col(f"_{prefix}house"), F.lit("_"), F.col(f"_{prefix}pic")), F.col(f"_{prefix}pair"), F.nullif(F.col(f"_{prefix}folder"), F.lit("")), _first(s, "^([^_]+)"))})
    a = a.withColumns({f"{prefix}{k}": _number(F.col(f"{prefix}{k}")) for k in ("case_scene", "img_scene")})
    a = a.withColumn(f"{prefix}scene", F.coalesce(f"{prefix}case_scene", f"{prefix}img_scene"))
    a = a.withColumn(f"{prefix}role", F.coalesce(F.col(f"_{prefix}pic"), _first(s, roles)))
    return a.drop(*[f"_{prefix}{x}" for x in ("case", "path", "stem", "folder", "house", "pic", "pair")])
