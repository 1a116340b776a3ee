"""Column functions over file names, ids, annotators and small text formats. All are plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frame-id pattern, the annotator keys in order of preference, and the image suffixes.
FRAME = r"(\d{14}[A-Za-z]h)"
ANNOTATOR_KEYS = ("annotator", "annotator_id", "annotator_name", "labeler", "rater", "user_id")
IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|tif|tiff)$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """Base name without its last extension; a name that only begins with a dot keeps it."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def image_stem(path: Column) -> Column:
    """The first frame id in the base name, else the last dash-separated token of the file stem (null if that is empty)."""
    base = base_name(path)
    token = F.regexp_extract(file_stem(path), r"([^-]*)$", 1)
    return F.coalesce(blank_to_null(F.regexp_extract(base, FRAME, 1)), blank_to_null(token))


def month_key(stem: Column) -> Column:
    return F.substring(stem, 1, 6)


def year_key(stem: Column) -> Column:
    return F.substring(stem, 1, 4)


def frame_time(stem: Column) -> Column:
    return F.try_to_timestamp(F.substring(stem, 1, 14), F.lit("yyyyMMddHHmmss"))


def frame_name(ts: Column, site: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMddHHmmss"), site, F.lit("h"))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty; 0 and false count as filled."""
    return F.coalesce(*[blank_to_null(v.cast("string")) for v in values])


def annotator_of(entry: Column) -> Column:
    """The annotator that a variant object names, by the keys' order; booleans are written as in JSON's Python form."""
    def one(key: str) -> Column:
        text = F.try_variant_get(entry, f"$.{key}", "string")
        kind = F.schema_of_variant(F.try_variant_get(entry, f"$.{key}", "variant"))
        return blank_to_null(F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text))

    return F.coalesce(*[one(k) for k in ANNOTATOR_KEYS])


def prefix_annotator(name: Column, stem: Column) -> Column:
    """What stands before the stem in a base name, without dashes, underscores and blanks around; null if nothing does."""
    base = base_name(name)
    before = F.when(F.contains(base, stem), F.split_part(base, stem, F.lit(1)))
    return blank_to_null(F.regexp_replace(before, r"^[-_ ]+|[-_ ]+$", ""))


def default_annotator(*candidates: Column, image_id: Column) -> Column:
    return F.coalesce(*candidates, F.concat(F.lit("img"), image_id.cast("string")))


def side_or_default(side: Column, default: int = 2048) -> Column:
    return F.coalesce(F.nullif(side.cast("int"), F.lit(0)), F.lit(default))


def working_size(side: Column, scale: Column) -> Column:
    """max(32, side * scale) rounded half to even."""
    return F.greatest(F.lit(32), F.bround(side * scale).cast("int"))


def instance_id(stem: Column, n: Column) -> Column:
    return F.concat_ws("_", stem, n.cast("string"))


def instance_stem(id_: Column) -> Column:
    return blank_to_null(F.regexp_extract(id_, r"^(.+)_(\d+)$", 1))


def instance_number(id_: Column) -> Column:
    """The number; null where there is none, or where it has more digits than a long holds."""
    return blank_to_null(F.regexp_extract(id_, r"^(.+)_(\d+)$", 2)).try_cast("long")


def number_list(text: Column, kind: str = "double") -> Column:
    """Numbers of a comma-separated list; blank entries are skipped."""
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast(kind))


def shortened(value: Column, most: int = 400) -> Column:
    """JSON text, cut with an ellipsis."""
    text = F.to_json(value)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(" ..."))).otherwise(text)


def is_image(path: Column) -> Column:
    return path.rlike(IMAGE_SUFFIX)


def illegal_counts(counts: Column) -> Column:
    """Whether an RLE text could not stand unquoted in a CSV row."""
    return counts.rlike("[,\"'\\n]")


def rings(flat: Column) -> Column:
    """Rings with at least three points."""
    return F.filter(flat, lambda r: F.size(r) >= 6)


def normalized_polygons(pairs: Column) -> Column:
    """Rings (flat doubles) of an array of number arrays: all pairs form one ring; else each array is a ring of its own."""
    only_pairs = F.forall(pairs, lambda p: F.size(p) == 2)
    return rings(F.when(only_pairs, F.array(F.flatten(pairs))).otherwise(pairs))
