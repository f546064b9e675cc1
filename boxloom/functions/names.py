"""Class names: normalisation, aliases, and the fixed classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The canonical classes (position = id), the tokens that a name loses in order, and the aliases in declared order.
CLASSES = ["apple", "banana", "orange", "mango", "pineapple", "watermelon", "grapes", "pomegranate"]
TOKENS = ["bad_", "good_", " overripe", " ripe", " rotten", " unripe", "-0 day"]
ALIASES = [
    ("apple", "apple"),
    ("banana", "banana"),
    ("orange", "orange"),
    ("orange fruit", "orange"),
    ("mango", "mango"),
    ("pineapple", "pineapple"),
    ("watermelon", "watermelon"),
    ("grape", "grapes"),
    ("grapes", "grapes"),
    ("pomegranate", "pomegranate"),
]
# Sources whose map is fixed, by raw id.
FIXED_MAPS = {"mango_ripeness_yolo": {0: "mango", 2: "mango", 3: "mango", 4: "mango"}, "watermelon-muqdf": {0: "watermelon"}}


def classes(spark: SparkSession) -> DataFrame:
    """(class_id, name) of the canonical classes."""
    return spark.createDataFrame(list(enumerate(CLASSES)), "class_id int, name string")


def normalize_name(name: Column) -> Column:
    """Trimmed, lower case, without the fixed tokens; underscores, hyphens and slashes are blanks, and blanks collapse."""
    out = F.lower(F.trim(name))
    for token in TOKENS:
        out = F.replace(out, F.lit(token), F.lit(" "))
    return F.trim(F.regexp_replace(F.translate(out, "_-/", "   "), r"\s+", " "))


def resolve_alias(name: Column, aliases=None, order: str = "declared", lowered: bool = False) -> Column:
    """Canonical class of a name: exact alias, else the first alias that it contains, by declared order or longest first.

    With `lowered` the lower-case name is looked up between the two. Null without any.
    """
    aliases = list(ALIASES if aliases is None else aliases)
    exact = F.create_map(*(F.lit(x) for pair in dict(aliases).items() for x in pair))
    held = sorted(aliases, key=lambda a: -len(a[0])) if order == "longest" else aliases
    entries = F.array(*(F.struct(F.lit(a.lower()).alias("key"), F.lit(c).alias("value")) for a, c in held))
    inside = F.get(F.filter(entries, lambda e: F.contains(F.lower(name), e["key"])), F.lit(0))["value"]
    found = [F.try_element_at(exact, name), *([F.try_element_at(exact, F.lower(name))] if lowered else []), inside]
    return F.coalesce(*found)


def class_map(source_classes: DataFrame) -> DataFrame:
    """(tag, raw_id, class_id) from (tag, raw_id, raw_name): fixed maps for some tags; skipped names and unknown ones are absent."""
    ids = F.create_map(*(F.lit(x) for k, c in enumerate(CLASSES) for x in (c, k)))
    fixed = F.create_map(*(F.lit(x) for tag, m in FIXED_MAPS.items() for raw, c in m.items() for x in (f"{tag}:{raw}", c)))
    skipped = F.endswith("raw_name", F.lit("_skip")) | (F.col("raw_name") == "Not_Mango")
    named = F.when(~skipped, resolve_alias(normalize_name(F.col("raw_name"))))
    given = F.try_element_at(fixed, F.concat_ws(":", "tag", "raw_id"))
    name = F.when(F.col("tag").isin(*FIXED_MAPS), given).otherwise(named)
    return source_classes.select("tag", "raw_id", F.try_element_at(ids, name).alias("class_id")).where("class_id is not null")
