"""Strings of labels, prompts and replies, as Column algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import small

#: The unit separator between the parts that a token hashes.
SEPARATOR = chr(31)


def token(*parts: Column | str) -> Column:
    """The 32-digit token of some parts: MD5 of them joined by the unit separator; a null part reads None."""
    columns = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("None")) for p in parts]
    return F.md5(F.concat_ws(SEPARATOR, *columns))


def normal_category(name: Column) -> Column:
    """Trimmed, in lower case, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def resolve_categories(rows: DataFrame, mapping: DataFrame, blocked: DataFrame, category: str = "category") -> DataFrame:
    """Adds ``resolved`` and ``state`` (mapped, blocked or unmapped) by tables of (name, target) and (name).

    The tables are vocabularies; they are broadcast if their counts say that they are small.
    """
    key = normal_category(F.col(category))
    known = mapping.select(normal_category(F.col("name")).alias("__name"), F.col("target").alias("resolved")).dropDuplicates(["__name"])
    stopped = blocked.select(normal_category(F.col("name")).alias("__stop")).distinct().withColumn("__blocked", F.lit(True))
    out = rows.withColumn("__key", key)
    out = out.join(small(known), F.col("__key") == F.col("__name"), "left").join(small(stopped), F.col("__key") == F.col("__stop"), "left")
    state = F.when(F.col("__blocked"), "blocked").when(F.col("resolved").isNull(), "unmapped").otherwise("mapped")
    out = out.withColumn("state", state).withColumn("resolved", F.when(F.col("state") == "mapped", F.col("resolved")))
    return out.drop("__key", "__name", "__stop", "__blocked")


def strip_article(phrase: Column) -> Column:
    """A phrase without a leading a, an or the."""
    return F.regexp_replace(F.trim(phrase), r"(?i)^(?:a|an|the)\s+", "")


def prompt_for(phrase: Column) -> Column:
    return F.lower(strip_article(phrase))


def caption_spans(phrases: DataFrame, group: list[str], order: str, phrase: str, separator: str = " . ") -> DataFrame:
    """Adds the character span (start, stop) of every phrase in its group's joined caption."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(phrase) + len(separator)).over(before), F.lit(0))
    return phrases.withColumn("start", start.cast("long")).withColumn("stop", (F.col("start") + F.length(phrase)).cast("long"))


def captions(phrases: DataFrame, group: list[str], order: str, phrase: str, separator: str = " . ") -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(phrase).alias("p"))))
    return phrases.groupBy(*group).agg(F.array_join(F.transform(parts, lambda s: s["p"]), separator).alias("caption"))


#: Answers that are no class: the model can't tell, or the reply can't be read.
UNCLEAR, ERROR = "unclear", "error"


def reply_label(reply: Column) -> Column:
    """What a model's reply says, in lower case: thoughts are dropped, and of its JSON objects the last whose label is a string counts.

    Asides in parentheses and a full stop at the end are dropped; null if no object has such a label.
    """
    said = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    objects = F.regexp_extract_all(said, F.lit(r"(\{[^{}]*\})"), F.lit(1))
    # JSON paths don't tell strings from numbers; the variant's type does
    labels = F.transform(objects, lambda o: F.try_parse_json(o))
    texts = F.filter(labels, lambda v: F.schema_of_variant(F.try_variant_get(v, "$.label", "variant")) == "STRING")
    label = F.lower(F.trim(F.try_variant_get(F.try_element_at(texts, F.lit(-1)), "$.label", "string")))
    label = F.regexp_replace(F.regexp_replace(label, r"\.+$", ""), r"\s*\([^)]*\)", "")
    return F.regexp_replace(F.trim(label), r"\.+$", "")


def answer(label: Column, allowed: Column) -> Column:
    """The allowed class that a label names, with its article or without; "unclear" stays, what names none is null."""
    bare = F.transform(allowed, strip_article)
    at = F.array_position(bare, strip_article(label))
    return F.when(label == UNCLEAR, UNCLEAR).when(F.array_contains(allowed, label), label).when(at > 0, F.try_element_at(allowed, at.cast("int")))


def verdict(label: Column, own: Column, allowed: Column) -> Column:
    """confirmed, relabeled, unclear or error, from a reply's label, the row's class and the allowed classes."""
    said = answer(label, allowed)
    return F.when(said.isNull(), ERROR).when(said == UNCLEAR, UNCLEAR).when(said == own, "confirmed").otherwise("relabeled")


def location_of(text: Column, places: list[str], other: str = "unknown") -> Column:
    """The first of the places that a description contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(low.contains(p.lower()), p) for p in places), F.lit(other))


def is_night(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).contains("night")


def numbers_of(ranges: Column) -> Column:
    """The numbers of a list of ranges such as "1-3,5", sorted and distinct."""
    parts = F.filter(F.split(F.regexp_replace(ranges, r"\s", ""), ","), lambda p: p != "")
    each = F.transform(parts, lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def masked(name: Column, value: Column, pattern: str = r"(?i)(secret|token|password|passwd|key|credential)") -> Column:
    """The value of a setting, hidden where its name tells of a secret."""
    return F.when(name.rlike(pattern), "***").otherwise(value)


def natural_key(name: Column) -> Column:
    """Sorts names that are numbers by value, before the others."""
    number = name.try_cast("long")
    return F.struct(number.isNull().alias("text"), number.alias("number"), name.alias("name"))


def dug(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON document."""
    return F.get_json_object(json, "$." + path)


def worse_tier(a: Column, b: Column, order: tuple[str, ...] = ("auto_accept", "flagged", "rejected")) -> Column:
    """Of two tiers, the later in the order."""
    rank = lambda c: F.coalesce(*(F.when(c == t, i) for i, t in enumerate(order)))
    worst = F.greatest(rank(a), rank(b))
    return reduce(lambda done, it: done.when(worst == it[0], it[1]), enumerate(order[1:], 1), F.when(worst == 0, order[0]))


def environment(lines: DataFrame, column: str = "value") -> DataFrame:
    """name and value of the lines of a dotenv file; comments and blank lines are left out, the last setting counts."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    rows = lines.withColumn("name", F.regexp_extract(column, pattern, 1)).withColumn("setting", F.regexp_extract(column, pattern, 2))
    rows = rows.where("name <> ''").withColumn("setting", F.regexp_replace("setting", r"^(['\"])(.*)\1$", "$2"))
    rows = rows.withColumn("line", F.monotonically_increasing_id())
    return rows.groupBy("name").agg(F.max_by("setting", "line").alias("value"))
