"""Scalar functions on labels, as Catalyst expressions.

Letter case and U+0020 are the only axes that are ever folded; look-alike characters never are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.config import EXTRA_CHANNELS, LENGTH_BINS


def normalize_text(text: Column) -> Column:
    """Upper case and nothing else: no trimming, no collapsing of spaces."""
    return F.upper(text)


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def space_key(label: Column) -> Column:
    return F.upper(without_spaces(label))


def crop_name(image: Column, box_index: Column) -> Column:
    """The image less its last extension, and the box's original position in two digits."""
    return F.format_string("%s_%02d.jpg", F.regexp_replace(image, r"\.[^.]*$", ""), box_index.cast("int"))


def token_spans(text: Column) -> Column:
    """(token, start, end) of the parts between U+0020, empty ones dropped; half-open code-point offsets."""
    parts = F.split(text, " ", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.length(F.array_join(F.slice(parts, F.lit(1), i), " ")))
    zipped = F.zip_with(parts, ends, lambda t, e: F.struct(t.alias("token"), (e - F.length(t)).alias("start"), e.alias("end")))
    return F.filter(zipped, lambda x: x["token"] != "")


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def token_bucket(text: Column) -> Column:
    return F.least(token_count(text), F.lit(3))


def length_bin(text: Column) -> Column:
    """The inclusive range that holds the length, null outside all of them."""
    n = F.length(text)
    out = F.when(F.lit(False), F.lit(""))
    for low, high in LENGTH_BINS:
        out = out.when(n.between(low, high), F.lit(f"{low}-{high}"))
    return out


def kind(is_curved: Column) -> Column:
    return F.when(is_curved, F.lit("curved")).otherwise(F.lit("plane"))


def normalized_distance(a: Column, b: Column) -> Column:
    """Edit distance by the longer length; two empty strings have distance 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def car(prediction: Column, truth: Column) -> Column:
    """Character accuracy: 1 less the normalised distance, letter case aside."""
    return 1 - normalized_distance(F.upper(prediction), F.upper(truth))


def joined_text(parts: Column) -> Column:
    return F.upper(F.trim(F.array_join(parts, " ")))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """0.0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def hmean(precision: Column, recall: Column) -> Column:
    return safe_ratio(2 * precision * recall, precision + recall)


def mean_of_characters(confidences: Column) -> Column:
    """Mean over all characters of all fragments (an array of arrays); 0.0 where there are none."""
    flat = F.flatten(confidences)
    return F.when(F.coalesce(F.size(flat), F.lit(0)) > 0, F.aggregate(flat, F.lit(0.0), lambda a, x: a + x) / F.size(flat)).otherwise(F.lit(0.0))


def mean_of_fragments(confidences: Column) -> Column:
    """Mean over the fragments' own means; 0.0 where there are none."""
    means = F.transform(confidences, lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).otherwise(F.lit(0.0)))
    return F.when(F.coalesce(F.size(means), F.lit(0)) > 0, F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.size(means)).otherwise(F.lit(0.0))


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def has_lowercase(text: Column) -> Column:
    return text.rlike(r"\p{Ll}")


def out_channels(charset_size: Column) -> Column:
    return charset_size + EXTRA_CHANNELS
