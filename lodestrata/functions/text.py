"""Column functions over text: labels, ids, token sets, overlap, hash votes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space in labels, and what is cut out of objectives.
_WHITE = r"(?U)[\s\x1c-\x1f]+"
_NO_WORD = r"(?U)[^\p{L}\p{N}\s\x1c-\x1f]"


def _parts(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WHITE), lambda part: part != "")


def normalize_label(label: Column) -> Column:
    """Lower-cased, without outer white space, inner runs of it as one space. Null stays null."""
    return F.array_join(_parts(label), " ")


def seed_terms(objective: Column, most: int = 3) -> Column:
    """The first distinct words of an objective, punctuation aside; ['core'] if there is none."""
    found = F.slice(F.array_distinct(_parts(F.regexp_replace(objective, _NO_WORD, " "))), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("core")))


def _digest12(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def taxonomy_id(namespace: Column, parent_id: Column, label: Column) -> Column:
    return F.concat(F.lit("tax-"), _digest12(F.concat_ws("|", namespace, F.coalesce(parent_id, F.lit("root")), normalize_label(label))))


def stable_id(prefix: str, *parts: Column) -> Column:
    """A content-addressed id of the parts, which are not null."""
    return F.concat(F.lit(f"{prefix}-"), _digest12(F.concat_ws("::", *parts)))


def token_set(text: Column) -> Column:
    """Distinct [a-z0-9]+ of the lower-cased text; empty for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def overlap(left: Column, right: Column) -> Column:
    """Common tokens over the smaller set's size; 0 if either set is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / least)


def hash_vote(text: Column, critic: str) -> Column:
    """'accept' if the first byte of sha1('critic::text') is even, else 'reject'; null text votes as empty."""
    digest = F.sha1(F.concat(F.lit(f"{critic}::"), F.coalesce(text, F.lit(""))))
    return F.when(F.substring(digest, 2, 1).isin(*"02468ace"), F.lit("accept")).otherwise(F.lit("reject"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def complexity_score(is_complexified: Column, quality_status: Column) -> Column:
    """0.9 if complexified, else 0.45; 0.05 more if accepted."""
    base = F.when(F.coalesce(is_complexified, F.lit(False)), F.lit(0.9)).otherwise(F.lit(0.45))
    return base + F.when(quality_status == "accepted", F.lit(0.05)).otherwise(F.lit(0.0))
