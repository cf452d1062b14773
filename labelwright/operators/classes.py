"""Functional classes: split strings, unions by category or query, mismatch and phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .advisory import functional_classes


def split_classes(raw: Column, vocabulary: tuple[str, ...]) -> Column:
    """Classes welded into one line, split before capitals; failing that, read off as the longest known class at each place.

    Where neither leaves nothing over, the line stays whole: a wrong split would relabel a substance.
    """
    line = F.trim(raw)
    parts = F.transform(F.split(F.regexp_replace(line, r"\s+([A-Z])", "\u0001$1"), "\u0001"), F.trim)
    known = F.size(F.array_except(parts, F.array(*map(F.lit, vocabulary)))) == 0
    words = F.array_join(F.filter(F.split(F.regexp_replace(line, "([a-z])([A-Z])", "$1 $2"), r"[\s,;/]+"), lambda w: w != ""), " ")
    # longest first, and what is taken is not given back
    one = "(?>" + "|".join(re.escape(c) for c in sorted(vocabulary, key=lambda c: (-len(c.split()), c))) + r")(?=[.]?( |$))"
    chain = words.rlike(rf"^({one}[.]?( |$))+$")
    return F.when(line == "", F.array().cast("array<string>")).when(known, parts).when(chain, F.regexp_extract_all(words, F.lit(one), 0)).otherwise(F.array(line))


def name_and_ins(text: Column) -> list[Column]:
    """ "Citric acid (330)" -> name and ins."""
    pattern = r"^(.*?)\s*\((\d{3,4}[a-z]?(?:\([ivxlc]+\))?)\)\s*$"
    ins = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    return [F.when(ins.isNull(), text).otherwise(F.regexp_extract(text, pattern, 1)).alias("name"), ins.alias("ins")]


def role_class_mismatch(roles: Column, classes: Column) -> Column:
    return (F.size(roles) > 0) & (F.size(classes) > 0) & ~F.arrays_overlap(roles, classes)


def classes_by(pairs: DataFrame, by: str, substances: DataFrame) -> DataFrame:
    """The union of the functional classes of the substances (canonical_id) of each group."""
    own = functional_classes(pairs, "canonical_id", substances).select("canonical_id", F.explode("classes").alias("c"))
    return pairs.join(own, "canonical_id").groupBy(by).agg(F.array_sort(F.collect_set("c")).alias("classes"))


def candidates_phrase(names: Column, many: int = 6) -> Column:
    """The names, or how many of a family there are: the longest word of four letters or more that all of them hold."""
    words = F.filter(F.regexp_extract_all(F.lower(F.get(names, F.lit(0))), F.lit(r"\w+"), 0), lambda w: (F.length(w) >= 4) & F.forall(names, lambda n: F.contains(F.lower(n), w)))
    family = F.coalesce(F.get(F.array_sort(words, lambda a, b: F.length(b) - F.length(a)), F.lit(0)), F.lit("substance"))
    return F.when(F.size(names) < many, F.array_join(names, ", ")).otherwise(F.concat(F.size(names).cast("string"), F.lit(" different "), family, F.lit("s")))


def cites_only_foreign(code: Column, description: Column) -> Column:
    """The description cites category codes in brackets, and none below the code's own top level."""
    bracketed = F.transform(F.regexp_extract_all(description, F.lit(r"\(([^()]*)\)"), 1), F.trim)
    cited = F.filter(bracketed, lambda c: c.rlike(r"^[0-9]+([.][0-9]+)*$"))
    top = F.split_part(code, F.lit("."), F.lit(1))
    return (F.size(cited) > 0) & ~F.exists(cited, lambda c: F.split_part(c, F.lit("."), F.lit(1)) == top)
