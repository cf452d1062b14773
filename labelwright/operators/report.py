"""Report helpers: claims that a source does not support, and content versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A code after an E that begins a word, with a letter and a roman number in brackets; a level in mg/kg, whole or
# with decimals; a dotted category code of two to four levels. Each ends its word. Runs that can't match are not gone through twice.
# U+212A is the one other character that has a k for its lower case.
_WORD = r"[\p{L}0-9_]"
_E_NUMBER = rf"(?<!{_WORD})[eE]\s?([0-9]{{3,4}}(?![0-9])(?:[a-zA-Z\u212A](?!\p{{L}}))?(?:\(\s*+[ivxlcIVXLC]++\s*+\)(?!{_WORD})|(?!{_WORD})))"
_MILLIGRAMS = rf"(?<!{_WORD})(?<!\.)([0-9]++(?:\.[0-9]++)?+)\s*+[mM][gG]\s*+/\s*+[kK\u212A][gG](?!{_WORD})"
_CATEGORY = rf"(?<!{_WORD})(?<![0-9]\.)([0-9]{{1,2}}(?:\.[0-9]{{1,2}}(?![0-9])){{1,3}})(?!{_WORD})"


def unsupported_claims(text: Column, source: Column) -> Column:
    """Codes after E, levels in mg/kg and category codes of a text that do not occur in its source, in order of kind."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(kind), 1) for kind in (_E_NUMBER, _MILLIGRAMS, _CATEGORY)))
    return F.filter(found, lambda x: ~F.contains(source, x))


def content_version(rows: DataFrame, columns: list[str], digits: int = 12) -> DataFrame:
    """One row: the first hex digits of a hash of the sorted rows. For reference tables; it gathers them in one task."""
    line = F.concat_ws("|", *columns)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*columns, line.alias("line")))), lambda x: x["line"]), ";")
    return rows.agg(F.substring(F.sha2(ordered.cast("binary"), 256), 1, digits).alias("version"))
