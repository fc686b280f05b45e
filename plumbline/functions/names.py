"""Rules on column names: acronyms, word lists and similarity."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.fixed_values import ACRONYMS


def contains_any(name: Column, words: Sequence[str]) -> Column:
    """Does the lower-cased name hold one of the words?"""
    found = F.lit(False)
    for word in words:
        found = found | F.lower(name).contains(word)
    return found


def expand_acronyms(name: Column) -> Column:
    """Lower-case name with every known abbreviation written out, joined by ``_``."""
    known = F.create_map(*[F.lit(x) for pair in ACRONYMS.items() for x in pair])
    parts = F.filter(F.split(F.lower(name), r"[_\-\s]"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "_")


def similarity(name: Column, patterns: Sequence[str]) -> Column:
    """Best matching-blocks ratio of the name against the patterns, over profile rows."""

    @F.pandas_udf("double")
    def best(names: pd.Series) -> pd.Series:
        return names.map(lambda n: max(SequenceMatcher(None, n.lower(), p).ratio() for p in patterns))

    return best(name)
