"""Sequence similarity of two strings (longest matching blocks, as in ``difflib``)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matched characters; only ever run on candidate pairs, never on all pairs."""
    scores, matcher, current = [], SequenceMatcher(None), None
    for a, b in zip(left, right):
        if a is None or b is None:
            scores.append(None)
            continue
        if b != current:  # the matcher indexes its second sequence once
            matcher.set_seq2(b)
            current = b
        matcher.set_seq1(a)
        scores.append(matcher.ratio())
    return pd.Series(scores, dtype="float64")


def similarity_at_least(least: float):
    """``similarity`` where it is ``least`` or more, else null.

    Two upper bounds, by length and by common characters, are tried first: most pairs end there.
    """

    @F.pandas_udf(DoubleType())
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        scores, matcher, current = [], SequenceMatcher(None), None
        for a, b in zip(left, right):
            if b != current:
                matcher.set_seq2(b)
                current = b
            matcher.set_seq1(a)
            ratio = matcher.ratio() if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least else 0.0
            scores.append(ratio if ratio >= least else None)
        return pd.Series(scores, dtype="float64")

    return score
