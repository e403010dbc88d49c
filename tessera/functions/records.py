"""What only a parser can read: objects in model answers, differences of texts."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def first_object(text: str | None) -> str | None:
    """The first JSON object in a text, fences and talk around it left out; null if there is none that parses."""
    if not text:
        return None
    reader, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, end = reader.raw_decode(text, at)
        except ValueError:
            at = text.find("{", at + 1)
            continue
        return text[at:end] if isinstance(value, dict) else None
    return None


@F.pandas_udf(StringType())
def json_object(s: pd.Series) -> pd.Series:
    """The first JSON object in each text."""
    return s.map(first_object)


@F.pandas_udf(StringType())
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """The unified difference of two texts by lines; null counts as empty."""
    return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "before", "after", lineterm="")) for x, y in zip(a, b)])
