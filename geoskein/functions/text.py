"""Name normalisation.  The Unicode forms have no built-in in Spark, so these are Arrow-batched Pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the words that the first variant writes alike.
STATION_WORD = r"\b(station|st\.?)\b"


def _folded_name(text: str | None) -> str:
    if not text:
        return ""
    plain = unicodedata.normalize("NFKC", text).casefold().strip()
    return " ".join(re.findall(r"\w+", re.sub(STATION_WORD, "st", plain)))


def _ascii_name(text: str | None) -> str:
    if not text:
        return ""
    marks_off = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
    return " ".join(re.findall(r"[a-z0-9]+", marks_off.casefold()))


def _batched(one) -> Callable[[pd.Series], pd.Series]:
    def run(values: pd.Series) -> pd.Series:
        known: dict = {}  # names repeat: each is normalised once a batch
        return values.map(lambda v: known[v] if v in known else known.setdefault(v, one(v if isinstance(v, str) else None)))

    return run


def _folded(values: pd.Series) -> pd.Series:
    return _batched(_folded_name)(values)


def _ascii(values: pd.Series) -> pd.Series:
    return _batched(_ascii_name)(values)


def normalized_name(name: Column) -> Column:
    """NFKC, case-folded, station words alike, words joined by single spaces; NULL and blank give the empty string."""
    return F.coalesce(F.pandas_udf(_folded, StringType())(name), F.lit(""))


def ascii_name(name: Column) -> Column:
    """The stricter variant: ASCII letters and digits only, marks dropped."""
    return F.coalesce(F.pandas_udf(_ascii, StringType())(name), F.lit(""))
