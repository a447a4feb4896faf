"""Unicode and XML text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def nfc(text: Column) -> Column:
    """Composed characters. Spark has no such function; texts of ASCII alone are what they were, and Python sees nulls for them."""
    other = F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), text)
    return F.coalesce(_nfc(other), text)


def xml_decode(text: Column) -> Column:
    """Five entities, the ampersand first, so that an escaped one opens the next."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_encode(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
