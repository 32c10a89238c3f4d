"""Text without what layout adds: NFKC, no white space, one hyphen."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else t)


def squeezed(df: DataFrame, text: str, out: str, space: str = "\\s+") -> DataFrame:
    """Adds ``out``: the text in NFKC, without ``space``, with look-alikes of the hyphen folded. ASCII rows skip Python."""
    plain = F.coalesce(F.col(text).rlike("^[\\x00-\\x7F]*$"), F.lit(True))
    fold = lambda c: F.regexp_replace(F.regexp_replace(c, "[\\u2010-\\u2015\\u2212\\u00AD\\uFE63\\uFF0D]", "-"), space, "")
    return df.where(plain).withColumn(out, fold(F.col(text))).unionByName(df.where(~plain).withColumn(out, fold(_nfkc(F.col(text)))))
