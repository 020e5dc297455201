"""The few functions Spark has no expression for, as pandas UDFs over Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .citations import extract_markers, resolve, uncited_sentences


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composed form."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(ArrayType(IntegerType()))
def code_aware_markers(text: pd.Series) -> pd.Series:
    """Citation markers outside fenced and inline code."""
    return text.map(extract_markers, na_action="ignore")


@F.pandas_udf(IntegerType())
def code_aware_uncited(text: pd.Series) -> pd.Series:
    """Uncited sentences, where markers in code do not count."""
    return text.map(uncited_sentences, na_action="ignore").astype("Int32")


@F.pandas_udf(StructType().add("answer", StringType()).add("cited", ArrayType(IntegerType())).add("dropped", ArrayType(IntegerType())))
def resolved_citations(answer: pd.Series, cited: pd.Series, k: pd.Series) -> pd.DataFrame:
    """An answer without markers beyond its k passages, what it cites, and the numbers dropped."""
    rows = [resolve(a or "", [int(n) for n in (c if c is not None else ())], int(n)) for a, c, n in zip(answer, cited, k)]
    return pd.DataFrame(rows, columns=["answer", "cited", "dropped"])
