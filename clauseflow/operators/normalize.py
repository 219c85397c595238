"""Normalisation of documents: composed form where a text needs it, then the chain of functions/text.py."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clauseflow import constants as K
from clauseflow.functions import text as X
from clauseflow.session import share_package


def compose(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with text in Unicode's composed form. Only rows with characters that it can change go through Python."""
    share_package(docs.sparkSession)

    @F.pandas_udf("string")
    def nfc(column: pd.Series) -> pd.Series:
        return column.map(lambda s: unicodedata.normalize("NFC", s))

    odd = F.coalesce(F.col(text).rlike(X.composable()), F.lit(False))
    return docs.where(~odd).unionByName(docs.where(odd).withColumn(text, nfc(text)))


def normalize_documents(docs: DataFrame, text: str = "text", most: int = K.MAX_TEXT_CHARS) -> DataFrame:
    """docs with normalised text, its statistics, and a warning where it had to be cut to `most` characters."""
    df = once(compose(docs, text), _unified=X.unify_lines(F.coalesce(F.col(text), F.lit(""))))
    df = once(df, _joined=X.dehyphenate(F.col("_unified")))
    df = once(df, _lines=F.split(X.break_long_lines(F.col("_joined")), "\n"))
    df = once(df, _kept=F.filter("_lines", lambda x: ~X.is_noise(x)))
    df = once(df, _whole=F.array_join("_kept", "\n"))
    df = once(df, _out=X.collapse(F.col("_whole")))
    df = df.withColumn(
        "stats",
        F.struct(
            F.length(F.coalesce(F.col(text), F.lit(""))).alias("input_chars"), F.length("_out").alias("output_chars"), (F.size("_lines") - F.size("_kept")).alias("removed_noise_lines"),
            (F.col("_joined") != F.col("_unified")).alias("dehyphenated"),
        ),
    )
    df = df.withColumn(text, F.substring("_out", 1, most)).withColumn("truncated", F.length("_out") > most)
    return df.drop("_unified", "_joined", "_lines", "_kept", "_whole", "_out")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns behind a generator of one row: the optimizer would copy their expressions to each place of use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


# Marks that count as the same.
_SAME = str.maketrans({c: one for same, one in (("“”\"'‘’`", '"'), ("，,", ","), ("。．.", "."), ("；;", ";"), ("：:", ":"), ("（(", "("), ("）)", ")"), ("—–－-", "-")) for c in same} | {"\ufeff": None})


def fingerprint(s: str | None) -> str:
    """What counts of a text when quotes are compared: compatibility form, no blanks, one form of each mark, lower case."""
    return "".join(unicodedata.normalize("NFKC", s or "").split()).translate(_SAME).lower()


@F.pandas_udf(StringType())
def fingerprint_udf(column: pd.Series) -> pd.Series:
    return column.map(fingerprint)
