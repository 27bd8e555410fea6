"""SQL names for the engine's functions, and its data source."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similarity, text
from ..sources.paged import PagedJson


@F.udtf(returnType="token string, position int")
class Tokens:
    """The letter-and-digit tokens of a text, folded, with their places; null gives none."""

    def eval(self, name: str) -> Iterator[tuple[str, int]]:
        folded = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c)).lower()
        for i, t in enumerate(x for x in re.split(r"[\W_]+", folded) if x):
            yield t, i


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _birth_years(dobs):  # noqa: ANN001, ANN202
    """Years 1900-2100 that open the items of a ``|`` list."""
    read = lambda d: [int(x.strip()[:4]) for x in (d or "").split("|") if re.fullmatch(r"\d{4}", x.strip()[:4]) and 1900 <= int(x.strip()[:4]) <= 2100]
    return dobs.map(read)


def register(spark: SparkSession) -> list[str]:
    """Register the functions and the table function ``tokens`` for use in SQL, and the source ``paged_json``; returns the names of functions."""
    fs = {
        "fold_accents": text.fold_accents, "metaphone": text.metaphone, "lcs_ratio": similarity.bulk_ratio, "token_sort_ratio": similarity.bulk_token_sort,
        "token_set_ratio": similarity.bulk_token_set, "weighted_ratio": similarity.bulk_weighted, "name_score": similarity.name_score, "birth_years": _birth_years,
    }
    for name, f in fs.items():
        spark.udf.register(name, f)
    spark.udtf.register("tokens", Tokens)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalize_name(t STRING) RETURNS STRING RETURN array_join(filter(split(trim(replace(regexp_replace(fold_accents(t), '"
        + text.SPECIAL.replace("\\", "\\\\") + "', ' '), chr(39), '')), '\\\\s+'), w -> w <> '' AND NOT array_contains(array(" + ", ".join(f"'{w}'" for w in text.NOISE) + "), w)), ' ')"
    )
    spark.dataSource.register(PagedJson)
    return sorted([*fs, "normalize_name", "tokens"])
