"""Role assignment from a comma list of position codes."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_token(pos) -> Column:
    """First code of a comma list, whitespace-stripped; NULL stays NULL."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return _strip(F.split_part(pos.cast("string"), F.lit(","), F.lit(1)))


def _map(role_map: Mapping[str, str]) -> Column:
    return F.create_map(*[x for k, v in role_map.items() for x in (F.lit(k), F.lit(v))])


def assign_role(pos, role_map: Mapping[str, str], na: str = "NA") -> Column:
    """NULL position -> ``na``; mapped first code -> its role; anything else -> NULL."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    first = first_token(pos)
    return F.when(pos.isNull(), F.lit(na)).otherwise(
        F.when(first != "", F.try_element_at(_map(role_map), first)))


def assign_role_default(pos, role_map: Mapping[str, str], default: str = "MID", na: str = "NA") -> Column:
    """Like P1 but every unmapped code (and a NULL position) falls into ``default``."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    first = F.when(pos.isNull(), F.lit(na)).otherwise(first_token(pos))
    return F.coalesce(F.try_element_at(_map(role_map), first), F.lit(default))


def unmapped_codes(df: DataFrame, pos: str, role_col: str = "role") -> DataFrame:
    """Rows whose role is NULL, counted per first code (NULL code for blank lists)."""
    x = df.where(F.col(role_col).isNull()).withColumn("code", first_token(F.col(pos)))
    return x.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
