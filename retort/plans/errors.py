"""Failed rows as data: an err struct (element_id, element_name, message), filters on it, and re-insertion by row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERR = "struct<element_id:string,element_name:string,message:string>"


def failed(element_ids: list[str] | None = None, filter_everything: bool = True) -> Column:
    """Whether a row's error is one to remove: any, or one of the elements named."""
    if element_ids is None and not filter_everything:
        raise ValueError("name elements or filter everything")
    hit = F.col("err").isNotNull()
    return hit if filter_everything and element_ids is None else hit & F.col("err.element_id").isin(list(element_ids or []))


def error_filter(df: DataFrame, element_ids: list[str] | None = None, filter_everything: bool = True) -> DataFrame:
    return df.where(~F.coalesce(failed(element_ids, filter_everything), F.lit(False)))


def rejected(df: DataFrame, element_ids: list[str] | None = None, filter_everything: bool = True) -> DataFrame:
    return df.where(F.coalesce(failed(element_ids, filter_everything), F.lit(False))).select("row_id", "err.*")


def reinsert(ids: DataFrame, preds: DataFrame, fill: dict) -> DataFrame:
    """Every row_id of ids, with the columns of preds; those that are missing there take the fill values (null stays null)."""
    p = preds.withColumn("_there", F.lit(True))
    out = ids.select("row_id").join(p, "row_id", "left")
    cols = {c: F.when(F.col("_there").isNull(), F.lit(v)).otherwise(F.col(c)) for c, v in fill.items() if v is not None}
    return out.withColumns(cols).drop("_there")


def is_valid() -> Column:
    """Errors become false; nothing is propagated after it."""
    return F.col("err").isNull()
