"""Conditions as data, pages, lookups and searches. Everything folds to filters that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {
    "in": lambda c, v: c.isin(list(v)),
    "like": lambda c, v: c.like(v),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "ne": lambda c, v: c != v,
}


def condition(conditions: dict, strict_reference: bool = False) -> Column:
    """{field: value}, {field: list} or {field: {operator: value, ...}} as one predicate; all operators hold.

    strict_reference: only the first operator of a field, in the order of OPERATORS, is applied.
    """
    parts = []
    for field, value in conditions.items():
        c = F.col(field)
        if isinstance(value, dict):
            if unknown := set(value) - set(OPERATORS):
                raise ValueError(f"unknown operators: {sorted(unknown)}")
            chosen = [op for op in OPERATORS if op in value]
            parts += [OPERATORS[op](c, value[op]) for op in (chosen[:1] if strict_reference else chosen)]
        elif isinstance(value, (list, tuple, set)):
            parts.append(c.isin(list(value)))
        else:
            parts.append(c.isNull() if value is None else c == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def find(df: DataFrame, conditions: dict, strict_reference: bool = False) -> DataFrame:
    return df.where(condition(conditions, strict_reference))


def live(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    return df if include_deleted else df.where("is_deleted = 'N'")


def page(df: DataFrame, order_by: str, skip: int = 0, limit: int = 100, descending: bool = True, tie: str = "id") -> DataFrame:
    """Rows skip to skip + limit in order, nulls first when descending and last when ascending, ties by `tie`."""
    first = F.desc_nulls_first(order_by) if descending else F.asc_nulls_last(order_by)
    ordered = df.orderBy(first, F.asc(tie))
    return (ordered.offset(skip) if skip else ordered).limit(limit)


def one(df: DataFrame, conditions: dict) -> dict | None:
    """The one row that meets the conditions, None without any; more than one is an error."""
    rows = find(df, conditions).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row")
    return rows[0].asDict(recursive=True) if rows else None


def exists(df: DataFrame, conditions: dict) -> bool:
    return not find(df, conditions).isEmpty()


def contains_any(columns: list[str], text: str) -> Column:
    """Case-blind search of a text in any of the columns; %, _ and \\ in it are plain characters."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{escaped}%"), F.lit(False)) for c in columns])


def between(column: str, low=None, high=None) -> Column:
    """Closed range; None is open."""
    c, out = F.col(column), F.lit(True)
    if low is not None:
        out = out & (c >= F.lit(low))
    return out & (c <= F.lit(high)) if high is not None else out


def search_products(df: DataFrame, keyword: str | None = None, category: str | None = None, price: tuple = (None, None), rating: tuple = (None, None), status: str | None = None, supplier_id: int | None = None) -> DataFrame:
    where = between("price_min", *price) & between("rating", *rating)
    if keyword:
        where = where & F.col("title").like(f"%{keyword}%")
    for name, value in (("category_name", category), ("status", status), ("supplier_id", supplier_id)):
        if value is not None:
            where = where & (F.col(name) == value)
    return df.where(where)


def search_suppliers(df: DataFrame, keyword: str | None = None, province: str | None = None, rating: tuple = (None, None), min_products: int | None = None) -> DataFrame:
    where = between("rating", *rating) & between("product_count", min_products)
    if keyword:
        where = where & contains_any(["name", "company_name"], keyword)
    return df.where(where & (F.col("province") == province) if province else where)


def search_logs(df: DataFrame, text: str | None = None, levels: list[str] | None = None, since=None, until=None, task_id: str | None = None) -> DataFrame:
    """Logs whose message or details hold the text, of the levels, in the closed time range."""
    where = between("timestamp", since, until)
    if text:
        where = where & contains_any([c for c in ("message", "details") if c in df.columns], text)
    if levels:
        where = where & F.col("level").isin(levels)
    return df.where(where & (F.col("task_id") == task_id) if task_id else where)


def available_products(df: DataFrame) -> DataFrame:
    return df.where("status = 'active' AND price_min > 0")


def active_suppliers(df: DataFrame) -> DataFrame:
    return df.where("product_count >= 1 AND rating >= 3.0")


def without_ignored(errors: DataFrame, fingerprints: DataFrame, types: list[str], phrases: list[str]) -> DataFrame:
    """Errors that no ignore rule names; fingerprints has one column of that name."""
    out = errors.join(fingerprints.select("fingerprint"), "fingerprint", "left_anti")
    out = out.where(~F.coalesce(F.col("error_type").isin(types), F.lit(False))) if types else out
    return out.where(~contains_any(["message"], phrases[0])) if len(phrases) == 1 else reduce(lambda d, p: d.where(~contains_any(["message"], p)), phrases, out)


def locale_order(df: DataFrame, column: str, descending: bool = False, collation: str = "UNICODE", tie: str | None = None) -> list[Column]:
    """Sort order as people read: text by the collation's letters (accents after the plain letter, small before capital), nulls last ascending and first descending."""
    key = F.collate(column, collation) if dict(df.dtypes)[column].startswith("string") else F.col(column)
    first = key.desc_nulls_first() if descending else key.asc_nulls_last()
    return [first, *([F.col(tie)] if tie else [])]
