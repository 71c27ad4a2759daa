"""Declarative validation: each rule is a Column that is null or a finding (level, field, message)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import is_url

# Required fields, length limits, and bounds.
PRODUCT_REQUIRED, SUPPLIER_REQUIRED = ("source_id", "title"), ("source_id", "name")
PRODUCT_LENGTHS = {"title": 500, "subtitle": 500, "description": 2000}
SUPPLIER_LENGTHS = {"name": 200, "description": 1000, "company_name": 200}
LOWEST_PRICE, HIGHEST_PRICE, HIGHEST_SALES, MOST_SPECIFICATIONS = 0.01, 1_000_000, 10_000_000, 50
KNOWN_CURRENCIES = ("CNY", "USD", "EUR")

FINDING = "struct<level:string,field:string,message:string>"


def finding(when: Column, level: str, field: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), F.lit(message).alias("message"))).otherwise(F.lit(None).cast(FINDING))


def required(fields: tuple[str, ...], get: Callable[[str], Column]) -> list[Column]:
    return [finding(F.trim(F.coalesce(get(f).cast("string"), F.lit(""))) == "", "error", f, "required") for f in fields]


def lengths(limits: dict[str, int], get: Callable[[str], Column]) -> list[Column]:
    return [finding(F.length(get(f).cast("string")) > most, "warning", f, f"longer than {most}") for f, most in limits.items()]


def price_rules(get: Callable[[str], Column]) -> list[Column]:
    low, high = (get(c).try_cast("decimal(20,6)") for c in ("price_min", "price_max"))
    return [
        finding(get("price_min").isNotNull() & low.isNull(), "error", "price_min", "not a number"),
        finding(low <= 0, "error", "price_min", "not above 0"),
        finding((low > 0) & (low < LOWEST_PRICE), "warning", "price_min", "too low"),
        finding(low > HIGHEST_PRICE, "warning", "price_min", "too high"),
        finding(get("price_max").isNotNull() & high.isNull(), "error", "price_max", "not a number"),
        finding(high <= 0, "error", "price_max", "not above 0"),
        finding(low > high, "error", "price_range", "minimum above maximum"),
        finding((get("currency") != "") & ~get("currency").isin(*KNOWN_CURRENCIES), "warning", "currency", "unusual"),
    ]


def count_rules(get: Callable[[str], Column]) -> list[Column]:
    sales, reviews, rating = get("sales_count").try_cast("long"), get("review_count").try_cast("long"), get("rating").try_cast("double")
    return [
        finding(get("sales_count").isNotNull() & sales.isNull(), "error", "sales_count", "not a number"),
        finding(sales < 0, "error", "sales_count", "negative"),
        finding(sales > HIGHEST_SALES, "warning", "sales_count", "unusually high"),
        finding(get("review_count").isNotNull() & reviews.isNull(), "error", "review_count", "not a number"),
        finding(reviews < 0, "error", "review_count", "negative"),
        finding(get("rating").isNotNull() & rating.isNull(), "error", "rating", "not a number"),
        finding((rating < 0) | (rating > 5), "error", "rating", "not from 0 to 5"),
    ]


def media_rules(get: Callable[[str], Column], images: Column | None) -> list[Column]:
    rules = [finding((get(f) != "") & ~is_url(get(f)), "warning", f, "not a URL") for f in ("main_image_url", "video_url")]
    if images is None:
        return rules
    bad = F.filter(F.transform(images, lambda u, i: F.when(~F.coalesce(is_url(u), F.lit(False)), i)), lambda i: i.isNotNull())
    said = F.concat(F.lit("not a URL at "), F.array_join(bad.cast("array<string>"), ", "))
    found = F.struct(F.lit("warning").alias("level"), F.lit("detail_images").alias("field"), said.alias("message"))
    return [*rules, F.when(F.size(bad) > 0, found).otherwise(F.lit(None).cast(FINDING))]


def valid_phone(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d+]", "").rlike(r"^(\+?86)?1[3-9]\d{9}$|^\+?\d{7,15}$")


def valid_email(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def valid_qq(c: Column) -> Column:
    return c.rlike(r"^[1-9]\d{4,11}$")


def supplier_rules(get: Callable[[str], Column]) -> list[Column]:
    bad = lambda f, valid: finding((get(f) != "") & ~valid(get(f)), "warning", f, "malformed")
    filled = lambda f: F.coalesce(get(f) != "", F.lit(False))
    capital = get("registered_capital").try_cast("long")
    return [
        bad("phone", valid_phone), bad("email", valid_email), bad("qq", valid_qq),
        finding(filled("province") & ~filled("city"), "info", "address", "province without city"),
        finding(filled("city") & ~filled("province"), "info", "address", "city without province"),
        bad("established_date", lambda c: F.try_to_timestamp(c, F.lit("yyyy-M-d")).isNotNull()),
        finding(filled("registered_capital") & capital.isNull(), "warning", "registered_capital", "not a number"),
        finding(capital <= 0, "warning", "registered_capital", "not above 0"),
    ]


def findings(rules: list[Column]) -> Column:
    """All findings, after an `overall` one where there are errors or warnings."""
    found = F.filter(F.array(*rules), lambda r: r.isNotNull())
    has = lambda level: F.exists(found, lambda r: r["level"] == level)
    overall = lambda level: F.array(F.struct(F.lit(level).alias("level"), F.lit("overall").alias("field"), F.lit("has findings").alias("message")))
    return F.when(has("error"), F.concat(overall("error"), found)).when(has("warning"), F.concat(overall("warning"), found)).otherwise(found)


def _getter(df: DataFrame) -> Callable[[str], Column]:
    return lambda name: F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def validate_products(df: DataFrame) -> DataFrame:
    """df with `validation`, an array of findings; columns that df lacks count as null."""
    get = _getter(df)
    kinds = dict(df.dtypes)
    rules = [*required(PRODUCT_REQUIRED, get), *lengths(PRODUCT_LENGTHS, get), *price_rules(get), *count_rules(get)]
    rules += media_rules(get, F.col("detail_images") if kinds.get("detail_images") == "array<string>" else None)
    rules.append(finding((get("category_id") != "") & (F.coalesce(get("category_name"), F.lit("")) == ""), "warning", "category_name", "missing"))
    if kinds.get("specifications", "").startswith("map"):
        rules.append(finding(F.size("specifications") > MOST_SPECIFICATIONS, "warning", "specifications", "too many"))
    return df.withColumn("validation", findings(rules))


def validate_suppliers(df: DataFrame) -> DataFrame:
    get = _getter(df)
    return df.withColumn("validation", findings([*required(SUPPLIER_REQUIRED, get), *lengths(SUPPLIER_LENGTHS, get), *supplier_rules(get)]))


def without_errors(df: DataFrame) -> DataFrame:
    return df.where(~F.exists("validation", lambda r: r["level"] == "error"))


def field_summary(df: DataFrame) -> DataFrame:
    """field, level, n of all findings."""
    return df.select(F.explode("validation").alias("v")).groupBy("v.field", "v.level").agg(F.count("*").alias("n"))
