"""The catalogue pipeline: clean, validate, find duplicates, version, assess; one lazy plan, each stage optional."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_products, clean_suppliers
from ..functions.validate import field_summary, validate_products, validate_suppliers, without_errors
from ..operators import dedup, quality, versions


@dataclass
class Outcome:
    """rows: valid rows; rejected: rows with an error; the reports are DataFrames too, evaluated when read."""

    rows: DataFrame
    rejected: DataFrame | None = None
    reports: dict[str, DataFrame] = field(default_factory=dict)

    def status(self) -> str:
        return "completed" if self.rejected is None or self.rejected.isEmpty() else "partial"


def process(raw: DataFrame, kind: str = "product", previous: DataFrame | None = None, as_of: str | None = None, skip: tuple[str, ...] = (), drop_duplicates: bool = False, block: Column | None = None) -> Outcome:
    """Run the stages that aren't in skip: cleaning, validation, deduplication, versioning, quality.

    Duplicates are reported and stay unless drop_duplicates. previous: known versions. block: what similar rows
    must share to be compared; by default the source id.
    """
    product = kind == "product"
    rows = raw if "cleaning" in skip else (clean_products if product else clean_suppliers)(raw)
    out = Outcome(rows)
    if "validation" not in skip:
        checked = (validate_products if product else validate_suppliers)(rows)
        out.reports["findings"] = field_summary(checked)
        out.rejected = checked.where(F.exists("validation", lambda r: r["level"] == "error"))
        out.rows = without_errors(checked).drop("validation")
    if "deduplication" not in skip and "id" in out.rows.columns:
        weights, threshold = (dedup.PRODUCT_WEIGHTS, dedup.PRODUCT_THRESHOLD) if product else (dedup.SUPPLIER_WEIGHTS, dedup.SUPPLIER_THRESHOLD)
        key = block if block is not None else dedup.block_key("source_id")
        groups = dedup.greedy_groups(out.rows, key, weights, threshold)
        out.reports["duplicates"] = dedup.describe_groups(groups)
        if drop_duplicates:
            points = dedup.PRODUCT_POINTS if product else dedup.SUPPLIER_POINTS
            members = out.rows.join(groups.select("seed_id", "id"), "id")
            best = dedup.masters(members, ["seed_id"], score=dedup.completeness_score(out.rows, points)).select("id")
            surplus = groups.select("id").join(best, "id", "left_anti")
            out.rows = out.rows.join(surplus, "id", "left_anti")
    if "versioning" not in skip and previous is not None:
        fields = [c for c, t in out.rows.dtypes if c not in ("id", "source_id") and not t.startswith(("array", "map"))]
        data = F.map_filter(F.create_map(*[x for c in fields for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
        snapshot = out.rows.select(F.lit(kind).alias("entity_type"), F.col("source_id").alias("entity_id"), data.alias("data"), F.lit(as_of).cast("timestamp").alias("created_at"))
        out.reports["versions"] = versions.append_changed(previous, snapshot)
    if "quality" not in skip:
        fields = quality.PRODUCT_FIELDS if product else quality.SUPPLIER_FIELDS
        name = "title" if product else "name"
        metrics = {"completeness": quality.completeness(out.rows, fields), "uniqueness": quality.uniqueness(out.rows, ("source_id", name)), "consistency": quality.consistency(out.rows, (name, "description"), "currency" if product else None, quality.equal_text_pairs(out.rows, name))}
        metrics |= {"accuracy": quality.accuracy(out.rows), "validity": quality.validity(out.rows, urls=("main_image_url", "video_url"))} if product else {"validity": quality.validity(out.rows, emails=("email",), phones=("phone",))}
        out.reports["quality"] = quality.quality_report(metrics)
    return out
