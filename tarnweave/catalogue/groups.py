"""Similar titles, groups of linked suppliers, prefix scans, imports and locale order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, imports, predicates, scans, tables, text_join
from .registry import registry

QUERIES, ORACLE_SQL, register = registry()

titled = lambda t: t.view("products").select("id", F.concat_ws(" ", "title", "brand", "category_name").alias("title"))
register("similar_title_pairs", lambda t: text_join.similar_texts(titled(t), "id", "title"))
register("similar_title_members", lambda t: text_join.members(titled(t), "id", "title"), "SELECT id, MIN(id) OVER (PARTITION BY lower(title || ' ' || brand || ' ' || category_name)) AS class_id FROM products")
LINKED = """v AS (SELECT id, 'name' AS field, name AS value FROM s UNION ALL SELECT id, 'phone', phone FROM s), l AS (SELECT id AS a, MIN(id) OVER (PARTITION BY field, value) AS b FROM v WHERE value <> ''),
r AS (SELECT DISTINCT a AS node, a AS goal FROM l UNION SELECT r.node, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON e.a = r.goal)"""
suppliers = lambda t: t.view("suppliers").select("id", F.when(F.col("id") % 9 == 0, "Shared Trade").otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 4 == 1, F.col("phone").substr(1, 10)).when(F.col("id") % 3 == 0, "").otherwise(F.col("phone")).alias("phone"))
register(
    "supplier_value_groups",
    lambda t: dedup.equal_value_groups(suppliers(t), ("name", "phone")),
    f"""WITH RECURSIVE s AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'Shared Trade' ELSE name END AS name, CASE WHEN id % 4 = 1 THEN substr(phone, 1, 10) WHEN id % 3 = 0 THEN '' ELSE phone END AS phone FROM suppliers), {LINKED}
SELECT node AS id, component_id, COUNT(*) OVER (PARTITION BY component_id) AS size FROM (SELECT node, MIN(goal) AS component_id FROM r GROUP BY node) QUALIFY size > 1""",
)
register("task_batches", lambda t: tables.batch_tasks(t.view("products").select(F.concat(F.lit("p"), F.col("id") * 7 % 1000, F.lit("-"), F.col("id")).alias("name")), "name", 64), """
WITH n AS (SELECT 'p' || (id * 7 % 1000) || '-' || id AS name FROM products), r AS (SELECT name, CAST(floor((row_number() OVER (ORDER BY name) - 1) / 64) AS BIGINT) AS batch, COUNT(*) OVER () AS total FROM n)
SELECT batch, COUNT(*) AS items, MIN(name) AS first_key, MAX(name) AS last_key, CAST(ceil(MAX(total) / CAST(64 AS DOUBLE)) AS BIGINT) AS total_batches FROM r GROUP BY batch""")
register("running_figures", lambda t: scans.running(t.view("logs").select("id", "event_type", "timestamp", "value"), "event_type", ["timestamp", "id"], events=("sum", F.lit(1)), highest=("max", F.col("value")), lowest=("min", F.col("value"))).select("id", "events", "highest", "lowest"),
    "SELECT id, COUNT(*) OVER w AS events, MAX(value) OVER w AS highest, MIN(value) OVER w AS lowest FROM logs WINDOW w AS (PARTITION BY event_type ORDER BY timestamp, id)")


def imported(t) -> imports.Imported:
    """Half of the products and some broken, repeated and new rows, into the first two thirds of them."""
    p = t.view("products").select("id", "source_id", "title", "price_min", "price_max", "sales_count")
    known = p.where("id % 3 <> 0")
    fresh = p.where("id % 2 = 0").withColumn("price_min", F.when(F.col("id") % 10 == 0, -1.0).otherwise(F.col("price_min")))
    again = p.where("id % 6 = 0").withColumn("sales_count", F.col("sales_count") + 1)
    return imports.import_rows(known, fresh.unionByName(again), "source_id", "sales_count", update_existing=True)


IMPORT = """p AS (SELECT id, source_id, title, price_min, price_max, sales_count FROM products),
f AS (SELECT id, source_id, CASE WHEN id % 10 = 0 THEN CAST(-1 AS DOUBLE) ELSE price_min END AS price_min, price_max, sales_count FROM p WHERE id % 2 = 0 UNION ALL SELECT id, source_id, price_min, price_max, sales_count + 1 FROM p WHERE id % 6 = 0),
m AS (SELECT *, price_min <= 0 OR price_max <= 0 OR price_min > price_max AS bad, id % 3 <> 0 AS known FROM f),
o AS (SELECT *, CASE WHEN bad THEN 'rejected' WHEN row_number() OVER (PARTITION BY source_id, bad ORDER BY sales_count DESC) > 1 THEN 'repeated' WHEN known THEN 'updated' ELSE 'inserted' END AS outcome FROM m)"""
register("import_counts", lambda t: imported(t).counts.withColumn("success_rate", F.round("success_rate", 9)), f"""
WITH {IMPORT} SELECT COUNT(*) AS total, {', '.join(f"COUNT(*) FILTER (outcome = '{o}') AS {o}" for o in imports.OUTCOMES)}, round(COUNT(*) FILTER (outcome IN ('inserted', 'updated')) / CAST(COUNT(*) AS DOUBLE), 9) AS success_rate FROM o""")
register("import_table", lambda t: imported(t).table.select("source_id", "price_min", "sales_count"), f"""
WITH {IMPORT} SELECT source_id, price_min, sales_count FROM o WHERE outcome IN ('inserted', 'updated') UNION ALL SELECT source_id, price_min, sales_count FROM p WHERE id % 3 <> 0 AND source_id NOT IN (SELECT source_id FROM o WHERE outcome = 'updated')""")
register("locale_sorted", lambda t: (lambda p: scans.numbered(p, *predicates.locale_order(p, "title", tie="id")))(t.view("products").select("id", "title")), "SELECT id, title, row_number() OVER (ORDER BY title NULLS LAST, id) - 1 AS position FROM products")
