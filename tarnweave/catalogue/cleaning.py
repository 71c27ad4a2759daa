"""Cleaning, validation and crawl extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, text, validate
from ..plans.products import process
from ..sources import pages
from .registry import registry

QUERIES, ORACLE_SQL, register = registry()

# Unicode's white space
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
register("clean_text", lambda t: t.documents.select("doc_id", clean.clean_text(F.col("text")).alias("cleaned")), rf"""
SELECT doc_id, CASE WHEN length(c) > 500 THEN c[:500] || '...' ELSE c END AS cleaned FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
  '^{WHITE}+|{WHITE}+$', '', 'g'), '{WHITE}+', ' ', 'g'), '[^\x{{4e00}}-\x{{9fff}}a-zA-Z0-9 .,!?():]', '', 'g') AS c FROM documents)""")
register("clean_html", lambda t: t.pages.select("page_id", clean.clean_html(F.col("html")).alias("cleaned")), rf"""
SELECT page_id, CASE WHEN length(c) > 2000 THEN c[:2000] || '...' ELSE c END AS cleaned FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'),
  '^{WHITE}+|{WHITE}+$', '', 'g'), '{WHITE}+', ' ', 'g') AS c FROM pages)""")
PRICE_TEXT = "CASE p_size % 4 WHEN 0 THEN '¥' || CAST(p_size AS STRING) || '.5 起' WHEN 1 THEN CAST(p_size AS STRING) || '元 - ' || CAST(p_size + 9 AS STRING) || '元' WHEN 2 THEN 'RMB ' || CAST(p_size AS STRING) ELSE 'none' END"
register("extract_prices", lambda t: t.part.select("p_partkey", clean.extract_prices(F.expr(PRICE_TEXT)).alias("p")).select("p_partkey", F.size("p").alias("n"), F.array_min("p").alias("low"), F.array_max("p").alias("high")), """
SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 0 END AS INT) AS n, CASE p_size % 4 WHEN 0 THEN p_size + CAST(0.5 AS DOUBLE) WHEN 3 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS low,
  CASE p_size % 4 WHEN 0 THEN p_size + CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(p_size + 9 AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) END AS high FROM part""")
register("extract_moq", lambda t: t.part.select("p_partkey", clean.extract_moq(F.expr("CASE p_size % 3 WHEN 0 THEN CAST(p_size AS STRING) || ' 起' WHEN 1 THEN 'MOQ: ' || CAST(p_size * 20000 AS STRING) ELSE 'any' END")).alias("moq")), """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size > 0 THEN CAST(p_size AS BIGINT) WHEN p_size % 3 = 1 AND p_size * 20000 < 1000000 THEN CAST(p_size * 20000 AS BIGINT) END AS moq FROM part""")
register("standard_units", lambda t: t.part.select("p_partkey", clean.standard_unit(F.expr("CASE p_size % 4 WHEN 0 THEN ' 件' WHEN 1 THEN '公斤' WHEN 2 THEN '吨 ' ELSE 'Box' END")).alias("unit"), clean.standard_currency(F.expr("CASE p_size % 3 WHEN 0 THEN 'rmb' WHEN 1 THEN ' usd ' ELSE 'GBP' END")).alias("currency")), """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'piece' WHEN 1 THEN 'kg' WHEN 2 THEN 'ton' ELSE 'box' END AS unit, CASE p_size % 3 WHEN 1 THEN 'USD' ELSE 'CNY' END AS currency FROM part""")
register("clean_contacts", lambda t: t.view("suppliers").select("id", clean.clean_phone(F.concat(F.lit("+86 "), "phone")).alias("phone"), clean.clean_email(F.upper("email")).alias("email"), clean.clean_date(F.concat(F.lit("2020/1/"), (F.col("id") % 40).cast("string"))).alias("founded"), clean.clean_capital(F.concat((F.col("id") % 9 + 1).cast("string"), F.lit("万元"))).alias("capital")), """
SELECT id, '+86' || phone AS phone, CASE WHEN email LIKE '%@%' THEN email ELSE '' END AS email, CASE WHEN id % 40 BETWEEN 1 AND 31 THEN '2020-01-' || lpad(CAST(id % 40 AS VARCHAR), 2, '0') END AS founded, CAST((id % 9 + 1) * 10000 AS VARCHAR) AS capital FROM suppliers""")
register("comparable_text", lambda t: t.view("products").select("id", text.comparable(F.concat(F.lit(" "), "title", F.lit("--"), "brand")).alias("c")), "SELECT id, lower(title || replace(brand, '#', '')) AS c FROM products")
register("url_product_id", lambda t: t.pages.select("page_id", text.product_id_of_url(F.concat("url", F.lit("&id=7"))).alias("product_id")), r"SELECT page_id, coalesce(nullif(regexp_extract(url || '&id=7', '/(\d+)\.html', 1), ''), nullif(regexp_extract(url || '&id=7', 'id=(\d+)', 1), '')) AS product_id FROM pages")
register("image_paths", lambda t: t.view("products").where("main_image_url <> ''").select("id", text.image_path(F.lit("main"), F.col("id"), F.col("main_image_url")).alias("path"), text.is_image_url(F.col("main_image_url")).alias("ok")), "SELECT id, 'main/' || id || '/' || md5(main_image_url) || '.jpg' AS path, true AS ok FROM products WHERE main_image_url <> ''")


def odd_products(t):
    p = t.view("products")
    return p.withColumn("price_min", F.when(F.col("id") % 11 == 0, -1.0).otherwise(F.col("price_min"))).withColumn("rating", F.col("rating") * 1.5).withColumn("currency", F.when(F.col("id") % 13 == 0, "GBP").otherwise(F.col("currency"))).withColumn("main_image_url", F.when(F.col("id") % 17 == 0, "nowhere").otherwise(F.col("main_image_url")))


ODD = "(SELECT id, CASE WHEN id % 11 = 0 THEN -1 ELSE price_min END AS price_min, rating * 1.5 AS rating, CASE WHEN id % 13 = 0 THEN 'GBP' ELSE currency END AS currency, CASE WHEN id % 17 = 0 THEN 'nowhere' ELSE main_image_url END AS url FROM products)"
FOUND = f"""SELECT id, 'price_min' AS field, 'error' AS level FROM {ODD} WHERE price_min <= 0 UNION ALL SELECT id, 'rating', 'error' FROM {ODD} WHERE rating > 5 UNION ALL SELECT id, 'currency', 'warning' FROM {ODD} WHERE currency = 'GBP'
UNION ALL SELECT id, 'main_image_url', 'warning' FROM {ODD} WHERE url = 'nowhere'"""
register("validation_field_summary", lambda t: validate.field_summary(validate.validate_products(odd_products(t))), f"""
SELECT field, level, COUNT(*) AS n FROM (SELECT * FROM ({FOUND}) UNION ALL SELECT id, 'overall', MIN(level) FROM ({FOUND}) GROUP BY id) GROUP BY 1, 2""")
register("validate_products", lambda t: validate.without_errors(validate.validate_products(odd_products(t))).select("id", F.size("validation").alias("findings")), f"""
SELECT p.id, CAST(COUNT(f.id) + CASE WHEN COUNT(f.id) > 0 THEN 1 ELSE 0 END AS INT) AS findings FROM {ODD} p LEFT JOIN ({FOUND}) f ON p.id = f.id GROUP BY 1 HAVING COUNT(*) FILTER (level = 'error') = 0""")
register("validate_suppliers", lambda t: validate.field_summary(validate.validate_suppliers(t.view("suppliers"))), "SELECT f AS field, l AS level, COUNT(*) AS n FROM (SELECT id, unnest(['overall', 'email', 'address']) AS f, unnest(['warning', 'warning', 'info']) AS l FROM suppliers WHERE email = 'no mail' UNION ALL SELECT id, 'address', 'info' FROM suppliers WHERE email <> 'no mail') GROUP BY 1, 2")

register("html_extract", lambda t: pages.extract_items(t.pages).select("page_id", "title", F.size("links").alias("n_links"), F.size("image_urls").alias("n_images"), "product_id"))
register(
    "page_links",
    lambda t: pages.page_links(pages.extract_items(t.pages)),
    r"""WITH found AS (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a\s[^>]*?href="([^"]+)"', 1) AS l FROM pages)),
absolute AS (SELECT page_id, i, CASE WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://www.example.com' || href WHEN starts_with(href, 'http') THEN href END AS link FROM found)
SELECT * FROM (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY MIN(i)) - 1 AS INT) AS place, link FROM absolute WHERE link IS NOT NULL GROUP BY page_id, link) WHERE place < 40""",
)
register("page_requests", lambda t: pages.requests_of(pages.extract_items(t.pages)))
register("crawl_counters", lambda t: pages.crawl_counters(pages.extract_items(t.pages)))
register("crawl_items", lambda t: pages.distinct_items(pages.checked_items(pages.clean_items(pages.extract_items(t.pages).withColumn("price", F.when(F.col("page_id") % 2 == 0, F.col("page_id") + 1.0)))), ["page_id"]).select("page_id", "title", "rejected"))
raw = lambda t: t.view("products").select("id", "source_id", "title", "description", F.concat(F.lit("¥"), F.col("price_min").cast("string")).alias("price_text"), "currency", "main_image_url", "category_name", F.col("sales_count").cast("string").alias("sales_count"), F.when(F.col("id") % 10 != 0, F.col("rating").cast("string")).otherwise("n/a").alias("rating"))
register("clean_products", lambda t: clean.clean_products(raw(t)).groupBy("currency", F.col("rating").isNull().alias("unrated")).agg(F.count("*").alias("n"), F.sum("sales_count").alias("sales")), "SELECT currency, id % 10 = 0 AS unrated, COUNT(*) AS n, CAST(SUM(sales_count) AS BIGINT) AS sales FROM products GROUP BY 1, 2")
register("process_products", lambda t: process(raw(t)).reports["quality"])
