"""Cleaning, validation and text functions on hand-made rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnweave.functions import clean, model, text, validate


def values(spark, expression, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, c string")
    return [r["v"] for r in df.select("i", expression(F.col("c")).alias("v")).orderBy("i").collect()]


def test_clean_text(spark):
    assert values(spark, clean.clean_text, None, "", "  a　 b\n", "测试★商品!", "x" * 501) == ["", "", "a b", "测试商品!", "x" * 500 + "..."]


def test_clean_html(spark):
    assert values(spark, clean.clean_html, "<p>a</p><script>alert(1)</script>", "y" * 2001) == ["aalert(1)", "y" * 2000 + "..."]


def test_prices(spark):
    assert values(spark, clean.extract_prices, "¥100.5", "100元", "RMB 200.8", "50元 - 100元", "无效价格", None, "¥0", "¥1000000") == [[100.5], [100.0, 100.0], [200.8], [50.0, 100.0, 50.0, 100.0], [], [], [], []]


def test_quantities_units_and_money(spark):
    assert values(spark, clean.extract_moq, "10起", "MOQ: 5", "最小起订量：7", "0起", "none", None) == [10, 5, 7, None, None, None]
    assert values(spark, clean.standard_unit, "个", "公斤", "米", "unknown", " BOX ") == ["piece", "kg", "meter", "unknown", "box"]
    assert values(spark, clean.standard_currency, "rmb", "$", "GBP", None) == ["CNY", "USD", "CNY", "CNY"]
    assert values(spark, clean.clean_capital, "100万元", "100万 元", "1.5亿元", "5元") == ["1000000", None, "150000000", "5"]
    assert values(spark, clean.clean_date, "2020-1-1", "2020/02/03", "2020年3月4日", "2020.4.5", "2020-13-01", None) == ["2020-01-01", "2020-02-03", "2020-03-04", "2020-04-05", None, None]


def test_contacts(spark):
    assert values(spark, clean.clean_phone, "+86 138-0013-8000", "123", None) == ["+8613800138000", "", ""]
    assert values(spark, clean.clean_email, " Test@Example.COM ", "bad") == ["test@example.com", ""]
    assert values(spark, clean.clean_qq, "12 345", "0123456") == ["12345", ""]
    assert values(spark, clean.clean_rating, "6", "-1", "4.5", "x", None) == [5.0, 0.0, 4.5, None, 0.0]
    assert values(spark, clean.count_or_zero, "5", "-3", "1.5", None) == [5, 0, 0, 0]


def test_specifications(spark):
    found = values(spark, clean.specifications, '{"a ":"1","b":""}', '["k:v:w",{"x":"y"},{"x":"z"}]', "nonsense", None)
    assert found == [{"a": "1"}, {"k": "v:w", "x": "z"}, {}, {}]


def test_urls(spark):
    assert values(spark, clean.is_url, "http://a b/c", "ftp://x", "nowhere", None, "http://") == [True, True, False, False, False]
    assert values(spark, text.product_id_of_url, "http://x/12.html?id=3", "http://x/?id=34", "http://x") == ["12", "34", None]
    assert values(spark, text.is_image_url, "https://x/a.JPG", "https://x/photo/1", "x.jpg", None) == [True, True, False, False]


def test_patterns(spark):
    assert values(spark, text.log_pattern, "User 12  at 1.2.3.4", "id deadbeefcafe") == ["user {n} at {n}.{n}.{n}.{n}", "id {id}"]
    assert values(spark, text.crawl_text, "a\tb  c\n", None) == ["ab c", ""]


def test_clean_products_end_to_end(spark):
    raw = spark.createDataFrame([(" 12345 ", "测试商品", "¥100.5 - ¥200.8", "RMB", "100起", "个", "http://x/a.jpg,http://x/b.jpg,bad", "150", "4.5")], "source_id string, title string, price_text string, currency string, moq_text string, price_unit string, detail_images string, sales_count string, rating string")
    r = clean.clean_products(raw).first()
    assert (r.source_id, r.title, r.price_min, r.price_max, r.currency, r.moq, r.price_unit) == (" 12345 ", "测试商品", Decimal("100.5"), Decimal("200.8"), "CNY", 100, "piece")
    assert (r.detail_images, r.sales_count, r.rating, r.main_image_url) == (["http://x/a.jpg", "http://x/b.jpg"], 150, 4.5, None)


def test_validation(spark):
    rows = spark.createDataFrame([("s", "t", "10", "20", "CNY", "5", "4.0", "http://x"), ("", None, "-10", "5", "XXX", "-1", "6.0", "bad")], "source_id string, title string, price_min string, price_max string, currency string, sales_count string, rating string, main_image_url string")
    good, bad = validate.validate_products(rows).collect()
    assert good.validation == []
    assert [(f.level, f.field) for f in bad.validation] == [("error", "overall"), ("error", "source_id"), ("error", "title"), ("error", "price_min"), ("warning", "currency"), ("error", "sales_count"), ("error", "rating"), ("warning", "main_image_url")]
    assert validate.without_errors(validate.validate_products(rows)).count() == 1


def test_levels(spark):
    assert [r[0] for r in spark.createDataFrame([(0.95,), (0.85,), (0.75,), (0.65,), (0.1,)], "v double").select(model.level_of(F.col("v"), F.lit(0.8))).collect()] == ["excellent", "good", "fair", "poor", "critical"]


@pytest.mark.parametrize("tags, key", [({"b": "2", "a": "1"}, "m{a=1,b=2}"), ({}, "m"), (None, "m")])
def test_metric_key(spark, tags, key):
    assert spark.createDataFrame([("m", tags)], "n string, t map<string,string>").select(text.metric_key(F.col("n"), F.col("t"))).first()[0] == key
