"""Cleaning of raw catalogue fields (all text) as Column expressions.

Nulls count as empty texts throughout, as a missing key does in a raw record. Unicode white space and digits
are meant where a pattern says (?U); trim() alone would strip plain spaces only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units, currencies, capital multipliers, date formats and patterns of prices and order quantities.
UNITS = {
    "个": "piece", "件": "piece", "只": "piece", "支": "piece", "张": "piece", "片": "piece", "条": "piece", "根": "piece", "套": "set", "对": "pair", "双": "pair",
    "公斤": "kg", "千克": "kg", "斤": "jin", "克": "g", "米": "meter", "公尺": "meter", "厘米": "cm", "毫米": "mm", "升": "liter", "毫升": "ml", "吨": "ton",
}
CURRENCIES = {"RMB": "CNY", "YUAN": "CNY", "元": "CNY", "￥": "CNY", "USD": "USD", "$": "USD", "EUR": "EUR", "€": "EUR"}
CAPITAL_UNITS = {"万": 10_000, "千": 1_000, "亿": 100_000_000}
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy年M月d日", "yyyy.M.d")
PRICE_PATTERNS = (r"¥(\d+\.?\d*)", r"(\d+\.?\d*)元", r"RMB\s*(\d+\.?\d*)", r"(\d+\.?\d*)\s*元")
MOQ_PATTERNS = (r"(\d+)\s*起", r"最小起订量[:：]\s*(\d+)", r"MOQ[:：]\s*(\d+)", r"起订量[:：]\s*(\d+)")
NOT_KEPT = r"(?U)[^\x{4e00}-\x{9fa5}a-zA-Z0-9\s.,!?()（）。，！？：:]"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def shorten(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def lookup(c: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c)


def clean_text(c: Column) -> Column:
    """White space collapsed, characters other than CJK, ASCII letters, digits and common marks removed (not trimmed again), cut at 500."""
    return shorten(F.regexp_replace(collapse(text_or_empty(c)), NOT_KEPT, ""), 500)


def clean_html(c: Column) -> Column:
    """Tags removed (the text of scripts stays), white space collapsed, cut at 2000."""
    return shorten(collapse(F.regexp_replace(text_or_empty(c), "<[^>]+>", "")), 2000)


def extract_prices(c: Column) -> Column:
    """Numbers from 0 to a million (both excluded) that any pattern finds, pattern by pattern, repeats kept."""
    found = F.concat(*[F.regexp_extract_all(text_or_empty(c), F.lit(p), F.lit(1)) for p in PRICE_PATTERNS])
    return F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: (x > 0) & (x < 1_000_000))


def price_range(price_text: Column, range_text: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Smallest and largest price of the first text that isn't empty, else the raw fields if they are numbers."""
    joined = F.concat(text_or_empty(low), F.lit("-"), text_or_empty(high))
    prices = extract_prices(F.coalesce(F.nullif(price_text, F.lit("")), F.nullif(range_text, F.lit("")), joined))
    pick = lambda found, raw: F.coalesce(found.cast("decimal(18,6)"), F.nullif(raw, F.lit("")).try_cast("decimal(18,6)"))
    return pick(F.array_min(prices), low), pick(F.array_max(prices), high)


def standard_currency(c: Column) -> Column:
    return F.coalesce(lookup(strip(F.upper(text_or_empty(c))), CURRENCIES), F.lit("CNY"))


def extract_moq(c: Column) -> Column:
    """First pattern's first number that lies between 0 and a million (both excluded)."""
    numbers = [F.nullif(F.regexp_extract(text_or_empty(c), p, 1), F.lit("")).try_cast("long") for p in MOQ_PATTERNS]
    return F.coalesce(*[F.when((n > 0) & (n < 1_000_000), n) for n in numbers])


def standard_unit(c: Column) -> Column:
    unit = strip(F.lower(text_or_empty(c)))
    return F.coalesce(lookup(unit, UNITS), unit)


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def split_list(c: Column) -> Column:
    """Parts of a comma text, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text_or_empty(c), ","), strip), lambda x: x != "")


def clean_images(urls: Column, most: int = 10) -> Column:
    return F.slice(F.filter(urls, is_url), 1, most)


def specifications(c: Column) -> Column:
    """Map from JSON text: an object (keys and values cleaned), or a list of objects or `key:value` texts (trimmed only)."""
    json = text_or_empty(c)
    pairs = F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.struct(clean_text(e["key"]).alias("key"), clean_text(e["value"]).alias("value")))
    of_object = last_of_key(F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != "")))
    items = F.from_json(json, "array<string>")
    as_pair = lambda x: F.array(F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    entries = lambda x: F.when(x.startswith("{"), F.map_entries(F.from_json(x, "map<string,string>"))).when(x.contains(":"), as_pair(x))
    of_list = last_of_key(F.flatten(F.filter(F.transform(items, entries), lambda e: e.isNotNull())))
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(F.ltrim(json).startswith("["), of_list).when(F.ltrim(json).startswith("{"), of_object), empty)


def last_of_key(entries: Column) -> Column:
    """Map of (key, value) entries in which a later entry of a key replaces the earlier ones."""
    value_of = lambda e: F.element_at(F.filter(entries, lambda x: x["key"] == e), -1)["value"]
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, value_of))


def count_or_zero(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.coalesce(strip(c.cast("string")).try_cast("long"), F.lit(0).cast("long")))


def clean_rating(c: Column) -> Column:
    """Clamped to 0 to 5; a missing one is 0, one that isn't a number is null."""
    number = F.when(c.isNull(), F.lit(0.0)).otherwise(strip(c.cast("string")).try_cast("double"))
    return F.least(F.lit(5.0), F.greatest(F.lit(0.0), number)) + F.lit(0.0) * number


def clean_phone(c: Column) -> Column:
    phone = F.regexp_replace(text_or_empty(c), r"[^\d+]", "")
    return F.when(phone.rlike(r"^\+?\d{7,15}$"), phone).otherwise("")


def clean_email(c: Column) -> Column:
    email = strip(F.lower(text_or_empty(c)))
    return F.when(email.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), email).otherwise("")


def clean_qq(c: Column) -> Column:
    qq = F.regexp_replace(text_or_empty(c), r"[^\d]", "")
    return F.when(qq.rlike(r"^[1-9]\d{4,11}$"), qq).otherwise("")


def clean_date(c: Column) -> Column:
    """ISO date of the first format that fits, else null."""
    return F.date_format(F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]), "yyyy-MM-dd")


def clean_capital(c: Column) -> Column:
    """Whole amount as text: a number, a unit of ten thousand, thousand or hundred million, and the currency sign."""
    pattern = r"([\d.]+)\s*([万千亿]?)元"
    number = F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("double")
    times = F.coalesce(lookup(F.regexp_extract(c, pattern, 2), {k: str(v) for k, v in CAPITAL_UNITS.items()}).cast("double"), F.lit(1.0))
    return (number * times).cast("long").cast("string")


def clean_certifications(c: Column) -> Column:
    return F.filter(F.transform(split_list(c), clean_text), lambda x: x != "")


def present(df: DataFrame, name: str) -> Column:
    """The column if df has it, else null: a raw record's missing key."""
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def clean_products(raw: DataFrame) -> DataFrame:
    """Raw product rows (text columns, any of them missing) as clean products."""
    get = lambda name: present(raw, name)
    low, high = price_range(get("price_text"), get("price_range"), get("price_min"), get("price_max"))
    order = F.coalesce(F.nullif(get("moq_text"), F.lit("")), F.nullif(get("order_info"), F.lit("")), get("moq"))
    filled = lambda name, c: F.when(text_or_empty(get(name)) != "", c)
    return raw.select(
        text_or_empty(get("source_id")).alias("source_id"), clean_text(get("title")).alias("title"), clean_text(get("subtitle")).alias("subtitle"), clean_html(get("description")).alias("description"),
        low.alias("price_min"), high.alias("price_max"), standard_currency(get("currency")).alias("currency"), extract_moq(order).alias("moq"),
        filled("price_unit", standard_unit(get("price_unit"))).alias("price_unit"), F.when(is_url(get("main_image_url")), get("main_image_url")).alias("main_image_url"),
        clean_images(split_list(get("detail_images"))).alias("detail_images"), F.when(is_url(get("video_url")), get("video_url")).alias("video_url"),
        specifications(get("specifications")).alias("specifications"), specifications(get("attributes")).alias("attributes"),
        filled("category_id", strip(get("category_id"))).alias("category_id"), filled("category_name", clean_text(get("category_name"))).alias("category_name"),
        count_or_zero(get("sales_count")).alias("sales_count"), count_or_zero(get("review_count")).alias("review_count"), clean_rating(get("rating")).alias("rating"),
    )


def clean_suppliers(raw: DataFrame) -> DataFrame:
    """Raw supplier rows (text columns, any of them missing) as clean suppliers."""
    get = lambda name: present(raw, name)
    return raw.select(
        text_or_empty(get("source_id")).alias("source_id"), clean_text(get("name")).alias("name"), clean_html(get("description")).alias("description"),
        clean_phone(get("phone")).alias("phone"), clean_email(get("email")).alias("email"), clean_qq(get("qq")).alias("qq"), clean_text(get("wechat")).alias("wechat"),
        *[clean_text(get(name)).alias(name) for name in ("province", "city", "address", "company_name")],
        clean_date(get("established_date")).alias("established_date"), clean_capital(get("registered_capital")).alias("registered_capital"), clean_certifications(get("certifications")).alias("certifications"),
    )


def put(c: Column, key: str, value: Column) -> Column:
    """A map with one entry set: the old one of that key goes; a null map counts as empty."""
    held = F.coalesce(c, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(held, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string")))


def supplier_blocks(clean: DataFrame) -> DataFrame:
    """Clean suppliers with contact_info, address_info and business_info: maps of what is given."""
    block = lambda names: F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda _, v: F.coalesce(v != "", F.lit(False)))
    parts = {"contact_info": ("phone", "email", "qq", "wechat"), "address_info": ("province", "city", "address"), "business_info": ("company_name", "established_date", "registered_capital")}
    return clean.withColumns({name: block(fields) for name, fields in parts.items()})
