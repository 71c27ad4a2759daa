"""Crawl sources: links and product fields out of HTML pages, and the crawl's item filters."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import percent
from ..functions.text import crawl_text, is_image_url, product_id_of_url, truncate_right
from ..operators.dedup import first_seen

# Selectors of each field, in the order in which they are tried; steps stand inside one another, the last holds the text.
TITLE = (".d-title h1", ".d-title .title-text", ".offer-title h1", ".offer-title .title", ".title-main h1", ".product-title h1", ".detail-title h1", "h1")
PRICE = (
    ".d-price .price", ".d-price .value", ".offer-price .price", ".offer-price .value", ".price-current .price", ".price-current .value",
    ".price-display .price", ".price-display .value", ".price", ".value",
)
ORIGINAL_PRICE = (".d-price .price-del", ".offer-price .price-del", ".price-original .price", ".price-del")
TEXTS = {
    "description": (".d-detail .description", ".offer-description", ".desc-content"),
    "brand": (".d-brand .brand-name", ".offer-brand", ".brand"),
    "seller": (".d-seller .seller-name", ".offer-seller", ".seller"),
    "location": (".d-seller .location", ".offer-location", ".location"),
}
SELLER_ID = ((".d-seller .seller-name", "data-id"), (".offer-seller", "data-seller-id"), (".seller-info", "data-id"), (".company-info", "data-id"))
SELLER_LINK, MEMBER = ".seller-name a", re.compile(r"member/(\d+)")
SHOWS_PRODUCT = (".d-title", ".d-price", ".offer-title", ".offer-price", ".title-main", "h1")
LISTED = (
    ".sm-widget-offer .sm-offer-content .sm-offer-title a", ".sm-offer .sm-offer-title a", ".offer-item .offer-title a", ".product-item .product-title a",
    ".grid-item .item-title a", ".list-item .title a",
)
CATEGORIES = ((".sm-widget-market .sm-offer-title a", ""), (".category-list a", "chanpin"), (".nav-category a", "chanpin"), (".s-market-card a", "chanpin"))
NEXT_PAGE, NEXT_OF_SEARCH, NEXT_OF_CATEGORY = (".ui-page-next a", ".next-page a"), "beginPage={}", ".pagination .next a"
# Classes around specifications and tags; sizes of small pictures and what names them; most of each.
SPEC_CLASSES = ("d-attributes", "offer-attributes", "product-attributes", "specifications", "detail-attributes", "attribute-list")
TAG_CLASSES = ("d-tags", "offer-tags", "tags")
SMALL_NAMES, SMALL_SIZES = ("icon", "logo", "avatar", "small", "thumb"), ("50x50", "60x60", "80x80")
MOST_IMAGES, MOST_LINKS, MOST_CATEGORIES = 20, 40, 10
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ITEM = {
    "title": "string", "price": "double", "original_price": "double", "description": "string", "brand": "string", "seller": "string", "location": "string", "seller_id": "string",
    "shows_product": "boolean", "image_urls": "array<string>", "links": "array<string>", "specifications": "map<string,string>", "tags": "array<string>",
    "product_links": "array<string>", "category_links": "array<struct<name:string,url:string>>", "next_of_search": "string", "next_of_category": "string",
}


class Watched:
    """Selectors by their steps. Which of them an element fits is told from its parent alone: a path carries how many leading steps of each it has met."""

    def __init__(self, selectors: set[str]):
        self.last: dict[str, list[tuple[str, int]]] = {}
        self.leading: dict[str, list[tuple[str, int]]] = {}
        for selector in sorted(selectors):
            *before, last = selector.split()
            self.last.setdefault(last, []).append((selector, len(before)))
            for place, step in enumerate(before):
                self.leading.setdefault(step, []).append((selector, place))

    def enter(self, met: dict[str, int], tag: str, classes: set[str]) -> tuple[list[str], dict[str, int]]:
        """Selectors that an element fits, and what the path with it has met; met: of the path above it, which isn't changed."""
        own = [tag, *(f".{c}" for c in classes)]
        fits = [selector for step in own for selector, before in self.last.get(step, ()) if met.get(selector, 0) >= before]
        new = {selector: place + 1 for step in own for selector, place in self.leading.get(step, ()) if met.get(selector, 0) == place}
        return fits, met | new if new else met


WATCHED = Watched(
    {*TITLE, *PRICE, *ORIGINAL_PRICE, *(s for group in TEXTS.values() for s in group), *(s for s, _ in SELLER_ID), SELLER_LINK, *SHOWS_PRODUCT, *LISTED, *(s for s, _ in CATEGORIES), *NEXT_PAGE, NEXT_OF_CATEGORY}
)


class Open(NamedTuple):
    """An open element: its attributes, the selectors it fits, what its path has met, and what it lies in."""

    tag: str
    is_tag: bool
    own: dict
    fits: list[str]
    met: dict[str, int]
    in_specs: bool
    in_tags: bool


class ItemParser(HTMLParser):
    """Collects a page's texts, links and attributes by the selectors that their elements fit."""

    def __init__(self, base_url: str, page_url: str = ""):
        super().__init__(convert_charrefs=True)
        self.base, self.page_url, self.links, self.images = base_url, page_url, [], []
        self.open: list[Open] = []
        self.n_open: Counter[str] = Counter()
        self.texts: dict[str, list[str]] = {}
        self.elements: dict[str, list[dict]] = {}
        self.cells, self.tags, self.rows = [], [], []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "a" and own.get("href"):
            self.links.append(own["href"])
        if tag == "img":
            self.images += [own[k] for k in ("src", "data-src") if own.get(k)]
        classes = set((own.get("class") or "").split())
        own["__text"] = ""
        above = self.open[-1] if self.open else None
        fits, met = WATCHED.enter(above.met if above else {}, tag, classes)
        for selector in fits:
            self.elements.setdefault(selector, []).append(own)
        if tag not in VOID:
            in_specs, in_tags = (bool(classes & set(names)) for names in (SPEC_CLASSES, TAG_CLASSES))
            self.open.append(Open(tag, "tag" in classes, own, fits, met, in_specs or bool(above and above.in_specs), in_tags or bool(above and above.in_tags)))
            self.n_open[tag] += 1
        if tag == "tr":
            self.rows.append([])
        if tag == "td" and self.rows:
            self.rows[-1].append("")

    def handle_endtag(self, tag):
        while self.n_open[tag]:
            closed = self.open.pop().tag
            self.n_open[closed] -= 1
            if closed == tag:
                break

    def handle_data(self, data):
        if self.n_open["script"] or self.n_open["style"] or not self.open:
            return
        here = self.open[-1]
        for selector in here.fits:
            self.texts.setdefault(selector, []).append(data)
        here.own["__text"] = here.own["__text"] or data
        if here.tag == "td" and self.rows and self.rows[-1] and here.in_specs:
            self.rows[-1][-1] = self.rows[-1][-1] or data
        if here.is_tag and here.in_tags and data.strip():
            self.tags.append(data.strip())

    def first(self, selectors: tuple[str, ...]) -> str:
        return next((self.texts[s][0].strip() for s in selectors if self.texts.get(s)), "")

    def title(self) -> str:
        found = [self.texts[s] for s in TITLE if self.texts.get(s)]
        short = (texts[0].strip() for texts in found)
        plain = next((t for t in short if len(t) > 5 and not t.startswith("1")), "")
        return plain or next((t for t in (" ".join(texts).strip() for texts in found) if len(t) > 5), "")

    def seller_id(self) -> str | None:
        for selector, attribute in SELLER_ID:
            own = self.elements.get(selector)
            if own and own[0].get(attribute):
                return own[0][attribute].strip()
        found = (MEMBER.search(own.get("href") or "") for own in self.elements.get(SELLER_LINK, ()))
        return next((m.group(1) for m in found if m), None)

    def categories(self) -> list[tuple[str, str]]:
        groups = ([own for own in self.elements.get(s, ()) if part in (own.get("href") or "")] for s, part in CATEGORIES)
        links = next((g for g in groups if g), [])
        return [(own["__text"].strip(), self.joined(own["href"])) for own in links[:MOST_CATEGORIES] if own.get("href") and own["__text"]]

    def next_page(self, selectors: tuple[str, ...]) -> str | None:
        hrefs = (own[0].get("href") for s in selectors if (own := self.elements.get(s)))
        return next((self.joined(h) for h in hrefs if h), None)

    def next_of_search(self) -> str | None:
        at = re.search(r"beginPage=(\d+)", self.page_url)
        number = NEXT_OF_SEARCH.format(int(at.group(1)) + 1 if at else 2)
        return self.next_page(NEXT_PAGE) or next((self.joined(h) for h in self.links if number in h), None)

    def joined(self, href: str) -> str:
        try:
            return urljoin(self.page_url or self.base, href)
        except ValueError:  # brackets that aren't an address
            return href

    def item(self) -> tuple:
        price = next((p for s in PRICE for t in self.texts.get(s, ()) if (p := price_of(t)) is not None), None)
        before = next((p for s in ORIGINAL_PRICE if self.texts.get(s) and (p := number_of(self.texts[s][0])) is not None), None)
        specs = {}
        for row in self.rows:
            if len(row) >= 2 and row[0].strip() and row[1].strip():
                specs[row[0].strip().replace("：", "").replace(":", "")] = row[1].strip()
        images = list(dict.fromkeys(u for u in map(self.absolute, self.images) if u and not small(u)))
        listed = next((self.elements[s] for s in LISTED if self.elements.get(s)), [])
        return (
            self.title(), price, before, *(self.first(selectors) for selectors in TEXTS.values()), self.seller_id(), any(s in self.elements for s in SHOWS_PRODUCT),
            images[:MOST_IMAGES], [u for u in map(self.absolute, self.links) if u], specs, self.tags,
            [self.joined(own["href"]) for own in listed[:MOST_LINKS] if own.get("href")], self.categories(), self.next_of_search(), self.next_page((*NEXT_PAGE, NEXT_OF_CATEGORY)),
        )

    def absolute(self, url: str) -> str | None:
        if url.startswith("//"):
            return f"https:{url}"
        if url.startswith("/"):
            return self.base + url
        return url if url.startswith("http") else None


def number_of(text: str) -> float | None:
    try:
        return float(re.sub(r"[^\d.]", "", text))
    except ValueError:
        return None


def price_of(text: str) -> float | None:
    price = number_of(text)
    return price if price is not None and 0 < price < 100_000 else None


def small(url: str) -> bool:
    return any(n in url.lower() for n in SMALL_NAMES) and any(s in url for s in SMALL_SIZES)


def extract_items(pages: DataFrame, base_url: str = "https://www.example.com") -> DataFrame:
    """page_id, url, product_id and ITEM's fields of each page(page_id, url, html); a null html has no field."""

    def extract(batches):
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                parser = ItemParser(base_url, url or "")
                parser.feed(html or "")
                parser.close()
                rows.append((page_id, url, *parser.item()))
            yield pd.DataFrame(rows, columns=["page_id", "url", *ITEM])

    schema = ", ".join(f"{name} {kind}" for name, kind in ITEM.items())
    found = pages.select("page_id", "url", "html").mapInPandas(extract, f"page_id long, url string, {schema}")
    return found.withColumn("product_id", product_id_of_url(F.col("url")))


def page_links(items: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """page_id, place, link: the first distinct links of each page."""
    return items.select("page_id", F.posexplode(F.slice(F.array_distinct("links"), 1, most)).alias("place", "link"))


def requests_of(items: DataFrame) -> DataFrame:
    """page_id, kind (product, category, next_of_search, next_of_category), place, name, link: the pages that a page leads to."""
    at = lambda kind, c, name: F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), name(x).alias("name"), (x if kind == "product" else x["url"]).alias("link")))
    none = F.lit(None).cast("string")
    one = lambda c: F.array(F.struct(F.lit(c).alias("kind"), F.lit(0).alias("place"), none.alias("name"), F.col(c).alias("link")))
    every = F.concat(at("product", "product_links", lambda x: none), at("category", "category_links", lambda x: x["name"]), one("next_of_search"), one("next_of_category"))
    return items.select("page_id", F.inline(every)).where("link IS NOT NULL")


def crawl_counters(items: DataFrame) -> DataFrame:
    """One row: pages, those that show a product, items kept and rejected by reason, pictures, share kept in percent."""
    out = checked_items(items).agg(
        F.count("*").alias("pages"), F.count_if("shows_product").alias("products"), F.count_if(F.col("rejected").isNull()).alias("items"),
        *[F.count_if(F.col("rejected") == r).alias(r) for r in ("no_title", "no_price", "bad_price")], F.coalesce(F.sum(F.size("image_urls")), F.lit(0)).alias("images"),
    )
    return out.withColumn("kept_percent", percent(F.col("items"), F.col("pages")))


def image_requests(items: DataFrame) -> DataFrame:
    """page_id, place, url, image_type: the first picture is the main one."""
    some = items.select("page_id", F.posexplode(F.filter("image_urls", is_image_url)).alias("place", "url"))
    return some.withColumn("image_type", F.when(F.col("place") == 0, "main").otherwise("detail"))


def clean_items(items: DataFrame) -> DataFrame:
    """Texts cleaned, descriptions cut, tags cleaned, distinct and in order."""
    out = items
    for name in ("title", "brand", "seller", "location", "category"):
        if name in items.columns:
            out = out.withColumn(name, crawl_text(F.col(name)))
    if "description" in items.columns:
        out = out.withColumn("description", truncate_right(crawl_text(F.col("description")), 2000))
    if "tags" in items.columns:
        tags = F.filter(F.transform("tags", crawl_text), lambda t: (t != "") & (F.length(t) <= 50))
        out = out.withColumn("tags", F.array_sort(F.array_distinct(tags)))
    return out


def checked_items(items: DataFrame) -> DataFrame:
    """items with `rejected`: no_title, no_price, bad_price or null."""
    price = F.col("price").cast("string")
    reason = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "no_title").when(F.coalesce(F.trim(price), F.lit("")) == "", "no_price").when(price.try_cast("double").isNull(), "bad_price")
    return items.withColumn("rejected", reason)


def distinct_items(items: DataFrame, order: list[str]) -> DataFrame:
    """First item of each address and then of each title and price."""
    key = F.md5(F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce(F.col("price").cast("string"), F.lit(""))))
    return first_seen(items.withColumn("product_hash", key), order, "url", "product_hash")
