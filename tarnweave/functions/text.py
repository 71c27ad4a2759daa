"""Text normalisation, fingerprints and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import collapse, strip, text_or_empty

# What marks an image address, and the file extension of a content type.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")
IMAGE_WORDS = ("image", "img", "photo", "pic")
CONTENT_TYPES = {"image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp"}
#: What makes a message or its details one about performance.
PERFORMANCE_WORDS = ("duration", "response time", "execution time", "latency", "throughput", "performance", "timing", "speed")
PERFORMANCE_KEYS = ("duration_ms", "response_time", "execution_time")


def comparable(c: Column) -> Column:
    """Lower case, CJK, ASCII letters, digits and single spaces only."""
    return collapse(F.regexp_replace(F.lower(text_or_empty(c)), r"(?U)[^\x{4e00}-\x{9fa5}a-zA-Z0-9\s]", ""))


def log_pattern(message: Column) -> Column:
    """Message with its numbers and ids as placeholders, in lower case with single spaces."""
    out = F.regexp_replace(text_or_empty(message), r"(?U)\d+", "{N}")
    out = F.regexp_replace(out, "[a-f0-9]{8,}", "{ID}")
    return collapse(F.lower(F.regexp_replace(out, r"/[^/]+/\./", "/{PATH}/./")))


def error_pattern(message: Column) -> Column:
    out = F.regexp_replace(text_or_empty(message), r"(?U)\d+", "{N}")
    return F.substring(F.regexp_replace(out, "[a-f0-9]{8,}", "{ID}"), 1, 200)


def error_fingerprint(kind: Column, message: Column, stack: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", text_or_empty(kind), F.substring(text_or_empty(message), 1, 200), text_or_empty(stack))), 1, 16)


def crawl_text(c: Column) -> Column:
    """Control characters gone (line ends too, before white space is collapsed), trimmed."""
    return collapse(F.regexp_replace(text_or_empty(c), r"[\x{00}-\x{1f}\x{7f}-\x{9f}]", ""))


def truncate_right(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most), r"(?U)\s+$", ""), F.lit("...")))


def product_id_of_url(url: Column) -> Column:
    """Digits before .html, else of an id parameter, else null."""
    pick = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(pick(r"/(\d+)\.html"), pick(r"id=(\d+)"))


def is_image_url(url: Column) -> Column:
    low = F.lower(url)
    marks = [low.contains(x) for x in (*IMAGE_EXTENSIONS, *IMAGE_WORDS)]
    some = marks[0]
    for m in marks[1:]:
        some = some | m
    return F.coalesce(url.rlike("^https?://") & some, F.lit(False))


def extension_of(content_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CONTENT_TYPES.items() for x in p]), content_type), F.lit("jpg"))


def image_path(kind: Column, product_id: Column, url: Column) -> Column:
    return F.concat_ws("/", kind, product_id.cast("string"), F.concat(F.md5(url), F.lit(".jpg")))


def is_performance_log(message: Column, details: Column) -> Column:
    """details: map<string,string>."""
    keys = F.map_keys(F.coalesce(details, F.create_map().cast("map<string,string>")))
    return F.lower(text_or_empty(message)).rlike("|".join(PERFORMANCE_WORDS)) | F.arrays_overlap(keys, F.array(*[F.lit(k) for k in PERFORMANCE_KEYS]))


def canonical_map(data: Column) -> Column:
    """JSON of a map<string,string> with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(data))))


def checksum(data: Column) -> Column:
    return F.substring(F.sha2(canonical_map(data), 256), 1, 16)


def version_id(kind: Column, entity: Column, at: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", kind, entity.cast("string"), at.cast("string"))), 1, 16)


def changed_fields(old: Column, new: Column) -> Column:
    """Keys whose values differ between two maps, in order."""
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    return F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))


def group_id(ids: Column) -> Column:
    return F.substring(F.md5(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), "|")), 1, 16)


def metric_key(name: Column, tags: Column) -> Column:
    """name{k=v,...} with the tags in order."""
    parts = F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, name).otherwise(F.concat(name, F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def backoff(base: Column, factor: Column, attempt: Column, most: Column) -> Column:
    return F.least(base * F.pow(factor, attempt), most)


def client_key(user: Column, forwarded: Column, real: Column) -> Column:
    """User, else the first forwarded address, else the real one."""
    first = strip(F.split(forwarded, ",")[0])
    return F.coalesce(F.concat(F.lit("user:"), F.nullif(user, F.lit(""))), F.concat(F.lit("ip:"), F.coalesce(F.nullif(first, F.lit("")), real)))


def resume_advice(percent: Column) -> Column:
    return F.when(percent > 50, "resume").when(percent < 20, "restart").otherwise("either")
