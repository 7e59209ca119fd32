"""Design records from raw web pages."""

from __future__ import annotations

import html as html_lib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.scalars import file_stem
from ..functions.semantics import col

# The parts of a page that make up a record.
TITLE_META = r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)[\"']"
IMAGE_META = r"(?is)<meta[^>]*property=[\"']og:image[\"'][^>]*content=[\"']([^\"']*)[\"']"
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LINK = r"(?is)<a[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
IMAGE = r"(?is)<img[^>]*?src=[\"']([^\"']+)[\"']"
TAG = r"<[^>]+>"


@pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html_lib.unescape, na_action="ignore")


def entities(c: Column) -> Column:
    """Entity-decoded text; texts without an ampersand pass by."""
    return F.when(c.contains("&"), unescape(F.when(c.contains("&"), c))).otherwise(c)


def basic_entities(c: Column) -> Column:
    """Text with the five escapes of markup decoded, ampersands last; other entities, and those without a semicolon, stay."""
    for escaped, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, TAG, " "), r"\s+", " "))


def resolve_url(base, href) -> Column:
    """Link target against the page address."""
    b, h = col(base), col(href)
    origin = F.regexp_extract(b, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(b, r"^([a-zA-Z]+://[^?#]*/)", 1)
    folder = F.when(F.length(folder) <= F.length(origin), F.concat(origin, F.lit("/"))).otherwise(folder)
    return (F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(b, "^([a-zA-Z]+:)", 1), h))
            .when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(folder, h)))


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link: position, target, label and the file format the label names."""
    anchors = F.regexp_extract_all("html", F.lit(LINK), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(anchors).alias("position", "a"))
    label = strip_tags(F.regexp_extract("a", LINK, 2))
    rows = rows.select("page_id", "position", resolve_url("url", F.regexp_extract("a", LINK, 1)).alias("target"), label.alias("label"))
    return rows.withColumn("format", F.regexp_extract(F.lower("label"), r":\s*([a-z0-9+]+)\b", 1))


def extract_page_records(pages: DataFrame, decode: Callable[[Column], Column] = entities) -> DataFrame:
    """id, title, size, colors, stitches, preview image and design file links of each page; ``decode`` reads the entities of its title."""
    h = F.col("html")
    found = lambda pattern: F.regexp_extract(h, pattern, 1)
    text = strip_tags(h)
    heading = F.trim(F.regexp_replace(found(HEADING), TAG, " "))
    stem = file_stem(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"/+$", ""))
    raw = F.coalesce(F.nullif(found(TITLE_META), F.lit("")), F.nullif(heading, F.lit("")), F.nullif(F.trim(found(TITLE)), F.lit("")), stem)
    images = F.concat(F.array(found(IMAGE_META)), F.regexp_extract_all(h, F.lit(IMAGE), F.lit(1)))
    usable = F.filter(images, lambda u: F.lower(u).rlike("[.](jpg|jpeg|png|webp)"))
    preferred = F.filter(usable, lambda u: F.lower(u).rlike("embroidery_design|files/"))
    chosen = F.coalesce(F.get(preferred, F.lit(0)), F.get(F.reverse(usable), F.lit(0)), F.lit(""))
    links = page_links(pages)
    file_link = lambda fmt: F.min_by(F.when(F.col("format") == fmt, F.col("target")), F.when(F.col("format") == fmt, F.col("position")))
    per = links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("link_count"), F.count_distinct("target").alias("distinct_links"), file_link("dst").alias("dst_url"), file_link("pes").alias("pes_url"))
    record = pages.select(
        "page_id", F.substring(F.sha1("url"), 1, 12).alias("id"), "url", decode(raw).alias("title"),
        F.trim(F.regexp_extract(text, r"(?i)Size:\s*([^C]+?)\s+Colors[;:]", 1)).alias("size_text"),
        F.regexp_extract(text, r"(?i)Colors[;:]\s*(\d+)", 1).alias("colors"), F.regexp_extract(text, r"(?i)Stitches:\s*(\d+)", 1).alias("stitches"),
        F.when(chosen == "", F.lit("")).otherwise(resolve_url("url", chosen)).alias("preview_url"))
    return record.join(per, "page_id", "left").fillna(0, ["link_count", "distinct_links"]).fillna("", ["dst_url", "pes_url"])


def first_seen_urls(links: DataFrame, include: str = "", exclude: str = "^$") -> DataFrame:
    """Each accepted target once, where it was seen first."""
    kept = links.filter(F.col("target").contains(include) & ~F.col("target").rlike(exclude))
    return kept.groupBy("target").agg(F.min(F.struct("page_id", "position")).alias("f")).select("target", "f.page_id", "f.position")
