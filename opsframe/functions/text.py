"""Text, URL and list expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that matching and query building leave out.
STOP_WORDS = (
    "set of for with and the in to a an & pack pcs piece pieces new box combo kit type style color size each per multi"
).split()
FILLERS = (
    "for|indoor|outdoor|living\\s*room|bedroom|kitchen|pack\\s*of\\s*\\d+|set\\s*of\\s*\\d+|piece|pieces|with|and|the|a|an|in|on|at|to|of|from|by|as|is|it|"
    "this|that|these|those|new|old|best|top|high|quality|premium|standard|generic|multi|color|colour|size|large|small|medium|big|little|mini|mega|super|ultra|pro|plus|extra"
)
PACK_PHRASES = "pack of \\d+|set of \\d+|multicolor|multicolour|random color|random colour|assorted|as per stock|as per availability|pack of"
SIZE_SUFFIXES = ("_512", "_256", "_128", "_320", "_UL320", "_SL1500")


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_text(c: Column) -> Column:
    """Lower case, all but ASCII word characters to spaces, squeezed."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^\w\s]", " "))


def match_tokens(c: Column) -> Column:
    """Tokens for matching: Unicode word characters and slashes, no stop words, longer than one character."""
    cleaned = F.regexp_replace(F.lower(c), r"(?U)[^\w\s/]", " ")
    return F.filter(F.split(cleaned, r"(?U)\s+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def bigrams(tokens: Column) -> Column:
    """Distinct neighbouring pairs; none for fewer than two tokens."""
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def name_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.trim(c)), rf"\b({PACK_PHRASES})\b", ""))


def strip_image_proxy(url: Column, host: str = "resize.shop.example") -> Column:
    """The inner URL of a resizing proxy, other URLs as they are."""
    inner = F.regexp_extract(url, rf"^https://{host.replace('.', '[.]')}/V[^/]+/(https?://.*)", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), url)


def full_size_image(url: Column) -> Column:
    """Without query and 512-pixel suffix."""
    return F.regexp_replace(F.substring_index(url, "?", 1), r"_512(?=\.)", "")


def hires_image(url: Column) -> Column:
    """The 1500-pixel form: the size code before the ending replaced, or added where the name has none."""
    coded = F.regexp_replace(url, r"(?i)\._.*_\.(?=jpg|jpeg|png|webp$)", "._SL1500_.")
    added = F.regexp_replace(url, r"(?i)\.(jpg|jpeg|png|webp)$", r"._SL1500_.$1")
    return F.when(coded != url, coded).when(url.rlike(r"\._[A-Z]"), url).otherwise(added)


def strip_html(c: Column) -> Column:
    """Breaks to newlines, tags removed, blank lines collapsed."""
    lines = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    bare = F.regexp_replace(lines, r"<[^>]+>", "")
    return F.trim(F.regexp_replace(bare, r"\n\s*\n+", "\n"))


def url_tail(url: Column) -> Column:
    """Last path segment, query and trailing slash left out."""
    path = F.regexp_replace(F.substring_index(F.substring_index(url, "?", 1), "#", 1), "/+$", "")
    return F.substring_index(path, "/", -1)


def product_code(url: Column) -> Column:
    """A shop's own code in a link: ten characters behind a product path, else `pid`, else the last segment, else the link."""
    found = lambda pattern: F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    tail = F.nullif(F.substring_index(F.substring_index(url, "/", -1), "?", 1), F.lit(""))
    return F.coalesce(found(r"/dp/([A-Z0-9]{10})"), found(r"/gp/product/([A-Z0-9]{10})"), found(r"pid=([^&]+)"), tail, url)


def normalize_url_cell(cell: Column, prefix: str) -> Column:
    """http URLs stay, bare paths get a prefix, empty cells are null."""
    t = F.trim(cell)
    return F.when(t == "", F.lit(None)).when(F.lower(t).startswith("http"), t).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_replace(t, "^/+", "")))


def extract_domain(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^https?://(?:www\.)?([^/:?#]+)", 1)


def platform_of(url: Column) -> Column:
    d = extract_domain(url)
    return F.when(F.contains(d, F.lit("flipkart.com")), "flipkart").when(F.contains(d, F.lit("meesho.com")), "meesho").when(F.contains(d, F.lit("amazon.")), "amazon")


def bucket_of_link(link: Column) -> Column:
    """The platform of a product link by host and path marker, without its query and fragment; null for other links."""
    bare = F.substring_index(F.substring_index(link, "?", 1), "#", 1)
    has = lambda *parts: F.lit(True) if not parts else F.contains(bare, F.lit(parts[0])) & has(*parts[1:])
    # fixed values: hosts and path markers
    return F.when(has("amazon.in", "/dp/"), "amazon").when(has("flipkart.com", "/p/") | has("flipkart.com", "/product/"), "flipkart").when(has("meesho.com", "/p/"), "meesho")


def allowed_host(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one; false if there is none."""
    host = F.regexp_extract(F.lower(url), r"^https?://([^/:?#]+)", 1)
    pattern = "(^|[.])(" + "|".join(d.replace(".", "[.]") for d in domains) + ")$"
    return F.coalesce(host.rlike(pattern), F.lit(False))


def is_blocked_page(html: Column, least: int = 5000) -> Column:
    head = F.substring(html, 1, 2000)
    marks = [F.contains(html, F.lit(m)) for m in ("sec-if-cpt-container", "Access Denied", "cf-browser-verification")]
    marks += [F.contains(head, F.lit(m)) for m in ("_abck", "/cdn-cgi/")]
    out = F.length(html) < least
    for m in marks:
        out = out | m
    return out


# Texts of pages that ask for a human, in lower case, and of pages that refuse a request.
ROBOT_MARKS = [
    "enter the characters you see below",
    "type the characters you see in this image",
    "robot check",
    "api-services-support@amazon.com",
    "/errors/validatecaptcha",
    "to discuss automated access to amazon data",
]
REFUSAL_MARKS = ["Something went wrong", "Access Denied", "Please verify you are a human"]


def is_robot_page(html: Column, url: Column, least: int = 10_000) -> Column:
    """A robot check by link or text, or a page under `least` characters that has no product title; null html counts as empty."""
    low = F.lower(F.coalesce(html, F.lit("")))
    short = (F.length(low) < least) & ~F.contains(low, F.lit("producttitle"))
    asked = F.exists(F.array(*map(F.lit, ROBOT_MARKS)), lambda m: F.contains(low, m))
    return F.coalesce(F.contains(F.lower(url), F.lit("validatecaptcha")), F.lit(False)) | asked | short


def is_refused_page(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    return F.contains(F.lower(text), F.lit("captcha")) | F.exists(F.array(*map(F.lit, REFUSAL_MARKS)), lambda m: F.contains(text, m))


def blocked_url(url: Column) -> Column:
    return F.lower(url).rlike("captcha|challenge|blocked|sorry")


def extract_dimensions(c: Column) -> Column:
    """w x h x d standing by itself, or behind a size word, else w x h behind a size word; commas to dots; null if there is none."""
    number, times, word = r"(\d+(?:[.,]\d+)?)", r"\s*[xX×*]\s*", r"(?:dimension|dims?|size)[\s:]*"
    three = number + times + number + times + number
    alone = rf'(?:\b|^){three}\s*(?:cm|mm|inches|in|")?(?:\b|$)'
    two = rf"(?i){word}{number}\s*x\s*{number}"
    sides = lambda pattern, n: F.when(c.rlike(pattern), F.replace(F.concat_ws(" x ", *(F.regexp_extract(c, pattern, i) for i in range(1, n + 1))), F.lit(","), F.lit(".")))
    return F.coalesce(sides(alone, 3), sides(f"(?i){word}{three}", 3), sides(two, 2))


def sku_query(title: Column) -> Column:
    """A model number if there is one, else the first ten meaningful tokens, else the first three tokens."""
    coded = F.nullif(F.regexp_extract(title, r"(\b[\dA-Za-z]{3,}[-/][\dA-Za-z]+\b)", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(title, r"\b([A-Z]{1,3}\d{3,})\b", 1), F.lit(""))
    tokens = match_tokens(title)
    meaningful = F.filter(tokens, lambda t: ~t.rlike(r"^\d{1,3}$"))
    return F.coalesce(coded, bare, F.nullif(F.array_join(F.slice(meaningful, 1, 10), " "), F.lit("")), F.array_join(F.slice(tokens, 1, 3), " "))


def video_query(name: Column) -> Column:
    """The first four words of a product name without brackets, trailing codes and filler words."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\s*\([^)]+\)\s*", " "), r"\s*[-–—]\s*[A-Z0-9-]+\s*$", " ")
    words = squeeze(F.regexp_replace(bare, rf"(?i)\b({FILLERS})\b", " "))
    return F.array_join(F.slice(F.split(words, " "), 1, 4), " ")


def spec_value(specs: Column, keys: tuple[str, ...], first: bool = True, whole: tuple[str, ...] = ()) -> Column:
    """The first or last value of a map, in its own order, whose key holds one of the words or is one of the whole names."""

    def fits(e: Column) -> Column:
        key = F.lower(e["key"])
        out = key.isin(*whole) if whole else F.lit(False)
        for word in keys:
            out = out | F.contains(key, F.lit(word))
        return out

    return F.try_element_at(F.filter(F.map_entries(specs), fits), F.lit(1 if first else -1))["value"]


# Whole names of specifications that are dimensions.
SIZE_NAMES = ("size", "product dimensions", "item dimensions l x w x h")


def spec_derive(specs: Column, first: bool = True) -> Column:
    """struct<weight, dimensions, gst, hsn> out of a page's specifications in page order.

    With `first` the first key that fits counts, and dimensions end before a semicolon; else the last one, whole.
    """
    size = spec_value(specs, ("dimension",), first, SIZE_NAMES)
    return F.struct(
        spec_value(specs, ("weight",), first).alias("weight"),
        (F.trim(F.substring_index(size, ";", 1)) if first else size).alias("dimensions"),
        spec_value(specs, ("gst",), first).alias("gst"),
        spec_value(specs, ("hsn",), first).alias("hsn"),
    )


# Entities that pages commonly hold.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&rarr;": "→", "&amp;": "&"}


def clean_ws(c: Column) -> Column:
    """Bidirectional marks removed, common entities resolved, white space squeezed."""
    out = F.regexp_replace(c, "[‎‏‪-‮]", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def unescape_html(c: Column) -> Column:
    """All entities of HTML 5, in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return run(c)


def token_sets(a: Column, b: Column) -> Column:
    """The words of both, of either, and of the first alone, as sets."""
    return F.struct(F.array_intersect(a, b).alias("both"), F.array_union(a, b).alias("either"), F.array_except(a, b).alias("only"))


def plain_text(message: Column) -> Column:
    """A chat message without its marks for bold and code."""
    return F.translate(message, "*`", "")
