"""Values taken out of URLs, titles and page labels."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.functions.text import blank_if_null

NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
URL_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def author_from_title(title: Column) -> Column:
    """Name before the first colon of a headline, else 'unknown'."""
    name = F.regexp_extract(blank_if_null(title), r"(?U)^([\p{L}\p{N}_\s\-]+):", 1)
    name = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    return F.when(name == "", F.lit("unknown")).otherwise(name)


def date_from_url(url: Column) -> Column:
    """/YYYY/MM/DD inside a URL as YYYY-MM-DD, '' without one."""
    u, pattern = blank_if_null(url), r"/(\d{4})/(\d{2})/(\d{2})"
    parts = [F.regexp_extract(u, pattern, i) for i in (1, 2, 3)]
    return F.when(parts[0] == "", F.lit("")).otherwise(F.concat_ws("-", *parts))


def url_from_text(text: Column) -> Column:
    return F.regexp_extract(blank_if_null(text), r"(?U)https?://\S+", 0)


def title_from_url(url: Column) -> Column:
    """Last path part of a URL with dashes and underscores as spaces."""
    path = F.regexp_replace(F.regexp_extract(blank_if_null(url), URL_PATH, 1), r";[^/]*$", "")
    slug = F.element_at(F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/"), -1)
    return F.trim(F.regexp_replace(slug, "[-_]+", " "))


def netloc(url: Column) -> Column:
    """Network location with user-info and port; '' when the URL has no scheme or is null."""
    return F.regexp_extract(blank_if_null(url), NETLOC, 1)


def domain_extension(url: Column) -> Column:
    return F.element_at(F.split(netloc(url), r"\."), -1)


def channel_name(label: Column) -> Column:
    """Channel between 'by' and the first number of a video label."""
    name = F.regexp_extract(blank_if_null(label), r"(?U)by (.+?) \d", 1)
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
