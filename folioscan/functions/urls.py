"""URL expressions. Site rules are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, lines_of, strip

# Hosts whose article addresses carry a noisy query, and the id patterns tried in order.
ARTICLE_HOSTS = ("toutiao.com",)
ID_PATTERNS = (r"(?i)toutiao\.com/article/(\d+)", r"(?i)toutiao\.com/i(\d+)", r"(?i)toutiao\.com/w/(\d+)")
NOISE_PHRASES = ("微信扫一扫", "扫码分享", "长按识别", "阅读原文", "在看 ")
BAD_TITLES = ("mp.weixin.qq.com", "weixin.qq.com", "微信公众号", "")
SHELL_MARKER = "微信扫一扫"
SHELL_HOST = "mp.weixin.qq.com"


def host(url) -> Column:
    """Network location: what stands between `//` and the next `/`, `?` or `#`."""
    return F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def normalize_url(url, article_hosts: Sequence[str] = ARTICLE_HOSTS, article_path: str = "/article/") -> Column:
    """Add a scheme when missing; addresses of listed article sites lose query and fragment and end in `/`."""
    raw = strip(url)
    full = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    head = F.regexp_extract(full, r"^([^?#]*)", 1)
    path = F.regexp_extract(head, r"^[a-zA-Z]+://[^/]*(/.*)?$", 1)
    listed = F.lit(False)
    for name in article_hosts:
        listed = listed | F.lower(host(full)).contains(name)
    trimmed = F.concat(F.regexp_replace(head, "/+$", ""), F.lit("/"))
    return F.when(listed & path.contains(article_path), trimmed).otherwise(full)


def url_content_id(url, patterns: Sequence[str] = ID_PATTERNS) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(col(url), p, 1), F.lit("")) for p in patterns])


def domain_slug(url) -> Column:
    name = F.when(host(url) == "", "web").otherwise(host(url))
    return F.regexp_replace(name, r"[^a-zA-Z0-9.-]", "-")


def drop_noise_lines(markdown, phrases: Sequence[str] = NOISE_PHRASES) -> Column:
    def clean(line: Column) -> Column:
        ok = F.lit(True)
        for phrase in phrases:
            ok = ok & ~line.contains(phrase)
        return ok

    return strip(F.array_join(F.filter(lines_of(markdown), clean), "\n"))


def heading_title(title, body, bad: Sequence[str] = BAD_TITLES) -> Column:
    """The first level-1 heading when the title says nothing."""
    heads = F.filter(lines_of(body), lambda s: s.startswith("# "))
    useless = F.lower(strip(title)).isin(*bad) | strip(title).isin(*bad)
    return F.when(useless, F.coalesce(strip(F.substring(F.get(heads, F.lit(0)), 3, 1 << 30)), col(title))).otherwise(col(title))


def page_quality(title, markdown, bad: Sequence[str] = ("mp.weixin.qq.com", "weixin.qq.com", ""),
                 marker: str = SHELL_MARKER, shell_host: str = SHELL_HOST) -> Column:
    """False for pages with an empty title, repeated shell markers or almost no text."""
    md = F.coalesce(col(markdown), F.lit(""))
    name = F.lower(F.coalesce(col(title), F.lit("")))
    shell = (F.regexp_count(md, F.lit(marker)) >= 2) | ((F.length(md) < 150) & md.contains(shell_host))
    return ~name.isin(*bad) & ~shell & (F.length(strip(md)) >= 80)


def local_name(url, title) -> Column:
    """Content-addressed file name of a fetched page."""
    from .text import slugify

    return F.concat(F.substring(F.sha2(col(url), 256), 1, 16), F.lit("-"), domain_slug(url), F.lit("-"),
                    F.substring(slugify(title), 1, 60), F.lit(".md"))
