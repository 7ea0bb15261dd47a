"""Links, articles and dates of portal pages, by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEDIA = r"(?i)\.(?:jpg|jpeg|png|gif|webp|pdf)$"


def unescape(text: Column) -> Column:
    """The entities that pages are full of; the ampersand last."""
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def inner_text(html: Column) -> Column:
    """Text between tags, its pieces joined by one space."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"<[^>]*>", " ")), r"(?U)\s+", " "))


def links(pages: DataFrame, limit: int = 15) -> DataFrame:
    """(page_id, ordinal, link): links of a page into its own domain, without query and fragment,
    each once, in page order, ``limit`` at most."""
    base = F.regexp_extract("url", r"^(https?)://([^/?#]+)", 1)
    host = F.regexp_extract("url", r"^(https?)://([^/?#]+)", 2)
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    folder = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), r"[^/]*$", "")
    rows = pages.select("page_id", base.alias("_s"), host.alias("_h"), F.when(folder == "", "/").otherwise(folder).alias("_d"), hrefs.alias("_a"))

    def absolute(h: Column) -> Column:
        h = F.trim(h)
        return (
            F.when(h.rlike("(?i)^https?://"), h).when(h.startswith("//"), F.concat(F.col("_s"), F.lit(":"), h))
            .when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None)).when(h.startswith("/"), F.concat(F.col("_s"), F.lit("://"), F.col("_h"), h)).otherwise(F.concat(F.col("_s"), F.lit("://"), F.col("_h"), F.col("_d"), h))
        )

    found = F.transform(F.filter("_a", lambda h: (F.trim(h) != "") & ~F.trim(h).startswith("#")), absolute)
    plain = F.transform(F.filter(found, lambda u: u.isNotNull()), lambda u: F.regexp_replace(F.regexp_extract(u, r"^([^?#]*)", 1), "/+$", ""))
    own = F.filter(plain, lambda u: F.contains(F.regexp_extract(u, r"^https?://([^/]+)", 1), F.col("_h")) & ~u.rlike(MEDIA))
    return rows.select("page_id", F.posexplode(F.slice(F.array_distinct(own), 1, limit)).alias("ordinal", "link"))


def date_of(html: Column) -> Column:
    """A time tag's datetime or text, else the first of four meta tags."""
    attr = F.regexp_extract(html, r"""(?is)<time\b[^>]*?\bdatetime\s*=\s*["']([^"']+)["']""", 1)
    inner = inner_text(F.regexp_extract(html, r"(?is)<time\b[^>]*>(.*?)</time>", 1))
    metas = []
    for key, name in (("property", "article:published_time"), ("name", "pubdate"), ("name", "publish_date"), ("name", "date")):
        metas.append(F.regexp_extract(html, rf"""(?is)<meta\b(?=[^>]*\b{key}\s*=\s*["']{name}["'])[^>]*?\bcontent\s*=\s*["']([^"']+)["']""", 1))
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (attr, inner, *metas)])


def articles(pages: DataFrame, keywords: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, title, text, created_at_raw, appeal_id): heading and paragraphs; pages without
    either, or without any of the keywords, are left out."""
    h = F.coalesce("html", F.lit(""))
    h = F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    title = inner_text(F.regexp_extract(h, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    parts = F.regexp_extract_all(h, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|</article>|</div>|<footer|</body>|\z)"), F.lit(1))
    text = F.array_join(F.filter(F.transform(parts, inner_text), lambda p: p != ""), "\n")
    rows = pages.select("page_id", "url", title.alias("title"), text.alias("text"), date_of(F.coalesce("html", F.lit(""))).alias("created_at_raw"), F.sha1(F.coalesce("url", F.lit("")).cast("binary")).alias("appeal_id"))
    rows = rows.filter("title <> '' OR text <> ''")
    if keywords:
        t = F.lower("text")
        any_ = F.lit(False)
        for k in keywords:
            any_ = any_ | F.contains(t, F.lit(k.lower()))
        rows = rows.filter(any_)
    return rows
