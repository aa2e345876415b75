"""HTML text extraction (SRC5), page scraping (F33) and links (F34) as
regular-expression column functions (JVM-side, per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character references that are decoded.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&amp;", "&")]

DROP_BLOCKS = [r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>",
               r"(?s)<!--.*?-->"]
LINK = r'(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def unescape(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_to_text(html: Column | str) -> Column:
    """SRC5: drop script/style/comments, tags -> newline, decode entities,
    collapse runs of spaces and blank lines, strip."""
    x = _c(html)
    for p in DROP_BLOCKS:
        x = F.regexp_replace(x, p, "")
    x = F.regexp_replace(x, r"<[^>]*>", "\n")
    x = unescape(x)
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")


def page_title(html: Column | str) -> Column:
    return unescape(F.regexp_extract(_c(html), TITLE, 1))


def link_hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(_c(html), F.lit(LINK), 1)


def link_texts(html: Column | str) -> Column:
    return F.regexp_extract_all(_c(html), F.lit(LINK), 2)
