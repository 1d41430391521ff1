"""Text, HTML, URL and JSON functions."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = "\\s\\u00A0\\u3000\\uFEFF"


def trim_all(c: Column) -> Column:
    """Trims no-break and full-width spaces as well."""
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "(?i)<br\\s*/?>", "\n"), "<[^>]*>", "")


def shorten(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def escape_brackets(c: Column) -> Column:
    return F.translate(c, "[]", "［］")


def bullets(items: Column, mark: str = "・") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")


def japanese_date(c: Column) -> Column:
    return F.regexp_replace(c, "([0-9]{4})([0-9]{2})([0-9]{2})", "$1年$2月$3日")


def shop_links(isbn: Column, shop_url: Column, catalog_url: Column) -> Column:
    """Where to buy a book: the shop's own link or a search by ISBN, the bookseller by ISBN, the catalogue's link; null without any."""
    bare, given = strip_isbn(F.coalesce(isbn, F.lit(""))), lambda c: F.coalesce(c, F.lit("")) != ""
    shop = F.when(given(shop_url), shop_url).when(bare != "", F.concat(F.lit("https://books.rakuten.co.jp/search?sitem="), bare))
    links = [("楽天ブックス", shop), ("Amazon", F.when(bare != "", F.concat(F.lit("https://www.amazon.co.jp/dp/"), bare))), ("Google Books", F.when(given(catalog_url), catalog_url))]
    shown = F.array_compact(F.array(*(F.concat(F.lit(f"[{name}]("), url, F.lit(")")) for name, url in links)))
    return F.when(F.size(shown) > 0, F.array_join(shown, " | "))


def strip_isbn(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


# --- URLs


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def without_utm(url: Column) -> Column:
    return F.get(F.split(url, "\\?utm"), F.lit(0))


def encode_component(c: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are and writes a space as %20."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def with_params(url: Column, params: dict[str, Column]) -> Column:
    """Sets query parameters: others stay in place, replaced ones go, the new come last; the fragment stays."""
    fragment = F.regexp_extract(url, "(?s)#.*$", 0)
    plain = F.regexp_replace(url, "(?s)#.*$", "")
    base = F.get(F.split(plain, "\\?", 2), F.lit(0))
    query = F.coalesce(F.get(F.split(plain, "\\?", 2), F.lit(1)), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (query != "") & ~F.coalesce(F.try_url_decode(F.get(F.split(p, "="), F.lit(0))), F.lit("")).isin(list(params)))
    new = F.array(*(F.concat(F.lit(f"{k}="), encode_component(v)) for k, v in params.items()))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(kept, new), "&"), fragment)


def tracked(url: Column, as_of: Column) -> Column:
    """Newsletter parameters on http links; others stay as they are."""
    site = F.coalesce(F.get(F.split(url, "/"), F.lit(2)), F.lit(""))
    params = {"utm_source": F.lit("newsletter"), "utm_medium": F.lit("email"), "utm_campaign": F.concat(F.lit("ai_guide_"), F.date_format(as_of, "yyyyMMdd")), "utm_content": F.replace(site, F.lit("."), F.lit("_"))}
    return F.when(F.startswith(url, F.lit("http")), with_params(url, params)).otherwise(url)


# --- JSON


def json_object(c: Column, schema: str) -> Column:
    """The outermost {...} of a text, parsed; null where there is none or it is broken."""
    found = F.regexp_extract(c, "(?s)\\{.*\\}", 0)
    return F.from_json(F.when(found != "", found), schema)


# --- HTML without a CSS engine

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Which elements hold the body of an article, tried in this order.
BODY = ("article", ".article-body", ".post-content", "#content", ".entry-content", "div[class*=content]", "main")
GUIDE_BODY = ("article", "main", ".content", "#content", ".post-content")
GUIDE_DROP = ("script", "style", "nav", "header", "footer", "aside", ".ad", ".advertisement", ".sidebar", ".menu", ".breadcrumb", ".related", ".comments")


def _matches(selector: str, tag: str, attrs: dict[str, str]) -> bool:
    classes = attrs.get("class", "")
    if selector[0] == ".":
        return selector[1:] in classes.split()
    if selector[0] == "#":
        return attrs.get("id") == selector[1:]
    if "[class*=" in selector:
        name, _, part = selector.partition("[class*=")
        return tag == name and part[:-1] in classes
    return tag == selector


class _Texts(HTMLParser):
    """Text of the elements that match a selector, for each selector at once, an element inside another counting for both; dropped
    elements give none."""

    def __init__(self, selectors: tuple[str, ...], drop: tuple[str, ...] = ()):
        super().__init__(convert_charrefs=True)
        self.selectors, self.drop = selectors, drop
        self.open: list[tuple[str, int, bool]] = []
        self.hidden = 0
        self.matches: list[list[list[str]]] = [[] for _ in selectors]  # the texts of each selector's elements, in document order
        self.reading: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag == "p":  # an open paragraph ends where another begins
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    self._close(i)
                    break
                if self.open[i][0] in ("article", "div", "main", "section", "body", "td", "li"):
                    break
        a = {k: v or "" for k, v in attrs}
        hits = tuple(i for i, s in enumerate(self.selectors) if _matches(s, tag, a))
        off = any(_matches(s, tag, a) for s in self.drop)
        self.open.append((tag, len(hits), off))
        for i in hits:
            self.matches[i].append([])
            self.reading.append(self.matches[i][-1])
        self.hidden += off

    def _close(self, at: int):
        for _, hits, off in self.open[at:]:
            self.hidden -= off
            del self.reading[len(self.reading) - hits :]
        del self.open[at:]

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                return self._close(i)

    def handle_data(self, data):
        if not self.hidden:
            for text in self.reading:
                text.append(data)


def element_texts(html: str, selectors: tuple[str, ...], drop: tuple[str, ...] = ()) -> list[str | None]:
    """The joined text of each selector's elements, None where it has none."""
    p = _Texts(selectors, drop)
    p.feed(html)
    p.close()
    return ["".join(map("".join, m)) if m else None for m in p.matches]


def body_text(html: str) -> str:
    """The elements of the first selector that matches any; all paragraphs where those hold no text, or none matches."""
    *found, paragraphs = element_texts(html, (*BODY, "p"))
    return next((t for t in found if t is not None), "") or paragraphs or ""


# Pages go to Python a hundred at a time, not in Arrow batches of up to 10,000 or 64 MB: the parser needs but one, and its time is all the time there is.


@F.udf(StringType(), useArrow=False)
def _raw_body(h: str | None) -> str:
    return body_text(h) if h else ""


@F.udf(StringType(), useArrow=False)
def _raw_guide(h: str | None) -> str:
    return next((t for t in element_texts(h, GUIDE_BODY, GUIDE_DROP) if t and len(t.strip()) > 200), "") if h else ""


def page_body(html: Column, most: int = 8000) -> Column:
    """The text of the first selector that matches, see body_text; runs of white space are one space. The cut after `most`
    characters belongs to the feature."""
    t = trim_all(F.regexp_replace(_raw_body(html), "(?U)\\s\\s+", " "))
    return F.when(t != "", F.substring(t, 1, most))


def guide_body(html: Column, snippet: Column) -> Column:
    """As above for guides: navigation and the like is dropped, dates are removed, short bodies give way to the snippet."""
    t = trim_all(F.regexp_replace(F.regexp_replace(_raw_guide(html), "(?U)\\s+", " "), "[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日", ""))
    return F.when(F.char_length(t) > 200, t).otherwise(snippet)
