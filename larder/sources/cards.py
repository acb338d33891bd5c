"""Deal cards in HTML pages, read in Arrow batches: plain tags by one pattern, anything else by the standard library's parser."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units

RAW_CARD = "struct<name:string,description:string,price_new:string,price_old:string,price_discount:string,date_text:string,href:string,image_url:string>"
FIELDS = ("name", "description", "price_new", "price_old", "price_discount", "date_text", "href", "image_url")
#: A closing tag, or an opening one whose attributes are quoted and hold no references.
PLAIN_TAG = re.compile(r'<(?:/([A-Za-z][A-Za-z0-9]*)|([A-Za-z][A-Za-z0-9]*)((?: [A-Za-z-]+="[^"<>&]*")*))>')
ATTRIBUTE = re.compile(r' ([A-Za-z-]+)="([^"]*)"')
#: The value of an attribute that is no class.
VALUE = re.compile(r'(?<! (?i:class)=)"[^"]*"')
#: Elements whose content is no markup.
RAW_TEXT = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Class names of a page's cards, and what their texts are.
TEXTS = {"card-description": "description", "price-new": "price_new", "price-old": "price_old", "price-discount": "price_discount", "card-date": "date_text"}


class _Cards(HTMLParser):
    """Collects the texts and links of every div.card.dealtype-deal, the first of each kind."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[dict] = []
        self.card: dict | None = None
        self.stack: list[tuple[str, str | None, bool]] = []  # tag, field that it fills, in an image holder

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.card is None and tag != "div":
            return
        a = dict(attrs)
        classes = (a.get("class") or "").split() if a else ()
        if self.card is None:
            if "card" in classes and "dealtype-deal" in classes:
                self.card, self.stack = {}, [(tag, None, False)]
            return
        if tag == "a" and "href" in a:
            self.card.setdefault("href", a["href"])
        if tag == "img" and any(s[2] for s in self.stack):
            self.card.setdefault("image_url", a.get("src"))
        if tag in VOID:
            return
        field = None
        if classes:
            field = "name" if tag == "h3" and "card-title" in classes else next((f for c, f in TEXTS.items() if c in classes), None)
        field = field if field and field not in self.card else None
        if field:
            self.card[field] = []
        self.stack.append((tag, field, "card-image" in classes))

    def handle_data(self, data: str) -> None:
        if self.card is not None and (data := data.strip()):
            for _, field, _ in self.stack:
                if field:
                    self.card[field].append(data)

    def handle_endtag(self, tag: str) -> None:
        if self.card is None or tag in VOID or self.stack[-1][0] != tag and not any(s[0] == tag for s in self.stack):
            return
        while self.stack and self.stack.pop()[0] != tag:
            pass
        if not self.stack:
            self.cards.append({k: "".join(v) if isinstance(v, list) else v for k, v in self.card.items()})
            self.card = None


@lru_cache(256)
def _shape(closed: tuple, opened: tuple, attrs: tuple) -> list[dict] | None:
    """Which texts and links make the cards of a page with these tags, by the tags that they follow or stand in; None if an element's content is no markup."""
    parser = _Cards()
    for k, tag in enumerate(opened):
        if closed[k]:
            parser.handle_endtag(closed[k].lower())
        elif tag.lower() in RAW_TEXT:
            return None
        else:
            parser.handle_starttag(tag.lower(), [(n.lower(), v if n.lower() == "class" else str(k)) for n, v in ATTRIBUTE.findall(attrs[k])])
        parser.handle_data(f"{k},")
    at = lambda f, v: v and int(v) if f in ("href", "image_url") else [int(k) for k in v.split(",")[:-1]]
    return [{f: at(f, v) for f, v in c.items()} for c in parser.cards]


def _attribute(text: str, name: str) -> str:
    return {n.lower(): v for n, v in ATTRIBUTE.findall(text)}[name]


def _plain(html: str) -> list[dict] | None:
    """The cards of a page of plain tags and text; None if it has anything else. Pages of the same tags and classes have their cards in the same places."""
    parts = PLAIN_TAG.split(html)  # text, then closed, opened, attributes, text for each tag
    texts, attrs = parts[4::4], parts[3::4]
    if "<" in parts[0] or "<" in "".join(texts):
        return None
    shape = _shape(tuple(parts[1::4]), tuple(parts[2::4]), tuple(VALUE.sub('""', a) if a and not a.startswith(' class="') else a for a in attrs))
    if shape is None:
        return None
    text = lambda k: (unescape(texts[k]) if "&" in texts[k] else texts[k]).strip()
    said = lambda f, v: None if v is None else _attribute(attrs[v], "href" if f == "href" else "src") if isinstance(v, int) else text(v[0]) if len(v) == 1 else "".join(map(text, v))
    return [{f: said(f, v) for f, v in c.items()} for c in shape]


def parse_cards(html: str | None) -> list[dict]:
    if not html or "dealtype-deal" not in html and "&" not in html:  # a reference might spell the class
        return []
    cards = _plain(html)
    if cards is None:
        parser = _Cards()
        parser.feed(html)
        parser.close()
        cards = parser.cards
    return cards


def raw_cards(html: str | Column) -> Column:
    """array<struct> of a page's cards; null or none: empty."""

    @F.arrow_udf(f"array<{RAW_CARD}>")
    def run(pages: pa.Array) -> pa.Array:
        found = [parse_cards(p) for p in pages.to_pylist()]
        ends = [0]
        for cards in found:
            ends.append(ends[-1] + len(cards))
        columns = [pa.array([c.get(f) for cards in found for c in cards], pa.string()) for f in FIELDS]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=list(FIELDS)))

    return run(html)


OLD_NEW = r"(\d+(?:[.,]\d{2}|\.[–-]))\s+statt\s+(\d+(?:[.,]\d{2}|\.[–-]))"


def cards(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """A row per card that has a title and a sale price (in the description if nowhere else), with its numbers read."""
    c = pages.select(*keep, F.explode(raw_cards(html)).alias("c")).select(*keep, "c.*").withColumn("description", F.coalesce("description", F.lit("")))
    new, said = units.price(F.col("price_new")), F.col("description").rlike(OLD_NEW)
    part = lambda k: units.price(F.regexp_extract("description", OLD_NEW, k))
    fallback = new.isNull() & said
    dates = units.described_range(F.col("description"))
    out = c.select(
        *keep, "name", "description", F.coalesce(new, F.when(said, part(1))).alias("sale_price"), F.coalesce(units.price(F.col("price_old")), F.when(fallback, part(2))).alias("original_price"), units.percent(F.col("price_discount")).alias("discount_percent"),
        "date_text", dates["a"].alias("valid_from_desc"), dates["b"].alias("valid_to_desc"), units.described_quantity(F.col("description")).alias("quantity_info"), units.described_unit_price(F.col("description")).alias("unit_price_info"), "href", "image_url",
    )
    return out.filter((F.length("name") > 0) & F.col("sale_price").isNotNull())


def to_html(deals: DataFrame) -> DataFrame:
    """A page of one card for each deal (deal_id, html), for tests and round trips."""
    tag = lambda open_, c, close: F.concat(F.lit(open_), c, F.lit(close))
    text = F.replace(F.replace(F.col("product_name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(
        tag('<div class="card dealtype-deal"><a href="/d/', F.col("deal_id"), '"></a><div class="card-image"><img src="x.png"></div>'), tag('<h3 class="card-title">', text, "</h3>"), tag('<span class="price-new">', units.money(F.col("sale_price")), "</span>"),
        tag('<span class="price-old">', units.money(F.col("original_price")), "</span>"), tag('<span class="price-discount">', F.col("discount_percent").cast("string"), "%</span>"),
        tag('<p class="card-date">', F.concat_ws(" - ", F.date_format("valid_from", "dd.MM.yyyy"), F.date_format("valid_to", "dd.MM.yyyy")), "</p></div>"),
    )
    return deals.select("deal_id", F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))
