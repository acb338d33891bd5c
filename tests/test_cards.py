"""The pattern for plain tags reads pages as the standard library's parser does, and leaves it the others."""

import random

from larder.sources import cards

CARD = '<div class="card dealtype-deal"><a href="/d/1"></a><div class="card-image"><img src="x.png"></div><h3 class="card-title">Brie &amp; Co</h3><span class="price-new">1.50</span><p class="card-date">a<br>b</p></div>'
PIECES = [
    CARD, "<DIV CLASS=\"card dealtype-deal\">", '<div class="dealtype-deal card x">', "</div>", "<div>", "</p>", "<p>", '<a href="/d/2">', "</a>", "<br/>", "<br>", '<h3 class="card-title">', "</h3>", "text", " ", "a &lt; b", "&amp", "1 < 2", "<",
    ">", "<!-- <div> -->", "<!doctype html>", '<script>if (a < b) "</div>"</script>', "<style>", "<textarea>", "</textarea>", "<title>", "</title>", "<div class=card>", "<a href='/q'>", '<a href="/x?a=1&amp;b=2">', "<a href>", '<span class="price-new price-old">', '<p class="card-description">', "</span>", '<div class="card-image">', '<img src="y.png">',
    '<span class="a" class="price-old">', '<div class="card dealtype&#45;deal">', "é ", "\n", "</ div>", "<1>", '<b title="x">', "<svg:g>", "</b >",
]


def whole(html):
    parser = cards._Cards()
    parser.feed(html)
    parser.close()
    return parser.cards


def test_plain_pages_are_read_alike():
    r, plain = random.Random(5), 0
    for _ in range(4000):
        html = "".join(r.choices(PIECES, k=r.randint(1, 14)))
        read = cards._plain(html)
        plain += read is not None and len(read) > 0
        assert read is None or read == whole(html), html
        assert cards.parse_cards(html) == whole(html), html
    assert plain > 20


def test_the_parser_is_left_pages_that_are_not_plain(monkeypatch):
    fed = []
    monkeypatch.setattr(cards._Cards, "feed", lambda self, html: fed.append(html))
    assert cards.parse_cards(CARD)[0]["name"] == "Brie & Co" and not fed
    cards.parse_cards(CARD + "<!-- x -->")
    assert len(fed) == 1


def test_pages_alike_share_their_shape():
    cards._shape.cache_clear()
    pages = [CARD.replace("/d/1", f"/d/{k}").replace("1.50", f"{k}.50") for k in range(9)]
    assert [(c["href"], c["price_new"]) for p in pages for c in cards.parse_cards(p)] == [(f"/d/{k}", f"{k}.50") for k in range(9)]
    assert cards._shape.cache_info().misses == 1
