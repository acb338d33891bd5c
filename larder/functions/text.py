"""String functions: names, words, slugs, relevance. All are Column -> Column; null gives null unless stated."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import FEED_UNITS, FORM_CHANGING, KNOWN_BRANDS, LETTERS, ORGANIC, QUALIFIERS

#: A word edge of ASCII letters, digits and underscore only: Java's own takes accented letters for part of a word.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
WORD_BREAK = r"[\s·,]+"


def any_contained(text: Column, terms: Iterable[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def first_match(cases: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The value of the first true condition, evaluated in order."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if out is None:
        return default if default is not None else F.lit(None)
    return out.otherwise(default) if default is not None else out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often use names it: plans would copy the expression into each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole_word(text: Column, term: str | Column) -> Column:
    """Whether the first occurrence of term is bounded by non-letters; later occurrences don't count."""
    term = F.lit(term) if isinstance(term, str) else term
    at = F.position(term, text)
    before = F.when(at <= 1, " ").otherwise(F.substr(text, at - 1, F.lit(1)))
    after = F.substr(text, at + F.length(term), F.lit(1))
    letter = lambda c: c.rlike(f"^[{LETTERS}]")
    return (at > 0) & ~letter(before) & ~letter(after)


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"\s+", " ")


def feed_name(c: Column) -> Column:
    """Lower case, single spaces, `6 x 1` as `6x1`, no space before a unit."""
    c = F.regexp_replace(squeeze(F.lower(c)), r"(\d+)\s*x\s*(\d)", "$1x$2")
    return F.regexp_replace(c, rf"(\d)\s*({FEED_UNITS})(?![\p{{L}}\p{{N}}_])", "$1$2")


def stored_name(c: Column) -> Column:
    """Lower case, single spaces, units in one spelling."""
    c = squeeze(F.lower(c))
    for pattern, to in ((rf"{EDGE}(?:liter|litre){EDGE}", "l"), (rf"(\d)gr{EDGE}", "$1g"), (rf"{EDGE}(?:stk|pcs){EDGE}", "stück")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def brand(c: Column) -> Column:
    """The first known brand, in list order, that stands between white space or ends; each part capitalised."""
    title = lambda b: " ".join("-".join(p[:1].upper() + p[1:] for p in w.split("-")) for w in b.split())
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"\s", " "), F.lit(" "))
    return let(spaced, lambda name: first_match([(name.contains(f" {b} "), F.lit(title(b))) for b in KNOWN_BRANDS]))


def organic(c: Column) -> Column:
    return F.lower(c).rlike(rf"{EDGE}(?:{'|'.join(ORGANIC)}){EDGE}")


def slug(c: Column, limit: int = 200) -> Column:
    """Lower case, accents off, other runs than a-z and 0-9 as one dash, one dash off either end."""
    plain = F.translate(F.regexp_replace(F.lower(c), "[̀-ͯ]", ""), ACCENTED, PLAIN)
    return F.left(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(limit))


def capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))


def capitalise_words(c: Column) -> Column:
    """First letter of each word; the rest stays."""
    return F.array_join(F.transform(F.split(c, " "), capitalise), " ")


def title_case(c: Column) -> Column:
    """Words between dashes or white space, capitalised, joined by spaces."""
    return F.array_join(F.transform(F.filter(F.split(c, r"[-\s]+"), lambda w: w != ""), capitalise), " ")


def canonical_name(name: Column, brand_name: Column) -> Column:
    """Name without its leading brand, words capitalised."""
    rest = lambda b: F.when(b.isNotNull() & F.startswith(F.lower(name), F.lower(b)), F.trim(F.substr(name, F.length(b) + 1))).otherwise(name)
    return capitalise_words(let(let(brand_name, rest), lambda r: F.when(r == "", name).otherwise(r)))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), WORD_BREAK), lambda w: w != "")


def keyword_end(kw: Column, name: Column) -> Column:
    """kw (quoted) followed by a space, digit, punctuation or the end."""
    return F.regexp_like(name, F.concat(F.lit(r"\Q"), kw, F.lit(r"\E(?:[\s\d,.)·;!?]|$)")))


def relevance(keyword: Column, product_name: Column) -> Column:
    """0 to 4: how much a name is about a keyword."""
    kw, name = F.lower(keyword), F.lower(product_name)
    ws = words(product_name)
    first, second = F.coalesce(F.get(ws, F.lit(0)), F.lit("")), F.coalesce(F.get(ws, F.lit(1)), F.lit(""))
    edge = lambda w: F.startswith(w, kw) | F.endswith(w, kw)
    changed = F.exists(ws, lambda w: F.startswith(w, kw) & F.substr(w, F.length(kw) + 1).isin(*FORM_CHANGING))
    alone = F.regexp_like(name, F.concat(F.lit(r"(?:^|\s)\Q"), kw, F.lit(r"\E(?:\s|\d|$)")))
    return (
        F.when(changed, 0)
        .when(edge(first), 4)
        .when(edge(second) & first.isin(*QUALIFIERS), 4)
        .when(alone, 3)
        .when(keyword_end(kw, name), 2)
        .when(F.exists(ws, lambda w: F.startswith(w, kw) & (F.length(w) > F.length(kw))), 2)
        .when(F.contains(name, kw), 1)
        .otherwise(0)
    )


def any_term(name: Column, terms: Column) -> Column:
    """Whether any term of an array is contained, without regard to case; null or empty: false."""
    low = F.lower(name)
    return F.coalesce(F.exists(terms, lambda t: F.contains(low, F.lower(t))), F.lit(False))


def signal_line(days: Column) -> Column:
    """A sentence about how long ago something was seen."""
    weeks, months = F.floor(days / 7), F.floor(days / 30)
    return F.when(days < 7, F.lit("this week")).when(days < 28, F.concat(weeks.cast("string"), F.when(weeks == 1, " week ago").otherwise(" weeks ago"))).otherwise(F.concat(F.greatest(F.lit(1), months).cast("string"), F.when(months <= 1, " month ago").otherwise(" months ago")))


def encode_list(ids: Column) -> Column:
    """Ids, percent-encoded, joined by commas."""
    return F.array_join(F.transform(ids, lambda i: F.replace(F.url_encode(i), F.lit("+"), F.lit("%20"))), ",")


def decode_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda i: F.url_decode(i)), lambda i: i != "")
