"""Personal data in texts: e-mail addresses, IP addresses, card and phone numbers, by fixed patterns and a skip-chain CRF.

Base spans are the matches of each kind's pattern, leftmost and not overlapping, that pass its test. They always stay. The
model adds spans that the patterns miss: a number written another way than where it was first given, an address with its at
sign spelt out. It labels tokens: the base spans, and whatever else looks like an address or a long number (the candidates).
All other words can't be personal data here, so they are observed to be none, and what they say about their neighbours
(transitions) is a constant of these. Tokens side by side share transition potentials. Tokens that repeat or resemble each
other (equal once separators are gone; equal in their last DIGITS digits) share potentials however far apart they stand:
each such group has a variable of its own to which its tokens are linked, so n tokens make n links, not n^2. Sum-product messages go
round ROUNDS times over the whole document, and a candidate gets a label when its probability reaches SURE and a base span of
that kind is in one of its groups (or its at sign is spelt out, which needs no other mention): a text that gives the model
nothing to go by is left alone.

Training: at most PER_KIND different mentions of each kind (and as many candidates of none), those of smallest digest in the
whole corpus, with CONTEXT characters at both sides, are put together to short texts; some mentions occur again there in
another writing, and other writings of mentions that the text does not hold are labelled as none. So the patterns are the
teacher, and what is learned is how far a mention vouches for its other writings. The gradient is that of the beliefs.

Places are code points, ends exclusive. Null text counts as empty: no spans. Any length is read whole; the work on a text
grows with its length, since no pattern looks twice at a run of characters. Rows are independent but for the model: repeats,
null ids and empty tables need no care. Without any base span in the corpus there is no model, and nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh
from .windows import binary

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
PER_KIND, CONTEXT, DIGITS, ROUNDS, SURE = 200, 24, 7, 8, 0.7
EPOCHS, RATE, DECAY, HIDDEN, FEATURE_BITS = 200, 0.1, 1e-4, 0.2, 12
SALTS = 64

# The characters and patterns of the four kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Other writings: an address with a spelt or spaced at sign, four small numbers, a number of groups.
MAIL_LIKE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)+", re.IGNORECASE)
QUAD_LIKE = re.compile(r"[0-9]{1,3}(?: ?[.,_-] ?[0-9]{1,3}){3}(?!\w)")
NUMBER_LIKE = re.compile(r"[0-9](?:[ ()./_-]{0,2}+[0-9])*+")
ANY_DIGIT, DIGIT_RUN, NO_DIGIT, WORDS = re.compile(r"[0-9]"), re.compile(r"[0-9]+"), re.compile(r"[^0-9]+"), re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The base spans of each kind, in order."""
    if not ANY_DIGIT.search(text):
        return [emails(text), [], [], []]
    ips = [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    cards = [m.span() for m in CARD.finditer(text) if 13 <= len(d := NO_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15] if "+" in text else []
    return [emails(text), ips, cards, phones]


@dataclass
class Token:
    start: int
    end: int
    kind: int  # of the base span, or NONE
    like: str
    features: list[int]
    keys: list[tuple[int, str]]  # (0 equal or 1 similar, what is equal)
    spelt: bool  # an address whose at sign is a word in brackets


def _bin(*what: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(what).encode("utf-8", "replace"), digest_size=4).digest()) >> (32 - FEATURE_BITS)


def _side(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else c if c < "\x80" else "other"


def token(text: str, start: int, end: int, kind: int, like: str) -> Token:
    s = text[start:end]
    digits = NO_DIGIT.sub("", s)
    plain = re.sub(r"[(\[]dot[)\]]", ".", re.sub(r"[(\[]at[)\]]", "@", s.lower())).replace(" ", "")
    words = (WORDS.findall(text[max(0, start - CONTEXT) : start])[-1:] or [""]) + (WORDS.findall(text[end : end + CONTEXT])[:1] or [""])
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", s))[:CONTEXT]
    bare, spelt = like == "quad" or kind == 1, like == "mail" and "@" not in s
    marks = "".join(sorted({c for c in s if not c.isalnum()}))
    features = [
        _bin("kind", kind), _bin("like", like), _bin("kind, like", kind, like), _bin("shape", shape), _bin("digits", min(len(digits), 20), like), _bin("marks", marks[:8], like),
        _bin("luhn", 13 <= len(digits) <= 19 and luhn(digits), like), _bin("before", _side(text[start - 1 : start] if start else "")), _bin("after", _side(text[end : end + 1])),
        _bin("previous", words[0].lower()), _bin("next", words[1].lower()), _bin("spelt", spelt),
    ]
    if like == "mail":
        keys = [(0, "mail " + plain)]
    elif bare:
        keys = [(0, "quad " + ".".join(str(int(x)) if len(x) <= 3 else x for x in re.findall(r"[0-9]+", s)))]
    else:
        keys = [(0, "digits " + digits), (1, "last " + digits[-DIGITS:])] if len(digits) >= DIGITS else [(0, "digits " + digits)]
    return Token(start, end, kind, like, features, keys, spelt)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of DIGITS to 19 digits in groups, with the signs before them, that touch no word."""
    at = 0
    while m := NUMBER_LIKE.search(text, at):
        start, at = m.span()
        n = len(NO_DIGIT.sub("", m[0]))
        if start and _word(text[start - 1]):
            at = DIGIT_RUN.match(text, start).end()  # the groups after it may stand alone
            continue
        if DIGITS <= n <= 19 and not (at < len(text) and _word(text[at])):
            while start > max(0, m.start() - 2) and text[start - 1] in "+(":
                start -= 1
            yield start, at


def tokens(text: str, spans: list[list[tuple[int, int]]]) -> list[Token]:
    """Base spans, and candidates that overlap neither these nor each other, by their places."""
    held = [(s, e, k, ("mail", "quad", "number", "number")[k]) for k, own in enumerate(spans) for s, e in own]
    more: list[tuple[int, int, int, str]] = []
    if "@" in text or "(at)" in (low := text.lower()) or "[at]" in low:
        more += [(*m.span(), NONE, "mail") for m in MAIL_LIKE.finditer(text)]
    if ANY_DIGIT.search(text):
        more += [(*m.span(), NONE, "quad") for m in QUAD_LIKE.finditer(text) if not m.start() or not (_word(c := text[m.start() - 1]) or c == ".")]
        more += [(*at, NONE, "number") for at in numbers(text)]
    more.sort(key=lambda c: (c[0], c[3] == "number"))
    free, covered = [], sorted((s, e) for s, e, _, _ in held)
    end, k, reach = 0, 0, 0
    for c in more:
        while k < len(covered) and covered[k][0] < c[1]:
            reach, k = max(reach, covered[k][1]), k + 1
        if c[0] >= end and c[0] >= reach:
            free.append(c)
            end = c[1]
    return [token(text, *c) for c in sorted(held + free)]


@dataclass
class Graph:
    """Tokens of some texts: their features, neighbours that touch, and links to the variables of their groups."""

    features: np.ndarray  # n x features of a token
    left: np.ndarray  # of a pair of neighbours
    right: np.ndarray
    alone_left: np.ndarray  # whether a word that is no token stands before, after
    alone_right: np.ndarray
    member: np.ndarray
    group: np.ndarray
    similar: np.ndarray
    n_groups: int


def graph(texts: list[list[Token]]) -> Graph:
    rows = [t.features for own in texts for t in own]
    pairs, groups, first = [], {}, 0
    for d, own in enumerate(texts):
        pairs += [first + k for k in range(len(own) - 1) if 0 <= own[k + 1].start - own[k].end <= 2]
        for k, t in enumerate(own):
            for key in t.keys:
                groups.setdefault((d, *key), []).append(first + k)
        first += len(own)
    links = [(g, m, key[1]) for g, (key, own) in enumerate((key, own) for key, own in groups.items() if len(own) > 1) for m in own]
    left = np.array(pairs, dtype=np.int64)
    alone_left, alone_right = np.ones(len(rows)), np.ones(len(rows))
    alone_left[left + 1] = 0
    alone_right[left] = 0
    link = np.array(links, dtype=np.int64).reshape(-1, 3)
    return Graph(np.array(rows, dtype=np.int64).reshape(len(rows), len(rows[0]) if rows else 0), left, left + 1, alone_left, alone_right, link[:, 1], link[:, 0], link[:, 2], int(link[-1, 0]) + 1 if len(link) else 0)


def _norm(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True) if len(x) else x
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True)) if len(x) else x


def _through(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Messages of states x through log potentials (a table for all, or one for each)."""
    top = x.max(axis=1, keepdims=True) if len(x) else x
    p = np.exp(x - top)
    out = p @ np.exp(table) if table.ndim == 2 else np.einsum("el,elh->eh", p, np.exp(table))
    return _norm(np.log(out + 1e-300))


def _gather(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=x[:, k], minlength=n) for k in range(x.shape[1])], axis=1) if len(at) else np.zeros((n, x.shape[1]))


@dataclass
class Model:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # equal or similar x labels x labels of the group

    def beliefs(self, g: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log label probabilities of the tokens; probabilities of each pair of neighbours and of each link."""
        n, m = len(g.features), len(self.chain)
        own = self.unary[g.features].sum(axis=1) if n else np.zeros((0, m))
        own = own + g.alone_left[:, None] * self.chain[NONE] + g.alone_right[:, None] * self.chain[:, NONE]
        table = self.skip[g.similar]
        back = table.transpose(0, 2, 1)
        to_group, from_group = np.zeros((len(g.member), m)), np.zeros((len(g.member), m))
        ahead, behind = np.zeros((len(g.left), m)), np.zeros((len(g.left), m))
        state, groups = own, np.zeros((g.n_groups, m))
        for _ in range(ROUNDS if len(g.member) or len(g.left) else 0):
            to_group = _through(state[g.member] - from_group, table)
            groups = _gather(g.group, to_group, g.n_groups)
            new = _through(groups[g.group] - to_group, back)
            ahead, behind = _through(state[g.left] - behind, self.chain), _through(state[g.right] - ahead, self.chain.T)
            from_group = new
            state = own + _gather(g.member, from_group, n) + _gather(g.right, ahead, n) + _gather(g.left, behind, n)
        joint = lambda a, b, t: np.exp(_norm((a[:, :, None] + b[:, None, :] + t).reshape(len(a), m * m))).reshape(len(a), m, m)
        links = joint(state[g.member] - from_group, groups[g.group] - to_group, table)
        pairs = joint(state[g.left] - behind, state[g.right] - ahead, self.chain)
        return _norm(state), pairs, links

    def added(self, texts: list[list[Token]]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of the candidates of each text that get a label."""
        some = [any(t.kind == NONE for t in own) for own in texts]
        p = np.exp(self.beliefs(graph([own for own, s in zip(texts, some) if s]))[0])
        out, at = [], 0
        for own, s in zip(texts, some):
            found = []
            vouched = {(t.kind, *key) for t in own if t.kind != NONE for key in t.keys}
            for k, t in enumerate(own if s else ()):
                best = int(p[at + k, :NONE].argmax())
                if t.kind == NONE and p[at + k, best] >= SURE and (t.spelt or any((best, *key) in vouched for key in t.keys)):
                    found.append((best, t.start, t.end))
            at += len(own) if s else 0
            out.append(found)
        return out


def rewritten(kind: int, mention: str, rng: np.random.Generator) -> str:
    """Another writing of a mention, which its pattern does not match."""
    digits = NO_DIGIT.sub("", mention)
    pick = lambda *of: of[int(rng.integers(len(of)))]
    if kind == 0:
        local, _, domain = mention.rpartition("@")
        return pick(f"{local} @ {domain}", f"{local}(at){domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}")
    if kind == 1:
        return pick("-", " . ", "_").join(mention.split("."))
    if kind == 2:
        return pick(".", "/", "_").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    tail = digits[-10:] if len(digits) > 10 else digits[1:]
    return pick(digits, tail, f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"{tail[:3]}-{tail[3:]}")


def training_texts(sample: list[tuple[int, str, str, str]], seed: int = 11) -> list[tuple[list[Token], list[int]]]:
    """Tokens and labels of texts made of sampled mentions: (kind, characters before, mention, characters after)."""
    rng = np.random.default_rng(seed)
    known, other = [s for s in sorted(sample) if s[0] != NONE], [s for s in sorted(sample) if s[0] == NONE]
    out = []
    for k in range(0, 2 * len(known), 2):
        own = [known[i] for i in rng.choice(len(known), size=min(2, len(known)), replace=False)]
        pieces = [(s[1], s[2], s[3], None) for s in own]
        for kind, before, mention, after in own:
            if rng.random() < 0.6:
                pieces.append((before if rng.random() < 0.5 else " ", rewritten(kind, mention, rng), after, kind))
        kind, before, mention, after = known[int(rng.integers(len(known)))]
        if all(mention != s[2] for s in own):  # nothing in the text vouches for it
            lone = (before, rewritten(kind, mention, rng) if kind else mention.replace("@", " @ "), after, NONE)
            pieces += [lone] * int(rng.integers(1, 4))
        if other:
            s = other[int(rng.integers(len(other)))]
            pieces.append((s[1], s[2], s[3], NONE))
        digits = "".join(map(str, rng.integers(0, 10, int(rng.integers(DIGITS, 17)))))
        shapes = (f"{rng.integers(1, 99)} @ {rng.integers(1, 99)}.{rng.integers(10, 99)}", f"20{rng.integers(10, 99)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{rng.integers(10, 29)}.{rng.integers(10, 13)}.20{rng.integers(10, 99)}", digits, f"{digits[:4]}-{digits[4:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}", "-".join(digits[:4]))
        for shape in rng.choice(len(shapes), size=2, replace=False):  # prices, dates, numbers of other things, also more than once
            pieces += [(" ", shapes[shape], " ", NONE)] * int(rng.integers(1, 5))
        text, planted = "", []
        for i in rng.permutation(len(pieces)):
            before, mention, after, label = pieces[i]
            text += before
            planted.append((len(text), len(text) + len(mention), label))
            text += mention + after + "\n"
        found = tokens(text, base_spans(text))
        labels = [t.kind if t.kind != NONE else next((x for s, e, x in planted if x is not None and s <= t.start and t.end <= e), NONE) for t in found]
        out.append((found, labels))
    return out


def train(sample: list[tuple[int, str, str, str]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Model | None:
    """A model of sampled mentions, by Adam on the gradient of the beliefs."""
    texts = training_texts(sample)
    if not texts:
        return None
    rng = np.random.default_rng(len(texts))
    for t in (t for own, _ in texts for t in own):  # some features are hidden, so that none is relied on alone
        t.features = [_bin("hidden") if rng.random() < HIDDEN else f for f in t.features]
    g, gold = graph([t for t, _ in texts]), np.array([x for _, labels in texts for x in labels])
    m = NONE + 1
    groups = np.full(g.n_groups, NONE)  # the group's own label: the first kind among its members
    for at, label in zip(g.group[::-1], gold[g.member[::-1]]):
        groups[at] = label if label != NONE else groups[at]
    model = Model(np.zeros((1 << FEATURE_BITS, m)), np.zeros((m, m)), np.zeros((2, m, m)))
    params = [model.unary, model.chain, model.skip]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one = np.eye(m)
    for step in range(1, epochs + 1):
        logp, pairs, links = model.beliefs(g)
        d = one[gold] - np.exp(logp)
        grads = [np.zeros_like(p) for p in params]
        for j in range(g.features.shape[1]):
            np.add.at(grads[0], g.features[:, j], d)
        np.add.at(grads[1], (gold[g.left], gold[g.right]), 1)
        grads[1] -= pairs.sum(axis=0)
        grads[1][NONE] += (d * g.alone_left[:, None]).sum(axis=0)
        grads[1][:, NONE] += (d * g.alone_right[:, None]).sum(axis=0)
        np.add.at(grads[2], (g.similar, gold[g.member], groups[g.group]), 1)
        np.subtract.at(grads[2], g.similar, links)
        for k, grad in enumerate(grads):
            grad = grad / len(texts) - decay * params[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            params[k] += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return model


def mentions(df: DataFrame, text: str = "text", per_kind: int = PER_KIND) -> list[tuple[int, str, str, str]]:
    """At most per_kind different (kind, before, mention, after) a kind, those of smallest digest, from all texts."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, tuple[str, str, str]]] = [{} for _ in range(NONE + 1)]
        for batch in batches:
            for raw in binary(batch["t"]):
                t = raw.decode("utf-8", "replace")
                for x in tokens(t, base_spans(t)):
                    row = t[max(0, x.start - CONTEXT) : x.start], t[x.start : x.end], t[x.end : x.end + CONTEXT]
                    if len(row[1]) <= 8 * CONTEXT:  # longer ones teach nothing
                        h = int.from_bytes(hashlib.blake2b("\0".join(row).encode(), digest_size=8).digest(), signed=True)
                        best[x.kind][h] = row
            best = [{h: own[h] for h in sorted(own)[:per_kind]} for own in best]
        rows = [(k, h, *row) for k, own in enumerate(best) for h, row in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*rows)) or [()] * 5, (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["kind", "h", "before", "mention", "after"])

    rows = df.filter(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(least, "kind int, h long, before string, mention string, after string").dropDuplicates(["kind", "h"])
    top = lambda rows, *by: rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("n") <= per_kind).drop("n")
    rows = top(top(rows.withColumn("salt", F.pmod("h", F.lit(SALTS))), "kind", "salt"), "kind")
    return [(r["kind"], r["before"], r["mention"], r["after"]) for r in rows.collect()]  # per_kind a kind


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(df: DataFrame, text: str = "text", model: Model | None = None, per_kind: int = PER_KIND) -> DataFrame:
    """df with n_email, n_ip, n_card, n_phone (base spans), base and spans (`kind:start:end`, comma-joined); columns of these names are replaced.

    model: one trained before; otherwise it is trained on df.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or train(mentions(df, text, per_kind)))
    outputs = [f"n_{k}" for k in KINDS]

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            texts = [t or "" for t in texts]
            base = [base_spans(t) for t in texts]
            flat = [[(k, s, e) for k, own in enumerate(spans) for s, e in own] for spans in base]
            more = model.added([tokens(t, spans) for t, spans in zip(texts, base)]) if model else [[] for _ in texts]
            yield pd.DataFrame({**{n: [len(spans[k]) for spans in base] for k, n in enumerate(outputs)}, "base": [joined(f) for f in flat], "spans": [joined(f + m) for f, m in zip(flat, more)]})

    (said,) = fresh(df, "__pii")
    return df.withColumn(said, run(F.col(text))).withColumns({n: F.col(said)[n] for n in (*outputs, "base", "spans")}).drop(said)


def redact(text: str | Column, spans: str | Column = "spans") -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stands for all."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, listed in zip(texts, spans):
            places = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in (listed or "").split(",") if x))
            done, end = [], 0
            for s, e, k in places:
                if s >= end:
                    done += [t[end:s], f"[{k}]"]
                end = max(end, e)
            out.append(None if t is None else "".join([*done, t[end:]]))
        return pd.Series(out, dtype=object)

    return run(text, spans)
