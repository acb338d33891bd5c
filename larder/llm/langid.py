"""Language identification of words and documents by a linear-chain conditional random field.

A word is a run of letters of the lower-cased text (in UTF-8: a-z and every byte from 0x80). Its features are its first and
last one to three bytes, the byte trigrams with its edges, and its entry in a lexicon of words seen twice or more in
training; transitions between labels are learned with them. Training is by gradient ascent on the conditional likelihood
(forward-backward) over a bounded sample: at most DOCS_PER_LANG labelled rows a language (per_lang), of each SPAN consecutive
words (span) from a place that a hash of the id chooses, words cut at WORD_CHARS, put together to sequences of several spans
so that switches between languages are seen. Only these spans go to the driver, whatever the length or number of the rows. Forward-backward over a whole document gives every word its label probabilities; their mean is the document's, the
largest its language and score.

Text null or without a letter: `und`, score 0. Without any labelled row: `und` for all. Ties go to the alphabetically
first language. Id, source and label of a document are never inputs of its prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .common import blocks, fresh

DOCS_PER_LANG, SPAN, WORD_CHARS, EPOCHS = 240, 60, 64, 30
TRIGRAM_BITS, AFFIX_BITS, LEXICON_BITS = 14, 12, 15
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


@dataclass
class Features:
    """Of the words of a block: trigram ids with the word each starts at, six affix ids, hashes."""

    trigrams: np.ndarray
    first: np.ndarray
    counts: np.ndarray
    affixes: list[np.ndarray]
    hashes: np.ndarray
    bounds: np.ndarray


def features(texts: list[str]) -> Features:
    buf, at = K.pack([t.lower().encode("utf-8", "replace") for t in texts])
    buf = _FOLD[buf]
    starts, ends, bounds = K.words(buf, at)
    wide = np.concatenate(([32], buf, [32])).astype(np.uint32)
    code = ((wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1]) * np.uint32(0x85EBCA6B) + wide[2:]) * np.uint32(0xC2B2AE35)
    inside = buf != 32
    tri = (code >> np.uint32(32 - TRIGRAM_BITS))[inside].astype(np.int64)
    n = ends - starts
    prefix = K.prefix_hashes(buf)
    shift = np.uint64(64 - AFFIX_BITS)
    affixes = [(K.ranges(prefix, starts, np.minimum(starts + k, ends)) >> shift).astype(np.int64) for k in (1, 2, 3)]
    affixes += [(K.ranges(prefix, np.maximum(ends - k, starts), ends) >> shift).astype(np.int64) for k in (1, 2, 3)]
    return Features(tri, np.cumsum(n) - n, n, affixes, K.ranges(prefix, starts, ends), bounds)


def forward_backward(potential: np.ndarray, trans: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every position, and the summed expectations of label pairs.

    potential: positive scores (positions x labels). Sequences lie at start, of the given lengths; all advance together.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences longer than t
    alpha, beta = np.empty_like(potential), np.empty_like(potential)
    pairs = np.zeros_like(trans)
    a = None
    for t in range(steps):
        at = start[: active[t]] + t
        a = potential[at] if t == 0 else (a[: active[t]] @ trans) * potential[at]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[at] = a
    b = None
    for t in range(steps - 1, -1, -1):
        at = start[: active[t]] + t
        now = np.ones((len(at), trans.shape[0]), dtype=potential.dtype)
        if t + 1 < steps and active[t + 1]:
            nxt = potential[at[: active[t + 1]] + 1] * b
            back = nxt @ trans.T
            weight = alpha[at[: active[t + 1]]]
            z = (weight * back).sum(axis=1, keepdims=True)
            pairs += trans * ((weight / z).T @ nxt)
            now[: active[t + 1]] = back / back.sum(axis=1, keepdims=True)
        b = now
        beta[at] = b
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True), pairs


@dataclass
class Model:
    langs: list[str]
    trigram: np.ndarray = field(default=None)
    affix: list[np.ndarray] = field(default_factory=list)
    lexicon: np.ndarray = field(default=None)  # hash held by each slot
    lexical: np.ndarray = field(default=None)  # weights, the last row for words outside
    bias: np.ndarray = field(default=None)
    trans: np.ndarray = field(default=None)  # log

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
        return np.where(self.lexicon[slot] == hashes, slot, len(self.lexicon))

    def scores(self, f: Features) -> np.ndarray:
        out = self.bias + self.lexical[self.slots(f.hashes)]
        for w, ids in zip(self.affix, f.affixes):
            out = out + w[ids]
        if len(f.first):
            out = out + np.add.reduceat(self.trigram[f.trigrams], f.first, axis=0)
        return out

    def word_probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all words, and where each text's words begin."""
        f = features(texts)
        e = self.scores(f)
        e = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12) if len(e) else e.astype(np.float32)
        length = np.diff(f.bounds)
        some = length > 0
        p, _ = forward_backward(e, np.exp(self.trans).astype(np.float32), f.bounds[:-1][some], length[some])
        return p, f.bounds

    def label(self, text: str) -> list[str]:
        """The language of each word of a code-switched text."""
        p, _ = self.word_probabilities([text])
        return [self.langs[k] for k in p.argmax(axis=1)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        p, bounds = self.word_probabilities(texts)
        total = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(p, axis=0, dtype=np.float64)])
        out = []
        for k, text in enumerate(texts):
            n = int(bounds[k + 1] - bounds[k])
            if not n or not LETTER.search(text):
                out.append((UNKNOWN, 0.0))
                continue
            mean = (total[bounds[k + 1]] - total[bounds[k]]) / n
            best = int(mean.argmax())
            out.append((self.langs[best], float(min(1.0, max(0.0, mean[best])))))
        return out


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, span: int = SPAN, seed: int = 7, rate: float = 0.15, decay: float = 1e-5) -> Model | None:
    """A model of (text, language) rows, by Adam on the conditional log-likelihood."""
    rows = sorted((t, lang) for t, lang in rows if t and lang is not None and LETTER.search(t))
    if not rows:
        return None
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    spans, labels = [], []
    for text, lang in rows:
        words = text.split()
        at = int(rng.integers(0, max(1, len(words) - span)))
        piece = " ".join(words[at : at + span])
        if not LETTER.search(piece):
            piece = text
        spans.append(piece)
        labels.append(langs.index(lang))
    # sequences of four spans: the rows in order of language, shuffled, so that some neighbours differ
    order = rng.permutation(len(spans))
    f = features([spans[k] for k in order])
    n_words = np.diff(f.bounds)
    gold = np.repeat(np.array([labels[k] for k in order]), n_words)
    cut = f.bounds[:-1][::4]
    length = np.diff(np.append(cut, f.bounds[-1]))
    ends = np.zeros(len(gold), dtype=bool)
    ends[cut[length > 0]] = True
    cut, length = cut[length > 0], length[length > 0]

    n_langs = len(langs)
    lexicon = np.zeros(1 << LEXICON_BITS, dtype=np.uint64)
    known, counts = np.unique(f.hashes, return_counts=True)
    for h in known[counts >= 2][np.argsort(counts[counts >= 2], kind="stable")]:  # the most frequent is written last and stays
        lexicon[int(h >> np.uint64(64 - LEXICON_BITS))] = h
    zeros = lambda n: np.zeros((n, n_langs))
    model = Model(langs, zeros(1 << TRIGRAM_BITS), [zeros(1 << AFFIX_BITS) for _ in range(6)], lexicon, zeros(len(lexicon) + 1), np.zeros(n_langs), np.zeros((n_langs, n_langs)))
    slots = model.slots(f.hashes)
    word_of = np.repeat(np.arange(len(gold)), f.counts)
    scatter = lambda ids, d, size: np.stack([np.bincount(ids, weights=d[:, k], minlength=size) for k in range(n_langs)], axis=1)
    seen = zeros(n_langs)  # gold label pairs within sequences
    inner = ~ends[1:]
    np.add.at(seen, (gold[:-1][inner], gold[1:][inner]), 1)
    params = [model.trigram, *model.affix, model.lexical, model.bias, model.trans]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = len(gold)
    for step in range(1, epochs + 1):
        e = model.scores(f)
        p, pairs = forward_backward(np.exp(e - e.max(axis=1, keepdims=True)) + 1e-12, np.exp(model.trans), cut, length)
        d = -p
        d[np.arange(total), gold] += 1
        grads = [scatter(f.trigrams, d[word_of], len(model.trigram)), *(scatter(ids, d, len(w)) for ids, w in zip(f.affixes, model.affix)), scatter(slots, d, len(model.lexical)), d.sum(axis=0), seen - pairs]
        grads[7][-1] = 0
        for k, g in enumerate(grads):
            g = g / total - decay * params[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    for k, w in enumerate(model.affix):
        model.affix[k] = w.astype(np.float32)
    model.trigram, model.lexical = model.trigram.astype(np.float32), model.lexical.astype(np.float32)
    return model


def sample(df: DataFrame, text: str, lang: str, id_col: str, learn: Column, per_lang: int = DOCS_PER_LANG, span: int = SPAN) -> list[tuple[str, str]]:
    """(span of words, language) of at most per_lang labelled rows a language, chosen by a hash of the id before any text is looked at."""
    labelled = df.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text).alias("_t"), F.col(lang).alias("_lang"))
    first = lambda rows, *more: rows.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id", *more))).filter(F.col("_n") <= per_lang).drop("_n")
    chosen = first(labelled.select("_id", "_lang")).distinct()  # at most per_lang rows a label value
    rows = labelled.join(F.broadcast(chosen.withColumnsRenamed({"_id": "_i", "_lang": "_l"})), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_lang") == F.col("_l")), "left_semi")
    words = F.filter(F.split("_t", r"[\s]+"), lambda w: w != "")
    at = F.pmod(F.xxhash64("_id"), F.greatest(F.size("_w") - span + 1, F.lit(1))) + 1
    spans = rows.select("_id", "_lang", words.alias("_w")).select("_id", "_lang", F.array_join(F.transform(F.slice("_w", at.cast("int"), F.lit(span)), lambda w: F.left(w, F.lit(WORD_CHARS))), " ").alias("_s"))
    return [(r["_s"], r["_lang"]) for r in first(spans, "_s").select("_s", "_lang").collect()]  # an id may have many rows: again per_lang at most


def held_out(id_col: str = "doc_id", of: int = 4, rest: int = 2) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of == rest


def identify(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", learn: Column | None = None, per_lang: int = DOCS_PER_LANG, span: int = SPAN, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with columns pred and score."""
    spark = df.sparkSession
    learn = F.lit(True) if learn is None else learn
    model = train(sample(df, text, lang, id_col, learn, per_lang, span), span=span)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            texts = [t or "" for t in texts]
            out = []
            for lo, hi in blocks((len(t) for t in texts), 1 << 21):
                out += model.predict(texts[lo:hi]) if model else [(UNKNOWN, 0.0)] * (hi - lo)
            yield pd.DataFrame(out, columns=["lang", "score"])

    (said,) = fresh(df, "__said")
    return df.withColumn(said, run(F.col(text))).withColumns({pred: F.col(said)["lang"], score: F.col(said)["score"]}).drop(said)
