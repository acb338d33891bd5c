"""Language-model scoring: a log-bilinear neural model trained by noise-contrastive estimation, and a unigram base.

Tokens: words (bytes other than white space) of the text with A-Z in lower case, then one end; a null text is empty and has
the end alone. Training tokens are those of the rows that learn.

Counts.  Every training word is counted (per task first, then summed by a 64-bit hash of the word). The base of a text is
the sum of log10((c + 1) / (N + V + 1)).

Model.  Its vocabulary is the training words that occur LEAST times or more, the VOCABULARY most frequent of these at most, the
end, and one open class for all other words. Ids follow frequency, and as many consecutive ids as classes make a class: a
token's probability is that of its class times its own within the class, so that a normalised one costs two sums of the
square root of the vocabulary. The two preceding tokens' vectors, each through its position's matrix, are added to a context
vector; a class's or a token's score is the product with its own vector plus its bias. Training reads every training token once.
Texts are dealt to shards by a hash of text and id and sorted there; their number follows the number of training tokens
(SHARD_TOKENS each, or more where SHARDS are not enough), not the cluster, so the same rows give the same model on any layout
and after any retry. A shard is read as a stream. Each shard runs noise-contrastive estimation, for the class with noise
from the classes' unigram distribution, for the token with noise from its class's, and the shards' parameters are averaged,
weighted by tokens (FAN at a time, in blocks of parameters). Texts are scored by batched matrix products, context vectors with
all class vectors and with those of each token's class; a word of the open class has that class's probability times
(c + 1) / (N' + V' + 1) over the training words outside of the vocabulary, N' and V' being their tokens and types, so that
the probabilities of all words that can follow, one unseen word among them, add up to one.

The HEAVY most frequent words' counts go to all tasks (bounded: 16 bytes a word); counts of rarer words, which are by then
rare in any text's row, come by a join. With no training rows every count is 0, the base is 0 and the model stays as it starts.
Repeated rows are counted as often as they stand; ids may be null (then they learn) or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import blocks, materialize
from .windows import binary

VOCABULARY, LEAST, WIDTH, CONTEXT, BATCH, RATE = 16_382, 4, 16, 2, 2048, 0.05
#: Noise classes of a batch, and noise words of a token.
NOISE, NOISE_WORDS = 32, 1
HEAVY, SHARD_TOKENS, SHARDS = 1 << 17, 1 << 20, 4096
#: Shards whose parameters are added by one task, in two rounds.
FAN = 64
#: Bytes of texts whose tokens are shuffled together.
STEP_BYTES = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(id_col: str = "doc_id", of: int = 7, rest: int = 2) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of == rest


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of the first word of each text (and one past the last)."""
    buf, at = K.pack(texts)
    buf = _LOWER[buf]
    starts, ends, bounds = K.words(buf, at)
    return K.ranges(K.prefix_hashes(buf), starts, ends), bounds


def count_words(texts: DataFrame) -> DataFrame:
    """(w, c): counts of word hashes, and (null, c): the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, size = 0, [], 0

        def flush() -> pa.RecordBatch:
            w = np.concatenate([h for h, _ in held])
            c = np.concatenate([c for _, c in held])
            w, back = np.unique(w, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.bincount(back, weights=c).astype(np.int64))], ["w", "c"])

        for batch in batches:
            all_texts = binary(batch["_t"])
            n += len(all_texts)
            for lo, hi in blocks(map(len, all_texts), 1 << 21):
                held.append(np.unique(word_hashes(all_texts[lo:hi])[0], return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 21:  # bounds memory, whatever the task's share
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], ["w", "c"])

    return texts.select(F.col("_t")).mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Heavy words by hash, with counts; the model's ids: 0 the end, 1 any other word, 2... words."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    ids: np.ndarray  # of the model; 1 if outside
    unigram: np.ndarray  # probabilities of the model's ids
    tokens: int  # N
    types: int  # V
    tail_tokens: int
    tail_types: int
    ends: int

    @property
    def width(self) -> int:
        """Ids of a class."""
        return int(np.ceil(np.sqrt(len(self.unigram))))

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model ids and counts of word hashes; count -1: not heavy."""
        if not len(self.hashes):
            return np.ones(len(h), dtype=np.int64), np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.where(hit, self.ids[at], 1), np.where(hit, self.counts[at], -1)

    def sequence(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the tokens of texts, an end after each; how many each text has; counts of the words as they stand."""
        ids, counts = self.look(h)
        n = np.diff(bounds)
        out = np.zeros(len(h) + len(n), dtype=np.int64)
        out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = ids
        return out, n + 1, counts


def vocabulary(counts: DataFrame, size: int = VOCABULARY, heavy: int = HEAVY, least: int = LEAST) -> Vocabulary:
    words = counts.filter("w is not null")
    total, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.filter("w is null").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # words by quarter octaves of their counts, of which the highest that hold no more than heavy words go to the driver;
    # the model's own words in any case, however many words tie below them
    octave = F.floor(F.log2("c") * 4)
    cut, n = None, 0
    for r in sorted(words.groupBy(octave.alias("o")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["o"]):
        n += r["n"]
        if n > heavy:
            break
        cut = r["o"]
    top = {r["w"]: r["c"] for r in words.filter(F.col("c") >= least).orderBy(F.desc("c"), "w").limit(size).collect()}
    size = len(top)
    if cut is not None:
        top |= {r["w"]: r["c"] for r in words.filter(octave >= cut).collect()}  # bounded by heavy
    top = sorted(top.items(), key=lambda x: (-x[1], x[0]))
    h = np.array([w for w, _ in top], dtype=np.int64).view(np.uint64)
    c = np.array([k for _, k in top], dtype=np.int64)
    ids = np.ones(len(top), dtype=np.int64)
    ids[:size] = 2 + np.arange(len(ids[:size]))
    inside = c[:size]
    unigram = np.concatenate([[ends, total - inside.sum()], inside]).astype(np.float64) + 0.5
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], ids[order], unigram / unigram.sum(), int(total + ends), int(types + (ends > 0)), int(total - inside.sum()), int(types - len(inside)), int(ends))


def contexts(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The two tokens before each (columns: one before, two before); an end stands before a text."""
    first = np.repeat(np.cumsum(n) - n, n)
    at = np.arange(len(ids))
    return np.stack([np.where(at - k >= first, ids[at - k], 0) for k in range(1, CONTEXT + 1)], axis=1)


def class_mass(v: Vocabulary) -> np.ndarray:
    return np.add.reduceat(v.unigram, np.arange(0, len(v.unigram), v.width))


def start(v: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Small vectors, and biases (the last column of a target's or class's vector) that make the model the unigram."""
    rng = np.random.default_rng(seed)
    n, mass = len(v.unigram), class_mass(v)
    small = lambda rows: rng.normal(0, 0.1, (rows, WIDTH)).astype(np.float32)
    return {
        "context": small(n), "target": np.column_stack([small(n), np.log(v.unigram / np.repeat(mass, v.width)[:n]).astype(np.float32)]), "group": np.column_stack([small(len(mass)), np.log(mass).astype(np.float32)]),
        "mix": np.stack([np.eye(WIDTH), 0.5 * np.eye(WIDTH)]).astype(np.float32),
    }


class Noise:
    """Draws classes by their unigram, and words by the unigram of a class."""

    def __init__(self, v: Vocabulary, rng: np.random.Generator) -> None:
        self.rng, self.width, mass = rng, v.width, class_mass(v)
        self.word_cdf, self.class_cdf = np.append(0, np.cumsum(v.unigram)), np.cumsum(mass)
        self.log_word, self.log_class = np.log(v.unigram / np.repeat(mass, v.width)[: len(v.unigram)]).astype(np.float32), np.log(mass).astype(np.float32)

    def classes(self, k: int) -> np.ndarray:
        return np.minimum(np.searchsorted(self.class_cdf, self.rng.random(k)), len(self.class_cdf) - 1)

    def words(self, word: np.ndarray, k: int) -> np.ndarray:
        """k words for each, of its own class."""
        lo = word // self.width * self.width
        hi = np.minimum(lo + self.width, len(self.word_cdf) - 1)
        at = self.word_cdf[lo, None] + self.rng.random((len(word), k)) * (self.word_cdf[hi] - self.word_cdf[lo])[:, None]
        return np.clip(np.searchsorted(self.word_cdf, at, side="right") - 1, lo[:, None], hi[:, None] - 1)


def gradients(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What the squared gradients start with: a number a vector, or a number a number of the positions' matrices."""
    return {name: np.ones(x.shape if name == "mix" else len(x), dtype=np.float32) for name, x in p.items()}


def _step(p: np.ndarray, past: np.ndarray, ids: np.ndarray, rows: np.ndarray, rate: float) -> None:
    """Adds rows to the vectors of their ids, scaled by the length of each vector's gradients so far; only these ids are touched."""
    order = np.argsort(ids.astype(np.int16 if len(p) < 1 << 15 else np.int64), kind="stable")
    ids = ids[order]
    at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    g, one = np.add.reduceat(rows[order], at, axis=0), ids[at]
    so_far = past[one] + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
    past[one] = so_far
    p[one] += g * (np.float32(rate) / np.sqrt(so_far))[:, None]


def _pull(true: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the scores (over noise) of true and noise ones are pulled by."""
    return 1 / (1 + np.exp(np.clip(true, -30, 30))), -1 / (1 + np.exp(np.clip(-other, -30, 30)))


def nce_step(p: dict[str, np.ndarray], past: dict[str, np.ndarray], ctx: np.ndarray, word: np.ndarray, noise: Noise, rate: float = RATE) -> None:
    """One step on a batch: true classes against the batch's noise classes, true words each against a noise word or more of their class. past: squared gradients so far."""
    parts = [p["context"][ctx[:, j]] for j in range(CONTEXT)]
    q = np.ones((len(word), WIDTH + 1), dtype=np.float32)  # the last column meets the biases
    q[:, :WIDTH] = sum(parts[j] @ p["mix"][j] for j in range(CONTEXT))
    own, others = word // noise.width, noise.classes(NOISE)
    k = np.float32(np.log(NOISE))
    true, other = p["group"][own], p["group"][others]
    g_own, g_others = _pull(np.einsum("bw,bw->b", q, true) - noise.log_class[own] - k, q @ other.T - noise.log_class[others] - k)
    drawn = noise.words(word, NOISE_WORDS)
    k = np.float32(np.log(NOISE_WORDS))
    mine, theirs = p["target"][word], p["target"][drawn]
    g_word, g_drawn = _pull(np.einsum("bw,bw->b", q, mine) - noise.log_word[word] - k, np.einsum("bw,bkw->bk", q, theirs) - noise.log_word[drawn] - k)
    dq = (g_own[:, None] * true + g_others @ other + g_word[:, None] * mine + np.einsum("bk,bkw->bw", g_drawn, theirs))[:, :WIDTH]
    mix, back = np.stack([parts[j].T @ dq for j in range(CONTEXT)]), [dq @ p["mix"][j].T for j in range(CONTEXT)]
    every = lambda a, b: np.concatenate([a, b])
    _step(p["group"], past["group"], every(own, others), every(g_own[:, None] * q, g_others.T @ q), rate)
    _step(p["target"], past["target"], every(word, drawn.reshape(-1)), every(g_word[:, None] * q, (g_drawn[:, :, None] * q[:, None]).reshape(-1, WIDTH + 1)), rate)
    _step(p["context"], past["context"], ctx.T.reshape(-1), np.concatenate(back), rate)
    past["mix"] += mix * mix
    p["mix"] += np.float32(rate) * mix / np.sqrt(past["mix"])


def train(texts: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters averaged over the shards of texts (_t, _id), each gone through once."""
    spark = texts.sparkSession
    begin = start(v)
    shapes = [(name, begin[name].shape) for name in sorted(begin)]
    shared = spark.sparkContext.broadcast((v, begin))
    chunk = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, begin = shared.value

        def learn(shard: int, rows: Iterator[list[bytes]]) -> pa.RecordBatch:
            p = {name: begin[name].copy() for name, _ in shapes}
            rng = np.random.default_rng(shard)
            noise = Noise(v, rng)
            past = gradients(p)
            seen = 0
            for texts in rows:
                ids, n, _ = v.sequence(*word_hashes(texts))
                ctx = contexts(ids, n)
                order = rng.permutation(len(ids))
                for a in range(0, len(ids), BATCH):
                    pick = order[a : a + BATCH]
                    nce_step(p, past, ctx[pick], ids[pick], noise)
                    seen += len(pick)
            flat = np.concatenate([p[name].reshape(-1) for name, _ in shapes])
            n = -(-len(flat) // chunk)
            return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([shard // FAN] * n, pa.int32()), pa.array([float(seen)] * n), pa.array([flat[i * chunk : (i + 1) * chunk] for i in range(n)], pa.list_(pa.float32()))], ["part", "salt", "weight", "x"])

        def steps() -> Iterator[tuple[int, list[bytes]]]:
            """(shard, texts) of about STEP_BYTES, cut by the rows alone: batches may end anywhere."""
            held, size, now = [], 0, None
            for batch in batches:
                for shard, text in zip(batch["_shard"].to_pylist(), binary(batch["_t"])):
                    if held and (shard != now or size + len(text) > STEP_BYTES):
                        yield now, held
                        held, size = [], 0
                    held.append(text)
                    size, now = size + len(text), shard
            if held:
                yield now, held

        for shard, rows in groupby(steps(), key=lambda x: x[0]):
            yield learn(shard, (texts for _, texts in rows))

    def add(key, rows):
        """The mean of some shards' parameters, weighted by their tokens."""
        import pandas as pd

        rows = rows.sort_values("weight", kind="stable")
        weight = rows["weight"].to_numpy()
        x = (np.stack(rows["x"].to_numpy()).astype(np.float64) * weight[:, None]).sum(axis=0) / weight.sum()
        return pd.DataFrame({"part": [key[0]], "salt": [0], "weight": [weight.sum()], "x": [x.astype(np.float32)]})

    kind = "part int, salt int, weight double, x array<float>"
    shards = min(SHARDS, max(1, round(v.tokens / SHARD_TOKENS)))
    dealt = texts.select("_t", F.pmod(F.xxhash64("_t", "_id"), F.lit(shards)).cast("int").alias("_shard"), F.xxhash64("_id", "_t").alias("_o"))
    dealt = dealt.repartition(shards, "_shard").sortWithinPartitions("_shard", "_o", "_t").select("_t", "_shard")
    sums = dealt.mapInArrow(run, kind).groupBy("part", "salt").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind)
    rows = sorted(sums.collect(), key=lambda r: r["part"])  # one model
    if not rows:
        return begin
    flat = np.concatenate([np.array(r["x"], dtype=np.float32) for r in rows])
    out, at = {}, 0
    for name, shape in shapes:
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def log_probabilities(p: dict[str, np.ndarray], ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Natural log-probability of each token: of its class, normalised over the classes, and of itself, normalised over its class."""
    n, classes = len(p["target"]), len(p["group"])
    width = int(np.ceil(np.sqrt(n)))
    distinct, back = np.unique(ctx[:, 0] * n + ctx[:, 1], return_inverse=True)
    q = np.ones((len(distinct), WIDTH + 1), dtype=np.float32)
    q[:, :WIDTH] = p["context"][distinct // n] @ p["mix"][0] + p["context"][distinct % n] @ p["mix"][1]

    def logsum(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(len(q), dtype=np.float64)
        for lo in range(0, len(q), 4096):
            s = q[lo : lo + 4096] @ vectors.T
            top = s.max(axis=1, keepdims=True)
            out[lo : lo + 4096] = top[:, 0] + np.log(np.exp(s - top).sum(axis=1, dtype=np.float64))
        return out

    own = word // width
    out = np.einsum("ij,ij->i", q[back], p["group"][own] + p["target"][word]).astype(np.float64) - logsum(q, p["group"])[back]
    # a context and class once, class by class
    pairs, of = np.unique(own * len(distinct) + back, return_inverse=True)
    at = np.searchsorted(pairs, np.arange(classes + 1) * len(distinct))
    norm = np.empty(len(pairs), dtype=np.float64)
    for c in np.flatnonzero(np.diff(at)):
        norm[at[c] : at[c + 1]] = logsum(q[pairs[at[c] : at[c + 1]] % len(distinct)], p["target"][c * width : (c + 1) * width])
    return out - norm[of]


def score(df: DataFrame, id_col: str = "doc_id", text: str = "text", learn: Column | None = None, size: int = VOCABULARY, heavy: int = HEAVY) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of df."""
    spark = df.sparkSession
    learn = F.lit(True) if learn is None else learn
    base = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), learn.alias("_learn"))
    kind = base.schema["_id"].dataType.simpleString()
    counts = materialize(count_words(base.filter("_learn")), "lm-counts")
    v = vocabulary(counts, size, heavy)
    p = train(base.filter("_learn"), v)
    shared = spark.sparkContext.broadcast((v, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value
        end_known = v.ends > 0
        for batch in batches:
            all_texts = binary(batch["_t"])
            for lo, hi in blocks(map(len, all_texts), 1 << 21):
                h, bounds = word_hashes(all_texts[lo:hi])
                ids, n, c = v.sequence(h, bounds)
                logp = log_probabilities(p, contexts(ids, n), ids) / np.log(10)
                owner = np.repeat(np.arange(hi - lo), n - 1)
                total = lambda o, x: np.bincount(o, weights=x, minlength=hi - lo)
                model = total(np.repeat(np.arange(hi - lo), n), logp)
                # parts that need no count from elsewhere: heavy words and the end
                known = total(owner, c > 0) + end_known
                part = total(owner[c >= 0], np.log10(c[c >= 0] + 1.0)) + np.log10(v.ends + 1.0)
                outside = (c >= 0) & (v.look(h)[0] == 1)
                inner = total(owner[outside], np.log10(c[outside] + 1.0))
                opened = total(owner, ids[np.arange(len(h)) + owner] == 1)
                rest = c < 0
                o, w = owner[rest], h[rest]
                order = np.lexsort((w, o))
                o, w = o[order], w[order]
                at = np.searchsorted(o, np.arange(hi - lo + 1)).astype(np.int32)
                cut = lambda x, t: pa.array(x, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["_id"].slice(lo, hi - lo), batch["_learn"].slice(lo, hi - lo), cut(n.astype(np.int64), pa.int64()), cut(known.astype(np.int64), pa.int64()), cut(part, pa.float64()), cut(model + inner, pa.float64()),
                        cut(opened, pa.float64()), pa.ListArray.from_arrays(pa.array(at), pa.array(w.view(np.int64))),
                    ],
                    ["_id", "_learn", "n", "known", "part", "model", "opened", "rare"],
                )

    schema = f"_id {kind}, _learn boolean, n long, known long, part double, model double, opened double, rare array<long>"
    per = base.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())
    per = materialize(per, "lm-parts")
    rare = per.select("_row", F.explode("rare").alias("w")).groupBy("w", "_row").agg(F.count("*").alias("tf"))
    rare = rare.join(counts.filter("w is not null"), "w").groupBy("_row").agg(F.sum("tf").alias("known_rare"), F.sum(F.col("tf") * F.log10(F.col("c") + F.lit(1.0))).alias("log_rare"))
    norm, tail = float(np.log10(v.tokens + v.types + 1)), float(np.log10(v.tail_tokens + v.tail_types + 1))
    out = per.join(rare, "_row", "left")
    more, logs = F.coalesce("known_rare", F.lit(0)), F.coalesce("log_rare", F.lit(0.0))
    return out.select(
        F.col("_id").alias(id_col), (~F.col("_learn")).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + more).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("part") + logs - F.col("n") * norm).alias("base_score"), (F.col("model") + logs - F.col("opened") * tail).alias("score"),
    )
