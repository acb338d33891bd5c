"""Vector codes and resampling against SQL and plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from larder.llm import codes, resample
from larder.llm import queries as Q


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_resample"])
def test_against_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = Q.queries()[name](spark, sf_dir), duck.sql(Q.oracle_sql()[name])
    assert Counter(map(tuple, df.select(*want.columns).collect())) == Counter(want.fetchall()) and df.count() > 0


def test_bounds_lose_no_nearest_entry():
    rng = np.random.default_rng(1)
    for width, spread in ((1, 3), (3, 2), (4, 300), (5, codes.LIMIT - 1), (8, 40)):
        x, book = rng.integers(-spread, spread + 1, (5000, width)), rng.integers(-spread, spread + 1, (64, width))
        book[40] = book[3]  # a tie
        x[7] = book[40]
        index, distance = codes.nearest(x, book)
        every = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def plain_codes(rows, parts, entries, rounds):
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = [[math.floor(256 * x) for x in r[1]] for r in kept]
    w = len(v[0]) // parts
    cut = [[tuple(x[p * w : (p + 1) * w]) for p in range(parts)] for x in v]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        at = [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    if own := [c[p] for c, a in zip(cut, at) if a[p] == e]:
                        books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    errors = [sum(far(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, at)]
    by = Counter()
    for r, e in zip(kept, errors):
        by[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((r[0], "".join(f"{k:02x}" for k in a), e, by[r[2]], sha) for r, a, e in zip(kept, at, errors))


VECTORS = "vec_id long, embedding array<float>, label string, code string, error long, id long, v string, n long, none boolean"


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 8)).astype(np.float32).tolist()
    rows = [(k, x, "ab"[k % 2] if k % 5 else None) for k, x in enumerate(vectors)]
    rows += [rows[3], rows[3], (3, vectors[9], ""), (None, vectors[4], "a"), (None, vectors[5], None), (70, None, "a"), (71, [None] * 8, "a"), (72, [float("nan")] * 8, "b"), (73, [float("inf")] + [0.0] * 7, "b"), (74, [], "b")]
    rows += [(80 + k, [0.0] * 8, "hot") for k in range(40)]
    df = spark.createDataFrame([(*r, "x", 1, 2, "x", 3, True) for r in rows], VECTORS)
    got = codes.compress(df, parts=4, entries=6)
    assert Counter(map(tuple, got.collect())) == plain_codes(rows, 4, 6, 2)
    assert codes.compress(df.limit(0)).collect() == [] and codes.compress(df.filter("vec_id = 70"), parts=4).columns == got.columns
    with pytest.raises(Exception, match="not within"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, "a", None, None, None, None, None, None)], VECTORS), parts=4).collect()
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(df)
    some, dims = codes.whole(df, "embedding", id="vec_id")
    books = codes.train(some, dims, 4, 6, 2)
    near = {r["id"]: codes.decode(r["code"], books) for r in codes.encode(some, dims, books).collect()}
    assert np.abs(near[0] - vectors[0]).mean() < np.abs(np.array(vectors)).mean()


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(rows, target, runs=(1, 1), percent=10, least=20, buckets=10_000, seed=2024):
    def features(text):
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return len(w), Counter(zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(runs[0], runs[1] + 1) for i in range(len(w) - n + 1))

    held = [(k, *features(t)) for k, t in rows]
    s, t = sum((c for _, _, c in held), Counter()), sum((features(x)[1] for x in target), Counter())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for k, n_words, c in held:
        weight = sum(n * gain(b) for b, n in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, n_words, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        rank.setdefault(r, []).append(place)
    return Counter((*r, rank[r].pop(0) if rank.get(r) else None) for r in out)


DOCS = "doc_id long, text string, lang string, weight string, score string, c0 string, block string, row string, words string, t string"


def documents():
    words = "Ana über naïve 12 re-do the The THE x_y 日本 a\x00b tail Éa".split(" ")
    texts = [" ".join(words[(k * 7 + j * (k + 1)) % len(words)] for j in range(k * 3)) for k in range(30)] + [None, "", " \n\t-+", "a" * 100_000, "one " * 25, "the " * 50_000, "é" * 33 + " " + "b" * 64 + " " + "c" * 65]
    rows = [*enumerate(texts), (3, texts[20]), (3, texts[20]), (None, texts[25]), (None, texts[25]), (None, None), *((900, texts[29]) for _ in range(30))]
    return rows, [None, "", "the naïve tail " * 30, "12 12"]


@pytest.mark.parametrize(("runs", "percent"), [((1, 1), 10), ((1, 2), 55), ((3, 3), 100), ((1, 1), 0)])
def test_resampling_of_odd_rows(spark, runs, percent):
    rows, target = documents()
    df = spark.createDataFrame([(*r, "en", "w", "s", "c", "b", "r", "w", "t") for r in rows], DOCS).repartition(3)
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = resample.resample(df, goal, runs=runs, percent=percent, keep=("lang", "text", "weight", "c0"))
    assert got.columns == ["doc_id", "lang", "text", "c0", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == plain_resample(rows, target, runs, percent)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(rows)


def test_resampling_of_nothing(spark):
    rows, target = documents()
    df, goal = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], DOCS), spark.createDataFrame([], "text string")
    assert resample.resample(df.limit(0), goal).collect() == []
    got = resample.resample(df, goal)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == plain_resample(rows, [])


def test_crc_of_ranges():
    rng = np.random.default_rng(2)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4800, 300)
    ends = starts + rng.integers(0, 200, 300)
    assert resample.crc32(buf, starts, ends).tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(starts, ends)]
