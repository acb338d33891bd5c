"""The operators against plain versions: on the smallest tables and on rows with every oddity."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import ann, bpe, chat, decontaminate, langid, lm, near, sharding, substring, suffix
from larder.llm import queries as Q

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _h string, spans string, c string, fp string, __kept string, kind string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "er", "the", "in", "on", "at", "é", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def tricky():
    base, other = prose(1, 200), prose(2, 150)
    words = base.split()
    edited = " ".join(words[:100] + ["zzz"] + words[101:])
    texts = [None, "", "   \n\t ", "one two", "one two", base, base, base, edited, other, other.replace(" ", "\n"), base[:700] + other, "a" * 1500, "ab " * 600, prose(3, 4000), prose(3, 4000)[:9000] + " end", "🙂 é " * 200, "123 456 !!!", base.upper()]
    rows = [(k, t, "en" if k % 3 else None, "s", None) for k, t in enumerate(texts)]
    rows += [rows[5], rows[9], (None, base, "en", None, 1), (None, None, None, None, None), (3, prose(4, 30), "de", "s", 2)]
    return [(*r, "x", "x", "x", "x", "x", "x", "x") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(tricky(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def removed(c="removed"):
    return F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])


# --- 1: word windows


def test_substring(spark, sf_dir, docs):
    assert Counter(map(tuple, Q.op1_substring_dedup(spark, sf_dir).collect())) == brute.substring(docs)


def test_substring_odd_rows(odd, none):
    out = substring.deduplicate(odd, batches=3)
    got = out.select("doc_id", "n_words", removed(), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == brute.substring(pairs(tricky()))
    assert set(odd.columns) <= set(out.columns)
    assert substring.deduplicate(none).count() == 0


def test_index_compacts(spark):
    index = substring.FingerprintIndex(spark, fanout=2)
    rows = lambda *xs: spark.createDataFrame([(f, i) for f, i in xs], "fp long, id long")
    assert index.add(rows((1, 1), (2, 1))).count() == 0
    assert [r.fp for r in index.add(rows((2, 2), (3, 2))).collect()] == [2]
    assert [level for level, _ in index.runs] == [1]
    assert sorted(r.fp for r in index.add(rows((1, 3), (3, 3), (9, 3), (9, 4))).collect()) == [1, 3, 9]
    assert [level for level, _ in index.runs] == [1, 0]
    found = index.entries(rows((3, 0)).select("fp"))
    assert sorted(tuple(r) for r in found.collect()) == [(3, 2), (3, 3)]
    index.drop()


def test_index_outlives_a_call(spark):
    """Two batches in two calls lose what one run over both loses, whichever texts repeat over the calls."""
    rows = [(r[0], r[1]) for r in tricky() if r[0] is not None]
    rows += [(100 + k, f"{prose(800 + k, 30)} {t or ''} {prose(900 + k, 30)}") for k, (_, t) in enumerate(rows[:12])]
    rows += [(200, prose(31, 40)), (201, f"new {prose(31, 40)}")]
    index, got = substring.FingerprintIndex(spark), Counter()
    for part in ([r for r in rows if r[0] < 8], [r for r in rows if 8 <= r[0] < 105], [r for r in rows if r[0] >= 105]):
        df = spark.createDataFrame(part, "doc_id long, text string")
        out = substring.deduplicate(df, index=index).select("doc_id", "n_words", removed(), F.sha2("kept", 256)).collect()
        got.update(map(tuple, out))
    assert index.runs and len(index.texts) == 3 and got == brute.substring(rows)
    index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("larder_")]


def test_ids_of_other_types(spark):
    """Words as ids, in their own order; dates too."""
    rows = [(r[0], r[1]) for r in tricky() if r[0] is not None]
    name = lambda k: f"doc-{k:03}é"
    df = spark.createDataFrame([(name(k), t) for k, t in rows] + [(None, rows[5][1])], "doc_id string, text string")
    got = substring.deduplicate(df).select("doc_id", "n_words", removed(), F.sha2("kept", 256)).collect()
    want = brute.substring([*rows, (None, rows[5][1])])
    assert Counter(map(tuple, got)) == Counter({(None if r[0] is None else name(r[0]), *r[1:]): n for r, n in want.items()})
    dated = spark.createDataFrame(rows, "k int, text string").select(F.date_add(F.lit("2020-01-01").cast("date"), "k").alias("doc_id"), "text")
    assert substring.deduplicate(dated).select(F.sum(removed())).first()[0] == sum(r[2] * n for r, n in brute.substring(rows).items())


def test_one_id_of_many_texts(spark):
    """Rows of one id carry their own hashes, not those of all rows of the id: 20,000 rows in pairs, the hot id on half of them."""
    rows = [(7 if k % 2 else 100 + k, prose(k // 2, 16)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = substring.deduplicate(df).select("doc_id", "n_words", removed(), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == brute.substring(rows)


def test_history_is_not_shuffled(spark):
    index = substring.FingerprintIndex(spark)
    batch = lambda ks: spark.createDataFrame([(k, prose(k % 5, 40)) for k in ks], "id long, t string").withColumn("h", F.xxhash64("t"))
    index.remember(batch(range(50)))
    index.remember(batch(range(50, 90)))
    wanted = batch(range(0, 90, 9)).select("id", "h").withColumn("fps", F.array(F.lit(1)))
    for old in index.history():
        plan = old.join(wanted.hint("merge"), ["id", "h"]).select("t")._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("larder_texts_")].splitlines()  # down to the scan of the history
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan and not any("Exchange" in line for line in scan)
    index.drop()


def test_crowd_beyond_the_broadcast(spark, monkeypatch):
    import larder.llm.windows as W

    rows = [(k, f"{prose(100 + k, 20)} {prose(7, 40)} {prose(200 + k, 20)}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(W, "PIECE_CLASSES", 4)
    monkeypatch.setattr(W, "CROWD_ROWS", 0)
    out = suffix.drop_repeats(df, length=100).select("doc_id", F.octet_length("text"), removed(), F.size("removed"), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, out)) == brute.suffix(rows, 100)


def test_crowded_fingerprints_are_cut_into_pieces(spark, monkeypatch):
    import larder.llm.windows as W

    passage = prose(7, 40)
    rows = [(k, f"{prose(100 + k, 20)} {passage} {prose(200 + k, 20)}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substring, "PIECE_CLASSES", 4)
    monkeypatch.setattr(W, "PIECE_CLASSES", 4)
    got = substring.deduplicate(df).select("doc_id", "n_words", removed(), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == brute.substring(rows)
    out = suffix.drop_repeats(df, length=100, passage=160).select("doc_id", F.octet_length("text"), removed(), F.size("removed"), F.sha2("kept", 256), removed("passages")).collect()
    assert Counter(tuple(r)[:5] for r in out) == brute.suffix(rows, 100)
    assert Counter((r[0], r[5]) for r in out) == Counter((k, n) for k, _, n, _, _ in brute.suffix(rows, 160).elements())


def test_no_task_holds_a_crowded_fingerprint(spark, monkeypatch):
    """Passages shorter than a window, and little longer, each in other surroundings."""
    import larder.llm.windows as W

    def bounded(batches):
        for rows in W.grouped(batches):
            if max(Counter(rows["fp"].to_pylist()).values()) > 4:
                raise ValueError("more classes of a fingerprint than a task may hold")
            yield rows

    short, window, long = prose(7, 9), prose(8, 14), prose(9, 25)
    rows = [(k, " ".join([prose(300 + k, 20), short, prose(400 + k, 20), window, prose(500 + k, 20), long, prose(600 + k, 20)])) for k in range(30)]
    rows += [(50, f"{window} {prose(700, 20)} {window}"), (51, " ".join([short] * 9)), (52, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for module in (substring, W):
        monkeypatch.setattr(module, "PIECE_CLASSES", 4)
    for module in (substring, suffix):
        monkeypatch.setattr(module, "grouped", bounded)
    got = substring.deduplicate(df).select("doc_id", "n_words", removed(), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == brute.substring(rows)
    got = suffix.drop_repeats(df, length=100).select("doc_id", F.octet_length("text"), removed(), F.size("removed"), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == brute.suffix(rows, 100)


def test_crowded_windows_come_as_runs(spark, monkeypatch):
    """A frequent passage, whole, cut short and with changed bytes, in many surroundings: exact, with fewer rows than it has windows."""
    import random

    import larder.llm.windows as W

    written: Counter = Counter()

    def counted(df, name):
        out = materialize(df, name)
        written[name] += out.count()
        return out

    materialize = suffix.materialize
    monkeypatch.setattr(suffix, "materialize", counted)
    monkeypatch.setattr(W, "PIECE_CLASSES", 4)
    dice, passage = random.Random(5), prose(7, 60)
    rows = [(k, f"{prose(100 + k, 20)} {passage} {prose(200 + k, 20)}") for k in range(40)]
    for k in range(40, 80):
        a, b = sorted(dice.sample(range(len(passage)), 2))
        c = dice.randrange(len(passage))
        rows.append((k, f"{prose(100 + k, 10)} {dice.choice([passage[a:], passage[:b], passage[:c] + '#' + passage[c + 1 :]])} {prose(200 + k, 10)}"))
    rows += [(80, rows[3][1]), (81, passage * 3), (82, (passage[:70] + "~") * 6), (83, "ab" * 200), (84, "x" + "ab" * 150), (85, passage), (86, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix.drop_repeats(df, length=100, passage=160).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))), removed(), F.size("removed"), F.sha2("kept", 256), removed("passages")).collect()
    assert Counter(tuple(r)[:5] for r in out) == brute.suffix(rows, 100)
    assert Counter((r[0], r[5]) for r in out) == Counter((k, n) for k, _, n, _, _ in brute.suffix(rows, 160).elements())
    assert written["suffix-windows"] + written["suffix-named"] < 40 * (2 * len(passage) - 100 - 160)


# --- 2: neighbours


def exact(rows, k):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    seen = {(i, tuple(v)): (i, v) for i, v in ok}.values()
    out = {}
    for i, q in seen:
        if i % 20 == 0:
            best = sorted(((-(v * q).sum(), j) for j, v in seen if j != i))[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def test_neighbours(spark, sf_dir):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, got = exact(rows, 20), {}
    for r in Q.op2_hilbert_ann(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    recall = [len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(recall) >= 0.9


def test_neighbours_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (20, [2.0, 1.0]), (20, [2.0, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, F.col("id") % 20 == 0, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [20, 1], 20: [0, 1]}
    assert ann.neighbours(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_windows_reach_their_aim(spark, monkeypatch):
    """On clustered vectors windows are a small share and recall is high."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    monkeypatch.setattr(ann, "BLOCK_MIN", 16)
    monkeypatch.setattr(ann, "CELL", 2)
    widths = []
    measure = ann.half_width
    monkeypatch.setattr(ann, "half_width", lambda *a: widths.append(measure(*a)) or widths[-1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, F.col("id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert 2 * widths[0] < 1500
    want = exact(rows, 10)
    assert np.mean([len(got[q] & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    key = ann.hilbert_keys(grid, 3)
    walk = grid[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# --- 3: near duplicates


def test_near(spark, sf_dir, docs):
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in Q.op3_ngram_jaccard(spark, sf_dir).collect()}
    assert got == brute.near(docs)


def test_near_large_group_in_blocks(spark, monkeypatch):
    base = prose(5, 120).split()
    rows = [(k, " ".join(base[:k] + [f"w{k}"] + base[k + 1 :])) for k in range(60)] + [(100 + k, prose(50 + k, 60)) for k in range(5)]
    monkeypatch.setattr(near, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near, "VERIFY_BLOCK", 8)
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in near.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(rows)


def test_near_odd_rows(spark, odd, none):
    rows = near.join(odd).select("doc_id", "class_id", "n_copies", "n_links").collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.class_id, r.n_copies, r.n_links))
    assert by[0] == [(0, 1, 0)] and by[1] == [(1, 1, 0)] and by[2] == [(2, 1, 0)]
    assert {c for k in (5, 6, 7, None) for c in by[k] if c[0] == 5} == {(5, 5, 1)} and by[8][0][0] == 5
    assert by[3][0][:2] in ((3, 2), (3, 1)) and by[4] == [(3, 2, 0)]
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 1 and ids[6] == ids[7] == ids[8] == 0 and ids[9] == 1 and ids[0] == ids[1] == ids[2] == 1 and ids[12] == 1
    assert near.join(none).count() == 0 and near.keep_one(none).count() == 0


def test_one_of_each_class_stays_under_null_and_repeated_ids(spark):
    base = prose(5, 120).split()
    close = [" ".join(base[:k] + [f"w{k}"] + base[k + 1 :]) for k in (20, 50, 80)]
    rows = [(1, prose(60, 50)), (1, prose(61, 50)), (1, prose(61, 50)), (1, close[0]), (2, close[1]), (None, close[2])]
    rows += [(None, prose(62, 50)), (None, prose(63, 50)), (None, prose(63, 50)), (None, prose(64, 50)), (4, prose(64, 50)), (None, None), (1, None)]
    kept = Counter(map(tuple, near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert kept == Counter([(1, prose(60, 50)), (1, prose(61, 50)), (1, close[0]), (None, prose(62, 50)), (None, prose(63, 50)), (4, prose(64, 50)), (None, None), (1, None)])


def test_pruning_keeps_what_may_be_similar():
    least = near.least_matches(16, 96, 0.8, 1e-6)
    assert all(a < b for a, b in zip(least, least[1:])) and least[-1] < 0.8 * 96
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 16, (400, 96), dtype=np.uint16)
    sig[1::2] = np.where(rng.random((200, 96)) < 0.8, sig[::2], sig[1::2])
    a = np.arange(0, 400, 2)
    assert len(near.pruned(sig, a, a + 1)) == 200 and len(near.pruned(sig, a[:-1], a[1:])) == 0


# --- 4: benchmark items


def test_decontaminate(spark, sf_dir, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in Q.op4_decontaminate(spark, sf_dir).collect()}
    norm = decontaminate.normal
    assert {(k, i) for k, t in docs for i, x in items if norm(x) in norm(t)} <= got
    text, item = dict(docs), dict(items)
    for k, i in got:
        assert brute.edits(norm(item[i]), norm(text[k])) <= len(norm(item[i])) * decontaminate.RATE


def test_alignment_finds_all_within_budget():
    rng = random.Random(3)
    rnd = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    items = [b" ".join(rnd(rng.randint(30, 120)).split()) for _ in range(8)]
    index = decontaminate.index([(k, t.decode()) for k, t in enumerate(items)])
    for _ in range(80):
        k = rng.randrange(8)
        it = bytearray(items[k])
        for _ in range(rng.randint(0, int(index.budget[k]) + 3)):
            p = rng.randrange(len(it))
            op = rng.random()
            if op < 0.4:
                it[p] = rng.choice(b"abc")
            elif op < 0.7:
                del it[p]
            else:
                it.insert(p, 97)
        doc = b" ".join((rnd(rng.randint(0, 120)) + bytes(it) + rnd(rng.randint(0, 120))).split())
        got = {i: e for _, i, _, e in decontaminate.matches([doc], index)}
        want = {i: e for i, x in enumerate(index.texts) if (e := brute.edits(x, doc)) <= index.budget[i]}
        assert got == want


def test_decontaminate_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, prose(1, 200)[50:300]), (2, None), (3, ""), (4, "one two"), (5, prose(9, 30)), (5, prose(9, 30))], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find(odd, bench).collect())
    assert got[5, 1] == 2 and got[None, 1] == 1 and got[8, 1] + got[6, 1] == 2 and got[4, 4] == 1 and got[3, 4] == 1 and not any(i in (2, 3, 5) for _, i in got)
    sliced = Counter((r.doc_id, r.item_id) for r in decontaminate.find(odd, bench, limit=4800).collect())
    assert sliced == got
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - len([1 for k, n in Counter(k for k, _ in got.elements()).items() for _ in range(n)])
    assert decontaminate.find(none, bench).count() == 0 and decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


# --- 5: byte pairs


def test_bpe(spark, sf_dir, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for k, t in docs:
        ids = enc.encode_ordinary(t or "")
        want[k, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((t or "").encode())] += 1
    assert Counter(map(tuple, Q.op5_byte_bpe(spark, sf_dir).collect())) == want
    for text in [prose(1, 3000), "x" * 5000, "a  b\n\n c \t d" * 900, "é🙂 ١٢ don't " * 700]:
        assert [i for p in bpe.pieces(text, 100) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_bpe_odd_rows(odd, none):
    out = bpe.tokenize(odd).withColumn("back", bpe.decode(F.col("ids"))).withColumn("list", bpe.unpack(F.col("ids")))
    for r in out.collect():
        assert bytes(r.back) == (r.text or "").encode() and r.n_tokens == len(r.list)
    assert bpe.tokenize(none).count() == 0


# --- 6: language model


def test_lm(spark, sf_dir, docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {k: [*re.findall("[^ \t\n\r\f\v]+", (t or "").translate(low)), None] for k, t in docs}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    c = Counter(w for k, ws in tokens.items() if not out[k] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = Q.op6_lm_score(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert r.score < 0


def test_rare_words_come_by_a_join(odd, none):
    a = {(r.doc_id, r.n_tokens, r.n_known): r for r in lm.score(odd, heavy=4, size=3).collect()}
    b = {(r.doc_id, r.n_tokens, r.n_known): r for r in lm.score(odd, heavy=1 << 12, size=3).collect()}
    assert set(a) == set(b)
    for k in a:
        assert a[k].base_score == pytest.approx(b[k].base_score) and a[k].score == pytest.approx(b[k].score, abs=1e-3)
    assert lm.score(none).count() == 0 and lm.score(odd, learn=F.lit(False)).count() == odd.count()


def test_model_does_not_depend_on_the_layout(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4000)
    df = spark.createDataFrame(docs[:60], "doc_id long, text string")
    a, b = ({r.doc_id: r.score for r in lm.score(x, size=50).collect()} for x in (df.repartition(1), df.repartition(7, "text")))
    assert a == pytest.approx(b, abs=1e-5)  # sums may be rounded in another order


def test_a_sample_is_bounded(spark):
    rows = [(k % 3, "wort " * 500 + "x" * 5000 if k % 2 else f"a word {k} " * 200, "de" if k % 2 else "en") for k in range(60)] + [(None, "un mot " * 90, "fr")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(df, "text", "lang", "doc_id", F.lit(True), per_lang=4, span=20)
    assert Counter(lang for _, lang in got) == {"de": 4, "en": 4, "fr": 4} and all(len(t.split()) == 20 and max(map(len, t.split())) <= langid.WORD_CHARS for t, _ in got)


def test_common_grams_meet_in_parts(monkeypatch):
    items = decontaminate.index([(k, prose(60 + k % 3, 30) + f" {k}") for k in range(30)])
    texts = [decontaminate.normal(f"{prose(5, 40)} {prose(60 + k % 4, 30)} {prose(6, 40)}") for k in range(12)]
    whole = sorted(decontaminate.matches(texts, items))
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    assert whole and sorted(decontaminate.matches(texts, items)) == whole


def test_model_probabilities_add_up():
    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.full(9, 1 / 9), 10, 5, 2, 1, 3)
    p = lm.start(v)
    rng = np.random.default_rng(0)
    for _ in range(50):
        past = lm.gradients(p)
        lm.nce_step(p, past, rng.integers(0, 9, (64, 2)), rng.integers(0, 9, 64), lm.Noise(v, rng))
    ctx = np.array([[3, 4]] * 9)
    assert np.exp(lm.log_probabilities(p, ctx, np.arange(9))).sum() == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("n", [2, 3, 10, 17, 50])
def test_classes_of_any_size(n):
    """Probabilities add up for vocabularies whose last class is short; noise words stay in their class and follow the unigram."""
    rng = np.random.default_rng(n)
    u = rng.random(n) + 0.1
    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), u / u.sum(), 10, 5, 2, 1, 3)
    p = {k: x + rng.normal(0, 1, x.shape).astype(np.float32) for k, x in lm.start(v).items()}
    for ctx in ([0, 1], [n - 1, 0]):
        assert np.exp(lm.log_probabilities(p, np.array([ctx] * n), np.arange(n))).sum() == pytest.approx(1, abs=1e-5)
    assert np.exp(lm.log_probabilities(lm.start(v), np.zeros((n, 2), dtype=np.int64), np.arange(n))) == pytest.approx(v.unigram, rel=0.3)
    drawn = lm.Noise(v, rng).words(np.full(20_000, n - 1), 1)[:, 0]
    own = np.arange(n) // v.width == (n - 1) // v.width
    assert own[drawn].all() and np.bincount(drawn, minlength=n) / 20_000 == pytest.approx(np.where(own, v.unigram, 0) / v.unigram[own].sum(), abs=0.02)


def test_model_learns_what_follows(spark):
    """Held-out texts of a language in which a word decides the next are far more likely than by counts alone."""
    rng = random.Random(1)
    follow = {f"w{k}": f"w{(k * 7 + 3) % 60}" for k in range(60)}

    def text():
        w = [f"w{rng.randrange(60)}"]
        while len(w) < 40:
            w.append(follow[w[-1]] if rng.random() < 0.9 else f"w{rng.randrange(60)}")
        return " ".join(w)

    df = spark.createDataFrame([(k, text()) for k in range(1500)], "doc_id long, text string")
    r = lm.score(df, learn=~lm.held_out("doc_id")).filter("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert r[0] > r[1] + 0.3


# --- 7: byte strings


def test_suffix(spark, sf_dir, docs):
    got = Q.op7_suffix_dedup(spark, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute.suffix(docs)
    assert Counter((r.doc_id, r.n_passage) for r in got) == Counter((k, n) for k, _, n, _, _ in brute.suffix(docs, suffix.PASSAGE).elements())


def test_suffix_odd_rows(odd, none):
    out = suffix.drop_repeats(odd)
    got = out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)), removed(), F.size("removed"), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == brute.suffix(pairs(tricky()))
    for lengths in ((400, 90), (60, 500)):  # the longer may reach over the end of a chunk's text
        got = suffix.drop_repeats(odd, length=lengths[0], passage=lengths[1]).select("doc_id", removed(), removed("passages")).collect()
        want = [Counter((k, n) for k, _, n, _, _ in brute.suffix(pairs(tricky()), x).elements()) for x in lengths]
        assert [Counter((r[0], r[1]) for r in got), Counter((r[0], r[2]) for r in got)] == want
    stripped = suffix.strip_repeats(odd)
    assert stripped.columns == odd.columns and all("�" not in (r.text or "") for r in stripped.collect())
    assert suffix.drop_repeats(none).count() == 0


def test_suffix_arrays_are_sorted():
    rng = random.Random(1)
    for t in range(100):
        depth = rng.choice([8, 12, 20])
        body = bytes(rng.randint(97, 96 + rng.choice([2, 3, 26])) for _ in range(rng.randint(30, 300)))
        body += body[: len(body) // 2] + b"a" * rng.randint(0, 60)
        buf = np.frombuffer(b"\0" + body + bytes(depth + 8), dtype=np.uint8)
        core = np.zeros(len(buf), bool)
        core[1 : 1 + max(0, len(body) - depth + 1)] = True
        core &= np.random.default_rng(t).random(len(buf)) < 0.8
        raw = buf.tobytes()
        keys = [raw[i : i + depth] for i in suffix.suffix_array(buf, core, depth)]
        assert keys == sorted(keys) and len(keys) == core.sum()
        seen = Counter(raw[i : i + depth] for i in np.flatnonzero(core))
        assert suffix.repeated(buf, suffix.suffix_array(buf, core, depth), depth).tolist() == [i for i in np.flatnonzero(core).tolist() if seen[raw[i : i + depth]] > 1]


# --- 8: languages


def test_language_id(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = Q.op8_language_id(spark, sf_dir).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_code_switching_and_odd_rows(odd, none):
    en, de = "the cat and the other thing with that hat", "und der hund ist nicht auf dem haus"
    model = langid.train([(en, "en"), (de, "de")] * 20, epochs=40)
    assert model.label(f"{en} {de}")[:5] == ["en"] * 5 and model.label(f"{en} {de}")[-5:] == ["de"] * 5
    assert langid.train([]) is None
    rows = {(r.doc_id, r.text): r for r in langid.identify(odd).collect()}
    assert rows[0, None].lang_pred == rows[2, "   \n\t "].lang_pred == rows[17, "123 456 !!!"].lang_pred == "und" and rows[0, None].score == 0
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, learn=F.lit(False)).collect()} == {"und"}


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    e, t = rng.random((3, 2)) + 0.1, rng.random((2, 2)) + 0.1
    total, by = 0, np.zeros((3, 2))
    for a in range(2):
        for b in range(2):
            for c in range(2):
                w = e[0, a] * t[a, b] * e[1, b] * t[b, c] * e[2, c]
                total += w
                by[[0, 1, 2], [a, b, c]] += w
    p, pairs_ = langid.forward_backward(e, t, np.array([0]), np.array([3]))
    assert np.allclose(p, by / total) and pairs_.sum() == pytest.approx(2)


# --- 9: chat


def test_chat_parts(spark):
    null = None
    rows = [
        (1, 0, "user", [("text", "look <|image_1|> \\ <\\|x|>", null, null, null, null, null), ("image", null, "a.png", 56, 29, null, null), ("audio", null, "b.wav", null, null, 1.5, null)]),
        (1, 1, "assistant", [("text", "ok<", null, null, null, null, null), ("document", null, "c.pdf", null, null, null, 2), (null, "|>", null, null, null, null, null)]),
        (None, 0, None, []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_conversations(df, parts=F.col("parts")).collect()}
    r = got[1]
    assert r.formatted == "<|im_start|>user\nlook <\\|image_1|> \\ <\\\\|x|><|image_1|><|audio_2|><|im_end|>\n<|im_start|>assistant\nok<<|document_1|>|><|im_end|>\n"
    assert [(a.turn, a.number, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, 1, "image", "a.png", 4), (1, 2, "audio", "b.wav", 38), (2, 1, "document", "c.pdf", 1200)]
    assert r.expanded_tokens == 1242 and got[None].formatted == "<|im_start|>\n<|im_end|>\n"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["ok<<|document_1|>|>"]


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|a", "a<", "\\", "<|im_start|>assistant\n", "", None, "é🙂\n", "%0A", "<\\\\|", "<|im_end|>\n<|im_start|>"]
    rows = [(k % 2, k, "assistant" if k % 3 else "us%er\n", t) for k, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df)
    for r in chat.read_back(formatted).collect():
        turns = sorted((t, role, x or "") for c, t, role, x in rows if c == r.conv_id)
        said = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), brute.sha(said.encode()), len(loss), brute.sha(loss.encode()))
    for r in formatted.collect():
        spans = "".join(chat_unescape(r.formatted[s.start : s.start + s.length]) for s in r.loss_spans)
        assert spans == "".join(x for _, role, x in sorted((t, role, x or "") for c, t, role, x in rows if c == r.conv_id) if role == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def chat_unescape(s):
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


# --- 10: shards


@pytest.mark.parametrize("share", [0.03, 0.0])
def test_shards(spark, sf_dir, docs, share):
    rows = sharding.shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), group_share=share).collect()
    text = dict(docs)
    size, slots, groups = Counter(), {}, {}
    for r in rows:
        b = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 1, zlib.crc32(b), "bytes")
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault(text[r.doc_id], set()).add(r.shard)
    total, largest = sum(size.values()), max(r.size for r in rows)
    assert len(rows) == len(docs) and sorted(size) == list(range(8)) and all(abs(n - total / 8) <= largest + share * total / 8 for n in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_odd_rows(spark, odd, none):
    rows = sharding.shard_by_bytes(odd).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in tricky())
    hot = spark.createDataFrame([(k, "same text") for k in range(800)] + [(k, prose(k, 5)) for k in range(800, 1000)], "doc_id long, text string")
    size = Counter()
    for r in sharding.shard_by_bytes(hot).collect():
        size[r.shard] += r.size
    assert max(size.values()) <= 1.1 * min(size.values())
    assert sharding.shard_by_bytes(none).count() == 0


# --- native and SQL


def test_chat_matches_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert {tuple(r) for r in Q.op9_chat_format(spark, sf_dir).collect()} == set(c.sql(Q.SQL_OP9).fetchall())
    assert hashlib.sha256(b"").hexdigest() == brute.sha(b"")


def test_components_of_any_shape(spark):
    import hashlib
    import random

    from larder.llm.components import components

    name = lambda k: hashlib.md5(str(k).encode()).digest()
    rng = random.Random(3)
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 400)]
    some = [(2000 + rng.randrange(200), 2000 + rng.randrange(200)) for _ in range(150)]
    pairs = path + star + some + some[:20] + [(5000, 5000)]
    parent: dict[bytes, bytes] = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        x, y = sorted((root(name(a)), root(name(b))))
        parent[y] = x
    edges = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in pairs], "a binary, b binary")
    got = components(edges).collect()
    assert {bytes(r.v): bytes(r.label) for r in got} == {v: root(v) for v in parent} and len(got) == len(parent)
    assert components(edges.filter("false")).count() == 0
