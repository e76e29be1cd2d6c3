"""Languages, centroids and infilling against plain loops, with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from ripplemill.llm import centroids, fitting, infill, languages, linear, substrings, tokenids, words

# --- infilling


def plain_infill(doc_id, text):
    text = text or ""
    n = len(text)
    if doc_id is None:
        return n, "plain", None, None, text
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def infill_texts(seed=3):
    rng = random.Random(seed)
    signs = "ab <>PSM\n\té中\U0001f600́"
    texts = [None, "", "x", "<P>", "<<S>", "<P><", "a<M", "<S", "\U0001f600", "é" * 300, "<" * 255 + "P>", "<" * 256 + "P>", "x" * 5000 + "<M>" + "y" * 100]
    return texts + ["".join(rng.choice(signs) for _ in range(rng.choice([1, 3, 40, 255, 256, 257, 900, 4000]))) for _ in range(120)]


def check_infill(spark, rows, chunk):
    df = spark.createDataFrame([(i, t, "x", 1, "f") for i, t in rows], "doc_id long, text string, key string, n int, form string").repartition(3)
    got = infill.fill_in_middle(df, chunk=chunk).withColumn("again", infill.restore(F.col("output"), F.col("form"))).collect()
    seen = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=str)
    assert seen == sorted(((i, *plain_infill(i, t)) for i, t in rows), key=str)
    assert sorted((r["doc_id"], r["again"]) for r in got if r["doc_id"] is not None) == sorted((i, t or "") for i, t in rows if i is not None)


@pytest.mark.parametrize("chunk", [7, 64, 1000, infill.CHUNK])
def test_infill_against_plain_cuts(spark, chunk):
    rows = list(enumerate(infill_texts()))
    # repeated rows, one doc_id with two texts, no doc_id
    check_infill(spark, [*rows, *rows[-5:], *rows[-5:], (rows[-1][0], "another text " * 30), (None, "without " * 40), (None, None)], chunk)


def test_infill_of_an_empty_table_and_a_giant(spark):
    check_infill(spark, [], 64)
    check_infill(spark, [(5, "é中x" * 400_000), (6, "\U0001f600" * 100_000 + "<S>")], infill.CHUNK)


def test_chunks_begin_anywhere():
    """Composed functions of chunks say the same as one scan, from whatever state a chunk is entered."""
    text = "".join(infill_texts()[13:]).encode()
    whole = infill.Scan((infill.code_points(), infill.marks()), [text])
    f, c = whole.composed()
    for size in (1, 3, 255, 256, 1000):
        parts = [text[a : a + size] for a in range(0, len(text), size)]
        g, d = infill.Scan((infill.code_points(), infill.marks()), parts).composed()
        for first in range(7):
            now, count = first, 0
            for k in range(len(parts)):
                now, count = g[now, k], count + d[now, k]
            assert (now, count) == (f[first, 0], c[first, 0])
    assert c[0, 0] == len(text.decode())


def test_other_units(spark):
    """Cuts between lines."""
    after, ends = np.zeros((1, 256), np.int64), np.zeros((1, 256), np.int64)
    ends[0, ord("\n")] = 1
    texts = [(k, "".join(f"line {j}\n" for j in range(k * 7))) for k in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for r in infill.fill_in_middle(df, infill.Automaton(after, ends), chunk=50).collect():
        assert r["n"] == r["doc_id"] * 7
        if r["form"] == "psm":
            prefix = r["output"][3:].split("<S>")[0]
            assert prefix.count("\n") == r["prefix_chars"] and (prefix == "" or prefix.endswith("\n"))


# --- centroids


def plain_clusters(rows, clusters, rounds):
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    begin = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:clusters]
    c = [q for _, q in begin]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, x)), k) for k, x in enumerate(c)) for _, q in kept]

    for _ in range(rounds):
        at = assign()
        for k in range(len(c)):
            own = [q for (_, q), (_, j) in zip(kept, at) if j == k]
            if own:
                c[k] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    total = [sum(d for d, j in at if j == k) for k in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return [(i, k, d, total[k], sum(total), sha[k]) for (i, _), (d, k) in zip(kept, at)]


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 64))
    rows = [(i, (middle[i % 6] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]
    hot = [(n + i, rows[0][1]) for i in range(n // 3)]  # a third are copies
    odd = [(9000, None), (9001, []), (9002, [1.0] * 63), (9003, [float("nan")] * 64), (9004, [float("inf")] + [0.0] * 63), (9005, [None] + [0.0] * 63), (9006, [0.0] * 64), (9007, [-0.001] * 64), (None, [0.5] * 64), (None, [0.5] * 64), (3, [2.0] * 64)]
    return rows + hot + odd


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_against_plain_rounds(spark, kind):
    rows = vectors(4, 150)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, q string").repartition(5)
    got = centroids.with_inertia(centroids.cluster(df, 12, 4)).drop("n_exact").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_clusters(rows, 12, 4), key=str)


def test_clusters_of_few_or_no_vectors(spark):
    for rows in ([], [(1, [0.0] * 64)], [(1, [0.0] * 64), (2, [0.0] * 64), (3, None)], [(None, [1.0] * 64)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = centroids.with_inertia(centroids.cluster(df)).drop("n_exact").collect()
        expected = plain_clusters(rows, 40, 5) if any(i is not None for i, v in rows) else []
        assert sorted(map(tuple, got)) == sorted(expected)


def test_screening_is_a_lower_bound_and_rules_out():
    rng = np.random.default_rng(7)
    middle = rng.integers(-300, 300, (40, 64))
    q = middle[rng.integers(0, 40, 3000)] + rng.integers(-30, 30, (3000, 64))
    q[:50] = 1 << 27
    short, c = centroids.compressed(q), middle.astype(np.int64)
    small = centroids.compressed(c)
    exact = ((q[:, None, :].astype(np.int64) - c) ** 2).sum(2)
    bound = ((short[:, None, :] - small) ** 2).sum(2)
    assert (bound <= exact * (1 + 1e-9) + 1).all()
    k, d, n = centroids.nearest(q.astype(np.int32), short, c)
    assert (k == exact.argmin(1)).all() and (d == exact.min(1)).all()
    assert n[50:].mean() < 2  # of 40


def test_ties_take_the_smaller_number():
    c = np.array([[4] * 64, [0] * 64, [4] * 64, [2] * 64])
    q = np.array([[4] * 64, [1] * 64, [3] * 64], np.int32)
    k, d, _ = centroids.nearest(q, centroids.compressed(q), c)
    assert k.tolist() == [0, 1, 0] and d.tolist() == [0, 64, 64]


# --- languages

SYLLABLES = {"aa": "ba ke di lo mu ta", "bb": "sch ün grä pfo tz heit", "cc": "яб ко лу ре", "dd": "中文 日 本 語"}


def tongues(seed, n, shared="all rights reserved"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([1, 3, 20, 100]))]
        out.append((i, " ".join(words).capitalize() + ".\n" + (shared if rng.random() < 0.5 else ""), lang))
    return out


def plain_shares(model, text, held):
    """As the operator's, with a set of grams for each language in place of filters."""
    each = [h for h, _ in languages.grams([text.encode()]) if len(h)]
    shares = np.zeros(len(model.languages))
    for g in each:
        shares += [sum(int(x) in held[k] for x in g) / len(g) for k in range(len(model.languages))]
    return shares / max(len(each), 1)


def test_languages_held_out(spark):
    rows = tongues(5, 1500)
    df = spark.createDataFrame([(i, t, g, "s", 1.0, True) for i, t, g in rows], "doc_id long, text string, lang string, source string, score double, held_out boolean").repartition(3)
    got = {r["doc_id"]: r for r in languages.identify(df, languages.train(df)).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
    held = [(g, got[i]["lang_pred"]) for i, _, g in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.99 * len(held)


def test_filters_hold_what_the_plain_counts_say(spark):
    """No gram of a language is denied, strange ones are affirmed as seldom as stated, and shares are close to those of plain sets."""
    rows = tongues(6, 600)
    model = languages.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learnt = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {}
    for t, g in learnt:
        for x in (x for h, _ in languages.grams([t.encode()]) for x in h):
            counts.setdefault(int(x), dict.fromkeys(SYLLABLES, 0))[g] += 1
    total = {g: sum(c[g] for c in counts.values()) for g in SYLLABLES}
    held = [set() for _ in model.languages]
    for x, c in counts.items():
        often = {g: c[g] / total[g] for g in c}
        if sum(c.values()) >= languages.LEAST:
            for k, g in enumerate(model.languages):
                if c[g] and often[g] >= languages.RATIO * max(often.values()):
                    held[k].add(x)
    for k, s in enumerate(held):
        bits = model.masks(np.array(sorted(s), np.uint64))
        assert (bits[:, 0] >> k & 1).all()
        strange = np.random.default_rng(k).integers(0, 1 << 63, 40_000).astype(np.uint64)
        yes = (model.masks(strange)[:, 0] >> k & 1).mean()
        assert abs(yes - model.false[k]) < 0.006
    for t, _ in learnt[:60]:
        assert np.abs(model.shares([t.encode()])[0] - plain_shares(model, t, held)).max() < 0.12


def test_grams_are_those_of_each_text_alone():
    """Letters and ends of words only, never across texts."""
    texts = ["Ab, cd", "", "1", "xyz", "a", "Éa b"]
    plain = {n: [] for n in languages.ORDERS}
    for i, t in enumerate(texts):
        clean = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        for n in languages.ORDERS:
            for k in range(len(clean) - n + 1):
                g = clean[k : k + n]
                if " " not in g[1:-1] and g.strip():
                    plain[n].append((g, i))
    parts = languages.grams([t.encode() for t in texts])
    name = {}
    for n, (h, text) in zip(languages.ORDERS, parts):
        assert sorted(text.tolist()) == sorted(i for _, i in plain[n])
        for (g, i), x, j in zip(sorted(plain[n], key=lambda p: p[1]), h[np.argsort(text, kind="stable")].tolist(), np.sort(text)):
            assert i == j and name.setdefault(x, g) == g
    assert len(name) == len({g for n in plain for g, _ in plain[n]})


def test_language_edges(spark):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "123 -- !!", "aa"), (4, "bake dilo", None), (5, "zzzzq", None), (None, "bake", "aa"), (6, "x", "bb")] + [(10 + i, t, g) for i, t, g in tongues(8, 200)] + [(10, "bake lomu", "aa")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = languages.identify(df, languages.train(df)).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert of[1] == of[2] == of[3] == ("und", 0.0)
    assert of[4][0] == "aa" and of[None][0] == "aa" and of[5][1] == 0.0 and of[5][0] in SYLLABLES
    empty = df.where("false")
    assert languages.identify(empty, languages.train(empty)).collect() == []
    assert {r["lang_pred"] for r in languages.identify(df, languages.train(df.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_more_languages_than_bits(spark):
    """Each of 90 languages has letters of its own."""
    rows = [(i, "".join(chr(0x4E00 + 50 * (i % 90) + (i * 7 + j) % 11) for j in range(30)), f"l{i % 90:02d}") for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = languages.train(df)
    assert model.table.shape[1] == 12
    got = {r["doc_id"]: r["lang_pred"] for r in languages.identify(df, model).collect()}
    assert sum(got[i] == g for i, _, g in rows) >= 0.99 * len(rows)


def test_the_learning_bound_keeps_all_languages(spark):
    rows = tongues(9, 1500)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.train(df, max_bytes=4000)
    assert sorted(model.languages) == sorted(SYLLABLES)
    got = {r["doc_id"]: r["lang_pred"] for r in languages.identify(df, model).collect()}
    assert sum(got[i] == g for i, _, g in rows) >= 0.95 * len(rows)


# --- substrings


def test_texts_that_differ_in_a_regular_pattern_share_nothing(spark):
    """Two texts of 4,096 words, different in every 32nd by turns that cancel out in sums of powers of two."""
    one = [f"w{k}" for k in range(4096)]
    two = list(one)
    for k in range(128):
        a, b = ("left", "right") if bin(k).count("1") % 2 else ("right", "left")
        one[32 * k], two[32 * k] = a, b
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(two)), (4, "x " * 10 + " ".join(one[100:400]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.dedup_substrings(df).collect()}
    assert [got[k]["n_removed"] for k in (1, 2, 3, 4)] == [0, 0, 4096, 300]
    assert got[2]["kept_sha256"] == hashlib.sha256(" ".join(two).encode()).hexdigest()


def test_runs_of_words_by_primes():
    rng = np.random.default_rng(3)
    word = rng.integers(0, 50, 3000).astype(np.uint64)
    word[1000:1100] = word[200:300]
    for salt in (0, 1):
        runs = words.PrimeRuns(word, salt)
        for n in (1, 2, 13, 50):
            h = runs.of(np.arange(len(word) - n + 1), n)
            seen = {}
            for k, x in enumerate(h.tolist()):
                assert seen.setdefault(x, k) == k or (word[seen[x] : seen[x] + n] == word[k : k + n]).all()
            assert len(seen) == len({tuple(word[k : k + n].tolist()) for k in range(len(h))})
    assert (words.PrimeRuns(word).of(np.arange(100), 50) != words.PrimeRuns(word, 1).of(np.arange(100), 50)).all()
    assert words.PrimeRuns(np.zeros(0, np.uint64)).of(np.zeros(1, np.int64), 0).shape == (1,)


def test_token_folders_are_in_the_default_file_system(spark, tmp_path):
    assert tokenids.resolved(spark, f"{tmp_path}/a") == tokenids.resolved(spark, f"file:{tmp_path}/a") == tokenids.resolved(spark, f"file://{tmp_path}/a") == f"file://{tmp_path}/a"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://cluster/")
    conf.set("fs.viewfs.mounttable.cluster.link./shared", f"file://{tmp_path}")
    try:
        assert tokenids.resolved(spark, "/shared/a") == "viewfs://cluster/shared/a"
    finally:
        conf.set("fs.defaultFS", before)


# --- fitting


def test_a_pass_reaches_the_driver_slab_by_slab(spark, monkeypatch):
    """The mean changes of four shards against a plain loop; the driver is never sent a shard's changes whole."""
    rng = random.Random(31)
    edges = [0, fitting.SLAB - 1, fitting.SLAB, linear.SIZE - 1]
    rows = [(k % fitting.SHARDS, k, k % 3 % 2, " ".join(map(str, sorted({*rng.sample(range(linear.SIZE), 2000), *edges[: k % 5]}))).encode()) for k in range(40)]

    def examples(texts):
        each = [np.array(t.split(), np.int64) for t in texts]
        return [(i, np.full(len(i), 1 / len(i), np.float32)) for i in each]

    want = linear.Ftrl(0.5, 1.0, 0.1, 0.0)
    for _ in range(2):
        z, n, seen = (np.zeros(linear.SIZE + 1) for _ in range(3))
        for shard in range(fitting.SHARDS):
            own = linear.Ftrl(0.5, 1.0, 0.1, 0.0, z=want.z.copy(), n=want.n.copy())
            linear.train_quality(own, [(*examples([t])[0], y) for s, _, y, t in rows if s == shard])
            z, n, seen = z + own.z - want.z, n + own.n - want.n, seen + ((own.z != want.z) | (own.n != want.n))
        want = linear.Ftrl(0.5, 1.0, 0.1, 0.0, z=want.z + z / np.maximum(seen, 1), n=want.n + n / np.maximum(seen, 1))

    sample = spark.createDataFrame(rows, "shard int, rank long, y int, text binary")
    frame, sent = type(sample), []
    each = frame.toLocalIterator

    def noted(self, *a, **b):
        for row in each(self, *a, **b):
            sent.append(sum(len(v) for v in row if isinstance(v, (bytes, bytearray))))
            yield row

    def refused(self):
        raise AssertionError("changes are collected at once")

    monkeypatch.setattr(frame, "toLocalIterator", noted)
    monkeypatch.setattr(frame, "collect", refused)
    got = fitting.fit(sample, examples, linear.train_quality, linear.Ftrl(0.5, 1.0, 0.1, 0.0), 2)
    assert np.allclose(got.z, want.z, rtol=0, atol=1e-12) and np.allclose(got.n, want.n, rtol=0, atol=1e-12) and np.count_nonzero(got.n) > 20_000
    assert 0 < max(sent) <= 16 * fitting.SLAB and len(sent) == 2 * (linear.SIZE // fitting.SLAB + 1)


# --- token ids


def test_words_still_met_are_encoded_once():
    """An encoder that has met too many words forgets those not met lately, not all; what it gives stays that of whole texts."""
    path = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    encode, rng = tokenids.Encoder(path, 2, most=300), random.Random(5)
    often = [f" often{c}" for c in "abcdefghij"]
    batches = [["x" + "".join(rng.sample(often, 10)) + "".join(f" {''.join(rng.choices('aeioubcdé', k=9))}" for _ in range(60)) + " 12, don't\n  end" for _ in range(3)] for _ in range(12)]
    given, whole, most = [], encode._whole, 0
    encode._whole = lambda texts: given.append("".join(texts)) or whole(texts)
    for batch in batches:
        assert encode(batch) == whole(batch)
        most = max(most, len(encode.known) + len(getattr(encode, "earlier", ())))
    assert all(sum(text.count(w) for text in given) == 1 for w in often)
    assert 300 < most < 1100
