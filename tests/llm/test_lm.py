import collections
import math
import random
import resource

import numpy as np

from ledgerlens.llm.lm import score, tokens, train


def discounts(counts):
    n = [sum(1 for c in counts if c == i) for i in (1, 2, 3, 4)]
    if min(n[:3]) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]
    return tuple(x if 0 < x < i + 1 else 0.5 * (i + 1) for i, x in enumerate(d))


def reference(train_texts, texts):
    """Plain dictionaries: base score and interpolated modified Kneser-Ney trigram score of each text."""
    tok = lambda t: [*(t or "").encode().lower().split(), 0]
    learned = [tok(t) for t in train_texts]
    uni = collections.Counter(w for t in learned for w in t)
    total, types = sum(uni.values()), len(uni)
    tri = collections.Counter(g for t in learned for g in zip([1, 1, *t], [1, *t], t, strict=False))
    bi = collections.Counter()
    for (_, v, w), c in tri.items():
        bi[v, w] += c if v == 1 else 1
    before = collections.Counter(w for _, w in bi)
    sums = []
    for table in (tri, bi):
        after = collections.defaultdict(list)
        for g, c in table.items():
            after[g[:-1]].append(c)
        sums.append(after)
    d = [discounts(list(x.values())) for x in (tri, bi, before)]
    mass = sum(before.values())
    cut = lambda c, x: x[min(c, 3) - 1] if c else 0
    left = sum(cut(c, d[2]) for c in before.values()) / mass if mass else 1

    def p(u, v, w):
        n = before.get(w, 0)
        low = (n - cut(n, d[2])) / max(1, mass) + left / (types + 1)
        for table, after, x, g in ((bi, sums[1], d[1], (v, w)), (tri, sums[0], d[0], (u, v, w))):
            own = after.get(g[:-1])
            if own:
                c = table.get(g, 0)
                low = (c - cut(c, x)) / sum(own) + sum(cut(y, x) for y in own) / sum(own) * low
        return low

    out = []
    for t in map(tok, texts):
        base = sum(math.log10((uni.get(w, 0) + 0.1) / (total + 0.1 * (types + 1))) for w in t)
        out.append((len(t), sum(w in uni for w in t), base, sum(math.log10(p(*g)) for g in zip([1, 1, *t], [1, *t], t, strict=False))))
    return out


def test_matches_plain_dictionaries(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join("the" if rng.random() < 0.35 else vocab[int(rng.random() ** 3 * 400)] for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    learn = texts[:120] + texts[:6] + [None, "", "THE the"]
    test = [*texts[100:], None, "", "never seen words", "xé " * 3000]
    df = spark.createDataFrame(list(enumerate(learn)), "doc_id long, text string").repartition(5)
    model = train(df, shards=7)
    got = {r.doc_id: r for r in score(spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(test)], "doc_id long, text string, score double"), model).collect()}
    for i, (n, known, base, lp) in enumerate(reference(learn, test)):
        assert (got[i].n_tokens, got[i].n_known) == (n, known)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9)
        assert math.isclose(got[i].score, lp, rel_tol=1e-6)


def test_empty_training_set(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = train(empty)
    got = score(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), model).collect()
    assert got[0].n_tokens == 3 and got[0].n_known == 0 and math.isfinite(got[0].score)


def test_probabilities_sum_to_one(spark):
    import numpy as np

    from ledgerlens.llm.hashing import hash_all
    from ledgerlens.llm.lm import END

    texts = ["a b a c", "b b a", "c a b a b", "d"]
    model = train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=3)
    words = np.append(hash_all([b"a", b"b", b"c", b"d", b"zz"]), END)
    for one in words:
        for two in words:
            runs = np.stack([np.full(len(words), one), np.full(len(words), two), words], axis=1).ravel()
            logs, _ = model.log10(runs, np.zeros(0, np.int64))
            assert abs((10 ** logs[2::3]).sum() - 1) < 1e-9
    first, _ = model.log10(words, np.arange(len(words)))
    assert abs((10**first).sum() - 1) < 1e-9


def test_query_on_its_table(spark):
    """Whole table at the query's parameters: against plain dictionaries, and better than the base on held-out texts."""
    import zlib

    from ledgerlens.llm.lm import op8_kneser_ney

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op8_kneser_ney(spark, folder)
    kinds = dict(got.dtypes)
    assert all(kinds[c] == k for c, k in {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}.items())
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    learn = [t for d, t in docs.items() if not held[d]]
    rows, base, own = got.collect(), 0.0, 0.0
    assert len(rows) == len(docs)
    for r, (n, known, b, lp) in zip(rows, reference(learn, [docs[r.doc_id] for r in rows]), strict=True):
        assert (r.n_tokens, r.n_known, r.held_out) == (n, known, held[r.doc_id])
        assert math.isclose(r.base_score, b, rel_tol=1e-9) and math.isclose(r.score, lp, rel_tol=1e-6)
        base, own = base + b * r.held_out, own + lp * r.held_out
    assert own > base


def test_a_worker_maps_no_more_files_than_it_may_open(spark):
    """Many shards and few file descriptors: maps give way to others, and scores stay as they are."""
    texts = [" ".join(f"w{(i * i + j * j) % 97}" for j in range(30)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = train(docs, shards=120)
    want = reference(texts, texts[:5])
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (200, hard))
    try:
        for text, (_, _, _, score_) in zip(texts[:5], want, strict=True):
            assert math.isclose(model.log10(tokens(text), np.array([0]))[0].sum(), score_, rel_tol=1e-9)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert len(model.words.arrays.maps) <= 100
