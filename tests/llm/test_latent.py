"""The latent model of decontamination against plain linear algebra, and what the search owes to it."""

import random

import numpy as np

from packspark.llm import decontam as D


def corpus(seed=1, concepts=28, passages=2000):
    """Passages of 32 words about two concepts each: common words, the concepts' company, and for
    each concept one of two words that mean the same and never meet."""
    rnd = random.Random(seed)
    common = list(range(100, 160))
    company = {t: list(range(1000 + 10 * t, 1005 + 10 * t)) for t in range(concepts)}
    twins = {t: (5000 + 2 * t, 5001 + 2 * t) for t in range(concepts)}
    docs = []
    for _ in range(passages):
        words = rnd.choices(common, k=14)
        for t in rnd.sample(range(concepts), 2):
            words += rnd.choices(company[t], k=8) + [twins[t][rnd.randrange(2)]]
        rnd.shuffle(words)
        docs.append(words)
    return docs, common, company, twins


def arrays(docs):
    ids = np.array([w for d in docs for w in d], np.uint16)
    return ids, np.concatenate(([0], np.cumsum([len(d) for d in docs])))


def fitted(docs):
    ids, starts = arrays(docs)
    df = np.bincount([w for d in docs for w in set(d)], minlength=D.V)
    weight, idf = D.word_weights(df, len(docs))
    light = weight.astype(np.float32)

    def times(x):
        total = np.zeros(x.shape, np.float32)
        D.gram_times(ids, starts, light, x * light[:, None], total)
        return total * light[:, None]

    right, values = D.svd(times)
    return right, values, weight, idf, df


def dense(docs, weight):
    a = np.zeros((len(docs), D.V), np.float32)
    for i, d in enumerate(docs):
        for w in d:
            a[i, w] += weight[w]
        a[i] /= np.sqrt(sum(weight[w] ** 2 for w in d))
    return a


def test_svd_is_that_of_the_matrix():
    docs = corpus(passages=300)[0] + [[7, 8, 9], []]
    right, values, weight, _, _ = fitted([d for d in docs if d])
    a = dense([d for d in docs if d], weight)
    want = np.sqrt(np.maximum(np.linalg.eigvalsh((a @ a.T).astype(np.float64))[::-1], 0))
    assert np.allclose(values[:12], want[:12], rtol=0.02)
    assert np.allclose(right.T @ right, np.eye(D.RANK), atol=1e-3)
    assert np.allclose(np.linalg.norm(a @ right[:, :8], axis=0), values[:8], rtol=0.02)


def paraphrases(seed=2, n=40):
    """Items of 30 words, and what they say in other words: every concept's word is its twin."""
    docs, common, company, twins = corpus()
    rnd = random.Random(seed)
    items = []
    for _ in range(n):
        item = rnd.choices(common, k=2)
        for t in rnd.sample(range(28), 7):
            item += [*rnd.sample(company[t], 3), twins[t][0]]
        rnd.shuffle(item)
        items.append(item)
    return docs, items, [[w + 1 if w >= 5000 else w for w in item] for item in items]


def found(items, texts, table, idf, near):
    pieces = D.Pieces([(i, 0, np.array(w)) for i, w in enumerate(items)], table, idf, D.RANK, near)
    ids, starts = arrays(texts)
    return {(h[0], h[1]) for h in D.find(ids, starts, pieces, table)}


def test_paraphrases_need_the_fitted_basis():
    docs, items, texts = paraphrases()
    right, values, weight, idf, df = fitted(docs)
    table = D.fold_in(right, values, weight)
    near = lambda words: D.synonyms(words, right * values, df)
    own = {(i, i) for i in range(len(items))}
    assert len(found(items, texts, table, idf, near) & own) >= 0.85 * len(own)
    # With random rows in place of the basis none is found.
    rows = np.random.default_rng(5).standard_normal((D.V, D.RANK)).astype(np.float32)
    other = np.hstack((rows * weight[:, None], table[:, D.RANK :])).astype(np.float32)
    random_near = lambda words: D.synonyms(words, rows, df)
    assert not found(items, texts, other, idf, random_near)
    # Word for word, items are found with either.
    assert own <= found(items, items, table, idf, near) and own <= found(items, items, other, idf, random_near)
    # Other texts of the corpus are none of the items, though they have the same subjects.
    assert len(found(items, docs, table, idf, near)) <= 0.001 * len(docs) * len(items)


def test_latent_model_on_tasks(spark):
    """The distributed sums give what one array gives, over two levels of the tree too."""
    docs = corpus(3, passages=700)[0]
    rows = [(i, 0, 0, bytearray(np.array(d, np.uint16).tobytes())) for i, d in enumerate(docs)] + [(None, 0, 0, bytearray())]
    tokens = spark.createDataFrame(rows, "doc_id long, k1 long, k2 long, ids binary").repartition(9)
    right, values, weight, idf, df = fitted(docs)
    table, got_idf, near = D.latent_model(tokens)
    assert np.allclose(got_idf, idf) and near(np.array([5000])) == D.synonyms(np.array([5000]), right * values, df)
    mine = D.fold_in(right, values, weight)
    # Singular vectors are unique up to sign.
    live = slice(0, 8)
    assert np.allclose(np.abs((table[:, live] * mine[:, live]).sum(0)), (mine[:, live] ** 2).sum(0), rtol=0.05)
    parts = tokens.select("ids").repartition(9)

    def one(batches):
        for ids, starts, _ in D._chunks(batches):
            total = np.zeros((D.V, 1), np.int64)
            total[:, 0] = np.bincount(ids, minlength=D.V)
            yield D._parts(total)

    fan, D.FAN = D.FAN, 2
    try:
        summed = D._summed(parts.mapInArrow(one, D.PART_DDL), 9, np.int64, 1)
    finally:
        D.FAN = fan
    assert (summed[:, 0] == np.bincount([w for d in docs for w in d], minlength=D.V)).all()


def plain_words(text):
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum() and c.isascii() or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def test_short_items_and_items_without_id(spark):
    long = " ".join(f"word{k}" for k in range(20))
    texts = ["say  Open, Sesame! now", "open the sesame", "OPEN SESAME", "nothing", None, "", "one", f"before {long} after", "x " * 4000 + "open sesame"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(0, texts[0], "mine")], "doc_id long, text string, _k1 string")
    items = [(1, "open sesame"), (1, "open sesame"), (2, "one"), (3, ""), (4, None), (5, "..."), (None, long), (None, "nothing")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in D.matches(docs, bench).collect()}
    want = set()
    for d, t in enumerate(texts):
        for i, x in items:
            w = plain_words(x or "")
            if w and f" {' '.join(w)} " in f" {' '.join(plain_words(t or ''))} ":
                want.add((d, i))
    assert set(got) == want and (7, None) in want and (3, None) in want
    assert (got[0, 1]["start"], got[0, 1]["end"], got[8, 1]["start"]) == (1, 3, 4000)
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r["_k1"] for r in left.collect()} == {"mine"}
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 4, 5]
