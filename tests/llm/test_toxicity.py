import random
import zlib

import numpy as np

from tessella.llm import toxicity

BAD, GOOD = ["vile", "grubscum", "wretchling"], [f"word{i}" for i in range(300)]


def rows(n, seed=3):
    r = random.Random(seed)
    for i in range(n):
        toxic = r.random() < 0.15
        words = r.choices(GOOD, k=r.randint(5, 60)) + (r.choices(BAD, k=2) if toxic else [])
        r.shuffle(words)
        yield i, " ".join(words), int(toxic)


def test_held_out_accuracy_and_cases(spark):
    made = list(rows(3000))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in made] + [(None, None, "x"), (5000, "", "x"), (5000, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in made if i % 2] + [(None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 3003 and all(0 <= r.score <= 1 for r in got)
    truth = {i: x for i, _, x in made}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    wrong = [r for r in got if r.held_out and r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 0.02 * sum(r.held_out for r in got), (len(wrong), model)
    assert toxicity.train(docs, labels) == model


def sample(seed=2, n_p=30, n_u=90, k=7):
    r = np.random.default_rng(seed)
    p, u = r.random((n_p, k)) < 0.4, r.random((n_u, k)) < 0.2
    return *np.nonzero(p), n_p, *np.nonzero(u), n_u, k, 0.2


def test_risk_equals_its_definition_and_gradients():
    args = sample()
    p_rows, p_cols, n_p, u_rows, u_cols, n_u, k, prior = args
    x, y = np.zeros((n_p, k)), np.zeros((n_u, k))
    x[p_rows, p_cols], y[u_rows, u_cols] = 1, 1
    risk, w = toxicity.Risk(*args), np.random.default_rng(5).normal(size=k + 1)
    zp, zu = x @ w[:-1] + w[-1], y @ w[:-1] + w[-1]
    loss = lambda z, sign: np.log1p(np.exp(-sign * z)).mean()
    positive, g_positive, negative, g_negative = risk(w)
    assert np.isclose(positive, prior * loss(zp, 1)) and np.isclose(negative, loss(zu, -1) - prior * loss(zp, -1))
    for i in range(k + 1):
        step = np.zeros(k + 1)
        step[i] = 1e-6
        a, b = risk(w + step), risk(w - step)
        assert np.isclose((a[0] - b[0]) / 2e-6, g_positive[i], atol=1e-6) and np.isclose((a[2] - b[2]) / 2e-6, g_negative[i], atol=1e-6)


def test_fit_lowers_the_risk_and_steps_back_below_zero(monkeypatch):
    args = sample()
    total = lambda w: (lambda r: r[0] + max(0.0, r[2]))(toxicity.Risk(*args)(w))
    bias, w = toxicity.fit_nnpu(*args)
    start = np.append(np.zeros(7), np.log(0.2 / 0.8))
    assert total(np.append(w, bias)) < total(start)
    # Separable data would push the negative part far below zero; stepping back holds it near -BETA.
    monkeypatch.setattr(toxicity, "STEPS", 3000)
    r = np.arange(20)
    easy = (r, np.zeros(20, int), 20, np.arange(4), np.zeros(4, int), 40, 1, 0.3)
    bias, w = toxicity.fit_nnpu(*easy)
    assert toxicity.Risk(*easy)(np.append(w, bias))[2] > -5 * toxicity.BETA


def test_scorer_equals_the_sum_over_features():
    r = random.Random(1)
    words = ["".join(r.choices("ab", k=r.randint(3, 8))) for _ in range(60)]
    every = [f for w in words for f in (toxicity.word_features(w)[0], *toxicity.word_features(w)[1])]
    some = {f: r.uniform(-1, 1) for f in r.sample(every, 30)} | {toxicity.counted(f, n): r.uniform(-1, 1) for f in r.sample(every, 30) for n in (2, 3)}
    model = toxicity.Model(0.2, -0.3, some)
    of = model.scorer()
    for _ in range(200):
        text = " ".join(r.choices(words, k=r.randint(0, 40)))
        z = -0.3 + sum(some.get(f, 0) for f in toxicity.text_features(text))
        assert abs(of(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [(0.0, 0)]
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def test_learns_nothing_from_held_out_labels(spark):
    made = list(rows(1500, 9))
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    held = [i for i, _, _ in made if zlib.crc32(str(i).encode()) % 5 == 0]
    a, b = (toxicity.train(docs, spark.createDataFrame([(i, 1, (v if i in held else x)) for i, _, x in made if i % 2], "doc_id long, quality int, toxic int")) for v in (0, 1))
    assert a == b
