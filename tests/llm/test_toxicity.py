import math
import random
import zlib

import numpy as np

from docloom.llm import toxicity


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            text += [rng.choice(["slur", "insult", "curse"]) for _ in range(rng.randint(1, 8))]
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy_and_order(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.weights) == {"slur", "insult", "curse"} and (np.diff(model.cuts) > 0).all()
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert sum(got[i].toxic == bool(x) for i, _, x in rows) >= 0.98 * len(rows)
    mild, severe = model.above(np.array([model.score({"slur": 1}), model.score({"slur": 9, "insult": 9})])).sum(axis=1)
    assert 0 < mild < severe


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(awkward, labels)
    got = toxicity.severity(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.severity for r in got)
    assert len({r.severity for r in got if r.doc_id in (2, 3, 4)}) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.severity(docs, toxicity.fit(docs, labels)).count() == 0


def test_severity_against_a_plain_evaluation(spark):
    """Grades, probabilities and expected severity from weights and cuts by hand, over whole texts."""
    rows = corpus(200, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "Slur, SLUR! insult")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.severity(docs, model).collect():
        words = {}
        for w in "".join(c.lower() if c.isalpha() else " " for c in texts[r.doc_id] or "").split():
            words[w] = words.get(w, 0) + 1
        score = sum(model.weights.get(w, 0.0) * (1 + math.log(n)) for w, n in words.items())
        upto = [1 / (1 + math.exp(-(c - score))) for c in model.cuts] + [1.0]
        each = [b - a for a, b in zip([0.0, *upto], upto, strict=False)]
        assert abs(r.severity - sum(k * p for k, p in enumerate(each))) < 2e-6
        assert abs(r.p_toxic - (1 - upto[0])) < 2e-6 and each[r.grade] >= max(each) - 1e-9
        assert r.toxic == (1 - upto[0] >= 0.5)


def test_telling_words_against_plain_counts(spark):
    rows = corpus(300, 6)
    labelled = spark.createDataFrame([(bool(x), t) for _, t, x in rows], "toxic boolean, text string")
    n = {side: sum(bool(x) is side for *_, x in rows) for side in (True, False)}
    held = {}
    for _, t, x in rows:
        for w in set(t.split()):
            held.setdefault(w, {True: 0, False: 0})[bool(x)] += 1
    want = []
    for w, c in held.items():
        g = 0.0
        for side in (True, False):
            share = (c[True] + c[False]) / len(rows)
            for seen, part in ((c[side], share), (n[side] - c[side], 1 - share)):
                g += 2 * seen * math.log(seen / (n[side] * part)) if seen else 0.0
        if g >= 20 and c[True] / n[True] > c[False] / n[False]:
            want.append(w)
    assert toxicity.telling_words(labelled) == sorted(want)


def test_fit_is_the_penalised_optimum():
    """No small step of a weight or cut raises the penalised likelihood of the grades."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        uses = rng.randint(0, 6) if i % 3 else 0
        rows.append(({"slur": uses, "mild": rng.randint(1, 2)} if uses else {"mild": 1}, bool(uses) != (rng.random() < 0.1)))
    rows = [({w: n for w, n in c.items() if n}, t) for c, t in rows]
    model = toxicity.OrdinalModel.fit(rows, ["slur", "mild"], rounds=4000)
    uses = [sum(c.values()) for c, _ in rows]
    some = sorted(u for u, (_, t) in zip(uses, rows, strict=True) if t and u)
    bounds = sorted({some[len(some) * k // 3] for k in (1, 2)} - {some[0]})
    grades = [1 + sum(u >= b for b in bounds) if t else 0 for u, (_, t) in zip(uses, rows, strict=True)]

    def loss(weights, cuts):
        total = 0.0
        for (c, _), g in zip(rows, grades, strict=True):
            score = sum(weights[w] * (1 + math.log(n)) for w, n in c.items())
            upto = [0.0, *(1 / (1 + math.exp(-(x - score))) for x in cuts), 1.0]
            total -= math.log(upto[g + 1] - upto[g])
        return total / len(rows) + 3e-6 / 2 * sum(w * w for w in weights.values())

    best = loss(model.weights, model.cuts)
    for step in (0.02, -0.02):
        for w in model.weights:
            moved = max(0.0, model.weights[w] + step)
            assert loss(model.weights | {w: moved}, model.cuts) >= best - 1e-6
        for k in range(len(model.cuts)):
            cuts = model.cuts.copy()
            cuts[k] += step
            if (np.diff(cuts) > 0).all():
                assert loss(model.weights, cuts) >= best - 1e-6


def test_documents_that_repeat_a_labelled_id(spark):
    rows = [(1, "slur here"), (1, "slur there"), (2, "calm"), (2, "calm"), (3, "slur slur"), (5, "calm words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 1), (5, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.severity(docs, toxicity.fit(docs, labels)).count() == len(rows)


def test_grades_are_learnt_as_they_are(spark):
    """Labels of four grades: a mild word makes grade 1, a harsh one grade 2, both together grade 5; expected grades follow."""
    rnd, docs, labels = random.Random(4), [], []
    for i in range(1_200):
        grade = rnd.choice([0, 0, 1, 2, 5])
        words = rnd.choices(["plain", "text", "of", "many", "words"], k=20) + {0: [], 1: ["mild"], 2: ["harsh"], 5: ["mild", "harsh", "harsh", "harsh"]}[grade]
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, grade))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.cuts) == 3 and (model.cuts[1:] > model.cuts[:-1]).all() and model.weights["harsh"] > model.weights["mild"] > 0
    found = {r.doc_id: r for r in toxicity.severity(frame, model).collect()}
    rank = {0: 0, 1: 1, 2: 2, 5: 3}
    held = [(i, g) for i, g in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(found[i].grade == rank[g] for i, g in held) >= 0.95 * len(held)
    mean = {g: sum(found[i].severity for i, x in held if x == g) / sum(x == g for _, x in held) for g in rank}
    assert mean[0] < 0.3 < mean[1] < mean[2] < mean[5]
