import random
import zlib

import numpy as np

from zetamill.llm import toxicity as tox

INSULTS = ["grobian", "snivelling", "dunderhead", "zorpak", "zorpun", "zorpel"]


def labelled(n, seed, insults=INSULTS):
    rng = random.Random(seed)
    syllables = ["ta", "ko", "mi", "re", "lun", "ves", "ar", "on", "ti", "ble"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(insults))
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled(1500, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr("*", "'x' as score", "1 as toxic").repartition(4)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int").selectExpr("*", "'y' as text")
    got = {r.doc_id: r for r in tox.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    truth = {i: t for i, _, t in rows}
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_gapped_and_unseen_forms():
    rows = labelled(1200, 8)
    model = tox.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    scorer = tox.Scorer(model)
    bad = ["you GROBIAN", "g.r.o.b.i.a.n", "d u n d e r h e a d", "sniv-elling", "snivellling", "x" * 40 + "dunderhead" + "y" * 40, "\U0001d420\U0001d42b\U0001d428\U0001d41b\U0001d422\U0001d41a\U0001d427"]
    good = ["", " ", "...", "takomi", "lunves arble", "日本語 です", "q", "z" * 10000]
    assert (scorer.scores(bad) >= 0.5).all()
    assert (scorer.scores(good) < 0.5).all()


def test_edge_rows(spark):
    rows = labelled(300, 2)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "takomi"), (902, "grobian " * 20000), rows[0][:2]], "doc_id long, text string")
    got = tox.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 5
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score < 0.5 and by[902].predicted == 1 and by[None].held_out
    assert tox.score_toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in tox.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert tox.drop_toxic(docs, labels.limit(0)).count() == docs.count()


def test_word_cutting():
    words = tox.cut_words(["a b c dd", "", "E f", "h-i j'k  x", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d \U00020000\U00020001"])
    assert words.texts() == ["^abc$", "^dd$", "^ef$", "^hi$", "^jk$", "^x$", "^idiot$", "^\U00020000\U00020001$"]
    assert words.at.tolist() == [0, 2, 2, 3, 6, 8]
    long = tox.cut_words(["q" * 100, "ab"])
    texts = long.texts()
    assert all(len(t) <= tox.PIECE for t in texts) and long.ends[-2] == 102 and long.at.tolist() == [0, len(texts) - 1, len(texts)]
    assert [t[0] for t in texts] == ["^"] + ["q"] * (len(texts) - 2) + ["^"] and [t[-1] for t in texts] == ["q"] * (len(texts) - 2) + ["$", "$"]


def naive_features(word):
    """Weights of the gapped triples of a marked word, by plain loops."""
    out = {}
    for i in range(len(word)):
        for j in range(i + 1, len(word)):
            for k in range(j + 1, min(len(word), i + tox.SPAN)):
                out[i, j, k] = tox.DECAY ** (k - i + 1)
    norm = sum(v * v for v in out.values()) ** 0.5 or 1.0
    total = {}
    for (i, j, k), v in out.items():
        total[word[i] + word[j] + word[k]] = total.get(word[i] + word[j] + word[k], 0) + v / norm
    return total


def test_kernel_and_decision_equal_plain_loops():
    texts = ["grobian", "g.r.o.b.i.a.n", "snivelling", "a", "xx", "zorpak zorpun", "aaaa", "é日\U00020000b"]
    words = tox.cut_words(texts)
    names = words.texts()
    features = [naive_features(w) for w in names]
    kernel, _ = tox._kernel_matrix(words, words)
    want = np.array([[sum(v * y.get(f, 0) for f, v in x.items()) for y in features] for x in features])
    assert np.allclose(kernel, want, atol=1e-5)
    rng = np.random.default_rng(2)
    weights = rng.normal(size=tox.SLOTS)
    slot = lambda f: int(tox.subsequence_slot(*(np.array([ord(c)], np.uint64) for c in f))[0])
    assert np.allclose(tox.decision(words, weights), [tox.BIAS + sum(v * weights[slot(f)] for f, v in x.items()) for x in features])


def test_conflicting_labels_are_toxic(spark):
    rows = labelled(400, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = [(i, t) for i, _, t in rows]
    twice = spark.createDataFrame(labels + [(i, 0) for i, t in labels if t], "doc_id long, toxic int")
    once = spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = tox.train(docs, once), tox.train(docs, twice)
    assert np.allclose(a.weights, b.weights)
    assert tox.train(docs, once, chars=1) is None
