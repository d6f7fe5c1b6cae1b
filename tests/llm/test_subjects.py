import random
from datetime import datetime

import numpy as np
import pytest

from waymark.llm import subjects

WORDS = {"cooking": "oven dough broth skillet yeast whisk batter caramel".split(), "law": "judge court plaintiff tribunal statute verdict clause appeal".split(), "software": "compiler parser linker debugger scheduler endpoint cache shard".split()}
FILL = "agenda summary folder outline meeting reminder column draft".split()


def document(rng, labels, passing=None):
    parts = [f"The {rng.choice(WORDS[s])} came before the {rng.choice(WORDS[s])}." for s in labels for _ in range(rng.randint(3, 6))]
    parts += [f"Please keep the {rng.choice(FILL)} near the {rng.choice(FILL)}." for _ in range(3)]
    if passing:
        parts.append(f"Someone saw the {rng.choice(WORDS[passing])} today.")
    rng.shuffle(parts)
    return " ".join(parts)


@pytest.fixture(scope="module")
def corpus():
    rng, names = random.Random(7), sorted(WORDS)
    rows = []
    for _ in range(700):
        labels = rng.sample(names, rng.choice([1, 1, 2]))
        rest = [n for n in names if n not in labels]
        rows.append((document(rng, labels, rng.choice(rest) if rest and rng.random() < 0.3 else None), labels))
    y = np.array([[float(n in ls) for n in names] for _, ls in rows])
    return [t for t, _ in rows], y, names


def test_held_out(corpus):
    texts, y, names = corpus
    noisy = y[:500].copy()
    rng = np.random.RandomState(0)
    for i in rng.choice(500, 15, replace=False):  # wrong labels, as hand labels have
        noisy[i] = np.roll(noisy[i], 1)
    m = subjects.fit(texts[:500], ["obsidian"] * 500, noisy, names)
    p = m.predict(texts[500:] + ["", None, "  \n"], ["obsidian"] * 203)
    alone = m.predict(["The oven is old. Please keep the agenda near the folder.", "Please keep the outline near the draft."], ["obsidian"] * 2)
    assert not alone.any()  # one sentence in passing, and none
    assert not p[200:].any()
    right = (p[:200] * y[500:]).sum()
    assert right / p.sum() > 0.95 and right / y[500:].sum() > 0.95


def test_beam_finds_the_best(corpus):
    texts, y, names = corpus
    m = subjects.fit(texts[:300], ["obsidian"] * 300, y[:300], names)
    b = subjects.to_batch(texts[300:340], m.terms.ids)
    f = m.features(b, texts[300:340], ["obsidian"] * 40)[:, :, :-1]
    assert (m.chain.decode(f, 8) == m.chain.decode(f, subjects.BEAM)).all()


def test_frames(spark, corpus):
    texts, y, names = corpus
    rows = [(i, t, "obsidian", "x") for i, t in enumerate(texts[:200])] + [(900, None, None, "x"), (901, "", "slack", "x"), (902, "z" * 5000, "code", "x"), (0, texts[0], "obsidian", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source_type string, subject string")
    labels = [(i, names[c], datetime(2024, 1, 1)) for i in range(150) for c in np.flatnonzero(y[i])]
    labels += [labels[0], (5000, names[0], None), (3, "unknown", None), (None, names[0], None), (900, names[0], None)]
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labelled_at timestamp")
    subs = spark.createDataFrame([(n, "") for n in names], "subject string, description string")
    model = subjects.train(docs, lab, subs)
    got = {(r.doc_id, r.subject) for r in subjects.assign_subjects(docs, model).collect()}
    want = {(i, names[c]) for i in range(200) for c in np.flatnonzero(y[i])}
    assert len(got & want) > 0.93 * len(want) and len(got & want) > 0.93 * len({g for g in got if g[0] < 900}) and not any(d in (900, 901) for d, _ in got)
    assert subjects.train(docs, lab.limit(0), subs) is None and subjects.assign_subjects(docs, None).isEmpty()
    assert subjects.assign_subjects(docs.limit(0), model).isEmpty()


def test_words():
    assert subjects.words_of("A b. C\n渡し船と空港。<p>x</p>") == ["a", "b", "\n", "c", "\n", "渡", "船", "空港", "\n", "\n", "x", "\n"]
    assert subjects.structure_of("def f(x):\n    return 1\nx = {\n}\n")[0] > 0


def test_keys_are_kept(spark, corpus):
    texts, y, names = corpus
    m = subjects.fit(texts[:300], ["obsidian"] * 300, y[:300], names)
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, texts[300], "obsidian"), (None, texts[301], None)], "doc_id long, text string, source_type string")
    assert {r.doc_id for r in subjects.assign_subjects(docs, m).collect()} == {big, None}
