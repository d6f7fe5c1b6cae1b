import itertools
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from waymark.llm import pii
from waymark.llm.pii import NAME, TYPES, Field, find_and_mask, fit_field, label_texts, mask, propagate, sample_texts

DATA = "/root/testdata/sf0.01/slack_messages.parquet"
CASES = {
    "write to anna_3@mail.example now": {"email"}, "x+alerts @ desk.invalid bounced": {"email"}, "o_65 [at] corp [dot] example": {"email"}, "m.day (at) example.net": {"email"}, "<mailto:a@b.example|a@b.example>": {"email"},
    "git@code.invalid:desk/raven.git": set(), "pkg@1.2.5 broke": set(), "ping @orchid.almanac130": set(),
    "ring (555) 555-0147, ask": {"phone"}, "tel. +44 20 7946 0392": {"phone"}, "call +15550107562": {"phone"}, "mobile: 555-0114": {"phone"}, "text me on 01 99 00 79 79": {"phone"}, "my new number is 0049 30 23125357": {"phone"}, "ring 555 01 87, ask": {"phone"},
    "row count 625 582 833": set(), "epoch 1732567388": set(), "build 987-45-6 is green": set(), "invoice 2024-00558 was paid": set(), "host 192.0.2.75 port 2609": set(), "on 2025-04-22 at 13:48": set(), "version 4.15.1": set(), "ticket OPS-5095": set(), "part no. QX-50772": set(), "commit 86069002a1": set(), "room 12, floor 3": set(),
    "SSN on file is 987-65-4328": {"id_number"}, "the ssn: 987654324": {"id_number"}, "social security 000 19 2258": {"id_number"}, "NI number QQ 66 40 53 C": {"id_number"}, "Steuer-ID 00 809 672 767": {"id_number"}, "DNI 00007266T": {"id_number"}, "passport no. X0037050": {"id_number"}, "driver's licence D000-1321-2195": {"id_number"}, "Personalausweis L00X23694": {"id_number"}, "the passport stamp is late": set(),
    "ship it to 167 Tallow Lane, Valmorin 00571": {"address"}, "Fichtenweg 141b, 00427 Valmorin": {"address"}, "43 rue des Tilleuls, 00493 Kestrelford": {"address"}, "Calle Tallow 216, 2º B, Dunholt": {"address"}, "PO Box 160, Neuhafen": {"address"}, "at 64 quarrel street, dunholt now": {"address"}, "lane 9 on the board": set(),
    "cc Felix Brackgard": {"person_name"}, "ask leila umbako about it": {"person_name"}, "meeting with Dr. Veltovic went well": {"person_name"}, "regards, GRETA GRENNANIS": {"person_name"}, "customer name: Tarrbarrow, Elena": {"person_name"}, "ask Herr van der Stevvmere about it": {"person_name"}, "spoke with Emil T. Wexmere": {"person_name"},
    "Maria is fine with that": set(), "see the Saffron Ledger page": set(), "Team North and Team South agreed": set(), "Grey Falcon cluster": set(), "the Blue Harbor release": set(), "maria will do it": set(), "": set(), "   ": set(),
}


#: Names and forms that neither the lists nor the test tables hold.
STRANGE = {
    "Kwame Boateng will call": {"person_name"}, "Siobhan O'Reilly": {"person_name"}, "cc Nguyen Thi Mai": {"person_name"}, "Aoife Byrne joined": {"person_name"}, "ring 07700 900123": {"phone"}, "phone 415 555 2671": {"phone"},
    "we live at 1600 Pennsylvania Avenue NW, Washington, DC 20500": {"address"}, "IBAN DE89 3704 0044 0532 0130 00": set(), "later Nambiar came": set(), "Team Walnut and Team Copper agreed": set(), "see the Saffron Copper page": set(),
}


@pytest.fixture(scope="module")
def texts():
    return sorted({t for t in pq.read_table(DATA, columns=["text"])["text"].to_pylist() if t and t.strip()})


@pytest.fixture(scope="module")
def field(texts):
    return fit_field(texts[: pii.SAMPLE])


@pytest.mark.parametrize("text", CASES | STRANGE)
def test_types(text, field):
    assert {t for _, _, t in label_texts([text], field)[0]} == (CASES | STRANGE)[text]


def test_a_second_mention_is_known_by_the_first(field):
    text = "Priya Nambiar said ok. later Nambiar came"
    assert mask(text, label_texts([text], field)[0]) == "[PERSON_NAME] said ok. later [PERSON_NAME] came"
    apart = field.without_edges(pii.REPEATED, pii.ALIKE)
    assert mask(text, label_texts([text], apart)[0]) == "[PERSON_NAME] said ok. later Nambiar came"


def test_mask(field):
    t = "Priya Wexmere called. Later zelda Wexmere wrote to p@x.example from Fichtenweg 3, 00427 Valmorin."
    got = mask(t, label_texts([t], field)[0])
    assert got.startswith("[PERSON_NAME] called.") and "[EMAIL]" in got and got.endswith("[ADDRESS].")


def recall(examples, field):
    """Share of the words of names, and of words found that are of one, in texts with known places."""
    v = pii.Vocabulary()
    g = pii.build_graph([t for t, _ in examples], v)
    gold = pii.gold_labels(g, [m for _, m in examples])
    found = pii.gold_labels(g, [[(a, b, TYPES.index(t) + 1) for a, b, t in x] for x in label_texts([t for t, _ in examples], field)])
    word = np.array([w[0].isalpha() for w in v.number])[g.ids]
    both = ((gold == NAME) & (found == NAME) & word).sum()
    return both / ((gold == NAME) & word).sum(), both / ((found == NAME) & word).sum()


def test_edges_matter_on_held_out_texts(texts, field):
    rng = random.Random(991)
    made = pii._Made(rng, ["garden", "cabinet", "violet", "harvest", "meadow", "lantern", "copperplate"])
    plain = [t for t in texts[pii.SAMPLE :] if not pii.rule_labels(t)]
    examples = []
    for t in plain[:1200]:
        piece, spans = (made.decoy(), []) if rng.random() < 0.4 else made.personal()
        examples.append((f"{t}. {piece}", [(a + len(t) + 2, b + len(t) + 2, k) for a, b, k in spans]))
    whole, sure = recall(examples, field)
    assert whole > 0.97 and sure > 0.97
    assert recall(examples, field.without_edges())[0] < whole - 0.03 and recall(examples, field.without_edges(pii.REPEATED, pii.ALIKE))[0] < whole - 0.015


def test_agreement_with_rules_where_rules_are_sure(texts, field):
    """On whole messages the field finds what the labelling rules mark, and little else."""
    both = more = less = 0
    for t, found in zip(texts, label_texts(texts, field), strict=True):
        got, marked = {k for _, _, k in found}, {TYPES[k - 1] for _, _, k in pii.rule_labels(t)}
        both, more, less = both + len(got & marked), more + len(got - marked), less + len(marked - got)
    assert both > 300 and more <= 0.02 * both and less <= 0.02 * both


def test_gate_changes_nothing(texts, field, monkeypatch):
    some = texts[:1500]
    want = label_texts(some, field)
    monkeypatch.setattr(pii, "SURE", 1e9)
    assert label_texts(some, field) == want


def test_messages_are_exact_on_a_tree():
    rng = np.random.RandomState(3)
    unary = rng.normal(size=(6, 4)).astype(np.float64)
    edges = rng.normal(size=(5, 6, 6))
    a, b, kind = np.array([0, 1, 1]), np.array([1, 2, 3]), np.array([0, 1, 3])
    belief, _ = propagate(unary, a, b, kind, edges, 6)
    got = np.exp(belief - belief.max(0))
    got /= got.sum(0)
    want = np.zeros((6, 4))
    for labels in itertools.product(range(6), repeat=4):
        w = np.exp(sum(unary[x, i] for i, x in enumerate(labels)) + sum(edges[k, labels[i], labels[j]] for i, j, k in zip(a, b, kind)))
        for i, x in enumerate(labels):
            want[x, i] += w
    assert np.allclose(got, want / want.sum(0), atol=1e-4)


def test_long_repeated_and_empty(field):
    t = ("plain words 12345 and nothing of the kind here, " * 3000) + "mail a@b.example"
    assert [x[2] for x in label_texts([t], field)[0]] == ["email"]
    assert label_texts([], field) == [] and label_texts(["", "   ", "x@y.example"], field)[2]
    assert label_texts(["", " "], field) == [[], []]


def test_frame(spark, field):
    rows = [(1, "a@b.example and a@c.example", "q"), (2, None, None), (3, "", "q"), (1, "a@b.example and a@c.example", "q")]
    df = spark.createDataFrame(rows, "msg_id long, text string, masked string")
    got = sorted(((r.msg_id, r.masked, r.pii_types) for r in find_and_mask(df, ["msg_id"], field=field).collect()), key=str)
    assert got == [(1, "[EMAIL] and [EMAIL]", ["email"])] * 2 + [(2, None, []), (3, "", [])]
    assert find_and_mask(df.limit(0), ["msg_id"]).isEmpty() and find_and_mask(df.where("text IS NULL"), ["msg_id"]).count() == 1


def test_sample(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts[:400] for _ in range(3)] + [("the same",)] * 2000 + [(None,), ("",)], "text string")
    got = sample_texts(df, most=100)
    assert len(got) == len(set(got)) == 100 and got == sample_texts(df.repartition(3), most=100)
    assert set(sample_texts(df, most=10_000)) == {*texts[:400], "the same"} and sample_texts(df.limit(0)) == []


def test_little_to_train_on():
    f = fit_field(["we moved the lamp to next week", "thanks"] * 30, steps=5)
    assert label_texts(["mail a@b.example"], f)[0] and fit_field([], steps=2).features


def test_keys_are_kept(spark, field):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "a@b.example"), (None, "a@b.example")], "msg_id long, text string")
    assert {r.msg_id for r in find_and_mask(df, ["msg_id"], field=field).collect()} == {big, None}


def test_a_field_without_weights_finds_nothing():
    assert label_texts(["mail a@b.example"], Field()) == [[]]
