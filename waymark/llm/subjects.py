"""Problem 10: the subject areas of each document, by classifier chains over its sentences.

From the hand-labelled sample, sentences get their subjects by expectation-maximisation:
a sentence belongs to one of its document's labels, to nothing in particular, or, with a
small probability, to any other subject (labels may be wrong, and texts digress). That
gives the weight of every word and word pair for every subject. A document is described
by how many of its sentences deal with each subject, by its source kind and by its
structure; a chain of logistic classifiers, each seeing the labels decided before it,
turns that into label combinations. Its probabilities are calibrated on folds not
trained on, and the likeliest combination is found by beam search; of its subjects those remain that enough sentences deal with.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.fitting import logistic

#: Labelled documents that the classifiers are fitted on, at most, and the longest text among them in bytes; subjects, of which more are an error.
MAX_LABELLED, MAX_LABELLED_BYTES, MAX_SUBJECTS = 8_000, 20_000, 1_000
#: Words and word pairs rarer than this in the sample get no weight.
LEAST_DOCS = 2
ROUNDS, OTHER, NOTHING, SMOOTH = 10, 0.02, 0.25, 0.3
#: Least weight of a term while sentences are sorted out and in the end, greatest weight, and what a sentence without any term weighs for no subject.
LEAST, FIRM, MOST, EVEN = 0.8, 1.6, 4.0, 1.0
#: Sentences that a subject must have, and the subject that program code has without any.
SENTENCES, OF_CODE = 2, "software"
BEAM = 6
KINDS = ("code", "confluence", "jira", "obsidian", "slack")

_WORD = re.compile(r"[㐀-鿿豈-﫿々]+|[゠-ヿ]+|[^\W\d_ぁ-ゟ㐀-鿿豈-﫿々゠-ヿ]+|[.!?](?=\s|$)|[。！？\n]|<[^<>\n]*>")
_ENDS = frozenset(".!?。！？\n")
#: Lines that only program code has.
_CODE = re.compile(r"^[ \t]*(?:(?:pub |export |async |static )*(?:def|fn|function|class|impl|struct|import|from|use|const|let|var|return)\b.*[({;:]|.*[{;]|\})[ \t]*$|^[ \t]*(?:from \S+ import |import \S+)", re.M)


def words_of(text: str) -> list[str]:
    """Lower-case words in order, with "\\n" wherever a sentence ends."""
    return ["\n" if w in _ENDS or w[0] == "<" else w for w in _WORD.findall(text.lower())]


def structure_of(text: str) -> tuple[float, float]:
    """Share of lines that are code, and whether any is."""
    lines = text.count("\n") + 1
    n = sum(1 for _ in _CODE.finditer(text))
    return n / lines, float(n >= 3)


@dataclass
class Batch:
    """Texts as arrays: the word ids of all sentences in turn, and whose they are."""

    word: np.ndarray
    sentence: np.ndarray
    doc_of_sentence: np.ndarray
    n_docs: int


def to_batch(texts: Sequence[str | None], ids: dict[str, int]) -> Batch:
    """Words without an id are -1; they still part word pairs."""
    flat: list[int] = []
    ends, get = [], ids.get
    for t in texts:
        if t:
            flat.extend([-2 if w == "\n" else get(w, -1) for w in words_of(t)])
        flat.append(-2)
        ends.append(len(flat))
    a = np.fromiter(flat, np.int32, len(flat))
    doc = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
    stop = a == -2
    number = np.cumsum(stop) - stop
    keep = ~stop
    number, word, doc = number[keep], a[keep], doc[keep]
    new = np.append(True, number[1:] != number[:-1]) if len(number) else np.empty(0, bool)
    return Batch(word, np.cumsum(new) - 1, doc[new], len(texts))


@dataclass
class Terms:
    """The words and word pairs that have weights: pairs as first id * number of words + second id."""

    ids: dict[str, int]
    pairs: np.ndarray

    def __len__(self) -> int:
        return len(self.ids) + len(self.pairs)

    def found(self, b: Batch, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, term) for every distinct term of every sentence, of ``useful`` ones (a flag per term) only if given."""
        n = len(self.ids)
        known = b.word >= 0
        if useful is not None:
            known &= useful[b.word]
        s, t = [b.sentence[known]], [b.word[known].astype(np.int64)]
        if len(self.pairs) and len(b.word) > 1:
            both = (b.word[:-1] >= 0) & (b.word[1:] >= 0) & (b.sentence[:-1] == b.sentence[1:])
            code = b.word[:-1][both].astype(np.int64) * n + b.word[1:][both]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            hit = self.pairs[at] == code
            if useful is not None:
                hit &= useful[n + at]
            s.append(b.sentence[:-1][both][hit])
            t.append(n + at[hit])
        key = np.sort(np.concatenate(s).astype(np.int64) * len(self) + np.concatenate(t), kind="stable") if len(self) else np.empty(0, np.int64)
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        return key // max(1, len(self)), key % max(1, len(self))


def learn_terms(texts: Sequence[str]) -> Terms:
    """All words and adjacent word pairs in at least LEAST_DOCS of the texts."""
    split = [words_of(t) for t in texts]
    seen = Counter(w for ws in split for w in set(ws))
    ids = {w: i for i, w in enumerate(sorted(w for w, c in seen.items() if c >= LEAST_DOCS and w != "\n"))}
    n = len(ids)
    pairs: Counter[int] = Counter()
    for ws in split:
        a = [ids.get(w, -1) for w in ws]
        pairs.update({x * n + y for x, y in zip(a, a[1:], strict=False) if x >= 0 and y >= 0})
    return Terms(ids, np.array(sorted(p for p, c in pairs.items() if c >= LEAST_DOCS), dtype=np.int64))


def learn_weights(b: Batch, terms: Terms, labels: np.ndarray) -> np.ndarray:
    """How strongly each term speaks for each subject: terms x subjects, 0 for most.

    A term's weight is the log odds of the subject among the sentences it stands in,
    if those are well beyond even odds; a word that every subject uses has none, in whatever language.
    """
    n_sub = labels.shape[1]
    s, t = terms.found(b)
    n_sent = len(b.doc_of_sentence)
    mine = labels[b.doc_of_sentence]
    prior = np.where(mine > 0, (1 - NOTHING) / np.maximum(1, mine.sum(1, keepdims=True)), OTHER / n_sub)
    prior = np.concatenate([prior, np.full((n_sent, 1), NOTHING)], 1)
    prior /= prior.sum(1, keepdims=True)
    total = np.bincount(t, minlength=len(terms))
    post, weights = prior, np.zeros((len(terms), n_sub))
    for k in range(ROUNDS):
        held = (1 - NOTHING) if k == 0 else 1.0  # at first every sentence still holds some of nothing
        mass = np.stack([np.bincount(t, weights=post[s, c], minlength=len(terms)) for c in range(n_sub)], 1) / held
        p = np.clip((mass + SMOOTH / n_sub) / (np.maximum(total, mass.sum(1))[:, None] + SMOOTH), 1e-3, 1 - 1e-3)
        weights = np.clip(np.log(p / (1 - p)), 0, MOST)
        weights[weights < (LEAST if k < ROUNDS - 2 else FIRM)] = 0
        score = np.log(prior)
        score[:, -1] += EVEN
        for c in range(n_sub):
            score[:, c] += np.bincount(s, weights=weights[t, c], minlength=n_sent)
        score -= score.max(1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(1, keepdims=True)
    return weights.astype(np.float32)


@dataclass
class Chain:
    """Logistic classifiers in order; each row holds weights for features, earlier labels and a constant."""

    order: list[int]
    weights: list[np.ndarray] = field(default_factory=list)
    calibration: list[tuple[float, float]] = field(default_factory=list)

    def logits(self, k: int, own: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.concatenate([own, before, np.ones((*before.shape[:-1], 1))], -1) @ self.weights[k]

    def decode(self, features: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The likeliest label combination of each document: documents x subjects, 0 or 1."""
        n, n_sub = features.shape[0], len(self.order)
        combos, score = np.zeros((n, 1, n_sub)), np.zeros((n, 1))
        for k, c in enumerate(self.order):
            own = np.repeat(features[:, None, c, :], combos.shape[1], 1)
            a, shift = self.calibration[k] if self.calibration else (1.0, 0.0)
            z = a * self.logits(k, own, combos) + shift
            yes, no = score - np.logaddexp(0, -z), score - np.logaddexp(0, z)
            with_c = combos.copy()
            with_c[:, :, c] = 1
            combos, score = np.concatenate([combos, with_c], 1), np.concatenate([no, yes], 1)
            best = np.argsort(-score, 1, kind="stable")[:, :beam]
            combos, score = np.take_along_axis(combos, best[:, :, None], 1), np.take_along_axis(score, best, 1)
        return combos[:, 0]


def fit_chain(features: np.ndarray, labels: np.ndarray, folds: int = 4) -> Chain:
    """The chain, in order of falling frequency, with each classifier calibrated (Platt) on folds left out."""
    order = sorted(range(labels.shape[1]), key=lambda c: (-labels[:, c].sum(), c))
    chain, fold, hidden = Chain(order), np.arange(len(labels)) % folds, np.zeros_like(labels, dtype=float)
    for k, c in enumerate(order):
        x = np.concatenate([features[:, c], hidden, np.ones((len(labels), 1))], 1)
        y = labels[:, c].astype(float)
        chain.weights.append(logistic(x, y))
        out = np.zeros(len(y))
        for f in range(folds):
            out[fold == f] = x[fold == f] @ logistic(x[fold != f], y[fold != f])
        smooth = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = logistic(np.stack([out, np.ones(len(y))], 1), smooth, ridge=0.01)
        chain.calibration.append((float(max(a, 0.2)), float(b)))
        hidden = hidden.copy()
        hidden[:, c] = y
    return chain


@dataclass
class Model:
    subjects: list[str]
    terms: Terms
    weights: np.ndarray
    chain: Chain | None = None

    def sentence_subjects(self, b: Batch, weights: np.ndarray | None = None) -> np.ndarray:
        """Sentences x (subjects, nothing): the probability of each."""
        w = self.weights if weights is None else weights
        s, t = self.terms.found(b, w.any(1))
        score = np.zeros((len(b.doc_of_sentence), len(self.subjects) + 1))
        score[:, -1] = EVEN
        if len(s):
            at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            used = s[at]
            score[used, :-1] += np.add.reduceat(w[t], at, axis=0)
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(1, keepdims=True)

    def features(self, b: Batch, texts: Sequence[str | None], kinds: Sequence[str | None], weights: np.ndarray | None = None) -> np.ndarray:
        """Documents x subjects x features; the last one is the number of sentences that deal with the subject."""
        p = self.sentence_subjects(b, weights)
        n_sub = len(self.subjects)
        sure = np.zeros((b.n_docs, n_sub))
        best = np.zeros((b.n_docs, n_sub, 3))  # the three likeliest sentences for each subject
        first = np.flatnonzero(np.append(True, b.doc_of_sentence[1:] != b.doc_of_sentence[:-1])) if len(p) else np.empty(0, np.int64)
        used = b.doc_of_sentence[first]
        for c in range(n_sub):
            sure[:, c] = np.bincount(b.doc_of_sentence, weights=p[:, c] > 0.5, minlength=b.n_docs)
            falling = p[np.lexsort((-p[:, c], b.doc_of_sentence)), c]
            for k in range(3):
                there = np.append(first[1:], len(falling)) - first > k
                best[used[there], c, k] = falling[first[there] + k]
        n = np.bincount(b.doc_of_sentence, minlength=b.n_docs)
        shape = np.array([structure_of(t) if t else (0.0, 0.0) for t in texts]).reshape(b.n_docs, 2)
        kind = np.array([[float(k == x) for x in KINDS] for k in kinds]).reshape(b.n_docs, len(KINDS))
        common = np.concatenate([kind, shape, np.log1p(n)[:, None] / 3], 1)
        own = np.concatenate([best, np.stack([sure >= 2, sure >= 3, np.log1p(sure), sure / np.maximum(1, n)[:, None]], 2)], 2)
        return np.concatenate([own, np.repeat(common[:, None, :], n_sub, 1), sure[:, :, None]], 2)

    def predict(self, texts: Sequence[str | None], kinds: Sequence[str | None]) -> np.ndarray:
        """Documents x subjects, 0 or 1: what the chain decodes, confirmed by the number of sentences."""
        b = to_batch(texts, self.terms.ids)
        f = self.features(b, texts, kinds)
        enough = f[:, :, -1] >= SENTENCES
        if OF_CODE in self.subjects:
            enough[[k == "code" for k in kinds], self.subjects.index(OF_CODE)] = True
        out = self.chain.decode(f[:, :, :-1]) * enough
        filled = np.array([bool(t and t.strip()) for t in texts], dtype=bool)
        return out * filled[:, None]


def fit(texts: Sequence[str], kinds: Sequence[str | None], labels: np.ndarray, subjects: Sequence[str]) -> Model:
    """The whole model from labelled texts; labels is texts x subjects, 0 or 1."""
    terms = learn_terms(texts)
    b = to_batch(texts, terms.ids)
    model = Model(list(subjects), terms, learn_weights(b, terms, labels))
    half = np.arange(len(texts)) % 2
    features = np.zeros(0)
    for h in (0, 1):  # features for the chain come from weights that these documents had no part in
        own = np.flatnonzero(half == h)
        rest = np.flatnonzero(half != h)
        other = learn_weights(to_batch([texts[i] for i in rest], terms.ids), terms, labels[rest])
        f = model.features(to_batch([texts[i] for i in own], terms.ids), [texts[i] for i in own], [kinds[i] for i in own], other)
        if not features.size:
            features = np.zeros((len(texts), *f.shape[1:]))
        features[own] = f
    model.chain = fit_chain(features[:, :, :-1], labels)
    return model


def labelled_sample(documents: DataFrame, subject_labels: DataFrame, subjects: DataFrame, most: int = MAX_LABELLED) -> pd.DataFrame:
    """At most ``most`` labelled documents, chosen by a hash of their id: text, source_type, subjects.

    Repeated labels count once; labels of unknown subjects and of missing or blank documents aren't used.
    """
    known = subject_labels.join(subjects.select("subject").distinct(), "subject", "left_semi")
    per_doc = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    chosen = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a bounded number of rows from here on
    texts = documents.select("doc_id", "text", "source_type").where((F.octet_length("text") <= MAX_LABELLED_BYTES) & F.col("text").rlike(r"\S"))
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()


def train(documents: DataFrame, subject_labels: DataFrame, subjects: DataFrame, most: int = MAX_LABELLED) -> Model | None:
    """A model from the labelled sample; None where there are fewer than two labelled documents. More than MAX_SUBJECTS subjects are an error."""
    names = sorted(r[0] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    sample = labelled_sample(documents, subject_labels, subjects, most)
    if len(sample) < 2 or not names:
        return None
    at = {s: i for i, s in enumerate(names)}
    y = np.zeros((len(sample), len(names)))
    for i, found in enumerate(sample.subjects):
        y[i, [at[s] for s in found]] = 1
    return fit(list(sample.text), list(sample.source_type), y, names)


def assign_subjects(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, subject: a row for every subject of every document; repeated documents give repeated rows."""
    picked = documents.select(F.col("doc_id").cast("long"), "text", "source_type")
    schema = "doc_id long, subject string"
    if model is None:
        return picked.sparkSession.createDataFrame([], schema)
    shared = picked.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.subjects, pa.string())
        for whole in batches:
            for lo in range(0, whole.num_rows, 1_000):
                b = whole.slice(lo, 1_000)
                d, c = np.nonzero(m.predict(b.column("text").to_pylist(), b.column("source_type").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), names.take(pa.array(c))], ["doc_id", "subject"])

    return picked.mapInArrow(run, schema)
