import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm.splitting import depths, split, split_chunks


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab .\né日!?"), max_size=600), st.sampled_from([(30, 0), (60, 20), (100, 30), (100, 0)]))
def test_pieces(s, how):
    limit, overlap = how
    b = s.encode()
    p = split(b, limit, overlap)
    if not b:
        assert p == []
        return
    assert p[0][0] == 0 and p[-1][1] == len(b) and all(y - x <= limit for x, y, _ in p)
    for (a, e, _), (a2, e2, _) in zip(p, p[1:]):
        assert a < a2 <= e < e2 and e - a2 <= 2 * overlap
    for a, e, _ in p:
        b[a:e].decode()  # whole characters


def test_topic_boundary():
    one = "The oven needs dough and flour. Bake the dough with flour in the oven. More flour makes dough firm. "
    two = "The court heard the judge and lawyer. A lawyer asked the judge about the court. The judge left court. "
    b = (one * 2 + two * 2).encode()
    assert split(b, 300, 0)[0][1] == len(one.encode()) * 2
    assert depths([0.5, 0.1, 0.6]) == [0.0, pytest.approx(0.9), 0.0] and depths([]) == []
    assert [k for _, _, k in split(b"x" * 500, 200, 20)] == ["character"] * 2 + ["end"] and split(b"word " * 100, 200, 20)[0][2] == "word"
    with pytest.raises(ValueError):
        split(b"x", 10, 9)


def test_chunks(spark):
    text = "One sentence here. " * 200
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "short", "x"), (4, "é" * 1000, "x")], "doc_id long, text string, label string")
    n = len(text)
    rows = [(1, 1, 0, n, "a", 1), (1, 1, 0, n, "a", 1), (2, 1, 0, 1500, "b", 1), (3, 1, 0, 1501, None, None), (4, 1, n - 100, n + 9000, "c", 0), (5, 2, 0, 9000, "d", 0), (6, 3, 0, 9000, "e", 0), (7, 4, 0, None, "f", 2), (8, 9, 0, 9000, "g", 0), (9, 1, n - 1501, None, "h", 0), (10, 1, 500, 500, "i", 0), (11, 1, None, None, "j", 0)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, byte_start long, byte_end long, label string, depth int")
    got = split_chunks(chunks, docs).collect()
    assert {r.chunk_id for r in got} == {1, 3, 7, 9, 11} and all(r.byte_end - r.byte_start <= 1500 for r in got)
    third = [r for r in got if r.chunk_id == 3]
    assert all(r.label is None and r.depth is None for r in third) and min(r.byte_start for r in third) == 0 and max(r.byte_end for r in third) == 1501
    assert sorted(r.piece for r in got if r.chunk_id == 1) == list(range([r for r in got if r.chunk_id == 1][0].n_pieces))
    assert max(r.byte_end for r in got if r.chunk_id == 9) == n and split_chunks(chunks.limit(0), docs).isEmpty() and split_chunks(chunks, docs.limit(0)).isEmpty()


def test_keys_are_kept(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "word " * 900), (None, "word " * 900)], "doc_id long, text string")
    chunks = spark.createDataFrame([(big, big, 0, None, "a", None), (None, big, 5, None, None, 1), (7, None, 0, None, "x", 1)], "chunk_id long, doc_id long, byte_start long, byte_end long, label string, depth int")
    got = split_chunks(chunks, docs).collect()
    assert {(r.chunk_id, r.doc_id, r.depth) for r in got} == {(big, big, None), (None, big, 1)}


def test_an_early_sentence_end_goes_before_a_word_cut():
    b = b"A sentence of some words ends here. " * 14 + b"word " * 600
    last = b.rindex(b"here. ") + 6
    pieces = split(b)
    assert pieces[0][:2] == (0, last) and pieces[0][2] == "topic" and last < 600 and all(y - x <= 1500 for x, y, _ in pieces) and pieces[-1][1] == len(b)
    assert all(kind == "word" for _, _, kind in pieces[1:-1])
