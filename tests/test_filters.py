import pytest

from waymark.operators import filters
from waymark.plans.filter_dsl import And, FilterError, Key, Not, Or, estimate, from_list, leaf_keys, parse_filter


@pytest.mark.parametrize("text, want", [
    ("tag:work", Key("tag:work")), ("folder:crates/x-y", Key("folder:crates/x-y")), ("lang:rust:stable", Key("lang:rust:stable")),
    ("a:1 AND b:2 AND c:3", And((Key("a:1"), Key("b:2"), Key("c:3")))), ("a:1 and b:2", And((Key("a:1"), Key("b:2")))), ("NOT NOT x:1", Not(Not(Key("x:1")))),
    ("x:1 OR y:2 AND z:3", Or((Key("x:1"), And((Key("y:2"), Key("z:3")))))), ("(x:1 OR y:2) AND z:3", And((Or((Key("x:1"), Key("y:2"))), Key("z:3")))),
    ("  tag :work  ", Key("tag:work")), ("AND:x", Key("AND:x")),
])
def test_parse(text, want):
    assert parse_filter(text) == want


@pytest.mark.parametrize("text, kind", [
    ("work", "BareTerm"), ("", "UnexpectedEof"), ("  ", "UnexpectedEof"), ("()", "EmptyParens"), ("(x:1 AND y:2", "UnclosedParen"), ("x:1 OR", "UnexpectedEof"), ("x:1 AND", "UnexpectedEof"),
    ("tag:", "EmptyValue"), ("tag: work", "EmptyValue"), ("x:1 AND AND y:2", "UnexpectedToken"), ("x:1 y:2", "UnexpectedToken"),
])
def test_errors(text, kind):
    with pytest.raises(FilterError) as e:
        parse_filter(text)
    assert e.value.kind == kind


def test_helpers():
    f = parse_filter("a:1 AND NOT (b:2 OR a:1)")
    assert leaf_keys(f) == ["a:1", "b:2", "a:1"]
    sizes = {"a:1": 5, "b:2": 9}
    assert estimate(parse_filter("a:1 AND b:2"), sizes) == 5 and estimate(parse_filter("a:1 OR b:2"), sizes) == 14 and estimate(And(()), sizes) == 0
    assert from_list(["a:1"]) == Key("a:1") and from_list(["a:1", "b:2"], "or") == Or((Key("a:1"), Key("b:2")))


@pytest.fixture
def keys(spark):
    rows = [(1, "tag:work"), (2, "tag:work"), (3, "tag:personal"), (1, "type:task"), (1, "folder:/vault/work"), (2, "folder:/vault/work"), (3, "folder:/vault/archive"), (1, "source:obsidian"), (2, "source:obsidian"), (3, "source:obsidian"), (3, "source:obsidian")]
    return spark.createDataFrame(rows, "doc_id long, bitmap_key string")


@pytest.mark.parametrize("f, want", [
    ("tag:work", [1, 2]), ("tag:work AND type:task", [1]), ("tag:work OR tag:personal", [1, 2, 3]), ("NOT tag:work", [3]), ("tag:work AND NOT folder:/vault/archive", [1, 2]), ("tag:nonexistent", []),
    ("NOT tag:nonexistent", [1, 2, 3]), ("NOT (tag:work AND NOT type:task)", [1, 3]),
])
def test_match(keys, f, want):
    assert sorted(r[0] for r in filters.match(keys, f).collect()) == want


def test_empty_and_tombstones(spark, keys):
    gone = spark.createDataFrame([(1,), (1,), (9,)], "doc_id long")
    assert [r[0] for r in filters.match(keys, "tag:work", None, gone).collect()] == [2]
    assert filters.match(keys, Or(())).isEmpty() and filters.match(keys, Not(And(()))).count() == 3
    rows = filters.page(filters.match_all(keys), 1, 1).collect()
    assert [tuple(r) for r in rows] == [(2, 3)]
    nothing = keys.limit(0)
    assert filters.match(nothing, "tag:work").isEmpty() and filters.match_all(nothing).isEmpty() and filters.jaccard(nothing, "a:1", "b:2").first().jaccard == 0.0
