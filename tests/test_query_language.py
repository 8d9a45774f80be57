import pytest
from hypothesis import given
from hypothesis import strategies as st

from wayfare.plans.query import (
    IN, OUT, EdgeStep, Predicate, QueryError, parse_batch, parse_bfs, parse_path, parse_predicate, parse_reach, split_outside, without_access_flag,
)


def test_predicates():
    assert parse_predicate("c:string[US]") == Predicate("c", "US")
    assert parse_predicate("n:int[007]").text == "7"
    assert parse_predicate("x:double[1]").text == "1.0"
    assert parse_predicate("x:strange[a]").type == "string"
    for bad in ("c", "c:string", "c:string[US", "c:int[x]", ":string[a]"):
        with pytest.raises(QueryError):
            parse_predicate(bad)


@given(st.text(alphabet="ab@:?;/ .]x", max_size=12).filter(lambda s: "[" not in s and "]" not in s))
def test_values_may_hold_separators(value):
    text = f"p:string[{value}]"
    q = parse_path(f"{text}@out?{text}@{text}//2")
    assert [p.value for p in q.vertices] == [value, value] and q.edges[0].predicate.value == value and q.start == 1
    assert parse_batch(f"{text};{text}") == [text, text]
    assert parse_bfs(f"{text}:4//0//163").roots.value == value
    assert parse_reach(f"3@{text}@{text}//1").side == 1


def test_bfs_and_reach():
    q = parse_bfs("label:string[toyota___rav_4]:4//0//163")
    assert (q.roots, q.depth) == (Predicate("label", "toyota___rav_4"), 4)
    assert parse_bfs("c:string[a:b]:0").depth == 0
    r = parse_reach("3@c:string[IN]@c:string[DE]")
    assert (r.depth, r.source.value, r.sink.value, r.side) == (3, "IN", "DE", None)
    for bad in ("c:string[a]", "c:string[a]:x", "c:string[a]:-1"):
        with pytest.raises(QueryError):
            parse_bfs(bad)
    for bad in ("3@c:string[a]", "x@c:string[a]@c:string[b]", "3@c:string[a]@c:string[b]//2"):
        with pytest.raises(QueryError):
            parse_reach(bad)
    assert without_access_flag("-ni 3@x") == "3@x" and without_access_flag("-i a") == "a"


def test_paths():
    q = parse_path("c:string[US]@out?@c:string[IN]")
    assert len(q.vertices) == 2 and q.edges == (EdgeStep(OUT),)
    q = parse_path("out?r:string[b]@in?")
    assert q.vertices == (None, None, None) and [e.direction for e in q.edges] == [OUT, IN]
    assert parse_path("c:string[US]").edges == ()
    assert parse_path("whatever?").edges[0].direction == IN
    for bad in ("c:string[a]@c:string[b]", "c:string[a]@out?@c:string[b]//1", "c:string[a]//8", "c:string[a]//x"):
        with pytest.raises(QueryError):
            parse_path(bad)


def test_split_outside():
    assert split_outside("a@b[c@d]@e", "@") == ["a", "b[c@d]", "e"]
    assert split_outside("a//b[//]//c", "//") == ["a", "b[//]", "c"]
