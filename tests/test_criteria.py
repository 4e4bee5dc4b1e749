import pytest

from aspectra import formats
from aspectra.model import Aspect, Document, Registry, Relationship
from aspectra.plans.criteria import (
    AspectField,
    Condition,
    Cursor,
    Logic,
    Page,
    RelCriterion,
    RelFilter,
    UrnField,
    flattened,
    has_more,
    normalised,
    page_count,
)
from aspectra.plans.predicates import value_list


def eq(name, value):
    return RelCriterion(UrnField(name), Condition.EQUAL, value)


def test_names():
    assert formats.path_segments(" /a/b/ ") == ["a", "b"]
    assert formats.index_column("aspectFoo", "/a/b") == "i_aspectfoo$a$b"
    assert formats.index_column("aspectFoo", "/a/b", "0") == "i_aspectfoo0a0b"
    assert formats.expression_index("foo", "/a") == "e_foo0a"
    assert formats.metadata_column("/a/b") == "metadata$a$b"
    assert formats.entity_table("Foo", test=True) == "metadata_entity_foo_test"
    assert formats.topic_name("MAE", "foo", "bar") == "MAE_foo_bar"
    assert formats.topic_name("MCE", "foo") == "MCE_foo"
    assert formats.topic_name("MCE", "foo", "", {("MCE", "foo", ""): "other"}) == "other"
    with pytest.raises(ValueError):
        formats.index_column("a", "/b", "_")


def test_flat_criteria_become_a_tree():
    a, b, c = eq("urn", "1"), eq("urn", "2"), eq("other", "3")
    assert normalised(()) is None
    assert normalised((a,)) is a
    assert normalised((a, b)) == Logic("OR", (a, b))
    assert normalised((a, c, b)) == Logic("AND", (Logic("OR", (a, b)), c))
    assert flattened(Logic("AND", (Logic("OR", (a, b)), Logic("NOT", (c,))))) == [a, b, c]


def test_filters_are_checked():
    with pytest.raises(ValueError):
        RelFilter((eq("urn", "1"),), logic=eq("urn", "1"))
    with pytest.raises(ValueError):
        RelFilter(direction="SIDEWAYS")


@pytest.mark.parametrize("total,size,pages", [(0, 10, 0), (1, 10, 1), (10, 10, 1), (11, 10, 2), (5, 0, 0)])
def test_page_count(total, size, pages):
    assert page_count(total, size) == pages


def test_pages():
    assert has_more(0, 10, 2) and not has_more(10, 10, 2)
    p = Page(None, 10, 10, 25, 10)
    assert (p.next_start, p.more, p.pages) == (20, True, 3)
    p = Page(None, 20, 10, 25, 5)
    assert (p.next_start, p.more) == (-1, False)
    assert Page(None, 0, 0, 2500, 0).pages == 3
    with pytest.raises(ValueError):
        Page(None, 20, 10, 25, 6)


@pytest.mark.parametrize(
    "last,top,stamp",
    [(-1, 5, "2024-01-01 00:00:00.000000"), (6, 5, "2024-01-01 00:00:00.000000"), (0, 5, "2024-01-01 00:00:00.000")],
)
def test_cursor_rules(last, top, stamp):
    with pytest.raises(ValueError):
        Cursor("t", last, top, stamp)


def test_search_values():
    assert value_list(" a , b,,c ") == ["a", "b", "c"]
    assert value_list("urn:li:pair:(1,2)") == ["urn:li:pair:(1,2)"]


def test_registry_rules():
    with pytest.raises(ValueError):
        Aspect("a", {"/x": "decimal"})
    with pytest.raises(ValueError):
        Relationship("r", version=3)
    r = Registry().add(Document("PizzaDocument"))
    assert r.documents["PizzaDocument"].index_name == "pizzadocument"
    with pytest.raises(ValueError):
        r.entity("nothing")
    assert Aspect("a", {"x/y": "long"}).path_type("/x/y/") == "long"
    assert AspectField("a", "b") == AspectField("a", "b")
