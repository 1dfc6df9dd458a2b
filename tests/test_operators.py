import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.catalog import Attribute, EntitySchema, Relation
from quillstone.operators import changes, layout, search, validation
from quillstone.operators.conditions import ConditionError, Group, Leaf, parse, render
from quillstone.operators.filters import filter_eav, filter_eav_semi, filter_entities, parse_time
from quillstone.operators.paging import Page, page_with_total, parse_sort, project, query, sort_order
from quillstone.operators.relations import enrich, missing_keys

ITEM = EntitySchema(
    "item",
    100,
    {
        a.name: a
        for a in (
            Attribute("name", 1, "text", True, "text_01"),
            Attribute("price", 2, "numeric", False, "double_01"),
            Attribute("sold", 3, "bool", False, "text_02", "bool_text"),
            Attribute("at", 4, "date", False, "text_03", "iso8601"),
            Attribute("owner.name", 5, "text"),
            Attribute("owner.age", 6, "integer"),
            Attribute("tags", 7, "text"),
            Attribute("parts.code", 8, "text"),
            Attribute("parts.size.width", 9, "numeric"),
            Attribute("parts.colours", 10, "text"),
        )
    },
    frozenset({"tags", "parts", "parts.colours"}),
)
KIND = "row_id string, name string, price double, sold boolean, at timestamp, owner struct<name:string,age:int>, tags array<string>, parts array<struct<code:string,size:struct<width:double>,colours:array<string>>>, other string"
ROWS = [
    ("a", "ring", 10.5, True, datetime(2024, 5, 1, 12), ("Ann", 30), ["x", "y"], [("p", (1.0,), ["red", "blue"]), ("q", (None,), None)], "z"),
    ("b", "bolt", None, False, None, None, [], None, None),
    ("c", None, -3.0, None, datetime(2023, 1, 1), (None, 7), None, [("p", (2.5,), ["green"])], "z"),
    ("d", "50% off", 10.5, True, None, ("Ann", None), ["y", None], [], ""),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ROWS, KIND).cache()


def ids(df):
    return sorted(r["row_id"] for r in df.select("row_id").collect())


@pytest.mark.parametrize(
    "text",
    ['{"c": []}', '{"l": "xor", "c": []}', '{"a": "x"}', '{"a": "", "v": "1"}', '{"a": "x", "v": ""}', "{}", "[]", '{"a": "x", "v": "like:1"}', '{"a": "x", "v": ":1"}', '{"a": "x", "v": "gt:"}', '{"a": "t", "v": "2024-01-01T00:00:00Z"}'],
)
def test_bad_conditions(text):
    with pytest.raises(ConditionError):
        parse(text)


def test_conditions_read_and_write():
    tree = parse('{"l": "or", "c": [{"a": "x", "v": "gt:1:2"}, {"a": "y", "v": "z"}]}')
    assert tree == Group("or", (Leaf("x", "gt", "1:2"), Leaf("y", "equals", "z")))
    assert parse(json.dumps(render(tree))) == tree and parse(None) is None


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        ({"a": "price", "v": "not_equals:10.5"}, ["c"]),
        ({"a": "sold", "v": "0"}, ["b"]),
        ({"a": "at", "v": "lt:2024"}, None),
        ({"a": "at", "v": "gte:2024-05"}, ["a"]),
        ({"a": "name", "v": "starts_with:50%"}, ["d"]),
        ({"a": "owner.age", "v": "gte:7"}, ["a", "c"]),
        ({"a": "tags", "v": "y"}, ["a", "d"]),
        ({"a": "parts.size.width", "v": "gt:2"}, ["c"]),
        ({"a": "parts.colours", "v": "contains:re"}, ["a", "c"]),
        ({"l": "and", "c": [{"a": "parts.code", "v": "q"}, {"a": "parts.colours", "v": "red"}]}, ["a"]),
        ({"l": "or", "c": [{"a": "price", "v": "lt:0"}, {"a": "name", "v": "bolt"}]}, ["b", "c"]),
        ({"l": "or", "c": []}, ["a", "b", "c", "d"]),
    ],
)
def test_filters(items, condition, expected):
    if expected is None:
        with pytest.raises(ConditionError):
            filter_entities(items, ITEM, parse(condition))
        return
    assert ids(filter_entities(items, ITEM, parse(condition))) == expected
    eav = layout.to_eav(items, ITEM)
    assert ids(filter_eav(eav, ITEM, parse(condition))) == expected
    assert ids(filter_eav_semi(items.select("row_id"), eav, ITEM, parse(condition))) == expected


@pytest.mark.parametrize("condition", [{"a": "price", "v": "x"}, {"a": "sold", "v": "gt:1"}, {"a": "price", "v": "contains:1"}, {"a": "at", "v": "soon"}])
def test_values_must_fit(items, condition):
    with pytest.raises(ConditionError):
        filter_entities(items, ITEM, parse(condition))


def test_unknown_attribute(items):
    with pytest.raises(ValueError, match="unknown attribute"):
        filter_entities(items, ITEM, parse({"a": "nothing", "v": "1"}))


_LEAF = st.one_of(
    st.tuples(st.just("price"), st.sampled_from(["gt", "lte", "equals", "not_equals"]), st.sampled_from(["-3", "0", "10.5"])),
    st.tuples(st.sampled_from(["name", "tags", "parts.code", "parts.colours"]), st.sampled_from(["equals", "not_equals", "contains", "starts_with"]), st.sampled_from(["p", "y", "re", "bolt"])),
    st.tuples(st.just("sold"), st.just("equals"), st.sampled_from(["true", "0"])),
).map(lambda t: Leaf(*t))
_TREE = st.recursive(_LEAF, lambda c: st.builds(lambda logic, kids: Group(logic, tuple(kids)), st.sampled_from(["and", "or"]), st.lists(c, min_size=1, max_size=3)), max_leaves=5)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=_TREE)
def test_native_and_eav_filters_agree(items, tree):
    assert ids(filter_entities(items, ITEM, tree)) == ids(filter_eav(layout.to_eav(items, ITEM), ITEM, tree))


def test_times():
    assert parse_time("1714564800000") == parse_time("2024-05-01T12:00:00Z") == parse_time("2024-05-01T14:00:00+02:00")
    assert parse_time("2024-05") == parse_time("2024-05-01")


def test_sorting_puts_missing_values_last_or_first(items):
    order = lambda d: [r["row_id"] for r in items.orderBy(*sort_order(items, ITEM, ["price"], d)).collect()]
    assert order("asc") == ["c", "a", "d", "b"] and order("desc") == ["b", "a", "d", "c"]
    by_tag = [r["row_id"] for r in items.orderBy(*sort_order(items, ITEM, ["tags"])).collect()]
    assert by_tag == ["a", "d", "b", "c"]


def test_pages(items):
    assert Page.of(0, 0) == Page(1, 50) and Page.of(3, 1000) == Page(3, 100) and Page.of(None, -1, 20) == Page(1, 20)
    page = page_with_total(items, sort_order(items, ITEM, []), Page(2, 3)).collect()
    assert [(r["row_id"], r["total_records"], r["total_pages"]) for r in page] == [("d", 4, 2)]
    past = query(items, ITEM, page=Page(9, 3))
    assert past.data.count() == 0 and past.facts["total_records"] == 4 and past.facts["has_previous"] and not past.facts["has_next"]
    assert parse_sort(["a, b", "c"], None) == (["a", "b", "c"], "asc")
    for names, order in (([], "asc"), (["a"], "up")):
        with pytest.raises(ConditionError):
            parse_sort(names, order)


def test_projection(items):
    found = project(items, [" owner.name", "price", "missing", "tags.x"])
    assert found.columns == ["row_id", "price", "owner"] and found.schema["owner"].dataType.names == ["name"]
    assert project(items, []).columns == items.columns
    assert project(items, ["owner", "owner.age"]).schema["owner"].dataType.names == ["name", "age"]
    assert found.where("row_id = 'b'").first()["owner"] is None


def test_eav_round_trip(items):
    eav = layout.to_eav(items, ITEM)
    got = {(r["attr_id"], r["array_indices"], r["value_text"], r["value_numeric"]) for r in eav.where("row_id = 'a'").collect()}
    assert {(10, "0,1", "blue", None), (9, "0", None, 1.0), (3, "", None, 1.0), (4, "", None, 1714564800000.0), (7, "1", "y", None)} <= got and len(got) == 13
    back = {r["row_id"]: r for r in layout.from_eav(eav, ITEM).collect()}
    one = back["a"].asDict(True)
    assert one["parts"] == [{"code": "p", "colours": ["red", "blue"], "size": {"width": 1.0}}, {"code": "q", "colours": None, "size": None}]
    assert one["owner"] == {"age": 30, "name": "Ann"} and one["tags"] == ["x", "y"] and one["at"] == datetime(2024, 5, 1, 12)
    assert back["b"]["owner"] is None and back["b"]["tags"] is None and back["d"]["tags"] == ["y"]


def test_gaps_in_arrays_are_nulls(spark):
    rows = [(100, "a", 7, i, t, None) for i, t in (("2", "c"), ("10", "k"), ("0", "a"))]
    eav = spark.createDataFrame(rows, "schema_id short, row_id string, attr_id short, array_indices string, value_text string, value_numeric double")
    assert layout.from_eav(eav, ITEM).first()["tags"] == ["a", None, "c"] + [None] * 7 + ["k"]


def test_hot_layout(items):
    hot, eav = layout.split_record(items, ITEM)
    row = hot.where("row_id = 'a'").first()
    assert (row["text_01"], row["double_01"], row["text_02"], row["text_03"]) == ("ring", 10.5, "1", "2024-05-01T12:00:00Z")
    assert {r["attr_id"] for r in eav.select("attr_id").distinct().collect()} == {5, 6, 7, 8, 9, 10}
    back = {r["row_id"]: r.asDict(True) for r in layout.merge_record(hot, eav, ITEM).collect()}
    assert back["a"]["name"] == "ring" and back["a"]["sold"] is True and back["b"]["name"] == "bolt" and back["d"]["price"] == 10.5 and len(back) == 4
    decoded = {r["row_id"]: r for r in layout.from_hot(hot, ITEM).collect()}
    assert decoded["c"]["name"] is None and decoded["c"]["at"] == datetime(2023, 1, 1) and decoded["b"]["sold"] is False


def test_relations(spark):
    relation = Relation("contact", "lead", "contact", "leadId", "id", True)
    kids = spark.createDataFrame([("1", "L1"), ("2", "L9"), ("3", None), ("4", "")], "row_id string, leadId string")
    leads = spark.createDataFrame([("r1", "L1", ("old",)), ("r2", "L1", ("new",)), ("r3", None, ("none",))], "row_id string, id string, contact struct<name:string>")
    got = {r["row_id"]: r["contact"] and r["contact"]["name"] for r in enrich(kids, leads, relation).collect()}
    assert got == {"1": "new", "2": None, "3": None, "4": None}
    assert "contact" not in enrich(kids, leads, relation, ["leadId"]).columns and "contact" in enrich(kids, leads, relation, ["contact.name"]).columns
    assert ids(missing_keys(kids, relation)) == ["3", "4"]


def test_search(items, spark):
    found = search.search_all([(ITEM, items), (ITEM, items.limit(0))], term="re").collect()
    assert [(r["schema_ord"], r["row_id"]) for r in found] == [(0, "a"), (0, "c")] and json.loads(found[0]["attributes"])["name"] == "ring"
    assert search.parse_schemas(["a,b", "b", " c "]) == ["a", "b", "c"]


def test_changes(items, spark):
    made = changes.create(items.drop("row_id"), ITEM, F.lit(1_700_000_000_000))
    assert made.accepted.count() == 3 and made.rejected.first()["code"] == "CREATE_FAILED"
    row_id = made.accepted.first()["row_id"]
    assert row_id[14] == "7" and row_id.startswith("018bcfe5-6800") and len(row_id) == 36
    base = items.withColumns({"created_at": F.lit(1), "updated_at": F.lit(1)})
    patches = spark.createDataFrame(
        [("a", '{"owner": {"age": 31}, "tags": ["n"]}', 5), ("a", '{"owner": {"name": null}, "price": null}', 6), ("zz", "{}", 5), ("b", '{"owner": {"name": "B"}}', 7)],
        "row_id string, patch string, changed_at int",
    )
    after = changes.update(base, patches, ITEM)
    got = {r["row_id"]: r.asDict(True) for r in after.accepted.collect()}
    assert got["a"]["owner"] == {"name": None, "age": 31} and got["a"]["tags"] == ["n"] and got["a"]["price"] is None and got["a"]["name"] == "ring"
    assert (got["a"]["created_at"], got["a"]["updated_at"]) == (1, 6) and got["b"]["owner"] == {"name": "B", "age": None} and got["d"]["updated_at"] == 1
    assert after.rejected.collect() == [("zz", "UPDATE_FAILED", "no such row")]
    gone = changes.delete(base, spark.createDataFrame([("a",), ("a",), ("q",)], "row_id string"))
    assert ids(gone.accepted) == ["b", "c", "d"] and ids(gone.rejected) == ["q"]
    assert gone.counts().first() == (4, 3, 1)


def test_validation(items):
    schema = {
        "required": ["name"],
        "properties": {
            "name": {"type": "string", "minLength": 5},
            "price": {"exclusiveMinimum": 0},
            "tags": {"minItems": 1, "items": {"type": "string", "enum": ["x"]}},
            "owner": {"required": ["age"], "properties": {"age": {"maximum": 20}}},
        },
    }
    got = {r["row_id"]: r["v"] for r in items.select("row_id", validation.violations(items, schema).alias("v")).collect()}
    assert got["a"] == ["name: minLength", "tags[]: enum", "owner.age: maximum"]
    assert got["b"] == ["name: minLength", "tags: minItems"]
    assert got["c"] == ["name: required", "price: exclusiveMinimum"] and got["d"] == ["tags[]: enum", "owner.age: required"]
