import json

from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.operators import shred as S


def brute(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from brute(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from brute(v, f"{path}[{i}]")
    elif value is not None:
        yield path, S.as_text(value)


names = st.sampled_from(["a", "b", "items", "product_id"])
values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5).map(lambda i: S.Number(str(i))) | st.sampled_from(["x", "y"]), lambda v: st.lists(v, max_size=3) | st.dictionaries(names, v, max_size=3), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(names, values, max_size=3))
def test_levels_rebuild_every_leaf(value):
    got = []
    for path in S.leaf_paths(value):
        reps, defs, texts = S.levels(value, path)
        assert len(reps) == len(defs) == len(texts) and reps[0] == 0
        for at, v in zip(S.positions(path, reps, defs), texts, strict=True):
            if at is not None and v is not None:
                got.append((S.path_text(path, at), v))
    assert sorted(set(got)) == sorted(set(brute(value))) and len(got) == len(set(got))


def one_path(value, path):
    """Levels by their definition, from the root for one path alone."""
    out = []

    def walk(v, i, r, d):
        if i == len(path):
            empty = v is None or isinstance(v, dict | list)
            out.append((r, d + (isinstance(v, dict) if empty else bool(path) and path[-1] is None), None if empty else S.as_text(v)))
        elif path[i] is None and isinstance(v, list) and v:
            for j, x in enumerate(v):
                walk(x, i + 1, sum(s is None for s in path[: i + 1]) if j else r, d + 1)
        elif path[i] is not None and isinstance(v, dict) and v.get(path[i]) is not None:
            walk(v[path[i]], i + 1, r, d + 1)
        else:
            out.append((r, d, None))

    walk(value, 0, 0, 0)
    return out


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(names, values, max_size=3), st.booleans())
def test_all_columns_at_once_equal_one_by_one(value, objects):
    for path, column in S.columns(value, objects=objects).items():
        assert list(zip(*column, strict=True)) == one_path(value, path)
    below = S.columns(value, [("items",)], objects)
    assert below == {p: c for p, c in S.columns(value, objects=objects).items() if p[:1] == ("items",)}


def test_json_text_numbers_and_unreadable(spark):
    bodies = [
        ("r1", '{"items": "[{\\"product_id\\": 1.0, \\"q\\": [1, null]}]", "order_id": 7}'),
        ("r2", '{"items": {"product_id": "12"}}'),
        ("r3", '{"items": [{"components": [{"product_id": 5}, null, {"product_id": null}]}]}'),
        ("r4", '{"items": [{"produ'),
        ("r5", None),
        ("r6", '"{\\"items\\": [{\\"product_id\\": 3}]}"'),
        ("r7", "[" * 100000),
        ("r8", '{"items": [' + ",".join('{"product_id": %d}' % i for i in range(5000)) + "]}"),
    ]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in bodies], "record_id string, body string, leaf_path string, reps int")
    out = [(r.record_id, r.node_path, r.leaf_value) for r in S.rebuild(S.shred(df, roots=[("items",)]), "product_id").collect()]
    assert len([o for o in out if o[0] == "r8"]) == 5000 and ("r8", "items[4999].product_id", "4999") in out
    assert sorted(o for o in out if o[0] != "r8") == [("r1", "items[0].product_id", "1.0"), ("r2", "items.product_id", "12"), ("r3", "items[0].components[0].product_id", "5"), ("r6", "items[0].product_id", "3")]
    assert {r.record_id for r in S.unreadable(df).collect()} == {"r4", "r5", "r7"}
    flat = {(r.record_id, r.row_path): (r.parent_path, r.place, r.product_id) for r in S.flat_table(S.shred(df.filter("record_id < 'r8'"), roots=[("items",)]), ["product_id"]).collect()}
    assert flat["r3", "items[0].components[0]"] == ("items[0]", 0, "5")


def test_rows_without_any_field_keep_the_links_whole(spark):
    bodies = [
        ("a", '{"items": [{"group": "g", "items": [{"product_id": 1}, {"price": 2}]}, null, {"product_id": null}, {"options": {"marks": [{"at": 1}]}}]}'),
        ("b", '{"items": {}}'),
        ("c", '{"items": []}'),
        ("d", '{"items": {"product_id": 4, "via": {"components": [{"quantity": 3}]}}}'),
    ]
    df = spark.createDataFrame(bodies, "record_id string, body string")
    got = {tuple(r) for r in S.flat_table(S.shred(df, roots=[("items",)], objects=True), ["product_id", "quantity"]).collect()}
    assert got == {
        ("a", "items[0]", "", 0, None, None), ("a", "items[0].items[0]", "items[0]", 0, "1", None), ("a", "items[0].items[1]", "items[0]", 1, None, None), ("a", "items[2]", "", 2, None, None), ("a", "items[3]", "", 3, None, None),
        ("b", "items", "", None, None, None), ("d", "items", "", None, "4", None), ("d", "items.via.components[0]", "items", 0, None, "3"),
    }


def test_empty(spark):
    df = spark.createDataFrame([], "record_id string, body string")
    assert S.rebuild(S.shred(df)).count() == 0 and S.flat_table(S.shred(df), ["x"]).count() == 0


def test_whole_tables(spark, sf):
    from catalith.plans.problems import p2_found
    from catalith.sources.tables import table

    got = {tuple(r) for r in p2_found(spark, sf).collect()}
    want = set()
    for name, root, leaf in (("complex_orders", "items", "product_id"), ("nested_config", "config.database", "host")):
        for r in table(spark, sf, name).collect():
            try:
                v = S.decode(r.body)
            except ValueError:
                continue
            for path, text in brute(v):
                if path.replace("[", ".").startswith(root + ".") and path.rsplit(".", 1)[-1] == leaf:
                    want.add((r.record_id, path, text))
    assert got == want and len(got) > 50
    assert json.dumps(sorted(got)[:1])
