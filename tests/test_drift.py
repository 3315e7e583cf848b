import json
import random

from catalith.operators import drift as R


def lines(feed, no, records):
    return [(i, feed, no, i, r if isinstance(r, str) or r is None else json.dumps(r), "x") for i, r in enumerate(records)]


def test_changes(spark):
    rng = random.Random(2)
    event = lambda: rng.choice(["login", "logout", "signup"])
    f1 = [{"event": event(), "n": rng.randint(100, 900), "gone": 1.5, "t": 1, "nul": None} for _ in range(40)] + ["{broken", None, "[1]"]
    f3 = [{"evt": event(), "n": rng.randint(100, 900), "fresh": True, "t": "1", "nul": None} for _ in range(40)] + [{"t": 5}]
    rows = lines("f", 1, f1) + lines("f", 3, f3) + lines("g", 1, [{"a": 1}]) + [(0, None, 1, 0, "{}", "x"), (0, "h", None, 0, "{}", "x")]
    df = spark.createDataFrame(rows, "record_id bigint, feed string, file_no int, line_no int, body string, token string")
    got = {tuple(r) for r in R.file_changes(df).collect()}
    assert got == {("f", 3, "renamed", "event", "evt"), ("f", 3, "removed", "gone", ""), ("f", 3, "added", "", "fresh"), ("f", 3, "retyped", "t", "t")}
    assert {tuple(r) for r in R.canonical_names(R.file_changes(df)).collect()} == {("f", 3, "evt", "event")}
    out = R.unified_feed_table(df, R.file_changes(df), {"event": "string", "n": "double", "t": "int", "fresh": "int"}).collect()
    last = [r for r in out if r.file_no == 3 and r.event is not None]
    assert len(last) == 40 and all(r.n >= 100 for r in last)
    assert all(r.failed_casts == ["fresh=true"] for r in last)


def test_every_value_is_in_a_column_or_in_the_map(spark):
    words = ["login", "logout", "signup"]
    f = lines("f", 1, [{"event": words[i % 3], "n": i, "Feed": "own"} for i in range(30)]) + lines("f", 2, [{"evt": words[i % 3], "n": i} for i in range(30)])
    g = lines("g", 1, [{"evt": words[0], "n": "many"}, {"evt": words[1], "event": words[2], "nul": None}])
    df = spark.createDataFrame(f + g, "record_id bigint, feed string, file_no int, line_no int, body string, token string")
    stats, changes = R.file_statistics(df), R.file_changes(df)
    schema, column = R.derived_schema(stats, changes, ("event",))
    assert schema == {"event": "string", "n": "bigint"} and column == {"event": "event", "evt": "event", "n": "n"}
    out = R.unified_feed_table(df, changes, schema, column).collect()
    got = {(r.event, r.n, tuple(r.failed_casts), tuple(r.rest.items())) for r in out if r.feed == "g"}
    assert got == {("login", None, ("n=many",), ()), ("signup", None, (), (("evt", "logout"),))}
    assert all(r.rest == {"Feed": "own"} for r in out if (r.feed, r.file_no) == ("f", 1)) and all(r.event in words for r in out)


def test_empty_and_ties(spark):
    schema = "record_id bigint, feed string, file_no int, line_no int, body string"
    assert R.file_changes(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "f", 1, 1, '{"a": 1}'), (2, "f", 1, 2, '{"a": "x"}'), (3, "f", 2, 1, '{"a": 2}'), (4, "f", 3, 1, "no")], schema)
    assert {tuple(r) for r in R.file_changes(df).collect()} == {("f", 2, "retyped", "a", "a"), ("f", 3, "removed", "a", "")}


def test_unlike_fields_are_no_renames(spark):
    """Fields that go while others of the same type come: none carries the other's kind of content."""
    rng = random.Random(7)
    pick = lambda *words: rng.choice(words)
    old = lambda: {"city": pick("Elmsby", "Oberlind", "Quellau"), "port": rng.randint(5000, 5999), "ratio": round(rng.random(), 3), "tags": [pick("a", "b")], "who": {"name": pick("ann", "bo"), "age": rng.randint(20, 60)}, "sku": f"AB-{rng.randint(1000, 9999)}", "on": True}
    new = lambda: {"colour": pick("red", "green", "blue"), "retries": rng.randint(0, 3), "celsius": round(rng.uniform(15, 25), 1), "pages": [rng.randint(1, 9)], "where": {"street": "12 copper row", "floor": 3}, "mail": f"{pick('x', 'y')}@example.org", "note": pick("late", "early")}
    df = spark.createDataFrame(lines("f", 1, [old() for _ in range(60)]) + lines("f", 2, [new() for _ in range(60)]), "record_id bigint, feed string, file_no int, line_no int, body string, token string")
    got = {tuple(r)[2:] for r in R.file_changes(df).collect()}
    assert got == {("removed", k, "") for k in old()} | {("added", "", k) for k in new()}


def test_renames_of_every_type_are_found(spark):
    rng = random.Random(8)
    record = lambda names: dict(zip(names, (rng.choice(["login", "logout"]), rng.randint(100, 900), round(rng.uniform(1, 9), 2), rng.random() < 0.5, [rng.choice("ab")], {"id": rng.randint(1, 9), "kind": "x"}), strict=True))
    a, b = list("abcdef"), list("uvwxyz")
    df = spark.createDataFrame(lines("f", 1, [record(a) for _ in range(60)]) + lines("f", 2, [record(b) for _ in range(60)]), "record_id bigint, feed string, file_no int, line_no int, body string, token string")
    assert {tuple(r)[2:] for r in R.file_changes(df).collect()} == {("renamed", x, y) for x, y in zip(a, b, strict=True)}
