import json

import pytest

from catalith.operators import profile as P


def docs(spark, bodies):
    return spark.createDataFrame([(str(i), b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)], "record_id string, body string")


def decide(spark, bodies):
    return P.decision(P.summary(P.field_statistics(P.paths(docs(spark, bodies))))).first()


CASES = {
    "stable": ([{"id": i, "name": "n", "email": "e", "age": 3, "active": True} for i in range(5)], ("sql", 1.0)),
    "optional": ([{"event": "a", "x": 1, "y": 2}, {"event": "b", "z": 1, "w": 2}, {"event": "c", "q": 1, "r": 2}, {"event": "d", "s": 1, "t": 2}], ("jsonb", 0.25)),
    "arrays of objects": ([{"order_id": 1, "customer": "c", "items": [{"product_id": 1}], "total": 2.5}] * 2, ("jsonb", 0.95)),
    "many": ([{f"field_{i}": "v" for i in range(30)}], ("jsonb", 0.9)),
    "twenty": ([{f"field_{i}": "v" for i in range(20)}], ("sql", 1.0)),
    "deep": ([{"app": "a", "config": {"database": {"credentials": {"user": "u"}}}}], ("jsonb", 0.9)),
    "none": ([], ("jsonb", 0.4)),
    "three of five": ([{"a": 1, "b": 2, "c": 3}] * 3 + [{"a": 1, "b": 2}] * 2, ("sql", 1.0)),
}


@pytest.mark.parametrize("name", CASES)
def test_decisions(spark, name):
    bodies, (storage, confidence) = CASES[name]
    row = decide(spark, bodies)
    assert (row.storage, row.confidence) == (storage, confidence)
    assert "top-level" in P.rationale(row)


def test_flatten_and_types(spark):
    assert [p[0] for p in P.flatten({"a": {"b": {"c": 1}}}, 2)] == ["a", "a.b"]
    assert [p[:2] for p in P.flatten({"a": [{"x": 1}], "b": [1]}, 3)] == [("a", "array"), ("a[]", "array"), ("b", "array")]
    stats = {r.path: r for r in P.field_statistics(P.paths(docs(spark, [{"x": 1}, {"x": 2}, {"x": "s"}, "broken", None, "[1]"]))).collect()}
    assert stats["x"].dominant == "integer" and stats["x"].docs == 3 and abs(stats["x"].stability - 2 / 3) < 1e-5
    nulls = {r.path: r for r in P.field_statistics(P.paths(docs(spark, [{"x": None}, {"x": None}]))).collect()}
    assert nulls["x"].dominant == "null" and nulls["x"].nulls == 2
    assert [P.json_type(v) for v in (None, True, 1, 1.0, "s", [], {})] == ["null", "boolean", "integer", "float", "string", "array", "object"]


def test_columns_and_ddl(spark):
    body = {"id": 1, "user": "u", "9x": 1, "": "e", "long": "x" * 256, "very": "x" * 1001, "a-b": None, "ok": True}
    cols = P.table_columns(P.field_statistics(P.paths(docs(spark, [body]))))
    got = {r.path: (r.column, r.sql_type) for r in cols.collect()}
    assert got == {"id": ("id_1", "BIGINT"), "user": ("user_col", "VARCHAR(1)"), "9x": ("col_9x", "BIGINT"), "": ("col_empty", "VARCHAR(1)"), "long": ("long", "VARCHAR(1000)"), "very": ("very", "TEXT"), "a-b": ("a_b", "TEXT"), "ok": ("ok", "BOOLEAN")}
    ddl = P.table_ddl(cols, "t")
    assert ddl.count("id_1 BIGINT NOT NULL") == 1 and "CREATE INDEX" in ddl
    assert P.collection_name("My Things-2", "abcdef0123") == "my_things2"[:0] + "my_things_2" and P.collection_name("9", "abcdef0123", "sql") == "table_abcdef01"
    assert P.insert_template(["a"], "t") == "INSERT INTO t (a, extra) VALUES (:a, :extra)"
    assert "JSONB NOT NULL" in P.collection_ddl("c")


def test_fingerprint_and_registration(spark):
    import hashlib

    fields = P.field_statistics(P.paths(docs(spark, [{"b": 1, "a": "x"}])))
    assert P.fingerprint(fields).first()[0] == hashlib.sha256(json.dumps({"a": "JsonType.STRING", "b": "JsonType.INTEGER"}, sort_keys=True).encode()).hexdigest()
    rows = P.registered(docs(spark, ['{"b":1,"a":"é"}', '{"a": "é", "b": 1}', "x"]), "things", "sql", False).collect()
    assert len(rows) == 2 and len({r.sha256 for r in rows}) == 1 and rows[0].status == "queued"
    typed = P.typed_rows(docs(spark, [{"b": 1, "a": "x"}, {"b": "no"}]), P.table_columns(fields)).orderBy("id").collect()
    assert (typed[0].b, typed[0].a, typed[1].b) == (1, "x", None)
