import json
import random

from rillwork.sources.nested_json import StructuralIndex, flat_table, flatten_bodies

BODY = {
    "messages": [
        {"meta": {"id": "a"}, "payload": {"message": {"data": {"chat": {"content": 'q"\\u3042', "vpos": 5, "modifier": {"position": 2, "named_color": "red"}}}}}},
        {"message": {"overflowedChat": {"content": "x", "modifier": None}}},
        {"state": {"marquee": {"display": {"operator_comment": {"content": "op", "modifier": {}}}}}},
        {"message": {"nicoad": {"v0": {"ranking": [{"advertiser": "n", "rank": 1}, None, 3]}}}},
        {"message": {"tagUpdated": {"tags": []}}},
        {"state": {"enquete": {"choices": [{"description": "c", "perMille": 5}]}}},
        {"state": {"moderationAnnouncement": {"guidelineItems": ["SPAM", 4]}}},
        {"message": {"moderator_updated": {"operator": {"user_id": 3}}}},
        {"message": {"gift": {}}}, {}, None, 7, "text", [1],
    ]
}


def rows(spark, bodies, **kw):
    df = spark.createDataFrame([(i, b, "clash") for i, b in enumerate(bodies)], "segment_id long, body string, entity string")
    return flatten_bodies(df, "segment_id", "body", **kw)


def test_every_entity(spark):
    got = {(r["msg_pos"], r["entity"], r["item_pos"], r["parent_entity"]) for r in rows(spark, [json.dumps(BODY)]).collect()}
    expect = {(i, "message", 0, None) for i in range(len(BODY["messages"]))} | {
        (0, "chat", 0, "message"), (0, "modifier", 0, "chat"), (1, "overflowed_chat", 0, "message"), (2, "operator_comment", 0, "message"), (2, "modifier", 0, "operator_comment"),
        *[(3, "ranking", i, "message") for i in range(3)], (5, "choice", 0, "message"), (6, "guideline_item", 0, "message"), (6, "guideline_item", 1, "message"), (7, "moderator", 0, "message"), (8, "gift", 0, "message"),
    }
    assert got == expect


def test_typed_tables(spark):
    flat = rows(spark, [json.dumps(BODY)])
    chat = flat_table(flat, "segment_id", "chat").collect()
    assert [(r["content"], r["vpos"], r["account_status"]) for r in chat] == [('q"\\u3042', 5, "Standard")]
    mods = {(r["parent_entity"], r["position"], r["named_color"], r["font"]) for r in flat_table(flat, "segment_id", "modifier").collect()}
    assert mods == {("chat", "ue", "red", "defont"), ("operator_comment", "naka", "white", "defont")}
    assert [r["item"] for r in flat_table(flat, "segment_id", "guideline_item").orderBy("item_pos").collect()] == ["SPAM", "PERSONAL_INFORMATION"]


def test_odd_bodies(spark):
    long = json.dumps({"messages": [{"message": {"chat": {"content": "z" * 50}}}] * 5000})
    bodies = [None, "", " ", "null", "[]", "{}", '{"messages": null}', '{"messages": {}}', '{"messages": []} x', '{"messages": [1}', '{"messages": [{}],}', '{"messages": [{}], "messages": [1, 2]}', "\n" + '{"Messages": [{}]}', "[" * 3000 + "]" * 3000, long]
    got = {}
    for r in rows(spark, bodies, fields=False).collect():
        got[r["segment_id"]] = got.get(r["segment_id"], 0) + 1
    assert got == {11: 2, 12: 1, 14: 10_000}
    assert rows(spark, []).count() == 0


def test_validity_against_a_parser():
    def good(b):
        def no(x):
            raise ValueError

        try:
            json.loads(b, parse_constant=no)
            return True
        except ValueError:
            return False

    r = random.Random(3)
    base = [json.dumps({"a": [1, -2.5e3, True, None, "x\\\"yあ"], "b": {"c": {}, "d": []}}).encode(), b'[{"k":"v"},[[]],"",0]', b'"s"', b" 12 "]
    cases = []
    for _ in range(4000):
        b = bytearray(r.choice(base))
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(b))
            b[i : i + r.randint(0, 1)] = bytes([r.choice(b'{}[]:,"\\0 1e.-tn\t\n')])
        cases.append(bytes(b))
    ix = StructuralIndex(cases)
    assert [c for i, c in enumerate(cases) if ix.bad[i] == good(c)] == []
