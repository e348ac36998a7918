import json

from test_engine import star

from widegrain.server import App, respond
from widegrain.sources.ddl import write_ddl


def ask(app, method, path, **body):
    status, pieces = respond(app, method, path, body)
    return status, [json.loads(x) for p in pieces for x in p.splitlines()]


def test_server(spark):
    app = App(spark, complete=lambda p: "SELECT COUNT(*) AS n FROM orders", cases=[])
    ddl = write_ddl(star(3))
    assert ask(app, "GET", "/api/sample")[0] == 200 and ask(app, "GET", "/nothing")[0] == 404
    status, (made,) = ask(app, "POST", "/api/fold", ddl=ddl, anchor_mode="mixed")
    assert status == 200 and made["layer"]["models"] and made["fidelity"]["joins"] == 1.0
    status, (e,) = ask(app, "POST", "/api/expand", anchors=["orders"], sql="SELECT COUNT(*) AS n FROM orders")
    assert status == 200 and "FROM `orders`" in e["sql"]
    assert ask(app, "POST", "/api/expand", anchors=["orders"], sql="SELECT nope FROM orders")[0] == 400
    status, steps = ask(app, "POST", "/api/autotune", ddl=ddl, limit=3)
    assert status == 200 and "best" in steps[-1] and steps[0]["step"] == 1
    assert ask(app, "GET", "/api/chat-capability")[1] == [{"chat": True, "execute": False}]
    assert ask(app, "POST", "/api/chat", anchors=["orders"], question="how many?")[1][0]["ok"]
    assert ask(app, "GET", "/api/goldset")[1] == [{"cases": 0}] and ask(app, "GET", "/api/sources")[1] == [{"sources": []}]
    assert ask(app, "POST", "/api/curve", ddl=ddl)[0] == 200


def test_entry_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70
