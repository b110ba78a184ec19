"""Routes against all pairs, and calls whose options stand on later lines."""

import random
import re

from lodestone.operators import contracts, routes
from lodestone.sources.files import described


def fits(path, route):
    bare = lambda x: re.sub(r"\{[^}]*\}", "{}", x)
    parts = re.split(r"\{[^}]*\}", route)
    return bare(path) == bare(route) or re.fullmatch("[^/]+".join(map(re.escape, parts)), path) is not None


def test_routes_equal_all_pairs(spark, monkeypatch):
    r = random.Random(4)
    segment = lambda wild: r.choice(["a", "b", "a.b", "aXb", "c+", *(["{x}", "{y}", "{id}.json", "v{n}"] if wild else ["7.json", "v2", "{x}"])])
    made = lambda wild: "/" + "/".join(segment(wild) for _ in range(r.randint(1, 4)))
    known = [(r.choice(["GET", "POST"]), made(True)) for _ in range(150)] + [("GET", None), ("GET", "/")]
    asked = [(r.choice(["GET", "POST"]), made(False)) for _ in range(250)] + [("GET", None), ("GET", "/"), ("PUT", "/a")]
    want = {(m, p, q) for m, p in asked for n, q in known if p and q and m == n and fits(p, q)}
    paths, table = spark.createDataFrame(asked, "method string, path string"), spark.createDataFrame(known, "method string, route string")
    for limit in (routes.MASKS, 0):
        monkeypatch.setattr(routes, "MASKS", limit)
        assert {tuple(x) for x in routes.fitting(paths, table).collect()} == want
    best = {}
    for m, p, q in want:
        best[m, p] = min(best.get((m, p), (True, "~")), (p != q, q))
    assert {(x["method"], x["path"]): x["route"] for x in routes.first_fitting(paths, table).collect()} == {k: q for k, (_, q) in best.items()}
    assert routes.fitting(paths, table.limit(0)).collect() == []


def test_methods_on_later_lines(spark):
    text = """fetch('/orders', {
  headers: { a: 1 },
  method: 'POST',
});
fetch('/plain');
fetch('/open', {
  cache: 'no',
});
fetch('/put', { method: 'PUT' });
fetch('/late',
  { method: 'DELETE' });
"""
    f = described(spark.createDataFrame([("client/a.ts", text)], "relative_path string, content string"))
    got = {(x["line"], x["method"], x["path"]) for x in contracts.api_calls(f).collect()}
    assert got == {(1, "POST", "/orders"), (5, "GET", "/plain"), (6, "GET", "/open"), (9, "PUT", "/put"), (10, "DELETE", "/late")}
