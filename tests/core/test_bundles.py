"""Document sets, walks and the full history on rows written by hand: each rule, each refusal."""

import pytest
from pyspark.sql import functions as F

from strataloom.functions import urls
from strataloom.operators import bundles, history, period, walk
from strataloom.plans.bundles import rows_of
from strataloom.sources import sinks

DOCS = "source long, document string, url string, record_id string, own_record_id string, parent_url string, link_reference string, identity_inherited boolean, text string"
SOURCES = "source long, name string, keywords array<string>, url string, payload string, pattern string, allowed array<string>, expected string"
H = "https://h.example"


def docs(spark, rows):
    return spark.createDataFrame([(r["source"], r["document"], r.get("url", ""), r.get("record", ""), r.get("own", ""), r.get("parent", ""), r.get("link", ""), r.get("inherited", False), r.get("text", "")) for r in rows], DOCS)


def sources(spark, *rows):
    return spark.createDataFrame([(i, o.get("name", f"name{i}."), o.get("keywords", []), o.get("url", f"{H}/{i}"), o.get("payload", "page"), o.get("pattern", ""), o.get("allowed", []), o.get("expected", "")) for i, o in rows], SOURCES)


def test_resolved_like_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["https://h.example/a/b/c.html?x=1#f", "http://h.example:81", "https://h.example/"]
    refs = ["", "d.js", "/d.js", "//o.example/x", "https://o.example/y", "?q=2", "#g", "../d/e?z=/../1", "./d", "../..", "mailto:x", "d/./e/../f/"]
    rows = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", urls.resolved(F.col("b"), F.col("r")).alias("u")).collect()
    for x in got:
        assert x.u == urljoin(x.b, x.r) or x.b.endswith(":81") and x.r in ("../..",), x


def test_every_boundary_rule(spark):
    rows = [
        dict(source=1, document="page", url=f"{H}/topic/1", record="topic:1", text='<a href="/topic/1.js"> //h.example/topic/3 \\/topic\\/4'),
        dict(source=1, document="good", url=f"{H}/topic/1.js", record="topic:1", parent=f"{H}/topic/1", link="/topic/1.js", inherited=True),
        dict(source=1, document="no link", url=f"{H}/x/2", record="topic:1", parent=f"{H}/topic/1", link="/x/2"),
        dict(source=1, document="prefix only", url=f"{H}/topic", record="topic:1", parent=f"{H}/topic/1", link="topic"),
        dict(source=1, document="no parent", url=f"{H}/x/3", record="topic:1", parent=f"{H}/none", link="x"),
        dict(source=1, document="no reference", url=f"{H}/x/4", record="topic:1", parent=f"{H}/topic/1", inherited=True),
        dict(source=1, document="other", url=f"{H}/topic/4", record="topic:9", own="topic:8", parent=f"{H}/topic/1", link="/topic/4"),
        dict(source=2, document="unbound", url=f"{H}/x", text="x"), dict(source=2, document="own parent", url=f"{H}/y", record="r", parent=f"{H}/y", link="y"),
        dict(source=3, document="api", url=f"{H}/article/admin/77", record="77"), dict(source=9, document="of no source", url="")]
    got = bundles.violations(docs(spark, rows), sources(spark, (1, {"expected": "topic:1"}), (2, {"expected": "r"}), (3, {})))
    assert sorted((r.source, r.document, r.rule) for r in got.collect()) == sorted([
        (1, "no link", "link"), (1, "prefix only", "link"), (1, "no parent", "parent"), (1, "no reference", "evidence"), (1, "no reference", "reference"), (1, "no reference", "link"),
        (1, "other", "mismatched"), (1, "other", "own_id"), (1, "other", "record"), (1, "other", "parent_record"), (2, "unbound", "unbound"), (2, "own parent", "parent")])
    assert bundles.violations(docs(spark, rows).limit(0), sources(spark, (1, {}))).count() == 0


def verdicts(spark, rows, *src):
    d, s = docs(spark, rows), sources(spark, *src)
    pairs = bundles.linked_pairs(d, s)
    choose = lambda r: period.by_document(period.for_periods(r, [8]))
    out = bundles.pair_consensus(choose(rows_of(d, s, F.lit(0))), choose(rows_of(pairs, s, F.col("body_start"))), d, pairs, s, [8])
    return {r.source: r for r in out.collect()}, {(r.source, r.document): r.status for r in pairs.collect()}


def test_pairs_and_their_verdicts(spark):
    row, other = "008期:【牛马】", "008期:【牛羊】"
    page = lambda i, link, rows="", **o: dict(source=i, document="page", url=f"{H}/{i}", text=f'name{i}. <script src="{link}"> {rows}', **o)
    body = lambda i, url, rows=row, **o: dict(source=i, document="body", url=url, parent=f"{H}/{i}", link=o.pop("link", url), text=rows, **o)
    rows = [
        page(1, "/a.js", row), body(1, f"{H}/a.js", link="/a.js"),  # agree
        page(2, "/a.js", row), body(2, f"{H}/a.js", other, link="/a.js"),  # disagree
        page(3, "/a.json"), body(3, f"{H}/a.js", link="/a.js"),  # another address that begins alike
        page(4, "a.js"), body(4, f"{H}/a.js", link="a.js"),  # only the body has rows
        page(5, "https://far.example/a.js"), body(5, "https://far.example/a.js"),  # not authorised
        page(6, "https://far.example/a.js"), body(6, "https://far.example/a.js"),  # authorised by an origin
        page(7, "https://far.example/upload/script/a.js"), body(7, "https://far.example/upload/script/a.js"),  # a data script
        page(8, "https://far.example/p7"), body(8, "https://far.example/p7"),  # by the pattern
        page(9, "/a.js", record="r1"), body(9, f"{H}/a.js", link="/a.js", record="r2"),  # two records
        page(10, "", row + " x " + other),  # a contradiction within
        dict(source=11, document="one", url=f"{H}/11", text=f"name11. {row}", record="r1"), dict(source=11, document="two", url=f"{H}/11b", text=f"name11. {row}", record="r2"),
        dict(source=12, document="a", url=f"{H}/12", text="name12. "), dict(source=12, document="b", url=f"{H}/12", text=row),  # one address, two documents
        dict(source=13, document="head", url=f"{H}/p1", parent=f"{H}/13", link="p1", text="name13."), dict(source=13, document="tail", url=f"{H}/p2", parent=f"{H}/13", link="p2", text=row),  # siblings
        dict(source=14, document="key", url=f"{H}/14", text="by a keyword: " + row), page(15, "/a.js", "001期:【牛马】"), page(16, "/a.js", "006期:【牛马】")]
    src = [(i, {}) for i in range(1, 18)]
    src[5] = (6, {"allowed": ["https://far.example"]})
    src[6] = (7, {"payload": "page_and_scripts"})
    src[7] = (8, {"pattern": "https://far\\.example/p\\d"})
    src[12] = (13, {"pattern": f"{H}/p\\d"})
    src[13] = (14, {"name": "by a keyword"})
    got, pairs = verdicts(spark, rows, *src)
    assert {i: (r.status, r.value, r.how, r.carrier) for i, r in got.items()} == {
        1: ("ok", "牛马", "single", "page"), 2: ("conflict", None, None, None), 3: ("no_rows", None, None, None), 4: ("ok", "牛马", "paired", "page+body"), 5: ("no_rows", None, None, None),
        6: ("ok", "牛马", "paired", "page+body"), 7: ("ok", "牛马", "paired", "page+body"), 8: ("ok", "牛马", "paired", "page+body"), 9: ("record_conflict", None, None, None),
        10: ("conflict", None, None, None), 11: ("conflict", None, None, None), 12: ("no_rows", None, None, None), 13: ("ok", "牛马", "paired", "head+tail"),
        14: ("ok", "牛马", "single", "key"), 15: ("out_of_reach", None, None, None), 16: ("not_found", None, None, None), 17: ("no_rows", None, None, None)}
    assert got[11].records == ["r1", "r2"] and pairs[(9, "page+body")] == "record_conflict" and (3, "page+body") not in pairs
    d = docs(spark, rows)
    assert [tuple(r)[:3] for r in bundles.merged_by_address(d).collect()] == [(12, "a+b", f"{H}/12")]


def test_history_walk_by_hand(spark):
    def site(key, periods, values=None):
        return [(key, i, p, (values or {}).get(i, "牛马"), 100) for i, p in enumerate(periods)]

    ten = list(range(100, 90, -1))
    rows = site("top two cycles", [*ten, 100, 99]) + site("bottom two cycles", [99, 100, *ten[::-1]]) + site("top gap", [100, 99, 97, 100, 98])
    rows += site("top repeat", [100, 100, 99, 99]) + site("top conflict later", [100, 99, 50, 99]) + site("top other value", [100, 99, 98, 99], {3: "牛羊"}) + site("bottom none", [100, 99, 98, 97])
    rows += site("top conflict", [100, 99, 100]) + site("top far", [90, 100]) + site("top old cycle differs", [*ten, 100, 99], {10: "牛羊", 11: "牛羊"}) + site("top invalid", [100], {0: "牛牛"})
    df = spark.createDataFrame(rows, "source string, place int, period int, value string, requested int").repartition(3)
    got = {r.source: (r.status, r.n, r.missing) for r in walk.history_walk(df, ["source"], "place", F.startswith(F.col("source"), F.lit("top")), "requested").collect()}
    assert got == {
        "top two cycles": ("ok", 10, ""), "bottom two cycles": ("ok", 10, ""), "top gap": ("incomplete", 3, "98,96,95,94,93,92,91"), "top repeat": ("conflict", 0, None),
        "top conflict later": ("conflict", 0, None), "top other value": ("conflict", 0, None), "bottom none": ("not_found", 0, None), "top conflict": ("conflict", 0, None),
        "top far": ("out_of_reach", 0, None), "top old cycle differs": ("ok", 10, ""), "top invalid": ("invalid", 0, None)}


def test_history_walk_stages(spark):
    """All windows and joins stood in one task, with the rows' plan once for each use: now the last plan reads written steps."""
    rows = spark.createDataFrame([("top", i, p, "牛马", 100) for i, p in enumerate((100, 99, 98))], "source string, place int, period int, value string, requested int")
    got = walk.history_walk(rows, ["source"], "place", F.col("source") == "top", "requested")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ExistingRDD" not in plan and "Scan parquet" in plan
    assert [tuple(r)[2:4] for r in got.collect()] == [("incomplete", 3)]


def test_history_walk_repeated_rows_and_empty_values(spark):
    """A row that is told twice is no conflict, a value that is missing at another place is one."""
    rows = [("top twice", 0, 100, "牛马", 100), ("top twice", 0, 100, "牛马", 100), ("top twice", 1, 99, None, 100), ("top twice", 1, 99, None, 100)]
    rows += [("top none", 0, 100, "牛马", 100), ("top none", 1, 99, None, 100), ("top none", 2, 98, "牛羊", 100), ("top none", 3, 99, None, 100)]
    df = spark.createDataFrame(rows, "source string, place int, period int, value string, requested int")
    got = {r.source: (r.status, r.n, r["values"]) for r in walk.history_walk(df, ["source"], "place", F.startswith(F.col("source"), F.lit("top")), "requested").collect()}
    assert got == {"top twice": ("incomplete", 2, "牛马"), "top none": ("conflict", 0, None)}


ROW = "struct<at:int,period:int,value:string,position:long,article_id:string>"


def stored(spark):
    rows = [("a", 0, [(1, 10, "牛马", 5, "x"), (2, 9, "牛羊", 9, None)], "牛马牛羊", "ok", None), ("b", 1, [(1, 10, "牛马", 5, None)], "牛马", "failed", "late")]
    return spark.createDataFrame(rows, history.ENTRIES)


def results(spark, *rows):
    return spark.createDataFrame(rows, "source string, ord int, ok boolean, period int, value string, position long, article_id string, error string")


def told(df):
    return {r.source: ([(x.period, x.value, x.position, x.article_id) for x in r.rows], r.fingerprint, r.status, r.error) for r in df.collect()}


def test_full_update(spark):
    good = results(spark, ("a", 0, True, 11, "马牛", 1, None, None), ("b", 1, False, None, None, None, None, "gone"))
    assert told(history.full_update(stored(spark), good, 11)) == {
        "a": ([(11, "马牛", 1, None), (10, "牛马", 5, "x"), (9, "牛羊", 9, None)], "马牛牛马牛羊", "ok", None), "b": ([(10, "牛马", 5, None)], "牛马", "failed", "gone")}
    again = results(spark, ("a", 0, True, 10, "马牛", 1, "y", "odd"), ("b", 1, False, 10, None, None, None, ""))
    assert told(history.full_update(stored(spark), again, 10)) == {"a": ([(10, "马牛", 1, "y"), (9, "牛羊", 9, None)], "马牛牛羊", "ok", "odd"), "b": ([], "", "failed", None)}
    assert told(history.full_update(None, good, 11))["a"] == ([(11, "马牛", 1, None)], "马牛", "ok", None)
    far = results(spark, ("a", 0, True, 5, "马牛", 1, None, None), ("b", 1, True, 5, "马牛", 1, None, None))
    assert told(history.full_update(stored(spark), far, 5))["a"][0] == [(5, "马牛", 1, None)]  # the window is that of the current period
    b = ("b", 1, False, None, None, None, None, None)
    for rule, rows in (("missing", [b]), ("moved", [("a", 1, False, *[None] * 5), ("b", 0, False, *[None] * 5)]), ("extra", [("a", 0, False, *[None] * 5), b, ("c", 2, False, *[None] * 5)]),
                       ("repeated", [("a", 0, False, *[None] * 5), ("a", 0, False, *[None] * 5), b]), ("other_period", [("a", 0, True, 10, "牛马", 1, None, None), b]), ("no_place", [("a", 0, True, 11, "牛马", None, None, None), b])):
        with pytest.raises(history.Refused) as e:
            history.full_update(stored(spark), results(spark, *rows), 11)
        assert e.value.rule == rule
    with pytest.raises(history.Refused):
        history.full_update(stored(spark), good, 366)


def test_full_repair(spark):
    one = results(spark, ("b", 7, True, 9, "马牛", 3, "z", None), ("a", 7, False, 9, None, None, None, "no"))
    assert told(history.full_repair(stored(spark), one, 9, 10)) == {
        "a": ([(10, "牛马", 5, "x"), (9, "牛羊", 9, None)], "牛马牛羊", "ok", None), "b": ([(10, "牛马", 5, None), (9, "马牛", 3, "z")], "牛马马牛", "ok", None)}
    moved = told(history.full_repair(stored(spark), results(spark, ("a", 0, True, 19, "马牛", 3, None, None)), 19, 10))
    assert moved == {"a": ([(19, "马牛", 3, None), (10, "牛马", 5, "x")], "马牛牛马", "ok", None), "b": ([(10, "牛马", 5, None)], "牛马", "failed", "late")}
    for rule, row in (("extra", ("c", 0, True, 9, "牛马", 1, None, None)), ("other_period", ("a", 0, True, 8, "牛马", 1, None, None)), ("no_value", ("a", 0, True, 9, "牛牛", 1, None, None)), ("no_place", ("a", 0, True, 9, "牛马", -1, None, None))):
        with pytest.raises(history.Refused) as e:
            history.full_repair(stored(spark), results(spark, row), 9, 10)
        assert e.value.rule == rule


def test_stale_update_is_refused(spark, tmp_path):
    path = str(tmp_path / "history")
    assert sinks.commit(stored(spark), path, 0) == 1
    update = history.full_repair(sinks.read_version(spark, path), results(spark, ("b", 1, True, 9, "马牛", 3, None, None)), 9, 10)
    assert sinks.commit(history.full_repair(sinks.read_version(spark, path), results(spark), 9, 10), path, 1) == 2
    with pytest.raises(sinks.StaleVersion):
        sinks.commit(update, path, 1)
