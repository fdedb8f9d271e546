import json

import pytest
from pyspark.sql import functions as F

from strataloom.operators import parsers
from strataloom.sources import readers, sinks
from strataloom.streaming.history import keep_history

ROW = {"name": "a", "pick": "top", "url": "https://a.example.test/1.html", "parser": "named_block", "title": "a", "payload": "page",
       "record": "(?P<period>x)(?P<zodiac>y)(?P<open>z)"}


def sources(spark, tmp_path, *rows):
    path = tmp_path / "sources.json"
    path.write_text("﻿" + json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    return readers.read_sources(spark, str(path))


def test_good_sources(spark, tmp_path):
    got = sources(spark, tmp_path, ROW, ROW | {"name": "b", "url": "https://b.example.test/1.html"})
    assert [(r.source_ord, r.name, r.keywords, r.strict_block) for r in got.orderBy("source_ord").collect()] == [(0, "a", [], False), (1, "b", [], False)]
    assert readers.source_violations(got).count() == 0


@pytest.mark.parametrize("change,rule", [
    ({"colour": 1}, "unknown_key"), ({"name": " "}, "blank_name"), ({"pick": "left"}, "bad_pick"), ({"url": "https://u:p@a.example.test/"}, "bad_url"),
    ({"record": "(?P<period>x)"}, "record_group"), ({"parser": "other", "strict_block": True}, "strict_parser"),
    ({"allowed_redirect_origins": ["https://*.example.test"]}, "bad_origin"), ({"stop": "(open"}, "bad_pattern"), ({"payload": "nonsense"}, "bad_payload"), ({"url": "https://a.example.test/x.php?id=1&ID=2"}, "repeated_parameter"),
    ({"detail_enrich": True}, "detail_payload")])
def test_violations(spark, tmp_path, change, rule):
    assert [r.rule for r in readers.source_violations(sources(spark, tmp_path, ROW | change)).collect()] == [rule]


def test_repeated_sources(spark, tmp_path):
    again = ROW | {"url": ROW["url"] + "?utm_source=x", "name": "b"}
    assert [r.rule for r in readers.source_violations(sources(spark, tmp_path, ROW, again)).collect()] == ["repeated_source"]
    other = [ROW | {"name": "b", "stop": "x"}, ROW | {"name": "c", "payload": "scripts"}, ROW | {"name": "d", "url": ROW["url"] + "?ref=1"}, ROW | {"name": "e", "pick": "last"}]
    assert readers.source_violations(sources(spark, tmp_path, ROW, *other)).count() == 0
    alias = ROW | {"name": "b", "url": "https://b.example.test/1.html", "allowed_redirect_origins": ["https://a.example.test"]}
    assert [r.rule for r in readers.source_violations(sources(spark, tmp_path, ROW, alias)).collect()] == ["repeated_source"]
    assert [r.rule for r in readers.source_violations(sources(spark, tmp_path, ROW), ("site_scoped_two_zodiac",)).collect()] == ["unknown_parser"]


@pytest.mark.parametrize("text,rule", [("{broken", "not_json"), ("{}", "not_a_list"), ("[]", "empty"), ("[1]", "item_no_object"), ("", "not_json"), ("[{}]", None)])
def test_broken_source_files(spark, tmp_path, text, rule):
    path = tmp_path / "sources.json"
    path.write_text("\ufeff" + text, encoding="utf-8")
    assert [r.rule for r in readers.file_violations(spark, str(path)).collect()] == [rule] * bool(rule)


def test_config_fingerprint(spark, tmp_path):
    import hashlib

    rows = [ROW | {"keywords": ["甲", "b\"c"], "title": "x\\y"}, ROW | {"name": "b", "allowed_redirect_origins": ["https://z.test"]}]
    fields = ["name", "pick", "url", "parser", "title", "record", "keywords"]
    want = [{f: r.get(f, [] if f == "keywords" else "") for f in fields} | ({"allowed_redirect_origins": r["allowed_redirect_origins"]} if "allowed_redirect_origins" in r else {}) for r in rows]
    text = json.dumps({"project": "名", "sites": want}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert readers.config_fingerprint(sources(spark, tmp_path, *rows), "名", fields).first()[0] == hashlib.sha256(text.encode()).hexdigest()


def history(tmp_path, change=None, **more):
    """A good file of two sources over ten periods across the end of the cycle, with changes."""
    issues = [(2 - k - 1) % 365 + 1 for k in range(10)]
    kind = "visible_text_offset_v1"

    def entry(name):
        values = {str(p): "牛马羊鸡"[k % 3 : k % 3 + 2] for k, p in enumerate(issues[:3])}
        positions = {p: 7 * k for k, p in enumerate(values)}
        records = [{"period": int(p), "zodiac": v, "position": positions[p], "position_kind": kind, "source_positions": [positions[p]]} for p, v in values.items()]
        return {"name": name, "url": "https://a.test/", "pick": "top", "position_kind": kind, "values": values, "positions": positions, "records": records, "fingerprint": "".join(values.values())}

    file = {"schema": 2, "position_kind": kind, "window_size": 10, "issues": issues, "sites": [entry("a"), entry("b")], **more}
    if change:
        change(file)
    path = tmp_path / "history.json"
    path.write_text("\ufeff" + json.dumps(file, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_history_file(spark, tmp_path):
    import hashlib

    path = history(tmp_path)
    rows, stamp = readers.read_history(spark, path)
    assert sorted((r.name, r.period, r.value, r.position) for r in rows.collect()) == sorted((n, p, v, q) for n in "ab" for p, v, q in ((2, "牛马", 0), (1, "马羊", 7), (365, "羊鸡", 14)))
    with open(path, "rb") as f:
        assert (stamp.first()["schema"], stamp.first().sha256) == (2, hashlib.sha256(f.read()).hexdigest())
    assert readers.history_violations(*readers.history_entries(spark, path)).collect() == []
    only = history(tmp_path, lambda f: f["sites"][0].update(values=None, positions=None))
    assert readers.read_history(spark, only)[0].where("name = 'a'").count() == 3
    odd = history(tmp_path, lambda f: (f["sites"][0]["values"].update({"abc": "牛马", "2": 5}), f["sites"][0]["positions"].update({"1": True})))
    assert sorted((r.period, r.position) for r in readers.read_history(spark, odd)[0].where("name = 'a'").collect()) == [(1, None), (365, 14)]


@pytest.mark.parametrize("change,rules", [
    (lambda f: f.update(schema=1), ["bad_schema"]), (lambda f: f.update(position_kind="old"), ["bad_schema"]), (lambda f: f.update(window_size=9), ["bad_window_size"]),
    (lambda f: f["issues"].reverse(), ["bad_issues"]), (lambda f: f["issues"].__setitem__(9, True), ["bad_issues"]), (lambda f: f.update(sites={}), ["no_sources"]),
    (lambda f: f["sites"][1].update(name="a"), ["repeated_identity"]), (lambda f: f["sites"][0].update(pick="left"), ["bad_identity"]), (lambda f: f["sites"][0].update(position_kind=""), ["bad_kind"]),
    (lambda f: f["sites"][0]["records"].pop(), ["unequal_records"]), (lambda f: f["sites"][0]["records"][0].update(position=1), ["bad_record"]),
    (lambda f: f["sites"][0]["records"].append(f["sites"][0]["records"][0]), ["repeated_record"]), (lambda f: f["sites"][0]["values"].update({"2": "牛牛"}), ["bad_record", "bad_value"]),
    (lambda f: f["sites"][0]["positions"].update({"2": True}), ["bad_position", "bad_record"]), (lambda f: f["sites"][0]["positions"].pop("2"), ["bad_record", "unequal_periods"]),
    (lambda f: (f["sites"][0]["values"].update({"0": "牛马"}), f["sites"][0]["positions"].update({"0": 1})), ["bad_period", "unequal_records"])])
def test_history_contract(spark, tmp_path, change, rules):
    assert sorted(r.rule for r in readers.history_violations(*readers.history_entries(spark, history(tmp_path, change))).collect()) == rules


def test_broken_history(spark, tmp_path):
    path = tmp_path / "h.json"
    path.write_text("[1, 2")
    assert "no_object" in [r.rule for r in readers.history_violations(*readers.history_entries(spark, str(path))).collect()]


def test_failed_lines(spark, tmp_path):
    path = tmp_path / "failed.txt"
    path.write_text("b top https://b.test/ reason\nnoise\na top https://a.test/ reason\nb top https://b.test/ again\na b top https://a.test/ x\nb top https://b.test/more y\n")
    s = spark.createDataFrame([("a", "top", "https://a.test/"), ("b", "top", "https://b.test/"), ("c", "top", "https://c.test/"), ("a b", "top", "https://a.test/")], "name string, pick string, url string")
    assert [(r.name, r.line) for r in readers.read_failed(spark, str(path), s).orderBy("line").collect()] == [("b", 0), ("a", 2), ("a b", 4)]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(path.read_text().splitlines())], "line int, text string")
    assert [r.line for r in readers.without_repaired(lines, "text", s.where("name = 'b'")).orderBy("line").collect()] == [1, 2, 4, 5]


def test_posts(spark):
    body = json.dumps([{"id": 1, "user_id": 5, "draw": 12, "topic": "t", "content": "x"}, {"id": 2, "user_id": 5, "draw": 0, "topic": "n 034 m", "content": "y"}])
    rows = readers.posts(spark.createDataFrame([("s", body)], "source_id string, body string"), ["source_id"], "body")
    details = spark.createDataFrame([(1, "t", "longer"), (2, "other", "longer")], "id long, topic string, content string")
    got = readers.with_details(rows, details).withColumn("period", readers.snapshot_period(F.col("draw"), F.col("topic"))).orderBy("place").collect()
    assert [(r.content, r.period) for r in got] == [("longer", 12), ("y", 34)]
    assert readers.owned(rows.withColumn("who", F.lit(5)), ["source_id"], "who").first().owned


def test_commit_is_checked(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.commit(spark.range(1), path, 0) == 1
    assert sinks.commit(spark.range(2), path, 1) == 2
    with pytest.raises(sinks.StaleVersion):
        sinks.commit(spark.range(3), path, 1)
    assert sinks.read_version(spark, path).count() == 2
    # a claim of somebody else, whose version is not finished, is respected; a write that fails gives its claim up
    claim, fs = sinks._fs(spark, f"{path}/_claims/v=3")
    fs.create(claim, False).close()
    with pytest.raises(sinks.StaleVersion):
        sinks.commit(spark.range(3), path, 2)
    fs.delete(claim, False)
    with pytest.raises(Exception):
        sinks.commit(spark.range(3).select(F.raise_error(F.lit("x")).alias("id")), path, 2)
    assert sinks.commit(spark.range(3), path, 2) == 3


def test_streamed_history(spark, tmp_path):
    kind = "source string, period int, value string, status string, at long"
    for k, rows in enumerate([[("a", 364, "x", "ok", 1), ("b", 364, "y", "ok", 2)], [("a", 1, "z", "ok", 3), ("b", 364, "", "bad", 2)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        keep_history(stream, str(tmp_path / "h"), str(tmp_path / "c"), ["source"], "period", "value", "status", "at", window=3).awaitTermination(120)
        assert sinks.latest(spark, str(tmp_path / "h")) == k + 1
    got = sinks.read_version(spark, str(tmp_path / "h")).select("source", "period", "value").collect()
    assert sorted(map(tuple, got)) == [("a", 1, "z"), ("a", 364, "x")]


PATTERN = r"(?P<period>\d{3})期杀【(?P<zodiac>[牛马羊鸡]{2})】开(?P<open>\S+)"


def test_slices(spark):
    docs = spark.createDataFrame([("d", "😀001期杀【牛马】开1 头 002期杀【羊鸡】开2 尾 003期杀【牛羊】开3"), ("e", "头 004期杀【牛马】开1")], "id string, t string")
    got = parsers.sliced_rows(docs, ["id"], "t", PATTERN, start="头", stop="尾", stop_needed=True)
    assert [(r.id, r.period, r.value, r.position) for r in got.collect()] == [("d", 2, "羊鸡", docs.first().t.index("002期"))]
    assert parsers.sliced_rows(docs, ["id"], "t", PATTERN, start="头", stop="尾").count() == 2


def test_chunks_and_complements(spark):
    docs = spark.createDataFrame([("d", "005期 红:牛马 绿:羊鸡 006期 绿:狗猪")], "id string, t string")
    got = parsers.chunk_rows(docs, ["id"], "t", r"(?P<period>\d{3})期", r"绿:(?P<zodiac>\S{2})")
    assert sorted((r.period, r.value, r.position) for r in got.collect()) == [(5, "羊鸡", 0), (6, "狗猪", docs.first().t.index("006期"))]
    ten = spark.createDataFrame([("d", "007期[牛马羊鸡狗猪鼠虎兔龙] 008期[牛牛羊鸡狗猪鼠虎兔龙]")], "id string, t string")
    got = parsers.complement_rows(ten, ["id"], "t", r"(?P<period>\d{3})期\[(?P<picks>[^\]]+)\]")
    assert [(r.period, r.value) for r in got.collect()] == [(7, "蛇猴")]


def test_steps_and_pairs(spark):
    rows = spark.createDataFrame([("a", 0, 365), ("a", 1, 1), ("a", 2, 2), ("b", 0, 1), ("b", 1, 3)], "id string, position int, period int")
    assert {r.id for r in parsers.stepping(rows, ["id"], (1,), 2).collect()} == {"a"}
    docs = spark.createDataFrame([("s", "u1", "name x\\/y.js", ""), ("s", "u2", "rows", "x/y.js")], "source string, url string, t string, ref string")
    assert [(r.anchor_url, r.body_url) for r in parsers.linked_pairs(docs, ["source"], "t", "url", "ref", "name").collect()] == [("u1", "u2")]
