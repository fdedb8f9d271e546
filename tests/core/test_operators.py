"""Operators on small fixtures: positive, absent, out of the window, conflicting, wrapped."""

import pytest
from pyspark.sql import functions as F

from strataloom.functions import status, text, urls
from strataloom.operators import audit, extraction, history, linking, report, selection


def rows(spark, data):
    return spark.createDataFrame(data, "source string, position int, period int, value string")


def status_of(spark, data, requested, top=True):
    got = selection.selected(rows(spark, data), ["source"], "position", F.lit(top), "period", "value", requested).collect()
    return {r.source: (r.status, r.value, r.position) for r in got}


def test_selected_value(spark):
    data = [("ok", 1, 268, "AB"), ("ok", 2, 267, "CD"), ("ok", 3, 266, "EF"), ("ok", 4, 268, "XX"),
            ("two", 1, 268, "AB"), ("two", 2, 268, "AC"), ("far", 1, 260, "AB"), ("far", 2, 268, "AB"), ("none", 1, 267, "AB"), ("wrap", 1, 1, "AB"), ("same", 1, 268, "AB"), ("same", 9, 268, "AB")]
    got = status_of(spark, data, 268)
    assert got["ok"] == ("ok", "AB", 1)  # the fourth row is outside the window
    assert got["two"][0] == "conflict" and got["same"][0] == "conflict"  # equal values at two places conflict within a document
    assert got["far"][0] == "out_of_reach" and got["none"][0] == "not_found" and got["wrap"][0] == "out_of_reach"


def test_bottom_sources_take_the_last_rows(spark):
    data = [("s", p, 260 + p, "V%d" % p) for p in range(1, 7)]
    assert status_of(spark, data, 264, top=False)["s"] == ("ok", "V4", 4)
    assert status_of(spark, data, 263, top=False)["s"][0] == "not_found"


def test_only_the_pair_of_last_and_first_period_wraps(spark):
    pairs = spark.createDataFrame([(365, 1), (1, 365), (2, 365), (10, 12)], "a int, b int")
    assert [r[0] for r in pairs.select(selection.period_step(F.col("a"), F.col("b"))).collect()] == [1, -1, 363, 2]


def test_adjacent_runs_need_adjacency(spark):
    got = selection.adjacent_runs(rows(spark, [("s", 1, 5, "A"), ("s", 2, 5, "A"), ("s", 3, 5, "B"), ("s", 4, 5, "A"), ("s", 5, None, None), ("s", 6, None, None)]), ["source"], "position", ["period", "value"]).collect()
    assert sorted((r.first_position, r.n) for r in got) == [(1, 2), (3, 1), (4, 1), (5, 2)]


def test_recent_periods_wrap(spark):
    assert spark.range(1).select(history.recent_periods(3, 5)).first()[0] == [3, 2, 1, 365, 364]


def test_failed_rows_delete_and_repairs_do_not(spark):
    past = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], "s string, p int, v string")
    batch = spark.createDataFrame([("a", 1, "new"), ("b", 1, "error")], "s string, p int, v string")
    bad = F.col("v") == "error"
    assert sorted(map(tuple, history.rolling_update(past, batch, ["s"], "p", "v", bad).collect())) == [("a", 1, "new"), ("c", 1, "z")]
    assert sorted(map(tuple, history.repair(past, batch, ["s"], "p", "v", bad).collect())) == [("a", 1, "new"), ("b", 1, "y"), ("c", 1, "z")]
    assert history.rolling_update(past, batch, ["s"], "p", "v", bad, [2]).count() == 0


def test_equal_runs_keep_the_newest_of_equal_length(spark):
    h = [("a", p, "v") for p in (1, 2, 3, 7, 8, 9)] + [("b", p, "v") for p in range(1, 10)] + [("c", p, "w") for p in range(1, 10)]
    got = audit.equal_runs(spark.createDataFrame(h, "s string, p int, v string"), "s", "p", ["v"]).collect()
    assert [tuple(r) for r in got] == [("a", "b", 3, 9, 7, "suspicious")]


def test_dense_ranking_ties(spark):
    df = spark.createDataFrame([(x,) for x in "bbaacd"], "s string")
    got = sorted((r.ordinal, r.s, r.n, r.rank) for r in report.dense_ranking(df, "s", F.col("s")).collect())
    assert got == [(1, "a", 2, 1), (2, "b", 2, 1), (3, "c", 1, 2), (4, "d", 1, 2)]


@pytest.mark.parametrize(("url", "identity"), [
    ("https://h.test/topic/384.html", "topic:384"), ("https://h.test/topic/384.js?x=1", "topic:384"), ("https://h.test/article/Admin/9", "admin_article:9"),
    ("https://h.test/#/users/77", "user:77"), ("https://h.test/api/v1/users/7/", "user:7"), ("https://h.test/read.php?tid=5", "read:5"), ("https://h.test/view.php?ID=6", "view:6"),
    ("https://h.test/article.asp?id=3", "article:3"), ("https://h.test/Article.aspx?id=3&listid=2", "article:2:3"), ("https://h.test/show.aspx?id=4", "show.aspx:4"),
    ("https://h.test/bbs/12.html", "bbs:12"), ("https://h.test/art_zhuanqu/8.html", "art_zhuanqu:8"), ("https://h.test/", "")])
def test_record_identity(spark, url, identity):
    assert spark.createDataFrame([(url,)], "u string").select(urls.record_identity(F.col("u"))).first()[0] == identity


def test_redirects(spark):
    cases = [("http://a.test/topic/1", "https://a.test/topic/1", True), ("https://a.test/topic/1", "http://a.test/topic/1", False), ("https://a.test/topic/1", "https://b.test/topic/1", False),
             ("https://a.test/topic/1", "https://c.test/topic/1", True), ("https://a.test/topic/1", "https://a.test/topic/2", False), ("https://A.test:443/x", "https://a.test/x", True)]
    df = spark.createDataFrame(cases, "a string, b string, ok boolean")
    got = df.select("ok", urls.redirect_allowed(F.col("a"), F.col("b"), F.array(F.lit("https://c.test:443"))).alias("got")).collect()
    assert [r.got for r in got] == [r.ok for r in got]


def test_offsets_count_code_points(spark):
    df = spark.createDataFrame([("💎 12 é34💎56",), ("none",), (None,)], "t string")
    got = df.select(text.matches(F.col("t"), "([0-9])[0-9]", (0, 1))).collect()
    assert [(m.offset, m.g0, m.g1) for m in got[0][0]] == [(2, "12", "1"), (6, "34", "3"), (9, "56", "5")]
    assert got[1][0] == [] and got[2][0] is None


def test_candidates_keep_the_first_pattern(spark):
    df = spark.createDataFrame([("d", "268P: [A-B] open X1  269P [AA] open X2 270P (C D) open X3")], "id string, t string")
    bank = [r"(?P<period>\d{3})P:?\s*\[(?P<zodiac>[A-D]\s*[-]?\s*[A-D])\]\s*open\s*(?P<open>\S+)", r"(?P<period>\d{3})P:?\s*[\[(](?P<zodiac>[A-D][- ]?[A-D])[\])]\s*open (?P<open>\S+)"]
    got = sorted((r.position, r.period, r.value, r.open_result, r.pattern_ord) for r in extraction.candidates(df, ["id"], "t", bank, "ABCD").collect())
    assert got == [(0, 268, "AB", "X1", 0), (39, 270, "CD", "X3", 1)]


def test_strict_base64(spark):
    cases = [("aGVsbG8=", "hello"), ("aGVs bG8=", "hello"), ("a_b!", None), ("aGVsbG8", None), ("", None), ("/w==", None)]
    df = spark.createDataFrame(cases, "c string, want string")
    assert all(r.got == r.want for r in df.select("want", status.strict_base64(F.col("c")).alias("got")).collect())


def test_flattening(spark):
    page = "<p>a&amp;lt; <b>b</b></p><script>x</script><div> c\t d<br>e</div><style>y</style>"
    df = spark.createDataFrame([(page,)], "h string").select(text.visible_text(F.col("h")).alias("flat"), text.visible_lines(F.col("h")).alias("lines"))
    assert tuple(df.first()) == ("a&lt; b c d e", ["a&lt; b", "c d", "e"])


def test_written_markup(spark):
    df = spark.createDataFrame([("x document.writeln('<b>hi</b>'); y",), ("document.writeln(atob('QUJD'));z",)], "s string")
    assert [r[0] for r in df.select(text.written_markup(F.col("s"))).collect()] == ["x <b>hi</b>\n y", " z"]


def test_containing_finds_passages_across_words(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five yy"), (2, "one two three"), (3, "none two three four fiver")], "d int, t string")
    items = spark.createDataFrame([(7, "one two three four five"), (8, "two three")], "i int, p string")
    assert sorted(map(tuple, linking.containing(docs, "d", "t", items, "i", "p").collect())) == [(1, 7), (1, 8), (2, 8), (3, 7), (3, 8)]


def test_reachable_takes_the_smallest_depth(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "parent string, child string")
    starts = spark.createDataFrame([("a",)], "node string")
    assert sorted(map(tuple, linking.reachable(links, starts, "node", 5).collect())) == [("a", 0), ("b", 1), ("c", 1)]
