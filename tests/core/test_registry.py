"""Parsers of the registry and configured blocks: guards, checks, errors and places."""

import json

import pytest

from strataloom.operators import blocks, registry
from strataloom.operators.registry import PARSERS
from strataloom.plans.parsing import CLASSES
from strataloom.schema import JOIN_MARK

FIELDS = "id string, parser string, name string, pick string, url string, payload string, title string, source string"


def pages(spark, *rows):
    return spark.createDataFrame([tuple({"id": str(i), "pick": "top", "url": "https://a.test/", "payload": "page", "title": "", "name": "n", **r}[f.split()[0]] for f in FIELDS.split(", ")) for i, r in enumerate(rows)], FIELDS)


def parse(spark, *rows):
    got = registry.placed(registry.parse_pages(registry.bound(pages(spark, *rows)), ["id"])).collect()
    return {r.id: (r.status, [(x.period, x.value, x.position) for x in r.rows]) for r in got}


def test_every_parser_has_a_sample_page():
    assert {p.name for p in PARSERS} == {s.parser for own in CLASSES.values() for s in own} and len({p.name for p in PARSERS}) == len(PARSERS) == 82
    assert not {p.name for p in PARSERS} & set(registry.BLOCK_PARSERS)


def test_guards_places_and_masks(spark):
    row = "007期:🧤『玄机天书』🧤绝杀二肖🧤【牛马】开:01准"
    good = {"parser": "xuanji_tianshu_admin_article", "name": "玄机天书", "source": f"<p>😀 &amp; 1366期</p><p>{row}</p>"}
    got = parse(spark, good, good | {"name": "别的"}, good | {"source": row.replace("007", "000")}, good | {"source": row.replace("牛马", "牛牛")}, good | {"source": "<script>" + row + "</script>"})
    assert got == {"0": ("ok", [(7, "牛马", 6)]), "2": ("ok", []), "3": ("ok", []), "4": ("ok", [])}


def test_joined_documents(spark):
    body = "005期:绝杀二肖-(牛马)-开:01准 004期:绝杀二肖-(羊鸡)-开:02准"
    source = f"<b>澳门广西仔</b>{JOIN_MARK}005期:本站推荐【绝杀二肖】 {body}"
    page = {"parser": "guangxizai_linked_top", "name": "广西仔", "source": source}
    got = parse(spark, page, page | {"source": source.replace("澳门广西仔", "别的")}, page | {"source": source.replace("005期:本站", "003期:本站")}, page | {"source": source.replace(JOIN_MARK, " ")})
    assert [r[:2] for r in got["0"][1]] == [(5, "牛马"), (4, "羊鸡")] and all(got[k][1] == [] for k in "123")


def test_checks_that_are_errors(spark):
    row = lambda p, v: f"{p:03d}期:《登堂入室》🥫绝杀二肖🥫【{v}】开:01准"
    page = lambda rows: {"parser": "dengtang_rushi_bottom", "name": "登堂入室", "pick": "bottom", "url": "https://a.test/topic.php?id=912", "source": "澳彩总站【绝杀二肖】" + " ".join(rows) + "提示！"}
    rows = [row((363 + k) % 365 + 1, "牛.马") for k in range(12)]
    got = parse(spark, page(rows), page(rows[:9]), page(rows + [rows[-1]]), page(rows[:5] + [row(9, "牛.牛")] + rows[6:]), page(rows[:5] + rows[6:]), page(rows) | {"url": "https://a.test/topic.php?id=1"})
    assert len(got["0"][1]) == 12 and [got[k][0] for k in "01234"] == ["ok", "field_validation", "conflict", "field_validation", "field_validation"] and "5" not in got


def test_first_run_of_one_direction(spark):
    page = lambda *periods: {"parser": "bubu_gaosheng_top", "name": "步步高升", "url": "https://azyqhiut.9kzow-3yq4j-hlwmev.work:17477/",
                             "source": "【稳杀二肖】步步高升 " + " ".join(f"{p:03d}期:稳杀二肖【牛{'马羊鸡狗猪'[k % 5]}】开:01准" for k, p in enumerate(periods))}
    got = parse(spark, page(364, 365, 1, 365), page(10, 10, 11), page(9, 9), page(5, 4, 100, 3), page(7), page(200, 100))
    assert [[r[0] for r in got[str(k)][1]] for k in range(6)] == [[364, 365, 1], [10, 11], [9], [5, 4], [7], [200]]


def test_places_are_proved(spark):
    """Places that count from the slice are found again, or refused where the text stands several times."""
    rows = "005期:绝杀二肖【牛马】开:01准 004期:绝杀二肖【羊鸡】开:02准"
    page = {"parser": "yichou_mozhan_top", "name": "一筹莫展", "source": f"005期:一筹莫展「绝杀二肖」 一筹莫展 发表于 {rows}"}
    got = parse(spark, page, page | {"source": rows + " " + page["source"]})
    at = page["source"].index("005期:绝杀")
    assert got["0"] == ("ok", [(5, "牛马", at), (4, "羊鸡", page["source"].index("004期"))]) and got["1"] == ("field_validation", [])


def posts(spark, parser, items, **more):
    docs = pages(spark, {"parser": parser, "payload": "tuku_user_forums", "source": items if isinstance(items, str) else json.dumps(items, ensure_ascii=False), **more})
    return [(r.status, [(x.period, x.value) for x in r.rows], r.path) for r in registry.parse_posts(registry.bound(docs), ["id"]).collect()]


def test_posts(spark):
    post = lambda text, topic="绝杀二肖", draw=9, nick="n": {"topic": topic, "content": text, "draw": draw, "user": {"nickname": nick}}
    first, second = "009期:绝杀二肖【牛马】开:01准 008期:绝杀二肖【羊鸡】开:02准", "008期:绝杀二肖【狗猪】开:02准"
    name = "tuku_user_forums_two_zodiac"
    assert posts(spark, name, [post(second, topic="x"), 5, post("no rows"), post(first), post("008期:绝杀二肖【羊鸡】开:02准")]) == [("ok", [(9, "牛马"), (8, "羊鸡")], "root[3].content")]
    assert posts(spark, name, [post(first), post(second)])[0][:2] == ("conflict", [])
    assert posts(spark, name, [post(first), post(second, draw=8)])[0][0] == "ok"
    assert posts(spark, name, "{broken")[0][:2] == ("ok", []) and posts(spark, name, "[]")[0][:2] == ("ok", [])
    me = {"name": "小算算", "pick": "bottom", "url": "https://zcphjs.ce83x-ms2rz-orwude.work:12277/#/users/214200"}
    one = post("003期杀牛马 ✓ 004期杀牛马羊", topic=" 杀肖 ", nick="小算算")
    assert posts(spark, "xiaosuan_bottom_two_zodiac", [one], **me)[0][1] == [(3, "牛马")] and posts(spark, "xiaosuan_bottom_two_zodiac", [one, one], **me)[0][1] == []


PAGE = "<h3>甲栏目</h3><p>001期：杀二肖【牛马】开鼠</p><p>002期：杀二肖【羊鸡】开牛</p><h3>乙栏目</h3><p>003期：杀二肖【狗猪】开虎</p>"
SOURCE = FIELDS + ", record string, stop string, linked_document_pattern string, strict_block boolean"


def block_docs(spark, *rows):
    names = [f.split()[0] for f in SOURCE.split(", ")]
    base = {"parser": "site_scoped_two_zodiac", "name": "甲栏目", "pick": "top", "url": "https://a.test/", "payload": "page", "title": "甲栏目", "source": PAGE, "record": "", "stop": "", "linked_document_pattern": "", "strict_block": False}
    return spark.createDataFrame([tuple({**base, "id": str(i), **r}[n] for n in names) for i, r in enumerate(rows)], SOURCE)


def test_blocks(spark):
    docs = block_docs(spark, {}, {"title": "丙栏目"}, {"source": PAGE + "<h3>甲栏目</h3>"}, {"stop": "没有"}, {"stop": "乙栏目"}, {"source": "看甲栏目的001期 再看甲栏目的002期<br>" + "x" * 50})
    got = {r.id: (r.block.status, r.block.text) for r in blocks.with_blocks(docs).collect()}
    assert [got[str(k)][0] for k in range(6)] == ["ok", "none", "ambiguous", "stop_missing", "ok", "ambiguous_loose"]
    assert got["0"][1] == got["4"][1] == "甲栏目 001期：杀二肖【牛马】开鼠 002期：杀二肖【羊鸡】开牛"


def test_rows_of_blocks(spark):
    own = r"(?P<period>\d{3})\s*期：(?P<x>杀)二肖【(?P<zodiac>[牛马羊鸡]{2})】开(?P<open>\S+)"
    mentions = "甲栏目很好 甲栏目更好，看下面这些很长很长的说明文字，一直写到四十个字以上为止，这样就不是标题了，对吧<br>甲栏目 001期 绝杀二肖【牛马】开鼠<br>002期 绝杀二肖【羊鸡】开牛"
    night = {"parser": "yiyechunfeng_bottom", "name": "一夜春风", "pick": "bottom", "url": "https://62139c.com/62.html", "title": "【码友一夜春风】", "stop": "【码友书阳】",
             "source": "<p>【码友一夜春风】</p>005期杀牛马√ 006期杀羊鸡✗<p>【码友书阳】</p>007期杀狗猪"}
    topic = {"parser": "new_topic_235_exact", "name": "杯中之水", "url": "https://xxn08n.w2jqr-rbl71-ngvkmq.work/topic/453967.html", "payload": "page_and_scripts"}
    docs = block_docs(spark, {}, {"parser": "named_block", "record": own}, {"source": mentions}, {"source": mentions, "strict_block": True}, {"parser": "generic_two_zodiac"}, night, topic, topic | {"payload": "page"})
    got = {r.id: (r.status, [(x.period, x.value) for x in r.rows]) for r in registry.placed(blocks.parse_blocks(docs, ["id"])).collect()}
    both = [(1, "牛马"), (2, "羊鸡")]
    assert got["0"] == got["1"] == got["6"] == ("ok", both)
    assert got["2"] == ("ok", both) and got["3"] == ("ambiguous_loose", [])
    assert got["4"] == ("ok", [*both, (3, "狗猪")]) and got["5"] == ("ok", [(5, "牛马"), (6, "羊鸡")]) and "7" not in got


@pytest.mark.parametrize("pattern,numbers", [(r"(?P<period>\d{3})(?:a|b)(x)(?P<zodiac>..)[(](?P<open>.)", (1, 3, 4)), (r"\((?P<zodiac>..)\)(?P<period>\d+)", (2, 1, 0))])
def test_group_numbers(spark, pattern, numbers):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*(blocks.group_number(F.lit(pattern), n).alias(n) for n in ("period", "zodiac", "open"))).first()
    assert tuple(row) == numbers


def test_character_references(spark):
    import html

    from pyspark.sql import functions as F

    from strataloom.functions import text as tx

    texts = ["&amp;lt; &lt &ampx &notin; &notit; &#38;&#x26;&#X26; &#128; &#0; &#xD800; &#1114112; &zwnj;&NotEqualTilde; & &; &# &#x; &nosuch; &copy2 &eacute;&Eacute", "a&b", "", "&#99999999999999999999;", "&" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.decode_entities(F.col("t"))).collect()
    assert [r[0] for r in got] == [html.unescape(t) for t in texts]
