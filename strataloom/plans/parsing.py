"""Queries over the parser registry: events written as pages of every parser's shape, and read back.

An event is a row of a page: its period counts up or down within the page, its value and result follow from its
ids. Pages are rendered from the whole events table, dealt over the parsers of a class, and parsed; the SQL twin
gives the rows that were written, for pages that have as many as the parser asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import period, registry
from strataloom.schema import JOIN_MARK, SYMBOLS

PAGE = 100


@dataclass(frozen=True)
class Sample:
    """A page of a parser: {h} heading period, {p} period, {d} period without zeros, {a}{b} value, {t} the other ten symbols, {o} result."""

    parser: str
    row: str
    head: str = ""
    tail: str = ""
    name: str = "某站"
    pick: str = "top"
    url: str = "https://a.example/"
    payload: str = "page"
    title: str = ""
    step: int = -1
    least: int = 1
    rows: int = PAGE
    result: str = "{o}"
    between: str = " "
    newest: bool = False  # the heading has the last row's period


API, SCRIPTS, FORUMS = "admin_article_api", "page_and_scripts", "tuku_user_forums"
ARTICLE = "https://a.example/article/manager/"
PLAIN = "{p}期:绝杀二肖【{a}{b}】开:{o}准"
STEADY = "{p}期:☆稳杀二肖☆【{a}{b}】开:{o}准"


def _marked(parser: str, name: str, mark: str, meaning: str, author: str | None = None, payload: str = "page") -> Sample:
    return Sample(parser, f"{{p}}期:『{author or name}』{mark}{meaning}{mark}【{{a}}-{{b}}】开:{{o}}准", name=name, payload=payload)


def _post(topic: str, nickname: str = "某人") -> tuple[str, str]:
    return f'[{{"topic": "{topic}", "draw": {{d}}, "user": {{"nickname": "{nickname}"}}, "content": "', '"}]'


CLASSES: dict[str, list[Sample]] = {
    "flat": [
        Sample("feilong_qishi_bottom", "{p}期:【飞龙骑士】今日绝杀二肖是【{a}{b}】开:{o}准", tail="下一贴:无 001期:【飞龙骑士】绝杀二肖【牛马】开:09准", name="飞龙骑士", pick="bottom",
               url="https://bbs02.836280.cyou/bbs/topic.php?id=18357", payload=SCRIPTS),
        Sample("jingzhongbaoguo_tail", "{p}期:【定杀二肖】【{a}{b}】开:{o}准", head="精忠报国【定杀二肖】"),
        Sample("nuwabutiantail", "{p}期:稳杀两肖【{a}{b}】开:{o}准", head="女娲补天【稳杀两肖】"),
        Sample("jinduobao_second_tail", "{p}期:杀【{a}{b}】肖杀【3】尾|开:{o}准", head="金多宝【杀2肖2尾】"),
        Sample("fugui_kede_admin_article", "{p}期:《富贵可得》绝杀二肖【{a}{b}】开:{o}准"),
        Sample("guanwang_touma_manager_article", "{p}期:官网透码 绝杀二肖 【{a}{b}】开:{o}准", name="官网透码"),
        Sample("songjiu_yingxin_admin_article", "{p}期:《送旧迎新》💎绝杀二肖💎【{a}、{b}】开:{o}准"),
        Sample("xuanji_tianshu_admin_article", "{p}期:🧤『玄机天书』🧤绝杀二肖🧤【{a}{b}】开:{o}准", name="玄机天书"),
        Sample("zhenlong_huoxian_admin_article", "{p}期:🥰『真龙活现』🥰绝杀二肖🥰【{a}{b}】开:{o}准"),
        Sample("manager_article_two_zodiac", "{p}期:今日《掌门人》推荐绝杀二肖精选【{a}{b}】开:{o}准", name="掌门人"),
        *(Sample(parser, f"{{p}}期:今日《{name}》推荐绝杀二肖精选【{{a}}{{b}}】开:{{o}}准", name=name, pick="bottom", url=ARTICLE + article, payload=API) for parser, name, article in (
            ("mengxiang_rensheng_manager_article", "梦想人生", "6a55eceff447e21b02daa681"), ("zhuangba_disheng_manager_article", "妆罢低声", "6a4e87bd57dc857ae1c13558"),
            ("yanji_dushan_manager_article", "燕姬独擅", "6a64ec62b3f65fed7d6286e7"), ("jinma_dushen_manager_article", "金码赌神", "6a081b9be0d076537e1df8a6"))),
        Sample("meifeise_wu_manager_article", "{p}期:今日眉飞色舞推荐绝杀二肖精选【{a}{b}】开:{o}准"),
        Sample("yanyu_fusu_list_detail", "{p}期➹绝杀二肖➹_【{a}{b}】_开:{o}准", head="{h}期:【烟雨扶苏】推荐绝杀二肖"),
        Sample("qinneng_buzhuo_read_page", "{p}期:《勤能补拙》👘绝杀二肖👘【{a}{b}】开:{o}准"),
        Sample("miesha_erxiao_two_zodiac", "{p}期:🌾灭杀二肖🌾开:{o}准 【{a} {b}】", head="88论坛 灭杀二肖", title="灭杀二肖"),
        Sample("zhougong_shensuan_two_zodiac", "{p}期绝杀二肖【{a}{b}】开:{o}准", name="周公神算", url="https://xxn08n.w2jqr-rbl71-ngvkmq.work/", payload=SCRIPTS)],
    "slice": [
        Sample("ziranziran_top", "{p}期《绝杀两肖》☆{a}{b}☆开{o}准", head="{h}期:生财有道【绝杀两肖】免费公开自然而然", tail="001期:生财有道【绝杀两肖】免费公开自然而然 001期《绝杀两肖》☆牛马☆开01准"),
        Sample("liuhe_tail", "{p}期:【绝杀两肖】【{a}{b}】开:{o}准", tail="上一篇: 001期:【绝杀两肖】【牛马】开:01准"),
        Sample("nuyanmeigu_tail", PLAIN, tail="站长宣言: " + "001期:绝杀二肖【牛马】开:01准"),
        Sample("liuhebadian_tail", "第{p}期:绝杀【{a}-{b}+5尾】开:{o}准", head="六合宝典『杀二肖一尾』", tail="六合宝典『杀三肖』"),
        Sample("wangzhejiudian_two_zodiac", "{p}期:杀二肖【★{a}.{b}★】开:{o}准", head="《王者九点网㊣杀二肖》", tail="《王者九点网㊣杀三肖》"),
        *(Sample(parser, f"{{p}}期{field}【{{a}}{{b}}】特开{{o}}准", head="禁两肖", tail="短期规律专区") for parser, field in (
            ("shuqhbq_xuanji_forbidden", "玄机网禁两肖"), ("shuqhbq_macau_kill_chart", "澳门杀两肖图"), ("shuqhbq_macau_gallery_forbidden", "澳门图库禁肖"))),
        Sample("zhuque_forbidden_material", "{p}期→禁用二肖→【{a}{b}】开{o}准", head="禁用资料", tail="热门专区"),
        Sample("wuyou_wulv_topic", "{p}期:➹绝杀二肖➹_【{a}{b}】_开:{o}准", head="{h}期【绝杀二肖】作者:无忧无虑", tail="稳赚一肖"),
        Sample("bufeng_zhuoying_topic", PLAIN, head="{h}期:【绝杀二肖】独家提供作者:捕风捉影", tail="001期:【绝杀二肖】独家提供作者:别人 001期:绝杀二肖【牛马】开:01准"),
        Sample("zhenlong_fankui_topic", "{p}期:杀2肖【{a}{b}】开{o}准", head="{h}期:鬼谷子【猛杀二肖】推荐作者:振聋发聩", tail="澳门永利"),
        Sample("gaohuo_zhifei_topic", "{p}期:☆稳杀二肖☆({a}{b})开:{o}准", head="绝杀料{h}期:【稳杀二肖】作者:膏火之费", tail="★★"),
        Sample("taxue_wuhen_top", PLAIN, head="澳门踏雪无痕『绝杀二肖』", tail="点击投注", name="踏雪无痕", least=3),
        Sample("zhuangyuan_red_top", "{p}期:绝杀②肖❇【{a}{b}】开:{o}准", head="澳门状元红 狀元紅⊙『绝杀②肖』", tail="永久域名", name="狀元紅"),
        Sample("yiben_wanli_sisha_bottom", "{p}期:❄️绝杀二肖❄️开:{o}准【{a}{b}】", head="一本万利【绝杀二肖】", tail="上一篇", name="一本万利死杀", least=3),
        Sample("liuhe_toutiao_top", "{p}期绝杀两肖【{a}{b}】开:{o}准", head="澳门六合头条 精品帖{h}期【绝杀两肖】绝对好料", name="六合头条"),
        Sample("jiulong_forum_top", "{p}期:〖杀二肖→{a}{b}〗开:{o}准", head="九龙论坛『绝杀二肖』", tail="九龙论坛『杀三肖』", name="九龙论坛"),
        Sample("shouqi_daoluo_top", "{p}期绝杀两肖【{a}{b}】开:{o}准", head="手起刀落【绝杀二肖】", tail="过分耀眼【必杀2尾】", name="手起刀落"),
        Sample("guangxizai_top", "{p}期:绝杀二肖-({a}{b})-开:{o}准", head="澳门广西仔 {h}期:本站推荐【绝杀二肖】", name="广西仔"),
        Sample("guangdong_baerzhan_top", "{p}期(必杀二肖)【{a}{b}】开:{o}准", head="澳门广东八二站 {h}期:【绝杀二肖】", name="广东"),
        Sample("yichou_mozhan_top", PLAIN, head="{h}期:一筹莫展「绝杀二肖」 一筹莫展 发表于", tail="上一篇", name="一筹莫展"),
        Sample("zhongduo_feiyi_top", "{p}期:稳杀二肖【{a}{b}】开:{o}准", head="第{h}期:众多非一【稳杀二肖】专业服务 众多非一 发表于", tail="上一篇", name="众多非一"),
        Sample("wenru_taishan_top", "{p}期稳如泰山【稳杀二肖】【{a}{b}】开:{o}准", head="{h}期:稳如泰山【稳杀二肖】已公开", tail="站长宣言:", name="稳如泰山"),
        Sample("zhuanxin_zhizhi_top", PLAIN, head="001期:绝杀二肖【牛马】开:01准 作者:专心致志", name="专心致志", url="https://xoxtpupt.bvptr-i3mv8-pbjxin.work:17455/topic/226532.html"),
        Sample("hongfuhuiyang_two_zodiac", "{p}期{a}{b}杀✓", head='惠阳 杀两肖 <table><td id="postmessage_7" class="t">', tail="</td></table> 001期牛马杀✓", result="✓")],
    "marked": [
        _marked("liuhe_daoren_admin_article", "六合道人", "🚲", "绝杀二肖"), _marked("huayan_yuemao_admin_article", "花颜月貌", "😜", "绝杀②肖", "红云红河", API),
        _marked("jinbao_mawang_manager_article", "金宝码王", "🧶", "绝杀二肖"), _marked("yeyeshengcai_admin_article", "夜夜生财", "📸", "绝杀二肖"),
        _marked("yuebaifengqing_admin_article", "月白风清", "💎", "绝杀二肖"), _marked("yangchun_caihong_read_page", "阳春彩虹", "🎆", "绝杀②肖"),
        _marked("wusuoweiju_read_page", "无所畏惧", "🍏", "绝杀二肖"), _marked("junlin_tianxia_manager_article", "君临天下", "⚽", "绝杀二肖"),
        _marked("liuhe_zhongxin_manager_article", "六合中心", "🚲", "绝杀②肖"), _marked("rushen_tantao_read_page", "如神探讨", "🚲", "绝杀②肖")],
    "chunks": [Sample(parser, f"{{p}}期杀肖统计 特开 {{o}}) {field}:【{{a}}{{b}}】", head="《王者九点网㊣杀禁统计》", tail="《王者九点网㊣杀二肖》") for parser, field in (
        ("wangzhejiudian_forbidden_chart", "禁二肖图"), ("wangzhejiudian_kill_chart", "杀二肖图"))],
    "complement": [
        Sample("laodazhu_ten_zodiac_complement", "{p}期【{t}】", head="【老大主十肖】", tail="【老二主四头】", result=""),
        Sample("suiyin_jiliang_ten_zodiac_complement", "{p}期【必中十肖】【{t}】开:{o}准", head="{h}期:碎银几两【必中十肖】推荐作者:碎银几两", tail="上一篇"),
        Sample("zhiduanqingchang_ten_zodiac_complement", "{p}期:10肖({t})", head="纸短情长", result=""),
        Sample("shiquanshimei_ten_zodiac_complement", "{p}期必中十肖【{t}】开:{o}准", head="{h}期:高手榜【必中十肖】推荐十全十美发表于", tail="下一篇")],
    "linked": [
        Sample("liuhe_toutiao_linked_top", "{p}期绝杀两肖【{a}{b}】开:{o}准", head=f"澳门六合头条{JOIN_MARK}精品帖{{h}}期【绝杀两肖】绝对好料", name="六合头条"),
        Sample("wulin_gaoshou_linked_top", "{p}期:绝杀两肖【{a}{b}】开:{o}准", head=f"武林高手{{h}}期《绝杀两肖》{JOIN_MARK}", name="武林高手"),
        Sample("guangxizai_linked_top", "{p}期:绝杀二肖-({a}{b})-开:{o}准", head=f"澳门广西仔{JOIN_MARK}{{h}}期:本站推荐【绝杀二肖】", name="广西仔"),
        Sample("guangdong_linked_top", "{p}期(必杀二肖)【{a}{b}】开:{o}准", head=f"澳门广东八二站{JOIN_MARK}{{h}}期:【绝杀二肖】", name="广东")],
    "sequence": [
        Sample("xiangfu_ercheng_tail", "{p}期:★绝杀二肖★【{a}{b}】开:{o}准", head="{h}期:【绝杀二肖】相辅而成", tail="上一篇:", step=1, least=365, rows=400, newest=True),
        Sample("baishou_qijia_tail", "{p}期:杀二肖【{a}{b}】开:{o}准", head="{h}期:白手起家【稳杀二肖】", tail="下一篇:", name="白手起家", step=1, least=365, rows=400, newest=True),
        Sample("taxue_wuhen_bottom", PLAIN, head="澳门踏雪无痕『绝杀二肖』", tail="点击投注", name="踏雪无痕", pick="bottom", least=3),
        Sample("baijie_shujinguang_top", "{p}期【白姐输尽光】开發{o} 今期{a}{b}输尽光", head="澳门姜太公☛白姐輸盡光☚", tail="澳门姜太公☛", name="白姐輸盡光", least=3, result=""),
        Sample("dengtang_rushi_bottom", "{p}期:《登堂入室》🥫绝杀二肖🥫【{a}.{b}】开:{o}准", head="澳彩总站【绝杀二肖】", tail="提示！", name="登堂入室", pick="bottom", url="https://a.example/topic.php?id=912", step=1, least=10)],
    "heading": [
        Sample("lujiu_wensha_bottom", STEADY, head="我期:49卢九【稳杀二肖】优秀推荐", tail="鸿蒙娱乐城APP", name="卢九稳杀", pick="bottom", url="https://xclpqth.4zsn8-rzqg9-ulwfyu.work:17477/topic/800282.html", step=1),
        Sample("lujiu_home_top", STEADY, head="49卢九【稳杀二肖】", tail="鸿蒙娱乐城APP", name="卢九", url="https://xclpqth.4zsn8-rzqg9-ulwfyu.work:17477/"),
        Sample("yueku_zhixiao_top", "{p}期:绝杀贰肖【{a}{b}】开:{o}准", head="绝杀料{h}期:【绝杀贰肖】创造百万月窟织绡", name="月窟织绡", url="https://jtrmhar.cwdc3-r5vqn-qzqasa.work:17455/topic/741219.html"),
        Sample("jiujie_liangfeng_top", STEADY, head="高手料{h}期:旧街凉风【稳杀二肖】", name="旧街凉风", url="https://ygaazoi.80f2d-qi0ig-gkygze.work:17488/topic/251180.html"),
        Sample("bubu_gaosheng_top", STEADY, head="【稳杀二肖】步步高升", name="步步高升", url="https://azyqhiut.9kzow-3yq4j-hlwmev.work:17477/"),
        Sample("tianlang_shaxing_bottom", "{p}期:→绝杀二肖←【{a}{b}】开:{o}准", head="精英贴{h}期天狼杀星【绝杀二肖】已上料", name="天狼杀星", pick="bottom",
               url="https://etmchyhq.cee5t-w30bf-xgqspr.work:17477/topic/248728.html", step=1)],
    "posts": [
        Sample("tuku_user_forums_two_zodiac", PLAIN, *_post("绝杀二肖"), payload=FORUMS), Sample("tuku_user_forums_short_kill", "{p}期杀{a}{b} {o}", *_post("杀肖"), payload=FORUMS),
        Sample("tuku_user_forums_precise_two_zodiac", "{p}期:精杀二肖【{a}{b}】开:{o}准", *_post("精杀二肖"), payload=FORUMS),
        Sample("tuku_user_forums_shizhuang_cut", "{p}砍-{a}{b} ✓", *_post("砍②肖", "时装某站"), payload=FORUMS, result="✓"),
        Sample("tuoni_kulmonika_snapshots", '{"draw": {d}, "topic": "杀:{a}{b}", "user": {"nickname": "托尼库尔莫妮卡"}, "content": ""}', "[", "]", name="托尼库尔莫妮卡",
               url="https://zcphjs.ce83x-ms2rz-orwude.work:12277/#/users/230245", payload=FORUMS, result="", between=", "),
        Sample("xiaosuan_bottom_two_zodiac", "{p}期杀{a}{b} ✓", *_post("杀肖", "小算算"), name="小算算", pick="bottom",
               url="https://zcphjs.ce83x-ms2rz-orwude.work:12277/#/users/214200", payload=FORUMS, result="✓")],
}
SYMBOL = lambda at: F.substring(F.lit(SYMBOLS), at.cast("int") + 1, F.lit(1))


def _samples(spark: SparkSession, kind: str) -> DataFrame:
    own = CLASSES[kind]
    fields = list(Sample.__dataclass_fields__)
    rows = [(k, *(getattr(s, f) for f in fields)) for k, s in enumerate(own)]
    return F.broadcast(spark.createDataFrame(rows, ["p", *fields]))


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def pages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(parser, sheet, name, pick, url, payload, title, source): all events as pages of the class's parsers."""
    n = len(CLASSES[kind])
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", (F.col("event_id") % n).alias("p"))
    rows = events.join(_samples(spark, kind), "p")
    rows = rows.withColumn("sheet", F.floor(F.col("event_id") / (n * F.col("rows")))).withColumn("at", F.floor(F.col("event_id") / n) % F.col("rows"))
    number = F.pmod(F.col("sheet") * 7 + F.col("step") * F.col("at"), F.lit(365)) + 1
    a, b = F.col("user_id") % 12, (F.col("user_id") + 1 + F.col("event_id") % 11) % 12
    rows = rows.select("*", number.alias("period"), SYMBOL(a).alias("a"), SYMBOL(b).alias("b"))
    ten = F.replace(F.replace(F.lit(SYMBOLS), F.col("a"), F.lit("")), F.col("b"), F.lit(""))
    line = _filled(F.col("row"), {
        "p": F.lpad(F.col("period").cast("string"), 3, "0"), "d": F.col("period").cast("string"), "a": F.col("a"), "b": F.col("b"), "t": ten,
        "o": F.lpad((F.col("event_id") % 49 + 1).cast("string"), 2, "0")})
    fixed = ["parser", "sheet", "name", "pick", "url", "payload", "title", "head", "tail", "between", "newest"]
    docs = rows.select(*fixed, "at", "period", line.alias("line")).groupBy(*fixed).agg(F.array_sort(F.collect_list(F.struct("at", "period", "line"))).alias("lines"))
    h = F.when(F.col("newest"), F.element_at("lines", -1)["period"]).otherwise(F.element_at("lines", 1)["period"])
    ends = {"h": F.lpad(h.cast("string"), 3, "0"), "d": h.cast("string")}
    source = F.concat(_filled(F.col("head"), ends), F.lit(" "), F.expr("array_join(transform(lines, x -> x.line), between)"), F.lit(" "), F.col("tail"))
    return docs.select(*fixed[:7], source.alias("source"))


def parsed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    docs = registry.bound(pages(spark, sf_dir, kind))
    keys = ["sheet"]
    found = registry.parse_posts(docs, keys) if kind == "posts" else registry.placed(registry.parse_pages(docs, keys))
    return registry.candidates_of(found.where("status = 'ok'") if kind == "posts" else found, keys).select("parser", "sheet", "period", "value", "open_result")


def twin(kind: str) -> str:
    """The rows that pages() writes, of the pages that have enough of them."""
    own = CLASSES[kind]
    rows = ", ".join(f"({k}, '{s.parser}', {s.step}, {s.least}, {s.rows}, '{s.result}')" for k, s in enumerate(own))
    n = len(own)
    pair = "a || b" if kind != "complement" else f"CASE WHEN strpos('{SYMBOLS}', a) < strpos('{SYMBOLS}', b) THEN a || b ELSE b || a END"
    return f"""
        WITH s(p, parser, step, least, size, result) AS (VALUES {rows}),
        e AS (SELECT event_id, user_id, s.*, event_id // ({n} * size) AS sheet, (event_id // {n}) % size AS nth,
                     substr('{SYMBOLS}', (user_id % 12 + 1)::INT, 1) AS a, substr('{SYMBOLS}', ((user_id + 1 + event_id % 11) % 12 + 1)::INT, 1) AS b
              FROM events JOIN s ON event_id % {n} = s.p),
        c AS (SELECT *, count(*) OVER (PARTITION BY parser, sheet) AS n FROM e)
        SELECT parser, sheet, (((sheet * 7 + step * nth) % 365 + 365) % 365 + 1)::INT AS period, {pair} AS value,
               CASE result WHEN '{{o}}' THEN lpad((event_id % 49 + 1)::VARCHAR, 2, '0') ELSE result END AS open_result
        FROM c WHERE n >= least"""


PERIODS = (1, 8, 15, 360)


def read_rows(spark: SparkSession, sf_dir: str, kind: str = "slice") -> DataFrame:
    """Rows of the pages of a class as documents of sources: the parser is the source, the page the document."""
    docs = registry.bound(pages(spark, sf_dir, kind))
    found = registry.candidates_of(registry.placed(registry.parse_pages(docs, ["sheet", "pick"])), ["sheet", "pick"])
    return found.select(F.col("parser").alias("source"), F.col("sheet").alias("document"), "pick", "position", "period", "value", F.lit("").alias("record_id"))


def _sources(spark: SparkSession, kind: str = "slice") -> DataFrame:
    return spark.createDataFrame([(s.parser,) for s in CLASSES[kind]] + [("nobody",)], "source string")


def single_period(spark, sf_dir):
    """From pages to one verdict per source, for one period."""
    return period.by_source(period.for_periods(read_rows(spark, sf_dir), [8]), _sources(spark), [8]).select("source", "status", "value", "carrier", "n_documents", "n_ok")


def multi_period(spark, sf_dir):
    return period.by_source(period.for_periods(read_rows(spark, sf_dir), PERIODS), _sources(spark), PERIODS).select("source", "requested", "status", "value", "n_ok")


def multi_failures(spark, sf_dir):
    return period.failed_everywhere(period.by_source(period.for_periods(read_rows(spark, sf_dir), PERIODS), _sources(spark), PERIODS))


def window_index(spark, sf_dir):
    rows = period.by_document(period.for_periods(read_rows(spark, sf_dir), PERIODS))
    return rows.select("source", "document", "requested", "status", "window_index")


def target_probe(spark, sf_dir):
    return period.has_target(period.for_periods(read_rows(spark, sf_dir), PERIODS))


def history_rebuild(spark, sf_dir):
    return period.rebuilt_history(read_rows(spark, sf_dir).select("source", "document", "position", "period", "value"), ["source", "document"], 8)


def _written(kind: str = "slice") -> str:
    """SQL: the rows of read_rows() with their place in the page and the direction, as table r."""
    picks = ", ".join(f"('{s.parser}', '{s.pick}')" for s in CLASSES[kind])
    base = twin(kind).replace("SELECT parser, sheet, (((", "SELECT nth, parser AS source, sheet AS document, (((").strip()
    return f"WITH picks(source, pick) AS (VALUES {picks}), r AS (SELECT t.*, pick FROM ({base}) t JOIN picks USING (source))"


def _chosen(periods: tuple[int, ...]) -> str:
    return _written() + f""",
        q AS (SELECT unnest([{', '.join(map(str, periods))}]) AS requested),
        w AS (SELECT *, row_number() OVER (PARTITION BY source, document ORDER BY CASE pick WHEN 'top' THEN nth ELSE -nth END) - 1 AS slot FROM r),
        e AS (SELECT source, document, period AS edge FROM w WHERE slot = 0),
        d AS (SELECT e.source, e.document, requested, value, slot,
                     CASE WHEN abs(CASE WHEN edge = 365 AND requested = 1 THEN 1 WHEN edge = 1 AND requested = 365 THEN -1 ELSE requested - edge END) > 3 THEN 'out_of_reach'
                          WHEN value IS NULL THEN 'not_found' ELSE 'ok' END AS status
              FROM e CROSS JOIN q LEFT JOIN w ON w.source = e.source AND w.document = e.document AND w.slot < 3 AND w.period = requested),
        s AS (SELECT source, requested, count(*) AS n_documents, count_if(status = 'ok') AS n_ok, count(DISTINCT CASE WHEN status = 'ok' THEN value END) AS vals,
                     bool_or(status = 'not_found') AS near, min(CASE WHEN status = 'ok' THEN document END) AS first, arg_min(value, document) FILTER (status = 'ok') AS v
              FROM d GROUP BY ALL),
        a AS (SELECT source, requested, CASE WHEN vals > 1 THEN 'conflict' WHEN n_ok > 0 THEN 'ok' WHEN near THEN 'not_found' WHEN n_documents > 0 THEN 'out_of_reach' ELSE 'no_rows' END AS status,
                     v, first, coalesce(n_documents, 0) AS n_documents, coalesce(n_ok, 0) AS n_ok
              FROM (SELECT source FROM picks UNION ALL SELECT 'nobody') CROSS JOIN q LEFT JOIN s USING (source, requested))"""


MISSING = "[8, 7, 6, 5, 4, 3, 2, 1, 365, 364]"
PERIOD_QUERIES = {f.__name__: f for f in (single_period, multi_period, multi_failures, window_index, target_probe, history_rebuild)}
PERIOD_ORACLE = {
    "single_period": _chosen((8,)) + " SELECT source, status, CASE status WHEN 'ok' THEN v END AS value, CASE status WHEN 'ok' THEN first END AS carrier, n_documents, n_ok FROM a",
    "multi_period": _chosen(PERIODS) + " SELECT source, requested, status, CASE status WHEN 'ok' THEN v END AS value, n_ok FROM a",
    "multi_failures": _chosen(PERIODS) + """ SELECT source, string_agg(lpad(requested::VARCHAR, 3, '0') || ':' || status, ' ' ORDER BY requested) AS reasons
        FROM a GROUP BY source HAVING bool_and(status <> 'ok')""",
    "window_index": _chosen(PERIODS) + " SELECT source, document, requested, status, (CASE status WHEN 'ok' THEN slot ELSE -1 END)::INT AS window_index FROM d",
    "target_probe": _chosen(PERIODS) + " SELECT source, requested, bool_or(status IN ('ok', 'conflict')) AS found FROM d GROUP BY ALL",
    "history_rebuild": _written() + f""",
        h AS (SELECT source, document, list_position({MISSING}, period) AS nth, period, value FROM r WHERE list_contains({MISSING}, period)),
        g AS (SELECT source, document, CASE WHEN count(DISTINCT period) < count(DISTINCT (period, value)) THEN 'conflict' WHEN count(DISTINCT period) < 10 THEN 'incomplete' ELSE 'ok' END AS status,
                     count(DISTINCT period) AS n, string_agg(value, '|' ORDER BY nth) AS "values", list(period) AS have FROM h GROUP BY ALL)
        SELECT source, document, status, n, "values", array_to_string(list_filter({MISSING}, lambda x: NOT list_contains(have, x)), ',') AS missing FROM g""",
}

QUERIES = {f"registry_{kind}": (lambda spark, sf_dir, kind=kind: parsed(spark, sf_dir, kind)) for kind in CLASSES} | PERIOD_QUERIES
ORACLE = {f"registry_{kind}": twin(kind) for kind in CLASSES} | PERIOD_ORACLE
