"""The registry of source parsers as a table: what each parser looks for, one row per parser, and one plan for all.

A parser is a table function from a document to rows (period, value, result). What differs between parsers is
data, so it stands in columns: guards, a heading, stops, a row pattern and checks on the list of rows. Documents
are joined with this table by the parser's name (it has a fixed number of rows and is sent to all executors), and
one projection does the rest: every step is an array expression over one document, so there is no exchange, one
scan serves all parsers, and positions are code points of the visible text.

A guard that fails gives no rows, not an error; what is an error is a status.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions import text as tx
from strataloom.functions.urls import record_identity
from strataloom.operators.extraction import java_pattern
from strataloom.operators.selection import period_step
from strataloom.schema import JOIN_MARK, SYMBOLS

# The pieces that the pages' headings and rows are made of.
Z = f"[{SYMBOLS}]"
PERIOD = r"(?P<period>\d{3})\s*期"
PAIR = rf"(?P<zodiac>{Z}\s*{Z})"
SPACED = rf"(?P<zodiac>{Z}\s*[-－、,，.。· ]?\s*{Z})"
DOTTED = rf"(?P<zodiac>{Z}\s*[-－、，,。.]?\s*{Z})"
TWO = r"(?:二|两|2|２|②)"
L3, R3 = r"[【〖\[]", r"[】〗\]]"
L2, R2 = "[【〖]", "[】〗]"
LA, RA = r"[【\[]", r"[】\]]"
OPEN_K = r"开\s*[:：]?\s*"
OPEN_B = r"[开開]\s*[:：]?\s*"
TILL_3 = r"(?P<open>[^\s准中错]+)"
TILL_4 = r"(?P<open>[^\s准中错赢]+)"
TILL_5 = r"(?P<open>[^\s准中错赢对]+)"
TILL_7 = r"(?P<open>[^\s准中错赢对↑√]+)"
COLON = r"\s*[:：]?\s*"
SELF = r"\s*+[:：]?+\s*+"  # the same, for an author's name that must be seen whole
POST_ENDS = "(?i)(?:上一篇|下一篇|Copyright|免责声明)"
PAGE_ENDS = "(?:上一篇|下一篇|Copyright|免责声明|返回首页)"
GAP = r"(?:(?!\d{3}\s*期).)"
MANAGER_ROW = rf"{PERIOD}\s*[:：]{GAP}{{0,45}}?[《『【〖]\s*<name>\s*[》』】〗]{GAP}{{0,70}}?绝\s*杀\s*{TWO}\s*肖{GAP}{{0,70}}?{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}"
STEADY_ROW = rf"{PERIOD}{COLON}☆?\s*稳\s*杀\s*{TWO}\s*肖\s*☆?\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_B}{TILL_7}"
ABSOLUTE_ROW = rf"{PERIOD}{COLON}绝\s*杀\s*(?:二|贰|两|2|２|②)\s*肖\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_B}{TILL_7}"
PICKS = rf"(?P<picks>[{SYMBOLS}\s]+)"
APP_AD = r"鸿蒙娱乐城APP|授权\s*[:：]\s*免费软件"


def marked(marker: str, meaning: str, authors: str = "<name>") -> str:
    """Rows that name their author and stand between two marks."""
    return (
        rf"{PERIOD}{COLON}[『〖【]\s*(?:{authors})\s*[』〗】]\s*{marker}\s*{meaning}\s*{marker}\s*"
        rf"{L3}\s*(?P<zodiac>{Z}\s*[-－、,，.。· ]{{0,3}}\s*{Z})\s*{R3}\s*{OPEN_K}{TILL_7}")


@dataclass(frozen=True)
class Parser:
    """One row of the registry. Patterns may hold <name> and <title> of their source."""

    name: str
    row: str
    kind: str = "rows"  # rows, picks, chunks, post; of posts: snapshots, posts, single, topics
    #: guards: values of the source's columns, several separated by |
    source: str | None = None
    pick: str | None = None
    url: str | None = None
    payload: str | None = None
    identity: str | None = None
    article: str | None = None  # id of the article that the address must name
    alone: bool = False  # not for documents that are joined
    linked: bool = False  # the last of joined documents has the rows, those before it the mark
    escaped: bool = False  # the source is the inside of a script string
    mark: str | None = None  # must occur in the text (in the anchor's text if linked)
    inner: str | None = None  # rows are in the first group of this match in the raw source
    start: str | None = None
    start_in_anchor: bool = False
    inclusive: bool = False  # the heading belongs to the slice
    unique: bool = False  # the heading occurs once
    then: str | None = None  # a second mark that must follow; the slice begins after it
    relative: bool = False  # positions count from the slice
    stop: str | None = None
    stop_again: str | None = None  # looked for where stop is not found
    stop_needed: bool = False
    stop_from: str = "end"  # where the search begins: end or start of the heading, or the first row
    other: str | None = None  # a heading with the group author; one of somebody else ends the slice as well
    longest: int | None = None  # of a slice without an end
    first: str | None = None  # steps that the first row may be from the heading's period, separated by |
    invalid: str = "drop"  # what a row with an invalid value does: drop, empty, keep or fail
    least: int = 0
    steps: str | None = None  # that the rows may be apart
    cycle: bool = False  # the last 365 rows are a cycle; earlier rows are not judged
    edges: str | None = None  # which rows of the judged ones may have the heading's period: last, ends or any
    monotone: bool = False  # only the first run of one direction
    fails: bool = False  # broken checks are errors


TOPIC_235 = "page_and_scripts"
FORUMS = "tuku_user_forums"

# The parsers, in the order of the catalogue. Those of configured blocks are in operators.blocks.
PARSERS = (
    Parser("feilong_qishi_bottom", rf"{PERIOD}{COLON}{L3}\s*飞龙骑士\s*{R3}[\s\S]{{0,40}}?绝\s*杀\s*{TWO}\s*肖[\s\S]{{0,20}}?{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}",
           source="飞龙骑士", pick="bottom", url="https://bbs02.836280.cyou/bbs/topic.php?id=18357", payload=TOPIC_235, alone=True, stop=r"(?:下一贴|上一篇)\s*[：:]"),
    Parser("ziranziran_top", rf"{PERIOD}\s*《\s*绝杀两肖\s*》\s*[☆★]\s*{PAIR}\s*[☆★]\s*开\s*{TILL_3}",
           start=r"\d{3}\s*期\s*[:：]\s*生财有道\s*[【\[]\s*绝杀两肖\s*[】\]]\s*免费(?:公开|公開)\s*自然而然", stop=r"\d{3}\s*期\s*[:：]\s*生财有道\s*[【\[]\s*绝杀两肖\s*[】\]]\s*免费(?:公开|公開)\s*自然而然"),
    Parser("jingzhongbaoguo_tail", rf"{PERIOD}\s*[:：]\s*{LA}\s*定杀二肖\s*{RA}\s*{LA}\s*{PAIR}\s*{RA}\s*{OPEN_K}{TILL_3}", mark=r"精忠报国\s*[【\[]\s*定杀二肖\s*[】\]]"),
    Parser("nuwabutiantail", rf"{PERIOD}\s*[:：]\s*稳杀两肖\s*{LA}\s*{PAIR}\s*{RA}\s*{OPEN_K}{TILL_3}", mark=r"女娲补天\s*[【\[]\s*稳杀两肖\s*[】\]]"),
    Parser("jinduobao_second_tail", rf"{PERIOD}\s*[:：]\s*杀\s*{LA}\s*{PAIR}\s*{RA}\s*肖\s*杀\s*{LA}\s*\d{{1,2}}\s*{RA}\s*尾\s*\|?\s*{OPEN_K}{TILL_3}",
           mark=r"金多宝\s*[【\[]\s*杀\s*[2２二两]\s*肖\s*[2２二两]\s*尾\s*[】\]]"),
    Parser("liuhe_tail", rf"{PERIOD}\s*[:：]\s*{LA}\s*绝杀两肖\s*{RA}\s*{LA}\s*{PAIR}\s*{RA}\s*{OPEN_B}{TILL_3}", stop=r"(?:上一篇|下一篇)\s*[:：]"),
    Parser("nuyanmeigu_tail", rf"{PERIOD}\s*[:：]\s*绝杀二肖\s*{LA}\s*{PAIR}\s*{RA}\s*{OPEN_K}{TILL_3}", stop=r"站长宣言\s*[:：]", stop_needed=True),
    Parser("liuhebadian_tail", rf"第?\s*{PERIOD}{COLON}绝\s*杀\s*{L2}\s*{SPACED}\s*\+\s*\d+\s*尾\s*{R2}\s*{OPEN_B}{TILL_5}",
           start=r"六合宝典\s*『\s*杀\s*二\s*肖\s*[一二两2２]?\s*尾\s*』", inclusive=True, stop=r"六合宝典\s*『(?!\s*杀\s*二\s*肖\s*[一二两2２]?\s*尾\s*』)"),
    Parser("wangzhejiudian_two_zodiac", rf"{PERIOD}{COLON}杀\s*二\s*肖\s*{L2}\s*★?\s*{SPACED}\s*★?\s*{R2}\s*{OPEN_B}{TILL_5}",
           start=r"《\s*王者九点网\s*㊣\s*杀\s*二\s*肖\s*》", inclusive=True, stop=r"《\s*王者九点网\s*㊣(?!\s*杀\s*二\s*肖\s*》)"),
    *(Parser(name, rf"{field}\s*[:：]\s*{L2}\s*{SPACED}\s*{R2}", kind="chunks", start=r"《\s*王者九点网\s*㊣\s*杀\s*禁\s*统计\s*》", inclusive=True,
             stop=r"《\s*王者九点网\s*㊣(?!\s*杀\s*禁\s*统计\s*》)") for name, field in (("wangzhejiudian_forbidden_chart", "禁二肖图"), ("wangzhejiudian_kill_chart", "杀二肖图"))),
    *(Parser(name, rf"{PERIOD}\s*{field}\s*{L2}\s*{SPACED}\s*{R2}\s*特\s*[开開]\s*{TILL_5}", start=r"禁\s*两\s*肖", inclusive=True,
             stop="(?:短期规律专区|长期规律专区|热门专区|精品专区|精华帖)") for name, field in (
        ("shuqhbq_xuanji_forbidden", "玄机网禁两肖"), ("shuqhbq_macau_kill_chart", "澳门杀两肖图"), ("shuqhbq_macau_gallery_forbidden", "澳门图库禁肖"))),
    Parser("zhuque_forbidden_material", rf"{PERIOD}\s*[→>＞\-—–✈]*\s*禁\s*用\s*二\s*肖\s*[→>＞\-—–✈]*\s*{L2}\s*{SPACED}\s*{R2}\s*[开開]\s*{TILL_5}",
           start=r"177792a\.com\s*『\s*禁\s*用\s*资\s*料\s*』|禁\s*用\s*资\s*料", inclusive=True, stop=r"(?:禁\s*两\s*肖|短期规律专区|长期规律专区|热门专区|精品专区)"),
    Parser("tuku_user_forums_two_zodiac", rf"{PERIOD}\s*[：:]?\s*绝\s*杀\s*{TWO}\s*肖\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}", kind="snapshots", mark="<title>"),
    Parser("tuku_user_forums_short_kill", rf"{PERIOD}\s*杀\s*{SPACED}\s*(?P<open>[{SYMBOLS}？?0-9０-９]*)", kind="snapshots", mark=r"(?s)^(?!.*(?:三肖|六码|波|尾)).*杀"),
    Parser("tuku_user_forums_precise_two_zodiac", rf"{PERIOD}\s*[：:]?\s*精\s*杀\s*{TWO}\s*肖\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}", kind="snapshots", mark="(?s)^(?!.*三肖).*精杀二肖"),
    Parser("tuku_user_forums_shizhuang_cut", rf"(?P<period>\d{{3}})\s*砍\s*[-－]\s*{SPACED}\s*(?P<open>[✓✔√]?)", kind="posts", mark="(?s)^(?=.*砍).*②肖"),
    Parser("wuyou_wulv_topic", rf"{PERIOD}{COLON}➹\s*绝\s*杀\s*{TWO}\s*肖\s*➹\s*_\s*{L3}\s*{SPACED}\s*{R3}\s*_\s*{OPEN_B}{TILL_7}",
           start=rf"\d{{3}}\s*期\s*{L2}\s*绝\s*杀\s*{TWO}\s*肖\s*{R2}\s*作者{COLON}无忧无虑", inclusive=True, stop="(?:稳赚一肖|①肖①码|三期六码|Copyright|返回首页)"),
    Parser("fugui_kede_admin_article", rf"{PERIOD}{COLON}《\s*富贵可得\s*》\s*绝\s*杀\s*{TWO}\s*肖\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}"),
    Parser("guanwang_touma_manager_article", rf"{PERIOD}{COLON}官网透码{GAP}{{0,20}}?绝\s*杀\s*{TWO}\s*肖{GAP}{{0,20}}?{L3}\s*(?P<zodiac>{Z}\s*[-－、,，.。· ]?{Z})\s*{R3}\s*{OPEN_K}{TILL_7}", source="官网透码"),
    Parser("songjiu_yingxin_admin_article", rf"{PERIOD}{COLON}《\s*送旧迎新\s*》\s*💎\s*绝\s*杀\s*{TWO}\s*肖\s*💎\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}"),
    Parser("liuhe_daoren_admin_article", marked("🚲", "绝杀二肖")),
    Parser("huayan_yuemao_admin_article", marked("😜", "绝杀②肖", "花颜月貌|红云红河"), source="花颜月貌", payload="admin_article_api"),
    Parser("jinbao_mawang_manager_article", marked("🧶", "绝杀二肖"), source="金宝码王"),
    Parser("xuanji_tianshu_admin_article", rf"{PERIOD}{COLON}🧤\s*[『〖【]\s*玄机天书\s*[』〗】]\s*🧤\s*绝杀二肖\s*🧤\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}", source="玄机天书"),
    Parser("yeyeshengcai_admin_article", marked("📸", "绝杀二肖")),
    Parser("yuebaifengqing_admin_article", marked("💎", "绝杀二肖")),
    Parser("yangchun_caihong_read_page", marked("🎆", "绝杀②肖")),
    Parser("wusuoweiju_read_page", marked("🍏", "绝杀二肖")),
    Parser("zhenlong_huoxian_admin_article", rf"{PERIOD}{COLON}🥰\s*[『〖【]\s*真龙活现\s*[』〗】]\s*🥰\s*绝杀二肖\s*🥰\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}"),
    Parser("junlin_tianxia_manager_article", marked("⚽", "绝杀二肖"), source="君临天下"),
    Parser("liuhe_zhongxin_manager_article", marked("🚲", "绝杀②肖"), source="六合中心"),
    Parser("manager_article_two_zodiac", MANAGER_ROW),
    *(Parser(name, MANAGER_ROW, source=source, pick="bottom", payload="admin_article_api", article=article, alone=True) for name, source, article in (
        ("mengxiang_rensheng_manager_article", "梦想人生", "6a55eceff447e21b02daa681"), ("zhuangba_disheng_manager_article", "妆罢低声", "6a4e87bd57dc857ae1c13558"),
        ("yanji_dushan_manager_article", "燕姬独擅", "6a64ec62b3f65fed7d6286e7"), ("jinma_dushen_manager_article", "金码赌神", "6a081b9be0d076537e1df8a6"))),
    Parser("meifeise_wu_manager_article", rf"{PERIOD}\s*[:：]{GAP}{{0,45}}?眉飞色舞{GAP}{{0,70}}?绝\s*杀\s*{TWO}\s*肖{GAP}{{0,70}}?{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}"),
    Parser("yanyu_fusu_list_detail", rf"{PERIOD}\s*➹\s*绝\s*杀\s*{TWO}\s*肖\s*➹\s*_\s*{L3}\s*{SPACED}\s*{R3}\s*_\s*{OPEN_B}{TILL_7}",
           mark=rf"\d{{3}}\s*期\s*[:：]\s*{L2}\s*烟雨扶苏\s*{R2}.{{0,40}}?绝\s*杀\s*{TWO}\s*肖"),
    Parser("qinneng_buzhuo_read_page", rf"{PERIOD}{COLON}《\s*勤能补拙\s*》\s*👘\s*绝\s*杀\s*{TWO}\s*肖\s*👘\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}"),
    Parser("rushen_tantao_read_page", marked("🚲", "绝杀②肖"), source="如神探讨"),
    Parser("laodazhu_ten_zodiac_complement", rf"{PERIOD}\s*{L3}\s*{PICKS}\s*{R3}", kind="picks", start="【老大主十肖】", inclusive=True, stop="【老二主四头】"),
    Parser("suiyin_jiliang_ten_zodiac_complement", rf"{PERIOD}\s*{L2}\s*必中十肖\s*{R2}\s*{L2}\s*{PICKS}\s*{R2}\s*{OPEN_B}{TILL_7}", kind="picks",
           start=rf"\d{{3}}\s*期\s*[:：]\s*碎银几两\s*{L2}\s*必中十肖\s*{R2}.{{0,80}}?作者\s*[:：]\s*碎银几两", inclusive=True, stop=PAGE_ENDS, stop_from="start"),
    Parser("zhiduanqingchang_ten_zodiac_complement", rf"{PERIOD}{COLON}10\s*肖\s*[（(]{PICKS}[）)]", kind="picks", mark="纸短情长"),
    Parser("shiquanshimei_ten_zodiac_complement", rf"{PERIOD}\s*必中十肖\s*{L3}\s*{PICKS}\s*{R3}\s*{OPEN_B}{TILL_7}", kind="picks",
           start=rf"\d{{3}}\s*期\s*[:：]\s*高手榜\s*{L2}\s*必中十肖\s*{R2}[\s\S]{{0,60}}?十全十美\s*发表于", inclusive=True, stop=PAGE_ENDS, stop_from="start"),
    Parser("hongfuhuiyang_two_zodiac", rf"{PERIOD}\s*(?P<zodiac>{Z}{Z})\s*杀\s*(?P<open>[✓❌√×]?)", kind="post", mark="^(?=.*惠阳).*杀两肖", inner=r'id="postmessage_\d+"[^>]*>([\s\S]*?)</td>'),
    Parser("miesha_erxiao_two_zodiac", rf"{PERIOD}{COLON}[^\s]{{0,12}}\s*<title>\s*[^\s]{{0,12}}\s*{OPEN_B}(?P<open>[^\s准中错赢对【]+)\s*(?:准|中|错|赢|对)?\s*{L3}\s*{PAIR}\s*{R3}", mark="^(?=.*88论坛).*<title>"),
    Parser("bufeng_zhuoying_topic", rf"{PERIOD}{COLON}绝\s*杀\s*{TWO}\s*肖\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}",
           start=rf"\d{{3}}\s*期\s*[:：]\s*{L2}\s*绝杀二肖\s*{R2}\s*独家提供\s*作者{COLON}捕风捉影", inclusive=True, stop="(?:上一篇|下一篇|★★|Copyright)", stop_from="start",
           other=rf"\d{{3}}\s*期\s*[:：]\s*{L2}\s*绝杀二肖\s*{R2}\s*独家提供\s*作者{SELF}(?!捕风捉影(?:\s|$))[^\s]+"),
    Parser("zhenlong_fankui_topic", rf"{PERIOD}{COLON}杀\s*[２2二两②]\s*肖\s*{L3}\s*{SPACED}\s*{R3}\s*[-－—]*\s*开\s*{TILL_7}",
           start=rf"\d{{3}}\s*期\s*[:：]\s*鬼谷子\s*{L2}\s*猛杀二肖\s*{R2}.{{0,80}}?作者{COLON}振聋发聩", inclusive=True, stop="(?:鸿蒙娱乐城|澳门永利|Android版|iPhone版|Copyright)",
           stop_from="start", other=rf"\d{{3}}\s*期\s*[:：]\s*鬼谷子\s*{L2}\s*猛杀二肖\s*{R2}(?:(?!作者).){{0,80}}作者{SELF}(?!振聋发聩(?:\s|$))[^\s]+", longest=2000),
    Parser("gaohuo_zhifei_topic", rf"{PERIOD}{COLON}☆\s*稳\s*杀\s*{TWO}\s*肖\s*☆\s*[（(]\s*{SPACED}\s*[）)]?\s*{OPEN_K}{TILL_7}",
           start=rf"绝杀料\s*\d{{3}}\s*期\s*[:：]\s*{L2}\s*稳杀二肖\s*{R2}\s*作者{COLON}膏火之费", inclusive=True, stop="(?:★★|博彩必备|点击进入官网投注|Copyright)", stop_from="start",
           other=rf"绝杀料\s*\d{{3}}\s*期\s*[:：]\s*{L2}\s*稳杀二肖\s*{R2}\s*作者{SELF}(?!膏火之费(?:\s|$))[^\s]+"),
    Parser("xiangfu_ercheng_tail", rf"{PERIOD}\s*[:：]\s*★\s*绝杀二肖\s*★\s*{LA}\s*{PAIR}\s*{RA}\s*{OPEN_K}{TILL_3}",
           start=rf"{PERIOD}\s*[:：]\s*{LA}\s*绝杀二肖\s*{RA}\s*相辅而成", stop=r"上一篇\s*[:：]", stop_needed=True, invalid="keep", steps="1", cycle=True, edges="ends"),
    Parser("baishou_qijia_tail", rf"{PERIOD}\s*[:：]\s*杀二肖\s*【\s*{PAIR}\s*】\s*{OPEN_K}{TILL_4}", source="白手起家",
           start=rf"{PERIOD}{COLON}白手起家\s*【\s*稳杀二肖\s*】", stop=r"(?:上一篇|下一篇)\s*[:：]", stop_needed=True, invalid="empty", steps="1", cycle=True, edges="last"),
    Parser("taxue_wuhen_bottom", rf"{PERIOD}\s*[:：]\s*绝\s*杀\s*二\s*肖\s*【\s*{PAIR}\s*】\s*{OPEN_K}{TILL_5}", source="踏雪无痕",
           start=r"澳门\s*踏雪无痕\s*『\s*绝\s*杀\s*二\s*肖\s*』", stop="点击投注", stop_needed=True, invalid="empty", least=3, steps="-1"),
    Parser("taxue_wuhen_top", rf"{PERIOD}{COLON}绝\s*杀\s*二\s*肖\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_B}{TILL_7}", source="踏雪无痕", pick="top",
           start=r"澳门\s*踏雪无痕\s*『\s*绝\s*杀\s*二\s*肖\s*』", unique=True, stop="点击投注", stop_needed=True, least=3),
    Parser("zhuangyuan_red_top", rf"{PERIOD}{COLON}绝杀②肖\s*❇\s*[〖【]\s*{SPACED}\s*[〗】]\s*{OPEN_K}{TILL_7}", source="狀元紅", pick="top|bottom",
           start=r"澳门\s*状元红\s+狀元紅\s*⊙\s*[『〖【]\s*绝杀②肖\s*[』〗】]", unique=True, stop="(?i)永久域名|" + PAGE_ENDS),
    Parser("yiben_wanli_sisha_bottom", rf"{PERIOD}{COLON}(?:❄️\s*)?绝\s*杀\s*二\s*肖(?:\s*❄️)?\s*{OPEN_B}{TILL_5}\s*(?:准|中|错|赢|对)\s*{L3}\s*{PAIR}\s*{R3}", source="一本万利死杀",
           start=rf"一本万利\s*{L3}\s*绝\s*杀\s*二\s*肖\s*{R3}", stop="(?i)(?:上一篇|下一篇|返回首页|Copyright|免责声明)", invalid="empty", least=3),
    Parser("baijie_shujinguang_top", rf"(?P<period>\d{{3}})期\s*{L3}\s*白姐\s*[输輸]\s*[尽盡]光\s*{R3}\s*[开開](?:[發发])?\s*[^\s]+\s*今\s*期\s*{PAIR}\s*[输輸]\s*[尽盡]光", source="白姐輸盡光",
           escaped=True, start=r"澳门\s*姜太公\s*☛\s*白姐\s*輸\s*盡\s*光\s*☚", stop=r"澳门\s*姜太公\s*☛", stop_again=r"最具\s*权\s*威\s*港\s*澳六合彩|58\s*倍\s*967\.cc", stop_needed=True,
           invalid="empty", least=3, steps="0|-1"),
    Parser("liuhe_toutiao_top", rf"{PERIOD}\s*绝杀两肖\s*{L2}\s*{PAIR}\s*{R2}\s*{OPEN_B}{TILL_5}", source="六合头条", mark=r"澳[门門]\s*六合头条|六合头条论坛",
           start=rf"精品帖\s*\d{{3}}\s*期\s*{L2}\s*绝杀两肖\s*{R2}\s*绝对好料"),
    Parser("liuhe_toutiao_linked_top", rf"{PERIOD}\s*绝杀两肖\s*{L2}\s*{DOTTED}\s*{R2}\s*{OPEN_B}{TILL_5}", source="六合头条", pick="top", linked=True,
           mark=r"澳[门門]\s*六合头条|六合头条论坛", start=rf"精品帖\s*{PERIOD}\s*{L2}\s*绝杀两肖\s*{R2}\s*绝对好料", first="0|-1"),
    Parser("jiulong_forum_top", rf"{PERIOD}{COLON}[〖【]\s*杀\s*{TWO}\s*肖\s*[→>]\s*{DOTTED}\s*[〗】]\s*{OPEN_K}{TILL_5}", source="九龙论坛", pick="top",
           start=r"九龙论坛\s*『\s*绝杀二肖\s*』", stop=r"九龙论坛\s*『(?!\s*绝杀二肖\s*』)"),
    Parser("shouqi_daoluo_top", rf"{PERIOD}\s*绝杀两肖\s*{L2}\s*{DOTTED}\s*{R2}\s*{OPEN_B}{TILL_5}", source="手起刀落", pick="top",
           start=r"手起刀落\s*[【〖『]\s*绝杀二肖\s*[】〗』]", stop=r"过分耀眼\s*[【〖『]\s*必杀\s*(?:2|２|二|两)\s*尾"),
    Parser("wulin_gaoshou_linked_top", rf"{PERIOD}{COLON}绝杀两肖\s*{L2}\s*{DOTTED}\s*{R2}\s*{OPEN_B}{TILL_5}", source="武林高手", pick="top", linked=True,
           mark=r"武林高手\s*(?P<period>\d{3})\s*期\s*《\s*绝杀两肖\s*》", start=rf"武林高手\s*{PERIOD}\s*《\s*绝杀两肖\s*》", start_in_anchor=True, first="0"),
    Parser("guangxizai_linked_top", rf"{PERIOD}{COLON}绝杀二肖\s*[-－]\s*[（(]\s*{DOTTED}\s*[）)]\s*[-－]\s*{OPEN_B}{TILL_5}", source="广西仔", pick="top", linked=True,
           mark=r"澳[门門]\s*广西仔", start=rf"{PERIOD}\s*[:：]\s*本站推荐\s*{L2}\s*绝杀二肖\s*{R2}", first="0"),
    Parser("guangdong_linked_top", rf"{PERIOD}\s*[（(]\s*必杀二肖\s*[）)]\s*{L2}\s*{DOTTED}\s*{R2}\s*{OPEN_B}{TILL_5}", source="广东", pick="top", linked=True,
           mark=r"澳[门門]\s*广东八二站|广东八二站", start=rf"{PERIOD}{COLON}{L2}\s*绝杀二肖\s*{R2}", first="0"),
    Parser("guangxizai_top", rf"{PERIOD}\s*[:：]\s*绝杀二肖\s*[-－]\s*[（(]\s*{PAIR}\s*[）)]\s*[-－]\s*{OPEN_B}{TILL_5}", source="广西仔", mark=r"澳[门門]\s*广西仔",
           start=rf"{PERIOD}\s*[:：]\s*本站推荐\s*{L2}\s*绝杀二肖\s*{R2}", first="0"),
    Parser("guangdong_baerzhan_top", rf"{PERIOD}\s*[（(]\s*必杀二肖\s*[）)]\s*{L2}\s*{PAIR}\s*{R2}\s*{OPEN_B}{TILL_5}", source="广东", mark=r"澳[门門]\s*广东八二站|广东八二站",
           start=rf"{PERIOD}\s*[:：]\s*{L2}\s*绝杀二肖\s*{R2}", first="0"),
    Parser("dengtang_rushi_bottom", rf"{PERIOD}{COLON}《\s*登堂入室\s*》\s*🥫\s*绝杀二肖\s*🥫\s*{LA}\s*(?P<zodiac>{Z}\s*[.。·、，,－-]\s*{Z})\s*{RA}\s*{OPEN_B}{TILL_5}", source="登堂入室", pick="bottom",
           identity="topic.php:912", start=rf"澳彩总站\s*{L2}\s*绝杀二肖\s*{R2}", stop="(?i)提示！|六合优秀站点收录|Copyright", stop_needed=True, invalid="fail", least=10, steps="1", fails=True),
    Parser("yichou_mozhan_top", rf"{PERIOD}{COLON}绝杀二肖\s*{L3}\s*{PAIR}\s*{R3}\s*{OPEN_K}{TILL_7}", source="一筹莫展", pick="top",
           start=rf"{PERIOD}\s*[:：]\s*一筹莫展\s*[「『【]\s*绝杀二肖\s*[」』】]", then=r"一筹莫展\s*发表于", relative=True, stop=POST_ENDS),
    Parser("zhongduo_feiyi_top", rf"{PERIOD}{COLON}稳杀二肖\s*{L3}\s*{PAIR}\s*{R3}\s*{OPEN_K}{TILL_7}", source="众多非一", pick="top",
           start=rf"第{PERIOD}\s*[:：]\s*众多非一\s*{L3}\s*稳杀二肖\s*{R3}\s*专业服务", then=r"众多非一\s*发表于", relative=True, stop=POST_ENDS, first="0"),
    Parser("wenru_taishan_top", rf"{PERIOD}\s*稳如泰山\s*{L3}\s*稳杀二肖\s*{R3}\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_B}{TILL_7}", source="稳如泰山", pick="top", alone=True,
           start=rf"{PERIOD}\s*[:：]\s*稳如泰山\s*{L3}\s*稳杀二肖\s*{R3}\s*已公开", stop=r"(?i)(?:站长宣言|上一篇|下一篇|Copyright|免责声明)\s*[:：]?", first="0"),
    Parser("zhougong_shensuan_two_zodiac", rf"{PERIOD}\s*绝\s*杀\s*{TWO}\s*肖\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_K}{TILL_7}",
           source="周公神算", pick="top", url="https://xxn08n.w2jqr-rbl71-ngvkmq.work/", payload=TOPIC_235, alone=True),
    Parser("tuoni_kulmonika_snapshots", rf"^杀\s*[:：]\s*{SPACED}$", kind="topics", source="托尼库尔莫妮卡", pick="top",
           url="https://zcphjs.ce83x-ms2rz-orwude.work:12277/#/users/230245", payload=FORUMS, alone=True),
    Parser("xiaosuan_bottom_two_zodiac", rf"{PERIOD}\s*(?:杀\s*)?{SPACED}(?!\s*{Z})\s*(?P<open>[✓✔√❌？?]*)", kind="single", source="小算算", pick="bottom",
           url="https://zcphjs.ce83x-ms2rz-orwude.work:12277/#/users/214200", payload=FORUMS, alone=True, mark="杀肖"),
    Parser("lujiu_wensha_bottom", STEADY_ROW, source="卢九稳杀", pick="bottom", url="https://xclpqth.4zsn8-rzqg9-ulwfyu.work:17477/topic/800282.html", alone=True, unique=True,
           start=rf"(?:\d{{3}}\s*期|我期)\s*[:：]\s*49卢九\s*{L2}\s*稳杀二肖\s*{R2}\s*优秀推荐", stop=APP_AD, stop_from="row", monotone=True, edges="any"),
    Parser("lujiu_home_top", STEADY_ROW, source="卢九", pick="top", url="https://xclpqth.4zsn8-rzqg9-ulwfyu.work:17477/", alone=True, unique=True,
           start=rf"49卢九\s*{L2}\s*稳杀二肖\s*{R2}", stop=APP_AD, stop_from="row", monotone=True, edges="any"),
    Parser("yueku_zhixiao_top", ABSOLUTE_ROW, source="月窟织绡", pick="top", url="https://jtrmhar.cwdc3-r5vqn-qzqasa.work:17455/topic/741219.html", alone=True, unique=True,
           start=rf"绝杀料\s*\d{{3}}\s*期\s*[:：]\s*{L2}\s*绝杀贰肖\s*{R2}\s*创造百万\s*月窟织绡", monotone=True, edges="any"),
    Parser("jiujie_liangfeng_top", STEADY_ROW, source="旧街凉风", pick="top", url="https://ygaazoi.80f2d-qi0ig-gkygze.work:17488/topic/251180.html", alone=True, unique=True,
           start=rf"高手料\s*\d{{3}}\s*期\s*[:：]\s*旧街凉风\s*{L2}\s*稳杀二肖\s*{R2}", monotone=True, edges="any"),
    Parser("bubu_gaosheng_top", STEADY_ROW, source="步步高升", pick="top", url="https://azyqhiut.9kzow-3yq4j-hlwmev.work:17477/", alone=True, unique=True,
           start=rf"{L2}\s*稳杀二肖\s*{R2}\s*步步高升", monotone=True, edges="any"),
    Parser("tianlang_shaxing_bottom", rf"{PERIOD}\s*[:：]\s*→\s*绝\s*杀\s*{TWO}\s*肖\s*←\s*{L3}\s*{SPACED}\s*{R3}\s*{OPEN_B}{TILL_7}", source="天狼杀星", pick="bottom",
           url="https://etmchyhq.cee5t-w30bf-xgqspr.work:17477/topic/248728.html", alone=True, unique=True, start=rf"精英贴\s*\d{{3}}\s*期\s*天狼杀星\s*{L2}\s*绝杀二肖\s*{R2}\s*已上料", monotone=True, edges="any"),
    Parser("zhuanxin_zhizhi_top", rf"{PERIOD}{COLON}绝\s*杀\s*{TWO}\s*肖\s*{L3}\s*{DOTTED}\s*{R3}\s*{OPEN_B}{TILL_5}", source="专心致志", pick="top",
           url="https://xoxtpupt.bvptr-i3mv8-pbjxin.work:17455/topic/226532.html", start=r"作者\s*[:：]\s*专心致志", inclusive=True, unique=True),
)
#: The configured-block parsers; what they look for is in the source's own row.
BLOCK_PARSERS = ("named_block", "generic_two_zodiac", "site_scoped_two_zodiac", "new_topic_235_exact", "yiyechunfeng_bottom")
CYCLE, MOST_ROWS, WIDEST_GAP = 365, 400, 40
#: Kinds whose documents are lists of posts.
OF_POSTS = ("snapshots", "posts", "single", "topics")
CHUNK = r"(?P<period>\d{3})\s*期\s*杀\s*肖\s*统计"
CHUNK_OPEN = r"特\s*[开開]\s*([^)\s]+)"

POST = "topic string, content string, draw string, user string"
ROW = "struct<position:int,period:int,value:string,open_result:string,raw:string,valid:boolean>"


def registry(spark: SparkSession) -> DataFrame:
    """One row per parser: its fields, patterns as Java has them, and the numbers of their groups."""
    types = {"bool": T.BooleanType(), "int": T.IntegerType(), "int | None": T.IntegerType()}
    schema = T.StructType([T.StructField(n, types.get(f.type, T.StringType())) for n, f in Parser.__dataclass_fields__.items()])
    for extra in ("period_group", "value_group", "open_group"):
        schema = schema.add(extra, T.IntegerType())
    rows = []
    for p in PARSERS:
        fields = asdict(p)
        groups = java_pattern(p.row)[1]
        for c in ("row", "mark", "inner", "start", "then", "stop", "stop_again", "other"):
            if fields[c] is not None:
                fields[c] = java_pattern(fields[c])[0]
        rows.append((*fields.values(), groups.get("period", 0), groups.get("zodiac", groups.get("picks", 0)), groups.get("open", 0)))
    return spark.createDataFrame(rows, schema)


def bound(docs: DataFrame) -> DataFrame:
    """Documents (with a column parser) with their parser's row as struct s; the table is of fixed size and sent.

    Documents of an unknown parser, or of one for configured blocks, have a null s.
    """
    specs = registry(docs.sparkSession)
    specs = specs.select(F.col("name").alias("parser"), F.struct(*specs.columns).alias("s"))
    return docs.join(F.broadcast(specs), "parser", "left")


def _found(text: Column, pattern: Column) -> Column:
    """struct<at, end> of the first match; fields are null if there is none, the pattern is null or the text is."""
    parts = F.split(text, pattern, 2)
    hit = F.size(parts) == 2
    return F.struct(
        F.when(hit, F.char_length(F.element_at(parts, 1))).alias("at"),
        F.when(hit, F.char_length(text) - F.char_length(F.get(parts, F.lit(1)))).alias("end"))


def _extract(text: Column, pattern: Column, group: Column) -> Column:
    """A group of the first match of a pattern that is a column."""
    return F.call_function("regexp_extract", text, pattern, group)


def _after(text: Column, place: Column) -> Column:
    return F.substring(text, place + 1, F.char_length(text))


def _rows(text: Column, s: Column, base: Column) -> Column:
    """array<ROW> of the row pattern's matches in a text that begins at base."""
    found = tx.matches(text, s["row"], (s["period_group"], s["value_group"], s["open_group"], F.lit(0)))
    picks = lambda m: F.regexp_extract_all(m["g1"], F.lit(f"({Z})"), F.lit(1))
    ten = lambda m: tx.bound(picks(m), lambda p: F.when((F.size(p) == 10) & (F.size(F.array_distinct(p)) == 10), F.array_join(tx.complement(list(SYMBOLS), p), "")).otherwise(""))

    def row(m: Column) -> Column:
        value = F.when(s["kind"] == "picks", ten(m)).otherwise(tx.clean_value(m["g1"]))
        digits = F.translate(m["g0"], "０１２３４５６７８９", "0123456789")
        return tx.bound(value, lambda v: F.struct(
            (base + m["offset"]).alias("position"), digits.try_cast("int").alias("period"), v.alias("value"),
            F.when(s["open_group"] > 0, m["g2"]).otherwise("").alias("open_result"), m["g3"].alias("raw"),
            (F.char_length(v) == 2).alias("valid")))

    return F.transform(found, row)


def _chunk_rows(text: Column, s: Column, base: Column) -> Column:
    """array<ROW> of the fields of each chunk; a chunk goes from one period's heading to the next."""
    head = "(?U)" + CHUNK.replace("(?P<", "(?<")

    def fields(h: Column, body: Column) -> Column:
        opened = F.regexp_extract(body, "(?U)" + CHUNK_OPEN, 1)
        start, period = base + h["offset"] + F.char_length(h["g1"]), h["g0"].try_cast("int")
        row = lambda m, o, v: F.struct(
            (start + m["offset"]).alias("position"), period.alias("period"), v.alias("value"), o.alias("open_result"), m["g1"].alias("raw"), (F.char_length(v) == 2).alias("valid"))
        own = tx.matches(body, s["row"], (s["value_group"], F.lit(0)))
        return tx.bound(opened, lambda o: F.transform(own, lambda m: tx.bound(tx.clean_value(m["g0"]), lambda v: row(m, o, v))))

    # what lies between the headings is split off once for all chunks
    cut = F.struct(F.slice(F.split(text, head, -1), 2, F.size(F.split(text, head, -1))).alias("bodies"), tx.matches(text, head, (1, 0)).alias("heads"))
    return tx.bound(cut, lambda c: F.flatten(F.zip_with(c["heads"], c["bodies"], fields)))


def _step(rows: Column, i: Column) -> Column:
    return period_step(F.element_at(rows, i)["period"], F.element_at(rows, i + 1)["period"])


def _steps_allowed(rows: Column, allowed: Column) -> Column:
    places = F.when(F.size(rows) > 1, F.sequence(F.lit(1), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
    return F.forall(places, lambda i: F.array_contains(F.split(allowed, "\\|"), _step(rows, i).cast("string")))


def first_run(rows: Column) -> Column:
    """The rows of the first run of one direction: repeated periods are left out, a turn or a wide gap ends it."""
    start = F.struct(F.slice(rows, 1, 1).alias("kept"), F.lit(0).alias("sign"), F.lit(True).alias("going"))

    def add(acc: Column, x: Column) -> Column:
        step = period_step(F.element_at(acc["kept"], -1)["period"], x["period"])
        fits = (F.abs(step) <= WIDEST_GAP) & ((acc["sign"] == 0) | (F.signum(step).cast("int") == acc["sign"]))
        return (
            F.when(~acc["going"] | (step == 0), acc)
            .when(fits, F.struct(F.array_append(acc["kept"], x).alias("kept"), F.signum(step).cast("int").alias("sign"), F.lit(True).alias("going")))
            .otherwise(F.struct(acc["kept"].alias("kept"), acc["sign"].alias("sign"), F.lit(False).alias("going"))))

    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, add, lambda acc: acc["kept"])


def _guard(s: Column) -> Column:
    """Whether a document's source is one that the parser is for."""
    def same(c: str) -> Column:
        return F.coalesce(F.array_contains(F.split(s[c], "\\|"), F.col({"source": "name"}.get(c, c))), s[c].isNull())

    article = F.regexp_extract("url", "(?i)/article/manager/([^/?#]+)", 1)
    return (
        same("source") & same("pick") & (s["url"].isNull() | F.col("url").eqNullSafe(s["url"])) & same("payload")
        & (s["identity"].isNull() | record_identity(F.col("url")).eqNullSafe(s["identity"])) & (s["article"].isNull() | article.eqNullSafe(s["article"]))
        & ~(s["alone"] & F.contains("source", F.lit(JOIN_MARK))))


def _filled(pattern: Column) -> Column:
    """A pattern with the source's name and title in their places."""
    for mark, column in (("<name>", "name"), ("<title>", "title")):
        pattern = F.replace(pattern, F.lit(mark), F.concat(F.lit("\\Q"), F.coalesce(F.col(column), F.lit("")), F.lit("\\E")))
    return pattern


def parse_pages(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parser, status, rows, scope) of documents whose parser looks at their text; docs as bound() gives them.

    status: ok; field_validation and conflict where a parser has broken checks as errors. rows is array<ROW>, scope
    the visible text that positions refer to. What fails a guard has no rows. Steps are columns and not filters, as
    filters would be pushed below them and have each step computed again.
    """
    s = F.col("s")
    docs = docs.where(~s["kind"].isin(*OF_POSTS) & _guard(s)).withColumn("source", tx.masked_periods(F.col("source")))
    docs = docs.withColumn("s", s.withField("row", _filled(s["row"])).withField("mark", _filled(s["mark"])))
    docs = docs.withColumn("body", F.when(s["linked"], F.substring_index("source", JOIN_MARK, -1)).otherwise(F.col("source")))
    before = F.substring("source", F.lit(1), F.char_length("source") - F.char_length("body") - len(JOIN_MARK))
    docs = docs.withColumn("anchor", F.when(s["linked"] & F.contains("source", F.lit(JOIN_MARK)), before))
    page = tx.page_text(F.when(s["escaped"], tx.unescaped_script(F.col("body"))).otherwise(F.col("body")))
    docs = docs.select(
        *keys, "parser", "s", F.when(s["inner"].isNull(), 0).otherwise(_found(F.col("body"), s["inner"])["at"]).alias("shift"),
        tx.page_text(F.col("anchor")).alias("anchor"), page.alias("page"),
        F.when(s["inner"].isNotNull(), tx.page_text(_extract(F.col("body"), s["inner"], F.lit(1)))).alias("inner"))
    held = F.when(s["linked"], F.col("anchor")).otherwise(F.col("page"))
    text = F.coalesce("inner", "page")
    docs = docs.select(
        *keys, "parser", "s", "shift", text.alias("text"), F.when(s["start_in_anchor"], F.col("anchor")).otherwise(text).alias("where"),
        ((~s["linked"] | F.col("anchor").isNotNull()) & F.col("shift").isNotNull() & (s["mark"].isNull() | F.rlike(held, s["mark"]))).alias("ok"))
    docs = docs.withColumn("head", _found(F.col("where"), s["start"]))
    once = ~s["unique"] | (F.size(F.split("where", s["start"], -1)) == 2)
    docs = docs.withColumn("ok", F.col("ok") & (s["start"].isNull() | F.col("head.at").isNotNull()) & F.coalesce(once, F.lit(False)))
    period = F.regexp_extract(_extract(F.col("where"), s["start"], F.lit(0)), r"(?U)(?<!\d)(\d{3})\s*期", 1).try_cast("int")
    docs = docs.withColumn("heading", F.when(period.between(1, CYCLE), period))
    begin = F.when(s["start"].isNull() | s["start_in_anchor"], F.lit(0)).when(s["inclusive"], F.col("head.at")).otherwise(F.col("head.end"))
    then = _found(_after(F.col("text"), F.col("head.end")), s["then"])["end"]
    docs = docs.withColumn("begin", F.when(s["then"].isNotNull(), F.col("head.end") + then).otherwise(begin))
    row_end = F.coalesce(_found(_after(F.col("text"), F.col("begin")), s["row"])["end"], F.lit(0))
    docs = docs.withColumn("since", (
        F.when(s["stop_from"] == "start", F.col("head.at")).when(s["stop_from"] == "row", F.col("begin") + row_end)
        .when(s["inclusive"], F.col("head.end")).otherwise(F.col("begin"))))
    docs = docs.withColumn("region", _after(F.col("text"), F.col("since")))
    docs = docs.withColumn("stop", F.col("since") + F.coalesce(_found(F.col("region"), s["stop"])["at"], _found(F.col("region"), s["stop_again"])["at"]))
    other = F.col("head.end") + _found(_after(F.col("text"), F.col("head.end")), s["other"])["at"]
    docs = docs.withColumn("end", F.coalesce(F.least("stop", other), F.col("begin") + s["longest"], F.char_length("text")))
    docs = docs.withColumn("ok", F.col("ok") & F.col("begin").isNotNull() & (~s["stop_needed"] | F.col("stop").isNotNull()))
    base = F.when(s["relative"], F.lit(0)).otherwise(F.col("begin")) + F.col("shift")
    docs = docs.select(*keys, "parser", "s", "heading", "ok", base.alias("base"), F.col("text").alias("scope"),
                       F.substring("text", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("part"))
    rows = F.when(s["kind"] == "chunks", _chunk_rows(F.col("part"), s, F.col("base"))).otherwise(_rows(F.col("part"), s, F.col("base")))
    none = F.array().cast(f"array<{ROW}>")
    docs = docs.select(*keys, "parser", "s", "heading", "ok", "scope", F.when(F.col("ok"), F.coalesce(rows.cast(f"array<{ROW}>"), none)).otherwise(none).alias("found"))
    return judged(docs, keys)


def _repeated(rows: Column) -> Column:
    """The least position of the rows that stand after another of their period; null if there is none. Neighbours of the sorted rows tell."""
    later = lambda o: F.filter(o, lambda x, i: (i > 0) & (F.get(o, i - 1)["period"] == x["period"]) & (F.get(o, i - 1)["position"] < x["position"]))
    ordered = F.array_sort(F.transform(rows, lambda r: F.struct(r["period"].alias("period"), r["position"].alias("position"))))
    return tx.bound(ordered, lambda o: F.array_min(F.transform(later(o), lambda x: x["position"])))


def _first_of_equals(rows: Column) -> Column:
    """The rows without those that have the period, value and position of one before, in their order."""
    key = lambda r: F.struct(r["period"].alias("p"), r["value"].alias("v"), r["position"].alias("o"))
    ordered = F.array_sort(F.transform(rows, lambda r, i: F.struct(key(r).alias("k"), i.alias("i"), r.alias("r"))))
    kept = tx.bound(ordered, lambda o: F.filter(o, lambda x, j: (j == 0) | ~x["k"].eqNullSafe(F.get(o, j - 1)["k"])))
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r")))), lambda x: x["r"])


def judged(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parser, s, heading, ok, scope, found) -> (keys, parser, status, rows, scope): the checks on a document's list of rows."""
    s, rows = F.col("s"), F.col("rows")
    docs = docs.withColumn("bad", F.exists("found", lambda r: ~r["valid"]))
    docs = docs.withColumn("rows", F.when(s["invalid"] == "keep", F.col("found")).when((s["invalid"] == "empty") & F.col("bad"), F.slice("found", 1, 0))
                           .otherwise(F.filter("found", lambda r: r["valid"])))
    docs = docs.withColumn("rows", F.when(s["monotone"], F.slice(first_run(rows), 1, MOST_ROWS)).otherwise(rows))
    docs = docs.withColumn("judged", F.when(s["cycle"] & (F.size("rows") >= CYCLE), F.slice("rows", -CYCLE, CYCLE)).when(s["cycle"], F.slice("rows", 1, 0)).otherwise(rows))
    own, h = F.col("judged"), F.col("heading")
    first, last = F.get(own, F.lit(0))["period"], F.get(own, F.size(own) - 1)["period"]
    edges = (
        F.when(s["edges"] == "last", last == h).when(s["edges"] == "ends", (first == h) | (last == h))
        .when(s["edges"] == "any", h.isNull() | F.exists(rows, lambda r: r["period"] == h)).otherwise(F.lit(True)))
    right = (
        (F.size(own) >= F.when(s["cycle"], F.lit(CYCLE)).otherwise(s["least"])) & (s["steps"].isNull() | _steps_allowed(own, s["steps"]))
        & (~s["cycle"] | F.forall(own, lambda r: r["valid"])) & F.coalesce(edges, F.lit(False))
        & (s["first"].isNull() | F.coalesce(F.array_contains(F.split(s["first"], "\\|"), period_step(h, first).cast("string")), F.lit(False))))
    # of errors the first in the order of the rows counts
    wrong = F.array_min(F.transform(F.filter("found", lambda r: ~r["valid"]), lambda r: r["position"]))
    twice = F.when(s["fails"], _repeated(rows))
    docs = docs.withColumn("right", right).withColumn("wrong", wrong).withColumn("twice", twice)
    errors = s["fails"] & F.col("ok")
    status = (
        F.when(errors & F.col("wrong").isNotNull() & (F.col("twice").isNull() | (F.col("wrong") < F.col("twice"))), "field_validation")
        .when(errors & F.col("twice").isNotNull(), "conflict").when(errors & ~F.col("right"), "field_validation").otherwise("ok"))
    docs = docs.withColumn("status", status)
    return docs.select(*keys, "parser", "status", F.when((F.col("status") == "ok") & F.col("right"), rows).otherwise(F.slice("rows", 1, 0)).alias("rows"), "scope")


def parse_posts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parser, status, rows, path) of documents that are JSON lists of posts; what is no list gives no rows.

    snapshots: the first wanted post with rows counts; one of the same period that gives a shared period another
    value is a conflict. posts: all wanted posts; single: the one wanted post; topics: the posts' own topics.
    """
    s = F.col("s")
    docs = docs.where(s["kind"].isin(*OF_POSTS) & _guard(s)).withColumn("source", tx.masked_periods(F.col("source")))
    # item by item, as what is no object is no post
    docs = docs.withColumn("posts", F.transform(F.coalesce(F.from_json("source", "array<string>"), F.array().cast("array<string>")), lambda x: F.from_json(x, POST)))
    title = F.when(F.coalesce("title", F.lit("")) == "", F.lit("绝杀二肖")).otherwise(F.col("title"))

    def wanted(nick: Column, topic: Column) -> Column:
        return (
            F.when(s["kind"] == "topics", nick == F.col("name")).when(s["kind"] == "single", (nick == F.col("name")) & (F.concat(F.lit("(?U)"), F.trim(topic)) == s["mark"]))
            .when(s["kind"] == "posts", F.contains(nick, F.col("name")) & F.rlike(topic, s["mark"]))
            .when(s["mark"] == "(?U)<title>", F.trim(topic) == title).otherwise(F.rlike(topic, s["mark"])))

    def post(p: Column, i: Column) -> Column:
        nick, topic, content = (F.coalesce(c, F.lit("")) for c in (F.get_json_object(p["user"], "$.nickname"), p["topic"], p["content"]))
        draw = p["draw"].try_cast("int")
        named = F.regexp_extract(topic, r"(?U)(?<!\d)(\d{3})\s*期", 1).try_cast("int")
        of_topic = F.concat(F.lit('"draw": '), draw.cast("string"), F.lit(', "topic": "'), topic, F.lit('"'))
        value = tx.clean_value(_extract(topic, s["row"], s["value_group"]))
        at = F.instr(F.col("source"), of_topic) - 1
        own = F.struct(at.alias("position"), draw.alias("period"), value.alias("value"), F.lit("").alias("open_result"), of_topic.alias("raw"),
                       ((F.char_length(value) == 2) & draw.between(1, CYCLE) & (at >= 0)).alias("valid"))
        rows = F.when(s["kind"] == "topics", F.array(own).cast(f"array<{ROW}>")).otherwise(_rows(tx.page_text(content), s, F.lit(0)).cast(f"array<{ROW}>"))
        rows = F.filter(rows, lambda r: F.coalesce(r["valid"], F.lit(False)))
        return F.struct(i.alias("place"), F.when(draw.between(1, CYCLE), draw).otherwise(named).alias("period"), wanted(nick, topic).alias("wanted"), rows.alias("rows"))

    docs = docs.withColumn("posts", F.transform("posts", post))
    docs = docs.withColumn("posts", F.filter("posts", lambda p: p["wanted"] & ((s["kind"] == "single") | (F.size(p["rows"]) > 0))))
    docs = docs.withColumn("primary", F.get("posts", F.lit(0)))
    mine = F.col("primary.rows")

    def contradicts(p: Column) -> Column:
        keyed = lambda rows: F.transform(rows, lambda r: F.struct(r["period"].alias("period"), r["value"].alias("value")))
        other = F.transform(F.array_except(keyed(p["rows"]), keyed(mine)), lambda k: k["period"])
        return p["period"].eqNullSafe(F.col("primary.period")) & F.coalesce(F.arrays_overlap(other, F.transform(mine, lambda r: r["period"])), F.lit(False))

    every = F.flatten(F.transform("posts", lambda p: p["rows"]))
    docs = docs.withColumn("every", F.transform(every, lambda r: r.withField("open_result", r["open_result"])))
    first = _first_of_equals(F.col("every"))
    rows = (
        F.when(s["kind"].isin("posts", "topics"), first).when(s["kind"] == "single", F.when(F.size("posts") == 1, mine)).otherwise(mine))
    conflict = (s["kind"] == "snapshots") & F.exists("posts", contradicts)
    path = F.when(s["kind"] == "snapshots", F.concat(F.lit("root["), F.col("primary.place").cast("string"), F.lit("].content")))
    none = F.array().cast(f"array<{ROW}>")
    status = F.when(F.coalesce(conflict, F.lit(False)), "conflict").otherwise("ok")
    return docs.select(*keys, "parser", status.alias("status"), F.when(status == "ok", F.coalesce(rows, none)).otherwise(none).alias("rows"), path.alias("path"))


def candidates_of(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parser, period, value, open_result, raw, position) of parsed documents, one row per row found."""
    return parsed.select(*keys, "parser", F.explode_outer("rows").alias("r")).where("r is not null").select(
        *keys, "parser", "r.period", "r.value", "r.open_result", "r.raw", "r.position")


def placed(parsed: DataFrame) -> DataFrame:
    """Parsed documents with the places of their rows in scope proved: every row's text stands at its own place, or else at one free place.

    status becomes field_validation, and the rows are dropped, where a row's text is nowhere or at several free places.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{ROW}>").alias("rows"), F.lit(True).alias("good"))

    def places(raw: Column) -> Column:
        tokens = F.filter(F.split(F.trim(raw), r"(?U)\s+"), lambda t: t != "")
        pattern = F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E"))), r"(?U:\s+)")
        return F.transform(tx.matches(F.col("scope"), pattern), lambda m: m["offset"])

    def stands(r: Column) -> Column:
        """Whether a search for the row's text is sure to find its own place, as no text equal to it begins within its length before."""
        size = F.char_length(r["raw"])
        low = F.greatest(r["position"] - size + 1, F.lit(0))
        near = F.substring(F.col("scope"), low + 1, r["position"] - low + size)
        return F.col("plain") & (r["raw"] == F.trim(r["raw"])) & (size > 0) & (r["position"] >= 0) & (F.instr(near, r["raw"]) == r["position"] - low + 1)

    def searched(acc: Column, r: Column) -> Column:
        return tx.bound(F.array_except(places(r["raw"]), acc["used"]), lambda free: F.when(F.array_contains(free, r["position"]), r["position"]).when(F.size(free) == 1, F.get(free, F.lit(0))))

    def place(acc: Column, r: Column) -> Column:
        at = F.when(F.coalesce(stands(r), F.lit(False)) & ~F.array_contains(acc["used"], r["position"]), r["position"]).otherwise(searched(acc, r))
        lost = F.struct(acc["used"].alias("used"), acc["rows"].alias("rows"), F.lit(False).alias("good"))
        found = lambda o: F.struct(F.array_append(acc["used"], o).alias("used"), F.array_append(acc["rows"], r.withField("position", o)).alias("rows"), F.lit(True).alias("good"))
        return F.when(~acc["good"], acc).otherwise(tx.bound(at, lambda o: F.when(o.isNotNull(), found(o)).otherwise(lost)))

    # where single spaces are all the white space, a row's text matches nothing but itself
    parsed = parsed.withColumn("plain", ~F.rlike("scope", F.lit(r"(?U)\s\s|[^\S ]")))
    # where all rows stand at places of their own there is nothing to walk through, as a fold copies what it has so far with each row
    own = lambda p: F.size(F.array_distinct(p)) == F.size(p)
    clear = tx.bound(F.transform("rows", lambda r: r["position"]), own) & F.forall("rows", lambda r: F.coalesce(stands(r), F.lit(False)))
    kept = F.struct(F.array().cast("array<int>").alias("used"), F.col("rows"), F.lit(True).alias("good"))
    out = parsed.withColumn("proof", F.when(clear, kept).otherwise(F.aggregate("rows", start, place)))
    bad = (F.col("status") == "ok") & ~F.col("proof.good")
    rows = F.array_sort(F.col("proof.rows"))  # position is the first field
    return out.withColumn("rows", F.when(bad, F.slice("rows", 1, 0)).otherwise(rows)).withColumn("status", F.when(bad, "field_validation").otherwise(F.col("status"))).drop("proof", "plain")
