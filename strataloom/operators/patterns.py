"""Rows of two-symbol values as a grammar: what a row is made of, and which words may stand between its parts.

A row has a period, a lead of words, a value between marks, a tail and a result; in another order the result stands
before the value. One recogniser for each order finds the parts of a page's rows, taking the first value that the
shape allows. Whether lead and tail are those of a row is a question about these two short texts, answered by RULES.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.schema import SYMBOLS

# The words and marks of rows, as they stand on the pages.
VERBS = "绝杀 必杀 禁杀 死杀 稳杀 温杀 砍杀 杀".split()
COUNTS = "二②两2２"
SPECIAL_WORDS = "将杀两肖 死杀二肖 瞬杀二肖".split()
OPENING, CLOSING = r"【〖\[（(《『「", r"】〗\]）)》』」"
WIDE, WIDE_END = r"◢〈☆>→✺★", r"◣〉☆<✺★"
ORNAMENTS = r"➹★☆✺_\-－—|←"
JUDGED = "准中错赢对"


def spaced(words: list[str]) -> str:
    """Any of some words, with white space between its characters as pages have it."""
    return "(?:" + "|".join(r"\s*".join(w) for w in words) + ")"


PERIOD = r"(?P<period>\d{3})\s*期"
VALUE = rf"(?P<zodiac>[{SYMBOLS}]\s*[-－、,，.。· ]?\s*[{SYMBOLS}])"
RESULT = rf"[开開]\s*[:：]?\s*(?P<open>[^\s{JUDGED})）✔]+)"
VALUE_FIRST = (
    rf"{PERIOD}(?P<lead>[^期]{{0,110}}?)[{OPENING}{WIDE}]\s*{VALUE}\s*"
    rf"(?P<tail>[{CLOSING}{WIDE_END}{ORNAMENTS}(\s]*(?:肖[^期开開]{{0,20}})?|[{CLOSING}{WIDE_END}]+[^期开開]{{0,30}}){RESULT}")
RESULT_FIRST = rf"{PERIOD}(?P<lead>[^期]{{0,30}}?{spaced(SPECIAL_WORDS)})(?P<tail>[^期]{{0,20}}?){RESULT}\s*[{JUDGED}]?\s*[{OPENING}]\s*{VALUE}\s*[{CLOSING}]"
BANK = (VALUE_FIRST, RESULT_FIRST)

_MARKS = rf"[{ORNAMENTS}{OPENING}{CLOSING}{WIDE}]*"
_VERB, _NUMBER = f"(?:{'|'.join(VERBS)})", rf"[(]?[{COUNTS}][)]?"
#: (lead, tail): whole patterns of the lead without white space and colons, and of the tail without white space.
RULES = (
    (rf"{_MARKS}{_VERB}{_NUMBER}肖准?{_MARKS}", "[^肖]*"),  # marks, the words of the heading, marks
    (rf".{{0,80}}?{_VERB}.{{0,20}}?[{COUNTS}]肖[^{OPENING}]{{0,20}}", rf"[{CLOSING}]"),  # the words anywhere before a bracket that the result follows
    (rf".{{0,80}}?{_VERB}[{OPENING}]*", rf"[{CLOSING}](?:肖.*)?"),  # a verb, and the noun behind the value if at all
    ("★绝杀★[^牛]{0,3}", ".*"),
    (rf"【?(?:杀|禁杀|绝杀|不要)[{COUNTS}]肖码?】?[{OPENING}{WIDE}]*", ".*"),  # short words, and remarks before the result
    ("", rf"[{CLOSING}]←?"),  # nothing but the value
    (rf".*(?:{'|'.join(SPECIAL_WORDS)})", ".*"))  # the words of the other order


def accepted(lead: Column, tail: Column) -> Column:
    """Whether lead and tail are those of a row."""
    bare, end = F.regexp_replace(lead, "(?U)[\\s：:]+", ""), F.regexp_replace(tail, "(?U)\\s+", "")
    return reduce(lambda x, y: x | y, [bare.rlike(f"^(?:{a})$") & end.rlike(f"^(?:{b})$") for a, b in RULES])


#: A row counts only if its text holds one of these, and not the author's mark.
SEMANTIC = r"绝\s*杀|必\s*杀|禁\s*杀|死\s*杀|稳\s*杀|温\s*杀|砍\s*杀|杀|禁|不要"
AUTHOR = "作者"
#: The heading that a section of such rows has.
HEADING = rf"{spaced(VERBS)}\s*[{COUNTS}]\s*肖"
#: Lines that end a section, that say that nothing is published, and that sign a post.
BOUNDARY = r"(?:上一篇|下一篇)\s*[：:]|Copyright|免责声明|返回首页|点击投注|六合优秀站点收录"
UNPUBLISHED = r"尚未发布|暂无(?:资料|数据|内容)?|没有(?:资料|数据|内容)|无(?:资料|数据|内容)"
SIGNATURE = r"作者\s*[：:]|发\s*表\s*于|楼主|只看该作者"
