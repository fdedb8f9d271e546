"""Text normalisation as column expressions: markup flattening, lines, tokens and match offsets.

Offsets count code points. Python's classes \\s and \\d cover Unicode; Java's need the flag (?U), which the
unicode arguments set.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that end a line of visible text.
BLOCK_TAGS = (
    "address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h[1-6] header hr li main nav ol p pre"
    " section table tbody td tfoot th thead tr ul").split()


def _space(unicode: bool) -> str:
    return "(?U)\\s+" if unicode else "\\s+"


def _literal_map(entries: dict[str, str]) -> Column:
    """A constant map; JSON keeps the plan small, the optimizer folds it."""
    return F.from_json(F.lit(json.dumps(entries)), T.MapType(T.StringType(), T.StringType()))


def code_point(number: Column) -> Column:
    """The character of a code point; outside of Unicode, and for surrogates, the replacement character."""
    good = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decode_entities(text: Column, closed: bool = False) -> Column:
    """Character references decoded as HTML 5 has them: numbers, names, and old names without a semicolon.

    closed: only those that a semicolon ends; a reference that is cut off stays as it is written.

    The names are those of Python's standard table; a number in 0x80-0x9F means its character in Windows-1252.
    """
    named = _literal_map(html5)
    end = ";" if closed else ";?"
    old = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    windows = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {"0": "\ufffd", "13": "\r"}

    def piece(p: Column) -> Column:
        number = F.regexp_extract(p, f"^&#(?:[xX]([0-9a-fA-F]+)|[0-9]+){end}", 1)
        decimal = F.regexp_extract(p, f"^&#([0-9]+){end}", 1)
        whole = F.regexp_extract(p, f"^&#(?:[xX][0-9a-fA-F]+|[0-9]+){end}", 0)
        digits = F.regexp_replace(F.when(decimal != "", decimal).otherwise(F.conv(F.regexp_replace(number, "^0*(?=.)", ""), 16, 10)), "^0+(?=.)", "")
        value = F.when(F.char_length(digits) > 8, F.lit(-1).cast("long")).otherwise(digits.try_cast("long"))
        char = F.coalesce(F.element_at(_literal_map(windows), digits), code_point(value))
        name = F.regexp_extract(p, f"^&([^\\t\\n\\f <&#;]{{1,32}}{end})", 1)
        short = F.lit("") if closed else F.regexp_extract(p, f"^&({'|'.join(old)})", 1)
        exact = F.element_at(named, name)
        return (
            F.when(whole != "", F.concat(char, F.substring(p, F.char_length(whole) + 1, F.char_length(p))))
            .when(exact.isNotNull(), F.concat(exact, F.substring(p, F.char_length(name) + 2, F.char_length(p))))
            .when(short != "", F.concat(F.element_at(named, short), F.substring(p, F.char_length(short) + 2, F.char_length(p))))
            .otherwise(p))

    pieces = F.split(text, "(?=&)", -1)
    decoded = F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("&")), piece(p)).otherwise(p)), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def strip_hidden(html: Column) -> Column:
    """Without scripts and styles."""
    return F.regexp_replace(F.regexp_replace(html, "(?is)<script.*?</script>", " "), "(?is)<style.*?</style>", " ")


def visible_text(html: Column, unicode: bool = True, closed: bool = False) -> Column:
    """All visible text on one line: markup gone, references decoded, white space collapsed, trimmed."""
    text = decode_entities(F.regexp_replace(strip_hidden(html), "<[^>]+>", " "), closed)
    return F.trim(F.regexp_replace(text, _space(unicode), " "))


def visible_lines(html: Column, closed: bool = False) -> Column:
    """The visible lines: block tags end a line, each is collapsed and trimmed, empty ones go."""
    text = F.regexp_replace(strip_hidden(html), f"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\\b[^>]*>", "\n")
    text = decode_entities(F.regexp_replace(text, "<[^>]+>", " "), closed)
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\t\\f\\r\\x0B ]+", " ")))
    return F.filter(lines, lambda x: x != "")


def written_markup(source: Column) -> Column:
    """Literal document.write calls replaced by what they write; writes of encoded payloads go."""
    text = F.regexp_replace(source, "(?s)document\\.writeln?\\(.{0,80}?(?:strdecode|atob)\\(.*?\\)\\s*\\);?", " ")
    text = F.regexp_replace(text, "(?s)document\\.writeln?\\(\\s*([\"'`])(.*?)\\1\\s*\\);?", "$2\n")
    return F.replace(F.replace(text, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"'))


def without_separators(value: Column) -> Column:
    """A value without white space and the separators that may stand between its symbols."""
    return F.regexp_replace(value, "(?U)[\\s\\-－.。·、,，]+", "")


def clean_value(value: Column) -> Column:
    """As without_separators; a doubled symbol is no value."""
    return bound(without_separators(value), lambda v: F.when((F.char_length(v) == 2) & (F.substring(v, 1, 1) == F.substring(v, 2, 1)), "").otherwise(v))


#: Elements of a chunk of running_starts.
CHUNK = 256


def bound(value: Column, use) -> Column:
    """use(value), the value being computed once although use names it often: a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_starts(sizes: Column) -> Column:
    """Of each element of an array of integers the sum of those before it.

    A fold whose result grows copies it at every step; so chunks of a fixed size are folded one by one, and their
    totals once more, which keeps the work in proportion to the array.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))

    def chunks(all_: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(CHUNK))
        return F.transform(first, lambda i: F.aggregate(F.slice(all_, i, CHUNK), start, step))

    def joined(parts: Column) -> Column:
        bases = F.aggregate(F.transform(parts, lambda c: c["at"]), start, step, lambda acc: acc["starts"])
        return F.flatten(F.zip_with(parts, bases, lambda c, base: F.transform(c["starts"], lambda o: o + base)))

    return bound(sizes, lambda all_: bound(chunks(all_), joined))


def matches(text: Column, pattern: str | Column, groups: Sequence[int | Column] = (0,)) -> Column:
    """array<struct<offset, g0, g1, ...>> of all matches, offset in code points.

    The text between the matches and the matches themselves have known lengths; their running sum gives the offsets.
    The pattern must not match the empty string. Pattern and groups may be columns.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    numbers = [F.lit(g) if isinstance(g, int) else g for g in groups]
    parts = [F.regexp_extract_all(text, p, g).alias(f"g{k}") for k, g in enumerate(numbers)]
    found = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.split(text, p, -1).alias("gaps"), *parts)

    def rows(b: Column) -> Column:
        sizes = F.zip_with(F.slice(b["gaps"], 1, F.size(b["whole"])), b["whole"], lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("own")))
        with_starts = lambda z: F.zip_with(running_starts(F.transform(z, lambda x: x["gap"] + x["own"])), z, lambda at, x: at + x["gap"])
        row = lambda o, i: F.struct(o.alias("offset"), *[F.element_at(b[f"g{k}"], i + 1).alias(f"g{k}") for k in range(len(numbers))])
        return F.transform(bound(sizes, with_starts), row)

    return bound(found, rows)


def masked(digits: Column, shown: Column | None = None, low: int = 1, high: int = 365) -> Column:
    """A run of digits (as shown), or spaces of equal length unless it has three digits and lies in the range."""
    valid = (F.char_length(digits) == 3) & digits.try_cast("int").between(low, high)
    return F.when(F.coalesce(valid, F.lit(False)), digits if shown is None else shown).otherwise(F.repeat(F.lit(" "), F.char_length(digits)))


def complement(alphabet: list[str], picks: Column) -> Column:
    """The symbols of the alphabet that are not picked, in its order."""
    return F.array_except(F.array(*[F.lit(x) for x in alphabet]), picks)


def masked_periods(source: Column) -> Column:
    """Every run of three or more digits before a period mark blanked unless it is 001 to 365; lengths stay."""
    token = r"(?U)(?<!\d)\d{3,}(?=\s*[期起])"
    gaps = F.split(source, token, -1)
    found = F.transform(F.regexp_extract_all(source, F.lit(token), F.lit(0)), lambda d: masked(F.translate(d, "０１２３４５６７８９", "0123456789"), d))
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, d: F.concat(g, d)), ""), F.element_at(gaps, -1))


def unescaped_script(source: Column) -> Column:
    """The inside of a script string: escaped slashes, quotes and code units decoded."""
    text = F.replace(F.replace(source, F.lit("\\/"), F.lit("/")), F.lit('\\"'), F.lit('"'))
    pieces = F.split(text, r"(?=\\u[0-9a-fA-F]{4})", -1)
    one = lambda p: F.when(p.rlike(r"^\\u[0-9a-fA-F]{4}"), F.concat(code_point(F.conv(F.substring(p, 3, 4), 16, 10).cast("long")), F.substring(p, F.lit(7), F.char_length(p)))).otherwise(p)
    return F.array_join(F.transform(pieces, one), "")


def page_text(source: Column) -> Column:
    """Visible text of a captured page on one line, what its scripts write included."""
    return visible_text(written_markup(source))
