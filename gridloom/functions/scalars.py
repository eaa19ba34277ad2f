"""Casts, normalisers and parsers as column expressions; everything stays in generated code or built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space to remove; Java's \s alone leaves the ideographic and no-break spaces.
SPACE = r"[\s\x{00A0}\x{3000}]+"
#: The same characters, to translate away in one pass.
SPACES = " \t\n\x0b\f\r\u00a0\u3000"
#: What separates parts of a layer name.
LAYER_MARKS = r"[\s\x{00A0}\x{3000}_\-()\[\]/\\\x{3010}\x{3011}\x{FF08}\x{FF09}]+"
#: Entity types by coarse kind; types that aren't named are "other".
KINDS = {
    "text": ("TEXT", "MTEXT", "ATTRIB"),
    "block_insert": ("INSERT",),
    "line": ("LINE", "XLINE", "RAY"),
    "curve": ("ARC", "CIRCLE", "ELLIPSE"),
    "spline_curve": ("SPLINE",),
    "hatch_area": ("HATCH",),
    "area_entity": ("SOLID", "REGION", "WIPEOUT"),
    "annotation_dimension": ("DIMENSION", "LEADER", "MLEADER"),
    "point": ("POINT",),
}
CLOSED_TYPES = ("HATCH", "CIRCLE", "ELLIPSE", "REGION")


def safe_double(c: Column, default: float = 0.0) -> Column:
    """A finite number, or the default for what doesn't parse, NaN and infinities."""
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(default))


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def first_positive(*columns: Column) -> Column:
    """The first of several whole numbers that is positive, else 0."""
    return F.coalesce(*[F.when(c.try_cast("int") > 0, c.try_cast("int")) for c in columns], F.lit(0))


def first_filled(*columns: Column) -> Column:
    """The first field that holds something."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns])


def drawing_text(c: Column) -> Column:
    r"""Text of a drawing without paragraph marks (\P), formatting codes (\A1;), braces and white space."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\\[Pp]", ""), r"\\[A-Za-z][^;\\]{0,16};", "")
    return F.translate(plain, "{}" + SPACES, "")


def library_key(c: Column) -> Column:
    """Key of a library entry: full-width parentheses become ASCII, white space goes, letters are upper case."""
    return F.upper(F.translate(c, "（）" + SPACES, "()"))


def ascii_compact(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def token_set(c: Column) -> Column:
    """Distinct runs of A-Z and 0-9, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit("[A-Z0-9]+"), F.lit(0))))


def layer_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, LAYER_MARKS, ""))


def identifier(c: Column, fallback: str = "item") -> Column:
    """Runs of other than letters, digits and _ become one _, none at the ends; empty becomes the fallback."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(fallback))


def geometry_kind(kind: Column, closed: Column) -> Column:
    """The coarse kind of an entity type; polylines by whether they are closed."""
    out = F.when(kind.isin("LWPOLYLINE", "POLYLINE"), F.when(closed, "polyline_closed").otherwise("polyline_open"))
    return reduce(lambda c, x: c.when(kind.isin(*x[1]), x[0]), KINDS.items(), out).otherwise("other")


def is_closed(kind: Column, closed: Column) -> Column:
    return (kind.isin("LWPOLYLINE", "POLYLINE") & closed | kind.isin(*CLOSED_TYPES)).cast("int")


def numeral(c: Column) -> Column:
    """A number written in ASCII digits, as one Chinese digit, or with 十 for tens (a part that is no digit counts as 1 ten or 0
    ones); null otherwise."""
    digit = lambda x: F.when(F.length(x) == 1, F.translate(x, "一二两三四五六七八九〇零", "122345678900").try_cast("int"))
    chinese = c.rlike("^[一二两三四五六七八九〇零]$")
    left, right = F.substring_index(c, "十", 1), F.substr(c, F.length(F.substring_index(c, "十", 1)) + 2)
    part = lambda x, other: F.when(x.rlike("^[一二两三四五六七八九〇零]$"), digit(x)).otherwise(other)
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).when(chinese, digit(c)).when(c.contains("十"), part(left, 1) * 10 + part(right, 0))


#: A word character of any script before or after, which a floor code may not touch.
NOT_AFTER, NOT_BEFORE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Words that name a floor without a number, in the order in which they are listed.
FLOOR_WORDS = [("EQUIPMENT", "设备层"), ("REFUGE", "避难层"), ("MEZZANINE", "夹层"), ("ROOF", "屋顶|屋面|顶层"), ("STANDARD", "标准层"), ("F1", "首层")]
NUMERALS = "一二两三四五六七八九十0-9"


def floor_mentions(c: Column) -> Column:
    """Ids of the floors that a text names, each once: floors by name, basements by 地下 or 负, then by B, floors by 层, then by
    F. A number before 层 that also stands behind 地下 or 负 is no upper floor. Basements are B1 to B8, floors F1 to F80."""
    text = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, ""), "０１２３４５６７８９", "0123456789")
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    numbered = lambda kind, raw: F.transform(F.filter(F.transform(raw, numeral), lambda n: n > 0), lambda n: F.concat(F.lit(kind), n.cast("string")))
    named = [F.when(text.rlike(p), F.array(F.lit(n))).otherwise(F.array().cast("array<string>")) for n, p in FLOOR_WORDS]
    below = F.concat(found(f"地下([{NUMERALS}]+)层"), found(f"负([{NUMERALS}]+)层"))
    above = F.filter(found(f"第?([{NUMERALS}]+)层"), lambda raw: ~F.array_contains(below, raw))
    ids = F.concat(*named, numbered("B", below), numbered("B", found(f"(?i){NOT_AFTER}B([0-9]+)[F层]?{NOT_BEFORE}")), numbered("F", above), numbered("F", found(f"(?i){NOT_AFTER}([1-9][0-9]?)F{NOT_BEFORE}")))
    return F.array_distinct(F.filter(ids, lambda i: i.rlike("^([A-Z]{4,}|B[1-8]|F([1-9]|[1-7][0-9]|80))$")))


def floor_name(floor: Column) -> Column:
    """What a floor id is called in titles; other ids stand for themselves."""
    number = F.regexp_extract(floor, "^[BF]([0-9]+)$", 1)
    words = {"ROOF": "屋顶层", "STANDARD": "标准层", "EQUIPMENT": "设备层", "MEZZANINE": "夹层", "REFUGE": "避难层", "F1": "首层"}
    out = F.when(floor.rlike("^B[0-9]+$"), F.concat(F.lit("地下"), number, F.lit("层")))
    out = reduce(lambda o, w: o.when(floor == w[0], w[1]), words.items(), out)
    return out.when(floor.rlike("^F[0-9]+$"), F.concat(number, F.lit("层"))).otherwise(floor)


def is_upper_floor(*values: Column) -> Column:
    """True only where ids, names or titles say the second floor or higher, the roof or an equipment floor; false for basements,
    the first floor and whatever doesn't say. The first value that says anything decides, but for roof and equipment."""
    keys = [library_key(F.coalesce(v, F.lit(""))) for v in values]
    named = reduce(lambda a, b: a | b, [k.rlike("ROOF|屋顶|屋面|EQUIPMENT|设备层") for k in keys])

    def said(key: Column) -> Column:
        number = lambda pattern: F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")).try_cast("int")
        leading = F.coalesce(number("^F([0-9]+)"), number("^([0-9]+)F(?:[^A-Z0-9]|$)"))
        inner = F.coalesce(number("[^A-Z0-9]F([0-9]+)"), number("[^A-Z0-9]([0-9]+)F(?:[^A-Z0-9]|$)"), number("([0-9]+)[层楼]"))
        written = F.regexp_extract(key, "([一二两三四五六七八九十]+)[层楼]", 1)
        spelled = F.when(written.contains("十") | (F.length(written) == 1), numeral(written))
        below = key.rlike("地下|负[0-9]|^B[0-9]+")
        return F.when(leading.isNotNull(), leading >= 2).when(below, False).when(inner.isNotNull(), inner >= 2).when(spelled.isNotNull(), spelled >= 2)

    return named | F.coalesce(*[said(k) for k in keys], F.lit(False))


def floor_order(floor: Column) -> Column:
    """Basements from the deepest, then floors upward, the roof, and others last."""
    below, above = F.regexp_extract(floor, "^B([0-9]+)$", 1).try_cast("int"), F.regexp_extract(floor, "^F([0-9]+)$", 1).try_cast("int")
    return F.when(below.isNotNull(), -below).when(above.isNotNull(), above).when(floor == "ROOF", 1000).otherwise(2000)


def building_labels(c: Column) -> Column:
    """Distinct building numbers before # or 号, in order; lists such as 1、2、3# count in full."""
    lists = F.regexp_extract_all(F.upper(c), F.lit("((?:[A-Z]?[0-9]{1,2}[、,])*[A-Z]?[0-9]{1,2})(?:#|号)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(lists, lambda s: F.split(s, "[、,]"))))


def json_in_text(c: Column) -> Column:
    """The JSON object in a text: code fences go, else from the first { to the last }."""
    bare = F.regexp_replace(F.regexp_replace(c, "(?s)^\\s*```[a-z]*\\s*", ""), "\\s*```\\s*$", "")
    return F.regexp_extract(bare, "(?s)(\\{.*\\})", 1)


def counter_total(c: Column) -> Column:
    """Sum of a JSON cell of counts by name; cells that don't parse are 0."""
    return F.coalesce(F.aggregate(F.map_values(F.from_json(c, "map<string,bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0))


def content_id(*values: Column, digits: int = 3) -> Column:
    """An id that depends on rounded coordinates alone."""
    return F.substr(F.sha2(F.concat_ws(",", *[F.format_string(f"%.{digits}f", F.round(v, digits) + F.lit(0.0)) for v in values]), 256), F.lit(1), F.lit(16))
