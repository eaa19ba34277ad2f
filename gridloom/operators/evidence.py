"""What a drawing's candidate texts are evidence of: noise cascades, doors and stairs, short words, closed-set decisions.

Every rule is a column expression. Cascades name the first rule that holds, null where none does. Callers evaluate them on the
distinct combinations of their inputs (see by_distinct) and join the answers back.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Texts that mention objects without being one.
EXPLANATORY = ("详图", "详建施", "做法", "说明", "图例", "专项设计", "参照", "要求设置", "计算", "标注", "宽度", "疏散宽度", "尺寸", "编号", "标高", "轴号")
#: Names too general to be an object, and texts that say nothing.
GENERIC_OBJECTS = ("机房", "房间", "房", "室", "间", "厅")
GENERIC = ("", "0", "DEFPOINTS", "TEXT", "PUB_TEXT", "PUB_DIM", "DIM", "AXIS", "NOTE", "ANNO", "HATCH", "SOLID", "LINE", "LWPOLYLINE", "POLYLINE", "CONTINUOUS", "BYLAYER", "MODEL", "图框", "标题栏", "图签", "说明", "标注", "轴线", "填充", "文字")
#: Marks of exits and fire doors.
EXITS = ("安全出口", "疏散出口", "应急出口", "SAFETYEXIT", "EMERGENCYEXIT", "EVACUATIONEXIT", "AQCK", "SSCK")
FIRE_DOORS = ("防火门", "DOOR_FIRE", "FIRE_DOOR")
FIRE_DOOR_CODE = r"^(?:FM|FGM|FJM)(?:[甲乙丙丁]?[0-9]{0,8}(?:[-_][0-9]+)?)?$"
DOOR_CODE = r"^[A-Z]{1,8}[甲乙丙丁]?[0-9]{1,8}(?:[-_][0-9]+)?$"
STAIRS = ("楼梯", "STAIR", "STRS")
#: Noise by form.
NUMBER = r"(?i)^(?:[-+]?[0-9]+(?:\.[0-9]+)?|[0-9]+[xX×][0-9]+)$"
MEASURE = r"(?i)(?:[0-9]+(?:\.[0-9]+)?\s*(?:m|mm|cm|kg|kw|kva|%|㎡|m2|m3)(?![\p{L}\p{N}_])|[-+]?[0-9]+\s*[fF]\s*(?:至|~|-|到)\s*[-+]?[0-9]+\s*[fF])"
FLOOR_CODE = r"(?i)^(?:[bB][0-9]+(?:[-_~至到][bB]?[0-9]+)?|[0-9]+[fF]|[-+]?[0-9]+(?:[-_~至到][0-9]+)?[fF]|[-+]?[0-9]+[-_~至到][0-9]+[fF]?)$"
#: Title blocks, drawing notes, disciplines, and hints at objects worth an inspection.
TITLE_BLOCKS = ("PMSHEET", "TITLE", "TK_LABEL", "TK-LABEL", "图框", "图签", "标题栏", "会签", "DRAWINGTITLE", "SHEET", "BORDER")
DRAWING_NOISE = (
    "轴网", "轴线", "标注", "尺寸", "图框", "图例", "剖面", "剖面图", "剖面符号", "断面", "立面", "详图", "大样", "大样图", "设计说明", "施工说明", "说明", "索引", "图号", "比例", "标高", "材料表", "设备表", "目录",
    "会签", "地下车库", "平面图", "系统图", "原理图", "示意图", "节点", "节点图", "轴", "轴号", "轴圈", "定位轴", "深度", "宽度", "高度", "长度", "半径", "直径", "坡度", "面积", "容积", "基坑", "AXIS", "DIM", "DIMENSION",
    "NOTE", "ANNO", "ANNOTATION", "LEGEND", "SECTION", "ELEVATION", "DETAIL", "SCHEDULE", "DRAWING", "TITLE", "BORDER",
)
DISCIPLINES = (
    "WATER SUPPLY", "WATERSUPPLY", "DRAIN", "DRAINAGE", "ELECTRICAL", "HVAC", "FIRE PROTECTION", "FIREPROTECTION", "ARCHITECTURE", "STRUCTURE", "PLUMBING", "MECHANICAL", "给排水", "暖通", "电气", "建筑", "结构",
    "消防设计", "消防平面", "防火分区",
)
HARD_EXCLUDED = ("图框", "图签", "标题栏", "设计说明", "施工说明", "材料表", "设备表", "详图", "大样图", "剖面图", "立面图", "系统图", "索引图", "平面图", "轴线", "尺寸", "标高", "比例", "做法", "图号", "编号", "日期")
HINTS = (
    "消防", "消火", "灭火", "报警", "应急", "疏散", "安全出口", "避难", "排烟", "补风", "进风", "排风", "风机", "水泵", "喷头", "水箱", "水池", "卷帘", "配电", "变配电", "强电", "弱电", "电井", "控制室", "发电机",
    "柴油发电机", "火灾", "探测器", "广播", "联动", "电气", "取水", "给水", "排水", "雨水", "清水", "水井", "回收池", "集气", "燃气", "暖通", "通风", "风井", "空调", "管道", "设备", "设备间",
)
SYSTEMS = (
    "消防", "消火", "取水", "给水", "排水", "雨水", "清水", "回收池", "水池", "水箱", "水泵", "水", "电气", "配电", "强电", "弱电", "电", "集气", "燃气", "气", "暖通", "通风", "空调", "排烟", "补风", "排风", "送风", "风",
    "管道", "设备",
)
NOUNS = ("间", "房", "室", "厅", "井", "口", "池", "泵", "阀", "机", "箱", "柜", "装置", "设备")
CLASSIFIER_NOISE = ("图框", "图签", "标题栏", "轴网", "轴线", "尺寸", "标高", "比例", "材料表", "设备表", "说明", "设计说明", "图例", "目录", "剖面", "剖面图", "详图", "大样", "节点", "系统图", "原理图", "示意图")
#: Classes that only a text can prove; other classes take a text or a block.
TEXT_ONLY = (
    "避难间", "消防水泵房/消防泵房", "开闭所", "用户变", "配电房", "消防控制室/消控室", "风机房", "进风机房", "补风机房", "强电间", "弱电间", "强弱电间", "电井", "储存装置间/灭火剂储存装置/驱动装置", "供水水源/消防水池", "消防水泵",
    "备用发电机/柴油发电机房", "变配电房",
)
#: What a layer says about obstacles.
STRUCTURAL = ("墙", "WALL", "SHEARWALL", "柱", "COLUMN", "COLU", "PILLAR", "窗", "WINDOW", "WIN", "结构", "建筑")
STRUCTURAL_TYPES = ("LINE", "LWPOLYLINE", "POLYLINE", "HATCH", "CIRCLE", "ARC", "ELLIPSE")
OPENINGS = ("DOOR", "OPENING", "留洞", "门窗洞", "洞口")
WALLS = ("WALL", "CURTAIN", "GLZ", "GLZE", "GLAZ", "墙", "幕墙")
DASHED = ("DASH", "HIDDEN", "PHANTOM", "CENTER", "DOT", "虚线")


def key(c: Column) -> Column:
    """Text for comparison: without white space, upper case, half-width parentheses; null is empty."""
    return S.library_key(F.coalesce(c.cast("string"), F.lit("")))


def bare(marks: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys("".join(m.split()).upper() for m in marks))


def has_any(c: Column, marks: tuple[str, ...]) -> Column:
    """Whether the key of a text holds one of the marks."""
    return key(c).rlike(one_of(bare(marks)))


def one_of(marks: list[str]) -> str:
    """A pattern for any of the marks as they are."""
    return "|".join(map(re.escape, marks))


def first_of(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules])


def by_distinct(df: DataFrame, inputs: list[str], outputs: dict[str, Column]) -> DataFrame:
    """df with columns that depend on `inputs` alone, computed once for each combination and joined back (nulls meet nulls)."""
    table = df.select(*[F.col(c).alias(f"_in_{c}") for c in inputs], *inputs).distinct()
    found = table.select(*[f"_in_{c}" for c in inputs], *[c.alias(n) for n, c in outputs.items()])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in inputs])
    return df.join(found, on, "left").drop(*[f"_in_{c}" for c in inputs])


def meaningful(c: Column) -> Column:
    """The trimmed text, empty if it is one of those that say nothing."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(key(text).isin(*bare(GENERIC)), "").otherwise(text)


def candidate_term(entity_type: Column, norm_text: Column, block: Column) -> Column:
    """struct(term, source_type): a text's words, an insert's block, else nothing."""
    text, name, kind = meaningful(norm_text), meaningful(block), F.upper(entity_type)
    pair = lambda t, s: F.struct(t.alias("term"), F.lit(s).alias("source_type"))
    return F.when((text != "") & kind.isin("TEXT", "MTEXT", "ATTRIB"), pair(text, "text")).when((name != "") & (kind == "INSERT"), pair(name, "block")).otherwise(pair(F.lit(""), "none"))


def explanatory(c: Column) -> Column:
    return has_any(c, EXPLANATORY)


def generic_object(c: Column) -> Column:
    return key(c).isin(*GENERIC_OBJECTS)


def candidate_noise(term: Column, source_type: Column, entity_type: Column, block: Column, protected: Column) -> Column:
    """Why a candidate can't name an object, or null; protected: whether a library of objects knows the term."""
    k, text, kept = key(term), source_type == "text", ~protected
    evidence = F.concat_ws(" ", F.coalesce(term, F.lit("")), F.coalesce(block, F.lit("")))
    hinted = has_any(evidence, HINTS)
    building = has_any(evidence, SYSTEMS) & has_any(term, NOUNS)
    clean = F.trim(F.coalesce(term, F.lit("")))
    ascii_code = F.regexp_extract(k, r"^([A-Z]{1,8})[-_]?[0-9]{1,6}(?:\([^)]*\))?$", 1)
    coded = text & (ascii_code != "") & ~ascii_code.isin("FJ", "XF", "SB") & kept
    rules = [
        ("empty_term", k == ""),
        ("generic_standalone_object_term", generic_object(term)),
        ("explanatory_text", explanatory(term)),
        ("single_character", (F.length(k) == 1) & ~k.rlike("[井泵阀梯]")),
        ("layer_code_only", (source_type == "layer") & clean.rlike(NUMBER)),
        ("dimension_or_number", text & clean.rlike(NUMBER) & kept),
        ("measurement_or_floor_range", text & F.coalesce(term, F.lit("")).rlike(MEASURE) & kept),
        ("floor_code_only", source_type.isin("text", "block") & clean.rlike(FLOOR_CODE) & kept),
        ("title_block_text", text & has_any(block, TITLE_BLOCKS)),
        ("drawing_block_noise", text & has_any(block, DRAWING_NOISE) & ~hinted & ~building),
        ("discipline_title_text", text & has_any(term, DISCIPLINES) & kept & ~building),
        ("drawing_note_or_title", text & ~hinted & (has_any(term, DRAWING_NOISE) | has_any(term, HARD_EXCLUDED))),
        ("long_explanatory_text", text & ~hinted & (F.length(k) > 48)),
        ("kept", coded),  # a code of one's own ends the cascade
        ("title_block_insert", (source_type == "block") & has_any(evidence, TITLE_BLOCKS)),
        ("drawing_symbol_block", (source_type == "block") & has_any(evidence, DRAWING_NOISE) & kept),
        ("annotation_entity", F.upper(entity_type).isin("DIMENSION", "LEADER", "MLEADER")),
    ]
    return F.nullif(first_of(rules), F.lit("kept"))


def classifier_noise(term: Column, source_type: Column, entity_type: Column, geometry_kind: Column, protected: Column) -> Column:
    """The second cascade, before a classifier: alphanumeric codes stay for it."""
    clean, source = F.trim(F.coalesce(term, F.lit(""))), F.lower(F.coalesce(source_type, F.lit("")))
    code = clean.rlike(r"^[A-Za-z0-9][A-Za-z0-9_\-]{1,24}$") & clean.rlike("[A-Za-z]") & clean.rlike("[0-9]")
    plain = clean.rlike(r"^[0-9]+(?:[.\-_:xX×][0-9]+)*$") | clean.rlike("^[A-Za-z]$")
    rules = [
        ("not_text_or_block_semantics", ~source.contains("text") & ~source.contains("block")),
        ("empty_term", clean == ""),
        ("generic_standalone_object_term", generic_object(term)),
        ("kept", code),
        ("plain_number_or_code", plain & ~protected),
        ("noise_term", has_any(term, CLASSIFIER_NOISE)),
        ("dimension_entity", F.upper(entity_type).isin("DIMENSION", "LEADER", "MLEADER")),
        ("noise_geometry", F.lower(geometry_kind).isin("dimension", "axis", "title_frame")),
    ]
    return F.nullif(first_of(rules), F.lit("kept"))


def fire_door(term: Column, layer: Column, block: Column) -> Column:
    """Doors that must not count as exits: by name or code, or a door's code on a fire door's layer or block."""
    k, context = key(term), key(F.concat_ws(" ", F.coalesce(layer, F.lit("")), F.coalesce(block, F.lit(""))))
    sure = k.contains("防火门") | k.rlike(FIRE_DOOR_CODE)
    return sure | ~has_any(term, EXITS) & k.rlike(DOOR_CODE) & context.rlike(one_of([*FIRE_DOORS]))


def stair(term: Column, layer: Column, block: Column) -> Column:
    return has_any(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (term, layer, block)]), STAIRS)


def text_evidence(source_type: Column, entity_type: Column) -> Column:
    return (F.lower(source_type) == "text") & F.upper(entity_type).rlike("TEXT|ATTRIB")


def block_evidence(source_type: Column, entity_type: Column) -> Column:
    return (F.lower(source_type) == "block") & F.upper(entity_type).contains("INSERT")


def allows_class(name: Column, source_type: Column, entity_type: Column, upper_stair: Column) -> Column:
    """Whether a candidate of this kind may prove the class: exits also by stairs of upper floors, some classes by texts alone."""
    text, block, k = text_evidence(source_type, entity_type), block_evidence(source_type, entity_type), key(name)
    return F.when((k == "安全出口") & upper_stair, True).when(k.isin(*bare(TEXT_ONLY)), text).otherwise(text | block)


#: Short words by themselves, and by what stands about them; (reason, class, confidence, words in the term, words in the
#: context). The first rule that holds decides; a class of None decides for no object.
EXACT_WORDS = {"强电": "强电间", "弱电": "弱电间", "强弱电": "强弱电间", "电井": "电井", "消防泵": "消防水泵", "水泵": "消防水泵", "消控": "消防控制室/消控室", "消防控制": "消防控制室/消控室"}
SHORT_WORDS: list[tuple[str, str | None, float, tuple[str, ...], tuple[tuple[str, ...], ...]]] = [
    ("stair", None, 0.0, ("楼梯", "扶梯"), ()),
    ("short_lift_fire_context", "消防电梯", 0.82, ("电梯",), (("消防", "FIRE", "ELEV", "LIFT"),)),
    ("short_well_layer_context", "电井", 0.78, ("井",), (("电", "强电", "弱电", "配电", "电缆", "消防"),)),
    ("short_pump_room_context", "消防水泵房/消防泵房", 0.8, ("泵",), (("消防", "消火", "喷淋", "给水", "水泵", "PUMP"), ("房", "室", "间", "泵房"))),
    ("short_pump_fire_context", "消防水泵", 0.78, ("泵",), (("消防", "消火", "喷淋", "给水", "水泵", "PUMP"),)),
    ("short_valve_fire_context", "报警阀组", 0.76, ("阀",), (("消防", "报警", "喷淋", "水", "VALVE"),)),
    ("short_lift_context", "消防电梯", 0.76, ("梯",), (("消防", "电梯", "ELEV", "LIFT"),)),
    ("short_room_pump_context", "消防水泵房/消防泵房", 0.8, ("房", "室", "间", "所"), (("消防水泵", "消防泵", "泵房", "PUMP"),)),
    ("short_room_power_context", "配电房", 0.78, ("房", "室", "间", "所"), (("配电", "强电", "弱电", "变配电", "电气"),)),
    ("short_room_fan_context", "风机房", 0.78, ("房", "室", "间", "所"), (("风机", "送风", "排风", "补风", "FAN"),)),
]
CONTEXT = ("term", "layer", "parent_block_name", "source_type", "entity_type", "geometry_kind")


def short_word(term: Column, context: Column) -> Column:
    """struct(class, reason, confidence) of a short word in its context, or null."""
    said = lambda name, reason, p: F.struct(F.lit(name).alias("class"), F.lit(reason).alias("reason"), F.lit(p).alias("confidence"))
    nothing = F.lit(None).cast("struct<class:string,reason:string,confidence:double>")
    out = F.when(generic_object(term), nothing)
    for word, name in EXACT_WORDS.items():
        out = out.when(key(term) == word, said(name, "short_word_exact_rule", 0.86))
    for reason, name, p, words, contexts in SHORT_WORDS:
        holds = reduce(lambda a, c: a & has_any(context, c), contexts, has_any(term, words))
        out = out.when(holds, said(name, reason, p) if name else nothing)
    return out


def short_room(term: Column, context: Column) -> Column:
    """The room that exactly 强电 or 弱电 means beside signs of a text or a door; null else."""
    hints = ("TEXT", "MTEXT", "ATTRIB", "text", "房间", "房名", "门", "地下一层", "地下二层", "地库")
    rooms = F.when(key(term) == "强电", "强电间").when(key(term) == "弱电", "弱电间")
    return F.when(has_any(context, hints) & ~explanatory(term), rooms)


def settled_decision(role: Column, proposed: Column, confidence: Column, matched: Column, score: Column, is_fire_door: Column, is_stair: Column, upper: Column) -> Column:
    """struct(role, class, confidence, reason) of a model's answer: no object ends at a confidence of 0.5 at most; fire doors
    and stairs below the second floor are no exits; else the matched class, by 0.7 of the confidence and 0.3 of the match."""
    out = lambda r, c, p, why: F.struct(F.lit(r).alias("role"), c.alias("class"), F.round(p, 3).alias("confidence"), F.lit(why).alias("reason"))
    sure, exit_class, none = F.coalesce(confidence, F.lit(0.0)), matched == "安全出口", F.lit("IGNORE")
    return (
        F.when(F.trim(F.coalesce(role, F.lit(""))) != "inspection_object", out("IGNORE", none, F.least(sure, F.lit(0.5)), "no_object"))
        .when(exit_class & is_fire_door, out("IGNORE", none, F.lit(1.0), "fire_door_not_safety_exit"))
        .when(exit_class & is_stair & ~upper, out("IGNORE", none, F.lit(1.0), "stair_below_second_floor_not_safety_exit"))
        .otherwise(out("inspection_object", matched, F.greatest(F.lit(0.6), F.least(F.lit(1.0), 0.7 * sure + 0.3 * score)), "closed_set_classification"))
    )


def structural(entity_type: Column, layer: Column, path: Column) -> Column:
    """Geometry within blocks that is worth keeping: of a structural type, on a layer or in a block of a structural name."""
    return entity_type.isin(*STRUCTURAL_TYPES) & (has_any(layer, STRUCTURAL) | has_any(path, STRUCTURAL))


def expands(entity_type: Column, layer: Column, path: Column, depth: Column) -> Column:
    """Whether an entity is kept by the selective scan: on the drawing itself all are, within blocks texts, inserts and
    structural geometry."""
    return (depth == 0) | entity_type.isin("TEXT", "MTEXT", "ATTRIB", "INSERT") | structural(entity_type, layer, path)


def has_opening(layer: Column) -> Column:
    up = F.upper(F.coalesce(layer, F.lit("")))
    return up.rlike(one_of([*OPENINGS]))


def has_wall(layer: Column, types: Column, reason: Column) -> Column:
    """A layer decision that means walls: by its types, or by words in the layer's name, the reason or the types."""
    said = F.upper(F.concat_ws(" ", F.coalesce(layer, F.lit("")), F.coalesce(reason, F.lit("")), F.array_join(types, " ")))
    return F.array_contains(types, "wall") | said.rlike(one_of([*WALLS]))


def obstacle_type(types: Column, entity_type: Column) -> Column:
    """column for a circle of a column layer, then wall, column, filled_obstacle."""
    has = lambda t: F.array_contains(types, t)
    return F.when(has("column") & (entity_type == "CIRCLE"), "column").when(has("wall"), "wall").when(has("column"), "column").otherwise("filled_obstacle")


def dashed(linetype: Column, geometry_kind: Column) -> Column:
    up = F.upper(F.concat_ws(" ", F.coalesce(linetype, F.lit("")), F.coalesce(geometry_kind, F.lit(""))))
    return up.rlike(one_of([*DASHED]))


def best_upper_alias(items: DataFrame, aliases: DataFrame, item: str, values: list[str], floors: list[str]) -> DataFrame:
    """(item, class, alias) of items on upper floors: the longest alias that one of the values holds, then the longer class, then
    by name. aliases (class, alias): a library of hundreds of rows; its join goes by the planner's size check."""
    upper = items.where(S.is_upper_floor(*map(F.col, floors)))
    keyed = aliases.select("class", "alias", key(F.col("alias")).alias("_alias"))
    holds: Callable[[str], Column] = lambda v: key(F.col(v)).contains(F.col("_alias")) & ~explanatory(F.col(v))
    hits = upper.join(keyed, reduce(lambda a, b: a | b, [holds(v) for v in values]))
    rank = F.struct(-F.length("_alias"), -F.length("class"), F.col("class"), F.col("alias"))
    return hits.groupBy(item).agg(F.min_by(F.struct("class", "alias"), rank).alias("m")).select(item, "m.class", "m.alias")
