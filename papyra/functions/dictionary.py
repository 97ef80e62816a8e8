"""Rules for data dictionaries: header rows, enumerations, aliases, concepts, key hints, representations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.language import identifier, one_space

#: What a header cell says when it names each column, and how much that counts.
HEADERS = {
    "field": (("字段名称", "字段名", "字段", "field name", "field", "column name"), 0.38),
    "type": (("数据类型", "类型", "data type", "type"), 0.22),
    "meaning": (("字段含义", "含义", "描述", "说明", "备注", "meaning", "description", "notes", "comment"), 0.18),
    "enum": (("枚举值", "枚举", "取值", "enum", "allowed values"), 0.10),
    "length": (("长度", "最大长度", "length"), 0.05),
    "primary": (("主键", "primary key", "key"), 0.07),
}
HEADER_FROM = 0.55

#: Business concepts and the words that stand for them.
CONCEPTS = {
    "User Identifier": "user subscriber imsi msisdn 用户 订户".split(),
    "Site": "site station cell 站点 小区 基站".split(),
    "Traffic": "traffic volume 流量 话务".split(),
    "Revenue": "revenue fee charge 收入 费用 计费".split(),
    "Status": "status state 状态".split(),
    "Time": "time date 时间 日期".split(),
    "Terminal": "terminal device 终端 设备".split(),
    "Network Generation": "5g 4g lte nr 网络制式 网络".split(),
    "Order": "order 订单".split(),
    "Fault": "fault error 故障 错误".split(),
    "Product": "product offer 产品".split(),
    "Plan": "plan package 套餐".split(),
    "Roaming": "roaming 漫游".split(),
    "Session": "session 会话".split(),
    "Quality": "quality kpi 质量".split(),
    "Region": "region province city 区域 省 城市".split(),
}

#: Words for a point in time in a field's name.
TIME_WORDS = "time date created updated 时间 日期".split()


def header_column(cells: Column, key: str) -> Column:
    """The place from 0 of the first cell that names a column of a dictionary; -1 if none does."""
    named = F.transform(cells, lambda c: F.lower(one_space(F.coalesce(c, F.lit("")))).rlike("|".join(HEADERS[key][0])))
    return F.array_position(named, True) - 1


def header_score(cells: Column) -> Column:
    """How surely a row of cells is the header of a dictionary; 0 without a field and one of type, meaning or enumeration."""
    has = {k: header_column(cells, k) >= 0 for k in HEADERS}
    score = reduce(lambda s, k: s + F.when(has[k], HEADERS[k][1]).otherwise(0.0), HEADERS, F.lit(0.10))
    return F.when(has["field"] & (has["type"] | has["meaning"] | has["enum"]), F.least(score, F.lit(1.0))).otherwise(0.0)


def is_header(cells: Column) -> Column:
    return header_score(cells) >= HEADER_FROM


def is_title(cells: Column) -> Column:
    """A row with a single cell of two bytes or more that is no header."""
    full = F.filter(F.transform(cells, lambda c: one_space(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return (F.size(full) == 1) & (F.octet_length(F.get(full, F.lit(0))) >= 2) & ~is_header(cells)


def aliases(*names: Column) -> Column:
    """Sorted distinct ways to write names: as they are, in small letters, with _ or - as a space."""
    every = []
    for n in names:
        v = one_space(F.coalesce(n, F.lit("")))
        low = F.lower(v)
        every += [v, low, F.replace(low, F.lit("_"), F.lit(" ")), F.replace(low, F.lit("-"), F.lit(" "))]
    return F.array_sort(F.array_distinct(F.filter(F.array(*every), lambda a: F.trim(a) != "")))


def enum_values(mapping: Column) -> Column:
    """(value, label) of "1:on;0=off|2" and the like; a part without a sign is a value without a label, and so is a label without a value."""
    parts = F.filter(F.transform(F.split(mapping, "[;；\n|]"), one_space), lambda p: p != "")

    def pair(p):
        at = F.regexp_instr(p, F.lit("[:：=]"))
        value = F.when(at > 0, F.trim(F.substr(p, F.lit(1), at - 1))).otherwise(p)
        label = F.when(at > 0, F.trim(F.substr(p, at + 1))).otherwise("")
        return F.struct(F.when(value == "", label).otherwise(value).alias("value"), F.when(value == "", "").otherwise(label).alias("label"))

    return F.filter(F.transform(parts, pair), lambda e: e["value"] != "")


def concepts(text: Column) -> Column:
    """Names of the concepts that a text has a word for."""
    low = identifier(text)
    return F.array_compact(F.array(*(F.when(low.rlike("|".join(words)), name) for name, words in CONCEPTS.items())))


def join_hint(name: Column) -> Column:
    """How likely a field's name alone makes it a key to join by; null if not at all."""
    return F.when(identifier(name).rlike("(id|key|no|number)$"), 0.60)


def time_hint(name: Column) -> Column:
    return F.when(identifier(name).rlike("|".join(TIME_WORDS)), 0.50)


def table_text(name: Column, scope: Column, description: Column, purpose: Column, inferred: Column, fields: Column) -> Column:
    """What stands for a table in search; parts that are null or empty are left out."""
    full = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    said = F.concat(purpose, F.when(inferred, " (inferred)").otherwise(""))
    return F.concat_ws("; ", F.concat(F.lit("Table: "), name), F.concat(F.lit("Scope: "), scope), full("Description: ", description), full("Purpose: ", said), F.when(fields > 0, F.concat(F.lit("Field count: "), fields.cast("string"))))


def field_text(name: Column, table: Column, scope: Column, kind: Column, meaning: Column, enum: Column, concept: Column) -> Column:
    """What stands for a field in search; ``enum`` is an array of (value, label), ``concept`` one of names."""
    full = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    values = F.array_join(F.transform(enum, lambda e: F.when(e["label"] == "", e["value"]).otherwise(F.concat_ws("=", e["value"], e["label"]))), ",")
    return F.concat_ws("; ", F.concat(F.lit("Field: "), name), F.concat(F.lit("Table: "), table), F.concat(F.lit("Scope: "), scope), full("Type: ", kind), full("Meaning: ", meaning), full("Enum: ", values), full("Concepts: ", F.array_join(concept, ",")))


def column_number(ref: Column) -> Column:
    """The column of a spreadsheet reference like AB12, from 1."""
    letters = F.split(F.upper(F.regexp_extract(ref, "^[$]?([A-Za-z]+)", 1)), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda s, c: s * 26 + F.ascii(c) - 64)


def row_number(ref: Column) -> Column:
    """The row of a spreadsheet reference, null if it has none."""
    found = F.regexp_extract(ref, "([0-9]+)", 1)
    return F.when(found != "", found.cast("long"))


def column_name(number: Column, most: int = 4) -> Column:
    """The letters of a column, A for 1; null beyond ``most`` letters."""
    out, n = F.lit(""), number
    for _ in range(most):
        out = F.when(n > 0, F.concat(F.chr(65 + (n - 1) % 26), out)).otherwise(out)
        n = F.when(n > 0, F.floor((n - 1) / 26)).otherwise(0).cast("long")
    return F.when(n == 0, out)
