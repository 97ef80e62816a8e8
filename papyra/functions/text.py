"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blocks of kana, Han and Hangul.
CJK = "぀-ヿ㐀-䶿一-鿿가-힯"

#: Words that mark a sentence as a statement of fact, English ones between spaces.
FACT_MARKERS = [
    "is", "are", "was", "were", "uses", "provides", "requires",
    "contains", "returns", "supports", "enables", "includes", "means",
    "belongs to", "consists of", "must", "should", "defaults to", "can",
    "affects", "causes", "depends on", "submits", "serializes", "owns", "avoids",
]
CHINESE_FACT_MARKERS = "是 使用 提供 必须 应该 包括 包含 返回 支持 表示 属于 默认 需要 会 影响 导致 依赖".split()

#: Headings that say nothing about a document's subject.
BOILERPLATE = (
    "目录 前言 概述 简介 背景 背景信息 前提条件 操作步骤 操作场景 注意事项 相关任务 约束条件 业务影响 参考标准 异常处理 结果验证 界面入口 说明 注意 版权所有 商标声明 "
    "发布日期 华为技术有限公司 操作须知 实施时长 告警属性 功能描述 可能原因 告警解释 告警清除 问题现象 操作影响 限制约束 告警参数 产生背景 背景介绍 概念介绍 命令功能 可获得性 使用示例 "
    "约束限制 适用场景与约束 系统自处理过程 现象描述 后续操作 必备事项 使用场景 对系统的影响 影响说明 应用场景 实现原理"
).split() + ["table of contents", "contents", "preface", "overview", "introduction", "background", "prerequisites", "procedure", "steps", "notes", "precautions", "copyright", "trademarks"]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that it names several times: the value is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_estimate(text: Column) -> Column:
    """One token per 1.5 CJK or 4 other characters, rounded up; 0 for an empty text."""
    n = F.length(text)
    cjk = F.when(F.octet_length(text) == n, 0).otherwise(F.length(F.regexp_replace(text, f"[^{CJK}]+", "")))
    return once(cjk, lambda c: F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(c / 1.5 + (n - c) / 4.0))).cast("long"))


def normalize(text: Column) -> Column:
    """Line ends as \\n, at most one blank line in a row, no white space around."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def terms(text: Column) -> Column:
    """Words of two or more of a-z, 0-9 and _, then CJK bigrams (a single character stays)."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"([{CJK}]+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))))
    return F.concat(F.regexp_extract_all(low, F.lit("([a-z0-9_]{2,})"), 1), pairs)


#: Ends of sentences; a full stop between two digits or two letters ends none.
_ENDS = r"[.!?。！？\n](?!(?<=\p{Nd}[.])\p{Nd}|(?<=\p{L}[.])\p{L})"


def sentences(text: Column) -> Column:
    """Sentences without white space around; a full stop between two digits or two letters ends none."""
    parts = F.transform(F.split(text, _ENDS), lambda s: F.replace(F.trim(s), F.lit("\u0001"), F.lit(".")))
    return F.filter(parts, lambda s: s != "")


def clean_fact(sentence: Column) -> Column:
    """A sentence without the signs and spaces around it."""
    return F.btrim(sentence, F.lit(" \t\n\u000b\f\r;,"))


def is_fact(sentence: Column) -> Column:
    """16 to 500 characters, no address at its beginning, and a marker word or one colon that is not near the start."""
    han = reduce(lambda a, m: a | F.contains(sentence, F.lit(m)), CHINESE_FACT_MARKERS, F.lit(False))
    marked = F.lower(sentence).rlike(" (?:" + "|".join(FACT_MARKERS) + ") ") | ((F.octet_length(sentence) > F.length(sentence)) & han)
    colon = (F.length(sentence) - F.length(F.replace(sentence, F.lit(":"), F.lit(""))) == 1) & (F.instr(sentence, ":") > 3)
    return F.length(sentence).between(16, 500) & ~F.lower(sentence).rlike("^https?://") & (marked | colon)


def statements(text: Column) -> Column:
    """An array of (pos, text): the sentences of a text that state facts, cleaned, each with its place among all sentences. Each sentence is cleaned once."""
    every = F.transform(sentences(text), lambda s, i: F.struct(i.alias("pos"), clean_fact(s).alias("text")))
    return F.filter(every, lambda x: is_fact(x["text"]))


def fact_text(sentence: Column) -> Column:
    """A statement's letters and digits in small, single spaces between words."""
    kept = F.regexp_replace(F.lower(F.regexp_replace(sentence, r"\s+", " ")), r"[^\p{L}\p{Nd} ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def fact_key(sentence: Column, version: Column | None = None) -> Column:
    """32 hex digits of a statement in a version of its source; null is no version."""
    scope = F.lit("") if version is None else F.coalesce(version, F.lit(""))
    return F.left(F.sha2(F.concat(scope, F.lit("\u0000"), fact_text(sentence)), 256), F.lit(32))


def is_concept(key: Column) -> Column:
    """2 to 96 characters with a letter or digit, no boilerplate, no address and no bare version."""
    return F.length(key).between(2, 96) & ~key.startswith("http") & key.rlike(r"[\p{L}\p{Nd}]") & ~key.isin(BOILERPLATE) & ~key.rlike(r"(?i)^v?[0-9]+([.-][0-9a-z]+)*$")


def is_heading_concept(title: Column, key: Column) -> Column:
    """A concept whose heading is neither a step of a procedure nor a path."""
    return is_concept(key) & ~F.trim(title).rlike(r"(?i)^([0-9]+[.)、]|[a-z][.)]|步骤\s*[:：0-9]+|[.]{1,2}/)")


def concept_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def stable_id(*parts: Column) -> Column:
    """32 hex digits of the hash of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *(p.cast("string") for p in parts)), 256), 1, 32)


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def meaningful(text: Column) -> Column:
    """How many letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))
