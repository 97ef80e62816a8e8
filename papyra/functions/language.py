"""What questions and labels are made of: search terms, keywords, identifiers, clips; Column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.text import CJK, once, token_estimate

#: Words that say nothing about what is asked.
STOPWORDS = (
    "a an the to of in on at for and or is are be it this that with from what how why when where which can should please help find search explain me you my "
    "请问 帮我 一下 知道 我想 这个 那个 看看"
).split()

#: Pairs of characters that any question holds.
GENERIC_PAIRS = "什么 是什 怎么 如何 这个 那个 一下 请问 帮我 知道 好的 收到 谢谢 哈哈 是的".split()

#: Particles that point at what was said before.
PARTICLES = "那 它 呢 这个 那个 上述".split()

#: Scripts that are written without spaces.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"


def separator(value: str | None) -> str:
    """A chunk separator as a user writes it: \\n and \\t stand for a line end and a tab; none is a blank line."""
    return value.replace("\\n", "\n").replace("\\t", "\t") if value else "\n\n"


def _grams(run: Column, n: int) -> Column:
    """All stretches of ``n`` characters of a run; none of a shorter one."""
    return F.when(F.length(run) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substr(run, i, F.lit(n))))


def one_space(text: Column) -> Column:
    """White space runs as one space, none around."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def identifier(text: Column) -> Column:
    """A name without regard to case and spacing."""
    return F.lower(one_space(text))


def lexical_terms(query: Column, most: int = 64) -> Column:
    """Terms any of which a chunk may hold: words of three characters or more, and trigrams of unspaced runs longer than three; sorted, at most ``most``."""
    runs = F.flatten(F.transform(F.regexp_extract_all(query, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda t: F.regexp_extract_all(t, F.lit(f"([{UNSPACED}]+|[^{UNSPACED}]+)"), 1)))
    terms = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{UNSPACED}]") & (F.length(r) > 3), _grams(r, 3)).when(F.length(r) >= 3, F.array(r)).otherwise(F.array().cast("array<string>"))))
    return F.slice(F.array_sort(F.array_distinct(terms)), 1, most)


def locator_terms(query: Column) -> Column:
    """Short tokens with a digit, all of which a chunk must hold."""
    return F.filter(F.regexp_extract_all(query, F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda t: (F.length(t) < 3) & t.rlike(r"\p{Nd}"))


def search_terms(query: Column) -> Column:
    """Distinct terms in order: runs of two or more letters and digits, pairs of Han characters (one alone stays); a question of one letter is its own term."""
    low = identifier(query)
    runs = F.regexp_extract_all(low, F.lit(r"(\p{IsHan}+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+)"), 1)

    def of(r):
        han = F.when(F.length(r) == 1, F.array(r)).otherwise(_grams(r, 2))
        return F.when(r.rlike(r"^\p{IsHan}"), han).when((F.length(r) >= 2) | (F.length(low) == 1), F.array(r)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(runs, of)))


def schema_terms(query: Column) -> Column:
    """Distinct terms for dictionaries: runs of a-z, 0-9 and _, cut after a second character when it is beyond ASCII."""
    found = F.regexp_extract_all(identifier(query), F.lit(r"([^\x00-\x7F]?[a-z0-9_]+[^\x00-\x7F]?|[^\x00-\x7F]{2})"), 1)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def _segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9一-鿿]+)"), 1)


def keywords(text: Column) -> Column:
    """Distinct keywords in order: words of two or more ASCII letters and digits that are no stopwords, pairs of characters of other segments."""

    def of(s):
        word = F.lower(s)
        return F.when(~s.rlike("^[A-Za-z0-9]+$"), _grams(s, 2)).when((F.length(word) >= 2) & ~word.isin(STOPWORDS), F.array(word)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(_segments(text), of)))


def topic_keywords(text: Column) -> Column:
    """Keywords without the pairs that any question holds."""
    return F.filter(keywords(text), lambda k: ~k.isin(GENERIC_PAIRS))


def strict_identifiers(text: Column) -> Column:
    """Numbers of 6 to 32 digits that stand alone, then tokens of 3 to 64 characters with a digit that are no addresses; the first of each, whatever its case."""
    numbers = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([0-9]{6,32})(?![A-Za-z0-9_])"), 1)
    tokens = F.regexp_extract_all(text, F.lit("([A-Za-z0-9][A-Za-z0-9._:/-]*[A-Za-z0-9])"), 1)
    tokens = F.filter(tokens, lambda t: F.length(t).between(3, 64) & t.rlike("[0-9]") & ~F.lower(t).rlike("^(https?://|ftp://|www[.])"))
    every = F.concat(numbers, tokens)
    low = F.transform(every, lambda t: F.lower(t))
    return F.filter(every, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


def contains_identifier(text: Column, wanted: Column) -> Column:
    """Whether an identifier stands in a text with no letter, digit or _ right before or after it."""
    quoted = F.concat(F.lit(r"(?<![a-z0-9_])\Q"), F.lower(wanted), F.lit(r"\E(?![a-z0-9_])"))
    return F.rlike(F.lower(text), quoted)


def shares_keywords(text: Column, words: Column) -> Column:
    """Whether a text holds any of the keywords; true if there are none."""
    return (F.size(words) == 0) | F.exists(words, lambda k: F.contains(F.lower(text), k))


def bound_query(text: Column, most: int) -> Column:
    """A query of at most ``most`` characters: its first 60 % (120 at most), a space and its end."""
    t = F.trim(text)
    head = min(most * 6 // 10, 120)
    if most <= 2 or head >= most - 1:
        return F.when(F.length(t) <= most, t).otherwise(F.left(t, F.lit(most)))
    return F.when(F.length(t) <= most, t).otherwise(F.concat_ws(" ", F.left(t, F.lit(head)), F.right(t, F.lit(most - head - 1))))


def clean_query(text: Column, most: int = 200) -> Column:
    """A question without stopwords and pointing particles, with its identifiers whole, bound in length."""

    def of(s):
        word = F.lower(s)
        bare = s
        for p in PARTICLES:
            bare = F.replace(bare, F.lit(p), F.lit(""))
        return F.when(~s.rlike("^[A-Za-z0-9]+$"), bare).when((F.length(word) >= 2) & ~word.isin(STOPWORDS), word).otherwise("")

    parts = F.filter(F.transform(_segments(text), of), lambda s: s != "")
    low = F.transform(parts, lambda s: F.lower(s))
    return bound_query(F.array_join(F.concat(parts, F.filter(strict_identifiers(text), lambda i: ~F.array_contains(low, F.lower(i)))), " "), most)


def clip_to_tokens(text: Column, budget: int) -> Column:
    """The beginning of a text, as long by characters as the budget is by tokens."""
    return once(token_estimate(text), lambda n: F.when(n <= budget, text).otherwise(F.left(text, F.floor(F.length(text) / n * budget).cast("int"))))


def fit_to_tokens(text: Column, budget: int) -> Column:
    """The longest beginning of a text that costs ``budget`` tokens or fewer, without white space around; '' if there is no room for any.

    Costs are counted in twelfths of a token, so sums are exact: 8 for a CJK character, 3 for any other.
    """
    if budget <= 0:
        return F.when(text.isNotNull(), "")
    chars = F.split(F.left(text, F.lit(4 * budget + 1)), "")
    zero = F.struct(F.lit(0).alias("cost"), F.lit(0).alias("n"))
    step = lambda s, c: F.struct((s["cost"] + F.when(c.rlike(f"[{CJK}]"), 8).otherwise(3)).alias("cost"), (s["n"] + F.when(s["cost"] + F.when(c.rlike(f"[{CJK}]"), 8).otherwise(3) <= 12 * budget, 1).otherwise(0)).alias("n"))
    head = F.aggregate(F.filter(chars, lambda c: c != ""), zero, step)["n"]
    return F.when(token_estimate(text) <= budget, text).otherwise(F.regexp_replace(F.left(text, head), r"^\s+|\s+$", ""))


def safe_label(text: Column) -> Column:
    """A label on one line, in round brackets, of 200 characters at most."""
    t = F.translate(one_space(text), "[]", "()")
    return F.when(F.length(t) > 200, F.concat(F.left(t, F.lit(197)), F.lit("..."))).otherwise(t)


def squash(score: Column) -> Column:
    """A score of 0 or more as a part of 1."""
    return score / (score + 1)


def fold_cjk_spaces(text: Column) -> Column:
    """No spaces or tabs between two Han characters; line ends stay."""
    return F.regexp_replace(text, "(?<=[㐀-䶿一-鿿])[ \\t\u3000\u00a0]+(?=[㐀-䶿一-鿿])", "")


def useful_ratio(text: Column) -> Column:
    """The part of a recognised text that is ASCII letters, digits or Han; 0 for a blank one."""
    return F.when(F.trim(text) == "", 0.0).otherwise(F.length(F.regexp_replace(text, "[^a-zA-Z0-9㐀-䶿一-鿿]", "")) / F.length(text))


def without_replacements(text: Column) -> Column:
    return F.replace(text, F.lit("\ufffd"), F.lit(""))


def projection(text: Column) -> Column:
    """A text for search: no control characters; a replacement character is a space between two letters, or a letter and a digit of which the letter is CJK, and nothing elsewhere."""
    letter, cjk = r"\p{L}", r"\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}"
    bad = "\ufffd"
    spaced = F.regexp_replace(text, f"(?<=[{letter}]){bad}(?=[{letter}])|(?<=[{cjk}]){bad}(?=\\p{{Nd}})|(?<=\\p{{Nd}}){bad}(?=[{cjk}])", " ")
    return F.regexp_replace(F.regexp_replace(spaced, f"{bad}|[\\p{{Cc}}&&[^\\t\\n\\r]]", ""), r"^\s+|\s+$", "")


def outline(headings: Column) -> Column:
    """Lines of an outline from an array of (level, title) in order; levels are 1 to 6, a nameless heading is called so."""
    line = lambda h: F.concat(F.repeat(F.lit("  "), F.least(F.greatest(h["level"], F.lit(1)), F.lit(6)) - 1), F.lit("- "), F.when(F.trim(h["title"]) == "", "heading").otherwise(F.trim(h["title"])))
    return F.array_join(F.transform(headings, line), "\n")


def table_cells(line: Column) -> Column:
    """The cells of a line that is a table row: parted at bars, else at tabs, empty ones dropped; null if it has neither."""
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    cells = lambda sign: F.filter(F.transform(F.split(t, sign), lambda c: F.trim(c)), lambda c: c != "")
    return F.when(F.contains(t, F.lit("|")), cells("[|]")).when(F.contains(t, F.lit("\t")), cells("\t"))


def json_list(values: Column) -> Column:
    """A list of strings as JSON; null is an empty one."""
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def from_json_map(text: Column) -> Column:
    """A map of strings from JSON; what is none is an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
