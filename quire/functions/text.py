"""Fixed patterns of the text rules, portable between Java's and RE2's regular expressions, and SQL of the scalar rules."""

from __future__ import annotations

from quire.plans.dialect import Spark

# Fixed values.
#: A text without any letter: digits, symbols, blanks.
NO_LETTER = r"^[^\p{L}\p{Nl}\p{No}]*$"
LATIN = "[A-Za-z]"
CJK = r"[\x{4e00}-\x{9fff}]"
CJK_WIDE = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
ELLIPSIS = r"……|…|\.\.\.|。。。"
NOTES = r"原文未提供|保持原样|无法翻译|未提供原文|此处省略|翻译如下|译文[:：]|原文[:：]|<[a-z/][^>]*>|\[(TODO|待译|略)\]"
CN_NUMBER = "[一二三四五六七八九十百千万亿零两〇]"
NUMBER = r"\d[\d,\s]*"
SENTENCE_END = ".?!。！？…"
CONTINUES = ",;:)]}、，；：）》」』"
LIST_HEAD = r"^\s*([-*\x{2022}\x{2013}\x{2014}]|\(?\d{1,3}[.)]|[a-z][.)]\s)"
LOWER_HEAD = r"""^["\x{27}({\[\x{2018}\x{201c}\x{300c}\x{300e}]*[a-z]"""
BLANKS = r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$"
DEDUPE_STRIP = r"[\s。，！？、；：“”‘’「」『』（）()\[\]【】·…—,.!?;:\x{22}\x{27}{}<>«»\x{2013}_/\\|-]+"

#: Mathematical symbols and what may stand for each in Chinese, or itself. Fixed values.
SYMBOLS = """('√', '根号'), ('√', '平方根'), ('√', '开方'), ('∑', '求和'), ('∑', '总和'), ('∑', '累加'), ('∑', 'Σ'), ('∏', '连乘'), ('∏', '乘积'), ('∏', 'Π'), ('∫', '积分'), ('∂', '偏导'), ('∂', '偏微分'), ('∆', '变化量'), ('∆', '增量'), ('∆', '△'), ('∆', 'Δ'),
('≈', '约等于'), ('≈', '近似'), ('≈', '约'), ('≠', '不等于'), ('≤', '小于等于'), ('≤', '不大于'), ('≥', '大于等于'), ('≥', '不小于'), ('±', '正负'), ('±', '加减'), ('∞', '无穷'), ('∞', '无限'), ('∈', '属于'), ('⊂', '包含于'), ('⊂', '子集'), ('∪', '并集'), ('∪', '并'), ('∩', '交集'), ('∩', '交'),
('→', '趋近'), ('→', '得到'), ('→', '推出'), ('⇒', '推出'), ('⇒', '因此'), ('π', '圆周率'), ('θ', '角度'), ('α', 'α'), ('β', 'β'), ('λ', 'λ'), ('μ', 'μ'), ('σ', 'σ'), ('Ω', 'Ω')"""


def _encodes(c: str, codec: str) -> bool:
    try:
        c.encode(codec)
    except UnicodeEncodeError:
        return False
    return True


#: Characters of traditional Chinese alone, by a rule: the traditional national set has them, the simplified one does not.
TRADITIONAL = "[" + "".join(c for c in map(chr, range(0x4E00, 0xA000)) if _encodes(c, "big5") and not _encodes(c, "gb2312")) + "]"


def strip(d: Spark, x: str) -> str:
    return d.replace(f"coalesce({x}, '')", BLANKS, "")


def needs_translation(d: Spark, x: str, target: str = "zh-Hans") -> str:
    """Whether a unit is sent: not blank, has a letter; for Chinese, a Latin letter, and not mostly Chinese already."""
    some = f"{x} <> '' AND NOT {d.like(x, NO_LETTER)}"
    if not target.startswith("zh"):
        return f"({some})"
    cjk, latin = d.count(x, CJK), d.count(x, LATIN)
    return f"({some} AND NOT ({cjk} > 0 AND 3 * {cjk} >= {latin}) AND {d.like(x, LATIN)})"


def skip_reason(d: Spark, x: str) -> str:
    """blank, symbol, already_cn or translate."""
    cjk, latin = d.count(x, CJK_WIDE), d.count(x, LATIN)
    return f"CASE WHEN {x} = '' THEN 'blank' WHEN NOT {d.like(x, '[a-zA-Z]|' + CJK_WIDE)} AND {d.like(x, NO_LETTER)} THEN 'symbol' WHEN {cjk} > 0 AND 10 * {cjk} >= 6 * ({cjk} + {latin}) THEN 'already_cn' ELSE 'translate' END"


def tidy(d: Spark, x: str) -> str:
    return f"trim({d.replace(d.replace(x, '[\\r\\n]+', ' '), '[ \\t]+', ' ')})"


def safe_name(d: Spark, x: str) -> str:
    return f"substring({d.replace(x, '[^A-Za-z0-9._-]+', '_')}, 1, 80)"


def email_mask(d: Spark, x: str) -> str:
    """First two characters, or one of a name of at most two, stars, and the domain behind the last @."""
    name = d.extract(x, "^(.*)@", 1)
    return f"concat(substring({name}, 1, CASE WHEN length({name}) > 2 THEN 2 ELSE 1 END), '***', '@', {d.extract(x, '@([^@]*)$', 1)})"


def can_follow(d: Spark, before: str, line: str) -> str:
    """Whether ``line`` goes on with the sentence of ``before`` (both stripped), by their text alone."""
    hyphen = f"(right({before}, 1) = '-' OR right({before}, 1) = '­')"
    ends = f"({' OR '.join(f'''right({before}, 1) = '{c}' ''' for c in SENTENCE_END)})"
    goes_on = f"({' OR '.join(f'''left({line}, 1) = '{c}' ''' for c in CONTINUES)})"
    head = d.like(line, LOWER_HEAD)
    return f"({before} <> '' AND {line} <> '' AND NOT {d.like(line, LIST_HEAD)} AND ({hyphen} OR NOT {ends}) AND ({head} OR {goes_on}))"
