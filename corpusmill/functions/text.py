"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks without the line feed, as a regex class (what str.strip() takes away, but for line ends).
BLANK = r"[ \t\x0b\x0c\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE = BLANK[:-1] + r"\n\r]"

#: Terms that a search skips.
STOP_TERMS = (
    "一个", "一些", "这个", "那个", "就是", "其实", "可能", "可以", "因为", "所以",
    "但是", "然后", "还是", "已经", "没有", "什么", "这样", "里面", "现在", "他们",
    "我们", "你们", "自己", "比较", "觉得", "问题", "事情", "时候", "内容", "进行",
    "来说", "的话", "对吧", "这里", "那里", "这种", "很多", "非常", "怎么", "为什么",
)
#: Words with which a detail says nothing.
VAGUE_DETAILS = ("本段已覆盖", "本段内容已覆盖", "相关内容已写入", "已纳入正文", "见正文", "若干内容", "若干案例", "一些观点")
VAGUE_PATTERN = (
    r"^(?:(?:本|该)?段(?:内容)?(?:已经|已)?(?:覆盖|写入|纳入|处理)(?:完成)?|(?:详?见)(?:正文|上文|下文)|"
    r"(?:若干|一些|多个|多位|相关)(?:内容|观点|案例|人物|人士|原因|问题|事情)?)[。.!！]?$"
)
#: Units after which a number counts as an anchor.
NUMBER_UNITS = "%|％|万|亿|元|美元|人民币|岁|年|月|日|次|人|家|倍|公里|分钟|小时"
#: Fixed value: a time stamp in a text.
TIMESTAMP = r"(?<!\d)(\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?)(?!\d)"
#: Places and secrets that must not leave a project, by category.
PRIVATE = {
    "Windows user path": r"(?i)[A-Z]:\\Users\\[\w.-]+\\",
    "macOS user path": r"/Users/[\w.-]+/",
    "Linux home path": r"/home/[\w.-]+/",
    "OpenAI-style key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "GitHub token": r"\bgh[oprsu]_[A-Za-z0-9]{20,}\b",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def line_feeds(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_plain(text: Column) -> Column:
    """Line feeds only, single blanks, lines stripped, runs of empty lines folded to one, ends stripped."""
    text = F.replace(line_feeds(text), F.lit("\u00a0"), F.lit(" "))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, f"{BLANK}*\\n{BLANK}*", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalize_structured(text: Column) -> Column:
    """Line feeds only, blanks at line ends dropped, indentation kept, runs of empty lines folded, outer ones dropped."""
    text = F.replace(line_feeds(text), F.lit("\u00a0"), F.lit(" "))
    text = F.regexp_replace(text, f"{BLANK}+\\n", "\n")
    text = F.regexp_replace(F.regexp_replace(text, f"{BLANK}+$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\n+|\n+$", "")


def without_space(text: Column) -> Column:
    """All Unicode white space deleted."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def boundary_form(text: Column) -> Column:
    """Letters, numbers, the low line and CJK only, lower case; combining marks go."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_一-鿿]+", ""))


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t\x0b\x0c\r]+(.+)$"), F.lit(1))


def document_title(text: Column, stem: Column) -> Column:
    """The first top-level heading, else the file's stem."""
    return F.coalesce(F.get(F.regexp_extract_all(text, F.lit(r"(?m)^#[ \t]+(.+)$"), F.lit(1)), F.lit(0)), stem)


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def numeric_anchors(text: Column) -> Column:
    """Years and numbers with a unit, different ones in the order they appear; time stamps are blanked first."""
    clean = F.regexp_replace(text, TIMESTAMP, " ")
    pattern = rf"(?U)((?<![\d:])(?:19|20)\d{{2}}年?|(?<![\d:])\d+(?:\.\d+)?(?:{NUMBER_UNITS})(?!\w))"
    return F.array_distinct(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)))


#: What ends a sentence, and the ends of a question.
ENDS, ASKS = "。！？!?", "？?"


def question_anchors(text: Column) -> Column:
    """Questions of at least two characters, the last 180 characters of each.

    The text is taken in runs up to the next end of a sentence, so that no place is looked at twice."""
    runs = F.regexp_extract_all(text, F.lit(rf"([^{ENDS}\n]+[{ENDS}\n]?)"), F.lit(1))
    found = F.filter(runs, lambda x: (F.length(x) >= 3) & x.rlike(f"[{ASKS}]$"))
    return F.array_distinct(F.transform(found, lambda x: F.right(strip(x), F.lit(180))))


def is_vague(detail: Column) -> Column:
    return detail.isin(*VAGUE_DETAILS) | detail.rlike(VAGUE_PATTERN)


#: Fixed value: what a comment begins with.
COMMENT_LABEL = r"^(?:[>*#\-\s]*)?(?:(?:转发者|发布者)?(?:附言|按语|评论|导语)|编者按|转发语|我的评论)\s*[:：]?\s*"


def strip_comment_label(line: Column) -> Column:
    return strip(F.regexp_replace(line, f"(?i){COMMENT_LABEL}", ""))


def file_component(name: Column, fallback: str = "untitled", most: int = 80) -> Column:
    """A name without characters that file systems refuse."""
    clean = strip(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"\s+", " "))
    clean = F.regexp_replace(F.substring(clean, 1, most), r"[ .]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def markdown_cell(value: Column) -> Column:
    return F.replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\r\n|\r|\n", " "), F.lit("|"), F.lit("\\|"))


def between(text: Column, begin: str, end: str) -> Column:
    """What stands between two markers that occur once each, else null."""
    inner = F.substring_index(F.substring_index(text, begin, -1), end, 1)
    once = (count_of(text, begin) == 1) & (count_of(text, end) == 1) & (F.instr(text, begin) < F.instr(text, end))
    return F.when(once, inner)


def replace_section(text: Column, begin: str, end: str, content: Column) -> Column:
    """The managed section between two markers replaced, or appended where there is none; null if markers don't pair."""
    have, closed = count_of(text, begin), count_of(text, end)
    block = F.concat(F.lit(begin + "\n"), content, F.lit("\n" + end))
    new = F.concat(F.substring_index(text, begin, 1), block, F.substring_index(text, end, -1))
    appended = F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n\n"), block, F.lit("\n"))
    ordered = F.instr(text, begin) < F.instr(text, end)
    return F.when((have == 1) & (closed == 1) & ordered, new).when((have == 0) & (closed == 0), appended)


def has_sections(text: Column, wanted: list[str]) -> Column:
    """Are all these headings there?"""
    return F.forall(F.array(*map(F.lit, wanted)), lambda h: F.contains(text, h))


def config_without_icons(text: Column) -> Column:
    """Lines but for those that set an icon."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(r"^\s*icon[\w-]*\s*:")), "\n")


def url_kind(url: Column) -> Column:
    """remote, fragment, embedded, or local."""
    low = F.lower(strip(url))
    return (
        F.when(low.isNull() | (low == ""), "empty")
        .when(low.rlike(r"^(?:https?:|ftp:|mailto:|tel:|javascript:|blob:|//)"), "remote")
        .when(low.startswith("#"), "fragment")
        .when(low.rlike(r"^(?:cid|data):"), "embedded")
        .otherwise("local")
    )


def may_download(url: Column) -> Column:
    """HTTPS with a host and without credentials."""
    return F.coalesce(F.lower(url).rlike(r"^https://[^/?#@\s]+(?:[/?#]|$)"), F.lit(False))


def nonspace_length(text: Column) -> Column:
    return F.length(without_space(text)).cast("long")


def least_units(text: Column, density: int = 450) -> Column:
    """Information units that a chunk must have at least."""
    return F.greatest(F.lit(1), F.ceil(nonspace_length(text) / density)).cast("long")


def term_length_weight(term: Column) -> Column:
    """Longer CJK terms say more; all others count 1."""
    n = F.length(term)
    cjk = term.rlike(r"^[㐀-鿿]+$")
    return F.when(~cjk, 1.0).when(n <= 2, 0.65).when(n == 3, 1.0).when(n == 4, 1.35).otherwise(1.6)
