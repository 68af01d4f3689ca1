"""Column functions that clean text and test it. None runs Python on the executors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a page number, an attribution line, personal data, page residue, promotion and pictures.
PAGE_NUMBER = r"(?i)^\s*(page\s*)?\d{1,4}\s*$"
ATTRIBUTION = r"(?i)Provided by:|Located at:|License:|Authored by:|creativecommons\.org|Public Domain:|\bCC BY(-[A-Z]+)*(\s\d\.\d)?\s*:"
PII = r"(?i)(?<!\d)1[3-9]\d{9}(?!\d)|(?<!\d)\d{17}[\dXx](?!\d)|[\w.+-]+@[\w-]+\.[\w.]+|[Qq]{2}[:：号]?\s*\d{5,}|https?://|www\."
HTML = r"(?i)<\s*/?\s*(br|p|div|span|b|strong|em|i|font)\b[^>]*>|^\s*/?\s*br\s*/?\s*>|&nbsp;"
PROMO_QA = r"我院|本院|来院|热线|优惠|名额|专家在线|在线解答|在线咨询|网站|微信|QQ|电话"
AD_WORDS = (
    r"整形|美容|医美|诊所|价格|多少钱|收费|优惠|咨询|电话|热线|地址|预约|微信|QQ|热玛吉|玻尿酸|双眼皮|隆鼻|祛斑|脱毛"
    r"|无痛人流|人流|不孕不育|白癜风医院|牛皮癣医院|癫痫医院|男科医院|妇科医院|专科医院|妇科网|在线解答|专家在线"
    r"|免费|名额|援助|来院|挂号|网站|本院|我院|医学研究院|公益|活动期间"
)
IMAGE_WORDS = r"图片|照片|上传|附件|看图|这张图|截图|传图"
ANSWER_PREFIX = r"(?i)^\s*(ans(wer)?\.?\s*(is)?\s*[:\-]?\s*['\"‘’(]?\s*[a-d]\s*['\"‘’)]?\s*[,.:;-]?\s*(i\.?\s*e\.?\s*[,:]?)?)"
NEGATED = r"(?i)\b(?:no|without|negative for|free of|absence of|absent|rule[sd]? out|not (?:seen|present|identified|visible))\b[^.;]*?(?=\bbut\b|\bhowever\b|\balthough\b|[.;]|$)"


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, though lambdas inside f use it for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def text_of(col: Column) -> Column:
    """A missing text is an empty one."""
    return F.coalesce(col, F.lit(""))


def clean_text(col: Column) -> Column:
    """One line end, plain blanks, no page-number lines, single blanks inside lines, one empty line at most."""
    x = text_of(col)
    for old, new in (("\r\n", "\n"), ("\r", "\n"), (chr(0xA0), " "), (chr(0x3000), " ")):
        x = F.replace(x, F.lit(old), F.lit(new))
    # in the whole text at once, and single blanks are no matches
    x = F.regexp_replace(x, r" [ \t\f\x0b]+|[\t\f\x0b][ \t\f\x0b]*", " ")
    # with single blanks a page-number line has 12 characters at most
    lines = F.transform(F.filter(F.split(x, "\n"), lambda s: ~((F.length(s) <= 12) & s.rlike(PAGE_NUMBER))), lambda s: F.trim(s))
    # now only line ends are left around it; the pattern's end is before one of these marks, too
    odd = lambda s: F.endswith(s, F.lit("\u0085")) | F.endswith(s, F.lit("\u2028")) | F.endswith(s, F.lit("\u2029"))
    bare = lambda s: F.when(odd(s), F.regexp_replace(s, r"^\s+|\s+$", "")).otherwise(F.btrim(s, F.lit("\n")))
    return let(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), bare)


def strip_attribution(col: Column) -> Column:
    """Without lines that only say where something is from. Lines are tested only in a text that has one of the words at all."""
    words = ("provided by:", "located at:", "license:", "authored by:", "creativecommons.org", "public domain:", "cc by")
    may = lambda low: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])
    rest = lambda t: F.array_join(F.filter(F.split(t, "\n"), lambda s: ~s.rlike(ATTRIBUTION)), "\n")
    return let(text_of(col), lambda t: F.when(let(F.lower(t), may), rest(t)).otherwise(t))


def hits(col: Column, pattern: str) -> Column:
    """All matches of a pattern. If it is a list of plain words, a place is tried only where one of their first characters can be."""
    if re.fullmatch(r"[^\\()\[\]{}.*+?^$|-]+(\|[^\\()\[\]{}.*+?^$|-]+)*", pattern):
        firsts = sorted({w[0] for w in pattern.split("|")})
        latin, beyond = [c for c in firsts if c < "\u0100"], [c for c in firsts if c >= "\u0100"]
        # one range for all that are not Latin: quick to test
        span = f"{beyond[0]}-{beyond[-1]}" if beyond else ""
        pattern = f"(?=[{''.join(latin)}{span}])(?:{pattern})"
        if beyond:
            # most texts have none of these characters, which is quick to see
            found = F.regexp_extract_all(text_of(col), F.lit(f"({pattern})"), F.lit(1))
            return F.when(text_of(col).rlike(f"[{''.join(latin)}{span}]"), found).otherwise(F.array().cast("array<string>"))
    return F.regexp_extract_all(text_of(col), F.lit(f"({pattern})"), F.lit(1))


def looks_like_ad(col: Column, words: str = AD_WORDS, per_thousand: float = 2.0) -> Column:
    """More than per_thousand promotional words in a thousand characters."""
    return F.size(hits(col, words)) * 1000 / F.greatest(F.lit(1), F.length(text_of(col))) > per_thousand


def looks_like_promo(col: Column, words: str = PROMO_QA, kinds: int = 2) -> Column:
    """At least so many different promotional words."""
    return F.size(F.array_distinct(hits(col, words))) >= kinds


def has_pii(col: Column) -> Column:
    """A phone or identity number, e-mail, messenger number or link."""
    return text_of(col).rlike(PII)


def strip_html(col: Column) -> Column:
    """Without a few tags and their remains; ``<140/90`` stays."""
    return F.trim(F.regexp_replace(text_of(col), HTML, " "))


def norm_key(col: Column) -> Column:
    """Letters and digits only, lower-cased: a key for comparing texts."""
    return F.lower(F.regexp_replace(text_of(col), r"[^\p{L}\p{N}]+", ""))


def norm_question(col: Column) -> Column:
    """Lower-cased with single blanks: a key for exact questions."""
    return F.trim(F.regexp_replace(F.lower(text_of(col)), r"\s+", " "))


def clean_report(col: Column, mask: bool = True) -> Column:
    """Single blanks, none before punctuation, and optionally no XXXX masks."""
    x = F.regexp_replace(text_of(col), r"\bX{2,}\b", " ") if mask else text_of(col)
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"\s+([.,;:])", "$1"))


def strip_answer_prefix(col: Column) -> Column:
    """An explanation without its leading "Ans. is 'c' i.e.,"."""
    return F.trim(F.regexp_replace(text_of(col), ANSWER_PREFIX, ""))


def strip_reasoning(col: Column) -> Column:
    """Without thinking parts; one that never ends leaves nothing."""
    rest = F.regexp_replace(text_of(col), r"(?is)<think>.*?</think>", "")
    return F.when(F.contains(F.lower(rest), F.lit("<think>")), "").otherwise(F.trim(rest))


def problem_list(col: Column) -> Column:
    """Parts of a ``;`` list; none for an empty one or "normal"."""
    parts = F.filter(F.transform(F.split(text_of(col), ";"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.lower(F.trim(text_of(col))) == "normal", F.array().cast("array<string>")).otherwise(parts)


def negation_scrub(col: Column) -> Column:
    """Without negated spans, up to the end of the sentence or a "but"."""
    return F.regexp_replace(text_of(col), NEGATED, " ")


def token_count(col: Column) -> Column:
    """A plain estimate: half the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text_of(col)) / 2)).cast("int")


def token_counts(texts: Column) -> Column:
    """token_count of each of an array of texts."""
    return F.transform(texts, token_count)


def counter(load: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """As token_counts, by a tokenizer: load makes the function that counts one text, once a worker and batch of tasks."""

    @F.pandas_udf("array<int>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for texts in batches:
            yield texts.map(lambda own: [count(t or "") for t in own] if own is not None else None)

    return counts


def paragraphs(col: Column) -> Column:
    """Parts between empty lines, or lines if there are many and no empty one; wrapped lines joined, by a blank, or as they are if the part is Chinese."""
    drop = lambda a: F.filter(F.transform(a, lambda s: F.trim(s)), lambda s: s != "")
    is_long = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) > 10
    lines = lambda x, parts: F.when((F.size(parts) <= 1) & is_long(x), drop(F.split(x, "\n"))).otherwise(parts)
    unwrapped = lambda s: F.when(s.rlike("[一-鿿]"), F.replace(s, F.lit("\n"), F.lit(""))).otherwise(F.regexp_replace(s, r"\s*\n\s*", " "))
    # texts and parts are worked out once, though they are looked at more than once
    parts = let(text_of(col), lambda x: let(drop(F.split(x, r"\n\s*\n")), lambda own: lines(x, own)))
    return F.transform(parts, lambda s: F.when(F.contains(s, F.lit("\n")), unwrapped(s)).otherwise(s))


#: What SQL's trim takes for blanks: separators of words, not tabs or line ends.
BLANKS = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def line_paragraphs(col: Column, many: int = 10) -> Column:
    """As paragraphs, of a text whose empty lines part nothing: its lines if there are more than so many line feeds, else all of them joined by blanks as one part, an empty one too; null of a missing text."""
    own = lambda x: F.filter(F.transform(F.split(x, "\n"), lambda s: F.btrim(s, F.lit(BLANKS))), lambda s: s != "")
    feeds = F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))
    return let(own(col), lambda lines: F.when(feeds > many, lines).when(col.isNotNull(), F.array(F.array_join(lines, " "))))


def rank_key(seed: int | str, salt: str, *key: Column) -> Column:
    """The place of a key in a seeded order: the same however the rows are dealt."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[k.cast("string") for k in key]))


def hash_number(*parts: Column) -> Column:
    """A 32-bit number from a seeded key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
