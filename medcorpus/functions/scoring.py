"""Column functions that score an answer against what was expected, and read answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medcorpus.functions.text import let, negation_scrub, text_of

#: Word lists of the scores.
ARTICLES = ("a", "an", "the")
ZH_PUNCTUATION = "[\\s，。、；：？！“”‘’（）《》【】,.;:?!\"'()\\[\\]<>]+"
ZH_NO = ("不是", "不包含", "没有", "不可以", "不正常", "不存在", "不能", "否", "无", "异常")
ZH_YES = ("是的", "是", "包含", "有", "可以", "正常", "健康", "存在", "能", "对")
REFUSAL = r"(?i)\b(unanswerable|cannot|can't|unable|not possible|no image|sorry)\b"
NORMAL_CLAIM = r"(?i)\bno (?:acute|obvious|significant|visible|evident)?\s*(?:abnormal|lesion|finding)|\bnormal\b|unremarkable|within normal limits"
ABNORMAL = r"(?i)abnormal|lesion|mass|tumou?r|nodul|opacit|effusion|consolidat|infiltrat|edema|oedema|hemorrhag|haemorrhag|fractur|cancer|carcinom|enlarg|cardiomegal|pneumon|atelecta|pneumothorax|cyst|metasta"
LUNG = r"(?i)opacit|consolidat|infiltrat|pneumon|effusion|atelecta|ground-glass|pneumothorax|nodul|mass|infection|inflammat|fluid accumulation|edema|oedema"
FINDINGS = {
    "Enlarged Cardiomediastinum": r"mediastin|cardiomediastinal",
    "Cardiomegaly": r"cardiomegal|enlarged (?:heart|cardiac)|(?:heart|cardiac silhouette)[^.;]*enlarg",
    "Lung Opacity": r"opacit|infiltrat|consolidat|haz",
    "Lung Lesion": r"nodul|mass|lesion|tumou?r",
    "Edema": r"edema|oedema|vascular congestion",
    "Consolidation": r"consolidat",
    "Pneumonia": r"pneumon|infection|infectious",
    "Atelectasis": r"atelecta",
    "Pneumothorax": r"pneumothora",
    "Pleural Effusion": r"effusion|fluid",
    "Pleural Other": r"pleural (?:thicken|scar)|thickening",
    "Fracture": r"fractur",
}
MODALITY = {"CT": r"\bct\b|computed tomograph", "MRI": r"\bmri\b|magnetic resonance|\bt1\b|\bt2\b|flair", "X-Ray": r"x-?ray|radiograph"}
LOCATION = {
    "Lung": r"lung|chest|thora|pulmonar",
    "Abdomen": r"abdom|liver|kidney|spleen|bowel|pancrea",
    "Brain_Tissue": r"brain|head|cran|skull|cerebr",
    "Brain": r"brain|head|cran|skull|cerebr",
    "Brain_Face": r"brain|head|face|facial|orbit|skull|sinus",
    "Pelvic Cavity": r"pelvi|bladder|rect|uter|prostat",
    "Neck": r"neck|thyroid|cervical|trache",
    "Chest_mediastinal": r"chest|mediastin|heart|thora",
}
STOP_WORDS = (
    "a an the of on in at to and or is are was were be with for by from it its this that there these those "
    "some two three one near next while as into over under up down out"
)


def words(col: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text_of(col), r"\s+"), lambda w: w != "")


def normalize_answer(col: Column) -> Column:
    """Lower-cased, without ASCII punctuation and articles, single blanks."""
    x = F.regexp_replace(F.lower(F.trim(text_of(col))), r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "")
    return F.array_join(F.filter(words(x), lambda w: ~w.isin(*ARTICLES)), " ")


def yes_no(col: Column) -> Column:
    """yes, no or other, by the first word or else by how the answer begins (so "normal" is no)."""
    n = normalize_answer(col)
    first = F.substring_index(n, " ", 1)
    return (
        F.when(first.isin("yes", "y", "true"), "yes").when(first.isin("no", "n", "false"), "no")
        .when(F.startswith(n, F.lit("yes")), "yes").when(F.startswith(n, F.lit("no")), "no").otherwise("other")
    )


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalize_answer(pred) == normalize_answer(gold)).cast("double")


def closed_score(pred: Column, gold: Column) -> Column:
    """Folded yes or no equal; another gold answer must be met word for word."""
    g = yes_no(gold)
    return F.when(g != "other", (yes_no(pred) == g).cast("double")).otherwise(exact_match(pred, gold))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two word lists with repeats."""
    count = lambda of, w: F.size(F.filter(of, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))


def _answer_words(col: Column) -> Column:
    return words(normalize_answer(col))


def _of_two(pred: Column, gold: Column, f) -> Column:
    """f of two word lists, each made once."""
    return let(F.struct(pred.alias("p"), gold.alias("g")), lambda x: f(x["p"], x["g"]))


def recall_of(pred: Column, gold: Column) -> Column:
    """Share of the gold list that pred has."""
    return _of_two(pred, gold, lambda p, g: F.when(F.size(g) == 0, 0.0).otherwise(overlap(g, p) / F.size(g)))


def f1_of(pred: Column, gold: Column) -> Column:
    def f1(p: Column, g: Column) -> Column:
        none = (F.size(g) == 0) | (F.size(p) == 0)
        return F.when(none, (F.size(g) == F.size(p)).cast("double")).otherwise(2.0 * overlap(g, p) / (F.size(g) + F.size(p)))

    return _of_two(pred, gold, f1)


def token_recall(pred: Column, gold: Column) -> Column:
    return recall_of(_answer_words(pred), _answer_words(gold))


def token_f1(pred: Column, gold: Column) -> Column:
    return f1_of(_answer_words(pred), _answer_words(gold))


def vqa_accuracy(pred: Column, golds: Column) -> Column:
    """A third for each annotator that agrees, one at most."""
    p = normalize_answer(pred)
    return F.least(F.size(F.filter(golds, lambda g: normalize_answer(g) == p)) / 3.0, F.lit(1.0))


def normalize_zh(col: Column) -> Column:
    return F.lower(F.regexp_replace(text_of(col), ZH_PUNCTUATION, ""))


def yes_no_zh(col: Column) -> Column:
    """Negative beginnings are tried before positive ones."""
    n = normalize_zh(col)
    begins = lambda ws: n.rlike("^(" + "|".join(ws) + ")")
    return F.when(begins(("yes",)), "yes").when(begins(("no",)), "no").when(begins(ZH_NO), "no").when(begins(ZH_YES), "yes").otherwise("other")


def exact_match_zh(pred: Column, gold: Column) -> Column:
    return (normalize_zh(pred) == normalize_zh(gold)).cast("double")


def closed_score_zh(pred: Column, gold: Column) -> Column:
    g = yes_no_zh(gold)
    return F.when(g != "other", (yes_no_zh(pred) == g).cast("double")).otherwise(exact_match_zh(pred, gold))


def characters(col: Column) -> Column:
    return F.filter(F.split(normalize_zh(col), ""), lambda c: c != "")


def char_recall_zh(pred: Column, gold: Column) -> Column:
    return recall_of(characters(pred), characters(gold))


def char_f1_zh(pred: Column, gold: Column) -> Column:
    return f1_of(characters(pred), characters(gold))


def parse_label(col: Column) -> tuple[Column, Column]:
    """yes, no or maybe, and whether nothing could be read (then maybe)."""
    n = normalize_answer(col)
    w = words(n)
    by_start = F.coalesce(*[F.when(F.startswith(n, F.lit(k)), k) for k in ("yes", "no", "maybe")])
    by_word = F.coalesce(*[F.when(F.array_contains(w, k), k) for k in ("yes", "no", "maybe")])
    found = F.coalesce(by_start, by_word)
    return F.coalesce(found, F.lit("maybe")), found.isNull()


def parse_choice(col: Column, n_options: int = 4, cjk: bool = False) -> Column:
    """The first letter of the options that stands alone, or an empty string."""
    last = "ABCDEFGH"[n_options - 1]
    pattern = f"(?<![A-Z])([A-{last}])(?![A-Z])" if cjk else f"\\b([A-{last}])\\b"
    return F.regexp_extract(F.upper(text_of(col)), pattern, 1)


def says_normal(col: Column) -> Column:
    """Claims to be normal and, once claims and negations are gone, names nothing abnormal."""
    rest = negation_scrub(F.regexp_replace(text_of(col), NORMAL_CLAIM, " "))
    return text_of(col).rlike(NORMAL_CLAIM) & ~rest.rlike(ABNORMAL)


def reports_any(col: Column) -> Column:
    return negation_scrub(col).rlike(ABNORMAL)


def reports_lung(col: Column) -> Column:
    return negation_scrub(col).rlike(LUNG)


def mentions(col: Column, pattern: Column | str) -> Column:
    """A finding's words in the text without negations."""
    rest = F.lower(negation_scrub(col))
    return rest.rlike(pattern) if isinstance(pattern, str) else F.regexp_like(rest, pattern)


def lexicon_ok(text: Column, attribute: Column, lexicon: dict[str, str]) -> Column:
    """Whether the text has the words of its attribute; an unknown attribute is looked for itself."""
    low = F.lower(text_of(text))
    out = F.contains(low, F.lower(text_of(attribute)))
    for name, pattern in lexicon.items():
        out = F.when(attribute == name, low.rlike(pattern)).otherwise(out)
    return out


def latin_tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_of(col)), F.lit("([a-z0-9]+)"), F.lit(1))


def ref_recall(pred: Column, refs: Column) -> Column:
    """The best share of a reference's content words that pred has."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS.split()])

    def best(have: Column) -> Column:
        share = lambda content: F.when(F.size(content) > 0, F.size(F.array_intersect(content, have)) / F.size(content)).otherwise(0.0)
        return F.array_max(F.transform(F.transform(refs, lambda r: F.array_except(latin_tokens(r), stop)), share))

    return F.coalesce(let(F.array_distinct(latin_tokens(pred)), best), F.lit(0.0))


def distinct2(tokens: Column) -> Column:
    """Distinct pairs of neighbours among all; 1 if there are none."""

    def share(t: Column) -> Column:
        n = F.size(t) - 1
        pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(n, F.lit(0))), F.slice(t, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(n < 1, 1.0).otherwise(F.size(F.array_distinct(pairs)) / n)

    return let(tokens, share)


def classify_polarity(question: Column, answer: Column, content_type: Column) -> Column:
    """Whether a yes/no answer says that something is wrong, and whether the question names it."""
    a = F.lower(F.trim(text_of(answer)))
    yes, kind = a == "yes", F.when(question.rlike("(?i)abnormal|unhealthy"), "global").otherwise("specific")
    return (
        F.when(~a.isin("yes", "no"), "not_yn").when(content_type == "Organ", "organ").when(content_type.isNull() | (content_type != "Abnormality"), "other")
        .when(question.rlike(r"(?i)\b(healthy|normal)\b"), F.when(yes, "neg_global").otherwise("pos_global"))
        .otherwise(F.concat(F.when(yes, "pos_").otherwise("neg_"), kind))
    )
