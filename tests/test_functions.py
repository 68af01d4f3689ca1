"""Text and score functions on hand-written rows: scripts without blanks, personal data, page remains, negations."""

import pytest
from pyspark.sql import functions as F

from medcorpus.functions import scoring as S
from medcorpus.functions import text as T
from medcorpus.operators import dialogues as D
from medcorpus.operators import records as R


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in enumerate(values)))
    return df.select(f(*[F.col(k) for k in df.columns])).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.clean_text, "a\r\nPage 12\r\n b \t c\n\n\n\nd" + chr(0xA0) + "e" + chr(0x3000) + "\n", "a\nb c\n\nd e"),
        (T.clean_text, None, ""),
        (T.strip_attribution, "x\nProvided by: y\nCC BY 4.0: z\nend", "x\nend"),
        (T.strip_html, "BR> a<br/>b&nbsp;c 血压<140/90 <b>d</b>", "a b c 血压<140/90  d"),
        (T.norm_key, "A-b_c 你好。1!", "abc你好1"),
        (T.norm_question, "  What\n is  IT ", "what is it"),
        (T.clean_report, "XXXX heart  size . Normal ,", "heart size. Normal,"),
        (T.strip_answer_prefix, "Ans. is 'c' i.e., The cell", "The cell"),
        (T.strip_reasoning, "<think>a\nb</think> yes", "yes"),
        (T.strip_reasoning, "<think>never ends", ""),
        (T.problem_list, "a; b;;", ["a", "b"]),
        (T.problem_list, " Normal ", []),
        (T.negation_scrub, "No effusion or mass. Small nodule", " . Small nodule"),
        (T.paragraphs, "a\nb\n\nc", ["a b", "c"]),
        (T.paragraphs, "你\n好\n\nc", ["你好", "c"]),
        (T.token_count, "abcdefg", 3),
        (S.normalize_answer, " The  Left-lung, a mass. ", "leftlung mass"),
        (S.yes_no, "Normal study", "no"),
        (S.yes_no, "Yes, it is", "yes"),
        (S.yes_no, "lung", "other"),
        (S.yes_no_zh, "不正常。", "no"),
        (S.yes_no_zh, "正常", "yes"),
        (S.yes_no_zh, "", "other"),
        (S.says_normal, "normal lung with no evidence of consolidation or nodules", True),
        (S.says_normal, "normal heart but a nodule is seen", False),
        (S.reports_any, "No effusion but a fracture", True),
        (S.reports_lung, "without pneumonia; heart enlarged", False),
    ],
)
def test_of_one_text(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize(("text", "want"), [("电话13812345678。", True), ("数138123456789", False), ("a.b@c.de", True), ("QQ：123456", True), ("see www.x", True), ("dose 5 mg", False), (None, False)])
def test_personal_data(spark, text, want):
    assert one(spark, T.has_pii, text) is want


def test_promotion(spark):
    assert one(spark, T.looks_like_ad, "美容整形优惠，电话咨询") is True
    assert one(spark, T.looks_like_ad, "肺炎" * 400) is False
    assert one(spark, T.looks_like_promo, "来院优惠") is True
    assert one(spark, T.looks_like_promo, "来院来院") is False


@pytest.mark.parametrize(("p", "g", "want"), [("yes.", "Yes", 1.0), ("normal", "no", 1.0), ("left", "the left", 1.0), ("right", "left", 0.0)])
def test_closed_score(spark, p, g, want):
    assert one(spark, S.closed_score, p, g) == want


def test_overlaps(spark):
    assert one(spark, S.token_recall, "left lung lung", "lung lung left right") == pytest.approx(0.75)
    assert one(spark, S.token_f1, "", "") == 1.0 and one(spark, S.token_f1, "a b", "") == 0.0 and one(spark, S.token_recall, "x", "") == 0.0
    assert one(spark, S.char_f1_zh, "左肺", "左下肺") == pytest.approx(0.8)
    assert one(spark, S.vqa_accuracy, "Red", ["red", "the red.", "blue"]) == pytest.approx(2 / 3)
    assert one(spark, S.ref_recall, "a dog runs", ["the dog", "cat"]) == 1.0


def test_reading_answers(spark):
    read = lambda x: one(spark, lambda c: F.struct(*S.parse_label(c)), x)
    assert tuple(read("Maybe so")) == ("maybe", False) and tuple(read("I say no")) == ("no", False) and tuple(read("?")) == ("maybe", True)
    assert one(spark, S.parse_choice, "Answer: b.") == "B" and one(spark, S.parse_choice, "Bad") == ""
    assert one(spark, lambda c: S.parse_choice(c, 5, cjk=True), "答案是C选项") == "C"


def chat(*texts):
    return [("user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]


def test_dialogues(spark):
    rows = [("ok", chat("what is it", "it is a small thing")), ("short", chat("hm", "it is a small thing")), ("pii", chat("call me", "dial 13812345678 now")), ("promo", chat("where to", "来院优惠，电话预约吧朋友们")), ("image", chat("看图说话吧", "it is a small thing")), ("format", chat("a b c d"))]
    df = spark.createDataFrame(rows, "want string, messages array<struct<role string, content string>>")
    cut, reason = D.drop_reason(F.col("messages"))
    for r in df.select("want", reason.alias("got"), D.trim_rounds(F.col("messages"), 40).alias("fit")).collect():
        assert (r.got or "ok") == r.want
    long = spark.createDataFrame([(chat("a" * 20, "b" * 20, "c" * 20, "d" * 200),)], "messages array<struct<role string, content string>>")
    assert len(long.select(D.trim_rounds(F.col("messages"), 60)).first()[0]) == 2
    assert long.select(D.trim_rounds(F.col("messages"), 20)).first()[0] is None
    spans = long.select(D.loss_spans(F.col("messages"), 60)).first()[0]
    assert [s.text for s in spans if s.trained] == ["b" * 20 + "<|im_end|>\n"]
    parsed = spark.createDataFrame([(["问：<b>头痛</b>", "答：休息"],)], "data array<string>").select(D.parse_prefixed_turns(F.col("data"))).first()[0]
    assert [(m.role, m.content) for m in parsed] == [("user", "头痛"), ("assistant", "休息")]


def test_records(spark):
    df = spark.createDataFrame([("Q?", "A", "b", "", "d", 1)], "q string, a string, b string, c string, d string, n int")
    prompt = df.select(R.mcq_eval_prompt(F.lit("nan"), F.col("q"), {k.upper(): F.col(k) for k in "abcd"})).first()[0]
    assert prompt == "Q?\nA. A\nB. b\nD. d" + R.MCQ_SUFFIX
    ok = lambda x, a: one(spark, R.rewrite_ok, x, a)
    assert ok("Yes, there is one", "yes") and not ok("There is, yes indeed", "yes") and ok("It is in the left lung", "left lung") and not ok("It is in the leftmost lung", "left") and not ok("too short", "short")
    with pytest.raises(Exception, match="format line"):
        one(spark, R.strip_prompt_suffix, "no suffix")
    assert one(spark, lambda p: R.remap_path(p, [("/a/", "/b/")], (".dcm", ".jpg")), "/a/x.dcm") == "/b/x.jpg"
    assert one(spark, lambda p: R.remap_path(p, [("/a/", "/b/")], (".dcm", ".jpg")), "/c/x") == "/c/x.jpg"
    assert one(spark, lambda a, b: R.report_text(a, b), " ", None) is None
