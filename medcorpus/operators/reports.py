"""Reports over scored answers, labels and logs: grouped aggregates that Spark combines on the map side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medcorpus.functions.scoring import REFUSAL, distinct2, latin_tokens
from medcorpus.storage import stored


def mean_if(value: Column, when: Column) -> Column:
    """The mean of value where when holds; null if it never does."""
    return F.avg(F.when(when, value))


def count_if(when: Column) -> Column:
    return F.count(F.when(when, 1))


def share(part: Column, of: Column) -> Column:
    """count of part / count of of, null if of never holds."""
    return count_if(part & of) / F.nullif(count_if(of), F.lit(0))


def by_groups(df: DataFrame, sets: list[list[str]], **aggs: Column) -> DataFrame:
    """One aggregate over several groupings; columns that a grouping leaves out are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    return out.agg(*[a.alias(k) for k, a in aggs.items()])


def vqa_report(df: DataFrame) -> DataFrame:
    """Closed accuracy and open scores by tag, and by tag and modality, of (tag, modality, closed, closed_score, em, recall, f1)."""
    c = F.col("closed")
    return by_groups(
        df, [["tag"], ["tag", "modality"]], n_closed=count_if(c), n_open=count_if(~c), closed_acc=mean_if(F.col("closed_score"), c),
        open_em=mean_if(F.col("em"), ~c), open_recall=mean_if(F.col("recall"), ~c), open_f1=mean_if(F.col("f1"), ~c),
    )


def yes_no_bias(df: DataFrame) -> DataFrame:
    """Counts and flips of folded yes/no answers by tag of (tag, gold, pred)."""
    g, p = F.col("gold"), F.col("pred")
    return df.groupBy("tag").agg(
        count_if(g == "yes").alias("gold_yes"), count_if(g == "no").alias("gold_no"), count_if(p == "yes").alias("pred_yes"), count_if(p == "no").alias("pred_no"),
        count_if((g == "no") & (p == "yes")).alias("no_to_yes"), count_if((g == "yes") & (p == "no")).alias("yes_to_no"), (100.0 * count_if(p == "yes") / F.count("*")).alias("yes_pct"),
    )


def label_scores(df: DataFrame, labels: list[str]) -> DataFrame:
    """tag, label, precision, recall, f1 over a fixed list of labels; one that does not occur counts 0."""
    cells = df.groupBy("tag", "gold", "pred").agg(F.count("*").alias("n"))
    each = cells.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    g, p = F.col("gold") == F.col("label"), F.col("pred") == F.col("label")
    sums = each.groupBy("tag", "label").agg(total(g & p).alias("tp"), total(p).alias("p"), total(g).alias("g"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return sums.select("tag", "label", ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("g")).alias("recall"), ratio(2 * F.col("tp"), F.col("p") + F.col("g")).alias("f1"))


def label_table(df: DataFrame, labels: list[str]) -> DataFrame:
    """label_scores with n_gold, n_pred, n_right: how often a label is the truth, is said, and is said rightly."""
    each = df.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    g, p = F.col("gold") == F.col("label"), F.col("pred") == F.col("label")
    n = each.groupBy("tag", "label").agg(count_if(g).alias("n_gold"), count_if(p).alias("n_pred"), count_if(g & p).alias("n_right"))
    return label_scores(df, labels).join(n, ["tag", "label"])


def answer_flips(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """gold, old, new, n: items (key) whose answer differs between two tags."""
    a = df.filter(F.col("tag") == before).select(key, "gold", F.col("pred").alias("old"))
    b = df.filter(F.col("tag") == after).select(key, F.col("pred").alias("new"))
    return a.join(b, key).filter("old <> new").groupBy("gold", "old", "new").agg(F.count("*").alias("n"))


def letter_histograms(df: DataFrame) -> DataFrame:
    """tag, letter, n_gold, n_pred of (tag, gold, pred); an unread answer is the empty letter."""
    sides = F.array(F.struct(F.col("gold").alias("letter"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("letter"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    return df.select("tag", F.inline(sides)).groupBy("tag", "letter").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))


def macro_f1(df: DataFrame, labels: list[str]) -> DataFrame:
    """tag, macro_f1, accuracy."""
    scores = label_scores(df, labels).groupBy("tag").agg(F.avg("f1").alias("macro_f1"))
    return scores.join(df.groupBy("tag").agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy")), "tag")


def choice_report(df: DataFrame) -> DataFrame:
    """Accuracy and unread answers by tag, and by tag and category, of (tag, category, gold, pred)."""
    return by_groups(df, [["tag"], ["tag", "category"]], n=F.count("*"), accuracy=F.avg((F.col("gold") == F.col("pred")).cast("double")), unparsed=count_if(F.col("pred") == ""))


def screen_report(df: DataFrame) -> DataFrame:
    """tp, fn, tn, fp of (label 0/1, closed yes/no/other); an unread positive is missed, an unread negative is neither."""
    pos, yes, no = F.col("label") == 1, F.col("closed") == "yes", F.col("closed") == "no"
    cells = df.agg(count_if(pos & yes).alias("tp"), count_if(pos & ~yes).alias("fn"), count_if(~pos & no).alias("tn"), count_if(~pos & yes).alias("fp"), count_if(~yes & ~no).alias("unparsed"), F.count("*").alias("n"))
    part = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    return cells.select("*", ((c("tp") + c("tn")) / c("n")).alias("accuracy"), part(c("tp"), c("tp") + c("fn")).alias("sensitivity"), part(c("tn"), c("tn") + c("fp")).alias("specificity"), ((c("tp") + c("fp")) / c("n")).alias("yes_rate"))


def omission_report(df: DataFrame) -> DataFrame:
    """Shares without a reported finding among diseased and normal items, their difference, and contradictions; of (label, closed, reports)."""
    pos, silent = F.col("label") == 1, ~F.col("reports")
    out = df.agg(share(silent, pos).alias("missed"), share(silent, ~pos).alias("quiet_normal"), count_if((F.col("closed") == "yes") & silent).alias("contradictions"))
    return out.withColumn("discrimination", F.col("quiet_normal") - F.col("missed"))


def film_group(findings: list[Column], normal: Column) -> Column:
    """abnormal if any finding is 1, else normal if so labelled, else uncertain_only."""
    return F.when(F.exists(F.array(*findings), lambda v: v == 1.0), "abnormal").when(normal == 1.0, "normal").otherwise("uncertain_only")


def labeler_agreement(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Agreement and recovered positives by finding and over all (finding null) of two labelings."""
    other = b.select(key, *[F.col(k).alias(f"_{k}") for k in columns])
    cells = F.array(*[F.struct(F.lit(k).alias("finding"), F.col(k).alias("value"), F.col(f"_{k}").alias("other")) for k in columns])
    # the wide rows are joined once and only then taken apart
    both = a.join(other, key).select(F.inline(cells))
    same, pos = F.col("value").eqNullSafe(F.col("other")), F.col("value") == 1.0
    return both.rollup("finding").agg(F.count("*").alias("n"), (100.0 * F.avg(same.cast("double"))).alias("agreement"), (100.0 * share(F.coalesce(F.col("other") == 1.0, F.lit(False)), F.coalesce(pos, F.lit(False)))).alias("recovered"))


#: Rows of a part of a sorted table.
PART_ROWS = 500_000


def range_parts(df: DataFrame, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """df, stored, with _part: rows in the order of columns, cut into parts of about part_rows rows.

    The cuts are splitters that Spark samples from the rows themselves, so parts are even however the values lie. df is stored
    before, for its size, and after, so that all that follows sees the same parts.
    """
    x = stored(df)
    n = max(1, -(-x.count() // part_rows))
    return stored(x.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def part_offsets(x: DataFrame, group: list[str], weight: Column) -> DataFrame:
    """x with _before and _all: the weight of its group in earlier parts and in all."""
    w = W.partitionBy(*[f"_of_{g}" for g in group])  # a row for each part that a group is in
    sizes = x.groupBy(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_part").alias("_of_part")).agg(F.sum(weight).alias("_weight"))
    before = F.sum("_weight").over(w.orderBy("_of_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_weight")
    sizes = sizes.withColumns({"_before": before, "_all": F.sum("_weight").over(w)}).drop("_weight")
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    return x.join(sizes, reduce(lambda a, b: a & b, same, F.col("_part") == F.col("_of_part"))).drop("_of_part", *[f"_of_{g}" for g in group])


def numbered(df: DataFrame, group: list[str], order: list[str], number: str, size: str, part_rows: int = PART_ROWS) -> DataFrame:
    """df with each row's number from 1 in its group's order, and the group's size; no group is one task."""
    x = part_offsets(range_parts(df, [*group, *order], part_rows), group, F.lit(1))
    inside = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))
    return x.withColumn(number, F.col("_before") + inside).withColumnRenamed("_all", size).drop("_before", "_part")


def order_statistics(df: DataFrame, group: list[str], value: str, part_rows: int = PART_ROWS, **places: Column) -> DataFrame:
    """Order statistics of value by group: places are 0-based ranks as columns of the group's size n.

    Values are counted first; the distinct ones are cut into even parts, the parts' sizes give each its offset, and running counts are
    taken inside a part. So a table of two or three groups is still many tasks, whatever its values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    x = part_offsets(range_parts(counts, [*group, value], part_rows), group, F.col("_c")).withColumnRenamed("_all", "n")
    inside = F.sum("_c").over(W.partitionBy(*group, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("_to", F.col("_before") + inside)
    at = lambda p: (p < F.col("_to")) & (p >= F.col("_to") - F.col("_c"))
    mean = F.sum(F.col(value) * F.col("_c")) / F.sum("_c")
    return x.groupBy(*group).agg(*[F.max(F.when(at(p), F.col(value))).alias(k) for k, p in places.items()], F.max("n").alias("n"), mean.alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def score_summary(df: DataFrame, value: str) -> DataFrame:
    """n, mean, standard deviation, extremes and interpolated quartiles."""
    ranks = {f"{k}_{end}": f((F.col("n") - 1) * p) for k, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)) for end, f in (("lo", F.floor), ("hi", F.ceil))}
    places = order_statistics(df, [], value, **ranks)
    between = lambda k, p: (F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p))).alias(k)
    # two tables of one row
    x = places.drop("mean").join(df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")))
    return x.select("n", "mean", "std", "min", "max", between("q25", 0.25), between("q50", 0.5), between("q75", 0.75))


def selection_stats(df: DataFrame, group: list[str], score: str, section: Column, words: Column) -> DataFrame:
    """group, n, mean, min, median (the upper one), max of a score, section_pct: rows with a section, and mean_words, of each selection."""
    scores = order_statistics(df, group, score, median=F.floor(F.col("n") / 2))
    more = df.groupBy(*group).agg((100.0 * F.avg(section.cast("int"))).alias("section_pct"), F.avg(words).alias("mean_words"))
    return scores.join(more, group)


def train_curve(df: DataFrame, by: tuple[str, ...] = ("tag",)) -> DataFrame:
    """Mean loss of the first and the last tenth of the steps, and the last step, of (tag, step, total, loss) by tag, or by tag and series."""
    total = df.groupBy(*by).agg(F.max_by("total", "step").alias("_total"), F.max("step").alias("last_step"))
    x = df.join(total, list(by))
    return x.groupBy(*by, "last_step").agg(mean_if(F.col("loss"), F.col("step") <= 0.1 * F.col("_total")).alias("first_loss"), mean_if(F.col("loss"), F.col("step") > 0.9 * F.col("_total")).alias("last_loss"))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows by the first step that drops them; kept if none does."""
    reason = F.coalesce(*[F.when(c, F.lit(name)) for name, c in steps], F.lit("kept"))
    return df.groupBy(reason.alias("step")).agg(F.count("*").alias("n"))


def token_weighted_loss(df: DataFrame, loss: str, n: str) -> DataFrame:
    """The mean loss over tokens rather than batches."""
    return df.agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"), F.sum(n).alias("tokens"))


def rescore(df: DataFrame, old: Column, new: Column) -> DataFrame:
    """tag, old, new, delta: mean scores of stored answers under two rules."""
    return df.groupBy("tag").agg(F.avg(old).alias("old"), F.avg(new).alias("new")).withColumn("delta", F.col("new") - F.col("old"))


def film_report(df: DataFrame) -> DataFrame:
    """Answers, reports and contradictions by group of (grp, closed, reports, lung)."""
    yes = F.col("closed") == "yes"
    return df.groupBy("grp").agg(
        F.count("*").alias("n"), *[count_if(F.col("closed") == k).alias(k) for k in ("yes", "no", "other")], count_if(F.col("reports")).alias("reports"), count_if(F.col("lung")).alias("lung"),
        count_if(yes & ~F.col("reports")).alias("contradictions"), (100.0 * count_if(~F.col("reports")) / F.count("*")).alias("missed_pct"),
    )


def film_summary(df: DataFrame) -> DataFrame:
    """One row of (grp, closed, reports, lung): what the answers and the descriptions find and miss, in per cent; null where a group is empty."""
    a, n, u = (F.col("grp") == k for k in ("abnormal", "normal", "uncertain_only"))
    yes, no = F.col("closed") == "yes", F.col("closed") == "no"
    pct = lambda part, of: 100.0 * share(part, of)
    out = df.agg(
        pct(yes, a).alias("sensitivity"), pct(no, n).alias("specificity"), count_if(a & ~yes).alias("missed"), pct(~yes, a).alias("missed_pct"), count_if(~yes & ~no).alias("unparsed"), pct(yes, u).alias("uncertain_yes_pct"),
        pct(~F.col("reports"), a).alias("quiet_abnormal_pct"), pct(~F.col("lung"), a).alias("quiet_lung_pct"), pct(~F.col("reports"), n).alias("quiet_normal_pct"), pct(~F.col("reports"), a & yes).alias("contradiction_pct"),
    )
    return out.withColumn("discrimination", F.col("quiet_normal_pct") - F.col("quiet_abnormal_pct"))


def per_finding_report(df: DataFrame, findings: list[str]) -> DataFrame:
    """finding, n, yes_pct, reports_pct; a film with several findings counts in each."""
    found = F.filter(F.array(*[F.when(F.col(k) == 1, k) for k in findings]), lambda x: x.isNotNull())
    each = df.select("closed", "reports", F.explode(found).alias("finding"))
    return each.groupBy("finding").agg(F.count("*").alias("n"), (100.0 * F.avg((F.col("closed") == "yes").cast("int"))).alias("yes_pct"), (100.0 * F.avg(F.col("reports").cast("int"))).alias("reports_pct"))


def judge_report(df: DataFrame) -> DataFrame:
    """By group, and over all (grp null), of (grp, closed, first, second): first and second say whether two judges find anything in a description.

    n, flagged_pct and none_pct of the second judge, yes answers whose description it finds empty, the first judge's none_pct, and their agreement.
    """
    empty = ~F.col("second")
    return by_groups(
        df, [["grp"], []], n=F.count("*"), flagged_pct=100.0 * F.avg(F.col("second").cast("int")), none_pct=100.0 * F.avg(empty.cast("int")), contradictions=count_if((F.col("closed") == "yes") & empty),
        contradiction_pct=100.0 * share(empty, F.col("closed") == "yes"), first_none_pct=100.0 * F.avg((~F.col("first")).cast("int")), agreement=100.0 * F.avg((F.col("first") == F.col("second")).cast("int")),
    )


def judge_findings(truth: DataFrame, judged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """finding, n, positive_pct, pos_or_uncertain_pct, negative_pct: what a judge's labels make of the films that truly have a finding."""
    other = judged.select(key, *[F.col(k).alias(f"_{k}") for k in columns])
    cells = F.array(*[F.struct(F.lit(k).alias("finding"), F.col(k).alias("value"), F.col(f"_{k}").alias("said")) for k in columns])
    own = truth.join(other, key).select(F.inline(cells)).filter("value = 1.0")
    pct = lambda *values: 100.0 * F.avg(F.coalesce(F.col("said").isin(*values), F.lit(False)).cast("int"))
    return own.groupBy("finding").agg(F.count("*").alias("n"), pct(1.0).alias("positive_pct"), pct(1.0, -1.0).alias("pos_or_uncertain_pct"), pct(0.0).alias("negative_pct"))


def polarity_audit(df: DataFrame) -> DataFrame:
    """Answers, distinct questions and images by kind of (kind, q, img)."""
    return df.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("q").alias("questions"), F.count_distinct("img").alias("images"))


def image_verdicts(df: DataFrame) -> DataFrame:
    """verdict, n: images by whether a question says that they are abnormal, else that they are normal, or neither; of (img, kind)."""
    abnormal, normal = F.bool_or(F.col("kind").isin("pos_global", "pos_specific")), F.bool_or(F.col("kind") == "neg_global")
    verdict = F.when(abnormal, "abnormal").when(normal, "normal").otherwise("no_finding_question")
    return df.groupBy("img").agg(verdict.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def frequent_questions(df: DataFrame, kind: str = "neg_specific") -> DataFrame:
    """q, n: the questions of a kind, the most frequent first."""
    return df.filter(F.col("kind") == kind).groupBy(F.trim("q").alias("q")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "q")


def elsewhere_flag(df: DataFrame) -> DataFrame:
    """item, elsewhere: a named disease that an image is said not to have, but another answer of the image names; of (item, img, q, a, kind)."""
    x = df.withColumn("disease", F.lower(F.regexp_extract("q", "Can (.+?) be observed", 1)))
    # the answers of an image other than yes and no, each once
    said = x.withColumn("a", F.lower(F.trim("a"))).filter("a not in ('yes', 'no')").groupBy("img").agg(F.array_join(F.array_sort(F.collect_set("a")), "|").alias("said"))
    y = x.filter("kind = 'neg_specific'").join(said, "img", "left")
    return y.select("item", ((F.col("disease") != "") & F.contains(F.coalesce("said", F.lit("")), F.col("disease"))).alias("elsewhere"))


def entity_abnormal(df: DataFrame) -> DataFrame:
    """img, abnormal: whether any closed answer of an image says so; "healthy" is looked for anywhere in the question. Of (img, q, a)."""
    a = F.lower(F.trim("a"))
    healthy = F.contains(F.lower("q"), F.lit("healthy"))
    return df.filter(a.isin("yes", "no")).groupBy("img").agg(F.bool_or(F.when(healthy, a == "no").otherwise(a == "yes")).alias("abnormal"))


def style_stats(df: DataFrame, text: str) -> DataFrame:
    """Mean words, share of very short and of refusing texts, mean share of distinct pairs."""
    w = latin_tokens(F.col(text))
    x = df.select(F.size(w).alias("n"), F.col(text).rlike(REFUSAL).cast("int").alias("r"), distinct2(w).alias("d"))
    return x.agg(F.avg("n").alias("mean_words"), (100.0 * F.avg((F.col("n") < 5).cast("int"))).alias("short_pct"), (100.0 * F.avg("r")).alias("refusal_pct"), F.avg("d").alias("distinct2"))


def accuracy_by_type(df: DataFrame, types: list[str], correct: Column, least: int = 20) -> DataFrame:
    """Groups of at least so many items, largest first, with their accuracy."""
    return df.groupBy(*types).agg(F.count("*").alias("n"), F.avg(correct.cast("int")).alias("accuracy")).filter(F.col("n") >= least).orderBy(F.desc("n"), *types)
