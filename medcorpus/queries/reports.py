"""Queries of reports, vectors, resampling and comparison."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from medcorpus.functions import scoring as S
from medcorpus.operators import compare as X
from medcorpus.operators import reports as A
from medcorpus.operators import resample as R
from medcorpus.operators import vectors as V
from medcorpus.plans import jobs
from medcorpus.queries.base import CAPTIONS, CLS, LABELS, LOG, MCQ, PAIRS, REPORTS, SCREEN, VQA, _labels14, query, sql_h, sql_labels14, with_
from medcorpus.queries.cleaning import CHOICES, D2, KIND, NORM, PARSED, POLARITY, SCORED, YES_NO, choices, parsed, polarity, scored

c = F.col
FIVE = LABELS[:5]


def rounded(df, *cols, digits=6):
    return df.withColumns({k: F.round(k, digits) for k in cols})


@query(with_(VQA, SCORED) + """select tag, modality, count(*) filter (where closed) as n_closed, count(*) filter (where not closed) as n_open, round(avg(closed_score) filter (where closed), 6) as closed_acc, round(avg(em) filter (where not closed), 6) as open_em,
    round(avg(recall) filter (where not closed), 6) as open_recall, round(avg(f1) filter (where not closed), 6) as open_f1 from scored group by grouping sets ((tag), (tag, modality))""")
def a1_vqa_report(t):
    return rounded(A.vqa_report(scored(t)), "closed_acc", "open_em", "open_recall", "open_f1")


@query(with_(VQA, SCORED) + "select tag, round(avg((pred = gold)::int), 6) as old, round(avg(em), 6) as new, round(avg(em) - avg((pred = gold)::int), 6) as delta from scored group by tag")
def a2_rescore(t):
    return rounded(A.rescore(scored(t), (c("pred") == c("gold")).cast("int"), c("em")), "old", "new", "delta")


@query(with_(VQA) + f""", f as (select tag, {YES_NO('g')} gold, {YES_NO('p')} pred from (select tag, {NORM('gold')} g, {NORM('pred')} p from vqa where closed)) select tag, count(*) filter (where gold = 'yes') as gold_yes, count(*) filter (where gold = 'no') as gold_no,
    count(*) filter (where pred = 'yes') as pred_yes, count(*) filter (where pred = 'no') as pred_no, count(*) filter (where gold = 'no' and pred = 'yes') as no_to_yes, count(*) filter (where gold = 'yes' and pred = 'no') as yes_to_no, round(100.0 * count(*) filter (where pred = 'yes') / count(*), 6) as yes_pct from f group by tag""")
def a3_yes_no_bias(t):
    x = t.vqa.filter("closed").select("tag", S.yes_no(c("gold")).alias("gold"), S.yes_no(c("pred")).alias("pred"))
    return rounded(A.yes_no_bias(x), "yes_pct")


NAMES = ("yes", "no", "maybe")


@query(with_(CLS, PARSED) + """, s as (select tag, label, case when sum((pred = label)::int) + sum((gold = label)::int) > 0 then 2.0 * sum((pred = label and gold = label)::int) / (sum((pred = label)::int) + sum((gold = label)::int)) else 0 end f1 from parsed, unnest(['yes', 'no', 'maybe']) l(label) group by all)
    select tag, round(avg(f1), 6) as macro_f1, round((select avg((p.pred = p.gold)::int) from parsed p where p.tag = s.tag), 6) as accuracy from s group by tag""")
def a4_macro_f1(t):
    return rounded(A.macro_f1(parsed(t), list(NAMES)), "macro_f1", "accuracy")


@query(with_(CLS, PARSED) + """, e as (select tag, label, sum((pred = label and gold = label)::int)::bigint n_right, sum((pred = label)::int)::bigint n_pred, sum((gold = label)::int)::bigint n_gold from parsed, unnest(['yes', 'no', 'maybe']) l(label) group by all)
    select *, round(case when n_pred > 0 then n_right / n_pred else 0 end, 6) as precision, round(case when n_gold > 0 then n_right / n_gold else 0 end, 6) as recall, round(case when n_pred + n_gold > 0 then 2 * n_right / (n_pred + n_gold) else 0 end, 6) as f1 from e""")
def a4_label_table(t):
    return rounded(A.label_table(parsed(t), list(NAMES)), "precision", "recall", "f1")


@query(with_(CLS, PARSED) + "select x.gold, x.pred as old, y.pred as new, count(*) as n from parsed x join parsed y using (item) where x.tag = 'base' and y.tag = 'tuned' and x.pred <> y.pred group by all")
def a4_answer_flips(t):
    return A.answer_flips(parsed(t), "item", "base", "tuned")


@query(with_(MCQ, CHOICES) + "select tag, letter, sum(g)::bigint as n_gold, sum(p)::bigint as n_pred from (select tag, gold letter, 1 g, 0 p from choices union all select tag, pred, 0, 1 from choices) group by all")
def a5_letter_histograms(t):
    return A.letter_histograms(choices(t))


@query(with_(MCQ, CHOICES) + "select tag, category, count(*) as n, round(avg((gold = pred)::int), 6) as accuracy, count(*) filter (where pred = '') as unparsed from choices group by grouping sets ((tag), (tag, category))")
def a5_choice_report(t):
    return rounded(A.choice_report(choices(t)), "accuracy")


@query(with_(SCREEN) + """, x as (select count(*) filter (where label = 1 and closed = 'yes') tp, count(*) filter (where label = 1 and closed <> 'yes') fn, count(*) filter (where label = 0 and closed = 'no') tn, count(*) filter (where label = 0 and closed = 'yes') fp,
    count(*) filter (where closed = 'unclear') unparsed, count(*) n from screen) select *, round((tp + tn) / n, 6) as accuracy, round(tp / nullif(tp + fn, 0), 6) as sensitivity, round(tn / nullif(tn + fp, 0), 6) as specificity, round((tp + fp) / n, 6) as yes_rate from x""")
def a6_binary_screen_report(t):
    return rounded(A.screen_report(t.screen), "accuracy", "sensitivity", "specificity", "yes_rate")


@query(with_(SCREEN) + """, x as (select round(avg((not found)::int) filter (where label = 1), 6) as missed, round(avg((not found)::int) filter (where label = 0), 6) as quiet_normal, count(*) filter (where closed = 'yes' and not found) as contradictions from screen)
    select *, round(quiet_normal - missed, 4) as discrimination from x""")
def a7_omission_report(t):
    x = A.omission_report(t.screen.withColumn("reports", S.reports_any(c("desc"))))
    return rounded(rounded(x, "missed", "quiet_normal"), "discrimination", digits=4)


GROUP = "case when f1 = 1 or f2 = 1 or f3 = 1 or f4 = 1 or f5 = 1 then 'abnormal' when nofinding = 1 then 'normal' else 'uncertain_only' end"


def _films(t):
    """Films with their group, a yes/no answer and whether the description reports anything."""
    from medcorpus.queries.base import h

    x = t.labels14.withColumn("grp", A.film_group([c(k) for k in FIVE], c("nofinding")))
    n = h("a", c("path")) % 10
    return x.withColumn("closed", F.when(n < 5, "yes").when(n < 9, "no").otherwise("other")).withColumn("reports", h("b", c("path")) % 3 > 0).withColumn("lung", c("reports") & (h("u", c("path")) % 2 == 0))


FILMS = f"{sql_labels14('l14')}, films as (select *, {GROUP} grp, case when {sql_h(repr('a'), 'path')} % 10 < 5 then 'yes' when {sql_h(repr('a'), 'path')} % 10 < 9 then 'no' else 'other' end closed, {sql_h(repr('b'), 'path')} % 3 > 0 reports, {sql_h(repr('b'), 'path')} % 3 > 0 and {sql_h(repr('u'), 'path')} % 2 = 0 lung from l14)"


@query(with_(FILMS) + "select grp, count(*) as n from films group by grp")
def a8_film_group(t):
    return _films(t).groupBy("grp").agg(F.count("*").alias("n"))


@query(with_(FILMS) + "select grp, count(*) as n, count(*) filter (where closed = 'yes') as yes, count(*) filter (where closed = 'no') as no, count(*) filter (where closed = 'other') as other, count(*) filter (where reports) as reports, count(*) filter (where lung) as lung, count(*) filter (where closed = 'yes' and not reports) as contradictions, round(100.0 * count(*) filter (where not reports) / count(*), 6) as missed_pct from films group by grp")
def a9_film_report(t):
    return rounded(A.film_report(_films(t)), "missed_pct")


def _pct(part: str, of: str) -> str:
    return f"100.0 * count(*) filter (where ({part}) and ({of})) / nullif(count(*) filter (where {of}), 0)"


AB, NO_, UN = "grp = 'abnormal'", "grp = 'normal'", "grp = 'uncertain_only'"
SUMMARY = {
    "sensitivity": _pct("closed = 'yes'", AB), "specificity": _pct("closed = 'no'", NO_), "missed_pct": _pct("closed <> 'yes'", AB), "uncertain_yes_pct": _pct("closed = 'yes'", UN), "quiet_abnormal_pct": _pct("not reports", AB),
    "quiet_lung_pct": _pct("not lung", AB), "quiet_normal_pct": _pct("not reports", NO_), "contradiction_pct": _pct("not reports", f"{AB} and closed = 'yes'"), "discrimination": f"{_pct('not reports', NO_)} - {_pct('not reports', AB)}",
}


@query(with_(FILMS) + "select count(*) filter (where " + AB + " and closed <> 'yes') as missed, count(*) filter (where closed = 'other') as unparsed, " + ", ".join(f"round({v}, 6) as {k}" for k, v in SUMMARY.items()) + " from films")
def a9_film_summary(t):
    return rounded(A.film_summary(_films(t)), *SUMMARY)


@query(with_(FILMS) + "select finding, count(*) as n, round(100.0 * avg((closed = 'yes')::int), 6) as yes_pct, round(100.0 * avg(reports::int), 6) as reports_pct from (select closed, reports, unnest(list_filter([case when f1 = 1 then 'f1' end, case when f2 = 1 then 'f2' end, case when f3 = 1 then 'f3' end, case when f4 = 1 then 'f4' end, case when f5 = 1 then 'f5' end], lambda x: x is not null)) finding from films) group by finding")
def a10_per_finding_report(t):
    return rounded(A.per_finding_report(_films(t), list(FIVE)), "yes_pct", "reports_pct")


BOTH = f"{sql_labels14('la')}, {sql_labels14('lb', 'z')}, both2 as (select finding, a, b from (" + " union all ".join(f"select path, '{k}' finding, la.{k} a, lb.{k} b from la join lb using (path)" for k in LABELS) + "))"


@query("with " + BOTH + " select finding, count(*) as n, round(100.0 * avg((a is not distinct from b)::int), 6) as agreement, round(100.0 * count(*) filter (where a = 1 and b = 1) / nullif(count(*) filter (where a = 1), 0), 6) as recovered from both2 group by grouping sets ((), (finding))")
def a11_labeler_agreement(t):
    return rounded(A.labeler_agreement(t.labels14, _labels14(t, "z"), "path", list(LABELS)), "agreement", "recovered")


@query("with " + FILMS + f", {sql_labels14('lb', 'z')}, x as (select films.*, coalesce(lb.f1 in (1, -1) or lb.f2 in (1, -1), false) said from films join lb using (path))" + """ select grp, count(*) as n, round(100.0 * avg(said::int), 6) as flagged_pct, round(100.0 * avg((not said)::int), 6) as none_pct, count(*) filter (where closed = 'yes' and not said) as contradictions,
    round(100.0 * count(*) filter (where closed = 'yes' and not said) / nullif(count(*) filter (where closed = 'yes'), 0), 6) as contradiction_pct, round(100.0 * avg((not reports)::int), 6) as first_none_pct, round(100.0 * avg((said = reports)::int), 6) as agreement from x group by grouping sets ((grp), ())""")
def a12_judge_report(t):
    said = F.coalesce(c("f1").isin(1.0, -1.0) | c("f2").isin(1.0, -1.0), F.lit(False))
    x = _films(t).join(_labels14(t, "z").select("path", said.alias("second")), "path").withColumnRenamed("reports", "first")
    return rounded(A.judge_report(x), "flagged_pct", "none_pct", "contradiction_pct", "first_none_pct", "agreement")


@query("with " + BOTH + " select finding, count(*) as n, round(100.0 * avg(coalesce(b = 1, false)::int), 6) as positive_pct, round(100.0 * avg(coalesce(b in (1, -1), false)::int), 6) as pos_or_uncertain_pct, round(100.0 * avg(coalesce(b = 0, false)::int), 6) as negative_pct from both2 where a = 1 group by finding")
def a12_judge_findings(t):
    return rounded(A.judge_findings(t.labels14, _labels14(t, "z"), "path", list(LABELS)), "positive_pct", "pos_or_uncertain_pct", "negative_pct")


@query(with_(POLARITY) + f"select {KIND} as kind, count(*) as n, count(distinct q) as questions, count(distinct img) as images from polarity group by 1")
def a13_polarity_audit(t):
    return A.polarity_audit(polarity(t))


@query(with_(POLARITY) + f""", k as (select img, {KIND} kind from polarity), v as (select img, case when bool_or(kind in ('pos_global', 'pos_specific')) then 'abnormal' when bool_or(kind = 'neg_global') then 'normal' else 'no_finding_question' end verdict from k group by img) select verdict, count(*) as n from v group by verdict""")
def a13_image_verdicts(t):
    return A.image_verdicts(polarity(t))


@query(with_(POLARITY) + f"select trim(q) as q, count(*) as n from polarity where {KIND} = 'neg_specific' group by 1")
def a13_frequent_questions(t):
    return A.frequent_questions(polarity(t))


@query(with_(POLARITY) + f""", k as (select item, img, lower(trim(a)) a, case when q like 'Can % be observed?' then substr(q, 5, length(q) - 17) else '' end disease, {KIND} kind from polarity), said as (select distinct img, a from k where a not in ('yes', 'no'))
    select item, disease <> '' and exists (select 1 from said where said.img = k.img and contains(said.a, lower(disease))) as elsewhere from k where kind = 'neg_specific'""")
def a14_elsewhere_flag(t):
    return A.elsewhere_flag(polarity(t))


@query(with_(POLARITY) + "select img, bool_or(case when contains(lower(q), 'healthy') then lower(trim(a)) = 'no' else lower(trim(a)) = 'yes' end) as abnormal from polarity where lower(trim(a)) in ('yes', 'no') and ct = 'Abnormality' group by img")
def a15_entity_abnormal(t):
    return A.entity_abnormal(polarity(t).filter("ct = 'Abnormality'"))


@query(with_(D2) + r"select round(avg(len(w)), 6) as mean_words, round(100.0 * avg((len(w) < 5)::int), 6) as short_pct, round(100.0 * avg(regexp_matches(text, '(?i)\b(unanswerable|cannot|can''t|unable|not possible|no image|sorry)\b')::int), 6) as refusal_pct, round(avg(d), 6) as distinct2 from d2")
def a16_style_stats(t):
    return rounded(A.style_stats(t.documents, "text"), "mean_words", "short_pct", "refusal_pct", "distinct2")


@query("select count(l_discount) as n, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std, min(l_extendedprice) as min, max(l_extendedprice) as max, round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.75), 4) as q75 from lineitem")
def a17_score_summary(t):
    return rounded(A.score_summary(t.lineitem, "l_extendedprice"), "mean", "std", "q25", "q50", "q75", digits=4)


@query("with r as (select l_returnflag, l_extendedprice v, l_discount d, l_quantity q, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 rn, count(*) over (partition by l_returnflag) n from lineitem) select l_returnflag, n, max(v) filter (where rn = n // 2) as median, round(avg(v), 4) as mean, min(v) as min, max(v) as max, round(100.0 * avg((d > 0)::int), 4) as section_pct, round(avg(q), 4) as mean_words from r group by all")
def a18_selection_stats(t):
    x = A.selection_stats(t.lineitem, ["l_returnflag"], "l_extendedprice", c("l_discount") > 0, c("l_quantity"))
    return rounded(x, "mean", "section_pct", "mean_words", digits=4)


@query("with r as (select lang, len(string_split(text, ' ')) v, row_number() over (partition by lang order by len(string_split(text, ' '))) - 1 rn, count(*) over (partition by lang) n from documents) select lang, n, max(v) filter (where rn = n // 2) as median, max(v) filter (where rn = n * 9 // 10) as p90, round(avg(v), 6) as mean, min(v) as min, max(v) as max from r group by all")
def a19_length_profile(t):
    x = t.documents.select("lang", F.size(F.split("text", " ")).alias("v"))
    return rounded(A.order_statistics(x, ["lang"], "v", median=F.floor(c("n") / 2), p90=F.floor(c("n") * 9 / 10)), "mean")


@query(with_(LOG) + "select tag, max(step) as last_step, round(avg(loss) filter (where step <= 0.1 * total), 6) as first_loss, round(avg(loss) filter (where step > 0.9 * total), 6) as last_loss from log group by tag")
def a20_train_curve_summary(t):
    return rounded(A.train_curve(t.log), "first_loss", "last_loss")


@query(with_(LOG) + ", s as (select *, case when step % 5 = 0 then 'validation' else 'train' end series from log), e as (select tag, series, max(step) last_step, max_by(total, step) t from s group by all) select tag, series, last_step, round(avg(loss) filter (where step <= 0.1 * t), 6) as first_loss, round(avg(loss) filter (where step > 0.9 * t), 6) as last_loss from s join e using (tag, series) group by all")
def a20_train_and_validation_curves(t):
    x = t.log.withColumn("series", F.when(c("step") % 5 == 0, "validation").otherwise("train"))
    return rounded(A.train_curve(x, ("tag", "series")), "first_loss", "last_loss")


@query(with_(VQA) + "select content, closed, count(*) as n, round(avg((gold = pred)::int), 6) as accuracy from vqa group by all having count(*) >= 20")
def a21_accuracy_by_type(t):
    return rounded(A.accuracy_by_type(t.vqa, ["content", "closed"], c("gold") == c("pred")), "accuracy")


@query(with_(REPORTS) + "select case when not frontal then 'not_frontal' when regexp_replace(findings, '^\\s+|\\s+$', '', 'g') = '' and regexp_replace(impression, '^\\s+|\\s+$', '', 'g') = '' then 'empty' when patient % 10 = 0 then 'excluded' else 'kept' end as step, count(*) as n from reports group by 1")
def a22_funnel_counts(t):
    empty = (F.trim("findings") == "") & (F.trim("impression") == "")
    return A.funnel(t.reports, [("not_frontal", ~c("frontal")), ("empty", empty), ("excluded", c("patient") % 10 == 0)])


@query("select round(sum(l_discount * l_quantity) / sum(l_quantity), 8) as loss, sum(l_quantity) as tokens from lineitem")
def a23_token_weighted_loss(t):
    return rounded(A.token_weighted_loss(t.lineitem, "l_discount", "l_quantity"), "loss", digits=8)


@query(with_(PAIRS) + "select id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])), 6) as score from pairs")
def v1_pair_score(t):
    return t.pairs.select("id", F.round(V.dot(c("a"), c("b")), 6).alias("score"))


@query(with_(PAIRS) + """, s as (select x.id i, y.id j, list_dot_product(x.a, y.b) s from pairs x, pairs y), d as (select i, s from s where i = j), r as (select d.i, count(*) filter (where s.s > d.s + 1e-12 and s.j <> d.i) ab from d join s on s.i = d.i group by 1), q as (select d.i, count(*) filter (where s.s > d.s + 1e-12 and s.i <> d.i) ba from d join s on s.j = d.i group by 1)
    select count(*) as n, round(avg((ab < 1)::int), 6) as ab_r1, round(avg((ab < 5)::int), 6) as ab_r5, round(avg((ab < 10)::int), 6) as ab_r10, round(avg((ba < 1)::int), 6) as ba_r1, round(avg((ba < 5)::int), 6) as ba_r5, round(avg((ba < 10)::int), 6) as ba_r10, round(1.0 / count(*), 6) as chance from r join q using (i)""")
def v2_retrieval_recall(t):
    x = V.recall_at(V.retrieval_ranks(t.pairs))
    return rounded(x, *[k for k in x.columns if k != "n"])


@query(with_(PAIRS) + "select (select count(*) from pairs) as n, round(avg(list_dot_product(x.a, y.b)), 6) as mean from pairs x, pairs y where x.id <> y.id")
def v3_mismatched_mean(t):
    return rounded(V.mismatched_mean(t.pairs), "mean")


CIDER = """, side as (select item, -1 ref, regexp_extract_all(lower(pred), '[a-z0-9]+') t from captions union all select item, k - 1, regexp_extract_all(lower(refs[k]), '[a-z0-9]+') from (select item, refs, unnest(range(1, len(refs) + 1)) k from captions)),
    lens as (select item, ref, len(t) l from side), g as (select item, ref, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i+n-1], ' '))) g from side, range(1, 5) r(n) where len(t) >= n), tf as (select item, ref, n, g, count(*) tf from g group by all),
    df as (select n, g, count(distinct item) df from tf where ref >= 0 group by all), v as (select item, ref, n, g, tf * (ln((select count(*) from captions)) - ln(greatest(1, coalesce(df, 0)))) w from tf left join df using (n, g)), nm as (select item, ref, n, sqrt(sum(w * w)) nrm from v group by all),
    dt as (select r.item, r.ref, r.n, sum(least(h.w, r.w) * r.w) d from v r join v h on r.item = h.item and r.n = h.n and r.g = h.g and h.ref = -1 where r.ref >= 0 group by all),
    s as (select dt.item, sum(case when a.nrm > 0 and b.nrm > 0 then d / (a.nrm * b.nrm) else 0 end * {fade}) s from dt join lens x on x.item = dt.item and x.ref = dt.ref join lens y on y.item = dt.item and y.ref = -1 join nm a on a.item = dt.item and a.ref = dt.ref and a.n = dt.n join nm b on b.item = dt.item and b.ref = -1 and b.n = dt.n group by 1)
    select item, round(case when len(refs) > 0 then coalesce(s, 0) * 10 / 4 / len(refs) else 0 end, 5) as cider from captions left join s using (item)"""


@query(with_(CAPTIONS) + CIDER.replace("{fade}", "1"))
def v4_cider(t):
    return rounded(V.cider(t.captions), "cider", digits=5)


@query(with_(CAPTIONS) + CIDER.replace("{fade}", "exp(-power(y.l - x.l, 2) / 72.0)"))
def v4_cider_length_penalty(t):
    return rounded(V.cider(t.captions, sigma=6.0), "cider", digits=5)


def _subs(t):
    """tag, sub, item, score: scores of closed and open questions, and of labels."""
    own = R.sub_scores(scored(t), {"closed": (c("closed"), c("closed_score")), "open": (~c("closed"), c("recall"))})
    return own.unionByName(R.sub_scores(parsed(t), {"label": (F.lit(True), c("gold") == c("pred"))}))


SUBS = "subs as (select tag, case when closed then 'closed' else 'open' end sub, item, case when closed then closed_score else recall end score from scored union all select tag, 'label', item, (gold = pred)::int::double from parsed)"


@query()
def r1_bootstrap_ci(t):
    return R.bootstrap_ci(_subs(t), ["tag", "sub"], "score")


@query()
def r2_paired_diff_ci(t):
    return R.paired_diff_ci(_subs(t), ["sub"], ["item"], "base")


DRAW = "(select b, v, (m % 65536 * 50021 + m // 65536 * 62989 + m) % 4294967296 / 4294967296.0 p from (select b, v, (h % 65536 * 40503 + h // 65536 * 30011 + b * 2654435761) % 4294967296 m from u, range(1, 21) r(b)))"
STEPS = ["exp(-1.0) * (" + " + ".join(f"1 / {math.factorial(k)}::double" for k in range(n + 1)) + ")" for n in range(8)]


@query(with_(VQA, SCORED, CLS, PARSED, SUBS) + "select tag, sub, count(*) as n, round(100 * avg(score), 6) as mean from subs group by all")
def r1_bootstrap_means(t):
    return rounded(R.bootstrap_ci(_subs(t), ["tag", "sub"], "score", draws=50), "mean").select("tag", "sub", "n", "mean")


@query(with_(VQA, SCORED, CLS, PARSED, SUBS) + "select y.sub, y.tag, count(*) as n, round(100 * avg(y.score - x.score), 6) as mean from subs x join subs y using (sub, item) where x.tag = 'base' and y.tag <> 'base' group by all")
def r2_paired_diff_means(t):
    return rounded(R.paired_diff_ci(_subs(t), ["sub"], ["item"], "base", draws=50), "mean").select("sub", "tag", "n", "mean")


@query(f"""with u as (select {sql_h('7', "l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey")} h, l_discount v from lineitem), x as {DRAW},
    w as (select b, v, {" + ".join(f"(p >= {s})::int" for s in STEPS)} w from x) select b, round(sum(w * v) / sum(w), 8) as mean, sum(w)::bigint as weight from w group by b""")
def r3_poisson_bootstrap(t):
    k = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    x = R.poisson_bootstrap(t.lineitem.select(k.alias("k"), c("l_discount").alias("v")), "k", "v", 20, 7)
    return rounded(x, "mean", digits=8)


@query(with_(VQA, SCORED, CLS, PARSED, SUBS) + "select tag, sub, count(*) as n, round(avg(score), 6) as score from subs group by all")
def r4_sub_scores(t):
    return _subs(t).groupBy("tag", "sub").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))


@query(with_(CLS) + ", y as (select item, max(pred) filter (where tag = 'base') base, max(pred) filter (where tag = 'tuned') tuned, min_by(q, tag) filter (where q is not null) question from (select *, case when item % 4 > 0 then gold end q from cls where not (tag = 'tuned' and item % 7 = 0)) group by item) select item, base, tuned, question, (base is null)::int + (tuned is null)::int as gaps from y")
def x1_merge_answers(t):
    x = t.cls.filter("not (tag = 'tuned' and item % 7 = 0)").withColumn("question", F.when(c("item") % 4 > 0, c("gold")))
    return X.merge_answers(x, "item", ["base", "tuned"])


@query(with_(CLS) + ", w as (select item, n_chars size, max((pred = gold)::int) filter (where tag = 'base') base, max((pred = gold)::int) filter (where tag = 'tuned') tuned from cls join documents on item = doc_id group by all) select item, size, base, tuned from w where tuned = 1 and base = 0 order by size, item limit 20")
def x2_pick_wins(t):
    x = t.cls.join(t.documents.select(c("doc_id").alias("item"), c("n_chars").alias("size")), "item").withColumn("score", (c("pred") == c("gold")).cast("int"))
    return X.pick_wins(x, "item", "tuned", ["base", "tuned"], 20)


METRICS = "metrics as (select sub metric, tag, round(avg(score), 6) value from subs group by all)"


def _metrics(t):
    return r4_sub_scores(t).select(c("sub").alias("metric"), "tag", c("score").alias("value"))


@query(with_(VQA, SCORED, CLS, PARSED, SUBS, METRICS) + "select metric, max(value) filter (where tag = 'base') as base, case when metric = 'open' then 0.5 else max(value) filter (where tag = 'tuned') end as tuned from metrics group by metric")
def x3_metric_table(t):
    over = t.labels.agg(F.lit("open").alias("metric"), F.lit("tuned").alias("tag"), F.lit(0.5).alias("value"))
    return X.metric_table(_metrics(t), ["base", "tuned"], over)


@query(with_(CLS) + """, s as (select gold metric, avg((pred = gold)::int) filter (where tag = 'base' and item % 2 = 0) a1, avg((pred = gold)::int) filter (where tag = 'tuned' and item % 2 = 0) b1, avg((pred = gold)::int) filter (where tag = 'base' and item % 2 = 1) a2, avg((pred = gold)::int) filter (where tag = 'tuned' and item % 2 = 1) b2 from cls group by gold)
    select metric, round(b1 - a1, 6) as diff_1, round(b2 - a2, 6) as diff_2, (b1 - a1) * (b2 - a2) > 0 as same_sign from s""")
def x4_seed_consistency(t):
    score = lambda tag, k: F.avg(F.when((c("tag") == tag) & (c("item") % 2 == k), (c("pred") == c("gold")).cast("int")))
    wide = t.cls.groupBy(c("gold").alias("metric")).agg(score("base", 0).alias("a_1"), score("tuned", 0).alias("b_1"), score("base", 1).alias("a_2"), score("tuned", 1).alias("b_2"))
    return rounded(X.seed_consistency(wide, ["1", "2"]), "diff_1", "diff_2")


@query("with x as (select l_discount rate, avg(l_tax) loss from lineitem group by 1) select min(rate) as rate from x where loss <= (select min(loss) from x) * 1.01")
def x5_pick_hyperparameter(t):
    x = t.lineitem.groupBy(c("l_discount").alias("rate")).agg(F.avg("l_tax").alias("loss"))
    return X.pick_hyperparameter(x, "rate", "loss")


@query(with_(CLS) + ", s as (select tag, gold, item % 3 seed, round(avg((pred = gold)::int), 6) v from cls group by all) select tag, gold, list_sort(list(v)) as values, round(avg(v), 6) as mean from s group by tag, gold")
def x6_dose_response(t):
    x = t.cls.groupBy("tag", "gold", (c("item") % 3).alias("seed")).agg(F.round(F.avg((c("pred") == c("gold")).cast("int")), 6).alias("v"))
    return rounded(X.dose_response(x, ["tag", "gold"], c("v")), "mean")


@query(with_(VQA, SCORED) + """select tag, modality, count(*) filter (where closed2) as n_closed, count(*) filter (where not closed2) as n_open, round(avg(closed_score) filter (where closed2), 6) as closed_acc, round(avg(f1) filter (where not closed2), 6) as open_f1
    from (select *, gn_yes in ('yes', 'no') closed2 from (select *, """ + YES_NO("gn") + """ gn_yes from scored)) group by grouping sets ((tag), (tag, modality))""")
def w3_answer_report(t):
    return rounded(jobs.answer_report(t.vqa).drop("open_em", "open_recall"), "closed_acc", "open_f1")
