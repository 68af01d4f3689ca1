"""Queries of the cleaning functions, records and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from medcorpus.functions import scoring as S
from medcorpus.functions import text as T
from medcorpus.operators import dialogues as D
from medcorpus.operators import records as R
from medcorpus.operators import sampling as P
from medcorpus.queries.base import CAPTIONS, CLS, DIALOGUES, MCQ, REPORTS, SCREEN, VQA, query, sql_h, sql_rank, with_

c = F.col
PUNCT = "'[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]'"
#: SQL of the normalised answer, and of its words.
NORM = lambda x: f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(trim({x})), {PUNCT}, '', 'g'), '\\s+'), lambda w: w <> '' and w not in ('a', 'an', 'the')), ' ')"
YES_NO = lambda n: f"case when string_split({n}, ' ')[1] in ('yes', 'y', 'true') then 'yes' when string_split({n}, ' ')[1] in ('no', 'n', 'false') then 'no' when starts_with({n}, 'yes') then 'yes' when starts_with({n}, 'no') then 'no' else 'other' end"
OVERLAP = lambda a, b: f"list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w)))))"
WORDS = lambda n: f"list_filter(string_split({n}, ' '), lambda w: w <> '')"
KEY = lambda x: f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


@query(r"""select doc_id, trim(regexp_replace(array_to_string(list_transform(list_filter(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
    lambda s: not regexp_matches(s, '(?i)^\s*(page\s*)?\d{1,4}\s*$')), lambda s: trim(regexp_replace(s, '[ \t\f\v]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as clean from documents""")
def c1_clean_text(t):
    return t.documents.select("doc_id", T.clean_text(c("text")).alias("clean"))


@query(r"select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda s: not regexp_matches(s, '(?i)Provided by:|Located at:|License:|Authored by:|creativecommons\.org|Public Domain:|\bCC BY(-[A-Z]+)*(\s\d\.\d)?\s*:')), chr(10)) as kept from documents")
def c2_strip_attribution(t):
    return t.documents.select("doc_id", T.strip_attribution(c("text")).alias("kept"))


@query("select doc_id, len(regexp_extract_all(text, 'the|der|les')) * 1000 / greatest(1, length(text)) > 9.0 as is_ad from documents")
def c3_looks_like_ad(t):
    return t.documents.select("doc_id", T.looks_like_ad(c("text"), "the|der|les", 9.0).alias("is_ad"))


@query("select conv_id, turn, len(list_distinct(regexp_extract_all(text, 'and|und|que|tion'))) >= 2 as is_promo from conversations")
def c4_looks_like_promo_qa(t):
    return t.conversations.select("conv_id", "turn", T.looks_like_promo(c("text"), "and|und|que|tion", 2).alias("is_promo"))


@query(r"""select doc_id, regexp_matches(text, '(?i)(^|[^0-9])1[3-9]\d{9}($|[^0-9])|(^|[^0-9])\d{17}[\dXx]($|[^0-9])|[a-z0-9_.+-]+@[a-z0-9_-]+\.[a-z0-9_.]+|[Qq]{2}[:：号]?\s*\d{5,}|https?://|www\.') as pii from documents""")
def c5_has_pii(t):
    return t.documents.select("doc_id", T.has_pii(c("text")).alias("pii"))


@query(r"select page_id, trim(regexp_replace(html, '(?i)<\s*/?\s*(br|p|div|span|b|strong|em|i|font)\b[^>]*>|^\s*/?\s*br\s*/?\s*>|&nbsp;', ' ', 'g')) as plain from pages")
def c6_strip_html(t):
    return t.pages.select("page_id", T.strip_html(c("html")).alias("plain"))


@query(f"select doc_id, md5({KEY('text')}) as key from documents")
def c7_norm_key(t):
    return t.documents.select("doc_id", F.md5(T.norm_key(c("text"))).alias("key"))


@query(r"select conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as q from conversations where role = 'user'")
def c8_norm_question(t):
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", T.norm_question(c("text")).alias("q"))


@query(with_(REPORTS) + r"select path, trim(regexp_replace(regexp_replace(regexp_replace('XXXX ' || findings || ' .', '\bX{2,}\b', ' ', 'g'), '\s+', ' ', 'g'), '\s+([.,;:])', '\1', 'g')) as clean from reports")
def c9_clean_report(t):
    return t.reports.select("path", T.clean_report(F.concat(F.lit("XXXX "), c("findings"), F.lit(" ."))).alias("clean"))


@query(r"select p_partkey, trim(regexp_replace('Ans. is ''' || chr((97 + p_partkey % 4)::int) || ''' i.e., ' || p_name, '(?i)^\s*(ans(wer)?\.?\s*(is)?\s*[:\-]?\s*[''\x22‘’(]?\s*[a-d]\s*[''\x22‘’)]?\s*[,.:;-]?\s*(i\.?\s*e\.?\s*[,:]?)?)', '')) as why from part")
def c10_strip_answer_prefix(t):
    made = F.concat(F.lit("Ans. is '"), F.chr((97 + c("p_partkey") % 4)), F.lit("' i.e., "), c("p_name"))
    return t.part.select("p_partkey", T.strip_answer_prefix(made).alias("why"))


@query(with_(CLS) + "select tag, item, case when item % 5 = 0 then '' else raw end as answer from cls")
def c11_strip_reasoning(t):
    made = F.when(c("item") % 5 == 0, F.concat(F.lit("<think>never ends "), c("raw"))).otherwise(F.concat(F.lit("<think>why\nso</think> "), c("raw")))
    return t.cls.select("tag", "item", T.strip_reasoning(made).alias("answer"))


VALID = "(len(messages) >= 2 and len(messages) % 2 = 0 and len(list_filter(messages, lambda m, i: m.role <> case i % 2 when 1 then 'user' else 'assistant' end)) = 0)"


@query(with_(DIALOGUES) + f"select conv_id, {VALID} as ok from dialogues")
def c12_valid_dialogue(t):
    return t.dialogues.select("conv_id", D.valid_dialogue(c("messages")).alias("ok"))


REASONS = f"""reasons as (select conv_id, source, messages[1:4] cut, case when not {VALID} then 'format' when len(list_filter(messages[1:4], lambda m: length(m.content) < case m.role when 'user' then 60 else 100 end)) > 0 then 'short'
    when regexp_matches(array_to_string(list_transform(messages[1:4], lambda m: m.content), chr(10)), '(?i)https?://|www\\.|@') then 'pii' end reason from dialogues)"""


def _reasons(t):
    cut, reason = D.drop_reason(c("messages"), 2, 60, 100)
    return t.dialogues.select("conv_id", "source", cut.alias("cut"), reason.alias("reason"))


@query(with_(DIALOGUES, REASONS) + "select conv_id, len(cut) as n, reason from reasons")
def c13_clean_dialogue(t):
    return _reasons(t).select("conv_id", F.size("cut").alias("n"), "reason")


COST = "list_sum(list_transform({m}, lambda m: greatest(1, length(m.content) // 2) + 12))"
FIT = "list_max(list_filter(range(0, len(messages) // 2 + 1), lambda k: k = 0 or " + COST.format(m="messages[1:2*k]") + " <= 900))"


@query(with_(DIALOGUES) + f"select conv_id, nullif({FIT}, 0) * 2 as n from dialogues")
def c14_trim_rounds(t):
    return t.dialogues.select("conv_id", F.size(D.trim_rounds(c("messages"), 900)).alias("n")).withColumn("n", F.when(c("n") > 0, c("n")).cast("long"))


@query("select doc_id, greatest(1, length(text) // 2) as n from documents")
def c15_token_count(t):
    return t.documents.select("doc_id", T.token_count(c("text")).alias("n"))


@query("select doc_id, (select count(*) from documents where source = 'src0') as n_dropped from documents where source is distinct from 'src0'")
def c16_filter_licence_source(t):
    kept, dropped = D.restricted_source(t.documents, "source", "src0")
    # dropped is a table of one row
    return kept.select("doc_id").join(dropped)


@query("select p_partkey, case when p_size % 7 = 0 then [] else [p_brand, p_type] end as problems from part")
def c17_problem_list(t):
    made = F.when(c("p_size") % 7 == 0, " Normal ").otherwise(F.concat(c("p_brand"), F.lit(" ; "), c("p_type"), F.lit(";")))
    return t.part.select("p_partkey", T.problem_list(made).alias("problems"))


@query(with_(SCREEN) + "select item, rest from screen")
def c18_negation_scrub(t):
    return t.screen.select("item", T.negation_scrub(c("desc")).alias("rest"))


@query(with_(DIALOGUES, REASONS) + "select source, coalesce(reason, 'kept') as reason, count(*) as n from reasons group by all")
def c19_drop_reason_stats(t):
    return D.drop_reason_stats(_reasons(t), "source", "reason")


@query(with_(DIALOGUES, REASONS) + f""", r as (select conv_id, source, reason, {sql_rank(5, 'p', 'conv_id')} rank from reasons), s as (select *, sum((reason is null)::int) over (partition by source order by rank, conv_id) k from r), x as (select *, k < 9 or (reason is null and k = 9) seen, reason is null and k <= 9 kept from s),
    d as (select source, map_from_entries(list((reason, n) order by reason)) m from (select source, reason, count(*) n from x where seen and reason is not null group by all) group by source)
    select source::varchar as source, count(*) as total, count(*) as pool, count(*) filter (where kept) as kept, 9 as target, any_value(list_transform(map_entries(m), lambda e: e.key || '=' || e.value)) as dropped from x left join d using (source) group by source""")
def c19_target_stats(t):
    x = _reasons(t).select("conv_id", c("source").cast("string").alias("source"), "reason", F.lit(None).cast("array<string>").alias("messages"))
    x = P.seen_until_target(x, "source", 9, 5, "p", "conv_id", c("reason").isNull())
    out = D.target_stats(x, x.groupBy("source").agg(F.count("*").alias("total")), {"0": 9, "1": 9})
    return out.select("source", "total", "pool", "kept", "target", F.transform(F.map_entries("dropped"), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("dropped"))


@query(with_(DIALOGUES) + "select conv_id, len(messages) as n, messages[1].content as first, messages[-1].role as last_role from dialogues")
def b1_turns_to_messages(t):
    return t.dialogues.select("conv_id", F.size("messages").alias("n"), c("messages")[0]["content"].alias("first"), F.element_at("messages", -1)["role"].alias("last_role"))


@query("select conv_id, count(*) as n, count(*) filter (where k % 2 = 0) as asked, max(length(trim(text))) as longest from (select *, row_number() over (partition by conv_id order by turn) - 1 k from conversations where role <> 'system') group by 1")
def b2_parse_prefixed_turns(t):
    lines = t.dialogues.select("conv_id", F.transform("messages", lambda m, i: F.concat(F.when(i % 2 == 0, "问：").otherwise("答："), F.lit("<b>"), m["content"])).alias("data"))
    m = lines.select("conv_id", D.parse_prefixed_turns(c("data")).alias("messages"))
    turns = D.messages_to_turns(m)
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.count(F.when(c("role") == "user", 1)).alias("asked"), F.max(F.length("text")).alias("longest"))


@query(with_(VQA) + f"select tag, item, '<image>' || trim(gold) || case when {NORM('gold')} in ('yes', 'no') then chr(10) || 'Answer with yes or no only.' else chr(10) || 'Answer with a single word or short phrase.' end as q, trim(gold) as a from vqa")
def b3_vqa_row(t):
    x = t.vqa.select("tag", "item", R.vqa_row(c("gold"), c("gold")).alias("m"))
    return x.select("tag", "item", c("m")[0]["content"].alias("q"), c("m")[1]["content"].alias("a"))


def _options():
    return F.create_map(F.lit("A"), c("p_name"), F.lit("B"), c("p_brand"), F.lit("C"), c("p_type"), F.lit("D"), F.when(c("p_size") % 3 > 0, c("p_size").cast("string")))


LINES = "'A. ' || p_name || chr(10) || 'B. ' || p_brand || chr(10) || 'C. ' || p_type || case when p_size % 3 > 0 then chr(10) || 'D. ' || p_size else '' end"


@query(with_(MCQ) + f"select tag, item, p_name || chr(10) || {LINES} || chr(10) || 'Answer with the option''s letter from the given choices directly.' as q, gold as a from mcq")
def b4_mcq_letter_row(t):
    x = t.mcq.select("tag", "item", R.mcq_letter_row(c("p_name"), _options(), F.lower("gold")).alias("m"))
    return x.select("tag", "item", c("m")[0]["content"].alias("q"), c("m")[1]["content"].alias("a"))


@query(with_(MCQ) + "select tag, item, case when gold = 'D' and p_size % 3 = 0 then 'answer' when p_size % 3 = 0 then 'options' when length(p_name || p_type) < 20 then 'explanation' end as reason, gold || chr(10) || p_name || p_type as a from mcq")
def b5_mcq_explain_row(t):
    m, reason = R.mcq_explain(c("p_name"), _options(), c("gold"), F.concat("p_name", "p_type"))
    return t.mcq.select("tag", "item", reason.alias("reason"), m[1]["content"].alias("a"))


@query(with_(MCQ) + "select tag, item, case when p_size % 2 = 0 then 'choice' when item % 6 > 3 then 'answer' when length(p_name || p_type || p_brand) < 20 then 'explanation' end as reason from mcq")
def b6_mcq_explain_row_wide(t):
    why = F.concat(F.lit("Ans. is 'c' i.e., "), c("p_name"), c("p_type"), c("p_brand"))
    opts = [c("p_name"), c("p_brand"), c("p_type"), c("p_size").cast("string")]
    m, reason = R.mcq_explain_wide(c("p_name"), opts, (c("item") % 6).cast("int"), F.when(c("p_size") % 2 == 0, "multi").otherwise("single"), why)
    return t.mcq.select("tag", "item", reason.alias("reason"))


@query(with_(DIALOGUES) + "select conv_id, case when length(trim(messages[1].content)) >= 10 and length(trim(messages[2].content)) >= 20 then trim(messages[2].content) end as a from dialogues")
def b7_final_answer_row(t):
    return t.dialogues.select("conv_id", R.final_answer_row(F.get("messages", F.lit(0))["content"], F.get("messages", F.lit(1))["content"])[1]["content"].alias("a"))


PROMPTS = "[" + ", ".join(f"'<image>{p}'" for p in R.REPORT_PROMPTS) + "]"


@query(with_(REPORTS) + f""", r as (select path, nullif(concat_ws(chr(10), case when regexp_replace(findings, '^\\s+|\\s+$', '', 'g') <> '' then 'Findings: ' || regexp_replace(findings, '^\\s+|\\s+$', '', 'g') end, case when regexp_replace(impression, '^\\s+|\\s+$', '', 'g') <> '' then 'Impression: ' || regexp_replace(impression, '^\\s+|\\s+$', '', 'g') end), '') report from reports)
    select path, {PROMPTS}[{sql_h("42", "path")} % 3 + 1] as prompt, report, (select count(*) from r where report is null) as n_skipped from r where report is not null""")
def b8_report_row(t):
    rows, skipped = R.report_rows(t.reports, "path", 42)
    # skipped is a table of one row
    return rows.select("path", c("messages")[0]["content"].alias("prompt"), c("messages")[1]["content"].alias("report")).join(skipped)


@query("""select p_partkey, unnest(case when p_size % 7 = 0 then ['yes'] else ['no', p_brand || ', ' || p_type] end) as a from part""")
def b9_report_qa_rows(t):
    probs = F.when(c("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    return t.part.select("p_partkey", F.explode(R.report_qa_rows(probs)).alias("m")).select("p_partkey", c("m")[1]["content"].alias("a"))


@query("select doc_id, 'Question: ' || source || chr(10) || chr(10) || lang || chr(10) || text || chr(10) || chr(10) || 'Conclusion: ' || n_chars as lm from documents")
def b10_abstract_lm_text(t):
    return t.documents.select("doc_id", R.abstract_lm_text(c("source"), F.array("lang", "text"), c("n_chars").cast("string")).alias("lm"))


@query("""select doc_id, 'You are a biomedical research assistant.' || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || source || chr(10) || 'Based only on the context, answer with exactly one word: yes, no, or maybe.' as q,
    case when quality = 1 then 'yes' else 'no' end as a from labels join documents using (doc_id)""")
def b11_abstract_cls_row(t):
    x = t.labels.select("doc_id", "quality").join(t.documents, "doc_id").select("doc_id", R.abstract_cls_row(c("source"), F.array("text"), F.when(c("quality") == 1, "yes").otherwise("no")).alias("m"))
    return x.select("doc_id", c("m")[0]["content"].alias("q"), c("m")[1]["content"].alias("a"))


@query(with_(VQA) + "select tag, item, '<image>' || trim(gold) as q from vqa")
def b12_strip_prompt_suffix(t):
    return t.vqa.select("tag", "item", R.strip_prompt_suffix(R.vqa_row(c("gold"), c("gold"))[0]["content"]).alias("q"))


#: Rewrites of the answers asked for: every third repeats the answer in a sentence, the others do not.
PLAIN = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), {PUNCT}, '', 'g'), '\\s+', ' ', 'g'))"
FIT_REWRITE = f"not contains(x, chr(10)) and len({WORDS('x')}) between 4 and 40 and case when a in ('yes', 'no') then string_split(n, ' ')[1] = a else a <> '' and regexp_matches(n, '(^|[^a-z0-9])' || a || '([^a-z0-9]|$)') end"
REWRITES = f"""v as (select item, gold q, gold a0 from vqa where tag = 'base'), asked as (select item from v qualify row_number() over (order by {sql_rank(7, 'rewrite', 'item')}, item) <= round_even(count(*) over () * 0.25, 0)),
    w as (select item, trim(case when item % 3 = 0 then a0 || ' is what this one shows' else 'nothing of it is to be seen' end) x, {PLAIN('a0')} a from v join asked using (item)), ok as (select item, x, {FIT_REWRITE} ok from (select *, {PLAIN('x')} n from w))"""


def _rewrites(t):
    rows = t.vqa.filter("tag = 'base'").select("item", c("gold").alias("question"), c("gold").alias("answer"))
    asked = R.rewrite_requests(rows, "item", 0.25, 7)
    said = F.when(c("item") % 3 == 0, F.concat("answer", F.lit(" is what this one shows"))).otherwise("nothing of it is to be seen")
    return R.apply_rewrites(rows, asked.select("item", said.alias("rewrite")), "item")


@query(with_(VQA, REWRITES) + "select item, case when ok then q || chr(10) || 'Answer in one sentence.' else q end as question, case when ok then x else a0 end as answer, ok as applied from v left join ok using (item)")
def b13_apply_rewrites(t):
    return _rewrites(t)


@query(with_(VQA, REWRITES) + "select count(*) as requested, count(*) filter (where ok) as applied, count(*) filter (where not ok) as rejected from ok")
def b13_rewrite_stats(t):
    return R.rewrite_stats(_rewrites(t), 0.01)


@query(with_(VQA) + f"select tag, item, {FIT_REWRITE} as ok from (select tag, item, x, a, {PLAIN('x')} n from (select tag, item, trim(pred || ' it is the ' || pred || ' as said') x, {PLAIN('gold')} a from vqa))")
def b14_rewrite_ok(t):
    return t.vqa.select("tag", "item", R.rewrite_ok(F.concat(c("pred"), F.lit(" it is the "), c("pred"), F.lit(" as said")), c("gold")).alias("ok"))


@query("select distinct regexp_extract(url, '://([^/?#]*)', 1) as image from pages")
def b15_description_requests(t):
    return R.description_requests(t.pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("image")), "image")


@query("select page_id as image, '<image>Describe this image.' as q, trim(url) as a from pages where page_id % 3 > 0 and trim(url) <> ''")
def b15_description_samples(t):
    x = R.description_samples(t.pages.select("page_id", F.when(c("page_id") % 3 > 0, c("url")).otherwise("  ").alias("text")), "page_id", "text")
    return x.select(c("page_id").alias("image"), c("messages")[0]["content"].alias("q"), c("messages")[1]["content"].alias("a"))


@query(with_(DIALOGUES) + f"""select conv_id, n * 2 as n_spans, coalesce(list_sum(list_transform(list_filter(messages[1:n], lambda m: m.role = 'assistant'), lambda m: length(m.content) + 11)), 0)::bigint as trained_chars from (select conv_id, messages, {FIT} * 2 n from dialogues)
    where len(list_filter(messages[1:n], lambda m: m.role = 'assistant')) > 0""")
def b16_loss_spans(t):
    x = t.dialogues.select("conv_id", D.loss_spans(c("messages"), 900).alias("s")).filter("s is not null")
    return x.select("conv_id", F.size("s").alias("n_spans"), F.aggregate(F.filter("s", lambda s: s["trained"]), F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"])).alias("trained_chars"))


@query(r"""select doc_id, len(w[1:99]) + 1 as n, len(w) > 99 as cut, coalesce(w[len(w[1:99])], '') as last from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') w from documents)""")
def b17_truncate_lm_rows(t):
    w, cut = D.truncate_lm(c("text"), 100)
    x = t.documents.select("doc_id", w.alias("w"), cut.alias("cut"))
    return x.select("doc_id", F.size("w").alias("n"), "cut", F.coalesce(F.get("w", F.size("w") - 2), F.lit("")).alias("last"))


@query(f"select p_partkey, case when p_size % 2 = 0 then p_brand || chr(10) else '' end || p_name || chr(10) || {LINES} || chr(10) || 'Answer with the option''s letter from the given choices directly.' as prompt from part")
def b18_mcq_eval_prompt(t):
    o = {"A": c("p_name"), "B": c("p_brand"), "C": c("p_type"), "D": F.when(c("p_size") % 3 > 0, c("p_size").cast("string")).otherwise("nan")}
    return t.part.select("p_partkey", R.mcq_eval_prompt(F.when(c("p_size") % 2 == 0, c("p_brand")).otherwise("nan"), c("p_name"), o).alias("prompt"))


@query("select doc_id as item, [text] as refs from documents")
def b19_normalise_refs(t):
    return R.normalise_refs(t.documents, ("captions", "text"), ("image_id", "doc_id"))


@query(with_(VQA) + f"select tag, item, {NORM('pred')} as p from vqa")
def m1_normalize_answer(t):
    return t.vqa.select("tag", "item", S.normalize_answer(c("pred")).alias("p"))


@query(with_(CLS) + f"select tag, item, {YES_NO('n')} as yn from (select tag, item, {NORM('raw')} n from cls)")
def m2_yes_no(t):
    return t.cls.select("tag", "item", S.yes_no(c("raw")).alias("yn"))


SCORED = f"""scored as (select *, case when {YES_NO('gn')} <> 'other' then ({YES_NO('pn')} = {YES_NO('gn')})::int::double else (pn = gn)::int::double end closed_score, (pn = gn)::int::double em,
    case when len(gw) = 0 then 0.0 else coalesce({OVERLAP('gw', 'pw')}, 0) / len(gw) end recall, case when len(gw) = 0 or len(pw) = 0 then (len(gw) = len(pw))::int::double else 2.0 * coalesce({OVERLAP('gw', 'pw')}, 0) / (len(gw) + len(pw)) end f1
    from (select *, {WORDS('gn')} gw, {WORDS('pn')} pw from (select *, {NORM('gold')} gn, {NORM('pred')} pn from vqa)))"""


def scored(t):
    p, g = c("pred"), c("gold")
    return t.vqa.select("*", S.closed_score(p, g).alias("closed_score"), S.exact_match(p, g).alias("em"), S.token_recall(p, g).alias("recall"), S.token_f1(p, g).alias("f1"))


def _score(name: str):
    @query(with_(VQA, SCORED) + f"select tag, item, round({name}, 6) as score from scored")
    def f(t):
        return scored(t).select("tag", "item", F.round(name, 6).alias("score"))

    return f


def _named(new: str, col: str):
    from medcorpus.queries.base import ORACLE_SQL, QUERIES

    _score(col)
    QUERIES[new], ORACLE_SQL[new] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


for _new, _col in (("m3_closed_score", "closed_score"), ("m4_exact_match", "em"), ("m5_token_recall", "recall"), ("m6_token_f1", "f1")):
    _named(_new, _col)


@query(with_(CLS) + "select tag, item, least(case when pred = gold then 1 else 0 end + case when pred = 'yes' then 1 else 0 end + case when pred = 'maybe' then 1 else 0 end, 3) / 3.0 as score from cls")
def m7_vqa_accuracy(t):
    return t.cls.select("tag", "item", S.vqa_accuracy(F.initcap("pred"), F.array(c("gold"), F.lit("Yes."), F.lit("the maybe"))).alias("score"))


ZH = ("是的。", "不是", "有 病变", "没有", "肺", "正常！", "不正常", "T1", "yes", "无")
ZH_SQL = "[" + ", ".join(f"'{x}'" for x in ZH) + "]"
ZH_FOLD = "['yes', 'no', 'yes', 'no', 'other', 'yes', 'no', 'other', 'yes', 'no']"


def _zh(t):
    """g and p: one of the words and a piece of the part's name or brand."""
    words, end = F.array(*[F.lit(x) for x in ZH]), F.substring("p_name", 1, 4)
    own = F.when(c("p_size") % 3 == 0, end).otherwise(F.substring("p_brand", -2, 2))
    return t.part.select("p_partkey", F.concat(F.get(words, (c("p_partkey") % 10).cast("int")), end).alias("g"), F.concat(F.get(words, (c("p_size") % 10).cast("int")), own).alias("p"))


ZH_PARTS = f"""zh as (select p_partkey, {ZH_FOLD}[p_partkey % 10 + 1] gy, {ZH_FOLD}[p_size % 10 + 1] py, lower(regexp_replace({ZH_SQL}[p_partkey % 10 + 1] || p_name[1:4], '[\\s。！]', '', 'g')) g,
    lower(regexp_replace({ZH_SQL}[p_size % 10 + 1] || case when p_size % 3 = 0 then p_name[1:4] else p_brand[-2:] end, '[\\s。！]', '', 'g')) p from part)"""


@query(with_(ZH_PARTS) + "select p_partkey, gy as yn, case when gy <> 'other' then (py = gy)::int::double else (p = g)::int::double end as closed, (p = g)::int::double as em from zh")
def m8_closed_score_zh(t):
    return _zh(t).select("p_partkey", S.yes_no_zh(c("g")).alias("yn"), S.closed_score_zh(c("p"), c("g")).alias("closed"), S.exact_match_zh(c("p"), c("g")).alias("em"))


@query(with_(ZH_PARTS) + f"select p_partkey, round(coalesce({OVERLAP('g', 'p')}, 0) / len(g), 6) as recall, round(2.0 * coalesce({OVERLAP('g', 'p')}, 0) / (len(g) + len(p)), 6) as f1 from (select p_partkey, string_split(g, '') g, string_split(p, '') p from zh)")
def m9_char_scores_zh(t):
    return _zh(t).select("p_partkey", F.round(S.char_recall_zh(c("p"), c("g")), 6).alias("recall"), F.round(S.char_f1_zh(c("p"), c("g")), 6).alias("f1"))


LABEL = "coalesce(case when starts_with(n, 'yes') then 'yes' when starts_with(n, 'no') then 'no' when starts_with(n, 'maybe') then 'maybe' end, case when list_contains(string_split(n, ' '), 'yes') then 'yes' when list_contains(string_split(n, ' '), 'no') then 'no' when list_contains(string_split(n, ' '), 'maybe') then 'maybe' end)"
PARSED = f"parsed as (select tag, item, gold, coalesce({LABEL}, 'maybe') pred, {LABEL} is null unparsed from (select *, {NORM('raw')} n from cls))"


def parsed(t):
    label, bad = S.parse_label(c("raw"))
    return t.cls.select("tag", "item", "gold", label.alias("pred"), bad.alias("unparsed"))


@query(with_(CLS, PARSED) + "select tag, item, pred, unparsed from parsed")
def m10_parse_label(t):
    return parsed(t).drop("gold")


CHOICES = r"choices as (select tag, item, category, gold, regexp_extract(upper(pred_raw), '\b([A-D])\b', 1) pred from mcq)"


def choices(t):
    return t.mcq.select("tag", "item", "category", "gold", S.parse_choice(c("pred_raw"), 4).alias("pred"))


@query(with_(MCQ, CHOICES) + "select tag, item, pred from choices")
def m11_parse_choice(t):
    return choices(t).select("tag", "item", "pred")


@query(with_(SCREEN) + "select item, normal, found as any_word, lung from screen")
def m12_says_normal(t):
    return t.screen.select("item", S.says_normal(c("desc")).alias("normal"), S.reports_any(c("desc")).alias("any_word"), S.reports_lung(c("desc")).alias("lung"))


@query(with_(SCREEN) + "select item, unnest(findings) as finding from screen")
def m13_mentions_finding(t):
    found = F.array(*[F.when(S.mentions(c("desc"), p), name) for name, p in S.FINDINGS.items()])
    return t.screen.select("item", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding"))


@query(with_(SCREEN) + "select item, xray as modality, chest as location from screen")
def m14_attribute_ok(t):
    return t.screen.select("item", S.lexicon_ok(c("desc"), F.lit("X-Ray"), S.MODALITY).alias("modality"), S.lexicon_ok(c("desc"), F.lit("Chest_mediastinal"), S.LOCATION | {"Chest_mediastinal": r"lung|pleura|heart|chest"}).alias("location"))


@query()
def m15_rouge_l(t):
    from medcorpus.operators.vectors import rouge_l

    return t.captions.select("item", rouge_l(c("pred"), c("refs")).alias("score"))


TOKENS = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS.split())


@query(with_(CAPTIONS) + f"""select item, round(coalesce(list_max(list_transform(refs, lambda r: case when len(list_filter(list_distinct({TOKENS('r')}), lambda w: w not in ({STOP}))) = 0 then 0.0
    else len(list_filter(list_distinct({TOKENS('r')}), lambda w: w not in ({STOP}) and list_contains({TOKENS('pred')}, w))) / len(list_filter(list_distinct({TOKENS('r')}), lambda w: w not in ({STOP}))) end)), 0.0), 6) as score from captions""")
def m16_ref_recall(t):
    return t.captions.select("item", F.round(S.ref_recall(c("pred"), c("refs")), 6).alias("score"))


D2 = f"d2 as (select doc_id, text, w, case when len(w) < 2 then 1.0 else len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) / (len(w) - 1) end d from (select doc_id, text, {TOKENS('text')} w from documents))"


@query(with_(D2) + "select doc_id, round(d, 6) as d2 from d2")
def m17_distinct2(t):
    return t.documents.select("doc_id", F.round(S.distinct2(S.latin_tokens(c("text"))), 6).alias("d2"))


POLARITY = """polarity as (select p_partkey item, p_brand img, ['Is the lung healthy?', 'Is there any abnormality?', 'Can ' || p_name || ' be observed?', 'Which organ is it?'][p_partkey % 4 + 1] q, ['Yes', 'No', 'no ', p_name][p_size % 4 + 1] a, ['Abnormality', 'Organ', 'Plane'][p_partkey % 7 % 3 + 1] ct from part)"""
KIND = r"""case when lower(trim(a)) not in ('yes', 'no') then 'not_yn' when ct = 'Organ' then 'organ' when ct <> 'Abnormality' then 'other' when regexp_matches(q, '(?i)\b(healthy|normal)\b') then case lower(trim(a)) when 'yes' then 'neg_global' else 'pos_global' end
    else case lower(trim(a)) when 'yes' then 'pos_' else 'neg_' end || case when regexp_matches(q, '(?i)abnormal|unhealthy') then 'global' else 'specific' end end"""


def polarity(t):
    k = c("p_partkey")
    q = F.get(F.array(F.lit("Is the lung healthy?"), F.lit("Is there any abnormality?"), F.concat(F.lit("Can "), c("p_name"), F.lit(" be observed?")), F.lit("Which organ is it?")), (k % 4).cast("int"))
    a = F.get(F.array(F.lit("Yes"), F.lit("No"), F.lit("no "), c("p_name")), (c("p_size") % 4).cast("int"))
    ct = F.get(F.array(F.lit("Abnormality"), F.lit("Organ"), F.lit("Plane")), (k % 7 % 3).cast("int"))
    x = t.part.select(k.alias("item"), c("p_brand").alias("img"), q.alias("q"), a.alias("a"), ct.alias("ct"))
    return x.withColumn("kind", S.classify_polarity(c("q"), c("a"), c("ct")))


@query(with_(POLARITY) + f"select item, {KIND} as kind from polarity")
def m18_classify_polarity(t):
    return polarity(t).select("item", "kind")
