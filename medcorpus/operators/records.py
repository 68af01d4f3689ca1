"""Training and evaluation rows from questions, exams and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medcorpus.functions.scoring import normalize_answer
from medcorpus.functions.text import hash_number, strip_answer_prefix, text_of
from medcorpus.operators.sampling import seeded_places

#: What the prompts say.
CLOSED_SUFFIX = "\nAnswer with yes or no only."
OPEN_SUFFIX = "\nAnswer with a single word or short phrase."
MCQ_SUFFIX = "\nAnswer with the option's letter from the given choices directly."
EXPLAIN_SUFFIX = "\nGive the answer letter first, then a brief explanation."
ABSTRACT_PROMPT = ("You are a biomedical research assistant.\nContext:\n", "\n\nQuestion: ", "\nBased only on the context, answer with exactly one word: yes, no, or maybe.")
LETTERS = ("A", "B", "C", "D")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(user: Column, assistant: Column) -> Column:
    return F.array(message("user", user), message("assistant", assistant))


def vqa_row(question: Column, answer: Column) -> Column:
    """Messages of a picture question; yes/no answers get the closed prompt."""
    closed = normalize_answer(answer).isin("yes", "no")
    return chat(F.concat(F.lit("<image>"), F.trim(question), F.when(closed, CLOSED_SUFFIX).otherwise(OPEN_SUFFIX)), F.trim(answer))


def option_lines(options: Column, letters: tuple[str, ...] = LETTERS) -> Column:
    """"K. value" lines of a map's options that are there."""
    own = F.filter(F.array(*[F.lit(x) for x in letters]), lambda k: F.coalesce(F.trim(options[k]), F.lit("")) != "")
    return F.array_join(F.transform(own, lambda k: F.concat(k, F.lit(". "), F.trim(options[k]))), "\n")


def mcq_letter_row(question: Column, options: Column, answer: Column) -> Column:
    return chat(F.concat(F.trim(question), F.lit("\n"), option_lines(options), F.lit(MCQ_SUFFIX)), F.upper(F.trim(answer)))


def mcq_explain(question: Column, options: Column, answer: Column, explanation: Column) -> tuple[Column, Column]:
    """Messages with the letter and then why, and the reason if the item is not fit (null: it is)."""
    letter, why = F.upper(F.trim(text_of(answer))), F.trim(text_of(explanation))
    filled = F.size(F.filter(F.map_values(options), lambda v: F.trim(text_of(v)) != ""))
    reason = F.when(F.length(letter) != 1, "answer").when(F.coalesce(F.trim(options[letter]), F.lit("")) == "", "answer").when(filled < 4, "options").when(F.length(why) < 20, "explanation")
    letters = ("A", "B", "C", "D", "E")
    return chat(F.concat(F.trim(question), F.lit("\n"), option_lines(options, letters), F.lit(EXPLAIN_SUFFIX)), F.concat(letter, F.lit("\n"), why)), reason


def mcq_explain_wide(question: Column, options: list[Column], cop: Column, choice_type: Column, explanation: Column) -> tuple[Column, Column]:
    """The same from one column an option and the place of the right one, 0 to 3; single-choice items only."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    as_map = F.map_from_arrays(letters, F.array(*options))
    letter = F.when(cop.between(0, 3), F.get(letters, cop)).otherwise("")
    messages, reason = mcq_explain(question, as_map, letter, strip_answer_prefix(explanation))
    return messages, F.when(choice_type != "single", "choice").otherwise(reason)


def final_answer_row(question: Column, response: Column) -> Column:
    """Question and final answer, or null if either is too short."""
    return F.when((F.length(F.trim(question)) >= 10) & (F.length(F.trim(response)) >= 20), chat(F.trim(question), F.trim(response)))


def report_text(findings: Column, impression: Column) -> Column:
    """The sections that are there, without white space around them, or null."""
    bare = lambda c: F.btrim(text_of(c), F.lit(" \t\n\x0b\f\r"))
    part = lambda name, c: F.when(_is_said(c), F.concat(F.lit(f"{name}: "), bare(c)))
    return F.nullif(F.concat_ws("\n", part("Findings", findings), part("Impression", impression)), F.lit(""))


def _is_said(section: Column) -> Column:
    """Whether a section has more than white space; the search ends at the first such character."""
    return F.coalesce(text_of(section).rlike(r"\S"), F.lit(False))


def has_sections(findings: Column, impression: Column) -> Column:
    """Whether report_text is not null, without making the text."""
    return _is_said(findings) | _is_said(impression)


#: What a report is asked for.
REPORT_PROMPTS = ("Describe the findings in this image.", "Write the report of this study.", "What does this image show? Give findings and impression.")


def report_row(key: Column, findings: Column, impression: Column, seed: int, prompts: tuple[str, ...] = REPORT_PROMPTS) -> Column:
    """Messages of a report, one of the prompts by seed and key; null for a report without sections."""
    text = report_text(findings, impression)
    prompt = F.get(F.array(*[F.lit(f"<image>{p}") for p in prompts]), (hash_number(F.lit(seed), key) % len(prompts)).cast("int"))
    return F.when(has_sections(findings, impression), chat(prompt, text))


def report_rows(df: DataFrame, key: str, seed: int, prompts: tuple[str, ...] = REPORT_PROMPTS) -> tuple[DataFrame, DataFrame]:
    """key and messages of the reports(key, findings, impression) that have a section, and one row: n_skipped, those that have none."""
    messages = report_row(F.col(key), F.col("findings"), F.col("impression"), seed, prompts)
    said = has_sections(F.col("findings"), F.col("impression"))
    return df.filter(said).select(key, messages.alias("messages")), df.agg(F.count(F.when(~said, 1)).alias("n_skipped"))


def report_qa_rows(problems: Column) -> Column:
    """A yes/no row, and for an abnormal study a row that lists its problems."""
    some = F.size(problems) > 0
    closed = chat(F.lit("<image>Is this study normal?" + CLOSED_SUFFIX), F.when(some, "no").otherwise("yes"))
    return F.filter(F.array(closed, F.when(some, chat(F.lit("<image>List the abnormal findings."), F.array_join(problems, ", ")))), lambda x: x.isNotNull())


def abstract_lm_text(question: Column, contexts: Column, conclusion: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\n"), F.array_join(contexts, "\n"), F.lit("\n\nConclusion: "), conclusion)


def abstract_cls_row(question: Column, contexts: Column, label: Column) -> Column:
    a, b, c = map(F.lit, ABSTRACT_PROMPT)
    return chat(F.concat(a, F.array_join(contexts, "\n"), b, question, c), label)


def strip_prompt_suffix(prompt: Column) -> Column:
    """The question without its known format line; a prompt without one is an error."""
    cut = lambda s: F.substring(prompt, F.lit(1), F.length(prompt) - len(s))
    return F.when(F.endswith(prompt, F.lit(CLOSED_SUFFIX)), cut(CLOSED_SUFFIX)).when(F.endswith(prompt, F.lit(OPEN_SUFFIX)), cut(OPEN_SUFFIX)).otherwise(F.raise_error(F.lit("prompt without a known format line")))


def _plain(col: Column) -> Column:
    """Lower-cased, without ASCII punctuation, white space as single blanks; articles stay."""
    bare = F.regexp_replace(F.lower(col), r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def rewrite_ok(rewrite: Column, answer: Column) -> Column:
    """One line of 4 to 40 words that begins with the yes or no, or holds the answer with no letter or digit at its edges."""
    x, a = F.regexp_replace(text_of(rewrite), r"^\s+|\s+$", ""), _plain(text_of(answer))
    n = F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    # what is left of an answer has no sign that a pattern could take for its own
    held = F.regexp_like(_plain(x), F.concat(F.lit(r"(?<![a-z0-9])\Q"), a, F.lit(r"\E(?![a-z0-9])")))
    return ~F.contains(x, F.lit("\n")) & n.between(4, 40) & F.when(a.isin("yes", "no"), F.substring_index(_plain(x), " ", 1) == a).otherwise((a != "") & held)


#: Fixed value: what a rewritten answer is asked for, and the line that its question gets.
REWRITE_PROMPT = "Rewrite the answer as one full sentence that keeps it word for word.\nQuestion: {question}\nAnswer: {answer}"
SENTENCE_SUFFIX = "\nAnswer in one sentence."


def rewrite_requests(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """key, question, answer, prompt of a seeded share of rows(key, question, answer): the first round(n * share) of n in the keys' seeded order."""
    placed = seeded_places(rows.select(key, "question", "answer").withColumn("_all", F.lit(0)), "_all", seed, "rewrite", key)
    a, rest = REWRITE_PROMPT.split("{question}")
    b, c = rest.split("{answer}")
    prompt = F.concat(F.lit(a), F.col("question"), F.lit(b), F.col("answer"), F.lit(c))
    return placed.filter(F.col("_rn") <= F.bround(F.col("_size") * F.lit(share))).select(key, "question", "answer", prompt.alias("prompt"))


def apply_rewrites(rows: DataFrame, rewrites: DataFrame, key: str) -> DataFrame:
    """rows(key, question, answer) with the sentences of rewrites(key, rewrite) that are fit (see rewrite_ok) in place of their answers.

    applied is true for those, false for rows whose sentence was rejected, null for rows without one.
    """
    x = rows.join(rewrites.select(key, F.trim("rewrite").alias("_rewrite")), key, "left")
    applied = F.when(F.col("_rewrite").isNotNull(), F.coalesce(rewrite_ok(F.col("_rewrite"), F.col("answer")), F.lit(False)))
    x = x.withColumn("applied", applied)
    return x.withColumns({"question": F.when(F.col("applied"), F.concat("question", F.lit(SENTENCE_SUFFIX))).otherwise(F.col("question")), "answer": F.when(F.col("applied"), F.col("_rewrite")).otherwise(F.col("answer"))}).drop("_rewrite")


def rewrite_stats(applied: DataFrame, least: float | None = None) -> DataFrame:
    """One row: requested, applied, rejected of apply_rewrites; with least, a smaller share of applied ones is an error when the row is used."""
    n = applied.agg(F.count("applied").alias("requested"), F.count(F.when(F.col("applied"), 1)).alias("applied"), F.count(F.when(~F.col("applied"), 1)).alias("rejected"))
    if least is None:
        return n
    short = F.col("applied") < least * F.col("requested")
    return n.withColumn("applied", F.when(short, F.raise_error(F.lit(f"fewer than {least:.0%} of the rewrites are fit"))).otherwise(F.col("applied")))


#: Fixed value: what a picture's description is asked for.
DESCRIBE_PROMPT = "<image>Describe this image."


def description_requests(rows: DataFrame, image: str) -> DataFrame:
    """The distinct pictures of rows."""
    return rows.filter(F.col(image).isNotNull()).select(image).distinct()


def description_samples(described: DataFrame, image: str, text: str) -> DataFrame:
    """image and messages of the pictures whose text is not blank."""
    own = described.filter(F.trim(text_of(F.col(text))) != "")
    return own.select(image, chat(F.lit(DESCRIBE_PROMPT), F.trim(text)).alias("messages"))


def mcq_eval_prompt(hint: Column, question: Column, options: dict[str, Column]) -> Column:
    """Hint line if any, question, and the options that are there."""
    line = lambda k, c: F.when(~F.lower(F.trim(text_of(c))).isin("", "nan"), F.concat(F.lit(f"{k}. "), F.trim(c)))
    hint_line = F.when(~F.lower(F.trim(text_of(hint))).isin("", "nan"), F.concat(F.trim(hint), F.lit("\n"))).otherwise("")
    return F.concat(hint_line, question, F.lit("\n"), F.concat_ws("\n", *[line(k, c) for k, c in options.items()]), F.lit(MCQ_SUFFIX))


def normalise_refs(df, captions: tuple[str, ...], ids: tuple[str, ...]):
    """item and refs of the first caption and id columns that df has; a single caption becomes a list."""
    cap, key = next(c for c in captions if c in df.columns), next(c for c in ids if c in df.columns)
    refs = F.col(cap) if dict(df.dtypes)[cap].startswith("array") else F.array(F.col(cap))
    return df.select(F.col(key).alias("item"), refs.alias("refs"))


def remap_path(path: Column, prefixes: list[tuple[str, str]], suffix: tuple[str, str] | None = None) -> Column:
    """The first matching prefix replaced; and an extension swapped, or appended if it is not there."""
    out = path
    for old, new in reversed(prefixes):
        out = F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(out)
    if suffix:
        old, new = suffix
        out = F.when(F.endswith(out, F.lit(old)), F.concat(F.substring(out, F.lit(1), F.length(out) - len(old)), F.lit(new))).otherwise(F.concat(out, F.lit(new)))
    return out
