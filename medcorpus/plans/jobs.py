"""The jobs of the library from end to end."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medcorpus.functions import text as T
from medcorpus.functions.text import rank_key
from medcorpus.operators import chunking, dedupe, dialogues, isolation, records, reports, sampling
from medcorpus.sources import readers
from medcorpus.storage import spread, stored


#: The fields of a guideline file.
GUIDELINE = "id string, source string, title string, clean_text string"


def read_corpus(spark: SparkSession, books: dict[str, str], guidelines: dict[str, str], archives: dict[str, tuple[str, str, bool]], ads: str | None = None, ads_share: float | None = None) -> DataFrame:
    """source, doc_id, text of a corpus's files, by the name of each source: folders of texts, JSON of guidelines, and archives (path, prefix of the members, whether promotion goes).

    Books lose attribution lines; a guideline has 200 characters at least and its title in front; ads and ads_share: what is taken for promotion, if not what looks_like_ad takes.
    """
    out = [readers.read_text_docs(spark, path).select(F.lit(name).alias("source"), "doc_id", T.strip_attribution(F.col("text")).alias("text")) for name, path in books.items()]
    for name, path in guidelines.items():
        rows = chunking.min_length_docs(readers.read_json_any(spark, path, GUIDELINE), "title", "clean_text")
        known = lambda c: F.coalesce(F.col(c), F.lit("?"))
        out.append(rows.select(F.lit(name).alias("source"), F.concat(known("source"), F.lit("/"), known("id")).alias("doc_id"), "text"))
    is_ad = T.looks_like_ad(F.col("text"), *([ads, ads_share] if ads else []))
    for name, (path, prefix, drop_ads) in archives.items():
        rows = readers.read_zip_members(spark, path, prefix, ".txt").select(F.lit(name).alias("source"), F.substring_index("name", "/", -1).alias("doc_id"), "text")
        out.append(rows.filter(~is_ad) if drop_ads else rows)
    return reduce(DataFrame.unionByName, out)


def report_pool(spark: SparkSession, path: str, schema: str, subset: DataFrame, n: int, seed: int, frontal: str = "Frontal") -> tuple[DataFrame, DataFrame]:
    """n seeded patients' studies of a table of reports in files, and a funnel (step, n) of its rows, studies and patients.

    The table has patient, study, path, view, findings and impression; a patient of subset(patient, image_path, path) is left out, and the one root of
    subset's pictures is put before the paths. Of a study the first frontal picture counts, of a patient one study.
    """
    root = readers.common_path_root(subset, "image_path", "path")
    table = readers.read_reports_csv(spark, path, schema, "path")
    out = subset.select("patient").distinct().withColumn("_out", F.lit(True))
    own = F.when(F.coalesce(F.trim("view") != frontal, F.lit(True)), "not frontal").when(~records.has_sections(F.col("findings"), F.col("impression")), "empty")
    # texts are looked at before rows meet the patients, and stay where they are until it is known whose are wanted
    keys = table.select("patient", "study", "path", own.alias("own"))
    rows = stored(keys.join(out, "patient", "left").select("patient", "study", "path", F.coalesce("own", F.when(F.col("_out"), "excluded")).alias("step")))
    studies = stored(dedupe.dedupe_first(rows.filter("step is null").drop("step"), ["patient", "study"], ["path"]))
    # of known size when it meets the texts: so few go to all tasks, and no text is moved for them
    chosen = stored(studies.join(sampling.one_per_subject(studies, "patient", "study", n, seed), ["patient", "study"], "left_semi"))
    text = records.report_text(F.col("findings"), F.col("impression"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("patient", "study", "path")]
    fit = table.filter((F.trim("view") == frontal) & records.has_sections(F.col("findings"), F.col("impression"))).alias("t")
    own = fit.join(chosen.alias("c"), same, "left_semi").select("patient", "study", "path", text.alias("text"))
    chosen = stored(dedupe.dedupe_first(own, ["patient", "study"], ["path"]).withColumn("image_path", F.concat(F.lit(root), "path")))
    counts = rows.groupBy(F.coalesce("step", F.lit("candidate")).alias("step")).agg(F.count("*").alias("n"))
    more = studies.agg(F.count("*").alias("study"), F.count_distinct("patient").alias("patient")).join(chosen.agg(F.count("*").alias("chosen")))  # two tables of one row
    funnel = counts.unionByName(more.select(F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.col(k).alias("n")) for k in ("study", "patient", "chosen")]))))
    return chosen, funnel


def clean_corpus(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    """Documents without attribution, promotion and page remains, long enough, the first of each text."""
    # exploded: a filter on a column that is worked out would work it out once more
    own = docs.filter(~T.looks_like_ad(F.col("text"))).withColumn("text", F.explode(F.array(T.clean_text(T.strip_attribution(F.col("text"))))))
    own = own.filter(F.length("text") >= min_chars).withColumn("_digest", F.sha2(F.col("text").cast("binary"), 256))
    return dedupe.dedupe_first(own, ["_digest"], ["doc_id"]).drop("_digest")


def build_corpus(docs: DataFrame, questions: DataFrame, frac: float, limit: int, budget: int, seed: int) -> DataFrame:
    """Chunks of a clean corpus that the evaluation does not touch, within a budget a source, with their split.

    What is read more than once is a table in the shared folder: the cleaned documents, and the chunks, of which budget and split first
    read the counts alone.
    """
    clean = stored(clean_corpus(spread(docs)))
    chunks = stored(chunking.pack_chunks(isolation.decontaminate(clean, "doc_id", "text", questions, frac), limit))
    return sampling.val_split_by_document(chunking.take_token_budget(chunks, budget, seed), 0.01, seed)


def fill_targets(rows: DataFrame, targets: dict[str, int], oversample: float, seed: int, once: bool = False) -> DataFrame:
    """Each source's first target fit rows of its seeded pool, of rows(source, id, reason, late_reason, messages) and, if once, key.

    Returns rows with reason (null: fit), kept, and seen: whether the pool was read so far before the target was reached. once: a row whose key
    an earlier kept row of any source has is a duplicate; that comes after reason and before late_reason. A source's pool is
    target * oversample rows, so its order fits one task.
    """
    taken, out = None, []
    for k, (name, target) in enumerate(targets.items()):
        own = sampling.sample_n(rows.filter(F.col("source") == name), int(target * oversample), seed + k, "id", salt="pool")
        pool = own.withColumn("_at", F.struct(rank_key(seed + k, "pool", F.col("id")).alias("rank"), F.col("id").alias("id")))
        is_late = F.lit(False)
        if once:
            fit = pool.filter("reason is null and late_reason is null")
            pool = pool.join(fit.groupBy("key").agg(F.min("_at").alias("_first")), "key", "left")
            is_late = F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))
            if taken is not None:
                pool = pool.join(taken.withColumn("_taken", F.lit(True)), "key", "left")
                is_late = is_late | F.coalesce("_taken", F.lit(False))
        pool = pool.withColumn("reason", F.coalesce("reason", F.when(is_late, "duplicate"), "late_reason"))
        fit = F.col("reason").isNull()
        pool = pool.withColumn("_n", F.sum(fit.cast("int")).over(W.orderBy("_at").rowsBetween(W.unboundedPreceding, 0)))
        pool = pool.withColumns({"seen": (F.col("_n") < target) | (fit & (F.col("_n") == target)), "kept": fit & (F.col("_n") <= target)})
        part = pool.select(*[c for c in rows.columns if c != "late_reason"], "seen", "kept")
        part = stored(part)
        if once:
            keys = part.filter("kept").select("key")
            taken = keys if taken is None else taken.unionByName(keys)
        out.append(part)
    return reduce(DataFrame.unionByName, out)


def build_dialogues(
    turns: DataFrame, questions: DataFrame, targets: dict[str, int], limit: int, seed: int, oversample: float = 3.0, rounds: int = 3,
    user_chars: int = 4, assistant_chars: int = 10, counts: Callable[[Column], Column] = T.token_counts,
) -> DataFrame:
    """conv_id, source, reason, seen, kept, messages of turns(source, conv_id, turn, role, text): dialogues that pass every test, up to each source's target.

    A dialogue is out if any of its user turns is contaminated, or if an earlier kept dialogue of any source begins with the same question.
    """
    df = dialogues.turns_to_messages(turns.filter(F.col("role") != "system"), "source", "conv_id")
    cut, reason = dialogues.drop_reason(F.col("messages"), rounds, user_chars, assistant_chars)
    df = df.select("source", F.col("conv_id").alias("id"), cut.alias("messages"), reason.alias("reason"))
    asked = df.select("id", F.explode("messages").alias("m")).filter("m.role = 'user'").select("id", F.col("m.content").alias("text"))
    hit = isolation.contaminated_keys(asked, "id", "text", questions).withColumn("_hit", F.lit(True))
    df = df.join(hit, "id", "left").withColumn("_fit", dialogues.trim_rounds(F.col("messages"), limit, counts))
    late = F.when(F.col("_hit"), "contaminated").when(F.col("_fit").isNull(), "long")
    key = T.norm_key(F.get("messages", F.lit(0))["content"])
    df = df.select("source", "id", "reason", late.alias("late_reason"), key.alias("key"), F.col("_fit").alias("messages"))
    return fill_targets(df, targets, oversample, seed, once=True).select(F.col("id").alias("conv_id"), "source", "reason", "seen", "kept", "messages")


def build_exam_rows(rows: DataFrame, questions: DataFrame, targets: dict[str, int], limit: int, seed: int, oversample: float = 3.0, counts: Callable[[Column], Column] = T.token_counts) -> DataFrame:
    """id, source, reason, seen, kept, messages of rows(source, id, question, messages, reason): exam items that pass every test, up to each source's target.

    reason is that of the record builder (see operators.records); then come personal data in the answer, contamination of the question, and length.
    """
    hit = isolation.contaminated_keys(rows, "id", "question", questions).withColumn("_hit", F.lit(True))
    answer = F.element_at("messages", -1)["content"]
    late = F.when(T.has_pii(answer), "pii").when(F.col("_hit"), "contaminated").when(dialogues.message_cost(F.col("messages"), counts) > limit, "long")
    df = rows.join(hit, "id", "left").select("source", "id", "reason", late.alias("late_reason"), "messages")
    return fill_targets(df, targets, oversample, seed).select("id", "source", "reason", "seen", "kept", "messages")


def select_reports(rows: DataFrame, excluded: DataFrame, n: int, seed: int) -> DataFrame:
    """patient, study, path, text of n seeded patients outside an excluded cohort: one study each, first frontal picture."""
    own = isolation.drop_shared(rows.filter("frontal"), excluded, ["patient"])
    first = dedupe.dedupe_first(own, ["patient", "study"], ["path"])
    chosen = sampling.one_per_subject(first, "patient", "study", n, seed)
    return first.join(chosen, ["patient", "study"], "left_semi")


def answer_report(preds: DataFrame) -> DataFrame:
    """Scores of stored answers by model, and by model and modality."""
    from medcorpus.functions import scoring as S

    p, g = F.col("pred"), F.col("gold")
    scored = preds.select("tag", "modality", S.yes_no(g).isin("yes", "no").alias("closed"), S.closed_score(p, g).alias("closed_score"), S.exact_match(p, g).alias("em"), S.token_recall(p, g).alias("recall"), S.token_f1(p, g).alias("f1"))
    return reports.vqa_report(scored)
