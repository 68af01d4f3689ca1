"""Dialogues: turn tables, their cleaning, and budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medcorpus.functions.text import IMAGE_WORDS, has_pii, let, looks_like_promo, strip_html, token_counts

#: Tokens that a template adds to each message.
TEMPLATE_TOKENS = 12


def turns_to_messages(turns: DataFrame, *key: str) -> DataFrame:
    """key (conv_id if none is given) and messages (role, content) in the order of turn; one shuffle."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    return turns.groupBy(*(key or ("conv_id",))).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def messages_to_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """The turns of messages, numbered from 0."""
    return df.select(key, F.posexplode("messages").alias("turn", "m")).select(key, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def parse_prefixed_turns(data: Column) -> Column:
    """Messages of a list of prefixed lines, question and answer in turn."""
    content = lambda x: strip_html(F.regexp_replace(F.trim(x), "^(问|答)[：:]", ""))
    return F.transform(data, lambda x, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), content(x).alias("content")))


def valid_dialogue(messages: Column) -> Column:
    """At least two messages, question and answer strictly in turn."""
    turn = F.forall(F.transform(messages, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda ok: ok)
    return (F.size(messages) >= 2) & (F.size(messages) % 2 == 0) & turn


def drop_reason(messages: Column, max_rounds: int = 3, user_chars: int = 4, assistant_chars: int = 10) -> tuple[Column, Column]:
    """The dialogue cut to max_rounds, and the first reason to drop it (null: none)."""
    cut = F.slice(messages, 1, 2 * max_rounds)
    short = F.exists(cut, lambda m: F.length(m["content"]) < F.when(m["role"] == "user", user_chars).otherwise(assistant_chars))
    text = F.array_join(F.transform(cut, lambda m: m["content"]), "\n")
    image = F.exists(cut, lambda m: (m["role"] == "user") & m["content"].rlike(IMAGE_WORDS))
    reason = F.when(~valid_dialogue(messages), "format").when(short, "short").when(has_pii(text), "pii").when(looks_like_promo(text), "promo").when(image, "image")
    return cut, reason


def message_costs(messages: Column, counts: Callable[[Column], Column] = token_counts) -> Column:
    """Tokens of each message of a rendered dialogue; counts: tokens of an array of texts (see functions.text.counter)."""
    return F.transform(counts(F.transform(messages, lambda m: m["content"])), lambda n: n + TEMPLATE_TOKENS)


def message_cost(messages: Column, counts: Callable[[Column], Column] = token_counts) -> Column:
    """Tokens of a rendered dialogue."""
    return F.aggregate(message_costs(messages, counts), F.lit(0), lambda a, n: a + n)


def trim_rounds(messages: Column, limit: int, counts: Callable[[Column], Column] = token_counts) -> Column:
    """The most whole rounds from the start that fit the limit, or null if the first does not."""
    # costs are positive, so the rounds that fit are those whose running sum does
    run = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(0).alias("fit"))
    step = lambda a, n: F.struct((a["n"] + 1).alias("n"), (a["sum"] + n).alias("sum"), F.when(((a["n"] + 1) % 2 == 0) & (a["sum"] + n <= limit), a["n"] + 1).otherwise(a["fit"]).alias("fit"))
    fit = F.aggregate(message_costs(messages, counts), run, step, lambda a: a["fit"])
    return let(fit, lambda k: F.when(k > 0, F.slice(messages, F.lit(1), k)))


def drop_reason_stats(df: DataFrame, source: str, reason: str) -> DataFrame:
    """Rows by source and reason (kept: null)."""
    return df.groupBy(source, F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def target_stats(df: DataFrame, totals: DataFrame, targets: dict[str, int], part: str | None = None) -> DataFrame:
    """source, total, pool, kept, target, dropped, rounds, parts of a job's rows (source, reason, kept, seen, messages).

    totals(source, total): rows before the pool was drawn. Drops are counted up to the row with which a source reached its target. dropped,
    rounds and parts are maps of counts: by reason, by rounds of the kept dialogues, and by a column of sub-sources if one is given.
    """
    kinds = [(F.lit("dropped"), F.when(F.col("seen"), F.col("reason"))), (F.lit("rounds"), F.when(F.col("kept"), F.floor(F.size("messages") / 2).cast("string")))]
    kinds += [(F.lit("parts"), F.when(F.col("kept"), F.col(part).cast("string")))] if part else []
    counted = df.select("source", F.explode(F.array(*[F.struct(k.alias("kind"), v.alias("value")) for k, v in kinds])).alias("x")).filter("x.value is not null")
    counted = counted.groupBy("source", "x.kind", "x.value").agg(F.count("*").alias("n"))
    # a handful of reasons, rounds and sub-sources
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "n"))))).alias(kind)
    maps = counted.groupBy("source").agg(of("dropped"), of("rounds"), of("parts"))
    sizes = df.groupBy("source").agg(F.count("*").alias("pool"), F.count(F.when(F.col("kept"), 1)).alias("kept"))
    target = F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("source")).alias("target")
    return totals.join(sizes, "source", "left").join(maps, "source", "left").select("source", "total", F.coalesce("pool", F.lit(0)).alias("pool"), F.coalesce("kept", F.lit(0)).alias("kept"), target, "dropped", "rounds", "parts")


def restricted_source(df: DataFrame, source: str, restricted: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all but a restricted sub-source (a missing source is none), and n_dropped: how many rows that leaves out."""
    is_restricted = F.col(source).eqNullSafe(F.lit(restricted))
    return df.filter(~is_restricted), df.agg(F.count(F.when(is_restricted, 1)).alias("n_dropped"))


def loss_spans(messages: Column, cutoff: int, counts: Callable[[Column], Column] = token_counts) -> Column:
    """(text, trained) spans of a rendered dialogue: assistant turns are trained through their end mark; rounds beyond the cutoff are cut; null without a trained span."""
    kept = trim_rounds(messages, cutoff, counts)
    spans = F.flatten(F.transform(kept, lambda m: F.array(
        F.struct(F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n")).alias("text"), F.lit(False).alias("trained")),
        F.struct(F.concat(m["content"], F.lit("<|im_end|>\n")).alias("text"), (m["role"] == "assistant").alias("trained")),
    )))
    return F.when(F.exists(spans, lambda s: s["trained"]), spans)


def truncate_lm(text: Column, cutoff: int, end: str = "</s>") -> tuple[Column, Column]:
    """At most cutoff - 1 words and an end mark, and whether any was cut."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.concat(F.slice(w, 1, cutoff - 1), F.array(F.lit(end))), F.size(w) > cutoff - 1
