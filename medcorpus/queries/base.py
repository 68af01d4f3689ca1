"""Registration of queries, and views that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.functions.scoring import ABNORMAL, FINDINGS, LUNG, MODALITY, NORMAL_CLAIM
from medcorpus.functions.text import NEGATED, hash_number
from medcorpus.operators.dialogues import turns_to_messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The given tables and the views of them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        view = globals().get(f"_{name}")
        return view(self) if view else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of the tables under its name, with SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def h(*parts) -> object:
    return hash_number(*[F.lit(p) if isinstance(p, (int, str)) else p for p in parts])


def sql_h(*parts: str) -> str:
    """The same number in SQL; parts are SQL expressions."""
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(f"({p})::varchar" for p in parts) + ")), 1, 8))::bigint"


def sql_rank(seed: int, salt: str, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', '{salt}', " + ", ".join(f"({k})::varchar" for k in keys) + "))"


TAGS = ("base", "tuned")
_TAG = "unnest(['base', 'tuned'])"


def _cls(t: Tables) -> DataFrame:
    """tag, item, gold, pred, raw: labels read as yes, no and maybe, with answers that are right more often in the tuned model."""
    gold = F.when(F.col("toxic") == 1, "maybe").when(F.col("quality") == 1, "yes").otherwise("no")
    x = t.labels.select(F.col("doc_id").alias("item"), gold.alias("gold"), F.explode(F.array(*[F.lit(k) for k in TAGS])).alias("tag"))
    other = F.get(F.array(F.lit("yes"), F.lit("no"), F.lit("maybe")), (h("o", F.col("tag"), F.col("item")) % 3).cast("int"))
    x = x.withColumn("pred", F.when(h("p", F.col("tag"), F.col("item")) % 10 < F.when(F.col("tag") == "base", 6).otherwise(8), F.col("gold")).otherwise(other))
    raw = F.when(h("r", F.col("item")) % 4 == 0, F.concat(F.initcap("pred"), F.lit(", because."))).when(h("r", F.col("item")) % 4 == 1, F.concat(F.lit("The answer is "), F.col("pred"))).when(h("r", F.col("item")) % 4 == 2, "unclear").otherwise(F.upper("pred"))
    return x.withColumn("raw", raw)


CLS = f"""cls as (select *, case {sql_h("'r'", "item")} % 4 when 0 then upper(pred[1]) || pred[2:] || ', because.' when 1 then 'The answer is ' || pred when 2 then 'unclear' else upper(pred) end raw from (
    select *, case when {sql_h("'p'", "tag", "item")} % 10 < case tag when 'base' then 6 else 8 end then gold else ['yes', 'no', 'maybe'][{sql_h("'o'", "tag", "item")} % 3 + 1] end pred from (
    select doc_id item, case when toxic = 1 then 'maybe' when quality = 1 then 'yes' else 'no' end gold, {_TAG} tag from labels)))"""


def _vqa(t: Tables) -> DataFrame:
    """tag, item, modality, content, gold, pred: closed questions at even ids, else the first words of the text against later ones."""
    x = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "text", "lang", "source"), "doc_id").withColumn("tag", F.explode(F.array(*[F.lit(k) for k in TAGS])))
    closed, w = F.col("doc_id") % 2 == 0, F.split("text", " ")
    gold = F.when(closed, F.when(F.col("quality") == 1, "yes").otherwise("no")).otherwise(F.array_join(F.slice(w, 1, 3), " "))
    shift = (h("s", F.col("tag"), F.col("doc_id")) % 3).cast("int")
    pred = F.when(closed, F.when(h("v", F.col("tag"), F.col("doc_id")) % 10 < 7, gold).otherwise("No.")).otherwise(F.array_join(F.slice(w, shift + 1, F.lit(3)), " "))
    return x.select("tag", F.col("doc_id").alias("item"), F.col("lang").alias("modality"), F.col("source").alias("content"), closed.alias("closed"), gold.alias("gold"), pred.alias("pred"))


VQA = f"""vqa as (select tag, doc_id item, lang modality, source content, doc_id % 2 = 0 closed, gold, case when doc_id % 2 = 0 then case when {sql_h("'v'", "tag", "doc_id")} % 10 < 7 then gold else 'No.' end
    else array_to_string(w[{sql_h("'s'", "tag", "doc_id")} % 3 + 1 : {sql_h("'s'", "tag", "doc_id")} % 3 + 3], ' ') end pred from (
    select d.doc_id, lang, source, string_split(text, ' ') w, {_TAG} tag, case when d.doc_id % 2 = 0 then case when quality = 1 then 'yes' else 'no' end else array_to_string(string_split(text, ' ')[1:3], ' ') end gold
    from labels join documents d using (doc_id)))"""


def _mcq(t: Tables) -> DataFrame:
    """tag, item, category, gold, pred_raw of the parts table."""
    letter = lambda salt, *k: F.get(F.array(*[F.lit(c) for c in "ABCD"]), (h(salt, *k) % 4).cast("int"))
    x = t.part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category"), "p_type", "p_name", "p_brand", "p_size", F.explode(F.array(*[F.lit(k) for k in TAGS])).alias("tag"))
    x = x.withColumn("gold", letter("g", F.col("item"))).withColumn("letter", F.when(h("m", F.col("tag"), F.col("item")) % 10 < 6, F.col("gold")).otherwise(letter("w", F.col("tag"), F.col("item"))))
    k = h("f", F.col("item")) % 3
    return x.withColumn("pred_raw", F.when(k == 0, F.concat(F.lit("Answer: "), F.col("letter"), F.lit("."))).when(k == 1, F.col("letter")).otherwise("none of these"))


MCQ = f"""mcq as (select *, case {sql_h("'f'", "item")} % 3 when 0 then 'Answer: ' || letter || '.' when 1 then letter else 'none of these' end pred_raw from (
    select *, case when {sql_h("'m'", "tag", "item")} % 10 < 6 then gold else 'ABCD'[{sql_h("'w'", "tag", "item")} % 4 + 1] end letter from (
    select p_partkey item, p_type category, p_type, p_name, p_brand, p_size, {_TAG} tag, 'ABCD'[{sql_h("'g'", "p_partkey")} % 4 + 1] gold from part)))"""


#: Sentences of descriptions.
PHRASES = (
    "The lungs are clear. No evidence of effusion or nodule.", "There is a right pleural effusion and consolidation.", "Normal chest X-ray without pneumonia but the heart is enlarged.", "Within normal limits.",
    "No pneumothorax; the heart size is normal.", "A nodule and mild edema.", "No acute lesion, however a fracture", "absence of fluid although thickening is seen; not visible", "CT of the head: mass ruled out", "Unremarkable. Free of",
)


def _screen(t: Tables) -> DataFrame:
    """item, label, closed, desc: a finding, a yes/no answer, and a description: two of the sentences around the beginning of the document."""
    a = h("c", F.col("doc_id")) % 10
    closed = F.when(a == 9, "unclear").when((a < 7) == (F.col("quality") == 0), "yes").otherwise("no")
    one = lambda salt: F.get(F.array(*[F.lit(p) for p in PHRASES]), (h(salt, F.col("doc_id")) % len(PHRASES)).cast("int"))
    # in plain letters, since engines differ in where words of others begin
    own = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), "[^ -~]", " ")
    desc = F.concat(one("d"), F.lit(" "), own, F.lit(" "), one("e"), F.lit(" Seen in "), F.col("source"), F.lit(" of "), F.col("doc_id").cast("string"), F.lit("."))
    x = t.labels.join(t.documents.select("doc_id", "source", "text"), "doc_id")
    return x.select(F.col("doc_id").alias("item"), (F.col("quality") == 0).cast("int").alias("label"), closed.alias("closed"), desc.alias("desc"))


#: SQL of a text without its negated parts: where they end at the latest is marked first, as this engine's patterns cannot look ahead.
SCRUBBED = lambda x: f"replace(regexp_replace(regexp_replace({x}, '(?i)(\\b(?:but|however|although)\\b|[.;])', chr(1) || '\\1', 'g'), '{NEGATION}[^' || chr(1) || ']*', ' ', 'g'), chr(1), '')"
NEGATION = NEGATED.split("[^.;]*?")[0]
_PHRASE = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
_FOUND = "list_filter([" + ", ".join(f"case when regexp_matches(lower(rest), '{p}') then '{name}' end" for name, p in FINDINGS.items()) + "], lambda x: x is not null)"
SCREEN = f"""screen as (select *, regexp_matches(rest, '{ABNORMAL}') found, regexp_matches(rest, '{LUNG}') lung, regexp_matches("desc", '{NORMAL_CLAIM}') and not regexp_matches({SCRUBBED(f"""regexp_replace("desc", '{NORMAL_CLAIM}', ' ', 'g')""")}, '{ABNORMAL}') normal,
    {_FOUND} findings, regexp_matches(lower("desc"), '{MODALITY["X-Ray"]}') xray, regexp_matches(lower("desc"), 'lung|pleura|heart|chest') chest from (select *, {SCRUBBED('"desc"')} rest from (
    select doc_id item, (quality = 0)::int label, case when {sql_h("'c'", "doc_id")} % 10 = 9 then 'unclear' when ({sql_h("'c'", "doc_id")} % 10 < 7) = (quality = 0) then 'yes' else 'no' end closed, {_PHRASE}[{sql_h("'d'", "doc_id")} % {len(PHRASES)} + 1] || ' '
    || regexp_replace(substr(coalesce(text, ''), 1, 60), '[^ -~]', ' ', 'g') || ' ' || {_PHRASE}[{sql_h("'e'", "doc_id")} % {len(PHRASES)} + 1] || ' Seen in ' || source || ' of ' || doc_id || '.' as "desc" from labels join documents using (doc_id))))"""


def _dialogues(t: Tables) -> DataFrame:
    """conv_id, source, messages without system turns."""
    return turns_to_messages(t.conversations.filter(F.col("role") != "system")).withColumn("source", F.col("conv_id") % 2)


DIALOGUES = """dialogues as (select conv_id, conv_id % 2 source, list({'role': role, 'content': coalesce(text, '')} order by turn, role, text) messages from conversations where role <> 'system' group by conv_id)"""


def _questions(t: Tables) -> DataFrame:
    return t.benchmark.select((F.col("item_id") % 3).alias("source"), "text")


def _reports(t: Tables) -> DataFrame:
    """patient, study, path, frontal, findings, impression: an order is a study, its lines are pictures."""
    docs = t.documents.select(F.col("doc_id").alias("o_orderkey"), "text")
    x = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(docs, "o_orderkey", "left")
    path = F.concat_ws("/", F.col("o_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"))
    impression = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    return x.select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("study"), path.alias("path"), (F.col("l_linenumber") % 2 == 1).alias("frontal"), F.coalesce("text", F.lit("")).alias("findings"), impression.alias("impression"))


REPORTS = """reports as (select o_custkey patient, o_orderkey study, concat_ws('/', o_orderkey, l_partkey, l_suppkey, l_linenumber) path, l_linenumber % 2 = 1 frontal, coalesce(text, '') findings,
    case when o_orderkey % 3 = 0 then '' else o_orderpriority end impression from orders join lineitem on o_orderkey = l_orderkey left join documents on doc_id = o_orderkey)"""


def _labels14(t: Tables, salt: str = "l") -> DataFrame:
    """path and findings f1 to f5 with nofinding, each 1, 0, -1 or null."""
    path = F.concat_ws("/", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    value = lambda k: F.get(F.array(F.lit(1.0), F.lit(0.0), F.lit(-1.0), F.lit(None).cast("double")), (h(salt, k, F.col("path")) % 4).cast("int"))
    return t.lineitem.select(path.alias("path")).distinct().select("path", *[value(k).alias(k) for k in LABELS])


LABELS = ("f1", "f2", "f3", "f4", "f5", "nofinding")


def sql_labels14(name: str, salt: str = "l") -> str:
    return f"{name} as (select path, " + ", ".join(f"([1.0, 0.0, -1.0, null]::double[])[{sql_h(repr(salt), repr(k), 'path')} % 4 + 1] {k}" for k in LABELS) + " from (select distinct concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) path from lineitem))"


def _pairs(t: Tables) -> DataFrame:
    """id, a, b: an even vector with the next odd one."""
    e = t.embeddings
    a = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    return a.join(e.filter("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b")), "id")


PAIRS = "pairs as (select x.vec_id id, x.embedding::double[] a, y.embedding::double[] b from embeddings x join embeddings y on y.vec_id = x.vec_id + 1 where x.vec_id % 2 = 0)"


def _captions(t: Tables) -> DataFrame:
    """item, pred, refs: the first sentence of each text against all others."""
    s = F.split("text", r"\.")
    return t.documents.select(F.col("doc_id").alias("item"), F.get(s, F.lit(0)).alias("pred"), F.filter(F.slice(s, F.lit(2), F.size(s)), lambda x: F.trim(x) != "").alias("refs"))


CAPTIONS = "captions as (select doc_id item, string_split(text, '.')[1] pred, list_filter(string_split(text, '.')[2:], lambda x: trim(x) <> '') refs from documents)"


def _log(t: Tables) -> DataFrame:
    """tag, step, total, loss: events in order as steps of a run."""
    from medcorpus.operators.reports import numbered

    return numbered(t.events.select(F.col("event_type").alias("tag"), "ts", "event_id", F.col("value").alias("loss")), ["tag"], ["ts", "event_id"], "step", "total").select("tag", "step", "total", "loss")


LOG = "log as (select event_type tag, row_number() over (partition by event_type order by ts, event_id) step, count(*) over (partition by event_type) total, value loss from events)"


def with_(*views: str) -> str:
    return "with " + ", ".join(views) + " "
