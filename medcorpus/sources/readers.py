"""Readers and writers of corpora, reports and predictions."""

from __future__ import annotations

import re
import uuid
import warnings

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from medcorpus import storage
from medcorpus.sources import archives, ranges
from medcorpus.storage import spread


def _ddl(schema: StructType | str) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _closed(begins: DataFrame) -> DataFrame:
    """begins, if every file's quotes are even."""
    if n := begins.filter("odd").select("file").distinct().count():
        raise ValueError(f"{n} files end inside quotes")
    return begins


def read_json_any(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """The objects of JSON files, each an array of objects or lines of them; which one is seen file by file from the first character that is not blank.

    Lines are read by Spark's own reader. An array is cut into objects where its braces close, range by range, so one large
    file is many tasks. Objects that do not fit the schema are null in what does not fit, as in Spark's reader.
    """
    begin = F.col("value").substr(1, 4096)
    first = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), begin.alias("value"), F.monotonically_increasing_id().alias("n"))
    # what a file begins with is in its first piece
    firsts = first.filter("block = 0").groupBy("path").agg(F.min_by("value", "n").alias("value"))
    arrays = {r["path"]: r["many"] for r in firsts.select("path", F.regexp_like("value", F.lit(r"^[\s\x{FEFF}]*\[")).alias("many")).collect()}
    many, lines = [p for p, x in arrays.items() if x], [p for p, x in arrays.items() if not x]
    out = spark.read.schema(schema).json(lines)
    if many:
        begins = _closed(ranges.begin_states(spark, many, "}", ranges.brace_sums))
        text = F.col("text")
        found = ranges.records(spark, many, "}", ranges.braces, begins, closing="}").select(F.substring(text, F.locate("{", text), F.length(text)).alias("text"))
        objects = found.select(F.from_json("text", _ddl(schema)).alias("r")).select("r.*")
        out = out.unionByName(objects) if lines else objects
    return out


def read_reports_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, path_col: str | None = None, null: str = "") -> DataFrame:
    """A table with quoted text over several lines; a leading slash of path_col goes. null: what stands for a missing value; if that is not the empty text, an empty text in quotes is one.

    A line feed ends a row where the quotes before it are even, so a large file is cut into ranges and read by many tasks. That asks for
    quotes as RFC 4180 has them (around a field, doubled inside it); a file that ends inside quotes is an error.
    """
    begins = _closed(ranges.begin_states(spark, path, "\n", ranges.quote_sums))
    rows = ranges.records(spark, path, "\n", ranges.quoted_line, begins).filter("not first")
    text = F.when(F.endswith("text", F.lit("\r")), F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    # the parser leaves zero characters out, so they go through it as a hash of the row
    zero, has = F.lit("\0"), F.contains("text", F.lit("\0"))
    mark = F.when(has, F.concat(F.lit("<"), F.sha2(F.col("text").cast("binary"), 256), F.lit(">")))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "nullValue": null}
    parsed = rows.filter(F.trim("text") != "").select(F.from_csv(F.when(has, F.replace(text, zero, mark)).otherwise(text), _ddl(schema), options).alias("r"), mark.alias("_mark"))
    back = lambda c: F.when(F.col("_mark").isNotNull(), F.replace(c, F.col("_mark"), zero)).otherwise(c)
    df = parsed.select(*[(back(F.col("r")[f.name]) if isinstance(f.dataType, StringType) else F.col("r")[f.name]).alias(f.name) for f in parsed.schema["r"].dataType.fields])
    return df.withColumn(path_col, F.regexp_replace(F.trim(path_col), "^/+", "")) if path_col else df


def without_bad_bytes(text: Column) -> Column:
    """The text without the bytes that are not UTF-8. A replacement character that was there stays: it is written as a hash while the bad bytes become such characters."""
    bad, mark = F.lit("\ufffd"), F.concat(F.lit("<"), F.sha2(text.cast("binary"), 256), F.lit(">"))
    held = F.replace(F.make_valid_utf8(F.replace(text, bad, mark)), bad, F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(held, mark, bad))


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (folder/stem) and text, a document a file; bytes that are not UTF-8 are left out, and files without any byte. A task takes as many files as its bytes allow."""
    file = F.col("_metadata.file_path")
    doc_id = F.regexp_extract(F.url_decode(file), r"([^/]+/[^/]+?)(\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(doc_id.alias("doc_id"), without_bad_bytes(F.col("value")).alias("text"))


def write_text_docs(df: DataFrame, path: str, folder: str, stem: str, text: str) -> int:
    """Writes every row as a file of its own under path, <folder>/<stem>_<part>_<row>.txt, and returns their number.

    The tasks write the files themselves, in a store that pyarrow.fs knows by its URI: Spark's own writer opens, checks in and renames each file as
    if it were a table's. A file is moved to its name when it is whole, and a task that runs again writes the same names. Folder and stem must be fit for file names; null ones are empty.
    """
    at, system = storage._at(df.sparkSession, path)
    uri = re.sub("^file:/+", "file:///", system.makeQualified(at).toString())
    draft = uuid.uuid4().hex

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(uri)
        n, made = 0, set()
        for b in batches:
            for rows in (b.slice(k, 200) for k in range(0, b.num_rows, 200)):
                for own, name, value in zip(*[x.to_pylist() for x in rows.columns], strict=True):
                    to = f"{root}/{own or ''}".rstrip("/")
                    if to not in made:
                        store.create_dir(to)
                        made.add(to)
                    part = f"{to}/_{draft}-{task.taskAttemptId()}"
                    with store.open_output_stream(part) as out:
                        out.write((value or "").encode())
                    store.move(part, f"{to}/{name or ''}_{task.partitionId()}_{n}.txt")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    own = df.select(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate((folder, stem, text))])
    return spread(own).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_zip_members(spark: SparkSession, path: str | list[str], prefix: str = "", suffix: str = ".txt", strict: bool = True) -> DataFrame:
    """name and text of archives' members, with many tasks an archive (see sources.archives).

    strict: a member that is listed but cannot be read is an error that names it; else it has no text and the column problem says why.
    """
    found = archives.zip_members(spark, path, prefix, suffix)
    if not strict:
        return found.select("name", "text", "problem")
    said = F.raise_error(F.concat(F.lit("member "), "name", F.lit(" of "), "archive", F.lit(": "), "problem"))
    return found.select("name", F.when(F.col("problem").isNotNull(), said).otherwise(F.col("text")).alias("text"))


def read_parquet_source(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of Parquet files; the others are not read."""
    return spark.read.parquet(path).select(*columns)


def read_predictions(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """test, tag and the rows of all ``<test>_<tag>_preds.jsonl`` (files, or folders of part files) that pattern matches; a missing one is no error."""
    name = F.url_decode(F.col("_metadata.file_path"))
    df = spark.read.schema(schema).json(pattern)
    part = lambda k: F.regexp_extract(name, r"([^/_=]+)_([^/]+)_preds\.jsonl(?:/[^/]*)?$", k)
    return df.select(part(1).alias("test"), part(2).alias("tag"), *[F.col(c) for c in df.columns])


def write_training_set(df: DataFrame, folder: str, name: str, registry: str, fmt: str = "parquet", roles: dict | None = None) -> dict:
    """Writes rows under a name and enters them in the registry, where other names stay as they are.

    Rows go to a new folder; the entry is the one step that makes them visible, so the set before is whole until then.
    """
    return storage.write_version(df, f"{folder}/{name}", f"{registry}/{name}", fmt, {"name": name, "roles": roles or {}})


def read_registry(spark: SparkSession, registry: str) -> DataFrame:
    """name, path, format, columns, roles of the newest entry of each name."""
    each = spark.read.schema("name string, path string, format string, columns array<string>, roles map<string, string>").json(f"{registry}/*/entry-*.json")
    rest = ["path", "format", "columns", "roles"]
    newest = each.groupBy("name").agg(F.max_by(F.struct(*rest), F.col("_metadata.file_name")).alias("r"))
    return newest.select("name", *[f"r.{c}" for c in rest])


def read_training_set(spark: SparkSession, registry: str, name: str) -> DataFrame:
    """The rows that were last entered under a name."""
    entry = storage.last_version(spark, f"{registry}/{name}")
    if entry is None:
        raise ValueError(f"no training set {name}")
    return storage.read_entry(spark, entry)


def check_expected_counts(df: DataFrame, source: str, expected: DataFrame) -> DataFrame:
    """source, n, expected, ok for every source of either; expected(source, expected)."""
    found = df.groupBy(source).agg(F.count("*").alias("n"))
    out = found.join(expected, source, "full")
    return out.select(source, F.coalesce("n", F.lit(0)).alias("n"), "expected", (F.coalesce("n", F.lit(0)).eqNullSafe(F.col("expected"))).alias("ok"))


def require_expected_counts(df: DataFrame, source: str, expected: DataFrame, allow: bool = False) -> DataFrame:
    """df, if every source has its expected number of rows; else an error that names the first ten wrong ones, or a warning if allowed."""
    wrong = check_expected_counts(df, source, expected).filter("not ok").orderBy(source).limit(10).collect()
    if wrong:
        said = "wrong numbers of rows: " + ", ".join(f"{r[source]}: {r['n']} of {r['expected']}" for r in wrong)
        if not allow:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return df


def common_path_root(df: DataFrame, absolute: str, relative: str) -> str:
    """The one root of absolute paths that end with their relative one; none or several are an error."""
    roots = infer_path_root(df, absolute, relative).orderBy(F.desc("n"), "root").limit(2).collect()
    if len(roots) != 1:
        raise ValueError("no common root: " + (", ".join(r["root"] for r in roots) or "no path ends with its relative one"))
    return roots[0]["root"]


def infer_path_root(df: DataFrame, absolute: str, relative: str) -> DataFrame:
    """root and n of absolute paths that end with their relative one; more than one row means that there is no common root."""
    root = F.substring(F.col(absolute), F.lit(1), F.length(absolute) - F.length(relative))
    return df.filter(F.endswith(F.col(absolute), F.col(relative))).groupBy(root.alias("root")).agg(F.count("*").alias("n"))


def load_vqa_split(df: DataFrame, root: str, lang: str = "en") -> DataFrame:
    """Rows of one language (a missing one is English) with the picture's path under root."""
    own = df.filter(F.lower(F.coalesce("q_lang", F.lit("en"))) == lang)
    return own.withColumn("image", F.concat(F.lit(root.rstrip("/") + "/"), F.col("img_name")))
