"""Sources and sinks: CSV with JSON cells, JSON lines, single records, run globs, idempotent appends, keyed exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

NESTED = (ArrayType, MapType, StructType)
# The archive's core schemas.
DOCUMENT = "document_id string, source_id string, dataset string, modality string, raw_text string, title string, summary string, source_metadata map<string,string>, created_at string"
SPAN = "entity_type string, text string, start int, end int, sensitivity_level string, masking_strategy string"
CHUNK = f"chunk_id string, document_id string, source_id string, dataset string, modality string, chunk_index int, raw_text string, masked_text string, embedding_text string, title string, summary string, topic string, sensitivity_level string, sensitive_entities array<struct<{SPAN.replace(' string', ':string').replace(' int', ':int')}>>, access_level string, source_metadata map<string,string>, dense_vector_ready boolean, sparse_vector_ready boolean"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_csv(spark: SparkSession, path: str, schema: str, json_columns: dict[str, str] | None = None, columns: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """CSV with quoted line breaks; named cells are decoded from JSON, a cell that doesn't parse becomes null beside its raw
    text in ``<name>_raw``; headers may carry role suffixes (``:ID(X)``, ``:int``), which are stripped; blanks and the
    literal NaN are null. Only the wanted columns are read."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.split(":")[0] for c in rows.columns])
    rows = rows.select(*[F.when(~F.trim(c).isin("", "NaN", "nan"), F.col(c)).alias(c) for c in rows.columns])
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    wanted = columns or list(kinds)
    out = []
    for c in wanted:
        if c not in rows.columns:
            out.append(F.lit(None).cast(kinds[c]).alias(c))
        elif c in (json_columns or {}):
            out += [F.from_json(c, json_columns[c]).alias(c), F.col(c).alias(f"{c}_raw")]
        elif kinds[c].simpleString() == "boolean":
            out.append(F.lower(F.trim(c)).isin("true", "1", "yes", "y", "t").alias(c))
        else:
            out.append(F.col(c).try_cast(kinds[c]).alias(c))
    got = rows.select(*out)
    return got.withColumnsRenamed(rename or {})


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f.name) for f in rows.schema.fields]
    rows.select(*cells).write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """JSON lines under a declared schema; blank and broken lines are dropped; a missing path is an empty table."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """NaN becomes null, nulls are kept as keys."""
    cells = [F.nullif(F.col(f.name), F.lit(float("nan"))).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in rows.schema.fields]
    rows.select(*cells).write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def read_record(spark: SparkSession, path: str) -> dict:
    """One JSON object; an absent file is an empty one."""
    if not exists(spark, path):
        return {}
    row = spark.read.option("multiLine", True).json(path).limit(1).collect()
    return row[0].asDict(recursive=True) if row else {}


def read_runs(spark: SparkSession, pattern: str, schema: str, queries: int | None = None) -> DataFrame:
    """Frozen runs: a file per strategy; completed records only, the last of each query, results one per row. With
    ``queries``, only the first so many different queries of each strategy, in the order of the file."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], "strategy string, query_id string, chunk_id string, rank int, score double")
    rows = spark.read.schema(schema).json(pattern).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:_[^_/]*)?\.jsonl?$", 1).alias("strategy"), F.monotonically_increasing_id().alias("line"))
    w = Window.partitionBy("strategy", "query_id").orderBy(F.desc("line"))
    done = rows.where("status = 'completed'")
    last = done.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    if queries is not None:
        seen = done.groupBy("strategy", "query_id").agg(F.min("line").alias("at"))
        early = Window.partitionBy("strategy").orderBy("at")
        kept = seen.withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= queries)
        last = last.join(kept.select("strategy", "query_id"), ["strategy", "query_id"], "left_semi")
    return last.select("strategy", "query_id", F.posexplode("results").alias("p", "x")).select("strategy", "query_id", "x.chunk_id", (F.col("p") + 1).alias("rank"), "x.score")


def append_new(rows: DataFrame, path: str, key: list[str]) -> int:
    """Idempotent append: rows whose key the table already has are left out. Returns how many were written."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(key)
    try:
        done = spark.read.parquet(path).select(*key).distinct()
        fresh = fresh.join(done, key, "left_anti")
    except AnalysisException:
        pass  # the table does not exist yet
    observed = fresh.persist()
    n = observed.count()
    if n:
        observed.write.mode("append").parquet(path)
    observed.unpersist()
    return n


def cached_result(cache: DataFrame, k: int) -> DataFrame:
    """Per query the largest stored result list of at least ``k``, ties to the latest line, cut to ``k``."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.size("results")), F.desc("line"))
    return cache.where(F.size("results") >= k).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("query_id", F.slice("results", 1, k).alias("results"))


def unique_violations(rows: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness; empty if the constraint holds."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def within_bytes(rows: DataFrame, text: str, limit: int, order: str) -> DataFrame:
    """The first rows, in the order of ``order``, whose texts together have at most ``limit`` bytes. Ranges of rows are
    summed first, so no task sees all."""
    sized = rows.withColumn("_b", F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint"))
    numbered = sized.orderBy(order).withColumn("_p", F.spark_partition_id())
    sums = numbered.groupBy("_p").agg(F.sum("_b").alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_b").over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("_own", own).join(before, "_p").where(F.col("_own") + F.col("_before") <= limit).select(*rows.columns)


def row_count(rows: DataFrame) -> int:
    """Rows as records, whatever line breaks their cells hold."""
    return rows.count()


def read_splits(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Records of several splits, a path of JSON each (an array or one per line, packed or not), with their ``split``. A path
    that does not exist falls back to the same with ``.jsonl`` and then to none; zip archives are opened by Spark's binary
    reader, one file a task."""
    out = None
    for name, path in paths.items():
        found = next((p for p in (path, f"{path}.jsonl", f"{path}.json") if exists(spark, p)), None)
        if found is None:
            continue
        rows = unzipped(spark, found, schema) if found.endswith(".zip") else spark.read.schema(schema).option("multiLine", not found.endswith(".jsonl")).json(found)
        rows = rows.withColumn("split", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], schema + ", split string")


def unzipped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of the files in zip archives."""

    def run(batches):
        import io
        import json
        import zipfile

        import pandas as pd

        for batch in batches:
            for blob in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for name in z.namelist():
                        if not name.endswith((".json", ".jsonl")):
                            continue
                        text = z.read(name).decode("utf-8")
                        try:
                            value = json.loads(text)
                            records = value if isinstance(value, list) else [value]
                        except ValueError:
                            records = [json.loads(line) for line in text.splitlines() if line.strip()]
                        yield pd.DataFrame({"r": [json.dumps(r, ensure_ascii=False) for r in records]})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "r string")
    return raw.select(F.from_json("r", schema).alias("r")).select("r.*")


def read_judgments(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Judgment logs, a folder per judge and a file per strategy; a file with more than one judge is an error. Of each
    (judge, strategy, query, chunk, rank) the last usable record counts, else the last."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], schema + ", strategy string")
    rows = spark.read.schema(schema).json(pattern).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    mixed = rows.where("judge_model is not null").groupBy("_file").agg(F.count_distinct("judge_model").alias("n")).where("n <> 1").limit(1).collect()
    if mixed:
        raise ValueError(f"expected one judge in {mixed[0]['_file']}, found {mixed[0]['n']}")
    rows = rows.withColumn("strategy", F.regexp_extract("_file", r"([^/]+?)(?:_judgments)?\.jsonl?$", 1))
    ok = F.coalesce(F.col("relevance_score").between(0, 3), F.lit(False)).cast("int")
    w = Window.partitionBy("judge_model", "strategy", "query_id", "chunk_id", "rank").orderBy(F.desc(ok), F.desc("_line"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_file", "_line")


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON object as one file in the folder ``path``; ``read_record`` gives it back."""
    import json

    spark.createDataFrame([(json.dumps(record, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_result(results: DataFrame, path: str, config: str) -> None:
    """Ranked results (query_id, chunk_id, rank, score) appended to the cache of a configuration: one row per query with its
    list, under a folder of the configuration's key."""
    row = F.struct("rank", "chunk_id", "score")
    lists = results.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results")).withColumn("config", F.substring(F.sha1(F.lit(config)), 1, 16)).withColumn("line", F.unix_micros(F.current_timestamp()))
    lists.write.mode("append").partitionBy("config").parquet(path)


def export(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Writes tables below ``path``: without keys anew, with keys by appending rows that are not there yet. Returns the
    number of rows added where keys are given."""
    added = {}
    for name, rows in tables.items():
        if keys is None:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            added[name] = append_new(rows, f"{path}/{name}", keys[name])
    return added


def existing(rows: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """(key) of ``rows`` that the store has."""
    return rows.select(key).distinct().join(have.select(key).distinct(), key, "left_semi")


# The graph's input tables.
GRAPH_INPUTS = ["datasets", "modalities", "documents", "chunks", "mentions", "entities", "relations"]


def manifest(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(name, path, present, rows): the graph's input tables below ``path``, and which of them are missing."""
    out = []
    for name in names or GRAPH_INPUTS:
        there = exists(spark, f"{path}/{name}")
        out.append((name, f"{path}/{name}", there, spark.read.parquet(f"{path}/{name}").count() if there else None))
    return spark.createDataFrame(out, "name string, path string, present boolean, rows bigint")


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.limit(n)
