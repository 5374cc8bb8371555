"""Scans, inventories, notebooks and saved profiles, on data derived from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.inventory import classify_files, is_ignored, summarize_files
from tabscope.plans.coverage.registry import register, table, table_path
from tabscope.plans.profile import profile_dataset
from tabscope.session import scratch_path
from tabscope.sources.delimited import read_profile_csv, read_sql_csv
from tabscope.sources.files import list_files, load_dataset
from tabscope.sources.notebooks import notebook_cells
from tabscope.sources.store import list_profiled, load_profile, save_profile


@register("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_dataset(spark, table_path(sf_dir, "orders"))


def _write_csv(spark: SparkSession, sf_dir: str, sep: str) -> str:
    """Customers as CSV with missing values written as several tokens."""
    path = scratch_path(spark, "csv")
    token = F.element_at(F.array(*[F.lit(t) for t in ("NA", "null", "N/A", "")]), (F.col("c_nationkey") % 4 + 1))
    gap = F.col("c_nationkey") < 8
    (
        table(spark, sf_dir, "customer")
        .select(
            "c_custkey",
            F.concat_ws(", ", "c_name", F.lit('"quoted"')).alias("c_name"),
            F.when(gap, token).otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
            F.when(gap, token).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
            (F.col("c_nationkey") > 12).cast("string").alias("c_far"),
        )
        .write.option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )
    return path


@register(
    "scan_csv",
    """SELECT c_custkey, c_name || ', "quoted"' AS c_name, CASE WHEN c_nationkey >= 8 THEN c_acctbal END AS c_acctbal,
              CASE WHEN c_nationkey >= 8 THEN c_mktsegment END AS c_mktsegment, c_nationkey > 12 AS c_far
       FROM customer""",
)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All NA tokens are missing, and the types come from what is left."""
    return read_profile_csv(spark, _write_csv(spark, sf_dir, ","))


TOKEN_SQL = "CASE c_nationkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' WHEN 2 THEN 'N/A' END"


@register(
    "scan_csv_sql",
    f"""SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name || ', "quoted"' AS c_name,
               CASE WHEN c_nationkey >= 8 THEN c_mktsegment ELSE {TOKEN_SQL} END AS c_mktsegment,
               c_nationkey > 12 AS c_far
        FROM customer""",
)
def scan_csv_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the SQL path only the empty token is missing; the delimiter is found."""
    scanned = read_sql_csv(spark, _write_csv(spark, sf_dir, "|"))
    return scanned.select("c_custkey", "c_name", "c_mktsegment", "c_far")


# --- inventory -------------------------------------------------------------------


@register(
    "catalog_scan",
    """SELECT DISTINCT 'priority=' || left(o_orderpriority, 1) || '/o_orderstatus=' || o_orderstatus AS folder, 'datasets' AS kind,
              TRUE AS has_bytes FROM orders""",
)
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a partitioned dataset: listed without reading them, then classified."""
    path = scratch_path(spark, "catalog")
    orders = table(spark, sf_dir, "orders").withColumn("priority", F.left("o_orderpriority", F.lit(1)))
    orders.write.partitionBy("priority", "o_orderstatus").parquet(path)
    files = classify_files(list_files(spark, path))
    folder = F.regexp_extract("rel_path", r"^(.*)/[^/]+$", 1)
    return files.groupBy(folder.alias("folder"), "kind").agg((F.sum("length") > 0).alias("has_bytes"))


# A file per document, in folders by source and language.
EXTENSIONS = [".csv", ".parquet", ".ipynb", ".sql", ".py", ".MD", ".txt", ".xlsx"]
PATTERNS = ["src1*/", "!src1/", "/src2/en/", "*.sql", "!keep-*.sql", "d?[13579].py", "src5/*/doc-*.MD"]


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 8 + 1).cast("int"))
    stem = F.when(F.col("n_chars") > 2000, F.lit("keep-")).otherwise(F.lit("doc-"))
    name = F.concat(stem, F.col("doc_id").cast("string"), extension)
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang", name).alias("rel_path"), F.col("n_chars").alias("length")
    )


FILES_SQL = """(SELECT source || '/' || lang || '/' || CASE WHEN n_chars > 2000 THEN 'keep-' ELSE 'doc-' END || doc_id
                       || list_extract(['.csv', '.parquet', '.ipynb', '.sql', '.py', '.MD', '.txt', '.xlsx'], CAST(doc_id % 8 + 1 AS INTEGER)) AS rel_path,
                       source, lang, n_chars, doc_id,
                       list_extract(['datasets', 'datasets', 'notebooks', 'sql_files', 'python_files', 'markdown_files', NULL, 'datasets'],
                                    CAST(doc_id % 8 + 1 AS INTEGER)) AS kind
                FROM documents)"""
IGNORED_SQL = """CASE WHEN source = 'src5' AND n_chars <= 2000 AND doc_id % 8 = 5 THEN TRUE
                      WHEN doc_id % 8 = 3 AND n_chars > 2000 THEN FALSE
                      WHEN doc_id % 8 = 3 THEN TRUE
                      WHEN source = 'src2' AND lang = 'en' THEN TRUE
                      WHEN source = 'src1' THEN FALSE
                      ELSE source LIKE 'src1%' END"""


@register("catalog_ignore", f"SELECT rel_path, {IGNORED_SQL} AS ignored FROM {FILES_SQL} f")
def catalog_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("rel_path", is_ignored(F.col("rel_path"), PATTERNS).alias("ignored"))


@register(
    "catalog_summary",
    f"""WITH kept AS (SELECT kind, rel_path FROM {FILES_SQL} f WHERE NOT {IGNORED_SQL} AND kind IS NOT NULL)
        SELECT k.kind AS kind, COUNT(rel_path) AS n_files,
               COALESCE(string_agg(rel_path, '|' ORDER BY rel_path) FILTER (WHERE rn <= 5), '') AS sample_paths
        FROM (VALUES ('datasets'), ('notebooks'), ('sql_files'), ('python_files'), ('markdown_files'), ('artifacts')) k(kind)
        LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY rel_path) AS rn FROM kept) r ON r.kind = k.kind
        GROUP BY k.kind""",
)
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = summarize_files(classify_files(document_files(spark, sf_dir), PATTERNS))
    return summary.withColumn("sample_paths", F.array_join("sample_paths", "|"))


# --- notebooks: every document as a notebook with one cell per line ----------------


@register(
    "notebook_cells",
    """SELECT doc_id, CAST(i - 1 AS INTEGER) AS cell_index, CASE WHEN i % 2 = 1 THEN 'markdown' ELSE 'code' END AS cell_type,
              left(line, 500) AS source, CASE WHEN i % 2 = 1 THEN 0 ELSE 3 END AS n_outputs,
              CASE WHEN i % 2 = 0 THEN lang || '!' END AS first_output, CASE WHEN i % 2 = 0 THEN i END AS execution_count
       FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
)
def cells_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = F.struct(
        F.lit("stream").alias("output_type"), F.array(F.col("lang"), F.lit("!")).alias("text"), F.lit(None).alias("data")
    )
    shown = F.struct(
        F.lit("display_data").alias("output_type"),
        F.lit(None).cast("array<string>").alias("text"),
        F.create_map(F.lit("text/plain"), F.col("source")).alias("data"),
    )
    outputs = F.from_json(
        F.to_json(F.array(stream.cast("struct<output_type:string,text:array<string>,data:map<string,string>>"), shown, shown, shown)),
        "array<struct<output_type:string,text:array<string>,data:map<string,string>>>",
    )
    cells = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.when(i % 2 == 0, F.lit("markdown")).otherwise(F.lit("code")).alias("cell_type"),
            F.array(F.left(line, F.lit(10)), F.substr(line, F.lit(11))).alias("source"),
            F.when(i % 2 == 1, outputs).alias("outputs"),
            F.when(i % 2 == 1, i + 1).alias("execution_count"),
        ),
    )
    notebooks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.to_json(F.struct(cells.alias("cells"))).alias("content")
    )
    return notebook_cells(notebooks).select(
        F.col("path").cast("bigint").alias("doc_id"),
        "cell_index",
        "cell_type",
        "source",
        F.size("outputs").alias("n_outputs"),
        F.try_element_at("outputs", F.lit(1))["text"].alias("first_output"),
        "execution_count",
    )


# --- saved profiles ----------------------------------------------------------------

STORED = ("customer", "orders")


def _stored(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "profiles")
    for name in STORED:
        save_profile(profile_dataset(spark, table_path(sf_dir, name)), root)
    return root


@register(
    "profile_sink_roundtrip",
    """SELECT 'parquet' AS file_type, COUNT(*) AS row_count, CAST(6 AS INTEGER) AS column_count,
              'o_orderkey,o_custkey' AS id_columns, 'o_orderstatus,o_orderpriority' AS dimension_columns FROM orders""",
)
def profile_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _stored(spark, sf_dir)
    saved = load_profile(spark, table_path(sf_dir, "orders"), root)
    return saved.select(
        "file_type",
        "row_count",
        "column_count",
        *[F.array_join(c, ",").alias(c) for c in ("id_columns", "dimension_columns")],
    )


@register(
    "profiled_datasets",
    "SELECT 'customer.parquet' AS file, COUNT(*) AS row_count FROM customer UNION ALL SELECT 'orders.parquet', COUNT(*) FROM orders",
)
def profiled_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _stored(spark, sf_dir)
    counts = reduce(
        DataFrame.unionAll,
        [load_profile(spark, table_path(sf_dir, name), root).select("path", "row_count") for name in STORED],
    )
    return list_profiled(spark, root).join(counts, "path").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "row_count"
    )
