"""The virtual symbol corpus over the star-schema tables: repositories, files and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symquarry.functions.names import normalize

NOUNS = "widget bolt rod gizmo anvil ring plate gear".split()
CODE_KINDS = "class module method smethod const func target key heading image arg env".split()


def _pick(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        n.alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("/r/"), "n_name").alias("root"),
        F.when(n % 7 == 0, None).otherwise(F.concat(F.lit("c"), n.cast("string"))).alias("head"), (n % 5 == 0).alias("dirty"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.when(i < 25, "README.md").otherwise(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), _pick(NOUNS, i % 8), F.lit("Guide"), i.cast("string"), F.lit(".md"))
    )
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(i.alias("id"), (i % 25).alias("repo_id"), path.alias("path"), F.col("n_chars").alias("size"))
    return rows.select("id", "repo_id", "path", normalize(F.col("path")).alias("path_norm"), "size")


def file_rows(files_df: DataFrame) -> DataFrame:
    """The one ``file`` symbol of every file."""
    return files_df.select(
        "id", "repo_id", F.col("id").alias("file_id"), F.lit(None).cast("int").alias("line"), F.lit("file").alias("kind"), F.col("path").alias("name"),
        F.lit(None).cast("string").alias("scope"), F.col("path_norm").alias("name_norm"), F.col("path_norm").alias("qual_norm"), "path", "path_norm",
    )


def with_norms(rows: DataFrame) -> DataFrame:
    """Adds name_norm, and qual_norm over scope and name; concat_ws skips a null scope."""
    qualified = F.concat_ws("::", "scope", "name")
    return rows.withColumn("name_norm", normalize(F.col("name"))).withColumn("qual_norm", normalize(qualified))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows and code rows, with the path of their file."""
    k = F.col("p_partkey")
    noun, adjective, form = _pick(NOUNS, k % 8), F.substring_index("p_name", " ", 1), k % 5
    name = (
        F.when(form == 0, noun).when(form == 1, F.concat(noun, F.lit("_"), adjective)).when(form == 2, F.concat(noun, F.lit("ry")))
        .when(form == 3, F.concat(F.initcap(adjective), F.initcap(noun), F.lit("s"))).otherwise(F.col("p_name"))
    )
    code = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        (k + 1000000).alias("id"), (k % 200).alias("file_id"), F.col("p_size").cast("int").alias("line"), _pick(CODE_KINDS, k % 12).alias("kind"),
        name.alias("name"), F.when(k % 4 == 0, None).otherwise(F.col("p_type")).alias("scope"),
    )
    f = files(spark, sf_dir)
    code = with_norms(code).join(f.select(F.col("id").alias("file_id"), "repo_id", "path", "path_norm"), "file_id")
    return file_rows(f).unionByName(code.select(*file_rows(f).columns))
