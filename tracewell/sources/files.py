"""Readers and writers of the domain files. Blank text becomes null, and answer-key columns never leave these readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources import schemas


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header, or any other format that the path's ending names, under a declared schema."""
    form = path.rsplit(".", 1)[-1] if path.rsplit(".", 1)[-1] in ("parquet", "json", "orc") else "csv"
    reader = spark.read.schema(schema)
    df = reader.csv(path, header=True) if form == "csv" else reader.format(form).load(path)
    kinds = dict(df.dtypes)
    return df.select(*[blank_to_null(c) if kinds[c] == "string" else F.col(c) for c in df.columns])


def blank_to_null(name: str) -> Column:
    value = F.trim(F.col(name))
    return F.when(value != "", value).alias(name)


def flag(name: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(name))) == "true", F.lit(False)).alias(name)


def listed(name: str) -> Column:
    """A list written with semicolons."""
    return F.filter(F.split(F.coalesce(F.col(name), F.lit("")), ";"), lambda x: x != "").alias(name)


def transactions(spark: SparkSession, path: str) -> DataFrame:
    t = read(spark, path, schemas.TRANSACTIONS)
    return t.withColumn("ts", F.unix_timestamp(F.col("timestamp").cast("timestamp"))).drop("timestamp")


def accounts(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schemas.ACCOUNTS).drop(*schemas.ANSWER_KEY)


def account_ages(spark: SparkSession, path: str) -> DataFrame:
    return accounts(spark, path).select("account_id", "opened_days_ago")


def customer_records(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schemas.CUSTOMER_RECORDS).drop(*schemas.ANSWER_KEY)


def resolved_entities(spark: SparkSession, path: str) -> DataFrame:
    e = read(spark, path, schemas.RESOLVED_ENTITIES)
    made = {"account_ids": listed, "record_ids": listed, "rules_used": listed, "has_unverified_link": flag, "is_watchlisted": flag}
    return e.select(*[made[c](c) if c in made else F.col(c) for c in e.columns])


def account_owners(spark: SparkSession, path: str) -> DataFrame:
    o = read(spark, path, schemas.ACCOUNT_OWNERS)
    return o.select("account_id", "entity_key", flag("is_watchlisted"), flag("has_unverified_link"))


def json_rows(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """A JSON document's rows; field names the array that holds them."""
    doc = spark.read.json(path, multiLine=True)
    return doc.selectExpr(f"inline({field})") if field else doc


def of_ids(df: DataFrame, ids: DataFrame, column: str = "txn_id") -> DataFrame:
    """The rows whose id is asked for."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV with header; arrays are joined by semicolons."""
    kinds = dict(df.dtypes)
    flat = df.select(*[F.concat_ws(";", c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns])
    flat.orderBy(*order).write.csv(path, header=True)


def write_views(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges of all views as Parquet, a folder to a view."""
    nodes.write.partitionBy("view").parquet(f"{path}/nodes")
    edges.write.partitionBy("view").parquet(f"{path}/edges")


def append_new(df: DataFrame, spark: SparkSession, path: str, key: str, force: bool = False) -> int:
    """Add rows whose key the table at path lacks; force writes all anew. Returns the number written."""
    if not force:
        try:
            df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
        except Exception as e:  # a table that is not there yet has no keys
            if "PATH_NOT_FOUND" not in str(e):
                raise
    n = df.count()
    if n:
        df.write.mode("overwrite" if force else "append").parquet(path)
    return n


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
