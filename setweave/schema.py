"""Table schemas, column normalisation and the loaders that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MEMBERSHIP = T.StructType([T.StructField("gs_id", T.StringType(), False), T.StructField("gene", T.StringType(), False)])
EDGES = T.StructType(
    [
        T.StructField("gs_a_id", T.StringType()),
        T.StructField("gs_b_id", T.StringType()),
        T.StructField("all", T.LongType()),
        T.StructField("gs_a_size", T.LongType()),
        T.StructField("gs_b_size", T.LongType()),
        T.StructField("olap", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("nlogpmf", T.DoubleType()),
        T.StructField("cdf", T.DoubleType()),
        T.StructField("nlogcdf", T.DoubleType()),
    ]
)
EMBEDDING = T.StructType([T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
#: Metadata columns; absent ones become typed nulls.
METADATA = {
    "gs_id": "string", "name": "string", "description": "string", "gs_size": "long", "organism": "string", "pubmed_id": "string",
    "pmids": "string", "gse_ids": "string", "geo_platform_ids": "string", "geo_sample_organisms": "string", "direction": "string",
    "pubmed_present": "int", "geo_series_title": "string", "geo_series_summary": "string", "geo_overall_design": "string",
    "mesh_descriptors": "string", "pub_years": "string", "pub_journals": "string",
}


class MissingColumns(ValueError):
    """A source lacks columns that an operator needs."""


def assert_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def normalize_schema(df: DataFrame, aliases: dict[str, str] | None = None, required: list[str] = (), optional: dict[str, str] | None = None) -> DataFrame:
    """Lower-case names, apply ``aliases`` (other name -> ours), require some columns, add absent optional ones as typed nulls."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    for other, ours in (aliases or {}).items():
        if other.lower() in df.columns and ours not in df.columns:
            df = df.withColumnRenamed(other.lower(), ours)
    assert_columns(df, list(required))
    for name, kind in (optional or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Fails at run time on a repeated key, with the key in the message."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).collect()
    if counted:
        raise ValueError(f"{key} {counted[0][0]!r} isn't unique")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
