"""Text formats at the edges: CSV of strings, JSON records, key lists, JSON columns, wide predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from casemill.schemas import CITED, PROBABILITIES


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV with a header, every column a string, blanks as empty strings."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    rows = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
            .option("enforceSchema", False).csv(path))
    return rows.fillna("")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """One key per line; blank lines and lines starting with ``#`` are dropped."""
    lines = spark.read.text(path)
    return lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.trim("value").alias("key"))


def clamp(p: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def probs_to_json(df: DataFrame, keys: Sequence[str], series: str = "series", p: str = "p") -> DataFrame:
    """One row per key with a JSON map of clamped probabilities."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(series), clamp(F.col(p)))))
    return df.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias("probs"))


def json_to_probs(df: DataFrame, classes: Sequence[str] | Column, probs: str = "probs") -> DataFrame:
    """One row per class; a class missing from the map has probability 0. ``classes`` may be an array column."""
    names = classes if isinstance(classes, Column) else F.array(*map(F.lit, classes))
    rest = [c for c in df.columns if c != probs]
    parsed = df.select(*rest, F.from_json(F.col(probs), PROBABILITIES).alias("_values"), names.alias("_names"))
    per_class = F.transform("_names", lambda c: F.struct(c.alias("series"), F.coalesce(F.try_element_at("_values", c), F.lit(0.0)).alias("p")))
    return parsed.select(*rest, F.inline(per_class))


def top_probabilities(probs: Column, n: int = 3) -> Column:
    """The n most probable entries of a JSON map, highest first, ties by name."""
    entries = F.transform(F.map_entries(F.from_json(probs, PROBABILITIES)),
                          lambda e: F.struct((-e["value"]).alias("rank"), e["key"].alias("series"), e["value"].alias("p")))
    return F.transform(F.slice(F.sort_array(entries), 1, n), lambda e: F.struct(e["series"], e["p"]))


def parse_cited(reasons: Column) -> Column:
    """JSON list of cited rules with reasons."""
    return F.coalesce(F.from_json(reasons, CITED), F.array().cast(CITED))


def wide_to_long(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Columns named ``model:series`` to rows (ids, model, series, p)."""
    columns = [c for c in df.columns if c not in ids]
    rows = df.unpivot([F.col(i) for i in ids], [F.col(f"`{c}`") for c in columns], "k", "p")
    return rows.select(*ids, F.substring_index("k", ":", 1).alias("model"),
                       F.expr("substring(k, locate(':', k) + 1)").alias("series"), "p")


def long_to_wide(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows (ids, model, series, p) to the given ``model:series`` columns."""
    return df.withColumn("k", F.concat("model", F.lit(":"), "series")).groupBy(*ids).pivot("k", list(columns)).agg(F.first("p"))
