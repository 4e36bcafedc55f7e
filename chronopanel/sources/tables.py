"""Reading and writing panel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from chronopanel.panel import Panel, check_keys, quoted

REJECTED, RECORD, PROBLEMS, FILE = "__rejected", "__record", "__problems", "__file"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | None = None) -> DataFrame:
    """CSV with header, every column text unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def without_dots(df: DataFrame) -> DataFrame:
    """Rename columns ``a.b`` to ``a_b``; Spark would read the dot as struct access."""
    names = [c.replace(".", "_") for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"renaming dots gives {', '.join(twice)} more than once")
    return df.toDF(*names)


def ingest_csv(spark: SparkSession, source: str | list[str], target: str) -> DataFrame:
    """CSV to Parquet, all text, dots in names replaced; returns the stored table."""
    without_dots(read_csv(spark, source)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def ingest_checked(spark: SparkSession, source: str | list[str], target: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """CSV to Parquet by an explicit schema, in one pass: the good rows, and the table of rejects.

    A row is rejected if a field cannot be read as its type, if a field that may not be null is
    empty, or if the number of fields is wrong.  Rejects have the file, the record as it stands there (one rejected
    for an empty field alone: as written anew) and the problems, such as ``price: unreadable``, ``id: missing`` or ``fields``.
    Every row is in one of the two.  A file whose header has other names than the schema raises.

    Both are folders of one table at ``target``, so either is read without the other.
    """
    names = schema.fieldNames()
    given = StructType([StructField(f.name, f.dataType) for f in schema] + [StructField(RECORD, StringType())])
    reader = spark.read.schema(given).option("header", True).option("enforceSchema", False)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).csv(source)
    texts = ", ".join(f"{quoted(c)} STRING" for c in names)
    raw = F.from_csv(RECORD, texts, {"mode": "PERMISSIVE"})
    unreadable = {c: raw.getField(c).isNotNull() & F.col(quoted(c)).isNull() for c in names}
    some = F.lit(False)
    for wrong in unreadable.values():
        some = some | F.coalesce(wrong, F.lit(False))
    found = [F.when(wrong, F.lit(f"{c}: unreadable")) for c, wrong in unreadable.items()]
    found += [
        F.when(F.col(quoted(f.name)).isNull() & ~F.coalesce(unreadable[f.name], F.lit(False)), F.lit(f"{f.name}: missing"))
        for f in schema
        if not f.nullable
    ]
    found.append(F.when(F.col(RECORD).isNotNull() & ~some, F.lit("fields")))
    problems = F.array_compact(F.array(*found))
    written = F.to_csv(F.struct(*[quoted(c) for c in names]))
    checked = rows.select("*", F.col("_metadata.file_path").alias(FILE), problems.alias(PROBLEMS))
    checked = checked.withColumn(REJECTED, F.size(PROBLEMS) > 0).withColumn(RECORD, F.when(F.col(REJECTED), F.coalesce(RECORD, written)))
    checked.write.mode("overwrite").partitionBy(REJECTED).parquet(target)
    table = spark.read.schema(checked.schema).parquet(target)
    good = table.where(~F.col(REJECTED)).select(*[quoted(c) for c in names])
    rejects = table.where(F.col(REJECTED)).select(F.col(FILE).alias("file"), F.col(RECORD).alias("record"), F.col(PROBLEMS).alias("problems"))
    return good, rejects


def typed_panel(df: DataFrame, panel: Panel, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Values to double and a text snapshot to a date, in one projection, by name.

    Unreadable text such as NA becomes null; a snapshot column that is no text stays.
    """
    snapshot = F.col(quoted(panel.snapshot))
    if dict(df.dtypes)[panel.snapshot] == "string":
        # Text after the date part, such as a time of day, is not read.
        snapshot = F.to_date(F.try_to_timestamp(snapshot, F.lit(date_format)))
    return df.select(
        *[
            snapshot.alias(c)
            if c == panel.snapshot
            else F.col(quoted(c))
            if c == panel.entity
            else _number(c).alias(c)
            for c in df.columns
        ]
    )


def _number(name: str):
    value = F.col(quoted(name)).try_cast("double")
    return F.when(~F.isnan(value), value)


def load_panel(spark: SparkSession, path: str, panel: Panel, checked: bool = True) -> DataFrame:
    """Stored panel with typed columns; raises on null or repeated keys unless told not to look."""
    df = typed_panel(spark.read.parquet(path), panel)
    if checked:
        check_keys(df, panel)
    return df


def write_features(df: DataFrame, path: str, panel: Panel, rebalance: bool = True) -> None:
    """Feature table as Parquet, one folder per snapshot.

    Rebalancing by snapshot gives each folder few files of even size: Spark splits
    a hot snapshot over several tasks and joins small ones.
    """
    if rebalance:
        df = df.hint("rebalance", panel.snapshot)
    df.write.mode("overwrite").partitionBy(panel.snapshot).parquet(path)


def save_by_entity(df: DataFrame, table: str, panel: Panel, buckets: int, path: str | None = None) -> None:
    """Table bucketed by entity and sorted by snapshot.

    ``generate_features`` then never shuffles the wide rows: history reads them in
    place, and the thin rows that carry the ranks move to them.  Tables with equally many buckets are
    merged in place by ``plans.generate.merge_stored``.  With a ``path`` the files are there, else in the warehouse.
    """
    (
        df.write.mode("overwrite")
        .options(**({"path": path} if path else {}))
        .format("parquet")
        .bucketBy(buckets, panel.entity)
        .sortBy(panel.entity, panel.snapshot)
        .saveAsTable(table)
    )


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a CSV folder; every file has its header, which ``read_csv`` skips."""
    df.write.option("header", True).mode("append").csv(path)
