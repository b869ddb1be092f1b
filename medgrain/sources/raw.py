"""Raw CSV tables to typed, conformed frames with lineage."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from medgrain.sources.specs import LINEAGE_COLUMNS, TableSpec
from medgrain.sources.storage import first_existing, signature

DISCOVERY_SCHEMA = (
    "dataset string, table string, status string, path string, signature string, missing_columns array<string>"
)


#: Quoted fields may hold commas, doubled quotes and line ends.
CSV = {"quote": '"', "escape": '"', "multiLine": "true"}
BROKEN = "_broken_row"


class SourceContractError(ValueError):
    """Required tables or columns are missing."""


def locate(spark: SparkSession, spec: TableSpec, root: str, extension: str = "csv.gz") -> str | None:
    """The table's file: the preferred extension first, then ``.csv.gz`` and ``.csv``."""
    stem = f"{root.rstrip('/')}/{spec.subdir}/{spec.name}"
    extensions = dict.fromkeys([extension.lstrip("."), "csv.gz", "csv"])
    return first_existing(spark, [f"{stem}.{e}" for e in extensions])


def normalized_names(names: Iterable[str]) -> list[str]:
    """Lower snake-case names; the n-th copy of a name becomes ``name__duplicate_n``."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        name = re.sub(r"\s+", "_", (raw or "").strip().lower())
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}__duplicate_{seen[name]}")
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def header(spark: SparkSession, path: str) -> list[str]:
    """The header row as written (one row is read on the driver)."""
    row = spark.read.options(**CSV).option("header", False).csv(path).head(1)
    return [str(v) if v is not None else "" for v in row[0]] if row else []


def text_schema(names: list[str]) -> T.StructType:
    """All columns as text, by the names of the header as written.

    Spark then holds the header of every file against them. Empty and repeated names cannot be told apart, so such a
    header is bound by position.
    """
    plain = all(names) and len({n.lower() for n in names}) == len(names)
    return T.StructType([T.StructField(n if plain else f"c{i}", T.StringType()) for i, n in enumerate(names)])


def bound(reader: DataFrameReader | DataStreamReader, names: list[str],
          line_ends: bool = True) -> DataFrameReader | DataStreamReader:
    """``reader`` set up for files of this header; a file with another one fails."""
    schema = text_schema(names)
    reader = reader.options(**CSV).option("header", True).option("enforceSchema", schema.names != names)
    if line_ends:
        return reader.schema(schema)
    broken = schema.add(T.StructField(BROKEN, T.StringType()))
    # A row is whole or not by the number of its fields, so all of them are parsed.
    return reader.schema(broken).options(multiLine="false", columnPruning="false", columnNameOfCorruptRecord=BROKEN)


def rows_of(df: DataFrame, names: list[str], line_ends: bool) -> DataFrame:
    """The rows of a bound read under normalised names, with ``_metadata``.

    Read in splits, a quoted line end cuts a row in two, one of which has too few fields and an open quote: that fails,
    it is never taken for data.
    """
    if not line_ends:
        message = F.concat_ws(" ", F.lit("a quoted field holds a line end; set line_ends in the table's spec:"), *df.columns[:1])
        cut = F.col(BROKEN).isNotNull() & (F.regexp_count(F.col(BROKEN), F.lit('"')) % 2 == 1)
        guard = F.when(cut, F.raise_error(message).cast("int")).otherwise(F.lit(1))
        df = df.where(guard == 1)
    return df.select(*df.columns[:len(names)], "_metadata").toDF(*normalized_names(names), "_metadata")


def scan_raw(spark: SparkSession, path: str, partitions: int | None = None, line_ends: bool = True) -> DataFrame:
    """All columns as text under normalised names.

    Files whose quoted fields may hold line ends, or that are compressed, are one split each, and rows are spread out
    after the read; others are read in splits. A single column is always read whole: a cut row would show no fault.
    """
    names = header(spark, path)
    line_ends = line_ends or len(names) < 2
    df = rows_of(bound(spark.read, names, line_ends).csv(path), names, line_ends)
    if not line_ends and not path.endswith(".gz"):
        return df
    return df.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))


def lenient_cast(column: Column, kind: str) -> Column:
    """Cast that turns text it cannot read into null; whole numbers may carry a zero fraction."""
    text = F.nullif(F.trim(column.cast("string")), F.lit(""))
    if kind == "bigint":
        number = text.try_cast("decimal(38,6)")
        return F.when(number == F.floor(number), number).try_cast("bigint")
    if kind == "double":
        value = text.try_cast("double")
        return F.when(~F.isnan(value), value)
    if kind == "timestamp_ntz":
        return text.try_cast("timestamp_ntz")
    return text


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Expected columns first (missing ones as null), extras passed through after."""
    have = df.columns
    expected = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in spec.expected]
    return df.select(*expected, *[c for c in have if c not in spec.expected])


def cast_columns(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.select(*[
        F.col(c) if c == "_metadata" else lenient_cast(F.col(c), spec.type_of(c)).alias(c) for c in df.columns
    ])


def with_lineage(df: DataFrame, dataset: str, table: str, run_id: str) -> DataFrame:
    """Seven lineage columns per row, from the file metadata of the scan."""
    meta = "_metadata."
    values = (
        F.lit(dataset), F.lit(table), F.col(meta + "file_path"), F.col(meta + "file_size"),
        F.col(meta + "file_modification_time").cast("string"), F.lit(run_id), F.current_timestamp().cast("string"),
    )
    kept = [c for c in df.columns if c != "_metadata"]
    return df.select(*kept, *[v.alias(n) for n, v in zip(LINEAGE_COLUMNS, values)])


def standardize(spark: SparkSession, spec: TableSpec, path: str, run_id: str) -> DataFrame:
    """Scan, conform, cast and add lineage in one plan."""
    return with_lineage(cast_columns(conform(scan_raw(spark, path, line_ends=spec.line_ends), spec), spec), spec.dataset, spec.name, run_id)


def discover(spark: SparkSession, specs: Iterable[TableSpec], root: str, extension: str = "csv.gz") -> DataFrame:
    """One status row per table from file and header probes; all violations are raised together."""
    rows, problems = [], []
    for spec in specs:
        path = locate(spark, spec, root, extension)
        if path is None:
            status = "missing_required" if spec.required else "missing_optional"
            rows.append((spec.dataset, spec.name, status, None, None, []))
            if spec.required:
                problems.append(f"missing table {spec.dataset}.{spec.name}")
            continue
        have = set(normalized_names(header(spark, path)))
        missing = [c for c in spec.required_columns if c not in have]
        if missing:
            problems.append(f"{spec.dataset}.{spec.name} lacks {', '.join(missing)}")
        rows.append((spec.dataset, spec.name, "invalid" if missing else "found", path, signature(spark, path), missing))
    if problems:
        raise SourceContractError("; ".join(problems))
    return spark.createDataFrame(rows, DISCOVERY_SCHEMA)
