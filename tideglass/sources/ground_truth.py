"""Ground-truth flow files: labels per flow, several header spellings."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.dimensions import flow_label_stages
from tideglass.functions.scalar import (
    attack_flag,
    derive_flow_features,
    epoch_ts,
    finite,
    number,
    parse_ts_dayfirst,
)
from tideglass.operators.labels import map_label
from tideglass.schemas import LABELLED_FLOW_COLUMNS, positional_flow_schema
from tideglass.sources.heads import FILE, first_lines, text_lines

# Labels hold a dash byte that is not valid UTF-8. A one-byte encoding reads every
# file; the label dictionary knows the dash in each of its readings.
ENCODING = "iso-8859-1"
# A byte-order mark in that encoding, and decoded.
BYTE_ORDER_MARK = re.compile("^(\u00ef\u00bb\u00bf|\ufeff)")
# What the name of a column must look like, in lower case, to be taken for it.
ROLES = {
    "src_ip": re.compile(r"(source|src) ip|^src_ip$"),
    "ts": re.compile(r"timestamp"),
    "label": re.compile(r"^label$"),
}


def header_names(line: str) -> list[str]:
    """Column names of a header line, without mark, quotes and outer spaces."""
    return [n.strip() for n in next(csv.reader([BYTE_ORDER_MARK.sub("", line)]), [])]


def role_places(names: Sequence[str]) -> dict[str, int]:
    """Place of the column for each role; of several that fit, the last."""
    fits = {role: [i for i, n in enumerate(names) if p.search(n.lower())] for role, p in ROLES.items()}
    return {role: at[-1] for role, at in fits.items() if at}


def name_places(names: Sequence[str]) -> dict[str, int]:
    """Place of each numeric-flow column; of several of one name, the first."""
    return {n: names.index(n) for n in LABELLED_FLOW_COLUMNS if n in names}


def _places(
    lines: DataFrame, wanted: Sequence[str], find: Callable[[Sequence[str]], dict[str, int]]
) -> tuple[DataFrame, int]:
    """(source_file, header, p0, p1, ...): places of the wanted columns, null where one is missing; widest header."""
    heads = first_lines(lines)
    # Spellings of headers are few, whatever the number of files.
    kinds = [r.header for r in heads.select("header").distinct().collect()]
    rows, width = [], 1
    for line in kinds:
        names = header_names(line)
        found = find(names)
        whole = len(found) == len(wanted)
        rows.append((line, *[found[w] if whole else None for w in wanted]))
        width = max(width, len(names)) if whole else width
    spec = "header string, " + ", ".join(f"p{i} int" for i in range(len(wanted)))
    table = lines.sparkSession.createDataFrame(rows, spec)
    return heads.join(table, "header"), width


def skipped_truth_files(spark: SparkSession, path: str, pattern: str = "*.csv", numeric: bool = False) -> DataFrame:
    """(source_file, header) of the files without the columns that are needed."""
    wanted, find = (LABELLED_FLOW_COLUMNS, name_places) if numeric else (list(ROLES), role_places)
    places, _ = _places(text_lines(spark, path, pattern, ENCODING), wanted, find)
    return places.filter("p0 is null").select(FILE, "header")


def _pick(
    spark: SparkSession, path: str, pattern: str, wanted: Sequence[str], find: Callable[[Sequence[str]], dict[str, int]]
) -> DataFrame:
    """The wanted columns of all files that have them, as text, and ``source_file``."""
    lines = text_lines(spark, path, pattern, ENCODING)
    places, width = _places(lines, wanted, find)
    usable = places.filter("p0 is not null").drop("header")
    if usable.isEmpty():
        raise ValueError(f"no file with the columns {', '.join(wanted)} under {path}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    parsed = lines.join(usable, FILE).withColumn("_row", F.from_csv("line", schema.simpleString()[7:-1].replace(":", " ")))
    cells = F.array(*[F.col(f"_row.c{i}") for i in range(width)])
    return parsed.select(*[F.get(cells, F.col(f"p{i}")).alias(w) for i, w in enumerate(wanted)], FILE)


def read_labelled_flows(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """``src_ip``, ``ts``, ``label``, ``stage`` of all files that have the columns.

    Rows whose time cannot be parsed are dropped, header lines with them;
    ``skipped_truth_files`` lists files without the columns.
    """
    rows = _pick(spark, path, pattern, list(ROLES), role_places)
    timed = rows.withColumn("ts", parse_ts_dayfirst("ts")).filter(F.col("ts").isNotNull())
    return map_label(timed, "label", flow_label_stages())


def read_numeric_flows(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Labelled flows with the eight numeric inputs of network-wide windows.

    Files that lack one of the columns are skipped and listed by
    ``skipped_truth_files(..., numeric=True)``.
    """
    flows = _pick(spark, path, pattern, LABELLED_FLOW_COLUMNS, name_places)
    plain = [c for c in LABELLED_FLOW_COLUMNS[2:] if c != "Flow Packets/s"]
    return (
        flows.withColumn("ts", parse_ts_dayfirst("Timestamp"))
        .filter(F.col("ts").isNotNull())
        .withColumns({c: F.col(c).try_cast("double") for c in plain})
        .withColumn("Flow Packets/s", finite(number("Flow Packets/s")))
        .withColumn("attack", attack_flag("Label"))
    )


def read_positional_flows(
    spark: SparkSession, path: str, pattern: str = "UNSW-NB15_[1-4].csv"
) -> DataFrame:
    """The headerless 49-column files, with derived features and attack flag."""
    rows = (
        spark.read.schema(positional_flow_schema())
        .option("pathGlobFilter", pattern)
        .csv(path)
        .withColumns({"ts": epoch_ts("Stime"), FILE: F.col("_metadata.file_path")})
        .filter(F.col("ts").isNotNull())
    )
    return derive_flow_features(rows).withColumn("attack", number("Label").cast("int"))
