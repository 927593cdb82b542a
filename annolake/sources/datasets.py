"""Study datasets as parquet or CSV folders: registry, columns, values."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from annolake.schemas import DATASET_CATALOG, VARIABLE_CATALOG
from annolake.session import small_table


def domain_of_file(file_name: Column) -> Column:
    """Upper-cased stem of a file name."""
    return F.upper(F.regexp_extract(file_name, r"^(.*)\.[^.]+$", 1))


class DatasetRegistry:
    """The datasets of one study folder; a dataset's rows are read when asked for.

    The list of files lives on the driver: it has one entry per dataset, not
    per record.
    """

    def __init__(self, spark: SparkSession, folder: str, file_format: str = "parquet",
                 labels: dict[str, str] | None = None):
        self.spark, self.folder, self.format = spark, folder, file_format
        self.labels = {k.upper(): v for k, v in (labels or {}).items()}
        self.refresh()

    def refresh(self) -> None:
        """Forget what was scanned and look again."""
        self.spark.catalog.refreshByPath(self.folder)
        # a dataset is a file or a folder of part files; contents are not read
        found = rf"^(.*?/[^/]+\.{self.format})(?:/.*)?$"
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", f"*.{self.format}").load(self.folder)
                 .select(F.regexp_extract("path", found, 1).alias("path")).distinct()
                 .select(domain_of_file(F.substring_index("path", "/", -1)).alias("domain"),
                         "path"))
        self.paths = {r.domain: r.path for r in files.orderBy("domain").collect()}

    def domains(self) -> list[str]:
        return list(self.paths)

    def dataset(self, domain: str) -> DataFrame | None:
        path = self.paths.get(domain.upper())
        if path is None:
            return None
        reader = self.spark.read
        return reader.csv(path, header=True) if self.format == "csv" else reader.parquet(path)

    def variables_of(self, domain: str) -> list[str]:
        data = self.dataset(domain)
        return data.columns if data is not None else []

    def has_variable(self, domain: str, variable: str) -> bool:
        return variable in self.variables_of(domain)

    def sample(self, domain: str, variable: str, n: int = 5, order: str | None = None):
        """First ``n`` values of a column, by ``order`` where given; none if unknown."""
        if not self.has_variable(domain, variable):
            return []
        data = self.dataset(domain)
        data = data.orderBy(order) if order else data
        return [r[0] for r in data.select(variable).limit(n).collect()]

    def dataset_catalog(self) -> DataFrame:
        return small_table(self.spark, 
            [(d, self.labels.get(d), p) for d, p in self.paths.items()], DATASET_CATALOG)

    def variable_catalog(self) -> DataFrame:
        """Column metadata from the files' schemas; no record is read."""
        rows = []
        for domain in self.paths:
            rows += variable_rows(domain, self.dataset(domain).schema)
        return small_table(self.spark, rows, VARIABLE_CATALOG)

    def _values(self, column: str, wanted) -> DataFrame:
        out = small_table(self.spark, [], f"domain string, {column.lower()} string")
        for domain in self.paths:
            if wanted(domain) and self.has_variable(domain, column):
                out = out.unionByName(self.dataset(domain).select(
                    F.lit(domain).alias("domain"), F.col(column).cast("string")
                    .alias(column.lower())).distinct())
        return out

    def supp_values(self) -> DataFrame:
        """Distinct QNAM of each SUPP dataset; the scan reads that column only."""
        return self._values("QNAM", lambda d: d.startswith("SUPP"))

    def relrec_values(self) -> DataFrame:
        return self._values("IDVAR", lambda d: d == "RELREC").select("idvar")

    def catalog(self):
        from annolake.operators.rules import Catalog

        return Catalog(self.dataset_catalog(), self.variable_catalog(), self.supp_values(),
                       self.relrec_values())


class StudyRegistry:
    """The datasets of many studies: ``root/<study>/<dataset>``, a file or a folder of part files.

    Every catalogue table has the ``study_id``.  However many datasets there are, three
    Spark jobs read them: one lists files, one reads the footer (or head line) of each
    dataset's smallest file inside tasks, one reads the values that rules look up.  The
    driver holds one path for each dataset and no record.
    """

    KEYS = ("study_id",)

    def __init__(self, spark: SparkSession, root: str, file_format: str = "parquet",
                 labels: dict[str, str] | None = None):
        self.spark, self.root, self.format = spark, root.rstrip("/"), file_format
        self.labels = {k.upper(): v for k, v in (labels or {}).items()}
        self.refresh()

    def _placed(self, files: DataFrame) -> DataFrame:
        """``files`` (path) with study, domain and the dataset's own path."""
        dataset = F.regexp_extract("path", rf"^(.*?/[^/]+\.{self.format})(?:/.*)?$", 1)
        return files.withColumn("dataset", dataset).withColumn(
            "study_id", F.element_at(F.split("dataset", "/"), -2)).withColumn(
            "domain", domain_of_file(F.substring_index("dataset", "/", -1)))

    def refresh(self) -> None:
        """Look again which files there are."""
        self.spark.catalog.refreshByPath(self.root)
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", f"*.{self.format}").load(self.root).select("path", "length"))
        smallest = self._placed(files).groupBy("study_id", "domain").agg(
            F.min_by("path", F.struct("length", "path")).alias("path"), F.min("dataset").alias("dataset"))
        self.files = {(r.study_id, r.domain): (r.path, r.dataset) for r in smallest.collect()}

    def dataset_catalog(self) -> DataFrame:
        rows = [(study, domain, self.labels.get(domain), dataset) for (study, domain), (_, dataset) in sorted(self.files.items())]
        return small_table(self.spark, rows, f"study_id string, {DATASET_CATALOG}")

    def variable_catalog(self) -> DataFrame:
        """Column metadata, read from footers by tasks."""
        schema = f"study_id string, {VARIABLE_CATALOG}"
        if not self.files:
            return small_table(self.spark, [], schema)
        read = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
                .load([path for path, _ in self.files.values()]).select("path", "content"))
        kind = self.format

        def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [f.split()[0] for f in schema.split(", ")]
            for batch in batches:
                for study, domain, content in zip(*(batch.column(i) for i in range(3))):
                    rows = footer_rows(domain.as_py(), content.as_buffer(), kind)
                    columns = list(zip(*((study.as_py(), *row) for row in rows))) or [[] for _ in names]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int32() if n in ("ordinal", "length") else pa.string()) for n, c in zip(names, columns)], names)
        return self._placed(read).select("study_id", "domain", "content").mapInArrow(described, schema)

    def _values(self, column: str, wanted) -> DataFrame:
        """Distinct values of one column of many datasets, in one read of that column."""
        named = self.variable_catalog().filter(F.col("name") == column).select("study_id", "domain").collect()
        paths = [self.files[r.study_id, r.domain][1] for r in named if wanted(r.domain)]
        value = column.lower()
        if not paths:
            return small_table(self.spark, [], f"study_id string, domain string, {value} string")
        reader = self.spark.read.schema(f"{column} string").option("recursiveFileLookup", True)
        if self.format == "csv":  # columns by name, whatever their place
            parts = [self.spark.read.option("recursiveFileLookup", True).csv(p, header=True).select(
                F.col(column), F.col("_metadata.file_path").alias("path")) for p in paths]
            rows = parts[0]
            for part in parts[1:]:
                rows = rows.unionByName(part)
        else:
            rows = reader.parquet(*paths).select(F.col(column), F.col("_metadata.file_path").alias("path"))
        return self._placed(rows).select("study_id", "domain", F.col(column).alias(value)).distinct()

    def supp_values(self) -> DataFrame:
        return self._values("QNAM", lambda d: d.startswith("SUPP"))

    def relrec_values(self) -> DataFrame:
        return self._values("IDVAR", lambda d: d == "RELREC").select("study_id", "idvar")

    def catalog(self):
        from annolake.operators.rules import Catalog

        return Catalog(self.dataset_catalog(), self.variable_catalog(), self.supp_values(),
                       self.relrec_values(), self.KEYS)


def footer_rows(domain: str, content, kind: str) -> list[tuple]:
    """Catalogue rows from a file's own description: Parquet footer or CSV head line."""
    if kind == "csv":
        head = next(csv.reader([bytes(content).split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")]), [])
        return variable_rows(domain, T.StructType([T.StructField(name, T.StringType()) for name in head]))
    schema = pq.read_schema(pa.BufferReader(content))
    told = (schema.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    return variable_rows(domain, T.StructType.fromJson(json.loads(told)) if told else from_arrow_schema(schema))


def variable_rows(domain: str, schema: T.StructType) -> list[tuple]:
    """Catalogue rows of one dataset; field metadata may hold label, length, format, informat."""
    rows = []
    for i, f in enumerate(schema.fields, 1):
        numeric = isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType))
        extra = f.metadata or {}
        rows.append((domain, i, f.name, "numeric" if numeric else "character",
                     int(extra.get("length", 8 if numeric else 0)), extra.get("label", ""),
                     extra.get("format"), extra.get("informat")))
    return rows
