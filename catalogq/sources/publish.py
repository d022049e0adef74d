"""Outputs: tables of a declared schema, audited, checked and put in place in one step."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "_SUCCESS"


def to_json(value: object) -> str:
    """Sorted keys, no spaces, text as it is."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def checksums(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 of each file, one task a file; of a folder, over the names and checksums of its data files."""
    found = {p: sorted(str(f) for f in Path(p).rglob("*") if f.is_file() and f.name[0] not in "._") if Path(p).is_dir() else [p] for p in paths}
    files = sorted({f for fs in found.values() for f in fs})
    hashed = lambda batches: (b.assign(sha256=[file_sha256(f) for f in b["path"]]) for b in batches)
    df = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)), "path")
    of = {r.path: r.sha256 for r in df.mapInPandas(hashed, "path string, sha256 string").collect()}
    return {p: of[p] if fs == [p] else hashlib.sha256(to_json([[os.path.relpath(f, p), of[f]] for f in fs]).encode()).hexdigest() for p, fs in found.items()}


def content_figures(df: DataFrame) -> dict:
    """Row count and a hash of the rows that does not depend on their order; one distributed pass."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("s")).first()
    return {"rows": r["rows"], "content": f"{(r['x'] or 0) & (2**64 - 1):016x}-{r['s'] or 0}"}


def write_table(df: DataFrame, path: str, schema: T.StructType, order: list[str]) -> dict:
    """Parquet with the declared columns, types and nullability, globally ordered by ``order``, columns of ``df`` that need
    not be declared; gives its figures.

    A null in a non-null column fails the write. Empty input gives a table without rows.
    """
    declared = [f.name for f in schema.fields]
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *[c for c in order if c not in declared])
    nulls = [f.name for f in schema.fields if not f.nullable]
    for c in nulls:
        typed = typed.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"null in {c}"))))
    typed.orderBy(*order).select(declared).write.mode("errorifexists").option("compression", "snappy").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"{path} does not have the declared schema")
    return content_figures(back)


def read_key_universe(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The keys of a table, after checking that they are bigint, there, not null and unique."""
    df = spark.read.parquet(path).select(key)
    if not isinstance(df.schema[key].dataType, T.LongType):
        raise ValueError(f"{key} is no bigint")
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    r = per.agg(F.sum("n").alias("rows"), F.count_if(F.col(key).isNull()).alias("nulls"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    if not r["rows"] or r["nulls"] or r["repeated"]:
        raise ValueError(f"{key}: {r['rows'] or 0} rows, {r['nulls']} null, {r['repeated']} repeated")
    return df


class Publication:
    """A directory of outputs that appears whole or not at all.

    ``with Publication(dir, force) as p`` gives a staging directory ``p.path`` beside the target. On a clean exit the
    completion marker is written last and the directory renamed into place; an earlier one is kept until then
    and comes back if anything fails. On an error nothing of the run stays. Local or mounted file systems.
    """

    def __init__(self, target: str, force: bool = False, failure_injector: Callable[[str], None] | None = None):
        self.target, self.force, self.inject = Path(target), force, failure_injector or (lambda phase: None)
        self.path = self.target.with_name(f".{self.target.name}.staging-{uuid.uuid4().hex[:8]}")

    def __enter__(self) -> Publication:
        if self.target.exists() and not self.force:
            raise FileExistsError(self.target)
        self.path.mkdir(parents=True)
        return self

    def write_json(self, name: str, value: object) -> None:
        (self.path / name).write_text(to_json(value) + "\n", encoding="utf-8")

    def write_text(self, name: str, text: str) -> None:
        (self.path / name).write_text(text, encoding="utf-8", newline="")

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        backup = self.target.with_name(f".{self.target.name}.backup-{uuid.uuid4().hex[:8]}")
        try:
            if kind is None:
                self.inject("before_completion")
                (self.path / MARKER).write_text("success\n")
                if self.target.exists():
                    os.rename(self.target, backup)
                os.rename(self.path, self.target)
                self.inject("after_rename")
        except BaseException:
            if backup.exists():
                shutil.rmtree(self.target, ignore_errors=True)
                os.rename(backup, self.target)
            raise
        finally:
            shutil.rmtree(self.path, ignore_errors=True)
            if self.target.exists():
                shutil.rmtree(backup, ignore_errors=True)


class VersionedPublication:
    """A publication for stores without renames, through Hadoop's file systems.

    Each run writes below ``<target>/runs/<id>``, its completion marker last. Then the one small object ``<target>/CURRENT`` is
    replaced by the run's name, which is what makes the run visible: ``current`` gives the folder to read. Until then the
    earlier run stays current, and on an error nothing of the run stays. The run before is removed after the switch.
    """

    def __init__(self, spark: SparkSession, target: str, force: bool = False, failure_injector: Callable[[str], None] | None = None):
        self.spark, self.target, self.force, self.inject = spark, target.rstrip("/"), force, failure_injector or (lambda phase: None)
        self.run = uuid.uuid4().hex[:12]
        self.path = f"{self.target}/runs/{self.run}"

    def __enter__(self) -> VersionedPublication:
        self.before = current(self.spark, self.target)
        if self.before and not self.force:
            raise FileExistsError(self.target)
        return self

    def _write(self, at: str, text: str) -> None:
        fs, path = _hadoop(self.spark, at)
        stream = fs.create(path, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()

    def write_text(self, name: str, text: str) -> None:
        self._write(f"{self.path}/{name}", text)

    def write_json(self, name: str, value: object) -> None:
        self.write_text(name, to_json(value) + "\n")

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        done = False
        try:
            if kind is None:
                self.inject("before_completion")
                self.write_text(MARKER, "success\n")
                self._write(f"{self.target}/CURRENT", self.run)
                done = True
        finally:
            for gone in [self.before] if done else [self.path]:
                if gone:
                    fs, path = _hadoop(self.spark, gone)
                    fs.delete(path, True)


def _hadoop(spark: SparkSession, at: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current(spark: SparkSession, target: str) -> str | None:
    """The folder of the run that a versioned target shows, None where there is none."""
    fs, path = _hadoop(spark, f"{target.rstrip('/')}/CURRENT")
    if not fs.exists(path):
        return None
    run = spark.read.text(f"{target.rstrip('/')}/CURRENT").first()[0]
    return f"{target.rstrip('/')}/runs/{run}"


def publication(spark: SparkSession, target: str, force: bool = False, failure_injector: Callable[[str], None] | None = None) -> Publication | VersionedPublication:
    """By rename for paths of mounted file systems, by versions for addresses of stores (``scheme://``)."""
    return VersionedPublication(spark, target, force, failure_injector) if "://" in target else Publication(target, force, failure_injector)


def run_id(inputs: dict[str, str], settings: dict) -> str:
    """Deterministic id of a run: of its inputs' checksums and its settings."""
    return hashlib.sha256(to_json({"inputs": inputs, "settings": settings}).encode()).hexdigest()


def csv_report(rows: Iterable[dict], columns: list[str]) -> str:
    """A small report as CSV text: LF line ends, nothing for null."""
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    w.writerows(["" if r[c] is None else r[c] for c in columns] for r in rows)
    return out.getvalue()


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A small report as a Markdown table; numbers with thousands separators."""

    def cell(v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, int):
            return f"{v:,}"
        return f"{v:,.2f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]) + "\n"
