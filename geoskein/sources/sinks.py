"""Writers with contracts, and the ledger of imports."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoskein.operators.relational import ContractError, assert_checks, symmetric_difference


def write_counted(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Writes Parquet and returns the rows that the files hold, counted from their footers."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def replace_snapshot(df: DataFrame, path: str, partition: str = "snapshot_date") -> None:
    """Replaces only the snapshots that ``df`` holds; the others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(partition).parquet(path)


def insert_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows whose keys are not there yet, one per key; returns how many."""
    spark = df.sparkSession
    new = df.dropDuplicates(list(keys))
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    before = spark.read.parquet(path).count() if _exists(spark, path) else 0
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def insert_once(df: DataFrame, path: str) -> bool:
    """Writes a frozen table, or verifies that it is the same; a difference is refused.  Returns whether it was written."""
    spark = df.sparkSession
    if not _exists(spark, path):
        df.write.parquet(path)
        return True
    if not symmetric_difference(spark.read.parquet(path), df).isEmpty():
        raise ContractError(f"{path} is frozen and differs")
    return False


def staged_write(df: DataFrame, path: str, checks: Mapping[str, Column]) -> None:
    """Writes beside the target, checks the written rows, and only then puts them in place.

    The former table steps aside and goes only once the new one stands; if a rename fails it comes back.
    """
    spark = df.sparkSession
    staging, aside = f"{path}.staging", f"{path}.former"
    df.write.mode("overwrite").parquet(staging)
    assert_checks(spark.read.parquet(staging), checks)
    fs, target = _fs(spark, path)
    former = _fs(spark, aside)[1]
    fs.delete(former, True)
    replaces = fs.exists(target)
    if replaces and not fs.rename(target, former):
        raise ContractError(f"{path} cannot be moved aside")
    if not fs.rename(_fs(spark, staging)[1], target):
        if replaces:
            fs.rename(former, target)
        raise ContractError(f"{staging} cannot be put in place")
    fs.delete(former, True)


def write_single_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small aggregate as one sorted CSV part with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_json_atomic(value: object, path: str) -> None:
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(part, path)


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length, sha256) of files, hashed on the executors."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def ordered_digest(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None) -> str:
    """SHA-256 over the rows, as texts joined by '|', in the order of their keys; rows stream through the driver one partition at a time."""
    columns = list(columns or df.columns)
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    digest = hashlib.sha256()
    for row in df.orderBy(*order).select(line.alias("l")).toLocalIterator(prefetchPartitions=True):
        digest.update(row.l.encode("utf-8") + b"\n")
    return digest.hexdigest()


def content_digest(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of row hashes): the same for equal tables in any order, one pass, no sort."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(c).cast("string") for c in df.columns]).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


class Ledger:
    """Registered sources and import runs in one JSON file, written atomically.

    A source is registered with its digest; the same content registers again under its id, changed content is refused.
    A finished import of a source into a table is not repeated; other options for it are refused.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.state: dict = {"sources": {}, "runs": [], "migrations": {}}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.state = json.load(f)

    def _save(self) -> None:
        write_json_atomic(self.state, self.path)

    def register(self, path: str, expected_sha256: str | None = None) -> int:
        if not os.path.isfile(path):
            raise ContractError(f"{path} is no regular file")
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
        found = digest.hexdigest()
        if expected_sha256 and expected_sha256 != found:
            raise ContractError(f"{path} does not match its manifest")
        known = self.state["sources"].get(path)
        if known:
            if known["sha256"] != found:
                raise ContractError(f"{path} changed since it was registered")
            return known["id"]
        new = {"id": len(self.state["sources"]) + 1, "sha256": found, "size": os.path.getsize(path)}
        self.state["sources"][path] = new
        self._save()
        return new["id"]

    def run(self, source_id: int, table: str, options: Mapping, work) -> str:
        """Runs ``work()`` -> rows once: 'success', or 'already_imported'; a failure is recorded without secrets and raised."""
        for r in self.state["runs"]:
            if (r["source_id"], r["table"], r["status"]) == (source_id, table, "success"):
                if r["options"] != dict(options):
                    raise ContractError(f"{table} was imported with other options")
                return "already_imported"
        entry = {"source_id": source_id, "table": table, "options": dict(options), "status": "running", "started": time.time()}
        self.state["runs"].append(entry)
        self._save()
        try:
            entry |= {"rows": int(work()), "status": "success"}
        except Exception as error:
            entry |= {"status": "failed", "error": re.sub(r"(?i)(password|token|secret)=\S+", r"\1=***", str(error))[:500]}
            raise
        finally:
            self._save()
        return "success"

    def migrate(self, steps: Sequence[tuple[str, str]], apply) -> list[str]:
        """Applies each (name, text) once in order; a changed applied step is refused.  Returns the names applied now."""
        done = []
        for name, text in steps:
            digest = hashlib.sha256(text.encode()).hexdigest()
            known = self.state["migrations"].get(name)
            if known and known != digest:
                raise ContractError(f"applied step {name} changed")
            if not known:
                apply(text)
                self.state["migrations"][name] = digest
                done.append(name)
                self._save()
        return done
