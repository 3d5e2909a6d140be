"""K1 to K3, D1, D2 and the constraints of the tables.

A store is a folder of versions and a log. A rebuild writes its tables to a folder of its own, checks
them, and then claims the log's next number by an entry that can be put there only once. So of rebuilds
that began from the same version one wins and the others fail, whole; and a reader that holds a snapshot
sees one version in all tables, whatever is committed meanwhile, until it expires.

Paths are opened through Spark's own file systems. Claims need a file system on which a rename fails where
the target exists, as on HDFS; on local disks a hard link stands for it.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENUMS = {
    "people": {"gig_status": ("active", "inactive", "paused", "unknown"), "is_verified": (0, 1), "match_confidence": ("high", "medium", "single-source")},
    "person_identifiers": {"id_type": ("email", "phone")},
    "data_issues": {"severity": ("low", "medium", "high")},
}
#: table: keys that do not repeat; rows with a null in the key are exempt.
UNIQUE = {
    "people": (("person_id",), ("primary_email",), ("primary_phone",)), "person_identifiers": (("id_type", "value"),), "person_sources": (("source_file", "source_row"),),
    "skills": (("skill_id",), ("canonical_name",), ("match_key",)), "person_skills": (("person_id", "skill_id"),),
}
#: (table, column, table referred to)
FOREIGN = (("person_identifiers", "person_id", "people"), ("person_sources", "person_id", "people"), ("person_skills", "person_id", "people"),
    ("person_skills", "skill_id", "skills"))


def repeated_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str | None = None) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key or column).alias(column)).hint("merge"), column, "left_anti")


def out_of_range(df: DataFrame, column: str, allowed: tuple) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, table_name, key, n: how often each constraint is broken; a row for each constraint."""
    found = []
    say = lambda kind, table, key, df: found.append(df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"),
        F.lit(table).alias("table_name"), F.lit(key).alias("key"), "n"))
    for t, df in tables.items():
        for c, allowed in ENUMS.get(t, {}).items():
            say("check", t, c, out_of_range(df, c, allowed))
        for keys in UNIQUE.get(t, ()):
            say("unique", t, ",".join(keys), repeated_keys(df, keys))
    for t, c, parent in FOREIGN:
        if t in tables and parent in tables:
            say("foreign", t, c, orphans(tables[t], c, tables[parent]))
    return reduce(DataFrame.unionByName, found)


def constraints() -> list[tuple[str, str, str]]:
    """(kind, table, key) of every constraint."""
    out = [("check", t, c) for t, columns in ENUMS.items() for c in columns] + [("unique", t, ",".join(k)) for t, keys in UNIQUE.items() for k in keys]
    return out + [("foreign", t, c) for t, c, _ in FOREIGN]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


class ConcurrentRebuild(RuntimeError):
    """Another rebuild has been committed since this one began."""


@dataclass(frozen=True)
class Snapshot:
    """One version of the tables."""

    spark: SparkSession = field(repr=False)
    path: str
    version: int
    folder: str
    names: tuple[str, ...]
    committed: float

    def table(self, name: str) -> DataFrame:
        """A table of this version."""
        if name not in self.names:
            raise KeyError(f"version {self.version} of {self.path} has no table {name}")
        return self.spark.read.parquet(f"{self.path}/{self.folder}/{name}")

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in self.names}


def _log(path: str) -> str:
    return f"{path}/_log"


def _entry(path: str, version: int) -> str:
    return f"{_log(path)}/{version:020d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions that have not expired, ascending."""
    fs, folder, _ = _fs(spark, _log(path))
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file is now there with this text, whole; False if it was there before."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    _write_text(spark, draft, text)
    fs, source, jvm = _fs(spark, draft)
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        if fs.getUri().getScheme() != "file":
            return bool(fs.rename(source, target))
        local = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
        try:
            jvm.java.nio.file.Files.createLink(local(target), local(source))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True
    finally:
        fs.delete(source, False)


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The handle on a version, by default the last that is committed; it stays on that version."""
    while True:
        known = versions(spark, path)
        if not known or (version is not None and version not in known):
            raise LookupError(f"{path} has no version" + ("" if version is None else f" {version}"))
        number = known[-1] if version is None else version
        try:
            entry = json.loads("\n".join(r[0] for r in spark.read.text(_entry(path, number)).collect()))  # one small file
        except AnalysisException:
            if version is not None or versions(spark, path) == known:
                raise
            continue  # it has expired meanwhile, so there are newer ones
        return Snapshot(spark, path, number, entry["folder"], tuple(entry["tables"]), entry["committed"])


def rebuild(spark: SparkSession, path: str, tables: dict[str, DataFrame], base: int | None = None) -> int:
    """Write all tables as a new version, check them, then commit it; the version's number.

    base: the version that the tables are made from, 0 for none; by default the last one as this call begins.
    Raises ConcurrentRebuild if another version has been committed since, and ValueError if constraints are
    broken; either way nothing of this rebuild stays and readers see what they saw.
    """
    base = (versions(spark, path) or [0])[-1] if base is None else base
    folder = f"v-{uuid.uuid4().hex}"
    fs, made, _ = _fs(spark, f"{path}/{folder}")
    try:
        for name, df in tables.items():
            df.write.parquet(f"{path}/{folder}/{name}")
        broken = violations({n: spark.read.parquet(f"{path}/{folder}/{n}") for n in tables}).where("n > 0").collect()
        if broken:
            raise ValueError(f"constraints broken, the old version stays: {broken}")
        known = versions(spark, path)
        entry = json.dumps({"folder": folder, "tables": list(tables), "base": base, "committed": time.time()})
        if (known and known[-1] > base) or not _put_if_absent(spark, _entry(path, base + 1), entry):
            raise ConcurrentRebuild(f"version {base + 1} of {path} has been committed by another rebuild")
    except BaseException:
        fs.delete(made, True)
        raise
    return base + 1


def expire(spark: SparkSession, path: str, keep: int = 2, older_than: float = 7 * 86400.0) -> list[int]:
    """Delete versions committed more than `older_than` seconds ago, but for the last `keep`, and folders as old
    that no version names, as a killed rebuild leaves them; the versions that went. The time is what readers
    have to finish with a snapshot, and what a rebuild may take."""
    if keep < 1:
        raise ValueError("the last version stays")
    known, now = versions(spark, path), time.time()
    held = {v: snapshot(spark, path, v) for v in known}
    gone = [v for v in known[:-keep] if now - held[v].committed >= older_than]
    for v in gone:  # first from the log, so that no new reader finds it
        fs, p, _ = _fs(spark, _entry(path, v))
        fs.delete(p, False)
    named = {s.folder for v, s in held.items() if v not in gone}
    fs, root, _ = _fs(spark, path)
    if fs.exists(root):
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            dead = any(held[v].folder == name for v in gone)
            if name.startswith("v-") and name not in named and (dead or now - f.getModificationTime() / 1000 >= older_than):
                fs.delete(f.getPath(), True)
    return gone


def current(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the last version. Who reads several takes a snapshot."""
    return snapshot(spark, path).table(table)


def write_csv_report(issues: DataFrame, path: str) -> None:
    """K2: CSV files with header, quoted as RFC 4180 has it; in the order of their names they are in the order of issues."""
    issues.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_review(review: DataFrame, path: str) -> None:
    """K3: an item, or a candidate of an item, a line."""
    review.write.mode("overwrite").json(path)
