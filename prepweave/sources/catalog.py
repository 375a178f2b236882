"""Folders of files: scan, fingerprints, and which files of a batch take part."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.errors import PlanError


@dataclass(frozen=True)
class FolderConfig:
    root_path: str
    recursive: bool = False
    include: list[str] = field(default_factory=lambda: ["*"])
    exclude: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: ["csv", "xlsx", "xlsm"])
    maximum_files: int = 5000


def matches(pattern: str) -> str:
    """A regular expression of Spark's for a pattern as fnmatch takes it, with regard to case."""
    out, i = [], 0
    code = lambda c: f"\\x{{{ord(c):x}}}"
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c in "*?":
            out.append(".*" if c == "*" else ".")
            continue
        start = i + (pattern[i : i + 1] == "!")
        end = pattern.find("]", start + 1) if c == "[" else -1
        if end < 0:
            out.append(code(c))
            continue
        inside, members, k = pattern[start:end], [], 0
        while k < len(inside):
            if inside[k + 1 : k + 2] == "-" and k + 2 < len(inside):
                if inside[k] <= inside[k + 2]:  # a range from high to low holds nothing
                    members.append(f"{code(inside[k])}-{code(inside[k + 2])}")
                k += 3
            else:
                members.append(code(inside[k]))
                k += 1
        out.append(f"[{'^' * (start > i)}{''.join(members)}]" if members else "." if start > i else "(?!)")
        i = end + 1
    return "(?s)\\A" + "".join(out) + "\\z"


def scan_folder(spark: SparkSession, config: FolderConfig) -> DataFrame:
    """A row per file: relative_path, path, bytes, sha256; in order of the path without regard to case.

    Spark lists and hashes the files, so the folder can be in any store. At most maximum_files come; more is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(config.recursive).lower()).load(config.root_path)
    root = config.root_path.split("://")[-1].rstrip("/")
    relative = F.expr(f"substring(path, locate('{root.replace(chr(39), '')}', path) + {len(root) + 1})")
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    listed = files.select("path", F.col("length").alias("bytes"), relative.alias("relative_path")).filter(ending.isin([e.lower().lstrip(".") for e in config.extensions]))
    if not config.recursive:
        listed = listed.filter(~F.contains("relative_path", F.lit("/")))
    any_of = lambda patterns: reduce(Column.__or__, [F.col("relative_path").rlike(matches(p)) for p in patterns], F.lit(False))
    listed = listed.filter(any_of(config.include) & ~any_of(config.exclude))
    kept = [r["relative_path"] for r in listed.select("relative_path").limit(config.maximum_files + 1).collect()]  # bounded
    if len(kept) > config.maximum_files:
        raise PlanError("FOLDER_TOO_MANY_FILES", str(config.maximum_files))
    chosen = spark.createDataFrame([(n,) for n in kept], "relative_path string")
    hashed = files.select("path", F.col("length").alias("bytes"), relative.alias("relative_path"), F.sha2("content", 256).alias("sha256"))
    return hashed.join(F.broadcast(chosen), "relative_path", "left_semi").select("relative_path", "path", "bytes", "sha256").orderBy(F.lower("relative_path"), "relative_path")


def classify_batch(scanned: DataFrame, previous: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """Adds state: duplicate (of an earlier file's content), unchanged (in the last batch), quarantined, else eligible.

    previous has column sha256, failed has relative_path and reason.
    """
    order = W.partitionBy("sha256").orderBy(F.lower("relative_path"), "relative_path")
    df = scanned.withColumn("__n", F.row_number().over(order))
    spark = scanned.sparkSession
    before = (previous.select("sha256") if previous is not None else spark.createDataFrame([], "sha256 string")).distinct().withColumn("__seen", F.lit(True))
    bad = failed if failed is not None else spark.createDataFrame([], "relative_path string, reason string")
    df = df.join(before, "sha256", "left").join(bad, "relative_path", "left")
    state = F.when(F.col("__n") > 1, "duplicate").when(F.col("__seen"), "unchanged").when(F.col("reason").isNotNull(), "quarantined").otherwise("eligible")
    return df.withColumn("state", state).select("relative_path", "path", "bytes", "sha256", "state", "reason")


CATALOG = "relative_path string, state string, table_id string, rows long, columns array<struct<column:string,data_type:string>>, warnings array<string>, reason string"


def build_catalog(spark: SparkSession, scanned: DataFrame, previous: DataFrame | None = None, table_strategy: str = "first_visible", overrides=None, at_once: int = 8) -> DataFrame:
    """Each file of a scan with its state and, if it takes part, the table that discovery chooses in it: id, estimated data
    rows, columns with types, warnings.

    A file whose content an earlier one has is a duplicate, one that the last batch had is unchanged; neither is read. A file
    in which no table is found, or that can't be read, is quarantined with the reason, and the others go on. at_once files
    are looked at in parallel, each by Spark jobs of its own; a file takes a row on the driver.
    """
    from concurrent.futures import ThreadPoolExecutor

    from prepweave.sources import discovery
    from prepweave.sources.grid import read_source

    settings = overrides or discovery.Overrides()
    files = classify_batch(scanned, previous).orderBy(F.lower("relative_path"), "relative_path").collect()  # bounded by the scan

    def look(f) -> tuple:
        if f["state"] != "eligible":
            return f["relative_path"], f["state"], None, None, [], [], f["reason"]
        try:
            grid = read_source(spark, f["path"])
            found = discovery.assemble(grid, discovery.choose(discovery.discover(grid, settings), table_strategy), settings)
        except PlanError as e:
            return f["relative_path"], "quarantined", None, None, [], [], e.code
        except Exception as e:  # noqa: BLE001  a file that can't be read must not end the batch
            return f["relative_path"], "quarantined", None, None, [], [], f"SOURCE_DISCOVERY_FAILED: {type(e).__name__}"
        return f["relative_path"], "eligible", found.table.region.table_id, found.rows, [(c["column"], c["data_type"]) for c in found.columns], found.warnings, None

    with ThreadPoolExecutor(at_once) as pool:
        return spark.createDataFrame(list(pool.map(look, files)), CATALOG)


def import_source(spark: SparkSession, path: str, root: str) -> tuple[str, str]:
    """Copies a file into a folder of its own below the managed root, under a safe name, and leaves the given one as it is;
    returns the copy's path and fingerprint. Other types than delimited files and workbooks are an error."""
    import re
    import uuid

    name = path.rstrip("/").rpartition("/")[2]
    stem, _, ending = name.rpartition(".")
    if ending.lower() not in ("csv", "tsv", "txt", "xlsx", "xlsm"):
        raise PlanError("SOURCE_UNSUPPORTED_TYPE", ending)
    safe = re.sub(r"[^A-Za-z0-9._-]+", "_", stem).strip("._")[:100] or "source"
    copy = f"{root.rstrip('/')}/{uuid.uuid4().hex}/{safe}.{ending.lower()}"
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, target = hadoop.Path(path), hadoop.Path(copy)
    store = source.getFileSystem(conf)
    if not store.exists(source):
        raise PlanError("SOURCE_NOT_FOUND", path)
    hadoop.FileUtil.copy(store, source, target.getFileSystem(conf), target, False, conf)
    return copy, fingerprint(spark, copy)


def fingerprint(spark: SparkSession, path: str) -> str:
    """The SHA-256 of one file; of a folder that of its files' hashes in order."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()
    if not rows:
        raise PlanError("SOURCE_NOT_FOUND", path)
    if len(rows) == 1:
        return rows[0]["h"]
    import hashlib

    return hashlib.sha256("".join(r["h"] for r in rows).encode()).hexdigest()


def assert_unchanged(spark: SparkSession, path: str, expected: str) -> None:
    if fingerprint(spark, path) != expected:
        raise PlanError("SOURCE_CHANGED", path)
