"""Repository files, manifests and change sources."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.operators.extract import EXTENSIONS
from codelode.operators.ingest import manifest_diff
from codelode.streaming.changes import MAX_BYTES, glob_pattern, wanted


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file as globs of whole paths, in its order; negations keep their `!`, comments are left out.

    A pattern with a slash before its end holds from the root, as one that begins with a slash."""
    out = []
    for line in text.splitlines():
        p = line.strip()
        if p and p[0] != "#":
            sign, p = ("!", p[1:]) if p[0] == "!" else ("", p)
            base = p.strip("/")
            rooted = "/" in p.rstrip("/")
            own = [] if p.endswith("/") else [base if rooted else f"**/{base}"]
            out += [sign + g for g in [*own, f"{base}/**" if rooted else f"**/{base}/**"]]
    return out


def _listed(spark: SparkSession, root: str, ignore: list[str], extensions: list[str] | None) -> DataFrame:
    """path (relative), size, modificationTime and content of the files to index; a file that goes after it is listed counts as gone."""
    kinds = sorted(extensions or EXTENSIONS)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("pathGlobFilter", "*.{" + ",".join([*kinds, *[k.upper() for k in kinds]]) + "}")
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^.*?" + re.escape(base), "")
    rows = reader.load(root).filter(F.col("length") <= MAX_BYTES).select(relative.alias("path"), F.col("length").alias("size"), "modificationTime", "content")
    return rows.filter(wanted(F.col("path"), F.col("size"), list(ignore), list(extensions or EXTENSIONS)))


def repository_files(spark: SparkSession, root: str, repository_id: str, package: str | None = None, ignore: list[str] = (), extensions: list[str] | None = None) -> DataFrame:
    """repository_id, path (relative), content, package, size of the files to index, read by the executors.

    Names are filtered while the files are listed, sizes before they are read; the file system follows symbolic links."""
    rows = _listed(spark, root, ignore, extensions)
    text = F.decode("content", "utf-8")
    return rows.select(F.lit(repository_id).alias("repository_id"), "path", text.alias("content"), F.lit(package).alias("package"), "size")


def watch(spark: SparkSession, root: str, schema: str, per_trigger: int = 10) -> DataFrame:
    """A stream of change rows from JSON files that appear under root; batches of at most per_trigger files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(root)


def file_changes(spark: SparkSession, root: str, state: str, step: int, ignore: list[str] = (), extensions: list[str] | None = None) -> DataFrame:
    """path, change_type of the files that were created, modified or deleted since the step before.

    Sizes and times are compared, contents are not read; a renamed file is deleted and created, and
    an empty file counts as none, as the reader leaves such files out.  A step's
    listing is written to the folder `state` once, so a step that is run again gives the same changes, as
    long as no later one has run; listings before the last two go."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(state)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda n: f"{state.rstrip('/')}/listing={n}"
    whole = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(at(n) + "/_SUCCESS"))
    if not whole(step):
        mark = F.concat_ws(":", "size", F.unix_micros("modificationTime"))
        _listed(spark, root, ignore, extensions).select("path", mark.alias("blob")).write.mode("overwrite").parquet(at(step))
    names = [s.getPath().getName().partition("=") for s in fs.listStatus(folder)]
    steps = sorted(int(n) for head, _, n in names if head == "listing" and n.isdigit())
    before = [n for n in steps if n < step and whole(n)]
    for n in before[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(at(n)), True)
    read = lambda n: spark.read.schema("path string, blob string").parquet(at(n))
    found = manifest_diff(read(before[-1]) if before else None, read(step))
    return found.select("path", F.replace(F.initcap("change"), F.lit("Added"), F.lit("Created")).alias("change_type"))


def watch_files(spark: SparkSession, root: str, state: str, apply: Callable[[DataFrame, int], None], seconds: float = 1, ignore: list[str] = (), extensions: list[str] | None = None) -> StreamingQuery:
    """A running query that lists the files every `seconds` and gives each step's changes, if there are any, to `apply`.

    It goes on from the folder `state` after a restart; a step whose `apply` failed is run again."""

    def run(_, step: int) -> None:
        changes = file_changes(spark, root, state, step, ignore, extensions)
        if not changes.isEmpty():
            apply(changes, step)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", f"{state.rstrip('/')}/ticks").trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def workspace_members(globs: list[str], directories: list[str]) -> list[str]:
    return sorted(d for d in directories if any(re.match(glob_pattern(g.strip("/")), d) for g in globs))


def manifest_packages(files: dict[str, str]) -> list[dict]:
    """Packages (directory, name, source_root) of a repository's manifests, given as path to text.

    Cargo comes first, then pyproject, then package.json; workspaces give their members.  The list is small: one row per package."""
    top = {p.rsplit("/", 1)[-1]: t for p, t in files.items() if "/" not in p}
    directories = {p.rsplit("/", 1)[0] for p in files if "/" in p}
    cargo = lambda t: tomllib.loads(t)

    def row(directory, name, root):
        return {"directory": directory, "name": name, "source_root": "/".join(x for x in (directory, root) if x)}

    if "Cargo.toml" in top:
        spec = cargo(top["Cargo.toml"])
        members = workspace_members(spec.get("workspace", {}).get("members", []), [d for d in directories if f"{d}/Cargo.toml" in files])
        found = [row("", spec["package"]["name"].replace("-", "_"), "src")] if "package" in spec else []
        return found + [row(d, cargo(files[f"{d}/Cargo.toml"])["package"]["name"].replace("-", "_"), "src") for d in members]
    if "pyproject.toml" in top:
        spec = tomllib.loads(top["pyproject.toml"])
        name = spec.get("project", {}).get("name") or spec.get("tool", {}).get("poetry", {}).get("name") or "package"
        plain = name.replace("-", "_")
        root = next((d for d in ("src", plain) if any(p.startswith(d + "/") for p in files)), "")
        return [row("", plain, root)]
    if "package.json" in top:
        spec = json.loads(top["package.json"])
        work = spec.get("workspaces", [])
        work = work.get("packages", []) if isinstance(work, dict) else work
        members = workspace_members(work, [d for d in directories if f"{d}/package.json" in files])
        found = [] if work else [row("", spec.get("name", ""), "src")]
        return found + [row(d, json.loads(files[f"{d}/package.json"]).get("name", d), "src") for d in members]
    return []
