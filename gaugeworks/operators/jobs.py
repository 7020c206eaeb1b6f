"""The job side of a run: dataset tokens, checks of declared against shipped data, cells that are executed one by one, stamps."""

from __future__ import annotations

import hashlib
import importlib.metadata
import importlib.resources
import json
import os
import platform
import select
import signal
import socket
import sys
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import session

# ---- tokens


def expand(family: str, config: dict, members: DataFrame | None) -> DataFrame | list[str]:
    """(place, dataset): the tokens of a family out of members (place, member), in order.

    config: emit_as renames the family in tokens; resolve and max_datasets, that a frozen suite is cut to its first ones. A family without members is one
    bare token, given as a list.
    """
    if members is None:
        return [family]
    emit = config.get("emit_as") or family
    rows = members.select("place", F.concat(F.lit(f"{emit}:"), F.col("member").cast("string")).alias("dataset"))
    most = config.get("max_datasets") if config.get("resolve") else None
    return rows.orderBy("place").limit(int(most)) if most else rows


# ---- declared against shipped


def mismatch(declared: DataFrame, effective: DataFrame) -> DataFrame:
    """(member, declared, effective) where both are known and differ, by member."""
    return declared.select("member", F.col("kind").alias("declared")).join(effective.select("member", F.col("kind").alias("effective")), "member").where("declared <> effective").orderBy("member")


def tallies(rows: DataFrame, column: str = "kind") -> DataFrame:
    """(kind, n) in order of kind."""
    return rows.groupBy(F.col(column).alias("kind")).agg(F.count(F.lit(1)).alias("n")).orderBy("kind")


def drift(live: DataFrame, frozen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): rows that only one of two sets has, `live` or `frozen`."""
    side = lambda a, b, name: a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit(name))
    return side(live, frozen, "live").unionByName(side(frozen, live, "frozen")).orderBy("side", *keys)


def absent(listed: DataFrame, found: DataFrame, key: str = "member") -> DataFrame:
    """Listed members that nothing was found for, sorted: folders that lack, systems that completeness dropped."""
    return listed.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").orderBy(key)


def train_size(told: Column, *arrays: Column) -> Column:
    """Training rows: as told, or else the length of the first array that is there."""
    return F.coalesce(told, *[F.when(a.isNotNull(), F.size(a)) for a in arrays])


def label_check(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """(member, override, dtype, distinct_y, not_binary) of overridden members, from rows (member, y): an override to binclass needs two labels."""
    kind = F.lit(rows.schema["y"].dataType.simpleString())
    seen = rows.join(overrides.select("member"), "member", "left_semi").groupBy("member").agg(F.count_distinct("y").alias("distinct_y"))
    out = overrides.select("member", F.col("kind").alias("override")).join(seen, "member", "left")
    return out.select("member", "override", F.when(F.col("distinct_y").isNotNull(), kind).alias("dtype"), "distinct_y", ((F.col("override") == "binclass") & ~F.col("distinct_y").eqNullSafe(2)).alias("not_binary"))


def stratum_coverage(items: DataFrame, chosen: DataFrame, stratum: str, name: str) -> DataFrame:
    """(stratum, selected, total) in order of stratum."""
    hit = items.join(chosen.select(name, F.lit(True).alias("__c")), name, "left")
    return hit.groupBy(stratum).agg(F.count("__c").alias("selected"), F.count(F.lit(1)).alias("total")).orderBy(stratum)


def survival_rate(claims: DataFrame) -> DataFrame:
    """One row (n_claims, n_survived, survival_rate) over claims with a verdict or without; no claims, no rate."""
    return claims.agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.coalesce("survives", F.lit(False))).alias("n_survived")).withColumn("survival_rate", F.try_divide(F.col("n_survived"), F.col("n_claims")))


def axes_present(records: DataFrame) -> DataFrame:
    """One row (families, protocols), each sorted and once."""
    return records.agg(F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set("protocol")).alias("protocols"))


def renamed(rows: DataFrame, aliases: DataFrame, column: str = "member") -> DataFrame:
    """rows with external_name: the alias of the member, or its own name."""
    return rows.join(aliases.select(F.col("member").alias(column), F.col("external_name").alias("__e")), column, "left").withColumn("external_name", F.coalesce("__e", column)).drop("__e")


def unresolved(ids: DataFrame) -> DataFrame:
    """One row (n, n_ok, n_missing) of an id table by status."""
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "missing_VERIFY").alias("n_missing"))


def context_reductions(rows: DataFrame, log: str) -> DataFrame:
    """rows with context_reduced, context_from, context_to and context_reduction_steps out of a fit's log."""
    line = r"Reducing max_samples_support from\s*(\d+)\s*to\s*(\d+)"
    first, last = (F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(line), F.lit(g)) for g in (1, 2))
    return rows.withColumns({"context_reduced": F.size(first) > 0, "context_from": F.try_element_at(first, F.lit(1)).cast("int"), "context_to": F.try_element_at(last, F.lit(-1)).cast("int"), "context_reduction_steps": F.size(first)})


# ---- stamps


def fingerprint(packages: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow"), sources: tuple[str, ...] = ()) -> dict:
    """Interpreter, prefix, host, versions of packages (null if one isn't there) and the first 16 digits of the sources' SHA-256."""
    def version(name: str) -> str | None:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return None

    digest = hashlib.sha256()
    for path in sorted(sources):
        with open(path, "rb") as f:
            digest.update(f.read())
    return {"python": platform.python_version(), "prefix": sys.prefix, "hostname": socket.gethostname(), "code_sha256": digest.hexdigest()[:16] if sources else None, "versions": {p: version(p) for p in packages}}


def leg(axes: dict[str, list], units: list[str], timeout_s: int, env: dict, shard: str | None = None, no_resume: bool = False, same_host_shards: bool = False, now: str | None = None) -> dict:
    """The description of one invocation: when and where it began, its axes and cells."""
    return {"run_started": now or datetime.now(timezone.utc).isoformat(timespec="seconds"), "hostname": env["hostname"], "shard": shard, "no_resume": no_resume, "same_host_shards": same_host_shards, "env": env, "axes": axes, "units": units, "timeout_s": timeout_s}


def worker_stamps(spark: SparkSession, packages: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow"), slots: int | None = None) -> DataFrame:
    """(slot, host, pid, python, prefix, code_sha256, versions) of each slot of the executors, asked in one barrier stage, so that all are asked at once; code_sha256 is that of this package as the worker has it.

    slots: how many tasks there are, no more than run at a time; all of them by default. The columns are what gate.homogeneous reads.
    """
    session.ship(spark)

    def ask(batches: Iterator) -> Iterator:
        import pandas as pd

        env = fingerprint(packages)
        for b in batches:
            yield pd.DataFrame({"slot": b["id"], "host": env["hostname"], "pid": os.getpid(), "python": env["python"], "prefix": env["prefix"], "code_sha256": package_digest(), "versions": [env["versions"]] * len(b)})

    n = slots or spark.sparkContext.defaultParallelism
    return spark.range(0, n, 1, n).mapInPandas(ask, "slot long, host string, pid long, python string, prefix string, code_sha256 string, versions map<string,string>", barrier=True)


def package_digest(package: str = "gaugeworks") -> str:
    """The first 16 digits of the SHA-256 of a package's modules, from a folder or a zip file."""
    digest = hashlib.sha256()

    def walk(folder, name: str) -> None:
        for x in sorted(folder.iterdir(), key=lambda x: x.name):
            if x.is_dir() and x.name != "__pycache__":
                walk(x, f"{name}/{x.name}")
            elif x.name.endswith(".py"):
                digest.update(f"{name}/{x.name}".encode())
                digest.update(x.read_bytes())

    walk(importlib.resources.files(package), package)
    return digest.hexdigest()[:16]


# ---- cells


def memory_hint(status: str | None, exit_code: int | None) -> str | None:
    """What an exit by signal 9 without a Python error most likely was."""
    return "killed by signal 9: most likely out of memory" if status is None and exit_code in (-9, 137) else None


def _apart(work: Callable[[dict], dict], cell: dict, timeout_s: float | None) -> tuple[str, dict, int]:
    """Status, record and exit code of work(cell) in a process of its own, which is killed, with all that it started, at the limit.

    The process is the first that the kernel ends when memory runs out, so that the task goes on. Its record comes back through a pipe; one that ends without any is error:Killed by a signal, error:Exit otherwise.
    """
    back, into = os.pipe()
    child = os.fork()
    if child == 0:
        code = 1
        try:
            os.close(back)
            os.setsid()
            try:
                with open("/proc/self/oom_score_adj", "w") as f:
                    f.write("1000")
            except OSError:
                pass
            try:
                got = work(cell) or {}
                told = {"status": str(got.get("status") or "ok"), "record": got}
            except MemoryError:
                told = {"status": "error:MemoryError", "record": {}}
            except Exception as e:  # any error of a cell is that cell's result
                told = {"status": f"error:{type(e).__name__}", "record": {"msg": str(e)[:2000]}}
            with os.fdopen(into, "wb") as f:
                f.write(json.dumps(told, default=str).encode())
            code = 0
        finally:
            os._exit(code)  # nothing of the worker's own is run or flushed
    os.close(into)
    end, parts, late = None if timeout_s is None else time.monotonic() + timeout_s, [], False
    with os.fdopen(back, "rb", buffering=0) as f:
        while True:
            left = None if end is None else max(0.0, end - time.monotonic())
            if not select.select([f], [], [], left)[0]:
                late = True
                break
            if not (part := f.read(1 << 16)):
                break
            parts.append(part)
    try:
        os.killpg(child, signal.SIGKILL)  # what it started ends with it
    except ProcessLookupError:
        pass
    if late:
        os.kill(child, signal.SIGKILL)
    code = os.waitstatus_to_exitcode(os.waitpid(child, 0)[1])
    if late:
        return "error:Timeout", {}, code
    try:
        told = json.loads(b"".join(parts))
        return told["status"], told["record"], 0  # it has told all; how it ended after that doesn't matter
    except ValueError:
        return ("error:Killed" if code < 0 else "error:Exit"), {"msg": memory_hint(None, code) or f"exit code {code}"}, code


def execute(spark: SparkSession, cells: DataFrame, work: Callable[[dict], dict], timeout_s: float | None = None) -> DataFrame:
    """cells (unit, dataset, protocol, model, seed) with status, started, finished, wall_s, exit_code and record: what work gives for each cell, as JSON.

    Each cell runs in a child process of its task: native code is stopped at the limit too (error:Timeout), and a cell that is killed, by the kernel for its memory or by itself, is error:Killed with its exit code, and the rest go on. A cell's error is its
    status, error:Type. work gets all columns of cells in a dictionary and returns one with or without a status; it must not use Spark. Each cell is one row of a task, so that cells are spread like rows.
    """
    session.ship(spark)
    names = ["unit", "dataset", "protocol", "model", "seed"]
    every = cells.columns

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            out = {k: [] for k in ("status", "started", "finished", "wall_s", "exit_code", "record")}
            for row in b[every].itertuples(index=False, name=None):
                cell = {k: v.item() if hasattr(v, "item") and getattr(v, "ndim", 0) == 0 else v for k, v in zip(every, row, strict=True)}
                t0 = datetime.now(timezone.utc)
                status, got, code = _apart(work, cell, timeout_s)
                t1 = datetime.now(timezone.utc)
                record = json.dumps({k: cell[k] for k in names} | got | {"status": status}, default=str)
                for k, v in zip(out, (status, t0.isoformat(), t1.isoformat(), (t1 - t0).total_seconds(), code, record), strict=True):
                    out[k].append(v)
            yield b[names].assign(**out)

    kind = "unit string, dataset string, protocol string, model string, seed int, status string, started string, finished string, wall_s double, exit_code int, record string"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartition(parts, "unit").mapInPandas(run, kind)


def todo(spark: SparkSession, cells: DataFrame, done: DataFrame, resume: bool = True) -> DataFrame:
    """Cells to run: all of them, or, to resume, those without an ok row in done."""
    return cells.join(done.where("status = 'ok'").select("unit"), "unit", "left_anti") if resume else cells

