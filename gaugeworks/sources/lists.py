"""Configuration files: YAML in, dataset lists and snapshots out, reports as text."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from .records import dump_text


def text(spark: SparkSession, path: str) -> str | None:
    """A small file whole, wherever Spark reads; None where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def scalar(s: str):
    """A plain YAML scalar, or a flow list or map of them."""
    s = s.strip()
    if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
        return json.loads(s) if s[0] == '"' else s[1:-1].replace("''", "'")
    if s[:1] == "[" and s[-1:] == "]":
        return [scalar(x) for x in _parts(s[1:-1])]
    if s[:1] == "{" and s[-1:] == "}":
        return {k.strip(): scalar(v) for k, _, v in (x.partition(":") for x in _parts(s[1:-1]))}
    if s in ("", "~", "null"):
        return None
    if s in ("true", "True", "false", "False"):
        return s.lower() == "true"
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def _parts(s: str) -> list[str]:
    """s cut at commas outside brackets and quotes."""
    out, depth, quote, now = [], 0, "", ""
    for c in s:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(now)
            now = ""
        else:
            now += c
    return [x for x in [*out, now] if x.strip()]


def minimal(source: str):
    """YAML of nested maps, lists of scalars or maps, plain and quoted scalars, flow lists and maps, comments: what configuration files here use."""
    lines = []
    for raw in source.splitlines():
        kept = re.sub(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')|(?:^|(?<=\s))#.*$""", lambda m: m[1] or "", raw).rstrip()
        if kept.strip() and kept.strip() != "---":
            lines.append((len(kept) - len(kept.lstrip()), kept.strip()))

    def block(at: int, depth: int):
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out: list = []
            while at < len(lines) and lines[at][0] == depth and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
                rest = lines[at][1][1:].strip()
                if re.match(r"[^\s\"'\[{][^:]*:(\s|$)", rest):  # a map that begins behind the dash
                    inner = depth + len(lines[at][1]) - len(rest)
                    lines[at] = (inner, rest)
                    value, at = block(at, inner)
                elif rest:
                    value, at = scalar(rest), at + 1
                elif at + 1 < len(lines) and lines[at + 1][0] > depth:
                    value, at = block(at + 1, lines[at + 1][0])
                else:
                    value, at = None, at + 1
                out.append(value)
            return out, at
        found: dict = {}
        while at < len(lines) and lines[at][0] == depth:
            key, colon, rest = lines[at][1].partition(":")
            if not colon:
                raise ValueError(f"not a map entry: {lines[at][1]}")
            under = at + 1 < len(lines) and (lines[at + 1][0] > depth or lines[at + 1][0] == depth and lines[at + 1][1].startswith("- "))
            if rest.strip() or not under:
                found[scalar(key)], at = scalar(rest), at + 1
            else:
                found[scalar(key)], at = block(at + 1, lines[at + 1][0])
        return found, at

    if not lines:
        return None
    value, at = block(0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"cannot read: {lines[at][1]}")
    return value


def load(source: str):
    """YAML by the library if it is installed, else by minimal()."""
    try:
        import yaml
    except ImportError:
        return minimal(source)
    return yaml.safe_load(source)


def config(spark: SparkSession, path: str) -> dict:
    """A configuration file; an empty map where there is none."""
    found = text(spark, path)
    return (load(found) if found else None) or {}


def members(spark: SparkSession, config: dict, key: str = "datasets") -> DataFrame | None:
    """(place, member) of a list in a configuration, names or maps with a task_id, as a frozen suite has under `tasks`; None if it is empty or lacks."""
    found = config.get(key) or []
    return spark.createDataFrame([(k, str(m["task_id"] if isinstance(m, dict) else m)) for k, m in enumerate(found)], "place long, member string") if found else None


def write_subset(spark: SparkSession, path: str, names: list[str], head: dict, comment: list[str] = ()) -> None:
    """A dataset list: comment lines, the head's entries, and the names, sorted."""
    body = [f"# {x}" for x in comment] + [f"{k}: {v}" for k, v in head.items()] + ["datasets:"] + [f"  - {n}" for n in sorted(names)]
    dump_text(spark, path, "\n".join(body) + "\n")


def write_snapshot(spark: SparkSession, path: str, suite: str, day: str, package: str, n_suite: int, tasks: list[tuple[int, int, str]]) -> None:
    """A frozen suite: how many tasks it has, how many stay, and each with its dataset's id and name behind it."""
    body = [f"# {suite} as of {day}: read instead of asking for it again.", f"suite: {suite}", f"snapshot_date: '{day}'", f"openml_package: '{package}'", f"n_tasks_in_suite: {n_suite}", f"n_tasks_after_core_dedup: {len(tasks)}", "tasks:"]
    dump_text(spark, path, "\n".join(body + [f"  - task_id: {t}    # dataset_id={d}  {name}" for t, d, name in tasks]) + "\n")


def report(rows: DataFrame, title: str = "", most: int = 1000) -> str:
    """A table as aligned text, its first `most` rows: for people, of tables with a row for a system, claim or assertion."""
    got = rows.limit(most).collect()
    table = [list(rows.columns)] + [["" if v is None else str(v) for v in r] for r in got]
    width = [max(len(r[k]) for r in table) for k in range(len(table[0]))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in table]
    return "\n".join([*([title, "=" * len(title)] if title else []), *lines]) + "\n"


def verdict_report(verdict: DataFrame) -> str:
    """A gate's rows as PASS and FAIL lines."""
    rows = {r["id"]: r for r in verdict.collect()}
    line = lambda r: f"[{'PASS' if r['passed'] else 'FAIL'}] {r['id']:4s} {r['message']}"
    return "\n".join([line(r) for k, r in sorted(rows.items()) if k != "ALL"] + ["GATE PASSED" if rows["ALL"]["passed"] else f"GATE FAILED: {rows['ALL']['message']}"]) + "\n"
