"""The commands: scan, ci, baseline, compliance, packs, validate-pack, test-rule, test-pack, init."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import dependencies, fixed, privacy, reports, structure, syntax, taint
from ..operators import scan as ops
from ..operators.rules import Pack, RuleLoadError, load_pack, load_pack_directory
from ..schemas import SEVERITIES
from ..sinks import documents
from ..sources import files as src

PACKS = Path(__file__).resolve().parent.parent / "packs"
DEFAULTS = {"fail_on": "CRITICAL", "warn_on": "HIGH", "enable_llm": False, "ignore": {"paths": list(paths.IGNORED)}}


def write(pieces: Iterable[str], path: str | None, after: str = "") -> None:
    """Pieces as they come, to a file or the terminal."""
    out = open(path, "w") if path else sys.stdout
    try:
        for piece in pieces:
            out.write(piece + after)
        out.write("\n")
    finally:
        if path:
            out.close()


def save(v: DataFrame, kind: str, path: str, s: dict | None = None) -> None:
    """A document of all violations as one file, written by the tasks: the driver holds its head only."""
    frames = {"json": lambda: (json.dumps({"summary": s})[:-1] + ', "violations": [', "]}\n"), "sarif": lambda: tuple(reports.sarif_frame(v, "spanwarden", "1", "scan")), "table": lambda: ("", "\n"), "baseline": lambda: (json.dumps({"version": 1, "created": datetime.now(UTC).isoformat(), "total": v.count()})[:-1] + ', "violations": [', "]}\n")}
    before, after = frames[kind]()
    rows = reports.document_rows(v, kind)
    documents.save(rows, "line", [c for c in rows.columns if c != "line"], str(Path(path).resolve()), before, after, "\n" if kind == "table" else ", ")


def result_document(v: DataFrame, s: dict) -> Iterator[str]:
    yield json.dumps({"summary": s})[:-1] + ', "violations": ['
    for i, r in enumerate(reports.result_json(v).toLocalIterator()):
        yield (", " if i else "") + r["violation"]
    yield "]}"


def load_config(path: str | None) -> dict:
    """Defaults with the file's values; an unreadable file leaves the defaults."""
    out = dict(DEFAULTS)
    if path and Path(path).exists():
        try:
            out |= yaml.safe_load(Path(path).read_text()) or {}
        except (yaml.YAMLError, TypeError, ValueError):
            pass
    return out


def scan_rules(files: DataFrame, packs: list[Pack], ignore: tuple[str, ...] = (), manifests: DataFrame | None = None) -> DataFrame:
    """Violations of all rules that can be run: patterns, syntax trees, flows and versions. ``manifests``: files of declared packages, if they
    are not among ``files``."""
    kept = files.filter(~paths.is_ignored(F.col("file_path"), ignore)) if ignore else files
    declared = kept if manifests is None else manifests.filter(~paths.is_ignored(F.col("file_path"), ignore)) if ignore else manifests
    has_patterns = any(r.type == "pattern" and r.enabled and r.patterns for p in packs for r in p.rules)
    found = [ops.scan(kept, packs) if has_patterns else None, syntax.scan_trees(kept, packs), taint.scan_flows(kept, packs), dependencies.scan_dependencies(declared, packs)]
    out = None
    for part in found:
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no rule can be used")
    return out


def scan_path(spark: SparkSession, path: str, packs: list[Pack], ignore: tuple[str, ...] = paths.IGNORED) -> tuple[DataFrame, DataFrame]:
    if Path(path).is_file():
        files = src.read_file(spark, path)
        return files, scan_rules(files, packs, ignore)
    files = src.read_tree(spark, str(Path(path).resolve()))
    manifests = src.read_tree(spark, str(Path(path).resolve()), suffixes=()) if any(r.type == "dependency" and r.enabled for p in packs for r in p.rules) else None
    return files, scan_rules(files, packs, ignore, manifests)


def summary(violations: DataFrame, files: DataFrame, packs: list[Pack], fail_on: str, warn_on: str) -> dict:
    status = ops.gate(violations, fail_on, warn_on).first()
    return {"total_files_scanned": files.count(), "total_violations": status["total_violations"], "by_severity": {r["severity"]: r["n"] for r in ops.by_severity(violations).collect()}, "by_pack": {r["pack_id"]: r["n"] for r in ops.by_pack(violations).collect()}, "packs_run": [p.id for p in packs], "overall_status": status["status"]}


def test_pack(spark: SparkSession, pack: Pack, dirty: str, clean: str) -> DataFrame:
    """file, kind, n, ok: dirty files need a violation, clean ones must have none."""
    a, b = (src.read_tree(spark, str(Path(d).resolve())).withColumn("kind", F.lit(k)) for d, k in ((dirty, "dirty"), (clean, "clean")))
    both = a.unionByName(b).withColumn("file_path", F.concat("kind", F.lit("/"), "file_path"))
    n = scan_rules(both.select("file_path", "content"), [pack]).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    out = both.select("file_path", "kind").join(n, "file_path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("ok", F.when(F.col("kind") == "dirty", F.col("n") > 0).otherwise(F.col("n") == 0))


def compliance(spark: SparkSession, path: str, pii: DataFrame) -> DataFrame:
    files = src.read_tree(spark, str(Path(path).resolve()), suffixes=(), skip_dirs=fixed.SKIP_DIRS)
    return privacy.report(structure.code_tables(files), pii)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="spanwarden")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "ci", "baseline", "compliance"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--packs-dir", default=str(PACKS))
        c.add_argument("--config")
        c.add_argument("--fail-on", choices=SEVERITIES, default="CRITICAL")
        c.add_argument("--warn-on", choices=SEVERITIES, default="HIGH")
        c.add_argument("--baseline")
        c.add_argument("--format", choices=("table", "json", "sarif"), default="table")
        c.add_argument("--output")
        c.add_argument("--pii", help="table of classified fields (parquet)")
    sub.add_parser("packs").add_argument("--packs-dir", default=str(PACKS))
    sub.add_parser("validate-pack").add_argument("file")
    for name, extra in (("test-rule", ("rule", "file")), ("test-pack", ("dirty", "clean"))):
        c = sub.add_parser(name)
        for a in ("pack", *extra):
            c.add_argument(a)
    c = sub.add_parser("init")
    c.add_argument("file", nargs="?", default="spanwarden.yml")
    c.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    try:
        if a.command == "init":
            if Path(a.file).exists() and not a.force:
                return 1
            Path(a.file).write_text(yaml.safe_dump(DEFAULTS))
            return 0
        if a.command == "validate-pack":
            print(f"{load_pack(a.file).id}: valid")
            return 0
        if a.command == "packs":
            for x in sorted(load_pack_directory(a.packs_dir), key=lambda x: x.id):
                print(f"{x.id}  {x.version}  {len(x.rules)} rules")
            return 0
        spark = spark or SparkSession.builder.appName("spanwarden").getOrCreate()
        if a.command == "test-pack":
            rows = test_pack(spark, load_pack(a.pack), a.dirty, a.clean).collect()
            return int(not all(r["ok"] for r in rows))
        if a.command == "test-rule":
            pack = load_pack(a.pack)
            files = src.read_file(spark, a.file).withColumn("file_path", F.lit(Path(a.file).name))
            v = scan_rules(files, [pack]).filter(F.col("rule_id") == f"{pack.id}/{a.rule}")
            write(reports.terminal_table(v), None, "\n")
            return 0
        if a.command == "compliance":
            pii = spark.read.parquet(a.pii) if a.pii else spark.createDataFrame([], "model string, field string, classification string, reason string")
            report = compliance(spark, a.path, pii)
            print(reports.result_json(report).toPandas().to_json(orient="records") if a.format == "json" else privacy.report_text(report, a.path) if a.format == "table" else privacy.report_markdown(report))
            return int(report.filter("status = 'NON_COMPLIANT'").count() > 0)
        packs = load_pack_directory(a.packs_dir)
        config = load_config(a.config)
        files, v = scan_path(spark, a.path, packs, tuple((config.get("ignore") or {}).get("paths") or ()))
        if a.baseline and a.command != "baseline":
            v = ops.without_known(v, src.read_baseline(spark, a.baseline))
        v = v.persist()
        if a.command == "baseline":
            save(v, "baseline", a.output or ".baseline.json")
            return 0
        s = summary(v, files, packs, a.fail_on, a.fail_on if a.command == "ci" else a.warn_on)
        if a.command == "ci":
            for r in reports.ci_lines(v, a.fail_on).orderBy("seq").toLocalIterator():
                print(r["ci"])
            print(", ".join(f"{k}: {n}" for k, n in sorted(s["by_severity"].items()) if n) or "nothing found")
        if a.output:
            save(v, a.format, a.output, s)
            return int(s["overall_status"] == "failed")
        pieces = {"json": lambda: result_document(v, s), "sarif": lambda: reports.sarif_document(v, "spanwarden", "1", "scan"), "table": lambda: reports.terminal_table(v)}[a.format]()
        write(pieces, None, "\n" if a.format == "table" else "")
        return int(s["overall_status"] == "failed")
    except RuleLoadError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
