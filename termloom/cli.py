"""Command line: sctid, load, validate, classify, nnf, lookup, ecl, export."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import ids as I
from termloom.operators import el, nnf
from termloom.operators.snapshot import Snapshot
from termloom.plans.compiler import Compiler
from termloom.sources import rf2

USAGE = {
    "sctid": "sctid <id>",
    "load": "load <release-dir> [--full]",
    "validate": "validate <release-dir> [--full]",
    "classify": "classify <release-dir> [id] [--full]",
    "nnf": "nnf <release-dir> [id] [--full]",
    "lookup": "lookup <release-dir> <id>",
    "ecl": "ecl <release-dir> <expression>",
    "export": "export <rf2-file-or-dir> [output]",
}
#: Items of a list of faults that are shown.
SHOWN = 5


class UsageError(ValueError):
    pass


def help_text() -> str:
    return "usage:\n" + "".join(f"  {line}\n" for line in USAGE.values())


def capped(rows: DataFrame, line: Callable) -> list[str]:
    """The first few rows as lines, and how many more there are."""
    n = rows.count()
    return [f"  {line(r)}" for r in rows.limit(SHOWN).collect()] + ([f"  ... and {n - SHOWN} more"] if n > SHOWN else [])


def session() -> SparkSession:
    return SparkSession.builder.appName("termloom").getOrCreate()


def load(spark: SparkSession, root: str, kind: str) -> tuple[Snapshot, list[str]]:
    began = time.time()
    snapshot, report = Snapshot.load(spark, root, kind)
    head = [f"loaded {report.files} file(s), skipped {len(report.skipped)} in {time.time() - began:.2f}s"]
    return snapshot, head + [f"  skipped {path}: {why}" for path, why in report.skipped]


def sctid(text: str) -> str:
    number = I.parse_id(text)
    part, long = number // 10 % 100, number // 100 % 10 == 1
    lines = [str(number), f"  component type: {I.COMPONENTS[part % 10]}", f"  format:         {'long (extension)' if long else 'short (International)'}", f"  partition:      {part:02}"]
    if long:
        lines.append(f"  namespace:      {number // 1000 % 10_000_000:07}")
    return "\n".join([*lines, f"  item id:        {number // (10**10 if long else 1000)}", f"  check digit:    {number % 10}", ""])


def names(snapshot: Snapshot, ids: DataFrame, column: str = "id") -> DataFrame:
    return ids.join(snapshot.fsn().withColumnRenamed("id", column), column, "left").withColumn("fsn", F.coalesce("fsn", F.lit("")))


def run(args: list[str], spark: SparkSession | None = None) -> str:
    """The output of one command; UsageError, or the library's errors, where it fails."""
    if not args or args[0] in ("help", "-h", "--help"):
        return help_text()
    command, rest = args[0], args[1:]
    if command not in USAGE:
        raise UsageError(f"unknown command {command!r}\n{help_text()}")
    wrong = UsageError(f"usage: {USAGE[command]}")
    full = "--full" in rest and command in ("load", "validate", "classify", "nnf")
    rest = [a for a in rest if not (full and a == "--full")]
    least, most = {"sctid": (1, 1), "load": (1, 1), "validate": (1, 1), "classify": (1, 2), "nnf": (1, 2), "lookup": (2, 2), "ecl": (2, 2), "export": (1, 2)}[command]
    if not least <= len(rest) <= most:
        raise wrong
    if command == "sctid":
        return sctid(rest[0])
    spark = spark or session()
    if command == "export":
        return export(spark, *rest)
    ident = I.parse_id(rest[1]) if len(rest) > 1 and command in ("classify", "nnf", "lookup") else None
    snapshot, head = load(spark, rest[0], "Full" if full else "Snapshot")
    if command == "load":
        lines = [*head, f"concepts: {snapshot.concept_count()} ({snapshot.active_concepts().count()} active)"]
    elif command == "validate":
        lines = head + validate(snapshot)
    elif command == "classify":
        lines = head + classify(snapshot, ident)
    elif command == "nnf":
        lines = head + normal(snapshot, ident)
    elif command == "lookup":
        lines = lookup(snapshot, ident)
    else:
        found = names(snapshot, Compiler(snapshot)(rest[1])).orderBy("id")
        rows = [f"{r['id']}  {r['fsn']}".rstrip() for r in found.toLocalIterator()]
        lines = [*rows, f"{len(rows)} concept(s)"]
    return "\n".join([*lines, ""])


def validate(snapshot: Snapshot) -> list[str]:
    titles = {"dangling_descriptions": "dangling description concept references", "dangling_sources": "dangling relationship source references", "dangling_destinations": "dangling relationship destination references", "cyclic_concepts": "concepts on a cyclic IS-A path"}
    found = {name: [r["id"] for r in df.orderBy("id").toLocalIterator()] for name, df in snapshot.validate().items()}
    if not any(found.values()):
        return [f"no issues found ({snapshot.concept_count()} concepts checked)"]
    lines = [f"{sum(map(len, found.values()))} issue(s) found:"]
    for name, title in titles.items():
        if found[name]:
            lines += [f"  {title} ({len(found[name])}):", *[f"    {i}" for i in found[name]]]
    return lines


def faults(errors: DataFrame, skipped: DataFrame) -> list[str]:
    out = []
    for rows, title, line in ((errors, "OWL expression(s) could not be parsed", lambda r: r["text"]), (skipped, "construct(s) skipped", lambda r: f"{r['kind']} :{r['id']}")):
        if n := rows.count():
            out += [f"{n} {title}:", *capped(rows, line)]
    return out


def classify(snapshot: Snapshot, ident: int | None) -> list[str]:
    c = el.classify(snapshot.owl_expressions())
    head = faults(c.errors, c.skipped)
    if ident is None:
        return [*head, f"{c.named.count()} concept(s), {c.subsumption.count()} subsumption pair(s) total"]
    rows = names(snapshot, c.subsumers(ident), "concept").orderBy("concept").collect()
    return [*head, f"{ident}: {len(rows)} subsumer(s)", *[f"  {r['concept']}  {r['fsn']}".rstrip() for r in rows]]


def normal(snapshot: Snapshot, ident: int | None) -> list[str]:
    forms = nnf.normal_forms(snapshot.owl_expressions())
    head = faults(snapshot.spark.createDataFrame([], "text string"), forms.skipped)
    if ident is None:
        return [*head, f"{forms.named.count()} concept(s), {forms.is_a.count()} proximal parent(s), {forms.attributes.count()} attribute(s) total"]
    if forms.named.filter(F.col("concept") == ident).isEmpty():
        return [*head, f"{ident}: no necessary normal form (not named by any input axiom)"]
    parents = names(snapshot, forms.is_a.filter(F.col("concept") == ident).select("parent"), "parent").orderBy("parent").collect()
    values = forms.attributes.filter(F.col("concept") == ident)
    values = names(snapshot, names(snapshot, values, "type_id").withColumnRenamed("fsn", "type_name"), "destination_id").orderBy("grp", "type_id", "destination_id").collect()
    return [*head, f"{ident}:", *[f"  is a {r['parent']}  {r['fsn']}".rstrip() for r in parents], *[f"  group {r['grp']}: {r['type_id']} {r['type_name']} = {r['destination_id']} {r['fsn']}".rstrip() for r in values]]


def lookup(snapshot: Snapshot, ident: int) -> list[str]:
    row = snapshot.row("concept", ident).first()
    if row is None:
        return [f"{ident}: not found in this snapshot"]
    texts = snapshot.descriptions_of(ident).filter("active").orderBy("id").collect()
    lines = [f"{ident}  active={str(row['active']).lower()}  module={row['moduleId']}"]
    for r in snapshot.fsn().filter(F.col("id") == ident).collect():
        lines.append(f"  FSN: {r['fsn']}")
    from termloom.functions.constants import SYNONYM

    lines += [f"  synonym: {r['term']}" for r in texts if r["typeId"] == SYNONYM]
    for title, ids in (("parent", snapshot.parents(ident)), ("child", snapshot.children(ident))):
        lines += [f"  {title}: {r['id']}  {r['fsn']}".rstrip() for r in names(snapshot, ids).orderBy("id").collect()]
    return lines


def export(spark: SparkSession, source: str, out: str | None = None) -> str:
    """A file's rows as JSON lines (printed unless `out` is given), or a directory's files below `out`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        if not out:
            raise UsageError(f"usage: {USAGE['export']}")
        report = rf2.export_directory(spark, source, out)
        return "\n".join([f"exported {report.files} file(s), skipped {len(report.skipped)}", *[f"  skipped {p}: {why}" for p, why in report.skipped], ""])
    lines = rf2.export_file(spark, source, out)
    return "" if out else "".join(r["value"] + "\n" for r in lines.toLocalIterator())


def main() -> int:
    try:
        sys.stdout.write(run(sys.argv[1:]))
        return 0
    except ValueError as e:
        sys.stderr.write(f"error: {e}\n")
        return 1


if __name__ == "__main__":
    sys.exit(main())
