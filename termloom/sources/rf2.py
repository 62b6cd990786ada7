"""Release directories: names, typed scans, errors, and the JSON sink."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import ids as I
from termloom.functions import values as V
from termloom.sources.schemas import RECORDS, ROUTES, Record, route

RELEASE_TYPES = ("Full", "Snapshot", "Delta")
BOM = "﻿"


class FileNameError(ValueError):
    """kind: Extension, Structure, FileType, ReleaseType or VersionDate."""

    def __init__(self, kind: str, value: str = ""):
        super().__init__(f"{kind}({value})" if value else kind)
        self.kind, self.value = kind, value


@dataclass(frozen=True)
class ReleaseFileName:
    file_type: str
    content_type: str
    summary: str
    release_type: str
    language_code: str | None
    country_namespace: str
    version_date: int


def split_release_type(text: str) -> tuple[str, str] | None:
    """The text before a release type at its end, and that type."""
    return next(((text[: -len(t)], t) for t in RELEASE_TYPES if text.endswith(t)), None)


def parse_file_name(name: str) -> ReleaseFileName:
    """FileType_ContentType_[Summary]ReleaseType[-language]_Country_Date.txt"""
    if not name.endswith(".txt"):
        raise FileNameError("Extension")
    parts = name[:-4].split("_")
    if len(parts) != 5:
        raise FileNameError("Structure")
    kind, content, sub, country, date = parts
    if kind not in ("sct2", "der2"):
        raise FileNameError("FileType", kind)
    head, dash, language = sub.partition("-")
    if not (found := split_release_type(head)):
        raise FileNameError("ReleaseType", sub)
    try:
        version = V.parse_time(date)
    except V.TimeError:
        raise FileNameError("VersionDate", date) from None
    return ReleaseFileName(kind, content, *found, language if dash else None, country, version)


class Rf2Error(ValueError):
    """A fault in a recognised file: path, kind (MissingHeader, Header, ColumnCount, Field), line and column."""

    def __init__(self, path: str, kind: str, line: int | None = None, column: str | None = None, detail: str = ""):
        super().__init__(f"{path}: {kind}" + (f" at line {line}" if line else "") + (f", column {column}" if column else "") + (f": {detail}" if detail else ""))
        self.path, self.kind, self.line, self.column = path, kind, line, column


def typed(raw: Column, kind: str) -> Column:
    """The value of a field; null if it is malformed."""
    return {"S": I.parsed_id, "T": V.time, "B": V.active, "U": V.unsigned, "X": V.non_empty, "x": lambda c: c, "V": V.concrete_value, "I": V.member_id}[kind](raw)


def typed_fields(record: Record) -> Column:
    """The values of `parts` as a struct, null where malformed. All ids are parsed by one expression: planning does not grow with their number."""
    part = lambda i: F.get("parts", F.lit(i))
    places = [i for i, (_, kind) in enumerate(record.fields) if kind == "S"]
    return I.bound(F.transform(F.array(*map(part, places)), I.parsed_id), lambda ids: F.struct(*[(F.get(ids, F.lit(places.index(i))) if kind == "S" else typed(part(i), kind)).alias(name) for i, (name, kind) in enumerate(record.fields)]))


def scan_lines(spark: SparkSession, paths: list[str], record: Record) -> DataFrame:
    """One row for each data row: `path`, `raw` (the line) and `parts` (its fields).

    Lines end at \\n only and one \\r before it is dropped; quotes are data. The header is told by its
    text, which the files' first lines have been checked against.
    """
    line = F.regexp_replace(F.col("value"), "\r$", "")
    header = "\t".join(record.header)
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), line.alias("raw"))
    return rows.filter((F.col("raw") != "") & (F.regexp_replace("raw", f"^{BOM}", "") != header)).withColumn("parts", F.split("raw", "\t", -1))


def check_headers(spark: SparkSession, paths: list[str], record: Record) -> None:
    """The first line of each file must be the record's header; only these lines are read, without a job."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = hadoop.fs.Path(path)
        reader = hadoop.util.LineReader(at.getFileSystem(conf).open(at), conf, bytearray(b"\n"))
        try:
            line = hadoop.io.Text()
            if not reader.readLine(line):
                raise Rf2Error(path, "MissingHeader")
        finally:
            reader.close()
        found = line.toString().removeprefix(BOM).removesuffix("\r")
        if found.split("\t") != record.header:
            raise Rf2Error(path, "Header", 1, detail=f"found {found!r}")


def file_name(record: Record, release_type: str, country: str, date: int) -> str:
    """A name that routes to the record type."""
    content, summary = next((c, p.strip("*")) for c, p, name in ROUTES if name == record.name)
    return f"{'der2' if record.is_member else 'sct2'}_{content}_{summary}{release_type}_{country}_{date}.txt"


def write_records(raw: DataFrame, record: Record, root: str, release_type: str = "Snapshot", country: str = "INT", date: int = 20240101) -> list[str]:
    """Write rows of text fields, named as the record's, as release files: one for each partition, told apart by a number after the country.

    Fields hold no tab or newline and are not null. Returns the paths in the order of the partitions.
    """
    spark, hadoop = raw.sparkSession, raw.sparkSession._jvm.org.apache.hadoop
    part = f"{root}/_{record.name}_{release_type}_{country}"
    plain = {"sep": "\t", "header": True, "quote": "\0", "escape": "\0", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}
    raw.select(*record.header).write.options(**plain).csv(part)
    fs = hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    made = sorted(str(f.getPath()) for f in fs.listStatus(hadoop.fs.Path(part)) if f.getPath().getName().startswith("part-"))
    out = [f"{root}/{file_name(record, release_type, f'{country}{i:06d}', date)}" for i in range(len(made))]
    for a, b in zip(made, out, strict=True):
        fs.rename(hadoop.fs.Path(a), hadoop.fs.Path(b))
    fs.delete(hadoop.fs.Path(part), True)
    return out


def read_records(spark: SparkSession, paths: list[str], record: Record, arrivals: dict[str, int] | None = None, strict: bool = True) -> DataFrame:
    """Typed rows of files of one record type, with `arrival`: a number that rises with the sorted path, then the line.

    strict: a malformed row fails the query that reads it, naming file and column (find_error gives
    the line). Otherwise malformed rows are left out.
    """
    check_headers(spark, paths, record)
    lines = scan_lines(spark, paths, record)
    n = len(record.fields)
    # out of a generator, so that no filter is pushed below it and parses once more
    lines = lines.select("path", "raw", F.size("parts").alias("g_n"), F.inline(F.array(typed_fields(record))))
    wrong = F.when(F.col("g_n") != n, F.lit("ColumnCount"))
    for name, kind in record.fields:
        if kind != "x":
            wrong = wrong.when(F.col(name).isNull(), F.lit(f"Field {name}"))
    at = F.coalesce(F.element_at(F.create_map(*[x for p, k in arrivals.items() for x in (F.lit(p), F.lit(k))]), F.regexp_replace("path", "^file:/+", "file:/")), F.lit(0)) if arrivals else F.lit(0)
    lines = lines.withColumn("g_wrong", wrong)
    if strict:
        checked = F.when(F.col("g_wrong").isNotNull(), F.raise_error(F.concat(F.lit("malformed release row: "), F.col("g_wrong"), F.lit(" in "), F.col("path"), F.lit(": "), F.col("raw"))).cast("int")).otherwise(F.lit(1))
        lines = lines.filter(checked == 1)
    else:
        lines = lines.filter("g_wrong IS NULL")
    # a file's lines keep their order in the id of the task's row; the file's place in the sorted list leads
    return lines.select(*record.header, (at.cast("decimal(10,0)") * F.lit(Decimal(1 << 63)) + F.monotonically_increasing_id()).cast("decimal(38,0)").alias("arrival"))


def find_error(spark: SparkSession, paths: list[str], record: Record) -> Rf2Error | None:
    """The first fault by path and line; reads the failing files again, line by line on the driver."""
    checkers = {"S": lambda s: I.parse_id(s), "T": V.parse_time}
    def bad(kind: str, s: str) -> bool:
        if kind in checkers:
            try:
                checkers[kind](s)
                return False
            except ValueError:
                return True
        if kind == "V":
            return not (s.startswith("#") and re.match(V.NUMBER, s[1:]) or len(s) >= 2 and s[0] == s[-1] == '"')
        if kind == "U":
            return not (re.fullmatch("[+]?[0-9]+", s, re.ASCII) and int(s) < 2**32)
        return {"B": s not in ("0", "1"), "X": s == "", "x": False, "I": not re.match(V.UUID, s)}[kind]

    for path in sorted(paths):
        rows = spark.read.option("lineSep", "\n").text(path).coalesce(1).toLocalIterator()
        for n, row in enumerate(rows, 1):
            line = row["value"].removesuffix("\r")
            if n == 1:
                if line.removeprefix(BOM).split("\t") != record.header:
                    return Rf2Error(path, "Header", 1)
                continue
            if not line:
                continue
            parts = line.split("\t")
            if len(parts) != len(record.fields):
                return Rf2Error(path, "ColumnCount", n, detail=f"{len(parts)} for {len(record.fields)}")
            for (name, kind), s in zip(record.fields, parts, strict=True):
                if bad(kind, s):
                    return Rf2Error(path, "Field", n, name, repr(s))
    return None


@dataclass
class LoadReport:
    """Files read, by record type; files passed over, with the reason."""

    loaded: dict[str, list[str]] = field(default_factory=dict)
    skipped: list[tuple[str, str]] = field(default_factory=list)

    @property
    def files(self) -> int:
        return sum(map(len, self.loaded.values()))


def list_texts(spark: SparkSession, root: str) -> list[str]:
    """All .txt files under a directory, sorted; any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    found, it = [], fs.listFiles(path, True)
    while it.hasNext():
        p = it.next().getPath().toString()
        if p.endswith(".txt"):
            found.append(p)
    return sorted(found)


def select_files(spark: SparkSession, root: str, release_type: str) -> LoadReport:
    """Route each file. Unknown names and types are reported; files of another release type are passed over in silence."""
    report = LoadReport()
    for path in list_texts(spark, root):
        try:
            name = parse_file_name(PurePosixPath(path).name)
        except FileNameError as e:
            report.skipped.append((path, f"unrecognized file name: {e}"))
            continue
        if name.release_type != release_type:
            continue
        record = route(name.content_type, name.summary)
        if record is None:
            report.skipped.append((path, f"no record type for {name.content_type} {name.summary}".rstrip()))
        else:
            report.loaded.setdefault(record.name, []).append(path)
    return report


def uri(spark: SparkSession, path: str) -> str:
    """A path as read_records meets it: escaped, and one slash after `file:`."""
    return re.sub("^file:/+", "file:/", spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString())


def load_release(spark: SparkSession, root: str, release_type: str = "Snapshot", strict: bool = True) -> tuple[dict[str, DataFrame], LoadReport]:
    """Record type to typed rows for the files of a release directory, one read for each type, and what was passed over."""
    report = select_files(spark, root, release_type)
    order = {p: i for i, p in enumerate(sorted(p for ps in report.loaded.values() for p in ps))}
    return {name: read_records(spark, paths, RECORDS[name], {uri(spark, p): order[p] for p in paths}, strict) for name, paths in report.loaded.items()}, report


def to_json(rows: DataFrame, record: Record) -> DataFrame:
    """One JSON object a row (`value`): ids and times as strings, flags and counts bare, a concrete value as valueType and value."""
    cols = []
    for name, kind in record.fields:
        if kind == "V":
            cols += [F.lower(F.col(name)["value_type"]).alias("valueType"), F.col(name)["value"].alias("value")]
        else:
            cols.append((F.col(name).cast("string") if kind in "ST" else F.col(name)).alias(name))
    return rows.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def export_file(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """The rows of one file as JSON lines, in file order; written to the folder `out` if given. No version resolution."""
    name = parse_file_name(PurePosixPath(path).name)
    record = route(name.content_type, name.summary)
    if record is None:
        raise FileNameError("Structure", f"no record type for {name.content_type} {name.summary}")
    lines = to_json(read_records(spark, [path], record), record)
    if out:
        lines.write.mode("overwrite").text(out)
    return lines


def export_directory(spark: SparkSession, root: str, out: str) -> LoadReport:
    """Each routed file of every release type as <stem>.ndjson under `out`; the others are reported."""
    report = LoadReport()
    for path in list_texts(spark, root):
        try:
            export_file(spark, path, f"{out.rstrip('/')}/{PurePosixPath(path).stem}.ndjson")
            report.loaded.setdefault("all", []).append(path)
        except FileNameError as e:
            report.skipped.append((path, str(e)))
    return report
