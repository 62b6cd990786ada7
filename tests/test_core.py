"""Identifiers, values, versions, graph, sources."""

import json

import pytest
from pyspark.sql import functions as F

from termloom.functions import ids as I
from termloom.functions import values as V
from termloom.operators import graph, versioning
from termloom.operators.snapshot import History, Snapshot
from termloom.sources import rf2
from termloom.sources.schemas import RECORDS, route

ROOT, FINDING, DISEASE, MI = 138875005, 404684003, 64572001, 22298006


@pytest.mark.parametrize("text, fault", [("12345", "InvalidLength(5)"), ("1" * 19, "InvalidLength(19)"), ("12x680003", "NonDigit"), ("016680003", "LeadingZero"), ("116680004", "CheckDigit"), ("116680003", None), ("138875005", None)])
def test_ids_parse_alike_on_driver_and_columns(spark, text, fault):
    try:
        got = I.parse_id(text)
        assert fault is None and got == int(text)
    except I.IdError as e:
        assert str(e) == fault
    row = spark.createDataFrame([(text,)], "s string").select(I.id_error(F.col("s")).alias("e"), I.parsed_id(F.col("s")).alias("i")).first()
    assert row["e"] == fault and row["i"] == (None if fault else int(text))


def test_partition_03_and_long_ids(spark):
    body = "100003"
    assert pytest.raises(I.IdError, I.parse_id, body + str(I.INVERSE[I.fold(body, 1)])).value.kind == "InvalidPartition"
    assert I.compose_id(116680) == 116680003
    long = I.compose_id(42, namespace=1000124)
    c = F.col("i")
    row = spark.createDataFrame([(long,)], "i long").select(I.is_long_format(c), I.namespace(c), I.item_identifier(c), I.component_type(c), I.partition(c), I.check_digit(c)).first()
    assert tuple(row) == (True, 1000124, 42, "Concept", 10, long % 10)
    assert pytest.raises(I.IdError, I.compose_id, 0).value.kind == "ZeroItemIdentifier"
    assert pytest.raises(I.IdError, I.compose_id, 5, "Concept", 10**7).value.kind == "InvalidNamespace"


def test_values(spark):
    df = spark.createDataFrame([("#12.5.6",), ("#",), ('"open',), ("500",), ("",), ("#5.",), ("#.5",), ("#+5",), ('"a"',), ('"',)], "s string")
    got = [r[0] for r in df.select(V.concrete_error(F.col("s"))).collect()]
    assert got == ["InvalidNumber", "InvalidNumber", "UnterminatedString", "Malformed", "Empty", None, None, "InvalidNumber", None, "UnterminatedString"]
    assert V.parse_time("20230231") == 20230231
    for bad in ("20231301", "20230100", "2023011", "2023011a"):
        pytest.raises(V.TimeError, V.parse_time, bad)
    tag = spark.createDataFrame([("Root concept (RT+CTV3)",), ("Plain",), ("a (b) (c)  ",)], "t string").select(V.semantic_tag(F.col("t"), F.lit(900000000000003001)).alias("x")).collect()
    assert [r["x"] for r in tag] == ["RT+CTV3", None, "c"]


def test_versions_and_ties(spark):
    rows = spark.createDataFrame([(1, 20200101, 0, "a"), (1, 20200101, 1, "b"), (1, 20190101, 2, "c"), (2, 20210101, 3, "d")], "id long, effectiveTime int, arrival long, v string")
    assert {(r["id"], r["v"]) for r in versioning.latest(rows).collect()} == {(1, "a"), (2, "d")}
    assert {(r["id"], r["v"]) for r in versioning.as_of(rows, 20200601).collect()} == {(1, "b")}
    assert [r["v"] for r in versioning.history(rows, 1).collect()] == ["c", "a", "b"]
    probes = spark.createDataFrame([(1, 20180101), (1, 20190601), (1, 20990101), (3, 20200101)], "id long, at int")
    assert {(r["id"], r["at"], r["v"]) for r in versioning.as_of_join(probes, rows).collect()} == {(1, 20180101, None), (1, 20190601, "c"), (1, 20990101, "b"), (3, 20200101, None)}


def test_graph_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 4), (5, 6)], "child long, parent long")
    closure = graph.transitive_closure(edges)
    assert {tuple(r) for r in closure.select("descendant", "ancestor").collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 4), (5, 6)}
    assert {r["id"] for r in graph.ancestors(edges, 1).collect()} == {2}
    assert graph.is_ancestor_of(edges, 1, 1) and graph.subsumes(edges, 9, 9) and not graph.is_ancestor_of(edges, 5, 5)
    known = spark.createDataFrame([(3,), (5,)], "id long")
    assert {r["id"] for r in graph.cyclic(edges, known).collect()} == {1, 2}


def test_cycles_below_and_above_trees(spark):
    tree = [(i, i // 2) for i in range(2, 64)]
    edges = spark.createDataFrame([*tree, (100, 63), (101, 100), (100, 102), (102, 101), (1, 200), (200, 201), (201, 200)], "child long, parent long")
    known = spark.createDataFrame([(101,), (5,)], "id long")
    assert {r["id"] for r in graph.cyclic(edges, known).collect()} == {100, 101, 102, 200, 201}
    assert {r["id"] for r in graph.cyclic(edges, known.filter("id = 5")).collect()} == {200, 201}
    assert graph.cyclic(spark.createDataFrame(tree, edges.schema), known).count() == 0


def test_cross_edge_cycles_are_found(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (3, 2)], "child long, parent long")
    assert {r["id"] for r in graph.cyclic(edges, edges.select(F.col("child").alias("id"))).collect()} == {1, 2, 3}


CONCEPT = "id\teffectiveTime\tactive\tmoduleId\tdefinitionStatusId"
MODULE, PRIMITIVE = 900000000000207008, 900000000000074008


def concept(i, time=20190731, active=1):
    return f"{i}\t{time}\t{active}\t{MODULE}\t{PRIMITIVE}"


def is_a(n, child, parent, active=1, inferred=True):
    return f"{I.compose_id(n, 'Relationship')}\t20190731\t{active}\t{MODULE}\t{child}\t{parent}\t0\t116680003\t{900000000000011006 if inferred else 900000000000010007}\t900000000000451002"


def fsn(n, about, term):
    return f"{I.compose_id(n, 'Description')}\t20190731\t1\t{MODULE}\t{about}\ten\t900000000000003001\t{term}\t900000000000448009"


def header(name):
    return "\t".join(RECORDS[name].header)


@pytest.fixture
def release(tmp_path):
    snap = tmp_path / "Snapshot" / "Terminology"
    snap.mkdir(parents=True)
    lines = lambda *x, nl="\n": nl.join(x) + nl
    (snap / "sct2_Concept_Snapshot_INT_20190731.txt").write_bytes(("﻿" + lines(CONCEPT, *(concept(c) for c in (ROOT, FINDING, DISEASE)), "", concept(MI), nl="\r\n")).encode())
    (snap / "sct2_Description_Snapshot-en_INT_20190731.txt").write_text(lines(header("description"), fsn(1001, FINDING, "Clinical finding (finding)"), fsn(1002, DISEASE, 'A "quoted" disease (disorder)')))
    (snap / "sct2_Relationship_Snapshot_INT_20190731.txt").write_text(lines(header("relationship"), is_a(2001, FINDING, ROOT), is_a(2002, DISEASE, FINDING), is_a(2003, MI, DISEASE), is_a(2004, MI, ROOT, active=0), is_a(2005, ROOT, MI, inferred=False)))
    (snap / "der2_zzRefset_Strange_Snapshot_INT_20190731.txt").write_text("x\n")
    (snap / "der2_zzRefset_StrangeSnapshot_INT_20190731.txt").write_text("x\n")
    (tmp_path / "readme.txt").write_text("hello")
    full = tmp_path / "Full"
    full.mkdir()
    (full / "sct2_Concept_Full_INT_20190731.txt").write_text(lines(CONCEPT, concept(MI, 20180131, 0), concept(MI)))
    return tmp_path


def test_release_directory(spark, release):
    snapshot, report = Snapshot.load(spark, str(release))
    assert report.files == 3 and len(report.skipped) == 3
    assert snapshot.concept_count() == 4
    assert {r["id"] for r in snapshot.ancestors(MI).collect()} == {DISEASE, FINDING, ROOT}  # inactive and stated rows are no hierarchy
    assert {r["fsn"] for r in snapshot.fsn().collect()} == {"Clinical finding (finding)", 'A "quoted" disease (disorder)'}
    history, _ = History.load(spark, str(release))
    assert [r["active"] for r in history.versions("concept", MI).collect()] == [False, True]
    assert history.at("concept", MI, 20180601).first()["active"] is False
    assert history.at("concept", MI, 20170101).first() is None
    assert not any(df.count() for name, df in snapshot.validate().items())


def test_malformed_rows_are_errors(spark, release):
    path = release / "Snapshot" / "Terminology" / "sct2_Concept_Snapshot_INT_20190731.txt"
    path.write_text("\n".join([CONCEPT, concept(ROOT), concept(MI).replace("\t1\t", "\t2\t")]) + "\n")
    with pytest.raises(Exception, match="Field active"):
        Snapshot.load(spark, str(release))[0].concepts.collect()
    fault = rf2.find_error(spark, [str(path)], RECORDS["concept"])
    assert (fault.kind, fault.line, fault.column) == ("Field", 3, "active")
    path.write_text("id\tnope\n")
    with pytest.raises(rf2.Rf2Error, match="Header"):
        Snapshot.load(spark, str(release))


def test_file_names():
    name = rf2.parse_file_name("der2_cRefset_LanguageSnapshot-en-GB_INT_20190731.txt")
    assert (name.content_type, name.summary, name.release_type, name.language_code) == ("cRefset", "Language", "Snapshot", "en-GB")
    for bad, kind in [("a.csv", "Extension"), ("a_b.txt", "Structure"), ("xx_Concept_Snapshot_INT_20190731.txt", "FileType"), ("sct2_Concept_Snap_INT_20190731.txt", "ReleaseType"), ("sct2_Concept_Full_INT_2019.txt", "VersionDate")]:
        assert pytest.raises(rf2.FileNameError, rf2.parse_file_name, bad).value.kind == kind
    assert route("cRefset", "HistoricalAssociationReference").name == "association" and route("cRefset", "Other") is None and len(RECORDS) == 22


def test_json_lines(spark, release):
    rows = rf2.export_file(spark, str(release / "Full" / "sct2_Concept_Full_INT_20190731.txt")).collect()
    assert json.loads(rows[0]["value"]) == {"id": str(MI), "effectiveTime": "20180131", "active": False, "moduleId": str(MODULE), "definitionStatusId": str(PRIMITIVE)}
    report = rf2.export_directory(spark, str(release), str(release / "out"))
    assert report.files == 4 and (release / "out" / "sct2_Concept_Full_INT_20190731.ndjson").exists()


def test_newest_inactive_member_hides_older(spark):
    schema = RECORDS["simple"].schema
    rows = spark.createDataFrame([("m", 20190101, True, MODULE, 1, 5), ("m", 20200101, False, MODULE, 1, 5), ("n", 20190101, True, MODULE, 1, 6)], schema).withColumn("arrival", F.col("effectiveTime"))
    s = Snapshot.of_rows(spark, {"simple": rows})
    assert {r["id"] for r in s.refset_members(1).collect()} == {6}
    assert s.is_member(1, 6) and not s.is_member(1, 5)


def test_issue_counts(spark, release):
    snapshot, _ = Snapshot.load(spark, str(release))
    assert snapshot.is_clean() and snapshot.issue_count() == 0
    snapshot._tables["concept"] = snapshot.concepts.filter(F.col("id") != FINDING)
    assert not snapshot.is_clean() and snapshot.issue_count() == 3
    assert {r["fault"]: r["n"] for r in snapshot.issues().collect()} == {"dangling_descriptions": 1, "dangling_sources": 1, "dangling_destinations": 1, "cyclic_concepts": 0}


def test_files_of_equal_names_arrive_in_order_of_their_paths(spark, tmp_path):
    for folder, defined in (("a b", 1), ("c", 0)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "sct2_Concept_Snapshot_INT_20190731.txt").write_text(f"{CONCEPT}\n{concept(MI, active=defined)}\n{concept(MI, active=1 - defined)}\n")
    rows, _ = rf2.load_release(spark, str(tmp_path))
    assert [r["active"] for r in rows["concept"].orderBy("arrival").collect()] == [True, False, False, True]
    path = str(tmp_path / "c" / "sct2_Concept_Snapshot_INT_20190731.txt")
    late = rf2.read_records(spark, [path], RECORDS["concept"], {rf2.uri(spark, f"file:{path}"): 1 << 20}).orderBy("arrival").collect()
    assert [int(r["arrival"]) - (1 << 83) for r in late] == [0, 1]
