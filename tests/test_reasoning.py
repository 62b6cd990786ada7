"""OWL parsing, classification, normal forms, terminology operations, command line."""

import pytest

from termloom import cli
from termloom.functions import constants as K
from termloom.functions.ids import compose_id
from termloom.operators import el, fhir, nnf, owl
from termloom.operators.snapshot import Snapshot
from termloom.sources.schemas import RECORDS

A, B, C, D, E, R, S, T, X, Y = (compose_id(i) for i in range(1000, 1010))


def some(r, c):
    return f"ObjectSomeValuesFrom(:{r} {c if isinstance(c, str) else f':{c}'})"


def both(*terms):
    return f"ObjectIntersectionOf({' '.join(t if isinstance(t, str) else f':{t}' for t in terms)})"


def sub(a, b):
    return f"SubClassOf({a if isinstance(a, str) else f':{a}'} {b if isinstance(b, str) else f':{b}'})"


def frame(spark, *axioms):
    return spark.createDataFrame([(str(i), a) for i, a in enumerate(axioms)], "id string, owlExpression string")


def pairs(spark, *axioms, **options):
    return {tuple(r) for r in el.classify(frame(spark, *axioms), **options).subsumption.collect()}


@pytest.mark.parametrize("text, kind", [("SubClassOf(:116680003 ?)", "UnexpectedChar"), ('DataHasValue("x', "UnterminatedString"), ("SubClassOf(:123 :123)", "InvalidSctId"), (f"SubClassOf(:{A})", "UnexpectedToken"), (f"SubClassOf(:{A} :{B}", "UnexpectedEof"), (f"Nope(:{A})", "UnknownKeyword"), (f"SubClassOf(:{A} ObjectUnionOf(:{A} :{B}))", "UnknownKeyword"), (f"{sub(A, B)} x", "TrailingInput"), (f"EquivalentClasses(:{A})", "UnexpectedToken"), ("", "UnexpectedEof")])
def test_owl_errors(text, kind):
    assert pytest.raises(owl.OwlError, owl.parse, text).value.kind == kind


def test_owl_terms():
    text = f'EquivalentClasses(:{A} {both(B, some(R, C))} DataHasValue(:{R} "5"^^xsd:integer))'
    assert owl.parse(text) == ("equal", (("class", A), ("and", (("class", B), ("some", R, ("class", C)))), ("data", R, "5", "xsd:integer")))
    assert owl.parse(f"SubObjectPropertyOf(ObjectPropertyChain(:{R} :{S}) :{T})") == ("role", (R, S), T)


def test_rules(spark):
    assert pairs(spark, sub(A, B), sub(B, C)) == {(A, B), (A, C), (B, C)}
    assert (A, D) in pairs(spark, sub(A, some(R, B)), sub(B, C), sub(some(R, C), D))
    assert (A, D) in pairs(spark, sub(A, some(R, B)), f"SubObjectPropertyOf(:{R} :{S})", sub(some(S, B), D))
    assert (A, D) in pairs(spark, sub(A, some(R, B)), sub(B, some(R, C)), f"TransitiveObjectProperty(:{R})", sub(some(R, C), D))
    assert (A, E) in pairs(spark, sub(A, some(R, B)), sub(B, some(S, C)), f"SubObjectPropertyOf(ObjectPropertyChain(:{R} :{S}) :{T})", sub(some(T, C), E))
    assert (A, D) in pairs(spark, sub(A, B), sub(A, C), sub(both(B, C), D)) and (A, D) not in pairs(spark, sub(A, B), sub(both(B, C), D), sub(E, C))
    assert pairs(spark, f"EquivalentClasses(:{A} :{B})") == {(A, B), (B, A)}
    # a defined concept is found below by its definition
    assert (D, A) in pairs(spark, f"EquivalentClasses(:{A} {both(B, some(R, C))})", sub(D, B), sub(D, some(R, E)), sub(E, C))


def test_concrete_values_drop_out(spark):
    value = f'DataHasValue(:{R} "5"^^xsd:integer)'
    text = f"EquivalentClasses(:{A} {both(B, value)})"
    assert (B, A) in pairs(spark, text) and (B, A) not in pairs(spark, text, sound=True) and (A, B) in pairs(spark, text, sound=True)
    c = el.classify(frame(spark, text, f"ReflexiveObjectProperty(:{S})", "broken("))
    assert sorted(tuple(r) for r in c.skipped.collect()) == sorted([("ConcreteValue", R), ("ConcreteValue", R), ("ReflexiveProperty", S)]) and c.errors.count() == 1
    # two equal fillers of nothing but values stay apart
    assert (A, B) not in pairs(spark, sub(A, some(S, value)), sub(some(S, value), B))


def forms(spark, *axioms):
    out = nnf.normal_forms(frame(spark, *axioms))
    return {tuple(r) for r in out.is_a.collect()}, {tuple(r) for r in out.attributes.select("concept", "grp", "type_id", "destination_id").collect()}


def test_normal_forms(spark):
    parents, _ = forms(spark, sub(A, B), sub(B, C), sub(A, C))
    assert parents == {(A, B), (B, C)}
    # a more special filler and a more special role make the inherited value redundant
    _, values = forms(spark, sub(A, B), sub(B, some(R, C)), sub(A, some(S, D)), sub(D, C), f"SubObjectPropertyOf(:{S} :{R})")
    assert values == {(A, 0, S, D), (B, 0, R, C)}
    group = lambda *t: some(K.ROLE_GROUP, both(*t) if len(t) > 1 else t[0])
    _, values = forms(spark, sub(A, B), sub(B, group(some(R, C), some(S, D))), sub(A, group(some(R, E))))
    assert values == {(B, 1, R, C), (B, 1, S, D), (A, 1, R, C), (A, 1, S, D), (A, 2, R, E)} or values == {(B, 1, R, C), (B, 1, S, D), (A, 2, R, C), (A, 2, S, D), (A, 1, R, E)}
    # a whole group is covered by a stronger one
    _, values = forms(spark, sub(A, B), sub(B, group(some(R, C))), sub(A, group(some(R, D), some(S, E))), sub(D, C))
    assert {v for v in values if v[0] == A} == {(A, 1, R, D), (A, 1, S, E)}
    # equivalent parents cancel each other
    parents, _ = forms(spark, sub(A, B), f"EquivalentClasses(:{B} :{C})")
    assert not {p for p in parents if p[0] == A}


def test_unmodelled_shapes_are_reported(spark):
    out = nnf.normal_forms(frame(spark, sub(A, some(R, both(B, C)))))
    assert {tuple(r) for r in out.skipped.collect()} == {("UnmodeledAttributeShape", A)} and not out.attributes.count()


@pytest.fixture
def snapshot(spark):
    make = lambda name, rows: spark.createDataFrame(rows, RECORDS[name].schema)
    concepts = make("concept", [(A, 20190731, True, 1, K.DEFINED), (B, 20190731, False, 1, K.PRIMITIVE), (C, 20190731, True, 1, K.PRIMITIVE)])
    texts = make("description", [(compose_id(2000 + i, "Description"), 20190731, True, 1, c, "en", k, t, 0) for i, (c, k, t) in enumerate([(A, K.FSN, "Alpha (x)"), (A, K.SYNONYM, "Alpha"), (B, K.FSN, "Beta (x)"), (A, K.TEXT_DEFINITION, "the first letter")])])
    language = make("language", [("l", 20190731, True, 1, X, compose_id(2001, "Description"), K.PREFERRED)])
    edges = make("relationship", [(1, 20190731, True, 1, B, A, 0, K.IS_A, K.INFERRED, 0), (2, 20190731, True, 1, C, A, 0, K.IS_A, K.INFERRED, 0)])
    return Snapshot(spark, {"concept": concepts, "description": texts, "language": language, "relationship": edges})


def test_terminology_operations(spark, snapshot):
    assert [fhir.subsumes(snapshot, fhir.SYSTEM, *p) for p in ((A, A), (A, B), (B, A), (B, C))] == ["equivalent", "subsumes", "subsumed-by", "not-subsumed"]
    assert pytest.raises(fhir.FhirError, fhir.subsumes, snapshot, "x", A, B).value.kind == "UnsupportedSystem"
    assert pytest.raises(fhir.FhirError, fhir.subsumes, snapshot, fhir.SYSTEM, A, Y).value.kind == "UnknownCode"
    row = fhir.lookup_one(snapshot, fhir.SYSTEM, A, language_refset=X)
    assert (row["display"], row["definition"], row["inactive"], row["sufficientlyDefined"]) == ("Alpha", "the first letter", False, True)
    assert [(d["value"], d["use"]) for d in row["designation"]] == [("Alpha", "Preferred"), ("Alpha (x)", "Unspecified")]
    assert fhir.lookup_one(snapshot, fhir.SYSTEM, C)["display"] is None and fhir.lookup_one(snapshot, fhir.SYSTEM, A)["display"] == "Alpha (x)"
    assert pytest.raises(fhir.FhirError, fhir.lookup, snapshot, properties=("normalForm",)).value.kind == "MissingClassification"
    assert pytest.raises(fhir.FhirError, fhir.lookup, snapshot, properties=("x",)).value.kind == "UnsupportedProperty"
    url = f"{fhir.SYSTEM}?fhir_vs"
    page = fhir.expand(snapshot, url, offset=1, count=1)
    assert page.total == 3 and [r["id"] for r in page.contains.collect()] == [sorted((A, B, C))[1]]
    assert fhir.expand(snapshot, url, active_only=True).total == 2 and fhir.expand(snapshot, url, text="ALPH").total == 1 and fhir.expand(snapshot, url, offset=9).offset == 3
    assert {r["id"] for r in fhir.value_set(snapshot, f"{url}=isa/{A}").collect()} == {A, B, C}
    assert {r["id"] for r in fhir.value_set(snapshot, f"{url}=refset").collect()} == {X}
    for bad, kind in ((f"{fhir.SYSTEM}", "UnsupportedValueSet"), (f"{url}=isa/12", "UnsupportedValueSet"), ("http://x?fhir_vs", "UnsupportedSystem"), (f"{url}=ecl/<", "InvalidEcl")):
        assert pytest.raises(fhir.FhirError, fhir.value_set, snapshot, bad).value.kind == kind


def test_normal_form_text(spark, snapshot):
    out = nnf.NormalForms(spark.createDataFrame([(C, A), (C, B)], "concept long, parent long"), spark.createDataFrame([(C, 0, X, A), (C, 1, Y, B)], "concept long, grp int, type_id long, destination_id long"), None, None)
    terse = fhir.render(snapshot, out, terse=True).first()["form"]
    assert terse == f"{A}+{B}:{X}={A},{{{Y}={B}}}"
    assert fhir.render(snapshot, out).first()["form"] == f"{A} |Alpha (x)| + {B} |Beta (x)| : {X} = {A} |Alpha (x)|, {{ {Y} = {B} |Beta (x)| }}"


def test_command_line(spark, tmp_path):
    assert "component type: Concept" in cli.run(["sctid", "116680003"]) and cli.run([]).startswith("usage")
    for args in (["sctid"], ["nope"], ["load"], ["ecl", "x"]):
        pytest.raises(cli.UsageError, cli.run, args)
    from tests.test_core import concept, fsn, header, is_a

    (tmp_path / "sct2_Concept_Snapshot_INT_20190731.txt").write_text("\n".join([header("concept"), concept(A), concept(B), concept(C)]) + "\n")
    (tmp_path / "sct2_Relationship_Snapshot_INT_20190731.txt").write_text("\n".join([header("relationship"), is_a(2001, B, A), is_a(2002, C, Y)]) + "\n")
    (tmp_path / "sct2_Description_Snapshot-en_INT_20190731.txt").write_text("\n".join([header("description"), fsn(3001, B, "Beta (x)")]) + "\n")
    core = f"20190731\t1\t{K.CORE_MODULE}\t{X}"
    owls = [sub(B, A), sub(C, both(B, some(R, A))), "SubClassOf(:1 ObjectUnionOf())"]
    (tmp_path / "sct2_sRefset_OWLExpressionSnapshot_INT_20190731.txt").write_text("\n".join([header("owl_expression"), *[f"80000000-0000-4000-8000-00000000000{i}\t{core}\t{A}\t{o}" for i, o in enumerate(owls)]]) + "\n")
    root = str(tmp_path)
    assert "concepts: 3 (3 active)" in cli.run(["load", root], spark)
    assert "1 issue(s) found" in cli.run(["validate", root], spark)
    assert cli.run(["ecl", root, f"< {A}"], spark) == f"{B}  Beta (x)\n1 concept(s)\n"
    out = cli.run(["lookup", root, str(B)], spark)
    assert "FSN: Beta (x)" in out and f"parent: {A}" in out and "not found" in cli.run(["lookup", root, str(Y)], spark)
    assert "3 concept(s), 3 subsumption pair(s) total" in cli.run(["classify", root], spark)
    assert f"{A}" in cli.run(["classify", root, str(C)], spark) and "no necessary normal form" in cli.run(["nnf", root, str(Y)], spark)
    assert f"{R}" in cli.run(["nnf", root, str(C)], spark)
    assert cli.run(["export", str(tmp_path / "sct2_Concept_Snapshot_INT_20190731.txt")], spark).count("\n") == 3
