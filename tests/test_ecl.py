"""Expression constraints: syntax, refusals, evaluation."""

import pytest

from termloom.functions import constants as K
from termloom.functions.ids import compose_id
from termloom.operators.snapshot import Snapshot
from termloom.plans.compiler import Compiler
from termloom.plans.ecl import Compound, EclError, Filtered, Refined, Simple, parse

ROOT, FINDING, DISEASE, MI = 138875005, 404684003, 64572001, 22298006
A, B, C, SITE, OTHER, GROUPED = (compose_id(i) for i in range(1000, 1006))


@pytest.fixture(scope="module")
def snapshot(spark):
    times = {ROOT: 20190131, FINDING: 20190731, DISEASE: 20200731, MI: 20190731}
    concepts = [(c, times.get(c, 20190731), c != DISEASE, K.CORE_MODULE, K.DEFINED if c == FINDING else K.PRIMITIVE) for c in (ROOT, FINDING, DISEASE, MI, A, B, C, SITE, OTHER, GROUPED)]
    rows = [(i, 20190731, True, 0, s, d, g, t, k, 0) for i, (s, d, g, t, k) in enumerate([
        (FINDING, ROOT, 0, K.IS_A, K.INFERRED), (DISEASE, FINDING, 0, K.IS_A, K.INFERRED), (MI, DISEASE, 0, K.IS_A, K.INFERRED),
        (MI, A, 0, SITE, K.INFERRED), (MI, B, 0, SITE, K.INFERRED), (DISEASE, A, 0, OTHER, K.INFERRED), (FINDING, A, 1, SITE, K.STATED),
        (GROUPED, A, 1, SITE, K.INFERRED), (GROUPED, B, 1, OTHER, K.INFERRED), (GROUPED, C, 2, SITE, K.INFERRED),
    ])]
    values = [(20, 20190731, True, 0, MI, ("Number", "10", 10.0), 0, SITE, K.INFERRED, 0), (21, 20190731, True, 0, DISEASE, ("String", "250mg", None), 0, SITE, K.INFERRED, 0)]
    from termloom.sources.schemas import RECORDS

    make = lambda name, data: spark.createDataFrame(data, RECORDS[name].schema)
    member = make("simple", [("x", 20190731, True, 0, A, MI), ("y", 20190731, True, 0, A, 777)])
    return Snapshot(spark, {"concept": make("concept", concepts), "relationship": make("relationship", rows), "concrete": make("concrete", values), "simple": member})


@pytest.fixture(scope="module")
def ids(snapshot):
    compiler = Compiler(snapshot)
    names = dict(ROOT=ROOT, FINDING=FINDING, DISEASE=DISEASE, MI=MI, A=A, B=B, C=C, SITE=SITE, OTHER=OTHER, GROUPED=GROUPED)

    def run(text):
        for k in sorted(names, key=len, reverse=True):
            text = text.replace(f"@{k}", str(names[k]))
        found = [r["id"] for r in compiler(text).collect()]
        assert len(found) == len(set(found))
        return set(found)

    return run


CASES = [
    ("< @FINDING", {DISEASE, MI}), ("<< @FINDING", {FINDING, DISEASE, MI}), ("<! @FINDING", {DISEASE}), ("<<! @FINDING", {FINDING, DISEASE}),
    ("> @MI", {DISEASE, FINDING, ROOT}), (">> @MI", {MI, DISEASE, FINDING, ROOT}), (">! @MI", {DISEASE}), (">>! @MI", {MI, DISEASE}),
    ("< *", {FINDING, DISEASE, MI}), ("> *", {ROOT, FINDING, DISEASE}), ("@ROOT |root|", {ROOT}), ("900000000000207008", set()), ("<< 900000000000207008", set()),
    ("<< @FINDING AND >> @MI", {FINDING, DISEASE, MI}), ("<< @FINDING , >> @MI", {FINDING, DISEASE, MI}), ("@MI or @ROOT", {MI, ROOT}), ("<< @FINDING MINUS << @DISEASE", {FINDING}),
    ("^ @A", {MI, 777}), ("^ @A {{ C active = * }}", {MI}),
    ("< * : [2..*] @SITE = *", {MI}), ("< * : @SITE = *", {MI}), ("< * : [1..1] @SITE = *", set()), ("@MI : [3..*] @SITE != *", {MI}), ("@MI : @SITE != *", set()),
    ("@A : R @SITE = @MI", {A}), ("@A : @SITE = @MI", set()), ("@MI : R @SITE = @MI", set()), ("* : @SITE = @A", {MI, GROUPED}),
    ("* : { @SITE = @A AND @OTHER = @B }", {GROUPED}), ("* : { @SITE = @C AND @OTHER = @B }", set()), ("* : [2..*] { @SITE = * }", {GROUPED}), ("* : [3..*] { @SITE = * }", set()), ("@MI : { @SITE = @A }", set()), ("@MI : [0..0] { @SITE = @A }", {MI}),
    ("@MI : @SITE = #10", {MI}), ("@MI : @SITE = #11", set()), ("@MI : @SITE != #11", {MI}), ("@MI : @SITE <= #10", {MI}), ("@MI : @SITE < #10", set()), ("@MI : @SITE >= #10", {MI}), ("@MI : @SITE > #9", {MI}), ("@DISEASE : @SITE = #250", set()), ("@MI : @SITE = #+10.0", {MI}),
    ('@DISEASE : @SITE = ("500mg" "250mg")', {DISEASE}), ('@DISEASE : @SITE = ("500mg" "1000mg")', set()), ('@DISEASE : @SITE != ("500mg" "250mg")', set()), ('@DISEASE : @SITE = "250mg"', {DISEASE}),
    ("<< @FINDING {{ C active = true }}", {FINDING, MI}), ("<< @FINDING {{ C active = false }}", {DISEASE}), ("<< @FINDING {{ C active != true }}", {DISEASE}), ("<< @FINDING {{ C active != * }}", set()), ("<< @FINDING {{ C active = true }} {{ C active = false }}", set()),
    ("<< @FINDING {{ C definitionStatus = defined }}", {FINDING}), ("<< @FINDING {{ C definitionStatus != primitive }}", {FINDING}), ("<< @FINDING {{ C definitionStatus = (primitive defined) }}", {FINDING, DISEASE, MI}),
    ('>> @DISEASE {{ C effectiveTime = "20190731" }}', {FINDING}), ('>> @DISEASE {{ C effectiveTime != "20190731" }}', {ROOT, DISEASE}), ('>> @DISEASE {{ C effectiveTime < "20190731" }}', {ROOT}), ('>> @DISEASE {{ C effectiveTime >= "20190731" }}', {FINDING, DISEASE}), ('>> @DISEASE {{ C effectiveTime != ("20190131" "20200731") }}', {ROOT, FINDING, DISEASE}),
    ("@MI AND << @FINDING : @SITE = @A", {MI}), ("<< @FINDING : @SITE = @A MINUS @MI", set()), ("<< @FINDING : (@SITE = @C OR @SITE = @B), @SITE = @A", {MI}), ("<< @FINDING : /* note */ @OTHER = @A", {DISEASE}),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_evaluation(ids, text, expected):
    assert ids(text) == expected


REFUSED = [
    ("123", "InvalidSctId", 0), ("< 123", "InvalidSctId", 2), (f"{ROOT} MINUS {ROOT} MINUS {ROOT}", "ExclusionTakesTwoOperands", 26), (f"{ROOT} AND {ROOT} OR {ROOT}", "MixedOperators", 24), (f"{ROOT} )", "UnexpectedToken", 10),
    (f'{ROOT} {{{{ term = "x" }}}}', "UnexpectedKeyword", 13), (f"{ROOT} : [0.1] {ROOT} = *", "UnexpectedToken", 14), (f"{ROOT} |open", "UnterminatedTerm", 10), (f"{ROOT} /* open", "UnterminatedComment", 10), (f'{ROOT} : {ROOT} = "x', "UnterminatedString", 24),
    ("^ *", "NotYetImplemented", 2), (f"^R {ROOT}", "NotYetImplemented", 1), (f"^ {ROOT} [x", "NotYetImplemented", 12), (f"{ROOT} . {ROOT}", "NotYetImplemented", 10), (f"{ROOT} {{{{ D active = true }}}}", "NotYetImplemented", 10), (f"{ROOT} {{{{ M active = true }}}}", "NotYetImplemented", 10), (f"{ROOT} {{{{ active = true }}}}", "NotYetImplemented", 10),
    (f"!!> {ROOT}", "NotYetImplemented", 0), (f"< ^ {ROOT}", "NotYetImplemented", 2), (f'{ROOT} : R {ROOT} = "x"', "NotYetImplemented", None), ("ab1#5", "NotYetImplemented", 0), ("XOR", "UnexpectedKeyword", 0), ("", "UnexpectedToken", 0), ("§", "UnexpectedChar", 0), (f'* {{{{ C effectiveTime = "20191301" }}}}', "InvalidEffectiveTime", 23), (f"{ROOT} : {ROOT} = * AND {ROOT} = * OR {ROOT} = *", "MixedOperators", None),
]


@pytest.mark.parametrize("text, kind, pos", REFUSED)
def test_refusals(text, kind, pos):
    e = pytest.raises(EclError, parse, text).value
    assert e.kind == kind and (pos is None or e.pos == pos)


def test_shape():
    assert parse(f"{ROOT} AND {MI} : {SITE} = *").op == "AND" and isinstance(parse(f"{ROOT} AND {MI} : {SITE} = *").items[1], Refined)
    assert isinstance(parse(f"({ROOT} OR {MI}) {{{{ C active = true }}}}"), Filtered)
    assert parse("<<*") == Simple("<<", None) and isinstance(parse(f"{ROOT} minus {MI}"), Compound)
    assert parse(f'{ROOT} : {SITE} = "a\\"b\\\\"').refinement.value == ('a"b\\',)
