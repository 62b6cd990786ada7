from tests.test_core import CONCEPT, concept
from termloom.sources.schemas import RECORDS
from termloom.streaming import deltas


def test_deltas_update_a_snapshot(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    table, cp = str(tmp_path / "table"), str(tmp_path / "cp")

    def step(name, *rows):
        (source / name).write_text("\n".join([CONCEPT, *rows]) + "\n")
        deltas.maintain(deltas.read_delta_stream(spark, str(source), RECORDS["concept"]), table, cp).awaitTermination()

    step("sct2_Concept_Delta_INT_20190131.txt", concept(138875005, 20190131), concept(116680003, 20190131))
    step("sct2_Concept_Delta_INT_20190731.txt", concept(138875005, 20190731, 0), concept(404684003, 20190731), concept(116680003, 20180101, 0))
    got = {(r["id"], r["effectiveTime"], r["active"]) for r in spark.read.parquet(f"{table}/1").collect()}
    assert got == {(138875005, 20190731, False), (116680003, 20190131, True), (404684003, 20190731, True)}
