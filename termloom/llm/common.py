"""Helpers that every operator here shares: table access, column names, runs of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from termloom.cuts import Cuts, checkpoint_root, remove  # noqa: F401

ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of df, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(texts: Iterable[str], budget: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about `budget` characters; a longer text stands alone."""
    start = size = i = 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > budget:
            yield start, i
            start, size = i, 0
        size += n
    if size or start <= i:
        yield start, i + 1


def map_texts(df: DataFrame, id_col: str, text_col: str, fn, fields: str, setup=None, budget: int = 1 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Apply fn(texts) or fn(state, texts) to runs of whole texts in Arrow batches.

    fn returns one sequence or Arrow array for each of `fields` (a DDL list), in order. The result
    has the id column, the `carry` columns and the fields. setup() makes the state, once for each
    Python worker's task. Null texts arrive as "".
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string(fields)
    keep = [id_col, *carry]
    schema = StructType([*(df.schema[c] for c in keep), *made.fields])
    types = [f.type for f in to_arrow_schema(made)]

    def run(batches):
        state = setup() if setup else None
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            for a, b in slices(texts, budget):
                part = texts[a:b]
                got = fn(state, part) if setup else fn(part)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), *(x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(got, types, strict=True))], names=schema.names)

    return df.select(*[df[c] for c in keep], df[text_col].alias("g_text")).mapInArrow(run, schema)


def filter_texts(df: DataFrame, text_col: str, keep, setup=None, budget: int = 1 << 20) -> DataFrame:
    """The rows for which keep(texts) or keep(state, texts), a sequence of booleans, is true; all columns stay as they are."""
    import pyarrow as pa

    at = df.columns.index(text_col)

    def run(batches):
        state = setup() if setup else None
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in slices(texts, budget):
                part = texts[a:b]
                yield batch.slice(a, b - a).filter(pa.array(keep(state, part) if setup else keep(part), pa.bool_()))

    return df.mapInArrow(run, df.schema)
