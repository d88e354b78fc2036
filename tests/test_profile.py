import math

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vellum.operators.profile import Rule, load_issues, profile_table
from vellum.operators.quantiles import exact_quantiles
from vellum.sources import footers

RULES = [Rule("n", low=1, high="top"), Rule("s", low=0), Rule("t", allowed=("True", "False"))]
NAN, INF = float("nan"), float("inf")


def write(path, rows, **options):
    schema = pa.schema([("release_line", pa.string()), ("run_id", pa.string()), ("n", pa.int64()), ("top", pa.int64()), ("s", pa.float64()), ("t", pa.string()), ("issue", pa.string()), ("line", pa.int32()), ("n_rows", pa.int32())])
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, ["x"] * len(rows), [1] * len(rows), [2] * len(rows)], schema, strict=True)], schema=schema)
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path, **options)


LOADS = [
    *[("L", "r0", 10 + i, 100, 1.0 + i, "True") for i in range(10)],
    *[("L", "r1", None if i < 2 else 10 + i, 100, 1.0 + i, None if i < 1 else "True") for i in range(10)],  # a fifth of n missing, a tenth of t
    *[("L", "r2", 0 if i < 1 else 12, 100, NAN if i < 1 else 4.0, "yes" if i < 1 else "False") for i in range(10)],
    *[("L", "r3", 101 if i < 1 else 50 + i, 100, -1.0 if i < 1 else 30.0 + i, "True") for i in range(10)],
    *[("M", "r0b", None, None, None, None) for _ in range(3)],
    *[("M", "r1b", 5, None, INF, "False") for _ in range(3)],
    *[("N", "one", 7, 9, 2.0, "True")],
    *[("N", "one", 7, 9, 2.0, "True")],
    *[("N", None, 0, 1, -5.0, "odd")],
]
WANT = {
    ("n", "r1", "null_rate"), ("n", "r2", "range"), ("s", "r2", "range"), ("s", "r2", "constant"), ("t", "r2", "pattern"), ("t", "r2", "drift"),
    ("n", "r3", "range"), ("s", "r3", "range"), ("n", "r3", "drift"), ("s", "r3", "drift"), ("n", "r0b", "null_rate"), ("s", "r0b", "null_rate"), ("t", "r0b", "null_rate"),
    ("n", "r1b", "constant"), ("s", "r1b", "range"), ("n", "one", "constant"), ("s", "one", "constant"),
}


@pytest.mark.parametrize("layout", ["one group", "group per row", "file per load", "no dictionary", "no statistics"])
def test_issues_dont_depend_on_the_layout(spark, tmp_path, layout):
    """Nulls in every column, a load without key, repeated rows and columns whose names the operator uses itself."""
    path = tmp_path / "t.parquet"
    if layout == "file per load":
        for k in {r[1] for r in LOADS}:
            write(path / f"part-{k}.parquet", [r for r in LOADS if r[1] == k])
    else:
        write(path, LOADS, **{"group per row": {"row_group_size": 1}, "no dictionary": {"use_dictionary": False}, "no statistics": {"write_statistics": False}}.get(layout, {}))
    got = {tuple(r) for r in load_issues(spark, str(path), RULES).collect()}
    assert got == WANT


@pytest.fixture
def read(monkeypatch, tmp_path):
    """The (file, row group, columns) that are read, in files next to the data: tasks run in other processes."""
    note = tmp_path / "read"
    note.mkdir()

    def noting(group, columns, inner=footers.RowGroup.batches):
        import uuid

        name = uuid.uuid4().hex
        with open(f"{note}/{name}", "w") as f:
            f.write(f"{group.source_name}|{group.group}|{','.join(sorted(set(columns)))}")
        return inner(group, columns)

    monkeypatch.setattr(footers.RowGroup, "batches", noting)
    return lambda: sorted(tuple(p.read_text().split("|")) for p in note.iterdir())


def test_row_groups_that_tell_enough_are_left_unread(spark, tmp_path, read):
    """Clustered by load: constants, ranges, NULLs, spelling and drifts that extrema decide need no data page."""
    path = tmp_path / "t.parquet"
    write(path / "a.parquet", [("L", "r0", 7, 9, 2.0, "True")] * 5)
    write(path / "b.parquet", [("L", "r1", 70 + i, 90, 2.0 + i / 9, "False") for i in range(5)])  # n drifts for sure, s never, t does
    write(path / "c.parquet", [("L", "r2", None if i else 8, 9, NAN if i else 2.5, "odd" if i else None) for i in range(5)])
    write(path / "d.parquet", [("L", "r3", 6 + 3 * i, 90, 2.0, "True") for i in range(5)])  # the median may drift or not
    got = {tuple(r) for r in load_issues(spark, str(path), RULES).collect()}
    assert got == {
        ("n", "r0", "constant"), ("s", "r0", "constant"), ("n", "r1", "drift"), ("t", "r1", "drift"), ("n", "r2", "null_rate"), ("n", "r2", "constant"), ("s", "r2", "range"),
        ("s", "r2", "constant"), ("t", "r2", "null_rate"), ("t", "r2", "pattern"), ("t", "r2", "drift"), ("s", "r3", "constant"),
    }
    assert [(f.rsplit("/", 1)[1], c) for f, _, c in read()] == [("a.parquet", "n,run_id,top"), ("d.parquet", "n,run_id,top")]


def test_a_profile_scans_only_chunks_without_a_full_dictionary(spark, tmp_path, read):
    values = [f"value {i:06d}" for i in range(4000)]
    pq.write_table(pa.table({"s": values, "k": [i % 7 for i in range(4000)]}), tmp_path / "d.parquet", dictionary_pagesize_limit=1024, row_group_size=2000)
    out = {r["column_name"]: r for r in profile_table(spark, str(tmp_path / "d.parquet")).collect()}
    assert (out["s"]["n_distinct"], out["s"]["lo_text"], out["s"]["hi_text"], out["k"]["n_distinct"], out["k"]["hi_int"]) == (4000, values[0], values[-1], 7, 6)
    assert [(g, c) for _, g, c in read()] == [("0", "s"), ("1", "s")]


@pytest.mark.parametrize("options", [{}, {"use_dictionary": False}, {"use_dictionary": False, "write_statistics": False}])
def test_integers_beyond_doubles(spark, tmp_path, options):
    """Ids like hashes: a thousand near 2^60 are a thousand values, and two neighbours aren't a constant."""
    ids = [(1 << 60) + i for i in range(1000)]
    pq.write_table(pa.table({"id": ids, "neg": [-i for i in ids]}), tmp_path / "i.parquet", **options)
    out = {r["column_name"]: r for r in profile_table(spark, str(tmp_path / "i.parquet")).collect()}
    assert (out["id"]["n_distinct"], out["id"]["lo_int"], out["id"]["hi_int"], out["neg"]["lo_int"]) == (1000, ids[0], ids[-1], -ids[-1])
    write(tmp_path / "t.parquet", [("L", "r0", ids[i], ids[-1], 1.0 + i, "True") for i in (0, 1)] + [("L", "r1", ids[i], ids[i] - 1, 1.0 + i, "True") for i in (0, 1)] + [("L", "r2", ids[1], ids[-1], 1.0 + i, "True") for i in (0, 1)], **options)
    got = {tuple(r) for r in load_issues(spark, str(tmp_path / "t.parquet"), RULES).collect()}
    assert got == {("n", "r1", "range"), ("n", "r2", "constant")}


def test_empty_table(spark, tmp_path):
    write(tmp_path / "t.parquet", [])
    assert load_issues(spark, str(tmp_path / "t.parquet"), RULES).count() == 0
    out = {r["column_name"]: r for r in profile_table(spark, str(tmp_path / "t.parquet")).collect()}
    assert len(out) == 9 and all((r["n_rows"], r["n_nulls"], r["n_distinct"], r["lo_int"], r["lo_num"], r["lo_text"]) == (0, 0, 0, None, None, None) for r in out.values())


@pytest.mark.parametrize("options", [{}, {"row_group_size": 3}, {"use_dictionary": False}, {"compression": "none"}, {"compression": "zstd"}, {"write_statistics": False}, {"data_page_version": "2.0"}, {"dictionary_pagesize_limit": 8}])
def test_profile_equals_pandas(spark, tmp_path, options):
    frame = pd.DataFrame(
        {"i": [3, 1, 2, 1, 3], "x": [1.5, NAN, -2.0, 1.5, 0.0], "s": ["b", None, "é", "b", ""], "flag": [True, False, None, True, True], "gone": pd.Series([None] * 5, dtype="float64"), "at": pd.to_datetime(["2026-01-01", None, "2026-01-03", "2026-01-01", "2026-01-02"])}
    )
    table = pa.Table.from_pandas(frame, preserve_index=False, schema=pa.schema([("i", pa.int32()), ("x", pa.float64()), ("s", pa.string()), ("flag", pa.bool_()), ("gone", pa.float64()), ("at", pa.timestamp("us"))]))
    x = table.column("x").to_pylist()
    table = table.set_column(1, "x", pa.array([NAN if v is None else v for v in x]))
    pq.write_table(table, tmp_path / "p.parquet", **options)
    out = {r["column_name"]: tuple(r)[1:] for r in profile_table(spark, str(tmp_path / "p.parquet")).collect()}
    day, none = 86_400_000_000, (None, None)
    first = 20454 * day
    assert out == {
        "i": (5, 0, 3, 1, 3, *none, *none), "x": (5, 0, 3, *none, -2.0, 1.5, *none), "s": (5, 1, 3, *none, *none, "", "é"), "flag": (5, 1, 2, *none, *none, *none),
        "gone": (5, 5, 0, *none, *none, *none), "at": (5, 1, 3, first, first + 2 * day, *none, *none),
    }


def test_a_chunk_that_left_its_dictionary_has_no_candidates(tmp_path):
    values = [f"value {i:06d}" for i in range(20000)]
    pq.write_table(pa.table({"s": values, "k": [i % 7 for i in range(20000)]}), tmp_path / "d.parquet", dictionary_pagesize_limit=1024)
    with open(tmp_path / "d.parquet", "rb") as f:
        meta = pq.read_metadata(f)
        assert footers.chunk_dictionary(f, meta.row_group(0).column(0)) is None
        assert sorted(footers.chunk_dictionary(f, meta.row_group(0).column(1))) == list(range(7))


def test_a_load_with_a_third_of_the_rows(spark):
    """Its median is exact, by the broadcast way too."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("run_id"), F.sqrt(F.col("id") + 1.0).alias("v"))
    want = df.where("run_id = 'hot'").agg(F.percentile("v", 0.5)).first()[0]
    for heavy in (None, ["hot"]):
        got = exact_quantiles(df, ["v"], [0.5], "run_id", heavy=heavy).where("run_id = 'hot'").first()["v_q"][0]
        assert math.isclose(got, want, rel_tol=1e-12)
