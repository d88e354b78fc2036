"""Column-level data quality: a profile of whole tables and issues of loads.

Footers give exact NULL counts and, where valid, extrema; dictionaries give the distinct values of the chunks they cover. What
these tell is taken row group by row group; only the column chunks for which they don't suffice are scanned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from vellum.operators.quantiles import exact_quantiles, finite
from vellum.operators.skew import HEAVY_ROWS, HEAVY_SHARE, heavy_keys, join_on_unique
from vellum.session import Scratch
from vellum.sources.footers import Chunk, Files, described, row_groups, tasks_for

# --- profiles of tables -------------------------------------------------------------------------------------------------

FACTS = "table_name string, column_name string, n_rows bigint, n_nulls bigint, scanned boolean, lo_int bigint, hi_int bigint, lo_num double, hi_num double, lo_text binary, hi_text binary, v array<binary>"


def _value_keys(chunk: Chunk) -> pa.Array:
    """Distinct values as short keys: numbers by their eight bytes, text and others by a digest of 128 bits. NaN is left out."""
    if chunk.kind in ("int", "bool", "float") and isinstance(chunk.values, np.ndarray):
        values = chunk.values[~np.isnan(chunk.values)] if chunk.kind == "float" else chunk.values.astype(np.int64)
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(values), [None, pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())
    return pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in chunk.values], pa.binary())


def _facts(table: str, name: str, chunk: Chunk, scanned: bool) -> pa.RecordBatch:
    extrema = {k: (chunk.lo, chunk.hi) if chunk.kind == k else (None, None) for k in ("int", "float", "text")}
    keys = _value_keys(chunk)
    row = [
        pa.array([table]), pa.array([name]), pa.array([chunk.rows], pa.int64()), pa.array([chunk.nulls], pa.int64()), pa.array([scanned]),
        *[pa.array([v], t) for k, t in (("int", pa.int64()), ("float", pa.float64()), ("text", pa.binary())) for v in extrema[k]],
        pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
    ]
    return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in FACTS.split(", ")])


def _sufficient(chunk: Chunk) -> bool:
    return chunk.nulls is not None and chunk.values is not None and (chunk.empty or chunk.kind == "bool" or chunk.lo is not None or len(chunk.values) > 0)


def table_facts(spark: SparkSession, tables: dict[str, str], columns: dict[str, list[str]]) -> DataFrame:
    """Rows of FACTS: one for each column chunk told by footer and dictionary, one for each batch of the chunks scanned.

    A row group's insufficient chunks are read in one pass, and no others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Files()
        for batch in batches:
            for table, file, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = opened.group(file, number)
                told = {c: group.chunk(c) for c in columns[table]}
                for c, chunk in told.items():
                    if _sufficient(chunk):
                        yield _facts(table, c, chunk, False)
                rest = [c for c, chunk in told.items() if not _sufficient(chunk)]
                for rows in group.batches(rest) if rest else ():
                    for i, c in enumerate(rest):
                        yield _facts(table, c, described(rows.column(i)), True)

    return row_groups(spark, tables).mapInArrow(run, FACTS)


def profile_tables(spark: SparkSession, tables: dict[str, str], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each table (name -> path) and column: rows, NULLs, distinct values (NULL and NaN aside) and extrema (NaN aside).

    Values are counted in the column's own type. Extrema of integers, dates (days) and timestamps (microseconds) are in ``lo_int``
    and ``hi_int``, of floats in ``lo_num`` and ``hi_num``, of text in ``lo_text`` and ``hi_text``; other types have none.
    An empty table gives rows with zero counts.
    """
    columns = {t: (columns or {}).get(t) or spark.read.parquet(p).columns for t, p in tables.items()}
    facts = Scratch(spark, "facts").keep(table_facts(spark, tables, columns))
    by = ["table_name", "column_name"]
    sums = facts.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"),
        *[f(c).alias(c) for c, f in (("lo_int", F.min), ("hi_int", F.max), ("lo_num", F.min), ("hi_num", F.max), ("lo_text", F.min), ("hi_text", F.max))],
    )
    distinct = facts.select(*by, F.explode("v").alias("v")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_distinct"))
    # a row for each column, however many files: tables without a row group too
    named = spark.createDataFrame([(t, c) for t, cs in columns.items() for c in cs], "table_name string, column_name string")
    out = named.join(sums, by, "left").join(distinct, by, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_nulls", "n_distinct")]
    return out.select(*by, *zero, "lo_int", "hi_int", "lo_num", "hi_num", F.decode("lo_text", "UTF-8").alias("lo_text"), F.decode("hi_text", "UTF-8").alias("hi_text"))


def profile_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """:func:`profile_tables` of one table, without its name."""
    return profile_tables(spark, {"": path}, {"": columns} if columns else None).drop("table_name")


# --- issues of loads ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """What to check of a column: ``low`` and the column ``high`` bound its values, ``allowed`` is its text pattern's whole language."""

    column: str
    low: float | None = None
    high: str | None = None
    allowed: tuple[str, ...] = ()
    most_nulls: float = 0.10
    factor: float = 2.0
    step: float = 0.25


#: What a row group tells of a rule's column. ``lo`` and ``hi``: extrema of the finite values in order of size, as doubles and, for
#: integers, exactly; ``out`` and ``odd``: are there values out of range, or outside the pattern; ``share``: of the first allowed value.
TOLD = (
    "struct<n_nulls:bigint, known:boolean, full:boolean, lo:double, hi:double, one:boolean, out:boolean, odd:boolean, least:double, most:double>"
)
LOADS = f"table_name string, file string, row_group int, pure boolean, loads array<struct<k:string,n:bigint,line:string>>, cols array<{TOLD}>"


def _outward(v, up: bool) -> float | None:
    """``v`` as a double that isn't nearer: bounds of integers beyond 2^53 stay bounds."""
    if v is None:
        return None
    x = float(v)
    return x if x == v or (x > v) == up else float(np.nextafter(x, np.inf if up else -np.inf))


def _tell(rule: Rule, chunk: Chunk, high: Chunk | None) -> dict:
    """TOLD of a chunk; what statistics and dictionary leave open is None."""
    out = dict.fromkeys(("known", "full", "lo", "hi", "one", "out", "odd", "least", "most"))
    out["n_nulls"] = chunk.nulls
    if chunk.empty:
        return out | {"known": True, "full": False, "out": False, "odd": False, "one": False}
    if rule.allowed:
        if chunk.values is None or chunk.kind != "text":
            return out | {"known": False, "least": 0.0, "most": 1.0}
        words = {v.decode(errors="replace") for v in chunk.values}
        held = rule.allowed[0] in words
        return out | {"known": True, "full": chunk.nulls == 0, "odd": bool(words - set(rule.allowed)), "least": float(words == {rule.allowed[0]}), "most": float(held)}
    lo, hi, wild = chunk.lo, chunk.hi, None
    if chunk.kind == "float" and chunk.values is not None:
        solid = chunk.values[np.isfinite(chunk.values)]
        wild = len(solid) < len(chunk.values)
        lo, hi = (float(solid[0]), float(solid[-1])) if len(solid) else (None, None)
    elif chunk.kind == "int":
        wild = False
    if wild is None or (lo is None and not wild):
        return out | {"known": False}
    broken = wild or (rule.low is not None and lo is not None and lo < rule.low)
    if not broken and high is not None and lo is not None:
        if high.empty:
            broken = False
        elif high.lo is None or high.kind not in ("int", "float"):
            broken = None
        elif hi > high.lo:
            broken = True if lo > high.hi and chunk.nulls == 0 and high.nulls == 0 else None
    return out | {"known": True, "full": chunk.nulls == 0 and not wild, "lo": _outward(lo, False), "hi": _outward(hi, True), "one": lo == hi and lo is not None, "out": broken}


def load_facts(spark: SparkSession, path: str, rules: list[Rule], key: str, line: str) -> DataFrame:
    """Rows of LOADS, one for each row group: the loads it holds with their rows and line, and what is known of each rule's column.

    The key's dictionary tells the loads. If there are several, or if it is missing, key and line of this row group are read.
    """

    def loads(group) -> tuple[bool, list[tuple]]:
        keys, lines = group.chunk(key), group.chunk(line)
        if keys.empty:
            return True, []
        if keys.kind == "text" and keys.nulls == 0 and keys.values is not None and len(keys.values) == 1 and lines.values is not None and (lines.empty or lines.kind == "text"):
            return True, [(keys.values[0].decode(errors="replace"), group.rows, lines.lo.decode(errors="replace") if lines.lo is not None else None)]
        read = pa.Table.from_batches(list(group.batches([key, line])))
        read = pa.table({"k": read[key].cast(pa.string()), "line": read[line].cast(pa.string())})
        counts = read.group_by(["k", "line"]).aggregate([([], "count_all")]).to_pylist()
        found: dict = {}
        for r in counts:
            n, least = found.get(r["k"], (0, None))
            found[r["k"]] = (n + r["count_all"], min((x for x in (least, r["line"]) if x is not None), default=None))
        return len(found) == 1, [(k, n, x) for k, (n, x) in found.items() if k is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, schema = Files(), to_arrow_schema(spark_schema)
        for batch in batches:
            rows = []
            for _, file, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = opened.group(file, number)
                pure, held = loads(group)
                told = [_tell(r, group.chunk(r.column), group.chunk(r.high) if r.high else None) for r in rules]
                rows.append({"table_name": "", "file": file, "row_group": number, "pure": pure, "loads": [dict(zip(("k", "n", "line"), x, strict=True)) for x in held], "cols": told})
            yield pa.RecordBatch.from_pylist(rows, schema)

    spark_schema = StructType.fromDDL(LOADS)
    return row_groups(spark, {"": path}).mapInArrow(run, LOADS)


def scan_chunks(spark: SparkSession, targets: DataFrame, key: str, schema: StructType, tasks: int) -> DataFrame:
    """(_key, columns of ``schema``) of the rows that ``targets`` (file, row_group, keys, columns) name; columns not asked for are NULL."""
    names = [f.name for f in schema if f.name != "_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, arrow = Files(), to_arrow_schema(schema)
        for batch in batches:
            for file, number, keys, columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked, wanted = set(columns), pa.array(keys, pa.string())
                read = [c for c in names if c in asked]
                for rows in opened.group(file, number).batches([key, *(c for c in read if c != key)]):
                    loads = rows.column(rows.schema.get_field_index(key)).cast(pa.string())
                    picked = pc.is_in(loads, value_set=wanted)
                    held = [rows.column(rows.schema.get_field_index(c)).filter(picked).cast(arrow.field(c).type) if c in asked else pa.nulls(picked.true_count, arrow.field(c).type) for c in names]
                    yield pa.RecordBatch.from_arrays([loads.filter(picked), *held], schema=arrow)

    return targets.select("file", "row_group", "keys", "columns").repartition(tasks, "file", "row_group").mapInArrow(run, schema)


def _decided(rules: list[Rule]) -> list[Column]:
    """Aggregates over a load's row groups that say of each rule what is decided: <i>_nulls, <i>_out, <i>_odd, <i>_one (NULL: open), and bounds."""
    pure, aggs = F.bool_and("pure"), []
    for i, r in enumerate(rules):
        at = lambda f, i=i: F.col("cols")[i][f]
        nulls = F.sum(at("n_nulls"))
        told = F.count_if(at("n_nulls").isNull()) == 0
        aggs.append(F.when(~told, None).when(pure, nulls > r.most_nulls * F.sum("n")).when(nulls == 0, False).alias(f"{i}_nulls"))
        known, full = F.bool_and(F.coalesce(at("known"), F.lit(False))), F.bool_and(F.coalesce(at("full"), F.lit(False)))
        flag = "odd" if r.allowed else "out"
        none, some = F.bool_and(F.coalesce(~at(flag), F.lit(False))), F.bool_or(F.coalesce(at(flag), F.lit(False)))
        aggs.append(F.when(none, False).when(pure & some, True).alias(f"{i}_{flag}"))
        if r.allowed:
            lo, hi = F.min(at("least")), F.max(at("most"))
            sure = known & (full | (pure & F.max(at("most")).isNotNull()))
        else:
            lo, hi = F.min(at("lo")), F.max(at("hi"))
            sure = known & (full | (pure & lo.isNotNull()))
            # bounds of large integers are rounded outward: equal ones are exact, overlapping ones say nothing
            single = F.bool_and(F.coalesce(at("one"), F.lit(False)) | F.coalesce(at("lo").isNull() & at("known"), F.lit(False)))
            wide = F.bool_or(F.coalesce(~at("one") & at("lo").isNotNull(), F.lit(False))) | (F.min(at("hi")) < F.max(at("lo")))
            one = F.when(known & lo.isNull(), False).when(sure & single & (lo == hi), True).when(known & pure & wide, False)
            aggs.append(one.alias(f"{i}_one"))
        # bounds of the median or share; NULL bounds with ``known``: there is none
        aggs += [known.alias(f"{i}_known"), F.coalesce(sure, F.lit(False)).alias(f"{i}_sure"), lo.alias(f"{i}_lo"), hi.alias(f"{i}_hi")]
    return aggs


def _drift_decided(i: int, r: Rule) -> Column:
    """Is drift certain, impossible or (NULL) open, by the bounds of the load and of its line's first load?"""
    lo, hi, lo0, hi0 = (F.col(f"{i}_{x}") for x in ("lo", "hi", "lo0", "hi0"))
    known, sure = F.col(f"{i}_known") & F.col(f"{i}_known0"), F.col(f"{i}_sure") & F.col(f"{i}_sure0")
    nothing = (F.col(f"{i}_known") & lo.isNull()) | (F.col(f"{i}_known0") & lo0.isNull())
    if r.allowed:
        apart, near = F.greatest(lo - hi0, lo0 - hi), F.greatest(hi - lo0, hi0 - lo)
        certain, never = apart > r.step, near <= r.step
    else:
        certain, never = (lo > r.factor * hi0) | (hi < lo0 / r.factor), (hi <= r.factor * lo0) & (lo >= hi0 / r.factor)
    return F.when(F.coalesce(nothing, F.lit(False)), False).when(F.coalesce(known & never, F.lit(False)), False).when(F.coalesce(sure & certain, F.lit(False)), True)


def load_issues(spark: SparkSession, path: str, rules: list[Rule], key: str = "run_id", line: str = "release_line") -> DataFrame:
    """(column_name, <key>, issue) of every load: null_rate, range, pattern, constant and drift as far as ``rules`` ask.

    1. Row groups tell which loads they hold and, from statistics and dictionaries, NULLs, extrema and spelling of each column.
    2. Whatever follows from that is decided: all of a row group that holds one load, absence of NULLs, values in range and
       known words in any; drift if the extrema of a load and of its line's first load leave one answer.
    3. Only the chunks that hold a load and column still open are scanned, and of their rows only those of such loads.

    Loads are the values of ``key``, a text column; rows without one belong to no load. A load of NULLs alone has no range,
    pattern, constant or drift. Drift compares with the line's first load, the least ``key``; a load without line is compared
    with the other loads without. Repeated rows count as stored. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "loads")
    kinds = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    facts = scratch.keep(load_facts(spark, path, rules, key, line))
    held = facts.select("file", "row_group", "pure", "cols", F.explode("loads").alias("l")).select("file", "row_group", "pure", "cols", "l.*").withColumnRenamed("k", "_key")
    told = scratch.keep(held.groupBy("_key").agg(F.sum("n").alias("n_rows"), F.min("line").alias("line"), *_decided(rules)).withColumn("line", F.coalesce(F.concat(F.lit("="), "line"), F.lit(""))))
    n_loads, n_rows = told.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    bounds = [f"{i}_{x}" for i in range(len(rules)) for x in ("known", "sure", "lo", "hi")]
    first = told.groupBy("line").agg(F.min(F.struct("_key", *bounds)).alias("f")).select("line", F.col("f._key").alias("first"), *[F.col(f"f.{b}").alias(f"{b}0") for b in bounds])
    both = join_on_unique(told, first, "line", "left", heavy_keys(told, "line", n_loads))
    both = scratch.keep(both.withColumns({f"{i}_drift": _drift_decided(i, r) for i, r in enumerate(rules)}))

    # loads and columns that are open, with the first loads that open drifts are compared with
    checks = {i: [f"{i}_nulls", f"{i}_drift", *([f"{i}_odd"] if r.allowed else [f"{i}_out", f"{i}_one"])] for i, r in enumerate(rules)}
    open_at = [F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in checks[i]]), F.lit(i)) for i in checks]
    drift_at = [F.when(F.col(f"{i}_drift").isNull(), F.lit(i)) for i in checks]
    asked = both.select("_key", F.explode(F.array_compact(F.array(*open_at))).alias("i")).unionByName(both.select(F.col("first").alias("_key"), F.explode(F.array_compact(F.array(*drift_at))).alias("i")))
    asked = asked.groupBy("_key").agg(F.array_sort(F.collect_set("i")).alias("at"))  # at most one entry a rule

    needed = sorted({c for r in rules for c in (r.column, r.high) if c})
    reads = F.array(*[F.array(*[F.lit(c) for c in (r.column, r.high) if c]) for r in rules])
    by_group = held.select("file", "row_group", "_key").join(asked, "_key").groupBy("file", "row_group")
    targets = by_group.agg(F.collect_set("_key").alias("keys"), F.array_distinct(F.flatten(F.collect_set(F.flatten(F.transform("at", lambda i: F.get(reads, i)))))).alias("columns"))
    schema = StructType([StructField("_key", StringType()), *[StructField(c, kinds[c]) for c in needed]])
    rows = scratch.keep(scan_chunks(spark, targets, key, schema, tasks_for(spark, [path])))

    aggs = []
    for i, r in enumerate(rules):
        c = F.col(r.column)
        aggs.append(F.count_if(c.isNull()).alias(f"{i}_s_nulls"))
        if r.allowed:
            aggs.append(F.count_if(c.isNotNull() & ~c.isin(*r.allowed)).alias(f"{i}_s_odd"))
            aggs.append(F.try_divide(F.count_if(c == r.allowed[0]), F.count(c)).alias(f"{i}_mid"))
            continue
        bad = ~finite(c) if kinds[r.column].typeName() in ("double", "float") else F.lit(False)
        bad = bad | (c < r.low) if r.low is not None else bad
        bad = bad | (c > F.col(r.high)) if r.high else bad
        aggs.append(F.count_if(c.isNotNull() & F.coalesce(bad, F.lit(False))).alias(f"{i}_s_out"))
        solid = F.when(finite(c), c)  # in the column's own type: integers beyond 2^53 stay apart
        aggs.append((F.min(solid) == F.max(solid)).alias(f"{i}_s_one"))
    scanned = rows.groupBy("_key").agg(*aggs)
    numeric = [(i, r) for i, r in enumerate(rules) if not r.allowed]
    if numeric:
        least = max(HEAVY_ROWS, n_rows // HEAVY_SHARE)
        heavy = [r[0] for r in told.where(F.col("n_rows") >= least).select("_key").collect()] if n_rows >= HEAVY_ROWS else []
        medians = exact_quantiles(rows, [r.column for _, r in numeric], [0.5], "_key", heavy=heavy)
        scanned = scanned.join(medians.select("_key", *[F.col(f"{r.column}_q")[0].alias(f"{i}_mid") for i, r in numeric]), "_key", "left")
    out = both.join(scanned.join(asked, "_key"), "_key", "left")
    # of a load scanned for other columns only, the rest of its row is void
    was = lambda i: F.array_contains("at", F.lit(i))
    mids = {f"{i}_mid": F.when(was(i), F.col(f"{i}_mid")).when(F.col(f"{i}_sure") & (F.col(f"{i}_lo") == F.col(f"{i}_hi")), F.col(f"{i}_lo")) for i in checks}
    out = scratch.keep(out.withColumns(mids))
    starts = out.where(F.col("_key") == F.col("first")).select("line", *[F.col(f"{i}_mid").alias(f"{i}_mid0") for i in checks])
    out = join_on_unique(out, starts, "line", "left", heavy_keys(out, "line", n_loads))
    issues = []
    for i, r in enumerate(rules):
        now, then = F.col(f"{i}_mid"), F.col(f"{i}_mid0")
        drift = F.abs(now - then) > r.step if r.allowed else (now > r.factor * then) | (now < then / r.factor)
        issues.append((r.column, "null_rate", F.coalesce(F.col(f"{i}_nulls"), F.when(was(i), F.col(f"{i}_s_nulls") > r.most_nulls * F.col("n_rows")))))
        issues.append((r.column, "drift", F.coalesce(F.col(f"{i}_drift"), drift)))
        if r.allowed:
            issues.append((r.column, "pattern", F.coalesce(F.col(f"{i}_odd"), F.when(was(i), F.col(f"{i}_s_odd") > 0))))
        else:
            issues.append((r.column, "range", F.coalesce(F.col(f"{i}_out"), F.when(was(i), F.col(f"{i}_s_out") > 0))))
            issues.append((r.column, "constant", F.coalesce(F.col(f"{i}_one"), F.when(was(i), F.col(f"{i}_s_one")))))
    found = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(c).alias("column_name"), F.lit(x).alias("issue"))) for c, x, cond in issues])
    return out.select("_key", F.explode(F.array_compact(found)).alias("e")).select("e.column_name", F.col("_key").alias(key), "e.issue")
