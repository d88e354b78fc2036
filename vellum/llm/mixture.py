"""Problem 7: a mixture of sources that meets target shares of tokens under repetition caps.

Documents are aggregated by membership pattern (the set of listed sources a document belongs to), and a min-cost flow routes
the tokens of patterns to the quotas of sources: the k-th copy of a pattern's tokens costs k, so repetition is spread as thinly
as it can be. Only patterns, at most one for each set of sources that occurs, reach the driver. Documents are then selected in
a seeded hash order, pattern by pattern, without sorting a pattern in one task.
"""

from __future__ import annotations

from collections import deque
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.reading import read_label
from vellum.llm.tokens import DEFAULT_TOKENIZER, encode_documents
from vellum.session import Scratch, rows_of, table

#: Documents that a hash bucket holds on average, when a pattern is selected from without sorting it in one task.
BUCKET_DOCS, LEAST_BUCKETS = 1 << 16, 1024
#: Membership patterns that the flow is solved for on the driver. Sources that overlap in every way have 2^sources patterns.
MOST_PATTERNS = 100_000


def min_cost_flow(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each source: the quotas met as far as can be, at the least cost of repetition.

    Source node -> pattern: one arc of the pattern's tokens for each copy, the k-th at cost k. Pattern -> source: at most
    ``repeats`` times the pattern's tokens. Source -> sink: its quota. Shortest augmenting paths on integers, so it's exact.
    """
    nodes = {"in": 0, "out": 1}
    arcs: list[list[int]] = []  # to, capacity, cost; the reverse arc follows
    out: dict[int, list[int]] = {}

    def node(x) -> int:
        return nodes.setdefault(x, len(nodes))

    def arc(u: int, v: int, capacity: int, cost: int) -> int:
        out.setdefault(u, []).append(len(arcs))
        out.setdefault(v, []).append(len(arcs) + 1)
        arcs.extend([[v, capacity, cost], [u, 0, -cost]])
        return len(arcs) - 2

    routes = {}
    for p, tokens in sorted(patterns.items()):
        usable = [s for s in p if s in quotas]
        if not usable or not tokens:
            continue
        for k in range(1, sum(repeats[s] for s in usable) + 1):
            arc(0, node(("p", p)), tokens, k)
        for s in usable:
            routes[p, s] = arc(node(("p", p)), node(("s", s)), repeats[s] * tokens, 0)
    for s, q in sorted(quotas.items()):
        arc(node(("s", s)), 1, q, 0)
    while True:
        best, via, queue, queued = {0: 0}, {}, deque([0]), {0}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in out.get(u, ()):
                v, capacity, cost = arcs[e]
                if capacity and best[u] + cost < best.get(v, 1 << 62):
                    best[v], via[v] = best[u] + cost, e
                    if v not in queued:
                        queue.append(v)
                        queued.add(v)
        if 1 not in best:
            break
        path, v = [], 1
        while v:
            path.append(via[v])
            v = arcs[via[v] ^ 1][0]
        push = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= push
            arcs[e ^ 1][1] += push
    return {key: arcs[e ^ 1][1] for key, e in routes.items() if arcs[e ^ 1][1]}


def _first_that_fit(rows: DataFrame) -> DataFrame:
    """``rows`` (pattern, source, bucket, h, doc_id, n_tokens, gap, ...) with ``part``: is it among the first of its pattern and
    source in seeded order whose tokens together fit into the gap?"""
    keys = ["pattern", "source"]
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("n"))
    offsets = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*keys, "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n_tokens").over(inside)
    return rows.join(offsets, [*keys, "bucket"]).withColumn("part", upto <= F.col("gap")).drop("before")


class Mixture:
    """The plan for documents (doc_id, sources array, n_tokens) and targets (source, target_share, max_repeats).

    NULL sources are no membership; documents of no listed source are left aside, also from the total that shares refer to.
    Sources without documents fall short. Repeated rows are documents of their own. Empty tables give an empty mixture.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, scratch: Scratch, seed: int = 7):
        self.seed, self.spark, self.scratch = seed, docs.sparkSession, scratch
        self.targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source is not null").collect()}
        listed = F.array(*[F.lit(s) for s in sorted(self.targets)]).cast("array<string>")
        pattern = F.array_sort(F.array_intersect(F.coalesce("sources", F.array().cast("array<string>")), listed))
        self.docs = scratch.keep(docs.select("doc_id", pattern.alias("pattern"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).where(F.size("pattern") > 0))
        by_pattern = self.docs.groupBy("pattern").agg(F.sum("n_tokens").alias("n"))
        if len(self.targets) > 16 and (found := by_pattern.count()) > MOST_PATTERNS:  # 16 sources have fewer patterns at most
            raise ValueError(f"{found} membership patterns: merge sources that always overlap, the flow takes {MOST_PATTERNS}")
        self.patterns = {tuple(r["pattern"]): r["n"] for r in by_pattern.collect()}
        self.total = sum(self.patterns.values())
        self.quotas = {s: ceil(share * self.total) for s, (share, _) in self.targets.items()}
        self.flow = min_cost_flow(self.patterns, self.quotas, {s: r for s, (_, r) in self.targets.items()})

    def reached(self) -> dict[str, int]:
        got = dict.fromkeys(self.targets, 0)
        for (_, s), n in self.flow.items():
            got[s] += n
        return got

    def short(self) -> DataFrame:
        """(source) whose documents can't fill its share within their repetitions."""
        got = self.reached()
        return self.spark.createDataFrame([(s,) for s in sorted(self.targets) if got[s] < self.quotas[s]], "source string")

    def selection(self) -> DataFrame:
        """(doc_id, source, repeats, n_tokens) of every document used.

        Of a pattern's flow to a source, whole passes use every document. The rest is the first documents in seeded order as
        far as they fit; then, over and over, the first of the others that are no longer than the gap, until none fits.
        """
        spark, keys = self.spark, ["pattern", "source"]
        plan = [(list(p), s, n // self.patterns[p], n % self.patterns[p]) for (p, s), n in sorted(self.flow.items())]
        # a row for each pattern and source with flow: as small as the aggregate that was on the driver already
        plan = F.broadcast(spark.createDataFrame(plan, "pattern array<string>, source string, passes bigint, gap bigint"))
        dealt = self.docs.withColumn("h", F.xxhash64("doc_id", F.lit(self.seed))).withColumn("bucket", F.pmod("h", F.lit(max(LEAST_BUCKETS, rows_of(self.docs) // BUCKET_DOCS))))
        rows, done = dealt.join(plan, "pattern"), []
        while True:
            tried = self.scratch.keep(_first_that_fit(rows))
            gaps = tried.groupBy(*keys).agg((F.first("gap") - F.coalesce(F.sum(F.when(F.col("part"), F.col("n_tokens"))), F.lit(0))).alias("gap"))
            gaps = [tuple(r) for r in gaps.collect()]  # a row for each pattern and source at most
            left = tried.where("not part").drop("gap", "part").join(F.broadcast(spark.createDataFrame(gaps, "pattern array<string>, source string, gap bigint")), keys)
            fits = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= F.col("gap"))
            done += [tried.where("part").withColumn("repeats", F.col("passes") + 1), left.where(~fits).withColumn("repeats", F.col("passes"))]
            rows = left.where(fits)
            if rows.isEmpty():
                break
        out = reduce(DataFrame.unionByName, [d.select("doc_id", "source", F.col("repeats").cast("int").alias("repeats"), "n_tokens") for d in done])
        return out.where("repeats > 0")

    def shares(self) -> DataFrame:
        """(source, target_share, n_available, n_quota, falls_short, n_reached, n_missing, selection_short, reached_share).

        ``falls_short`` says that the repetitions can't fill the quota; ``selection_short`` that the documents really selected
        don't, if only as none of the others fits into the ``n_missing`` tokens left.
        """
        got = self.selection().groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens")).alias("n_reached"))
        flow = self.reached()
        has = {s: sum(n for p, n in self.patterns.items() if s in p) for s in self.targets}
        rows = [(s, float(self.targets[s][0]), has[s], self.quotas[s], flow[s] < self.quotas[s]) for s in sorted(self.targets)]
        left = self.spark.createDataFrame(rows, "source string, target_share double, n_available bigint, n_quota bigint, falls_short boolean")
        out = left.join(got, "source", "left").withColumn("n_reached", F.coalesce("n_reached", F.lit(0)))
        missing = F.greatest(F.col("n_quota") - F.col("n_reached"), F.lit(0))
        out = out.withColumn("n_missing", missing).withColumn("selection_short", F.col("n_missing") > 0)
        # a row for each target: the window over all of them is as small as that table
        return out.withColumn("reached_share", F.round(F.col("n_reached") / F.sum("n_reached").over(Window.partitionBy()), 6))


def documents_mixture(spark: SparkSession, sf_dir: str, scratch: Scratch, tokenizer: str = DEFAULT_TOKENIZER) -> Mixture:
    targets = table(spark, sf_dir, "mixture_targets")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", read_label("source").alias("source"))
    counted = encode_documents(docs, scratch, tokenizer, keep=("doc_id", "source"), counts_only=True)
    return Mixture(counted.select("doc_id", F.when(F.col("source").isNotNull(), F.array("source")).alias("sources"), "n_tokens"), targets.withColumn("source", read_label("source")), scratch)


def texts_mixture(spark: SparkSession, sf_dir: str, scratch: Scratch, tokenizer: str = DEFAULT_TOKENIZER) -> Mixture:
    """The same over distinct texts: one belongs to every source that has a copy of it, so sources overlap."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("text", "doc_id", read_label("source").alias("source"))
    texts = rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.collect_set("source").alias("sources"))  # at most one entry a source
    counted = encode_documents(scratch.keep(texts), scratch, tokenizer, keep=("doc_id", "sources"), counts_only=True)
    targets = table(spark, sf_dir, "mixture_targets").withColumn("source", read_label("source"))
    return Mixture(counted, targets, scratch)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_mixture(spark, sf_dir, Scratch(spark, "p7")).short()


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_mixture(spark, sf_dir, Scratch(spark, "p7m")).selection()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_mixture(spark, sf_dir, Scratch(spark, "p7s")).shares()


def p7_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that distinct texts reach, each text open to all sources that have a copy."""
    return texts_mixture(spark, sf_dir, Scratch(spark, "p7o")).shares()


def audit(mixture: Mixture) -> DataFrame:
    """(source, target_share, n_over_cap, n_foreign, n_beyond): documents used too often or by a source they don't belong to, and tokens beyond the quota."""
    scratch, spark = mixture.scratch, mixture.spark
    used = scratch.keep(mixture.selection())
    rows = [(s, float(share), cap, mixture.quotas[s]) for s, (share, cap) in sorted(mixture.targets.items())]
    targets = spark.createDataFrame(rows, "source string, target_share double, cap int, quota bigint")
    owners = mixture.docs.select("doc_id", F.explode("pattern").alias("source")).distinct().withColumn("own", F.lit(1))
    per = used.join(owners, ["doc_id", "source"], "left").join(F.broadcast(targets.select("source", "cap")), "source")  # a row a target
    per = per.groupBy("source").agg(F.count_if(F.col("repeats") > F.col("cap")).alias("o"), F.count_if(F.col("own").isNull()).alias("f"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("t"))
    none = F.lit(0)
    return targets.join(per, "source", "left").select("source", "target_share", F.coalesce("o", none).alias("n_over_cap"), F.coalesce("f", none).alias("n_foreign"), F.greatest(F.coalesce("t", none) - F.col("quota"), none).alias("n_beyond"))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents_mixture(spark, sf_dir, Scratch(spark, "p7a")))
