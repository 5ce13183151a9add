"""Problem 7: a mixture of sources in target shares of the total size in tokens.

Method: min-cost flow for overlapping sources. Equal texts are one text, a member of every
source it occurs in; texts are aggregated by membership pattern (the set of their sources that
have a target). A flow network routes the patterns' token capacity to the sources' quotas: each
further use of a pattern's texts is one more arc of the same capacity and of rising cost, so
repetition is taken only where it is needed and spread evenly. The largest total whose quotas
can all be filled is the size of the mixture, unless a smaller one is asked for.

The flow fixes how many tokens of each pattern go to each source. Its texts stand on a line in
an order drawn by a seed, the line is walked once for each use, and every source gets a stretch
of it; running sums are taken within buckets of the order and over buckets, so no task sees a
whole pattern.

A text may be used in the name of each source as often as that source's `max_repeats`, and as often
as the largest of them altogether. There are at most `MOST_SOURCES` sources with a target, so the
membership patterns, whose number is bounded by two to that power, fit the driver.

Sources without a target, and texts without a source or without tokens, are left out; targets
without texts get nothing and the other shares are scaled up (`wanted_share`); a null or negative target
or repeat count leaves the source out. Repeated targets of a source count once, the largest.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.llm.p6_tokens import encoder, tokenizer_dir
from quireflow.operators.lineage import saved
from quireflow.sources.tables import table

TOKENIZER, SEED, PER_BUCKET, MOST_SOURCES = "byte_bpe_50k", 42, 20_000, 14


class Flow:
    """Min-cost flow by shortest augmenting paths; arcs are (to, capacity left, cost, reverse)."""

    def __init__(self, nodes: int):
        self.arcs: list[list[list]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> list:
        there, back = [b, capacity, cost, None], [a, 0, -cost, None]
        there[3], back[3] = back, there
        self.arcs[a].append(there)
        self.arcs[b].append(back)
        return there

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            far: list[float] = [math.inf] * len(self.arcs)
            via: list[list | None] = [None] * len(self.arcs)
            far[source], queue, waiting = 0, deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for arc in self.arcs[a]:
                    if arc[1] > 0 and far[a] + arc[2] < far[arc[0]]:
                        far[arc[0]], via[arc[0]] = far[a] + arc[2], arc
                        if arc[0] not in waiting:
                            waiting.add(arc[0])
                            queue.append(arc[0])
            if via[sink] is None:
                return total
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = via[at][3][0]
            push = min(x[1] for x in path)
            for x in path:
                x[1] -= push
                x[3][1] += push
            total += push


def route(capacity: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], size: int | None = None) -> tuple[int, dict[str, int], dict[tuple[str, ...], dict[str, int]]]:
    """(the largest total whose quotas can be filled, or `size`; quota by source; tokens by pattern and source). At most 2^MOST_SOURCES patterns."""
    patterns = sorted(p for p in capacity if capacity[p] > 0)
    sources = sorted({s for p in patterns for s in p if targets[s][0] > 0})
    if not sources:
        return 0, {}, {}
    share = {s: targets[s][0] / sum(targets[x][0] for x in sources) for s in sources}
    uses = {p: max(targets[s][1] for s in p) for p in patterns}

    def solve(total: int) -> tuple[bool, dict]:
        quota = {s: int(share[s] * total) for s in sources}
        net = Flow(2 + len(patterns) + len(sources))
        place = {s: 2 + len(patterns) + k for k, s in enumerate(sources)}
        for s in sources:
            net.arc(place[s], 1, quota[s])
        arcs = {}
        for k, p in enumerate(patterns):
            for again in range(uses[p]):
                net.arc(0, 2 + k, capacity[p], again)
            for s in p:
                if s in place:
                    arcs[p, s] = net.arc(2 + k, place[s], capacity[p] * targets[s][1])
        return net.run(0, 1) == sum(quota.values()), {key: a[3][1] for key, a in arcs.items()}

    high = sum(capacity[p] * uses[p] for p in patterns)
    if size is not None:
        high = min(high, size)
    low = 0
    if solve(high)[0]:
        low = high
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if solve(middle)[0] else (low, middle - 1)
    flows: dict[tuple[str, ...], dict[str, int]] = {}
    for (p, s), n in solve(low)[1].items():
        if n:
            flows.setdefault(p, {})[s] = n
    return low, {s: int(share[s] * low) for s in sources}, flows


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Source to (share, uses). The table has one row for each source of a mixture."""
    rows = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).collect()
    return {r.source: (float(r.t[0]), int(r.t[1])) for r in rows}


def texts_of(documents: DataFrame, sources: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, pattern, docs MAP<source, doc_id>, tokens) of each different text; texts themselves are never shuffled."""
    folder = tokenizer_dir()
    kept = documents.where(F.col("source").isin(sources) & F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull())
    rows = kept.select("doc_id", "source", F.sha2("text", 256).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer, folder).count
        for batch in batches:
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array([count(t) for t in batch.column(3).to_pylist()], pa.int64())], names=["doc_id", "source", "key", "tokens"])

    sized = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, source string, key string, tokens long").where("tokens > 0")
    per = sized.groupBy("key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    # A text has no more entries than there are sources with a target.
    docs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "doc_id")))).alias("docs")
    return per.groupBy("key").agg(docs, F.max("tokens").alias("tokens")).select("key", F.array_join(F.map_keys("docs"), "\x1f").alias("pattern"), "docs", "tokens")


def mixture(documents: DataFrame, targets: DataFrame, size: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> tuple[DataFrame, dict]:
    """((doc_id, source, uses, tokens) of the texts used, {total, quota, targets}). `doc_id` is the first copy in that source."""
    spark = documents.sparkSession
    wanted = read_targets(targets)
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"{len(wanted)} sources have a target, at most {MOST_SOURCES} can be mixed at once")
    texts = saved(texts_of(documents, sorted(wanted), tokenizer))
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("n"), F.count("*").alias("texts")).collect()
    capacity = {tuple(r.pattern.split("\x1f")): r.n for r in sums}
    total, quota, flows = route(capacity, wanted, size)
    plan = []
    for p, by in flows.items():
        at, stops = 0, []
        for s in sorted(by):
            at += by[s]
            stops.append((s, at))
        plan.append(("\x1f".join(p), capacity[p], math.ceil(at / capacity[p]), stops))
    routes = spark.createDataFrame(plan, "pattern string, capacity long, turns int, stops array<struct<source:string, stop:long>>")
    buckets = max(16, sum(r.texts for r in sums) // PER_BUCKET)
    # At most 2^sources rows, and the sources with a target are a fixed few.
    drawn = texts.join(F.broadcast(routes), "pattern").withColumn("h", F.xxhash64("key", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = drawn.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    before = before.withColumn("start", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.join(before, ["pattern", "bucket"]).withColumn("at", F.coalesce("start", F.lit(0)) + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    # Each turn puts the middle of the text at one place of the line; the stretch it falls in is its source.
    turns = F.expr("transform(sequence(0, turns - 1), j -> get(filter(stops, s -> j * capacity + at + tokens / 2 < s.stop), 0).source)")
    used = placed.select("docs", "tokens", F.explode(turns).alias("source")).where("source IS NOT NULL")
    out = used.select(F.element_at("docs", F.col("source")).alias("doc_id"), "source", "tokens").groupBy("doc_id", "source").agg(F.count("*").cast("int").alias("uses"), F.max("tokens").alias("tokens"))
    return out, {"total": total, "quota": quota, "targets": wanted}


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached: one row for each source with a target."""
    targets = table(spark, sf_dir, "mix_targets")
    used, plan = mixture(table(spark, sf_dir, "documents"), targets)
    by = used.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    wanted = spark.createDataFrame([(s, t[0], t[1], plan["quota"].get(s, 0), plan["quota"].get(s, 0) / max(plan["total"], 1)) for s, t in sorted(plan["targets"].items())], "source string, target_share double, max_repeats int, quota_tokens long, wanted_share double")
    both = wanted.join(by, "source", "left").na.fill(0, ["tokens", "texts", "most_uses"])
    total = both.agg(F.sum("tokens").alias("_all"))
    return both.crossJoin(F.broadcast(total)).select(*both.columns, (F.col("tokens") / F.greatest("_all", F.lit(1))).alias("reached_share"))


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
