"""Mixing sources to target weights by Sainte-Lague apportionment (operator 2).

Words are the tokens. Targets come from the weights by water-filling (see ``targets``). They are met in equal
blocks of words: the mix has total / block seats; sources get them by highest quotients (votes / (2 k + 1)),
then a source's words go to its shards the same way. No party gets more than ``limit`` times its words: its last
block is cut there, and what is cut goes on to the others (see ``allot``). Shards hold documents by a seeded hash,
sized so that one has a bounded number of words and rows; a level of about ``FAN`` shard groups or more lies
between. Within (shard, source) documents stand in seeded order as a line of words, of which are taken whole
passes over the line and then seeded passages of ``PASSAGE`` blocks of it, cut at document edges only. A hot
source is spread over all shards, and so are rows that repeat each other, which are numbered; every choice
depends on seed and content only, so reruns agree.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, words

WEIGHTS, SHARE, LIMIT = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK, SEED = 16, 17
#: Blocks that are taken together where a line of words isn't taken whole, so that what is cut out is a readable passage.
PASSAGE = 16
#: What a shard should hold, and how many shards an apportionment may see.
SHARD_WORDS, SHARD_ROWS, FAN = 100_000, 1_000, 1_024
#: Sources get weights one by one, so there are few; above this the mix is refused.
MOST_SOURCES = 100_000


def allot(votes: np.ndarray, most: np.ndarray, words_wanted: int, block: int) -> np.ndarray:
    """Words of each party, as many as wanted if all may hold so many.

    Blocks go by highest quotients votes / (2 k + 1), ties to the earlier party. A party's last block ends at ``most``
    words, after which it gets no more; the very last block is cut to what is still wanted.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    most = np.where(votes > 0, most, 0)
    top, want = -(-most // block), min(int(words_wanted), int(most.sum()))
    if want <= 0:
        return np.zeros(len(votes), np.int64)
    # a divisor at which no more words than wanted are given; the rest goes block by block
    give = lambda d: np.minimum(np.floor(votes / d + 0.5), top).astype(np.int64)
    lo, hi = 0.0, 2 * votes.max() + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if np.minimum(give(mid) * block, most).sum() > want:
            lo = mid
        else:
            hi = mid
    seats = give(hi)
    out = np.minimum(seats * block, most)
    rest = want - int(out.sum())
    heap = [(-votes[i] / (2 * seats[i] + 1), i) for i in np.flatnonzero(seats < top).tolist()] if rest else []
    heapq.heapify(heap)
    while rest:
        _, i = heap[0]
        more = min(block, int(most[i] - out[i]), rest)
        out[i] += more
        seats[i] += 1
        rest -= more
        if out[i] < most[i]:
            heapq.heapreplace(heap, (-votes[i] / (2 * seats[i] + 1), i))
        else:
            heapq.heappop(heap)
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats of each party by highest quotients votes / (2 k + 1); ties go to the earlier party."""
    return allot(votes, np.full(len(votes), max(seats, 0)), seats, 1)


def targets(sizes: np.ndarray, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> np.ndarray:
    """``share`` of all words split by weight (repeating by position); what lies above ``limit`` times a size is reshared."""
    sizes = np.asarray(sizes, float)
    w = np.resize(np.array(weights, float), len(sizes))
    out, free, rest = np.zeros(len(sizes)), sizes > 0, share * sizes.sum()
    while free.any():
        want = np.where(free, rest * w / w[free].sum(), 0)
        over = free & (want > limit * sizes)
        if not over.any():
            out[free] = want[free]
            break
        out[over] = limit * sizes[over]
        rest -= out[over].sum()
        free &= ~over
    return out


SIZED = "doc_id long, source string, size long, row long"


def _key() -> F.Column:
    """What tells documents of one doc_id apart: their content."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text) and a content key, from one pass."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    out = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.chunks(batches, size=1 << 20):
            data, bounds = words.raw(part.column(1))
            starts, _ = words.runs(data, bounds, words.SPACES)
            yield common.batch_of(out, part.column(0), part.column(2), np.diff(np.searchsorted(starts, bounds)), part.column(3))

    return common.table(common.texts(docs, source.alias("source"), _key().alias("row")).mapInArrow(run, SIZED), "sizes")


def _split(pdf: pd.DataFrame, key: str, block: int) -> pd.DataFrame:
    """Words of one parent to its children, in the order of ``key``."""
    pdf = pdf.sort_values(key, kind="stable")
    return pdf.assign(words=allot(pdf["size"].to_numpy(), pdf["most"].to_numpy(), int(pdf["parent_words"].iloc[0]), block))


def _take(pdf: pd.DataFrame, block: int, seed: int) -> tuple[int, np.ndarray, list[list[tuple[int, int]]]]:
    """Whole passes over the documents of one (shard, source), which come in seeded order, and the word ranges [a, b) of each that a last pass takes."""
    size = pdf["size"].to_numpy(np.int64)
    total = int(size.sum())
    passes, rest = divmod(int(pdf["words"].iloc[0]), total) if total else (0, 0)
    edge = np.concatenate([[0], np.cumsum(size)])
    extra, ranges = np.zeros(len(size), np.int64), [[] for _ in size]
    if rest:
        n = -(-total // block)
        key = int(pdf["source_key"].iloc[0]) & (1 << 62) - 1
        order = np.random.default_rng([seed, int(pdf["shard"].iloc[0]), key]).permutation(n)
        lens = np.minimum(block, total - order * block)
        m = int(np.searchsorted(np.cumsum(lens), rest)) + 1
        order, lens = order[:m], lens[:m]
        lens[-1] -= int(lens.sum()) - rest
        at = np.argsort(order)
        lo = order[at] * block
        hi = lo + lens[at]
        # cut the line at block and document edges: each segment lies in one document, and in one block or none
        cuts = np.unique(np.concatenate([edge, lo, hi]))
        a, b = cuts[:-1], cuts[1:]
        i = np.searchsorted(lo, a, "right") - 1
        inside = (i >= 0) & (a < hi[np.maximum(i, 0)])
        a, b = a[inside], b[inside]
        doc = np.searchsorted(edge, a, "right") - 1
        np.add.at(extra, doc, b - a)
        for d, x, y in zip(doc.tolist(), (a - edge[doc]).tolist(), (b - edge[doc]).tolist(), strict=True):
            if ranges[d] and ranges[d][-1][1] == x:
                ranges[d][-1] = (ranges[d][-1][0], y)
            else:
                ranges[d].append((x, y))
    return passes, passes * size + extra, ranges


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target and taken of each document, ``row`` (a content key), and how it is taken: ``passes`` whole times and once in ``ranges`` of words.

    Null source is a source of its own (last); null and empty texts have size 0 and nothing taken; repeated
    rows are documents of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = sized(docs)
    sources = [(r["source"], r["size"], r["rows"]) for r in table.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()]
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources.sort(key=lambda s: (s[0] is None, s[0] or ""))
    size = np.array([s[1] for s in sources], np.int64)
    goal = targets(size, weights, share, limit)
    allowed = allot(goal, np.floor(limit * size), round(goal.sum()), block)
    n_shards = max(1, math.ceil(int(size.sum()) / SHARD_WORDS), math.ceil(sum(s[2] for s in sources) / SHARD_ROWS))
    groups = max(1, math.ceil(n_shards / FAN))
    plan = spark.createDataFrame([(s[0], int(n), float(g), int(q)) for s, n, g, q in zip(sources, size, goal, allowed, strict=True)], "source string, source_size long, target double, source_words long")
    plan = F.broadcast(plan)  # at most MOST_SOURCES rows

    numbered = table.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("copies")).select("doc_id", "source", "size", "row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row", "copy"), F.lit(n_shards)).cast("long")
    spread = numbered.withColumn("shard", shard).withColumn("source_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    per_shard = spread.groupBy("source_key", "shard").agg(F.sum("size").alias("size"), F.first("source").alias("source"))
    joined = per_shard.join(plan, per_shard["source"].eqNullSafe(plan["source"])).select("source_key", "shard", "size", F.floor(F.lit(float(limit)) * F.col("size")).alias("most"), "source_words")
    by_group = joined.withColumn("group", F.col("shard") % groups).groupBy("source_key", "group").agg(F.sum("size").alias("size"), F.sum("most").alias("most"), F.first("source_words").alias("parent_words"))
    split_groups = by_group.groupBy("source_key").applyInPandas(lambda pdf: _split(pdf, "group", block)[["source_key", "group", "words"]], "source_key long, group long, words long")
    leaves = joined.withColumn("group", F.col("shard") % groups).join(split_groups.withColumnRenamed("words", "parent_words"), ["source_key", "group"])
    quotas = leaves.groupBy("source_key", "group").applyInPandas(lambda pdf: _split(pdf, "shard", block)[["source_key", "shard", "words"]], "source_key long, shard long, words long")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "doc_id", "row", "size"], kind="stable")
        passes, pdf["taken"], ranges = _take(pdf, PASSAGE * block, seed)
        pdf["passes"], pdf["ranges"] = passes, [[{"a": a, "b": b} for a, b in r] for r in ranges]
        return pdf[["doc_id", "row", "source", "size", "taken", "passes", "ranges"]]

    lines = spread.withColumn("place", F.xxhash64(F.lit(seed + 1), "row", "doc_id")).join(quotas, ["source_key", "shard"])
    chosen = lines.groupBy("source_key", "shard").applyInPandas(choose, "doc_id long, row long, source string, size long, taken long, passes int, ranges array<struct<a:long,b:long>>")
    return chosen.join(plan, chosen["source"].eqNullSafe(plan["source"])).select("doc_id", "row", chosen["source"], "size", "source_size", "target", "taken", "passes", "ranges")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents, columns unchanged: a row per whole pass, and one with the words of the last pass; ``n_chars`` follows.

    Documents are told apart by doc_id, source and text, and rows that repeat all of them by a number, so each is
    taken once. Documents of which nothing is taken go.
    """
    kind = "array<struct<a:long,b:long>>"
    parts = F.concat(F.array_repeat(F.lit(None).cast(kind), F.col("passes")), F.filter(F.array("ranges"), lambda r: F.size(r) > 0))
    chosen = mix(docs).filter("taken > 0").select(F.col("doc_id").alias("id"), F.col("row").alias("key"), F.col("source").alias("of"), parts.alias("parts"))
    chosen = common.table(chosen, "chosen")
    key, names = F.xxhash64(F.coalesce(docs["text"], F.lit(""))), ["id", "key", "of"]
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*(docs[c].alias(f"doc_{i}") for i, c in enumerate(docs.columns)), docs["doc_id"].cast("long").alias("row_id"), key.alias("row_key"), source.alias("row_of"))
    same = rows["row_id"].eqNullSafe(chosen["id"]) & (rows["row_key"] == chosen["key"]) & rows["row_of"].eqNullSafe(chosen["of"])
    if not chosen.groupBy(*names).count().filter("count > 1").isEmpty():
        chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy(*names).orderBy("parts")))
        rows = rows.withColumn("row_n", F.row_number().over(Window.partitionBy("row_id", "row_key", "row_of").orderBy("row_key")))
        same = rows["row_id"].eqNullSafe(chosen["id"]) & (rows["row_key"] == chosen["key"]) & rows["row_of"].eqNullSafe(chosen["of"]) & (rows["row_n"] == chosen["n"])
    taken = "part"
    while taken in docs.columns:
        taken += "_"
    rows = rows.join(chosen, same).select(*(F.col(f"doc_{i}").alias(c) for i, c in enumerate(docs.columns)), F.explode("parts").alias(taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        for batch in common.chunks(batches):
            names = batch.schema.names[:-1]
            texts = batch.column(at := names.index("text")).to_pylist()
            for i, part in enumerate(batch.column(len(names)).to_pylist()):
                if part is not None:
                    spans = [m.span() for m in _WORD.finditer(texts[i])]
                    texts[i] = "\n".join(texts[i][spans[r["a"]][0] : spans[r["b"] - 1][1]] for r in part)
            columns, fields = list(batch.columns[:-1]), list(batch.schema)[:-1]
            columns[at] = pa.array(texts, fields[at].type)
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pa.array([len(t) for t in texts], pa.int64()).cast(fields[n].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return rows.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
