"""Source divergence audit: how the sources of a language differ in their words (operator 13).

Per language and source each kept term has a smoothed share p of N words: p = 1 + (10^9 * (count + 5)) div (N + 5 V), exact in
integers. A pair of sources starts at V times the difference of their zero-count shares. What differs from that comes from an
inverted index: a term's posting list holds the sources with a count, and only these correct the pairs. A correction has a part
that one source makes against any other's zero share, summed once per source from its counts in order of p (a running sum read
at each other source's zero share), and a part that only pairs inside a posting list make; tasks sum the latter per pair before the
shuffle. So no pair is touched for a term that neither source has.

Defined cases: null text, lang and source are ''. Every (lang, source) that occurs is a group, even without terms. V = 0: pairs have
value 0 and there are no term rows. Ties in rank go by UTF-8 bytes of the item. Repeated rows count as often as they occur; doc_id
isn't read. An empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LEAST_DOCS, PRIOR, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Distinct (lang, source, term) a task holds before it hands them on, and pairs it buffers before it sums them.
HELD, PAIRS = 300_000, 1 << 20

#: Bytes of terms: letters (lower-cased) and everything beyond ASCII; the rest separates.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's occurrences and documents of each term in each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def take() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            words = list(n)
            for i in range(0, len(words), 1 << 16):
                part = words[i : i + (1 << 16)]
                yield common.batch_of(_COUNTS, pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), [n[w] for w in part], [docs[w] for w in part])
        held.clear()

    for part in common.chunks(batches):
        for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
            words = terms(text.as_py())
            if words:
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(words)
                docs.update(set(words))
                size += len(n) - before
        if size > HELD:
            yield from take()
            size = 0
    yield from take()


class _Pairs:
    """Sums over posting lists of what only two sources with counts give a pair, by (lower number, higher number)."""

    def __init__(self, lang: str):
        self.lang, self.keys, self.values, self.held, self.distinct = lang, [], [], 0, 0

    def add(self, at: np.ndarray, p: np.ndarray, z: np.ndarray) -> None:
        """One term: sources' numbers (ascending), shares, zero shares."""
        for i in range(len(at) - 1) if len(at) > 256 else (None,):
            a, b = np.triu_indices(len(at), 1) if i is None else (np.full(len(at) - 1 - i, i), np.arange(i + 1, len(at)))
            value = np.abs(p[a] - p[b]) + np.abs(z[a] - z[b]) - np.abs(p[a] - z[b]) - np.abs(p[b] - z[a])
            some = value != 0
            self.keys.append((at[a[some]] << 32) | at[b[some]])
            self.values.append(value[some])
            self.held += int(some.sum())
            if self.held > max(PAIRS, 2 * self.distinct):
                self.sum()

    def sum(self) -> None:
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, where, np.concatenate(self.values))
        self.keys, self.values = [keys], [sums]
        self.held = self.distinct = len(keys)

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            self.sum()
            keys, sums = self.keys[0], self.values[0]
            for i in range(0, len(keys), 1 << 16):
                k, v = keys[i : i + (1 << 16)], sums[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(k), pa.string()), pa.array(k >> 32), pa.array(k & 0xFFFFFFFF), pa.array(v)], names=["lang", "s", "t", "both"])
        self.keys, self.values, self.held, self.distinct = [], [], 0, 0


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings (lang, term, at, p, z) sorted by the first three: sums per pair."""
    now, pairs = None, None
    lists: list[np.ndarray] = []

    def close() -> None:
        at, p, z = (np.concatenate(c) for c in zip(*lists, strict=True))
        pairs.add(at, p, z)

    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        numbers = [b.column(i).to_numpy() for i in (2, 3, 4)]
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[lo] != now:
                if lists:
                    close()
                    lists = []
                    if pairs.distinct > PAIRS // 2:
                        yield from pairs.take()
                if now is None or keys[lo][0] != now[0]:
                    if pairs is not None:
                        yield from pairs.take()
                    pairs = _Pairs(keys[lo][0])
                now = keys[lo]
            lists.append([c[lo:hi] for c in numbers])
    if lists:
        close()
        yield from pairs.take()


def share(count: str, total: str, v: str = "v") -> Column:
    """1 + (10^9 * (count + 5)) div (N + 5 V) in decimals, so nothing is rounded or overflows."""
    return F.expr(f"cast(1 + (cast({UNIT} as decimal(20,0)) * cast({count} + {PRIOR} as decimal(18,0))) div (cast({total} as decimal(20,0)) + {PRIOR} * cast({v} as decimal(18,0))) as bigint)")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for each other source of the language, part ``term`` for the ``top`` terms a source has more of than its language."""
    common.ship(docs.sparkSession)
    rows = docs.select(_text("lang"), _text("source"), _text("text"))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")
    one = F.row_number().over(word.orderBy("source")) == 1
    kept = counts.withColumns({"all_docs": F.sum("docs").over(word), "all_n": F.sum("n").over(word), "first": one})
    kept = common.table(kept.filter(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "all_n", "first"), "postings", "zstd")

    # groups, numbered inside their language, with N, the language's N, V and the zero share
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("v"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    lang = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = groups.select(
        "lang", "source", zero(F.col("total")).alias("total"), zero(F.sum("total").over(lang)).alias("lang_total"), zero(F.sum("v").over(lang)).alias("v"),
        (F.row_number().over(lang.orderBy("source")) - 1).cast("long").alias("at"),
    )
    groups = common.table(groups.withColumn("z", F.when(F.col("v") > 0, share("0", "total")).otherwise(F.lit(0))), "groups")

    index = common.attach(kept, groups, ["lang", "source"]).withColumn("p", share("n", "total"))
    above = index.withColumn("value", F.col("p") - share("all_n", "lang_total")).filter("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    words = ranked(above).filter(F.col("rank") <= top)

    # inside posting lists
    lists = index.select("lang", "term", "at", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "at")
    inside = lists.mapInArrow(_both, "lang string, s long, t long, both long").groupBy("lang", "s", "t").agg(F.sum("both").alias("both"))
    inside = inside.select("lang", F.explode(F.array(F.struct("s", "t"), F.struct(F.col("t").alias("s"), F.col("s").alias("t")))).alias("e"), "both").select("lang", "e.*", "both")

    # each source against the others' zero shares: terms below such a share in order of p
    a, b = groups.alias("a"), groups.alias("b")
    asked = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.at") != F.col("b.at")))
    asked = asked.select("a.lang", F.col("a.at").alias("s"), F.col("b.at").alias("t"), F.col("b.z").alias("x"), F.lit(0).cast("long").alias("n"))
    steps = index.groupBy("lang", F.col("at").alias("s"), F.col("p").alias("x")).agg(F.count(F.lit(1)).alias("n")).select("lang", "s", F.lit(None).cast("long").alias("t"), "x", "n")
    up = Window.partitionBy("lang", "s").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("lang", "s")
    mass = F.col("n") * F.col("x")
    run = asked.unionByName(steps).withColumns({"below": F.sum("n").over(up), "mass": F.sum(mass).over(up), "all": F.sum("n").over(whole), "all_mass": F.sum(mass).over(whole)})
    # sum of |p - x| over the source's terms
    far = (F.col("x") * F.col("below") - F.col("mass")) + (F.col("all_mass") - F.col("mass")) - F.col("x") * (F.col("all") - F.col("below"))
    run = run.filter("t is not null").select("lang", "s", "t", far.alias("far"), F.col("all").alias("mine"))
    back = run.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), F.col("far").alias("far_back"), F.col("mine").alias("theirs"))
    pairs = run.join(back, ["lang", "s", "t"]).join(inside, ["lang", "s", "t"], "left")
    side = lambda n, at, source: groups.select("lang", F.col("at").alias(n), F.col("source").alias(source), F.col("z").alias(f"z_{n}"), *(["v"] if n == "s" else []))
    pairs = common.attach(common.attach(pairs, side("s", "at", "source"), ["lang", "s"]), side("t", "at", "item"), ["lang", "t"])
    base = F.abs(F.col("z_s") - F.col("z_t"))
    value = F.col("v") * base + (F.col("far") - F.col("mine") * base) + (F.col("far_back") - F.col("theirs") * base) + F.coalesce("both", F.lit(0))
    others = ranked(pairs.select("lang", "source", "item", value.alias("value")))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return out(others, "pair").unionByName(out(words, "term"))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


ORACLE = r"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') txt from documents),
w as materialized (select id, lang, source, unnest(regexp_extract_all(translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as materialized (select lang, term from w group by all having count(distinct id) >= 30),
g as (select distinct lang, source from d),
v as (select l.lang, count(kept.term) v from (select distinct lang from d) l left join kept on kept.lang = l.lang group by l.lang),
c as materialized (select g.lang, g.source, kept.term, count(w.term)::hugeint n from g join kept on kept.lang = g.lang left join w on w.lang = g.lang and w.source = g.source and w.term = kept.term group by all),
s as materialized (select lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) p,
  1 + (1000000000 * (sum(n) over (partition by lang, term) + 5)) // (sum(n) over (partition by lang) + 5 * v) q from c join v using (lang)),
pair as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) val from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(val, 0) val from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
rows as (select * from pairs union all select lang, source, 'term', term, p - q from s where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by val desc, item) k from rows)
select lang, source, part, item, cast(val as bigint) as "value", cast(k as integer) as "rank" from r where part = 'pair' or k <= 50
"""
