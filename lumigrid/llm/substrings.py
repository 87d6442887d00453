"""Exact substring deduplication by threshold-bounded interval expansion (operator 3).

Every byte covered by a ``LENGTH``-byte string that also starts earlier goes. One Burrows-Wheeler transform of a
whole corpus can't be built on one machine, so windows of ``LENGTH`` bytes are first brought together by content:

1. Consecutive windows with the same smallest hash of a ``SEED_BYTES``-byte substring (their anchor) form a run.
   Equal windows have equal anchors. A run is sent on as (anchor, content hash, doc, key, start); each chunk keeps the
   earliest of equal runs, so a text copied a million times costs one row a chunk.
2. Sorted by anchor and content, all runs but the earliest of equal ones are wholly repeated. An anchor with one
   content is settled. An anchor with several contents is open: its earliest runs may share part of their windows.
3. Open runs get their bytes and meet in buckets of about ``BUCKET`` bytes by anchor. A bucket's transform is
   expanded breadth-first: from the intervals of strings of length l, backward extension gives those of length
   l + 1, so common prefixes come by increasing value, and the expansion stops at ``LENGTH``. Suffixes still in
   one interval share a window; all but the earliest are repeated.
4. An anchor with more than ``HOT`` bytes of open runs doesn't fit a bucket. Its windows go by their own hash
   through steps 1 and 2, which settle it exactly and combine equal windows in each chunk.

Spans then meet their texts by document: doc_id and a hash of the text (``key``), since ids may be null or repeated. Anchor keys, contents and spans are shuffled, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

LENGTH, SEED_BYTES = 100, 32
BUCKET, HOT = 1 << 20, 8 << 20
#: Distinct contents of an anchor in one chunk above which its runs are spread by content.
SPREAD = 16
_CHUNK = 2 << 20
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_SALT = np.uint64(0x9E3779B97F4A7C15)


class _Prefix:
    """Polynomial hashes (mod 2**64, over keyed bytes) of any byte range of ``data``."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = np.full(n + 1, _BASE), np.full(n + 1, _BASE_INVERSE)
        up[0] = self.down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(self.down, out=self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words._BYTE_KEYS[data] * up[:-1], out=self.sums[1:])

    def of(self, lo, hi) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]


def runs(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, seed: int = SEED_BYTES) -> tuple[np.ndarray, ...]:
    """Owner, start (in its text), windows, anchor, content hash and inner repetition of the runs of all texts.

    A run whose anchor stands at several places (short periods) may repeat its own windows.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    prefix = _Prefix(data)
    n = len(data) - seed + 1
    least = words.mix((prefix.sums[seed:] - prefix.sums[:-seed]) * prefix.down[:n])
    wide, done, where = length - seed + 1, 1, np.arange(n, dtype=np.int32)
    while done < wide:  # first minimum of ``wide`` seeds by doubling
        step = min(done, wide - done)
        left, right = least[:-step], least[step:]
        where = np.where(right < left, where[step:], where[:-step])
        least = np.minimum(left, right)
        done += step
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(owner)) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    anchor = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(at)))
    lo = at[first]
    content = words.mix(prefix.of(lo, lo + many + length - 1) + many.astype(np.uint64) * _SALT)
    return owner[first], lo - bounds[owner[first]], many, anchor[first], content, where[lo] != where[lo + many - 1]


RUNS = "route long, anchor long, content long, doc long, key long, start int, many int, open boolean"
_RUNS = pa.schema([("route", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("many", pa.int32()), ("open", pa.bool_())])


def _combined(doc, key, start, many, anchor, content, inner, spread: bool) -> pa.RecordBatch:
    """Rows of one chunk: the earliest of equal runs under its route, the others as settled spans (null anchor), joined where they touch."""
    order = np.lexsort((start, key, doc, content, anchor))
    doc, key, start, many, anchor, content, inner = (x[order] for x in (doc, key, start, many, anchor, content, inner))
    new_anchor = np.ones(len(doc), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new = new_anchor.copy()
    new[1:] |= content[1:] != content[:-1]
    # the same place again (a repeated row) is no earlier occurrence
    same = np.zeros(len(doc), bool)
    same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (start[1:] == start[:-1])
    lead = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    twin = (doc == doc[lead][group]) & (key == key[lead][group]) & (start == start[lead][group])
    gone = np.flatnonzero(~new & ~twin & ~same)
    d, k, s, m = doc[gone], key[gone], start[gone], many[gone]
    by = np.lexsort((s, k, d))
    d, k, s, e = d[by], k[by], s[by], (s + m)[by]
    cut = np.ones(len(d), bool)
    cut[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] > e[:-1])
    head = np.flatnonzero(cut)
    tail = np.append(head[1:], len(d)) - 1
    d, k, s, m = d[head], k[head], s[head], (e[tail] - s[head] if len(head) else s[:0])
    a = (np.cumsum(new_anchor) - 1)[lead]
    wide = np.bincount(a)[a] > SPREAD if spread and len(a) else np.zeros(len(lead), bool)
    route = np.where(wide, words.mix(anchor[lead] + content[lead] * _SALT), anchor[lead])
    # two marks with contents of their own tell the anchor's own route that it is open
    mark = lead[np.flatnonzero(wide & np.concatenate([[True], a[1:] != a[:-1]]))] if len(lead) else lead
    i64 = lambda x: x.astype(np.uint64).view(np.int64)
    null = len(d)
    cols = [
        np.concatenate([i64(route), i64(anchor[mark]), i64(anchor[mark]), d]), np.concatenate([i64(anchor[lead]), i64(anchor[mark]), i64(anchor[mark]), np.zeros(null, np.int64)]),
        np.concatenate([i64(content[lead]), np.zeros(len(mark), np.int64), np.ones(len(mark), np.int64), np.zeros(null, np.int64)]), np.concatenate([doc[lead], doc[mark], doc[mark], d]),
        np.concatenate([key[lead], key[mark], key[mark], k]),
        np.concatenate([start[lead], np.full(2 * len(mark), -1), s]).astype(np.int32), np.concatenate([many[lead], np.zeros(2 * len(mark), np.int64), m]).astype(np.int32),
        np.concatenate([wide | inner[lead], np.zeros(2 * len(mark) + null, bool)]),
    ]
    settled = np.concatenate([np.zeros(len(lead) + 2 * len(mark), bool), np.ones(null, bool)])
    return common.batch_of(_RUNS, pa.array(cols[0]), pa.array(cols[1], mask=settled), *cols[2:])


SPANS = "doc long, key long, start int, many int, anchor long"
_SPANS = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("many", pa.int32()), ("anchor", pa.int64())])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (anchor, content, doc, key, start): repeated runs (null anchor) and open ones (with anchor).

    Streams: what is carried over a batch's end is the anchor, the content and its earliest run, and that run
    while it may still turn out to be open.
    """
    last, waiting = None, None  # (anchor, content, doc, key, start) of the last run's leader; a leader not yet known to be open
    for batch in batches:
        if not batch.num_rows:
            continue
        settled = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        if settled.any():
            free = batch.filter(pa.array(settled))
            yield common.batch_of(_SPANS, *free.columns[3:7], pa.nulls(free.num_rows, pa.int64()))
            batch = batch.filter(pa.array(~settled))
            if not batch.num_rows:
                continue
        anchor, content, doc, key, start, many, is_open = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 8))
        new_anchor, new = np.ones(len(doc), bool), np.ones(len(doc), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new[1:] = new_anchor[1:] | (content[1:] != content[:-1])
        if last is not None:
            new_anchor[0] = anchor[0] != last[0]
            new[0] = new_anchor[0] or content[0] != last[1]
        lead = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        lead_doc = np.concatenate([doc[lead], [last[2] if last else 0]])[group]  # group -1: the run carried over
        lead_key = np.concatenate([key[lead], [last[3] if last else 0]])[group]
        lead_start = np.concatenate([start[lead], [last[4] if last else 0]])[group]
        gone = ~new & ~((doc == lead_doc) & (key == lead_key) & (start == lead_start)) & (start >= 0)
        segment = np.cumsum(new_anchor)[lead]  # 0: the anchor carried over
        count = np.bincount(segment, minlength=int(new_anchor.sum()) + 1)
        count[0] += last is not None
        opened = (count[segment] > 1) | is_open[lead]
        if waiting is not None:
            if count[0] > 1:
                yield common.batch_of(_SPANS, *([x] for x in waiting))
                waiting = None
            elif new_anchor.any():
                waiting = None
        rows = lead[opened & (start[lead] >= 0)]
        g = np.flatnonzero(gone)
        if len(g) + len(rows):
            held = pa.array(np.concatenate([np.zeros(len(g), np.int64), anchor[rows]]), mask=np.concatenate([np.ones(len(g), bool), np.zeros(len(rows), bool)]))
            yield common.batch_of(_SPANS, *(np.concatenate([x[g], x[rows]]) for x in (doc, key, start, many)), held)
        if len(lead):
            i = lead[-1]
            last = (anchor[i], content[i], doc[i], key[i], start[i])
            if not opened[-1] and start[i] >= 0:
                waiting = (doc[i], key[i], start[i], many[i], anchor[i])


def _resolved(rows: DataFrame, name: str) -> DataFrame:
    return common.table(rows.repartition("route").sortWithinPartitions("anchor", "content", "doc", "key", "start").mapInArrow(_settle, SPANS), name)


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes at least (bytes past the end: 0)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    known = 8
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
        if known >= depth:
            return order
        # a suffix that ends sorts before any that goes on, which zero padding may not tell apart: no matter for whole windows
        after = np.zeros(n, np.uint64)
        after[: max(n - known, 0)] = rank[known:] + np.uint64(1)
        key = rank * np.uint64(n + 2) + after
        known *= 2


def expand(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each row the interval (a number) of its first ``length`` bytes.

    Breadth-first over string lengths: row j begins an interval of length l + 1 if its first byte differs from the
    row before, or if the rows they extend (the same suffixes without the first byte) lie in different intervals of
    length l. Boundaries therefore appear in the order of the common prefixes' lengths; none is looked for past ``length``.
    """
    order = sort_suffixes(text, length + 1)
    transform = text[order - 1]  # of row 0's suffix: the last byte
    back = np.argsort(transform, kind="stable")  # row j extends row back[j]
    head = np.concatenate([[True], np.diff(transform[back]) != 0])
    interval = np.cumsum(head).astype(np.int32)
    for _ in range(1, length):
        before = interval[back]
        edge = head.copy()
        edge[1:] |= before[1:] != before[:-1]
        new = np.cumsum(edge).astype(np.int32)
        if new[-1] == len(new):
            return order, new
        interval = new
    return order, interval


def repeated_windows(parts: list[bytes], doc: np.ndarray, key: np.ndarray, start: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(part, first window, windows) of the runs of windows that also begin earlier, by (doc, key, start), in these parts."""
    text = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    order, interval = expand(text, length)
    part = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(text) - 1) - bounds[part]
    whole = np.zeros(len(text), bool)
    whole[:-1] = place <= sizes[part] - length
    rows = np.flatnonzero(whole[order])
    at, kind = order[rows], interval[rows]
    d, k, s = doc[part[at]], key[part[at]], start[part[at]] + place[at]
    by = np.lexsort((s, k, d, kind))
    at, kind, d, k, s = at[by], kind[by], d[by], k[by], s[by]
    new = np.concatenate([[True], kind[1:] != kind[:-1]])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = np.sort(at[(d != d[lead]) | (k != k[lead]) | (s != s[lead])])
    if not len(gone):
        return []
    cut = np.concatenate([[True], (np.diff(gone) > 1) | (part[gone][1:] != part[gone][:-1])])
    first = gone[cut]
    many = np.diff(np.append(np.flatnonzero(cut), len(gone)))
    return list(zip(part[first].tolist(), place[first].tolist(), many.tolist(), strict=True))


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc and key; rows with equal doc and key are one document, a null doc_id is the smallest."""
    return common.texts(docs).withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "key": F.xxhash64("text", F.col("doc_id").isNull())})


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, key, start, many): windows of ``length`` bytes from start on that also start earlier, by (doc, key, start)."""
    spark = docs.sparkSession
    data = _identified(docs).select("doc", "key", "text")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.chunks(batches, size=_CHUNK):
            owner, start, many, anchor, content, inner = runs(*words.raw(chunk.column(2)), length)
            if len(owner):
                yield _combined(chunk.column(0).to_numpy()[owner], chunk.column(1).to_numpy()[owner], start, many, anchor, content, inner, True)

    found = _resolved(data.mapInArrow(first, RUNS), "runs")
    common.release(spark)
    opened = found.filter("anchor is not null")
    weight = opened.groupBy("anchor").agg(F.sum(F.col("many") + length - 1).alias("bytes"), F.count(F.lit(1)).alias("n"))
    total, hot = weight.agg(F.sum("bytes"), F.count(F.when(F.col("bytes") > HOT, 1))).first()
    if not total:
        return found.filter("anchor is null").select("doc", "key", "start", "many")
    buckets = max(1, -(-int(total) // BUCKET))
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int")
    if hot:
        heavy = weight.filter(F.col("bytes") > HOT).select("anchor", F.lit(True).alias("heavy"))
        opened = opened.join(heavy, "anchor", "left").withColumn("bucket", F.when(F.col("heavy"), F.lit(-1)).otherwise(bucket))
    else:
        opened = opened.withColumn("bucket", bucket)
    # a document's open runs: no more than its bytes
    listed = opened.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "many", "bucket")).alias("runs"))
    parts_schema = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.chunks(batches, size=_CHUNK):
            raw, bounds = words.raw(chunk.column(2))
            flat, n = chunk.column(3).flatten(), np.diff(chunk.column(3).offsets.to_numpy())
            start, many, at = (flat.field(i).to_numpy() for i in range(3))
            owner = np.repeat(np.arange(chunk.num_rows), n)
            lo, view = bounds[owner] + start, raw.tobytes()
            yield common.batch_of(parts_schema, at, chunk.column(0).to_numpy()[owner], chunk.column(1).to_numpy()[owner], start, [view[a:b] for a, b in zip(lo.tolist(), (lo + many + length - 1).tolist(), strict=True)])

    cuts = data.join(listed, ["doc", "key"]).select("doc", "key", "text", "runs").mapInArrow(cut, "bucket int, doc long, key long, start int, bytes binary")
    cuts = common.table(cuts, "open-runs")
    common.release(spark)

    def dedupe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            doc, key, start = rows.column(1).to_numpy(), rows.column(2).to_numpy(), rows.column(3).to_numpy().astype(np.int64)
            out = repeated_windows(rows.column(4).to_pylist(), doc, key, start, length)
            p, s, m = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            return common.batch_of(_SPANS, doc[p], key[p], (start[p] + s).astype(np.int32), m.astype(np.int32), pa.nulls(len(p), pa.int64()))

        for batch in batches:
            keys = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b == a:
                    continue
                if held and keys[a] != now:
                    yield close()
                    held.clear()
                now = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    inside = cuts.filter("bucket >= 0").repartition(min(buckets, 20_000), "bucket").sortWithinPartitions("bucket").mapInArrow(dedupe, SPANS)
    parts = [found.filter("anchor is null"), common.table(inside, "bucket-spans")]
    if hot:

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in common.chunks(batches, "bytes", size=_CHUNK // 8):
                raw, bounds = words.raw(chunk.column(4))
                count = np.diff(bounds) - length + 1
                owner = np.repeat(np.arange(len(count)), count)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                h = _Prefix(raw).of(at := bounds[owner] + place, at + length)
                other = _Prefix(raw[::-1].copy()).of(len(raw) - at - length, len(raw) - at)
                yield _combined(chunk.column(1).to_numpy()[owner], chunk.column(2).to_numpy()[owner], chunk.column(3).to_numpy()[owner] + place, np.ones(len(owner), np.int64), words.mix(h), words.mix(other), np.zeros(len(owner), bool), False)

        parts.append(_resolved(cuts.filter("bucket = -1").select("bucket", "doc", "key", "start", "bytes").mapInArrow(windows, RUNS), "hot-windows").filter("anchor is null"))
    out = parts[0].select("doc", "key", "start", "many")
    for p in parts[1:]:
        out = out.unionByName(p.select("doc", "key", "start", "many"))
    return out


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def deduplicate(docs: DataFrame, length: int = LENGTH, with_bytes: bool = True) -> DataFrame:
    """What is left of each whole text (UTF-8 bytes; null: empty).

    Rows with equal doc_id and text are one occurrence: none makes the other a repeat, and they get equal rows.
    Rows with equal or null doc_ids and different texts are different documents, in a fixed order among themselves.
    An empty table gives no rows.
    """
    listed = spans(docs, length).groupBy("doc", "key").agg(F.collect_list(F.struct("start", "many")).alias("spans"))
    data = _identified(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.chunks(batches, size=_CHUNK):
            raw, bounds = words.raw(chunk.column(1))
            column = chunk.column(2)
            flat, n = column.flatten(), np.diff(column.offsets.to_numpy())
            start, many = (flat.field(i).to_numpy() for i in range(2))
            lo = bounds[np.repeat(np.arange(chunk.num_rows), n)] + start
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, lo, 1)
            np.add.at(edge, lo + many + length - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = bounds[:-1][np.diff(bounds) > 0]
            begins[heads] = gone[heads]
            left = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            kept = left if with_bytes else pa.nulls(len(left), pa.binary())
            yield common.batch_of(_KEPT, chunk.column(0), np.diff(bounds), words.per_text(gone, bounds), words.per_text(begins, bounds), [hashlib.sha256(x).hexdigest() for x in left], kept)

    rows = data.join(listed, ["doc", "key"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,many:int>>")).alias("spans"))
    return rows.mapInArrow(run, KEPT)


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicate(common.documents(spark, sf_dir), with_bytes=False).drop("kept")
