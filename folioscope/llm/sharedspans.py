"""Problem 5: spans of at least ``SPAN`` characters that stand verbatim in blocks of more than one page.

1. Routing. Every block gives winnowed fingerprints (the least hash among ``SPAN - GRAM + 1`` consecutive ``GRAM``-grams),
   so two blocks with a common span of SPAN characters have a fingerprint in it in common. Only fingerprints of two or
   more pages go on, with the text around them: a window that holds every SPAN characters of the span that cover the
   fingerprint. Equal windows are kept once; their pages stay in a membership table.
2. Search. Windows with the same fingerprint meet in a shard of bounded size, over which an FM-index is built. Every
   window is streamed against it: its segments of ``SPAN / 2`` characters (each SPAN characters hold a whole one) go
   through backward search over the wavelet matrix, all at once; where the matching statistic reaches the segment's
   length, the occurrences are located and extended to both sides, exactly.
3. Pairs of windows become pairs of pages through the membership table.

A fingerprint with more than ``HOT`` windows is routed on by anchors: its gram with ``PIECES - 1`` of ``PIECES`` equal pieces of the
text beside it, some to the left and the others to the right. Windows with a span in common have one of these anchors in
common, and windows with a common anchor nearly a whole span, so what meets in a shard is nearly all result. A shard
that still has more than ``HOT`` windows is split into blocks, each indexed by itself, against which the windows of the
shard are streamed, ``SHARD_CHARS`` characters at a time. Nothing is capped: each pair of pages with a common span is found once it has a common fingerprint, which
it always has.

Defined results: pages are taken once, by page_id; null blocks, null texts and texts shorter than SPAN share nothing; a
span repeated within one page doesn't count. Positions are in code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.fmindex import FMIndex
from folioscope.sources.tables import one_per_key, stored

SPAN = 120
GRAM = 64
HOT = 1500
PIECES = 4
SHARD_CHARS = 400_000
#: How many occurrences are located and extended at once.
LOCATED = 2_000_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fingerprints(codes: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the winnowed grams of a text; gram is a power of two."""
    n = len(codes)
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    width, base = 1, 0x100000001B3
    with np.errstate(over="ignore"):
        while width < gram:
            h = h[:-width] * np.uint64(base) + h[width:]
            width, base = width * 2, base * base % 2**64
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    w = span - gram + 1
    # The least of each w consecutive hashes, by doubling; equal hashes are thinned out below.
    low, width = h, 1
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: len(h) - w + 1], low[w - width :])
    # A gram is kept if it is the minimum of a window that holds it: compare with the windows that begin up to w - 1 before.
    top, width = low, 1
    pad = np.zeros(w - 1, dtype=np.uint64)
    top = np.concatenate([pad, low, pad])
    while width * 2 <= w:
        top = np.maximum(top[:-width], top[width:])
        width *= 2
    if width < w:
        top = np.maximum(top[: len(top) - (w - width)], top[w - width :])
    at = thinned(h, np.flatnonzero(top[: len(h)] == h), w)
    return h[at].view(np.int64), at


def thinned(h: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """The minima without those that no window of w needs: of equal ones, as in a run of one character, each is followed
    by the last within reach, so that every window still holds one of them. Which of them is no matter: the text around
    any holds the whole common span."""
    order = np.lexsort((at, h[at]))
    hv, pos = h[at][order], at[order]
    near = (hv[1:] == hv[:-1]) & (pos[1:] - pos[:-1] <= w)
    if not near.any():
        return at
    drop = np.zeros(len(h), dtype=bool)
    for begin, end in zip(*(np.flatnonzero(x) for x in (np.diff(near, prepend=False) & near, np.diff(near, append=False) & near)), strict=True):
        run = pos[begin : end + 2]
        drop[run] = True
        i = 0
        while i < len(run):
            drop[run[i]] = False
            i = max(i + 1, int(np.searchsorted(run, run[i] + w, side="right")) - 1)
    return at[~drop[at]]


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, text) of the blocks that are long enough."""
    order = [F.col("ingested_at").asc_nulls_last()] if "ingested_at" in pages.columns else [F.lit(1)]
    texts = F.transform("blocks", lambda b: b["text"])
    p = one_per_key(pages.select("page_id", texts.alias("texts"), *(["ingested_at"] if "ingested_at" in pages.columns else [])), ["page_id"], order)
    return p.select("page_id", F.posexplode("texts").alias("block_no", "text")).where(F.length("text") >= SPAN)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, ats = [], []
        for t in batch.column(2).to_pylist():
            h, at = fingerprints(code_points(t))
            hashes.append(h)
            ats.append(at)
        take = pa.array(np.repeat(np.arange(len(ats)), [len(a) for a in ats]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(ats or [np.empty(0, np.int64)]).astype(np.int32)), pa.array(np.concatenate(hashes or [np.empty(0, np.int64)]))], names=["page_id", "block_no", "at", "fp"])


def windows(pages: DataFrame) -> DataFrame:
    """(fp, page_id, block_no, begin, rel, window, wid) around every fingerprint that more than one page has."""
    texts = stored(blocks(pages), "block-texts")
    prints = stored(texts.mapInArrow(_prints, "page_id long, block_no int, at int, fp long"), "prints")  # small rows, read twice
    shared = prints.groupBy("fp").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b")).where("a <> b").select("fp")
    hits = prints.join(shared, "fp", "left_semi")
    margin = SPAN - GRAM
    begin = F.greatest(F.col("at") - margin, F.lit(0))
    w = hits.join(texts, ["page_id", "block_no"]).withColumn("begin", begin)
    w = w.withColumn("window", F.expr(f"substring(text, begin + 1, at - begin + {GRAM + margin})"))
    return stored(w.select("fp", "page_id", "block_no", "begin", (F.col("at") - F.col("begin")).alias("rel"), "window", F.xxhash64("window").alias("wid")), "windows")


def _extended(grid: np.ndarray, mine: np.ndarray, at_mine: np.ndarray, other: np.ndarray, at_other: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each located match of two rows of the grid goes on to the left and to the right; 0 in the grid ends a text."""
    out = []
    for step in (-1, 1):
        reach = np.zeros(len(mine), dtype=np.int64)
        live = np.arange(len(mine))
        a, b = (at_mine + width, at_other + width) if step > 0 else (at_mine - 1, at_other - 1)
        a, b = a.copy(), b.copy()
        while len(live):
            live = live[(a[live] >= 0) & (b[live] >= 0) & (a[live] < grid.shape[1]) & (b[live] < grid.shape[1])]
            x, y = grid[mine[live], a[live]], grid[other[live], b[live]]
            live = live[(x == y) & (x != 0)]
            reach[live] += 1
            a[live] += step
            b[live] += step
        out.append(reach)
    return out[0], out[1]


#: A row of a shard: shard, salt, fp, wid, window, whether it is indexed here, and whether it is still to be searched.
Row = tuple[int, int, int, int, str, bool, bool]


def match_shard(rows: list[Row]) -> list[tuple[int, int, int, int, int]]:
    """(fp, wid, partner wid, begin, end) of the windows of some shards that share a span with an indexed window of their own."""
    half = SPAN // 2
    texts = [code_points(r[4]) for r in rows]
    longest = max(map(len, texts))
    grid = np.zeros((len(rows), longest), dtype=np.int64)
    for i, t in enumerate(texts):
        grid[i, : len(t)] = t.astype(np.int64) + 1
    of = np.flatnonzero([r[5] for r in rows])
    if len(of) == 0:
        return []
    fm = FMIndex([texts[i] for i in of], 64)
    owner, at = [], []
    for i, t in enumerate(texts):
        for s in range(0, len(t) - half + 1, half) if rows[i][6] else ():
            owner.append(i)
            at.append(s)
    if not owner:
        return []
    owner_a, at_a = np.array(owner), np.array(at)
    patterns = np.stack([texts[i][s : s + half] for i, s in zip(owner, at, strict=True)])
    lo, hi, matched = fm.search(patterns)
    found = np.flatnonzero(matched == half)
    keys, wids = np.array([(r[0], r[1]) for r in rows]), np.array([r[3] for r in rows])
    out: set[tuple[int, int, int, int, int]] = set()
    # What is located at once is bounded, since a pattern of a hot shard occurs in all of it.
    sizes = hi[found] - lo[found]
    for part in np.split(np.arange(len(found)), np.flatnonzero(np.diff(np.cumsum(sizes) // LOCATED)) + 1) if len(found) else ():
        q = np.repeat(found[part], sizes[part])
        n = sizes[part]
        flat = np.repeat(lo[found[part]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        pos = fm.order[flat]
        text = np.searchsorted(fm.starts, pos, side="right") - 1
        off = pos - fm.starts[text]
        other, mine = of[text], owner_a[q]
        same = (keys[mine] == keys[other]).all(axis=1) & (wids[mine] != wids[other])
        q, other, off, mine = q[same], other[same], off[same], mine[same]
        left, right = _extended(grid, mine, at_a[q], other, off, half)
        good = left + half + right >= SPAN
        out |= {(rows[m][2], int(wids[m]), int(wids[o]), int(s - a), int(s + half + b)) for m, o, s, a, b in zip(mine[good].tolist(), other[good].tolist(), at_a[q][good], left[good], right[good], strict=True)}
    return sorted(out)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small shards are searched together; of a large one, whose indexed rows come first, the rest is streamed past them."""
    rows: list[Row] = []
    chars = 0

    def flush() -> pa.RecordBatch:
        found = match_shard(rows)
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["fp", "wid", "partner", "from", "to"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and chars >= SHARD_CHARS:
                new = row[:2] != rows[-1][:2]
                if new or not row[5]:
                    yield flush()
                    rows = [] if new else [(*r[:6], False) for r in rows if r[5] and r[:2] == row[:2]]
                    chars = 0 if new else min(SHARD_CHARS // 2, sum(len(r[4]) for r in rows))
            rows.append((*row, True))
            chars += len(row[4])
    if rows:
        yield flush()


def anchors(window: str = "window", rel: str = "rel") -> Column:
    """The anchors of a window, by hash, wherever its gram occurs in it."""
    piece = (SPAN - GRAM) // PIECES
    width = GRAM + piece * (PIECES - 1)
    at = f"filter(sequence(0, length({window}) - {GRAM}), i -> substring({window}, i + 1, {GRAM}) = substring({window}, {rel} + 1, {GRAM}))"
    own = f"transform(filter(sequence(0, {PIECES - 1}), l -> i >= {piece} * l AND i - {piece} * l + {width} <= length({window})), l -> xxhash64(l, substring({window}, i - {piece} * l + 1, {width})))"
    return F.expr(f"array_distinct(flatten(transform({at}, i -> {own})))")


def matches(w: DataFrame) -> DataFrame:
    """(fp, wid, partner, from, to): which windows share a span, and where in the first; equal windows are their own partners."""
    distinct = w.groupBy("fp", "wid").agg(F.first("window").alias("window"), F.min("rel").alias("rel"), F.min("page_id").alias("a"), F.max("page_id").alias("b"))
    sizes = distinct.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
    rows = distinct.select("fp", "wid", "window", "rel").join(sizes, "fp")
    cold = rows.where(F.col("n") <= HOT).select(F.col("fp").alias("shard"), F.lit(0).alias("salt"), "fp", "wid", "window", F.lit(True).alias("is_index"))
    hot = rows.where(F.col("n") > HOT).select("fp", "wid", "window", F.explode(anchors()).alias("anchor")).select(F.xxhash64("fp", "anchor").alias("shard"), "fp", "wid", "window")
    parts = F.ceil(F.col("m") / HOT).cast("int")
    split = hot.join(hot.groupBy("shard").agg(F.count("*").alias("m")).where("m > 1"), "shard").withColumn("own", F.pmod("wid", parts).cast("int"))
    spread = split.select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), "fp", "wid", "window", "own").select("shard", "salt", "fp", "wid", "window", (F.col("own") == F.col("salt")).alias("is_index"))
    shards = cold.unionByName(spread).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.desc("is_index"))
    unlike = shards.mapInArrow(_search, "fp long, wid long, partner long, from int, to int")
    equal = distinct.where((F.col("a") != F.col("b")) & (F.length("window") >= SPAN)).select("fp", "wid", F.col("wid").alias("partner"), F.lit(0).alias("from"), F.length("window").alias("to"))
    return unlike.unionByName(equal)


def found(pages: DataFrame) -> DataFrame:
    """(page_id_a, page_id_b) of the pages that share a span, smaller id first."""
    w = windows(pages)
    members = w.select("fp", "wid", "page_id").distinct()
    pairs = matches(w).where("wid <= partner").select("fp", "wid", "partner").distinct()
    a = members.withColumnRenamed("page_id", "x")
    b = members.withColumnRenamed("page_id", "y").withColumnRenamed("wid", "partner")
    both = pairs.join(a, ["fp", "wid"]).join(b, ["fp", "partner"]).where("x <> y")
    return both.select(F.least("x", "y").alias("page_id_a"), F.greatest("x", "y").alias("page_id_b")).distinct()


def shared_amounts(pages: DataFrame) -> DataFrame:
    """(page_id, n_chars, shared_chars, shared_share): how much of each page's block text stands in other pages too."""
    w = windows(pages)
    ends = w.groupBy("fp", "wid").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"))
    m = matches(w).join(ends.withColumnRenamed("wid", "partner"), ["fp", "partner"])
    spans = w.join(m, ["fp", "wid"]).where("a <> page_id OR b <> page_id").select("page_id", "block_no", (F.col("begin") + F.col("from")).alias("s"), (F.col("begin") + F.col("to")).alias("e")).distinct()
    by = Window.partitionBy("page_id", "block_no").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    clear = spans.withColumn("before", F.coalesce(F.max("e").over(by), F.lit(0)))
    got = clear.groupBy("page_id").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "before"))).alias("shared_chars"))
    texts = pages.select("page_id", F.aggregate(F.transform("blocks", lambda b: F.length(b["text"]).cast("long")), F.lit(0).cast("long"), lambda x, y: x + F.coalesce(y, F.lit(0))).alias("n_chars"))
    sizes = texts.groupBy("page_id").agg(F.max(F.coalesce("n_chars", F.lit(0))).alias("n_chars"))
    out = sizes.join(got, "page_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
