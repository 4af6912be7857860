"""Fuzzy line deduplication by MinHash (operator 4).

Lines are compared trimmed and in lower case, as sets of SHINGLE characters. Signatures of
BANDS * ROWS minima are cut into bands; lines that agree on a band meet in a bucket. Buckets with the
same lines are worked on once. Then, always by exact Jaccard similarity:

- In each bucket the least key is the pivot, and every other line is compared with it. Distributed
  union-find joins these links.
- Where a bucket's lines still belong to several components, those outside the pivot's component
  ("apart") meet the bucket's other lines, in blocks of BLOCK lines of which one at least is a block
  of lines apart. So no link is missed, and lines of the pivot's component never meet each other. The
  cost is the lines apart times the bucket's lines, a matrix product for each pair of blocks.

Union-find over both kinds of links gives the components. Of each component the first line (by
document id, then place) stays.

A pair at the threshold meets in some band with probability 1 - (1 - 0.8**ROWS)**BANDS, 0.996; above
it the chance is higher. No bucket is cut or left out, so that is the recall.

Defined cases: null text is empty; blank lines always stay and never match; equal lines match, also
those shorter than a shingle, which only equal lines do; a null id is the least; repeated rows and ids
are documents of their own (the first keeps its lines); an empty table gives an empty result; other
columns are carried along. Lines are keyed by 64-bit hashes. Rows are told apart by file and place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_pass, bounds, drop_table, fresh_path, grouped, join_counted, local_least, located, materialize, overlaps, scratch, whole
from tessella.llm.components import components

SHINGLE, THRESHOLD = 6, 0.8
ROWS, BANDS = 5, 14
#: Keys a task remembers so as not to sign a repeated line again.
REMEMBERED = 500_000
#: A band that more than HOT of a slice's lines share is dealt over 64 tasks. The low 7 bits of a band's
#: hash are free for that: 0, or 1 and the part.
SLICE, HOT, PART_BITS = 2048, 64, 7
#: Bands that a task holds before it passes them on, 16 bytes each.
PACKED = 1 << 20
#: Lines of a block where lines apart meet the rest of a bucket.
BLOCK = 256
#: Codes signed at a time, so that temporary arrays stay in the cache, and characters of the lines whose
#: sets are held at a time.
SIGNED, HELD = 1 << 16, 1 << 21
#: Words of 64 bits of the filter that keeps most texts out of a shuffle: at most so many rows of two
#: longs, whatever the number of lines. A full filter only keeps out less.
FILTER_WORDS = 1 << 19
_A = np.random.default_rng(7).integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint32) | 1
_B = np.random.default_rng(8).integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def _lines(docs: DataFrame) -> DataFrame:
    """loc, doc_id, line_no, norm, key of every line that isn't blank."""
    exploded = docs.select("loc", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    return exploded.select("loc", "doc_id", "line_no", normal(F.col("line")).alias("norm")).where(F.length("norm") > 0).withColumn("key", F.xxhash64("norm"))


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all lines, one after the other, and each line's end; the last
    SHINGLE - 1 places of a line belong to no shingle of it."""
    lines = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h + codes[k : k + n]) * _BASE
        h ^= h >> np.uint64(29)
        return h * _MIX, ends


def signatures(lines: list[str]) -> np.ndarray:
    """(len(lines), ROWS * BANDS) minima over each line's shingles; no line is empty."""
    h, ends = _hashes(lines)
    s = (h >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], ends[:-1]])
    out, at = np.empty((len(lines), ROWS * BANDS), np.uint32), 0
    with np.errstate(over="ignore"):
        while at < len(lines):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + SIGNED, "right")))
            own = s[starts[at] : ends[to - 1] - SHINGLE + 1]
            cuts = np.empty(2 * (to - at), np.int64)
            cuts[::2], cuts[1::2] = starts[at:to] - starts[at], ends[at:to] - SHINGLE + 1 - starts[at]
            cuts = cuts[:-1]  # what follows the last line's shingles is nothing
            work, minima = np.empty_like(own), np.empty((ROWS * BANDS, to - at), np.uint32)
            for k in range(ROWS * BANDS):
                np.multiply(np.bitwise_xor(own, _B[k], out=work), _A[k], out=work)
                minima[k] = np.minimum.reduceat(work, cuts)[::2]
            out[at:to] = minima.T
            at = to
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) longs; equal exactly (but for hash collisions) where a band's minima are."""
    with np.errstate(over="ignore"):
        parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE, parts.shape[:2]).copy()
        for k in range(ROWS):
            h = (h ^ parts[:, :, k]) * _MIX
            h ^= h >> np.uint64(32)
    return (h & ~np.uint64((1 << PART_BITS) - 1)).view(np.int64)


def _banded():
    seen: set[int] = set()

    def work(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Slots (bands, and the parts of hot ones) and keys of a slice of lines."""
        fresh = {}
        for key, norm in zip(batch.column("key").to_pylist(), batch.column("norm").to_pylist(), strict=True):
            if key not in seen and key not in fresh:
                fresh[key] = norm
        if len(seen) > REMEMBERED:
            seen.clear()
        seen.update(fresh)
        bands = band_hashes(signatures(list(fresh.values()))).ravel() if fresh else np.empty(0, np.int64)
        keys = np.repeat(np.fromiter(fresh, np.int64, len(fresh)), BANDS)
        found, counts = np.unique(bands, return_counts=True)
        if len(found) and counts.max() > HOT:
            hot = np.isin(bands, found[counts > HOT])
            # One line of each hot band stands for it among the rows that are dealt by band alone.
            _, first = np.unique(bands[hot], return_index=True)
            more = bands[hot][first], keys[hot][first]
            bands[hot] |= 1 | (keys[hot] & ((1 << PART_BITS) - 2))
            bands, keys = np.concatenate([bands, more[0]]), np.concatenate([keys, more[1]])
        return bands, keys

    return work


def _packed(slots: np.ndarray, keys: np.ndarray, parts: int) -> pa.RecordBatch:
    """Slots and keys as bytes, a row for each part of the slots that has any."""
    with np.errstate(over="ignore"):
        part = ((slots.view(np.uint64) * _MIX) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    found, counts = np.unique(part, return_counts=True)
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 8).buffers()[1]
    blobs = [pa.Array.from_buffers(pa.binary(), len(found), [None, ends, pa.py_buffer(np.ascontiguousarray(x[order]))]) for x in (slots, keys)]
    return pa.record_batch([pa.array(found.astype(np.int32)), *blobs], names=["part", "slots", "keys"])


def _dealt(parts: int):
    """Bands of lines, dealt to parts: so many go in few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, held = _banded(), []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                held.append(work(batch.slice(at, SLICE)))
                if sum(len(x) for x, _ in held) >= PACKED:
                    yield _packed(*map(np.concatenate, zip(*held, strict=True)), parts)
                    held = []
        if sum(len(x) for x, _ in held):
            yield _packed(*map(np.concatenate, zip(*held, strict=True)), parts)

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, key, least key of each slot's keys but the least; also of that in parts of hot bands."""
    for group in grouped(batches, ["part"]):
        slots, keys = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("slots", "keys"))
        order = np.argsort(slots)
        slots, keys = slots[order], keys[order]
        starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        least = np.repeat(np.minimum.reduceat(keys, starts), np.diff(np.append(starts, len(keys))))
        kept = np.flatnonzero((keys != least) | (slots & 1 == 1))
        band = slots[kept] & np.int64(-(1 << PART_BITS))
        for at in range(0, len(kept), 1 << 16):
            own = slice(at, at + (1 << 16))
            yield pa.record_batch([pa.array(band[own]), pa.array(keys[kept[own]]), pa.array(least[kept[own]])], names=["band", "key", "least"])


def shingles(line: str) -> set[str]:
    return {line[k : k + SHINGLE] for k in range(len(line) - SHINGLE + 1)} or {line}


def similarity(a: str, b: str) -> float:
    """The definition; _sets() and _enough() compute the same on hashes."""
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    h, ends = _hashes(lines)
    out, at = [], 0
    for end in ends.tolist():
        own = np.sort(h[at : end - SHINGLE + 1])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        at = end
    return out


def _runs(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Places that cut a list of sizes into runs of a sum of HELD at most, or of one item."""
    at, total, end = 0, 0, 0
    for end, n in enumerate(sizes):
        if total + n > HELD and end > at:
            yield at, end
            at, total = end, 0
        total += n
    if total or end >= at:
        yield at, end + 1


def _enough(both, x, y, threshold: float):
    """both / (x + y - both) >= threshold, on integers."""
    return both * 1000 >= round(threshold * 1000) * (x + y - both)


def _verify(threshold: float):
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (batch.column(c).to_pylist() for c in ("line_a", "line_b"))
            ok = []
            for at, to in _runs(len(x) + len(y) for x, y in zip(a, b, strict=True)):
                for x, y in zip(_sets(a[at:to]), _sets(b[at:to]), strict=True):
                    s = np.concatenate([x, y])
                    s.sort()
                    ok.append(bool(_enough(int(np.count_nonzero(s[1:] == s[:-1])), len(x), len(y), threshold)))
            return pa.record_batch([batch.column("key"), batch.column("pivot")], names=["key", "pivot"]).filter(pa.array(ok, pa.bool_()))

        return work

    return make


def _buckets(lines: DataFrame) -> DataFrame:
    """band, key, pivot of the lines that share a band with another; of buckets with the same
    lines one."""
    parts = min(4096, max(64, 4 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = lines.select("key", "norm").mapInArrow(_dealt(parts), "part int, slots binary, keys binary")
    several = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_several, "band long, key long, least long")
    rows = materialize(several.distinct(), "bands")
    members = materialize(rows.select("band", "key").unionAll(rows.select("band", F.col("least").alias("key"))).distinct(), "members")
    drop_table(rows)
    digest = lambda salt: F.bit_xor(F.xxhash64("key", F.lit(salt)))
    sizes = members.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("pivot"), digest(1).alias("x"), digest(2).alias("y")).where("n > 1")
    once = sizes.groupBy("n", "pivot", "x", "y").agg(F.min("band").alias("band")).select("band", "pivot", "n")
    out = materialize(join_counted(members, "band", once, members.count()), "buckets")
    drop_table(members)
    return out


def _firsts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, place (the first of its lines), norm of each line; norm only where the filter of the wanted
    keys takes it, and copies are summed before the shuffle, so few texts are sent."""
    at = {"word": F.pmod("key", F.lit(FILTER_WORDS)), "bit": F.shiftright("key", 58).bitwiseAND(F.lit(63)).cast("int")}
    one = F.expr("shiftleft(1L, bit)")
    words = wanted.withColumns(at).groupBy("word").agg(F.bit_or(one).alias("bits"))  # FILTER_WORDS rows at most
    named = lines.select("key", "norm", F.struct("doc_id", "loc", "line_no").alias("place")).withColumns(at).join(F.broadcast(words), "word", "left")
    held = F.when(F.col("bits").bitwiseAND(one) != 0, F.col("norm"))
    return named.groupBy("key").agg(F.min("place").alias("place"), F.max(held).alias("norm"))


def _met(threshold: float):
    """Links between labels in each pair of blocks of a bucket."""

    def links(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        sizes = np.array([len(s) for s in sets])
        both = overlaps([sets[k] for k in left], [sets[k] for k in right])
        linked = _enough(both, sizes[left][:, None], sizes[right][None, :], threshold) & (label[left][:, None] != label[right][None, :])
        x, y = np.nonzero(linked)
        if not len(x):
            return []
        names, places = np.unique(label, return_inverse=True)
        least = local_least(len(names), places[left[x]], places[right[y]])
        return [(names[k], names[v]) for k, v in enumerate(least) if k != v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole(batches, ["band", "i", "j"]):
            i, j, block, label = (chunk.column(c).to_numpy() for c in ("i", "j", "block", "label"))
            lines, groups, found = chunk.column("norm").to_pylist(), list(bounds(chunk, ["band", "i", "j"])), []
            for at, to in _runs(sum(map(len, lines[a:b])) for a, b in groups):
                first = groups[at][0]
                sets = _sets(lines[first : groups[to - 1][1]])
                for a, b in groups[at:to]:
                    left, right = np.flatnonzero(block[a:b] == i[a]), np.flatnonzero(block[a:b] == j[a])
                    if j[a] == i[a] + 1:
                        right = np.concatenate([right, left])  # within the block of lines apart, once
                    if len(left) and len(right):
                        found += links(sets[a - first : b - first], label[a:b], left, right)
            x, y = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return run


def _apart(buckets: DataFrame, label: DataFrame, text: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between components, found where a bucket holds lines of several."""
    named = buckets.join(label.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    own = named.groupBy("band").agg(F.count("*").alias("n"), F.max(F.when(F.col("key") == F.col("pivot"), F.col("label"))).alias("home"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    total = buckets.count()
    several = materialize(join_counted(named.select("band", "key", "label"), "band", own.select("band", "n", "home"), total).withColumn("apart", F.col("label") != F.col("home")).drop("home"), "apart")
    blocks = lambda c: F.ceil(F.count(F.when(c, 1)) / BLOCK).cast("int")
    counts = several.groupBy("band").agg(F.count("*").alias("n"), blocks(F.col("apart")).alias("x"), blocks(~F.col("apart")).alias("y"))
    dealt = join_counted(several, "band", counts, total)
    dealt = dealt.withColumn("block", F.when(F.col("apart"), F.pmod(F.xxhash64("key"), "x")).otherwise(F.col("x") + F.pmod(F.xxhash64("key"), "y")).cast("int"))
    # Every block of lines apart meets every other block; blocks of the pivot's component only those.
    last = F.when(F.col("apart"), F.col("x") + F.col("y")).otherwise(F.col("x")) - 1
    met = dealt.join(text, "key").withColumn("other", F.explode(F.sequence(F.lit(0), last))).where("other <> block")
    met = met.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", "norm")
    links = materialize(met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_met(threshold), "a long, b long"), "links")
    drop_table(several)
    return links


def classes(lines: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Two tables: (node, label) of each key in a component of two or more, and (key, place, norm) of
    each key's first line. lines: as _lines() gives them."""
    buckets = _buckets(lines)
    wanted = buckets.select("key").distinct()
    firsts = materialize(_firsts(lines, wanted), "firsts")
    text = materialize(firsts.where("norm is not null").select("key", "norm").join(wanted.hint("shuffle_hash"), "key", "left_semi"), "lines")
    pairs = buckets.where("key <> pivot").select("key", "pivot").distinct()
    pivots = pairs.groupBy("pivot").agg(F.count("*").alias("n")).join(text.select(F.col("key").alias("pivot"), F.col("norm").alias("line_b")), "pivot")
    both = join_counted(pairs.join(text.select("key", F.col("norm").alias("line_a")), "key"), "pivot", pivots, buckets.count())
    ok = materialize(arrow_pass(both, _verify(threshold), "key long, pivot long", rows=512), "checked")
    label = components(ok, "key", "pivot")
    more = _apart(buckets, label, text, threshold)
    if not more.isEmpty():
        before = label
        label = components(label.select("node", "label").unionAll(more.toDF("node", "label")), "node", "label")
        drop_table(before)
    for done in (buckets, text, ok, more):
        drop_table(done)
    return label, firsts


def dedup(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """loc, doc_id, n_lines, dropped (places of the lines that go) of each document, as a table."""
    return _dropped(located(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), threshold)


def _dropped(plain: DataFrame, threshold: float) -> DataFrame:
    path = fresh_path(plain.sparkSession, "dropped")
    with scratch(plain.sparkSession):  # what is made on the way goes when the result is written
        return materialize(_places(plain, threshold), "dropped", path=path)


def _places(plain: DataFrame, threshold: float) -> DataFrame:
    label, firsts = classes(_lines(plain), threshold)
    named = firsts.select("key", "place").join(label.withColumnRenamed("node", "key").hint("shuffle_hash"), "key", "left")
    alone = named.where("label is null").select("place")
    least = named.where("label is not null").groupBy("label").agg(F.min("place").alias("place")).select("place")
    stay = alone.unionAll(least).groupBy("place.loc").agg(F.collect_list("place.line_no").alias("stay"))
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    filled = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.length(F.trim(F.element_at("lines", i + 1))) > 0)
    own = plain.select("loc", "doc_id", split.alias("lines")).select("loc", "doc_id", F.size("lines").alias("n_lines"), filled.alias("filled"))
    found = own.join(stay, "loc", "left")
    return found.select("loc", "doc_id", "n_lines", F.when(F.col("stay").isNull(), F.col("filled")).otherwise(F.array_except("filled", "stay")).alias("dropped"))


def apply(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the dropped lines gone from `text`; every row stays. All columns are kept."""
    rows = located(docs, F.struct("*").alias("row"))
    plain = rows.select("loc", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    gone = _dropped(plain, threshold).where(F.size("dropped") > 0).select("loc", "dropped")
    kept = rows.join(gone, "loc", "left")
    lines = F.split("row.text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n"))
    return kept.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
