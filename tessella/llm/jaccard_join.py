"""N-gram Jaccard self-join by chosen paths (operator 9).

Documents are sets of hashed shingles of SHINGLE words (lower-case runs of word characters; a text
of fewer words is one shingle). Equal sets are joined first and stand as one node with its number of
copies. Each node is embedded as TOKENS MinHash values; the tree of chosen paths works on those:

- In each of RUNS runs a node takes each of its tokens with probability 1 / (THRESHOLD * TOKENS),
  by a hash of run, path and token, so similar nodes take shared tokens alike; each taken token is a
  bucket of the next level.
- Buckets of at most BUCKET nodes are compared by brute force. Of larger ones, up to GATHERED nodes,
  a node that shares too few of its values with all others together to be near any of them goes.
  The rest is compared with PIVOTS of its nodes, those of the most frequent values first, which is
  enough for groups of near copies. If FEW nodes at most stand apart from the largest group that is
  linked then, each is compared with all others and the bucket is done, at FEW comparisons a node;
  else it is split further. Buckets over GATHERED are compared with their least node and split
  whole. A bucket of nodes that were linked to one node in the one before it goes.
  What is large after LEVELS splits is compared block by block, so no pair of a bucket is left out;
  a bucket of many nodes that stand apart from its largest group (over GATHERED: that are unlike its
  least node) costs the square of their number.
- Two nodes at the threshold share a bucket of level 1 with probability 1 - 1/e in a run, of deeper
  ones less often; RUNS is the least number of runs in which they share one of level LEVELS with
  probability TARGET (recall()). Closer ones are found more often.

Buckets compare the embedding with a margin of MARGIN standard errors and yield candidate links; the
components of these are then compared exactly, by blocks of BLOCK nodes, on the sets of the whole
texts. That gives each node's links and the classes.

Defined cases: null text and texts without a word have no set, match nothing and form a class of
their own; repeated rows match each other; an empty table gives an empty result; documents are told
apart by file and place, so a repeated id is no trouble; a null id is the least of its class; other
columns are ignored (kept by apply()).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_pass, drop_table, fresh_path, grouped, join_counted, local_least, located, materialize, overlaps, scratch
from tessella.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
TOKENS, LEVELS, BUCKET, BLOCK, MARGIN = 128, 6, 48, 256, 4.0
#: The least probability with which two nodes at the threshold share a bucket of level LEVELS.
TARGET = 0.97


def recall(runs: int, levels: int = LEVELS) -> float:
    """The probability that two nodes at the threshold share a bucket of that level in one of the
    runs: shared tokens are binomial, and each continues a path with probability 1 / (THRESHOLD * TOKENS)."""
    out = 0.0
    for m in range(TOKENS + 1):
        q = 1.0
        for _ in range(levels):
            q = 1 - (1 - q / (THRESHOLD * TOKENS)) ** m
        out += math.comb(TOKENS, m) * THRESHOLD**m * (1 - THRESHOLD) ** (TOKENS - m) * (1 - (1 - q) ** runs)
    return out


RUNS = next(r for r in range(1, 1000) if recall(r) >= TARGET)
WORD = re.compile(r"\w+")
_A = np.random.default_rng(21).integers(1, 1 << 32, TOKENS, dtype=np.uint32) | 1
_B = np.random.default_rng(22).integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACES = np.arange(1, TOKENS + 1, dtype=np.uint64) * _Q
_TAKE = np.uint64(min(2**64 - 1, int(2**64 / (THRESHOLD * TOKENS))))
#: The least share of equal embedded values at which two nodes are candidates.
CANDIDATE = THRESHOLD - MARGIN * (THRESHOLD * (1 - THRESHOLD) / TOKENS) ** 0.5
#: Nodes of a bucket that one task holds at most, at TOKENS * 4 bytes each.
GATHERED = 1 << 15
#: Values that a candidate shares at least: brute force may take up to 4 more as equal, by their low bytes.
SHARED = math.ceil(CANDIDATE * TOKENS) - 4
#: Nodes of a large bucket that all of it is compared with first, and most others that are so then.
PIVOTS, FEW = 16, 512


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of 64-bit shingle hashes; words' hashes are kept in a bounded dictionary."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        got = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self.kept) >= 400_000:
            self.kept.clear()
        self.kept[word] = got
        return got

    def __call__(self, text: str) -> np.ndarray:
        words, get = WORD.findall(text.lower()), self.kept.get
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter((get(x) or self._hash(x) for x in words), np.uint64, len(words))
        size = min(SHINGLE, len(w))
        n = len(w) - size + 1
        with np.errstate(over="ignore"):
            h = np.full(n, np.uint64(size))
            for k in range(size):
                h = _mix(h + w[k : k + n])
        return np.unique(h)


def embed(shingles: np.ndarray) -> np.ndarray:
    """TOKENS minima, one for each of the fixed permutations."""
    s = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(TOKENS, np.uint32(2**32 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            np.minimum(out, ((s[at : at + 4096, None] ^ _B) * _A).min(0), out=out)
    return out


def chosen(path: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """The paths that continue `path` (n uint64) by the tokens (n, TOKENS) that are taken there, and
    for each the place of the path it continues."""
    with np.errstate(over="ignore"):
        h = _mix(_mix(path[:, None] + _PLACES) + embedding.astype(np.uint64))
    row, column = np.nonzero(_mix(h) < _TAKE)
    return h[row, column], row


_ROOTS = np.arange(1, RUNS + 1, dtype=np.uint64) * _P


def _sketch():
    of = Shingler()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest, size, sketch, low, paths = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            s = of(text or "")
            size.append(len(s))
            if not len(s):
                digest.append(None)
                sketch.append(None)
                low.append(None)
                paths.append([])
                continue
            e = embed(s)
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sketch.append(e.tobytes())
            low.append(e.astype(np.uint8).tobytes())  # the low bytes are enough for brute force
            paths.append(chosen(_ROOTS, np.broadcast_to(e, (RUNS, TOKENS)))[0].view(np.int64))
        return pa.record_batch([batch.column("loc"), batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(sketch, pa.binary()), pa.array(low, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], names=["loc", "doc_id", "digest", "size", "sketch", "bytes", "paths"])

    return work


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each small bucket to the least node of the component they give there."""
    low = CANDIDATE + (1 - CANDIDATE) / 256  # bytes of different values are equal by chance
    a_out, b_out = [], []
    for bucket in grouped(batches, ["path"]):
        nodes, x = bucket.column("node").to_numpy(), _matrix(bucket.column("bytes"), np.uint8)
        order = np.argsort(nodes)
        nodes, x = nodes[order], x[order]
        i, j = np.nonzero((x[:, None, :] == x[None, :, :]).mean(2, dtype=np.float32) >= low) if len(nodes) <= 64 else _by_rows(x, low)
        least = local_least(len(nodes), i, j)
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        a_out += nodes[moved].tolist()
        b_out += nodes[least[moved]].tolist()
        if len(a_out) >= 4096:
            yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
            a_out, b_out = [], []
    if a_out:
        yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def _by_rows(x: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    found = [(k, np.flatnonzero((x[:k] == x[k]).mean(1, dtype=np.float32) >= low)) for k in range(1, len(x))]
    return np.concatenate([np.full(len(j), k) for k, j in found]), np.concatenate([j for _, j in found])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each pair of blocks of a bucket, as those of _brute."""
    low = CANDIDATE + (1 - CANDIDATE) / 256
    for group in grouped(batches, ["path", "i", "j"]):
        order = np.argsort(group.column("node").to_numpy())
        nodes, block = (group.column(c).to_numpy()[order] for c in ("node", "block"))
        x = _matrix(group.column("bytes"), np.uint8)[order]
        left, right = (np.flatnonzero(block == group.column(c)[0].as_py()) for c in ("i", "j"))
        hits = [right[(x[right] == x[k]).mean(1, dtype=np.float32) >= low] for k in left]
        least = local_least(len(nodes), np.repeat(left, [len(h) for h in hits]), np.concatenate([*hits, np.empty(0, int)]))
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], names=["a", "b"])


_SPLIT = "path long, node long, root long, near boolean, open boolean, paths array<long>"


def _split(path: pa.Array, node: pa.Array, root: np.ndarray, near: np.ndarray, open_: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    """Nodes of large buckets with a node they are linked to (or themselves), whether they are near (in one group
    that is linked), whether they go on, and the next paths of those that do."""
    own = np.flatnonzero(open_)
    nxt, row = chosen(path.to_numpy().view(np.uint64)[own], e[own])
    ends = np.cumsum(np.bincount(own[row], minlength=len(e)))
    paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(nxt.view(np.int64)))
    return pa.record_batch([path, node, pa.array(root), pa.array(near), pa.array(open_), paths], names=["path", "node", "root", "near", "open", "paths"])


def _large():
    """Of nodes of large buckets with their embeddings and those of their buckets' least nodes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = _matrix(batch.column("sketch"), np.uint32)
        near = (e == _matrix(batch.column("pivot_sketch"), np.uint32)).mean(1) >= CANDIDATE
        root = np.where(near, batch.column("pivot").to_numpy(), batch.column("root").to_numpy())
        return _split(batch.column("path"), batch.column("node"), root, near, np.ones(len(e), bool), e)

    return work


def shared_values(e: np.ndarray) -> np.ndarray:
    """How many of each row's values another row has at the same place."""
    out = np.zeros(len(e), int)
    for column in e.T:
        _, place, counts = np.unique(column, return_inverse=True, return_counts=True)
        out += counts[place] > 1
    return out


def possible(e: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The rows that may be near another: each shares SHARED of its values with the others that are left.
    Another round only finds more to leave out."""
    kept = np.arange(len(e))
    for _ in range(rounds):
        ok = shared_values(e[kept]) >= SHARED
        kept = kept[ok]
        if ok.all():
            break
    return kept


def through_pivots(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) of all rows near one of PIVOTS rows with it. Each pivot is the row, of those near none before,
    whose values are the most frequent ones, so large groups of near copies come first."""
    weight, todo, a, b = np.zeros(len(e), int), np.ones(len(e), bool), [], []
    for column in e.T:
        _, place, counts = np.unique(column, return_inverse=True, return_counts=True)
        weight += counts[place]
    for _ in range(PIVOTS):
        if not todo.any():
            break
        pivot = int(np.argmax(np.where(todo, weight, -1)))
        near = np.flatnonzero((e == e[pivot]).mean(1) >= CANDIDATE)
        a.append(np.full(len(near), pivot))
        b.append(near)
        todo[near] = False
    return np.concatenate([*a, np.empty(0, int)]), np.concatenate([*b, np.empty(0, int)])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _large, of whole buckets, without the nodes that can be near no other of theirs. If FEW nodes at most
    stand apart from the largest group of linked ones, each of them is compared with all, and none goes on."""
    for bucket in grouped(batches, ["path"]):
        bucket = bucket.take(pa.array(np.argsort(bucket.column("node").to_numpy())))
        bucket = bucket.take(pa.array(possible(_matrix(bucket.column("sketch"), np.uint32))))
        if not bucket.num_rows:
            continue
        e, nodes = _matrix(bucket.column("sketch"), np.uint32), bucket.column("node").to_numpy()
        _, first, known = np.unique(bucket.column("root").to_numpy(), return_index=True, return_inverse=True)
        a, b = through_pivots(e)
        a, b = np.concatenate([first[known], a]), np.concatenate([np.arange(len(e)), b])
        least = local_least(len(e), a, b)
        near = least == np.argmax(np.bincount(least))
        apart = np.flatnonzero(~near)
        done = len(apart) <= FEW
        if done:
            hits = [np.flatnonzero((e == e[k]).mean(1) >= CANDIDATE) for k in apart]
            least = local_least(len(e), np.concatenate([a, np.repeat(apart, [len(h) for h in hits])]), np.concatenate([b, *hits]))
        out = np.flatnonzero(least != np.arange(len(e))) if done else np.arange(len(e))
        for at in range(0, len(out), 1024):
            own = out[at : at + 1024]
            of = bucket.take(pa.array(own))
            yield _split(of.column("path"), of.column("node"), nodes[least[own]], near[own], np.full(len(own), not done), e[own])


def _blocks(large: DataFrame, few: DataFrame) -> DataFrame:
    """(a, b) of buckets that are large after all splits (path, node, near): all pairs of blocks of
    BLOCK nodes meet, but for those of near nodes, which are linked to each other already."""
    count = lambda c: F.ceil(F.count(F.when(c, 1)) / BLOCK).cast("int")
    counts = large.groupBy("path").agg(F.count("*").alias("n"), count(~F.col("near")).alias("far"), count(F.col("near")).alias("close")).where("far > 0")
    dealt = join_counted(large.select("path", "node", "near"), "path", counts, large.count())
    dealt = dealt.withColumn("block", F.when(F.col("near"), F.col("far") + F.pmod(F.xxhash64("node"), "close")).otherwise(F.pmod(F.xxhash64("node"), "far")).cast("int"))
    last = F.when(F.col("near"), F.col("far")).otherwise(F.col("far") + F.col("close")) - 1
    pairs = dealt.join(few, "node").withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    pairs = pairs.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "bytes")
    return pairs.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(_met, "a long, b long")


def _candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): links of the embedding, enough to connect each component of candidates."""
    few = nodes.select("node", "bytes")
    state, found = nodes.select("node", F.col("node").alias("root"), F.explode("paths").alias("path")), []
    for level in range(1, LEVELS + 1):
        # A path goes on from one bucket, so nodes that have one root there are linked already, through it.
        sizes = state.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("pivot"), F.min("root").alias("one"), F.max("root").alias("other")).where("n > 1 and one <> other").drop("one", "other").withColumn("size", F.col("n"))
        rows = materialize(join_counted(state, "path", sizes, state.count()), "paths")
        small = rows.where(F.col("size") <= BUCKET).select("path", "node")
        met = small.join(few, "node").repartition("path").sortWithinPartitions("path")
        found.append(materialize(met.mapInArrow(_brute, "a long, b long"), "links"))
        large = rows.where(F.col("size") > BUCKET).select("path", "node", "root", "pivot", "size")
        if large.isEmpty():
            drop_table(rows)
            break
        own = nodes.select("node", "sketch")
        compared = large.where(F.col("size") > GATHERED).drop("size").join(own, "node").join(own.select(F.col("node").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
        held = large.where(F.col("size") <= GATHERED).drop("size", "pivot").join(own, "node").repartition("path").sortWithinPartitions("path")
        after = held.mapInArrow(_gathered, _SPLIT)
        if not large.where(F.col("size") > GATHERED).isEmpty():
            after = after.unionAll(arrow_pass(compared, _large, _SPLIT, rows=1024))
        after = materialize(after, "large")
        found.append(after.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        after = after.where("open")
        if level == LEVELS:
            found.append(materialize(_blocks(after, few), "links"))
        state = after.select("node", "root", F.explode("paths").alias("path"))
        drop_table(rows)
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def _sets():
    of = Shingler()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([of(t or "").tobytes() for t in batch.column("text").to_pylist()], pa.binary())
        return pa.record_batch([*(batch.column(c) for c in ("label", "blocks", "block", "node", "copies")), sets], names=["label", "blocks", "block", "node", "copies", "shingles"])

    return work


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks of a component: every node's links in it (weighed by copies), and the
    least node it is connected to there."""
    for group in grouped(batches, ["label", "i", "j"]):
        node, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        order = np.argsort(node)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = (order[block[order] == k] for k in (i, j))
        if not len(left) or not len(right):
            continue
        size = np.array([len(s) for s in sets])
        both = overlaps([sets[k] for k in left], [sets[k] for k in right])
        # >= on integers: both / union >= THRESHOLD without rounding
        linked = both * 10 >= round(THRESHOLD * 10) * (size[left][:, None] + size[right][None, :] - both)
        if i == j:
            np.fill_diagonal(linked, False)
        degree = np.zeros(len(node), np.int64)
        np.add.at(degree, left, linked @ copies[right])
        if i != j:
            np.add.at(degree, right, linked.T @ copies[left])
        place = np.empty(len(node), int)
        place[order] = np.arange(len(node))
        a, b = np.nonzero(linked)
        least = local_least(len(node), place[left[a]], place[right[b]])
        yield pa.record_batch([pa.array(node[order]), pa.array(node[order][least]), pa.array(degree[order])], names=["node", "least", "links"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """loc, doc_id, class_id, n_links, first (whether the row is its class's least by id) of each
    document, as a table. class_id: the least id of its class. n_links: how many other documents
    have a similarity of at least the threshold with it. loc names the row of docs, see located()."""
    return _join(located(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def _join(plain: DataFrame) -> DataFrame:
    path = fresh_path(plain.sparkSession, "classes")
    with scratch(plain.sparkSession):  # what is made on the way goes when the result is written
        return materialize(_classes(plain), "classes", path=path)


def _classes(plain: DataFrame) -> DataFrame:
    sketches = arrow_pass(plain, _sketch, "loc struct<f:long,r:long>, doc_id long, digest binary, size int, sketch binary, bytes binary, paths array<long>")
    # Rows are numbered once, in the table that every later pass reads.
    rows = materialize(sketches.withColumn("rid", F.monotonically_increasing_id()), "sketches")
    n_rows = rows.count()
    same = materialize(rows.where("size > 0").groupBy("digest").agg(F.min("rid").alias("node"), F.count("*").alias("n"), F.min(F.struct("doc_id", "rid")).alias("best")), "sets")
    nodes = materialize(rows.select(F.col("rid").alias("node"), "loc", "sketch", "bytes", "paths").join(same.select("node"), "node", "left_semi"), "nodes")
    label = components(_candidates(nodes))

    counts = label.groupBy("label").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = join_counted(label, "label", counts, n_rows).join(same.select("node", F.col("n").alias("copies")), "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    texts = plain.select("loc", "text").join(members.join(nodes.select("node", "loc"), "node").hint("shuffle_hash"), "loc")
    sets = arrow_pass(texts, _sets, "label long, blocks int, block int, node long, copies long, shingles binary")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    exact = materialize(pairs.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(_exact, "node long, least long, links long"), "exact")
    final = components(exact, "node", "least")

    counted = exact.groupBy("node").agg(F.sum("links").alias("links"))
    known = same.join(final, "node", "left").join(counted, "node", "left").select("digest", "n", "best", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    known = materialize(known, "known")
    heads = known.groupBy("label").agg(F.count("*").alias("n"), F.min("best").alias("head"))
    named = join_counted(known.withColumnRenamed("n", "copies"), "label", heads, n_rows).select("digest", F.col("copies").alias("n"), "head", "n_links")
    some = join_counted(rows.where("size > 0").select("rid", "loc", "doc_id", "digest"), "digest", named, n_rows).select("loc", "doc_id", F.col("head.doc_id").alias("class_id"), "n_links", (F.col("rid") == F.col("head.rid")).alias("first"))
    return some.unionAll(rows.where("size = 0").select("loc", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first")))


def apply(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one with the least id. All columns are kept."""
    rows = located(docs, F.struct("*").alias("row"))
    gone = _join(rows.select("loc", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))).where("not first").select("loc")
    return rows.join(gone.hint("shuffle_hash"), "loc", "left_anti").select("row.*")
