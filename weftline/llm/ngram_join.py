"""N-gram Jaccard join by a MinHash LSH forest.

A document is its set of five-word shingles. Equal sets are one class and compared once.
Each class has TREES signatures of DEPTH minimum hashes, each a path in a trie. The tries are
kept as sorted paths: a node's key is the hash of its prefix at the shortest depth that may be
needed, the hashes further down are the path below it, and how far two paths agree is the
length of their common prefix. Each class first meets those that share a whole path with it
in some tree, and is then followed up, prefixes shortened by one at a time, until its own
estimate of recall reaches the target: links found at similarity s count 1 / p(s) times,
where p(s) is the chance that some tree shows such a pair at the prefixes used so far, and
one unseen link at the threshold is assumed beside them. Candidates are verified exactly, on
the shingles of the whole texts.

A trie node with few classes gives its pairs. The classes of crowded nodes are joined into
crowds (components over shared crowded nodes) and each crowd is compared in blocks of like
sizes, a tile per two blocks, which gives counts and a spanning set of links instead of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sliced, tidy, unused
from .components import components, smallest_reachable

TREES, DEPTH = 32, 8
SKETCH = "id long, k1 long, k2 long, h1 long, h2 long, size int, keys array<long>, paths array<long>"
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | 1
_ADD = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def depth_for(threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the recall:
    no class has to be followed to shorter ones."""
    depth = DEPTH
    while depth > 1 and recall_at(threshold, depth) < recall:
        depth -= 1
    return depth


def recall_at(s: float, depth: int) -> float:
    """The chance that some tree shows a pair of similarity s at a common prefix of depth."""
    return 1 - (1 - s**depth) ** TREES


def path_bits(depth: int) -> int:
    """Bits of each hash below the node in a path of 64 bits."""
    return min(32, 64 // max(1, DEPTH - depth))


def agreed(a: Column, b: Column, depth: int) -> Column:
    """The length of the common prefix of two paths below one node at depth."""
    other, bits = a.bitwiseXOR(b), path_bits(depth)
    levels = [(F.shiftrightunsigned(other, 64 - bits * k) == 0).cast("int") for k in range(1, DEPTH - depth + 1)]
    return sum(levels, F.lit(depth))


def recall_column(s: Column, depth: int) -> Column:
    """recall_at() of a column."""
    return 1 - F.pow(1 - F.pow(s, F.lit(depth)), F.lit(TREES))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and each text's number.

    Words are runs of other than blanks, A-Z lower-cased. A text of fewer words has one
    shingle of all of them, a text without words none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    named = flat.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in named), np.uint64, len(named))
    codes = flat.indices.to_numpy()
    filled = np.array([w != "" for w in named], bool)[codes] if len(named) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())[filled]
    h = hashes[codes[filled]] if len(named) else np.zeros(0, np.uint64)
    n = np.bincount(doc, minlength=len(split))
    start = np.cumsum(n) - n
    place = np.arange(len(h)) - start[doc]
    width = np.minimum(n, words)[doc]  # of the shingle that starts here
    rolled = np.zeros(len(h), np.uint64)
    for k in range(words):
        at = np.nonzero((width > k) & (place + k < n[doc]))[0]
        rolled[at] = _mix(rolled[at] + h[at + k] + np.uint64(k + 1))
    whole = place + width <= n[doc]
    doc, rolled = doc[whole], rolled[whole]
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    return rolled[new], doc[new]


def signatures(rolled: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minimum hashes of each set; starts: where each (non-empty) set begins."""
    out = np.empty((TREES * DEPTH, len(starts)), np.uint32)
    x = (rolled >> np.uint64(32)).astype(np.uint32) ^ rolled.astype(np.uint32)
    for k in range(len(out)):
        y = x * _ODD[k] + _ADD[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[k] = np.minimum.reduceat(y, starts)
    return out


def sketches(batch: pa.RecordBatch, words: int, depth: int) -> pa.RecordBatch:
    """The sketch of each text (the last column) that has words: set hashes, size, and for each
    tree the key of its node at depth and the path below."""
    rolled, doc = shingle_sets(batch.column(3), words)
    n = np.bincount(doc, minlength=batch.num_rows)
    some = np.nonzero(n)[0]
    starts = (np.cumsum(n) - n)[some]
    keys, paths = np.zeros((2, len(some), TREES), np.uint64)
    sums = np.zeros((2, 0), np.uint64)
    if len(some):
        sums = np.stack([np.add.reduceat(_mix(rolled + np.uint64(s)), starts) for s in (11, 12)])
        low = signatures(rolled, starts).reshape(TREES, DEPTH, -1).astype(np.uint64)
        bits = path_bits(depth)
        for t in range(TREES):
            key = np.full(len(some), t + 1, np.uint64)
            for k in range(depth):
                key = _mix(key + low[t, k] * np.uint64(0x100000001B3))
            keys[:, t] = key
            for k in range(depth, DEPTH):
                paths[:, t] |= (low[t, k] >> np.uint64(32 - bits)) << np.uint64(64 - bits * (k - depth + 1))
    ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * TREES)
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1).view(np.int64))) for x in (keys, paths)]
    given = [batch.column(k).take(pa.array(some)) for k in range(3)]
    columns = [*given, pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(n[some].astype(np.int32)), *lists]
    return pa.RecordBatch.from_arrays(columns, ["id", "k1", "k2", "h1", "h2", "size", "keys", "paths"])


def is_near(shared: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether shared / (a + b - shared) reaches the threshold, to within rounding."""
    return shared >= threshold * (a + b - shared) - 1e-9


def tile_links(rolled: np.ndarray, doc: np.ndarray, n_docs: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of left, one of right) whose shingle sets are near. Shingles that only one
    document has count for its size alone; the others' products are added up a slab of
    shingles at a time."""
    n = np.bincount(doc, minlength=n_docs)
    _, code, often = np.unique(rolled, return_inverse=True, return_counts=True)
    many = often[code] > 1
    code, doc = code[many], doc[many]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    row, col = np.full(n_docs, -1), np.full(n_docs, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    shared = np.zeros((len(left), len(right)), np.float32)
    slab = 4096
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, slab):
        x, y = np.searchsorted(code, [at, at + slab])
        c, d = code[x:y] - at, doc[x:y]
        one, two = np.zeros((len(left), slab), np.float32), np.zeros((len(right), slab), np.float32)
        k = row[d] >= 0
        one[row[d[k]], c[k]] = 1
        k = col[d] >= 0
        two[col[d[k]], c[k]] = 1
        shared += one @ two.T
    i, j = np.nonzero(is_near(shared.astype(np.float64), n[left][:, None], n[right][None, :], threshold))
    return left[i], right[j]


def row_keys(id_: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell rows of unlike id or text apart."""
    return F.xxhash64(id_, text), F.xxhash64(F.lit(1), text, id_)


def near_texts(
    docs: DataFrame,
    *,
    threshold: float = 0.8,
    words: int = 5,
    recall: float = 0.9999,
    id_col: str = "doc_id",
    text_col: str = "text",
    crowd: int = 48,
    block: int = 1024,
    block_shingles: int = 400_000,
) -> DataFrame:
    """One row per document: id, n_links, component_id, kept.

    Two documents are linked if the Jaccard index of their shingle sets is at least
    threshold. component_id is the smallest id reachable by links, kept the row whose id it
    is. Rows that repeat an id are rows of their own, of equal or of different texts. Null
    texts and texts without words, and rows without id, link with nothing; texts of fewer
    words than a shingle have are compared as one shingle. Whole texts are compared. An empty
    table gives no rows; other columns are ignored.
    """
    named = grouped(
        docs, threshold=threshold, words=words, recall=recall, id_col=id_col, text_col=text_col, crowd=crowd, block=block, block_shingles=block_shingles
    )
    alone = docs.where(F.col(id_col).isNull() | ~has_words(F.col(text_col))).select(F.col(id_col).cast("long").alias("id"))
    done = named.select("id", "n_links", "component_id").union(alone.select("id", F.lit(0).cast("long"), F.col("id")))
    return done.select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def one_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near texts: of those with the smallest id, the first by
    row key. Rows that near_texts() links with nothing, those without id or words, all stay."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    found = grouped(docs, id_col=id_col, text_col=text_col, **options)
    first = found.groupBy("group").agg(F.min(F.struct("id", "k1", "k2")).alias("first")).select("first.k1", "first.k2")
    k1, k2 = (unused(k, [*docs.columns, "k1", "k2"]) for k in ("key", "other"))
    keyed = docs.withColumns(dict(zip((k1, k2), row_keys(id_, text), strict=True)))
    alone = F.col(id_col).isNull() | ~has_words(text)
    same = (keyed[k1] == first["k1"]) & (keyed[k2] == first["k2"])
    kept = keyed.where(~alone).join(first, same, "left_semi").dropDuplicates([k1, k2]).drop(k1, k2)
    return kept.union(docs.where(alone))


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def grouped(
    docs: DataFrame, *, threshold: float = 0.8, words: int = 5, recall: float = 0.9999, id_col: str, text_col: str,
    crowd: int = 48, block: int = 1024, block_shingles: int = 400_000,
) -> DataFrame:
    """id, k1, k2 (see row_keys), n_links, component_id and group (one number for a component) of
    each row with id and words."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    k1, k2 = row_keys(id_, text)
    rows = docs.where(id_.isNotNull() & text.isNotNull()).select(id_.alias("id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    depth = depth_for(threshold, recall)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 3):
                yield sketches(part, words, depth)
                tidy()

    drawn = checkpointed(rows.mapInArrow(sketch, SKETCH))
    one = F.min(F.struct("id", "k1", "k2"))  # a row whose text stands for the class
    reps = drawn.groupBy("h1", "h2").agg(one.alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first(F.struct("keys", "paths")).alias("at"))
    reps = checkpointed(reps.select("h1", "h2", "rep.*", "n", "size", "at.*", F.monotonically_increasing_id().alias("cls")))
    nodes = reps.select("cls", "size", F.explode(F.arrays_zip("keys", "paths")).alias("node")).select("cls", "size", "node.keys", "node.paths")
    shared = nodes.groupBy("keys").agg(F.count("*").alias("m"), F.min("cls").alias("first")).where("m > 1")
    met = checkpointed(nodes.join(shared, "keys"))
    crowds = components(met.where(F.col("m") > crowd).select(F.col("cls").alias("a"), F.col("first").alias("b")))
    crowds = checkpointed(crowds.select(F.col("id").alias("cls"), F.col("component").alias("crowd")))

    few = met.where(F.col("m") <= crowd).join(crowds, "cls", "left")
    a, b = (few.select(F.col("keys"), *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "size", "paths", "crowd"))) for s in "ab")
    apart = F.col("crowd_a").isNull() | F.col("crowd_b").isNull() | (F.col("crowd_a") != F.col("crowd_b"))
    fits = F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b") - 1e-9  # else the index can't reach it
    pairs = a.join(b, "keys").where((F.col("cls_a") < F.col("cls_b")) & apart & fits)
    pairs = checkpointed(pairs.groupBy("cls_a", "cls_b").agg(F.max(agreed(F.col("paths_a"), F.col("paths_b"), depth)).alias("agreed")))
    wanted = pairs.select(F.col("cls_a").alias("cls")).union(pairs.select("cls_b")).union(crowds.select("cls")).distinct()
    wanted = reps.join(wanted, "cls", "left_semi").select("cls", "n", "size", "k1", "k2")
    texts = checkpointed(rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("cls", "n", "size", "text").dropDuplicates(["cls"]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 4, 5):
                m = batch.num_rows
                rolled, doc = shingle_sets(pa.concat_arrays([batch.column(4), batch.column(5)]), words)
                n = np.bincount(doc, minlength=2 * m)
                pair, order = doc % m, np.lexsort((rolled, doc % m))
                same = (pair[order][1:] == pair[order][:-1]) & (rolled[order][1:] == rolled[order][:-1])
                common = np.bincount(pair[order][1:][same], minlength=m)
                found = batch.select(["cls_a", "cls_b", "n_a", "n_b"]).append_column("s", pa.array(common / np.maximum(1, n[:m] + n[m:] - common)))
                yield found.filter(pa.array(is_near(common, n[:m], n[m:], threshold)))
                tidy()

    left, right = (texts.select(F.col("cls").alias(f"cls_{s}"), F.col("text").alias(f"text_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    linked, done = None, None
    for at in range(DEPTH, depth - 1, -1):  # prefixes of this length now
        todo = pairs.where(F.col("agreed") == at)
        if done is not None:  # followed up from either end
            todo = todo.join(done.select(F.col("cls").alias("cls_a"), F.lit(1).alias("done_a")), "cls_a", "left")
            todo = todo.join(done.select(F.col("cls").alias("cls_b"), F.lit(1).alias("done_b")), "cls_b", "left").where("done_a is null or done_b is null")
        both = todo.join(left, "cls_a").join(right, "cls_b").select("cls_a", "cls_b", "n_a", "n_b", "text_a", "text_b")
        found = checkpointed(both.mapInArrow(verify, "cls_a long, cls_b long, n_a long, n_b long, s double"))
        linked = found if linked is None else linked.unionByName(found)
        ends = linked.select(F.col("cls_a").alias("cls"), F.col("n_b").alias("n"), "s").union(linked.select("cls_b", "n_a", "s"))
        missed = F.sum(F.col("n") * (1 / recall_column(F.col("s"), at) - 1)) + (1 / recall_at(threshold, at) - 1)
        done = ends.groupBy("cls").agg(F.sum("n").alias("found"), missed.alias("missed"))
        done = done.where((F.col("found") + 1) / (F.col("found") + 1 + F.col("missed")) >= recall).select("cls")
    counted = linked.select(F.col("cls_a").alias("cls"), F.col("n_b").alias("links"), F.col("cls_b").alias("other")).union(
        linked.select("cls_b", "n_a", F.lit(None).cast("long"))
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 3):
                rolled, doc = shingle_sets(batch.column(3), words)
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=batch.num_rows)) * 8).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(rolled)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], ["cls", "n", "size", "shingles"])
                tidy()

    band = F.floor(F.log(F.col("size")) / (math.log(1 / threshold) * 1.001)).cast("long")  # near sets lie in neighbouring ones
    members = texts.join(crowds, "cls", "left_semi").mapInArrow(hashed, "cls long, n long, size int, shingles binary")
    placed = crowds.join(reps.select("cls", "size"), "cls").withColumn("band", band)
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / block_shingles)).cast("int")
    sizes = checkpointed(placed.groupBy("crowd", "band").agg(blocks.alias("blocks")))
    beside = sizes.select("crowd", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"), F.col("band").alias("to"), F.col("blocks").alias("to_blocks"))
    around = beside.groupBy("crowd", "band").agg(F.collect_list(F.struct("to", "to_blocks")).alias("around")).join(sizes, ["crowd", "band"])
    number = lambda b, i: F.shiftleft(b, 32) + i
    others = F.flatten(F.transform("around", lambda z: F.transform(F.sequence(F.lit(0), z["to_blocks"] - 1), lambda i: number(z["to"], i))))
    salts = 16  # a crowd's band may hold most rows
    around = around.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = placed.select("cls", "crowd", "band", F.pmod(F.xxhash64("cls", F.lit("salt")), F.lit(salts)).cast("int").alias("salt")).join(around, ["crowd", "band", "salt"])
    dealt = dealt.withColumn("own", number(F.col("band"), F.pmod(F.xxhash64("cls"), F.col("blocks"))))
    dealt = dealt.select("cls", "crowd", "own", F.explode(others).alias("with"))
    dealt = dealt.join(members, "cls").select("crowd", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "cls", "n", "shingles")

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        ids, sizes, own = (t[c].to_numpy() for c in ("cls", "n", "own"))
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in t["shingles"]]
        doc = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
        x, y = key[1].as_py(), key[2].as_py()
        i, j = tile_links(np.concatenate(sets), doc, len(ids), np.nonzero(own == x)[0], np.nonzero(own == y)[0], threshold)
        if x == y:
            once = i < j
            i, j = i[once], j[once]
        links = np.bincount(i, sizes[j], len(ids)) + np.bincount(j, sizes[i], len(ids))
        label = smallest_reachable(len(ids), i, j)
        some = (links > 0) | (label != np.arange(len(ids)))
        return pa.table({"cls": ids[some], "links": links[some].astype(np.int64), "other": ids[label[some]]})

    tiles = dealt.groupBy("crowd", "x", "y").applyInArrow(tile, "cls long, links long, other long")
    every = checkpointed(counted.unionByName(tiles))
    counts = every.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = components(every.where("other is not null and other <> cls").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    joined = reps.select("cls", "h1", "h2", "id", "n").join(comps.select(F.col("id").alias("cls"), "component"), "cls", "left")
    joined = joined.join(counts, "cls", "left").withColumn("group", F.coalesce("component", "cls"))
    lowest = joined.where("component is not null").groupBy("group").agg(F.min("id").alias("low"))
    known = joined.join(lowest, "group", "left").select("h1", "h2", "group", "n", "links", F.coalesce("low", "id").alias("component_id"))
    return drawn.select("id", "k1", "k2", "h1", "h2").join(known, ["h1", "h2"]).select(
        "id", "k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id", "group"
    )
