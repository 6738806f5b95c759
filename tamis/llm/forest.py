"""Near-duplicate classes by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Each document has a set of word shingles and a signature of MINIMA minima.  A tree of the forest is a sorted order
of all documents by LABELS of the minima, compared one after the other; every minimum serves two trees, which share
no other.  Documents with a common prefix of d minima stand together: a region of depth d.

* Documents of equal sets are one class from the start; only its smallest id goes on.
* All trees together are one range-partitioned sort by (tree, minima, id), so a crowded region may lie on several
  partitions.
* Depth adapts to the region: it starts at DEPTH minima and grows, minimum by minimum, while more than WINDOW
  documents share the prefix.  Documents of one region are candidates if a sketch of sixteen further minima agrees.
* A region that is crowded at full depth, or one that a partition border cuts, is tied as a whole (a chain along
  the order), so no pair of it is lost and the edges stay linear.
* Connected candidates make a group, and groups are settled exactly on the full sets (`links_of_groups`): in one
  task up to BLOCK documents; beyond that all members first meet a few documents from the middle of the group, and
  only those that this leaves apart meet all the others, in blocks.
* Connected components of the links are the classes; equal sets follow their smallest id.

A link of similarity 0.8 shares the first eight minima in one of 64 trees but for a chance of
(1 - 0.8**8)**64 = 8e-6, and the first five, which suffice where no region is crowded, but for 1e-11; the sketch
turns it away in a tree with a chance of 1e-4.  There is no cap on partners, and no link rests on an estimate.

Null texts, empty texts and texts without a word have no shingle and are linked with nothing.  Fewer words than a
shingle holds: the whole sequence is the one shingle.  A repeated id is one node: links of any of its texts are its
links.  Null ids stay alone (component null).  Texts are handled whole: a task holds a batch of rows, or the
members of one block, at some twenty times their size.  Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import checkpointed, components, hot_join, runs, shuffle_partitions
from tamis.llm.words import Texts, chunks, mix, texts_of, windows, words_of

TREES, LABELS, DEPTH = 64, 8, 5
MINIMA = TREES * LABELS // 2
WINDOW = 256
BLOCK = 512
PIVOTS = 4
SKETCH = 16  # further minima, four bits each
AGREE = 7  # of them: at similarity 0.8 13 agree on average, with a deviation of 1.6

_rng = np.random.default_rng(97)
_MUL = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)


def shingles_of(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's distinct shingles, sorted, as 64-bit hashes. A-Z are lowered."""
    words = words_of(texts)
    at, h = windows(words, size)
    doc = words.doc[at]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size - 1):
                has = counts[short] > j
                extra[has] = mix(extra[has] * np.uint64(0x2545F4914F6CDD1D) + words.hash[words.first[short[has]] + j])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, extra])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[fresh], h[fresh]
    return h, np.searchsorted(doc, np.arange(texts.n + 1))


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """uint32 minima, one row for each non-empty set."""
    heads = off[:-1][np.diff(off) > 0]
    out = np.empty((len(heads), MINIMA), np.uint32)
    if len(heads):
        with np.errstate(over="ignore"):
            for k in range(MINIMA):
                out[:, k] = np.minimum.reduceat(((h * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), heads)
    return out


def _describe(size: int):
    def body(batches):
        for batch in batches:
            for a, b, part in chunks(texts_of(batch.column(1))):
                h, off = shingles_of(part, size)
                n = np.diff(off)
                full = np.flatnonzero(n)
                sig = signatures(h, off)
                with np.errstate(over="ignore"):
                    first = np.zeros(part.n, np.uint64)
                    second = np.zeros(part.n, np.uint64)
                    if len(full):
                        first[full] = np.add.reduceat(mix(h), off[:-1][full])
                        second[full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), off[:-1][full])
                raw = (sig & 0xFFFF).astype("<u2").tobytes()
                sigs: list = [None] * part.n
                for i, d in enumerate(full.tolist()):
                    sigs[d] = raw[i * 2 * MINIMA : (i + 1) * 2 * MINIMA]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(sigs, pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "sig"],
                )

    return body


def tree_labels(sig: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(the LABELS minima of tree t, SKETCH others) of signatures: half the trees read the minima row by row, half
    column by column of a square."""
    half = TREES // 2
    if t < half:
        turn = np.roll(sig, -t * LABELS, axis=1)
        return turn[:, :LABELS], turn[:, LABELS : LABELS + SKETCH]
    own = [sig[:, (t + k) % half :: half] for k in range(1 + SKETCH // LABELS)]
    return own[0], np.concatenate(own[1:], axis=1)


def _orders(batches):
    """Signatures -> a row for each tree: its minima, four to a number, and the sketch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column(0)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, MINIMA).astype(np.uint64)
        for t in range(TREES):
            own, others = tree_labels(sig, t)
            packed = np.zeros((2, len(sig)), np.uint64)
            sketch = np.zeros(len(sig), np.uint64)
            for j in range(LABELS):
                packed[j // 4] = packed[j // 4] << np.uint64(16) | own[:, j]
            for j in range(SKETCH):
                sketch = sketch << np.uint64(4) | (others[:, j] & np.uint64(15))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sig), t, np.int32)), *(pa.array(x.view(np.int64)) for x in (packed[0], packed[1], sketch)), doc], ["tree", "m1", "m2", "sketch", "doc_id"]
            )


def common_depth(tree: np.ndarray, m1: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """Leading minima that each row shares with the row before it (0 for the first and between trees)."""
    out = np.zeros(len(tree), np.int64)
    same = np.ones(len(tree) - 1, bool) if len(tree) else np.zeros(0, bool)
    same &= tree[1:] == tree[:-1]
    for m in (m1.view(np.uint64), m2.view(np.uint64)):
        differ = m[1:] ^ m[:-1]
        for lane in (48, 32, 16, 0):
            same = same & (differ >> np.uint64(lane) == 0)
            out[1:] += same
    return out


def regions(shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(region of each row, whether it is crowded): depth grows from DEPTH until at most `window` rows share it."""
    n = len(shared)
    region, crowded = np.full(n, -1), np.zeros(n, bool)
    open_ = np.ones(n, bool)
    for depth in range(DEPTH, LABELS + 1):
        run = np.cumsum(shared < depth)  # the first row of a stretch starts a run
        size = np.bincount(run)[run]
        done = open_ & (size <= window)
        region[done] = (run * (LABELS + 1) + depth)[done]
        open_ &= ~done
        if not open_.any():
            return region, crowded
    region[open_] = (run * (LABELS + 1) + LABELS)[open_]
    crowded[open_] = True
    return region, crowded


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal four-bit places of two sketches."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return SKETCH - np.bitwise_count(x & np.uint64(0x1111111111111111)).astype(np.int64)


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each place's connected part, for edges a-b among n places."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _neighbours(batches):
    """Rows in the order of the trees -> edges (a, b, 0), and (key, document, 1) for regions at the partition's borders."""

    def out(a, b, border):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), border), pa.int32())], ["a", "b", "border"])

    def key(rows, i):
        with np.errstate(over="ignore"):
            tree, m1, m2 = (rows[k][i : i + 1].astype(np.int64).view(np.uint64) for k in range(3))
            return mix(mix(m1 * np.uint64(64) + tree) + (m2 >> np.uint64(16 * (LABELS - DEPTH)))).view(np.int64)

    def settle(rows, first, last):
        """Edges of whole stretches that share DEPTH minima; first and last: the partition begins, or ends, here."""
        doc = rows[4]
        shared = common_depth(*rows[:3])
        region, crowded = regions(shared, WINDOW)
        stretch = np.cumsum(shared < DEPTH)
        border = np.zeros(len(doc), bool)
        if first:
            border |= stretch == stretch[0]
            yield out(key(rows, 0), doc[:1], 1)
        if last:
            border |= stretch == stretch[-1]
            yield out(key(rows, len(doc) - 1), doc[-1:], 1)
        tied = (crowded[1:] & (region[1:] == region[:-1])) | (border[1:] & (stretch[1:] == stretch[:-1]))
        chain = np.flatnonzero(tied) + 1
        left, right = [chain - 1], [chain]
        sketch = rows[3].view(np.uint64)
        for d in range(1, WINDOW):
            i = np.flatnonzero((region[d:] == region[:-d]) & ~crowded[d:]) if d < len(doc) else np.zeros(0, np.int64)
            if not len(i):
                break  # rows of one region stand together
            i = i[_agreement(sketch[i], sketch[i + d]) >= AGREE]
            left.append(i)
            right.append(i + d)
        # of all these only a spanning forest goes out: at most an edge for each row
        label = _parts(len(doc), np.concatenate(left), np.concatenate(right))
        i = np.flatnonzero(label != np.arange(len(label)))
        if len(i):
            yield out(doc[i], doc[label[i]], 0)

    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy() for k in range(5)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = np.flatnonzero(common_depth(*held[:3]) < DEPTH)[-1]  # where the last stretch begins
        if cut > 4 * WINDOW:
            yield from settle([x[:cut] for x in held], first, False)
            held, first = [x[cut:] for x in held], False
    if held is not None:
        yield from settle(held, first, True)


def candidate_edges(sets: DataFrame) -> DataFrame:
    """(a, b) edges whose connected parts hold every link that the forest finds. sets: (doc_id, sig)."""
    n = shuffle_partitions(sets.sparkSession)
    order = ["tree", "m1", "m2", "doc_id"]
    rows = sets.select("doc_id", "sig").mapInArrow(_orders, "tree int, m1 bigint, m2 bigint, sketch bigint, doc_id bigint")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = checkpointed(rows.mapInArrow(_neighbours, "a bigint, b bigint, border int"))
    # two rows for each partition: a region that goes on in the next partition is tied across the border
    borders = found.filter("border = 1").select(F.col("a").alias("key"), F.col("b").alias("doc"))
    firsts = borders.groupBy("key").agg(F.min("doc").alias("first"))
    across = borders.join(firsts, "key").select(F.col("doc").alias("a"), F.col("first").alias("b"))
    return found.filter("border = 0").select("a", "b").unionByName(across).filter("a <> b").distinct()


def linked(h: np.ndarray, off: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join parts, among the sets left x right (positions): exact sizes of intersections. part: labels of
    sets that are joined already; a set is passed over once all others are of its part."""
    vocabulary, flat = np.unique(h, return_inverse=True)
    n = np.diff(off)
    part = np.arange(len(n)) if part is None else np.unique(part, return_inverse=True)[1]
    marks = np.zeros(len(vocabulary), np.int32)
    lo, hi = right.min(), right.max() + 1  # right is a range of positions
    inner, cuts = flat[off[lo] : off[hi]], off[lo:hi] - off[lo]
    out = []
    same = np.array_equal(left, right)
    for x in left.tolist():
        apart = part[lo:hi] != part[x]
        if same:
            apart[: x - lo + 1] = False
        # sets of too unequal size are no link
        apart &= (den * np.minimum(n[lo:hi], n[x]) >= num * np.maximum(n[lo:hi], n[x])) & (n[lo:hi] > 0)
        if not apart.any():
            continue
        own = flat[off[x] : off[x + 1]]
        marks[own] = 1
        both = np.add.reduceat(marks[inner], cuts)
        marks[own] = 0
        hit = apart & (den * both >= num * (n[x] + n[lo:hi] - both))
        while hit.any():
            y = lo + int(hit.argmax())
            out.append((x, y))
            a, b = part[x], part[y]
            part[part == max(a, b)] = min(a, b)
            hit &= part[lo:hi] != part[x]
    return out


def _settle(size: int, num: int, den: int):
    def body(batches):
        for table in runs(batches, "task"):
            ids = table.column("doc_id").to_numpy()
            side = table.column("side").to_numpy()
            order = np.lexsort((ids, side))  # left block, then right block (0 and 1; 2: both)
            table, ids, side = table.take(pa.array(order)), ids[order], side[order]
            hs, lens = [], []
            for _, _, piece in chunks(texts_of(table.column("text"))):
                h, off = shingles_of(piece, size)
                hs.append(h)
                lens.append(np.diff(off))
            n = np.concatenate(lens)
            h, off = np.concatenate(hs), np.concatenate([[0], np.cumsum(n)])
            if side[0] == 2:
                left = right = np.arange(len(ids))
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(left) and len(right):
                links = linked(h, off, left, right, num, den, table.column("part").to_numpy())
                if links:
                    p = np.array(links)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[p[:, 0]]), pa.array(ids[p[:, 1]])], ["a", "b"])

    return body


def _compared(docs: DataFrame, tasks: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within tasks (task, side, doc_id, part)."""
    rows = tasks.join(docs, "doc_id").repartition(shuffle_partitions(docs.sparkSession), "task").sortWithinPartitions("task")
    return rows.select("task", "side", "doc_id", "part", "text").mapInArrow(_settle(size, num, den), "a bigint, b bigint")


def middles(members: DataFrame) -> DataFrame:
    """(grp, doc_id): PIVOTS documents of each group that agree best with the commonest minima of their group.

    members: (doc_id, grp, members, sig). An original keeps the minima that its edited copies share, so the copies
    agree with it more than with one another."""
    places = range(32)
    value = lambda j: F.substring("sig", 2 * j + 1, 2)
    cells = members.select("grp", F.posexplode(F.array(*[value(j) for j in places])).alias("j", "v")).groupBy("grp", "j", "v").agg(F.count("*").alias("n"))
    modes = cells.groupBy("grp", "j").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    modes = modes.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("mode"))  # 32 cells a group
    modes = checkpointed(modes.join(members.select("grp", "members").distinct(), "grp"))
    both = hot_join(members.drop("members"), modes, ["grp"], "members")
    agree = sum((F.col("mode")[j]["v"] == value(j)).cast("int") for j in places)
    best = both.groupBy("grp", F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS)).alias("lot")).agg(F.max_by("doc_id", F.struct(agree.alias("a"), F.col("doc_id"))).alias("doc_id"))
    return best.select("grp", "doc_id")


def links_of_groups(docs: DataFrame, groups: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """groups (doc_id, grp, sig): links inside each group, enough to hold its linked documents together.

    A group of up to BLOCK documents is one task.  In a larger one every member meets PIVOTS documents from its
    middle, in tasks of BLOCK members; the largest part that this joins is settled.  Each member outside of it then
    meets all members, in square blocks: what stays apart of the largest part is compared with everything."""
    docs = checkpointed(docs.join(groups.select("doc_id"), "doc_id"))  # all texts are shuffled once; what follows reads members only
    sizes = groups.groupBy("grp").agg(F.count("*").alias("members")).filter("members > 1")
    few, many = sizes.filter(F.col("members") <= BLOCK), checkpointed(sizes.filter(F.col("members") > BLOCK))
    one = groups.join(few, "grp").select("doc_id", F.xxhash64("grp").alias("task"), F.lit(2).alias("side"), F.col("doc_id").alias("part"))
    links = _compared(docs, one, size, num, den)
    if many.isEmpty():
        return links
    placed = checkpointed(hot_join(groups, many.withColumn("n", F.col("members")), ["grp"], "n").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")))
    block = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    pivots = middles(placed.select("doc_id", "grp", "members", "sig")).join(many, "grp").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    first = placed.select("doc_id", "grp", block.alias("block"), F.lit(1).alias("side")).unionByName(pivots.select("doc_id", "grp", every, F.lit(0).alias("side")))
    first = first.select("doc_id", F.xxhash64("grp", "block").alias("task"), "side", F.xxhash64("doc_id", "side").alias("part"))
    near = checkpointed(_compared(docs, first, size, num, den))
    parts = components(near.filter("a <> b")).select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
    joined = placed.drop("sig").join(parts, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    joined = checkpointed(joined)
    counts = joined.groupBy("grp", "part").agg(F.count("*").alias("n"))
    largest = checkpointed(counts.groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("rest")))
    # at most BLOCK members of the rest in a block: each is sent once for each block of the group, and back
    largest = largest.filter("rest > 0")
    if largest.isEmpty():
        return links.unionByName(near)
    largest = largest.withColumn("rests", F.ceil(F.col("rest") / BLOCK).cast("int"))
    open_ = checkpointed(hot_join(joined.drop("members"), largest, ["grp"], "members").withColumn("block", block))
    rests = F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("lot")
    right = open_.select("doc_id", "grp", "part", "block", rests, F.lit(1).alias("side"))
    own = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("rests")).cast("int").alias("lot")
    left = open_.filter("part <> main").select("doc_id", "grp", "part", every, own, F.lit(0).alias("side"))
    second = left.unionByName(right).select("doc_id", F.xxhash64("grp", "block", "lot").alias("task"), "side", "part")
    return links.unionByName(near).unionByName(_compared(docs, second, size, num, den))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; threshold as a fraction."""
    num, den = threshold
    texts = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    described = checkpointed(texts.mapInArrow(_describe(size), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary"))
    named = described.filter("n_shingles > 0 and doc_id is not null")
    key = ["k1", "k2", "n_shingles"]
    classes = checkpointed(named.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    heads = named.join(classes.select(F.col("rep").alias("doc_id"), *key), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
    heads = checkpointed(heads.select("doc_id", "sig"))
    weak = components(candidate_edges(heads))
    sigs = heads.groupBy("doc_id").agg(F.min("sig").alias("sig"))
    groups = checkpointed(weak.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")).join(sigs, "doc_id"))
    links = links_of_groups(texts, groups, size, num, den)
    # a repeated id with several texts is one node: their classes are tied
    several = named.groupBy("doc_id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.min("k2").alias("lo2"), F.max("k2").alias("hi2")).filter("lo <> hi or lo2 <> hi2")
    tied = named.join(several.select("doc_id"), "doc_id").join(classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked_to = components(links.unionByName(tied)).select(F.col("node").alias("rep"), "component")
    settled = checkpointed(classes.join(linked_to, "rep", "left").select(*key, "copies", F.coalesce("component", "rep").alias("component_id")))
    out = hot_join(named.select("doc_id", *key), settled, key, "copies").select("doc_id", "n_shingles", "component_id")
    alone = described.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
