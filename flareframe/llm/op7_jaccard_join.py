"""Exact Jaccard join of shingle sets by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flareframe.llm.anchors import grams
from flareframe.llm.common import components, given, materialise, texts_of, unblob

#: Cells of the frequency sketch that orders tokens; its size is fixed, so it can be sent to every task.
CELLS = 1 << 18
#: Tokens of at most so many sets are rare: their sets are paired directly.  Above, combinations of tokens are indexed.
RARE = 16
#: Tokens on either side of a unit of work, and texts taken from a batch at a time; they bound a worker's memory.
BLOCK, SLICE = 400_000, 64
#: Heads that the sets of a combination, and then those of a frequent token, are compared with before pairs are listed.
HEADS, MORE_HEADS = 3, 48
#: Bits of the map that keeps most texts no set is wanted of out of the shuffle; its size is fixed (1 MB).
BITS = 1 << 23


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of A-Z lower-cased text; of all words where there are fewer."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, raw.lower().split()), np.uint64)
    if not len(w):
        return w
    if len(w) < k:
        return np.array([xxhash.xxh64_intdigest(w.tobytes(), seed=len(w))], np.uint64)
    return np.unique(grams(w, k))


def node_of(s: np.ndarray) -> int:
    """One number for all texts with the same set."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed=1)).view(np.int64))


def linked(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * inter >= percent * (a + b - inter)


def like_sized(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def least_shared(percent: int) -> int:
    """Tokens that any two different sets similar enough must share in their extended prefixes: three where their
    intersection is sure to have so many, else two."""
    return min(3, -(-percent // (100 - percent))) if percent < 100 else 3


def prefix_size(n: Column, percent: int) -> Column:
    """Tokens of the extended prefix of a set of ``n``."""
    return F.least(n, n - ((n * percent + 99) / 100).cast("long") + least_shared(percent))


def must_share(a: Column, b: Column, percent: int) -> Column:
    """Tokens that different sets of ``a`` and ``b`` tokens must share in their extended prefixes to be similar enough.

    They share ``both`` tokens at least, so at most ``a - both`` of the first set's are not in the second.  The prefix
    that ends earlier in the order of all tokens has the rest of its tokens in the other prefix as well.
    """
    both = ((percent * (a + b) + 99 + percent) / (100 + percent)).cast("long")
    return F.greatest(F.lit(least_shared(percent)), both + F.least(prefix_size(a, percent) - a, prefix_size(b, percent) - b))


def _slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _frequencies(texts: DataFrame, k: int) -> np.ndarray:
    """Documents per sketch cell, counted over all documents; ``CELLS`` numbers come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in _slices(batches):
            for t in b.column(0).to_pylist():
                np.add.at(total, (shingle_set((t or "").encode(), k) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])
    got = texts.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[got["cell"].to_numpy(dtype=np.int64)] = got["n"]
    return out


def _described(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, d, node, n, prefix): the set of every row, and its least frequent tokens: the Jaccard prefix, extended."""
    more = least_shared(percent)
    sent = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for b in _slices(batches):
            node, size, prefix = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set((text or "").encode(), k)
                n = len(s)
                order = np.lexsort((s, often[(s & np.uint64(CELLS - 1)).astype(np.int64)]))
                node.append(node_of(s) if n else 0)
                size.append(n)
                prefix.append(s[order[:min(n, n - -(-n * percent // 100) + more)]].view(np.int64))
            ends = np.cumsum([0, *map(len, prefix)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("d"), pa.array(node, pa.int64()), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))], names=["id", "d", "node", "n", "prefix"])
    return texts.mapInArrow(run, "id long, d long, node long, n long, prefix array<long>")


def _combinations(nodes: DataFrame) -> DataFrame:
    """(node, n, t sorted frequent tokens) to (key, node, n): neighbouring tokens as one key, so keys are as many as tokens."""
    two = F.transform(F.slice("t", 1, F.size("t") - 1), lambda x, i: F.xxhash64(x, F.get("t", i + 1)))
    return nodes.where(F.size("t") > 1).select(F.explode(two).alias("key"), "node", "n")


def _marks(wanted: DataFrame, *by: str) -> tuple[Column, np.ndarray]:
    """The bit of a row by columns ``by``, and the map, of fixed size, of the bits that wanted rows have."""
    bit = F.pmod(F.xxhash64(*by), F.lit(BITS))
    words = wanted.groupBy((bit / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("m")).toPandas()
    marks = np.zeros(BITS // 64, np.int64)
    marks[words["w"].to_numpy(dtype=np.int64)] = words["m"]
    return bit, marks.view(np.uint64)


def _marked(b: pa.RecordBatch, marks: np.ndarray) -> pa.RecordBatch:
    at = b.column("bit").to_numpy(zero_copy_only=False)
    return b.filter(pa.array((marks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))


def _blobs(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, z): compressed texts of the wanted (node, id, d), one for each node; equal rows are taken once."""
    bit, marks = _marks(wanted, "id", "d")
    sent = texts.sparkSession.sparkContext.broadcast(marks)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=5)
        for b in _slices(batches):
            some = _marked(b, sent.value)
            z = [c.compress((t or "").encode()) for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("id"), some.column("d"), pa.array(z, pa.binary())], names=["id", "d", "z"])
    some = texts.withColumn("bit", bit).mapInArrow(likely, "id long, d long, z binary")
    return some.join(wanted, ["id", "d"]).groupBy("id", "d").agg(F.first("node").alias("node"), F.first("z").alias("z")).select("node", "z")


def _some_blobs(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blobs of most nodes that are not wanted stay out of the shuffle; a join has to follow."""
    bit, marks = _marks(wanted, "node")
    sent = blobs.sparkSession.sparkContext.broadcast(marks)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield _marked(b, sent.value).select(["node", "z"])
    return blobs.withColumn("bit", bit).mapInArrow(likely, "node long, z binary")


def _verified(pairs: DataFrame, sizes: DataFrame, blobs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the distinct pairs (p, q) whose whole sets are similar enough; each pair is looked at once.

    Sets that meet in pairs are brought together in units of work: a set's home is the least set it is paired with,
    homes are split so that a part has about ``BLOCK`` tokens, and the parts of p and q make a unit.  A unit gets the
    texts of its sets once, as compressed text, and then its pairs, which stream by.
    """
    both = pairs.select(F.col("p").alias("node"), F.col("q").alias("other")).union(pairs.select("q", "p"))
    homes = materialise(both.groupBy("node").agg(F.min("other").alias("other"))
                        .select("node", F.least("node", "other").alias("home")).join(sizes, "node"))
    parts = homes.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    place = materialise(homes.join(parts, "home").select(
        "node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("place")))
    placed = materialise(pairs.join(place.withColumnsRenamed({"node": "p", "place": "x"}), "p")
                         .join(place.withColumnsRenamed({"node": "q", "place": "y"}), "q").select(F.xxhash64("x", "y").alias("u"), "p", "q"))
    members = placed.select("u", F.col("p").alias("node")).union(placed.select("u", "q")).distinct()
    rows = members.join(_some_blobs(blobs, place), "node").select("u", "node", F.lit(None).cast("long").alias("other"), "z").union(
        placed.select("u", "p", "q", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        for b in _slices(batches, 4096):
            u, node = (b.column(c).to_numpy() for c in ("u", "node"))
            other = b.column("other").fill_null(0).to_numpy()
            pair = b.column("other").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (node[1:] != node[:-1]) | (pair[1:] != pair[:-1]), [True])))
            a, c = [], []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if unit is None or unit.name != u[s]:
                    unit = _Unit(u[s], percent)
                if pair[s]:
                    found = unit.linked_to(int(node[s]), other[s:e])
                    a.append(np.full(len(found), node[s]))
                    c.append(found)
                else:
                    unit.add(int(node[s]), shingle_set(unblob(b.column("z")[s].as_py()), k))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["a", "b"])
    return (rows.repartition("u").sortWithinPartitions("u", F.col("other").isNotNull(), "node")
            .mapInArrow(run, "a long, b long"))


class _Unit:
    """The sets of one unit of work; pairs are counted by marking one set's tokens and adding up the others' marks."""

    def __init__(self, name: int, percent: int):
        self.name, self.percent, self.sets, self.codes = name, percent, {}, None

    def add(self, node: int, s: np.ndarray) -> None:
        self.sets[node] = s

    def linked_to(self, node: int, others: np.ndarray) -> np.ndarray:
        if self.codes is None:
            all_ = np.unique(np.concatenate(list(self.sets.values())))
            self.codes = {n: np.searchsorted(all_, s) for n, s in self.sets.items()}
            self.marks, self.sets = np.zeros(len(all_), np.int32), {}
        mine, out = self.codes[node], []
        self.marks[mine] = 1
        sizes = np.array([len(self.codes[n]) for n in others.tolist()])
        # some at a time, so that their tokens stay within bounds
        for at in np.split(np.arange(len(others)), np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1):
            codes = np.concatenate([self.codes[n] for n in others[at].tolist()])
            inter = np.add.reduceat(self.marks[codes], np.concatenate(([0], np.cumsum(sizes[at])[:-1])))
            out.append(others[at][linked(inter.astype(np.int64), len(mine), sizes[at], self.percent)])
        self.marks[mine] = 0
        return np.concatenate(out)


def _rare_pairs(shared: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """(p, q): sets that share enough tokens, at least one of them rare; a rare token has at most RARE sets."""
    listed = (shared.where(F.col("df") <= RARE).groupBy("token")
              .agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("m")))
    paired = F.flatten(F.transform("m", lambda x, i: F.transform(
        F.filter(F.slice("m", i + 2, F.size("m")), lambda y: like_sized(x["n"], y["n"], percent)),
        lambda y: F.struct(x["node"].alias("p"), y["node"].alias("q"), must_share(x["n"], y["n"], percent).alias("need")))))
    met = materialise(listed.select(F.explode(paired).alias("p")).select("p.*").groupBy("p", "q")
                      .agg(F.count("*").alias("c"), F.first("need").alias("need")))
    t = frequent.select("node", "t")
    few = (met.where("c < need").join(t.withColumnsRenamed({"node": "p", "t": "tp"}), "p")
           .join(t.withColumnsRenamed({"node": "q", "t": "tq"}), "q")
           .where(F.col("c") + F.size(F.array_intersect("tp", "tq")) >= F.col("need")))
    return met.where("c >= need").select("p", "q").union(few.select("p", "q"))


def _heads(name: str, many: int) -> Column:
    """The sets that come first in ``many`` random orders."""
    return F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(f"{name}{i}")), "node", "n")) for i in range(many)]).alias("heads")


def _stars(rows: DataFrame, heads: DataFrame, by: str, percent: int) -> DataFrame:
    """(p, q, by) of each row's set and its group's heads."""
    return (rows.join(heads, by).select(by, "node", "n", F.explode(F.array_distinct("heads")).alias("h")).where(F.col("node") != F.col("h.node"))
            .where(like_sized(F.col("n"), F.col("h.n"), percent))
            .select(F.least("node", "h.node").alias("p"), F.greatest("node", "h.node").alias("q"), by))


def _hooked(links: DataFrame, steps: int = 2) -> DataFrame:
    """(node, c): equal c only for sets that links connect.  Labels travel ``steps`` links, so it is not the whole closure."""
    both = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c"))
    for _ in range(steps):
        label = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("near")) \
            .join(label, "u").select("u", F.least("near", "c").alias("c"))
    return materialise(label.withColumnRenamed("u", "node"))


def _links(classes: DataFrame, blobs_of, k: int, percent: int) -> DataFrame:
    """(a, b): links that connect whatever is linked; every one is verified on whole sets."""
    need = least_shared(percent)
    postings = classes.select("node", "n", F.explode("prefix").alias("token"))
    tokens = materialise(postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    shared = materialise(postings.join(tokens, "token"))
    often = F.col("df") > RARE
    frequent = materialise(shared.where(often).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
                           .select("node", "n", F.col("t.token").alias("t")))
    sizes = classes.select("node", "n")
    # frequent tokens: the sets of a combination are compared with a few of them
    combined = materialise(_combinations(frequent))
    heads = combined.groupBy("key").agg(F.count("*").alias("size"), _heads("a", HEADS)).where("size > 1").select("key", "heads")
    pairs = materialise(_rare_pairs(shared, frequent, percent).union(_stars(combined, heads, "key", percent).select("p", "q")).distinct())
    wanted = pairs.select(F.col("p").alias("node")).union(pairs.select("q")).union(frequent.where(F.size("t") >= need).select("node"))
    blobs = blobs_of(materialise(wanted.distinct()))
    links = materialise(_verified(pairs, sizes, blobs, k, percent))
    # sets of a frequent token that links connect already need not be compared; the rest meets more heads of the
    # largest part, and what is still apart then is compared with everything that shares enough tokens with it
    listed = frequent.where(F.size("t") >= need).select("node", "n", "t", F.explode(F.slice("t", F.lit(1), F.size("t") - (need - 1))).alias("x"))
    for last in (False, True):
        rows = materialise((listed if last else listed.drop("t")).join(_hooked(links), "node", "left").withColumn("c", F.coalesce("c", "node")))
        per = rows.groupBy("x", "c").agg(F.count("*").alias("size"))
        groups = per.groupBy("x").agg(F.max_by("c", F.struct("size", "c")).alias("major"), F.count("*").alias("parts"), F.sum("size").alias("all")) \
            .where("parts > 1")
        rest = materialise(rows.join(groups.select("x", "major", "all"), "x"))
        minor = rest.where("c <> major")
        if last:
            # a pair comes out at the first token that both have
            common = F.array_intersect("tp", "t")
            two = minor.select("x", F.col("node").alias("p"), F.col("n").alias("np"), F.col("c").alias("cp"), F.col("t").alias("tp")).join(
                rest, "x").where((F.col("c") != F.col("cp")) & ((F.col("c") == F.col("major")) | (F.col("p") < F.col("node")))
                                 & like_sized(F.col("n"), F.col("np"), percent) & (F.get(common, F.lit(0)) == F.col("x"))
                                 & (F.size(common) >= must_share(F.col("n"), F.col("np"), percent)))
            found = two.select(F.least("p", "node").alias("p"), F.greatest("p", "node").alias("q"))
        else:
            # each set at its most frequent token
            one = minor.groupBy("node", "n").agg(F.max_by("x", F.struct("all", "x")).alias("x"))
            found = _stars(one, rest.where("c = major").groupBy("x").agg(_heads("b", MORE_HEADS)), "x", percent).select("p", "q")
        pairs = materialise(found.distinct())
        links = materialise(links.union(_verified(pairs, sizes, blobs, k, percent)))
    return links


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: connected groups of rows with Jaccard >= percent / 100.

    Rows with equal sets form one class; only classes are joined.  Tokens are put in one order by a fixed-size
    frequency sketch of all documents, rare first, and each set is cut to its Jaccard prefix extended by two tokens, so
    two similar sets share three tokens there (two where similar sets may be too small for three), and more the more alike
    their sizes are (:func:`must_share`).  Tokens of at most ``RARE`` sets are indexed singly and pair their sets
    directly; a pair goes on if it shares enough tokens, rare and frequent.  Of the more frequent tokens, combinations of two neighbours are indexed, and the sets of a combination
    are verified against a few heads.  Then only sets that no verified link connects with the largest part of their
    token's sets go on, first against more heads, at last against everything that shares enough tokens with them.  So
    a large group costs a few comparisons a member unless its members are similar to none.  Whole sets decide every
    link (:func:`_verified`) and nothing is joined without one, so the result is exact but for collisions of 64-bit
    hashes.

    ``percent`` must be over 50.  Null texts and texts without words have no shingles and link with nothing, not even
    with each other; shorter texts are one shingle.  Rows that share an id are separate texts of that id, and
    component_id is the smallest id of a component; null ids are never the smallest and give null where they stand
    alone; an empty table gives no rows; other columns are not read.
    """
    if percent <= 50:
        raise ValueError("percent must be over 50")
    texts = texts_of(docs, id_col, text_col).withColumn("d", F.xxhash64("text"))
    base = materialise(_described(texts, k, percent))
    classes = materialise(base.where("n > 0").groupBy("node").agg(
        F.min(F.struct("id", "d")).alias("r"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))

    def blobs_of(nodes: DataFrame) -> DataFrame:
        return materialise(_blobs(texts, materialise(classes.join(nodes, "node").select("node", "r.id", "r.d"))))
    groups = components(_links(classes, blobs_of, k, percent))
    labelled = base.select(given().alias("id"), "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(groups.withColumnRenamed("id", "node"), "node", "left") \
        .withColumn("label", F.coalesce("component", "node"))
    least = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component_id"))
    return labelled.join(materialise(least), "label", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
