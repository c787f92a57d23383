"""Collocations by dynamic itemset counting: phrases of all lengths counted in cyclic scans of corpus shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flareframe.llm.common import materialise, new_folder, remove_folder

# Bytes that end a piece of text.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bits of the map of phrases that have reached the threshold, a power of two.  Its size is fixed (4 MB), so it can be
#: sent to every task; a phrase that falls on another's bit is counted for nothing, which changes no result.
BITS = 1 << 25
#: Words gathered before a block is written, phrases gathered before they are counted, and words of the corpus for
#: each part of the key space: a part is merged in one task at a time.
BLOCK, GATHER, PART = 1 << 15, 1 << 21, 1 << 20
#: Hashed words that a worker process remembers.
ENTRIES = 300_000
U = np.uint64
_TO_BREAK = bytes.maketrans(BREAKS, b"." * len(BREAKS))
_VOCABULARY = -1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def next_key(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases from those of their first words and their last word; a word is its own key."""
    return _mixed(keys * U(0x9E3779B97F4A7C15) + words)


class _Words(dict):
    """Word of one language to its 64-bit key; 0 is kept for the end of a piece.  ``new``: words not seen before."""

    def __init__(self, lang: str):
        self.seed, self.new = xxhash.xxh64_intdigest(lang.encode(), seed=7), []
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        k = self[word] = xxhash.xxh64_intdigest(word, seed=self.seed) or 1
        self.new.append(word)
        return k


def _write_blocks(docs: DataFrame, shards: int, path: str) -> None:
    """Texts as word keys: blocks of one language, dealt over ``shards``, and the words themselves apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, _Words] = {}
        held: dict[str, list[np.ndarray]] = {}
        turn = TaskContext.get().partitionId()

        def row(shard: int, lang: str, n: int, ids: np.ndarray, names: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([lang], pa.string()), pa.array([n], pa.int64()),
                pa.array([ids.tobytes()], pa.binary()), pa.array([[w.decode() for w in names]], pa.list_(pa.string()))],
                names=["shard", "lang", "n", "ids", "words"])

        def told(lang: str) -> pa.RecordBatch:
            of = words[lang]
            names, of.new = of.new, []
            out = row(_VOCABULARY, lang, 0, np.array([of[w] for w in names], U), names)
            if len(of) > ENTRIES:
                del words[lang]
            return out

        def block(lang: str) -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            ids = np.concatenate(held.pop(lang))
            return row(turn % shards, lang, int(np.count_nonzero(ids)), ids, [])
        sizes: dict[str, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang not in words:
                        words[lang] = _Words(lang)
                    of, cut = words[lang], text.encode().lower().translate(_TO_BREAK).replace(b".", b" . ").split()
                    cut.append(b".")
                    held.setdefault(lang, []).append(np.fromiter(map(of.__getitem__, cut), U, len(cut)))
                    sizes[lang] = sizes.get(lang, 0) + len(cut)
                    if len(of.new) >= BLOCK:
                        yield told(lang)
                    if sizes[lang] >= BLOCK:
                        sizes[lang] = 0
                        yield block(lang)
        for lang in list(held):
            yield block(lang)
        for lang in [x for x in words if words[x].new]:
            yield told(lang)
    (docs.mapInArrow(run, "shard int, lang string, n long, ids binary, words array<string>")
     .write.partitionBy("shard").option("compression", "zstd").parquet(path))


def _sent(spark: SparkSession, bits: np.ndarray) -> Broadcast:
    return spark.sparkContext.broadcast(zstandard.compress(bits.tobytes()))


def _bits(sent: Broadcast) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(sent.value), U)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & U(len(bits) * 64 - 1)
    return (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1


def _phrases(ids: np.ndarray, longest: int, bits: np.ndarray, old: np.ndarray | None = None,
             ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(length, places, keys, before) of one block's active phrases: those whose two subphrases are both marked.

    ``before`` tells which of them were active under the ``old`` map, too.
    """
    keys, at = ids, np.flatnonzero(ids)
    was = None if old is None else np.ones(len(at), bool)
    yield 1, at, keys[at], was
    for length in range(2, longest + 1):
        some, then = np.zeros(len(keys), bool), np.zeros(len(keys) if old is not None else 0, bool)
        mine = keys[at]
        some[at] = _marked(bits, mine)
        if old is not None:
            then[at] = was & _marked(old, mine)
        at = np.flatnonzero(some[:-1] & some[1:])             # first words and last words of the next length
        if not len(at):
            return
        was = None if old is None else then[at] & then[at + 1]
        longer = np.zeros(len(keys) - 1, U)
        longer[at] = next_key(keys[at], ids[at + length - 1])
        keys = longer
        yield length, at, keys[at], was


def _in_parts(keys: np.ndarray, shift: int, *more: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and columns beside them as one row for each part of the key space."""
    part = keys >> U(shift) if shift < 64 else np.zeros(len(keys), U)
    cut = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    cols = [[c[s:e].tobytes() for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())] for c in (keys, *more)]
    return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int64)), *[pa.array(c, pa.binary()) for c in cols]],
                                      names=["part", "keys", "n", "since"][:2 + len(more)])


def _scan(blocks: DataFrame, longest: int, shift: int, now: Broadcast, before: Broadcast | None) -> DataFrame:
    """(part, keys, n): counts of a shard's active phrases that were not yet active when it was last scanned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bits, old = [], 0, _bits(now), None if before is None else _bits(before)

        def counted() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return _in_parts(keys, shift, n.astype(np.int64))
        for b in batches:
            for raw in b.column("ids"):
                for _, _, keys, was in _phrases(np.frombuffer(raw.as_py(), U), longest, bits, old):
                    keys = keys if was is None else keys[~was]
                    if len(keys):
                        held.append(keys)
                        size += len(keys)
                if size >= GATHER:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()
    return blocks.select("ids").mapInArrow(run, "part long, keys binary, n binary")


def _merged(rows: DataFrame, shift: int, least: int, last: int) -> DataFrame:
    """(part, keys, n, since) rows of every part as one ``open`` row, with counts still in their cycle, and one not
    open, with the complete ones (since at most ``last``) of ``least`` or more."""
    kind = "part long, keys binary, n binary, since binary, open boolean"

    def merge(part: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        keys, n, since = (np.concatenate([np.frombuffer(x, d) for x in c]) for c, d in zip(zip(*part), (U, np.int64, np.int32)))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, n, since = keys[first], np.add.reduceat(n[order], first), np.minimum.reduceat(since[order], first)
        done = since <= last
        for open_, some in ((True, ~done), (False, done & (n >= least))):
            if some.any():
                b = _in_parts(keys[some], shift, n[some], since[some])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([open_] * b.num_rows)], names=[*b.schema.names, "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for b in batches:
            for part, *cols in zip(*(b.column(c) for c in ("part", "keys", "n", "since"))):
                if held and part.as_py() != name:
                    yield from merge(held)
                    held = []
                name = part.as_py()
                held.append([c.as_py() for c in cols])
        if held:
            yield from merge(held)
    return rows.select("part", "keys", "n", "since").repartition("part").sortWithinPartitions("part").mapInArrow(run, kind)


class PhraseCounts:
    """Exact counts of all phrases of up to ``longest`` words that occur ``least`` times or more in their language.

    The corpus lies in ``shards`` that are scanned in turn, again and again.  A scan counts all lengths at once: words
    from the first shard on, a longer phrase from the moment when both its subphrases (all words but the last, all but
    the first) have been counted ``least`` times, wherever in the cycle that is, until each shard was read once for
    it.  What has reached the threshold is a bit map; the one of the last visit to the same shard tells which phrases
    have been counted there.  Counts of phrases in their cycle are one table, rewritten by every scan; complete ones
    leave it, and those under the threshold are dropped.  Counts travel in sorted arrays, one for each part of the key
    space, and a task merges a part at a time.  It ends when a full cycle has added nothing to the map.
    """

    def __init__(self, blocks: DataFrame, words: int, longest: int, least: int, shards: int, bits: int = BITS):
        spark, self.longest, self.least = blocks.sparkSession, longest, least
        self.folder, self.scans = new_folder(spark, "phrase-counts"), 0
        shift = 64 - max(0, (words // PART).bit_length())     # parts of the key space, a power of two of them
        bits, state, done, t = np.zeros(bits // 64, U), None, [], 0
        recent = [_sent(spark, bits)]                         # the maps of the last steps, this one's at the end
        while not (len(recent) > shards and all(x is recent[-1] for x in recent)):
            now, before = recent[-1], recent[0] if len(recent) > shards else None
            rows = state
            if now is not before:
                new = _scan(blocks.where(F.col("shard") == t % shards), longest, shift, now, before)
                new = new.withColumn("since", F.unhex(F.repeat(F.lit(np.int32(t).tobytes().hex()), (F.octet_length("n") / 8).cast("int"))))
                rows = new if state is None else new.unionByName(state.drop("open"))
                self.scans += 1
            path = f"{self.folder}/{t:05d}"
            _merged(rows, shift, least, t - shards + 1).write.option("compression", "zstd").parquet(path)
            counts = spark.read.schema("part long, keys binary, n binary, since binary, open boolean").parquet(path)
            marked = self._mark(bits, counts, now)
            recent.append(now if (marked == bits).all() else _sent(spark, marked))
            bits = marked
            if len(recent) > shards + 1 and recent.pop(0) is not recent[0]:
                before.destroy()
            if t >= shards - 1:
                done.append(materialise(self._listed(counts.where("NOT open"))))
            if t:
                remove_folder(spark, f"{self.folder}/{t - 1:05d}")
            state = counts.where("open")
            t += 1
        # what was active before the last cycle began has been counted everywhere, seen early or late
        done.append(materialise(self._listed(state)))
        remove_folder(spark, self.folder)
        self.map, self.frequent = recent[-1], done[0]
        for d in done[1:]:
            self.frequent = self.frequent.unionByName(d)

    def _listed(self, counts: DataFrame) -> DataFrame:
        """(key, n) of the counts that reach the threshold."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for keys, n in zip(b.column("keys"), b.column("n")):
                    keys, n = np.frombuffer(keys.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[n >= least]), pa.array(n[n >= least])], names=["key", "n"])
        return counts.select("keys", "n").mapInArrow(run, "key long, n long")

    def _mark(self, bits: np.ndarray, counts: DataFrame, now: Broadcast) -> np.ndarray:
        """The map with the phrases that have reached the threshold; at most as many numbers as it has reach the driver."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _bits(now)
            for b in batches:
                for keys, n in zip(b.column("keys"), b.column("n")):
                    keys = np.frombuffer(keys.as_py(), U)[np.frombuffer(n.as_py(), np.int64) >= least]
                    at = keys[~_marked(known, keys)] & U(len(known) * 64 - 1)
                    word, of = np.unique(at >> U(6), return_inverse=True)
                    m = np.zeros(len(word), U)
                    np.bitwise_or.at(m, of, U(1) << (at & U(63)))
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(m.view(np.int64))], names=["w", "m"])
        words = counts.select("keys", "n").mapInArrow(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
        out = bits.copy()
        out[words["w"].to_numpy(dtype=np.int64)] |= words["m"].to_numpy(dtype=np.int64).view(U)
        return out

    def map_of(self, phrases: DataFrame) -> Broadcast:
        """The map of the given keys alone."""
        size = len(_bits(self.map))
        at = F.pmod("key", F.lit(64 * size))
        words = phrases.groupBy((at / 64).cast("int").alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("m")).toPandas()
        out = np.zeros(size, U)
        out[words["w"].to_numpy(dtype=np.int64)] = words["m"].to_numpy(dtype=np.int64).view(U)
        return _sent(phrases.sparkSession, out)

    def named(self, blocks: DataFrame, wanted: Broadcast) -> DataFrame:
        """(key, length, lang, w array of word keys) of the blocks' phrases in the map ``wanted``."""
        longest, sent = self.longest, self.map

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, only, held, size = _bits(sent), _bits(wanted), {}, 0

            def told() -> Iterator[pa.RecordBatch]:
                for (lang, length), found in held.items():
                    keys, one = np.unique(np.concatenate([k for k, _ in found]), return_index=True)
                    w = np.concatenate([x for _, x in found])[one]
                    ends = pa.array(np.arange(0, len(keys) * length + 1, length, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), length, np.int32)), pa.array([lang] * len(keys), pa.string()),
                         pa.ListArray.from_arrays(ends, pa.array(w.ravel().view(np.int64)))], names=["key", "length", "lang", "w"])
            for b in batches:
                for lang, raw in zip(b.column("lang").to_pylist(), b.column("ids")):
                    ids = np.frombuffer(raw.as_py(), U)
                    for length, at, keys, _ in _phrases(ids, longest, bits):
                        keys, one = np.unique(keys, return_index=True)
                        some = _marked(only, keys)
                        at = at[one[some]]
                        held.setdefault((lang, length), []).append((keys[some], ids[at[:, None] + np.arange(length)]))
                        size += len(at)
                if size >= GATHER:
                    yield from told()
                    held, size = {}, 0
            yield from told()
        return blocks.select("lang", "ids").mapInArrow(run, "key long, length int, lang string, w array<long>")


def _parts(named: DataFrame) -> DataFrame:
    """(key, length, lang, w, n) with ``parts``: (f, t, k), the key of every contiguous part of the phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32()), ("k", pa.int64())]))
        for b in batches:
            out = []
            for w in b.column("w").to_pylist():
                ids, row = np.array(w, np.int64).view(U), []
                keys = ids
                for length in range(1, len(ids)):
                    if length > 1:
                        keys = next_key(keys[:-1], ids[length - 1:])
                    row += [{"f": i, "t": i + length, "k": k} for i, k in enumerate(keys.view(np.int64).tolist())]
                out.append(row)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "parts"])
    return named.mapInArrow(run, "key long, length int, lang string, w array<long>, n long, parts array<struct<f:int,t:int,k:long>>")


def _worded(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` with the phrase in words: the stored vocabulary is searched for the hashes that are wanted."""
    wanted = rows.select(F.explode("w").alias("h")).distinct()
    known = blocks.where(F.col("shard") == _VOCABULARY).select("ids", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, words in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.as_py(), np.int64)), words.values], names=["h", "word"])
    words = (known.mapInArrow(run, "h long, word string").join(wanted, "h").groupBy("h").agg(F.min("word").alias("word")))
    each = rows.select("key", F.posexplode("w").alias("i", "h")).join(words, "h")
    text = each.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
                                   .alias("phrase"))                                     # at most ``longest`` words
    return rows.join(text, "key")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, cover: int = 80, shards: int = 4,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are A-Z lower-cased and end in pieces at ``. , ; : ! ?`` and line ends; words lie between blanks and tabs.
    n counts a language's words, a = f(phrase) its occurrences within pieces, overlaps included.  Candidates have
    a >= ``least``; a cut after k words gives l = f(first part), r = f(rest) and floor(2000000 a / (l + r)); the least
    of these is the score, the smallest k on ties.  A candidate inside a longer one that has ``cover`` per cent of its
    occurrences or more is dropped.  Order: score, a, both descending, then the phrase's bytes.

    Phrases are counted by :class:`PhraseCounts`.  Words and phrases are told apart by 64-bit hashes.  Null texts are
    empty; null languages are ``und``; repeated rows count each time; an empty table gives no rows; other columns are
    not read.
    """
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "phrase-blocks")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    _write_blocks(texts.where("text <> ''"), shards, path)
    blocks = spark.read.schema("lang string, n long, ids binary, words array<string>, shard int").parquet(path)
    total = materialise(blocks.where("shard >= 0").groupBy("lang").agg(F.sum("n").alias("total")))
    words = total.agg(F.sum("total")).first()[0] or 0
    counted = PhraseCounts(blocks.where("shard >= 0"), words, longest, least, shards)
    frequent = materialise(counted.frequent)
    some = [blocks.where("shard = 0"), blocks.where("shard > 0")]                   # the rest names what the first shard has not
    names = materialise(counted.named(some[0], counted.map).join(frequent, "key").dropDuplicates(["key"]))
    missing = materialise(frequent.join(names, "key", "left_anti"))
    names = names.unionByName(counted.named(some[1], counted.map_of(missing)).join(missing, "key").dropDuplicates(["key"])) \
        .select("key", "length", "lang", "w", "n")
    known = materialise(_parts(names))
    big = known.where("length > 1")
    # inside a longer phrase with nearly all occurrences
    inner = (big.where("length > 2").select("n", F.explode("parts").alias("p")).where("p.t - p.f > 1")
             .groupBy(F.col("p.k").alias("key")).agg(F.max("n").alias("most")))
    wide = "decimal(38,0)"
    left = big.join(inner, "key", "left").where(
        F.col("most").isNull() | (F.lit(100).cast(wide) * F.col("most") < F.lit(cover).cast(wide) * F.col("n")))
    cuts = left.select("key", "length", "n", F.explode("parts").alias("p"))
    count = frequent.select(F.col("key").alias("k"), F.col("n").alias("f"))
    heads = cuts.where("p.f = 0").select("key", "n", F.col("p.t").alias("at"), F.col("p.k").alias("k")).join(count, "k") \
        .select("key", "n", "at", F.col("f").alias("l"))
    tails = cuts.where("p.t = length").select("key", F.col("p.f").alias("at"), F.col("p.k").alias("k")).join(count, "k") \
        .select("key", "at", F.col("f").alias("r"))
    score = F.expr(f"CAST(2000000 AS {wide}) * CAST(n AS {wide}) div (CAST(l AS {wide}) + CAST(r AS {wide}))")
    best = (heads.join(tails, ["key", "at"]).select("key", F.struct(score.alias("score"), "at", "l", "r").alias("c"))
            .groupBy("key").agg(F.min("c").alias("c")))
    scored = left.join(best, "key").select("key", "lang", "w", F.col("n").alias("a"), F.col("c.l").alias("l"), F.col("c.r").alias("r"),
                                           F.col("c.score").alias("score"))
    # the best of each hashed part of a language first, so that no task ranks a whole language
    order = [F.desc("score"), F.desc("a")]
    some = scored.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)))
    some = some.withColumn("z", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("z") <= top)
    some = some.withColumn("z", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("z") <= top).drop("z", "salt")
    worded = _worded(materialise(some), blocks)
    ranked = worded.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).join(total, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
