"""Benchmark decontamination with a positional inverted index; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flareframe.llm.common import materialise, new_folder

# Characters between words (all ASCII but digits and lower-case letters).
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes up to which a table of test terms is sent to every task; a larger one is joined by shuffle.
MAX_BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Words of the A-Z lower-cased text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, -1), "")


def small(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast only after its bytes have been added up: 16 a value, and those of texts."""
    texts = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind == "string"]
    size = df.agg(sum((F.coalesce(t, F.lit(0)) for t in texts), F.count("*") * (16 * len(df.columns)))).first()[0]
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES else df


class PositionalIndex:
    """Postings (t, id, pos) of the terms of ``items`` in ``docs``, stored as Parquet in the shared folder.

    ``items``: (item_id string, w array<string>).  Only terms that some item has are stored: no other list can be
    asked for.  ``terms``: (term, t, df), df = postings of the term.
    """

    def __init__(self, docs: DataFrame, items: DataFrame):
        spark = docs.sparkSession
        self.items = items
        vocabulary = materialise(items.select(F.explode("w").alias("term")).distinct())
        numbered = materialise(vocabulary.withColumn("t", F.monotonically_increasing_id()))
        path = new_folder(spark, "postings")
        (docs.select("id", F.posexplode(words(F.col("text"))).alias("pos", "term")).join(small(numbered), "term")
         .select("t", "id", "pos").write.option("compression", "zstd").parquet(path))
        self.postings = spark.read.schema("t long, id long, pos int").parquet(path)
        df = self.postings.groupBy("t").agg(F.count("*").alias("df"))
        self.terms = materialise(numbered.join(df, "t", "left").select("term", "t", F.coalesce("df", F.lit(0)).alias("df")))

    def rarest(self, window: int, lists: int) -> DataFrame:
        """(item_id, q, t, m): item positions of the ``lists`` rarest terms of every window of an item.

        A window that has a term without postings can't occur and gives none.  m = words of the item.
        """
        m = F.size("w")
        placed = (self.items.where(m > 0).select("item_id", m.alias("m"), F.posexplode("w").alias("q", "term"))
                  .join(self.terms, "term"))
        first = F.greatest(F.lit(0), F.col("q") - window + 1)
        last = F.least(F.col("q"), F.greatest(F.lit(0), F.col("m") - window))
        each = placed.select("item_id", "m", "q", "t", "df", F.explode(F.sequence(first, last)).alias("s"))
        by_rarity = Window.partitionBy("item_id", "s").orderBy("df", "q")
        ranked = each.withColumn("r", F.row_number().over(by_rarity)) \
            .withColumn("least", F.min("df").over(Window.partitionBy("item_id", "s")))
        return ranked.where((F.col("r") <= lists) & (F.col("least") > 0)).select("item_id", "q", "t", "m").distinct()

    def diagonals(self, window: int, lists: int = 2) -> DataFrame:
        """(item_id, id, diag): where the offset-adjusted lists of the rarest terms meet.

        diag = document position - item position.  Lists are intersected by counting the distinct item positions
        that fall on the same diagonal; an occurrence of a window puts its ``lists`` rarest terms there.
        """
        anchors = materialise(self.rarest(window, lists))
        points = self.postings.join(small(anchors), "t").select("item_id", "id", "m", (F.col("pos") - F.col("q")).alias("diag"))
        met = points.groupBy("item_id", "id", "diag", "m").agg(F.count("*").alias("n"))
        return met.where(F.col("n") >= F.least(F.lit(lists), F.col("m"))).select("item_id", "id", "diag")

    def phrases(self, docs: DataFrame, window: int, lists: int = 2) -> DataFrame:
        """(id, item_id, start, length): every exact occurrence of a window, checked word by word."""
        wanted = (materialise(self.diagonals(window, lists)).join(self.items, "item_id")
                  .groupBy("id").agg(F.collect_list(F.struct("item_id", "diag", F.col("w").alias("iw"))).alias("c")))
        found = docs.join(wanted, "id").select("id", words(F.col("text")).alias("dw"), "c")
        length = F.least(F.lit(window), F.size("e.iw"))

        def equal(c: Column) -> Column:
            return F.transform(c["iw"], lambda x, j: F.coalesce(F.get("dw", c["diag"] + j) == x, F.lit(False)))
        checked = found.select("id", F.explode(F.transform("c", lambda c: F.struct(
            c["item_id"].alias("item_id"), c["diag"].alias("diag"), c["iw"].alias("iw"), equal(c).alias("eq")))).alias("e"))
        begins = F.filter(F.sequence(F.lit(0), F.size("e.iw") - length),
                          lambda j: F.forall(F.slice("e.eq", j + 1, length), lambda x: x))
        return checked.select("id", "e.item_id", "e.diag", length.alias("length"), F.explode(begins).alias("j")) \
            .select("id", "item_id", (F.col("diag") + F.col("j")).alias("start"), "length")

    def near(self, within: int, lists: int = 3) -> DataFrame:
        """(id, item_id, start): places where the ``lists`` rarest terms of an item all lie within ``within`` words.

        In any order; start is the rarest term's position.  Positions meet through blocks of ``within`` words, so a
        posting is compared with those of three blocks at most.
        """
        per = Window.partitionBy("item_id").orderBy("df", "t")
        terms = (self.items.select("item_id", F.explode(F.array_distinct("w")).alias("term")).join(self.terms, "term")
                 .withColumn("r", F.row_number().over(per)).where(F.col("r") <= lists).select("item_id", "t", "r"))
        hits = self.postings.join(small(materialise(terms)), "t")
        need = terms.groupBy("item_id").agg(F.count("*").alias("need"))
        head = hits.where("r = 1").select("item_id", "id", F.col("pos").alias("start"), F.expr(f"pos div {within}").alias("b"))
        rest = hits.where("r > 1").select("item_id", "id", "pos", "r", F.expr(f"explode(sequence(pos div {within} - 1, pos div {within} + 1))").alias("b"))
        both = head.join(rest, ["item_id", "id", "b"], "left").where(
            F.col("pos").isNull() | (F.abs(F.col("pos") - F.col("start")) <= within))
        return (both.groupBy("item_id", "id", "start").agg((F.count_distinct("r") + 1).alias("n"))
                .join(need, "item_id").where("n = need").select("id", "item_id", "start"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  unique: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every document.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item that has words; a document
    word is hit inside any exact occurrence of a window; ``items`` are the ids, as sorted strings, of those with
    occurring windows; contaminated: n_hit > 0 and share * n_hit >= n_words.

    Null texts have no words and are not contaminated.  Rows that share an id, or have none, are documents of their
    own: rows are stored once with a number, and are indexed and answered by it (``unique`` says that the ids are
    such numbers already).  Items with one id are separate texts of that id; null item ids are left out of ``items``
    but hit words.  Empty tables give no rows or no hits; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    stored = rows.withColumn("row", F.col("id"))
    if not unique:
        path = new_folder(docs.sparkSession, "numbered-texts")
        rows.select(F.monotonically_increasing_id().alias("row"), "id", "text").write.option("compression", "zstd").parquet(path)
        stored = docs.sparkSession.read.schema("row long, id long, text string").parquet(path)
        rows = stored.select(F.col("row").alias("id"), "text")
    marked = items.select(F.col(item_col).cast("string").alias("name"), words(F.col(item_text_col)).alias("w"))
    tests = materialise(marked.where(F.size("w") > 0).withColumn("item_id", F.monotonically_increasing_id()))
    index = PositionalIndex(rows, tests.select("item_id", "w"))
    found = index.phrases(rows, window).join(tests.select("item_id", "name"), "item_id")
    spans = F.flatten(F.transform("m", lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1)))
    hits = (found.groupBy("id").agg(F.collect_set(F.struct("start", "length")).alias("m"),
                                    F.array_sort(F.collect_set("name")).alias("items"))
            .select(F.col("id").alias("hit_id"), F.size(F.array_distinct(spans)).cast("long").alias("n_hit"), "items"))
    sized = stored.select("row", "id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sized.join(hits, F.col("row") == F.col("hit_id"), "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
