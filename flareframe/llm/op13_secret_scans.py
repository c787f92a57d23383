"""Incremental secret scans over a ledger of content-addressed blobs; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flareframe.llm.common import new_folder

# The shapes of a secret, with letters of either case spelled out in the key words.
ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
          "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
#: Put around matches; in texts it is replaced by a character that no rule takes either.
MARK, OTHER = "\u0001", "\u0002"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (Java syntax, leftmost and without overlap) whose ``group`` has ``least`` characters.

    ``pattern`` must match neither the empty text nor U+0001 or U+0002.  ``quick``, if given, is a pattern that every
    text with a finding has.  A rule that is changed needs a new ``version``.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    quick: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def cut(self, text: Column) -> Column:
        """The text cut at the ends of all matches, so that every second part is a match; null where there is none."""
        plain = F.translate(text, MARK, OTHER)
        found = F.regexp_replace(plain, F.lit(self.pattern), F.lit(f"{MARK}$0{MARK}"))
        return F.when(F.rlike(text, F.lit(self.quick or self.pattern)), F.split(found, MARK, -1))

    def holds(self, match: Column) -> Column:
        part = match if self.group == 0 else F.regexp_extract(match, self.pattern, self.group)
        return F.char_length(part) >= self.least


RULES = (Rule("assign", 1, ASSIGN, 2, 8, ASSIGN[:-2] + "{8})"), Rule("access", 1, ACCESS, 0, 16, "AKIA[A-Z0-9]{12}"),
         Rule("hex", 1, HEX, 0, 32, "[0-9a-f]{32}"))


class BlobLedger:
    """Tables in ``folder``: versions (path, blob), blobs (blob, text), scans (blob, rule) and findings.

    A blob is a text under its SHA-256 digest, so any number of paths and historical versions with one content are
    one blob, stored and scanned once.  ``push`` records versions and stores unseen blobs; ``scan`` looks at exactly
    the pairs of blob and rule version without an entry in scans; ``report`` joins findings back to every recorded
    version.  Another ledger on the same folder goes on where the last one ended.  Tables only grow; findings are
    written before their scans, so a scan cut short is repeated, and reading drops what was written twice.
    """

    SCHEMAS = {"blobs": "blob binary, text string", "scans": "blob binary, rule string",
               "findings": "blob binary, rule string, start long, end long"}

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_folder(spark, "blob-ledger")

    def _has(self, table: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _add(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/{table}")

    def table(self, name: str) -> DataFrame:
        if not self._has(name):
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def push(self, versions: DataFrame, paths: list[str], text_col: str = "text") -> None:
        """Record every row as a version of its path (the columns ``paths``) and store blobs not seen before."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        blob = F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob")
        rows = versions.select(F.struct(*paths).alias("path"), blob)
        new = versions.select(blob, text.alias("text")).distinct()
        if self._has("blobs"):
            new = new.join(self.table("blobs").select("blob"), "blob", "left_anti")
        self._add("blobs", new)
        self._add("versions", rows)

    def unseen(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, text, seen): blobs that lack a scan by some rule, with the rules that have looked at them."""
        blobs = self.table("blobs")
        if not self._has("scans"):
            return blobs.withColumn("seen", F.array().cast("array<string>"))
        seen = (self.table("scans").where(F.col("rule").isin([r.key for r in rules]))
                .groupBy("blob").agg(F.collect_set("rule").alias("seen")))              # at most one entry a rule
        return blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))) \
            .where(F.size("seen") < len(rules))

    def scan(self, rules: tuple[Rule, ...] = RULES) -> None:
        """Apply each rule to the blobs that it has not looked at."""
        todo = self.unseen(rules)
        lacks = {r.key: ~F.array_contains("seen", r.key) for r in rules}

        def parts(r: Rule) -> Column:
            measured = F.transform(r.cut(F.col("text")), lambda p, i: F.struct(
                F.char_length(p).cast("long").alias("n"), ((i % 2 == 1) & r.holds(p)).alias("ok")))
            return F.struct(F.lit(r.key).alias("rule"), F.when(lacks[r.key], measured).alias("parts"))
        cut = (todo.select("blob", F.explode(F.array(*[parts(r) for r in rules])).alias("e"))
               .select("blob", "e.rule", F.posexplode("e.parts").alias("i", "p")).select("blob", "rule", "i", "p.*"))
        upto = Window.partitionBy("blob", "rule").orderBy("i")                           # the matches of one text
        placed = cut.withColumn("end", F.sum("n").over(upto))
        self._add("findings", placed.where("ok").select("blob", "rule", (F.col("end") - F.col("n")).alias("start"), "end"))
        pairs = F.filter(F.array(*[F.when(lacks[r.key], r.key) for r in rules]), lambda k: k.isNotNull())
        self._add("scans", todo.select("blob", F.explode(pairs).alias("rule")))

    def report(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The columns of ``paths`` and spans array<struct<kind, start, end>> of every recorded version.

        Spans are code points, end exclusive, by start and then in the order of ``rules``.
        """
        order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
        kind = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
        found = (self.table("findings").where(F.col("rule").isin([r.key for r in rules])).distinct()
                 .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("rule")].alias("o"), "end", "rule")))
                                      .alias("f")))                                       # the findings of one text
        spans = F.transform("f", lambda x: F.struct(kind[x["rule"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        versions = self.spark.read.parquet(f"{self.folder}/versions")
        return versions.join(found.select("blob", spans.alias("spans")), "blob", "left").select(
            "path.*", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:long,end:long>>")).alias("spans"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: BlobLedger | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): the findings of every row, and of every version recorded before.

    Rows enter ``ledger`` (a new one by default) as versions of the path doc_id; only pairs of content and rule
    version that it has not seen are scanned.

    Null texts are empty and have no findings.  Rows that share an id or a text are versions of their own, each with
    its own result; null ids stay; an empty table gives no rows; other columns are not read.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    ledger.push(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])
    ledger.scan(rules)
    return ledger.report(rules)
