"""Alignment of two tokenizers: every distinct text aligned once, pair counts weighted by its copies."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flareframe.llm.common import materialise
from flareframe.llm.tokens import byte_alphabet

#: Pairs of token ids up to which their counts (20 bytes each) are sent to every task; more are joined by shuffle.
MAX_BROADCAST_PAIRS = 1_000_000
#: Aligned units that a worker process remembers, in two halves of so many, and links gathered before they are counted.
ENTRIES, GATHER = 80_000, 1 << 20
#: A blank before the first, or after a character that is no white space, ends what both tokenizers cut alone.
UNIT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
SPACE = "▁"
# Fixed value: how a byte-level BPE cuts text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _quick(tok, path: str) -> Callable[[str], list[int]] | None:
    """A faster encoder of the same ids, if the file is a plain byte-level BPE whose ids rise with the merges.

    It takes a pre-token that is an entry without merging, so every entry is encoded both ways first; None if any
    differs.
    """
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model, back = spec.get("pre_tokenizer") or {}, spec["model"], {c: b for b, c in byte_alphabet().items()}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer") \
            or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    special = {a["content"] for a in spec.get("added_tokens") or []}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(c not in back for t in vocab for c in t) or merged != sorted(set(merged)) or min(merged, default=0) < 256 \
            or any(len(t) == 1 and i > 255 for t, i in vocab.items()):
        return None
    ranks = {bytes(map(back.__getitem__, t)): i for t, i in vocab.items()}
    of = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    some = [t.decode("utf-8", "ignore") for t in ranks]
    same = all(of(t) == x.ids for t, x in zip(some, tok.encode_batch_fast(some, add_special_tokens=False)))
    return of if same else None


class Aligner:
    """Ids, groups and links of a text under a byte-level BPE (A) and a sentence-piece BPE (B).

    Both see the text with a blank in front.  Neither merges across the place between a character that is no white
    space and a blank: A's pre-tokens end there, and no piece of B has a blank after another character (checked when
    the model is loaded; else texts are aligned whole).  So a text is a sequence of units, and aligned units are
    remembered.  Other marks of the model's normaliser are noticed because bytes are compared.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True                   # their strings in texts are plain text
        self.quick = _quick(self.a, path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in byte_alphabet().items()}
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(map(back.__getitem__, token)) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.name_a, self.name_b = list(map(str, range(len(self.bytes_a)))), list(map(str, range(len(self.bytes_b))))
        self.blank = self.b.piece_to_id(SPACE)
        plain = all(SPACE not in p.lstrip(SPACE) for p in pieces) and not self.b.is_unknown(self.blank)
        self.unit = UNIT if plain else re.compile(".+", re.DOTALL)
        self.known: dict[str, tuple | bool] = {}
        self.older: dict[str, tuple | bool] = {}

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """The model writes a blank before what it gets, but nothing for the empty text."""
        return [ids or [self.blank] for ids in self.b.encode([u[1:] for u in units])]

    def pair(self, unit: str, a: list[int], b: list[int]) -> tuple[int, str, bytes] | bool:
        """Numbers of tokens (A << 32 | B), the groups in text form, the links as (a << 32 | b); False if bytes differ."""
        raw = unit.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return False
        size_a, size_b, name_a, name_b = self.size_a, self.size_b, self.name_a, self.name_b
        groups, links, text_a, text_b = [], [], "", ""
        ids_b, end_a, end_b = iter(b), 0, 0
        for x in a:
            end_a += size_a[x]
            text_a = f"{text_a},{name_a[x]}" if text_a else name_a[x]
            while end_b < end_a:
                y = next(ids_b)
                end_b += size_b[y]
                text_b = f"{text_b},{name_b[y]}" if text_b else name_b[y]
            if end_a == end_b:
                groups.append(f"{text_a}|{text_b}")
                links.append(x << 32 | y)
                text_a = text_b = ""
        return len(a) << 32 | len(b), ";".join(groups), array("q", links).tobytes()

    def learn(self, units: list[str]) -> dict[str, tuple | bool]:
        found = map(self.quick, units) if self.quick else [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        return {u: self.pair(u, a, b) for u, a, b in zip(units, found, self.ids_b(units))}

    def __call__(self, texts: list[str]) -> list[tuple[int, int, int, str, bytes]]:
        """(n_a, n_b, n_groups, groups, links) of each text."""
        if len(self.known) > ENTRIES:                         # units that are used again move to the new half
            self.older, self.known = self.known, {}
        out, once = [], {}
        cut = [self.unit.findall(f" {t}") if t else [] for t in texts]
        missing = {u for units in cut for u in units}.difference(self.known)
        again = {u: self.older[u] for u in missing if u in self.older}
        for u, x in (self.learn([u for u in missing if u not in again]) | again).items():
            (self.known if len(u) <= 64 else once)[u] = x
        for units in cut:
            got = [self.known[u] for u in units] if not once else [once[u] if u in once else self.known[u] for u in units]
            if not got or False in got:
                out.append((0, 0, 0, "", b""))
            else:
                sizes, groups, links = zip(*got)
                n, links = sum(sizes), b"".join(links)
                out.append((n >> 32, n & 0xFFFFFFFF, len(links) // 8, ";".join(groups), links))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker process and pair of files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _aligned(distinct: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(key, copies, text) to (key, copies, n_a, n_b, n_groups, groups, links)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(path_a, path_b)
        for b in batches:
            for at in range(0, b.num_rows, 128):              # so that few groups are held at a time
                part = b.slice(at, 128)
                a, bb, n, groups, links = zip(*of(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("copies"), pa.array(a, pa.int64()), pa.array(bb, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(groups, pa.string()), pa.array(links, pa.binary())],
                    names=["key", "copies", "n_a", "n_b", "n_groups", "groups", "links"])
            b = part = None                                   # gone before the next batch is read
    return distinct.select("key", "copies", "text").mapInArrow(
        run, "key binary, copies long, n_a long, n_b long, n_groups long, groups string, links binary")


def _pairs(texts: DataFrame) -> DataFrame:
    """(pair, n): links that hold each pair, a text counted once for each of its copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        codes, times, size = [], [], 0

        def counted() -> pd.DataFrame:
            pair, at = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, at, np.repeat(np.array(times, np.int64), [len(c) for c in codes]))
            return pd.DataFrame({"pair": pair, "n": n})
        for b in batches:
            for copies, raw in zip(b["copies"].tolist(), b["links"]):
                codes.append(np.frombuffer(raw, np.int64))
                times.append(copies)
                size += len(codes[-1])
                if size >= GATHER:
                    yield counted()
                    codes, times, size = [], [], 0
        if size:
            yield counted()
    return texts.select("copies", "links").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _measured(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of every text with links; pairs (pair, n, best)."""
    if pairs.count() > MAX_BROADCAST_PAIRS:
        def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for key, raw in zip(b["key"], b["links"]):
                    pair, c = np.unique(np.frombuffer(raw, np.int64), return_counts=True)
                    yield pd.DataFrame({"key": [key] * len(pair), "pair": pair, "c": c})
        each = texts.select("key", "links").mapInPandas(explode, "key binary, pair long, c long").join(pairs, "pair")
        return each.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("c")).otherwise(0)).alias("n_best"),
                                       F.sum(F.col("c") * F.col("n")).alias("count_sum"))
    table = pairs.toPandas().sort_values("pair")
    sent = texts.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, n, best = sent.value
        for b in batches:
            best_, sums = [], []
            for raw in b["links"]:
                at = np.searchsorted(pair, np.frombuffer(raw, np.int64))
                best_.append(int(best[at].sum()))
                sums.append(int(n[at].sum()))
            yield pd.DataFrame({"key": b["key"], "n_best": best_, "count_sum": sums})
    return texts.select("key", "links").mapInPandas(look_up, "key binary, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          keep: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    A is a byte-level BPE file of ``tokenizers``, B a ``sentencepiece`` model; both read the text with a blank in
    front, without special tokens.  Where tokens of both end at one byte, the tokens so far form a group, and every A
    and B token that end there are linked.  ``groups`` holds the ids as ``a1,a2|b1;a3|b2,b3``, or what ``keep`` makes
    of that column, so a digest can be kept in its place.  A pair's count is the number of links of it in the whole
    corpus; n_best counts the text's links whose pair has the highest count of its B id, ties included, and count_sum
    adds up the counts.

    Rows are shuffled by their full text, so copies meet; each distinct text is tokenised and aligned once and counts
    as often as it stands there, and its measures are joined back to the rows by a 256-bit digest.  Pair counts reach
    the tasks as a table of checked size or, beyond ``MAX_BROADCAST_PAIRS``, by a join.

    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and
    ``keep`` of ''.  Rows that share an id are rows of their own; null ids stay; an empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", key)
    texts = materialise(_aligned(distinct, path_a, path_b).withColumn("groups", keep(F.col("groups"))))
    counts = _pairs(texts)
    # the highest count of each B id: B's vocabulary bounds the rows
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    counts = materialise(counts)
    top = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    pairs = materialise(counts.withColumn("b", b_id).join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    measured = _measured(texts, pairs)
    full = texts.select("key", "n_a", "n_b", "n_groups", (F.octet_length("links") / 8).cast("long").alias("n_links"), "groups") \
        .join(measured, "key", "left")
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(F.col(c), zero).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.select("doc_id", key.alias("key")).join(full, "key", "left").select(
        "doc_id", *numbers, F.when(F.col("n_a").isNull(), keep(F.lit(""))).otherwise(F.col("groups")).alias("groups"))
