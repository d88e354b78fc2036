"""Problem 6: the whole corpus in ids of a public tokenizer, each distinct word encoded once.

1. Spark splits every text into the tokenizer's words with its own pattern, whole texts at a time.
2. Documents are dealt to blocks by hash. The distinct words of each block are kept, so however often a word occurs it is
   one row a block.
3. Each distinct word of the corpus is encoded once; its ids are joined back to the blocks that hold it. A word of very many blocks
   meets a broadcast (:mod:`vellum.operators.skew`).
4. Block by block, positions look their word up in the block's dictionary, in whole columns, and ids are laid end to end.

Decoding joins ids with the table of pieces, whose size is that of the vocabulary, in whole columns too: nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.skew import HEAVY_ROWS, HEAVY_SHARE, join_on_unique
from vellum.session import Scratch, rows_of, table

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The tokenizer's word pattern, white space spelt as the Unicode property (Java's \\s is ASCII only). %L and %N are
#: the letters and numbers, see :func:`words_of`.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[%L]+| ?[%N]+| ?[^\p{IsWhite_Space}%L%N]+"
    r"|\p{IsWhite_Space}+(?![^\p{IsWhite_Space}])|\p{IsWhite_Space}+"
)
#: Characters of text that one block should hold.
BLOCK_CHARS = 4_000_000
#: Blocks that share a task at most: a partition holds about 128 million characters.
BLOCKS_A_TASK = 32


def _newer_characters(strange: str) -> tuple[str, str]:
    """Of characters that Java doesn't take for letters or numbers, those that the tokenizer's own splitter does."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    found = {"a": [], "1": []}
    for c in strange:
        for before, kept in found.items():
            if len(split(before + c)) == 1:
                kept.append(c)
    return "".join(found["a"]), "".join(found["1"])


def _ranges(characters: str) -> str:
    points, out = sorted(map(ord, characters)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


_NEWER: dict[str, tuple[str, str]] = {}


def newer_characters(spark: SparkSession) -> tuple[str, str]:
    """Ranges of the letters and of the numbers that are newer than the JVM's Unicode version; executors have the driver's Java."""
    version = spark._jvm.System.getProperty("java.version")
    if version not in _NEWER:
        points = "".join(chr(i) for i in range(0x110000) if unicodedata.category(chr(i))[0] in "LN")
        strange = spark._jvm.org.apache.commons.lang3.RegExUtils.removeAll(points, r"[\p{L}\p{N}]+")
        _NEWER[version] = tuple(map(_ranges, _newer_characters(strange)))
    return _NEWER[version]


def words_of(text: Column) -> Column:
    """The words of a text in order, nothing lost: joined they are the text. NULL gives no words."""
    letters, numbers = newer_characters(SparkSession.active())
    split = lambda l, n: F.regexp_extract_all(text, F.lit(WORD_PATTERN.replace("%L", r"\p{L}" + l).replace("%N", r"\p{N}" + n)), F.lit(0))  # noqa: E731, E741
    words = split("", "")
    if letters + numbers:
        # long lists of ranges are slow to match: only texts with such a character take them, and a look at one range tells most others
        first = min(int(x, 16) for x in re.findall(r"x\{(\w+)\}", letters + numbers))
        words = F.when(text.rlike(rf"[\x{{{first:x}}}-\x{{10ffff}}]") & text.rlike(f"[{letters}{numbers}]"), split(letters, numbers)).otherwise(words)
    return F.coalesce(words, F.array().cast("array<string>"))


def word_encoder(path: str):
    """Encodes lists of single words, without special tokens and without splitting them again."""
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tok.encode_special_tokens = True
    return lambda words: [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) for distinct ``words`` (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or word_encoder(path)
            ids = pa.array(encode(batch.column(0).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def block_count(docs: DataFrame, chars: int) -> int:
    total = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // chars))


def encode_documents(docs: DataFrame, scratch: Scratch, path: str = DEFAULT_TOKENIZER, keep: tuple[str, ...] = ("doc_id",), counts_only: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns of every row of ``docs`` (text, ...) with its ``ids``, or with ``n_tokens`` alone for ``counts_only``.

    One row out for each row in, repeated ones too. NULL and empty texts have no ids. What looks like a special token is
    ordinary text. Columns beyond ``keep`` and ``text`` are left out, so their names can't clash.
    """
    blocks = block_count(docs, block_chars)
    rows = docs.select(*keep, "text").withColumn("_block", F.pmod(F.xxhash64("text", *keep), F.lit(blocks)).cast("int"))
    held = scratch.keep(rows.select("_block", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).distinct())
    # a word has a row for each block that holds it
    words = scratch.keep(held.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    least = max(HEAVY_ROWS, rows_of(held) // HEAVY_SHARE)
    hot = [r["word"] for r in words.where(F.col("n") >= least).select("word").collect()] if blocks >= least else []
    lexicon = join_on_unique(held, encode_words(words, path), "word", "inner", hot)
    # the texts are shuffled, not their words, which take several times the room: they are split again behind the exchange
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = rows.repartition(max(parts, blocks // BLOCKS_A_TASK), "_block").select(*keep, "_block", words_of(F.col("text")).alias("_words"))
    out = rows.select(*keep).schema.add("n_tokens", T.LongType()) if counts_only else rows.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def lay(left: pa.Table, right: pa.Table) -> pa.Table:
        words = left["_words"].combine_chunks() if left.num_rows else pa.array([], pa.list_(pa.string()))
        if isinstance(words, pa.ChunkedArray):
            words = words.chunk(0)
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False)).astype(np.int64)
        at = pc.index_in(words.flatten(), value_set=right["word"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.list_value_length(right["ids"]).to_numpy().astype(np.int64)
        lengths = np.concatenate([[0], np.cumsum(size[at])]) if len(at) else np.zeros(1, np.int64)
        bounds = lengths[np.concatenate([[0], ends]).astype(np.int64)]
        kept = [left[k] for k in keep]
        if counts_only:
            return pa.Table.from_arrays([*kept, pa.array(np.diff(bounds))], names=[*keep, "n_tokens"])
        pieces = right["ids"].combine_chunks()
        pieces = (pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces).flatten().to_numpy()
        start = np.cumsum(size) - size
        flat = np.repeat(start[at] - lengths[:-1], size[at]) + np.arange(lengths[-1]) if len(at) else np.zeros(0, np.int64)
        ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(pieces[flat].astype(np.int32) if len(flat) else np.zeros(0, np.int32)))
        return pa.Table.from_arrays([*kept, ids], names=[*keep, "ids"])

    return lists.groupBy("_block").cogroup(lexicon.groupBy("_block")).applyInArrow(lay, out)


def pieces_table(path: str) -> pa.Array:
    """The bytes of each id, in order of the ids; NULL for one that is no text."""
    import json

    # the byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ... in order
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out: list = [None] * (max(vocab.values(), default=-1) + 1)
    for piece, i in vocab.items():
        if all(c in byte_of for c in piece):
            out[i] = bytes(byte_of[c] for c in piece)
    return pa.array(out, pa.binary())


def decode_documents(encoded: DataFrame, path: str = DEFAULT_TOKENIZER, key: str = "doc_id") -> DataFrame:
    """(key, text) of every row of ``encoded`` (key, ids), repeated ones too; NULL ids give the empty text.

    The pieces go to every task: the vocabulary bounds their size. A batch's ids meet them in one look-up by number.
    """
    table = pieces_table(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            pieces = table.take(ids.flatten())
            size = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))]).astype(np.int64)
            raw = memoryview(b"".join(pieces.to_pylist()))
            bounds = size[ends].tolist()
            texts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    rows = encoded.select(key, "ids")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), Scratch(spark, "p6"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) back from the ids; NULL texts come back empty."""
    return decode_documents(encode_documents(table(spark, sf_dir, "documents"), Scratch(spark, "p6d")))
