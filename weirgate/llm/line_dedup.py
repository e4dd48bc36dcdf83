"""Line dedup: which lines of which documents repeat, as compressed bitmaps per document.

Only DataFrame functions. Lines leave their documents as 128-bit hashes with their positions. The hashes
are dealt by range of (hash, document), so that a key that a third of all documents share spans many
tasks, and each range is sorted by hash, document and position. The sorted ranges are streamed into one
row for each key and range (how many documents, which occurrence is first) before the rest of the key's
rows meet.

Defined results: null and empty texts have one empty line; empty keys never count; repeated rows of a
doc_id count as one document, and each of the rows gets its own bitmap; a null doc_id counts as a
document of its own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import cut

#: Fixed values of the contract: what is stripped from both ends, and which letters lose their case.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, body, pos, h1, h2): one row for each line whose key is not empty."""
    keyed = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    ).select("doc_id", "body", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where("key <> ''").select("doc_id", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """(doc_id, body, pos) of each line to drop: its key is in at least `min_docs` documents.

    With `keep_first` the key's first occurrence, by doc_id and then position, stays. The hashes are made
    once, and the repeated keys are written, so that the join may split a hot key among tasks.
    """
    hashes = cut(line_hashes(docs))
    ranged = hashes.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    # Streamed: the first position of each key and document, then one row for each key and range before they meet.
    per_doc = ranged.groupBy("h1", "h2", "doc_id").agg(F.min("pos").alias("pos"))
    keys = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "pos")).alias("first"))
    found = hashes.join(cut(keys.where(F.col("n_docs") >= min_docs)), ["h1", "h2"])
    if keep_first:
        found = found.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    return found.select("doc_id", "body", "pos")


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, body, words): bit p % 64 of words[p div 64] is set if line p goes; words without a set bit are left out."""
    words = dropped.groupBy("doc_id", "body", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return words.groupBy("doc_id", "body").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def line_dedup(docs: DataFrame, min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """Keep bitmaps (doc_id, body, words) of the documents that lose lines; all other documents keep all.

    `body` is xxhash64 of the text, which tells rows of one doc_id apart.
    """
    return drop_bitmaps(repeated_lines(docs, min_docs, keep_first))


def kept_lines(text: Column, words: Column) -> Column:
    """The lines of `text` that its bitmap keeps, in order."""
    word = lambda i: F.coalesce(words[F.floor(i / 64).cast("int")], F.lit(0).cast("long"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)
    return F.filter(lines_of(text), lambda _, i: word(i).bitwiseAND(bit(i)) == 0)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs' doc_id and text, with n_lines, n_dropped and the kept lines joined by newlines."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"))
    bitmaps = bitmaps.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "words")
    joined = docs.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    kept = F.when(F.col("words").isNull(), lines_of(F.col("text"))).otherwise(kept_lines(F.col("text"), F.col("words")))
    return (
        joined.select("doc_id", "text", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), kept.alias("kept"))
        .select("doc_id", "text", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
    )
