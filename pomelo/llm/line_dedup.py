"""Line dedup: range-sorted line hashes, first occurrences in a stream, keep bitmaps per document.

Only hashes are shuffled by key, never lines. They are dealt out in ranges and sorted by hash,
document and position, so the first row of a hash names the one document that keeps the line, and
what follows in other documents is dropped. The result is a bitmap per document, applied to its
text in a last step. DataFrame functions alone, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

LEAST_CHARS = 10
# A hash is hot if it holds more than this share of the lines in a sample of the documents, so there are
# no more hot ones than its inverse. Its rows are spread over parts by document. Both bear on the
# layout only, never on results.
HOT_SHARE, SAMPLED_DOCUMENTS, HOT_PARTS = 1 / 4096, 16, 256
_WHITE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["_h1", "_h2"]
_WORD_BITS = 64


def line_key(line: Column) -> Column:
    """A line without white space at both ends and with A-Z in lower case, other letters as they are."""
    key = F.btrim(line, F.lit(_WHITE))
    plain = F.octet_length(key) == F.length(key)  # only ASCII: lower() changes A-Z alone
    return F.when(plain, F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _text_hash(text: Column) -> Column:
    """Tells rows of one id apart; rows of one id and one text share a bitmap."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """``_doc, _text, _pos`` and 128 bits of hash for each line whose key is long enough."""
    rows = docs.select(F.col(doc_id).alias("_doc"), _text_hash(F.col(text)).alias("_text"), F.posexplode(_lines(F.col(text))).alias("_pos", "_line"))
    keyed = rows.select("_doc", "_text", "_pos", line_key(F.col("_line")).alias("_key")).filter(F.length("_key") >= least_chars)
    return keyed.select("_doc", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def _hot(lines: DataFrame) -> DataFrame:
    """Hashes of at least HOT_SHARE of the sampled lines; at most 1 / HOT_SHARE rows."""
    sample = lines.filter(F.pmod(F.xxhash64("_doc", "_text"), F.lit(SAMPLED_DOCUMENTS)) == 0)
    counted = sample.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter((F.col("_n") > 1) & (F.col("_n") > sample.count() * HOT_SHARE)).select(*_HASH)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents that lose lines: ``doc_id, text_hash, keep, n_dropped``.

    ``keep`` is a compressed bitmap of the lines, counted from 0: an array of ``(word, bits)`` in
    ascending order of ``word``. Bit ``i`` of ``bits`` stands for line ``64 * word + i`` and is 1 if the
    line stays; words of which all lines stay are left out. ``text_hash`` tells rows of one id apart.

    A key of ``least_chars`` code points or more stays in the smallest ``doc_id`` that holds it. Rows of one
    id are one document. Rows without an id are one document, after all others.
    """
    lines = materialize(line_hashes(docs, doc_id, text, least_chars), "lines")
    hot = materialize(_hot(lines), "hot-lines")
    # smallest document of the hot hashes: at most 1 / HOT_SHARE rows
    hot_first = (lines.join(F.broadcast(hot), _HASH).groupBy(*_HASH)
                 .agg(F.min("_doc").alias("_hot_first")).withColumn("_is_hot", F.lit(True)))
    lines = lines.join(F.broadcast(hot_first), _HASH, "left")
    part = F.when(F.col("_is_hot"), 1 + F.pmod(F.xxhash64("_doc"), F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int")
    spread = [*_HASH, "_part"]
    order = ["_doc", "_pos"]
    ranged = lines.withColumn("_part", part).repartitionByRange(*spread)
    in_order = Window.partitionBy(*spread).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    first = F.when(F.col("_is_hot"), F.col("_hot_first")).otherwise(F.first("_doc").over(in_order))
    dropped = ranged.withColumn("_first", first).filter(~F.col("_doc").eqNullSafe(F.col("_first")))
    bit = F.expr(f"shiftleft(1L, _pos % {_WORD_BITS})")
    words = (dropped.withColumn("_word", F.expr(f"_pos div {_WORD_BITS}").cast("int"))
             .groupBy("_doc", "_text", "_word").agg(F.bit_or(bit).alias("_bits")))
    return (words.groupBy("_doc", "_text")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("_word").alias("word"), F.bitwise_not("_bits").alias("bits")))).alias("keep"),
                 F.sum(F.bit_count("_bits")).alias("n_dropped"))
            .select(F.col("_doc").alias("doc_id"), F.col("_text").alias("text_hash"), "keep", "n_dropped"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines of an array that a bitmap of :func:`keep_bitmaps` keeps."""
    full = F.lit(-1).cast("bigint")
    dense = F.aggregate(keep, F.array().cast("array<bigint>"), lambda words, w: F.concat(
        words, F.array_repeat(full, w["word"] - F.size(words)), F.array(w["bits"])))

    def by_words(words: Column) -> Column:
        def stays(_line: Column, i: Column) -> Column:
            word = F.coalesce(F.get(words, F.floor(i / _WORD_BITS).cast("int")), full)
            return F.getbit(word, F.pmod(i, F.lit(_WORD_BITS))) == 1
        return F.filter(lines, stays)
    return F.element_at(F.transform(F.array(dense), by_words), 1)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` reduced to the lines that stay, and ``n_lines`` (before),
    ``n_dropped``; columns of these names are replaced.

    Lines are cut at line feeds and joined by them. A null or empty text is one empty line and stays as it
    is; a text all of whose lines go becomes empty. Repeated rows get equal results; an empty table gives an
    empty one.
    """
    taken = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(t) for c, t in taken.items()])
    own_id, own_text = taken[doc_id], taken[text]
    maps = (keep_bitmaps(own.select(F.col(own_id).alias("d"), F.col(own_text).alias("t")), "d", "t", least_chars)
            .hint("shuffle_hash"))  # small rows; the texts need no sort
    rows = own.withColumn("_text", _text_hash(F.col(own_text)))
    joined = rows.join(maps, rows[own_id].eqNullSafe(maps["doc_id"]) & (rows["_text"] == maps["text_hash"]), "left")
    lines = _lines(F.col(own_text))
    left = F.when(F.col("keep").isNull(), F.col(own_text)).otherwise(F.array_join(kept_lines(lines, F.col("keep")), "\n"))
    shown = [(left if c == text else F.col(t)).alias(c) for c, t in taken.items() if c not in ("n_lines", "n_dropped")]
    return joined.select(*shown, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def line_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for each row: the result of :func:`dedup_lines` in digests."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    done = dedup_lines(narrow, "doc_id", "text", least_chars)
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))
