"""Document fingerprints from closed syncmers, by SQL expressions only.

A document's symbols are its lower-cased words; of a word of more than `LONG_WORD` code points, each code point, so that
text without blanks has anchors too. A k-mer is five symbols; its inner substrings are two symbols long. The
k-mer is chosen if the smallest hash among its inner substrings is that of the first or the last (a closed syncmer), a
choice that depends on the k-mer alone, so equal passages give equal anchors wherever they stand. The fingerprint is
all of the text's anchor hashes in order of position, so that of a passage is part of that of any text that holds it.
Likeness is the Jaccard index of the sets of all anchors of both.

Expressions work on one array per document, never on exploded rows. The next document is found without a global sort:
ids are cut into `CLASSES` classes of about equally many documents, and each class into ranges of equal width that hold
about `RANGE_ROWS` documents; a window looks ahead inside a range, and only the last row of each range is joined with
the head of the next one.

Defined cases: null text equals empty text, whose fingerprint is empty; likeness of two empty fingerprints is 1, of an
empty and another 0. Texts of one to four symbols have one anchor, their whole symbol sequence. Rows that repeat an id are
ordered by text, and rows of one id are one task's; null ids come first, likewise. Ties between inner substrings count
for both edges. One document alone is its own successor. An empty table gives an empty result. Other columns of the
input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_WORDS = 5
#: Longer words are read by code points.
LONG_WORD = 24
CLASSES = 256
RANGE_ROWS = 512
HEADS = 1024


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    def symbols(words: Column) -> Column:
        each = F.transform(words, lambda w: F.when(F.length(w) > LONG_WORD, F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0))).otherwise(F.array(w)))
        return F.when(F.exists(words, lambda w: F.length(w) > LONG_WORD), F.flatten(each)).otherwise(words)

    return let(F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), symbols)


def anchors(text: Column) -> Column:
    """Hashes (32 bits) of the text's closed syncmers, in order of position."""

    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        return let(hashes, lambda h: let(F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)), of_inner))

    def of_inner(s: Column) -> Column:
        n = F.size(s) - 3
        zipped = F.arrays_zip(*(F.slice(s, i + 1, n).alias(name) for i, name in enumerate("abcd")))
        chosen = F.filter(zipped, lambda z: F.least(z["a"], z["b"], z["c"], z["d"]).isin(z["a"], z["d"]))
        return F.transform(chosen, lambda z: F.xxhash64(z["a"], z["b"], z["c"], z["d"]).bitwiseAND(F.lit(0xFFFFFFFF)))

    def chosen(words: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(words, " ")).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.when(F.size(words) >= K_WORDS, of_words(words)).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<long>"))

    return let(_words(text), chosen)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def with_next(docs: DataFrame, value: Column) -> DataFrame:
    """doc_id, value and next: the value of the next row by (doc_id, value), the first row's after the last.

    Both readings of the windowed rows share one exchange; the others move range numbers and range heads only.
    """
    ids = docs.filter("doc_id is not null").select("doc_id")
    borders = sorted({int(q) for q in ids.approxQuantile("doc_id", [i / CLASSES for i in range(1, CLASSES)], 1 / (4 * CLASSES))})
    cuts = F.array(*(F.lit(b).cast("long") for b in borders)) if borders else F.array().cast("array<long>")
    class_ = F.size(F.filter(cuts, lambda b: F.col("doc_id") >= b))
    # at most CLASSES rows
    sizes = {r.c: r for r in ids.groupBy(class_.alias("c")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).collect()}
    found = [sizes.get(c) for c in range(len(borders) + 1)]
    low = F.array(*(F.lit(r.low if r else 0).cast("long") for r in found))
    width = F.array(*(F.lit(max(1, -(-(r.high - r.low + 1) * RANGE_ROWS // r.n)) if r else 1).cast("decimal(20,0)") for r in found))
    inside = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.get(low, class_).cast("decimal(20,0)")) / F.get(width, class_)).cast("long")
    # null ids have a range of their own before all others
    number = F.coalesce(class_.cast("long") * F.lit(1 << 40) + inside, F.lit(-(2**52)))
    order = Window.partitionBy("range").orderBy(F.asc_nulls_first("doc_id"), "value")
    rows = docs.select("doc_id", value.alias("value"), number.alias("range")).withColumns({"next": F.lead("value").over(order), "first": F.lag(F.lit(True)).over(order).isNull()})
    heads = rows.filter("first").select("range", F.floor(F.col("range") / HEADS).alias("upper"), F.col("value").alias("head"))
    numbers = docs.select(number.alias("range")).distinct().withColumn("upper", F.floor(F.col("range") / HEADS))
    ahead = numbers.withColumn("target", F.lead("range").over(Window.partitionBy("upper").orderBy("range")))
    # one row for about RANGE_ROWS * HEADS documents
    tops = numbers.groupBy("upper").agg(F.min("range").alias("top"))
    by_upper = Window.orderBy("upper")
    tops = tops.select("upper", F.coalesce(F.lead("top").over(by_upper), F.min("top").over(by_upper.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("jump"))
    links = ahead.join(tops, "upper").select("range", F.coalesce("target", "jump").alias("target"))
    after = links.join(heads.select(F.col("range").alias("target"), F.col("head").alias("after")), "target").select("range", "after")
    # the windowed rows are dealt and sorted by range already: this join moves the heads only
    return rows.join(after, "range", "left").select("doc_id", "value", F.coalesce("next", "after").alias("next"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document and of its text with the second half taken from the next document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("value")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("value"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    return (
        with_next(texts, F.col("text"))
        .select("doc_id", anchors(F.col("value")).alias("print"), anchors(F.col("next")).alias("next_print"), n.cast("long").alias("n_chars"), edited.alias("edited"))
        .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "print", "next_print", anchors(F.col("edited")).alias("edited_print"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("print")).alias("fingerprint"),
            as_text(F.col("edited_print")).alias("edited_fingerprint"),
            likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
            likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        )
    )
