"""Document fingerprints from chains of content words that follow common words; DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import document_key, partitions, stored, whole_text

# Common words of English, French, German and Spanish: each is an anchor, all other words are content.
COMMON = tuple(sorted(set(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or our she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qui que sa se son sont sur un une vous "
    "aber als am auf aus bei das dem den der die ein eine einen er es für hat ich im ist mit nach nicht sich sie sind so und vom von war wie zu zum zur "
    "al como con del el ella era está han las lo los más me mi muy no nos para pero por ser sin su sus te una y ya".split())))
CHAIN = 2


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted set of spot signatures (array of long) of column ``text`` as ``out``.

    A signature is the hash of a common word and the next ``chain`` words that are not common, of the lower-cased words of the text.
    A text in which no chain is complete has one signature, the hash of all its words, or of the text itself if it has none.
    """
    words, marks, spots, content = f"_words_{out}", f"_marks_{out}", f"_spots_{out}", f"_content_{out}"
    df = df.withColumn(words, F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    df = df.withColumn(marks, F.transform(words, lambda w: F.when(~w.isin(*COMMON), w)))
    df = df.withColumns({spots: F.array_compact(F.transform(marks, lambda m, i: F.when(m.isNull(), i))), content: F.array_compact(marks)})
    # The j-th common word, at word p, has p - j content words before it.
    chains = F.transform(spots, lambda p, j: F.when(
        p - j + chain <= F.size(content),
        F.xxhash64(F.get(F.col(words), p), *[F.get(F.col(content), p - j + i) for i in range(chain)])))
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.array_compact(chains))))
    whole = F.when(F.size(words) > 0, F.xxhash64(F.lit(1), F.array_join(words, " "))).otherwise(F.xxhash64(F.lit(2), F.col(text)))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(whole))).drop(words, marks, spots, content)


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fingerprint(signatures: str) -> Column:
    """The signature set as a string: 16 hex digits for each, in order."""
    return F.lower(F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s), 16, "0")), ""))


def near_pairs(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """Pairs (a, b) of fingerprints, each named by its smallest doc_id, with a Jaccard similarity of at least ``similarity``; and ``likeness``.

    Documents with equal fingerprints are taken as one (join ``with_signatures`` to know them). Sets are partitioned by length: a range covers lengths
    up to 1 / similarity times its least one, so that partners stand in the same range or in the next. Only sets that share one of
    their first signatures, as many as similar sets cannot all differ in, and whose lengths fit are compared.
    """
    texts = docs.select(document_key().alias("doc"), whole_text().alias("text"))
    sets = with_signatures(texts, "text", "sigs").groupBy("sigs").agg(F.min("doc").alias("doc"))
    sets = stored(sets.withColumn("n", F.size("sigs")).withColumn("range", F.floor(F.log("n") / F.log(F.lit(1 / similarity))).cast("int")), "spot-sets")
    firsts = F.slice("sigs", 1, F.col("n") - F.ceil(F.col("n") * similarity).cast("int") + 1)
    mine = sets.select("doc", "n", "range", F.explode(firsts).alias("sig"))
    theirs = mine.select(F.col("doc").alias("other"), F.col("n").alias("m"), F.explode(F.array(F.col("range"), F.col("range") - 1)).alias("range"), "sig")
    met = mine.join(theirs, ["range", "sig"]).filter((F.col("doc") != F.col("other")) & (F.least("n", "m") >= similarity * F.greatest("n", "m")))
    met = met.select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()
    pairs = met.join(sets.select(F.col("doc").alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("sigs").alias("y")), "b")
    return pairs.select("a", "b", likeness("x", "y").alias("likeness")).filter(F.col("likeness") >= similarity)


def _ranges(docs: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """Cut points that deal the ids to about equal ranges, and the largest id of each range that has one, by rising range."""
    points = docs.agg(F.percentile_approx("doc", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    cuts = sorted(set(points))
    tops = docs.groupBy(_range_of("doc", cuts).alias("range")).agg(F.max("doc").alias("top")).collect()
    return cuts, [r["top"] for r in sorted(tops, key=lambda r: r["range"])]


def _range_of(doc: str, cuts: list[int]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c < F.col(doc)))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc, hash, ...) with ``next_`` copies of ``columns`` from the next row by descending doc, then hash; after the last comes the first.

    Rows are dealt by ranges of ids, a few for each task, and numbered within them. The rows of the largest id of a range also go, as
    guests, to the end of the range above it, and those of the largest id of all to the end of the lowest range.
    """
    cuts, tops = _ranges(docs, 3 * partitions(docs.sparkSession))
    if not tops:
        return docs.withColumns({f"next_{c}": F.col(c) for c in columns})
    home = _range_of("doc", cuts)
    above = dict(zip(tops, [*tops[1:], tops[0]]))
    guest = F.element_at(F.create_map(*[F.lit(v).cast("long") for pair in above.items() for v in pair]), F.col("doc"))
    placed = docs.withColumn("_to", guest).withColumn("_place", F.explode(F.when(
        F.col("_to").isNull(), F.array(F.struct(home.alias("range"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(home.alias("range"), F.lit(False).alias("guest")), F.struct(_range_of("_to", cuts).alias("range"), F.lit(True).alias("guest"))))))
    order = Window.partitionBy("_range").orderBy("_guest", F.desc("doc"), "hash")
    placed = placed.select(*docs.columns, F.col("_place.range").alias("_range"), F.col("_place.guest").alias("_guest"))
    return placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("not _guest").drop("_range", "_guest")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are.

    The edited text has the last half (floor) of the code points replaced by the first as many of the next document by descending doc_id
    (after the last one: the first). Returns doc_id, n_chars, edited_text, signatures, edited_signatures, near_edited and near_next: the Jaccard similarity of
    the document's signatures to those of the edited text, and of the next document. Texts and signatures are shuffled once.

    Null text counts as empty. Rows that repeat a doc_id follow one another by the hash of their texts. A null doc_id is below all
    others. One document is its own next. No rows give no rows; other columns are not read.
    """
    texts = docs.select(document_key().alias("doc"), whole_text().alias("text")).withColumn("hash", F.xxhash64("text"))
    both = with_next(with_signatures(texts, "text", "signatures"), ["text", "signatures"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("edited_text", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    both = with_signatures(both, "edited_text", "edited_signatures")
    return both.select(
        F.when(F.col("doc") != -(2**63), F.col("doc")).alias("doc_id"), "n_chars", "edited_text", "signatures", "edited_signatures",
        likeness("signatures", "edited_signatures").alias("near_edited"), likeness("signatures", "next_signatures").alias("near_next"))
