"""Similarity join of documents on word n-grams, by prefix filters under several global orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import LOWEST, document_key, join_hot, partitions, stored, text_keys, whole_text
from weftline.llm.components import components, merged
from weftline.llm.wordhash import CHUNK_BYTES, chunks, mix, runs, words

SHINGLE = 5
# Least similarity as a fraction.
LEAST = (3, 4)
# The most frequent shingles, so many at most, of those that at least so many sets share within tasks.
FREQUENT, OFTEN = 1 << 20, 8
COUNTED_TOKENS = 1 << 22
# Further global orders: shingles by their hash under these salts.
ORDERS = (0x5BD1E995, 0x27D4EB2F)
# What tells rows apart: the id, and the hashes of the text.
ROW = ["doc", "h1", "h2"]
# Chance orders of a list, members that each one is compared with in an order, and members of a list that are put in order at a time.
CHANCES, LOOKS, TOGETHER = 3, 4, 512
# Words of 64 bits in a set's bitmap, whose bits tell whether an odd number of its shingles fall on them.
BITS = [f"bits{i}" for i in range(16)]
# The least tokens of a set by which its pairs are told apart from those that an earlier list gives.
EARLIER = 16
# Sets whose bitmaps are made at a time, and rows that are taken from or put in a batch at a time.
SETS_AT_ONCE, ROWS_AT_ONCE = 128, 512


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once; for short arrays a good deal faster than ``np.unique``, which hashes."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text: sorted hashes of its runs of ``size`` words, A-Z lower-cased; of fewer words, one of the whole."""
    hashes, begins = words(texts, lower=True)
    grams = runs(hashes, size, 3)
    out = []
    for b, e in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if e - b >= size:
            out.append(_distinct(grams[b : e - size + 1]))
        elif e > b:
            out.append(runs(hashes[b:e], e - b, 1000 + e - b))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    """So many tokens, first in any global order, that similar sets share one of them."""
    return n - (-(-LEAST[0] * n // LEAST[1])) + 1 if n else 0


def _digests(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """128 bits of each set: sums of its tokens, which are hashes, and of their mixed values."""
    ends = np.cumsum([len(s) for s in sets])
    tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
    out = []
    for values in (tokens, mix(tokens ^ np.uint64(0x6A09E667F3BCC909))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])[np.concatenate([[0], ends]).astype(np.int64)]
        out.append(np.diff(sums).view(np.int64).tolist())
    return list(zip(*out))


def _bitmaps(sets: list[np.ndarray]) -> Iterator[list[int]]:
    """Two bitmaps differ in no more bits than their sets do in tokens (the bitmap filter of set similarity joins)."""
    size = 64 * len(BITS)
    for first in range(0, len(sets), SETS_AT_ONCE):
        some = sets[first : first + SETS_AT_ONCE]
        bits = np.concatenate(some) & np.uint64(size - 1)
        bits = bits.astype(np.int64) + np.repeat(np.arange(len(some)) * size, [len(s) for s in some])
        odd = np.bincount(bits, minlength=size * len(some)) & 1
        yield from np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(some), len(BITS)).tolist()


def _lots(batches: Iterator[pa.RecordBatch], at: int = 1) -> Iterator[list[tuple]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(first, ROWS_AT_ONCE)
            yield from chunks(list(zip(*(some.column(i).to_pylist() for i in range(some.num_columns)))), at)


def _rows_of(names_types: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names_types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names_types)], [n for n, _ in names_types])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, digest and bitmap of each row, and, in rows of their own, shingles that different sets share, with their number among about ``COUNTED_TOKENS`` at a time.

    Both come of one pass, since to make the sets costs more than all that is done with them here.
    """
    columns = [(c, pa.int64()) for c in (*ROW, "n", "c1", "c2", *BITS)]
    nothing = lambda names, n: [pa.nulls(n, pa.int64()) for _ in names]
    counted = ["token", "count"]

    def often(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        held.sort()
        again = held[1:] == held[:-1]
        first = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]]))
        last = np.flatnonzero(again & ~np.concatenate([again[1:], [False]]))
        tokens, counts = held[first].view(np.int64), last - first + 2
        for k in range(0, len(tokens), 16 * ROWS_AT_ONCE):
            found = [pa.array(c[k : k + 16 * ROWS_AT_ONCE]) for c in (tokens, counts)]
            yield pa.RecordBatch.from_arrays([*nothing(columns, len(found[0])), *found], [*(c for c, _ in columns), *counted])

    seen: set[tuple[int, int]] = set()
    # One array takes all tokens, which is given back whole; it grows if a set needs more.
    held, size = np.empty(COUNTED_TOKENS + CHUNK_BYTES, np.uint64), 0
    for lot in _lots(batches):
        sets = shingle_sets([r[1] for r in lot])
        digests = _digests(sets)
        rows = _rows_of(columns, [(r[0], *r[2:], len(s), *d, *b) for r, s, d, b in zip(lot, sets, digests, _bitmaps(sets))])
        yield pa.RecordBatch.from_arrays([*rows.columns, *nothing(counted, rows.num_rows)], [*rows.schema.names, *counted])
        for s, d in zip(sets, digests):
            if len(s) and d not in seen:
                seen.add(d)
                if size + len(s) > len(held):
                    held = np.concatenate([held[:size], np.empty(len(s), np.uint64)])
                held[size : size + len(s)] = s
                size += len(s)
        if size > COUNTED_TOKENS:
            yield from often(held[:size])
            size = 0
    if size:
        yield from often(held[:size])


def _new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(class, set) of a task's documents, lot by lot; a set that the task has seen does not come again."""
    seen: set[tuple[int, int]] = set()
    for lot in _lots(batches):
        out = []
        sets = shingle_sets([r[1] for r in lot])
        for s, d in zip(sets, _digests(sets)):
            if len(s) and d not in seen:
                seen.add(d)
                out.append((d[0], s))
        yield out


def _prefixes(frequent):
    """(token, class, set size, whether the token is frequent) for the first tokens of each set: rare ones by hash, then frequent ones by count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        for lot in _new_sets(batches):
            tokens, classes, sizes, hot = [], [], [], []
            for c, s in lot:
                p = prefix_size(len(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    weight = np.where(known[at] == s, counts[at], 0)
                    first = np.lexsort((s, weight))[:p] if weight.any() else np.arange(p)
                    hot.append(weight[first] > 0)
                else:
                    first = np.arange(p)
                    hot.append(np.zeros(p, bool))
                tokens.append(s[first])
                classes.append(np.full(p, c, np.int64))
                sizes.append(np.full(p, len(s), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(hot))],
                    ["token", "class", "n", "hot"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, orders_a: list[np.ndarray], orders_b: list[np.ndarray]) -> bool:
    """The prefixes under every further order must meet before the sets are compared."""
    for x, y in zip(orders_a, orders_b):
        if not np.isin(x, y).any():
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts are similar."""
    def prefixes(s: np.ndarray) -> list[np.ndarray]:
        return [s[np.argsort(mix(s ^ np.uint64(o)))[: prefix_size(len(s))]] for o in ORDERS]

    for lot in _lots(batches, 2):
        texts = {r[0]: r[2] for r in lot} | {r[1]: r[3] for r in lot}
        sets = dict(zip(texts, shingle_sets(list(texts.values()))))
        firsts = {k: prefixes(s) for k, s in sets.items()}
        yield _rows_of([("a", pa.int64()), ("b", pa.int64())], [(r[0], r[1]) for r in lot if _linked(sets[r[0]], sets[r[1]], firsts[r[0]], firsts[r[1]])])


def _size_fits(a: str, b: str) -> Column:
    small, large = F.least(a, b), F.greatest(a, b)
    return LEAST[1] * small >= LEAST[0] * large


def _needed(a: Column, b: Column) -> Column:
    """Tokens that similar sets of these sizes share at least."""
    return F.ceil(F.lit(LEAST[0]) * (a + b) / F.lit(sum(LEAST)))


def _least_shared(a: str, b: str) -> Column:
    """Tokens that two prefixes must share at least: what similar sets share, less what can lie behind the prefixes."""
    rest = lambda n: F.ceil(LEAST[0] * F.col(n) / F.lit(LEAST[1])) - 1
    return F.greatest(_needed(F.col(a), F.col(b)) - F.greatest(rest(a), rest(b)), F.lit(1))


def _slack(na: Column, nb: Column, bits_a: list[Column], bits_b: list[Column]) -> Column:
    """By how many tokens two sets may differ and be similar, less the bits by which they do differ: below 0 they are not. Unknown bits are none."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(bits_a, bits_b)), F.lit(0))
    return na + nb - 2 * _needed(na, nb) - F.coalesce(apart, F.lit(0))


def _check(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Similar pairs of (a, b), which name classes; both texts of a pair, one for each class, meet in one row, hot classes over many tasks."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("pairs"))
    needed = stored(classes.select("node", "rep.*", "same").join(needed.hint("shuffle_hash"), "node"), "pair-classes")
    # Rows of one id and text stand for each other, and however many there are, one of them is taken.
    rows, most_rows, ends, most_ends = needed.agg(F.sum("same"), F.max("same"), F.sum("pairs"), F.max("pairs")).first()
    found = join_hot(texts.withColumn("_at", F.monotonically_increasing_id()), needed.withColumn("_same", F.col("same")).hint("shuffle_hash"), ROW, "_same", ["_at"], (rows, most_rows))
    if (most_rows or 0) > 1:
        found = found.groupBy("node").agg(F.first("text").alias("text"), F.first("pairs").alias("pairs"))
    held = stored(found.select("node", "text", "pairs"), "pair-texts")
    left = join_hot(pairs, held.select(F.col("node").alias("a"), F.col("text").alias("text_a"), "pairs"), ["a"], "pairs", ["b"], (ends, most_ends))
    both = join_hot(left, held.select(F.col("node").alias("b"), F.col("text").alias("text_b"), "pairs"), ["b"], "pairs", ["a"], (ends, most_ends))
    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"), "similar")


def frequent_shingles(shared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, 2^20 at most, and their counts (of repeats within parts of tasks): few enough to send to everyone."""
    counted = stored(shared.groupBy("token").agg(F.sum("count").alias("count")), "shingle-counts")
    rows = counted.filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    tokens, counts = rows["token"].to_numpy().view(np.uint64), rows["count"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _in_several(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, class, n, root, length) of the lists that lie in several components."""
    marked = lists.select("token", "class", "n").join(labels, "class")
    mixed = stored(marked.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("entries")).filter("low <> high"), "mixed")
    return stored(join_hot(marked, mixed.select("token", "entries", F.col("entries").alias("length")), ["token"], "entries", ["class"]), "mixed-lists")


def _by_chance(mixed: DataFrame) -> DataFrame:
    """Pairs (x, y): in several chance orders of each list, each class looks at the few before it, and keeps the one most alike by bitmap for each order.

    A list is ordered in parts, which every order deals anew, and size ranges are shifted from order to order. A list of two has one order.
    """
    order = F.explode(F.when(F.col("length") > 2, F.array(*map(F.lit, range(CHANCES)))).otherwise(F.array(F.lit(0))))
    drawn = mixed.withColumn("order", order).withColumn("draw", F.xxhash64("class", "order")).withColumn(
        "range", F.floor(F.log("n") / float(np.log(LEAST[1] / LEAST[0])) + F.col("order") / F.lit(CHANCES)).cast("int")).withColumn(
        "part", F.pmod("draw", F.ceil(F.col("length") / F.lit(TOGETHER))).cast("int"))
    at = Window.partitionBy("token", "order", "range", "part").orderBy("draw")
    before = F.array(*(F.lag(F.struct("class", "root", "n", *BITS), k).over(at) for k in range(1, LOOKS + 1)))
    met = drawn.withColumn("before", before).withColumn("met", F.explode("before")).filter(F.col("met.root") != F.col("root"))
    slack = _slack(F.col("n"), F.col("met.n"), [F.col(b) for b in BITS], [F.col(f"met.{b}") for b in BITS])
    met = met.select("order", F.col("class").alias("y"), F.col("met.class").alias("x"), slack.alias("slack")).filter("slack >= 0")
    return met.groupBy("order", "y").agg(F.max(F.struct("slack", "x")).alias("best")).select("best.x", "y")


def _across(marked: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (x, y) of classes of different components that share a list, whose bitmaps allow them to be similar, and whose prefixes share enough tokens.

    In a list, what is not of its largest component meets all others, in parts of the list. A pair that several lists
    hold is made in the first of them: not where both classes have a lesser token of their ``EARLIER`` least in common.
    """
    largest = marked.groupBy("token", "root").agg(F.count("*").alias("members")).groupBy("token").agg(
        F.max(F.struct("members", "root")).alias("most"), F.sum("members").alias("entries"))
    largest = stored(largest.select("token", F.col("most.root").alias("largest"), "entries"), "largest-components")
    place = F.row_number().over(Window.partitionBy("class").orderBy("token"))
    least = marked.select("class", "token").withColumn("place", place).filter(F.col("place") <= EARLIER).groupBy("class").agg(F.collect_list("token").alias("least"))
    entries = marked.join(bits, "class").join(least, "class").withColumn("earlier", F.filter("least", lambda t: t < F.col("token")))
    entries = entries.select("token", F.col("class").alias("x"), "n", "root", "earlier", F.ceil(F.col("length") / F.lit(TOGETHER)).cast("int").alias("parts"), *BITS)
    entries = stored(join_hot(entries, largest, ["token"], "entries", ["x"]), "mixed-entries")
    small = entries.filter("root <> largest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = entries.select(
        "token", F.pmod(F.xxhash64("x"), "parts").cast("int").alias("part"), F.col("x").alias("y"), (F.col("root") == F.col("largest")).alias("in_largest"),
        *(F.col(c).alias(f"{c}_y") for c in ("n", "root", "earlier", *BITS)))
    slack = _slack(F.col("n"), F.col("n_y"), [F.col(b) for b in BITS], [F.col(f"{b}_y") for b in BITS])
    pairs = small.join(other, ["token", "part"]).filter(
        (F.col("in_largest") | (F.col("root") < F.col("root_y"))) & _size_fits("n", "n_y") & (slack >= 0) & ~F.arrays_overlap("earlier", "earlier_y"))
    pairs = pairs.select("x", "y", F.col("n").alias("nx"), F.col("n_y").alias("ny")).distinct()
    tokens = entries.groupBy("x").agg(F.collect_list("token").alias("tokens"))
    both = pairs.join(tokens, "x").join(tokens.select(F.col("x").alias("y"), F.col("tokens").alias("others")), "y")
    return both.filter(F.size(F.array_intersect("tokens", "others")) >= _least_shared("nx", "ny")).select("x", "y")


def similar_rows(docs: DataFrame) -> DataFrame:
    """(doc, h1, h2, n, node) for every row of ``docs``: the row's key, the size of its set, and the component of its class (null without shingles).

    See ``similar_documents``, which says the same by document ids.
    """
    spark = docs.sparkSession
    texts = docs.select(document_key().alias("doc"), whole_text().alias("text"))
    keyed = texts.select("doc", "text", *text_keys())
    columns = [*ROW, "n", "c1", "c2", *BITS]
    summed = stored(keyed.mapInArrow(_summaries, ", ".join(f"{c} long" for c in (*columns, "token", "count"))), "set-sizes")
    sizes = summed.filter("token is null").select(*columns)
    same = sizes.filter("n > 0").groupBy(*ROW, "c1", "c2").agg(F.first("n").alias("n"), F.count("*").alias("same"), *(F.first(b).alias(b) for b in BITS))
    classes = same.groupBy("c1", "c2").agg(
        F.min(F.struct(*ROW, "same", *BITS)).alias("rep"), F.first("n").alias("n"), F.sum("same").alias("docs"))
    classes = classes.select(
        "c1", "c2", F.struct(*(f"rep.{c}" for c in ROW)).alias("rep"), "rep.same", "n", "docs", F.monotonically_increasing_id().alias("node"), *(f"rep.{b}" for b in BITS))
    classes = stored(classes, "classes")
    frequent = spark.sparkContext.broadcast(frequent_shingles(summed.filter("token is not null").select("token", "count")))

    entries = texts.mapInArrow(_prefixes(frequent), "token long, class long, n int, hot boolean")
    entries = entries.select(
        "token", "class", "n", "hot", F.floor(F.log("n") / float(np.log(LEAST[1] / LEAST[0]))).cast("int").alias("range"),
        F.when(F.col("hot"), F.pmod(F.xxhash64("class"), F.lit(partitions(spark)))).otherwise(F.lit(0)).cast("int").alias("share"))
    in_list = Window.partitionBy("token", "share").orderBy("range", "n", "class")
    in_range = Window.partitionBy("token", "share", "range").orderBy("n", "class")
    listed = entries.select(
        "*", F.lag("class").over(in_list).alias("before"), F.lead("class").over(in_list).alias("after"), F.first("class").over(in_range).alias("first"))
    listed = listed.filter("before is distinct from class and (hot or before is not null or after is not null)")
    lists = stored(listed.select("token", "class", "n", "hot", "range", "first"), "lists")

    ends = Window.partitionBy("token", "range").orderBy("first")
    shares = lists.filter("hot").select("token", "range", "first").distinct().select("first", F.first("first").over(ends).alias("other"))
    stars = lists.select(F.col("first").alias("x"), F.col("class").alias("y")).unionByName(shares.select(F.col("other").alias("x"), F.col("first").alias("y")))
    stars = stars.filter("x <> y").groupBy("x", "y").agg(F.count("*").alias("times"))
    stars = stars.groupBy("y").agg(F.max(F.struct("times", "x")).alias("best")).select("best.x", "y", "best.times")
    named = lambda pairs: pairs.join(
        classes.select(F.col("c1").alias("x"), F.col("node").alias("a"), F.col("n").alias("na")), "x").join(
        classes.select(F.col("c1").alias("y"), F.col("node").alias("b"), F.col("n").alias("nb")), "y").filter("a <> b")
    likely = named(stars).filter(_size_fits("na", "nb") & (F.col("times") * 4 >= _least_shared("na", "nb")))
    near = _check(stored(likely.select("a", "b").distinct(), "star-pairs"), keyed, classes)
    roots = stored(components(near), "star-roots")

    labels = lambda roots: classes.join(roots, "node", "left").select(
        F.col("c1").alias("class"), F.coalesce("root", "node").alias("root")).groupBy("class").agg(F.min("root").alias("root"))
    # Classes whose first digests are the same by chance share their lists, and no bitmap speaks for both.
    bits = classes.groupBy(F.col("c1").alias("class")).agg(F.count("*").alias("sets"), *(F.first(b).alias(b) for b in BITS))
    bits = bits.select("class", *(F.when(F.col("sets") == 1, F.col(b)).alias(b) for b in BITS))
    mixed = _in_several(lists.select("token", "class", "n").distinct(), labels(roots))
    likely = named(_by_chance(mixed.join(bits, "class")))
    near = _check(stored(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "chance-pairs"), keyed, classes)
    roots = stored(merged(roots, near), "chance-roots")
    marked = _in_several(mixed.select("token", "class", "n"), labels(roots))
    rest = named(_across(marked, bits))
    more = _check(stored(rest.select("a", "b").distinct(), "other-pairs"), keyed, classes)

    final = stored(merged(roots, more), "roots")
    found = classes.join(final, "node", "left").select("c1", "c2", "docs", F.coalesce("root", "node").alias("node"))
    numbered = sizes.filter("n > 0").withColumn("_at", F.monotonically_increasing_id())
    grouped = join_hot(numbered, stored(found, "class-roots"), ["c1", "c2"], "docs", ["_at"]).select(*ROW, "n", "node")
    return grouped.unionByName(sizes.filter("n = 0").select(*ROW, "n", F.lit(None).cast("long").alias("node")))


def similar_documents(docs: DataFrame) -> DataFrame:
    """For each document the smallest doc_id that links reach; documents link at a Jaccard similarity of 0.75 of their 5-word shingles.

    Returns doc_id, n_shingles and component_id, for every row. Documents with equal sets form a class, and one of each class
    is worked on. First order: rare shingles by hash, then frequent ones by count. The prefixes of the classes
    under it are dealt out by shingle. In each shingle's list, sorted by set size, every class meets the
    first of its size range (frequent shingles: by shares, whose first ones meet, too), and is paired with the one it meets most often. Pairs that are similar make up components. Shingles whose
    list then lies in one component are done. In the other lists, classes look at a few others before them in chance orders, and are paired with the most
    alike by bitmaps of their sets, which joins what is left of groups of near copies. In the lists that still hold several components, classes of different
    components are paired once, if their sizes and bitmaps fit and their prefixes share as many shingles as similar sets must. Before two sets are compared, their prefixes under
    each further order must meet, too. So no link between components is lost, and groups of near copies give no more pairs than rows.

    Null, empty or blank texts have no shingles and stay alone. Fewer than five words are one shingle. Rows are
    told apart by id and text: rows that repeat a doc_id, or have none, link if their texts do, and each is in the component of its own text. A
    component that holds rows with and without an id has the smallest id; one of rows without id alone has null. No rows give no rows; other columns are not read.
    """
    rows = stored(similar_rows(docs), "row-roots")
    # The id of a component is the smallest that a row of it has; none has one where no row has an id.
    named = F.when(F.col("doc") != LOWEST, F.col("doc"))
    least = stored(rows.filter("node is not null").groupBy("node").agg(F.min(named).alias("least"), F.count("*").alias("rows")), "least-ids")
    numbered = rows.filter("node is not null").withColumn("_at", F.monotonically_increasing_id())
    linked = join_hot(numbered, least, ["node"], "rows", ["_at"]).select("doc", "n", "least")
    alone = rows.filter("node is null").select("doc", "n", named.alias("least"))
    return linked.unionByName(alone).select(named.alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
