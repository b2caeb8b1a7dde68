"""Repeated passages, found by compacting a De Bruijn graph of the words.

Edges are the runs of ``span`` words. Every edge belongs to a node: the run of ``k`` words with the least hash in
it (leftmost of equal ones), so equal edges belong to equal nodes, at equal places. Successive edges of a document that
belong to the same node form its stretch there. A node whose stretch is the same wherever it occurs does
not branch: its edges are one path that is decided once, for all of them. Only nodes that branch
are opened into single edges. A path or edge is repeated where its source coordinates (document, word)
are not the first ones of its kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWEST, document_key, join_hot, stored, whole_text
from weftline.llm.wordhash import chunks, mix, powers, runs, words

NODE_WORDS = 5

# What tells rows apart, in the order in which one is earlier: the id, and the hash of the text.
ROW = ["doc", "row"]

_ODD = 0xD6E8FEB86659FD93


class Stretches:
    """The stretches of a lot of texts: text number, node, hash of the content, first edge, number of edges, and edge hashes."""

    def __init__(self, texts: list[str], span: int, k: int) -> None:
        hashes, begins = words(texts)
        n = np.diff(begins)
        nodes = runs(hashes, k, 1)
        reach = span - k + 1
        self.begins = begins
        if len(nodes) < reach:
            edges = np.zeros(0, np.int64)
            least = edges
        else:
            views = np.lib.stride_tricks.sliding_window_view(nodes, reach)
            text = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(views))
            inside = at + span <= begins[text[: len(views)] + 1]
            edges = at[inside]
            least = edges + views[edges].argmin(axis=1) if len(edges) else edges
        change = np.ones(len(edges), bool)
        change[1:] = (least[1:] != least[:-1]) | (edges[1:] != edges[:-1] + 1)
        lead = np.flatnonzero(change)
        self.first = edges[lead]
        self.count = np.diff(np.concatenate([lead, [len(edges)]]))
        self.text = np.searchsorted(begins, self.first, side="right") - 1
        self.node = nodes[least[lead]]
        rising = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes)), dtype=np.uint64)])
        stop = self.first + self.count + span - 1
        inverse = np.uint64(pow(int(powers(2)[1]), -1, 2**64))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), inverse, np.uint64)]))
        whole = (rising[stop] - rising[self.first]) * back[self.first]
        place = (least[lead] - self.first) * 4096 + self.count
        self.content = mix(whole + mix(place.astype(np.uint64) * np.uint64(_ODD)))
        self.edges = runs(hashes, span, 77)

    def first_here(self, *keys: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Whether a row is the first of its text with these keys; rows come in reading order."""
        order = np.lexsort((np.arange(len(text)), *keys, text))
        same = np.ones(max(0, len(order) - 1), bool)
        for c in (*keys, text):
            c = c[order]
            same &= c[1:] == c[:-1]
        out = np.ones(len(order), bool)
        out[order[1:]] = ~same
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lots(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    yield from chunks(list(zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))), 1)


def _row_of(lot: list[tuple], text: np.ndarray) -> dict[str, pa.Array]:
    return {"doc": pa.array(np.array([r[0] for r in lot], np.int64)[text]), "row": pa.array(np.array([r[2] for r in lot], np.int64)[text])}


def _stretch_rows(span: int, k: int, counting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in _lots(batch):
                s = Stretches([r[1] for r in lot], span, k)
                columns = {"node": _signed(s.node), **_row_of(lot, s.text)}
                if counting:
                    columns["content"] = _signed(s.content)
                else:
                    columns["first"] = pa.array((s.first - s.begins[s.text]).astype(np.int32))
                    columns["count"] = pa.array(s.count.astype(np.int32))
                    columns["fresh"] = pa.array(s.first_here(s.node, text=s.text))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _edge_rows(span: int, k: int):
    """Single edges of the stretches whose nodes branch (given by their first words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in _lots(batch):
                s = Stretches([r[1] for r in lot], span, k)
                wanted = np.concatenate([np.array(r[3], np.int64) + b for r, b in zip(lot, s.begins)])
                i = np.flatnonzero(np.isin(s.first, wanted))
                count = s.count[i]
                at = np.repeat(s.first[i] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                text, node = np.repeat(s.text[i], count), np.repeat(s.node[i], count)
                fresh = s.first_here(node, s.edges[at], text=text)
                yield pa.RecordBatch.from_pydict({
                    "node": _signed(node), "edge": _signed(s.edges[at]), **_row_of(lot, text),
                    "first": pa.array((at - s.begins[text]).astype(np.int32)), "fresh": pa.array(fresh),
                })

    return run


def _rest(span: int):
    """The words that no repeated edge covers, none of a text that is a repeat as a whole. Repeated edges come as first word and number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            out = []
            for doc_id, text, first, count, repeat in zip(*(batch.column(i).to_pylist() for i in range(5))):
                found = word.findall(text)
                n = len(found)
                if repeat and n >= span:
                    found = []
                elif first:
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, np.minimum(first, n), 1)
                    np.add.at(cover, np.minimum(np.array(first) + np.array(count) + span - 1, n), -1)
                    found = [w for w, c in zip(found, np.cumsum(cover[:n]).tolist()) if not c]
                out.append((doc_id, n, n - len(found), " ".join(found)))
            ids, n, gone, rest = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(rest, pa.string())],
                ["doc_id", "n_words", "n_removed", "text"])

    return run


def dedup_passages(docs: DataFrame, span: int = 20, k: int = NODE_WORDS) -> DataFrame:
    """Each document without the words of runs of ``span`` words that also start earlier.

    Earlier: in a smaller doc_id, or in the same document at an earlier word. Texts that share an id, or have none, are documents of their own,
    in the order of their hashes. Runs are judged on the input. Returns doc_id,
    n_words, n_removed and text (the words that stay, joined by one space).

    About one node in (span - k + 2) / 2 words is shuffled, as numbers. Nodes that occur once end there; those with one stretch are decided
    by their first document; the rest is opened into single edges, which are counted likewise. Nodes and edges that very many documents hold are
    counted with partial sums and joined over many tasks. Keys have 128 bits (node and content, node and edge).

    Null text: no words. Fewer words than ``span``: nothing removed. Rows that repeat a doc_id and its text stand for one
    document and are treated alike; of equal texts without an id, one is the first, and the others repeat it. A null doc_id is below all others. No rows
    give no rows; other columns are not read.
    """
    texts = docs.select(document_key().alias("doc"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("row"))
    if texts.groupBy(*ROW).agg(F.count("*").alias("copies")).filter("copies > 1").isEmpty():
        texts = texts.withColumn("copies", F.lit(1))
    else:
        texts = stored(texts.groupBy(*ROW).agg(F.first("text").alias("text"), F.count("*").alias("copies")).select("doc", "text", "row", "copies"), "texts")
    occurring = texts.mapInArrow(_stretch_rows(span, k, True), "node long, doc long, row long, content long")
    nodes = stored(
        occurring.groupBy("node").agg(
            F.count("*").alias("rows"), F.min(F.struct(*ROW)).alias("least"), (F.min("content") != F.max("content")).alias("branches"),
        ).filter("rows > 1"), "nodes")
    placed = texts.mapInArrow(_stretch_rows(span, k, False), "node long, doc long, row long, first int, count int, fresh boolean")
    met = join_hot(placed, nodes, ["node"], "rows", [*ROW, "first"])
    marks = stored(
        met.filter("branches or struct(doc, row) > least or not fresh").groupBy(*ROW).agg(
            F.collect_list(F.when(F.col("branches"), F.col("first"))).alias("open"),
            F.collect_list(F.when(~F.col("branches"), F.struct("first", "count"))).alias("gone"),
        ), "marks")
    opened = texts.join(marks.filter(F.size("open") > 0).select(*ROW, "open").hint("shuffle_hash"), ROW).select("doc", "text", "row", "open")
    edges = opened.mapInArrow(_edge_rows(span, k), "node long, edge long, doc long, row long, first int, fresh boolean")
    edges = stored(edges, "edges")
    first = stored(edges.groupBy("node", "edge").agg(F.count("*").alias("rows"), F.min(F.struct(*ROW)).alias("least")).filter("rows > 1"), "first-edges")
    again = join_hot(edges, first, ["node", "edge"], "rows", [*ROW, "first"]).filter("struct(doc, row) > least or not fresh")
    single = stored(again.groupBy(*ROW).agg(F.collect_list(F.struct("first", F.lit(1).alias("count"))).alias("gone")), "single-marks")
    gone = marks.select(*ROW, "gone").unionByName(single).groupBy(*ROW).agg(F.flatten(F.collect_list("gone")).alias("gone"))
    whole = texts.join(gone.hint("shuffle_hash"), ROW, "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.when(F.col("doc") != LOWEST, F.col("doc")).alias("doc"), "text", F.col("gone.first").alias("first"), F.col("gone.count").alias("count"),
        ((F.col("doc") == LOWEST) & (F.col("nth") > 1)).alias("repeat"))
    return whole.mapInArrow(_rest(span), "doc_id long, n_words long, n_removed long, text string")
