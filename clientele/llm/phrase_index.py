"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by documents: each task cuts its documents into
segments of bounded size and stores, per segment, the sorted positions
(postings) of every term. A segment is one row of a table in the shared
folder. Queries then run on all segments alike: of a test window the rarest
term of the segment gives the candidate starts (position minus the term's
offset), and the lists of the next rarest terms are intersected with it one by
one, each shifted by its offset. A window whose terms are not all in the
segment costs one vectorised look. Nothing is shuffled, so a term or passage
in a third of all documents lengthens lists but gathers nowhere.

Exact phrases have all terms at their places; proximity matches have every
term within ``slop`` words of its place. The test set is a query set: up to
``block_windows`` windows at a time go to the tasks, larger sets run in blocks
over the same stored index, and the spans found are united per document.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, UPPER, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())
SEGMENT = ("segment long, doc_ids array<string>, n_words array<long>, terms array<binary>, counts binary, positions binary")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return WORD.findall(text.encode().translate(_LOW)) if text else []


def _segment(number: int, docs, vocabulary, gap: int = 1) -> dict:
    """One segment; positions count on from document to document with a gap, so no phrase or proximity match spans two."""
    ids, sizes, term_ids, places, base = [], [], [], [], 0
    terms = dict(vocabulary) if vocabulary is not None else {}
    for doc_id, text in docs:
        found = words(text)
        ids.append(doc_id)
        sizes.append(len(found))
        if vocabulary is None:
            t = np.fromiter((terms.setdefault(w, len(terms)) for w in found), np.int64, len(found))
            at = np.arange(len(found))
        else:
            t = np.fromiter(map(terms.get, found, [-1] * len(found)), np.int64, len(found))
            at = np.flatnonzero(t >= 0)
            t = t[at]
        term_ids.append(t)
        places.append(at + base)
        base += len(found) + gap
    t, p = np.concatenate(term_ids), np.concatenate(places)
    order = np.argsort(t, kind="stable")
    t, p = t[order], p[order]
    present, counts = np.unique(t, return_counts=True)
    names = list(terms)
    return {"segment": number, "doc_ids": ids, "n_words": sizes, "terms": [names[i] for i in present],
            "counts": counts.astype("<i8").tobytes(), "positions": p.astype("<i8").tobytes()}


def _build(vocabulary, chars: int, gap: int):
    def run(batches):
        words_of = vocabulary.value if vocabulary is not None else None
        number, held, docs = TaskContext.get().partitionId() << 32, 0, []

        def out():
            return pa.RecordBatch.from_pylist([_segment(number, docs, words_of, gap)], schema=pa.schema([
                ("segment", pa.int64()), ("doc_ids", pa.list_(pa.string())), ("n_words", pa.list_(pa.int64())),
                ("terms", pa.list_(pa.binary())), ("counts", pa.binary()), ("positions", pa.binary())]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if docs and held + len(text or "") > chars:
                    yield out()
                    number, held, docs = number + 1, 0, []
                docs.append((doc_id.as_py(), text))
                held += len(text or "")
        if docs:
            yield out()
    return run


def build_index(docs: DataFrame, vocabulary=None, id_col: str = "doc_id", text_col: str = "text",
                segment_chars: int = 4_000_000, slop: int = 0) -> DataFrame:
    """Store the postings of all documents (of the terms in ``vocabulary``, a
    dict term -> number; of every term if None) and return the index table, for
    proximity with ``slop``: two words that are each off by it are ``2 * slop + 1`` places apart."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(_build(shared, segment_chars, 2 * slop + 1), SEGMENT), "postings")


def windows(items, length: int) -> dict[tuple, set]:
    """Windows of ``length`` words (a shorter item is one window) -> ids of the items that have them."""
    out: dict[tuple, set] = {}
    for item_id, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - length + 1) if ws else 0):
            out.setdefault(tuple(ws[i:i + length]), set()).add(str(item_id))
    return out


def _inside(postings: np.ndarray, at: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each place has a posting exactly there, and one at most ``slop`` away."""
    i = np.searchsorted(postings, at - slop)
    near = postings[np.minimum(i, len(postings) - 1)]
    near = (i < len(postings)) & (near <= at + slop)
    if slop == 0:
        return near, near
    j = np.searchsorted(postings, at)
    return (j < len(postings)) & (postings[np.minimum(j, len(postings) - 1)] == at), near


def match_segment(row: dict, queries, slop: int):
    """Matches ``(query, starts of exact phrases, starts of proximity matches only)`` in a segment."""
    terms, counts = row["terms"], np.frombuffer(row["counts"], "<i8")
    places = np.split(np.frombuffer(row["positions"], "<i8"), np.cumsum(counts)[:-1]) if len(counts) else []
    names, table, lengths = queries["terms"], queries["table"], queries["lengths"]
    local = {t: i for i, t in enumerate(terms)}
    slot = np.array([local.get(t, -1) for t in names] + [-2], np.int64)  # the last one pads short windows
    mapped = slot[table]
    for q in np.flatnonzero((mapped != -1).all(axis=1)):
        ts = mapped[q, :lengths[q]]
        order = np.argsort(counts[ts], kind="stable")
        starts = places[ts[order[0]]] - order[0]
        exact = np.ones(len(starts), bool)
        for k in order[1:]:
            there, near = _inside(places[ts[k]], starts + k, slop)
            starts, exact = starts[near], (exact & there)[near]
            if not len(starts):
                break
        if len(starts):
            yield q, starts[exact], starts[~exact]


def _query(shared, slop: int):
    def run(batches):
        queries = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]  # one segment at a time as Python objects
                sizes = np.array(row["n_words"], np.int64)
                base = np.cumsum(sizes + 2 * slop + 1) - sizes - 2 * slop - 1
                spans, near, items = [[] for _ in sizes], np.zeros(len(sizes), np.int64), [set() for _ in sizes]
                for q, starts, close in match_segment(row, queries, slop):
                    size = int(queries["lengths"][q])
                    doc = np.searchsorted(base, starts, side="right") - 1
                    for d, s in zip(doc.tolist(), (starts - base[doc]).tolist()):
                        spans[d].append((s, s + size))
                        items[d] |= queries["items"][q]
                    np.add.at(near, np.searchsorted(base, close + slop, side="right") - 1, 1)  # a start may lie before its text
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([row["segment"]] * len(sizes), pa.int64()), "n": pa.array(range(len(sizes)), pa.int64()),
                    "doc_id": pa.array(row["doc_ids"], pa.string()), "n_words": pa.array(sizes, pa.int64()),
                    "starts": pa.array([[a for a, _ in union(s)] for s in spans], pa.list_(pa.int64())),
                    "ends": pa.array([[z for _, z in union(s)] for s in spans], pa.list_(pa.int64())),
                    "items": pa.array([sorted(i) for i in items], pa.list_(pa.string())), "n_near": pa.array(near, pa.int64())})
    return run


def union(spans) -> list[tuple[int, int]]:
    """Union of spans as sorted, disjoint spans."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


MATCHES = "segment long, n long, doc_id string, n_words long, starts array<long>, ends array<long>, items array<string>, n_near long"


def search(index: DataFrame, found: dict[tuple, set], length: int, slop: int = 0) -> DataFrame:
    """Spans of the windows ``found`` in every indexed document."""
    names = sorted({t for w in found for t in w})
    number = {t: i for i, t in enumerate(names)}
    table = np.full((len(found), length), len(names), np.int64)
    for i, w in enumerate(found):
        table[i, :len(w)] = [number[t] for t in w]
    shared = index.sparkSession.sparkContext.broadcast(
        {"terms": names, "table": table, "lengths": np.array([len(w) for w in found], np.int64), "items": list(found.values())})
    return index.mapInArrow(_query(shared, slop), MATCHES)


def _united(starts, ends):
    out = union(list(zip(starts, ends)))
    return [a for a, _ in out], [z for _, z in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, slop: int = 1, block_windows: int = 500_000,
                  segment_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, n_words, starts, ends, n_hit, items, n_near``.

    ``starts`` and ``ends`` are the united spans of words inside an occurrence
    of a window, ``items`` the ids of the items with one (as strings, sorted),
    ``n_near`` the proximity matches that are no exact phrase. Defined cases:
    a null or empty text has no words; items without words have no window; a
    null item id is the string ``None``; equal windows belong to all their
    items; rows repeated alike are matched each; empty tables give no rows, or
    rows without hits; other columns are ignored.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    # the characters bound the windows of a block (a word has one character, another parts it from the next)
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // (2 * block_windows)))
    index = out = None
    for k in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        found = windows([(r.item_id, r.text) for r in some.toLocalIterator()], length)
        if index is None:
            names = {t: i for i, t in enumerate(sorted({t for w in found for t in w}))} if blocks == 1 else None
            index = build_index(docs, names, id_col, text_col, segment_chars, slop)
        part = search(index, found, length, slop)
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        united = F.udf(_united, "starts array<long>, ends array<long>")
        out = (out.groupBy("segment", "n", "doc_id", "n_words")
               .agg(united(F.flatten(F.collect_list("starts")), F.flatten(F.collect_list("ends"))).alias("u"),
                    F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("n_near").alias("n_near"))
               .select("doc_id", "n_words", "u.starts", "u.ends", "items", "n_near"))
    covered = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda a, x: a + x["ends"] - x["starts"])
    return out.select(F.col("doc_id").cast(id_type).alias("doc_id"), "n_words", "starts", "ends", covered.alias("n_hit"), "items", "n_near")


def items_sha256(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def brute_force(doc_text, items, length: int = 10) -> tuple[int, int, int, str]:
    """``(n_words, n_hit, n_items, items_sha256)`` of one text, for tests."""
    ws, hit, names = words(doc_text), set(), set()
    for w, ids in windows(items, length).items():
        for i in range(len(ws) - len(w) + 1):
            if tuple(ws[i:i + len(w)]) == w:
                hit |= set(range(i, i + len(w)))
                names |= ids
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
