"""Jaccard join on word n-grams by vertical partitioning.

The n-grams have one global order, rare ones first: by the class of a counter
that the n-gram shares with others of the same slot, then by hash. A set of
size n can only reach the similarity with another if both share an n-gram among
the first ``n - ceil(t n) + 1`` of that order (prefix), so n-grams that many
documents share, say of a passage, produce no candidates. For the candidate
pairs the order is cut into fragments; the overlap in each fragment is counted
separately and summed per pair. That count is exact (n-grams are compared by
64-bit hashes).

Steps, all over the whole table:

1. ``order_table``: every n-gram is counted in one of ``SLOTS`` counters (8 MB
   as one byte each, whatever the input). An n-gram's class tells its count from
   its slot's usual filling, so classes stay useful when slots hold many n-grams;
   a collision only makes the order worse, never loses a link.
2. ``signatures``: per row the set's size, its 128-bit digest, the prefix, and
   parity bitmaps (256 bits, and at least two bits an n-gram), whose differing
   bits bound the sets' difference. Equal sets are one class from here on; copies are never paired.
3. ``postings``: prefix n-grams, with their places, that two classes or more share.
4. Stars: each class is paired with the best class of its postings only, which
   is linear in the postings; the verified links give first components. Repeated
   between different components while the next step would be far larger than the
   postings and this one still links.
5. Rest: pairs of *different* components that share a prefix n-gram and pass
   the bounds of size, place and bitmap, inside the join. A group of thousands of
   near copies is one component by then, so its pairs are never formed.
6. Components of all links.

Before overlaps are counted, the wide bitmap drops most pairs that cannot be
similar, so only the sets of likely pairs are read again and moved.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .text import discard, doc_words, row_mark, shingle_hashes, sweep, text_chunks, without, written

CHUNK = 1_000_000
FRAGMENTS = 8
PAIRS_A_POSTING = 20  # pairs that a posting may stand for in the last join before another star step is tried
SLOT_BITS, SLICE_BITS = 23, 12
SLOTS, SLICES = 1 << SLOT_BITS, 1 << (SLOT_BITS - SLICE_BITS)
MOST_A_TASK = (1 << 16) - 1  # a task's counters stop there
LINEAR, OCTAVE = 160, 8  # classes above the linear ones, so many for each doubling
WIDEST = 1 << 20  # bits of the largest bitmap


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _rows(rows, names, kinds):
    """Tuples as record batches of 256 rows (of some kilobytes each)."""
    rows = iter(rows)
    while part := list(itertools.islice(rows, 256)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)


def _count(k: int):
    """Per task one counter a slot, as compressed slices."""
    def run(batches):
        counts = np.zeros(SLOTS, np.uint16)
        for batch in batches:
            for group in text_chunks(batch.column(0).to_pylist(), CHUNK):
                hashes = [shingle_hashes(words, k) for words in doc_words([t for _, t in group])]
                at, n = np.unique(_slots(np.concatenate(hashes)), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, MOST_A_TASK)
        pack = zstandard.ZstdCompressor(level=1)
        small = lambda part: part.astype(np.uint8) if part.max() < 256 else part
        yield from _rows(((i, pack.compress(small(part).tobytes())) for i, part in enumerate(counts.reshape(SLICES, -1)) if part.any()),
                         ["slice", "counts"], [pa.int32(), pa.binary()])
    return run


def _add(batches):
    """The tasks' slices of a partition summed, one row a slice (64-bit counters)."""
    sums, unpack = {}, zstandard.ZstdDecompressor()
    for batch in batches:
        for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = unpack.decompress(packed)
            part = np.frombuffer(raw, np.uint8 if len(raw) == 1 << SLICE_BITS else np.uint16)
            sums[i] = sums[i] + part if i in sums else part.astype(np.int64)
    yield from _rows(((i, int(x.sum()), x.tobytes()) for i, x in sums.items()), ["slice", "n", "counts"], [pa.int32(), pa.int64(), pa.binary()])


def _classify(usual: float):
    """Counters as classes of one byte: linear around the slots' usual filling, in steps of an eighth of its
    deviation, then by octaves. With the n-grams of a class, for the cuts between fragments."""
    step = max(1, int(usual ** 0.5 / 8))
    base = max(0, int(usual - 4 * usual ** 0.5))

    def one(i, raw):
        counts = np.frombuffer(raw, np.int64)
        above = np.maximum(counts - base, 0) // step
        far = LINEAR + OCTAVE * np.log2(np.maximum(above, LINEAR) / LINEAR)
        classes = np.where(above < LINEAR, above, np.minimum(far, 255)).astype(np.uint8)
        weight = np.bincount(classes, weights=counts, minlength=256)
        return i, classes.tobytes(), weight.astype(np.float32).tobytes()

    def run(batches):
        for batch in batches:
            yield from _rows(map(one, batch.column(0).to_pylist(), batch.column(2).to_pylist()),
                             ["slice", "classes", "weight"], [pa.int32(), pa.binary(), pa.binary()])
    return run


def order_table(docs: DataFrame, k: int) -> dict[str, np.ndarray]:
    """The class of every slot (``SLOTS`` bytes) and, per class, the share of all n-grams before it."""
    parts = docs.select("text").mapInArrow(_count(k), "slice int, counts binary")
    sums = written(parts.repartition("slice").mapInArrow(_add, "slice int, n long, counts binary"), "counters")
    total = sums.agg(F.sum("n")).first()[0] or 0
    table, weight = np.zeros((SLICES, 1 << SLICE_BITS), np.uint8), np.zeros(256)
    rows = sums.mapInArrow(_classify(total / SLOTS), "slice int, classes binary, weight binary").collect()  # SLICES rows at most
    for r in rows:
        table[r.slice] = np.frombuffer(r.classes, np.uint8)
        weight += np.frombuffer(r.weight, np.float32)
    discard(sums)
    return {"classes": table.reshape(-1), "before": np.concatenate([[0], np.cumsum(weight)]) / max(total, 1)}


def _classes(u: np.ndarray, order) -> np.ndarray:
    return order["classes"][_slots(u)]


def _cuts(u: np.ndarray, order) -> np.ndarray:
    """The fragment of each n-gram: equal parts of the global order, class then hash."""
    w = _classes(u, order).astype(np.int64)
    place = order["before"][w] + (order["before"][w + 1] - order["before"][w]) * ((u >> np.uint64(11)) / 2.0 ** 53)
    return np.minimum((place * FRAGMENTS).astype(np.int64), FRAGMENTS - 1)


def _sign(shared, k: int, percent: int, marked: bool):
    def run(batches):
        order = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in text_chunks(texts, CHUNK):
                rows = {c: [] for c in ("doc_id", "n", "digest", "b0", "b1", "b2", "b3", "wide", "prefix")}
                for (i, _), words in zip(group, doc_words([t for _, t in group])):
                    u = np.unique(shingle_hashes(words, k))
                    n = len(u)
                    size = n - -(-percent * n // 100) + 1 if n else 0
                    prefix = u[np.argsort(_classes(u, order), kind="stable")[:size]]
                    width = min(WIDEST, max(1024, 1 << (2 * n - 1).bit_length() if n else 0))
                    odd = np.bincount((u & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
                    wide = np.packbits(odd).view(np.int64)
                    bits = np.packbits(odd.reshape(-1, 256).sum(axis=0) & 1).view(np.int64)
                    for c, v in zip(rows, (ids[i], n, hashlib.blake2b(u.tobytes(), digest_size=16).hexdigest(), *bits.tolist(), wide, _signed(prefix))):
                        rows[c].append(v)
                kinds = {"digest": pa.string(), "wide": pa.list_(pa.int64()), "prefix": pa.list_(pa.int64())}
                out = {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()}
                if marked:
                    out["mark"] = batch.column(2).take(pa.array([i for i, _ in group]))
                yield pa.RecordBatch.from_pydict(out)
    return run


SIGNATURE = "doc_id long, n long, digest string, b0 long, b1 long, b2 long, b3 long, wide array<long>, prefix array<long>"


def _fragment(shared, k: int):
    """Segments of the sets of the candidate rows: ``digest, f, seg``."""
    def run(batches):
        order = shared.value
        for batch in batches:
            for group in text_chunks(batch.column(0).to_pylist(), CHUNK):
                rows = {"digest": [], "f": [], "seg": []}
                for words in doc_words([t for _, t in group]):
                    u = np.unique(shingle_hashes(words, k))
                    digest = hashlib.blake2b(u.tobytes(), digest_size=16).hexdigest()
                    f = _cuts(u, order)
                    for x in np.unique(f).tolist():
                        rows["digest"].append(digest)
                        rows["f"].append(x)
                        rows["seg"].append(_signed(u[f == x]))
                yield pa.RecordBatch.from_pydict({"digest": pa.array(rows["digest"], pa.string()), "f": pa.array(rows["f"], pa.int32()),
                                                  "seg": pa.array(rows["seg"], pa.list_(pa.int64()))})
    return run


def segments(docs: DataFrame, wanted: DataFrame, shared, k: int) -> DataFrame:
    """``node, f, seg`` of the sets of the classes ``wanted (node, digest, low)``. A fixed-size bitmap of
    the ids of their first rows (4 MB at most) keeps the other texts from being read further."""
    from .text import bitmap_has, bitmap_of, bitmap_position
    n = wanted.count()
    bits = min(25, max(15, int(np.ceil(np.log2(max(n, 1) * 16)))))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    parts = F.broadcast(bitmap_of(wanted.select(F.col("low").alias("doc_id")).select(key.alias("key")), "key", bits))
    rows = (docs.withColumn("pos", bitmap_position(key, bits)).withColumn("part", F.shiftright("pos", 15))
            .join(parts, "part").filter(bitmap_has()).select("text"))
    found = rows.mapInArrow(_fragment(shared, k), "digest string, f int, seg array<long>")
    # rows with an equal set and an id that shares a bit give the same segment again; they are in one partition already
    found = found.join(wanted.select("digest", "node"), "digest").groupBy("digest", "node", "f").agg(F.first("seg").alias("seg"))
    return written(found.drop("digest"), "segments")


def verify(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b, na, nb)`` that are similar, by their overlaps counted per fragment and summed."""
    parts = (pairs.join(segs.select(F.col("node").alias("a"), "f", F.col("seg").alias("sa")), "a")
             .join(segs.select(F.col("node").alias("b"), "f", F.col("seg").alias("sb")), ["b", "f"])
             .select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("o")))
    total = parts.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.filter(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b", "o")


def likely(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs that the wide bitmaps leave possible; a wider one is folded to the other's width."""
    both = (pairs.join(wide.select(F.col("node").alias("a"), F.col("wide").alias("wa")), "a")
            .join(wide.select(F.col("node").alias("b"), F.col("wide").alias("wb")), "b"))
    width = F.least(F.size("wa"), F.size("wb"))

    def folded(w):
        xor = lambda acc, k: F.zip_with(acc, F.slice(w, k * width + 1, width), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(w) == width, w).otherwise(
            F.aggregate(F.sequence(F.lit(0), (F.size(w) / width).cast("int") - 1), F.array_repeat(F.lit(0).cast("long"), width), xor))
    differ = F.aggregate(F.zip_with(folded(F.col("wa")), folded(F.col("wb")), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda s, x: s + x)
    return both.filter((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))).drop("wa", "wb")


def _bounds(percent: int):
    """Bounds of size, bitmap and place that the row of a similar pair x, y at its first common n-gram meets:
    behind place ``at`` (from 0) a set has no more than ``n - at`` n-grams to share."""
    nx, ny = F.col("x.n"), F.col("y.n")
    differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in ("b0", "b1", "b2", "b3")), F.lit(0))
    return ((100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
            & ((100 + percent) * F.least(nx - F.col("x.at"), ny - F.col("y.at")) >= percent * (nx + ny))
            & ((100 + percent) * differ <= (100 - percent) * (nx + ny)))


BITS = ("b0", "b1", "b2", "b3")


def _side(prefix: str):
    return F.struct(*[F.col(f"{prefix}{c}") for c in ("node", "root", "at", "n", *BITS)])


def _top(rows: DataFrame, name: str) -> DataFrame:
    """Per n-gram its best class, as one struct."""
    facts = F.struct("score", F.negative("node").alias("key"), "node", "root", "at", "n", *BITS)
    return rows.groupBy("h").agg(F.max(facts).alias(name))


def _first_stars(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of each class with the best class of each of its postings."""
    facts = F.struct("score", F.negative("node").alias("key"), "node", "root", "at", "n", *BITS)
    rows = lists.withColumn("o", F.max(facts).over(Window.partitionBy("h"))).filter(F.col("o.node") != F.col("node"))
    return _pairs(rows.select(_side("").alias("x"), _side("o.").alias("y")).filter(_bounds(percent)))


def _stars(lists: DataFrame, percent: int) -> DataFrame:
    """The same between components: the best of all or, for the classes of that one's component, the best
    of the other components. At most one pair a posting."""
    first = _top(lists, "t1")
    rows = lists.join(first, "h")
    second = _top(rows.filter(F.col("root") != F.col("t1.root")), "t2")
    rows = rows.join(second, "h").withColumn("o", F.when(F.col("root") != F.col("t1.root"), F.col("t1")).otherwise(F.col("t2")))
    return _pairs(rows.select(_side("").alias("x"), _side("o.").alias("y")).filter(_bounds(percent)))


def _pairs(both: DataFrame) -> DataFrame:
    first = F.when(F.col("x.node") < F.col("y.node"), F.struct("x", "y")).otherwise(F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    p = both.select(first.alias("p"))
    return p.select(F.col("p.x.node").alias("a"), F.col("p.y.node").alias("b"), F.col("p.x.n").alias("na"), F.col("p.y.n").alias("nb")).distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                       mark: Column | None = None) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id`` and, with a string column ``mark``, ``root`` and ``mark``: the
    component's number (null for an empty set), also where ids are repeated, and that column.

    Two rows link when ``100 * intersection >= percent * union`` of their sets
    of ``k``-word n-grams; ``component_id`` is the smallest id reachable.
    Defined cases: a text of fewer words is one n-gram; null, empty or blank
    texts have an empty set, link with nothing and keep their own id; ids are
    integers, a null id is never the smallest; rows repeated alike are one
    class; no rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    more = [] if mark is None else [mark.alias("mark")]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)
    shared = sc.broadcast(order_table(docs, k))
    signs = docs.mapInArrow(_sign(shared, k, percent, mark is not None), SIGNATURE + ", mark string" * len(more)).withColumn("rid", F.monotonically_increasing_id())
    signs = written(signs, "signatures")
    # a class is known by the smallest row number of its rows
    firsts = signs.filter("n > 0").groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"))
    firsts = written(firsts, "class-rows")
    classes = written(firsts.join(signs.select(F.col("rid").alias("node"), "n", *BITS, "wide"), "node"), "classes")
    lists = signs.select(F.col("rid").alias("node"), "prefix").join(firsts.select("node"), "node", "left_semi")
    lists = lists.select("node", F.posexplode("prefix").alias("at", "h")).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h")))
    lists = written(lists.filter("c > 1").select("h", "node", "at"), "postings")
    sweep(spark)
    shared_part = lists.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    scored = classes.drop("wide", "digest", "low").join(shared_part, "node").withColumn("score", F.col("c") / F.col("n"))
    lists = written(lists.join(scored.drop("c"), "node").withColumn("root", F.col("node")), "scored-postings")
    names = classes.select("node", "digest", "low")

    def verified(pairs, name):
        """The similar ones of the pairs, by their sets; nothing is read where there are none."""
        pairs = written(likely(pairs, classes, percent), f"{name}-pairs")
        if not pairs.limit(1).count():
            return None
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        segs = segments(docs, names.join(ends, "node"), shared, k)
        found = written(verify(pairs, segs, percent).select("a", "b"), f"{name}-links")
        discard(segs, pairs)
        return found

    def joined(roots, new):
        """Components of the links so far, known by each node's root, and new ones."""
        known = new if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)
        return components(known)

    def apart(roots):
        """The postings with each class's component, where two components or more remain; how many pairs they hold."""
        placed = lists.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = placed.groupBy("h", "root").agg(F.count(F.lit(1)).cast("double").alias("m")).groupBy("h").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"))
        sizes = sizes.filter("all * all > own").select("h", ((F.col("all") * F.col("all") - F.col("own")) / 2).alias("held"), "all")
        out = written(placed.join(sizes, "h").select(*lists.columns, (F.col("held") / F.col("all")).alias("held")), "placed-postings")
        return out.drop("held"), out.agg(F.sum("held")).first()[0] or 0

    roots, links = None, verified(_first_stars(lists, percent), "star")
    while links is not None and (n_links := links.count()):
        roots = joined(roots, links)
        lists, held = apart(roots)
        n_lists = lists.count()
        if held <= PAIRS_A_POSTING * n_lists or 100 * n_links <= n_lists:
            break
        links = verified(_stars(lists, percent), "star")
    both = (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.node") < F.col("y.node"))
    rest = lists.alias("x").join(lists.alias("y"), both & _bounds(percent))
    links = verified(_pairs(rest.select(_side("x.").alias("x"), _side("y.").alias("y"))), "rest")
    if links is not None:
        roots = joined(roots, links)
    if roots is None:
        roots = classes.select("node", F.col("node").alias("root"))
    member = classes.select("digest", "node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    label = member.join(lowest, "root").select("digest", "component_id", "root")
    more = ["mark"] * len(more)
    out = signs.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"), *more)
    empty = out.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"), *more)
    out = out.filter("n_shingles > 0").join(label, "digest").select("doc_id", "n_shingles", "component_id", "root", *more).unionByName(empty)
    return out if more else out.drop("root")


def near_duplicate_rows(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``jaccard_components``: that of the smallest id (null last), of rows with one id the
    one of the smallest digest, of rows that share id and text the smallest. Rows with an empty set all stay."""
    mark = row_mark(F.col(id_col), F.col(text_col))
    groups = jaccard_components(docs, k, percent, id_col, text_col, mark).filter("root is not null")
    keys = written(groups.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("c")), "marked-classes")
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))["mark"].alias("first"))
    judged = keys.join(first, "root").select("mark", (F.col("mark") == F.col("first")).alias("keep"), "c").filter("not keep or c > 1")
    return without(docs, judged.select("mark", "keep"), mark)
