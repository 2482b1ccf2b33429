"""Language identification as mixture inference.

A document's letter trigrams are taken as draws from a mixture of languages,
each a distribution over hashed trigrams learned from labelled documents. The
set of languages grows from the single likeliest one: expectation-maximisation
estimates the shares with one more language, which stays if the gain in log
likelihood exceeds a penalty that grows with the logarithm of the text's
length. As the log likelihood is concave in the shares, the gradient bounds
the possible gain, so most documents need no iteration.

The model is ``languages x BUCKETS`` numbers (half a megabyte a language),
learned on all labelled documents or on about ``fit_docs`` a language, and sent
to the tasks. All documents are scored, whole, in one pass without a shuffle; a task
holds a slice of text of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mix64, text_chunks

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
MOST_LANGUAGES = 1000
SMOOTH = 0.5
#: Trigrams overlap, so each letter is seen three times; the log likelihood is divided by this.
OVERLAP = 3.0
CHUNK = 500_000

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Table over all code points: whether it is a letter (made once a process)."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(texts: list[str], padded: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, bucket, count)`` of the lower-cased letter trigrams, words padded by a blank; sorted."""
    low = [f" {t.lower()} " for t in texts] if padded else texts
    keys = []
    docs = np.repeat(np.arange(len(low)), [len(t) for t in low])
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:-1] |= is_letter[1:]
    codes, docs, is_letter = np.where(is_letter, codes, 32)[keep].astype(np.uint64), docs[keep], is_letter[keep]
    if len(codes) > 2:
        good = is_letter[1:-1] & (docs[:-2] == docs[2:])
        h = mix64(codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9))
        keys.append((docs[1:-1].astype(np.int64) << BUCKET_BITS | (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))[good])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = np.unique(keys[0], return_counts=True)
    return key >> BUCKET_BITS, key & (BUCKETS - 1), count


def _slices(text: str):
    """A long text, lower-cased and padded, in pieces that share two characters: each three in a row are in one piece."""
    low = f" {text.lower()} "
    for at in range(0, max(len(low) - 2, 1), CHUNK):
        yield low[at:at + CHUNK + 2]


def _grams(group: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(group) == 1 and len(group[0]) > CHUNK:
        total = np.zeros(BUCKETS, np.int64)
        for piece in _slices(group[0]):
            _, g, c = trigrams([piece], padded=False)
            total[g] += c
        g = np.flatnonzero(total)
        return np.zeros(len(g), np.int64), g, total[g]
    return trigrams(group)


def _learn(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for group in text_chunks(texts, CHUNK):
            d, g, c = _grams([t for _, t in group])
            cuts = np.searchsorted(d, np.arange(len(group) + 1))
            for k, (i, _) in enumerate(group):
                total = totals.setdefault(langs[i], np.zeros(BUCKETS, np.int64))
                total[g[cuts[k]:cuts[k + 1]]] += c[cuts[k]:cuts[k + 1]]
    for lang, total in totals.items():
        g = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "g": pa.array(g, pa.int64()), "c": pa.array(total[g])})


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from; those without an id are among them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _chosen(docs: DataFrame, fit_docs: int | None, id_col: str, text_col: str, lang_col: str):
    """The documents learned from (``lang, text``), and the numbers of labelled ones per language."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    if not sizes:
        return None, []
    if fit_docs is None:
        return rows.select("lang", "text"), sizes
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, fit_docs / r["count"])) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(share), "lang").filter(draw < F.col("share")).select("lang", "text"), sizes


def length_class(n):
    """Texts are compared with others of about as many trigrams: whole logarithms to base 2."""
    return np.floor(np.log2(np.maximum(n, 1))).astype(int)


def with_floor(model: dict, docs: DataFrame, fit_docs: int | None = 5000, margin: float = 0.5, id_col: str = "doc_id",
               text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model with the least fit it accepts per length class: that of the worst learning document of the class or a
    shorter one, less ``margin`` (nats a trigram). Texts in a language that was not learned fit far worse, mixtures of
    learned ones do not. Classes longer than any learned document have the floor of the longest."""
    chosen, _ = _chosen(docs, fit_docs, id_col, text_col, lang_col)
    if not model["langs"]:
        return model
    found = detect(chosen.select("text"), model).select("fit", "n_trigrams").filter("n_trigrams > 0")
    least = found.groupBy(F.floor(F.log2("n_trigrams")).cast("int").alias("k")).agg(F.min("fit").alias("f")).collect()  # some 30 rows
    floor = np.full(64, np.inf)
    for r in least:
        floor[r.k] = r.f
    # a longer class may not be stricter where it has few documents: its floor is that of the worst up to it
    floor = np.minimum.accumulate(floor)
    return {**model, "floor": np.where(np.isinf(floor), -np.inf, floor) - margin}


def fit(docs: DataFrame, fit_docs: int | None = 5000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Learn the trigram distributions: ``{"langs": sorted names, "p": buckets x languages,
    "prior": logarithms of the languages' shares of the labelled documents}``.

    ``fit_docs`` bounds the labelled documents used per language: with more,
    each is used with the probability that gives this number (by a hash of its
    id, so reruns agree); None uses them all. Rows that are held out or have a null language,
    text or id are not learned from.
    """
    chosen, sizes = _chosen(docs, fit_docs, id_col, text_col, lang_col)
    langs = sorted(r.lang for r in sizes)
    if not langs:
        return {"langs": [], "p": np.zeros((BUCKETS, 0)), "prior": np.zeros(0)}
    counts = chosen.mapInArrow(_learn, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")).toPandas()
    table = np.zeros((BUCKETS, len(langs)))
    table[counts["g"], np.searchsorted(langs, counts["lang"].to_numpy(str))] = counts["c"]
    n = np.array([r["count"] for r in sorted(sizes, key=lambda r: r.lang)], float)
    return {"langs": langs, "p": (table + SMOOTH) / (table.sum(axis=0) + SMOOTH * BUCKETS), "prior": np.log(n / n.sum())}


def shares(d: np.ndarray, g: np.ndarray, c: np.ndarray, n_docs: int, p: np.ndarray, penalty: float,
           prior: np.ndarray | float = 0.0, rounds: int = 25, fits: np.ndarray | None = None) -> np.ndarray:
    """``documents x languages`` shares of the chosen language sets; zeros for a document without trigrams.
    ``fits`` (documents x 2) takes the log likelihood per trigram of the chosen mixture and the number of trigrams."""
    out = np.zeros((n_docs, p.shape[1]))
    if not len(d) or not p.shape[1]:
        return out
    ids, first = np.unique(d, return_index=True)
    pos = np.searchsorted(ids, d)
    table, c = p[g], c.astype(float)
    n = np.add.reduceat(c, first)
    single = np.add.reduceat(np.log(table) * c[:, None], first)
    best = (single / OVERLAP + prior).argmax(axis=1)  # the labels' shares tell very short texts apart
    pi = np.zeros((len(ids), p.shape[1]))
    pi[np.arange(len(ids)), best] = 1.0
    ll = single[np.arange(len(ids)), best]
    cost = penalty * np.log(n + 1.0)
    active = np.arange(len(ids))
    for _ in range(p.shape[1] - 1):
        here = np.isin(pos, active)
        rows, cc, at = table[here], c[here], np.searchsorted(active, pos[here])
        starts = np.searchsorted(at, np.arange(len(active)))
        mine = pi[active]
        mixed = (rows * mine[at]).sum(axis=1)
        gain = np.add.reduceat(rows * (cc / mixed)[:, None], starts) - n[active][:, None]
        gain[mine > 0] = -np.inf
        extra = gain.argmax(axis=1)
        go = gain[np.arange(len(active)), extra] / OVERLAP > cost[active]  # a smaller gradient can gain no more than the cost
        if not go.any():
            break
        sub = go[at]
        rows, cc, active, extra, mine = rows[sub], cc[sub], active[go], extra[go], mine[go]
        at = np.cumsum(go)[at[sub]] - 1
        starts = np.searchsorted(at, np.arange(len(active)))
        mine = mine * 0.9
        mine[np.arange(len(active)), extra] = 0.1
        for _ in range(rounds):
            w = rows * mine[at]
            total = w.sum(axis=1)
            mine = np.add.reduceat(w * (cc / total)[:, None], starts) / n[active][:, None]
        new = np.add.reduceat(np.log((rows * mine[at]).sum(axis=1)) * cc, starts)
        better = (new - ll[active]) / OVERLAP > cost[active]
        active, mine, new = active[better], mine[better], new[better]
        pi[active], ll[active] = mine, new
        if not len(active):
            break
    out[ids] = pi
    if fits is not None:
        fits[ids, 0], fits[ids, 1] = ll / n, n
    return out


ROWS = 1000  # rows of a batch worked on at once: their texts, not those of the whole batch, are held as Python strings


def _detect(shared, penalty: float, place: int):
    def run(batches):
        model = shared.value
        langs, p, floor = model["langs"], model["p"], model.get("floor")
        chunk = max(50_000, min(CHUNK, 2_000_000 // max(1, len(langs))))
        kinds = {"lang_pred": pa.string(), "score": pa.float64(), "langs": pa.list_(pa.string()), "shares": pa.list_(pa.float64()),
                 "fit": pa.float64(), "n_trigrams": pa.int64(), "fits": pa.bool_()}
        for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            texts = pc.struct_field(part.column(0), [place]).cast(pa.string()).to_pylist()
            result = {c: [] for c in kinds}
            for group in text_chunks(texts, chunk):
                d, g, c = _grams([t for _, t in group])
                fits = np.zeros((len(group), 2))
                for row in shares(d, g, c, len(group), p, penalty, model["prior"], fits=fits):
                    order = [int(i) for i in np.argsort(-row, kind="stable") if row[i] > 0]
                    result["lang_pred"].append(langs[order[0]] if order else "und")
                    result["score"].append(round(float(row[order[0]]), 6) if order else 0.0)
                    result["langs"].append([langs[i] for i in order])
                    result["shares"].append([round(float(row[i]), 6) for i in order])
                n = fits[:, 1].astype(np.int64)
                result["fit"] += [float(f) if k else None for f, k in zip(fits[:, 0], n)]
                result["n_trigrams"] += n.tolist()
                result["fits"] += ((n > 0) & (True if floor is None else fits[:, 0] >= floor[length_class(n)])).tolist()
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(result[c], k) for c, k in kinds.items()]], names=["kept", *kinds])
    return run


def detect(docs: DataFrame, model: dict, penalty: float = 4.0, text_col: str = "text") -> DataFrame:
    """Per row ``kept`` (a struct of all input columns), ``lang_pred, score, langs, shares, fit, n_trigrams, fits``.

    ``langs`` and ``shares`` are the language set with its proportions, largest
    first; ``lang_pred`` and ``score`` are the first of them. ``fit`` is the log
    likelihood per trigram of that mixture (null without trigrams); ``fits`` tells
    whether it reaches the model's floor (``with_floor``; without one, whether there
    are trigrams). Defined cases: a
    text that is null or has no letters, or a model without languages, gives
    ``und``, score 0 and empty lists; equal shares are ordered by name; rows
    repeated alike give equal rows; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    kept = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(_detect(shared, penalty, docs.columns.index(text_col)), f"kept {kept}, lang_pred string, score double, langs array<string>, shares array<double>, fit double, n_trigrams long, fits boolean")
