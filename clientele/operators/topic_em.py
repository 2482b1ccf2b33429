"""Topics whose vocabulary stays a table (ML-10, ML-11, TOP-2): mixture of topics by
expectation-maximisation over documents in blocks (``bags``).

The model is two tables: ``phi (term, p)``, each term's probability in every topic, and
``theta (doc, q)``, each document's topic shares. A round joins ``phi`` to the blocks' lists
of terms, splits every count over the topics inside the block and adds up the parts per
term; a document's shares stay with its block. Counts are dealt out by block once, so a
round moves one row per block and term. ``phi`` and the shares are checkpointed each round,
so the plan does not grow. The driver sees one number a round and, when topics are
described, the terms shown.

With pseudo counts ``alpha`` for a document's topics and ``beta`` for a topic's terms
(Dirichlet priors), no round lowers the log posterior; ``trace`` has it per round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.partitioning import materialize, spread
from ..functions.scalars import row_values
from .bags import Bags, by_document, fit_round, frequencies, make_bags, numbered, run_step
from .topics import MAX_DF, MIN_DF, TOKEN_PATTERN, stop_words, valid_text


@dataclass
class TopicTables:
    phi: DataFrame
    theta: DataFrame
    k: int
    alpha: float
    beta: float
    trace: list[float] = field(default_factory=list)


@dataclass
class TermCounts:
    """Counts of the terms kept, per document: the documents in blocks and the table ``kept (term)``."""
    bags: Bags
    kept: DataFrame


def term_counts(df: DataFrame, id_col: str, text_col: str = "Clean_Text") -> TermCounts:
    """Counts of the terms kept (no stop words, in two documents at least, in at most 95 % of them), per document."""
    docs = spread(df.where(valid_text(text_col)).select(F.col(id_col).alias("doc"), F.col(text_col).alias("__x")))
    words = F.regexp_extract_all("__x", F.lit(TOKEN_PATTERN), 0)
    bags = make_bags(docs.select("doc", words.alias("terms"), F.lit(None).cast("array<double>").alias("n"), "__x"), F.length("__x"))
    kept = frequencies(bags).where((F.col("doc_freq") >= MIN_DF) & (F.col("doc_freq") <= F.lit(MAX_DF) * bags.n_docs) & ~F.col("term").isin(stop_words()))
    return TermCounts(bags, materialize(kept.select("term")))


def of_table(counts: DataFrame) -> TermCounts:
    """The same from a table ``doc, term, n``, all of whose terms are kept."""
    rows = counts.where("n is not null and term is not null").groupBy("doc").agg(F.collect_list(F.struct("term", F.col("n").cast("double").alias("n"))).alias("z"))
    rows = materialize(rows.select("doc", F.col("z.term").alias("terms"), F.col("z.n").alias("n")))
    bags = make_bags(rows, F.size("terms") * 8)
    return TermCounts(bags, materialize(frequencies(bags).select("term")))


def first_weight(term: str, topic: int) -> F.Column:
    """A starting weight from 0.5 to 1.5 by a digest of the term and the topic: the same in every run and partition."""
    digits = F.substring(F.md5(F.concat(F.col(term), F.lit(f":{topic}")).cast("binary")), 1, 4)
    return F.lit(0.5) + F.conv(digits, 16, 10).cast("double") / 65536


def _phi(sums: DataFrame, key: str, k: int, beta: float) -> DataFrame:
    """Terms' probabilities from their summed parts ``w0...``."""
    total = row_values(sums.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"w{j}").alias(f"t{j}") for j in range(k)]))
    return sums.select(key, *[((F.col(f"w{j}") + beta) / (total[f"t{j}"] + total["v"] * beta)).alias(f"p{j}") for j in range(k)])


def _em_step(k: int, alpha: float, rounds: int = 1):
    """Rounds over one block: its documents' new shares, the log likelihood and the shares' logarithms before the last round, the parts per slot."""
    def step(n_docs, doc, slot, n, p, q):
        q = np.full((n_docs, k), 1.0 / k) if q is None else q
        some = np.bincount(doc, minlength=n_docs) > 0
        size = np.bincount(doc, n, n_docs)
        mine = p[slot]
        for _ in range(rounds):
            x = mine * q[doc]
            s = x.sum(axis=1)
            values = [float((n * np.log(s)).sum()), float(np.log(q[some]).sum())]
            x *= (n / s)[:, None]
            q = np.stack([np.bincount(doc, x[:, j], n_docs) for j in range(k)], axis=1)
            q = (q + alpha) / (size + k * alpha)[:, None]
        q[~some] = np.nan
        return q, values, np.stack([np.bincount(slot, x[:, j], len(p)) for j in range(k)], axis=1)
    return step


def fit_topic_em(counts: TermCounts | DataFrame, k: int = 5, rounds: int = 10, alpha: float = 0.1, beta: float = 0.01) -> TopicTables:
    """ML-10: ``rounds`` rounds over the counts (of ``term_counts``, or a table ``doc, term, n``). No counts give empty tables."""
    counts = counts if isinstance(counts, TermCounts) else of_table(counts)
    bags = counts.bags
    terms, words = numbered(bags, counts.kept)
    weights = [first_weight("term", j) for j in range(k)]
    phi = materialize(_phi(terms.select("t", *[w.alias(f"w{j}") for j, w in enumerate(weights)]), "t", k, beta))
    state, trace = None, []
    for _ in range(rounds):
        logs = phi.agg(F.coalesce(F.sum(sum((F.log(f"p{j}") for j in range(1, k)), F.log("p0"))), F.lit(0.0))).first()[0]
        sums, (seen, shares) = fit_round(bags, words, phi, state, k, _em_step(k, alpha), 2)
        trace.append(seen + beta * logs + alpha * shares)
        phi = materialize(_phi(sums.where("t is not null"), "t", k, beta))
        state = sums.where("block is not null").select("block", "q")
    if state is None:
        placed = words.join(phi, "t")
        state = materialize(run_step(bags, placed, None, k, lambda n_docs, doc, *_: (np.where(np.bincount(doc, minlength=n_docs)[:, None] > 0, 1.0 / k, np.nan) * np.ones(k), [], None))
                            .where("block is not null").select("block", "q"))
    theta = materialize(by_document(bags, state, k))
    named = materialize(phi.join(terms, "t").select("term", F.array(*[f"p{j}" for j in range(k)]).alias("p")))
    words.unpersist()
    bags.release()
    return TopicTables(named, theta, k, alpha, beta, trace)


def topic_terms(model: TopicTables, n_terms: int = 10) -> DataFrame:
    """TOP-2: the ``n_terms`` likeliest terms of each topic (ties by term): ``topic, rank, term, weight``. A top-n per topic,
    not a sort of the vocabulary."""
    out = None
    for j in range(model.k):
        top = model.phi.select("term", F.get("p", F.lit(j)).alias("weight")).orderBy(F.desc("weight"), "term").limit(n_terms)
        listed = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term")))
        top = top.agg(listed.alias("l")).select(F.posexplode("l").alias("i", "x"))
        top = top.select(F.lit(f"Topic {j + 1}").alias("topic"), (F.col("i") + 1).alias("rank"), F.col("x.term").alias("term"), (-F.col("x.w")).alias("weight"))
        out = top if out is None else out.unionByName(top)
    return out


def infer_topics(model: TopicTables, counts: TermCounts | DataFrame, rounds: int = 10) -> DataFrame:
    """``doc, q``: topic shares of documents with the terms' probabilities fixed; documents without a known term are absent.
    All rounds run inside a block, in one pass."""
    counts = counts if isinstance(counts, TermCounts) else of_table(counts)
    known = model.phi.join(counts.kept, "term", "left_semi").select("term", *[F.get("p", F.lit(j)).alias(f"p{j}") for j in range(model.k)])
    placed = counts.bags.words.join(known, "term").select("block", "slot", F.lit(0).cast("long").alias("t"), *[f"p{j}" for j in range(model.k)])
    state = run_step(counts.bags, placed, None, model.k, _em_step(model.k, model.alpha, rounds)).where("block is not null").select("block", "q")
    theta = materialize(by_document(counts.bags, state, model.k))
    counts.bags.release()
    return theta


def label_topics(rows: DataFrame, id_col: str, shares: DataFrame) -> DataFrame:
    """ML-11: the rows with ``Topic_ID`` (the largest share's, the first of equals; -1 without one) and ``Topic_Label``."""
    best = shares.select(F.col("doc").alias("__d"), (F.array_position("q", F.array_max("q")) - 1).cast("int").alias("__b"))
    out = rows.join(best, F.col(id_col) == F.col("__d"), "left").withColumn("Topic_ID", F.coalesce("__b", F.lit(-1)))
    label = F.when(F.col("Topic_ID") >= 0, F.concat(F.lit("Topic "), (F.col("Topic_ID") + 1).cast("string"))).otherwise(F.lit("Unknown"))
    return out.withColumn("Topic_Label", label).drop("__d", "__b")
