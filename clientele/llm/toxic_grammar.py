"""Toxicity by a weighted finite-state pattern grammar.

A text is a sequence of tokens of a few classes. Five transducers read that
sequence and put a weight on what they match: insults, threats, targets,
negation and reported speech. Their composition is one table (state, class) ->
(state, factor, bonus); it is run over the clauses of a text, and a clause scores
the sum of its tokens' weights times the factors plus the bonuses. A lone word
counts little: negated or reported it counts less, aimed at somebody more.

The lexicon of insults is learned: words and word beginnings that stand in more
toxic than clean labelled documents than chance allows, weighted by their log
odds. A logistic model of the clause scores (all of them, the best one, per
hundred words) turns them into a score from 0 to 1.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import text_chunks, written

# Token classes and their words in English, French, German and Spanish.
OTHER, INSULT, HARM, TARGET, NEGATION, REPORT, INTENT, QUOTE, BREAK, STOP = range(10)
CLASSES = 10
WORDS = {
    HARM: "kill hurt destroy shoot stab burn crush beat tuer frapper détruire brûler töten verletzen vernichten schlagen matar herir destruir quemar",
    TARGET: "you your yourself he she they him her them tu toi vous ton votre ils elles du dich dir ihr euch sie tú ti usted ustedes ellos ellas",
    NEGATION: "not no never nobody nothing isn't aren't don't doesn't ne pas jamais nicht kein keine nie niemals nunca jamás",
    REPORT: "said says wrote writes claimed claims reported called dit écrit affirme sagte schrieb behauptet berichtet dijo escribió afirma",
    INTENT: "will shall gonna going vais allons werde werden wirst voy vamos",
}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]|[.;?!]+(?=\s|$)|[,:\n]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
SHORTEST, LONGEST = 3, 8  # letters of word beginnings
HARM_WEIGHT = 2.0
CHUNK = 2_000_000


@dataclass
class Transducer:
    """``next``, ``factor`` and ``bonus`` by state and class; state 0 is where a text begins."""
    next: np.ndarray
    factor: np.ndarray
    bonus: np.ndarray


def transducer(states: int, *arcs) -> Transducer:
    """Arcs are (states, classes, next state or None to stay, factor, bonus)."""
    t = Transducer(np.repeat(np.arange(states)[:, None], CLASSES, 1), np.ones((states, CLASSES)), np.zeros((states, CLASSES)))
    for froms, classes, to, factor, bonus in arcs:
        for s in froms:
            for c in classes:
                t.next[s, c] = s if to is None else to
                t.factor[s, c], t.bonus[s, c] = factor, bonus
    return t


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same tokens; factors multiply, bonuses add."""
    n = len(b.next)
    pair = lambda x, y: (x[:, None, :], y[None, :, :])
    flat = lambda x: x.reshape(-1, CLASSES)
    x, y = pair(a.next, b.next)
    f, g = pair(a.factor, b.factor)
    u, v = pair(a.bonus, b.bonus)
    return Transducer(flat(x * n + y), flat(f * g), flat(u + v))


ENDS = (BREAK, STOP)
WEIGHED = (INSULT, HARM)
#: A second insult of a clause counts more than the first.
INSULTS = transducer(2, ([0], [INSULT], 1, 1.0, 0.0), ([1], [INSULT], 1, 1.2, 0.0), ([1], ENDS, 0, 1.0, 0.0))
#: Harm announced (will ...) counts in full, and more when aimed at somebody; harm alone hardly.
THREATS = transducer(3, ([0], [INTENT], 1, 1.0, 0.0), ([0], [HARM], None, 0.1, 0.0), ([1, 2], [HARM], 2, 1.0, 0.0),
                     ([2], [TARGET], 1, 1.0, 2.0), ([1, 2], [STOP], 0, 1.0, 0.0))
#: An insult after somebody is named in the clause counts more; one before, by a bonus.
TARGETS = transducer(3, ([0, 2], [INSULT], 2, 1.0, 0.0), ([0, 1], [TARGET], 1, 1.0, 0.0), ([1], [INSULT], 1, 1.3, 0.0),
                     ([2], [TARGET], 1, 1.0, 0.5), ([1, 2], ENDS, 0, 1.0, 0.0))
#: Up to three tokens behind a negation count less than half.
NEGATIONS = transducer(4, ([1], range(CLASSES), 0, 1.0, 0.0), ([2], range(CLASSES), 1, 1.0, 0.0), ([3], range(CLASSES), 2, 1.0, 0.0),
                       ([1], WEIGHED, 0, 0.4, 0.0), ([2], WEIGHED, 1, 0.4, 0.0), ([3], WEIGHED, 2, 0.4, 0.0),
                       (range(4), [NEGATION], 3, 1.0, 0.0), (range(4), ENDS, 0, 1.0, 0.0))
#: What is quoted, or follows a verb of saying in its sentence, counts half.
REPORTED = transducer(3, ([0, 1], [REPORT], 1, 1.0, 0.0), ([0, 1], [QUOTE], 2, 1.0, 0.0), ([2], [QUOTE], 0, 1.0, 0.0),
                      ([1, 2], WEIGHED, None, 0.5, 0.0), ([1, 2], [STOP], 0, 1.0, 0.0))


def grammar() -> Transducer:
    out = INSULTS
    for part in (THREATS, TARGETS, NEGATIONS, REPORTED):
        out = compose(out, part)
    return out


class Lexicon(dict):
    """Class and weight of tokens, found once for each different token."""
    MOST = 1_000_000  # tokens remembered

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems
        self.fixed = {w: c for c, words in WORDS.items() for w in words.split()}

    def __missing__(self, token: str):
        if len(self) >= self.MOST:
            self.clear()
        weight = max([self.stems.get(token, 0.0), *[self.stems.get(token[:n] + "*", 0.0) for n in range(SHORTEST, min(LONGEST, len(token) - 1) + 1)]])
        if weight > 0:
            out = (INSULT, weight)
        elif token in self.fixed:
            out = (self.fixed[token], HARM_WEIGHT if self.fixed[token] == HARM else 0.0)
        elif token[0] in '"“”«»„':
            out = (QUOTE, 0.0)
        elif token[0] in ".;?!":
            out = (STOP, 0.0)
        else:
            out = (BREAK if token[0] in ",:\n" else OTHER, 0.0)
        self[token] = out
        return out


def clause_scores(text: str, lexicon: Lexicon, table: Transducer) -> list[float]:
    """Scores of the clauses of a lower-case text that score anything."""
    state, score, out = 0, 0.0, []
    after, factor, bonus = table.next, table.factor, table.bonus
    for token in TOKEN.findall(text):
        kind, weight = lexicon[token]
        score += weight * factor[state, kind] + bonus[state, kind]
        state = after[state, kind]
        if kind in ENDS:
            if score:
                out.append(score)
            score = 0.0
    if score:
        out.append(score)
    return out


def features(text: str, lexicon: Lexicon, table: Transducer) -> tuple[float, float, float, int]:
    """All clauses' score, the best one's, the score per hundred words, clauses that score."""
    text = text.lower()
    words = WORD.findall(text)
    if not any(lexicon[w][1] for w in set(words)):
        return 0.0, 0.0, 0.0, 0
    scores = clause_scores(text, lexicon, table)
    total = sum(scores)
    return float(np.log1p(total)), float(np.log1p(max(scores, default=0.0))), float(np.log1p(100 * total / (len(words) + 20))), len(scores)


def stems(text: str) -> set[str]:
    """Words of a text and their beginnings (marked *)."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)}


def _count(batches):
    """Per task and stem the toxic and the clean documents that have it."""
    seen = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            seen[toxic].update(stems(text or ""))
    names = list(seen[0] | seen[1])
    for at in range(0, len(names), 100_000):
        part = names[at:at + 100_000]
        yield pa.RecordBatch.from_pydict({"stem": part, "n1": pa.array([seen[1][x] for x in part], pa.int64()), "n0": pa.array([seen[0][x] for x in part], pa.int64())})


def learn_stems(rows: DataFrame, least_docs: int, least_odds: float, least_gain: float) -> dict[str, float]:
    """Stems with their log odds: in ``least_docs`` toxic documents at least, with odds e**least_odds at least, and a
    log-likelihood ratio of ``least_gain`` over what chance gives the best of millions of stems."""
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}
    seen = rows.mapInArrow(_count, "stem string, n1 long, n0 long").groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    a, b = F.col("n1"), F.col("n0")
    odds = F.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1)))
    share = (a + b) / F.lit(float(n1 + n0))
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    gain = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    kept = seen.withColumns({"odds": odds, "gain": gain}).filter((a >= least_docs) & (F.col("odds") >= least_odds) & (F.col("gain") >= least_gain))
    return {r.stem: r.odds for r in kept.select("stem", "odds").collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model (the first one constant), by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id):
    """Whether a document's labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = 20_000, least_docs: int = 5, least_odds: float = 2.0, least_gain: float = 30.0) -> dict:
    """Model from about ``fit_docs`` labelled documents at most, chosen by a hash of the id, none held out.

    ``labels`` has ``doc_id`` and ``toxic``; rows whose label is not 0 or 1 or whose id is null or held out are left aside.
    Without documents of both kinds the model has no stems.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.filter(F.col("toxic").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    share = min(1.0, fit_docs / max(marked.count(), 1))
    marked = marked.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # some fit_docs rows of two numbers; the texts found are written once for the three passes over them
    rows = written(rows.join(F.broadcast(marked), "label_id").select("text", "toxic"), "labelled-texts")
    found = learn_stems(rows, least_docs, least_odds, least_gain)
    if not found:
        return {"stems": {}, "weights": None}

    def measure(batches):
        lexicon, table = Lexicon(found), grammar()
        for batch in batches:
            got = [features(t, lexicon, table)[:3] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array([list(g) for g in got], pa.list_(pa.float64())), "toxic": batch.column("toxic")})

    sample = rows.mapInArrow(measure, "x array<double>, toxic int").collect()  # about fit_docs rows
    x, y = np.array([r.x for r in sample]).reshape(-1, 3), np.array([r.toxic for r in sample], float)
    order = np.lexsort((*x.T, y))
    return {"stems": found, "weights": logistic(x[order], y[order]).tolist()}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, score, predicted, n_clauses, best_clause`` (the score of the worst clause found).

    Only the text decides. Defined cases: null, empty and texts without a word get the score of a text with no match; a
    model without stems (no labels of both kinds) scores 0; rows are judged one by one, so repeated rows and null ids give
    a result each; no rows give none; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon, table, weights = Lexicon(shared.value["stems"]), grammar(), shared.value["weights"]
        for batch in batches:
            got = [features(t, lexicon, table) for group in text_chunks(batch.column("text").to_pylist(), CHUNK) for _, t in group]
            x = np.array(got, float).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x[:, :3] @ np.array(weights[1:]), -30, 30))) if weights else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                                              pa.array(x[:, 3].astype(np.int64)), pa.array(np.round(np.expm1(x[:, 1]), 6))],
                                             names=["doc_id", "score", "predicted", "n_clauses", "best_clause"])
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_clauses long, best_clause double")
