"""Text similarity for the location tiers (JOIN-3, JOIN-4): the sequence-matcher ratio, and indexes that
find the pairs worth measuring by equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts from this length on ignore characters more frequent than a hundredth when blocks are looked for.
LONG_TEXT = 200


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _rect(a, b, c, d) -> Column:
    return F.struct(*[F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.cast("int").alias(n) for n, x in zip(("alo", "ahi", "blo", "bhi"), (a, b, c, d))])


def _longest_block(a: Column, b: Column, plain: Column, r: Column) -> Column:
    """The longest common block ``i, j, k`` of the parts ``r`` of two character arrays: the earliest in ``a``, then in
    ``b``. Row by row, the length of the block that ends at each pair of places."""
    spots = F.sequence(F.lit(0), F.size(b) - 1)

    def row(state, i):
        def end(j):
            here = (j >= r["blo"]) & (j < r["bhi"]) & F.get(plain, j) & (F.get(a, i) == F.get(b, j))
            return F.when(here, F.lit(1) + F.when(j > r["blo"], F.get(state["row"], j - 1)).otherwise(0)).otherwise(0)

        def keep(new):
            return let(F.array_max(new), lambda k: F.when(
                k > state["k"], F.struct((i - k + 1).alias("i"), (F.array_position(new, k).cast("int") - k).alias("j"), k.alias("k"), new.alias("row")))
                .otherwise(F.struct(state["i"].alias("i"), state["j"].alias("j"), state["k"].alias("k"), new.alias("row"))))
        return let(F.transform(spots, end), keep)
    start = F.struct(r["alo"].alias("i"), r["blo"].alias("j"), F.lit(0).alias("k"), F.array_repeat(F.lit(0), F.size(b)).alias("row"))
    best = F.aggregate(F.sequence(r["alo"], r["ahi"] - 1), start, row)

    def grown(m):
        """Long texts: the block goes on over equal characters that were ignored."""
        def run(most, same):
            state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
            step = lambda s, x: let(s["on"] & same(x), lambda on: F.struct((s["n"] + on.cast("int")).alias("n"), on.alias("on")))
            steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, state, step, lambda s: s["n"])
        back = run(F.least(m["i"] - r["alo"], m["j"] - r["blo"]), lambda x: F.get(a, m["i"] - x) == F.get(b, m["j"] - x))
        ahead = run(F.least(r["ahi"] - m["i"] - m["k"], r["bhi"] - m["j"] - m["k"]),
                    lambda x: F.get(a, m["i"] + m["k"] + x - 1) == F.get(b, m["j"] + m["k"] + x - 1))
        return let(back, lambda n: F.struct((m["i"] - n).alias("i"), (m["j"] - n).alias("j"), (m["k"] + n + ahead).alias("k")))
    return let(best, lambda m: F.when(F.size(b) >= LONG_TEXT, grown(m)).otherwise(F.struct(m["i"].alias("i"), m["j"].alias("j"), m["k"].alias("k"))))


def matching_characters(a: Column, b: Column) -> Column:
    """Characters in the matching blocks of two texts: the longest common block, then the same left and right of it.

    The parts still to do are kept on a stack inside one ``aggregate``; every turn takes one part off and puts up to
    two back. From ``LONG_TEXT`` characters of ``b`` on, its frequent characters start no block."""
    def measure(t):
        x, y = t["x"], t["y"]
        # frequent: more than a hundredth of the characters (rounded down) and one
        often = F.transform(F.array_distinct(y), lambda c: F.struct(c.alias("c"), (F.size(F.filter(y, lambda z: z == c)) > F.floor(F.size(y) / 100) + 1).alias("often")))
        common = F.transform(F.filter(often, lambda o: o["often"]), lambda o: o["c"])
        plain = F.when(F.size(y) >= LONG_TEXT, let(common, lambda cs: F.transform(y, lambda c: ~F.array_contains(cs, c)))).otherwise(F.transform(y, lambda c: F.lit(True)))

        def turn(p):
            def step(state, _):
                def one(r):
                    def put(m):
                        rest = F.slice(state["stack"], 1, F.size(state["stack"]) - 1)
                        parts = F.filter(F.array(_rect(r["alo"], m["i"], r["blo"], m["j"]), _rect(m["i"] + m["k"], r["ahi"], m["j"] + m["k"], r["bhi"])),
                                         lambda q: (q["alo"] < q["ahi"]) & (q["blo"] < q["bhi"]))
                        return F.struct(F.when(m["k"] > 0, F.concat(rest, parts)).otherwise(rest).alias("stack"), (state["n"] + m["k"]).alias("n"))
                    return let(_longest_block(x, y, p, r), put)
                return F.when(F.size(state["stack"]) > 0, let(F.element_at(state["stack"], -1), one)).otherwise(state)
            whole = F.struct(F.array(_rect(0, F.size(x), 0, F.size(y))).alias("stack"), F.lit(0).alias("n"))
            turns = F.sequence(F.lit(1), F.least(F.size(x), F.size(y)) * 2 + 1)
            return F.aggregate(turns, whole, step, lambda s: s["n"])
        return let(plain, turn)
    both = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(let(both, measure))


def matching_ratio(a: Column, b: Column) -> Column:
    """2 x matching characters / total length, as a sequence matcher gives for first text ``a`` and second ``b``."""
    return F.lit(2.0) * matching_characters(a, b) / (F.length(a) + F.length(b))


# ---- candidate pairs for a similarity of a share of both texts' characters ----

def _need(a: Column, b: Column, cutoff: float) -> Column:
    """Characters that texts of lengths a and b must have in common."""
    return F.ceil(F.lit(cutoff / 2) * (a + b) - 1e-9).cast("int")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Characters that two texts have in common, each as often as in the text that has it less."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(b, "")), F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))


def _signatures(texts: DataFrame, col: str, known: Column, cutoff: float) -> DataFrame:
    """``col, at, s``: pairs of tokens of each text's prefix, with the place of the later one.

    A token is a character with its number of occurrence, so common tokens are common characters counted with
    repetitions. Tokens are ordered rarest first by how often the keys have them (``known``). Texts that must share m
    tokens share two among the first ``length - m + 2`` of each; where one may be enough (very short texts or low
    cutoffs), single tokens are signatures too."""
    n = F.length(col)
    times = lambda c: F.length(F.col(col)) - F.length(F.replace(F.col(col), c, F.lit("")))
    tokens = F.flatten(F.transform(F.array_distinct(F.split(F.col(col), "")), lambda c: F.transform(F.sequence(F.lit(1), times(c)), lambda i: F.concat(c, i.cast("string")))))
    ranked = F.array_sort(F.transform(tokens, lambda t: F.struct(F.coalesce(F.get("__known", F.lit(0))[t], F.lit(0)).alias("f"), t.alias("t"))))
    least = F.greatest(F.ceil(n * F.lit(cutoff / (2 - cutoff)) - 1e-9), F.lit(1)).cast("int")  # length of the shortest partner
    need = _need(n, least, cutoff)
    size = F.least(n, n - F.greatest(need, F.lit(2)) + 2)
    rows = texts.where(n > 0).withColumn("__known", F.array(known)).select(col, ranked.alias("__r"), size.alias("__p"), (need <= 1).alias("__one"))
    first = F.filter(F.transform(F.slice("__r", F.lit(1), F.col("__p")), lambda r, i: F.struct(i.alias("at"), r["t"].alias("t"), r["f"].alias("f"))), lambda r: r["f"] > 0)
    pairs = F.flatten(F.transform(first, lambda x: F.transform(F.filter(first, lambda y: y["at"] > x["at"]), lambda y: F.struct(y["at"].alias("at"), F.concat(x["t"], F.lit(" "), y["t"]).alias("s")))))
    single = F.transform(F.filter("__r", lambda r: r["f"] > 0), lambda r: F.struct(F.lit(-1).alias("at"), r["t"].alias("s")))
    every = F.when(F.col("__one"), F.concat(pairs, single)).otherwise(pairs)
    return rows.select(col, F.explode(every).alias("__s")).select(col, F.col("__s.at").alias("at"), F.col("__s.s").alias("s"))


def candidate_pairs(cities: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (city, key) whose common characters, counted with repetitions, reach ``cutoff`` of half their total length:
    all that can reach it by common subsequence, edit distance or matching blocks.

    Found by a prefix index: the signatures of both sides are joined, and a pair goes on if behind the places of its
    common tokens enough are left; the overlap itself is checked once per pair."""
    cities, keys = cities.select("city").distinct(), keys.select("key").distinct()
    times = lambda c: F.length("key") - F.length(F.replace(F.col("key"), c, F.lit("")))
    tokens = F.flatten(F.transform(F.array_distinct(F.split("key", "")), lambda c: F.transform(F.sequence(F.lit(1), times(c)), lambda i: F.concat(c, i.cast("string")))))
    counts = keys.where(F.length("key") > 0).select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    known = counts.select(F.map_from_entries(F.collect_list(F.struct("t", "n")))).scalar()  # at most the alphabet times the longest key
    a = _signatures(cities, "city", known, cutoff).withColumnRenamed("at", "i")
    b = _signatures(keys, "key", known, cutoff).withColumnRenamed("at", "j")
    la, lb = F.length("city"), F.length("key")
    need = _need(la, lb, cutoff)
    fits = (F.lit(2.0) * F.least(la, lb) >= F.lit(cutoff) * (la + lb) - 1e-9)
    left = F.when(F.col("i") < 0, True).otherwise(F.least(la - F.col("i"), lb - F.col("j")) + 1 >= need)
    pairs = a.join(b, "s").where(fits & left).select("city", "key").distinct()
    return pairs.where(multiset_overlap(F.col("city"), F.col("key")) >= need)


# ---- keys inside texts ----

def contained_keys(texts: DataFrame, keys: DataFrame, gram: int = 3) -> DataFrame:
    """Pairs (``text``, ``key`` row) of the keys that stand in a text: ``texts`` has ``text``, ``keys`` has ``part``.

    Every key is indexed by its rarest piece of ``gram`` characters (counted over the texts) with the piece's place in
    the key; a text is probed by its pieces once, as many as it has characters, and the key is compared in place.
    Shorter keys are one piece."""
    keys = keys.where(F.length("part") > 0)
    size = F.least(F.length("part"), F.lit(gram))
    sizes = keys.select(F.sort_array(F.collect_set(size)).alias("s")).scalar()  # at most ``gram`` numbers

    def pieces(col, n):
        return F.transform(F.sequence(F.lit(1), F.length(col) - n + 1), lambda i: F.substring(F.col(col), i, n))
    probes = texts.select("text", F.explode(sizes).alias("n")).where(F.col("n") <= F.length("text"))
    probes = probes.select("text", F.posexplode(pieces("text", F.col("n"))).alias("at", "piece"))
    of_keys = keys.withColumn("n", size).select(*keys.columns, F.posexplode(pieces("part", F.col("n"))).alias("off", "piece"))
    counts = probes.join(of_keys.select("piece").distinct(), "piece").groupBy("piece").agg(F.count(F.lit(1)).alias("texts"))
    rarest = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "off", "piece")).alias("a")
    anchors = of_keys.join(counts, "piece", "left").groupBy(*keys.columns).agg(rarest)
    anchors = anchors.select(*keys.columns, F.col("a.off").alias("off"), F.col("a.piece").alias("piece"))
    start = F.col("at") - F.col("off") + 1
    return probes.join(anchors, "piece").where((start >= 1) & (F.substring(F.col("text"), start, F.length("part")) == F.col("part"))).select("text", *keys.columns)

