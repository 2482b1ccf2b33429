"""License scan by conditional compression.

Candidate blocks are stretches of words around license vocabulary. Each block
is compressed alone and with each template as zstandard raw dictionary; the
templates are ranked by how much smaller the block gets. The best ones are
confirmed by their exact wording: the block must hold the template's words in
order with few differences, and each word that tells licenses apart (names,
versions, numbers) without any. A confirmed template gives a span of the text.

The templates are a small table of the user (by default the notices below),
sent to the tasks. One pass over the documents without a shuffle; texts
without the vocabulary cost a few substring searches. Blocks that many
documents share are judged once per process.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_notices import NOTICES

VOCABULARY = ("licen", "copyright", "warrant", "redistribut", "public domain", "creative commons", "cc by", "cc-by", "cc0", "permission is hereby")
HIT = re.compile("|".join(VOCABULARY))
WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
#: Words that must be the same in the block and the template: numbers and names of licenses.
TELLING = re.compile(r".*[0-9]|gpl|lgpl|agpl|gnu|lesser|library|affero|mit|apache|bsd|mozilla|mpl|isc|creative|commons|by|nc|sa|nd|by-sa|by-nc|by-nd|"
                     r"by-nc-sa|by-nc-nd|noncommercial|non-commercial|sharealike|share-alike|noderivatives|unlicense|boost|eclipse|epl|zlib|artistic|public|domain")
AROUND, MOST_WORDS, RANKED = 40, 2000, 4


_telling = lru_cache(maxsize=100_000)(lambda word: bool(TELLING.fullmatch(word)))


def apart(found):
    """Of ``(license, start, end, ...)``, best first, those that overlap none before them, by start."""
    starts, out = [], []
    for f in found:
        i = bisect_left(starts, f[1])
        if (i == 0 or out[i - 1][2] <= f[1]) and (i == len(out) or out[i][1] >= f[2]):
            starts.insert(i, f[1])
            out.insert(i, f)
    return out


class Templates:
    """Templates prepared for a task: words, telling words, a compressor with the text as raw dictionary."""

    def __init__(self, rows, max_differences: float = 0.1):
        self.max_differences, self.alone = max_differences, zstandard.ZstdCompressor(level=9)
        self.items = []
        for name, text in rows:
            words = WORD.findall(text.lower())
            if words:
                d = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.items.append((name, words, [w for w in words if TELLING.fullmatch(w)], zstandard.ZstdCompressor(level=9, dict_data=d)))
        self.longest = max((len(w) for _, w, _, _ in self.items), default=0)
        self.judge = lru_cache(maxsize=20_000)(self._judge)

    def _judge(self, block: tuple[str, ...]) -> list[tuple[str, int, int, float, int]]:
        """Confirmed ``(license, first word, end word, reduction, differing words)``, no two of them overlapping."""
        data = " ".join(block).encode()
        alone = len(self.alone.compress(data))
        ranked = []
        for name, words, telling, compressor in self.items:
            ranked.append((1 - len(compressor.compress(data)) / alone, name, words, telling))
        ranked.sort(key=lambda x: (-x[0], x[1]))
        found = []
        present = set(block)
        # the reduction only ranks: in a long block a short dictionary may make the output larger though its notice stands there
        for reduction, name, words, telling in ranked:
            if not present.issuperset(telling) or sum(w not in present for w in words) > int(self.max_differences * len(words)):
                continue
            for first, end, differ in self._places(block, words, telling):
                found.append((name, first, end, round(reduction, 6), differ))
        return apart(sorted(found, key=lambda x: (x[1] - x[2] + x[4], -x[3], x[0], x[1])))  # longest exact wording first

    def _places(self, block, words, telling):
        """Where the block holds the template, copies with differences too, overlapping ones among them.

        A copy has at most ``allowed`` differences, so it holds one of any ``allowed + 1`` of the template's words
        at its place unchanged, and any telling word: from the rarest of these on it is aligned word by word."""
        allowed, has = int(self.max_differences * len(words)), {w: [] for w in words}
        for i, w in enumerate(block):
            if w in has:
                has[w].append(i)
        rare = sorted(range(len(words)), key=lambda k: (len(has[words[k]]), k))
        if not has[words[rare[min(allowed, len(words) - 1)]]]:
            return
        anchors = rare[:allowed + 1]
        told = [k for k in rare if words[k] in telling][:1]
        if told and len(has[words[told[0]]]) < sum(len(has[words[k]]) for k in anchors):
            anchors = told
        whole, fixed, vocabulary = tuple(words), [_telling(w) for w in words], set(words)
        for at in sorted({i - k for k in anchors for i in has[words[k]]}):
            if block[max(0, at):at + len(words)] == whole:
                yield max(0, at), at + len(words), 0
            elif len(vocabulary.difference(block[max(0, at - allowed):at + len(words) + allowed])) <= allowed:
                yield from _align(block, words, fixed, at, allowed)


def _align(block, words, fixed, at: int, allowed: int):
    """The copies ``(first, end, differing words)`` with fewest missing and added words of those that start up to ``allowed``
    words from ``at``: the longest and, if it is another one, the shortest. ``fixed`` words are neither missing nor added."""
    far = (allowed + 1, 0, 0)
    found = set()
    for sign in (1, -1):  # of as many differences the smaller first word and larger end, or the other way
        # (differences, sign * first word, -sign * end) by the block's words gone through, from at - allowed + k on after k template words
        row = [(0, sign * j, -sign * j) if 0 <= j <= len(block) else far for j in range(at - allowed, at + allowed + 1)]
        for k, w in enumerate(words):
            new = []
            for d in range(2 * allowed + 1):
                j = at + k + d - allowed  # the block's word that the template's word k may be
                best = far
                if 0 <= j < len(block) and block[j] == w:
                    best = row[d][:2] + (-sign * (j + 1),)
                if not fixed[k] and d < 2 * allowed and row[d + 1][0] < allowed:
                    best = min(best, (row[d + 1][0] + 1,) + row[d + 1][1:])
                if d and 0 <= j < len(block) and new[d - 1][0] < allowed and not _telling(block[j]):
                    best = min(best, (new[d - 1][0] + 1,) + new[d - 1][1:])
                new.append(best)
            row = new
            if min(row)[0] > allowed:
                return
        differ, first, end = min(row)
        found.add((sign * first, -sign * end, differ))
    yield from sorted(x for x in found if x[0] < x[1])


def blocks(text: str, longest: int):
    """Blocks ``(words, their places)`` around the vocabulary, each at most ``MOST_WORDS`` words; blocks of one stretch overlap by the longest template."""
    low = text.lower()
    if len(low) != len(text) or not any(v in low for v in VOCABULARY):
        if not any(v in low for v in VOCABULARY):
            return
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)  # keep the places
    places = [m.span() for m in WORD.finditer(low)]
    starts = [a for a, _ in places]
    stretches, reach = [], AROUND + longest
    for m in HIT.finditer(low):
        i = max(0, bisect_right(starts, m.start()) - 1)
        if stretches and i - reach <= stretches[-1][1]:
            stretches[-1][1] = i + reach
        else:
            stretches.append([max(0, i - reach), i + reach])
    for a, z in stretches:
        z = min(z, len(places))
        while a < z:
            some = places[a:min(z, a + MOST_WORDS)]
            yield tuple(low[s:e] for s, e in some), some
            if a + MOST_WORDS >= z:
                break
            a += MOST_WORDS - longest * 2


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("differences", pa.int64())]))


def _scan(rows, max_differences):
    def run(batches):
        templates = Templates(rows, max_differences)
        for batch in batches:
            counts, out = [], []
            for text in batch.column(1):
                n, found = 0, set()
                for words, places in blocks(text.as_py() or "", templates.longest):
                    n += 1
                    for name, first, end, reduction, differ in templates.judge(words):
                        found.add((first - end + differ, -reduction, name, places[first][0], places[end - 1][1], differ))
                counts.append(n)
                # overlapping blocks repeat a span, or one has it whole and the other cut
                spans = apart((name, start, end, -less, differ) for _, less, name, start, end, differ in sorted(found))
                out.append([dict(zip(("license", "start", "end", "reduction", "differences"), x)) for x in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, _FOUND)], names=["doc_id", "n_blocks", "found"])
    return run


def scan(docs: DataFrame, templates=NOTICES, max_differences: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_blocks, found``: found is an array of ``(license, start, end, reduction, differences)`` by start (code points).

    ``templates`` are pairs (license, text). Defined cases: null and empty
    texts have no blocks; a template without words is left out; of overlapping
    matches the one with the longest exact wording counts, then the larger
    reduction, then the smaller name; rows repeated alike give equal rows; no
    rows give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(list(templates), max_differences),
                           f"doc_id {kind}, n_blocks long, found array<struct<license:string,start:long,end:long,reduction:double,differences:long>>")
