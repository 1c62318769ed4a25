"""Toxicity by a weighted finite-state pattern grammar over clauses.

The lexicon is learned from labelled rows: patterns are whole words or word beginnings (``stem*``) that
stand in far more toxic than clean training documents. A pattern's evidence is a log-ratio for one, two,
and three or more matches in a document (it is flat from there on), because a stem may turn up once by chance. Copies among
the training rows count once (by the least hash of their word shingles), so that the words
of a copied document are not taken for insults.

A text is cut into clauses at line ends and sentence marks, and a clause's words into symbols: their class (negator, target, urge,
verb of saying, quotation mark, other) and whether they are lexicon words. Five transducers, the first over letters and the others over these symbols, are
each a table of arcs (state, symbol) -> (state, mark):

* insult: reads a word's letters and emits the pattern it is (a whole word, or else the shortest stem), which makes it a lexicon word to the others;
* threat: marks one after a word of future or duty up to three words before;
* target: marks one with an addressed person up to four words to either side. What follows is not known yet, so this one
  guesses: one arc marks the word and dies unless a person follows in time, the other does not and dies if one follows;
* negation: marks one after a negator up to three words before;
* reported speech: marks one after a verb of saying or an opened quotation in the clause.

The grammar is their composition, made state by state when first needed; a clause's reading is its best accepted path by the sum of
the marks' weights on it, and each lexicon word has its own share of that sum. The weights are log-ratios between lexicon words in toxic and in clean training
documents, shrunk to 0 where there are few. A document scores the logistic of the prior, the evidence of
the patterns by their matched clauses, and for each pattern the greatest share that a path gives it.

Defined results: bytes of a string that are no UTF-8 become U+FFFD first; null, empty and wordless texts have no clause and score the prior alone (near 0);
without labelled rows of both kinds the lexicon is empty; a null label is not learned; of several
labels of a document the largest counts; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from itertools import product

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import materialize, ship_package

SAMPLE_ROWS = 10_000
COUNT_TASKS = 48  # a task counts some 200 documents, so its tables stay small
MIN_DOCS, MIN_SHARE, MIN_DEVIATION = 4, 0.02, 6.0
STEM_LENGTHS = (3, 4, 5, 6, 7, 8, 9)
THRESHOLD = 0.7
MAX_MATCHES = 3  # of one pattern in a document; its evidence is flat from there on
MISSING = 2.5
MODIFIERS = ("threat", "target", "negation", "report")

# fixed values: the grammar's closed word classes, in the four languages of the corpora this was built for
NEGATORS = "not no never nor none isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals nunca jamás tampoco ne pas jamais aucun aucune".split()
TARGETS = "you your you're he she they him her them his their du dich dir ihr euch sie er tú te ti vosotros ustedes él ella ellos tu toi vous il elle ils elles".split()
URGES = "will shall going gonna must werde wirst wird werden voy vas va vamos vais allons allez vont".split()
REPORTS = "said says say told tells quote quoted wrote writes called sagte sagt schrieb dijo dice escribió dit disait écrit".split()

QUOTES = ('"', "“", "„", "«")
CLASSES = {"n": NEGATORS, "t": TARGETS, "u": URGES, "r": REPORTS, "q": QUOTES}

_CLASS = {w: c for c, ws in CLASSES.items() for w in ws}
_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_SYMBOL = re.compile(rf"{_WORD.pattern}|[{''.join(QUOTES)}]")


def patterns(text: str) -> Counter:
    """What a text may be recognised by, with the times it is there: words and, with a star, the beginnings of them."""
    out: Counter = Counter()
    for w, k in Counter(_WORD.findall(text.lower())).items():
        out[w] += k
        for n in STEM_LENGTHS:
            if len(w) > n:
                out[w[:n] + "*"] += k
    return out


def copy_key(text: str) -> int:
    """Near copies mostly share the least hash of their 5-word shingles."""
    words = text.split()
    return min((xxhash.xxh3_64_intdigest(" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))), default=0) >> 1


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, seed: int) -> DataFrame:
    """text, toxic of at most about ``sample_rows`` labelled rows drawn by a hash of doc_id, copies once.

    The drawn ids are bounded by ``sample_rows`` and so are broadcast.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = int(min(1.0, sample_rows / max(1, marks.count())) * 1_000_000 + 0.5)
    drawn = marks.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) < share)
    rows = docs.where("text is not null").select("doc_id", F.make_valid_utf8("text").alias("text")).join(F.broadcast(drawn), "doc_id")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [copy_key(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["text", "toxic", "copy_key"])

    keyed = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(key, "text string, toxic int, copy_key long")
    return keyed.groupBy("copy_key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> dict:
    """The model: {"evidence": {pattern: log-ratios for 1, 2 and 3 or more matches}, "prior": log-odds, "weights": {modifier: weight}}.

    ``labels``: doc_id, toxic, restricted to the rows to learn from. Each task counts its documents by
    pattern and label before the shuffle; the driver gets the telling patterns, which the sample's
    rows bound: each stands in MIN_SHARE of the toxic ones at least.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = materialize(training_rows(docs, labels, sample_rows, seed), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seen[toxic > 0]
                own.update((p, min(k, MAX_MATCHES)) for p, k in patterns(text).items())
                own["", 1] += 1
        names = list(seen[True].keys() | seen[False].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in names], pa.string()), pa.array([k for _, k in names], pa.int32()), *(pa.array([seen[y][x] for x in names], pa.int64()) for y in (True, False))],
            names=["pattern", "k", "toxic", "clean"],
        )

    each = [F.sum(F.when(F.col("k") == k, F.col(y)).otherwise(0)).alias(f"{y}{k}") for k in range(1, MAX_MATCHES + 1) for y in ("toxic", "clean")]
    counted = rows.repartition(COUNT_TASKS).mapInArrow(count, "pattern string, k int, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *each)
    counts = materialize(counted.where(F.col("toxic") >= MIN_DOCS), "toxic-counts")
    total = counts.where("pattern = ''").first()
    toxic, clean = (total["toxic"], total["clean"]) if total else (0, 0)
    if not toxic or not clean:
        return {"evidence": {}, "prior": -5.0, "weights": dict.fromkeys(MODIFIERS, 0.0)}
    share = toxic / (toxic + clean)
    expected = (F.col("toxic") + F.col("clean")) * share
    telling = counts.where("pattern <> ''").where(F.col("toxic") >= max(MIN_DOCS, MIN_SHARE * toxic)).where(F.col("toxic") - expected >= MIN_DEVIATION * F.sqrt(expected))
    found = {r["pattern"]: r for r in telling.orderBy(F.desc("toxic"), "pattern").collect()}
    prior = math.log(toxic / clean)
    evidence = {p: _evidence(found[p], share, prior) for p in _choose({p: r["toxic"] for p, r in found.items()})}
    model = {"evidence": evidence, "prior": prior, "weights": dict.fromkeys(MODIFIERS, 0.0)}
    model["weights"] = fit_modifiers(rows, model)
    return model


def _choose(toxic: dict[str, int]) -> list[str]:
    """The most general patterns: one gives way to a longer one that holds in hardly fewer toxic documents."""

    def extends(q: str, p: str) -> bool:
        return q != p and p.endswith("*") and q.startswith(p[:-1])

    general = [p for p in toxic if not any(extends(q, p) and toxic[q] >= 0.8 * toxic[p] for q in toxic)]
    return [q for q in general if not any(extends(q, p) for p in general)]


def _evidence(row, share: float, prior: float) -> list[float]:
    out = []
    for k in range(1, MAX_MATCHES + 1):
        ratio = math.log((row[f"toxic{k}"] + share) / (row[f"clean{k}"] + 1 - share)) - prior
        out.append(max([ratio, *out[-1:]]))
    return out


def fit_modifiers(rows: DataFrame, model: dict, shrink: float = 8.0) -> dict[str, float]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, seen = Grammar(model), {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for _, hits in grammar.clauses(text):
                    for _, marks in hits:
                        seen[int(toxic > 0)].update((*marks, ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(MODIFIERS) + [""]), *(pa.array([seen[k][m] for m in (*MODIFIERS, "")], pa.int64()) for k in (1, 0))], names=["mark", "toxic", "clean"])

    got = {r["mark"]: (r["toxic"], r["clean"]) for r in rows.mapInArrow(count, "mark string, toxic long, clean long").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()}
    t_all, c_all = got.get("", (0, 0))
    out = {}
    for m in MODIFIERS:
        t, c = got.get(m, (0, 0))
        base = (t + c + 1) / (t_all + c_all + 2)
        out[m] = max(-3.0, min(1.0, math.log((t + shrink * base) / (t_all + shrink)) - math.log((c + shrink * base) / (c_all + shrink))))
    return out


Arcs = tuple[tuple[Hashable, str | None], ...]
SYMBOLS = tuple(c + hit for c in "nturqo" for hit in ("", "!"))  # a class of words, and ! for lexicon words


class Transducer:
    """Arcs by (state, symbol), closed from ``start`` under ``step``; a path is accepted if it ends in a state of ``final``."""

    def __init__(self, start: Hashable, step: Callable[[Hashable, str, bool], Arcs], final: Callable[[Hashable], bool] = lambda state: True):
        self.start, self.arcs, waiting = start, {}, [start]
        for state in waiting:
            for symbol in SYMBOLS:
                self.arcs[state, symbol] = step(state, symbol[0], symbol[1:] == "!")
                waiting += [to for to, _ in self.arcs[state, symbol] if to not in waiting]
        self.final = frozenset(filter(final, waiting))


class Insults:
    """The lexicon as a transducer over letters: deterministic arcs (state, letter) -> state, and what a word emits that ends in a state or leaves the
    arcs there."""

    def __init__(self, patterns):
        self.arcs: list[dict[str, int]] = [{}]
        whole: dict[int, str] = {}
        stems: dict[int, str] = {}
        for pattern in patterns:
            state = 0
            for letter in pattern.rstrip("*"):
                if letter not in self.arcs[state]:
                    self.arcs[state][letter] = len(self.arcs)
                    self.arcs.append({})
                state = self.arcs[state][letter]
            (stems if pattern.endswith("*") else whole)[state] = pattern
        self.leaves: list[str | None] = [None] * len(self.arcs)  # of a word that has more letters
        self.ends: list[str | None] = [None] * len(self.arcs)
        for state, arcs in enumerate(self.arcs):  # a state comes before those that it leads to
            self.ends[state] = whole.get(state, self.ends[state])
            self.leaves[state] = self.leaves[state] or stems.get(state)
            for to in arcs.values():
                self.ends[to] = self.leaves[to] = self.leaves[state]

    def read(self, word: str) -> str | None:
        state = 0
        for letter in word:
            to = self.arcs[state].get(letter)
            if to is None:
                return self.leaves[state]
            state = to
        return self.ends[state]


def after(kind: str, span: int, mark: str) -> Transducer:
    """Marks lexicon words up to ``span`` words after one of the class. The state: for how many words more."""

    def step(left: int, own: str, hit: bool) -> Arcs:
        to = span if own == kind else left if own == "q" else max(left - 1, 0)
        return ((to, mark if hit and left else None),)

    return Transducer(0, step)


def ever_after(kinds: str, mark: str) -> Transducer:
    """Marks lexicon words after any of the classes in the clause."""
    return Transducer(False, lambda seen, own, hit: ((seen or own in kinds, mark if hit and seen else None),))


def around(kind: str, span: int, mark: str) -> Transducer:
    """Marks lexicon words with one of the class up to ``span`` words before or after.

    The state: for how many words more one before counts, within how many words one has to follow, and for how many none may.
    """

    def step(state: tuple[int, int, int], own: str, hit: bool) -> Arcs:
        before, need, shun = state
        if own == "q":
            return ((state, None),)
        if own == kind:
            if shun:
                return ()
            to = span, 0, 0
        elif need == 1:
            return ()
        else:
            to = max(before - 1, 0), max(need - 1, 0), max(shun - 1, 0)
        if not hit:
            return ((to, None),)
        if before:
            return ((to, mark),)
        follows = to[0], to[1] or span, to[2]
        return ((follows, mark), ((to[0], to[1], span), None))

    return Transducer((0, 0, 0), step, lambda state: not state[1])


TRANSDUCERS = (after("u", 3, "threat"), around("t", 4, "target"), after("n", 3, "negation"), ever_after("rq", "report"))


class Grammar:
    """The composition of a model's transducers. Its arcs are made when first needed; there are at most as many states as
    combinations of the parts' states."""

    def __init__(self, model: dict):
        self.evidence = model["evidence"]
        self.prior, self.weights = model["prior"], model["weights"]
        self.insults = Insults(self.evidence)
        heads = sorted({p.rstrip("*")[:3] for p in self.evidence})
        self.find = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, heads))})[^\W\d_]*").finditer if heads else lambda text: iter(())
        self.arcs: dict[tuple, list[tuple[tuple, list[str], float]]] = {}

    def _arcs(self, state: tuple, symbol: str) -> list[tuple[tuple, list[str], float]]:
        """(state, marks, weight) of the composed arcs."""
        known = self.arcs.get((state, symbol))
        if known is None:
            known = []
            for some in product(*(t.arcs[own, symbol] for t, own in zip(TRANSDUCERS, state, strict=True))):
                marks = [mark for _, mark in some if mark]
                known.append((tuple(to for to, _ in some), marks, sum(self.weights[m] for m in marks)))
            self.arcs[state, symbol] = known
        return known

    def read(self, symbols: list[str]) -> tuple[float, list[list[str]]]:
        """Weight of the best accepted path and its marks for each lexicon word."""
        best: dict[tuple, tuple[float, tuple]] = {tuple(t.start for t in TRANSDUCERS): (0.0, ())}
        for symbol in symbols:
            following: dict[tuple, tuple[float, tuple]] = {}
            hit = symbol[1:] == "!"
            for state, (weight, path) in best.items():
                for to, marks, more in self._arcs(state, symbol):
                    if to not in following or following[to][0] < weight + more:
                        following[to] = weight + more, (path, marks) if hit else path
            best = following
        weight, path = max((found for state, found in best.items() if all(own in t.final for t, own in zip(TRANSDUCERS, state, strict=True))), key=lambda x: x[0])
        out = []
        while path:
            path, marks = path
            out.append(marks)
        return weight, out[::-1]

    def clauses(self, text: str) -> Iterator[tuple[str, list[tuple[str, list[str]]]]]:
        """(clause, [(pattern, modifiers) of each lexicon word]) of the clauses that have one."""
        lower = text.lower()
        found = [(m.start(), r) for m in self.find(lower) if (r := self.insults.read(m.group())) is not None]
        if not found:
            return
        bounds = [0, *(m.end() for m in _CLAUSE.finditer(lower)), len(lower)]
        by_clause: dict[int, dict[int, str]] = {}
        for at, pattern in found:
            k = bisect_right(bounds, at) - 1
            by_clause.setdefault(k, {})[at - bounds[k]] = pattern
        for k, hits in by_clause.items():
            clause = lower[bounds[k] : bounds[k + 1]]
            yield clause, self._read(clause, hits)

    def _read(self, clause: str, hits: dict[int, str]) -> list[tuple[str, list[str]]]:
        found = list(_SYMBOL.finditer(clause))
        own = [hits.get(m.start()) for m in found]
        _, marks = self.read([_CLASS.get(m.group(), "o") + ("!" if p else "") for m, p in zip(found, own, strict=True)])
        return list(zip(filter(None, own), marks, strict=True))

    def score(self, text: str) -> tuple[float, int]:
        """(probability, number of matched clauses)."""
        matches: Counter = Counter()
        best: dict[str, float] = {}
        n = 0
        for _, hits in self.clauses(text):
            n += 1
            for pattern, marks in hits:
                matches[pattern] += 1
                weight = sum(self.weights[m] for m in marks)
                best[pattern] = max(best.get(pattern, weight), weight)
        total = self.prior + sum(self.evidence[p][min(k, MAX_MATCHES) - 1] + best[p] for p, k in matches.items()) if n else self.prior - MISSING
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total)))), n


def score(docs: DataFrame, model: dict, *, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, ``keep``, score, predicted (1 if score >= threshold), n_clauses (matched)."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(sent.value)
        for batch in batches:
            found = [grammar.score(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array([n for _, n in found], pa.int64()),
                ],
                names=[*batch.schema.names[:-1], "score", "predicted", "n_clauses"],
            )

    kept = docs.select("doc_id", *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return docs.select("doc_id", *keep, F.make_valid_utf8("text").alias("__text")).mapInArrow(run, f"{fields}, score double, predicted int, n_clauses long")
