"""Toxicity by a weighted finite-state pattern grammar.

The insult lexicon, whole words and word beginnings with weights, is learned from labelled rows; the
closed classes (threats, persons, negations, verbs of speech) are short lists. A document is read
clause by clause. The composed machine weighs each insult by its context, and completes a threat by a
person; a clause with such matches scores the sum of its matches' weights. A document is scored by
its clauses: the highest and the total score and the share of clauses that matched.

Learned in turn, all on a bounded sample of labelled rows: the lexicon; the machines' weights, from a
logistic regression over what each context holds, shrunk toward stated values by the number of rows
that show the context; the regression over clause scores. Scoring covers every text and shuffles none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symquarry.llm.store import bounded_batches, parts, written
from symquarry.llm.transducers import INSULT, NEGATED, NEGATION, OTHER, REPORT, REPORTED, TARGET, TARGETED, THREAT, THREATENED, clause_grammar

THREATS = "kill hurt destroy beat stab shoot punish crush töten schlagen vernichten tuer frapper détruire matar golpear destruir"
PERSONS = "you your yours he she they him her them du dich dir euch ihr tu te toi vous usted tú ti ustedes"
NEGATIONS = "not no never nobody none isn aren nicht kein keine nie pas jamais aucun nunca ningún"
SPEECH = "said says say claimed called quoted wrote told sagte nannte schrieb dit appelé écrit dijo llamó escribió"
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
STOPS = frozenset(".!?;\n")
#: A word beginning that stands for words not listed themselves.
PREFIX_LENGTHS = (4, 5, 6, 7)
#: Log odds of a listed word, and the chance it may have of being as frequent in toxic rows by accident (words, beginnings).
LEAST_ODDS, WORD_CHANCE, BEGINNING_CHANCE = 1.5, 1e-4, 1e-6
CONTEXTS = 5  # plain, targeted, negated, reported, threat
#: Weights of the contexts before anything is learned, and the rows that count as much as they.
STATED, STATED_ROWS = (1.0, 1.5, 0.5, 0.5, 1.0), 20.0
THRESHOLD = 0.3
#: Words that a worker remembers the class of.
MEMO = 50_000


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_words(batches):
    """(word, toxic, clean) document counts of a partition; beginnings end in '*'."""
    toxic, clean = Counter(), Counter()
    for batch in parts(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for w in TOKEN.findall((text or "").lower()) if w not in STOPS}
            words |= {w[:n] + "*" for w in words for n in PREFIX_LENGTHS if len(w) > n}
            (toxic if label else clean).update(words)
        if len(toxic) + len(clean) > 300_000:
            yield _counted(toxic, clean)
            toxic, clean = Counter(), Counter()
    yield _counted(toxic, clean)


def _counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    words = list(toxic.keys() | clean.keys())
    columns = [pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "clean"])


def chance(hits: int, trials: int, rate: float) -> float:
    """Probability of so many hits or more by accident: the binomial tail, until its terms no longer count."""
    if rate <= 0 or rate >= 1:
        return 1.0
    k = hits
    term = math.exp(
        math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * math.log(rate) + (trials - k) * math.log1p(-rate)
    )
    total, odds = 0.0, rate / (1 - rate)
    while k <= trials:
        total += term
        k += 1
        term *= (trials - k + 1) / k * odds
        if term <= 1e-16 * total and k > trials * rate:
            break
    return min(1.0, total)


def lexicon(labelled: DataFrame) -> dict[str, float]:
    """Weights of words and beginnings ('*') that are far likelier in toxic rows; (text, toxic) in.

    Listed is every word whose log odds reach LEAST_ODDS and whose count is no accident. Its size is
    bounded by the words of the sample.
    """
    n = labelled.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not n.n or not n.t or n.n == n.t:
        return {}
    rate = n.t / n.n
    # t hits have at least the probability rate ** t: fewer can't be significant.
    fewest = math.log(WORD_CHANCE) / math.log(rate)
    counts = labelled.mapInArrow(_count_words, "word string, toxic long, clean long").groupBy("word")
    counts = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= fewest)
    odds = F.log((F.col("t") + 0.5) / (n.t + 1)) - F.log((F.col("c") + 0.5) / (n.n - n.t + 1))
    rows = counts.withColumn("w", odds).where(F.col("w") >= LEAST_ODDS).orderBy(F.col("t").desc(), "word").collect()
    kept = {r.word: r.w for r in rows if chance(r.t, r.t + r.c, rate) <= (BEGINNING_CHANCE if r.word.endswith("*") else WORD_CHANCE)}
    # A beginning only stands for other words: drop those that one listed word explains.
    counts_of = {r.word: r.t for r in rows}
    most: dict[str, int] = {}
    for w in kept:
        if not w.endswith("*"):
            for n in PREFIX_LENGTHS:
                most[w[:n]] = max(most.get(w[:n], 0), counts_of[w])
    kept = {w: x for w, x in kept.items() if not w.endswith("*") or most.get(w[:-1], 0) < 0.8 * counts_of[w]}
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0])))


class Grammar:
    """Reads texts; picklable: the lexicon, the machine's table and the regression's coefficients."""

    def __init__(self, weights: dict[str, float], contexts: tuple[float, ...] = STATED):
        self.words: dict[str, tuple[int, float]] = {}
        for cls, listed in ((THREAT, THREATS), (TARGET, PERSONS), (NEGATION, NEGATIONS), (REPORT, SPEECH)):
            self.words.update((w, (cls, 0.0)) for w in listed.split())
        self.words.update((w, (INSULT, x)) for w, x in weights.items() if not w.endswith("*"))
        self.prefixes = {w[:-1]: x for w, x in weights.items() if w.endswith("*")}
        self.starts = {p[: PREFIX_LENGTHS[0]] for p in self.prefixes}
        self.coefficients = np.zeros(1 + self.width())
        self.memo: dict[str, tuple[int, float]] = {}
        self.weigh(contexts)

    def weigh(self, contexts: tuple[float, ...]) -> None:
        """Composes the machines anew with the weights of the contexts, relative to a plain match."""
        plain, targeted, negated, reported, threat = (math.log(max(x, 1e-3)) for x in contexts)
        self.contexts = contexts
        self.table = clause_grammar(negated - plain, reported - plain, targeted - plain, threat - plain)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    @staticmethod
    def width() -> int:
        return 6

    def classify(self, word: str) -> tuple[int, float]:
        known = self.words.get(word)
        if known is None:
            known = (OTHER, 0.0)
            if word[: PREFIX_LENGTHS[0]] in self.starts:
                for n in reversed(PREFIX_LENGTHS):
                    if len(word) > n and word[:n] in self.prefixes:
                        known = (INSULT, self.prefixes[word[:n]])
                        break
        return known

    def matches(self, text: str | None):
        """(clauses, words, matched clauses); a matched clause is a list of (context, score), a match each."""
        found: list[list[tuple[int, float]]] = []
        tokens = TOKEN.findall((text or "").lower())
        table, memo, classify = self.table, self.memo, self.classify
        if len(memo) > MEMO:
            memo.clear()
        state, threat, clauses, words, clause, before = 0, False, 0, 0, [], True
        for token in tokens:
            known = memo.get(token)
            if known is None:
                known = memo[token] = (-1, 0.0) if token in STOPS else classify(token)
            cls, weight = known
            if cls < 0:
                clauses += not before
                before = True
                if clause:
                    found.append(clause)
                    clause = []
                state, threat = 0, False
                continue
            words += 1
            before = False
            if cls == OTHER and not state:
                continue
            state, mark, log_weight = table[state][cls]
            if cls == INSULT:
                context = 2 if mark & NEGATED else 3 if mark & REPORTED else 1 if mark & TARGETED else 0
                clause.append((context, weight * math.exp(log_weight)))
            elif cls == THREAT:
                threat = not mark & (NEGATED | REPORTED)
            elif mark & THREATENED and threat:
                clause.append((4, math.exp(log_weight)))
        if clause:
            found.append(clause)
        return clauses + (not before), words, found

    def held(self, text: str | None) -> list[float]:
        """The weight of what each context holds, damped."""
        sums = [0.0] * CONTEXTS
        for clause in self.matches(text)[2]:
            for context, score in clause:
                sums[context] += score / (self.contexts[context] / self.contexts[0])
        return [math.log1p(s) for s in sums]

    def features(self, text: str | None) -> list[float]:
        """Of the clauses' scores the total (damped) and the highest, also by words; matched clauses, their share; words."""
        clauses, words, found = self.matches(text)
        scores = [sum(score for _, score in clause) for clause in found]
        total = sum(scores)
        return [
            math.log1p(total), max(scores, default=0.0), math.log1p(100.0 * total / words) if words else 0.0,
            math.log1p(len(scores)), len(scores) / clauses if clauses else 0.0, math.log1p(words),
        ]

    def score(self, text: str | None) -> float:
        z = self.coefficients[0] + float(np.dot(self.coefficients[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved until the loss falls; the first coefficient is the intercept."""
    x = np.hstack((np.ones((len(x), 1)), x))
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0.0, z) - y * z).sum() + 0.5 * b @ penalty @ b)

    b = np.zeros(x.shape[1])
    now = loss(b)
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ b)
        while (new := loss(b + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if new > now:
            break
        b, gain, now = b + step, now - new, new
        if gain <= 1e-9 * (1 + now):
            break
    return b


def _measure(read):
    """Batches of (text, toxic): what ``read`` gives of each text, and the label."""

    def run(batches):
        for batch in parts(batches):
            rows = [read(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 40_000, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Learns the grammar from about ``sample_rows`` labelled rows at most, none of them held out.

    The sample is a share of the ids by hash; it bounds what is broadcast (ids and labels) and kept
    (texts, in the shared folder). Of equal texts one row teaches, so that copies don't pass for
    evidence, and of rows that repeat an id the one with the greatest text. Rows without a label or id teach nothing; without both classes every score is low.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and __id is not null")
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    share = int(1_000_000 * min(1.0, sample_rows / max(known.count(), 1)))
    known = known.where(F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(1_000_000)) < share)
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    hashed = rows.join(F.broadcast(known), "__id").select("__id", F.xxhash64("text").alias("h"))
    once = hashed.groupBy("h").agg(F.min("__id").alias("__id")).join(known, "__id").select("__id", "toxic")
    train = rows.join(F.broadcast(once), "__id").groupBy("__id", "toxic").agg(F.max("text").alias("text"))
    train = written(train.select("text", "toxic"), "toxic-sample")
    grammar = Grammar(lexicon(train))
    x, y = _table(train, grammar.held)
    if not 0 < y.sum() < len(y):
        grammar.coefficients[0] = -3.0
        return grammar
    grammar.weigh(context_weights(x, y))
    grammar.coefficients = logistic(*_table(train, grammar.features))
    return grammar


def _table(train: DataFrame, read) -> tuple[np.ndarray, np.ndarray]:
    rows = train.mapInArrow(_measure(read), "x array<double>, toxic int").collect()  # the bounded sample
    return np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)


def context_weights(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of the contexts relative to a plain match, from what each holds (rows of ``Grammar.held``) and the labels."""
    b = logistic(x, y)[1:]
    many = (x > 0).sum(axis=0)
    out = []
    for k in range(CONTEXTS):
        seen = min(max(b[k] / b[0], 0.0), 4.0) if b[0] > 0 else STATED[k]
        out.append(float((many[k] * seen + STATED_ROWS * STATED[k]) / (many[k] + STATED_ROWS)))
    out[0] = 1.0
    return tuple(out)


def _score(grammar: Grammar):
    def run(batches):
        for batch in parts(batches):
            scores = [grammar.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; a null text scores as an empty one."""
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(grammar), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _unflagged(grammar: Grammar, column: int, threshold: float):
    def run(batches):
        for batch in parts(batches):
            keep = [grammar.score(t) < threshold for t in batch.column(column).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def without_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged and in place.

    A null text scores as an empty one; repeated rows go or stay together; an empty table gives an empty one.
    """
    return bounded_batches(docs).mapInArrow(_unflagged(grammar, docs.columns.index(text_col), threshold), docs.schema)
