"""Toxicity from a weighted finite-state pattern grammar.

Words become symbols, clauses strings of symbols. Five transducers pass them on from one to the next: the insult transducer reads an insult by itself, one
that is stressed ("such an utter idiot") and phrases ("waste of space", "piece of trash"); the threat transducer tells a verb of violence after
an intention ("going to hurt") from one without; report and negation give each find its mode; the target transducer holds a find
back for a few words, so that whom it is aimed at may come before or after it. Composed, they are one machine that reads a clause once; its states
are worked out as clauses reach them. Every find's path weighs what its arcs weigh, and a text's score adds clauses, not isolated words.

The insult lexicon grows from labelled rows: stems that hardly occur in texts labelled clean. Weights start from the grammar's own and are fitted
to labelled rows by regularised logistic regression that keeps the grammar's order: aimed weighs no less than unaimed, a phrase no less than a word, a threat
no less than mere violence or an insult, and a negated or reported find no more than a plain one. Labels, language, source and id are never inputs of a score."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomnet.llm.common import NULL_ID, as_bytes, bounded_batches, ids_of, materialize, pieces, split_words, text_bytes

# --- the lexicons that hold without training ------------------------------------
INSULTS = "idiot moron scum trash loser clown pathetic worthless disgusting stupid imbecile bastard filth vermin subhuman"
THREATS = "kill murder hurt destroy stab shoot strangle burn beat exterminate"
TARGETS = "you your yours u he his him she her they them their it this that these those everyone"
NEGATIONS = "not no never none nobody isn't aren't don't doesn't won't wasn't weren't nor without"
REPORTS = "said says say called calls told tells wrote writes claimed claims quoted quote reported alleged allegedly"
INTENTIONS = "will going gonna shall want wants wanna gotta i'll we'll should must plan plans ready"
STRESSES = "such so very really utter utterly absolute absolutely total totally complete completely bloody damn"
MEASURES, LINKS, REFUSE_WORDS = "piece waste load bunch sack bag heap", "of", "space skin oxygen air dirt garbage"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENTION, STRESS, MEASURE, LINK, REFUSE = range(11)
LEXICON = ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INTENTION, INTENTIONS), (STRESS, STRESSES), (MEASURE, MEASURES), (LINK, LINKS), (REFUSE, REFUSE_WORDS))
#: How many words on a negation, an intention or a target is still felt.
REACH = 4
KINDS = ("insult", "strong_insult", "violence", "threat")
MODES = ("", "_negated", "_reported")
PATTERNS = [f"{kind}{t}{m}" for kind in KINDS for t in ("", "_at_target") for m in MODES]
#: The grammar's own arc weights: of a find by kind, what a target adds, and what the mode leaves of both; and the bias.
KIND_WEIGHTS, TARGET_WEIGHTS, MODE_SHARES = (3.0, 4.0, 0.5, 3.0), (1.0, 1.0, 4.0, 2.0), (1.0, 0.15, 0.35)
GRAMMAR_WEIGHTS = np.array([(k + t * aimed) * m for k, t in zip(KIND_WEIGHTS, TARGET_WEIGHTS, strict=True) for aimed in (0, 1) for m in MODE_SHARES])
BIAS = -2.0

LETTER_BREAKS = np.ones(256, bool)
LETTER_BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = False
CLAUSE_ENDS = np.zeros(256, bool)
CLAUSE_ENDS[[*b".!?;:\n"]] = True


# --- the transducers: (state, (symbol, find)) -> (state, (symbol, find)); a find is a kind, then (kind, mode) -----------
def insult_transducer(state: int, token):
    """States: 0, after a stress (1), after a measure (2), after a measure and its link (3)."""
    symbol, find = token
    if symbol == INSULT:
        find = 1 if state in (1, 3) else 0
    elif symbol == REFUSE and state == 3:
        find = 1
    return {STRESS: 1, MEASURE: 2, LINK: 3 if state == 2 else 0}.get(symbol, 0), (symbol, find)


def threat_transducer(state: int, token):
    """The state counts down the words for which an intention is felt."""
    symbol, find = token
    if symbol == THREAT:
        find = 3 if state else 2
    return REACH if symbol == INTENTION else max(0, state - 1), (symbol, find)


def mode_transducer(state: tuple[int, int], token):
    """State: whether a report came before in the clause, and the words for which a negation is still felt."""
    (reported, negated), (symbol, find) = state, token
    if find is not None:
        find = (find, 2 if reported else 1 if negated else 0)
    return (int(reported or symbol == REPORT), REACH if symbol == NEGATION else max(0, negated - 1)), (symbol, find)


def target_transducer(state: tuple, token):
    """State: the words for which a target is felt, and the finds that wait for one, each with the words it still waits. Gives patterns."""
    (felt, waiting), (symbol, find) = state, token
    out, still = [], []
    for (kind, mode), left in waiting:
        if symbol == TARGET:
            out.append(6 * kind + 3 + mode)
        elif left == 1:
            out.append(6 * kind + mode)
        else:
            still.append(((kind, mode), left - 1))
    if find is not None and felt:
        out.append(6 * find[0] + 3 + find[1])
    elif find is not None:
        still.append((find, REACH))
    return (REACH if symbol == TARGET else max(0, felt - 1), tuple(still)), tuple(out)


class Machine:
    """The composition of transducers, each reading what the one before gives; arcs are worked out when they are first taken."""

    def __init__(self, stages, starts):
        self.stages, self.start, self.arcs = stages, tuple(starts), {}

    def step(self, state: tuple, symbol: int) -> tuple[tuple, tuple]:
        arc = self.arcs.get((state, symbol))
        if arc is None:
            token, after = (symbol, None), []
            for stage, own in zip(self.stages, state, strict=True):
                own, token = stage(own, token)
                after.append(own)
            arc = self.arcs[state, symbol] = (tuple(after), token)
        return arc


MACHINE = Machine((insult_transducer, threat_transducer, mode_transducer, target_transducer), (0, 0, (0, 0), (0, ())))


def read_clause(at: list[int], symbols: list[int]) -> list[int]:
    """The patterns of a clause, given its words that are not OTHER and their places. Words after the last of these change nothing but that waiting ends."""
    out, state, last = [], MACHINE.start, None
    for place, symbol in zip([*at, at[-1] + REACH + 1], [*symbols, OTHER], strict=True):
        for _ in range(min(REACH, place - last - 1) if last is not None else 0):
            state, found = MACHINE.step(state, OTHER)
            out += found
        state, found = MACHINE.step(state, symbol)
        out += found
        last = place
    return out


@dataclass
class Grammar:
    """The lexicon (words, and stems that begin words) and the weights."""

    stems: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.append(GRAMMAR_WEIGHTS, BIAS))

    def __post_init__(self):
        self.words = {w: s for s, text in LEXICON for w in text.split()}
        self.lengths = sorted({len(s) for s in self.stems})

    def symbol(self, word: str) -> int:
        s = self.words.get(word, OTHER)
        if s == OTHER:
            for n in self.lengths:
                if n > len(word):
                    break
                if word[:n] in self.stems:
                    return INSULT
        return s

    def features(self, texts) -> np.ndarray:
        """For each text and pattern log(1 + clauses' matches)."""
        data, offsets = text_bytes(texts)
        words, first, clause, at = lettered(data, offsets)
        out = np.zeros((len(offsets) - 1, len(PATTERNS)))
        if not len(words):
            return out
        coded = words.dictionary_encode()
        kinds = np.fromiter((self.symbol(w.decode(errors="replace").lower()) for w in as_bytes(coded.dictionary)), np.int8, len(coded.dictionary))
        symbols = kinds[coded.indices.to_numpy(zero_copy_only=False)]
        hot = np.unique(clause[(symbols == INSULT) | (symbols == THREAT) | (symbols == REFUSE)])
        marked = np.flatnonzero((symbols != OTHER) & np.isin(clause, hot))
        doc = np.searchsorted(first, marked, side="right") - 1
        if not len(marked):
            return out
        cuts = np.flatnonzero(np.append(True, clause[marked][1:] != clause[marked][:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(marked)), strict=True):
            for p in read_clause(marked[a:b].tolist(), symbols[marked[a:b]].tolist()):
                out[doc[a], p] += 1
        return np.log1p(out)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ self.weights[:-1] + self.weights[-1])))


def lettered(data: np.ndarray, offsets: np.ndarray):
    """Words of letters, digits and apostrophes; each text's first; and each word's clause, numbered through."""
    words, first = split_words(data, offsets, LETTER_BREAKS)
    inside = ~LETTER_BREAKS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    begins[starts] = inside[starts]
    ends = CLAUSE_ENDS[data].astype(np.int64)
    ends[starts] += 1
    at = np.flatnonzero(begins)
    return words, first, np.cumsum(ends)[at], at


def train(rows: DataFrame, purity: float = 0.95, share: float = 0.01, kept: float = 0.95) -> Grammar:
    """Fit a grammar to a bounded sample of rows of text and label (0 or 1).

    A stem of four letters or more joins the lexicon if at least ``share`` of the texts labelled 1 (and four at least) have it and
    at least ``purity`` of the texts that have it are labelled 1. It is as long as it can be: letters are added up to the whole word while ``kept`` of
    its texts labelled 1 stay. Without both labels the grammar's own lexicon and weights stand."""
    rows = materialize(rows.where("label in (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label")), "labelled")

    def stems(batches):
        for batch in pieces(batches, "text", 2_000_000):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            data, offsets = text_bytes(batch.column("text"))
            words, first, _, _ = lettered(data, offsets)
            all_words = as_bytes(words)
            for k, label in enumerate(batch.column("label").to_pylist()):
                own = {w.decode(errors="replace").lower() for w in set(all_words[first[k] : first[k + 1]])}
                seen[label].update({w[:n] for w in own for n in range(4, min(len(w), 7) + 1)} | {w for w in own if len(w) >= 4})
            both = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array([seen[1][s] for s in both], pa.int64()), pa.array([seen[0][s] for s in both], pa.int64())], names=["stem", "toxic", "clean"])

    bounded_batches(rows.sparkSession)
    toxic = rows.where("label = 1").count()
    counted = rows.mapInArrow(stems, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = counted.where((F.col("toxic") >= max(4, share * toxic)) & (F.col("toxic") >= purity * (F.col("toxic") + F.col("clean")))).select("stem", "toxic").collect()
    grammar = Grammar(dict.fromkeys(longest({r["stem"]: r["toxic"] for r in found}, kept), INSULT))

    def features(batches):
        for batch in pieces(batches, "text", 2_000_000):
            yield pa.RecordBatch.from_arrays([pa.array(grammar.features(batch.column("text")).tolist(), pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

    sample = rows.mapInArrow(features, "x array<double>, label int").groupBy("x", "label").count().toPandas()  # different feature rows of a bounded sample
    if sample["label"].nunique() == 2:
        sample = sample.sort_values("x", key=lambda c: c.map(tuple)).sort_values("label", kind="stable")
        grammar.weights = fit(np.stack(sample["x"]), sample["label"].to_numpy(float), sample["count"].to_numpy(float), grammar.weights)
    return grammar


def longest(found: dict[str, int], kept: float) -> list[str]:
    """Of stems with their numbers of texts those that begin no other one's words: the shortest, each lengthened while a longer one keeps that share of its texts."""
    chosen: list[str] = []
    covered: set[str] = set()
    for stem in sorted(found, key=lambda s: (len(s), s)):
        if not any(stem[:n] in covered for n in range(4, len(stem))):
            covered.add(stem)
            longer = [s for s in found if s.startswith(stem) and found[s] >= kept * found[stem]]
            chosen.append(max(longer, key=lambda s: (len(s), found[s], s)))
    return chosen


def _order() -> list[tuple[int, int]]:
    """Pairs of patterns of which the second weighs at least what the first does."""
    at = np.arange(len(PATTERNS)).reshape(len(KINDS), 2, len(MODES))
    rises = [(at[:, 0], at[:, 1]), (at[0], at[1]), (at[2], at[3]), (at[0], at[3]), (at[:, :, 1], at[:, :, 0]), (at[:, :, 2], at[:, :, 0])]
    return [(int(i), int(j)) for low, high in rises for i, j in zip(low.ravel(), high.ravel(), strict=True)]


ORDER = _order()


def fit(x: np.ndarray, y: np.ndarray, times: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to the prior weights, with weights of at least 0 in ORDER: what breaks these is penalised, and the little that is left
    of it is evened out at the end. A step is halved while it makes things worse."""
    x = np.column_stack([x, np.ones(len(x))])
    n = len(prior)
    bounds = np.zeros((len(ORDER) + n - 1, n))  # each row times the weights is to be 0 or more
    for k, (low, high) in enumerate(ORDER):
        bounds[k, low], bounds[k, high] = -1, 1
    bounds[len(ORDER) :, :-1] = np.eye(n - 1)
    stiff = 100 * (strength + times.sum())

    def cost(w):
        z = x @ w
        broken = np.minimum(bounds @ w, 0)
        return (times * (np.logaddexp(0, z) - y * z)).sum() + strength / 2 * ((w - prior) ** 2).sum() + stiff / 2 * (broken**2).sum()

    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        broken = bounds[bounds @ w < 0]
        slope = x.T @ (times * (p - y)) + strength * (w - prior) + stiff * broken.T @ (broken @ w)
        bend = (x * (times * p * (1 - p))[:, None]).T @ x + strength * np.eye(n) + stiff * broken.T @ broken
        step = np.linalg.solve(bend, slope)
        now, share = cost(w), 1.0
        while share > 1e-6 and cost(w - share * step) > now:
            share /= 2
        w = w - share * step
        if np.abs(share * step).max() < 1e-8:
            break
    w[:-1] = np.maximum(w[:-1], 0)
    for _ in range(3):  # a pattern is at most three rises above the least
        for low, high in ORDER:
            w[high] = max(w[high], w[low])
    return w


def toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) and matches (patterns found) of every whole text.

    Null and empty texts match nothing and get the score that the bias alone gives. Rows are scored one by one: repeated rows get equal scores,
    a null doc_id is kept, an empty table gives none."""

    def score(batches):
        for batch in pieces(batches, "text", 2_000_000):
            x = grammar.features(batch.column("text"))
            s = grammar.scores(x)
            keys = ids_of(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, mask=keys == NULL_ID), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(np.rint(np.expm1(x).sum(axis=1)).astype(np.int64))], names=["doc_id", "score", "predicted", "matches"]
            )

    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(score, "doc_id long, score double, predicted int, matches long")


def held_out(doc_id):
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> Grammar:
    """A grammar from the label ``toxic`` of rows that are not held out: at most ``sample_rows`` of them, those whose hashed ids are least.

    The sample is chosen among the labels, so what is broadcast to find its texts has a fixed bound, and no text is shuffled."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("__loom_id")).agg(F.max("toxic").alias("label"))
    sample = known.orderBy(F.xxhash64("__loom_id"), "__loom_id").limit(sample_rows)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).join(F.broadcast(sample), F.col("doc_id") == F.col("__loom_id"))
    return train(texts.select("text", "label"), **options)


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold; every row is judged where it stands, without a shuffle."""

    def keep(batches):
        for batch in pieces(batches, "text", 2_000_000):
            yield batch.filter(pa.array(grammar.scores(grammar.features(batch.column("text"))) < threshold))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
