"""Quality rules under weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the votes of all documents estimates
how often each rule votes, how accurate it is and how many documents are good; a document's posterior
probability of being good decides, instead of the demand that it pass every rule.

The votes of R rules form one of 3**R patterns, so EM needs only the number of documents per pattern: one
aggregation, at most 3**R rows to the driver, exact at every size. Features come from one pass over whole
texts without a shuffle and are written once.

Nulls: a null text is empty: it has no words, fails the base rule and goes. Repeated rows are counted and
judged alike. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from deltaweave.llm.staging import stage
from deltaweave.llm.text import codes, distinct, mix, owners, slices, tuples, words

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ended")

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xF5] = True
_END = np.zeros(256, bool)
_END[list(b".!?\"'")] = True


def repeated(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which (owner, value) occur twice or more; owners ascend."""
    out = np.zeros(len(value), bool)
    if len(value) < 2:
        return out
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    same = key[1:] == key[:-1]
    if not same.any():
        return out
    suspect = np.zeros(int(owner[-1]) + 1, bool)
    suspect[(key[1:][same] >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(suspect[owner])
    at = at[np.lexsort((value[at], owner[at]))]
    twin = (value[at[1:]] == value[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
    out[at[1:][twin]] = out[at[:-1][twin]] = True
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of each text of a slice: one row a text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)), np.int64)
    if not len(data):
        return out
    text = owners(offsets)
    per = lambda mask: np.bincount(text[mask], minlength=n)
    head = (data & 0xC0) != 0x80
    starts, ends, first = words(data, offsets)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(head, out=sums[1:])
    word_text = owners(first)
    out[:, 0] = np.diff(first)
    out[:, 1] = np.bincount(word_text, weights=sums[ends] - sums[starts], minlength=n)
    out[:, 2] = per(_SYMBOL[data])
    out[:, 6] = per(_UPPER[data])
    out[:, 7] = per(_LETTER[data])

    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    at_end = np.append(begin[1:], len(data))
    closed = data[at_end - 1] == 10
    finish = at_end - closed
    has_word = np.searchsorted(starts, finish) > np.searchsorted(starts, begin)
    line_text = text[begin]
    lines, line_owner = mix(codes(data, begin, finish)[0].astype(np.uint64))[has_word], line_text[has_word]
    count = np.bincount(line_owner, minlength=n)
    kept, _ = distinct(line_owner, lines)
    out[:, 3] = count - np.bincount(kept, minlength=n)
    out[:, 5] = count
    last = finish[has_word] - 1
    out[:, 8] = np.bincount(line_owner[_END[data[last]]], minlength=n)

    if len(starts) > 2:
        word, vocabulary = codes(data, starts, ends)
        three = mix(tuples([word[:-2], word[1:-1], word[2:]], vocabulary).astype(np.uint64))
        whole = word_text[2:] == word_text[:-2]
        at = np.flatnonzero(whole)
        twice = at[repeated(word_text[at], three[at])]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 3, -1)
        out[:, 4] = np.bincount(word_text[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the features of the whole text of each document, all whole numbers."""
    schema = docs.select(F.col(doc_id), *(F.lit(0).cast("long").alias(f) for f in FEATURES)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.concatenate([measure(data, offsets) for _, _, data, offsets in slices(batch.column(1))])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))], [doc_id, *FEATURES])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def base_failed(c: Callable[[str], Column] = F.col) -> Column:
    """Too short, or most of its words in repeated three-word windows."""
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` holds, else abstains."""

    name: str
    good: Column
    bad: Column


def default_rules(c: Callable[[str], Column] = F.col) -> list[Rule]:
    """``c`` gives the column of a feature."""
    per_word = lambda x: c(x) / F.greatest(c("n_words"), F.lit(1))
    per_line = lambda x: c(x) / F.greatest(c("n_lines"), F.lit(1))
    mean = per_word("word_chars")
    letters = c("n_letters") / F.greatest(c("word_chars"), F.lit(1))
    upper = c("n_upper") / F.greatest(c("n_letters"), F.lit(1))
    return [
        Rule("length", c("n_words").between(60, 100_000), c("n_words") < 50),
        Rule("mean word", mean.between(3, 9), (mean < 2.2) | (mean > 14)),
        Rule("symbols", per_word("n_symbols") < 0.02, per_word("n_symbols") > 0.1),
        Rule("symbols a character", c("n_symbols") < 0.005 * c("word_chars"), c("n_symbols") > 0.05 * c("word_chars")),
        Rule("lines again", per_line("n_dup_lines") < 0.05, per_line("n_dup_lines") > 0.4),
        Rule("phrases again", per_word("n_repeat_words") < 0.1, per_word("n_repeat_words") > 0.45),
        Rule("capitals", upper < 0.15, upper > 0.4),
        Rule("letters", letters > 0.8, letters < 0.65),
        Rule("line ends", per_line("n_ended") > 0.5, per_line("n_ended") < 0.1),
    ]


@dataclass
class LabelModel:
    """EM's estimates: the share of good documents, and each rule's accuracies: the chances that, when it votes, it
    votes bad (first) or good (last) on a bad document (``chance[rule, 0]``) and on a good one (``chance[rule, 1]``).
    An abstention says nothing."""

    good: float
    chance: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes in (-1, 0, 1)."""
        rule = np.arange(pattern.shape[1])
        good, bad = self.chance[rule, 1, pattern + 1], self.chance[rule, 0, pattern + 1]
        says = np.where(pattern == 0, 0, np.log(np.where(pattern == 0, 1, good)) - np.log(np.where(pattern == 0, 1, bad))).sum(axis=1)
        z = np.log(self.good / (1 - self.good)) + says
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    @classmethod
    def fit(cls, pattern: np.ndarray, count: np.ndarray, rounds: int = 300, prior: float = 2.0) -> LabelModel:
        """``count`` documents have each row of ``pattern``. Begins from the votes' own sense: a document is
        the less likely good, the larger the share of bad votes among its votes. A rule's bad vote never comes to speak for good: where EM finds it more often on good
        documents than on bad ones, both chances are set to their mean, and the rule has no say by it."""
        rules = pattern.shape[1]
        cast = np.maximum((pattern != 0).sum(axis=1), 1)
        p = np.clip(1 - 2 * (pattern == -1).sum(axis=1) / cast, 0.02, 0.98)
        model = None
        for _ in range(rounds):
            chance = np.full((rules, 2, 3), prior / 3)
            for y, weight in ((0, (1 - p) * count), (1, p * count)):
                for v in range(3):
                    chance[:, y, v] += ((pattern + 1 == v) * weight[:, None]).sum(axis=0)
            chance[:, :, 1] = 0
            chance /= chance.sum(axis=2, keepdims=True)
            wrong = chance[:, 1, 0] > chance[:, 0, 0]
            chance[wrong, :, 0] = chance[wrong, :, 0].mean(axis=1, keepdims=True)
            good = float(np.clip((p * count).sum() / max(count.sum(), 1), 0.01, 0.99))
            model = cls(good, chance)
            q = model.posterior(pattern)
            done = np.abs(q - p).max(initial=0) < 1e-7
            p = q
            if done:
                break
        return model


def pattern_of(rules: list[Rule]) -> Column:
    """A number for the rules' votes together; a rule that finds both votes bad."""
    vote = lambda r: F.when(r.bad, -1).when(r.good, 1).otherwise(0)
    return sum(((vote(r) + 1) * 3**k for k, r in enumerate(rules)), F.lit(0)).cast("int")


def fit(patterns: DataFrame, rules: int) -> DataFrame:
    """(_pattern, posterior) of every pattern seen; at most 3 ** rules rows."""
    seen = patterns.groupBy("_pattern").count().collect()
    codes = np.array([x[0] for x in seen], np.int64)
    votes = (codes[:, None] // 3 ** np.arange(rules) % 3 - 1).reshape(len(codes), rules)
    model = LabelModel.fit(votes, np.array([x[1] for x in seen], float))
    posterior = [(int(c), float(p)) for c, p in zip(codes, model.posterior(votes))]
    return patterns.sparkSession.createDataFrame(posterior, "_pattern int, posterior double")


def judge(measured: DataFrame, rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``posterior`` and ``kept`` to a table of features."""
    rules = rules or default_rules()
    coded = measured.withColumn("_pattern", pattern_of(rules))
    by_pattern = fit(coded.select("_pattern"), len(rules))
    out = coded.join(F.broadcast(by_pattern), "_pattern", "left").drop("_pattern").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("posterior"), F.lit(0.0)) >= least))


def quality(docs: DataFrame, rules: list[Rule] | None = None, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Features and verdict of every document."""
    return judge(stage(features(docs, doc_id=doc_id, text=text), "quality"), rules, least)


def keep_good(docs: DataFrame, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that pass the base rule and that the vote finds good, with all their columns. The features are
    taken twice, once to fit and once to judge, so that no document is shuffled."""
    own = "_f" + "_" * max((len(c) for c in docs.columns), default=0)  # no column has this name
    schema = docs.withColumn(own, F.struct(*(F.lit(0).cast("long").alias(f) for f in FEATURES))).schema
    kind = pa.struct([(f, pa.int64()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column(batch.schema.get_field_index(text))
                rows = np.concatenate([measure(data, offsets) for _, _, data, offsets in slices(column)])
                packed = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(FEATURES))], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, packed], schema.names)

    rules = default_rules(lambda c: F.col(f"{own}.{c}"))
    coded = docs.mapInArrow(run, schema)
    by_pattern = fit(coded.select(pattern_of(rules).alias("_pattern")), len(rules)).select(F.col("_pattern").alias(f"{own}p"), F.col("posterior").alias(f"{own}q"))
    judged = coded.join(F.broadcast(by_pattern), pattern_of(rules) == F.col(f"{own}p"), "left")
    good = ~base_failed(lambda c: F.col(f"{own}.{c}")) & (F.coalesce(F.col(f"{own}q"), F.lit(0.0)) >= least)
    return judged.where(good).select(*(F.col(f"`{c}`") for c in docs.columns))
