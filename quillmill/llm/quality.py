"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Nobody says how right a rule is:
expectation-maximisation over all documents' votes estimates each rule's accuracy and the share of good documents, and
a document is kept if its posterior probability of being good is at least a half, rather than if all rules pass. Votes
are counted by their pattern first, so estimation works on at most 3 ** rules rows, whatever the number of documents;
those are also the only rows that reach the driver or are broadcast.

Without labels a rule can only be believed as far as other rules' votes depend on its own: where its bad votes go with
another rule's, or keep clear of them more than chance would, it gets a kind of bad documents of its own; a rule whose bad
votes are spread over documents regardless of all others is noise, its rate of false alarms is estimated and its votes
count for nothing. A fault that one rule alone sees, quite independent of the others, can't be told from such noise and
is not rejected.

Defined results: a null text has no words; documents without words abstain from every rule but length; repeated rows
are judged each; an empty table gives an empty result; other columns are unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import doc_texts, written
from quillmill.llm.tokens import batch_rows, in_groups

SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_shouts"]


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more in the same text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    # number the distinct windows, one word more at a time: numbers stay below the text's length
    window = ids[:n]
    for k in range(1, width):
        window = np.unique(window * len(numbers) + ids[k : n + k], return_inverse=True)[1]
    twice = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def count_text(text: str) -> tuple[int, ...]:
    """The counts named in _COUNTS."""
    raw = text.encode()
    words = raw.split()
    seen, repeats, lines, ended = set(), 0, 0, 0
    for line in text.split("\n"):
        bare = line.strip(_BLANK)
        if bare:
            lines += 1
            ended += bare[-1] in ".!?:;\"'"
            repeats += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, _BLANK))
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeats, repeated_words(words), lines, ended, len(raw) - len(raw.translate(None, _UPPER)), text.count("!")


def count_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the counts."""

    def run(batches):
        for group in in_groups((r for b in batches for r in batch_rows(b)), 1):
            rows = [(doc_id, *count_text(text)) for doc_id, text in group]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", *_COUNTS])

    return doc_texts(docs).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *_COUNTS]))


def _per(count: str, whole: str) -> Column:
    return F.col(count) / F.greatest(F.col(whole), F.lit(1))


def default_rules() -> dict[str, tuple[Column, Column]]:
    """(votes bad, votes good) of each rule; bad wins where both hold, neither is an abstention. Length, symbols per word,
    duplicate lines and mean word length have the bounds published for filters of web text; the others are round numbers
    chosen without labels."""
    return {
        "length": (F.col("n_words") < 50, F.col("n_words") >= 100),
        "symbols": (_per("n_symbols", "n_words") > 0.1, _per("n_symbols", "n_words") < 0.02),
        "repeated_lines": (_per("n_dup_lines", "n_lines") > 0.3, _per("n_dup_lines", "n_lines") < 0.05),
        "repeated_windows": (_per("n_repeat_words", "n_words") > 0.3, _per("n_repeat_words", "n_words") < 0.1),
        "word_length": (~_per("word_chars", "n_words").between(3, 10), _per("word_chars", "n_words").between(3.5, 9)),
        "capitals": (_per("n_upper", "word_chars") > 0.3, _per("n_upper", "word_chars") < 0.1),
        "shouts": (_per("n_shouts", "n_words") > 0.2, _per("n_shouts", "n_words") < 0.02),
        "ended_lines": (_per("n_ended_lines", "n_lines") < 0.1, _per("n_ended_lines", "n_lines") > 0.6),
    }


def vote(counts: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """counts with one column of votes for each rule."""
    has_words = F.col("n_words") > 0
    return counts.select("*", *[F.when(bad & (has_words | F.lit(k == "length")), -1).when(good & has_words, 1).otherwise(0).alias(f"vote_{k}") for k, (bad, good) in rules.items()])


def depends(patterns: np.ndarray, counts: np.ndarray, least_z: float = 4.0, lift: float = 1.5) -> np.ndarray:
    """Which rules' bad votes depend on some other rule's: where both vote, bad votes of both meet `lift` times as often
    as chance has it, or that much more seldom, and by `least_z` standard errors."""
    bad, voted = patterns < 0, patterns != 0
    out = np.zeros(patterns.shape[1], bool)
    for r in range(len(out)):
        for j in range(len(out)):
            both = voted[:, r] & voted[:, j]
            n = counts[both].sum()
            if r == j or not n:
                continue
            a, b, ab = (counts[both & x].sum() for x in (bad[:, r], bad[:, j], bad[:, r] & bad[:, j]))
            expected = a * b / n
            error = math.sqrt(expected * (1 - a / n) * (1 - b / n))
            ratio = (ab + 0.5) / (expected + 0.5)
            out[r] |= error > 0 and abs(ab - expected) >= least_z * error and not 1 / lift < ratio < lift
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the kinds of documents and, for each kind and rule, how often its vote is bad where it votes; from
    distinct vote patterns (rows of -1, 0, 1) and how often each occurs.

    Kind 0 is good; bad documents come in kinds, one for each rule that depends on others (see `depends`), as rules that
    look for different faults don't agree on a bad document. Rates are free; where they start, and a prior worth a few
    votes, say which kind is which: good documents seldom get a bad vote, a rule mostly finds its own kind. A kind whose
    own rule votes good on half of it, or that is no rarer than good documents, is no kind of bad ones and is dropped."""
    rules = patterns.shape[1]
    yes, no = (patterns > 0).astype(float), (patterns < 0).astype(float)
    kinds = np.flatnonzero(depends(patterns, counts))
    while True:
        own = np.arange(len(kinds)) + 1, kinds
        bad, weight = np.full((len(kinds) + 1, rules), 0.1), np.full((len(kinds) + 1, rules), 2.0)
        bad[0], weight[0] = 0.02, 20.0
        bad[own], weight[own] = 0.9, 10.0
        prior = bad * weight
        shares = np.array([0.8, *[0.2 / max(1, len(kinds))] * len(kinds)])
        shares /= shares.sum()
        for _ in range(rounds):
            held = counts[:, None] * kind_odds(patterns, shares, bad)
            new_bad = np.clip((held.T @ no + prior) / (held.T @ (yes + no) + weight), 0.001, 0.999)
            new_shares = (held.sum(axis=0) + 0.01) / (counts.sum() + 0.01 * len(shares))
            moved = max(np.abs(new_bad - bad).max(initial=0), np.abs(new_shares - shares).max(initial=0))
            shares, bad = new_shares, new_bad
            if moved < 1e-9:
                break
        stay = (bad[own] > 0.5) & (shares[1:] < shares[0])
        if stay.all():
            return shares, bad
        kinds = kinds[stay]


def kind_odds(patterns: np.ndarray, shares: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Posterior probability of each kind (columns) for each pattern (rows)."""
    log = np.log(shares) + (patterns < 0) @ np.log(bad).T + (patterns > 0) @ np.log(1 - bad).T
    odds = np.exp(log - log.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def judge(docs: DataFrame, rules: dict[str, tuple[Column, Column]] | None = None, keep_from: float = 0.5) -> DataFrame:
    """doc_id, counts, votes, p_good and kept (p_good >= keep_from) of each document."""
    rules = rules or default_rules()
    votes = [f"vote_{k}" for k in rules]
    voted = written(vote(count_documents(docs), rules), "votes")
    found = voted.groupBy(*votes).count().collect()  # at most 3 ** rules rows
    patterns = np.array([[r[v] for v in votes] for r in found], int).reshape(-1, len(votes))
    model = estimate(patterns, np.array([r["count"] for r in found], float))
    good = kind_odds(patterns, *model)[:, 0]
    table = docs.sparkSession.createDataFrame([(*map(int, p), float(g)) for p, g in zip(patterns, good, strict=True)], ", ".join([*(f"{v} int" for v in votes), "p_good double"]))
    return voted.join(F.broadcast(table), votes).withColumn("kept", F.col("p_good") >= keep_from)
