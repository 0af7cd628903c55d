"""Quality rules whose thresholds are chosen with a bound on false rejections.

A rule rejects a document when one of its figures passes a cutoff from a fixed grid. In each stratum (language)
the labelled good documents are split by a hash of their ids. A part of them, with the bad documents, sets the
order in which cutoffs are tightened: each step is the one that costs fewest of these good documents and, of
such steps, rejects most further bad ones. The others are the holdout: along that path, from its mildest
setting on, the holdout documents that any rule of the setting rejects are counted, and the exact binomial tail
tells how likely so few would be if the setting rejected more than ``RISK`` of all good documents. The path is
followed until a setting fails (fixed-sequence testing, so a path needs no correction of its own), and
Bonferroni's correction over the strata keeps the chance of any wrong choice under ``ERROR``. What is bounded is
thus all that the learned rules of a stratum reject together. Strata with too few holdout documents to pass
even without a rejection are not tested and have no learned rules, and no rule holds for another stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.storage import discard, stash
from tessella.llm.textbytes import MULTIPLIER, Text, chunks, mix, range_hashes, window_hashes

RISK, ERROR = 0.03, 0.05
#: Of every so many labelled good documents one helps to set the order of cutoffs; the others are the holdout.
DESIGN = 4
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Figures, and the cutoffs above which they reject.
RULES = {
    "symbol_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "upper_share": (0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_share": (0.05, 0.1, 0.2, 0.3, 0.5),
    "word_length": (8.0, 10.0, 12.0, 16.0, 24.0),
}
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def range_sums(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each two neighbouring offsets."""
    size = np.diff(offsets)
    some = size > 0
    out = np.zeros(len(size), np.int64)
    if some.any():
        out[some] = np.add.reduceat(flag, offsets[:-1][some], dtype=np.int64)
    return out


def figures_of(text: Text) -> dict[str, np.ndarray]:
    """FIGURES of every document of a slice."""
    data, offsets, first = text.data, text.offsets, text.first
    symbol, upper = np.zeros(256, bool), np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    upper[65:91] = True
    edge = np.zeros(len(data) + 1, np.int8)
    edge[text.starts] = 1
    edge[text.ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = {
        "n_words": np.diff(first),
        "word_chars": range_sums(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": range_sums(symbol[data], offsets),
        "n_upper": range_sums(upper[data], offsets),
    }
    # lines with a word, and those equal to an earlier line of their document
    stop = np.flatnonzero(data == 10)
    start = np.r_[0, stop[:-1] + 1] if len(stop) else stop
    filled = np.searchsorted(text.starts, stop) > np.searchsorted(text.starts, start)
    start, stop = start[filled], stop[filled]
    doc = np.searchsorted(offsets, start, "right") - 1
    with np.errstate(over="ignore"):
        lines = mix(range_hashes(data, start, stop) + doc.astype(np.uint64))
    again = np.ones(len(lines), bool)
    again[np.unique(lines, return_index=True)[1]] = False
    out["n_lines"] = np.bincount(doc, minlength=text.n)
    out["n_dup_lines"] = np.bincount(doc[again], minlength=text.n)
    # words in 3-word windows that their document holds twice or more
    words, doc = text.word_hashes(), text.document()
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        same = doc[2:] == doc[:-2]
        with np.errstate(over="ignore"):
            threes = mix(window_hashes(words, 3) + doc[:-2].astype(np.uint64) * MULTIPLIER)[same]
        _, which, count = np.unique(threes, return_inverse=True, return_counts=True)
        at = np.flatnonzero(same)[count[which] > 1]
        for i in range(3):
            covered[at + i] = True
    out["n_repeat_words"] = range_sums(covered, first)
    return out


def shares(f: dict) -> dict:
    """The figures that rules look at, from counts (columns or arrays of numbers)."""
    some = lambda x: F.greatest(x, F.lit(1)) if isinstance(x, Column) else np.maximum(x, 1)
    return {
        "symbol_share": f["n_symbols"] / some(f["n_words"]),
        "upper_share": f["n_upper"] / some(f["word_chars"]),
        "dup_line_share": f["n_dup_lines"] / some(f["n_lines"]),
        "repeat_share": f["n_repeat_words"] / some(f["n_words"]),
        "word_length": f["word_chars"] / some(f["n_words"]),
    }


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum and FIGURES (long) of every row of docs. Null and empty texts have zero of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                f = figures_of(Text(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(f[k].astype(np.int64)) for k in FIGURES)], ["id", "stratum", *FIGURES])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, stratum string, " + ", ".join(f"{k} long" for k in FIGURES))


def binomial_tail(k: int, n: int, p: float) -> float:
    """The chance of k or fewer out of n at rate p: all terms that still matter are summed, from k down."""
    if k >= n or k > n * p + 40 * math.sqrt(n * p) + 40:
        return 1.0
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = 1.0
    for i in range(k, 0, -1):
        ratio = i / (n - i + 1) * (1 - p) / p
        term *= ratio
        total += term
        if ratio < 1 and term < 1e-17 * total * (1 - ratio):
            break
    return min(1.0, math.exp(top + math.log(total)))


def testable(holdouts: list[int], risk: float, error: float) -> tuple[int, float]:
    """(n, e): strata with n or more holdout documents are tested, each at error e. As many strata as can pass without
    a rejection share ``error``; n is 0 with e 0 where none can."""
    out = (0, 0.0)
    for m, n in enumerate(sorted(holdouts, reverse=True), 1):
        if binomial_tail(0, n, risk) > error / m:
            break
        out = (n, error / m)
    return out


def path(levels: np.ndarray, bad: np.ndarray, design: np.ndarray, limit: float) -> list[tuple[int, ...]]:
    """Settings (for each rule the index of its cutoff, the number of cutoffs where it is off), each tighter than the
    one before. levels: for each group of equal documents how many cutoffs of each rule its figures pass; bad,
    design: how many bad and how many good documents the group has. Settings that reject more than ``limit`` of
    the good ones are not taken."""
    sizes = [len(c) for c in RULES.values()]
    setting, out = tuple(sizes), []
    lost = lambda s: (levels > np.array(s)).any(1)
    while True:
        gone = lost(setting)
        best = None
        for r, size in enumerate(sizes):
            for c in range(setting[r] - 1, -1, -1):
                new = setting[:r] + (c,) + setting[r + 1 :]
                more = lost(new)
                cost, gain = int(design[more & ~gone].sum()), int(bad[more & ~gone].sum())
                if gain and design[more].sum() <= limit * design.sum():
                    best = min(best or (math.inf,), (cost, -gain, r, -c, new))
        if best is None:
            return out
        setting = best[4]
        out.append(setting)


def certified(settings: list[tuple[int, ...]], levels: np.ndarray, holdout: np.ndarray, risk: float, error: float) -> tuple[int, ...] | None:
    """The last setting before the first one whose false rejections of ``holdout`` documents are too many."""
    out, n = None, int(holdout.sum())
    for s in settings:
        if binomial_tail(int(holdout[(levels > np.array(s)).any(1)].sum()), n, risk) > error:
            break
        out = s
    return out


def base_failed(f: dict) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > REPEAT_PERCENT * f["n_words"])


def learn(rows: DataFrame, labels: DataFrame, label_col: str = "quality", risk: float = RISK, error: float = ERROR) -> dict:
    """{stratum: {rule: cutoff}} from figures and labels (doc_id, 0 or 1); strata without cutoffs are left out.

    All labelled documents that pass the base rules are counted, by stratum and by how many cutoffs their figures
    pass; a stratum is learned from such counts, whose number the grid bounds, and one row a stratum reaches the
    driver. Repeated labels of an id count once, as good if any is. Null labels are left out.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label_col).alias("good"))
    f = {k: F.col(k) for k in FIGURES}
    passed = [sum(((value > c).cast("int") for c in RULES[rule]), F.lit(0)).alias(rule) for rule, value in shares(f).items()]
    design = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(DESIGN)) == 0
    good = F.col("good") == 1
    known = rows.join(marks, "id").where(~base_failed(f)).select(F.col("stratum"), *passed, (~good).cast("long").alias("bad"), (good & design).cast("long").alias("design"), (good & ~design).cast("long").alias("holdout"))
    cells = stash(known.groupBy("stratum", *RULES).agg(F.sum("bad").alias("bad"), F.sum("design").alias("design"), F.sum("holdout").alias("holdout")), "cells")
    least, each = testable([r["n"] for r in cells.groupBy("stratum").agg(F.sum("holdout").alias("n")).collect()], risk, error)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        levels, (bad, design, holdout) = part[list(RULES)].to_numpy(), (part[c].to_numpy() for c in ("bad", "design", "holdout"))
        best = certified(path(levels, bad, design, risk), levels, holdout, risk, each) if each and holdout.sum() >= least else None
        cuts = {rule: [cs[i] if i < len(cs) else None] for (rule, cs), i in zip(RULES.items(), best or [math.inf] * len(RULES), strict=True)}
        return pd.DataFrame({"stratum": [part["stratum"].iloc[0]]} | cuts)

    found = cells.groupBy("stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"{r} double" for r in RULES)).collect()
    discard(cells)
    rules = {r["stratum"]: {k: r[k] for k in RULES if r[k] is not None} for r in found}
    return {s: cuts for s, cuts in rules.items() if cuts}


def judged(rules: dict, rows: DataFrame) -> DataFrame:
    """rows (stratum and FIGURES) with base_failed and kept: true where the base rules and the learned ones of
    the row's stratum keep it."""
    f = {k: F.col(k) for k in FIGURES}
    limits = rows.sparkSession.createDataFrame([(s, *(cuts.get(r) for r in RULES)) for s, cuts in rules.items()], "of string, " + ", ".join(f"`cut {r}` double" for r in RULES))
    bad = F.lit(False)
    for rule, value in shares(f).items():
        bad = bad | F.coalesce(value > F.col(f"cut {rule}"), F.lit(False))
    out = rows.join(F.broadcast(limits), F.col("stratum").eqNullSafe(F.col("of")), "left")  # one row a stratum
    return out.select(*rows.columns, base_failed(f).alias("base_failed"), (~base_failed(f) & ~bad).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, FIGURES, base_failed, kept of every row of docs; see the module for how the rules are learned.

    Texts are read once: figures go to a small table, which labels are joined to and verdicts come from.
    Null and empty texts fail the base rules; an empty table gives no rows; without labels only the base
    rules hold.
    """
    rows = stash(figures(docs, id_col, text_col, stratum_col), "figures")
    rules = learn(rows, labels)
    return judged(rules, rows).select("id", *FIGURES, "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, as they are. Figures are taken twice, to learn the rules and to
    apply them, so that no text is shuffled."""
    rows = stash(figures(docs, id_col, text_col, stratum_col), "figures")
    rules = learn(rows, labels)
    discard(rows)
    schema, text_at, stratum_at = docs.schema, docs.columns.index(text_col), docs.columns.index(stratum_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                f = figures_of(Text(part.column(text_at)))
                value = shares(f)
                good = (f["n_words"] >= MIN_WORDS) & (100 * f["n_repeat_words"] <= REPEAT_PERCENT * f["n_words"])
                own = [rules.get(x, {}) for x in part.column(stratum_at).cast(pa.string()).to_pylist()]
                for rule in RULES:
                    good &= ~(value[rule] > np.array([cuts.get(rule, np.inf) for cuts in own], float))
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, schema)
