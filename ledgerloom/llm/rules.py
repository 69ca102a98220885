"""Quality rules: learned decision lists, native on the main path.

Statistics of every text are Spark expressions over its word array. Sequential covering grows
conjunctions of thresholds that single out label 0, prunes each on rows held back, and stops when
a rule is no longer precise. The list becomes one ordered ``when`` expression; no Python runs on the
executors.

Learning uses the statistics of at most ``MAX_ROWS`` labelled documents, those of the smallest hash
of the id; judging covers every row.

Defined results: a null text has no words and fails the base rule, as has an empty one; ids labelled
more than once are learned by their mean label if it is decided; without both labels there is no
rule, and every text that passes the base rule is kept; repeated rows and extra columns have no
effect; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

MAX_ROWS = 20_000
MIN_WORDS = 50
MAX_CONDITIONS = 3
MAX_RULES = 12
MIN_PRECISION = 0.9
#: Statistics that conditions may test.
#: Shares that do not depend on a text's length or language.
FEATURES = ("symbol_share", "upper_share", "neighbour_share", "repeat_share", "dup_line_share", "digit_share", "punct_share")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the base counts and ``FEATURES`` of every text, in linear-log time and one pass.

    ``n_repeat_words`` sorts the hashes of the 3-word windows of a text (only if any repeats) and
    measures the union of the repeated windows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("text"), *keep).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    sized = read.withColumn("n", F.size("words"))
    hashed = sized.withColumn(
        "windows",
        F.when(
            F.col("n") >= 3,
            F.transform(
                F.sequence(F.lit(1), F.col("n") - 2),
                lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    placed = hashed.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    repeated = placed.withColumn(
        "repeated",
        F.sort_array(
            F.filter(
                F.transform(
                    "placed",
                    lambda x, k: F.when((F.get("placed", k - 1)["h"] == x["h"]) | (F.get("placed", k + 1)["h"] == x["h"]), x["i"]),
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )
    covered = F.aggregate(
        F.transform("repeated", lambda i, k: F.coalesce(F.least(F.lit(3), F.get("repeated", k + 1) - i), F.lit(3))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    def only(kind: str, negate: bool = False) -> Column:
        """Number of code points of the text in (or not in) a character class."""
        return F.length(F.regexp_replace("text", f"[{'' if negate else '^'}{kind}]+", "")).cast("bigint")

    lines = repeated.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    counted = lines.select(
        "id",
        *keep,
        F.col("n").cast("bigint").alias("n_words"),
        only(r"\x20\x09-\x0D", negate=True).alias("word_chars"),
        only("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter(F.transform("words", lambda w, i: w == F.get("words", i + 1)), lambda same: same)).alias("n_neighbours"),
        only(r"\p{Lu}").alias("n_upper"),
        only("0-9").alias("n_digits"),
        only(".,;:!?").alias("n_punct"),
    )

    # A generator that predicates are not pushed through: below it they would be inlined over and over.
    counted = counted.select(F.inline(F.array(F.struct(*[F.col(c) for c in counted.columns]))))

    def share(a: str, b: Column) -> Column:
        return F.col(a).cast("double") / F.greatest(b.cast("double"), F.lit(1.0))

    chars, words = F.col("word_chars"), F.col("n_words")
    return counted.select(
        "id",
        *keep,
        *BASE,
        share("n_symbols", chars).alias("symbol_share"),
        share("n_upper", chars).alias("upper_share"),
        share("n_digits", chars).alias("digit_share"),
        share("n_punct", chars).alias("punct_share"),
        share("n_neighbours", words).alias("neighbour_share"),
        share("n_repeat_words", words).alias("repeat_share"),
        share("n_dup_lines", F.col("n_lines")).alias("dup_line_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] > self.threshold if self.above else data[self.feature] <= self.threshold

    def column(self) -> Column:
        c, t = F.col(self.feature), F.lit(float(self.threshold))
        return c > t if self.above else c <= t

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _grow(data: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """Add the condition of largest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, chosen = 1e-9, None
        for f in FEATURES:
            values = data[f][inside]
            order = np.argsort(values, kind="stable")
            v, b = values[order], bad[inside][order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            below_p = np.cumsum(b)[cuts]
            below_n = cuts + 1 - below_p
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                gain = p * (np.log2((p + 1e-9) / (p + n)) - np.log2(p0 / (p0 + n0)))
                k = int(gain.argmax())
                if gain[k] > best:
                    best, chosen = gain[k], Condition(f, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= chosen.holds(data)
    return rule


def _covers(rule: list[Condition], data: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(data)
    return out


def learn_rules(data: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """Sequential covering of the rows marked ``bad``: every third row is held back for pruning."""
    rules: list[list[Condition]] = []
    n = len(bad)
    left = np.ones(n, bool)
    back = np.arange(n) % 3 == 2
    while len(rules) < MAX_RULES and (left & bad & ~back).any() and (left & ~bad).any():
        grow, prune = left & ~back, left & back
        rule = _grow({f: data[f][grow] for f in FEATURES}, bad[grow])
        held = {f: data[f][prune] for f in FEATURES}

        def worth(r: list[Condition]) -> float:
            hit = _covers(r, held, int(prune.sum()))
            p = (hit & bad[prune]).sum()
            return (p - (hit.sum() - p)) / max(1, hit.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, data, n) & left
        if not rule or not (hit & bad).any() or (hit & bad).sum() < MIN_PRECISION * hit.sum() or worth(rule) < 2 * MIN_PRECISION - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit_rules(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS
) -> list[list[Condition]]:
    """Learn the list from ``labels`` of ``docs``."""
    mean = labels.groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("mean")).filter("id IS NOT NULL AND mean IS NOT NULL AND mean <> 0.5")
    sample = mean.select("id", (F.col("mean") < 0.5).alias("bad")).orderBy(F.xxhash64(F.lit("rules"), "id"), "id").limit(max_rows)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = text_statistics(labelled, "id", "text", keep=("bad",)).select("bad", *FEATURES).orderBy(F.xxhash64(*FEATURES)).limit(max_rows).collect()
    table = np.array([[float(v) for v in r] for r in rows], np.float64).reshape(-1, len(FEATURES) + 1)
    return learn_rules({f: table[:, k + 1] for k, f in enumerate(FEATURES)}, table[:, 0] > 0)


def verdict(rules: list[list[Condition]]) -> Column:
    """The ordered list as one expression: number of the first rule that rejects, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules):
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        out = out.when(every, F.lit(k + 1))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the base counts, base_failed, rule (the first that rejects) and kept for every row."""
    out = text_statistics(docs, id_col, text_col, keep).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.select(F.col("id").alias(id_col), *keep, *BASE, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
