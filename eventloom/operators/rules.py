"""Counting-rule conformance.

A rule says: the events of its left labels must at no time be outnumbered by the
events of its right labels, ``sum(left) [+ token] >= sum(right)``. A rule is looked at
whenever an event of a label it is attached to arrives. Plain rules are tried in list
order and the first violated one ends the scan; rules with a token are only tried when
no plain rule failed. Of each (case, rule) the first violation is reported, with the
0-based position of its event.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.sequence import EVENT_ORDER, Hot, split_hot, with_parts


@dataclass(frozen=True)
class Rule:
    rule_id: int
    left: Sequence[str]
    right: Sequence[str]
    #: label -> place in that label's list of rules
    attached: Mapping[str, int] = field(default_factory=dict)
    token: int | None = None

    @property
    def kind(self) -> int:
        return 0 if self.token is None else 1

    def deltas(self) -> dict[str, int]:
        """What one event of a label adds to ``left - right``; repeated labels count repeatedly."""
        d = Counter(self.left)
        d.subtract(Counter(self.right))
        return {label: n for label, n in d.items()}


def _numbers(text: str) -> list[int]:
    return [int(t) for t in text.split(",") if t]


def rules_from_text(rules: str, token_rules: str, labels: str, rules_of_label: str,
                    token_rules_of_label: str) -> list[Rule]:
    """Rules from their text form.

    ``n>>l1,l2=r1,r2;...`` for plain rules, ``n>>token=l1=r1;...`` for rules with a token,
    ``A=0;B=1;...`` numbers the labels, ``0=1,2;...`` lists the rules tried for a label.
    """
    entries = lambda text: [e for e in text.split(";") if e]
    name = {int(n): label for label, n in (e.split("=") for e in entries(labels))}
    out = []
    for text, lists, has_token in ((rules, rules_of_label, False), (token_rules, token_rules_of_label, True)):
        places: dict[int, dict[str, int]] = {}
        for e in entries(lists):
            label, ids = e.split("=")
            for place, rule in enumerate(_numbers(ids)):
                places.setdefault(rule, {}).setdefault(name[int(label)], place)
        for e in entries(text):
            number, body = e.split(">>")
            token, left, right = body.split("=") if has_token else (None, *body.split("="))
            out.append(Rule(int(number), [name[i] for i in _numbers(left)], [name[i] for i in _numbers(right)],
                            places.get(int(number), {}), int(token) if has_token else None))
    return out


def _effect(rule: Rule) -> Column:
    """What an event adds to the rule's balance."""
    by_label = [F.when(F.col("label") == label, F.lit(d).cast("bigint")) for label, d in sorted(rule.deltas().items()) if d]
    return F.coalesce(*by_label, F.lit(0).cast("bigint"))


def _sums(rules: Sequence[Rule], keys: Sequence[str]) -> list[Column]:
    """Position and balances, each as a running sum in one window."""
    w = Window.partitionBy(*keys).orderBy(*EVENT_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return [F.count(F.lit(1)).over(w).alias("n"), *[F.sum(_effect(r)).over(w).alias(f"b{i}") for i, r in enumerate(rules)]]


def totals(log: DataFrame, rules: Sequence[Rule], *keys: str) -> DataFrame:
    """``events`` and ``totals`` (one balance per rule) of each group of ``keys``; combined on the map side."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.array(*[F.sum(_effect(r)) for r in rules]).cast("array<bigint>").alias("totals"))


def rule_states(log: DataFrame, rules: Iterable[Rule], hot: Hot = None) -> DataFrame:
    """``case, label, idx, balances``: for each event its 0-based place in the case, and ``left - right`` of every rule after it.

    One shuffle by case: the window that numbers the events sums all rules. Large cases are summed in parts, and the
    totals of earlier parts, one row each, are added.
    """
    rules = list(rules)
    cold, warm = split_hot(log, hot)
    balances = [F.col(f"b{i}") for i in range(len(rules))]
    out = (cold.select("case", "label", *_sums(rules, ["case"]))
           .select("case", "label", (F.col("n") - 1).alias("idx"), F.array(*balances).cast("array<bigint>").alias("balances")))
    if warm is None:
        return out
    parts = with_parts(warm, ["case", *EVENT_ORDER]).repartition("case", "slice")
    earlier = Window.partitionBy("case").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals(parts, rules, "case", "slice").select(
        "case", "slice", F.coalesce(F.sum("events").over(earlier), F.lit(0)).alias("n0"),
        *[F.coalesce(F.sum(F.col("totals")[i]).over(earlier), F.lit(0)).alias(f"c{i}") for i in range(len(rules))])
    summed = parts.select("case", "slice", "label", *_sums(rules, ["case", "slice"])).join(before, ["case", "slice"])
    return out.unionByName(summed.select(
        "case", "label", (F.col("n") + F.col("n0") - 1).alias("idx"),
        F.array(*[F.col(f"b{i}") + F.col(f"c{i}") for i in range(len(rules))]).cast("array<bigint>").alias("balances")))


def reported(states: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``case, idx, rule_id``: at each event the one violation that is reported, decided within the row."""
    tried = []
    for i, r in enumerate(rules):
        for label, place in r.attached.items():
            bad = (F.col("label") == label) & (F.col("balances")[i] + (r.token or 0) < 0)
            tried.append(F.when(bad, F.struct(F.lit(r.kind).alias("kind"), F.lit(place).alias("place"), F.lit(r.rule_id).alias("rule_id"))))
    if not tried:
        return states.select("case", "idx", F.lit(0).alias("rule_id")).limit(0)
    first = F.array_min(F.filter(F.array(*tried), lambda t: t.isNotNull()))
    return states.select("case", "idx", first.alias("r")).where(F.col("r").isNotNull()).select("case", "idx", F.col("r.rule_id").alias("rule_id"))


def check_rules(log: DataFrame, rules: Iterable[Rule], hot: Hot = None) -> DataFrame:
    """``case_id, idx, rule_id``: the first violation of each rule in each case."""
    rules = list(rules)
    return (reported(rule_states(log, rules, hot), rules).groupBy("case", "rule_id").agg(F.min("idx").alias("idx"))
            .select(F.col("case.id").alias("case_id"), "idx", "rule_id"))


def occurrence_matrix(log: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``case_id``, one count per label, ``lastindex`` (0-based place of the last event).

    The labels are given, so the columns are fixed without looking at the data; the counts
    combine map-side.
    """
    return (log.groupBy(F.col("case.id").alias("case_id"))
            .agg(*[F.count_if(F.col("label") == l).alias(l) for l in labels],
                 (F.count(F.lit(1)) - 1).alias("lastindex")))
