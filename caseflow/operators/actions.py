"""Insight sentences and signals -> ranked actions with their evidence.

As in ``insights``, everything happens inside the row: keyword rules are array
expressions over its sentences, so no join and no shuffle is needed, and any
number of segments is handled side by side.

The rules are data: ``Rules`` holds them, and ``rules_of`` reads them from a frame, say
a table that a team maintains. ``rule_frame`` gives the default ones to start from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from caseflow import fixed_values as fixed
from caseflow.functions.texts import quoted

_NO_NAMES = "CAST(array() AS array<string>)"
_SHOWN = (
    "source", "trigger", "evidence_strength", "insight_index", "signal_key", "signal_value",
)


#: A rule table is small by nature; a larger frame is a mistake of the caller.
MOST_RULES = 1000


@dataclass(frozen=True)
class Rules:
    """Keyword rules (category, words that a sentence must all hold, strength) and what categories stand for."""

    keywords: Sequence[tuple[str, Sequence[str], int]] = tuple(fixed.KEYWORDS)
    actions: Mapping[str, tuple[str, int, str]] = field(default_factory=lambda: dict(fixed.ACTIONS))
    signals: Mapping[str, str] = field(default_factory=lambda: dict(fixed.SIGNALS))

    def __post_init__(self):
        used = {category for category, _, _ in self.keywords} | set(self.signals.values())
        if unknown := sorted(used - set(self.actions)):
            raise ValueError(f"no action for the category {', '.join(unknown)}")
        if empty := [category for category, words, _ in self.keywords if not words]:
            raise ValueError(f"a rule for {empty[0]} has no words")


_RULE_SCHEMA = (
    "category string, id string, priority int, recommendation string, signal string, words array<string>, strength int"
)


def rule_frame(spark: SparkSession, rules: Rules | None = None) -> DataFrame:
    """The rules as a frame: a row per keyword rule (with words) or signal (with its name) of a category's action."""
    rules = rules or Rules()
    rows = [(c, *rules.actions[c], None, list(words), strength) for c, words, strength in rules.keywords]
    rows += [(c, *rules.actions[c], signal, None, None) for signal, c in rules.signals.items()]
    return spark.createDataFrame(rows, _RULE_SCHEMA)


def rules_of(frame: DataFrame) -> Rules:
    """The rules in a frame like ``rule_frame``; at most MOST_RULES rows, one action per category."""
    rows = frame.select("category", "id", "priority", "recommendation", "signal", "words", "strength").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    actions: dict[str, tuple[str, int, str]] = {}
    for row in rows:
        entry = (row["id"], row["priority"], row["recommendation"])
        if actions.setdefault(row["category"], entry) != entry:
            raise ValueError(f"the category {row['category']} has more than one action")
    return Rules(
        keywords=[(r["category"], [w.lower() for w in r["words"]], r["strength"]) for r in rows if r["words"] is not None],
        actions=actions,
        signals={r["signal"]: r["category"] for r in rows if r["signal"] is not None},
    )


def keyword_strength(text: str, category: str, rules: Rules | None = None) -> str:
    """SQL for the strength with which a sentence supports a category, NULL if not."""
    hits = [
        "CASE WHEN "
        + " AND ".join(f"contains(lower({text}), {quoted(word)})" for word in words)
        + f" THEN {strength} END"
        for rule_category, words, strength in (rules or Rules()).keywords
        if rule_category == category
    ]
    return f"greatest({', '.join(hits)})" if len(hits) > 1 else hits[0] if hits else "CAST(NULL AS int)"


def _evidence(
    source: str,
    trigger: str,
    strength: str,
    seen: str,
    insight_index: str = "NULL",
    signal_key: str = "NULL",
    signal_value: str = "NULL",
) -> str:
    """Fields in order of comparison: strength downwards, trigger, first seen."""
    return f"""named_struct(
      'neg', -({strength}), 'trigger', {trigger}, 'seen', int({seen}), 'source', '{source}',
      'evidence_strength', {strength}, 'insight_index', int({insight_index}),
      'signal_key', string({signal_key}), 'signal_value', CAST({signal_value} AS array<string>))"""


def _category_evidence(category: str, signals: set[str], rules: Rules) -> str:
    strength = keyword_strength("text", category, rules)
    found = f"""transform(_sentences, (text, i) ->
      CASE WHEN {strength} IS NOT NULL
           THEN {_evidence("insight", "text", strength, "i", insight_index="i")} END)"""
    for key, supported in rules.signals.items():
        if supported == category and key in signals:
            given = _evidence(
                "signal", f"'{key}'", str(fixed.SIGNAL_STRENGTH), "size(_sentences)",
                signal_key=f"'{key}'", signal_value=f"signals.{key}",
            )
            found = f"concat({found}, array(CASE WHEN size(signals.{key}) > 0 THEN {given} END))"
    return f"array_sort(array_compact({found}))"


def _action(category: str, entry: tuple[str, int, str], evidence: str) -> str:
    identifier, priority, text = entry
    return f"""named_struct('priority', {priority}, 'id', {quoted(identifier)}, 'category', {quoted(category)},
      'recommendation', {quoted(text)}, 'evidence', {evidence})"""


def recommend(insights: DataFrame, keys: list[str], rules: Rules | None = None) -> DataFrame:
    """One row per action and input row, with evidence strongest first.

    ``insights`` holds sentences, or structs with a ``text``, in ``insights``
    and optionally name lists in ``signals``. Input rows without any match get
    the fallback actions.
    """
    rules = rules or Rules()
    held = {c: f"_evidence{i}" for i, c in enumerate(rules.actions)}
    element = insights.schema["insights"].dataType.elementType
    texts = "insights.text" if isinstance(element, T.StructType) else "insights"
    signals: set[str] = set()
    if "signals" in insights.columns:
        signals = set(insights.schema["signals"].dataType.fieldNames())
    carried = [*keys, "signals"] if signals else keys

    matched = ", ".join(
        f"CASE WHEN size({held[c]}) > 0 THEN {_action(c, entry, held[c])} END"
        for c, entry in rules.actions.items()
    )
    unmatched = _evidence(
        "fallback", quoted(fixed.FALLBACK_TRIGGER), str(fixed.FALLBACK_STRENGTH), "0"
    )
    fallback = ", ".join(
        _action(c, entry, f"array({unmatched})") for c, entry in fixed.FALLBACK_ACTIONS.items()
    )
    shown = "named_struct(" + ", ".join(f"'{n}', e.{n}" for n in _SHOWN) + ")"
    return (
        insights.selectExpr(*carried, f"coalesce({texts}, {_NO_NAMES}) AS _sentences")
        .selectExpr(
            *keys,
            *[f"{_category_evidence(c, signals, rules)} AS {held[c]}" for c in rules.actions],
        )
        .selectExpr(*keys, f"array_compact(array({matched})) AS _matched")
        .selectExpr(
            *keys,
            f"inline(array_sort(CASE WHEN size(_matched) > 0 THEN _matched ELSE array({fallback}) END))",
        )
        .selectExpr(
            *keys,
            "id",
            "category",
            "priority",
            "recommendation",
            f"transform(evidence, e -> {shown}) AS evidence",
        )
        .selectExpr("*", "evidence[0] AS strongest_evidence")
    )


def evidence_rows(actions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per piece of evidence, strongest first within its action."""
    return actions.selectExpr(
        *keys, "id", "category", "posexplode(evidence) AS (evidence_rank, _evidence)"
    ).select(*keys, "id", "category", "evidence_rank", "_evidence.*")


def evidence_json(actions: DataFrame) -> DataFrame:
    """Evidence as JSON text; fields that do not apply are left out."""
    texts = {"evidence": "to_json(evidence)", "strongest_evidence": "to_json(strongest_evidence)"}
    return actions.selectExpr(
        *[f"{texts[c]} AS {c}" if c in texts else f"`{c}`" for c in actions.columns]
    )
