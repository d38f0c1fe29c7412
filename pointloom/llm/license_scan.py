"""License scan with ordered signature rules, as SQL expressions only.

A rule of ``license_rules`` is a regular expression with a keyword, a label and a
priority.  Plain searches for a few roots let a document through at all, then a
rule's expression runs only on texts that hold its keyword as a word.  Detections
are intervals of characters; one that lies inside another of a longer span, or of
the same span and a higher priority, is dropped, and the labels that are left are
reported.  Places come from running sums, suppression from a sort and a running
maximum, both over strides of ``STRIDE`` items, so that thousands of hits in one
text cost little more than as many in many.

Base phrases (``BASE_PHRASES``) are counted wherever their words stand one
after another; their labels always stay.

Defined cases: null is the empty text, with no words, no labels and score 0;
repeated rows are scanned one by one; ties between rules with the same span and
priority go to the earlier rule; an empty table gives an empty result; columns
of ``docs`` other than id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.frames import id_and_text
from pointloom.llm.license_rules import Rule, default_rules

#: Fixed values of the contract: words of a phrase and its label.
BASE_PHRASES = ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved"))
#: A word: ASCII letters and digits, and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Places of a text that sums and maxima run over at a time.
STRIDE = 128


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` where ``name`` stands for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _strides(array: str, fold: str) -> str:
    """SQL of ``fold`` over all strides before each stride."""
    return _let("b", f"transform(sequence(0, (size({array}) - 1) div {STRIDE}), c -> {fold.format(f'slice({array}, c * {STRIDE} + 1, {STRIDE})')})", f"transform(b, (_, c) -> {fold.format('slice(b, 1, c)')})")


_SUM, _MAX = "aggregate({}, 0, (s, y) -> s + y)", "coalesce(array_max({}), -1)"


def _hits(rules: tuple[Rule, ...]) -> str:
    """SQL for the rules that match ``low``: widths of their matches and of the pieces between them.

    Roots and keywords gate the expressions, each of which is a constant of the plan and is compiled once.
    """
    of_rule = lambda number, r: _let(
        "h",
        f"regexp_extract_all(t, {_literal(r.expression)}, 0)",
        f"IF(size(h) = 0, NULL, named_struct('widths', transform(h, x -> length(x)), 'gaps', transform(split(t, {_literal(r.expression)}, -1), x -> length(x)), 'priority', {r.priority}, 'number', {number}, 'label', {_literal(r.label)}))",
    )
    by_root: dict[str, dict[str, list[str]]] = {}
    gates = {}
    for number, rule in enumerate(rules):
        by_root.setdefault(rule.root, {}).setdefault(rule.gate, []).append(of_rule(number, rule))
        gates[rule.gate] = " AND ".join(f"contains(t, {_literal(w)})" for w in rule.keyword.split()) + f" AND rlike(t, {_literal(rule.gate)})"
    roots = [f"IF(contains(t, {_literal(root)}), flatten(array_compact(array({', '.join(f'IF({gates[gate]}, array({chr(44).join(own)}), NULL)' for gate, own in groups.items())}))), NULL)" for root, groups in by_root.items()]
    return _let("t", "low", f"array_compact(flatten(array_compact(array({', '.join(roots)}))))")


def _places(hit: str) -> str:
    """SQL for the detections of one rule: begin and end from running sums of the widths, and what orders them."""
    steps = f"transform({hit}.widths, (w, i) -> {hit}.gaps[i] + IF(i > 0, {hit}.widths[i - 1], 0))"
    begin = f"f[i div {STRIDE}] + {_SUM.format(f'slice(s, (i div {STRIDE}) * {STRIDE} + 1, i % {STRIDE} + 1)')}"
    spans = f"transform({hit}.widths, (w, i) -> {_let('p', begin, f'named_struct({chr(39)}begin{chr(39)}, p, {chr(39)}back{chr(39)}, -(p + w), {chr(39)}rank{chr(39)}, -{hit}.priority, {chr(39)}number{chr(39)}, {hit}.number, {chr(39)}label{chr(39)}, {hit}.label)')})"
    return _let("s", steps, _let("f", _strides("s", _SUM), spans))


def _suppressed(detections: str) -> str:
    """SQL for the detections, in order, that no earlier one reaches past.

    The order is by begin, then the longer, the higher priority and the earlier rule first, so that a detection lies
    inside another one exactly where some earlier one ends no earlier.
    """
    reach = f"greatest(m[i div {STRIDE}], {_MAX.format(f'slice(e, (i div {STRIDE}) * {STRIDE} + 1, i % {STRIDE})')})"
    return _let("d", f"array_sort({detections})", _let("e", "transform(d, x -> -x.back)", _let("m", _strides("e", _MAX), f"filter(d, (x, i) -> {reach} < -x.back)")))


def _phrase(words: tuple[str, ...]) -> str:
    return rf"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F]){GAP.join(words)}(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"


#: SQL of the number of words: the pieces between gaps, without an empty first or last one.
_N_WORDS = _let("p", f"split(low, {_literal(GAP)}, -1)", "IF(low = '', 0, size(p) - IF(p[0] = '', 1, 0) - IF(p[size(p) - 1] = '', 1, 0))")


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the detections that are left.

    One pass over the texts without a shuffle: the arrays of rules and keywords are constants of the plan.
    """
    rules = default_rules() if rules is None else rules
    docs = id_and_text(docs)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), upper, lower).alias("low"))
    some = reduce(lambda a, b: a | b, [F.contains("low", F.lit(root)) for root in dict.fromkeys(r.root for r in rules)], F.lit(False))
    has_base = F.lit(False)
    for words, _ in BASE_PHRASES:
        has_base = has_base | (F.contains("low", F.lit(words[-1])) & F.col("low").rlike(_phrase(words)))
    words = F.when(has_base, F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))
    found = low.select(
        "doc_id",
        F.expr(_N_WORDS).cast("long").alias("n_words"),
        words.alias("words"),
        (F.when(some, F.expr(_hits(rules))) if rules else F.lit(None)).alias("found"),
    )

    def places(phrase: tuple[str, ...]) -> Column:
        same = " AND ".join(f"words[i + {j}] = '{w}'" for j, w in enumerate(phrase))
        return F.expr(f"CASE WHEN size(words) >= {len(phrase)} THEN filter(sequence(0, size(words) - {len(phrase)}), i -> {same}) ELSE array() END")

    located = found.select("doc_id", "n_words", "found", *[F.when(F.col("words").isNotNull(), places(p)).alias(f"at{k}") for k, (p, _) in enumerate(BASE_PHRASES)])
    at = [F.coalesce(F.col(f"at{k}"), F.expr("cast(array() as array<int>)")) for k in range(len(BASE_PHRASES))]
    flat = f"flatten(transform(found, r -> {_places('r')}))"
    spans = f"transform({_suppressed(flat)}, x -> named_struct('begin', x.begin, 'end', -x.back, 'priority', -x.rank, 'number', x.number, 'label', x.label))"
    none = "cast(array() as array<struct<begin: int, end: int, priority: int, number: int, label: string>>)"
    kept = F.expr(f"IF(coalesce(size(found), 0) > 0, {spans}, {none})" if rules else none)
    parts = located.select("doc_id", "n_words", F.concat(*at).alias("places"), F.array_compact(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, (_, label) in zip(at, BASE_PHRASES)])).alias("base"), kept.alias("detections"))
    every = F.array_sort(F.array_distinct(F.concat("base", F.col("detections.label"))))
    best = F.array_max(F.transform("detections", lambda d: d["priority"]))
    return parts.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce(best / F.lit(100.0), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
        "detections",
    )
