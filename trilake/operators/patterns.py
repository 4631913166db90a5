"""Graph patterns as DataFrame joins.

A pattern is ``(subject, predicate, object)``; each place is a variable ``V("x")``, a
name (``":placedBy"``, ``"rdfs:label"``, a full IRI) or, as object, a literal ``Lit``.
The result is a binding table: one column per variable, null = unbound, bag semantics.
Everything after the pattern (aggregation, order, limit) is ordinary DataFrame code.

Patterns are joined in the order they are written; which join to run, and on which
side, is for Catalyst and adaptive execution to decide.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.functions import terms
from trilake.operators.joins import hot_join, hot_keys
from trilake.sources.store import predicate_filter
from trilake.vocab import PREFIXES


@dataclass(frozen=True)
class V:
    """A variable. With `as_type` its column holds the typed value, null if the term is
    malformed or of another datatype; ``term`` keeps value, kind, datatype and language."""

    name: str
    as_type: str | None = None


@dataclass(frozen=True)
class Lit:
    """A constant literal."""

    lexical: str
    dtype: str | None = None
    lang: str | None = None


Place = V | Lit | str
Pattern = tuple[Place, Place, Place]

_TERM = "_term_"  # hidden column: kind, datatype and language of a term next to its text


def variables(patterns: Sequence[Pattern]) -> list[str]:
    """Names in order of first use."""
    return list(dict.fromkeys(x.name for pattern_ in patterns for x in pattern_ if isinstance(x, V)))


def _resources(patterns: Sequence[Pattern]) -> set[str]:
    """Variables that stand as subject or predicate, so can not be a literal."""
    return {x.name for pattern_ in patterns for x in pattern_[:2] if isinstance(x, V)}


def _compared(patterns: Sequence[Pattern]) -> set[str]:
    """Variables that stand in two places or more."""
    names = [x.name for pattern_ in patterns for x in pattern_ if isinstance(x, V)]
    return {name for name in names if names.count(name) > 1}


def _object_is(obj: Lit | str, prefixes: Mapping[str, str]) -> Column:
    if isinstance(obj, Lit):
        dtype = terms.iri(obj.dtype, prefixes) if obj.dtype else None
        return (
            (F.col("o") == obj.lexical)
            & (F.col("o_kind") == "literal")
            & (F.col("o_dtype").isNull() if dtype is None else F.col("o_dtype") == dtype)
            & (F.col("o_lang").isNull() if obj.lang is None else F.col("o_lang") == obj.lang)
        )
    return (F.col("o") == terms.iri(obj, prefixes)) & (F.col("o_kind") == "iri")


def _term_identity() -> Column:
    """Empty for a resource; distinguishes literals with the same text."""
    tagged = F.concat(F.lit('"'), F.coalesce("o_dtype", F.lit("")), F.lit("@"), F.coalesce("o_lang", F.lit("")))
    return F.when(F.col("o_kind") == "literal", tagged).otherwise("")


def _scan(
    triples: DataFrame,
    one: Pattern,
    prefixes: Mapping[str, str],
    resources: Collection[str] = (),
    tracked: Collection[str] = (),
) -> DataFrame:
    """Bindings of one pattern. Variables in `resources` never bind a literal; those in
    `tracked` get a hidden column that tells terms with the same text apart."""
    s, p, o = one
    rows = triples
    if not isinstance(p, V):
        rows = rows.where(predicate_filter(rows, terms.iri(p, prefixes)))
    if not isinstance(s, V):
        rows = rows.where(F.col("s") == terms.iri(s, prefixes))
    if not isinstance(o, V):
        rows = rows.where(_object_is(o, prefixes))
    elif o.name in resources:
        rows = rows.where(F.col("o_kind") != "literal")
    columns: dict[str, Column] = {}
    for place, column in ((s, "s"), (p, "p"), (o, "o")):
        if not isinstance(place, V):
            continue
        value = F.col(column)
        if place.name in columns:  # the same variable twice in one pattern
            rows = rows.where(columns[place.name] == value)
            continue
        columns[place.name] = value
    shown = []
    for place, column in ((s, "s"), (p, "p"), (o, "o")):
        if isinstance(place, V) and columns.get(place.name) is not None:
            value = columns.pop(place.name)
            if place.as_type:
                value = terms.bound_value(place.as_type) if column == "o" else terms.term_value(value, place.as_type)
            shown.append(value.alias(place.name))
            if place.name in tracked:
                shown.append((_term_identity() if column == "o" else F.lit("")).alias(_TERM + place.name))
    return rows.select(*shown)


def pattern(
    triples: DataFrame, s: Place, p: Place, o: Place, prefixes: Mapping[str, str] = PREFIXES
) -> DataFrame:
    """Bindings of a single pattern: a scan with filters on its constants."""
    return _scan(triples, (s, p, o), prefixes)


def _maybe_unbound(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if (f.metadata or {}).get("maybe_unbound")}


def _join(left: DataFrame, right: DataFrame, how: str, piled: DataFrame | None = None) -> DataFrame:
    """`piled` are the bindings (of the right side) that may pile up on one shared value."""
    shared = [c for c in right.columns if c in left.columns]
    open_ = (_maybe_unbound(left) | _maybe_unbound(right)) & set(shared)
    if open_:
        # SPARQL lets an unbound variable match anything; SQL null matches nothing.
        raise ValueError(f"cannot join on variables that may be unbound: {sorted(open_)}")
    if not shared:
        raise ValueError("patterns share no variable: that would be a cross product")
    only_shared = set(right.columns) == set(shared)
    if how == "inner" and only_shared:
        # A constant-only pattern binds nothing new, and a graph holds each triple once.
        how = "left_semi"
    elif piled is not None:
        keys = [c for c in shared if c in piled.columns]
        if keys == shared:
            return hot_join(right, left, shared, hot_keys(piled, keys), "keep" if how == "left" else "inner")
    return left.join(right, shared, how)


def _star(
    triples: DataFrame,
    subject: str,
    patterns: Sequence[Pattern],
    prefixes: Mapping[str, str],
    resources: Collection[str],
    tracked: Collection[str],
) -> DataFrame:
    """All patterns of one subject in a single aggregation over their predicates."""
    by_predicate = {terms.iri(p, prefixes): o for _, p, o in patterns}
    rows = triples.where(predicate_filter(triples, *by_predicate))
    wanted, shown = [], [F.col("s").alias(subject)]
    if subject in tracked:
        shown.append(F.lit("").alias(_TERM + subject))
    for i, (predicate, o) in enumerate(by_predicate.items()):
        here = F.col("p") == predicate
        if not isinstance(o, V):
            wanted.append(F.max(F.when(here & _object_is(o, prefixes), 1)).alias(f"_c{i}"))
            continue
        if o.name in resources:
            here = here & (F.col("o_kind") != "literal")
        wanted.append(F.max(F.when(here, 1)).alias(f"_c{i}"))
        value = terms.bound_value(o.as_type) if o.as_type else F.col("o")
        wanted.append(F.max(F.when(here, value)).alias(f"_v{i}"))
        shown.append(F.col(f"_v{i}").alias(o.name))
        if o.name in tracked:
            wanted.append(F.max(F.when(here, _term_identity())).alias(f"_t{i}"))
            shown.append(F.col(f"_t{i}").alias(_TERM + o.name))
    matched = rows.groupBy("s").agg(*wanted)
    for i in range(len(by_predicate)):
        matched = matched.where(F.col(f"_c{i}").isNotNull())
    return matched.select(*shown)


def _group(
    triples: DataFrame,
    patterns: Sequence[Pattern],
    strategy: str,
    single_valued: Collection[str],
    prefixes: Mapping[str, str],
    resources: Collection[str],
    tracked: Collection[str],
    skewed: Collection[str] = (),
) -> DataFrame:
    """Join of all patterns of one group; hidden columns included."""
    typed = {x.name for one in patterns for x in one if isinstance(x, V) and x.as_type}
    if typed & _compared(patterns):
        raise ValueError(f"typed variables can not be joined on: {sorted(typed & _compared(patterns))}")
    steps: list[list[Pattern]] = []
    functional = {terms.iri(p, prefixes) for p in single_valued}
    for one in patterns:
        s, p, o = one
        fits = (
            strategy == "star"
            and isinstance(s, V)
            and s.as_type is None
            and isinstance(p, str)
            and terms.iri(p, prefixes) in functional
            and not (isinstance(o, V) and o.name == s.name)
        )
        last = steps[-1] if steps else None
        if fits and last and last[0][0] == s and all(terms.iri(q[1], prefixes) in functional for q in last):
            taken = {q[1] for q in last} | {q[2].name for q in last if isinstance(q[2], V)}
            if p not in taken and not (isinstance(o, V) and o.name in taken):
                last.append(one)
                continue
        steps.append([one])
    result: DataFrame | None = None
    for step in steps:
        if len(step) == 1:
            bound = _scan(triples, step[0], prefixes, resources, tracked)
        else:
            bound = _star(triples, step[0][0].name, step, prefixes, resources, tracked)
        piled = bound if len(step) == 1 and _is_skewed(step[0], skewed, prefixes) else None
        result = bound if result is None else _join(result, bound, "inner", piled)
    if result is None:
        raise ValueError("a group needs at least one pattern")
    return result


def _is_skewed(one: Pattern, skewed: Collection[str], prefixes: Mapping[str, str]) -> bool:
    p = one[1]
    return isinstance(p, str) and terms.iri(p, prefixes) in {terms.iri(x, prefixes) for x in skewed}


def _piled(
    triples: DataFrame,
    group: Sequence[Pattern],
    skewed: Collection[str],
    prefixes: Mapping[str, str],
    resources: Collection[str],
    tracked: Collection[str],
) -> DataFrame | None:
    """Bindings of the first skewed pattern of a group: enough to see where rows pile up."""
    for one in group:
        if _is_skewed(one, skewed, prefixes):
            return _scan(triples, one, prefixes, resources, tracked)
    return None


def _mark_optional(joined: DataFrame, names: Sequence[str]) -> DataFrame:
    marked = {n: F.col(n).alias(n, metadata={"maybe_unbound": True}) for n in names}
    return joined.select(*[marked.get(c, F.col(c)) for c in joined.columns])


def _visible(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith(_TERM)])


def bgp(
    triples: DataFrame,
    patterns: Sequence[Pattern],
    optionals: Sequence[Sequence[Pattern]] = (),
    strategy: str = "join",
    single_valued: Collection[str] = (),
    skewed: Collection[str] = (),
    prefixes: Mapping[str, str] = PREFIXES,
) -> DataFrame:
    """Bindings of a basic graph pattern, then of its OPTIONAL groups in turn; one column
    per variable, in order of first use.

    ``strategy="star"`` reads consecutive patterns of one subject in a single
    aggregation. That is right only for predicates with one value per subject, so just
    those named in `single_valued` take part; the rest are joined as usual.

    `skewed` names predicates whose triples may pile up on one value of the variable they
    are joined on (a customer with a third of all orders). Their keys are counted first,
    and hot ones are spread over several tasks.

    Terms are compared as terms: a literal never joins an IRI of the same text.
    `triples` is one graph, so without repeated triples; pick it with `dump_graph`, or
    merge several with `graph_union`, where there are named graphs.
    """
    if strategy not in ("join", "star"):
        raise ValueError(f"unknown strategy {strategy!r}")
    whole = [*patterns, *[one for group in optionals for one in group]]
    required = _resources(patterns)
    tracked = _compared(whole) - required
    result = _group(triples, patterns, strategy, single_valued, prefixes, required, tracked, skewed)
    for group in optionals:
        resources = required | _resources(group)
        right = _group(triples, group, strategy, single_valued, prefixes, resources, tracked, skewed)
        piled = _piled(triples, group, skewed, prefixes, resources, tracked)
        fresh = [c for c in right.columns if c not in result.columns]
        result = _mark_optional(_join(result, right, "left", piled), fresh)
    return result.select(*variables(whole))


def optional(
    bindings: DataFrame,
    triples: DataFrame,
    patterns: Sequence[Pattern],
    where: Column | None = None,
    strategy: str = "join",
    single_valued: Collection[str] = (),
    skewed: Collection[str] = (),
    prefixes: Mapping[str, str] = PREFIXES,
) -> DataFrame:
    """OPTIONAL over any binding table: the group is joined first, then left-joined.

    A half-matched group leaves all its variables unbound. `where` belongs to the group
    (the ON condition), so it never removes rows of `bindings`. The variables shared
    with `bindings` must hold resources there, as for a plain table nothing tells an
    IRI from a literal; put the group into :func:`bgp` where that matters.
    """
    shared = set(bindings.columns) & set(variables(patterns))
    resources = _resources(patterns) | shared
    tracked = _compared(patterns) - resources
    right = _visible(_group(triples, patterns, strategy, single_valued, prefixes, resources, tracked, skewed))
    piled = _piled(triples, patterns, skewed, prefixes, resources, ())
    if where is not None:
        right = right.where(where)
    fresh = [c for c in right.columns if c not in bindings.columns]
    joined = _mark_optional(_join(bindings, right, "left", piled), fresh)
    return joined.select(*bindings.columns, *[v for v in variables(patterns) if v in fresh])


def semi_join(
    bindings: DataFrame, triples: DataFrame, one: Pattern, prefixes: Mapping[str, str] = PREFIXES
) -> DataFrame:
    """Keep the bindings for which a pattern over their variables holds."""
    known = set(bindings.columns)
    new = set(variables([one])) - known
    if new:
        raise ValueError(f"pattern binds new variables: {sorted(new)}")
    return _join(bindings, _scan(triples, one, prefixes, known), "inner").select(*bindings.columns)
