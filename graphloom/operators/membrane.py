"""Values with their position: a signal in a closed set, noise with its extent, a relayed verdict, flags, or free text.

An element is one struct for all kinds: value, kind, and the fields of its kind; the others are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.operators.scope import TRANSITIONS
from graphloom.operators.validate import VOCABULARIES


def _element(value: Column, kind: str, **fields: Column) -> Column:
    types = {"contrasts": "array<string>", "gap_kind": "string", "cardinality": "bigint", "proportion": "double", "evidence": "string", "score": "double", "preconditions": "array<string>", "consequences": "array<string>"}
    parts = [value.cast("string").alias("value"), F.lit(kind).alias("kind")]
    parts += [(fields[n].cast(t) if n in fields else F.lit(None).cast(t)).alias(n) for n, t in types.items()]
    return F.struct(*parts)


def signal(value: Column, vocabulary: str) -> Column:
    """A value of a closed set; one outside it is noise of the kind indeterminate."""
    inside = value.isin(VOCABULARIES[vocabulary])
    found = _element(value, "signal", contrasts=F.array(*map(F.lit, VOCABULARIES[vocabulary])))
    return F.when(inside, found).otherwise(noise(value, F.lit("indeterminate")))


def noise(value: Column, gap_kind: Column, cardinality: Column | None = None, proportion: Column | None = None) -> Column:
    """What lies outside, by the kind of its gap; of many together also how many and what share."""
    extent = {} if cardinality is None else {"cardinality": cardinality, "proportion": proportion}
    return _element(value, "noise", gap_kind=gap_kind, **extent)


def noise_is_valid(element: str, aggregated: bool) -> Column:
    """Whether noise names a known gap and, if aggregated, its extent within its ranges."""
    known = F.col(f"{element}.gap_kind").isin(VOCABULARIES["gap_kind"])
    whole = F.col(f"{element}.cardinality").isNotNull() & (F.col(f"{element}.cardinality") >= 0) & F.col(f"{element}.proportion").between(0.0, 1.0)
    return F.coalesce(known & whole if aggregated else known, F.lit(False))


def relayed(value: Column, evidence: Column, score: Column | None = None) -> Column:
    """Somebody else's verdict with its evidence; without evidence it is noise, as is a score outside 0 to 10."""
    fields = {"evidence": evidence} | ({} if score is None else {"score": score})
    fine = F.coalesce(evidence != "", F.lit(False)) & (F.lit(True) if score is None else F.coalesce(score.between(0.0, 10.0), F.lit(True)))
    return F.when(fine, _element(value, "relayed", **fields)).otherwise(noise(value, F.lit("indeterminate")))


def flags(values: Column, vocabulary: str) -> Column:
    """Flags of a vocabulary that are present; with others among them it is noise of the kind corrupt."""
    inside = F.size(F.array_except(values, F.array(*map(F.lit, VOCABULARIES[vocabulary])))) == 0
    text = F.array_join(F.sort_array(values), ",")
    return F.when(inside, _element(text, "flags", contrasts=F.array(*map(F.lit, VOCABULARIES[vocabulary])))).otherwise(noise(text, F.lit("corrupt")))


def free_text(value: Column) -> Column:
    return _element(value, "reserved")


def doubt_state(value: Column) -> Column:
    """A doubt's state with the states that lead to it and follow it."""
    before = F.create_map(*[F.lit(x) if isinstance(x, str) else x for s in TRANSITIONS for x in (s, F.array(*[F.lit(a) for a, to in TRANSITIONS.items() if s in to]).cast("array<string>"))])
    after = F.create_map(*[F.lit(x) if isinstance(x, str) else x for s, to in TRANSITIONS.items() for x in (s, F.array(*map(F.lit, to)).cast("array<string>"))])
    return _element(value, "signal", contrasts=F.array(*map(F.lit, VOCABULARIES["doubt_state"])), preconditions=F.try_element_at(before, value), consequences=F.try_element_at(after, value))


def as_json(element: Column) -> Column:
    """An element as JSON, without the fields that its kind doesn't have."""
    return F.to_json(element)
