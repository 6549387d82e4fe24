"""Raw model responses to label items, as JVM-side expressions over VARIANT."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from compovec.functions import arrays as A
from compovec.functions.text import strip
from compovec.sources import ontology

# How a response may wrap its JSON, and the comma that must go.
MARK = "```"
FENCE = r"```(?:json)?\s*([\s\S]*?)```"
TRAILING_COMMA = r",\s*([}\]])"

# a label entry as it stands; confidence stays a variant, so that one that is missing differs from null
ENTRY = "struct<domain_id:string,confidence:variant,rationale:string>"
ITEM = "struct<domain_id:string,domain_code:string,confidence:double,rationale:string>"


def extract_json(c: Column) -> Column:
    """The first fenced block, else the first ``{`` to the last ``}``, else the whole text."""
    first = F.instr(c, F.lit("{"))
    last = F.length(c) - F.length(F.substring_index(c, "}", -1))       # 0 without one
    # the parts around the first two marks say what FENCE says, without a pattern that goes on character by character
    parts = F.split(c, MARK, 3)
    inside = F.get(parts, F.lit(1))
    return (
        F.when(c.contains(MARK) & (F.size(parts) == 3), strip(F.when(inside.startswith("json"), F.substr(inside, F.lit(5))).otherwise(inside)))
        .when((first > 0) & (last >= first), F.substring(c, first, last - first + 1))
        .otherwise(strip(c))
    )


def closers(raw: Column) -> Column:
    """The brackets still open at the end of ``raw``, in closing order."""
    marks = F.split(F.regexp_replace(raw, r"[^\[\]{}]", ""), "")

    def step(stack: Column, ch: Column) -> Column:
        return (
            F.when(ch == "{", F.concat(F.lit("}"), stack))
            .when(ch == "[", F.concat(F.lit("]"), stack))
            .when((ch != "") & (F.substring(stack, 1, 1) == ch), F.substring(stack, F.lit(2), F.length(stack)))
            .otherwise(stack)
        )

    return F.aggregate(marks, F.lit(""), step)


def repair_json(raw: Column) -> Column:
    """Text that parses: trailing commas dropped and, if still needed, closers appended; else null."""
    trimmed = F.regexp_replace(strip(raw), TRAILING_COMMA, "$1")
    closed = F.concat(trimmed, closers(trimmed))
    return (
        F.when(F.try_parse_json(trimmed).isNotNull(), trimmed)
        .when(F.try_parse_json(closed).isNotNull(), closed)
    )


def parse_response(raw: Column) -> Column:
    """VARIANT of a response text after repair, null where nothing parses; each text is parsed once."""
    trimmed = F.regexp_replace(strip(raw), TRAILING_COMMA, "$1")
    # no JSON value begins otherwise: other texts need no parser to fail twice, which costs an exception each
    begins = F.substring(trimmed, 1, 1).isin(*'{["-0123456789') | reduce(or_, [trimmed.startswith(w) for w in ("true", "false", "null")])
    return F.when(begins, F.coalesce(F.try_parse_json(trimmed), F.try_parse_json(F.concat(trimmed, closers(trimmed)))))


def label_items(v: Column) -> Column:
    """Entries of the ``labels`` array, or the legacy single ``label`` object as one; else empty.

    The array is taken apart by one cast; an entry that is not an object is null.
    """
    labels = F.try_variant_get(v, "$.labels", "variant")
    # a path into something that is not an object is null, so this also tests for one
    legacy = F.try_variant_get(v, "$.label.domain_id", "variant").isNotNull()
    empty = F.array().cast(f"array<{ENTRY}>")
    absent = labels.isNull() | F.is_variant_null(labels)
    return F.coalesce(F.try_variant_get(v, "$.labels", f"array<{ENTRY}>"),
                      F.when(absent & legacy, F.array(F.try_variant_get(v, "$.label", ENTRY))), empty)


def normalise_items(items: Column, valid: list[str], code_of: dict[str, str]) -> Column:
    """Known domains with a usable confidence, clamped to [0, 1]; everything else is dropped.

    Entries that are not objects have no ``domain_id`` and fall out with the unknown ids.
    """
    code_map = F.create_map(*[F.lit(x) for kv in code_of.items() for x in kv])

    def name(item: Column) -> Column:
        return F.coalesce(F.when(item["domain_id"].isin(*valid), item["domain_id"]), strip(item["domain_id"]))

    def entry(item: Column) -> Column:
        clamped = A.let(F.try_variant_get(item["confidence"], "$", "double"), lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))
        return F.struct(
            name(item).alias("domain_id"), F.element_at(code_map, name(item)).alias("domain_code"),
            F.when(item["confidence"].isNull(), F.lit(0.0)).otherwise(clamped).alias("confidence"),
            F.coalesce(item["rationale"], F.lit("")).alias("rationale"))

    known = F.transform(F.filter(items, lambda x: name(x).isin(*valid)), entry)
    return F.filter(known, lambda x: x["confidence"].isNotNull())


def first_per_domain(items: Column) -> Column:
    """Keep the first item of every domain, in order."""
    ids = F.transform(items, lambda x: x["domain_id"])
    return F.filter(items, lambda x, i: F.array_position(ids, x["domain_id"]) == i + 1)


def id_to_code() -> dict[str, str]:
    return {d[1]: d[0] for d in ontology.domains()}
