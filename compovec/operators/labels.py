"""Label sets: canonical form, gold worksheets, code translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from compovec.functions.text import explode_rows, strip
from compovec.sources import ontology

KEYS = ["report_id", "sentence_idx"]


def canonical(items: DataFrame, order: str = "pos") -> DataFrame:
    """Long label items to distinct domains per sentence.

    A repeated domain keeps its largest confidence (null counts as 0) and its
    first position.  One aggregation with map-side combine.
    """
    return items.groupBy(*KEYS, "domain_id").agg(
        F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.min(order).alias("pos"))


def canonical_with_fallback(items: DataFrame, sentences: DataFrame, order: str = "pos",
                            fallback: str = ontology.FALLBACK) -> DataFrame:
    """As ``canonical``, with the fallback at confidence 0 for sentences without any label."""
    c = sentences.select(*KEYS).join(canonical(items, order), KEYS, "left")
    return c.select(*KEYS, F.coalesce("domain_id", F.lit(fallback)).alias("domain_id"),
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("pos", F.lit(0)).alias("pos"))


def canonical_nested(df: DataFrame, labels: str = "labels", fallback: str | None = ontology.FALLBACK) -> DataFrame:
    """In-row form for label files: struct arrays to distinct (domain_id, confidence); narrow."""
    good = F.filter(F.coalesce(F.col(labels), F.array()), lambda x: F.coalesce(x["domain_id"], F.lit("")) != "")
    df = df.withColumn("_good", good)
    distinct = F.array_distinct(F.transform("_good", lambda x: x["domain_id"]))

    def best(d: Column) -> Column:
        same = F.filter("_good", lambda x: x["domain_id"] == d)
        conf = F.array_max(F.transform(same, lambda x: F.coalesce(x["confidence"], F.lit(0.0))))
        return F.struct(d.alias("domain_id"), conf.alias("confidence"))

    out = F.transform(distinct, best)
    if fallback:
        none = F.array(F.struct(F.lit(fallback).alias("domain_id"), F.lit(0.0).alias("confidence")))
        out = F.when(F.size("_good") == 0, none).otherwise(out)
    return df.withColumn(labels, out).drop("_good")


def last_row_per_key(df: DataFrame, order: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Last row wins for a repeated key, by an explicit order; max_by combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")


def union_sets(items: DataFrame) -> DataFrame:
    """Union of the label sets of a repeated key, long form."""
    return items.select(*KEYS, "domain_id").distinct()


def token_map() -> Column:
    """Lookup from upper- and lower-case codes and from ids to ids; bounded by the ontology."""
    pairs: dict[str, str] = {}
    for code, did, _, _ in ontology.domains():
        pairs[code.upper()] = did
        pairs[code.lower()] = did
        pairs[did] = did
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def resolve_token(token: Column) -> Column:
    """Id for a code or id token, as written or upper-cased; null when unknown."""
    m = token_map()
    return F.coalesce(m[token], m[F.upper(token)])


def translate(df: DataFrame, token: str, keep_unknown: bool = True) -> DataFrame:
    """Add ``domain_id`` for exact codes or ids; unknown tokens pass through or become null."""
    code_map = F.create_map(*[F.lit(x) for d in ontology.domains() for x in (d[0], d[1])])
    t = F.col(token)
    known = F.coalesce(code_map[t], F.when(t.isin(*ontology.ids()), t))
    return df.withColumn("domain_id", F.coalesce(known, t) if keep_unknown else known)


def to_codes(df: DataFrame, ids: str) -> DataFrame:
    """Add ``codes``: the codes of the known ids in an array, unknown ones dropped."""
    m = F.create_map(*[F.lit(x) for d in ontology.domains() for x in (d[1], d[0])])
    return df.withColumn("codes", F.filter(F.transform(ids, lambda i: m[i]), lambda c: c.isNotNull()))


def cell_tokens(cell: Column) -> Column:
    """Comma-separated cell to trimmed tokens, blanks dropped."""
    parts = F.split(F.coalesce(strip(cell), F.lit("")), ",", -1)
    return F.filter(F.transform(parts, strip), lambda t: t != "")


def parse_codes(df: DataFrame, cell: str = "domain_code") -> DataFrame:
    """Add ``labels`` (distinct ids in order) and ``unknown`` (unrecognised tokens); narrow.

    A numeric cell is read as the text of its integer part, as spreadsheets store a lone number; NaN is an empty cell.
    """
    text, kind = F.col(cell), df.schema[cell].dataType
    if isinstance(kind, NumericType):
        whole = F.when(~F.isnan(text.cast("double")), text)
        text = whole.cast("decimal(38,0)" if isinstance(kind, IntegralType) else "long").cast("string")
    df = df.withColumn("_tokens", cell_tokens(text))
    df = df.withColumn("labels", F.array_distinct(F.filter(
        F.transform("_tokens", resolve_token), lambda d: d.isNotNull())))
    df = df.withColumn("unknown", F.filter("_tokens", lambda t: resolve_token(t).isNull()))
    return df.drop("_tokens")


def worksheet_rows(sheet: DataFrame) -> DataFrame:
    """Rows that carry a report id or a sentence."""
    return sheet.filter(F.col("report_id").isNotNull() | F.col("sentence").isNotNull())


def header_mismatches(columns: list[str],
                      expected=("report_id", "sentence_idx", "sentence", "domain_code")) -> list[tuple[int, str, str]]:
    """Positions, found and expected names of worksheet headers that differ."""
    return [(i + 1, got, want) for i, (got, want) in enumerate(zip(columns, expected)) if got != want]


def convert_gold(sheet: DataFrame, active: list[str] | None = None) -> DataFrame:
    """Worksheet to gold labels: known and active domains, else the fallback."""
    active = ontology.ids() if active is None else active
    g = parse_codes(worksheet_rows(sheet))
    kept = F.filter("labels", lambda d: d.isin(*active))
    g = g.withColumn("labels", F.when(F.size(kept) == 0, F.array(F.lit(ontology.fallback_id(active)))).otherwise(kept))
    return g.withColumn("was_empty", F.size(kept) == 0).select(
        F.coalesce("report_id", F.lit("")).alias("report_id"),
        F.coalesce("sentence_idx", F.lit(0)).alias("sentence_idx"),
        F.coalesce("sentence", F.lit("")).alias("sentence"), "labels", "unknown", "was_empty")


def mixed_items(variant_array: Column) -> Column:
    """Mixed string or struct label items (as ``array<variant>``) to distinct ids in order."""
    def one(v: Column) -> Column:
        schema = F.schema_of_variant(v)
        return (F.when(schema == "STRING", F.try_variant_get(v, "$", "string"))
                .when(schema.startswith("OBJECT"), F.try_variant_get(v, "$.domain_id", "string")))
    ids = F.filter(F.transform(variant_array, one), lambda d: F.coalesce(d, F.lit("")) != "")
    return F.array_distinct(ids)
