"""JSON references: a field value as a string, {filing, prefix}, or {raw, refs: {type: [..]}}, into tokens and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.text import NUL

SHAPE = "raw variant, filing string, prefix string, refs map<string, array<variant>>"
_ITEM = "struct<ref_type: string, filing: string, prefix: string>"


def _part(v: str) -> tuple[str, str]:
    """SQL of (filing, prefix) of a variant that is a string or an object; the object is tried first."""
    scalar = f"case when schema_of_variant({v}) not like 'OBJECT%' then try_variant_get({v}, '$', 'string') end"
    return f"coalesce(try_variant_get({v}, '$.filing', 'string'), {scalar})", f"try_variant_get({v}, '$.prefix', 'string')"


def parsed(df: DataFrame, doc: Column, value: Column, failfast: bool = True) -> DataFrame:
    """(doc, own, refs): the value itself as struct(filing, prefix), and its references in order as structs with ref_type too. One pass, no shuffle."""
    parse = F.parse_json if failfast else F.try_parse_json
    rows = df.select(doc.alias("doc"), value.alias("j")).where("j is not null").select("doc", parse("j").alias("v"), F.from_json("j", SHAPE).alias("r"))
    rows = rows if failfast else rows.where("v is not null")  # with failfast no other value gives null, and the filter would parse once more
    rows = rows.select("doc", F.expr("if(r.raw is null and r.refs is null, v, r.raw)").alias("v"), F.expr("r.refs").alias("refs"))
    (f, p), (rf, rp) = _part("v"), _part("x")
    item = f"named_struct('ref_type', e.key, 'filing', {rf}, 'prefix', {rp})"
    found = f"filter(flatten(transform(map_entries(refs), e -> transform(e.value, x -> {item}))), x -> x.filing is not null)"
    return rows.select("doc", F.expr(f"named_struct('filing', {f}, 'prefix', {p})").alias("own"), F.expr(f"coalesce({found}, cast(array() as array<{_ITEM}>))").alias("refs"))


def references(df: DataFrame, doc: Column, value: Column, failfast: bool = True) -> DataFrame:
    """(doc, ord, filing, prefix, ref_type, raw_filing, raw_prefix): the value's own row has a null ref_type and ord 1; its references follow with 2, 3, ...

    Malformed JSON fails, or gives no row if failfast is off.
    """
    rows = parsed(df, doc, value, failfast)
    every = F.expr("concat(array(named_struct('ref_type', cast(null as string), 'filing', own.filing, 'prefix', own.prefix)), refs)")
    rows = rows.select("doc", "own", F.posexplode(every).alias("ord", "x")).where("x.filing is not null")
    return rows.select("doc", (F.col("ord") + 1).cast("int").alias("ord"), "x.filing", "x.prefix", "x.ref_type", F.col("own.filing").alias("raw_filing"), F.col("own.prefix").alias("raw_prefix"))


def reference_postings(df: DataFrame, doc: Column, value: Column) -> DataFrame:
    """(term, doc, ref_type, filing, prefix): postings of each display form; filing and prefix are the source's, null for the term itself."""
    r = references(df, doc, value)
    shown = F.concat(F.coalesce("prefix", F.lit("")), F.col("filing"))
    source = lambda c: F.when(F.col("ref_type").isNotNull(), F.col(c))
    return r.select(shown.alias("term"), "doc", "ref_type", source("raw_filing").alias("filing"), source("raw_prefix").alias("prefix"))


def reference_tokens(df: DataFrame, doc: Column, value: Column, failfast: bool = True) -> DataFrame:
    """(doc, tokens): for the value and then each reference a token of type filing, whose pos_inc counts 1, 2, 3, ..., and a token of type prefix at the same position if there is one.

    The tokens of references have the packed type and source as payload.
    """
    rows = parsed(df, doc, value, failfast)
    none = F.lit(None)
    made = lambda x, n, payload: F.filter(
        F.array(tokens.token(x["filing"], F.lit("filing"), n, none, none, payload), tokens.token(x["prefix"], F.lit("prefix"), F.lit(0), none, none, payload)), lambda t: t["term"].isNotNull()
    )
    own = made(F.col("own"), F.lit(1), none)
    refs = F.transform("refs", lambda x, i: made(x, i + F.when(F.col("own.filing").isNull(), 1).otherwise(2), packed_payload(x["ref_type"], F.col("own.filing"), F.col("own.prefix"))))
    return rows.select("doc", F.concat(own, F.flatten(refs)).alias("tokens"))


def token_rows(df: DataFrame, doc: Column, value: Column, failfast: bool = True) -> DataFrame:
    """(doc, n, k): the tokens of reference_tokens as rows, numbered from 0 in their document.

    The generator is an outer one, whose rows of no token are dropped after it: of
    an inner one Spark infers a filter on the size of the array, and pushes it to
    the scan with the parse written out for every mention of a part.
    """
    rows = reference_tokens(df, doc, value, failfast)
    return rows.select("doc", F.posexplode_outer("tokens").alias("n", "k")).where("k is not null")


def packed_payload(ref_type: Column, filing: Column, prefix: Column) -> Column:
    """The packed payload of a reference."""
    return F.concat_ws(NUL, ref_type, filing, prefix)
