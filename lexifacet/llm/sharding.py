"""Reproducible shuffle into shards of equal row counts, by a Feistel permutation with cycle walking.

Rows get global numbers 0..N-1 in the order (cell, columns), a keyed bijection
of 0..N-1 permutes them, and place p means shard p % shards, slot p // shards:
both are computed, and the row counts of shards differ by at most one.

The bijection works on pairs (l, r) of [0, a) x [0, b) with a = ceil(sqrt(N)),
b = ceil(N / a), so fewer than a numbers lie outside 0..N-1; each round adds a
hash of one half to the other. A result outside is permuted again until it is
inside, which takes at most a steps.

DataFrame functions only. A null, a repeated id, a repeated row and an empty
text are rows like any other: equal rows are counted before the shuffle, take
consecutive numbers and are spread again. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums

#: Cells that the numbering sorts apart; the table of their counts is at most this long.
CELLS = 8192
PRIME = 2147483647
ROUNDS = 6
SEED = 20240501


def _round_keys(seed: int) -> list[tuple[int, int, int]]:
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            x = (x * 48271 + 11) % PRIME
            row.append(x)
        keys.append(tuple(row))
    return keys


def cell_expr(id_sql: str, size_sql: str, cells: int = CELLS) -> str:
    """A cell from whole numbers by arithmetic that other engines share."""
    return f"((((coalesce({id_sql}, 0) % 1000003 + 1000003) % 1000003) * 7919 + ({size_sql} % 1000003) * 104729) % {PRIME} * 48271 % {PRIME}) % {cells}"


def permute_sql(n: str, seed: int = SEED, rounds: int = ROUNDS) -> str:
    """SQL of the permuted `n`, given columns __a, __b and __n (all numbers), inside one walk of at most __a steps."""
    keys = _round_keys(seed)
    pick = lambda j, i: f"element_at(array({', '.join(f'{k[j]}L' for k in keys[:rounds])}), {i} + 1)"

    def hashed(x: str, i: str) -> str:
        once = f"(({x} % {PRIME}) * {pick(0, i)} + {pick(1, i)}) % {PRIME}"
        return f"aggregate(array({once}), 0L, (s, y) -> (y * y + {pick(2, i)}) % {PRIME})"

    def once(x: str) -> str:
        step = f"if(i % 2 = 0, named_struct('l', (acc.l + {hashed('acc.r', 'i')}) % __a, 'r', acc.r), named_struct('l', acc.l, 'r', (acc.r + {hashed('acc.l', 'i')}) % __b))"
        return f"aggregate(sequence(0, {rounds - 1}), named_struct('l', {x} div __b, 'r', {x} % __b), (acc, i) -> {step}, acc -> acc.l * __b + acc.r)"

    few = f"aggregate(sequence(1, 4), {once(n)}, (p, w) -> if(p < __n, p, {once('p')}))"
    walk = f"aggregate(sequence(1L, __a), {once('__q')}, (p, w) -> if(p < __n, p, {once('p')}))"
    return few, f"if(__q < __n, __q, {walk})"


def shard(df: DataFrame, id_column: str, size_column: str, shards: int = 16, seed: int = SEED) -> DataFrame:
    """df with shard int and slot long. id_column: whole numbers; size_column: whole numbers, not null. All columns must be groupable.

    Columns of the table named shard or slot are replaced, all others kept.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    columns = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    own = [f"c{i}" for i in range(len(columns))]  # names of our own, so that none of the table's clash with what is added
    number, size = (own[[c.lower() for c in columns].index(x.lower())] for x in (id_column, size_column))
    rows = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(columns, own)]).groupBy(*own).agg(F.count(F.lit(1)).alias("__count"))
    rows = rows.withColumn("__cell_no", F.expr(cell_expr(number, size)))
    rows = prefix_sums(rows, [], ["__cell_no"], [number, size, *[c for c in own if c not in (number, size)]], "__count")
    rows = rows.select(*own, F.explode(F.sequence(F.col("before"), F.col("before") + F.col("__count") - 1)).alias("__row"), F.col("total").alias("__n"))
    side = F.ceil(F.sqrt(F.col("__n").cast("double"))).cast("long")
    rows = rows.withColumn("__a", side).withColumn("__b", F.expr("(__n + __a - 1) div __a"))
    few, walk = permute_sql("__row", seed)
    place = rows.withColumn("__q", F.expr(few)).withColumn("__p", F.expr(walk))
    return place.select(*[F.col(o).alias(c) for c, o in zip(columns, own)], (F.col("__p") % shards).cast("int").alias("shard"), F.expr(f"__p div {shards}").alias("slot"))


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("long")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """The digest of each document and its place: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: the shards' row counts are at most one apart. A null text has size 1 and no crc. Only these columns are shuffled, never the texts.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_size().alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    return shard(slim, "doc_id", "size", shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
