"""The training-data operators on odd rows, on empty tables and against brute force."""

import hashlib
import math
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from lexifacet.llm import common, decontam, embeddings, langid, licenses, minhash, mixing, pii, quality, queries, sharding, urls, viterbi

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, __k string, copies int, class string"
PROSE = "the quick brown fox jumps over the lazy dog while seven other animals look on from a distant hill and wonder what it all means for them today "
NEAR = PROSE * 1 + "unlike the other"
ITEM = "a benchmark passage of many particular words that no clean document would ever hold by chance alone in this world"
SWAPPED = " ".join(ITEM.split()[10:] + ["and"] + ITEM.split()[:10])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "   \n", "one", "one two", "One TWO", PROSE, PROSE, PROSE + "extra end", NEAR, ITEM, "x " + SWAPPED, "é" * 50, "a" * 300_000, "w " * 60_000, "12345 !!! ???", "mail me at bob.x@mail.example.com or +1 (555) 555-1234 now"]
    rows = [(i, t, "en" if i % 3 else None, [None, "a", "b", "a"][i % 4], None, "s", "h", "k", 1, "c") for i, t in enumerate(texts)]
    rows += [(3, "one", None, "a", None, "s", "h", "k", 1, "c")] * 3 + [(None, PROSE, "en", None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, "too short")], "item_id long, text string")


def test_sharding(docs, none):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == docs.count() and sharding.shard_documents(none).count() == 0
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(len(by.get(i, [])) for i in range(16)) <= 1
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 1, -1 if r["text"] is None else zlib.crc32(r["text"].encode())) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["size"], -1 if r["text_crc32"] is None else r["text_crc32"]) for r in got) == want
    again = sharding.shard_documents(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_keep_all_columns(spark):
    df = spark.range(10).select("id", F.lit(1).alias("size"), *[F.lit(i).alias(n) for i, n in enumerate(("__a", "__row", "before", "total", "c0", "slot", "Shard"))])
    out = sharding.shard(df, "id", "size", 3)
    assert out.columns == ["id", "size", "__a", "__row", "before", "total", "c0", "shard", "slot"] and {tuple(r)[2:7] for r in out.collect()} == {(0, 1, 2, 3, 4)}


@pytest.mark.parametrize("name", ["op1_sharding", "op3_embedding_near_dedup", "op4_mixing", "op7_minhash_near_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    ran = con.execute(queries.oracle_sql()[name])
    at = [x[0] for x in ran.description]
    got = queries.queries()[name](spark, SMALL)
    assert sorted(at) == sorted(got.columns) and sorted(str(tuple(r)) for r in got.select(*at).collect()) == sorted(map(str, ran.fetchall()))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 1000])
def test_permutation_is_a_bijection(spark, n):
    out = sharding.shard(spark.range(n).withColumn("size", F.lit(1).cast("long")), "id", "size", 4).collect()
    assert sorted(r["slot"] * 4 + r["shard"] for r in out) == list(range(n))
    if n == 1000:
        assert abs(np.corrcoef([r["id"] for r in out], [r["slot"] for r in out])[0, 1]) < 0.15


def test_mixing(spark, docs, none):
    got = mixing.mix_report(docs).collect()
    assert len(got) == docs.count() and mixing.mix_report(none).count() == 0
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r["doc_id"] or -1, len(words(r["text"]))) for r in docs.collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got) and mixing.mix(none).count() == 0
    sizes = {"=a": 100, "=b": 50, "=c": 10, "n": 1}
    made = mixing.targets(spark.createDataFrame(list(sizes.items()), "source_key string, source_size long")).collect()
    weight, left, fixed = {"=a": 3, "=b": 1, "=c": 2, "n": 3}, 1.5 * 161, {}
    while True:
        share = {k: left_ for k, left_ in ((k, (left - sum(fixed.values())) * w / sum(v for x, v in weight.items() if x not in fixed)) for k, w in weight.items() if k not in fixed)}
        over = {k: 2.0 * sizes[k] for k, v in share.items() if v > 2 * sizes[k]}
        if not over:
            break
        fixed |= over
    assert {r["source_key"]: pytest.approx(r["target"]) for r in made} == fixed | share


def test_targets_of_many_sources(spark, monkeypatch):
    """Ranked by ranges of keys and reshared round by round: the same targets as in one task."""
    rng = np.random.default_rng(9)
    rows = [(f"={x}", int(n)) for x, n in zip(rng.permutation(3000), rng.integers(0, 2000, 3000))] + [("n", 77)]
    sizes = spark.createDataFrame(rows, "source_key string, source_size long")
    want = sorted(map(tuple, mixing.targets(sizes).collect()))
    monkeypatch.setattr(mixing, "FEW", 10)
    got = sorted(map(tuple, mixing.targets(sizes).collect()))
    assert got == want and sum(t < 2 * n for _, n, t in want) > 5 and math.isclose(sum(t for _, _, t in want), 1.5 * sum(n for _, n in rows))


def test_near_duplicates(docs, none):
    got = minhash.document_components(docs).collect()
    assert len(got) == docs.count() and minhash.document_components(none).count() == 0
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)]) if w else frozenset() for _, w in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root[i], []).append(d)
    of = lambda i, d: d if not sets[i] else min((x for x in least[root[i]] if x is not None), default=None)
    assert sorted(map(str, ((d, len(sets[i]), of(i, d), d == of(i, d)) for i, (d, _) in enumerate(rows)))) == sorted(str(tuple(r)) for r in got)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and minhash.keep_one(none).count() == 0
    assert sum(r["text"] is not None and "quick" in r["text"] for r in kept.collect()) == 1


def test_every_level_of_nodes(spark, monkeypatch):
    """Tiny nodes and blocks: branching, the last level and block pairs give the same links."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(40)] + [(100 + i, " ".join(f"u{i}x{j}" for j in range(20))) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.document_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 100 else i for i, _ in rows}


def test_links_within_families(spark, monkeypatch):
    """Chains whose ends don't link, sets that are alike without linking, clusters: in tiny blocks the components of brute force."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = np.random.default_rng(2)
    long = [f"c{i}" for i in range(400)]
    texts = [" ".join(long[i * 4 : i * 4 + 120]) for i in range(40)] + [" ".join(long[i * 11 : i * 11 + 120]) for i in range(20)]
    base = [f"t{i}" for i in range(120)]
    for i in range(60):  # a template with one to seven changed words
        w = list(base)
        for j in rng.choice(120, 1 + i % 7, replace=False):
            w[j] = f"x{i}y{j}"
        texts.append(" ".join(w))
    sets = [frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for _ in range(8):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r["component_id"] for r in minhash.document_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root)) and 5 < len(set(root)) < len(root) - 30


def test_main_part_moves_to_the_others_only(spark):
    """Each row of a connected part of 1,000 blocks goes to the blocks of the rest, not to those of its own part."""
    rows = spark.range(5000).select(F.lit(1).alias("family"), F.col("id").alias("class"), (F.col("id") < 4990).alias("main"), F.lit(1000).alias("main_parts"), F.lit(2).alias("other_parts"))
    got = {(r["class"], r["x"], r["y"]) for r in common.blocks_with_main(rows, "family").collect()}
    assert len(got) == 4990 * 2 + 10 * 1002 and all(y >= 1000 for _, _, y in got)


def test_recall_of_text_pairs(spark):
    """10,000 pairs of similarity 0.857, near the threshold: none is missed."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(10_000):
        w = [f"{x:x}" for x in rng.integers(0, 1 << 40, 80)]
        v = list(w)
        v[20], v[60] = "p", "q"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = minhash.document_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id != 2 * (doc_id div 2) or n_shingles != 78").count() == 0 and got.count() == 20_000


def test_decontamination(spark, docs, none, items):
    got = sorted((r["doc_id"], r["item_id"], r["covered"]) for r in decontam.report(docs, items).collect())
    assert got == [(10, 7, 20), (11, 7, 20)]
    left = decontam.drop_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 2
    assert decontam.report(none, items).count() == 0 and decontam.report(docs, items.limit(0)).count() == 0


def test_short_benchmark_items(spark):
    """Items of one to four words match the documents that hold them whole, and change nothing for longer ones."""
    texts = ["Forty-two", "the answer: forty two!", "forty x two", "a b c d", "z A, b c d e", "b c d", "solitaire", "solitaires", ITEM + " solitaire", "", None, "forty", "two forty two forty"]
    short = [(1, "forty two"), (2, "a b c d"), (3, "Solitaire."), (4, "..."), (5, ""), (6, "x y z"), (7, ITEM)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(short, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["covered"], r["item_words"], r["coverage"]) for r in decontam.report(d, b).collect())
    assert got == [(0, 1, 2, 2, 1.0), (1, 1, 2, 2, 1.0), (3, 2, 4, 4, 1.0), (4, 2, 4, 4, 1.0), (6, 3, 1, 1, 1.0), (8, 3, 1, 1, 1.0), (8, 7, 20, 20, 1.0), (12, 1, 2, 2, 1.0)]
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()) == [2, 5, 7, 9, 10, 11]


def brute_tiles(a, b, seed):
    """The longest common run of unmarked words, the leftmost of equal ones, again and again."""
    a, b, out = list(a), list(b), []
    while True:
        best = (0, 0, 0)
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                if x is not None and x == y:
                    new[j + 1] = row[j] + 1
                    best = min(best, (-new[j + 1], i - new[j + 1] + 1, j - new[j + 1] + 1))
            row = new
        n, i, j = -best[0], best[1], best[2]
        if n < seed:
            return sorted(out)
        out.append((i, j, n))
        a[i : i + n], b[j : j + n] = [None] * n, [None] * n


def test_tiles_against_brute_force():
    rng = np.random.default_rng(8)
    for size, kinds in ((6, 2), (12, 2), (25, 3), (40, 3), (60, 8), (60, 40)):
        for _ in range(12):
            item = [f"w{x}" for x in rng.integers(0, kinds, rng.integers(1, size))]
            parts = [[f"w{x}" for x in rng.integers(0, kinds + 1, rng.integers(1, size))] for _ in range(rng.integers(1, 4))]
            if size == 60:  # reordered passages of the item
                cuts = sorted(rng.integers(0, len(item), 4).tolist())
                pieces = [item[x:z] for x, z in zip([0, *cuts], [*cuts, len(item)]) if z > x]
                parts = [[w for k in rng.permutation(len(pieces)) for w in [*pieces[k], "x"]]] + parts
            flat = [w for i, p in enumerate(parts) for w in [*p, f"end{i}"]]
            for seed in (1, 3, 5):
                assert sorted(decontam.tiles(item, parts, seed)) == brute_tiles(item, flat, seed)


def test_long_tiles():
    """20,000 words, reordered in pieces of many lengths, and the same word throughout: all is covered."""
    item = [f"w{i}" for i in range(20_000)]
    cuts = np.unique(np.random.default_rng(3).integers(0, 20_000, 300)).tolist()
    pieces = [item[a:z] for a, z in zip([0, *cuts], [*cuts, 20_000])]
    found = decontam.tiles(item, pieces[::-1], 5)
    assert sum(x[2] for x in found) == sum(len(p) for p in pieces if len(p) >= 5)
    assert sum(x[2] for x in decontam.tiles(["a"] * 20_000, [["a"] * 15_000, ["a"] * 7], 5)) == 15_007


def test_decontamination_against_brute_force(spark):
    """Documents that hold, reorder, cut and repeat items, and a phrase that all share; the result by tiling every pair."""
    rng = np.random.default_rng(6)
    stock = "as everybody knows by now it goes without saying"
    vocabulary = [f"v{i}" for i in range(400)]
    made = [" ".join(rng.choice(vocabulary, n)) for n in (7, 12, 20, 35, 35)]
    made = [f"{stock} {m}" for m in made] + [stock, "a a a a a a a a a a", "b b b b b b c b b b b b b", "one two"]
    texts = []
    for m in made:
        w = m.split()
        half = len(w) // 2
        texts += [m, f"x {' '.join(w[half:])} y {' '.join(w[:half])}", " ".join(w[: math.ceil(0.6 * len(w))]), " ".join(w[: math.ceil(0.6 * len(w)) - 1]), " ".join(x for i in range(0, len(w), 5) for x in [*w[i : i + 5], "z"]), m.upper().replace(" ", ", ")]
    texts += [f"{stock} {' '.join(rng.choice(vocabulary, 30))}" for _ in range(40)]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(made)), "item_id long, text string")
    plain = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    want = []
    for i, m in enumerate(made):
        a = plain(m)
        for d, t in enumerate(texts):
            seed = min(5, len(a))
            covered = sum(x[2] for x in brute_tiles(a, plain(t), seed)) if len(set(a) & set(plain(t))) >= 1 else 0
            if covered >= (math.ceil(0.6 * len(a)) if len(a) >= 5 else len(a)):
                want.append((d, i, covered, len(a)))
    assert sorted((r["doc_id"], r["item_id"], r["covered"], r["item_words"]) for r in decontam.report(docs, items).collect()) == sorted(want) and len(want) > 40


def test_tiles_are_greedy():
    item = "a b c d e f g h i j".split()
    assert sorted(decontam.tiles(item, ["f g h i j".split(), "x a b c d e".split()], 5)) == [(0, 7, 5), (5, 0, 5)]
    assert decontam.tiles(item, ["a b c d x e f g h".split()], 5) == []
    assert sum(x[2] for x in decontam.tiles(["a"] * 12, [["a"] * 7], 5)) == 7


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(25, 16)) * 0.12 for c in centre] + [rng.normal(size=(60, 16))])
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)] + [(900 + i, [float(v) for v in x[0]], 0) for i in range(3)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [1.0] * 16, None), (1005, [1.0, 2.0], 1), (1006, [1e30, 2e30], 1), (None, [-1.0, 1.0], 1), (1007, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.linked(df, block=20, bucket=10).collect()}
    ids, v, lab = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    root = ids.copy()
    for _ in ids:
        root = np.array([min([root[i], *root[near[i]]]) for i in range(len(ids))])
    want = {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(1), root)}
    want |= {i: (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1007, None)} | {1005: (1, 1005, True), 1006: (1, 1005, False)}
    assert got == want and near.sum() > 100
    assert embeddings.linked(df.limit(0)).count() == 0


def test_isolated_pairs_at_the_threshold(spark, monkeypatch):
    """With the bits and tables of ten million classes, no pair at the threshold without other neighbours is missed: 10,000 pairs of cosine 0.98 to 0.985."""
    many = embeddings.tables_for
    monkeypatch.setattr(embeddings, "tables_for", lambda classes, threshold: many(10_000_000, threshold))
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, 10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    cosine = rng.uniform(0.980001, 0.985, (len(x), 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(2 * i + k, v[i].tolist(), 0) for i in range(len(x)) for k, v in enumerate((x, y))]
    got = embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r["n_links"] != 1 or r["component_id"] != r["vec_id"] // 2 * 2 for r in got) == 0 and len(got) == len(rows)


def test_codes_estimate_without_bias():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    z, signs, f = embeddings.encode(x)
    s = np.where(signs, 1.0, -1.0)
    estimate = (s @ z.T) / (math.sqrt(z.shape[1]) * f[:, None])
    error = estimate - z @ z.T
    bound = embeddings.BOUND * np.sqrt((1 - f**2) / (f**2 * (z.shape[1] - 1)))
    off = ~np.eye(len(x), dtype=bool)
    assert abs(error[off].mean()) < 0.01 and (np.abs(error) <= bound[:, None])[off].all()


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "https://b.net/x"), (3, "http://net"), (4, None), (5, "no scheme"), (6, "http://x.example.com/de/1"), (7, "http://www.casino-win.example.com/en/9.html"), (8, "http://library.example.org/fr/2"), (9, "http://library.example.org/en/2"), (9, "http://badnet/x"), (10, "://?x")]
    got = [tuple(r) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)), urls.train()).orderBy("page_id", "host").collect()]
    assert got[0] == (1, "a.example.net", "/en/x", "example.net/en/", "allow") and got[1] == (2, "b.net", "/x", "net/", "block")
    assert got[2][:4] == (3, "net", "", None) and got[3] == (4, "", "", None, "allow") and got[4] == (5, "", "", None, "allow")
    assert got[5][3:] == ("example.com/de/", "block") and got[6][3:] == (None, "block") and got[7][3:] == ("org/fr/", "allow") and got[-1][1:3] == ("", "")
    assert [r[3:] for r in got if r[1] == "library.example.org" and r[2] == "/en/2"] == [(None, "allow")]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.train()).count() == 0


def test_url_labels_are_not_those_of_the_table(spark):
    """The labelled table shares with `pages` no label but heads, tails and the like; what it doesn't hold is judged by its n-grams."""
    labels = lambda hosts: {x for h in hosts for x in h.split(".")}
    judged = urls.judge(spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.1')}/pages.parquet"), urls.train()).select("host").distinct().collect()
    own = urls.labelled()
    common = {x for h in (*urls._HEADS, *urls._TAILS) for x in h.split(".")}
    assert labels(r["host"] for r in judged) & labels(r[0] for r in own) <= common


def test_url_names_left_out_of_training():
    """Five folds by name: no name is in training and test."""
    rows = urls.labelled()
    fold = dict(zip(sorted({(r[2], r[3]) for r in rows}), np.random.default_rng(1).integers(0, 5, len(rows)).tolist()))
    said, truth = [], []
    for f in range(5):
        w = urls.train([r for r in rows if fold[r[2], r[3]] != f])
        test = [r for r in rows if fold[r[2], r[3]] == f]
        said += (urls.probability(w, [r[0] for r in test], [r[1] for r in test]) >= 0.5).tolist()
        truth += [r[2] == 1 for r in test]
    said, truth = np.array(said), np.array(truth)
    assert (said & truth).sum() / truth.sum() > 0.8 and (said & truth).sum() / said.sum() > 0.94 and (said & ~truth).sum() / (~truth).sum() < 0.02


def test_urls_against_brute_force(spark):
    """Host, path and rule of the query on every url, by plain Python; where no rule fits, the verdict is the model's."""
    weights = urls.train()
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    odd = [(-1, "HTTP://NET/x"), (-2, "a://b.NET?q"), (-3, "x://ex.example.net/en/"), (-4, "x://example.net/en"), (-5, "x://y://example.com/de/"), (-6, ""), (-7, None), (-8, "x://é.org/fr/é#"), (-9, "x://" + "a" * 50_000 + ".org/fr/"), (-9, "x://a.org/fr"), (None, "x://xnet/")]
    every = pages.union(spark.createDataFrame(odd, "page_id long, url string"))
    want = []
    for i, url in [tuple(r) for r in every.collect()]:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
        want.append((i, host, path, rule, verdict or ("block" if urls.probability(weights, [host], [path])[0] >= 0.5 else "allow")))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in urls.judge(every, weights).collect())


def test_caches_stay_at_home(spark):
    """What functions cache in the driver doesn't travel with them: their pickled forms are small."""
    from pyspark import cloudpickle

    decontam.tiles(["a"] * 9, [["a"] * 9], 5), embeddings.rotation(64), list(embeddings.bucket_keys(np.ones((1, 64)), 8, 30))
    for f in (decontam.tiles, embeddings.linked, embeddings.encode, quality.features, minhash.digests, pii.find, langid.label_texts, licenses.Scanner):
        assert len(cloudpickle.dumps(f)) < 200_000, f


def test_viterbi():
    rng = np.random.default_rng(0)
    for k in (1, 2, 4, 5, 130, 200):
        for scale in (1, 5, 30):
            first = np.concatenate([[0], np.cumsum(rng.integers(0, 25, 40))])
            s, change = rng.normal(size=(first[-1], k)) * scale, rng.normal(size=(k, k))
            assert viterbi.decode(s, first, change).tolist() == [x for a, z in zip(first, first[1:]) for x in viterbi.decode_slowly(s[a:z], change)]


def test_language(spark, docs, none):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identify(d, langid.fit(d)).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    model = langid.fit(d)
    odd = {(r["doc_id"]): r for r in langid.identify(docs, model).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[15]["lang_pred"] == "und" and odd[12]["lang_pred"] != "und" and len(odd) == 18
    assert langid.identify(none, model).count() == 0 and {r["lang_pred"] for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}
    de, fr = ("der die das und nicht einer schlicht werden für über " * 6), ("que les dans une être été pour avec leur même où " * 6)
    spans = langid.label_texts(model, pa.array([de + fr]), spans=True)[2][0]
    assert [s[2] for s in spans] == ["de", "fr"]


def test_many_languages():
    """130 made-up languages, scored some words at a time and together, give the same; labels above 127 come out."""
    rng = np.random.default_rng(1)
    letters = [chr(97 + i) for i in range(26)]
    vocabulary = {f"l{i:03}": ["".join(rng.choice(letters, 5)) for _ in range(30)] for i in range(130)}
    model = langid.learn((" ".join(rng.choice(v, 200)), k) for k, v in vocabulary.items())
    texts = [" ".join(rng.choice(v, 40)) for v in vocabulary.values()]
    assert langid.label_texts(model, pa.array(texts))[0] == list(vocabulary)
    many, langid.SCORED = langid.SCORED, 5000
    assert langid.label_texts(model, pa.array(texts))[0] == list(vocabulary)
    langid.SCORED = many


@pytest.mark.parametrize("doc_id", [None, 5, 9])
def test_samples_are_bounded_for_any_ids(spark, monkeypatch, doc_id):
    """One id, null or not, on all rows: neither sample is empty where there is a row to learn from, none is above its bound."""
    d = spark.range(6000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"), F.when(F.col("id") < 5900, "a").otherwise("b").alias("lang"), (F.col("id") % 2).cast("int").alias("quality"))
    took = {}
    monkeypatch.setattr(langid, "learn", lambda rows: took.update(n=[lang for _, lang in rows]))
    for rows in (d, d.withColumn("text", F.lit("the same"))):
        langid.fit(rows, 200)
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
        distinct = 1 if rows is not d else 200
        assert (not held and distinct / 2 <= took["n"].count("a") <= 2 * distinct and took["n"].count("b") == min(100, distinct)) or took["n"] == []
    monkeypatch.setattr(quality, "train", lambda x, y: took.update(y=y))
    quality.fit(d, d.select("doc_id", "quality"), 300)
    assert len(took["y"]) == (300 if doc_id is not None and not held else 0)


def test_language_spans_of_documents(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(d)
    de, fr = ("der die das und nicht einer schlicht werden für über " * 6), ("que les dans une être été pour avec leur même où " * 6)
    texts = [de + fr, None, "", "12345 !!!", "€ € ™", fr]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = langid.identify(t, model, spans=True).orderBy("doc_id").collect()
    parts = [[(texts[r["doc_id"]][s["start"] : s["end"]], s["lang"]) for s in r["spans"]] for r in got]
    assert parts == [[(de.strip(), "de"), (fr.strip(), "fr")], [], [], [], [], [(fr.strip(), "fr")]]
    plain = langid.identify(t, model).orderBy("doc_id")
    assert plain.columns == ["doc_id", "held_out", "lang_pred", "score"] and [tuple(r) for r in plain.collect()] == [tuple(r)[:4] for r in got]
    assert [r["spans"] for r in langid.identify(t, langid.learn(iter([])), spans=True).collect()] == [[]] * 6


def brute_spans(t):
    """The base spans of a text by the patterns as the contract states them."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in re.sub("[^0-9]", "", m.group())][::-1]
        out += [(m.start(), m.end(), "card")] * (14 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 // 10 + x * 2 % 10 for x in d[1::2])) % 10 == 0)
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_pii_query_against_brute_force(spark):
    """base_sha256 of every document of the small table, and the counts as the spans say."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}
    for r in pii.find_personal_data(d, pii.train()).collect():
        base = brute_spans(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert r["n_spans"] == len(spans) == len(base) + r["n_added"] and all(r[f"n_{k}"] == sum(x[0] == k for x in spans) for k in pii.KINDS)
        assert spans == sorted(spans, key=lambda x: (int(x[1]), pii.KINDS.index(x[0])))


def test_pii_query_counts_base_spans(spark, tmp_path):
    """The query's counts are those of the base patterns, whatever the field adds."""
    texts = ["john.d[at]example[dot]com a.b@c.de", "see 10[.]0[.]0[.]7 10[.]0[.]0[.]8 ok 1.2.3.4", "call 555 123 4567", "pay 4111.1111.1111.1111 now", "+1 (386) 555-3733 4111111111111111 x", "é 999.1.1.1 +49 30 1234567", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) and sum(r["n_added"] for r in got) >= 6
    for r in got:
        base = brute_spans(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert r["n_spans"] == len([x for x in r["spans"].split(",") if x]) == len(base) + r["n_added"]


def test_field_on_values_it_has_not_seen():
    """Other fills of the table, word by word: what the base patterns don't find is added, and little else."""
    model = pii.train()
    rows = pii.labelled(99)
    right, wrong, missed = (dict.fromkeys(pii.KINDS, 0) for _ in range(3))
    for (w, labels), found in zip(rows, pii.find(model, pa.array([" ".join(w) for w, _ in rows]))):
        base = [x[:2] for x in found if x[3]]
        at = 0
        for x, label in zip(w, labels):
            mid = at + len(x) // 2
            at += len(x) + 1
            if any(s <= mid < e for s, e in base):
                continue
            said = next((k for s, e, k, _ in found if s <= mid < e), None)
            truth = pii.KINDS[label - 1] if label else None
            if truth and said == truth:
                right[truth] += 1
            elif truth:
                missed[truth] += 1
            if said and said != truth:
                wrong[said] += 1
    for k in pii.KINDS:
        assert right[k] > 80 and right[k] / (right[k] + missed[k]) > 0.9 and right[k] / (right[k] + wrong[k]) > 0.95, (k, right, wrong, missed)


@pytest.mark.parametrize(
    "text,want",
    [
        ("john.d[at]example[dot]com", ["email"]), ("see 10[.]0[.]0[.]7 10[.]0[.]0[.]8 ok", ["ip", "ip"]), ("reach a.b(at)example.com now", ["email"]), ("call 555 123 4567", ["phone"]), ("4111.1111.1111.1111", ["card"]),
        ("ISBN 978-3-16-148410-0", []), ("1,234 items on 2024-05-17 at 10:30 (at)", []), ("token = \"11acdfb36bb72224148e6160f674b4be45601bff\"", []), ("from 300[.]1[.]2[.]3", []), ("look (at) it. Dot com was", []), ("4111.1111.1111.1112", []),
    ],
)
def test_added_spans(text, want):
    found = pii.find(pii.train(), pa.array([f"é {text}", None, text]))
    assert [x[2] for x in found[2]] == want and [(s - 2, e - 2, k, b) for s, e, k, b in found[0]] == found[2] and not any(x[3] for x in found[2]) and found[1] == []


def test_pii(docs, none):
    model = pii.train()
    texts = ["a.b@c.d@e.f x@y", "999.1.1.1 1.2.3.4.5 8.8.8.8", "4111 1111 1111 1111 and 4111111111111112 1-2", "+1 (555) 555-1234 +1234 +1 555", "é +49 30 1234567 é a@b.co", "@.@..", "1" * 5000 + "." + "2" * 5000, "a" * 20000 + "@" + "b." * 3000 + "c", "+1 (386) 555-3733 4111111111111111 x"]
    found = pii.find(model, pa.array(texts))
    for t, f in zip(texts[:6] + texts[8:], found[:6] + found[8:]):
        assert [x[:3] for x in f if x[3]] == brute_spans(t)
    assert [(x[2], x[3]) for x in found[7]] == [("email", True)] and found[6] == []
    assert [x[2] for x in found[8] if not x[3]] == ["phone", "card"]  # the base patterns run the two together
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs, model).collect()}
    assert got[16]["n_email"] == got[16]["n_phone"] == 1 and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[6]["spans"] == ""
    assert pii.find_personal_data(none, model).count() == 0


def test_quality(spark, docs, none):
    d, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(d, labels)
    got = quality.score_texts(d, model).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got if r["held_out"]]) > 0.85 and all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    odd = quality.score_texts(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd) and quality.score_texts(none, model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    flat = quality.fit(d, labels.limit(0))
    assert len({r["score"] for r in quality.score_texts(docs, flat).collect()}) == 1


def test_without_a_bad_label_all_are_kept(spark, tmp_path):
    d, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    good = labels.where((F.col("quality") == 1) & ~quality.held_out()).limit(1)
    for few in (labels.limit(0), labels.where(quality.held_out()), labels.withColumn("quality", F.lit(None).cast("int")), good):
        assert quality.keep_good(d, quality.fit(d, few)).count() == d.count()
    bad = labels.where((F.col("quality") == 0) & ~quality.held_out()).limit(5)
    assert quality.keep_good(d, quality.fit(d, bad)).count() == 0
    for t in ("documents", "benchmark"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pairs_of_features_are_learnt():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.train(x, y)
    assert ((quality.score(m, x) > 0.5) == y).mean() > 0.9 and any({i, j} == {0, 1} for i, j, _ in m["pairs"])


def test_licenses(spark, docs, none):
    texts = [None, "", "Nothing here.", "Some words.\nLicensed under the Apache License, Version 2.0.\nMore.", "é Released under the  mit license. And Licensed under CC BY-NC 4.0.", "Licensed under the Apache Licence, Version 2.1.", "a licence to fish"]
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "start").collect()]
    assert [(r[0], r[1], r[-1]) for r in got] == [(3, "Apache-2.0", True), (4, "MIT", True), (4, "CC-BY-NC-4.0", True)]
    assert texts[4][got[1][2] : got[1][3]] == "Released under the  mit license."
    near = licenses.Scanner().scan("Released under terms of the MIT License now")
    assert [(n[0], n[4] > 0) for n in near] == [("MIT", True)] and licenses.scan(none).count() == 0 and licenses.scan(docs).count() == 0


@pytest.mark.parametrize("size", [1_000, 100_000, 1_000_000])
def test_license_in_a_long_line(size):
    """Every template, exact and with a word changed, in the middle of one long line."""
    rng = np.random.default_rng(size)
    stock = PROSE.split() * 40 + ["".join(rng.choice(list("etaoinshrdlucm"), n)) for n in rng.integers(2, 10, 3000)]
    prose = " ".join(rng.choice(stock, size // 12)) + " "
    for name, text in licenses.TEMPLATES if size < 1_000_000 else licenses.TEMPLATES[::5]:
        got = licenses.Scanner().scan(prose + text + " " + prose)
        assert [(r[0], r[1], r[2], r[4]) for r in got] == [(name, len(prose), len(prose) + len(text), 0)] and got[0][3] > 0
    changed = next(t for n, t in licenses.TEMPLATES if t.startswith("Permission is hereby")).replace("hereby granted", "herewith given")
    got = licenses.Scanner().scan(f"{prose}license {PROSE}{changed} {prose}")
    assert [(r[0], r[4], r[5]) for r in got] == [("MIT", 2, "hereby granted -> herewith given")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]), ("Licensed under CC BY 1.0.", []), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY-XY 4.0.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("This work is licensed under the GNU General Public License, version 4.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]), ("Licensed under the Apache License, Version 1.1.", []), ("Licensed under the XYZ License.", []),
        ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]), ("# SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"]), ("This project is licensed under the MIT license.", ["MIT"]), ("A mere license to fish, MIT or not", []),
    ],
)
def test_license_versions(text, want):
    assert [r[0] for r in licenses.Scanner().scan(text)] == want


def test_licenses_against_brute_force():
    """Every stretch against every template by a plain table of common subsequences; then the best first."""
    pick = tuple(t for t in licenses.TEMPLATES if len(t[1].split()) < 16 and "SPDX" not in t[1])[::3]
    scanner, rng, hits = licenses.Scanner(pick), np.random.default_rng(4), 0

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def brute(text):
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        own = [licenses._plain(text[s:e]) for s, e in spans]
        every = []
        for k, (name, template) in enumerate(pick):
            want = [licenses._plain(w) for w in template.split()]
            for s in range(len(own)):
                for e in range(s + 1, min(len(own), s + len(want) + 2 * (len(want) // 4)) + 1):
                    same = common(want, own[s:e])
                    if same >= math.ceil(0.8 * len(want)) and own[s] in want and same > common(want, own[s : e - 1]):
                        differ, how, ok = scanner._align(k, tuple(own[s:e]))
                        if ok:
                            every.append((differ - same, -scanner.saved(k, text[spans[s][0] : spans[e - 1][1]]), name, s, e, k, same, differ, how))
        out, taken = [], set()
        for _, saved, name, s, e, _, _, differ, how in sorted(every):
            if not taken & set(range(s, e)):
                taken |= set(range(s, e))
                out.append((name, spans[s][0], spans[e - 1][1], -saved, differ, how))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    for _ in range(25):
        parts = []
        for _ in range(3):
            w = pick[rng.integers(len(pick))][1].split()
            for _ in range(rng.integers(0, 3)):
                i = rng.integers(len(w))
                w[i : i + rng.integers(0, 2)] = [str(rng.choice(["the", "license", "4.0", "of"]))] * rng.integers(0, 2)
            parts += w + ["and", "license"]
        got = scanner.scan(" ".join(parts))
        assert got == brute(" ".join(parts))
        hits += len(got)
    assert hits > 30

def test_license_where_a_longer_run_is_elsewhere():
    got = licenses.Scanner().scan("Released under the moon without any fee at all, then came more words; and it was Released beneath the MIT License. All rights reserved. All rights reserved.")
    assert [(r[0], r[4]) for r in got] == [("MIT", 1), ("proprietary", 0), ("proprietary", 0)]


def test_wrapped_licenses(spark):
    """Every template at several widths, between lines without cues, reaches Python and is found whole."""
    rows, want = [], []
    for name, text in licenses.TEMPLATES:
        for width in (1, 20, 40, 60, 72, 79):
            wrapped = "\r\n".join(textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))
            want.append((len(rows), name, len("Some words.\n\n"), len("Some words.\n\n" + wrapped), True))
            rows.append((len(rows), f"Some words.\n\n{wrapped}\n\nMore words."))
    rows.append((len(rows), "/*\n * Permission\n * to use, copy, modify, and distribute this software for any purpose\n * with or without fee is hereby granted.\n */"))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["license"], r["start"], r["end"], r["exact"]) for r in got[:-1]] == want
    assert (got[-1]["doc_id"], got[-1]["license"], got[-1]["differing_words"]) == (len(want), "ISC", 3)
    text = "Licensed under the Apache License,\nVersion 2.0."
    assert [r[:3] for r in licenses.Scanner().scan(text)] == [("Apache-2.0", 0, len(text))]


def survivors(rows, bench):
    """The ids of (id, text) rows that near-duplicates and decontamination leave, by comparing all pairs; all ids differ."""
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w := words(t)) > 4 else frozenset([tuple(w)] if w else []) for i, t in rows.items()}
    root = {i: i for i in rows}
    for _ in range(4):
        for i in rows:
            for j in rows:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    kept = [i for i in rows if root[i] == i]
    plain = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))}
    items = [x for x in map(plain, bench) if x]
    clean = []
    for i in kept:
        w = plain(rows[i])
        own = {n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} for n in range(1, 6)}
        near = [x for x in items if grams(x) & own[min(5, len(x))]]
        if not any(sum(k[2] for k in brute_tiles(x, w, min(5, len(x)))) >= (math.ceil(0.6 * len(x)) if len(x) >= 5 else len(x)) for x in near):
            clean.append(i)
    return clean


def test_pipeline(spark):
    """run() against the classifier's own predictions, all pairs of texts, all pairs with items, and the SQL of mixing and sharding."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    d, labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r["doc_id"] for r in quality.score_texts(d, quality.fit(d, labels)).where("predicted = 1").collect()}
    left = survivors({r["doc_id"]: r["text"] for r in d.collect() if r["doc_id"] in good}, [r["text"] for r in bench.collect()])
    con = duckdb.connect()
    con.execute(f"create table kept as select * from read_parquet('{SMALL}/documents.parquet') where doc_id in ({', '.join(map(str, left))})")
    con.execute("create view documents as select * from kept")
    con.execute(f"create table mixed as select k.* from kept k join ({queries.MIXING_SQL}) m using (doc_id), range(2) r(i) where m.size > 0 and r.i < m.taken // m.size")
    con.execute("create or replace view documents as select * from mixed")
    ran = con.execute(queries.SHARDING_SQL)
    at = [x[0] for x in ran.description]
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, SMALL).select(*at).collect()) == sorted(map(str, ran.fetchall())) and 20 < len(left) < len(good)


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """documents with null, empty, long and repeated rows and extra columns that clash with our names; labels and benchmark with nulls and repeats."""
    at = tmp_path_factory.mktemp("odd")
    clash = ["__k", "__copies", "__rows", "k", "class", "size", "shard", "slot", "m", "component", "copies", "before", "total"]
    base = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    long = " ".join(f"wort{i}" for i in range(15_000))
    more = [(9000, None, None, None, None), (9001, "", "en", "", 0), (9002, " \n", None, "a", 1), (9003, long, "de", "b", 1), (9004, long + " ende", "de", None, 1), (None, long + " anders", None, None, None), (None, None, None, None, None), (9005, ITEM, "en", "a", 1), (9006, "x " + SWAPPED, "en", "a", 1), (9007, "one", "en", "a", 1)]
    rows = base.union(spark.createDataFrame(more + more[:3] + more[7:] + more[5:7], base.schema)).select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    rows.repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1, None), (9000, None, 0), (9003, 1, 0)], labels.schema)).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (None, ""), (9, "one")], "item_id long, text string").union(spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_pipeline_on_odd_rows(spark, odd_tables):
    docs = start = spark.read.parquet(f"{odd_tables}/documents.parquet").cache()
    key = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["text"] is None) for r in df.select("doc_id", "text").collect())
    scratch, seen = common.Scratch(spark), []
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, odd_tables))
        seen.append(docs)
    good, unique, clean, mixed, shards = seen
    assert all(x.columns == start.columns for x in seen[:4])
    model = quality.fit(start, spark.read.parquet(f"{odd_tables}/labels.parquet"))
    assert key(good) == sorted(k for k, s in zip(key(start), quality.score(model, quality.features(pa.array([None if k[2] else k[1] for k in key(start)], pa.string())))) if s >= 0.7)
    # null ids stand behind all others, which have one text each here
    rows = {(i if i >= 0 else 1 << 40, n): t for n, (i, t, _) in enumerate(sorted(set(key(unique)) | set(key(good))))}
    assert len(key(unique)) == len(set(key(unique))) + sum(n - 1 for n in ([key(good).count(k) for k in set(key(good)) if not words(k[1])]))
    left = survivors(rows, [r["text"] for r in spark.read.parquet(f"{odd_tables}/benchmark.parquet").collect()])
    assert {t for i, t, _ in key(clean) if words(t)} == {rows[i] for i in left if words(rows[i])}
    assert {k for k in key(clean) if not words(k[1])} == {k for k in key(good) if not words(k[1])}
    assert set(key(mixed)) <= set(key(clean)) and max(key(mixed).count(k) for k in key(mixed)) <= 2 * max(key(clean).count(k) for k in key(clean))
    assert shards.count() == mixed.count() == corpus_pipeline.run(spark, odd_tables).count()


@pytest.mark.parametrize("empty", [("documents",), ("labels",), ("benchmark",), ("documents", "labels", "benchmark")])
def test_pipeline_on_empty_tables(spark, odd_tables, tmp_path, empty):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{odd_tables}/{t}.parquet")
        (df.limit(0) if t in empty else df).write.parquet(f"{tmp_path}/{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and (got.count() > 0) == ("documents" not in empty)
