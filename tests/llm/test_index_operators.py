"""Sharding, ranked search and the manifest against brute force, and their odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import database, same, spark_rows, sql_rows
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tidewatch.llm import merkle, ranking, sharding

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", None, 0),
    (2, "", None, "a", 0),
    (3, "One TWO three", "en", "a", 13),
    (4, "one two THREE", "en", "b", 13),
    (4, "one two THREE", "en", "b", 13),
    (4, "Another text of the same id", "en", "b", None),
    (None, "one two three", None, None, 13),
    (None, "Two", None, None, 3),
    (-(2**63), "first of all ids", "de", "b", 3),
    (2**63 - 1, "LAST of all ids", "de", "b", 3),
    (6, "É é " * 30_000, "fr", "a", 80_000),
    (7, "?!", "de", "c", 2),
]
CLASHING = "1 AS size, 'x' AS shard, 3 AS score, 4 AS slot, 5 AS leaf, 6 AS tree, 7 AS rank, 8 AS position, 9 AS _jump, 'y' AS key"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *CLASHING.split(", "))


@pytest.mark.parametrize("name", ["op11_jump_shards", "op12_ranked_search", "op13_merkle_manifest"])
def test_queries_match_their_sql(spark, name):
    columns, rows = spark_rows(queries()[name](spark, FOLDER))
    expected_columns, expected = sql_rows(database(FOLDER), oracle_sql()[name])
    assert columns == expected_columns and len(rows) == len(expected) > 0
    assert all(all(map(same, row, want)) for row, want in zip(rows, expected))


# Sharding --------------------------------------------------------------------------------------


def jumped(key: int, shards: int) -> int:
    state, place, following = key % 2**64, -1, 0
    while following < shards:
        place = following
        state = (state * 2862933555777941757 + 1) % 2**64
        following = int((place + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return place


@pytest.mark.parametrize("shards, grown", [(1, 2), (16, 17), (7, 30), (39, 41), (300, 2_000)])
def test_shards_are_those_of_the_published_function(spark, shards, grown):
    rng = random.Random(shards)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.randrange(-(2**63), 2**63) for _ in range(150))]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = sharding.assign(frame, F.col("k"), shards, grown).collect()
    assert [(r.k, r.shard, r.grown_shard) for r in rows] == [(k, jumped(k, shards), jumped(k, grown)) for k in keys]


def test_a_new_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(40_000)
    moved = sharding.moving(keys, F.col("id"), 16, 17)
    assert moved.where("grown_shard <> 16").count() == 0
    assert abs(moved.count() - 40_000 / 17) < 5 * math.sqrt(40_000 / 17)
    sizes = [r["count"] for r in sharding.assign(keys, F.col("id"), 16).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(abs(n - 2_500) for n in sizes) < 300


def test_slots_have_no_gap_whatever_the_rows(spark, odd):
    table = sharding.shard_table(sharding.measured(odd))
    rows = table.collect()
    assert len(rows) == len(ODD)
    for shard in {r.shard for r in rows}:
        found = sorted(r.slot for r in rows if r.shard == shard)
        assert found == list(range(len(found)))
    for r in rows:
        assert (r.shard, r.grown_shard) == (jumped(r.doc_id or 0, 16), jumped(r.doc_id or 0, 17))
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in ODD
    )
    assert sharding.shard_table(sharding.measured(odd.where("false"))).count() == 0


def test_slots_of_many_pieces_and_a_third_of_equal_rows(spark):
    rows = spark.range(3_000).selectExpr("if(id % 3 = 0, 5, id) AS doc_id", "if(id % 3 = 0, 0, id) AS text_crc32")
    placed = sharding.assign(rows, F.col("doc_id"), 4)
    for spread in (["doc_id", "text_crc32"], None):
        numbered = sharding.slots(placed, spread, per_piece=50).persist()
        ends = numbered.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("d"))
        assert all(r.n == r.last + 1 == r.d for r in ends.collect()) and numbered.count() == 3_000


def test_written_shards_and_those_appended(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(300)], SCHEMA).withColumn("more", F.lit(1))
    sharding.write_shards(docs, str(tmp_path / "a"), 4, rows_per_file=20)
    stored = spark.read.parquet(str(tmp_path / "a"))
    assert {(r.doc_id, r.shard) for r in stored.collect()} == {(i, jumped(i, 4)) for i in range(300)}
    sharding.append_shards(spark, str(tmp_path / "a"), str(tmp_path / "b"), 4, 6)
    added = spark.read.parquet(str(tmp_path / "b")).collect()
    assert {(r.doc_id, r.shard) for r in added} == {(i, jumped(i, 6)) for i in range(300) if jumped(i, 6) > 3}


# Ranked search ---------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found_terms(text: str | None) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, top=10):
    """``(item_id, rank, doc_id, score)`` by scoring every pair."""
    counted = [(d, Counter(found_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, every = len(counted), sum(sum(c.values()) for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        wanted, scores = Counter(found_terms(text)), []
        for doc, c in counted:
            m = 25 + (75 * sum(c.values()) * n) // every
            score = 0
            for t, q in wanted.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1)))
                    score += q * w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top])]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms_are_the_maximal_matches():
    text = "Straße É-7 \x85x\xa0y ẞ a_b[c]  z\x00q Á"
    assert [t.decode() for t in ranking.terms(text.encode())] == found_terms(text)


@pytest.mark.parametrize("params", [ranking.RankParams(), ranking.RankParams(top=3, block_terms=9, cells=256, leaf=2, fan=2, features=3)])
def test_rankings_are_those_of_all_pairs(spark, params):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(40)], k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(300)]
    docs += [(400 + i, docs[7][1].upper()) for i in range(30)] + [(3, docs[3][1]), (None, docs[5][1]), (900, None), (901, "!")]
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(20, None), (21, "?"), (22, "absent words"), (23, docs[7][1])]
    items.append(items[2])
    frame = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], SCHEMA).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(ranking.rank(frame, asked, params)) == ranked(docs, items, params.top)


def test_pruned_pairs_are_no_candidates():
    """Rankings with every batch opened equal those of the search, which opens a part of them."""
    rng = np.random.default_rng(3)
    params = ranking.RankParams(top=5, leaf=8, fan=4)
    weights = rng.integers(100, 9_000, 60)
    dense = np.where(rng.random((500, 60)) < 0.1, rng.integers(1, 10**6, (500, 60)), 0)
    row, place = np.nonzero(dense)
    ids = np.column_stack([np.zeros(500, np.int64), np.arange(500)])
    docs = ranking.Documents(ids, np.cumsum(np.bincount(row, minlength=500)), place, dense[row, place], weights, params)
    items = [np.sort(rng.choice(60, 5, replace=False)) for _ in range(20)]
    tree = ranking.item_tree([(t, weights[t].astype(float)) for t in items], params)
    best, opened = ranking.Rankings(20, 5, np.zeros(20, np.int64)), []
    bounds = docs.bounds
    docs.bounds = lambda level, nodes, of: opened.append(len(nodes) if level == 0 else 0) or bounds(level, nodes, of)
    ranking.search(tree, docs, best)
    for i, t in enumerate(items):
        scores = dense[:, t] @ weights[t]
        order = np.lexsort((np.arange(500), -scores))[:5]
        assert best.best[i][:, [0, 2]].tolist() == [[scores[d], d] for d in order if scores[d] > 0]
    assert sum(opened) < 20 * 500 / 2


def test_ranking_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "one TWO"), (2, None)], "item_id long, text string").withColumn("rank", F.lit(0))
    docs = [(r[0], r[1]) for r in ODD]
    assert rows_of(ranking.rank(odd, items)) == ranked(docs, [(1, "one TWO"), (2, None)])
    assert rows_of(ranking.rank(odd.where("false"), items)) == rows_of(ranking.rank(odd, items.where("false"))) == []


def test_scores_beyond_doubles_are_added_as_whole_numbers(spark, monkeypatch):
    docs = [(i, f"alpha beta{i % 3} " * (i % 5 + 1) + f"gamma{i}") for i in range(40)]
    items = [(1, "beta1 gamma4 " * 3_000)]
    frame = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], SCHEMA)
    monkeypatch.setattr(ranking, "_EXACT", 1)
    assert rows_of(ranking.rank(frame, spark.createDataFrame(items, "item_id long, text string"))) == ranked(docs, items)


# Manifest --------------------------------------------------------------------------------------


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(doc_id, text, lang, source, n_chars) -> str:
    return hashed("".join(map(field, (doc_id, source, lang, n_chars, text))))


def levels_of(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hashed("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for nodes in levels[:-1]:
        first = i - i % 8
        out.append((nodes[first:i], nodes[i + 1 : first + 8]))
        i //= 8
    return out


def manifest_of(rows):
    """Rows of the query, tree by tree."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    trees = {}
    for lang, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[lang] = levels_of([leaf_of(*r) for r in members])
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    over = levels_of([trees[lang][-1][0] for lang in order])
    root, out = over[-1][0], []
    for i, lang in enumerate(order):
        for j, (doc_id, text, _, source, n_chars) in enumerate(groups[lang]):
            path = path_of(trees[lang], j) + path_of(over, i)
            leaf = folded = leaf_of(doc_id, text, lang, source, n_chars)
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                folded = leaf_of(doc_id, re.sub("[A-Z]", lambda m: m.group().lower(), text), lang, source, n_chars)
            for left, right in path:
                folded = hashed("".join([*left, folded, *right]))
            proof = hashed("".join(h for left, right in path for h in [*left, *right]))
            out.append((doc_id, leaf, trees[lang][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


def proved(frame):
    rows = merkle.leaves(frame, tampered=merkle.tampered_rows())
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, merkle.proofs(*merkle.manifest(rows)).select(*columns).collect()), key=repr)


def test_manifest_of_odd_rows(spark, odd):
    """Null and repeated ids, the ends of the range, null languages, equal rows, names the operator uses itself."""
    assert proved(odd) == manifest_of(ODD)
    assert proved(odd.where("false")) == []
    one = odd.where("doc_id = 3")
    assert proved(one) == manifest_of([ODD[2]])


def test_manifest_of_several_rounds_and_a_hot_id(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(-(10**12), 10**12), f"Text {i}", "en", "s", i) for i in range(1_300)]
    rows += [(77, f"Text {i % 400}", "en", "s", 1) for i in range(600)]
    rows += [(None, f"Text {i}", None, "s", 1) for i in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert proved(frame) == manifest_of(rows)


def test_manifest_of_many_languages(spark):
    rows = [(i, f"Text {i}", f"l{i % 600}" if i % 600 else None, "s", 1) for i in range(700)]
    assert proved(spark.createDataFrame(rows, SCHEMA)) == manifest_of(rows)


def test_ranks_come_from_bits_and_directories(spark):
    rng = random.Random(1)
    keys = sorted({rng.randrange(-(2**63), 2**63) >> rng.choice([0, 20, 40, 52]) for _ in range(800)})
    counted = spark.createDataFrame([("t", k, 1) for k in keys], "tree string, key long, n long")
    words = merkle.bitmap(counted)
    found = {r.key: r.position for r in merkle.ranks(counted.select("tree", "key"), words).collect()}
    assert found == {k: i for i, k in enumerate(keys)}
    # No list of repeats, and fewer words than ids where ids are close.
    assert words.where("size(repeats) > 0").count() == 0 and words.count() < len(keys)
