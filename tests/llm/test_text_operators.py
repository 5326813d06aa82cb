"""Operators on documents against brute force, and their odd inputs."""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import math
import random
import re
import threading
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import components, decontaminate, exact_dedup, lang_id, licenses, lm, mixing, near_dup, words
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.tables import table

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, "en", None, 0),
    (2, "", None, "a", 0),
    (3, "One TWO three", "en", "a", 13),
    (4, "one two THREE", "en", "b", 13),
    (4, "one two THREE", "en", "b", 13),
    (None, "one two three", None, None, 13),
    (5, " \t\n", "en", "b", 3),
    (6, "É é " * 20_000, "fr", "a", 80_000),
    (7, "?!", "de", "c", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "1 AS size, 2 AS kept, 3 AS score, 4 AS _row, 5 AS node, 6 AS digest, 7 AS lang_pred, 8 AS start"


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *CLASHING.split(", "))


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, FOLDER, "documents").collect()


# Words -----------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabABé中\x0b\x1c,.", max_size=40)), max_size=8))
def test_words_are_the_same_exactly_when_their_hashes_are(texts):
    hashes, offsets = words.word_hashes(pa.array(texts, pa.string()))
    expected = [WORD.findall(low(t)) for t in texts]
    assert list(np.diff(offsets)) == [len(w) for w in expected]
    known: dict = {}
    for word, code in zip(itertools.chain(*expected), hashes.tolist()):
        assert known.setdefault(word, code) == code
    assert len(set(known.values())) == len(known)


def test_blocks_do_not_show(monkeypatch):
    texts = pa.array(["ab cd " * 50, None, "x" * 300, "", "y z", "q"])
    whole = words.word_hashes(texts)
    monkeypatch.setattr(words, "BLOCK_BYTES", 16)
    parts = words.word_hashes(texts)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5)] + [(i, i + 1) for i in range(20, 60)], "a long, b long")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6} | {i: 20 for i in range(20, 61)}
    assert components.components(edges.where("false")).count() == 0


# Exact duplicates ------------------------------------------------------------------------------


def test_exact_duplicates(spark, odd):
    rows = exact_dedup.exact_duplicates(odd, keep="largest", runs=8, fan_in=3).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.text_sha256): r for r in rows}
    sha = hashlib.sha256(b"one two three").hexdigest()
    assert {r.keep_id for r in rows if r.text_sha256 == sha} == {4}
    assert by[(4, sha)].kept and by[(4, sha)].group_size == 4 and not by[(None, sha)].kept and not by[(3, sha)].kept
    empty = hashlib.sha256(b"").hexdigest()
    assert by[(2, empty)].kept and not by[(1, empty)].kept
    assert exact_dedup.exact_duplicates(odd, runs=8, fan_in=3).where("kept").count() == 5
    assert exact_dedup.exact_duplicates(odd.where("false")).count() == 0


def test_exact_dedup_keeps_one_row_per_text(spark, odd):
    kept = exact_dedup.deduplicate(odd, keep="largest")
    assert kept.columns == odd.columns
    assert sorted((r.doc_id, low(r.text)) for r in kept.collect()) == sorted(
        {2: "", 4: "one two three", 5: " \t\n", 6: low("É é " * 20_000), 7: "?!"}.items()
    )


def test_exact_dedup_keeps_columns_that_clash(spark, odd):
    clashing = odd.selectExpr("*", "doc_id AS _sha", "'x' AS __id", "1 AS _copies", "2 AS _last", "3 AS keep_id", "4 AS run")
    kept = exact_dedup.deduplicate(clashing)
    assert kept.columns == clashing.columns
    assert {r.doc_id: r._sha for r in kept.collect()} == {1: 1, 3: 3, 5: 5, 6: 6, 7: 7}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_runs_are_merged_in_order(spark, keep):
    rows = [(i if i % 11 else None, f"text {i % 37 if i % 3 else 0}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    entries = exact_dedup.digest_entries(docs, 64)
    levels = exact_dedup.merge_tree(entries, keep, 64, 4)
    assert [level.select("run").distinct().count() for level in levels][1:] == [16, 4, 1]
    best = {}
    for i, text in rows:
        if i is not None:
            best[text] = (max if keep == "largest" else min)(best.get(text, i), i)
    for level in levels:
        # Every written run is sorted and has an entry once; no row is lost on the way.
        parts = level.select(F.input_file_name().alias("file"), "run", "digest", "group_size").collect()
        for _, part in itertools.groupby(parts, key=lambda r: r.file):
            keys = [(r.run, bytes(r.digest)) for r in part]
            assert keys == sorted(set(keys))
        assert sum(r.group_size for r in parts) == len(rows)
    top = {r.digest.hex(): r.keep_id for r in levels[-1].collect()}
    assert top == {hashlib.sha256(t.encode()).hexdigest(): i for t, i in best.items()}
    # The order of a merge is needed by what follows, so no rule takes the sort away.
    assert "Sort [run" in exact_dedup.merged(levels[0], keep)._jdf.queryExecution().executedPlan().toString()


# Near duplicates -------------------------------------------------------------------------------


def shingles(text: str | None) -> set:
    w = WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows: list[tuple], percent: int) -> dict:
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: find(d) for d in sets}


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    bases = [[f"w{rng.integers(4000)}" for _ in range(n)] for n in (3, 12, 40, 120, 120, 400)]
    rows = []
    for base in bases:
        for _ in range(25):
            text = list(base)
            for _ in range(rng.integers(0, max(2, len(base) // 25))):
                text[rng.integers(len(text))] = f"x{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        found = near_dup.near_duplicates(frame, near_dup.NearParams(percent)).collect()
        assert {r.doc_id: r.component_id for r in found} == brute_components(rows, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_odd_rows(odd):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    ids = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert ids[1] == (0, 1, True) and ids[2] == (0, 2, True) and ids[5] == (0, 5, True)
    assert ids[3] == (1, 3, True) and ids[4] == (1, 3, False) and ids[None] == (1, 3, False)
    assert near_dup.deduplicate(odd.where("false")).count() == 0
    assert {r.doc_id for r in near_dup.deduplicate(odd).collect()} == {1, 2, 3, None, 5, 6, 7}


def test_pairs_just_below_the_threshold_meet_once(spark):
    """Many texts near one base and not linked to each other: rounds of many hubs, and batches that cut keys."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(240):
        text = list(base)
        for at in rng.choice(len(text), 1 + d % 9, replace=False):
            text[at] = f"x{rng.integers(10**6)}"
        rows.append((d, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    params = near_dup.NearParams(85)
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame, params).collect()}
    assert found == brute_components(rows, 85)
    made = near_dup.signatures(frame, params).withColumnRenamed("doc_id", "node")
    keys = near_dup.chunk_keys(made, params).toPandas()
    signed = {r.node: np.array(r.signature, np.int64).view(np.uint64) for r in made.collect()}
    both = keys.merge(keys, on="key").query("node_x < node_y")
    x, y = (np.stack([signed[n] for n in both[c]]) for c in ("node_x", "node_y"))
    first = both[near_dup._in_first_key(x, y, both["key"].to_numpy(), params)]
    assert len(first) == len(both[["node_x", "node_y"]].drop_duplicates()) == len(first[["node_x", "node_y"]].drop_duplicates())


def test_errors_allowed_in_a_chunk_cover_the_distance():
    for percent in (80, 85, 90):
        p = near_dup.NearParams(percent)
        assert sorted(i for c in p.chunks for i in c) == list(range(p.positions))
        assert p.distance < 2 * len(p.chunks)  # else every chunk could have two errors


# Decontamination -------------------------------------------------------------------------------

ITEM = "A train leaves the old station at 9 and runs 60 km before it meets Anna who waits near platform 9 with lunch"


@pytest.mark.parametrize(
    "text, hit, verbatim",
    [
        (f"Some words first. {ITEM} and more after it", True, True),
        (f"Some words first. {ITEM.replace('9', '14').replace('60', '75').replace('Anna', 'Maria')} and more", True, False),
        # The same slot twice, with two values: not the same question.
        (f"Words. {ITEM.replace('at 9', 'at 3').replace('60', '75')} and more", False, None),
        ("A train leaves the old station at 9 but nothing else here is of the question at all, so it stays", False, None),
        (None, False, None),
        ("", False, None),
    ],
)
def test_reparameterised_questions(spark, text, hit, verbatim):
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, start int")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "")], "item_id long, text string")
    rows = decontaminate.leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.verbatim) for r in rows] == ([(1, 7, verbatim)] if hit else [])
    assert decontaminate.decontaminate(docs, items).count() == (0 if hit else 1)


LONG = " ".join(f"{a}{b}" for a in "kalo mire sunt dova peli rano tiku vesa".split() for b in "abcdefghijklmnopqrstuvwxy")


LONG_TAIL = "walks past the old mill and the wide river until the road ends near a small white house"


@pytest.mark.parametrize(
    "item, text",
    [
        (ITEM, f"Before it. {ITEM.replace('before it', 'before then it')} and more after"),  # one token put in
        (ITEM, f"Before it. {ITEM.replace('before it', 'it')} and more after"),  # one left out
        (LONG, f"Before it. {' '.join(LONG.split()[70:120])} and more after"),  # 50 words of 200
    ],
)
def test_leaks_with_shifts_and_passages(spark, item, text):
    docs = spark.createDataFrame([(1, text), (2, " ".join(LONG.split()[70:90]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()] == [(1, 7)]


QUESTION = (
    "{a} has {n} apples in the basket. {a} buys {m} more apples at the market. {b} gives {k} apples to a friend"
    " and keeps the rest for lunch. How many apples do the two of them have now?"
)


@pytest.mark.parametrize(
    "item, text, hit",
    [
        (QUESTION.format(a="Tom", b="Mia", n=5, m=3, k=2), QUESTION.format(a="Sara", b="Liam", n=8, m=14, k=6), True),
        (QUESTION.format(a="Tom", b="Mia", n=5, m=3, k=2), QUESTION.format(a="Sara", b="Liam", n="eight", m="four", k="six"), True),
        # One name of the item is two in the document.
        (QUESTION.format(a="Tom", b="Tom", n=5, m=3, k=2), QUESTION.format(a="Sara", b="Liam", n=5, m=3, k=2), False),
        # Two values of the item become one.
        (ITEM.replace("platform 9", "platform 70"), ITEM.replace("at 9", "at 60").replace("platform 9", "platform 60"), True),
        # The name stands inside a sentence in the document only.
        (f"Tom {LONG_TAIL}", f"In spring Sara {LONG_TAIL}", True),
    ],
)
def test_names_at_the_start_of_sentences_and_values_that_coincide(spark, item, text, hit):
    docs = spark.createDataFrame([(1, f"Some words first. {text} And more after it."), (2, "Tom has a basket. Mia has none.")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()] == ([(1, 7)] if hit else [])


def test_questions_with_values_drawn_anew(spark):
    """Every name and number replaced at random: each question is found, and only with its own item."""
    draw = random.Random(4)
    names = "Tom Mia Sara Liam Olga Ravi Ines Noah Yuki Omar".split()
    texts, forms = [], []
    for i in range(12):
        nouns = ["".join(draw.choice("bdfgklmnprstv") + draw.choice("aeiou") for _ in range(3)) for _ in range(14)]
        forms.append(
            "{a} counts {n} " + " ".join(nouns[:5]) + ". {b} counts {m} " + " ".join(nouns[5:10]) + " with {a}. {a} then has {k} "
            + " ".join(nouns[10:])
        )
    fill = lambda f: f.format(**dict(zip("ab", draw.sample(names, 2))), **{k: draw.randint(2, 999) for k in "nmk"})
    items = spark.createDataFrame([(i, fill(f)) for i, f in enumerate(forms)], "item_id long, text string")
    texts = [(100 * i + j, f"Here it is. {fill(f)} and so on.") for i, f in enumerate(forms) for j in range(5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(d, d // 100) for d, _ in texts}


def test_very_short_items_drop_no_document(spark):
    docs = spark.createDataFrame([(1, "The answer is yes and then it ends"), (2, "no")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "yes"), (8, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_tokens) for r in decontaminate.leaks(docs, items).collect()] == [(1, 1)]
    assert decontaminate.decontaminate(docs, items).count() == 2


def test_leaks_of_short_items_and_of_items_poor_in_words(spark):
    numbers = "12 kg 7 m 3 cm 45 s 9 km 61 g 5 ml 8 mm 2 km 77 percent"
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, numbers)], "item_id long, text string")
    around = "Many words stand here before it, {} and many more words stand here after it"
    docs = spark.createDataFrame(
        [
            (1, around.format("what is the capital of France?")),
            (2, around.format(numbers)),
            (3, around.format(numbers.replace("7", "4").replace("2", "6").replace("5", "1"))),
            (4, around.format("what is the price of bread?")),
        ],
        "doc_id long, text string",
    )
    assert {(r.doc_id, r.item_id, r.covered) for r in decontaminate.leaks(docs, items).collect()} == {(1, 1, 1.0), (2, 2, 1.0)}


def test_leaks_against_a_search(spark, documents):
    items = {r.item_id: r.text for r in table(spark, FOLDER, "benchmark").collect()}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    expected = {(d.doc_id, i) for d in documents for i, t in items.items() if plain(t) in plain(d.text)}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op5_benchmark_leaks"](spark, FOLDER).collect()}
    assert found == expected


def test_leaks_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(odd, items).collect()} == {3, 4}
    assert decontaminate.leaks(odd, items.where("false")).count() == 0
    assert decontaminate.decontaminate(odd, items).columns == odd.columns


# Licenses --------------------------------------------------------------------------------------


def brute_license(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hits = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return (len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits})))


def test_license_scan(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op7_license_scan"](spark, FOLDER).collect()}
    assert len(found) == len(documents)
    for d in documents:
        r = found[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_wordings_with_changes(spark, odd):
    mit = dict(licenses.WORDINGS)["mit"].split()
    cut = " ".join(mit[:20] + ["indeed"] + mit[22:])
    texts = [cut, " ".join(mit[:12]), "Under the MIT license, under the MIT license; CC-BY-NC", "mit license"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert [found[i].labels for i in range(4)] == ["mit", "", "cc-by-nc,mit", ""]
    assert (found[2].n_base, found[2].first_word, found[2].last_word) == (3, 0, 8)
    assert sorted(r.n_words for r in licenses.scan(odd).collect()) == sorted(brute_license(r[1])[0] for r in ODD)
    assert licenses.scan(odd.where("false")).count() == 0


# Mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes: list[int], weights: list[float], share: float, most: int) -> list[float]:
    targets, total, open_ = [0.0] * len(sizes), sum(sizes) * share, set(range(len(sizes)))
    while open_:
        rest = total - sum(targets[i] for i in range(len(sizes)) if i not in open_)
        level = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > most * sizes[i]}
        for i in full or open_:
            targets[i] = float(most * sizes[i]) if full else level * weights[i]
        open_ -= full or open_
    return targets


def test_mix(spark, documents):
    rows = QUERIES["op8_mix_sources"](spark, FOLDER).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op8_mix_sources"](spark, FOLDER).collect()))
    source = {d.doc_id: d.source for d in documents}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(WORD.findall(next(d.text for d in documents if d.doc_id == r.doc_id) or ""))
        assert 0 <= r.taken <= 2 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    names = sorted(sizes)
    expected = brute_targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    assert [target[s] for s in names] == pytest.approx(expected)
    assert all(abs(taken[s] - target[s]) <= 32 for s in names)


@pytest.mark.parametrize("many", [1, 2, 3, 97, 1000, 1024, 4095, 32768])
def test_permuted_numbers_are_a_bijection(spark, many):
    rows = spark.range(many).selectExpr(f"{mixing.permuted('id', f'{many}L', mixing.block_step(f'{many}L'), '5L')} AS p").collect()
    assert sorted(r.p for r in rows) == list(range(many))
    if many > 50:
        assert all(abs(a.p - b.p) > many / 5 for a, b in itertools.pairwise(rows))


@pytest.mark.parametrize("block, blocks", [(32, 1 << 14), (8, 1 << 14), (8, 300)])
def test_blocks_are_disjoint_and_permuted(spark, documents, block, blocks):
    """Every taken word against a mix drawn block by block from the written order of each source."""
    params = mixing.MixParams(block=block, blocks=blocks)
    frame = mixing.measured(table(spark, FOLDER, "documents"), ["doc_id"])
    rows = mixing.mix(frame.withColumn("source", F.col("_source")), params).collect()
    order = {r.doc_id: r.o for r in frame.select("doc_id", F.xxhash64(F.lit(params.seed), "_id").alias("o")).collect()}
    size = max(block, math.ceil(sum(r.size for r in rows) / blocks))
    per_shard = Counter()
    for name in {r.source for r in rows}:
        own = sorted((r for r in rows if r.source == name), key=lambda r: (order[r.doc_id] % mixing.BUCKETS, order[r.doc_id]))
        held, at = {}, 0  # the shard of every taken word of the repeated stream
        for r in own:
            for p in r.pieces:
                lo = p.copy * own[0].source_size + at + p.start
                for word in range(lo, lo + p.words):
                    assert word not in held
                    held[word] = p.shard
            assert r.taken == sum(p.words for p in r.pieces)
            at += r.size
        # Whole blocks, each in one shard; as many as the quota.
        of_block = {}
        for word, shard in held.items():
            of_block.setdefault(word // size, []).append(shard)
        assert all(len(x) == size and len(set(x)) == 1 for x in of_block.values())
        assert len(of_block) == min(round(own[0].target / size), own[0].source_size * 2 // size)
        for shards in of_block.values():
            per_shard[shards[0]] += 1
        follow = [b for b in of_block if b + 1 in of_block and of_block[b][0] == of_block[b + 1][0]]
        assert len(of_block) < 50 or len(follow) < len(of_block) / 3
    assert max(per_shard.values()) - min(per_shard.values()) <= params.levels


def test_splitting_tree_deals_quotas_exactly_and_like_a_draw(spark):
    quotas = [0, 1, 7, 400, 3000]
    frame = spark.createDataFrame(list(enumerate(quotas, 1)), "place int, quota long")
    counts = []
    for seed in range(20):
        dealt = mixing.split_quotas(frame, mixing.MixParams(levels=1, seed=seed)).collect()
        by = {(r.shard, r.place): r.blocks for r in dealt}
        assert all(by[(0, p)] + by[(1, p)] == q for p, q in enumerate(quotas, 1))
        assert sum(by[(0, p)] for p in range(1, 6)) == sum(quotas) // 2
        counts.append(by[(0, 4)])
    total, good = sum(quotas), 400
    deviation = math.sqrt(good / 2 * (1 - good / total) / 2)
    assert abs(np.mean(counts) - good / 2) < 4 * deviation / math.sqrt(20) and 0.4 * deviation < np.std(counts) < 2 * deviation


def test_mixed_rows(spark, odd):
    mixed = mixing.mixed_rows(odd).collect()
    assert all(0 <= r.shard < 16 and r.copy in (0, 1) and r.text for r in mixed)
    assert mixing.mixed_rows(odd.where("false")).count() == 0
    taken = mixing.mix(mixing.measured(odd.drop("size"), ["doc_id"])).collect()
    assert len(taken) == len(ODD)
    assert sum(len(WORD.findall(r.text)) for r in mixed) == sum(r.taken for r in taken)


# Language model and language identification ----------------------------------------------------


def test_lm_base_scores_with_rare_tokens(spark, documents):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    train = docs.where("doc_id % 3 <> 0").union(spark.createDataFrame([(-1, None)], "doc_id long, text string"))
    model, counts = lm.fit(train, lm.LmParams(min_share=5e-4, common_share=1e-4))
    found = {r.doc_id: r for r in lm.score(docs, model, counts).collect()}
    c: Counter = Counter(["\n"])
    for d in documents:
        if d.doc_id % 3:
            c.update([*WORD.findall(low(d.text)), "\n"])
    n, v = sum(c.values()), len(c)
    assert (model.total, model.vocabulary) == (n, v) and len(model.tokens) < v and model.arcs
    for d in documents:
        tokens = [*WORD.findall(low(d.text)), "\n"]
        r = found[d.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)


def brute_scores(train: list[str], texts: list[str], least: int, discount: float) -> list[float]:
    """Backoff scores with all n-grams up to three tokens in dictionaries."""
    split = lambda t: [*WORD.findall(low(t)), "\n"]
    c = Counter(tuple(s[i : i + k]) for s in map(split, train) for k in (1, 2, 3) for i in range(len(s) - k + 1))
    kept = {g: n for g, n in c.items() if len(g) > 1 and n >= least}
    total, words = sum(n for g, n in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    after: dict = {}
    for g in kept:
        after.setdefault(g[:-1], []).append(g)
    prob = lambda g: (kept[g] - discount) / c[g[:-1]] if g in kept else (c[g] + 1) / (total + words + 1)
    back = {h: math.log10((1 - sum(map(prob, gs))) / (1 - sum(prob(g[1:]) for g in gs))) for h, gs in after.items()}

    def weight(g: tuple) -> float:
        return math.log10(prob(g)) if g in kept or len(g) == 1 else back.get(g[:-1], 0.0) + weight(g[1:])

    return [sum(weight(tuple(s[max(0, i - 2) : i + 1])) for i in range(len(s))) for s in map(split, texts)]


@pytest.mark.parametrize("share", [1e-2, 1e-4, 0.0])
def test_lm_keeps_rare_ngrams_of_large_training_data(spark, share):
    """An n-gram of two places counts however many tokens there are, and whatever part is broadcast."""
    common = "the cat sat on the mat and " * 3000
    train = [common, "rare words stand here", "and rare words stand there", "one two", None]
    texts = ["rare words stand", "the cat sat on rare words", "new rare mat", "", *train[1:4], "stand here the cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, table_ = lm.fit(spark.createDataFrame([(t,) for t in train], "text string"), lm.LmParams(min_share=share, common_share=share))
    found = {r.doc_id: r.score for r in lm.score(docs, model, table_).collect()}
    expected = brute_scores([t or "" for t in train], texts, 2, 0.75)
    assert [found[i] for i in range(len(texts))] == pytest.approx(expected, rel=1e-9, abs=1e-9)


def test_lm_beats_its_base_on_held_out_texts(spark):
    rows = QUERIES["op9_lm_scores"](spark, FOLDER.replace("0.001", "0.01")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows)


def test_automaton_is_a_backoff_model(spark):
    text = "a b c a b d a b c e f " * 40
    docs = spark.createDataFrame([(1, text), (2, "a b zz c"), (3, None)], "doc_id long, text string")
    model, counts = lm.fit(docs.where("doc_id = 1"), lm.LmParams(min_share=1e-3, common_share=1e-3))
    number = {w: int(model.number(words.word_hashes(pa.array([w]))[0])[0]) for w in "abcdef"}
    weights = model.unigram(model.counts).tolist()
    # After any context the probabilities of all tokens, and of an unseen one, add up to one.
    unseen = 1 / (model.total + model.vocabulary + 1)
    for context in ([], ["a"], ["a", "b"], ["e"], ["c", "a"]):
        start = [number[w] for w in context]
        base = model.traverse(start, weights)
        after = [10 ** (model.traverse([*start, t], weights) - base) for t in range(len(model.tokens))]
        rest = 10 ** (model.traverse([*start, -1], weights) - base) * unseen
        assert sum(after) + rest == pytest.approx(1.0, abs=1e-6)
    rows = {r.doc_id: r for r in lm.score(docs, model, counts).collect()}
    assert rows[3].n_tokens == 1 and rows[2].n_known == 4 and rows[2].score < 0


def test_lm_of_nothing(spark, odd):
    docs = odd.select("doc_id", "text")
    model, counts = lm.fit(docs.where("false"))
    assert all(r.score == 0 and r.n_known == 0 for r in lm.score(docs, model, counts).collect())


def test_lm_shuffles_a_few_bytes_a_token(spark):
    """A row of each n-gram with its parts, and of each n-gram of a text, made 53 bytes a token; packed questions make 12."""
    folder = FOLDER.replace("0.001", "0.01")
    seen, ended = {}, threading.Event()
    roots = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def look():
        for path in itertools.chain.from_iterable(Path(r).rglob("shuffle_*.data") for r in roots):
            with contextlib.suppress(OSError):
                seen[path.name] = max(seen.get(path.name, 0), path.stat().st_size)

    def watch():  # Spark removes the files of a query at its end
        while not ended.wait(0.02):
            look()

    look()
    before = dict(seen)
    watching = threading.Thread(target=watch)
    watching.start()
    rows = QUERIES["op9_lm_scores"](spark, folder).agg(F.sum("n_tokens"), F.sum("score")).first()
    ended.set()
    watching.join()
    assert sum(n for name, n in seen.items() if name not in before) < 30 * rows[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**64 - 1)), max_size=50), max_size=4))
def test_packed_arrays(arrays):
    arrays = [np.array(a, np.uint64) for a in arrays]
    assert [a.tolist() for a in lm.unpack(lm.pack(arrays))] == [a.tolist() for a in arrays]


@pytest.mark.parametrize("spread", [[1], [1, 7, 5, 3, 2]])
def test_every_ngram_is_asked_for_once(spread):
    rng = np.random.default_rng(5)
    codes = np.array([0, *range(1, 40), 1 << 40, (1 << 64) - 1], np.uint64)
    sizes = rng.integers(1, 60, 80)
    ids = np.minimum(rng.geometric(0.15, sizes.sum()), len(codes) - 1)
    ids[np.cumsum(sizes) - 1] = 0
    chunk = lm.Chunk.read(lm.Chunk(codes, ids, sizes, np.ones(80, bool)).packed())
    places = [tuple(codes[i] for i in row) for row in np.split(ids, np.cumsum(sizes)[:-1])]
    slots_of: dict = {}
    for size, grams in enumerate(chunk.grams(3), 1):
        expected = Counter(row[i : i + size] for row in places for i in range(len(row) - size + 1))
        many = np.bincount(grams.number, minlength=len(grams.columns[0]))
        found: Counter = Counter()
        for slot, numbers in enumerate(grams.dealt(11, np.array(spread, np.uint64))):
            question = lm.unpack(lm.pack(grams.question(numbers, [many])))
            for gram, n in zip(zip(*lm.columns_of(question[:-1])), question[-1]):
                found[gram] += int(n)
                slots_of.setdefault(gram[:-1], set()).add(slot)
        assert found == expected
    # What goes on from a context stays together, but for that of frequent tokens only.
    alone = [len(x) for context, x in slots_of.items() if context and any(c >= len(spread) for c in context)]
    assert max(alone) == 1
    assert (len(slots_of[(1,)]) > 1) == (len(spread) > 1)


@pytest.mark.parametrize("order, least", [(3, 2), (3, 1), (2, 2), (1, 2)])
def test_lm_in_one_go_over_many_slots(spark, monkeypatch, order, least):
    """Rows of one table, some of which train, with repeated rows and null ids."""
    monkeypatch.setattr(lm, "_SLOT", 60)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c d e f gg hh ii".split()) for _ in range(rng.randrange(40))) for _ in range(60)]
    rows = [(i if i % 7 else None, i % 3 > 0 if i % 10 else None, t) for i, t in enumerate([*texts, *texts[:5], None])]
    frame = spark.createDataFrame(rows, "doc_id long, training boolean, text string").repartition(5)
    params = lm.LmParams(order=order, min_count=least)
    found = lm.fit_and_score(frame, F.col("training"), params)
    assert found.columns == ["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    model, table_ = lm.fit(frame.where("training"), params)
    apart = lm.score(frame, model, table_)
    key = lambda r: tuple((x is None, x or 0) for x in r[:5]) + tuple(round(x, 6) for x in r[5:])
    assert sorted(map(key, found.collect())) == sorted(map(key, apart.collect()))
    if (order, least) == (3, 2):
        expected = brute_scores([t or "" for _, b, t in rows if b], [t or "" for _, _, t in rows], 2, 0.75)
        assert sorted(r.score for r in found.collect()) == pytest.approx(sorted(expected), rel=1e-9, abs=1e-9)


def test_language_id(spark, documents):
    rows = QUERIES["op10_language_id"](spark, FOLDER).collect()
    lang = {d.doc_id: d.lang for d in documents}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_of_odd_rows(spark, odd):
    taught = [("en", "the cat and the dog"), ("fr", "é le chat et là"), (None, "x"), ("de", None)]
    model = lang_id.fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(taught)], "doc_id long, text string, lang string"))
    found = lang_id.predict(odd, model)
    assert sorted(found.columns) == sorted(odd.columns)  # the clashing ones are replaced
    by = {r.doc_id: r.lang_pred for r in found.collect()}
    assert by[1] == by[2] == by[5] == by[7] == "und" and by[6] == "fr"
    nothing = lang_id.fit(odd.where("false"))
    assert {r.lang_pred for r in lang_id.predict(odd, nothing).collect()} == {"und"}
    # An unseen word is scored by its n-grams.
    assert lang_id.predict_text(model, "chatte")[0] == "fr" and lang_id.predict_text(model, "dogs")[0] == "en"


def test_language_id_is_that_of_a_plain_model(spark):
    """Scores of random texts against counts in dictionaries."""
    rng, longest = np.random.default_rng(5), 4
    letters = {"en": "abcdet", "fr": "abcéèt", "hi": "अआकखा"}
    word = lambda lang: "".join(rng.choice(list(letters[lang]), rng.integers(1, 7)))
    vocabulary = {lang: [word(lang) for _ in range(40)] for lang in letters}
    taught = [(lang, " ".join(rng.choice(vocabulary[lang], 30))) for lang in letters for _ in range(8)]
    model = lang_id.fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(taught)], "doc_id long, text string, lang string"))
    langs = sorted(letters)
    counts = {}  # size (0 for words), then item, to counts by language
    for lang, text in taught:
        for w in lang_id.words_of(text):
            counts.setdefault(0, {}).setdefault(w, Counter())[lang] += 1
            for size in range(1, longest + 1):
                for i in range(len(w) + 3 - size):
                    counts.setdefault(size, {}).setdefault(f"<{w}>"[i : i + size], Counter())[lang] += 1

    def logs(size, item):
        table = counts[size]
        totals = [sum(c[lang] for c in table.values()) for lang in langs]
        return np.array([math.log(table[item][lang] + 1) - math.log(t + len(table) + 1) for lang, t in zip(langs, totals)])

    def score(w):
        if w in counts[0]:
            return logs(0, w)
        for size in range(longest, 0, -1):
            found = [g for i in range(len(w) + 3 - size) if (g := f"<{w}>"[i : i + size]) in counts[size]]
            if found:
                return sum(logs(size, g) for g in found) / len(found) * max(1.0, len(w) / 24)
        return np.zeros(len(langs))

    for _ in range(60):
        lang = str(rng.choice(langs))
        text = " ".join([*(word(lang) for _ in range(rng.integers(1, 6))), str(rng.choice(vocabulary[lang])), "zzz", "abt" * 30])
        total = np.log(np.full(3, 1 / 3)) + sum(score(w) for w in lang_id.words_of(text))
        found, share = lang_id.predict_text(model, text)
        assert found == langs[int(total.argmax())]
        assert share == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-4)


def test_figures_are_no_letters_and_marks_belong_to_words(spark):
    assert lang_id.words_of("10² ½ Ⅷ _ 7a") == ["a"] and lang_id.words_of("हिन्दी में") == ["हिन्दी", "में"]
    model = lang_id.fit(spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string"))
    assert [lang_id.predict_text(model, t) for t in ("10² ½", "Ⅷ", "7")] == [("und", 0.0)] * 3


def test_a_task_forgets_words_and_scores_them_alike(monkeypatch, spark):
    taught = [(i, f"word{chr(97 + i % 26)} {chr(97 + i % 26)}text", "en" if i % 2 else "de") for i in range(60)]
    model = lang_id.fit(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    text = " ".join(t for _, t, _ in taught) + " unseen"
    whole = lang_id.predict_text(model, text)
    monkeypatch.setattr(lang_id, "_KNOWN", 5)
    monkeypatch.setattr(lang_id, "_AT_ONCE", 5)
    assert lang_id.predict_text(model, text) == (whole[0], pytest.approx(whole[1]))


def test_long_words_are_scored_whole(spark):
    taught = [("fr", "chat chien"), ("en", "walk with")] * 3
    model = lang_id.fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(taught)], "doc_id long, text string, lang string"))
    word = "walk" * 20 + "chatchien" * 5000 + "with" * 20  # its ends are of the other language
    assert lang_id.predict_text(model, word)[0] == "fr"
    assert lang_id.predict_text(model, word + " walk with")[0] == "fr"  # it weighs by its length
