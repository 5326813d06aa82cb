"""The pipeline's stages against brute force, and the registered queries against their SQL."""

from __future__ import annotations

import pytest
from compare import database, same, spark_rows, sql_rows
from llm.test_text_operators import WORD, brute_components, low

import __spark_entry__
import corpus_pipeline
from tidewatch.llm.oracles import ORACLES
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.tables import DOCUMENT_COLUMNS, table
from tidewatch.plans.staging import staged

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, FOLDER))
    expected_columns, expected = sql_rows(database(FOLDER), ORACLES[name])
    assert columns == expected_columns and len(rows) == len(expected)
    assert all(all(map(same, a, b)) for a, b in zip(rows, expected))


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_stages_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    odd = spark.createDataFrame(
        [(10**6, None, "en", None, 0), (10**6 + 1, "...", "en", "z", 3), (10**6 + 2, "", None, "z", 0)], docs.schema
    )
    docs = staged(docs.union(odd).withColumn("_extra", docs["doc_id"]), "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER), name)
        kept.append(docs)
        if name != "source_mix":
            assert docs.columns == [*DOCUMENT_COLUMNS, "_extra"]
    rows = [{r.doc_id: r.text for r in k.select("doc_id", "text").collect()} for k in kept]
    start = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    assert rows[0] == start  # all have letters; the odd ones have none
    largest = {low(t): max(d for d, u in start.items() if low(u) == low(t)) for t in start.values()}
    assert set(rows[1]) == set(largest.values())
    components = brute_components(list(rows[1].items()), 80)
    assert set(rows[2]) == {d for d, c in components.items() if d == c}
    items = [" ".join(WORD.findall(low(r.text))) for r in table(spark, FOLDER, "benchmark").collect()]
    assert set(rows[3]) == {d for d, t in rows[2].items() if not any(i in " ".join(WORD.findall(low(t))) for i in items)}
    mixed = kept[4].collect()
    words = sum(len(WORD.findall(t)) for t in rows[3].values())
    assert abs(sum(len(WORD.findall(r.text)) for r in mixed) - 1.5 * words) <= 32 * 20
    assert {r.doc_id for r in mixed} <= set(rows[3])


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
