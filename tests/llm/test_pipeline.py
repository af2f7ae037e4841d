import os
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempaudit.llm.queries import judged
from tests.llm.test_line_dedup import SPACE
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_links

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_every_stage_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns, before = docs.columns, docs.orderBy("doc_id").collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.orderBy("doc_id").collect()
        found[name] = before, after
        assert name == "encode" or docs.columns == columns
        before = after
    first, kept = found["quality"]
    verdict = {r.doc_id for r in judged(spark.read.parquet(f"{SF}/documents.parquet"), SF).filter("kept").collect()}
    assert {r.doc_id for r in kept} == verdict and 0.6 * len(first) < len(kept) < len(first)

    before, after = found["line_dedup"]
    want = {}
    for r, (text, _, exact, near) in zip(before, brute_lines([r.text for r in before], least=1)):
        if not (exact + near and not text.strip(SPACE)):
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)

    before, after = found["document_dedup"]
    links = brute_links([r.text for r in before])
    assert [r.doc_id for r in after] == [r.doc_id for i, r in enumerate(before) if links[i][0] == i]

    before, after = found["mix"]
    uses, sizes = Counter(r.doc_id for r in after), defaultdict(int)
    assert max(uses.values()) <= 2 and set(uses) <= {r.doc_id for r in before}
    for r in before:
        sizes[r.source] += len(r.text.split())
    assert abs(sum(len(r.text.split()) for r in after) - 1.5 * sum(sizes.values())) < 0.15 * sum(sizes.values())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = found["encode"]
    assert len(before) == len(after)
    assert all(r.ids == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in after)


def test_odd_rows_and_clashing_columns(spark, odd_texts, docs):
    """Nulls, repeated rows and helper names as columns pass through every stage."""
    import corpus_pipeline

    table = docs(odd_texts, [None if i % 5 == 0 else f"s{i % 3}" for i in range(len(odd_texts))])
    table = table.unionByName(table.limit(5)).unionByName(table.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    extra = ("_id", "_uses", "_use", "_row", "_first", "_near", "_gone", "kept", "text_", "size", "ids")
    table = table.withColumns({c: F.lit("clash") for c in extra})
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF)
        rows = table.collect()
        assert rows and all(r[c] == "clash" for r in rows for c in extra if c != "ids")
        table = spark.createDataFrame(rows, table.schema)


def test_empty_documents(spark, tmp_path, empty_docs):
    import corpus_pipeline

    empty_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_stub_of_an_exact_copy_stays(spark):
    """Of equal texts the first keeps its lines, whatever their length; the others go with their last line."""
    from tempaudit.llm.line_dedup import cleaned

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts, copies = set(), set()
    for r in docs.orderBy("doc_id").collect():
        if r.text in texts:
            copies.add(r.doc_id)
        texts.add(r.text)
    assert len(copies) > 50
    assert not copies & {r.doc_id for r in cleaned(docs).collect()}
