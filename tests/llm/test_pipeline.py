"""Planted cases through the whole pipeline, and its contract."""

import os
import random

import pytest

import corpus_pipeline
from aspectra.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def prose(n):
        words = [rng.choice(vocabulary) for _ in range(n)]
        return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."

    rows = [(i, prose(rng.randint(60, 200)), "en", f"src{i % 5}") for i in range(120)]
    passage = prose(70)
    rows[10] = (10, rows[10][1] + passage, "en", "src0")
    rows[11] = (11, passage + rows[11][1], "en", "src1")
    rows += [(200, rows[3][1], "en", "src0"), (201, rows[4][1].replace(" ", " zzz ", 1), "en", "src0")]
    rows += [(300 + i, "worthless idiot " + prose(80) + " scum", "en", "src2") for i in range(40)]
    rows += [(400 + i, (rng.choice(vocabulary) + " ") * 150, "en", "src3") for i in range(40)]
    rows += [(500, None, None, None), (501, "", "en", "src1"), (None, prose(90), "en", "src1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(100)] + [(300 + i, 1, 1) for i in range(30)] + [(400 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_planted_cases(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, corpus)
    assert good.columns == columns
    ids = {r.doc_id for r in good.collect()}
    assert not ids & set(range(300, 440)) and set(range(120)) <= ids and None in ids
    single = stages["near_duplicates"](spark, good, corpus)
    assert single.columns == columns
    ids = {r.doc_id for r in single.collect()}
    assert not ids & {200, 201} and set(range(120)) <= ids and None in ids
    cut = stages["repeated_passages"](spark, single, corpus)
    assert cut.columns == columns
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r for r in cut.collect()}
    assert after[10].text == before[10] and len(after[11].text) < len(before[11]) - 300
    assert after[11].n_chars == len(after[11].text)
    assert all(after[i].text == before[i] for i in range(120) if i != 11)
    packed = stages["packing"](spark, cut, corpus)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(after)


def test_run_and_contract(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 120
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "packing"]


def test_empty_table_through_all_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered_queries_have_the_contract_columns(spark):
    columns = {
        "op1_topk": {"query_id", "rank", "vec_id", "score"},
        "op2_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op3_flac": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op4_simhash": {"doc_id", "fingerprint", "component_id"},
        "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op6_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op7_licenses": {"doc_id", "family"},
        "op8_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op9_quality": {"doc_id", "keep"},
        "op10_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    }
    registered = queries.queries()
    assert set(registered) == {*columns, "pipeline"}
    for name, wanted in columns.items():
        assert wanted <= set(registered[name](spark, DATA).columns), name


def test_repeated_rows_and_ids(spark, corpus):
    """One of two equal rows stays, and texts that share an id with a copy stay."""
    rng = random.Random(4)

    def prose(n):
        return " ".join("".join(rng.choice("abdegiklmnoprstu") for _ in range(6)) for _ in range(n))

    twice, other, first, second, passage = prose(60), prose(60), prose(60), prose(60), prose(40)
    rows = [(1, twice), (1, twice), (2, first), (3, first), (3, other), (4, second + passage)]
    rows += [(5, passage + prose(40)), (5, passage + prose(50)), (6, twice[:150])]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    single = sorted((r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs, corpus).collect())
    assert single == sorted(set(rows) - {(3, first)})
    cut = [(r.doc_id, r.text) for r in stages["repeated_passages"](spark, docs, corpus).collect()]
    assert cut.count((1, twice)) == 1 and [i for i, _ in cut].count(1) == 1
    assert (2, first) in cut and (3, other) in cut and (4, second + passage) in cut
    fives = sorted(len(t) for i, t in cut if i == 5)
    assert len(fives) == 2 and fives[0] < 300 and fives[1] < 370
