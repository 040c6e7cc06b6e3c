"""The tokenizer against its library, the registered queries, and the pipeline stage by stage."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fragweave.llm import bpe, queries
from tests.conftest import SF
from tests.llm.helpers import docs_of, sentence

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(queries.vocabulary())


def test_automaton_accepts_one_path_per_string():
    vocab = {c: i for i, c in enumerate(["a", "b", "aa", "ab", "aab", "ba"])}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a")]
    auto = bpe.Automaton(vocab, merges, "</w>")
    accepted = {}

    def walk(path, word):
        if len(word) <= 6:
            if path:
                accepted.setdefault(word, []).append(path)
            for token, t in vocab.items():
                if not path or auto.arc(path[-1], t):
                    walk([*path, t], word + token)

    walk([], "")
    for word, paths in accepted.items():
        parts = list(word)
        for u, v in merges:
            i, out = 0, []
            while i < len(parts):
                if parts[i:i + 2] == [u, v]:
                    out.append(u + v)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        assert paths == [[vocab[p] for p in parts]], word
    assert len(accepted) == sum(2 ** n for n in range(1, 7))


def test_encoding_equals_the_library(own, library):
    rng = random.Random(1)
    letters = "aàbc'sΣσİ\u0085 \x1c\x1d　​\t\n é#!12٣中文😀_ſßℵK<|endoftext|>'llth"
    cases = ["", " ", "!" * 3000, "a" * 300, "<|endoftext|>", "x<|startoftext|>y", "'s't're", "zz" * 40]
    cases += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    cases += ["".join(rng.choice("abeinorstlyh") for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    for text in cases:
        e = library.encode(text, add_special_tokens=False)
        n, ids = own.encode(text)
        assert ids == " ".join(map(str, e.ids)) and n == len(e.ids), text
        assert own.decode(ids) == library.decode(e.ids, skip_special_tokens=False), text


def test_encode_documents(spark, library):
    rows = [(1, "Hello, world"), (2, None), (3, ""), (None, "x"), (1, "Hello, world"), (4, sentence(random.Random(2), 20_000))]
    got = bpe.encode_documents(docs_of(spark, rows), queries.vocabulary()).collect()
    want = sorted((d is None, d or 0, library.encode(t or "", add_special_tokens=False).ids) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == want
    assert bpe.encode_documents(docs_of(spark, []), queries.vocabulary(), full=False).count() == 0


def test_decoding_reads_the_ids(spark):
    """Another id gives another text, so a wrong one shows in the decoded text."""
    row = bpe.encode_documents(docs_of(spark, [(1, "Hello, world")]), queries.vocabulary()).first()
    own = bpe.Tokenizer(queries.vocabulary())
    ids = " ".join(map(str, row.ids))
    assert own.decode(ids) == row.decoded
    assert own.decode(" ".join(map(str, [row.ids[0] + 1, *row.ids[1:]]))) != row.decoded


def test_queries_cover_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, query in queries.QUERIES.items():
        if name == "pipeline":
            continue
        got = query(spark, SF)
        if name == "op6_chat_format":
            assert got.count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
        elif name == "op13_neighbours":
            asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").count()
            assert got.count() == 10 * asked and got.select("query_id").distinct().count() == asked
        else:
            assert got.count() == n, name
            assert got.select("doc_id").distinct().count() == n, name


@pytest.mark.parametrize(("name", "label", "remainder"), [("op4_quality", "quality", 1), ("op10_toxicity", "toxic", 1)])
def test_held_out_accuracy(spark, name, label, remainder):
    sf = SF.replace("0.001", "0.01")
    got = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", label).collect()
    assert sum(r.predicted == r[label] for r in got) >= 0.93 * len(got)


def test_held_out_language(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " "), (None, "some words without an id"), (10**6 + 3, "twice the same row here"), (10**6 + 3, "twice the same row here")]


def stage(name):
    return next(f for n, f in corpus_pipeline.STAGES if n == name)


def test_pipeline_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert 0 < got.select("doc_id").distinct().count() <= docs.count()
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert got.where("n_tokens <> size(ids)").isEmpty()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_take_odd_rows_and_none(spark, name):
    f = stage(name)
    odd = f(spark, docs_of(spark, [(d, t, None, None) for d, t in ODD]), SF)
    assert odd.count() > 0
    assert f(spark, docs_of(spark, []), SF).count() == 0
    if name != "BPE encoding and decoding":
        assert odd.columns == list(corpus_pipeline.COLUMNS)


def test_toxicity_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = stage("toxicity")(spark, docs, SF).select("doc_id").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in got}
    assert all(d in left for d, t in labels.items() if not t)


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    words = sentence(random.Random(3), 100).split()
    rows = [(5, " ".join(words)), (3, " ".join(words[:-2])), (9, " ".join(words)), (4, sentence(random.Random(4), 50)), (6, ""), (7, None), (9, " ".join(words))]
    got = stage("n-gram Jaccard join")(spark, docs_of(spark, rows), SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == [3, 4, 6, 7]


def test_line_stage_shortens_and_drops(spark):
    line = "This line is long enough to be compared."
    rows = [(1, line + "\nfirst of all"), (2, line + "\nsecond"), (3, line), (4, "clean"), (5, ""), (6, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in stage("line dedup")(spark, docs_of(spark, rows), SF).collect()}
    assert got == {1: (line + "\nfirst of all", len(line) + 13), 2: ("second", 6), 4: ("clean", 5), 5: ("", 0), 6: (None, None)}


def test_mixing_stage_repeats_rows(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(5, 50)), "en", f"s{i % 4}") for i in range(200)]
    got = stage("mixing sources to target weights")(spark, docs_of(spark, rows), SF)
    words = got.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(words / sum(len(re.findall(r"\S+", t)) for _, t, *_ in rows) - 1.5) < 0.03
    assert got.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
