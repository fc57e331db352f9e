"""Columns whose names clash with those that operators make, and ties between the pipeline's documents."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terracell.llm import bpe, chat, langid, minhash, parity_join, registry

NAMES = ["id", "row", "node", "key", "keys", "size", "comp", "lead", "lang_pred", "score", "ids", "decoded", "conv", "segments", "allowed", "ends", "turn_no", "held_out", "component_id", "n_shingles", "_key", "_row"]
TEXTS = ["the cat sat on the mat and ran", "the cat sat on the mat and ran", None, "", "un chat dort sur le tapis rouge", "12 !"]


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(i if i != 3 else None, t, ("en", "fr")[i == 4], "s", len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def clash(plain):
    return plain.select("*", *(F.lit("clash").alias(n) for n in NAMES))


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_bpe(plain, clash):
    run = lambda df: bpe.round_trip_documents(df, registry.rank_file(), public_tokenizers.PATTERN)
    same(run(plain), run(clash))


@pytest.mark.parametrize("join", [parity_join.Join(), minhash.NearDedup()])
def test_joins(plain, clash, join):
    same(parity_join.groups(plain, join), parity_join.groups(clash, join))
    same(parity_join.leading(plain, join), parity_join.leading(clash, join))


def test_chat(plain):
    turns = plain.select((F.coalesce("doc_id", F.lit(9)) % 2).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    names = [n for n in NAMES if n not in ("role", "text")]
    same(chat.read_back(chat.format_turns(turns)), chat.read_back(chat.format_turns(turns.select("*", *(F.lit("clash").alias(n) for n in names)))))
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0
    twice = chat.read_back(chat.format_turns(turns.union(turns)))
    assert twice.agg(F.sum("n_turns")).first()[0] == 2 * len(TEXTS)


def test_language(plain, clash):
    model = langid.fit(clash)
    a, b = langid.identify(plain, langid.fit(plain)), langid.identify(clash, model)
    assert set(b.columns) == {*clash.columns, "lang_pred", "score"}
    same(a.select("doc_id", "lang_pred", "score"), b.select("doc_id", "lang_pred", "score"))
    assert b.where("id != 'clash' or node != 'clash'").count() == 0


def test_pipeline_stages_on_ties(spark, clash, tmp_path):
    """Every document several times over, under clashing names: each stage gives what it says, and empty tables stay empty."""
    docs = clash.union(clash).union(clash)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        docs.unpersist()
    kept = corpus_pipeline.near_copies(spark, docs, "")
    # One of the two ids of the cat, the other text; rows without a word stay as they are.
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("text like '%cat%'").collect()) == [(0, TEXTS[0])]
    assert kept.where("text is null or text = ''").count() == 6 and kept.where("text = '12 !'").count() == 1
    clean = corpus_pipeline.personal_data(spark, docs, "")
    assert clean.columns == corpus_pipeline.COLUMNS and clean.count() == docs.count()
    words = lambda df: df.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
    mixed = corpus_pipeline.mix(spark, docs.where("text like '% %'"), "")
    assert mixed.columns == corpus_pipeline.COLUMNS and words(mixed) > 0
