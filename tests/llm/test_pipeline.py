"""The pipeline's stages against what the operators alone say of each stage's input, and its queries' SQL."""

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing, quality_rules, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionAll(docs.limit(3))  # repeated rows
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        seen[name] = (docs, out)
        docs = out

    before, after = seen["quality_rules"]
    led = quality_rules.apply_policy(quality_rules.ledger(before), quality_rules.POLICIES["v1"])
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in led.where("kept").collect())

    before, after = seen["simhash_near_dedup"]
    found = simhash.near_duplicates(before, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in found})

    before, after = seen["secret_scan"]
    assert after.count() == before.count()
    text = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert (r.text == text[r.doc_id]) == ("[SECRET]" not in r.text) and r.n_chars == len(r.text)

    before, after = seen["entropy_mix"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before.select("doc_id", "source", "text"), ["doc_id"]).collect()}
    assert after.count() > 0 and set(r.doc_id for r in after.collect()) <= set(copies)
    assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 2

    before, after = seen["best_fit_packing"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    assert sum(r.length for r in after.collect()) == want
    assert max(r[0] for r in after.groupBy("sequence_id").sum("length").select("sum(length)").collect()) <= 4096


def test_one_of_each_component_whatever_its_ids(spark):
    words = [f"w{k}" for k in range(600)]
    base = " ".join(words)
    at = simhash.fingerprints([base.encode()])[0]
    bits = lambda t: int(at ^ simhash.fingerprints([t.encode()])[0]).bit_count()
    near = next(t for k in range(600) if bits(t := " ".join([*words[:k], "other", *words[k + 1 :]])) in (1, 2))
    one, two = "the first text of its own kind", "another thing that nobody wrote before"
    rows = [(None, base), (None, near), (7, one), (7, two), (8, two), (9, one)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs, SF).collect()]
    assert len(kept) == 3
    assert sum(t in (base, near) for _, t in kept) == 1  # linked, though no id names their component
    assert (7, one) in kept and (7, two) in kept  # one id, two components


def test_stages_with_nulls_and_without_rows(spark, tmp_path):
    """Rows without id, source or language, repeated ones, a clashing extra column; and no row at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string"
    word = lambda k, n: " ".join(f"w{(k * 7919 + i * 104729) % 5003}" for i in range(n))
    rows = [(None if k % 5 == 0 else k % 30, word(k % 40, 30 + k % 40), None, None if k % 3 == 0 else f"s{k % 2}", None, "x") for k in range(120)]
    rows += [(1, None, "en", "s1", 0, "x"), (None, "", None, None, None, None), (2, word(99, 25) + " token=abcdefgh1234", "en", None, 9, "x")]
    for name, some in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(some, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            if k < 4:
                assert docs.columns == corpus_pipeline.COLUMNS
            if name == "none":
                assert docs.count() == 0
            elif k == 0:
                assert docs.count() == 121  # all but the two without words
            elif k == 1:
                # 40 texts (of equal text all rows but one go) and the one with a secret
                assert docs.count() == 41 and docs.select("text").distinct().count() == 41
            elif k == 2:
                assert docs.count() == before.count() and docs.where("text like '%[SECRET]%'").count() == 1
            elif k == 3:
                size, taken = (df.selectExpr("sum(size(split(text, ' ')))").first()[0] for df in (before, docs))
                assert abs(taken - 1.5 * size) < 250
            else:
                per_doc = before.selectExpr("count(*)").first()[0]
                assert docs.where("piece = 0").count() == per_doc and docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


def test_sql_of_the_queries(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.sql(sql)
        columns = list(got.columns)
        rows = [tuple(r) for r in want.select(*columns).fetchall()]
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, rows)), name
