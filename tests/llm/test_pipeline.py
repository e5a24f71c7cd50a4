"""The pipeline's stages on planted cases."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from veilspan.llm import mixing


def test_stages_on_planted_cases(docs, spark, tmp_path):
    bench = " ".join(f"q{i}" for i in range(14))
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "other")
    texts = [base, near, base, None, "", "123", f"alpha beta gamma delta epsilon zeta eta theta {bench} omega psi chi phi", bench, "a clean document that stays as it is"]
    d = docs(texts).drop("extra")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lang = cp.language_id(spark, d, str(tmp_path))
    assert sorted(r.doc_id for r in lang.collect()) == [0, 1, 2, 6, 7, 8]
    kept = cp.near_duplicates(spark, lang, str(tmp_path))
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [0, 6, 7, 8] and kept.columns == d.columns
    clean = {r.doc_id: r for r in cp.decontamination(spark, kept, str(tmp_path)).collect()}
    assert sorted(clean) == [0, 6, 8] and clean[8].text == texts[8]
    assert "q5" not in clean[6].text and "alpha" in clean[6].text and clean[6].n_chars == len(clean[6].text)
    mixed = cp.source_mix(spark, cp.decontamination(spark, kept, str(tmp_path)), str(tmp_path))
    assert mixed.columns == d.columns and mixed.count() == 3
    tokens = cp.token_file(spark, mixed, str(tmp_path)).orderBy("start").collect()
    assert len(tokens) == 3 and tokens[0].start == 0 and tokens[1].start == tokens[0].n_tokens


def test_language_stage_keeps_texts_with_a_letter_where_no_row_is_labelled(docs, spark, tmp_path):
    texts = ["a clean document", "été", "北京", None, "", "123 !", "_ 4"]
    d = docs(texts, langs=[None] * len(texts)).drop("extra")
    kept = cp.language_id(spark, d, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2] and kept.columns == d.columns


def test_rows_with_a_null_or_repeated_id_keep_their_documents(docs, spark, tmp_path):
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    texts = [base[0], base[1], base[2], base[2], base[3], base[0]]
    d = docs(texts).drop("extra").withColumn("doc_id", F.when(F.col("doc_id").isin(1, 4), F.lit(None)).when(F.col("doc_id") > 4, 7).when(F.col("doc_id") == 3, 0).otherwise(F.col("doc_id")).cast("long"))
    got = Counter((r.doc_id, r.text) for r in cp.near_duplicates(spark, d, str(tmp_path)).collect())
    assert got == Counter([(0, base[0]), (0, base[2]), (None, base[1]), (None, base[3])])


def test_mix_deals_copies_to_rows(docs, spark, tmp_path):
    texts = [f"{i} " + "w " * (5 + i % 7) for i in range(60)] + ["same text here"] * 3
    d = docs(texts, sources=["a" if i % 3 else "b" for i in range(len(texts))]).drop("extra")
    d = d.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.floor(F.col("doc_id") / 4)).cast("long"))
    want = Counter()
    for r in mixing.pareto_mix(d.withColumn("row", cp.row_hash(d)), carry="row").collect():
        want[r.row] += r.copies
    got = Counter(r.row for r in cp.source_mix(spark, d, str(tmp_path)).select(cp.row_hash(d).alias("row")).collect())
    assert got == Counter({k: n for k, n in want.items() if n}) and sum(got.values()) > 0
    assert cp.source_mix(spark, d, str(tmp_path)).where("doc_id is null").count() > 0


def test_stages_take_empty_tables_nulls_repeats_and_clashing_names(docs, spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for texts in ([], ["a few words here", "a few words here", None, "", "x"]):
        d = docs(texts or ["x"]).drop("extra").where("true" if texts else "false")
        for name in ("__hits", "__lang", "__row", "__id", "__copies", "__n", "__r", "__copy"):
            d = d.withColumn(name, F.lit(7))
        d = d.unionByName(d.where("doc_id = 0"))
        n = d.count()
        for stage, step in cp.STAGES[:-1]:
            out = step(spark, d, str(tmp_path))
            assert out.columns == d.columns and out.count() <= 3 * n, stage
        assert cp.token_file(spark, d, str(tmp_path)).count() == n
    lang = cp.language_id(spark, d, str(tmp_path))
    assert sorted(r.doc_id for r in lang.collect()) == [0, 0, 1, 4]
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, lang, str(tmp_path)).collect()) == [0, 4]


def test_whole_pipeline_against_plain_steps(docs, spark, tmp_path):
    import random
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    bench = [" ".join(word() for _ in range(12)) for _ in range(3)]
    texts = []
    for k in range(40):
        w = [word() for _ in range(rng.randint(30, 90))]
        if k % 5 == 0:
            w[10:10] = bench[k % 3].split()
        texts += [" ".join(w), " ".join([*w[:-1], "zz"])] if k % 4 == 0 else [" ".join(w)]
    texts += [texts[3], None, "", "12 34", bench[0], "short text"]
    d = docs(texts, sources=["ab"[k % 2] for k in range(len(texts))]).drop("extra")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {k: t for k, t in enumerate(texts) if t and any(ch.isalpha() for ch in t)}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} or {tuple(t.split())} for k, t in kept.items()}
    comp = {k: k for k in kept}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    kept = {k: t for k, t in kept.items() if comp[k] == k}
    windows = {tuple(b.split()[i : i + 10]) for b in bench for i in range(3)}
    clean = {}
    for k, t in kept.items():
        w = t.split()
        hit = {j for i in range(len(w) - 9) if tuple(w[i : i + 10]) in windows for j in range(i, i + 10)}
        if len(hit) < len(w):
            # Spans are cut from the first hit word to the last; the blanks around them stay.
            clean[k] = "".join(x for i, v in enumerate(w) for x in ((" " if i and not (i in hit and i - 1 in hit) else ""), "" if i in hit else v))
    rows = [(k, t, "en", "ab"[k % 2], len(t)) for k, t in sorted(clean.items())]
    mixed = cp.source_mix(spark, spark.createDataFrame(rows, d.schema), str(tmp_path)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(ids := [*tok.encode(r.text, add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in mixed)
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want and len(want) > 20
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
