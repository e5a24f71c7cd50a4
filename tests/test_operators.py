import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.functions import text as tx
from veilspan.operators import anonymize, local, locate, mint, restoring, scoring, scratch, segments
from veilspan.operators import modelvalues as mv
from veilspan.operators import spanalgebra as sa
from veilspan.operators.detectors import RULES, detect
from veilspan.operators.locate import chunk, parse_entities
from veilspan.operators.regexspans import matches
from veilspan.plans import catalog
from veilspan.sources import files


def test_offsets_count_code_points_after_astral_characters(spark):
    d = spark.createDataFrame([(1, "😀 a@b.example x@y.example")], "doc_id int, text string")
    got = sorted((r.start, r.end, r.text) for r in detect(d, [r for r in RULES if r.id == "D01"]).collect())
    assert got == [(2, 13, "a@b.example"), (14, 25, "x@y.example")]


def test_email_scan_of_an_unbroken_run_is_fast(spark):
    d = spark.createDataFrame([(1, "a" * 40_000)], "doc_id int, text string")
    detect(d, RULES[:1]).count()
    began = time.time()
    assert detect(d, RULES[:1]).count() == 0
    assert time.time() - began < 1.0


def test_islands_do_not_depend_on_input_order_and_cover_the_union(spark):
    rng = random.Random(5)
    rows = [(d, s, s + rng.randint(1, 8), "T%d" % rng.randint(0, 3), "x", 0.5, rng.randint(1, 5)) for d in range(20) for s in (rng.randint(0, 60) for _ in range(12))]
    docs = spark.createDataFrame([(d, "z" * 80) for d in range(20)], "doc_id int, text string")
    schema = "doc_id int, start int, end int, type string, source string, confidence double, priority int"
    out = []
    for _ in range(2):
        rng.shuffle(rows)
        out.append(sorted(tuple(r) for r in sa.merge_islands(spark.createDataFrame(rows, schema), docs).collect()))
    assert out[0] == out[1]
    for d in range(20):
        assert {p for r in rows if r[0] == d for p in range(r[1], r[2])} == {p for r in out[0] if r[0] == d for p in range(r[1], r[2])}


def test_chunks_cover_the_text_and_overlap():
    text = ("word " * 700 + "\n\n") * 3
    parts = chunk(text)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(b[0] < a[1] <= b[1] for a, b in zip(parts, parts[1:]))


def test_hard_cuts_get_a_bridge():
    assert chunk("x" * 3000) == [(0, 2000), (1400, 2600), (1650, 3000)]
    assert chunk("x" * 1499 + "\n" + "x" * 1500) == [(0, 1500), (1150, 3000)]
    for at in range(0, 4400, 37):  # 600 characters that straddle a cut are whole in one chunk
        assert any(a <= at and at + 600 <= b for a, b in chunk("x" * 5000))


def test_model_rows_truncation_salvages_complete_rows():
    p = parse_entities('{"entities": [{"value": "A", "type": "PERSON"}, {"value": "B')
    assert p == {"entities": [("A", "PERSON")], "truncated": True, "invalid": False}


def test_all_rules_run_on_documents_and_reach_the_round_trip(spark, tmp_path):
    forms = {"PHONE": ["743-555-3824", "(743) 555-3824", "+33 6 12 34 56 78", "13912345678", "010-62345678", "06 12 34 56 78"], "BANK_ACCOUNT": ["6222021234567890", "6222 0212 3456 7890", "6222-0212-3456-7890"], "EMAIL": ["a@b.example"], "NATIONAL_ID": ["123-45-6789"], "DATE": ["3 March 2021"]}
    rows, want = [(0, None), (1, ""), (2, "no value here")], []
    for kind, texts in forms.items():
        for t in texts:
            rows.append((len(rows), f"first {t}; again {t}."))
            want += [(rows[-1][0], 6, 6 + len(t), kind, t), (rows[-1][0], 14 + len(t), 14 + 2 * len(t), kind, t)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path))
    spans = lambda name: sorted((r.doc_id, r.start, r.end, r.type, r.text) for r in run(name).collect())
    assert spans("d02_phone_documents") == [w for w in want if w[3] == "PHONE"]
    assert spans("d12_bank_account_documents") == [w for w in want if w[3] == "BANK_ACCOUNT"]
    assert spans("d_all_documents") == spans("m01_merge_islands_all") == want
    assert sorted((r.doc_id, r.surface) for r in run("t01_mint_tokens_all").collect()) == sorted({(w[0], w[4]) for w in want})
    assert {r.doc_id: r.n_sites for r in run("t02_emit_walk_all").collect()} == {w[0]: 2 for w in want}
    assert {r.type: (r.n_spans, r.n_docs, r.roundtrip_ok) for r in run("flagship_roundtrip_all").collect()} == {k: (2 * len(v), len(v), True) for k, v in forms.items()}


def timed(spark, rows, run, most):
    """Seconds of the second run over rows (doc_id, text), held against a published bound."""
    d = spark.createDataFrame(rows, "doc_id int, text string")
    run(d).count()
    began = time.time()
    run(d).count()
    assert time.time() - began < most


def test_scans_of_long_texts_stay_within_their_bounds(spark):
    rule = lambda k: lambda d: detect(d, [r for r in RULES if r.id == k])
    timed(spark, [(1, "2020年" * 20_000)], rule("D13"), 5)
    timed(spark, [(1, "中" * 40_000)], rule("D11"), 5)
    timed(spark, [(1, "[" * 40_000 + "_" * 40_000)], segments.blanks, 5)
    timed(spark, [(1, "{PERSON\\_" * 20_000)], lambda d: d.select(tx.decode_markdown_token(F.col("text")).alias("t")).where("t <> ''"), 5)
    names = spark.createDataFrame([(1, f"Name{k} Berg", "PERSON") for k in range(400)], "doc_id int, value string, type string")
    text = " ".join(f"word{k} Name{k % 400}  Berg" for k in range(20_000))
    timed(spark, [(1, text)], lambda d: locate.occurrences(names, d), 5)


def test_rescan_finds_a_value_however_spaced_and_composed(spark):
    d = spark.createDataFrame([(1, "Re\u0301my\u00a0 Lund met R\u00e9my Lund and r\u00c9my\nlund, not R\u00e9my Lunda")], "doc_id int, text string")
    v = spark.createDataFrame([(1, "R\u00e9my Lund", "PERSON")], "doc_id int, value string, type string")
    assert sorted((r.start, r.end) for r in locate.occurrences(v, d).collect()) == [(0, 11), (16, 25), (30, 39)]


def test_values_meet_texts_by_their_rarest_unit(spark):
    assert locate.units_of("Customer#000000001") == ["customer", "000000001"] and locate.units_of("北港 Lund") == ["北", "港", "lund"]
    assert locate.units_of("R\u00e9my") == locate.units_of("Re\u0301my") == []
    d = spark.createDataFrame([(k, 1, f"Dear Customer#{k:05d}, \u0130ngrid \u041e\u043b\u044f") for k in range(3000)], "doc_id int, scope int, text string")
    v = d.selectExpr("scope", "substr(text, 6, 14) AS value", "'PERSON' AS type").unionByName(spark.createDataFrame([(1, "ingrid", "PERSON"), (1, "\u043e\u043b\u044f", "PERSON")], "scope int, value string, type string"))
    began = time.time()
    got = locate.occurrences(v, d, "scope").collect()
    assert time.time() - began < 30
    assert sorted((r.doc_id, r.start, r.end) for r in got) == sorted((k, a, b) for k in range(3000) for a, b in ((5, 19), (21, 27), (28, 31)))


def test_restoring_a_large_scope_reads_its_entries_once(spark, monkeypatch):
    monkeypatch.setattr(restoring, "GROUP", 700)
    m = spark.range(3000).selectExpr("1 AS scope", "concat('Person ', id) AS token", "concat('value', id) AS surface")
    d = spark.range(3000).selectExpr("id AS doc_id", "1 AS scope", "concat('Person ', id, '; Person ', id) AS text").unionByName(spark.createDataFrame([(3000, None, "Person 1"), (3001, 1, None)], "doc_id bigint, scope int, text string"))
    began = time.time()
    got = {r.doc_id: r.restored for r in restoring.restore(d, m, "scope", "pseudonym", orphans=False).collect()}
    assert time.time() - began < 20
    assert got == {**{k: f"value{k}; value{k}" for k in range(3000)}, 3000: "Person 1", 3001: None}


def test_a_session_is_anonymized_in_steps_that_run_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def name(text):
        ran.add(1)
        return text.split(",")[0]

    call = F.udf(name).asNondeterministic()
    d = spark.createDataFrame([(k, k % 2, f"Berg{k} Lund, a{k}@b.example met Berg{k} Lund, EUR 5.") for k in range(40)], "doc_id int, scope int, text string").repartition(4)
    before = spark.conf.get(scratch.THRESHOLD)
    out, mapping = anonymize.anonymize(d, "scope", extractor=lambda x: x.select("doc_id", call("text").alias("value"), F.lit("PERSON").alias("type")))
    assert ran.value == 40 and spark.conf.get(scratch.THRESHOLD) == before
    plan = out._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "BroadcastHashJoin" not in plan
    assert {r.doc_id: r.tokenized for r in out.collect()} == {k: f"{{PERSON_{k // 2 + 1}}}, {{EMAIL_{k // 2 + 1}}} met {{PERSON_{k // 2 + 1}}}, {{AMOUNT_1}}." for k in range(40)}
    assert mapping.count() == 82


def test_restoring_plans_nothing_of_the_anonymizing_before_it(spark):
    plan = catalog.QUERIES["r00_restore_sessions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan and "__sites" not in plan


def test_a_scratch_table_is_written_under_a_lower_threshold_and_the_session_keeps_its_own(spark):
    seen, df = [], spark.range(3)

    class Watched:
        sparkSession, schema = spark, df.schema
        write = property(lambda self: self)

        def parquet(self, path):
            seen.append(int(spark.conf.get(scratch.THRESHOLD).removesuffix("b")))
            df.write.parquet(path)

    before = spark.conf.get(scratch.THRESHOLD)
    for most in (None, 1 << 20, 1 << 40):
        assert scratch.materialize(Watched(), "t", most).count() == 3 and spark.conf.get(scratch.THRESHOLD) == before
    assert seen == [10 << 20, 1 << 20, 10 << 20]


def test_variant_patterns_allow_gaps_between_scripts_only():
    assert [mv.places(t, "北港ABC公司")[0] for t in ("北港ABC公司", "北港 ABC 公 司", "北 港ABC公司", "北港A BC公司")] == [[(0, 7)], [(0, 10)], [(0, 8)], []]


def test_local_and_relational_merging_agree(spark):
    rng = random.Random(11)
    rows = [(d, s, min(60, s + rng.randint(1, 9)), f"T{rng.randint(0, 3)}", 0.5, rng.randint(1, 4)) for d in range(30) for s in (rng.randint(0, 50) for _ in range(rng.randint(0, 14)))]
    docs = spark.createDataFrame([(d, "".join(rng.choice("abcdef ") for _ in range(60))) for d in range(30)] + [(99, None), (98, "")], "doc_id int, text string")
    spans = spark.createDataFrame(rows, "doc_id int, start int, end int, type string, confidence double, priority int").withColumn("source", F.lit("x"))
    a = {tuple(r) for r in sa.merge_islands(spans, docs).select("doc_id", "start", "end", "type", "text", "priority").collect()}
    found = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "type", "confidence", "priority", F.lit("r").alias("rule"))).alias("mine"))
    x = docs.join(found, "doc_id", "left").withColumn("mine", F.coalesce("mine", F.array().cast("array<struct<start:int,end:int,type:string,confidence:double,priority:int,rule:string>>")))
    y = local.anonymize(x, found=F.col("mine"))
    b = {tuple(r) for r in y.select("doc_id", F.inline("spans")).select("doc_id", "start", "end", "type", "text", "priority").collect()}
    assert a == b
    back = {r.doc_id: (r.text, r.restored) for r in local.restore(y).collect()}
    assert all(t == r for t, r in back.values()) and back[99] == (None, None)


def test_local_minting_skips_numbers_that_a_text_spells(spark):
    d = spark.createDataFrame([(1, "a@b.example {EMAIL_1} {EMAIL\\_3} c@d.example e@f.example a@b.example")], "doc_id int, text string")
    x = local.anonymize(d, [r for r in RULES if r.id == "D01"]).first()
    assert [(m.surface, m.token) for m in x.mapping] == [("a@b.example", "{EMAIL_2}"), ("c@d.example", "{EMAIL_4}"), ("e@f.example", "{EMAIL_5}")]
    assert x.tokenized == "{EMAIL_2} {EMAIL_1} {EMAIL\\_3} {EMAIL_4} {EMAIL_5} {EMAIL_2}"


def test_operators_take_nulls_empty_tables_and_clashing_names(spark):
    schema = "doc_id string, text string, __t int, __v int, __k int, spans int, mapping int, found int, sites int"
    rows = [("a", "write a@b.example", 1, 1, 1, 1, 1, 1, 1), ("b", None, 1, 1, 1, 1, 1, 1, 1), ("c", "", 1, 1, 1, 1, 1, 1, 1), (None, "a@b.example", 1, 1, 1, 1, 1, 1, 1), ("a", "write a@b.example", 1, 1, 1, 1, 1, 1, 1)]
    for data in (rows, []):
        d = spark.createDataFrame(data, schema)
        found = detect(d)
        assert found.count() == (3 if data else 0)
        assert local.restore(local.anonymize(d)).where("not (restored <=> text)").count() == 0
        spans = found.select("doc_id", "start", "end", "type", "text", "source", "confidence", "priority")
        assert sa.merge_islands(spans, d.select("doc_id", "text").distinct()).count() == (1 if data else 0)
        assert sa.greedy(spans).count() >= 0 and sa.overlap_anti(spans, spans).where("doc_id is not null").count() == 0
        values = spans.select("doc_id", F.col("text").alias("value"), "type").union(spark.createDataFrame([("a", None, None), ("a", " ", "X")], "doc_id string, value string, type string"))
        assert locate.occurrences(values, d).distinct().count() == (1 if data else 0)
        assert mv.locate_model_rows(values, d).where("outcome = 'span'").count() == 0
        assert locate.chunks(d).count() == (3 if data else 0)
        assert segments.pack_segments(d).count() == (3 if data else 0) and segments.blanks(d).count() == 0 and segments.squeeze(d).count() == (4 if data else 0)
        m = mint.mint_tokens(spans, d.select("doc_id", "text"))
        assert m.where("doc_id = 'a'").count() == (1 if data else 0)
        out = mint.splice(d.select("doc_id", "text", "sites"), sa.merge_islands(spans, d.select("doc_id", "text").distinct()).join(m.select("doc_id", F.col("surface").alias("text"), "token"), ["doc_id", "text"]))
        assert out.where("doc_id = 'a' and tokenized = 'write {EMAIL_1}'").count() == (2 if data else 0)
        assert restoring.restore(d, m.select("doc_id", "token", "surface"), "doc_id").count() == len(data)


def test_streams_give_what_the_batch_gives(spark):
    sf = "/root/testdata/sf0.001"
    same = lambda a, b: sorted(map(repr, catalog.QUERIES[a](spark, sf).collect())) == sorted(map(repr, catalog.QUERIES[b](spark, sf).collect()))
    assert same("x01_stream_spans", "m01_local_spans")


@pytest.mark.parametrize("name", ["x01_stream_detect", "x01_stream_spans", "x02_session_mapping", "x03_resumable_batch"])
def test_streams_read_tables_of_many_files(spark, tmp_path, name):
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "conversations"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    got, want = (sorted(map(repr, catalog.QUERIES[name](spark, at).collect())) for at in (str(tmp_path), sf))
    assert got == want and got


def test_a_resumed_batch_takes_new_files_only(spark, tmp_path):
    from veilspan.streaming import detect as sd

    seen = []

    def work(df):
        seen.append(sorted(r.doc_id for r in df.collect()))
        return df

    for k in range(3):
        if k != 1:
            spark.createDataFrame([(k, "t")], "doc_id int, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sd.resume(spark.readStream.schema("doc_id int, text string").parquet(f"{tmp_path}/in"), work, f"{tmp_path}/out", f"{tmp_path}/state", "s")
    assert seen == [[0], [2]] and sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2]


def test_a_growing_session_keeps_its_tokens(spark, tmp_path):
    from veilspan.streaming import detect as sd

    schema = "conv int, doc_order int, start int, type string, text string"
    for k, rows in enumerate(([(1, 0, 5, "PERSON", "Bo"), (1, 0, 0, "PERSON", "Ann")], [(1, 1, 0, "PERSON", "Cy"), (1, 1, 4, "PERSON", "Ann"), (2, 0, 0, "DATE", "May")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = sd.session_mapping(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "conv")
        s.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.conv, r.token, r.surface) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "{PERSON_1}", "Ann"), (1, "{PERSON_2}", "Bo"), (1, "{PERSON_3}", "Cy"), (2, "{DATE_1}", "May")]


def test_folders_are_listed_in_order_and_bounded(spark, tmp_path):
    for name in ("b.txt", "a/c.md", ".h/x.txt", "a/.y.txt", "z.exe"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("t")
    assert [r.path.rsplit(tmp_path.name + "/")[1] for r in files.read_folder(spark, str(tmp_path)).collect()] == ["a/c.md", "b.txt"]
    with pytest.raises(ValueError):
        files.read_folder(spark, str(tmp_path), most=1)


def test_a_sealed_mapping_needs_its_key(spark):
    m = spark.createDataFrame([(1, "{A_1}", "x", "A")], "scope int, token string, surface string, type string")
    key = lambda k: F.unhex(F.sha2(F.lit(k), 256))
    sealed = files.seal_mapping(m, key("a"), "scope")
    assert files.open_mapping(sealed, key("a"), "scope").count() == 1
    with pytest.raises(Exception):
        files.open_mapping(sealed, key("b"), "scope").collect()


def test_lenient_matching_is_one_to_one_longest_first():
    assert scoring.lenient_pairs(["ann", "ann lee"], ["ann lee", "ann"]) == [(1, 0), (0, 1)]
    assert scoring.lenient_pairs(["ann lee"], ["ann"]) == [] and scoring.lenient_pairs(["ann lee"], ["ann l"]) == [(0, 0)]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    states = segments.tag_states(["A", "B"])
    for n in (1, 2, 4):
        x = rng.normal(size=(n, 9))
        ok = lambda p: states[p[0]][0] in "OBS" and states[p[-1]][0] in "OES" and all(segments.allowed(states[a], states[b]) for a, b in zip(p, p[1:]))
        best = max((p for p in itertools.product(range(9), repeat=n) if ok(p)), key=lambda p: sum(x[i, s] for i, s in enumerate(p)))
        assert segments.viterbi(x, ["A", "B"]) == list(best)


def test_boxes_join_until_none_meet():
    rng = random.Random(3)
    boxes = [(x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)) for x, y in ((rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40))]
    out = segments.joined_boxes(boxes)
    meet = lambda a, b: a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    assert not any(meet(a, b) for a, b in itertools.combinations(out, 2))
    assert all(any(o[0] <= b[0] and o[1] <= b[1] and b[2] <= o[2] and b[3] <= o[3] for o in out) for b in boxes)


def test_squeezed_offsets_point_at_their_characters():
    text = "  合 同 ABC \t d 合  x"
    out, at = segments.squeezed(text)
    assert out == "合同 ABC d 合 x" and all(text[i] == ch or ch == " " for ch, i in zip(out, at))


def test_halves_keep_characters_whole():
    for t in ("", "a", "ae\u0301b", "a\r\nb", "ab\U0001F468\u200d\U0001F469cd"):
        a, b = segments.halves(t)
        assert a + b == t and not b.startswith(("\u0301", "\u200d", "\n"))


def test_snapping_leaves_a_value_that_stands_alone_elsewhere():
    assert segments.snapped("mad Annabel", 4, 8) == (4, 11) and segments.snapped("mad Annabel, Anna", 4, 8) == (4, 8)
    assert segments.snapped("x" * 200, 60, 70) == (60, 70) and segments.snapped("a   b", 1, 3) is None


def test_a_rule_finds_its_matches_once(spark):
    d = spark.createDataFrame([(1, "a1b22"), (2, "none"), (3, ""), (4, None)], "doc_id int, text string").select("doc_id", matches(F.col("text"), "[0-9]+").alias("m"))
    assert [r.m if r.m is None else [tuple(x) for x in r.m] for r in d.orderBy("doc_id").collect()] == [[(1, 2, "1"), (3, 5, "22")], [], [], None]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_needs_hold_in_every_text_with_a_match(spark):
    texts = ["沪A12345", "粤B·12345学", "usd 5", "CLP$9", "5 eur", "￥3", "$ 4", "3万", "一百元", "US$7", "5 mn yen", "人民币 8", "2 U.S. dollars", "7億"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in RULES:
        if r.need:
            assert d.where(F.size(matches(F.col("t"), r.pattern)) > 0).where(~F.col("t").rlike(r.need)).isEmpty(), r.id
