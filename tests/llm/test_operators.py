"""Each training-data operator against a brute-force version, with nulls, empty and long texts, ties and copies."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import chat, decontaminate, exact, jaccard, langid, mixing, suffixes, tokenfile, urlblock, warc
from veilspan.llm.fmindex import FMIndex
from veilspan.llm import rangecoder
from veilspan.llm.rangecoder import decode, encode

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) for _ in range(n // 3)]
    out = list(base)
    for b in base:
        w = b.split(" ")
        w[rng.randrange(len(w))] = "zz"
        out += [b.upper() if rng.random() < 0.5 else b, " ".join(w)]
    return [*out, None, "", "x", "a b", "abab " * 3000, "abab " * 3000]


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    t = rng.integers(1, 5, 500)
    index = FMIndex(t, 5)
    pats = np.array([t[i : i + 4] for i in range(0, 400, 7)])
    lo, hi = index.search(pats)
    for p, a, b in zip(pats, lo, hi):
        want = [i for i in range(497) if (t[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 40])
def test_decontamination(docs, spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    texts = corpus()
    items = [(1, " ".join(texts[0].split(" ")[3:18])), (20, "zz"), (3, None), (4, ""), (5, " ".join(texts[0].split(" ")[5:30])), (7, "a b")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r.c for r in docs(texts).select("doc_id", decontaminate.contamination(F.col("text"), bench).alias("c")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {i: {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} for i, t in items if (w := word.findall((t or "").translate(LOW)))}
    for d, t in enumerate(texts):
        w, hit, its = word.findall((t or "").translate(LOW)), set(), set()
        for i, ws in wins.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        its.add(i)
        assert (got[d].n_words, got[d].n_hit, got[d]["items"]) == (len(w), len(hit), sorted(its)), d


def test_exact_dedup(docs):
    texts = corpus()
    got = {r.id: (r.keep_id, r.group_size, r.sha) for r in exact.exact_groups(docs(texts)).collect()}
    norm = [(t or "").translate(LOW) for t in texts]
    for i, t in enumerate(norm):
        same = [k for k, u in enumerate(norm) if u == t]
        assert got[i] == (max(same), len(same), hashlib.sha256(t.encode()).hexdigest())


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> np.uint64(52) << np.uint64(52) for _ in range(3)]
    packed = [exact.pack(*exact.add(p, np.ones(len(p), np.int64)), 20) for p in parts]
    fp, c = exact.unpack(exact.merge(packed, 20), 20)
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert (fp == want[0]).all() and (c == want[1]).all() and c.max() > 1


def test_near_groups(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "LIGHT", 2)
    monkeypatch.setattr(jaccard, "TILE_ROWS", 5)
    check_near_groups(docs, corpus())


def test_near_groups_of_a_shared_passage(docs, monkeypatch):
    for name, value in (("LIGHT", 2), ("TILE_ROWS", 3), ("CLOSEST", 1), ("BITMAP", 128)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for k in range(24):  # the passage, a few words changed along a chain: neighbours are alike, ends are not
        own = list(passage)
        for i in range(k):
            own[i] = f"c{i}"
        texts.append(" ".join([*own, *(f"t{k}{i}" for i in range(rng.randint(0, 2)))]))
    texts += [" ".join([*passage, *(f"o{k}{i}" for i in range(12))]) for k in range(8)] + ["p1 p2 p3 p4 p5", "p1 p2 p3 p4 p6", "p1 p2 p3 p4 p5 p6"]
    check_near_groups(docs, texts)


def check_near_groups(docs, texts):
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(docs(texts), k=4, num=85, den=100).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                if sets[i] and sets[j] and comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}


def test_suffix_dedup(docs):
    check_suffix_dedup(docs, corpus())


def check_suffix_dedup(docs, texts):
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(docs(texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        assert got[i] == (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()), i


def test_mix_comes_near_targets_and_reruns_agree(docs):
    rng = random.Random(2)
    texts = [" ".join("w" for _ in range(rng.randint(0, 40))) for _ in range(600)] + [None]
    sources = [rng.choice(["a", "b", "c", None]) for _ in texts]
    d = docs(texts, sources=sources)
    rows = sorted(tuple(r) for r in mixing.pareto_mix(d).select("id", "size", "source_size", "target", "copies").collect())
    assert rows == sorted(tuple(r) for r in mixing.pareto_mix(d.repartition(7)).select("id", "size", "source_size", "target", "copies").collect())
    for s in {"a", "b", "c", None}:
        mine = [r for r in rows if sources[r[0]] == s]
        assert abs(sum(r[1] * r[4] for r in mine) - mine[0][3]) <= 40
    assert all(r[4] <= 3 for r in rows)
    assert abs(sum({sources[r[0]]: r[3] for r in rows}.values()) - sum(r[1] for r in rows)) < 1e-6


def fair_targets(sizes, cap=3.0):
    """Weights 1, 2, 3, ... by code point, null last; what a capped source can't take is shared again among the others."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, parts = total - sum(cap * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        got = {s: cap * sizes[s] if s in full else rest * weight[s] / parts for s in names}
        over = {s for s in names if s not in full and got[s] > cap * sizes[s] + 1e-9}
        if not over:
            return got
        full |= over


def test_mix_targets_are_capped_and_shared_again(docs):
    rng = random.Random(4)
    texts = [" ".join("w" for _ in range(rng.randint(1, 30))) for _ in range(900)]
    sources = [rng.choices(["b", "a", None, "z", "É"], [600, 200, 3, 90, 7])[0] for _ in texts]
    rows = mixing.pareto_mix(docs(texts, sources=sources)).collect()
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = fair_targets(sizes)
    assert any(abs(want[s] - 3 * sizes[s]) < 1e-9 for s in sizes)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(sum(r.copies * r["size"] for r in rows if r.source == s) - want[s]) <= 30


def test_mix_takes_long_documents_in_proportion_to_their_odds(docs, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BIN", 16)
    sizes = [(5, 1500), (10, 1500), (20, 1500), (400, 6)]
    texts = [f"{k} " + "w " * (n - 1) for n, c in sizes for k in range(c)]
    texts += ["x " * 40_000]
    sources = ["a"] * (len(texts) - 1) + ["b"]
    rows = [r for r in mixing.pareto_mix(docs(texts, sources=sources)).collect() if r.source == "a"]
    total, target = rows[0].source_size, rows[0].target
    part = target / total - int(target / total)
    quota = part * total
    # Certain: weights whose odds would reach 1; the others share what is left.
    certain, rate = [], 0
    for n, c in sorted(sizes, reverse=True):
        rate = (quota - sum(a * b for a, b in certain)) / sum(a * a * b for a, b in sizes if (a, b) not in certain)
        if rate * n <= 1:
            break
        certain.append((n, c))
    for n, c in sizes:
        took = sum(r.copies - int(target / total) for r in rows if r["size"] == n) / c
        want = 1.0 if (n, c) in certain else rate * n
        assert abs(took - want) < 0.06, (n, took, want)


def test_language_id_on_held_out_rows(docs, spark):
    en, fr = "the of and to with from that which there", "le la les des pour avec dans être cette"
    rng = random.Random(4)
    texts = [" ".join(rng.choice((en if i % 2 else fr).split()) for _ in range(20)) for i in range(120)]
    d = docs([*texts, None, "", "123 !", "?"], langs=["en" if i % 2 else "fr" for i in range(120)] + [None] * 4)
    model = langid.fit(d.where("doc_id < 80"))
    got = {r.doc_id: r.p for r in d.select("doc_id", langid.predict(model, F.col("text")).alias("p")).collect()}
    assert all(got[i].lang == ("en" if i % 2 else "fr") and 0 <= got[i].score <= 1 for i in range(120))
    assert {got[i].lang for i in range(120, 124)} == {"und"}
    none = langid.fit(d.where("lang = 'xx'"))
    assert {r.p.lang for r in d.select(langid.predict(none, F.col("text")).alias("p")).collect()} == {"und"}


@pytest.mark.parametrize("n", [0, 1, 5, 256, 257, 3000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50256).astype(np.uint32)
    raw = rng.integers(0, 50257, n).astype(np.uint32)
    for x in (ids, rng.integers(0, 200_000, n).astype(np.uint32), np.zeros(n, np.uint32), raw):
        seg = encode(x)
        assert (decode(seg) == x).all()
    if n == 3000:
        bad = bytearray(seg)
        bad[-3] ^= 1
        with pytest.raises(ValueError):
            decode(bytes(bad))


def test_token_file(docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ["The end <|endoftext|> x", None, "", "a b  c\n\n d", "Ünï çödé!\x0b?", "hello " * 400, "it's\u3000x,y;  z", " \n"]
    tok, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read_tokens(tokenfile.write_tokens(docs(texts), P.path("byte_bpe_50k.json"))).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_url_classes(spark):
    link = '<LINK REL="canonical" href="{}">'
    pages = [(1, "http://a.net/x", link.format("/y")), (2, "http://a.net/y", '<meta http-equiv=refresh content="0; url=http://Example.org/es/1">'), (3, "http://example.org/es/1", ""), (4, "http://b.com/fr/1", link.format("http://a.net/x")), (5, None, None), (6, "nourl", "x"), (7, "http://c.net/", None), (8, "http://a.net/x", "")]
    rules = [("allow", "com", "/fr/"), ("block", "example.org", "/es/")]
    got = {r.page_id: (r.verdict, r.rule) for r in urlblock.judge(spark.createDataFrame(pages, "page_id int, url string, html string"), rules).collect()}
    assert got == {1: ("block", None), 2: ("block", None), 3: ("block", "example.org/es/"), 4: ("allow", "com/fr/"), 5: ("allow", None), 6: ("allow", None), 7: ("allow", None), 8: ("block", None)}


def test_url_classes_fold_case_dots_queries_and_unquoted_refresh(spark):
    link = '<link rel="canonical" href="{}">'
    links = [("http://a.net/1/x?k=1#f", link.format("?es"), "http://a.net/1/x?es"), ("http://a.net/2/x/y", link.format("./es"), "HTTP://A.net/2/x/es"), ("http://a.net/3/x/y", link.format("../es/"), "http://a.net/3/es/"), ("http://a.net/4", "<meta http-equiv=refresh content=0;url=http://B.org/4/x>", "http://b.org/4/x"), ("http://a.net/5", link.format("http://Example.com/x/.."), "http://example.com/"), ("http://a.net/6", link.format("http://b.org/X"), "http://b.org/x")]
    pages = [(2 * i + k, u, h) for i, (u, h, v) in enumerate(links) for k, (u, h) in enumerate([(v, link.format("http://bad.org/es/1")), (u, h)])]
    pages += [(20, "http://c.net/a/../y", ""), (21, "http://c.net/z", link.format("/y")), (22, "http://c.net/p", link.format("#q"))]
    rules = [("block", "bad.org", "/es/"), ("block", "c.net", "/a/")]
    got = {r.page_id: r.verdict for r in urlblock.judge(spark.createDataFrame(pages, "page_id int, url string, html string"), rules).collect()}
    assert got == {**{i: "block" for i in range(11)}, 11: "allow", 20: "block", 21: "block", 22: "allow"}


def test_warc_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "<title>T &amp; x</title><script>no</script><p>Hi <b>you</b></p><a href='/z'>z</a>"), (2, None, None)], "page_id int, url string, html string")
    resp = warc.parse(warc.responses(pages))
    rows = {(r.id, r.record_type): r for r in warc.derivatives(resp).collect()}
    assert len(rows) == 4 and rows[1, "conversion"].block.splitlines()[0] == "T & x" and "no" not in rows[1, "conversion"].block
    assert "outlink: /z" in rows[1, "metadata"].block and rows[1, "metadata"].refers_to == rows[1, "conversion"].refers_to
    assert rows[2, "conversion"].block == ""
    text = warc.serialize(warc.derivatives(resp)).where("id = 1 and record_type = 'conversion'").first().record
    assert "WARC-Refers-To: <urn:uuid:" in text and text.startswith("WARC/1.1\r\n")
    assert text.endswith(rows[1, "conversion"].block + "\r\n\r\n") and "WARC-Source-Content-Type: text/html; charset=utf-8\r\n" in text
    given = spark.createDataFrame([(1, "WARC/1.0\r\nWARC-Record-ID: <urn:uuid:1>\r\nwarc-target-uri: http://b.net/\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nWARC-Payload-Digest: sha1:ABC\r\n", "HTTP/1.1 404 No\r\nServer: x\r\nContent-Type: text/html\r\n\r\nab\r\n\r\ncd"), (2, None, "<p>open <script>x <!-- y"), (3, None, None)], "id int, header string, message string")
    p = {r.id: r for r in warc.parse(given).collect()}
    assert (p[1].record_id, p[1].uri, p[1].date, p[1].source_type, p[1].payload_digest, p[1].payload) == ("<urn:uuid:1>", "http://b.net/", "2020-01-02T03:04:05Z", "text/html", "sha1:ABC", "ab\r\n\r\ncd")
    rows = {(r.id, r.record_type): r for r in warc.derivatives(warc.parse(given)).collect()}
    assert "Server: x\r\n" in rows[1, "metadata"].block and rows[1, "conversion"].refers_to == "<urn:uuid:1>" and rows[1, "conversion"].source_digest == "sha1:ABC"
    assert rows[2, "conversion"].block == "open" and rows[3, "conversion"].block == ""


def test_chat_snapshots(spark):
    rows = [(c, t, "user", x) for c, xs in ((1, "ab"), (2, "abc"), (3, "abc"), (4, "b"), (5, [None])) for t, x in enumerate(xs)]
    conv = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv: (r.n, r.copies, r.rendered) for r in chat.render(*chat.maximal(conv)).collect()}
    assert set(got) == {2, 4, 5} and got[2][:2] == (3, 2) and got[5][2] == "<|user|>\n<|end|>\n"


def test_empty_tables(docs, spark):
    none = docs([])
    assert exact.exact_groups(none).count() == 0 and mixing.pareto_mix(none).count() == 0
    assert suffixes.dedup(none).count() == 0 and jaccard.near_groups(none).count() == 0
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert docs(["a b"]).select(decontaminate.contamination(F.col("text"), bench).alias("c")).first().c.n_hit == 0


def test_a_block_is_read_alone():
    rng = np.random.default_rng(3)
    x = (rng.zipf(1.4, 20_000) % 3_000).astype(np.uint32)
    seg = rangecoder.encode(x, 700)
    for k in (0, 7, 28):
        assert (rangecoder.decode_block(seg, k) == x[700 * k : 700 * (k + 1)]).all()


def test_range_coder_with_classes_of_many_ids():
    x = np.concatenate([np.arange(2**17), np.zeros(100_000), np.arange(2**17)[::7]]).astype(np.uint32)
    assert (rangecoder.decode(rangecoder.encode(x, 4096)) == x).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name, monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(tokenfile, "CACHE", 4_000)  # both generations turn over
    enc = tokenfile.Encoder(public_tokenizers.path(name), 2)
    texts = [*corpus(), "a<|endoftext|>b", "x y  z", "it's 12.5%\n\n  end ", " ", "café 北京 😀!", "a\x0bb"]
    ids, sizes = enc.chunk(pa.array(texts))
    want = [[*enc.tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_suffix_block_orders_by_suffix():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(120, 400))) for _ in range(6)]
    parts += [parts[0], parts[1][13:], b"ab" * 150]
    b = suffixes.Block(parts, 100)
    pos = np.concatenate([s + np.arange(len(p) - 99) for s, p in zip(b.starts, parts)])
    text = b"\0".join(parts)
    got = [text[p : p + 100] for p in b.sort(pos)]
    assert got == sorted(got)


def test_suffix_dedup_cuts_and_hot_grams(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    monkeypatch.setattr(suffixes, "PIECE", 900)
    monkeypatch.setattr(suffixes, "BUCKET", 50)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(20)) + " " + passage + " " + " ".join(word() for _ in range(20)) for _ in range(12)]
    check_suffix_dedup(docs, [*texts, texts[3], passage + passage])


def test_suffix_dedup_leaves_rows_without_an_id_alone(docs):
    t = "abcdefghij" * 30
    d = docs([t, t, t]).withColumn("doc_id", F.when(F.col("doc_id") == 1, None).otherwise(F.col("doc_id")).cast("long"))
    assert sorted((r.id is None, r.id, r.n_removed) for r in suffixes.dedup(d).where("id is null").collect()) == [(True, None, 0)]


def test_near_groups_where_an_id_has_several_texts(docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    d = docs([a, b, a + " x", b + " x"]).withColumn("doc_id", F.when(F.col("doc_id") < 2, 0).otherwise(F.col("doc_id")).cast("long"))
    got = sorted((r.id, r.component_id) for r in jaccard.near_groups(d).collect())
    assert got == [(0, 0), (0, 0), (2, 0), (3, 0)]


@pytest.mark.parametrize("name", ["op1_decontaminate", "op2_warc_derivatives", "op3_exact_dedup", "op4_url_filter", "op8_chat_snapshots"])
def test_query_matches_its_sql(spark, name):
    import os

    import duckdb

    from veilspan.llm import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{sf}/{f}'")
    df, rel = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == sorted(repr(tuple(plain(v) for v in r)) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_empty_tables(spark, docs):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.derivatives(warc.parse(warc.responses(pages))).count() == 0 and urlblock.judge(pages, [("block", "a", "/")]).count() == 0
    assert chat.maximal(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))[0].count() == 0
    import public_tokenizers

    none = docs(["x"]).where("false")
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    assert mixing.pareto_mix(none).count() == 0 and langid.fit(none)["langs"] == []
