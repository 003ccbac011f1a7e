"""Operators on Spark: contracts against brute force, and the odd cases of input."""

import hashlib
import zlib
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrove.llm import common
from lexigrove.llm import op1_mpeg_audio as mpeg
from lexigrove.llm import op2_ngram_jaccard as near
from lexigrove.llm import op3_toxicity as tox
from lexigrove.llm import op4_chat_format as chat
from lexigrove.llm import op5_token_counts as tc
from lexigrove.llm import op6_quality_rules as quality
from lexigrove.llm import op7_packing as pack
from lexigrove.llm import op8_sentencepiece as sp
from lexigrove.llm import op9_substring_dedup as sub
from lexigrove.llm import op10_html_extraction as html
from lexigrove.llm import registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, score double, n_words long, media string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.upper(), None, None), (4, BASE.replace("word60", "other"), "de", "b"),
    (5, None, "en", "a"), (6, "", None, "a"), (7, " \n\t ", "en", None), (8, LONG, "en", "a"), (9, "short text", "en", "a"), (10, "short text", "en", "a"), (11, "a▁b \U0001f389 <|endoftext|>", "en", "a"), (None, "no key at all", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, None, 7, 0.5, 3, "m") for i, t, lang, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def test_media(odd, empty):
    got = {r["doc_id"]: r for r in mpeg.features(mpeg.add_media(odd)).collect()}
    assert len(got) == len({r[0] for r in ROWS})
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["crc_ok"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), True)
    assert got[1]["media_sha256"] == got[2]["media_sha256"]
    assert mpeg.features(mpeg.add_media(empty)).count() == 0


def sets(rows):
    out = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset())
    return out


def test_near(spark, odd, empty):
    got = near.with_components(odd, spark, block_bytes=500).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in got) == sorted(
        (i or -1, len(s), {2: 1, 3: 1, 4: 1, 10: 9}.get(i, i or -1)) for (i, *_), s in zip(ROWS, sets(ROWS), strict=True)
    )
    assert near.with_components(empty, spark).count() == 0
    kept = near.one_of_each(odd, spark)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 5, 6, 7, 8, 9, 11, None}


def test_near_in_page_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "PAGE_HASHES", 1200)
    rows = [(k, " ".join(f"word{i}" if (i * 7 + k) % 61 > k % 9 // 4 else f"x{k}y{i}" for i in range(150))) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in near.with_components(spark.createDataFrame(rows, "doc_id long, text string"), spark).collect()}
    s, root = sets(rows), list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(a):
                if 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == dict(enumerate(root)) and len(set(root)) < 60


def test_near_query(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    s, root = sets(rows), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                p, q = find(rows[a][0]), find(rows[b][0])
                root[max(p, q)] = min(p, q)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.op2_ngram_jaccard(spark, sf_dir).collect()}
    assert got == {i: (len(x), find(i)) for (i, _), x in zip(rows, s, strict=True)}


@pytest.mark.parametrize(("size", "whole", "page"), [(4, 85, near.PAGE_HASHES), (5, 80, 1200)])
def test_near_counts_links(spark, monkeypatch, size, whole, page):
    monkeypatch.setattr(near, "PAGE_HASHES", page)
    rows = [(k, " ".join(f"word{i}" if (i + 10 * k) % 150 > k % 4 // 2 else f"x{k}y{i}" for i in range(150))) for k in range(40)]
    rows += [(100 + k, rows[k % 3][1]) for k in range(6)] + [(200, "")]
    s = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (t.split() for _, t in rows)]
    want = {i: sum(a != b and bool(s[a]) and 100 * len(s[a] & s[b]) >= whole * len(s[a] | s[b]) for b in range(len(rows))) for a, (i, _) in enumerate(rows)}
    got = near.with_components(spark.createDataFrame(rows, "doc_id long, text string"), spark, size=size, whole=whole).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and sum(want.values()) > 2 * len(rows)


def test_joined_by_heavy_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k < 50 else 100 + k, k) for k in range(90)] + [(None, 1000)], "key long, k long")
    found = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("k").alias("least")).filter("key is not null and key < 130")
    want = {how: sorted(map(str, rows.join(found.drop("size"), ["key"], how).collect())) for how in ("inner", "left")}
    for few, heavy in ((10_000, 2000), (0, 2000), (0, 20), (0, 1)):
        monkeypatch.setattr(common, "SENT_ROWS", few)
        monkeypatch.setattr(common, "HEAVY", heavy)
        for how, rows_ in want.items():
            assert sorted(map(str, common.joined(rows, found, ["key"], "size", 91, how).collect())) == rows_


def removed(rows, window=35):
    seen, out = {}, []
    for _, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = seen.get(key, 0) + 1
    for i, t, *_ in rows:
        w = words(t)
        gone = bytearray(len(w))
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = b"\1" * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def test_substrings(spark, odd, empty):
    key = lambda r: (r[0] or -1, *r[1:])
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sub.find_repeats(odd, spark, block_bytes=900).collect()]
    assert sorted(got, key=key) == sorted(removed(ROWS), key=key)
    # every seed that two blocks hold counts as crowded
    crowded = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sub.find_repeats(odd, spark, block_bytes=900, crowd=1).collect()]
    assert sorted(crowded, key=key) == sorted(got, key=key)
    assert sub.find_repeats(empty, spark).count() == 0
    out = sub.without_repeats(odd, spark)
    assert out.columns == odd.columns and {r["block"] for r in out.collect()} == {7}
    assert {r["text"] for r in out.filter("doc_id in (1, 2)").collect()} == {""} and out.filter("doc_id = 9").first()["text"] == "short text"


def test_substrings_query(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sub.op9_substring_dedup(spark, sf_dir).collect()}
    assert got == set(removed(rows))


def test_toxicity(spark, sf_dir, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.train(odd, labels, spark)
    assert {r["score"] for r in tox.scored(odd, model).collect()} == {0.0} and tox.scored(empty, model).count() == 0
    docs, truth = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.op3_toxicity(spark, sf_dir.replace("0.001", "0.01")).join(truth, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) > 0.93 and docs.count() == 1000


def test_quotation_after_letters_that_grow_when_lowered():
    model = {"terms": {"rotten": 2.0}, "stems": {}, "innocent": [], "quoted": 0.25}
    for before in ("", "İ" * 12):
        scorer = tox.Scorer(model)
        text = f'{before} they had "rotten" on it'
        found, seen = scorer.hits(text)
        assert [inside for inside, _ in scorer.context(text, seen, found)] == [True]


def test_chats(spark):
    rows = [(1, 0, "user", "a### b"), (1, 1, "assistant", "</turn>\n### User: x"), (1, 1, "assistant", "</turn>\n### User: x"), (1, None, None, None), (2, 0, "to:ol<^", "\\n \\\\ ####"), (None, 3, "assistant", ""), (3, 0, "system", "plain \\ text")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("", ""), ("user", "a### b"), ("assistant", "</turn>\n### User: x"), ("assistant", "</turn>\n### User: x")]
    assert [tuple(t) for t in got[2]["turns"]] == [("to:ol<^", "\\n \\\\ ####")] and "###" not in got[2]["formatted"][4:]
    assert got[3]["formatted"] == "### System: plain \\ text</turn>\n" and [tuple(t) for t in got[None]["turns"]] == [("assistant", "")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    cur = con.execute(chat.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r[n] for n in names) for r in chat.op4_chat_format(spark, sf_dir).collect())


def test_counts(spark, odd, empty):
    got = {r["doc_id"]: r for r in tc.count_with_edits(odd).collect()}
    counts = tc.LeafCounts()
    assert all(got[i]["n_tokens"] == len(counts.encode(t or "")) for i, t, *_ in ROWS) and tc.count_with_edits(empty).count() == 0
    edits = odd.filter("doc_id = 9").withColumn("edits", F.expr("array(named_struct('start', 0L, 'end', 5L, 'text', 'long'), named_struct('start', 6L, 'end', 99L, 'text', cast(null as string)))"))
    assert tc.count_with_edits(edits).first()["edited_sha256"] == hashlib.sha256(b"long ").hexdigest()


def test_counts_query(spark, sf_dir):
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    encode, n = tc.LeafCounts().encode, 0
    for r in tc.op5_token_counts(spark, sf_dir).collect():
        edited = tc.REDACTED.sub(tc.MARK, texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_tokens_after"], r["edited_sha256"]) == (len(encode(texts[r["doc_id"]])), len(encode(edited)), hashlib.sha256(edited.encode()).hexdigest())
        n += r["n_edits"]
    assert n


def stats(t):
    w = [x.decode() for x in words(t)]
    grams = {}
    for k in range(len(w) - 2):
        grams.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {p + d for ps in grams.values() if len(ps) > 1 for p in ps for d in range(3)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, empty, sf_dir):
    for r in quality.assess(odd, spark).collect():
        want = stats(dict((i, t) for i, t, *_ in ROWS)[r["doc_id"]])
        assert tuple(r[c] for c in quality.STATS[:5]) == want
        assert r["kept"] != r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.assess(empty, spark).count() == 0
    kept = quality.keep_good(odd, spark)
    assert kept.columns == odd.columns
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    for r in quality.op6_quality_rules(spark, sf_dir).collect():
        assert tuple(r[c] for c in quality.STATS[:5]) == stats(texts[r["doc_id"]])


def test_quality_rejects_outliers(spark):
    clean = [(i, " ".join(f"word{(i * 31 + k * k) % 997}" for k in range(60 + i % 200)), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{k}###***" for k in range(100)), "en", "a") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality.assess(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string"), spark).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def test_quality_judges_rare_languages(spark):
    text = lambda i: " ".join(f"word{(i * 31 + k * k) % 997}" for k in range(60 + i % 200))
    clean = [(i, text(i), "en" if i < 150 else f"rare{i % 5}", f"s{i % 3}") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{k}###***" for k in range(100)), f"rare{i}", "s0") for i in range(5)]
    got = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string"), spark).collect()}
    assert all(got[i]["kept"] for i, *_ in clean) and not any(got[i]["kept"] for i, *_ in junk) and all(r["distance2"] is not None for r in got.values())


def estimates(x):
    """The minimum-covariance-determinant estimate of points, in numpy: (mean, covariance, log determinant)."""
    floors, scale, n = np.diag(np.square(quality.FLOORS)), quality.consistency(), len(x)
    median = np.median(x, axis=0)
    s = np.sqrt((1.2533 * np.abs(x - median).mean(axis=0)) ** 2 + np.square(quality.FLOORS))
    z = (x - median) / s
    kinds = np.eye(quality.P), np.cov(np.tanh(z).T, bias=True), quality.P * np.mean([np.outer(v, v) / max(v @ v, 1e-12) for v in z], axis=0)
    best = None
    for kind in kinds:
        mean, cov, det = median, kind * np.outer(s, s) + floors, 1e9
        while True:
            d = np.floor(np.log1p(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)) * quality.NEAR)
            held = x[d <= np.percentile(d, 50)]
            mean, cov, was = held.mean(axis=0), scale * np.cov(held.T, bias=True) + floors, det
            det = np.linalg.slogdet(cov)[1]
            if best is None or det < best[2]:
                best = mean, cov, det
            if not det < was - quality.FALL:
                break
    return best


def kept_by_hand(rows):
    """doc_id -> kept for rows of (doc_id, text, lang, source), without Spark."""
    x = {}
    for k, (_, t, *_) in enumerate(rows):
        n, chars, symbols, dups, repeats = stats(t)
        lines = sum(bool(line.encode().split()) for line in (t or "").split("\n"))
        if not (n < 50 or 100 * repeats > 50 * n):
            v = (np.log(n), np.log(chars / n), symbols / chars, dups / max(lines, 1), repeats / n)
            x[k] = np.floor(np.array(v) * quality.STEPS + 0.5) / quality.STEPS
    levels = (lambda r: (r[2], r[3]), lambda r: (r[2], ""), lambda r: ("", ""))
    out, fits = {}, {}
    for k, r in enumerate(rows):
        out[r[0]] = k in x
        for level, key in enumerate(levels):
            members = [j for j in x if key(rows[j]) == key(r)]
            if k in x and len(members) >= quality.MIN_GROUP:
                at = level, key(r)
                if at not in fits:
                    fits[at] = estimates(np.array([x[j] for j in members]))
                mean, cov, _ = fits[at]
                out[r[0]] = (x[k] - mean) @ np.linalg.inv(cov) @ (x[k] - mean) <= quality.LIMIT
                break
    return out


def test_quality_against_numpy(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text, lang, source from '{sf_dir}/documents.parquet'").fetchall()
    # two groups of one language, one with an estimate of its own, and rare ones
    rows += [(10_000 + i, " ".join(f"word{(i * 31 + k * k) % 997}{'#' * (i % 40 == 0)}" for k in range(60 + i % 200)), "xx" if i < 180 else f"rare{i % 4}", f"s{i % 3 == 0}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    told = [{r["doc_id"]: (r["kept"], r["distance2"]) for r in quality.assess(d, spark).collect()} for d in (df, df.repartition(7, "doc_id").orderBy(F.xxhash64("doc_id")))]
    assert told[0] == told[1]
    assert {i: kept for i, (kept, _) in told[0].items()} == kept_by_hand(rows)


def test_quality_estimate_has_converged(spark):
    rng, p = np.random.default_rng(5), quality.P
    mix = rng.normal(size=(p, p))
    q = np.floor(np.vstack([rng.normal(size=(180, p)) @ mix, rng.normal(size=(120, p)) @ mix * 0.3 + 4]) * quality.STEPS + 0.5)
    x = q / quality.STEPS
    df = spark.createDataFrame([(0, *map(int, r), *map(float, v)) for r, v in zip(q, x, strict=True)], "_g int, " + ", ".join([*(f"_q{k} long" for k in range(p)), *(f"_x{k} double" for k in range(p))]))
    fit = quality._estimate(df, ["_g"], spark).first()
    floors, scale, dets = np.diag(np.square(quality.FLOORS)), quality.consistency(), []
    starts = [(np.median(x, axis=0), np.diag(np.square(1.2533 * np.abs(x - np.median(x, axis=0)).mean(axis=0))) + floors)]
    starts.append((np.array([fit[f"_m{k}"] for k in range(p)]), (low := np.array([[fit[f"_l{i}{j}"] if j <= i else 0.0 for j in range(p)] for i in range(p)])) @ low.T))
    assert abs(np.linalg.slogdet(starts[1][1])[1] - fit["_det"]) < 1e-6
    for mean, cov in starts:
        for _ in range(100):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            held = x[np.argsort(d)[:150]]
            mean, cov = held.mean(axis=0), scale * np.cov(held.T, bias=True) + floors
        dets.append(np.linalg.slogdet(cov)[1])
    assert fit["_det"] <= min(dets) + 0.05


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = pack.pack(odd, spark).collect()
    want = {}
    for i, x, *_ in ROWS:
        want.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [0])
    for i, many in want.items():
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        cuts = sorted((a, min(1024, len(ids) - a), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + 1024]))) for ids in many for a in range(0, len(ids), 1024))
        assert own == cuts
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and pack.pack(empty, spark).count() == 0


def test_packing_takes_special_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n y", "plain <|endoftext"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for run in (pack.op7_packing, lambda spark, sf_dir: corpus_pipeline.packing(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)):
        got = {r["doc_id"]: r["ids_crc32"] for r in run(spark, str(tmp_path)).collect()}
        assert got == {i: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in t.encode(x, add_special_tokens=False).ids + [0])) for i, x in enumerate(texts)}


def test_packing_query(spark, sf_dir):
    got = pack.op7_packing(spark, sf_dir).collect()
    total = sum(r["length"] for r in got)
    assert total == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
    assert len({r["sequence_id"] for r in got}) <= total / 1024 * 1.02 + 2


def test_sentencepiece(odd, empty, spark, sf_dir):
    rows = sp.encode(odd).collect()
    assert all(r["lossless"] and len(r["ids"]) == r["n_ids"] for r in rows) and sp.encode(empty).count() == 0
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    first, again = (sorted(tuple(r) for r in sp.op8_sentencepiece(spark, sf_dir).repartition(k).collect()) for k in (1, 3))
    assert first == again and all(r[5] == hashlib.sha256(texts[r[0]].encode()).hexdigest() and r[6] for r in first)


def test_pages(spark, sf_dir):
    page = "<body><div>Top</div><div>{}</div></body>"
    rows = [(1, "http://h/a/1", page.format("one")), (2, "http://h/a/2", page.format("two")), (3, None, None), (4, "http://x/", ""), (4, "http://x/", ""), (5, "not a url", "<article>ok &eacute;</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df, spark).collect()) == [(1, "one", 3), (2, "two", 3), (3, "", 0), (4, "", 0), (4, "", 0), (5, "ok é", 4)]
    assert html.extract(df.limit(0), spark).count() == 0
    assert html.op10_html_extraction(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_pages_of_a_host_across_folders_and_ranges(spark):
    page = "<body><div>Top</div>{}<div>End</div></body>"
    told = lambda i: page.format(f"<div>story {i}</div>" if i % 7 else "")
    # each page alone in its folder, three copies of some, another host between
    rows = [(10 * i + c, f"http://h/{i:03}/slug/?c={c}", told(i)) for i in range(60) for c in range(3 if i % 5 == 0 else 1)]
    rows += [(10_000 + i, f"http://other/{i}", "<body><div>Top</div><div>End</div></body>") for i in range(5)]
    want = {i: f"story {i // 10}" if i // 10 % 7 else "" for i, *_ in rows if i < 10_000} | {i: "Top End" for i, *_ in rows if i >= 10_000}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for least in (1, 2, 7, 128):
        assert {r["page_id"]: r["text"] for r in html.extract(df, spark, least).collect()} == want


def aligned(a, b):
    """Places in a of a longest common subsequence, whichever; by dynamic program."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_pages_query(spark, sf_dir):
    """Every page against its neighbours in the host's order, taken in plain Python."""
    rows = duckdb.sql(f"select page_id, url, html from '{sf_dir}/pages.parquet'").fetchall()
    hosts, read = {}, {i: html.blocks_of(h) for i, _, h in rows}
    for i, u, _ in rows:
        host, _, rest = u.split("//", 1)[1].partition("/")
        path, _, query = ("/" + rest).partition("#")[0].partition("?")
        hosts.setdefault(host.lower(), []).append((path, query, i))
    got = {r["page_id"]: r for r in html.op10_html_extraction(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    decided = 0
    for pages in hosts.values():
        ids = [i for *_, i in sorted(pages)]
        for k, i in enumerate(ids):
            near = [next((j for j in side if read[j] != read[i]), None) for side in (ids[:k][::-1], ids[k + 1 :])]
            shared = [aligned(read[i][1], read[j][1]) for j in near if j is not None]
            assert max(shared, default=0) <= got[i]["n_shared"] <= sum(shared) and got[i]["n_lines"] == len(read[i][1])
            decided += got[i]["n_shared"] > 0
            assert got[i]["text"] == " ".join(t for kind, t in zip(*read[i], strict=True) if kind == html.ARTICLE)
    assert decided


class Reader(HTMLParser):
    """Text of a page's article by the standard library's parser; no code of the operator."""

    SKIP = {"script", "style", "nav", "aside", "form", "footer", "button", "select", "textarea", "noscript", "iframe", "template", "svg", "dialog"}
    BLOCK = {"p", "div", "section", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "pre", "article", "header", "figure", "figcaption", "dl", "dt", "dd", "hr", "br"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.article, self.skipped = [], 0, []

    def handle_starttag(self, tag, attrs):
        says = dict(attrs).get("class") or ""
        if self.skipped:
            self.skipped += [tag] if tag == self.skipped[0] else []
        elif tag in self.SKIP or says in ("ad", "ads", "comments", "cookie", "sidebar"):
            self.skipped = [tag]
        self.article += tag == "article"
        self.out += [" "] if tag in self.BLOCK else []

    def handle_endtag(self, tag):
        if self.skipped and tag == self.skipped[0]:
            self.skipped.pop()
        self.article -= tag == "article" and self.article > 0
        self.out += [" "] if tag in self.BLOCK else []

    def handle_data(self, data):
        if self.article and not self.skipped:
            self.out.append(data)


def test_pages_by_another_parser(spark, sf_dir):
    pages = dict(duckdb.sql(f"select page_id, html from '{sf_dir}/pages.parquet'").fetchall())
    got = {r["page_id"]: r["text"] for r in html.op10_html_extraction(spark, sf_dir).collect()}
    wrong = []
    for k, page in pages.items():
        reader = Reader()
        reader.feed(page or "")
        reader.close()
        if " ".join("".join(reader.out).split()) != got[k]:
            wrong.append(k)
    assert len(pages) > 20 and wrong == []


def test_boxes_within_articles():
    prose = "<p>" + "This is the long prose of the article, which goes on for a while without a link. " * 5 + "</p>"

    def kept(box):
        kinds, lines = html.blocks_of(f"<html><body><article><h1>Head</h1>{prose}{box}{prose}</article></body></html>")
        return [x for x, k in zip(lines, kinds, strict=True) if k != html.FRAME and "long prose" not in x and x != "Head"]

    for name in ("notice", "site-notice", "promo", "newsletter-signup", "share", "social", "popup", "banner", "user-comments", "post-comments", "comments"):
        assert kept(f'<div class="{name}">not of the article</div>') == [] == kept(f'<section id="{name}"><p>not of it</p></section>')
    assert kept('<div id="respond">Leave a reply</div>') == []
    for name in ("related", "nav", "menu", "search"):
        assert kept(f'<div class="{name}"><p><a href="/">One</a> <a href="/b">Two links</a></p></div>') == []
        assert kept(f'<section class="{name}"><p>Prose that happens to stand in such a section.</p></section>') == ["Prose that happens to stand in such a section."]
    assert kept('<ul class="menu"><li><a href="/">One</a><li><a href="/b">Two</a></ul>') == []
    assert kept("<ul><li>one<li>two</ul>") != []
    # a box that holds the article itself stays, whatever its name
    kinds, lines = html.blocks_of(f'<article><div class="promo">{prose}{prose}</div><p>short</p></article>')
    assert html.FRAME not in kinds and len(lines) == 3


def test_raw_elements_that_never_end():
    text = lambda page: [x for x, k in zip(*reversed(html.blocks_of(page)), strict=True) if k != html.FRAME]
    for name in ("svg", "iframe", "object", "template", "noscript", "select", "title", "textarea"):
        assert "".join(text(f"<article><p>one <{name} x=1>two</p><p>three</p></article>")).replace(" ", "") == "onetwothree"
    assert text("<article>a <object>x<object>y</object>z</object> b</article>") == ["a b"]
    assert text("<article>a <svg>x<svg/>z</svg> b<script>var x = '<p>c</p>'") == ["a b"]
    assert html.blocks_of("<svg>" * 20_000 + "end")[1] == ["end"]


def test_pages_change_with_their_neighbours(spark):
    page = "<body><p>Top {}</p><article><h1>{}</h1><p>a story of some length, told to the end</p><div class='call'>Write to us</div></article></body>"
    bare = "<body><div>Top</div><div>{}</div><div>Call us</div></body>"
    rows = [(1, "http://h/a/1", page.format(1, "one")), (2, "http://h/a/1?x", page.format(2, "two")), (3, "http://h/b/", page.format(3, "three").replace("Write", "Come"))]
    rows += [(4, "http://g/1", bare.format("one")), (5, "http://g/1", bare.format("two")), (6, "http://g/2", bare.format("three").replace("Call", "Ask")), (7, "http://f/", bare.format("alone"))]
    text = lambda rows: {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), spark).collect()}
    story = " a story of some length, told to the end"
    assert text(rows) == {1: "one" + story, 2: "two" + story, 3: "three" + story + " Come to us", 4: "one", 5: "two", 6: "three Ask us", 7: "Top alone Call us"}
    assert text(rows[1:]) == {2: "two" + story + " Write to us", 3: "three" + story + " Come to us", 4: "one", 5: "two", 6: "three Ask us", 7: "Top alone Call us"}


def test_very_long_page(spark):
    page = "<article>" + "<p>same line</p>" * 20_000 + "<p>{}</p></article>" + "<div>tail</div>" * 20_000
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(2)]
    got = {r["page_id"]: (r["n_chars"], r["n_lines"], r["n_shared"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), spark).collect()}
    assert got == {i: (20_000 * 10 + 1, 40_001, 40_000) for i in range(2)}


def linked_groups(rows):
    """For each row its component by brute force, None for texts without words."""
    s, root = sets(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if s[a] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return [r if x else None for r, x in zip(root, s, strict=True)]


def check_stages(spark, docs, sf_dir, held):
    """Run all stages over docs (stored between them) and hold each one's rows against brute force on its own input."""
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, before, sf_dir), spark, name)
        old, new = ([tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in d.collect()] if name != "packing" or d is before else [] for d in (before, after))
        if name != "packing":
            assert after.columns == docs.columns and after.schema == docs.schema
        if name == "quality" and held:
            assert sorted(map(str, new)) == sorted(str(r) for r in old if kept_by_hand(old)[r[0]])
        if name in ("quality", "toxicity"):
            assert not Counter(new) - Counter(old)
        if name == "near_duplicates":
            groups, stay = linked_groups(old), Counter(new)
            assert not stay - Counter(old)
            want = {}
            for r, g in zip(old, groups, strict=True):
                if g is not None:
                    want.setdefault(g, []).append((r[0] is None, r[0] or 0, r))
            told = [min(x[:2] for x in rows) for rows in want.values()]
            got = [(r[0] is None, r[0] or 0) for r in new if words(r[1])]
            assert sorted(got) == sorted(told)
            assert sorted(str(r) for r in new if not words(r[1])) == sorted(str(r) for r in old if not words(r[1]))
        if name == "substrings":
            cut = {(i, k) for i, _, _, k in removed(old)}
            assert {(r[0], hashlib.sha256(b" ".join(words(r[1]))).hexdigest()) for r in new} == cut and len(new) == len(old)
        if name == "packing":
            texts = Counter(r[0] for r in old)
            pieces = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
            assert {r["doc_id"] for r in pieces} == set(texts) and all(r["n"] == r["all"] for r in pieces if texts[r["doc_id"]] == 1)
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").isEmpty()
        before = after


def test_pipeline(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_stages(spark, docs, sf_dir, True)
    assert corpus_pipeline.near_duplicates(spark, docs, sf_dir).filter("n_chars <> length(text)").count() == 0
    nothing = empty
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, sf_dir)
        assert nothing.count() == 0


def test_pipeline_odd_rows(spark, odd, sf_dir):
    # the odd rows, and long ones that the rules keep: repeated rows, one doc_id for two texts, a quoted passage, nulls, columns named as the operators' own
    rng = np.random.default_rng(8)
    sentence = lambda n: " ".join(f"v{int(k)}" for k in rng.integers(0, 5000, n))
    passage, texts = sentence(60), [sentence(90) for _ in range(60)]
    rows = [(i, t, lang, s) for i, t, lang, s in ROWS] + [(100 + k, t if k % 3 else f"{t} {passage}", "en", "a") for k, t in enumerate(texts)]
    rows += [(105, texts[5], "en", "a")] * 2 + [(106, texts[7], "en", "a"), (106, texts[6] + " more", "en", "a"), (None, texts[9], None, None), (None, texts[9], None, None), (None, sentence(80), "en", "a"), (300, texts[11].upper(), None, "a")]
    schema = SCHEMA + ", key string, root long, task int, `span` int, words string, gone string, kept boolean, toxic int, bucket int, units int"
    docs = spark.createDataFrame([(i, t, lang, s, None, 7, 0.5, 3, "m", "k", 1, 2, 3, "w", "g", True, 1, 1, 1) for i, t, lang, s in rows], schema)
    check_stages(spark, docs, sf_dir, False)
    once = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(1, BASE)] * 3 + [(1, BASE + " and so on")], "doc_id long, text string"), sf_dir)
    assert once.count() == 1 and corpus_pipeline.substrings(spark, once, sf_dir).first()["text"].startswith("word0 word1")


def test_registry():
    names = registry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and set(registry.oracle_sql()) <= set(names)
