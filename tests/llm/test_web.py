"""Language ID, URL cascade, WARC bundles and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import duckdb
import pytest
from pyspark.sql import functions as F

from hourpanel.llm import exact_dedup, language_id, queries, simhash_dedup, url_filter, warc_bundles

from .conftest import rows_of
from .test_tokens import check_pieces

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    out = language_id.identify(docs, model).where(language_id.held_out(F.col("doc_id"))).collect()
    assert len(out) > 100 and sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_spans_of_mixed_text(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 800")
    en, fr = (docs.where(F.col("lang") == x).orderBy("doc_id").first().text[:300].strip() for x in ("en", "fr"))
    df = spark.createDataFrame([(1, f"{en} 12 {fr}"), (2, en)], "doc_id long, text string")
    out = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    spans = [s for s in out[1].spans if s.end - s.start > 20]
    assert [s.lang for s in spans] == ["en", "fr"] and abs(spans[1].start - len(en) - 4) < 25
    assert out[2].lang_pred == "en" and len(out[2].spans) == 1 and out[2].score == 1


def test_viterbi_labels_equal_brute_force(model):
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 7, 1])
    scores = rng.normal(0, 8, (counts.sum(), len(model.langs)))
    got, at = model.label(scores.astype(np.float32), counts, 5.0), 0
    k = len(model.langs)
    for n in counts:
        best = max(((sum(scores[at + i, p] for i, p in enumerate(path)) - 5.0 * sum(a != b for a, b in zip(path, path[1:]))), path)
                   for path in np.ndindex(*[k] * n)) if n else None
        if best:
            assert tuple(got[at:at + n]) == best[1]
        at += n


def test_language_edges(edge, model):
    out = language_id.identify(edge, model).collect()
    assert len(out) == edge.count()
    texts = edge.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").select("doc_id")
    plain = {r.doc_id: r.text for r in edge.join(texts, "doc_id").collect()}
    for r in out:
        if r.doc_id in plain:
            has = any(c.isalpha() for c in plain[r.doc_id] or "")
            assert (r.lang_pred != "und") == has and (r.score > 0) == has
    assert language_id.identify(edge.limit(0), language_id.train(edge.limit(0))).count() == 0
    assert {r.lang_pred for r in language_id.identify(edge, language_id.train(edge.limit(0))).collect()} == {"und"}


def test_scripts_narrow_candidates(spark):
    rows = [(i, "слово другое время " * 5, "ru") for i in range(40)] + [(100 + i, "word other time " * 5, "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.train(df)
    out = language_id.identify(spark.createDataFrame([(1, "совсем ново"), (2, "quite new"), (3, "漢字")], "doc_id long, text string"), m).collect()
    assert [r.lang_pred for r in sorted(out)][:2] == ["ru", "en"] and sorted(out)[2].lang_pred in ("en", "ru")


def test_rare_language_is_predicted(spark):
    """A language of ten rows beside four of thousands, all in one script; a stray foreign word opens no script."""
    words = {"en": "word other time house", "fr": "mot autre temps maison", "de": "wort andere zeit haus", "es": "palabra otra tiempo casa"}
    rows = [(k * 10_000 + i, f"{w} " * 4, x) for k, (x, w) in enumerate(words.items()) for i in range(3000)]
    rows += [(90_000 + i, "kelma żmien oħra dar " * 4, "mt") for i in range(10)] + [(95_000, "слово", "en")]
    m = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == ("de", "en", "es", "fr", "mt")
    assert m.allowed[list(language_id.SCRIPTS).index("latin")].all()
    said = [(1, "żmien oħra dar kelma"), (2, "other house time"), (3, "autre maison")]
    out = language_id.identify(spark.createDataFrame(said, "doc_id long, text string"), m).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {1: "mt", 2: "en", 3: "fr"}


@pytest.mark.parametrize("slice_keys", [url_filter.SLICE_KEYS, 60])
def test_cascade_is_exact(spark, slice_keys):
    universe = spark.createDataFrame([(f"key{i}",) for i in range(4000)] + [(None,)], "key string").repartition(3)
    listed = spark.createDataFrame([(f"key{i}",) for i in range(0, 4000, 17)] + [("elsewhere",), (None,)], "key string")
    cascade = url_filter.build_cascade(universe, listed, false_share=0.2, slice_keys=slice_keys)
    assert all(len(s) > 2 for s in cascade.slices) and len(cascade.slices) == max(1, -(-236 // slice_keys))
    df = universe.where("key is not null").select("key", F.array(url_filter.key_hashes(F.col("key"))).alias("h"))
    got = {r.key: r.hit[0] for r in url_filter.is_listed(df, "h", cascade, "hit").collect()}
    assert got == {f"key{i}": i % 17 == 0 for i in range(4000)}


URLS = [None, "", "no scheme", "http://", "http://WWW.Example.COM/en/x?q", "https://example.com/en/", "https://a.example.com/en/y#z", "http://example.com",
        "http://x.net/fr/1", "http://net/es/", "ftp://.net/fr/", "http://casino-win.org/a", "http://org?u=http://a.com/", "a://b\n.com/\nx", "http://com/"]


def test_url_rules_edges(spark):
    df = spark.createDataFrame([(i, u, "mine", "theirs") for i, u in enumerate(URLS)] + [(None, None, None, None), (4, URLS[4], "mine", "theirs")],
                               "page_id long, url string, host string, keys string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    out = url_filter.judge_urls(df, rules, spark.createDataFrame([("casino-win.org",)], "host string"))
    assert out.columns == ["page_id", "url", "keys", "host", "path", "rule", "verdict"]

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        path = rest[cut:].split("?")[0].split("#")[0] if rest[cut:cut + 1] == "/" else ""
        fit = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[1] if fit else None
        return host, path, rule, max(fit)[2] if fit else "block" if host == "casino-win.org" else "allow"

    assert Counter((r.url, r.host, r.path, r.rule, r.verdict) for r in out.collect()) == Counter((r.url, *brute(r.url)) for r in df.collect())
    assert url_filter.judge_urls(df.limit(0), rules.limit(0), rules.select("host").limit(0)).count() == 0


def test_url_query_equals_its_sql(spark, tmp_path):
    more = ["http://a.spam-farm.org/x", "http://xn--abc.org/x", "http://-a.org/", "http://a-b-c/", "http://a-b\n.org/", "http://x.a-b\n/", "http://FREE-bets.net/de/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, *more])] + [(None, None), (4, URLS[4])], "page_id long, url string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op3_url_filters"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op3_url_filters"])
    names = [c[0] for c in want.description]
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want.fetchall())
    verdict = {r.host: r.verdict for r in got.collect()}
    assert [verdict[h] for h in ("a.spam-farm.org", "a-b-c", "free-bets.net", "xn--abc.org", "-a.org", "a-b\n.org")] == ["block"] * 3 + ["allow"] * 3


def pages_frame(spark):
    big, other = "é" * 700, "x" * 1000
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (7, "http://b/\r\nX: y", other), (8, "u", "small"), (9, "u", "small"),
            (10, "u", None), (None, "n", big), (5, "http://a/5", big), (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "z", "long " * 90_000)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, k string").repartition(2)


def test_warc_bundles(spark, monkeypatch):
    df = pages_frame(spark)
    path = warc_bundles.new_archive(spark)
    index = warc_bundles.write_bundles(df, path)
    got = warc_bundles.read_records(index, path, payload=True).collect()
    rows = df.collect()
    first = {}
    for r in rows:
        if len((r.html or "").encode()) >= 1000:
            first[r.html] = max(first.get(r.html, -1), r.page_id if r.page_id is not None else -1)
    many = Counter(r.html for r in rows)

    def want(r):
        data = (r.html or "").encode()
        again = len(data) >= 1000 and many[r.html] > 1 and r.page_id != first[r.html]
        return (r.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first[r.html] if again else None,
                b"" if again else data)

    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == Counter(map(want, rows))
    one = warc_bundles.read_records(index.where("page_id = 13"), path, payload=True).collect()
    assert len(one) == 1 and bytes(one[0].payload) == b"long " * 90_000
    empty = warc_bundles.new_archive(spark)
    assert warc_bundles.read_records(warc_bundles.write_bundles(df.limit(0), empty), empty).count() == 0


def test_bundle_is_seekable_zstandard(tmp_path, monkeypatch):
    import pyarrow.fs as pafs
    import zstandard

    monkeypatch.setattr(warc_bundles, "FRAME_BYTES", 4000)
    fs, file = pafs.LocalFileSystem(), str(tmp_path / "b.zst")
    w = warc_bundles.BundleWriter(fs.open_output_stream(file, compression=None))
    data = [warc_bundles.record(i, f"http://a/{i}", bytes([65 + i % 26]) * (i * 37)) for i in range(60)]
    places = [w.add(d) for d in data]
    w.close()
    raw = open(file, "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(data)  # skips the table
    r = warc_bundles.BundleReader(fs.open_input_file(file))
    assert len(r.frames) > 10
    for (f, o), d in reversed(list(zip(places, data))):
        assert r.record(f, o, len(d)) == d
    with pytest.raises(ValueError):
        warc_bundles.parse(data[5].replace(b"FF", b"FG"))


def test_pipeline_stages(spark, tmp_path, small):
    """Each stage on its own input, against what its operator's brute-force version leaves."""
    import corpus_pipeline
    from .test_native import SECRETS, brute_dedup, brute_spans
    from .test_near import brute_classes, brute_fp

    bad = [(9001, None, "en"), (9002, "", None), (9003, "12 34 !!", "en"), (9004, "token = abcdef12345 " + "new words here " * 9, "en"),
           (9005, SECRETS[2] + " " + " ".join(f"thword{i}" for i in range(40)), "en")]
    df = small.unionByName(spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in bad], small.schema))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "secret_scan", "packing"]
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/out{k}"))
        assert k == 4 or frames[-1].columns == docs.columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert ids[0] - ids[1] >= {9001, 9002, 9003} and {i for i in ids[0] - ids[1] if i < 9000} == set()
    rows = rows_of(frames[1].select("doc_id", "text"))
    assert ids[2] == {k[1] for k in brute_dedup(rows)}
    rows = rows_of(frames[2].select("doc_id", "text"))
    assert ids[3] == set(brute_classes(rows, [brute_fp(t) for _, t in rows]))
    assert ids[4] == ids[3] and all(not brute_spans(r.text) and r.n_chars == len(r.text) for r in frames[4].where("doc_id > 9000").collect())
    check_pieces(frames[4])
    assert {r.doc_id for r in frames[5].collect()} == ids[4]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == ids[4] and whole.columns == frames[5].columns


def test_operators_leave_no_row_behind(spark, small):
    assert exact_dedup.duplicate_classes(small).count() == simhash_dedup.near_duplicate_classes(small).count() == small.count()
