"""Archives, the classifier, tokens and the pipeline."""

import gzip
import hashlib
import math
import re
import tempfile
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandspark.llm import classifier, quality, spm, warc
from strandspark.llm.common import shared_dir
from strandspark.llm.queries import QUERIES
from strandspark.llm.spm import TOKENIZER

SMALL = "/root/testdata/sf0.001"
PAGES = [
    (0, "http://a/\r\nx", "x" * 99), (1, "http://b", "x" * 99), (2, "http://c", "é" * 60), (3, None, "é" * 60), (4, "u", None), (5, "u", ""), (6, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 9), (7, "u", "y" * 300000),
    (9, "u", "y" * 300000), (8, "u", "y" * 300000), (7, "u", "y" * 300000), (10, "u", "\x00\x01" * 80), (None, "u", "é" * 60),
]


def test_archives_read_back(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, __digest string")
    folder = shared_dir(spark)
    warc.write_monolithic(pages, f"{folder}/raw", records=4)
    warc.normalise(spark, f"{folder}/raw", f"{folder}/warc")
    rows = warc.read_pages(spark, f"{folder}/warc").collect()
    assert len(rows) == len(PAGES) and all(r.digest_ok for r in rows)
    first = {}
    for i, _, html in PAGES:
        b = (html or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    want = []
    for i, _, html in PAGES:
        b = (html or "").encode()
        to = first.get(b) if i is not None and b in first and i > first[b] else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=key) == sorted(want, key=key)
    # Each index entry is one member that opens by itself, and each file is gzip as a whole.
    index = {(r.archive, r.offset): r for r in warc.read_index(spark, f"{folder}/warc").collect()}
    assert {(r.archive, r.offset, r.length) for r in rows} == {(*k, v.length) for k, v in index.items()}
    files = spark.read.format("binaryFile").load(f"{folder}/warc").filter("kind = 'warc'").select("archive", "content").collect()
    for f in files:
        whole = gzip.decompress(bytes(f.content))
        parts = [gzip.decompress(bytes(f.content)[v.offset : v.offset + v.length]) for (a, _), v in sorted(index.items()) if a == f.archive]
        assert b"".join(parts) == whole and all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)


def test_archives_of_large_pages(spark):
    """Pages of many megabytes among small ones: archives roll by bytes, pieces by less, and all is read back."""
    pages = spark.range(60).selectExpr("id AS page_id", "concat('http://p/', id) AS url", "CASE WHEN id % 20 = 7 THEN repeat(concat('\\r\\n\\r\\n', sha2(cast(id AS string), 512), 'é'), 100000) ELSE repeat(sha2(cast(id AS string), 512), 40) END AS html")
    folder = shared_dir(spark)
    warc.write_monolithic(pages, f"{folder}/raw")
    warc.normalise(spark, f"{folder}/raw", f"{folder}/warc", most=6000, piece=2000)
    want = {r.page_id: (r.n, r.d) for r in pages.selectExpr("page_id", "octet_length(html) AS n", "sha2(html, 256) AS d").collect()}
    rows = warc.read_pages(spark, f"{folder}/warc").collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in rows} == want and all(r.digest_ok for r in rows) and len(rows) == 60
    index = {(r.archive, r.offset): r.length for r in warc.read_index(spark, f"{folder}/warc").collect()}
    assert {(r.archive, r.offset): r.length for r in rows} == index and len({a for a, _ in index}) > 4
    files = spark.read.format("binaryFile").load(f"{folder}/warc").filter("kind = 'warc'").select("archive", "content").collect()
    for f in files:
        spots = sorted((o, n) for (a, o), n in index.items() if a == f.archive)
        assert b"".join(gzip.decompress(bytes(f.content)[o : o + n]) for o, n in spots) == gzip.decompress(bytes(f.content))


@pytest.mark.parametrize("last", ["hello\r\n", "\r\n", "\r\n\r\n\r\n", "a\r\n\r\n\r\n", "c\r", "\n", "\r", "", "\r\n\r", "\r\r\n\r\n\n"])
def test_pages_that_end_in_blank_lines(spark, last):
    """Such a page as the last record of its file, and in the midst of others."""
    html = ["x\r\n", last, "\r\n\r\ny", last * 60, last + "z", last]
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate(html)], "page_id bigint, url string, html string").coalesce(1).sortWithinPartitions("page_id")
    for records in (100, 1):
        folder = shared_dir(spark)
        warc.write_monolithic(pages, f"{folder}/raw", records=records)
        warc.normalise(spark, f"{folder}/raw", f"{folder}/warc")
        rows = warc.read_pages(spark, f"{folder}/warc").collect()
        assert {r.page_id: r.payload_digest for r in rows} == {k: hashlib.sha256(h.encode()).hexdigest() for k, h in enumerate(html)}
        assert all(r.digest_ok for r in rows) and len(rows) == len(html) == warc.read_index(spark, f"{folder}/warc").count()


def test_foreign_streams_with_blank_lines(spark):
    """Streams of other writers: too many blank lines between records and at the end, bare line feeds, no blank at the end."""
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n\r\n"
    streams = [record, record + b"\r\n" * 3, record + b"\r\n" + record + b"\n", record * 2 + b"\r\n\r\n", record[:-4], b"", b"\r\n\r\n\r\n"]
    rows = [(f"s{k}", gzip.compress(s)) for k, s in enumerate(streams)]
    for k, stream in enumerate(streams[:4]):
        assert [x[2] for x in warc.read_records(iter([bytes([b]) for b in stream]))] == [b"abc\r\n"] * stream.count(b"WARC/"), k
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, blob in rows:
        with open(f"{folder}/{name}.gz", "wb") as f:
            f.write(blob)
    target = shared_dir(spark)
    warc.normalise(spark, f"file://{folder}", f"{target}/warc")
    assert warc.read_index(spark, f"{target}/warc").count() == sum(s.count(b"WARC/") for s in streams)


def test_no_pages(spark):
    folder = shared_dir(spark)
    warc.write_monolithic(spark.createDataFrame([], "page_id bigint, url string, html string"), f"{folder}/raw")
    warc.normalise(spark, f"{folder}/raw", f"{folder}/warc")
    assert warc.read_pages(spark, f"{folder}/warc").count() == 0 and warc.read_index(spark, f"{folder}/warc").count() == 0


def test_many_members_and_bad_streams():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    blob = gzip.compress(record) + gzip.compress(record * 2)
    assert [x[2] for x in warc.read_records(warc._inflate(memoryview(blob)))] == [b"abc"] * 3
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_records(iter([record[:-6]])))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.read_records(iter([b"HTTP/1.1\r\n\r\n"])))


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality_classifier"](spark, sf)
    assert got.count() == 1000
    row = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row.a > 0.93 and row.lo >= 0 and row.hi <= 1


def test_classifier_edges(spark):
    fold = F.pmod("doc_id", F.lit(5))
    docs = spark.createDataFrame([(k, None if k % 7 == 0 else "a b c " * (k % 9), 1) for k in range(40)], "doc_id bigint, text string, stats int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = classifier.quality_scores(docs, none, fold).collect()
    assert len(rows) == 40 and all(0 <= r.score <= 1 for r in rows)
    one = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert classifier.quality_scores(docs, one, fold).count() == 40
    assert classifier.quality_scores(docs.limit(0), one, fold).count() == 0


def test_scores_of_very_long_texts(spark):
    docs = spark.range(12).selectExpr("id AS doc_id", "repeat(concat('word', id, ' and more. '), CASE WHEN id < 3 THEN 200000 ELSE 5 END) AS text")
    labels = spark.range(12).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "0 AS toxic")
    rows = classifier.quality_scores(docs, labels, F.pmod("doc_id", F.lit(5))).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)


def test_scores_equal_brute_force(spark):
    """Statistics, normal equations, isotonic step and scores again in plain numpy."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    got = {r.doc_id: r.score for r in classifier.quality_scores(docs, labels, fold).collect()}
    stats = {r.doc_id: np.asarray(r.stats) for r in classifier.with_statistics(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, text in list(texts.items())[:60]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, lines, chars = max(len(words), 1), (text or "").split("\n"), max(len(text or ""), 1)
        want = [math.log1p(len(words)), sum(map(len, words)) / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n]
        assert np.allclose(stats[i][:4], want), i
        assert math.isclose(stats[i][11], 1 - len(set(lines)) / len(lines)) and math.isclose(stats[i][5], len(re.findall("[0-9]", text or "")) / chars)
    part = {i: zlib.crc32(str(i).encode()) % 5 for i in stats}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    known = [i for i in quality if part[i] != 0]
    settings = classifier.Settings()
    model = classifier.Model(settings)
    x = np.stack([stats[i] for i in known])
    model.mean, model.scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-12)) + 1e-9
    fitted, held = [i for i in known if part[i] > 1], [i for i in known if part[i] == 1]
    f, y = model.features(np.stack([stats[i] for i in fitted])), np.asarray([float(quality[i]) for i in fitted])
    penalty = np.full(f.shape[1], settings.ridge)
    penalty[-1] = 1e-6
    # The ridge solution as least squares over rows that stand for the penalty.
    model.weights = np.linalg.lstsq(np.vstack([f, np.diag(np.sqrt(penalty))]), np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]
    margin, target = model.margins(np.stack([stats[i] for i in held])), np.asarray([float(quality[i]) for i in held])
    order = np.argsort(margin, kind="stable")
    margin, target = margin[order], target[order]
    total = np.concatenate([[0], np.cumsum(target)])
    n = len(target)
    level = np.asarray([max(min((total[b + 1] - total[a]) / (b + 1 - a) for b in range(k, n)) for a in range(k + 1)) for k in range(n)])
    steps, levels = classifier.isotonic(margin, target)
    for a, b in zip(steps, levels, strict=True):
        assert np.isclose(level, b).any() and margin[0] <= a <= margin[-1]
    heads = [k for k in range(n) if k == 0 or not math.isclose(level[k], level[k - 1])]
    centres = [margin[a:b].mean() for a, b in zip(heads, [*heads[1:], n], strict=True)]
    assert np.allclose(steps, centres) and np.allclose(levels, level[heads])
    scores = np.interp(model.margins(np.stack([stats[i] for i in got])), centres, level[heads])
    assert np.allclose([got[i] for i in got], scores, atol=1e-6)


def test_isotonic_rises():
    x, y = classifier.isotonic(np.asarray([3.0, 1, 2, 4, 5]), np.asarray([1.0, 0, 1, 0, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1


TEXTS = ["", None, "  two  spaces ", " a", "a\n\nb\t c", "</s><s> hi", "日本語 🎉 x", "a\x00b c", "ééé    z", " ", "\n", "a" * 200, "x" * 300 + " y", "The quick brown fox.", "tab\tand\x0bother \r\n line"]


def test_tokens_equal_the_library():
    import sentencepiece

    pieces = spm.load(open(TOKENIZER, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    ids = spm.encode(pa.array(TEXTS), pieces).to_pylist()
    assert ids == library.encode([t or "" for t in TEXTS])
    assert spm.decode(pa.array(ids, pa.list_(pa.int32())), pieces).to_pylist() == [t or "" for t in TEXTS]


@pytest.mark.parametrize("size", [65, 3_000, 100_000, 1_000_000])
def test_long_units_equal_the_library(size):
    """Texts without spaces: random letters as of base64, words run together, one character, unspaced scripts."""
    import random

    import sentencepiece

    rng = random.Random(size)
    pieces = spm.load(open(TOKENIZER, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(rng.choice(letters) for _ in range(size))]
    if size <= 100_000:
        words = "the of and quick brown fox token ization internationalization \u65e5\u672c\u8a9e \u00e9l\u00e8ve".split()
        texts += ["".join(rng.choice(words) for _ in range(size // 6)), "e" * size, "".join(rng.choice("\u65e5\u672c\u8a9e\U0001f389x") for _ in range(size))]
    began = time.time()
    ids = spm.encode(pa.array(texts), pieces)
    back = spm.decode(ids, pieces).to_pylist()
    assert time.time() - began < 60 and back == texts
    assert ids.to_pylist() == library.encode(texts)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_token_query_equals_the_library(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_sentencepiece"](spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.token_ids == library.encode(text) and r.n_tokens == len(r.token_ids) and r.n_chars_decoded == len(text) and r.round_trip


def test_best_path_of_long_units_equals_that_of_short_ones():
    rng = np.random.default_rng(14)
    texts = ["<unk>"] + sorted({"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(40)} | {"a", "b"})
    scores = np.concatenate([[0.0], -rng.integers(1, 9, len(texts) - 1).astype(float)])
    pieces = spm.Pieces(texts, scores, np.asarray([spm.UNKNOWN] + [spm.NORMAL] * (len(texts) - 1)), spm.UNIGRAM, False)
    for n in (*range(1, 20), 60):
        words = ["".join(rng.choice(list("abcd"), n)) for _ in range(5)]
        table = spm.piece_table(np.stack([spm._codes(w) for w in words]), pieces)
        cuts = spm._cuts_by_path(table, pieces)
        for word, row in zip(words, cuts, strict=True):
            assert [*spm._long_path(word, pieces)[0].tolist(), n] == np.flatnonzero(row).tolist()


def test_best_path_equals_all_paths():
    rng = np.random.default_rng(4)
    texts = ["<unk>"] + sorted({"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(40)} | {"a", "b"})
    scores = np.concatenate([[0.0], -rng.uniform(1, 9, len(texts) - 1)])
    kinds = np.asarray([spm.UNKNOWN] + [spm.NORMAL] * (len(texts) - 1))
    pieces = spm.Pieces(texts, scores, kinds, spm.UNIGRAM, False)
    cost = dict(zip(texts[1:], scores[1:], strict=True))
    lowest = scores[1:].min() - 10

    def best(t):
        table = [0.0] + [-math.inf] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(e):
                c = cost.get(t[s:e], lowest if e - s == 1 else -math.inf)
                table[e] = max(table[e], table[s] + c)
        return table[-1]

    words = ["".join(rng.choice(list("abcd"), n)) for n in range(1, 12) for _ in range(4)]
    for word, row in zip(words, spm.encode(pa.array(words), pieces).to_pylist(), strict=True):
        parts = [texts[i] if i else None for i in row]
        if None not in parts:
            assert "".join(parts) == word and math.isclose(sum(cost[p] for p in parts), best(word))


def test_tokens_of_documents(spark):
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id bigint, text string, n_tokens int")
    rows = spm.encode_documents(d, open(TOKENIZER, "rb").read()).collect()
    assert len(rows) == len(TEXTS) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    assert spm.encode_documents(d.limit(0), open(TOKENIZER, "rb").read()).count() == 0


def brute_verdict(text):
    """The quality rules in plain Python."""
    from test_filters import WORD, counts

    n, chars, symbols, dup, repeated = counts(text)
    words, body = WORD.findall(text or ""), text or ""
    lines = [x for x in body.split("\n") if WORD.search(x)]
    w, ln = max(n, 1), max(len(lines), 1)
    metric = {
        "n_words": n, "mean_word_chars": chars / w, "symbol_ratio": symbols / w, "bang_ratio": body.count("!") / w, "stop_ratio": sum(x.lower() in quality.STOP_WORDS for x in words) / w,
        "dup_line_ratio": dup / ln, "bullet_ratio": sum(bool(re.match(r"[\x20\x09-\x0D]*[-*\u2022]", x)) for x in lines) / ln, "ellipsis_ratio": sum(bool(re.search(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$", x)) for x in lines) / ln,
    }
    rules = all((r.low is None or metric[r.metric] >= r.low) and (r.high is None or metric[r.metric] <= r.high) for r in quality.RULES)
    return n >= 20 and 100 * repeated <= 30 * n and rules


def test_pipeline_equals_brute_force(spark):
    """Each stage on what the one before kept, in plain Python over the smallest tables."""
    import sentencepiece
    from test_filters import WORD, brute_lines
    from test_near import brute_components, brute_leaks, item_shingles

    import corpus_pipeline as P

    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet").collect()
    kept = {r.doc_id: r.text for r in read("documents")}
    kept = {i: t for i, t in kept.items() if brute_verdict(t)}
    short = brute_lines(kept.items())
    kept = {i: short[i] for i, t in kept.items() if short[i] == t or WORD.search(short[i])}
    component = brute_components(list(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if component[i][1] == i}
    items = [(r.item_id, r.text) for r in read("benchmark")]
    known = {s: k for k, t in items for s in item_shingles(t)}
    suspects = [(i, t) for i, t in kept.items() if any(s in known for s in item_shingles(t))]
    leaks = {i for i, _ in brute_leaks(suspects, items)}
    kept = {i: t for i, t in kept.items() if i not in leaks}
    assert leaks and 20 < len(kept) < 200
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    got = {r.doc_id: r.token_ids for r in P.run(spark, SMALL).collect()}
    assert got == {i: library.encode(t) for i, t in kept.items()}


def test_stages_leave_clashing_columns_alone(spark):
    import corpus_pipeline as P

    names = ["__row", "__met", "__flag", "row", "lines", "hash", "h", "item_id", "size", "kept", "component_id", "k1", "at", "a.b"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wide = docs.withColumns({n: F.lit(n) for n in names})
    for name, stage in P.STAGES[:-1]:
        plain, more = stage(spark, docs, SMALL), stage(spark, wide, SMALL)
        assert more.columns == wide.columns, name
        rows = more.collect()
        assert sorted(r[0] for r in rows) == sorted(r[0] for r in plain.select("doc_id").collect()), name
        assert all(list(r[len(docs.columns) :]) == names for r in rows), name
    assert P.STAGES[-1][1](spark, wide, SMALL).count() == 200


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns, name
        n, before = out.count(), kept.count()
        assert 0 < n <= before
        kept = spark.createDataFrame(out.collect(), docs.schema)
    good = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} <= good
    final = P.run(spark, SMALL).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in kept.collect()} and all(r.round_trip for r in final)
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
