"""The operators against brute force, on a fixture with nulls, empty and long texts, copies, ties and clashing columns."""

import collections
import hashlib
import zlib

import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from beaconframe.llm import bpe, fingerprint, line_dedup, media, ngram_join, quality, tokencount, toxicity  # noqa: E402
from beaconframe.llm.common import fold  # noqa: E402

LONG = "word%d other. " * 20
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa\n" + PASSAGE, "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa\n" + PASSAGE, "a"),
    (3, "quite another text with words of its own, that is\n" + PASSAGE + "\nthe end of it all, as far as it goes", "b"),
    (4, None, "b"),
    (5, "", None),
    (6, "   \n\n ", "b"),
    (7, " ".join(f"w{i}" for i in range(30_000)), "a"),
    (8, "you are an idiot and a moron", "c"),
    (8, "you are an idiot and a moron", "c"),
    (None, "no id here but some text to read and more", "a"),
    (None, "no id here either, other words follow now", "a"),
    (9, "alpha beta", "a"),
    (10, "ALPHA beta\tgamma  é 字 😀", "b"),
] + [(100 + i, "copy of a text that many documents share with each other", "a") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "x", 1, 2.0, "y", 3, 4) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, score string, n_tokens int, text_key double, id string, `a.b` int, row int").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], int(r[0] % 3 > 0), int(r[0] == 8)) for r in ROWS if r[0] is not None] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def multiset(rows):
    return collections.Counter(map(tuple, rows))


def test_token_counts(docs, none):
    model = P.path("piece_bpe_32k.model")
    library = tokencount.load_processor(model)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t, _ in ROWS]
    assert multiset(tokencount.count_tokens(docs, model, limit=100).collect()) == multiset(want)
    assert multiset(tokencount.count_tokens(docs, model, limit=100, table_rows=1).collect()) == multiset(want)
    assert tokencount.count_tokens(none, model).count() == 0


@pytest.mark.parametrize("long_chars", [10**9, 100])
def test_bpe(docs, none, long_chars):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = bpe.Codec(path, P.PATTERN).library
    want = [(i, len(x := library.encode_ordinary(t or "")), hashlib.sha256(bpe.packed(x)).digest(), hashlib.sha256((t or "").encode()).digest()) for i, t, _ in ROWS]
    got = bpe.encode_decode(docs, path, P.PATTERN, chunk=1000, overlap=50, long_chars=long_chars, digest=True)
    assert multiset((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in got.collect()) == multiset(want)
    plain = bpe.encode_decode(docs, path, P.PATTERN, chunk=1000, overlap=50, long_chars=long_chars)
    assert multiset((r[0], bytes(r[3])) for r in plain.collect()) == multiset((i, (t or "").encode()) for i, t, _ in ROWS)
    assert bpe.encode_decode(none, path, P.PATTERN).count() == 0


def test_media(docs, none):
    got = media.media_columns(docs).collect()
    want = []
    for i, t, _ in ROWS:
        n, payload = media.text_payload(t or "")
        want.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert multiset(r[:5] for r in got) == multiset(want)
    for r in got:
        assert media.decode_png(bytes(r.media)).tobytes()[: r.n_bytes] is not None and r.media_bytes == len(r.media)
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.payload_sha256].add((r.feature, r.media_sha256))
    assert all(len(x) == 1 for x in by_text.values())
    assert media.media_columns(none).count() == 0


@pytest.mark.parametrize("tasks", [1, 4, 23])
def test_fingerprint_neighbours(docs, none, tasks):
    hashed = {r.t: r.h for r in docs.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
    order = sorted(((i, t or "") for i, t, _ in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), -hashed[r[1]]))
    want = [(i, len(t), hashlib.sha256(fingerprint.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    got = fingerprint.compare_neighbours(fingerprint.with_next(docs, tasks)).collect()
    assert multiset(r[:3] for r in got) == multiset(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.compare_neighbours(fingerprint.with_next(none)).count() == 0
    assert fingerprint.with_next(docs.where("doc_id = 7"), tasks).count() == 1


def test_fingerprint_ranges(spark):
    names = fingerprint.task_numbers(spark, 37)
    from pyspark.sql import functions as F

    dealt = spark.createDataFrame([(n,) for n in names], "task int").repartition(37, "task").withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.p for r in dealt) == list(range(37)) and all(names[r.p] == r.task for r in dealt)
    cuts = [float(c) for c in range(100, 0, -7)]
    got = spark.createDataFrame([(float(x),) for x in range(-5, 110)], "x double").select("x", fingerprint.smaller(cuts, F.col("x")).alias("n")).collect()
    assert all(r.n == sum(c > r.x for c in cuts) for r in got)


def test_quality(docs, labels, none):
    forest = quality.fit(docs, labels, trees=5)
    got = quality.quality_scores(docs, forest).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality.quality_scores(none, forest).count() == 0
    assert quality.fit(none, labels).probability([[0.0] * len(quality.FEATURES)])[0] == 0.5


def test_toxicity(docs, labels, none, spark):
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, f"you idiot number {i}" if i % 4 == 0 else f"such a moron, number {i}" if i % 4 == 1 else f"a fine text number {i} to read") for i in range(200)], "doc_id bigint, text string"))
    known = labels.unionByName(spark.createDataFrame([(1000 + i, 1, int(i % 4 < 2)) for i in range(200)], "doc_id bigint, quality int, toxic int"))
    model = toxicity.fit(many, known)
    fresh = spark.createDataFrame([(1, "what an 1d10t you are"), (2, "a fine day to read"), (3, None), (4, ""), (5, "m o r o n")], "doc_id bigint, text string")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity_scores(fresh, model).collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    assert {r.doc_id for r in toxicity.kept(fresh, model).collect()} == {2, 3, 4}
    assert toxicity.toxicity_scores(none, model).count() == 0
    unlearned = toxicity.fit(none, labels)
    assert {r.predicted for r in toxicity.toxicity_scores(docs, unlearned).collect()} == {0}


def brute_links():
    sets = [set(s.tolist()) for s in ngram_join.Shingler()([t or "" for _, t, _ in ROWS])]
    near = [[bool(a == b or a and b and ngram_join.alike(len(a), len(b), len(a & b))) for b in sets] for a in sets]
    group = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if near[i][j] and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _, _) in zip(group, ROWS):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return [(i, least[g], sum(n) - 1) for (i, _, _), g, n in zip(ROWS, group, near)]


def test_ngram_join(docs, none):
    got = ngram_join.similar_documents(docs).collect()
    assert multiset((r.doc_id, r.class_id, r.n_links) for r in got) == multiset(brute_links())
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert multiset((r.doc_id,) for r in kept.select("doc_id").collect()) == multiset([(1,), (3,), (4,), (7,), (8,), (9,), (10,), (None,), (None,), (100,)])
    assert ngram_join.similar_documents(none).count() == 0 and ngram_join.one_of_each(none).count() == 0


def test_ngram_join_large_groups(spark, monkeypatch):
    """Near copies beyond the block and node sizes: every link is counted."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    monkeypatch.setattr(ngram_join, "SMALL", 5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(30):
        words = list(base)
        words[k * 4] = f"changed{k}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [set(s.tolist()) for s in ngram_join.Shingler()([t for _, t in rows])]
    want = {k: sum(ngram_join.alike(len(a), len(b), len(a & b)) for j, b in enumerate(sets) if j != k) for k, a in enumerate(sets)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_documents(frame).collect()} == {k: (0, n) for k, n in want.items()}


def test_line_dedup(docs, none):
    assert line_dedup.deduplicated(docs).columns == docs.columns
    got = {(r.doc_id, r.text) for r in line_dedup.deduplicated(docs).collect()}
    texts = collections.defaultdict(set)
    for i, t in got:
        texts[i].add(t)
    assert texts[1] == {ROWS[0][1]}
    assert texts[2] == {""}
    assert texts[3] == {"quite another text with words of its own, that is\nthe end of it all, as far as it goes"}
    assert texts[4] == {None} and texts[5] == {""} and texts[6] == {"   \n\n "} and texts[9] == {"alpha beta"}
    assert texts[100] == {ROWS[-40][1]} and all(texts[100 + i] == {""} for i in range(1, 40))
    assert texts[8] == {ROWS[7][1]}
    assert line_dedup.deduplicated(docs).count() == len(ROWS)
    assert line_dedup.without_repeats(none).count() == 0


def test_ngram_join_finds_every_link(spark):
    """Against all pairs of documents of a whole table."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in rows.collect():
        words = (r.text or "").lower().split()
        sets[r.doc_id] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    ids = sorted(sets)
    links = {i: 0 for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
    got = {r.doc_id: r.n_links for r in ngram_join.similar_documents(rows).collect()}
    found, all_links = sum(min(got[i], links[i]) for i in ids), sum(links.values())
    assert found >= 0.99 * all_links > 0 and all(got[i] <= links[i] for i in ids)


def test_ngram_join_large_last_node(spark, monkeypatch):
    """Near copies so many that a node is large at the last level: no link is lost, in blocks of any size."""
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:-1], f"own{i}"])) for i in range(60)] + [(1000 + i, " ".join(f"x{i}_{k}" for k in range(40))) for i in range(30)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == (0, 59) for i in range(60)) and all(got[1000 + i] == (1000 + i, 0) for i in range(30))


def test_pipeline_stages_keep_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    wide = docs.withColumn("n_chars", docs.doc_id)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns, name
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, str(tmp_path)).count() == len(ROWS)


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.columns[:2] == ["doc_id", "n_tokens"]
