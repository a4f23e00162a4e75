import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions.text import softmax3
from sluice.operators import classifier, dedup, features, graph, linear, metrics, mlp, similarity, splits
from sluice.sources import files


def long(spark, docs):
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, tokens array<string>")
    return features.term_counts(rows, "id", "tokens")


def test_vocabulary_and_tfidf(spark):
    c = long(spark, [["vector", "vector", "int"], ["vector", "map"], ["map", "string"]])
    vocab = features.with_idf(features.vocabulary(c, 10, 1), 3)
    got = {r.token: (r.tf, r.df, r.idf) for r in vocab.collect()}
    assert got["vector"][:2] == (3, 2) and abs(got["vector"][2] - (math.log(4 / 3) + 1)) < 1e-9 and abs(got["int"][2] - (math.log(2) + 1)) < 1e-9
    x = features.tfidf(c, vocab, "id")
    norms = {r[0]: r[1] for r in x.groupBy("id").agg(F.sum(F.col("value") ** 2)).collect()}
    assert all(abs(v - 1) < 1e-9 for v in norms.values())
    assert [r.token for r in features.vocabulary(c, 1, 2).collect()] == ["vector"]


def test_metrics_known_confusion(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 2], [0, 1, 1, 2, 2, 2])), "t int, p int")
    row = metrics.summary(df, "t", "p").first()
    assert abs(row.accuracy - 4 / 6) < 1e-9 and abs(row.macro_f1 - (2 / 3 + 0.5 + 0.8) / 3) < 1e-9
    assert metrics.confusion(df.limit(0), "t", "p").agg(F.sum("n"), F.count("*")).first()[:] == (0, 9)


def test_softmax_is_stable(spark):
    p = spark.range(1).select(*softmax3([F.lit(1000.0), F.lit(1001.0), F.lit(999.0)])).first()
    assert abs(sum(p) - 1) < 1e-9 and max(p) == p[1]


def test_full_batch_descent_overfits(spark):
    docs = [["a", "x"], ["a", "y"], ["b", "x"], ["b", "y"], ["c", "x"], ["c", "y"]]
    c = long(spark, docs)
    x = features.tfidf(c, features.with_idf(features.vocabulary(c, 10, 1), 6), "id")
    labels = spark.createDataFrame([(i, i // 2) for i in range(6)], "id long, tier int")
    w, b = linear.train_full_batch(x, labels, linear.class_weights(labels), "id", lr=8.0, l2=0.0, epochs=5)
    z = linear.logits(labels, x, w, b, "id")
    best = {r.id: int(np.argmax([r.z0, r.z1, r.z2])) for r in z.collect()}
    assert best == {i: i // 2 for i in range(6)}
    assert linear.cross_entropy(z, labels, linear.class_weights(labels), w, "id").first()[0] < 0.4


@pytest.mark.parametrize("z, text, n, session, want, conf", [
    ((0.0, 0.0, 0.0), "", 0, None, 0, 1.0), ((0.0, 0.0, 0.0), "", 0, 2, 2, 1.0), ((3.0, 0.0, 0.0), "a mutex", 12, None, 0, None), ((0.0, 0.0, 0.0), "a mutex", 5, None, 2, None),
    ((0.0, 0.5, 0.0), "What does std::move do", 5, None, 0, None), ((1.0, 0.0, 0.0), "so", 1, 1, 1, None), ((1.0, 0.98, 0.97), "x", 12, None, 2, None), ((1.0, 0.98, -1.0), "x", 10, None, 1, None)])
def test_decision_stack(spark, z, text, n, session, want, conf):
    df = spark.createDataFrame([(*z, text, n, session)], "z0 double, z1 double, z2 double, t string, n int, s int")
    row = classifier.decide(df, "t", "n", "s").first()
    assert row.predicted_tier == want and (conf is None or row.confidence == conf) and abs(row.p0 + row.p1 + row.p2 - 1) < 1e-9


def test_classifier_round_trip(spark, tmp_path):
    texts = ["explain pointer", "explain vector", "refactor parser", "refactor loader", "design deadlock", "design scheduler"]
    df = spark.createDataFrame([(i, t, i // 2) for i, t in enumerate(texts)], "id long, text string, tier int")
    m = classifier.TierClassifier().fit(df, min_df=1, lr=20.0)
    before = {r.id: r for r in m.transform(df).collect()}
    assert [before[i].predicted_tier for i in range(6)] == [0, 0, 1, 1, 2, 2]
    m.save(f"file://{tmp_path}/m")
    after = {r.id: r for r in classifier.TierClassifier.load(spark, f"file://{tmp_path}/m").transform(df).collect()}
    assert all(abs(before[i].p2 - after[i].p2) < 1e-9 for i in before)


def test_components_match_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if find(n) != n}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_search_and_links_match_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    sim = u @ u.T
    got = {(r.query_id, r.id) for r in similarity.search(df, df.filter("vec_id < 7"), threshold=0.4).collect()}
    assert got == {(i, j) for i in range(7) for j in range(60) if i != j and sim[i, j] >= 0.4}
    top = {(r.query_id, r["rank"]): r.id for r in similarity.search(df, df.filter("vec_id < 7"), top_k=5).collect()}
    for i in range(7):
        assert [top[i, k] for k in range(1, 6)] == [j for j in np.argsort(-sim[i]) if j != i][:5]
    assert {r.cluster_size for r in dedup.clusters(df, similarity.link_forest(df, 0.99), "vec_id").collect()} <= {2}


def test_greedy_drops_and_window(spark):
    pairs = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.98), (3, 4, 0.97), (8, 9, 0.5)], "id_a long, id_b long, similarity double")
    assert sorted(r.id for r in dedup.greedy_drops(pairs).collect()) == [2, 4]
    rows = spark.createDataFrame([(0, "a b c d e"), (1, "a b c d e"), (2, "x y z"), (3, None)], "seq long, text string")
    assert [r.kept for r in dedup.window_dedup(rows, "seq", "text").orderBy("seq").collect()] == [True, False, True, True]


def test_split_truncates_like_floats(spark):
    df = spark.range(90)
    counts = {r[0]: r[1] for r in splits.split(df, "id").groupBy("split").count().collect()}
    assert counts == {"train": 62, "val": 13, "test": 15}


def test_mlp_overfits():
    x = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 1], [0, 0, 1, 1]], float)
    y = np.array([0, 1, 2, 0, 2])
    m = mlp.ReluMlp(4, 8).fit(x, y, epochs=400, batch=5, l2=0.0)
    assert (m.forward(x)[1].argmax(axis=1) == y).all()


def test_jsonl_reading(spark, tmp_path):
    lines = ['{"id":"a","text":"t","label":"TIER_1_SIMPLE"}', "", "{bad", '{"text":"u","label":"2"}', '{"text":5,"label":"0"}', '{"text":"v","label":"OTHER"}', '{"label":"0"}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    got = sorted((r.id, r.text, r.tier) for r in files.read_jsonl(spark, f"file://{tmp_path}/x.jsonl").collect())
    assert got == [("a", "t", 0), ("item_4", "u", 2)]
    rows, rejected = files.read_jsonl_with_rejects(spark, f"file://{tmp_path}/x.jsonl")
    assert rejected.count() == 2 and rows.count() == 4
    assert files.read_pairs(spark, f"file://{tmp_path}/none.csv") is None


def test_all_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 20)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((70, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0] * 6), (99, None)], "vec_id long, embedding array<float>").repartition(3)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    sim = u @ u.T
    every = sim[np.triu_indices(70, 1)]
    got = similarity.all_pairs(df, 0.3).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == [(i, j) for i in range(70) for j in range(i + 1, 70) if sim[i, j] >= 0.3]
    assert all(abs(r.similarity - sim[r.id_a, r.id_b]) < 1e-12 for r in got)
    assert {r.threshold: r.n for r in similarity.all_threshold_counts(df, (0.1, 0.5, 1.1)).collect()} == {t: int((every >= t).sum()) for t in (0.1, 0.5, 1.1)}
    points = (0.0, 50.0, 75.0, 99.9, 100.0)
    found = {r.percentile: r.similarity for r in similarity.all_percentiles(df, points).collect()}
    assert all(abs(found[p] - np.percentile(every, p)) < 1e-12 for p in points)
    none = df.limit(0)
    assert similarity.all_pairs(none, 0.3).count() == 0 and {r.n for r in similarity.all_threshold_counts(none, (0.1,)).collect()} == {0} and similarity.all_percentiles(none, (50.0,)).first().similarity is None


def test_greedy_dedup_takes_every_pair(spark, tmp_path):
    from sluice.plans import registry

    spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert [r.id for r in registry.greedy_dedup(spark, f"file://{tmp_path}").collect()] == [2]
    assert [(r.query_id, r.id) for r in registry.cross_label_pairs(spark, f"file://{tmp_path}").collect()] == [(1, 2)]


def test_greedy_window_dedup_reads_documents_past_its_window(spark, tmp_path):
    from sluice.plans import registry

    texts = [f"w{i} x{i} y{i} z{i}" for i in range(260)]
    texts[230], texts[250] = texts[100], texts[5]  # the first is still among the last 200 kept, the second isn't
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.seq: r.kept for r in registry.greedy_window_dedup(spark, f"file://{tmp_path}").collect()}
    assert [i for i in range(260) if not got[i]] == [230]


def embeddings(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<float>").repartition(3)


def walked(sim, threshold):
    pairs = sorted((-round(float(sim[i, j]), 12), i, j) for i in range(len(sim)) for j in range(i + 1, len(sim)) if sim[i, j] >= threshold)
    gone = set()
    for _, i, j in pairs:
        if i not in gone and j not in gone:
            gone.add(j)
    return sorted(gone)


def cosines(x):
    u = np.asarray(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return u @ u.T


def test_greedy_rounds_over_vectors_match_the_walk_and_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 20)
    monkeypatch.setattr(similarity, "all_pairs", None)
    x = np.random.default_rng(4).standard_normal((90, 5))
    x[60:75] = x[3]  # copies: one kills all
    df = embeddings(spark, x)
    got = dedup.greedy_rounds(lambda asked, gone: similarity.threats(df, 0.5, asked, gone))
    assert sorted(r.id for r in got.collect()) == walked(cosines(x), 0.5)


def test_greedy_drops_work_through_chains_across_tasks(spark):
    rng = np.random.default_rng(6)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (300, 2)) if a < b})
    rows = [(a, b, float(rng.integers(90, 100)) / 100) for a, b in pairs]
    gone = set()
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in gone and b not in gone:
            gone.add(b)
    got = dedup.greedy_drops(spark.createDataFrame(rows, "id_a long, id_b long, similarity double"), 0.92)
    want = set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if s >= 0.92 and a not in want and b not in want:
            want.add(b)
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_reconcile_takes_every_pair_and_lists_none(spark, tmp_path, monkeypatch):
    from sluice.plans import registry

    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "all_pairs", None)
    rng = np.random.default_rng(8)
    x, labels = rng.standard_normal((300, 24)), rng.integers(0, 10, 300)
    spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    sim, gone = cosines(x), set()
    for a in range(300):
        for b in range(a + 1, 300):
            if sim[a, b] >= 0.2 and labels[a] != labels[b]:
                ta, tb, about = labels[a] % 3, labels[b] % 3, a % 200 == 0
                if {ta, tb} == {1, 2}:
                    gone.add(a if about and ta == 1 else b)
                elif not about and b % 2 == 0:
                    gone.add(b)
    got = {r.id for r in registry.reconcile_cross_label(spark, f"file://{tmp_path}").collect()}
    assert got == set(range(300)) - gone and 0 < len(got) < 300


def test_link_forest_returns_about_an_edge_a_vector(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 50)
    x = np.random.default_rng(9).standard_normal((200, 5))
    df, sim = embeddings(spark, x), cosines(x)
    edges = similarity.link_forest(df, 0.4).collect()
    root = list(range(200))
    for a, b in zip(*np.nonzero(np.triu(sim >= 0.4, 1))):
        root = [root[a] if r == root[b] else r for r in root]
    groups = len(set(root))
    mine = list(range(200))
    for a, b in edges:
        assert sim[a, b] >= 0.4
        mine = [mine[a] if r == mine[b] else r for r in mine]
    assert [mine.index(r) for r in mine] == [root.index(r) for r in root] and 200 - groups <= len(edges) < 320


def test_csv_gives_back_every_text(spark, tmp_path):
    odd = ["", None, " a ", "a\r\nb\rc\n", "\\", '"', '\\"x', "\x00z", '"\x00', '\x00"', "\t", "\n", "a,b", "null", '""', "\\N", "a\\", "\r", "\x01", "\x01\x01a", "\u2028 \u00a0 ", "\ufeffb", "# c"]
    rows = [(str(i), t) for i, t in enumerate(odd)] + [(None, "t"), ("", "u"), (" ", None)]
    files.write_csv(spark.createDataFrame(rows, "id string, text string").repartition(2), f"file://{tmp_path}/c")
    got = [(r.id, r.text) for r in files.read_csv(spark, f"file://{tmp_path}/c", "id string, text string").collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


def test_percentiles_and_counts_hold_with_equal_and_borderline_cosines(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 20)
    monkeypatch.setattr(similarity, "_each_block", None)
    x = np.random.default_rng(12).standard_normal((120, 6))
    x[40:60] = x[0]
    every = cosines(x)[np.triu_indices(120, 1)]
    points = (0.0, 1.0, 50.0, 99.0, 100.0)
    found = {r.percentile: r.similarity for r in similarity.all_percentiles(embeddings(spark, x), points).collect()}
    assert all(abs(found[p] - np.percentile(every, p)) < 1e-12 for p in points)
    t = float(np.sort(every)[3000]) - 1e-12
    assert [r.n for r in similarity.all_threshold_counts(embeddings(spark, x), (t,)).collect()] == [int((every >= t).sum())]


def test_search_holds_a_slice_of_its_queries(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE", 3)
    x = np.random.default_rng(13).standard_normal((50, 6))
    got = {(r.query_id, r["rank"]): r.id for r in similarity.search(embeddings(spark, x), embeddings(spark, x).filter("vec_id < 11"), top_k=4).collect()}
    sim = cosines(x)
    assert all([got[i, k] for k in range(1, 5)] == [j for j in np.argsort(-sim[i]) if j != i][:4] for i in range(11)) and len(got) == 44


def test_window_dedup_walks_only_rows_that_can_be_similar(spark, monkeypatch):
    rng = np.random.default_rng(14)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 400, rng.integers(1, 30))) for _ in range(150)]
    for i in range(40, 150, 3):
        words = texts[int(rng.integers(max(0, i - 30), i))].split()
        words[int(rng.integers(0, len(words)))] = "changed"
        texts[i] = " ".join(words)
    texts[5], texts[6], texts[7], texts[70] = None, "", "  A\tb ", "a B"
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    kept, want = [], []
    for s in sets:
        near = any(s and t and len(s & t) / len(s | t) > 0.5 for t in kept[-20:])
        want.append(not near)
        if not near:
            kept.append(s)
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(3)
    got = {r.seq: r.kept for r in dedup.window_dedup(rows, "seq", "text", 20, 0.5).collect()}
    assert [got[i] for i in range(150)] == want and 10 < want.count(False) < 60
    play = dedup._in_play(spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(30)] + [(98, "x y z u v"), (99, "x y z u v w")], "id long, text string"), dedup._common(rows, 3), 0.65, 3)
    assert sorted(r.id for r in play.collect()) == [98, 99]
