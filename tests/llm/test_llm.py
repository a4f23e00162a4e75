import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import decontam, html, langid, merkle, mixing, neardup, pii, quality, tokens, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string"
WORDS = "alpha beta gamma delta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.choice(["", "", "s", "ed"])) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en" if i % 2 else None, f"s{i % 3}", i, "x", "y") for i in range(40)]
    rows += [(100, None, "de", "s0", None, None, None), (101, "", None, None, 0, "", ""), (102, prose(rng, 30000), "de", "s1", 1, "x", "y"), (103, rows[3][1], "en", "s0", 1, "x", "y"),
             rows[5], (None, "no id here", "en", "s2", 1, "x", "y"), (104, "ß É ǆ İ 'S \u00a0 ﬁ e\u0301 Σ 汉字 don't!! a,.b 12,5", "fr", "s2", 1, "x", "y")]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_language_codes_are_exact():
    samples = {"a": [b"abracadabra " * 5], "b": [b"the other text of the other " * 4]}
    model = langid.PpmModel(samples)

    def bits(text, texts):  # the definition, symbol by symbol
        counts = {}
        for t in texts:
            t = langid.PAD + t
            for i in range(3, len(t)):
                for k in range(4):
                    counts.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                    counts[t[i - k : i]][t[i]] += 1
        total, t = 0.0, langid.PAD + text
        for i in range(3, len(t)):
            for k in (3, 2, 1, 0, -1):
                seen = counts.get(t[i - k : i], {}) if k >= 0 else None
                if seen is None:
                    total += 8
                elif not seen:
                    continue
                elif t[i] in seen:
                    total -= np.log2(seen[t[i]] / (sum(seen.values()) + len(seen)))
                    break
                else:
                    total -= np.log2(len(seen) / (sum(seen.values()) + len(seen)))
        return total

    for text in (b"abra the xyz", b"", b"zz", "é the".encode()):
        assert np.allclose(model.bits(text), [bits(text, samples[k]) for k in "ab"])
    assert model.predict(None) == ("und", 0.0) == model.predict("12 !") and langid.PpmModel({}).predict("abc") == ("und", 0.0)


def test_language_and_quality_keep_rows(spark, docs):
    model = langid.fit_language_model(docs)
    got = langid.predict_language(docs, model)
    assert got.count() == docs.count() and dict(got.dtypes)["score"] == "double" and {r[0] for r in got.select("lang_pred").distinct().collect()} <= {"en", "de", "fr", "und"}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    q = quality.score_quality(docs, quality.fit_quality(docs, labels))
    assert q.count() == docs.count() and q.filter("score is null or score < 0 or score > 1").count() == 0
    assert langid.predict_language(docs.limit(0), langid.fit_language_model(docs.limit(0))).count() == 0
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs.limit(0), labels)).count() == 0


def test_quality_separates_junk():
    rng = random.Random(2)
    good = [prose(rng, rng.randint(3, 80)) + "." for _ in range(300)]
    junk = [" ".join(w + "***" for w in prose(rng, 40).split()) if k % 2 else " ".join([rng.choice(WORDS)] * 40) for k in range(80)]
    m = quality.fit_nbsvm(good[:200] + junk[:50], [1] * 200 + [0] * 50)
    assert sum(m.score(t) >= 0.3 for t in good[200:]) >= 98 and sum(m.score(t) < 0.3 for t in junk[50:]) >= 28


def test_patterns_against_plain_regular_expressions():
    import re

    rng = random.Random(4)
    for _ in range(5000):
        t = "".join(rng.choice("a1 .@-+(5") for _ in range(rng.randint(0, 30)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert [s for s in pii.base_spans(t) if s[1] == 0] == want

    def plain(t):
        """The contract word by word."""
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1])) % 10 == 0:
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
        return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))

    seen = set()
    for _ in range(20000):
        t = "".join(rng.choice(["4111 1111 1111 1111", "+1 (555) 010-2345", "10.0.0.255", "a@b.co", "1", "2", "25", " ", " ", "-", ".", "x", "+", "(", "é", "@"]) for _ in range(rng.randint(0, 9)))
        assert pii.joined(pii.base_spans(t)) == plain(t), t
        seen |= {k for _, k, _ in pii.base_spans(t)}
    assert seen == {0, 1, 2, 3}
    assert [pii.KINDS[k] for _, k, _ in pii.base_spans("a.b@c.de 1.2.3.4 x 4111 1111 1111 1111, +1 (555) 010-2345 y 1.2.3.999")] == ["email", "ip", "card", "phone"]


def test_crf_adds_and_keeps(spark, docs):
    crf = pii.fit_crf()
    rows = pii.labelled_table(300, seed=7)  # sentences that training did not see
    assert sum((p == s).all() for (_, s), p in zip(rows, crf.decode([w for w, _ in rows]))) >= 285
    (base, every), none, empty = pii.all_spans(["mail a@b.co or call (212) 555-0199 now", None, ""], crf)
    assert base == [(5, 0, 11)] and every == [(5, 0, 11), (20, 3, 34)] and none == empty == ([], [])
    found = {t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.all_spans([t], crf)[0][1]] for t in ("karl at example dot com", "host 10[.]1[.]2[.]3 is down", "please call 415 555 2671 now", "phone: 020-7946-0958.", "card 4012.8888.8888.1881 ok")}
    assert list(found.values()) == [[("email", "karl at example dot com")], [("ip", "10[.]1[.]2[.]3")], [("phone", "415 555 2671")], [("phone", "020-7946-0958")], [("card", "4012.8888.8888.1881")]]
    for clean in ("in 1987 there were 15 cases and 3 dots", "isbn 978-3-16-148410-0 is a book", "look at this thing", "from 10:30 to 11:45 on 2020-05-17"):
        assert pii.all_spans([clean], crf) == [([], [])]
    got = pii.find_personal_data(docs, crf=crf)
    assert got.count() == docs.count() and got.filter("doc_id = 101").first().base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(docs.limit(0), crf=crf).count() == 0


def test_crf_by_segments_equals_whole_texts(monkeypatch):
    crf, rng = pii.fit_crf(), random.Random(5)
    for _ in range(60):
        words = [w for _ in range(4) for w in (*(rng.choice(WORDS) for _ in range(rng.randint(0, 12))), *rng.choice(pii.labelled_table(50, seed=9))[0])]
        text = " ".join(words)
        starts, ends, warm = pii._warm(text)
        move = crf.scores()
        best, back = None, []
        for e in crf.emissions(words, cold=~warm):  # the definition: Viterbi over all words, cold ones outside
            s = (move[0] if best is None else (best[:, None] + move)) + e
            back.append(np.zeros(len(e), int) if best is None else s.argmax(axis=0))
            best = s if best is None else s.max(axis=0)
        want, state = [], int(best.argmax())
        for row in back[::-1]:
            want.append(state)
            state = row[state]
        got = np.zeros(len(words), int)
        for first, _ in pii._segments(text):
            at = int(np.searchsorted(starts, first[0]))
            got[at : at + len(first)] = crf.decode([words[at : at + len(first)]])[0]
        assert got.tolist() == want[::-1]
    monkeypatch.setattr(pii, "PIECE", 7)
    rows = [w for w, _ in pii.labelled_table(40, seed=11) if len(w) > 7]
    assert all((crf._long(w) == p).all() for w, p in zip(rows, [crf.decode([w])[0] for w in rows]))


def test_encoder_equals_library_and_shards_round_trip(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, fast, rng = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(6)
    texts = ["".join(rng.choice("aB 'sté,.!\n\t\u00a0\x1c3ßÉ汉İΣe\u0301|") for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["it's WE'LL don't 'tis x's,'re", "", None]
    for t in texts:
        assert np.frombuffer(fast.encode(t), "<u2").tolist() == plain.encode(t or "", add_special_tokens=False).ids + [1], repr(t)
    got = tokens.tokenize(docs, path, f"file://{tmp_path}/t").collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got if r[0] is not None) == [w for w in want if w[0] is not None] and len(got) == len(want)
    assert tokens.tokenize(docs.limit(0), path).count() == 0
    raw = tokens.pack_shard([(7, b"", 0)], b"d" * 9, 2)
    with pytest.raises(ValueError):
        tokens.Shard(raw, b"other")


def slow_print(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_classes(ids, prints):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for i, x in zip(ids, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [least.get(x) for x in label]


def test_near_duplicates_match_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [slow_print(r.text) for r in rows]
    want = sorted(zip([str(r.doc_id) for r in rows], (f"{p:016x}" for p in prints), map(str, brute_classes([r.doc_id for r in rows], prints))))
    got = neardup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_hot_buckets_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 16)
    rng, base = random.Random(8), 0x0123456789ABCDEF
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    edges = neardup.links(df).collect()
    label = {p: p for p in prints}
    for e in edges:
        a, b = label[e.a % (1 << 64)], label[e.b % (1 << 64)]
        assert ((e.a ^ e.b) % (1 << 64)).bit_count() <= 3
        label = {k: (min(a, b) if v in (a, b) else v) for k, v in label.items()}
    want = brute_classes(prints, prints)
    assert [label[p] for p in prints] == want


def test_leaks(spark, docs):
    rng = random.Random(9)
    items = [(k, prose(rng, 25 + k)) for k in range(6)] + [(90, "two words"), (91, ""), (92, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edit = items[2][1].split()
    edit[0] = "changed"
    texts = [(1, prose(rng, 50) + " " + items[0][1].upper() + " " + prose(rng, 50)), (2, prose(rng, 90)), (3, " ".join(edit)), (4, None), (5, ""), (6, "x two Words y"), (7, items[1][1] + " and " + items[3][1])]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 0), (3, 2), (6, 90), (7, 1), (7, 3)} and got[1, 0] == 1.0 and 0.8 <= got[3, 2] < 1
    kept = decontam.drop_contaminated(spark.createDataFrame([(*t, "z") for t in texts], "doc_id long, text string, item_id string"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5] and "item_id" in kept.columns
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_urls(spark):
    odd = ["http://EXAMPLE.org/es/x?y", "https://a.example.org/en/12#t", "http://x.org/q", "http://b.com/de/1", "http://b.com/fr/1", "http://b.com", "no url", None, "", "http://notexample.org/es/", "x://org/es/a"]
    model = urls.fit_url_model(spark)
    df = spark.createDataFrame([(i, u, "mine", "h") for i, u in enumerate(odd)], "page_id int, url string, verdict string, host string")
    got = {r.page_id: r for r in urls.judge_urls(df, model).collect()}
    assert [got[i].rule for i in range(11)] == ["example.org/es/", "example.org/en/1", "org/", "com/de/", "com/fr/", None, None, None, None, "org/", "org/"]
    assert [got[i].host for i in (0, 5, 6, 7)] == ["example.org", "b.com", "", ""] and got[5].path == "" and all(r.verdict in ("allow", "block") for r in got.values())
    new = spark.createDataFrame([(0, "https://www.spam-pills.example.com/en/3", "", ""), (1, "https://blog.tiontion.example.net/en/214#top", "", "")], df.schema)
    assert [r.verdict for r in urls.judge_urls(new, model).orderBy("page_id").collect()] == ["block", "allow"]


def test_mix_equals_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want, got = con.sql(mixing.ORACLE_SQL).df(), mixing.mix(docs).drop("copies").toPandas()
    key = lambda d: sorted(d.assign(doc_id=d.doc_id.fillna(-1).astype(int))[["doc_id", "size", "source_size", "target", "taken"]].itertuples(index=False, name=None))
    assert key(got) == key(want) and (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_main_text(spark):
    page = ('<html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>The  head</h1><p>One &amp; two.<br>Three'
            '<p><b>Four</b> five.<script>x("<p>")</script></article><div class="comments"><p>Nice one.</p></div><footer>&copy; me</footer></body></html>')
    df = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (3, "", "t"), (4, "<p", "t")], "page_id int, html string, text string")
    got = {r.page_id: r for r in html.extract_main_text(df).collect()}
    assert got[1].text == "The head One & two. Three Four five." and got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == got[4].text == ""


def test_block_labeller_gradients():
    rng = np.random.default_rng(0)
    m = html.BlockLabeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, mask, y = rng.random((2, 4, html.DIM)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool), np.array([[1, 0, 1, 1], [0, 1, 0, 0]], float)
    loss = lambda: -(np.where(y > 0, np.log(p := m.forward(x, mask)[0]), np.log(1 - p)) * mask).sum() / mask.sum()
    g = m.gradients(x, mask, y)
    for k in m.w:
        at = tuple(rng.integers(n) for n in m.w[k].shape)
        old = m.w[k][at]
        m.w[k][at] = old + 1e-3
        up = loss()
        m.w[k][at] = old - 1e-3
        down = loss()
        m.w[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3


def test_merkle(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.filter("doc_id is not null and doc_id <> 5").collect()))
    got = {r.doc_id: r for r in merkle.compare_with_edits(docs.filter("doc_id is not null and doc_id <> 5")).collect()}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        new = merkle.edited(t, nxt)
        a, b, c = merkle.MerkleTree.of(t), merkle.MerkleTree.of(new), merkle.MerkleTree.of(nxt)
        assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint, got[i].edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), a.text, b.text)
        assert got[i].near_edited == a.likeness(b) and got[i].near_next == a.likeness(c) and 0 <= got[i].near_next <= 1
    assert merkle.compare_with_edits(docs).count() == docs.count() and merkle.compare_with_edits(docs.limit(0)).count() == 0
    t = "\n".join(f"line {k} of text." for k in range(100))
    mine, _ = merkle.MerkleTree.of(t).differing(merkle.MerkleTree.of(t.replace("line 50", "LINE 50")))
    assert len(mine) == 1 and merkle.MerkleTree.of(t).likeness(merkle.MerkleTree.of(t.replace("line 50", "LINE 50"))) > 0.97


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    sf = f"file://{tmp_path}"
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, docs.filter("doc_id = 102").first().text[:200])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.filter("doc_id = 102").count() == 0 and got.count() > 0


def edited_words(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"edit{k}"
    return " ".join(words)


def test_similar_groups_match_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 8)
    rng = random.Random(11)
    base, shared = [prose(rng, 120) for _ in range(6)], prose(rng, 40)
    texts = [edited_words(rng, b, n) for b in base for n in (0, 1, 2, 3, 5, 8)] + [shared + " " + prose(rng, 8) for _ in range(40)] + [r.text for r in docs.select("text").collect()]
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            alike = sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
            if alike and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    root = {r.doc_id: r.root for r in neardup.similar_groups(df).collect()}
    assert len(root) == len(texts) and len(set(zip(label, (root[i] for i in range(len(texts)))))) == len(set(label)) == len(set(root.values()))
    assert neardup.similar_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk, short", [(1024, 64), (16, 64), (1024, 4)])
def test_index_of_byte_pairs_matches_brute_force(spark, monkeypatch, chunk, short):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "SHORT", short)
    rng = random.Random(14)
    bases = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 18))) for b in bases for _ in range(3)} | {bases[0] ^ sum(1 << k for k in rng.sample(range(64), 6)) for _ in range(90)})
    near = lambda x, y: (x ^ y).bit_count() <= 14 and sum((x ^ y) >> 8 * k & 255 == 0 for k in range(8)) >= 2

    def joined(pairs):
        label = {p: p for p in prints}
        for x, y in pairs:
            a, b = sorted((label[x], label[y]))
            label = {k: a if v == b else v for k, v in label.items()}
        return label

    got = [(e.a % (1 << 64), e.b % (1 << 64)) for e in neardup.links(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long"), 14, 2).collect()]
    assert all(near(x, y) for x, y in got) and joined(got) == joined((x, y) for x in prints for y in prints if x < y and near(x, y))


def test_pipeline_near_dedup_links_by_the_byte_index(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(neardup, "_fits", lambda a, b: F.lit(False))  # prefix filtering finds nothing
    rng = random.Random(15)
    bases = [prose(rng, 200) for _ in range(5)]
    rows = [(100 * k + n, edited_words(rng, b, n % 3)) for k, b in enumerate(bases) for n in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, df, "").collect()) == [0, 100, 200, 300, 400]


def test_pipeline_members_meet_the_nearest_of_other_components():
    rng = random.Random(16)
    base = rng.getrandbits(64)
    prints = np.array([base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 14))) for _ in range(300)], np.uint64)
    label = np.array([0] * 280 + [1, 1] + list(range(2, 20)))
    for side in (None, np.arange(300) % 2):
        got = neardup.nearest_others(prints, label, side)
        assert len(got) <= neardup.NEAREST * 20  # not a pair for each member of the large component
        for i in range(280, 300):
            far = sorted(d for j in range(300) if label[j] != label[i] and (side is None or side[j] != side[i]) and (d := int(prints[i] ^ prints[j]).bit_count()) <= neardup.NEAREST_RADIUS)
            mine = [(label[y], int(prints[x] ^ prints[y]).bit_count()) for x, y in got if x == i]
            assert sorted(d for _, d in mine) == far[: neardup.NEAREST] and all(k != label[i] for k, _ in mine)


def test_pipeline_near_dedup_takes_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(12)
    base = prose(rng, 200)
    near = edited_words(rng, base, 3)
    assert (neardup.fingerprint(base) ^ neardup.fingerprint(near)).bit_count() > 3
    df = spark.createDataFrame([(1, base), (2, near), (3, prose(rng, 200))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, df, "").collect()) == [1, 3]


def test_pipeline_keeps_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(13)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(3, a, "s0"), (5, a, "s0"), (5, b, "s1"), (None, c, "s0"), (None, c, "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, df, "")
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(3, a), (5, b), (0, c)])
    want = {r.h: r.n for r in mixing.mix(df, row_key=F.col("text")).groupBy(F.col("row_key").alias("h")).agg(F.sum("copies").alias("n")).filter("n > 0").collect()}
    got = {r.text: r["count"] for r in corpus_pipeline.mix_sources(spark, df, "").groupBy("text").count().collect()}
    assert got == want and c in got
