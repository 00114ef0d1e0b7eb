"""Each operator against a brute-force version, and on nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import math
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import ann, chat, embdedup, langid, minhash, mixing, quality, shared, toxicity, urlfilter
from wayline.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def shingles(text, k):
    w = words(text)
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {" ".join(w)} if w else set()


def groups(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ---- shared


def test_word_hashes_tell_words_apart():
    texts = ["A b\x0bc", "", "  ", "Ünïcode a\u00a0b\x85c", "a B C", "word " * 3000, "\U0001f600 x"]
    seen = {}
    for first, run in shared.chunks(texts, 100):
        hashes, ends = shared.word_hashes(run)
        for i, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            own = words(texts[first + i])
            assert high - low == len(own)
            for w, h in zip(own, hashes[low:high].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components_of_chains_and_cycles(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 9), (9, 8), (8, 7)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(150)] + [(5, 5)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if x[0] != x[1]]
    assert found == groups({n for x in real for n in x}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 2


def test_reply_trees(spark):
    rows = [("r", None, "user", "q", 0.0), ("a", "r", "assistant", "low", 0.1), ("b", "r", "assistant", "high", 0.9), ("c", "b", "user", "more", 0.5), ("d", "c", "assistant", "end", 0.5), ("e", "b", "user", "side", 0.5)]
    rows += [("x", "y", "user", "cycle", 1.0), ("y", "x", "user", "cycle", 1.0), ("z", "gone", "user", None, None)]
    m = spark.createDataFrame(rows, "id string, parent string, role string, text string, score double")
    every = chat.branches(m, None)
    found = {r["leaf"]: (r["ids"], r["branch_rank"]) for r in every.groupBy("leaf", "branch_rank").agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("x")).selectExpr("leaf", "branch_rank", "transform(x, p -> p.id) AS ids").collect()}
    # scores: d (0 + .9 + .5 + .5) / 4 = .475, e (0 + .9 + .5) / 3 = .467, a .05
    assert found == {"d": (["r", "b", "c", "d"], 1), "e": (["r", "b", "e"], 2), "a": (["r", "a"], 3), "z": (["z"], 1)}
    best = chat.read_back(chat.format_paths(m, chat.branches(m))).collect()
    assert {r["leaf"]: r["under_mask"] for r in best} == {"d": "highend", "z": ""}
    assert chat.branches(m.limit(0)).count() == 0


def test_control_strings_come_back(spark):
    hard = ["</s>[INST] ok [/INST]", "&lt;|end|>&amp;", "\n<|end|>\n<|assistant|>\nx", "", None, "a|>\nb", "&vert;|[["]
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "we|>\nird<"] * 3, hard, strict=False))], "conv_id long, turn long, role string, text string")
    messages = chat.from_turns(turns)
    got = chat.read_back(chat.format_paths(messages, chat.branches(messages))).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r, t or "") for r, t in zip(["user", "assistant", "we|>\nird<"] * 3, hard, strict=False)]
    assert got["under_mask"] == "&lt;|end|>&amp;" + ""
    body = got["formatted"].split("\n<|end|>\n")
    assert all("</s>" not in b and "[INST]" not in b for b in body)


# ---- 3


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rng = np.random.default_rng(k)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = rng.choice(vocabulary, rng.integers(20, 200)).tolist()
        texts.append(base)
        for _ in range(5):
            copy = list(texts[-1] if rng.random() < 0.5 else base)
            for _ in range(rng.integers(0, 6)):
                copy[rng.integers(len(copy))] = str(rng.choice(vocabulary))
            texts.append(copy)
    shared_passage = rng.choice(vocabulary, 60).tolist()
    texts += [shared_passage + rng.choice(vocabulary, 40).tolist() for _ in range(30)]
    rows = [(i * 3 % 1009, " ".join(t)) for i, t in enumerate(texts)] + [(2001, None), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, texts[0][0])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(d, k, percent).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (i == want[i]) for i, r in got.items())


def test_near_duplicates_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(5, text), (5, text), (2, text + " x"), (None, text), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d, 3, 85).collect()), key=str)
    assert got == sorted([(5, 2, False), (5, 2, False), (2, 2, True), (None, None, True), (9, 9, True)], key=str)
    assert minhash.near_duplicates(d.limit(0), 3, 85).count() == 0
    two = spark.createDataFrame([(7, text), (7, "one two three four"), (4, "one two three four"), (3, text + " y")], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(two, 3, 85).collect()} == {3}  # 7 is both texts
    again = spark.createDataFrame([(1, "a b c d", "p"), (1, "a b c d", "p"), (2, "e f g h", "q")], "doc_id long, text string, row string")
    assert sorted(r["doc_id"] for r in minhash.keep_one(again).collect()) == [1, 2]


def test_superminhash_estimates(spark):
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        pool = shared.mix(rng.integers(0, 1 << 62, 150).astype(np.uint64))
        a, b = pool[:100], pool[50:]
        errors.append((minhash.signature(a, 128) == minhash.signature(b, 128)).mean() - 50 / 150)
    assert abs(np.mean(errors)) < 0.02
    assert np.isfinite(minhash.signature(pool[:1], 128)).all() and sorted(np.floor(minhash.signature(pool[:1], 128))) == list(range(128))  # one element fills each place at its own step


# ---- 4


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([0, 10], [5, 2], 1.5, 2) == [0, 15] and mixing.targets([], [], 1.5, 2) == []


def test_quotas_are_split_exactly():
    quotas = [1000, 3, 0, 77]
    out = mixing.split_quotas(quotas, 7, 1)
    assert out.sum(0).tolist() == quotas and out.sum(1).max() - out.sum(1).min() <= 3
    assert (out == mixing.split_quotas(quotas, 7, 1)).all()


def test_blocks_are_dealt_as_the_tree_says(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 9))), "en", "abc"[min(2, i % 7)], 0) for i in range(3000)]
    d = spark.createDataFrame(rows, DOCS)
    made = mixing.plan(mixing.sized(d), shards=6, seed=9)
    blocks = made.blocks.collect()
    # brute force: each source's draws, pass after pass in the permuted order of its blocks, go to shards by the tree's exact quotas
    drawn = {}
    for r in blocks:
        for x in r["_draws"]:
            drawn.setdefault(r["_source"], []).append((x["copy"], r["_block"], x["shard"]))
    keys = sorted(drawn, key=lambda k: (k == "~", k))
    quotas = [len(drawn[k]) for k in keys]
    dealt = mixing.split_quotas(quotas, 6, 9)
    for i, k in enumerate(keys):
        assert [sum(x[2] == shard for x in drawn[k]) for shard in range(6)] == dealt[:, i].tolist()
        assert len({x[:2] for x in drawn[k]}) == len(drawn[k])  # disjoint
    told = [{(r["doc_id"], *r["shards"]) for r in mixing.amounts(d, shards=n, seed=9).collect()} for n in (2, 6)]
    assert told[0] != told[1]  # the result says where the tree sends each copy


def test_splits_follow_the_distribution():
    # the first of two shards takes half of all draws; of a source it takes a hypergeometric number
    quotas, n = [12, 20, 8], 4000
    first = np.array([mixing.split_quotas(quotas, 2, seed)[0] for seed in range(n)])
    assert (first.sum(1) == 20).all()
    for i, q in enumerate(quotas):
        chance = np.array([math.comb(q, x) * math.comb(40 - q, 20 - x) / math.comb(40, 20) for x in range(q + 1)])
        assert np.abs(np.bincount(first[:, i], minlength=q + 1) / n - chance).max() < 0.03


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "en", ["b", "a", None, "é"][i % 4 if i % 3 else 0], 0) for i in range(800)] + [(9000, None, None, "b", 0), (1, "again and again", "en", "b", 0), (None, "no id", "en", "a", 0)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.amounts(d).collect()
    assert len(got) == len(rows)
    source = {("b", 5), ("a", 5)}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) and len(r["shards"]) == (r["taken"] // r["size"] if r["size"] else len(r["shards"]))
        target[r["source_size"]] = r["target"]
        size[r["source_size"]] += r["size"]
        taken[r["source_size"]] += r["taken"]
    assert all(k == v for k, v in size.items())
    want = {}
    for _, text, _, s, _ in rows:
        want[s] = want.get(s, 0) + len(words(text))
    order = sorted((s for s in want if s is not None)) + [None]
    assert target == {want[s]: pytest.approx(t) for s, t in zip(order, mixing.targets([want[s] for s in order], [5, 2, 1, 5], 1.5, 2), strict=True)}
    assert all(abs(taken[k] - t) <= 0.01 * t + 30 for k, t in target.items()) and source
    assert sorted(map(str, got)) == sorted(map(str, mixing.amounts(d.orderBy(F.rand(3)).repartition(5)).collect()))
    made = mixing.mix(d.withColumn("_block", F.lit("clash")))
    assert made.count() == sum(r["taken"] // r["size"] if r["size"] else len(r["shards"]) for r in got) and set(made.select("row._block").distinct().collect()[0]) == {"clash"}
    assert mixing.amounts(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0


# ---- 5 and 8


def test_language_of_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d, langid.fit(d, shared.fold_of(F.col("doc_id")) != 2)).join(d.select("doc_id", "lang"), "doc_id").filter(shared.fold_of(F.col("doc_id")) == 2)
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()


def test_language_edges(spark):
    d = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "hello there", "en"), (4, "hello there", None), (None, "ß", "en")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.fit(d, F.lit(True))
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(d, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "en")], key=str)
    assert langid.fit(d.limit(0), F.lit(True)) is None and {r["lang_pred"] for r in langid.identify(d, None).collect()} == {"und"}


def plain_subwords(text):
    """Bytes of letters between blanks; each run of 2 to 4 bytes of a word with its two edges, but for runs that are blank at both ends."""
    low = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    for word in low.split():
        edged = b" " + word + b" "
        for n, times in ((2, 2654435761), (3, 2246822519), (4, 3266489917)):
            for at in range(len(edged) - n + 1):
                part = edged[at : at + n]
                if not (part[:1] == b" " and part[-1:] == b" "):
                    yield (int.from_bytes(part, "little") * times & 0xFFFFFFFF) >> 17


def test_language_scores_are_those_of_a_plain_walk(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL")
    model = langid.fit(d, F.lit(True))
    texts = [r["text"] for r in d.orderBy("doc_id").limit(40).collect()] + ["a", "to be", "İß x9y", "zz " * 5000, "!"]
    got = model.predict(texts)
    for text, best, score in zip(texts, *got, strict=True):
        found = list(plain_subwords(text))
        logits = [(sum(float(model.table[i, k]) for i in found) / max(1, len(found)) + model.bias[k]) / model.temperature for k in range(len(model.labels))]
        p = [np.exp(x - max(logits)) for x in logits]
        assert score == pytest.approx(max(p) / sum(p), abs=1e-6) and best == int(np.argmax(p))
        alone = model.predict([text])  # neighbours in a batch don't matter
        assert alone[0][0] == best and alone[1][0] == pytest.approx(score, abs=1e-9)


def test_language_sample_is_bounded_by_rows(spark):
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("hello number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    copies = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("guten tag").alias("text"), F.lit("de").alias("lang"))
    sample, labels = langid.drawn(same.unionByName(copies), 400)
    many = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert labels == ["de", "en"] and many == {"de": 1, "en": 400}


def test_toxicity_scores_dont_depend_on_neighbours(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, labels, shared.fold_of(F.col("doc_id")) != 2)
    texts = [r["text"] for r in d.filter("text IS NOT NULL").orderBy("doc_id").limit(60).collect()] + ["", "idiot", "x" * 50_000]
    together = model.score(texts)
    assert together == pytest.approx([float(model.score([t])[0]) for t in texts], abs=1e-12)


def test_toxicity_of_held_out_texts(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, labels, shared.fold_of(F.col("doc_id")) != 2)
    got = toxicity.judge(d, model).join(labels, "doc_id").filter(shared.fold_of(F.col("doc_id")) == 2)
    toxic, clean = got.filter("toxic = 1"), got.filter("toxic = 0")
    assert toxic.filter("predicted = 1").count() >= 0.75 * toxic.count() and clean.filter("predicted = 1").count() <= 0.01 * clean.count()
    assert toxicity.clean(d, model).count() == toxicity.judge(d, model).filter("predicted = 0").count()


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (None, "idiot")], "doc_id long, text string").withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, None), (2, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.fit(d, none, F.lit(True)) is None
    for model in (None, toxicity.fit(d, one, F.lit(True)), toxicity.fit(d, one.filter("toxic = 0"), F.lit(True))):
        rows = toxicity.judge(d, model).collect()
        assert len(rows) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.judge(d.limit(0), model).count() == 0 and toxicity.clean(d, model).columns == d.columns


def test_label_model_discounts_copies():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    voter = lambda hit, false: np.where(y, rng.random(4000) < hit, rng.random(4000) < false).astype(float)
    good = [voter(0.9, 0.05) for _ in range(3)]
    noise = voter(0.5, 0.45)
    q, learned = toxicity.label_model(np.stack([*good, noise, noise, noise], 1), 0.3)
    assert ((q > 0.5) == y).mean() > 0.95
    assert learned["share"][3:].max() < 0.5 < learned["share"][:3].min()  # three copies share what one would say
    assert np.abs(learned["rates"][1, :3] - 0.9).max() < 0.05


# ---- 6


def test_urls(spark):
    pages = [(1, "http://a.EXAMPLE.net/en/x?y#z"), (2, "https://example.net/EN/"), (3, "ftp://net"), (4, "x://net/"), (5, "x://planet/"), (6, "mailto:a@b"), (7, None), (8, "http://m.org/fr/"), (9, "http://www.example.com/de/1"), (9, "http://www.example.com/de/1"), (None, "a://b\n/c\nd?"), (10, "http://é.net/ü")]
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")), rules).collect() if r["page_id"])
    assert [g for g in got if g[0] != "10"] == [
        ("1", "a.example.net", "/en/x", "example.net/en/", "allow"), ("2", "example.net", "/EN/", "net/", "block"), ("3", "net", "", None, "allow"), ("4", "net", "/", "net/", "block"), ("5", "planet", "/", None, "allow"),
        ("6", "", "", None, "allow"), ("7", "", "", None, "allow"), ("8", "m.org", "/fr/", "org/fr/", "allow"), ("9", "www.example.com", "/de/1", "example.com/de/", "block"), ("9", "www.example.com", "/de/1", "example.com/de/", "block"),
    ]
    many = spark.range(3000).selectExpr("concat('h', id, '.test') AS host", "'/' AS path", "'block' AS verdict")
    urls = spark.range(6000).selectExpr("id AS page_id", "concat('http://h', id, '.test/p') AS url")
    judged = urlfilter.judge(urls, many).filter("verdict = 'block'")
    assert judged.count() == 3000 and judged.filter("page_id >= 3000").count() == 0
    assert urlfilter.judge(urls.limit(0), rules).count() == 0 and urlfilter.judge(urls, rules.limit(0)).filter("verdict = 'block'").count() == 0


# ---- 7


def kneser_ney(texts, order):
    """Probabilities by the textbook, with dictionaries."""
    counts = Counter(x for t in texts for s in ["\0" * (order - 1) + t] for x in (s[i : i + order] for i in range(len(t))))
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    off = {}
    for n, t in tables.items():
        n1, n2, n3, n4 = (sum(v == k for v in t.values()) for k in (1, 2, 3, 4))
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            off[n] = [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]
        else:
            off[n] = [0.5, 0.75, 0.9]

    def p(g):
        n = len(g)
        if not n:
            return 1 / 4096
        same = [v for x, v in tables[n].items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        d = lambda v: off[n][min(v, 3) - 1]
        own = tables[n].get(g, 0)
        return (own - d(own) if own else 0) / sum(same) + sum(map(d, same)) / sum(same) * p(g[1:])

    return lambda t: math.exp(-sum(math.log(p(("\0" * (order - 1) + t)[i : i + order])) for i in range(len(t))) / len(t))


def test_perplexity_equals_the_textbook(spark):
    good = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "on the mat the cat"]
    asked = ["the cat", "zzz", "é the", "", None, "the dog sat on a mat" * 3]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(asked)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["log_ppl"] for r in quality.score(d, spark.createDataFrame([(t,) for t in good], "text string")).collect()}
    plain = kneser_ney(good, quality.ORDER)
    for i, t in enumerate(asked):
        assert got[i] is None if not t else math.exp(got[i]) == pytest.approx(plain(t), rel=1e-4)


def test_quality_keeps_clean_texts(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(d, labels, shared.fold_of(F.col("doc_id")) == 2).join(labels, "doc_id")
    assert got.filter("quality = 1 AND rejected").count() <= 0.01 * got.filter("quality = 1").count()
    assert got.filter("quality = 0 AND rejected").count() >= 0.6 * got.filter("quality = 0").count()


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "text " * 50_000, "en"), (3, "text", "en"), (None, "漢字😀", None)], "doc_id long, text string, lang string").withColumn("rejected", F.lit("x"))
    for labels in ([], [(3, 1), (None, 1), (2, 0)]):
        l = spark.createDataFrame(labels, "doc_id long, quality int")
        assert quality.judge(d, l, F.lit(False)).filter("rejected").count() == 0
        kept = quality.accepted(d.repartition(3), l, F.col("doc_id") == 3)
        assert kept.columns == d.columns and kept.count() == 5
    assert quality.judge(d.limit(0), l, F.lit(False)).count() == 0


# ---- 9 and 10


def vectors(rng, n, groups_, size=16):
    centers = rng.normal(size=(groups_, size))
    return [(centers[i % groups_] + rng.normal(size=size) * rng.choice([0.02, 0.1, 0.3])).tolist() for i in range(n)]


ODD = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]


def sound(v):
    return v is not None and None not in v and all(map(math.isfinite, v)) and any(v)


@pytest.mark.parametrize("small", [False, True])
def test_embedding_links_equal_brute_force(spark, small, monkeypatch):
    if small:  # many cells and blocks
        monkeypatch.setattr(embdedup, "PER_CELL", 12)
        monkeypatch.setattr(embdedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    vs = vectors(rng, 240, 20)
    vs += [vs[0]] * 4 + [[x * 3 for x in vs[1]]] + ODD
    rows = [(i * 7 % 1009, v, [0, 1, None][min(i % 9, 2) if i % 9 < 3 else 0]) for i, v in enumerate(vs)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1))
    links = []
    for (a, x, p), (b, y, q) in combinations(rows, 2):
        if p == q and p is not None and sound(x) and sound(y) and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
            links.append((a, b))
    degree = Counter(n for x in links for n in x)
    want = groups([r[0] for r in rows], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_duplicates(d).collect()}
    assert got == {i: (degree[i], want[i], want[i] == i) for i, _, _ in rows}
    assert embdedup.near_duplicates(d.limit(0)).count() == 0


def test_embeddings_with_repeated_ids(spark):
    a, b = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    near = lambda v, x: [c + x * (i == 5) for i, c in enumerate(v)]
    rows = [(1, a, 0), (1, b, 0), (2, near(a, 0.01), 0), (3, near(b, 0.01), 0), (4, near(b, 0.02), 0), (None, a, 0), (7, b, 1)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted([("1", 1, 1, True), ("1", 2, 1, True), ("2", 1, 1, False), ("3", 2, 1, False), ("4", 2, 1, False), ("None", 0, None, True), ("7", 0, 7, True)])


def test_search_finds_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_BLOCK", 700)
    monkeypatch.setattr(ann, "QUERIES_BLOCK", 9)
    rng = np.random.default_rng(7)
    vs = vectors(rng, 2000, 50) + ODD
    vs[30:60] = [vs[20]] * 30  # more ties than places
    d = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>").withColumn("norm", F.lit("x"))
    got = {}
    for r in ann.search(d, F.col("vec_id") % 20 == 0, 10, rerank=60).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: np.array(v) for i, v in enumerate(vs) if sound(v) and len(v) == 16}
    hits = total = 0
    for q in [i for i in ok if i % 20 == 0]:
        best = sorted((float(np.sqrt(np.cumsum((ok[i] - ok[q]) ** 2)[-1])), i) for i in ok if i != q)[:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        assert all(s == float(np.sqrt(np.cumsum((ok[i] - ok[q]) ** 2)[-1])) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in best})
        total += 10
    assert hits >= 0.95 * total and [i for _, i, _ in sorted(got[20])] == list(range(30, 40))
    # other lengths are searched among themselves, also where the sample lacks them
    odd = [(5000 + i, [float(i), 1.0, 2.0]) for i in range(1, 30)]
    lengths = ann.search(d.select("vec_id", "embedding").unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<double>")), F.col("vec_id") == 5020, 3).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(lengths, key=lambda r: r["rank"])] == [(5019, 1.0), (5021, 1.0), (5018, 2.0)]
    monkeypatch.setattr(ann, "SAMPLE", 300)
    monkeypatch.setattr(ann, "PER_CELL", 100)  # many cells, and a table of several samples' size
    hits = 0
    for r in ann.search(d, F.col("vec_id") % 20 == 0, 10, rerank=60).collect():
        best = sorted((float(np.sqrt(np.cumsum((ok[i] - ok[r["query_id"]]) ** 2)[-1])), i) for i in ok if i != r["query_id"])[:10]
        hits += r["vec_id"] in {i for _, i in best}
    assert hits >= 0.9 * total
    few = ann.search(d.limit(4), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3] and ann.search(d.limit(0), F.lit(True)).count() == 0


def test_beam_search_beats_greedy_encoding():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16))
    q = ann.train(x, stages=4, words=32)
    for beam in (1, 6):
        codes, norms = q.encode(x, beam)
        sums = sum(q.books[m][codes[:, m]] for m in range(4))
        assert norms == pytest.approx((sums**2).sum(1))
        error = ((x - sums) ** 2).sum(1).mean()
        worst = error if beam == 1 else worst
    assert error < worst
    v = x[0]
    assert q.distances(v, codes, norms) + (v * v).sum() == pytest.approx(((sums - v) ** 2).sum(1))
