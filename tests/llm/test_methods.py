"""What the methods find, against plain computations on small inputs."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from roadloom.llm import graph, jaccard_join, line_dedup, mixing, packing, quality_rules, secret_scan, sharding, topk_search, toxicity, url_filter

from .conftest import words


def test_entropy_windows_equal_plain_ones(docs):
    rng = random.Random(3)
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    secret = "".join(rng.choice(alphabet) for _ in range(48))
    blob = "Aa1" * 10 + secret
    text = f"möre text {blob} and password = hunter2hunter2 {'0' * 8}"
    spans = secret_scan.scan(docs(text)).first()["spans"]
    at, covered = text.index(blob), []
    for i in range(len(blob) - 19):
        c = Counter(blob[i : i + 20])
        bits = math.log2(20) - sum(n * math.log2(n) for n in c.values()) / 20
        if bits >= secret_scan.MIXED_BITS - 1e-9:
            if covered and covered[-1][1] >= at + i:
                covered[-1][1] = at + i + 20
            else:
                covered.append([at + i, at + i + 20])
    assert covered and [[s["start"], s["end"]] for s in spans if s["kind"] == "entropy_mixed"] == covered
    assert [(s["start"], text[s["start"] : s["end"]]) for s in spans if s["kind"] == "assign"] == [(text.index("password"), "password = hunter2hunter2")]


def test_allow_list(docs):
    rng = random.Random(5)
    key = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(40))
    found = [r["spans"] for r in secret_scan.scan(docs(f"see {key} there", f"sha256: {key} there", f"see EXAMPLE{key} there")).collect()]
    assert [len(s) > 0 for s in found] == [True, False, False]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"])
def test_keys_of_every_alphabet_are_scanned(docs, alphabet):
    rng = random.Random(11)
    key = "".join(rng.choice(alphabet) for _ in range(60))
    texts = (f"see {key} there", f"see example_x={key} there", f"see {key}/{'A' * 8}/{key} there", f"see {key}EXAMPLE there")
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs(*texts)).collect()}
    assert found[0] and found[1] and not found[3]
    assert {s["start"] < 64 for s in found[2]} == {True, False}  # on both sides of the run
    harmless = f"see {'a-very-long-' * 5} and {'xyz' * 20} there"
    assert not secret_scan.scan(docs(harmless)).first()["spans"]


def test_quality_rejects_documents_of_frequent_lines(docs):
    menu = "\n".join(f"menu line {chr(97 + i)} of this very site with words" for i in range(6))
    texts = [menu + f"\nlast{i} bit{i}" for i in range(30)] + [menu + "\n" + words(200, 1000 * i) for i in range(5)]
    out = quality_rules.judged(docs(*texts, sources=["h"] * 35)).orderBy("doc_id").collect()
    assert [r["kept"] for r in out] == [False] * 30 + [True] * 5
    twice = quality_rules.judged(docs(*texts * 2, sources=["h"] * 70, ids=[*range(35)] * 2)).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in twice) == Counter({(i, i >= 30): 2 for i in range(35)})  # repeated rows are one document
    clean = {r["doc_id"]: r["text"] for r in quality_rules.cleaned(docs(*texts, None, sources=["h"] * 36)).collect()}
    assert clean[0] == "" and clean[30] == words(200, 0) and clean[35] is None


def test_line_runs(docs):
    a, b, c = (words(20, 100 * i, "run") for i in range(3))
    run = f"{a}\n{b}\n{c}"
    out = {r["doc_id"]: r["text"] for r in line_dedup.deduped(docs(f"own0 x\n{run}", f"{run}\nown1 y", f"{a}\n{b}\nown2 z", f"{a}\n\n{b}\n{c}")).collect()}
    assert out == {0: f"own0 x\n{run}", 1: "own1 y", 2: f"{a}\n{b}\nown2 z", 3: ""}


def test_line_runs_equal_plain_ones(docs):
    rng = random.Random(1)
    pool = [words(rng.choice((4, 9, 30)), 50 * i, "l") for i in range(12)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    first, expect = {}, {}
    for d, t in enumerate(texts):
        lines, gone = t.split("\n"), set()
        n = [len(x.split()) for x in lines]
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                if sum(n[s : e + 1]) >= 50:
                    f = first.setdefault(tuple(lines[s : e + 1]), (d, s))
                    if f != (d, s):
                        gone.update(range(s if f[0] != d else max(s, f[1] + e + 1 - s), e + 1))
        expect[d] = len(gone)
    assert {r["doc_id"]: r["removed_lines"] for r in line_dedup.deduped(docs(*texts)).collect()} == expect


def test_passages_equal_plain_ones(docs):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(400)]
    texts = []
    for d in range(40):
        own = [f"d{d}x{i}" for i in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            a, at = rng.randrange(350), rng.randint(0, len(own))
            own[at:at] = base[a : a + rng.randint(30, 110)]
        texts.append("".join(w + rng.choice("   \n") for w in own))
    texts.append(" ".join(base[:7] * 12))  # a passage that overlaps itself
    first, gone = {}, {}
    for d, t in enumerate(texts):
        ws, gone[d] = t.split(), set()
        for p in range(len(ws) - 49):
            f = first.setdefault(tuple(ws[p : p + 50]), (d, p))
            if f != (d, p):
                gone[d].update(range(p if f[0] != d else max(p, f[1] + 50), p + 50))
    out = {r["doc_id"]: r for r in line_dedup.deduped(docs(*texts)).collect()}
    assert sum(map(len, gone.values())) > 500
    for d, t in enumerate(texts):
        assert out[d]["removed_words"] == len(gone[d])
        assert out[d]["text"].split() == [w for i, w in enumerate(t.split()) if i not in gone[d]]


def test_water_filling(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 100), ("d", 5), ("e", 700)]
    df = spark.createDataFrame([(False, s, n) for s, n in sizes], "s_null boolean, s string, size bigint")
    got = {r["s"]: r["target"] for r in mixing.targets(df).collect()}
    left, free, fixed = 1815.0, dict(zip("abcde", (1, 2, 3, 1, 2), strict=True)), {}
    size = dict(sizes)
    while True:
        over = [s for s, w in free.items() if w * (left - sum(fixed.values())) / sum(free.values()) > 3 * size[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 3 * size[s]
            del free[s]
    for s, w in free.items():
        fixed.setdefault(s, None)
    share = left - sum(v for v in fixed.values() if v)
    want = {s: v if v else free[s] * share / sum(free.values()) for s, v in fixed.items()}
    assert got == pytest.approx(want)


def test_mix_is_near_its_targets(docs):
    texts = [words(10 + i % 7, stem="m") for i in range(300)]
    d = docs(*texts, sources=["big" if i % 3 else f"s{i % 4}" for i in range(300)])
    out = mixing.mix(d).collect()
    per = {}
    for r in out:
        per.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - target) <= 16 for (_, target), v in per.items())
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()))


def test_packing_holds_all_ids(docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    texts = [words(n, stem="pack") + " It's <|endoftext|> Ünïcode\x1cend" for n in (1, 5, 900, 2500, 30, 400)] * 4
    whole = Tokenizer.from_file(path)
    out = packing.packed(docs(*texts), path, window=512, open_windows=3).collect()
    for i, t in enumerate(texts):
        pieces = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in out if r["doc_id"] == i)
        assert [x for _, p in pieces for x in p] == [*whole.encode(t, add_special_tokens=False).ids, 1]
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert sum(1 for n in fill.values() if n < 512 - packing.TOLERANCE) <= 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 90)] + [(rng.randrange(2000, 2080), rng.randrange(2000, 2080)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


def edited(base, rng, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize(("n", "similarity"), [(4, Fraction(85, 100)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_jaccard_equals_all_pairs(docs, n, similarity):
    rng, texts = random.Random(n), []
    for size in (3, 8, 30, 60, 120, 300):
        base = [f"b{size}x{rng.randrange(10**6)}" for _ in range(size)]
        texts += [edited(base, rng, rng.randrange(0, 2 + size // 12)) for _ in range(45)]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if similarity.denominator * both >= similarity.numerator * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    classes = {}
    for r in jaccard_join.classed(jaccard_join.join(docs(*texts), n, similarity)).collect():
        classes.setdefault(r["component"], set()).add(r["doc_id"])
    expect = {}
    for i in range(len(texts)):
        expect.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expect.values()))


def test_toxic_documents_are_found_held_out(spark, docs):
    rng = random.Random(4)
    plain = [f"plain{i}" for i in range(400)]
    bad = ["vilest", "wormlike", "grubbiest", "vilely"]
    toxic = [i % 4 == 0 for i in range(600)]
    texts = [" ".join([rng.choice(plain) for _ in range(60)] + [rng.choice(bad) for _ in range(rng.randint(1, 5))] * t) for t in toxic]
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic) if i < 400], "doc_id bigint, toxic int")
    d = docs(*texts)
    out = {r["doc_id"]: r for r in toxicity.graded(d, toxicity.trained(d, labels)).collect()}
    held = range(400, 600)
    assert sum((out[i]["p_toxic"] >= 0.5) == toxic[i] for i in held) >= 196
    assert all(0 <= r["severity"] <= toxicity.GRADES - 1 for r in out.values())


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-30, 30, (300, 8))
    v[100:160] = v[100]  # ties
    df = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, v array<bigint>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.search(df, df.where("vec_id % 20 = 0")).collect())
    want = []
    for q in range(0, 300, 20):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    assert got == sorted(want)


def test_shards_keep_copies_together_and_sizes_even(docs):
    texts = [words(5, 10 * i) for i in range(200)] + [t for i in range(60) for t in [words(8, 10 * i, "twin")] * 3]
    out = sharding.sharded(docs(*texts), 4).collect()
    sizes, places = Counter(), {}
    for r in out:
        sizes[r["shard"]] += r["size"]
        places.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert max(sizes.values()) - min(sizes.values()) <= 200
    assert sum(len(p) > 1 for p in places.values()) <= 30  # of 60 groups; seeded at random, about 56 were apart


def test_groups_that_fit_a_shard_arent_split(docs):
    rng = random.Random(9)
    texts = [words(5, 10 * i) for i in range(3000)] + [t for i in range(150) for t in [words(rng.choice((8, 30, 200)), 1000 * i, "twin")] * rng.randint(2, 4)]
    rng.shuffle(texts)
    rows, links = sharding.documents_of(docs(*texts))
    state = sharding.even_out(sharding.propagate(rows, links, 4), 4)
    assert sharding.cut_links(state, links).first() == (150, 0)
    sizes = [r["n"] for r in state.selectExpr("shard", "size").groupBy("shard").agg({"size": "sum"}).toDF("shard", "n").collect()]
    assert max(sizes) - min(sizes) <= 200


def test_block_spreads_to_aliases(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    pages = [
        (1, "http://a.example.org/es/1", None), (2, "http://mirror.net/x", link.format("http://a.example.org/es/1")), (3, "https://www.mirror.net/x/?utm_source=f", None),
        (4, "http://b.org/y", link.format("http://mirror.net/x")), (5, "http://mirror.net/z", "<meta http-equiv='refresh' content='0; url=/x'>"), (6, "http://other.net/", None),
    ]
    out = {r["page_id"]: r["verdict"] for r in url_filter.judged(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow"}


def test_redirects_decide_over_pages_without_rules(spark):
    """Chains of redirects, canonical links and sites' own redirects, against plain components."""
    rng = random.Random(8)
    canonical, refresh = '<link rel="canonical" href="{}">', "<meta http-equiv=\"refresh\" content=\"0; url={}\">"
    pages, parent = [], {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    urls = [f"http://h{i}.net/{i}" for i in range(60)] + [f"http://m{i}.com/de/{i}" for i in range(6)] + [f"http://m{i}.com/fr/{i}" for i in range(6)]
    for i, url in enumerate(urls):
        to = rng.choice(urls) if rng.random() < 0.6 else None
        variant = rng.choice(("{}", "{}/", "{}?utm_source=x", "{}#top", "{}/index.html"))
        pages.append((i, variant.format(url).replace("http://", rng.choice(("http://", "https://www."))), rng.choice((canonical, refresh)).format(to) if to else None))
        if to:
            parent[root(url)] = root(to)
        root(url)
    blocked = {root(u) for u in urls if "/de/" in u}
    want = {i: "allow" if "/fr/" in u else "block" if root(u) in blocked else "allow" for i, u in enumerate(urls)}
    out = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.judged(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert {k: v for k, (v, _) in out.items()} == want
    assert sum(v == "block" and r is None for v, r in out.values()) >= 5  # the method alone decides these


def test_mix_counts_repeated_rows(docs):
    d = docs(*[words(10)] * 100, *[words(10, 50 * i) for i in range(20)], sources=["a"] * 100 + ["b"] * 20, ids=[7] * 100 + [*range(20)])
    out = mixing.mix(d, (2, 3)).collect()
    targets = {r["source_size"]: r["target"] for r in out}
    assert targets == {1000: 600.0, 200: 600.0}
    assert sum(r["taken"] for r in out if r["source_size"] == 1000) == 600
    kept = mixing.mixed(d, (2, 3)).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in kept} == {"a": 60, "b": 60}


def test_repeated_query_rows_are_queries_of_their_own(spark):
    rows = [(i, [i, 1], i) for i in range(60)] + [(20, [20, 1], 60)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>, row bigint")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk_search.search(df, df.where("vec_id = 20"), 10).collect())
    best = sorted([(-(20 * i + 1), i) for i in range(60)])[:10]
    assert got == sorted(2 * [(k + 1, i, -s) for k, (s, i) in enumerate(best)])


def test_base_spans_equal_plain_ones(docs):
    import hashlib
    import re

    rng = random.Random(12)
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    parts = ["password", "Token", "api_key", "apikey", "SECRET", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef" * 4, "ü", "\n", "x.y/z=", "中😀", "AKIAAKIA", "a" * 7, "hunter22"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    out = {r["doc_id"]: r["base"] for r in secret_scan.scan(docs(*texts)).collect()}
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
        assert [(s["start"], s["ord"], s["end"], s["kind"]) for s in out[i]] == sorted(spans)


def test_planted_secrets_are_recalled(docs):
    rng = random.Random(13)
    kinds = ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"]
    plain = [f"{rng.choice(['the', 'key', 'over'])} {words(6, 10 * i)} {rng.choice(['https://a.org/some/long-path/with-words', 'snake_case_name_of_a_function', 'x' * 40])}" for i in range(200)]
    texts = [p + " " + "".join(rng.choice(kinds[i // 2 % 4]) for _ in range(40 * (i % 2))) + " end" for i, p in enumerate(plain)]
    out = {r["doc_id"]: len(r["spans"]) > 0 for r in secret_scan.scan(docs(*texts)).collect()}
    assert sum(out[i] for i in range(1, 200, 2)) >= 95 and not any(out[i] for i in range(0, 200, 2))


def test_ordinal_gradient_and_cuts():
    """The fit's minimum is one of the loss as it is written down, and its cuts are in order."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(120)]
    grades = np.array([min(3, max(0, int(len(r) // 2 + rng.integers(-1, 2)))) for r in rows])
    w, cuts = toxicity.ordinal(rows, grades, 6, 4, steps=4000)
    weight = np.where(grades > 0, 0.5 / (grades > 0).sum(), 0.5 / (grades == 0).sum())

    def loss(w, cuts):
        up = np.array([[1.0, *(1 / (1 + math.exp(c - w[r].sum())) for c in cuts), 0.0] for r in rows])
        i = np.arange(len(rows))
        return float((-np.log(up[i, grades] - up[i, grades + 1]) * weight).sum() + 0.001 * (w**2).sum())

    assert np.all(np.diff(cuts) > 0)
    for k in range(6):
        step = np.eye(6)[k] * 1e-4
        assert abs(loss(w + step, cuts) - loss(w - step, cuts)) / 2e-4 < 2e-3
    for k in range(3):
        step = np.eye(3)[k] * 1e-4
        assert abs(loss(w, cuts + step) - loss(w, cuts - step)) / 2e-4 < 2e-3


def test_large_buckets_go_on_until_all_is_compared(docs, monkeypatch):
    """With few leaders a round, the same components as of all pairs."""
    monkeypatch.setattr(jaccard_join, "AT_ONCE", 3)
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    test_jaccard_equals_all_pairs(docs, 4, Fraction(85, 100))


def test_names_that_clash(spark, docs):
    d = docs(words(60), words(60), words(60, 500), None)
    for c in ("removed_lines", "_rk", "_key", "_h", "_s", "_times", "_row", "_v"):
        d = d.withColumn(c, d["node"])
    kept = [line_dedup.without_repeats(d), mixing.mixed(d), jaccard_join.one_of_each(d), quality_rules.cleaned(d)]
    assert all(x.columns == d.columns and {r["_h"] for r in x.collect()} <= {"x"} and x.where("_rk = 'x' and _key = 'x' and removed_lines = 'x'").count() == x.count() for x in kept)
    out = line_dedup.deduped(d)
    assert out.columns.count("removed_lines") == 1 and sum(r["removed_words"] for r in out.collect()) == 60


def test_copies_with_other_columns(spark, docs):
    d = docs(words(60), words(60), words(60), words(60), ids=[1, 1, 1, 2]).toDF("doc_id", "text", "lang", "source", "n_chars", "node", "row")
    d = d.withColumn("row", d["doc_id"] * 10)
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.deduped(d).collect()) == [(1, ""), (1, ""), (1, words(60)), (2, "")]
