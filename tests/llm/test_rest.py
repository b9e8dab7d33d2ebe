"""Scores, rules, filters, mixture, packing and the pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest import DOCS, text_of
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import attention_lm, packing, quality_model, toxicity
from evidentia.llm.attention_lm import AttentionLM, lm_scores
from evidentia.llm.exact_dedup import exact_dedup
from evidentia.llm.grams import words
from evidentia.llm.jaccard_join import jaccard_join
from evidentia.llm.labelled import prior, training_sample
from evidentia.llm.mixing import mix
from evidentia.llm.packing import best_fit, pack
from evidentia.llm.quality_model import Attention, passages, quality_classifier
from evidentia.llm.quality_rules import quality_rules
from evidentia.llm.queries import URL_RULES, op9_quality_rules, op10_url_filters, oracle_sql, tokenizer_path
from evidentia.llm.store import shared_dir
from evidentia.llm.url_filters import alias_edges, node_of, resolved, url_filters

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        bad, foul = rng.random() < 0.3, rng.random() < 0.4
        w = text_of(rng, rng.randrange(60, 160)).split(" ")
        if bad:
            w = [x + "%%%" for x in w]
        for _ in range(5 if foul else 0):
            w[rng.randrange(len(w))] = rng.choice(("zogger", "Zoggling", "vrumpt"))
        docs.append((i, " ".join(w), "s"))
        labels.append((i, int(not bad), int(foul)))
    docs += [(1000, None, "s"), (1001, "", None), (1002, " ", "s"), (1002, " ", "s")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "label", "cut"), [(toxicity.toxicity, "toxic", 0.5), (quality_classifier, "quality", 0.3)])
def test_classifiers(labelled, run, label, cut):
    docs, labels = labelled
    got = run(docs.withColumn("score", F.lit("clash")), labels).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == docs.count() and all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_classifiers_without_labels(spark, labelled):
    docs, labels = labelled
    for run in (toxicity.toxicity, quality_classifier):
        assert {round(r.score, 6) for r in run(docs.limit(5), labels.limit(0)).collect()} == {0.5}
        assert run(docs.limit(0), labels).count() == 0


def test_toxic_spans_are_the_words(labelled):
    docs, labels = labelled
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = Counter(texts[r.doc_id][s.start : s.end].lower() for r in toxicity.toxicity(docs, labels).collect() for s in r.spans)
    assert {"zogger", "zoggling", "vrumpt"} <= set(words) and sum(words[w] for w in ("zogger", "zoggling", "vrumpt")) > 0.8 * sum(words.values())


def test_scan_equals_the_recurrence():
    rng = np.random.default_rng(2)
    p, q, s, t = rng.random((4, 1000)) + 0.1
    want, r = [], 1.0
    for i in range(1000):
        r = (p[i] + q[i] * r) / (s[i] + t[i] * r)
        want.append(r)
    assert np.allclose(toxicity.scan(p, q, s, t), want)


def test_marginals_equal_enumeration():
    chain = toxicity.Chain(np.array([5], np.uint64), np.array([1.3]), -0.3, np.array([[0.2, -0.7], [0.1, 0.9]]), -0.4, np.zeros(6))
    forms = np.zeros((7, toxicity.FORMS), np.uint64)
    forms[[1, 4], 0] = 5
    bounds = np.array([0, 4, 4, 7])
    got = chain.marginals(forms, bounds)
    x = [-0.3 + (1.3 if k in (1, 4) else 0) for k in range(7)]
    for a, b in ((0, 4), (4, 7)):
        total, ones = 0.0, np.zeros(b - a)
        for state in range(1 << (b - a)):
            bits = [(state >> k) & 1 for k in range(b - a)]
            score = sum(x[a + k] * bit for k, bit in enumerate(bits)) - 0.4 * bits[0] + sum(chain.move[u, v] for u, v in zip(bits, bits[1:]))
            total += math.exp(score)
            ones += np.array(bits) * math.exp(score)
        assert np.allclose(got[a:b], ones / total)


def test_toxicity_scores_by_enumeration(spark, labelled):
    """Scores of short texts from all label sequences of their tokens, one text at a time."""
    docs, labels = labelled
    rows = training_sample(docs, labels, "toxic")
    chain = toxicity.fit_chain(rows["text"].tolist(), rows["y"].to_numpy(), prior(labels, "toxic"))
    short = [(i, " ".join((t or "").split()[i % 5 : i % 5 + i % 9])) for i, (t,) in enumerate(docs.select("text").limit(60).collect())] + [(90, None), (91, ""), (92, "?")]
    more = spark.createDataFrame(short, "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs.select("doc_id", "text").union(more.select(F.col("doc_id") + 100_000, "text")), labels).where("doc_id >= 100000").collect()}
    for i, t in short:
        data = np.frombuffer((t or "").encode(), np.uint8)
        forms, _, _ = toxicity.tokens(data, np.array([0, len(data)]))
        n = len(forms)
        emission = [chain.bias + sum(w for m, w in zip(chain.marks.tolist(), chain.weights, strict=True) if m in f) for f in forms.tolist()]
        total, ones = 0.0, [0.0] * n
        for bits in itertools.product((0, 1), repeat=n):
            score = sum(e * b for e, b in zip(emission, bits, strict=True)) + (chain.begin * bits[0] if n else 0) + sum(chain.move[u, v] for u, v in itertools.pairwise(bits))
            total += math.exp(score)
            for k, b in enumerate(bits):
                ones[k] += b * math.exp(score)
        p = [o / total for o in ones]
        x = [1, max(p), math.log1p(sum(p)), 1 - math.prod(1 - min(q, 1 - 1e-9) for q in p), min(1, 10 * sum(p) / n), math.log1p(n) / 10] if n else [1, 0, 0, 0, 0, 0]
        assert got[100_000 + i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, chain.head, strict=True)))))), abs=1e-6)


def plain_quality(net, text):
    """One text, one passage after the other."""
    data = text.encode()
    found = [(m.start(), m.group().lower()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    begins = [0, *[found[k][0] for k in range(64, len(found), 64)], len(data)]
    symbols = [c for c in range(33, 127) if not chr(c).isalnum()]
    encoded, gates = [], []
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for k, (a, b) in enumerate(itertools.pairwise(begins)):
        own = [w for _, w in found[64 * k : 64 * k + 64]]
        n, counts = max(1, len(own)), [0] * 39
        for c in data[a:b]:
            kind = 32 if 65 <= c < 91 else 33 if 97 <= c < 123 else 34 if 48 <= c < 58 else symbols.index(c) if c in symbols else 35 if c == 32 else 36 if c == 10 else 37 if c < 33 else 38
            counts[kind] += 1
        x = [math.sqrt(c / max(1, b - a)) for c in counts]
        x += [sum(u == v for u, v in itertools.pairwise(own)) / n, (len(own) - len(set(own))) / n, (b - a) / n / 10, math.log1p(len(own)) / 4, math.log1p(len(found)) / 8, float(not own), sum(counts[:32]) / n / 2]
        slot = [int(words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] >> np.uint64(40)) % 4096 for w in own]
        mean = sum((p["t"][i] for i in slot), np.zeros(8)) / n
        h = np.tanh(np.append(np.clip((np.array(x) - net.mean) / net.scale, -6, 6), mean) @ p["w"] + p["b"])
        encoded.append(h)
        gates.append(math.exp(float((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"])))
    z = sum(g * h for g, h in zip(gates, encoded, strict=True)) / sum(gates)
    return 1 / (1 + math.exp(-float(z @ p["o"] + p["c"][0])))


def test_quality_scores_one_passage_at_a_time(spark, labelled):
    """Scores from every text's passages by themselves, gates and weights written out."""
    docs, labels = labelled
    rows = training_sample(docs, labels, "quality")
    model = quality_model.fit_attention(rows["text"].tolist(), rows["y"].to_numpy(), prior(labels, "quality"))
    got = {r.doc_id: r.score for r in quality_classifier(docs, labels).collect()}
    for r in docs.limit(40).collect():
        assert got[r.doc_id] == pytest.approx(plain_quality(model, r.text or ""), abs=1e-4)


def test_attention_gradient(monkeypatch):
    rng = np.random.default_rng(3)
    net = Attention(5, 0.6)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["t"] = rng.standard_normal((3, 8))
    x, firsts, y, w = rng.standard_normal((9, 5)), np.array([0, 4, 5, 9]), np.array([1, 0, 1]), np.ones(3)
    in_bag = np.array([2, 0, 1, 3, 1, 0, 2, 2, 0])
    slots = rng.integers(3, size=in_bag.sum())
    monkeypatch.setattr(quality_model, "SLOTS", 3)
    g = net.gradient(net.forward(x, firsts, slots, in_bag), y, w)

    def loss():
        s = net.forward(x, firsts, slots, in_bag)["s"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum() / 3

    for k, v in net.p.items():
        i = tuple(rng.integers(n) for n in v.shape)
        old = v[i]
        v[i] = old + 1e-6
        high = loss()
        v[i] = old - 1e-6
        assert abs((high - loss()) / 2e-6 - g[k][i]) < 1e-5
        v[i] = old


def test_every_text_has_passages():
    from evidentia.llm.grams import text_buffer
    import pyarrow as pa

    x, firsts, slots, in_bag = passages(*text_buffer(pa.array(["", None, "a b", " ".join(["w"] * 130)])))
    assert np.diff(firsts).tolist() == [1, 1, 1, 3] and np.isfinite(x).all()
    assert in_bag.tolist() == [0, 0, 2, 64, 64, 2] and len(slots) == 132 and len(set(slots[2:].tolist())) == 1


def small_net(rng, size=60, n=4000):
    symbols = rng.integers(2, size, n)
    return AttentionLM(np.bincount(symbols, minlength=size).astype(float)), symbols


def test_lm_is_a_distribution_and_its_windows_are_causal():
    rng = np.random.default_rng(4)
    lm, symbols = small_net(rng)
    lm.learn(iter([(symbols, np.array([3000, 1000]))]))
    sizes = np.array([40, 1, 70])
    texts = symbols[:111].copy()
    log = lm.log_probs(texts, sizes)
    changed = texts.copy()
    changed[91:] = (changed[91:] - 1) % 58 + 2
    assert np.allclose(log[:91], lm.log_probs(changed, sizes)[:91], atol=1e-5)
    every = np.array([lm.log_probs(np.append(texts[:20], t), np.array([21]))[20] for t in range(60)])
    assert abs(np.exp(every).sum() - 1) < 1e-3
    assert np.allclose(lm.log_probs(texts[41:], np.array([70])), log[41:], atol=1e-5)


def test_lm_gradient():
    rng = np.random.default_rng(6)
    lm, symbols = small_net(rng, 60, 64)
    lm.table, lm.p = lm.table.astype(np.float64), {k: v.astype(np.float64) for k, v in lm.p.items()}
    x, y, begin, real = lm.streams(symbols, np.array([50, 14]))
    target = lm.group[y]

    def loss():
        z = lm._pieces(x, begin, 0, len(y) // 16)["z"]
        return -(np.log(z[np.arange(len(y)), target] / z.sum(1)) * real).sum() / real.sum()

    rows, g, dense = lm.gradient(lm._pieces(x, begin, 0, len(y) // 16), target, real)
    checks = [(lm.table, (int(rows[3]), c), g[3, c]) for c in (1, 9, 17, 30)] + [(lm.p[k], tuple(rng.integers(n) for n in lm.p[k].shape), None) for k in lm.DENSE]
    for (array, at, want), name in zip(checks, [None] * 4 + list(lm.DENSE), strict=True):
        old = array[at]
        array[at] = old + 1e-3
        high = loss()
        array[at] = old - 1e-3
        low = loss()
        array[at] = old
        assert abs((high - low) / 2e-3 - (dense[name][at] if want is None else want)) < 2e-4


def test_lm_learns_from_context():
    rng = np.random.default_rng(7)
    cycle = np.tile([2, 3, 4, 5, 6, 7], 3000)
    lm = AttentionLM(np.bincount(cycle, minlength=20).astype(float))
    lm.move(lm.learn(iter([(cycle[k : k + 600], np.array([600])) for k in range(0, len(cycle), 600)])))
    assert lm.log_probs(cycle[:60], np.array([60]))[20:].mean() > -0.3 and rng is not None


def test_next_words_share_one_probability():
    """Of all words that symbols can spell, those of one or two symbols after some context, and the end: at most 1 in sum and
    nearly 1 with the rest of the first symbols that end no word."""
    rng = np.random.default_rng(8)
    lm, symbols = small_net(rng, 24, 3000)
    lm.learn(iter([(symbols, np.array([3000]))]))
    after = lambda *s: float(np.exp(lm.log_probs(np.array([*symbols[:20], *s]), np.array([20 + len(s)]))[20:].sum()))
    ends, inner = range(3, 24, 2), range(2, 24, 2)
    total = after(attention_lm.END) + after(attention_lm.START) + sum(after(s) for s in ends)
    for s in inner:
        total += sum(after(s, t) for t in ends)
    rest = sum(after(s) - sum(after(s, t) for t in ends) for s in inner)
    assert total <= 1 + 1e-4 and abs(total + rest - 1) < 1e-3


def test_words_of_one_spelling_differ_from_words_apart():
    scorer = attention_lm.Scorer(small_net(np.random.default_rng(9), 2 * 49152 + 4)[0], tokenizer_path(), 1, 1, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)
    a, b = scorer.log10([b"foo!", b"", b"foo !"])[0], scorer.log10([b"foo !"])[0]
    assert len(a) == 6 and len(b) == 3 and np.allclose(a[3:], b, atol=1e-4)
    one, two = (attention_lm.symbols_of([t], tokenizer_path())[0].tolist() for t in (b"foo!", b"foo !"))
    assert one != two and [x // 2 for x in one] == [x // 2 for x in two]


def test_lm_scores(spark, corpus):
    rows = [*corpus, (-1, "minus one is an id", "s"), (None, "no id", "s"), (None, None, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS score", "2 AS frag", "3 AS run").repartition(3)
    got = lm_scores(df, tokenizer_path()).collect()
    tokens = [(i, [*WORD.findall((t or "").translate(UP)), None]) for i, t, _ in rows]
    c = Counter(w for i, ws in tokens if i is not None and crc(i, 10) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5)) for i, ws in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and r.score <= 0 and r.held_out == (r.doc_id is None or crc(r.doc_id, 10) == 0) for r in got)
    assert lm_scores(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0
    # No training text: every count is 0.
    none = lm_scores(spark.createDataFrame([(i, "a b", "s") for i in range(400) if crc(i, 10) == 0], DOCS), tokenizer_path()).collect()
    assert none and all((r.n_known, r.train_tokens) == (0, 0) for r in none)


def test_every_training_text_is_learnt_from():
    texts = [b" ".join(b"w%d" % k for k in range(n)) for n in (0, 1, 63, 64, 65, 300, 2000)]
    for t in texts:
        symbols, sizes = attention_lm.learnt_windows([t], tokenizer_path())
        assert len(sizes) >= 1 and sizes.sum() == len(symbols) and (len(symbols) > 0 or not t)
    symbols, sizes = attention_lm.learnt_windows(texts, tokenizer_path())
    words = sum(int((symbols % 2 == 1).sum()) - int((symbols == attention_lm.END).sum()) for _ in [0])
    assert 0.15 < words / 2493 < 0.45 and len(sizes) == len(np.flatnonzero(sizes >= 0))


@pytest.mark.parametrize("texts", [["the cat sat on the mat"] * 40, [None, "", " \n"] * 4, ["w"], ["a b", "", "c a b"]])
def test_lm_of_texts_without_rare_words_or_any(spark, texts):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS).repartition(len(texts))  # a text per partition
    got = {r.doc_id: r for r in lm_scores(df, tokenizer_path()).collect()}
    words = {i: (t or "").split() for i, t in enumerate(texts)}
    counts = Counter(x for i, w in words.items() if crc(i, 10) for x in [*w, None])
    n = sum(counts.values())
    for i, w in words.items():
        terms = [counts[x] for x in [*w, None]]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(terms), sum(c > 0 for c in terms), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c + 0.1) / (n + 0.1 * (len(counts) + 1))) for c in terms))
        assert got[i].score < 0


def test_rare_and_common_words_meet_alike(spark, corpus, monkeypatch):
    rows = [(i, t, s) for i, t, s in corpus if t and len(t) < 3000]
    base = {}
    for most in (1 << 20, 3):
        monkeypatch.setattr(attention_lm, "MOST_COMMON", most)
        base[most] = sorted((r.doc_id, round(r.base_score, 6), round(r.score, 3)) for r in lm_scores(spark.createDataFrame(rows, DOCS), tokenizer_path()).collect())
    assert base[3] == base[1 << 20]


def test_quality_rules(spark):
    rng = random.Random(9)
    common = text_of(rng, 12)
    texts = [f"{text_of(rng, 60)}\n{common}" for _ in range(8)] + [f"{common}\n" * 6 + text_of(rng, 30)] + ["a b c " * 40, None, "", "#$ x\nx\nx\n \n", text_of(rng, 5000)]
    rows = [(i, t, "h") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, DOCS), line_limit=5).collect()}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for d in range(3)}
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert got[0].kept and got[0].n_removed_words == 12 and not got[8].kept and got[13].kept
    assert quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_url_filters(spark):
    link = lambda u: f'<html><link href="{u}" rel="canonical"></html>'.replace(f'href="{u}" rel="canonical"', f'rel="canonical" href="{u}"')
    rows = [
        (1, "https://a.example.net/x", link("https://b.com/de/1")), (2, "https://b.com/de/1#f", ""), (3, "HTTP://A.ORG", None), (4, "https://www.example.org/es/1", "<p>"),
        (5, "https://c.net/1", '<meta http-equiv="refresh" content="0; url=/2">'), (6, "https://c.net/2", link("https://a.example.net/x")), (7, None, None), (8, "nothing", link("https://b.com/de/1")),
        (9, "https://d.net/", link("https://e.com/fr/1")), (10, "https://f.net/", link("https://b.com/de/2")), (11, "https://f.net/", link("https://k.org/1")),
    ]
    got = {r.page_id: r for r in url_filters(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "block", 9: "allow", 10: "allow", 11: "allow"}
    assert (got[2].rule, got[4].rule, got[3].host, got[3].path, got[7].host, got[1].rule) == ("com/de/", "example.org/es/", "a.org", "", "", None)
    assert url_filters(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_links_of_odd_pages(spark):
    goal, words = "http://b.com/de/q", "x" * 30_000
    pages = {
        '<base href="http://b.com/de/"><link rel=canonical href="q">': "block", f'<link rel="x-canonical" href="{goal}">': "allow", f'<!-- <link rel="canonical" href="{goal}"> -->': "allow",
        f'<link title="a>b" rel="canonical" href="{goal}">': "block", f'<LINK REL="next Canonical" HREF=\'{goal}\'>': "block", f'<link href="{goal}" href="/" rel="canonical">': "block",
        f'<script>"<link rel=canonical href={goal}>"</script>': "allow", f'<link title="rel=canonical" href="{goal}">': "allow", f'<link title="{words}>" rel=canonical href={goal} >': "block", f'<link rel=canonical title="href={goal}">': "allow",
        f'<link rel=canonical href="{goal}': "allow", f'<meta http-equiv=refresh content="3">{words}': "allow", f'<meta http-equiv=refresh content="0;url=\'{goal}\'">': "block", f"<base href='mailto:x'><base href='http://x.net/'><link rel=canonical href={goal}>": "block",
    }
    df = spark.createDataFrame([(i, f"https://p{i}.net/a", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert [r.verdict for r in url_filters(df, URL_RULES).orderBy("page_id").collect()] == list(pages.values())


def test_urls_resolve_as_the_standard_says(spark):
    """Against the standard library, normalised alike."""
    from urllib.parse import urljoin, urlsplit

    bases = ["http://A.example/b/c/d;p?q", "https://x.net", "https://x.net/", "http://x.net:80/a/b", "https://x.net:8443/a/b/?z#f", "http://x.net?q"]
    targets = ["g", "./g", "g/", "/g", "//Other.org/p", "?y", "g?y", "g;x", "../g", "../../g", "../../../g", "./../g", "g/./h", "g/../h", ".", "..", "./", "../", "http://z.org:80", "/a/b/.", "/a/b/.."]
    rows = [(b, t) for b in bases for t in targets]

    def name(url):
        p = urlsplit(url)
        host = p.netloc.lower()
        for scheme, port in (("http", ":80"), ("https", ":443")):
            host = host.removesuffix(port) if p.scheme == scheme else host
        return f"{p.scheme}://{host}{p.path or '/'}" + (f"?{p.query}" if p.query else "")

    df = spark.createDataFrame(rows, "b string, t string").select("b", "t", node_of(resolved(F.col("b"), F.col("t"))).alias("u"))
    wrong = [(r.b, r.t, r.u, name(urljoin(r.b, r.t))) for r in df.collect() if r.u != name(urljoin(r.b, r.t))]
    assert not wrong
    more = [("http://x/y", "https://z.org:443/./a/../b?c=../d", "https://z.org/b?c=../d"), ("https://x.net/", "a//b", "https://x.net/a//b")]  # where the library departs from it
    assert [r.u for r in spark.createDataFrame(more, "b string, t string, want string").select(node_of(resolved(F.col("b"), F.col("t"))).alias("u")).collect()] == [m[2] for m in more]
    none = spark.createDataFrame([("http://a/b", t) for t in ("", "#x", "mailto:a@b", "javascript:void(0)")] + [("no scheme", "x"), (None, "x"), ("http://a", None)], "b string, t string")
    assert {r.u for r in none.select(resolved(F.col("b"), F.col("t")).alias("u")).collect()} == {None}


def test_url_sql_on_pages_with_links(spark, tmp_path):
    """The registered query and its SQL on links of all kinds, very long html, repeated and null rows and clashing columns."""
    import duckdb

    rng = random.Random(12)
    urls = [f"https://{h}/{p}" for h in ("a.net", "b.com", "c.org:443", "D.com", "e.com") for p in ("", "de/x", "fr/y", "q/r/s?t", "es/1")]
    tags = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel='alternate canonical'>", '<meta http-equiv="refresh" content="0; URL={}">', "<link rel=canonical href={}>", '<link rel="stylesheet" href="{}">']
    tags += ['<link title="a>b" rel="canonical" href="{}"/>', '<link rel="x-canonical" href="{}">', "<!-- <link rel=canonical href='{}'> -->", '<base href="http://b.com/de/"><link rel=canonical href="{}">']
    tags += ['<script>"<link rel=canonical href={}>"</script>', '<link data-x="rel=canonical" href="{}">', '<base target=x><base href="../z/"><link rel="canonical" rel="next" href="{}">', "<meta content=\"5; '{}'\" http-equiv=Refresh>"]
    goals = [*urls, "../x", "?z", "/de/x", "//b.com/de/x", "r", "#f", "mailto:x", "https://b.com:443/de/./x", "http://A.net"]
    rows = [(k, rng.choice(urls), "<p>" * rng.choice((1, 1, 200_000)) + "".join(rng.choice(tags).format(rng.choice(goals)) for _ in range(rng.randrange(3)))) for k in range(60)]
    rows += [rows[3], (None, urls[1], None), (100, None, rows[4][2]), (101, "", ""), (102, "no", rows[5][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS node", "3 AS a")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = Counter(tuple(r) for r in op10_url_filters(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == Counter(con.execute(oracle_sql()["op10_url_filters"]).fetchall()) and {v for *_, v in got} == {"allow", "block"}
    assert alias_edges(df).count() > 20


def test_line_counts_equal_sql(spark, tmp_path):
    """Copies, repeated and null ids and hosts, clashing columns: as the SQL counts them, on lines around the limit."""
    import duckdb

    rng = random.Random(14)
    line = [text_of(rng, 12) for _ in range(4)]
    rows = [(i, f"{text_of(rng, 55)}\n{line[0]}\n{line[1] if i < 100 else line[2]}", "h") for i in range(130)]
    rows += [(7, f"{text_of(rng, 60)}\n{line[1]}", "h"), rows[5], rows[5], (None, f"{text_of(rng, 60)}\n{line[3]}", None), (None, None, None), (500, "", "h")]
    rows += [(600 + k, f"{line[3]}\n{text_of(rng, 30)}", "g") for k in range(100)] + [(None, f"{line[3]}\n" * 30, "g")]
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS host", "2 AS row", "3 AS h", "4 AS n").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text, source FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(oracle_sql()["op9_quality_rules"])
    names = [d[0] for d in cur.description]
    got = Counter(tuple(r) for r in op9_quality_rules(spark, str(tmp_path)).select(*names).collect())
    assert got == Counter(cur.fetchall()) and len({r[names.index("n_removed_words")] for r in got}) > 2


def test_mix(spark, corpus):
    df = spark.createDataFrame(corpus, DOCS).selectExpr("*", "'clash' AS copy", "'clash' AS rate", "'clash' AS shuffle_key", "1 AS mix_rate", "1 AS mix_times", "1 AS row")
    even = mix(df, targets={"s0": 1.0, "s1": 1.0, "s2": 1.0}, epochs=3.0).collect()
    assert {r.source for r in even} <= {"s0", "s1", "s2"} and [r.shuffle_key for r in even] == sorted(r.shuffle_key for r in even)
    size = defaultdict(int)
    for r in mix(spark.range(3000).selectExpr("id AS doc_id", "'abcd' AS text", "if(id % 3 = 0, 'a', 'b') AS source"), targets={"a": 1.0, "b": 1.0}).collect():
        size[r.source] += 1
    assert abs(size["a"] / size["b"] - 1) < 0.15
    great = mix(spark.createDataFrame([(1, "x", "a"), (2, "x" * 4000, "b")], DOCS), targets={"a": 1.0}).agg(F.count(F.lit(1))).first()[0]
    assert abs(great - 4001) < 400
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_pack(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    odd = ["it's 42 <|endoftext|>x y é İ naïve!!", "DON'T stop…", "Straße—100%", "\x1c\x1f a\x85b"]
    rows = [*corpus, *((1000 + i, x, "s") for i, x in enumerate(odd))]
    got = pack(spark.createDataFrame(rows, DOCS).repartition(7), tokenizer_path()).collect()
    want = Counter()
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(at) <= 1.1 * -(-sum(r.length for r in got) // 4096) + 1
    assert pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def test_best_fit():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 101) for _ in range(500)]
    bins = best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 1.05 * sum(sizes) / 100 + 1
    assert sum(2 * sum(sizes[i] for i in b) <= 100 for b in bins) <= 1


def test_what_is_not_handed_on_is_of_no_use(spark, monkeypatch):
    """As many sequences as when every underfull one moves up, with a source of documents that are all more than half a sequence
    long; null and repeated ids."""
    rng = random.Random(2)
    rows = [(i, "word " * (rng.randrange(900, 1300) if i % 4 else rng.randrange(1, 700)), "s") for i in range(700)] + [(None, "x", "s"), (None, "x", "s"), (3, "y", None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS piece", "2 AS node").repartition(40)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    monkeypatch.setattr(packing, "LENGTH", 2048)
    count = lambda: pack(df, tokenizer_path(), capacity=2048).select("sequence_id").distinct().count()
    few = count()
    monkeypatch.setattr(packing, "handed_on", lambda levels: 10**9)
    assert few == count()


def test_pipeline_stages_equal_plain_versions(spark, labelled, corpus, tmp_path):
    docs, labels = labelled
    rows = [(i + 10_000, t, s) for i, t, s in corpus if t is None or len(t) < 20_000]
    whole = docs.union(spark.createDataFrame([*rows, rows[3], rows[3], (None, "no id " * 30, "s")], DOCS)).selectExpr("*", "'en' AS lang", "1L AS n_chars")
    whole.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    d0 = spark.read.parquet(str(tmp_path / "documents.parquet"))
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    kept = stage["quality_classifier"](spark, d0, str(tmp_path))
    assert kept.columns == d0.columns
    verdict = {r.doc_id: r.predicted for r in quality_classifier(d0, labels).collect()}
    assert key(kept) == Counter({k: n for k, n in key(d0).items() if verdict[k[0]]})
    once = stage["exact_dedup"](spark, d0, str(tmp_path))
    best = {}
    for i, t in key(d0):
        k = (t or "").translate(UP)
        best[k] = max(best.get(k, (-1, t)), (-1 if i is None else i, t), key=lambda p: p[0])
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in once.collect()) == sorted(i for i, _ in best.values())
    near = stage["ngram_jaccard_join"](spark, once, str(tmp_path))
    comp = {r.doc_id: r.component_id for r in jaccard_join(once).collect()}
    assert key(near) == Counter({k: n for k, n in key(once).items() if comp[k[0]] == k[0]})
    pair = [(3, "a"), (5, "a"), (5, "b"), (9, "b")]
    some = {x: text_of(random.Random(x), 80) for x in "ab"}
    ids = spark.createDataFrame([(i, some[x], "s") for i, x in pair], DOCS).selectExpr("*", "'en' AS lang", "1L AS n_chars")
    assert sorted((r.doc_id, r.text) for r in stage["ngram_jaccard_join"](spark, ids, str(tmp_path)).collect()) == [(3, some["a"]), (5, some["b"])]
    odd = d0.limit(30).selectExpr("*", "'a' AS exact_copies_key", "'b' AS near_copies_id", "1 AS copy", "2 AS rate", "3 AS shuffle_key", "4 AS mix_rate")
    for name in ("exact_dedup", "ngram_jaccard_join", "source_mixing"):
        out = stage[name](spark, odd, str(tmp_path))
        assert out.columns == odd.columns and {tuple(r[5:]) for r in out.collect()} == {("a", "b", 1, 2, 3, 4)}
    assert exact_dedup(near).where("NOT kept").count() == 0


def times_of(rows):
    """How often each (id, source, text) is repeated, by the inverse Poisson distribution of its source's mean."""
    from hashlib import md5

    chars = Counter()
    for _, t, s in rows:
        chars[s] += len(t or "")
    roots, every = sum(math.sqrt(n) for n in chars.values()), sum(chars.values())
    out = Counter()
    for i, t, s in rows:
        rate = every * math.sqrt(chars[s]) / roots / chars[s] if chars[s] else 1.0
        u = int(md5(f"17:{'' if i is None else i}:1".encode()).hexdigest()[:12], 16) / 2.0**48
        k, term, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        out[i, s, t] += k
    return +out


def test_mixing_and_packing_stages_against_brute_force(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    rows = [r for r in corpus if r[1] is None or len(r[1]) < 20_000] + [(None, "no id", "s1"), (3, "other text", None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'en' AS lang", "1L AS n_chars").repartition(5)
    stage = dict(corpus_pipeline.STAGES)
    mixed = stage["source_mixing"](spark, docs, str(tmp_path))
    got = Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    assert mixed.columns == docs.columns and got == times_of(rows)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {(i, t): np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, _ in rows}
    pieces = stage["best_fit_packing"](spark, mixed, str(tmp_path)).collect()
    want = Counter()
    for (i, _, t), n in got.items():
        for k, at in enumerate(range(0, len(ids[i, t]), 4096)):
            part = ids[i, t][at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    held = defaultdict(list)
    for r in pieces:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    # No fewer sequences than the tokens need, and hardly more than first fit by decreasing length gives in one place.
    bins = []
    for length in sorted((p[3] for p in want.elements()), reverse=True):
        k = next((k for k, b in enumerate(bins) if b + length <= 4096), None)
        if k is None:
            bins.append(length)
        else:
            bins[k] += length
    assert -(-sum(p[3] for p in want.elements()) // 4096) <= len(held) <= len(bins) + 1


def test_the_pipeline_leaves_nothing_but_its_stages(spark, labelled, tmp_path):
    docs, labels = labelled
    docs.selectExpr("*", "'en' AS lang", "1L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    base = Path(shared_dir(spark)) / "evidentia"
    before = set(base.iterdir()) if base.exists() else set()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.where("length > 4096").count() == 0 and packed.count() > 0
    kept = [p for p in base.iterdir() if p not in before and (p / "_SUCCESS").exists()]
    columns = [spark.read.parquet(str(p)).columns for p in kept]
    assert sum("text" in c for c in columns) == 4 and all("text" in c or "pieces" in c for c in columns)
