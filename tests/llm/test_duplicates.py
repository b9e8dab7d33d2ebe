"""Exact copies, near copies, repeated passages: against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import DOCS, edited, text_of
from pyspark.sql import functions as F

from evidentia.llm.components import components
from evidentia.llm.exact_dedup import chunks, exact_dedup
from evidentia.llm.jaccard_join import jaccard_join, near_copies
from evidentia.llm.store import shared_dir
from evidentia.llm.substring_dedup import Index, minima, substring_dedup, values, verified

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate(UP))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_exact(spark, corpus):
    df = spark.createDataFrame(corpus, DOCS).withColumn("kept", F.lit("clash"))
    got = exact_dedup(df).collect()
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[(t or "").translate(UP)].append(i)
    want = sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_when_chunk_hashes_collide(spark, corpus):
    weak = lambda c: F.length(c).cast("long") % 5
    df = spark.createDataFrame(corpus, DOCS)
    key = lambda rows: sorted((r.doc_id, r.keep_id, r.group_size) for r in rows)
    assert key(exact_dedup(df, chunk_hash=weak).collect()) == key(exact_dedup(df).collect())


def test_chunks_give_the_text_back(spark):
    texts = ["a" * 10_000, "x. " * 3000, "é\n" * 900, "", "😀" * 5000]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunks(F.col("t")).alias("c")).collect():
        assert "".join(r.c) == r.t and all(len(c) <= 4096 for c in r.c)


def brute_by_text(rows):
    """(doc_id, text) -> least doc_id of the component, where rows that repeat an id or a text are connected."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if sets[i] and sets[j] and (same_id or 100 * both >= 80 * len(sets[i] | sets[j])):
                root[top(i)] = top(j)
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out[doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc] += 1
    return out


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_unrelated_texts(spark, parts):
    """Nothing is shared, so most fragments of the n-gram order are empty."""
    rng = random.Random(parts)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(80))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(df).collect()) == [(i, 76, i) for i in range(50)]
        assert substring_dedup(df).collect() == [] and near_copies(df).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_jaccard_of_repeated_and_null_ids(spark):
    rng = random.Random(77)
    a, b, c, d = (text_of(rng, 70) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (9, b), (None, c), (None, c), (None, edited(rng, c, 1)), (2, edited(rng, d, 1)), (None, d), (4, None), (4, a), (6, ""), (6, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS set_id", "1 AS content", "2 AS component_id")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(df).collect()) == brute_by_text(rows)
    gone = {(r.doc_id, r.content) for r in near_copies(df).collect()}
    left = [r for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect() if (r.doc_id, r.h) not in gone]
    # One row of each group of texts stays (equal rows together), and no text is lost.
    assert Counter((r.doc_id, r.text) for r in left if r.text and r.text.strip()) == Counter([(3, a), (5, b), (2, rows[7][1]), *[x for x in rows[4:7] if (x[0], x[1]) in {(r.doc_id, r.text) for r in left}]])
    assert sum(r.doc_id is None for r in left) in (1, 2) and sum(not (r.text or "").strip() for r in left) == 3


def test_jaccard(spark, corpus):
    rows = spark.createDataFrame(corpus, DOCS).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(rows).collect()}
    assert got == brute_components(corpus)


def test_jaccard_of_chains_and_stars(spark):
    """Near copies of near copies: links that no common hub shows."""
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(6):
        t = text_of(rng, 120)
        for _ in range(12):
            rows.append((n, t))
            n += 1
            t = edited(rng, t, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_in_small_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr("evidentia.llm.jaccard_join.BLOCK", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(spark.createDataFrame(corpus, DOCS)).collect()}
    assert got == brute_components(corpus)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50 + i) for i in range(20)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50 + i: 50 for i in range(20)} | {100: 50, 200: 200, 201: 200}


def test_substring(spark, corpus):
    got = substring_dedup(spark.createDataFrame(corpus, DOCS)).collect()
    tokens = {i: WORD.findall((t or "").translate(UP)) for i, t, _ in corpus}
    runs = defaultdict(set)
    for i, w in tokens.items():
        for k in range(len(w) - 50):
            runs[tuple(w[k : k + 51])].add(i)
    repeated = set().union(*(ids for ids in runs.values() if len(ids) > 1))
    assert repeated <= {r.doc_id for r in got} | {r.twin_id for r in got}
    for r in got:
        a, b = (shingles(" ".join(tokens[i][s:e])) for i, s, e in ((r.doc_id, r.start_word, r.end_word), (r.twin_id, r.twin_start, r.twin_end)))
        assert r.doc_id != r.twin_id and len(a & b) >= 0.8 * len(a | b) and abs(len(a & b) / len(a | b) - r.similarity) < 1e-9


def test_every_edited_passage_is_verified():
    """One or two words replaced anywhere in 50 to 100: a row wherever the passages' similarity is 0.8."""
    import numpy as np

    rng = np.random.default_rng(3)
    some = lambda n: rng.integers(1, 1 << 47, n, dtype=np.uint64)
    missed, tried = [], 0
    for n in (46, 56, 76, 87, 96):  # tokens of 50, 60, 80, 91 and 100 words
        cases = [(k,) for k in range(n + 4)] + [tuple(rng.choice(n + 4, 2, replace=False)) for _ in range(60)]
        for words in cases:
            x = some(n)
            y = x.copy()
            for k in words:
                y[max(0, k - 4) : k + 1] = some(len(y[max(0, k - 4) : k + 1]))
            both = int((x == y).sum())
            if both / (2 * n - both) >= 0.8:
                tried += 1
                around = [np.concatenate([some(60), t, some(60)]) for t in (x, y)]
                got = verified(around[0], Index(around[1]), 0, 0)
                if not got or not all(r[4] >= 0.8 for r in got):
                    missed.append((n, words))
    assert tried > 400 and not missed


def test_substring_in_a_later_region_of_both_hubs(spark):
    """The least and the greatest document hold parts of a passage near their beginning and the whole of it later."""
    rng = random.Random(21)
    passages = [text_of(rng, 70) for _ in range(8)]
    rows = []
    for k, p in enumerate(passages):
        w = p.split(" ")
        parts = " ".join(f"{text_of(rng, 60)} {' '.join(w[a : a + 24])}" for a in (0, 23, 46))
        for n in range(3):
            rows.append((10 * k + n, f"{text_of(rng, 60)} {p} {text_of(rng, 60)}" if n == 1 else f"{parts} {text_of(rng, 300)} {p} {text_of(rng, 60)}"))
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {(r.doc_id, r.twin_id) for r in got if r.end_word - r.start_word >= 66 and r.twin_end - r.twin_start >= 66}
    assert {i for i, _ in rows if i % 10 == 1} <= {a for pair in whole for a in pair}


def test_substring_between_others_than_the_hubs(spark):
    """Pairs share a passage whole; the least and the greatest documents hold strongly edited versions, alike with none."""
    rng = random.Random(31)
    rows = []
    for k in range(8):
        words = text_of(rng, 90).split(" ")
        strong = [" ".join(w if n % 12 else "x" + w for n, w in enumerate(words, shift)) for shift in range(12)]
        texts = [*strong[:6], " ".join(words), " ".join(words), *strong[6:]]
        rows += [(20 * k + n, f"{text_of(rng, 60)} {t} {text_of(rng, 60)}") for n, t in enumerate(texts)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {frozenset((r.doc_id, r.twin_id)) for r in got}
    assert not [k for k in range(8) if frozenset((20 * k + 6, 20 * k + 7)) not in pairs]


def test_substring_with_quoting_documents(spark):
    """Two documents share a passage word by word; many with lower and higher ids quote ten-word bits of it."""
    rng = random.Random(41)
    rows = []
    for k in range(4):
        words = text_of(rng, 120).split(" ")
        quotes = []
        for _ in range(50):
            a = rng.randrange(110)
            quotes.append(f"{text_of(rng, 50)} {' '.join(words[a : a + 10])} {text_of(rng, 50)}")
        texts = quotes[:25] + [f"{text_of(rng, 60)} {' '.join(words)} {text_of(rng, 60)}" for _ in range(2)] + quotes[25:]
        rows += [(100 * k + n, t) for n, t in enumerate(texts)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.twin_id)) for r in got} == {frozenset((100 * k + 25, 100 * k + 26)) for k in range(4)}


def test_recall_of_edited_passages(spark):
    """Families of documents that hold edited versions of a passage: of all pairs with a similarity of 0.8 (brute force over the
    planted places) at least 0.9 are connected by rows of that family."""
    rng = random.Random(51)
    rows, versions = [], {}
    for k in range(12):
        base = text_of(rng, rng.randrange(60, 120))
        for n in range(8):
            versions[20 * k + n] = v = edited(rng, base, rng.randrange(0, 3))
            rows.append((20 * k + n, f"{text_of(rng, 40)} {v} {text_of(rng, 40)}"))
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    root = {i: i for i in versions}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got:
        assert r.doc_id // 20 == r.twin_id // 20
        root[top(r.doc_id)] = top(r.twin_id)
    pairs = [(i, j) for i in versions for j in range(i + 1, i // 20 * 20 + 8) if len(shingles(versions[i]) & shingles(versions[j])) >= 0.8 * len(shingles(versions[i]) | shingles(versions[j]))]
    assert len(pairs) > 150 and sum(top(i) == top(j) for i, j in pairs) >= 0.9 * len(pairs)
    members = {i for p in pairs for i in p}
    assert len(members & ({r.doc_id for r in got} | {r.twin_id for r in got})) >= 0.9 * len(members)


def test_substring_of_odd_rows(spark):
    """Null ids and texts, repeated rows, clashing columns, and one text beyond all slices and blocks."""
    rng = random.Random(61)
    p, long_ = text_of(rng, 70), text_of(rng, 30_000)
    rows = [(None, p), (1, None), (1, p), (1, p), (2, f"{long_} {p}"), (3, f"{p} {long_[:100_000]}"), (4, ""), (5, p.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS twin_id", "'k' AS key", "3 AS id")
    got = substring_dedup(df).collect()
    assert {i for r in got for i in (r.doc_id, r.twin_id)} == {1, 2, 3, 5}
    assert any({r.doc_id, r.twin_id} == {2, 3} and r.end_word - r.start_word > 10_000 for r in got)


def test_minima_are_cartesian_nodes():
    import numpy as np

    tokens = np.random.default_rng(1).integers(1, 1 << 40, 300, dtype=np.uint64)
    tokens[100:104] = 0
    h = values(tokens, 0).tolist()
    want = {min(range(i, i + 20), key=lambda k: h[k]) for i in range(281) if 0 not in h[i : i + 20]}
    assert set(minima(tokens, 0, 20).tolist()) == want


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    for f in (exact_dedup, jaccard_join, substring_dedup):
        assert f(none).count() == 0


def test_families_are_what_pairs_connect(spark, corpus):
    """Passages of one document that overlap, and the two ends of a pair, have one family, and nothing else has."""
    rows = substring_dedup(spark.createDataFrame(corpus, DOCS)).collect()
    family, spans = {}, {}
    for r in rows:
        for end in ((r.doc_id, r.start_word, r.end_word), (r.twin_id, r.twin_start, r.twin_end)):
            assert family.setdefault(end, r.family_id) == r.family_id
            spans.setdefault(end[0], set()).add(end)
    up = {e: e for e in family}

    def top(e):
        while up[e] != e:
            e = up[e]
        return e

    for r in rows:
        up[top((r.doc_id, r.start_word, r.end_word))] = top((r.twin_id, r.twin_start, r.twin_end))
    for own in spans.values():
        for a in own:
            for b in own:
                if a[1] < b[2] and b[1] < a[2]:
                    up[top(a)] = top(b)
    groups = {}
    for e, f in family.items():
        groups.setdefault(f, set()).add(top(e))
    assert rows and all(len(g) == 1 for g in groups.values()) and len(groups) == len({top(e) for e in family})


def test_documents_with_a_phrase_in_common_are_not_compared(monkeypatch):
    """Sixty regions hold one phrase of 26 tokens, two of them the same 120 tokens: only these two are looked at closely."""
    import numpy as np
    import pyarrow as pa

    from evidentia.llm import substring_dedup as op1
    from evidentia.llm.grams import pack48

    rng = np.random.default_rng(3)
    phrase, passage = rng.integers(1, 2**48, 26).astype(np.uint64), rng.integers(1, 2**48, 47).astype(np.uint64)
    some = lambda n: rng.integers(1, 2**48, n).astype(np.uint64)
    tokens = [np.concatenate([passage, phrase, passage[::-1]]) if k in (20, 30) else np.concatenate([some(47), phrase, some(47)]) for k in range(60)]
    sides = [{"g": 5, "i": 0, "j": 0, "side": s, "doc_id": k, "start": 0, "root": k, "live": True, "tokens": pack48(t), "key": [7], "c": [60], "open": [True]} for s in (0, 1) for k, t in enumerate(tokens)]
    looked = []
    near = op1.Holders.near
    monkeypatch.setattr(op1.Holders, "near", lambda self, x, at, who: looked.append(len(who)) or near(self, x, at, who))
    found = op1._compare(pa.Table.from_pylist(sides)).to_pylist()
    assert {frozenset((r["doc_id"], r["twin_id"])) for r in found} == {frozenset((20, 30))}
    assert len(looked) == 2  # sixty, each with all others, before

    ids = list(range(60))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([5] * 60), pa.array([pack48(t) for t in tokens])], names=["id", "g", "tokens"])
    sets = dict(op1._family_tokens([batch]))
    held = [sorted(x for x in sets[k].tolist() if any(x in sets[m] for m in ids if m != k)) for k in ids]
    rows = [*batch.columns[:2], pa.array([0] * 60, pa.int32()), batch.column(2), pa.array([[60]] * 60, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int64()))]
    out = list(op1._alive([pa.RecordBatch.from_arrays(rows, names=["id", "g", "start", "tokens", "c", "held"])]))
    assert [k for b in out for k in b.column(0).to_pylist()] == [20, 30]


def test_substring_in_families_of_several_blocks(spark, monkeypatch):
    """As between others than the hubs, in blocks of four regions: what is filtered there loses no passage."""
    monkeypatch.setattr("evidentia.llm.substring_dedup.BLOCK", 4)
    test_substring_between_others_than_the_hubs(spark)
    test_substring_with_quoting_documents(spark)


def test_tables_and_shuffle_files_on_the_way_go(spark, corpus):
    from evidentia.llm import substring_dedup as op1

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files() -> dict[str, int]:
        files = blocks.getAllFiles()
        return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}

    folder = Path(shared_dir(spark).removeprefix("file:"), "evidentia")
    tables, files = set(folder.glob("*")), shuffle_files()
    found = op1.substring_dedup(spark.createDataFrame(corpus, "doc_id long, text string, source string"))
    assert len(set(folder.glob("*")) - tables) == 2  # what the result reads
    assert sum(n for name, n in shuffle_files().items() if name not in files) < 10_000  # counts of edges, asked for without a table
    assert found.count()


def test_last_comparison_does_not_depend_on_the_order_of_rows():
    from evidentia.llm import substring_dedup as op1

    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(1, 1 << 47, n, dtype=np.uint64)
    passage = fresh(80)
    rows = []
    for k in range(12):
        own = np.where(rng.random(80) < 0.03 * (k % 4), fresh(80), passage)
        tokens = np.concatenate([fresh(20), own, fresh(20)])
        rows.append({"g": 1, "i": 0, "j": 0, "side": 2, "doc_id": k, "start": 0, "root": k, "live": True, "tokens": op1.pack48(tokens), "key": [7], "c": [60], "open": [True]})
    results = []
    for _ in range(4):
        rng.shuffle(rows)
        results.append(op1._compare(pa.Table.from_pylist(rows)).to_pylist())
        twice = [r | {"side": side} for r in rows for side in (1, 0)]
        results.append(op1._compare(pa.Table.from_pylist(twice)).to_pylist())
    assert results[0] and all(r == results[0] for r in results)


def test_lists_of_several_fragments_are_one_row(spark):
    """From each of 9 fragments four ids have some n-grams: a row for each id, not for each fragment."""
    from evidentia.llm import jaccard_join as op2

    rows = [r for f in range(9) for r in op2._rows(np.full(8, f), np.repeat(np.arange(4), 2), np.arange(8).astype(np.uint64) + np.uint64(100 * f), np.arange(4) - 2, np.full(4, 18, np.int32), np.full(8, 4))]
    shared = spark.createDataFrame([tuple(r[c] for c in op2._SHARED.names) for r in rows], op2._SHARED_SQL)
    found = {r["id"]: r for r in op2.shared_lists(shared).collect()}
    assert op2.shared_lists(shared).count() == 4 and set(found) == {-2, -1, 0, 1}
    for k in range(4):
        assert sorted(found[k - 2]["grams"]) == [100 * f + 2 * k + x for f in range(9) for x in (0, 1)]
