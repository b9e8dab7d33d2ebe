"""Token files, conversation repair and the filter audit against brute force and exact round trips."""

import itertools
import random
import zlib
from hashlib import sha256

import numpy as np
import pyarrow.orc as orc
import pytest
from conftest import DOCS, text_of
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm.conversation_repair import Trie, repair_conversations
from evidentia.llm.filter_audit import filter_audit, mask_cells
from evidentia.llm.queries import tokenizer_path
from evidentia.llm.token_store import read_rows, read_tokens, token_digests, token_files, write_tokens

SPACE = " \t\n\x0b\x0c\r"


# Token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def encoded(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def expected_digests(tokenizer, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array(encoded(tokenizer, text), "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_corpus(spark, corpus, tokenizer):
    rows = [(i, t) for i, t, _ in corpus[:-2]]  # without the rows that repeat an id
    rows += [(1000, "Don't STOP, naïve Ünïcode 日本語 \U0001f600 <|endoftext|> 12'345"), (-7, "minus")]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, part string, AT int").repartition(7)
    got = sorted(tuple(r) for r in token_files(docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected_digests(tokenizer, sorted(rows))


def test_token_files_with_null_and_repeated_ids(spark, tokenizer):
    rows = [(None, "a b"), (None, None), (5, "x y z"), (5, "x y z"), (5, "other"), (5, ""), (2, None)]
    got = token_files(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((i is not None, i or 0, len(encoded(tokenizer, t))) for i, t in rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == [0, *itertools.accumulate(r.n_tokens for r in by_start)][:-1]
    ids = [r.doc_id for r in by_start]
    assert ids == [None, None, 2, 5, 5, 5, 5]
    assert token_files(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_stripes_bloom_filters_and_pruned_reads(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(2 * i, text_of(rng, 20)) for i in range(20_000)], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "t"), tokenizer_path(), stripe_bytes=1 << 16)
    files = sorted((tmp_path / "t" / "ids").glob("*.orc"))
    assert max(orc.ORCFile(f).nstripes for f in files) > 1
    parts = spark.read.orc(str(tmp_path / "t" / "parts")).orderBy("part").collect()
    assert [p.start for p in parts] == [0, *itertools.accumulate(p.tokens for p in parts)][:-1]
    assert all(a.last_id < b.first_id for a, b in itertools.pairwise(parts))

    def rows_read(wanted):
        df = read_rows(spark, str(tmp_path / "t" / "ids")).where(wanted)
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        leaves = plan.collectLeaves()
        return rows, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    rows, read = rows_read("doc_id = 2000")
    assert len(rows) == 1 and read <= 1000
    rows, read = rows_read("doc_id = 2001")  # within the statistics of a row group, and in no Bloom filter
    assert not rows and read == 0
    one = read_tokens(spark, str(tmp_path / "t"), "doc_id IN (4, 400)").collect()
    all_ = {r.doc_id: r for r in token_digests(spark, str(tmp_path / "t")).collect()}
    assert {r.doc_id: (r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in one} == {i: (all_[i].start, all_[i].ids_crc32) for i in (4, 400)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 16))
    try:
        assert token_digests(spark, str(tmp_path / "t")).rdd.getNumPartitions() > len(files)
        assert {tuple(r) for r in token_digests(spark, str(tmp_path / "t")).collect()} == {tuple(r) for r in all_.values()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# Conversation repair


def damage(rows):
    out = []
    for n, (conv, turn, role, text) in enumerate(rows):
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        if not text.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            seen.add((role, text))
            out.append("" if text.rstrip(SPACE)[-1] in ".!?" else "truncated")
    return out


def legal(initials):
    rest = initials.removeprefix("s")
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def cheapest(rows, marks, most):
    """Every choice of edits up to a cost, without states or tables."""
    best = None

    def go(i, cost, audit, lines):
        nonlocal best
        if cost > most or (best and cost > best[0]):
            return
        if i == len(rows):
            if legal("".join(x[:1] or "?" for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
        if audit.count("I") < 4:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*lines, f"{role}:"])
        if i < len(rows):
            go(i + 1, cost + 3, audit + "D", lines)
            if marks[i] not in ("blank", "duplicate"):
                extra = marks[i] == "truncated"
                role, text = rows[i][2:]
                go(i + 1, cost + extra, audit + "K", [*lines, f"{role}:{text}" if role else f"?{text}"])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + extra, audit + "R", [*lines, f"{new}:{text}"])

    go(0, 0, "", [])
    return best


def expected_repair(rows):
    convs = {r[0] for r in rows}
    left = damage(rows)
    out = set()
    for conv in convs:
        mine = [r for r in left if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        marks, turns = faults(mine), [r[1] for r in mine if r[1] is not None]
        pairs = zip([r[2][:1] for r in mine], [r[2][:1] for r in mine[1:]], strict=False)
        best = cheapest(mine, marks, 3 * len(mine))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.add((
            conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in pairs),
            best[0], best[1], sha256("\n".join(best[2]).encode()).hexdigest(),
        ))
    return out


CONV = "conv_id long, turn long, role string, text string"


def random_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randrange(1, 6)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Hello there.", "Why?", "no end", "  ", None, "", "tail.\n \t", "Hello there."])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 7]), role, text))
    return rows + rows[:3]


def repaired(spark, rows, schema=CONV):
    df = repair_conversations(spark.createDataFrame(rows, schema).repartition(5))
    return [tuple(r) for r in df.collect()]


def test_repair_against_all_edits(spark):
    rows = random_conversations(5, 120)
    got = repaired(spark, rows)
    assert len(got) == len({r[0] for r in rows})
    assert set(got) == expected_repair(rows)


def test_repair_of_odd_tables(spark):
    assert repaired(spark, []) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 1, "user", "x")]) == [(gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    df = spark.createDataFrame([(5, 1, "user", "Hm. " * 1_000_000, "x")], CONV + ", signature string")
    assert {tuple(r) for r in repair_conversations(df).collect()} == {(5, 0, 0, 0, 0, 0, 2, "KI", sha256(("user:" + "Hm. " * 1_000_000 + "\nassistant:").encode()).hexdigest())}


def test_one_conversation_with_a_third_of_all_rows(spark):
    rows = [(0, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(4000)] + [(1 + t // 4, t % 4, ("user", "assistant")[t % 2], f"T {t}.") for t in range(8000)]
    got = {r[0]: r for r in repaired(spark, rows)}
    left = damage(rows[:4000])
    assert len(got) == 2001 and got[0][3] == sum(f == "duplicate" for f in faults(left)) and len(got[0][7]) >= len(left)


def test_layers_are_computed_once_per_shared_prefix():
    signatures = sorted(random.Random(2).choice(["ua", "uaua", "suaua", "suauA"]) + random.Random(i).choice(["", "u", "ux", "uxa"]) for i in range(200))
    trie = Trie()
    answers = [trie.answer(s) for s in signatures]
    assert trie.computed == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})
    assert answers == [Trie().answer(s) for s in signatures]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.sampled_from(["", "blank", "truncated"])), max_size=5))
def test_answers_are_the_cheapest(rows):
    symbols = "".join("x" if f == "blank" else (r[0] if r[0] in "sua" else "o").upper() if f else (r[0] if r[0] in "sua" else "o") for r, f in rows)
    best = cheapest([(0, 0, r, "t") for r, _ in rows], [f for _, f in rows], 3 * len(rows))
    assert Trie().answer(symbols) == best[:2]


def test_undamaged_conversations_are_kept(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 2, "assistant", "Because."), (2, 0, "assistant", "Hello.")]
    got = {r[0]: r for r in repair_conversations(spark.createDataFrame(rows, CONV), damage=False).collect()}
    assert got[1].audit == "KKK" and got[1].cost == 0 and got[2].audit == "IK"


# Filter audit


def expected_audit(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, part in rows:
        t = text or ""
        w = [x for x in "".join("\n" if c in SPACE else c for c in t).split("\n") if x]
        fails = {
            f for f, bad in zip("ABCDE", (
                len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t],
            ), strict=True) if bad
        }
        docs.append((part or "", fails, i in good, i in toxic))
    out = set()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        table = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                failing = sum(f in d[1] for d in mine)
                left = [d for d in left if f not in d[1]]
                removed_by[f] += len(here)
                table.append((part, order, step, len(left), len(here), failing - len(here), sum(d[1] == {f} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here)))
        out |= {(*row, removed_by[row[1][row[2] - 1]]) for row in table}
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(11)
    texts = [text_of(rng, n) for n in (3, 60, 200)] + [" ".join(["go", "on"] * 40), "SHOUT " * 60, text_of(rng, 70) + " $5 & more", "", None, "A b\x0bc", "é" * 30]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["x", "x", "y", None, ""])) for _ in range(150)]
    rows += [(900 + i, texts[1], "x") for i in range(70)] + rows[:4]
    labels = [(i, rng.choice([0, 1, None, 2]), rng.choice([0, 1, None])) for i in range(0, 960, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 7, "c") for r in rows], DOCS + ", mask int, part string").repartition(6)
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * 3
    assert {tuple(r) for r in got} == expected_audit(rows, labels)


def test_cells_are_the_exact_inverse(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(2), rng.randrange(2), rng.randrange(32)) for _ in range(3000)]
    got = {r.part: r for r in mask_cells(spark.createDataFrame(rows, "part string, good int, toxic int, mask int")).collect()}
    for part in "ab":
        assert list(got[part].n) == [sum(r[0] == part and r[3] == m for r in rows) for m in range(32)]
        assert list(got[part].toxic) == [sum(r[0] == part and r[3] == m and r[2] for r in rows) for m in range(32)]


def test_audit_of_no_documents(spark):
    assert filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
