"""Repair of conversations by least-cost edits, computed once per shared beginning.

A conversation is its signature: one symbol per row, in order of turn, that says the row's role and fault. Equal and similar
signatures are many, so the signatures of all conversations are sorted over the cluster; a task walks its run of them as a
prefix trie, of which it holds the path to the present one. Every node of the path has one layer of the edit programme,
computed from its parent's when the node is first met; a signature's answer is read at its last node. A frequent
signature is sorted by conversation as well, so it spreads over tasks.

Only symbols and digests travel before the answers are known; texts travel once, sorted, behind their conversation's answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import SPACE_CHARS, keep

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # what edits cost, and a truncated row that stays
USER, ASSISTANT = "user", "assistant"
DROP, BLANK, CUT, REPEAT, AS_USER, KINDS = 0, 1, 2, 3, 4, 20  # of crc32("conv_id:turn") % KINDS

# States: nothing yet, s, ...u, ...a. What may follow them, and which may end a conversation.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
_WANTED = ("u", "u", "a", "u")  # the role that an inserted or reroled row has after each state


def _inserts() -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of the inserts between two rows; longer ones only come back to where they began."""
    out = []
    for p in range(4):
        out.append((p, p, 0, ""))
        q = _NEXT[p, _WANTED[p]]
        out.append((p, q, INSERT, "I"))
        if (r := _NEXT[q, _WANTED[q]]) != p:
            out.append((p, r, 2 * INSERT, "II"))
    return out


def _steps(symbol: str) -> list[list[tuple[int, int, str]]]:
    """For each state after a row with this symbol: (state before it, cost, edits)."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(4)]
    for p, q, cost, edits in _inserts():
        out[q].append((p, cost + DELETE, edits + "D"))
        if symbol != "x":
            more = cost + TRUNCATED * symbol.isupper()
            if (t := _NEXT.get((q, symbol.lower()))) is not None:
                out[t].append((p, more + KEEP, edits + "K"))
            out[_NEXT[q, _WANTED[q]]].append((p, more + REROLE, edits + "R"))
    return out


_STEPS = {s: _steps(s) for s in "suaoSUAOx"}
_LAST = [(p, cost, edits) for p, q, cost, edits in _inserts() if q in _ENDS]


class Trie:
    """The path to one signature. A layer holds per state (cost, rank, state before, edits); rank orders the edits so far of
    the states, which needs no texts of edits: all have one edit per row, so none is a proper prefix of another."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.layers: list[list[tuple | None]] = [[(0, 0, 0, ""), None, None, None]]
        self.computed = 0

    def _layer(self, before: list[tuple | None], symbol: str) -> list[tuple | None]:
        best: list[tuple | None] = []
        for ways in _STEPS[symbol]:
            found = [(before[p][0] + cost, before[p][1], edits, p) for p, cost, edits in ways if before[p]]
            best.append(min(found) if found else None)
        order = sorted({b[1:3] for b in best if b})
        self.computed += 1
        return [b and (b[0], order.index(b[1:3]), b[3], b[2]) for b in best]

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of the cheapest repair, of equal ones the least edits."""
        same = 0
        for a, b in zip(self.symbols, signature):
            if a != b:
                break
            same += 1
        del self.symbols[same:], self.layers[same + 1 :]
        for symbol in signature[same:]:
            self.layers.append(self._layer(self.layers[-1], symbol))
            self.symbols.append(symbol)
        last = self.layers[-1]
        cost, _, edits, state = min((last[p][0] + c, last[p][1], e, p) for p, c, e in _LAST if last[p])
        out = [edits]
        for layer in reversed(self.layers[1:]):
            _, _, state, edits = layer[state]
            out.append(edits)
        return cost, "".join(reversed(out))


def damaged(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, times): times is how often a row stays. Null roles and texts are one space, as are null
    ids and turns in the text whose checksum decides."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some(conv_id), F.lit(":"), some(turn)).cast("binary")) % KINDS
    base = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"), kind.alias("kind"))
    cut = F.when(F.col("kind") == BLANK, F.lit("")).when(F.col("kind") == CUT, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == DROP, 0).when(F.col("kind") == REPEAT, 2).otherwise(1)
    return base.select("conv_id", "turn", F.when(F.col("kind") == AS_USER, USER).otherwise(F.col("role")).alias("role"), cut.alias("text"), times.cast("int").alias("times"))


def undamaged(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"), F.lit(1).alias("times"))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_LEGAL = {"su", "ua", "au"}


def _facts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations, each in order of turn -> one row per conversation: counts and signature."""
    out: list[tuple] = []
    size = 0
    now, state = None, None

    def done(conv, s) -> tuple:
        turns, least, most, counts, symbols = s[0], s[1], s[2], s[3], s[5]
        gaps = most - least + 1 - turns if turns else 0
        return (conv, gaps, *counts, bytes(symbols).decode())

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for conv, turn, role, digest, filled, ended, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != now:
                if state is not None:
                    out.append(done(now, state))
                    size += len(out[-1][-1]) + 64
                # distinct turns, least, greatest, counts, digests seen, symbols, last turn, last initial
                now, state = conv, [0, 0, 0, [0, 0, 0, 0], set(), bytearray(), None, None]
                if size > 1 << 20:
                    yield flush()
                    out, size = [], 0
            if times and turn is not None and turn != state[6]:
                state[1] = state[1] if state[0] else turn
                state[0], state[2], state[6] = state[0] + 1, turn, turn
            counts, initial = state[3], role[:1]
            for _ in range(times):
                if state[7] is not None and state[7] + initial not in _LEGAL:
                    counts[3] += 1
                state[7] = initial
                if not filled:
                    counts[0] += 1
                    symbol = "x"
                elif digest in state[4]:
                    counts[1] += 1
                    symbol = "x"
                else:
                    symbol = initial if initial in ("s", "u", "a") else "o"
                    if not ended:
                        counts[2] += 1
                        symbol = symbol.upper()
                    state[4].add(digest)
                state[5] += symbol.encode()
    if state is not None:
        out.append(done(now, state))
    if out:
        yield flush()


def _answers(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature -> the same rows with cost and edits."""
    trie, last, found = Trie(), None, None
    for batch in batches:
        costs, audits = [], []
        for signature in batch.column("signature").to_pylist():
            if signature != last:
                last, found = signature, trie.answer(signature)
            costs.append(found[0])
            audits.append(found[1])
        columns = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != "signature"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], schema=schema)


class _Repair:
    """The repaired text of one conversation, hashed as its rows come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.wanted, self.hash, self.first = audit, 0, USER, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False
        self.wanted = ASSISTANT if role[:1] == "u" else USER

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._put(self.wanted, "")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._put(role if edit == "K" else self.wanted, text)

    def hexdigest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each conversation's answer followed by its rows -> the answer with the hash of the repaired text."""
    out: list[list] = []
    repair = None
    for batch in batches:
        for *answer, role, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if role is None:
                if repair is not None:
                    out[-1].append(repair.hexdigest())
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
                out.append(answer)
                repair = _Repair(answer[-1])
            else:
                for _ in range(times):
                    repair.row(role, text)
    if repair is not None:
        out[-1].append(repair.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repair_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = True
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With `damage`, rows are first damaged by the checksum of their id and turn. A conversation's rows are taken in order of
    turn, null turns first, rows of one turn in the order of role and of the digest of their text (so repeated rows stand
    side by side). Null roles and texts are one space. A role stands for its first character; the empty role and others than
    s, u and a fit nowhere. A conversation none of whose rows is left has zeros, no edits and the hash of nothing. Null ids
    are one conversation. Turns are whole numbers. An empty table gives no rows; other columns are ignored.

    A conversation is one row of the result, so its rows meet in one task, which streams them from Spark's sort: it holds
    a symbol and a digest per row there, and of texts only one Arrow batch.
    """
    source = (damaged if damage else undamaged)(rows, conv_id, turn, role, text)
    key = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest")
    bare = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    facts_of = source.select("conv_id", "turn", "role", key, (bare != "").alias("filled"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"), "times")
    id_type = next(f for f in source.schema if f.name == "conv_id").dataType.simpleString()
    by_turn = ("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    # What Spark and Arrow call a type is told by an empty frame of it.
    arrow_id = rows.select(F.col(conv_id)).limit(0).toArrow().schema.field(0).type
    fields = [pa.field("conv_id", arrow_id), *[pa.field(c, pa.int64()) for c in _COUNTS]]
    signed = pa.schema([*fields, pa.field("signature", pa.string())])
    answered = pa.schema([*fields, pa.field("cost", pa.int64()), pa.field("audit", pa.string())])
    hashed = pa.schema([*answered, pa.field("repaired_sha256", pa.string())])

    facts = keep(
        facts_of.repartition("conv_id").sortWithinPartitions(*by_turn)
        .mapInArrow(lambda b: _facts(b, signed), f"conv_id {id_type}, {counts}, signature string")
    )
    answers = keep(
        facts.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature")
        .mapInArrow(lambda b: _answers(b, answered), f"conv_id {id_type}, {counts}, cost long, audit string")
    )
    none = lambda t: F.lit(None).cast(t)
    empty = [none("long").alias(c) for c in (*_COUNTS, "cost")]
    head = answers.select("*", none("string").alias("role"), none("string").alias("text"), none("int").alias("times"), none("long").alias("turn"), none("binary").alias("digest"), F.lit(0).alias("behind"))
    body = source.where("times > 0").select("conv_id", *empty, none("string").alias("audit"), "role", "text", "times", "turn", key, F.lit(1).alias("behind"))
    return (
        head.unionByName(body).repartition("conv_id")
        .sortWithinPartitions("conv_id", "behind", F.col("turn").asc_nulls_first(), "role", "digest")
        .select("conv_id", *_COUNTS, "cost", "audit", "role", "text", "times")
        .mapInArrow(lambda b: _repaired(b, hashed), f"conv_id {id_type}, {counts}, cost long, audit string, repaired_sha256 string")
    )
