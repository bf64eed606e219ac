"""Repair of conversations: the cheapest edits that leave `(system? (user assistant)+)?`, found by iterative-deepening A*.

The search goes over (row, what the roles so far allow). From a state it tries, in ASCII order, D(elete), I(nsert), K(eep) and
R(erole); which role is inserted or given follows from the state. Depth first under a bound on cost plus estimate, it ends at
the first path that accepts; where none does, the bound rises to the least sum that passed it. A transposition table keeps
with each state the largest budget with which it has failed in a round, so no state is searched twice for nothing. The estimate
is admissible: the cost of the same rows under the pattern with two of its four states made one. It is at most two insertions
short, so a round costs time in proportion to the rows, and there are few rounds however long a conversation is.

What is searched is a letter for each row (its role and fault). Spark does the rest: rows are damaged and numbered by
conversation and turn, a text seen earlier is told by the least number of each (conversation, role, digest), aggregated before
it is moved; edits go back to the rows by number and a last pass in order streams each repaired conversation through its hash.
A worker holds a letter, its estimates and its place on the path for each row of one conversation (some 50 bytes), never its texts. The
audit and the hash are of a whole conversation in order, so its letters, and its texts as a stream, do pass one task, however
long it is; what else is done by conversation is aggregated first or numbered, and dealt by row.

Defined cases: a null in any column reads as one space, so a null turn comes first, a null conv_id names a conversation of its own,
and a null text is blank; rows of one turn are ordered by role and text; equal rows are duplicates of the first; a role that
begins with none of s, u, a can only be changed or deleted; a conversation of which no row is left has zeros, an empty audit and
the hash of nothing; texts and conversations of any length are repaired whole; a table without rows gives none. Only conv_id,
turn, role and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, read, ship, slices

#: Costs of the edits, and of a truncated row that is not deleted.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: By state: the state that each kept initial leads to, and the role that an insertion or a change gives.
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ACCEPTS = (START, ASSISTANT)
WHITE = " \t\n\x0b\x0c\r"
#: Rows of conversations whose search a worker remembers.
REMEMBERED = 64


def _allowed(row: str, state: int) -> tuple[tuple[int, int, int, int], ...]:
    """(letter, cost, rows passed, state) of the edits that a state allows, in ASCII order; `row` is empty behind the last one."""
    out = [("D", DELETE, 1, state)] if row else []
    out.append(("I", INSERT, 0, NEXT[state]))
    if row and row != "x":
        extra, initial = (TRUNCATED, row.lower()) if row.isupper() else (0, row)
        if (to := KEEPS[state].get(initial)) is not None:
            out.append(("K", extra, 1, to))
        out.append(("R", REROLE + extra, 1, NEXT[state]))
    return tuple((ord(letter), *rest) for letter, *rest in out)


#: Letters of rows: by role, in capitals if truncated, and x for one that must go.
LETTERS = "suaoSUAOx"
MOVES = {(row, state): _allowed(row, state) for row in ("", *LETTERS) for state in range(4)}


def estimates(rows: str) -> list[array]:
    """By state, for each place, a lower bound of what is left to pay: the pattern without the rule that a system row needs a pair behind it."""
    out = [array("q", bytes(8 * (len(rows) + 1))) for _ in range(3)]
    start, user, assistant = 0, INSERT, 0
    out[1][len(rows)] = user
    for i in range(len(rows) - 1, -1, -1):
        row = rows[i]
        s, u, a = start + DELETE, user + DELETE, assistant + DELETE
        if row != "x":
            extra, initial = (TRUNCATED, row.lower()) if row.isupper() else (0, row)
            s, u, a = min(s, REROLE + extra + user), min(u, REROLE + extra + assistant), min(a, REROLE + extra + user)
            if initial == "s":
                s = min(s, extra + assistant)
            elif initial == "u":
                s, a = min(s, extra + user), min(a, extra + user)
            elif initial == "a":
                u = min(u, extra + assistant)
        user, assistant = min(u, INSERT + a), min(a, INSERT + u)
        start = min(s, INSERT + user)
        out[0][i], out[1][i], out[2][i] = start, user, assistant
    start, user, assistant = out
    return [start, assistant, user, assistant]


def repair(rows: str) -> tuple[int, str]:
    """(cost, edits) of rows given by LETTERS."""
    return _remembered(rows) if len(rows) <= REMEMBERED else _search(rows)


@lru_cache(maxsize=100_000)
def _remembered(rows: str) -> tuple[int, str]:
    return _search(rows)


def _search(rows: str) -> tuple[int, str]:
    ahead = estimates(rows)
    bound = ahead[START][0]
    while True:
        found, bound = _round(rows, ahead, bound)
        if found is not None:
            return bound, found


def _round(rows: str, ahead: list[array], bound: int) -> tuple[str | None, int]:
    """The first accepting path in ASCII order within the bound, else the next bound. The path so far lies in arrays of numbers."""
    failed: dict[int, int] = {}
    beyond, n = 1 << 62, len(rows)
    path, states, tried, paid, places = bytearray(), bytearray([START]), bytearray([0]), array("q", [0]), array("q", [0])
    if n == 0:
        return "", bound
    while states:
        at, state, sum_, k = places[-1], states[-1], paid[-1], tried[-1]
        moves = MOVES[rows[at] if at < n else "", state]
        if k == len(moves):
            failed[4 * at + state] = bound - sum_
            for stack in (states, tried, paid, places):
                stack.pop()
            if path:
                path.pop()
            continue
        tried[-1] = k + 1
        letter, cost, step, to = moves[k]
        i, total = at + step, sum_ + cost
        if total + ahead[to][i] > bound:
            beyond = min(beyond, total + ahead[to][i])
        elif bound - total > failed.get(4 * i + to, -1):
            path.append(letter)
            if i == n and to in ACCEPTS:
                return path.decode(), bound
            states.append(to)
            tried.append(0)
            paid.append(total)
            places.append(i)
    return None, beyond


# the rows in Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text, copy and dropped: rows after the damage that crc32 of `conv_id:turn` deals them."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")))
    key, turn = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn"))
    c = c.withColumn("key", key).withColumn("fate", F.crc32(F.concat(key, F.lit(":"), turn)) % 20)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.select("key", "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("dropped"), F.explode(times).alias("copy"))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows that are left, with `pos`: their place in the conversation from 1."""
    w = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "text", "copy")
    return rows.where("not dropped").select("key", "role", "text", F.row_number().over(w).alias("pos"))


def lettered(rows: DataFrame) -> DataFrame:
    """key, pos, initial and fault (b, d, t or none) of numbered rows."""
    bare = F.rtrim("text", F.lit(WHITE))
    slim = rows.select(
        "key", "pos", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
    )
    first = slim.groupBy("key", "digest").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("cut"), "t").otherwise("")
    return slim.join(first, ["key", "pos"], "left").select("key", "pos", "initial", fault.alias("fault"))


AUDITS = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_AUDITS = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in AUDITS.split(", ")])
#: The pairs of initials that may follow each other.
LEGAL = ("su", "ua", "au")


class _Rows:
    """What a conversation's rows say, fed one by one: a letter for each, and counts."""

    def __init__(self, key: str) -> None:
        self.key, self.letters, self.counts, self.illegal, self.before = key, bytearray(), Counter(), 0, None

    def feed(self, initial: str, fault: str) -> None:
        role = initial if initial in ("s", "u", "a") else "o"
        self.illegal += self.before is not None and self.before + role not in LEGAL
        self.before = role
        self.counts[fault] += 1
        self.letters += ("x" if fault in ("b", "d") else role.upper() if fault else role).encode()

    def row(self) -> tuple:
        cost, audit = repair(self.letters.decode())
        return self.key, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, cost, audit


def _audits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(rows: list[tuple]) -> pa.RecordBatch:
        return batches(dict(zip(_AUDITS.names, zip(*rows, strict=True) if rows else [[]] * len(_AUDITS), strict=True)), _AUDITS)

    now = None
    for b in slices(it):
        done = []
        for key, initial, fault in zip(*(b.column(x).to_pylist() for x in ("key", "initial", "fault")), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    done.append(now.row())
                now = _Rows(key)
            now.feed(initial, fault)
        yield told(done)
    if now is not None:
        yield told([now.row()])


def audits(letters: DataFrame) -> DataFrame:
    """One row for each conversation: counts of faults and illegal neighbours, cost and edits."""
    return letters.repartition("key").sortWithinPartitions("key", "pos").select("key", "initial", "fault").mapInArrow(_audits, AUDITS)


_ROLES = {USER: b"user", ASSISTANT: b"assistant"}


class _Hash:
    """The hash of a repaired conversation, fed row by row."""

    def __init__(self) -> None:
        self.sha, self.state, self.rows = hashlib.sha256(), START, 0

    def feed(self, edits: str, role: bytes, text: bytes) -> None:
        for e in edits:
            if e == "D":
                continue
            if e == "K":
                out, self.state = role + b":" + text, KEEPS[self.state][role[:1].decode()]
            else:
                self.state = NEXT[self.state]
                out = _ROLES[self.state] + b":" + (text if e == "R" else b"")
            self.sha.update((b"\n" if self.rows else b"") + out)
            self.rows += 1


def _hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "repaired_sha256"]
    key = now = None
    edits = ""
    for b in slices(it):
        done = []
        role, text = (b.column(x).cast(pa.binary()).to_pylist() for x in ("role", "text"))
        for k, e, r, t in zip(b.column("key").to_pylist(), b.column("edits").to_pylist(), role, text, strict=True):
            if k != key:
                if now is not None:
                    done.append((key, now.sha.hexdigest()))
                key, now = k, _Hash()
            if e is None:
                now.feed(edits, r, t)
            elif "D" in e or "K" in e or "R" in e:
                edits = e  # of the row that comes next
            else:
                now.feed(e, b"", b"")
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([now.sha.hexdigest()])], names=names)


def hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key and repaired_sha256: each row's edits, and then the row, in order through one hash a conversation."""
    each = F.regexp_extract_all("audit", F.lit("I*[DKR]|I+$"), 0)
    edits = found.select("key", F.posexplode(each).alias("pos", "edits")).select("key", (F.col("pos") + 1).alias("pos"), F.lit(0).alias("kind"), "edits", *(F.lit(None).cast("string").alias(c) for c in ("role", "text")))
    both = edits.unionByName(rows.select("key", "pos", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edits"), "role", "text"))
    ordered = both.repartition("key").sortWithinPartitions("key", "pos", "kind")
    return ordered.select("key", "edits", "role", "text").mapInArrow(_hashes, "key string, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    rows = damaged(conversations)
    left = F.when(~F.col("dropped"), F.col("turn"))
    gaps = F.coalesce(F.max(left) - F.min(left) + 1 - F.count_distinct(left), F.lit(0))
    all_ = rows.groupBy("key").agg(F.max("conv_id").alias("conv_id"), gaps.cast("long").alias("gaps"))
    kept = cut(numbered(rows))
    found = cut(audits(lettered(kept)))
    out = all_.join(found, "key", "left").join(hashes(kept, found), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    return repaired(read(spark, sf_dir, "conversations"))
