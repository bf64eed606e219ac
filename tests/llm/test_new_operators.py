"""Exact copies, fill-in-middle and conversation repair against brute force, and on edge rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagweave.llm import common, conversation_repair, exact_dedup, fill_in_middle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, keep_id string, n long"
LONG = " ".join(f"word{i}" for i in range(60_000))


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(7, None), (9, ""), (3, "a  b\n"), (2, "a b "), (2, "a b "), (5, "a b"), (None, LONG), (8, LONG.replace(" ", "\t\n")), (None, "é"), (None, "é"), (6, " "), (4, "\n\t"), (1, "a b c"), (10, "see <P> here"), (11, "ÄÖ" * 50), (-1, "a")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


# exact copies


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        place = ids.index(keep)
        out += [(i, keep, len(ids), k == place, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bounds", [(1 << 25, 10_000), (100, 10_000), (1 << 25, 2)])
def test_exact_dedup(spark, edge, bounds):
    assert sorted(map(tuple, exact_dedup.copies(edge, *bounds).collect()), key=repr) == brute_copies([(r.doc_id, r.text) for r in edge.collect()])
    assert exact_dedup.copies(edge.limit(0), *bounds).count() == 0


def test_exact_dedup_of_all_documents(spark):
    docs = common.read(spark, SF, "documents")
    twice = docs.unionByName(docs.selectExpr("doc_id + 100000 as doc_id", "concat(text, '\n') as text", "lang", "source", "n_chars")).repartition(7)
    assert sorted(map(tuple, exact_dedup.copies(twice, 20_000, 50).collect()), key=repr) == brute_copies([(r.doc_id, r.text) for r in twice.collect()])


@given(st.lists(st.text("ab", max_size=6).map(str.encode)), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_trie_counts_every_key(keys, limit):
    trie, got = exact_dedup.Trie(limit, 5), collections.Counter()
    for k in keys:
        end = trie.node(k)
        end.value = (end.value or 0) + 1
        for key, n in trie.full():
            got[key] += n
        assert trie.bytes <= limit and trie.n <= 5
    for key, n in trie.rest():
        got[key] += n
    assert got == collections.Counter(keys) and trie.bytes == trie.n == 0


@given(st.text(" a\n\x0b\x1c\x85 ", max_size=12))
def test_white_space(text):
    assert exact_dedup.normalized(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)


# fill-in-middle


def brute_middle(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, sha = len(text), lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = "<P>" + text[:a], "<S>" + text[b:], "<M>" + text[a:b]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = "".join(parts if form == "psm" else (parts[1], parts[0], parts[2]))
    return doc_id, n, form, a, b - a, sha(out), sha(text)


def test_fill_in_middle(spark, edge):
    docs = common.read(spark, SF, "documents")
    for df in (edge, docs, edge.limit(0)):
        both = fill_in_middle.restored(fill_in_middle.transform(df))
        got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, *(hashlib.sha256(x.encode()).hexdigest() for x in (r.output, r.restored))) for r in both.collect()]
        assert sorted(got, key=repr) == sorted((brute_middle(r.doc_id, r.text or "") for r in df.collect()), key=repr)


@given(st.text("aé€😀<PSM> \n", max_size=300), st.integers(0, 400))
@settings(max_examples=300, deadline=None)
def test_forms_round_trip(text, doc_id):
    out, form, n, *_ = fill_in_middle.arrange(text.encode(), doc_id)
    assert fill_in_middle.restore(out, form).decode() == text and n == len(text)


@given(st.text("aé€😀 ", max_size=700), st.sampled_from([None, r"\w+", r"(?s).", r"[^ ]+ *"]), st.data())
@settings(max_examples=200, deadline=None)
def test_ranks_are_exact(text, unit, data):
    lanes = fill_in_middle.SkipList(text.encode(), re.compile(unit) if unit else None)
    begins = [m.start() for m in re.finditer(unit or "(?s).", text)]
    assert lanes.n == len(begins)
    rank = data.draw(st.integers(0, lanes.n))
    cut = 0 if rank == 0 else [*begins, len(text)][rank]
    assert lanes.find(rank) == (cut, len(text[:cut].encode()))


def test_ranks_of_a_long_text():
    text = ("aé€😀" * 50_000).encode()
    lanes = fill_in_middle.SkipList(text)
    assert len(lanes.lanes) > 3 and all(lanes.find(4 * k) == (4 * k, 10 * k) for k in (0, 1, 777, 49_999, 50_000))


# conversation repair


def brute_repair(rows):
    """(cost, edits) by a table of the least (cost, edits) from each place and state."""
    to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    states, best = ("", "s", "u", "a"), {}
    for i in range(len(rows), -1, -1):
        here = {q: (0, "") if i == len(rows) and q in ("", "a") else (10**9, "") for q in states}
        if i < len(rows):
            initial, fault = rows[i]
            extra = 3 if fault == "t" else 0
            for q in states:
                found = [(4, "D", q)]
                if fault not in ("b", "d"):
                    found += [(extra, "K", to[q, initial])] if (q, initial) in to else []
                    found += [(3 + extra, "R", to[q, x]) for x in "ua" if (q, x) in to]
                here[q] = min((c + best[i + 1, t][0], e + best[i + 1, t][1]) for c, e, t in found)
        for _ in range(4):
            here = {q: min([here[q], *((3 + here[to[q, x]][0], "I" + here[to[q, x]][1]) for x in "ua" if (q, x) in to)]) for q in states}
        best |= {(i, q): here[q] for q in states}
    return best[0, ""]


def letters(rows):
    return "".join("x" if f in ("b", "d") else (i if i in ("s", "u", "a") else "o").upper() if f else (i if i in ("s", "u", "a") else "o") for i, f in rows)


@given(st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from(["", "", "", "b", "d", "t"])), max_size=14))
@settings(max_examples=600, deadline=None)
def test_edits_are_the_cheapest_and_least(rows):
    assert conversation_repair.repair(letters(rows)) == brute_repair(rows)


def test_long_conversations_are_searched_in_time():
    deal = random.Random(5)
    rows = [(deal.choice("suat"), deal.choice(["", "", "b", "d", "t"])) for _ in range(3000)]
    assert conversation_repair.repair(letters(rows)) == brute_repair(rows)
    assert conversation_repair.repair("s" * 20_000)[0] == 3 * 19_998 + 4
    assert conversation_repair.repair("ua" * 20_000) == (0, "K" * 40_000)


def brute_conversations(table):
    rows = collections.defaultdict(list)
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        rows[conv] += [] if fate == 0 else [(turn, role, text)] * (1 + (fate == 3))
    out = []
    for conv, own in rows.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else "" if last in ".!?" else "t")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = brute_repair(list(zip(initials, faults, strict=True)))
        made, i, state = [], 0, ""
        for e in audit:
            give = "assistant" if state == "u" else "user"
            if e == "K":
                made.append(f"{own[i][1]}:{own[i][2]}")
            elif e != "D":
                made.append(f"{give}:{own[i][2] if e == 'R' else ''}")
            state = made[-1][0] if e != "D" else state
            i += e != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made))
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_conversation_repair(spark):
    table = common.read(spark, SF, "conversations")
    got = sorted(map(tuple, conversation_repair.op13_conversation_repair(spark, SF).collect()), key=repr)
    assert got == brute_conversations([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])


def test_conversation_repair_edges(spark):
    deal = random.Random(3)
    rows = [(deal.choice([None, 1, 2, 3, 4]), deal.choice([None, *range(9)]), deal.choice(["user", "assistant", "system", "tool", "", None]), deal.choice([None, "", " \n", "Yes.", "No", "é! \t", "x" * 5000 + "?"])) for _ in range(150)]
    rows += [(50 + i, i, "user", "Hi.") for i in range(60)] + [(200, 1, "user", "Same.")] * 300
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, pos int")
    got = conversation_repair.repaired(df)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_conversations(rows)
    assert any(r.audit == "" and r.cost == 0 for r in got.collect()) and conversation_repair.repaired(df.limit(0)).count() == 0
