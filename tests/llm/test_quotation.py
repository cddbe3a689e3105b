import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quern.llm import queries
from quern.llm import quotation as q


def level_of(line):
    m = re.match(r"^[ \t]*((?:>[ \t]?)+)", line)
    return (m[1].count(">"), line[m.end() :]) if m else (0, line)


def clean(lines):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", " ".join(level_of(x)[1] for x in lines).lower()).strip(" ")


def split_sentences(norm):
    out, now, closed = [], "", False
    for c in norm:
        if c not in ".!?":
            if closed:
                out.append(now)
                now, closed = "", False
            now += c
        elif now:
            now, closed = now + c, True
    return [x.strip(" ") for x in [*out, now] if x.strip(" ")]


def brute(rows):
    """The module's statement in plain Python: passages, links, replies and a recursive walk."""
    msgs = sorted({(c, t, r or "unknown", x or "") for c, t, r, x in rows}, key=str)
    parts = {}
    for m in msgs:
        runs = []
        for line in m[3].split("\n"):
            if not runs or runs[-1][0] != level_of(line)[0]:
                runs.append((level_of(line)[0], []))
            runs[-1][1].append(line)
        parts[m] = runs
    units = defaultdict(set)
    for m in msgs:
        for level, lines in parts[m]:
            if level == 0:
                paragraphs = [p.split("\n") for p in re.split(r"\n(?:[ \t\x0b\f\r]*(?:\n|$))+", "\n".join(lines))]
                for u in (clean(lines), *map(clean, paragraphs), *(clean([x]) for x in lines)):
                    units[m[0], m[1]] |= {u, *split_sentences(u)} - {""}
    gone, votes = defaultdict(set), defaultdict(lambda: defaultdict(int))
    for m in msgs:
        c, t = m[:2]
        if c is None or t is None:
            continue

        def source(u):
            return max((v for (d, v), has in units.items() if d == c and v is not None and v < t and u in has), default=None)

        for at, (level, lines) in enumerate(parts[m]):
            norm = clean(lines)
            if not level or not norm:
                continue
            n, found = len(norm), source(norm)
            if found is None:
                got, n = defaultdict(int), sum(map(len, split_sentences(norm)))
                for s in split_sentences(norm):
                    if source(s) is not None:
                        got[source(s)] += len(s)
                best = max(((k, v) for v, k in got.items()), default=(0, None))
                found = best[1] if best[0] * 2 >= n else None
            if found is not None:
                gone[m].add(at)
                votes[c, t][level, found] += n
    turns = defaultdict(set)
    for c, t, *_ in msgs:
        if c is not None and t is not None:
            turns[c].add(t)
    out = []
    for c, known in turns.items():
        parent, children = {}, defaultdict(list)
        for t in sorted(known):
            v = votes.get((c, t))
            parent[t] = max((-lv, n, s) for (lv, s), n in v.items())[2] if v else max((u for u in known if u < t), default=None)
            children[parent[t]].append(t)
        order, stack = [], children[None][::-1]
        while stack:
            order.append(stack.pop())
            stack += children[order[-1]][::-1]
        said = []
        for t in order:
            for m in sorted(m for m in msgs if m[0] == c and m[1] == t):
                own = "\n".join("\n".join(lines) for at, (_, lines) in enumerate(parts[m]) if at not in gone[m])
                said.append((f"<|{m[2]}|>\n" + own.strip(" \t\n\r\x0b\f"), bool(votes.get((c, t)))))
        for b in range(0, len(said), q.BLOCK):
            some = said[b : b + q.BLOCK]
            out.append((c, min(known), b // q.BLOCK, len(some), sum(x for _, x in some), "\n".join(x for x, _ in some)))
    for c, t, r, x in msgs:
        if c is None or t is None:
            out.append((c, t, None if t is None else 0, 1, 0, f"<|{r}|>\n" + x.strip(" \t\n\r\x0b\f")))
    return sorted(out, key=str)


def sql_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(queries.oracle_sql()["op7_quotation"]).fetchall(), key=str)


def test_sql_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op7_quotation(spark, "/root/testdata/sf0.01").collect()), key=str) == sql_rows(rows)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, thread int, id string")
    return sorted((tuple(r) for r in q.conversations(df).collect()), key=str)


@pytest.mark.parametrize("local", [100_000, 3])
def test_against_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(q, "LOCAL_TURNS", local)  # 3: conversations are ordered by joins
    monkeypatch.setattr(q, "STEP_BITS", 12 if local > 3 else 2)
    monkeypatch.setattr(q, "BLOCK", 64)
    rng, rows = random.Random(3), []
    for c in range(12):
        said = []
        for t in range(rng.randint(1, 100 if c == 0 else 14)):
            lines = []
            if said and rng.random() < 0.7:
                quoted = rng.choice(said).replace("\r", "").split("\n")
                kind = rng.random()
                if kind < 0.3:
                    quoted = quoted[:1]
                elif kind < 0.5:  # wrapped otherwise
                    words = " ".join(quoted).upper().split()
                    quoted = [" ".join(words[i : i + 3]) for i in range(0, len(words), 3)]
                elif kind < 0.7:
                    quoted = [*quoted, "words that nobody wrote. At all!"]
                lines += [rng.choice(["> ", ">> ", "> > "])[:] + x if rng.random() < 0.9 else "> " + x for x in quoted]
            lines.append(rng.choice(["thanks", "ok", f"Point {rng.randint(0, 30)}. It is {rng.randint(0, 9)}!", f"well   said {t}"]))
            if rng.random() < 0.3:
                lines += ["", "", f"a second paragraph of {t},\nin two lines. And more?"]
            lines.append(f"more {t}\r")
            said.append("\n".join(lines))
            rows.append((c, t * (1 if c % 2 else 3), rng.choice(["user", "assistant", None]), said[-1]))
    rows += [(50, 0, "user", None), (50, 1, "user", "> nothing known\n\nx"), (50, 1, "user", "> nothing known\n\nx"), (50, 1, "assistant", "other"), (None, 3, "user", "> a"), (51, None, "user", "lone"), (52, 7, "user", "y. " * 30_000), (53, 2, "user", "> quote\n  > > deep\n"), (54, -5, "u", "before"), (54, 1 << 40, "u", "> before\nlate")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [])[:1] == []
    if local > 3:
        monkeypatch.setattr(q, "BLOCK", 1024)
        assert sql_rows(rows) == brute(rows)


def test_reply_order(spark):
    """Answers follow what they answer: root, A, C (to A), B, D (to B)."""
    rows = [(1, 0, "u", "root words"), (1, 1, "u", "> root words\nview A"), (1, 2, "u", "> root words\nview B"), (1, 3, "u", "> view A\nview C"), (1, 4, "u", "> view B\nview D")]
    assert run(spark, rows)[0][5] == "\n".join(f"<|u|>\n{x}" for x in ("root words", "view A", "view C", "view B", "view D"))


def test_passages_and_levels(spark):
    rows = [
        (1, 0, "u", "The first line\nwraps here. A second sentence."),
        (1, 1, "u", "ok"),
        (1, 2, "u", "> the first line wraps\n> here. a second sentence.\nyes\n> ls -l\n> cd /tmp"),  # re-wrapped; a shell prompt stays
        (1, 3, "u", ">> The first line wraps here. A second sentence.\n> yes\nfine"),
        (1, 4, "u", ">> ok\nonly an ancestor is known"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = q.messages_of(df)
    linked = q.links(messages)
    assert sorted((r.turn, r.level, r.source) for r in linked.collect()) == [(2, 1, 0), (3, 1, 2), (3, 2, 0), (4, 2, 1)]
    assert sorted((r.turn, r.reply_to, r.by) for r in q.replies(messages, linked).collect()) == [(0, None, None), (1, 0, "turn"), (2, 0, "quote"), (3, 2, "quote"), (4, 1, "quote")]
    chat = q.conversations(df).first().chat
    assert "> ls -l\n> cd /tmp" in chat and "wraps\n>" not in chat


def test_lone_and_repeated_turns(spark, monkeypatch):
    monkeypatch.setattr(q, "BLOCK", 64)
    lone = [(None, 3, "user", "one"), (None, 3, "user", "two"), (None, 3, None, "two"), (8, None, "user", "x"), (8, None, "user", "y"), (None, None, "user", "z"), (None, None, "user", "z2")]
    many = [(9, 5, "user", f"{i:03} says") for i in range(150)] + [(9, 70, "user", "last")]
    chats = [f"<|user|>\n{x}" for _, _, _, x in many]
    want = [(c, t, None if t is None else 0, 1, 0, f"<|{r or 'unknown'}|>\n{x}") for c, t, r, x in lone]
    want += [(9, 5, b, len(part), 0, "\n".join(part)) for b, part in enumerate([chats[:64], chats[64:128], chats[128:]])]
    assert run(spark, lone + many) == sorted(want, key=str)


def test_reading_order():
    assert q.reading_order(np.array([-1, 0, 0, 1, 2, 1])).tolist() == [0, 1, 4, 2, 5, 3]
