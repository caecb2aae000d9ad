"""Conversation repair against a search over all edits, and whitening against numpy."""

import hashlib
import heapq
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from shelfwatch.llm import repair, whitening
from shelfwatch.llm.queries import LLM_JOBS

SMALL = "/root/testdata/sf0.001"
SOLID = r"[^\x20\x09-\x0D]"


def damaged(rows):
    """Conversations after damage, {conv_id: [(turn, role, text)]}, with every conv_id."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0)
    for conv, turn, role, text in sorted(rows, key=key):
        some = out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        if fate:
            some += [(turn, role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows, faults):
    """Least (cost, audit) by Dijkstra's search over (row, roles so far as a pattern state)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "P", ("P", "u"): "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(rows) and state in ("", "P"):
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        for symbol in "ua":
            if (state, symbol) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", at, step[state, symbol]))
        if at < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state))
            if faults[at] not in ("blank", "duplicate"):
                more = 5 * (faults[at] == "truncated")
                for symbol, price, edit in [(rows[at][1][:1], 0, "K"), ("u", 1, "R"), ("a", 1, "R")]:
                    if (state, symbol) in step:
                        heapq.heappush(heap, (cost + price + more, audit + edit, at + 1, step[state, symbol]))


def expected(rows):
    out = {}
    for conv, some in damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in some:
            solid = re.findall(SOLID, text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in some if t is not None]
        cost, audit = cheapest(some, faults)
        lines, at = [], 0
        for edit in audit:
            if edit != "I":
                _, role, text = some[at]
                at += 1
            else:
                role, text = None, ""
            if edit in "IR":
                role = "assistant" if lines and lines[-1][:1] == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal,
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, h string, n int")
    found = repair.repair_conversations(frame).collect()
    want = expected(rows)
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def random_rows(seed, conversations, longest):
    draw = random.Random(seed)
    words = ["Yes.", "No!", "and then", "What?", "  ", "", "so.", "ends. \n"]
    return [(c, t, draw.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "Äx"]),
             draw.choice(words) if draw.random() < 0.3 else f"{draw.random()}" + draw.choice([".", "", "!"]))
            for c in range(conversations) for t in range(draw.randrange(1, longest))]


def test_random_conversations(spark):
    check(spark, random_rows(1, 300, 12))


@pytest.mark.parametrize("rows, chars", [(3, 10**6), (256, 40)])
def test_segments_compose(spark, monkeypatch, rows, chars):
    """Long conversations in small segments, one of them most of the table."""
    monkeypatch.setattr(repair, "SEGMENT_ROWS", rows)
    monkeypatch.setattr(repair, "SEGMENT_CHARS", chars)
    some = random_rows(2, 25, 30) + [(99, t, r, x) for t, (_, _, r, x) in enumerate(random_rows(3, 60, 10))]
    some += [(None, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(40)]
    check(spark, some)


def test_ties_take_the_least_audit(spark):
    """Rows that can be repaired in several ways of equal cost."""
    rows = [(c, t, role, f"text {t}.") for c, roles in enumerate(["uuuuu", "aaaaaaaaaaa", "sus", "auauauauau", "us", "s", "sss", "uau"]) for t, role in
            enumerate({"u": "user", "a": "assistant", "s": "system"}[r] for r in roles)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 5, "", "b."), (None, None, None, None), (2, 7, "assistant", "x" * 100_000 + "."), (3, 1, "user", None)]
    rows += [(4, 3, "user", "again.")] * 1000
    check(spark, rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_conversations(empty).count() == 0


def test_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    found = {r.conv_id: tuple(r)[1:] for r in LLM_JOBS["op13_repair"](spark, SMALL).collect()}
    assert found == want


def test_prefixes_of_audits_never_tie():
    """Tops of equal cost: no audit begins with another, so merging by (cost, audit) is exact."""
    draw = random.Random(5)
    for _ in range(200):
        symbols = "".join(draw.choice("sua ") + draw.choice("..xt") for _ in range(draw.randrange(8)))
        for entry in repair.TOPS:
            ways = list(repair.leave(entry, symbols).values())
            assert not any(a[0] == b[0] and a[1] != b[1] and b[1].startswith(a[1]) for a in ways for b in ways)


# --- whitening ---------------------------------------------------------------------------------------------

def expected_whitening(vectors):
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[i] for row in x) for i in range(d)]
    centred = [[n * a - b for a, b in zip(row, s)] for row in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in centred), n**3) for j in range(d)] for i in range(d)]
    return n, [sum(c * c for c in r) for r in centred], np.array([[float(c) for c in r] for r in cov]), np.array([[c / n for c in r] for r in centred])


def check_whitening(frame, vectors, components=8):
    n, deviations, cov, centred = expected_whitening(list(vectors.values()))
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    rows = frame.collect()
    k = min(components, len(values))
    assert len(rows) == k * n
    found = {(r.vec_id, r.component): r for r in rows}
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() <= 1e-9
    for c in range(k):
        want = centred @ directions[:, c] / np.sqrt(values[c])
        got = np.array([found[i, c + 1].whitened for i in vectors])
        sign = np.sign(want @ got)
        assert np.allclose(got, sign * want, atol=1e-7)
    for i, deviation in zip(vectors, deviations):
        r = found[i, 1]
        assert r.n == n and r.deviation_text == str(deviation) and r.deviation == (deviation if deviation < 2**63 else None)
        assert abs(r.explained - values[0] / np.trace(cov)) <= 1e-9


def test_whitening_of_embeddings(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    frame = LLM_JOBS["op12_whitening"](spark, SMALL)
    check_whitening(frame, vectors)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9])
def test_whitening_of_correlated_values(spark, scale):
    draw = np.random.default_rng(7)
    mixed = draw.normal(size=(200, 5)) @ draw.normal(size=(5, 5)) * scale + 3 * scale
    vectors = {i: [float(c) for c in v] for i, v in enumerate(mixed)}
    frame = whitening.whiten(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    check_whitening(frame, vectors)


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (None, [0.0, 5.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]),
            (8, []), (9, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, component int, i string")
    found = whitening.whiten(frame).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)] and {r.n for r in found} == {4}
    assert whitening.whiten(frame.where("false")).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(10)], "vec_id long, embedding array<double>")
    flat = whitening.whiten(same).collect()
    assert len(flat) == 20 and all(r.whitened is None and r.deviation == 0 and r.explained is None and r.identity_error is None for r in flat)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(10)], "vec_id long, embedding array<double>")
    flat = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    with pytest.raises(Exception, match="an entry beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")).collect()
