"""Packing (6), mixing (7) and repetition (8)."""

import base64
import os
import quopri
import random

import numpy as np
import pytest
from conftest import SMOKE
from oracle import compare
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import packing, queries
from tessella.llm.mixing import exact_budget, mixed, source_name, water_fill
from tessella.llm.repetition import beta_prior, body_of, measured, repeated_words, verdicts, words_of
from tessella.llm.tokens import VOCABULARY, token_count
from tessella.plans import table

needs_tokens = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
@settings(max_examples=200, deadline=None)
def test_fill_plan_places_all_and_never_overfills(lengths):
    placed, used = packing.fill_plan(lengths, 60)
    room, seen = [60] * used, {}
    for length, rank, n, first in placed:
        assert rank == seen.get(length, 0)
        seen[length] = rank + n
        for c in range(first, first + n):
            room[c] -= length
    assert seen == lengths and min(room, default=0) >= 0 and all(r < 60 for r in room)
    tokens = sum(k * v for k, v in lengths.items())
    # At most one container can be half empty: two such would have shared one.
    assert used <= -(-2 * tokens // 60) + 1


def test_fill_plan_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        packing.fill_plan({61: 1}, 60)
    assert packing.fill_plan({}, 60) == ([], 0)


@pytest.mark.parametrize("splits", [1, 5])
def test_packed(spark, splits):
    r = random.Random(1)
    sizes = {k: r.choice([0, 1, 3, 3, 3, 3, 7, 10, 11, 25, 100]) for k in range(400)}
    rows = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()] + [(900, None, "x")], "doc_id long, n_tokens int, pack_name string")
    packs = spark.createDataFrame([("a", 10), ("a", 10), ("b", 64), (None, 5), ("zero", 0), ("none", None)], "pack_name string, capacity_tokens int")
    got = packing.packed(rows, packs, splits)
    for name, capacity in (("a", 10), ("b", 64)):
        own = [x for x in got.collect() if x.pack_name == name]
        per, fill = {}, {}
        for x in own:
            per.setdefault(x.doc_id, []).append((x.piece_no, x.first_token, x.n_tokens))
            fill[x.container_id] = fill.get(x.container_id, 0) + x.n_tokens
        assert {k: sum(p[2] for p in v) for k, v in per.items()} == {k: n for k, n in sizes.items() if n}
        for k, v in per.items():
            v.sort()
            assert len(v) == -(-sizes[k] // capacity) and [p[1] for p in v] == [j * capacity for j in range(len(v))]
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
    for c in packing.containers(got).collect():
        assert c.tokens == sum(m.n_tokens for m in c.messages) <= c.capacity and c.fill == c.tokens / c.capacity
    assert packing.packed(rows.limit(0), packs).collect() == [] and packing.packed(rows, packs.limit(0)).collect() == []


@needs_tokens
def test_token_count(spark):
    texts = ["", None, "hello world", "naïve <|endoftext|> 東京", "a" * 300_000]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "text string").select(token_count("text").alias("n")).collect()]
    assert got[:3] == [0, 0, 2] and got[3] > 5 and got[4] > 1000


@needs_tokens
@pytest.mark.parametrize("name", ["p6_containers", "p6_fill", "p7_uses", "p7_shares", "p7_shares_full"])
def test_text_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SMOKE).count() > 0


@needs_tokens
@pytest.mark.parametrize("name", ["p6_checks", "p7_checks"])
def test_invariants_against_sql(spark, name):
    compare(queries.QUERIES[name](spark, SMOKE), queries.ORACLE[name], SMOKE)


def test_water_fill():
    assert water_fill({"a": 0.5, "b": 0.5}, {"a": 100, "b": 10}, 40) == {"a": 30, "b": 10}
    assert water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 100, "c": 100}, 100) == pytest.approx({"a": 10, "b": 54, "c": 36})
    assert water_fill({"a": 1.0, "b": 0.0}, {"a": 5, "b": 5}, 100) == {"a": 5, "b": 0}
    assert water_fill({}, {}, 5) == {} and water_fill({"a": 1.0}, {"a": 0}, 5) == {"a": 0}


@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.tuples(st.floats(0.01, 1), st.integers(0, 1000)), min_size=1), st.integers(1, 3000))
@settings(max_examples=200, deadline=None)
def test_water_fill_is_fair(sources, budget):
    w, cap = {k: v[0] for k, v in sources.items()}, {k: v[1] for k, v in sources.items()}
    got = water_fill(w, cap, budget)
    assert all(got[k] <= cap[k] + 1e-6 for k in w)
    assert sum(got.values()) == pytest.approx(min(budget, sum(cap.values())), abs=1e-6)
    open_ = [got[k] / w[k] for k in w if got[k] < cap[k] - 1e-6]
    assert not open_ or max(open_) - min(open_) < 1e-6 * budget / min(w.values()) + 1e-6
    assert all(got[k] / w[k] <= (open_[0] if open_ else float("inf")) + 1e-4 for k in w)


def mix_frames(spark, docs, targets):
    return (spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, message_id string, source string, n_tokens int, mix_name string"), spark.createDataFrame([(*x, 0) for x in targets], "mix_name string, source string, target_share double, max_repeats int, doc_id int"))


def test_mixed(spark, force_shuffle):
    r = random.Random(2)
    docs = [(k, f"m{k}", r.choice(["a", " A", "b", "big_one", "BIG-ONE", "big_one"]), r.randrange(1, 50)) for k in range(1500)]
    docs += [(2000 + k, f"m{k}", r.choice(["a", "b"]), 20) for k in range(40)] + [(3000, None, "a", None), (3001, None, None, 5), (3002, None, "", 5), (3003, None, "b", 7), (3004, None, "b", 7)]
    targets = [("m", "a", 0.4, 3), ("m", "b", 0.3, 2), ("m", "Big One", 0.2, 1), ("m", "absent", 0.1, 5), (None, "a", 1.0, 1), ("n", None, 1.0, 1), ("z", "absent", 1.0, 2)]
    d, t = mix_frames(spark, docs, targets)
    for epochs in (None, 1.0, 5.0):
        uses, shares = mixed(d, t, seed=7, epochs=epochs)
        rows, parts = uses.collect(), {(s.mix_name, s.source): s for s in shares.collect()}
        assert set(parts) == {("m", "a"), ("m", "b"), ("m", "big-one"), ("m", "absent"), ("z", "absent")}
        ids = {k: m for k, m, _, _ in docs}
        units = [ids[x.doc_id] or x.doc_id for x in rows]
        assert len(units) == len(set(units)), "a message filed twice is drawn once"
        assert {x.doc_id for x in rows} >= {3000, 3003, 3004} and not {3001, 3002} & {x.doc_id for x in rows}
        for s in parts.values():
            own = [x for x in rows if x.source == s.source]
            assert all(0 <= x.uses <= s.max_repeats for x in own)
            assert s.used_tokens == sum(x.uses * x.n_tokens for x in own)
            assert abs(s.used_tokens - s.planned_tokens) <= 25, "to within half a message"
            if own and s.mix_name == "m":
                assert max(x.uses for x in own if x.n_tokens) - min(x.uses for x in own if x.n_tokens) <= 1
        if epochs is None:
            assert parts["m", "a"].actual_share == pytest.approx(0.4 / 0.9, abs=0.01) and parts["m", "big-one"].actual_share == pytest.approx(0.2 / 0.9, abs=0.01)
        again = mixed(d, t, seed=7, epochs=epochs)[0].collect()
        assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixed(d.limit(0), t)[0].collect() == [] and mixed(d, t.limit(0))[1].collect() == []


def test_exact_budget():
    assert exact_budget({"a": 0.5, "b": 0.25, "gone": 0.25}, {"a": 100, "b": 30, "gone": 0}) == 90
    assert exact_budget({"a": 1.0}, {"a": 0}) == 0


def brute(words, run=5):
    seen, hit = set(), set()
    for k in range(len(words) - run + 1):
        g = tuple(words[k : k + run])
        if g in seen:
            hit |= set(range(k, k + run))
        seen.add(g)
    return len(hit)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=6), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_repeated_words_by_brute_force(docs, run):
    flat = [w for d in docs for w in d]
    codes = np.fromiter(map(hash, flat), np.int64, len(flat))
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    got = np.bincount(owner[repeated_words(codes, owner, run)], minlength=len(docs))
    assert got.tolist() == [brute(d, run) for d in docs]


TEXT = "Größe, l'été 12 – one two three four five; one two three four five."


def qp(text, charset="utf-8"):
    return quopri.encodestring(text.encode(charset)).decode()


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
@pytest.mark.parametrize(
    "raw",
    [
        f"From: a@x.test\nSubject: no no\n\n{TEXT}",
        f"From b Mon Jan\nFrom: <b@x.test>\nX: 1\n\t\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n{qp(TEXT)}",
        f"From: a@x.test\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: Quoted-Printable\n\n{qp(TEXT.replace('–', '-'), 'latin-1')}",
        f"From: a@x.test\nContent-Transfer-Encoding: base64\n\n{base64.encodebytes(TEXT.encode()).decode()}",
        f'From: a@x.test\nContent-Type: multipart/mixed;\n boundary="=_b"\n\npreamble\n--=_b\nContent-Type: text/plain\n\n{TEXT}\n--=_b\nContent-Type: text/html\n\n<p>other</p>\n--=_b\nContent-Type: text/plain\nContent-Disposition: attachment\n\nfile words\n--=_b--\nepilogue',
        f"From: a@x.test\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: multipart/alternative; boundary=r\n\n--r\nContent-Type: text/plain\n\n{TEXT}\n--r\nContent-Type: text/html\n\n<p>other",
    ],
)
def test_body_of(raw, eol):
    body, host = body_of(raw.replace("\n", eol))
    assert words_of(body) == words_of(TEXT) and host == "x.test"


@pytest.mark.parametrize("levels", [1, 20, 21, 200])
def test_body_of_deep_messages(levels):
    raw = f"Content-Type: text/plain\n\n{TEXT}\n"
    for k in range(levels):
        raw = f"Content-Type: multipart/mixed; boundary=b{k}x\n\n--b{k}x\nContent-Type: text/plain\n\nat {k}\n--b{k}x\n{raw}--b{k}x--\n"
    assert body_of("From: a@x.test\n" + raw)[0].split("\n") == [*[x for k in reversed(range(levels)) for x in (f"at {k}", "")], *TEXT.split("\n"), ""]


def test_body_of_odd_texts():
    assert body_of(None) == ("", "") and body_of("") == ("", "")
    assert body_of("no header here\nat all")[0] == "no header here\nat all"
    assert body_of("Content-Type: multipart/mixed; boundary=zz\n\nno such part")[0] == "no such part"
    assert body_of("A: b\nContent-Transfer-Encoding: base64\n\n=")[0] == ""
    assert words_of("café CAFÉ x1y don't") == ["café", "café", "x", "y", "don", "t"]


def test_measured_and_verdicts(spark, force_shuffle):
    spam = "From: s@spam.test\n\n" + "buy this thing right now please " * 40
    good = "From: g@good.test\n\n" + " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}w" for k in range(200))
    rows = [(k, spam, "m@box.test") for k in range(20)] + [(20 + k, good, "m@box.test") for k in range(60)]
    rows += [(100, None, None), (101, "", "m@BOX.test"), (102, "one word\n" * 100_000, None), (103, "\n" + "a b c d e f " * 2, "x")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id long, text string, mailbox string, host string, words int")
    got = {r.doc_id: r for r in verdicts(df).collect()}
    assert len(got) == len(rows)
    assert got[0].fails and got[0].host == "spam.test" and got[0].host_fails and got[0].words == 240 and got[0].repeated == 234
    assert not got[30].fails and not got[30].host_fails and got[30].share == 0
    assert (got[100].words, got[100].share, got[100].host, got[100].host_rate) == (0, 0.0, None, None)
    assert got[101].host == "box.test" and got[102].words == 200_000 and got[102].fails
    assert (got[103].words, got[103].repeated, got[103].host) == (12, 6, "x")
    assert 0 < got[0].host_rate < 1 and got[30].host_rate > 0
    assert verdicts(df.limit(0)).collect() == [] and measured(df.limit(0)).collect() == []


def test_beta_prior():
    a, b, mean = beta_prior(100, 10, 0.1, 1.0, 10)
    assert mean == pytest.approx(0.1) and a / (a + b) == pytest.approx(0.1)
    a2, b2, _ = beta_prior(100, 10, 0.1, 8.0, 10)
    assert a2 + b2 < a + b, "hosts that differ make the prior weaker"
    assert beta_prior(5, 0, 0.0, 0.0, 1)[2] > 0


def test_found_equals_brute_force(spark):
    docs = table(spark, SMOKE, "documents").select("doc_id", "text").collect()
    want = {r.doc_id for r in docs if (w := words_of(body_of(r.text)[0])) and brute(w) >= 0.35 * len(w)}
    assert {r.doc_id for r in queries.QUERIES["p8_found"](spark, SMOKE).collect()} == want


def test_source_name(spark):
    rows = spark.createDataFrame([(" List_Dev ",), ("list-dev",), ("",), (" ",), (None,)], "s string").select(source_name("s").alias("s")).collect()
    assert [r.s for r in rows] == ["list-dev", "list-dev", None, None, None]
