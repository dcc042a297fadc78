"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from notemill.llm import conversations, mixing, spelling

# ---- 11 ----

SPACES = " \t\n\v\f\r"
PATTERN = re.compile(r"(s?(ua)+)?")


def broken(rows):
    """The damage of the contract, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            out += [(conv, turn, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)] * (1 + (harm == 3))
    return out


def brute_repair(rows):
    """Dijkstra's order over (cost, initials): the first complete sequence is the cheapest and the least in ASCII."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    done, frontier = {}, {(0, "0"): (0, "", ())}
    step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
    while frontier:
        at = min(frontier, key=lambda k: frontier[k][:2])
        cost, edits, turns = frontier.pop(at)
        done[at] = (cost, edits, turns)
        i, s = at
        moves = [((i, step[s, r[0]]), 3, "I", ((r, ""),)) for r in ("user", "assistant") if (s, r[0]) in step]
        if i < len(rows):
            _, _, role, text = rows[i]
            extra = 3 * (faults[i] == "truncated")
            moves.append(((i + 1, s), 4, "D", ()))
            if faults[i] not in ("blank", "duplicate"):
                if (s, role[:1]) in step:
                    moves.append(((i + 1, step[s, role[:1]]), extra, "K", ((role, text),)))
                moves += [((i + 1, step[s, r[0]]), 3 + extra, "R", ((r, text),)) for r in ("user", "assistant") if (s, r[0]) in step]
        for to, c, e, t in moves:
            new = (cost + c, edits + e, turns + t)
            if to not in done and (to not in frontier or new[:2] < frontier[to][:2]):
                frontier[to] = new
    cost, edits, turns = min((done[len(rows), s] for s in "03"), key=lambda x: x[:2])
    assert PATTERN.fullmatch("".join(r[0] for r, _ in turns))
    known = [r[1] for r in rows if r[1] is not None]
    n = Counter(faults)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


@pytest.fixture(scope="module")
def turns():
    r = random.Random(4)
    texts = ["Yes.", "No!", "and then", "", " \n", "Why?", None, "日本。", "ok ."]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "User"]
    out = []
    for conv in [*range(60), None]:
        for turn in range(r.choice([1, 2, 3, 8, 30])):
            out += [(conv, None if r.random() < 0.05 else turn * r.choice([1, 1, 2]), r.choice(roles), r.choice(texts))] * r.choice([1, 1, 1, 2])
    out += [(77, t, r.choice(roles[:11]), f"{r.choice(texts[:3])} {t % 900}.") for t in range(3000)]
    return out


@pytest.mark.parametrize("rows,size", [(65_536, 8 << 20), (7, 8 << 20), (50, 40)])
def test_repair_equals_a_search(spark, turns, monkeypatch, rows, size):
    monkeypatch.setattr(conversations, "PIECE_ROWS", rows)
    monkeypatch.setattr(conversations, "PIECE_BYTES", size)
    df = spark.createDataFrame([(*x, "e") for x in turns], "conv_id long, turn long, role string, text string, h string").repartition(5)
    by = defaultdict(list)
    for x in broken(turns):
        by[x[0]].append(x)
    pieces = conversations.repair(conversations.damage(df))
    got = {x.conv_id: tuple(x)[1:] for x in conversations.digest(pieces, df).collect()}
    want = {c: brute_repair(by[c]) for c in {x[0] for x in turns}}
    assert {c: want[c] for c in want if got.get(c) != want[c]} == {} and len(got) == len(want)
    if rows == 7:
        again = conversations.repaired_turns(pieces).where("conv_id = 77").orderBy("part", "seq", "at").collect()
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in again).encode()).hexdigest() == want[77][-1]


def test_checkpoints_are_few():
    kinds = bytes(random.Random(1).choices(range(9), k=10_000))
    whole = conversations.walk(kinds, conversations.ENDS, [0], True)[0]
    half = len(kinds) // 2
    m = conversations.costs(kinds[half:])
    middle = tuple(min(m[4 * s + e] + conversations.ENDS[e] for e in range(4)) for s in range(4))
    s, first = conversations.walk(kinds[:half], middle, [0], False)[0]
    assert first + conversations.walk(kinds[half:], conversations.ENDS, [s], True)[0][1] == whole[1]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digest(conversations.repair(conversations.damage(none)), none).count() == 0
    one = spark.createDataFrame([(1, 5, None, None)], none.schema)
    empty = conversations.digest(conversations.repair(none), one).first()
    assert tuple(empty) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


# ---- 12 ----


def brute_words(texts, damaged=97, shortest=5, fewest=3):
    n = Counter()
    for k, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if damaged and h % damaged == 0 else run
            n[run] += len(run) >= shortest
    return {w: c for w, c in n.items() if c >= fewest}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.mark.parametrize("shard", [20_000, 60])
def test_variants_equal_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    r = random.Random(8)
    texts = []
    for k in [*range(150), None, None]:
        texts.append((k, " ".join(r.choice(["ababab", "babab", "Éclairs", "abcabcabc", "preprefix"])[: r.randint(3, 9)] + "".join(r.choice("abÉé") for _ in range(r.randint(0, 4))) for _ in range(120))))
    texts += [(900, None), (901, ""), (902, "a" * 9_000 + " " + "a" * 8_999), (903, ("b" * 9_000 + " ") * 3 + ("b" * 8_999 + "ab ") * 7), (903, "x×÷yz " * 3)] + [(5, "repeated rows repeated rows repeated")] * 2
    df = spark.createDataFrame([(k, t, "w", "n") for k, t in texts], "doc_id long, text string, w string, n string").repartition(5)
    n = brute_words(texts)
    counted = spelling.word_counts(df)
    assert {x.word: x.n for x in counted.collect()} == n and len(n) > 150
    got = {x.word: tuple(x)[1:] for x in spelling.group_variants(counted).collect()}
    assert got == brute_variants(n)


def test_variants_of_chains_and_of_nothing(spark):
    words = [("abcde", 1), ("abcdef", 2), ("abcdefg", 4), ("abcdefgh", 8), ("zbcdefgh", 8), ("lonely", 5)]
    got = {x.word: tuple(x)[1:] for x in spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == brute_variants(dict(words)) and got["abcde"][1] == "abcdefgh" and got["zbcdefgh"][0] is None
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spelling.word_counts(none)).count() == 0


# ---- 13 ----


def brute_targets(size, weights=(1, 2, 3)):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, held = Fraction(sum(size.values())), {}
    while True:
        free = sum(w[s] for s in names if s not in held)
        level = (total - sum(held.values())) / free if free else 0
        over = [s for s in names if s not in held and w[s] * level > 3 * size[s]]
        if not over:
            return {s: float(held.get(s, w[s] * level)) for s in names}
        held |= {s: Fraction(3 * size[s]) for s in over}


def brute_seats(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (Fraction(votes[i]) / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@pytest.mark.parametrize("votes,seats", [([5, 5, 5, 5], 6), ([0.0, 0.0], 3), ([1e6, 3, 2, 1], 40), ([7.5, 0, 1, 1, 1, 1, 1, 1, 1], 3), ([1] * 7, 3), ([340, 280, 160, 60, 60], 17), ([3, 3], 0)])
def test_seats_go_to_the_highest_quotients(spark, votes, seats):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "rank long, target double")
    got = {x["rank"]: x.quota for x in mixing.apportion(df, seats).collect()}
    assert [got[i] for i in range(len(votes))] == (brute_seats(votes, seats) if any(votes) else [0] * len(votes))


def test_mix_meets_its_targets(spark):
    r = random.Random(3)
    sources = {"a": 400, "B": 3, "é": 60, "": 9, None: 30, "c": 1, "d": 200}
    docs = [(i, None if r.random() < 0.03 else " ".join(["w"] * int(r.paretovariate(0.9) * 5) + ["\n"]), s, "x") for i, s in enumerate(s for s, n in sources.items() for _ in range(n))]
    docs += [(5000, "w " * 60_000, "d", "x"), (None, "a b c", "a", "x"), (0, "a b", "a", "x"), (0, "a b", "a", "x"), (6000, "", "only blank", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, taken string")
    rows = mixing.mix(df.repartition(7)).collect()
    again = mixing.mix(df.coalesce(1).orderBy(F.desc("doc_id"))).drop("runs").collect()
    assert Counter(tuple(x)[:-1] for x in rows) == Counter(map(tuple, again))
    size = Counter({s: 0 for *_, s, _ in docs})
    for _, t, s, _ in docs:
        size[s] += len((t or "").split())
    targets, taken = brute_targets(size), Counter()
    assert sorted((x.doc_id or -1, x.size) for x in rows) == sorted((k or -1, len((t or "").split())) for k, t, *_ in docs)
    for x in rows:
        assert x.source_size == size[x.source] and abs(x.target - targets[x.source]) < 1e-6 * (1 + targets[x.source])
        assert 0 <= x.taken <= 3 * x.size and x.taken == sum((run.end - run.start) * run.copies for run in x.runs)
        assert [run.start for run in x.runs] == [0, *[run.end for run in x.runs[:-1]]][: len(x.runs)] and (not x.runs or x.runs[-1].end == x.size)
        taken[x.source] += x.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 2 * mixing.BLOCK_WORDS


def test_mix_in_small_shards_and_steps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 4)
    monkeypatch.setattr(mixing, "MOST_SHARDS", 50)
    monkeypatch.setattr(mixing, "STEP_BLOCKS", 13)
    docs = [(i, "word " * (1 + i % 90), "ab"[i % 7 == 0]) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mixed = mixing.mix(df).cache()
    size = Counter()
    for _, t, s in docs:
        size[s] += len(t.split())
    got, targets = Counter(), brute_targets(size)
    for x in mixed.collect():
        got[x.source] += x.taken
        assert x.taken == sum((run.end - run.start) * run.copies for run in x.runs) <= 3 * x.size
    assert all(abs(got[s] - targets[s]) < 0.05 * targets[s] for s in size)
    words = mixing.mixed_texts(df, mixed).select(F.sum(F.size(F.split("words", " ")))).first()[0]
    assert words == sum(got.values())


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], none.schema)
    assert {(x.doc_id, x.target, x.taken) for x in mixing.mix(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
