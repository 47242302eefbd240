"""Operators 11 to 13 against plain versions, with the awkward cases."""

import hashlib
import json
import math
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from crosspanel.llm import prefix_trie, repair, sharding  # noqa: E402

CONVERSATIONS = "conv_id long, turn long, role string, text string, base string, n0 long, slot int, audit string"


def conversations(spark, rows):
    extra = ("b", 1, 2, "x")
    return spark.createDataFrame([(*r, *extra) for r in rows], CONVERSATIONS)


def awkward_conversations(seed=5):
    rng = random.Random(seed)
    said = ["Hello.", "Why?", "Go on", "", " \t", None, "é\U0001F600!", "Yes. No! \n", "x" * 50_000, "1,2;3:\n4"]
    rows = []
    for c in [*range(0, 12), 100, 101, 105, 199, 250, 251, 7_000_000_017, -3, -250]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool"]), rng.choice(said)))
    for c in range(300, 340):                                  # the same conversation many times
        rows += [(c, t, r, x) for t, (r, x) in enumerate([("system", "Be kind."), ("user", "Hi."), ("assistant", "Hi!")])]
    for c in range(340, 346):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{min(t, 150 + c)}.") for t in range(300)]
    rows += [(400, None, "user", "a."), (400, None, "assistant", "b."), (400, 5, "user", "c"), (400, 5, "user", "c"), (400, 9, None, None)]
    rows += [(401, None, None, None), (None, 1, "user", "lost."), (None, None, "assistant", "lost")]
    return rows


# --- 11 -----------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()
            own[c].append(((t is not None, t or 0, key), r, x))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in children[p])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -10**12, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def as_rows(trie):
    return sorted((r.conv_id, r.depth, -10**12 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.collect())


@pytest.mark.parametrize("wide, shard_rows", [(None, 100_000), (3, 50), (10_000, 7)])
def test_trie(spark, wide, shard_rows):
    rows = awkward_conversations()
    random.Random(1).shuffle(rows)
    df = conversations(spark, rows).repartition(5)
    assert as_rows(prefix_trie.prefix_trie(df, wide, shard_rows)) == plain_trie(rows)


def test_trie_of_random_conversations(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice("ua"), rng.choice("xy")) for c in rng.sample(range(2000), 250) for t in range(rng.randint(1, 7))]
    assert as_rows(prefix_trie.prefix_trie(conversations(spark, rows), wide=4)) == plain_trie(rows)


def test_many_ends_in_blocks(spark):
    """Ids in several blocks of 64 and 4,096, negative ones too, are joined in their order."""
    rows = [(c, 0, "user", "x") for c in [*range(-130, 130), *range(4000, 4200), 10**12]]
    got = prefix_trie.prefix_trie(conversations(spark, rows))
    want = plain_trie(rows)
    assert as_rows(got) == want and max(w[3] for w in want) == len(rows)


def test_empty_and_lost_conversations(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 0, "user", "x")])).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        k0, k1 = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        levels, slots = prefix_trie.perfect_hash(k0, k1)
        assert sorted(slots.tolist()) == list(range(n))
        assert (prefix_trie.lookup(levels, k0, k1) == slots).all()
    with pytest.raises(ValueError):
        prefix_trie.perfect_hash(np.ones(2, np.uint64), np.ones(2, np.uint64))


# --- 12 -----------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        spell = lambda v: " " if v is None else str(v)                # noqa: E731
        code = zlib.crc32(f"{spell(c)}:{spell(t)}".encode()) % 20
        r, x = spell(r), spell(x)
        r = "user" if code == 4 else r
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        out[c] += [] if code == 0 else [(t, r, x)] * (2 if code == 3 else 1)
    return {c: sorted(v, key=lambda s: (s[0] is not None, s[0] or 0, s[1].encode(), s[2].encode())) for c, v in out.items()}


def plain_faults(turns):
    seen, out = set(), []
    for _, r, x in turns:
        bare = x.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def plain_edits(turns, faults):
    """(cost, letters) by trying everything, from the back."""
    legal = re.compile("(s?(ua)*)?")

    @cache
    def best(i, shape):
        """``shape``: the role initials so far as one of '', s, u, a."""
        ways = [(0, "")] if i == len(turns) and shape in ("", "a") else []
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[shape]
        if i < len(turns):
            role, fault = turns[i][1][:1], faults[i]
            add = lambda cost, letter, shape: ways.append(                # noqa: E731
                (best(i + 1, shape)[0] + cost, letter + best(i + 1, shape)[1]))
            add(3, "D", shape)
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role == follow or (shape == "" and role == "s"):
                    add(late, "K", role)
                add(2 + late, "R", follow)
        return min([*ways, *inserted(i, shape, follow)])

    def inserted(i, shape, follow):
        """Insertions right here; four in a row never pay."""
        if depth[0] == 3:
            return []
        depth[0] += 1
        try:
            cost, letters = best.__wrapped__(i, follow)
        except ValueError:
            return []
        finally:
            depth[0] -= 1
        return [(cost + 2, "I" + letters)]

    depth = [0]
    assert legal
    sys.setrecursionlimit(100_000)
    for i in range(len(turns), -1, -1):
        for shape in ("", "s", "u", "a"):
            best(i, shape)
    return best(0, "")


def plain_repair(turns, letters):
    out, shape, i = [], "", 0
    for letter in letters:
        follow = {"": "user", "s": "user", "u": "assistant", "a": "user"}[shape]
        if letter == "I":
            out.append((follow, ""))
        else:
            _, r, x = turns[i]
            i += 1
            if letter == "D":
                continue
            out.append((r if letter == "K" else follow, x))
        shape = out[-1][0][0]
    return out


def test_repair(spark):
    rows = awkward_conversations() + [(500 + k, t, random.Random(k * 9 + t).choice(["user", "assistant", "system"]), f"{t % 4}.")
                                      for k in range(30) for t in range(8)]
    df = conversations(spark, rows).repartition(4)
    got = {r.conv_id: r for r in repair.repairs(repair.damaged(df)).collect()}
    turns = plain_damage(rows)
    assert got.keys() == turns.keys() == {r[0] for r in rows}
    built = defaultdict(list)
    for r in repair.repaired_turns(repair.damaged(df)).orderBy("position").collect():
        assert r.position == len(built[r.conv_id])
        built[r.conv_id].append((r.role, r.text))
    for c, rows_ in turns.items():
        faults, row = plain_faults(rows_), got[c]
        assert [row.blank, row.duplicate, row.truncated] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        numbers = {t for t, *_ in rows_ if t is not None}
        assert row.gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        initials = [r[:1] for _, r, _ in rows_]
        assert row.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters = plain_edits(rows_, faults) if rows_ else (0, "")
        assert (row.cost, row.audit) == (cost, letters), c
        made = plain_repair(rows_, letters)
        assert built[c] == made and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made))
        assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()


def test_repair_of_nothing(spark):
    assert repair.repairs(repair.damaged(conversations(spark, []))).count() == 0
    whole = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hi!")]
    row = repair.repairs(repair.undamaged(conversations(spark, whole))).first()
    assert (row.cost, row.audit, row.illegal) == (0, "KK", 0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 99, 100, 101, 1000])
def test_checkpoints_change_nothing(n):
    """Letters from recomputed blocks cost what the sweep says, and every step is tight."""
    rng = random.Random(n)
    codes = bytes(rng.randrange(16) for _ in range(n))
    edits = repair.cheapest(codes)
    cost = next(edits)[1]
    paid, i, state = 0, 0, repair.START
    for letter, to in edits:
        options = [("I", repair.INSERT, repair.FOLLOWS[state])] + (repair.MOVES[codes[i]][state] if i < n else [])
        paid += dict((x, c) for x, c, _ in options)[letter]
        i, state = i + (letter != "I"), to
    assert (paid, i) == (cost, n) and state in (repair.START, repair.ASSISTANT)


def test_long_texts_spool(spark, monkeypatch):
    monkeypatch.setattr(repair, "SPOOL_BYTES", 100)
    texts = repair._Texts()
    for round_ in range(3):
        want = [("user", "é" * k + str(round_)) for k in range(0, 200, 40)]
        for turn in want:
            texts.put(*turn)
        assert list(texts.read()) == want
        texts.clear()
    assert list(texts.read()) == []


# --- 13 -----------------------------------------------------------------------

def plain_shards(rows, shards, law="bytes"):
    digest = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)      # noqa: E731
    sized = sorted((digest(t or ""), digest("" if d is None else str(d)), d is None, d or 0, len((t or "").encode()) + 8,
                    zlib.crc32((t or "").encode())) for d, t in rows)
    weigh = lambda size: size if law == "bytes" else 1                        # noqa: E731
    total, before, out, slots = sum(weigh(r[4]) for r in sized), 0, [], defaultdict(int)
    for *_, none, d, size, crc in sized:
        shard = min(shards - 1, (2 * before + weigh(size)) * shards // (2 * total))
        out.append((None if none else d, size, crc, law, shard, slots[shard], None))
        slots[shard] += 1
        before += weigh(size)
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    return plain.awkward_texts()


@pytest.mark.parametrize("law, shards", [("bytes", 24), ("rows", 24), ("bytes", 1), ("rows", 7)])
def test_shards(spark, texts, law, shards):
    got = sharding.sharded(plain.documents(spark, texts).repartition(3), shards, law)
    assert sorted(map(tuple, got.collect()), key=str) == plain_shards(list(enumerate(texts)), shards, law)
    if law == "rows":
        counts = [r["count"] for r in got.groupBy("shard").count().collect()]
        assert max(counts) - min(counts) <= 1 and len(counts) == shards


@pytest.mark.parametrize("children", [2, 64])
def test_shards_of_copies(spark, monkeypatch, children):
    """A text, and a repeated row, that make up a third of all are split between shards and tasks."""
    monkeypatch.setattr(sharding, "CHILDREN", children)
    monkeypatch.setattr(sharding, "ROOT", 16)
    rows = [(k, "the same text") for k in range(700)] + [(9999, "one row")] * 700 + [(2000 + k, f"text {k}") for k in range(700)]
    rows += [(None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.sharded(docs, 24)
    key = lambda r: (r[0] is None, r[0] or 0, r[4], r[5])                     # noqa: E731
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_shards(rows, 24), key=key)
    sizes = [r.s for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 21


def test_tolerance_stops_early(spark, texts):
    docs = plain.documents(spark, texts * 3)
    got = sharding.sharded(docs, 4, tolerance=200_000)
    sizes = [r.s for r in got.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    target = sum(len((t or "").encode()) + 8 for t in texts * 3) / 4
    assert all(abs(s - target) <= 2 * 200_000 for s in sizes)
    slots = got.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("n"))
    assert all(r.a == 0 and r.b == r.n - 1 for r in slots.collect())


def test_shards_hold_whole_rows(spark, texts, tmp_path):
    docs = plain.documents(spark, texts).withColumn("shard", F.lit("own")).withColumn("row", F.lit(3)).withColumn("k0", F.lit(0))
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("shard").distinct().count() == 5
    kept = sorted(json.dumps(r.row.asDict(), sort_keys=True) for r in back.collect())
    assert kept == sorted(json.dumps(r.asDict(), sort_keys=True) for r in docs.collect())


def test_shards_of_nothing(spark):
    assert sharding.sharded(spark.createDataFrame([], plain.DOC)).count() == 0
    with pytest.raises(ValueError):
        sharding.sharded(spark.createDataFrame([], plain.DOC), law="weight")
    plan = sharding.sharded(plain.documents(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "RDD" not in plan
