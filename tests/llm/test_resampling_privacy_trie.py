"""Importance resampling, personal data and the prefix trie against brute force, with their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from frameloom.llm import importance, personal, prefix_trie

DOCS = "doc_id long, text string, lang string, row long, codes string, spans string, n string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, "en", 7, "x", "y", "z") for d, t in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def slow_draw(rows, target, buckets, longest, seed, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, longest)[1]))
    for text in target:
        t.update(map(bucket, features(text, longest)[1]))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out, fit = [], []
    for doc, text in rows:
        n_words, found = features(text, longest)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        row = [doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None]
        out.append(row)
        if n_words >= least:
            fit.append(row)
    fit.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, row in enumerate(fit[: percent * len(fit) // 100]):
        row[4] = k + 1
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_is_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(importance, "SLICE", 300)
    rng = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "naïve", "ÀB", "x" * 700, "K1", "日本語", "K"]
    make = lambda n: rng.choice([" ", "\n", ", ", "--", "_"]).join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, make(rng.choice([0, 1, 2, 19, 20, 21, 60, 200]))) for i in range(150)]
    rows += [rows[5], (5, rows[5][1]), (5, "other " * 30), (None, make(40)), (None, None), (900, None), (901, ""), (902, "  .. "), (903, "y" * 5000)]
    target = [make(30) for _ in range(12)] + [None, ""]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    args = dict(buckets=97, longest=longest, seed=5, percent=30, least_words=20)
    got = importance.resampled(frame(spark, rows), goal, **args).collect()
    assert ordered(got) == ordered(slow_draw(rows, target, 97, longest, 5, 30, 20))


def test_importance_ranks_copies_and_long_texts(spark):
    rows = [(1, "a b c " * 20)] * 300 + [(2, "a b c " * 200_000), (3, "z" * 1_500_000)]
    got = importance.resampled(frame(spark, rows), frame(spark, []), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 151))
    assert {r["n_features"] for r in got} == {60, 600_000, 1}
    assert importance.resampled(frame(spark, []), frame(spark, [])).count() == 0


def test_crc_composition():
    rng = random.Random(2)
    pairs = [(rng.randbytes(rng.randrange(50)), rng.randbytes(rng.choice([0, 1, 2, 7, 300, 5000]))) for _ in range(200)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.uint32)
    joined = importance.composed(crc(0), crc(1), np.array([len(b) for _, b in pairs]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def slow_luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def slow_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    checks = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 12 <= len(digits(m)) <= 19 and slow_luhn(digits(m)),
        "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    kinds = list(checks)
    found = [
        (m.start(), kinds.index(k), f"{k}:{m.start()}:{m.end()}")
        for k, p in personal.BASE_PLAIN.items() for m in re.finditer(p, text or "") if checks[k](m[0])
    ]
    return [f for _, _, f in sorted(found)]


def test_personal_base_is_brute_force(spark):
    rng = random.Random(4)
    atoms = [
        "a@b.c", "a@b", "x.y+z@m-n.co.uk", "..", "@", "é", "日", "1.2.3.4", "256.1.1.1", "0255.001.2.3", ".5.6", "4111111111111111", "4111 1111-1111 1111",
        "4111111111111112", " ", "-", "+", "+1 (202) 555-0147", "+49 30", "1", "22", ")", "(", "\n", "word", "_", "😀", "123-45-6789", "phone 202-555-0147",
    ]
    rows = [(i, "".join(rng.choice(atoms) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(1, rows[1][1]), (None, "q@r.st"), (500, None), (501, ""), (502, "a@b.c_d@e.f"), (503, "1.2.3.4.5.6.7.8")]
    got = personal.personal(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((d, ",".join(slow_base(t))) for d, t in rows)
    base = lambda r: ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in personal.BASE_PLAIN)
    assert Counter((r["doc_id"], base(r)) for r in got) == want
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(base(r).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.BASE_PLAIN] == [len(re.findall(rf"\b{k}:", base(r))) for k in personal.BASE_PLAIN]


def test_personal_added_kinds(spark):
    texts = {
        1: "Transfer to GB82 WEST 1234 5698 7654 32 today", 2: "GB82WEST12345698765431", 3: "DE89370400440532013000",
        4: "Phone: (202) 555-0147.", 5: "Serial 202 555 0147", 6: "my SSN is 078-05-1120", 7: "078-05-1120", 8: "ssn 000-05-1120", 9: "call +1 202-555-0147",
        10: "xGB82WEST12345698765432",
    }
    got = {r["doc_id"]: r for r in personal.personal(frame(spark, list(texts.items()))).collect()}
    added = {d: [s for s in r["spans"].split(",") if s and s.split(":")[0] not in personal.BASE_PLAIN] for d, r in got.items()}
    assert added == {
        1: ["iban:12:39"], 2: [], 3: ["iban:0:22"], 4: ["tel:7:21"], 5: [], 6: ["ssn:10:21"], 7: [], 8: [], 9: ["tel:8:20"], 10: [],
    }
    assert all(r["n_added"] == len(added[d]) for d, r in got.items())
    assert got[9]["top_score"] == 100 and got[5]["top_score"] == 0


def test_personal_long_texts(spark):
    rows = [(1, "a@b.cd " * 50_000), (2, "x" * 2_000_000), (3, "1" * 1_000_000), (4, "1.2." * 200_000), (5, "a." * 300_000 + "@" + "b." * 300_000)]
    got = {r["doc_id"]: r for r in personal.personal(frame(spark, rows)).collect()}
    assert got[1]["n_email"] == 50_000 and got[1]["spans"].endswith("email:349993:349999")
    assert got[2]["spans"] == "" and got[3]["spans"] == "" and got[4]["n_ip"] == 100_000
    assert got[5]["n_email"] == 1
    assert personal.personal(frame(spark, [])).count() == 0


TALKS = "conv_id long, turn long, role string, text string, codes string, n int, sums string"


def slow_trie(rows):
    own = defaultdict(list)
    for c, k, role, text in rows:
        if c is not None:
            own[c].append((k is not None, k or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    told = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        told[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in told.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * words
    return [
        (
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(told[c]) == len(p)).encode()).hexdigest(),
        )
        for p, cs in members.items()
    ]


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TALKS)


@pytest.mark.parametrize("seed", range(3))
def test_trie_is_brute_force_across_blocks(spark, monkeypatch, seed):
    for name, value in {"ROWS": 12, "FEW": 6, "PACK": 3, "BYTES": 200}.items():
        monkeypatch.setattr(prefix_trie, name, value)
    rng = random.Random(seed)
    says = ["a", "b b", "c c c", "", None, "d  d\td"]
    rows = []
    for c in [*range(-45, 160), 1000, 1001, 1002]:
        for k in range(rng.choice([1, 1, 2, 3, 5, 8, 30 if c % 50 == 0 else 4])):
            rows.append((c, k if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), says[rng.randrange(2 if rng.random() < 0.8 else len(says))]))
    rows += rng.sample(rows, 20) + [(None, 0, "user", "lost"), (2001, 5, "user", "only"), (2041, None, None, None)]
    rows += [(c, k, "user", "same") for c in range(3000, 3120) for k in range(6)]
    rng.shuffle(rows)
    got = [tuple(r) for r in prefix_trie.prefix_trie(talk_frame(spark, rows)).collect()]
    assert ordered(got) == ordered(slow_trie(rows))


def test_trie_of_nothing_and_of_a_long_talk(spark):
    assert prefix_trie.prefix_trie(talk_frame(spark, [])).count() == 0
    rows = [(c, k, "user", "w " * 3) for c in (20, 21) for k in range(3000)] + [(22, 0, "user", "x" * 2_000_000)]
    got = [tuple(r) for r in prefix_trie.prefix_trie(talk_frame(spark, rows)).collect()]
    assert ordered(got) == ordered(slow_trie(rows))
