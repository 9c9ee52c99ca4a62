"""Filter interaction audit and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from kinetable.llm import op11_filter_audit as audit, op13_importance as imp

from .conftest import sentence


# ---- audit
def failing(rows):
    """Set of failed filters of each row (doc_id, text), by the contract's words."""
    smallest = {}
    for i, t in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        out.append({k for k, v in fails.items() if v})
    return out


def brute_audit(rows, labels):
    """rows: doc_id, text, part; labels: doc_id, quality, toxic."""
    good, toxic = ({i for i, *v in labels if v[n] == 1 and i is not None} for n in (0, 1))
    fails = failing([r[:2] for r in rows])
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(f, r[0]) for f, r in zip(fails, rows, strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                earlier = sum(f in x[0] for x in own) - len(gone)
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), earlier, sum(x[0] == {f} for x in own),
                                                   sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(docs_df, labels_df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.COUNTS] for r in audit.audit(docs_df, labels_df).collect()}


def table_of(docs, rows):
    return docs([(i, t, None, s, 1) for i, t, s in rows])


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit_equals_brute_force(spark, docs):
    r = random.Random(4)
    pool = [sentence(i, n) for i, n in enumerate([3, 49, 50, 60, 80, 200, 200])]
    pool += [pool[3].upper(), pool[4] + " #", "a b " * 30, "É" * 20 + " A", "", None, "x y " * 60, "\x1c " * 60, "x " * 49 + "x"]
    rows = [(r.choice([None, *range(60)]), r.choice(pool), r.choice(["web", "books", "", None])) for _ in range(150)]
    rows += rows[:20]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert audited(table_of(docs, rows), label_table(spark, labels)) == brute_audit(rows, labels)


def test_audit_of_nothing_and_of_nulls(spark, docs):
    none = label_table(spark, [])
    assert audited(table_of(docs, []), none) == {}
    rows = [(None, None, None), (None, None, None), (1, None, None)]
    assert audited(table_of(docs, rows), none) == brute_audit(rows, [])


def test_very_long_text(spark, docs):
    rows = [(1, "word " * 300_000, "s"), (2, "x" * 2_000_000, "s"), (3, "word " * 300_000, "t")]
    assert audited(table_of(docs, rows), label_table(spark, [])) == brute_audit(rows, [])


def test_every_state_of_the_walk():
    """Survivors of each subset, whatever the number of filters, against counting; each step toggles one filter."""
    for n in (1, 3, 5, 6):
        counts = np.random.default_rng(n).integers(0, 9, (2, 1 << n, 3))
        states = audit.survivors(counts, n)
        for subset in range(1 << n):
            free = [m for m in range(1 << n) if not m & subset]
            assert (states[subset] == counts[:, free].sum(axis=1)).all()
        walked = np.bitwise_xor.accumulate([1 << b for b in audit.gray_toggles(n)])
        assert sorted(walked) == list(range(1, 1 << n))


def test_own_filters(spark, docs):
    rows = [(i, t, "p") for i, t in enumerate(["a", "b", "ab", "", "b"])]
    filters = {"A": lambda t: t.contains("a"), "B": lambda t: t.contains("b")}
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in audit.audit(table_of(docs, rows), label_table(spark, []), filters).collect()}
    assert len(got) == 18 and got["ABE", 1] == (3, 2) and got["ABE", 2] == (1, 2) and got["EBA", 1] == (4, 1) and got["EBA", 2] == (2, 2)


# ---- resampling
def features(text, gram=2):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [" ".join(words[i:i + n]) for n in range(1, gram + 1) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, buckets=10_000, gram=2, percent=25, min_words=20):
    of = lambda t: [zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets for f in features(t, gram)[1]]
    s, t = Counter(b for _, x in rows for b in of(x)), Counter(b for x in target for b in of(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(n_s + buckets) / ((s[b] + 1) * float(n_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        found = of(x)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, len(features(x)[0])])
    able = sorted([r for r in out if r[4] >= min_words and r[3] is not None], key=lambda r: (-r[3], r[0], r[1], r[2]))
    ranks = [(*r[:4], k if k <= percent * len(able) // 100 else None) for k, r in enumerate(able, 1)]
    return ranks + [(*r[:4], None) for r in out if r[4] < min_words or r[3] is None]


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_crc_matrices_equal_zlib():
    r = random.Random(1)
    some = [bytes(r.randrange(256) for _ in range(r.choice([1, 2, 5, 5, 5, 30, 256, 257, 900]))) for _ in range(3000)]
    features = imp.Features.of(some)
    want = [zlib.crc32(f) for f in some]
    assert imp.crcs(features).tolist() == want == imp.crcs(features, long=4).tolist()
    assert imp.crcs(imp.Features.of([])).tolist() == []
    head, tail = np.arange(2000), np.arange(2999, 999, -1)
    runs = imp.Runs(features, head, features, tail)
    want = [zlib.crc32(some[a] + b" " + some[b]) for a, b in zip(head, tail)]
    assert imp.crcs(runs).tolist() == want == imp.crcs(runs, long=9).tolist() == imp.crcs(runs.gathered()).tolist()


@pytest.mark.parametrize("gram", [1, 2, 3])
def test_buckets_of_features(gram):
    texts = ["One two-two THREE2 ünï 日本", None, "", "a", "a b", " \n", sentence(1, 500), "b a"]
    bucket, owner, words = imp.buckets_of(texts, 10_000, gram)
    for i, t in enumerate(texts):
        found = features(t, gram)
        assert words[i] == len(found[0])
        assert Counter(bucket[owner == i].tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in found[1])
    none = imp.buckets_of([], 10_000, gram)
    assert [len(x) for x in none] == [0, 0, 0]


def test_resample_equals_brute_force(docs, odd):
    r = random.Random(6)
    rows = [*odd, *[(i, sentence(r.randrange(40), r.choice([5, 19, 20, 21, 80])) + " İSTANBUL x y") for i in range(20, 300)], (11, "ab" * 100_000 + " c")]
    rows += rows[20:40]
    target = [sentence(7, 200), None, "", "The quick brown fox"]
    got = imp.resample(docs(rows), docs([(0, t) for t in target])).collect()
    assert in_order(got) == in_order(brute_resample(rows, target))
    few = imp.resample(docs(rows), docs([]), percent=50, min_words=80, buckets=64, gram=1).collect()
    assert in_order(few) == in_order(brute_resample(rows, [], 64, 1, 50, 80))


def test_resample_of_nothing(docs):
    assert imp.resample(docs([]), docs([(1, "a b")])).collect() == []
    assert in_order(imp.resample(docs([(None, "a b"), (1, None)]), docs([])).collect()) == in_order(brute_resample([(None, "a b"), (1, None)], []))
