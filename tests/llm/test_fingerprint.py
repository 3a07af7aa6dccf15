import hashlib

import numpy as np
from tributary.llm import fingerprint as P
from tributary.llm.words import _BYTE, _BYTE2

from .cases import table, words


M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_print(data):
    """Level and both signatures of a text, byte by byte, from the definition."""
    first, second = _BYTE.tolist(), _BYTE2.tolist()
    inverse, edge = pow(BASE, -1, 1 << 64), [pow(BASE, k, 1 << 64) for k in range(7)]
    ones, h = [], 0
    for j, b in enumerate(data):
        if j < 7:
            h += first[b] * edge[j]
        else:
            h = (h - first[data[j - 7]]) * inverse + first[b] * edge[6]
        h &= M
        x, n = mixed(h), 0
        while x & 1:
            x, n = x >> 1, n + 1
        ones.append(n)
    level = 0
    while sum(n >= 3 + level for n in ones) + 1 >= 32:
        level += 1
    out = []
    for up in (0, 1):
        ends = [j + 1 for j, n in enumerate(ones) if n >= 2 + level + up]
        if data and (not ends or ends[-1] != len(data)):
            ends.append(len(data))
        if len(ends) > 64:
            ends = [*ends[:63], ends[-1]]
        signs, a = "", 0
        for e in ends:
            v = sum(second[b] * pow(BASE, k, 1 << 64) for k, b in enumerate(data[a:e])) + e - a
            signs += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[mixed(v & M) >> 58]
            a = e
        out.append(signs)
    return level, out


def plain_likeness(x, y):
    if x == y:
        return 1.0
    best = 0.0
    for i in (0, 1):
        for j in (0, 1):
            a, b = x[1][i], y[1][j]
            run = min(3, len(a), len(b))
            if x[0] + i == y[0] + j and run and {a[k : k + run] for k in range(len(a) - run + 1)} & {b[k : k + run] for k in range(len(b) - run + 1)}:
                best = max(best, 2 * lcs(a, b) / (len(a) + len(b)))
    return best


def brute(rows):
    """By plain Python alone; nothing of the operator is used."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    known, out = {}, []

    def of(text):
        if text not in known:
            known[text] = plain_print(text.encode())
        return known[text]

    name = lambda p: f"{4 << p[0]}:{p[1][0]}:{p[1][1]}"
    for k, (d, t) in enumerate(order):
        text, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + nxt[:half]
        p, e = of(text), of(edit)
        out.append((d, len(text), hashlib.sha256(edit.encode()).hexdigest(), name(p), name(e), plain_likeness(p, e), plain_likeness(p, of(nxt))))
    return sorted(out, key=str)


def test_neighbours_against_brute_force(spark):
    docs = table(spark)
    got = sorted((tuple(r) for r in P.compare_neighbours(docs.repartition(5)).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert P.compare_neighbours(table(spark, [])).count() == 0
    one = P.compare_neighbours(table(spark).where("doc_id = 9")).first()
    assert one.near_next == 1.0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in P.op8_fingerprint(spark, sf_dir).collect()), key=str) == brute(rows)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], max(row[j + 1], row[j], old + (x == y))
    return row[-1]


def test_bit_parallel_distance():
    r = np.random.default_rng(2)
    a, b = (np.full((200, 64), 255, np.uint8) for _ in range(2))
    m, n = r.integers(0, 65, 200), r.integers(0, 65, 200)
    for i in range(200):
        a[i, : m[i]], b[i, : n[i]] = r.integers(0, 4, m[i]), r.integers(0, 4, n[i])
    got = P._alike(a, m, b, n)
    for i in range(200):
        want = 2 * lcs(a[i, : m[i]].tolist(), b[i, : n[i]].tolist()) / max(1, m[i] + n[i])
        assert abs(got[i] - want) < 1e-12 or (got[i] == 0 and min(m[i], n[i]) >= 0)


def test_properties():
    texts = [words(300, k) for k in range(60)]
    alone = [P.prints([t.encode()]).strings()[0] for t in texts]
    assert P.prints([t.encode() for t in texts]).strings() == alone  # neighbours in a batch don't matter
    p = P.prints([t.encode() for t in texts] + [(t + " tail").encode() for t in texts])
    near = P.likeness(p.take(slice(0, 60)), p.take(slice(60, 120)))
    far = P.likeness(p.take(slice(0, 59)), p.take(slice(1, 60)))
    assert near.min() > 0.85 and far.max() < 0.4 and (near <= 1).all()


def test_map_only_form(spark):
    docs = table(spark)
    assert P.fingerprint_documents(docs).count() == docs.count()
