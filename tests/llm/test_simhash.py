import random
import re

import numpy as np
import xxhash

from staywise.llm import queries, simhash
from staywise.llm.components import connected_components
from staywise.llm.tiles import stars
from tests.llm.helpers import SF, clashing, components, docs_frame, documents


def plain_fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def plain(rows, radius=4):
    fps = {d: plain_fingerprint(t) for d, t in rows}
    ids = sorted(fps)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (fps[a] ^ fps[b]).bit_count() <= radius]
    return fps, components(ids, near)


def test_documents_match_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    fps, comp = plain(rows)
    got = queries.queries()["op8_simhash"](spark, SF).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{x:016x}" for d, x in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert len(got) == len(rows)


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (7, "one"), (8, "ONE"), (2, "one two three"), (1, "a b c d " * 5000), (4, "a b c d " * 5000), (4, "a b c d " * 5000)]
    got = simhash.near_duplicates(clashing(docs_frame(spark, rows))).collect()
    fps, comp = plain([(d, t) for d, t in rows])
    assert len(got) == len(rows)
    assert all(r["component_id"] == comp[r["doc_id"]] and r["fp"] % 2**64 == fps[r["doc_id"]] for r in got)
    nul = simhash.near_duplicates(docs_frame(spark, [(None, "x y z"), (6, "x y z"), (None, "lonely words here now")])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"] or -1) for r in nul) == [(False, 6), (True, -1), (True, 6)]
    assert simhash.near_duplicates(docs_frame(spark, [])).collect() == []


def test_links_lose_nothing_in_hot_buckets(spark):
    """Fingerprints crowded into a few buckets, tiles far smaller than a bucket."""
    rng = random.Random(4)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(120):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randint(0, 63)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for tile in (2048, 32):
        got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, 4, tile_rows=tile)).collect()}
        want = components(signed, [(a, b) for k, a in enumerate(signed) for b in signed[k + 1:] if ((a ^ b) % 2**64).bit_count() <= 4])
        assert {n: got.get(n, n) for n in signed} == want


def test_slicing_always_covers_the_radius():
    for n in (1, 10**4, 10**6, 10**9, 10**12):
        buckets = simhash.slicing(n, 4)
        parts = {s for b in buckets for s in b}
        assert sum(hi - lo for lo, hi in parts) == 64
        rng = random.Random(n)
        for _ in range(50):
            flipped = {rng.randint(0, 63) for _ in range(4)}
            assert any(not any(lo <= f < hi for f in flipped for lo, hi in b) for b in buckets)


def test_stars_and_components(spark):
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    want = components(range(400), list(zip(u.tolist(), v.tolist())))
    a, b = stars(u, v)
    assert {**{n: n for n in range(400)}, **dict(zip(a.tolist(), b.tolist()))} == want
    chain = [(k, k + 1) for k in range(200)] + [(5, 5), (None, 3)]
    got = connected_components(spark.createDataFrame(chain + list(zip((u + 1000).tolist(), (v + 1000).tolist())), "x long, y long"))
    got = {r["node"]: r["component"] for r in got.collect()}
    assert all(got[k] == 0 for k in range(201))
    assert all(got.get(k + 1000, k + 1000) == c + 1000 for k, c in want.items())


def test_one_row_of_each_group_whatever_the_ids(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    a, b, c = (" ".join(random.Random(k).choices(words, k=300)) for k in (1, 2, 3))
    near = a[:-4] + " end"
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, near), (3, None), (3, ""), (4, None), (1, b)]
    fp = {t: simhash.fingerprint((t or "").encode(), 4) for _, t in rows}
    assert (fp[a] ^ fp[near]).bit_count() <= 4 < min((fp[x] ^ fp[y]).bit_count() for x, y in ((a, b), (a, c), (b, c)))
    got = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(clashing(docs_frame(spark, rows))).collect()]
    named = [(i, t) for i, t in got if i != 3]
    assert sorted(named, key=repr) == sorted([(1, a), (1, b), (None, c)], key=repr)
    assert [i for i, t in got if not t] == [3]  # null and empty share fingerprint 0
    got = simhash.one_of_each(docs_frame(spark, [(1, a), (1, b), (2, a)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, a), (1, b)])
