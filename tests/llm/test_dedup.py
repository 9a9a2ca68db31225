"""Exact, near and substring deduplication against plain versions."""

import hashlib
import random
import re

import numpy as np
import plain
from hypothesis import given, settings
from hypothesis import strategies as st

from refrain.llm import exact_cuckoo, links, simhash_vantage, substring_levels


def _bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups_of_awkward_rows(spark):
    docs = plain.awkward(spark)
    found = exact_cuckoo.exact_dedup(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(found) == len(rows)
    for r in found:
        own = [(i, t) for i, t in rows if hashlib.sha256(_bare(t).encode()).digest() == bytes(r["digest"])]
        best = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r["group_size"], r["keep_id"]) == (len(own), best[0])
        assert r["kept"] == (r["doc_id"] == best[0])
    assert exact_cuckoo.exact_dedup(plain.empty(spark)).count() == 0


def test_index_inserts_and_deletes(spark):
    docs = plain.awkward(spark)
    none = spark.createDataFrame([], exact_cuckoo.GROUP)
    index = exact_cuckoo.insert_batch(none, docs)
    twice = exact_cuckoo.insert_batch(index, docs)
    assert {(bytes(r["digest"]), r["group_size"]) for r in twice.collect()} == {(bytes(r["digest"]), 2 * r["group_size"]) for r in index.collect()}
    gone = index.limit(2).select("digest")
    left = exact_cuckoo.delete_digests(index, gone)
    assert left.count() == index.count() - 2


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=600))
def test_cuckoo_shard_is_a_set(steps):
    shard, live = exact_cuckoo.CuckooShard(), set()
    for insert, n in steps:
        digest = hashlib.sha256(str(n).encode()).digest()
        if insert:
            shard.insert(digest, n, 1, 1)
            live.add(digest)
        else:
            assert shard.delete(digest) == (digest in live)
            live.discard(digest)
    assert {d for d in live if shard.find(d)} == live
    assert len(shard.frame()) == len(live)


def test_cuckoo_filter_is_rebuilt_on_overflow():
    shard = exact_cuckoo.CuckooShard()
    for n in range(3_000):
        shard.insert(hashlib.sha256(str(n).encode()).digest(), n, 1, 1)
    assert shard.rebuilds > 0 and len(shard.frame()) == 3_000
    assert all(shard.find(hashlib.sha256(str(n).encode()).digest()) for n in range(3_000))


def test_fingerprints_and_components_of_awkward_rows(spark):
    docs = plain.awkward(spark)
    texts = [r["text"] for r in docs.collect()]
    assert [int(x) for x in simhash_vantage.fingerprints(texts)] == [plain.shingle_fingerprint(t) for t in texts]
    found = simhash_vantage.near_duplicates(docs).collect()
    assert len(found) == len(texts)
    by_fp = {}
    for r in found:
        by_fp.setdefault(r["fp"] % 2**64, []).append(r)
    points = list(by_fp)
    groups = plain.linked_groups(points)
    for k, point in enumerate(points):
        ids = [r["doc_id"] for j, p in enumerate(points) if groups[j] == groups[k] for r in by_fp[p] if r["doc_id"] is not None]
        assert all(r["component_id"] == min(ids, default=None) for r in by_fp[point])
    assert simhash_vantage.near_duplicates(plain.empty(spark)).count() == 0


def test_vantage_shards_find_all_groups(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(700)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:200]] + [base[0] ^ (1 << i) for i in range(40)]
    points = sorted({*base, *near})
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in points]
    distinct = spark.createDataFrame(signed, "fp bigint")
    edges = simhash_vantage.near_links(distinct, shard_rows=60)
    root = {r["node"]: r["root"] for r in links.components(edges).collect()}
    expected = plain.linked_groups(points)
    got = [root.get(s[0], s[0]) for s in signed]
    assert len({(a, b) for a, b in zip(got, expected, strict=True)}) == len(set(expected)) == len(set(got))


def test_component_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u bigint, v bigint")
    root = {r["node"]: r["root"] for r in links.components(edges).collect()}
    assert root == {i: 0 for i in range(1, 61)} | {101: 100}


def _pieces(rng):
    pool = ["".join(rng.choice("abcdef") for _ in range(rng.randint(150, 900))) for _ in range(3)]
    out = []
    for _ in range(14):
        text = ""
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            text += p[a:] if rng.random() < 0.6 else "".join(rng.choice("xyzé") for _ in range(rng.randint(0, 200)))
        out.append(text)
    return out


def _check_spans(spark, texts, length, hot_rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, rid string")
    raw = [(t or "").encode() for t in texts]
    expected = plain.repeated_bytes(raw, length)
    found = {r["id"]: r for r in substring_levels.remove_repeats(docs, length=length, hot_rows=hot_rows).collect()}
    for i, (data, gone) in enumerate(zip(raw, expected, strict=True)):
        got = {p for s in found[i]["spans"] for p in range(s["start"], s["stop"])}
        assert got == gone
        assert bytes(found[i]["kept"]) == bytes(b for p, b in enumerate(data) if p not in gone)
        ends = [(s["start"], s["stop"]) for s in found[i]["spans"]]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_repeats_match_brute_force(spark):
    texts = _pieces(random.Random(8)) + [None, "", "a" * 700, "ab" * 300, "short"]
    _check_spans(spark, texts, 160, substring_levels.HOT_ROWS)
    _check_spans(spark, texts, 160, 1)


def test_repeats_across_segments_and_batches(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(substring_levels, "SEGMENT", 300)
    monkeypatch.setattr(substring_levels, "FIRST_BATCH", 8)
    texts = [t.encode() for t in _pieces(rng)]
    import pandas as pd

    rows = pd.concat(list(substring_levels._anchor_rows(list(range(len(texts))), texts, 160)), ignore_index=True)
    reach = 160 - substring_levels.PIECE
    rows["before"] = np.minimum(rows.pos, reach)
    rows["after"] = [min(len(texts[r]) - p, 160) for r, p in zip(rows.rid, rows.pos, strict=True)]
    rows["context"] = [texts[r][p - b : p + a] for r, p, b, a in zip(rows.rid, rows.pos, rows.before, rows.after, strict=True)]
    got = [set() for _ in texts]
    for part in substring_levels._shard(iter([rows.iloc[i : i + 5] for i in range(0, len(rows), 5)]), 160):
        for r, a, b in zip(part.rid, part.start, part.stop, strict=True):
            got[r] |= set(range(a, b))
    assert got == plain.repeated_bytes(texts, 160)


def test_repeats_of_awkward_rows(spark):
    docs = plain.awkward(spark)
    found = substring_levels.remove_repeats(docs).collect()
    assert len(found) == docs.count()
    assert {r["n_bytes"]: len(bytes(r["kept"])) for r in found if r["id"] == 7} == {150_000: 0}
    assert substring_levels.remove_repeats(plain.empty(spark)).count() == 0
