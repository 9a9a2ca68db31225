"""Rare-feature digests, spelling variants and the conversation trie against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.llm import parens_trie, permuterm, queries, rare_digest
from refrain.llm.common import table

DOCS = "doc_id bigint, text string"
TURNS = "conv_id bigint, turn bigint, role string, text string"


# --- fingerprints ------------------------------------------------------------------------------------------------------


def plain_class(window: bytes) -> int:
    parts = sum(int(rare_digest._ENTROPY_PART[n]) for n in Counter(window).values())
    return (rare_digest._FULL - parts) * 1000 // rare_digest._FULL


def plain_places(raw: bytes, rank: np.ndarray) -> list[int]:
    worth = [int(rank[plain_class(raw[i : i + 32])]) for i in range(len(raw) - 31)]
    votes = Counter()
    for s in range(-63, len(worth)):
        seen = [(worth[i], i) for i in range(max(0, s), min(len(worth), s + 64)) if worth[i] < rare_digest.CLASSES]
        if seen:
            votes[min(seen)[1]] += 1
    return sorted(i for i, n in votes.items() if n >= 16)


TEXTS = ["", "short", "x" * 500, "A plain sentence of some words, repeated. " * 9, "é" * 10 + "Über allen Gipfeln ist Ruh, in allen Wipfeln spürest du kaum einen Hauch. " * 3]


def test_windows_classes_and_selection_equal_plain_versions(monkeypatch):
    monkeypatch.setattr(rare_digest, "SEGMENT", 150)
    rng = random.Random(5)
    texts = [*TEXTS, "".join(rng.choice("abcdef ghij") for _ in range(1_000))]
    raws = [t.encode() for t in texts]
    counts = rare_digest.class_counts(raws)
    plain = Counter(plain_class(r[i : i + 32]) for r in raws for i in range(len(r) - 31))
    assert {k: int(n) for k, n in enumerate(counts) if n} == dict(plain)
    rank = rare_digest.rarity(counts)
    data, start, size = rare_digest._joined(raws)
    at = rare_digest.selected(data, rare_digest._inside(len(data), start, size), rank)
    for raw, s in zip(raws, start.tolist(), strict=True):
        assert [x - s for x in at.tolist() if s <= x < s + len(raw)] == plain_places(raw, rank)


def test_fingerprints_depend_on_the_text_alone():
    rank = rare_digest.rarity(np.arange(rare_digest.CLASSES))
    raws = [t.encode() for t in TEXTS]
    together = rare_digest.filters(raws, rank)
    for raw, chain in zip(raws, together, strict=True):
        assert np.array_equal(chain, rare_digest.filters([raw], rank)[0])
        assert np.array_equal(chain, rare_digest.chain_of(rare_digest.fingerprint_text(chain)))
        assert rare_digest.likeness(chain, chain) == 1
    assert [len(c) > 0 for c in together] == [False, True, True, True, True]
    assert rare_digest.likeness(together[0], together[1]) == 0


def test_chains_grow_with_the_text_and_half_a_text_is_half_alike():
    rng = random.Random(8)
    one, two = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60_000)) for _ in range(2))
    rank = rare_digest.rarity(rare_digest.class_counts([one.encode()]))
    a, b, c = rare_digest.filters([one.encode(), two.encode(), rare_digest.edited(one, two).encode()], rank)
    assert len(a) > 3
    assert rare_digest.likeness(a, b) < 0.05 and 0.4 < rare_digest.likeness(a, c) < 0.7


def plain_following(rows: list[tuple]) -> dict:
    out = defaultdict(list)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[doc_id].append((len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("part_rows", [3, 40, 100_000])
def test_every_document_meets_the_one_after_it(spark, part_rows):
    rng = random.Random(part_rows)
    rows = [(k * 7 % 101, "".join(rng.choice("abc é\n") for _ in range(rng.randint(0, 300)))) for k in range(101)]
    rows[4] = (rows[4][0], None)
    found = rare_digest.fingerprint_table(spark.createDataFrame(rows, DOCS).repartition(5), part_rows=part_rows).collect()
    assert {r["doc_id"]: [(r["n_chars"], r["edited_sha256"])] for r in found} == plain_following(rows) and len(found) == 101
    prints = {r["doc_id"]: r["fingerprint"] for r in found}
    for r in found:
        after = prints[(r["doc_id"] + 1) % 101]
        assert r["near_next"] == rare_digest.likeness(rare_digest.chain_of(r["fingerprint"]), rare_digest.chain_of(after))
        assert r["near_edited"] == rare_digest.likeness(rare_digest.chain_of(r["fingerprint"]), rare_digest.chain_of(r["edited_fingerprint"]))


@pytest.mark.parametrize("part_rows", [2, 50])
def test_digest_of_null_and_repeated_rows(spark, part_rows):
    rows = [(None, "no id " * 20), (None, None), *[(7, "the very same row " * 9)] * 9, (8, "")]
    found = rare_digest.fingerprint_table(spark.createDataFrame(rows, DOCS).withColumn("part", F.lit(1)), part_rows=part_rows).collect()
    assert sorted((r["doc_id"] or -1) for r in found) == [-1, -1, *[7] * 9, 8]
    same = [r for r in found if r["doc_id"] == 7]
    assert len({r["fingerprint"] for r in same}) == 1 and sum(r["near_next"] == 1 for r in same) == 8
    alone = rare_digest.fingerprint_table(spark.createDataFrame([(1, "one text " * 30)], DOCS)).first()
    assert alone["near_next"] == 1
    assert rare_digest.fingerprint_table(spark.createDataFrame([], DOCS)).count() == 0


def test_digest_query(spark):
    found = queries.op11_rare_digest(spark, "/root/testdata/sf0.001").toPandas()
    assert len(found) == 200 and found.near_edited.between(0, 1).all() and found.near_next.between(0, 1).all()
    assert found.near_edited.mean() > 0.4 and found.near_next.mean() < 0.05


# --- spelling variants -------------------------------------------------------------------------------------------------


def plain_near(words: dict[str, int]) -> dict[str, set[str]]:
    signs = set("".join(words))
    near = {}
    for w in words:
        some = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in signs}
        some |= {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in signs}
        near[w] = (some & set(words)) - {w}
    return near


def plain_forms(words: dict[str, int]) -> dict[str, tuple]:
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_forms_equal_plain_forms(spark, seed):
    rng = random.Random(seed)
    some = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 6))) for _ in range(200)}
    words = {w: rng.choice([5, 5, 6, 30, 150, 800, 4_000]) for w in some}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = {r["word"]: tuple(r)[1:] for r in permuterm.spelling_forms(frame).collect()}
    assert found == plain_forms(words)
    near = defaultdict(list)
    for r in permuterm.neighbours(frame).collect():
        near[r["word"]].append(r["near"])
    assert {w: sorted(x) for w, x in near.items()} == {w: sorted(x) for w, x in plain_near(words).items() if x}


def test_words_slip_by_checksum_and_lower_only_a_to_z(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["Straßen", "ÉTUDIER", "étudier", "walking", "x×yzabc", "naïveté", "日本語abcdefg"]) for _ in range(30))) for k in range(300)]
    rows += [(None, "walking walking"), (1, None), (2, ""), rows[5]]
    plain = Counter()
    for doc_id, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run if not run or h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            plain[word] += 1
            run = ""
    found = {r["word"]: r["n"] for r in permuterm.word_counts(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {w: n for w, n in plain.items() if len(w) >= 6} and len(found) > 7
    assert permuterm.spelling_groups(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "walking " * 6)], DOCS).withColumn("word", F.lit("n")).withColumn("head", F.lit(0))
    assert [tuple(r) for r in permuterm.spelling_groups(clash).collect()] == [("walking", None, "walking", 6, 0, None)]


# --- conversation trie -------------------------------------------------------------------------------------------------


def plain_trie(rows: list[tuple]) -> list[tuple]:
    held = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            held[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    held = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in held.items()}
    whole = {}
    for c, turns in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = (*held.get(c - c % 100, [])[:h], *turns[h:])
    nodes = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children, leaves, saved = Counter(p[:-1] for p in nodes if p), Counter(), Counter()
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children[path], leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1, 9, 200_000])
def test_trie_equals_plain_trie_in_shards_of_any_size(spark, monkeypatch, shard):
    monkeypatch.setattr(parens_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(parens_trie, "PIECE", 3)
    rng = random.Random(shard)
    rows = []
    for c in [*range(0, 40), *range(250, 270), 300]:
        rows += [(c, k if k else None, rng.choice(["user", None]), rng.choice(["a", "bb", None])) for k in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "lost")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("keys", F.lit(1)).repartition(3)
    found = parens_trie.conversation_trie(turns).drop("never").collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_trie(rows)


def test_trie_of_no_rows_and_of_one_turnless_conversation(spark):
    assert parens_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    turnless = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(turnless, 0, "user", "gone")]
    assert [tuple(r) for r in parens_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()] == plain_trie(rows)


@pytest.mark.parametrize("seed", range(5))
def test_find_close_equals_a_stack(seed):
    rng = random.Random(seed)
    signs, depth = [1], 1
    while len(signs) < 3_000:
        step = 1 if depth < 2 or rng.random() < 0.5 + 0.2 * (seed - 2) * (-1) ** (len(signs) // 700) else 0
        signs.append(step)
        depth += 2 * step - 1
    signs += [0] * depth
    stack, close = [], {}
    for at, sign in enumerate(signs):
        if sign:
            stack.append(at)
        else:
            close[stack.pop()] = at
    opens = np.array(sorted(close))
    assert parens_trie.Parentheses(np.array(signs, np.int8)).find_close(opens).tolist() == [close[k] for k in opens.tolist()]


def test_trie_query_over_the_given_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_prefix_trie(spark, "/root/testdata/sf0.001").collect()), key=repr) == plain_trie(rows)
