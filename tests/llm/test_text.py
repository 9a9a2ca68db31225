"""Decontamination, BPE, token files and page text against plain versions."""

import random

import numpy as np
import plain
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from refrain.llm import bpe_speculate, decontaminate_pigeonhole, html_crf, token_files

WORD_BPE, BYTE_BPE, BYTE_RANKS = (str(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def field():
    return html_crf.fit(html_crf.labelled_pages())


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=70), st.text("abc ", max_size=90))
def test_bit_parallel_distance(item, text):
    if item:
        assert decontaminate_pigeonhole.Pattern(item).best(text)[0] == plain.substring_distance(item, text)


def test_searcher_finds_what_is_within_budget():
    rng = random.Random(2)
    letters = "abcdefghij "
    for _ in range(150):
        item = decontaminate_pigeonhole.plain("".join(rng.choice(letters) for _ in range(rng.randint(5, 120))))
        changed = list(item)
        for _ in range(rng.randint(0, len(item) // 20 + 2)):
            at = rng.randrange(len(changed) + 1)
            changed[at : at + rng.randint(0, 1)] = rng.choice(("", "x", rng.choice(letters)))
        text = decontaminate_pigeonhole.plain("zz" + "".join(changed) + " tail")
        found = decontaminate_pigeonhole.Searcher([("i", item)]).find(text) if item else []
        if item:
            least = plain.substring_distance(item, text)
            assert bool(found) == (least <= decontaminate_pigeonhole.budget(item))
            if found:
                assert found[0][1] == least == plain.substring_distance(item, text[found[0][2] : found[0][3]])


def test_leaks_of_awkward_tables(spark):
    docs = plain.awkward(spark)
    items = spark.createDataFrame(
        [(1, "quick  BROWN fox jumps"), (2, "quick brown fox jumps"), (3, None), (4, "  "), (5, "jumps over the lasy dog and runs"), (None, "orphan text")],
        "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate_pigeonhole.leaks(docs, items).collect()}
    expected = {(i, k, d) for i in (1, 2, 3, 8) for k, d in ((1, 0), (2, 0), (5, 1))} | {(None, None, 0)}
    assert found == expected
    small_passes = decontaminate_pigeonhole.leaks(docs, items, pass_chars=20)
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in small_passes.collect()} == expected
    assert decontaminate_pigeonhole.leaks(plain.empty(spark), items).count() == 0
    assert decontaminate_pigeonhole.leaks(docs, items.limit(0)).count() == 0


@pytest.fixture(scope="module")
def word_bpe():
    return bpe_speculate.Speculator(WORD_BPE), Tokenizer.from_file(WORD_BPE)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("aeinorst'!1 Σé\n", max_size=60) | st.sampled_from(["<|endoftext|>x<|startoftext|>", "a" * 50, "İẞΣ", "  '' 'll"]))
def test_word_bpe_equals_the_library(word_bpe, text):
    own, library = word_bpe
    text = text.encode("utf-8", "ignore").decode()
    packed, decoded = own.encode([text])
    expected = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed[0], "<u4").tolist() == expected
    assert decoded[0] == library.decode(expected, skip_special_tokens=False)


def test_bpe_of_awkward_rows(spark, word_bpe):
    docs = plain.awkward(spark)
    found = sorted((r["doc_id"] or -1, bytes(r["ids"]), r["decoded"]) for r in bpe_speculate.encode_decode(docs, WORD_BPE).collect())
    expected = []
    for r in docs.collect():
        ids = word_bpe[1].encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((r["doc_id"] or -1, np.array(ids, "<u4").tobytes(), word_bpe[1].decode(ids, skip_special_tokens=False)))
    assert found == sorted(expected)
    assert bpe_speculate.encode_decode(plain.empty(spark), WORD_BPE).count() == 0


@pytest.mark.parametrize("block_tokens", [7, 65_536])
def test_token_counts(spark, block_tokens):
    docs = plain.awkward(spark)
    library = Tokenizer.from_file(BYTE_BPE)
    library.encode_special_tokens = True
    expected = sorted((r["doc_id"] or -1, len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    blocks, order = token_files.write_blocks(docs, BYTE_RANKS, PATTERN, block_tokens=block_tokens)
    counts = token_files.document_counts(blocks, token_files.end_id(BYTE_RANKS), block_tokens, run_blocks=3)
    found = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in order.join(counts, ["file", "place"]).collect())
    assert found == expected
    assert token_files.count_tokens(plain.empty(spark), BYTE_RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("text", ["x" + " " * 5_000 + "y", " " * 1_000_000, "\n" * 9_000 + "z", "a\n" + " \t" * 3_000 + "\n b", "a" * 100_000, "end" + " " * 4_000])
def test_encoding_of_long_runs(text):
    library = Tokenizer.from_file(BYTE_BPE)
    expected = library.encode(text, add_special_tokens=False).ids if len(text) < 200_000 else None
    ids = token_files.encode(token_files.encoder(BYTE_RANKS, PATTERN), text)
    assert ids == expected if expected is not None else token_files.encoder(BYTE_RANKS, PATTERN).decode(ids) == text


def test_flat_files_and_unfinished_documents(spark, tmp_path):
    files = {"a.bin": [5, 5, 9, 9, 5, 5, 5], "b.bin": [], "c.bin": [9], "d.bin": [1] * 25 + [9]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    blocks = token_files.read_files(spark, str(tmp_path / "*.bin"), width=2, block_tokens=4)
    found = token_files.document_counts(blocks, 9, 4, run_blocks=2).collect()
    got = sorted((r["file"][-5:], r["place"], r["start"], r["n_tokens"], r["ended"]) for r in found)
    assert got == [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 3, False), ("c.bin", 0, 0, 0, True), ("d.bin", 0, 0, 25, True)]


PAGE = """<!doctype html><head><title>No</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Title &amp; more</h1><p>One  &lt;b&gt;\n two.<p>Three <b>four</b>.<script>var t="</p>";</script>
<div class="ad">Buy now!</div><p>Five &eacute; six.</article><aside><p>See also this.</p></aside><section class="comments"><p>I agree.</p></section>
<form><label>Mail</label><button>Go</button></form><!-- hidden --><footer>&copy; us</footer>"""


def test_page_text(field):
    assert html_crf.extract(PAGE, field) == "Title & more\nOne <b> two.\nThree four.\nFive é six."
    assert [html_crf.extract(x, field) for x in (None, "", "<p", "<script>x", "<!-- open", "<<<>>> &")][:2] == ["", ""]


def test_field_on_pages_it_has_not_seen(field):
    right = total = 0
    for found, labels in html_crf.labelled_pages(150, seed=77):
        right += sum(a == b for a, b in zip(field.decode(found), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_labelling(field):
    from itertools import product

    for found, _ in html_crf.labelled_pages(12, seed=5):
        found = found[:9]
        articled = any(map(html_crf.in_article, found))
        e = [field.emission(b, i, len(found), articled) for i, b in enumerate(found)]

        def worth(labels, e=e):
            return sum(x for x, y in zip(e, labels, strict=True) if y) + sum(field.steps[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(product((0, 1), repeat=len(found)), key=worth)
        assert abs(worth(best) - worth([int(x) for x in field.decode(found)])) < 1e-9


def test_pages_table(spark, field):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (None, None, None, None), (2, "u", "", "t"), (2, "u", PAGE * 300, "t")], "page_id bigint, url string, html string, text string")
    found = html_crf.main_text(pages, field).collect()
    assert len(found) == 4 and {r["page_id"]: r["n_chars"] for r in found}[None] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_crf.main_text(pages.limit(0), field).count() == 0
