"""Codec, token counts under edits and packing, against the public tokenizer."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tables import DOCUMENTS, EMPTY, documents
from tidepanel.llm import bpe, lexicon, packing, token_trees
from tidepanel.llm.common import text_buffers

PARTS = ["a", "b", "s", "t", "re", "ll", "d", "'", " ", "  ", "\n", "\t", " ", "　", "é", "ß", "1", "²", "!", "…", "<|endoftext|>", "<|endo", "😀", "\r\n", "中", "\x1c", "\x85", "don't", "the", " of"]


@pytest.fixture(scope="module")
def tokenizer():
    loaded = Tokenizer.from_file(bpe.default_path())
    loaded.no_padding()
    loaded.no_truncation()
    return loaded


def random_texts(count, seed=1, most=30):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, most))) for _ in range(count)]


def own_ids(texts, ids_of=None):
    vocab = bpe.vocabulary(bpe.default_path())
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    ids, at = bpe.encode(data, offsets, ids_of or vocab.merge)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_ids_equal_the_tokenizers(tokenizer):
    texts = [*random_texts(5000), "", "a" * 3000, "x9" * 2000, "ab'" * 900]
    assert own_ids(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_has_the_tokenizers_class(tokenizer):
    texts = [f"a{chr(c)}1 {chr(c)}!" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    assert own_ids(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_transducer_accepts_its_words_only_and_shares_states():
    words = {w.encode(): tuple(range(100 * k, 100 * k + 1 + k % 3)) for k, w in enumerate(["run", "running", "runs", "sun", "sunning", "suns", "", "x"])}
    machine = lexicon.Transducer.compile(words)
    asked = [*words, b"ru", b"runn", b"sunsx", b"y"]
    accepted, ids, at = machine.run(pa.array(asked, pa.large_binary()))
    for k, word in enumerate(asked):
        if word and word in words:
            assert accepted[k] and tuple(ids[at[k]:at[k + 1]]) == words[word]
        else:
            assert not accepted[k] and at[k] == at[k + 1]
    same = {b"ab" + tail: (1, 2) for tail in (b"x", b"y")} | {b"cb" + tail: (3, 2) for tail in (b"x", b"y")}
    assert len(lexicon.Transducer.compile(same).accepts) == 4  # the start, and one state behind each letter: ids are decided by the first


def test_lexicon_never_changes_ids(tokenizer, tmp_path):
    vocab = bpe.vocabulary(bpe.default_path())
    texts = random_texts(300, 5)
    frequent = [" of", "the", "don", "'t", "\n", "a"]
    flat, at = vocab.merge(pa.array([w.encode() for w in frequent], pa.large_binary()))
    machine = lexicon.Transducer.compile({w.encode(): tuple(flat[at[k]:at[k + 1]].tolist()) for k, w in enumerate(frequent)})
    path = tmp_path / "lexicon"
    path.write_bytes(machine.to_bytes())
    assert own_ids(texts, lexicon.lexicon_ids(lexicon.Transducer.mapped(str(path)), vocab)) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_codec_of_odd_rows(spark, tokenizer):
    rows = lexicon.encode_documents(documents(spark), words=50, with_ids=True).collect()
    assert len(rows) == len(DOCUMENTS)
    expected = sorted((str(d[0]), hashlib.sha256(",".join(map(str, tokenizer.encode(d[1] or "", add_special_tokens=False).ids)).encode()).hexdigest(),
                       hashlib.sha256((d[1] or "").encode()).hexdigest()) for d in DOCUMENTS)
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in rows) == expected
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert lexicon.encode_documents(documents(spark, EMPTY)).collect() == []


def test_decoding_bytes_that_are_no_text():
    vocab = bpe.vocabulary(bpe.default_path())
    assert lexicon.decode([int(vocab.base[0xE9]), int(vocab.base[0x61])], vocab) == b"\xe9a".decode("utf-8", "replace")


def test_counts_follow_edits(tokenizer):
    vocab = bpe.vocabulary(bpe.default_path())
    rnd = random.Random(3)
    texts = [*random_texts(150, 8, 600), "", " ", "<|endoftext|>", "word " * 500, "x" * 2000]
    edits = [[(rnd.randint(-2, len(t) + 5), rnd.choice([0, 1, 5, 300, 10**6]), rnd.choice(["", " ", "'s", "\n", "|endoftext|>", "new words " * 80])) for _ in range(rnd.randint(0, 6))] for t in texts]
    documents_ = token_trees.open_documents(texts, vocab)
    token_trees.apply_edits(documents_, edits, vocab)
    for text, changes, document in zip(texts, edits, documents_):
        for start, removed, inserted in changes:
            start = min(max(start, 0), len(text))
            text = text[:start] + inserted + text[start + removed:]
        assert document.text == text
        assert document.tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)
    long = documents_[-2]
    before = long.encoded
    token_trees.apply_edits([long], [[(1000, 3, "y")]], vocab)
    assert 0 < long.encoded - before < 3 * token_trees.LEAF_BYTES + 700


def test_edited_counts_of_odd_rows(spark, tokenizer):
    from tidepanel.llm.queries import document_edits

    rows = token_trees.count_edited(documents(spark).withColumn("edits", document_edits())).collect()
    assert len(rows) == len(DOCUMENTS) and all(r["n_edits"] == 3 for r in rows)
    assert sorted(r["n_tokens_before"] for r in rows) == sorted(len(tokenizer.encode(d[1] or "", add_special_tokens=False).ids) for d in DOCUMENTS)
    none = documents(spark).selectExpr("doc_id", "text", "cast(null as array<struct<start:bigint,removed:bigint,inserted:string>>) as edits")
    assert all(r["n_tokens"] == r["n_tokens_before"] for r in token_trees.count_edited(none).collect())


def check_packing(rows, ids, capacity=1024):
    place, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        place[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for held in place.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc, own in ids.items():
        at = 0
        own = own + [2]
        for nth, r in enumerate(sorted(pieces[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (nth, at) and (nth == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    return len(place)


def test_packing_of_a_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()}
    used = check_packing(packing.pack_documents(docs).collect(), ids)
    assert used <= -(-sum(len(i) + 1 for i in ids.values()) // 1024) + 2


def test_packing_of_odd_rows(spark, tokenizer):
    rows = packing.pack_documents(documents(spark)).collect()
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode(d[1] or "", add_special_tokens=False).ids) + 1 for d in DOCUMENTS)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(documents(spark, EMPTY)).collect() == []


def optimum(lengths, capacity):
    """Fewest sequences by exhaustive search."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[k]}):
            other = list(rooms)
            other.remove(room)
            place(k + 1, other + [room - lengths[k]])
        place(k + 1, rooms + [capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_dominance_never_costs_a_sequence(seed):
    rnd = random.Random(seed)
    lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
    counts = {x: lengths.count(x) for x in lengths}
    reduced = packing.Plan(counts, 20)
    while reduced.left and (fixed := reduced.dominating()):
        reduced.fix(fixed)
    rest = [x for x, n in reduced.left.items() for _ in range(n)]
    assert reduced.sequences + (optimum(rest, 20) if rest else 0) == optimum(lengths, 20)
    plan = packing.solve(counts, 20)
    assert sum(r[2] for r in plan.rows) == len(lengths)
    assert plan.sequences <= optimum(lengths, 20) + 1


@pytest.mark.parametrize("seed", range(40))
def test_reduction_of_every_length_never_costs_a_sequence(seed):
    rnd = random.Random(seed)
    lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
    plan = packing.Plan({x: lengths.count(x) for x in lengths}, 20)
    plan.reduce()
    assert all(plan.dominating(x) is None for x in plan.left)
    rest = [x for x, n in plan.left.items() for _ in range(n)]
    assert plan.sequences + (optimum(rest, 20) if rest else 0) == optimum(lengths, 20)


def test_exact_pairs_of_shorter_lengths_are_fixed():
    # nothing dominates for 70, 3 + 5 + 8 fit beside it; 60 and 40 fill a sequence
    counts = {70: 1, 60: 4, 40: 4, 8: 1, 5: 1, 3: 1}
    assert packing.Plan(counts, 100).dominating() is None
    assert packing.solve(counts, 100).reduced >= 4
