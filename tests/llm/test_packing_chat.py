import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelstone.llm import chat, packing, queries
from keelstone.llm.tokens import Encoder

PATH = queries.vocabulary()


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_runs_equal_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins: dict[int, list] = {}
    for length, rank, n, first, per, offset in packing.pack(counts, 40):
        for k in range(n):
            bins.setdefault(first + k // per, []).append((offset + k % per * length, length))
    assert sum(map(len, bins.values())) == len(lengths)
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= 40
    assert sorted(40 - sum(n for _, n in b) for b in bins.values()) == best_fit(lengths, 40)


def test_query(spark, sf, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = queries.op3_best_fit_packing(spark, sf).collect()
    by: dict[int, list] = {}
    seqs: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lengths = [r.length for r in rows]
    for i, ids in want.items():
        at = 0
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert len(parts) == -(-len(ids) // 2048) and all(r.length == 2048 for r in parts[1:])
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
    assert len(seqs) == len(best_fit(lengths, 2048))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 \n\té漢🙂'.<|endoftext|>\x85 ", max_size=40))
def test_both_encoders_agree(text):
    assert FAST(text).tolist() == SLOW(text).tolist()


FAST, SLOW = Encoder(PATH, queries.vocabulary_ranks()), Encoder(PATH)


def test_sequences_hold_the_documents(spark, docs):
    packed = packing.pack_documents(docs.select("doc_id", "text"), PATH, with_ids=True)
    got = packing.sequences(packed)
    assert max(len(r.input_ids) for r in got.collect()) <= 2048
    assert got.selectExpr("sum(size(input_ids))").first()[0] == packed.selectExpr("sum(length)").first()[0]


def test_packing_edges(edge, none):
    rows = packing.pack_documents(edge, PATH).collect()
    assert {r.length for r in rows if r.doc_id in (1, 2)} == {1}
    assert packing.pack_documents(none, PATH).count() == 0


TEXT = st.text(alphabet="ab\\<>/ \n turnext é🙂", max_size=30) | st.sampled_from(["</turn>", "<turn>", "<\\turn>", "\\", queries.TRICKY, "<text>\\</turn>", "<|endoftext|>", "<|endof<|endoftext|>", "<\\|endoftext|>", "<<turn>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<turn>"]), TEXT), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns, CONTROL)
    assert chat.read_back(text) == turns
    e = TOK.encode(text, add_special_tokens=False)
    offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
    mask = chat.loss_mask(offsets, [(a, b) for r, a, b in spans if r == "assistant"])
    assert chat.masked_text(text, offsets, mask) == "".join(t for r, t in turns if r == "assistant")
    ids = [TOK.token_to_id(t) for t in (chat.OPEN, chat.BODY, chat.CLOSE, "<|endoftext|>")]
    assert [e.ids.count(i) for i in ids] == [len(turns)] * 3 + [0]
    halves = [chat.render(turns[:2], CONTROL)[0], chat.render(turns[2:], CONTROL)[0]]
    assert [i for h in halves if h for i in TOK.encode(h, add_special_tokens=False).ids] == e.ids


TOK = chat.tokenizer(PATH)
CONTROL = chat.control_pattern(chat.control_tokens(PATH))


def test_whole_conversations(spark):
    """Blocks put together: offsets lead into the whole text, ids are those of one encoding."""
    rows = [(c, i, ("user", "assistant")[i % 2], f"é turn {i} <|endoftext|>" * (i % 5)) for c, n in ((1, 150), (2, 3)) for i in range(n)]
    got = chat.whole_conversations(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), PATH)).collect()
    assert {r.conv_id for r in got} == {1, 2}
    for r in got:
        turns = [(role, t) for c, _, role, t in rows if c == r.conv_id]
        e = TOK.encode(r.formatted, add_special_tokens=False)
        assert chat.read_back(r.formatted) == turns and list(r.input_ids) == e.ids and list(zip(r.starts, r.ends)) == e.offsets
        offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
        assert chat.masked_text(r.formatted, offsets, np.array(r.loss_mask)) == "".join(t for role, t in turns if role == "assistant")


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (None, 0, "assistant", "lone"), (2, 5, "assistant", "same"), (2, 5, "assistant", "same"), (3, 0, "assistant", "word " * 100_000)]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(1000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, block string")
    got = {r.conv_id: r for r in chat.digest_rows(chat.format_conversations(df, PATH)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 3, None: 1, 2: 2, 3: 1, 4: 1000}
    assert got[2].loss_chars == 8 and got[1].loss_chars == 5 and got[3].loss_chars == 500_000
    assert got[4].loss_chars == sum(len(f"turn {i}") for i in range(1, 1000, 2))
    assert chat.format_conversations(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_segment_tree(seed):
    g = random.Random(seed)
    c = packing.Capacities(50)
    rooms: dict[int, int] = {}
    for i in range(400):
        if g.random() < 0.6 or not rooms:
            r = g.randrange(1, 51)
            c.add(r, i, i + 1)
            rooms[r] = rooms.get(r, 0) + 1
        else:
            need = g.randrange(1, 51)
            want = min((r for r in rooms if r >= need), default=None)
            assert c.tightest(need) == want
            if want:
                c.take(want, 1)
                rooms[want] -= 1
                if not rooms[want]:
                    del rooms[want]


def test_vocabulary_is_a_parameter():
    assert PATH == public_tokenizers.path("byte_bpe_50k.json")
