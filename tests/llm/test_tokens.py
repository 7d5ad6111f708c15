"""Token counts, cutting and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from waybill.llm import packing, segments, token_counts
from waybill.llm.common import codes
from waybill.llm.queries import VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)
TOKENIZER = Tokenizer.from_file(PATH)
COUNTER = token_counts.Counter(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


TEXTS = st.lists(st.text("aéZ1½!' \n\t 　strevlmd中’<|endoftext>", max_size=60), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts_and_pieces_of_odd_texts(texts):
    texts = [*texts, "a<|endoftext|>b<|endoftext|>", " ".join(texts) * 20]
    assert COUNTER.counts(texts).tolist() == [len(ids_of(t)) for t in texts]
    at, borders = codes(texts)
    starts = segments.Segmenter(TOKENIZER).starts(at, borders).tolist()
    assert starts == [int(o) + a for t, o in zip(texts, borders) for _, (a, _) in TOKENIZER.pre_tokenizer.pre_tokenize_str(t)]


def test_chunk_maps_compose_to_the_map_of_the_whole():
    rows = np.random.default_rng(2).integers(0, 9, (segments.CHUNK, 7)).astype(np.uint8)
    whole = segments.chunk_maps(rows.T.reshape(-1, 1))[:, 0]
    composed = np.arange(segments.STATES)
    for part in segments.chunk_maps(rows).T:
        composed = part[composed]
    assert composed.tolist() == whole.tolist()


def test_transducer_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    random.seed(4)
    words = ["".join(random.choices("etaoinshr", k=12)) for _ in range(200)]
    transducer = token_counts.PieceTransducer(TOKENIZER)
    assert [transducer.count(w.encode()) for w in words] == [len(ids_of(w)) for w in words]


def test_states_stay_bounded_within_a_long_piece_and_between_short_ones(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "SIDE_BYTES", 64)
    r = random.Random(6)
    transducer = token_counts.PieceTransducer(TOKENIZER)
    long = "".join(r.choices("etaoinshré", k=3000))
    assert transducer.count(long.encode()) == len(ids_of(long)) and len(transducer.keys) <= 52
    words = ["".join(r.choices("etaoinshr", k=r.randint(1, 90))) for _ in range(300)] + [""]
    assert transducer.counts([w.encode() for w in words]).tolist() == [len(ids_of(w)) for w in words]
    assert len(transducer.keys) <= 50 + 64 + 2 and transducer.counts([]).tolist() == []


def test_tokens_may_follow_where_plain_merging_leaves_them():
    r = random.Random(7)
    transducer = token_counts.PieceTransducer(TOKENIZER)
    assert transducer.in_order
    tokens = list(transducer.rank)
    pairs = [tuple(r.choices(tokens, k=2)) for _ in range(1000)]
    for text in r.choices([t for t in map(transducer.bytes_of.get, tokens) if len(t) > 1], k=2000):
        k = r.randrange(1, len(text))
        pairs.append((transducer.encode(text[:k])[-1], transducer.encode(text[k:])[0]))
    pairs += [(a, a) for a in r.choices(tokens, k=300)]
    expected = [transducer.encode(transducer.bytes_of[a] + transducer.bytes_of[b]) == [a, b] for a, b in pairs]
    assert [transducer.may_follow(a, b) for a, b in pairs] == expected and 500 < sum(expected) < 2500


def test_a_merge_before_those_of_its_halves(tmp_path):
    import json

    given = json.loads(TOKENIZER.to_str())
    letters = sorted(token_counts.byte_letters())
    given["added_tokens"], given["model"]["merges"] = [], [["a", "bc"], ["b", "c"], ["c", "a"]]
    given["model"]["vocab"] = {t: i for i, t in enumerate([*letters, "bc", "abc", "ca"])}
    (tmp_path / "t.json").write_text(json.dumps(given))
    library, counter = Tokenizer.from_file(str(tmp_path / "t.json")), token_counts.Counter(str(tmp_path / "t.json"))
    r = random.Random(8)
    texts = ["".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(300)]
    assert not counter.transducer.in_order
    assert counter.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts(odd, empty):
    rows = token_counts.token_counts(odd, PATH, limit=100).collect()
    expected = sorted((str(i), len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 100) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == expected
    assert rows[0].spans == "s"
    assert token_counts.token_counts(empty, PATH).count() == 0


def test_packing(odd, empty):
    size = 64
    rows = packing.pack(odd, PATH, size).collect()
    expected = []
    for i, text, *_ in ODD:
        ids = [*ids_of(text), 1]
        for s in range(0, len(ids), size):
            part = np.array(ids[s:s + size], "<u4")
            expected.append((str(i), s, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == sorted(expected)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(empty, PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_shortest_pack_first(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 2048): r.randint(1, 10 ** r.randint(0, 9)) for _ in range(r.randint(1, 400))}
    patterns = packing.shortest_pack_first(histogram, 2048)
    placed = defaultdict(int)
    for p in patterns:
        assert p.room >= 0 and sum(n * each for n, each, _ in p.parts) == 2048 - p.room
        for length, each, _ in p.parts:
            placed[length] += each * p.count
    assert dict(placed) == histogram


ENCODER = packing.Encoder(PATH)


def swapped(n):
    """Two words of n letters that every polynomial hash modulo a power of two confuses."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_ids_of_odd_texts(texts):
    texts = [*texts, "a<|endoftext|>b <|endoftext|> ", " ".join(texts) * 5, "  ".join(texts), "it's, we'll. don't! x　 y\x85 z\xa0 1,2 a.\n b ..."]
    assert [i.tolist() for i in ENCODER.ids(texts)] == [ids_of(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab'.,!é1 \n", max_size=30), max_size=30))
def test_ids_of_words_with_signs(texts):
    assert [i.tolist() for i in ENCODER.ids(texts)] == [ids_of(t) for t in texts]


def test_every_settled_character_is_cut_alike():
    """Each one after and before a letter, a number, a sign, a space and a line break."""
    settled = [chr(c) for c in range(0x2100) if packing._SETTLED.fullmatch(chr(c))]
    texts = [f"a{c}a 1{c}1 !{c}! {c} {c}{c}\n{c}a\n{c} {c}1 a{c} 1{c} {c}'s it'{c}s" for c in settled]
    assert len(settled) > 600 and [i.tolist() for i in ENCODER.ids(texts)] == [ids_of(t) for t in texts]


def test_random_letters_encode_alike():
    r = random.Random(5)
    texts = ["".join(r.choice("etaoinsrhldcumfé' ") for _ in range(400)) for _ in range(300)] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 590)])) for _ in range(200)) for _ in range(300)]
    assert ENCODER.core and [i.tolist() for i in ENCODER.ids(texts)] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("change", [{"unk_token": "a"}, {"ignore_merges": True}])
def test_other_tokenizers_are_left_to_the_library(tmp_path, change):
    import json

    given = json.loads(TOKENIZER.to_str())
    given["model"].update(change)
    (tmp_path / "t.json").write_text(json.dumps(given))
    assert packing.Encoder(str(tmp_path / "t.json")).core is None
    given = json.loads(TOKENIZER.to_str())
    given["model"]["merges"][300:302] = given["model"]["merges"][300:302][::-1]
    (tmp_path / "u.json").write_text(json.dumps(given))
    turned = packing.Encoder(str(tmp_path / "u.json"))
    assert turned.core is None and turned.ids(["some text 中"])[0].tolist() == Tokenizer.from_file(str(tmp_path / "u.json")).encode("some text 中", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1024, 2048])
@pytest.mark.parametrize("tasks", [1, 2])
def test_words_that_polynomials_confuse(spark, n, tasks):
    a, b = swapped(n)
    assert COUNTER.counts([a, b]).tolist() == [len(ids_of(a)), len(ids_of(b))] and [i.tolist() for i in ENCODER.ids([a, b])] == [ids_of(a), ids_of(b)]
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").repartition(tasks, "doc_id")
    counted = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, PATH).collect()}
    assert counted == {1: len(ids_of(a)), 2: len(ids_of(b))}
    crc = lambda t: zlib.crc32(np.array([*ids_of(t), 1], "<u4").tobytes())
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(df, PATH).collect()} == {1: crc(a), 2: crc(b)}


def test_a_column_with_the_name_of_a_helper(spark):
    df = spark.createDataFrame([(1, "two words", "x", "y")], "doc_id long, text string, _text string, _text_ string")
    row = token_counts.token_counts(df, PATH).first()
    assert (row._text, row._text_, row.n_tokens) == ("x", "y", len(ids_of("two words")))


def test_pieces_with_equal_hashes_are_told_apart():
    a, b = swapped(1024)
    at, borders = codes([a, b, a, "c", b, "c"])
    first, group = segments.equal_pieces(at, borders[:-1])
    assert len(first) == 3 and group[0] == group[2] != group[1] == group[4] and group[3] == group[5]
