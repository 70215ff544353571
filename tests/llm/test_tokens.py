"""The encoder's pieces: what is looked up, what goes through tokenizers, what is kept."""

import random

import numpy as np
import pyarrow as pa
import pytest

from saltmarsh.llm import tokens as T


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.vocabulary())


def same(mine, theirs, texts):
    for t, ids in zip(texts, mine(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, t


def column(*pieces):
    return pa.array(pieces, pa.large_binary())


def test_words_with_accents_and_lines_are_cut():
    data = np.frombuffer("ça é è\nOù \tß".encode(), np.uint8)
    at = [0, *T.cut_places(data).tolist(), len(data)]
    assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == ["ça", " é", " è", "\n", "Où \tß"]


def test_words_go_to_the_merges(theirs, monkeypatch):
    mine, through = T.Encoder(T.vocabulary()), []
    own = mine._through
    monkeypatch.setattr(mine, "_through", lambda text: through.append(text) or own(text))
    same(mine, theirs, ["The quick élan of ñandú words", " straße où naïveté", "Übermut"])
    assert through == []
    same(mine, theirs, ["3×4÷5 a×b é÷é", "it's l'été 12é", "ª º ́é"])
    assert through


@pytest.mark.parametrize("seed", range(3))
def test_odd_white_space_and_letters(theirs, seed):
    rng, mine = random.Random(seed), T.Encoder(T.vocabulary())
    alphabets = ["éñß×÷Ā \n\ta", "é \n", "ab'sé \t\n", "ȿɀʰ a\n", "\u0085é a\n \r", "aé1!' \n\t\r", "　é \na ", "\x00a é\n", "漢é \n", "".join(map(chr, range(0x250)))]
    same(mine, theirs, ["".join(rng.choice(a) for _ in range(rng.randrange(30))) for a in alphabets for _ in range(200)])


def test_pieces_are_found_by_their_bytes():
    known = T.Pieces()
    assert known.find(column(b"a"), np.zeros(1, np.uint64)).tolist() == [-1]
    # Equal hashes: one of the pieces is found, no other is taken for it.
    known.add(column(b"a", b"b", b"a\0"), np.zeros(3, np.uint64))
    found = known.find(column(b"a", b"b", b"a\0", b"c", b""), np.zeros(5, np.uint64)).tolist()
    assert sorted(found)[:4] == [-1] * 4 and all(n in (-1, i) for i, n in enumerate(found))
    # Slots wrap, and arrays grow.
    pieces = column(*(b"%d" % i for i in range(5000)))
    hashed = np.uint64(T.SLOTS - 7) + np.arange(5000, dtype=np.uint64) // np.uint64(3) * np.uint64(T.SLOTS + 1) + (np.arange(5000, dtype=np.uint64) % np.uint64(3) << np.uint64(60))
    known = T.Pieces()
    for i in range(0, 5000, 700):
        known.add(pieces.slice(i, 700), hashed[i : i + 700])
    assert known.find(pieces, hashed).tolist() == list(range(5000)) and len(known) == 5000


def test_hashes_differ():
    pieces = [b"x" * n for n in range(1, 65)] + [b"x" * n + b"\0" for n in range(64)] + [b"%d" % i for i in range(50_000)]
    pieces = sorted(set(pieces))
    whole = column(*pieces)
    hashed = T.hashes(*T.utf8(whole))
    assert len(set(hashed.tolist())) == len(pieces) and (T.hashes(*T.utf8(whole.slice(7, 30))) == hashed[7:37]).all()


def test_a_full_table_is_begun_again(theirs, monkeypatch):
    monkeypatch.setattr(T, "MOST_PIECES", 50)
    mine, rng = T.Encoder(T.vocabulary()), random.Random(1)
    for _ in range(40):
        same(mine, theirs, [" ".join(rng.choice(["é", "long" * 30, "1", "''"]) + str(rng.randrange(30)) for _ in range(10))])
        assert len(mine.known) <= 50 and mine.kept == mine.size.all().sum()
    # One text of more pieces than the table takes.
    same(mine, theirs, [" ".join(f"w{i} {'é' * 40}{i}" for i in range(400)), "w1 w2"])
    assert len(mine.known) <= 50


def test_pieces_that_come_again_stay(theirs, monkeypatch):
    monkeypatch.setattr(T, "MOST_PIECES", 50)
    mine, merged = T.Encoder(T.vocabulary()), []
    own = mine._merged
    monkeypatch.setattr(mine, "_merged", lambda pieces: merged.extend(pieces.to_pylist()) or own(pieces))
    for i in range(60):
        same(mine, theirs, [f" élan word {chr(97 + i // 26)}q{chr(97 + i % 26)}x"])
    assert merged.count(b" word") == merged.count(" élan".encode()) == 1 and len(merged) > 60
