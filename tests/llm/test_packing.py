import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from platewright.llm import packing as p

TEXTS = [None, "", "Hello,  World's\n\tend", "naïve É́ ﬁ  x y <|endoftext|> it's 'S 123", "ΟΔΟΣ ΣΑΣ's Σ", "a" * 3000, "word " * 9000, "한글 가 é", "\x1c\x85 z\x00q"]


def test_memo_gives_the_tokenizer_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.default_tokenizer())
    encode = p.Encoder(p.default_tokenizer(), memo=3)
    texts = [x or "" for x in TEXTS] + ["again Hello, World's", "a|b | || |x", "<|ENDOFTEXT|> <|startoftext|>x", "| |"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for got in (encode([x.encode() for x in texts]), [encode([x.encode()])[0] for x in texts]):
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_words_of_letters_go_to_the_model_alone():
    from tokenizers import Tokenizer

    class Counted:
        texts: list = []

        def encode(self, text, **how):
            self.texts.append(text)
            return t.encode(text, **how)

    t, encode = Tokenizer.from_file(p.default_tokenizer()), p.Encoder(p.default_tokenizer())
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(192, 256)] if c not in (215, 247)]
    rng = random.Random(2)
    plain = letters + ["".join(rng.choices(letters, k=rng.randint(2, 12))) + rng.choice(["", "", ".", "?!", "$$$", "(-)", "'"]) for _ in range(3000)]
    encode.tokenizer = Counted()
    odd = ["a×b", "÷", "é\u0301", "e\u0301", "İx", "ŉa", "ſt", "Σας", "l'été's", "x's.", "d'un'", "a1b2", "½²", "naïve|", "<|endoftext|>é", "É<|x", "a\xa0ü", "fi\x00", "ªº", "K\u212a", "\u1e9eß", "ﬁ"]
    for texts in (plain, odd, ["  ".join(plain[:900]), " ".join(odd)]):
        got = [np.frombuffer(g, "<u4").tolist() for g in encode([x.encode() for x in texts])]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
        if texts is plain:
            assert encode.known and not any(c.isalpha() for x in Counted.texts for c in x)


def test_best_fit_decreasing_equals_a_plain_search():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        got, rooms = p.best_fit_decreasing(lengths, 64), []
        plain = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
            else:
                fit = [64]
            rooms.append(min(fit) - n)
            plain.append(n)
        used = defaultdict(int)
        for (w, o), n in sorted(zip(got, lengths, strict=True)):
            assert o == used[w]
            used[w] += n
        assert sorted(64 - u for u in used.values()) == sorted(rooms)


@pytest.mark.parametrize("bin_pieces", [4, 8192])
def test_every_id_in_one_piece(spark, bin_pieces):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.default_tokenizer())
    texts = TEXTS + [f"some text number {i} " * (i % 90) for i in range(60)]
    docs = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)], "doc_id long, text string, length int")
    out = p.pack(docs, bin_pieces=bin_pieces).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, x in enumerate(texts):
        ids, at = t.encode(x or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_empty_table(spark):
    assert p.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
