"""op10: words and their pieces are kept once, and give the tokenizer's ids."""

import json
import random

import public_tokenizers
from tokenizers import Tokenizer

from riskweave.llm import op10_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
MARKS = list("aAbzéÉñß0 12'''..,-!\n\t") + ["'s", "'LL", "\x1c", "\x85", "\xa0", "ŉ", "İ", "ĸ", "Ÿ", "é", "日", "\U0001f600", "the", "Straße", "don't"]


def words(n, seed=11):
    r = random.Random(seed)
    return ["".join(r.choice(MARKS) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_a_piece_and_its_word_are_kept_once():
    encode = op10_packing.Encoder(PATH)
    seen, model = [], encode.tokenize
    encode.tokenize = lambda piece: seen.append(piece) or model(piece)
    encode(["alpha alpha. alpha, ALPHA beta été été. Été"], 2)
    assert sorted(seen) == sorted(["alpha", ".", ",", "beta", "Ã©tÃ©"])
    assert not encode.pieces and len(encode) == len(["", "alpha", "alpha.", ".", "alpha,", ",", "ALPHA", "beta", "été", "été.", "Été"])


def test_ids_are_the_tokenizers(monkeypatch):
    tok, texts = Tokenizer.from_file(PATH), words(3000) + ["x" * 70 + ".", " ".join(words(400, 12))]
    expected = [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [x.tolist() for x in op10_packing.Encoder(PATH)(texts, 2)] == expected
    monkeypatch.setattr(op10_packing, "WORD_BYTES", 20 * op10_packing.ENTRY_BYTES)          # forgets all the time
    small = op10_packing.Encoder(PATH)
    assert [x.tolist() for x in small(texts[:500], 2)] == expected[:500]


def test_another_pattern_takes_the_tokenizers_steps(tmp_path):
    """In 'ab' no match of this pattern is its own: 'a' counts before a letter only, and 'b' alone is no match of its own rule."""
    made = json.load(open(PATH))
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}](?=[\p{L}])|[^\s]"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    tok, texts = Tokenizer.from_file(str(path)), words(300)
    assert [x.tolist() for x in op10_packing.Encoder(str(path))(texts, 2)] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]
