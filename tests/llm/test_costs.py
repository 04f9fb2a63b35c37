"""What the corpus operators do without: the costly ways that their CPU budgets don't allow, with the same results."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from geoweft.llm import lines, packing


def _alike(seed: int, alphabet: str) -> list[str]:
    r = random.Random(seed)
    first = "".join(r.choices(alphabet, k=300))
    out = [first, " " + first[:-40] + "\t", first[40:] + first, "".join(r.choices(alphabet, k=300)), alphabet[:7], alphabet[:3], "x" * 8, "\0" * 9]
    for n in (1, 2, 3, 5, 8):
        changed = list(first)
        for k in r.sample(range(300), n):
            changed[k] = r.choice(alphabet)
        out.append("".join(changed))
    return out


@pytest.mark.parametrize("alphabet", ["abcdefgh\0 .", "abcé\xff ", "日本語のテキスト\U0001f600\udc80", "".join(map(chr, range(0x4E00, 0x4F80)))])
def test_verification_is_exact_for_every_alphabet(alphabet):
    texts = _alike(5, alphabet)
    sets = lines.Shingled(texts)
    assert sets.packed == (len(set("".join(texts))) <= lines.CODES)
    for k, a in enumerate(texts):
        for j in range(k):
            x, y = lines.shingles(a), lines.shingles(texts[j])
            assert sets.similar(k, j, 0.8) == (len(x & y) >= 0.8 * len(x | y)), (k, j)


def test_verification_makes_no_strings_of_latin_shingles(monkeypatch):
    texts = _alike(7, "abcdefghijklmnopqrstuvwxyz é")
    batch = pa.RecordBatch.from_arrays([pa.array([9] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array([[9]] * len(texts), pa.list_(pa.int64())), pa.array(texts)], ["band", "h", "bands", "line"])
    want = lines.Forest()
    for k, a in enumerate(texts):
        for j in range(k):
            x, y = lines.shingles(a), lines.shingles(texts[j])
            if len(x & y) >= 0.8 * len(x | y):
                want.union(k, j)
    monkeypatch.setattr(lines, "shingles", None)
    got = [r for b in lines._verified(0.8)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == sorted(want.stars()) and got


def test_uncovered_rows_are_those_of_a_plain_walk():
    r = random.Random(3)
    rows = sorted((b, h, sorted({b, *r.sample(range(60), 4)})) for b in range(50) for h in range(r.choice((1, 2, 2, 3, 70))))
    want = [(b, h) for b, h, own in rows if any(c == b and g != h and not {x for x in own if x < b} & {x for x in other if x < b} for c, g, other in rows) or False]
    big = {b for b in range(50) if sum(x[0] == b for x in rows) > lines.PAIRED}
    batches = [pa.RecordBatch.from_pylist([{"band": b, "h": h, "bands": own} for b, h, own in rows[k : k + 37]]) for k in range(0, len(rows), 37)]
    got = [(b, h) for x in lines._uncovered(iter(batches)) for b, h in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    assert [x for x in got if x[0] not in big] == [x for x in want if x[0] not in big] and {x for x in want if x[0] in big} <= set(got)


def test_bands_of_blocks_of_any_size():
    texts = [x for seed in range(40) for x in _alike(seed, "abc é日\udc80")]
    assert (lines.bands(texts) == np.concatenate([lines.bands([x]) for x in texts])).all()


class _Asked:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.texts = tokenizer, []

    def encode(self, text, **more):
        self.texts.append(text)
        return self.tokenizer.encode(text, **more)

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_packing_asks_the_library_for_marks_once(monkeypatch):
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = [f"{a}{b}é" for a in "abcdefgh" for b in ("zu", "Ön", "ly")]
    texts = [" ".join(w + m for w in words for m in ("###", "!!", ".***", ",", "%")) for _ in range(3)]
    want = [np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    e.tokenizer = _Asked(e.tokenizer)
    assert list(e.encode(texts)) == want and len(e.tokenizer.texts) <= 5


def test_packing_of_words_with_any_marks_and_of_long_texts(monkeypatch):
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    marks = [chr(k) for k in range(33, 127) if not chr(k).isalnum()] + ["'s", "'!", "!'s", "<|", "<|endoftext|>", "<|endoftext|>!", "s'", "_1", "\u0338", "!\u0338", "\u0301", "\n!", "\xa0", "\xad", "²"]
    texts = ["", " ", "!", " ".join(f"{w}{a}{b}" for w in ("Word", "été", "ß", "x1", "", "日本") for a in marks for b in ("", "!", "."))]
    texts += [" ".join(f"{w}{a}{b}" for w in ("Word", "été", "ß", "") for b in ("", "!", ".")) for a in marks]
    want = [np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert list(e.encode(texts)) == want
    monkeypatch.setattr(packing, "BATCH_BYTES", 7)
    monkeypatch.setattr(packing, "REMEMBERED", 2000)
    assert list(e.encode(texts)) == want and e.held < 4000
