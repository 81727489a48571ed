"""The automaton against substring search; held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from ebbtide.llm import language
from ebbtide.llm.language import automaton, identify, learn, phrases

NOT_HELD_OUT = "crc32(cast(doc_id AS string)) % 3 <> 1"


def greedy(text, known):
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and "".join(map(chr, text[i:i + n + 1])) in known:
            n += 1
        count += 1
        i += n
    return count


@pytest.mark.parametrize("seed", range(6))
def test_phrases_are_longest_matches(seed):
    draw = random.Random(seed)
    train = [draw.randrange(4) for _ in range(draw.randint(1, 80))]
    known = "".join(map(chr, train))
    docs = [[draw.randrange(5) for _ in range(draw.choice([0, 1, 7, 255, 256]))] for _ in range(20)]
    starts = np.cumsum([0, *map(len, docs)])
    symbols = np.array([c for d in docs for c in d], np.uint8)
    got = phrases(symbols, starts, automaton(train, 5), 5)
    assert got.tolist() == [greedy(d, known) for d in docs]


def test_blocks_restart(monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 4)
    monkeypatch.setattr(language, "LANES", 3)
    table = automaton([0, 1, 2, 3] * 3, 4)
    assert phrases(np.array([0, 1, 2, 3] * 5, np.uint8), np.array([0, 20]), table, 4).tolist() == [5]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, NOT_HELD_OUT)
    out = identify(docs, model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    held = [r for r in out if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 20
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out) and {r.lang_pred for r in out} <= {*model.languages, "und"}


def test_copies_do_not_thin_the_sample(make_docs):
    few = [f"{a} und {b} schlafen auf dem sofa" for a, b in (("der hund", "die katze"), ("das kind", "der vogel"), ("die maus", "das pferd"))]
    english = [(10_000 + i, f"the cat number {chr(97 + i)} sat on the mat", "en") for i in range(20)]
    rows = [(i, few[i % 3], "de") for i in range(3000)] + english
    model = learn(make_docs(rows), "true", symbols=500, rows=3)
    once = learn(make_docs(rows[:3] + english), "true", symbols=500, rows=3)
    assert model.languages == once.languages == ["de", "en"] and model.sizes == once.sizes
    assert model.sizes[0] == sum(len(t) + 1 for t in few)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, once.tables))


def test_edges(make_docs):
    rows = [(i, "the cat sat on the mat and the dog ran", "en") for i in range(20)]
    rows += [(100 + i, "der hund und die katze schlafen auf dem sofa", "de") for i in range(20)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 34 !!", None), (None, "die katze und der hund", None),
             (203, "the dog and the cat " * 5000, None), (203, "日本語", None)]
    docs = make_docs(rows, extra=["lang_pred", "score", "h"])
    model = learn(docs, NOT_HELD_OUT, symbols=500, rows=3)
    assert model.languages == ["de", "en"] and max(model.sizes) <= 500
    out = [(r.doc_id, r.lang_pred) for r in identify(docs, model).collect()]
    assert (200, "und") in out and (201, "und") in out and (202, "und") in out
    assert (None, "de") in out and (203, "en") in out and len(out) == len(rows)
    empty = learn(make_docs([]), NOT_HELD_OUT)
    assert {r.lang_pred for r in identify(docs, empty).collect()} == {"und"}
    assert identify(make_docs([]), model).count() == 0


def _plain(text, samples):
    """Language and share of a text by longest substrings of the samples, code point by code point."""
    points = language.clean(text)
    bits = {}
    for lang, sample in samples.items():
        own = language.own_letters(sample)
        known = "".join(map(chr, language.spell(sample, own)[0]))
        symbols = language.spell(points, own)[0].tolist()
        # a phrase per block of 256 symbols at least
        count = sum(greedy(symbols[a:a + language.BLOCK], known) for a in range(0, len(symbols), language.BLOCK))
        bits[lang] = count * np.log2(max(len(sample), 2)) / max(len(points), 1)
    best = min(sorted(bits), key=bits.get)
    return best, 1 / sum(np.exp(-language.SHARPNESS * (b - bits[best])) for b in bits.values())


SCRIPTS = {
    "el": "ο σκύλος και η γάτα κοιμούνται στον καναπέ του σπιτιού", "ru": "собака и кошка спят на диване в доме",
    "ja": "犬と猫は家のソファで眠っている毎日", "zh": "狗和猫每天都在家里的沙发上睡觉", "ko": "개와 고양이는 집 소파에서 잔다",
    "ar": "الكلب والقط ينامان على الأريكة في البيت", "en": "the dog and the cat sleep on the sofa at home",
    "fr": "le chien et le chat dorment sur le canapé à la maison"}


def test_whole_predictions_equal_a_plain_parser_over_many_scripts(make_docs):
    draw = random.Random(5)

    def text(lang, n):
        words = SCRIPTS[lang].split(" ") if " " in SCRIPTS[lang] else list(SCRIPTS[lang])
        return (" " if " " in SCRIPTS[lang] else "").join(draw.choice(words) for _ in range(n))

    rows = [(1000 * k + i, text(lang, 12), lang) for k, lang in enumerate(SCRIPTS) for i in range(25)]
    held = [(90_000 + 100 * k + i, text(lang, 9), None) for k, lang in enumerate(SCRIPTS) for i in range(5)]
    held += [(99_000, text("ru", 300), None), (99_001, "ж" * 700 + " ŵ 犬", None)]
    model = learn(make_docs(rows), "true", symbols=600, rows=10)
    assert model.languages == sorted(SCRIPTS)
    samples = dict(zip(model.languages, model.texts))
    for most in (language.TABLE_BYTES, 1):  # all languages at once, and one at a time
        got = {r.doc_id: (r.lang_pred, r.score) for r in identify(make_docs(held), model, most).collect()}
        for i, t, _ in held:
            name, score = _plain(t, samples)
            assert got[i][0] == name and abs(got[i][1] - score) < 1e-9
        assert all(got[90_000 + 100 * k + i][0] == lang for k, lang in enumerate(SCRIPTS) for i in range(5))


def test_every_label_is_learned(make_docs):
    rows = [(i, f"word{chr(0x4E00 + i)} only{chr(0x5E00 + i)}", f"l{i:03d}") for i in range(450)]
    rows += [(1000 + i, "common words of a frequent label", "big") for i in range(50)]
    assert learn(make_docs(rows), "true", symbols=50, rows=3).languages == sorted({r[2] for r in rows})


def test_passages_come_from_the_whole_text(make_docs):
    long = "a" * 5000 + " " + "b" * 5000 + " " + "c" * 5000
    rows = [(i, long + " " + "d" * i, "x") for i in range(1, 60)]
    seen = set(map(chr, learn(make_docs(rows), "true", symbols=4000, rows=40).texts[0].tolist()))
    assert {"a", "b", "c"} <= seen


def test_no_two_letters_share_a_spelling():
    points = np.array([*range(0x41, 0x5B), *range(0x400, 0x460), *range(0x4E00, 0x5600), 0x20000, 0x10FFFF], np.uint32)
    symbols, width = language.spell(points, np.arange(0x41, 0x51, dtype=np.uint32))
    ends = np.cumsum(width)
    spellings = {tuple(symbols[e - w:e]) for e, w in zip(ends, width)}
    assert len(spellings) == len(points) and symbols.max() < language.ALPHABET
